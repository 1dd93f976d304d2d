"""A star schema of customer profiles that is loaded run by run (SRC-15): archetype dimension, current facts, history.

* ``dim_archetype``: one row for each level and signature under a surrogate key. The key is a digest of both, so it needs
  no numbering and is the same in every run; the first run that sees an archetype writes its row, later ones leave it.
* ``fact_current``: one row for each customer, as its last run had it, and when it was first seen.
* ``fact_history``: what each customer was from ``valid_from`` to ``valid_to``; a run closes a row and opens another
  only where an archetype of the customer has changed. Closed rows are appended, open ones are written anew.

Each run writes tables of its own number and only then the line in ``runs`` by which readers find them, so a run that
dies half way leaves no trace but files; running it again writes its number again.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from patronage.sources.tables import exists

RUNS = "run int, loaded_at timestamp_ntz"


def archetype_key(level: str, signature: Column) -> Column:
    """The surrogate key of an archetype."""
    return F.when(signature.isNotNull(), F.substring(F.md5(F.concat(F.lit(f"{level}|"), signature)), 1, 16))


def last_run(spark: SparkSession, path: str) -> int:
    """The number of the last complete run, 0 before the first."""
    if not exists(spark, f"{path}/runs"):
        return 0
    return spark.read.schema(RUNS).parquet(f"{path}/runs").agg(F.max("run")).first()[0] or 0


def read(spark: SparkSession, path: str, name: str) -> DataFrame:
    """A table after the last complete run; ``fact_history`` is its closed and its open rows."""
    run = last_run(spark, path)
    if not run:
        raise ValueError(f"no run under {path}")
    if name != "fact_history":
        return spark.read.parquet(f"{path}/{name}/run={run}")
    open_rows = spark.read.parquet(f"{path}/history_open/run={run}")
    closed = [f"{path}/history_closed/run={k}" for k in range(2, run + 1)]
    rest = open_rows.withColumn("valid_to", F.lit(None).cast("timestamp_ntz"))
    return rest.unionByName(spark.read.parquet(*closed)) if closed else rest


def load(profiles: DataFrame, path: str, at: datetime, levels: dict[str, str], metrics: tuple[str, ...], value: str, key: str = "customer_id") -> int:
    """Load a run of profiles, one row for each customer; returns its number.

    ``levels`` names the column of the signature of each level, ``metrics`` the columns that facts carry, ``value`` the
    metric whose mean the dimension keeps. Of rows that repeat a customer one stays, the smallest.
    """
    spark, done = profiles.sparkSession, last_run(profiles.sparkSession, path)
    run, when = done + 1, F.lit(at).cast("timestamp_ntz")
    ids = [f"{level}_id" for level in levels]

    def write(df: DataFrame, name: str) -> None:
        df.write.mode("overwrite").parquet(f"{path}/{name}/run={run}")

    chosen = profiles.groupBy(key).agg(F.min(F.struct(*levels.values(), *metrics)).alias("p")).select(key, "p.*")
    write(chosen.select(key, *[archetype_key(level, F.col(c)).alias(f"{level}_id") for level, c in levels.items()], *[F.col(c).alias(f"signature_{level}") for level, c in levels.items()], *metrics), "staged")
    new = spark.read.parquet(f"{path}/staged/run={run}")

    # All levels are counted in one reading, within the tasks first.
    each = F.array(*[F.struct(F.lit(level).alias("level"), F.col(f"{level}_id").alias("archetype_id"), F.col(f"signature_{level}").alias("signature")) for level in levels])
    seen = new.select(F.explode(each).alias("a"), F.col(value).alias("v")).where("a.archetype_id IS NOT NULL").groupBy("a.level", "a.archetype_id", "a.signature").agg(F.count("*").alias("member_count"), F.avg("v").alias("mean_value"))
    total = new.agg(F.count("*").alias("all"))
    found = seen.crossJoin(F.broadcast(total)).select("archetype_id", "level", "signature", "member_count", (100 * F.col("member_count") / F.col("all")).alias("population_pct"), "mean_value", when.alias("first_seen"))
    facts = new.select(key, *ids, *metrics)
    if not done:
        write(found, "dim_archetype")
        write(facts.select("*", when.alias("first_seen"), when.alias("last_updated")), "fact_current")
        write(facts.select("*", when.alias("valid_from")), "history_open")
    else:
        known = spark.read.parquet(f"{path}/dim_archetype/run={done}")
        write(known.unionByName(found.join(known.select("archetype_id"), "archetype_id", "left_anti")), "dim_archetype")
        old = spark.read.parquet(f"{path}/fact_current/run={done}")
        both = old.select(key, F.struct("*").alias("o")).join(facts.select(key, F.struct("*").alias("n")), key, "full")
        now = [F.coalesce(F.col(f"n.{c}"), F.when(F.col("n").isNull(), F.col(f"o.{c}"))).alias(c) for c in (*ids, *metrics)]
        write(both.select(key, *now, F.coalesce("o.first_seen", when).alias("first_seen"), F.when(F.col("n").isNull(), F.col("o.last_updated")).otherwise(when).alias("last_updated")), "fact_current")
        opened = spark.read.parquet(f"{path}/history_open/run={done}")
        pair = opened.select(key, F.struct("*").alias("o")).join(facts.select(key, F.struct("*").alias("n")), key, "full")
        same = F.lit(True)
        for c in ids:
            same = same & F.col(f"o.{c}").eqNullSafe(F.col(f"n.{c}"))
        stays = F.col("n").isNull() | (F.col("o").isNotNull() & same)
        row = lambda s: [F.col(f"{s}.{c}").alias(c) for c in (*ids, *metrics)]
        kept = pair.where(stays).select(key, *row("o"), F.col("o.valid_from").alias("valid_from"))
        fresh = pair.where(~stays).select(key, *row("n"), when.alias("valid_from"))
        write(kept.unionByName(fresh), "history_open")
        write(pair.where(~stays & F.col("o").isNotNull()).select(key, *row("o"), F.col("o.valid_from").alias("valid_from"), when.alias("valid_to")), "history_closed")
    spark.createDataFrame([(run, at)], RUNS).coalesce(1).write.mode("append").parquet(f"{path}/runs")
    return run
