"""Point-in-time snapshots of memberships, and drift between them."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from patronage.operators import membership

#: Centres of two axes over orders / 10 and value / 1e6.
CENTERS = {"frequency": {"light": (0.3,), "steady": (0.8,), "heavy": (1.5,)}, "value": {"small": (0.4,), "mid": (1.0,), "large": (2.0,)}}
#: Days each type of snapshot is kept.
KEEP_DAYS = {"daily": 7, "weekly": 60, "monthly": 365, "quarterly": 730, "yearly": 1825}


def snapshot_type(day: Column) -> Column:
    """yearly, quarterly, monthly, weekly (Sunday) or daily (SC-9)."""
    first = F.dayofmonth(day) == 1
    return F.when(first & (F.month(day) == 1), "yearly").when(first & F.month(day).isin(4, 7, 10), "quarterly").when(first, "monthly").when(F.weekday(day) == 6, "weekly").otherwise("daily")


def snapshots(orders: DataFrame, dates: list[date]) -> DataFrame:
    """State of every customer at each date, from its orders before it; the dates are dealt out, not joined row by row (SNP-1).

    Orders combine to (customer, first date they count for) before the running totals, so rows do not multiply by dates.
    """
    days = sorted(dates)
    at = F.array(*[F.lit(d) for d in days])
    slot = F.size(F.filter(at, lambda d: d <= F.to_date("order_date")))
    new = orders.withColumn("slot", slot).where(F.col("slot") < len(days)).groupBy("customer_id", "slot").agg(F.count("*").alias("n"), F.sum("total_price").alias("v"), F.min("order_date").alias("f"))
    dense = new.groupBy("customer_id").agg(F.collect_list(F.struct("slot", "n", "v", "f")).alias("s"))  # one entry for each date at most
    out = dense.select("customer_id", F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.lit(d).alias("snapshot_date")) for k, d in enumerate(days)])).alias("d"), "s").select("customer_id", "d.*", F.filter("s", lambda x: x["slot"] <= F.col("d.k")).alias("s")).where(F.size("s") > 0)
    total = lambda name, zero: F.aggregate("s", zero, lambda a, x: a + x[name])
    state = out.select("customer_id", "snapshot_date", snapshot_type(F.col("snapshot_date")).alias("snapshot_type"), total("n", F.lit(0).cast("long")).alias("orders_at"), total("v", F.lit(0.0)).alias("value_at"), F.array_min(F.transform("s", lambda x: x["f"])).alias("first_order"))
    point = {"frequency": F.col("orders_at") / 10, "value": F.col("value_at") / 1e6}
    m = F.create_map(*[x for a, c in CENTERS.items() for x in (F.lit(a), membership.memberships(membership.distances([point[a]], c)))])
    top = lambda a: membership.ranked(F.col("memberships")[a])[0]["segment"]
    return state.withColumn("memberships", m).withColumn("dominant", F.create_map(*[x for a in CENTERS for x in (F.lit(a), top(a))])).withColumn("archetype", F.concat_ws("/", *[F.col("dominant")[a] for a in CENTERS]))


def consecutive(snaps: DataFrame) -> DataFrame:
    """Each snapshot with the customer's previous one: days between, drift of each axis and over all (WIN-5, DRF-1 to DRF-3)."""
    w = W.partitionBy("customer_id").orderBy("snapshot_date")
    before = snaps.select("*", *[F.lag(c).over(w).alias(f"old_{c}") for c in ("snapshot_date", "memberships", "dominant", "archetype", "value_at")]).where(F.col("old_snapshot_date").isNotNull())
    axes = list(CENTERS)
    each = before.withColumn("axis_drift", F.create_map(*[x for a in axes for x in (F.lit(a), membership.drift(F.col("old_memberships")[a], F.col("memberships")[a]))]))
    overall = F.aggregate(F.map_values("axis_drift"), F.lit(0.0), lambda s, x: s + x) / len(axes)
    out = each.withColumn("drift", overall).withColumn("days", F.datediff("snapshot_date", "old_snapshot_date"))
    d = F.col("drift")
    severity = F.when(d < 0.1, "stable").when(d < 0.3, "minor").when(d < 0.5, "moderate").when(d < 0.7, "major").otherwise("severe")
    changed = F.map_keys(F.map_filter("dominant", lambda k, v: v != F.col("old_dominant")[k]))
    return out.select("customer_id", "old_snapshot_date", "snapshot_date", "days", "axis_drift", "drift", (d / F.nullif("days", F.lit(0))).alias("velocity"), severity.alias("severity"), F.array_sort(changed).alias("changed_axes"), (d >= 0.5).alias("anomaly"), "old_archetype", "archetype", (F.col("value_at") - F.col("old_value_at")).alias("value_delta"))


def drift_summary(steps: DataFrame) -> DataFrame:
    """Mean, extremes and spread of a customer's drift, and the pattern of its velocity (DRF-4, DRF-5)."""
    w = W.partitionBy("customer_id").orderBy("snapshot_date")
    seq = steps.withColumn("i", F.row_number().over(w) - 1)
    g = seq.groupBy("customer_id").agg(F.count("*").alias("n"), F.avg("drift").alias("mean_drift"), F.max("drift").alias("max_drift"), F.min("drift").alias("min_drift"), F.stddev_pop("drift").alias("drift_std"), F.count_if("anomaly").alias("anomalies"), F.count_if(F.size("changed_axes") > 0).alias("transitions"), F.regr_slope("velocity", "i").alias("slope"), F.avg("velocity").alias("mean_velocity"))
    pattern = F.when(F.col("n") < 3, "insufficient_data").when(F.col("slope") > 0.01, "accelerating").when(F.col("slope") < -0.01, "stabilizing").when(F.col("mean_velocity") > 0.02, "steady_drift").otherwise("stable")
    return g.withColumn("pattern", pattern).withColumn("oscillations", F.lit(0).cast("long")).drop("slope")


def transitions(snaps: DataFrame) -> DataFrame:
    """Changes of archetype with the days spent in the one before (WIN-10)."""
    w = W.partitionBy("customer_id").orderBy("snapshot_date")
    seq = snaps.select("customer_id", "snapshot_date", "archetype", F.lag("archetype").over(w).alias("before"))
    start = seq.withColumn("run", F.max(F.when(F.col("before").isNull() | (F.col("before") != F.col("archetype")), F.col("snapshot_date"))).over(w.rowsBetween(W.unboundedPreceding, 0)))
    moved = start.withColumn("old_run", F.lag("run").over(w)).where(F.col("before").isNotNull() & (F.col("before") != F.col("archetype")))
    return moved.select("customer_id", F.col("before").alias("from_archetype"), F.col("archetype").alias("to_archetype"), "snapshot_date", F.datediff("snapshot_date", "old_run").alias("days_in_previous"))


def transition_paths(snaps: DataFrame, least: int = 3) -> DataFrame:
    """Paths between archetypes taken at least ``least`` times, with mean days in the one before, drift and velocity of the step (AGG-19)."""
    steps = consecutive(snaps).select("customer_id", "snapshot_date", "drift", "velocity")
    moves = transitions(snaps).join(steps, ["customer_id", "snapshot_date"])
    return moves.groupBy("from_archetype", "to_archetype").agg(F.count("*").alias("n"), F.avg("days_in_previous").alias("avg_days"), F.avg("drift").alias("avg_drift"), F.avg("velocity").alias("avg_velocity"), F.min("snapshot_date").alias("first_seen"), F.max("snapshot_date").alias("last_seen")).where(F.col("n") >= least)


def purge(snaps: DataFrame, reference: date) -> DataFrame:
    """Snapshots young enough for their type (FLT-8)."""
    keep = F.create_map(*[F.lit(x) for kv in KEEP_DAYS.items() for x in kv])
    return snaps.where(F.datediff(F.lit(reference), "snapshot_date") <= keep[F.col("snapshot_type")])


def as_of(snaps: DataFrame, reference: date, horizons: list[int], value: str) -> DataFrame:
    """A value as it was 0 or more days before the reference date: the last snapshot not after that day (JOIN-16)."""
    day = lambda h: F.date_sub(F.lit(reference), h)
    return snaps.groupBy("customer_id").agg(*[F.max(F.when(F.col("snapshot_date") <= day(h), F.struct("snapshot_date", value)))[value].alias(f"{value}_{h}d") for h in horizons])


def horizons(snaps: DataFrame, short: tuple[int, int] = (7, 14), long: tuple[int, int] = (90, 180), moved: int = 28, rapid: float = 0.015, moderate: float = 0.008, risky: float = 0.010) -> DataFrame:
    """Drift of each snapshot over a short and a long horizon (DRF-7); a state is that of the last snapshot not after so many days before.

    * velocity: how far memberships are from those ``short[0]`` days before, for each day between, with its alert
    * short_drift, long_drift: between the two states of each horizon; acceleration: the former less the latter
    * migration: the archetype differs from that ``moved`` days before; axes_changed with both segments, days_elapsed
    * churn_risk: HIGH where the frequency segment has fallen from heavy and the velocity is above ``risky``

    All states come from one sort of a customer's snapshots, by range frames over the day.
    """
    by_day = W.partitionBy("customer_id").orderBy("day")
    state = F.struct("snapshot_date", "memberships", "dominant", "archetype")
    lags = sorted({*short, *long, moved})
    seq = snaps.withColumn("day", F.unix_date("snapshot_date"))
    at = seq.select("*", *[F.last(state).over(by_day.rangeBetween(W.unboundedPreceding, -h)).alias(f"s{h}") for h in lags])
    between = lambda a, b: membership.membership_drift(F.col(f"s{b}")["memberships"], F.col(f"s{a}")["memberships"])
    before, old = F.col(f"s{short[0]}"), F.col(f"s{moved}")
    days = F.datediff("snapshot_date", before["snapshot_date"])
    v = membership.membership_drift(before["memberships"], F.col("memberships")) / F.nullif(days, F.lit(0))
    alert = F.when(v > rapid, "RAPID_DRIFT").when(v > moderate, "MODERATE_DRIFT").when(v.isNotNull(), "STABLE")
    changes = F.map_filter(F.map_zip_with(old["dominant"], F.col("dominant"), lambda k, a, b: F.when(~a.eqNullSafe(b), F.struct(a.alias("from"), b.alias("to")))), lambda k, x: x.isNotNull())
    axes = F.array_sort(F.transform(F.map_entries(changes), lambda e: F.struct(e["key"].alias("axis"), e["value"]["from"].alias("from"), e["value"]["to"].alias("to"))))
    fallen = (old["dominant"]["frequency"] == "heavy") & (F.col("dominant")["frequency"] != "heavy")
    out = at.select("customer_id", "snapshot_date", v.alias("velocity"), alert.alias("alert"), between(*short).alias("short_drift"), between(*long).alias("long_drift"), (old["archetype"] != F.col("archetype")).alias("migrated"), old["archetype"].alias("from_archetype"), F.col("archetype").alias("to_archetype"), axes.alias("axes_changed"), F.datediff("snapshot_date", old["snapshot_date"]).alias("days_elapsed"), F.when(fallen & (v > risky), "HIGH").alias("churn_risk"))
    return out.withColumn("acceleration", F.col("short_drift") - F.col("long_drift"))
