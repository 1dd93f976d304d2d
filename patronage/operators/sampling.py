"""Samples of customers: tiers, strata, weights, spread."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from patronage.operators.quantiles import quantiles

# Cuts of the tiers and the shares of a sample they get.
TIER_CUTS, TIER_SHARES = (0.5, 0.8, 0.95), (0.2, 0.3, 0.3, 0.2)


def draw(key: str, seed: int) -> Column:
    """A number in (0, 1) from a hash of the key: the same after any repartitioning."""
    return (F.shiftrightunsigned(F.xxhash64(F.col(key), F.lit(seed)), 11) + 0.5) / float(1 << 53)


def digest(key: str, seed: int) -> Column:
    """An order of rows by a digest of their key, the same in any engine."""
    return F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")))


def tiered(df: DataFrame, key: str, value: str, n: int, seed: int = 1, by: Callable[[str, int], Column] = draw) -> DataFrame:
    """A sample with fixed quotas of four value tiers, drawn in the order ``by`` (SMP-1)."""
    cuts = F.array(*[F.lit(float(c)) for c in quantiles(df, [F.col(value).cast("double")], TIER_CUTS)[0]])
    tier = F.size(F.filter(cuts, lambda c: c < F.col(value)))
    quota = F.element_at(F.array(*[F.lit(int(s * n)) for s in TIER_SHARES]), F.col("tier") + 1)
    t = df.withColumn("tier", tier)
    return t.withColumn("_r", F.row_number().over(W.partitionBy("tier").orderBy(by(key, seed), key))).where(F.col("_r") <= quota).drop("_r")


def stratified(df: DataFrame, key: str, stratum: str, n: int, strata: int, seed: int = 1, by: Callable[[str, int], Column] = draw) -> DataFrame:
    """n rows, equal quotas for each stratum, topped up from all other rows where quotas do not make n (SMP-2)."""
    ranked = df.withColumn("_r", F.row_number().over(W.partitionBy(stratum).orderBy(by(key, seed), key)))
    base = ranked.where(F.col("_r") <= n // strata).drop("_r")
    drawn = base.count()  # strata times their quota at most
    more = df.join(base.select(key), key, "left_anti").orderBy(by(key, seed + 1), key).limit(max(0, n - drawn))
    return base.unionByName(more)


def weighted(df: DataFrame, key: str, weight: Column, n: int, seed: int = 1) -> DataFrame:
    """Without replacement, by weight: the n smallest of -ln(u) / w (SMP-3)."""
    return df.where(weight > 0).orderBy(-F.ln(draw(key, seed)) / weight, key).limit(n)


def at_random(df: DataFrame, key: str, n: int, seed: int = 1) -> DataFrame:
    """n rows in the order of a digest of their key: the same draw in any engine (SMP-6)."""
    return df.orderBy(F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string"))), key).limit(n)


def sample_size(rows: int) -> int:
    """A quarter below 10,000 rows, 5 % below 100,000, 3 % above; 500 to 5000 (SMP-5)."""
    share = 0.25 if rows < 10_000 else 0.05 if rows < 100_000 else 0.03
    return max(500, min(5000, int(rows * share)))


#: Which sample fits an axis: by tiers of value where there is nothing else to say.
STRATEGIES = {
    "weighted": ("purchase_value", "value_sophistication"),
    "recent": ("customer_maturity", "loyalty_trajectory"),
    "diverse": ("category_exploration", "communication_preference", "problem_complexity_profile", "product_knowledge"),
}


def strategy(axis: str) -> str:
    """The sampling strategy of an axis: weighted, recent, diverse or tiered (SMP-5)."""
    return next((s for s, own in STRATEGIES.items() if axis in own), "tiered")


def for_axis(df: DataFrame, axis: str, key: str, value: str, age_days: str, n: int, seed: int = 1) -> DataFrame:
    """A sample of n rows by the strategy of an axis; ``value`` weighs, ``age_days`` are days since the last purchase (SMP-5)."""
    kind = strategy(axis)
    if kind == "weighted":
        return weighted(df, key, F.col(value), n, seed)
    if kind == "recent":
        return weighted(df, key, 1 / (F.col(age_days) + 1.0), n, seed)
    return at_random(df, key, n, seed) if kind == "diverse" else tiered(df, key, value, n, seed).drop("tier")
