"""Scaling, soft membership in segments, and what follows from memberships."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from patronage.operators.quantiles import quantiles

#: Shares that differ by less are equal: rounding alone sets them apart.
ALIKE = 1e-9


@dataclass(frozen=True)
class Scaler:
    """Centre, divisor and clip limits of each feature, from one aggregation of one row."""

    features: tuple[str, ...]
    center: tuple[float, ...]
    scale: tuple[float, ...]
    low: tuple[float, ...] | None = None
    high: tuple[float, ...] | None = None

    def columns(self, clip: bool = True) -> list[Column]:
        out = []
        for k, f in enumerate(self.features):
            x = F.coalesce(F.col(f).cast("double"), F.lit(0.0))
            if clip and self.low is not None:
                x = F.least(F.greatest(x, F.lit(self.low[k])), F.lit(self.high[k]))
            out.append((x - self.center[k]) / self.scale[k])
        return out


def clip_limits(df: DataFrame, features: tuple[str, ...], low: float = 0.01, high: float = 0.99) -> tuple[tuple[float, ...], tuple[float, ...]]:
    """The two percentiles of each feature, all in one aggregation (CLU-1)."""
    found = quantiles(df, [F.coalesce(F.col(f).cast("double"), F.lit(0.0)) for f in features], (low, high))
    return tuple(q[0] for q in found), tuple(q[1] for q in found)


def fit_scaler(df: DataFrame, features: tuple[str, ...], kind: str = "standard", winsorise: bool = False) -> Scaler:
    """Standard (mean, population deviation) or robust (median, interquartile range) scaling; a zero divisor is 1 (CLU-2, CLU-3)."""
    low, high = clip_limits(df, features) if winsorise else (None, None)
    x = Scaler(features, (0.0,) * len(features), (1.0,) * len(features), low, high).columns()
    if kind == "standard":
        row = df.agg(*[F.struct(F.avg(c).alias("a"), F.stddev_pop(c).alias("b")).alias(f) for f, c in zip(features, x, strict=True)]).first()
        center, scale = [row[f]["a"] for f in features], [row[f]["b"] for f in features]
    else:
        found = quantiles(df, x, (0.25, 0.5, 0.75))
        center, scale = [q[1] for q in found], [q[2] - q[0] for q in found]
    return Scaler(features, tuple(c or 0.0 for c in center), tuple(s or 1.0 for s in scale), low, high)


def distances(point: list[Column], centers: dict[str, tuple[float, ...]]) -> Column:
    """Euclidean distance to each segment's centre, as a map; a column expression, so no join (JOIN-7, SC-15)."""
    far = lambda c: F.sqrt(sum(((p - F.lit(v)) ** 2 for p, v in zip(point, c, strict=True)), F.lit(0.0)))
    return F.create_map(*[x for name, c in centers.items() for x in (F.lit(name), far(c))])


def memberships(d: Column, kind: str = "exp") -> Column:
    """Shares of the segments from distances: ``exp`` exp(-d), ``inverse`` 1 / (1 + d), ``nearest`` all to the nearest (MEM-1 to MEM-3)."""
    least = F.array_min(F.map_values(d))
    if kind == "nearest":
        best = F.array_min(F.transform(F.map_entries(d), lambda e: F.struct(e["value"], e["key"])))["key"]
        return F.transform_values(d, lambda k, v: (k == best).cast("double"))
    # The smallest distance is taken off before exp: the shares are the same and cannot all vanish.
    weight = (lambda v: F.exp(least - v)) if kind == "exp" else (lambda v: 1 / (1 + v))
    raw = F.transform_values(d, lambda k, v: weight(v))
    total = F.aggregate(F.map_values(raw), F.lit(0.0), lambda a, x: a + x)
    return F.transform_values(raw, lambda k, v: v / total)


def ranked(m: Column) -> Column:
    """Entries of a membership map from the largest share down, ties by name, as structs (score, segment).

    Shares within ``ALIKE`` of each other are ties: where two distances are equal by rule, as on the two sides of a centre,
    the last digits of the scaling would else order all customers by the way in which rows happened to be added up.
    """
    shares = F.map_values(m)
    place = lambda v: F.array_max(F.filter(shares, lambda w: w <= v + ALIKE))
    down = F.array_sort(F.transform(F.map_entries(m), lambda e: F.struct((-place(e["value"])).alias("n"), e["key"].alias("segment"), e["value"].alias("score"))))
    return F.transform(down, lambda x: F.struct(x["score"].alias("score"), x["segment"].alias("segment")))


def strength(top: Column) -> Column:
    """strong, balanced or weak, from ranked entries (MEM-4)."""
    first, second = top[0]["score"], F.get(top, 1)["score"]
    return F.when(first > 0.7, "strong").when((first > 0.4) & F.coalesce(second > 0.3, F.lit(False)), "balanced").otherwise("weak")


def drift(old: Column, new: Column) -> Column:
    """L2 distance of two membership maps over the union of their segments (missing is 0), over sqrt(2), 1 at most (DRF-1)."""
    gap = F.map_values(F.map_zip_with(old, new, lambda k, a, b: (F.coalesce(a, F.lit(0.0)) - F.coalesce(b, F.lit(0.0))) ** 2))
    return F.least(F.lit(1.0), F.sqrt(F.aggregate(gap, F.lit(0.0), lambda s, x: s + x)) / 2**0.5)


def membership_drift(old: Column, new: Column) -> Column:
    """One L2 norm over all axes that both maps of maps have, not normalised (DRF-6, UDF-1)."""
    both = F.map_filter(F.map_zip_with(old, new, lambda k, a, b: F.when(a.isNotNull() & b.isNotNull(), F.aggregate(F.map_values(F.map_zip_with(a, b, lambda s, x, y: (F.coalesce(x, F.lit(0.0)) - F.coalesce(y, F.lit(0.0))) ** 2)), F.lit(0.0), lambda t, x: t + x))), lambda k, v: v.isNotNull())
    return F.sqrt(F.aggregate(F.map_values(both), F.lit(0.0), lambda t, x: t + x))


def outlier_score(m: Column, floor: float = 0.3) -> Column:
    """1 - max / floor, 0 at least: high where no segment fits (OUT-1)."""
    return F.greatest(F.lit(0.0), 1 - F.array_max(F.map_values(m)) / floor)
