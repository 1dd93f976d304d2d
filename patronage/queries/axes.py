"""AXIS-1 to AXIS-13, FEAT-1 and FEAT-2."""

from __future__ import annotations

from patronage.operators import axes
from patronage.operators.cleaning import to_items, to_orders
from patronage.queries.registry import WIDE, query, rounded
from patronage.sources.tables import Tables

WHOLE = {"total_orders", "recent_orders_90d", "days_since_last_purchase", "unique_categories", "unique_products", "preferred_time_numeric", "customer_maturity_score", "lifecycle_stage", "primary_channel_numeric", "channel_diversity", "category_switching", "categories_mastered"}


def wide_of(t: Tables):
    # The last date of orders that have lines, without building the orders for it.
    dated = t.headers.join(t.raw_lines.select("order_id"), "order_id", "left_semi")
    return axes.wide_features(to_orders(t.headed_lines), to_items(t.sales_lines), axes.reference_date_of(dated))


def _pick(names, prefix: str = "") -> str:
    return ", ".join(f"CAST({n} AS BIGINT) AS {prefix}{n}" if n in WHOLE and not prefix else f"round(coalesce(CAST({n} AS DOUBLE), 0), 6) AS {prefix}{n}" if prefix else f"round({n}, 6) AS {n}" for n in names)


def _register(no: int, name: str) -> None:
    @query(f"AXIS-{no}", f"WITH {WIDE}\nSELECT customer_id, {_pick(axes.AXES[name])} FROM wide")
    def one(t: Tables):
        df = rounded(axes.axis(wide_of(t), name))
        return df.select(*[df[c].cast("long").alias(c) if c in WHOLE else df[c] for c in df.columns])


for _no, _name in enumerate(axes.AXES, 1):
    _register(_no, _name)


@query("FEAT-1", f"WITH {WIDE}\nSELECT customer_id, " + _pick(dict.fromkeys(f for fs in axes.AXES.values() for f in fs)) + " FROM wide")
def feat_1(t: Tables):
    wide = wide_of(t)
    names = dict.fromkeys(f for fs in axes.AXES.values() for f in fs)
    df = rounded(wide.select("customer_id", *[wide[axes.ALIASES.get(f, f)].alias(f) for f in names]))
    return df.select(*[df[c].cast("long").alias(c) if c in WHOLE else df[c] for c in df.columns])


@query("FEAT-2", f"WITH {WIDE}\nSELECT customer_id, " + ", ".join(_pick(fs, f"{a}__") for a, fs in axes.AXES.items()) + " FROM wide")
def feat_2(t: Tables):
    return rounded(axes.flatten(wide_of(t)))
