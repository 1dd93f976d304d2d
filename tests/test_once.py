"""Features of customers are worked out once for a query, and their items are dealt out once."""

import pytest
from patronage.operators import axes
from patronage.operators.cleaning import to_items
from patronage.queries import models, scoring, segments
from patronage.sources.tables import Tables

from tests.conftest import SMALL


@pytest.mark.parametrize("name", ["CLU-2", "CHN-2", "CMP-2", "CLU-7"])
def test_features_are_worked_out_once(spark, monkeypatch, name):
    from patronage import catalog

    rows = spark.sparkContext.accumulator(0)

    def each(batches):
        for batch in batches:
            rows.add(batch.num_rows)
            yield batch

    wide = segments.wide_of(Tables(spark, SMALL))
    spark.sparkContext.setLogLevel("ERROR")
    wide = wide.localCheckpoint()
    for module in (segments, scoring, models):
        monkeypatch.setattr(module, "wide_of", lambda t: wide.mapInArrow(each, wide.schema))
    got = catalog.queries()[name](spark, SMALL)
    assert got.count() > 0 and rows.value == wide.count()


def test_items_are_dealt_out_once(spark):
    items = to_items(Tables(spark, SMALL).sales_lines).localCheckpoint()
    plan = axes.item_features(items)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange ") == 1 and "Expand" not in plan


def test_item_features_by_hand(spark):
    lines = [(1, 1, 10, "a", 3, 5.0, 0.0), (1, 2, 10, "a", 1, 7.0, 7.0), (1, 2, 11, None, 4, 1.0, 0.0), (1, 3, 12, "b", 2, 3.0, 0.0), (2, 4, 10, None, 0, 2.0, 0.0)]
    items = spark.createDataFrame(lines, "customer_id long, order_id long, product_id long, category string, quantity long, price double, refund_amount double")
    got = {r.customer_id: r for r in axes.item_features(items).collect()}
    a, b = got[1], got[2]
    assert (a.total_items, a.unique_products, a.unique_categories, a.categories_mastered) == (4, 3, 2, 0)
    assert (a.repeat_product_rate, a.avg_repurchase_count, a.items_returned_pct, a.total_refunds) == pytest.approx((1 / 3, 2.0, 0.25, 7.0))
    assert a.product_concentration == pytest.approx(0.16 + 0.16 + 0.04) and a.loyalty_index == pytest.approx(0.4) and a.primary_category_dominance == pytest.approx(4 / 6)
    assert a.category_diversity == pytest.approx(0.9182958340544896) and a.avg_item_price == pytest.approx(4.0)
    assert (b.total_items, b.unique_products, b.unique_categories, b.category_diversity) == (1, 1, 0, 0.0) and b.product_concentration is None and b.price_variance is None
