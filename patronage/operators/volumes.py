"""Ticket volumes over all grains, forecasts of them and how they came out, and tickets for each product sold."""

from __future__ import annotations

from datetime import date, datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

GRAINS = ("hour", "day", "week", "month")
DIMENSIONS = ("channel", "priority", "category", "status")


def volume_cube(tickets: DataFrame, holidays: tuple[date, ...] = ()) -> DataFrame:
    """Tickets for each period of each grain, with maps of counts by channel, priority, category and status (TKT-6).

    One scan: tickets are counted by hour and all four fields within the tasks first; these counts are dealt to the four
    grains, and one aggregation over grouping sets makes total and maps. Missing fields count as ``unknown``; tickets
    without a time are left out. hour_of_day is of hours only, day_of_week (0 is Monday) of hours and days.
    """
    at = F.date_trunc("hour", "created_at").cast("timestamp_ntz")
    hours = tickets.where("created_at IS NOT NULL").groupBy(at.alias("at"), *[F.coalesce(d, F.lit("unknown")).alias(d) for d in DIMENSIONS]).agg(F.count("*").alias("n"))
    each = F.array(*[F.struct(F.lit(g).alias("granularity"), F.date_trunc(g, "at").cast("timestamp_ntz").alias("period_start")) for g in GRAINS])
    dealt = hours.select(F.explode(each).alias("p"), *DIMENSIONS, "n").select("p.*", *DIMENSIONS, "n")
    keys = ["granularity", "period_start"]
    sets = dealt.groupingSets([keys, *[[*keys, d] for d in DIMENSIONS]], *keys, *DIMENSIONS).agg(F.grouping_id().alias("set"), F.sum("n").alias("n"))
    whole = (1 << len(DIMENSIONS)) - 1
    of = lambda k: whole - (1 << (len(DIMENSIONS) - 1 - k))
    maps = [F.map_from_entries(F.array_sort(F.collect_list(F.when(F.col("set") == of(k), F.struct(d, "n"))))).alias(f"tickets_by_{d}") for k, d in enumerate(DIMENSIONS)]
    g = sets.groupBy(*keys).agg(F.max(F.when(F.col("set") == whole, F.col("n"))).alias("ticket_count"), *maps)
    start, short = F.col("period_start"), F.col("granularity").isin("hour", "day")
    ends = F.when(F.col("granularity") == "hour", start + F.expr("INTERVAL '1' HOUR")).when(F.col("granularity") == "day", start + F.expr("INTERVAL '1' DAY")).when(F.col("granularity") == "week", start + F.expr("INTERVAL '7' DAY")).otherwise(F.add_months(F.to_date(start), 1).cast("timestamp_ntz"))
    holiday = F.to_date(start).isin(*holidays) if holidays else F.lit(False)
    return g.select(
        "granularity", "period_start", ends.alias("period_end"), "ticket_count", *[f"tickets_by_{d}" for d in DIMENSIONS], F.when(short, F.weekday(start)).alias("day_of_week"), F.when(F.col("granularity") == "hour", F.hour(start)).alias("hour_of_day"),
        (short & (F.weekday(start) >= 5)).alias("is_weekend"), (short & holiday).alias("is_holiday"), F.weekofyear(start).alias("week_of_year"), F.month(start).alias("month_of_year"), F.quarter(start).alias("quarter"),
    )


def latest_forecasts(forecasts: DataFrame, since: date) -> DataFrame:
    """Of each series and day from ``since`` on the forecast made last (WIN-7). Needs series, period, made_at, predicted; of equal times the larger prediction."""
    days = forecasts.where(F.to_date("period") >= F.lit(since)).groupBy("series", F.to_date("period").alias("day"))
    return days.agg(F.max(F.struct("made_at", "predicted")).alias("f"), F.count("*").alias("forecasts")).select("series", "day", "f.made_at", "f.predicted", "forecasts")


def horizon(days: Column, horizons: tuple[int, ...] = (1, 7, 30)) -> Column:
    """The class of a number of days ahead: the first of ``horizons`` that is not below it, else ``beyond``."""
    out = F.lit("beyond")
    for h in sorted(horizons, reverse=True):
        out = F.when(days <= h, f"{h}d").otherwise(out)
    return out


def judged(forecasts: DataFrame, actuals: DataFrame, horizons: tuple[int, ...] = (1, 7, 30)) -> DataFrame:
    """What forecasts said of each period before it began, beside what came (TKT-7).

    Of each horizon the forecast made last counts, and under ``latest`` the last of all; one made after the period has
    begun never does. ``forecasts``: model, series, period, made_at, predicted; ``actuals``: series, period, actual.
    Errors are actual less predicted; error_pct is null where nothing came.
    """
    before = forecasts.where(F.col("made_at") <= F.col("period"))
    ahead = horizon(F.datediff("period", "made_at"), horizons)
    last = before.groupBy("model", "series", "period", ahead.alias("horizon")).agg(F.max(F.struct("made_at", "predicted")).alias("f"))
    over_all = last.groupBy("model", "series", "period").agg(F.lit("latest").alias("horizon"), F.max("f").alias("f"))
    both = last.unionByName(over_all).join(actuals.select("series", "period", "actual"), ["series", "period"])
    e = F.col("actual") - F.col("f.predicted")
    return both.select("model", "series", "period", "horizon", "f.made_at", "f.predicted", "actual", e.alias("error"), F.when(F.col("actual") > 0, 100 * e / F.col("actual")).alias("error_pct"))


def accuracy(found: DataFrame) -> DataFrame:
    """Forecasts, MAE, MAPE, RMSE and R2 of each model and horizon (TKT-7)."""
    e, y = F.col("error"), F.col("actual").cast("double")
    return found.groupBy("model", "horizon").agg(
        F.count("*").alias("total_forecasts"), F.avg(F.abs(e)).alias("mae"), F.avg(F.abs("error_pct")).alias("mape"), F.sqrt(F.avg(e * e)).alias("rmse"), (1 - F.avg(e * e) / F.nullif(F.var_pop(y), F.lit(0.0))).alias("r2"),
    )


def product_tickets(lines: DataFrame, tickets: DataFrame, factor: float = 1.5, since: datetime | None = None) -> DataFrame:
    """Sales and tickets of each product, its rate, the mean rate of its type and whether it is far above it (TKT-9).

    A ticket counts for the product that its customer bought last; sales count from ``since`` on. ``lines``: product_id, product_type, customer_id,
    order_id, order_date, line_number, quantity, line_item_sales; ``tickets``: customer_id.
    """
    last = lines.where("customer_id IS NOT NULL").groupBy("customer_id").agg(F.max_by("product_id", F.struct("order_date", "order_id", "line_number", "product_id")).alias("product_id"))
    asked = tickets.groupBy("customer_id").agg(F.count("*").alias("t")).join(last, "customer_id").groupBy("product_id").agg(F.sum("t").alias("tickets"))
    sales = lines if since is None else lines.where(F.col("order_date") >= F.lit(since).cast("timestamp_ntz"))
    sold = sales.groupBy("product_id").agg(F.max("product_type").alias("product_type"), F.sum("quantity").alias("units"), F.sum("line_item_sales").alias("revenue"), F.countDistinct("customer_id").alias("customers"))
    rated = sold.join(asked, "product_id", "left").fillna(0, ["tickets"]).withColumn("rate", F.col("tickets") / F.nullif("units", F.lit(0)))
    mean = rated.groupBy("product_type").agg(F.avg("rate").alias("type_rate")).withColumnRenamed("product_type", "of_type")
    return rated.join(mean, F.col("product_type").eqNullSafe(F.col("of_type"))).drop("of_type").withColumn("high", F.col("rate") > factor * F.col("type_rate"))


def high_ticket_products(rated: DataFrame, limit: int = 50) -> DataFrame:
    """The products far above their type by their rate, highest first (TOP-4)."""
    return rated.where("high").orderBy(F.col("rate").desc(), "product_id").limit(limit)
