"""Reading landed data and writing tables: CSV, JDBC, nested JSON, partitions, upserts."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The columns of the line export and their names here.
EXPORT = {"Customer_ID": "customer_id", "Date": "order_date", "Sales": "line_item_sales", "Title": "product_name", "ProductType": "product_type", "Category": "category", "QTY": "quantity", "TotalDiscount": "line_item_discount", "Refunds": "line_item_refunds"}
EXPORT_SCHEMA = "Customer_ID long, Date timestamp_ntz, Sales double, Title string, ProductType string, Category string, QTY long, TotalDiscount double, Refunds double"
MONEY = "struct<shopMoney:struct<amount:string,currencyCode:string>>"
LINE_SCHEMA = f"struct<quantity:int,sku:string,product:struct<legacyResourceId:string,title:string,productType:string>,variant:struct<title:string>,originalTotalSet:{MONEY},discountedTotalSet:{MONEY}>"
ORDER_SCHEMA = f"legacyResourceId string, name string, createdAt string, processedAt string, customer struct<legacyResourceId:string>, totalPriceSet {MONEY}, displayFulfillmentStatus string, displayFinancialStatus string, shippingAddress struct<latitude:double,longitude:double>, lineItems struct<edges:array<struct<node:{LINE_SCHEMA}>>>"
TICKET_SCHEMA = "id string, status string, channel string, is_unread boolean, customer struct<id:string,email:string>, tags array<struct<name:string>>"
MESSAGE_SCHEMA = "id string, body_text string, body_html string, source struct<type:string>"


def work_path(spark: SparkSession, name: str) -> str:
    """A new path in the folder that the cluster shares, deleted when the driver ends; a temporary one on a local master where none is set."""
    top = spark.conf.get("spark.checkpoint.dir", "")
    if not top:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        top = tempfile.mkdtemp(prefix="spark-work-")
        spark.conf.set("spark.checkpoint.dir", top)
    path = os.path.join(top, f"{name}-{uuid.uuid4().hex}")

    def drop() -> None:
        try:
            where = spark._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
        except Exception:  # the session has ended already: the folder is the cluster's to clear
            pass

    atexit.register(drop)
    return path


def read_lines_csv(spark: SparkSession, path: str) -> DataFrame:
    """Order-line export with a fixed schema, renamed (SRC-1)."""
    return spark.read.schema(EXPORT_SCHEMA).option("header", True).csv(path).withColumnsRenamed(EXPORT)


def parsed(column: str, schema: str) -> Column:
    """A JSON column parsed once for each row: the generator keeps the optimizer from parsing again for every field."""
    return F.explode(F.array(F.from_json(column, schema)))


def flatten_orders(raw: DataFrame, column: str = "value") -> DataFrame:
    """Nested order JSON to line rows (SRC-3).

    Orders without a customer go; the discount is original less discounted; an order's number is its name where that is
    one, else its id; missing statuses, currency, product and variant have defaults, a missing address is null; seven
    calendar columns follow the date, which keeps its wall clock.
    """
    o = raw.select(parsed(column, ORDER_SCHEMA).alias("o")).select("o.*").where("customer.legacyResourceId IS NOT NULL")
    edges = F.coalesce("lineItems.edges", F.array().cast(f"array<struct<node:{LINE_SCHEMA}>>"))
    total = F.aggregate(edges, F.lit(0).cast("long"), lambda n, e: n + F.coalesce(e["node"]["quantity"], F.lit(1)))
    lines = o.withColumn("items", total).select("*", F.posexplode("lineItems.edges").alias("line_no", "e")).select("*", "e.node.*")
    amount = lambda c: F.coalesce(F.col(f"{c}.shopMoney.amount").cast("double"), F.lit(0.0))
    at, text = F.col("createdAt").cast("timestamp_ntz"), lambda c, default: F.coalesce(c, F.lit(default))
    return lines.select(
        F.col("legacyResourceId").cast("long").alias("order_id"), F.coalesce(F.regexp_replace("name", "#", "").try_cast("long"), F.col("legacyResourceId").cast("long")).alias("order_number"), F.col("customer.legacyResourceId").cast("long").alias("customer_id"),
        (F.col("line_no") + 1).alias("line_no"), at.alias("order_date"), F.coalesce(F.col("processedAt").cast("timestamp_ntz"), at).alias("created_at"),
        F.year(at).alias("year"), F.quarter(at).alias("quarter"), F.month(at).alias("month"), F.date_format(at, "MMMM").alias("month_name"), F.weekofyear(at).alias("week"), F.dayofmonth(at).alias("day"), F.date_format(at, "EEEE").alias("week_day"),
        text("sku", "").alias("sku"), F.coalesce(F.col("product.legacyResourceId").cast("long"), F.lit(0)).alias("product_id"), text("product.title", "Unknown Product").alias("product_name"), text("variant.title", "").alias("variant_name"), text("product.productType", "Unknown").alias("product_type"),
        text("product.productType", "Unknown").alias("category"), F.coalesce("quantity", F.lit(1)).alias("quantity"), amount("discountedTotalSet").alias("line_item_sales"), (amount("originalTotalSet") - amount("discountedTotalSet")).alias("line_item_discount"), F.lit(0.0).alias("line_item_refunds"),
        text("totalPriceSet.shopMoney.currencyCode", "USD").alias("currency"), F.lit("online_store").alias("sales_channel"), F.col("shippingAddress.latitude").alias("latitude"), F.col("shippingAddress.longitude").alias("longitude"),
        text("displayFulfillmentStatus", "UNFULFILLED").alias("fulfillment_status"), text("displayFinancialStatus", "PENDING").alias("financial_status"), amount("totalPriceSet").alias("order_total"), F.col("items").alias("order_total_items"),
    )


def normalise_tickets(raw: DataFrame, column: str = "value") -> DataFrame:
    """Ticket JSON to rows with defaults and a stable id (SRC-4)."""
    t = raw.select(parsed(column, TICKET_SCHEMA).alias("t")).select("t.*")
    return t.select(
        F.substring(F.sha2(F.concat(F.lit("ticket:"), "id"), 256), 1, 16).alias("ticket_key"), "id", F.coalesce("customer.id", "customer.email", F.lit("unknown")).alias("customer"), F.when(F.col("channel") == "api", "chat").otherwise(F.col("channel")).alias("channel"),
        F.when(F.col("status").isin("open", "closed"), F.col("status")).otherwise("pending").alias("status"), F.when(F.col("is_unread"), "high").otherwise("normal").alias("priority"), F.coalesce(F.transform("tags", lambda x: x["name"]), F.array().cast("array<string>")).alias("tags"),
    )


def normalise_messages(raw: DataFrame, column: str = "value") -> DataFrame:
    """Message JSON: sender by source type, text before html (SRC-5)."""
    m = raw.select(parsed(column, MESSAGE_SCHEMA).alias("m")).select("m.*")
    return m.select("id", F.when(F.col("source.type").isin("helpdesk", "internal"), "agent").otherwise("customer").alias("sender"), F.coalesce(F.nullif("body_text", F.lit("")), "body_html").alias("content"))


def write_months(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Write lines by year and month with a load time (SRC-6); append leaves what is there."""
    dated = df.withColumn("year", F.year("order_date")).withColumn("month", F.month("order_date")).withColumn("loaded_at", F.current_timestamp())
    dated.write.mode(mode).partitionBy("year", "month").parquet(path)


def incremental_slice(source: DataFrame, target: DataFrame, column: str = "order_date", strict: bool = False) -> DataFrame:
    """Rows of the source after the target's last day; ``strict`` takes all that are later than its last time (SRC-7)."""
    mark = target.agg(F.max(column).alias("mark"))
    after = (F.col(column) > F.col("mark")) if strict else (F.to_date(column) >= F.date_add(F.to_date("mark"), 1))
    return source.crossJoin(F.broadcast(mark)).where(F.col("mark").isNull() | after).drop("mark")


def upsert(target: DataFrame, changes: DataFrame, keys: list[str], order: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """Last write of each key wins; columns of ``keep`` stay as the target had them (SRC-8)."""
    both = target.withColumn("_new", F.lit(0)).unionByName(changes.withColumn("_new", F.lit(1)))
    rest = [c for c in target.columns if c not in keys]
    g = both.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct("_new", order)).alias("r"), *[F.min_by(c, F.struct("_new", order)).alias(f"_{c}") for c in keep])
    return g.select(*keys, *[F.col(f"_{c}").alias(c) if c in keep else F.col(f"r.{c}").alias(c) for c in rest])


def update_columns(target: DataFrame, changes: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Insert new keys, and of known keys replace the listed columns only (SRC-9)."""
    rest = [c for c in target.columns if c not in keys]
    new = changes.select(*keys, *[F.col(c).alias(f"_{c}") for c in rest], F.lit(True).alias("_hit"))
    old = target.withColumn("_old", F.lit(True))
    pick = lambda c: F.when(F.col("_hit") & (F.col("_old").isNull() | F.lit(c in columns)), F.col(f"_{c}")).otherwise(F.col(c)).alias(c)
    return old.join(new, keys, "full").select(*keys, *[pick(c) for c in rest])


def replace_store(df: DataFrame, path: str) -> None:
    """Replace the partitions of the stores in ``df`` and leave the others (SRC-10)."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("store_id").parquet(path)


def write_results(profiles: DataFrame, path: str, archetypes: int = 50, sample: int = 10) -> None:
    """The results of a run as JSON (SRC-12): ``tier1`` all segments of all axes, ``tier2`` the largest archetypes, ``tier3`` signatures of a few customers.

    Segments and archetypes are counted in one reading each, with their share of all profiles.
    """
    from patronage.operators.sampling import at_random

    total = profiles.agg(F.count("*").alias("all"))
    share = lambda df: df.crossJoin(F.broadcast(total)).select("key", "name", "n", (100 * F.col("n") / F.col("all")).alias("pct"))
    segments = profiles.select(F.explode("dominant_segments").alias("key", "name")).groupBy("key", "name").agg(F.count("*").alias("n"))
    largest = profiles.groupBy(F.col("archetype_id").alias("key"), F.col("signature").alias("name")).agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "key").limit(archetypes)
    few = at_random(profiles, "customer_id", sample).select(F.col("customer_id").cast("string").alias("key"), F.col("signature").alias("name"), F.lit(1).cast("long").alias("n"), F.lit(None).cast("double").alias("pct"))
    for name, df in (("tier1", share(segments)), ("tier2", share(largest)), ("tier3", few)):
        df.write.mode("overwrite").json(f"{path}/{name}")
