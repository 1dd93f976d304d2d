"""The library's input tables, mapped from the driver's star schema."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Which order priority stands for which sales channel.
CHANNELS = {"1-URGENT": "pos", "2-HIGH": "web", "3-MEDIUM": "shopify_draft_order"}


def exists(spark: SparkSession, path: str) -> bool:
    """Whether there is something at a path, in whatever file system it is."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)


@dataclass(frozen=True)
class Tables:
    """Lazily read tables of one scale-factor folder."""

    spark: SparkSession
    sf_dir: str

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    @cached_property
    def headers(self) -> DataFrame:
        """Order headers: order_id, customer_id, order_date, order_total, sales_channel, fulfillment_status."""
        channel = F.coalesce(F.create_map(*[F.lit(x) for kv in CHANNELS.items() for x in kv])[F.col("o_orderpriority")], F.col("o_orderpriority"))
        return self.read("orders").select(
            F.col("o_orderkey").alias("order_id"), F.col("o_custkey").alias("customer_id"), F.col("o_orderdate").alias("order_date"),
            F.col("o_totalprice").alias("order_total"), channel.alias("sales_channel"), F.col("o_orderstatus").alias("fulfillment_status"),
        )

    @cached_property
    def raw_lines(self) -> DataFrame:
        """Order lines without their headers."""
        net = F.col("l_extendedprice") * (1 - F.col("l_discount"))
        return self.read("lineitem").select(
            F.col("l_orderkey").alias("order_id"), F.col("l_linenumber").alias("line_number"), F.col("l_partkey").alias("product_id"), F.col("l_suppkey").alias("supplier_id"),
            F.col("l_quantity").cast("long").alias("quantity"), net.alias("line_item_sales"), (F.col("l_extendedprice") * F.col("l_discount")).alias("line_item_discount"),
            F.when(F.col("l_returnflag") == "R", net).otherwise(0.0).alias("line_item_refunds"), F.col("l_shipdate").alias("ship_date"), F.col("l_extendedprice").alias("list_price"),
        )

    @cached_property
    def products(self) -> DataFrame:
        return self.read("part").select(F.col("p_partkey").alias("product_id"), F.col("p_name").alias("product_name"), F.col("p_type").alias("category"), F.col("p_brand").alias("product_type"))

    @cached_property
    def headed_lines(self) -> DataFrame:
        """Order lines with their headers: all that orders are made of."""
        return self.raw_lines.join(self.headers, "order_id", "left")

    @cached_property
    def sales_lines(self) -> DataFrame:
        """The denormalised line fact."""
        return self.headed_lines.join(self.products, "product_id", "left")

    @cached_property
    def stores(self) -> DataFrame:
        """customer_id and its store."""
        return self.read("customer").select(F.col("c_custkey").alias("customer_id"), F.col("c_mktsegment").alias("store_id"), F.col("c_name").alias("customer_name"), F.col("c_acctbal").alias("balance"), F.col("c_nationkey").alias("nation_id"))

    @cached_property
    def events(self) -> DataFrame:
        return self.read("events").select("event_id", F.col("user_id").alias("entity"), "ts", "event_type", "value", "props")

    @cached_property
    def messages(self) -> DataFrame:
        """Ticket messages from conversations."""
        return self.read("conversations").select(F.col("conv_id").alias("ticket_id"), F.col("turn").alias("message_no"), (F.col("role") != "user").alias("from_agent"), F.col("text").alias("content"))
