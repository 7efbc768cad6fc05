"""Orders rendered as one-page documents, in three layouts: the input of the recognition queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

LABELS = ("Invoice Number", "Invoice Date", "Customer", "Terms", "Total")


def fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ordinal and the five values of each order, as strings."""
    orders, customer = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("orders", "customer"))
    joined = orders.join(customer.select("c_custkey", "c_name"), F.col("o_custkey") == F.col("c_custkey"))
    return joined.select(
        F.col("o_orderkey").alias("ordinal"),
        F.concat(F.lit("INV-"), F.col("o_orderkey").cast("string")).alias("Invoice Number"),
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("Invoice Date"),
        F.col("c_name").alias("Customer"),
        F.col("o_orderpriority").alias("Terms"),
        F.concat(F.lit("$"), F.format_number(F.bround(F.col("o_totalprice").cast("decimal(18,4)"), 2), 2)).alias("Total"),
    )


def spread(rows: DataFrame) -> DataFrame:
    """Rows for work that costs far more than moving them: evenly over the cores, or over as many partitions as the shuffle has
    where that is more."""
    spark = rows.sparkSession
    return rows.repartition(max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))))


def _render(layout: str) -> Column:
    between = {"colon": ": ", "column": "    ", "stacked": "\n"}[layout]
    return F.concat_ws("\n", F.lit("INVOICE 1."), *[F.concat(F.lit(f"{x}{between}"), F.col(f"`{x}`")) for x in LABELS], F.lit("Thank you"), F.lit(""))


def documents(spark: SparkSession, sf_dir: str, layout: str = "mixed") -> DataFrame:
    """ordinal and text. ``mixed``: a third of the orders each in colon, column and stacked layout."""
    values = spread(fields(spark, sf_dir))
    if layout != "mixed":
        return values.select("ordinal", _render(layout).alias("text"))
    third = F.pmod("ordinal", F.lit(3))
    return values.select("ordinal", F.when(third == 0, _render("colon")).when(third == 1, _render("column")).otherwise(_render("stacked")).alias("text"))
