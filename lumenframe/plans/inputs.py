"""Tables as the queries read them, and the same with planted gaps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

LINE = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"]
#: The same planted gaps in SQL.
LI_NULL_SQL = "(select * replace (nullif(l_discount, 0.05) as l_discount, case when l_linenumber = 3 then null else l_quantity end as l_quantity) from lineitem)"
EV_NULL_SQL = "(select * replace (nullif(event_type, 'error') as event_type, case when event_id % 7 = 0 then null else value end as value) from events)"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def li_null(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").withColumns({"l_discount": F.nullif(F.col("l_discount"), F.lit(0.05)), "l_quantity": F.when(F.col("l_linenumber") != 3, F.col("l_quantity"))})


def ev_null(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").withColumns({"event_type": F.nullif(F.col("event_type"), F.lit("error")), "value": F.when(F.col("event_id") % 7 != 0, F.col("value"))})


def rounded(df: DataFrame, digits: int = 4, **names: str) -> DataFrame:
    """Doubles rounded for comparison; columns renamed to ASCII: new=old."""
    old = {v: k for k, v in names.items()}
    def one(c: str, t: str) -> Column:
        x = F.col(f"`{c}`")
        return (F.round(x, digits) + F.lit(0.0) if t in ("double", "float") else x).alias(old.get(c, c))
    return df.select(*[one(c, t) for c, t in df.dtypes])
