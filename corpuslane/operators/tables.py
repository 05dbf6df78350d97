"""Joins and summaries of tables that the engine has no single operator for: the latest earlier row, approximate profiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def asof_join(left: DataFrame, right: DataFrame, by: str, time: str, cols: list[str], bucket: str = "day") -> DataFrame:
    """``left`` with ``cols`` of the latest row of ``right`` of the same key ``by`` at or before its ``time``; null where there is none.

    Among rows of ``right`` with one key and time the largest ``cols`` counts. Null keys and times match
    nothing. Both tables are cut by key and time bucket (a unit of ``date_trunc``), and a window runs
    inside a bucket only; what a bucket inherits is the last row of the buckets before it, found over one
    row per key and bucket. So a key that holds many of the rows is spread over its buckets.
    """
    pack = F.struct(*cols)
    r = right.where(F.col(by).isNotNull() & F.col(time).isNotNull()).groupBy(F.col(by).alias("_k"), F.col(time).alias("_t")).agg(F.max(pack).alias("_v"))
    r = r.withColumn("_b", F.date_trunc(bucket, "_t"))
    rows = left.withColumn("_k", F.col(by)).withColumn("_t", F.col(time)).withColumn("_b", F.date_trunc(bucket, "_t"))
    keep = [F.col(f"`{c}`") for c in left.columns]
    # one row per key and bucket: the last value of each, and before it that of the buckets before
    last = r.groupBy("_k", "_b").agg(F.max_by("_v", "_t").alias("_end"))
    every = last.unionByName(rows.where("_k is not null and _t is not null").select("_k", "_b").distinct().withColumn("_end", F.lit(None).cast(last.schema["_end"].dataType)))
    every = every.groupBy("_k", "_b").agg(F.max("_end").alias("_end"))
    before = Window.partitionBy("_k").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    inherited = every.select("_k", "_b", F.last("_end", ignorenulls=True).over(before).alias("_from"))
    tagged = rows.select("_k", "_b", "_t", F.lit(1).alias("_side"), F.struct(*keep).alias("_row"), F.lit(None).cast(last.schema["_end"].dataType).alias("_v")).where("_k is not null and _t is not null")
    both = tagged.unionByName(r.select("_k", "_b", "_t", F.lit(0).alias("_side"), F.lit(None).cast(tagged.schema["_row"].dataType).alias("_row"), "_v"))
    upto = Window.partitionBy("_k", "_b").orderBy("_t", "_side").rowsBetween(Window.unboundedPreceding, 0)
    found = both.withColumn("_v", F.last("_v", ignorenulls=True).over(upto)).where("_side = 1").join(inherited, ["_k", "_b"], "left")
    found = found.select("_row.*", F.coalesce("_v", "_from").alias("_v"))
    lost = rows.where("_k is null or _t is null").select(*keep, F.lit(None).cast(last.schema["_end"].dataType).alias("_v"))
    out = found.unionByName(lost)
    return out.select(*[F.col(f"`{c}`") for c in left.columns if c not in cols], *[F.col(f"_v.{c}").alias(c) for c in cols])


def profile(df: DataFrame, group: str, value: str, shares: tuple[float, ...] = (0.5, 0.9), error: float = 0.02, distinct: Column | None = None) -> DataFrame:
    """Per group: rows, approximate number of distinct values (or of ``distinct``) and approximate quantiles, by sketches that merge map-side."""
    d = F.col(value) if distinct is None else distinct
    q = F.percentile_approx(value, list(shares), int(1 / error) * 10)
    return df.groupBy(group).agg(F.count("*").alias("n"), F.approx_count_distinct(d, error).alias("distinct_values"), q.alias("quantiles"))
