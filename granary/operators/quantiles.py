"""Exact quantiles of many groups at once, in memory that no group's size decides."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from granary.sources.files import written

#: Buckets that a group's open range is cut into each round, and values in a range that are few enough to sort.
BUCKETS, FEW = 1024, 8192
_MAX = 1.7976931348623157e308


def exact_quantiles(rows: DataFrame, keys: list[str], value: str, wanted: dict[str, float], *, few: int = FEW) -> DataFrame:
    """keys and a column for each wanted quantile, at (n - 1) * q among a group's sorted values, between two of them in proportion.

    Each wanted rank has a range that holds it. A round counts the range's values by bucket, with each bucket's least and
    greatest value, and the bucket that the rank falls into is the next range; once a range holds `few` values or one alone,
    its values are sorted. All groups and ranks go through a round together, with partial counts in each task. Nulls and
    NaN do not count; infinite values count as the greatest finite ones. A group without values has no row.
    """
    number = F.when(F.col(value).isNotNull(), F.greatest(F.lit(-_MAX), F.least(F.lit(_MAX), F.col(value).cast("double"))))
    base = written(rows.filter(~F.isnan(F.col(value).cast("double"))).select(*keys, number.alias("v")).filter("v is not null"), "values")
    place = lambda q: (F.col("n") - 1) * F.lit(float(q))
    sizes = base.groupBy(*keys).agg(F.count("*").alias("n"), F.min("v").alias("low"), F.max("v").alias("high"))
    ranks = F.array_distinct(F.flatten(F.array(*[F.array(F.floor(place(q)), F.ceil(place(q))) for q in wanted.values()])))
    state = written(sizes.select(*keys, F.explode(ranks).alias("rank"), "low", "high", F.lit(0).cast("long").alias("below"), F.col("n").alias("inside")), "ranks")
    while not (open_ := state.filter((F.col("inside") > few) & (F.col("low") < F.col("high")))).isEmpty():
        width = F.col("high") / BUCKETS - F.col("low") / BUCKETS
        at = F.when(width > 0, F.least(F.lit(BUCKETS - 1), F.floor((F.col("v") / BUCKETS - F.col("low") / BUCKETS) / width * BUCKETS))).otherwise(F.when(F.col("v") > F.col("low"), 1).otherwise(0))
        found = base.join(open_, keys).filter("v between low and high").groupBy(*keys, "rank", "below", at.alias("bucket"))
        found = found.agg(F.count("*").alias("inside"), F.min("v").alias("low"), F.max("v").alias("high"))
        before = F.sum("inside").over(Window.partitionBy(*keys, "rank").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1))  # over BUCKETS rows at most
        found = found.withColumn("below", F.col("below") + F.coalesce(before, F.lit(0)))
        found = found.filter((F.col("below") <= F.col("rank")) & (F.col("rank") < F.col("below") + F.col("inside")))
        done = state.filter((F.col("inside") <= few) | (F.col("low") >= F.col("high")))
        state = written(done.unionByName(found.select(*done.columns)), "ranks")
    settled = state.filter("low >= high").select(*keys, "rank", F.col("low").alias("at"))
    few_left = base.join(state.filter("low < high"), keys).filter("v between low and high")
    sorted_ = few_left.groupBy(*keys, "rank", "below").agg(F.array_sort(F.collect_list("v")).alias("all"))
    picked = settled.unionByName(sorted_.select(*keys, "rank", F.get("all", (F.col("rank") - F.col("below")).cast("int")).alias("at")))
    table = picked.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("rank", "at"))).alias("at"))
    out = sizes.select(*keys, "n").join(table, keys)
    between = lambda q: F.col("at")[F.floor(place(q))] * (1 - (place(q) - F.floor(place(q)))) + F.col("at")[F.ceil(place(q))] * (place(q) - F.floor(place(q)))
    return out.select(*keys, *[between(q).alias(name) for name, q in wanted.items()])
