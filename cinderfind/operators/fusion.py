"""Weighted reciprocal-rank fusion of any number of ranked lists, for all queries at once."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

K = 60


def rrf(rankings: Sequence[DataFrame], weights: Sequence[float | Column] | None = None, k: int = K) -> DataFrame:
    """Lists (query_id, id, position from 1) -> (query_id, id, score) with score the sum of weight / (k + position).

    An id that comes twice in a list counts at its first position; other positions stay. A weight is a number or a
    column of its list. Union and one aggregation: no join, whatever the number of lists.
    """
    weights = [1.0] * len(rankings) if weights is None else list(weights)
    if isinstance(k, bool) or not isinstance(k, int) or k < 1:
        raise ValueError("k is a positive whole number")
    if len(rankings) - len(weights):
        raise ValueError("each list has one weight")
    if any(not isinstance(w, Column) and w < 0 for w in weights):
        raise ValueError("weights aren't negative")
    if not rankings:
        raise ValueError("there is no list to fuse")
    parts = []
    for i, (ranking, weight) in enumerate(zip(rankings, weights)):
        w = weight if isinstance(weight, Column) else F.lit(float(weight))
        checked = F.when(F.coalesce(F.col("id").cast("string"), F.lit("")) == "", F.raise_error(F.lit("an id is empty"))).otherwise(F.col("id"))
        parts.append(ranking.select("query_id", checked.alias("id"), F.col("position").cast("long").alias("position"), w.alias("weight"), F.lit(i).alias("list")))
    first = reduce(DataFrame.unionByName, parts).groupBy("query_id", "id", "list").agg(F.min("position").alias("position"), F.first("weight").alias("weight"))
    return first.groupBy("query_id", "id").agg(F.sum(F.col("weight") / (F.lit(k) + F.col("position"))).alias("score"))


def top(scored: DataFrame, k: int, by: str = "score", key: str = "id") -> DataFrame:
    """Each query's k best with their rank from 1, ties to the smaller key."""
    order = Window.partitionBy("query_id").orderBy(F.desc(by), key)
    return scored.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
