"""Word vectors: composite vectors of texts and the relevance they give to sentences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.operators.grounding import top_k
from strandline.session import broadcast_if_small


def read_vectors(spark, path: str) -> DataFrame:
    """``word, vec`` of a text file of vectors: a word and its numbers per line; a first line of counts is left out."""
    parts = spark.read.text(path).select(F.split("value", " ").alias("p")).where(F.size("p") > 2)
    return parts.select(F.get("p", F.lit(0)).alias("word"), F.slice("p", 2, F.size("p") - 1).cast("array<double>").alias("vec"))


def composite(rows: DataFrame, id_col: str, words: Column, vocabulary: DataFrame, weights: DataFrame | None = None) -> DataFrame:
    """``id, vec``: the unit-length weighted sum of the vectors of a row's known words; null where none is known.

    ``weights(word, weight)`` default to 1. Sums are combined map-side per dimension, so a long text is no hot task.
    """
    each = rows.select(F.col(id_col).alias("id"), F.explode(words).alias("word")).groupBy("id", "word").agg(F.count("*").alias("n"))
    if weights is not None:
        each = each.join(broadcast_if_small(weights), "word", "left").withColumn("n", F.col("n") * F.coalesce("weight", F.lit(1.0)))
    parts = each.join(broadcast_if_small(vocabulary.select("word", "vec")), "word").select("id", F.posexplode(F.transform("vec", lambda x: x * F.col("n"))).alias("i", "x"))
    sums = parts.groupBy("id", "i").agg(F.sum("x").alias("x")).groupBy("id").agg(F.array_sort(F.collect_list(F.struct("i", "x"))).alias("v"))
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, e: s + e["x"] * e["x"]))
    unit = sums.select("id", F.when(norm > 0, F.transform("v", lambda e: e["x"] / norm)).alias("vec"))
    return rows.select(F.col(id_col).alias("id")).distinct().join(unit, "id", "left")


def relevance(rows: DataFrame, nodes: DataFrame, threshold: float = 0.7) -> DataFrame:
    """``id, relevance``: the score of the best concept if it is above the threshold, else 0; ``rows(id, vec)``."""
    best = top_k(rows, nodes, 1).select("id", "score")
    return rows.select("id").join(best, "id", "left").select("id", F.when(F.col("score") > threshold, F.col("score")).otherwise(0.0).alias("relevance"))
