"""Readers and writers of dimensions (seasons, word weights, foreign vocabularies, caches) and small table utilities.

Dimensions are files of fixed size that are parsed on the driver; everything else is a DataFrame transformation.
"""

from __future__ import annotations

from itertools import product

import yaml
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def read_seasons(spark: SparkSession, text: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``modifiers(word, shift)``, ``triggers(word)`` and ``calendar(place, season, first_month, last_month)`` of a file of three YAML documents."""
    modifiers, triggers, places = yaml.safe_load_all(text)
    rows = [(str(place), season, int(at["start"]), int(at["end"])) for place, seasons in places.items() for season, at in seasons.items()]
    return (
        spark.createDataFrame([(w, int(n)) for w, n in modifiers.items()], "word string, shift int"),
        spark.createDataFrame([(str(w),) for w in triggers["triggers"]], "word string"),
        spark.createDataFrame(rows, "place string, season string, first_month int, last_month int"),
    )


def season_triggers(sentences: DataFrame, modifiers: DataFrame, triggers: DataFrame) -> DataFrame:
    """``doc_id, sent_no, pos, season, shift``: trigger words of ``sentences(doc_id, sent_no, words)``; the word before may shift the season."""
    words = sentences.select("doc_id", "sent_no", F.col("words").alias("w")).select("doc_id", "sent_no", "w", F.posexplode("w").alias("pos", "word"))
    found = words.join(F.broadcast(triggers.select(F.lower("word").alias("season"))), F.lower("word") == F.col("season"))
    before = found.withColumn("__before", F.when(F.col("pos") > 0, F.lower(F.get("w", F.col("pos") - 1))))
    shifted = before.join(F.broadcast(modifiers.select(F.lower("word").alias("__before"), "shift")), "__before", "left")
    return shifted.select("doc_id", "sent_no", "pos", "season", F.coalesce("shift", F.lit(0)).alias("shift"))


def read_weights(spark: SparkSession, path: str) -> DataFrame:
    """``word, weight`` of a tab-separated file; of a repeated word the last in order of weight stays, unreadable weights are left out."""
    p = spark.read.text(path).select(F.split("value", "\t").alias("p"))
    rows = p.select(F.get("p", F.lit(0)).alias("word"), F.get("p", F.lit(1)).try_cast("double").alias("weight")).where("word IS NOT NULL AND weight IS NOT NULL")
    return rows.groupBy("word").agg(F.max("weight").alias("weight"))


def read_foreign_vocabulary(spark: SparkSession, path: str) -> DataFrame:
    """``node, examples`` of lines ``a,b,c <tab> example,example``: the path is joined by slashes, examples are trimmed."""
    p = spark.read.text(path).where("trim(value) <> ''").select(F.split("value", "\t").alias("p"))
    parts = lambda i: F.filter(F.transform(F.split(F.coalesce(F.get("p", F.lit(i)), F.lit("")), ","), lambda x: F.trim(x)), lambda x: x != "")
    return p.select(F.array_join(parts(0), "/").alias("node"), parts(1).alias("examples"))


def save_vocabulary(nodes: DataFrame, path: str, version: str, date: str) -> None:
    """Writes a vocabulary with its version, to be read again without parsing."""
    nodes.withColumn("version", F.lit(version)).withColumn("version_date", F.lit(date)).write.mode("overwrite").parquet(path)


def load_vocabulary(spark: SparkSession, path: str) -> tuple[DataFrame, str | None, str | None]:
    """A saved vocabulary with its version and date; None for both where it has no nodes."""
    saved = spark.read.parquet(path)
    row = saved.select("version", "version_date").first()
    return saved.drop("version", "version_date"), row and row.version, row and row.version_date


def concatenated(spark: SparkSession, paths: list[str], separator: str = "\t") -> DataFrame:
    """The rows of several sheets under the columns of the first; the later header lines are dropped, missing columns are null."""
    frames = [spark.read.csv(p, sep=separator, header=True, quote='"', escape='"') for p in paths]
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f.select(*[c for c in f.columns if c in frames[0].columns]), allowMissingColumns=True)
    return out


def shuffled(df: DataFrame, seed: int, keys: list[str]) -> DataFrame:
    """Rows in an order that looks random but depends on ``seed`` and ``keys`` only; adds ``idx``, without a single sorted partition."""
    from strandline.operators.analytics import numbered

    return numbered(df.withColumn("__r", F.xxhash64(F.lit(seed), *keys)), ["__r", *keys], "idx").drop("__r")


def metadata_keys(df: DataFrame, payload: Column) -> DataFrame:
    """``key, n``: the top-level keys of JSON objects and how many objects have them; other texts have none."""
    return df.select(F.explode(F.json_object_keys(payload)).alias("key")).groupBy("key").agg(F.count("*").alias("n"))


def odometer(spark: SparkSession, *wheels: list) -> DataFrame:
    """``c0, c1, ...``: every combination of given short lists, the last turning fastest; it is meant for parameters, not for data."""
    rows = list(product(*wheels))
    return spark.createDataFrame(rows, [f"c{i}" for i in range(len(wheels))]) if rows else spark.createDataFrame([], ", ".join(f"c{i} string" for i in range(len(wheels))))


def gold_sheet(entities: DataFrame, sentences: DataFrame, groundings: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Gold groundings and rejects: ``entities(row_no, sent_key, entity)`` found in ``sentences(sent_key, text)`` with the best node of each branch.

    ``groundings(id, node, score)`` has the entity as ``id``; an entity that its sentence does not hold, or without nodes, is rejected.
    """
    placed = entities.join(sentences, "sent_key", "left").withColumn("start", F.expr("coalesce(instr(text, entity), 0) - 1"))
    best = Window.partitionBy("id", "branch").orderBy(F.desc("score"), "node")
    top = groundings.withColumn("branch", F.split_part(F.ltrim("node", F.lit("/")), F.lit("/"), F.lit(1))).withColumn("r", F.row_number().over(best)).where("r = 1").select(F.col("id").alias("entity"), "branch", "node", "score")
    found = placed.where("start >= 0").join(top, "entity")
    return found.select("row_no", "sent_key", "entity", "start", "branch", "node", "score"), entities.join(found.select("row_no").distinct(), "row_no", "left_anti")
