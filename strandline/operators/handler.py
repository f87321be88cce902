"""Grounders by vocabulary and their use on mentions, free texts and corpora that were read before."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.operators import compositional
from strandline.operators import grounding as G

#: Vocabularies that are compared slot by slot, and those that are flat lists of indicators, by name.
COMPOSITIONAL, INDICATORS = {"wm_compositional"}, {"wdi", "fao", "mitre12", "who", "interventions"}


def grounder(name: str, nodes: DataFrame, k: int = 5) -> Callable[..., DataFrame]:
    """The grounder of a vocabulary: ``f(rows, id_col, text_col[, vector]) -> id, node, score, ...``. Any other name is grounded by the sieve."""
    base = name.partition("/")[0].lower()
    if base in COMPOSITIONAL:
        return lambda rows, id_col, text, vector=None: compositional.ground(rows, nodes, id_col, text)
    if base in INDICATORS:
        return lambda rows, id_col, text, vector=None: G.by_examples(rows, nodes, k, id_col, text) if vector is None else G.top_k(rows, nodes, k, id_col, vector)
    return lambda rows, id_col, text, vector=None: G.sieve(rows, nodes, k, id_col, text, vector=vector)


def versioned(found: DataFrame, name: str, version: str | None, date: str | None) -> DataFrame:
    """Groundings with the name, version and date of their vocabulary."""
    return found.withColumn("vocabulary", F.lit(name)).withColumn("version", F.lit(version)).withColumn("version_date", F.lit(date))


def ground_all(rows: DataFrame, vocabularies: dict[str, DataFrame], id_col: str, text: str, k: int = 5) -> DataFrame:
    """``vocabulary, id, node, score``: the rows against each of several vocabularies."""
    parts = [grounder(name, nodes, k)(rows, id_col, text).select(F.lit(name).alias("vocabulary"), "id", "node", "score") for name, nodes in sorted(vocabularies.items())]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def covered_tokens(tokens: Column, start: Column, stop: Column, length: Column) -> Column:
    """``struct<start, stop>`` of the whole tokens that a character interval touches; null for an interval that is none of the text.

    ``tokens`` has ``start`` and ``stop`` offsets; the interval must begin and end at a token, not between two.
    """
    begins = F.filter(F.transform(tokens, lambda t, i: F.when((t["start"] <= start) & (start < t["stop"]), i)), lambda i: i.isNotNull())
    ends = F.filter(F.transform(tokens, lambda t, i: F.when((t["start"] <= stop) & (stop <= t["stop"]), i)), lambda i: i.isNotNull())
    valid = (start <= stop) & (start >= 0) & (start < length) & (stop <= length) & (F.size(begins) > 0) & (F.size(ends) > 0)
    return F.when(valid, F.struct(F.get(begins, F.lit(0)).alias("start"), (F.get(ends, F.lit(0)) + 1).alias("stop")))


def reground_intervals(rows: DataFrame, nodes: DataFrame, name: str, k: int = 10) -> DataFrame:
    """``row_id, node, score``: groundings of character intervals of ``rows(row_id, text, tokens, start, stop)``; invalid ones have none."""
    span = covered_tokens(F.col("tokens"), F.col("start"), F.col("stop"), F.length("text"))
    named = rows.withColumn("__s", span).where("__s IS NOT NULL").select("row_id", F.array_join(F.transform(F.slice("tokens", F.col("__s.start") + 1, F.col("__s.stop") - F.col("__s.start")), lambda t: t["word"]), " ").alias("name"))
    return grounder(name, nodes, k)(named, "row_id", "name").select(F.col("id").alias("row_id"), "node", "score")


def reground_corpus(mentions: DataFrame, nodes: DataFrame, name: str, k: int = 5) -> DataFrame:
    """``canonical_name, groundings``: new groundings of the names in a corpus that was read before, each name once, best first."""
    names = mentions.where("canonical_name IS NOT NULL").select("canonical_name").distinct()
    found = grounder(name, nodes, k)(names, "canonical_name", "canonical_name")
    best = F.transform(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("order"), "node", "score"))), lambda g: F.struct(g["node"].alias("node"), g["score"].alias("score")))
    return found.groupBy(F.col("id").alias("canonical_name")).agg(best.alias("groundings"))


def weighted_tokens(tokens: Column, ratio: float) -> Column:
    """``array<struct<word, weight>>`` for a composite vector in which nouns count ``ratio`` times as much as other words."""
    return F.transform(tokens, lambda t: F.struct(F.lower(t["word"]).alias("word"), F.when(t["tag"].startswith("NN"), F.lit(ratio)).otherwise(F.lit(1.0)).alias("weight")))


def weighted_composite(rows: DataFrame, vocabulary: DataFrame, ratio: float, id_col: str = "id") -> DataFrame:
    """``id, vec``: unit sums of word vectors weighted by :func:`weighted_tokens`; null where no word is known. ``rows(id, tokens)``, ``vocabulary(word, vec)``."""
    from strandline.session import broadcast_if_small

    each = rows.select(F.col(id_col).alias("id"), F.explode(weighted_tokens(F.col("tokens"), ratio)).alias("t")).select("id", "t.word", "t.weight")
    parts = each.join(broadcast_if_small(vocabulary), "word").select("id", "weight", F.posexplode("vec").alias("i", "x"))
    sums = parts.groupBy("id", "i").agg(F.sum(F.col("x") * F.col("weight")).alias("x")).groupBy("id").agg(F.array_sort(F.collect_list(F.struct("i", "x"))).alias("v"))
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, e: s + e["x"] * e["x"]))
    unit = sums.select("id", F.when(norm > 0, F.transform("v", lambda e: e["x"] / norm)).alias("vec"))
    return rows.select(F.col(id_col).alias("id")).distinct().join(unit, "id", "left")
