"""Exporters of extractions: each gives a table to be written; :data:`EXPORTERS` names them.

Tables: ``edges`` of the reading pipeline, ``extractions`` as in the corpus, ``groundings(id, node, score, rank)``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.operators.analytics import numbered
from strandline.sources.jsonld import corpus_documents, groundings_only


def annotation_sheet(edges: DataFrame) -> DataFrame:
    """One row per cause and effect of causal edges, with polarity and rule, in a total order."""
    order = ["doc_id", "sent_no", "label", "cause", "effect", "rule", "polarity"]
    return numbered(edges.where("label = 'Causal'").select(*order), order, "row")


def simple_pairs(edges: DataFrame) -> DataFrame:
    """Cause and effect pairs with counts of changes; several effects of a sentence come as rows of their own."""
    order = ["doc_id", "sent_no", "cause", "effect", "label", "rule"]
    return numbered(edges.select(*order, F.when(F.col("cause_up"), "inc").otherwise("dec").alias("cause_polarity"), F.when(F.col("effect_up"), "inc").otherwise("dec").alias("effect_polarity")), order, "idx")


def grounding_sheet(edges: DataFrame, groundings: DataFrame) -> DataFrame:
    """Per causal edge the best node and score of both sides; ``NONE`` and 0 where a side has none. ``groundings.id`` is the text."""
    best = groundings.where("rank = 1").select("id", "node", "score")
    side = lambda name: best.select(F.col("id").alias(name), F.col("node").alias(f"{name}_node"), F.col("score").alias(f"{name}_score"))
    out = edges.where("label = 'Causal'").join(side("cause"), "cause", "left").join(side("effect"), "effect", "left")
    return out.select("doc_id", "sent_no", "cause", F.coalesce("cause_node", F.lit("NONE")).alias("cause_node"), F.coalesce("cause_score", F.lit(0.0)).alias("cause_score"), "effect", F.coalesce("effect_node", F.lit("NONE")).alias("effect_node"), F.coalesce("effect_score", F.lit(0.0)).alias("effect_score"))


def insight(similarities: DataFrame, k: int = 3) -> DataFrame:
    """``id, node, n, best, worst, mean, top``: the example similarities of a node added up. ``similarities(id, node, example, score)``.

    The ``k`` best examples are kept by a rank in each task before they are gathered.
    """
    from pyspark.sql import Window

    stats = similarities.groupBy("id", "node").agg(F.count("*").alias("n"), F.max("score").alias("best"), F.min("score").alias("worst"), F.avg("score").alias("mean"))
    rank = F.row_number().over(Window.partitionBy("id", "node").orderBy(F.desc("score"), "example"))
    top = similarities.withColumn("r", rank).where(F.col("r") <= k).groupBy("id", "node").agg(F.array_sort(F.collect_list(F.struct("r", "example", "score"))).alias("t"))
    return stats.join(top, ["id", "node"]).select("id", "node", "n", "best", "worst", "mean", F.transform("t", lambda e: F.concat_ws(":", e["example"], e["score"].cast("string"))).alias("top"))


def changes_sheet(extractions: DataFrame) -> DataFrame:
    """``extraction_id, pos, state_type, state_text`` of mentions with more than one increase or decrease."""
    e = extractions.select("extraction_id", F.filter("states", lambda x: x["state_type"].isin("INC", "DEC")).alias("f")).where(F.size("f") > 1)
    return e.select("extraction_id", F.posexplode("f").alias("pos", "s")).select("extraction_id", "pos", "s.state_type", "s.state_text")


def display(mentions: DataFrame) -> DataFrame:
    """One readable line per mention, by sentence and label."""
    line = F.format_string("%s [%s] %s (%s)", F.col("sent_key"), F.col("label"), F.col("text"), F.col("found_by"))
    return mentions.select("sent_key", "label", "mention_no", line.alias("line"))


EXPORTERS: dict[str, Callable[..., DataFrame]] = {
    "jsonld": corpus_documents, "grounding": groundings_only, "annotation": annotation_sheet, "simple": simple_pairs, "groundingSheet": grounding_sheet, "groundingInsight": insight, "incdec": changes_sheet, "display": display,
}


def exporter(name: str) -> Callable[..., DataFrame]:
    """The exporter of that name; an unknown name is refused."""
    if name not in EXPORTERS:
        raise NotImplementedError(name)
    return EXPORTERS[name]
