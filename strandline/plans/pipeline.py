"""The reading pipeline: documents -> sentences -> mentions -> causal edges, each step a DataFrame transformation."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.functions import annotate
from strandline.functions.scores import is_increase, relation_polarity
from strandline.operators.rules import find_mentions, load_rules

TAXONOMY = [{"Entity": ["Concept"]}, {"Event": [{"Directed": ["Causal"]}, {"Undirected": ["Correlation"]}]}, {"Attachment": ["Increase", "Decrease"]}]

#: A small grammar over tokens; a full grammar over dependencies is loaded the same way.
GRAMMAR = r"""
vars:
  cause: [cause, trigger, provoke, lead, aggravate, worsen, intensify, double, increase, disrupt]
  inhibit: [reduce, ease, limit, delay]
rules:
  - {name: noun-phrase, label: Concept, priority: 1, type: token, pattern: "[tag=/^JJ/]* [tag=/^NNS?$/]+"}
  - {name: up, label: Increase, priority: 2, type: token, pattern: "(?<trigger> [lemma=/^(rising|increas|higher|heavy|grow)/]) (?= []* @Concept | [tag=/^N/])"}
  - {name: down, label: Decrease, priority: 2, type: token, pattern: "(?<trigger> [lemma=/^(falling|decreas|limited|weak|poor)/]) (?= []* @Concept | [tag=/^N/])"}
  - {name: verb-causal, label: Causal, priority: 3, type: token, pattern: "@cause:Concept [tag=RB]? (?<trigger> [lemma=/^(${ cause })$/ & tag=/^V/]) [tag=DT]? @effect:Concept"}
  - {name: verb-inhibits, label: Causal, priority: 3, type: token, pattern: "@cause:Concept [tag=RB]? (?<trigger> [lemma=/^(${ inhibit })$/ & tag=/^V/]) [tag=DT]? @effect:Concept"}
  - {name: due-to, label: Causal, priority: 3, type: token, pattern: "@effect:Concept [tag=/^(IN|NNP|V.*|CD|NN|,|RB)$/]{,8}? (?<trigger> because of | due to | owing to) [tag=DT]? @cause:Concept"}
  - {name: followed-by, label: Correlation, priority: 3, type: token, pattern: "@cause:Concept was (?<trigger> followed by) [tag=DT]? @effect:Concept"}
"""


@dataclass
class Config:
    """Settings of a run; a component that is None is left out."""

    annotate: Callable[[DataFrame], DataFrame] = annotate.sentences
    rules: list[dict] = field(default_factory=lambda: load_rules(GRAMMAR))
    taxonomy: list = field(default_factory=lambda: TAXONOMY)
    edge_labels: tuple[str, ...] = ("Causal", "Correlation")


def mentions(docs: DataFrame, config: Config | None = None) -> DataFrame:
    """All mentions of ``docs(doc_id, text)``; narrow from the scan on."""
    config = config or Config()
    return find_mentions(config.annotate(docs), config.rules, config.taxonomy).withColumn("doc_id", F.split_part("sent_key", F.lit(":"), F.lit(1)).cast("long")).withColumn("sent_no", F.split_part("sent_key", F.lit(":"), F.lit(2)).cast("int"))


def edges(found: DataFrame, labels: tuple[str, ...] = ("Causal", "Correlation")) -> DataFrame:
    """``doc_id, sent_no, label, cause, effect, cause_up, effect_up, polarity, rule``: one row per cause and effect.

    Mentions of a sentence are gathered first (their number is bounded by its length), so arguments and the changes inside
    them are looked up in arrays: one shuffle by sentence instead of three joins.
    """
    item = F.struct("mention_no", "label", "start", "stop", "text", "args", "found_by")
    per = found.groupBy("doc_id", "sent_no").agg(F.collect_list(item).alias("ms"))
    event = per.select("doc_id", "sent_no", "ms", F.explode(F.filter("ms", lambda m: m["label"].isin(*labels))).alias("e"))
    pick = lambda role: F.transform(F.filter("e.args", lambda a: a["role"] == role), lambda a: F.get(F.filter("ms", lambda m: m["mention_no"] == a["mention_no"]), F.lit(0)))
    pair = event.select("doc_id", "sent_no", "ms", "e", F.explode(pick("cause")).alias("c"), pick("effect").alias("es")).select("doc_id", "sent_no", "ms", "e", "c", F.explode("es").alias("f"))
    n = lambda side, kind: F.size(F.filter("ms", lambda m: (m["label"] == kind) & (m["start"] >= F.col(f"{side}.start")) & (m["stop"] <= F.col(f"{side}.stop"))))
    up = lambda side: is_increase(n(side, "Increase"), n(side, "Decrease"))
    out = pair.select("doc_id", "sent_no", F.col("e.label").alias("label"), F.lower("c.text").alias("cause"), F.lower("f.text").alias("effect"), up("c").alias("cause_up"), up("f").alias("effect_up"), F.col("e.found_by").alias("rule"))
    return out.withColumn("polarity", relation_polarity(F.col("cause_up"), F.col("effect_up")))


def causal_graph(found_edges: DataFrame) -> DataFrame:
    """``cause, effect, label, n, n_docs, promote``: the edges of all documents added up."""
    per_doc = found_edges.groupBy("cause", "effect", "label", "doc_id").agg(F.count("*").alias("c"), F.count_if(F.col("polarity") == "PROMOTE").alias("p"))
    return per_doc.groupBy("cause", "effect", "label").agg(F.sum("c").alias("n"), F.count("*").alias("n_docs"), F.sum("p").alias("promote"))
