"""Small changes to mentions: labels, provenance, heads, hedges over the dependency graph, events across sentences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def relabelled(labels: Column, label: str) -> Column:
    """The labels with a new one in front; it is not repeated."""
    return F.concat(F.array(F.lit(label)), F.filter(labels, lambda x: x != label))


def found_by_copy(found_by: Column, step: str) -> Column:
    """Provenance with a step added behind."""
    return F.concat_ws("++", found_by, F.lit(step))


def head_info(tokens: Column, start: Column, stop: Column, head: Column, trigger_start: Column, trigger_stop: Column) -> Column:
    """``struct<text, start, stop, words>``: the syntactic head of a mention, else its trigger, else all of it."""
    a = F.coalesce(head, trigger_start, start)
    b = F.when(head.isNotNull(), head + 1).otherwise(F.coalesce(trigger_stop, stop))
    return F.struct(F.array_join(F.transform(F.slice(tokens, a + 1, b - a), lambda t: t["word"]), " ").alias("text"), a.alias("start"), b.alias("stop"), (b - a).alias("words"))


def neighbourhood(edges: Column, start: Column, stop: Column, degree: int = 2) -> Column:
    """Tokens of a span and those at most ``degree`` dependencies away, in either direction, in order."""

    def step(reached: Column, near: str, far: str) -> Column:
        return F.transform(F.filter(edges, lambda e: F.array_contains(reached, e[near])), lambda e: e[far])

    reached = F.sequence(start, F.greatest(stop - 1, start))
    for _ in range(degree):
        reached = F.array_distinct(F.concat(reached, step(reached, "src", "dst"), step(reached, "dst", "src")))
    return F.array_sort(reached)


def hedged(mentions: DataFrame, sentences: DataFrame, hints: list[str], degree: int = 2, label: str = "Event") -> DataFrame:
    """``sent_key, mention_no, hints``: for each mention with ``label`` the hint lemmas in or near its span, in order of place.

    ``mentions(sent_key, mention_no, labels, start, stop)``, ``sentences(sent_key, tokens, edges)``. A sentence without edges
    has the span alone.
    """
    rows = mentions.where(F.array_contains("labels", label)).join(sentences, "sent_key")
    near = neighbourhood(F.coalesce("edges", F.array().cast("array<struct<src:int,dst:int,rel:string>>")), F.col("start"), F.col("stop"), degree)
    found = F.filter(F.transform(near, lambda i: F.get("tokens", i)["lemma"]), lambda x: x.isin(*hints))
    return rows.select("sent_key", "mention_no", found.alias("hints"))


def negated_by_dependency(mentions: DataFrame, sentences: DataFrame, label: str = "Event") -> DataFrame:
    """``sent_key, mention_no, negations``: the ``neg`` dependents of each trigger or of a verb its trigger depends on; an odd number negates."""
    rows = mentions.where(F.array_contains("labels", label)).join(sentences, "sent_key")
    a, b = F.coalesce("trigger_start", "start"), F.coalesce("trigger_stop", "stop")
    inside = lambda i: (i >= a) & (i < b)
    heads = F.transform(F.filter("edges", lambda e: inside(e["dst"]) & e["rel"].rlike("^(xcomp|ccomp|aux|acl)")), lambda e: e["src"])
    neg = F.filter("edges", lambda e: (e["rel"] == "neg") & (inside(e["src"]) | F.array_contains(heads, e["src"])))
    return rows.select("sent_key", "mention_no", F.array_sort(F.array_distinct(F.transform(neg, lambda e: F.get("tokens", e["dst"])["word"]))).alias("negations"))


def across_sentences(parts: DataFrame, sentences: DataFrame) -> DataFrame:
    """``doc_id, event_no, text`` of events over several sentences: from the first part on, whole sentences between, up to the last part.

    ``parts(doc_id, event_no, sent_no, start, stop)`` are the trigger and arguments; ``sentences(doc_id, sent_no, raw array<string>)``.
    Only sentences that hold a part are put together, as many as the event has.
    """
    spans = parts.groupBy("doc_id", "event_no", "sent_no").agg(F.min("start").alias("a"), F.max("stop").alias("b"))
    ends = spans.groupBy("doc_id", "event_no").agg(F.min("sent_no").alias("first"), F.max("sent_no").alias("last"))
    j = spans.join(ends, ["doc_id", "event_no"]).join(sentences, ["doc_id", "sent_no"])
    n = F.size("raw")
    words = F.when(F.col("sent_no") == F.col("first"), F.slice("raw", F.col("a") + 1, F.greatest(n - F.col("a"), F.lit(0)))).when(F.col("sent_no") == F.col("last"), F.slice("raw", F.lit(1), F.least("b", n))).otherwise(F.col("raw"))
    pieces = j.groupBy("doc_id", "event_no").agg(F.array_sort(F.collect_list(F.struct("sent_no", words.alias("w")))).alias("p"))
    return pieces.select("doc_id", "event_no", F.array_join(F.flatten(F.transform("p", lambda x: x["w"])), " ").alias("text"))


def clipped(start: Column, stop: Column, n_tokens: Column, before: Column, after: Column) -> Column:
    """``struct<start, stop>``: the local interval of an event that goes on before or behind its sentence, widened to that edge."""
    return F.struct(F.when(before, 0).otherwise(start).alias("start"), F.when(after, n_tokens).otherwise(stop).alias("stop"))


def expandable_concepts(mentions: DataFrame, edges: DataFrame, kinds: tuple[str, ...] = ("INC", "DEC", "QUANT", "POS", "NEG")) -> DataFrame:
    """Concepts with a change or quantity that are no argument of a causal edge, labelled ``Concept-Expanded`` to be expanded.

    ``mentions(sent_key, mention_no, label, labels, attachments)``, ``edges(sent_key, mention_no)`` the arguments of edges.
    """
    changed = mentions.where((F.col("label") == "Concept") & F.exists("attachments", lambda a: a["type"].isin(*kinds)))
    return changed.join(edges.select("sent_key", "mention_no").distinct(), ["sent_key", "mention_no"], "left_anti").withColumn("labels", relabelled(F.col("labels"), "Concept-Expanded")).withColumn("label", F.lit("Concept-Expanded"))


def observed(df: DataFrame, stage: str) -> tuple[DataFrame, object]:
    """The rows unchanged, with an observation of their number that is filled when they are written: what a stage let through, without a second pass."""
    from pyspark.sql import Observation

    watch = Observation(stage)
    return df.observe(watch, F.count(F.lit(1)).alias("rows")), watch
