"""Attachments of mentions: merging, and the filters that leave the most specific ones.

An attachment is ``struct<type, trigger, quantifiers array<string>>``; two are equal if their type, trigger and
sorted quantifiers are. Null lists count as empty.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def canonical(attachment: Column) -> Column:
    """The attachment with its quantifiers sorted: equal attachments become equal structs."""
    return F.struct(attachment["type"].alias("type"), attachment["trigger"].alias("trigger"), F.array_sort(F.coalesce(attachment["quantifiers"], F.array().cast("array<string>"))).alias("quantifiers"))


def merged(df: DataFrame, keys: list[str], attachments: str) -> DataFrame:
    """One row per mention with the union of its attachments, sorted.

    The union is map-side: single attachments are made distinct before they are gathered, so a mention repeated in a third
    of all rows is no hot task.
    """
    single = df.select(*keys, F.explode_outer(attachments).alias("__a")).select(*keys, F.when(F.col("__a").isNotNull(), canonical(F.col("__a"))).alias("__a")).distinct()
    return single.groupBy(*keys).agg(F.array_sort(F.collect_list("__a")).alias(attachments))


def without_substrings(attachments: Column) -> Column:
    """Drops an attachment whose trigger is part of a longer (or equal, already kept) trigger of the same type.

    A fold from the longest trigger on, ties by more quantifiers, then by trigger and quantifiers.
    """
    order = F.transform(attachments, lambda a: F.struct((-F.length(a["trigger"])).alias("n"), (-F.size(a["quantifiers"])).alias("q"), a["type"].alias("type"), a["trigger"].alias("trigger"), a["quantifiers"].alias("quantifiers")))
    plain = F.transform(F.array_sort(order), lambda a: F.struct(a["type"].alias("type"), a["trigger"].alias("trigger"), a["quantifiers"].alias("quantifiers")))
    return F.aggregate(
        plain,
        F.filter(plain, lambda _: F.lit(False)),
        lambda kept, a: F.when(F.exists(kept, lambda k: (k["type"] == a["type"]) & k["trigger"].contains(a["trigger"])), kept).otherwise(F.concat(kept, F.array(a))),
    )


def most_quantified(attachments: Column) -> Column:
    """Of attachments with one type and trigger those with the most quantifiers (the first of equals)."""
    better = lambda a, b: (b["type"] == a["type"]) & (b["trigger"] == a["trigger"]) & ((F.size(b["quantifiers"]) > F.size(a["quantifiers"])) | ((F.size(b["quantifiers"]) == F.size(a["quantifiers"])) & (b["quantifiers"] < a["quantifiers"])))
    return F.filter(attachments, lambda a: ~F.exists(attachments, lambda b: better(a, b)))


def counts(attachments: Column, kind: str) -> Column:
    """Number of attachments of a type, e.g. ``INC``."""
    return F.size(F.filter(attachments, lambda a: a["type"] == kind))


def _named(attachments: Column, kind: str, name: str, lower: bool) -> Column:
    trigger = (lambda a: F.lower(a["trigger"])) if lower else (lambda a: a["trigger"])
    return F.transform(F.filter(attachments, lambda a: a["type"] == kind), lambda a: F.concat(F.lit(f"{name}("), trigger(a), F.lit(")")))


def modifier_string(attachments: Column) -> Column:
    """``Quant(t), Hedged(t), Negated(t)`` with lower-case triggers, in this order of types."""
    return F.array_join(F.concat(*[_named(attachments, k, n, True) for k, n in (("QUANT", "Quant"), ("HEDGE", "Hedged"), ("NEGATION", "Negated"))]), ", ")


def polarity_string(attachments: Column) -> Column:
    """``Increase(t), Decrease(t)``, increases first."""
    return F.array_join(F.concat(*[_named(attachments, k, n, False) for k, n in (("INC", "Increase"), ("DEC", "Decrease"))]), ", ")


#: Attachments that a trigger word makes, by the name they have in files.
TRIGGERED = ["INC", "DEC", "POS", "NEG", "QUANT", "PROP", "HEDGE", "NEGATION"]
NAMED = "struct<type:string,trigger:string,quantifiers:array<string>,text:string,start:string,end:string,value:double>"


def words_of(attachment: Column) -> Column:
    """The words of an attachment: its trigger and quantifiers, or its text cut at blanks, or none."""
    text = F.coalesce(F.split(attachment["text"], " "), F.array().cast("array<string>"))
    return F.when(attachment["trigger"].isNotNull(), F.concat(F.array(attachment["trigger"]), F.coalesce(attachment["quantifiers"], F.array().cast("array<string>")))).otherwise(text)


def from_json(json: Column) -> Column:
    """An attachment from JSON ``{type, trigger?, quantifications?, text?, start?, end?, value?}``.

    With a trigger it is one of :data:`TRIGGERED`; without, a place, a score or a time, which without a ``start`` is the
    document's own time (``DCT``). Unknown kinds and unreadable texts give null.
    """
    raw = F.from_json(json, "type string, trigger string, quantifications array<string>, text string, start string, end string, value double")
    plain = F.when(raw["type"].isin("LocationExp", "SCORE"), raw["type"]).when(raw["type"] == "TIMEX", F.when(raw["start"].isNull(), "DCT").otherwise("TIMEX"))
    kind = F.when(raw["trigger"].isNotNull(), F.when(raw["type"].isin(*TRIGGERED), raw["type"])).otherwise(plain)
    quantifiers = F.when(F.size(raw["quantifications"]) > 0, raw["quantifications"])
    return F.when(kind.isNotNull(), F.struct(kind.alias("type"), raw["trigger"].alias("trigger"), quantifiers.alias("quantifiers"), raw["text"].alias("text"), raw["start"].alias("start"), raw["end"].alias("end"), raw["value"].alias("value")))


def in_order(attachments: Column) -> Column:
    """Attachments in the order of display: by kind, then trigger, then quantifiers; repeated ones once."""
    return F.array_sort(F.array_distinct(F.transform(attachments, canonical)))


def with_document_time(mentions: DataFrame, documents: DataFrame, kind: str = "DCT") -> DataFrame:
    """Mentions with the creation time of their document attached where they have no time of their own.

    ``mentions(doc_id, attachments)``, ``documents(doc_id, dct)``; documents are reduced to one row each, a null time adds nothing.
    """
    dct = documents.where("dct IS NOT NULL").groupBy("doc_id").agg(F.min("dct").cast("string").alias("__dct"))
    timed = F.exists("attachments", lambda a: a["type"] == "TIMEX")
    own = F.struct(F.lit(kind).alias("type"), F.col("__dct").alias("trigger"), F.array().cast("array<string>").alias("quantifiers"))
    added = F.when(F.col("__dct").isNotNull() & ~F.coalesce(timed, F.lit(False)), F.concat(F.coalesce("attachments", F.array().cast("array<struct<type:string,trigger:string,quantifiers:array<string>>>")), F.array(own))).otherwise(F.col("attachments"))
    return mentions.join(dct, "doc_id", "left").withColumn("attachments", added).drop("__dct")


def with_context(events: DataFrame, kind: str, role: str) -> DataFrame:
    """``entity_no, attachments``: every entity of an event with every time or place of it, each once.

    ``events(event_no, entities array<int>, <role> array<string>)``; the lists of an event are bounded by its sentence.
    """
    pairs = events.select(F.explode("entities").alias("entity_no"), role).select("entity_no", F.explode(role).alias("text")).distinct()
    one = F.struct(F.lit(kind).alias("type"), F.col("text").alias("trigger"), F.array().cast("array<string>").alias("quantifiers"))
    return pairs.groupBy("entity_no").agg(F.array_sort(F.collect_list(one)).alias("attachments"))


def quantified(mentions: DataFrame, adjectives: DataFrame, mean: float, stdev: float) -> DataFrame:
    """``mention_id, quantifier, delta, mu, sigma``: the change that the quantifying words of each mention stand for.

    The triggers of quantifications and the quantifiers of increases and decreases are looked up in
    ``adjectives(adjective, mu, sigma, intercept)`` and applied to the mean and deviation of the domain; unknown words have nulls.
    """
    from strandline.functions.scores import adjective_delta
    from strandline.session import broadcast_if_small

    none = F.array().cast("array<string>")
    words = lambda a: F.when(a["type"] == "QUANT", F.array(a["trigger"])).when(a["type"].isin("INC", "DEC"), F.coalesce(a["quantifiers"], none)).otherwise(none)
    each = mentions.select("mention_id", F.explode(F.flatten(F.transform("attachments", words))).alias("quantifier"))
    known = adjectives.groupBy(F.lower("adjective").alias("__a")).agg(F.min(F.struct("mu", "sigma", "intercept")).alias("k"))
    out = each.join(broadcast_if_small(known), F.lower("quantifier") == F.col("__a"), "left")
    return out.select("mention_id", "quantifier", adjective_delta(F.col("k.intercept"), F.col("k.mu"), F.col("k.sigma"), F.lit(mean), F.lit(stdev)).alias("delta"), "k.mu", "k.sigma")


def document_attachments(documents: DataFrame) -> DataFrame:
    """``doc_id, attachments map<string, string>``: creation time, title, place and relevance (5 decimals) of each document; missing ones are left out."""
    entries = F.array(*[F.struct(F.lit(k).alias("k"), v.cast("string").alias("v")) for k, v in (("dct", F.col("dct")), ("title", F.col("title")), ("location", F.col("location")), ("relevance", F.format_number("relevance", 5)))])
    return documents.select("doc_id", F.map_from_entries(F.filter(entries, lambda e: e["v"].isNotNull())).alias("attachments"))
