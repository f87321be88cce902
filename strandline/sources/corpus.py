"""Annotated corpora as JSON-LD: documents with their sentences, words, dependencies and extractions, and back.

Tables: ``documents(document_id, title, location, dct_text, dct_start, dct_end)``,
``sentences(document_id, sent_no, text, relevance, tokens array<struct<word, tag, entity, start, stop, lemma, chunk, norm>>,
edges array<struct<src, dst, rel>>)`` and ``mentions(document_id, sent_no, mention_no, label, labels, start, stop,
trigger_start, trigger_stop, text, args array<struct<role, mention_no>>, found_by, canonical_name, relevance,
attachments array<struct<type, trigger, quantifiers>>)``. Word positions in the objects are 1-based and inclusive, character
offsets 0-based. A document comes in one object per :data:`PART` sentences, so no task gathers a document of any size;
arguments stay within a sentence. Null fields and empty lists are left out and come back as nulls and empty lists.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Sentences of a document in one object.
PART = 500
TOKENS = "array<struct<word:string,tag:string,entity:string,start:int,stop:int,lemma:string,chunk:string,norm:string>>"
EDGES = "array<struct<src:int,dst:int,rel:string>>"
ATTACHMENTS = "array<struct<type:string,trigger:string,quantifiers:array<string>>>"
_SPAN = "array<struct<start:int,end:int>>"
_PROVENANCE = f"array<struct<sentence:struct<`@id`:string>,sentenceWordPositions:{_SPAN}>>"
SCHEMA = (
    "`documents` array<struct<id:string,title:string,location:string,dct:struct<text:string,start:string,end:string>,sentences:array<struct<`@id`:string,text:string,relevance:double,"
    "words:array<struct<text:string,tag:string,entity:string,startOffset:int,endOffset:int,lemma:string,chunk:string,norm:string>>,dependencies:array<struct<source:struct<`@id`:string>,destination:struct<`@id`:string>,relation:string>>>>>>, "
    f"`extractions` array<struct<`@id`:string,type:string,subtype:string,labels:array<string>,text:string,rule:string,canonicalName:string,relevance:double,provenance:{_PROVENANCE},"
    f"trigger:struct<text:string,provenance:{_PROVENANCE}>,arguments:array<struct<type:string,value:struct<`@id`:string>>>,states:array<struct<type:string,text:string,modifiers:array<struct<text:string>>>>>>"
)


def _some(items: Column) -> Column:
    return F.when(F.size(items) > 0, items)


def _id(kind: str, *parts: Column) -> Column:
    return F.concat(F.lit(f"_:{kind}_"), F.concat_ws("_", *[p.cast("string") for p in parts]))


def _provenance(start: Column, stop: Column) -> Column:
    words = F.array(F.struct(F.lit("Interval").alias("@type"), (start + 1).alias("start"), stop.alias("end")))
    return F.array(F.struct(F.lit("Provenance").alias("@type"), F.struct(_id("Document", F.col("document_id")).alias("@id")).alias("document"), F.struct(_id("Sentence", F.col("document_id"), F.col("sent_no")).alias("@id")).alias("sentence"), words.alias("sentenceWordPositions")))


def write_corpus(documents: DataFrame, sentences: DataFrame, mentions: DataFrame, context: str = "https://example.org/corpus") -> DataFrame:
    """``document_id, part, json``: the objects of all documents that have sentences. Rows with a null id are left out."""
    doc, sent = F.col("document_id"), F.col("sent_no")
    words = F.transform(
        F.coalesce("tokens", F.array().cast(TOKENS)),
        lambda t, i: F.struct(
            F.lit("Word").alias("@type"), _id("Word", doc, sent, i).alias("@id"), t["word"].alias("text"), t["tag"].alias("tag"), t["entity"].alias("entity"), t["start"].alias("startOffset"), t["stop"].alias("endOffset"), t["lemma"].alias("lemma"), t["chunk"].alias("chunk"), t["norm"].alias("norm")
        ),
    )
    links = F.transform(F.coalesce("edges", F.array().cast(EDGES)), lambda e: F.struct(F.lit("Dependency").alias("@type"), F.struct(_id("Word", doc, sent, e["src"]).alias("@id")).alias("source"), F.struct(_id("Word", doc, sent, e["dst"]).alias("@id")).alias("destination"), e["rel"].alias("relation")))
    s = sentences.where(doc.isNotNull() & sent.isNotNull()).select("document_id", "sent_no", F.struct(F.lit("Sentence").alias("@type"), _id("Sentence", doc, sent).alias("@id"), "text", "relevance", _some(words).alias("words"), _some(links).alias("dependencies")).alias("s"))
    arguments = F.transform(F.coalesce("args", F.array().cast("array<struct<role:string,mention_no:int>>")), lambda a: F.struct(F.lit("Argument").alias("@type"), a["role"].alias("type"), F.struct(_id("Extraction", doc, sent, a["mention_no"]).alias("@id")).alias("value")))
    states = F.transform(F.coalesce("attachments", F.array().cast(ATTACHMENTS)), lambda a: F.struct(F.lit("State").alias("@type"), a["type"].alias("type"), a["trigger"].alias("text"), _some(F.transform(a["quantifiers"], lambda q: F.struct(F.lit("Modifier").alias("@type"), q.alias("text")))).alias("modifiers")))
    event = F.size("args") > 0
    trigger = F.when(F.col("trigger_start").isNotNull(), F.struct(F.lit("Trigger").alias("@type"), _provenance(F.col("trigger_start"), F.col("trigger_stop")).alias("provenance")))
    body = F.struct(
        F.lit("Extraction").alias("@type"), _id("Extraction", doc, sent, F.col("mention_no")).alias("@id"), F.when(event, "relation").otherwise("concept").alias("type"), F.when(event, F.lower("label")).otherwise("entity").alias("subtype"),
        _some(F.concat(F.array("label"), F.filter("labels", lambda x: x != F.col("label")))).alias("labels"), "text", F.col("found_by").alias("rule"), F.col("canonical_name").alias("canonicalName"), "relevance",
        _provenance(F.col("start"), F.col("stop")).alias("provenance"), trigger.alias("trigger"), _some(arguments).alias("arguments"), _some(states).alias("states"),
    )
    # the mentions of a sentence are bounded by its length
    m = mentions.where(doc.isNotNull() & sent.isNotNull()).select("document_id", "sent_no", F.struct("mention_no", body.alias("x")).alias("m")).groupBy("document_id", "sent_no").agg(F.array_sort(F.collect_list("m")).alias("ms"))
    per = s.join(m, ["document_id", "sent_no"], "left").withColumn("part", F.floor(sent / PART).cast("int")).groupBy("document_id", "part").agg(F.array_sort(F.collect_list(F.struct("sent_no", "s", "ms"))).alias("items"))
    d = documents.where(doc.isNotNull()).groupBy("document_id").agg(F.first(F.struct("title", "location", "dct_text", "dct_start", "dct_end")).alias("d"))
    dct = F.when(F.col("d.dct_start").isNotNull(), F.struct(F.lit("TimeExpression").alias("@type"), F.col("d.dct_text").alias("text"), F.col("d.dct_start").cast("string").alias("start"), F.col("d.dct_end").cast("string").alias("end")))
    whole = F.struct(
        F.struct(F.lit(context).alias("@base")).alias("@context"), F.lit("Corpus").alias("@type"),
        F.array(F.struct(F.lit("Document").alias("@type"), _id("Document", doc).alias("@id"), doc.alias("id"), F.col("d.title").alias("title"), F.col("d.location").alias("location"), dct.alias("dct"), F.transform("items", lambda i: i["s"]).alias("sentences"))).alias("documents"),
        _some(F.flatten(F.transform("items", lambda i: F.transform(F.coalesce(i["ms"], F.filter(F.array(F.struct(F.lit(0).alias("mention_no"), F.lit(None).alias("x"))), lambda _: F.lit(False))), lambda x: x["x"])))).alias("extractions"),
    )
    return per.join(d, "document_id", "left").select("document_id", "part", F.to_json(whole).alias("json"))


def _last(column: Column) -> Column:
    """The number at the end of an ``@id``."""
    return F.regexp_extract(column, r"_(\d+)$", 1).try_cast("int")


def read_corpus(objects: DataFrame, column: str = "json") -> tuple[DataFrame, DataFrame, DataFrame]:
    """``documents, sentences, mentions`` of objects as :func:`write_corpus` makes them; unreadable objects give no rows."""
    parsed = objects.select(F.from_json(column, SCHEMA).alias("c")).where("c.documents IS NOT NULL").select(F.explode("c.documents").alias("d"), F.col("c.extractions").alias("xs"))
    docs = parsed.select(F.col("d.id").alias("document_id"), "d.title", "d.location", F.col("d.dct.text").alias("dct_text"), F.col("d.dct.start").try_cast("date").alias("dct_start"), F.col("d.dct.end").try_cast("date").alias("dct_end")).distinct()
    words = F.transform("s.words", lambda w: F.struct(w["text"].alias("word"), w["tag"].alias("tag"), w["entity"].alias("entity"), w["startOffset"].alias("start"), w["endOffset"].alias("stop"), w["lemma"].alias("lemma"), w["chunk"].alias("chunk"), w["norm"].alias("norm")))
    links = F.transform("s.dependencies", lambda e: F.struct(_last(e["source"]["@id"]).alias("src"), _last(e["destination"]["@id"]).alias("dst"), e["relation"].alias("rel")))
    sentences = parsed.select(F.col("d.id").alias("document_id"), F.explode("d.sentences").alias("s")).select("document_id", _last(F.col("s.@id")).alias("sent_no"), "s.text", "s.relevance", F.coalesce(words, F.array().cast(TOKENS)).alias("tokens"), F.coalesce(links, F.array().cast(EDGES)).alias("edges"))
    place = lambda c: F.get(F.get(c, F.lit(0))["sentenceWordPositions"], F.lit(0))
    states = F.transform("x.states", lambda s: F.struct(s["type"].alias("type"), s["text"].alias("trigger"), F.coalesce(F.transform(s["modifiers"], lambda m: m["text"]), F.array().cast("array<string>")).alias("quantifiers")))
    args = F.transform("x.arguments", lambda a: F.struct(a["type"].alias("role"), _last(a["value"]["@id"]).alias("mention_no")))
    x = parsed.select(F.col("d.id").alias("document_id"), F.explode("xs").alias("x"))
    found = x.select(
        "document_id", _last(F.get("x.provenance", F.lit(0))["sentence"]["@id"]).alias("sent_no"), _last(F.col("x.@id")).alias("mention_no"), F.get("x.labels", F.lit(0)).alias("label"), F.coalesce("x.labels", F.array().cast("array<string>")).alias("labels"),
        (place("x.provenance")["start"] - 1).alias("start"), place("x.provenance")["end"].alias("stop"), (place("x.trigger.provenance")["start"] - 1).alias("trigger_start"), place("x.trigger.provenance")["end"].alias("trigger_stop"),
        "x.text", F.coalesce(args, F.array().cast("array<struct<role:string,mention_no:int>>")).alias("args"), F.col("x.rule").alias("found_by"), F.col("x.canonicalName").alias("canonical_name"), "x.relevance", F.coalesce(states, F.array().cast(ATTACHMENTS)).alias("attachments"),
    )
    return docs, sentences, found


def annotated(sentences: DataFrame) -> DataFrame:
    """``sent_key, tokens, edges`` for the rule engine, from the sentences of a corpus: rules run on what was annotated elsewhere."""
    return sentences.select(F.concat_ws(":", "document_id", "sent_no").alias("sent_key"), "tokens", "edges")


def mentions_json(mentions: DataFrame) -> DataFrame:
    """``document_id, id, json``: one object per mention under an id that equal mentions share; repeated ones come once.

    The id is a hash of document, place, labels, rule and arguments, so files written apart can be put together.
    """
    keys = ["document_id", "sent_no", "start", "stop", "label", "labels", "found_by", "args"]
    ident = F.format_string("M:%016x", F.xxhash64(*[F.to_json(F.struct(c)) for c in keys]))
    body = F.to_json(F.struct(ident.alias("id"), *[F.col(c) for c in [*keys, "mention_no", "text", "trigger_start", "trigger_stop", "attachments"]]))
    return mentions.select("document_id", ident.alias("id"), body.alias("json")).groupBy("document_id", "id").agg(F.min("json").alias("json"))


def read_mentions_json(objects: DataFrame, column: str = "json") -> DataFrame:
    """The mentions of :func:`mentions_json`, with their ids; unreadable objects give no rows."""
    schema = f"id string, document_id string, sent_no int, mention_no int, label string, labels array<string>, start int, stop int, trigger_start int, trigger_stop int, text string, args array<struct<role:string,mention_no:int>>, found_by string, attachments {ATTACHMENTS}"
    return objects.select(F.from_json(column, schema).alias("m")).select("m.*").where("id IS NOT NULL")
