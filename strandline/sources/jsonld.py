"""Corpora as JSON-LD: one object per document with its extractions, and back to tables.

Null, empty-string and empty-list fields are left out. A document with very many extractions comes in several
objects of one ``@id`` (parts), so that no task has to gather an unbounded group; a reader joins them by id.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Extractions per object.
PART = 1000


def corpus_documents(documents: DataFrame, extractions: DataFrame, context: str = "https://example.org/corpus") -> DataFrame:
    """``document_id, part, n, json``: the JSON-LD object(s) of each document that has extractions.

    Rows with a null id are left out: an object needs an ``@id``. Repeated document rows count once.
    """
    e = extractions.where("document_id IS NOT NULL")
    parts = e.groupBy("document_id").agg(F.ceil(F.count("*") / PART).alias("parts"))
    blank = lambda c: F.nullif(F.col(c), F.lit(""))
    states = F.transform(F.filter("states", lambda s: s["state_type"].isNotNull()), lambda s: F.struct(F.lit("State").alias("@type"), s["state_type"].alias("type"), s["state_text"].alias("text")))
    body = F.struct(
        F.lit("Extraction").alias("@type"), F.format_string("_:Extraction_%d", "extraction_id").alias("@id"), blank("extraction_type").alias("type"), blank("subtype").alias("subtype"),
        F.when(F.size("mention_labels") > 0, F.col("mention_labels")).alias("labels"), blank("mention_text").alias("text"), blank("rule_name").alias("rule"), blank("canonical_name").alias("canonicalName"), F.col("relevance"),
        F.when(F.col("node_path").isNotNull(), F.array(F.struct(F.lit("Grounding").alias("@type"), F.rtrim(F.col("node_path"), F.lit("/")).alias("ontologyConcept"), F.col("node_score").alias("value")))).alias("groundings"), F.when(F.size("states") > 0, states).alias("states"),
    )
    rows = e.join(parts, "document_id").select("document_id", F.pmod(F.xxhash64("extraction_id"), "parts").cast("int").alias("part"), "extraction_id", body.alias("x"))
    objects = rows.groupBy("document_id", "part").agg(F.count("*").alias("n"), F.array_sort(F.collect_list(F.struct("extraction_id", "x"))).alias("xs"))
    docs = documents.where("document_id IS NOT NULL").groupBy("document_id").agg(F.min("uri").alias("location"), F.min("extracted_metadata.Title").alias("title"))
    whole = F.to_json(
        F.struct(
            F.struct(F.lit(context).alias("@base")).alias("@context"), F.lit("Corpus").alias("@type"),
            F.array(F.struct(F.lit("Document").alias("@type"), F.concat(F.lit("_:Document_"), "document_id").alias("@id"), F.col("document_id").alias("id"), blank("title").alias("title"), blank("location").alias("location"))).alias("documents"),
            F.transform("xs", lambda x: x["x"]).alias("extractions"),
        )
    )
    return objects.join(docs, "document_id", "left").select("document_id", "part", "n", whole.alias("json"))


READ_SCHEMA = (
    "`documents` array<struct<id:string,title:string,location:string>>, `extractions` array<struct<`@id`:string,type:string,subtype:string,labels:array<string>,text:string,rule:string,canonicalName:string,relevance:double,"
    "groundings:array<struct<ontologyConcept:string,value:double>>,states:array<struct<type:string,text:string>>>>"
)


def read_extractions(objects: DataFrame, column: str = "json") -> DataFrame:
    """Extraction table of JSON-LD objects: the inverse of :func:`corpus_documents`; unreadable objects give no rows."""
    parsed = objects.select(F.from_json(column, READ_SCHEMA).alias("c")).select(F.get("c.documents", F.lit(0))["id"].alias("document_id"), F.explode("c.extractions").alias("x"))
    states = F.transform("x.states", lambda s: F.struct(s["type"].alias("state_type"), s["text"].alias("state_text")))
    return parsed.select(
        F.regexp_extract(F.col("x.@id"), r"_(\d+)$", 1).cast("long").alias("extraction_id"), "document_id", F.col("x.type").alias("extraction_type"), "x.subtype", F.coalesce("x.labels", F.array().cast("array<string>")).alias("mention_labels"),
        F.col("x.text").alias("mention_text"), F.col("x.rule").alias("rule_name"), F.col("x.canonicalName").alias("canonical_name"), "x.relevance", F.coalesce(states, F.expr("cast(array() AS array<struct<state_type:string,state_text:string>>)")).alias("states"),
        F.get("x.groundings", F.lit(0))["ontologyConcept"].alias("node_path"), F.get("x.groundings", F.lit(0))["value"].alias("node_score"),
    )


def groundings_only(objects: DataFrame, column: str = "json") -> DataFrame:
    """``extraction_id, groundings``: ids and groundings, for regrounding without the rest."""
    parsed = objects.select(F.explode(F.from_json(column, READ_SCHEMA)["extractions"]).alias("x"))
    return parsed.select(F.regexp_extract(F.col("x.@id"), r"_(\d+)$", 1).cast("long").alias("extraction_id"), F.to_json("x.groundings").alias("groundings"))
