"""Readers of documents, their metadata and the small dictionaries of the pipeline.

Documents come out as ``doc_id, title, location, text, dct_start, dct_end``: the document creation time is the
half-open day. Unreadable records give null fields, never an error.
"""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.functions.text import after_last, unescape_tsv

CDR_SCHEMA = "document_id string, extracted_text string, uri string, extracted_metadata struct<Title:string,CreationDate:string,ModDate:string,Author:string,Pages:int>"


def document_date(value: Column) -> Column:
    """Date of ``yyyy-MM-dd`` or of epoch seconds; null for the epoch itself and for anything else."""
    number = F.when(value.rlike(r"^\d{9,10}$"), value.try_cast("long"))
    return F.coalesce(F.when(value.rlike(r"^\d{4}-\d\d-\d\d$"), F.nullif(value.try_cast("date"), F.lit("1970-01-01").cast("date"))), F.when(number > 0, F.to_date(F.from_unixtime(number))))


def _document(doc_id: Column, title: Column, location: Column, text: Column, day: Column) -> list[Column]:
    return [doc_id.alias("doc_id"), title.alias("title"), location.alias("location"), text.alias("text"), day.alias("dct_start"), F.date_add(day, 1).alias("dct_end")]


def read_text(spark: SparkSession, path: str, pattern: str = "*.txt", date: str | None = None) -> DataFrame:
    """One document per file; its id is the file name."""
    files = spark.read.option("pathGlobFilter", pattern).text(path, wholetext=True).select("value", F.input_file_name().alias("file"))
    return files.select(*_document(after_last(F.col("file"), "/"), F.lit(None).cast("string"), F.col("file"), F.col("value"), F.lit(date).cast("date")))


def read_cdr(spark: SparkSession, path: str) -> DataFrame:
    """Document records, one JSON object per line or file, possibly wrapped in ``_source``; the later of the two dates is preferred by name: ModDate, else CreationDate."""
    raw = spark.read.schema(f"{CDR_SCHEMA}, _source struct<{CDR_SCHEMA.replace(' string', ':string').replace('extracted_metadata struct', 'extracted_metadata:struct')}>").json(path, multiLine=True)
    pick = lambda c: F.coalesce(F.col(c), F.col(f"_source.{c}"))
    meta = lambda c: F.coalesce(F.col(f"extracted_metadata.{c}"), F.col(f"_source.extracted_metadata.{c}"))
    return raw.select(*_document(pick("document_id"), meta("Title"), pick("uri"), pick("extracted_text"), F.coalesce(document_date(meta("ModDate")), document_date(meta("CreationDate")))))


def _tagged(node, found: dict) -> dict:
    """Name-value pairs anywhere in a metadata tree; the first of a name counts."""
    if isinstance(node, dict):
        if "N" in node and "V" in node:
            found.setdefault(str(node["N"]), node["V"])
        for v in node.values():
            _tagged(v, found)
    elif isinstance(node, list):
        for v in node:
            _tagged(v, found)
    return found


def tree_metadata(df: DataFrame, id_col: str, json_col: str) -> DataFrame:
    """``doc_id, title, day`` from metadata trees of ``{N, V}`` pairs: spreadsheet, creation, then publication date; ``D:`` and ``/`` notations."""

    def run(batches):
        for b in batches:
            rows = []
            for i, text in zip(b[id_col], b[json_col]):
                try:
                    pairs = _tagged(json.loads(text), {})
                except (TypeError, ValueError):
                    pairs = {}
                raw = next((str(pairs[k]) for k in ("spreadsheetDate", "creation date", "CreationDate", "publicationDate") if pairs.get(k)), "")
                m = re.match(r"^(?:D:)?(\d{4})[-/]?(\d\d)[-/]?(\d\d)", raw)
                rows.append((i, pairs.get("title"), "-".join(m.groups()) if m else None))
            yield pd.DataFrame(rows, columns=["doc_id", "title", "day"])

    return df.select(F.col(id_col).cast("string"), json_col).mapInPandas(run, "doc_id string, title string, day string").withColumn("day", F.col("day").try_cast("date"))


def pdfinfo(text: Column) -> Column:
    """``map<key, value>`` of ``Key:   value`` lines."""
    lines = F.filter(F.split(text, r"\r?\n"), lambda x: x.contains(":"))
    return F.map_from_entries(F.array_distinct(F.transform(lines, lambda x: F.struct(F.trim(F.substring_index(x, ":", 1)).alias("k"), F.trim(F.regexp_extract(x, r"^[^:]*:(.*)$", 1)).alias("v")))))


def read_tsv(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """Tab-separated text with escaped fields; short rows are padded with nulls, long ones cut."""
    parts = spark.read.text(path).select(F.split("value", "\t").alias("p"))
    return parts.select(*[unescape_tsv(F.get("p", F.lit(i))).alias(c) for i, c in enumerate(columns)])


def write_tsv(df: DataFrame, path: str) -> None:
    """Tab-separated text with escaped fields and a header line per part."""
    from strandline.functions.text import escape_tsv

    df.select(*[escape_tsv(F.coalesce(F.col(c).cast("string"), F.lit(""))).alias(c) for c in df.columns]).write.csv(path, sep="\t", header=True, quote="", escape="")


def read_words(spark: SparkSession, path: str) -> DataFrame:
    """``word``: words of a commented list, separated by line ends or commas."""
    return spark.read.text(path).select(F.explode(F.split(F.regexp_replace("value", "#.*$", ""), ",")).alias("word")).select(F.trim("word").alias("word")).where("word <> ''")


def read_phrases(spark: SparkSession, path: str) -> DataFrame:
    """``phrase, label``: one phrase per line; the label is the file's base name."""
    rows = spark.read.text(path).select(F.trim("value").alias("phrase"), F.regexp_extract(F.input_file_name(), r"([^/.]+)[^/]*$", 1).alias("label"))
    return rows.where("phrase <> '' AND NOT startswith(phrase, '#')")


def read_adjectives(spark: SparkSession, path: str) -> DataFrame:
    """``adjective, mu, sigma, intercept`` of a tab-separated table with ``#`` comments."""
    return spark.read.csv(path, sep="\t", comment="#", schema="adjective string, mu double, sigma double, intercept double")


def read_domain_parameters(spark: SparkSession, path: str) -> DataFrame:
    """``name, mean, stdev`` of ``name TAB mean:x TAB stdev:y`` lines."""
    rows = spark.read.text(path).where("NOT startswith(value, '#')").select(F.split("value", "\t").alias("p"))
    value = lambda k: F.get(F.filter("p", lambda x: x.startswith(f"{k}:")), F.lit(0)).substr(F.lit(len(k) + 2), F.lit(40)).try_cast("double")
    return rows.select(F.get("p", F.lit(0)).alias("name"), value("mean").alias("mean"), value("stdev").alias("stdev"))


def with_ids(names: DataFrame, ids: DataFrame) -> DataFrame:
    """Adds ``_id`` by base name, trying the endings ``.html``, ``.htm``, ``.pdf`` in this order; null if none is listed."""
    base = F.regexp_extract("name", r"([^/]+?)(?:\.[^./]*)?$", 1)
    tried = names.select("*", F.posexplode(F.array(*[F.concat(base, F.lit(e)) for e in (".html", ".htm", ".pdf")])).alias("__i", "__file"))
    hits = tried.join(ids.select(F.col("file_name").alias("__file"), "_id"), "__file").groupBy("name").agg(F.min(F.struct("__i", "_id")).alias("__h"))
    return names.join(hits, "name", "left").select(*names.columns, F.col("__h._id").alias("_id"))
