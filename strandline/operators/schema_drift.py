"""Schemas that drift between the files of a feed: renamed, retyped, added and removed fields.

Every field of every file is profiled by the JSON types of its values, a sketch of the words in them, their
numeric range and its name. Between a file and the one before it in its feed, the fields that go and those that
come are matched by a bipartite assignment of largest total similarity; a matched pair is a rename, the rest are
removals and additions. Matched and lasting fields of different type are retyped.
"""

from __future__ import annotations

import hashlib
import json
import re

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandline.session import broadcast_if_small, cut, written

#: Buckets of a value sketch: the smallest hash of a word in each.
BUCKETS = 32
#: Similarity from which a field that goes and one that comes carry the same information.
MIN_SIMILARITY = 0.4
#: Names used by several feeds up to which their profiles are sent to all workers (about 1 KB each).
MAX_NAMES = 100_000

TYPES = ("string", "number", "boolean", "array", "object")
_WORD = re.compile(r"\w+")
_NAME_PART = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|\d+")


def json_type(value) -> str:
    if isinstance(value, bool):
        return "boolean"
    if isinstance(value, (int, float)):
        return "number"
    return {str: "string", list: "array", dict: "object"}[type(value)]


def metadata_of(payload: str | None) -> dict | None:
    """The ``extracted_metadata`` of a record, unwrapped from ``_source``; None if unreadable, {} if the record has none."""
    if not payload:
        return None
    try:
        record = json.loads(payload)
    except ValueError:
        return None
    if isinstance(record, dict) and isinstance(record.get("_source"), dict):
        record = record["_source"]
    if not isinstance(record, dict):
        return None
    meta = record.get("extracted_metadata")
    return meta if isinstance(meta, dict) else {}


def value_text(value) -> str:
    """The information of a value whatever its JSON type: the text of all its leaves."""
    if isinstance(value, dict):
        return " ".join(value_text(v) for k, v in value.items() if k not in ("role", "type"))
    if isinstance(value, list):
        return " ".join(map(value_text, value))
    return "" if value is None else str(value)


def _hash(word: str) -> int:
    return int.from_bytes(hashlib.blake2b(word.encode("utf-8", "surrogatepass"), digest_size=7).digest(), "big")


def profiles(raw: DataFrame) -> DataFrame:
    """``file_no, key, type, n, lo, hi, sketch``: one row per file and field with a value.

    Rows are profiled batch by batch and the profiles merged by minimum, maximum and sum, so a file of any size is
    never in one task. Unreadable and null payloads and null values count for nothing.
    """
    columns = ["file_no", "key", *TYPES, "lo", "hi", *[f"s{i}" for i in range(BUCKETS)]]

    def run(batches):
        for batch in batches:
            found: dict[tuple, list] = {}
            for file_no, payload in zip(batch.file_no, batch.payload):
                for key, value in (metadata_of(payload) or {}).items():
                    if value is None:
                        continue
                    row = found.get((file_no, key))
                    if row is None:
                        row = found[file_no, key] = [0] * len(TYPES) + [None, None] + [None] * BUCKETS
                    kind = json_type(value)
                    row[TYPES.index(kind)] += 1
                    text = value_text(value)
                    try:
                        number = float(text)
                        at = len(TYPES)
                        row[at] = number if row[at] is None else min(row[at], number)
                        row[at + 1] = number if row[at + 1] is None else max(row[at + 1], number)
                    except ValueError:
                        pass
                    for word in _WORD.findall(text.lower()):
                        h = _hash(word)
                        i = len(TYPES) + 2 + h % BUCKETS
                        if row[i] is None or h < row[i]:
                            row[i] = h
            rows = [(f, k, *r) for (f, k), r in found.items()]
            out = pd.DataFrame(rows, columns=columns)
            yield out.astype({c: "Int64" for c in columns[2 : 2 + len(TYPES)] + columns[-BUCKETS:]} | {"lo": "float64", "hi": "float64", "file_no": "int64"})

    kinds = ["file_no long", "key string", *[f"{t} long" for t in TYPES], "lo double", "hi double", *[f"s{i} long" for i in range(BUCKETS)]]
    part = raw.select(F.col("file_no").cast("long"), "payload").where(F.col("file_no").isNotNull()).mapInPandas(run, ", ".join(kinds))
    merged = part.groupBy("file_no", "key").agg(*[F.sum(t).alias(t) for t in TYPES], F.min("lo").alias("lo"), F.max("hi").alias("hi"), *[F.min(f"s{i}").alias(f"s{i}") for i in range(BUCKETS)])
    best = F.greatest(*[F.struct(F.col(t).alias("n"), F.lit(-i).alias("rank"), F.lit(t).alias("t")) for i, t in enumerate(TYPES)])
    return merged.select("file_no", "key", best["t"].alias("type"), sum((F.col(t) for t in TYPES), F.lit(0)).alias("n"), "lo", "hi", F.array(*[F.col(f"s{i}") for i in range(BUCKETS)]).alias("sketch"))


def name_parts(key: str) -> list[str]:
    """Words of a field name without its namespace."""
    local = re.split(r"[:.]", key)[-1]
    return [p.lower() for p in _NAME_PART.findall(local)] or [local.lower()]


def name_similarity(a: str, b: str) -> float:
    """Dice coefficient of the letter pairs of two names, namespaces and case aside."""
    x, y = ("".join(name_parts(k)) for k in (a, b))
    if x == y:
        return 1.0
    p, q = ({s[i : i + 2] for i in range(len(s) - 1)} for s in (x, y))
    return 2 * len(p & q) / (len(p) + len(q)) if p or q else 0.0


def similarity(a: dict, b: dict) -> float:
    """How far two profiled fields carry the same information, 0 to 1; booleans say nothing but by their names."""
    names = name_similarity(a["key"], b["key"])
    if "boolean" in (a["type"], b["type"]):
        return names if a["type"] == b["type"] and names >= 0.7 else 0.0
    numeric = [x["lo"] is not None and x["lo"] == x["lo"] for x in (a, b)]
    if all(numeric):
        span = max(a["hi"], b["hi"]) - min(a["lo"], b["lo"])
        shared = min(a["hi"], b["hi"]) - max(a["lo"], b["lo"])
        values = 1.0 if span == 0 else max(0.0, shared / span)
        # ranges alone are weak evidence: the names must have something in common
        return 0.5 * values + 0.5 * names if values >= 0.3 and names > 0 else 0.0
    if any(numeric):
        return 0.0
    pairs = [(x, y) for x, y in zip(a["sketch"], b["sketch"]) if x is not None or y is not None]
    values = sum(x == y for x, y in pairs) / len(pairs) if pairs else 0.0
    return 0.8 * values + 0.2 * names if values > 0 else 0.0


def assignment(weights: list[list[float]]) -> list[tuple[int, int]]:
    """Pairs of the assignment with the largest total weight (Hungarian method with potentials); weights >= 0."""
    if not weights or not weights[0]:
        return []
    rows, cols = len(weights), len(weights[0])
    flip = rows > cols
    w = [list(r) for r in zip(*weights)] if flip else weights
    n, m = len(w), len(w[0])
    u, v, match = [0.0] * (n + 1), [0.0] * (m + 1), [0] * (m + 1)
    for i in range(1, n + 1):
        match[0], at = i, 0
        slack, seen, way = [float("inf")] * (m + 1), [False] * (m + 1), [0] * (m + 1)
        while match[at]:
            seen[at] = True
            row, delta, to = match[at], float("inf"), 0
            for j in range(1, m + 1):
                if not seen[j]:
                    cost = -w[row - 1][j - 1] - u[row] - v[j]
                    if cost < slack[j]:
                        slack[j], way[j] = cost, at
                    if slack[j] < delta:
                        delta, to = slack[j], j
            for j in range(m + 1):
                if seen[j]:
                    u[match[j]] += delta
                    v[j] -= delta
                else:
                    slack[j] -= delta
            at = to
        while at:
            match[at] = match[way[at]]
            at = way[at]
    pairs = [(match[j] - 1, j - 1) for j in range(1, m + 1) if match[j]]
    return sorted((b, a) if flip else (a, b) for a, b in pairs)


def compare(before: list[dict], after: list[dict]) -> list[tuple[str, str, str]]:
    """Changes ``(kind, key_before, key_after)`` between the profiled fields of two files."""
    old, new = ({f["key"]: f for f in sorted(fields, key=lambda f: f["key"])} for fields in (before, after))
    gone, come = [f for k, f in old.items() if k not in new], [f for k, f in new.items() if k not in old]
    changes = [("retyped", k, k) for k, f in new.items() if k in old and old[k]["type"] != f["type"]]
    weights = [[s if (s := similarity(a, b)) >= MIN_SIMILARITY else 0.0 for b in come] for a in gone]
    matched = [(i, j) for i, j in assignment(weights) if weights[i][j] > 0]
    for i, j in matched:
        changes.append(("renamed", gone[i]["key"], come[j]["key"]))
        if gone[i]["type"] != come[j]["type"]:
            changes.append(("retyped", come[j]["key"], come[j]["key"]))
    changes += [("removed", f["key"], "") for i, f in enumerate(gone) if i not in {a for a, _ in matched}]
    changes += [("added", "", f["key"]) for j, f in enumerate(come) if j not in {b for _, b in matched}]
    return changes


def changes(raw: DataFrame) -> DataFrame:
    """p5: ``file_no, change_kind, key_before, key_after`` between each file and the one before it in its feed.

    The first file of a feed gives none; a file without readable records has no fields, so all go and come back;
    repeated records change nothing; of two files with the same place in a feed the lower ``file_no`` is first;
    an empty table gives an empty one; extra columns are not read. Field lists are collected per file (bounded
    by the width of its schema), never values.
    """
    return _changes(raw, profiles(raw))


def _steps(raw: DataFrame) -> DataFrame:
    """``file_no, feed, before_no``: every file with the one before it in its feed, null for the first."""
    files = raw.where(F.col("file_no").isNotNull()).groupBy(F.col("file_no").cast("long").alias("file_no")).agg(F.min("feed").alias("feed"), F.min("file_seq").alias("file_seq"))
    order = Window.partitionBy("feed").orderBy("file_seq", "file_no")
    return files.select("file_no", "feed", F.lag("file_no").over(order).alias("before_no"))


def _changes(raw: DataFrame, profiled: DataFrame) -> DataFrame:
    fields = profiled.groupBy("file_no").agg(F.collect_list(F.struct("key", "type", "lo", "hi", "sketch")).alias("fields"))
    steps = _steps(raw).where(F.col("before_no").isNotNull())
    both = steps.join(fields.withColumnRenamed("fields", "after"), "file_no", "left").join(fields.select(F.col("file_no").alias("before_no"), F.col("fields").alias("before")), "before_no", "left").select("file_no", "before", "after")

    def run(batches):
        for batch in batches:
            rows = []
            for file_no, before, after in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                rows += [(file_no, *c) for c in compare(before or [], after or [])]
            import pyarrow as pa

            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), *[pa.array([r[i] for r in rows], pa.string()) for i in (1, 2, 3)]], names=["file_no", "change_kind", "key_before", "key_after"])

    return both.mapInArrow(run, "file_no long, change_kind string, key_before string, key_after string")


def _lineages(raw: DataFrame, profiled: DataFrame) -> DataFrame:
    """``file_no, key, feed, root``: every field of every file with the first field of its line in the feed.

    A field continues the one of the same name, or the one it was renamed from, in the file before. The first of each
    line is found by pointer doubling, so a feed of any number of files takes a logarithmic number of joins.
    """
    steps = _steps(raw)
    fields = profiled.select("file_no", "key").join(steps, "file_no")
    renames = _changes(raw, profiled).where("change_kind = 'renamed'").select("file_no", F.col("key_after").alias("key"), F.col("key_before").alias("old"))
    earlier = profiled.select(F.col("file_no").alias("before_no"), F.col("key").alias("same"))
    linked = fields.join(renames, ["file_no", "key"], "left").join(earlier, (fields["before_no"] == earlier["before_no"]) & (fields["key"] == earlier["same"]), "left").select("file_no", "key", "feed", fields["before_no"], F.coalesce("old", "same").alias("old"))
    node = lambda no, key: F.struct(F.col(no).alias("file_no"), F.col(key).alias("key"))
    up = cut(linked.select("feed", node("file_no", "key").alias("at"), F.when(F.col("old").isNotNull(), node("before_no", "old")).otherwise(node("file_no", "key")).alias("root")))
    while True:
        step = up.select(F.col("at").alias("root"), F.col("root").alias("further"))
        farther = cut(up.join(step, "root").select("feed", "at", F.col("further").alias("root"), (F.col("further") != F.col("root")).alias("moved")))
        up = farther.drop("moved")
        if farther.where("moved").isEmpty():
            return up.select("at.file_no", "at.key", "feed", "root")


def _same_name(key: str) -> str:
    return "".join(name_parts(key))


def fields_of(raw: DataFrame) -> DataFrame:
    """``file_no, key, field``: the canonical name of every field of every file.

    Names are resolved within a feed, along the line of a field from file to file, so one name that two feeds give to
    different fields joins nothing. A line is called by its first name, namespaces and case aside. A line whose first
    name is used by no other feed is matched with the names that several feeds use and this feed does not, by a
    bipartite assignment on the merged profiles; what finds no match keeps its own name.
    """
    profiled = written(profiles(raw), "profiles")
    lines = written(_lineages(raw, profiled), "lineages")
    buckets = [F.min(F.get("sketch", F.lit(i))).alias(f"s{i}") for i in range(BUCKETS)]
    merged = lines.join(profiled, ["file_no", "key"]).groupBy("feed", "root").agg(F.sum("n").alias("n"), F.mode("type", True).alias("type"), F.min("lo").alias("lo"), F.max("hi").alias("hi"), *buckets)
    merged = written(merged.select("feed", "root", F.col("root.key").alias("first"), "n", "type", "lo", "hi", F.array(*[F.col(f"s{i}") for i in range(BUCKETS)]).alias("sketch")), "lines")

    named = _name_column(merged)
    feeds = named.groupBy("name").agg(F.count_distinct("feed").alias("feeds"), F.sum("n").alias("n"), F.mode("type", True).alias("type"), F.min("lo").alias("lo"), F.max("hi").alias("hi"), *buckets, F.min_by("first", F.struct(-F.col("n"), F.col("first"))).alias("key"))
    shared_names = feeds.where("feeds > 1").select("name", "key", "type", "lo", "hi", F.array(*[F.col(f"s{i}") for i in range(BUCKETS)]).alias("sketch"))
    if shared_names.count() > MAX_NAMES:
        raise ValueError(f"more than {MAX_NAMES} field names are used by several feeds")
    common = raw.sparkSession.sparkContext.broadcast({r.name: r.asDict() for r in shared_names.collect()})

    def run(batches):
        for batch in batches:
            rows = []
            for feed, group in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                own = {x["name"] for x in group}
                odd = [x for x in group if x["name"] not in common.value]
                free = [c for name, c in sorted(common.value.items()) if name not in own]
                weights = [[w if (w := similarity({**x, "key": x["first"]}, c)) >= MIN_SIMILARITY else 0.0 for c in free] for x in odd]
                found = {i: free[j]["key"] for i, j in assignment(weights) if weights[i][j] > 0}
                rows += [(feed, x["root"]["file_no"], x["root"]["key"], common.value[x["name"]]["key"]) for x in group if x["name"] in common.value]
                rows += [(feed, x["root"]["file_no"], x["root"]["key"], found.get(i, x["first"])) for i, x in enumerate(odd)]
            import pyarrow as pa

            kinds = [pa.string(), pa.int64(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], type=k) for i, k in enumerate(kinds)], names=["feed", "file_no", "key", "field"])

    # the lines of a feed are as many as it ever had fields
    gathered = named.groupBy("feed").agg(F.sort_array(F.collect_list(F.struct("root", "name", "first", "type", "lo", "hi", "sketch"))).alias("lines"))
    resolved = gathered.mapInArrow(run, "feed string, file_no long, key string, field string").select("feed", F.struct("file_no", "key").alias("root"), "field")
    return lines.join(resolved, [lines["feed"].eqNullSafe(resolved["feed"]), lines["root"] == resolved["root"]]).select("file_no", lines["key"], "field")


def _name_column(merged: DataFrame) -> DataFrame:
    names = F.pandas_udf(lambda s: s.map(_same_name), "string")
    return merged.withColumn("name", names("first"))


def unify(raw: DataFrame) -> DataFrame:
    """``raw_no, file_no, field, type, value``: all records as one long table under canonical field names.

    ``type`` is the JSON type that most values of the field have, whatever the value's own; ``value`` is its text, so a
    number written as text and a list of one are the same as the plain value. Two fields of a record with one canonical
    name give two rows only if their texts differ. Unreadable records have no rows; files are told apart by ``file_no``.
    """
    names = fields_of(raw)

    def run(batches):
        for batch in batches:
            rows = []
            for raw_no, file_no, payload in zip(batch.raw_no, batch.file_no, batch.payload):
                rows += [(raw_no, file_no, k, json_type(v), value_text(v)) for k, v in (metadata_of(payload) or {}).items() if v is not None]
            yield pd.DataFrame(rows, columns=["raw_no", "file_no", "key", "own", "value"]).astype({"raw_no": "int64", "file_no": "int64"})

    some = raw.where(F.col("raw_no").isNotNull() & F.col("file_no").isNotNull())
    cells = some.select(F.col("raw_no").cast("long"), F.col("file_no").cast("long"), "payload").mapInPandas(run, "raw_no long, file_no long, key string, own string, value string")
    cells = written(cells.join(broadcast_if_small(names), ["file_no", "key"]), "cells")
    types = cells.groupBy("field", "own").agg(F.count("*").alias("n")).groupBy("field").agg(F.max_by("own", F.struct("n", "own")).alias("type"))
    return cells.join(broadcast_if_small(types), "field").select("raw_no", "file_no", "field", "type", "value").distinct()
