"""Evaluation passages that leak into training text: ten or more consecutive words of an item, in order.

The test n-grams are few (one per word of the held-out items, whose size is checked) and are broadcast as a hash set;
the corpus is scanned once, without a shuffle. Each n-gram is also represented by
its *anchor*, its word that is rarest among the n-grams; a document without any anchor cannot hold a hit, which one set operation
per document decides, so windows are built around anchors only. A hash hit is verified word by word.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.session import written

WORDS = 10
#: Test n-grams up to which the set is broadcast (about 100 bytes each); larger sets are joined.
MAX_NGRAMS = 2_000_000
#: Parts that a hot n-gram is split into.
SALT = 16

_WORD = re.compile(r"[^\W_]+")


def words_with_spans(text: str) -> list[tuple[str, int, int]]:
    """``(word, start, end)`` of the runs of letters and digits in composed, lower-cased form; offsets are of ``text``."""
    composed = unicodedata.normalize("NFC", text)
    if composed == text:
        return [(unicodedata.normalize("NFC", m[0].lower()), m.start(), m.end()) for m in _WORD.finditer(text)]
    out, start, i = [], None, 0
    for i, c in enumerate(text):
        if c.isalnum() or (start is not None and unicodedata.combining(c)):
            start = i if start is None else start
        elif start is not None:
            out.append((start, i))
            start = None
    if start is not None:
        out.append((start, len(text)))
    # a mark that does not compose with the letter before it ends a word in the composed form as well
    return [(unicodedata.normalize("NFC", w.lower()), a, b) for a, b in out for w in _WORD.findall(unicodedata.normalize("NFC", text[a:b]))]


def words(text: str) -> list[str]:
    """Normalised words: runs of letters and digits of the canonically composed text in lower case."""
    return _WORD.findall(unicodedata.normalize("NFC", unicodedata.normalize("NFC", text).lower()))


class TestSet:
    """N-grams of the items: anchor word -> [(place of the anchor, n-gram, item)]."""

    __test__ = False

    def __init__(self, items: list[tuple[int, str]], n: int = WORDS):
        self.n = n
        grams: dict[tuple[str, ...], list[int]] = {}
        for item, text in items:
            w = words(text or "")
            for i in range(len(w) - n + 1):
                ids = grams.setdefault(tuple(w[i : i + n]), [])
                if item not in ids:
                    ids.append(item)
        seen = Counter(w for g in grams for w in set(g))
        self.grams = grams
        self.places: dict[str, list[int]] = {}
        places: dict[str, set[int]] = {}
        for g in grams:
            at = min(range(n), key=lambda i: (seen[g[i]], i))
            places.setdefault(g[at], set()).add(at)
        self.places = {w: sorted(p) for w, p in places.items()}
        self.anchors = frozenset(self.places)

    def hits(self, w: list[str]) -> dict[int, list[int]]:
        """Item -> positions of its n-grams among the words ``w``."""
        found: dict[int, list[int]] = {}
        if len(w) < self.n or self.anchors.isdisjoint(w):
            return found
        places, n = self.places, self.n
        starts = {i - p for i, x in enumerate(w) if x in places for p in places[x]}
        for s in sorted(starts):
            if 0 <= s <= len(w) - n:
                for item in self.grams.get(tuple(w[s : s + n]), ()):  # the look-up compares the words themselves
                    found.setdefault(item, []).append(s)
        return found


def _rows(gold: DataFrame) -> DataFrame:
    return gold.where(F.col("item_text").isNotNull()).select(F.col("item_id").cast("long").alias("item_id"), "item_text")


def _is_small(gold: DataFrame) -> bool:
    """Whether the n-grams of the items, at most one for two characters, may be sent to all workers."""
    return (_rows(gold).agg(F.sum(F.length("item_text"))).first()[0] or 0) / 2 <= MAX_NGRAMS


def _test_set(gold: DataFrame, n: int):
    made = TestSet([(r.item_id, r.item_text) for r in _rows(gold).collect()], n)
    return gold.sparkSession.sparkContext.broadcast(made)


def _gram_keys(w: list[str], n: int) -> set[int]:
    return {int.from_bytes(hashlib.blake2b("\x1f".join(w[i : i + n]).encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True) for i in range(len(w) - n + 1)}


def _joined_hits(docs: DataFrame, gold: DataFrame, n: int) -> DataFrame:
    """``digest, item_id, starts``: the verified hits of the distinct texts for test sets of any size.

    The n-grams of both sides are hashed and joined, salted by text so that an n-gram that a third of the texts hold
    is split; the pairs of a text and an item that share a hash are then compared word by word.
    """

    def keyed(label):
        def run(batches):
            for batch in batches:
                ids, keys = [], []
                for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    found = _gram_keys(words(text), n)
                    ids += [i] * len(found)
                    keys += found
                yield pa.RecordBatch.from_arrays([pa.array(ids, batch.schema.field(0).type), pa.array(keys, pa.int64())], names=[label, "key"])

        return run

    texts = written(docs.where(F.col("text").isNotNull()).select(F.unhex(F.md5("text")).alias("digest"), "text").dropDuplicates(["digest"]), "leak-texts")
    items = _rows(gold)
    left = texts.mapInArrow(keyed("digest"), "digest binary, key long").withColumn("salt", F.pmod(F.xxhash64("digest"), F.lit(SALT)).cast("int"))
    right = items.mapInArrow(keyed("item_id"), "item_id long, key long").distinct().withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
    pairs = written(left.join(right, ["key", "salt"]).select("digest", "item_id").distinct(), "leak-pairs")

    def verify(batches):
        for batch in batches:
            out = []
            for digest, item, text, item_text in zip(*(c.to_pylist() for c in batch.columns)):
                w, x = words(text), words(item_text)
                grams = {tuple(x[i : i + n]) for i in range(len(x) - n + 1)}
                if starts := [i for i in range(len(w) - n + 1) if tuple(w[i : i + n]) in grams]:
                    out.append((digest, item, starts))
            yield pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], type=t) for i, t in enumerate((pa.binary(), pa.int64(), pa.list_(pa.int32())))], names=["digest", "item_id", "starts"])

    return pairs.join(texts, "digest").join(items, "item_id").select("digest", "item_id", "text", "item_text").mapInArrow(verify, "digest binary, item_id long, starts array<int>")


def leaks(docs: DataFrame, gold: DataFrame, n: int = WORDS) -> DataFrame:
    """``doc_id, item_id``: each pair of a document and an item it holds at least ``n`` consecutive words of.

    One pair per row of ``docs`` (a repeated row repeats its pairs); null, empty and blank texts have none; an
    item with fewer than ``n`` words cannot leak; empty tables give an empty result; other columns are not read.
    Beyond :data:`MAX_NGRAMS` the items are not broadcast but joined (:func:`_joined_hits`), with the same result.
    """
    if not _is_small(gold):
        hits = _joined_hits(docs, gold, n).select("digest", "item_id").distinct()
        rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), F.unhex(F.md5(docs["text"])).alias("digest"))
        return rows.join(hits, "digest").select("doc_id", "item_id")
    shared = _test_set(gold, n)

    def run(batches):
        test = shared.value
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            out = [(d, item) for d, t in zip(ids, texts) if t for item in test.hits(words(t))]
            yield pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], type=pa.int64()) for i in (0, 1)], names=["doc_id", "item_id"])

    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].alias("text")).mapInArrow(run, "doc_id long, item_id long")


def remove_leaks(docs: DataFrame, gold: DataFrame, n: int = WORDS, max_share: float = 0.5) -> DataFrame:
    """``doc_id, text, removed_chars, drop``: the texts without the leaked spans.

    ``drop`` is true where the spans make up at least ``max_share`` of the text: such a document is better left out.
    Null texts stay null and are not dropped.
    """
    if _is_small(gold):
        shared = _test_set(gold, n)
        source = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].alias("text"), F.lit(None).cast("array<int>").alias("starts"))
    else:
        shared = None
        hits = _joined_hits(docs, gold, n).select("digest", F.explode("starts").alias("start")).distinct().groupBy("digest").agg(F.collect_list("start").alias("starts"))  # at most one a word of the text
        source = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].alias("text"), F.unhex(F.md5(docs["text"])).alias("digest")).join(hits, "digest", "left").select("doc_id", "text", F.coalesce("starts", F.array().cast("array<int>")).alias("starts"))

    def run(batches):
        for batch in batches:
            rows: list[tuple] = []
            for d, t, known in zip(*(batch.column(i).to_pylist() for i in range(3))):
                spans = words_with_spans(t) if t else []
                cut = sorted(known) if shared is None else sorted({s for starts in shared.value.hits([w for w, _, _ in spans]).values() for s in starts})
                keep, at, removed = [], 0, 0
                for s in cut:
                    a, b = max(spans[s][1], at), spans[s + n - 1][2]
                    if b > at:
                        keep.append(t[at:a])
                        removed += b - a
                        at = b
                rows.append((d, None if t is None else "".join(keep) + t[at:], removed, bool(t) and removed >= max_share * len(t)))
            kinds = [pa.int64(), pa.string(), pa.int32(), pa.bool_()]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], type=k) for i, k in enumerate(kinds)], names=["doc_id", "text", "removed_chars", "drop"])

    return source.mapInArrow(run, "doc_id long, text string, removed_chars int, drop boolean")
