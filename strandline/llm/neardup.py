"""Near-duplicate texts by deletion-variant signatures.

A text is the set of its 8-character windows. Its signature has ``SEGMENTS * WIDTH`` symbols, each the minimum
of one hash function over the windows, so two signatures agree in a symbol with the probability that is the
similarity of the sets. The signature is cut into so few segments that a similar pair must have one segment
that differs in at most one symbol: with 16 segments of 5, any pair that disagrees in at most 31 of the 80
symbols has one. Every segment is indexed by its one-wildcard variants (the segment without one of its
symbols), an equality join on them gives the candidates, and candidates are verified on the window sets.

The symbols are hash minima, not single bits: at a similarity of 0.6 a pair of 64-bit sign signatures differs in
about 15 bits, and segments that then differ in at most one bit would be 8 bits wide and match everything.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.session import broadcast_if_small, written

SEGMENTS, WIDTH = 16, 5
WINDOW = 8
MIN_CHARS = 200
SIMILARITY = 0.6
#: Share of equal symbols below which a candidate is not verified: 4.5 standard deviations under 0.6.
MIN_AGREEMENT = 0.35

_random = np.random.default_rng(20210607)
_MULTIPLY = (_random.integers(0, 2**31, SEGMENTS * WIDTH, dtype=np.uint32) << np.uint32(1)) | np.uint32(1)
_FLIP = _random.integers(0, 2**32, SEGMENTS * WIDTH, dtype=np.uint32)
_POWERS = _random.integers(1, 2**63, WINDOW, dtype=np.uint64) | np.uint64(1)
_BLANKS = str.maketrans("", "", " \t\r\n")


def normal_text(text: str) -> str:
    """Lower case without blanks, tabs and line breaks."""
    return text.lower().translate(_BLANKS)


def window_set(text: str) -> set[str]:
    return {text[i : i + WINDOW] for i in range(len(text) - WINDOW + 1)}


def signatures(texts: list[str]) -> np.ndarray:
    """``len(texts) x (SEGMENTS * WIDTH)`` symbols of normalised texts of at least ``WINDOW`` characters.

    A symbol is the low 16 bits of a minimum: different minima share one in 65,536 times, which verification sorts out.
    """
    out = np.empty((len(texts), SEGMENTS * WIDTH), dtype=np.uint16)
    at = 0
    while at < len(texts):
        # groups of texts of about 64k characters stay in the cache
        size, stop = 0, at
        while stop < len(texts) and (stop == at or size + len(texts[stop]) <= 65_536):
            size += len(texts[stop])
            stop += 1
        codes = np.frombuffer("".join(texts[at:stop]).encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
        n = len(codes) - WINDOW + 1
        h = codes[:n] * _POWERS[0]
        for j in range(1, WINDOW):
            h += codes[j : n + j] * _POWERS[j]
        h ^= h >> np.uint64(29)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        h = (h >> np.uint64(32)).astype(np.uint32)
        lengths = np.array([len(t) for t in texts[at:stop]])
        starts = np.concatenate(([0], np.cumsum(lengths)[:-1]))
        # windows that cross into the next text belong to neither: segments are [start, end of own windows)
        edges = np.empty(2 * len(lengths), dtype=np.int64)
        edges[::2], edges[1::2] = starts, starts + lengths - WINDOW + 1
        edges = edges[:-1]
        for k in range(SEGMENTS * WIDTH):
            out[at:stop, k] = np.minimum.reduceat((h ^ _FLIP[k]) * _MULTIPLY[k], edges)[::2] & np.uint32(0xFFFF)
        at = stop
    return out


def variant_keys(symbols: np.ndarray) -> np.ndarray:
    """``n x (SEGMENTS * WIDTH)`` 64-bit keys: each segment without each of its symbols, tagged with both places."""
    n = len(symbols)
    mixed = symbols.astype(np.uint64).reshape(n, SEGMENTS, WIDTH)
    tags = np.arange(SEGMENTS * WIDTH, dtype=np.uint64).reshape(1, SEGMENTS, WIDTH)
    each = (mixed + np.uint64(0x9E3779B97F4A7C15)) * (np.arange(1, WIDTH + 1, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93) | np.uint64(1))
    each ^= each >> np.uint64(32)
    each *= np.uint64(0xFF51AFD7ED558CCD)
    each ^= each >> np.uint64(29)
    keys = each.sum(axis=2, keepdims=True, dtype=np.uint64) - each  # the segment's sum without one symbol
    keys = (keys ^ (keys >> np.uint64(31))) * np.uint64(0xC4CEB9FE1A85EC53) + tags * np.uint64(0x9FB21C651E98DF25)
    return keys.reshape(n, -1).view(np.int64)


def _signed(texts: DataFrame) -> DataFrame:
    """``rec, digest, symbols`` of every text that is long enough."""

    def run(batches):
        for batch in batches:
            recs, texts_ = [], []
            for r, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if t is not None and len(n := normal_text(t)) >= MIN_CHARS:
                    recs.append(r)
                    texts_.append(n)
            if recs:
                s = signatures(texts_)
                digests = [hashlib.blake2b(t.encode("utf-8", "surrogatepass"), digest_size=16).digest() for t in texts_]
                packed = [row.tobytes() for row in s]
                yield pa.RecordBatch.from_arrays([pa.array(recs, pa.int64()), pa.array(digests, pa.binary()), pa.array(packed, pa.binary())], names=["rec", "digest", "symbols"])

    return texts.mapInArrow(run, "rec long, digest binary, symbols binary")


def _keys(classes: DataFrame) -> DataFrame:
    def run(batches):
        for batch in batches:
            symbols = np.frombuffer(b"".join(batch.column(1).to_pylist()), dtype=np.uint16).reshape(-1, SEGMENTS * WIDTH)
            if len(symbols):
                keys = variant_keys(symbols)
                recs = np.repeat(batch.column(0).to_numpy(), SEGMENTS * WIDTH)
                yield pa.RecordBatch.from_arrays([pa.array(keys.reshape(-1)), pa.array(recs)], names=["key", "rep"])

    return classes.select("rep", "symbols").mapInArrow(run, "key long, rep long")


def _agreeing(pairs: DataFrame) -> DataFrame:
    """Candidates whose signatures agree in at least ``MIN_AGREEMENT`` of the symbols."""

    def run(batches):
        for batch in batches:
            x, y = (np.frombuffer(b"".join(batch.column(i).to_pylist()), dtype=np.uint16).reshape(-1, SEGMENTS * WIDTH) for i in (2, 3))
            keep = pa.array((x == y).mean(axis=1) >= MIN_AGREEMENT)
            yield pa.RecordBatch.from_arrays([batch.column(i).filter(keep) for i in (0, 1)], names=["a", "b"])

    return pairs.select("a", "b", "sa", "sb").mapInArrow(run, "a long, b long")


def _verified(pairs: DataFrame, similarity: float) -> DataFrame:
    def run(batches):
        for batch in batches:
            out = []
            last, last_set = None, set()
            for a, b, ta, tb in zip(*(batch.column(i).to_pylist() for i in range(4))):
                if a != last:
                    last, last_set = a, window_set(normal_text(ta))
                other = window_set(normal_text(tb))
                common = len(last_set & other)
                out.append(common >= similarity * (len(last_set) + len(other) - common))
            keep = pa.array(out, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(i).filter(keep) for i in (0, 1)], names=["a", "b"])

    return pairs.select("a", "b", "ta", "tb").mapInArrow(run, "a long, b long")


def classes_and_links(df: DataFrame, id_col: str = "rec_no", text_col: str = "extracted_text", similarity: float = SIMILARITY) -> tuple[DataFrame, DataFrame]:
    """Membership ``rep, rec`` (texts equal after normalisation share ``rep``, the lowest id) and links ``a, b`` between representatives.

    Copies are collapsed before the search, so a text that a third of all rows repeat is one entry of the index.
    Null texts and texts under ``MIN_CHARS`` normalised characters are in neither table.
    """
    texts = df.select(df[id_col].cast("long").alias("rec"), df[text_col].alias("text"))
    signed = written(_signed(texts), "neardup-signed")
    reps = signed.groupBy("digest").agg(F.min("rec").alias("rep"))
    members = signed.select("rec", "digest").join(reps, "digest").select("rep", "rec")
    classes = signed.join(reps.select(F.col("rep").alias("rec")), "rec", "left_semi").select(F.col("rec").alias("rep"), "symbols")
    keys = _keys(classes)
    x, y = keys.alias("x"), keys.alias("y")
    candidates = x.join(y, F.col("x.key") == F.col("y.key")).where(F.col("x.rep") < F.col("y.rep")).select(F.col("x.rep").alias("a"), F.col("y.rep").alias("b")).distinct()
    symbols = signed.select("rec", "symbols")
    near = candidates.join(symbols.select(F.col("rec").alias("a"), F.col("symbols").alias("sa")), "a").join(symbols.select(F.col("rec").alias("b"), F.col("symbols").alias("sb")), "b")
    near = written(_agreeing(near), "neardup-near")
    small = broadcast_if_small(near)
    left = texts.join(small, F.col("rec") == F.col("a")).select("a", "b", F.col("text").alias("ta"))
    right = texts.join(broadcast_if_small(near.select(F.col("b").alias("rec")).distinct()), "rec", "left_semi").select(F.col("rec").alias("b"), F.col("text").alias("tb"))
    return members, written(_verified(left.join(right, "b"), similarity), "neardup-links")


def pairs(df: DataFrame, id_col: str = "rec_no", text_col: str = "extracted_text", similarity: float = SIMILARITY) -> DataFrame:
    """p2: ``rec_a, rec_b`` (``rec_a < rec_b``) of all rows whose window sets have at least ``similarity`` in common.

    The result is defined on pairs of rows, so copies are expanded here, and only here. A repeated id has no pair
    with itself; empty tables give an empty result; other columns are not read.
    """
    members, links = classes_and_links(df, id_col, text_col, similarity)
    of = lambda name, to: members.select(F.col("rep").alias(name), F.col("rec").alias(to))
    between = links.join(of("a", "x"), "a").join(of("b", "y"), "b").select("x", "y")
    within = of("r", "x").join(of("r", "y"), "r").where(F.col("x") < F.col("y")).select("x", "y")
    both = between.unionByName(within)
    return both.select(F.least("x", "y").alias("rec_a"), F.greatest("x", "y").alias("rec_b")).where("rec_a < rec_b")


def components(df: DataFrame, id_col: str = "rec_no", text_col: str = "extracted_text") -> DataFrame:
    """``rec, rep, links``: one row per text that is long enough, with its class and the number of links of the class."""
    members, links = classes_and_links(df, id_col, text_col)
    ends = links.select(F.explode(F.array("a", "b")).alias("rep")).groupBy("rep").count().withColumnRenamed("count", "links")
    return members.join(ends, "rep", "left").select("rec", "rep", F.coalesce("links", F.lit(0)).alias("links"))
