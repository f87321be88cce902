"""Ranking the nodes of a vocabulary for a concept: exact, pattern and vector similarity in a sieve."""

from __future__ import annotations

import heapq
import math
import re
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandline.functions.scores import combined
from strandline.session import broadcast_if_small

#: Nodes (or examples, or patterns) up to which a vocabulary is sent to all workers: it is a dimension, its size is checked.
MAX_NODES = 200_000
#: Nodes of a block of a searched table, and rows that are compared with it at a time.
BLOCK, ROWS = 20_000, 1_000


def _vocabulary(nodes: DataFrame, *columns: str):
    """The vocabulary as a broadcast list: refused beyond ``MAX_NODES`` instead of growing with the data."""
    rows = [tuple(r) for r in nodes.select(*columns).orderBy("node").limit(MAX_NODES + 1).collect()]
    if len(rows) > MAX_NODES:
        raise ValueError(f"the vocabulary has more than {MAX_NODES} nodes: block it by branch first")
    return nodes.sparkSession.sparkContext.broadcast(rows)


def _compared(rows: DataFrame, id_col: str, column: str, score, kind: str) -> DataFrame:
    """``id, node, score`` for the pairs that ``score(values) -> [(row, node, score)]`` gives: one narrow stage, no join."""

    def run(batches):
        for batch in batches:
            ids, values = batch.column(0), batch.column(1).to_pylist()
            found = score(values)
            yield pa.RecordBatch.from_arrays([ids.take(pa.array([f[0] for f in found], pa.int64())), pa.array([f[1] for f in found], pa.string()), pa.array([f[2] for f in found], pa.float64())], names=["id", "node", "score"])

    return rows.select(F.col(id_col).alias("id"), F.col(column)).mapInArrow(run, f"id {kind}, node string, score double")


def top_k(rows: DataFrame, nodes: DataFrame, k: int, id_col: str = "id", vector: str = "vec", least: float | None = None, round_to: int = 6) -> DataFrame:
    """``id, node, score, rank``: the ``k`` nodes (``node, node_vec[, node_neg]``) with the highest dot product.

    Each batch of rows is multiplied with the matrix of the vocabulary (of checked size) and cut to ``k`` in place: no
    join and no shuffle. Scores are rounded before ranking, ties by node; ``least`` leaves out lower scores; null
    vectors have no nodes.
    """
    negative = "node_neg" in nodes.columns
    shared = _vocabulary(nodes, "node", "node_vec", *(["node_neg"] if negative else []))
    kind = rows.schema[id_col].dataType.simpleString()

    def run(batches):
        table = shared.value
        names = [t[0] for t in table]
        matrix = np.array([t[1] for t in table], dtype=np.float64)
        against = [i for i, t in enumerate(table) if negative and t[2] is not None]
        minus = np.array([table[i][2] for i in against], dtype=np.float64)
        for batch in batches:
            present = [i for i, v in enumerate(batch.column(1).to_pylist()) if v is not None]
            out: list[tuple] = []
            for keep in (present[i : i + ROWS] for i in range(0, len(present) if names else 0, ROWS)):
                x = np.array([batch.column(1)[i].as_py() for i in keep], dtype=np.float64)
                scores = x @ matrix.T
                if against:
                    close = x @ minus.T > 0.5
                    lowered = np.maximum(-1.0, scores[:, against] - 0.2)
                    scores[:, against] = np.where(close, lowered, scores[:, against])
                scores = np.round(scores, round_to)
                order = _best_columns(scores, k)
                for row, best in enumerate(order):
                    rank = 0
                    for j in best:
                        if least is None or scores[row, j] >= least:
                            rank += 1
                            out.append((keep[row], names[j], float(scores[row, j]), rank))
            ids = batch.column(0).take(pa.array([o[0] for o in out], pa.int64()))
            yield pa.RecordBatch.from_arrays([ids, pa.array([o[1] for o in out], pa.string()), pa.array([o[2] for o in out], pa.float64()), pa.array([o[3] for o in out], pa.int32())], names=["id", "node", "score", "rank"])

    return rows.select(F.col(id_col).alias("id"), F.col(vector)).mapInArrow(run, f"id {kind}, node string, score double, rank int")


def _best_columns(scores: np.ndarray, k: int) -> np.ndarray:
    """The ``k`` best columns of each row, best first, ties in order; only the columns that can be among them are sorted."""
    if k * 4 >= scores.shape[1]:
        return np.argsort(-scores, axis=1, kind="stable")[:, :k]
    edge = -np.partition(-scores, k - 1, axis=1)[:, k - 1]
    out = np.empty((len(scores), k), dtype=np.int64)
    for row, least in enumerate(edge):
        some = np.flatnonzero(scores[row] >= least)
        out[row] = some[np.argsort(-scores[row, some], kind="stable")[:k]]
    return out


def search(rows: DataFrame, corpus: DataFrame, k: int, id_col: str = "id", vector: str = "vec", least: float | None = None, own: Column | None = None, block: int = BLOCK) -> DataFrame:
    """``id, node, score, rank`` as :func:`top_k` for a corpus of any size: its blocks are ranked one by one, the best of all merged.

    ``own`` (of ``id``) is the node that a row itself is; it is left out of the row's result.
    """
    n = max(1, math.ceil(corpus.count() / block))
    k_block = k if own is None else k + 1
    parts = [top_k(rows, corpus.where(F.pmod(F.xxhash64("node"), F.lit(n)) == i), k_block, id_col, vector, least) for i in range(n)]
    found = reduce(DataFrame.unionByName, parts)
    if own is not None:
        found = found.where(F.col("node") != own)
    rank = F.row_number().over(Window.partitionBy("id").orderBy(F.desc("score"), "node"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)


def exact(rows: DataFrame, nodes: DataFrame, id_col: str = "id", name: str = "name") -> DataFrame:
    """``id, node, score``: nodes whose canonical name (last part of the path, ``_`` as blank) is the row's name."""
    names = nodes.select("node", F.lower(F.replace(F.regexp_extract("node", r"([^/]+)/?$", 1), F.lit("_"), F.lit(" "))).alias("__name"))
    return rows.join(broadcast_if_small(names), F.lower(F.col(name)) == F.col("__name")).select(F.col(id_col).alias("id"), "node", F.lit(1.0).alias("score"))


def by_pattern(rows: DataFrame, nodes: DataFrame, id_col: str = "id", text: str = "name") -> DataFrame:
    """``id, node, score``: nodes one of whose ``patterns`` occurs in the row's text, case aside."""
    shared = _vocabulary(nodes.where(F.size("patterns") > 0), "node", "patterns")

    def score(values):
        table = [(n, [re.compile(p, re.I) for p in ps]) for n, ps in shared.value]
        return [(i, n, 1.0) for i, v in enumerate(values) if v for n, ps in table if any(p.search(v) for p in ps)]

    return _compared(rows, id_col, text, score, rows.schema[id_col].dataType.simpleString())


class _Distance:
    """Edit distance of one text to many, bit-parallel: a column of the table is one integer."""

    def __init__(self, text: str):
        self.size, self.full = len(text), (1 << len(text)) - 1
        self.at: dict[str, int] = {}
        for i, c in enumerate(text):
            self.at[c] = self.at.get(c, 0) | 1 << i

    def to(self, other: str) -> int:
        if not self.size:
            return len(other)
        up, down, score, top = self.full, 0, self.size, 1 << (self.size - 1)
        for c in other:
            eq = self.at.get(c, 0)
            diagonal = (((eq & up) + up) ^ up) | eq | down
            right_up, right_down = down | ~(diagonal | up) & self.full, up & diagonal
            score += bool(right_up & top) - bool(right_down & top)
            right_up = (right_up << 1 | 1) & self.full
            right_down = right_down << 1 & self.full
            up, down = right_down | ~(diagonal | right_up) & self.full, right_up & diagonal
        return score


def by_examples(rows: DataFrame, nodes: DataFrame, k: int, id_col: str = "id", text: str = "name") -> DataFrame:
    """``id, node, score``: the ``k`` nodes with an example most similar to the row's text (ties by node)."""
    shared = _vocabulary(nodes.where(F.size("examples") > 0), "node", "examples")

    def score(values):
        flat = [(n, e.lower()) for n, es in shared.value for e in es]
        letters = {c: i for i, c in enumerate(sorted({c for _, e in flat for c in e}))}
        sizes = np.array([len(e) for _, e in flat])
        bags = np.zeros((len(flat), len(letters)), dtype=np.int32)
        for i, (_, e) in enumerate(flat):
            for c in e:
                bags[i, letters[c]] += 1
        memo: dict = {}
        out = []
        for i, v in enumerate(values):
            if v is None or not flat:
                continue
            if v not in memo:
                memo[v] = _best_examples(v.lower(), flat, letters, sizes, bags, k)
            out += [(i, n, s) for n, s in memo[v]]
        return out

    return _compared(rows, id_col, text, score, rows.schema[id_col].dataType.simpleString())


def _best_examples(a: str, flat: list, letters: dict, sizes, bags, k: int) -> list[tuple[str, float]]:
    """The ``k`` best nodes for a text. Letters not shared bound the distance from below, so most examples need no table."""
    bag = np.zeros(len(letters), dtype=np.int32)
    for c in a:
        if c in letters:
            bag[letters[c]] += 1
    longest = np.maximum(np.maximum(sizes, len(a)), 1)
    bound = np.round(1 - (longest - np.minimum(bags, bag).sum(axis=1)) / longest, 6) + 1e-9
    to = _Distance(a).to
    best: dict[str, float] = {}
    least = -1.0
    for j in np.argsort(-bound, kind="stable"):
        if len(best) >= k and bound[j] < least:
            break
        node, example = flat[j]
        s = round(1 - to(example) / int(longest[j]), 6)
        if s > best.get(node, -1.0):
            best[node] = s
            if len(best) >= k:
                least = heapq.nlargest(k, best.values())[-1]
    return [(n, -s) for s, n in heapq.nsmallest(k, [(-s, n) for n, s in best.items()])]


def sieve(rows: DataFrame, nodes: DataFrame, k: int, id_col: str = "id", text: str = "name", least: float = 0.0, vector: str | None = None, weight: float = 0.75) -> DataFrame:
    """``id, node, score, stage, rank``: exact names, else patterns, else similarity; a later stage only where the earlier found none.

    The last stage is the weighted mean of vector and example similarity where ``rows`` have a ``vector`` column (and
    ``nodes`` a ``node_vec``), else example similarity alone.
    """
    first = exact(rows, nodes, id_col, text)
    left = rows.join(first.select(F.col("id").alias(id_col)).distinct(), id_col, "left_anti")
    second = by_pattern(left, nodes, id_col, text)
    left = left.join(second.select(F.col("id").alias(id_col)).distinct(), id_col, "left_anti")
    third = by_examples(left, nodes, k, id_col, text) if vector is None else blended(left, nodes, k, id_col, text, vector, weight)
    every = first.withColumn("stage", F.lit(1)).unionByName(second.withColumn("stage", F.lit(2))).unionByName(third.withColumn("stage", F.lit(3)))
    rank = F.row_number().over(Window.partitionBy("id").orderBy(F.desc("score"), "node"))
    return every.where(F.col("score") >= least).withColumn("rank", rank).where(F.col("rank") <= k)


def blended(rows: DataFrame, nodes: DataFrame, k: int, id_col: str, text: str, vector: str, weight: float = 0.75) -> DataFrame:
    """``id, node, score``: the ``k`` nodes with the best weighted mean of vector similarity and that of their best example.

    Both similarities of a row with all nodes exist in the task only; a missing vector, text or example counts as 0.
    """
    shared = _vocabulary(nodes, "node", "node_vec", "examples")
    kind = rows.schema[id_col].dataType.simpleString()

    def run(batches):
        table = shared.value
        names = [t[0] for t in table]
        width = max((len(t[1]) for t in table if t[1] is not None), default=0)
        matrix = np.array([t[1] if t[1] is not None else [0.0] * width for t in table], dtype=np.float64).reshape(len(table), width)
        examples = [[e.lower() for e in t[2] or []] for t in table]
        for batch in batches:
            out: list[tuple] = []
            for i, (name, vec) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())):
                score = weight * (matrix @ np.array(vec, dtype=np.float64)) if vec is not None else np.zeros(len(names))
                if name is not None:
                    a = name.lower()
                    to = _Distance(a).to
                    score = score + (1 - weight) * np.array([max((1 - to(e) / max(len(a), len(e), 1) for e in es), default=0.0) for es in examples])
                score = np.round(score, 6)
                out += [(i, names[j], float(score[j])) for j in np.argsort(-score, kind="stable")[:k]]
            ids = batch.column(0).take(pa.array([o[0] for o in out], pa.int64()))
            yield pa.RecordBatch.from_arrays([ids, pa.array([o[1] for o in out], pa.string()), pa.array([o[2] for o in out], pa.float64())], names=["id", "node", "score"])

    return rows.select(F.col(id_col).alias("id"), F.col(text), F.col(vector)).mapInArrow(run, f"id {kind}, node string, score double")


def blend(vectors: DataFrame, examples: DataFrame, weight: float = 0.75) -> DataFrame:
    """``id, node, score``: weighted mean of vector and example similarity; a missing one counts as 0."""
    both = vectors.withColumnRenamed("score", "v").join(examples.withColumnRenamed("score", "e"), ["id", "node"], "full_outer")
    return both.select("id", "node", F.round(combined(F.coalesce("v", F.lit(0.0)), F.coalesce("e", F.lit(0.0)), weight), 6).alias("score"))


def map_nodes(left: DataFrame, right: DataFrame, k: int, weights: tuple[float, float] = (0.8, 0.1), block: int = BLOCK) -> DataFrame:
    """``id, node, score``: the ``k`` nodes of another vocabulary for each node (``node, vec, parents array<vec>``); all of them for ``k = 0``.

    ``parents`` are the vectors of the names on the node's path, its own name first. Own similarity is counted
    ``weights[0]``, that of the i-th names on both paths ``weights[1] / (i + 1)``, from 0 on. Ties by node. The weighted sum is one product of the vectors laid end to end, so both sides may be of any size (:func:`search`).
    """
    depth = min(df.agg(F.max(F.size("parents"))).first()[0] or 0 for df in (left, right))

    def laid(df, own, up):
        parents = [F.coalesce(F.transform(F.get("parents", F.lit(i)), lambda x: x * F.lit(w)), F.transform("vec", lambda x: F.lit(0.0))) for i, w in enumerate(up)]
        return df.select("node", F.concat(F.transform("vec", lambda x: x * F.lit(own)), *parents).alias("node_vec"))

    ones = [1.0] * max(0, depth)
    weighted = laid(left, weights[0], [weights[1] / (i + 1) for i in range(len(ones))])
    return search(weighted, laid(right, 1.0, ones), k or 2**31 - 2, "node", "node_vec", block=block).select("id", "node", "score")
