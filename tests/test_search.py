"""Searches over whole tables against brute force."""

import numpy as np

from strandline.operators import grounding as G
from strandline.plans.catalogue import QUERIES


def brute(spark, small, k, penalty=False):
    rows = spark.read.parquet(f"{small}/embeddings.parquet").orderBy("vec_id").collect()
    x = np.array([r.embedding for r in rows], dtype=np.float64)
    ids = [r.vec_id for r in rows]
    scores = x @ x.T
    if penalty:
        at = {v: i for i, v in enumerate(ids)}
        for j, v in enumerate(ids):
            if v + 40 in at:
                near = x @ x[at[v + 40]] > 0.5
                scores[near, j] = np.maximum(-1.0, scores[near, j] - 0.2)
    scores = np.round(scores, 6)
    names = [f"n{v:03d}" for v in ids]
    best = {v: sorted(((-scores[i, j], names[j]) for j in range(len(ids)) if j != i))[:k] for i, v in enumerate(ids)}
    return rows, {v: [(n, -s) for s, n in b] for v, b in best.items()}


def same(got, want):
    return set(got) == set(want) and all([n for n, _ in got[v]] == [n for n, _ in want[v]] and np.allclose([s for _, s in got[v]], [s for _, s in want[v]], atol=2e-6) for v in want)


def lists(df, order):
    out = {}
    for r in df.orderBy("vec_id", *order).collect():
        out.setdefault(r.vec_id, []).append((r.node, r.score))
    return out


def test_the_stated_queries_are_searched_among_all_others(spark, small):
    rows, want = brute(spark, small, 10)
    want = {v: b for v, b in want.items() if v % 100 == 0}
    assert len(rows) > 40
    got = lists(QUERIES["vec_dot_topk"](spark, small), ["rank"])
    assert same(got, want) and max(int(n[1:]) for b in got.values() for n, _ in b) >= 40
    sliced = {v: [(n, s) for n, s in b[:3] if s >= 0.2] for v, b in want.items()}
    got = {v: sorted(b, key=lambda p: (-p[1], p[0])) for v, b in lists(QUERIES["vec_threshold_slice"](spark, small), []).items()}
    assert same(got, {v: b for v, b in sliced.items() if b})
    best = {r.vec_id: r.relevance for r in QUERIES["relevance_top1"](spark, small).collect()}
    assert set(best) == set(want) and all(abs(best[v] - (b[0][1] if b[0][1] > 0.3 else 0)) < 2e-6 for v, b in want.items())
    label = {r.vec_id: r.label for r in rows}
    first = {v: next((i + 1 for i, (n, _) in enumerate(b[:5]) if label[int(n[1:])] == label[v]), None) for v, b in want.items()}
    for r in QUERIES["mrr_eval"](spark, small).collect():
        of = [1 / first[v] if first[v] else 0 for v in want if label[v] == r.label]
        assert (r.n, r.mrr) == (len(of), round(sum(of) / len(of), 6))


def test_penalty_among_all_others(spark, small):
    want = {v: b for v, b in brute(spark, small, 5, penalty=True)[1].items() if v % 100 == 0}
    got = {v: sorted(b, key=lambda p: (-p[1], p[0])) for v, b in lists(QUERIES["vec_neg_penalty"](spark, small), []).items()}
    assert same(got, want)


def test_blocks_give_the_same_result(spark, small):
    e = spark.read.parquet(f"{small}/embeddings.parquet")
    nodes = e.selectExpr("format_string('n%03d', vec_id) AS node", "embedding AS node_vec")
    one, many = (sorted(map(tuple, G.search(e, nodes, 4, "vec_id", "embedding", block=b).collect())) for b in (10**6, 70))
    assert one == many and len(one) == 4 * e.count()


def test_every_node_is_mapped(spark, small):
    rows = spark.read.parquet(f"{small}/embeddings.parquet").collect()
    vec = {r.vec_id: np.array(r.embedding, dtype=np.float64) for r in rows}
    right = [r.vec_id for r in rows if r.label % 2 == 0]
    want = {}
    for r in rows:
        if r.label % 2:
            scored = [(-round(0.9 * (vec[r.vec_id] @ vec[b]) + 0.1 * (vec[r.vec_id // 10] @ vec[b // 10]) / 2, 6), f"n{b:03d}") for b in right]
            want[f"n{r.vec_id:03d}"] = [(n, -s) for s, n in sorted(scored)[:3]]
    got = {}
    for r in QUERIES["ontology_pairwise_map"](spark, small).collect():
        got.setdefault(r.id, []).append((r.node, r.score))
    assert same({v: sorted(b, key=lambda p: (-p[1], p[0])) for v, b in got.items()}, want)


def test_k_zero_maps_to_all_nodes(spark):
    nodes = lambda *v: spark.createDataFrame([(f"n{i}", list(x), [list(x)]) for i, x in enumerate(v)], "node string, vec array<double>, parents array<array<double>>")
    got = {(r.id, r.node): r.score for r in G.map_nodes(nodes((1.0, 0.0)), nodes((1.0, 0.0), (0.0, 1.0), (0.6, 0.8)), 0).collect()}
    assert got == {("n0", "n0"): 0.9, ("n0", "n1"): 0.0, ("n0", "n2"): 0.54}


def test_the_last_stage_blends_vectors_and_examples(spark):
    nodes = spark.createDataFrame([("a/rain", ["heavy rain"], ["^xx$"], [1.0, 0.0]), ("a/wind", ["wind"], [], [0.0, 1.0])], "node string, examples array<string>, patterns array<string>, node_vec array<double>")
    rows = spark.createDataFrame([(1, "wind", [1.0, 0.0]), (2, "winds", [1.0, 0.0]), (3, "winds", None)], "id int, name string, vec array<double>")
    got = {(r.id, r.node): (r.score, r.stage) for r in G.sieve(rows, nodes, 2, vector="vec").collect()}
    assert got[1, "a/wind"] == (1.0, 1) and got[2, "a/wind"] == (0.2, 3) and got[2, "a/rain"] == (0.75, 3) and got[3, "a/wind"] == (0.2, 3)
