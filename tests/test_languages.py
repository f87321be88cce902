"""Irregular and missing language tags."""

import pytest

from strandline.functions import text as X
from strandline.plans.catalogue import QUERIES

ROWS = [
    (1, "Drought caused crop failure because of the heat. No harvest could begin.", "en"), (2, "Drought caused crop failure because of the heat. No harvest could begin.", "EN"),
    (3, "Drought caused crop failure because of the heat. No harvest could begin.", " en-XX"), (4, "The failure of the harvest is known to the council.", None),
    (5, "Der Ausfall der Ernte ist dem Rat bekannt.", None), (6, "The heat of it", "fr"), (7, None, None), (8, "", "en"), (9, "Le conseil to", "FR-x"),
]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("languages"))
    spark.createDataFrame(ROWS, "doc_id long, text string, lang string").selectExpr("*", "timestamp'2018-05-01 00:00:00' AS published_at").write.parquet(f"{path}/documents.parquet")
    return path


def test_english(spark, folder):
    assert sorted(r.doc_id for r in X.english(spark.read.parquet(f"{folder}/documents.parquet")).collect()) == [1, 2, 3, 4, 8]


def test_english_queries_take_irregular_tags(spark, folder):
    run = lambda name: QUERIES[name](spark, folder).collect()
    assert {r.doc_id for r in run("causal_edges")} == {1, 2, 3}
    assert {r.n_docs for r in run("causal_graph")} == {3}
    assert {r.doc_id for r in run("gazetteer_longest_match")} == {1, 2, 3, 4}
    assert {r.doc_id: r.negated for r in run("negation_parity")} == {1: 1, 2: 1, 3: 1, 4: 0}
    assert [(r.hint, r.n, r.n_docs) for r in run("hedging_scan")] == [("could", 3, 3)]
    assert [(r.text, r.n) for r in run("rule_mentions")] == [("because of", 3)]


def test_counts_cover_all_languages(spark, folder):
    run = lambda name: QUERIES[name](spark, folder).collect()
    n = {(r.lang, r.word): r.n for r in run("token_counts_by_lang")}
    assert (n["en", "drought"], n["und", "der"], n["fr", "conseil"], n["fr", "heat"]) == (3, 2, 1, 1)
    assert {(r.lang, r.kind): r.n for r in run("trigger_regex_classify")}["en", "cause"] == 6
    assert {(r.lang, r.a, r.b): r.n for r in run("token_pattern_bigram")} == {("en", "because", "of"): 3, ("und", "failure", "of"): 1, ("und", "known", "to"): 1, ("fr", "heat", "of"): 1, ("fr", "conseil", "to"): 1}
