import random

import pytest
from pyspark.sql import functions as F

from strandline.functions import scores as S
from strandline.functions import text as X
from strandline.operators import analytics as A
from strandline.operators import attachments as T
from strandline.operators import grounding as G
from strandline.operators import mentions as M
from strandline.sources import documents as D
from strandline.sources.jsonld import corpus_documents, read_extractions
from strandline.sources.ontology import nodes_of


@pytest.mark.parametrize("a,b,want", [("cat", "cars", 2), ("kitten", "sitting", 3), ("Sunday", "Saturday", 3), ("mom", "Mom", 1), ("", "ab", 2)])
def test_edit_distance(a, b, want):
    assert X.edit_distance(a, b) == want == G._Distance(a).to(b)


def test_edit_distance_flags():
    assert X.edit_distance("meter", "metre", transpose=True) == 1 and X.edit_distance("mom", "Mom", free_case=True) == 0 and X.edit_distance("ab", "cd", substitute=False) == 4


@pytest.mark.parametrize("text,want", [("(a)", True), ("(a", False), ("[(])", True), (")(", False), ("{<>}", True), ("", True)])
def test_brackets(text, want):
    assert X.matching_brackets(text) is want


def test_scores(spark):
    r = spark.sql("SELECT array(0.5D, 0.5D) AS v, cast(array() AS array<double>) AS none").select(S.noisy_or(F.col("v")).alias("v"), S.noisy_or(F.col("none")).alias("n"), S.example_similarity(F.lit("Trade"), F.lit("trade")).alias("e")).first()
    assert abs(r.v - (1 - 0.51**2)) < 1e-12 and r.n == 0 and r.e == 1


@pytest.mark.parametrize("text,want", [("rain causes flooding", False), ("rain does not cause flooding", True), ("rain does not not cause it", False), ("not not not", True), ("is poor", True), ("", False)])
def test_negation_parity(spark, text, want):
    df = spark.createDataFrame([(text,)], "t string")
    assert df.select(M.negated(X.words(F.col("t")), ["not"], [("is", "poor")])).first()[0] is want


def test_gazetteer_keeps_the_longest_leftmost(spark):
    lex = spark.createDataFrame([("fuel shortage", "E"), ("local fuel shortage", "E"), ("shortage", "E"), ("shortage of food", "E"), ("food", "F")], "phrase string, label string")
    df = spark.createDataFrame([(1, "a local fuel shortage of food"), (2, None), (3, "")], "id int, t string")
    got = {tuple(r) for r in M.gazetteer(df, ["id"], X.words(F.col("t")), lex).collect()}
    assert got == {(1, "E", 1, 4, "local fuel shortage"), (1, "F", 5, 6, "food")}


def test_keep_longest_breaks_ties(spark):
    df = spark.createDataFrame([(1, "k", 0, 5), (2, "k", 0, 5), (3, "k", 1, 3), (4, "k", 4, 9), (5, None, 0, 1)], "id int, k string, start int, stop int")
    assert {r.id for r in M.keep_longest(df, ["k"]).collect()} == {1, 4, 5}


def test_nearest_before(spark):
    rows = spark.createDataFrame([(1, "u", 10), (2, "u", 3), (3, "v", 5), (4, "u", 4)], "id int, u string, at int")
    ref = spark.createDataFrame([("u", 4), ("u", 9), ("u", 9), ("v", 6)], "u string, ref_at int")
    assert {r.id: r.ref_at for r in M.nearest_before(rows, ref, ["u"], "at").collect()} == {1: 9, 2: None, 3: None, 4: 4}


def test_coreference_links_to_the_event_that_ends_last(spark):
    df = spark.createDataFrame([("d", 0, 1, "rain causes flooding", 5), ("d", 0, 2, "it rose", 9), ("d", 1, 3, "This causes problems", 3), ("d", 3, 4, "This stays", 3)], "doc string, sent int, id int, text string, stop int")
    assert [tuple(r) for r in M.coreference(df, "doc", "sent", "text", ["this", "that", "these", "those"]).collect()] == [("d", 3, 2)]


def test_chains_and_reach(spark):
    causes = spark.createDataFrame([("s", 2, 4)], "s string, id int, token int")
    effects = spark.createDataFrame([("s", 1, 3, 6), ("s", 2, 3, 6)], "s string, effect_id int, start int, stop int")
    assert [tuple(r) for r in M.chained(causes, effects, ["s"]).collect()] == [("s", 2, 1)]
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 1)], "mention_id int, argument_id int")
    assert {tuple(r) for r in M.reachable(edges, spark.createDataFrame([(1,)], "mention_id int")).collect()} == {(1, 1), (1, 2), (1, 3)}


def test_attachments(spark):
    df = spark.createDataFrame(
        [("m", [("QUANT", "very", ["b", "a"]), ("INC", "increased", [])]), ("m", [("QUANT", "very", ["a", "b"]), ("INC", "increase", ["much"]), ("QUANT", "very", [])]), ("n", None)],
        "m string, a array<struct<type:string,trigger:string,quantifiers:array<string>>>",
    )
    merged = T.merged(df, ["m"], "a")
    got = {r.m: [tuple(x) for x in r.a] for r in merged.collect()}
    assert got["n"] == [] and len(got["m"]) == 4
    r = merged.where("m = 'm'").select(T.most_quantified(T.without_substrings(F.col("a"))).alias("a"), T.polarity_string(F.col("a")).alias("p"), T.modifier_string(F.col("a")).alias("q")).first()
    assert {(x["type"], x["trigger"]) for x in r.a} == {("INC", "increased"), ("QUANT", "very")}
    assert r.p == "Increase(increase), Increase(increased)" and r.q == "Quant(very), Quant(very)"


def test_grounding_sieve(spark):
    rows = spark.createDataFrame([(1, "Crop Failure"), (2, "flood of 2012"), (3, "hungr"), (4, None)], "id int, name string")
    nodes = spark.createDataFrame([("top/a/crop_failure", ["x"], []), ("top/a/flooding", ["deluge"], ["flood"]), ("top/b/", ["hunger"], [])], "node string, examples array<string>, patterns array<string>")
    assert {(r.id, r.node, r.stage) for r in G.sieve(rows, nodes, 1).collect()} == {(1, "top/a/crop_failure", 1), (2, "top/a/flooding", 2), (3, "top/b/", 3)}


def test_best_examples_equals_brute_force(spark):
    random.seed(5)
    word = lambda: "".join(random.choices("abcde ", k=random.randint(1, 9)))
    nodes = [(f"n{i:02d}", [word() for _ in range(3)]) for i in range(20)]
    names = sorted({word() for _ in range(30)})
    got = G.by_examples(spark.createDataFrame([(n,) for n in names], "name string"), spark.createDataFrame(nodes, "node string, examples array<string>"), 3, "name", "name")
    sim = lambda a, b: round(1 - X.edit_distance(a, b) / max(len(a), len(b), 1), 6)
    want = {(a, n, s) for a in names for s, n in [(-x, n) for x, n in sorted((-max(sim(a, e) for e in es), n) for n, es in nodes)[:3]]}
    assert {(r.id, r.node, r.score) for r in got.collect()} == want


def test_top_k_ties_and_nulls(spark):
    rows = spark.createDataFrame([(1, [1.0, 0.0]), (2, None)], "id int, vec array<double>")
    nodes = spark.createDataFrame([("b", [1.0, 0.0], None), ("a", [1.0, 0.0], None), ("c", [1.0, 0.0], [1.0, 0.0])], "node string, node_vec array<double>, node_neg array<double>")
    assert [(r.node, r.score, r.rank) for r in G.top_k(rows, nodes, 3).orderBy("rank").collect()] == [("a", 1.0, 1), ("b", 1.0, 2), ("c", 0.8, 3)]
    assert G.top_k(rows, nodes.limit(0), 3).count() == 0


def test_numbered_is_one_to_n_whatever_the_partitions(spark):
    df = spark.range(1000).selectExpr("id", "id % 7 AS k")
    for parts in (1, 5):
        got = {r.id: r.n for r in A.numbered(df.repartition(parts), ["k", "id"], "n").collect()}
        want = {x: i + 1 for i, x in enumerate(sorted(range(1000), key=lambda v: (v % 7, v)))}
        assert got == want
    assert A.numbered(df.limit(0), ["k", "id"], "n").count() == 0


def test_json_ld_round_trip(spark, small):
    docs, e = spark.read.parquet(f"{small}/cdr.parquet"), spark.read.parquet(f"{small}/extractions.parquet")
    back = read_extractions(corpus_documents(docs, e))
    cols = ["extraction_id", "document_id", "extraction_type", "subtype", "mention_text", "rule_name", "canonical_name", "relevance"]
    want = e.where("document_id IS NOT NULL").select(*cols)
    assert want.exceptAll(back.select(*cols)).count() == 0 and back.select(*cols).exceptAll(want).count() == 0


def test_sources(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"_source": {"document_id": "x", "extracted_text": "t", "uri": "u", "extracted_metadata": {"Title": "T", "ModDate": "soon", "CreationDate": "1282271910"}}}')
    r = D.read_cdr(spark, str(tmp_path / "a.json")).first()
    assert (r.doc_id, r.title, str(r.dct_start), str(r.dct_end)) == ("x", "T", "2010-08-20", "2010-08-21")
    (tmp_path / "b.txt").write_text("one\ntwo")
    assert D.read_text(spark, str(tmp_path), date="2015-01-01").first().text == "one\ntwo"
    info = spark.createDataFrame([("Title:  x\nModDate: 2015-01-01T00:00:00Z",)], "t string").select(D.pdfinfo(F.col("t"))).first()[0]
    assert info == {"Title": "x", "ModDate": "2015-01-01T00:00:00Z"}
    (tmp_path / "c.tsv").write_text("a\\tb\tc\nd\n")
    assert [tuple(r) for r in D.read_tsv(spark, str(tmp_path / "c.tsv"), ["x", "y"]).collect()] == [("a\tb", "c"), ("d", None)]
    ids = spark.createDataFrame([("n.htm", "2"), ("n.html", "1"), ("m.pdf", "3")], "file_name string, _id string")
    assert {r.name: r._id for r in D.with_ids(spark.createDataFrame([("d/n.txt",), ("m.txt",), ("q",)], "name string"), ids).collect()} == {"d/n.txt": "1", "m.txt": "3", "q": None}
    tree = spark.createDataFrame([(1, '{"a": [{"MT": {"N": "title", "V": "T"}}, {"MT": {"N": "CreationDate", "V": "D:20150102030405"}}]}'), (2, "bad")], "i int, j string")
    assert {r.doc_id: (r.title, str(r.day)) for r in D.tree_metadata(tree, "i", "j").collect()} == {"1": ("T", "2015-01-02"), "2": (None, "None")}


def test_ontology_dialects():
    classic = [{"top": [{"concept": [{"name": "a/b", "examples": ["x"], "pattern": "p.*", "polarity": -1}, "leaf"]}]}]
    rows = {r[0]: r for r in nodes_of(classic)}
    assert set(rows) == {"top/", "top/concept/", "top/concept/a\\/b", "top/concept/leaf"} and rows["top/concept/a\\/b"][4] == -1.0 and rows["top/concept/a\\/b"][7] == ["p.*"]
    tree = [{"node": {"name": "top", "children": [{"node": {"name": "x", "examples": ["e"], "descriptions": ["d"]}}]}}]
    assert {r[0]: r[5] for r in nodes_of(tree)} == {"top/": ["top"], "top/x": ["e", "d"]}


def test_text_functions(spark):
    df = spark.createDataFrame([("ﬁne  ½",)], "t string").select(X.nfkc_with_offsets(F.col("t")).alias("n")).first().n
    assert df.text == "fine  1⁄2" and df.starts[:2] == [0, 0] and df.ends[:2] == [1, 1]
    r = spark.createDataFrame([("a/b+3.jsonld", "at least 5", "~1,200%", r"x\\n\n")], "f string, q string, n string, e string").select(X.file_parts(F.col("f")).alias("p"), X.quantity_class(F.col("q")).alias("q"), X.to_number(F.col("n")).alias("n"), X.unescape_tsv(F.col("e")).alias("e")).first()
    assert tuple(r.p) == ("b", 3, "jsonld") and r.q == "minimum" and r.n == 1200.0 and r.e == "x\\n\n"


def test_exchange_reads_once(spark, small):
    from strandline.streaming.exchange import read_once_counts

    n = spark.read.parquet(f"{small}/notices.parquet").selectExpr("lower(regexp_replace(document_id, '[-\\\\s]', '')) AS d", "explode_outer(ontologies) AS o").where("d IS NOT NULL")
    r = read_once_counts(spark, small).first()
    assert (r.documents, r.pairs) == (n.select("d").distinct().count(), n.where("o IS NOT NULL").distinct().count())
