"""Annotated corpora, dimensions and the reshaping of mentions on small fixtures."""

import json

import pytest
from pyspark.sql import functions as F

from strandline.functions import text as X
from strandline.operators import attachments as A
from strandline.operators import handler as H
from strandline.operators import reshape as R
from strandline.operators.rules import find_mentions
from strandline.sources import corpus as C
from strandline.sources import dimensions as D

ATT = C.ATTACHMENTS
MENTIONS = f"document_id string, sent_no int, mention_no int, label string, labels array<string>, start int, stop int, trigger_start int, trigger_stop int, text string, args array<struct<role:string,mention_no:int>>, found_by string, canonical_name string, relevance double, attachments {ATT}"


def token(word, tag="NN", entity="O", start=0, lemma=None, norm=None):
    return (word, tag, entity, start, start + len(word), lemma or word.lower(), None, norm)


@pytest.fixture(scope="module")
def tables(spark):
    docs = spark.createDataFrame([("d1", "T", "here", "2018-05-01", "2018-05-01", "2018-05-02"), ("d2", None, None, None, None, None)], "document_id string, title string, location string, dct_text string, dct_start string, dct_end string")
    docs = docs.withColumn("dct_start", F.to_date("dct_start")).withColumn("dct_end", F.to_date("dct_end"))
    tokens = [token("Rainfall", start=0), token("causes", "VBZ", start=9, lemma="cause"), token("flooding", start=16)]
    rows = [("d1", 0, "Rainfall causes flooding", 0.5, tokens, [(1, 0, "nsubj"), (1, 2, "dobj")]), ("d1", 501, "x", None, [token("x")], []), ("d2", 0, None, None, [], [])]
    sentences = spark.createDataFrame(rows, f"document_id string, sent_no int, text string, relevance double, tokens {C.TOKENS}, edges {C.EDGES}")
    m = [
        ("d1", 0, 1, "Concept", ["Concept", "Entity"], 0, 1, None, None, "Rainfall", [], "np", "rainfall", 0.25, [("INC", "more", ["much"]), ("HEDGE", "likely", [])]),
        ("d1", 0, 2, "Concept", ["Concept", "Entity"], 2, 3, None, None, "flooding", [], "np", "flooding", None, []),
        ("d1", 0, 3, "Causal", ["Causal", "Event"], 0, 3, 1, 2, "Rainfall causes flooding", [("cause", 1), ("effect", 2)], "r1++r2", None, None, []),
    ]
    return docs, sentences, spark.createDataFrame(m, MENTIONS)


def rows(df):
    return sorted(map(repr, df.collect()))


def test_corpus_round_trip(spark, tables):
    docs, sentences, mentions = tables
    objects = C.write_corpus(docs, sentences, mentions)
    assert sorted((r.document_id, r.part) for r in objects.collect()) == [("d1", 0), ("d1", 1), ("d2", 0)]
    one = json.loads(objects.where("document_id = 'd1' AND part = 0").first().json)
    event = next(x for x in one["extractions"] if x["type"] == "relation")
    assert event["subtype"] == "causal" and [a["type"] for a in event["arguments"]] == ["cause", "effect"] and event["arguments"][0]["value"]["@id"] == one["extractions"][0]["@id"]
    assert event["trigger"]["provenance"][0]["sentenceWordPositions"] == [{"@type": "Interval", "start": 2, "end": 2}]
    assert one["documents"][0]["sentences"][0]["dependencies"][1]["destination"]["@id"] == "_:Word_d1_0_2"
    d, s, m = C.read_corpus(objects.union(spark.createDataFrame([("x", 0, "{bad"), ("y", 0, None)], "document_id string, part int, json string")))
    assert rows(d) == rows(docs)
    assert rows(s.select(sentences.columns)) == rows(sentences)
    assert rows(m.select(mentions.columns)) == rows(mentions)
    assert C.write_corpus(docs.limit(0), sentences.limit(0), mentions.limit(0)).count() == 0


def test_rules_run_on_a_corpus_read_back(spark, tables):
    docs, sentences, mentions = tables
    _, s, _ = C.read_corpus(C.write_corpus(docs, sentences, mentions))
    specs = [
        {"name": "np", "label": "Concept", "priority": "1", "type": "token", "pattern": "[tag=NN]"},
        {"name": "causes", "label": "Causal", "priority": "2", "type": "dependency", "pattern": "trigger = [lemma=cause]\ncause: Concept = nsubj\neffect: Concept = dobj"},
    ]
    found = find_mentions(C.annotated(s), specs).where("label = 'Causal'").collect()
    assert [(r.sent_key, r.start, r.stop) for r in found] == [("d1:0", 0, 3)]


def test_a_rule_without_end_empties_its_sentence_only(spark):
    schema = "sent_key string, tokens array<struct<word:string>>, edges array<struct<src:int,dst:int,rel:string>>"
    df = spark.createDataFrame([("a", [("go",)], []), ("b", [("x",)], None), ("c", None, None)], schema)
    got = find_mentions(df, [{"name": "n", "label": "N", "priority": "1+", "type": "token", "pattern": "go"}]).collect()
    assert [r.sent_key for r in got] == ["a"]


def test_mentions_json(spark, tables):
    mentions = tables[2]
    objects = C.mentions_json(mentions.union(mentions.limit(2)))
    assert objects.count() == 3
    back = C.read_mentions_json(objects)
    assert rows(back.select("sent_no", "mention_no", "labels", "args", "attachments")) == rows(mentions.select("sent_no", "mention_no", "labels", "args", "attachments"))


def test_seasons(spark):
    modifiers, triggers, calendar = D.read_seasons(spark, "---\nearly: -1\nlate: 1\n---\ntriggers:\n  - belg\n  - gu\n---\n'337996':\n  belg: {start: 5, end: 8}\n  gu:\n    start: 10\n    end: 1\n")
    assert {tuple(r) for r in calendar.collect()} == {("337996", "belg", 5, 8), ("337996", "gu", 10, 1)}
    s = spark.createDataFrame([(1, 0, ["the", "Late", "belg", "rains", "gu"])], "doc_id int, sent_no int, words array<string>")
    assert {tuple(r) for r in D.season_triggers(s, modifiers, triggers).collect()} == {(1, 0, 2, "belg", 1), (1, 0, 4, "gu", 0)}


def test_small_tables(spark, tmp_path):
    (tmp_path / "idf.tsv").write_text("rain\t1.5\nbad\nrain\t1.0\n")
    assert [tuple(r) for r in D.read_weights(spark, str(tmp_path / "idf.tsv")).collect()] == [("rain", 1.5)]
    (tmp_path / "o.tsv").write_text("a,b, c\tx y, z\n\nd\n")
    assert {(r.node, tuple(r.examples)) for r in D.read_foreign_vocabulary(spark, str(tmp_path / "o.tsv")).collect()} == {("a/b/c", ("x y", "z")), ("d", ())}
    nodes = spark.createDataFrame([("a", 1)], "node string, n int")
    D.save_vocabulary(nodes, str(tmp_path / "v"), "abc", "2020-01-01")
    again, version, date = D.load_vocabulary(spark, str(tmp_path / "v"))
    assert rows(again) == rows(nodes) and (version, date) == ("abc", "2020-01-01")
    (tmp_path / "1.tsv").write_text("a\tb\n1\t2\n")
    (tmp_path / "2.tsv").write_text("b\ta\n3\t4\n")
    assert {tuple(r) for r in D.concatenated(spark, [str(tmp_path / "1.tsv"), str(tmp_path / "2.tsv")]).collect()} == {("1", "2"), ("4", "3")}
    many = spark.range(50)
    one, two = ([r.id for r in D.shuffled(many, seed, ["id"]).orderBy("idx").collect()] for seed in (1, 2))
    assert sorted(one) == sorted(two) == list(range(50)) and one != two
    j = spark.createDataFrame([('{"a": 1, "b": 2}',), ('{"a": null}',), ("x",), (None,)], "p string")
    assert {tuple(r) for r in D.metadata_keys(j, F.col("p")).collect()} == {("a", 2), ("b", 1)}
    assert [tuple(r) for r in D.odometer(spark, [1, 2], ["x", "y"]).collect()] == [(1, "x"), (1, "y"), (2, "x"), (2, "y")]


def test_gold_sheet(spark):
    entities = spark.createDataFrame([(1, "s", "rain"), (2, "s", "snow"), (3, "s", "flood")], "row_no int, sent_key string, entity string")
    sentences = spark.createDataFrame([("s", "rain and flood")], "sent_key string, text string")
    g = spark.createDataFrame([("rain", "wm/a", 0.4), ("rain", "wm/b", 0.9), ("rain", "who/c", 0.1), ("snow", "wm/a", 1.0)], "id string, node string, score double")
    found, rejected = D.gold_sheet(entities, sentences, g)
    assert {(r.row_no, r.start, r.branch, r.node) for r in found.collect()} == {(1, 0, "wm", "wm/b"), (1, 0, "who", "who/c")}
    assert {r.row_no for r in rejected.collect()} == {2, 3}


def test_sanitized(spark):
    df = spark.createDataFrame([("αβ café", ), ("plain ~",), ("a — b",), (None,), ("",)], "t string")
    assert [r[0] for r in df.select(X.sanitized(F.col("t"))).collect()] == ["alphabeta cafe", "plain ~", "a   b", None, ""]
    assert df.select(X.sanitized(F.col("t"), True)).first()[0] == "alphabeta café"


def test_document_text(spark):
    df = spark.createDataFrame([("One two.\nThree\ffour. Five", [8, 20, 25]), ("ab.cd", [3])], "t string, e array<int>")
    assert [r[0] for r in df.select(X.document_text(F.col("t"), F.col("e"))).collect()] == ["One two.\nThree four.\nFive", "ab.cd"]


def test_extract_number(spark):
    t = lambda w, e="O", n=None: (w, e, n)
    cases = [([t("about"), t("5", "NUMBER", "5.0"), t("%", "PERCENT", "x")], 0, 3), ([t("12", "NUMBER", "?")], 0, 1), ([t("ten", "NUMBER", "?"), t("x", "NUMBER")], 0, 2), ([t("a")], 0, 1), ([t("a"), t("7", "NUMBER", "7")], 0, 1)]
    df = spark.createDataFrame(cases, "tokens array<struct<word:string,entity:string,norm:string>>, a int, b int")
    got = [r[0] and tuple(r[0]) for r in df.select(X.extract_number(F.col("tokens"), F.col("a"), F.col("b"))).collect()]
    assert got == [(1, 3, 5.0), (0, 1, 12.0), None, None, None]


def test_attachments(spark):
    texts = ['{"type": "INC", "trigger": "rise", "quantifications": ["much"]}', '{"type": "TIMEX", "text": "in May", "start": "3"}', '{"type": "TIMEX", "text": "2018"}', '{"type": "INC"}', '{"type": "XX", "trigger": "a"}', "bad", '{"type": "SCORE", "value": 0.5}']
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").withColumn("a", A.from_json(F.col("t")))
    got = [(r.a and r.a.type, r.w) for r in df.select("i", "a", F.when(F.col("a").isNotNull(), A.words_of(F.col("a"))).alias("w")).orderBy("i").collect()]
    assert got == [("INC", ["rise", "much"]), ("TIMEX", ["in", "May"]), ("DCT", ["2018"]), (None, None), (None, None), (None, None), ("SCORE", [])]
    schema = f"doc_id int, mention_id int, attachments {ATT}"
    m = spark.createDataFrame([(1, 1, [("TIMEX", "May", [])]), (1, 2, [("INC", "rise", ["heavy", "odd"])]), (2, 3, [("QUANT", "Heavy", [])]), (1, 4, None)], schema)
    docs = spark.createDataFrame([(1, "2018-05-01"), (2, None)], "doc_id int, dct string")
    dct = {r.mention_id: [a.type for a in r.attachments or []] for r in A.with_document_time(m, docs).collect()}
    assert dct == {1: ["TIMEX"], 2: ["INC", "DCT"], 3: ["QUANT"], 4: ["DCT"]}
    adjectives = spark.createDataFrame([("heavy", 0.1, 0.2, 0.3)], "adjective string, mu double, sigma double, intercept double")
    q = {(r.mention_id, r.quantifier): r.delta for r in A.quantified(m, adjectives, 2.0, 3.0).collect()}
    assert set(q) == {(2, "heavy"), (2, "odd"), (3, "Heavy")} and q[2, "odd"] is None and q[2, "heavy"] == q[3, "Heavy"] == pytest.approx(2.718281828 ** (0.3 + 0.1 * 2 + 0.2 * 3) * 3.0, rel=1e-6)
    e = spark.createDataFrame([(1, [4, 5], ["May", "May"]), (2, [5], ["June"])], "event_no int, entities array<int>, time array<string>")
    assert {r.entity_no: [a.trigger for a in r.attachments] for r in A.with_context(e, "TIMEX", "time").collect()} == {4: ["May"], 5: ["June", "May"]}
    d = spark.createDataFrame([(1, "2018", None, "x", 0.1234567)], "doc_id int, dct string, title string, location string, relevance double")
    assert A.document_attachments(d).first().attachments == {"dct": "2018", "location": "x", "relevance": "0.12346"}


def test_hedges_and_negation_over_dependencies(spark):
    # Rainfall is likely to cause flooding
    tokens = [token("Rainfall"), token("is", "VBZ"), token("likely", "JJ"), token("to", "TO"), token("cause", "VB"), token("flooding"), token("not", "RB")]
    edges = [(2, 0, "nsubj"), (2, 1, "cop"), (2, 4, "xcomp"), (4, 3, "mark"), (4, 5, "dobj"), (2, 6, "neg")]
    s = spark.createDataFrame([("k", tokens, edges), ("none", tokens, None)], f"sent_key string, tokens {C.TOKENS}, edges {C.EDGES}")
    m = spark.createDataFrame([("k", 1, ["Causal", "Event"], 4, 6, 4, 5), ("k", 2, ["Concept"], 0, 1, None, None), ("none", 1, ["Event"], 4, 6, 4, 5)], "sent_key string, mention_no int, labels array<string>, start int, stop int, trigger_start int, trigger_stop int")
    assert {(r.sent_key, r.mention_no): r.hints for r in R.hedged(m, s, ["likely", "may"]).collect()} == {("k", 1): ["likely"], ("none", 1): []}
    assert {(r.sent_key): r.negations for r in R.negated_by_dependency(m, s).where("negations IS NOT NULL").collect()} == {"k": ["not"]}


def test_reshaped_mentions(spark):
    s = spark.createDataFrame([(1, 0, ["a", "b", "c"]), (1, 1, ["d", "e"]), (1, 2, ["f", "g", "h"])], "doc_id int, sent_no int, raw array<string>")
    parts = spark.createDataFrame([(1, 7, 0, 1, 2), (1, 7, 0, 2, 3), (1, 7, 1, 0, 1), (1, 7, 2, 0, 1), (1, 7, 2, 1, 2)], "doc_id int, event_no int, sent_no int, start int, stop int")
    assert R.across_sentences(parts, s).first().text == "b c d e f g"
    df = spark.createDataFrame([([token("a"), token("b"), token("c")],)], f"tokens {C.TOKENS}")
    info = df.select(R.head_info(F.col("tokens"), F.lit(0), F.lit(3), F.lit(None).cast("int"), F.lit(1), F.lit(3)).alias("h"), R.relabelled(F.array(F.lit("x"), F.lit("y")), "y").alias("l"), R.clipped(F.lit(2), F.lit(3), F.lit(9), F.lit(True), F.lit(True)).alias("c")).first()
    assert tuple(info.h) == ("b c", 1, 3, 2) and info.l == ["y", "x"] and tuple(info.c) == (0, 9)
    m = spark.createDataFrame([("k", 1, "Concept", ["Concept"], [("INC", "more", [])]), ("k", 2, "Concept", ["Concept"], [("INC", "more", [])]), ("k", 3, "Concept", ["Concept"], [])], f"sent_key string, mention_no int, label string, labels array<string>, attachments {ATT}")
    out = R.expandable_concepts(m, spark.createDataFrame([("k", 2)], "sent_key string, mention_no int")).collect()
    assert [(r.mention_no, r.labels) for r in out] == [(1, ["Concept-Expanded", "Concept"])]
    rows_, watch = R.observed(spark.range(5), "stage")
    rows_.collect()
    assert watch.get["rows"] == 5


def test_handler(spark):
    nodes = spark.createDataFrame([("wm/rain", ["heavy rain"], []), ("wm/wind", ["wind"], [])], "node string, examples array<string>, patterns array<string>")
    text = "the wind blew"
    tokens = [("the", 0, 3), ("wind", 4, 8), ("blew", 9, 13)]
    rows_ = spark.createDataFrame([(1, text, tokens, 4, 8), (2, text, tokens, 3, 8), (3, text, tokens, 5, 7), (4, text, tokens, 9, 99)], "row_id int, text string, tokens array<struct<word:string,start:int,stop:int>>, start int, stop int")
    got = {}
    for r in H.reground_intervals(rows_, nodes, "wm", 1).collect():
        got[r.row_id] = r.node
    assert got == {1: "wm/wind", 3: "wm/wind"}
    m = spark.createDataFrame([("wind",), ("wind",), (None,)], "canonical_name string")
    assert [(r.canonical_name, r.groundings[0].node) for r in H.reground_corpus(m, nodes, "wm").collect()] == [("wind", "wm/wind")]
    both = H.ground_all(m.where("canonical_name IS NOT NULL").distinct(), {"wm": nodes, "wdi": nodes}, "canonical_name", "canonical_name", 1)
    assert {(r.vocabulary, r.node) for r in both.collect()} == {("wm", "wm/wind"), ("wdi", "wm/wind")}
    words = spark.createDataFrame([(1, [("Rain", "NN"), ("heavy", "JJ")]), (2, [("x", "NN")])], "id int, tokens array<struct<word:string,tag:string>>")
    v = spark.createDataFrame([("rain", [1.0, 0.0]), ("heavy", [0.0, 1.0])], "word string, vec array<double>")
    out = {r.id: r.vec for r in H.weighted_composite(words, v, 2.0).collect()}
    assert out[2] is None and out[1] == pytest.approx([2 / 5**0.5, 1 / 5**0.5])
