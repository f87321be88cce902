import datetime as dt

import pytest
from pyspark.sql import functions as F

from strandline.operators import context as C
from strandline.operators import vectors as V
from strandline.plans import pipeline
from strandline.sources import exporters as E

D = dt.date


@pytest.mark.parametrize(
    "text,want",
    [
        ("in 2015", (D(2015, 1, 1), D(2016, 1, 1))), ("on 2015-02-28", (D(2015, 2, 28), D(2015, 3, 1))), ("by 31 December 2016", (D(2016, 12, 31), D(2017, 1, 1))), ("in December 2016", (D(2016, 12, 1), D(2017, 1, 1))),
        ("during March", (D(2018, 3, 1), D(2018, 4, 1))), ("between May and July 2013", (D(2013, 5, 1), D(2013, 8, 1))), ("between November and February 2013", (D(2012, 11, 1), D(2013, 3, 1))),
        ("the past three months", (D(2018, 2, 28), D(2018, 5, 31))), ("the next week", (D(2018, 5, 31), D(2018, 6, 7))), ("on 2015-02-31", None), ("31 April 2015", None),
    ],
)
def test_time_intervals(text, want):
    (m,) = C._TIME.finditer(text)
    assert C.time_interval(m, D(2018, 5, 31)) == want


def test_times_frame(spark):
    df = spark.createDataFrame([(1, "In 2015 and last year.", None), (2, None, None), (3, "", D(2018, 1, 1))], "doc_id long, text string, dct date")
    assert [(r.doc_id, r.text, r.begins) for r in C.times(df).orderBy("start").collect()] == [(1, "2015", D(2015, 1, 1)), (1, "last year", None)]


def test_seasons(spark):
    triggers = spark.createDataFrame([("d", 4, 3, "meher", 0), ("d", 4, 9, "belg", -1), ("e", 0, 0, "meher", 0)], "doc_id string, sent_no int, pos int, season string, shift int")
    times = spark.createDataFrame([("d", 1, 0, D(2009, 1, 1)), ("d", 2, 5, D(2011, 1, 1)), ("d", 4, 50, None), ("e", 9, 0, D(2011, 1, 1))], "doc_id string, sent_no int, pos int, begins date")
    places = spark.createDataFrame([("d", 4, 1, "Tigray"), ("d", 4, 2, "Nowhere"), ("d", 3, 2, "Nowhere")], "doc_id string, sent_no int, pos int, place string")
    calendar = spark.createDataFrame([("Tigray", "meher", 9, 2), ("Tigray", "belg", 2, 4)], "place string, season string, first_month int, last_month int")
    got = {(r.season, r.begins, r.ends) for r in C.seasons(triggers, times, places, calendar).collect()}
    assert got == {("meher", D(2011, 9, 1), D(2012, 3, 1)), ("belg", D(2011, 1, 1), D(2011, 4, 1))}


def test_vectors(spark, tmp_path):
    (tmp_path / "v.txt").write_text("2 2\nrain 1.0 0.0\nflood 0.0 2.0\n")
    vocab = V.read_vectors(spark, str(tmp_path / "v.txt"))
    rows = spark.createDataFrame([(1, ["rain", "rain", "x"]), (2, ["rain", "flood"]), (3, ["x"]), (4, [])], "id int, w array<string>")
    got = {r.id: r.vec for r in V.composite(rows, "id", F.col("w"), vocab, spark.createDataFrame([("rain", 2.0)], "word string, weight double")).collect()}
    assert got[1] == [1.0, 0.0] and abs(got[2][0] - 0.5**0.5) < 1e-12 and got[3] is None and got[4] is None
    nodes = vocab.select(F.col("word").alias("node"), F.col("vec").alias("node_vec"))
    rel = {r.id: r.relevance for r in V.relevance(V.composite(rows, "id", F.col("w"), vocab), nodes, 0.95).collect()}
    assert rel[1] == 1.0 and rel[3] == 0.0


def test_pipeline_and_exporters(spark):
    docs = spark.createDataFrame([(1, "Rising drought reduced local trade in Lamu. Prices fell because of severe hunger."), (2, None), (3, "Strong rain was followed by heavy flooding.")], "doc_id long, text string")
    edges = pipeline.edges(pipeline.mentions(docs)).cache()
    got = {(r.doc_id, r.label, r.cause, r.effect) for r in edges.collect()}
    assert {(1, "Causal", "rising drought", "local trade"), (1, "Causal", "severe hunger", "prices"), (3, "Correlation", "strong rain", "heavy flooding")} <= got
    assert pipeline.causal_graph(edges).where("cause = 'rising drought'").first().n == 1
    assert [r.row for r in E.exporter("annotation")(edges).orderBy("row").collect()] == [1, 2]
    g = spark.createDataFrame([("rising drought", "top/drought", 0.9, 1), ("rising drought", "top/x", 0.1, 2)], "id string, node string, score double, rank int")
    assert {(r.cause_node, r.effect_node, r.effect_score) for r in E.grounding_sheet(edges, g).collect()} == {("top/drought", "NONE", 0.0), ("NONE", "NONE", 0.0)}
    sims = spark.createDataFrame([(1, "n", "a", 0.5), (1, "n", "b", 0.7), (1, "n", "c", 0.1)], "id int, node string, example string, score double")
    r = E.insight(sims, 2).first()
    assert (r.n, r.best, r.worst, r.top) == (3, 0.7, 0.1, ["b:0.7", "a:0.5"])
    with pytest.raises(NotImplementedError):
        E.exporter("nothing")
