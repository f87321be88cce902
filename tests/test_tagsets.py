from pyspark.sql import functions as F

from strandline.functions import tagsets as T
from strandline.operators import mentions as M

SCHEMA = "sent_key string, tokens array<struct<word:string,lemma:string,tag:string,entity:string>>"


def frame(spark, *sentences):
    rows = [(f"s{i}", [(w, w.lower(), t, e) for w, t, e in (x.split("/") for x in s.split())]) for i, s in enumerate(sentences)]
    return spark.createDataFrame(rows, SCHEMA)


def test_content(spark):
    df = frame(spark, "the/DT rain/NN/".replace("/NN/", "/NN/O").replace("/DT", "/DT/O"), "2015/NN/DATE", "R/NN/O", "the/DT/O")
    assert [r[0] for r in df.select(T.has_content(F.col("tokens"), ["thing"])).collect()] == [True, False, False, False]
    assert [r[0] for r in df.select(T.content_name(F.col("tokens"), ["thing"])).collect()] == ["rain", "2015", "R", "the"]


def test_split_and_trim(spark):
    df = frame(spark, "the/DT/O maize/NN/O ,/,/O beans/NNS/O and/CC/O big/JJ/O ,/,/O ripe/JJ/O rice/NN/O of/IN/O", "of/IN/O the/DT/O")
    got = df.select("sent_key", T.split_coordinated(F.col("tokens"), F.lit(0), F.size("tokens")).alias("p"), T.trimmed(F.col("tokens"), F.lit(0), F.size("tokens")).alias("t")).orderBy("sent_key").collect()
    assert [tuple(p) for p in got[0].p] == [(0, 2), (3, 4), (5, 10)] and tuple(got[0].t) == (1, 9)
    assert tuple(got[1].t) == (0, 2)
    found = spark.createDataFrame([("s0", 0, 10), ("s0", 0, 4)], "sent_key string, start int, stop int")
    avoid = spark.createDataFrame([("s0", 3, 4)], "sent_key string, start int, stop int")
    assert {tuple(r) for r in M.entities(df, found, avoid).collect()} == {("s0", 1, 2), ("s0", 5, 9)}


def test_valid_entities(spark):
    df = frame(spark, "heavy/JJ/O rain/NN/O", "2015/CD/DATE", "This/DT/O", "rain/NN/O of/IN/O")
    assert [r[0] for r in df.select(T.valid_entity(F.col("tokens"))).collect()] == [True, False, True, False]


def test_contained_events(spark):
    df = spark.createDataFrame([(1, "k", 5, ["heavy rain", "flood"]), (2, "k", 4, ["rain", "flood"]), (3, "k", 4, ["hunger"]), (4, "j", 1, ["rain"])], "id int, k string, w int, args array<string>")
    assert {r.id for r in M.without_contained_events(df, ["k"], "w", "args", "id").collect()} == {1, 3, 4}
