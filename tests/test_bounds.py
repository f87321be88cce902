"""Bounds that must not cut a result silently."""

import pytest

from strandline.operators import mentions as M
from strandline.operators import schema_drift


def test_reachable_has_no_depth(spark):
    arguments = spark.createDataFrame([(i, i + 1) for i in range(12)] + [(12, 5)], "mention_id long, argument_id long")
    got = M.reachable(arguments, spark.createDataFrame([(0,)], "mention_id long"))
    assert sorted(map(tuple, got.collect())) == [(0, i) for i in range(13)]


def test_a_phrase_of_any_length_is_found(spark):
    from pyspark.sql import functions as F

    words = [f"w{i}" for i in range(30)]
    df = spark.createDataFrame([(1, ["x", *words, "y"])], "id int, w array<string>")
    lexicon = spark.createDataFrame([(" ".join(words), "Long"), (" ".join(words[:2]), "Long"), ("y", "Short")], "phrase string, label string")
    got = {(r.label, r.start, r.stop) for r in M.gazetteer(df, ["id"], F.col("w"), lexicon).collect()}
    assert got == {("Long", 1, 31), ("Short", 31, 32)}


def test_too_many_shared_names_are_refused(spark, monkeypatch):
    rows = [(1, 1, 1, "f", '{"extracted_metadata": {"a": "x"}}'), (2, 2, 1, "g", '{"extracted_metadata": {"a": "x"}}')]
    raw = spark.createDataFrame(rows, "raw_no long, file_no long, file_seq int, feed string, payload string")
    monkeypatch.setattr(schema_drift, "MAX_NAMES", 0)
    with pytest.raises(ValueError, match="field names"):
        schema_drift.fields_of(raw)


def test_longest_intervals_against_brute_force(spark):
    import random

    random.seed(2)
    rows = [(random.choice(["a", "b", None]), random.choice([None, *range(6)]), random.choice([None, *range(6, 11)]), random.randrange(12), i) for i in range(150)]
    df = spark.createDataFrame(rows, "k string, start int, stop int, id int, row int")

    def held(x, y):
        if None in (*x[:3], *y[:3]) or x[0] != y[0] or y[1] > x[1] or y[2] < x[2]:
            return False
        return y[2] - y[1] > x[2] - x[1] or (y[2] - y[1] == x[2] - x[1] and y[3] < x[3])

    want = sorted(x[4] for x in rows if not any(held(x, y) for y in rows))
    assert sorted(r.row for r in M.keep_longest(df, ["k"]).collect()) == want
