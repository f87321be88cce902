import pytest

from strandline.operators import compositional as C

NODES = [(p, p.split("/")[1], C.node_words(p)) for p in ("top/concept/food", "top/concept/crop_failure_3", "top/process/transportation", "top/property/price", "top/property/security", "top/concept/water")]


@pytest.mark.parametrize(
    "text,want",
    [
        ("price of food", ("top/concept/food", "top/property/price", None, None)),
        ("water transportation", ("top/concept/water", None, "top/process/transportation", None)),
        ("food security", ("top/concept/food", "top/property/security", None, None)),
        ("severe crop failure", ("top/concept/crop_failure_3", None, None, None)),
        ("price of transportation", (None, None, "top/process/transportation", "top/property/price")),
        ("price", ("top/property/price", None, None, None)),
        ("nothing here", (None, None, None, None)),
        ("", (None, None, None, None)),
    ],
)
def test_slots(text, want):
    got = C.slots(text, NODES)
    assert tuple(got[n] and got[n][0] for n in C.NAMES) == want


def test_match_and_score():
    assert C.exact_match("a crop failure now".split(), ["crop", "failure"]) == (1, 2) and C.exact_match(["crop"], ["crop", "failure"]) == (0, 1) and C.exact_match(["big", "crop"], ["crop", "failure"]) is None
    assert C.tuple_score([None] * 4) == 0 and C.tuple_score([1.0, None, None, None]) < C.tuple_score([1.0, 0.7, None, None]) and C.nearest(2, [1, 3]) == 1 and C.nearest(5, [1, 3]) == 1


def test_frames(spark):
    rows = spark.createDataFrame([(1, "price of food", 0), (2, None, 0), (1, "price of food", 0)], "id int, name string, score int")
    nodes = spark.createDataFrame([(p, b) for p, b, _ in NODES], "node string, branch string")
    got = sorted((r.id, r.theme, r.score > 0) for r in C.ground(rows, nodes).collect())
    assert got == [(1, "top/concept/food", True), (1, "top/concept/food", True), (2, None, False)]
    main = spark.createDataFrame([("a", ["flood"], [1.0, 0.0]), ("b", [], [0.0, 1.0])], "node string, patterns array<string>, node_vec array<double>")
    inter = spark.createDataFrame([("i", ["cash"], [0.0, 1.0]), ("j", [], [0.6, 0.8])], "node string, patterns array<string>, node_vec array<double>")
    rows = spark.createDataFrame([(1, "floods", [0.0, 1.0]), (2, "cash aid", [0.0, 1.0]), (3, "aid", [0.6, 0.8]), (4, "rain", [0.6, 0.8])], "id int, name string, vec array<double>")
    best = {r.id: r.node for r in C.intervention_sieve(rows, main, inter, ["aid"], 2).where("rank = 1").collect()}
    assert best[1] == "a" and best[2] in ("b", "i") and best[3] == "j" and best[4] == "b"
