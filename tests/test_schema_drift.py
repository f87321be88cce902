import itertools
import json
import random

from strandline.operators.schema_drift import assignment, changes, fields_of, name_similarity, unify

SCHEMA = "raw_no long, file_no long, file_seq int, feed string, payload string"


def rows(*files, feed="f"):
    out, n = [], itertools.count(1)
    for no, records in files:
        out += [(next(n) + 1000 * no, no, no, feed, r if r is None or isinstance(r, str) else json.dumps(r)) for r in records]
    return out


def meta(**fields):
    return {"extracted_metadata": fields}


def test_changes(spark):
    people = ["Ann Lee", "Bo Ray", "Cy Fox", "Di Poe"]
    one = [meta(Author=p, Tagged=True, Pages=i, Subject="trade, maize") for i, p in enumerate(people)]
    two = [{"_source": meta(writtenBy=[p], Encrypted=False, pageCount=i, Subject="trade, maize")} for i, p in enumerate(people)] + [None, "{bad", "[]", ""]
    three = [meta(writtenBy=[p], Encrypted=None, pageCount=str(i), Subject={"name": "trade maize"}) for i, p in enumerate(people)]
    df = spark.createDataFrame(rows((1, one), (2, two), (3, three), (3, three[:1])), SCHEMA)
    got = {tuple(r) for r in changes(df).collect()}
    assert got == {
        (2, "renamed", "Author", "writtenBy"), (2, "retyped", "writtenBy", "writtenBy"), (2, "renamed", "Pages", "pageCount"), (2, "removed", "Tagged", ""), (2, "added", "", "Encrypted"),
        (3, "removed", "Encrypted", ""), (3, "retyped", "pageCount", "pageCount"), (3, "retyped", "Subject", "Subject"),
    }
    names = {(r.file_no, r.key): r.field for r in fields_of(df).collect()}
    assert names[1, "Author"] == names[3, "writtenBy"] == "Author" and names[3, "pageCount"] == "Pages"
    fields = {r.field for r in unify(df).collect()}
    assert len(fields) == 5
    assert changes(df.limit(0)).count() == 0


def test_unreadable_file_loses_all_fields(spark):
    df = spark.createDataFrame(rows((1, [meta(a="x")]), (2, [None, "{"]), (3, [meta(a="x")])), SCHEMA)
    assert {tuple(r) for r in changes(df).collect()} == {(2, "removed", "a", ""), (3, "added", "", "a")}


def test_assignment_is_optimal():
    random.seed(3)
    for _ in range(200):
        n, m = random.randint(1, 4), random.randint(1, 5)
        w = [[random.random() for _ in range(m)] for _ in range(n)]
        total = sum(w[i][j] for i, j in assignment(w))
        small, large = (n, m) if n <= m else (m, n)
        best = max(sum((w[i][p[i]] if n <= m else w[p[i]][i]) for i in range(small)) for p in itertools.permutations(range(large), small))
        assert abs(total - best) < 1e-9


def test_names():
    assert name_similarity("dc:creator", "Creator") == 1.0 and name_similarity("Tagged", "Encrypted") < 0.7


def test_one_name_for_different_fields_of_two_feeds_joins_nothing(spark):
    people, titles = [f"Ann{i} Lee{i}" for i in range(6)], [f"Report on trade {i} in spring" for i in range(6)]
    a = [(1, [meta(Title=t, Author=p) for t, p in zip(titles, people)]), (2, [meta(Name=t, Author=p) for t, p in zip(titles, people)])]
    b = [(11, [meta(Title=t, Author=p) for t, p in zip(titles, people)]), (12, [meta(Title=t, Name=p) for t, p in zip(titles, people)])]
    c = [(21, [meta(heading=t, writer=p, pages=3) for t, p in zip(titles, people)])]
    df = spark.createDataFrame(rows(*a, feed="a") + rows(*b, feed="b") + rows(*c, feed="c"), SCHEMA)
    names = {(r.file_no, r.key): r.field for r in fields_of(df).collect()}
    assert names[2, "Name"] == "Title" and names[12, "Name"] == "Author"
    assert names[21, "heading"] == "Title" and names[21, "writer"] == "Author" and names[21, "pages"] == "pages"
    table = {(r.raw_no, r.field): (r.type, r.value) for r in unify(df).collect()}
    assert len(table) == 4 * 12 + 18 and table[21002, "pages"] == ("number", "3")


def test_types_are_unified(spark):
    df = spark.createDataFrame(rows((1, [meta(Pages=i) for i in range(5)]), (2, [meta(Pages=str(i)) for i in range(3)])), SCHEMA)
    assert {(r.type, r.value) for r in unify(df).collect()} == {("number", str(i)) for i in range(5)}
    assert unify(df.limit(0)).count() == 0
