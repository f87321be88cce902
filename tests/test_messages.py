from strandline.operators.messages import MessageStore, surplus_rows
from strandline.session import scratch_path

SCHEMA = "delivery_no long, batch_no long, team string, document_id string, timestamp string, extra int"


def test_surplus_rows(spark):
    teams = spark.createDataFrame([("a", "Europe/Berlin", "dmy")], "team string, zone_id string, date_order string")
    i = "0123456789abcdef0123456789abcdef"
    rows = [
        (1, 0, "a", i, "2015-01-01T00:00:00Z", 1),
        (2, 0, "a", i.upper(), "2015-01-01 01:00:00", 1),
        (3, 1, "a", " 01234567-89ab-cdef-0123-456789abcdef\n", "1420070400", 1),
        (4, 1, "a", i, "2015-01-02T00:00:00Z", 1),
        (5, 1, "a", i, "n/a", 1),
        (6, 1, "a", i, "n/a", 1),
        (7, 9, "a", None, "2015-01-01T00:00:00Z", 1),
        (8, 9, "a", None, "2015-01-01T00:00:00Z", 1),
        (9, None, "a", i, "2015-01-02T00:00:00Z", 1),
    ]
    got = {r[0] for r in surplus_rows(spark.createDataFrame(rows, SCHEMA), teams).collect()}
    assert got == {2, 3, 9}
    assert surplus_rows(spark.createDataFrame([], SCHEMA), teams).count() == 0


def test_later_batch_with_a_lower_arrival_replaces_the_winner(spark):
    store = MessageStore(spark, scratch_path(spark, "store"))
    schema = "id binary, instant long, arrival long, part int"
    store.ingest(spark.createDataFrame([(b"x", 1, 10, 0), (b"y", 1, 11, 1), (b"x", 1, 12, 1)], schema))
    store.ingest(spark.createDataFrame([(b"x", 1, 5, 2), (b"z", None, 6, 2)], schema))
    assert {(bytes(r.id), r.arrival) for r in store.messages().collect()} == {(b"x", 5), (b"y", 11)}
    assert {r.arrival for r in store.surplus().collect()} == {10, 12}


def test_one_message_with_a_third_of_all_rows(spark):
    store = MessageStore(spark, scratch_path(spark, "store"))
    df = spark.range(3000).selectExpr("cast(if(id % 3 = 0, 'hot', cast(id as string)) as binary) AS id", "1L AS instant", "id AS arrival", "cast(id % 4 AS int) AS part")
    store.ingest(df)
    assert store.messages().count() == 2001 and store.surplus().count() == 999


def brute(batches):
    """Winners and losers of all rows so far, after each batch."""
    seen = {}
    for batch in batches:
        for i, t, arrival in batch:
            seen.setdefault((i, t), set()).add(arrival)
        yield {(i, t, min(a), len(a)) for (i, t), a in seen.items()}, {x for a in seen.values() for x in a - {min(a)}}


def test_many_overlapping_batches_keep_every_winner(spark):
    random = __import__("random").Random(5)
    arrivals = random.sample(range(10_000), 240)
    batches = [[(f"m{random.randrange(25)}".encode(), random.randrange(3), a) for a in arrivals[k : k + 40]] for k in range(0, 240, 40)]
    store = MessageStore(spark, scratch_path(spark, "store"), part_rows=10)
    for batch, (winners, losers) in zip(batches, brute(batches)):
        store.ingest(spark.createDataFrame(batch, "id binary, instant long, arrival long"))
        assert {(bytes(r.id), r.instant, r.arrival, r.copies) for r in store.messages().collect()} == winners
        got = [r.arrival for r in store.surplus().collect()]
        assert set(got) == losers and len(got) == len(losers)
    assert store.vacuum() > 0
    assert store.messages().count() == len(winners) and store.surplus().count() == len(losers)


def test_only_touched_partitions_are_overwritten(spark):
    store = MessageStore(spark, scratch_path(spark, "store"))
    schema = "id binary, instant long, arrival long"
    for k in range(3):
        store.ingest(spark.createDataFrame([(b"x%d" % k, 1, k)], schema))
    before = store.manifest()["parts"]
    store.ingest(spark.createDataFrame([(b"x1", 1, 9), (b"new", 500, 10)], schema))
    after = store.manifest()["parts"]
    changed = {h for h in before if after[h] != before[h]}
    assert len(changed) == 1 and len(after) == 4


def test_of_two_writers_the_second_starts_again(spark):
    path, schema = scratch_path(spark, "store"), "id binary, instant long, arrival long"
    one, two = MessageStore(spark, path), MessageStore(spark, path)
    stale = two.manifest()
    one.ingest(spark.createDataFrame([(b"a", 1, 1)], schema))
    fresh, calls = two.manifest, []
    two.manifest = lambda: stale if not calls and not calls.append(1) else fresh()
    two.ingest(spark.createDataFrame([(b"a", 1, 2), (b"b", 1, 3)], schema))
    assert {(bytes(r.id), r.arrival, r.copies) for r in one.messages().collect()} == {(b"a", 1, 2), (b"b", 3, 1)}
    assert one.manifest()["version"] == 2


def test_many_repeated_messages_are_told_without_a_broadcast(spark, monkeypatch):
    from strandline.operators import messages

    monkeypatch.setattr(messages, "BROADCAST_ROWS", 3)
    store = MessageStore(spark, scratch_path(spark, "store"))
    df = spark.range(400).selectExpr("cast(cast(id % 40 as string) as binary) AS id", "1L AS instant", "id AS arrival")
    store.ingest(df)
    store.ingest(df.selectExpr("id", "instant", "arrival + 1000 AS arrival"))
    assert {r.arrival for r in store.surplus().collect()} == set(range(40, 400)) | set(range(1000, 1400))
