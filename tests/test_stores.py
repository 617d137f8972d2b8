import datetime as dt

from pyspark.sql import functions as F

from tessera.operators import store, versions
from tessera.streaming import feedback, sink

EVENTS = "event_id long, ts timestamp, request_id long, event_type string"


def test_sink_replays_change_nothing_and_equal_the_batch(spark, tmp_path):
    day = lambda i: dt.datetime(2024, 1, 1 + i % 2, i % 24)
    rows = [(i, day(i), i % 5, [" LIKE", "click", "nonsense", None][i % 4]) for i in range(80)]
    df = spark.createDataFrame([*rows, *rows[:10]], EVENTS)  # ten events arrive twice
    for n, part in enumerate((df.where("event_id < 30"), df.where("event_id >= 30"))):
        part.coalesce(1).write.parquet(f"{tmp_path}/in{n}")
        spark.read.parquet(f"{tmp_path}/in{n}").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = feedback.read_events(spark, f"{tmp_path}/in", EVENTS, files_per_batch=1)
    out = f"{tmp_path}/out"
    sink.start(stream, out, f"{tmp_path}/ck").awaitTermination()
    good, bad = store.validate(df.dropDuplicates(["event_id"]))
    state = lambda: [sorted(map(tuple, x.collect()), key=str) for x in (sink.accepted(spark, out), sink.quarantined(spark, out), sink.latest(spark, out))]
    columns = sink.accepted(spark, out).columns
    want = [sorted(map(tuple, x.select(columns).collect()), key=str) for x in (good, bad, store.latest(good, ["request_id"], ["ts", "event_id"]))]
    assert state() == want
    sink.write_batch(df.where("event_id < 30").dropDuplicates(["event_id"]), 0, out)  # the first batch again, as after a lost checkpoint
    sink.start(stream, out, f"{tmp_path}/ck").awaitTermination()  # nothing new
    assert len(state()[0]) == len(want[0]) and state() == want


def test_versions(spark, tmp_path):
    schema = "item_id long, seen long, first_seen int, last_seen int, quality double, types array<string>, text string"
    path = f"{tmp_path}/store"
    rows = lambda ids, t, text="x": spark.createDataFrame([(i, 1, t, t, float(t), [f"t{t}"], text if i % 10 else " ") for i in ids], schema)
    commit = lambda df: versions.commit(df, path, text="text", buckets=16)
    assert versions.versions(spark, path) == [] and commit(rows(range(40), 1)) == 0
    first = versions.fingerprint(spark, path)
    assert first[0] == 36 and commit(rows([3, 4], 2, "new text")) == 1
    assert versions.fingerprint(spark, path) == first  # texts change, ids do not: an index stays
    assert commit(rows([3, 99], 3)) == 2 and versions.fingerprint(spark, path) != first
    assert commit(rows([120], 4)) == 3 and versions.fingerprint(spark, path) == versions.fingerprint(spark, path, 2)  # an id without text
    state = lambda v: {r.item_id: (r.seen, r.first_seen, r.last_seen, r.types) for r in versions.read(spark, path, v).collect()}
    assert len(state(0)) == 40 and state(0)[3] == (1, 1, 1, ["t1"]) and state(1)[3] == (2, 1, 2, ["t1", "t2"]) and state(2)[3] == (3, 1, 3, ["t1", "t2", "t3"])
    assert len(state(None)) == 42 and state(None)[5] == (1, 1, 1, ["t1"]) and 99 not in state(1)
    # a commit leaves the buckets alone that it does not touch
    a, b = (dict(versions.manifest(spark, path, v).select("bucket", "folder").collect()) for v in (1, 2))
    touched = {r.b for r in rows([3, 99], 3).select(versions._bucket("item_id", 16).alias("b")).collect()}
    assert {k for k in b if a.get(k) != b[k]} == touched
    assert commit(rows([], 5)) == 4 and state(4) == state(3)
    # the order of rows, and of what was committed when, does not matter
    other = f"{tmp_path}/other"
    versions.commit(rows([*range(39, -1, -1), 99], 9), other, text="text", buckets=16)
    assert versions.fingerprint(spark, other) == versions.fingerprint(spark, path)
    try:
        versions.read(spark, path, 77)
        raise AssertionError
    except ValueError:
        pass


def test_replacing_an_index_follows_the_fingerprint(spark, tmp_path):
    from tessera.operators import semantic

    kept = {}

    def index(path):
        mark = versions.fingerprint(spark, path)
        if mark not in kept:
            kept[mark] = semantic.fit(versions.read(spark, path).select(F.col("item_id").alias("id"), "text"))
        return kept[mark]

    schema, path = "item_id long, seen long, first_seen int, last_seen int, text string", f"{tmp_path}/s"
    versions.commit(spark.createDataFrame([(i, 1, 1, 1, f"a{i % 3} b{i}") for i in range(6)], schema), path, text="text")
    one = index(path)
    versions.commit(spark.createDataFrame([(2, 1, 2, 2, "other words")], schema), path, text="text")
    assert index(path) is one
    versions.commit(spark.createDataFrame([(9, 1, 2, 2, "more")], schema), path, text="text")
    assert index(path) is not one and index(path).items.count() == 7
