import random

from pyspark.sql import functions as F

from graphloom.functions import terms as T
from graphloom.operators import store
from graphloom.streaming import changes


def test_class_counts_follow_appends(spark, tmp_path):
    rows = lambda *s: spark.createDataFrame([("g", "iri", x, T.TYPE, "iri", c, None, None) for x, c in s], store.SCHEMA)
    folder = str(tmp_path / "in")
    rows(("a", "C"), ("b", "C"), ("a", "D")).write.mode("append").parquet(folder)
    q = changes.class_counts(changes.quad_stream(spark, folder)).writeStream.outputMode("complete").format("memory").queryName("class_counts").option("checkpointLocation", str(tmp_path / "ck")).start()
    try:
        q.processAllAvailable()
        rows(("a", "C"), ("c", "D")).write.mode("append").parquet(folder)
        q.processAllAvailable()
        assert {r.cls: r.n for r in spark.table("class_counts").collect()} == {"C": 2, "D": 2}
    finally:
        q.stop()


def test_event_windows_as_batch(spark):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    got = changes.event_counts(events)
    assert got.agg(F.sum("n")).first()[0] == events.count() and got.columns == ["start", "event_type", "n", "total"]


def test_members_with_retractions(spark, tmp_path):
    """After each batch the state is what the batch query gives over all events so far."""
    rng = random.Random(5)
    every = [(rng.randrange(400), rng.choice(["add", "add", "remove"]), f"s{rng.randrange(12)}", f"c{rng.randrange(9)}") for _ in range(400)]
    rng.shuffle(every)  # late events are in later files
    folder, schema = str(tmp_path / "in"), "seq long, op string, s string, cls string"
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    (tmp_path / "in").mkdir()
    told = changes.member_conflicts(spark.readStream.schema(schema).parquet(folder), 4)
    q = told.writeStream.outputMode("update").format("memory").queryName("member_conflicts").option("checkpointLocation", str(tmp_path / "ck")).start()
    try:
        for i in range(0, 400, 150):
            spark.createDataFrame([*every[i : i + 150], *every[i : i + 20]], schema).coalesce(1).write.mode("append").parquet(folder)
            q.processAllAvailable()
            now = {}
            for r in spark.table("member_conflicts").collect():  # in the order in which it was told
                now[r.s] = (r.n, r.open)
            want = {r.s: (r.n, r.open) for r in changes.members_after(spark.createDataFrame(every[: i + 150], schema), 4).collect()}
            assert now == want
    finally:
        q.stop()
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    assert any(o for _, o in want.values()) and not all(o for _, o in want.values())
