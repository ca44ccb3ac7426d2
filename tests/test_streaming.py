from pyspark.sql import functions as F

from tomewright.plans.assemble import assemble_entries, resolve_collisions
from tomewright.plans.directory import plan_by_directory
from tomewright.sources.files import files_from_table, prepare_files
from tomewright.streaming.refresh import KbStore, stream_refresh

SCHEMA = "path string, content string, size bigint, modified timestamp, deleted boolean"


def test_two_batches_equal_one(spark, tmp_path):
    first = [("a/x.ts", "1"), ("a/y.ts", "2"), ("b/z.py", "3"), (".env", "S=1")]
    then = [("a/x.ts", "1 changed"), ("c/w.md", "4")]

    def arrive(rows, when, gone=()):
        rows = [(p, c, False) for p, c in rows] + [(p, "", True) for p in gone]
        (spark.createDataFrame(rows, "path string, content string, deleted boolean")
         .select("path", "content", F.octet_length("content").cast("long").alias("size"),
                 F.to_timestamp(F.lit(when)).alias("modified"), "deleted")
         .coalesce(1).write.mode("append").parquet(str(tmp_path / "in")))
        stream = spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in"))
        stream_refresh(stream, str(tmp_path / "kb"), str(tmp_path / "ck"),
                       lambda batch: f"t{batch}").awaitTermination()

    arrive(first, "2025-01-01")
    arrive(then, "2025-01-02", gone=["b/z.py"])
    store = KbStore(spark, str(tmp_path / "kb"))
    kb = store.kb(store.latest())

    final = [("a/x.ts", "1 changed"), ("a/y.ts", "2"), ("c/w.md", "4")]
    files = prepare_files(files_from_table(spark.createDataFrame(
        final, "path string, content string")))
    want = assemble_entries(resolve_collisions(plan_by_directory(files)), "t1")
    assert sorted(map(tuple, kb.entries.collect())) == sorted(map(tuple, want.entries.collect()))
    assert sorted(map(tuple, kb.body.collect())) == sorted(map(tuple, want.body.collect()))
    report = store.report(store.latest()).first()
    assert (report.entries_updated, report.entries_removed, report.entries_created) == (2, 2, 1)
    assert report.files_scanned == 3


def refresh_once(spark, tmp_path, batches):
    """The store after batches of (path, content, modified, deleted)."""
    from tomewright.streaming.refresh import refresh_batch
    store = KbStore(spark, str(tmp_path))
    for k, rows in enumerate(batches):
        arrived = spark.createDataFrame(
            rows, "path string, content string, modified string, deleted boolean").select(
            "path", "content", F.octet_length("content").cast("long").alias("size"),
            F.to_timestamp("modified").alias("modified"), "deleted")
        refresh_batch(store, arrived, k, "t")
    return store


ROWS = [("a/x.ts", "new", "2025-02-01", False), ("a/x.ts", "old", "2025-01-01", False),
        ("b/y.ts", "one", "2025-01-01", False), ("b/y.ts", "two", "2025-01-01", False),
        ("c/z.ts", "", "2025-03-01", True), ("c/z.ts", "late", "2025-02-01", False),
        ("d/w.ts", "kept", "2025-01-01", False)]


def test_order_of_arrival_does_not_count(spark, tmp_path):
    def result(name, batches):
        store = refresh_once(spark, tmp_path / name, batches)
        last, kb = store.latest(), store.kb(store.latest())
        state = store.state(last)
        return (sorted(map(tuple, store.files(last).collect())),
                *(sorted(map(str, t.collect())) for t in (kb.entries, kb.body, kb.tags, kb.sources)),
                sorted(map(tuple, state.files.collect())), state.summary.first()["categories"])

    at_once = result("one", [ROWS])
    assert [r[0] for r in at_once[0]] == ["a/x.ts", "b/y.ts", "d/w.ts"]
    assert at_once[-1] == '{"module":3}'
    assert result("late", [ROWS[0::2], ROWS[1::2]]) == at_once
    assert result("back", [ROWS[4:], ROWS[:4], ROWS[2:6]]) == at_once
