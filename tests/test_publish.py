"""Writes that count at once or not at all."""

import threading

import pytest
from pyspark.sql import functions as F

from attesta.operators import publish
from attesta.operators.publish import Log, Stale, export_tables, published, restore, restored_table, take_lease, verified, write_fenced

SCHEMA = "id long, v string"


def rows(spark, *ids):
    return spark.createDataFrame([(i, f"v{i}") for i in ids], SCHEMA)


def ids(spark, path):
    return sorted(r.id for r in published(spark, path, SCHEMA).collect())


def test_batches_count_once_and_old_leases_write_nothing(spark, tmp_path):
    path = f"file://{tmp_path}/sink"
    assert ids(spark, path) == []
    first = take_lease(spark, path, "q")
    assert write_fenced(rows(spark, 1, 2), path, "q", 0, first) and not write_fenced(rows(spark, 1, 2), path, "q", 0, first)
    second = take_lease(spark, path, "q")
    assert (first, second) == (1, 2)
    with pytest.raises(Stale):
        write_fenced(rows(spark, 9), path, "q", 1, first)
    assert write_fenced(rows(spark, 3), path, "q", 1, second) and write_fenced(rows(spark, 4), path, "other", 1, 1)
    assert ids(spark, path) == [1, 2, 3, 4]


def test_a_lease_that_passes_on_during_the_write_is_refused(spark, tmp_path, monkeypatch):
    path = f"file://{tmp_path}/sink"
    lease, commit = take_lease(spark, path, "q"), Log.commit

    def late(self, entry):
        monkeypatch.setattr(Log, "commit", commit)
        take_lease(spark, path, "q")  # another holder, while the data was being written
        return commit(self, entry)

    monkeypatch.setattr(Log, "commit", late)
    with pytest.raises(Stale):
        write_fenced(rows(spark, 1), path, "q", 0, lease)
    assert ids(spark, path) == []


def test_of_two_writers_one_looks_again(spark, tmp_path):
    path = f"file://{tmp_path}/sink"
    log = Log(spark, path)
    assert log.append({"query": "a", "epoch": 0, "fence": 1, "folders": []}, 0) and not log.append({"query": "b", "epoch": 0, "fence": 1, "folders": []}, 0)
    threads = [threading.Thread(target=lambda i=i: Log(spark, path).commit(lambda before: {"query": f"t{i}", "epoch": 0, "fence": 1, "folders": [], "n": len(before)})) for i in range(8)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    entries = Log(spark, path).entries()
    assert len(entries) == 9 and sorted(e["query"] for e in entries[1:]) == [f"t{i}" for i in range(8)] and [e["n"] for e in entries[1:]] == list(range(1, 9))


def test_a_manifest_that_is_only_begun_ends_the_log(spark, tmp_path):
    path = f"file://{tmp_path}/sink"
    write_fenced(rows(spark, 1), path, "q", 0, 1)
    (tmp_path / "sink/_log/000000000001.json").write_text('{"query": "q", "epo')
    assert ids(spark, path) == [1] and len(Log(spark, path).entries()) == 1


def test_streams_may_run_a_batch_again(spark, tmp_path):
    source, path = f"file://{tmp_path}/in", f"file://{tmp_path}/sink"
    for i in range(3):
        rows(spark, 10 * i, 10 * i + 1).coalesce(1).write.mode("append").parquet(source)
    lease = take_lease(spark, path, "s")
    calls = []

    def batch(df, epoch):
        calls.append(epoch)
        write_fenced(df, path, "s", epoch, lease)
        write_fenced(df, path, "s", epoch, lease)

    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(source).writeStream.foreachBatch(batch).option("checkpointLocation", f"file://{tmp_path}/ck").trigger(availableNow=True).start()
    stream.awaitTermination(120)
    assert len(calls) == 3 and ids(spark, path) == [0, 1, 10, 11, 20, 21]


def test_an_export_is_measured_and_read_again(spark, tmp_path):
    to = f"file://{tmp_path}/out"
    odd = spark.createDataFrame([(None, "a\x1fb", 1.5), (1, None, float("nan")), (1, None, float("nan"))], "id long, `a b` string, d double")
    told = export_tables({"t": rows(spark, *range(100)).repartition(7), "odd": odd, "none": rows(spark).limit(0)}, to)
    assert {n: t["rows"] for n, t in told["tables"].items()} == {"t": 100, "odd": 3, "none": 0}
    assert {(r.table, r.rows, r.same) for r in verified(spark, to).collect()} == {("t", 100, True), ("odd", 3, True), ("none", 0, True)}
    with pytest.raises(Exception):
        export_tables({"t": rows(spark, 1)}, to)
    with pytest.raises(FileNotFoundError):
        verified(spark, f"file://{tmp_path}/nothing")


def test_a_restore_brings_all_or_nothing(spark, tmp_path):
    out, into = f"file://{tmp_path}/out", f"file://{tmp_path}/into"
    export_tables({"a": rows(spark, 1, 2), "b": rows(spark, 3)}, out)
    assert restore(spark, out, into) and not restore(spark, out, into)
    assert sorted(r.id for r in restored_table(spark, into, "a").collect()) == [1, 2] and len(Log(spark, into).entries()) == 1
    other = f"file://{tmp_path}/other"
    rows(spark, 99).write.mode("append").parquet(f"{out}/data/b")  # no longer what the manifest says
    assert [(r.table, r.same) for r in verified(spark, out).orderBy("table").collect()] == [("a", True), ("b", False)]
    with pytest.raises(ValueError, match="b"):
        restore(spark, out, other)
    assert Log(spark, other).entries() == []


def test_digests_see_every_change_but_order(spark):
    base = rows(spark, 1, 2, 3)
    of = lambda df: df.agg(F.sum(publish.row_digest(df))).first()[0]
    assert of(base) == of(base.orderBy(F.desc("id")).repartition(3)) != of(rows(spark, 1, 2, 4)) and of(base) != of(base.withColumn("v", F.when(F.col("id") != 2, F.col("v")))) and of(base) != of(base.union(base.limit(1)))
