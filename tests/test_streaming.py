import json


from attesta.streaming import incremental


def feed(path, name, rows):
    (path / name).write_text("\n".join(json.dumps(r) for r in rows))


SCHEMA = "entity_id string, content_hash string, observed_at timestamp"


def run(stream, path, mode, name):
    q = stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(path)).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return stream.sparkSession.table(name)


def test_latest_state_ignores_late_rows(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    feed(src, "1.json", [{"entity_id": "e", "content_hash": "A", "observed_at": "2026-01-01T00:00:00Z"}, {"entity_id": "e", "content_hash": "B", "observed_at": "2026-01-03T00:00:00Z"}])
    feed(src, "2.json", [{"entity_id": "e", "content_hash": "C", "observed_at": "2026-01-02T00:00:00Z"}])
    s = incremental.file_stream(spark, str(src), SCHEMA, files=1)
    out = run(incremental.latest_state(s), tmp_path / "cp", "update", "latest_state_test")
    assert {r.content_hash for r in out.filter("revisits = 1").collect()} == {"B"}


def test_sightings_once(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    row = {"entity_id": "e", "content_hash": "A", "observed_at": "2026-01-01T00:00:00Z"}
    feed(src, "1.json", [row, row])
    feed(src, "2.json", [row])
    s = incremental.file_stream(spark, str(src), SCHEMA, files=1)
    assert run(incremental.occurrences_once(s, ["entity_id", "content_hash"], "observed_at"), tmp_path / "cp", "append", "once_test").count() == 1


def test_budget_resets_by_window(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    feed(src, "1.json", [{"policy_id": "p", "at": f"2026-01-01T00:0{m}:00Z", "cost": 6.0} for m in (0, 1, 5)])
    s = incremental.file_stream(spark, str(src), "policy_id string, at timestamp, cost double")
    out = run(incremental.budget(s, 300, 10.0), tmp_path / "cp", "append", "budget_test").orderBy("at").collect()
    assert [(r.used, r.fits) for r in out] == [(0.0, True), (6.0, False), (0.0, True)]


def test_sink_adds_nothing_twice(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (1, "a"), (2, "b")], "id int, v string")
    write = incremental.sink_new(["id"], str(tmp_path / "out"))
    write(df, 0)
    write(df, 0)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2
