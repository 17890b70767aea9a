import io
import zipfile

from pyspark.sql import functions as F

from attesta.sources import captures, documents, staging
from attesta.tables import Tables, optional

W = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"


def docx(body: str) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="{W}"><w:body>{body}</w:body></w:document>')
    return out.getvalue()


def p(text: str, style: str = "") -> str:
    return f'<w:p><w:pPr>{f"""<w:pStyle w:val="{style}"/>""" if style else ""}</w:pPr><w:r><w:t>{text}</w:t></w:r></w:p>'


def test_docx_and_html_by_signature(spark):
    raw = docx(p("Top", "Heading1") + p("Body") + f"<w:tbl><w:tr><w:tc>{p('cell')}</w:tc></w:tr></w:tbl>")
    html = b"<h2>T</h2><p onclick='x()'>a <b>b</b><script>no()</script></p><ul><li>i</ul>"
    df = spark.createDataFrame([(1, raw), (2, html), (3, b"PKbroken"), (4, None)], "id int, content binary")
    out = {r.id: r.x for r in df.select("id", documents.document_blocks("content").alias("x")).collect()}
    assert [(b.kind, b.level, b.text) for b in out[1].blocks] == [("heading", 1, "Top"), ("paragraph", 0, "Body"), ("cell", 0, "cell")]
    assert [(b.kind, b.text) for b in out[2].blocks] == [("heading", "T"), ("paragraph", "a b"), ("list_item", "i")]
    assert out[2].removed == {"event_handler": 1, "script": 1}
    assert out[3].coverage == "parsing_error" and out[4].coverage == "unavailable"


def test_doctype_and_unsafe_names_are_refused(spark):
    evil = io.BytesIO()
    with zipfile.ZipFile(evil, "w") as z:
        z.writestr("word/document.xml", "<!DOCTYPE x><a/>")
    up = io.BytesIO()
    with zipfile.ZipFile(up, "w") as z:
        z.writestr("../x", "a")
    assert documents.docx_document(evil.getvalue())["status"] == "doctype"
    assert documents.docx_document(up.getvalue())["status"] == "unsafe_names"


def test_envelope_shapes(spark):
    df = spark.createDataFrame([('[{"id":1}]',), ('{"items":[{"id":2}]}',), ('{"odd":1}',), ("not json",)], "r string")
    out = df.select(captures.unwrapped(F.col("r"), "items", "id:long").alias("x")).select("x.coverage", F.size("x.items").alias("n")).collect()
    assert [(r.coverage, r.n if r.coverage == "complete" else 0) for r in out] == [("complete", 1), ("complete", 1), ("parsing_error", 0), ("parsing_error", 0)]


def test_ingest_is_idempotent(spark):
    response = '[{"id":1,"name":"S","modules":[{"id":7,"name":"M","modname":"page","instance":3,"contents":[]}]},{"id":2,"name":"Empty","modules":[]}]'
    cap = spark.createDataFrame([("contents", '{"courseid":42}', response)], "function string, params string, response string").withColumn("captured_at", F.to_timestamp(F.lit("2026-01-01")))
    e, o, r = captures.projected(captures.course_contents(cap.union(cap)), "o", "c")
    assert (e.count(), o.count(), r.count()) == (3, 3, 1)


def test_posts_are_chosen_before_they_are_cut(spark):
    response = '{"posts":[' + ",".join(f'{{"id":{i},"parentid":{0 if i < 3 else 1},"author":{{"id":9}},"timecreated":{i}}}' for i in range(1, 6)) + "]}"
    cap = spark.createDataFrame([("posts", '{"discussionid":5}', response)], "function string, params string, response string").withColumn("captured_at", F.current_timestamp())
    out = captures.posts(cap, 0, 1, roots_only=True).collect()
    assert [(r.post_id, r.truncated) for r in out] == [(1, True)]


def test_staging_findings(spark, tmp_path):
    (tmp_path / "a.md").write_text("see https://x.y/z.\nsecond\r\n")
    (tmp_path / "b.bin").write_bytes(b"\xff\xfe\x00")
    inv = staging.inventory(documents.read_files(spark, str(tmp_path)), tmp_path.name)
    rows = {r.path: r for r in inv.collect()}
    assert rows["a.md"].eol == "mixed" and rows["a.md"].lines == 2 and rows["a.md"].links == ["https://x.y/z"] and rows["b.bin"].encoding == "binary"
    want = spark.createDataFrame([("a.md", "0" * 64, "x"), ("gone", "1" * 64, "y")], "path string, sha256 string, git_blob string")
    assert {r.path: r.finding for r in staging.verify(want, inv).collect()} == {"a.md": "corrupted", "gone": "missing", "b.bin": "extra"}


def test_export_redacts_and_leaves_secret_paths_out(spark, tmp_path):
    (tmp_path / "ok.txt").write_text("password = hunter2hunter2hunter2")
    (tmp_path / ".env").write_text("x")
    out = staging.export(staging.inventory(documents.read_files(spark, str(tmp_path)), tmp_path.name)).collect()
    assert [(r.path, bytes(r.content)) for r in out] == [("ok.txt", b"password = [REDACTED]")]


def test_tenants_do_not_see_each_other(spark, tmp_path):
    spark.createDataFrame([("a", 1), ("b", 2)], "owner_id string, v int").write.parquet(f"{tmp_path}/t.parquet")
    assert [r.v for r in Tables(spark, str(tmp_path), "a").t.collect()] == [1]
    assert optional(Tables(spark, str(tmp_path)).t, owner_id=None, v=2).count() == 1


def test_extraction_is_done_once_per_version(spark):
    df = spark.createDataFrame([("f1", b"<p>a</p>"), ("f2", b"<p>a</p>"), ("f3", b"<p>b</p>")], "path string, content binary").withColumn("sha256", F.sha2("content", 256))
    none = spark.createDataFrame([], "sha256 string, version string").select("sha256", "version", documents.document_blocks(F.lit(b"")).alias("extracted"))
    first = documents.extract_new(df, none, "1").cache()
    assert first.count() == 2
    again = documents.extract_new(df, first.drop("reused"), "1")
    assert {r.reused for r in again.collect()} == {True}


def test_cells_know_their_place_and_archives_their_kind(spark):
    cell = lambda t, span=1: f'<w:tc><w:tcPr><w:gridSpan w:val="{span}"/></w:tcPr>{p(t)}</w:tc>'
    raw = docx(f"<w:tbl><w:tr>{cell('a', 2)}{cell('b')}</w:tr><w:tr>{cell('c')}</w:tr></w:tbl>")
    assert [(b[3], b[4]) for b in documents.docx_document(raw)["blocks"]] == [("a", "table:1/row:1/column:1"), ("b", "table:1/row:1/column:3"), ("c", "table:1/row:2/column:1")]
    other = io.BytesIO()
    with zipfile.ZipFile(other, "w") as z:
        z.writestr("xl/workbook.xml", "x")
        z.writestr("xl/vbaProject.bin", "x")
    df = spark.createDataFrame([(raw,), (other.getvalue(),), (b"no zip",)], "c binary")
    assert [r[0] for r in df.select(documents.office_kind("c")).collect()] == ["docx", "xlsx_macro", "unreadable"]


def test_staging_is_idempotent_and_repairs(spark):
    import hashlib

    import pytest

    sha = lambda b: hashlib.sha256(b).hexdigest()
    inv = spark.createDataFrame([("a", sha(b"1"), "cas/1", b"1"), ("b", sha(b"1"), "cas/1", b"1"), ("c", sha(b"2"), "cas/2", b"2")], "path string, sha256 string, cas_path string, content binary")
    store = spark.createDataFrame([(sha(b"2"), "cas/2", b"damaged")], "sha256 string, cas_path string, content binary")
    once = staging.staged(inv, store)
    assert {bytes(r.content) for r in once.collect()} == {b"1", b"2"} and staging.new_blobs(inv, once).count() == 0
    manifest = inv.select("path", "sha256").withColumn("batch_id", F.lit("x"))
    assert staging.restored(manifest, once, "x").count() == 3
    with pytest.raises(ValueError, match="not restorable"):
        staging.restored(manifest, store, "x")
    with pytest.raises(ValueError, match="another batch"):
        staging.restored(manifest, once, "y")
    cur = spark.createDataFrame([("r1", "note", "Text", ["a", "missing"])], "record_id string, kind string, text string, refs array<string>")
    entities, _, relations = staging.imported(manifest, cur, "o", "c")
    assert entities.count() == 4 and relations.count() == 1


def test_reads_resume_within_budget(spark):
    from attesta.streaming import resume

    forums = spark.createDataFrame([("c", 0, "f", 2), ("c", 1, "g", 3), ("d", 0, "h", 1)], "course_id string, position int, forum_id string, pages int")
    none = spark.createDataFrame([], "course_id string, position int, forum_id string, next_page int")
    first = resume.next_reads(forums, none, 3)
    assert [(r.forum_id, r.page) for r in first.filter("course_id = 'c'").orderBy("call").collect()] == [("f", 0), ("f", 1), ("g", 0)]
    state = resume.checkpoint(forums, first, none)
    assert {r.course_id: (r.forum_id, r.next_page, r.completed) for r in state.collect()} == {"c": ("g", 1, False), "d": ("h", 1, True)}
    again = resume.next_reads(forums, state.filter("not completed").drop("completed"), 3)
    assert [(r.forum_id, r.page) for r in again.filter("course_id = 'c'").orderBy("call").collect()] == [("g", 1), ("g", 2)]
    moved = spark.createDataFrame([("c", 0, "g", 3), ("c", 1, "f", 2)], "course_id string, position int, forum_id string, pages int")
    assert resume.next_reads(moved, state.drop("completed"), 9).count() == 5
