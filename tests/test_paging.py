from pyspark.sql import functions as F

from attesta.operators import paging, search, storage


def versions(spark):
    at = F.timestamp_micros(F.lit(1791244800000000).cast("long") + F.col("id"))
    return spark.range(23).select(F.format_string("%02d", "id").alias("id"), at.alias("observed_at"))


def test_keyset_pages_meet_without_gap(spark):
    df = versions(spark)
    one = paging.keyset_desc(df, "observed_at", "id").collect()
    two = paging.keyset_desc(df, "observed_at", "id", (one[-1].observed_at, one[-1].id)).collect()
    assert [r.id for r in one + two] == [f"{i:02d}" for i in range(22, -1, -1)]


def test_cursor_has_microseconds(spark):
    assert versions(spark).filter("id = '07'").select(paging.cursor_text(F.col("observed_at"))).first()[0].endswith(".000007Z")


def test_offset_page_and_sentinel(spark):
    df = spark.range(45)
    assert {r.next_offset for r in paging.offset_page(df, ["id"], 20).collect()} == {40}
    last = paging.offset_page(df, ["id"], 40).collect()
    assert [r.id for r in last] == list(range(40, 45)) and {r.next_offset for r in last} == {None}


def test_chunks_join_to_the_text(spark):
    text = "é" * 19_000 + "end"
    out = paging.text_chunks(spark.createDataFrame([(1, text)], "id int, text string"), "text", 8000).orderBy("chunk_no").collect()
    assert "".join(r.chunk for r in out) == text and len(out) == 3


def test_incomplete_history_is_said_to_be(spark):
    assert paging.bounded_history(spark.range(201), ["id"])[1] is False
    assert paging.bounded_history(spark.range(200), ["id"])[1] is True


def test_blocks_page_has_stubs(spark):
    df = spark.createDataFrame([(1, ["a", "b" * 40_000, "c"])], "id int, blocks array<string>")
    out = paging.blocks_page(df, "blocks", 1, 2).orderBy("ordinal").collect()
    assert [(r.ordinal, r.stub) for r in out] == [(2, True), (3, False)]


def test_search_wildcards_and_tokens(spark):
    df = spark.createDataFrame([(1, "Alpha beta"), (2, "alphabet")], "id int, t string")
    assert df.filter(search.contains(F.col("t"), "a_p")).count() == 2
    assert [r.id for r in df.filter(search.has_all(F.col("t"), "BETA alpha")).collect()] == [1]
    assert df.filter(search.has_all(F.col("t"), "...")).count() == 0


def test_excerpt_begins_before_the_match(spark):
    df = spark.createDataFrame([(1, "x" * 500 + "needle" + "y" * 2000)], "id int, t string")
    out = search.search_documents(df, "id", "t", "NEEDLE").first()
    assert len(out.excerpt) == 800 and out.excerpt.index("needle") == 120 and out.length == 2506


def test_owners_do_not_share_blobs(spark):
    df = spark.createDataFrame([("a", "ü"), ("a", "ü"), ("b", "ü")], "owner_id string, content string")
    out = {r.owner_id: (r.files, r.blobs, r.preserved_bytes, r.saved_bytes) for r in storage.dedup_savings(df, ["owner_id"], "content").collect()}
    assert out == {"a": (2, 1, 4, 2), "b": (1, 1, 2, 0)}


def test_parts_come_together_in_order(spark):
    import hashlib

    whole = bytes(range(200))
    digest = hashlib.sha256(whole).hexdigest()
    df = spark.createDataFrame([("f", 1, whole[100:], digest), ("f", 0, whole[:100], digest)], "f string, n int, part binary, sha string")
    r = storage.reassembled(df, "f", "n", "part", "sha").first()
    assert r.intact and bytes(r.content) == whole


def test_compaction_keeps_bytes_that_do_not_match(spark):
    import hashlib

    good = hashlib.sha256(b"abc").hexdigest()
    df = spark.createDataFrame([("o", "1", good, 3, b"abc", None), ("o", "2", good, 3, b"abd", None)], "owner_id string, id string, sha256 string, bytes long, inline_content binary, blob_sha256 string")
    files, blobs = storage.compacted(df)
    assert blobs.count() == 1
    assert {r.id: (r.blob_sha256 is not None, r.inline_content is None) for r in files.collect()} == {"1": (True, True), "2": (False, False)}
