"""Licenses, HTML, URL filter, packing, neighbours, pipeline and the registry."""

import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from attesta.llm import op03_licenses, op07_url_filter
from attesta.llm.op03_licenses import KNOWN, canonical, canonical_text, scan
from attesta.llm.op05_html import extract, parse, render
from attesta.llm.op07_url_filter import Cascade, judge
from attesta.llm.op09_packing import pack, pack_documents
from attesta.llm.op10_neighbours import neighbours
from tests.llm.corpus import documents, tokens


def test_license_texts_in_other_dress(spark):
    mit = KNOWN[8][1]
    rows = [(1, "Copyright (c) 2020 Someone\n\n" + mit.upper()), (2, mit.replace("sublicense", "sublicence").replace(",", " ,")), (3, mit + " extra"), (4, "text\nReleased under the MIT License.\nAll rights reserved\n"), (5, None), (6, ""), (4, "again"), (7, "x" * 100_000)]
    docs = spark.createDataFrame([(*r, "no") for r in rows], "doc_id long, text string, license string")
    out = scan(docs).collect()
    assert len(out) == len(rows)
    by = {(r.doc_id, r.notices): r for r in out}
    assert by[1, ""].license == "MIT" and by[2, ""].license == "MIT" and by[3, ""].license is None
    assert by[4, "MIT;reserved"].n_notices == 2 and by[5, ""].digest is None
    con = duckdb.connect()
    frame = docs.toPandas()
    con.register("documents", frame)
    want = sorted(map(str, con.sql(op03_licenses.oracle()).fetchall()))
    assert sorted(str((r.doc_id, r.digest, r.license, r.notices, r.n_notices)) for r in out) == want
    assert scan(docs.limit(0)).count() == 0


def test_every_line_and_every_list_counts(spark):
    rows = [(1, "Released under the MIT License." + " " * 3000), (2, "Use it freely."), (3, "before\r\nUse it freely\r\nafter"), (4, KNOWN[12][1].replace("\n", "\r\n")), (5, "Copyright 2020 Me\n" + KNOWN[14][1]), (6, "all\nrights reserved")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    by = {r.doc_id: r for r in scan(docs).collect()}
    assert by[1].notices == "MIT" and by[1].license == "MIT" and by[4].license == "BSD-2-Clause" and by[5].license == "Zlib" and by[6].license == "reserved"
    for known in ((("ZZ", "Use it freely."),), spark.createDataFrame([("ZZ", "use it, FREELY"), ("no", None)], "license string, text string")):
        by = {r.doc_id: (r.license, r.notices) for r in scan(docs, known=known).collect()}
        assert by[2] == ("ZZ", "ZZ") and by[3] == (None, "ZZ") and by[1] == (None, "")


def test_both_canonical_forms_agree(spark):
    df = spark.createDataFrame([(t,) for _, t in KNOWN], "t string")
    assert [r[0] for r in df.select(canonical(F.col("t"))).collect()] == [canonical_text(t) for _, t in KNOWN]


def test_html_layout():
    page = "<head><title>T</title><style>x</style><body><h1>A<p>one <b>two</b>\n three<br>four<p hidden>no<div style='DISPLAY: none'>no</div><ul><li>a<li>b<ol start=3><li>c</ol></ul><table><tr><th>Name<th>V<tr><td>alpha<td>1</table><pre> x\n  y</pre>&lt;end&gt;<script>no</script><!-- no -->"
    assert render(parse(page)).split("\n") == ["A", "", "one two three", "four", "", "- a", "- b", "", "  3. c", "", "Name  | V", "alpha | 1", "", " x", "  y", "", "<end>"]


PAGES = {
    "<table>loose<tr>text in row<td>a<td>b<tbody><div>in body</div><tr><form><td>q</td></form><td>r</table>": ["loosetext in row", "in body", "a | b", "q | r"],
    "<table><tr><td rowspan=2>A<td>b1<tr><td>b2<tr><td colspan=2>wide cell here<tr><td>x<td>y</table>": ["A | b1", "  | b2", "wide cell here", "x | y"],
    "<table><td>no row<td>two<tr><td>next</table>after": ["no row | two", "next", "", "after"],
    "<table><tr><td>a<table><tr><td>i1<td>i2</table><td>b</table>": ["a       | b", "i1 | i2 |"],
    "<textarea>a &amp; b</textarea><title>t &lt; u</title>": ["a & b"],
    "<div style='visibility:hidden'>no <b style='visibility: visible'>yes</b> no</div>": ["yes"],
    "<style>/* x */ .gone, #off { display:none } @media print { p { display: none } } i.dim{visibility:hidden}</style><p class='a gone'>no<p id=off>no<p>yes<i class=dim>no</i>": ["yes"],
    "<select><option>one<option selected>two<option>three</select> <select multiple><option>p<option>q</select>": ["two", "p", "q"],
    "<svg><title>no</title><text>label</text></svg> <math><mi>x</mi><mo>=</mo><mn>1</mn></math>": ["label x=1"],
}


@pytest.mark.parametrize("page", PAGES)
def test_all_visible_text_is_there(page):
    assert [x.rstrip() for x in render(parse(page)).split("\n")] == PAGES[page]


def test_every_word_of_a_broken_table_is_there():
    rng = random.Random(5)
    tags = ["<table>", "</table>", "<tr>", "</tr>", "<td>", "<td rowspan=3>", "<th colspan=2>", "</td>", "<tbody>", "<div>", "</div>", "<form>", "<p>", "<li>", "<caption>", "<span>", "</tbody>"]
    for _ in range(400):
        words_ = [f"w{i}" for i in range(rng.randrange(1, 25))]
        got = render(parse("".join(x for w in words_ for x in (*rng.choices(tags, k=rng.randrange(4)), f" {w} "))))
        assert sorted(x for x in got.replace("|", " ").split() if x != "-") == sorted(words_)


@pytest.mark.parametrize("page", ["<div>" * 5000, "<p " + 'a="' * 5000, "<" * 20000, "<!--" * 5000, "<ul><li>" * 3000, "<table>" * 3000, "</p>" * 5000, "&#x110000;&bogus;", "<a b='c>d", "<script>", "<td>x", "\x00<p>\x00"])
def test_html_that_is_broken(page):
    assert isinstance(render(parse(page)), str)


def test_html_rows(spark):
    df = spark.createDataFrame([(1, None, "a"), (2, "", "b"), (3, "<p>x", "c"), (3, "<p>x", "c"), (None, "<title>t</title>y", "d")], "page_id long, html string, text string")
    got = {(r.page_id, r.text) for r in extract(df).collect()}
    assert got == {(1, None), (2, ""), (3, "x"), (None, "y")} and extract(df.limit(0)).count() == 0


URLS = ["http://a.NET/x", "https://www.example.net/en/1?q", "https://example.net/de/", "http://example.com/de/p#f", "http://m.example.com/de", "http://x.org/fr/a", "http://org/fr/", "ftp://notnet/", "http://a.net", "http://a.net?x=/", "nothing", None, "", "http://spam-farm.example.org/en/", "http://www.spam-farm.example.org/fr/", "HTTP://Cheap-Pills.EXAMPLE.com/x", "http://my-spam-farm.example.org/", "a://b://c/d", "http://a.net:80/x", "http://é.org/fr/ü", "://h/p"]


def test_url_verdicts_equal_sql(spark):
    df = spark.createDataFrame([(i, u, "host") for i, u in enumerate(URLS)], "page_id long, url string, host string")
    con = duckdb.connect()
    frame = df.toPandas()
    con.register("pages", frame)
    want = sorted(map(str, con.sql(op07_url_filter.oracle()).fetchall()))
    out = judge(df).collect()
    assert sorted(str((r.page_id, r.host, r.path, r.rule, r.verdict)) for r in out) == want
    by = {r.page_id: r for r in out}
    assert (by[0].rule, by[1].rule, by[3].rule, by[5].rule, by[8].rule) == ("net/", "example.net/en/", "example.com/de/", "org/fr/", None)
    assert by[13].verdict == "block" and by[14].verdict == "allow" and by[15].verdict == "block" and by[16].verdict == "allow"
    assert judge(df.limit(0)).count() == 0


def test_a_listed_table_and_one_too_large_for_a_plan(spark):
    df = spark.createDataFrame([(i, f"http://a{i % 7}.b{i % 11}.org/x") for i in range(300)] + [(400, None)], "page_id long, url string")
    listed = spark.createDataFrame([("B3.org",), ("a5.b7.org",), ("other.net",), (None,)], "domain string")
    want = {i: "block" if i % 11 == 3 or i % 7 == 5 and i % 11 == 7 else "allow" for i in range(300)} | {400: "allow"}
    for size in (1 << 20, 1):
        assert {r.page_id: r.verdict for r in judge(df, listed=listed, filter_bytes=size).collect()} == want


@pytest.mark.parametrize("share", [0, 1, 3, 50, 100])
def test_cascade_is_exact(spark, share):
    u = spark.range(3000).select(F.concat(F.lit("h"), "id").alias("key"), (F.col("id") % 100 < share).alias("listed"))
    c = Cascade.build(u)
    assert u.filter(c.listed(F.col("key")) != F.col("listed")).count() == 0


def check_bins(rows, docs, capacity):
    rooms: dict[int, list] = {}
    for r in rows:
        if r.bin_id is not None:
            rooms.setdefault(r.bin_id, []).append(r)
    for members in rooms.values():
        assert sum(m.n_tokens for m in members) <= capacity
        spans = sorted((m.bin_offset, m.bin_offset + m.n_tokens) for m in members)
        assert all(a[1] <= b[0] for a, b in zip(spans, spans[1:], strict=False))
        sources = [docs[m.doc_id][1] for m in members if docs[m.doc_id][1] is not None]
        texts = [docs[m.doc_id][0] for m in members]
        assert len(set(sources)) == len(sources) and len(set(texts)) == len(texts)


def test_bins_hold_every_token_and_no_conflict(spark):
    df = documents(spark)
    docs = {r.doc_id: (tuple(tokens(r.text)), r.source) for r in df.collect()}
    rows = pack_documents(df, capacity=256).collect()
    check_bins(rows, docs, 256)
    total: dict[int, int] = {}
    for r in rows:
        total[r.doc_id] = total.get(r.doc_id, 0) + r.n_tokens
    assert total.pop(0) == 2 * len(docs[0][0])  # its row is there twice
    assert total == {i: len(w) for i, (w, _) in docs.items() if i}
    assert pack_documents(df.limit(0)).count() == 0


def test_given_clusters_part_near_copies(spark):
    df = spark.createDataFrame([(i, f"a b c d {i}", None) for i in range(40)] + [(7, "a b c d 7", None)], "doc_id long, text string, source string")
    bins = [r.bin_id for r in pack_documents(df, capacity=20, clusters=df.selectExpr("doc_id", "doc_id div 2 * 2 as component_id")).collect()]
    assert len(bins) == 41
    got: dict[int, list] = {}
    for r in pack_documents(df, capacity=20, clusters=df.selectExpr("doc_id", "doc_id div 2 * 2 as component_id")).collect():
        got.setdefault(r.bin_id, []).append(r.doc_id // 2)
    assert all(len(set(m)) == len(m) for m in got.values()) and len(got) >= 11


def test_best_fit_takes_the_tightest_compatible_bin():
    rng = random.Random(6)
    n = 400
    sizes = np.array(sorted((rng.randrange(1, 60) for _ in range(n)), reverse=True))
    sources = np.array([rng.randrange(5) if rng.random() < 0.7 else 1 for _ in range(n)])
    clusters = np.array([rng.choice([0, 0, 0, 1, 2, 70]) for _ in range(n)])
    got = pack(sizes, sources, clusters, 100)
    bins: list = []
    for i in range(n):
        fit = [(left, k) for k, (left, s, c) in enumerate(bins) if left >= sizes[i] and (not sources[i] or sources[i] not in s) and (not clusters[i] or clusters[i] not in c)]
        chosen = bins[got[i]][0] if got[i] < len(bins) else None
        assert chosen == min(fit)[0] if fit else got[i] == len(bins)
        if got[i] == len(bins):
            bins.append([100, set(), set()])
        bins[got[i]][0] -= sizes[i]
        bins[got[i]][1].add(sources[i])
        bins[got[i]][2].add(clusters[i])


def test_neighbours_in_all_lists_are_exact(spark):
    rng = np.random.default_rng(3)
    v = rng.normal(size=(300, 8)).astype(np.float32)
    v[50:120] = v[50]
    rows = [(i, [float(x) for x in v[i]], 0) for i in range(300)]
    rows += [(1000, None, 0), (1001, [0.0] * 8, 0), (1002, [1.0, None] + [0.0] * 6, 0), (1003, [float("nan")] * 8, 0), (1004, [float("inf")] + [0.0] * 7, 0), (1005, [1.0], 0), (None, [1.0] * 8, 0), rows[3]]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, score int")
    out: dict[int, list] = {}
    near = {(r.query_id, r.vec_id) for r in neighbours(df, df.filter("vec_id % 20 = 0")).collect()}
    for r in neighbours(df, df.filter("vec_id % 20 = 0"), reach=float("inf"), most_read=10**9).orderBy("query_id", "rank").collect():
        out.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    x = v.astype(np.float64)
    assert sorted(out) == list(range(0, 300, 20))
    for q, got in out.items():
        s = (x * x[q]).sum(1)
        s[q] = -np.inf
        want = np.lexsort((np.arange(300), -s))[:20]
        assert [g[1] for g in got] == want.tolist() and [g[0] for g in got] == list(range(1, 21))
        assert np.allclose([g[2] for g in got], s[want], rtol=1e-12)
    assert len(near) == 300 and len(near & {(q, g[1]) for q, got in out.items() for g in got}) >= 0.9 * 300
    twice = spark.createDataFrame([(1, [1.0, 0.0]), (1, [0.0, 5.0]), (2, [0.0, 1.0])], "vec_id long, embedding array<double>")
    assert [(r.query_id, r.vec_id, r.score) for r in neighbours(twice, twice).orderBy("query_id").collect()] == [(1, 2, 5.0), (2, 1, 5.0)]
    few = df.filter("vec_id < 5")
    assert neighbours(few, few).count() == 20 and neighbours(df.limit(0), df.limit(0)).count() == 0


def test_recall_over_lists(spark):
    rng = np.random.default_rng(4)
    centers = rng.normal(size=(40, 16))
    v = (centers[rng.integers(0, 40, 4000)] + 0.4 * rng.normal(size=(4000, 16))).astype(np.float32)
    df = spark.createDataFrame([(i, [float(x) for x in v[i]]) for i in range(4000)], "vec_id long, embedding array<float>")
    got: dict[int, set] = {}
    for r in neighbours(df, df.filter("vec_id % 20 = 0")).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    x = v.astype(float)
    hits = 0
    for q, mine in got.items():
        s = x @ x[q]
        s[q] = -np.inf
        hits += len(mine & set(np.argsort(-s)[:20].tolist()))
    assert len(got) == 200 and hits / (20 * 200) >= 0.9


def test_recall_with_norms_that_differ(spark):
    rng = np.random.default_rng(8)
    n = 20_000
    v = rng.normal(size=(n, 16))
    v *= np.exp(rng.uniform(-1.15, 1.15, (n, 1))) / np.sqrt((v * v).sum(1, keepdims=True))  # a factor of ten
    df = spark.createDataFrame([(i, x) for i, x in enumerate(v.tolist())], "vec_id long, embedding array<double>")
    got: dict[int, set] = {}
    for r in neighbours(df, df.filter("vec_id % 100 = 0")).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    hits = 0
    for q, mine in got.items():
        s = v @ v[q]
        s[q] = -np.inf
        hits += len(mine & set(np.argsort(-s)[:20].tolist()))
    print("recall", hits / (20 * len(got)))
    assert len(got) == n // 100 and hits / (20 * len(got)) >= 0.9


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline

    df = documents(spark)
    df.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, 0) for i in range(90)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, " ".join(tokens(df.filter("doc_id = 4").first().text)[:30]))], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = df
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == df.columns
        docs = spark.createDataFrame(docs.collect(), df.schema)
    out = corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).collect()
    assert {r.doc_id for r in out} == {r.doc_id for r in docs.collect()}
    run = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted((r.doc_id, r.n_tokens) for r in run) == sorted((r.doc_id, r.n_tokens) for r in out)


def test_pipeline_of_odd_and_of_no_rows(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(3)
    long = " ".join(f"word{rng.randrange(10**6)}" for _ in range(30_000))
    rows = [(1, long, "en", "s", 0, "k"), (1, long, "en", "s", 0, "k"), (None, long, None, None, 0, "k"), (2, None, "en", "s", 0, "k"), (3, "", None, "s", 0, "k"), (None, "a text of its own without an id", None, None, None, "k")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, key string")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = df
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = spark.createDataFrame(stage(spark, docs, str(tmp_path)).select(df.columns).collect(), df.schema)
        assert stage(spark, df.limit(0), str(tmp_path)).count() == 0
    assert sorted((r.doc_id or 0, r.text, r.key) for r in docs.collect()) == [(0, "a text of its own without an id", "k"), (1, long, "k")]
    packed = corpus_pipeline.STAGES[-1][1]
    assert packed(spark, docs, str(tmp_path)).agg(F.sum("n_tokens")).first()[0] == 30_008 and packed(spark, df.limit(0), str(tmp_path)).count() == 0


def test_registry_has_each_operator():
    import __spark_entry__

    names = __spark_entry__.queries()
    assert "pipeline" in names and all(sum(n.startswith(f"op{i}_") for n in names) == 1 for i in range(1, 11))


def _wrapped(text, width=70):
    import textwrap

    return "\n\n".join(textwrap.fill(p, width) for p in text.split("\n\n"))


def test_license_files_as_they_are_distributed(spark):
    by_name = {n: t for n, t in KNOWN if len(t) > 400}
    mit, bsd2, bsd3, isc = by_name["MIT"], by_name["BSD-2-Clause"], by_name["BSD-3-Clause"], by_name["ISC"]
    comment = lambda mark, t: "\n".join(f"{mark} {x}".rstrip() for x in t.split("\n"))
    rows = [
        (1, "MIT License\n\nCopyright (c) 2021 Some One\n\n" + _wrapped(mit, 78)),
        (2, "The MIT License (MIT)\n=====================\n\nCopyright © 2015-2020 A, B and C\n\n" + _wrapped(mit)),
        (3, "Copyright (c) 2001, The Authors\nAll rights reserved.\n\n" + _wrapped(bsd2)),
        (4, "BSD 3-Clause License\n\nCopyright 2019 X. All rights reserved.\n\n" + _wrapped(bsd3, 60)),
        (5, "ISC License\n\nCopyright 2020 Y\n\n" + _wrapped(isc, 66)),
        (6, comment("#", "Copyright 2020 Z\n\n" + _wrapped(mit))),
        (7, comment("//", "Copyright (C) 2020 Z\n" + by_name["GPL-3.0"])),
        (8, "/*\n" + comment(" *", "Copyright 2020 Z\n\n" + _wrapped(bsd2)) + "\n */\n"),
        (9, _wrapped(mit).replace("without restriction", "with restrictions")),
        (10, "MIT License"),
        (11, "Notes on the text\n" + mit),
        (12, "Copyright law is what this document is about.\n" + mit),
        (13, "MIT License\nAll rights reserved."),
    ]
    assert any(line.startswith("copyright notice") for t in (rows[4][1],) for line in t.lower().split("\n")) or "copyright notice" in rows[4][1]
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, digest string, place int")
    got = {r.doc_id: r.license for r in scan(docs).collect()}
    want = {1: "MIT", 2: "MIT", 3: "BSD-2-Clause", 4: "BSD-3-Clause", 5: "ISC", 6: "MIT", 7: "GPL-3.0", 8: "BSD-2-Clause"}
    assert got == {i: want.get(i) for i, _ in rows}
    con = duckdb.connect()
    con.register("documents", docs.toPandas())
    assert {r[0]: r[2] for r in con.sql(op03_licenses.oracle()).fetchall()} == got
    table = spark.createDataFrame(list(KNOWN), "license string, text string")
    assert {r.doc_id: r.license for r in scan(docs, known=table).collect()} == got


def test_published_license_files(spark):
    import os

    folder = "/usr/share/common-licenses"
    names = {"Apache-2.0": "Apache-2.0", "GPL-3": "GPL-3.0", "GPL-2": "GPL-2.0", "LGPL-2.1": "LGPL-2.1", "LGPL-3": "LGPL-3.0", "MPL-2.0": "MPL-2.0"}
    if not all(os.path.exists(f"{folder}/{n}") for n in names):
        pytest.skip("no license files here")
    texts = {n: open(f"{folder}/{n}", encoding="utf-8").read() for n in names}
    rows = list(enumerate(texts.values())) + [(10, texts["Apache-2.0"].replace("[yyyy] [name of copyright owner]", "2024 A Company")), (11, texts["GPL-3"].replace("\n", "\r\n").upper()), (12, texts["MPL-2.0"] + "one more word")]
    got = {r.doc_id: r.license for r in scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {**dict(enumerate(names.values())), 10: "Apache-2.0", 11: "GPL-3.0", 12: None}
