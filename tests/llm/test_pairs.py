"""Jaccard join and substring dedup against brute force."""

import random

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from attesta.llm.components import components
from attesta.llm.op01_jaccard import jaccard_components, jaccard_links, keep_one
from attesta.llm.op06_substrings import MET, _alive, _covering, _had, _passages, _sets, cartesian_spans, cut_repeats, repeated_passages
from attesta.llm.textkit import Words, sorted_sets
from tests.llm.corpus import SCHEMA, documents, shingles, texts, tokens, words


def groups(items, linked):
    root = {i: i for i in items}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    items = sorted(items)
    for a in items:
        for b in items:
            if a < b and linked(a, b):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: find(i) for i in items}


@pytest.mark.parametrize("seed", [3, 11])
def test_components_equal_brute_force(spark, seed):
    sets = dict(enumerate(map(shingles, texts(seed))))
    want = groups(sets, lambda a, b: bool(sets[a] and sets[b]) and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]))
    got = jaccard_components(documents(spark, seed)).collect()
    assert len(got) == len(sets) + 1
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == {i: (len(sets[i]), want[i]) for i in sets}


def test_one_document_of_each_group_stays(spark):
    docs = documents(spark)
    kept = keep_one(docs)
    assert kept.columns == docs.columns
    want = {r.doc_id for r in jaccard_components(docs).collect() if r.doc_id == r.component_id}
    assert {r.doc_id for r in kept.collect()} == want


def test_empty_table_and_null_ids(spark):
    assert jaccard_components(spark.createDataFrame([], SCHEMA)).count() == 0
    assert repeated_passages(spark.createDataFrame([], SCHEMA)).count() == 0
    rows = spark.createDataFrame([(None, "a b c d e f"), (4, "a b c d e f"), (None, None)], "doc_id long, text string")
    assert sorted((r.doc_id or 0, r.n_shingles, r.component_id or 0) for r in jaccard_components(rows).collect()) == [(0, 0, 0), (0, 2, 4), (4, 2, 4)]


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(30)] + [(100, i) for i in range(101, 120)] + [(5, 5), (None, 3)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert all(got[i] == 0 for i in range(31)) and all(got[i] == 100 for i in range(100, 120))


def test_later_links_join_components(spark):
    from attesta.llm.op01_jaccard import _with_links

    roots = spark.createDataFrame([(2, 1), (1, 1), (5, 4), (4, 4), (12, 11), (11, 11)], "node long, root long")
    links = spark.createDataFrame([(2, 5), (9, 1), (7, 8)], "u long, v long")
    got = {r.node: r.root for r in _with_links(roots, links).collect()}
    assert got == {1: 1, 2: 1, 4: 1, 5: 1, 9: 1, 7: 7, 8: 7, 11: 11, 12: 11}
    assert _with_links(roots, links.limit(0)).count() == 6


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet="aAbBé \t\n\u00a0", max_size=40)), max_size=8))
def test_words_and_shingle_sets(column):
    w = Words(pa.array(column, pa.string()))
    assert w.count().tolist() == [len(tokens(t)) for t in column]
    _, at = sorted_sets(*w.shingles(5))
    assert np.diff(at).tolist() == [len(shingles(t)) for t in column]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.integers(0, 12), max_size=25), min_size=1, max_size=4), st.integers(2, 6))
def test_cartesian_spans(docs, least):
    h = np.array([x for d in docs for x in d], np.uint64)
    at = np.cumsum([0] + [len(d) for d in docs])
    want = set()
    for d, base in zip(docs, at.tolist(), strict=False):
        for i, v in enumerate(d):
            a = i
            while a > 0 and d[a - 1] > v:
                a -= 1
            b = i
            while b + 1 < len(d) and d[b + 1] >= v:
                b += 1
            if b - a + 1 >= least:
                want.add((base + i, base + a, base + b))
    c, a, b = cartesian_spans(h, at, least)
    assert set(zip(c.tolist(), a.tolist(), b.tolist(), strict=True)) == want


def test_every_repeated_passage_is_found(spark):
    docs = {i: tokens(t) for i, t in enumerate(texts())}
    found: dict[int, list] = {}
    for r in repeated_passages(documents(spark)).collect():
        assert r.source_doc_id < r.doc_id
        found.setdefault(r.doc_id, []).append((r.start_word, r.end_word))
    seen: dict[tuple, int] = {}
    for i, w in docs.items():
        own = {}
        for j in range(len(w) - 49):
            gram = tuple(w[j : j + 50])
            if gram in seen:
                assert any(s <= j and j + 50 <= e for s, e in found.get(i, [])), (i, j)
            own[gram] = i
        for g in own:
            seen.setdefault(g, i)
    clean = [i for i in range(60) if i % 5 and i != 7]
    assert not [i for i in clean if i in found]


def test_passages_are_cut_and_the_rest_stays(spark):
    docs = documents(spark)
    out = {r.doc_id: r.text for r in cut_repeats(docs).collect()}
    first, later = texts()[0], texts()[10]
    assert out[0] == first
    passage = " ".join(tokens(first)[32:92])
    assert passage in later and passage not in out[10] and out[10].split()[:20] == later.split()[:20]


def test_changed_words_in_the_middle_do_not_part_a_passage():
    def hits(*runs):  # lengths of runs, on and off in turn
        return np.repeat(np.arange(len(runs)) % 2 == 0, runs)

    assert _passages(hits(38, 10, 38)) == [(0, 85)]
    assert _passages(hits(18, 11, 18)) == [(0, 46)]
    assert _passages(hits(18, 10, 18)) == [(0, 45)]
    assert _passages(hits(0, 7, 1, 9, 1, 9, 1, 9, 38, 10, 38, 9, 1, 9, 1, 40))[0][1] >= 121
    assert _passages(hits(100, 30, 100)) == [(0, 99), (130, 229)]
    assert _passages(hits(300, 60, 1)) == [(0, 299)]
    assert _passages(hits(20, 20, 20, 20, 20)) == [] and _passages(hits(45)) == [] and _passages(hits(0, 50)) == []
    rng = np.random.default_rng(5)
    for _ in range(300):
        h = rng.random(160) < rng.choice([0.3, 0.7, 0.8])
        got = _passages(h)
        assert all(e - s >= 45 and h[s : e + 1].mean() >= 0.75 and h[s] and h[e] for s, e in got)
        any_ = any(h[i] and h[j] and h[i : j + 1].mean() >= 0.75 for i in range(115) for j in range(i + 45, 160))
        assert bool(got) == any_


def test_second_copy_in_one_document_is_found(spark):
    rng = random.Random(6)
    rows, want = [], []
    for i in range(20):
        passage = words(rng, 60)
        rows.append((2 * i, " ".join(words(rng, 50) + passage + words(rng, 50))))
        rows.append((2 * i + 1, " ".join(words(rng, 40) + passage + words(rng, 300) + passage + words(rng, 40))))
        want += [(2 * i + 1, 40, 100), (2 * i + 1, 400, 460)]
    got = repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert all(any(r.doc_id == d and r.start_word <= s and e <= r.end_word for r in got) for d, s, e in want)
    assert all(r.end_word - r.start_word < 75 for r in got)


def test_repeats_are_found_among_documents_that_share_a_part(spark):
    rng = random.Random(7)
    rows, want = [], []
    for i in range(20):
        passage = words(rng, 60)
        for j in range(12):
            mine = passage if j in (5, 11) else passage[:49]  # others come before and between
            rows.append((100 * i + j, " ".join(words(rng, 30) + mine + words(rng, 30))))
        want += [(100 * i + 11, s, s + 50) for s in range(30, 41)]
    got = repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert all(any(r.doc_id == d and r.start_word <= s and e <= r.end_word for r in got) for d, s, e in want)
    texts_ = dict(rows)
    for r in got:
        assert texts_[r.doc_id].encode()[r.start_byte : r.end_byte].decode() == " ".join(tokens(texts_[r.doc_id])[r.start_word : r.end_word])


def test_long_lists_that_are_split_give_the_same_components(spark):
    docs = documents(spark)
    want = {tuple(r) for r in jaccard_components(docs).select("doc_id", "component_id").collect()}
    rows, roots = jaccard_links(docs, long_list=1)
    ids = rows.filter("n > 0").join(roots.withColumnRenamed("node", "digest"), "digest", "left").selectExpr("doc_id", "coalesce(root, digest) as root")
    least = ids.groupBy("root").agg({"doc_id": "min"}).toDF("root", "component_id")
    got = {tuple(r) for r in ids.join(least, "root").select("doc_id", "component_id").collect()}
    assert got == {(d, c) for d, c in want if any(tokens(texts()[d]))}


def test_one_row_stays_of_rows_that_repeat(spark):
    w = words(random.Random(1), 30)
    a, b, c = " ".join(w), " ".join([*w, "more"]), " ".join(words(random.Random(2), 30))
    rows = [(1, a), (1, a), (1, c), (None, b), (None, a), (None, "alone in its group of words"), (None, "alone in its group of words"), (2, ""), (3, None), (2, "")]
    got = keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id or 0, r.text or "") for r in got) == sorted([(1, a), (1, c), (0, "alone in its group of words"), (2, ""), (3, "")])


def test_near_copies_of_passages_are_found(spark):
    rng = random.Random(8)
    rows, at = [], {}
    for i in range(150):
        passage = words(rng, 80)
        edited = list(passage)
        for j in rng.sample(range(10, 70), 2):
            edited[j] = f"edit{i}x{j}"
        rows += [(2 * i, " ".join(words(rng, 60) + passage + words(rng, 60))), (2 * i + 1, " ".join(words(rng, 30) + edited + words(rng, 90)))]
        at[2 * i + 1] = (30, 110)
    found = [r for r in repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    hit = {r.doc_id for r in found if r.start_word <= at[r.doc_id][0] + 15 and r.end_word >= at[r.doc_id][1] - 15}
    print("near copies found", len(hit), "of 150")
    assert len(hit) >= 0.9 * 150 and all(r.doc_id in at for r in found)


@pytest.mark.parametrize("between", [1, 2, 5])
def test_near_copies_among_others_that_share_a_part(spark, between):
    """Others before and between hold the first 40 of the 80 words, too few to be a passage of their own."""
    rng = random.Random(7)
    rows, want, k = [], [], 0
    for _ in range(100):
        p = words(rng, 80)
        q = list(p)
        for at in rng.sample(range(80), 2):
            q[at] = f"other{rng.randrange(10**6)}"
        bodies = [p[:40]] * between + [p] + [p[:40]] * between + [q]
        for body in bodies:
            k += 1
            around = words(rng, 60)
            rows.append((k, " ".join(around[:30] + body + around[30:])))
        want.append((k - between - 1, k))
    covered: dict = {}
    pairs = set()
    for r in repeated_passages(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect():
        covered.setdefault(r.doc_id, set()).update(range(r.start_word, r.end_word))
        pairs.add((r.source_doc_id, r.doc_id))
    assert sum(w in pairs for w in want) >= 90 and sum(len(covered.get(b, set()) & set(range(30, 110))) >= 60 for _, b in want) >= 90
    assert set(covered) <= {b for _, b in want}


@pytest.mark.parametrize("share", [50, 60])
def test_near_copies_among_many_that_share_most(spark, share):
    """Others before and between hold more than half of the passage, and of two parts in turn, so that both places of a group are theirs."""
    rng = random.Random(9)
    rows, want, k = [], [], 0
    for _ in range(60):
        p = words(rng, 90)
        q = list(p)
        for at in rng.sample(range(90), 2):
            q[at] = f"other{rng.randrange(10**6)}"
        others = [p[:share], p[90 - share :]] * 3
        for body in [*others, p, *others, q]:
            k += 1
            around = words(rng, 60)
            rows.append((k, " ".join(around[:30] + body + around[30:])))
        want.append((k - len(others) - 1, k))
    got = repeated_passages(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    covered: dict = {}
    for r in got:
        covered.setdefault(r.doc_id, set()).update(range(r.start_word, r.end_word))
    lost = [b for _, b in want if len(covered.get(b, set()) & set(range(30, 120))) < 80]
    print("lost", len(lost), "of 60")
    assert len(lost) <= 1


def test_a_passage_of_parts_that_many_share_is_found(spark):
    """Two phrases that stand in many documents each, together in one early and one late document only."""
    rng = random.Random(13)
    rows, want, k = [], [], 0
    for _ in range(40):
        a, b = words(rng, 30), words(rng, 30)
        for body in [a, b, a, b, a + b, a, b, a, b, a + b[:14] + ["changed"] + b[15:]]:
            k += 1
            around = words(rng, 60)
            rows.append((k, " ".join(around[:30] + body + around[30:])))
        want.append((k - 5, k))
    got = repeated_passages(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    found = {(r.source_doc_id, r.doc_id) for r in got if r.start_word <= 32 and r.end_word >= 85}
    print("found", sum(w in found for w in want), "of 40")
    assert sum(w in found for w in want) >= 39 and {r.doc_id for r in got} <= {b for _, b in want}


def test_the_rarest_shingles_are_in_each_passage():
    rng = np.random.default_rng(3)
    for _ in range(200):
        p = np.flatnonzero(rng.random(150) < rng.choice([0.8, 0.95, 1.0]))
        n, gram = rng.integers(1, 9, len(p)), rng.permutation(len(p)) + 1
        known = pa.array([[{"place": a, "gram": b, "n": c} for a, b, c in zip(p.tolist(), gram.tolist(), n.tolist(), strict=True)]], pa.list_(pa.struct([("place", pa.int64()), ("gram", pa.int64()), ("n", pa.int64())])))
        out = list(_alive(iter([pa.record_batch([pa.array([1]), known, pa.array([[0, 150]])], names=["doc_id", "known", "runs"])])))
        grams = set(out[0].column(2)[0].as_py()) if out else set()
        hit = np.zeros(150, bool)
        hit[p] = rng.random(len(p)) < rng.choice([0.7, 0.8, 0.9])
        for s, e in _passages(hit):
            assert len(grams & set(gram[(p >= s) & (p <= e) & hit[p]].tolist())) >= MET
            regions = out[0].column(1)[0].as_py()
            assert any(a <= s and e <= b for a, b in zip(regions[::2], regions[1::2], strict=True))


def test_only_what_passages_do_not_cover_is_sought():
    """Two thousand documents have a passage of 60 shingles, three the ten before it: the three are met, unless the passage isn't found yet."""
    place = list(range(70))
    known = pa.array([[{"place": i, "gram": 1000 + i, "n": 3 if i < 10 else 2000} for i in place]], pa.list_(pa.struct([("place", pa.int64()), ("gram", pa.int64()), ("n", pa.int64())])))

    def sought(held):
        batch = pa.record_batch([pa.array([1]), known, pa.array([[0, 24]]), pa.array([held], pa.list_(pa.int64()))], names=["doc_id", "known", "runs", "held"])
        return [(r["need"], sorted(r["grams"])) for b in _alive(iter([batch])) for r in b.to_pylist()]

    assert [x[0] for x in sought([])] == [MET]
    assert sought([10, 69]) == [(1, list(range(1000, 1010)))]
    assert sought([0, 30, 20, 69]) == [] and sought([0, 30, 35, 69]) == []  # no word between them
    assert sought([0, 20, 36, 69]) == [(1, list(range(1000, 1036)))]  # a passage may reach over the words between


def test_a_document_holds_a_repeated_shingle_once():
    class Wanted:
        value = bytes([255]) * (1 << 21)

    batch = pa.record_batch({"doc_id": pa.array([4, 5]), "text": ["a b c d e " * 50, "a b c d e"]})
    rows = [(r["gram"], r["doc_id"]) for b in _had(Wanted)(iter([batch])) for r in b.to_pylist()]
    assert len(rows) == len(set(rows)) == 6


def test_a_very_long_copy_is_one_passage(spark):
    rng = random.Random(10)
    long = words(rng, 100_000)
    rows = [(1, " ".join(words(rng, 100) + long)), (2, " ".join(long + words(rng, 100))), (3, None), (3, " ".join(long[:60]))]
    got = repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    covered = np.zeros(100_100, bool)
    for r in got:
        if r.doc_id == 2:
            covered[r.start_word : r.end_word] = True
    assert covered[:100_000].all() and not covered[100_005:].any() and any(r.doc_id == 3 and r.end_word - r.start_word == 60 for r in got)


def test_only_the_text_that_counts_is_cut(spark):
    rng = random.Random(12)
    passage, own, other = words(rng, 60), words(rng, 20), words(rng, 20)
    rows = [(1, " ".join(passage), 9, "k"), (2, " ".join(own + passage), 9, "k"), (2, " ".join(other), 9, "k"), (None, " ".join(passage), 9, "k"), (4, " ".join(passage), 9, "k"), (5, None, 9, "k")]
    out = cut_repeats(spark.createDataFrame(rows, "doc_id long, text string, n_chars long, spans string"))
    got = sorted((r.doc_id or 0, r.text or "", r.spans) for r in out.collect())
    kept = {" ".join(own), " ".join(own + passage)}
    assert [g[0] for g in got] == [0, 1, 2, 2, 5] and any(g[1] in kept for g in got) and (2, " ".join(other), "k") in got


def test_near_copies_are_cut_where_many_share_a_part(spark):
    rng = random.Random(17)
    rows, late = [], []
    for i in range(20):
        p = [f"w{i}x{j}" for j in range(90)]
        q = [*p[:41], "changed", *p[42:]]
        others = [p[:50], p[40:]] * 3
        for j, body in enumerate([*others, p, *others, q]):
            rows.append((100 * i + j, " ".join(words(rng, 30) + body + words(rng, 30))))
        late.append((100 * i + len(others) * 2 + 1, set(p[5:41] + p[42:85])))
    out = {r.doc_id: set(r.text.split()) for r in cut_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert sum(not out[d] & p for d, p in late) >= 19


def test_many_documents_that_have_a_passage_give_one_row():
    """Five hundred earlier documents have 60 of the shingles, one has 70: the open document gets that one's passage, not a row for each."""
    near = [{"doc_id": i, "grams": list(range(1000, 1060))} for i in range(500)] + [{"doc_id": 500, "grams": list(range(1000, 1070))}, {"doc_id": 900, "grams": list(range(1000, 1080))}]
    asks = {"doc_id": 700, "regions": [5, 84], "grams": list(range(1000, 1080)), "known": list(range(1000, 1080)), "need": 1, "places": list(range(5, 85)), "held": []}
    lists = pa.list_(pa.int64())
    opened = pa.Table.from_pylist([asks, {**asks, "doc_id": 701, "held": [5, 74]}], pa.schema({k: pa.int64() if k in ("doc_id", "need") else lists for k in asks}))
    got = _covering(None, opened, pa.Table.from_pylist(near, pa.schema({"doc_id": pa.int64(), "grams": lists}))).to_pylist()
    assert got == [{"doc_id": 700, "source_doc_id": 500, "start_word": 5, "end_word": 79}]


def test_a_document_of_one_repeated_shingle_is_kept():
    class Wanted:
        def __init__(self, byte):
            self.value = bytes([byte]) * (1 << 22)

    batch = pa.record_batch({"doc_id": pa.array([4, 5]), "text": ["a " * 200, " ".join(f"w{i}" for i in range(60))]})
    kept = lambda again: [(r["doc_id"], len(r["grams"])) for b in _sets(Wanted(255), Wanted(again))(iter([batch])) for r in b.to_pylist()]
    assert kept(0) == [(5, 56)] and kept(255) == [(4, 1), (5, 56)]


def test_shuffles_of_repeats_go_with_the_step_that_needs_them(spark, monkeypatch):
    from attesta.llm import op06_substrings as op6

    def shuffled():
        files = spark._jvm.scala.jdk.javaapi.CollectionConverters.asJava(spark.sparkContext._jsc.sc().env().blockManager().diskBlockManager().getAllFiles())
        return {f.getName(): f.length() for f in files if f.getName().startswith("shuffle_")}

    steps, stash = {}, op6.stash

    def watched(df, name):
        before = shuffled()
        out = stash(df, name)
        steps.setdefault(name, []).append(sum(n for f, n in shuffled().items() if f not in before))
        return out

    monkeypatch.setattr(op6, "stash", watched)
    assert repeated_passages(documents(spark, 3)).count() > 0
    # Windows lie on disk for some of the functions at once, and none stays behind its step.
    assert len(steps["met"]) == op6.ROUNDS > 1 and {n for of in steps.values() for n in of} == {0}


def test_rounds_have_each_window_once():
    from attesta.llm import op06_substrings as op6

    batch = pa.record_batch({"doc_id": pa.array(range(30), pa.int64()), "text": pa.array([" ".join(words(random.Random(i), 150)) for i in range(30)])})
    rows = lambda functions: [r for b in op6._windows(iter([batch]), functions) for r in zip(*(c.to_pylist() for c in b.columns[:3]), strict=True)]
    each = [rows(range(i, op6.FUNCTIONS, op6.ROUNDS)) for i in range(op6.ROUNDS)]
    assert sorted(sum(each, [])) == sorted(rows(range(op6.FUNCTIONS))) and max(map(len, each)) < 0.4 * sum(map(len, each))
