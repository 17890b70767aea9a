"""Language mixture, quality classifier, decontamination."""

import random

import numpy as np
import pytest
from pyspark.sql import DataFrame

from attesta.llm import op08_quality, prefilter
from attesta.llm.op02_language import has_letter, identify, languages
from attesta.llm.op04_decontaminate import Index, contaminated, keep_clean, split_item
from attesta.llm.op08_quality import fit, keep_good, quality
from attesta.llm.scratch import stash
from tests.llm.corpus import words

EN = "the of and to in is that for with this from are was not have they which their would there".split()
DE = "der die und das nicht ist ein eine mit für auf dem werden sich auch nach über können schön straße".split()


def prose(rng, vocabulary, n):
    return " ".join(rng.choice(vocabulary) for _ in range(n))


def test_languages_on_held_out_rows(spark):
    rng = random.Random(1)
    rows = [(i, prose(rng, EN if i % 2 else DE, rng.randrange(3, 60)), "en" if i % 2 else "de", "s", 7) for i in range(300)]
    rows += [(1000, None, "en", None, 0), (1001, "123 ### !!", "de", None, 0), (1002, "", None, None, 0), (1003, prose(rng, EN, 40) + " " + prose(rng, DE, 40), None, None, 0), (None, "the of and", "en", None, 0)]
    out = identify(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, score int")).collect()
    assert len(out) == len(rows)
    known = {r[0]: r[2] for r in rows[:300]}
    held = [r for r in out if r.held_out and r.doc_id in known]
    assert 40 < len(held) < 110 and sum(r.lang_pred == known[r.doc_id] for r in held) >= 0.97 * len(held)
    by = {r.doc_id: r for r in out}
    assert [by[i].lang_pred for i in (1000, 1001, 1002)] == ["und"] * 3 and by[1000].score == 0
    assert by[1003].n_langs == 2 and 0.3 < by[1003].score < 0.7
    assert all(0 <= r.score <= 1 for r in out)


def test_letters():
    assert [has_letter(t) for t in (None, "", "12 ½ ² ① Ⅷ _", "½a", "é", "中", "ª")] == [False] * 3 + [True] * 4


def test_mixtures_equal_those_of_a_plain_em():
    rng = np.random.default_rng(4)
    sizes = [0, 1, 5, 40, 200, 3]
    first = np.cumsum([0, *sizes])
    like = rng.random((first[-1], 4)) ** 4
    like[first[3] : first[4], 2] = 1
    like /= like.max(1, keepdims=True)

    def em(w, pi):
        pi = pi / pi.sum()
        while len(w) and (pi > 0).sum() > 1:
            r = w * pi
            new = (r / r.sum(1, keepdims=True)).mean(0)
            done = np.abs(new - pi).max() < 1e-3
            pi = new
            if done:
                break
        return pi, np.log((w * pi).sum(1)).sum()

    got = languages(like, first)
    for i, n in enumerate(sizes):
        w = like[first[i] : first[i + 1]]
        pi, ll = em(w, np.ones(4))
        while (pi > 0).sum() > 1:
            less = pi.copy()
            less[np.where(less > 0, less, 2).argmin()] = 0
            pi2, ll2 = em(w, less)
            if ll2 + 0.5 * np.log(max(n, 1)) < ll:
                break
            pi, ll = pi2, ll2
        assert got[i] == pytest.approx(pi, abs=1e-6)


def test_nothing_to_learn_is_undetermined(spark):
    rows = spark.createDataFrame([(1, "some text", None)], "doc_id long, text string, lang string")
    assert identify(rows).first().lang_pred == "und"
    assert identify(rows.limit(0)).count() == 0


def kneser_ney(texts):
    """Interpolated modified Kneser-Ney by dictionaries: a function of a four-gram of bytes."""
    counts = {4: {}}
    for t in texts:
        b = b"\0\0\0" + t.encode()
        for i in range(3, len(b)):
            g = b[i - 3 : i + 1]
            counts[4][g] = counts[4].get(g, 0) + 1
    for order in (3, 2, 1):
        counts[order] = {}
        for g in counts[order + 1]:
            counts[order][g[1:]] = counts[order].get(g[1:], 0) + 1
    off = {}
    for order, c in counts.items():
        n = [sum(v == i for v in c.values()) for i in range(1, 5)]
        y = n[0] / (n[0] + 2 * n[1]) if n[0] and n[1] else 0.5
        raw = [1 - 2 * y * n[1] / n[0] if n[0] else y, 2 - 3 * y * n[2] / n[1] if n[1] else 2 * y, 3 - 4 * y * n[3] / n[2] if n[2] else 3 * y]
        off[order] = [min(max(d, 0.05), i + 0.95) for i, d in enumerate(raw)]

    def p(gram):
        out = 1 / 256
        for order in (1, 2, 3, 4):
            g, c = gram[4 - order :], counts[order]
            own = {k: v for k, v in c.items() if k[:-1] == g[:-1]}
            if own:
                less = lambda v, order=order: off[order][min(v, 3) - 1]
                total = sum(own.values())
                out = (own[g] - less(own[g]) if g in own else 0) / total + sum(map(less, own.values())) / total * out
        return out

    return p


def test_probabilities_equal_those_by_dictionaries(spark):
    texts = ["abcabdabcaab" * 5, "bca cab", None, "", "größer über " * 4, "the cat sat on the mat. " * 3 + "the end"]
    model = fit(spark.createDataFrame([(t,) for t in texts], "text string"))
    p = kneser_ney([t for t in texts if t])
    rng = random.Random(3)
    grams = [g.encode() if isinstance(g, str) else g for g in ("abca", "bca ", " cat", "zzzz", "\0\0\0a", "e ca")] + [bytes(rng.choice(b"abcdet \xc3\xbc") for _ in range(4)) for _ in range(200)]
    code = np.array([int.from_bytes(g, "big") for g in grams])
    assert model.probability(code) == pytest.approx([p(g) for g in grams], rel=1e-5)
    for context in (b"xab", b"the", b"\0\0\0", b"\xff\xff\xff"):
        all_ = np.array([int.from_bytes(context + bytes([i]), "big") for i in range(256)])
        assert model.probability(all_).sum() == pytest.approx(1, abs=1e-4)


def test_junk_goes_and_clean_text_stays(spark):
    rng = random.Random(2)
    rows = [(i, prose(rng, EN, 80), "en") for i in range(200)] + [(500 + i, "".join(rng.choice("#$%&*XQZ!") for _ in range(300)), "en") for i in range(20)] + [(900, None, "en"), (901, "", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, 1, 0) for i in range(150)] + [(3, 1, 1), (None, 1, 0), (500, 0, 0)], "doc_id long, quality int, toxic int")
    out = {r.doc_id: r.keep for r in quality(docs, labels).collect()}
    assert len(out) == len(rows)
    assert sum(out[i] for i in range(200)) >= 198 and not any(out[500 + i] for i in range(20)) and not out[900] and not out[901]
    kept = keep_good(docs, labels)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {i for i, k in out.items() if k}
    assert all(r.keep for r in quality(docs.filter("text <> ''"), labels.limit(0)).collect())
    assert quality(docs.limit(0), labels).count() == 0


def test_the_quality_model_stays_rows(spark, monkeypatch):
    """Neither the model nor the scores pass through the driver: no n-gram is collected or broadcast from Python."""
    monkeypatch.setattr(DataFrame, "toArrow", lambda self: pytest.fail("collected"))
    model = fit(spark.createDataFrame([("abc abd abc",), ("cab",)], "text string"))
    assert isinstance(model.rows, DataFrame) and model.rows.columns == ["t", "code", "v"] and model.rows.count() > 20


def test_texts_are_not_shuffled_to_be_scored(spark, monkeypatch):
    """Texts are written once and read by block; those of the trusted are not shuffled either, and ids that a full bitmap lets through are no trusted ones."""
    rng = random.Random(6)
    rows = [(i, prose(rng, EN, 60), "en") for i in range(90)] + [(None, prose(rng, EN, 60), "en"), (90, "#$%&*XQZ!" * 30, "en"), (91, None, "en")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    labels = spark.createDataFrame([(i, 1, 0) for i in range(60)] + [(90, 0, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    plans = {}

    def written(df, name="part"):
        plans[name] = df._jdf.queryExecution().executedPlan().toString()
        return stash(df, name)

    monkeypatch.setattr(op08_quality, "stash", written)
    once = {r.doc_id: tuple(r) for r in quality(docs, labels).collect()}
    assert len(once) == len(rows) and not once[90][-1]
    assert "Bucketed: true" in plans["scored"] and "Exchange hashpartitioning(block" not in plans["scored"]
    monkeypatch.setattr(prefilter, "BITS", 15)
    monkeypatch.setattr(prefilter, "bitmap", lambda hashes, bits=15: b"\xff" * (1 << (bits - 3)))
    monkeypatch.setattr(op08_quality, "BLOCK_BYTES", 500)
    monkeypatch.setattr(op08_quality, "PAGE_BYTES", 200)
    assert {r.doc_id: tuple(r) for r in quality(docs, labels).collect()} == once


def test_wand_finds_what_a_full_scan_finds():
    rng = random.Random(4)
    items = [(i, " ".join(words(rng, rng.randrange(5, 40))) + ". " + " ".join(words(rng, 6)) + ".") for i in range(150)]
    for i in range(0, 150, 3):
        items[i] = (i, items[i][1] + " the of and the")
    ix = Index(items, 0.3)
    assert Index([], 0.3).search(np.zeros(0, int), 0.3) == []
    for _ in range(60):
        pick = rng.sample(range(len(ix.terms)), 60) + rng.sample(np.concatenate([np.searchsorted(ix.terms, np.unique(ix.terms))]).tolist(), 20)
        target = rng.randrange(150)
        own = [t for t in range(len(ix.terms)) if target in ix.docs[t]]
        terms = np.unique(np.array(pick + own[: rng.randrange(len(own) + 1)]))
        score = np.zeros(len(items))
        for t in terms:
            score[ix.docs[t]] += ix.impacts[t]
        got = dict(ix.search(terms, 0.3))
        want = {int(d): score[d] for d in np.flatnonzero(score >= 0.3 - 1e-9)}
        assert got.keys() == want.keys() and all(got[d] == pytest.approx(want[d]) for d in got)
        seen = terms[ix.essential[terms]]
        if want and len(seen):
            assert ix.likely(np.zeros(len(seen), np.int64), seen).tolist() == [0]


def test_planted_items_are_found_and_clean_documents_stay(spark):
    rng = random.Random(5)
    items = [(i, " ".join(words(rng, 25)) + ". " + " ".join(words(rng, 7)) + ".") for i in range(40)]
    clean = [" ".join(words(rng, rng.randrange(1, 400))) for _ in range(60)]
    docs = [(i, t) for i, t in enumerate(clean)]
    for i in range(20):
        w = clean[i].split()
        at = rng.randrange(len(w) + 1)
        docs.append((100 + i, " ".join(w[:at] + [items[i][1].upper() if i % 2 else items[i][1]] + w[at:])))
    docs += [(200, None), (201, ""), (202, items[5][1]), (202, items[5][1]), (203, items[6][1].split(".")[0][:40])]
    d = spark.createDataFrame(docs, "doc_id long, text string")
    b = spark.createDataFrame([*items, (77, None), (78, "  "), (None, "x y z")], "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in contaminated(d, b).collect()}
    assert got == {(100 + i, i) for i in range(20)} | {(202, 5)}
    assert {r.doc_id for r in keep_clean(d, b).collect()} == {i for i, _ in docs} - {i for i, _ in got}
    assert contaminated(d, b.limit(0)).count() == 0 and contaminated(d.limit(0), b).count() == 0


def test_blocks_of_items_do_not_change_the_result(spark):
    rng = random.Random(9)
    items = [(i, " ".join(words(rng, rng.randrange(6, 40))) + " of the. " + " ".join(words(rng, 5)) + ".") for i in range(60)]
    docs = [(i, " ".join(words(rng, 30)) + " " + items[i % 60][1] + " " + " ".join(words(rng, 3000 if i == 5 else 30))) for i in range(90)]
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    one, many = ({tuple(r) for r in contaminated(d, b, block_bytes=n).collect()} for n in (1 << 20, 3000))
    assert {r[:2] for r in one} >= {(i, i % 60) for i in range(90)}
    assert {(*r[:2], round(r[2], 9), *r[3:]) for r in one} == {(*r[:2], round(r[2], 9), *r[3:]) for r in many}


def test_answer_is_the_last_sentence():
    assert split_item("What is it? Forty two.") == ("What is it? ", "Forty two.")
    assert split_item("Only one sentence.") == ("Only one sentence.", "")


def test_items_with_short_questions_are_found(spark):
    pad = " ".join(f"pad{i}" for i in range(40))
    items = {1: "Why so? Because of the long winding river.", 2: "Stop. Nobody passes this gate before dawn.", 3: "Lonely words here", 4: "One two three four five? Seven eight nine."}
    docs = [(i, f"{pad} {t} {pad}") for i, t in items.items()] + [(i + 10, t) for i, t in items.items()]
    docs += [(21, f"{pad} so why? because of the long winding river. {pad}"), (22, pad)]
    out = contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(list(items.items()), "item_id long, text string")).collect()
    assert {(r.doc_id, r.item_id) for r in out} == {(i + at, i) for i in items for at in (0, 10)}
    assert all(r.question_overlap == 1 for r in out)
