"""Fill-in-middle against slices of code points and exact round trips."""

import hashlib
import random
import re

import duckdb
from hypothesis import given, settings
from hypothesis import strategies as st

from attesta.llm import op11_middle
from attesta.llm.op11_middle import digests, ends, fill_in_middle, holds, nth_bit, transform
from tests.llm.corpus import documents


def brute(doc_id, text):
    text = text or ""
    h = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[i : i + 8], 16) for i in (0, 8, 16, 24))
    n = len(text)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    if not text or "<P>" in text or "<S>" in text or "<M>" in text or h3 % 100 >= 90:
        return n, "plain", None, None, text
    if h4 % 100 < 20:
        return n, "spm", a, b - a, f"<S>{text[b:]}<P>{text[:a]}<M>{text[a:b]}"
    return n, "psm", a, b - a, f"<P>{text[:a]}<S>{text[b:]}<M>{text[a:b]}"


@settings(max_examples=200, deadline=None)
@given(st.text(), st.integers(0, 10**6))
def test_one_text(text, doc_id):
    n, form, p, m, out = transform(str(doc_id), text.encode())
    assert (n, form, p, m, out.decode()) == brute(doc_id, text)


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="<>PSMx"), st.sampled_from([b"<P>", b"<S>", b"<M>"]))
def test_markers(text, marker):
    assert holds(text.encode(), marker) == (marker in text.encode())


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab \n\té"))
def test_words_are_units(text):
    marks = ends(text.encode(), "word")
    cuts = [nth_bit(marks, k, len(text.encode())) + 1 for k in range(marks.bit_count())]
    raw, at, found = text.encode(), 0, []
    for c in cuts:
        found.append(raw[at:c].decode())
        at = c
    assert "".join(found) == text
    assert found == re.findall(r"^\s+|\S+\s*", text)


def rows():
    rng = random.Random(5)
    texts = [None, "", "a", "é", "𝄞" * 50, "has <P> inside", "<S>", "almost <P", "M>", "x<" * 40, "äöü€𝄞\n" * 5000, "".join(chr(rng.choice([65, 228, 8364, 119070])) for _ in range(3000))]
    out = [(i * 7 + j, t) for j in range(7) for i, t in enumerate(texts)]
    return [*out, (None, "no id"), (None, None), (3, "again"), (3, "again")]


def test_whole_tables(spark):
    docs = spark.createDataFrame([(*r, "n", "x", 1) for r in rows()], "doc_id long, text string, n string, output string, form int")
    made = fill_in_middle(docs).collect()
    want = sorted(str((i, *brute(i, t))) for i, t in rows())
    assert sorted(str(tuple(r)) for r in made) == want
    found = digests(docs).collect()
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert sorted(map(str, map(tuple, found))) == sorted(str((i, n, f, p, m, sha(o), sha(t or ""))) for i, t in rows() for n, f, p, m, o in [brute(i, t)])
    con = duckdb.connect()
    con.register("documents", docs.select("doc_id", "text").toPandas().astype({"doc_id": "Int64"}))
    assert sorted(str(x) for x in con.sql(op11_middle.oracle()).fetchall()) == sorted(str(tuple(r)) for r in found)
    assert digests(docs.limit(0)).count() == 0


def test_random_corpus_and_other_units(spark):
    docs = documents(spark)
    assert sorted(str(tuple(r)) for r in fill_in_middle(docs).collect()) == sorted(str((r.doc_id, *brute(r.doc_id, r.text))) for r in docs.collect())
    plain = fill_in_middle(docs, fim_rate=0).filter("form <> 'plain'").count()
    assert plain == 0
    by_word = fill_in_middle(docs, unit="word", fim_rate=100, spm_rate=0).filter("form = 'psm'")
    whole = by_word.select(op11_middle.restored(by_word.output, by_word.form).alias("text")).collect()
    assert sorted(r.text for r in whole) == sorted(r.text for r in docs.filter("text <> ''").collect())
