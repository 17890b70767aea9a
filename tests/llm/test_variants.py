"""Spelling variants against all pairs and against SQL."""

import random
import re
import zlib
from collections import Counter

import duckdb
import pytest

from attesta.llm import op12_variants
from attesta.llm.op12_variants import near_words, spelling_variants

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def counted(rows, min_length=7, min_count=2, drop=31):
    n = Counter()
    for i, t in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = run.translate(LOW)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if drop and h % drop == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += 1
    return {w: c for w, c in n.items() if len(w) >= min_length and c >= min_count}


def brute(rows, times=10, **options):
    n = counted(rows, **options)
    near = {w: [v for v in n if abs(len(v) - len(w)) < 2 and one_edit(v, w)] for w in n}
    form = {}
    for w, found in near.items():
        best = min(found, key=lambda v: (-n[v], v), default=None)
        form[w] = best if best is not None and n[best] >= times * n[w] else None
    out = []
    for w in n:
        root = w
        while form[root] is not None:
            root = form[root]
        out.append((w, n[w], len(near[w]), form[w], n[form[w]] if form[w] else None, root))
    return sorted(map(str, out))


def spelt(seed=2, size=120):
    """Documents of a few stems and their misspellings, common and rare, with letters beyond ASCII."""
    rng = random.Random(seed)
    stems = ["".join(rng.choice("aeioubcdlmnrstüßñ×Àÿ") for _ in range(rng.randrange(6, 13))) for _ in range(25)] + ["abababab", "aaaaaaa", "aaaaaaaa", "mississippi"]
    rows = []
    for i in range(size):
        words = []
        for _ in range(60):
            w = list(rng.choice(stems[: rng.choice([3, 29])]))
            for _ in range(rng.choice([0, 0, 0, 1, 1, 2])):
                at = rng.randrange(len(w))
                w[at : at + rng.choice([0, 1, 1])] = rng.choice(["", "a", "ü", "z"])
            words.append("".join(w).title() if rng.random() < 0.2 else "".join(w))
        rows.append((i, rng.choice([" ", ", ", "1", "\n"]).join(words)))
    long_ = "x" * 300
    rows += [(i, f"{long_} {long_[:-1]} {long_[1:]}y {long_[:150]}z{long_[150:]}") for i in (5000, 5001)]
    return [*rows, (None, rows[0][1]), (None, None), (7000, ""), (7001, None), rows[1], rows[1], (7002, "ab cd 123 ĀbcdefghĀ İstanbul" * 2)]


@pytest.mark.parametrize("long_list", [1 << 10, 0])
def test_against_all_pairs(spark, long_list):
    rows = spelt()
    docs = spark.createDataFrame([(*r, "w", 1) for r in rows], "doc_id long, text string, word string, n int")
    found = spelling_variants(docs, long_list=long_list)
    assert found.columns == ["word", "n", "n_near", "form", "form_n", "root"]
    assert sorted(str(tuple(r)) for r in found.collect()) == brute(rows)


def test_sql_agrees(spark):
    rows = [r for r in spelt(seed=4, size=40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    con = duckdb.connect()
    con.register("documents", docs.toPandas().astype({"doc_id": "Int64"}))
    assert sorted(str(x) for x in con.sql(op12_variants.oracle()).fetchall()) == sorted(str(tuple(r)) for r in spelling_variants(docs).collect()) == brute(rows)
    assert spelling_variants(docs.limit(0)).count() == 0


def test_options_and_chains(spark):
    rows = [(i, " ".join(["abcdefgh"] * 1000 + ["abcdefgx"] * 100 + ["abcdefyx"] * 10 + ["abcdezyx"])) for i in range(2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    by = {r.word: r for r in spelling_variants(docs, drop=0, min_count=1).collect()}
    assert by["abcdezyx"].form == "abcdefyx" and by["abcdezyx"].root == "abcdefgh" and by["abcdefgh"].form is None
    assert sorted(map(str, map(tuple, by.values()))) == brute(rows, drop=0, min_count=1)


@pytest.mark.parametrize("long_list", [1 << 10, 8, 0])
def test_one_large_group(spark, long_list):
    """Many words around one, all in the same lists: every pair that is near, and no other."""
    rng = random.Random(1)
    base = "longestword"
    words = {base[:i] + c + base[i + 1 :] for i in range(11) for c in "abcdefghijklmnop"} | {base[:i] + base[i + 1 :] for i in range(11)} | {base[:i] + rng.choice("qvw") + base[i:] for i in range(12)}
    frame = spark.createDataFrame([(w, i + 1) for i, w in enumerate(sorted(words))], "word string, n long")
    found = {(r.word, r.other) for r in near_words(frame, long_list=long_list).collect()}
    assert found == {(a, b) for a in words for b in words if a != b and one_edit(a, b)}
