"""The maximum-entropy model: counts by dictionary, probabilities that sum to one, better on held-out texts than counts alone."""

import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest

from attesta.llm import op13_maxent
from attesta.llm.op13_maxent import Model, Positions, score
from tests.llm.corpus import documents, tokens


def brute(rows):
    out_of = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 5 == 1
    text = [(i, out_of(i), [*tokens(t), None]) for i, t in rows]
    c = Counter(w for _, held, ws in text if not held for w in ws)
    n, v = sum(c.values()), len(c)
    return sorted(str((i, held, len(ws), sum(c[w] > 0 for w in ws), n, round(sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in ws), 6))) for i, held, ws in text)


@pytest.mark.parametrize("known", [1 << 18, 200, 0])
def test_counts_are_exact(spark, known):
    docs = documents(spark).withColumnsRenamed({"n_chars": "row", "digest": "held_out", "key": "c"})
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    more = spark.createDataFrame([(None, "no id"), (None, None), (900, ""), (900, "again"), (900, "again")], "doc_id long, text string")
    full = docs.unionByName(more, allowMissingColumns=True)
    found = score(full, known=known).collect()
    want = brute([*rows, (None, "no id"), (None, None), (900, ""), (900, "again"), (900, "again")])
    assert sorted(str((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6))) for r in found) == want
    assert all(math.isfinite(r.score) and r.score < 0 for r in found)
    again = {}
    for r in found:
        if r.doc_id == 900 and r.n_tokens == 2:
            again.setdefault(r.score, 0)
    assert len(again) == 1


def test_empty_and_nothing_to_learn_from(spark):
    schema = "doc_id long, text string"
    assert score(spark.createDataFrame([], schema)).count() == 0
    only_held = [i for i in range(200) if zlib.crc32(str(i).encode()) % 5 == 1][:3]
    rows = score(spark.createDataFrame([(i, "a b") for i in only_held], schema)).collect()
    assert len(rows) == 3 and all(r.n_known == 0 and r.train_tokens == 0 and r.held_out and math.isfinite(r.score) for r in rows)


def _bigram_texts(n, seed):
    rng = random.Random(seed)
    after = {w: rng.sample(range(60), 3) for w in range(60)}
    out = []
    for _ in range(n):
        w, words = rng.randrange(60), []
        for _ in range(80):
            words.append(f"w{w}")
            w = rng.choice(after[w])
        out.append(" ".join(words))
    return out


def test_learns_what_counts_do_not_know(spark):
    docs = spark.createDataFrame(list(enumerate(_bigram_texts(1500, 3))), "doc_id long, text string").repartition(3)
    rows = score(docs).filter("held_out").collect()
    gain = sum(r.score - r.base_score for r in rows) / sum(r.n_tokens for r in rows)
    assert len(rows) > 200 and gain > 0.5 and sum(r.score > r.base_score for r in rows) > 0.98 * len(rows)


def _model(rng, symbols):
    model = Model(rng.integers(1, 100, symbols))
    model.groups += rng.normal(0, 0.5, model.groups.shape).astype(np.float32)
    model.members += rng.normal(0, 0.5, model.members.shape).astype(np.float32)
    return model


@pytest.mark.parametrize("symbols", [65, 700, 1024])
def test_probabilities_sum_to_one(symbols):
    rng = np.random.default_rng(1)
    model = _model(rng, symbols)
    history = [5, 64, 3]
    each = [np.array([*history, s], "<u2").tobytes() for s in range(symbols)]
    before = model.log_probability([np.array(history, "<u2").tobytes()], symbols)[0]
    assert abs(sum(10 ** (model.log_probability(each, symbols) - before)) - 1) < 1e-4


def test_scores_do_not_depend_on_company():
    rng = np.random.default_rng(2)
    model = _model(rng, 500)
    texts = [rng.integers(0, 500, n).astype("<u2").tobytes() for n in (1, 3000, 7, 1)]
    alone = [model.log_probability([t], 500)[0] for t in texts]
    assert np.allclose(model.log_probability(texts, 500), alone, rtol=1e-5)


def test_steps_follow_the_gradient():
    """The first step of a row is the gradient of the log likelihood, by differences."""
    rng = np.random.default_rng(3)
    model = _model(rng, 300)
    text = [rng.integers(0, 300, 1).astype("<u2").tobytes()]
    x = Positions(text, 300)
    row = int(x.features(0, 1)[0][0][0])
    before, old = model.log_probability(text, 300)[0], model.groups[row].copy()
    slope = np.zeros(op13_maxent.CLASSES)
    for k in range(op13_maxent.CLASSES):
        model.groups[row, k] += 1e-2
        slope[k] = (model.log_probability(text, 300)[0] - before) * math.log(10) / 1e-2
        model.groups[row] = old
    used, squares = [np.zeros(op13_maxent.ROWS, np.int64) for _ in range(2)], [np.zeros(op13_maxent.ROWS, np.float32) for _ in range(2)]
    model.train(text, 300, used, squares)
    step = (model.groups[row] - old) / op13_maxent.RATE
    assert np.allclose(step, slope, atol=0.03) and used[0][row] >= 1
