"""Small random corpora with copies, near copies, shared passages and odd rows."""

import random
import re

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n long, digest string, key string"


def words(rng, n):
    return [rng.choice("abcdefghij") + rng.choice("aeiou") + rng.choice("klmnop") + str(rng.randrange(40)) for _ in range(n)]


def texts(seed=3):
    rng = random.Random(seed)
    out = []
    passage = words(rng, 60)
    line = words(rng, 12)
    for i in range(60):
        w = words(rng, rng.choice([3, 8, 40, 120, 200]))
        if i % 5 == 0:
            w = w[:20] + passage + w[20:]
        if i % 3 == 0:
            w = line + w
        out.append(" ".join(w))
    base = words(rng, 150)
    for _ in range(25):
        w = list(base)
        for _ in range(rng.randrange(9)):
            w[rng.randrange(len(w))] = "edit" + str(rng.randrange(10**6))
        out.append(" ".join(w))
    out += [out[7]] * 5 + ["", "   \t ", None, "one", "One", "two words", "A b C d", "x" * 3000, " ".join(words(rng, 6000)), "über " * 30, "no\u00a0break\u00a0space"]
    return out


def documents(spark, seed=3):
    rows = [(i, t, ["en", "de", None][i % 3], f"s{i % 4}" if i % 9 else None, len(t or ""), 1, "d", "k") for i, t in enumerate(texts(seed))]
    rows.append(rows[0])  # a repeated row
    return spark.createDataFrame(rows, SCHEMA)


def tokens(text):
    low = (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    return re.findall(r"[^\x20\x09-\x0D]+", low)


def shingles(text, k=5):
    w = tokens(text)
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()
