"""Parts of preserved JSON against a plain reader, and normalisation against what must be gone."""

import json
import random

import pytest
from pyspark.sql import functions as F

from attesta.operators import preserved

REQUEST = "file_id string, sha256 string, pointer string, offset int, limit int, children_offset int"


def parts(spark, values, asked, **options):
    m = spark.createDataFrame([(k, "v", v if isinstance(v, str) else json.dumps(v, ensure_ascii=False)) for k, v in values.items()], "file_id string, sha256 string, content string")
    r = spark.createDataFrame([(f, "v", p, o, n, c) for f, p, o, n, c in asked], REQUEST)
    return [row.asDict() for row in preserved.read_parts(r, m, **options).orderBy("file_id", "pointer", "offset").collect()]


def test_pages_join_to_the_value(spark):
    rng = random.Random(3)
    array = [rng.choice([i, "x" * rng.randrange(90), {"k": ["é", None, True]}, 1.5]) for i in range(130)]
    text = "".join(rng.choice("aé€𝄞\n\"") for _ in range(3000))
    for pointer, value, limit in (("/a", array, 17), ("/t", text, 101)):
        at, got = 0, []
        while at is not None:
            (row,) = parts(spark, {"f": {"a": array, "t": text}}, [("f", pointer, at, limit, 0)], budget=900)
            assert row["refusal"] is None and len(row["result"].encode()) <= 900 or pointer == "/a" and len(json.loads(row["result"])) == 1
            got.append(json.loads(row["result"]))
            assert row["coverage"] == ("complete" if row["next_offset"] is None else "partial")
            at = row["next_offset"]
        assert (sum(got, []) if pointer == "/a" else "".join(got)) == value


def test_refusals_and_offsets(spark):
    value = {"a": [1, 2], "t": "a𝄞b", "n": 5, "o": {"": 1, "a/b": {"~": 2}}}
    asked = [("f", "/a", 3, None, 0), ("f", "/a", 2, None, 0), ("f", "/a/2", 0, None, 0), ("f", "/a/00", 0, None, 0), ("f", "/n", 1, None, 0), ("f", "/n", 0, None, 0), ("f", "/o/a~1b/~0", 0, None, 0), ("f", "/o/", 0, None, 0), ("f", "/t", 2, None, 0), ("f", "/t", 1, 1, 0), ("f", "/t", 4, None, 0), ("f", "/t", 5, None, 0), ("g", "", 0, None, 0), ("h", "", 0, None, 0), ("f", "x", 0, None, 0), ("f", "/a", -1, None, 0), ("f", "/a", 0, 0, 0), ("f", "/n", 0, None, 1)]
    got = {(r["file_id"], r["pointer"], r["offset"], r["limit"], r["children_offset"]): (r["refusal"], r["result"]) for r in parts(spark, {"f": value, "h": "no json"}, asked)}
    assert got == {
        ("f", "/a", 3, None, 0): ("invalid_offset", None), ("f", "/a", 2, None, 0): (None, "[]"), ("f", "/a/2", 0, None, 0): ("not_found", None), ("f", "/a/00", 0, None, 0): ("invalid_locator", None), ("f", "/n", 1, None, 0): ("invalid_offset", None), ("f", "/n", 0, None, 0): (None, "5"),
        ("f", "/o/a~1b/~0", 0, None, 0): (None, "2"), ("f", "/o/", 0, None, 0): (None, "1"), ("f", "/t", 2, None, 0): ("invalid_offset", None), ("f", "/t", 1, 1, 0): (None, '"𝄞"'), ("f", "/t", 4, None, 0): (None, '""'), ("f", "/t", 5, None, 0): ("invalid_offset", None),
        ("g", "", 0, None, 0): ("not_found", None), ("h", "", 0, None, 0): ("invalid_material", None), ("f", "x", 0, None, 0): ("invalid_locator", None), ("f", "/a", -1, None, 0): ("invalid_locator", None), ("f", "/a", 0, 0, 0): ("invalid_locator", None), ("f", "/n", 0, None, 1): ("invalid_offset", None),
    }


def test_large_values_list_their_children(spark):
    value = {"big": {f"k{i}": "x" * 20 for i in range(250)}, "list": ["y" * 500, "z"]}
    pages, at = [], 0
    while at is not None:
        (row,) = parts(spark, {"f": value}, [("f", "/big", 0, None, at)], budget=400)
        assert row["result"] is None and row["coverage"] == "partial" and row["children_count"] == 250
        pages += row["children"]
        at = row["children_next_offset"]
    assert pages == list(value["big"])
    (row,) = parts(spark, {"f": value}, [("f", "/list", 0, None, 0)], budget=400)
    assert row["result"] is None and row["children"] == ["0"]
    (row,) = parts(spark, {"f": {"format": "w", "value": [1]}}, [("f", "", 0, None, 0)], envelopes={"w": "value"})
    assert row["result"] == "[1]"
    assert parts(spark, {"f": 1}, []) == []


def test_fitting_is_the_largest_prefix(spark):
    rng = random.Random(1)
    rows = [(i, [json.dumps("ä" * rng.randrange(12), ensure_ascii=False) for _ in range(rng.randrange(1, 30))]) for i in range(60)]
    got = dict(spark.createDataFrame(rows, "i int, c array<string>").select("i", preserved.fitting(F.col("c"), 90)).collect())
    for i, c in rows:
        fits = [k for k in range(1, len(c) + 1) if len(("[" + ",".join(c[:k]) + "]").encode()) <= 90]
        assert got[i] == (max(fits) if fits else 1)


def test_normalised_values_hold_no_secrets(spark):
    deep = {"password": "p", "x": "Bearer abc.def", "intro": "<a href='javascript:evil()' onclick=go()>in</a><script>s</script> &NBSP;b"}
    for i in range(40):
        deep = {"n": [deep, {"Email": "e@x"}], "level": i}
    rows = [(1, json.dumps(deep)), (2, json.dumps([{"fileurl": "http://h/p?token=1", "filename": "f", "type": "content"}, {"url": "http://h/q#x", "filename": "g", "filesize": 3}, {"fileurl": "http://u:p@h/", "type": "url"}, {"fileurl": "https://H/a?sesskey=9", "type": "url"}])), (3, "{"), (4, None), (5, '"just?token=text"')]
    got = {r.id: r.n for r in spark.createDataFrame(rows, "id int, j string").select("id", preserved.normalised("j").alias("n")).collect()}
    kept = got[1].tree
    assert not any(x in kept for x in ("password", "abc.def", "e@x", "javascript:evil", "onclick", "<script")) and "Bearer [REDACTED]" in kept and got[1].twins[0].text == "in b" and got[1].twins[0].path.count(".n[0]") == 40
    assert [(f.path, f.kind, f.url) for f in got[2].files] == [("$[1]", "file", "http://h/q"), ("$[2]", "unsafe", None), ("$[3]", "reference", "https://h/a?sesskey=[REDACTED]")]
    assert got[3].tree is None and got[4].tree is None and got[5].tree == '"just?token=[REDACTED]"'


@pytest.mark.parametrize("raw, text", [("<p>a<br>b</p>", "a b"), ("<!-- x -->a<style>b</style>", "a"), ("<form><input></form>c<meta x>", "c"), ("", "")])
def test_markup_is_cleaned(raw, text):
    assert preserved.clean_markup(raw)[1] == text
