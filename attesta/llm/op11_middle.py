"""Fill-in-middle transformation by big-integer bit-parallelism.

A text is one integer per class of bytes: ``bytes.translate`` turns it into binary digits, bit ``i``
standing for byte ``i``. Shifted boolean operations of these masks mark the bytes at which a unit
ends, ``bit_count`` is the number of units, and the end of the k-th unit is found by halving the mask
and counting the lower half's bits, so a text costs a few passes over its bytes whatever its length.
The markers are found the same way, a mask per byte of a marker, each shifted by its place.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attesta.llm.scratch import in_batches
from attesta.llm.textkit import slices

PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
#: Of a hundred documents as many are transformed; of a hundred of these as many have the suffix first.
FIM_RATE, SPM_RATE = 90, 20

_SPACE = b" \t\n\v\f\r"
#: Tables for translate by class: a byte becomes the digit 1 if it is in the class.
_DIGITS: dict[bytes, bytes] = {}


def _mask(text: bytes, members: bytes) -> int:
    """The integer whose bit ``i`` says that byte ``i`` of ``text`` is one of ``members``."""
    if members not in _DIGITS:
        _DIGITS[members] = bytes(49 if b in members else 48 for b in range(256))
    return int(text[::-1].translate(_DIGITS[members]), 2)


_FOLLOWS = bytes(range(0x80, 0xC0))


def ends(text: bytes, unit: str = "char") -> int:
    """The mask of the last byte of each unit: code points, or words with the white space behind them."""
    if not text:
        return 0
    if unit == "char":
        return ~(_mask(text, _FOLLOWS) >> 1) & ((1 << len(text)) - 1)
    space = _mask(text, _SPACE)
    return space & ~(space >> 1) | 1 << (len(text) - 1)


def holds(text: bytes, marker: bytes) -> bool:
    """Whether ``marker`` occurs in ``text``."""
    if marker[:1] not in text:
        return False
    hit = -1
    for i, b in enumerate(marker):
        hit &= _mask(text, bytes([b])) >> i
    return hit != 0


def nth_bit(bits: int, k: int, width: int) -> int:
    """Where the set bit of rank ``k`` (from 0) is among the ``width`` lowest."""
    at = 0
    while width > 1:
        half = width >> 1
        low = bits & ((1 << half) - 1)
        if k < (c := low.bit_count()):
            bits, width = low, half
        else:
            bits, width, k, at = bits >> half, width - half, k - c, at + half
    return at


def transform(key: str, text: bytes, unit: str = "char", seed: int = 1, fim_rate: int = FIM_RATE, spm_rate: int = SPM_RATE) -> tuple[int, str, int | None, int | None, bytes]:
    """``(n, form, units of the prefix, of the middle, output)`` of one text."""
    marks = ends(text, unit)
    n = marks.bit_count()
    digest = hashlib.sha256(f"{seed}:{key}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[i : i + 8], 16) for i in (0, 8, 16, 24))
    if not text or h3 % 100 >= fim_rate or any(holds(text, m) for m in (PREFIX, SUFFIX, MIDDLE)):
        return n, "plain", None, None, text
    first, second = sorted((h1 % (n + 1), h2 % (n + 1)))
    cut = [nth_bit(marks, k - 1, len(text)) + 1 if k else 0 for k in (first, second)]
    before, middle, after = text[: cut[0]], text[cut[0] : cut[1]], text[cut[1] :]
    if h4 % 100 < spm_rate:
        return n, "spm", first, second - first, b"".join((SUFFIX, after, PREFIX, before, MIDDLE, middle))
    return n, "psm", first, second - first, b"".join((PREFIX, before, SUFFIX, after, MIDDLE, middle))


def _transformed(*options):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                rows = [transform("" if i is None else str(i), t or b"", *options) for i, t in zip(part.column(0).to_pylist(), part.column(1).cast(pa.binary()).to_pylist(), strict=True)]
                n, form, prefix, middle, output = zip(*rows, strict=True)
                # Not decoded: a text of ill-formed UTF-8 comes out byte for byte.
                text = pa.Array.from_buffers(pa.string(), len(output), (out := pa.array(output, pa.binary())).buffers(), out.null_count)
                yield pa.record_batch({"doc_id": part.column(0), "n": pa.array(n, pa.int64()), "form": pa.array(form), "prefix_units": pa.array(prefix, pa.int64()), "middle_units": pa.array(middle, pa.int64()), "output": text})

    return run


def fill_in_middle(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", unit: str = "char", seed: int = 1, fim_rate: int = FIM_RATE, spm_rate: int = SPM_RATE) -> DataFrame:
    """Per row of ``docs``: ``doc_id, n, form, prefix_units, middle_units, output``.

    A text has ``n`` units (``char``: code points; ``word``: words with the white space behind them).
    Two hashes of seed and doc_id cut it; ``form`` is ``psm``, ``spm`` (suffix first) or ``plain``, for
    which the output is the text and the units are null. Null text is empty, and empty texts and texts
    that hold a marker are plain. A null doc_id hashes as no digits. Rows that repeat an id are cut by
    the same hashes, each by its own length. Texts are cut whole, however long; ill-formed UTF-8 is
    counted by the bytes that begin a code point. Extra columns are not read; an empty table gives no
    rows.
    """
    if unit not in ("char", "word"):
        raise ValueError(f"unit {unit!r}")
    text = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return in_batches(text, _transformed(unit, seed, fim_rate, spm_rate), "doc_id long, n long, form string, prefix_units long, middle_units long, output string")


def restored(output: Column, form: Column) -> Column:
    """The text that ``fill_in_middle`` was given, from its output and form."""
    part = lambda text, marker, i: F.split_part(text, F.lit(marker.decode()), F.lit(i))
    outer, middle = part(output, MIDDLE, 1), part(output, MIDDLE, 2)
    psm = F.concat(part(part(outer, SUFFIX, 1), PREFIX, 2), middle, part(outer, SUFFIX, 2))
    spm = F.concat(part(outer, PREFIX, 2), middle, part(part(outer, PREFIX, 1), SUFFIX, 2))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)


def digests(docs: DataFrame) -> DataFrame:
    """``fill_in_middle`` with digests in place of the texts."""
    made = fill_in_middle(docs)
    return made.select("doc_id", "n", "form", F.col("prefix_units").alias("prefix_chars"), F.col("middle_units").alias("middle_chars"), F.sha2("output", 256).alias("output_sha256"), F.sha2(restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"))


def oracle() -> str:
    """The same rows in DuckDB."""
    return f"""
    WITH d AS (
      SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, '')) AS n, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents
    ), g AS (
      SELECT *, CAST('0x' || substr(h, 1, 8) AS UBIGINT) % (n + 1) AS a, CAST('0x' || substr(h, 9, 8) AS UBIGINT) % (n + 1) AS b,
        CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR CAST('0x' || substr(h, 17, 8) AS UBIGINT) % 100 >= {FIM_RATE} THEN 'plain'
          WHEN CAST('0x' || substr(h, 25, 8) AS UBIGINT) % 100 < {SPM_RATE} THEN 'spm' ELSE 'psm' END AS form
      FROM d
    ), c AS (
      SELECT *, CAST(least(a, b) AS BIGINT) AS p, CAST(greatest(a, b) AS BIGINT) AS m FROM g
    ), x AS (
      SELECT *, substr(t, 1, p) AS pre, substr(t, p + 1, m - p) AS mid, substr(t, m + 1) AS suf FROM c
    )
    SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN p END AS prefix_chars, CASE WHEN form <> 'plain' THEN m - p END AS middle_chars,
      sha256(CASE form WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid WHEN 'spm' THEN '<S>' || suf || '<P>' || pre || '<M>' || mid ELSE t END) AS output_sha256,
      sha256(t) AS restored_sha256
    FROM x"""
