"""Blocks of HTML and DOCX documents, one row per block.

Parsing is a small helper per document inside an Arrow batch; everything around it (dispatch by
signature, counters, paging, coverage) is columns.
"""

from __future__ import annotations

import io
import re
import zipfile
from html.parser import HTMLParser
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

BLOCK = T.StructType().add("ordinal", "integer").add("kind", "string").add("level", "integer").add("text", "string").add("locator", "string")
DOCUMENT = T.StructType().add("status", "string").add("coverage", "string").add("removed", T.MapType(T.StringType(), T.IntegerType())).add("blocks", T.ArrayType(BLOCK))

#: Fixed values of the formats.
_REMOVED = frozenset("script style template iframe object embed form input button select textarea noscript svg".split())
_VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
_BLOCK_KIND = {"p": "paragraph", "li": "list_item", "blockquote": "quote", "pre": "preformatted", "dt": "term", "dd": "definition", "td": "cell", "th": "cell", "div": "paragraph", "section": "paragraph", "article": "paragraph", "footer": "paragraph", "header": "paragraph", "main": "paragraph", "nav": "paragraph", "caption": "caption", "tr": "row", "ul": "list", "ol": "list", "table": "table", "body": "paragraph"} | {f"h{i}": "heading" for i in range(1, 7)}
_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
MAX_ENTRIES, MAX_BYTES, MAX_RATIO, MAX_DEPTH = 2048, 96 << 20, 400, 256


class _Blocks(HTMLParser):
    """Collects blocks of visible text; removed elements and attributes are counted."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.blocks: list[tuple] = []
        self.removed: dict[str, int] = {}
        self.open: list[str] = []
        self.kind, self.level, self.text = "paragraph", 0, []
        self.skipped: str | None = None
        self.deep = False

    def count(self, what: str) -> None:
        self.removed[what] = self.removed.get(what, 0) + 1

    def flush(self) -> None:
        text = "".join(self.text)
        text = text.strip("\n") if self.kind == "preformatted" else re.sub(r"\s+", " ", text).strip()
        if text:
            self.blocks.append((len(self.blocks) + 1, self.kind, self.level, text, f"block:{len(self.blocks) + 1}"))
        self.text = []

    def _begin(self, tag: str) -> None:
        self.flush()
        self.kind, self.level = _BLOCK_KIND[tag], int(tag[1]) if tag[0] == "h" and tag[1:].isdigit() else 0

    def handle_starttag(self, tag, attrs):
        if self.skipped:
            return
        if tag in _REMOVED:
            self.count(tag)
            if tag not in _VOID:
                self.skipped = tag
            return
        for name, value in attrs:
            if name.startswith("on"):
                self.count("event_handler")
            elif name in ("href", "src") and (value or "").strip().lower().startswith("javascript:"):
                self.count("script_url")
        if tag == "br":
            self.text.append("\n" if self.kind == "preformatted" else " ")
        if tag in _BLOCK_KIND:
            self._begin(tag)
        if tag not in _VOID:
            if len(self.open) < MAX_DEPTH:
                self.open.append(tag)
            else:
                self.deep = True

    def handle_endtag(self, tag):
        if self.skipped:
            if tag == self.skipped:
                self.skipped = None
            return
        if tag in _BLOCK_KIND:
            self.flush()
            self.kind, self.level = "paragraph", 0
        if tag in self.open:
            while self.open.pop() != tag:
                pass

    def handle_data(self, data):
        if not self.skipped and "title" not in self.open[-1:]:
            self.text.append(data)

    def handle_comment(self, data):
        self.count("comment")


def html_document(markup: str | None) -> dict | None:
    if markup is None:
        return None
    p = _Blocks()
    p.feed(markup)
    p.close()
    p.flush()
    coverage = "partial" if p.deep or p.skipped else "complete"
    return {"status": "extracted", "coverage": coverage, "removed": p.removed, "blocks": p.blocks}


def _failed(status: str) -> dict:
    return {"status": status, "coverage": "parsing_error", "removed": {}, "blocks": []}


def docx_document(raw: bytes | None) -> dict | None:
    """Paragraphs, headings and cells of a DOCX, within limits on entries, size and ratio."""
    if raw is None:
        return None
    try:
        z = zipfile.ZipFile(io.BytesIO(raw))
        infos = z.infolist()
        names = [i.filename for i in infos]
        if len(infos) > MAX_ENTRIES or sum(i.file_size for i in infos) > MAX_BYTES or any(i.file_size > MAX_RATIO * max(1, i.compress_size) for i in infos):
            return _failed("limits")
        if any(i.flag_bits & 1 for i in infos):
            return _failed("encrypted")
        if len(set(names)) != len(names) or any(n.startswith("/") or "\\" in n or ".." in n.split("/") for n in names):
            return _failed("unsafe_names")
        if "word/document.xml" not in names:
            return _failed("not_docx")
        body = z.read("word/document.xml")
        if b"<!DOCTYPE" in body or b"<!ENTITY" in body:
            return _failed("doctype")
        blocks: list[tuple] = []
        cell = table = row = column = 0
        for event, e in ElementTree.iterparse(io.BytesIO(body), events=("start", "end")):
            if e.tag == f"{_W}tc":
                cell += 1 if event == "start" else -1
                if event == "end":
                    span = e.find(f"{_W}tcPr/{_W}gridSpan")
                    column += int(span.get(f"{_W}val", "1")) if span is not None else 1
            elif event == "start" and e.tag == f"{_W}tbl":
                table, row = table + 1, 0
            elif event == "start" and e.tag == f"{_W}tr":
                row, column = row + 1, 1
            if event == "end" and e.tag == f"{_W}p":
                text = "".join(t.text or "" if t.tag == f"{_W}t" else "\t" if t.tag == f"{_W}tab" else "" for t in e.iter()).strip()
                style = e.find(f"{_W}pPr/{_W}pStyle")
                outline = e.find(f"{_W}pPr/{_W}outlineLvl")
                named = re.fullmatch(r"(?:Heading|T[ií]tulo|Ttulo)\s*([1-9])", style.get(f"{_W}val", "") if style is not None else "")
                level = int(outline.get(f"{_W}val", "0")) + 1 if outline is not None else int(named[1]) if named else 0
                kind = "cell" if cell else "heading" if level else "list_item" if e.find(f"{_W}pPr/{_W}numPr") is not None else "paragraph"
                if text:
                    where = f"table:{table}/row:{row}/column:{column}" if cell else f"block:{len(blocks) + 1}"
                    blocks.append((len(blocks) + 1, kind, level, text, where))
        return {"status": "extracted", "coverage": "complete", "removed": {}, "blocks": blocks}
    except (zipfile.BadZipFile, ElementTree.ParseError, ValueError, NotImplementedError, OSError, EOFError):
        return _failed("parsing_error")


def _frame(rows: list[dict | None]) -> pd.DataFrame:
    none = {"status": None, "coverage": "unavailable", "removed": {}, "blocks": []}
    return pd.DataFrame([r or none for r in rows], columns=["status", "coverage", "removed", "blocks"])


def _office_kind(raw: bytes | None) -> str | None:
    if raw is None:
        return None
    try:
        names = set(zipfile.ZipFile(io.BytesIO(raw)).namelist())
    except (zipfile.BadZipFile, ValueError, NotImplementedError, OSError, EOFError):
        return "unreadable"
    macro = "_macro" if any(n.endswith("vbaProject.bin") for n in names) else ""
    for part, kind in (("word/document.xml", "docx"), ("ppt/presentation.xml", "pptx"), ("xl/workbook.xml", "xlsx")):
        if part in names:
            return kind + macro
    return "zip"


@F.pandas_udf(T.StringType())
def office_kind(content: pd.Series) -> pd.Series:
    """docx, pptx, xlsx (with ``_macro`` if there is code), zip or unreadable, from the archive's entries."""
    return content.map(lambda c: _office_kind(None if c is None else bytes(c)))


@F.pandas_udf(DOCUMENT)
def html_blocks(markup: pd.Series) -> pd.DataFrame:
    return _frame([html_document(m) for m in markup])


@F.pandas_udf(DOCUMENT)
def document_blocks(content: pd.Series) -> pd.DataFrame:
    """DOCX if the bytes begin as a ZIP does, else HTML in UTF-8."""
    return _frame([None if c is None else docx_document(bytes(c)) if bytes(c[:2]) == b"PK" else html_document(bytes(c).decode("utf-8", "replace")) for c in content])


def blocks(df: DataFrame, keys: list[str], extracted: str) -> DataFrame:
    return df.select(*keys, F.inline(f"{extracted}.blocks"))


def block_counters(df: DataFrame, extracted: str) -> DataFrame:
    """Counters over a document's blocks."""
    b = F.col(f"{extracted}.blocks")
    count = lambda kind: F.size(F.filter(b, lambda x: x["kind"] == kind))
    chars = F.aggregate(b, F.lit(0), lambda s, x: s + F.char_length(x["text"]))
    return df.withColumns({"n_blocks": F.size(b), "n_headings": count("heading"), "n_paragraphs": count("paragraph"), "n_list_items": count("list_item"), "n_cells": count("cell"), "n_chars": chars})


def artifact_type(content: Column) -> Column:
    """From the first bytes: pdf, zip or, if they are UTF-8, text."""
    return F.when(F.substring(content, 1, 5) == F.lit(b"%PDF-"), "pdf").when(F.substring(content, 1, 2) == F.lit(b"PK"), "zip").when(F.is_valid_utf8(content.cast("string")), "text").otherwise("binary")


def read_files(spark, path: str, glob: str | None = None) -> DataFrame:
    """Files below a folder with their bytes, digest and kind by extension."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    df = (reader.option("pathGlobFilter", glob) if glob else reader).load(path)
    extension = F.lower(F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1))
    kind = F.when(extension.isin("htm", "html"), "html").when(extension == "docx", "docx").when(extension == "pdf", "pdf").when(extension.isin("srt", "vtt"), "subtitles").when(extension.isin("md", "txt", "csv", "json"), "text").otherwise("other")
    return df.withColumns({"sha256": F.sha2("content", 256), "kind": kind})


def not_yet_extracted(files: DataFrame, done: DataFrame, version: str) -> DataFrame:
    """Files whose bytes this version of the extractor has not seen."""
    return files.join(done.filter(F.col("version") == version).select("sha256"), "sha256", "left_anti")


def extract_new(files: DataFrame, done: DataFrame, version: str) -> DataFrame:
    """Extractions of all files, equal bytes once; those done before are taken over as ``reused``."""
    new = not_yet_extracted(files, done, version).dropDuplicates(["sha256"]).select("sha256", F.lit(version).alias("version"), document_blocks("content").alias("extracted"), F.lit(False).alias("reused"))
    kept = done.filter(F.col("version") == version).select("sha256", "version", "extracted", F.lit(True).alias("reused"))
    return new.unionByName(kept)

