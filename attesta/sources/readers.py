"""All read functions of a learning platform by one table of rules, and one ingest for what they give.

A capture is a row of ``captures.CAPTURE``. A reader says where in a response its items lie, what they
are and what they belong to; items stay JSON, so that a field that isn't known here is kept. What has
another shape than expected becomes a coverage, never an empty success.
"""

from __future__ import annotations

from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from attesta.functions.hashing import stable_uuid
from attesta.schema import COVERAGE_WORST


class Reader(NamedTuple):
    """``envelope`` holds the items, if they aren't the response itself; ``parent`` is a field of an item, or with ``?`` a parameter of the call."""

    kind: str
    envelope: str | None = None
    key: str = "id"
    title: str = "name"
    parent_kind: str | None = None
    parent: str | None = None
    relation: str | None = None


#: What each function reads: fixed values.
READERS = {
    "courses": Reader("course", None, "id", "fullname"),
    "contents": Reader("section", None, "id", "name", "course", "?courseid", "has_section"),
    "pages": Reader("page", "pages", parent_kind="course", parent="course", relation="has_page"),
    "books": Reader("book", "books", parent_kind="course", parent="course", relation="has_book"),
    "resources": Reader("resource", "resources", parent_kind="course", parent="course", relation="has_resource"),
    "urls": Reader("url", "urls", parent_kind="course", parent="course", relation="has_url"),
    "forums": Reader("forum", "forums", parent_kind="course", parent="course", relation="has_forum"),
    "feedbacks": Reader("feedback", "feedbacks", parent_kind="course", parent="course", relation="has_feedback"),
    "feedback_items": Reader("feedback_item", "items", parent_kind="feedback", parent="?feedbackid", relation="has_item"),
    "assignments": Reader("assignment", "courses", parent_kind="course", parent="course_id", relation="has_assignment"),
    "discussions": Reader("discussion", "discussions", "discussion", "name", "forum", "?forumid", "has_discussion"),
    "posts": Reader("forum_post", "posts", "id", "subject", "discussion", "?discussionid", "has_post"),
    "activities_completion": Reader("completion_activity", "statuses", "cmid", "modname", "course", "?courseid", "has_completion"),
    "course_completion": Reader("course_completion", "completionstatus", "id", "name", "course", "?courseid", "has_course_completion"),
    "calendar": Reader("event", "events", parent_kind="course", parent="courseid", relation="has_event"),
}
#: Responses that are one record rather than a list, and lists inside the items of another: fixed values.
_RECORDS = ("course_completion",)
_INSIDE = {"assignments": ("assignments", "id", "course_id")}


def _list(text: Column) -> Column:
    """The elements of a JSON array, each as JSON text; null if it is none."""
    return F.when(F.ltrim(text).startswith("["), F.from_json(text, "array<string>"))


def _id(text: Column) -> Column:
    """A positive whole number, as text."""
    return F.when(text.rlike("^[1-9][0-9]{0,17}$"), text)


def _with(item: Column, name: str, value: Column) -> Column:
    """An object with one more field, in front."""
    rest = F.regexp_replace(item, r"^\s*\{\s*", "")
    return F.concat(F.lit(f'{{"{name}":'), value, F.when(rest.startswith("}"), "").otherwise(","), rest)


def read(captures: DataFrame, name: str) -> DataFrame:
    """``function, captured_at, coverage, warnings, position, item, kind, external_id, title, parent_kind, parent_id, relation`` of one function's captures.

    One row an item; a response without items, or of another shape, has one row with a null item. An
    item without an id has a null ``external_id`` and makes the response ``partial``.
    """
    how = READERS[name]
    rows = captures.filter(F.col("function") == name)
    inside = F.get_json_object("response", f"$.{how.envelope}") if how.envelope else F.lit(None).cast("string")
    if name in _RECORDS:
        one = F.coalesce(inside, F.when(F.ltrim("response").startswith("{"), F.col("response")))
        items = F.when(F.ltrim(one).startswith("{"), F.array(_with(one, how.key, F.coalesce(_id(F.get_json_object("params", "$.courseid")), F.lit("0")))))
    else:
        items = F.coalesce(_list(F.col("response")), _list(inside))
    if name in _INSIDE:
        field, key, to = _INSIDE[name]
        # Each child carries the id of what it stands in.
        items = F.flatten(F.transform(items, lambda x: F.transform(F.coalesce(_list(F.get_json_object(x, f"$.{field}")), F.array().cast("array<string>")), lambda y: _with(y, to, F.coalesce(F.get_json_object(x, f"$.{key}"), F.lit("null"))))))
    warnings = F.coalesce(F.size(_list(F.get_json_object("response", "$.warnings"))), F.lit(0))
    rows = rows.select("function", "captured_at", "params", items.alias("items"), F.greatest(warnings, F.lit(0)).alias("warnings"))
    key = lambda x: _id(F.get_json_object(x, f"$.{how.key}"))
    coverage = F.when(F.col("items").isNull(), "parsing_error").when((F.col("warnings") > 0) | F.exists("items", lambda x: key(x).isNull()), "partial").otherwise("complete")
    rows = rows.withColumn("coverage", coverage).select("function", "captured_at", "params", "coverage", "warnings", F.posexplode_outer("items").alias("position", "item"))
    parent = F.lit(None).cast("string") if how.parent is None else F.get_json_object("params", f"$.{how.parent[1:]}") if how.parent[0] == "?" else F.get_json_object("item", f"$.{how.parent}")
    text = lambda x: F.lit(x).cast("string")
    return rows.select(
        "function", "captured_at", "coverage", "warnings", "position", "item", text(how.kind).alias("kind"), key(F.col("item")).alias("external_id"),
        F.coalesce(F.get_json_object("item", f"$.{how.title}"), F.lit(how.kind)).alias("title"), text(how.parent_kind).alias("parent_kind"), _id(parent).alias("parent_id"), text(how.relation).alias("relation"),
    )


def read_all(captures: DataFrame, names=tuple(READERS)) -> DataFrame:
    """What all named functions give, one under another."""
    return reduce(DataFrame.union, [read(captures, n) for n in names])


def coverage_of(items: DataFrame) -> DataFrame:
    """Per function the worst coverage of its captures, their number and the number of items."""
    rank = F.create_map(*[F.lit(x) for pair in COVERAGE_WORST.items() for x in pair])
    return items.groupBy("function").agg(F.max_by("coverage", F.element_at(rank, F.col("coverage"))).alias("coverage"), F.count_distinct("captured_at").alias("captures"), F.count("item").alias("items"))


def merged_states(rows: DataFrame, keys: list[str], state: str, at: str) -> DataFrame:
    """Per key one JSON object: every field as the newest of ``rows`` that has it says (ties: the greater text); fields in order of name.

    Fields are grouped, not objects folded, so a key may have any number of rows.
    """
    fields = rows.select(*keys, at, F.explode(F.from_json(state, "map<string,variant>")).alias("name", "v")).select(*keys, at, "name", _value(F.col("v")).alias("v"))
    newest = fields.groupBy(*keys, "name").agg(F.max(F.struct(F.col(at).alias("at"), F.col("v").alias("v"))).alias("w"))
    packed = F.sort_array(F.collect_list(F.struct("name", F.col("w.v").alias("v"))))
    return newest.groupBy(*keys).agg(_object(packed).alias(state))


def _value(v: Column) -> Column:
    return F.coalesce(F.to_json(v), F.lit("null"))


def _object(packed: Column) -> Column:
    """A JSON object of ``(name, v)`` in order of name; of a name that comes twice the last."""
    quoted = lambda x: F.regexp_replace(F.to_json(F.array(x)), r"^\[|\]$", "")
    following = F.slice(packed, 2, F.greatest(F.size(packed), F.lit(1)))
    fields = F.zip_with(packed, following, lambda e, after: F.when(after.isNull() | (after["name"] != e["name"]), F.concat(quoted(e["name"]), F.lit(":"), e["v"])))
    return F.concat(F.lit("{"), F.array_join(fields, ","), F.lit("}"))


def entities(items: DataFrame) -> DataFrame:
    """``kind, external_id, title, state, versions`` of what readers give: states merged field by field, and how many contents there are.

    Items are dealt once, by what they are of, and sorted once; only those of an entity with more than one
    content are taken apart into fields.
    """
    keys = ["external_id", "kind"]
    dealt = items.filter("external_id is not null").select(*keys, "captured_at", "title", "item").repartition(*keys)
    contents = dealt.groupBy(*keys, "item").agg(F.max(F.struct("captured_at", "title")).alias("t"))
    of = Window.partitionBy(*keys).orderBy("item").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)  # the order they have
    contents = contents.select(*keys, "item", F.col("t.captured_at").alias("captured_at"), F.max("t").over(of)["title"].alias("title"), F.count("*").over(of).alias("versions"))
    packed = F.sort_array(F.transform(F.map_entries(F.from_json("item", "map<string,variant>")), lambda e: F.struct(e["key"].alias("name"), _value(e["value"]).alias("v"))))
    single = contents.filter("versions = 1").select(*keys, "title", "versions", packed.alias("packed")).withColumn("item", _object(F.col("packed")))
    several = merged_states(contents.filter("versions > 1"), [*keys, "title", "versions"], "item", "captured_at")
    return single.select(several.columns).union(several).select("kind", "external_id", "title", F.col("item").alias("state"), "versions")


def ingest(items: DataFrame, owner: str, connection: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``(entities, occurrences, relations)`` of what readers give.

    Ids come from owner, connection, kind and external id, so it may be run again, and over captures that
    overlap: states are merged field by field, an occurrence of a content counts once, from its first
    sight, and so does a relation. Relations lead from parents that are there.
    """
    node = lambda kind, ext: stable_uuid(F.lit(owner), F.lit(connection), kind, ext)
    rows = items.filter("external_id is not null").withColumn("id", node(F.col("kind"), F.col("external_id")))
    merged = entities(items).select(F.lit(owner).alias("owner_id"), node(F.col("kind"), F.col("external_id")).alias("id"), F.lit(connection).alias("connection_id"), "kind", "external_id", "title", "state")
    seen = rows.withColumn("content_hash", F.sha2("item", 256)).groupBy("id", "content_hash").agg(F.min(F.struct("captured_at", "coverage")).alias("s"), F.min("item").alias("content"))
    occurrences = seen.select(F.lit(owner).alias("owner_id"), F.col("id").alias("entity_id"), "content_hash", F.col("s.captured_at").alias("observed_at"), F.col("s.coverage").alias("coverage"), "content")
    linked = rows.filter("parent_id is not null").select(node(F.col("parent_kind"), F.col("parent_id")).alias("from_id"), F.col("id").alias("to_id"), F.col("relation").alias("kind")).distinct()
    relations = linked.join(merged.select(F.col("id").alias("from_id")), "from_id", "left_semi").select(F.lit(owner).alias("owner_id"), "from_id", "to_id", "kind")
    return merged, occurrences, relations
