"""Captured course data (JSON files of a learning platform's read functions) as tables.

Each capture is ``{"function", "params", "response", "captured_at"}``; the response is kept as
text and read with an explicit schema, so odd shapes become a coverage, never an empty success.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CAPTURE = "function string, params string, response string, captured_at timestamp"

#: Read functions that never give data here: fixed values.
DENIED = ("grades", "submission_status")


def read_captures(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(CAPTURE).json(path)


def unwrapped(response: Column, envelope: str, element: str) -> Column:
    """``(coverage, items)``: a bare array or one under ``envelope``; any other shape is a parsing error."""
    bare = F.from_json(response, f"array<struct<{element}>>")
    inside = F.from_json(F.get_json_object(response, f"$.{envelope}"), f"array<struct<{element}>>")
    is_array = response.rlike(r"^\s*\[")
    items = F.when(is_array, bare).otherwise(inside)
    return F.struct(F.when(items.isNull(), "parsing_error").otherwise("complete").alias("coverage"), items.alias("items"))


def assignments(captures: DataFrame) -> DataFrame:
    """``courses[].assignments[]`` as flat rows with their course."""
    kind = "array<struct<id:long,fullname:string,assignments:array<struct<id:long,cmid:long,name:string,intro:string,duedate:long,allowsubmissionsfromdate:long,cutoffdate:long>>>>"
    courses = captures.filter("function = 'assignments'").select("captured_at", F.explode(F.from_json(F.get_json_object("response", "$.courses"), kind)).alias("c"))
    return courses.select("captured_at", F.col("c.id").alias("course_id"), F.explode("c.assignments").alias("a")).select("captured_at", "course_id", "a.*")


def course_contents(captures: DataFrame) -> DataFrame:
    """Sections, their modules and the modules' files: one row per module, files as an array."""
    kind = "array<struct<id:long,name:string,modules:array<struct<id:long,name:string,modname:string,instance:long,contents:array<struct<filename:string,fileurl:string,filesize:long>>>>>>"
    sections = captures.filter("function = 'contents'").select("captured_at", F.get_json_object("params", "$.courseid").cast("long").alias("course_id"), F.explode(F.from_json("response", kind)).alias("s"))
    modules = sections.select("captured_at", "course_id", F.col("s.id").alias("section_id"), F.col("s.name").alias("section_name"), F.explode_outer("s.modules").alias("m"))
    return modules.select("captured_at", "course_id", "section_id", "section_name", F.col("m.id").alias("module_id"), F.col("m.name").alias("module_name"), "m.modname", "m.instance", F.col("m.contents").alias("files"))


def discussions(captures: DataFrame, per_page: int) -> DataFrame:
    """Discussions of each page; a full page says that there may be more."""
    kind = "array<struct<discussion:long,id:long,name:string,userid:long,timemodified:long>>"
    rows = captures.filter("function = 'discussions'").select("captured_at", F.get_json_object("params", "$.forumid").cast("long").alias("forum_id"), F.get_json_object("params", "$.page").cast("int").alias("page"), F.from_json(F.get_json_object("response", "$.discussions"), kind).alias("d"))
    rows = rows.withColumn("has_more", F.size("d") == per_page)
    return rows.select("captured_at", "forum_id", "page", "has_more", F.explode_outer("d").alias("x")).select("captured_at", "forum_id", "page", "has_more", F.col("x.discussion").alias("discussion_id"), F.col("x.id").alias("first_post_id"), "x.name", F.col("x.userid").alias("author_id"), "x.timemodified")


def posts(captures: DataFrame, offset: int = 0, limit: int | None = None, roots_only: bool = False) -> DataFrame:
    """Posts per discussion: chosen first, cut afterwards; ``truncated`` if more were chosen than are given."""
    from pyspark.sql import Window

    kind = "array<struct<id:long,parentid:long,author:struct<id:long>,subject:string,message:string,timecreated:long>>"
    rows = captures.filter("function = 'posts'").select(F.get_json_object("params", "$.discussionid").cast("long").alias("discussion_id"), F.explode(F.from_json(F.get_json_object("response", "$.posts"), kind)).alias("p")).select("discussion_id", F.col("p.id").alias("post_id"), F.coalesce("p.parentid", F.lit(0)).alias("parent_id"), F.col("p.author.id").alias("author_id"), "p.subject", "p.message", "p.timecreated")
    if roots_only:
        rows = rows.filter("parent_id = 0")
    w = Window.partitionBy("discussion_id").orderBy("timecreated", "post_id")
    rows = rows.withColumns({"_n": F.row_number().over(w), "_all": F.count("*").over(Window.partitionBy("discussion_id"))})
    if limit is None:
        return rows.filter(F.col("_n") > offset).withColumn("truncated", F.lit(False)).drop("_n", "_all")
    return rows.filter((F.col("_n") > offset) & (F.col("_n") <= offset + limit)).withColumn("truncated", F.col("_all") > offset + limit).drop("_n", "_all")


def calendar(events: DataFrame, start: Column, end: Column) -> DataFrame:
    """Events in the half-open interval ``[start, end)``."""
    return events.filter((F.col("starts_at") >= start) & (F.col("starts_at") < end))


def denied(captures: DataFrame) -> DataFrame:
    """Rows for functions that are never read: coverage ``denied``."""
    return captures.filter(F.col("function").isin(*DENIED)).select("function", "captured_at", F.lit("denied").alias("coverage"))


def projected(contents: DataFrame, owner: str, connection: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``(entities, occurrences, relations)`` of course contents: the ingest as three tables.

    Repeating it changes nothing: identities and hashes come from the data.
    """
    from attesta.functions.hashing import stable_uuid

    def node(kind: str, ext, title, state):
        return F.struct(F.lit(owner).alias("owner_id"), stable_uuid(F.lit(owner), F.lit(connection), F.lit(kind), ext.cast("string")).alias("id"), F.lit(connection).alias("connection_id"), F.lit(kind).alias("kind"), ext.cast("string").alias("external_id"), title.alias("title"), F.to_json(state).alias("state"))

    section = node("section", F.col("section_id"), F.col("section_name"), F.struct("course_id", "section_id"))
    module = node("module", F.col("module_id"), F.col("module_name"), F.struct("course_id", "section_id", "module_id", "modname", "instance"))
    rows = contents.select("captured_at", section.alias("s"), F.when(F.col("module_id").isNotNull(), module).alias("m"))
    nodes = rows.select("captured_at", F.explode(F.array("s", "m")).alias("n")).filter("n is not null").select("captured_at", "n.*")
    entities = nodes.groupBy("owner_id", "id", "connection_id", "kind", "external_id").agg(F.max_by("title", "captured_at").alias("title"), F.max_by("state", "captured_at").alias("state"))
    occurrences = nodes.select("owner_id", F.col("id").alias("entity_id"), F.sha2("state", 256).alias("content_hash"), F.col("captured_at").alias("observed_at"), F.col("state").alias("content")).dropDuplicates(["owner_id", "entity_id", "content_hash", "observed_at"])
    relations = rows.filter("m is not null").select(F.lit(owner).alias("owner_id"), F.col("s.id").alias("from_id"), F.col("m.id").alias("to_id"), F.lit("has_module").alias("kind")).distinct()
    return entities, occurrences, relations
