"""Resumable reads: what is read next under a call budget, from what has been read."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def next_reads(forums: DataFrame, progress: DataFrame, budget: int) -> DataFrame:
    """The next page reads of each course, in order, as many as its budget of calls allows.

    ``forums(course_id, position, forum_id, pages)``; ``progress(course_id, position, forum_id,
    next_page)`` is where a course stopped. If that forum is no longer at that position the course
    begins again; forums before it are done.
    """
    saved = progress.select("course_id", F.col("position").alias("_p"), F.col("forum_id").alias("_f"), F.col("next_page").alias("_n"))
    here = forums.select("course_id", F.col("position").alias("_p"), F.col("forum_id").alias("_now"))
    kept = saved.join(here, ["course_id", "_p"], "left").filter(F.col("_now") == F.col("_f")).drop("_now")
    todo = forums.join(kept, "course_id", "left").filter(F.col("_p").isNull() | (F.col("position") >= F.col("_p")))
    first = F.when(F.col("position") == F.col("_p"), F.col("_n")).otherwise(0)
    pages = todo.withColumn("_first", first).filter(F.col("_first") < F.col("pages")).withColumn("page", F.explode(F.sequence(F.col("_first"), F.col("pages") - 1)))
    nth = F.row_number().over(Window.partitionBy("course_id").orderBy("position", "page"))
    return pages.withColumn("call", nth).filter(F.col("call") <= budget).select("course_id", "call", "position", "forum_id", "page")


def checkpoint(forums: DataFrame, reads: DataFrame, progress: DataFrame) -> DataFrame:
    """Where each course stands after its reads; ``completed`` instead of a place when nothing is left."""
    last = reads.groupBy("course_id").agg(F.max_by(F.struct("position", "forum_id", "page"), "call").alias("l"))
    end = forums.groupBy("course_id").agg(F.max_by(F.struct("position", "pages"), "position").alias("e"))
    out = last.join(end, "course_id")
    done = (F.col("l.position") == F.col("e.position")) & (F.col("l.page") + 1 >= F.col("e.pages"))
    new = out.select("course_id", F.col("l.position").alias("position"), F.col("l.forum_id").alias("forum_id"), (F.col("l.page") + 1).alias("next_page"), done.alias("completed"))
    rest = progress.join(new.select("course_id"), "course_id", "left_anti").select("course_id", "position", "forum_id", "next_page", F.lit(False).alias("completed"))
    return new.unionByName(rest)
