"""Typed edges, bounded expansion and packages of related material."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Edge kinds from strongest to weakest: fixed values.
PRECEDENCE = ("required", "related", "suggested", "has_content", "section_related", "references")
#: The right that stands where edges declare none or several: a fixed value.
NO_RIGHTS = "private source; redistribution not authorized"


def strongest(kind: str = "kind", order: Sequence[str] = PRECEDENCE) -> Column:
    """Aggregate: the strongest kind of a group's edges. A position and a lookup, combined map-side."""
    rank = F.array_position(F.array(*[F.lit(k) for k in order]), F.col(kind))
    return F.element_at(F.array(*[F.lit(k) for k in order]), F.min(F.when(rank > 0, rank)).cast("int"))


def two_hop(first: DataFrame, second: DataFrame, start: str, middle: str, end: str) -> DataFrame:
    """Distinct ``(start, end)`` over one path of two edges."""
    return first.select(start, middle).distinct().join(second.select(middle, end).distinct(), middle).select(start, end).distinct()


def union_paths(*paths: DataFrame) -> DataFrame:
    """Pairs reachable by any of the paths."""
    out = paths[0]
    for p in paths[1:]:
        out = out.union(p)
    return out.distinct()


def resolve_section(relations: DataFrame, focal: DataFrame) -> DataFrame:
    """Per focal activity: the section that holds its module, or why there is none.

    Paths: section -> module (the activity itself is the module), and section -> module -> content.
    """
    has_module = relations.filter("kind = 'has_module'").select("owner_id", F.col("from_id").alias("section_id"), F.col("to_id").alias("module_id"))
    has_content = relations.filter("kind = 'has_content'").select("owner_id", F.col("from_id").alias("module_id"), F.col("to_id").alias("activity_id"))
    direct = has_module.select("owner_id", F.col("module_id").alias("activity_id"), "section_id")
    through = has_content.join(has_module, ["owner_id", "module_id"]).select("owner_id", "activity_id", "section_id")
    found = direct.union(through).distinct().groupBy("owner_id", "activity_id").agg(F.count("*").alias("sections"), F.min("section_id").alias("_one"))
    out = focal.join(found, ["owner_id", "activity_id"], "left").withColumn("sections", F.coalesce("sections", F.lit(0)))
    return out.withColumns({"section_id": F.when(F.col("sections") == 1, F.col("_one")), "gap": F.when(F.col("sections") == 0, "section_missing").when(F.col("sections") > 1, "section_ambiguous")}).drop("_one")


def section_siblings(relations: DataFrame, resolved: DataFrame) -> DataFrame:
    """Material of the same section, as ``section_related`` edges that are derived and never stored."""
    has_module = relations.filter("kind = 'has_module'").select("owner_id", F.col("from_id").alias("section_id"), F.col("to_id").alias("material_id"))
    has_content = relations.filter("kind = 'has_content'").select("owner_id", F.col("from_id").alias("_m"), F.col("to_id").alias("material_id"))
    contents = has_module.withColumnRenamed("material_id", "_m").join(has_content, ["owner_id", "_m"]).select("owner_id", "section_id", "material_id")
    members = has_module.union(contents).distinct()
    return resolved.filter("section_id is not null").join(members, ["owner_id", "section_id"]).filter("material_id <> activity_id").select("owner_id", "activity_id", "material_id", F.lit("section_related").alias("kind"))


def study_graph(relations: DataFrame, entities: DataFrame, focal: DataFrame) -> DataFrame:
    """Per focal activity its material: direct edges and section siblings, one row per material with the strongest kind and all kinds."""
    direct = relations.filter(F.col("kind").isin("required", "related", "suggested", "references", "has_content")).select("owner_id", F.col("from_id").alias("activity_id"), F.col("to_id").alias("material_id"), "kind").join(focal.select("owner_id", "activity_id"), ["owner_id", "activity_id"], "left_semi")
    every = direct.unionByName(section_siblings(relations, resolve_section(relations, focal)))
    packed = every.groupBy("owner_id", "activity_id", "material_id").agg(strongest().alias("relation"), F.sort_array(F.collect_set("kind")).alias("kinds"))
    names = entities.select("owner_id", F.col("id").alias("material_id"), "title", F.col("kind").alias("material_kind"))
    return packed.join(names, ["owner_id", "material_id"])


def package(graph: DataFrame, files: DataFrame) -> DataFrame:
    """Materials with their files, and whether a file must be chosen."""
    f = files.groupBy("owner_id", F.col("entity_id").alias("material_id")).agg(F.count("*").alias("file_count"), F.sort_array(F.collect_list(F.struct("name", "id"))).alias("files"))
    out = graph.join(f, ["owner_id", "material_id"], "left").withColumn("file_count", F.coalesce("file_count", F.lit(0)))
    return out.withColumns({"selection_required": F.col("file_count") >= 2, "bibliography": F.col("relation") == "references"})


def study_entries(packages: DataFrame, declared: DataFrame) -> DataFrame:
    """A package as entries: a material that is also cited is one entry as a ``reference`` and one in its other role.

    ``declared(owner_id, activity_id, material_id, kind, rights)`` are rights by edge. An entry has the
    right that the edges of its own kinds agree on; where they differ or say nothing it falls back to
    none to redistribute, and differing ones need a review. All rights stay in ``rights_by_relation``.
    """
    keys = ["owner_id", "activity_id", "material_id"]
    each = declared.filter("rights is not null").groupBy(*keys, "kind").agg(F.max("rights").alias("rights"))
    by = each.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("kind", "rights"))).alias("rights_by_relation"))
    other = F.filter("kinds", lambda k: k != "references")
    role = F.when(F.col("relation").isin("required", "suggested"), F.col("relation")).otherwise("related")
    cited = F.when(F.array_contains("kinds", "references"), F.struct(F.lit("reference").alias("role"), F.array(F.lit("references")).alias("of")))
    used = F.when(F.size(other) > 0, F.struct(role.alias("role"), other.alias("of")))
    out = packages.join(by, keys, "left").withColumn("_e", F.explode(F.array_compact(F.array(cited, used))))
    agreed = F.coalesce(F.array_distinct(F.array_compact(F.transform("_e.of", lambda k: F.element_at("rights_by_relation", k)))), F.array().cast("array<string>"))
    out = out.withColumns({"role": F.col("_e.role"), "_agreed": agreed})
    return out.withColumns({"rights": F.when(F.size("_agreed") == 1, F.get("_agreed", F.lit(0))).otherwise(NO_RIGHTS), "rights_requires_review": F.size("_agreed") > 1}).drop("_e", "_agreed")


def unique_targets(bindings: DataFrame, context: Sequence[str], target: str) -> DataFrame:
    """Contexts with exactly one distinct target, and that target."""
    return bindings.groupBy(*context).agg(F.count_distinct(target).alias("_n"), F.min(target).alias(target)).filter("_n = 1").drop("_n")


def precedence_page(df: DataFrame, keys: Sequence[str], order: Sequence[str], size: int) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= size).drop("_n")
