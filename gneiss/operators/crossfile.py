"""Analyses across files: duplicates, unused and leaked symbols, class closure, home modules."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gneiss.functions.core import truncated


def duplicates(shapes: DataFrame, least: int = 2) -> DataFrame:
    """Rows of shapes(shape_hash, path, ...) whose hash occurs in at least `least` paths."""
    often = shapes.groupBy("shape_hash").agg(F.countDistinct("path").alias("n_paths")).where(F.col("n_paths") >= least)
    return shapes.join(often, "shape_hash")


def duplicates_by_role(shapes: DataFrame, roles: DataFrame, least: int = 2) -> DataFrame:
    """Duplicates within a role; a path without role counts as production."""
    r = shapes.join(roles.select("path", "role"), "path", "left").withColumn("role", F.coalesce("role", F.lit("production")))
    often = r.groupBy("shape_hash", "role").agg(F.countDistinct("path").alias("n_paths")).where(F.col("n_paths") >= least)
    return r.join(often, ["shape_hash", "role"])


def elsewhere(dups: DataFrame, shown: int = 5) -> DataFrame:
    """dups(shape_hash, role, path, line) with the sorted places of the group's other members, the first `shown` of them and how many more.

    A group hands on its first shown + 1 places and their number only; both are cut down before they are shuffled.
    """
    place = F.concat_ws(":", "path", F.col("line").cast("string"))
    places = dups.select("shape_hash", "role", place.alias("place")).distinct()
    order = F.row_number().over(Window.partitionBy("shape_hash", "role").orderBy("place"))
    first = places.withColumn("r", order).where(F.col("r") <= shown + 1).groupBy("shape_hash", "role").agg(F.sort_array(F.collect_list("place")).alias("first"))
    groups = places.groupBy("shape_hash", "role").agg(F.count(F.lit(1)).alias("n")).join(first, ["shape_hash", "role"])
    others = F.slice(F.filter("first", lambda x: x != F.concat_ws(":", F.col("path"), F.col("line").cast("string"))), 1, shown)
    more = F.col("n") - 1 - shown
    told = F.concat(F.array_join(others, ", "), F.when(more > 0, F.concat(F.lit(" (+"), more.cast("string"), F.lit(" more)"))).otherwise(""))
    return dups.join(groups, ["shape_hash", "role"]).withColumn("elsewhere", told).drop("first", "n")


def unreferenced(defined: DataFrame, used: DataFrame, key: str) -> DataFrame:
    return defined.join(used.select(key).distinct(), key, "left_anti")


def dead_symbols(definitions: DataFrame, used: DataFrame) -> DataFrame:
    """definitions(name, path, role, ...) of production or script files that no name in used(name) meets."""
    mine = definitions.where(F.col("role").isin("production", "script") & ~F.col("path").rlike(r"(^|/)__init__\.py$"))
    return mine.where(~F.col("name").rlike("^__.*__$")).join(used.select("name").distinct(), "name", "left_anti")


def leaked_private(definitions: DataFrame, references: DataFrame, shown: int = 3) -> DataFrame:
    """Names defined in one file and referenced from others: name, path, n_files, files."""
    single = definitions.groupBy("name").agg(F.countDistinct("path").alias("n"), F.min("path").alias("path")).where("n = 1").select("name", "path")
    users = references.select("name", F.col("path").alias("user")).distinct()
    hits = single.join(users, "name").where(F.col("user") != F.col("path"))
    out = hits.groupBy("name", "path").agg(F.array_sort(F.collect_set("user")).alias("u"))
    return out.select("name", "path", F.size("u").alias("n_files"), truncated(F.col("u"), shown).alias("files"))


def descendants(edges: DataFrame, roots: DataFrame, most: int = 100) -> DataFrame:
    """name and least depth of all that derive from roots(name) by edges(name, base)."""
    seen = roots.select("name", F.lit(0).alias("depth"))
    frontier, depth = seen, 0
    while depth < most:
        depth += 1
        step = edges.join(frontier.select(F.col("name").alias("base")), "base").select("name").distinct()
        frontier = step.join(seen, "name", "left_anti").withColumn("depth", F.lit(depth)).checkpoint()
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
    return seen


def home(members: DataFrame, key: str, module: str) -> DataFrame:
    """The module that holds most members of each key; none where two lead."""
    n = members.groupBy(key, module).agg(F.count(F.lit(1)).alias("n"))
    lead = n.withColumn("r", F.rank().over(Window.partitionBy(key).orderBy(F.desc("n")))).where("r = 1")
    alone = F.count(F.lit(1)).over(Window.partitionBy(key)) == 1
    return lead.withColumn("alone", alone).where("alone").select(key, F.col(module).alias("home"), "n")


def outside_home(members: DataFrame, homes: DataFrame, key: str, module: str) -> DataFrame:
    return members.join(homes.select(key, "home"), key).where(F.col(module) != F.col("home"))


def near_twins(skeletons: DataFrame, least: int) -> DataFrame:
    """Groups (path, skeleton_hash) with at least `least` members and two different literal lists."""
    g = skeletons.groupBy("path", "skeleton_hash").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("literals").alias("variants"), F.min("line").alias("line"))
    return g.where((F.col("n") >= least) & (F.col("variants") >= 2))


def repeated_blocks(blocks: DataFrame) -> DataFrame:
    g = blocks.groupBy("path", "block_hash").agg(F.sort_array(F.collect_set("line")).alias("lines"))
    return g.where(F.size("lines") >= 2)
