"""Where fields are allowed and required, as globs over the directories.

Directories are counted, not walked. A field may stand anywhere below a directory
if it occurs in every group of files below it (the files that lie directly in one
directory), and must if each of those files has it; both follow from how many
groups below a directory say so, an aggregate over each group's ancestors. Globs
are then the topmost such directories, and groups that have the field elsewhere.
Tables grow with directories and fields; only globs reach the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def parent(path: str | Column) -> Column:
    """The directory of a path, "" at the top."""
    return F.regexp_replace(path, r"/?[^/]*$", "")


def directory_counts(docs: DataFrame) -> DataFrame:
    """(dir, field, files): documents with a field, and of all of them beside a null field; one pass."""
    names = F.transform(F.filter("leaves", lambda x: x["first"] & (x["type"] != "Object")), lambda x: x["field"])
    own = F.concat(F.array(F.lit(None).cast("string")), F.coalesce(names, F.array().cast("array<string>")))
    return docs.select(parent("path").alias("dir"), F.explode(own).alias("field")).groupBy("dir", "field").agg(F.count(F.lit(1)).alias("files"))


def directory_fields(docs: DataFrame) -> DataFrame:
    """(dir, field, having, files): in how many of a directory's documents a field is."""
    counts = directory_counts(docs)
    files = counts.where("field is null").select("dir", "files")
    return counts.where("field is not null").withColumnRenamed("files", "having").join(files, "dir").select("dir", "field", "having", "files")


def _above(directory: str) -> Column:
    """A directory and all above it, to the top."""
    parts = F.filter(F.split(directory, "/"), lambda x: x != "")
    return F.transform(F.sequence(F.lit(0), F.size(parts)), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))


def _glob(directory: str, stars: str) -> Column:
    return F.when(F.col(directory) == "", F.lit(stars)).otherwise(F.concat(directory, F.lit(f"/{stars}")))


def field_globs(counts: DataFrame) -> DataFrame:
    """(field, allowed, required): sorted globs, from ``directory_counts``.

    These should be kept, as they are read several times.
    """
    files, having = counts.where("field is null").select("dir", "files"), counts.where("field is not null")
    groups = having.withColumnRenamed("files", "having").join(files, "dir").select("dir", "field", (F.col("having") == F.col("files")).alias("always"))
    totals = files.select(F.explode(_above("dir")).alias("at")).groupBy("at").agg(F.count(F.lit(1)).alias("groups"))
    held = groups.select("field", "always", F.explode(_above("dir")).alias("at")).groupBy("at", "field").agg(F.count(F.lit(1)).alias("ever"), F.count_if("always").alias("always"))
    whole = held.join(totals, "at").where("ever = groups").select("at", "field", (F.col("always") == F.col("groups")).alias("always"))

    def topmost(rows: DataFrame) -> DataFrame:
        above = rows.select(F.col("at").alias("up"), "field")
        up = F.when(F.col("at") != "", parent("at"))
        return rows.withColumn("up", up).join(above, ["up", "field"], "left_anti").select("field", _glob("at", "**").alias("glob"))

    elsewhere = groups.join(whole.select(F.col("at").alias("dir"), "field"), ["dir", "field"], "left_anti").select("field", _glob("dir", "*").alias("glob"))
    allowed = topmost(whole).unionByName(elsewhere).select("field", "glob", F.lit(False).alias("due"))
    required = topmost(whole.where("always")).select("field", "glob", F.lit(True).alias("due"))
    every = allowed.unionByName(required).groupBy("field")
    return every.agg(*[F.sort_array(F.collect_list(F.when(F.col("due") == due, F.col("glob")))).alias(name) for name, due in (("allowed", False), ("required", True))])
