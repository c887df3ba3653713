"""Relational operators over package entries, shapes and text geometry."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geometry import COVERED, invisible, overlap_ratio

RATIO, LARGE = 2000, 128 << 20
#: Side of the lowest level's cells in points, and the level of what is larger than all cells.
BAND, LEVELS = 16.0, 12


def safe_path(name: Column) -> Column:
    plain = F.replace(name, F.lit("\\"), F.lit("/"))
    return ~(F.instr(plain, "\0") > 0) & ~plain.rlike(r"^/|^[A-Za-z]:/") & ~plain.rlike(r"(^|/)\.\.(/|$)")


def encrypted(flags: Column) -> Column:
    return flags.bitwiseAND(0x41) != 0


def compression_ratio(packed: Column, unpacked: Column) -> Column:
    return F.when(packed == 0, F.when(unpacked > 0, float("inf")).otherwise(1.0)).otherwise(unpacked / packed)


def nth_of_name(entries: DataFrame, file_id: str = "file_id", name: str = "name", order: str = "idx") -> DataFrame:
    """Adds ``nth``: which entry of the file with this name, in any case, it is."""
    return entries.withColumn("nth", F.row_number().over(Window.partitionBy(file_id, F.lower(name)).orderBy(order)))


def duplicate_names(entries: DataFrame, file_id: str = "file_id", name: str = "name", order: str = "idx") -> DataFrame:
    """Entries whose name, in any case, an earlier entry of the file has."""
    return nth_of_name(entries, file_id, name, order).where("nth > 1").drop("nth")


def orphans(parts: DataFrame, used: DataFrame, on: list[str]) -> DataFrame:
    return parts.join(used, on, "left_anti")


def covered_texts(texts: DataFrame, rects: DataFrame, keys: list[str]) -> DataFrame:
    """Visible texts that a rectangle of their stream covers, with the first such rectangle's ratio.

    A rectangle that covers more than half of a text holds its middle. So texts and rectangles meet in cells of the page: a rectangle
    lies in one to four cells of the level whose cells are as wide and as high as it (both to the next power of two), a text's middle in
    one cell a level. Levels are those of the stream's own rectangles, gathered first (at most (LEVELS + 1)**2), so that a text is
    copied as often as there are sizes, and not at all where there are no rectangles.
    """
    def level(low: str, high: str) -> Column:
        size = F.greatest(F.col(high) - F.col(low), F.lit(BAND))
        return F.least(F.lit(LEVELS), F.greatest(F.lit(0), F.ceil(F.log2(size / BAND)))).cast("int")

    def cell(at: Column, of: Column) -> Column:
        return F.when(of < LEVELS, F.floor(at / (BAND * F.pow(F.lit(2.0), of)))).otherwise(0).cast("long")

    def between(low: str, high: str, of: Column) -> Column:
        return F.array_distinct(F.array(cell(F.col(low), of), cell(F.col(high), of)))

    sides = ("left", "right", "bottom", "top")
    wide, high = F.col("wide"), F.col("high")
    r = rects.withColumns({"wide": level("left", "right"), "high": level("bottom", "top")})
    levels = r.groupBy(*keys).agg(F.collect_set(F.struct("wide", "high")).alias("levels"))
    r = r.withColumn("column", F.explode(between("left", "right", wide))).withColumn("row", F.explode(between("bottom", "top", high)))
    r = r.select(*keys, "wide", "high", "column", "row", F.col("seq").alias("rect"), *[F.col(c).alias(f"r_{c}") for c in sides])
    t = texts.where(~invisible(F.col("render_mode"))).join(levels, keys).select(*keys, "seq", "text", *sides, F.inline("levels"))
    t = t.withColumns({"column": cell((F.col("left") + F.col("right")) / 2, wide), "row": cell((F.col("bottom") + F.col("top")) / 2, high)})
    ratio = overlap_ratio({s: F.col(s) for s in sides}, {s: F.col(f"r_{s}") for s in sides})
    met = t.join(r, [*keys, "wide", "high", "column", "row"]).withColumn("ratio", ratio).where(F.col("ratio") >= COVERED)
    return met.groupBy(*keys, "seq").agg(F.min_by("ratio", "rect").alias("ratio"), F.first("text").alias("text"))


def comment_authors(comments: DataFrame, authors: DataFrame) -> DataFrame:
    """(file_id, part, author_id) with the author's name, else initials; distinct names in order of appearance."""
    named = authors.select("file_id", "author_id", F.coalesce(F.nullif("name", F.lit("")), F.nullif("initials", F.lit(""))).alias("who"))
    met = comments.join(named, ["file_id", "author_id"], "left").where("who IS NOT NULL")
    first = met.groupBy("file_id", "part", "who").agg(F.min("seq").alias("seq"))
    return first.groupBy("file_id", "part").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "who"))), lambda e: e["who"]), ", ").alias("authors"))
