"""What the two vector searches share: distinct vectors, cells of bounded blocks, and the lists' last steps.

Equal vectors are one group with its ``k`` + 1 smallest ids, the only ones that can stand in any list of ``k`` (one may
be the query's own row): a third of all rows may be one vector without any bucket or cell growing. Queries are groups
too; a group is searched once for all query rows that hold its vector. Searches give lists of (query group, group,
score); ``finish`` puts the ids back, leaves each query row itself out and ranks.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import parts_for, stored

GROUP = "a long, b long, dim int, least long, asks boolean, vec binary"
LIST = "qa long, qb long, a long, b long, least long, score {0}, scored long"
LISTED = [c.split()[0] for c in LIST.split(", ")]


def usable(df: DataFrame, id_col: str, vec_col: str, drop_zero: bool) -> DataFrame:
    """(id, vec array<double>) of the vectors that take part.

    Left out: null ids, null or empty vectors, vectors holding null, NaN or infinite components and, with
    ``drop_zero``, zero vectors. Vectors of different lengths are never compared with each other.
    """
    out = df.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("vec"))
    out = out.where(F.col("id").isNotNull() & F.col("vec").isNotNull() & (F.size("vec") > 0))
    out = out.where(F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))))
    return out.where(F.exists("vec", lambda x: x != 0)) if drop_zero else out


def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The column ``vec`` as the bytes of its doubles."""
    for batch in batches:
        lists = batch.column("vec")
        ends = lists.offsets.to_numpy().astype(np.int64)
        if (ends[-1] - ends[0]) * 8 >= 2**31:
            raise ValueError("a batch of vectors exceeds 2 GB")
        flat = np.ascontiguousarray(lists.flatten().to_numpy(zero_copy_only=False), np.float64)
        bytes_ = pa.Array.from_buffers(pa.binary(), len(lists), [None, pa.py_buffer(((ends - ends[0]) * 8).astype(np.int32)), pa.py_buffer(flat)])
        yield pa.RecordBatch.from_arrays([bytes_ if n == "vec" else batch.column(n) for n in batch.schema.names], names=batch.schema.names)


def distinct(vectors: DataFrame, every: int, k: int) -> tuple[DataFrame, DataFrame]:
    """(groups, asked) of (id, vec): groups a, b (128-bit print), dim, ids, least, asks, vec; asked a row for each query."""
    keyed = vectors.withColumns({"a": F.xxhash64("vec"), "b": F.xxhash64(F.lit(7), "vec")})
    asked = keyed.where(F.col("id") % every == 0).select(F.col("id").alias("query_id"), "a", "b")
    nth = F.row_number().over(Window.partitionBy("a", "b").orderBy("id"))
    few = keyed.withColumn("nth", nth).where(F.col("nth") <= k + 1)
    groups = few.groupBy("a", "b").agg(F.array_sort(F.collect_list("id")).alias("ids"), F.first("vec").alias("vec"))
    groups = groups.join(asked.select("a", "b").distinct().withColumn("asks", F.lit(True)), ["a", "b"], "left")
    groups = groups.select("a", "b", F.size("vec").alias("dim"), "ids", F.col("ids")[0].alias("least"), F.coalesce("asks", F.lit(False)).alias("asks"), "vec")
    schema = "a long, b long, dim int, ids array<long>, least long, asks boolean, vec binary"
    return stored(groups.mapInArrow(packed, schema), "vectors"), asked


def matrix(vec: pd.Series) -> np.ndarray:
    """The vectors of one length as rows."""
    raw = np.frombuffer(b"".join(vec), np.float64)
    return raw.reshape(len(vec), -1)


def keep_best(a: np.ndarray, score: np.ndarray, least: np.ndarray, k: int, ascending: bool) -> np.ndarray:
    """Places of the first ``k`` of each query ``a`` by (score, least id)."""
    order = np.lexsort((least, score if ascending else ~score, a))  # ~ turns whole numbers round and never overflows
    held = a[order]
    starts = np.r_[0, np.flatnonzero(np.diff(held)) + 1] if len(held) else np.empty(0, int)
    place = np.arange(len(held)) - np.repeat(starts, np.diff(np.r_[starts, len(held)]))
    return order[place < k]


def listed(asked: pd.DataFrame, rows: pd.DataFrame, kernel: Callable, k: int, ascending: bool, score_type) -> pd.DataFrame:
    """The lists of one cell. ``kernel(queries, rows)`` gives (query, row, score, rows scored for each query)."""
    if not len(asked) or not len(rows):
        return pd.DataFrame({c: np.empty(0, score_type if c == "score" else np.int64) for c in LISTED})
    q, r, score, scored = kernel(matrix(asked["vec"]), matrix(rows["vec"]))
    keep = keep_best(q, score, rows["least"].to_numpy()[r], k, ascending)
    q, r, score = q[keep], r[keep], score[keep]
    at = lambda frame, c, i: frame[c].to_numpy()[i]
    return pd.DataFrame({"qa": at(asked, "a", q), "qb": at(asked, "b", q), "a": at(rows, "a", r), "b": at(rows, "b", r),
                         "least": at(rows, "least", r), "score": score, "scored": scored[q]})


def blocks(n: Column, each: int) -> Column:
    return F.greatest(F.lit(1), F.ceil(n / each)).cast("int")


def in_cells(rows: DataFrame, asked: DataFrame, key: list[str], n_rows: Column, n_asked: Column, rows_each: int, asked_each: int) -> DataFrame:
    """``key``, i, j, side and the group's columns: each row block meets each query block of its key."""
    own = lambda n: F.pmod(F.xxhash64("a", "b"), n).cast("int")
    all_of = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    nr, nq = blocks(n_rows, rows_each), blocks(n_asked, asked_each)
    columns = ["a", "b", "least", "vec"]
    left = rows.select(*key, own(nr).alias("i"), all_of(nq).alias("j"), F.lit(0).alias("side"), *columns)
    right = asked.select(*key, all_of(nr).alias("i"), own(nq).alias("j"), F.lit(1).alias("side"), *columns)
    return left.unionByName(right)


def search_cells(cells: DataFrame, key: list[str], kernel: Callable, k: int, ascending: bool, score_type: str, parts: int) -> DataFrame:
    """LIST rows: the ``k`` + 1 best groups of each query group in each cell. ``kernel(key values)`` gives the cell's kernel.

    Cells are small in bytes and long in work, so ``parts`` says how many tasks they are dealt to.
    """
    kind = np.float64 if score_type == "double" else np.int64

    def cell(values: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["a", "b"])
        side = pdf["side"].to_numpy()
        return listed(pdf[side == 1], pdf[side == 0], kernel(values), k + 1, ascending, kind)

    return cells.repartition(parts, *key, "i", "j").groupBy(*key, "i", "j").applyInPandas(cell, LIST.format(score_type))


def grid(groups: DataFrame, asked: DataFrame, kernel: Callable, k: int, ascending: bool, score_type: str,
         rows_each: int = 1024, asked_each: int = 2048) -> DataFrame:
    """LIST rows of the groups ``asked`` against all ``groups`` of their length."""
    size = lambda d, n: d.groupBy("dim").agg(F.count("*").alias(n))
    sizes = size(groups, "n_rows").join(size(asked, "n_asked"), "dim")
    n_cells = sizes.agg(F.sum(F.ceil(F.col("n_rows") / rows_each) * F.ceil(F.col("n_asked") / asked_each))).first()[0] or 0
    cells = in_cells(groups.join(sizes, "dim"), asked.join(sizes, "dim"), ["dim"], F.col("n_rows"), F.col("n_asked"), rows_each, asked_each)
    return search_cells(cells, ["dim"], kernel, k, ascending, score_type, parts_for(n_cells, 2))


def merged(lists: DataFrame, k: int, ascending: bool) -> DataFrame:
    """qa, qb, a, b, least, score: the ``k`` + 1 best groups of each query group over all its lists."""
    order = F.col("score") if ascending else F.bitwise_not("score")  # whole scores where large is best
    met = lists.groupBy("qa", "qb", "a", "b").agg(F.min("least").alias("least"), F.first("score").alias("score"))
    nth = F.row_number().over(Window.partitionBy("qa", "qb").orderBy(order, "least"))
    return met.withColumn("nth", nth).where(F.col("nth") <= k + 1).drop("nth")


def finish(lists: DataFrame, groups: DataFrame, asked: DataFrame, k: int, ascending: bool) -> DataFrame:
    """(query_id, rank, vec_id, score) of the best lists, each query row without itself."""
    order = F.col("score") if ascending else F.bitwise_not("score")  # whole scores where large is best
    rows = merged(lists, k, ascending).join(groups.select("a", "b", "ids"), ["a", "b"]).select(
        "qa", "qb", order.alias("order"), "score", ((F.col("a") == F.col("qa")) & (F.col("b") == F.col("qb"))).alias("own"), F.explode("ids").alias("vec_id"))
    tops = rows.groupBy("qa", "qb").agg(F.slice(F.array_sort(F.collect_list(F.struct("order", "vec_id", "own", "score"))), 1, k + 1).alias("top"))
    each = asked.join(tops.withColumnsRenamed({"qa": "a", "qb": "b"}), ["a", "b"])
    itself = F.array_position(F.transform("top", lambda x: x["own"] & (x["vec_id"] == F.col("query_id"))), True)
    rest = F.slice(F.filter("top", lambda x, i: i != F.col("itself") - 1), 1, k)
    out = each.withColumn("itself", itself).select("query_id", F.posexplode(rest).alias("rank", "x"))
    return out.select("query_id", (F.col("rank") + 1).cast("int").alias("rank"), "x.vec_id", "x.score")
