"""Exact top-k by inner product with bounds from multi-resolution segment statistics.

A vector is cut in 1, 4 and 16 segments; of each segment its mean and standard deviation are kept. For vectors q and
x, |q-x|^2 >= sum over segments of len * ((mq-mx)^2 + (sq-sx)^2), because the centred parts of a segment differ by at
least the difference of their lengths. As q.x = (|q|^2 + |x|^2 - |q-x|^2) / 2, a lower bound of the distance is an
upper bound of the score; |q|^2 is the sum of len * (mq^2 + sq^2), so that bound is the inner product of the statistics, each
times the root of its segment's length, and one matrix product bounds all pairs of a block.
Coarse bounds come first and only what they leave meets the finer ones; survivors are scored exactly in integers. The bar
of a query is its ``k`` + 1st best score among a fixed number of rows (``SEEDS``), then among all scored so far in the cell: a
score that the query has surely reached, so nothing that could enter is ever dropped.

Cases: components become floor(256 * x); scores are exact integers, and one that no 64-bit integer holds counts as the
nearest that one does; null and non-finite vectors take no part, zero vectors do; fewer candidates give fewer rows; ties go to the
smaller id; rows that repeat an id are rows and queries of their own; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .vectors import distinct, finish, grid, matrix, usable

LEVELS, SEEDS, TILE = (1, 4, 16), 64, 256
EXACT, LONG, LOOSE = 2.0**52, 2.0**62, 2.0**100
LEAST, LARGEST = -(2**63), 2**63 - 1


def segments(x: np.ndarray, n: int) -> np.ndarray:
    """Means and deviations of ``n`` segments, each times the root of its length, side by side."""
    edges = np.linspace(0, x.shape[1], min(n, x.shape[1]) + 1).astype(int)
    size = np.diff(edges)
    mean = np.add.reduceat(x, edges[:-1], 1) / size
    centred = x - np.repeat(mean, size, 1)
    square = np.add.reduceat(centred * centred, edges[:-1], 1) / size
    return np.concatenate([mean, np.sqrt(square)], 1) * np.sqrt(np.r_[size, size])


def products(q: np.ndarray, r: np.ndarray) -> np.ndarray:
    """Exact inner products of whole-numbered rows with whole-numbered rows, as int64; what is beyond that range as its end."""
    with np.errstate(over="ignore"):
        norms = np.sqrt((q * q).sum(1).max()) * np.sqrt((r * r).sum(1).max())  # no partial sum is larger
    if norms < EXACT:
        return (q @ r.T).astype(np.int64)
    if norms < LONG and max(np.abs(q).max(), np.abs(r).max()) < LONG:
        return q.astype(np.int64) @ r.astype(np.int64).T
    whole = np.array([[int(v) for v in row] for row in r], object)
    out = [[min(LARGEST, max(LEAST, int(np.dot(np.array([int(v) for v in row], object), x)))) for x in whole] for row in q]
    return np.array(out, np.int64)


def reached(score: np.ndarray) -> np.ndarray:
    """Scores as bars: the least that 64 bits hold may stand for less, so it keeps nothing out."""
    return np.where(score == LEAST, -np.inf, score.astype(float))


def segment_topk(q: np.ndarray, r: np.ndarray, seeds: np.ndarray, k: int):
    """(query, row, score, rows scored) of the rows that may be among a query's ``k`` best."""
    if max(np.abs(q).max(), np.abs(r).max()) >= LOOSE:  # squares might leave the doubles: no bounds
        score = products(q, r)
        at, row = np.indices(score.shape).reshape(2, -1)
        return at, row, score.ravel(), np.full(len(q), len(r))
    stats = [(segments(q, n), segments(r, n)) for n in LEVELS]
    rest = np.sqrt((r * r).sum(1))
    out, scored = [], np.zeros(len(q), np.int64)
    for i in range(0, len(q), TILE):
        part = slice(i, min(i + TILE, len(q)))
        some = q[part]
        bar = np.full(len(some), -np.inf)
        if len(seeds) >= k:
            bar = reached(np.partition(products(some, seeds), -k, 1)[:, -k])
        # rounding of the bounds: far above what doubles can lose on these sums
        slack = 1e-9 * np.sqrt((some * some).sum(1))[:, None] * rest + 1e-6
        bound = stats[0][0][part] @ stats[0][1].T + slack
        for first, last in ((0, min(len(r), 4 * k)), (min(len(r), 4 * k), len(r))):  # a few rows lift the bar for all others
            rows = np.argsort(-bound.max(0), kind="stable")[first:last]
            open_ = bound[:, rows] >= bar[:, None]
            rows, open_ = rows[open_.any(0)], open_[:, open_.any(0)]
            for a, b in stats[1:]:
                if len(rows):
                    open_ &= a[part] @ b[rows].T + slack[:, rows] >= bar[:, None]
                    rows, open_ = rows[open_.any(0)], open_[:, open_.any(0)]
            if not len(rows):
                continue
            score = products(some, r[rows])
            if len(rows) >= k:
                bar = np.maximum(bar, reached(np.partition(score, -k, 1)[:, -k]))
            open_ &= score >= bar[:, None]
            at, row = np.nonzero(open_)
            out.append((at + i, rows[row], score[at, row]))
            scored[part] += len(rows)
    if not out:
        return np.empty(0, int), np.empty(0, int), np.empty(0, np.int64), scored
    return *(np.concatenate(x) for x in zip(*out)), scored


def topk(embeddings: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", every: int = 50, k: int = 5) -> DataFrame:
    """query_id, rank, vec_id, score: each query's ``k`` highest integer inner products, exact."""
    vectors = usable(embeddings, id_col, vec_col, False)
    # beyond 2^52 a double has no fraction, and floor() would cut it at 2^63
    vectors = vectors.withColumn("vec", F.transform("vec", lambda x: F.when(F.abs(x) < 2.0**44, F.floor(256 * x).cast("double")).otherwise(256 * x)))
    groups, asked = distinct(vectors, every, k)
    seeds = {}
    for row in groups.groupBy("dim").count().orderBy(F.col("count").desc()).limit(64).collect():  # the commonest lengths
        some = groups.where(F.col("dim") == row["dim"]).orderBy("a", "b").limit(SEEDS).toPandas()  # SEEDS rows
        seeds[row["dim"]] = matrix(some["vec"])

    def kernel(values):
        dim = int(values[0])
        return lambda q, r: segment_topk(q, r, seeds.get(dim, np.empty((0, dim))), k + 1)

    return finish(grid(groups, groups.where("asks"), kernel, k, False, "long"), groups, asked, k, False)


ORACLE = """
WITH v AS (
  SELECT vec_id, row_number() OVER () AS row, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.row AS query, q.vec_id AS query_id, r.vec_id AS vec_id,
         CAST(list_sum(list_transform(list_zip(q.e, r.e), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v q JOIN v r ON q.row <> r.row AND len(q.e) = len(r.e)
  WHERE q.vec_id % 50 = 0
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, vec_id) AS rank FROM s)
WHERE rank <= 5
"""
