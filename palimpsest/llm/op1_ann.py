"""Approximate nearest neighbours: multiprobe p-stable hashing with exact reranking.

Each of ``TABLES`` tables has ``HASHES`` functions floor((a.x + b) / w), a Gaussian (2-stable), b uniform in [0, w). A row's
bucket is the tuple of all its slots. The shuffle goes by the bucket's cell, its first slots in steps of ``COARSE``, as many
of them as keep about ``CELL_ROWS`` rows in a cell; cells beyond that are dealt over blocks.
Queries visit perturbed buckets in the order of their estimated success. Moving a coordinate costs the squared distance
from the query's projection to the border that is crossed, a bucket the sum over its coordinates. Cells come first: the
perturbation sets of the coarse slots are made in increasing cost by shifting and expanding a heap, and each query goes to
its own cell and the first ``probes`` of them. Within a cell the buckets that exist are visited in the same order, up to the cost
``reach`` at which a table has given its share of rows. Candidates of all tables are merged; the exact distance, in double
precision on the original vectors, ranks them.

``w`` and ``reach`` are fitted for each vector length on a bounded sample (``SAMPLE`` distinct vectors, lowest print first);
lengths without a sample visit all buckets of their cells. All rows are indexed, no bucket is capped. A query whose tables give fewer
than ``k`` + 1 rows is compared with all rows, in blocks.

Cases: fewer than ``k`` candidates give fewer rows; equal vectors have distance 0 and rank by id; rows that repeat an id
are rows and queries of their own; null, zero and non-finite vectors take no part; an empty table gives no rows; further
columns are ignored.
"""

from __future__ import annotations

import heapq
import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import parts_for, stored
from .vectors import distinct, finish, grid, in_cells, matrix, merged, search_cells, usable

TABLES, HASHES, WIDTH, COARSE, SEED = 10, 40, 1.0, 3.0, 20240607
SHARE, LEAST, SAMPLE = 0.01, 48, 1024
CELL_ROWS, PROBES = 2048, 256


def probe_sets(n: int, probes: int) -> np.ndarray:
    """The first ``probes`` perturbation sets over 2n slots sorted by cost, in order of expected cost.

    Slot j (from 0) and slot 2n-1-j move the same coordinate in opposite directions, so no set holds both. The costs
    are the expectations for uniform projections; a row of the result flags the slots that the set holds.
    """
    j = np.arange(1, 2 * n + 1, dtype=float)
    cost = np.where(j <= n, j * (j + 1) / (4 * (n + 1) * (n + 2)),
                    1 - (2 * n + 1 - j) / (n + 1) + (2 * n + 1 - j) * (2 * n + 2 - j) / (4 * (n + 1) * (n + 2)))
    out, heap = [], [(cost[0], (0,))]
    while heap and len(out) < probes:
        total, held = heapq.heappop(heap)
        last = held[-1]
        if len({min(s, 2 * n - 1 - s) for s in held}) == len(held):
            out.append(held)
        if last + 1 < 2 * n:
            heapq.heappush(heap, (total - cost[last] + cost[last + 1], (*held[:-1], last + 1)))
            heapq.heappush(heap, (total + cost[last + 1], (*held, last + 1)))
    flags = np.zeros((len(out), 2 * n), bool)
    for i, held in enumerate(out):
        flags[i, list(held)] = True
    return flags


def functions(dim: int, table: int, width: float) -> tuple[np.ndarray, np.ndarray]:
    """(a / w, b / w) of a table."""
    rng = np.random.default_rng([SEED, dim, table])
    return rng.standard_normal((dim, HASHES)) / width, rng.random(HASHES)


def costs(place: np.ndarray, slots: np.ndarray, most: float = np.inf) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, row, cost) of all pairs whose bucket costs no more than ``most``; coordinates one by one, most pairs drop out early."""
    total = np.zeros((len(place), len(slots)), np.float32)
    q = r = None
    for d in range(place.shape[1]):
        if q is None:
            gap = slots[None, :, d] - place[:, d, None]
        else:
            gap = slots[r, d] - place[q, d]
        np.maximum(gap, -1 - gap, out=gap)
        np.maximum(gap, 0, out=gap)
        gap *= gap
        total += gap
        if d % 8 == 7 and np.isfinite(most):
            if q is None:
                q, r = np.nonzero(total <= most)
                total = total[q, r]
            else:
                keep = total <= most
                q, r, total = q[keep], r[keep], total[keep]
    if q is None:
        q, r = np.nonzero(total <= most)
        return q, r, total[q, r]
    keep = total <= most
    return q[keep], r[keep], total[keep]


def fit(sample: np.ndarray, rows: int) -> tuple[float, float]:
    """(w, reach) for vectors of one length: slots of WIDTH deviations, and the cost within which a table finds its share."""
    spread = float(np.sqrt(((sample - sample.mean(0)) ** 2).sum(1).mean())) or float(np.abs(sample).max())
    width = WIDTH * spread
    share = min(1.0, max(SHARE, LEAST / max(1, rows)))
    if share >= 1 or len(sample) < 8:
        return width, np.inf
    found = []
    for t in range(2):
        a, b = functions(sample.shape[1], t, width)
        place = (sample @ a + b).astype(np.float32)
        q, r, cost = costs(place[:256], np.floor(place))
        found.append(cost[q != r])
    return width, float(np.quantile(np.concatenate(found), share))


def coarse_slots(rows: int) -> int:
    """How many coarse slots make cells of about CELL_ROWS rows, two cells and a bit for each slot."""
    return int(np.clip(round(math.log(max(1, rows) / CELL_ROWS) / math.log(2.2)), 1, 16))


def cell_key(slots: np.ndarray) -> np.ndarray:
    odd = np.random.default_rng(SEED).integers(1, 2**62, slots.shape[1], dtype=np.int64) | 1
    with np.errstate(over="ignore"):
        return (np.clip(slots, -(2.0**52), 2.0**52).astype(np.int64) * odd).sum(1)


def probed(place: np.ndarray, probes: int) -> np.ndarray:
    """(query, own cell and the first perturbed ones) keys for coarse projections; a set that moves a coordinate both ways repeats the own one."""
    n = place.shape[1]
    base = np.floor(place)
    down = place - base
    single = np.concatenate([down, 1 - down], 1) ** 2
    rank = np.argsort(single, 1, kind="stable")
    step = np.concatenate([-np.ones(n), np.ones(n)])
    coordinate, move = rank % n, step[rank]
    out = [cell_key(base)]
    for flags in probe_sets(n, probes):
        moved = base.copy()
        for s in np.flatnonzero(flags):
            moved[np.arange(len(base)), coordinate[:, s]] += move[:, s]
        out.append(cell_key(moved))
    return np.stack(out, 1)


def hashed(groups: DataFrame, fits: dict[int, tuple[float, float]], slots: int, probes: int, queries: bool) -> DataFrame:
    """The groups in their cells (t, cell), or the query groups in the cells that they visit."""

    def run(pdfs):
        for pdf in pdfs:
            for dim, part in pdf.groupby("dim"):
                x = matrix(part["vec"])
                width = fits.get(dim, (1.0, np.inf))[0]
                for t in range(TABLES):
                    a, b = functions(dim, t, width)
                    place = (x @ a[:, :slots] + b[:slots]) / COARSE
                    keys = probed(place, probes) if queries else cell_key(np.floor(place))[:, None]
                    at = np.repeat(np.arange(len(part)), keys.shape[1])
                    out = part.iloc[at].assign(t=t, cell=keys.ravel())
                    yield (out.drop_duplicates(["a", "b", "cell"]) if queries else out)[["t", "cell", "dim", "a", "b", "least", "vec"]]

    rows = (groups.where("asks") if queries else groups).select("dim", "a", "b", "least", "vec")
    return rows.mapInPandas(run, "t int, cell long, dim int, a long, b long, least long, vec binary")


def visit(t: int, dim: int, fits: dict[int, tuple[float, float]]):
    """The kernel of a cell of table ``t``: exact distances of the rows whose buckets the queries visit."""
    width, reach = fits.get(dim, (1.0, np.inf))
    a, b = functions(dim, t, width)

    def kernel(q: np.ndarray, r: np.ndarray):
        slots = np.floor(r @ a + b).astype(np.float32)
        place = (q @ a + b).astype(np.float32)
        step = max(1, (1 << 20) // len(r))
        pairs = [(i + x, y) for i in range(0, len(q), step) for x, y, _ in [costs(place[i: i + step], slots, reach)]]
        at, row = (np.concatenate(x) for x in zip(*pairs))
        return at, row, distances(q, r, at, row), np.bincount(at, minlength=len(q))

    return kernel


def distances(q: np.ndarray, r: np.ndarray, at: np.ndarray, row: np.ndarray) -> np.ndarray:
    score = np.empty(len(at))
    for i in range(0, len(at), 1 << 15):
        s = slice(i, i + (1 << 15))
        score[s] = np.sqrt(((q[at[s]] - r[row[s]]) ** 2).sum(1))
    return score


def all_pairs(q: np.ndarray, r: np.ndarray):
    at, row = np.divmod(np.arange(len(q) * len(r)), len(r))
    return at, row, distances(q, r, at, row), np.full(len(q), len(r))


def candidates(groups: DataFrame, k: int) -> DataFrame:
    """The tables' lists; ``scored`` is how many rows a query met in that cell."""
    spark = groups.sparkSession
    n = groups.groupBy("dim").agg(F.count("*").alias("n")).orderBy(F.col("n").desc()).limit(64).collect()  # the commonest lengths
    fits = {}
    for row in n:
        some = groups.where(F.col("dim") == row["dim"]).orderBy("a", "b").limit(SAMPLE).toPandas()  # SAMPLE rows
        fits[row["dim"]] = fit(matrix(some["vec"]), row["n"])
    n_rows = groups.count()
    slots = coarse_slots(n_rows)
    probes = min(PROBES, math.ceil(0.6 * 3**slots))
    rows, asked = hashed(groups, fits, slots, probes, False), hashed(groups, fits, slots, probes, True)
    key = ["t", "dim", "cell"]
    sizes = rows.groupBy(*key).agg(F.count("*").alias("n_rows")).join(asked.groupBy(*key).agg(F.count("*").alias("n_asked")), key)
    sizes = stored(sizes, "ann-cells").select(*key, "n_rows", "n_asked")
    cells = in_cells(rows.join(sizes, key), asked.join(sizes, key), key, F.col("n_rows"), F.col("n_asked"), 2 * CELL_ROWS, CELL_ROWS)
    return search_cells(cells, key, lambda v: visit(int(v[0]), int(v[1]), fits), k, True, "double", parts_for(n_rows * TABLES, 2 * CELL_ROWS))


def nearest(embeddings: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", every: int = 100, k: int = 10) -> DataFrame:
    """query_id, rank, vec_id, score: each query's ``k`` nearest rows found, by Euclidean distance."""
    groups, asked = distinct(usable(embeddings, id_col, vec_col, True), every, k)
    # a query's lists become one before any join: its k + 1 best groups hold more than k rows, or they are all that it met
    lists = stored(merged(candidates(groups, k), k, True), "ann-lists")
    met = lists.join(groups.select("a", "b", F.size("ids").alias("n")), ["a", "b"])
    enough = met.groupBy(F.col("qa").alias("a"), F.col("qb").alias("b")).agg(F.sum("n").alias("n")).where(F.col("n") > k)
    few = groups.where("asks").join(enough, ["a", "b"], "left_anti")
    more = grid(groups, few, lambda _: all_pairs, k, True, "double")
    return finish(lists.unionByName(more.drop("scored")), groups, asked, k, True)
