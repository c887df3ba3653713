"""N-gram Jaccard join: MinHash LSH forest with prefixes shortened until the target recall, and exact verification.

A document is the set of its ``WORDS``-word shingles (lower-cased ``\\w+`` words, 64-bit hashes); a text of 1 to 4 words
is the one shingle of all its words, a text without words has none and meets nothing. Documents with equal sets are
one class of copies, represented by the smallest doc_id; only representatives are joined.
Forest: each of ``TREES`` prefix tries holds signatures of ``DEPTH`` MinHash values; a node of a trie, the documents that share a
prefix, is a bucket. Buckets of equal members, in any tree and at any depth, are one, at the greatest of their depths. The join begins with
the longest prefixes and verifies what meets there. From the similarities found it estimates its recall: a pair of similarity s
meets at depth m with probability 1 - (1 - s^m)^trees, so each found pair stands for the inverse of that. While the estimate
is below ``RECALL`` the prefixes are shortened by one value; they need not be shorter than where even pairs at the threshold
itself meet with that probability.
A bucket of any size is dealt over cells of two bounded blocks; a cell compares its documents by one matrix product of shingle
counts and keeps pairs whose exact Jaccard is ``SIMILARITY`` or more. A pair that meets in several buckets counts in the deepest
of them, of these in the least of their numbers. Cells return links per document and a spanning forest, never the pairs. Classes
are the connected components, found by rounds of minimum labels.

Result: one row for each row of the input: doc_id, class_id (smallest doc_id of its class), n_links (other rows at or
above the threshold, copies included).

Cases: null texts count as empty; rows without words are classes of their own with 0 links; null doc_ids are kept
as rows: they are never joined and get class_id null and 0 links; repeated doc_ids are one document if their texts
have equal sets, and otherwise each row joins by its own text; an empty
table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import re
from functools import reduce

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, grouped, slim, stored

WORDS, SIMILARITY, TREES, DEPTH, RECALL, BINS = 5, 0.8, 8, 3, 0.999, 40
CELL_ROWS, CELL_SHINGLES, MEMO = 512, 400_000, 100_000
WORD = re.compile(r"\w+")
_rng = np.random.default_rng(91)
MULTIPLY = _rng.integers(1, 2**63, (TREES, DEPTH), dtype=np.uint64) | np.uint64(1)
ADD = _rng.integers(0, 2**63, (TREES, DEPTH), dtype=np.uint64)
ODD = np.uint64(0x9E3779B97F4A7C15)


def meeting(similarity, depth: int, trees: int = TREES):
    """The probability that a pair shares a prefix of ``depth`` values in a tree."""
    return 1 - (1 - similarity**depth) ** trees


def depth_for(similarity: float, recall: float, trees: int = TREES, depth: int = DEPTH) -> int:
    """The longest prefix whose expected recall at the threshold is enough; 1 if none is."""
    while depth > 1 and meeting(similarity, depth, trees) < recall:
        depth -= 1
    return depth


def estimated_recall(found: dict[int, int], depth: int) -> float:
    """From the number of pairs by similarity (in ``BINS``, taken at a bin's lower end) found at ``depth`` and deeper; 0 without any."""
    all_ = sum(n / meeting(max(bin_, 1) / BINS, depth) for bin_, n in found.items())
    return sum(found.values()) / all_ if all_ else 0.0


def shingles(text: str | None, memo: dict, words: int = WORDS) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's shingles."""
    found = WORD.findall(text.lower()) if text else []
    if not found:
        return np.empty(0, np.uint64)
    hashed = []
    for w in found:
        h = memo.get(w)
        if h is None:
            h = xxhash.xxh3_64_intdigest(w.encode("utf-8", "surrogatepass"))
            if len(memo) > MEMO:
                memo.clear()
            memo[w] = h
        hashed.append(h)
    h = np.array(hashed, np.uint64)
    n = max(1, len(h) - words + 1)
    out = np.full(n, len(h) if len(h) < words else words, np.uint64)
    for k in range(min(words, len(h))):
        out = (out ^ h[k: k + n]) * ODD
        out ^= out >> np.uint64(29)
    return np.unique(out)


def tree_keys(s: np.ndarray) -> np.ndarray:
    """For each depth and tree the hash of the signature's prefix."""
    keys, out = np.arange(1, TREES + 1, dtype=np.uint64), []
    for d in range(DEPTH):
        x = s[None, :] * MULTIPLY[:, d, None] + ADD[:, d, None]
        keys = (keys ^ (x ^ (x >> np.uint64(32))).min(1)) * ODD
        out.append((keys ^ (keys >> np.uint64(31))).view(np.int64))
    return np.concatenate(out)


def signed(digest: int) -> tuple[int, int]:
    """The two halves of a 128-bit number as longs."""
    return tuple((x & (2**64 - 1)) - ((x >> 63 & 1) << 64) for x in (digest >> 64, digest))


def sketch(documents: DataFrame) -> DataFrame:
    """row, doc_id, h (hash of the text), a, b (128-bit print of the shingle set; null without words), n, keys."""

    def run(batches):
        memo: dict = {}
        for pdf in batches:
            a, b, n, keys = [], [], [], []
            for text in pdf["text"]:
                s = shingles(text, memo)
                n.append(len(s))
                high, low = signed(xxhash.xxh3_128_intdigest(s.tobytes()))
                a.append(high if len(s) else None)
                b.append(low if len(s) else None)
                keys.append(tree_keys(s) if len(s) else None)
            yield pd.DataFrame({"row": pdf["row"], "doc_id": pdf["doc_id"], "h": pdf["h"], "a": pd.array(a, "Int64"), "b": pd.array(b, "Int64"), "n": n, "keys": keys})

    rows = documents.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("h"), "text")
    ids = rows.withColumn("doc_id", F.col("doc_id").cast("string"))
    return ids.mapInPandas(slim(run), "row long, doc_id string, h long, a long, b long, n int, keys array<long>").withColumn("doc_id", F.col("doc_id").cast("long"))


def compare(cell: pd.DataFrame, bucket: int, similarity: float, within: bool) -> pd.DataFrame:
    """Links and spanning forest of one cell; rows carry side (0: first block, 1: second), copies and keys.

    ``within``: the cell is one block against itself; else a block may be empty, and then nothing meets.
    """
    sets = [np.frombuffer(b, np.uint64) for b in cell["shingles"]]
    sides, copies, ids = cell["side"].to_numpy(), cell["copies"].to_numpy(), cell["rep"].to_numpy()
    keys = np.stack(cell["keys"])
    one, two = np.flatnonzero(sides == 0), np.flatnonzero(sides == 1)
    if within:
        two = one
    size = np.array([len(s) for s in sets])
    flat = np.concatenate(sets)
    owner = np.repeat(np.arange(len(sets)), size)
    # shingles that only one document holds add to no intersection
    values, at, times = np.unique(flat, return_inverse=True, return_counts=True)
    useful = times > 1
    column = np.cumsum(useful) - 1
    keep = useful[at]
    owner, at = owner[keep], column[at[keep]]
    shared = np.zeros((len(one), len(two)), np.float32)
    order = np.argsort(at, kind="stable")
    owner, at = owner[order], at[order]
    row = np.full(len(sets), -1)
    row[one] = np.arange(len(one))
    col = np.full(len(sets), -1)
    col[two] = np.arange(len(two))
    width = min(4096, max(1, int(useful.sum())))
    for begin in range(0, int(useful.sum()), width):
        lo, hi = np.searchsorted(at, [begin, begin + width])
        o, a = owner[lo:hi], at[lo:hi] - begin
        left, right = np.zeros((len(one), width), np.float32), np.zeros((len(two), width), np.float32)
        m = row[o] >= 0
        left[row[o[m]], a[m]] = 1
        m = col[o] >= 0
        right[col[o[m]], a[m]] = 1
        shared += left @ right.T
    union = size[one][:, None] + size[two][None, :] - shared
    close = shared >= similarity * union - 1e-6
    if within:
        np.fill_diagonal(close, False)
    x, y = np.nonzero(close)
    i, j, similar = one[x], two[y], shared[x, y] / union[x, y]
    same = keys[i] == keys[j]
    first = np.where(same, keys[i], ABSENT).min(1)
    mine = first == bucket
    i, j = i[mine], j[mine]
    bins = np.bincount(np.floor(similar[mine] * BINS + 1e-6).astype(int), minlength=BINS + 1) // (2 if within else 1)
    links = np.bincount(i, copies[j], len(sets)) + (0 if within else np.bincount(j, copies[i], len(sets)))
    parent = np.arange(len(sets))

    def root(v):
        while parent[v] != v:
            parent[v] = parent[parent[v]]
            v = parent[v]
        return v

    for u, v in zip(i, j):
        p, q = root(u), root(v)
        if p != q:
            parent[max(p, q)] = min(p, q)
    roots = np.array([root(v) for v in range(len(sets))])
    hit = links > 0
    held = np.flatnonzero(bins)
    return pd.DataFrame({"rep": np.r_[ids[hit], np.zeros(len(held), np.int64)], "links": np.r_[links[hit], np.zeros(len(held))].astype(np.int64), "to": np.r_[ids[roots[hit]], np.zeros(len(held), np.int64)],
                         "bin": np.r_[np.full(hit.sum(), -1), held].astype(np.int32), "pairs": np.r_[np.zeros(hit.sum()), bins[held]].astype(np.int64)})


def components(edges: DataFrame, most: int = 60) -> DataFrame:
    """(rep, class): minimum labels over (rep, to) edges; labels jump along each other, so rounds grow with the log."""
    both = cut(edges.select("rep", "to").unionByName(edges.select(F.col("to").alias("rep"), F.col("rep").alias("to"))).distinct())
    labels = cut(both.groupBy("rep").agg(F.least(F.min("to"), F.col("rep")).alias("label")))
    for _ in range(most):
        seen = both.join(labels.select(F.col("rep").alias("to"), F.col("label").alias("near")), "to").groupBy("rep").agg(F.min("near").alias("near"))
        better = labels.join(seen, "rep").select("rep", "label", F.least("label", "near").alias("fresh"))
        jump = better.join(labels.select(F.col("rep").alias("fresh"), F.col("label").alias("further")), "fresh", "left")
        fresh = cut(jump.select("rep", "label", F.least("fresh", "further").alias("fresh")))
        changed = fresh.where("fresh < label").limit(1).count()
        labels = fresh.select("rep", F.col("fresh").alias("label"))
        if not changed:
            return labels.withColumnRenamed("label", "class")
    raise RuntimeError(f"no fixed labels after {most} rounds")


def classes(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY,
            recall: float = RECALL) -> DataFrame:
    """row, doc_id, h (hash of the text), class (a number of the class), class_id, n_links, worded for each row."""
    docs = documents.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = stored(sketch(docs), "jaccard-sketch")
    met = rows.where(F.col("a").isNotNull() & F.col("doc_id").isNotNull())
    # one representative for each distinct set
    reps = cut(met.groupBy("a", "b").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies"), F.max("n").alias("n"), F.max("keys").alias("keys")).withColumn("node", F.xxhash64("a", "b")))
    nodes = reps.select("rep", "a", "b", "n", F.posexplode("keys").alias("at", "key")).withColumn("depth", F.floor(F.col("at") / TREES) + 1)
    buckets = nodes.groupBy("key").agg(F.count("*").alias("members"), F.sum("n").alias("weight"), F.first("depth").alias("depth"),
                                       F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("who")).where("members > 1")
    # buckets of equal members are one: the least number of the deepest, numbered so that deeper ones come first
    number = F.shiftleft(F.lit(DEPTH) - F.col("depth"), 60).bitwiseOR(F.col("key").bitwiseAND((1 << 60) - 1))
    same = Window.partitionBy("members", "who", "weight")
    buckets = cut(buckets.select("key", "members", "weight", F.min(number).over(same).alias("bucket")))
    homes = nodes.join(buckets, "key").groupBy("a", "b").agg(F.min("rep").alias("rep"), F.collect_list(F.struct("at", "bucket", "members", "weight")).alias("homes"))
    homes = homes.join(reps.select("a", "b", "node", "copies"), ["a", "b"]).select(
        F.col("rep").alias("doc_id"), "a", "b", "node", "copies", F.transform("homes", lambda h: h["at"]).alias("at"),
        F.transform("homes", lambda h: h["bucket"]).alias("bucket"),
        F.transform("homes", lambda h: F.greatest(F.ceil(h["members"] / CELL_ROWS), F.ceil(h["weight"] / CELL_SHINGLES)).cast("long")).alias("blocks"))
    homes = cut(homes)

    def run(batches):
        for cell in grouped(batches, ["bucket", "i", "j"]):
            within = bool(cell["i"].iloc[0] == cell["j"].iloc[0])
            if len(cell) > 1 and (within or cell["side"].nunique() == 2):
                yield compare(cell, int(cell["bucket"].iloc[0]), similarity, within)

    met_at: dict[int, int] = {}
    levels = []
    for depth in range(DEPTH, depth_for(similarity, recall) - 1, -1):
        here = homes.where(F.exists("bucket", lambda b: F.shiftright(b, 60) == DEPTH - depth))
        cells = docs.join(here, "doc_id").mapInPandas(slim(deal_at(depth)), CELL).repartition("bucket", "i", "j").sortWithinPartitions("bucket", "i", "j", "a")
        levels.append(stored(cells.mapInPandas(slim(run), "rep long, links long, to long, bin int, pairs long"), "jaccard-links"))
        for r in levels[-1].where("bin >= 0").groupBy("bin").agg(F.sum("pairs").alias("n")).collect():  # BINS rows
            met_at[r["bin"]] = met_at.get(r["bin"], 0) + r["n"]
        if estimated_recall(met_at, depth) >= recall:
            break
    found = reduce(DataFrame.unionByName, levels).where("bin < 0")
    links = found.groupBy("rep").agg(F.sum("links").alias("links"))
    labels = components(found.where("rep <> to"))
    known = reps.select("a", "b", "rep", "copies", "node").join(links.withColumnRenamed("rep", "node"), "node", "left").join(labels.withColumnRenamed("rep", "node"), "node", "left")
    known = cut(known.withColumn("class", F.coalesce("class", "node")))
    least = known.groupBy("class").agg(F.min("rep").alias("class_id"))
    known = known.join(least, "class").select("a", "b", "class", "class_id", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    # null prints get keys of their own, so that no two of them meet
    keyed = rows.select("row", "doc_id", "h", F.when(F.col("doc_id").isNotNull(), F.col("a")).alias("a"), "b").select(
        "row", "doc_id", "h", F.coalesce("a", F.xxhash64("row")).alias("a"), F.when(F.col("a").isNotNull(), F.col("b")).alias("b"))
    return keyed.join(cut(known), ["a", "b"], "left").select(
        "row", "doc_id", "h", "class", F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.col("class_id").isNotNull().alias("worded"))


CELL = "bucket long, i int, j int, side int, rep long, a long, copies long, keys array<long>, shingles binary"
ABSENT = np.iinfo(np.int64).max


def deal_at(depth: int):
    """Deals representatives, with their shingles, to the cells of their buckets of that depth."""

    def deal(batches):
        memo: dict = {}
        for pdf in batches:
            out, size = [], 0
            for text, a, b, node, copies, at, bucket, blocks in zip(*(pdf[c] for c in ("text", "a", "b", "node", "copies", "at", "bucket", "blocks"))):
                s = shingles(text, memo)
                raw = s.tobytes()
                if signed(xxhash.xxh3_128_intdigest(raw)) != (a, b):
                    continue  # another row of the same doc_id, with other words
                keys = np.full(TREES * DEPTH, ABSENT)
                keys[np.asarray(at)] = bucket
                for home, n in dict(zip(map(int, bucket), map(int, blocks))).items():
                    if home >> 60 != DEPTH - depth:
                        continue
                    own = xxhash.xxh3_64_intdigest(f"{a} {b} {home}") % n
                    for other in range(n):
                        out.append((home, min(own, other), max(own, other), int(other < own), node, a, copies, keys, raw))
                        size += len(raw)
                        if size > 16 << 20:
                            yield pd.DataFrame(out, columns=NAMES)
                            out, size = [], 0
            if out:
                yield pd.DataFrame(out, columns=NAMES)

    return deal


NAMES = [c.split()[0] for c in CELL.split(", ")]


def without_near_copies(documents: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """One row of each class: that of the smallest doc_id, of equal ids that of the smallest text hash. Null ids and texts without words stay.

    Rows of one doc_id with different texts are documents of their own; of rows that repeat both the first by all columns stays.
    """
    rows = stored(classes(documents, similarity=similarity).where("worded AND doc_id IS NOT NULL").select("doc_id", "h", "class"), "jaccard-classes")
    best = rows.groupBy("class").agg(F.min(F.struct("doc_id", "h")).alias("best"))
    # a class of copies is one row of ``best``; only what goes is joined with the texts
    gone = rows.join(best, "class").where(F.struct("doc_id", "h") != F.col("best")).select(F.col("doc_id").alias("_id"), F.col("h").alias("_h")).distinct()
    keyed = documents.withColumns({"_id": F.col("doc_id").cast("long"), "_h": F.xxhash64(F.coalesce("text", F.lit("")))})
    kept = keyed.join(gone, ["_id", "_h"], "left_anti")
    if rows.groupBy("doc_id", "h").count().where("count > 1").limit(1).count():
        worded = F.coalesce("text", F.lit("")).rlike(r"(?U)\w") & F.col("_id").isNotNull()
        first = F.row_number().over(Window.partitionBy("_id", "_h").orderBy(*[c for c in documents.columns]))
        kept = kept.withColumn("_n", first).where((F.col("_n") == 1) | ~worded)
    return kept.select(*documents.columns)
