"""Phrase collocations: phrases of 2 to 5 words that occur often and more often than their parts let expect.

Counts come from weighted acyclic automata. A shard, the blocks of a task until they have ``HELD`` different n-grams, gives its
n-grams in sorted order; they are cut where ranges of phrases end, and a count transducer is built from each part. A range unites
its transducers in order, adds up weights and builds that of the phrases that occur ``least`` times. The parts of a candidate are
looked up by composing the phrases asked of a range with its transducer.

Passes before that find what can be frequent at all: words, then runs of two and of three words whose shorter runs are frequent, are
counted by 64-bit hashes, and the frequent ones set bits in filters of 2**``BITS`` bits (4 MB each, broadcast, whatever the corpus). A
phrase all of whose runs pass may be frequent; a shared bit lets more pass and drops nothing, since counts are by the words themselves.

A text is read whole, in blocks of ``BLOCK`` bytes of one language; a longer text goes in several, each beginning with the last
four words of the one before, which are not counted twice. Where the ranges, of some ``PER_RANGE`` words of text each, end is taken
from a bounded sample; the result does not depend on it.

Cases: null and empty texts have no words; a null lang is ``und``; doc_ids play no part, so null and repeated ones are rows like
others; phrases of equal score are ordered by count, then by their bytes; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import heapq
import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stored
from .transducers import Transducer, build, compose

LEAST, LONGEST, MOST, INSIDE = 100, 5, 2000, 100
BITS, FILTERS, BLOCK, PER_RANGE, SALTS = 25, 3, 2 << 20, 1_000_000, 16
#: For the cuts of the ranges only: documents, characters of each, and phrases that are looked at.
TAKEN, LOOK, SAMPLE = 2000, 4000, 10_000
#: Different n-grams of a shard, and bytes whose hashes are worked out together.
HELD, TOGETHER = 150_000, 1 << 18
WORD, GAP, END = 0, 1, 2
KIND = np.zeros(256, np.uint8)
KIND[[0x20, 0x09]] = GAP
KIND[[*b".,;:!?", *range(0x0A, 0x0E)]] = END
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
BREAK = re.compile(rb"[.,;:!? \t-\r]")
BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and its inverse modulo 2**64."""
    if base not in _powers or len(_powers[base][0]) < n:
        made = []
        for b in (base, pow(base, -1, 1 << 64)):
            p = np.full(n + (n >> 2), b, np.uint64)
            p[0] = 1
            made.append(np.cumprod(p, dtype=np.uint64))
        _powers[base] = (made[0], made[1])
    return _powers[base]


def mixed(x: np.ndarray) -> np.ndarray:
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return x ^ (x >> np.uint64(31))


def slices(data: bytes, size: int) -> Iterator[tuple[bytes, int]]:
    """A long text in slices that begin with up to LONGEST - 1 words of the one before, and the number of these words."""
    at = 0
    while at < len(data):
        found = BREAK.search(data, at + size)
        end = found.end() if found else len(data)
        begin, carried = at, 0
        while begin and carried < LONGEST - 1:
            j = begin
            while j and KIND[data[j - 1]] == GAP:
                j -= 1
            if not j or KIND[data[j - 1]] == END:
                break
            while j and KIND[data[j - 1]] == WORD:
                j -= 1
            begin, carried = j, carried + 1
        yield data[begin:end], carried
        at = end


def blocks(batches, size: int) -> Iterator[tuple[str, bytes, int]]:
    """(lang, bytes, words carried over) of batches of (lang, text)."""
    held: dict[str, list[bytes]] = {}
    weight: dict[str, int] = {}
    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            data = text.encode("utf-8", "surrogatepass")
            if len(data) > size:
                yield from ((lang, *piece) for piece in slices(data, size))
                continue
            held.setdefault(lang, []).append(data)
            weight[lang] = weight.get(lang, 0) + len(data)
            if weight[lang] >= size:
                yield lang, b"\n".join(held.pop(lang)), 0
                weight[lang] = 0
            elif sum(weight.values()) >= 4 * size:  # many languages: none is large
                yield from ((x, b"\n".join(texts), 0) for x, texts in held.items())
                held.clear()
                weight.clear()
    for lang, texts in held.items():
        yield lang, b"\n".join(texts), 0


class Block:
    """Words of a block: places, 64-bit hashes (lang included), and whether the next word follows in the same piece."""

    def __init__(self, lang: str, data: bytes) -> None:
        self.data = LOWER[np.frombuffer(data, np.uint8)]
        kind = KIND[self.data]
        edge = np.flatnonzero(np.diff(np.concatenate(([0], (kind == WORD).view(np.int8), [0]))))
        self.start, self.end = edge[::2], edge[1::2]
        ends = np.cumsum(kind == END, dtype=np.int32)
        piece = ends[self.start] if len(self.start) else self.start
        self.follows = piece[1:] == piece[:-1]
        own = np.frombuffer(lang.encode("utf-8", "surrogatepass").ljust(1, b"\0"), np.uint8)
        self.lang = np.uint64(int.from_bytes(own.tobytes() + b"\1", "little") % 0xFFFFFFFFFFFFFFC5)
        self.hash = self.hashes(BASES[0])

    def hashes(self, base: int) -> np.ndarray:
        """Hashes of the words, some ``TOGETHER`` bytes of text (a whole word at least) at a time."""
        out, at = np.empty(len(self.start), np.uint64), 0
        with np.errstate(over="ignore"):
            while at < len(out):
                first = self.start[at]
                end = max(at + 1, int(np.searchsorted(self.end, first + TOGETHER, "right")))
                part = self.data[first: self.end[end - 1]]
                up, down = powers(base, max(TOGETHER, len(part)) + 1)
                sums = np.zeros(len(part) + 1, np.uint64)
                np.cumsum((part.astype(np.uint64) + np.uint64(1)) * up[: len(part)], dtype=np.uint64, out=sums[1:])
                begin = self.start[at:end] - first
                out[at:end] = (sums[self.end[at:end] - first] - sums[begin]) * down[begin]
                at = end
            return mixed(out + self.lang)

    def word(self, i: int) -> bytes:
        return self.data[self.start[i]: self.end[i]].tobytes()


def passes(hashes: np.ndarray, bits: np.ndarray) -> np.ndarray:
    slot = hashes >> np.uint64(64 - BITS)
    return (bits[slot >> np.uint64(3)] >> (slot & np.uint64(7)).astype(np.uint8)) & 1 == 1


def runs(block: Block, filters: list[np.ndarray]) -> tuple[list[np.ndarray], np.ndarray]:
    """For 1, 2, ... words, one number more than there are filters: where so many begin in one piece whose shorter runs all pass;
    and the hashes of the longest."""
    h, there = block.hash, [np.ones(len(block.hash), bool)]
    with np.errstate(over="ignore"):
        for size, bits in enumerate(filters, 2):
            ok = there[-1]
            ok[ok] = passes(h[ok], bits)
            both = ok[:-1] & ok[1:]
            if size == 2:
                both &= block.follows
            there.append(both)
            h = mixed(h[:-1] * np.uint64(3) + (block.hash[size - 1:] ^ np.uint64(BASES[1])))
    return there, h


def level_counts(lang: str, data: bytes, carried: int, *filters: np.ndarray) -> Iterator[tuple[str | None, np.ndarray, np.ndarray]]:
    """Hashes and counts of the block's runs of one word more than there are filters; of words their number by lang too."""
    block = Block(lang, data)
    if not filters:
        yield lang, np.zeros(1, np.uint64), np.array([len(block.hash) - carried])
    there, h = runs(block, list(filters))
    here = there[-1]
    here[: max(0, carried - len(filters))] = False  # those that end in words carried over
    yield None, *np.unique(h[here], return_counts=True)


def ngrams(lang: str, data: bytes, carried: int, *filters: np.ndarray) -> list[tuple[tuple[bytes, ...], int]]:
    """The block's possible phrases of up to LONGEST words with their counts."""
    block = Block(lang, data)
    if not len(block.hash):
        return []
    there, h = runs(block, list(filters[:-1]))
    there[-1][there[-1]] = passes(h[there[-1]], filters[-1])
    ok, n = there[0], len(block.hash)
    if not ok.any():
        return []
    at = np.flatnonzero(ok)
    _, rep, inverse = np.unique(block.hash[at], return_index=True, return_inverse=True)
    size, other = block.end[at] - block.start[at], block.hashes(BASES[1])[at]
    if ((other != other[rep][inverse]) | (size != size[rep][inverse])).any():  # two words of one hash: told apart by all of them
        _, rep, inverse = np.unique(np.rec.fromarrays([block.hash[at], other, size]), return_index=True, return_inverse=True)
    spelled = [block.word(at[i]) for i in rep]
    order = sorted(range(len(spelled)), key=spelled.__getitem__)
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    spelled = [spelled[i] for i in order]
    word = np.full(n, -1, np.int64)
    word[at] = rank[inverse]
    out: list[tuple[tuple[bytes, ...], int]] = []
    above, label, first = [()], np.zeros(n, np.int64), at
    for size in range(1, LONGEST + 1):
        known = there[min(size, len(there)) - 1]  # runs of that many words end a longer phrase
        last = first + size - min(size, len(there))
        first = first[last < len(known)]
        first = first[known[first + size - min(size, len(there))]]
        if not len(first):
            break
        codes, inverse = np.unique(label[first] * len(spelled) + word[first + size - 1], return_inverse=True)
        counts = np.bincount(inverse[first + size - 1 >= carried], minlength=len(codes))
        above = [(*above[p], spelled[w]) for p, w in zip((codes // len(spelled)).tolist(), (codes % len(spelled)).tolist())]
        out += [(phrase, c) for phrase, c in zip(above, counts.tolist()) if c]
        label[first] = inverse
    return out


def by_blocks(docs: DataFrame, count, size: int, *filters) -> DataFrame:
    """lang, h, c: what ``count`` gives for all blocks; ``filters`` are broadcast bit filters."""
    def run(batches):
        for lang, data, carried in blocks(batches, size):
            for of, h, c in count(lang, data, carried, *[f.value for f in filters]):
                if len(h):
                    yield pa.RecordBatch.from_arrays([pa.array([of] * len(h), pa.string()), pa.array(h.view(np.int64)), pa.array(c.astype(np.int64))], names=["lang", "h", "c"])

    return docs.mapInArrow(run, "lang string, h long, c long").groupBy("lang", "h").agg(F.sum("c").alias("c"))


def bit_filter(frequent: DataFrame):
    """The broadcast filter of the hashes: bits at their first BITS bits."""
    slot = F.shiftrightunsigned("h", 64 - BITS) + 1
    rows = frequent.select(slot.alias("slot")).groupBy(F.bitmap_bucket_number("slot").alias("k")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("slot")).alias("bits")).collect()
    bits = np.zeros(1 << BITS >> 3, np.uint8)  # 2**BITS / 8 bytes, however many rows there are
    for r in rows:
        bits[(r["k"] - 1) * 4096: r["k"] * 4096] = np.frombuffer(bytes(r["bits"]), np.uint8)
    return frequent.sparkSession.sparkContext.broadcast(bits)


def key(lang: str, phrase: tuple[bytes, ...]) -> tuple[bytes, ...]:
    return (lang.encode("utf-8", "surrogatepass"), *phrase)


def cut_points(docs: DataFrame, filters: list, ranges: int, size: int) -> list[tuple[bytes, ...]]:
    """Keys that cut the phrases in about so many ranges, from those of the first characters of some documents."""
    rows = docs.count()
    if ranges < 2 or not rows:
        return []
    some = docs.sample(min(1.0, 2 * TAKEN / rows), 1).select("lang", F.substring("text", 1, LOOK).alias("text")).limit(TAKEN)

    def run(batches):
        for lang, data, carried in blocks(batches, size):
            found = [key(lang, p) for p, _ in ngrams(lang, data, carried, *[f.value for f in filters])]
            kept = found[:: max(1, len(found) // 1000)]
            yield pa.RecordBatch.from_arrays([pa.array([b" ".join(k) for k in kept], pa.binary())], names=["key"])

    keys = sorted(tuple(bytes(r["key"]).split(b" ")) for r in some.mapInArrow(run, "key binary").orderBy(F.xxhash64("key"), "key").limit(SAMPLE).collect())
    want = min(ranges, len(keys))
    return sorted({keys[i * len(keys) // want] for i in range(1, want)})


def shards(docs: DataFrame, filters: list, cuts: list[tuple[bytes, ...]], size: int, held: int = HELD) -> DataFrame:
    """range, lang, automaton: the transducers of a shard's sorted phrases, one for each range that it has phrases of."""
    def run(batches):
        counts: dict[str, dict[tuple[bytes, ...], int]] = {}
        known = 0

        def flush():
            for lang in sorted(counts):
                found, own = sorted(counts[lang].items()), counts.pop(lang)
                own.clear()
                edges = [bisect_left(found, (cut[1:], 0)) if cut[0] == key(lang, ())[0] else len(found) if cut > key(lang, ()) else 0 for cut in cuts]
                rows = [(at, lang, build(found[a:b]).dump()) for at, (a, b) in enumerate(zip([0, *edges], [*edges, len(found)])) if a < b]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int32(), pa.string(), pa.binary()))], names=["range", "lang", "automaton"])

        for lang, data, carried in blocks(batches, size):
            own = counts.setdefault(lang, {})
            before = len(own)
            for phrase, c in ngrams(lang, data, carried, *[f.value for f in filters]):
                own[phrase] = own.get(phrase, 0) + c
            known += len(own) - before
            if not own:
                del counts[lang]
            if known >= held:
                yield from flush()
                known = 0
        yield from flush()

    return docs.mapInArrow(run, "range int, lang string, automaton binary")


def united(dealt: DataFrame, cuts: list[tuple[bytes, ...]], least: int) -> DataFrame:
    """The frequent phrases by range: rows of kind automaton (range, lang, automaton), phrase (lang, phrase, a) and ask (range, lang, phrase)."""
    def unite(group: pd.DataFrame) -> pd.DataFrame:
        at = int(group["range"].iloc[0])
        rows, asked = [], set()
        for lang, some in group.groupby("lang"):
            own = [(p, w) for p, w in summed(Transducer.load(bytes(a)) for a in some["automaton"]) if w >= least]
            if not own:
                continue
            rows.append(("automaton", at, lang, None, 0, build(own).dump()))
            for phrase, a in own:
                if len(phrase) > 1:
                    rows.append(("phrase", at, lang, b" ".join(phrase), a, None))
                    asked |= {(lang, part) for k in range(1, len(phrase)) for part in (phrase[:k], phrase[k:])}
        rows += [("ask", bisect_right(cuts, key(lang, p)), lang, b" ".join(p), 0, None) for lang, p in sorted(asked)]
        return pd.DataFrame(rows, columns=["kind", "range", "lang", "phrase", "a", "automaton"])

    return dealt.groupBy("range").applyInPandas(unite, "kind string, range int, lang string, phrase binary, a long, automaton binary")


def summed(automata) -> Iterator[tuple[tuple[bytes, ...], int]]:
    """The union of transducers in rising order, weights added."""
    last, total = None, 0
    for phrase, weight in heapq.merge(*automata):
        if phrase != last:
            if last is not None:
                yield last, total
            last, total = phrase, 0
        total += weight
    if last is not None:
        yield last, total


def part_counts(rows: DataFrame) -> DataFrame:
    """lang, phrase, f of all phrases that were asked for."""
    def look(asks: pd.DataFrame, automata: pd.DataFrame) -> pd.DataFrame:
        out = []
        for lang, some in asks.groupby("lang"):
            acceptor = build((p, 0) for p in sorted(tuple(bytes(x).split(b" ")) for x in some["phrase"]))
            for a in automata.loc[automata["spoken"] == lang, "counts"]:
                out += [(lang, b" ".join(p), f) for p, f in compose(acceptor, Transducer.load(bytes(a)))]
        return pd.DataFrame(out, columns=["lang", "phrase", "f"])

    # both sides read one table: names of their own keep their columns apart
    asks = rows.where("kind = 'ask'").select(F.col("range").alias("to"), "lang", "phrase").distinct()
    automata = rows.where("kind = 'automaton'").select(F.col("range").alias("of"), F.col("lang").alias("spoken"), F.col("automaton").alias("counts"))
    return asks.groupBy("to").cogroup(automata.groupBy("of")).applyInPandas(look, "lang string, phrase binary, f long")


def collocations(documents: DataFrame, least: int = LEAST, most: int = MOST, inside: int = INSIDE, block: int = BLOCK, per_range: int = PER_RANGE, held: int = HELD) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's first ``most`` phrases."""
    docs = documents.where("text <> ''").select(F.coalesce("lang", F.lit("und")).alias("lang"), "text")
    counts = stored(by_blocks(docs, level_counts, block).where((F.col("c") >= least) | F.col("lang").isNotNull()), "phrase-words")
    filters = [bit_filter(counts.where("lang IS NULL"))]
    while len(filters) < FILTERS:
        filters.append(bit_filter(by_blocks(docs, level_counts, block, *filters).where(F.col("c") >= least)))
    total = counts.where("lang IS NOT NULL").agg(F.sum("c").alias("n")).first()["n"] or 0
    cuts = cut_points(docs, filters, min(SAMPLE, -(-total // per_range)), block)
    rows = stored(united(shards(docs, filters, cuts, block, held), cuts, least), "phrases")
    text = F.col("phrase").cast("string")
    phrases = rows.where("kind = 'phrase'").select("lang", text.alias("phrase"), "a", F.split(text, " ").alias("words"))
    join = lambda ws: F.array_join(ws, " ")
    size = F.size("words")
    parts = part_counts(rows).select("lang", text.alias("part"), "f")
    cuts = phrases.select("*", F.explode(F.sequence(F.lit(1), size - 1)).alias("k"))
    cuts = cuts.withColumns({"first": join(F.slice("words", F.lit(1), F.col("k"))), "rest": join(F.slice("words", F.col("k") + 1, size - F.col("k")))})
    for column, name in (("first", "l"), ("rest", "r")):
        cuts = cuts.join(parts.select("lang", F.col("part").alias(column), F.col("f").alias(name)), ["lang", column])
    totals = counts.where("lang IS NOT NULL").groupBy("lang").agg(F.sum("c").alias("n"))
    exact = lambda c: F.col(c).cast("decimal(19,0)")
    # the quotient is at most 1000 * n / a, so it fits 64 bits; products of three counts fit 38 digits
    score = F.call_function("div", (exact("a") * exact("n")).cast("decimal(35,0)") * F.lit(1000).cast("decimal(4,0)"), exact("l") * exact("r"))
    scored = cuts.join(totals, "lang").withColumn("score", score)
    best = scored.groupBy("lang", "phrase").agg(F.first("a").alias("a"), F.first("n").alias("n"), F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    # a longer candidate that holds a phrase and is frequent enough goes through one that is longer by one word
    shorter = F.array(F.slice("words", F.lit(1), size - 1), F.slice("words", F.lit(2), size - 1))
    longer = phrases.where(size > 2).select("lang", F.explode(F.transform(shorter, join)).alias("phrase"), "a").groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    left = best.join(longer, ["lang", "phrase"], "left").where(F.col("longer").isNull() | (100 * F.col("longer") < inside * F.col("a")))
    order = [F.desc("cut.score"), F.desc("a"), F.asc("phrase")]
    left = left.withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(SALTS)))
    for by in (("lang", "salt"), ("lang",)):  # a language's first are among the first of its parts
        left = left.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("rank") <= most)
    return left.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", F.col("cut.l").alias("l"), F.col("cut.r").alias("r"), "n", F.col("cut.score").alias("score"))


ORACLE = """
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) AS piece
  FROM documents WHERE text IS NOT NULL),
worded AS (SELECT lang, list_filter(string_split_regex(piece, '[\\x20\\x09]+'), lambda w: w <> '') AS ws FROM pieces),
totals AS (SELECT lang, sum(len(ws)) AS n FROM worded GROUP BY lang),
numbered AS (SELECT lang, ws, row_number() OVER () AS piece FROM worded),
flat AS (SELECT lang, piece, unnest(ws) AS w, unnest(range(1, len(ws) + 1)) AS i FROM numbered),
led AS (
  SELECT lang, w AS a, w || ' ' || lead(w, 1) OVER p AS b, w || ' ' || lead(w, 1) OVER p || ' ' || lead(w, 2) OVER p AS c,
         w || ' ' || lead(w, 1) OVER p || ' ' || lead(w, 2) OVER p || ' ' || lead(w, 3) OVER p AS d,
         w || ' ' || lead(w, 1) OVER p || ' ' || lead(w, 2) OVER p || ' ' || lead(w, 3) OVER p || ' ' || lead(w, 4) OVER p AS e
  FROM flat WINDOW p AS (PARTITION BY piece ORDER BY i)),
spelled AS (SELECT lang, a AS s FROM led UNION ALL SELECT lang, b FROM led UNION ALL SELECT lang, c FROM led UNION ALL SELECT lang, d FROM led UNION ALL SELECT lang, e FROM led),
counts AS (SELECT lang, string_split(s, ' ') AS g, count(*) AS f FROM spelled WHERE s IS NOT NULL GROUP BY lang, s HAVING count(*) >= 100),
cuts AS (
  SELECT c.lang, c.g, c.f AS a, l.f AS l, r.f AS r, t.n, k,
         (CAST(1000 AS HUGEINT) * c.f * t.n) // (CAST(l.f AS HUGEINT) * r.f) AS score
  FROM counts c, (SELECT unnest([1, 2, 3, 4]) AS k), counts l, counts r, totals t
  WHERE k < len(c.g) AND l.lang = c.lang AND l.g = c.g[1 : k] AND r.lang = c.lang AND r.g = c.g[k + 1 : len(c.g)] AND t.lang = c.lang),
best AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, g ORDER BY score, k) = 1),
inner_ AS (
  SELECT lang, g[i : i + m - 1] AS g, max(f) AS longer FROM counts, (SELECT unnest([2, 3, 4]) AS m), (SELECT unnest([1, 2, 3, 4]) AS i)
  WHERE m < len(g) AND i + m - 1 <= len(g) GROUP BY ALL),
kept AS (SELECT b.* FROM best b LEFT JOIN inner_ i ON b.lang = i.lang AND b.g = i.g WHERE i.longer IS NULL OR 100 * i.longer < 100 * b.a),
ranked AS (
  SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, array_to_string(g, ' ')) AS rank, array_to_string(g, ' ') AS phrase,
         a, l, r, CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score FROM kept)
SELECT * FROM ranked WHERE rank <= 2000
"""
