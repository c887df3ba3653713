"""LM scoring: a unigram base and online logistic mixing of hashed-context bit predictors.

Bits: a byte (or the end of the text) is spelt by the Huffman code of the training bytes that follow the same byte, so
common bytes take few binary decisions. A decision is predicted from the contexts of the last ``ORDERS`` bytes: each context, hashed
together with the place in the code tree, has counts of zeros and ones from all training documents. The counts are
summed by Spark in blocks of slots; their size is fixed by ``BITS``, so the finished tables can be broadcast.
Mixing: the predictors' logits are weighted by one of ``GATES`` weight sets, chosen by the depth in the code tree, and
the weights learn online, after each ``STRIDE`` bytes of the document, from the prediction errors. Refinement: an
adaptive map from the mixed probability to what has happened at that probability in this document so far is averaged
in. Documents are independent of each other: all weights start anew with each. numpy runs the same stride of many
documents at once. score is log10 of the product of all decisions' probabilities; bits_per_byte is the same per byte.

Base: the c of each token over all training documents. The ``FREQUENT`` commonest tokens are looked up in a broadcast
table (bounded), all others in a shuffled join, so every token meets its exact count.

Cases: a null text counts as empty: one token (the end); null and repeated doc_ids are separate rows (a null id has
crc32 of the empty text, so it trains); equal texts get equal scores; without training documents N = V = 0 and c = 0
throughout, the predictors then start at even odds; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import heapq
from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc_mod, stored

ORDERS, BITS, GATES, STRIDE, RATE, BINS, FREQUENT, SLOTS = (2, 3, 4), 18, 8, 8, 0.004, 24, 1 << 17, 4096
END, BATCH, MIX_BATCH, PRIOR = 256, 1 << 18, 1 << 24, 24.0
WINDOW = 1 << 20
WORDS_AT_ONCE = 200_000


def tokens(text: bytes) -> list[bytes]:
    """bytes.lower and bytes.split know ASCII only: A-Z, and the six white characters of the contract."""
    return text.lower().split()


def encoded(text) -> bytes:
    return text.encode("utf-8", "surrogatepass") if text else b""


class Code:
    """A Huffman code over 257 symbols for each preceding byte: the hashed nodes that a symbol passes and its bits there."""

    def __init__(self, counts: np.ndarray):
        nodes, bits, size = [], [], []
        for before, row in enumerate(counts):
            heap = [(int(c) + 1, i) for i, c in enumerate(row)]
            heapq.heapify(heap)
            parent, fresh = {}, len(row)
            while len(heap) > 1:
                a, b = heapq.heappop(heap), heapq.heappop(heap)
                parent[a[1]], parent[b[1]] = (fresh, 0), (fresh, 1)
                heapq.heappush(heap, (a[0] + b[0], fresh))
                fresh += 1
            paths = {fresh - 1: ((), ())}
            for at in range(fresh - 2, -1, -1):
                up, bit = parent[at]
                paths[at] = (*paths[up][0], before * 512 + up), (*paths[up][1], bit)
            for s in range(len(row)):
                size.append(len(paths[s][0]))
                nodes += paths[s][0]
                bits += paths[s][1]
        self.size = np.array(size, np.int64)
        self.start = np.cumsum(self.size) - self.size
        self.node, self.bit = np.array(nodes, np.uint32) * np.uint32(0x85EBCA6B), np.array(bits, np.uint8)

    def spell(self, symbols: np.ndarray, before: np.ndarray):
        """(decisions of each symbol, depth, hashed node and bit of each decision)."""
        word = before.astype(np.int64) * 257 + symbols
        n = self.size.take(word)
        begin = np.cumsum(n) - n
        count = np.arange(int(n.sum()))
        at = np.repeat(self.start.take(word) - begin, n)
        at += count
        count -= np.repeat(begin, n)
        return n, count, self.node.take(at, mode="clip"), self.bit.take(at, mode="clip")


def stream(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """All symbols, each document after ``max(ORDERS)`` zeros and closed by END, and where its symbols start."""
    pad = max(ORDERS)
    size = np.array([len(t) + 1 + pad for t in texts])
    out = np.frombuffer((bytes(pad) + (b"\0" + bytes(pad)).join(texts) + b"\0"), np.uint8).astype(np.uint16)
    ends = np.cumsum(size)
    out[ends - 1] = END
    return out, ends - size + pad


def packed(symbols: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The symbol at each place and the ``max(ORDERS)`` bytes before it (6 at most) in one number, the farthest byte lowest."""
    pad = max(ORDERS)
    low = np.zeros(len(symbols) + 8, np.uint8)
    low[: len(symbols)] = symbols  # END ends a document, so no place has it before it
    eight = np.ndarray(len(symbols), "<u8", low, strides=(1,))  # the eight bytes from each place on
    out = eight[at - pad]
    out &= np.uint64((1 << 8 * pad) - 1)
    out |= symbols.take(at).astype(np.uint64) << np.uint64(8 * pad)
    return out


def unpacked(keys: np.ndarray, back: int) -> np.ndarray:
    """The symbol ``back`` places before; 0 is the symbol itself."""
    out = keys >> np.uint64(8 * (max(ORDERS) - back))
    return (out & np.uint64(255) if back else out).astype(np.uint32)


def hashes(keys: np.ndarray) -> list[np.ndarray]:
    """For each order a 32-bit hash of the preceding symbols."""
    out, h, done = [], np.zeros(len(keys), np.uint32), 0
    for order in ORDERS:
        for back in range(done + 1, order + 1):
            h += unpacked(keys, back)
            h += np.uint32(1)
            h *= np.uint32(0x2C1B3C6D)
            h ^= h >> np.uint32(15)
        done = order
        out.append(h * np.uint32(0x9E3779B1))
    return out


def contexts(symbols: np.ndarray) -> list[np.ndarray]:
    """``hashes`` at all places (of no meaning at the zeros between documents)."""
    return hashes(packed(symbols, np.arange(len(symbols))))


def spelt(keys: np.ndarray, code: Code):
    """(decisions of each key, their depths, their bits, their slots for each order) of ``BATCH`` keys at a time."""
    for i in range(0, len(keys), BATCH):
        part = keys[i: i + BATCH]
        n, depth, node, bit = code.spell(unpacked(part, 0), unpacked(part, 1))
        yield n, depth, bit, [slot(np.repeat(h, n), node) for h in hashes(part)]


def slot(context: np.ndarray, node: np.ndarray, bits: int = BITS) -> np.ndarray:
    h = context ^ node
    h *= np.uint32(0xC2B2AE35)
    h >>= np.uint32(32 - bits)
    return h.astype(np.int64)


def grouped_by_bytes(texts: list[bytes], limit: int = BATCH):
    held, size = [], 0
    for i, t in enumerate(texts):
        held.append(i)
        size += len(t)
        if size >= limit:
            yield held
            held, size = [], 0
    if held:
        yield held


def count_contexts(texts: list[bytes], code: Code, counts: np.ndarray) -> None:
    """Adds to ``counts`` (order, slot * 2 + bit). A symbol after the same bytes is spelt once for all its places in ``WINDOW`` bytes."""
    for ids in grouped_by_bytes(texts, WINDOW):
        symbols, starts = stream([texts[i] for i in ids])
        real = np.ones(len(symbols), bool)
        for back in range(1, max(ORDERS) + 1):
            real[starts - back] = False
        keys = np.sort(packed(symbols, np.flatnonzero(real)))
        new = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
        keys, times = keys[new], np.diff(np.r_[new, len(keys)])
        done = 0
        for n, _, bit, slots in spelt(keys, code):
            each = np.repeat(times[done: done + len(n)], n).astype(float)  # whole numbers far below 2**53
            done += len(n)
            for k, place in enumerate(slots):
                place += place
                place += bit
                counts[k] += np.bincount(place, each, counts.shape[1]).astype(np.int64)


def logits(counts: np.ndarray) -> np.ndarray:
    """(order, slot) logits of a one."""
    zero, one = counts[:, 0::2] + 0.4, counts[:, 1::2] + 0.4
    return np.log(one / zero).astype(np.float32)


def mix_scores(texts: list[bytes], code: Code, table: np.ndarray) -> np.ndarray:
    """log10 probability of each text."""
    out = np.zeros(len(texts))
    # the longest first: a step works on the documents that still go on, and those of like length share their steps
    order = np.argsort([-len(t) for t in texts], kind="stable")
    texts = [texts[i] for i in order]
    for ids in grouped_by_bytes(texts, MIX_BATCH):
        out[order[ids]] = _mix([texts[i] for i in ids], code, table)
    return out


def numbered(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(number of each key, the key of each number). Equal keys share a number, but for a few whose hash another key took."""
    slots = ((keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(44)).astype(np.int64)
    places = np.arange(len(keys))
    last = np.zeros(1 << 20, np.int64)
    last[slots] = places
    like = last.take(slots, mode="clip")
    other = np.flatnonzero(keys.take(like, mode="clip") != keys)
    like[other] = other
    own = np.flatnonzero(like == places)
    places[own] = np.arange(len(own))
    return places.take(like, mode="clip"), keys[own]


def prepared(keys: np.ndarray, code: Code, table: np.ndarray):
    """(decisions of each key, its first row less the decisions before it, rows of decisions: logits, then gate * 2 + bit)."""
    number, keys = numbered(keys)
    each, rows = [], []
    for n, depth, bit, slots in spelt(keys, code):
        each.append(n)
        row = np.empty((len(depth), len(ORDERS) + 1), np.float32)
        for j, s in enumerate(slots):
            row[:, j] = table[j].take(s, mode="clip")
        row[:, -1] = np.minimum(depth, GATES - 1) * 2 + bit
        rows.append(row)
    each = np.concatenate(each)
    start = (np.cumsum(each) - each).take(number, mode="clip")
    each = each.take(number, mode="clip")
    start -= np.cumsum(each)
    start += each
    return each, start, np.concatenate(rows)


def steps(starts: np.ndarray, size: np.ndarray):
    """For each stride (documents that still go on, where the symbols of each start, places of the symbols); sizes fall."""
    falling = -size
    for begin in range(0, int(size.max()), STRIDE):
        m = int(np.searchsorted(falling, -begin, "left"))
        length = np.minimum(size[:m] - begin, STRIDE)
        first = np.cumsum(length) - length
        at = np.repeat(starts[:m] + begin - first, length)
        at += np.arange(len(at))
        yield m, first, at


def _mix(texts: list[bytes], code: Code, table: np.ndarray) -> np.ndarray:
    """The same for texts of falling length.

    What does not depend on the weights is worked out ``WINDOW`` symbols ahead, once for each different symbol and context.
    """
    symbols, starts = stream(texts)
    k, n = len(ORDERS), len(texts)
    all_weights = np.zeros((n * GATES, k + 1), np.float32)  # as wide as a row, whose last column weighs nothing
    all_weights[:, :k] = 1.25 / k
    bins = np.linspace(-8, 8, BINS)
    all_seen = np.stack([np.tile(PRIOR / (1 + np.exp(x)), n) for x in (bins, -bins)])
    total = np.zeros(n)

    def learn_from(held):
        each_all, start_all, rows = prepared(packed(symbols, np.concatenate([at for _, _, at in held])), code, table)
        done, decided = 0, 0
        for m, first, at in held:
            each, start = each_all[done: done + len(at)], start_all[done: done + len(at)]
            done += len(at)
            per_doc = np.add.reduceat(each, first)
            docs = np.arange(m)
            at = np.repeat(start, each)
            at += np.arange(decided, decided + len(at))
            decided += len(at)
            inputs = rows.take(at, axis=0, mode="clip")
            seen = all_seen[:, : m * BINS]
            gate = inputs[:, k].astype(np.int64)
            bit = gate & 1
            gate >>= 1
            gate += np.repeat(docs * GATES, per_doc)
            parts = all_weights.take(gate, axis=0, mode="clip")
            parts *= inputs
            mixed = parts[:, 0] + parts[:, 1]
            for j in range(2, k):
                mixed += parts[:, j]
            np.clip(mixed, -8, 8, out=mixed)
            p = np.exp(-mixed)
            p += 1
            np.reciprocal(p, out=p)
            mixed += 8
            mixed *= (BINS - 1) / 16
            mixed += 0.5
            place = mixed.astype(np.int64)
            place += np.repeat(docs * BINS, per_doc)
            refined = (seen[1] / (seen[0] + seen[1])).astype(np.float32).take(place, mode="clip")
            one = bit.astype(np.float32)
            # the chance of what came: final where it is a one, else 1 - final
            refined *= 0.25
            refined += 0.75 * p
            chance = refined * (2 * one - 1)
            chance += 1 - one
            total[:m] += np.add.reduceat(np.log(chance), np.cumsum(per_doc) - per_doc, dtype=np.float64)
            one -= p
            one *= RATE
            gate *= k + 1
            for j in range(k):
                np.add.at(all_weights.reshape(-1), gate, one * inputs[:, j])
                gate += 1
            bit *= n * BINS
            place += bit
            np.add.at(all_seen.reshape(-1), place, 1.0)

    held, ahead = [], 0
    for step in steps(starts, np.array([len(t) + 1 for t in texts])):
        held.append(step)
        ahead += len(step[2])
        if ahead >= WINDOW:
            learn_from(held)
            held, ahead = [], 0
    if held:
        learn_from(held)
    return total / np.log(10)


def learn(rows: DataFrame):
    """(code, table, token counts, N, V) from the training rows (text)."""

    def count(batches):
        held, histogram = Counter(), np.zeros(256 * 257, np.int64)

        def flush():
            yield pd.DataFrame({"kind": 0, "token": list(held), "n": list(held.values())})

        for pdf in batches:
            after: list[bytes] = []
            for text in map(encoded, pdf["text"]):
                held.update(tokens(text))
                after.append(text)
                if len(held) > WORDS_AT_ONCE:
                    yield from flush()
                    held = Counter()
            for ids in grouped_by_bytes(after):
                symbols, starts = stream([after[i] for i in ids])
                real = np.ones(len(symbols), bool)
                for back in range(1, max(ORDERS) + 1):
                    real[starts - back] = False
                at = np.flatnonzero(real)
                histogram += np.bincount(symbols[at - 1].astype(np.int64) * 257 + symbols[at], minlength=len(histogram))
        if held:
            yield from flush()
        seen = np.flatnonzero(histogram)
        yield pd.DataFrame({"kind": 1, "token": [str(i).encode() for i in seen], "n": histogram[seen]})

    counted = rows.mapInPandas(count, "kind int, token binary, n long").groupBy("kind", "token").agg(F.sum("n").alias("n"))
    counted = stored(counted, "lm-tokens")
    histogram = np.zeros(256 * 257, np.int64)
    for r in counted.where("kind = 1").collect():  # at most 256 * 257 rows
        histogram[int(bytes(r["token"]))] = r["n"]
    words = counted.where("kind = 0").select("token", "n")
    sums = words.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    histogram = histogram.reshape(256, 257)
    ends = int(histogram[:, END].sum())
    code = Code(histogram)

    def observe(batches):
        counts = np.zeros((len(ORDERS), 2 << BITS), np.int64)
        for pdf in batches:
            count_contexts([encoded(t) for t in pdf["text"]], code, counts)
        blocks = counts.astype(np.uint32).reshape(len(ORDERS) * (1 << BITS) // SLOTS, -1)
        yield pd.DataFrame({"block": np.arange(len(blocks)), "counts": [b.tobytes() for b in blocks]})

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        whole = np.sum([np.frombuffer(b, np.uint32) for b in pdf["counts"]], axis=0, dtype=np.uint64)
        both = whole.astype(float).reshape(1, -1)
        return pd.DataFrame({"block": pdf["block"].iloc[:1], "logits": [logits(both).tobytes()]})

    blocks = rows.mapInPandas(observe, "block int, counts binary").groupBy("block").applyInPandas(add, "block int, logits binary")
    table = np.zeros((len(ORDERS) * (1 << BITS) // SLOTS, SLOTS), np.float32)
    for r in blocks.collect():  # len(ORDERS) * 2**BITS numbers, whatever the corpus
        table[r["block"]] = np.frombuffer(r["logits"], np.float32)
    return code, table.reshape(len(ORDERS), -1), words, sums["n"] + ends, sums["v"] + (ends > 0), ends


def score(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, n_bytes, bits_per_byte for each row."""
    spark = documents.sparkSession
    docs = documents.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    docs = docs.withColumn("held_out", crc_mod("doc_id", 7) == 2)
    code, table, words, n_all, n_distinct, ends = learn(docs.where(~F.col("held_out")).select("text"))
    whole = n_all + n_distinct + 1
    # the least count that at most FREQUENT tokens reach, so that what is collected is bounded
    shares = words.groupBy("n").agg(F.count("*").alias("k"))
    upto, least = 0, 1
    for r in shares.orderBy(F.col("n").desc()).limit(FREQUENT).toLocalIterator():
        upto += r["k"]
        if upto > FREQUENT:
            least = r["n"] + 1
            break
    frequent = words.where(F.col("n") >= least).toPandas()
    model = spark.sparkContext.broadcast((code, table, [bytes(t) for t in frequent["token"]], frequent["n"].to_numpy(np.int64)))

    def run(batches):
        code, table, frequent, n_frequent = model.value
        value = np.log10((n_frequent + 1) / whole)
        end_value = np.log10((ends + 1) / whole)
        known_tokens = pa.array(frequent, pa.binary())
        held, size = [], 0

        def mixed():
            """The held batches with their scores: long documents of many batches go on together."""
            scores = mix_scores([t for texts, _, _ in held for t in texts], code, table)
            for texts, arrays, names in held:
                part, scores = scores[: len(texts)], scores[len(texts):]
                yield pa.RecordBatch.from_arrays([*arrays, pa.array(part)], names=[*names, "score"])

        for batch in batches:
            texts = [encoded(t) for t in batch.column("text").to_pylist()]
            words = pc.ascii_split_whitespace(pc.ascii_lower(pa.array(texts, pa.binary()).cast(pa.large_string(), safe=False)))
            owner = pc.list_parent_indices(words).to_numpy()
            flat = pc.list_flatten(words).cast(pa.large_binary())
            filled = pc.greater(pc.binary_length(flat), 0)
            flat, owner = flat.filter(filled), owner[filled.to_numpy(zero_copy_only=False)]
            at = pc.index_in(flat, value_set=known_tokens.cast(pa.large_binary()))
            rare = at.is_null().to_numpy(zero_copy_only=False)
            n = len(texts)
            ids = at.filter(at.is_valid()).to_numpy()
            base = np.bincount(owner[~rare], value[ids], n) + end_value
            many, other = np.bincount(owner[~rare], minlength=n), np.bincount(owner[rare], minlength=n)
            lists = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(other)], pa.int32()), flat.filter(at.is_null()).cast(pa.binary()))
            columns = {"n_tokens": many + other + 1, "known": many + (ends > 0), "base": base,
                       "n_bytes": np.array([len(t) for t in texts])}
            held.append((texts, [batch.column("row"), batch.column("doc_id"), batch.column("held_out"), *map(pa.array, columns.values()), lists],
                         ["row", "doc_id", "held_out", *columns, "rare"]))
            size += sum(map(len, texts))
            if size >= MIX_BATCH:
                yield from mixed()
                held, size = [], 0
        if held:
            yield from mixed()

    scored = stored(docs.withColumn("row", F.monotonically_increasing_id()).select("row", "doc_id", "held_out", "text").mapInArrow(
        run, "row long, doc_id long, held_out boolean, n_tokens long, known long, base double, n_bytes long, rare array<binary>, score double"), "lm-scored")
    pairs = scored.select("row", F.explode("rare").alias("token"))
    met = pairs.join(words, "token", "left")
    rest = met.groupBy("row").agg(F.count("n").alias("more_known"),
                                  F.sum(F.log10((F.coalesce("n", F.lit(0)) + 1) / F.lit(float(whole)))).alias("more_base"))
    return scored.drop("rare").join(rest, "row", "left").select(
        "doc_id", "held_out", "n_tokens", (F.col("known") + F.coalesce("more_known", F.lit(0))).alias("n_known"),
        F.lit(n_all).cast("long").alias("train_tokens"), (F.col("base") + F.coalesce("more_base", F.lit(0.0))).alias("base_score"),
        "score", "n_bytes", (-F.col("score") * F.lit(float(np.log2(10))) / F.greatest("n_bytes", F.lit(1))).alias("bits_per_byte"))
