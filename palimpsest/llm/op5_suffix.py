"""Suffix dedup with a run-length index: remove bytes of 50-byte strings that also start in a smaller document.

1. Anchors. Of the ``SPAN - GRAM + 1`` GRAM-byte strings in a SPAN-byte string the one with the least hash is its
   anchor, so equal strings have equal anchors and a long common passage has one every few bytes. Hashes of anchors
   meet in buckets (once for each task, so a passage of a third of all documents costs a bucket one entry a task);
   those of two documents set a bit in a filter of fixed size. A full filter lets more pass, it never drops a match.
2. Windows. Around each anchor that passes, all bytes of the strings that may have it as their anchor go to its bucket.
   Within a task equal windows are one; of their documents the larger ones are settled at once, the smallest goes on. An
   anchor that occurs in ``HOT`` groups of documents or more is split: its strings fall into classes by how far their anchor is from
   their start, and the bytes on both sides that all strings of a class hold are part of the bucket's key, so equal strings still meet.
3. Index. The distinct windows of an anchor are ranked by document. For each bit of the rank the windows without it are indexed
   and those with it, which belong to larger documents, stream through the index of the windows whose ranks agree above that bit.
   The index is a Burrows-Wheeler transform kept as runs, with the LF value of each run's head and text places sampled at both
   ends of each run. A stream goes from a window's last byte to its first: where the row's run holds the byte it takes the LF step,
   else it goes on from the end of the nearest run of that byte above or below, whichever sampled place has the longer match.
   The lengths are the matching statistics; a start with ``SPAN`` or more bytes is marked.
4. Spans are joined back to the documents by a key of id and text, merged and cut out.

Cases: a null text counts as empty; texts under SPAN bytes are untouched; null doc_ids neither lose bytes nor cause it;
rows that repeat a doc_id do not remove from each other; equal rows give equal results; strings are judged on the
input; any bytes may occur; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import grouped, slim

SPAN, GRAM = 50, 24
LEFT = SPAN - GRAM
WIDE = LEFT + SPAN
BUCKETS, ROWS_PER_BUCKET, FILTER_BITS, FLUSH, PIECE = 64, 4000, 27, 4 << 20, 1 << 19
BLOCK = 12
STEPS = np.arange(BLOCK)
HOT, HOT_BITS, CLASSES, INDEXED, RUNS = 1024, 23, 9, 8_000, 1 << 16
POSITION, MASK = np.uint64(30), np.uint64((1 << 30) - 1)
_rng = np.random.default_rng(50)
BYTE = _rng.integers(0, 2**64, 256, dtype=np.uint64)
ODD = _rng.integers(0, 2**64, 8, dtype=np.uint64) | np.uint64(1)
PRINT = _rng.integers(0, 2**64, WIDE - GRAM, dtype=np.uint64)


def mixed(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(32))
    x *= ODD[6]
    x ^= x >> np.uint64(29)
    return x


class Batch:
    """The bytes of some documents, one after the other, with hashes of all strings of 16 bytes and all anchors."""

    def __init__(self, texts: list[bytes]):
        self.bytes = np.frombuffer(b"".join(texts), np.uint8)
        self.size = np.array([len(t) for t in texts], np.int64)
        self.end = np.cumsum(self.size)
        self.begin = self.end - self.size
        n = len(self.bytes)
        self.at, self.hash = np.empty(0, np.int64), np.empty(0, np.uint64)
        if n < SPAN:
            return
        # only strings within one document
        inside = np.ones(n + 1, np.int8)
        for back in range(1, SPAN):
            cut = self.end - back
            inside[cut[(cut >= 0) & (back <= self.size)]] = 0
        self.h16 = np.empty(n - 15, np.uint64)
        found = []
        for a in range(0, n - SPAN + 1, PIECE):  # some starts at a time: what is worked out for each byte stays small
            h = BYTE[self.bytes[a: a + PIECE + SPAN - 1]]
            step = 1
            for k in range(3):  # 2, 4, 8
                h = h[:-step] * ODD[k] + h[step:]
                step *= 2
            h16 = h[:-8] * ODD[3] + h[8:]
            self.h16[a: a + len(h16)] = h16
            g = mixed(h16[:-8] * ODD[4] + h[16:])
            least = (g & ~MASK) | np.arange(len(g), dtype=np.uint64)
            reach = 1
            while reach * 2 <= LEFT + 1:
                least = np.minimum(least[:-reach], least[reach:])
                reach *= 2
            rest = LEFT + 1 - reach
            if rest:
                least = np.minimum(least[:-rest], least[rest:])
            chosen = (least[np.flatnonzero(inside[a: a + len(least)])] & MASK).astype(np.int64)
            if len(chosen):
                chosen = chosen[np.r_[True, chosen[1:] != chosen[:-1]]]
                found.append((chosen + a, g[chosen]))
        if found:
            at, hashes = (np.concatenate(x) for x in zip(*found))
            fresh = np.r_[True, at[1:] != at[:-1]]  # the first anchor of a piece may be the last of the one before
            self.at, self.hash = at[fresh], hashes[fresh]

    def owner(self, at: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.end, at, "right")


def batches_of(pdfs, columns: tuple[str, ...]):
    """Lists of the columns for groups of documents of about FLUSH bytes; texts become bytes, null ids are left out."""
    held: list[list] = [[] for _ in columns]
    size = 0
    for pdf in pdfs:
        for values in zip(*(pdf[c] for c in columns)):
            text = values[0].encode("utf-8", "surrogatepass") if values[0] else b""
            if len(text) < SPAN:
                continue
            held[0].append(text)
            for h, v in zip(held[1:], values[1:]):
                h.append(v)
            size += len(text)
            if size >= FLUSH:
                yield held
                held, size = [[] for _ in columns], 0
    if held[0]:
        yield held


def bucket_of(h: np.ndarray, buckets: int) -> np.ndarray:
    return ((h >> np.uint64(40)) % np.uint64(buckets)).astype(np.int64)


def by_bucket(buckets: np.ndarray):
    """(bucket, positions) for each bucket that occurs."""
    order = np.argsort(buckets, kind="stable")
    sorted_ = buckets[order]
    cuts = np.flatnonzero(np.r_[True, sorted_[1:] != sorted_[:-1]]) if len(order) else []
    for a, b in zip(cuts, [*cuts[1:], len(order)]):
        yield int(sorted_[a]), order[a:b]


def filter_place(h: np.ndarray, slice_bits: int) -> np.ndarray:
    """A bit within the bucket's slice of the filter, from the 40 low bits of the hash."""
    low = h & np.uint64((1 << 40) - 1)
    return ((low * ODD[5]) >> np.uint64(20)).astype(np.int64) % slice_bits


class Bits:
    """A bit set of fixed size over anchor hashes, in slices by bucket."""

    def __init__(self, buckets: int, bits: int):
        self.buckets, self.size = buckets, max(8, (1 << bits) // buckets // 8 * 8)
        self.packed = np.zeros((buckets, self.size // 8), np.uint8)

    def slice_of(self, h: np.ndarray) -> bytes:
        flags = np.zeros(self.size, np.uint8)
        flags[filter_place(h, self.size)] = 1
        return np.packbits(flags).tobytes()

    def holds(self, h: np.ndarray) -> np.ndarray:
        place = filter_place(h, self.size)
        return (self.packed[bucket_of(h, self.buckets), place >> 3] >> (7 - (place & 7)).astype(np.uint8) & 1).astype(bool)


def shared_filter(docs: DataFrame, buckets: int, bits: int = FILTER_BITS, hot: int = HOT) -> tuple[Bits, Bits]:
    """Bits for the anchor hashes of two or more documents, and for those in ``hot`` or more groups of documents."""
    common, frequent = Bits(buckets, bits), Bits(buckets, min(bits, HOT_BITS))

    def hashes(pdfs):
        for texts, ids in batches_of(pdfs, ("text", "doc_id")):
            b = Batch(texts)
            # distinct within each document id, then which hashes this group holds in two of them
            _, doc = np.unique(np.array(ids, object).astype(str), return_inverse=True)
            doc = doc[b.owner(b.at)]
            order = np.lexsort((doc, b.hash))
            h, d = b.hash[order], doc[order]
            new = np.r_[True, h[1:] != h[:-1]] if len(h) else np.empty(0, bool)
            many = np.zeros(len(h), bool)
            if len(h):
                group = np.cumsum(new) - 1
                differs = np.r_[False, ~new[1:] & (d[1:] != d[:-1])]
                many = np.bincount(group, differs)[group] > 0
            h, many = h[new], many[new]
            out = []
            for k, at in by_bucket(bucket_of(h, buckets)):
                low = h[at].view(np.uint8).reshape(-1, 8)[:, :5]
                out.append((k, low[~many[at]].tobytes(), low[many[at]].tobytes()))
            yield pd.DataFrame(out, columns=["bucket", "once", "more"])

    def meet(pdfs):
        for group in grouped(pdfs, ["bucket"]):
            def read(column):
                low = np.frombuffer(b"".join(group[column]), np.uint8).reshape(-1, 5)
                out = np.zeros((len(low), 8), np.uint8)
                out[:, :5] = low
                return out.view(np.uint64).ravel()

            values, times = np.unique(read("once"), return_counts=True)
            more, again = np.unique(read("more"), return_counts=True)
            shared = np.concatenate([values[times > 1], more, np.intersect1d(values, more)])
            both, at = np.unique(np.concatenate([values, more]), return_inverse=True)
            often = both[np.bincount(at, np.concatenate([times, again])) >= hot] if len(both) else both
            yield pd.DataFrame({"bucket": group["bucket"].iloc[:1], "bits": [common.slice_of(shared)], "often": [frequent.slice_of(often)]})

    found = docs.mapInPandas(slim(hashes), "bucket int, once binary, more binary").repartition("bucket").sortWithinPartitions("bucket")
    for r in found.mapInPandas(slim(meet), "bucket int, bits binary, often binary").toLocalIterator():  # 2**bits bits, whatever the corpus
        common.packed[r["bucket"]] = np.frombuffer(r["bits"], np.uint8)
        frequent.packed[r["bucket"]] = np.frombuffer(r["often"], np.uint8)
    return common, frequent


class RunIndex:
    """A run-compressed Burrows-Wheeler transform of texts, each closed by a separator, with text places sampled at run ends."""

    def __init__(self, symbols: np.ndarray, size: np.ndarray):
        """``symbols`` (above 0) are the texts one after the other, ``size`` their lengths. Separators (0) differ by their place."""
        ends = np.cumsum(size + 1) - 1
        text = np.zeros(int(size.sum()) + len(size), np.int64)
        inside = np.ones(len(text), bool)
        inside[ends] = False
        text[inside] = symbols
        self.text, self.closed = text.astype(np.int32), np.repeat(ends, size + 1)
        n, longest = len(text), int(size.max()) + 1
        # the first sort takes as many symbols as fit in a word, each further one doubles the length
        names = np.cumsum(np.bincount(text) > 0)
        bits = int(names[-1]).bit_length()
        length = max(1, 62 // bits)
        both, here, left = np.zeros(n, np.int64), names[text], self.closed - np.arange(n) + 1
        for k in range(length):
            both <<= bits
            both[: n - k] |= np.where(left[: n - k] > k, here[k:], 0)
        while True:
            order = np.argsort(both, kind="stable" if length >= longest else None)
            ordered = both[order]
            fresh = np.cumsum(np.r_[False, ordered[1:] != ordered[:-1]])
            rank = np.empty(n, np.int64)
            rank[order] = fresh
            if fresh[-1] == n - 1 or length >= longest:
                break  # what is equal up to its separator stands by place
            far = np.zeros(n, np.int64)
            far[: n - length] = np.where(left[: n - length] > length, rank[length:] + 1, 0)
            both = rank * (n + 2) + far
            length *= 2
        last = text[order - 1]  # the symbol before each suffix; the text is a circle
        self.start = np.flatnonzero(np.r_[True, last[1:] != last[:-1]])
        self.char = last[self.start]
        size_ = np.diff(np.r_[self.start, n])
        # LF of a run's first row: rows of smaller symbols, then earlier rows of this one
        self.by_char = np.argsort(self.char, kind="stable")
        self.step = np.empty(len(size_), np.int64)
        self.step[self.by_char] = np.cumsum(size_[self.by_char]) - size_[self.by_char]
        self.end = self.start + size_ - 1
        self.head, self.tail = order[self.start], order[self.end]  # sampled text places
        self.keys = self.char[self.by_char] * (len(size_) + 1) + self.by_char  # ascending: runs of each symbol in order

    def lf(self, row: np.ndarray, run: np.ndarray) -> np.ndarray:
        """The row of the suffix that is one symbol longer."""
        return self.step[run] + row - self.start[run]

    def common(self, place: np.ndarray, streams: np.ndarray, row: np.ndarray, at: int, length: np.ndarray) -> np.ndarray:
        """How many symbols from ``place`` on equal those of the streams' rows from ``at`` on, ``length`` at most."""
        out = np.zeros(len(place), np.int64)
        going = np.flatnonzero(length > 0)
        for k in range(0, int(length.max()) if len(length) else 0, BLOCK):  # a few symbols at once
            t = self.text.take(place[going][:, None] + (k + STEPS), mode="clip")
            s = streams.take((row[going] * streams.shape[1] + at + k)[:, None] + STEPS, mode="clip")
            differs = t != s
            met = np.where(differs.any(1), differs.argmax(1), BLOCK)
            out[going] += met
            going = going[(met == BLOCK) & (length[going] > k + BLOCK)]
            if not len(going):
                break
        return np.minimum(out, length)

    def statistics(self, streams: np.ndarray, size: np.ndarray) -> np.ndarray:
        """(stream, place) -> the length of the longest match with any text that starts there. ``streams`` are padded rows of symbols."""
        out = np.zeros(streams.shape, np.int64)
        row, place, length = (np.zeros(len(streams), np.int64) for _ in range(3))
        for at in range(streams.shape[1] - 1, -1, -1):
            live = np.flatnonzero(size > at)
            c, r = streams[live, at], row[live]
            run = np.searchsorted(self.start, r, "right") - 1
            same = (self.char[run] == c) & (length[live] > 0)
            new_row, new_place, new_length = self.lf(r, run), place[live] - 1, length[live] + 1
            other = np.flatnonzero(~same)
            if len(other):
                o, oc = live[other], c[other]
                key = oc * (len(self.start) + 1) + run[other]
                after = np.searchsorted(self.keys, key)
                best = np.full(len(other), -1)
                for k, samples, rows in ((after - 1, self.tail, self.end), (after, self.head, self.start)):
                    good = (k >= 0) & (k < len(self.keys))
                    target = self.by_char[np.clip(k, 0, len(self.keys) - 1)]
                    good &= self.char[target] == oc
                    g = np.flatnonzero(good)
                    met = self.common(samples[target[g]], streams, o[g], at + 1, length[o[g]])
                    better = met > best[g]
                    g, met = g[better], met[better]
                    best[g] = met
                    t = target[g]
                    new_row[other[g]] = self.lf(rows[t], t)
                    new_place[other[g]] = samples[t] - 1
                none = best < 0  # the symbol does not occur
                new_row[other[none]] = 0
                new_length[other] = best + 1
            row[live], place[live], length[live] = new_row, new_place, new_length
            out[live, at] = new_length
        return out


def long_matches(padded: np.ndarray, size: np.ndarray, anchor: np.ndarray, mark: np.ndarray, docs: np.ndarray, span: int) -> np.ndarray:
    """(window, start) -> does a window with the same anchor and a smaller document hold the ``span`` symbols that start there?

    ``padded`` are rows of symbols of ``size``, with the anchor itself as the one symbol at ``mark``; ``anchor`` numbers the anchors.
    """
    out = np.zeros((len(size), max(1, int(size.max()) - span + 1)), bool)
    order = np.lexsort((docs, anchor))
    first = np.r_[True, anchor[order][1:] != anchor[order][:-1]]
    fresh = np.r_[True, docs[order][1:] != docs[order][:-1]] | first
    dense = np.cumsum(fresh) - 1
    rank = np.empty(len(size), np.int64)
    rank[order] = dense - np.repeat(dense[first], np.diff(np.r_[np.flatnonzero(first), len(size)]))
    for bit in range(int(rank.max()).bit_length()):
        _, node = np.unique(anchor * (1 << 32) + (rank >> (bit + 1)), return_inverse=True)
        larger = rank >> bit & 1 == 1
        asked = np.flatnonzero(larger & ~all_of(out, size, span))
        held = np.flatnonzero(~larger & np.isin(node, node[asked]))
        held = held[np.argsort(node[held], kind="stable")]
        for a in range(0, len(held), INDEXED):  # a node may reach over several indexes
            part = held[a: a + INDEXED]
            index = RunIndex(*flat(padded, size, mark, node, part))
            lo, hi = node[part[0]], node[part[-1]]
            some = asked[(node[asked] >= lo) & (node[asked] <= hi)]
            for b in range(0, len(some), INDEXED):
                i = some[b: b + INDEXED]
                streams = padded[i].astype(np.int32)
                streams[np.arange(len(i)), mark[i]] = 257 + node[i]
                out[i] |= index.statistics(streams, size[i])[:, : out.shape[1]] >= span
    return out


def all_of(out: np.ndarray, size: np.ndarray, span: int) -> np.ndarray:
    return (out | (np.arange(out.shape[1]) > (size - span)[:, None])).all(1)


def flat(padded: np.ndarray, size: np.ndarray, mark: np.ndarray, node: np.ndarray, part: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    rows = padded[part].astype(np.int64)
    rows[np.arange(len(part)), mark[part]] = 257 + node[part]
    return rows[np.arange(rows.shape[1]) < size[part][:, None]], size[part]


def united(group: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Disjoint (group, start, end) rows that cover the same places of each group, touching ones joined."""
    if not len(start):
        return group, start, end
    wide = int(end.max()) + 2
    start, end = start + group * wide, end + group * wide
    order = np.argsort(start, kind="stable")
    start, reach = start[order], np.maximum.accumulate(end[order])
    first = np.flatnonzero(np.r_[True, start[1:] > reach[:-1]])
    group = start[first] // wide
    return group, start[first] - group * wide, reach[np.r_[first[1:] - 1, len(start) - 1]] - group * wide


def spans_by_key(doc: np.ndarray, key: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[list[int], list[int], list[bytes]]:
    """(doc, key, spans) for each document and key that occur."""
    if not len(doc):
        return [], [], []
    order = np.lexsort((key, doc))
    fresh = np.r_[True, (doc[order][1:] != doc[order][:-1]) | (key[order][1:] != key[order][:-1])]
    head = order[fresh]
    group, start, end = united(np.cumsum(fresh) - 1, start[order].astype(np.int64), end[order].astype(np.int64))
    raw = np.stack([start, end], 1).astype(np.int32).tobytes()
    edges = (np.searchsorted(group, np.arange(len(head) + 1)) * 8).tolist()
    return doc[head].tolist(), key[head].tolist(), [raw[a:b] for a, b in zip(edges, edges[1:])]


FIELDS = (("anchor", np.uint64), ("doc", np.int64), ("key", np.int32), ("at", np.int32), ("left", np.uint8), ("size", np.uint8))
ROUTED = "bucket int, " + ", ".join(f"{n} binary" for n, _ in FIELDS) + ", bytes binary, spans binary"


def beside(b: Batch, at: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Hashes of the ``left`` bytes before and the ``right`` bytes after the anchors at ``at``."""
    out = np.zeros(len(at), np.uint64)
    for k in range(LEFT):
        for there, from_ in ((left > k, at - 1 - k), (right > k, at + GRAM + k)):
            byte = BYTE[b.bytes[np.clip(from_, 0, len(b.bytes) - 1)]]
            out = np.where(there, mixed(out * ODD[k % 5] + byte), out)
    return out


def windows(b: Batch, at: np.ndarray, h: np.ndarray, hot: np.ndarray):
    """(bucket key, place of the anchor, bytes before it, bytes after it) of the windows around anchors."""
    own = b.owner(at)
    before, after = np.minimum(LEFT, at - b.begin[own]), np.minimum(LEFT, b.end[own] - at - GRAM)
    cold = ~hot
    out = [(h[cold], at[cold], before[cold], after[cold])]
    if hot.any():
        h, at, before, after = (x[hot] for x in (h, at, before, after))
        edges = np.linspace(0, LEFT + 1, CLASSES + 1).astype(int)
        for c, (least, most) in enumerate(zip(edges, edges[1:] - 1)):  # strings with ``least`` to ``most`` bytes before the anchor
            can = np.flatnonzero((before >= least) & (after >= LEFT - most))
            full = lambda n: np.full(len(can), n)
            key = mixed(h[can] * ODD[7] + beside(b, at[can], full(least), full(LEFT - most))) + np.uint64(c)
            out.append((key, at[can], np.minimum(before[can], most), np.minimum(after[can], LEFT - least)))
    return [np.concatenate(x) for x in zip(*out)]


def route(docs: DataFrame, filters, buckets: int) -> DataFrame:
    """Rows of windows by bucket; rows with ``spans`` (key in ``key``) are settled already and lie in random buckets."""
    columns = [c.split()[0] for c in ROUTED.split(", ")]

    def run(pdfs):
        (common, frequent), packer = filters.value, zstandard.ZstdCompressor(level=1)
        for texts, ids, keys in batches_of(pdfs, ("text", "doc_id", "key")):
            b = Batch(texts)
            passed = common.holds(b.hash)
            h, at, left, right = windows(b, b.at[passed], b.hash[passed], frequent.holds(b.hash[passed]))
            fits = left + right >= SPAN - GRAM
            h, at, left, right = h[fits], at[fits], left[fits], right[fits]
            own = b.owner(at)
            size = left + GRAM + right
            first, last = at - left, at + GRAM + right - 16
            pieces = [b.h16[np.minimum(first + 16 * j, last)] for j in range(5)]
            window = np.zeros(len(at), np.uint64)
            for j, p in enumerate(pieces):
                window = mixed(window * ODD[j] + p)
            window ^= mixed((left * 256 + size).astype(np.uint64) + h)
            doc, key = np.array(ids, np.int64)[own], np.array(keys, np.int32)[own]
            start = first - b.begin[own]
            order = np.lexsort((doc, window))
            w, d = window[order], doc[order]
            cuts = np.flatnonzero(np.r_[True, w[1:] != w[:-1]]) if len(w) else np.empty(0, int)
            least = np.repeat(d[cuts], np.diff(np.r_[cuts, len(w)]))
            gone = order[d > least]
            on = order[d == least]
            out = [(abs(d + k) % buckets, b"", np.int64(d).tobytes(), np.int32(k).tobytes(), b"", b"", b"", b"", s)
                   for d, k, s in zip(*spans_by_key(doc[gone], key[gone], start[gone], (start + size)[gone]))]
            fields = {"anchor": h, "doc": doc, "key": key, "at": start, "left": left, "size": size}
            for k, i in by_bucket(bucket_of(h[on], buckets)):
                i = on[i]
                # the anchor's own bytes stay behind: its hash stands for them
                n = size[i] - GRAM
                place = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
                taken = np.repeat(first[i], n) + place + GRAM * (place >= np.repeat(left[i], n))
                out.append((k, *(fields[f][i].astype(t).tobytes() for f, t in FIELDS), packer.compress(b.bytes[taken].tobytes()), b""))
            yield pd.DataFrame(out, columns=columns)

    return docs.mapInPandas(slim(run), ROUTED).repartition("bucket").sortWithinPartitions("bucket")


def resolve(group: pd.DataFrame) -> tuple[list[int], list[int], list[bytes]]:
    """(doc_id, key, spans) of one bucket."""
    settled = group["spans"].map(len) > 0
    done = ([int.from_bytes(d, "little", signed=True) for d in group["doc"][settled]], [int.from_bytes(k, "little", signed=True) for k in group["key"][settled]],
            group["spans"][settled].tolist())
    group = group[~settled]
    if not len(group):
        return done
    f = {n: np.frombuffer(b"".join(group[n]), t) for n, t in FIELDS}
    unpacker = zstandard.ZstdDecompressor()
    raw = np.frombuffer(b"".join(map(unpacker.decompress, group["bytes"])), np.uint8)
    size = f["size"].astype(np.int64) - GRAM
    offset = np.cumsum(size) - size
    shape = f["left"].astype(np.uint64) * np.uint64(256) + f["size"]
    # distinct windows, each with its least document
    prints = mixed(f["anchor"] + shape * ODD[7])
    for a in range(0, len(size), 1 << 15):
        part = slice(a, a + (1 << 15))
        n = size[part]
        padded = np.zeros((len(n), WIDE - GRAM), np.uint64)
        padded[np.arange(WIDE - GRAM) < n[:, None]] = raw[offset[part][0]: offset[part][-1] + n[-1]] + np.uint64(1)
        prints[part] += padded @ PRINT
    order = np.lexsort((f["doc"], prints))
    new = np.r_[True, prints[order][1:] != prints[order][:-1]]
    which = np.empty(len(order), np.int64)
    which[order] = np.cumsum(new) - 1
    head = order[new]
    doc = f["doc"][head]
    hit = np.zeros((len(head), WIDE - SPAN + 1), bool)
    # anchors with several distinct windows go through the index
    _, anchor, times = np.unique(f["anchor"][head], return_inverse=True, return_counts=True)
    several = np.flatnonzero(times[anchor] > 1)
    several = several[np.argsort(anchor[several], kind="stable")]
    edges = np.r_[0, np.flatnonzero(np.diff(anchor[several])) + 1, len(several)] if len(several) else np.array([0])
    part = 0
    while part < len(edges) - 1:  # whole anchors together
        to = max(part + 1, int(np.searchsorted(edges, edges[part] + 2 * INDEXED, "right")) - 1)
        i = several[edges[part]: edges[to]]
        rows = head[i]
        n, left = size[rows], f["left"][rows].astype(np.int64)
        # bytes are 1 to 256; the anchor itself is one symbol, at ``left``
        padded = np.zeros((len(i), int(n.max()) + 1), np.int16)
        column = np.arange(padded.shape[1])
        there = (column <= n[:, None]) & (column != left[:, None])
        place = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        padded[there] = raw[np.repeat(offset[rows], n) + place].astype(np.int16) + 1
        found = long_matches(padded, n + 1, anchor[i], left, doc[i], SPAN - GRAM + 1)
        hit[i, : found.shape[1]] = found
        part = to
    # a copy of a window whose least document is smaller is covered as a whole; runs of starts are one span, some windows at a time
    parts = []
    for a in range(0, len(which), RUNS):
        some = slice(a, a + RUNS)
        starts = (hit[which[some]] | (doc[which[some]] < f["doc"][some])[:, None]) & (np.arange(WIDE - SPAN + 1) <= (size[some] + GRAM - SPAN)[:, None])
        turns = np.diff(starts.view(np.int8), axis=1, prepend=np.int8(0), append=np.int8(0))
        (e, begin), (_, end) = np.nonzero(turns == 1), np.nonzero(turns == -1)  # both by window, then by place
        parts.append((f["doc"][some][e], f["key"][some][e], f["at"][some][e] + begin, f["at"][some][e] + end - 1 + SPAN))
    found = spans_by_key(*(np.concatenate(x) for x in zip(*parts)))
    return tuple(a + b for a, b in zip(done, found))


def removed_spans(docs: DataFrame, n_rows: int) -> DataFrame:
    """(doc_id, key, pieces): what to remove of the documents with that id and key (see ``keyed``)."""
    spark = docs.sparkSession
    buckets = 1 << max(BUCKETS.bit_length() - 1, (n_rows // ROWS_PER_BUCKET).bit_length())
    usable = docs.where(F.col("doc_id").isNotNull() & (F.octet_length("text") >= SPAN))
    filters = spark.sparkContext.broadcast(shared_filter(usable.select("text", "doc_id"), buckets))  # 2**27 and 2**23 bits

    def run(pdfs):
        for group in grouped(pdfs, ["bucket"]):
            yield pd.DataFrame(dict(zip(("doc_id", "key", "spans"), resolve(group))))

    found = route(usable, filters, buckets).mapInPandas(slim(run), "doc_id long, key int, spans binary")
    return found.groupBy("doc_id", "key").agg(F.collect_list("spans").alias("pieces"))


def keyed(documents: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id, text and a 32-bit key of both, which tells rows of one id with different texts apart."""
    return documents.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).withColumn(
        "key", F.hash("doc_id", "text"))


def merged(pieces) -> np.ndarray:
    if pieces is None or not len(pieces):
        return np.empty((0, 2), np.int32)
    both = np.frombuffer(b"".join(pieces), np.int32).reshape(-1, 2)
    _, start, end = united(np.zeros(len(both), np.int64), both[:, 0].astype(np.int64), both[:, 1].astype(np.int64))
    return np.stack([start, end], 1)


def keep_bytes(text: bytes, spans: np.ndarray) -> bytes:
    out, at = [], 0
    for a, b in spans:
        out.append(text[at:a])
        at = b
    return b"".join([*out, text[at:]])


def deduplicate(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 for each row."""
    docs = keyed(documents, id_col, text_col)
    spans = removed_spans(docs, documents.count())

    def run(pdfs):
        for pdf in pdfs:
            out = []
            for doc_id, text, pieces in zip(pdf["doc_id"], pdf["text"], pdf["pieces"]):
                raw, cut = text.encode("utf-8", "surrogatepass"), merged(pieces)
                kept = keep_bytes(raw, cut)
                out.append((doc_id, len(raw), len(raw) - len(kept), len(cut), hashlib.sha256(kept).hexdigest()))
            yield pd.DataFrame(out, columns=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    joined = docs.join(spans, ["doc_id", "key"], "left").select(F.col("doc_id").cast("string").alias("doc_id"), "text", "pieces")
    out = joined.mapInPandas(slim(run), "doc_id string, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
    return out.withColumn("doc_id", F.col("doc_id").cast("long"))


def without_repeats(documents: DataFrame) -> DataFrame:
    """The rows of ``documents`` with the repeated bytes cut out of the text and n_chars, where it is there, set anew.

    Bytes that are cut inside a character leave a broken one; what cannot be decoded is left out of the text. Rows
    stay, even with nothing left; a null text becomes empty.
    """
    columns = documents.columns
    docs = documents.withColumn("text", F.coalesce("text", F.lit("")))
    docs = docs.withColumn("_key", F.hash(F.col("doc_id").cast("long"), "text")).withColumn("_id", F.col("doc_id").cast("long"))
    spans = removed_spans(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.col("_key").alias("key")), documents.count())
    joined = docs.join(spans.select(F.col("doc_id").alias("_id"), F.col("key").alias("_key"), "pieces"), ["_id", "_key"], "left")

    @F.pandas_udf("string")
    def cut(text: pd.Series, pieces: pd.Series) -> pd.Series:
        return pd.Series([t if p is None else keep_bytes(t.encode("utf-8", "surrogatepass"), merged(p)).decode("utf-8", "ignore")
                          for t, p in zip(text, pieces)], dtype=object)

    joined = joined.withColumn("text", cut("text", "pieces"))
    if "n_chars" in columns:
        joined = joined.withColumn("n_chars", F.length("text").cast(documents.schema["n_chars"].dataType))
    return joined.select(*columns)
