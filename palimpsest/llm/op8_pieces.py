"""SentencePiece encoding and decoding: best-score segmentation, in giant documents by a max-plus parallel scan.

The vocabulary and its scores come from a public model file (never trained here). A text's segmentation is the one
whose pieces have the highest score sum; sums are exact: whole scores are taken as they are, others in steps of 2^-20. A character
that is no piece is spelt in byte pieces at a score below all others. White space is escaped as SentencePiece does it: blanks become
U+2581 and one stands before the text; a U+2581 of the text itself is spelt in bytes, so decoding gives back every text.

No piece spans the start of a new word, so words are segmented on their own: the distinct words of a batch once, the rest is
put together by Arrow. Documents of ``CHUNK`` characters or more are split, and each chunk is a row of its own from then on:
1. A chunk's transfer matrix holds, for each overhang i with which a piece may reach into it and each overhang j with which one
   may reach beyond it, the best score from i to j. In a chunk that holds the start of a word all paths meet there and the matrix is
   the sum of a column and a row; chunks without any are worked out in full.
2. Matrices combine by max-plus products, which are associative: up a tree of ``FAN`` children a node, then down again, which gives
   each chunk the best scores of all overhangs at its front.
3. From these each chunk tells, alone, for each overhang at its end the one at its front; composed from the last chunk to the first
   these maps fix the overhang at every border, and each chunk is traced back alone.

Cases: a null text counts as empty; an empty text has no pieces; of segmentations of equal score that with the earliest start of
the last piece is taken, and so on towards the front, whatever the chunks; null and repeated doc_ids are separate rows; an empty
table gives no rows; columns with clashing names are kept as they are only where asked for.
"""

from __future__ import annotations

import hashlib
import re
from array import array

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slim, stored

CHUNK, FAN, MEMO, AT_ONCE = 65_536, 32, 120_000, 1 << 22
BLANK, OWN_BLANK = "▁", "\udc81"
LOW = -(1 << 60)


def default_model() -> str:
    return "/opt/tokenizers/piece_bpe_32k.model"


SLOT_BITS = 20
STEP, MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def hashes(codes: np.ndarray, longest: int) -> list[np.ndarray]:
    """For each length up to ``longest`` the 64-bit hashes (row, start) of all substrings."""
    one = (codes.astype(np.uint64) + np.uint64(1)) * MIX
    one ^= one >> np.uint64(32)
    out = [one]
    for n in range(2, longest + 1):
        out.append(out[-1][:, :-1] * STEP + one[:, n - 1:])
    return out


def slot_of(h: np.ndarray) -> np.ndarray:
    return (h * MIX) >> np.uint64(64 - SLOT_BITS)


_KEPT: dict[str, "Pieces"] = {}


def kept(vocabulary) -> "Pieces":
    """The vocabulary's Pieces, made once for each Python worker; words stay in its memo from task to task."""
    if vocabulary[-1] not in _KEPT:
        _KEPT[vocabulary[-1]] = Pieces(*vocabulary[:2])
    return _KEPT[vocabulary[-1]]


class Pieces:
    """The vocabulary with best segmentations of single words, chunks and texts."""

    def __init__(self, pieces: list[tuple[str, int, int]], byte_ids: list[int]):
        self.piece = {p: (i, score) for p, i, score in pieces}
        text = {i: p.replace(BLANK, " ").encode("utf-8") for p, i, _ in pieces}
        text |= {i: bytes([b]) for b, i in enumerate(byte_ids)}
        self.text = pa.array([text.get(i, b"") for i in range(max(text) + 1)], pa.binary())
        self.byte_ids = byte_ids
        self.longest = max(map(len, self.piece))
        self.unknown = min(s for _, _, s in pieces) - 10
        # every beginning of a piece, with the piece's score where it is one
        self.stem: dict[str, int | None] = {p[:n]: None for p in self.piece for n in range(1, len(p))}
        self.stem |= {p: score for p, (_, score) in self.piece.items()}
        self.memo: dict[bytes, tuple[int, bytes]] = {}
        # an open-addressed table of the pieces' hashes for whole batches of words
        self.key, self.at = np.zeros(1 << SLOT_BITS, np.uint64), np.zeros(1 << SLOT_BITS, np.int32)
        self.ids = np.array([i for _, i, _ in pieces], np.int32)
        self.scores = np.array([s for _, _, s in pieces], np.int64)
        self.probes = 1
        for k, (p, _, _) in enumerate(pieces):
            h = hashes(np.frombuffer(p.encode("utf-32-le"), np.uint32)[None, :], len(p))[-1][0]
            slot, h, tries = int(slot_of(h)[0]), h[0], 1
            while self.key[slot]:
                slot, tries = (slot + 1) % len(self.key), tries + 1
            self.key[slot], self.at[slot], self.probes = h, k, max(self.probes, tries)

    @staticmethod
    def load(model: str) -> tuple[list[tuple[str, int, int]], list[int], float, str]:
        """(pieces with ids and scores in steps, ids of the bytes, size of a step, a key of all this)."""
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=model)
        bytes_, pieces = {}, []
        for i in range(sp.get_piece_size()):
            name = sp.id_to_piece(i)
            if sp.is_byte(i):
                bytes_[int(name[1:-1], 16)] = i
            elif not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)) and BLANK not in name.lstrip(BLANK):
                pieces.append((name, i, sp.get_score(i)))
        step = 1.0 if all(score == int(score) for _, _, score in pieces) else 2.0**-20
        pieces = [(name, i, round(score / step)) for name, i, score in pieces]
        byte_ids = [bytes_[b] for b in range(256)]
        return pieces, byte_ids, step, hashlib.sha256(repr((pieces, byte_ids)).encode("utf-8", "surrogatepass")).hexdigest()

    def spell(self, char: str) -> list[int]:
        char = BLANK if char == OWN_BLANK else char
        return [self.byte_ids[b] for b in char.encode("utf-8", "surrogatepass")]

    def best(self, text: str, entry: list[int], exits: int) -> tuple[list[int], list[int]]:
        """Best scores of, and starts before, all places up to len(text) + exits.

        ``entry[i]`` is the score of arriving at place i from before the text (LOW: never). The last ``exits``
        characters of ``text`` belong to the next chunk: pieces reach into them, none starts there.
        """
        n = len(text)
        inner = n - exits
        best, start = [LOW] * (n + 1), [-1] * (n + 1)
        best[: min(len(entry), n + 1)] = entry[: n + 1]
        get, longest = self.piece.get, self.longest
        for end in range(1, n + 1):
            top, at = best[end], -1
            for s in range(max(0, end - longest), min(end, inner)):
                if best[s] <= LOW:
                    continue
                found = get(text[s:end])
                if found is not None:
                    value = best[s] + found[1]
                elif end - s == 1:
                    value = best[s] + self.unknown
                else:
                    continue
                if value > top:
                    top, at = value, s
            best[end], start[end] = top, at
        return best, start

    def trace(self, text: str, start: list[int], end: int) -> list[int]:
        """Ids of the pieces that lead to ``end`` from where the path entered."""
        out = []
        while start[end] >= 0:
            s = start[end]
            found = self.piece.get(text[s:end])
            out.append([found[0]] if found else self.spell(text[s:end]))
            end = s
        return [i for ids in reversed(out) for i in ids]

    def unit(self, raw: bytes) -> tuple[int, bytes]:
        """(score, ids) of one word with the blanks before it."""
        got = self.memo.get(raw)
        if got is None:
            word = spelt(raw)
            n, stem, absent = len(word), self.stem, object()
            best, start = [0] + [LOW] * n, [0] * (n + 1)
            for s in range(n):  # from left to right, so that of equal sums the earliest start stays
                here = best[s]
                for end in range(s + 1, n + 1):
                    score = stem.get(word[s:end], absent)
                    if end == s + 1:
                        if score is None or score is absent:
                            more, score = score is None, self.unknown
                        else:
                            more = True
                    elif score is None:
                        continue
                    elif score is absent:
                        break
                    if here + score > best[end]:
                        best[end], start[end] = here + score, s
                    if not more:
                        break
            ids, end = [], n
            while end:
                found = self.piece.get(word[start[end]: end])
                ids.append([found[0]] if found else self.spell(word[start[end]: end]))
                end = start[end]
            got = best[n], array("i", [i for x in reversed(ids) for i in x]).tobytes()
            if len(self.memo) >= MEMO:
                self.memo.clear()
            if n <= 64:
                self.memo[raw] = got
        return got

    def lookup(self, h: np.ndarray) -> np.ndarray:
        """The number of the piece with each hash, -1 where there is none."""
        slot = slot_of(h).astype(np.int64)
        key = self.key[slot]
        found = np.where(key == h, self.at[slot], -1)
        going = np.nonzero((key != h) & (key != 0))
        for _ in range(self.probes - 1):
            if not len(going[0]):
                break
            slot[going] = (slot[going] + 1) % len(self.key)
            key = self.key[slot[going]]
            hit = key == h[going]
            found[tuple(g[hit] for g in going)] = self.at[slot[tuple(g[hit] for g in going)]]
            left = ~hit & (key != 0)
            going = tuple(g[left] for g in going)
        return found

    def learn_words(self, raws: list[bytes]) -> None:
        """Puts the best segmentations of many words into the memo, all words of a length at once."""
        by_length: dict[int, list[tuple[bytes, str]]] = {}
        for raw in raws:
            word = spelt(raw)
            by_length.setdefault(len(word), []).append((raw, word))
        if len(self.memo) + len(raws) > MEMO:
            self.memo.clear()
        for n, both in by_length.items():
            if n > 64 or len(both) < 8:
                continue  # one by one, when they come
            keys, group = zip(*both)
            codes = np.frombuffer("".join(group).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(-1, n)
            pieces = [self.lookup(h) for h in hashes(codes, min(n, self.longest))]
            values = [np.where(p >= 0, self.scores[p], LOW) for p in pieces]
            values[0] = np.where(pieces[0] >= 0, values[0], self.unknown)
            best = np.full((n + 1, len(group)), 2 * LOW, np.int64)
            start = np.zeros((n + 1, len(group)), np.int64)
            best[0] = 0
            for end in range(1, n + 1):
                for s in range(max(0, end - len(values)), end):  # the earliest start of the best stays
                    value = best[s] + values[end - s - 1][:, s]
                    better = value > best[end]
                    best[end] = np.where(better, value, best[end])
                    start[end] = np.where(better, s, start[end])
            end, rows, taken = np.full(len(group), n), np.arange(len(group)), []
            while (going := end > 0).any():
                s = start[end, rows]
                ids = np.full(len(group), -2, np.int32)  # -1: an unknown character, -2: nothing
                for k, p in enumerate(pieces):
                    m = np.flatnonzero(going & (end - s == k + 1))
                    found = p[m, s[m]]
                    ids[m] = np.where(found >= 0, self.ids[found], -1)
                taken.append(ids)
                end = np.where(going, s, end)
            table = np.stack(taken[::-1], 1)
            whole = (table != -1).all(1)
            count = (table >= 0).sum(1)
            flat = table[table >= 0] if whole.all() else table[whole][table[whole] >= 0]
            ends = np.cumsum(np.where(whole, count, 0))
            raw, scores = flat.astype(np.int32).tobytes(), best[n].tolist()
            for w, ok, e, c, score in zip(keys, whole.tolist(), ends.tolist(), count.tolist(), scores):
                if ok:
                    self.memo[w] = score, raw[4 * (e - c): 4 * e]

    def encode(self, escaped: str) -> tuple[int, bytes]:
        """(score, ids) of an escaped text that begins and ends with words."""
        scores, ids = self.encode_all([unescaped(escaped)])
        return int(scores[0]), ids[0].as_py()

    def encode_all(self, texts: list[bytes]) -> tuple[np.ndarray, pa.BinaryArray]:
        """Scores and ids (int32) of texts that begin with a blank or are empty."""
        if not texts:
            return np.empty(0, np.int64), pa.array([], pa.binary())
        size = np.array([len(t) for t in texts])
        begin = np.cumsum(size) - size
        raw = np.frombuffer(b"".join(texts), np.uint8)
        blank = raw == 32
        first = blank.copy()
        first[1:] &= ~blank[:-1]
        first[begin[size > 0]] = True
        starts = np.flatnonzero(first)
        words = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(np.r_[starts, len(raw)].astype(np.int32)), pa.py_buffer(raw)]).dictionary_encode()
        distinct = words.dictionary.to_pylist()
        memo = self.memo
        fresh = [w for w in distinct if w not in memo]
        if len(fresh) > 64:
            self.learn_words(fresh)
        got = [memo.get(w) or self.unit(w) for w in distinct]
        which = words.indices
        ids = pa.array([g[1] for g in got], pa.binary()).take(which)
        edges = np.searchsorted(starts, np.r_[begin, len(raw)])
        total = np.r_[0, np.cumsum(np.array([g[0] for g in got], np.int64)[which.to_numpy()])]
        ends = ids.buffers()[1]
        ends = np.frombuffer(ends, np.int32)[ids.offset: ids.offset + len(ids) + 1] if len(ids) else np.zeros(1, np.int32)
        out = pa.Array.from_buffers(pa.binary(), len(texts), [None, pa.py_buffer(ends[edges].astype(np.int32)), ids.buffers()[2]])
        return total[edges[1:]] - total[edges[:-1]], out

    def decode(self, pieces: pa.BinaryArray) -> list[bytes]:
        """The bytes of rows of ids, each without the blank that stands before a text."""
        ends = np.frombuffer(pieces.buffers()[1], np.int32)[pieces.offset: pieces.offset + len(pieces) + 1]
        ids = np.frombuffer(pieces.buffers()[2], np.uint8)[ends[0]: ends[-1]].view(np.int32) if ends[-1] > ends[0] else np.empty(0, np.int32)
        out = self.text.take(pa.array(ids)).cast(pa.large_binary())
        at = np.frombuffer(out.buffers()[1], np.int64)[out.offset: out.offset + len(out) + 1] if len(out) else np.zeros(1, np.int64)
        at, data = at[(ends - ends[0]) // 4], memoryview(out.buffers()[2]) if len(out) else memoryview(b"")
        return [bytes(data[a + 1: b]) for a, b in zip(at[:-1].tolist(), at[1:].tolist())]

    def middle(self, text: str, inner: int) -> tuple[int, int]:
        """The first start of a word that no piece from before the chunk reaches, and the last one (-1, -1: none)."""
        first = last = -1
        for m in re.compile(f"(?<=[^{BLANK}]){BLANK}").finditer(text, self.longest, inner):
            if first < 0:
                first = m.start()
            last = m.start()
        return first, last

    def matrix(self, text: str, exits: int) -> np.ndarray:
        """The transfer matrix of a chunk: text holds it and up to ``longest - 1`` = ``exits`` further characters."""
        size, inner = self.longest, len(text) - exits
        out = np.full((size, size), LOW, np.int64)
        first, last = self.middle(text, inner)
        if first >= size:
            head = [self._from(text[:first], i, 0)[0] for i in range(size)]
            between = self.encode(text[first:last])[0]
            tail = self._from(text[last:], 0, exits)
            for i in range(size):
                if head[i] > LOW:
                    for j in range(min(exits, size - 1) + 1):
                        if tail[j] > LOW:
                            out[i, j] = head[i] + between + tail[j]
            return out
        for i in range(min(size, inner + 1)):
            row = self._from(text, i, exits)
            out[i, : len(row)] = row[:size]
        return out

    def _from(self, text: str, i: int, exits: int) -> list[int]:
        """Best scores from place i to all exits; LOW where there is no way."""
        best, _ = self.best(text, [LOW] * i + [0], exits)
        return best[len(text) - exits:]

    def fronts(self, text: str, exits: int, front: list[int]) -> list[int]:
        """For each overhang at the end the overhang at the front (scores ``front``) that its best path comes from; -1: none."""
        inner = len(text) - exits

        def back(start, end):
            while start[end] >= 0:
                end = start[end]
            return end

        first, _ = self.middle(text, inner)
        if first >= self.longest:
            _, start = self.best(text[:first], front, 0)
            return [back(start, first)] * self.longest
        best, start = self.best(text, front, exits)
        return [back(start, inner + j) if j <= exits and best[inner + j] > LOW // 2 else -1 for j in range(self.longest)]

    def between(self, text: str, exits: int, front: list[int], leave: int) -> bytes:
        """Ids of the best path from the front to overhang ``leave``."""
        inner = len(text) - exits
        first, last = self.middle(text, inner)
        if first < self.longest:
            _, start = self.best(text, front, exits)
            return np.array(self.trace(text, start, inner + leave), np.int32).tobytes()
        _, start = self.best(text[:first], front, 0)
        head = np.array(self.trace(text[:first], start, first), np.int32).tobytes()
        end = text[last:]
        _, start = self.best(end, [0], exits)
        tail = np.array(self.trace(end, start, len(end) - exits + leave), np.int32).tobytes()
        return head + self.encode(text[first:last])[1] + tail


def spelt(raw: bytes) -> str:
    return raw.decode("utf-8", "surrogatepass").replace(BLANK, OWN_BLANK).replace(" ", BLANK)


def unescaped(text: str) -> bytes:
    return text.replace(BLANK, " ").replace(OWN_BLANK, BLANK).encode("utf-8", "surrogatepass")


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The max-plus product, associative; LOW absorbs."""
    out = (a[:, :, None] + b[None, :, :]).max(1)
    return np.where(out < LOW // 2, LOW, out)


def escape(text: str) -> str:
    return BLANK + text.replace(BLANK, OWN_BLANK).replace(" ", BLANK) if text else ""


def prefixes(front: np.ndarray, matrices: list[np.ndarray]) -> list[np.ndarray]:
    """The best scores of all overhangs at the front of each chunk, from those at the front of the first."""
    out = [front]
    for m in matrices[:-1]:
        out.append(product(out[-1][None, :], m)[0])
    return out


def split(escaped: str, longest: int, chunk: int = CHUNK):
    """(number, text with up to ``longest`` - 1 further characters, how many of these there are)."""
    for k, at in enumerate(range(0, len(escaped), chunk)):
        text = escaped[at: at + chunk + longest - 1]
        yield k, text, max(0, len(text) - chunk)


def rows_of(documents: DataFrame, text_col: str) -> DataFrame:
    return documents.withColumn("_text", F.coalesce(F.col(text_col).cast("string"), F.lit(""))).withColumn("_row", F.monotonically_increasing_id())


def encode(documents: DataFrame, text_col: str = "text", model: str | None = None, keep: tuple[str, ...] = ("doc_id",),
           chunk: int = CHUNK) -> DataFrame:
    """The columns ``keep`` (of simple types), n_bytes, pieces binary (int32 ids in order), n_pieces and score."""
    spark = documents.sparkSession
    vocabulary = spark.sparkContext.broadcast(Pieces.load(model or default_model()))  # bounded by the vocabulary
    kept_ = [f"_k{i}" for i in range(len(keep))]
    types = {k: documents.schema[c].dataType for k, c in zip(kept_, keep)}
    step = vocabulary.value[2]
    docs = rows_of(documents, text_col).select("_row", F.octet_length("_text").cast("long").alias("n_bytes"), "_text",
                                               *[F.col(c).cast("string").alias(k) for k, c in zip(kept_, keep)])
    fields = "_row long, n_bytes long, " + ", ".join(f"{k} string" for k in kept_)
    columns = ["_row", "n_bytes", *kept_]

    def small(batches):
        p = kept(vocabulary.value)
        for batch in batches:
            texts = [b" " + t.encode("utf-8", "surrogatepass") if t else b"" for t in batch.column("_text").to_pylist()]
            ends = np.cumsum([len(t) for t in texts])
            at = 0
            while at < len(texts):  # a few megabytes at once
                to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + AT_ONCE, "right")))
                score, ids = p.encode_all(texts[at:to])
                part = batch.slice(at, to - at)
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in columns), ids, pa.array(score)], names=[*columns, "pieces", "score"])
                at = to

    def split_up(pdfs):
        p = kept(vocabulary.value)
        for pdf in pdfs:
            for row, text in zip(pdf["_row"], pdf["_text"]):
                parts = [(row, k, exits, part.encode("utf-8", "surrogatepass")) for k, part, exits in split(escape(text), p.longest, chunk)]
                yield pd.DataFrame(parts, columns=["_row", "chunk", "exits", "text"])

    short = F.length("_text") < chunk
    direct = docs.where(short).mapInArrow(slim(small), fields + ", pieces binary, score long")
    giant = stored(docs.where(~short), "pieces-giant")
    chunks = stored(giant.mapInPandas(slim(split_up), "_row long, chunk int, exits int, text binary").repartition("_row", "chunk"), "pieces-chunks")

    def transfer(pdfs):
        p = kept(vocabulary.value)
        for pdf in pdfs:
            made = [p.matrix(bytes(t).decode("utf-8", "surrogatepass"), int(x)).tobytes() for t, x in zip(pdf["text"], pdf["exits"])]
            yield pd.DataFrame({"_row": pdf["_row"], "chunk": pdf["chunk"], "matrix": made})

    def read(matrices: pd.Series) -> list[np.ndarray]:
        return [np.frombuffer(m, np.int64).reshape(int(np.sqrt(len(m) // 8)), -1) for m in matrices]

    def combine(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("chunk")
        whole, *rest = read(pdf["matrix"])
        for m in rest:
            whole = product(whole, m)
        return pd.DataFrame({"_row": pdf["_row"].iloc[:1], "chunk": pdf["chunk"].iloc[:1] // FAN, "matrix": [whole.tobytes()]})

    def spread(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("chunk")
        front = np.frombuffer(pdf["front"].iloc[0], np.int64)
        return pd.DataFrame({"_row": pdf["_row"], "chunk": pdf["chunk"], "front": [v.tobytes() for v in prefixes(front, read(pdf["matrix"]))]})

    # up the tree, level by level, and down again
    levels = [stored(chunks.mapInPandas(slim(transfer), "_row long, chunk int, matrix binary"), "pieces-matrices")]
    most = levels[0].agg(F.max("chunk")).first()[0]
    while most:
        levels.append(stored(levels[-1].groupBy("_row", F.floor(F.col("chunk") / FAN).alias("node")).applyInPandas(combine, "_row long, chunk int, matrix binary"), "pieces-matrices"))
        most //= FAN
    start = np.full(kept(vocabulary.value).longest, LOW, np.int64)
    start[0] = 0
    fronts = levels[-1].select("_row", "chunk", F.lit(bytearray(start.tobytes())).alias("front"))
    total = levels[-1].select("_row", F.col("matrix").alias("whole"))
    for level in reversed(levels[:-1]):
        nodes = level.withColumn("node", F.floor(F.col("chunk") / FAN)).join(fronts.select("_row", F.col("chunk").cast("long").alias("node"), "front"), ["_row", "node"])
        fronts = stored(nodes.groupBy("_row", "node").applyInPandas(spread, "_row long, chunk int, front binary"), "pieces-fronts")
    at_front = chunks.join(fronts, ["_row", "chunk"])

    def maps(pdfs):
        p = kept(vocabulary.value)
        for pdf in pdfs:
            made = [p.fronts(bytes(t).decode("utf-8", "surrogatepass"), int(x), np.frombuffer(f, np.int64).tolist()) for t, x, f in zip(pdf["text"], pdf["exits"], pdf["front"])]
            yield pd.DataFrame({"_row": pdf["_row"], "chunk": pdf["chunk"], "comes": made})

    # a few numbers for each chunk of one document
    comes = at_front.mapInPandas(slim(maps), "_row long, chunk int, comes array<int>").groupBy("_row").agg(F.array_sort(F.collect_list(F.struct("chunk", "comes"))).alias("all"))
    last = F.aggregate(F.reverse("all"), F.array(F.lit(0)), lambda a, x: F.concat(F.array(x["comes"][a[0]]), a))
    leaves = comes.select("_row", F.posexplode(F.slice(last, 2, F.size("all"))).alias("chunk", "leave"))

    def back(pdfs):
        p = kept(vocabulary.value)
        for pdf in pdfs:
            ids = [p.between(bytes(t).decode("utf-8", "surrogatepass"), int(x), np.frombuffer(f, np.int64).tolist(), int(o))
                   for t, x, f, o in zip(pdf["text"], pdf["exits"], pdf["front"], pdf["leave"])]
            yield pd.DataFrame({"_row": pdf["_row"], "chunk": pdf["chunk"], "pieces": ids})

    @F.pandas_udf("binary")
    def one_text(parts: pd.Series) -> pd.Series:
        return parts.map(lambda chunks_: b"".join(c["pieces"] for c in sorted(chunks_, key=lambda c: c["chunk"])))

    @F.pandas_udf("long")
    def best_of(whole: pd.Series) -> pd.Series:
        return whole.map(lambda m: int(np.frombuffer(m, np.int64)[0]))  # from no overhang to none

    traced = at_front.join(leaves, ["_row", "chunk"]).mapInPandas(slim(back), "_row long, chunk int, pieces binary")
    # one document's pieces, as large as its text
    whole = traced.groupBy("_row").agg(F.collect_list(F.struct("chunk", "pieces")).alias("parts")).select("_row", one_text("parts").alias("pieces"))
    long_ = giant.drop("_text").join(whole, "_row").join(total, "_row").withColumn("score", best_of("whole"))
    shape = ["n_bytes", "pieces", (F.octet_length("pieces") / 4).cast("long").alias("n_pieces"), (F.col("score") * F.lit(step)).alias("score")]
    back_to = [F.col(k).cast(types[k]).alias(c) for k, c in zip(kept_, keep)]
    return direct.select(*back_to, *shape).unionByName(long_.select(*back_to, *shape))


def decode(encoded: DataFrame, model: str | None = None, keep: tuple[str, ...] = ("doc_id",), column: str = "pieces") -> DataFrame:
    """The columns ``keep`` and the text of the pieces."""
    vocabulary = encoded.sparkSession.sparkContext.broadcast(Pieces.load(model or default_model()))

    @F.pandas_udf("string")
    def text(pieces: pd.Series) -> pd.Series:
        known = pieces.notna().to_numpy()
        texts = kept(vocabulary.value).decode(pa.array([b or b"" for b in pieces], pa.binary()))
        return pd.Series([t.decode("utf-8", "surrogatepass") if k else None for t, k in zip(texts, known)], dtype=object)

    return encoded.select(*keep, text(column).alias("text"))


def round_trip(documents: DataFrame, model: str | None = None) -> DataFrame:
    """doc_id, n_bytes, n_pieces, score, pieces_sha256 and the SHA-256 of the decoded text for each row."""
    encoded = encode(documents, model=model)
    vocabulary = encoded.sparkSession.sparkContext.broadcast(Pieces.load(model or default_model()))

    @F.pandas_udf("string")
    def decoded_hash(pieces: pd.Series) -> pd.Series:
        texts = kept(vocabulary.value).decode(pa.array(pieces, pa.binary()))
        return pd.Series([hashlib.sha256(t).hexdigest() for t in texts], dtype=object)

    return encoded.select("doc_id", "n_bytes", "n_pieces", "score", F.sha2("pieces", 256).alias("pieces_sha256"), decoded_hash("pieces").alias("decoded_sha256"))
