"""Language identification by hyperdimensional profiles.

Every letter has a random vector of ``DIM`` signs, worked out from its code point. An n-gram's vector is the product of its
letters' vectors, each rotated by its place (binding); a text's vector is the sum of its n-grams' vectors (bundling). A
language's prototype is the sum of the unit vectors of its training texts, in fixed point, so that sums do not depend on their
order. A text gets the language whose prototype has the largest cosine with its vector; the score is that cosine, 0 at least.

Texts are read whole, as runs of letters in lower case between single blanks, in slices of ``SLICE`` characters that share
N - 1 characters; n-grams are counted for each text and slice and meet their vectors in one matrix product, ``AT_ONCE``
n-grams at a time. Texts never move: only sums by language are shuffled. Prototypes are fetched and broadcast ``BLOCK``
languages at a time (8 MB), best so far carried along, so any number of languages is possible.

Learns from documents whose crc32(doc_id as text) mod 4 is not 2 with a non-null lang and a letter in the text.

Cases: a null text or one without letters is ``und`` with score 0, also where nothing was learned; equal cosines go to the
smaller lang; null and repeated doc_ids are rows of their own; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc_mod

N, DIM, SLICE, AT_ONCE, BLOCK, SCALE, SEED = 3, 1024, 1 << 20, 4096, 1024, 1 << 24, 20_261
UNKNOWN, BLANK = "und", 32
_letters: np.ndarray | None = None


def letters() -> np.ndarray:
    """Whether a code point is a letter."""
    global _letters
    if _letters is None:
        _letters = np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)
    return _letters


def signs(points: np.ndarray, dim: int = DIM) -> np.ndarray:
    """One row of ``dim`` random signs (int8) for each code point."""
    with np.errstate(over="ignore"):
        x = points.astype(np.uint64)[:, None] * np.uint64(0x9E3779B97F4A7C15) + np.arange(1, dim // 64 + 1, dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03) + np.uint64(SEED)
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
        x ^= x >> np.uint64(31)
    return (np.unpackbits(x.view(np.uint8), axis=1).astype(np.int8) << 1) - 1


def normal(text: str) -> np.ndarray:
    """Code points of the text's letters in lower case, a blank around and between runs of them; empty without letters."""
    a = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    a = np.where(letters()[a], a, BLANK)
    a = np.concatenate(([BLANK], a, [BLANK])).astype(np.uint32)
    a = a[np.concatenate(([True], (a[1:] != BLANK) | (a[:-1] != BLANK)))]
    return a if len(a) > 1 else a[:0]


def bundle(rows: list[tuple[int, np.ndarray]], n_rows: int, out: np.ndarray) -> None:
    """Adds the n-grams of slices (row, code points) to the rows of ``out``."""
    if not rows:
        return
    points, inverse = np.unique(np.concatenate([a for _, a in rows]), return_inverse=True)
    k, row = len(points), np.repeat([r for r, _ in rows], [len(a) for _, a in rows])
    code, whole = np.zeros(max(0, len(inverse) - N + 1), np.int64), np.ones(max(0, len(inverse) - N + 1), bool)
    piece = np.repeat(np.arange(len(rows)), [len(a) for _, a in rows])
    for j in range(N):
        code = code * k + inverse[j: len(inverse) - N + 1 + j]
    whole = piece[: len(code)] == piece[N - 1:]
    code, row = code[whole], row[: len(whole)][whole]
    grams, gram = np.unique(code, return_inverse=True)
    cells, counts = np.unique(gram * n_rows + row, return_counts=True)  # by n-gram, then row
    gram, row = cells // n_rows, cells % n_rows
    rotated = [np.roll(signs(points), N - 1 - j, axis=1) for j in range(N)]
    for at in range(0, len(grams), AT_ONCE):
        some = grams[at: at + AT_ONCE]
        vectors = np.ones((len(some), DIM), np.int8)
        for j in range(N):
            vectors *= rotated[j][some // k ** (N - 1 - j) % k]
        a, b = np.searchsorted(gram, (at, at + len(some)))
        matrix = np.zeros((n_rows, len(some)), np.float32)
        matrix[row[a:b], gram[a:b] - at] = counts[a:b]
        out += matrix @ vectors.astype(np.float32)  # whole numbers below 2**24, hence exact


def vectors(texts: list[str | None]) -> Iterator[tuple[int, np.ndarray]]:
    """(first row, vectors of the rows from there on as unit vectors; rows of zeros where there is no letter)."""
    held: list[tuple[int, np.ndarray]] = []
    first, weight, out = 0, 0, np.zeros((0, DIM))

    def done(until: int) -> np.ndarray:
        total = np.zeros((until - first, DIM))
        part, size = [], 0
        for r, a in held:
            for at in range(0, max(1, len(a) - N + 1), SLICE):
                cut = a[at: at + SLICE + N - 1]
                if size + len(cut) > SLICE and part:
                    bundle(part, len(total), total)
                    part, size = [], 0
                part.append((r - first, cut))
                size += len(cut)
        bundle(part, len(total), total)
        length = np.sqrt((total * total).sum(1, keepdims=True))
        return total / np.where(length == 0, 1, length)

    for i, text in enumerate(texts):
        a = normal(text or "")
        if held and weight + len(a) > SLICE:
            yield first, done(i)
            held, first, weight = [], i, 0
        held.append((i, a))
        weight += len(a)
    if held:
        yield first, done(len(texts))


def profiles(documents: DataFrame) -> DataFrame:
    """lang, place, value: the prototypes' components, summed over all training texts."""
    training = documents.where((crc_mod("doc_id", 4) != 2) & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("lang", "text")

    def run(batches):
        held: dict[str, np.ndarray] = {}

        def table():
            values = np.concatenate(list(held.values())) if held else np.zeros(0, np.int64)
            return pa.RecordBatch.from_arrays([pa.array(np.repeat(np.array(list(held), object), DIM), pa.string()), pa.array(np.tile(np.arange(DIM, dtype=np.int32), len(held))),
                                               pa.array(values)], names=["lang", "place", "value"])

        for batch in batches:
            langs, which = np.unique(np.array(batch.column(0).to_pylist(), object), return_inverse=True)
            for first, unit in vectors(batch.column(1).to_pylist()):
                fixed = np.rint(unit * SCALE).astype(np.int64)
                of = which[first: first + len(unit)]
                for k in np.unique(of):
                    there = fixed[of == k].sum(0)
                    if there.any():
                        held[langs[k]] = held.get(langs[k], 0) + there
            if len(held) > BLOCK:
                yield table()
                held.clear()
        if held:
            yield table()

    return training.mapInArrow(run, "lang string, place int, value long").groupBy("lang", "place").agg(F.sum("value").alias("value"))


def predict(documents: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score of each row."""
    from .common import stored

    spark = documents.sparkSession
    learned = stored(profiles(documents), "language-profiles")
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.lit(UNKNOWN).alias("lang_pred"), F.lit(-2.0).alias("score"))
    last, blocks = None, 0
    while True:  # as a rule once: BLOCK languages at a time, in order
        more = learned.where("place = 0") if last is None else learned.where((F.col("place") == 0) & (F.col("lang") > last))
        names = [r["lang"] for r in more.select("lang").orderBy("lang").limit(BLOCK).collect()]
        if not names:
            break
        got = learned.where((F.col("lang") >= names[0]) & (F.col("lang") <= names[-1])).toPandas()  # at most BLOCK * DIM rows
        matrix = np.zeros((len(names), DIM))
        at = {n: i for i, n in enumerate(names)}
        matrix[got["lang"].map(at).to_numpy(), got["place"].to_numpy()] = got["value"]
        matrix /= np.sqrt((matrix * matrix).sum(1, keepdims=True))
        rows, last, blocks = better(rows, spark.sparkContext.broadcast((names, matrix.astype(np.float32)))), names[-1], blocks + 1
    score = F.when(F.col("lang_pred") == UNKNOWN, 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("score"))))
    return rows.select("doc_id", (crc_mod("doc_id", 4) == 2).alias("held_out"), "lang_pred", score.alias("score"))


def better(rows: DataFrame, prototypes) -> DataFrame:
    """The rows with the best of these prototypes where it beats the best so far."""
    def run(batches):
        names, matrix = prototypes.value
        names = np.array(names, object)
        for batch in batches:
            pred, score = np.array(batch.column(2).to_pylist(), object), batch.column(3).to_numpy().copy()
            for first, unit in vectors(batch.column(1).to_pylist()):
                cosine = np.round(unit @ matrix.T.astype(np.float64), 9)
                best = cosine.argmax(1)
                found, here = cosine[np.arange(len(unit)), best], slice(first, first + len(unit))
                wins = unit.any(1) & (found > score[here])
                pred[here], score[here] = np.where(wins, names[best], pred[here]), np.where(wins, found, score[here])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(pred, pa.string()), pa.array(score)], names=batch.schema.names)

    return rows.mapInArrow(run, rows.schema)
