"""Toxicity by non-negative positive-unlabelled learning.

Confirmed toxic documents (P) and unlabelled ones (U) train linear classifiers in numpy on the hashed distinct words of
a text. With the class prior pi, the risk is pi * R_P(+) + max(0, R_U(-) - pi * R_P(-)) with logistic loss; where the
inner difference is below zero it counts as zero, so the negative part cannot be driven below what is possible. pi is the toxic share among the labelled training rows. ``MODELS`` classifiers learn on disjoint
parts of the sample, one task each, and the mean of their coefficients scores all documents.

The sample is bounded: at most ``POSITIVES`` labelled toxic rows and ``UNLABELLED`` other rows, the first by a hash of
their ids, all from the training fold (crc32(doc_id) mod 3 is not 1). Labels, lang, source and doc_id never enter a
score. Whole texts are read, both to learn and to score.

Cases: a null text counts as empty; an empty text scores as the bias alone; rows without label only ever serve as
unlabelled text; null labels are no labels; null and repeated doc_ids are separate rows with their own scores; without
any toxic training row all scores are 0; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from .common import crc_mod, slim

BITS, MODELS, POSITIVES, UNLABELLED, EPOCHS, RATE, DECAY, THRESHOLD = 18, 2, 6000, 16000, 400, 1.0, 1e-5, 0.7
SHRINK, TELLING = 6, 0.6
WORD = re.compile(r"\w+")


def features(text: str | None, bits: int = BITS) -> np.ndarray:
    """Sorted distinct hashed words of the whole text."""
    words = set(WORD.findall(text.lower())) if text else ()
    return np.unique(np.fromiter((zlib.crc32(w.encode("utf-8", "surrogatepass")) >> (32 - bits) for w in words), np.int32, len(words)))


def train(rows: list[np.ndarray], positive: np.ndarray, prior: float, bits: int = BITS, epochs: int = EPOCHS,
          rate: float = RATE, decay: float = DECAY) -> np.ndarray:
    """Coefficients (2**bits words, then the bias) by momentum descent on the non-negative risk.

    A word's column is scaled by how differently P and U hold it (log ratio of its document shares, shrunk by
    ``SHRINK`` documents), so words that occur a few times cannot be used to remember single unlabelled texts.
    """
    size = 1 << bits
    pos, unl = np.flatnonzero(positive), np.flatnonzero(~positive)
    if not len(pos) or not len(unl) or not 0 < prior < 1:
        return np.zeros(size + 1)

    def flat(ids):
        got = [rows[i] for i in ids]
        return np.concatenate(got), np.repeat(np.arange(len(ids)), [len(x) for x in got])

    (wu, at_u), (wp, at_p) = flat(unl), flat(pos)
    in_u, in_p = np.bincount(wu, minlength=size).astype(float), np.bincount(wp, minlength=size).astype(float)
    scale = np.log((in_p + 1) / (len(pos) + 2)) - np.log((in_u + 1) / (len(unl) + 2))
    scale *= (in_p + in_u) / (in_p + in_u + SHRINK)
    scale[np.abs(scale) < TELLING] = 0
    telling = scale != 0
    wu, at_u, wp, at_p = wu[telling[wu]], at_u[telling[wu]], wp[telling[wp]], at_p[telling[wp]]
    w, bias, speed, bias_speed = np.zeros(size), 0.0, np.zeros(size), 0.0
    for _ in range(epochs):
        su = np.bincount(at_u, (w * scale)[wu], len(unl)) + bias
        sp = np.bincount(at_p, (w * scale)[wp], len(pos)) + bias
        # logistic losses: l(+) = log(1+e^-s) with slope -sigmoid(-s), l(-) = log(1+e^s) with slope sigmoid(s)
        negative = np.logaddexp(0, su).mean() - prior * np.logaddexp(0, sp).mean()
        up = 1 / (1 + np.exp(-np.clip(sp, -30, 30)))
        gp = -prior * (1 - up) / len(pos)
        gu = np.zeros(len(unl))
        if negative > 0:
            gu = 1 / (1 + np.exp(-np.clip(su, -30, 30))) / len(unl)
            gp = gp - prior * up / len(pos)
        g = (np.bincount(wu, gu[at_u], size) + np.bincount(wp, gp[at_p], size)) * scale + decay * w
        speed = 0.9 * speed - rate * g
        bias_speed = 0.9 * bias_speed - rate * (gu.sum() + gp.sum())
        w += speed
        bias += bias_speed
    return np.r_[w * scale, bias]


def fit(documents: DataFrame, labels: DataFrame, models: int = MODELS, positives: int = POSITIVES,
        unlabelled: int = UNLABELLED) -> np.ndarray:
    """The mean coefficients of ``models`` classifiers; their size is fixed by ``BITS``, whatever the corpus."""
    known = labels.where(F.col("toxic").isNotNull() & (crc_mod("doc_id", 3) != 1))
    counts = known.agg(F.count("*").alias("n"), F.sum(F.when(F.col("toxic") == 1, 1).otherwise(0)).alias("p")).first()
    if not counts["n"] or not counts["p"]:
        return np.zeros((1 << BITS) + 1)
    prior = counts["p"] / counts["n"]

    def first(ids: DataFrame, most: int, mark: int) -> DataFrame:
        ids = ids.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.col("doc_id").cast("long"), F.lit(mark)).alias("h"))
        return ids.where(F.col("doc_id").isNotNull()).orderBy("h", "doc_id").limit(most).select("doc_id", F.lit(mark).alias("positive"))

    chosen = first(known.where("toxic = 1").select("doc_id").distinct(), positives, 1).unionByName(
        first(documents.where(crc_mod("doc_id", 3) != 1).select("doc_id"), unlabelled, 0).distinct())
    # at most positives + unlabelled ids, by the limits above
    sample = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(chosen), "doc_id")
    sample = sample.select("text", "positive", F.pmod(F.xxhash64("doc_id", F.lit(9)), F.lit(models)).cast("int").alias("part"))

    def encode(batches):
        for pdf in batches:
            yield pd.DataFrame({"part": pdf["part"], "positive": pdf["positive"], "words": [features(t).tobytes() for t in pdf["text"]]})

    def learn(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = [np.frombuffer(b, np.int32) for b in pdf["words"]]
        order = sorted(range(len(rows)), key=lambda i: (pdf["positive"].iloc[i], pdf["words"].iloc[i]))
        w = train([rows[i] for i in order], pdf["positive"].to_numpy()[order] == 1, prior)
        return pd.DataFrame({"part": pdf["part"].iloc[:1], "w": [w.astype(np.float32).tobytes()]})

    encoded = sample.mapInPandas(slim(encode), "part int, positive int, words binary")
    trained = encoded.groupBy("part").applyInPandas(learn, "part int, w binary").orderBy("part").collect()
    if not trained:
        return np.zeros((1 << BITS) + 1)
    return np.mean([np.frombuffer(r["w"], np.float32) for r in trained], axis=0, dtype=np.float64)


def score(documents: DataFrame, w: np.ndarray, keep: tuple[str, ...] = ("doc_id",), text_col: str = "text",
          name: str = "score") -> DataFrame:
    """The columns ``keep`` and, as ``name``, the score of each row's whole text."""
    spark = documents.sparkSession
    known = bool(np.any(w))
    # 2**BITS coefficients at most, most of them 0
    nonzero = np.flatnonzero(np.abs(w[:-1]) > 1e-6)
    model = spark.sparkContext.broadcast((nonzero.astype(np.int32), w[nonzero].astype(np.float32), float(w[-1])))
    schema = StructType([*documents.select(*keep).schema.fields, StructField(name, DoubleType())])

    def run(batches):
        at, values, bias = model.value
        table = np.zeros(1 << BITS)
        table[at] = values
        for batch in batches:
            total = np.array([table[features(t)].sum() + bias for t in batch.column(len(keep)).to_pylist()], dtype=float)
            scores = 1 / (1 + np.exp(-np.clip(total, -500, 500))) if known else np.zeros(len(total))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(scores)], names=schema.names)

    return documents.select(*keep, F.col(text_col).alias("_scored")).mapInArrow(slim(run), schema)


def classify(documents: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted for each row."""
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return score(docs, fit(docs, labels)).select(
        "doc_id", (crc_mod("doc_id", 3) == 1).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def without_toxic(documents: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows whose text scores below ``threshold``, with the columns of ``documents``."""
    keep = tuple(documents.columns)
    return score(documents, fit(documents, labels), keep, name="_toxicity").where(F.col("_toxicity") < threshold).select(*keep)
