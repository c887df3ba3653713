"""Filter interaction audit: what each of five quality filters removes, in every order of the filters.

Failures of a document are letters: A fewer than 100 words, B too few distinct words, C too many capitals, D a character of
``[#$%&*|]``, E the same text as a document of smaller doc_id. A to D are expressions over one text. E is an existential
self-join: a left-semi join on hash, exact text and smaller doc_id. Its right side holds each repeated text once, with its
least doc_id, so a group of copies is combined before it moves; its left side is salted where a hash is frequent. The ids
of E are united with those of the other failures and their bits combined; counts by combination give everything else, since
an order only decides which letter of a combination comes first.

Only texts whose hash may occur twice enter the join: hashes that occur twice mark one of ``SLOTS`` slots, and the marked
slots are broadcast (at most ``SLOTS`` longs, whatever the corpus). Where all slots are marked, more texts move; none is lost.

Cases: a null text counts as empty, a null lang as the part ''; a null doc_id is never smaller or larger than another, so its
row is never E; rows that share doc_id and text are not E of each other; a doc_id with several labels is good (toxic) if any
of them says so; an empty table gives no rows; further columns are ignored. Rows of one doc_id, lang and 64-bit hash count
as one text.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

FILTERS = "ABCDE"
#: Slots of the hash filter; salts of a frequent hash, and the share of all rows (1 in so many) from which a hash is frequent.
SLOTS, SALTS, FREQUENT = 1 << 20, 64, 256


def bit(letter: str) -> int:
    return 1 << FILTERS.index(letter)


def failures(text: Column) -> Column:
    """The bits of A to D."""
    words = F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")
    n, distinct = F.size(words), F.size(F.array_distinct(words))
    capitals = F.length(text) - F.length(F.regexp_replace(text, "[A-Z]", ""))
    fails = {"A": n < 100, "B": 100 * distinct < 80 * n, "C": 100 * capitals > 10 * F.length(text), "D": text.rlike(r"[#$%&*|]")}
    total = F.lit(0)
    for letter, condition in fails.items():
        total = total + F.when(condition, bit(letter)).otherwise(0)
    return total


def hashed(documents: DataFrame) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("lang", F.lit("")).alias("part"), text.alias("text"), F.xxhash64(text).alias("hash"))


def copies(docs: DataFrame, hashes: DataFrame, slots: int = SLOTS) -> DataFrame:
    """doc_id, part, hash of the rows whose text a row of smaller doc_id has; ``hashes`` are the hashes of all rows."""
    counted = hashes.groupBy("hash").agg(F.count("*").alias("n"))
    total = hashes.count()
    # fewer than FREQUENT hashes can each hold more than one row in FREQUENT
    hot = [r["hash"] for r in counted.where(F.col("n") > max(2, total // FREQUENT)).select("hash").limit(FREQUENT).collect()]
    slot = F.pmod(F.col("hash"), F.lit(slots))
    marked = counted.where("n > 1").select(slot.alias("slot")).distinct()  # at most ``slots`` rows
    texts = docs.join(F.broadcast(marked), slot == F.col("slot"), "left_semi")
    often = F.col("hash").isin(hot) if hot else F.lit(False)
    salts = F.when(often, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    first = texts.groupBy("hash", "text").agg(F.min("doc_id").alias("least")).withColumn("salt", F.explode(salts)).alias("b")
    later = texts.withColumn("salt", F.when(often, F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(SALTS)).cast("int")).otherwise(0)).alias("a")
    same = [F.col(f"a.{c}") == F.col(f"b.{c}") for c in ("hash", "salt", "text")]
    return later.join(first, [*same, F.col("b.least") < F.col("a.doc_id")], "left_semi").select("doc_id", "part", "hash")


def combinations(documents: DataFrame, labels: DataFrame, slots: int = SLOTS) -> DataFrame:
    """part, bits and the numbers n, good and toxic of documents that fail just the filters of these bits."""
    docs = hashed(documents)
    marks = stored(docs.select("doc_id", "part", "hash", failures(F.col("text")).alias("bits")), "audit-marks")
    ids = ["doc_id", "part", "hash"]
    failed = marks.withColumn("n", F.lit(1)).unionByName(copies(docs, marks.select("hash"), slots).withColumns({"bits": F.lit(bit("E")), "n": F.lit(0)}))
    combined = failed.groupBy(*ids).agg(F.bit_or("bits").alias("bits"), F.sum("n").alias("n")).groupBy("doc_id", "part", "bits").agg(F.sum("n").alias("n"))
    any_of = lambda c: F.max(F.when(F.col(c) == 1, 1).otherwise(0))
    known = labels.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(any_of("quality").alias("good"), any_of("toxic").alias("toxic"))
    n = F.col("n")
    return combined.join(known, "doc_id", "left").groupBy("part", "bits").agg(
        F.sum(n).alias("n"), F.sum(n * F.coalesce("good", F.lit(0))).alias("good"), F.sum(n * F.coalesce("toxic", F.lit(0))).alias("toxic"))


def audit(documents: DataFrame, labels: DataFrame, slots: int = SLOTS) -> DataFrame:
    """One row for each part, order of the filters and step."""
    orders = ["".join(p) for p in permutations(FILTERS)]
    combos = combinations(documents, labels, slots)
    letters = F.concat(*[F.when(F.col("bits").bitwiseAND(bit(x)) != 0, x).otherwise("") for x in FILTERS])
    rows = combos.withColumn("failed", letters).withColumn("filter_order", F.explode(F.lit(orders))).withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(len(FILTERS)))))
    earlier = F.substring(F.col("filter_order"), F.lit(1), F.col("step") - 1)
    rows = rows.withColumns({"filter": F.substring(F.col("filter_order"), F.col("step"), F.lit(1)), "before": earlier})
    # removed earlier: one of its letters stands among the earlier filters
    gone = F.exists(F.split(F.col("failed"), ""), lambda x: (x != "") & F.contains(F.col("before"), x))
    rows = rows.withColumns({"gone": gone, "fails": F.contains(F.col("failed"), F.col("filter"))})
    here, count = F.col("fails") & ~F.col("gone"), lambda when, of="n": F.sum(F.when(when, F.col(of)).otherwise(0)).cast("long")
    steps = rows.groupBy("part", "filter_order", "step", "filter").agg(
        count(~F.col("fails") & ~F.col("gone")).alias("kept"), count(here).alias("removed"), count(F.col("fails") & F.col("gone")).alias("redundant"),
        count(F.col("failed") == F.col("filter")).alias("unique_fails"), count(here, "good").alias("good_lost"), count(here, "toxic").alias("toxic_lost"))
    shapley = F.sum("removed").over(Window.partitionBy("part", "filter")).alias("shapley")
    return steps.select("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", shapley)


ORACLE = """
WITH base AS (
  SELECT d.doc_id, coalesce(d.lang, '') AS part, coalesce(d.text, '') AS t,
         list_filter(string_split_regex(coalesce(d.text, ''), '[\\x20\\x09-\\x0D]+'), lambda w: w <> '') AS words
  FROM documents d),
least AS (SELECT t, min(doc_id) AS first FROM base GROUP BY t),
known AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY doc_id),
failed AS (
  SELECT b.part, coalesce(k.good, 0) AS good, coalesce(k.toxic, 0) AS toxic,
         CASE WHEN len(words) < 100 THEN 'A' ELSE '' END || CASE WHEN 100 * len(list_distinct(words)) < 80 * len(words) THEN 'B' ELSE '' END
         || CASE WHEN 100 * length(regexp_replace(b.t, '[^A-Z]', '', 'g')) > 10 * length(b.t) THEN 'C' ELSE '' END
         || CASE WHEN regexp_matches(b.t, '[#$%&*|]') THEN 'D' ELSE '' END || CASE WHEN coalesce(b.doc_id > l.first, false) THEN 'E' ELSE '' END AS f
  FROM base b JOIN least l ON b.t = l.t LEFT JOIN known k ON b.doc_id = k.doc_id),
combos AS (SELECT part, f, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM failed GROUP BY part, f),
letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
orders AS (
  SELECT a.x || b.x || c.x || d.x || e.x AS o FROM letters a JOIN letters b ON b.x <> a.x JOIN letters c ON c.x NOT IN (a.x, b.x)
  JOIN letters d ON d.x NOT IN (a.x, b.x, c.x) JOIN letters e ON e.x NOT IN (a.x, b.x, c.x, d.x)),
steps AS (SELECT o, s, substr(o, s, 1) AS x, substr(o, 1, s - 1) AS before FROM orders, (SELECT unnest([1, 2, 3, 4, 5]) AS s)),
met AS (
  SELECT part, o, s, x, n, good, toxic, f, contains(f, x) AS fails, length(translate(before, f, '')) < length(before) AS gone FROM combos, steps),
counted AS (
  SELECT part, o AS filter_order, CAST(s AS INTEGER) AS step, x,
         CAST(sum(CASE WHEN NOT fails AND NOT gone THEN n ELSE 0 END) AS BIGINT) AS kept, CAST(sum(CASE WHEN fails AND NOT gone THEN n ELSE 0 END) AS BIGINT) AS removed,
         CAST(sum(CASE WHEN fails AND gone THEN n ELSE 0 END) AS BIGINT) AS redundant, CAST(sum(CASE WHEN f = x THEN n ELSE 0 END) AS BIGINT) AS unique_fails,
         CAST(sum(CASE WHEN fails AND NOT gone THEN good ELSE 0 END) AS BIGINT) AS good_lost, CAST(sum(CASE WHEN fails AND NOT gone THEN toxic ELSE 0 END) AS BIGINT) AS toxic_lost
  FROM met GROUP BY part, o, s, x)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, x) AS BIGINT) AS shapley FROM counted
"""
