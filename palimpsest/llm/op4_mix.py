"""Mixing sources to target weights by Sainte-Laguë apportionment.

Targets: all words are shared among the sources by weight; a target stops at ``MOST`` times its source's size and the
excess is shared again by weight. With the sources in order of (cap / weight), those before the first whose cap is at
or above the common level are capped and the others lie at that level, which is where repeated sharing ends.
Quotas: the words are cut in blocks of ``BLOCK``. Seat j of a claim v has the quotient v / (2j - 1) and the highest
quotients get the seats. Rounding v / (V / K) to the nearest integer is off by few seats; only those few quotients are
made and ranked. Sources get their blocks from all blocks, then the shards of a source from the source's blocks.
Selection: within a shard the documents lie in a seeded order; whole rounds take every document, what is left of the
quota takes the first documents of the order, the last one in part. Nothing is taken more than ``MOST`` times.

Shards hold about ``SHARD`` documents each, by a hash, so a source with a third of all rows has as many more shards.
The rows of sources and shards are the only ones that are ranked in common: one row for each source in one window, one
for each shard in its source's.

Cases: a null text has size 0 and takes 0; null source is one source, last in order; null and repeated doc_ids are
separate rows; equal rows may swap their parts; an empty table gives no rows; a corpus without words has targets 0;
further columns are ignored. Reruns agree: order and shards come from hashes of id, size and text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

BLOCK, SHARD, MOST, SEED, SALTS = 4, 128, 3, 17, 64
WORD = r"[^\x20\x09-\x0D]+"


def targets(sources: DataFrame, most: int = MOST) -> DataFrame:
    """Adds weight and target to (skey, source, source_size)."""
    everyone = Window.partitionBy()
    s = sources.withColumn("weight", 1 + (F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1) % 3)
    s = s.withColumn("cap", F.col("source_size") * most).withColumn("ratio", F.col("cap") / F.col("weight"))
    before = Window.orderBy("ratio", "skey").rowsBetween(Window.unboundedPreceding, -1)
    s = s.withColumn("level", (F.sum("source_size").over(everyone) - F.coalesce(F.sum("cap").over(before), F.lit(0)))
                     / (F.sum("weight").over(everyone) - F.coalesce(F.sum("weight").over(before), F.lit(0))))
    s = s.withColumn("open", F.col("ratio") >= F.col("level"))
    level = F.min_by(F.when(F.col("open"), F.col("level")), F.when(F.col("open"), F.struct("ratio", "skey"))).over(everyone)
    return s.withColumn("target", F.when(F.col("open"), level * F.col("weight")).otherwise(F.col("cap")).cast("double"))


def sainte_lague(claims: DataFrame, group: list[str], name: str, claim: str, seats: str) -> DataFrame:
    """Adds ``quota`` to rows (group.., name, claim, seats): the group's seats by highest quotients, ties by name."""
    whole = Window.partitionBy(*group)
    c = claims.withColumn("v", F.col(claim).cast("double")).withColumn("all_v", F.sum("v").over(whole))
    c = c.withColumn("near", F.when((F.col("all_v") > 0) & (F.col(seats) > 0),
                                    F.floor(F.col("v") * F.col(seats) / F.col("all_v") + 0.5)).otherwise(F.lit(0)).cast("long"))
    c = c.withColumn("diff", F.when(F.col("all_v") > 0, F.col(seats) - F.sum("near").over(whole)).otherwise(F.lit(0)).cast("long"))
    c = c.withColumn("n", F.count("*").over(whole))
    # within a change of the divisor that moves diff seats, a claim gains or loses its share of diff + n, plus one
    reach = F.when(F.col("diff") == 0, F.lit(0)).otherwise(F.ceil((F.abs("diff") + F.col("n")) * F.col("v") / F.col("all_v")) + 1).cast("int")
    reach = F.when(F.col("diff") < 0, F.least(reach.cast("long"), F.col("near"))).otherwise(reach)
    steps = c.withColumn("reach", reach).where(F.col("reach") > 0).select(
        *group, name, "v", "near", "diff", F.explode(F.sequence(F.lit(1).cast("long"), F.col("reach").cast("long"))).alias("j"))
    more = F.col("diff") > 0
    steps = steps.withColumn("quotient", F.when(more, F.col("v") / (2 * (F.col("near") + F.col("j")) - 1))
                             .otherwise(-F.col("v") / (2 * (F.col("near") - F.col("j") + 1) - 1)))
    ranked = steps.withColumn("at", F.row_number().over(Window.partitionBy(*group).orderBy(F.col("quotient").desc(), F.col(name), "j")))
    moved = ranked.where(F.col("at") <= F.abs("diff")).groupBy(*group, name).agg(
        F.sum(F.when(more, 1).otherwise(-1)).alias("moved"))
    out = c.join(moved, [*group, name], "left")
    return out.withColumn("quota", F.col("near") + F.coalesce(F.col("moved"), F.lit(0))).drop("v", "all_v", "near", "diff", "n", "moved")


def mix(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
        block: int = BLOCK, shard_rows: int = SHARD, most: int = MOST, seed: int = SEED, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, size, source_size, target, taken for each row; with ``keep``, these columns of the row too."""
    docs = documents.select(
        F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).cast("string").alias("source"),
        F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        F.xxhash64(F.lit(seed), F.col(id_col).cast("long"), F.length(text_col), F.col(text_col)).alias("draw"),
        F.when(F.col(source_col).isNull(), "n").otherwise(F.concat(F.lit("v"), F.col(source_col))).alias("skey"),
        *[F.col(c).alias(f"kept_{c}") for c in keep])
    if not keep:
        docs = cut(docs)
    sources = docs.groupBy("skey", "source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_docs"))
    sources = targets(cut(sources), most)
    sources = sources.withColumn("one", F.lit(0)).withColumn(
        "blocks", F.floor(F.sum("source_size").over(Window.partitionBy("one")) / block))
    sources = sainte_lague(sources, ["one"], "skey", "target", "blocks")
    sources = cut(sources.select("skey", "source_size", "target", F.col("quota").alias("source_quota"),
                                 F.ceil(F.col("n_docs") / shard_rows).cast("long").alias("shards")))
    # a source may hold a third of all rows: its row is there once for each salt
    salted = sources.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    dealt = docs.withColumn("salt", F.pmod("draw", F.lit(SALTS).cast("long"))).join(salted, ["skey", "salt"]).withColumn("shard", F.pmod(F.xxhash64("draw", F.lit(1)), F.col("shards")))
    shards = dealt.groupBy("skey", "shard", "source_quota").agg(F.sum("size").alias("shard_size"))
    shards = sainte_lague(cut(shards), ["skey"], "shard", "shard_size", "source_quota")
    shards = cut(shards.select("skey", "shard", "shard_size",
                               F.least(F.col("quota") * block, F.col("shard_size") * most).alias("words")))
    placed = dealt.join(shards, ["skey", "shard"])
    upto = Window.partitionBy("skey", "shard").orderBy("draw", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum("size").over(upto), F.lit(0))
    rounds = F.when(F.col("shard_size") > 0, F.floor(F.col("words") / F.col("shard_size"))).otherwise(F.lit(0)).cast("long")
    placed = placed.withColumn("before", before).withColumn("rounds", rounds)
    part = F.greatest(F.lit(0), F.least(F.col("size"), F.col("words") - F.col("rounds") * F.col("shard_size") - F.col("before")))
    return placed.select("doc_id", "size", "source_size", "target",
                         (F.col("rounds") * F.col("size") + part).cast("long").alias("taken"),
                         *[F.col(f"kept_{c}").alias(c) for c in keep if c != "doc_id"])
