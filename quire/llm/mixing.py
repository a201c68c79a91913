"""Mixing sources to target weights by Sainte-Lague apportionment.

Words are dealt in blocks of equal size. Each source's target is a number of blocks; the blocks go to the
sources by the highest quotients target / (2s + 1), then from each source to its shards, and in each shard a seeded
permutation of the shard's blocks says which of them the quota takes. A quota above the number of blocks goes
round the shard again. Where there are more than 2 ** FAN_BITS sources, or shards of a source, the blocks go down a
tree of as many parties a node, so that no ranking sees more of them.

Defined cases: null text has size 0 and is never taken; null source is a source of its own, ranked last; rows
that repeat an id count as rows of their own; an empty table gives an empty result; other columns stay as they
are (`mixed_documents` carries them as one struct, so their names can't clash; `mix` gives its own columns only).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quire.llm.common import SPACE_WORD, stored, table

WEIGHTS = (5, 2, 1)
CAP = 3
BLOCK_WORDS = 32
SHARD_WORDS = 1 << 16
FAN_BITS = 8
#: Up to so many rows the table of sources (three numbers and a name each) is broadcast, else it is joined with salt.
BROADCAST_SOURCES = 20_000
SALTS = 64
#: A prime above any number of blocks in a shard: b -> b * STEP + start is a permutation of the blocks.
STEP = 1_000_000_007
RESULT = ("size", "source_size", "target", "taken")


def words_of(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(SPACE_WORD)), F.lit(0)).cast("long")


def running(rows: DataFrame, order: dict[str, Column], sums: dict[str, Column], label: str) -> DataFrame:
    """Adds for each name in sums the sum of its column over the rows before and at this one, in the given order (a total one).

    Rows are dealt by ranges of the order and written, the few ranges are summed up, and each range is summed within: no task
    sees more than one range, however many rows there are.
    """
    keyed = rows.withColumns(order).repartitionByRange(*order).withColumn("range_", F.spark_partition_id())
    held = stored(keyed.withColumns({f"{name}_": c for name, c in sums.items()}), label)
    ranges = held.groupBy("range_").agg(*[F.sum(f"{name}_").alias(name) for name in sums])
    earlier = W.orderBy("range_").rowsBetween(W.unboundedPreceding, -1)
    starts = ranges.select("range_", *[F.coalesce(F.sum(name).over(earlier), F.lit(0)).alias(f"{name}_start_") for name in sums])
    within = W.partitionBy("range_").orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    # One row a range, so no more rows than the shuffle has partitions.
    summed = held.join(F.broadcast(starts), "range_").withColumns({name: F.col(f"{name}_start_") + F.sum(f"{name}_").over(within) for name in sums})
    return summed.drop("range_", *order, *[f"{name}{end}" for name in sums for end in ("_", "_start_")])


def source_targets(sized: DataFrame, weights=WEIGHTS, cap: int = CAP) -> DataFrame:
    """One row per source: source, source_id, source_size, target.

    Sorted by cap / weight, the level is (words left) / (weight left) at the first source that it does not fill. Names are ranked
    and words summed in that order by ranges, so sources may be as many as web hosts.
    """
    sums = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    named = running(sums, {"unnamed_": F.col("source").isNull(), "name_": F.col("source")}, {"source_id": F.lit(1).cast("long")}, "mix-names")
    ranked = named.withColumn(
        "weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(F.col("source_id") - 1, F.lit(len(weights))) + 1).cast("int"))
    ).withColumn("most", F.col("source_size") * F.lit(float(cap)))
    order = {"full_at": F.col("most") / F.col("weight"), "id_": F.col("source_id")}
    leveled = running(ranked, order, {"full": F.col("most"), "weighed": F.col("weight")}, "mix-levels")
    words, weight = leveled.agg(F.sum("source_size"), F.sum("weight")).first()
    level = (F.lit(words) - F.col("full") + F.col("most")) / (F.lit(weight) - F.col("weighed") + F.col("weight"))
    found = leveled.select("source_id", (F.col("most") / F.col("weight")).alias("full_at"), level.alias("level")).filter("level <= full_at")
    first = found.agg(F.min(F.struct("full_at", "source_id", "level"))).first()[0]
    target = F.least(F.col("most"), F.lit(first.level) * F.col("weight")) if first else F.col("most")
    return leveled.select("source", "source_id", "source_size", target.alias("target"))


def sainte_lague(parties: DataFrame, group: list[str], key: str) -> DataFrame:
    """Adds quota: the group's seats (column seats, alike in a group) go to its parties by highest votes / (2s + 1).

    With a divisor d each party has v / d - 1/2 <= s <= v / d + 1/2 seats, and the sum of v / d differs from the
    seats by n / 2 at most; so a party's seats lie within share * n / 2 + 1/2 of its exact claim. Only the quotients
    in that range are ranked, about 4 n of them, and those below it are won for certain.
    """
    whole = W.partitionBy(*group)
    p = (
        parties.withColumn("n_", F.count(F.lit(1)).over(whole))
        .withColumn("all_", F.sum("votes").over(whole))
        .withColumn("share_", F.when(F.col("all_") > 0, F.col("votes") / F.col("all_")).otherwise(F.lit(1.0) / F.col("n_")))
        .withColumn("claim_", F.col("share_") * F.col("seats"))
        .withColumn("slack_", F.col("share_") * F.col("n_") / 2 + 1.5)
        .withColumn("sure_", F.greatest(F.lit(0), F.floor(F.col("claim_") - F.col("slack_"))).cast("long"))
        .withColumn("rest_", F.col("seats") - F.sum("sure_").over(whole))
    )
    tried = p.withColumn("s_", F.explode(F.sequence(F.col("sure_"), F.ceil(F.col("claim_") + F.col("slack_")).cast("long"))))
    order = whole.orderBy((F.col("votes") / (2 * F.col("s_") + 1)).desc(), F.col(key), F.col("s_"))
    won = tried.withColumn("won_", (F.row_number().over(order) <= F.col("rest_")).cast("long"))
    return won.groupBy(*group, key).agg((F.first("sure_") + F.sum("won_")).alias("quota"))


def join_sources(rows: DataFrame, sources: DataFrame) -> DataFrame:
    """rows with their source's columns. The sources are broadcast if few, else each is repeated under SALTS keys, so that one hot source is not one task."""
    if sources.limit(BROADCAST_SOURCES + 1).count() <= BROADCAST_SOURCES:
        return rows.join(F.broadcast(sources.withColumnRenamed("source", "source_")), F.col("source").eqNullSafe(F.col("source_"))).drop("source_")
    salted = sources.withColumnRenamed("source", "source_").withColumn("salt_", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    mine = rows.withColumn("salt", F.pmod(F.hash("doc_id"), F.lit(SALTS)))
    return mine.join(salted, F.col("source").eqNullSafe(F.col("source_")) & (F.col("salt") == F.col("salt_"))).drop("source_", "salt", "salt_")


def descended(leaves: DataFrame, group: list[str], key: str, above: DataFrame) -> DataFrame:
    """The roots' seats (above: group, node = 0, quota) given down a tree to the leaves (group, key, votes): group, node = key, quota.

    Votes are summed as decimals, so that the sums don't depend on the order of rows.
    """
    most = leaves.agg(F.max(key)).first()[0] or 0
    levels = 1
    while most >> (FAN_BITS * levels):
        levels += 1
    for level in reversed(range(levels)):
        nodes = (
            leaves.withColumn("node", F.shiftright(key, FAN_BITS * level))
            .groupBy(*group, "node")
            .agg(F.sum(F.col("votes").cast("decimal(28,6)")).cast("double").alias("votes"))
            .withColumn("parent", F.shiftright("node", FAN_BITS))
        )
        given = above.select(*group, F.col("node").alias("parent"), F.col("quota").alias("seats"))
        above = sainte_lague(nodes.join(given, [*group, "parent"]), [*group, "parent"], "node")
    return above.select(*group, "node", "quota")


def shard_quotas(shards: DataFrame, sources: DataFrame, block_words: int) -> DataFrame:
    """(source_id, shard, votes) and sources with targets -> (source_id, node = shard, quota)."""
    votes = sources.select("source_id", F.col("target").alias("votes"))
    root = F.lit(0).cast("long").alias("node")
    words = F.coalesce(F.sum(F.col("votes").cast("decimal(28,6)")), F.lit(0)).cast("double")
    seats = stored(votes.agg(F.round(words / block_words).cast("long").alias("quota")).select(root, "quota"), "mix-seats")
    won = stored(descended(votes, [], "source_id", seats), "mix-quotas")
    return descended(shards, ["source_id"], "shard", won.select(F.col("node").alias("source_id"), root, "quota"))


def mix(
    rows: DataFrame,
    weights=WEIGHTS,
    cap: int = CAP,
    seed: int = 17,
    block_words: int = BLOCK_WORDS,
    shard_words: int = SHARD_WORDS,
) -> DataFrame:
    """rows(doc_id, source, size; row_ is kept if there) -> with source_size, target, taken, and where the words lie in the shard.

    first_block / start_, n_blocks, passes and extra say which words are taken: all of them `passes` times, and once
    more those of the blocks that `chosen` marks. Words of a shard lie in seeded order of its documents.
    """
    rows = rows.select("doc_id", "source", "size", *(["row_"] if "row_" in rows.columns else []))
    sources = stored(source_targets(rows.select("source", "size"), weights, cap), "mix-sources")
    dealt = (
        join_sources(rows, sources)
        .withColumn("n_shards", F.greatest(F.lit(1), F.ceil(F.col("source_size") / shard_words)).cast("long"))
        .withColumn("order_", F.xxhash64(F.col("doc_id"), F.lit(seed)))
        .withColumn("shard", F.pmod(F.xxhash64(F.col("order_"), F.lit(seed + 1)), F.col("n_shards")))
    )
    held = dealt.filter(F.col("size") > 0)
    shards = stored(held.groupBy("source_id", "shard").agg(F.sum("size").alias("votes")), "mix-shards")
    quotas = shard_quotas(shards, sources, block_words)
    info = shards.join(quotas.withColumnRenamed("node", "shard"), ["source_id", "shard"]).select(
        "source_id", "shard", F.ceil(F.col("votes") / block_words).cast("long").alias("n_blocks"), "quota"
    )
    line = W.partitionBy("source_id", "shard").orderBy("order_", "doc_id", "size")
    placed = held.withColumn("start_", F.sum("size").over(line.rowsBetween(W.unboundedPreceding, 0)) - F.col("size"))
    placed = (
        placed.join(info, ["source_id", "shard"])
        .withColumn("quota", F.least(F.col("quota"), F.col("n_blocks") * cap))
        .withColumn("passes", F.expr("quota div n_blocks"))
        .withColumn("extra", F.expr("quota % n_blocks"))
        .withColumn("shift_", F.pmod(F.xxhash64("source_id", "shard", F.lit(seed + 2)), F.col("n_blocks")))
    )
    span = lambda b: F.least(F.col("start_") + F.col("size"), (b + 1) * block_words) - F.greatest(F.col("start_"), b * block_words)
    blocks = F.sequence(F.expr(f"start_ div {block_words}"), F.expr(f"(start_ + size - 1) div {block_words}"))
    once = F.aggregate(blocks, F.lit(0).cast("long"), lambda acc, b: acc + F.when(chosen(b), span(b)).otherwise(F.lit(0)))
    taken = placed.withColumn("taken", F.col("passes") * F.col("size") + once)
    none = dealt.filter(F.col("size") <= 0).withColumn("taken", F.lit(0).cast("long"))
    return taken.unionByName(none, allowMissingColumns=True)


def chosen(block: Column) -> Column:
    """Whether the quota's last, partial pass takes this block of the shard."""
    return F.pmod(block * F.lit(STEP) + F.col("shift_"), F.col("n_blocks")) < F.col("extra")


def mixed_documents(docs: DataFrame, text: str = "text", block_words: int = BLOCK_WORDS, **options) -> DataFrame:
    """The mix itself: each document once per pass that takes words of it, with those words. Columns stay those of docs.

    A pass that takes all words keeps the text as it is; a partial one keeps the taken words, one space between. n_chars, if
    there, is counted anew.
    """
    rows = docs.select(F.struct(*[F.col(c) for c in docs.columns]).alias("row_"), "doc_id", "source", words_of(F.col(text)).alias("size"))
    held = mix(rows, block_words=block_words, **options).filter(F.col("taken") > 0)
    whole = F.col("row_")[text]
    partial = F.array_join(
        F.filter(F.regexp_extract_all(whole, F.lit(SPACE_WORD), F.lit(0)), lambda w, i: chosen(F.floor((F.col("start_") + i) / block_words))), " "
    )
    rest = F.col("taken") - F.col("passes") * F.col("size")
    last = F.when(rest == F.col("size"), whole).when(rest > 0, partial)
    texts = F.concat(F.array_repeat(whole, F.col("passes").cast("int")), F.when(rest > 0, F.array(last)).otherwise(F.expr("cast(array() as array<string>)")))
    out = held.withColumn("texts_", texts).withColumn("text_", F.explode("texts_"))
    new = {text: F.col("text_")} | ({"n_chars": F.char_length("text_").cast(docs.schema["n_chars"].dataType)} if "n_chars" in docs.columns else {})
    return out.select(*[new.get(c, F.col("row_")[c]).alias(c) for c in docs.columns])


def op9_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    rows = stored(docs.select("doc_id", "source", words_of(F.col("text")).alias("size")), "mix-sizes")
    return mix(rows).select("doc_id", *RESULT, "source_id", "shard", "quota", "n_blocks")
