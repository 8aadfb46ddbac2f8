"""Mixing sources to target weights by Sainte-Lague apportionment, in DataFrame operations only.

Words stand for tokens. The words of a source are dealt to shards of bounded size; within a shard
the texts stand in a seeded order and their words form one stream, cut into blocks of block_words.
Seats (block takings) go to sources by the highest quotients target / (2k + 1), each source's seats
go to its shards the same way, and a shard takes every block seats // blocks times and the
seats % blocks blocks with the lowest seeded hash once more.

Highest quotients need no loop over seats. With N seats, S parties and shares p, the divisor that
gives N seats differs from total / N so little that a party's seats lie within S * p + 2 of its
exact share. All seats below that range are given, those in it are ranked by quotient.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import columns_of, fresh, stage_table

#: Words are runs of anything but these, as in every operator here.
WORD = r"[^\x20\x09-\x0D]+"
BLOCK_WORDS = 64
SHARD_WORDS = 1 << 20
SHARD_TEXTS = 1 << 16
#: Blocks are listed by tasks of so many shards; beyond so many tasks, by larger ones, which spill.
SHARDS_PER_TASK, MOST_PARTITIONS = 16, 20_000
#: A source's seats go to groups of so many shards first, so no window holds all shards of a source.
SHARD_GROUP = 4096
EPOCHS = 1.5
REPEATS = 2
WEIGHTS = (5.0, 2.0, 1.0)
SEED = 17


def source_targets(sources: DataFrame, share: float = EPOCHS, repeats: int = REPEATS) -> DataFrame:
    """Targets in proportion to weight, none above repeats * size, the excess shared anew.

    sources: source, source_size, weight, one row per source. The level at which weights are
    paid out follows in closed form: in order of cap / weight, the first sources are capped for as
    long as the level that the others then get is above their own cap. Weights must be positive.
    """
    cap = F.col("source_size") * F.lit(float(repeats))
    fill = Window.orderBy(F.col("ratio"), F.col("source").asc_nulls_last())
    everyone = Window.partitionBy()
    s = (
        sources.withColumn("cap", cap.cast("double"))
        .withColumn("ratio", F.col("cap") / F.col("weight"))
        .withColumn("total", F.sum("source_size").over(everyone) * F.lit(float(share)))
        .withColumn("caps_before", F.coalesce(F.sum("cap").over(fill.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
        .withColumn("weights_left", F.sum("weight").over(fill.rowsBetween(0, Window.unboundedFollowing)))
        .withColumn("level", (F.col("total") - F.col("caps_before")) / F.col("weights_left"))
        # The first source, in this order, whose cap is not exceeded fixes the level of all after it.
        .withColumn("nth", F.row_number().over(fill))
        .withColumn("open_level", F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("nth", "level"))).over(everyone))
    )
    paid = F.col("weight") * F.col("open_level.level")
    return s.withColumn("target", F.when(F.col("open_level").isNull(), F.col("cap")).otherwise(F.least(F.col("cap"), paid))).select("source", "source_size", "weight", "target")


def highest_quotients(parties: DataFrame, group: list[str], party: list[str], votes: Column, seats: Column, cap: Column) -> DataFrame:
    """parties with a column seats_won: Sainte-Lague seats within each group, at most cap a party.

    Groups keep one row for each party; ties go to the smaller party key. Caps are meant for rounding
    at a party's end: seats that a cap far below a party's share leaves over go to no other.
    """
    g = Window.partitionBy(*group)
    p = (
        parties.withColumn("_v", votes.cast("double"))
        .withColumn("_n", seats.cast("long"))
        .withColumn("_cap", cap.cast("long"))
        .withColumn("_all", F.sum("_v").over(g))
        .withColumn("_parties", F.count(F.lit(1)).over(g))
        .withColumn("_exact", F.when(F.col("_all") > 0, F.col("_v") / F.col("_all") * F.col("_n")).otherwise(F.lit(0.0)))
        .withColumn("_slack", F.when(F.col("_all") > 0, F.col("_v") / F.col("_all") * F.col("_parties")).otherwise(F.lit(0.0)) + F.lit(2.0))
        .withColumn("_lo", F.least(F.greatest(F.floor(F.col("_exact") - F.col("_slack")), F.lit(0)), F.col("_cap")).cast("long"))
        .withColumn("_hi", F.least(F.ceil(F.col("_exact") + F.col("_slack")) + 2, F.col("_cap")).cast("long"))
        .withColumn("_rest", F.col("_n") - F.sum("_lo").over(g))
    )
    ranked = (
        p.withColumn("_k", F.explode_outer(F.when(F.col("_hi") > F.col("_lo"), F.sequence(F.col("_lo"), F.col("_hi") - 1))))
        .withColumn("_quotient", F.col("_v") / (F.col("_k") * 2 + 1))
        .withColumn("_rank", F.row_number().over(g.orderBy(F.col("_quotient").desc_nulls_last(), *[F.col(c).asc_nulls_last() for c in party], F.col("_k"))))
        .withColumn("_won", ((F.col("_rank") <= F.col("_rest")) & F.col("_k").isNotNull() & (F.col("_v") > 0)).cast("long"))
    )
    keep = parties.columns
    return ranked.groupBy(*keep).agg((F.first("_lo") + F.sum("_won")).alias("seats_won"))


def _seeded(seed: int, *cols: Column) -> Column:
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[c.cast("string") for c in cols]).cast("binary"))


def default_weights(sources: DataFrame, weights: tuple[float, ...] = WEIGHTS) -> DataFrame:
    """sources with a weight each: the given weights in turn, sources by code point, null last."""
    n = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    table = F.array(*[F.lit(float(w)) for w in weights])
    return sources.withColumn("weight", F.element_at(table, (n % len(weights) + 1).cast("int")))


def _placed(docs: DataFrame, weights: tuple[float, ...], share: float, repeats: int, block_words: int, shard_words: int, shard_texts: int, seed: int) -> tuple[DataFrame, DataFrame]:
    """Texts with their place in their shard (start, end) and how often each block they reach is taken; and texts without words."""
    key = F.substring(F.md5(F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary")), 1, 16)
    sized = docs.select("doc_id", "source", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"), key.alias("text_key"))
    # Equal rows travel as one with their number, so a row that repeats without end is never in one place.
    sized = stage_table(sized.groupBy("doc_id", "source", "size", "text_key").agg(F.count(F.lit(1)).alias("copies")), "mix-sizes")
    per_source = sized.groupBy("source").agg(F.sum(F.col("size") * F.col("copies")).alias("source_size"), F.sum("copies").alias("texts"))
    targets = source_targets(default_weights(per_source, weights), share, repeats)
    plan = targets.join(per_source.select(F.col("source").alias("_s"), "texts"), F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
    plan = plan.withColumn("total_seats", F.round(F.sum("target").over(Window.partitionBy()) / block_words).cast("long"))
    plan = plan.withColumn("shards", F.greatest(F.lit(1), F.ceil(F.col("source_size") / F.lit(float(shard_words))), F.ceil(F.col("texts") / F.lit(float(shard_texts)))).cast("long"))
    plan = highest_quotients(plan, [], ["source"], F.col("target"), F.col("total_seats"), F.ceil(F.col("source_size") / F.lit(float(block_words))) * repeats + F.col("shards") * repeats).withColumnRenamed("seats_won", "source_seats")
    # One row a source, kept small by the number of sources, not of texts. Spark picks the join.
    plan = stage_table(plan.select("source", "source_size", "target", "shards", "source_seats"), "mix-plan")

    dealt = sized.join(plan.withColumnRenamed("source", "_s"), F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
    # Copies are dealt in parts that fill a shard at most; part and copy tell them apart.
    together = F.greatest(F.lit(1), F.least(F.lit(shard_texts), F.floor(F.lit(shard_words) / F.greatest(F.col("size"), F.lit(1))))).cast("long")
    dealt = dealt.withColumn("together", together).withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("copies") - 1) / F.col("together")))))
    dealt = dealt.withColumn("shard", F.pmod(F.conv(F.substring(_seeded(seed, F.coalesce(F.col("doc_id"), F.lit(-1)), F.col("text_key"), F.col("part")), 1, 8), 16, 10).cast("long"), F.col("shards")))
    dealt = dealt.withColumn("copy", F.explode(F.sequence(F.col("part") * F.col("together"), F.least("copies", (F.col("part") + 1) * F.col("together")) - 1)))
    # A null source is a group of its own in keys: (missing, '') differs from (given, '').
    key = [F.col("source").isNull().alias("no_source"), F.coalesce("source", F.lit("")).alias("source_key")]
    dealt = stage_table(dealt.select("doc_id", "source", "size", "source_size", "target", "source_seats", "text_key", "copy", "shard", *key), "mix-dealt")
    full = dealt.filter(F.col("size") > 0)
    shards = full.groupBy("no_source", "source_key", "shard").agg(F.sum("size").alias("shard_size"), F.first("source_seats").alias("source_seats"))
    shards = shards.withColumn("blocks", F.ceil(F.col("shard_size") / F.lit(float(block_words))).cast("long")).withColumn("shard_group", F.floor(F.col("shard") / SHARD_GROUP))
    of_source, of_group = ["no_source", "source_key"], ["no_source", "source_key", "shard_group"]
    groups = shards.groupBy(*of_group).agg(F.sum("shard_size").alias("group_size"), F.first("source_seats").alias("source_seats"), F.sum("blocks").alias("group_blocks"))
    groups = highest_quotients(groups, of_source, ["shard_group"], F.col("group_size"), F.col("source_seats"), F.col("group_blocks") * repeats).select(*of_group, F.col("seats_won").alias("group_seats"))
    shards = highest_quotients(shards.drop("source_seats").join(groups, of_group), of_group, ["shard"], F.col("shard_size"), F.col("group_seats"), F.col("blocks") * repeats)
    in_shard = ["no_source", "source_key", "shard"]
    shards = stage_table(shards.select(*in_shard, "blocks", "seats_won"), "mix-shards")
    # A few rows become all blocks: without a count of partitions, Spark would put them in one task.
    n_shards = plan.agg(F.sum("shards").alias("n")).first()["n"] or 0
    shards = shards.repartition(min(max(n_shards // SHARDS_PER_TASK, 1), MOST_PARTITIONS), *in_shard)
    blocks = shards.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block"))
    luck = Window.partitionBy(*in_shard).orderBy(_seeded(seed, F.col("source_key"), F.col("shard"), F.col("block")), "block")
    rounds = F.floor(F.col("seats_won") / F.col("blocks"))
    times = rounds + (F.row_number().over(luck) <= F.col("seats_won") - rounds * F.col("blocks")).cast("long")
    # A shard's blocks are a row: an array of how often each is taken, of which a text needs a slice.
    listed = F.array_sort(F.collect_list(F.struct(F.col("block").cast("int").alias("block"), F.col("times").cast("short").alias("times"))))
    taken = blocks.withColumn("times", times).groupBy(*in_shard).agg(F.transform(listed, lambda b: b["times"]).alias("times"))

    order = Window.partitionBy(*in_shard).orderBy(_seeded(seed + 1, F.coalesce(F.col("doc_id"), F.lit(-1))), F.col("doc_id"), "text_key", "copy")
    placed = full.withColumn("end", F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, 0))).withColumn("nth", F.row_number().over(order)).withColumn("start", F.col("end") - F.col("size"))
    placed = placed.withColumn("first", F.floor(F.col("start") / block_words)).withColumn("last", F.floor((F.col("end") - 1) / block_words))
    # Arrays grow with the words, and there are as many as shards: no broadcast.
    placed = placed.join(taken.hint("merge"), in_shard).withColumn("times", F.slice("times", (F.col("first") + 1).cast("int"), (F.col("last") - F.col("first") + 1).cast("int")))
    return placed, dealt.filter(F.col("size") == 0)


def mix_sources(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = EPOCHS, repeats: int = REPEATS, block_words: int = BLOCK_WORDS, shard_words: int = SHARD_WORDS, shard_texts: int = SHARD_TEXTS, seed: int = SEED) -> DataFrame:
    """One row per row of docs: doc_id, source, size, source_size, target, taken.

    docs: doc_id, text, source; more columns are ignored. A null or empty text has size 0 and is
    taken 0 times; a null source is a source of its own, after all others; rows that repeat a
    doc_id, or have none, are texts of their own (their shard and their order in it follow from
    id and text, and equal rows are interchangeable). An empty table gives no rows. Texts are read
    once: their ids, sources, sizes and hashes are staged in the shared folder, equal rows as one.
    No task ever holds a source, only a shard of about shard_words words or shard_texts texts, or
    the figures of SHARD_GROUP shards, so a hot source is spread over as many tasks as it has
    shards; the windows over sources hold one row a source.
    """
    placed, empty = _placed(docs, weights, share, repeats, block_words, shard_words, shard_texts, seed)
    # Whole blocks, less what of the first and the last lies outside the text.
    whole = F.aggregate("times", F.lit(0).cast("long"), lambda a, t: a + t) * block_words
    outside = F.element_at("times", 1) * (F.col("start") - F.col("first") * block_words) + F.element_at("times", -1) * ((F.col("last") + 1) * block_words - F.col("end"))
    cols = ["doc_id", "source", "size", "source_size", "target", "taken"]
    return placed.withColumn("taken", (whole - outside).cast("long")).select(*cols).unionByName(empty.withColumn("taken", F.lit(0).cast("long")).select(*cols))


def mixed_documents(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = EPOCHS, repeats: int = REPEATS, block_words: int = BLOCK_WORDS, shard_words: int = SHARD_WORDS, shard_texts: int = SHARD_TEXTS, seed: int = SEED) -> DataFrame:
    """The mix itself, with the columns of docs: a row for each round in which a text is taken.

    A row's text holds the taken blocks' words in order, with the white space before each; a text
    taken whole is kept as it is. n_chars, if docs has it, follows the new text. Texts without
    words are in no mix. Rows with equal doc_id and text share one selection, rows without a doc_id
    as well. Any other columns may be among docs', and they stay as they are.
    """
    placed, _ = _placed(docs, weights, share, repeats, block_words, shard_words, shard_texts, seed)
    id_, key_, parts_, round_, mine_, words_ = fresh(docs, "mix_id", "mix_key", "mix_parts", "mix_round", "mix_mine", "mix_words")

    def part(times: Column, nth: Column) -> Column:
        lo = (F.col("first") + nth) * block_words
        at = F.greatest(lo, F.col("start"))
        return F.struct((at - F.col("start")).cast("int").alias("at"), (F.least(lo + block_words, F.col("end")) - at).cast("int").alias("n"), times.cast("int").alias("times"))

    parts = F.filter(F.transform("times", part), lambda p: p["times"] > 0)
    lists = placed.select("doc_id", "text_key", "source_key", "shard", "nth", parts.alias("parts")).filter(F.size("parts") > 0)
    lists = lists.groupBy(F.col("doc_id").alias(id_), F.col("text_key").alias(key_)).agg(F.min_by("parts", F.struct("source_key", "shard", "nth")).alias(parts_))
    text_key = F.substring(F.md5(F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary")), 1, 16)
    joined = docs.join(lists.hint("merge"), F.col("doc_id").eqNullSafe(F.col(id_)) & (text_key == F.col(key_)))
    rounds = joined.withColumn(round_, F.explode(F.sequence(F.lit(1), F.array_max(F.transform(parts_, lambda p: p["times"])))))
    rounds = rounds.withColumn(mine_, F.array_sort(F.filter(parts_, lambda p: p["times"] >= F.col(round_))))
    words = F.regexp_extract_all("text", F.lit(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+"), F.lit(0))
    rounds = rounds.withColumn(words_, words)
    taken = F.array_join(F.transform(mine_, lambda p: F.array_join(F.slice(words_, p["at"] + 1, p["n"]), "")), "")
    whole = F.aggregate(mine_, F.lit(0), lambda a, p: a + p["n"]) == F.size(words_)
    out = rounds.withColumn("text", F.when(whole, F.col("text")).otherwise(F.regexp_replace(taken, r"^[\x20\x09-\x0D]+", "")))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*columns_of(docs))
