"""Resharding by minimum-cost flow: what each old shard sends to each new one so that the fewest bytes move.

Old shards supply their bytes, new ones take up to their capacity, and a byte that changes its shard
costs. The flow over shards, a small table whatever the rows, is solved by successive shortest paths.
Each old shard's rows stand in a fixed order of blocks, large rows first; the flow cuts this order into
runs, one for each shard it goes to, the shard's own first. So large rows stay, a run is whole blocks
but for the two that are cut, and a cut falls between two small rows.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import fresh, quoted, stage_table

#: Blocks have about so many bytes and rows; equal rows are handled so many at a time.
BLOCK_BYTES, BLOCK_ROWS, COPIES = 64 << 20, 1 << 18, 4096


def min_cost_flow(supply: list[int], capacity: list[int], cost: np.ndarray | None = None) -> np.ndarray:
    """flow[i, j], whole bytes from old shard i to new shard j, of the least total cost.

    cost: of a byte from i to j; by default 0 where i is j and 1 elsewhere. All supplies must fit into
    the capacities. Successive shortest paths from all shards that still have bytes, with potentials that
    keep reduced costs from going below 0; each path uses up a supply, a capacity or a flow.
    """
    n, m = len(supply), len(capacity)
    if sum(supply) > sum(capacity):
        raise ValueError("the new shards don't hold what the old ones have")
    c = np.asarray(cost, float) if cost is not None else 1.0 - np.eye(n, m)
    left, room, flow = np.array(supply, dtype=object), np.array(capacity, dtype=object), np.zeros((n, m), dtype=object)
    u, v = np.zeros(n), c.min(axis=0) if n else np.zeros(m)  # distances so far; 0 for shards that still have bytes
    while (left > 0).any():
        far = np.concatenate([np.where(left > 0, 0.0, np.inf), np.full(m, np.inf)])
        back, done = np.full(n + m, -1), np.zeros(n + m, bool)
        for _ in range(n + m):
            k = int(np.where(done, np.inf, far).argmin())
            if done[k] or np.isinf(far[k]):
                break
            done[k] = True
            if k < n:
                reach, side = far[k] + np.maximum(c[k] + u[k] - v, 0.0), slice(n, n + m)
                closer = ~done[side] & (reach < far[side])
            else:
                reach, side = far[k] + np.maximum(v[k - n] - u - c[:, k - n], 0.0), slice(0, n)
                closer = ~done[side] & (reach < far[side]) & (flow[:, k - n] > 0)
            far[side] = np.where(closer, reach, far[side])
            back[side] = np.where(closer, k, back[side])
        far = np.where(np.isinf(far), 0.0, far)
        u, v = u + far[:n], v + far[n:]
        target = n + int(np.where(room > 0, v, np.inf).argmin())
        path = [target]
        while back[path[-1]] >= 0:
            path.append(int(back[path[-1]]))
        steps = list(zip(path[1:], path[:-1], strict=True))
        amount = min([left[path[-1]], room[target - n], *(flow[b, a - n] for a, b in steps if a >= n)])
        for a, b in steps:
            if a < n:
                flow[a, b - n] += amount
            else:
                flow[b, a - n] -= amount
        left[path[-1]] -= amount
        room[target - n] -= amount
    return flow


def equal_capacities(total: int, shards: int) -> list[int]:
    """Shards of equal bytes, the first ones a byte larger where they don't come out even."""
    return [total // shards + (j < total % shards) for j in range(shards)]


def run_ends(spark: SparkSession, flow: np.ndarray) -> DataFrame:
    """_from, _ends, _to: where each old shard's runs end, in bytes, and where each goes; its own shard's comes first."""
    rows = []
    for i, row in enumerate(flow.tolist()):
        runs = sorted(((j != i, j, f) for j, f in enumerate(row) if f > 0))
        rows.append((i, np.cumsum([f for _, _, f in runs], dtype=object).tolist() if runs else [0], [j for _, j, _ in runs] or [i]))
    return spark.createDataFrame(rows, "_from int, _ends array<long>, _to array<int>")


def block_name(size: Column, block: Column) -> Column:
    """Sorts blocks of larger rows first."""
    return F.format_string("%02d-%07d", F.lit(63) - F.floor(F.log2(size)).cast("int"), block)


def with_blocks(rows: DataFrame, shard: str, size: str, copies: str, key: list[str], block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """rows with _block: rows of one power of two in size, dealt by a hash of the key into blocks of about block_bytes."""
    kind = F.floor(F.log2(size)).cast("int")
    kinds = rows.groupBy(F.col(shard).alias("_s"), kind.alias("_k")).agg(F.greatest(F.ceil(F.sum(F.col(size) * F.col(copies)) / block_bytes), F.ceil(F.sum(copies) / BLOCK_ROWS)).cast("int").alias("_blocks"))
    # At most 64 rows a shard.
    dealt = rows.withColumn("_kind", kind).join(F.broadcast(kinds), (F.col(shard) == F.col("_s")) & (F.col("_kind") == F.col("_k")))
    return dealt.withColumn("_block", block_name(F.col(size), F.pmod(F.xxhash64(*key), "_blocks").cast("int"))).drop("_s", "_k", "_kind", "_blocks")


def with_positions(rows: DataFrame, shard: str, size: str, copies: str, order: list[Column]) -> DataFrame:
    """rows with _pos and _row: bytes and rows before each in its shard, by block, then size, the largest first, then order.

    Sums run within a block, which is bounded, and over the blocks of a shard, a row each.
    """
    inside = Window.partitionBy(shard, "_block").orderBy(F.desc(size), *order).rowsBetween(Window.unboundedPreceding, -1)
    before = {"_pos": F.coalesce(F.sum(F.col(size) * F.col(copies)).over(inside), F.lit(0)), "_row": F.coalesce(F.sum(copies).over(inside), F.lit(0))}
    across = Window.partitionBy(shard).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    totals = rows.groupBy(shard, "_block").agg(F.sum(F.col(size) * F.col(copies)).alias("_bytes"), F.sum(copies).alias("_rows"))
    starts = totals.select(shard, "_block", F.coalesce(F.sum("_bytes").over(across), F.lit(0)).alias("_pos0"), F.coalesce(F.sum("_rows").over(across), F.lit(0)).alias("_row0"))
    placed = rows.withColumns(before).join(starts, [shard, "_block"])
    return placed.withColumns({"_pos": F.col("_pos") + F.col("_pos0"), "_row": F.col("_row") + F.col("_row0")}).drop("_pos0", "_row0")


def destination(position: Column, size: Column) -> Column:
    """The shard of the run that holds the row's middle byte; needs _ends and _to."""
    passed = F.size(F.filter("_ends", lambda e: e * 2 <= position * 2 + size))
    return F.element_at("_to", F.least(passed + 1, F.size("_to")))


def sharding_query(docs: DataFrame, old_shards: int = 12, shards: int = 16, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """What op13 returns, from an old layout of old_shards by a checksum of doc_id to shards of equal bytes.

    doc_id, size, text_crc32, law, shard, slot, grown_shard, and old_shard, from which each row comes. Sizes
    of shards differ from equal ones by at most half a row for each run that is cut to or from them. A null
    text has size 1 and the checksum of an empty one; a row without doc_id is dealt by its text's checksum.
    Repeated rows are counted first and told apart at the end, so a row repeated any number of times is no
    group in one task. Other columns are ignored; an empty table gives no rows. Row numbers and shards
    depend on the rows alone, not on partitions.
    """
    spark = docs.sparkSession
    text = F.encode(F.coalesce(F.col("text").cast("string"), F.lit("")), "UTF-8")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))
    counted = rows.groupBy("doc_id", "size", "text_crc32").agg(F.count(F.lit(1)).alias("_n"))
    old = F.pmod(F.crc32(F.coalesce("doc_id", "text_crc32").cast("string").cast("binary")), F.lit(old_shards)).cast("int")
    parts = counted.withColumn("old_shard", old).withColumn("_part", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("_n") - 1) / COPIES))))
    parts = stage_table(parts.withColumn("_n", F.least(F.lit(COPIES), F.col("_n") - F.col("_part") * COPIES)), "reshard-rows")
    sizes = {r["old_shard"]: r["bytes"] for r in parts.groupBy("old_shard").agg(F.sum(F.col("size") * F.col("_n")).alias("bytes")).collect()}
    supply = [sizes.get(i, 0) for i in range(old_shards)]
    flow = min_cost_flow(supply, equal_capacities(sum(supply), shards))
    key = ["doc_id", "text_crc32", "_part"]
    placed = with_positions(with_blocks(parts, "old_shard", "size", "_n", key, block_bytes), "old_shard", "size", "_n", [F.col(c) for c in key])
    sent = placed.join(F.broadcast(run_ends(spark, flow)), F.col("old_shard") == F.col("_from"))
    sent = sent.withColumn("_copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_n") - 1)))
    sent = sent.withColumn("shard", destination(F.col("_pos") + F.col("_copy") * F.col("size"), F.col("size"))).withColumn("_row", F.col("_row") + F.col("_copy"))
    sent = stage_table(sent.select("doc_id", "size", "text_crc32", "old_shard", "shard", "_row"), "reshard-sent")
    # A run is consecutive rows of its old shard, so a slot is a run's first slot and a difference of row numbers. A row for each run.
    runs = sent.groupBy("shard", "old_shard").agg(F.count(F.lit(1)).alias("_rows"), F.min("_row").alias("_first"))
    base = F.coalesce(F.sum("_rows").over(Window.partitionBy("shard").orderBy("old_shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    out = sent.join(F.broadcast(runs.select("shard", "old_shard", (base - F.col("_first")).alias("_shift"))), ["shard", "old_shard"])
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("_row") + F.col("_shift")).alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "old_shard")


# ---- a store of sharded files --------------------------------------------------------------


def text_bytes() -> Column:
    return (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long")


def write_store(docs: DataFrame, path: str, shard: Column, block_bytes: int = BLOCK_BYTES) -> None:
    """Write docs (doc_id, text and any other columns) as files of path/data, by shard and block, and path/listing/of=0, which tells what belongs to the store."""
    names = fresh(docs, "_shard", "_size", "_n")
    rows = docs.withColumns({names[0]: shard.cast("int"), names[1]: text_bytes(), names[2]: F.lit(1)})
    rows = with_blocks(rows, *names, key=["doc_id", "text"], block_bytes=block_bytes).drop(names[2])
    _write(rows, path, 0, names[0], names[1], None)


def _write(rows: DataFrame, path: str, of: int, shard: str, size: str, kept: DataFrame | None) -> None:
    """Files for rows by shard and _block, then the listing of these and of the kept ones."""
    folders = rows.withColumnsRenamed({shard: "to_shard", "_block": "block", size: "stored_bytes"})
    folders.repartition("to_shard", "block").write.partitionBy("to_shard", "block").parquet(f"{path}/data/of={of}")
    written = rows.sparkSession.read.parquet(f"{path}/data/of={of}").groupBy(F.col("to_shard").cast("int").alias("shard"), F.col("block").cast("string").alias("block")).agg(F.sum("stored_bytes").alias("bytes"), F.count(F.lit(1)).alias("rows"))
    listing = written.withColumn("since", F.lit(of))
    (listing.unionByName(kept) if kept is not None else listing).write.parquet(f"{path}/listing/of={of}")


def store_listing(spark: SparkSession, path: str) -> DataFrame:
    """shard, block, bytes, rows, since (the writing in whose folder its files are): a row a block."""
    every = spark.read.parquet(f"{path}/listing")
    return every.join(F.broadcast(every.agg(F.max("of").alias("of"))), "of").drop("of")


def read_store(spark: SparkSession, path: str, blocks: DataFrame | None = None) -> DataFrame:
    """The store's rows with shard, block and since; of these blocks only, if given. Folders that aren't listed aren't read."""
    data = spark.read.option("mergeSchema", False).parquet(f"{path}/data").withColumnsRenamed({"to_shard": "shard", "of": "since"}).withColumn("block", F.col("block").cast("string"))
    listed = (store_listing(spark, path) if blocks is None else blocks).select("shard", "block", "since")
    return data.join(listed, ["shard", "block", "since"], "left_semi")


def reshard_store(spark: SparkSession, path: str, capacities: list[int], cost: np.ndarray | None = None) -> np.ndarray:
    """Move the store into shards of these capacities with the fewest bytes moved; the flow that was solved.

    Blocks that stay whole keep their files. Rows of the others are read, sent to their shards and written
    anew, and a new listing is written last: until then readers see the old store, after a failure too.
    Folders that no listing names can be removed once no reader is left.
    """
    listing = stage_table(store_listing(spark, path), "store-listing")
    found = {r["shard"]: (r["bytes"], r["of"]) for r in listing.groupBy("shard").agg(F.sum("bytes").alias("bytes"), F.max("since").alias("of")).collect()}
    last = spark.read.parquet(f"{path}/listing").agg(F.max("of")).first()[0]
    n = max([*found, -1]) + 1
    flow = min_cost_flow([found.get(i, (0, 0))[0] for i in range(n)], capacities, cost)
    ends = F.broadcast(run_ends(spark, flow))
    before = F.coalesce(F.sum("bytes").over(Window.partitionBy("shard").orderBy("block", "since").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = listing.withColumn("_pos0", before).join(ends, F.col("shard") == F.col("_from"))
    whole = (F.element_at("_to", 1) == F.col("shard")) & (F.col("_pos0") + F.col("bytes") <= F.element_at("_ends", 1))
    placed = stage_table(placed.withColumn("_stays", whole), "store-blocks")
    moving = placed.filter(~F.col("_stays")).select("shard", "block", "since", "_pos0", "_ends", "_to")
    rows = read_store(spark, path, moving).join(moving, ["shard", "block", "since"])
    columns = [c for c in rows.columns if c not in ("shard", "block", "since", "_pos0", "_ends", "_to", "stored_bytes")]
    inside = Window.partitionBy("shard", "block", "since").orderBy(F.desc("stored_bytes"), *[F.col(quoted(c)) for c in ("doc_id", "text")]).rowsBetween(Window.unboundedPreceding, -1)
    sent = rows.withColumn("_to_shard", destination(F.col("_pos0") + F.coalesce(F.sum("stored_bytes").over(inside), F.lit(0)), F.col("stored_bytes")))
    # Of one block and power of two; the old shard and writing keep the names of what comes together apart.
    sent = sent.withColumn("_block", F.format_string("%s-%d-%d", F.substring_index("block", "-", 2), F.col("shard"), F.col("since")))
    _write(sent.select(*[F.col(quoted(c)) for c in columns], "_to_shard", "_block", F.col("stored_bytes").alias("_size")), path, last + 1, "_to_shard", "_size", placed.filter("_stays").select("shard", "block", "bytes", "rows", "since"))
    return flow
