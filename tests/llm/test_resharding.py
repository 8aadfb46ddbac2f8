"""op13: the flow against enumeration, the query's law, and stores of files before and after."""

import collections
import itertools
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tests.llm.test_llm import SCHEMA, TEXTS
from tideline.llm import resharding as rs
from tideline.llm.queries import QUERIES

SF = "/root/testdata/sf0.01"


def least_cost(supply, capacity, cost):
    """The least cost of all whole-number flows, by going through them."""
    if not supply:
        return 0
    best = None
    for split in itertools.product(*(range(min(supply[0], c) + 1) for c in capacity)):
        if sum(split) == supply[0]:
            rest = least_cost(supply[1:], [c - s for c, s in zip(capacity, split, strict=True)], cost[1:])
            if rest is not None:
                mine = rest + sum(s * k for s, k in zip(split, cost[0], strict=True))
                best = mine if best is None else min(best, mine)
    return best


@settings(max_examples=60, deadline=None)
@given(st.data())
def test_flow_costs_least(data):
    n, m = data.draw(st.integers(1, 3)), data.draw(st.integers(1, 3))
    supply, capacity = data.draw(st.lists(st.integers(0, 4), min_size=n, max_size=n)), data.draw(st.lists(st.integers(0, 6), min_size=m, max_size=m))
    cost = np.array(data.draw(st.lists(st.lists(st.integers(0, 5), min_size=m, max_size=m), min_size=n, max_size=n)), float)
    if sum(supply) > sum(capacity):
        with pytest.raises(ValueError, match="don't hold"):
            rs.min_cost_flow(supply, capacity, cost)
        return
    flow = rs.min_cost_flow(supply, capacity, cost)
    assert (flow >= 0).all() and flow.sum(axis=1).tolist() == supply and (flow.sum(axis=0) <= capacity).all()
    assert (flow * cost).sum() == least_cost(supply, capacity, cost.tolist())


def test_flow_moves_only_what_exceeds():
    rng = np.random.default_rng(4)
    for _ in range(20):
        supply = [int(x) for x in rng.integers(0, 1 << 50, 12)]
        capacity = rs.equal_capacities(sum(supply), 16)
        flow = rs.min_cost_flow(supply, capacity)
        moved = sum(supply) - sum(flow[i, i] for i in range(12))
        assert moved == sum(max(0, s - c) for s, c in zip(supply, capacity, strict=False))
        assert flow.sum(axis=0).tolist() == capacity and (flow > 0).sum() <= 12 + 16


def check_law(got, rows, old_shards=12, shards=16):
    size = [len((t or "").encode()) + 1 for _, t in rows]
    assert collections.Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == collections.Counter((d, s, zlib.crc32((t or "").encode())) for (d, t), s in zip(rows, size, strict=True))
    by = collections.defaultdict(list)
    for r in got:
        by[r["shard"]].append(r)
        assert r["law"] == "bytes" and r["grown_shard"] is None
    assert all(0 <= s < shards for s in by) and all(sorted(r["slot"] for r in v) == list(range(len(v))) for v in by.values())
    total, moved = sum(size), sum(r["size"] for r in got if r["shard"] != r["old_shard"])
    old = collections.Counter()
    for r in got:
        old[r["old_shard"]] += r["size"]
        assert r["old_shard"] == zlib.crc32(str(r["doc_id"] if r["doc_id"] is not None else r["text_crc32"]).encode()) % old_shards
    return {s: sum(r["size"] for r in v) for s, v in by.items()}, total / shards, moved, sum(max(0, b - c) for b, c in zip([old[i] for i in range(old_shards)], rs.equal_capacities(total, shards), strict=False))


@pytest.mark.parametrize("block", [1 << 12, 64 << 20])
def test_query_on_all_documents(spark, block):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    sizes, mean, moved, least = check_law(rs.sharding_query(docs, block_bytes=block).collect(), rows)
    assert len(sizes) == 16 and max(abs(b - mean) for b in sizes.values()) < 0.02 * mean
    assert abs(moved - least) < 0.01 * mean * 16
    if block == 64 << 20:
        again = rs.sharding_query(docs.repartition(7)).collect()
        assert sorted(map(tuple, again)) == sorted(map(tuple, QUERIES["op13_resharding"](spark, SF).collect()))


def test_odd_rows(spark, monkeypatch):
    rows = list(enumerate(TEXTS)) + [(6, TEXTS[6])] * 500 + [(None, "nobody's text")] * 700 + [(None, None)] * 40 + [(k, "the same text") for k in range(3000)]
    docs = spark.createDataFrame([(i, t, "en", "s", None, "clash", "clash") for i, t in rows], SCHEMA).repartition(3)
    monkeypatch.setattr(rs, "COPIES", 64)
    sizes, mean, _, _ = check_law(rs.sharding_query(docs).collect(), rows)
    big = max(len((t or "").encode()) + 1 for _, t in rows)
    assert len(sizes) == 16 and max(abs(b - mean) for b in sizes.values()) <= big
    assert rs.sharding_query(spark.createDataFrame([], SCHEMA)).collect() == []


def files_of(path):
    return {str(f.relative_to(path)): f.read_bytes() for f in path.glob("data/of=0/to_shard=*/block=*/*.parquet")}


def test_store_keeps_rows_and_whole_files(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet").unionByName(spark.createDataFrame([(None, None, None, None, None), (None, "a" * 50, "en", "s", 1), (None, "a" * 50, "en", "s", 1)], "doc_id long, text string, lang string, source string, n_chars long")).withColumn("odd `name", F.lit(1))
    path = str(tmp_path / "store")
    rs.write_store(docs, path, F.coalesce(F.pmod(F.col("doc_id"), F.lit(5)), F.lit(4)), block_bytes=1 << 16)
    columns = docs.columns
    first = sorted(map(str, rs.read_store(spark, path).select(*[F.col(rs.quoted(c)) for c in columns]).collect()))
    assert first == sorted(map(str, docs.collect()))
    before, old = files_of(tmp_path / "store"), {r["shard"]: r["bytes"] for r in rs.store_listing(spark, path).groupBy("shard").agg(F.sum("bytes").alias("bytes")).collect()}
    total = sum(old.values())
    capacities = rs.equal_capacities(total, 8)
    flow = rs.reshard_store(spark, path, capacities)
    assert files_of(tmp_path / "store") == before
    listing = rs.store_listing(spark, path).collect()
    kept = sum(r["bytes"] for r in listing if r["since"] == 0)
    assert kept > 0.5 * total and sum(r["bytes"] for r in listing) == total
    moved = total - sum(flow[i, i] for i in range(5))
    assert moved == sum(max(0, old[i] - capacities[i]) for i in range(5))
    assert sorted(map(str, rs.read_store(spark, path).select(*[F.col(rs.quoted(c)) for c in columns]).collect())) == first
    sizes = collections.Counter()
    for r in listing:
        sizes[r["shard"]] += r["bytes"]
    assert sorted(sizes) == list(range(8)) and max(abs(b - total / 8) for b in sizes.values()) < 0.03 * total / 8
    # And back to fewer shards: those that go away have no room.
    rs.reshard_store(spark, path, [total, total, 0])
    assert {r["shard"] for r in rs.store_listing(spark, path).collect()} <= {0, 1}
    assert sorted(map(str, rs.read_store(spark, path).select(*[F.col(rs.quoted(c)) for c in columns]).collect())) == first
