"""Removal of long repeated byte strings from a corpus, by sharded run-length indexes.

A string of LONG bytes is removed where it also starts earlier. To compare like with like without
sorting the corpus, each window of LONG bytes is assigned to an anchor: the place of the smallest
hash among its GRAM-byte grams. Equal windows have equal anchors at equal offsets. Consecutive
windows with one anchor form a region, and regions are dealt to buckets by their anchor's hash.
- A region equal to an earlier one with that anchor is all repeats.
- First regions that share their anchor with a different one may still share windows. Only these
  go, as bytes, to shards by anchor; a run-length index of each shard, with the shard's regions
  streamed through it, finds the windows that occur earlier.
- An anchor with more than HOT_REGIONS such regions (a licence line in many texts) would make its
  shard grow with the corpus. The windows of its regions go to shards by their own hash instead,
  each group of texts sending the first of equal ones.
The marked ranges then meet the texts again. Both times texts travel in groups of bounded size.

A document is told by its doc_id and text together, so rows that share an id don't share marks.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import _U, SpanHasher, blob, bounded_batches, stage_table, text_chunks
from .run_index import RunIndex

LONG = 100
GRAM = 32
BUCKET_REGIONS = 1 << 20
FLUSH_REGIONS = 1 << 20
SHARD_BYTES = 1 << 20
GROUP_BYTES = 16 << 20
HOT_REGIONS = 1 << 14
#: A region in a bucket: what it hangs on, what it holds, where it is and how far it reaches.
#: (doc: its id, row: hash of id and text; both together tell a document.)
REGION = np.dtype([("anchor", "<u4"), ("held", "<u8"), ("doc", "<i8"), ("row", "<i8"), ("lo", "<u4"), ("back", "u1"), ("more", "u1")])
#: A region that must be looked at by bytes, and a marked range of bytes.
PLACE = np.dtype([("key", "<u8"), ("doc", "<i8"), ("row", "<i8"), ("lo", "<u4"), ("back", "u1"), ("more", "u1"), ("hot", "u1")])
WINDOW = np.dtype([("hash", "<u8"), ("doc", "<i8"), ("row", "<i8"), ("lo", "<u4")])
RANGE = np.dtype([("doc", "<i8"), ("row", "<i8"), ("lo", "<u4"), ("hi", "<u4")])
#: A missing doc_id counts as this one: it comes last.
NO_ID = np.iinfo(np.int64).max


def sliding_minimum(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each `width` values in a row, by minima from both ends of blocks of that width."""
    n = len(values)
    if n < width:
        return values[:0]
    blocks = -(-n // width)
    padded = np.full(blocks * width, np.iinfo(values.dtype).max, dtype=values.dtype)
    padded[:n] = values
    rows = padded.reshape(blocks, width)
    forward = np.minimum.accumulate(rows, axis=1).ravel()
    backward = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(backward[: n - width + 1], forward[width - 1 : n])


_PLACE_BITS = 26  # a chunk of texts, or one text, of up to 64 MB; longer texts are cut with an overlap


def regions_of(data: np.ndarray, offs: np.ndarray, long: int = LONG, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """Of texts joined in data: anchor hash, region hash, text, lo, anchor - lo and windows - 1, by region."""
    n = len(data)
    if n < long:
        empty = np.zeros(0, dtype=np.int64)
        return empty.astype(_U), empty.astype(_U), empty, empty, empty, empty
    hashes = SpanHasher(data)
    at = np.arange(n - gram + 1)
    grams = hashes(at, at + gram)
    mask = _U((1 << _PLACE_BITS) - 1)
    least = sliding_minimum((grams & ~mask) | at.astype(_U), long - gram + 1)
    anchor = (least & mask).astype(np.int64)
    text = np.repeat(np.arange(len(offs) - 1), np.diff(offs))[: n - long + 1]
    valid = np.arange(n - long + 1) + long <= offs[text + 1]
    starts = valid.copy()
    starts[1:] &= ~valid[:-1] | (anchor[1:] != anchor[:-1]) | (text[1:] != text[:-1])
    lo = np.flatnonzero(starts)
    ends = valid.copy()
    ends[:-1] &= ~valid[1:] | starts[1:]
    hi = np.flatnonzero(ends)
    a = anchor[lo]
    held = hashes(lo, hi + long) ^ ((a - lo).astype(_U) * _U(0x9FB21C651E98DF25))
    return grams[a], held, text[lo], lo - offs[text[lo]], a - lo, hi - lo


def _cut_texts(column: pa.Array, long: int) -> Iterator[tuple[np.ndarray, np.ndarray, int, int]]:
    """Chunks of texts for regions_of; a text beyond the place bits comes in pieces that overlap."""
    most = (1 << _PLACE_BITS) - 1
    for ch in text_chunks(column):
        if len(ch.data) <= most:
            yield ch.data, ch.offs, ch.lo, 0
        else:
            for at in range(0, len(ch.data) - long + 1, most - 2 * long):
                piece = ch.data[at : at + most]
                yield piece, np.array([0, len(piece)]), ch.lo, at


def _packed(kind: str, groups: np.ndarray, rows: np.ndarray) -> pa.RecordBatch:
    """One row of (group, packed) for each group among rows."""
    order = np.argsort(groups, kind="stable")
    groups, rows = groups[order], rows[order]
    cut = np.flatnonzero(np.concatenate(([True], groups[1:] != groups[:-1]))) if len(groups) else groups[:0]
    ends = np.append(cut[1:], len(groups))[: len(cut)]
    return pa.RecordBatch.from_arrays([pa.array(groups[cut], pa.int64()), pa.array([blob(rows[a:b]) for a, b in zip(cut, ends, strict=True)], pa.binary())], ["grp", kind])


def _unpacked(table: pa.Table, name: str, dtype: np.dtype) -> np.ndarray:
    parts = [np.frombuffer(x.as_py(), dtype=dtype) for x in table.column(name) if x.is_valid]
    return np.concatenate(parts) if parts else np.zeros(0, dtype=dtype)


def _distinct(rows: np.ndarray) -> np.ndarray:
    """The first of equal regions among sorted ones: copies of a row bring the same regions again."""
    keep = np.ones(len(rows), dtype=bool)
    if len(rows):
        keep[1:] = rows[1:] != rows[:-1]
    return keep


def _repeats(rows: np.ndarray, bucket: np.ndarray | None = None) -> np.ndarray:
    """Which sorted regions equal an earlier one: of a smaller id, or further ahead in the same document.

    Regions of other documents of the same id, and copies of the row itself, aren't earlier.
    """
    new = np.ones(len(rows), dtype=bool)
    new[1:] = (rows["anchor"][1:] != rows["anchor"][:-1]) | (rows["held"][1:] != rows["held"][:-1])
    if bucket is not None:
        new[1:] |= bucket[1:] != bucket[:-1]
    first = np.flatnonzero(new)[np.cumsum(new) - 1]
    own = np.zeros(len(rows), dtype=bool)
    own[1:] = ~new[1:] & (rows["doc"][1:] == rows["doc"][:-1]) & (rows["row"][1:] == rows["row"][:-1])
    start = np.maximum.accumulate(np.where(own, 0, np.arange(len(rows)))) if len(rows) else first
    return (rows["doc"] != rows["doc"][first]) | (rows["lo"] != rows["lo"][start])


def _region_blobs(docs: DataFrame, buckets: int, long: int, gram: int) -> DataFrame:
    """Regions packed by bucket. Regions that repeat within a task's buffer travel to buckets of
    their own (numbered from `buckets`), since they are settled: a text held by a third of all
    rows then costs its anchor's bucket one region a buffer."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[tuple[np.ndarray, np.ndarray]] = []
        held = 0

        def flush() -> pa.RecordBatch:
            bucket, rows = (np.concatenate(x) for x in zip(*kept, strict=True))
            kept.clear()
            order = np.lexsort((rows["lo"], rows["row"], rows["doc"], rows["held"], rows["anchor"], bucket))
            bucket, rows = bucket[order], rows[order]
            once = _distinct(rows)
            bucket, rows = bucket[once], rows[once]
            again = _repeats(rows, bucket)
            return _packed("regions", np.where(again, bucket + buckets, bucket), rows)

        for batch in batches:
            ids, row = np.asarray(batch.column(0).fill_null(NO_ID)), np.asarray(batch.column(2))
            for data, offs, first, at in _cut_texts(batch.column(1), long):
                anchor, region, text, lo, back, more = regions_of(data, offs, long, gram)
                rows = np.empty(len(lo), dtype=REGION)
                rows["anchor"], rows["held"], rows["doc"], rows["row"] = (anchor // _U(buckets)).astype(np.uint32), region, ids[first + text], row[first + text]
                rows["lo"], rows["back"], rows["more"] = lo + at, back, more
                kept.append(((anchor % _U(buckets)).astype(np.int64), rows))
                held += len(rows)
                if held >= FLUSH_REGIONS:
                    yield flush()
                    held = 0
        if held:
            yield flush()

    return _texts(docs).mapInArrow(run, "grp long, regions binary")


def _texts(docs: DataFrame) -> DataFrame:
    return bounded_batches(docs).selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text", "xxhash64(cast(doc_id as long), cast(text as string)) row")


def _merge(ranges: np.ndarray) -> np.ndarray:
    """Ranges by document, those that touch or overlap joined."""
    r = ranges[np.lexsort((ranges["lo"], ranges["row"], ranges["doc"]))]
    if not len(r):
        return r
    new = np.concatenate(([True], (r["doc"][1:] != r["doc"][:-1]) | (r["row"][1:] != r["row"][:-1])))
    # Within a doc, the furthest end so far: offset docs so that one running maximum serves all.
    nth = np.cumsum(new).astype(np.int64) << 33
    reach = np.maximum.accumulate(nth + r["hi"])
    new[1:] |= (nth[1:] + r["lo"][1:]) > reach[:-1]
    cut = np.flatnonzero(new)
    out = r[cut].copy()
    out["hi"] = (reach[np.append(cut[1:], len(r)) - 1] - nth[cut]).astype(np.uint32)
    return out


def settle_regions(regions: DataFrame, buckets: int, groups: int, shards: int | None = None, long: int = LONG) -> DataFrame:
    """grp, marks, places, n_hot: for each group of documents, ranges known to repeat, regions to look at, and how many of them are of hot anchors."""

    def run(table: pa.Table) -> pa.Table:
        bucket = int(table.column("grp")[0].as_py())
        rows = _unpacked(table, "regions", REGION)
        if bucket >= buckets:
            again = np.ones(len(rows), dtype=bool)
            open_ = hot = ~again
        else:
            rows = rows[np.lexsort((rows["lo"], rows["row"], rows["doc"], rows["held"], rows["anchor"]))]
            rows = rows[_distinct(rows)]
            again = _repeats(rows)
            a, h = rows["anchor"], rows["held"]
            new = np.ones(len(rows), dtype=bool)
            new[1:] = a[1:] != a[:-1]
            differs = ~new
            differs[1:] &= h[1:] != h[:-1]
            several = np.logical_or.reduceat(differs, np.flatnonzero(new)) if len(rows) else new
            nth = np.cumsum(new) - 1
            open_ = several[nth] & ~again
            hot = (np.bincount(nth[open_], minlength=len(several)) > HOT_REGIONS)[nth]
        marks = np.empty(int(again.sum()), dtype=RANGE)
        for c in ("doc", "row", "lo"):
            marks[c] = rows[c][again]
        marks["hi"] = rows["lo"][again] + rows["more"][again].astype(np.uint32) + np.uint32(long)
        marks = _merge(marks)
        places = np.empty(int(open_.sum()), dtype=PLACE)
        for c in ("doc", "row", "lo", "back", "more"):
            places[c] = rows[c][open_]
        places["hot"] = hot[open_]
        places["key"] = rows["anchor"][open_].astype(_U) * _U(buckets) + _U(bucket % buckets)
        out = [_packed("marks", np.mod(marks["row"], groups), marks), _packed("places", np.mod(places["row"], groups), places)]
        n_hot = pa.array([int(np.frombuffer(x.as_py(), dtype=PLACE)["hot"].sum()) for x in out[1].column(1)], pa.int64())
        full = [pa.table({"grp": b.column(0), "marks": b.column(1) if i == 0 else pa.nulls(b.num_rows, pa.binary()), "places": b.column(1) if i else pa.nulls(b.num_rows, pa.binary()), "n_hot": n_hot if i else pa.nulls(b.num_rows, pa.int64())}) for i, b in enumerate(out)]
        return pa.concat_tables(full)

    return regions.groupBy("grp").applyInArrow(run, "grp long, marks binary, places binary, n_hot long")


def _dealt(docs: DataFrame, groups: int, long: int) -> tuple[DataFrame, DataFrame, DataFrame | None]:
    """Texts of at least `long` bytes by group; one of each document; and the groups that take part of another's rows.

    A document's group follows from its row hash. Copies of one row (equal id, or none, and equal
    text) all have one hash: where they exceed GROUP_BYTES they are dealt to groups of their own,
    which get their marks from the group they come from.
    """
    texts = _texts(docs).filter(F.octet_length("text") >= long)
    grp = F.pmod("row", F.lit(groups)).cast("long")
    size = F.count(F.lit(1)) * F.max(F.octet_length("text"))
    hot = stage_table(texts.groupBy("doc_id", "row").agg(F.ceil(size / F.lit(float(GROUP_BYTES))).cast("long").alias("parts"), F.count(F.lit(1)).alias("n")).filter("parts > 1 and n > 1").drop("n"), "repeat-copies")
    if hot.isEmpty():
        texts = texts.withColumn("grp", grp)
        return texts, texts, None
    same = [F.col("doc_id").eqNullSafe(F.col("_d")), F.col("row") == F.col("_r")]
    hot = hot.withColumnsRenamed({"doc_id": "_d", "row": "_r"})
    parts = hot.select("_r", "parts", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part")).select(F.pmod("_r", F.lit(groups)).cast("long").alias("grp"), own_group("_r", "part", groups).alias("to"))
    mixed = texts.join(hot, same, "left").withColumn("part", F.floor(F.rand(17) * F.col("parts")))
    spread = mixed.withColumn("grp", F.when(F.col("parts").isNull(), grp).otherwise(own_group("row", "part", groups))).drop("_d", "_r", "parts", "part")
    once = mixed.filter("parts is not null").groupBy("doc_id", "row").agg(F.first("text").alias("text")).select("doc_id", "text", "row")
    one_each = mixed.filter("parts is null").select("doc_id", "text", "row").unionByName(once).withColumn("grp", grp)
    return spread, one_each, parts.distinct()


def own_group(row: str, part: str, groups: int):
    return F.lit(groups) + F.shiftrightunsigned(F.xxhash64(row, part), 2)


def _by_document(packed: np.ndarray) -> dict[tuple[int, int], np.ndarray]:
    """Places or ranges of each document, from an array sorted by document."""
    new = np.flatnonzero(np.concatenate(([True], (packed["doc"][1:] != packed["doc"][:-1]) | (packed["row"][1:] != packed["row"][:-1])))) if len(packed) else []
    ends = [*new[1:], len(packed)]
    return {(int(packed["doc"][a]), int(packed["row"][a])): packed[a:b] for a, b in zip(new, ends, strict=False)}


def _documents(texts: pa.Table) -> Iterator[tuple[int | None, tuple[int, int], pa.Scalar]]:
    for d, row, text in zip(texts.column("doc_id").to_pylist(), texts.column("row").to_pylist(), texts.column("text"), strict=True):
        yield d, (NO_ID if d is None else d, row), text


def _first_windows(windows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of equal windows, those that may be first (of the smallest id, the first of each document), and the repeats."""
    w = windows[np.lexsort((windows["lo"], windows["row"], windows["doc"], windows["hash"]))]
    new = np.ones(len(w), dtype=bool)
    new[1:] = w["hash"][1:] != w["hash"][:-1]
    own = np.ones(len(w), dtype=bool)
    own[1:] = new[1:] | (w["doc"][1:] != w["doc"][:-1]) | (w["row"][1:] != w["row"][:-1])
    first, start = np.flatnonzero(new)[np.cumsum(new) - 1], np.flatnonzero(own)[np.cumsum(own) - 1]
    repeats = (w["doc"] != w["doc"][first]) | (w["lo"] != w["lo"][start])
    return w[~repeats], w[repeats]


def _window_marks(windows: np.ndarray, long: int) -> np.ndarray:
    marks = np.empty(len(windows), dtype=RANGE)
    for c in ("doc", "row", "lo"):
        marks[c] = windows[c]
    marks["hi"] = marks["lo"] + np.uint32(long)
    return _merge(marks)


def region_bytes(texts: DataFrame, places: DataFrame, shards: int, window_shards: int = 1, groups: int = 1, long: int = LONG) -> DataFrame:
    """shard, and packed: key, doc, row, lo, back and the bytes of regions to look at. texts: each document once, by group.

    Shards from `shards` on hold windows of hot anchors, by hash; shard -1 - grp holds marks of a group.
    """

    def run(texts: pa.Table, found: pa.Table) -> pa.Table:
        todo = _unpacked(found, "places", PLACE)
        wanted = _by_document(todo[np.lexsort((todo["row"], todo["doc"]))])
        out = {"shard": [], "packed": []}
        if wanted and texts.num_rows:
            rows, parts = [], []
            windows: list[np.ndarray] = []
            held = 0

            def flush() -> None:
                first, again = _first_windows(np.concatenate(windows))
                windows[:] = []
                for base, name, what, where in ((shards, "windows", first, (first["hash"] % _U(window_shards)).astype(np.int64)), (-1, "marks", marks := _window_marks(again, long), np.mod(marks["row"], groups))):
                    batch = _packed(name, where, what)
                    out["shard"] += [base + g if base >= 0 else -1 - g for g in batch.column(0).to_pylist()]
                    out["packed"] += batch.column(1).to_pylist()

            for _, key, text in _documents(texts):
                mine = wanted.pop(key, None)  # a copy of the row has the same places
                if mine is not None:
                    raw = (text.as_py() or "").encode()
                    if mine["hot"].any():
                        hot = mine[mine["hot"] > 0]
                        n = hot["more"].astype(np.int64) + 1
                        at = np.repeat(hot["lo"].astype(np.int64) - np.cumsum(n) + n, n) + np.arange(n.sum())
                        w = np.empty(len(at), dtype=WINDOW)
                        w["hash"], w["doc"], w["row"], w["lo"] = SpanHasher(np.frombuffer(raw, dtype=np.uint8))(at, at + long), *key, at
                        windows.append(w)
                        held += len(w)
                        if held >= FLUSH_REGIONS:
                            flush()
                            held = 0
                        mine = mine[mine["hot"] == 0]
                    for k, lo, back, more in mine[["key", "lo", "back", "more"]].tolist():
                        piece = raw[lo : lo + more + long]
                        rows.append((k, *key, lo, back, len(piece)))
                        parts.append(piece)
            if windows:
                flush()
            shard = np.array([r[0] % shards for r in rows], dtype=np.int64)
            head = np.array(rows, dtype=_PIECE)
            for s in np.unique(shard):
                mine = np.flatnonzero(shard == s)
                out["shard"].append(int(s))
                out["packed"].append(len(mine).to_bytes(4, "little") + blob(head[mine]) + b"".join(parts[k] for k in mine))
        return pa.table({"shard": pa.array(out["shard"], pa.int64()), "packed": pa.array(out["packed"], pa.binary())})

    return texts.groupBy("grp").cogroup(places.select("grp", "places").filter("places is not null").groupBy("grp")).applyInArrow(run, "shard long, packed binary")


_PIECE = np.dtype([("key", "<u8"), ("doc", "<i8"), ("row", "<i8"), ("lo", "<u4"), ("back", "u1"), ("size", "<u2")])


def index_shards(pieces: DataFrame, groups: int, shards: int, long: int = LONG) -> DataFrame:
    """grp and marks: windows of the pieces that occur earlier, found by a run-length index a shard, or by hash."""

    def run(table: pa.Table) -> pa.Table:
        shard = table.column("shard")[0].as_py()
        if shard < 0:
            marks = _merge(_unpacked(table, "packed", RANGE))
            return pa.Table.from_batches([_packed("marks", np.full(len(marks), -1 - shard), marks)])
        if shard >= shards:
            marks = _window_marks(_first_windows(_unpacked(table, "packed", WINDOW))[1], long)
            return pa.Table.from_batches([_packed("marks", np.mod(marks["row"], groups), marks)])
        heads, texts = [], []
        for x in table.column("packed"):
            raw = x.as_py()
            n = int.from_bytes(raw[:4], "little")
            head = np.frombuffer(raw, dtype=_PIECE, count=n, offset=4)
            data = np.frombuffer(raw, dtype=np.uint8, offset=4 + n * _PIECE.itemsize)
            cut = np.concatenate(([0], np.cumsum(head["size"].astype(np.int64))))
            heads.append(head)
            texts += [data[a:b] for a, b in zip(cut[:-1], cut[1:], strict=True)]
        head = np.concatenate(heads)
        order = np.lexsort((head["lo"], head["row"], head["doc"]))
        head, texts = head[order], [texts[i] for i in order]
        index = RunIndex(texts, long)
        ends = index.starts + head["size"]
        row, length = index.matching_statistics(index.text, index.starts, ends)
        place = np.flatnonzero(length >= long)
        # Places in the joined texts follow (doc, row, lo), so an earlier place is an earlier start.
        # Pieces of a document overlap, and the same start may stand in two of them: compare starts.
        piece = np.searchsorted(index.starts, place, "right") - 1
        first = index.first_place(row[place])
        other = np.searchsorted(index.starts, first, "right") - 1
        own = head["lo"][piece].astype(np.int64) + place - index.starts[piece]
        was = head["lo"][other].astype(np.int64) + first - index.starts[other]
        doc, row_ = head["doc"][piece], head["row"][piece]
        same_id = head["doc"][other] == doc
        earlier = ~same_id | ((head["row"][other] == row_) & (was < own))
        # The first place may be in another document of the same id: then an earlier one in the own document counts.
        unsure = np.flatnonzero(same_id & (head["row"][other] != row_))
        if len(unsure):
            unsure = unsure[np.lexsort((own[unsure], row_[unsure], first[unsure]))]
            new = np.concatenate(([True], (first[unsure][1:] != first[unsure][:-1]) | (row_[unsure][1:] != row_[unsure][:-1])))
            earlier[unsure] = own[unsure] > own[unsure][np.flatnonzero(new)[np.cumsum(new) - 1]]
        marks = np.empty(int(earlier.sum()), dtype=RANGE)
        marks["doc"], marks["row"], marks["lo"] = doc[earlier], row_[earlier], own[earlier]
        marks["hi"] = marks["lo"] + np.uint32(long)
        marks = _merge(marks)
        return pa.Table.from_batches([_packed("marks", np.mod(marks["row"], groups), marks)])

    return pieces.groupBy("shard").applyInArrow(run, "grp long, marks binary")


def cut_documents(texts: DataFrame, marks: DataFrame, with_text: bool = False) -> DataFrame:
    """Each row of texts, which come by group: doc_id, n_bytes, n_removed, n_spans, kept_sha256, and the text left if asked for.

    Bytes that are left may end inside a character; in the text they are replaced.
    """
    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", *(["kept_text"] if with_text else [])]

    def run(texts: pa.Table, found: pa.Table) -> pa.Table:
        ranges = _by_document(_merge(_unpacked(found, "marks", RANGE)))
        none = np.zeros(0, dtype=RANGE)
        out: dict[str, list] = {c: [] for c in names}
        for d, key, text in _documents(texts):
            raw = (text.as_py() or "").encode()
            mine = ranges.get(key, none)
            lo, hi = mine["lo"].tolist(), mine["hi"].tolist()
            kept = b"".join(raw[x:y] for x, y in zip([0, *hi], [*lo, len(raw)], strict=True))
            values = [d, len(raw), len(raw) - len(kept), len(lo), hashlib.sha256(kept).hexdigest(), kept.decode(errors="replace")]
            for c, v in zip(names, values, strict=False):
                out[c].append(v)
        kinds = [pa.int64()] * 4 + [pa.string()] * 2
        return pa.table({c: pa.array(out[c], k) for c, k in zip(names, kinds, strict=False)})

    schema = ", ".join(f"{c} {'string' if c.startswith('kept') else 'long'}" for c in names)
    return texts.groupBy("grp").cogroup(marks.groupBy("grp")).applyInArrow(run, schema)


def uncut_documents(docs: DataFrame, long: int, with_text: bool = False) -> DataFrame:
    """The same of texts too short to lose anything; they stay where they are."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    cols = [F.col("doc_id").cast("long").alias("doc_id"), F.octet_length(text).cast("long").alias("n_bytes"), F.lit(0).cast("long").alias("n_removed"), F.lit(0).cast("long").alias("n_spans"), F.sha2(text, 256).alias("kept_sha256")]
    return docs.filter(F.octet_length(text) < long).select(*cols, *([text.alias("kept_text")] if with_text else []))


def _prime_above(n: int) -> int:
    while any(n % k == 0 for k in range(2, math.isqrt(n) + 1)):
        n += 1
    return n


def remove_repeats(docs: DataFrame, long: int = LONG, gram: int = GRAM, with_text: bool = False) -> DataFrame:
    """Each byte covered by a `long`-byte string that also starts earlier is removed.

    docs: doc_id, text; more columns are ignored. Earlier means a smaller doc_id, or the same
    document and an earlier start; a null doc_id comes after all others. A null or empty text has
    no bytes; texts shorter than `long` lose nothing. Rows of one doc_id (or none) with different
    texts are different documents, neither of them earlier; rows with equal texts as well are
    copies of one document, with the same result each. An empty table gives no rows. Region hashes
    have 64 bits. Texts travel twice in groups of about GROUP_BYTES, regions once.
    """
    total = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("b")).first()["b"]
    regions = 2 * total // (long - gram + 2) + 1
    buckets = max(1, math.ceil(regions / BUCKET_REGIONS))
    groups = _prime_above(max(2, math.ceil(total / GROUP_BYTES)))
    settled = stage_table(settle_regions(_region_blobs(docs, buckets, long, gram), buckets, groups, long=long), "repeat-settled")
    size = settled.agg(F.coalesce(F.sum(F.octet_length("places")), F.lit(0)).alias("b"), F.coalesce(F.sum("n_hot"), F.lit(0)).alias("hot")).first()
    contested, hot = size["b"] // PLACE.itemsize, size["hot"]
    shards = max(1, math.ceil((contested - hot) * (long + (long - gram) // 2) / SHARD_BYTES))
    window_shards = max(1, math.ceil(hot * (long - gram) / BUCKET_REGIONS))
    marks = settled.filter("marks is not null").select("grp", "marks")
    texts, one_each, parts = _dealt(docs, groups, long)
    if contested:
        marks = marks.unionByName(index_shards(region_bytes(one_each, settled, shards, window_shards, groups, long), groups, shards, long))
    if parts is not None:
        marks = marks.unionByName(marks.join(parts, "grp").select(F.col("to").alias("grp"), "marks"))
    return cut_documents(texts, marks, with_text).unionByName(uncut_documents(docs, long, with_text))
