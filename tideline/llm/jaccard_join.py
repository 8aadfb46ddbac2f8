"""N-gram Jaccard join by a count-vector R-tree.

A document is its set of distinct word n-grams, as 64-bit hashes in order. Ranges of hash values
are groups; the number of a set's hashes in each group is its count vector, a point. Two sets share
at most the sum of the coordinate minima of their points, and at most the same sum against the
upper corner of a box that holds a point: an R-tree over points finds all partners whose bound
reaches the needed overlap, and those pairs are verified on the sets.

A single tree over a corpus can't be cut into tasks, since boxes of points in many dimensions
overlap. So points are first dealt to lists, such that any two similar sets meet in some list: with
room for at most t differing hashes and more than t non-empty groups, some group is the same in
both. The groups' contents are the list keys. Sets of a few n-grams, whose groups are too few, are
dealt by a prefix of their hashes instead. A tree is built for each list of more than DIRECT sets.

Sets that are equal are one class from the start, so copies cost one key each and never pair up.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import _U, SpanHasher, blob, bounded_batches, columns_of, fresh, id_bitmap, in_bitmap, mix64, stage_table, text_chunks
from .graph import connected_components

WIDTH = 5
PERCENT = 80
#: Sets below this size are dealt by hash prefix.
SMALL = 25
BUCKET_KEYS = 1 << 20
FLUSH_KEYS = 1 << 20
BLOCK = 2048
FANOUT = 16
#: Lists of at most so many sets are compared directly: a tree over two leaves saves nothing.
DIRECT = 32
#: Boxes have COARSE coordinates; points have at least as many, about one for four elements.
COARSE = 64


# ---- sets ----------------------------------------------------------------------------------


def shingle_sets(column: pa.Array, width: int = WIDTH) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text: A-Z lower-cased, words as in WORD.

    A text of fewer words than width is one shingle, one without words has none.
    """
    for ch in text_chunks(column):
        starts, ends, first = ch.words()
        w = SpanHasher(ch.lowered())(starts, ends)
        whole = len(w) - width + 1
        if whole > 0:
            s = w[:whole]
            for k in range(1, width):
                s = mix64(s * _U(0x2545F4914F6CDD1D) + w[k : whole + k])
        for i in range(ch.n):
            a, b = first[i], first[i + 1]
            if b - a >= width:
                x = np.sort(s[a : b - width + 1])
                yield x[np.concatenate(([True], x[1:] != x[:-1]))]
            elif b > a:
                yield mix64(np.array([int(sum(int(v) * (2 * k + 3) for k, v in enumerate(w[a:b])) + (int(b - a) << 61)) & 0xFFFFFFFFFFFFFFFF], dtype=_U))
            else:
                yield w[:0]


def fingerprint(s: np.ndarray) -> int:
    """A 63-bit name of a set: equal sets have equal names."""
    with np.errstate(over="ignore"):
        x = mix64(np.array([mix64(s ^ _U(0xA0761D6478BD642F)).sum(dtype=_U) + _U(len(s)) * _U(0xE7037ED1A0B428DB)], dtype=_U))
    return int(x[0] >> _U(1))


class Bands:
    """Size bands and the number of groups in each, for one similarity threshold (in percent).

    Bands grow by 100 / percent, so similar sets are in the same band or in neighbouring ones; a
    pair meets at the band of its larger set.
    """

    def __init__(self, percent: int = PERCENT):
        self.percent = percent
        self.edges = [SMALL]

    def _reach(self, n: int) -> int:
        while self.edges[-1] <= n:
            self.edges.append(max(self.edges[-1] + 1, math.ceil(self.edges[-1] * 100 / self.percent)))
        return int(np.searchsorted(self.edges, n, "right")) - 1

    def groups(self, band: int) -> int:
        while len(self.edges) <= band + 1:
            self._reach(self.edges[-1])
        differing = 2 * (self.edges[band + 1] - 1) * (100 - self.percent) // (100 + self.percent)
        return differing + 4 + differing // 12

    def count(self, n: int) -> int:
        """How many keys a set of n gets, at most."""
        band = self._reach(n)
        small = n * (100 - self.percent) // 100 + 1 if n < SMALL else 0
        return (small + (self.groups(0) if math.ceil(n * 100 / self.percent) >= SMALL else 0)) if band < 0 else self.groups(band) + self.groups(band + 1)

    def keys(self, s: np.ndarray) -> np.ndarray:
        n = len(s)
        band = self._reach(n)
        out = []
        if n < SMALL:
            out.append(mix64(s[: n * (100 - self.percent) // 100 + 1] ^ _U(0x8EBC6AF09C88C6E3)))
            wanted = [0] if math.ceil(n * 100 / self.percent) >= SMALL else []
        else:
            wanted = [band, band + 1]
        if wanted:
            mixed = mix64(s ^ _U(0x589965CC75374CC3))
            for k in wanted:
                group = ((s >> _U(32)) * _U(self.groups(k))) >> _U(32)
                at = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1])))
                out.append(mix64(np.add.reduceat(mixed, at) + group[at] * _U(0x1D8E4E27C47D124F) + _U(k + 1)))
        return np.concatenate(out)


def fine_counts(s: np.ndarray) -> np.ndarray:
    """How many of the set's hashes lie in each of equal ranges of values, four to eight an element."""
    dims = max(COARSE, 1 << (4 * len(s)).bit_length())
    return np.bincount(((s >> _U(32)) * _U(dims) >> _U(32)).astype(np.int64), minlength=dims)


def pack_point(s: np.ndarray) -> bytes:
    """A set as a point: the ranges whose counts exceed 3 and by how much, then all counts in two bits.

    A point is shuffled once for each of its set's lists, so it is coded by the frequency of its
    bytes: most ranges are empty.
    """
    counts = fine_counts(s)
    over = np.flatnonzero(counts > 3)
    low = np.minimum(counts, 3).astype(np.uint8).reshape(-1, 4)
    z = zlib.compressobj(1, zlib.DEFLATED, -15, 9, zlib.Z_HUFFMAN_ONLY)
    coded = z.compress(blob(low[:, 0] | low[:, 1] << 2 | low[:, 2] << 4 | low[:, 3] << 6)) + z.flush()
    return np.concatenate(([len(over)], over, counts[over] - 3)).astype(np.uint32).tobytes() + coded


def read_point(packed: bytes) -> tuple[np.ndarray, np.ndarray, int]:
    """Count vector (a range for every 16 fine ones, COARSE at least), fine vector and excess.

    The fine vector's counts are at most 3; excess is what lies above that in all. With the excess
    of both sets added, the sum of fine minima still bounds the overlap, within a few elements.
    """
    fine, over, extra = _read_fine(packed)
    n = len(over)
    dims = max(COARSE, len(fine) // 16)
    counts = fine.reshape(dims, -1).sum(axis=1, dtype=np.uint16)
    if n:
        np.add.at(counts, over // (len(fine) // dims), extra.astype(np.uint16))
    return counts, fine, int(extra.sum())


def _read_fine(packed: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    n = int.from_bytes(packed[:4], "little")
    over, extra = np.frombuffer(packed, dtype=np.uint32, count=2 * n, offset=4).reshape(2, n)
    b = np.frombuffer(zlib.decompress(packed[4 + 8 * n :], -15), dtype=np.uint8)
    fine = np.empty((len(b), 4), dtype=np.uint8)
    for k in range(4):
        np.bitwise_and(b >> np.uint8(2 * k), np.uint8(3), out=fine[:, k])
    return fine.ravel(), over, extra


# ---- the tree ------------------------------------------------------------------------------


class CountRTree:
    """A bulk-loaded R-tree over count vectors; only boxes' upper corners matter for the bound.

    Boxes are of the vectors folded to COARSE coordinates. Points that their box and their folded
    vector let through are bounded once more by all their coordinates, and then by their fine
    vectors if given, which is nearly exact.
    """

    fine: np.ndarray | None = None
    excess: np.ndarray | None = None

    def __init__(self, vectors: np.ndarray, sizes: np.ndarray, percent: int = PERCENT, fanout: int = FANOUT):
        self.percent, self.fanout, self.vectors, self.sizes = percent, fanout, vectors, sizes
        coarse = self._coarse(vectors)
        self.order = self._tile(coarse, sizes)
        self.levels = [(coarse[self.order], sizes[self.order])]
        while len(self.levels[-1][1]) > fanout:
            upper, least = self.levels[-1]
            at = np.arange(0, len(least), fanout)
            self.levels.append((np.maximum.reduceat(upper, at, axis=0), np.minimum.reduceat(least, at)))

    @staticmethod
    def _coarse(vectors: np.ndarray) -> np.ndarray:
        return vectors.reshape(len(vectors), COARSE, -1).sum(axis=2, dtype=np.int32)

    def _tile(self, vectors: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Sort-tile order: by size, then slabs of that order by the two most spread coordinates."""
        n = len(sizes)
        a, b = np.argsort(-vectors.var(axis=0), kind="stable")[:2]
        slab = max(self.fanout, math.isqrt(n) // self.fanout * self.fanout)
        rank = np.empty(n, dtype=np.int64)
        rank[np.lexsort((vectors[:, a], sizes))] = np.arange(n)
        return np.lexsort((vectors[:, b], vectors[:, a], rank // slab))

    def with_fine(self, fine: np.ndarray, excess: np.ndarray) -> CountRTree:
        self.fine, self.excess = fine, excess
        return self

    def neighbours(self, i: int) -> np.ndarray:
        """Rows whose bounds against row i allow the overlap that the threshold asks for, i among them."""
        at = self.query(self.vectors[i], int(self.sizes[i]))
        if self.fine is None:
            return at
        out = []
        for lo in range(0, len(at), 512):
            part = at[lo : lo + 512]
            bound = np.minimum(self.fine[part], self.fine[i]).sum(axis=1, dtype=np.int64) + self.excess[part] + self.excess[i]
            out.append(part[bound * (100 + self.percent) >= self.percent * (self.sizes[i] + self.sizes[part])])
        return np.concatenate(out) if out else at

    def query(self, vector: np.ndarray, size: int) -> np.ndarray:
        """Rows whose count vectors allow the overlap that the threshold asks for."""
        fine, vector = vector, self._coarse(vector[None])[0]
        at = np.arange(len(self.levels[-1][1]))
        for depth in range(len(self.levels) - 1, -1, -1):
            upper, least = self.levels[depth]
            bound = np.minimum(upper[at], vector).sum(axis=1)
            at = at[bound * (100 + self.percent) >= self.percent * (size + least[at])]
            if depth:
                at = (at[:, None] * self.fanout + np.arange(self.fanout)).ravel()
                at = at[at < len(self.levels[depth - 1][1])]
        at = self.order[at]
        bound = np.minimum(self.vectors[at], fine).sum(axis=1, dtype=np.int64)
        return at[bound * (100 + self.percent) >= self.percent * (size + self.sizes[at])]


def _fold(vectors: list[np.ndarray]) -> np.ndarray:
    """Count vectors with the least number of ranges among them: neighbouring ranges add up."""
    dims = min(map(len, vectors))
    return np.stack([v.astype(np.uint16) if len(v) == dims else v.reshape(dims, -1).sum(axis=1, dtype=np.uint16) for v in vectors])


class Bounded:
    """The sets of a list: which of them the bounds let come near a given one, by a tree or, in short lists, directly."""

    def __init__(self, packed: list[bytes], sizes: np.ndarray, percent: int = PERCENT):
        self.sizes, self.percent, self.tree = sizes, percent, None
        if len(packed) > DIRECT:
            counts, fine, excess = zip(*map(read_point, packed), strict=True)
            self.tree = CountRTree(_fold(list(counts)), sizes, percent).with_fine(_fold(list(fine)), np.array(excess, dtype=np.int64))
            return
        points = [_read_fine(x) for x in packed]
        dims = min(len(f) for f, _, _ in points)
        self.fine = np.stack([f if len(f) == dims else f.reshape(dims, -1).sum(axis=1, dtype=np.uint8) for f, _, _ in points])
        self.excess = np.array([int(e.sum()) for _, _, e in points], dtype=np.int64)

    def near(self, i: int) -> np.ndarray:
        """Rows whose bounds against row i allow the overlap that the threshold asks for, i among them."""
        if self.tree is not None:
            return self.tree.neighbours(i)
        bound = np.minimum(self.fine, self.fine[i]).sum(axis=1, dtype=np.int64) + self.excess + self.excess[i]
        return np.flatnonzero(bound * (100 + self.percent) >= self.percent * (self.sizes[i] + self.sizes))


#: What a pair of the first pass is: a leader and its member, members of different leaders, or a note that the list had too many of these.
LED, ACROSS, TOO_MANY = 0, 1, 2
#: Lists with more pairs between stars than this come again if they aren't one component by then: those of near copies are.
MOST_ACROSS = 32


def star_pairs(packed: list[bytes], sizes: np.ndarray, percent: int = PERCENT) -> Iterator[tuple[int, int, int]]:
    """(row, row, kind): leaders with their members, until each row leads or is led, and bounded pairs between stars.

    If all led pairs turn out to be links, these pairs connect whatever the list can connect: two rows
    of one star meet in its leader. Pairs between stars start from all stars but the largest; a list
    with more than MOST_ACROSS of them is noted instead, so there are about as many pairs as rows.
    """
    n = len(sizes)
    bounded = Bounded(packed, sizes, percent)
    star = np.full(n, -1, dtype=np.int64)
    seen: dict[int, np.ndarray] = {}
    for i in range(n):
        if star[i] < 0:
            mine = bounded.near(i)
            seen[i] = mine
            new = mine[star[mine] < 0]
            star[new] = star[i] = i
            yield from ((i, int(j), LED) for j in new if j != i)
    if len(seen) > 1:
        largest = int(np.bincount(star).argmax())
        across: list[tuple[int, int, int]] = []
        for i in np.flatnonzero(star != largest):
            mine = seen.get(int(i))
            mine = bounded.near(int(i)) if mine is None else mine
            across += ((int(i), int(j), ACROSS) for j in mine[(star[mine] != star[i]) & ((star[mine] == largest) | (mine > i))])
            if len(across) > MOST_ACROSS:
                yield 0, 0, TOO_MANY
                return
        yield from across


def crossing_pairs(packed: list[bytes], sizes: np.ndarray, component: np.ndarray, percent: int = PERCENT) -> Iterator[tuple[int, int, int]]:
    """All pairs of different components that the bounds allow."""
    names, inverse, count = np.unique(component, return_inverse=True, return_counts=True)
    if len(names) < 2:
        return
    bounded = Bounded(packed, sizes, percent)
    largest = int(np.argmax(count))
    for i in np.flatnonzero(inverse != largest):
        for j in bounded.near(int(i)):
            if inverse[j] != inverse[i] and (inverse[j] == largest or j > i):
                yield int(i), int(j), ACROSS


# ---- jobs ----------------------------------------------------------------------------------


def document_sets(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """doc_id, row (hash of id and text), n_shingles and fp (null for an empty set) for each row; map-only."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [(len(s), fingerprint(s) if len(s) else None) for s in shingle_sets(batch.column(1), width)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array([x[0] for x in sets], pa.int64()), pa.array([x[1] for x in sets], pa.int64())], ["doc_id", "row", "n_shingles", "fp"])

    return _rows(docs).mapInArrow(run, "doc_id long, row long, n_shingles long, fp long")


def _rows(docs: DataFrame) -> DataFrame:
    return bounded_batches(docs).selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text", f"{ROW} row")


#: Tells a row by its id and text, for rows without an id too.
ROW = "xxhash64(cast(doc_id as long), cast(text as string))"


def _key_blobs(docs: DataFrame, buckets: int, width: int, percent: int) -> DataFrame:
    """List keys and set names, packed by bucket: few rows of large blobs, not a row a key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bands = Bands(percent)
        keys: list[np.ndarray] = []
        names: list[np.ndarray] = []
        seen: set[int] = set()
        held = 0

        def flush() -> pa.RecordBatch:
            k, f = np.concatenate(keys), np.concatenate(names)
            keys.clear()
            names.clear()
            bucket = (k % _U(buckets)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            k, f, bucket = (k[order] // _U(buckets)).astype(np.uint32), f[order], bucket[order]
            cut = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1])))
            ends = np.append(cut[1:], len(bucket))
            return pa.RecordBatch.from_arrays([pa.array(bucket[cut]), pa.array([blob(k[a:b]) for a, b in zip(cut, ends, strict=True)], pa.binary()), pa.array([blob(f[a:b]) for a, b in zip(cut, ends, strict=True)], pa.binary())], ["bucket", "keys", "names"])

        for batch in batches:
            for s in shingle_sets(batch.column(1), width):
                if len(s) and (name := fingerprint(s)) not in seen:
                    if len(seen) > 1_000_000:  # only saves work: a copy seen again makes the same keys
                        seen.clear()
                    seen.add(name)
                    k = bands.keys(s)
                    keys.append(k)
                    names.append(np.full(len(k), name, dtype=np.int64))
                    held += len(k)
                    if held >= FLUSH_KEYS:
                        yield flush()
                        held = 0
        if held:
            yield flush()

    return _rows(docs).mapInArrow(run, "bucket long, keys binary, names binary")


def candidate_lists(docs: DataFrame, buckets: int, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """(list, fp): sets that share a list key with another. Lists of the same members are one list."""

    def group(table: pa.Table) -> pa.Table:
        k = np.concatenate([np.frombuffer(b.as_py(), dtype=np.uint32) for b in table.column("keys")])
        f = np.concatenate([np.frombuffer(b.as_py(), dtype=np.int64) for b in table.column("names")])
        order = np.argsort(k, kind="stable")
        k, f = k[order], f[order]
        again = np.concatenate(([False], k[1:] == k[:-1]))
        keep = again | np.concatenate((again[1:], [False]))
        k, f = k[keep], f[keep]
        order = np.lexsort((f, k))
        k, f = k[order], f[order]
        fresh = np.concatenate(([True], (k[1:] != k[:-1]) | (f[1:] != f[:-1])))[: len(k)]
        k, f = k[fresh], f[fresh]
        if len(k):
            at = np.flatnonzero(np.concatenate(([True], k[1:] != k[:-1])))
            size = np.diff(np.append(at, len(k)))
            name = (mix64(np.add.reduceat(mix64(f.astype(_U)), at) + size.astype(_U)) >> _U(1)).astype(np.int64)
            _, one = np.unique(name, return_index=True)
            take = np.zeros(len(at), dtype=bool)
            take[one] = True
            take &= size > 1
            rows = np.repeat(take, size)
            k, f = np.repeat(name, size)[rows], f[rows]
        return pa.table({"list": pa.array(k, pa.int64()) if len(k) else pa.array([], pa.int64()), "fp": pa.array(f, pa.int64())})

    return _key_blobs(docs, buckets, width, percent).groupBy("bucket").applyInArrow(group, "list long, fp long").distinct()


HASH_BYTES = 6


def set_table(docs: DataFrame, classes: DataFrame, wanted: DataFrame, hashes: bool, width: int = WIDTH) -> DataFrame:
    """fp, n and the point, or fp and the top 48 bits of each hash, for the wanted fps.

    Read from one row of each class, in a pass over the texts that a bitmap of those rows' hashes
    narrows. A few rows nobody wants come along, and an fp can come twice if its
    row repeats; the joins that follow on fp aren't hurt by either.
    """
    bits = docs.sparkSession.sparkContext.broadcast(id_bitmap(classes.join(wanted.select("fp").distinct(), "fp", "left_semi"), "rep"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            batch = batch.filter(pa.array(in_bitmap(bits.value, np.asarray(batch.column(2)))))
            for lo in range(0, batch.num_rows, 1000):
                rows = []
                for s in shingle_sets(batch.column(1).slice(lo, 1000), width):
                    if len(s) and (name := fingerprint(s)) not in seen:
                        seen.add(name)
                        rows.append((name, len(s), np.ascontiguousarray(s).view(np.uint8).reshape(-1, 8)[:, 8 - HASH_BYTES :].tobytes() if hashes else pack_point(s)))
                yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.binary())], ["fp", "n", "packed"])

    return _rows(docs).mapInArrow(run, "fp long, n long, packed binary")


def _in_lists(members: DataFrame, pick) -> DataFrame:
    """(a, b, list, kind) from each list by pick(points, sizes, components); lists arrive sorted, one by one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, rows = None, []
        out: tuple[list, list, list, list] = ([], [], [], [])

        def pairs() -> None:
            if len(rows) > 1:
                rows.sort(key=lambda r: (r[1], r[0]))
                sizes = np.array([r[1] for r in rows], dtype=np.int64)
                for i, j, kind in pick([r[2] for r in rows], sizes, np.array([r[3] for r in rows], dtype=np.int64)):
                    x, y = rows[i][0], rows[j][0]
                    for o, v in zip(out, (min(x, y), max(x, y), now, kind), strict=True):
                        o.append(v)

        def found() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, (pa.int64(), pa.int64(), pa.int64(), pa.int32()), strict=True)], ["a", "b", "list", "kind"])
            for o in out:
                o.clear()
            return batch

        for batch in batches:
            for name, *row in zip(*(batch.column(k).to_pylist() for k in range(5)), strict=True):
                if name != now:
                    pairs()
                    now, rows = name, []
                rows.append(row)
            yield found()
        pairs()
        yield found()

    ordered = members.select("list", "fp", "n", "counts", "component").repartition("list").sortWithinPartitions("list")
    return ordered.mapInArrow(run, "a long, b long, list long, kind int")


def verified(docs: DataFrame, classes: DataFrame, pairs: DataFrame, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """The pairs whose sets reach the threshold, by the intersection of their hashes' upper 48 bits. pairs is read twice."""

    def read(x) -> np.ndarray:
        out = np.zeros((len(x) // HASH_BYTES, 8), dtype=np.uint8)
        out[:, 8 - HASH_BYTES :] = np.frombuffer(x, dtype=np.uint8).reshape(-1, HASH_BYTES)
        return out.view(_U).ravel()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, held = None, None
        for batch in batches:
            out: tuple[list[int], list[int]] = ([], [])
            for a, b, fp, packed in zip(*(batch.column(k).to_pylist() for k in range(3)), batch.column(3), strict=True):
                if (a, b) != last:
                    last, held = (a, b), (fp, packed)
                elif held and fp != held[0]:
                    x, y = read(held[1].as_py()), read(packed.as_py())
                    z = np.sort(np.concatenate((x, y)), kind="stable")
                    common = int((z[1:] == z[:-1]).sum())
                    held = None
                    if 100 * common >= percent * (len(x) + len(y) - common):
                        out[0].append(a)
                        out[1].append(b)
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in out], ["a", "b"])

    sides = pairs.filter("a <> b").select("a", "b", F.explode(F.array("a", "b")).alias("fp"))
    both = sides.join(set_table(docs, classes, sides, True, width).select("fp", "packed"), "fp")
    return both.select("a", "b", "fp", "packed").repartition("a", "b").sortWithinPartitions("a", "b").mapInArrow(run, "a long, b long")


def jaccard_links(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(documents with their set, links between different sets, components of linked sets).

    The first: doc_id, row, n_shingles, fp. The second: a, b (fps), links enough to connect each
    component, every one verified; pairs not listed lie within a component or aren't similar. The
    third: node, component (fps), for sets with a link.
    """
    found = stage_table(document_sets(docs, width), "jaccard-sets")
    bands = Bands(percent)
    per_size = found.filter("fp is not null").groupBy("n_shingles").count()
    # A histogram over sizes grows with the longest text, not with the table; rounded up to 2 digits.
    coarse = per_size.selectExpr("cast(ceil(n_shingles / pow(10, greatest(0, length(n_shingles) - 2))) * pow(10, greatest(0, length(n_shingles) - 2)) as long) n", "count").groupBy("n").agg(F.sum("count").alias("c"))
    keys = sum(bands.count(r["n"]) * r["c"] for r in coarse.collect())
    buckets = max(1, math.ceil(keys / BUCKET_KEYS))
    lists = stage_table(candidate_lists(docs, buckets, width, percent), "jaccard-lists")
    classes = found.filter("fp is not null").groupBy("fp").agg(F.min("row").alias("rep"))
    points = stage_table(set_table(docs, classes, lists, False, width).withColumnRenamed("packed", "counts"), "jaccard-points")
    blocks = lists.groupBy("list").agg(F.ceil(F.count(F.lit(1)) / F.lit(float(BLOCK))).cast("int").alias("blocks"))
    members = lists.join(blocks, "list")

    # First, stars and what lies between them; in lists longer than a block each block by itself.
    block = F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int")
    first = members.withColumn("list", F.when(F.col("blocks") > 1, F.xxhash64("list", block)).otherwise(F.col("list")))
    found_pairs = stage_table(_in_lists(first.join(points, "fp").withColumn("component", F.col("fp")), lambda p, n, c: star_pairs(p, n, percent)), "jaccard-pairs")
    pairs = found_pairs.filter(F.col("kind") != TOO_MANY).select("a", "b").distinct()
    links = stage_table(verified(docs, classes, pairs, width, percent), "jaccard-links")
    components = connected_components(links)

    # Then, again, lists of which the first pass doesn't tell all, if they still hold more than one component:
    # those with a led pair that isn't a link, with too many pairs between stars, and those of several blocks.
    untold = found_pairs.filter(F.col("kind") == LED).join(links, ["a", "b"], "left_anti").select("list").unionByName(found_pairs.filter(F.col("kind") == TOO_MANY).select("list")).unionByName(blocks.filter("blocks > 1").select("list")).distinct()
    labelled = members.join(untold, "list", "left_semi").join(components.withColumnRenamed("node", "fp"), "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    labelled = stage_table(labelled, "jaccard-untold")
    per_list = labelled.groupBy("list", "component").agg(F.count(F.lit(1)).alias("c")).groupBy("list").agg(F.max_by("component", F.struct("c", "component")).alias("top"), F.max("c").alias("n_top"), F.sum("c").alias("n_all")).filter("n_all > n_top")
    rest = labelled.join(per_list, "list").withColumns({"tops": F.ceil(F.col("n_top") / F.lit(float(BLOCK))).cast("int"), "others": F.ceil((F.col("n_all") - F.col("n_top")) / F.lit(float(BLOCK))).cast("int")})
    again = _in_lists(rest.withColumn("list", F.explode(_meetings())).join(points, "fp"), lambda p, n, c: crossing_pairs(p, n, c, percent))
    more = stage_table(again.select("a", "b").distinct().join(pairs, ["a", "b"], "left_anti"), "jaccard-more-pairs")
    if not more.isEmpty():
        more = stage_table(verified(docs, classes, more, width, percent), "jaccard-more-links")
        links = stage_table(links.unionByName(more).distinct(), "jaccard-all-links")
        components = connected_components(links)
    return found, links, components


def _meetings():
    """The lists in which a set of a long list meets the others: an array of names.

    The list's largest component needs no pairs within itself. Its blocks meet each block of the
    other sets, and these meet each other: few rows where one component is most of the list.
    """
    blocks = F.when(F.col("component") == F.col("top"), F.col("tops")).otherwise(F.col("others"))
    mine = F.pmod(F.xxhash64("fp"), blocks).cast("int")

    def up_to(n: str):
        return F.sequence(F.lit(0), F.col(n) - 1)

    with_top = F.transform(up_to("tops"), lambda k: F.xxhash64("list", F.lit("top"), mine, k))
    with_others = F.transform(up_to("others"), lambda k: F.xxhash64("list", F.lit("other"), F.least(mine, k), F.greatest(mine, k)))
    of_top = F.transform(up_to("others"), lambda k: F.xxhash64("list", F.lit("top"), k, mine))
    return F.when(F.col("blocks") <= 1, F.array("list")).when(F.col("component") == F.col("top"), of_top).otherwise(F.concat(with_top, with_others))


def _by_class(found: DataFrame, components: DataFrame) -> DataFrame:
    """fp and first, the first document of its component: the smallest id, rows without one last, then by row hash."""
    first = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row")
    classes = found.filter("fp is not null").groupBy("fp").agg(F.min(first).alias("rep"))
    named = classes.join(components, classes["fp"] == components["node"], "left").select("fp", "rep", F.coalesce("component", "fp").alias("component"))
    return named.join(named.groupBy("component").agg(F.min("rep").alias("first")), "component").select("fp", "first")


def near_duplicate_components(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """One row per row of docs: doc_id, n_shingles, component_id.

    docs: doc_id, text; more columns are ignored. Two documents link when 100 * |intersection| >=
    percent * |union| of their shingle sets. A null or empty text has no shingles, links with
    nothing and is its own component. Rows that repeat a doc_id with the same text count as copies,
    with other texts as documents of their own. component_id is the smallest doc_id reachable, also
    by way of rows without one; null if none is. An empty table gives no rows.
    """
    found, _, components = jaccard_links(docs, width, percent)
    return found.join(_by_class(found, components), "fp", "left").select("doc_id", "n_shingles", F.coalesce("first.doc_id", F.when(F.col("first").isNull(), F.col("doc_id"))).alias("component_id"))


def one_of_each_group(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """docs with one document of each component: the one of the smallest doc_id, or of none if no other has one.

    Of rows that repeat, id and text, one stays; so do documents without words. Any other columns
    may be among docs', and they stay as they are.
    """
    found, _, components = jaccard_links(docs, width, percent)
    first = found.filter("fp is null").select("row").unionByName(_by_class(found, components).select("first.row")).distinct()
    row = fresh(docs, "row")[0]
    kept = docs.withColumn(row, F.expr(ROW)).join(first.withColumnRenamed("row", row), row, "left_semi")
    return kept.dropDuplicates([row]).select(*columns_of(docs))
