"""What several operators share: staged tables and vectorised scanning of UTF-8 text.

Scanning works on the bytes of an Arrow string column, a bounded chunk of whole texts at a
time, so that the cost per byte is a few numpy passes and no Python object is made per word.
"""

from __future__ import annotations

import hashlib
import os
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Texts are scanned in chunks of about so many bytes; a longer text is a chunk of its own.
CHUNK_BYTES = 1 << 20
#: The white space of the word pattern [^\x20\x09-\x0D]+
SPACES = (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D)
_U = np.uint64
_P = 0x9E3779B97F4A7C15  # odd, so it has an inverse modulo 2**64
_P_INV = pow(_P, -1, 1 << 64)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    Where it is unset, a local session gets a temporary one; on a cluster that is an error, since
    executors elsewhere would not see a folder of the driver's.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.conf.get("spark.master", "local").startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        path = tempfile.mkdtemp(prefix="tideline-shared-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path


#: Folders written by this process, until remove_staged.
_staged: list[str] = []


def stage_table(df: DataFrame, name: str, compression: str | None = None) -> DataFrame:
    """Write df once to the shared folder and read it back, which cuts its lineage.

    The files outlive the executors that wrote them. A lazily read table can't know its last reader:
    whoever has written a result calls remove_staged.
    """
    spark = df.sparkSession
    path = os.path.join(shared_dir(spark), f"{name}-{uuid.uuid4().hex}")
    df.write.parquet(path, compression=compression)
    _staged.append(path)
    return spark.read.schema(df.schema).parquet(path)


def staged_so_far() -> int:
    """A mark for remove_staged."""
    return len(_staged)


def remove_staged(spark: SparkSession, since: int = 0, but_last: int = 0) -> int:
    """Remove what stage_table has written since a mark, but for the last ones; results that still read it must have been written. How many folders."""
    conf = spark._jsparkSession.sessionState().newHadoopConf()
    gone = _staged[since : len(_staged) - but_last]
    for path in gone:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(conf).delete(at, True)
    _staged[since : len(_staged) - but_last] = []
    return len(gone)


#: Arrow batches between the JVM and Python hold at most so many rows and bytes: texts are long, and
#: each batch stands in memory on both sides at once.
BATCH_ROWS, BATCH_BYTES = 1000, 4 << 20


def bounded_batches(df: DataFrame) -> DataFrame:
    """df, with the session's Arrow batches bounded; call it on what goes to mapInArrow."""
    conf = df.sparkSession.conf
    if int(conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > BATCH_ROWS:
        conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    try:
        conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    except Exception:  # noqa: BLE001  a Spark without this setting still has the bound on rows
        pass
    return df


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names like these that df doesn't have yet."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def columns_of(df: DataFrame) -> list[Column]:
    """All columns, whatever their names hold."""
    return [F.col(quoted(c)) for c in df.columns]


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def mix64(x: np.ndarray) -> np.ndarray:
    """Finalise 64-bit hashes so that every input bit reaches every output bit."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _U(27))
    x = x * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


_powers: list[np.ndarray] = []


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """P**i and P**-i modulo 2**64 for i up to n; tables for a chunk are kept, longer ones aren't."""
    if _powers and len(_powers[0]) > n:
        return _powers[0], _powers[1]
    size = max(n, CHUNK_BYTES + (CHUNK_BYTES >> 1)) + 1
    tables = []
    for base in (_P, _P_INV):
        t = np.full(size, base, dtype=_U)
        t[0] = 1
        tables.append(np.cumprod(t, dtype=_U))
    if n <= CHUNK_BYTES + (CHUNK_BYTES >> 1):
        _powers[:] = tables
    return tables[0], tables[1]


_WORD_BYTE = np.ones(256, dtype=bool)
_WORD_BYTE[list(SPACES)] = False
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


class SpanHasher:
    """64-bit hashes of any byte ranges of one buffer, by prefix sums of a polynomial."""

    def __init__(self, data: np.ndarray):
        self.pw, self.inv = _power_tables(len(data) + 1)
        self.prefix = np.zeros(len(data) + 1, dtype=_U)
        np.cumsum((data.astype(_U) + _U(1)) * self.pw[: len(data)], out=self.prefix[1:])

    def raw(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return (self.prefix[end] - self.prefix[start]) * self.inv[start]

    def __call__(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix64(self.raw(start, end) + (end - start).astype(_U) * _U(0xD6E8FEB86659FD93))


class TextChunk:
    """Some whole texts as one byte array: offs[i]:offs[i + 1] is text i of the batch at lo + i."""

    def __init__(self, data: np.ndarray, offs: np.ndarray, lo: int):
        self.data, self.offs, self.lo, self.n = data, offs, lo, len(offs) - 1

    def words(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts and ends of the words, and for each text the index of its first word (n + 1 long)."""
        word = _WORD_BYTE[self.data]
        before, after = np.zeros_like(word), np.zeros_like(word)
        before[1:], after[:-1] = word[:-1], word[1:]
        before[self.offs[:-1][self.offs[:-1] < len(word)]] = False
        after[self.offs[1:][self.offs[1:] > 0] - 1] = False
        starts, ends = np.flatnonzero(word & ~before), np.flatnonzero(word & ~after) + 1
        return starts, ends, np.searchsorted(starts, self.offs)

    def lowered(self) -> np.ndarray:
        """The bytes with A-Z lower-cased (UTF-8 continuation bytes are never in that range)."""
        return _LOWER[self.data]

    def per_text(self, mask_or_weight: np.ndarray) -> np.ndarray:
        """Sum of a value per byte over each text."""
        c = np.zeros(len(self.data) + 1, dtype=np.int64)
        np.cumsum(mask_or_weight, out=c[1:])
        return c[self.offs[1:]] - c[self.offs[:-1]]


def text_chunks(column: pa.Array, limit: int = CHUNK_BYTES, most: int = 1 << 13) -> Iterator[TextChunk]:
    """The texts of an Arrow string column, nulls as empty texts, in chunks of about limit bytes and at most `most` texts."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    n = len(column)
    if not n:
        return
    column = column.fill_null("") if column.null_count else column
    wide = pa.types.is_large_string(column.type)
    kind = np.dtype(np.int64 if wide else np.int32)
    _, offsets, values = column.buffers()
    offs = np.frombuffer(offsets, dtype=kind, count=column.offset + n + 1)[column.offset :].astype(np.int64)
    data = np.frombuffer(values, dtype=np.uint8) if values is not None else np.zeros(0, dtype=np.uint8)
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offs, offs[lo] + limit, "right")) - 1)
        hi = min(hi, n, lo + most)
        yield TextChunk(data[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo], lo)
        lo = hi


def blob(a: np.ndarray) -> bytes:
    return np.ascontiguousarray(a).tobytes()


def sha256_hex(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


BITMAP_BITS = 26
_BITMAP_CUT = 16


def id_bitmap(ids: DataFrame, column: str) -> bytes:
    """A bitmap of the hashed longs in a column: fixed in size, made by tasks, joined in pieces.

    It only saves work. Something not in the table passes it with a chance that grows with the
    table, so whoever uses it joins or checks afterwards.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros(1 << (BITMAP_BITS - 3), dtype=np.uint8)
        for batch in batches:
            at = bitmap_places(np.asarray(batch.column(0).drop_null()))
            np.bitwise_or.at(bits, at >> 3, np.left_shift(1, at & 7).astype(np.uint8))
        rows = bits.reshape(-1, 1 << _BITMAP_CUT)
        some = np.flatnonzero(rows.any(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array([rows[k].tobytes() for k in some], pa.binary())], ["part", "bits"])

    def join(table: pa.Table) -> pa.Table:
        bits = np.zeros(1 << _BITMAP_CUT, dtype=np.uint8)
        for x in table.column("bits"):
            bits |= np.frombuffer(x.as_py(), dtype=np.uint8)
        return pa.table({"part": pa.array([table.column("part")[0].as_py()], pa.int64()), "bits": pa.array([bits.tobytes()], pa.binary())})

    parts = ids.selectExpr(f"cast({column} as long)").mapInArrow(run, "part long, bits binary").groupBy("part").applyInArrow(join, "part long, bits binary")
    bits = bytearray(1 << (BITMAP_BITS - 3))
    for r in parts.collect():
        bits[r["part"] << _BITMAP_CUT : (r["part"] + 1) << _BITMAP_CUT] = r["bits"]
    return bytes(bits)


def bitmap_places(ids: np.ndarray) -> np.ndarray:
    return (mix64(ids.astype(np.int64).view(_U)) >> _U(64 - BITMAP_BITS)).astype(np.int64)


def in_bitmap(bits: bytes, ids: np.ndarray) -> np.ndarray:
    at = bitmap_places(ids)
    return (np.frombuffer(bits, dtype=np.uint8)[at >> 3] >> (at & 7).astype(np.uint8)) & 1 > 0
