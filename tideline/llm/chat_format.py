"""Chat formatting at token level.

Each segment (role, content) is encoded by itself; reserved ids, which no encoded text can hold,
are spliced between segments: <turn> role <sep> content <end>. Control strings inside contents and
roles are escaped first, so that the formatted text, too, can be read back. Which tokens are
trained on is a prefix sum over +1 at a trained content's start and -1 at its end.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_batches

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: The public split pattern of that byte-level vocabulary. Fixed value.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"""
#: Reserved marks as text, and what must not occur unescaped in a role or content.
TURN, SEP, END = "### ", ": ", "</turn>\n"
_ESCAPE = re.compile(r"\\|###|</turn>")
_ESCAPE_ROLE = re.compile(r"\\|###|</turn>|: ")
_UNESCAPE = re.compile(r"\\(\\|###|</turn>|: )")


def escape(text: str, role: bool = False) -> str:
    """Put a backslash before each backslash and control string (in a role, before ': ' too)."""
    return (_ESCAPE_ROLE if role else _ESCAPE).sub(lambda m: "\\" + m[0], text)


def unescape(text: str) -> str:
    return _UNESCAPE.sub(lambda m: m[1], text)


@lru_cache(maxsize=2)
def load_encoding(path: str = VOCABULARY):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("chat", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}), max(ranks.values()) + 1


def encode_turn(role: str | None, text: str | None, trained: bool, path: str = VOCABULARY) -> tuple[np.ndarray, np.ndarray, str]:
    """Token ids of one turn, the loss mask beside them, and the turn as text."""
    encoding, free = load_encoding(path)
    role, text = escape(role or "", role=True), escape(text or "")
    parts = [[free], encoding.encode_ordinary(role), [free + 1], encoding.encode_ordinary(text), [free + 2]]
    ids = np.concatenate([np.asarray(p, dtype=np.int32) for p in parts])
    step = np.zeros(len(ids) + 1, dtype=np.int8)
    if trained:
        begin = 2 + len(parts[1])
        step[begin] += 1
        step[begin + len(parts[3])] -= 1
    return ids, np.cumsum(step)[:-1].astype(bool), f"{TURN}{role}{SEP}{text}{END}"


def decode_turn(ids: np.ndarray, mask: np.ndarray, path: str = VOCABULARY) -> tuple[str, str, str]:
    """Role, text and the text under the loss mask, unescaped, from ids and mask alone."""
    encoding, free = load_encoding(path)
    marks = np.flatnonzero(ids >= free)
    if ids[marks].tolist() != [free, free + 1, free + 2]:
        raise ValueError("not one formatted turn")
    role, text = (unescape(encoding.decode(ids[a + 1 : b].tolist())) for a, b in zip(marks[:-1], marks[1:], strict=True))
    return role, text, unescape(encoding.decode(ids[mask].tolist()))


TURNS_SCHEMA = "conv_id long, turn long, role string, token_ids array<int>, loss_mask array<boolean>, formatted string"


def format_turns(conversations: DataFrame, train_roles: tuple[str, ...] = ("assistant",), path: str = VOCABULARY) -> DataFrame:
    """One row a turn: conv_id, turn, role, token_ids, loss_mask, formatted.

    The formatted conversation is its turns' rows one after another, by turn. Each turn is
    formatted by itself, so nothing is shuffled and no conversation, however long, is gathered.
    conversations: conv_id, turn, role, text; more columns are ignored. A null text or role is an
    empty one, rows without a conv_id are one conversation, repeated turns are kept, and an empty
    table gives no rows. The vocabulary's path must be readable on every executor.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 1000):
                part = batch.slice(lo, 1000)
                done = [encode_turn(r, t, r in train_roles, path) for r, t in zip(part.column(2).to_pylist(), part.column(3).to_pylist(), strict=True)]
                at = np.cumsum([0, *(len(d[0]) for d in done)]).astype(np.int32)
                ids, mask = (np.concatenate([d[k] for d in done]) for k in (0, 1))
                lists = [pa.ListArray.from_arrays(pa.array(at), pa.array(x)) for x in (ids, mask)]
                yield pa.RecordBatch.from_arrays([*[part.column(k) for k in range(3)], *lists, pa.array([d[2] for d in done], pa.string())], ["conv_id", "turn", "role", "token_ids", "loss_mask", "formatted"])

    rows = bounded_batches(conversations).selectExpr("cast(conv_id as long) conv_id", "cast(turn as long) turn", "cast(role as string) role", "cast(text as string) text")
    return rows.mapInArrow(run, TURNS_SCHEMA)


DIGEST_SCHEMA = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def conversation_digests(turns: DataFrame, path: str = VOCABULARY) -> DataFrame:
    """What op10 returns, read back from the formatted turns.

    A digest of a whole conversation is sequential, so a conversation's turns stream, sorted on
    disk by Spark, through one task that holds one turn at a time. Turns of equal number follow by
    role, a null one as empty, then by the text before escaping.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        now, state = object(), None

        def close():
            if state:
                rows.append((now, state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4]))

        for batch in batches:
            conv, ids, mask, formatted = batch.column(0).to_pylist(), batch.column(1), batch.column(2), batch.column(3).to_pylist()
            flat, on = ids.flatten().to_numpy(zero_copy_only=False), mask.flatten().to_numpy(zero_copy_only=False)
            at = np.asarray(ids.offsets) - ids.offsets[0].as_py()
            for i, c in enumerate(conv):
                if state is None or c != now:
                    close()
                    now, state = c, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                role, text, trained = decode_turn(flat[at[i] : at[i + 1]], on[at[i] : at[i + 1]], path)
                state[0] += 1
                state[1].update(f"{role}\n{text}\n".encode())
                state[2] += len(trained)
                state[3].update(trained.encode())
                state[4] += len(formatted[i])
            if len(rows) >= 1000:
                yield _digests(rows)
                rows.clear()
        close()
        yield _digests(rows)

    role = F.coalesce("role", F.lit(""))
    begin = F.length(F.regexp_replace(role, _ESCAPE_ROLE.pattern, r"\\$0")) + len(TURN) + len(SEP) + 1
    text = F.regexp_replace(F.col("formatted").substr(begin, F.length("formatted") - begin - len(END) + 1), _UNESCAPE.pattern, "$1")
    ordered = turns.repartition("conv_id").sortWithinPartitions("conv_id", "turn", role, text).select("conv_id", "token_ids", "loss_mask", "formatted")
    return ordered.mapInArrow(run, DIGEST_SCHEMA)


def _digests(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
    names = [c.split()[0] for c in DIGEST_SCHEMA.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names)


#: A conversation whose texts look like the template itself. Fixed value of the query.
TRICKY = r"\### Assistant: </turn> ok"


def with_tricky(spark: SparkSession, conversations: DataFrame) -> DataFrame:
    rows = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.element_at(F.array(F.lit("user"), F.lit("assistant")), (F.col("id") + 1).cast("int")).alias("role"), F.lit(TRICKY).alias("text"))
    return conversations.select("conv_id", "turn", "role", "text").unionByName(rows)
