"""Spelling variants: words one edit apart, found by Gram matrices of letter counts.

A word is its vector of letter counts. One replaced letter moves it by a squared distance of 2, one
letter more or less by 1, so pairs beyond 2 are out. Squared distances of two blocks of words are a
matrix product. Words are blocked by their letter counts summed over a few groups of letters: an edit
moves these sums by one letter in one group or from one group to another, so each block meets its own
and neighbouring ones only, of its length and the next, and each pair of words meets once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, stage_table

#: Groups of letters that make a block's key, by code point; and the most words and bytes of a block.
GROUPS = 6
BLOCK_WORDS, BLOCK_BYTES = 2048, 1 << 18
#: Letters: a-z and U+00C0 to U+00FF (A-Z are lower-cased before).
_OTHERS = 0xC0 - 26


def letter_runs(docs: DataFrame) -> DataFrame:
    """doc_id and run, a row for each maximal run of letters in the text, A-Z lower-cased."""
    text = F.translate(F.col("text").cast("string"), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return docs.select(F.col("doc_id").cast("string").alias("doc_id"), F.explode(F.regexp_extract_all(text, F.lit("[a-zÀ-ÿ]+"), F.lit(0))).alias("run"))


def misspelt_words(docs: DataFrame, every: int = 97, least_chars: int = 5, least_count: int = 3) -> DataFrame:
    """word and n: distinct words of the corpus with their occurrences, some of them with a letter taken out.

    A run whose checksum with its doc_id is divisible by `every` loses the letter at that checksum modulo
    its length. Words have at least least_chars letters and least_count occurrences. A null text has no
    words, a null doc_id counts as an empty one, repeated rows count again, other columns are ignored,
    and an empty table gives no words. Counts are summed in tasks before the shuffle.
    """
    runs = letter_runs(docs).filter(F.length("run") >= least_chars)
    h = F.crc32(F.encode(F.concat(F.coalesce("doc_id", F.lit("")), F.lit(":"), F.col("run")), "UTF-8"))
    at = (h % F.length("run")).cast("int")
    cut = F.concat(F.col("run").substr(F.lit(1), at), F.col("run").substr(at + 2, F.length("run")))
    words = runs.select(F.when(h % every == 0, cut).otherwise(F.col("run")).alias("word")).filter(F.length("word") >= least_chars)
    return words.groupBy("word").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least_count)


def _codes(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Letters of all words, from 0 to 89, one after another, and how many each word has."""
    size = np.fromiter(map(len, words), np.int64, len(words))
    points = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).astype(np.int64)
    return np.where(points < 128, points - 97, points - _OTHERS), size


def letter_counts(codes: np.ndarray, size: np.ndarray) -> np.ndarray:
    return np.bincount(np.repeat(np.arange(len(size)), size) * 90 + codes, minlength=len(size) * 90).reshape(-1, 90)


def near_in_blocks(left: list[str], right: list[str], same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the pairs one edit apart: left's words all have one length, right's the same or one more. same: one block with itself, each pair once."""
    (codes_l, size_l), (codes_r, size_r) = _codes(left), _codes(right)
    x, y = letter_counts(codes_l, size_l), letter_counts(codes_r, size_r)
    kind = np.float32 if max(len(left[0]), len(right[0])) < 1 << 11 else np.float64  # whole numbers stay exact
    gram = x.astype(kind) @ y.astype(kind).T
    squared = (x * x).sum(axis=1)[:, None] + (y * y).sum(axis=1)[None, :] - 2 * gram
    i, j = np.nonzero(squared <= 2)
    if same:
        i, j = i[i < j], j[i < j]
    a, b = codes_l.reshape(len(left), -1)[i], codes_r.reshape(len(right), -1)[j]
    if a.shape[1] == b.shape[1]:
        ok = (a != b).sum(axis=1) == 1
    else:
        head = np.logical_and.accumulate(a == b[:, :-1], axis=1).sum(axis=1)
        tail = np.logical_and.accumulate((a == b[:, 1:])[:, ::-1], axis=1).sum(axis=1)
        ok = head + tail >= a.shape[1]
    return i[ok], j[ok]


def _cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """word, n and the word's cell: its letters in each group."""
    for batch in batches:
        words = batch.column(0).to_pylist()
        codes, size = _codes(words)
        sums = np.bincount(np.repeat(np.arange(len(words)), size) * GROUPS + codes % GROUPS, minlength=len(words) * GROUPS)
        cells = pa.ListArray.from_arrays(pa.array(np.arange(0, len(sums) + 1, GROUPS, dtype=np.int32)), pa.array(sums.astype(np.int32)))
        yield pa.RecordBatch.from_arrays([*batch.columns, cells], ["word", "n", "cell"])


def near_cells(cell: np.ndarray) -> list[list[int]]:
    """The cell itself, those a letter of one group away in another (each such pair of cells once), and those with one letter more."""
    out = [cell]
    for g in range(GROUPS):
        more = cell.copy()
        more[g] += 1
        out.append(more)
        for h in range(g):
            if more[h] > 0:
                moved = more.copy()
                moved[h] -= 1
                out.append(moved)
    return [c.tolist() for c in out]


def _neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        flat, at = [], [0]
        for cell in batch.column(0).to_pylist():
            flat += near_cells(np.array(cell))
            at.append(len(flat))
        lists = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(flat, pa.list_(pa.int32())))
        yield pa.RecordBatch.from_arrays([*batch.columns, lists], ["cell", "near"])


def near_words(words: DataFrame) -> DataFrame:
    """word, other and n of other: all ordered pairs of words that differ by exactly one letter put in, taken out or replaced.

    words: word (distinct, of letters a-z and U+00C0 to U+00FF, not empty) and n. A cell of many words is
    several blocks, whose pairs are dealt out singly, so no task is given a whole cell.
    """
    celled = stage_table(bounded_batches(words).select("word", F.col("n").cast("long").alias("n")).mapInArrow(_cells, "word string, n long, cell array<int>"), "spelling-cells")
    sizes = celled.groupBy("cell").agg(F.count(F.lit(1)).alias("_words"), F.sum(F.octet_length("word")).alias("_bytes")).select("cell", F.greatest(F.ceil(F.col("_words") / BLOCK_WORDS), F.ceil(F.col("_bytes") / BLOCK_BYTES)).cast("int").alias("blocks"))
    sizes = stage_table(sizes, "spelling-sizes")
    dealt = celled.join(sizes, "cell").withColumn("block", F.pmod(F.xxhash64("word"), "blocks").cast("int"))
    blocks = stage_table(dealt.groupBy("cell", "block").agg(F.sort_array(F.collect_list(F.struct("word", "n"))).alias("of")), "spelling-blocks")
    meets = sizes.select("cell").mapInArrow(_neighbours, "cell array<int>, near array<array<int>>").select("cell", F.explode("near").alias("near"))
    right_sizes = sizes.select(F.col("cell").alias("near"), F.col("blocks").alias("_of_near"))
    pairs = meets.join(right_sizes, "near")
    left = blocks.select("cell", "block", F.col("of").alias("left")).join(pairs, "cell")
    left = left.withColumn("_first", F.when(F.col("cell") == F.col("near"), F.col("block")).otherwise(0))
    left = left.withColumn("near_block", F.explode(F.when(F.col("_first") < F.col("_of_near"), F.sequence("_first", F.col("_of_near") - 1))))
    right = blocks.select(F.col("cell").alias("near"), F.col("block").alias("near_block"), F.col("of").alias("right"))
    both = left.join(right, ["near", "near_block"]).select("left", "right", ((F.col("cell") == F.col("near")) & (F.col("block") == F.col("near_block"))).alias("same"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                x, y = ((lambda v: (v.field("word").to_pylist(), v.field("n").to_numpy()))(batch.column(c)[k].values) for c in (0, 1))
                i, j = near_in_blocks(x[0], y[0], batch.column(2)[k].as_py())
                if len(i):
                    a, b = np.asarray(x[0], object), np.asarray(y[0], object)
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([a[i], b[j]]), pa.string()), pa.array(np.concatenate([b[j], a[i]]), pa.string()), pa.array(np.concatenate([y[1][j], x[1][i]]))], ["word", "other", "other_n"])

    return both.mapInArrow(run, "word string, other string, other_n long")


def roots(links: DataFrame) -> DataFrame:
    """word and root of links(word, form or null): the last word reached by going from form to form.

    Each round jumps twice as far, so a chain of k steps takes log2(k) rounds; forms must not run in circles.
    """
    now = stage_table(links.select("word", F.coalesce("form", "word").alias("root")), "spelling-roots")
    while True:
        jump = now.select(F.col("word").alias("_at"), F.col("root").alias("_next"))
        new = stage_table(now.join(jump, F.col("root") == F.col("_at")).select("word", F.col("_next").alias("root"), (F.col("_next") != F.col("root")).alias("moved")), "spelling-roots")
        now = new.select("word", "root")
        if new.filter("moved").isEmpty():
            return now


def variant_groups(words: DataFrame) -> DataFrame:
    """What op12 returns: word, form, root, n, n_near, form_n for each of words(word, n).

    form: the near word of largest n (ties: the first in code-point order) if that is at least twice the
    word's own; root: where forms lead. Since n at least doubles from form to form, chains are short.
    """
    words = stage_table(words.select("word", F.col("n").cast("long").alias("n")), "spelling-words")
    best = near_words(words).groupBy("word").agg(F.count(F.lit(1)).alias("_near"), F.min_by(F.struct("other", "other_n"), F.struct(-F.col("other_n"), F.col("other"))).alias("_best"))
    is_form = F.col("_best.other_n") >= 2 * F.col("n")
    formed = words.join(best, "word", "left").select("word", "n", F.coalesce("_near", F.lit(0)).cast("long").alias("n_near"), F.when(is_form, F.col("_best.other")).alias("form"), F.when(is_form, F.col("_best.other_n")).alias("form_n"))
    formed = stage_table(formed, "spelling-forms")
    return formed.join(roots(formed), "word").select("word", "form", "root", "n", "n_near", "form_n")
