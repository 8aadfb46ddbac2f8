"""Which tokens of two tokenizers share bytes of a text.

Both token sequences tile the same bytes. In a batch of documents laid end to end, pandas.merge_asof
finds for each token start the other side's token that covers it; of two tokens that share bytes one
starts inside the other, so both directions together give every overlap. The key of the merge is a
document's place in the batch plus the offset in it, one sorted whole number: both sides have a token
at each document's first byte, so no match leaves its document. Where tokens of both sides end at
the same byte, a group of tokens ends.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import chain, compress, pairwise

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .chat_format import PATTERN
from .common import bounded_batches, sha256_hex, stage_table

BYTE_BPE = "/opt/tokenizers/byte_bpe_50k.json"
PIECE_BPE = "/opt/tokenizers/piece_bpe_32k.model"
#: The white space of Unicode by its bytes in UTF-8. Fixed values.
_WHITE = [c.encode() for c in "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"]
#: Segments that a worker remembers at most between batches and their bytes, how many it encodes at a time, and
#: how many of up to so many bytes each it joins to one text for that.
REMEMBERED, REMEMBERED_BYTES, ENCODED, JOINED, JOINED_BYTES = 1 << 18, 1 << 23, 1 << 14, 1 << 6, 1 << 8
#: Id pairs whose counts every task holds; those of rarer pairs are joined.
HELD_PAIRS = 1 << 20


def byte_level_alphabet() -> dict[str, int]:
    """The character that stands for each byte in a byte-level vocabulary: printable ones for themselves, the others from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


class ByteLevel:
    """The byte-level vocabulary: token ids of texts, and each id's bytes.

    A faster encoder takes two neighbours whose union is in the vocabulary, in the order of ids, where the
    file lists which two make a token. Both take the same steps if each token, encoded by the listed merges,
    is itself: two tokens that tile a third one's bytes are then at the point where its own two parts stand.
    That is checked for every token; a vocabulary that doesn't pass is encoded by its own library.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        tokenizer.encode_special_tokens = True
        alphabet = byte_level_alphabet()
        special = {t.content for t in tokenizer.get_added_tokens_decoder().values()}
        vocabulary = tokenizer.get_vocab()
        self.bytes = [b""] * len(vocabulary)
        for token, i in vocabulary.items():
            self.bytes[i] = bytes(alphabet[c] for c in token) if token not in special and all(c in alphabet for c in token) else token.encode()
        plain = {t: i for t, i in vocabulary.items() if t not in special}
        merged = all(len(parts := tokenizer.model.tokenize(t)) == 1 and parts[0].id == i for t, i in plain.items())
        self.ranked = self.tokenizer = None
        if merged and len({self.bytes[i] for i in plain.values()} & {bytes([b]) for b in range(256)}) == 256 and tokenizer.normalizer is None:
            import tiktoken

            self.ranked = tiktoken.Encoding("listed", pat_str=PATTERN, mergeable_ranks={self.bytes[i]: i for i in plain.values()}, special_tokens={})
        else:
            self.tokenizer = tokenizer

    def encode(self, texts: list[str]) -> list[list[int]]:
        if self.ranked is not None:
            return [self.ranked.encode_ordinary(t) for t in texts]
        return [e.ids for e in self.tokenizer.encode_batch(texts, add_special_tokens=False)]


class Pieces:
    """The piece vocabulary, which puts a space before a text: token ids of texts that begin with a space."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        names = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        if any("▁" in n.lstrip("▁") for n in names):
            raise ValueError("pieces cross spaces: segments can't be encoded by themselves")
        self.bytes = [bytes([int(n[3:5], 16)]) if self.model.is_byte(i) else n.replace("▁", " ").encode() for i, n in enumerate(names)]

    def encode(self, texts: list[str]) -> list[list[int]]:
        """No piece crosses from a letter to a space, so what follows a letter's own token is the text's."""
        first = len(self.model.encode("a"))
        return [ids[first:] for ids in self.model.encode(["a" + t for t in texts], num_threads=1)]


def _bytes_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of an Arrow string array, and where in them each text begins; the last one's end too."""
    _, offsets, values = texts.buffers()
    offs = np.frombuffer(offsets, np.int32, len(texts) + 1, texts.offset * 4) if len(texts) else np.zeros(1, np.int32)
    data = np.frombuffer(values, np.uint8) if values is not None else np.zeros(0, np.uint8)
    return data[offs[0] : offs[-1]], (offs - offs[0]).astype(np.int64)


def _after_white(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Whether a character of white space ends before each of these bytes; a text of at least one byte before must be there."""
    last = data[at - 1].astype(np.int32)
    out = np.isin(last, [w[0] for w in _WHITE if len(w) == 1])
    wide = np.flatnonzero(last >= 0x80)
    two = data[at[wide] - 2].astype(np.int32) << 8 | last[wide]
    three = data[at[wide] - 3].astype(np.int32) << 16 | two
    out[wide] = np.isin(two, [int.from_bytes(w) for w in _WHITE if len(w) == 2]) | np.isin(three, [int.from_bytes(w) for w in _WHITE if len(w) == 3])
    return out


def segments_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The segments of a space and each text one after another, and how many each text has; null and empty texts have none.

    A segment is a space that follows no white space, and all up to the next one: no token of either side
    crosses such a border, and but for a text's last one no segment ends in white space.
    """
    some = np.asarray(pc.fill_null(pc.greater(pc.binary_length(texts), 0), False))
    n = np.zeros(len(texts), np.int64)
    data, offs = _bytes_of(pc.binary_join_element_wise("", texts.filter(pa.array(some)), " "))
    spaces = np.flatnonzero(data == 0x20)
    border = np.ones(len(spaces), bool)
    inner = np.ones(len(spaces), bool)
    inner[np.searchsorted(spaces, offs[:-1])] = False
    border[inner] = ~_after_white(data, spaces[inner])
    starts = spaces[border]
    n[some] = np.diff(np.searchsorted(starts, offs))
    ends = np.append(starts, len(data)).astype(np.int32)
    return pa.Array.from_buffers(pa.string(), len(starts), [None, pa.py_buffer(ends), pa.py_buffer(data)]), n


class Ragged:
    """Rows of whole numbers in one array, added to at its end."""

    def __init__(self):
        self.flat, self.start, self.size = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def add(self, flat: np.ndarray, size: np.ndarray) -> None:
        self.start = np.concatenate([self.start, len(self.flat) + np.cumsum(size) - size])
        self.size = np.concatenate([self.size, size])
        self.flat = np.concatenate([self.flat, flat])

    def take(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The numbers of these rows one after another, and how many each has."""
        size = self.size[rows]
        at = np.repeat(self.start[rows] - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
        return self.flat[at], size

    def only(self, rows: np.ndarray) -> Ragged:
        out = Ragged()
        out.flat, out.size = self.take(rows)
        out.start = np.cumsum(out.size) - out.size
        return out


def _flat(rows: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    size = np.fromiter(map(len, rows), np.int64, len(rows))
    return np.fromiter(chain.from_iterable(rows), np.int32, int(size.sum())), size


class TwoTokenizers:
    """Encodes texts by both, each distinct segment of a batch once, and not again while it is remembered."""

    def __init__(self, a_path: str, b_path: str):
        self.a, self.b = ByteLevel(a_path), Pieces(b_path)
        self.sizes = tuple(np.fromiter(map(len, side.bytes), np.int64, len(side.bytes)) for side in (self.a, self.b))
        self.forget()

    def forget(self) -> None:
        self.known = pa.array([], pa.string())
        self.ids = (Ragged(), Ragged())
        self.exact, self.uses = np.zeros(0, bool), np.zeros(0, np.int64)

    def keep_most_used(self) -> None:
        """Forget all but half of the segments that may be remembered, those used most."""
        rows = np.argsort(-self.uses, kind="stable")[: REMEMBERED // 2]
        rows = rows[np.cumsum(np.diff(_bytes_of(self.known)[1])[rows]) <= REMEMBERED_BYTES // 2]
        self.known = self.known.take(pa.array(rows))
        self.ids = tuple(ids.only(rows) for ids in self.ids)
        self.exact, self.uses = self.exact[rows], np.zeros(len(rows), np.int64)

    def learn(self, segments: pa.Array) -> np.ndarray:
        """Encode and remember new segments; their places in `segments` in the order in which they are remembered.

        Segments that don't end in white space can follow one another in a text, and are encoded together. Those
        that do, long ones, and those of a joined text whose tokens aren't its bytes are encoded each by itself.
        """
        data, offs = _bytes_of(segments)
        joined = ~_after_white(data, offs[1:]) & (np.diff(offs) <= JOINED_BYTES)
        alone, order, parts = [np.flatnonzero(~joined)], [], []
        joined = np.flatnonzero(joined)
        for lo in range(0, len(joined), ENCODED):
            rows = joined[lo : lo + ENCODED]
            good, *ids = self._joined(segments.take(pa.array(rows)))
            order.append(rows[good])
            alone.append(rows[~good])
            parts.append((np.ones(len(order[-1]), bool), *ids))
        alone = np.concatenate(alone)
        for lo in range(0, len(alone), ENCODED):
            order.append(alone[lo : lo + ENCODED])
            parts.append(self._alone(segments.take(pa.array(order[-1])).to_pylist()))
        order = np.concatenate(order)
        self.known = pa.concat_arrays([self.known, segments.take(pa.array(order))])
        exact, flat_a, size_a, flat_b, size_b = (np.concatenate(x) for x in zip(*parts, strict=True))
        self.exact, self.uses = np.concatenate([self.exact, exact]), np.concatenate([self.uses, np.zeros(len(order), np.int64)])
        self.ids[0].add(flat_a, size_a)
        self.ids[1].add(flat_b, size_b)
        return order

    def _joined(self, segments: pa.Array) -> tuple[np.ndarray, ...]:
        """Which segments are told by joined texts, the ids of these by either side and how many each has."""
        data, offs = _bytes_of(segments)
        raw, cuts = data.tobytes(), np.append(np.arange(0, len(segments), JOINED), len(segments))
        runs = [raw[i:j] for i, j in pairwise(offs[cuts].tolist())]
        texts = [r.decode() for r in runs]
        ids = [side.encode(texts) for side in (self.a, self.b)]
        right = [all(b"".join(map(side.bytes.__getitem__, x)) == r for side, x in zip((self.a, self.b), xs, strict=True)) for r, *xs in zip(runs, *ids, strict=True)]
        good = np.repeat(right, np.diff(cuts))
        ends, out = np.cumsum(np.diff(offs)[good]), []
        for sizes, rows in zip(self.sizes, ids, strict=True):
            flat, _ = _flat(list(compress(rows, right)))
            at = np.cumsum(sizes[flat])
            last = np.searchsorted(at, ends)
            if len(ends) and not np.array_equal(at[last], ends):  # a token crosses a border
                none = np.zeros(0, np.int64)
                return np.zeros(len(segments), bool), none.astype(np.int32), none, none.astype(np.int32), none
            out += [flat, np.diff(last + 1, prepend=0)]
        return good, *out

    def _alone(self, segments: list[str]) -> tuple[np.ndarray, ...]:
        """Whether each segment's tokens are its bytes, its ids by either side and how many it has."""
        a, b = self.a.encode(segments), self.b.encode(segments)
        raw = [s.encode() for s in segments]
        exact = [b"".join([self.b.bytes[i] for i in y]) == r for y, r in zip(b, raw, strict=True)]
        if self.a.ranked is None:  # that encoder's tokens are always the text's bytes
            exact = [e and b"".join([self.a.bytes[i] for i in x]) == r for e, x, r in zip(exact, a, raw, strict=True)]
        return np.array(exact, bool), *_flat(a), *_flat(b)

    def encode(self, texts: pa.Array | list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Ids by the first, how many each text has, and the same of the second; texts that can't be tiled have none."""
        texts = pa.array(texts, pa.string()) if isinstance(texts, list) else texts
        segments, n = segments_of(texts)
        if len(self.known) > REMEMBERED or self.known.nbytes > REMEMBERED_BYTES + 8 * REMEMBERED:
            self.keep_most_used()
        distinct = segments.dictionary_encode()
        place = pc.index_in(distinct.dictionary, value_set=self.known)
        new = np.flatnonzero(np.asarray(place.is_null()))
        place = np.asarray(place.fill_null(0)).astype(np.int64)
        if len(new):
            first = len(self.known)
            order = self.learn(distinct.dictionary.take(pa.array(new)))
            place[new[order]] = first + np.arange(len(new))
        codes = place[np.asarray(distinct.indices)]
        self.uses += np.bincount(codes, minlength=len(self.uses))
        ends = np.cumsum(n)
        doc = np.repeat(np.arange(len(texts)), n)
        keep = np.ones(len(texts), bool)
        for i in np.unique(doc[~self.exact[codes]]).tolist():
            mine, want = codes[ends[i] - n[i] : ends[i]], b" " + texts[i].as_py().encode()
            keep[i] = all(b"".join([side.bytes[k] for k in ids.take(mine)[0]]) == want for side, ids in zip((self.a, self.b), self.ids, strict=True))
        if not keep.all():
            codes, doc = codes[keep[doc]], doc[keep[doc]]
        out: list[np.ndarray] = []
        for ids in self.ids:
            flat, size = ids.take(codes)
            out += [flat, np.bincount(doc, weights=size, minlength=len(texts)).astype(np.int64)]
        return out[0], out[1], out[2], out[3]


@lru_cache(maxsize=2)
def two_tokenizers(a_path: str, b_path: str) -> TwoTokenizers:
    return TwoTokenizers(a_path, b_path)


@lru_cache(maxsize=2)
def byte_sizes(a_path: str, b_path: str) -> tuple[np.ndarray, np.ndarray]:
    both = two_tokenizers(a_path, b_path)
    both.forget()  # who asks for sizes doesn't encode
    return both.sizes


def align(a_bytes: np.ndarray, b_bytes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Links (positions in both sides, in order of the byte where the overlap begins) and group ends (tokens of both sides up to each).

    a_bytes and b_bytes: the byte lengths of the tokens of all documents, which tile the same bytes.
    """
    end_a, end_b = np.cumsum(a_bytes), np.cumsum(b_bytes)
    start_a, start_b = end_a - a_bytes, end_b - b_bytes
    tokens_a, tokens_b = pd.DataFrame({"at": start_a, "a": np.arange(len(end_a))}), pd.DataFrame({"at": start_b, "b": np.arange(len(end_b))})
    if not len(end_a):
        none = np.zeros(0, np.int64)
        return none, none, none, none
    of_a, of_b = pd.merge_asof(tokens_a, tokens_b, on="at"), pd.merge_asof(tokens_b, tokens_a, on="at")
    covering = of_b["a"].to_numpy()
    later = start_a[covering] != start_b  # equal starts are links of the other direction already
    at = np.concatenate([start_a, start_b[later]])
    order = np.argsort(at, kind="stable")
    link_a, link_b = np.concatenate([np.arange(len(end_a)), covering[later]])[order], np.concatenate([of_a["b"].to_numpy(), np.flatnonzero(later)])[order]
    near = np.searchsorted(end_b, end_a)
    both = end_b[near] == end_a
    return link_a, link_b, np.flatnonzero(both) + 1, near[both] + 1


def _lists(values: np.ndarray, counts: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)), pa.array(values.astype(np.int32)))


def encode_two_ways(docs: DataFrame, a_path: str = BYTE_BPE, b_path: str = PIECE_BPE) -> DataFrame:
    """doc_id, a_ids, b_ids: the token ids of a space and the text by both tokenizers, special strings as plain text.

    Both lists are empty where the text is null or empty, or where the tokens' bytes on either side are
    not those of the space and the text. Rows without a doc_id and repeated rows stay; other columns
    are ignored; an empty table gives no rows. Map-only; the vocabularies must be readable on every executor.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = two_tokenizers(a_path, b_path)
        for batch in batches:
            a, n_a, b, n_b = both.encode(batch.column(1))
            yield from _parts([pa.RecordBatch.from_arrays([batch.column(0), _lists(a, n_a), _lists(b, n_b)], ["doc_id", "a_ids", "b_ids"])], 1)

    return bounded_batches(docs).selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text").mapInArrow(run, "doc_id long, a_ids array<int>, b_ids array<int>")


def _sides(batch: pa.RecordBatch, first: int) -> tuple[np.ndarray, ...]:
    """Ids of both sides of a batch and how many each row has."""
    out = []
    for k in (first, first + 1):
        column = batch.column(k)
        out += [column.flatten().to_numpy(zero_copy_only=False), np.diff(np.asarray(column.offsets))]
    return tuple(out)


def _parts(batches: Iterable[pa.RecordBatch], first: int, tokens: int = 1 << 17) -> Iterator[pa.RecordBatch]:
    """The rows of batches, about so many tokens of the list column `first` at a time; a longer row is a part of its own."""
    for batch in batches:
        ends = np.asarray(batch.column(first).offsets)
        lo = 0
        while lo < batch.num_rows:
            hi = min(batch.num_rows, max(lo + 1, int(np.searchsorted(ends, ends[lo] + tokens, "right")) - 1))
            yield batch.slice(lo, hi - lo)
            lo = hi


def align_tokens(encoded: DataFrame, a_path: str = BYTE_BPE, b_path: str = PIECE_BPE) -> DataFrame:
    """encoded (doc_id, a_ids, b_ids) with link_a and link_b (token positions from 0, a link each), and group_a and group_b (tokens of each side up to each group's end)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sizes = byte_sizes(a_path, b_path)
        for batch in _parts(batches, 1):
            a, n_a, b, n_b = _sides(batch, 1)
            link_a, link_b, group_a, group_b = align(sizes[0][a], sizes[1][b])
            first_a, first_b = np.cumsum(n_a) - n_a, np.cumsum(n_b) - n_b
            of_link, of_group = np.repeat(np.arange(len(n_a)), n_a)[link_a], np.repeat(np.arange(len(n_a)), n_a)[group_a - 1]
            links, groups = np.bincount(of_link, minlength=len(n_a)), np.bincount(of_group, minlength=len(n_a))
            lists = [_lists(link_a - first_a[of_link], links), _lists(link_b - first_b[of_link], links), _lists(group_a - first_a[of_group], groups), _lists(group_b - first_b[of_group], groups)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *lists], [*batch.schema.names, "link_a", "link_b", "group_a", "group_b"])

    return bounded_batches(encoded).select("doc_id", "a_ids", "b_ids").mapInArrow(run, "doc_id long, a_ids array<int>, b_ids array<int>, link_a array<int>, link_b array<int>, group_a array<int>, group_b array<int>")


def pair_counts(encoded: DataFrame, a_path: str = BYTE_BPE, b_path: str = PIECE_BPE) -> DataFrame:
    """pair (first id times the second vocabulary's size, plus second id) and n, the links of the corpus that hold it. Summed in tasks first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sizes = byte_sizes(a_path, b_path)
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def total() -> None:
            pairs, place = np.unique(np.concatenate([p for p, _ in held]), return_inverse=True)
            held[:] = [(pairs, np.bincount(place, weights=np.concatenate([n for _, n in held])).astype(np.int64))]

        for batch in _parts(batches, 0):
            a, _, b, _ = _sides(batch, 0)
            link_a, link_b, _, _ = align(sizes[0][a], sizes[1][b])
            held.append(np.unique(a[link_a].astype(np.int64) * len(sizes[1]) + b[link_b], return_counts=True))
            if sum(len(p) for p, _ in held[1:]) > max(1 << 20, len(held[0][0])):
                total()
        if held:
            total()
            for lo in range(0, len(held[0][0]), 1 << 16):
                yield pa.RecordBatch.from_arrays([pa.array(x[lo : lo + (1 << 16)]) for x in held[0]], ["pair", "n"])

    return bounded_batches(encoded).select("a_ids", "b_ids").mapInArrow(run, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))


def _held(counts: DataFrame, most: int) -> dict[str, np.ndarray]:
    """The counts of at most `most` pairs, the most frequent: whole steps of a quarter of a doubling, told from a histogram of some 250 rows."""
    step = F.floor(F.log2("n") * 4)
    sizes = sorted(((r["step"], r["count"]) for r in counts.groupBy(step.alias("step")).count().collect()), reverse=True)
    least, total = None, 0
    for s, n in sizes:
        if total + n > most:
            break
        least, total = s, total + n
    rows = counts.filter(step >= least) if least is not None else counts.limit(0)
    t = rows.select("pair", "n", "best").toArrow()
    pair = t.column("pair").to_numpy()
    order = np.argsort(pair)
    return {"pair": pair[order], "n": t.column("n").to_numpy()[order], "best": t.column("best").to_numpy(zero_copy_only=False).astype(bool)[order]}


@lru_cache(maxsize=2)
def _names(n_a: int, n_b: int) -> pa.Array:
    """Each id of the first side, then each of the second: with the mark between two of a group, and with the one after a group's last."""
    return pa.array([f"{i}{mark}" for n, marks in ((n_a, ",|"), (n_b, ",;")) for i in range(n) for mark in marks], pa.large_string())


def _group_bytes(a: np.ndarray, b: np.ndarray, group_a: np.ndarray, group_b: np.ndarray, n_ids: tuple[int, int]) -> tuple[np.ndarray, np.ndarray]:
    """All tokens of both sides in order of groups, first side first, each id with the mark that follows it: their bytes, and where each token's begin; the last one's end too."""
    size_a, size_b = np.diff(group_a, prepend=0), np.diff(group_b, prepend=0)
    last_a, last_b = np.zeros(len(a), bool), np.zeros(len(b), bool)
    last_a[group_a - 1], last_b[group_b - 1] = True, True
    out = np.empty(len(a) + len(b), np.int64)
    out[np.arange(len(a)) + np.repeat(group_b - size_b, size_a)] = a.astype(np.int64) * 2 + last_a
    out[np.arange(len(b)) + np.repeat(group_a, size_b)] = (n_ids[0] + b.astype(np.int64)) * 2 + last_b
    if not len(out):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, values = _names(*n_ids).take(pa.array(out)).buffers()
    return np.frombuffer(values, np.uint8), np.frombuffer(offsets, np.int64, len(out) + 1)


def alignment_query(docs: DataFrame, a_path: str = BYTE_BPE, b_path: str = PIECE_BPE, held_pairs: int = HELD_PAIRS) -> DataFrame:
    """What op11 returns: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.

    Tokens are written once. A first pass over them counts id pairs; a second one digests each document
    with the counts of the most frequent pairs at hand (held_pairs at most, so of bounded size), and
    what a document has of rarer pairs is joined with their counts: no pair is left out. Rows are told
    apart by a number that is written with the tokens, so null and repeated doc_ids do no harm.
    """
    spark = docs.sparkSession
    tokens = stage_table(encode_two_ways(docs, a_path, b_path).withColumn("row", F.monotonically_increasing_id()), "alignment-tokens", "zstd")
    counts = stage_table(pair_counts(tokens, a_path, b_path), "alignment-pairs")
    n_b_ids = F.lit(len(Pieces(b_path).bytes))
    most = counts.groupBy((F.col("pair") % n_b_ids).alias("_b")).agg(F.max("n").alias("_most"))  # at most a row for each id of the vocabulary
    counts = stage_table(counts.join(F.broadcast(most), F.col("pair") % n_b_ids == F.col("_b")).select("pair", "n", (F.col("n") == F.col("_most")).alias("best")), "alignment-counts")
    held = spark.sparkContext.broadcast(_held(counts, held_pairs))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sizes, known = byte_sizes(a_path, b_path), held.value
        pairs = len(sizes[0]) * len(sizes[1])
        for batch in _parts(batches, 2):
            a, n_a, b, n_b = _sides(batch, 2)
            rows = len(n_a)
            link_a, link_b, group_a, group_b = align(sizes[0][a], sizes[1][b])
            row_of = np.repeat(np.arange(rows), n_a)
            of_link, n_groups = row_of[link_a], np.bincount(row_of[group_a - 1], minlength=rows)
            n_links = np.bincount(of_link, minlength=rows)
            data, starts = _group_bytes(a, b, group_a, group_b, (len(sizes[0]), len(sizes[1])))
            ends = starts[np.append(0, np.cumsum(n_a + n_b))].tolist()
            shas = [sha256_hex(data[lo : hi - 1]) if hi > lo else "" for lo, hi in pairwise(ends)]
            pair = a[link_a].astype(np.int64) * len(sizes[1]) + b[link_b]
            code, distinct = pd.factorize(pair)
            at = np.searchsorted(known["pair"], distinct)
            at[at == len(known["pair"])] = 0
            found = known["pair"][at] == distinct if len(known["pair"]) else np.zeros(len(distinct), bool)
            at, found = at[code], found[code]
            at, mine = at[found], of_link[found]
            n_best, count_sum = np.bincount(mine[known["best"][at]], minlength=rows), np.zeros(rows, np.int64)
            np.add.at(count_sum, mine, known["n"][at])
            rare, times = np.unique(of_link[~found] * pairs + pair[~found], return_counts=True)
            offsets = pa.array(np.searchsorted(rare, np.arange(rows + 1) * pairs).astype(np.int32))
            lists = [pa.ListArray.from_arrays(offsets, pa.array(x.astype(np.int64))) for x in (rare % pairs, times)]
            columns = [pa.array(x.astype(np.int64)) for x in (n_a, n_b, n_groups, n_links, n_best, count_sum)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *columns, pa.array(shas), *lists], ["row", "doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256", "rare", "times"])

    schema = "row long, doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string, rare array<long>, times array<long>"
    digests = stage_table(tokens.select("row", "doc_id", "a_ids", "b_ids").mapInArrow(run, schema), "alignment-digests", "zstd")
    rare = digests.select("row", F.explode(F.arrays_zip("rare", "times")).alias("r")).select("row", F.col("r.rare").alias("pair"), F.col("r.times").alias("times"))
    rest = rare.join(counts, "pair").groupBy("row").agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("_best"), F.sum(F.col("times") * F.col("n")).alias("_sum"))
    out = digests.drop("rare", "times").join(rest, "row", "left")
    return out.select("doc_id", "n_a", "n_b", "n_groups", "n_links", (F.col("n_best") + F.coalesce("_best", F.lit(0))).alias("n_best"), (F.col("count_sum") + F.coalesce("_sum", F.lit(0))).alias("count_sum"), "groups_sha256")
