"""op11 against brute force: every overlap by comparing byte ranges, counts over all links."""

import collections
import hashlib
import re

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tests.llm.test_llm import SCHEMA, TEXTS
from tideline.llm import token_alignment as ta
from tideline.llm.queries import QUERIES

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def sides():
    both = ta.two_tokenizers(ta.BYTE_BPE, ta.PIECE_BPE)
    return both.a, both.b


def direct(sides, text):
    """Ids of both sides by one call each on the whole text."""
    if not text:
        return [], []
    a, b = sides[0].encode([" " + text])[0], sides[1].model.encode(text, num_threads=1)
    want = (" " + text).encode()
    same = all(b"".join(s.bytes[i] for i in ids) == want for s, ids in zip(sides, (a, b), strict=True))
    return (a, b) if same else ([], [])


def brute(sides, rows):
    """The rows of op11, all overlaps found by comparing every pair of neighbouring byte ranges."""
    links, out = [], []
    counts = collections.Counter()
    for doc_id, text in rows:
        a, b = direct(sides, text)
        ranges = []
        for s, ids in zip(sides, (a, b), strict=True):
            ends = np.cumsum([0, *(len(s.bytes[i]) for i in ids)])
            ranges.append(list(zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)))
        mine, j0 = [], 0
        for i, (lo, hi) in enumerate(ranges[0]):
            while ranges[1][j0][1] <= lo:
                j0 += 1
            j = j0
            while j < len(b) and ranges[1][j][0] < hi:
                mine.append((a[i], b[j]))
                j += 1
        cut = sorted({e for _, e in ranges[0]} & {e for _, e in ranges[1]})
        groups, i, j = [], 0, 0
        for end in cut:
            i0, j0 = i, j
            while i < len(a) and ranges[0][i][1] <= end:
                i += 1
            while j < len(b) and ranges[1][j][1] <= end:
                j += 1
            groups.append((",".join(map(str, a[i0:i])), ",".join(map(str, b[j0:j]))))
        counts.update(mine)
        links.append(mine)
        out.append((doc_id, len(a), len(b), len(cut), len(mine), groups))
    top = collections.defaultdict(int)
    for (_, y), n in counts.items():
        top[y] = max(top[y], n)
    return [(d, x, y, g, n, sum(counts[p] == top[p[1]] for p in m), sum(counts[p] for p in m), hashlib.sha256(";".join(f"{p}|{q}" for p, q in gs).encode()).hexdigest() if gs else "") for (d, x, y, g, n, gs), m in zip(out, links, strict=True)]


def rows_of(df):
    return [tuple(r[c] for c in ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")) for r in df.collect()]


def same(got, want):
    key = lambda r: (r[0] is None, r[0] or 0, r[1:7])
    got, want = sorted(got, key=key), sorted(want, key=key)
    assert got == want


ODD = ["a ", " a", "\ta\n  b   c \n", "<|endoftext|> <s> </s> <unk> <0x0A>", "a▁b ▁", "it's we'LL '’", "　 x  y\x1c z\x85", "\u0000 �", "𝔘𝔫𝔦 👩‍👩‍👧 é", "0123 456789  ", "$$$ ///a/b/c", " "]


@pytest.mark.parametrize("held", [0, 1 << 20])
def test_query_on_odd_texts(spark, sides, held):
    rows = list(enumerate([*TEXTS, *ODD])) + [(6, TEXTS[6]), (6, "another text of id six"), (None, "nobody's text"), (None, "nobody's text"), (None, None)]
    docs = spark.createDataFrame([(i, t, "en", "s", None, "clash", "clash") for i, t in rows], SCHEMA).repartition(3)
    same(rows_of(ta.alignment_query(docs, held_pairs=held)), brute(sides, rows))


def test_query_on_all_documents(spark, sides):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    same(rows_of(QUERIES["op11_token_alignment"](spark, SF)), brute(sides, rows))


def test_empty_table(spark):
    assert ta.alignment_query(spark.createDataFrame([], SCHEMA)).collect() == []
    assert ta.align_tokens(ta.encode_two_ways(spark.createDataFrame([], SCHEMA))).collect() == []


@settings(max_examples=150, deadline=None)
@given(st.lists(st.one_of(st.text(max_size=40), st.text(alphabet=" \t\n ab'sé漢1.▁", max_size=60)), min_size=1, max_size=4))
def test_segments_change_nothing(texts):
    both = ta.two_tokenizers(ta.BYTE_BPE, ta.PIECE_BPE)
    a, n_a, b, n_b = both.encode(texts)
    want = [direct((both.a, both.b), t) for t in texts]
    assert a.tolist() == [x for w, _ in want for x in w] and n_a.tolist() == [len(w) for w, _ in want]
    assert b.tolist() == [x for _, w in want for x in w] and n_b.tolist() == [len(w) for _, w in want]


def test_lists_of_links_and_groups(spark, sides):
    text = "The naïve coöperation of unbelievable tokenizers, 12345 times"
    r = ta.align_tokens(ta.encode_two_ways(spark.createDataFrame([(1, text), (2, None), (3, text)], "doc_id long, text string").repartition(1))).orderBy("doc_id").collect()
    assert r[0][1:] == r[2][1:] and r[1]["link_a"] == [] and r[1]["group_b"] == []
    at_a, at_b = (np.cumsum([0, *(len(s.bytes[i]) for i in ids)]) for s, ids in zip(sides, (r[0]["a_ids"], r[0]["b_ids"]), strict=True))
    every = [(i, j) for i in range(len(at_a) - 1) for j in range(len(at_b) - 1) if at_a[i] < at_b[j + 1] and at_b[j] < at_a[i + 1]]
    assert sorted(zip(r[0]["link_a"], r[0]["link_b"], strict=True)) == every
    assert [at_a[g] for g in r[0]["group_a"]] == [at_b[g] for g in r[0]["group_b"]] == sorted(set(at_a[1:]) & set(at_b[1:]))


@settings(max_examples=200, deadline=None)
@given(st.lists(st.one_of(st.text(max_size=40), st.text(alphabet=" 　\t\n\x85\x1c ab'sLé漢1²_-<|>ǅ́‍", max_size=60)), min_size=1, max_size=4))
def test_ranks_encode_as_the_listed_merges_do(texts):
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(ta.BYTE_BPE)
    own.encode_special_tokens = True
    side = ta.two_tokenizers(ta.BYTE_BPE, ta.PIECE_BPE).a
    assert side.ranked is not None
    assert side.encode(texts) == [own.encode(t, add_special_tokens=False).ids for t in texts]


def test_new_segments_are_encoded_together(sides, monkeypatch):
    both = ta.two_tokenizers(ta.BYTE_BPE, ta.PIECE_BPE)
    both.forget()
    given_texts = []
    for side in sides:
        monkeypatch.setattr(side, "encode", lambda texts, f=side.encode: given_texts.extend(texts) or f(texts))
    words = [f"w{i * 7919 % 100003}é{i}" for i in range(20_000)]
    a, n_a, b, n_b = both.encode([" ".join(words), " ".join(reversed(words)), None, ""])
    assert len(given_texts) < 2 * len(words) // 32
    assert n_a[0] == n_a[1] and n_b[0] == n_b[1] and n_a[2:].tolist() == n_b[2:].tolist() == [0, 0]
    monkeypatch.undo()
    x, y = direct(sides, " ".join(words))
    assert a[: n_a[0]].tolist() == x and b[: n_b[0]].tolist() == y


@pytest.mark.parametrize(("name", "most"), [("REMEMBERED", 8), ("REMEMBERED_BYTES", 40), ("JOINED", 3), ("JOINED_BYTES", 4), ("ENCODED", 5)])
def test_bounds_change_no_ids(sides, monkeypatch, name, most):
    monkeypatch.setattr(ta, name, most)
    if name == "REMEMBERED_BYTES":
        monkeypatch.setattr(ta, "REMEMBERED", 16)
    both = ta.two_tokenizers(ta.BYTE_BPE, ta.PIECE_BPE)
    both.forget()
    parts = [[t, *(f"word{k}x{i}  y　z ▁ v{k}\n " for k in range(5)), t] for i, t in enumerate([*TEXTS, *ODD])]
    for texts in [*parts, *parts[::-1]]:
        a, n_a, b, n_b = both.encode(texts)
        want = [direct(sides, t) for t in texts]
        assert a.tolist() == [x for w, _ in want for x in w] and n_a.tolist() == [len(w) for w, _ in want]
        assert b.tolist() == [x for _, w in want for x in w] and n_b.tolist() == [len(w) for _, w in want]
    both.forget()


WHITE = "\\t\\n\\x0b\\x0c\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"


@settings(max_examples=300, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(max_size=30), st.text(alphabet=" \t\n\r\x0b\x0c\x1c\x85\xa0   ​    　ａéà漢Ņ", max_size=40)), max_size=5), st.integers(0, 2))
def test_segments_by_bytes(texts, skipped):
    segments, n = ta.segments_of(pa.array(texts, pa.string())[skipped:])
    border = re.compile(f" [{WHITE}]*[^{WHITE}]*(?:(?! )[{WHITE}]+[^{WHITE}]*)*")
    want = [border.findall(" " + t) if t else [] for t in texts[skipped:]]
    assert segments.to_pylist() == [s for w in want for s in w] and n.tolist() == [len(w) for w in want]
