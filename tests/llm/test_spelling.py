"""op12 against brute force, and its blocks against all pairs."""

import collections
import re
import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tests.llm.test_llm import SCHEMA, TEXTS
from tideline.llm import spelling

RUN = re.compile("[A-Za-zÀ-ÿ]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) - len(a) == 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def brute_words(rows, every=97):
    n = collections.Counter()
    for doc_id, text in rows:
        for run in RUN.findall(text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % every == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += 1
    return {w: k for w, k in n.items() if len(w) >= 5 and k >= 3}


def brute_groups(n):
    near = {w: [v for v in n if one_edit(w, v)] for w in n}
    form = {}
    for w, vs in near.items():
        best = min(vs, key=lambda v: (-n[v], v), default=None)
        form[w] = best if best and n[best] >= 2 * n[w] else None

    def root(w):
        return root(form[w]) if form[w] else w

    return sorted((w, form[w], root(w), n[w], len(near[w]), n.get(form[w])) for w in n)


def got_rows(df):
    return sorted(tuple(r[c] for c in ("word", "form", "root", "n", "n_near", "form_n")) for r in df.collect())


WORDS = "house hoose houses horse mouse mouses spouse letter lettre better bitter butter étude etude etudes étüde straße strasse aaaaa aaaaaa aaaaaaa abcde abced abcdef".split()


def test_groups_with_ties_chains_and_odd_rows(spark):
    text = " ".join(" ".join([w.upper() if k % 3 == 0 else w.capitalize()] * (3 + k * k % 17 * 2 ** (k % 5))) for k, w in enumerate(WORDS))
    rows = list(enumerate([*TEXTS, text, text.replace(" ", "9"), None])) + [(6, TEXTS[6]), (None, "nobody nobody nobody nobodi nobody nobody"), (3, "x" * 5000 + " " + "x" * 5001)] + [(k, "x" * 5000 + " " + "x" * 5001) for k in (50, 51)]
    docs = spark.createDataFrame([(i, t, "en", "s", None, "clash", "clash") for i, t in rows], SCHEMA).repartition(3)
    want = brute_groups(brute_words(rows))
    assert any(w[1] and w[1] != w[2] for w in want) and any(w[4] > 1 for w in want)
    assert got_rows(spelling.variant_groups(spelling.misspelt_words(docs))) == want
    seven = spelling.misspelt_words(docs, every=7)
    assert {r["word"]: r["n"] for r in seven.collect()} == brute_words(rows, 7) != brute_words(rows)


@pytest.mark.parametrize("block", [3, 2048])
def test_all_documents_in_small_and_large_blocks(spark, monkeypatch, block):
    monkeypatch.setattr(spelling, "BLOCK_WORDS", block)
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    assert got_rows(spelling.variant_groups(spelling.misspelt_words(docs))) == brute_groups(brute_words(rows))


def test_empty_table(spark):
    assert spelling.variant_groups(spelling.misspelt_words(spark.createDataFrame([], SCHEMA))).collect() == []


@settings(max_examples=100, deadline=None)
@given(st.lists(st.text(alphabet="abcéÿÀ", min_size=3, max_size=3), min_size=1, max_size=12, unique=True), st.lists(st.text(alphabet="abcéÿÀ", min_size=3, max_size=4), min_size=1, max_size=12, unique=True))
def test_blocks_find_each_edit(left, right):
    i, j = spelling.near_in_blocks(left, left, True)
    assert sorted(zip(i, j, strict=True)) == [(a, b) for a in range(len(left)) for b in range(a + 1, len(left)) if one_edit(left[a], left[b])]
    for size in (3, 4):
        part = [w for w in right if len(w) == size]
        if part:
            i, j = spelling.near_in_blocks(left, part, False)
            assert sorted(zip(i, j, strict=True)) == [(a, b) for a in range(len(left)) for b in range(len(part)) if one_edit(left[a], part[b])]


def test_near_cells_hold_every_edit():
    def cell(w):
        codes, size = spelling._codes([w])
        return [int((codes % spelling.GROUPS == g).sum()) for g in range(spelling.GROUPS)]

    words = ["abcdef", "abcdeg", "abcdefg", "zbcdef", "abcef", "ébcdef"]
    import numpy as np

    for a in words:
        for b in words:
            if one_edit(a, b):
                assert (cell(b) in spelling.near_cells(np.array(cell(a)))) + (cell(a) in spelling.near_cells(np.array(cell(b)))) >= 1
