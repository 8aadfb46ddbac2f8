"""Registered queries on all rows of a small table against brute force, a round trip or held-out accuracy."""

import collections
import hashlib
import re

import numpy as np
import pytest

from tests.llm.test_llm import WORD, brute_components, brute_repeats
from tideline.llm import chat_format, decontaminate, language_id, secret_scan
from tideline.llm.queries import QUERIES

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def texts(spark):
    return [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]


def test_language_of_held_out_documents(spark):
    got = QUERIES["op2_language_id"](spark, SF)
    acc = language_id.accuracy_by_language(got, spark.read.parquet(f"{SF}/documents.parquet").filter("lang is not null"))
    assert len(acc) >= 4 and (acc["accuracy"] >= 0.97).all()


def test_packed_rows_hold_all_tokens(spark, texts):
    encoding, _ = chat_format.load_encoding()
    pieces = collections.defaultdict(dict)
    for r in QUERIES["op3_token_packing"](spark, SF).collect():
        ids = np.frombuffer(r["input_ids"], np.uint16)
        for d, o, a, b in zip(r["doc_ids"], r["token_offsets"], r["cu_seqlens"], r["cu_seqlens"][1:], strict=False):
            assert o not in pieces[d]
            pieces[d][o] = ids[a:b].tolist()
    assert {d: [x for o in sorted(p) for x in p[o]] for d, p in pieces.items()} == {d: encoding.encode_ordinary(t) for d, t in texts if t}


def test_components_of_all_documents(spark, texts):
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in QUERIES["op4_ngram_jaccard"](spark, SF).collect()}
    assert got == brute_components(texts, 4, 85)


def test_base_spans_of_all_documents(spark, texts):
    def digest(x):
        a = [(m.start(), 0, m.end()) for m in re.finditer(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", x, re.I | re.A) if len(m[2]) >= 6]
        a += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", x) if len(m[0]) >= 20]
        a += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", x) if len(m[0]) >= 24]
        return hashlib.sha256(",".join(f"{('assign', 'access', 'hex')[k]}:{p}:{q}" for p, k, q in sorted(a)).encode()).hexdigest()

    got = {r["doc_id"]: r["base_sha256"] for r in QUERIES["op6_secret_scan"](spark, SF).collect()}
    assert got == {d: digest(t or "") for d, t in texts}


def test_entropy_finds_secrets_that_no_pattern_names(spark, texts):
    """Random keys planted in documents: nearly all are found, and few spans are anything else."""
    r = np.random.default_rng(3)
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    rows, want = [], {}
    for d, t in texts[:400]:
        words = (t or "").split(" ")
        key = "".join(r.choice(list(letters + ("+/" if d % 2 else "")), int(r.integers(24, 44))))
        at = int(r.integers(0, len(words) + 1))
        rows.append((d, " ".join([*words[:at], key, *words[at:]])))
        want[d] = key
    found = {x["doc_id"]: [s["secret"] for s in x["spans"] if s["kind"] == "entropy"] for x in secret_scan.scan_secrets(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    hit = sum(any(s in want[d] or want[d] in s for s in found[d]) for d in want)
    other = sum(not (s in want[d] or want[d] in s) for d in want for s in found[d])
    assert hit / len(want) >= 0.95 and other / len(want) <= 0.01


def test_quality_counts_of_all_documents(spark, texts):
    got = {r["doc_id"]: (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) for r in QUERIES["op7_quality_rules"](spark, SF).collect()}
    for d, t in texts:
        w = WORD.findall(t or "")
        c = collections.Counter(zip(w, w[1:], w[2:], strict=False))
        again = {i + k for i in range(len(w) - 2) if c[tuple(w[i : i + 3])] >= 2 for k in range(3)}
        lines = [x for x in (t or "").split("\n") if WORD.search(x)]
        assert got[d] == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), len(lines) - len(set(lines)), len(again), len(w) < 50 or 100 * len(again) > 50 * len(w))


def test_repeats_of_all_documents(spark, texts):
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in QUERIES["op8_repeat_removal"](spark, SF).collect()}
    assert got == {d: v for (d, _), v in brute_repeats(texts, 100).items()}


def squeezed(text):
    return " " + " ".join(re.findall(r"[^\W_]+", (text or "").lower())) + " "


def test_documents_that_hold_an_item_are_found(spark, texts):
    items = {r["item_id"]: squeezed(r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()}
    got = {(r["doc_id"], r["item_id"]) for r in QUERIES["op9_decontamination"](spark, SF).collect()}
    plain = {d: squeezed(t) for d, t in texts}
    whole = {(d, k) for d, t in plain.items() for k, item in items.items() if item in t}
    assert whole and whole <= got
    eights = {tuple(w[a : a + 8]) for w in map(str.split, items.values()) for a in range(max(1, len(w) - 7))}
    widths = {len(e) for e in eights}
    clean = {d for d, t in plain.items() if not any(tuple(w[a : a + n]) in eights for w in [t.split()] for n in widths for a in range(len(w) - n + 1))}
    assert not clean & {d for d, _ in got}


@pytest.mark.parametrize("bitmap", [1 << 22, 0])
def test_every_item_is_found_where_it_stands(spark, monkeypatch, bitmap):
    """Each item planted verbatim, by way of the bitmap and without it."""
    monkeypatch.setattr(decontaminate, "BITMAP_WINDOWS", bitmap)
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    items = [(r["item_id"], r["text"]) for r in bench.collect()]
    pad = "Nothing to see in this text, which speaks of other things entirely. "
    docs = spark.createDataFrame([(k, pad + t + " " + pad) for k, t in items] + [(-1, pad)], "doc_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.contaminated_pairs(docs, bench).collect()}
    assert {(k, k) for k, t in items if len(squeezed(t).split()) >= decontaminate.LEAST_TOKENS} <= got and not any(d == -1 for d, _ in got)
