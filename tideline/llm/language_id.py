"""Language identification in two levels: the family first, then the language within it.

Features are hashed byte n-grams of the lower-cased letters of a whole text. Families are told
apart by one linear support vector machine each (one against the rest); languages of one family by
one for each two of them, which vote. Machines are fitted on a bounded sample of labelled rows.
"""

from __future__ import annotations

import pickle
from collections import Counter
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import blob, bounded_batches, columns_of, fresh, text_chunks
from .decontaminate import lower_latin

DIMS = 4096
#: At most so many labelled texts of a language, and of all languages (or two of each), are sampled to fit machines.
SAMPLE_PER_LANGUAGE, SAMPLE = 500, 2000
#: Up to so many languages of a family, each two take a machine; beyond, each takes one against the rest.
PAIRED = 16
#: Machines fitted in one product.
AT_ONCE = 64
#: Public classification of languages. A language that isn't listed is a family of its own.
FAMILIES = {"germanic": "en de nl sv da no nb nn is af", "romance": "fr es it pt ro ca gl oc", "slavic": "ru uk pl cs sk bg sr hr sl be mk", "indic": "hi bn mr ne ur pa gu", "semitic": "ar he mt am", "turkic": "tr az kk uz", "uralic": "fi et hu"}
_FAMILY_OF = {code: family for family, codes in FAMILIES.items() for code in codes.split()}
UNDETERMINED = "und"
_LETTER = np.zeros(256, dtype=np.uint8)
_LETTER[97:123] = np.arange(97, 123)
_LETTER[128:] = np.arange(128, 256)


def family_of(lang: str) -> str:
    return _FAMILY_OF.get(lang.lower().split("-")[0], f"other:{lang}")


def gram_features(data: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """A row of DIMS counts for each text: n-grams of 1 to 4 bytes, runs of other bytes as one space."""
    n = len(offs) - 1
    x = _LETTER[lower_latin(data)]
    text = np.repeat(np.arange(n, dtype=np.int64), np.diff(offs))
    keep = x != 0
    keep[1:] |= x[:-1] != 0
    x, text = x[keep].astype(np.uint32), text[keep]
    out = np.zeros(n * DIMS, dtype=np.float32)
    h = np.zeros(len(x), dtype=np.uint32)
    for k in range(4):
        m = len(x) - k
        if m <= 0:
            break
        h = (h[:m] * np.uint32(0x9E3779B1)) ^ (x[k:] * np.uint32(0x85EBCA77) + np.uint32(k))
        if k == 0:
            continue
        same = text[:m] == text[k:]
        slot = ((h * np.uint32(0xC2B2AE35)) >> np.uint32(20)).astype(np.int64)
        out += np.bincount((text[:m] * DIMS + slot)[same], minlength=n * DIMS)
    return out.reshape(n, DIMS)


def scaled(counts: np.ndarray) -> np.ndarray:
    """Square roots of frequencies: rows of unit length. Works in place."""
    np.sqrt(counts, out=counts)
    counts /= np.maximum(np.sqrt(np.einsum("ij,ij->i", counts, counts)), 1e-9)[:, None]
    return counts


def has_letter(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


def fit_svm(x: np.ndarray, y: np.ndarray, cost: float = 20.0, rounds: int = 150) -> np.ndarray:
    """Weights (the last one the bias) of a linear machine, squared hinge loss, by accelerated descent."""
    w = np.zeros(x.shape[1] + 1, dtype=np.float32)
    seen = w.copy()
    weight = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y <= 0).sum())).astype(np.float32)
    step = 1.0 / (1.0 + 4.0 * cost)
    for t in range(rounds):
        gap = np.maximum(0.0, 1.0 - y * (x @ seen[:-1] + seen[-1])) * weight * y
        grad = np.append(seen[:-1] - 2 * cost * (gap @ x), -2 * cost * gap.sum()).astype(np.float32)
        new = seen - step * grad
        seen = new + (t / (t + 3.0)) * (new - w)
        w = new
    return w


def fit_against_rest(x: np.ndarray, names: np.ndarray, each: list[str]) -> np.ndarray:
    """A machine a name against all others; of many, AT_ONCE are descended side by side."""
    if len(each) <= PAIRED:
        return np.stack([fit_svm(x, np.where(names == f, 1.0, -1.0)) for f in each])
    return np.concatenate([_fit_side_by_side(x, np.where(names[:, None] == np.array(each[lo : lo + AT_ONCE], dtype=object)[None, :], 1.0, -1.0).astype(np.float32)) for lo in range(0, len(each), AT_ONCE)])


def _fit_side_by_side(x: np.ndarray, y: np.ndarray, cost: float = 20.0, rounds: int = 150) -> np.ndarray:
    """As fit_svm, for each column of y."""
    w = np.zeros((x.shape[1] + 1, y.shape[1]), dtype=np.float32)
    seen = w.copy()
    weight = np.where(y > 0, 0.5 / np.maximum(1, (y > 0).sum(axis=0)), 0.5 / np.maximum(1, (y <= 0).sum(axis=0))).astype(np.float32)
    step = np.float32(1.0 / (1.0 + 4.0 * cost))
    for t in range(rounds):
        gap = np.maximum(0.0, 1.0 - y * (x @ seen[:-1] + seen[-1])) * weight * y
        grad = np.concatenate([seen[:-1] - 2 * cost * (x.T @ gap), -2 * cost * gap.sum(axis=0, keepdims=True)])
        new = seen - step * grad
        seen = (new + np.float32(t / (t + 3.0)) * (new - w)).astype(np.float32)
        w = new.astype(np.float32)
    return w.T


class Model:
    """Families, one machine a family; for each family its languages and a machine for each two, or in a large family for each against the rest.

    learned_from: how many texts of each language.
    """

    def __init__(self, x: np.ndarray, langs: np.ndarray):
        self.learned_from = dict(Counter(langs))
        self.langs = sorted(self.learned_from)
        fam = np.array([family_of(v) for v in langs]) if len(langs) else langs
        self.families = sorted(set(fam))
        self.outer = fit_against_rest(x, fam, self.families) if len(self.families) > 1 else None
        self.inner = {}
        for f in self.families:
            mine = sorted({v for v in self.langs if family_of(v) == f})
            machines = []
            if len(mine) > PAIRED:
                rows = fam == f
                machines = [(a, -1, w) for a, w in enumerate(fit_against_rest(x[rows], langs[rows], mine))]
            for a, b in combinations(range(len(mine) if len(mine) <= PAIRED else 0), 2):
                rows = (langs == mine[a]) | (langs == mine[b])
                machines.append((a, b, fit_svm(x[rows], np.where(langs[rows] == mine[a], 1.0, -1.0))))
            self.inner[f] = (mine, machines)

    def predict(self, x: np.ndarray) -> tuple[list[str], np.ndarray]:
        if not self.langs:
            return [UNDETERMINED] * len(x), np.zeros(len(x))

        def squash(v):
            return 1.0 / (1.0 + np.exp(-3.0 * np.clip(v, -10, 10)))

        if self.outer is None:
            family, sure = np.zeros(len(x), dtype=int), np.ones(len(x))
        else:
            p = squash(x @ self.outer[:, :-1].T + self.outer[:, -1])
            p = p / p.sum(axis=1, keepdims=True)
            family, sure = p.argmax(axis=1), p.max(axis=1)
        out, score = np.empty(len(x), dtype=object), np.zeros(len(x))
        for k, f in enumerate(self.families):
            rows = np.flatnonzero(family == k)
            if not len(rows):
                continue
            mine, machines = self.inner[f]
            votes, weight = np.zeros((len(rows), len(mine))), np.zeros((len(rows), len(mine)))
            for a, b, w in machines:
                p = squash(x[rows] @ w[:-1] + w[-1])
                if b < 0:
                    weight[:, a] = p
                    continue
                votes[:, a] += p >= 0.5
                votes[:, b] += p < 0.5
                weight[:, a] += p
                weight[:, b] += 1 - p
            if machines and machines[0][1] < 0:  # shares, on the scale of votes
                weight *= (len(mine) - 1) / np.maximum(weight.sum(axis=1, keepdims=True), 1e-9)
            best = (votes + weight / (len(mine) + 1)).argmax(axis=1)
            out[rows] = np.array(mine, dtype=object)[best]
            score[rows] = sure[rows] * (weight[np.arange(len(rows)), best] / max(1, len(mine) - 1) if machines else 1.0)
        return list(out), np.clip(score, 0.0, 1.0)


def fit_language_model(docs: DataFrame, learn: Column, per_language: int = SAMPLE_PER_LANGUAGE, most: int = SAMPLE, languages: int | None = None) -> Model:
    """Fit on a sample of the rows for which `learn` holds and lang is given.

    Of every language (or of the most frequent `languages`, if a caller wants no others), different texts are taken by a hash of id and text, at most per_language of them
    and `most` in all, but two of each language however many there are; equal rows count once. One task
    gathers their hashed counts and fits, the driver gets the machines.
    """
    # Learned from may be any column of docs, so what is added to it gets names of its own.
    known = docs.filter(learn & F.col("lang").isNotNull() & F.col("text").isNotNull())
    known = known.select(F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"), F.xxhash64(F.lit("sample"), "doc_id", "text").alias("h"))
    counted = known.groupBy("lang").agg(F.approx_count_distinct("h", 0.05).alias("n")).orderBy(F.desc("n"), "lang")
    counts = {r["lang"]: r["n"] for r in (counted if languages is None else counted.limit(languages)).collect()}
    if not counts:
        return Model(np.zeros((0, DIMS), dtype=np.float32), np.zeros(0, dtype=object))
    bound = max(2, min(per_language, most // len(counts)))
    # Half as many again as wanted, since the counts are estimates; what is too much is cut by rank.
    rate = F.create_map(*[F.lit(v) for lang, n in counts.items() for v in (lang, min(1.0, 1.5 * bound / max(1, n)))])
    share = F.pmod("h", F.lit(1 << 40)) / float(1 << 40)
    some = known.filter(share < F.element_at(rate, F.col("lang"))).groupBy("lang", "h").agg(F.max("text").alias("text"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("h"))
    sample = some.withColumn("rank", rank).filter(F.col("rank") <= bound).select("lang", "h", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            packed = []
            for ch in text_chunks(batch.column(2), most=128):
                for row in gram_features(ch.data, ch.offs):
                    at = np.flatnonzero(row)
                    packed.append(blob(at.astype(np.uint16)) + blob(row[at]))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(packed, pa.binary())], ["lang", "h", "packed"])

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = sorted((lang, h, raw) for batch in batches for lang, h, raw in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True) if raw)
        x = np.zeros((len(got), DIMS), dtype=np.float32)
        for i, (_, _, raw) in enumerate(got):
            n = len(raw) // 6
            x[i, np.frombuffer(raw, dtype=np.uint16, count=n)] = np.frombuffer(raw, dtype=np.float32, offset=2 * n)
        model = Model(scaled(x), np.array([lang for lang, _, _ in got], dtype=object))
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(model)], pa.binary())], ["model"])

    fitted = bounded_batches(sample).mapInArrow(run, "lang string, h long, packed binary").coalesce(1).mapInArrow(fit, "model binary")
    return pickle.loads(fitted.first()["model"])


def _with_languages(docs: DataFrame, model: Model, pred: str, score: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(batch.num_columns - 1)
            langs: list[str] = []
            scores: list[np.ndarray] = []
            for ch in text_chunks(column, most=128):
                found, chance = model.predict(scaled(gram_features(ch.data, ch.offs)))
                ascii_letters = ch.per_text((ch.data | 32) - 97 < 26)
                for i in np.flatnonzero(ascii_letters == 0):
                    if not has_letter(column[ch.lo + int(i)].as_py()):
                        found[i], chance[i] = UNDETERMINED, 0.0
                langs += found
                scores.append(chance)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(langs, pa.string()), pa.array(np.concatenate(scores) if scores else np.zeros(0))], [*batch.schema.names[:-1], pred, score])

    # Columns travel by number: mapInArrow can't read names with dots.
    numbered = [c.alias(f"c{k}") for k, c in enumerate(columns_of(docs))]
    fields = "".join(f"c{k} {f.dataType.simpleString()}, " for k, f in enumerate(docs.schema))
    read = bounded_batches(docs).select(*numbered, F.col("text").cast("string").alias("read"))
    return read.mapInArrow(run, f"{fields}{pred} string, {score} double").toDF(*docs.columns, pred, score)


def identify_languages(docs: DataFrame, model: Model) -> DataFrame:
    """docs with lang_pred and score, from the whole text alone; map-only.

    A text that is null or has no letter, and any text if nothing was learned, is undetermined with
    score 0. Rows are told apart by nothing but their text, so repeated rows agree. Columns of docs
    that are called lang_pred or score are replaced. An empty table gives no rows.
    """
    return _with_languages(docs.drop("lang_pred", "score"), model, "lang_pred", "score")


def held_out() -> Column:
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(5)) == 0, F.lit(False))


def language_query(docs: DataFrame) -> DataFrame:
    """The columns of op2: fitted where crc32(doc_id) mod 5 isn't 0, predicted for every row."""
    model = fit_language_model(docs, ~held_out())
    return identify_languages(docs.select("doc_id", "text"), model).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


#: Below this a prediction is no better than a coin in both levels.
LEAST_SCORE = 0.25


def identified_documents(docs: DataFrame, least_score: float = LEAST_SCORE) -> DataFrame:
    """docs without the texts whose language can't be told. Any columns may be among docs', and they stay as they are."""
    model = fit_language_model(docs, ~held_out())
    pred, score = fresh(docs, "lang_pred", "score")
    return _with_languages(docs, model, pred, score).filter((F.col(pred) != UNDETERMINED) & (F.col(score) >= least_score)).select(*columns_of(docs))


def accuracy_by_language(predicted: DataFrame, truth: DataFrame) -> pd.DataFrame:
    """Share of held-out rows predicted right, by language (a report of a row a language)."""
    both = predicted.filter("held_out").join(truth.select("doc_id", "lang"), "doc_id")
    return both.groupBy("lang").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double")).alias("accuracy"), F.count(F.lit(1)).alias("n")).toPandas()
