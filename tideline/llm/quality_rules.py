"""Quality rules whose cutoffs are risk-controlled on labelled holdouts.

A rule rejects a document whose feature is above a cutoff. What is bounded is the joint verdict of
all rules: the share of good documents that pass the base rule and are still rejected. Labelled
documents are split by a hash of their id. A fifth of them (the tuning part) lays out a ladder of
cutoffs for all rules at once, each step at least as strict as the one before. On the rest, the
holdout, steps are tested from the loosest down: a step is certified if the exact binomial test
rejects "more than max_risk of good documents are lost". Testing stops at the first failure (a
fixed sequence, so steps need no correction), and the level is divided by the number of strata
tested (Bonferroni). So with probability 1 - delta no stratum tested loses more than max_risk of
its good documents to all rules together. Strata with too few labels for a test to succeed are
tested as one: the bound then holds for their union. Among certified steps the one that separates
bad from good best is taken; where none does, nothing is rejected.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import _U, SpanHasher, bounded_batches, mix64, stage_table, text_chunks

SYMBOLS = b"#*$%&|<>"  # fixed value
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
MAX_RISK = 0.02
DELTA = 0.05
GOOD_WEIGHT = 5.0  # a good document lost weighs so many bad ones kept
BINS = 200
STEPS = 20
#: One labelled document in so many is for tuning; a rule must gain this much there to be used.
TUNING_PART, LEAST_GAIN = 5, 0.02
RULES = ("symbols", "dup_lines", "repeat_words", "long_words")
COUNTS = ["n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words"]


def _distinct_per_text(keys: np.ndarray, text: np.ndarray, n: int) -> np.ndarray:
    """How many different keys each text has; keys already differ between texts."""
    _, first = np.unique(keys, return_index=True)
    return np.bincount(text[first], minlength=n)


def count_features(column: pa.Array) -> dict[str, np.ndarray]:
    """The counts of COUNTS for each text of an Arrow string column; a null text counts as empty."""
    out = {c: np.zeros(len(column), dtype=np.int64) for c in COUNTS}
    symbol = np.zeros(256, dtype=bool)
    symbol[[*SYMBOLS]] = True
    for ch in text_chunks(column):
        at = slice(ch.lo, ch.lo + ch.n)
        starts, ends, first = ch.words()
        hashes = SpanHasher(ch.data)
        out["n_words"][at] = np.diff(first)
        points = np.zeros(len(ch.data) + 1, dtype=np.int64)
        np.cumsum((ch.data & 0xC0) != 0x80, out=points[1:])
        chars = np.zeros(len(starts) + 1, dtype=np.int64)
        np.cumsum(points[ends] - points[starts], out=chars[1:])
        out["word_chars"][at] = chars[first[1:]] - chars[first[:-1]]
        out["n_symbols"][at] = ch.per_text(symbol[ch.data])

        # Lines: cut at every \n and at the ends of texts; those with a word are compared whole.
        breaks = np.flatnonzero(ch.data == 10)
        line_from = np.sort(np.concatenate((ch.offs[:-1], breaks + 1)))
        text = np.searchsorted(ch.offs[1:], line_from, "right")
        # A break at the very end of a text opens an empty line that belongs to that text: it has no word.
        text = np.minimum(text, ch.n - 1)
        line_to = np.minimum(np.append(line_from[1:], len(ch.data)), ch.offs[text + 1])
        has_break = np.zeros(len(ch.data) + 1, dtype=bool)
        has_break[breaks] = True
        line_to = np.where((line_to > line_from) & has_break[np.maximum(line_to - 1, 0)], line_to - 1, line_to)
        with_word = np.searchsorted(starts, line_to) > np.searchsorted(starts, line_from)
        lf, lt, tx = line_from[with_word], line_to[with_word], text[with_word]
        salt = mix64(np.arange(1, ch.n + 1, dtype=_U))
        out["n_lines"][at] = np.bincount(tx, minlength=ch.n)
        out["n_dup_lines"][at] = out["n_lines"][at] - _distinct_per_text(mix64(hashes(lf, lt) ^ salt[tx]), tx, ch.n)

        if len(starts) >= 3:
            w = hashes(starts, ends)
            owner = np.repeat(np.arange(ch.n), np.diff(first))
            whole = owner[:-2] == owner[2:]
            three = mix64((w[:-2] * _U(3) + mix64(w[1:-1] * _U(5)) + mix64(w[2:] * _U(7) + _U(1))) ^ salt[owner[:-2]])
            _, inverse, count = np.unique(three[whole], return_inverse=True, return_counts=True)
            again = np.zeros(len(starts), dtype=bool)
            where = np.flatnonzero(whole)[count[inverse] >= 2]
            for k in range(3):
                again[where + k] = True
            out["n_repeat_words"][at] = np.bincount(owner[again], minlength=ch.n)
    return out


FEATURES_SCHEMA = "doc_id long, stratum string, " + ", ".join(f"{c} long" for c in COUNTS)


def document_features(docs: DataFrame, stratum: str = "lang") -> DataFrame:
    """doc_id, stratum and the counts, one row per row of docs; map-only."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts = count_features(batch.column(2))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *[pa.array(counts[c]) for c in COUNTS]], ["doc_id", "stratum", *COUNTS])

    return bounded_batches(docs).select(F.col("doc_id").cast("long"), F.coalesce(F.col(stratum).cast("string"), F.lit("")).alias("stratum"), F.col("text").cast("string")).mapInArrow(run, FEATURES_SCHEMA)


def rule_bins(features: DataFrame) -> DataFrame:
    """Each rule's feature as a whole number of percent (long_words: tenths of a character), up to BINS."""

    def bin_of(a: str, b: str, scale: int):
        return F.least(F.coalesce(F.floor(F.try_divide(F.col(a) * scale, F.col(b))), F.lit(0)), F.lit(BINS)).cast("int")

    return features.withColumns({"symbols": bin_of("n_symbols", "word_chars", 100), "dup_lines": bin_of("n_dup_lines", "n_lines", 100), "repeat_words": bin_of("n_repeat_words", "n_words", 100), "long_words": bin_of("word_chars", "n_words", 10)})


def binomial_tail(k: int, n: int, p: float) -> float:
    """P(Bin(n, p) <= k), exactly, as the regularised incomplete beta I(1 - p; n - k, k + 1)."""
    if k >= n:
        return 1.0
    a, b, x = n - k, k + 1.0, 1.0 - p
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log(p))
    if x < (a + 1) / (a + b + 2):
        return front * _beta_fraction(a, b, x) / a
    return 1.0 - front * _beta_fraction(b, a, p) / b


def _beta_fraction(a: float, b: float, x: float) -> float:
    """Lentz's evaluation of the continued fraction of the incomplete beta function."""
    tiny, c, d = 1e-300, 1.0, 1.0 - (a + b) * x / (a + 1)
    d = 1.0 / (d if abs(d) > tiny else tiny)
    h = d
    for m in range(1, 100_000):
        for top in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1.0 + top * d
            c = 1.0 + top / c
            d = 1.0 / (d if abs(d) > tiny else tiny)
            c = c if abs(c) > tiny else tiny
            h *= d * c
        if abs(d * c - 1.0) < 1e-14:
            break
    return h


def select_cutoff(good: np.ndarray, bad: np.ndarray, max_risk: float, level: float) -> int:
    """The cutoff bin for one stratum and rule from histograms of good and bad documents.

    BINS means that nothing is rejected.
    """
    n_good, n_bad = int(good.sum()), int(bad.sum())
    best, best_gain, lost, caught = BINS, 0.0, 0, 0
    for cutoff in range(BINS - 1, -1, -1):
        lost += int(good[cutoff + 1])
        caught += int(bad[cutoff + 1])
        if not n_good or binomial_tail(lost, n_good, max_risk) > level:
            break
        gain = caught / max(n_bad, 1) - GOOD_WEIGHT * lost / n_good
        if gain > best_gain + 1e-12:
            best, best_gain = cutoff, gain
    return best


def rule_cutoffs(good: np.ndarray, bad: np.ndarray, max_risk: float, steps: int) -> list[int]:
    """A rule's cutoffs from the tuning part's histograms, none above the one before.

    The first loses no good document, the last up to max_risk of them, and none is stricter than the
    (loosest) cutoff that separates bad from good best. A rule that separates nothing stays at BINS.
    """
    above_good, above_bad = (np.append(np.cumsum(h[::-1])[::-1][1:], 0) / max(1.0, h.sum()) for h in (good, bad))
    gain = above_bad - GOOD_WEIGHT * above_good
    if gain.max() < LEAST_GAIN:
        return [BINS] * steps
    best = BINS - int(np.argmax(gain[::-1] >= gain.max() - 1e-12))
    return [max(best, int(np.argmax(above_good <= max_risk * k / max(1, steps - 1) + 1e-12))) for k in range(steps)]


def ladder(histograms: dict[str, tuple[np.ndarray, np.ndarray]], max_risk: float, steps: int = STEPS) -> dict[str, list[int]]:
    """Each rule's cutoff at each step. Rules come in one by one, the one that catches most bad documents first; then all grow stricter."""
    n = len(histograms)
    cuts = {r: rule_cutoffs(g, b, max_risk, steps - n + 1) for r, (g, b) in histograms.items()}
    caught = {r: float(b[cuts[r][0] + 1 :].sum()) for r, (_, b) in histograms.items()}
    place = {r: k for k, r in enumerate(sorted(cuts, key=lambda r: -caught[r]))}
    return {r: [BINS] * place[r] + [c[0]] * (n - place[r]) + c[1:] for r, c in cuts.items()}


def certified_step(good: np.ndarray, bad: np.ndarray, max_risk: float, level: float) -> int:
    """How many steps of the ladder to take (0: none), from the holdout's documents by first step that rejects them, the last for none."""
    def from_the_top(h: np.ndarray) -> np.ndarray:
        out = np.zeros(BINS + 1)
        out[BINS : BINS - len(h) + 1 : -1], out[0] = h[:-1], h[-1]
        return out

    return BINS - select_cutoff(from_the_top(good), from_the_top(bad), max_risk, level)


def labelled_documents(binned: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, stratum, quality, tuning and the bins of each labelled document that passes the base rule.

    labels: doc_id, quality (1 good, 0 bad, null unlabelled). Of rows that repeat a doc_id the
    lowest quality and the largest features count.
    """
    known = labels.filter("quality is not null and doc_id is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    once = binned.filter(~base_failed()).join(known, "doc_id").groupBy("doc_id").agg(F.max("stratum").alias("stratum"), F.min("quality").alias("quality"), *[F.max(r).alias(r) for r in RULES])
    return once.withColumn("tuning", F.pmod(F.xxhash64(F.lit("tuning"), "doc_id"), F.lit(TUNING_PART)) == 0)


def risk_controlled_cutoffs(binned: DataFrame, labels: DataFrame, max_risk: float = MAX_RISK, delta: float = DELTA) -> DataFrame:
    """stratum and one cutoff for each rule, for each stratum with labelled documents.

    What a task gathers is a stratum's histograms, of fixed size.
    """
    rows = stage_table(labelled_documents(binned, labels), "quality-labelled")
    strata = stage_table(rows.groupBy("stratum").agg(F.coalesce(F.sum(((F.col("quality") > 0) & ~F.col("tuning")).cast("long")), F.lit(0)).alias("n_good")), "quality-strata")

    def needed(families: int) -> int:
        """Good documents in the holdout without which not even losing none would pass the test."""
        return math.ceil(math.log(delta / max(1, families)) / math.log(1.0 - max_risk))

    alone = F.col("n_good") >= needed(strata.count())
    count = strata.agg(F.coalesce(F.sum(alone.cast("long")), F.lit(0)).alias("alone"), F.coalesce(F.max((~alone).cast("long")), F.lit(0)).alias("rest")).first()
    level = delta / max(1, count["alone"] + count["rest"])
    family = strata.select("stratum", F.when(alone, F.concat(F.lit("="), "stratum")).otherwise(F.lit("rest")).alias("family"))
    rows = rows.join(family, "stratum")

    def histograms(pdf: pd.DataFrame, place: str, size: int) -> tuple[np.ndarray, np.ndarray]:
        good = pdf["quality"] > 0
        return tuple(np.bincount(pdf.loc[pick, place], weights=pdf.loc[pick, "n"], minlength=size) for pick in (good, ~good))

    def lay(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame([{"family": pdf["family"].iloc[0]} | {f"cuts_{r}": c for r, c in ladder({r: histograms(pdf[pdf["rule"] == r], "bin", BINS + 1) for r in RULES}, max_risk).items()}])

    stacked = "stack({}, {}) as (rule, bin)".format(len(RULES), ", ".join(f"'{r}', {r}" for r in RULES))
    tuned = rows.filter("tuning").selectExpr("family", "quality", stacked).groupBy("family", "rule", "bin", "quality").agg(F.count(F.lit(1)).alias("n"))
    ladders = stage_table(tuned.groupBy("family").applyInPandas(lay, "family string, " + ", ".join(f"cuts_{r} array<int>" for r in RULES)), "quality-ladders")

    # Cutoffs fall along the ladder, so the first step that rejects comes after those that don't.
    def passed(rule: str):
        return F.size(F.filter(f"cuts_{rule}", lambda c: c >= F.col(rule)))

    first = F.least(*[passed(r) for r in RULES]).cast("int")
    held = rows.filter("not tuning").join(ladders, "family").groupBy("family", first.alias("step"), "quality").agg(F.count(F.lit(1)).alias("n"))

    def choose(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame([[pdf["family"].iloc[0], certified_step(*histograms(pdf, "step", STEPS + 1), max_risk, level)]], columns=["family", "steps"])

    steps = held.groupBy("family").applyInPandas(choose, "family string, steps int")
    cuts = [F.when(F.col("steps") > 0, F.element_at(f"cuts_{r}", F.greatest("steps", F.lit(1)))).otherwise(F.lit(BINS)).cast("int").alias(f"cut_{r}") for r in RULES]
    return family.join(steps.join(ladders, "family").select("family", *cuts), "family").drop("family")


def base_failed():
    return (F.col("n_words") < MIN_WORDS) | (F.col("n_repeat_words") * 100 > F.col("n_words") * MAX_REPEAT_PERCENT)


def apply_quality_rules(docs: DataFrame, labels: DataFrame, stratum: str = "lang", max_risk: float = MAX_RISK, delta: float = DELTA) -> DataFrame:
    """One row per row of docs: doc_id, the counts, base_failed, kept and rejected_by (rules).

    docs: doc_id, text and the stratum's column; more columns are ignored. A null or empty text has
    no words and fails the base rule; a null stratum is a stratum named by the empty text. Rows that
    repeat a doc_id are judged each. A stratum without labels has no cutoffs and loses only what
    fails the base rule. Empty docs give no rows.
    """
    binned = stage_table(rule_bins(document_features(docs, stratum)), "quality-features")
    cutoffs = stage_table(risk_controlled_cutoffs(binned, labels, max_risk, delta), "quality-cutoffs")
    judged = binned.join(cutoffs, "stratum", "left")
    hits = F.array_compact(F.array(*[F.when(F.col(r) > F.col(f"cut_{r}"), F.lit(r)) for r in RULES]))
    return judged.select("doc_id", "stratum", *COUNTS, base_failed().alias("base_failed"), hits.alias("rejected_by")).withColumn("kept", ~F.col("base_failed") & (F.size("rejected_by") == 0))
