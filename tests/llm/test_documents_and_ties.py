"""Documents told by id and text, slots of any language, many languages, ties of turns, staged tables."""

import hashlib
import os

import numpy as np
import pytest

from tests.llm.test_llm import SCHEMA
from tideline.llm import chat_format, common, decontaminate, language_id

ITEM = "Three farmers from Boston sell twelve apples each day at the market near the old river bridge, how many apples are sold within twenty-one weeks?"
RUSSIAN = "Сколько яблок купил вчера на рынке мальчик по имени Иван если у его сестры по имени Мария осталось ровно 17 груш и 4 сливы"


def pairs(spark, rows, items):
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    return docs, bench, {(r["doc_id"], r["item_id"]) for r in decontaminate.contaminated_pairs(docs, bench).collect()}


def test_rows_without_id_and_of_one_id(spark):
    clean = "this text is about something else altogether and holds nothing of any test that was ever written down"
    halves = ITEM[: len(ITEM) // 2 - 30], ITEM[len(ITEM) // 2 + 30 :]
    rows = [(None, ITEM), (None, clean), (7, ITEM), (7, clean), (8, halves[0]), (8, halves[1]), (9, None), (None, None), (7, ITEM)]
    docs, bench, got = pairs(spark, rows, [(1, ITEM)])
    assert got == {(None, 1), (7, 1)}
    kept = sorted(map(str, decontaminate.without_contaminated(docs, bench).collect()))
    assert kept == sorted(map(str, (r for r in docs.collect() if r["text"] != ITEM)))


def test_columns_that_clash_stay(spark):
    docs = spark.createDataFrame([(1, ITEM, "a"), (2, "x", "b")], "doc_id long, text string, doc_key string")
    bench = spark.createDataFrame([(1, ITEM)], "item_id long, text string")
    assert [tuple(r) for r in decontaminate.without_contaminated(docs, bench).collect()] == [(2, "x", "b")]


@pytest.mark.parametrize("text", [
    ITEM.replace("Three", "Seven").replace("twelve", "nine").replace("twenty-one", "forty-six").replace("Boston", "Denver"),
    ITEM.replace("Three", "8").replace("twelve", "300").replace("twenty-one", "11"),
])
def test_number_words_are_slots(spark, text):
    assert pairs(spark, [(5, text)], [(1, ITEM)])[2] == {(5, 1)}


def test_number_words_must_agree(spark):
    other = ITEM.replace("apples each", "apples, two pears each")
    assert pairs(spark, [(5, "seven singers from Denver bring nine drums each evening to the stage beside the new city hall")], [(1, ITEM)])[2] == set()
    assert pairs(spark, [(5, other)], [(1, ITEM)])[2] == {(5, 1)}


def test_names_of_other_scripts_are_slots(spark):
    same = RUSSIAN.replace("Иван", "Пётр").replace("Мария", "Ольга").replace("17", "93").replace("4", "8")
    assert pairs(spark, [(1, RUSSIAN), (2, same), (3, same.upper())], [(1, RUSSIAN)])[2] >= {(1, 1), (2, 1)}


def test_joined_numbers_leave_other_tokens_alone():
    texts = ["twenty-three", "four five, six", "a seven b", "nine", "", "eight"]
    data = "".join(texts).encode()
    offs = np.cumsum([0, *(len(t.encode()) for t in texts)])
    _, kind, first = decontaminate.template_tokens(np.frombuffer(data, np.uint8), offs)
    assert np.diff(first).tolist() == [1, 2, 3, 1, 0, 1] and kind.tolist() == [1, 1, 1, 0, 1, 0, 1, 1]


def test_every_language_can_be_predicted(spark):
    letters = "abcdefghijklmnopqrstuvwxyz"
    r = np.random.default_rng(3)
    rows = []
    for k in range(130):
        words = ["".join(r.choice(list(letters), 5)) for _ in range(6)]
        lang = f"en-{k}" if k < 20 else f"q{k}"  # one family of twenty
        rows += [(k * 10 + i, " ".join(r.choice(words, 40)), lang) for i in range(6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = language_id.language_query(docs).toPandas().merge(docs.toPandas(), on="doc_id")
    assert set(got["lang_pred"]) == set(got["lang"]) and got["score"].between(0, 1).all()
    assert (got[got["held_out"]]["lang_pred"] == got[got["held_out"]]["lang"]).mean() > 0.9


def test_turns_of_equal_number_follow_by_role_and_raw_text(spark):
    rows = [(1, 0, "a", "!"), (1, 0, "a", "###"), (1, 0, "a", "A"), (1, 0, "a: b", "\\x"), (1, 0, None, "z"), (1, 0, "", "y"), (1, 0, "assistant", "a!"), (1, 0, "assistant", "a"), (1, 0, "assistant", None), (1, 0, "a", "</turn>\n: ")]
    t = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(4)
    got = chat_format.conversation_digests(chat_format.format_turns(t)).first()
    order = sorted(((r or ""), (x or "")) for _, _, r, x in rows)
    assert got["turns_sha256"] == hashlib.sha256("".join(f"{r}\n{x}\n" for r, x in order).encode()).hexdigest()
    assert got["loss_sha256"] == hashlib.sha256("".join(x for r, x in order if r == "assistant").encode()).hexdigest()


def test_the_pipeline_removes_what_its_stages_wrote(spark):
    import corpus_pipeline

    before = common.staged_so_far()
    one = common.stage_table(spark.range(3), "of-another")
    out = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    left = common._staged[before:]
    assert one.count() == 3 and out.count() > 0 and sum("pipeline-" in p for p in left) == 1
    assert common.remove_staged(spark, before) == len(left) and not any(os.path.exists(p) for p in left)


def test_clashing_columns_of_turns(spark):
    t = spark.createDataFrame([(1, 0, "user", "x", "c")], "conv_id long, turn long, role string, text string, formatted string")
    assert chat_format.format_turns(t).first()["formatted"] == "### user: x</turn>\n"
    assert SCHEMA
