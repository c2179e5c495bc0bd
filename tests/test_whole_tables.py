"""Queries over whole tables against brute force, on rows that an id or length filter would leave out."""

import datetime
import re

import pytest

from strata.functions import text as t
from strata.plans import QUERIES

TEXTS = {
    0: "the dog is in the house and it was not for the cat " * 200, 1: "le chien est dans la maison avec nous pour un jour " * 5, 2: "", 3: None, 4: "aaaa short aaa", 7: "der hund ist nicht mit dem mann und die frau ist von hier " * 4,
    9: "words of no language " * 200 + "der die das und ist mit " * 900, 20: "(a\\E.*b) aaa " * 400, 41: "el perro no es de la casa y los otros con una mesa " * 5, 105: "é🙂aaa🙂🙂 " * 500,
}
ITEMS = {k: v for k, v in enumerate(["aaa tail", "a\\E and", "🙂🙂x", "der", "", None, " is not", "zzz"])} | {k: "aaa" for k in range(40, 60)}


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("whole"))
    docs = [(k, x, "fr" if k == 1 else "en", "s", len(x or "")) for k, x in TEXTS.items()]
    spark.createDataFrame(docs, "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame(list(ITEMS.items()), "item_id bigint, text string").write.parquet(f"{d}/benchmark.parquet")
    events = [(k, datetime.datetime(2024, 1, 1), k % 3, "click", 1.0, "{}") for k in range(880, 1000)]
    spark.createDataFrame(events, "event_id bigint, ts timestamp, user_id bigint, event_type string, value double, props string").write.parquet(f"{d}/events.parquet")
    return d


def test_occurrences_of_every_item_in_every_text(spark, tables):
    def n(x, p):
        return sum(x.startswith(p, i) for i in range(len(x))) if x and p else 0

    got = {(r.doc_id, r.item_id): r.n for r in QUERIES["st13_occurrences"](spark, tables).collect()}
    assert got == {(k, i): n(x, p and p[:3]) for k, x in TEXTS.items() for i, p in ITEMS.items()}
    assert got[105, 0] == 500 and got[20, 1] == 400


def test_language_of_every_whole_text(spark, tables):
    def judge(x):
        words = re.findall("[a-zà-öø-ÿ]+", (x or "").lower())
        if len(words) < 25:
            return "undecided"
        scores = {lang: sum((0.35 if w in t.AMBIGUOUS else 1.0) for w in words if w in own) / len(words) for lang, own in t.FUNCTION_WORDS.items()}
        best = max(scores, key=scores.get)
        return "undecided" if scores[best] < 0.02 or best != "en" and scores[best] - scores["en"] < 0.02 else best

    want = [judge(x) for x in TEXTS.values()]
    got = {r.got: r.n for r in QUERIES["st12_ag22_language_check"](spark, tables).collect()}
    assert got == {g: want.count(g) for g in want} and sum(got.values()) == len(TEXTS)
    assert judge(TEXTS[9]) == "de" != judge(TEXTS[9][:4000])


def test_no_row_is_left_out(spark, tables):
    ids = set(TEXTS)
    assert {r.doc_id for r in QUERIES["gr12_files_from_diff"](spark, tables).collect()} == ids
    assert {r.doc_id for r in QUERIES["st31_markdown_links"](spark, tables).collect()} == ids
    assert QUERIES["ag5_scan_coverage"](spark, tables).count() == len(ids)
    assert QUERIES["pt2_apply_in_order"](spark, tables).count() == len(ids)
    idx = {k: k * 7 % 40 for k in range(880, 1000)}
    want, last, seen = {}, {}, [(k % 3, i) for k, i in idx.items()]
    for k, i in idx.items():
        if seen.count((k % 3, i)) > 1:
            want[k] = "duplicate"
        elif i <= last.get(k % 3, -1):
            want[k] = "not rising"
        last[k % 3] = i
    assert {r.pos: r.problem for r in QUERIES["w8_index_problems"](spark, tables).collect()} == want and max(want) >= 900
