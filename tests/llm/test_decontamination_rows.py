import pytest
from helpers import LONG, frame, rows

from rillflow.llm.decontaminate import clean_rows, contaminated

ADD = "add 3 and 5 and then add 4 and 6 and stop now please"
CITY = "What is the capital city of France"
TRAIN = "The train leaves Oslo at 9 and Ann waits 12 minutes for the train to Bergen before Ann goes home"
LISTED = "7 1 8 2 8 1 8 2 8 4 5 9"
ITEMS = [(1, ADD), (2, CITY), (3, TRAIN), (4, LISTED), (5, "Zebra quilts Now"), (6, None), (7, "")]
DOCS = [
    (10, f"some words before {ADD} and some after", {1}),
    (11, "some words before add 13 and 15 and then add 14 and 16 and stop now please", {1}),
    (12, "add 13 and 15 and then add 14 and 13 and halt here now", set()),
    (13, f"{ADD} {LONG[:2000]} and later on {ADD.replace('3', '70')}", {1}),
    (20, "Answer this now What is the capital city of France", {2}),
    (21, "What is the capital town of Spain", set()),
    (30, TRAIN.replace(" ", "\n"), {3}),
    (31, TRAIN.replace("Oslo", "Rome").replace("Ann", "Bob"), {3}),
    (32, "so The train leaves Rome at 7 and Bob waits 12 minutes for the train to Bari before Bob goes home " + TRAIN.replace("9", "11"), {3}),
    (33, "The train leaves Rome at 9 and Bob waits 12 minutes for the train to Bari before Tim goes home", set()),
    (40, f"the numbers are {LISTED} in all", {4}),
    (41, "the numbers are 1 2 3 4 5 6 7 8 9 10 11 12 13 14 in all", set()),
    (50, "he sells zebra\nquilts, now and then", {5}),
    (51, "zebra quilts are sold now", set()),
    (60, None, set()),
]


@pytest.fixture(scope="module")
def items(spark):
    return spark.createDataFrame(ITEMS, "item_id long, text string")


@pytest.mark.parametrize("broadcast", [200_000, 0])
def test_each_occurrence_is_judged_by_itself(spark, items, broadcast):
    got = contaminated(frame(spark, [d[:2] for d in DOCS]), items, broadcast_windows=broadcast).select("doc_id", "item_id").collect()
    assert len(got) == len(set(got))
    assert {i: {r["item_id"] for r in got if r["doc_id"] == i} for i, *_ in DOCS} == {i: want for i, _, want in DOCS}


def test_rows_are_judged_by_their_own_text(spark, items):
    docs = [(None, f"x {CITY}"), (None, "clean"), (None, None), (7, ADD), (7, "clean as well"), (7, "the numbers"), (None, CITY[:15]), (None, CITY[8:])]
    left = clean_rows(frame(spark, docs), items)
    assert left.columns == frame(spark).columns
    assert rows(left.select("doc_id", "text")) == sorted([d for d in docs if d[1] not in (f"x {CITY}", ADD)], key=str)
    assert clean_rows(frame(spark, []), items).count() == 0


def test_pipeline_stage_keeps_clean_rows(spark, items, tmp_path):
    import corpus_pipeline as P

    items.write.parquet(f"{tmp_path}/benchmark.parquet")
    left = P.decontamination(spark, frame(spark, [(None, CITY), (None, "clean")]), str(tmp_path))
    assert rows(left.select("text")) == [("clean",)]
