from helpers import LONG, ODD, frame, rows

from rillflow.llm.decontaminate import clean, contaminated

ITEMS = [(1, "Yesterday Tom Smith walked 12 km from Paris to Lyon in 3 hours, and Tom said 12 was enough"), (2, "the quick brown fox jumps over the lazy dog near the river bank"), (3, "too short"), (4, None)]
SAME = "and then: yesterday TOM SMITH walked 12 km from PARIS to LYON in 3 hours, and TOM said 12 was enough!"
OTHER = "Yesterday Ann Smith walked 40 miles from Rome to Bari in 9 hours, and Ann said 40 was enough"
MIXED = "Yesterday Ann Smith walked 40 miles from Rome to Bari in 9 hours, and Bob said 17 was enough"
PART = "the quick brown fox jumps over a sleeping cat that nobody has seen"


def items(spark, n=4):
    return spark.createDataFrame([(*x, "x") for x in ITEMS[:n]], "item_id long, text string, doc_id string")


def found(spark, docs, **kw):
    got = contaminated(frame(spark, docs), items(spark), **kw)
    return {(r["doc_id"], r["item_id"]): (r["n_slots"], r["n_changed"]) for r in got.collect()}


def test_copies_and_new_parameters(spark):
    docs = [(10, SAME), (11, OTHER), (12, MIXED), (13, PART), (14, "x " + ITEMS[1][1].upper() + " " + LONG), *ODD]
    got = found(spark, docs)
    assert set(got) == {(10, 1), (11, 1), (14, 2)}
    assert got[10, 1][1] == 0 and got[11, 1][1] > 0 and got[14, 2] == (0, 0)
    assert found(spark, docs, broadcast_windows=0) == got


def test_clean(spark):
    docs = [(10, ITEMS[1][1]), (10, "same id"), (11, PART), (None, ITEMS[1][1]), (None, "x"), *ODD[:8]]
    left = clean(frame(spark, docs), items(spark))
    assert left.columns == frame(spark).columns
    assert rows(left.select("doc_id", "text")) == sorted([(11, PART), *ODD[:8]], key=str)
    fine = clean(frame(spark), items(spark))
    assert fine.count() == len(ODD)


def test_empty_tables(spark):
    assert contaminated(frame(spark, []), items(spark)).count() == 0
    assert contaminated(frame(spark), items(spark).limit(0)).count() == 0


def test_no_python_on_the_main_path(spark):
    plan = contaminated(frame(spark, [(1, "a b c d e")], False), items(spark))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan
