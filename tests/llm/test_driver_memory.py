"""What the driver frees goes back to the machine while a query of many steps runs."""

from sealfold.llm import common, exact_dedup


def test_the_driver_gives_back_after_each_stored_table(spark, monkeypatch):
    assert common.trim(spark)
    calls, trim = [], common.trim
    monkeypatch.setattr(common, "trim", lambda s: calls.append(trim(s)))
    stored = common.materialize(spark.range(3), "trimmed")
    common.discard(stored)
    assert calls == [True]


def test_exact_dedup_collects_between_its_steps(spark, monkeypatch):
    calls, drop = [], exact_dedup.drop_garbage
    monkeypatch.setattr(exact_dedup, "drop_garbage", lambda s: calls.append(drop(s)))
    docs = spark.createDataFrame([(1, "a"), (2, "A"), (3, "b")], "doc_id long, text string")
    assert sorted(r["doc_id"] for r in exact_dedup.deduplicate(docs).collect()) == [2, 3]
    assert len(calls) == 2
