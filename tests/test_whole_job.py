"""Queries read every row of their tables: no quota, no stand-in rows."""

from pyspark.sql import functions as F

from emberframe.catalog import QUERIES, sessions
from emberframe.catalog.bindings import table
from tests.oracle import ROOT

SF = f"{ROOT}/sf0.01"


def test_blocks_are_judged_by_the_events_themselves(spark, tmp_path):
    # Two frames of every phase and bin for both trials of one block; nothing but the tracking differs between the runs.
    rows = [
        (8 + 8 * i + 4 * (user // 6) + p, user, "view", '{"k": %d}' % (i // 2 * 10))
        for user in (0, 6) for p in range(4) for i in range(20)
    ]
    events = spark.createDataFrame(rows, "event_id long, user_id long, event_type string, props string")
    ts = F.timestamp_micros(F.lit(1_704_067_200_000_000) + F.col("event_id") * 1_000_000)
    for value, valid in ((9.0, True), (0.0, False)):
        root = str(tmp_path / str(valid))
        events.withColumns({"ts": ts, "value": F.lit(value)}).write.parquet(f"{root}/events.parquet")
        got = QUERIES["selected_blocks"](spark, root).select("valid", "selected").collect()
        assert [tuple(r) for r in got] == [(valid, valid)]


def test_pinch_samples_are_all_events_of_their_phases(spark):
    events = table(spark, SF, "events").where(F.col("event_type").isin("click", "view", "purchase"))
    assert sessions._tips(spark, SF).count() == events.count()


def test_pinch_groups_count_every_sample(spark):
    assert QUERIES["pinch_tip_effects"](spark, SF).count() == 60
    assert QUERIES["pinch_group_effects"](spark, SF).count() == 30
    assert {r["valid_groups"] for r in QUERIES["pinch_session_verdict"](spark, SF).collect()} == {6}
