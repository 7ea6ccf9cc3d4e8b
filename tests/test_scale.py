"""Plans that hold at size: no rows gathered by a handful of keys."""

from emberframe.catalog import classifiers
from emberframe.operators import calibration, statistics
from tests.oracle import ROOT


def test_residuals_leave_the_samples_where_they_are(spark, stored):
    rows = [(i % 3, i % 7 + 0.5, i % 11 / 10, i % 13 / 10, i % 17 * 1.0, i % 19 * 2.0) for i in range(30_000)]
    samples = stored(rows, "g int, x double, y double, z double, u double, v double")
    fitted = calibration.fit_affine(samples, ["g"])
    plan = fitted._jdf.queryExecution().executedPlan().toString()
    # the solved fits are a written table of known size, which goes to the samples
    assert "ArrowEvalPython" not in plan and "BroadcastHashJoin" in plan
    assert sorted(r["g"] for r in fitted.collect()) == [0, 1, 2]


def test_samples_are_read_from_the_written_orders(spark):
    plan = classifiers._samples(spark, f"{ROOT}/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Aggregate" not in plan


def test_correlations_of_raw_values_need_no_ranks(spark, monkeypatch):
    plans, plain = [], statistics.settle
    monkeypatch.setattr(statistics, "settle", lambda df: plans.append(df._jdf.queryExecution().optimizedPlan().toString()) or plain(df))
    rows = spark.createDataFrame([(i, i % 2, i * 1.0, i * i * 1.0) for i in range(12)], "id int, rep int, p double, s double")
    got = statistics.correlation_table(rows, row_id=["id"], rep="rep", proxies=["p"], signals=["s"]).collect()
    assert len(got) == 1 and 0.9 < got[0]["median_abs_per_rep_pearson"] < 1
    assert len(plans) == 1 and "_rank" not in plans[0]
