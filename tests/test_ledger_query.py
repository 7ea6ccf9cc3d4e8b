"""The ledger query collects what differs from line to line, and nothing that all trials share."""

from emberframe.catalog import QUERIES


def test_lines_are_collected_without_what_all_trials_share(spark, tmp_path):
    orders = [(1, 1, "F"), (2, 2, "O"), (3, 1, "F")]
    lines = [(1, 2, 9.0, "A", 0.01, "O", 0.0), (1, 1, 50.0, "N", 0.07, "F", 0.06), (2, 1, 1.0, "R", 0.0, "O", 0.0)]
    root = str(tmp_path)
    spark.createDataFrame(orders, "o_orderkey long, o_custkey long, o_orderstatus string").write.parquet(f"{root}/orders.parquet")
    kinds = "l_orderkey long, l_linenumber int, l_quantity double, l_returnflag string, l_tax double, l_linestatus string, l_discount double"
    spark.createDataFrame(lines, kinds).write.parquet(f"{root}/lineitem.parquet")
    out = QUERIES["ledger_schema"](spark, root)
    collected = [line for line in out._jdf.queryExecution().optimizedPlan().toString().split("\n") if "collect_list(" in line]
    assert collected and not any("a" * 64 in line for line in collected)
    frames, trials = "$.realsense_profile_verification.complete_aligned_frames:minimum", "$.trials[]"
    assert {r.o_orderkey: r.violations.split("|") for r in out.collect()} == {
        1: ["$.prior_failed_run_id:type?then", frames, f"{trials}.abort_reason:enum?then", f"{trials}.label:enum", f"{trials}.scheduled_slot:maximum"],
        2: ["$.session_attempt:enum", f"{trials}.artifacts.thermal:type?then"],
        3: [""],
    }
