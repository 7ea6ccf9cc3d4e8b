"""Classifier fits and metrics over ``lineitem`` orders and labelled documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from emberframe.catalog.bindings import q, table, telemetry, with_telemetry
from emberframe.catalog.registry import query
from emberframe.operators import classify
from emberframe.operators.settle import settle

_FEATURES = ["price", "quantity", "discount"]

# Samples: one per order; label from its most common flag side, trial = ship mode bucket.
_SAMPLES = """
WITH o AS (SELECT l_orderkey, l_orderkey % 4 AS trial, (l_orderkey // 4) % 5 AS fold,
  CASE WHEN avg(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) >= 0.4 THEN 1 ELSE 0 END AS label,
  CAST(round(avg(l_extendedprice) / 500 + CASE WHEN avg(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) >= 0.4 THEN 9 ELSE 0 END) AS DOUBLE) AS price,
  sum(l_quantity) AS quantity, CAST(max(CAST(round(l_discount * 100) AS INTEGER)) AS DOUBLE) AS discount FROM lineitem GROUP BY l_orderkey),
s AS (SELECT l_orderkey, trial, fold, label, 'price' AS feature, price AS value FROM o UNION ALL
      SELECT l_orderkey, trial, fold, label, 'quantity', quantity FROM o UNION ALL
      SELECT l_orderkey, trial, fold, label, 'discount', discount FROM o)"""


def _samples(spark, root):
    """The orders are written once: every fit and every score reads them, and they are far smaller than their lines."""
    share = F.avg(F.when(F.col("l_returnflag") == "R", 1).otherwise(0))
    label = F.when(share >= 0.4, 1).otherwise(0)
    orders = table(spark, root, "lineitem").groupBy("l_orderkey").agg(
        label.alias("label"),
        F.round(F.avg("l_extendedprice") / 500 + F.when(share >= 0.4, 9).otherwise(0)).alias("price"),
        F.sum("l_quantity").alias("quantity"),
        F.max(F.round(F.col("l_discount") * 100).cast("int")).cast("double").alias("discount"),
    )
    orders = orders.withColumns(
        {"trial": F.col("l_orderkey") % 4, "fold": F.floor(F.col("l_orderkey") / 4) % 5}
    )
    return classify.long_features(settle(orders), ["l_orderkey", "trial", "fold", "label"], _FEATURES)


# Candidate cuts and their accuracy, by sorted cumulative counts.
def _rules_sql(source: str, keys: str) -> str:
    return f"""
vc AS (SELECT {keys}, value, count(CASE WHEN label = 1 THEN 1 END) AS p, count(CASE WHEN label = 0 THEN 1 END) AS n FROM {source} GROUP BY ALL),
cu AS (SELECT *, sum(p) OVER w AS pt, sum(n) OVER w AS nt, lead(value) OVER w AS nx, lag(value) OVER w AS pv,
  sum(p) OVER g AS tp, sum(n) OVER g AS tn, min(value) OVER g AS lo, max(value) OVER g AS hi FROM vc
  WINDOW w AS (PARTITION BY {keys} ORDER BY value), g AS (PARTITION BY {keys})),
cd AS (SELECT {keys}, tp, tn, CASE WHEN nx IS NULL THEN hi + greatest(1.0, (hi - lo) * 0.01) ELSE (value + nx) / 2 END AS thr, pt, nt, false AS al FROM cu WHERE lo < hi
  UNION ALL SELECT {keys}, tp, tn, lo - greatest(1.0, (hi - lo) * 0.01), 0, 0, false FROM cu WHERE lo < hi AND pv IS NULL
  UNION ALL SELECT {keys}, tp, tn, value, 0, 0, true FROM cu WHERE lo = hi),
sg AS (SELECT *, 1 AS sign, (tp - pt) AS hp, nt AS hn FROM cd UNION ALL
  SELECT *, -1, CASE WHEN al THEN tp ELSE pt END, CASE WHEN al THEN 0 ELSE tn - nt END FROM cd),
ac AS (SELECT *, CASE WHEN tp > 0 AND tn > 0 THEN (hp / tp + hn / tn) / 2 WHEN tp > 0 THEN hp / tp ELSE hn / tn END AS acc FROM sg),
rl AS (SELECT * FROM ac QUALIFY row_number() OVER (PARTITION BY {keys} ORDER BY acc DESC, sign DESC, thr) = 1)"""


@query(
    "threshold_rule",
    _SAMPLES + "," + _rules_sql("s", "trial, feature")
    + "\nSELECT trial, feature, round(acc, 6) AS train_balanced_accuracy, sign, round(thr, 6) AS threshold FROM rl",
)
def threshold_rule(spark, root):
    rules = classify.fit_threshold(_samples(spark, root), ["trial", "feature"])
    return rules.withColumns({n: q(n) for n in ("train_balanced_accuracy", "threshold")})


def _metrics_sql(source: str, keys: str) -> str:
    return f"""
rk AS (SELECT *, rank() OVER (PARTITION BY {keys} ORDER BY score) + (count(*) OVER (PARTITION BY {keys}, score) - 1) / 2 AS rk FROM {source}),
mt AS (SELECT {keys}, count(*) AS n, avg(CASE WHEN label = 1 THEN CASE WHEN prediction = 1 THEN 1 ELSE 0 END END) AS sens,
  avg(CASE WHEN label = 0 THEN CASE WHEN prediction = 0 THEN 1 ELSE 0 END END) AS spec,
  sum(CASE WHEN label = 1 THEN rk END) AS rs, count(CASE WHEN label = 1 THEN 1 END) AS p, count(CASE WHEN label = 0 THEN 1 END) AS m FROM rk GROUP BY ALL)"""


_METRIC_COLUMNS = """n, round(sens, 6) AS sensitivity, round(spec, 6) AS specificity, round(coalesce((sens + spec) / 2, sens, spec), 6) AS balanced_accuracy,
  round(CASE WHEN p > 0 AND m > 0 THEN (rs - p * (p + 1) / 2) / (p * m) END, 6) AS rank_auc"""
_ROUNDED = ("sensitivity", "specificity", "balanced_accuracy", "rank_auc")


@query(
    "balanced_metrics",
    """
WITH d AS (SELECT source, quality AS label, CASE WHEN n_chars >= 900 THEN 1 ELSE 0 END AS prediction, n_chars AS score
  FROM documents JOIN labels USING (doc_id)),"""
    + _metrics_sql("d", "source")
    + f"\nSELECT source, {_METRIC_COLUMNS} FROM mt",
)
def balanced_metrics(spark, root):
    docs = table(spark, root, "documents").select("doc_id", "source", "n_chars")
    joined = docs.join(table(spark, root, "labels").select("doc_id", "quality"), "doc_id")
    joined = joined.withColumn("prediction", F.when(F.col("n_chars") >= 900, 1).otherwise(0))
    out = classify.balanced_metrics(joined, ["source"], "quality", "prediction", "n_chars")
    return out.withColumns({n: q(n) for n in _ROUNDED})


_LOFO = (
    _SAMPLES
    + """, fs AS (SELECT DISTINCT trial, feature, fold AS held FROM s),
tr AS (SELECT s.*, held FROM s JOIN fs ON fs.trial = s.trial AND fs.feature = s.feature WHERE s.fold <> held),"""
    + _rules_sql("tr", "trial, feature, held")
    + """, pd AS (SELECT s.trial, s.feature, s.label, sign * (value - thr) AS score, CASE WHEN sign * (value - thr) >= 0 THEN 1 ELSE 0 END AS prediction
  FROM s JOIN rl ON rl.trial = s.trial AND rl.feature = s.feature AND rl.held = s.fold)"""
)


@query(
    "leave_one_group_out",
    _LOFO + "," + _metrics_sql("pd", "trial, feature") + f"\nSELECT trial, feature, {_METRIC_COLUMNS} FROM mt",
)
def leave_one_group_out(spark, root):
    return _held_out(spark, root).withColumns({n: q(n) for n in _ROUNDED})


def _held_out(spark, root):
    scored = classify.leave_one_fold_out(_samples(spark, root), ["trial", "feature"])
    return classify.balanced_metrics(scored, ["trial", "feature"], "label", "prediction", "score")


@query(
    "best_univariate",
    _LOFO + "," + _metrics_sql("pd", "trial, feature")
    + """, r AS (SELECT trial, feature, n, coalesce((sens + spec) / 2, sens, spec) AS acc FROM mt)
SELECT trial, feature, n, round(acc, 6) AS balanced_accuracy FROM r QUALIFY row_number() OVER (PARTITION BY trial ORDER BY acc DESC, feature) = 1""",
)
def best_univariate(spark, root):
    best = classify.best_model(_held_out(spark, root), ["trial"])
    return best.select("trial", "feature", "n", q("balanced_accuracy").alias("balanced_accuracy"))


@query(
    "nearest_centroid",
    _SAMPLES
    + """, fs AS (SELECT DISTINCT trial, fold AS held FROM s),
st AS (SELECT s.trial, feature, held, CASE WHEN stddev_pop(value) = 0 THEN 1 ELSE stddev_pop(value) END AS sd,
  avg(CASE WHEN label = 1 THEN value END) AS h, avg(CASE WHEN label = 0 THEN value END) AS l FROM s JOIN fs ON fs.trial = s.trial WHERE s.fold <> held GROUP BY ALL),
ds AS (SELECT s.trial, s.l_orderkey, s.fold, s.label, sum(((value - h) / sd) ** 2) AS dh, sum(((value - l) / sd) ** 2) AS dl
  FROM s JOIN st ON st.trial = s.trial AND st.feature = s.feature AND st.held = s.fold GROUP BY ALL)
SELECT trial, l_orderkey, fold, label, CASE WHEN dh < dl THEN 1 ELSE 0 END AS prediction, round(dl - dh, 5) AS score FROM ds""",
)
def nearest_centroid(spark, root):
    out = classify.centroid_scores(_samples(spark, root), ["trial"], ["l_orderkey"])
    return out.withColumn("score", q("score", 5))


@query(
    "cross_trial",
    _SAMPLES + "," + _rules_sql("s", "trial, feature")
    + """, pd AS (SELECT rl.trial AS train, s.trial AS test, s.feature, label, acc, sign, thr, sign * (value - thr) AS score,
  CASE WHEN sign * (value - thr) >= 0 THEN 1 ELSE 0 END AS prediction FROM s JOIN rl ON rl.feature = s.feature AND rl.trial <> s.trial),"""
    + _metrics_sql("pd", "train, test, feature, acc, sign, thr")
    + """
SELECT train, test, feature, round(acc, 6) AS train_balanced_accuracy, sign, round(thr, 6) AS threshold,
  round(sens, 6) AS sensitivity, round(spec, 6) AS specificity, round(coalesce((sens + spec) / 2, sens, spec), 6) AS balanced_accuracy,
  round(CASE WHEN p > 0 AND m > 0 THEN (rs - p * (p + 1) / 2) / (p * m) END, 6) AS rank_auc FROM mt""",
)
def cross_trial(spark, root):
    out = classify.cross_group_metrics(_samples(spark, root), "trial")
    return out.withColumns({n: q(n) for n in (*_ROUNDED, "train_balanced_accuracy", "threshold")})


@query(
    "hold_samples",
    with_telemetry(
        """
, k AS (SELECT trial, phase, t, CAST(counter AS DOUBLE) AS target, signal, frame % 11 = 0 AS frozen, frame % 13 = 0 AS jump FROM ev),
u AS (SELECT * FROM k WHERE NOT frozen AND NOT jump), m AS (SELECT *, max(t) OVER (PARTITION BY trial, phase) AS e FROM u),
a AS (SELECT trial, phase, arg_min(target, t) AS target_percent, count(*) AS final_window_frame_count, avg(signal) AS signal FROM m WHERE t >= e - 172800 GROUP BY ALL)
SELECT trial, phase, target_percent, final_window_frame_count, round(signal, 6) AS signal, CASE WHEN target_percent >= 70 THEN 1 ELSE 0 END AS hard_label
FROM a WHERE target_percent >= 70 OR target_percent <= 50"""
    ),
)
def hold_samples(spark, root):
    rows = telemetry(spark, root).withColumns(
        {
            "target": F.col("counter").cast("double"),
            "frozen_frame_flag": F.col("frame") % 11 == 0,
            "agc_jump_flag": F.col("frame") % 13 == 0,
        }
    )
    out = classify.hold_samples(rows, ["trial", "phase"], "t", "target", ["signal"], window_s=172800.0)
    return out.withColumn("signal", q("signal"))
