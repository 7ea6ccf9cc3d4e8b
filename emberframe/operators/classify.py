"""Threshold and centroid classifiers, their held-out evaluation and metrics.

Sample tables are long: keys, ``feature``, ``value``, ``label`` (0/1), ``fold``
and a sample id. All fits work on counts of equal values or on moments, so the
training rows are aggregated once, however many folds there are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberframe.functions.numbers import is_finite
from emberframe.operators.joins import asof_pairs
from emberframe.operators.ordered import (
    Series,
    following,
    previous,
    running_sum,
    scan,
    with_group_stats,
)
from emberframe.operators.windows import final_window

HARD_MIN_PERCENT = 70.0
NOT_HARD_MAX_PERCENT = 50.0


def hold_samples(
    rows: DataFrame, keys: list[str], at: str, target: str, features: list[str], *,
    window_s: float = 1.0, hard_min: float = HARD_MIN_PERCENT, not_hard_max: float = NOT_HARD_MAX_PERCENT,
) -> DataFrame:
    """One sample per prompted hold: feature means over its last stretch.

    Frozen and jumping frames and rows with an unusable number are dropped first,
    holds between the two label limits afterwards.
    """
    usable = ~F.coalesce(F.col("frozen_frame_flag"), F.lit(False))
    usable = usable & ~F.coalesce(F.col("agc_jump_flag"), F.lit(False))
    for name in (at, target, *features):
        usable = usable & is_finite(F.col(name))
    last = final_window(rows.filter(usable), keys, at, window_s)
    samples = last.groupBy(*keys).agg(
        F.min_by(target, at).alias("target_percent"),
        F.count(F.lit(1)).alias("final_window_frame_count"),
        *[F.avg(f).alias(f) for f in features],
    )
    label = F.when(F.col("target_percent") >= hard_min, 1).when(F.col("target_percent") <= not_hard_max, 0)
    return samples.withColumn("hard_label", label).filter(F.col("hard_label").isNotNull())


def long_features(samples: DataFrame, kept: list[str], features: list[str]) -> DataFrame:
    pairs = F.array(
        *[F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("value")) for f in features]
    )
    return samples.select(*kept, F.explode(pairs).alias("_f")).select(*kept, "_f.*")


def balanced(sensitivity: Column, specificity: Column) -> Column:
    """Mean of the two rates; one alone when the other has no samples."""
    return F.coalesce((sensitivity + specificity) / 2, sensitivity, specificity)


def rank_auc(df: DataFrame, keys: list[str], score: str, label: str) -> DataFrame:
    """Probability that a positive outscores a negative, ties a half; null for one class.

    From counts of equal scores alone: no score is computed twice and joined to itself.
    """
    counted = df.where(F.col(score).isNotNull()).groupBy(*keys, score).agg(
        F.count(F.lit(1)).alias("_same"),
        F.count(F.when(F.col(label) == 1, 1)).alias("_p"),
        F.count(F.when(F.col(label) == 0, 1)).alias("_n"),
    )
    ranked = scan(counted, Series(tuple(keys), (score,)), {"_upto": running_sum(F.col("_same"))})
    rank = F.col("_upto") - F.col("_same") + (F.col("_same") + 1) / 2
    sums = ranked.groupBy(*keys).agg(F.sum(F.col("_p") * rank).alias("_ranks"), F.sum("_p").alias("_p"), F.sum("_n").alias("_n"))
    p, n = F.col("_p").cast("double"), F.col("_n").cast("double")
    auc = F.when((p > 0) & (n > 0), F.try_divide(F.col("_ranks") - p * (p + 1) / 2, p * n))
    return sums.select(*keys, auc.alias("rank_auc"))


def balanced_metrics(df: DataFrame, keys: list[str], label: str, prediction: str, score: str) -> DataFrame:
    """Sensitivity, specificity, balanced accuracy and rank AUC per group."""
    hit = F.when(F.col(prediction) == F.col(label), 1.0).otherwise(0.0)
    rates = df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        F.avg(F.when(F.col(label) == 1, hit)).alias("sensitivity"),
        F.avg(F.when(F.col(label) == 0, hit)).alias("specificity"),
    )
    rates = rates.withColumn("balanced_accuracy", balanced(F.col("sensitivity"), F.col("specificity")))
    return rates.join(rank_auc(df, keys, score, label), keys)


def _value_counts(samples: DataFrame, keys: list[str]) -> DataFrame:
    return samples.groupBy(*keys, "value").agg(
        F.count(F.when(F.col("label") == 1, 1)).alias("pos"),
        F.count(F.when(F.col("label") == 0, 1)).alias("neg"),
    )


def _fit_counts(counts: DataFrame, keys: list[str], rows_per_chunk: int | None) -> DataFrame:
    """Best threshold rule from counts per distinct value.

    Each value offers the cut just above it: the middle to the next value, or an
    outer margin after the last; the first value also offers the cut below it.
    """
    by_value = Series(tuple(keys), ("value",))
    totals = with_group_stats(
        counts, keys,
        {
            "_P": F.sum("pos"), "_N": F.sum("neg"),
            "_lo": F.min("value"), "_hi": F.max("value"),
        },
    )
    walked = scan(
        totals, by_value,
        {
            "_pos_to": running_sum(F.col("pos")), "_neg_to": running_sum(F.col("neg")),
            "_next": following(F.col("value")), "_prev": previous(F.col("value")),
        },
        rows_per_chunk=rows_per_chunk,
    )
    margin = F.greatest(F.lit(1.0), (F.col("_hi") - F.col("_lo")) * 0.01)
    single = F.col("_lo") == F.col("_hi")
    upper = F.when(F.col("_next").isNull(), F.col("_hi") + margin).otherwise(
        (F.col("value") + F.col("_next")) / 2
    )
    cut = lambda t, p, n, both: F.struct(
        t.alias("threshold"), p.alias("pos_below"), n.alias("neg_below"), both.alias("all_positive")
    )
    zero = F.lit(0).cast("long")
    above = F.when(~single, cut(upper, F.col("_pos_to"), F.col("_neg_to"), F.lit(False)))
    below = F.when(
        ~single & F.col("_prev").isNull(), cut(F.col("_lo") - margin, zero, zero, F.lit(False))
    )
    alone = F.when(single, cut(F.col("value"), zero, zero, F.lit(True)))
    cuts = F.filter(F.array(above, below, alone), lambda c: c.isNotNull())
    offered = walked.select(*keys, "_P", "_N", F.explode(cuts).alias("_c"))
    P, N = F.col("_P").cast("double"), F.col("_N").cast("double")
    pb, nb, every = F.col("_c.pos_below"), F.col("_c.neg_below"), F.col("_c.all_positive")

    def rule(sign: int) -> Column:
        if sign > 0:
            tp, tn = F.col("_P") - pb, nb
        else:
            tp = F.when(every, F.col("_P")).otherwise(pb)
            tn = F.when(every, zero).otherwise(F.col("_N") - nb)
        accuracy = balanced(F.when(P > 0, F.try_divide(tp, P)), F.when(N > 0, F.try_divide(tn, N)))
        return F.struct(
            accuracy.alias("accuracy"), F.lit(sign).alias("sign"),
            (-F.col("_c.threshold")).alias("negated"),
        )

    best = F.max(F.greatest(rule(1), rule(-1)))
    return offered.groupBy(*keys).agg(best.alias("_b")).select(
        *keys,
        F.col("_b.accuracy").alias("train_balanced_accuracy"),
        F.col("_b.sign").alias("sign"),
        (-F.col("_b.negated")).alias("threshold"),
    )


def fit_threshold(samples: DataFrame, keys: list[str], *, rows_per_chunk: int | None = None) -> DataFrame:
    """Best (sign, threshold) per group: accuracy, then positive sign, then smaller threshold."""
    return _fit_counts(_value_counts(samples, keys), keys, rows_per_chunk)


def apply_threshold(df: DataFrame) -> DataFrame:
    """Score and 0/1 prediction of joined rules."""
    score = F.col("sign") * (F.col("value") - F.col("threshold"))
    return df.withColumn("score", score).withColumn(
        "prediction", F.when(F.col("score") >= 0, 1).otherwise(0)
    )


def leave_one_fold_out(
    samples: DataFrame, keys: list[str], *, rows_per_chunk: int | None = None
) -> DataFrame:
    """Univariate rules fitted without each fold and applied to it.

    A fold's training counts are the totals minus its own, so the fits run on
    (distinct value, fold) counts; folds are the few sequences of one recording.
    """
    own = _value_counts(samples, [*keys, "fold"])
    totals = own.groupBy(*keys, "value").agg(F.sum("pos").alias("_tp"), F.sum("neg").alias("_tn"))
    folds = samples.select(*keys, "fold").distinct()
    spread = totals.join(folds, keys).join(own, [*keys, "fold", "value"], "left")
    kept = lambda total, mine: F.col(total) - F.coalesce(F.col(mine), F.lit(0))
    train = spread.select(
        *keys, "fold", "value", kept("_tp", "pos").alias("pos"), kept("_tn", "neg").alias("neg")
    ).filter(F.col("pos") + F.col("neg") > 0)
    rules = _fit_counts(train, [*keys, "fold"], rows_per_chunk)
    return apply_threshold(samples.join(rules, [*keys, "fold"]))


def centroid_scores(samples: DataFrame, keys: list[str], sample_id: list[str]) -> DataFrame:
    """Nearest-centroid prediction per sample, trained without the sample's fold.

    z-scoring by the training spread turns the distance to a class centroid into
    sum(((x - class mean) / spread)^2), so only training moments are needed; they
    are totals minus the fold's own, taken around the group mean for accuracy.
    """
    at = [*keys, "feature"]
    centred = with_group_stats(samples, at, {"_m": F.avg("value")}).withColumn(
        "_x", F.col("value") - F.col("_m")
    )
    hard, soft = F.col("label") == 1, F.col("label") == 0
    sums = {
        "n": F.count(F.lit(1)).cast("double"),
        "s": F.sum("_x"),
        "ss": F.sum(F.col("_x") * F.col("_x")),
        "hn": F.count(F.when(hard, 1)).cast("double"),
        "hs": F.coalesce(F.sum(F.when(hard, F.col("_x"))), F.lit(0.0)),
        "sn": F.count(F.when(soft, 1)).cast("double"),
        "sums": F.coalesce(F.sum(F.when(soft, F.col("_x"))), F.lit(0.0)),
    }
    own = centred.groupBy(*at, "fold").agg(*[e.alias(n) for n, e in sums.items()])
    whole = own.groupBy(*at).agg(*[F.sum(n).alias(f"_{n}") for n in sums])
    train = own.join(whole, at).select(
        *at, "fold", *[(F.col(f"_{n}") - F.col(n)).alias(f"t_{n}") for n in sums]
    )
    ratio = lambda a, b: F.when(F.col(b) > 0, F.try_divide(F.col(a), F.col(b)))
    mean, square = ratio("t_s", "t_n"), ratio("t_ss", "t_n")
    variance = square - mean * mean
    flat = variance <= F.greatest(F.abs(square), F.lit(1.0)) * F.lit(1e-14)
    spread = F.when(flat, F.lit(1.0)).otherwise(F.sqrt(F.greatest(variance, F.lit(0.0))))
    fitted = train.select(
        *at, "fold", spread.alias("_sd"),
        ratio("t_hs", "t_hn").alias("_hard"), ratio("t_sums", "t_sn").alias("_soft"),
    )
    gap = lambda c: F.pow(F.try_divide(F.col("_x") - F.col(c), F.col("_sd")), 2)
    scored = centred.join(fitted, [*at, "fold"]).groupBy(*keys, "fold", *sample_id, "label").agg(
        F.sum(gap("_hard")).alias("_dh"), F.sum(gap("_soft")).alias("_ds")
    )
    return scored.withColumns(
        {
            "prediction": F.when(F.col("_dh") < F.col("_ds"), 1).otherwise(0),
            "score": F.col("_ds") - F.col("_dh"),
        }
    ).drop("_dh", "_ds")


def cross_group_metrics(
    samples: DataFrame, group: str, *, rows_per_chunk: int | None = None
) -> DataFrame:
    """Rules fitted on each group, judged on every other group, per feature.

    The result itself has one row per ordered pair of groups and feature. Test
    counts beside a threshold come from one as-of pass over the cumulative value
    counts, so no test sample is joined to a rule.
    """
    keys = [group, "feature"]
    counts = _value_counts(samples, keys)
    rules = _fit_counts(counts, keys, rows_per_chunk)
    walked = scan(
        counts, Series((group, "feature"), ("value",)),
        {"pos_to": running_sum(F.col("pos")), "neg_to": running_sum(F.col("neg"))},
        rows_per_chunk=rows_per_chunk,
    ).select(F.col(group).alias("test"), "feature", F.col("value").alias("threshold"), "pos_to", "neg_to")
    totals = counts.groupBy(*keys).agg(F.sum("pos").alias("_P"), F.sum("neg").alias("_N"))
    tests = totals.select(F.col(group).alias("test"), "feature", "_P", "_N")
    pairs = rules.withColumnRenamed(group, "train").join(tests, "feature").filter(
        F.col("train") != F.col("test")
    )

    def beside(sign: int) -> DataFrame:
        chosen = pairs.filter(F.col("sign") == sign)
        return asof_pairs(
            chosen, walked, ["test", "feature"], "threshold", ["pos_to", "neg_to"],
            inclusive=sign < 0, rows_per_chunk=rows_per_chunk,
        )

    seen = beside(1).unionByName(beside(-1))
    below = lambda c: F.coalesce(F.col(c), F.lit(0))
    tp = F.when(F.col("sign") > 0, F.col("_P") - below("pos_to")).otherwise(below("pos_to"))
    tn = F.when(F.col("sign") > 0, below("neg_to")).otherwise(F.col("_N") - below("neg_to"))
    rate = lambda hits, total: F.when(F.col(total) > 0, F.try_divide(hits, F.col(total).cast("double")))
    judged = seen.select(
        "train", "test", "feature", "train_balanced_accuracy", "sign", "threshold",
        rate(tp, "_P").alias("sensitivity"), rate(tn, "_N").alias("specificity"),
    )
    auc = rank_auc(samples, keys, "value", "label").select(
        F.col(group).alias("test"), "feature", F.col("rank_auc").alias("_auc")
    )
    directed = F.when(F.col("sign") > 0, F.col("_auc")).otherwise(1 - F.col("_auc"))
    return judged.join(auc, ["test", "feature"]).withColumns(
        {
            "balanced_accuracy": balanced(F.col("sensitivity"), F.col("specificity")),
            "rank_auc": directed,
        }
    ).drop("_auc")


def best_model(metrics: DataFrame, keys: list[str], name: str = "feature") -> DataFrame:
    """Row with the best balanced accuracy per group; first name on ties."""
    fields = [c for c in metrics.columns if c not in keys]
    order = F.struct((-F.col("balanced_accuracy")).alias("_a"), F.col(name))
    return metrics.groupBy(*keys).agg(F.min_by(F.struct(*fields), order).alias("_r")).select(*keys, "_r.*")
