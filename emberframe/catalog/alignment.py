"""Joins, phase windows, routing and ledger checks over the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from emberframe.catalog.bindings import EVENT_SERIES, q, table, telemetry, with_telemetry
from emberframe.catalog.registry import query
from emberframe.functions import text
from emberframe.operators import contracts, joins
from emberframe.operators.ordered import Series
from emberframe.operators.repeatability import phase_windows

_W = "(PARTITION BY trial ORDER BY t_us, frame)"


@query(
    "positional_join",
    with_telemetry(
        """
, a AS (SELECT trial, signal, row_number() OVER (PARTITION BY trial ORDER BY t_us, frame) AS row FROM ev WHERE phase <> 'error'),
b AS (SELECT trial, counter, row_number() OVER (PARTITION BY trial ORDER BY t_us, frame) AS row FROM ev)
SELECT trial, row, a.signal, b.counter, a.row IS NOT NULL AND b.row IS NOT NULL AS matched
FROM a FULL JOIN b USING (trial, row)"""
    ),
)
def positional_join(spark, root):
    rows = telemetry(spark, root)
    features = rows.filter(F.col("phase") != "error").select("trial", "t_us", "frame", "signal")
    counters = rows.select("trial", "t_us", "frame", "counter")
    out = joins.positional_join(features, counters, EVENT_SERIES)
    return out.select("trial", "row", "signal", "counter", "matched")


@query(
    "frame_join_last_wins",
    with_telemetry(
        """
, f AS (SELECT trial, phase, arg_max(signal, (t_us, frame)) AS feature FROM ev GROUP BY trial, phase)
SELECT ev.trial, ev.frame, ev.phase, feature FROM ev JOIN f USING (trial, phase)"""
    ),
)
def frame_join_last_wins(spark, root):
    rows = telemetry(spark, root)
    features = rows.select("trial", "phase", "t_us", "frame", F.col("signal").alias("feature"))
    out = joins.frame_join(
        rows.select("trial", "phase", F.col("frame").alias("id")), features,
        ["trial", "phase"], F.struct("t_us", "frame"),
    )
    return out.select("trial", F.col("id").alias("frame"), "phase", "feature")


@query(
    "invalid_anti_join",
    with_telemetry(
        """
, bad AS (SELECT DISTINCT trial, counter FROM ev WHERE phase = 'error')
SELECT trial, frame, counter FROM ev WHERE (trial, counter) NOT IN (SELECT trial, counter FROM bad)"""
    ),
)
def invalid_anti_join(spark, root):
    rows = telemetry(spark, root)
    events = rows.select(
        "trial", "counter",
        F.when(F.col("phase") == "error", "invalid").otherwise(F.col("phase")).alias("event_type"),
    )
    kept = joins.without_invalid_actions(rows, events, ["trial", "counter"])
    return kept.select("trial", "frame", "counter")


_PHASES = f"""
, e AS (SELECT trial, t_us, frame, phase, signal,
        row_number() OVER (PARTITION BY trial ORDER BY t_us, frame) AS n FROM ev),
w AS (SELECT trial, (n - 1) // 10 AS block, min(t_us) AS s, max(t_us) AS x FROM e GROUP BY ALL)"""


@query(
    "interval_join",
    with_telemetry(
        """
, w AS (SELECT trial, phase AS label, min(t_us) AS s, max(t_us) AS x FROM ev GROUP BY trial, phase)
SELECT ev.trial, ev.frame, arg_min(w.label, w.label) AS label FROM ev JOIN w
  ON w.trial = ev.trial AND ev.t_us BETWEEN w.s AND w.x GROUP BY ev.trial, ev.frame"""
    ),
)
def interval_join(spark, root):
    rows = telemetry(spark, root)
    spans = rows.groupBy("trial", F.col("phase").alias("label")).agg(
        F.min("t_us").alias("start"), F.max("t_us").alias("end")
    )
    out = joins.interval_join(
        rows.select("trial", "frame", "t_us"), spans, ["trial"], "t_us",
        bucket=86_400_000_000, row_id=["frame"], rank="label",
    )
    return out.select("trial", "frame", "label")


@query(
    "asof_pair",
    with_telemetry(
        """
, c AS (SELECT trial, t AS right_t, t_us AS r_us, max(signal) AS right_signal FROM ev WHERE phase = 'click' GROUP BY ALL),
p AS (SELECT v.trial, v.frame, v.t, c.right_t, c.right_signal FROM (SELECT * FROM ev WHERE phase = 'view') v
      ASOF LEFT JOIN c ON v.trial = c.trial AND v.t_us >= c.r_us)
SELECT trial, frame, round(t - right_t, 6) AS sensor_skew_s, right_signal,
  CASE WHEN right_t IS NULL THEN 'sample_missing'
       WHEN t - right_t > 172800 AND t - right_t > 86400 THEN 'first_stale|skew_exceeded'
       WHEN t - right_t > 86400 THEN 'skew_exceeded' ELSE '' END AS reasons FROM p"""
    ),
)
def asof_pair(spark, root):
    rows = telemetry(spark, root)
    views = rows.filter(F.col("phase") == "view").select("trial", "frame", "t")
    clicks = rows.filter(F.col("phase") == "click").select(
        "trial", "t", F.col("signal").alias("right_signal")
    )
    paired = joins.asof_pairs(views, clicks, ["trial"], "t", ["right_signal"])
    verdict = joins.pairing_verdict(
        F.col("t"), F.col("right_t"), F.col("t"),
        max_first_age=172800.0, max_second_age=1.0, max_skew=86400.0,
    )
    return paired.select(
        "trial", "frame", q(verdict["sensor_skew_s"]).alias("sensor_skew_s"), "right_signal",
        F.concat_ws("|", verdict["reasons"]).alias("reasons"),
    )


@query(
    "stream_reconciliation",
    with_telemetry(
        """
, a AS (SELECT trial, count(*) AS n FROM ev WHERE phase = 'view' GROUP BY trial),
b AS (SELECT trial, count(*) AS n FROM ev WHERE phase = 'click' GROUP BY trial),
j AS (SELECT trial, coalesce(a.n, 0) AS n_thermal, coalesce(b.n, 0) AS n_visible FROM a FULL JOIN b USING (trial))
SELECT *, CASE WHEN n_thermal = 0 THEN 'missing_thermal' WHEN n_visible = 0 THEN 'missing_visible'
  WHEN n_thermal <> n_visible THEN 'count_mismatch_visible' END AS reason FROM j"""
    ),
)
def stream_reconciliation(spark, root):
    rows = telemetry(spark, root)
    return joins.stream_counts(
        {
            "thermal": rows.filter(F.col("phase") == "view"),
            "visible": rows.filter(F.col("phase") == "click"),
        },
        ["trial"],
    )


@query(
    "pair_by_number",
    """
WITH n AS (SELECT page_id, CASE WHEN page_id % 9 = 0 THEN 'cover.png' ELSE 'f_' || lpad(CAST(page_id * 7 % 17 AS VARCHAR), 4, '0') || '_' || regexp_extract(url, '//([^./]+)', 1) || page_id || '.png' END AS name FROM pages),
m AS (SELECT *, CAST(nullif(regexp_extract(name, '(\\d+)', 1), '') AS BIGINT) AS number FROM n),
a AS (SELECT number, arg_max(page_id, name) AS left_page_id, max(name) AS left_name FROM m WHERE page_id % 2 = 0 AND number IS NOT NULL GROUP BY number),
b AS (SELECT number, arg_max(page_id, name) AS right_page_id, max(name) AS right_name FROM m WHERE page_id % 2 = 1 AND number IS NOT NULL AND number % 5 <> 0 GROUP BY number)
SELECT number, left_name, left_page_id, right_name, right_page_id FROM a JOIN b USING (number)""",
)
def pair_by_number(spark, root):
    """Files of two cameras by the first number in their names; some names have none, some numbers one side."""
    pages, page = table(spark, root, "pages"), F.col("page_id")
    number = F.lpad((page * 7 % 17).cast("string"), 4, "0")
    named = F.concat(F.lit("f_"), number, F.lit("_"), F.regexp_extract("url", "//([^./]+)", 1), page.cast("string"), F.lit(".png"))
    files = pages.select("page_id", F.when(page % 9 == 0, "cover.png").otherwise(named).alias("name"))
    right = files.where((page % 2 == 1) & (F.regexp_extract("name", r"^f_(\d+)", 1).try_cast("long") % 5 != 0))
    return joins.pair_by_number(files.where(page % 2 == 0), right, "name")


@query(
    "longest_prefix_route",
    """
WITH f AS (SELECT DISTINCT replace(replace(p_name, ' ', '_'), '-', '_') || '_' || p_brand
             || CASE p_size % 4 WHEN 0 THEN '.csv' WHEN 1 THEN '.PNG' WHEN 2 THEN '.md' ELSE '.json' END AS name FROM part),
r AS (SELECT DISTINCT split_part(p_name, ' ', 1) AS prefix, split_part(p_name, ' ', 1) AS grp FROM part
      UNION SELECT DISTINCT replace(p_name, ' ', '_'), 'full ' || p_name FROM part),
m AS (SELECT name, arg_max(grp, length(prefix)) AS grp FROM f JOIN r
  ON name = prefix OR starts_with(name, prefix || '.') OR starts_with(name, prefix || '_') GROUP BY name)
SELECT f.name, m.grp AS "group", CASE regexp_extract(lower(f.name), '(\\.[^./]*)$', 1)
  WHEN '.csv' THEN 'csv' WHEN '.png' THEN 'figures' WHEN '.md' THEN 'reports' WHEN '.txt' THEN 'reports'
  WHEN '.json' THEN 'metadata' ELSE 'other' END AS kind
FROM f LEFT JOIN m USING (name)""",
)
def longest_prefix_route(spark, root):
    part = table(spark, root, "part")
    kinds = F.array(*[F.lit(k) for k in (".csv", ".PNG", ".md", ".json")])
    stem = F.regexp_replace("p_name", "[ -]", "_")
    names = part.select(
        F.concat(stem, F.lit("_"), "p_brand", F.get(kinds, F.col("p_size") % 4)).alias("name")
    ).distinct()
    word = F.substring_index("p_name", " ", 1)
    rules = part.select(word.alias("prefix"), word.alias("group")).union(
        part.select(F.regexp_replace("p_name", " ", "_"), F.concat(F.lit("full "), "p_name"))
    ).distinct().withColumn("group_rank", F.length("prefix"))
    routed = joins.longest_prefix(names, rules, "name")
    return routed.withColumn("kind", joins.artifact_kind(F.col("name")))


@query(
    "phase_windows_from_events",
    with_telemetry(
        """
, m AS (SELECT trial, counter AS name, t_us, frame,
        CASE phase WHEN 'view' THEN 'phase_start' WHEN 'click' THEN 'phase_end' END AS kind FROM ev),
a AS (SELECT trial, name, count(CASE WHEN kind = 'phase_start' THEN 1 END) AS starts,
   count(CASE WHEN kind = 'phase_end' THEN 1 END) AS ends,
   min(CASE WHEN kind = 'phase_start' THEN t_us END) AS "start",
   max(CASE WHEN kind = 'phase_end' THEN t_us END) AS "end" FROM m WHERE kind IS NOT NULL GROUP BY ALL)
SELECT trial, name, "start", "end", CASE WHEN starts > 1 THEN 'starts_more_than_once'
  WHEN starts = 0 THEN 'ends_without_start' WHEN ends = 0 THEN 'missing_end'
  WHEN ends > 1 THEN 'ends_more_than_once' WHEN "end" < "start" THEN 'ends_before_start' END AS violation FROM a"""
    ),
)
def phase_windows_from_events(spark, root):
    rows = telemetry(spark, root)
    kind = F.when(F.col("phase") == "view", "phase_start").when(F.col("phase") == "click", "phase_end")
    log = rows.select("trial", F.col("counter").alias("name"), "t_us", kind.alias("event_type"))
    return phase_windows(log.filter(F.col("event_type").isNotNull()), ["trial"], "name", "t_us")


_LEDGER = """
WITH c AS (SELECT conv_id, turn, role, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS rn,
        length(text) % 7 = 0 AS aborted, length(text) % 11 = 0 AS odd FROM conversations),
p AS (SELECT *, coalesce(sum(CASE WHEN aborted THEN 0 ELSE 1 END) OVER (PARTITION BY conv_id ORDER BY turn
        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + 1 AS expected_slot FROM c),
l AS (SELECT *, CASE WHEN odd THEN turn + 1 ELSE expected_slot END AS slot FROM p),
a AS (SELECT *, row_number() OVER (PARTITION BY conv_id, slot ORDER BY turn) AS expected_attempt FROM l),
b AS (SELECT *, CASE WHEN odd THEN 1 ELSE expected_attempt END AS attempt,
     CASE WHEN slot % 2 = 1 THEN 'loose' ELSE 'tight' END AS expected_label,
     CASE role WHEN 'user' THEN 'loose' ELSE 'tight' END AS label FROM a),
d AS (SELECT *, sum(CASE WHEN aborted THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id, expected_label ORDER BY turn) AS label_aborts,
     count(*) OVER (PARTITION BY conv_id, slot, attempt) AS copies FROM b),
v AS (SELECT conv_id, turn, concat_ws('|', CASE WHEN copies > 1 THEN 'duplicate_key' END,
     CASE WHEN slot <> expected_slot THEN 'slot_out_of_order' END,
     CASE WHEN attempt <> expected_attempt THEN 'attempt_mismatch' END,
     CASE WHEN label <> expected_label THEN 'label_mismatch' END,
     CASE WHEN aborted AND label_aborts > 5 THEN 'abort_budget_exceeded' END) AS violations FROM d)"""


def _ledger(spark, root):
    from emberframe.operators.ordered import row_index, running_sum, scan

    series = Series(("conv_id",), ("turn",))
    talk = table(spark, root, "conversations")
    aborted = F.length("text") % 7 == 0
    rows = talk.select(
        "conv_id", "turn", "role", aborted.alias("aborted"), (F.length("text") % 11 == 0).alias("odd")
    )
    done = F.when(F.col("aborted"), 0).otherwise(1).cast("long")
    rows = scan(rows, series, {"_done": running_sum(done)})
    rows = rows.withColumn(
        "slot", F.when(F.col("odd"), F.col("turn") + 1).otherwise(F.col("_done") - done + 1)
    ).drop("_done")
    rows = scan(rows, Series(("conv_id", "slot"), ("turn",)), {"_nth": row_index()})
    trials = rows.select(
        "conv_id", "turn", "slot",
        F.when(F.col("odd"), F.lit(1)).otherwise(F.col("_nth")).alias("attempt"),
        F.when(F.col("role") == "user", "loose").otherwise("tight").alias("label"),
        F.when(F.col("aborted"), "technical_abort").otherwise("completed").alias("outcome"),
        *[
            F.lit(flag).alias(name)
            for name, flag in (
                ("pretrial_ffc", True), ("ffc_reset", True), ("ffc_active", False),
                ("color_valid", True), ("thermal_valid", True),
                ("has_rgb", True), ("has_depth", True), ("has_thermal", True),
            )
        ],
    )
    longest = talk.groupBy("conv_id").agg((F.max("turn") + 2).cast("int").alias("n"))
    primary = longest.select("conv_id", F.expr("repeat('LT', n)").alias("primary"))
    slots = contracts.schedule_slots(primary, ["conv_id"], "primary")
    return contracts.ledger_violations(trials, slots, series), series


@query("ledger_violations", _LEDGER + "\nSELECT conv_id, turn, violations FROM v")
def ledger_violations(spark, root):
    rows, _ = _ledger(spark, root)
    return rows.select("conv_id", "turn", F.concat_ws("|", "violations").alias("violations"))


@query(
    "ledger_first_violation",
    _LEDGER
    + """
SELECT conv_id, count(*) AS attempts, count(CASE WHEN violations <> '' THEN 1 END) AS broken_rows,
  split_part(arg_min(CASE WHEN violations <> '' THEN violations END, turn), '|', 1) AS first_violation
FROM v GROUP BY conv_id""",
)
def ledger_first_violation(spark, root):
    rows, series = _ledger(spark, root)
    return contracts.first_violation(rows, series)


@query(
    "schedule_slots",
    """
WITH s AS (SELECT doc_id, string_agg(CASE WHEN ascii(c) % 2 = 0 THEN 'L' ELSE 'T' END, '' ORDER BY i) AS p FROM (
    SELECT doc_id, i, substr(sha, i, 1) AS c FROM (SELECT doc_id, substr(sha256(text), 1, 30) AS sha FROM documents),
      (SELECT unnest(range(1, 31)) AS i)) GROUP BY doc_id)
SELECT doc_id, i AS slot, substr(p, i, 1) AS letter,
  concat_ws('|', CASE WHEN length(replace(p, 'T', '')) <> 15 THEN 'label_balance' END, 'schedule_hash_mismatch') AS issues
FROM s, (SELECT unnest(range(1, 31)) AS i)""",
)
def schedule_slots(spark, root):
    docs = table(spark, root, "documents")
    head = F.split(F.substring(F.sha2("text", 256), 1, 30), "")
    letters = F.transform(head, lambda c: F.when(F.ascii(c) % 2 == 0, "L").otherwise("T"))
    plans = docs.select("doc_id", F.array_join(letters, "").alias("primary"))
    issues = contracts.schedule_issues(F.col("primary"), F.lit(None).cast("string"))
    plans = plans.withColumn("issues", F.concat_ws("|", issues))
    slots = contracts.schedule_slots(plans, ["doc_id", "issues"], "primary")
    return slots.select("doc_id", "slot", "letter", "issues")


@query(
    "freshness_guard",
    """
SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)""",
)
def freshness_guard(spark, root):
    planned = table(spark, root, "customer").select("c_custkey")
    recorded = table(spark, root, "orders").select(F.col("o_custkey").alias("c_custkey"))
    return contracts.not_fresh(planned, recorded, ["c_custkey"])


@query(
    "missing_grid_cells",
    """
SELECT u.user_id, p.event_type FROM (SELECT DISTINCT user_id FROM events) u,
  (SELECT DISTINCT event_type FROM events) p
WHERE NOT EXISTS (SELECT 1 FROM events e WHERE e.user_id = u.user_id AND e.event_type = p.event_type
  AND e.value > 60)""",
)
def missing_grid_cells(spark, root):
    events = table(spark, root, "events")
    names = F.array(*[F.lit(n) for n in ("click", "error", "purchase", "signup", "view")])
    grid = events.select("user_id").distinct().withColumn("event_type", F.explode(names))
    return contracts.missing_from_grid(grid, events.filter(F.col("value") > 60), ["user_id", "event_type"])


@query(
    "content_manifest",
    """
SELECT url AS path, CAST(octet_length(encode(html)) AS BIGINT) AS bytes, sha256(html) AS sha256 FROM pages""",
)
def content_manifest(spark, root):
    return contracts.content_manifest(table(spark, root, "pages"), "url", "html")


@query(
    "path_guard",
    """
WITH p AS (SELECT page_id, CASE page_id % 4 WHEN 0 THEN regexp_replace(url, '^https?://', '')
    WHEN 1 THEN regexp_replace(url, '^https?:/', '') WHEN 2 THEN '../' || url
    ELSE regexp_replace(url, '^https?://[^/]+/', 'a/../') END AS path FROM pages)
SELECT page_id, path, path <> '' AND NOT starts_with(path, '/') AND NOT regexp_matches(path, '(^|/)\\.\\.(/|$)')
  AND NOT contains(path, '\\') AS safe FROM p""",
)
def path_guard(spark, root):
    pages = table(spark, root, "pages")
    which = F.col("page_id") % 4
    path = (
        F.when(which == 0, F.regexp_replace("url", "^https?://", ""))
        .when(which == 1, F.regexp_replace("url", "^https?:/", ""))
        .when(which == 2, F.concat(F.lit("../"), "url"))
        .otherwise(F.regexp_replace("url", "^https?://[^/]+/", "a/../"))
    )
    rows = pages.select("page_id", path.alias("path"))
    return rows.withColumn("safe", text.safe_relative_path(F.col("path")))


@query(
    "slug_ids",
    """
WITH s AS (SELECT p_partkey, trim(regexp_replace(lower(p_name), '[^a-z0-9]+', '-', 'g'), '-') AS a,
  trim(regexp_replace(lower(p_brand), '[^a-z0-9]+', '-', 'g'), '-') AS b, p_size AS rep,
  p_size % 5 = 0 AS warmed, p_name || ' ' || p_brand AS full_name FROM part),
i AS (SELECT *, a || '_' || b || '_rep' || CASE WHEN rep < 10 THEN '0' ELSE '' END || rep AS base FROM s)
SELECT p_partkey, base || CASE WHEN warmed THEN '_warmed' ELSE '' END AS trial_id,
  trim(regexp_replace(lower(full_name), '[^a-z0-9]+', '-', 'g'), '-') AS wide_slug,
  CASE WHEN p_partkey % 2 = 0 THEN rep ELSE CAST(regexp_extract(base, '_rep(\\d+)$', 1) AS INTEGER) END AS rep FROM i""",
)
def slug_ids(spark, root):
    part = table(spark, root, "part")
    parts = (F.col("p_name"), F.col("p_brand"))
    base = text.trial_identifier(*parts, rep=F.col("p_size"))
    full = text.trial_identifier(*parts, rep=F.col("p_size"), warmed=F.col("p_size") % 5 == 0)
    stored = F.when(F.col("p_partkey") % 2 == 0, F.col("p_size"))
    return part.select(
        "p_partkey", full.alias("trial_id"),
        text.unicode_slug(F.concat_ws(" ", *parts)).alias("wide_slug"),
        text.repetition_number(stored, base).alias("rep"),
    )


@query(
    "row_type_gate",
    """
SELECT conv_id, count(*) AS rows, count(CASE WHEN role = 'user' THEN 1 END) AS n_user,
  count(CASE WHEN role = 'assistant' THEN 1 END) AS n_assistant,
  count(CASE WHEN role = 'user' THEN 1 END) = 1 AND count(CASE WHEN role = 'assistant' THEN 1 END) = 1 AS valid
FROM conversations GROUP BY conv_id""",
)
def row_type_gate(spark, root):
    return contracts.exactly_one(
        table(spark, root, "conversations"), ["conv_id"], "role", ["user", "assistant"]
    )


@query(
    "spec_domain_issues",
    """
SELECT o_orderkey, concat_ws('|', CASE WHEN o_orderstatus NOT IN ('O', 'F') THEN 'invalid_o_orderstatus' END,
  CASE WHEN o_orderpriority NOT IN ('1-URGENT', '2-HIGH') THEN 'invalid_o_orderpriority' END,
  CASE WHEN o_custkey NOT BETWEEN 1 AND 99 THEN 'rep_out_of_range' END) AS issues FROM orders""",
)
def spec_domain_issues(spark, root):
    issues = contracts.domain_issues(
        {"o_orderstatus": ("O", "F"), "o_orderpriority": ("1-URGENT", "2-HIGH")},
        ("o_orderpriority",), rep="o_custkey",
    )
    return table(spark, root, "orders").select("o_orderkey", F.concat_ws("|", issues).alias("issues"))


@query(
    "identity_gate",
    """
SELECT c_custkey, concat_ws('|', CASE WHEN c_mktsegment <> 'BUILDING' THEN 'c_mktsegment' END,
  CASE WHEN c_nationkey <> 7 THEN 'c_nationkey' END) AS issues FROM customer""",
)
def identity_gate(spark, root):
    rows = table(spark, root, "customer").select("c_custkey", "c_mktsegment", "c_nationkey")
    out = contracts.identity_issues(rows, {"c_mktsegment": "BUILDING", "c_nationkey": 7})
    return out.select("c_custkey", F.concat_ws("|", "identity_issues").alias("issues"))


@query(
    "structural_rules",
    """
SELECT doc_id, concat_ws('|', CASE WHEN NOT regexp_matches(lang, '^[a-z]{2}$') THEN 'lang_pattern' END,
  CASE WHEN NOT (n_chars >= 1) THEN 'n_chars_minimum' END,
  CASE WHEN lang = 'de' AND NOT (n_chars < 2000) THEN 'de_length_conditional' END,
  CASE WHEN n_chars <> length(text) THEN 'n_chars_matches' END) AS issues FROM documents""",
)
def structural_rules(spark, root):
    issues = contracts.structural_issues(
        {
            "lang_pattern": F.col("lang").rlike("^[a-z]{2}$"),
            "n_chars_minimum": F.col("n_chars") >= 1,
            "de_length_conditional": (F.col("lang") != "de") | (F.col("n_chars") < 2000),
            "n_chars_matches": F.col("n_chars") == F.length("text"),
        }
    )
    return table(spark, root, "documents").select("doc_id", F.concat_ws("|", issues).alias("issues"))


@query(
    "session_rollup",
    """
WITH o AS (SELECT o_custkey, o_orderpriority, o_orderstatus <> 'P' AS valid, o_totalprice > 480000 AS failed,
    o_totalprice < 20000 AS aborted FROM orders),
b AS (SELECT o_custkey, o_orderpriority, bool_and(valid) AS pv, count(*) AS n, bool_or(aborted) AS ab,
    bool_or(failed) AS fa FROM o GROUP BY ALL)
SELECT o_custkey, count(*) AS blocks, count(CASE WHEN pv AND n >= 2 THEN 1 END) AS valid_pairs,
  CAST(sum(n) AS BIGINT) AS artifacts,
  CASE WHEN bool_or(fa) THEN 'error' WHEN bool_or(ab) THEN 'aborted'
    WHEN count(CASE WHEN pv AND n >= 2 THEN 1 END) >= 2 THEN 'complete' ELSE 'incomplete' END AS status
FROM b GROUP BY o_custkey""",
)
def session_rollup(spark, root):
    trials = table(spark, root, "orders").select(
        "o_custkey", "o_orderpriority",
        (F.col("o_orderstatus") != "P").alias("valid"),
        (F.col("o_totalprice") > 480000).alias("failed"),
        (F.col("o_totalprice") < 20000).alias("aborted"),
        F.lit(1).cast("long").alias("artifacts"),
    )
    return contracts.session_rollup(trials, ["o_custkey"], "o_orderpriority", wanted=2)
