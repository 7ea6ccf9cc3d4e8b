"""Streams with time-outs over ``events``, their replays on the recorded table, and SQL for both."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from emberframe.catalog.bindings import instant, micros_since_origin, q, table
from emberframe.catalog.registry import query
from emberframe.operators.ordered import Series
from emberframe.operators.settle import shared_folder
from emberframe.operators.silence import silence_reports
from emberframe.sources import feed
from emberframe.sources import frames as frame_files
from emberframe.streaming import machines, run, timed, watches, windows

HOUR = 3_600_000_000
DAY = 24 * HOUR

# A stream over the whole table ends with the watermark at its newest instant, in whole milliseconds.
_ROWS = """
wm AS (SELECT max(epoch_us(ts)) // 1000 * 1000 AS wm FROM events),
e AS (
  SELECT user_id AS source, epoch_us(ts) AS t, event_id, event_type AS kind, value, CAST(regexp_extract(props, '"k": (\\d+)', 1) AS DOUBLE) AS k,
         row_number() OVER o AS rn, lag(epoch_us(ts)) OVER o AS p, lead(epoch_us(ts)) OVER o AS nx
  FROM events, wm WHERE epoch_us(ts) <= wm WINDOW o AS (PARTITION BY user_id ORDER BY epoch_us(ts), event_id)
)"""


def _lives(idle: int) -> str:
    """Rows numbered by the lives of their key's state."""
    return f"""{_ROWS},
l AS (SELECT *, sum(CASE WHEN p IS NULL OR t - p > {idle} THEN 1 ELSE 0 END) OVER (PARTITION BY source ORDER BY rn) AS life FROM e)"""


def _events(df):
    """Columns that the machines below name, from recorded events."""
    kind = F.when(F.col("event_type") == "error", "error").when(F.col("event_type") == "signup", "start").otherwise("frame")
    event = F.when(F.col("event_type") == "signup", "unlock").when(F.col("event_type").isin("error", "view"), "space").otherwise("sample")
    status = F.when(F.col("event_type") == "click", "baseline").when(F.col("event_type") == "error", "thermal_stale")
    return df.select(
        F.col("user_id").alias("source"), instant("ts").alias("ts"), "event_id", kind.alias("kind"), event.alias("event"), "value",
        F.col("value").alias("u"), F.regexp_extract("props", r'"k": (\d+)', 1).cast("double").alias("v"),
        F.col("event_id").alias("frame_id"), F.unix_micros(instant("ts")).alias("observed_us"),
        (F.col("event_type") != "signup").alias("hand_valid"), F.when(F.col("event_type") == "view", "open").otherwise("closed").alias("fist"),
        F.when(F.col("event_type").isin("view", "signup"), "active").otherwise(status).alias("status"),
        (F.col("event_type") != "error").alias("available"), F.col("value").alias("pinch"),
    )


def _streamed(spark, root, machine, columns, idle_us=None):
    rows = _events(run.open_table(spark, f"{root}/events.parquet")).select("source", "ts", "event_id", *columns)
    return run.run_available(timed.timed_stream(rows, ["source"], "ts", machine, order=("event_id",), idle_us=idle_us), spark)


def _replayed(spark, root, machine, columns, idle_us=None):
    rows = _events(table(spark, root, "events")).select("source", "ts", "event_id", *columns)
    until = timed.final_watermark(rows, "ts")
    return timed.replay_timed(rows, ["source"], "ts", machine, until, order=("event_id",), idle_us=idle_us)


SILENCE = watches.SilenceWatch(limit_us=DAY)
SILENCE_IDLE = 2 * DAY
SILENCE_SQL = f"""
WITH {_lives(SILENCE_IDLE)},
g AS (
  SELECT *, sum(CASE WHEN kind <> 'signup' THEN 1 ELSE 0 END) OVER o AS generation,
         max(CASE WHEN kind NOT IN ('signup', 'error') THEN rn END) OVER o > coalesce(max(CASE WHEN kind = 'signup' THEN rn END) OVER o, 0) AS observed
  FROM l WINDOW o AS (PARTITION BY source, life ORDER BY rn)
)
SELECT source, t AS at_us, CAST(generation AS BIGINT) AS generation, 'thermal_unavailable' AS report FROM g WHERE kind = 'error'
UNION ALL
SELECT source, t + {DAY} + 1, CAST(generation AS BIGINT), CASE WHEN observed THEN 'thermal_stale' ELSE 'thermal_unavailable' END
FROM g, wm WHERE kind <> 'error' AND t + {DAY} + 1 <= coalesce(nx, wm)"""


@query("stream_silence", SILENCE_SQL)
def stream_silence(spark, root):
    """Stalls and read errors, each once a publication, by event-time timers; an idle key's state goes."""
    return _streamed(spark, root, SILENCE, ["kind"], SILENCE_IDLE)


@query("replay_silence", SILENCE_SQL)
def replay_silence(spark, root):
    return _replayed(spark, root, SILENCE, ["kind"], SILENCE_IDLE)


@query("silence_reports", SILENCE_SQL)
def silence(spark, root):
    """The same reports without a walk: look-back columns and running counts."""
    rows = _events(table(spark, root, "events")).withColumnRenamed("observed_us", "t_us")
    until = timed.final_watermark(rows, "ts")
    series = Series(("source",), ("t_us", "event_id"))
    return silence_reports(rows, series, F.col("kind"), limit_us=DAY, idle_us=SILENCE_IDLE, until_us=until)


GAPS = watches.GapWatch(period_us=6 * HOUR, limit=8)
GAPS_IDLE = 3 * DAY
GAPS_SQL = f"""
WITH {_lives(GAPS_IDLE)},
g AS (SELECT l.*, i, t + i * {6 * HOUR} + 1 AS due FROM l, wm, range(1, 9) r(i) WHERE t + i * {6 * HOUR} + 1 <= coalesce(nx, wm)),
x AS (SELECT source, life, min(CASE WHEN i = 8 THEN due END) AS lost FROM g GROUP BY ALL),
k AS (SELECT g.* FROM g JOIN x USING (source, life) WHERE lost IS NULL OR t < lost)
SELECT source, due AS at_us, 'stream_gap' AS event, i AS gaps_in_row FROM k
UNION ALL SELECT source, due, 'stream_lost', i FROM k WHERE i = 8"""


@query("stream_gap_watch", GAPS_SQL)
def stream_gap_watch(spark, root):
    """A gap for every six hours of silence; after eight in a row the stream is lost, noticed by timers."""
    return _streamed(spark, root, GAPS, [], GAPS_IDLE)


@query("replay_gap_watch", GAPS_SQL)
def replay_gap_watch(spark, root):
    return _replayed(spark, root, GAPS, [], GAPS_IDLE)


SOAK = watches.SoakWatch(stall_us=DAY, close=20.0, reopen=40.0)
SOAK_COLUMNS = ["frame_id", "observed_us", "hand_valid", "fist", "status", "available", "pinch"]
SOAK_SQL = f"""
WITH RECURSIVE {_ROWS},
stop AS (SELECT source, min(rn) AS last, min_by(t + {DAY} + 1, rn) AS due FROM e, wm WHERE t + {DAY} + 1 <= coalesce(nx, wm) GROUP BY source),
live AS MATERIALIZED (SELECT e.*, last, due FROM e LEFT JOIN stop USING (source) WHERE last IS NULL OR rn <= last),
w AS (
  SELECT DISTINCT source, CAST(0 AS BIGINT) AS rn, 'open' AS wait, CAST(0 AS BIGINT) AS cycles, false AS latched FROM live
  UNION ALL
  SELECT w.source, r.rn,
         CASE WHEN r.kind <> 'view' THEN wait WHEN wait = 'close' THEN CASE WHEN r.value <= 20 THEN 'reopen' ELSE wait END
              WHEN r.value >= 40 THEN 'close' ELSE wait END,
         cycles + CASE WHEN r.kind = 'view' AND wait = 'reopen' AND r.value >= 40 THEN 1 ELSE 0 END,
         CASE r.kind WHEN 'error' THEN true WHEN 'click' THEN false ELSE latched END
  FROM w JOIN live r ON r.source = w.source AND r.rn = w.rn + 1
)
SELECT r.source, r.t AS at_us, CASE r.kind WHEN 'signup' THEN 'HOLD' WHEN 'view' THEN 'MOVING' ELSE 'MIDDLE' END AS state, w.cycles,
       w.latched AS fault_latched, CAST(NULL AS VARCHAR) AS terminal_reason
FROM w JOIN live r ON r.source = w.source AND r.rn = w.rn
UNION ALL
SELECT r.source, r.due, NULL, w.cycles, w.latched, 'oak_publication_stall' FROM w JOIN live r ON r.source = w.source AND r.rn = w.rn WHERE r.rn = r.last"""


@query("stream_soak_watch", SOAK_SQL)
def stream_soak_watch(spark, root):
    """Ticks of soak sessions, ended by the session's own timer when its source falls silent."""
    return _streamed(spark, root, SOAK, SOAK_COLUMNS)


@query("replay_soak_watch", SOAK_SQL)
def replay_soak_watch(spark, root):
    return _replayed(spark, root, SOAK, SOAK_COLUMNS)


QUOTA = watches.QuotaWatch(groups=3, quota=2, timeout_us=3 * DAY)
_ENDS = "CASE WHEN grp + 1 >= 3 THEN 'complete' ELSE 'rest' END"
QUOTA_SQL = f"""
WITH RECURSIVE {_ROWS},
w AS (
  SELECT DISTINCT source, CAST(0 AS BIGINT) AS rn, CAST(NULL AS BIGINT) AS late, CAST(NULL AS VARCHAR) AS late_phase, CAST(NULL AS BIGINT) AS late_grp,
         'warmup' AS phase, CAST(NULL AS BIGINT) AS grp, CAST(0 AS BIGINT) AS n, CAST([] AS DOUBLE[]) AS us, CAST([] AS DOUBLE[]) AS vs,
         CAST(NULL AS DOUBLE) AS bu, CAST(NULL AS DOUBLE) AS bv, CAST(NULL AS BIGINT) AS since, '' AS event, false AS accepted,
         CAST(0 AS BIGINT) AS valid, CAST(NULL AS DOUBLE) AS shift, false AS completed, CAST(NULL AS BIGINT) AS t
  FROM e
  UNION ALL
  SELECT source, rn, late, late_phase, late_grp,
         CASE WHEN act IN ('unlock', 'next') THEN 'prepare_just_touch' WHEN act = 'record' THEN replace(phase, 'prepare_', 'record_') WHEN NOT full_ THEN phase
              WHEN phase = 'record_just_touch' THEN 'prepare_press_hard' WHEN phase = 'record_press_hard' THEN 'prepare_return_touch' ELSE {_ENDS} END,
         CASE WHEN act = 'unlock' THEN 0 WHEN act = 'next' THEN grp + 1 WHEN full_ AND phase = 'record_return_touch' AND grp + 1 >= 3 THEN NULL ELSE grp END,
         CASE WHEN act = 'none' THEN n WHEN act = 'sample' AND NOT full_ THEN n + 1 ELSE 0 END,
         us2, vs2,
         CASE WHEN act IN ('unlock', 'next') THEN NULL WHEN full_ AND phase = 'record_just_touch' THEN list_aggregate(us2, 'median') ELSE bu END,
         CASE WHEN act IN ('unlock', 'next') THEN NULL WHEN full_ AND phase = 'record_just_touch' THEN list_aggregate(vs2, 'median') ELSE bv END,
         CASE WHEN act = 'record' THEN t WHEN act IN ('unlock', 'next') OR full_ THEN NULL ELSE since END,
         event, act = 'sample', CASE WHEN act = 'none' THEN n WHEN act = 'sample' THEN n + 1 ELSE 0 END,
         CASE WHEN act = 'sample' AND phase <> 'record_just_touch' THEN sqrt((u - bu) * (u - bu) + (v - bv) * (v - bv)) END,
         full_ AND phase = 'record_return_touch', t
  FROM (
    SELECT *, act = 'sample' AND n + 1 >= 2 AS full_,
           CASE WHEN act IN ('unlock', 'next') THEN [] WHEN act = 'sample' AND phase = 'record_just_touch' THEN list_append(us, u) ELSE us END AS us2,
           CASE WHEN act IN ('unlock', 'next') THEN [] WHEN act = 'sample' AND phase = 'record_just_touch' THEN list_append(vs, v) ELSE vs END AS vs2
    FROM (
      SELECT *, CASE WHEN event = 'unlock' AND phase = 'warmup' THEN 'unlock' WHEN event = 'space' AND starts_with(phase, 'prepare_') THEN 'record'
                     WHEN event = 'space' AND phase = 'rest' THEN 'next' WHEN event = 'sample' AND starts_with(phase, 'record_') THEN 'sample' ELSE 'none' END AS act
      FROM (
        SELECT source, rn, t, event, u, v, us, vs, bu, bv,
               CASE WHEN timed THEN since + {3 * DAY} END AS late, CASE WHEN timed THEN {_ENDS} END AS late_phase,
               CASE WHEN timed AND grp + 1 < 3 THEN grp END AS late_grp,
               CASE WHEN timed THEN {_ENDS} ELSE phase END AS phase, CASE WHEN timed AND grp + 1 >= 3 THEN NULL ELSE grp END AS grp,
               CASE WHEN timed THEN 0 ELSE n END AS n, CASE WHEN timed THEN NULL ELSE since END AS since
        FROM (
          SELECT w.source, r.rn, r.t, r.value AS u, r.k AS v, us, vs, bu, bv, phase, grp, n, since,
                 CASE WHEN r.kind = 'signup' THEN 'unlock' WHEN r.kind IN ('error', 'view') THEN 'space' ELSE 'sample' END AS event,
                 since IS NOT NULL AND r.t >= since + {3 * DAY} AS timed
          FROM w JOIN e r ON r.source = w.source AND r.rn = w.rn + 1))))
)
SELECT source, t AS at_us, event, phase, grp AS group_index, accepted AS quota_accepted, valid AS valid_samples, round(shift, 6) AS center_shift_px,
       completed AS group_completed FROM w WHERE rn > 0
UNION ALL SELECT source, late, 'timeout', late_phase, late_grp, false, 0, NULL, false FROM w WHERE late IS NOT NULL
UNION ALL
SELECT source, since + {3 * DAY}, 'timeout', {_ENDS}, CASE WHEN grp + 1 < 3 THEN grp END, false, 0, NULL, false
FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY rn DESC) AS back FROM w), wm WHERE back = 1 AND since + {3 * DAY} <= wm"""


def _quota(df):
    return df.withColumn("center_shift_px", q("center_shift_px"))


@query("stream_quota_protocol", QUOTA_SQL)
def stream_quota_protocol(spark, root):
    """Touch, press and return groups with typed state; phases time out by timer, also when nothing arrives."""
    return _quota(_streamed(spark, root, QUOTA, ["event", "u", "v"]))


@query("replay_quota_protocol", QUOTA_SQL)
def replay_quota_protocol(spark, root):
    return _quota(_replayed(spark, root, QUOTA, ["event", "u", "v"]))


ATTEMPTS = watches.AttemptWatch(
    target=30.0, tolerance=25.0, stable_us=12 * HOUR, reach_us=4 * DAY, gap_us=DAY, hold_us=2 * DAY, attempts=3
)
_ROW = "{'at': %s, 'attempt': %s, 'event': '%s', 'reason': %s}"
_PROMPT = _ROW % ("now", "attempt + 1", "action_prompt", "CAST(NULL AS VARCHAR)")
ATTEMPTS_SQL = f"""
WITH RECURSIVE {_ROWS},
w AS (
  SELECT DISTINCT source, CAST(0 AS BIGINT) AS rn, CAST(0 AS BIGINT) AS attempt, 'new' AS mode, CAST(NULL AS BIGINT) AS began, CAST(NULL AS BIGINT) AS ins,
         CAST(NULL AS BIGINT) AS outs, CAST([] AS STRUCT("at" BIGINT, attempt BIGINT, event VARCHAR, reason VARCHAR)[]) AS said FROM e
  UNION ALL
  SELECT source, rn, CASE WHEN act = 'new' OR (again AND attempt < 3) THEN attempt + 1 ELSE attempt END,
         CASE WHEN act = 'new' THEN 'approach' WHEN again THEN CASE WHEN attempt < 3 THEN 'approach' ELSE 'failed' END
              WHEN act = 'done' THEN 'complete' WHEN act = 'gated' THEN 'hold' ELSE mode END,
         CASE WHEN act IN ('new', 'gated') OR (again AND attempt < 3) THEN now WHEN again OR act = 'done' THEN NULL ELSE began END,
         CASE WHEN act IN ('new', 'wait') THEN since END, CASE WHEN act = 'held' THEN off END,
         CASE WHEN act = 'new' THEN [{_PROMPT}]
              WHEN again THEN list_concat([{_ROW % ("now", "attempt", "invalid", "CASE act WHEN 'late' THEN 'target_not_reached' ELSE 'gate_lost_during_hold' END")}],
                                          CASE WHEN attempt < 3 THEN [{_PROMPT}] ELSE [] END)
              WHEN act = 'gated' THEN [{_ROW % ("now", "attempt", "gated_hold_start", "'target_stable'")}]
              WHEN act = 'done' THEN [{_ROW % ("now", "attempt", "step_complete", "'valid_gated_hold'")}] ELSE [] END
  FROM (
    SELECT *, act IN ('late', 'lost') AS again FROM (
      SELECT *, CASE WHEN fires THEN CASE mode WHEN 'approach' THEN 'late' ELSE 'done' END WHEN mode = 'new' THEN 'new'
                     WHEN mode = 'approach' AND since < t AND t - since >= {12 * HOUR} THEN 'gated' WHEN mode = 'approach' THEN 'wait'
                     WHEN mode = 'hold' AND t - off > {DAY} THEN 'lost' WHEN mode = 'hold' THEN 'held' ELSE 'none' END AS act
      FROM (
        SELECT w.source, attempt, mode, began, r.t, due <= coalesce(r.t, wm) AS fires, CASE WHEN due <= coalesce(r.t, wm) THEN w.rn ELSE w.rn + 1 END AS rn,
               CASE WHEN due <= coalesce(r.t, wm) THEN due ELSE r.t END AS now,
               CASE WHEN abs(r.value - 30) <= 25 THEN coalesce(ins, r.t) END AS since, CASE WHEN NOT abs(r.value - 30) <= 25 THEN coalesce(outs, r.t) END AS off
        FROM (SELECT *, CASE mode WHEN 'approach' THEN began + {4 * DAY} + 1 WHEN 'hold' THEN began + {2 * DAY} + 1 END AS due FROM w) w
        LEFT JOIN e r ON r.source = w.source AND r.rn = w.rn + 1, wm
        WHERE r.t IS NOT NULL OR due <= wm)))
)
SELECT source, s."at" AS at_us, s.attempt AS attempt, s.event AS event, s.reason AS reason FROM (SELECT source, unnest(said) AS s FROM w)"""


@query("stream_attempt_loop", ATTEMPTS_SQL)
def stream_attempt_loop(spark, root):
    """Approach, hold and retry of one step per source; attempts that run out of time end by timer."""
    return _streamed(spark, root, ATTEMPTS, ["value"])


@query("replay_attempt_loop", ATTEMPTS_SQL)
def replay_attempt_loop(spark, root):
    return _replayed(spark, root, ATTEMPTS, ["value"])


PAIRS = watches.PairWatch(max_age_us=20 * HOUR, max_skew_us=12 * HOUR)
PAIRS_SQL = f"""
WITH e AS (
  SELECT user_id AS source, epoch_us(ts) AS t, event_id AS id, event_type AS kind, value, CAST(regexp_extract(props, '"k": (\\d+)', 1) AS BIGINT) AS k FROM events
),
c AS (SELECT * FROM e WHERE kind NOT IN ('error', 'purchase')), h AS (SELECT * FROM e WHERE kind IN ('error', 'purchase')),
cut AS (SELECT least((SELECT max(t) FROM c), (SELECT max(t) FROM h)) // 1000 * 1000 - {DAY} AS cut),
m AS (
  SELECT c.source, c.id, any_value(c.t) AS t, any_value(c.k) AS k, any_value(c.value) AS value,
         arg_max(h.t, (h.t, h.id)) AS ht, arg_max(h.id, (h.t, h.id)) AS hid, arg_max(h.k, (h.t, h.id)) AS hk, arg_max(h.kind, (h.t, h.id)) AS hkind,
         arg_max(h.value, (h.t, h.id)) AS hv
  FROM c LEFT JOIN h ON c.source = h.source AND h.t <= c.t AND h.t >= c.t - {DAY} GROUP BY c.source, c.id
),
j AS (
  SELECT m.*, m.t + (m.k % 5) * {HOUR} - {HOUR} AS now,
         max(id) OVER w AS pc, max(k) OVER w AS pd, max(hid) OVER w AS pf, max(hk) OVER w AS pp
  FROM m, cut WHERE t + 1 <= cut WINDOW w AS (PARTITION BY source ORDER BY t, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
)
SELECT source, t + 1 AS at_us, id AS color_frame, hid AS frame_counter, concat_ws(',',
  CASE WHEN ht IS NULL THEN 'host_read_completion_time_invalid' END,
  CASE WHEN ht IS NOT NULL AND NOT now - t BETWEEN 0 AND {20 * HOUR} THEN 'd435_host_read_completion_stale' END,
  CASE WHEN ht IS NOT NULL AND NOT now - ht BETWEEN 0 AND {20 * HOUR} THEN 'lepton_host_read_completion_stale' END,
  CASE WHEN abs(t - ht) > {12 * HOUR} THEN 'host_read_completion_skew_exceeded' END,
  CASE WHEN k % 2 = 1 THEN 'd435_timestamp_domain_mismatch' END,
  CASE WHEN id <= pc THEN 'd435_color_frame_non_increasing' END, CASE WHEN k <= pd THEN 'd435_depth_frame_non_increasing' END,
  CASE WHEN hid IS NULL THEN 'lepton_telemetry_missing' END,
  CASE WHEN hv < 5 THEN 'lepton_ffc_desired' END, CASE WHEN hkind = 'error' AND hv < 10 THEN 'lepton_ffc_in_progress' END,
  CASE WHEN hv < 15 THEN 'lepton_ffc_not_idle' END, CASE WHEN hv < 20 OR hv > 200 THEN 'lepton_tlinear_invalid' END,
  CASE WHEN hid <= pf THEN 'lepton_frame_counter_non_increasing' END, CASE WHEN hk <= pp THEN 'lepton_packet_timestamp_non_increasing' END) AS reasons
FROM j"""


@query("stream_pair_freshness", PAIRS_SQL)
def stream_pair_freshness(spark, root):
    """Camera and thermal streams joined within a day, each pair judged against all counters before it."""
    k = F.regexp_extract("props", r'"k": (\d+)', 1).cast("long")
    events = run.open_table(spark, f"{root}/events.parquet").withColumn("k", k).withColumn("ts", instant("ts"))
    thermal_kind = F.col("event_type").isin("error", "purchase")
    camera = events.where(~thermal_kind).select(
        F.col("user_id").alias("source"), "ts", F.col("event_id").alias("color_frame"), F.col("k").alias("depth_frame"), F.lit("a").alias("color_domain"),
        F.when(F.col("k") % 2 == 1, "b").otherwise("a").alias("depth_domain"), (F.unix_micros("ts") + (F.col("k") % 5) * HOUR - HOUR).alias("now_us"),
    )
    value = F.col("value")
    thermal = events.where(thermal_kind).select(
        F.col("user_id").alias("source"), F.col("ts").alias("thermal_ts"), F.col("event_id").alias("frame_counter"), F.col("k").alias("packet_ms"),
        (value < 5).alias("ffc_desired"), ((F.col("event_type") == "error") & (value < 10)).alias("ffc_in_progress"),
        F.when(value < 15, "imminent").otherwise("complete").alias("ffc_state"), (value >= 20).alias("tlinear_enabled"),
        F.when(value > 200, 0.1).otherwise(0.01).alias("tlinear_resolution_k"),
    )
    judged = windows.judged_pairs(camera, thermal, ["source"], "ts", "thermal_ts", PAIRS, reach="1 day")
    return run.run_available(judged, spark).withColumn("reasons", F.array_join("reasons", ","))


def _timeline(spark, root):
    rows = run.open_table(spark, f"{root}/events.parquet")
    return rows.select(F.col("user_id").alias("source"), F.col("event_type").alias("phase"), "event_id", instant("ts").alias("ts"), "value")


def _binned(df):
    us = lambda c: F.unix_micros(f"window.{c}").alias(f"{c}_us")
    return df.select(us("start"), us("end"), *[c for c in df.columns if c != "window"])


_SUMS = "count(*) AS samples, round(sum(value), 6) AS total, max(value) AS highest"


def _sums():
    return [F.count(F.lit(1)).alias("samples"), F.sum("value").alias("total"), F.max("value").alias("highest")]


def _bins_sql(group: str, start: str, width: int) -> str:
    """Bins that the final watermark has passed."""
    return f"""
WITH {_ROWS}, b AS (SELECT *, {start} AS s FROM e)
SELECT {group}, s AS start_us, s + {width} AS end_us, {_SUMS} FROM b, wm WHERE s + {width} <= wm GROUP BY {group}, s"""


@query("stream_tumbling", _bins_sql("phase", f"t // {DAY} * {DAY}", DAY).replace("phase,", "kind AS phase,", 1).replace("BY phase", "BY kind"))
def stream_tumbling(spark, root):
    """Daily bins of each phase, put out once the watermark has passed their end."""
    bins = windows.tumbling(_timeline(spark, root), ["phase"], "ts", "1 day", "0 seconds", _sums())
    return _binned(run.run_available(bins, spark)).withColumn("total", q("total"))


@query(
    "stream_sliding",
    f"""
WITH {_ROWS}, b AS (SELECT *, (t // {DAY} - i) * {DAY} AS s FROM e, range(3) r(i))
SELECT kind AS phase, s AS start_us, s + {3 * DAY} AS end_us, {_SUMS} FROM b, wm WHERE s + {3 * DAY} <= wm GROUP BY kind, s""",
)
def stream_sliding(spark, root):
    """Three-day windows that move by a day."""
    bins = windows.sliding(_timeline(spark, root), ["phase"], "ts", "3 days", "1 day", "0 seconds", _sums())
    return _binned(run.run_available(bins, spark)).withColumn("total", q("total"))


@query(
    "stream_sessions",
    f"""
WITH wm AS (SELECT max(epoch_us(ts)) // 1000 * 1000 AS wm FROM events),
e AS (SELECT user_id AS source, epoch_us(ts) AS t, event_id, value, lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY epoch_us(ts), event_id) AS p FROM events),
s AS (SELECT *, sum(CASE WHEN p IS NULL OR t - p > {12 * HOUR} THEN 1 ELSE 0 END) OVER (PARTITION BY source ORDER BY t, event_id) AS n FROM e)
SELECT source, min(t) AS start_us, max(t) + {12 * HOUR} AS end_us, {_SUMS} FROM s, wm GROUP BY source, n, wm HAVING max(t) + {12 * HOUR} <= wm""",
)
def stream_sessions(spark, root):
    """Clusters of a source's events separated by twelve quiet hours."""
    bins = windows.sessions(_timeline(spark, root), ["source"], "ts", "12 hours", "0 seconds", _sums())
    bins = bins.withColumnRenamed("session_window", "window")
    return _binned(run.run_available(bins, spark)).withColumn("total", q("total"))


@query(
    "stream_latest",
    "SELECT user_id AS source, epoch_us(max(ts)) AS at_us, arg_max(event_type, (ts, event_id)) AS phase, arg_max(value, (ts, event_id)) AS value FROM events GROUP BY user_id",
)
def stream_latest(spark, root):
    """The newest sample of each source, in update mode; older arrivals change nothing."""
    updates = windows.latest(_timeline(spark, root), ["source"], "ts", ["phase", "value"])
    return windows.keep_latest(updates, spark, ["source"], "ts").select("source", F.unix_micros("ts").alias("at_us"), "phase", "value")


@query(
    "stream_progress",
    f"""
WITH {_ROWS}, b AS (SELECT t // {DAY} * {DAY} AS s, kind, count(*) AS ticks FROM e, wm WHERE t // {DAY} * {DAY} + {DAY} <= wm GROUP BY ALL),
a AS (SELECT s, sum(ticks) AS interval_ticks FROM b GROUP BY s)
SELECT s AS start_us, kind AS phase, ticks, CAST(sum(ticks) OVER (PARTITION BY kind ORDER BY s) AS BIGINT) AS status_ticks, CAST(interval_ticks AS BIGINT) AS interval_ticks,
       CAST((SELECT sum(interval_ticks) FROM a x WHERE x.s <= b.s) AS BIGINT) AS ticks_so_far
FROM b JOIN a USING (s)""",
)
def stream_progress(spark, root):
    """Ticks per day and phase as a stream, then the running report over those few rows."""
    counted = run.run_available(windows.progress(_timeline(spark, root), "ts", "0 seconds", "phase", "1 day"), spark)
    report = windows.progress_report(counted, "phase")
    return report.select(F.unix_micros("start").alias("start_us"), "phase", "ticks", "status_ticks", "interval_ticks", "ticks_so_far")


_ARRIVED = f"""
a AS (SELECT user_id AS source, event_id, epoch_us(ts) AS t_us, epoch_us(ts) + CAST(regexp_extract(props, '"k": (\\d+)', 1) AS BIGINT) * {HOUR} AS arrived_us FROM events),
n AS (SELECT *, max(t_us) OVER (PARTITION BY source ORDER BY arrived_us, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS newest FROM a),
j AS (SELECT source, event_id, t_us, CASE WHEN newest IS NULL OR t_us > newest THEN 'fresh' WHEN t_us = newest THEN 'pending'
                                          WHEN newest - t_us > {DAY} THEN 'late' ELSE 'stale' END AS arrival FROM n)"""


def _arrived(spark, root):
    """Events that arrive up to 99 hours after their time."""
    rows = run.open_table(spark, f"{root}/events.parquet")
    late = F.regexp_extract("props", r'"k": (\d+)', 1).cast("long") * HOUR
    t = F.unix_micros(instant("ts"))
    timeline = rows.select(F.col("user_id").alias("source"), "event_id", t.alias("t_us"), (t + late).alias("arrived_us"))
    return windows.arrivals(timeline, ["source"], "t_us", ["arrived_us", "event_id"], DAY)


@query("stream_arrivals", f"WITH {_ARRIVED} SELECT * FROM j WHERE arrival <> 'late'")
def stream_arrivals(spark, root):
    """Fresh, pending and stale rows of a stream whose rows come out of order."""
    return windows.with_side_table(_arrived(spark, root), spark)[0].drop("arrived_us")


@query("stream_late_rows", f"WITH {_ARRIVED} SELECT * FROM j WHERE arrival = 'late'")
def stream_late_rows(spark, root):
    """The side table: rows over a day older than the newest their source had shown."""
    return windows.with_side_table(_arrived(spark, root), spark)[1].drop("arrived_us")


def _datagrams(rows):
    """A datagram for each event: its segment and packet mode follow from its place, its id stands in packet 0.

    Packets are numbered from 0; the segment is in the upper bits of packet 20.
    """
    head = lambda i, segment=0: bytes([segment << 4 | i >> 8, i & 255, 0, 0])
    filler = bytes(frame_files.PACKET_BYTES - frame_files.HEADER_BYTES)
    run_of = lambda a, b: b"".join(head(i) + filler for i in range(a, b))
    marked = F.concat(F.lit(head(0)), F.to_binary(F.lpad(F.hex("event_id"), 16, "0"), F.lit("hex")), F.lit(filler[8:] + run_of(1, 20)))
    segment = F.coalesce(*[F.when(F.col("segment") == k, F.lit(head(20, k) + filler)) for k in (1, 2, 3, 4)])
    tail = F.when(F.col("packets") == 60, F.lit(run_of(21, 60))).otherwise(F.lit(run_of(21, 61)))
    return rows.select(F.col("source").cast("string").alias("stream"), "ts", "seq", F.concat(marked, segment, tail).alias("payload"))


@query(
    "stream_frame_feed",
    """
WITH e AS (SELECT user_id, event_id, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS seq FROM events WHERE event_type IN ('view', 'click')),
wm AS (SELECT max(epoch_us(ts)) // 1000 * 1000 AS wm FROM e),
d AS (SELECT *, [1, 2, 3, 4, 1, 2, 3, 4, 4, 1, 2, 4][seq % 12 + 1] AS segment, CASE WHEN seq % 7 = 6 THEN 61 ELSE 60 END AS packets FROM e),
l AS (SELECT *, lag(segment, 1) OVER w AS s1, lag(segment, 2) OVER w AS s2, lag(segment, 3) OVER w AS s3, lag(packets, 1) OVER w AS p1, lag(packets, 2) OVER w AS p2,
        lag(packets, 3) OVER w AS p3, lag(event_id, 1) OVER w AS e1, lag(event_id, 2) OVER w AS e2, lag(event_id, 3) OVER w AS e3
      FROM d WINDOW w AS (PARTITION BY user_id ORDER BY seq))
SELECT CAST(user_id AS VARCHAR) AS stream, epoch_us(ts) AS at_us, seq - 3 AS first_seq, seq AS last_seq, CAST(packets AS BIGINT) AS packets,
       concat_ws(',', e3, e2, e1, event_id) AS ids, CAST(4 * 164 * packets AS INTEGER) AS bytes
FROM l, wm WHERE segment = 4 AND s1 = 3 AND s2 = 2 AND s3 = 1 AND p1 = packets AND p2 = packets AND p3 = packets AND epoch_us(ts) <= wm""",
)
def stream_frame_feed(spark, root):
    """Datagrams derived from events, written as capture files, read as a feed and put together to frames."""
    feed.register(spark)
    place = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")).cast("long") - 1
    events = table(spark, root, "events").where(F.col("event_type").isin("view", "click")).withColumn("seq", place)
    at = (F.col("seq") % 12).cast("int")
    pattern = F.array(*[F.lit(x) for x in (1, 2, 3, 4, 1, 2, 3, 4, 4, 1, 2, 4)])
    rows = events.select(
        F.col("user_id").alias("source"), "event_id", instant("ts").alias("ts"), "seq", F.get(pattern, at).alias("segment"),
        F.when(F.col("seq") % 7 == 6, 61).otherwise(60).alias("packets"),
    )
    folder = shared_folder(spark)
    _datagrams(rows).write.format(feed.FORMAT).mode("append").save(folder)
    read = frame_files.datagrams(spark.readStream.format(feed.FORMAT).load(folder))
    frames = run.run_available(timed.timed_stream(read, ["stream"], "ts", watches.FrameAssembly(), order=("seq",)), spark)
    size = F.col("packets") * frame_files.PACKET_BYTES
    event_of = lambda k: F.conv(F.hex(F.substring("payload", (F.lit(k) * size + frame_files.HEADER_BYTES + 1).cast("int"), F.lit(8))), 16, 10)
    return frames.select(
        "stream", "at_us", "first_seq", "last_seq", "packets", F.concat_ws(",", *[event_of(k) for k in range(4)]).alias("ids"),
        F.octet_length("payload").alias("bytes"),
    )


def _pressure_sql(blob: bool) -> str:
    """The estimator's checks in their order, stepped row by row; what each leaves of the state follows."""
    late = lambda a, b, limit: f"({a} - {b} > {limit} + greatest(abs({a}), abs({b}), {limit}) * 2.220446049250313e-16)"
    pressure = "greatest(bd, 0) / 24" if blob else "(greatest(c0 - b0, 0) + greatest(c1 - b1, 0)) / 2 / 24"
    return f"""
WITH RECURSIVE {_ROWS},
f AS MATERIALIZED (
  SELECT source, rn, t, (t - 1704067200000000) / 1e12 AS now, CAST(k AS BIGINT) AS k, value FROM e
), r AS MATERIALIZED (
  SELECT *, now - (k % 11) * 0.021 AS oak, CASE WHEN k = 17 THEN NULL ELSE floor(now / 0.05) * 0.05 - (k % 3) * 0.05 END AS thermal, k <> 13 AS readable, k <> 29 AS shape_ok,
         CASE WHEN k = 31 THEN NULL ELSE value % 20 END AS frame_range, 'c' || CAST(floor(value / 40) AS BIGINT) AS content, CASE WHEN k % 23 <> 5 THEN k // 50 END AS roi,
         1 - (k % 9) / 12 AS quality, value AS c0, value / 2 AS c1, value - 20 AS bd, (k % 8) / 100 AS pinch, k % 41 <> 7 AS enabled FROM f
), w AS (
  SELECT DISTINCT source, CAST(0 AS BIGINT) AS rn, CAST(NULL AS BIGINT) AS t, CAST(NULL AS DOUBLE) AS th, CAST(NULL AS VARCHAR) AS seen, CAST(NULL AS BIGINT) AS rep, CAST(NULL AS DOUBLE) AS b0,
         CAST(NULL AS DOUBLE) AS b1, CAST(NULL AS BIGINT) AS br, false AS act, '' AS status, CAST(0 AS DOUBLE) AS pressure, false AS available, CAST(0 AS DOUBLE) AS q FROM r
  UNION ALL
  SELECT source, rn, t,
         CASE WHEN step <= 9 THEN th ELSE thermal END, CASE WHEN step = 5 THEN seen WHEN step < 10 OR step = 13 THEN NULL ELSE content END, CASE WHEN step = 5 THEN rep WHEN step < 10 OR step = 13 THEN NULL ELSE reps END,
         CASE WHEN step = 5 THEN b0 WHEN step < 14 THEN NULL WHEN step = 14 THEN {"b0" if blob else "CASE WHEN fits THEN 0.08 * c0 + 0.92 * b0 ELSE c0 END"} ELSE b0 END,
         CASE WHEN step = 5 THEN b1 WHEN step < 14 THEN NULL WHEN step = 14 THEN {"b1" if blob else "CASE WHEN fits THEN 0.08 * c1 + 0.92 * b1 ELSE c1 END"} ELSE b1 END,
         CASE WHEN step = 5 THEN br WHEN step < 14 THEN NULL WHEN step = 14 THEN {"br" if blob else "roi"} ELSE br END,
         CASE WHEN step = 5 THEN act WHEN step < 14 THEN false ELSE step > 14 END,
         ['thermal_unavailable', 'oak_stale', 'thermal_stale', 'thermal_stale', 'thermal_pending', 'sensor_skew', 'thermal_shape_mismatch', 'thermal_unavailable', 'thermal_low_contrast', 'thermal_stale',
          'projection_out_of_fov', 'low_quality', 'disabled', 'baseline', 'active_no_baseline', 'active'][step],
         CASE WHEN step = 16 THEN least(greatest({pressure}, 0), 1) ELSE 0 END, step IN (5, 13, 14, 16), CASE WHEN step >= 12 THEN quality ELSE 0 END
  FROM (
    SELECT *, CASE WHEN NOT readable THEN 1 WHEN now - oak < 0 OR {late("now", "oak", 0.2)} THEN 2 WHEN thermal IS NULL OR now - thermal < 0 OR {late("now", "thermal", 0.2)} THEN 3 WHEN thermal < th THEN 4
      WHEN thermal = th THEN 5 WHEN {late("greatest(oak, thermal)", "least(oak, thermal)", 0.15)} THEN 6 WHEN NOT shape_ok THEN 7 WHEN frame_range IS NULL THEN 8 WHEN frame_range < 2 THEN 9
      WHEN reps > 2 THEN 10 WHEN roi IS NULL THEN 11 WHEN quality < 0.5 THEN 12 WHEN NOT enabled THEN 13 WHEN NOT active THEN 14 WHEN {"false" if blob else "NOT fits"} THEN 15 ELSE 16 END AS step
    FROM (
      SELECT r.*, w.th, w.seen, w.rep, w.b0, w.b1, w.br, w.act, CASE WHEN w.seen = r.content THEN w.rep + 1 ELSE 0 END AS reps, coalesce(w.br = r.roi, false) AS fits,
             CASE WHEN NOT w.act AND r.pinch <= 0.045 THEN true WHEN w.act AND r.pinch >= 0.055 THEN false ELSE w.act END AS active
      FROM w JOIN r ON r.source = w.source AND r.rn = w.rn + 1))
)
SELECT source, t AS at_us, status, round(pressure, 6) AS pressure, act AND status LIKE 'active%' AS active, available, round(q, 6) AS reading_quality FROM w WHERE rn > 0"""


def _readings(df):
    """Sensor readings made of events: hours of the timeline count as milliseconds, so ages and repeats occur."""
    k = F.regexp_extract("props", r'"k": (\d+)', 1).cast("long")
    now = micros_since_origin("ts") / F.lit(1e12)
    value = F.col("value")
    rows = df.select(F.col("user_id").alias("source"), instant("ts").alias("ts"), "event_id", k.alias("k"), value.alias("value"), now.alias("now_s"))
    k, now = F.col("k"), F.col("now_s")
    return rows.select(
        "source", "ts", "event_id", "now_s", (now - (k % 11) * 0.021).alias("oak_s"), F.when(k != 17, F.floor(now / 0.05) * 0.05 - (k % 3) * 0.05).alias("thermal_s"),
        (k != 13).alias("readable"), (k != 29).alias("shape_ok"), F.when(k != 31, value % 20).alias("frame_range"), F.concat(F.lit("c"), F.floor(value / 40).cast("string")).alias("content"),
        F.when(k % 23 != 5, F.array(F.floor(k / 50))).alias("roi"), F.lit("projection_out_of_fov").alias("roi_mode"), (1 - (k % 9) / 12).alias("quality"), F.array(value, value / 2).alias("crop"),
        (value - 20).alias("blob_delta"), ((k % 8) / 100).alias("pinch"), (k % 41 != 7).alias("enabled"),
    )


def _pressure(out):
    return out.withColumns({c: q(c) for c in ("pressure", "reading_quality")})


PRESSURE = {blob: watches.PressureWatch(machines.PressureEstimator(max_repeats=2, blob=blob)) for blob in (False, True)}


@query("stream_pressure", _pressure_sql(False))
def stream_pressure(spark, root):
    """The pressure estimator with its baseline, as a stream in event-time order with typed state."""
    rows = _readings(run.open_table(spark, f"{root}/events.parquet"))
    return _pressure(run.run_available(timed.timed_stream(rows, ["source"], "ts", PRESSURE[False], order=("event_id",)), spark))


@query("replay_pressure", _pressure_sql(False))
def replay_pressure(spark, root):
    rows = _readings(table(spark, root, "events"))
    return _pressure(timed.replay_timed(rows, ["source"], "ts", PRESSURE[False], timed.final_watermark(rows, "ts"), order=("event_id",)))


@query("replay_blob_pressure", _pressure_sql(True))
def replay_blob_pressure(spark, root):
    """Pressure from the blob's rise alone, without a baseline."""
    rows = _readings(table(spark, root, "events"))
    return _pressure(timed.replay_timed(rows, ["source"], "ts", PRESSURE[True], timed.final_watermark(rows, "ts"), order=("event_id",)))
