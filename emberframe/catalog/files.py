"""Binary decoding, segments and JSON-safe rows over the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from emberframe.catalog.bindings import EVENT_SERIES, q, table, telemetry, with_telemetry
from emberframe.catalog.registry import query
from emberframe.operators import joins
from emberframe.operators.ordered import row_index, scan
from emberframe.sinks import writers
from emberframe.sources import frames as frame_files
from emberframe.sources import trials
from emberframe.streaming import machines, run


@query(
    "raw_u16_decode",
    """
WITH h AS (SELECT doc_id, sha256(text) AS h FROM documents),
w AS (SELECT doc_id, i, CAST('0x' || substr(h, i * 4 + 3, 2) AS INTEGER) * 256 + CAST('0x' || substr(h, i * 4 + 1, 2) AS INTEGER) AS v FROM h, (SELECT unnest(range(16)) AS i))
SELECT doc_id, string_agg(CAST(v AS VARCHAR), ',' ORDER BY i) AS counts FROM w GROUP BY doc_id""",
)
def raw_u16_decode(spark, root):
    docs = table(spark, root, "documents").select("doc_id", F.unhex(F.sha2("text", 256)).alias("payload"))
    values = frame_files.u16_little("payload")
    return docs.select("doc_id", F.array_join(F.transform(values, lambda v: v.cast("string")), ",").alias("counts"))


@query(
    "palette_file",
    """
WITH h AS (SELECT doc_id, sha256(text) || substr(sha256(lang), 1, 2) AS h FROM documents)
SELECT CAST(doc_id AS VARCHAR) AS path, CAST(i AS INTEGER) AS idx, CAST('0x' || substr(h, i * 6 + 1, 2) AS INTEGER) AS r, CAST('0x' || substr(h, i * 6 + 3, 2) AS INTEGER) AS g,
  CAST('0x' || substr(h, i * 6 + 5, 2) AS INTEGER) AS b FROM h, (SELECT unnest(range(11)) AS i)""",
)
def palette_file(spark, root):
    digits = F.concat(F.sha2("text", 256), F.substring(F.sha2("lang", 256), 1, 2))
    files = table(spark, root, "documents").select(
        F.col("doc_id").cast("string").alias("path"), F.unhex(digits).alias("content")
    )
    return frame_files.palette_entries(files, exact=11)


_SEGMENTS = with_telemetry(
    """
, s AS (SELECT trial, t_us, frame, counter % 4 + 1 AS seg, counter // 4 % 2 AS pk FROM ev),
l AS (SELECT *, lag(seg, 1) OVER w AS a, lag(seg, 2) OVER w AS b, lag(seg, 3) OVER w AS c, lag(pk, 1) OVER w AS d, lag(pk, 2) OVER w AS e, lag(pk, 3) OVER w AS f,
  lag(frame, 1) OVER w AS fs FROM s WINDOW w AS (PARTITION BY trial ORDER BY t_us, frame))"""
)


@query(
    "segment_frames",
    with_telemetry(
        """
, n AS (SELECT *, row_number() OVER (PARTITION BY trial ORDER BY t_us, frame) - 1 AS i FROM ev),
s AS (SELECT *, CASE WHEN counter > 95 THEN NULL ELSE [1, 2, 3, 4, 1, 2, 3, 4, 2, 1, 3, 4][i % 12 + 1] END AS seg, CASE WHEN i % 7 = 6 THEN 61 ELSE 60 END AS pk FROM n),
l AS (SELECT *, lag(seg, 1) OVER w AS a, lag(seg, 2) OVER w AS b, lag(seg, 3) OVER w AS c, lag(pk, 1) OVER w AS d, lag(pk, 2) OVER w AS e, lag(pk, 3) OVER w AS f,
  concat_ws(',', lag(frame, 3) OVER w, lag(frame, 2) OVER w, lag(frame, 1) OVER w, frame) || ',' AS payload FROM s WINDOW w AS (PARTITION BY trial ORDER BY t_us, frame))
SELECT trial, t_us, frame, pk AS packets, payload FROM l WHERE seg = 4 AND a = 3 AND b = 2 AND c = 1 AND d = pk AND e = pk AND f = pk"""
    ),
)
def segment_frames(spark, root):
    """Whole frames of four segments, with the payload of all four; some datagrams are malformed."""
    pattern = F.array(*[F.lit(x) for x in (1, 2, 3, 4, 1, 2, 3, 4, 2, 1, 3, 4)])
    placed = scan(telemetry(spark, root), EVENT_SERIES, {"_i": row_index()}).withColumn("_i", F.col("_i") - 1)
    rows = placed.select(
        "trial", "t_us", "frame", F.when(F.col("counter") <= 95, F.get(pattern, (F.col("_i") % 12).cast("int"))).alias("segment"),
        F.when(F.col("_i") % 7 == 6, 61).otherwise(60).alias("packets"), F.encode(F.concat(F.col("frame").cast("string"), F.lit(",")), "utf-8").alias("payload"),
    )
    return frame_files.assembled_frames(rows, EVENT_SERIES).withColumn("payload", F.decode("payload", "utf-8"))


@query(
    "segment_assembly",
    _SEGMENTS + "\nSELECT count(*) AS frames FROM l WHERE seg = 4 AND a = 3 AND b = 2 AND c = 1 AND d = pk AND e = pk AND f = pk",
)
def segment_assembly(spark, root):
    rows = telemetry(spark, root).select(
        "trial", "t_us", "frame", (F.col("counter") % 4 + 1).alias("segment"),
        (F.floor(F.col("counter") / 4) % 2).alias("packets"), F.lit(b"\0").alias("payload"),
    )
    return frame_files.assembled_frames(rows, EVENT_SERIES).agg(F.count(F.lit(1)).alias("frames"))


@query("replay_segments")
def replay_segments(spark, root):
    rows = telemetry(spark, root).select(
        "trial", "t_us", F.col("frame").alias("seq"), (F.col("counter") % 4 + 1).alias("segment"),
        (F.floor(F.col("counter") / 4) % 2).alias("packets"),
    )
    return run.replay(rows, ["trial"], ["t_us", "seq"], machines.SegmentAssembler()).select("trial", "seq", "frame_start")


@query(
    "json_safe_rows",
    """
SELECT l_orderkey, l_linenumber, CASE WHEN l_discount > 0 THEN round(l_tax / l_discount, 6) END AS ratio,
  CASE WHEN l_tax > 0 THEN '[' || CAST(l_quantity AS VARCHAR) || ',1.5]' ELSE '[' || CAST(l_quantity AS VARCHAR) || ',null]' END AS pair FROM lineitem""",
)
def json_safe_rows(spark, root):
    nan, inf = F.lit(float("nan")), F.lit(float("inf"))
    rows = table(spark, root, "lineitem").select(
        "l_orderkey", "l_linenumber",
        F.when(F.col("l_discount") > 0, q(F.try_divide("l_tax", "l_discount"))).otherwise(nan).alias("ratio"),
        F.array("l_quantity", F.when(F.col("l_tax") > 0, 1.5).otherwise(inf)).alias("pair"),
    )
    out = writers.flattened(writers.json_safe(rows))
    return out.select("l_orderkey", "l_linenumber", "ratio", "pair")


@query(
    "merged_columns",
    """
SELECT c_custkey AS key, c_name AS name, c_acctbal AS balance, CAST(NULL AS VARCHAR) AS brand FROM customer
UNION ALL SELECT p_partkey, p_name, NULL, p_brand FROM part""",
)
def merged_columns(spark, root):
    people = table(spark, root, "customer").select(F.col("c_custkey").alias("key"), F.col("c_name").alias("name"), F.col("c_acctbal").alias("balance"))
    parts = table(spark, root, "part").select(F.col("p_partkey").alias("key"), F.col("p_name").alias("name"), F.col("p_brand").alias("brand"))
    return writers.flattened(writers.merged_rows(people, parts))


@query(
    "artifact_lookup",
    """
WITH r AS (SELECT page_id, CASE WHEN page_id % 5 = 0 THEN '../' || url WHEN page_id % 7 = 0 THEN NULL WHEN page_id % 11 = 0 THEN 'gone' ELSE regexp_replace(url, '^https?://', '') END AS path FROM pages),
f AS (SELECT page_id, regexp_replace(url, '^https?://', '') AS path, octet_length(encode(html)) AS bytes FROM pages)
SELECT r.page_id, CASE WHEN r.path IS NULL THEN 'artifact_missing' WHEN starts_with(r.path, '../') THEN 'artifact_outside_session' WHEN f.bytes IS NULL THEN 'artifact_not_found' END AS artifact_issue,
  CAST(f.bytes AS INTEGER) AS bytes FROM r LEFT JOIN f ON f.page_id = r.page_id AND f.path = r.path""",
)
def artifact_lookup(spark, root):
    pages = table(spark, root, "pages")
    plain = F.regexp_replace("url", "^https?://", "")
    number = F.col("page_id")
    stored = (
        F.when(number % 5 == 0, F.concat(F.lit("../"), "url")).when(number % 7 == 0, F.lit(None))
        .when(number % 11 == 0, "gone").otherwise(plain)
    )
    files = pages.select("page_id", plain.alias("path"), F.col("html").cast("binary").alias("content"))
    out = trials.artifacts(pages.select("page_id", stored.alias("stored")), files, "stored", ["page_id"])
    return out.select("page_id", "artifact_issue", F.octet_length("content").alias("bytes"))


@query(
    "routing_manifest",
    """
WITH f AS (SELECT url, regexp_extract(url, '([^/?#]*)[^/]*$', 1) AS name FROM pages)
SELECT name, count(*) AS files, CASE regexp_extract(lower(name), '(\\.[^./]*)$', 1) WHEN '.csv' THEN 'csv' WHEN '.png' THEN 'figures' WHEN '.md' THEN 'reports' WHEN '.txt' THEN 'reports'
  WHEN '.json' THEN 'metadata' ELSE 'other' END AS kind FROM f GROUP BY name""",
)
def routing_manifest(spark, root):
    names = table(spark, root, "pages").select(F.regexp_extract("url", r"([^/?#]*)[^/]*$", 1).alias("name"))
    return names.groupBy("name").agg(F.count(F.lit(1)).alias("files")).withColumn(
        "kind", joins.artifact_kind(F.col("name"))
    )


@query(
    "payload_decode",
    """
WITH h AS (SELECT page_id, sha256(html) AS h FROM pages WHERE html IS NOT NULL),
b AS (SELECT page_id, list_transform(range(32), lambda i: CAST('0x' || substr(h, i * 2 + 1, 2) AS INTEGER)) AS b FROM h),
s AS (SELECT page_id, y, x, b[(2 * w) % 32 + 1] + 256 * b[(2 * w + 1) % 32 + 1] AS v
      FROM b, (SELECT y, x, y * 164 + CASE WHEN x < 80 THEN x + 2 ELSE x + 4 END AS w FROM range(120) r(y), range(160) c(x))),
d AS (SELECT page_id, y, x, 256 * b[o % 32 + 1] + b[(o + 1) % 32 + 1] AS v FROM b, (SELECT y, x, (y // 2) * 164 + 4 + (x // 2) * 2 AS o FROM range(120) r(y), range(160) c(x))),
a AS (SELECT 'split' AS layout, * FROM s UNION ALL SELECT 'doubled', * FROM d)
SELECT layout, page_id, count(*) AS pixels, CAST(sum(v) AS BIGINT) AS total, CAST(sum(v * (y * 160 + x)) AS BIGINT) AS weighted FROM a GROUP BY ALL""",
)
def payload_decode(spark, root):
    """Device payloads made of page digests, decoded by both layouts; the weighted sum depends on every pixel's place."""
    pages = table(spark, root, "pages").where("html is not null").select("page_id", F.sha2("html", 256).alias("h"))
    layouts = {"split": (1230, frame_files.decode_split_payload), "doubled": (308, frame_files.decode_doubled_payload)}

    def decoded(name):
        times, decode = layouts[name]
        frames = pages.select(F.lit(name).alias("layout"), "page_id", decode(F.unhex(F.repeat("h", F.lit(times)))).alias("pixels"))
        zero = F.lit(0).cast("long")
        weights = F.transform("pixels", lambda v, i: v.cast("long") * i)
        add = lambda values: F.aggregate(values, zero, lambda total, v: total + v)
        return frames.select("layout", "page_id", F.size("pixels").cast("long").alias("pixels"), add("pixels").alias("total"), add(weights).alias("weighted"))

    return decoded("split").union(decoded("doubled"))
