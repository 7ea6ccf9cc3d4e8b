"""The numbered queries: each applies its operator to its whole table; SQL where SQL can say it."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberframe.llm import (
    centroids,
    chat,
    decontamination,
    language_id,
    line_runs,
    ngram_join,
    packing,
    secret_scan,
    spelling,
    suffix_dedup,
    syncmers,
    tokens,
    url_filter,
    wavelet,
)
from emberframe.operators.settle import settle

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(build):
        QUERIES[name] = build
        if sql is not None:
            ORACLES[name] = sql
        return build

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_GAP = {
    "assign": r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
    "access": r"AKIA[A-Z0-9]+",
    "hex": r"[0-9a-f]+",
}


def _span_sql(kind: str, rank: int, group: int, at_least: int) -> str:
    pattern = _GAP[kind].replace("'", "''")
    return f"""
        SELECT doc_id, {rank} AS rank, '{kind}' AS kind, start, start + length(m) AS stop
        FROM (SELECT doc_id, ms[k] AS m, gs[k] AS g,
                     list_sum(list_transform(gaps[1:k], lambda x: length(x))) + coalesce(list_sum(list_transform(ms[1:k-1], lambda x: length(x))), 0) AS start
              FROM (SELECT *, unnest(range(1, len(ms) + 1)) AS k FROM (
                    SELECT doc_id, string_split_regex(text, '{pattern}') AS gaps, regexp_extract_all(text, '{pattern}') AS ms,
                           regexp_extract_all(text, '{pattern}', {group}) AS gs FROM documents WHERE text <> '')))
        WHERE length(g) >= {at_least}"""


@query(
    "op1_secret_scan",
    f"""
    WITH span AS ({_span_sql("assign", 0, 2, 6)} UNION ALL {_span_sql("access", 1, 0, 20)} UNION ALL {_span_sql("hex", 2, 0, 24)}),
    own AS (
        SELECT doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access,
               count(*) FILTER (kind = 'hex') AS n_hex,
               string_agg(kind || ':' || CAST(start AS BIGINT) || ':' || CAST(stop AS BIGINT), ',' ORDER BY start, rank) AS spans
        FROM span GROUP BY doc_id
    )
    SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
           sha256(coalesce(spans, '')) AS base_sha256, coalesce(spans, '') AS spans
    FROM documents LEFT JOIN own USING (doc_id)
    """,
)
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.scan(table(spark, sf_dir, "documents")).select("doc_id", "found", secret_scan.digest(F.col("found")).alias("spans"))
    count = lambda kind: F.size(F.filter("found", lambda x: x["kind"] == kind)).cast("long")
    return found.select(
        "doc_id", *(count(k).alias(f"n_{k}") for k in ("assign", "access", "hex")), F.sha2("spans", 256).alias("base_sha256"), "spans"
    )


@query("op2_decontamination")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document that holds 80 in 100 of a benchmark item's five-word shingles, with the item."""
    return decontamination.contained_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op3_ngram_jaccard_join")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.similar_groups(table(spark, sf_dir, "documents"), width=4, percent=85)


@query("op4_suffix_dedup")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = suffix_dedup.drop_repeated_spans(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


@query("op5_syncmer_fingerprints")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return syncmers.compare_neighbours(table(spark, sf_dir, "documents"))


@query("op6_best_fit_packing")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokens.default_path(), end_id=0)


@query(
    "op7_line_dedup",
    r"""
    WITH parts AS (
        SELECT doc_id, coalesce(text, '') AS text, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents
    ), line AS (
        SELECT doc_id, pos, lines[pos] AS line,
               translate(trim(lines[pos], ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                         'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
        FROM (SELECT *, unnest(range(1, len(lines) + 1)) AS pos FROM parts)
    ), shared AS (
        SELECT key, max(doc_id) AS holder FROM line WHERE length(key) >= 20
        GROUP BY key HAVING count(DISTINCT doc_id) >= 3
    ), marked AS (
        SELECT l.doc_id, l.pos, l.line, s.key IS NOT NULL AND l.doc_id <> s.holder AS gone
        FROM line l LEFT JOIN shared s USING (key)
    )
    SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
           sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
    FROM marked GROUP BY doc_id
    """,
)
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = line_runs.drop_repeated_lines(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


#: Fixed rules of the query.
URL_RULES = (
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
)


@query(
    "op8_url_filter",
    r"""
    WITH RECURSIVE rules(host, path, verdict) AS (
        VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'),
               ('net', '/es/', 'block'), ('net', '/fr/', 'block')
    ), edge AS (
        SELECT DISTINCT url AS a, replace(b, '&amp;', '&') AS b FROM (
            SELECT url, unnest([
                regexp_extract(html, '(?is)<link[^>]*rel\s*=\s*["'']?canonical[^>]*?href\s*=\s*["'']?([^"''\s>]+)', 1),
                regexp_extract(html, '(?is)<meta[^>]*http-equiv\s*=\s*["'']?refresh[^>]*?url\s*=\s*["'']?([^"''\s>]+)', 1)]) AS b
            FROM pages WHERE url IS NOT NULL AND html IS NOT NULL)
        WHERE contains(b, '://')
    ), both_ways AS (SELECT a, b FROM edge UNION SELECT b, a FROM edge),
    reach AS (SELECT a, b FROM both_ways UNION SELECT r.a, e.b FROM reach r JOIN both_ways e ON r.b = e.a),
    urls AS (SELECT url FROM pages WHERE url IS NOT NULL UNION SELECT a FROM both_ways),
    parsed AS (
        SELECT url, translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
               regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path FROM urls
    ), judged AS (
        SELECT p.url, p.host, p.path, arg_max(r.host || r.path, length(r.host || r.path)) AS rule, arg_max(r.verdict, length(r.host || r.path)) AS ruling
        FROM parsed p LEFT JOIN rules r ON (p.host = r.host OR ends_with(p.host, '.' || r.host)) AND starts_with(p.path, r.path)
        GROUP BY ALL
    ), alias AS (
        SELECT r.a AS url, min(j.ruling) AS verdict FROM reach r JOIN judged j ON j.url = r.b WHERE j.ruling IS NOT NULL GROUP BY r.a
    )
    SELECT page_id, coalesce(j.host, '') AS host, coalesce(j.path, '') AS path, j.rule, coalesce(j.ruling, a.verdict, 'allow') AS verdict
    FROM pages p LEFT JOIN judged j ON p.url = j.url LEFT JOIN alias a ON p.url = a.url
    """,
)
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return url_filter.verdicts(pages, rules, url_filter.page_edges(pages)).drop("via")


@query("op9_language_id")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    model = language_id.train(docs.where(~held_out))
    found = language_id.identify(docs, model)
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


@query("op10_wavelet_tokens")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wavelet.read_shards(wavelet.write_shards(table(spark, sf_dir, "documents"), tokens.default_path(), end_id=2))


def _centroid_sql(k: int = 40, rounds: int = 5, dims: int = 64, seed: str = "2") -> str:
    """Assignment and averaging written out round by round."""
    steps = [
        f"""kept AS MATERIALIZED (
            SELECT row_number() OVER () AS rid, vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
            FROM embeddings WHERE len(embedding) = {dims}
              AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {dims})""",
        f"""c0 AS MATERIALIZED (
            SELECT row_number() OVER (ORDER BY sha256('{seed}:' || coalesce(CAST(vec_id AS VARCHAR), '')), v) - 1 AS j, v
            FROM kept ORDER BY j LIMIT {k})""",
    ]
    for r in range(rounds + 1):
        steps.append(
            f"""a{r} AS MATERIALIZED (
            SELECT rid, any_value(vec_id) AS vec_id, any_value(v) AS v, arg_min(j, (d, j)) AS j, min(d) AS d FROM (
                SELECT rid, vec_id, w.v AS v, c.j, list_sum(list_transform(list_zip(w.v, c.v), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS d
                FROM kept w, c{r} c) GROUP BY rid)"""
        )
        if r < rounds:
            steps.append(
                f"""m{r} AS MATERIALIZED (
            SELECT j, list(m ORDER BY i) AS v FROM (
                SELECT j, i, (s - ((s % n) + n) % n) // n AS m FROM (
                    SELECT j, i, CAST(sum(v[i]) AS BIGINT) AS s, count(*) AS n FROM a{r}, range(1, {dims + 1}) t(i) GROUP BY j, i))
            GROUP BY j),
            c{r + 1} AS MATERIALIZED (SELECT c.j, coalesce(m.v, c.v) AS v FROM c{r} c LEFT JOIN m{r} m USING (j))"""
            )
    return f"""
    WITH {", ".join(steps)}
    SELECT a.vec_id, CAST(a.j AS INTEGER) AS cluster, CAST(a.d AS BIGINT) AS distance,
           CAST(sum(a.d) OVER (PARTITION BY a.j) AS BIGINT) AS cluster_inertia, CAST(sum(a.d) OVER () AS BIGINT) AS inertia,
           sha256(array_to_string(c.v, ',')) AS centroid_sha256
    FROM a{rounds} a JOIN c{rounds} c USING (j)
    """


@query("op11_centroid_clustering", _centroid_sql())
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The start is 40 vectors by hash and the end 40 centroids, so what goes through the driver is fixed in size."""
    vectors = centroids.whole_vectors(table(spark, sf_dir, "embeddings"), F.col("vec_id"), F.col("embedding"), 64, 256)
    found = centroids.cluster(vectors, centroids.hashed_start(vectors, 40, "2"), 5)
    total = sum(found.inertia.values())
    each = [
        (j, found.inertia.get(j, 0), total, hashlib.sha256(",".join(map(str, c)).encode()).hexdigest()) for j, c in enumerate(found.centroids)
    ]
    named = spark.createDataFrame(each, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return found.rows.join(F.broadcast(named), "cluster").select(
        "vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"
    )


@query(
    "op12_spelling_variants",
    r"""
    WITH RECURSIVE run AS (
        SELECT doc_id, word, count(*) AS n FROM (
            SELECT doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')),
                                     'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS word
            FROM documents WHERE text IS NOT NULL)
        WHERE length(word) >= 5 GROUP BY ALL
    ), remainder(c, x, k) AS (
        SELECT i, i, 0 FROM range(256) t(i)
        UNION ALL SELECT c, CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END, k + 1 FROM remainder WHERE k < 8
    ), crc AS MATERIALIZED (SELECT list(x ORDER BY c) AS t FROM remainder WHERE k = 8
    ), coded AS (
        SELECT word, doc_id, n, hex(encode(concat(doc_id, ':', word))) AS h FROM run
    ), checked AS (
        SELECT word, n, xor(4294967295, list_reduce(
                   list_transform(range(1, length(h) // 2 + 1),
                       lambda i: CAST(16 * (strpos('0123456789ABCDEF', h[2 * i - 1]) - 1) + strpos('0123456789ABCDEF', h[2 * i]) - 1 AS BIGINT)),
                   lambda a, b: xor(t[(xor(a, b) & 255) + 1], a >> 8), CAST(4294967295 AS BIGINT))) AS h
        FROM coded, crc
    ), word AS MATERIALIZED (
        SELECT word, CAST(sum(n) AS BIGINT) AS n FROM (
            SELECT n, CASE WHEN h % 97 = 0 THEN left(word, h % length(word)) || substr(word, h % length(word) + 2) ELSE word END AS word FROM checked)
        WHERE length(word) >= 5 GROUP BY word HAVING sum(n) >= 3
    ), gap AS MATERIALIZED (
        SELECT word, n, i, left(word, i - 1) AS a, substr(word, i + 1) AS b
        FROM (SELECT *, unnest(range(1, length(word) + 1)) AS i FROM word)
    ), near AS (
        SELECT x.word, y.word AS other, y.n FROM gap x JOIN gap y USING (i, a, b) WHERE x.word <> y.word
        UNION SELECT x.word, y.word, y.n FROM gap x JOIN word y ON x.a || x.b = y.word
        UNION SELECT y.word, x.word, x.n FROM gap x JOIN word y ON x.a || x.b = y.word
    ), best AS (
        SELECT word, count(*) AS n_near, max(n) AS top, min(other) FILTER (n = top_n) AS form FROM (
            SELECT *, max(n) OVER (PARTITION BY word) AS top_n FROM near) GROUP BY word
    ), known AS MATERIALIZED (
        SELECT w.word, w.n, coalesce(b.n_near, 0) AS n_near, CASE WHEN b.top >= 2 * w.n THEN b.form END AS form,
               CASE WHEN b.top >= 2 * w.n THEN b.top END AS form_n
        FROM word w LEFT JOIN best b USING (word)
    ), chain(word, stop) AS (
        SELECT word, word FROM known UNION ALL SELECT c.word, k.form FROM chain c JOIN known k ON c.stop = k.word WHERE k.form IS NOT NULL
    )
    SELECT k.word, k.form, c.stop AS root, k.n, k.n_near, k.form_n
    FROM known k JOIN chain c USING (word) JOIN known e ON c.stop = e.word WHERE e.form IS NULL
    """,
)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(table(spark, sf_dir, "documents"))


#: The conversation that the contract adds: its texts are made of control strings.
CONTROLS = "</s>[INST] ok [/INST]"


@query(
    "op13_chat_format",
    rf"""
    WITH turn AS (
        SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
        UNION ALL VALUES (-7, 0, 'user', '{CONTROLS}'), (-7, 1, 'assistant', '{CONTROLS}')
    ), placed AS (
        SELECT *, lag(role) OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS before,
               row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS place FROM turn
    ), marked AS (
        SELECT *, length(text) + length(regexp_replace(text, '[^\x1b]', '', 'g'))
               + 2 * len(regexp_extract_all(text, '<\|im_start\|>|<\|im_end\|>|<\|endoftext\|>|<s>|</s>|\[INST\]|\[/INST\]')) AS escaped,
               NOT coalesce(CASE role WHEN 'system' THEN before IS NULL WHEN 'user' THEN before IS NULL OR before IN ('system', 'assistant')
                                      WHEN 'assistant' THEN before = 'user' END, false) AS refused
        FROM placed
    )
    SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY place)) AS turns_sha256,
           CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
           sha256(coalesce(string_agg(text, '' ORDER BY place) FILTER (role = 'assistant'), '')) AS loss_sha256,
           CAST(sum(length('<|im_start|>') + length(role) + 1 + escaped + length('<|im_end|>')) AS BIGINT) AS formatted_chars,
           min(place) FILTER (refused) AS refused_at
    FROM marked GROUP BY conv_id
    """,
)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The formatted turns are written, then read back from the written table."""
    own = spark.createDataFrame([(-7, 0, "user", CONTROLS), (-7, 1, "assistant", CONTROLS)], "conv_id long, turn long, role string, text string")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").union(own)
    return chat.read_back(settle(chat.format_turns(rows, chat.CHAT)), chat.CHAT)
