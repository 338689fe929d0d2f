"""Registered queries of the conversation engine over whole tables, and their equals in DuckDB SQL.

``documents`` stand in for stored chunks (source for the project), ``embeddings`` for their vectors
(vec_id for the chunk), ``conversations`` for transcripts.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadloom.functions import redact as redaction
from threadloom.functions import text as T
from threadloom.functions.redact import redact
from threadloom.operators import retrieval
from threadloom.operators.chunks import split_column
from threadloom.operators.embedding import embed
from threadloom.operators.turns import turns_of, window_around
from threadloom.plans import incremental
from threadloom.plans.catalog import shared_dir
from threadloom.sources.transcripts import conversation_events, parse_lines

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

#: The query vector of the dense queries, and the terms of the sparse ones, which can't overlap themselves.
VECTOR = [((k * 37) % 64 - 31.5) / 64 for k in range(64)]
TERMS, RARE = "the and", "whe"
PROJECT, LABEL, LIMIT = "src3", 3, 10


def query(sql: str | None = None) -> Callable:
    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return turns_of(conversation_events(_table(spark, sf_dir, "conversations")))


def _chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id"), F.col("source").alias("project_path"), "text")


def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("chunk_id"), "embedding")


_CLEAN = r"trim(regexp_replace(regexp_replace(regexp_replace({0}, '\r\n', chr(10), 'g'), '[ \t]+', ' ', 'g'), '[ \t\r]+(\n)', '\1', 'g'), ' ' || chr(9) || chr(10) || chr(13))"
TURNS_SQL = f"""
ev AS (SELECT CAST(conv_id AS VARCHAR) AS session_id, turn + 1 AS line, role, {_CLEAN.format("coalesce(text, '')")} AS t FROM conversations WHERE role IN ('user', 'assistant')),
num AS (SELECT *, sum(CASE WHEN role = 'user' AND t <> '' THEN 1 ELSE 0 END) OVER (PARTITION BY session_id ORDER BY line) AS n FROM ev),
turns AS (SELECT session_id, CAST(n - 1 AS BIGINT) AS turn_index, max(CASE WHEN role = 'user' THEN t END) AS "user",
  coalesce(string_agg(CASE WHEN role = 'assistant' AND t <> '' THEN t END, chr(10) || chr(10) ORDER BY line), '') AS assistant,
  CAST(min(CASE WHEN role = 'user' THEN line END) AS BIGINT) AS line_start, CAST(max(line) AS BIGINT) AS line_end
  FROM num WHERE n > 0 AND (role = 'assistant' OR t <> '') GROUP BY session_id, n),
rendered AS (SELECT *, 'User: ' || "user" || CASE WHEN assistant <> '' THEN chr(10) || chr(10) || 'Assistant: ' || assistant ELSE '' END AS text FROM turns)
"""


@query(f'WITH {TURNS_SQL} SELECT session_id, turn_index, "user", assistant, line_start, line_end FROM turns')
def turns_grouped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PAR1, PAR2, WIN2, AGG4, AGG5."""
    return _turns(spark, sf_dir).select("session_id", "turn_index", "user", "assistant", "line_start", "line_end")


@query(
    f"""WITH {TURNS_SQL}, f AS (SELECT *, split_part("user", chr(10), 1) AS first FROM rendered)
SELECT session_id, turn_index, text, CASE WHEN first = '' THEN 'Conversation' WHEN length(first) <= 80 THEN first ELSE rtrim(substr(first, 1, 79)) || '...' END AS title,
  CAST(greatest(1, len(regexp_extract_all(text, '\\S+'))) AS BIGINT) AS token_count FROM f"""
)
def turns_render_title_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TXT13-TXT15."""
    text = T.render_turn(F.col("user"), F.col("assistant"), F.col("tool_summary"))
    return _turns(spark, sf_dir).select("session_id", "turn_index", text.alias("text"), T.title(F.col("user")).alias("title"), T.token_count(text).alias("token_count"))


@query(f"WITH {TURNS_SQL} SELECT session_id, turn_index, substr(sha256(text), 1, 16) AS content_hash FROM rendered")
def chunk_content_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TXT16."""
    text = T.render_turn(F.col("user"), F.col("assistant"), F.col("tool_summary"))
    return _turns(spark, sf_dir).select("session_id", "turn_index", T.content_hash(text).alias("content_hash"))


@query(f"WITH {TURNS_SQL} SELECT concat_ws(':', session_id, line_start, turn_index + 1, 1, substr(sha256(text), 1, 16)) AS chunk_uid, session_id FROM rendered")
def chunk_uid_single_part(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CHK1 for turns of one part."""
    text = T.render_turn(F.col("user"), F.col("assistant"), F.col("tool_summary"))
    uid = F.concat_ws(":", "session_id", "line_start", F.col("turn_index") + 1, F.lit(1), T.content_hash(text))
    return _turns(spark, sf_dir).select(uid.alias("chunk_uid"), "session_id")


@query()
def chunk_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CHK2-CHK5."""
    parts = _table(spark, sf_dir, "documents").select("doc_id", F.posexplode(split_column(F.col("text"), 800)).alias("part_index", "part"))
    return parts.withColumn("n_chars", F.length("part"))


@query(f"SELECT doc_id, {_CLEAN.format('text')} AS cleaned, length({_CLEAN.format('text')}) AS n_chars FROM documents")
def clean_text_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TXT1-TXT3."""
    cleaned = T.clean_text(F.col("text"))
    return _table(spark, sf_dir, "documents").select("doc_id", cleaned.alias("cleaned"), F.length(cleaned).cast("bigint").alias("n_chars"))


@query(
    """WITH l AS (SELECT doc_id, text, string_split(regexp_replace(text, '\\n$', ''), chr(10)) AS x FROM documents),
d AS (SELECT doc_id, CASE WHEN len(x) <= 120 THEN x ELSE x[:80] || ['[long output omitted]'] || x[-20:] END AS y FROM l)
SELECT doc_id, array_to_string(list_transform(y, lambda s: CASE WHEN length(s) <= 500 THEN rtrim(s) ELSE rtrim(substr(s, 1, 500)) || ' [truncated]' END), chr(10)) AS cleaned FROM d"""
)
def drop_long_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TXT10, TXT11."""
    return _table(spark, sf_dir, "documents").select("doc_id", T.truncate_lines(T.drop_long_logs(F.col("text"))).alias("cleaned"))


def _sql_pattern(prefix: str, bare: str) -> str:
    """A pattern of assignments in DuckDB's dialect, where a quote can't stand in a text."""
    return f"({prefix})(?:(\")[^\"]*\"|(')[^']*'|{bare})".replace("'", r"\x27")


_SECRET = "(?i)" + _sql_pattern(rf"\b(?:[a-z0-9]+[_-])*{redaction.KEY}\s*[:=]\s*", redaction.SECRET_BARE)
_ENV = _sql_pattern(redaction.ENV_PREFIX, redaction.ENV_BARE)
REDACTED_SQL = rf"regexp_replace(regexp_replace(text, '{_ENV}', '\1\2\3<redacted>\2\3', 'g'), '{_SECRET}', '\1\2\3<redacted>\2\3', 'g')"
TOKENS_SQL = REDACTED_SQL.replace("(text,", "(replace(text, '/home/someone', '~'),")
for _p in redaction.TOKENS:
    TOKENS_SQL = f"regexp_replace({TOKENS_SQL}, '{_p.replace('(?U)', '').replace('(?iU)', '(?i)')}', '{redaction.PLACEHOLDER}', 'g')"
_H = "md5(CAST(doc_id AS VARCHAR))"
#: Lines with one secret each, made of a row's id, in both dialects of SQL.
SECRET_LINES = (
    f"concat('key sk-', {_H}, ' end')", f"concat('x ghp_', {_H}, ', y')", f"concat('github_pat_', {_H})", f"concat('(glpat-', {_H}, ')')", f"concat('hf_', {_H}, ' and hf_short')",
    f"concat('xoxb-', {_H}, '-x')", f"concat('id AKIA', upper(substr({_H}, 1, 16)), ' z AKIA', {_H})", f"concat('AIza', substr(concat({_H}, {_H}), 1, 35), '.')", f"concat('eyJ', {_H}, '.', {_H}, '.', {_H}, ' eyJ.x')",
    f"concat('Authorization: BEARER ', {_H})", f"concat('-----BEGIN RSA PRIVATE KEY-----', chr(10), {_H}, chr(10), '-----END RSA PRIVATE KEY----- tail')", f"concat('see /home/someone/', {_H})",
    f"concat(repeat('a_', 80), 'token=', {_H}, ' mytoken=', {_H}, ' a__token=', {_H}, ' x-y_api-key: ', {_H})", f"concat('export Q1=', {_H}, ' PASSWORD = ', {_H}, ' client-secret:', {_H})",
)
_LINES_SQL = "CASE doc_id % 14 " + " ".join(f"WHEN {k} THEN {x}" for k, x in enumerate(SECRET_LINES)) + " END"


@query(f"WITH s AS (SELECT doc_id, {_LINES_SQL} AS text FROM documents) SELECT doc_id, {TOKENS_SQL} AS redacted FROM s")
def redact_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """RED1-RED15: a secret of every kind, made of the rows' ids."""
    made = F.expr(_LINES_SQL.replace("VARCHAR", "STRING"))
    return _table(spark, sf_dir, "documents").select("doc_id", redaction.redact(made, "/home/someone").alias("redacted"))


def _short_sql(text: str, limit: int) -> str:
    flat = f"trim(regexp_replace({text}, '\\s+', ' ', 'g'))"
    return f"CASE WHEN length({flat}) <= {limit} THEN {flat} ELSE rtrim(substr({flat}, 1, {limit - 1})) || '...' END"


@query(f"SELECT doc_id, {_short_sql('text', 200)} AS short, contains(lower(text), 'the ') AS has_word FROM documents")
def truncate_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TXT4, TXT6, TXT7."""
    return _table(spark, sf_dir, "documents").select("doc_id", T.truncate(F.col("text"), 200).alias("short"), T.contains_ci(F.col("text"), "The ").alias("has_word"))


_REMINDER = "concat('<System-', '<system-reminder>', {0}, '</SYSTEM-reminder>', 'reminder>', {0}, '</system-reminder>', text, '<system-reminder> open')"


@query(f"SELECT doc_id, {_CLEAN.format("concat(text, '<system-reminder> open')")} AS cleaned FROM documents")
def clean_user_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TXT2, TXT5: a reminder that the removal of another one forms, and one that is never closed."""
    return _table(spark, sf_dir, "documents").select("doc_id", T.clean_user_text(F.expr(_REMINDER.format("md5(CAST(doc_id AS STRING))"))).alias("cleaned"))


@query(
    """WITH f AS (SELECT doc_id, lpad(CAST(doc_id % 1000000000 AS VARCHAR), 9, '0') AS digits FROM documents),
t AS (SELECT *, make_timestamp(2024, 3, CAST(1 + doc_id % 28 AS BIGINT), CAST(doc_id % 24 AS BIGINT), 30, 15.0) AS stamp, regexp_replace(digits, '(000)+$', '') AS shown FROM f)
SELECT doc_id, strftime(stamp - INTERVAL 150 MINUTE, '%Y-%m-%dT%H:%M:%S') || CASE WHEN shown = '' THEN '' ELSE '.' || shown END || '+00:00' AS utc FROM t"""
)
def normalize_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TXT17: offsets and fractions of nine digits."""
    part = lambda x, n: F.lpad(x.cast("string"), n, "0")
    i = F.col("doc_id")
    at = F.concat(F.lit("2024-03-"), part(1 + i % 28, 2), F.lit("T"), part(i % 24, 2), F.lit(":30:15."), part(i % 1_000_000_000, 9), F.lit("+02:30"))
    return _table(spark, sf_dir, "documents").select("doc_id", T.normalize_timestamp(at).alias("utc"))


@query(
    """WITH p AS (SELECT doc_id, substr(text, 1, 2000) AS x FROM documents), q AS (SELECT *, CASE WHEN length(x) > 1200 OR len(string_split(regexp_replace(x, '\n$', ''), chr(10))) > 40 THEN '[long output omitted]' ELSE x END AS y FROM p WHERE NOT contains(x, '```'))
SELECT doc_id, concat('a ```', y, '``` b ```', x) AS cleaned FROM q"""
)
def clean_fenced(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TXT9: a long block between fences, and one that is never closed."""
    x = F.left("text", F.lit(2000))
    rows = _table(spark, sf_dir, "documents").select("doc_id", x.alias("x")).where(~F.contains("x", F.lit("```")))
    return rows.select("doc_id", T.clean_fences(F.concat(F.lit("a ```"), "x", F.lit("``` b ```"), "x")).alias("cleaned"))


@query("SELECT doc_id, trim(regexp_replace(regexp_replace(replace(text, '. ', repeat(chr(10) || ' ', 5)), '(?m)^[ \t]+$', '', 'g'), '\n{4,}', repeat(chr(10), 3), 'g'), ' ' || chr(9) || chr(10) || chr(13)) AS cleaned FROM documents WHERE NOT contains(text, chr(13))")
def collapse_blank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TXT12."""
    rows = _table(spark, sf_dir, "documents").where(~F.contains("text", F.lit("\r")))
    return rows.select("doc_id", T.collapse_blank_lines(F.replace("text", F.lit(". "), F.lit("\n " * 5))).alias("cleaned"))


_TOOL_TEXT = "trim(regexp_replace(coalesce(text, ''), '\\s+', ' ', 'g'))"


@query(
    f"""WITH u AS (SELECT conv_id, turn, {_short_sql("coalesce(text, '')", 160)} AS command, {_short_sql("coalesce(text, '')", 80)} AS value, {_short_sql(f"split_part({_CLEAN.format("coalesce(text, '')")}, chr(10), 1)", 120)} AS first FROM conversations)
SELECT CAST(conv_id AS VARCHAR) || '-' || CAST(turn AS VARCHAR) AS session_id,
  ['Bash' || CASE WHEN command = '' THEN '' ELSE ': ' || command END, 'Read: /srv/' || CAST(turn AS VARCHAR), 'Grep: ' || CAST(conv_id AS VARCHAR) || ', src', 'TodoWrite: 2 todos', 'Fetch: a=true, n=' || CAST(turn AS VARCHAR) || CASE WHEN value = '' THEN ', z=' ELSE ', z=' || value END, 'Tool result' || CASE WHEN first = '' THEN '' ELSE ': ' || first END] AS tools FROM u"""
)
def tool_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PAR5-PAR8: tool calls and a result in one turn for every row, as JSON lines."""
    rows = _table(spark, sf_dir, "conversations").select("conv_id", "turn", F.coalesce("text", F.lit("")).alias("text"))
    use = lambda name, given: F.struct(F.lit("tool_use").alias("type"), F.lit(name).alias("name"), F.struct(*given).alias("input"))
    calls = [
        use("Bash", [F.col("text").alias("command")]),
        use("Read", [F.concat(F.lit("/srv/"), F.col("turn").cast("string")).alias("file_path")]),
        use("Grep", [F.col("conv_id").cast("string").alias("pattern"), F.lit("src").alias("path")]),
        use("TodoWrite", [F.array(F.lit(1), F.lit(2)).alias("todos")]),
        use("Fetch", [F.col("text").alias("z"), F.col("turn").alias("n"), F.lit(True).alias("a")]),
    ]
    said = lambda role, content: F.concat(F.lit(f'{{"type":"{role}","message":{{"role":"{role}","content":'), content, F.lit("}}"))
    events = F.array(
        said("user", F.lit('"q"')),
        said("assistant", F.concat(F.lit("["), F.concat_ws(",", *[F.to_json(c) for c in calls]), F.lit("]"))),
        said("user", F.concat(F.lit("["), F.to_json(F.struct(F.lit("tool_result").alias("type"), F.col("text").alias("content"))), F.lit("]"))),
    )
    lines = rows.select(F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("session_id"), F.posexplode(events).alias("line", "text")).withColumn("line", F.col("line") + 1)
    return turns_of(parse_lines(lines)).select("session_id", F.col("tool_summary").alias("tools"))



@query(f"SELECT doc_id, {REDACTED_SQL} AS redacted FROM documents")
def redact_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """RED2-RED15. No token pattern but assignments occurs in the tables, so the SQL has those two."""
    return _table(spark, sf_dir, "documents").select("doc_id", redact(F.col("text")).alias("redacted"))


@query(f"SELECT CAST(count(*) AS BIGINT) AS n_rows, CAST(count(*) FILTER (text IS DISTINCT FROM {REDACTED_SQL}) AS BIGINT) AS n_changed FROM documents")
def redact_changed_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SNK11, AGG8."""
    return _table(spark, sf_dir, "documents").agg(F.count("*").alias("n_rows"), F.count_if(~F.col("text").eqNullSafe(redact(F.col("text")))).alias("n_changed"))


@query("SELECT r_name AS name, '/' || replace(r_name, ' ', '/') AS decoded FROM region UNION ALL SELECT n_name, n_name FROM nation")
def decode_project_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC5."""
    regions = _table(spark, sf_dir, "region").select(F.col("r_name").alias("name"), F.concat(F.lit("-"), F.replace("r_name", F.lit(" "), F.lit("-"))).alias("dir"))
    nations = _table(spark, sf_dir, "nation").select(F.col("n_name").alias("name"), F.col("n_name").alias("dir"))
    return regions.unionByName(nations).select("name", T.decode_project(F.col("dir")).alias("decoded"))


_Q = "[" + ", ".join(repr(x) for x in VECTOR) + "]::DOUBLE[]"
DISTANCE_SQL = f"dist AS (SELECT vec_id AS chunk_id, label, 1 - list_dot_product(CAST(embedding AS DOUBLE[]), {_Q}) / (sqrt(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))) * sqrt(list_dot_product({_Q}, {_Q}))) AS distance FROM embeddings)"


def _nearest(spark: SparkSession, sf_dir: str, exact: bool | None) -> DataFrame:
    known = _table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("chunk_id"), F.col("label").alias("project_path"))
    project = None if exact is None else LABEL
    return retrieval.dense(_vectors(spark, sf_dir), known, VECTOR, LIMIT, project, bool(exact)).select("chunk_id", F.round("distance", 9).alias("distance"))


@query(f"WITH {DISTANCE_SQL} SELECT chunk_id, round(distance, 9) AS distance FROM dist ORDER BY dist.distance, chunk_id LIMIT 10")
def dense_knn_global(spark: SparkSession, sf_dir: str) -> DataFrame:
    """KNN1."""
    return _nearest(spark, sf_dir, None)


@query(
    f"""WITH {DISTANCE_SQL}, wide AS (SELECT *, row_number() OVER (ORDER BY distance, chunk_id) AS k FROM dist)
SELECT chunk_id, round(distance, 9) AS distance FROM wide
WHERE label = {LABEL} AND k <= greatest({LIMIT}, least((SELECT count(*) FROM embeddings WHERE label = {LABEL}), 2000)) ORDER BY wide.distance, chunk_id LIMIT {LIMIT}"""
)
def dense_knn_scoped_post(spark: SparkSession, sf_dir: str) -> DataFrame:
    """KNN2: cut first, filtered then."""
    return _nearest(spark, sf_dir, False)


@query(f"WITH {DISTANCE_SQL} SELECT chunk_id, round(distance, 9) AS distance FROM dist WHERE label = {LABEL} ORDER BY dist.distance, chunk_id LIMIT {LIMIT}")
def dense_knn_scoped_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """KNN2: filtered first."""
    return _nearest(spark, sf_dir, True)


def _bm25_sql(terms: list[str], where: str = "true", limit: int = LIMIT, name: str = "sparse") -> str:
    count = "CAST((length(t) - length(replace(t, '{0}', ''))) // length('{0}') AS DOUBLE)"
    held = " AND ".join(f"contains(t, '{x}')" for x in terms)
    n = ", ".join(f"CAST(count(*) FILTER (contains(t, '{x}')) AS DOUBLE) AS n{k}" for k, x in enumerate(terms))
    idf = "CASE WHEN ln((n - n{0} + 0.5) / (n{0} + 0.5)) <= 0 THEN 1e-6 ELSE ln((n - n{0} + 0.5) / (n{0} + 0.5)) END"
    part = " + ".join(f"({idf.format(k)}) * ({count.format(x)} * 2.2 / ({count.format(x)} + 1.2 * (0.25 + 0.75 * size / mean)))" for k, x in enumerate(terms))
    return f"""low AS (SELECT doc_id AS chunk_id, source, lower(text) AS t, CAST(greatest(length(text) - 2, 0) AS DOUBLE) AS size FROM documents),
stats AS (SELECT CAST(count(*) AS DOUBLE) AS n, avg(size) AS mean, {n} FROM low),
{name} AS (SELECT chunk_id, -({part}) AS bm25 FROM low, stats WHERE {held} AND {where} ORDER BY bm25, chunk_id LIMIT {limit})"""


def _sparse(spark: SparkSession, sf_dir: str, terms: str, project: str | None = None) -> DataFrame:
    return retrieval.sparse(_chunks(spark, sf_dir), terms, LIMIT, project).select("chunk_id", F.round("bm25", 9).alias("bm25"))


@query(f"WITH {_bm25_sql([RARE])} SELECT chunk_id, round(bm25, 9) AS bm25 FROM sparse")
def sparse_single_term(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FTS1-FTS3."""
    return _sparse(spark, sf_dir, RARE)


@query(f"WITH {_bm25_sql(TERMS.split())} SELECT chunk_id, round(bm25, 9) AS bm25 FROM sparse")
def sparse_multi_term(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FTS1-FTS3: all terms must occur."""
    return _sparse(spark, sf_dir, TERMS)


@query("SELECT doc_id AS chunk_id, 0.0::DOUBLE AS bm25 FROM documents WHERE false")
def sparse_short_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FTS2: terms under three characters find nothing."""
    return _sparse(spark, sf_dir, "a of to")


@query(f"WITH {_bm25_sql([RARE], f"source = '{PROJECT}'")} SELECT chunk_id, round(bm25, 9) AS bm25 FROM sparse")
def sparse_scoped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FTS1 with a project; statistics stay those of all rows."""
    return _sparse(spark, sf_dir, RARE, PROJECT)


HYBRID_SQL = f"""{DISTANCE_SQL}, {_bm25_sql(TERMS.split(), limit=40)},
near AS (SELECT chunk_id, distance FROM (SELECT * FROM dist ORDER BY distance, chunk_id LIMIT 40) JOIN (SELECT doc_id AS chunk_id FROM documents) USING (chunk_id)),
nr AS (SELECT *, CAST(row_number() OVER (ORDER BY distance, chunk_id) AS INTEGER) AS dense_rank FROM near),
sr AS (SELECT *, CAST(row_number() OVER (ORDER BY bm25, chunk_id) AS INTEGER) AS sparse_rank FROM sparse),
fused AS (SELECT coalesce(nr.chunk_id, sr.chunk_id) AS chunk_id, dense_rank, sparse_rank, distance, bm25,
  coalesce(1.0::DOUBLE / (60 + dense_rank), 0) + coalesce(1.0::DOUBLE / (60 + sparse_rank), 0) AS score, least(dense_rank, sparse_rank) AS best_rank FROM nr FULL JOIN sr ON nr.chunk_id = sr.chunk_id),
top AS (SELECT * FROM fused ORDER BY score DESC, best_rank, chunk_id LIMIT {LIMIT})"""


def _hybrid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.hybrid(_chunks(spark, sf_dir), _vectors(spark, sf_dir), TERMS, VECTOR, LIMIT)


@query(f"WITH {HYBRID_SQL} SELECT chunk_id, dense_rank, sparse_rank, round(score, 9) AS score, best_rank FROM top")
def rrf_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """RRF1, RRF2, JON3."""
    return _hybrid(spark, sf_dir).select("chunk_id", "dense_rank", "sparse_rank", F.round("score", 9).alias("score"), "best_rank")


@query(f"WITH {HYBRID_SQL} SELECT top.chunk_id, d.source AS project_path, d.text, round(top.score, 9) AS score, round(top.distance, 9) AS distance, round(top.bm25, 9) AS bm25 FROM top JOIN documents d ON d.doc_id = top.chunk_id")
def hybrid_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """HYB1, the flagship."""
    return _hybrid(spark, sf_dir).select("chunk_id", "project_path", "text", F.round("score", 9).alias("score"), F.round("distance", 9).alias("distance"), F.round("bm25", 9).alias("bm25"))


@query("SELECT label, CAST(count(*) AS BIGINT) AS n, CAST(min(vec_id) AS BIGINT) AS first_id FROM embeddings GROUP BY label")
def project_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG2 for every project."""
    return _table(spark, sf_dir, "embeddings").groupBy("label").agg(F.count("*").alias("n"), F.min("vec_id").alias("first_id"))


LINE, CONTEXT = 3, 1


@query(
    f"""WITH {TURNS_SQL}, w AS (SELECT *, coalesce(min(CASE WHEN line_start >= {LINE} THEN turn_index END) OVER (PARTITION BY session_id), max(turn_index) OVER (PARTITION BY session_id)) AS target FROM turns)
SELECT session_id, turn_index, "user", assistant FROM w WHERE abs(turn_index - target) <= {CONTEXT}"""
)
def expand_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """API2, WIN3 for every session."""
    return window_around(_turns(spark, sf_dir), LINE, CONTEXT).select("session_id", "turn_index", "user", "assistant")


@query(f"""WITH {TURNS_SQL} SELECT turn_index, "user", assistant, line_start, line_end FROM turns WHERE session_id = '7' ORDER BY turn_index""")
def read_session(spark: SparkSession, sf_dir: str) -> DataFrame:
    """API3, SRT5."""
    return _turns(spark, sf_dir).where("session_id = '7'").select("turn_index", "user", "assistant", "line_start", "line_end").orderBy("turn_index")


def _sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = _table(spark, sf_dir, "conversations").groupBy(F.col("conv_id").cast("string").alias("session_id"))
    lines = text.agg(F.array_sort(F.collect_list(F.struct("turn", F.coalesce("text", F.lit("")).alias("text")))).alias("x"))
    body = F.array_join(F.transform("x", lambda r: r["text"]), "\n")
    return lines.select("session_id", F.sha2(body, 256).alias("sha256"), F.octet_length(body).cast("bigint").alias("size"), F.size("x").cast("bigint").alias("n_lines"))


SESSIONS_SQL = "s AS (SELECT CAST(conv_id AS VARCHAR) AS session_id, sha256(string_agg(coalesce(text, ''), chr(10) ORDER BY turn)) AS sha256, CAST(strlen(string_agg(coalesce(text, ''), chr(10) ORDER BY turn)) AS BIGINT) AS size, CAST(count(*) AS BIGINT) AS n_lines FROM conversations GROUP BY conv_id)"


@query(f"WITH {SESSIONS_SQL} SELECT * FROM s ORDER BY size DESC, session_id LIMIT 20")
def list_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """API4, SRT4: a top-k list with a tie-break."""
    return _sessions(spark, sf_dir).orderBy(F.desc("size"), "session_id").limit(20)


@query(f"WITH {TURNS_SQL} SELECT CAST(count(DISTINCT session_id) AS BIGINT) AS sessions, CAST(count(*) AS BIGINT) AS chunks FROM turns")
def stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG1, API10."""
    return _turns(spark, sf_dir).agg(F.countDistinct("session_id").alias("sessions"), F.count("*").alias("chunks"))


@query(
    f"""WITH {SESSIONS_SQL} SELECT session_id, sha256 FROM s
WHERE NOT (CAST(session_id AS BIGINT) % 3 = 0)"""
)
def session_skip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FLT7, JON8: every third session is stored with the same marks, the next without a signature."""
    files = _sessions(spark, sf_dir).withColumns({"mtime": F.lit("2026-05-13T01:02:03+00:00"), "index_sig": F.lit("v1")})
    third = F.col("session_id").cast("bigint") % 3
    stored = files.where(third < 2).withColumn("index_sig", F.when(third == 0, F.col("index_sig")))
    return incremental.out_of_date(files, stored).select("session_id", "sha256")


UIDS_SQL = "uids AS (SELECT concat_ws(':', session_id, line_start, turn_index + 1, 1, substr(sha256(text), 1, 16)) AS chunk_uid, session_id, turn_index FROM rendered)"
_BEFORE_SQL = TURNS_SQL.replace("FROM conversations WHERE", "FROM (SELECT * FROM conversations QUALIFY turn < max(turn) OVER (PARTITION BY conv_id)) WHERE")
OLD_SQL = "o AS (WITH " + _BEFORE_SQL + ", " + UIDS_SQL + " SELECT * FROM uids)"


def _uids(conversations: DataFrame) -> DataFrame:
    turns = turns_of(conversation_events(conversations))
    text = T.render_turn(F.col("user"), F.col("assistant"), F.col("tool_summary"))
    return turns.select(F.concat_ws(":", "session_id", "line_start", F.col("turn_index") + 1, F.lit(1), T.content_hash(text)).alias("chunk_uid"), "session_id")


def _old_and_new(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The conversations without their last turns, and as they are."""
    now = _table(spark, sf_dir, "conversations")
    last = now.groupBy("conv_id").agg(F.max("turn").alias("last"))
    return _uids(now.join(last, "conv_id").where("turn < last").drop("last")), _uids(now)


_NEW_SQL = f"WITH {TURNS_SQL}, {UIDS_SQL}, {OLD_SQL}"


@query(f"{_NEW_SQL} SELECT chunk_uid, session_id FROM uids WHERE chunk_uid NOT IN (SELECT chunk_uid FROM o)")
def incremental_fresh(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JON6, SET1, SET2."""
    old, new = _old_and_new(spark, sf_dir)
    return incremental.fresh(new, old).select("chunk_uid", "session_id")


@query(f"{_NEW_SQL} SELECT chunk_uid, session_id FROM o WHERE chunk_uid NOT IN (SELECT chunk_uid FROM uids)")
def incremental_stale(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JON7, SET1."""
    old, new = _old_and_new(spark, sf_dir)
    return incremental.stale(old, new).select("chunk_uid", "session_id")


@query(f"{_NEW_SQL} SELECT chunk_uid, session_id FROM o WHERE chunk_uid IN (SELECT chunk_uid FROM uids)")
def incremental_kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SNK3: rows that stay as they are."""
    old, new = _old_and_new(spark, sf_dir)
    return incremental.kept(old, new).select("chunk_uid", "session_id")


@query("SELECT conv_id, turn, role FROM conversations WHERE conv_id NOT IN (SELECT conv_id FROM conversations WHERE role = 'system')")
def cascade_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SNK8, JON9: deleting sessions takes their rows."""
    rows = _table(spark, sf_dir, "conversations").withColumn("session_id", F.col("conv_id"))
    return incremental.without(rows, rows.where("role = 'system'")).select("conv_id", "turn", "role")


@query(f"SELECT CASE WHEN source = '{PROJECT}' THEN 'moved' ELSE source END AS project_path, CAST(count(*) AS BIGINT) AS n FROM documents GROUP BY 1")
def migrate_project(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SNK10."""
    return incremental.renamed(_chunks(spark, sf_dir), PROJECT, "moved").groupBy("project_path").agg(F.count("*").alias("n"))


@query()
def stub_embedding_norm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """EMB5, EMB6 over conversation texts."""
    from threadloom.config import Embedding

    vectors = _table(spark, sf_dir, "conversations").select("conv_id", "turn", embed(F.coalesce("text", F.lit("")), Embedding(dimension=64)).alias("v"))
    norm = F.aggregate(F.transform("v", lambda x: x.cast("double") * x), F.lit(0.0), lambda a, b: a + b)
    return vectors.select("conv_id", "turn", F.size("v").alias("width"), F.round(F.sqrt(norm), 4).alias("norm"))


@query(ORACLE_SQL["turns_grouped"])
def jsonl_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC6, PAR1-PAR9: conversations written as JSON lines and parsed."""
    event = F.to_json(F.struct(F.col("role").alias("type"), F.struct("role", F.col("text").alias("content")).alias("message")))
    lines = _table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("string").alias("session_id"), (F.col("turn") + 1).alias("line"), event.alias("text"))
    return turns_of(parse_lines(lines)).select("session_id", "turn_index", "user", "assistant", "line_start", "line_end")


@query(
    "WITH v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings), q AS (SELECT vec_id AS query_id, e AS qe FROM v WHERE vec_id % 100 = 0), "
    "d AS (SELECT query_id, vec_id, 1 - list_dot_product(e, qe) / sqrt(list_dot_product(e, e) * list_dot_product(qe, qe)) AS distance FROM q JOIN v ON vec_id <> query_id) "
    "SELECT query_id, vec_id, round(distance, 9) AS distance FROM d QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY d.distance, vec_id) <= 10"
)
def hybrid_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """KNN1 for many queries at once, O9: every hundredth vector against all, in blocks."""
    v = _table(spark, sf_dir, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("e"))
    pairs = retrieval.dense_batch(v.where("vec_id % 100 = 0"), v, LIMIT)
    return pairs.select("query_id", "vec_id", F.round("distance", 9).alias("distance"))


@query(f"WITH {TURNS_SQL} SELECT session_id, CAST(count(*) AS BIGINT) AS n_turns FROM turns GROUP BY session_id")
def stream_equals_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STR3: rows taken by a stream in micro-batches; a conversation may come in several, its turns are those of all."""
    source = f"{sf_dir}/conversations.parquet"
    schema = spark.read.parquet(source).schema
    at = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex[:10]}"
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(source)
    reader = spark.readStream.schema(schema)
    if path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(path).isDirectory():
        stream = reader.parquet(source)
    else:  # a stream takes no single file, only the folder that holds it
        stream = reader.option("pathGlobFilter", "conversations.parquet").parquet(sf_dir)

    def batch(rows: DataFrame, number: int) -> None:  # a batch that is done again writes the same folder again
        rows.write.mode("overwrite").parquet(f"{at}/out/batch={number}")

    stream.writeStream.foreachBatch(batch).option("checkpointLocation", f"{at}/state").trigger(availableNow=True).start().awaitTermination()
    turns = turns_of(conversation_events(spark.read.schema(schema).parquet(f"{at}/out")))
    return turns.groupBy("session_id").agg(F.count("*").alias("n_turns"))
