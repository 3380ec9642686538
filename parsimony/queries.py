"""Queries over the test tables, one for each operator, with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from parsimony.functions import text as X
from parsimony.operators import fidelity, ledger, lines, ranking, select, store
from parsimony.operators import json_columns as J
from parsimony.operators.binary import line_diffs
from parsimony.plans import recover
from parsimony.plans.compress import compress
from parsimony.plans.policy import Policy, pipeline_for
from parsimony.streaming import ledger as stream

Q: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
NOW = 1_706_745_600  # a fixed present: 2024-02-01


def query(name: str, sql: str | None = None):
    def put(f):
        Q[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return put


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


# --- payloads made from the tables, alike on both sides ----------------------------------------

_H = "sha256(CAST(doc_id AS VARCHAR))"
SECRETS_SQL = f"""(SELECT doc_id, lang, text || ' key sk-' || substr({_H}, 1, 24) || ' id AKIA' || upper(substr({_H}, 1, 16)) || ' at http://u:' || substr({_H}, 1, 6) || '@host with Bearer ' || substr({_H}, 7, 10) || '= and eyJ' || substr({_H}, 1, 5) || '.' || substr({_H}, 6, 5) || '.' || substr({_H}, 11, 5) AS body FROM documents)"""


def secrets(s: SparkSession, d: str) -> DataFrame:
    h = F.sha2(F.col("doc_id").cast("string"), 256)
    sub = lambda a, n: F.substring(h, a, n)
    body = F.concat("text", F.lit(" key sk-"), sub(1, 24), F.lit(" id AKIA"), F.upper(sub(1, 16)), F.lit(" at http://u:"), sub(1, 6), F.lit("@host with Bearer "), sub(7, 10), F.lit("= and eyJ"), sub(1, 5), F.lit("."), sub(6, 5), F.lit("."), sub(11, 5))
    return table(s, d, "documents").select("doc_id", "lang", body.alias("body"))


RUNS_SQL = r"""(SELECT doc_id, lang, text || E'\naa\naa\nbb\nbb\nbb\n2024-01-02T03:04:05Z cc\nJan  2 03:04:06 cc\ncc\n' AS body FROM documents)"""


def runs(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "documents").select("doc_id", "lang", F.concat("text", F.lit("\naa\naa\nbb\nbb\nbb\n2024-01-02T03:04:05Z cc\nJan  2 03:04:06 cc\ncc\n")).alias("body"))


LOGS_SQL = r"""(SELECT user_id AS payload_id, string_agg(event_type || ' id=' || event_id || ' took ' || CAST(floor(value) AS BIGINT) || E'ms at 0xff\n', '' ORDER BY event_id) AS body FROM events GROUP BY user_id)"""


def logs(s: SparkSession, d: str) -> DataFrame:
    line = F.concat("event_type", F.lit(" id="), "event_id", F.lit(" took "), F.floor("value").cast("string"), F.lit("ms at 0xff\n"))
    rows = table(s, d, "events").groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("event_id", line.alias("l")))).alias("a"))
    return rows.select(F.col("user_id").alias("payload_id"), F.array_join(F.transform("a", lambda x: x["l"]), "").alias("body"))


LEDGER_SQL = """(SELECT 'r' || event_id AS request_id, strftime(date_trunc('second', ts), '%Y-%m-%dT%H:%M:%SZ') AS timestamp, CASE WHEN event_id % 3 <> 0 THEN 'wrap' ELSE 'cli' END AS surface, 'json' AS format,
  CASE event_id % 4 WHEN 0 THEN 'conservative' WHEN 1 THEN 'balanced' WHEN 2 THEN 'aggressive' ELSE 'balanced' END AS mode, CASE WHEN event_id % 5 < 3 THEN 'compressed' ELSE 'best_effort' END AS status,
  o AS original_tokens, c AS compressed_tokens, greatest(o - c, 0) AS saved_tokens, CASE WHEN o = 0 THEN 0.0 ELSE CAST(greatest(o - c, 0) AS DOUBLE) / o * 100 END AS savings_pct,
  CASE WHEN event_type = 'error' AND event_id % 3 <> 0 THEN 'would_increase_tokens' END AS bypass_reason, 'sha256:' || sha256('/p/' || user_id) AS project_hash
  FROM (SELECT *, CAST(floor(value * 10) AS BIGINT) AS o, CAST(floor(value * 10) AS BIGINT) - CAST(floor(floor(value * 10) * (event_id % 7) / 20) AS BIGINT) AS c FROM events))"""


def records(s: SparkSession, d: str) -> DataFrame:
    e, i = table(s, d, "events"), F.col("event_id")
    o = F.floor(F.col("value") * 10).cast("long")
    reports = e.select(
        F.concat(F.lit("r"), i).alias("request_id"),
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("timestamp"),
        (i % 3 != 0).alias("is_wrap"),
        (F.col("event_type") == "error").alias("never_worse_applied"),
        F.lit(None).cast("string").alias("bypass"),
        F.lit("json").alias("format"),
        F.when(i % 4 == 0, "conservative").when(i % 4 == 2, "aggressive").otherwise("balanced").alias("mode"),
        F.when(i % 5 < 3, "compressed").otherwise("best_effort").alias("status"),
        o.alias("original_tokens"),
        (o - F.floor(o * (i % 7) / 20).cast("long")).alias("compressed_tokens"),
        X.project_hash(F.concat(F.lit("/p/"), F.col("user_id"))).alias("project"),
    )
    return ledger.record_from_report(reports)


ENTRIES_SQL = f"(SELECT lang AS namespace, sha256(text) AS hash, text AS body, {NOW} - doc_id * 97 % 900000 AS stored_at, CASE WHEN doc_id % 4 = 0 THEN NULL ELSE 604800 END AS ttl, CAST(strlen(text) AS BIGINT) AS bytes FROM documents QUALIFY row_number() OVER (PARTITION BY lang, sha256(text) ORDER BY {NOW} - doc_id * 97 % 900000 DESC, CASE WHEN doc_id % 4 = 0 THEN NULL ELSE 604800 END DESC NULLS FIRST) = 1)"


def entries(s: SparkSession, d: str) -> DataFrame:
    p = table(s, d, "documents").select(F.col("lang").alias("namespace"), F.col("text").alias("body"), (F.lit(NOW) - F.col("doc_id") * 97 % 900000).alias("stored_at"), F.when(F.col("doc_id") % 4 != 0, F.lit(604800)).cast("long").alias("ttl"))
    empty = s.createDataFrame([], "namespace string, hash string, body string, stored_at long, ttl long, bytes long")
    return store.put(empty, p)


def split_sql(c: str) -> str:
    s = f"string_split({c}, chr(10))"
    return f"CASE WHEN {s}[-1] = '' THEN {s}[1:len({s}) - 1] ELSE {s} END"


# --- tokens, redaction, formats ----------------------------------------------------------------


@query("tokens_heuristic", "SELECT doc_id, CAST(ceil(strlen(text) / 4.0) AS BIGINT) AS tokens FROM documents")
def _(s, d):
    return table(s, d, "documents").select("doc_id", X.tokens("text").alias("tokens"))


def _redact_sql(c: str) -> str:
    for p, put in X.SECRETS:
        c = f"regexp_replace({c}, '{p}', '{put.replace('$1', chr(92) + '1')}', 'g')"
    return c


@query("redact", f"SELECT doc_id, sha256({_redact_sql('body')}) AS redacted_sha256 FROM {SECRETS_SQL}")
def _(s, d):
    return secrets(s, d).select("doc_id", F.sha2(X.redact("body"), 256).alias("redacted_sha256"))


for _i, _name in enumerate(("jwt", "api_key", "aws_key", "basic_auth", "bearer")):
    _p, _put = X.SECRETS[_i]

    @query(f"redact_{_name}", f"SELECT doc_id, sha256(regexp_replace(body, '{_p}', '{_put.replace('$1', chr(92) + '1')}', 'g')) AS redacted_sha256 FROM {SECRETS_SQL}")
    def _(s, d, p=_p, put=_put):
        return secrets(s, d).select("doc_id", F.sha2(F.regexp_replace("body", p, put), 256).alias("redacted_sha256"))


def _count_sql() -> str:
    out, c = [], "body"
    for p, put in X.SECRETS:
        out.append(f"len(regexp_extract_all({c}, '{p}'))")
        c = f"regexp_replace({c}, '{p}', '{put.replace('$1', chr(92) + '1')}', 'g')"
    return " + ".join(out)


@query("redaction_count", f"SELECT doc_id, CAST({_count_sql()} AS BIGINT) AS n FROM {SECRETS_SQL}")
def _(s, d):
    return secrets(s, d).select("doc_id", X.redaction_count("body").alias("n"))


@query("contains_secret", f"SELECT doc_id, {' OR '.join(f'''regexp_matches(body, '{p}')''' for p, _ in X.SECRETS)} AS found FROM (SELECT doc_id, body FROM {SECRETS_SQL} UNION ALL SELECT doc_id + 1000000, text FROM documents)")
def _(s, d):
    plain = table(s, d, "documents").select((F.col("doc_id") + 1000000).alias("doc_id"), F.col("text").alias("body"))
    return secrets(s, d).select("doc_id", "body").unionByName(plain).select("doc_id", X.contains_secret("body").alias("found"))


_FORMATS_SQL = r"""(SELECT conv_id * 1000 + turn AS id, CASE (conv_id + turn) % 8 WHEN 7 THEN '{"a":1,"a":' || turn || '}' WHEN 0 THEN '{"messages":[{"role":"user","content":"x"}]}' WHEN 1 THEN '{"system":"s","messages":[{"role":"user"}]}' WHEN 2 THEN '[1,2]' WHEN 3 THEN '42' WHEN 4 THEN 'diff --git a b' WHEN 5 THEN '{"messages":[]}' ELSE text || E'\n+++ b' END AS body FROM conversations)"""


def _formats(s, d):
    k = (F.col("conv_id") + F.col("turn")) % 8
    body = F.when(k == 7, F.concat(F.lit('{"a":1,"a":'), "turn", F.lit("}"))).when(k == 0, '{"messages":[{"role":"user","content":"x"}]}').when(k == 1, '{"system":"s","messages":[{"role":"user"}]}').when(k == 2, "[1,2]").when(k == 3, "42").when(k == 4, "diff --git a b").when(k == 5, '{"messages":[]}').otherwise(F.concat("text", F.lit("\n+++ b")))
    return table(s, d, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), body.alias("body"))


_CHAT = "json_valid(body) AND json_type(CASE WHEN json_valid(body) THEN body ELSE 'null' END, '$.messages[0]') IS NOT NULL"


@query("detect_format", f"""SELECT id, CASE WHEN {_CHAT} THEN CASE WHEN json_type(body, '$.system') IS NOT NULL THEN 'anthropic_json' ELSE 'openai_json' END
  WHEN json_valid(body) AND json_type(CASE WHEN json_valid(body) THEN body ELSE 'null' END) IN ('OBJECT', 'ARRAY') THEN 'json' WHEN starts_with(body, 'diff --git') OR starts_with(body, '@@') OR contains(body, chr(10) || '+++ ') THEN 'git_diff' ELSE 'plain_text' END AS format FROM {_FORMATS_SQL}""")
def _(s, d):
    return _formats(s, d).select("id", X.detect_format("body").alias("format"))


@query("detect_format_proxy", f"SELECT id, CASE WHEN {_CHAT} THEN 'openai_json' ELSE 'plain_text' END AS format FROM {_FORMATS_SQL}")
def _(s, d):
    return _formats(s, d).select("id", X.detect_format_proxy("body").alias("format"))


# --- lines -------------------------------------------------------------------------------------


def _compact_sql(c: str) -> str:
    return rf"""WITH p AS (SELECT doc_id, unnest({c}) AS x, generate_subscripts({c}, 1) AS i FROM {RUNS_SQL}),
  f AS (SELECT *, CASE WHEN x = lag(x) OVER (PARTITION BY doc_id ORDER BY i) THEN 0 ELSE 1 END AS n FROM p),
  g AS (SELECT *, sum(n) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM f),
  r AS (SELECT doc_id, run, first(x) AS x, count(*) AS n FROM g GROUP BY doc_id, run)
  SELECT doc_id, sha256(string_agg(CASE WHEN n >= 3 THEN x || chr(10) || '[repeated ' || n || 'x]' || chr(10) || x ELSE rtrim(repeat(x || chr(10), CAST(n AS BIGINT)), chr(10)) || repeat(chr(10), CASE WHEN x = '' THEN CAST(n - 1 AS BIGINT) ELSE 0 END) END, chr(10) ORDER BY run)) AS out_sha256 FROM r GROUP BY doc_id"""


@query("log_compaction", _compact_sql(split_sql("body")))
def _(s, d):
    return runs(s, d).select("doc_id", F.sha2(lines.compact_log("body"), 256).alias("out_sha256"))


@query("log_compaction_ts", _compact_sql(f"list_transform({split_sql('body')}, lambda x: CASE WHEN regexp_matches(x, '{lines.ISO_TIME}') THEN regexp_replace(x, '{lines.ISO_TIME}', '') ELSE regexp_replace(x, '{lines.SYSLOG_TIME}', '') END)"))
def _(s, d):
    return runs(s, d).select("doc_id", F.sha2(lines.compact_log("body", True), 256).alias("out_sha256"))


_DIFF_SQL = f"(SELECT doc_id, list_transform({split_sql('text')}, lambda x, i: CASE WHEN (i - 1) % 8 = 0 THEN 'diff --git a/x b/x' WHEN (i - 1) % 8 = 1 THEN '@@ -1 +1 @@' WHEN (i - 1) % 8 = 2 THEN '+' || x WHEN (i - 1) % 8 = 3 THEN '-' || x ELSE ' ' || x END) AS ls FROM documents)"


def _diff_sql(keep: bool) -> str:
    head = "starts_with(x, 'diff --git') OR starts_with(x, 'index ') OR starts_with(x, '--- ') OR starts_with(x, '+++ ') OR starts_with(x, '@@')" + (" OR starts_with(x, '+') OR starts_with(x, '-')" if keep else "")
    return f"""WITH p AS (SELECT doc_id, unnest(ls) AS x, generate_subscripts(ls, 1) AS i FROM {_DIFF_SQL}), k AS (SELECT *, {head} AS k FROM p),
  f AS (SELECT *, CASE WHEN NOT k AND NOT lag(k) OVER (PARTITION BY doc_id ORDER BY i) THEN 0 ELSE 1 END AS n FROM k),
  g AS (SELECT *, sum(n) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM f),
  r AS (SELECT doc_id, run, first(x) AS x, first(k) AS k, count(*) AS n FROM g GROUP BY doc_id, run)
  SELECT doc_id, sha256(string_agg(CASE WHEN k THEN x ELSE '[' || n || '{' context' if keep else ''} lines dropped]' END, chr(10) ORDER BY run)) AS out_sha256 FROM r GROUP BY doc_id"""


def _diffs(s, d):
    made = F.transform(X.lines("text"), lambda x, i: F.when(i % 8 == 0, "diff --git a/x b/x").when(i % 8 == 1, "@@ -1 +1 @@").when(i % 8 == 2, F.concat(F.lit("+"), x)).when(i % 8 == 3, F.concat(F.lit("-"), x)).otherwise(F.concat(F.lit(" "), x)))
    return table(s, d, "documents").where(F.size(X.lines("text")) > 0).select("doc_id", F.array_join(made, "\n").alias("body"))


@query("diff_compaction", _diff_sql(True))
def _(s, d):
    return _diffs(s, d).select("doc_id", F.sha2(lines.compact_diff("body"), 256).alias("out_sha256"))


@query("diff_compaction_headers", _diff_sql(False))
def _(s, d):
    return _diffs(s, d).select("doc_id", F.sha2(lines.compact_diff("body", False), 256).alias("out_sha256"))


_PAT = lines.CAPTURED
_FOLDED = f"""WITH l AS (SELECT payload_id, list_transform({split_sql('body')}, lambda x: x || chr(10)) AS s FROM {LOGS_SQL}),
  t AS (SELECT payload_id, s, list_transform(s, lambda x: regexp_replace(x, '{_PAT}', chr(0), 'g')) AS shapes FROM l),
  u AS (SELECT *, list_transform(list_sort(list_transform(list_distinct(shapes), lambda y: {{'i': list_position(shapes, y), 'y': y}})), lambda z: z.y) AS templates FROM t)"""


@query("log_field_fold", f"""{_FOLDED}
  SELECT payload_id, sha256('{lines.LOG_FOLD}' || chr(10) || CAST(to_json(templates) AS VARCHAR) || chr(10) || array_to_string(list_transform(s, lambda x: array_to_string(list_prepend(CAST(list_position(templates, regexp_replace(x, '{_PAT}', chr(0), 'g')) - 1 AS VARCHAR), regexp_extract_all(x, '{_PAT}')), ' ')), chr(10))) AS out_sha256
  FROM u WHERE len(s) >= 3 AND len(templates) < len(s)""")
def _(s, d):
    return logs(s, d).select("payload_id", lines.fold_log("body").alias("f")).where("f is not null").select("payload_id", F.sha2("f", 256).alias("out_sha256"))


@query("log_unfold", f"{_FOLDED} SELECT payload_id, sha256(array_to_string(s, '')) AS out_sha256 FROM u WHERE len(s) >= 3 AND len(templates) < len(s)")
def _(s, d):
    folded = logs(s, d).select("payload_id", lines.fold_log("body").alias("f")).where("f is not null")
    return folded.select("payload_id", F.sha2(lines.unfold_log("f"), 256).alias("out_sha256"))


def _cut_sql(c: str) -> str:
    """As many whole characters as 50 bytes hold."""
    return f"CASE WHEN strlen({c}) > 50 THEN substr({c}, 1, CAST(list_max(list_filter(range(0, 51), lambda k: strlen(substr({c}, 1, CAST(k AS BIGINT))) <= 50)) AS BIGINT)) || '... [{X.MARKER}: truncated]' ELSE {c} END"


_ANSI_SQL = r"(SELECT doc_id, chr(27) || '[1;31m' || text || E'\nextra the line' || chr(27) || '[0m' AS body FROM documents)"


@query("filter_stages", f"""SELECT doc_id, sha256(a) AS ansi, sha256(regexp_replace(a, 'th(e|a)', '<\\1>', 'g')) AS replaced, sha256(array_to_string(list_filter(l, lambda x: regexp_matches(x, 'the')), chr(10))) AS kept, sha256(array_to_string(list_filter(l, lambda x: NOT regexp_matches(x, 'the')), chr(10))) AS stripped,
  sha256(array_to_string(l[1:2], chr(10))) AS head, sha256(array_to_string(l[greatest(len(l) - 1, 1):], chr(10))) AS tail, sha256(CASE WHEN len(l) > 2 THEN array_to_string(l[1:2], chr(10)) || chr(10) || '... [{X.MARKER}: truncated ' || (len(l) - 2) || ' more lines]' ELSE a END) AS max_lines,
  sha256({_cut_sql('a')}) AS truncated, sha256(CASE WHEN array_to_string(list_filter(l, lambda x: regexp_matches(x, 'zzz')), chr(10)) = '' THEN 'none' ELSE array_to_string(list_filter(l, lambda x: regexp_matches(x, 'zzz')), chr(10)) END) AS on_empty
  FROM (SELECT doc_id, a, {split_sql('a')} AS l FROM (SELECT doc_id, regexp_replace(body, chr(27) || '\\[[0-9;]*[A-Za-z]', '', 'g') AS a FROM {_ANSI_SQL}))""".replace("\\\\", "\\"))
def _(s, d):
    S = lines.Stage
    a = S("strip_ansi").apply(F.concat(F.lit("\u001b[1;31m"), F.col("text"), F.lit("\nextra the line\u001b[0m")))
    rows = table(s, d, "documents").select("doc_id", a.alias("a"))
    h = lambda *st: F.sha2(lines.Filter("x", "1", (), st).apply("a"), 256)
    return rows.select("doc_id", F.sha2("a", 256).alias("ansi"), h(S("replace", pattern="th(e|a)", replacement="<$1>")).alias("replaced"), h(S("keep_lines", pattern="the")).alias("kept"), h(S("strip_lines", pattern="the")).alias("stripped"), h(S("head", count=2)).alias("head"), h(S("tail", count=2)).alias("tail"), h(S("max_lines", count=2)).alias("max_lines"), h(S("truncate", count=50)).alias("truncated"), h(S("keep_lines", pattern="zzz"), S("on_empty", value="none")).alias("on_empty"))


@query("filter_truncate", f"SELECT doc_id, sha256({_cut_sql('text')}) AS truncated FROM documents")
def _(s, d):
    cut = lines.Filter("x", "1", (), (lines.Stage("truncate", count=50),)).apply("text")
    return table(s, d, "documents").select("doc_id", F.sha2(cut, 256).alias("truncated"))


@query("filter_match", """SELECT id, CASE WHEN k = 0 THEN 'git-diff' WHEN k = 1 THEN 'git-status' WHEN k = 2 THEN 'cargo' END AS filter_id, sha256(CASE WHEN k = 0 THEN replace(body, 'index 0af..1' || chr(10), '') WHEN k = 2 THEN replace(body, '   Compiling x v1' || chr(10), '') ELSE body END) AS out_sha256
  FROM (SELECT conv_id * 1000 + turn AS id, (conv_id + turn) % 4 AS k, 'index 0af..1' || chr(10) || '   Compiling x v1' || chr(10) || text || 'z' AS body FROM conversations)""")
def _(s, d):
    k = (F.col("conv_id") + F.col("turn")) % 4
    argv = F.when(k == 0, F.array(F.lit("git"), F.lit("diff"), F.lit("-w"))).when(k == 1, F.array(F.lit("git"), F.lit("status"))).when(k == 2, F.array(F.lit("cargo"), F.lit("test"))).otherwise(F.array(F.lit("ls")))
    rows = table(s, d, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), argv.alias("argv"), F.concat(F.lit("index 0af..1\n   Compiling x v1\n"), "text", F.lit("z")).alias("text"))
    return lines.apply_filters(rows).select("id", "filter_id", F.sha2("filtered", 256).alias("out_sha256"))


# --- JSON --------------------------------------------------------------------------------------


@query("json_minify", """SELECT event_id, '{"k":"a  b \\t \\" c","p":' || regexp_replace(props, '\\s+', '', 'g') || '}' AS out FROM events""")
def _(s, d):
    body = F.concat(F.lit(' { "k" : "a  b \\t \\" c" ,\n "p" :'), "props", F.lit("}\n"))
    return table(s, d, "events").select("event_id", J.minify(body).alias("out"))


_ARRAYS_SQL = """(SELECT user_id AS payload_id, '[' || string_agg('{"id": ' || event_id || ', "t": "' || event_type || '"}', ', ' ORDER BY event_id) || ']' AS body, '{"__tf_cols__":["id","t"],"__tf_rows__":[' || string_agg('[' || event_id || ',"' || event_type || '"]', ',' ORDER BY event_id) || ']}' AS folded, '[' || string_agg('{"id":' || event_id || ',"t":"' || event_type || '"}', ',' ORDER BY event_id) || ']' AS flat, count(*) AS n FROM events GROUP BY user_id)"""


def _arrays(s, d):
    item = F.concat(F.lit('{"id": '), "event_id", F.lit(', "t": "'), "event_type", F.lit('"}'))
    rows = table(s, d, "events").groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("event_id", item.alias("x")))).alias("a"), F.count("*").alias("n"))
    return rows.select(F.col("user_id").alias("payload_id"), "n", F.concat(F.lit("["), F.array_join(F.transform("a", lambda x: x["x"]), ", "), F.lit("]")).alias("body"))


@query("json_field_fold", f"SELECT payload_id, sha256(CASE WHEN n >= 2 THEN folded ELSE flat END) AS out_sha256 FROM {_ARRAYS_SQL}")
def _(s, d):
    return _arrays(s, d).select("payload_id", F.sha2(J.field_fold("body"), 256).alias("out_sha256"))


@query("json_unfold", f"SELECT payload_id, sha256(flat) AS out_sha256 FROM {_ARRAYS_SQL}")
def _(s, d):
    return _arrays(s, d).select("payload_id", F.sha2(J.field_unfold(J.field_fold("body")), 256).alias("out_sha256"))


_TWICE_SQL = """(SELECT doc_id, h, '{"a":"' || h || '","b":["' || h || '",' || doc_id || ']}' AS body FROM (SELECT doc_id, sha256(CAST(doc_id AS VARCHAR)) AS h FROM documents))"""


def _twice(s, d):
    h = F.sha2(F.col("doc_id").cast("string"), 256)
    return table(s, d, "documents").select("doc_id", F.concat(F.lit('{"a":"'), h, F.lit('","b":["'), h, F.lit('",'), "doc_id", F.lit("]}")).alias("body"))


@query("json_value_dict", f"""SELECT doc_id, '{{"__tf_dict__":["' || h || '"],"__tf_data__":{{"a":{{"__tf_ref__":0}},"b":[{{"__tf_ref__":0}},' || doc_id || ']}}}}' AS out FROM {_TWICE_SQL}""")
def _(s, d):
    return _twice(s, d).select("doc_id", J.value_dict("body").alias("out"))


@query("json_undict", f"SELECT doc_id, body AS out FROM {_TWICE_SQL}")
def _(s, d):
    return _twice(s, d).select("doc_id", J.value_undict(J.value_dict("body")).alias("out"))


@query("schema_compaction", """SELECT event_id, '{"name":"' || event_type || '","examples":[' || event_id || '],"p":{"examples":["x"]}}' AS out FROM events""")
def _(s, d):
    body = F.concat(F.lit('{"name":"'), "event_type", F.lit('", "examples": ['), "event_id", F.lit(', 2, 3], "p": {"examples": ["x", "y"]}}'))
    return table(s, d, "events").select("event_id", J.schema_compact(body).alias("out"))


# --- selection ---------------------------------------------------------------------------------

_STATS_SQL = "(SELECT user_id, med, quantile_cont(abs(value - med), 0.5) AS mad FROM events JOIN (SELECT user_id, quantile_cont(value, 0.5) AS med, count(value) AS n FROM events GROUP BY user_id) USING (user_id) WHERE n >= 2 GROUP BY user_id, med)"


@query("numeric_field_stats", f"SELECT user_id, round(med, 6) AS med, round(mad, 6) AS mad FROM {_STATS_SQL}")
def _(s, d):
    return select.numeric_stats(table(s, d, "events"), "user_id", "value").select("user_id", F.round("med", 6).alias("med"), F.round("mad", 6).alias("mad"))


@query("rank_and_turns", f"""WITH z AS (SELECT e.*, event_type = 'error' AS failure, round(CASE WHEN mad > 0 THEN abs(value - med) / (1.4826 * mad) WHEN value = med THEN 0 ELSE 1000 END, 9) AS score, event_id = min(event_id) OVER (PARTITION BY user_id) OR event_id = max(event_id) OVER (PARTITION BY user_id) AS edge FROM events e JOIN {_STATS_SQL} s USING (user_id)),
  r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY failure DESC, score DESC, edge DESC, event_id) AS rnk FROM z),
  t AS (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY rnk) AS round, first_value(failure) OVER w AS f1, first_value(score) OVER w AS s1, first_value(edge) OVER w AS e1 FROM r WINDOW w AS (PARTITION BY user_id, event_type ORDER BY rnk))
  SELECT event_id, CAST(rnk AS INTEGER) AS rnk, CAST(row_number() OVER (PARTITION BY user_id ORDER BY round, f1 DESC, s1 DESC, e1 DESC, event_type) AS INTEGER) AS turn FROM t""")
def _(s, d):
    e = table(s, d, "events").join(select.numeric_stats(table(s, d, "events"), "user_id", "value"), "user_id")
    score = select.modified_z(F.col("value"), F.col("med"), F.col("mad"))
    return select.ranked(e, "user_id", "event_id", F.col("event_type") == "error", score, F.col("event_type")).select("event_id", "rnk", "turn")


def _prunable(s, d):
    item = F.to_json(F.struct("event_id", "value", (F.col("event_type") != "error").alias("ok"), F.repeat(F.col("event_type"), 60).alias("note")))
    rows = table(s, d, "events").groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("event_id", item.alias("x")))).alias("a"))
    return rows.select(F.col("user_id").alias("payload_id"), F.concat(F.lit('{"rows":['), F.array_join(F.transform("a", lambda x: x["x"]), ","), F.lit("]}")).alias("body"))


@query("json_prune")
def _(s, d):
    rows = _prunable(s, d).withColumn("r", J.prune("body", 0.3))
    back = J.revert("r.out", "r.dropped") == J.minify("body")
    return rows.select("payload_id", F.sha2("r.out", 256).alias("out_sha256"), "r.total", F.size("r.dropped").alias("dropped"), back.alias("reverts"))


@query("json_prune_counts", """SELECT user_id AS payload_id, CASE WHEN count(*) >= 2 THEN CAST(count(*) AS INTEGER) ELSE 0 END AS total, true AS reverts, count(*) >= 2 AS smaller FROM events GROUP BY user_id""")
def _(s, d):
    """Items that pruning looked at, whether the dropped ones lead back to the payload, and whether it got smaller."""
    rows = _prunable(s, d).withColumn("r", J.prune("body", 0.3))
    return rows.select("payload_id", "r.total", (J.revert("r.out", "r.dropped") == J.minify("body")).alias("reverts"), (F.octet_length("r.out") < F.octet_length("body")).alias("smaller"))


@query("marker_hash", f"""SELECT doc_id, '{{"$tf_ref":{{"hash":"' || sha256(body) || '","alg":"sha256","namespace":"default"}}}}' AS marker FROM {_TWICE_SQL}""")
def _(s, d):
    return _twice(s, d).select("doc_id", J.marker("body").alias("marker"))


# --- plans and pipeline ------------------------------------------------------------------------

_SCOPES = "(VALUES ('all'), ('general'), ('code_review'), ('change_summary'), ('debugging'), ('search'), ('extraction'), ('planning'), ('qa')) AS s(scope)"


@query("pipeline_for", f"""SELECT mode, scope, format, CAST(pos AS INTEGER) AS pos, id, CAST(CASE mode WHEN 'conservative' THEN c ELSE CASE mode WHEN 'balanced' THEN b ELSE a END END AS DOUBLE) AS max_ratio FROM
  (VALUES (0, 'json_minify', true, true, false, 1.0, 1.0, 1.0, NULL, ['openai_json', 'anthropic_json', 'json']), (1, 'json_field_fold', false, true, false, 0.0, 1.0, 1.0, NULL, ['json']), (2, 'json_value_dict', false, true, false, 0.0, 1.0, 1.0, NULL, ['json']),
   (3, 'schema_compaction', true, true, false, 0.15, 0.3, 0.5, NULL, ['openai_json', 'anthropic_json']), (4, 'log_field_fold', false, false, true, 0.0, 1.0, 1.0, NULL, ['plain_text', 'command_output']), (5, 'log_compaction', false, true, false, 0.0, 0.65, 0.75, ['general', 'change_summary'], ['plain_text', 'command_output']),
   (6, 'diff_compaction', false, false, true, 0.0, 0.6, 0.7, ['code_review', 'change_summary'], ['plain_text', 'command_output', 'git_diff'])) AS m(pos, id, con, bal, ex, c, b, a, scopes, formats), {_SCOPES}, (VALUES ('conservative'), ('balanced'), ('aggressive')) AS o(mode), (SELECT unnest(['openai_json', 'anthropic_json', 'json', 'plain_text', 'command_output', 'git_diff']) AS format)
  WHERE (ex OR CASE WHEN mode = 'conservative' THEN con ELSE bal END) AND (scopes IS NULL OR list_contains(scopes, scope)) AND list_contains(formats, format)""")
def _(s, d):
    return pipeline_for(s, experimental=True)


_GATED = f"""WITH c AS ({_compact_sql(split_sql('body')).replace('sha256(string_agg(', '(string_agg(').replace('AS out_sha256', 'AS made')}),
  b AS (SELECT doc_id, lang, body, made, CAST(ceil(strlen(body) / 4.0) AS BIGINT) AS before, CAST(ceil(strlen(made) / 4.0) AS BIGINT) AS after FROM {RUNS_SQL} JOIN c USING (doc_id)),
  g AS (SELECT *, CASE WHEN after > before THEN 'skipped' WHEN after = before THEN 'no_op' WHEN 1 - CAST(after AS DOUBLE) / before > 0.65 THEN 'skipped' ELSE 'applied' END AS gate FROM b)"""


@query("compress_text", _GATED + " SELECT doc_id AS payload_id, before AS original_tokens, CASE WHEN gate = 'applied' THEN after ELSE before END AS compressed_tokens, gate, sha256(CASE WHEN gate = 'applied' THEN made ELSE body END) AS out_sha256 FROM g")
def _(s, d):
    out = compress(runs(s, d).select(F.col("doc_id").alias("payload_id"), "body"), Policy(scope="general"), F.lit("plain_text"))
    return out.select("payload_id", "original_tokens", "compressed_tokens", F.get("transforms", F.lit(0))["status"].alias("gate"), F.sha2("out", 256).alias("out_sha256"))


@query("savings_by_lang", _GATED + " SELECT lang, count(*) AS payloads, CAST(sum(before) AS BIGINT) AS original_tokens, CAST(sum(CASE WHEN gate = 'applied' THEN after ELSE before END) AS BIGINT) AS compressed_tokens, round(100.0 * sum(CASE WHEN gate = 'applied' THEN before - after ELSE 0 END) / sum(before), 6) AS savings_pct FROM g GROUP BY lang")
def savings_by_lang(s, d):
    rows = runs(s, d)
    made = lines.compact_log("body")
    before, after = X.tokens("body"), X.tokens("made")
    g = rows.withColumn("made", made).withColumn("before", before).withColumn("after", F.when((after < before) & (1 - after / before <= 0.65), after).otherwise(before))
    return g.groupBy("lang").agg(F.count("*").alias("payloads"), F.sum("before").alias("original_tokens"), F.sum("after").alias("compressed_tokens"), F.round(100.0 * F.sum(F.col("before") - F.col("after")) / F.sum("before"), 6).alias("savings_pct"))


@query("compress_json", f"""WITH t AS (SELECT payload_id, n, body, flat, folded, CAST(ceil(strlen(body) / 4.0) AS BIGINT) AS t0, CAST(ceil(strlen(flat) / 4.0) AS BIGINT) AS t1, CAST(ceil(strlen(folded) / 4.0) AS BIGINT) AS t2 FROM {_ARRAYS_SQL}),
  g AS (SELECT *, CASE WHEN t1 < t0 THEN 'applied' ELSE 'no_op' END AS g1, CASE WHEN n < 2 OR t2 = t1 THEN 'no_op' WHEN t2 < t1 THEN 'applied' ELSE 'skipped:would_increase_tokens' END AS g2 FROM t),
  o AS (SELECT *, CASE WHEN g2 = 'applied' THEN folded WHEN g1 = 'applied' THEN flat ELSE body END AS o FROM g)
  SELECT payload_id, 'json' AS format, t0 AS original_tokens, CAST(ceil(strlen(o) / 4.0) AS BIGINT) AS compressed_tokens, t0 - CAST(ceil(strlen(o) / 4.0) AS BIGINT) AS saved_tokens, round((t0 - ceil(strlen(o) / 4.0)) / t0, 9) AS savings_ratio, 'best_effort' AS status, 'json_minify:' || g1 || ',json_field_fold:' || g2 || ',json_value_dict:no_op' AS steps, sha256(o) AS out_sha256 FROM o""")
def _(s, d):
    out = compress(_arrays(s, d).select("payload_id", "body"))
    steps = F.array_join(F.transform("transforms", lambda t: F.concat_ws(":", t["id"], t["status"], t["skipped_reason"])), ",")
    return out.select("payload_id", "format", "original_tokens", "compressed_tokens", "saved_tokens", F.round("savings_ratio", 9).alias("savings_ratio"), "status", steps.alias("steps"), F.sha2("out", 256).alias("out_sha256"))


@query("compress_lossy")
def _(s, d):
    out = compress(_prunable(s, d), Policy(lossy="json_prune", lossy_ratio=0.2))
    return out.select("payload_id", "original_tokens", "compressed_tokens", F.size("dropped").alias("n_dropped"), "status", F.transform("transforms", lambda t: F.concat_ws(":", t["id"], t["status"], t["skipped_reason"])).alias("steps"))


@query("lossy_restore", """SELECT user_id AS payload_id, sha256('{"rows":[' || string_agg('{"event_id":' || event_id || ',"v":' || CAST(floor(value) AS BIGINT) || ',"note":"' || repeat(event_type, 60) || '"}', ',' ORDER BY event_id) || ']}') AS body_sha256, true AS whole FROM events GROUP BY user_id""")
def _(s, d):
    """Pruned payloads, their items in the store, and back again by their markers."""
    item = F.to_json(F.struct("event_id", F.floor("value").cast("long").alias("v"), F.repeat(F.col("event_type"), 60).alias("note")))
    rows = table(s, d, "events").groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("event_id", item.alias("x")))).alias("a"))
    rows = rows.select(F.col("user_id").alias("payload_id"), F.concat(F.lit('{"rows":['), F.array_join(F.transform("a", lambda x: x["x"]), ","), F.lit("]}")).alias("body"))
    policy = Policy(lossy="json_prune", lossy_ratio=0.2, disabled=("json_field_fold", "json_value_dict"))
    after, settled = recover.persist(compress(rows, policy), s.createDataFrame([], store.ENTRY), policy, NOW)
    back = recover.restore(settled.select("payload_id", "out"), after, NOW)
    return back.select("payload_id", F.sha2("body", 256).alias("body_sha256"), (F.col("n_markers") == F.col("n_found")).alias("whole"))


_CHATS = f"""WITH p AS (SELECT conv_id, '{{' || chr(10) || '  "messages" : [ ' || string_agg('{{' || chr(10) || '    "role" : ' || to_json(role) || ',' || chr(10) || '    "content" : ' || to_json(text) || chr(10) || '  }}', ', ' ORDER BY turn) || ' ]' || chr(10) || '}}' AS body,
    '{{"messages":[' || string_agg('{{"role":' || to_json(role) || ',"content":' || to_json(text) || '}}', ',' ORDER BY turn) || ']}}' AS flat, coalesce(string_agg(text, '' ORDER BY turn) FILTER (role = 'system'), '') || coalesce(arg_max(text, turn) FILTER (role = 'user'), '') AS kept, list_append(list(text) FILTER (role = 'system'), coalesce(arg_max(text, turn) FILTER (role = 'user'), '')) AS segments FROM conversations GROUP BY conv_id),
  t AS (SELECT conv_id, CAST(ceil(strlen(body) / 4.0) AS BIGINT) AS t0, CAST(ceil(strlen({_redact_sql('body')}) / 4.0) AS BIGINT) AS t1, CAST(ceil(strlen({_redact_sql('flat')}) / 4.0) AS BIGINT) AS t2, len(list_filter(segments, lambda g: NOT contains({_redact_sql('flat')}, {_redact_sql('g')}))) > 0 AS lost, ceil(strlen({_redact_sql('kept')}) / 4.0) > 50 AS stuck FROM p)"""


@query("compress_conversations", f"{_CHATS} SELECT conv_id AS payload_id, 'openai_json' AS format, t0 AS original_tokens, CASE WHEN t0 <= 50 THEN t0 WHEN stuck OR t1 <= 50 OR lost THEN t1 ELSE least(t1, t2) END AS compressed_tokens, CASE WHEN t0 <= 50 THEN 'passthrough' WHEN stuck THEN 'unreachable_target' WHEN CASE WHEN lost THEN t1 ELSE least(t1, t2) END <= 50 THEN 'compressed' ELSE 'best_effort' END AS status FROM t")
def _(s, d):
    turns = table(s, d, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", F.col("text").alias("content")))).alias("a"))
    body = F.to_json(F.struct(F.transform("a", lambda x: F.struct(x["role"].alias("role"), x["content"].alias("content"))).alias("messages")), {"pretty": "true"})
    return compress(turns.select(F.col("conv_id").alias("payload_id"), body.alias("body")), Policy(target_tokens=50)).select("payload_id", "format", "original_tokens", "compressed_tokens", "status")


@query("protected_segments", "SELECT conv_id, coalesce(string_agg(text, '|' ORDER BY turn) FILTER (role = 'system'), '') AS system, arg_max(text, turn) FILTER (role = 'user') AS last_user, CAST(ceil((coalesce(sum(strlen(text)) FILTER (role = 'system'), 0) + coalesce(strlen(arg_max(text, turn) FILTER (role = 'user')), 0)) / 4.0) AS BIGINT) AS floor FROM conversations GROUP BY conv_id")
def _(s, d):
    turns = table(s, d, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", F.col("text").alias("content")))).alias("a"))
    body = F.to_json(F.struct(F.transform("a", lambda x: F.struct(x["role"].alias("role"), x["content"].alias("content"))).alias("messages")))
    g = turns.select("conv_id", F.exists("a", lambda x: x["role"] == "user").alias("asked"), J.protected_segments(body, "openai_json").alias("p"))
    system = F.when(F.col("asked"), F.slice("p", 1, F.size("p") - 1)).otherwise(F.col("p"))
    return g.select("conv_id", F.array_join(system, "|").alias("system"), F.when(F.col("asked"), F.element_at("p", -1)).alias("last_user"), X.tokens(F.array_join("p", "")).alias("floor"))


# --- store -------------------------------------------------------------------------------------


@query("store_put", f"SELECT namespace, hash, stored_at, ttl, bytes FROM {ENTRIES_SQL}")
def _(s, d):
    return entries(s, d).drop("body")


@query("retrieve", f"""SELECT a.namespace, a.hash, CASE WHEN e.hash IS NULL THEN 'missing' WHEN ttl IS NOT NULL AND greatest({NOW} - stored_at, 0) >= ttl THEN 'expired' ELSE 'found' END AS status FROM (SELECT DISTINCT lang AS namespace, sha256(text) AS hash FROM documents UNION SELECT DISTINCT 'xx', sha256(text) FROM documents) a LEFT JOIN {ENTRIES_SQL} e USING (namespace, hash)""")
def _(s, d):
    docs = table(s, d, "documents")
    asked = docs.select(F.col("lang").alias("namespace"), F.sha2("text", 256).alias("hash")).union(docs.select(F.lit("xx"), F.sha2("text", 256))).distinct()
    return store.retrieve(entries(s, d), asked, NOW).drop("body")


@query("store_gc", f"""SELECT namespace, hash FROM (SELECT *, sum(bytes) OVER (ORDER BY stored_at DESC, hash DESC, namespace DESC ROWS UNBOUNDED PRECEDING) AS upto FROM {ENTRIES_SQL} WHERE NOT coalesce(greatest({NOW} - stored_at, 0) >= ttl, false)) WHERE upto <= 500000""")
def _(s, d):
    return store.gc(entries(s, d), NOW, 500_000).select("namespace", "hash")


@query("sha256_hex", "SELECT page_id, sha256(html) AS sha256 FROM pages")
def _(s, d):
    return table(s, d, "pages").select("page_id", F.sha2("html", 256).alias("sha256"))


@query("marker_reference", "SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN sha256(text) WHEN doc_id % 3 = 1 THEN substr(sha256(text), 1, 20) END AS hash FROM documents")
def _(s, d):
    h, k = F.sha2("text", 256), F.col("doc_id") % 3
    mark = F.when(k == 0, F.concat(F.lit(f"[{X.MARKER}:retrieve hash="), F.upper(h), F.lit(" alg=sha256 namespace=default bytes=3 ttl=9]")))
    bare = F.when(k == 2, F.lit("not hex")).otherwise(F.upper(F.substring(h, 1, 20)))
    return table(s, d, "documents").select("doc_id", X.retrieval_reference(mark, bare).alias("hash"))


# --- ledger ------------------------------------------------------------------------------------

_AGG = """count(*) AS requests, count(*) FILTER (surface = 'wrap') AS commands, count(*) FILTER (surface = 'wrap' AND bypass_reason IS NULL) AS wrapped_commands, count(*) FILTER (surface = 'wrap' AND bypass_reason IS NOT NULL) AS raw_commands, count(*) FILTER (bypass_reason IS NOT NULL) AS bypass_count,
  CAST(coalesce(sum(original_tokens), 0) AS BIGINT) AS raw_tokens, CAST(coalesce(sum(compressed_tokens), 0) AS BIGINT) AS compressed_tokens, CAST(coalesce(sum(original_tokens) FILTER (surface = 'wrap' AND bypass_reason IS NULL), 0) AS BIGINT) AS wr, CAST(coalesce(sum(saved_tokens) FILTER (surface = 'wrap' AND bypass_reason IS NULL), 0) AS BIGINT) AS ws, CAST(coalesce(sum(original_tokens) FILTER (surface = 'wrap' AND bypass_reason IS NOT NULL), 0) AS BIGINT) AS rc"""
_DERIVED = "greatest(raw_tokens - compressed_tokens, 0) AS saved_tokens, round(CASE WHEN raw_tokens = 0 THEN 0 ELSE CAST(greatest(raw_tokens - compressed_tokens, 0) AS DOUBLE) / raw_tokens * 100 END, 6) AS savings_pct, CAST(CASE WHEN wr = 0 THEN 0 ELSE round(rc * (CAST(ws AS DOUBLE) / wr)) END AS BIGINT) AS estimated_lost_tokens, round(CASE WHEN commands = 0 THEN 0 ELSE CAST(wrapped_commands AS DOUBLE) / commands * 100 END, 6) AS coverage_pct"
_COLS = ["requests", "commands", "wrapped_commands", "raw_commands", "bypass_count", "raw_tokens", "compressed_tokens", "saved_tokens", "savings_pct", "estimated_lost_tokens", "coverage_pct"]


def _summary(df: DataFrame, *by: str) -> DataFrame:
    return df.select(*by, *(F.round(c, 6).alias(c) if c.endswith("pct") else c for c in _COLS))


def _summary_sql(source: str, by: str = "") -> str:
    cols = f"{by}, " if by else ""
    return f"SELECT {cols}requests, commands, wrapped_commands, raw_commands, bypass_count, raw_tokens, compressed_tokens, {_DERIVED} FROM (SELECT {cols}{_AGG} FROM {source}{f' GROUP BY {by}' if by else ''})"


@query("ledger_records", f"SELECT request_id, timestamp, surface, mode, status, original_tokens, compressed_tokens, saved_tokens, round(savings_pct, 6) AS savings_pct, bypass_reason, project_hash FROM {LEDGER_SQL}")
def _(s, d):
    return records(s, d).drop("format").withColumn("savings_pct", F.round("savings_pct", 6))


@query("stats_aggregate", _summary_sql(LEDGER_SQL))
def _(s, d):
    return _summary(ledger.aggregate(records(s, d)))


@query("stats_by_project", _summary_sql(LEDGER_SQL, "project_hash"))
def _(s, d):
    return _summary(ledger.aggregate(records(s, d), "project_hash"), "project_hash")


_TS = "epoch(strptime(timestamp, '%Y-%m-%dT%H:%M:%SZ'))"


@query("gain", _summary_sql(f"(SELECT * FROM {LEDGER_SQL} WHERE {NOW} - {_TS} <= 604800)"))
def _(s, d):
    return _summary(ledger.gain(records(s, d), NOW, 604_800))


@query("ledger_gc", f"SELECT request_id FROM {LEDGER_SQL} WHERE {NOW} - {_TS} <= 10 * 86400")
def _(s, d):
    return ledger.gc(records(s, d), NOW, 10).select("request_id")


@query("recent_requests", f"SELECT request_id, timestamp FROM {LEDGER_SQL} ORDER BY timestamp DESC, request_id LIMIT 20")
def _(s, d):
    return ledger.recent(records(s, d), 20).select("request_id", "timestamp")


@query("policy_proposals", f"""SELECT mode AS scope, format('{{}} conservative-mode sessions averaged {{:.1f}}% savings', count(*), avg(savings_pct)) AS observation, least(count(*) / 50.0, 1.0)::DOUBLE AS confidence, count(*) AS sample_size FROM {LEDGER_SQL} WHERE status = 'compressed' AND mode = 'conservative' GROUP BY mode HAVING count(*) >= 5 AND avg(savings_pct) < 15""")
def _(s, d):
    return ledger.policy_proposals(records(s, d)).drop("suggestion")


@query("duration_seconds", "SELECT event_id, CASE event_id % 6 WHEN 0 THEN event_id * 86400 WHEN 1 THEN event_id * 3600 WHEN 2 THEN event_id * 60 WHEN 3 THEN event_id WHEN 4 THEN event_id END AS secs FROM events")
def _(s, d):
    i = F.col("event_id")
    text = F.when(i % 6 == 0, F.concat(i, F.lit("d"))).when(i % 6 == 1, F.concat(i, F.lit("h"))).when(i % 6 == 2, F.concat(F.lit(" "), i, F.lit("m"))).when(i % 6 == 3, F.concat(i, F.lit("s"))).when(i % 6 == 4, i.cast("string")).otherwise("x9")
    return table(s, d, "events").select("event_id", X.duration_seconds(text).alias("secs"))


@query("timestamps", "SELECT event_id, strftime(to_timestamp(epoch(date_trunc('second', ts))) AT TIME ZONE 'UTC', '%Y-%m-%dT%H:%M:%SZ') AS stamp, CAST(floor(epoch(ts)) AS BIGINT) AS unix FROM events")
def _(s, d):
    unix = F.unix_seconds(F.col("ts").cast("timestamp"))
    stamp = X.format_timestamp(unix)
    return table(s, d, "events").select("event_id", stamp.alias("stamp"), X.parse_timestamp(stamp).alias("unix"))


@query("csv_export", f"SELECT request_id || ',' || timestamp || ',' || CASE WHEN original_tokens % 3 = 0 THEN '\"a,\"\"b\"' ELSE 'plain' END || ',' || coalesce(bypass_reason, '') AS line FROM {LEDGER_SQL}")
def _(s, d):
    rows = records(s, d).withColumn("note", F.when(F.col("original_tokens") % 3 == 0, 'a,"b').otherwise("plain"))
    return ledger.to_csv(rows, ["request_id", "timestamp", "note", "bypass_reason"])


@query("ledger_windows", f"SELECT CAST(floor({_TS} / 3600) * 3600 AS BIGINT) AS window_start, mode, count(*) AS requests, CAST(sum(original_tokens) AS BIGINT) AS original_tokens, CAST(sum(saved_tokens) AS BIGINT) AS saved_tokens FROM {LEDGER_SQL} GROUP BY ALL")
def _(s, d):
    return stream.windows(records(s, d))


@query("output_savings", "SELECT event_id, greatest(CAST(floor(value) AS BIGINT) - event_id % 100, 0) AS measured, CAST(round(floor(value) * 0.25) AS BIGINT) AS estimated FROM events")
def _(s, d):
    v = F.floor("value").cast("long")
    return table(s, d, "events").select("event_id", ledger.output_savings_measured(v, F.col("event_id") % 100).alias("measured"), ledger.output_savings_estimated(v, F.lit(0.25)).alias("estimated"))


@query("pipeline_report", """SELECT event_id AS request_id, CASE WHEN ran THEN greatest(raw - core, 0) END AS external_saved_bytes, CASE WHEN ran AND stored THEN 'full' WHEN ran THEN 'none' ELSE 'not_applicable' END AS external_recoverability, greatest(core - out, 0) AS core_saved_bytes, CASE WHEN out < core THEN 'applied' ELSE 'passthrough' END AS core_status, CASE WHEN ran THEN 'partial' ELSE 'not_applicable' END AS raw_capture
  FROM (SELECT event_id, event_id % 2 = 0 AS ran, event_id % 4 = 0 AS stored, CAST(floor(value * 20) AS BIGINT) AS raw, CAST(floor(value * 10) AS BIGINT) AS core, CAST(floor(value * 10) AS BIGINT) - event_id % 3 AS out FROM events)""")
def _(s, d):
    i, v = F.col("event_id"), F.col("value")
    core = F.floor(v * 10).cast("long")
    rows = table(s, d, "events").select(i.alias("request_id"), (i % 2 == 0).alias("external_ran"), F.lit(True).alias("capture_raw"), ((i % 4 == 0)).alias("raw_stored"), F.lit(False).alias("store_originals"), F.lit("partial").alias("completeness"), F.floor(v * 20).cast("long").alias("raw_bytes"), core.alias("core_in_bytes"), (core - i % 3).alias("out_bytes"), F.lit(None).cast("long").alias("raw_tokens"), core.alias("original_tokens"), (core - i % 3).alias("compressed_tokens"))
    return ledger.pipeline_report(rows).select("request_id", "external_saved_bytes", "external_recoverability", "core_saved_bytes", "core_status", "raw_capture")


# --- ranking -----------------------------------------------------------------------------------

_BM25 = """WITH t AS (SELECT doc_id, unnest(list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+'), lambda x: x <> '')) AS w FROM documents), dl AS (SELECT d.doc_id, count(w) AS dl FROM documents d LEFT JOIN t USING (doc_id) GROUP BY d.doc_id),
  tf AS (SELECT doc_id, w, count(*) AS tf FROM t WHERE w IN ('the', 'licensed', 'de') GROUP BY doc_id, w), df AS (SELECT w, count(*) AS df FROM tf GROUP BY w), n AS (SELECT count(*) AS n, avg(dl) AS a FROM dl), q AS (SELECT unnest(['the', 'licensed', 'de', 'licensed']) AS w),
  s AS (SELECT doc_id, sum(ln((n - df + 0.5) / (df + 0.5) + 1) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / a))) AS score FROM q JOIN tf USING (w) JOIN df USING (w) JOIN dl USING (doc_id), n GROUP BY doc_id)""".replace("\\\\", "\\")


@query("bm25_topk", _BM25 + " SELECT doc_id AS id, round(coalesce(score, 0), 6) AS score FROM documents LEFT JOIN s USING (doc_id) ORDER BY round(coalesce(score, 0), 9) DESC, id LIMIT 25")
def _(s, d):
    chunks = table(s, d, "documents").select(F.col("doc_id").alias("id"), "text")
    return ranking.bm25_topk(chunks, ["the", "licensed", "de", "licensed"], 25).select("id", F.round("score", 6).alias("score"))


_UNITS = r"""u AS (SELECT doc_id, i - 1 AS pos, CASE WHEN i < n THEN x || chr(10) ELSE x END AS unit FROM (SELECT doc_id, unnest(l) AS x, generate_subscripts(l, 1) AS i, len(l) AS n FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)) WHERE i < n OR x <> ''), k AS (SELECT doc_id, pos, lower(unnest(regexp_extract_all(unit, '[A-Za-z0-9_]+'))) AS tok FROM u)"""
_SCORED = {
    "frequency": f"WITH {_UNITS}, z AS (SELECT DISTINCT * FROM k), df AS (SELECT doc_id, tok, count(*) AS df FROM z GROUP BY ALL), s AS (SELECT doc_id, pos, sum(1.0::DOUBLE / df) AS score FROM z JOIN df USING (doc_id, tok) GROUP BY ALL)",
    "surprisal": f"WITH {_UNITS}, c AS (SELECT doc_id, tok, count(*) AS n, sum(count(*)) OVER (PARTITION BY doc_id) AS total FROM k GROUP BY doc_id, tok), s AS (SELECT doc_id, pos, avg(-log2(n / total::DOUBLE)) AS score FROM k JOIN c USING (doc_id, tok) GROUP BY ALL)",
    "bm25": f"WITH {_UNITS}, dl AS (SELECT doc_id, pos, len(regexp_extract_all(unit, '[A-Za-z0-9_]+')) AS dl FROM u), a AS (SELECT doc_id, count(*) AS n, avg(dl) AS avgdl FROM dl GROUP BY doc_id), tf AS (SELECT doc_id, pos, tok, count(*) AS tf FROM k WHERE tok IN ('the', 'of', 'de') GROUP BY ALL), df AS (SELECT doc_id, tok, count(*) AS df FROM tf GROUP BY ALL), s AS (SELECT doc_id, pos, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))) AS score FROM tf JOIN df USING (doc_id, tok) JOIN dl USING (doc_id, pos) JOIN a USING (doc_id) GROUP BY ALL)",
}
for _sel, _sql in _SCORED.items():

    @query(f"selector_{_sel}", _sql + " SELECT doc_id, CAST(pos AS INTEGER) AS pos, round(coalesce(score, 0), 6) AS score FROM u LEFT JOIN s USING (doc_id, pos)")
    def _(s, d, sel=_sel):
        return ranking.unit_scores(ranking.units(table(s, d, "documents")), sel, ["the", "of", "de"]).select("doc_id", "pos", F.round("score", 6).alias("score"))


@query("selector_recency", f"WITH {_UNITS} SELECT doc_id, CAST(pos AS INTEGER) AS pos, CAST(pos AS DOUBLE) AS score FROM u")
def _(s, d):
    return ranking.unit_scores(ranking.units(table(s, d, "documents")), "recency").select("doc_id", "pos", "score")


@query("forced_units", f"WITH {_UNITS} SELECT doc_id, CAST(pos AS INTEGER) AS pos FROM u WHERE contains(unit, '@') OR contains(unit, 'Licensed')")
def _(s, d):
    rows = ranking.unit_scores(ranking.units(table(s, d, "documents")), "forced_only")
    return rows.where(ranking.forced(F.col("unit"), ["@", "Licensed", ""])).select("doc_id", "pos")


_ALLOC = f"""WITH {_UNITS}, r AS (SELECT doc_id, pos, strlen(unit) AS b, contains(unit, '@') AS f FROM u), g AS (SELECT doc_id, CAST(sum(b) AS BIGINT) AS total, CAST(coalesce(sum(b) FILTER (f), 0) AS BIGINT) AS at0, coalesce(list(pos ORDER BY pos) FILTER (f), []) AS must, coalesce(list({{'pos': pos, 'b': b}} ORDER BY pos DESC) FILTER (NOT f), []) AS rest FROM r GROUP BY doc_id),
  a AS (SELECT doc_id, total, CAST(floor(total / 8) AS BIGINT) AS ceiling, list_reduce(list_prepend({{'bytes': at0, 'kept': must, 'pos': 0::BIGINT, 'b': 0::BIGINT}}, list_transform(rest, lambda x: {{'bytes': 0::BIGINT, 'kept': []::BIGINT[], 'pos': x.pos, 'b': x.b}})), lambda p, q: CASE WHEN ceil((p.bytes + q.b) / 4.0) <= floor(total / 8) THEN {{'bytes': p.bytes + q.b, 'kept': list_append(p.kept, q.pos), 'pos': 0::BIGINT, 'b': 0::BIGINT}} ELSE p END) AS z FROM g)
  SELECT doc_id, array_to_string(list_sort(z.kept), ',') AS kept, z.bytes AS kept_bytes FROM a"""


@query("allocate", _ALLOC)
def _(s, d):
    scored = ranking.unit_scores(ranking.units(table(s, d, "documents")), "recency")
    out = ranking.allocate(scored, F.floor(F.col("total_bytes") / 8), ["@"])
    return out.select("doc_id", F.array_join(F.transform("kept", lambda x: x.cast("string")), ",").alias("kept"), "kept_bytes")


_TASK = """(SELECT doc_id, lang, doc_id % 3 AS ratio, text, substr(text, 1, CAST(length(text) * (doc_id % 3 + 1) / 3 AS BIGINT)) AS kept FROM documents)"""
_WS = "regexp_replace({}, '\\s+', '', 'g')"


@query("baseline_report", f"""SELECT lang AS selector, ratio, round(avg(CASE WHEN contains({_WS.format('kept')}, {_WS.format("substr(text, 1, 40)")}) THEN 1.0 ELSE 0.0 END), 4) AS mean_task_success, round(avg((CASE WHEN contains({_WS.format('kept')}, {_WS.format("substr(text, 5, 9)")}) THEN 0.5 ELSE 0 END) + (CASE WHEN contains({_WS.format('kept')}, {_WS.format("substr(text, 500, 9)")}) THEN 0.5 ELSE 0 END)), 4) AS mean_survival, count(*) FILTER (strlen(kept) * 2 > strlen(text)) AS over_budget_count FROM {_TASK} GROUP BY lang, ratio""")
def _(s, d):
    t = table(s, d, "documents").select("lang", (F.col("doc_id") % 3).alias("ratio"), "text", F.substring("text", F.lit(1), F.round(F.length("text") * (F.col("doc_id") % 3 + 1) / 3).cast("int")).alias("kept"))
    sc = ranking.task_score(F.col("kept"), F.array(F.substring("text", 5, 9), F.substring("text", 500, 9)), F.substring("text", 1, 40))
    rows = t.select(F.col("lang").alias("selector"), "ratio", sc.alias("s"), (F.octet_length("kept") / F.octet_length("text")).alias("achieved_ratio"), (F.octet_length("kept") * 2 > F.octet_length("text")).alias("over_budget")).select("*", "s.*")
    return ranking.baseline_report(rows).drop("mean_achieved_ratio")


# --- fidelity ----------------------------------------------------------------------------------

_FID = rf"""(SELECT doc_id, lang AS transform, CASE WHEN doc_id % 2 = 0 THEN 'general' ELSE 'search' END AS scope, CASE WHEN n = 0 THEN 1.0 ELSE len(list_intersect(a, b))::DOUBLE / n END AS quality, CASE WHEN contains(c, substr(text, 1, 5)) AND contains(c, substr(text, 40, 5)) THEN 1.0 ELSE 0.0 END AS survival, CASE WHEN length(text) = 0 THEN 0 ELSE 1 - length(c)::DOUBLE / length(text) END AS ratio
  FROM (SELECT doc_id, lang, text, c, list_distinct(list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '')) AS a, list_distinct(list_filter(regexp_split_to_array(c, '\s+'), lambda x: x <> '')) AS b, len(list_distinct(list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> ''))) AS n FROM (SELECT *, substr(text, 1, 20 + length(text) - (length(text) * (doc_id % 10)) // 10) AS c FROM documents)))"""
_FID2 = f"(SELECT *, CASE WHEN survival < 1 OR quality < 0.5 THEN 1.0 ELSE 0.0 END AS failure, CASE WHEN ratio >= 0 AND ratio < 0.4 THEN 'light' WHEN ratio >= 0.4 AND ratio < 0.6 THEN 'medium' ELSE 'heavy' END AS bucket FROM {_FID})"


def _fidelity(s, d):
    short = F.substring("text", F.lit(1), (20 + F.length("text") - F.floor(F.length("text") * (F.col("doc_id") % 10) / 10)).cast("int"))
    rows = table(s, d, "documents").select("doc_id", F.col("lang").alias("transform"), F.when(F.col("doc_id") % 2 == 0, "general").otherwise("search").alias("scope"), F.col("text").alias("original"), short.alias("compressed"), F.array(F.substring("text", 1, 5), F.substring("text", 40, 5)).alias("critical"))
    return fidelity.fidelity_rows(rows)


@query("fidelity_rows", f"SELECT doc_id, round(quality, 6) AS quality, survival, failure, bucket FROM {_FID2}")
def _(s, d):
    return _fidelity(s, d).select("doc_id", F.round("quality", 6).alias("quality"), "survival", "failure", "bucket")


@query("fidelity_gate", f"SELECT transform, scope, bucket, round(avg(quality), 6) AS quality, round(avg(failure), 6) AS failure, round(avg(survival), 6) AS survival, count(*) AS n, avg(quality) >= 0.95 AND avg(failure) <= 0.005 AND avg(survival) >= 0.99 AS passed FROM {_FID2} GROUP BY GROUPING SETS ((), (transform), (transform, scope), (transform, bucket))")
def _(s, d):
    g = fidelity.fidelity_gate(_fidelity(s, d))
    return g.select("transform", "scope", "bucket", *(F.round(c, 6).alias(c) for c in ("quality", "failure", "survival")), "n", "passed")


_LINE_DIFF = f"""WITH RECURSIVE turns AS (SELECT conv_id, turn, coalesce(text, '') AS t, lead(coalesce(text, '')) OVER w AS nxt, row_number() OVER w AS rn FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn, text)),
  pairs AS (SELECT row_number() OVER () AS id, conv_id, turn, {split_sql('t')} AS a, {split_sql("coalesce(nxt, '')")} AS b FROM turns WHERE nxt IS NOT NULL OR rn = 1),
  dp AS (SELECT id, a, b, CAST(len(a) AS BIGINT) AS i, [list_transform(range(len(b) + 1), lambda x: 0::BIGINT)] AS rows FROM pairs
    UNION ALL SELECT id, a, b, i - 1, list_append(rows, list_append(list_transform(range(1, len(b) + 1), lambda j: list_max(list_transform(range(j, len(b) + 1), lambda k: CASE WHEN a[i] = b[k] THEN rows[-1][k + 1] + 1 ELSE rows[-1][k] END))), 0::BIGINT)) FROM dp WHERE i > 0),
  best AS (SELECT id, a, b, rows, len(a) AS n, len(b) AS m FROM dp WHERE i = 0),
  path AS (SELECT id, 0::BIGINT AS i, 0::BIGINT AS j, -1::BIGINT AS pos, NULL::VARCHAR AS tag, NULL::VARCHAR AS line FROM best
    UNION ALL SELECT id, CASE WHEN tag = 'insert' THEN i ELSE i + 1 END, CASE WHEN tag = 'delete' THEN j ELSE j + 1 END, pos + 1, tag, CASE WHEN tag = 'insert' THEN b[j + 1] ELSE a[i + 1] END
      FROM (SELECT p.id, i, j, pos, a, b, CASE WHEN i < n AND j < m AND a[i + 1] = b[j + 1] THEN 'equal' WHEN i < n AND (j = m OR rows[n - i][j + 1] >= rows[n - i + 1][j + 2]) THEN 'delete' ELSE 'insert' END AS tag FROM path p JOIN best USING (id) WHERE i < n OR j < m))
  SELECT conv_id, CAST(turn AS BIGINT) AS turn, CAST(pos AS INTEGER) AS pos, tag, line FROM path JOIN pairs USING (id) WHERE tag IS NOT NULL"""


@query("line_diff", _LINE_DIFF)
def _(s, d):
    return turn_diffs(table(s, d, "conversations"))


def turn_diffs(turns: DataFrame) -> DataFrame:
    """conv_id, turn and the diff lines of each turn to the next of its conversation; a single turn is diffed with nothing."""
    w = Window.partitionBy("conv_id").orderBy("turn", "text")
    text = F.coalesce("text", F.lit(""))
    pairs = turns.select("conv_id", "turn", text.alias("before"), F.lead(text).over(w).alias("after"), F.row_number().over(w).alias("at"))
    return line_diffs(pairs.where("after is not null or at = 1").withColumn("after", F.coalesce("after", F.lit(""))), "conv_id", "turn")
