"""Queries over texts: documents, benchmark, pages and JSON of events."""
from __future__ import annotations

from pyspark.sql import functions as F

from auditframe.functions import text as X
from auditframe.functions.canon import id_to_path, normal_text, path_to_id, template_to_family, url_host
from auditframe.operators import leak as L
from auditframe.plans.registry import query, sql_view, tree_sql
from auditframe.plans.strategy import k_of, load


def docs(spark, sf, *columns):
    return load(spark, sf, "documents", *columns)


def shingle_sql(table, key, width, pattern, keep_short):
    """Distinct (key, shingle) rows of a table."""
    full = f"""SELECT DISTINCT key, s AS shingle FROM (SELECT key, string_agg(w, ' ') OVER win AS s, count(*) OVER win AS n FROM t
      WINDOW win AS (PARTITION BY key ORDER BY i ROWS BETWEEN CURRENT ROW AND {width - 1} FOLLOWING)) WHERE n = {width}"""
    short = f" UNION ALL SELECT key, string_agg(w, ' ' ORDER BY i) FROM t GROUP BY key HAVING count(*) < {width}" if keep_short else ""
    quoted = pattern.replace("'", "''")
    return f"""WITH w AS (SELECT {key} AS key, regexp_extract_all(lower(text), '{quoted}') AS ws FROM {table}),
      t AS (SELECT key, unnest(ws) AS w, unnest(range(len(ws))) AS i FROM w) {full}{short}"""


for _name, _table, _key in (("docs", "documents", "doc_id"), ("bench", "benchmark", "item_id")):
    sql_view(f"v_sh13_{_name}", shingle_sql(_table, _key, 13, X.WORD, True))
    sql_view(f"v_sh10_{_name}", shingle_sql(_table, _key, 10, X.WORD_OR_APOSTROPHE, False))


sql_view("v_sealed_tree", tree_sql("SELECT DISTINCT sha256(shingle) AS name FROM v_sh13_bench", levels=L.COMMITMENT_LEVELS, with_value=False))


@query(
    "contamination",
    """SELECT count(*) FILTER (s) AS sealed_shingles, count(*) FILTER (c) AS candidate_shingles, count(*) FILTER (s AND c) AS overlap_shingles,
  (SELECT root FROM v_sealed_tree) AS sealed_commitment,
  round_even(count(*) FILTER (s AND c) / greatest(1, count(*) FILTER (s)), 6) AS overlap_ratio,
  CASE WHEN count(*) FILTER (s AND c) = 0 THEN 'PASS' ELSE 'FAIL' END AS status
FROM (SELECT shingle, bool_or(c) AS c, bool_or(NOT c) AS s FROM (SELECT shingle, true AS c FROM v_sh13_docs UNION ALL SELECT shingle, false FROM v_sh13_bench) GROUP BY shingle)""",
)
def contamination(spark, sf):
    sealed = load(spark, sf, "benchmark", F.col("item_id").alias("doc_id"), "text")
    return L.contamination(docs(spark, sf, "doc_id", "text"), sealed, "doc_id", "text")


@query(
    "source_overlap",
    """SELECT key AS doc_id, count(*) AS overlapping_shingles, substr(sha256(min(shingle)), 1, 16) AS example_hash
FROM v_sh10_docs WHERE shingle IN (SELECT shingle FROM v_sh10_bench) GROUP BY key""",
)
def source_overlap(spark, sf):
    return L.source_overlap(docs(spark, sf, "doc_id", "text"), "doc_id", "text", load(spark, sf, "benchmark", "item_id", "text"), "item_id")


PLANTED = r'token = "[0-9a-f]{40}"'
PATTERNS = {**{f"p{i}": p for i, p in enumerate(L.SECRET_PATTERNS)}, "planted": PLANTED}


@query(
    "secret_scan",
    " UNION ALL ".join(f"SELECT doc_id, '{name}' AS pattern FROM documents WHERE regexp_matches(text, '{p}')" for name, p in PATTERNS.items()),
)
def secret_scan(spark, sf):
    return L.pattern_hits(docs(spark, sf, "doc_id", "text"), "doc_id", "text", PATTERNS)


MACHINE = {"attribute": r'href="/[A-Za-z]+"', "query": r"utm_source=[a-z]+"}


@query(
    "internal_identifiers",
    """SELECT DISTINCT page_id, pattern, match FROM (SELECT page_id, 'attribute' AS pattern, unnest(regexp_extract_all(html, 'href="/[A-Za-z]+"')) AS match FROM pages
  UNION ALL SELECT page_id, 'query', unnest(regexp_extract_all(html, 'utm_source=[a-z]+')) FROM pages)""",
)
def internal_identifiers(spark, sf):
    return L.pattern_matches(load(spark, sf, "pages", "page_id", "html"), "page_id", "html", MACHINE)


@query(
    "internal_identifiers_first50",
    """SELECT DISTINCT page_id, pattern, match FROM (SELECT page_id, 'attribute' AS pattern, unnest(regexp_extract_all(html, 'href="/[A-Za-z]+"')) AS match FROM pages
  UNION ALL SELECT page_id, 'query', unnest(regexp_extract_all(html, 'utm_source=[a-z]+')) FROM pages) ORDER BY page_id, pattern, match LIMIT 50""",
)
def internal_identifiers_first50(spark, sf):
    hits = L.pattern_matches(load(spark, sf, "pages", "page_id", "html"), "page_id", "html", MACHINE)
    return L.first_hits(hits, 50)


SHAPE = "[A-Z][a-z]{7,}"


@query(
    "identifier_leak",
    f"""SELECT DISTINCT doc_id, needle FROM (SELECT doc_id, unnest(regexp_extract_all(text, '{SHAPE}')) AS needle FROM documents)
WHERE needle IN (SELECT unnest(regexp_extract_all(text, '{SHAPE}')) FROM benchmark)""",
)
def identifier_leak(spark, sf):
    b = load(spark, sf, "benchmark", "text")
    needles = b.select(F.explode(F.regexp_extract_all("text", F.lit(f"({SHAPE})"), F.lit(1))).alias("needle"))
    return L.shaped_leaks(docs(spark, sf, "doc_id", "text"), "doc_id", "text", needles, SHAPE)


@query(
    "substring_leak",
    """SELECT DISTINCT doc_id, needle FROM documents d, (SELECT DISTINCT text AS needle FROM benchmark) WHERE needle <> '' AND contains(d.text, needle)""",
)
def substring_leak(spark, sf):
    needles = load(spark, sf, "benchmark", "text").select(F.col("text").alias("needle"))
    return L.substring_leaks(docs(spark, sf, "doc_id", "text"), "doc_id", "text", needles)


def files(spark, sf, *columns):
    path = F.concat(F.when(F.col("doc_id") % 97 == 0, "Oracle/").otherwise(""), F.col("source"), F.lit("/"), F.col("doc_id"))
    return docs(spark, sf, "doc_id", "source", "text").select(path.alias("path"), "text", *columns)


sql_view("v_files", "SELECT CASE WHEN doc_id % 97 = 0 THEN 'Oracle/' ELSE '' END || source || '/' || doc_id AS path, text, doc_id, source FROM documents")
sql_view(
    "v_gold_leaks",
    """SELECT path, 'matches evaluator-only naming' AS reason FROM v_files WHERE regexp_matches(path, '(?i)oracle|private[-_]gold')
UNION ALL SELECT path, 'embeds gold content' FROM v_files f WHERE EXISTS (SELECT 1 FROM benchmark b WHERE len([i FOR i IN range(1, greatest(length(b.text) - 59, 1) + 1) IF contains(f.text, substr(b.text, i, 60))]) > 0)""",
)


@query("gold_leak", "SELECT * FROM v_gold_leaks")
def gold_leak(spark, sf):
    gold = load(spark, sf, "benchmark", F.col("text").alias("record"))
    return L.gold_leaks(files(spark, sf), "path", "text", gold)


WORDS = ("Ingerest", "quality", "FÜR", "hand")


@query(
    "content_safety",
    " UNION ALL ".join(f"SELECT doc_id, '{w}' AS word FROM documents WHERE contains(lower(text), lower('{w}'))" for w in WORDS),
)
def content_safety(spark, sf):
    return L.forbidden_words(docs(spark, sf, "doc_id", "text"), "doc_id", "text", WORDS)


@query(
    "path_rules",
    """SELECT path, unnest(list_filter([CASE WHEN doc_id % 53 = 0 OR doc_id % 59 = 0 THEN 'unsafe path' END, CASE WHEN doc_id % 61 = 0 THEN 'link entry' END,
  CASE WHEN lang = 'de' THEN 'identity-bearing ownership metadata' END], lambda x: x IS NOT NULL)) AS reason FROM (
  SELECT CASE WHEN doc_id % 53 = 0 THEN '/' WHEN doc_id % 59 = 0 THEN 'a/../' ELSE '' END || source || '/' || doc_id AS path, doc_id, lang FROM documents)""",
)
def path_rules(spark, sf):
    d = load(spark, sf, "documents", "doc_id", "source", "lang")
    prefix = F.when(F.col("doc_id") % 53 == 0, "/").when(F.col("doc_id") % 59 == 0, "a/../").otherwise("")
    entries = d.select(
        F.concat(prefix, "source", F.lit("/"), "doc_id").alias("path"), (F.col("doc_id") % 61 == 0).alias("is_link"),
        F.when(F.col("lang") == "de", "builder").otherwise("").alias("owner"),
    )
    return L.path_problems(entries, "path")


@query(
    "forbidden_keys",
    "SELECT event_id, k % 13 = 0 OR k % 17 = 0 AS any_depth, k % 17 = 0 AS top_level FROM v_ev WHERE k % 13 = 0 OR k % 17 = 0",
)
def forbidden_keys(spark, sf):
    e = load(spark, sf, "events", "event_id", "event_type", "props").withColumn("k", k_of(F.col("props")))
    k = F.col("k")
    inner = F.struct(F.col("event_type").alias("action"), F.when(k % 13 == 0, k).alias("final_state"))
    body = F.to_json(F.struct(F.col("event_id").alias("id"), inner.alias("request"), F.when(k % 17 == 0, k).alias("mutations")))
    d = e.select("event_id", body.alias("json"))
    return d.select(
        "event_id", L.has_forbidden_key(F.col("json"), L.FORBIDDEN_OUTPUT_KEYS).alias("any_depth"),
        L.has_forbidden_top_key(F.col("json"), L.FORBIDDEN_OUTPUT_KEYS).alias("top_level"),
    ).where("any_depth")


@query("safe_projection", "SELECT o_orderkey, o_orderstatus, o_orderpriority FROM orders")
def safe_projection(spark, sf):
    return L.safe_projection(load(spark, sf, "orders"), ["o_orderkey", "o_orderstatus", "o_orderpriority"], ["o_totalprice", "final_state"])


@query("canary_echo", "SELECT event_id, user_id % 3 AS run_id, user_id AS episode_id FROM v_ev WHERE k % 50 = 0")
def canary_echo(spark, sf):
    """Responses hold the canary of their own episode where k % 50 = 0, that of another one where k % 50 = 1."""
    e = load(spark, sf, "events", "event_id", "user_id", "event_type", "props").withColumn("k", k_of(F.col("props")))
    episodes = L.with_canary(
        e.select((F.col("user_id") % 3).alias("run_id"), F.col("user_id").alias("episode_id")).distinct(),
        F.concat(F.lit("salt"), F.col("run_id")), F.col("episode_id"),
    )
    told = e.where("k % 50 < 2").withColumn("told_id", F.when(F.col("k") % 50 == 0, F.col("user_id")).otherwise(F.col("user_id") + 1))
    canaries = episodes.select(F.col("episode_id").alias("told_id"), F.col("canary").alias("_told"))
    echoed = told.join(canaries, "told_id", "left").select("event_id", F.concat_ws(" ", "event_type", "_told").alias("_text"))
    responses = e.join(echoed, "event_id", "left").select(
        "event_id", (F.col("user_id") % 3).alias("run_id"), F.col("user_id").alias("episode_id"), F.coalesce("_text", "event_type").alias("text")
    )
    return L.canary_echoes(responses, episodes, ["run_id", "episode_id"]).select("event_id", "run_id", "episode_id")


# --- scalar text functions ---------------------------------------------------------
@query(
    "reply_parse",
    """SELECT conv_id, turn, CASE WHEN turn = 7 THEN 'response_token_limit' WHEN role = 'system' THEN 'invalid_response'
  WHEN (conv_id + turn) % 5 = 0 THEN 'invalid_json' END AS reason, NOT (turn = 7 OR role = 'system' OR (conv_id + turn) % 5 = 0) AS has_json FROM conversations""",
)
def reply_parse(spark, sf):
    """Replies built from turns: plain, fenced, with a broken brace, or missing."""
    c = load(spark, sf, "conversations", "conv_id", "turn", "role", "text")
    mark = F.col("conv_id") + F.col("turn")
    json = F.to_json(F.struct(F.lit("assess").alias("tool"), F.struct("text").alias("args")))
    body = (
        F.when(F.col("role") == "system", None).when(mark % 5 == 0, F.concat(json, F.lit("}{")))
        .when(mark % 3 == 0, F.concat(F.lit("```json\n"), json, F.lit("\n```"))).otherwise(F.concat(F.lit("  "), json))
    )
    parsed = X.parse_reply(body, F.when(F.col("turn") == 7, "length").otherwise("stop"))
    return c.select("conv_id", "turn", parsed.alias("p")).select("conv_id", "turn", "p.reason", F.col("p.json").isNotNull().alias("has_json"))


@query(
    "text_normalise",
    r"""SELECT doc_id, sha256(trim(regexp_replace(text, '\s+', ' ', 'g'))) AS digest, len(regexp_extract_all(lower(text), '[a-z0-9]+')) AS tokens FROM documents""",
)
def text_normalise(spark, sf):
    d = docs(spark, sf, "doc_id", "text")
    return d.select("doc_id", F.sha2(normal_text(F.col("text")), 256).alias("digest"), F.size(X.tokens(F.col("text"))).cast("long").alias("tokens"))


@query("url_host", "SELECT page_id, lower(regexp_extract(url, '^[a-z]+://([^/?#:]+)', 1)) AS host FROM pages")
def hosts(spark, sf):
    return load(spark, sf, "pages", "page_id", "url").select("page_id", url_host(F.col("url")).alias("host"))


@query(
    "id_path",
    """SELECT doc_id, CASE WHEN lang <> 'de' THEN 'episodes_v2/' || lang || '_' || doc_id || '.v1.json' END AS path,
  CASE WHEN lang <> 'de' THEN 'episode_' || lang || '_' || doc_id || '_v1' END AS back, source AS family FROM documents""",
)
def id_path(spark, sf):
    d = load(spark, sf, "documents", "doc_id", "lang", "source")
    prefix = F.when(F.col("lang") == "de", "task_").otherwise("episode_")
    name = F.concat(prefix, "lang", F.lit("_"), "doc_id", F.lit("_v1"))
    path = id_to_path(name)
    return d.select(
        "doc_id", path.alias("path"), path_to_id(path).alias("back"),
        template_to_family(F.concat(F.lit("eval_"), F.col("source"), F.lit("_r2"))).alias("family"),
    )
