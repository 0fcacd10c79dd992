"""Registered queries over the driver tables, each with its SQL.

``conversations`` stand in for sessions with messages, ``documents`` for a
corpus by provider (``source``), ``events`` for tool calls and results,
``pages`` for sessions with a working directory (the path of the URL).
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable
from datetime import date

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions import coerce, text
from tidemark.operators import assemble, collect, evaluate, filters, index, postings, reduction, relations, scratch, search, stats, views, workflow
from tidemark.operators.search import TextQuery

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return keep


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("provider"), F.coalesce(F.substring("text", 1, 60), F.lit("")).alias("title"), F.coalesce("text", F.lit("")).alias("content"))


_CORPUS = "corpus AS (SELECT doc_id, source AS provider, coalesce(substring(text, 1, 60), '') AS title, coalesce(text, '') AS content FROM documents)"
_PATH = "regexp_extract(url, '^[a-z]+://[^/]+([^?#]*)', 1)"


def _path() -> F.Column:
    return F.regexp_extract("url", "^[a-z]+://[^/]+([^?#]*)", 1)


# --- search -----------------------------------------------------------------------


@_query("SELECT conv_id, turn FROM conversations WHERE regexp_matches(text, 'the', 'i')")
def kw_filter(spark, d):
    return _t(spark, d, "conversations").filter(TextQuery.phrase("the").matches(F.col("text"))).select("conv_id", "turn")


@_query("SELECT conv_id, turn FROM conversations WHERE regexp_matches(text, 'of the', 'i')")
def kw_phrase(spark, d):
    return _t(spark, d, "conversations").filter(TextQuery.phrase("  of   the ").matches(F.col("text"))).select("conv_id", "turn")


@_query("SELECT conv_id, turn FROM conversations WHERE regexp_matches(text, 'the', 'i') AND regexp_matches(text, 'and', 'i')")
def search_terms_all(spark, d):
    return _t(spark, d, "conversations").filter(TextQuery.terms("the and the").matches(F.col("text"))).select("conv_id", "turn")


@_query("SELECT doc_id FROM documents WHERE (regexp_matches(source, 'src1', 'i') OR regexp_matches(text, 'src1', 'i')) AND (regexp_matches(source, 'en', 'i') OR regexp_matches(text, 'en', 'i'))")
def search_terms_cross_field(spark, d):
    return _t(spark, d, "documents").filter(TextQuery.terms("src1 en").matches(F.col("source"), F.col("text"))).select("doc_id")


@_query(f"WITH {_CORPUS} SELECT doc_id, CASE WHEN regexp_matches(title, 'the', 'i') AND regexp_matches(title, 'ing', 'i') THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS rank FROM corpus WHERE (regexp_matches(title, 'the', 'i') OR regexp_matches(content, 'the', 'i')) AND (regexp_matches(title, 'ing', 'i') OR regexp_matches(content, 'ing', 'i')) ORDER BY rank DESC, doc_id DESC LIMIT 20")
def search_literal_rank_topk(spark, d):
    found = search.literal_rank(_corpus(spark, d), TextQuery.terms("the ing"))
    return search.top(found.select("doc_id", "rank"), 20, F.desc("rank"), F.desc("doc_id"))


def _sessions(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Conversations as sessions of four providers in five folders, and their messages."""
    turns = _t(spark, sf_dir, "conversations")
    provider = F.element_at(F.array(*map(F.lit, ("codex", "claudecode", "kimi", "pi"))), (F.col("conv_id") % 4 + 1).cast("int"))
    rows = turns.groupBy("conv_id").agg(F.min(F.when(F.col("turn") == 0, F.col("text"))).alias("t0"))
    sessions = rows.select(
        provider.alias("provider"), F.col("conv_id").cast("string").alias("session_id"), F.coalesce(F.substring("t0", 1, 60), F.lit("")).alias("title"), F.concat(F.lit("/w/p"), F.col("conv_id") % 5).alias("working_directory"),
        (F.col("conv_id") * 7 % 13).alias("updated_at"), (F.col("conv_id") % 3).alias("created_at"))
    return sessions, turns.select(provider.alias("provider"), F.col("conv_id").cast("string").alias("session_id"), F.col("turn").alias("seq"), "role", "text")


_SESSIONS = """
s AS (SELECT conv_id, ['codex', 'claudecode', 'kimi', 'pi'][conv_id % 4 + 1] AS provider, conv_id::VARCHAR AS session_id, coalesce(substring(min(text) FILTER (turn = 0), 1, 60), '') AS title,
  '/w/p' || conv_id % 5 AS working_directory, conv_id * 7 % 13 AS updated_at, conv_id % 3 AS created_at, string_agg(trim(text), chr(10) || chr(10) ORDER BY turn) FILTER (trim(text) <> '') AS content FROM conversations GROUP BY conv_id)"""
_LATEST = "updated_at DESC, created_at DESC, provider, session_id"
_BM25 = f"""{_SESSIONS},
w AS (SELECT *, (greatest(length(title) - 2, 0) + greatest(length(content) - 2, 0))::DOUBLE AS len,
  ((length(title) - length(replace(lower(title), 'that', '')) + length(content) - length(replace(lower(content), 'that', ''))) / 4)::DOUBLE AS a,
  ((length(title) - length(replace(lower(title), 'from', '')) + length(content) - length(replace(lower(content), 'from', ''))) / 4)::DOUBLE AS b FROM s WHERE content IS NOT NULL),
g AS (SELECT count(*)::DOUBLE AS n, avg(len) AS al, (count(*) FILTER (a > 0))::DOUBLE AS da, (count(*) FILTER (b > 0))::DOUBLE AS db FROM w),
r AS (SELECT w.*, round(greatest(ln((n - da + 0.5) / (da + 0.5)), 1e-6) * a * 2.2 / (a + 1.2 * (0.25 + 0.75 * len / al)) + greatest(ln((n - db + 0.5) / (db + 0.5)), 1e-6) * b * 2.2 / (b + 1.2 * (0.25 + 0.75 * len / al)), 6) AS rank
  FROM w, g WHERE a > 0 AND b > 0)"""


def _searched(spark: SparkSession, sf_dir: str) -> DataFrame:
    sessions, messages = _sessions(spark, sf_dir)
    return sessions.join(views.corpus(messages), search.KEY)


@_query(f"WITH {_BM25} SELECT provider, session_id, rank FROM r ORDER BY rank DESC, {_LATEST} LIMIT 20")
def search_bm25_topk(spark, d):
    return search.search(_searched(spark, d), TextQuery.terms("that from"), limit=20).select("provider", "session_id", "rank")


@_query(f"WITH {_BM25} SELECT provider, session_id, rank FROM r WHERE provider IN ('codex', 'pi') ORDER BY rank DESC, {_LATEST} LIMIT 7")
def search_scoped_topk(spark, d):
    corpus = _searched(spark, d)
    return search.search(corpus, TextQuery.terms("that from"), corpus.filter("provider in ('codex', 'pi')"), 7).select("provider", "session_id", "rank")


@_query(f"WITH {_BM25} SELECT provider, session_id, rank FROM r")
def search_indexed(spark, d):
    corpus = _searched(spark, d)
    return search.indexed(corpus, search.gram_table(corpus), search.size_table(corpus), TextQuery.terms("that from")).select("provider", "session_id", "rank")


@_query(f"WITH {_SESSIONS} SELECT provider, session_id, CASE WHEN contains(lower(title), 'qu') THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS rank FROM s WHERE contains(lower(title), 'qu') OR contains(lower(content), 'qu')")
def search_indexed_short(spark, d):
    """A literal without a trigram: ranked by the title, from the kept texts."""
    corpus = _searched(spark, d)
    kept = postings.refresh(spark, scratch.place(spark, "index"), corpus.withColumn("signature", F.lit("1")), corpus, F.current_timestamp())
    return postings.search(kept, TextQuery.terms("qu")).select("provider", "session_id", "rank")


# a second scan finds two thirds of the sessions changed: their whole texts count, of the others the first two turns
_CHANGED = "string_agg(trim(text), chr(10) || chr(10) ORDER BY turn) FILTER (trim(text) <> '' AND (conv_id % 3 <> 0 OR turn < 2)) AS content"
_WHOLE = "string_agg(trim(text), chr(10) || chr(10) ORDER BY turn) FILTER (trim(text) <> '') AS content"


@_query(f"WITH {_BM25.replace(_WHOLE, _CHANGED)} SELECT provider, session_id, rank FROM r")
def search_after_refresh(spark, d):
    sessions, messages = _sessions(spark, d)
    root, now = scratch.place(spark, "index"), F.current_timestamp()
    before = views.corpus(messages.filter("seq < 2"))
    postings.refresh(spark, root, sessions.withColumn("signature", F.lit("1")), before, now)
    changed = sessions.withColumn("signature", F.when(F.col("session_id").cast("long") % 3 != 0, "2").otherwise("1"))
    kept = postings.refresh(spark, root, changed, views.corpus(messages), now)
    return postings.search(kept, TextQuery.terms("that from")).select("provider", "session_id", "rank")


# letters read as CJK characters, so that every text has words of one character
_LETTERS, _SIGNS = "abcdefghijklmnopqrstuvwxyz", "甲乙丙丁戊己庚辛壬癸子丑寅卯辰巳午未申酉戌亥天地玄黄"
_SIGNED = f"translate(regexp_replace(lower({{}}), '[^a-z]', ' ', 'g'), '{_LETTERS}', '{_SIGNS}')"
_TH, _IN = (f"{_SIGNS[_LETTERS.index(a)]}{_SIGNS[_LETTERS.index(b)]}" for a, b in ("th", "in"))


def _phrases(x: str) -> str:
    """SQL: how often two characters are neighbours in title or content, apart from spaces."""
    return "+".join(f"(length(replace({f}, ' ', '')) - length(replace(replace({f}, ' ', ''), '{x}', ''))) / 2" for f in ("title", "content"))


@_query(f"""
WITH t AS (SELECT doc_id, coalesce(source, '') AS provider, {_SIGNED.format("coalesce(substring(text, 1, 60), '')")} AS title, {_SIGNED.format("coalesce(text, '')")} AS content FROM documents),
w AS (SELECT *, (length(replace(title, ' ', '')) + length(replace(content, ' ', '')))::DOUBLE AS len, ({_phrases(_TH)})::DOUBLE AS a, ({_phrases(_IN)})::DOUBLE AS b FROM t),
g AS (SELECT count(*)::DOUBLE AS n, avg(len) AS al, (count(*) FILTER (a > 0))::DOUBLE AS da, (count(*) FILTER (b > 0))::DOUBLE AS db FROM w)
SELECT doc_id, round(greatest(ln((n - da + 0.5) / (da + 0.5)), 1e-6) * a * 2.2 / (a + 1.2 * (0.25 + 0.75 * len / al)) + greatest(ln((n - db + 0.5) / (db + 0.5)), 1e-6) * b * 2.2 / (b + 1.2 * (0.25 + 0.75 * len / al)), 6) AS rank
FROM w, g WHERE a > 0 AND b > 0 AND (contains(title, '{_TH}') OR contains(content, '{_TH}')) AND (contains(title, '{_IN}') OR contains(content, '{_IN}'))""")
def search_cjk(spark, d):
    signed = lambda c: F.translate(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), "[^a-z]", " "), _LETTERS, _SIGNS)
    corpus = _t(spark, d, "documents").select(
        F.coalesce("source", F.lit("")).alias("provider"), F.col("doc_id").cast("string").alias("session_id"), signed(F.substring("text", 1, 60)).alias("title"), signed(F.col("text")).alias("content"),
        F.lit("1").alias("signature"), F.col("doc_id").alias("updated_at"), F.col("doc_id").alias("created_at"))
    kept = postings.refresh(spark, scratch.place(spark, "index"), corpus, corpus, F.current_timestamp())
    return postings.search(kept, TextQuery.terms(f"{_TH} {_IN}")).select(F.col("session_id").cast("long").alias("doc_id"), "rank")


@_query(f"""WITH {_SESSIONS}, k AS (SELECT *, CASE WHEN conv_id % 2 = 0 THEN coalesce(content, '') ELSE '' END AS said FROM s)
SELECT provider, session_id, CASE WHEN contains(lower(title), 'de la') THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS rank FROM k WHERE contains(lower(title), 'de la') OR contains(lower(said), 'de la')""")
def query_title_only(spark, d):
    """Half of the sessions have no message: their titles are searched all the same."""
    sessions, messages = _sessions(spark, d)
    return evaluate.matches(filters.QuerySpec(keyword="de la"), sessions, messages.filter("cast(session_id as long) % 2 = 0")).select("provider", "session_id", "rank")


@_query(f"""WITH {_SESSIONS} SELECT provider, session_id, CASE WHEN contains(lower(title), 'de la') THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS rank FROM s
WHERE provider IN ('codex', 'claudecode', 'kimi') AND working_directory IN ('/w/p1') AND (contains(lower(title), 'de la') OR contains(lower(content), 'de la'))""")
def query_keyword(spark, d):
    spec = filters.parse_uri("agents://w/p1?q=de%20la&providers=codex,claude,kimi")
    return evaluate.matches(spec, *_sessions(spark, d)).select("provider", "session_id", "rank")


@_query(f"""WITH {_SESSIONS}, e AS (SELECT conv_id, arg_min(role, turn) AS matched_role FROM conversations WHERE role IN ('assistant', 'system') AND contains(lower(text), 'que') GROUP BY conv_id)
SELECT provider, session_id, matched_role FROM s JOIN e USING (conv_id) ORDER BY {_LATEST} LIMIT 5""")
def query_roles(spark, d):
    spec = filters.parse_query("que role:assistant,system path:/w limit:5")
    return evaluate.matches(spec, *_sessions(spark, d)).select("provider", "session_id", "matched_role")


@_query(f"WITH {_SESSIONS} SELECT provider, session_id, title AS snippet FROM s WHERE provider = 'pi' ORDER BY {_LATEST} LIMIT 9")
def query_all(spark, d):
    return evaluate.matches(filters.QuerySpec(providers=("pi",), limit=9), *_sessions(spark, d)).select("provider", "session_id", "snippet")


@_query(f"WITH {_SESSIONS} SELECT provider, session_id FROM s QUALIFY row_number() OVER (PARTITION BY provider ORDER BY {_LATEST}) <= 3")
def source_topk(spark, d):
    return evaluate.per_source(_sessions(spark, d)[0], 3).select("provider", "session_id")


@_query(f"WITH {_SESSIONS} SELECT provider, session_id, title FROM s WHERE provider = 'codex' AND session_id = '4'")
def uri_lookup(spark, d):
    return evaluate.find_uri(_sessions(spark, d)[0], "codex://threads/4").select("provider", "session_id", "title")


@_query("""
WITH p AS (SELECT conv_id, turn, text, length(regexp_extract(text, '(?is)^(.*?)and', 1)) AS p FROM conversations WHERE regexp_matches(text, 'and', 'i')),
q AS (SELECT *, greatest(p - 48, 0) AS s, least(p + 51, length(text)) AS e FROM p)
SELECT conv_id, turn, (CASE WHEN s > 0 THEN '...' ELSE '' END) || substring(text, s + 1, p - s) || '**' || substring(text, p + 1, 3) || '**' || substring(text, p + 4, e - p - 3) || (CASE WHEN e < length(text) THEN '...' ELSE '' END) AS snippet FROM q""")
def snippet(spark, d):
    return _t(spark, d, "conversations").filter(text.has_literal(F.col("text"), "and")).select("conv_id", "turn", text.snippet(F.col("text"), "and").alias("snippet"))


@_query("WITH c AS (SELECT conv_id, turn, trim(regexp_replace(text, '[\\s\\x0b\\x1c-\\x1f]+', ' ', 'g')) AS t FROM conversations) SELECT conv_id, turn, CASE WHEN length(t) <= 96 THEN t ELSE rtrim(substring(t, 1, 96)) || '...' END AS excerpt FROM c")
def excerpt(spark, d):
    return _t(spark, d, "conversations").select("conv_id", "turn", text.excerpt(F.col("text")).alias("excerpt"))


# --- filters ----------------------------------------------------------------------


@_query("SELECT conv_id, arg_min(role, turn) AS role, min(turn) AS turn FROM conversations WHERE regexp_matches(text, 'en', 'i') AND lower(role) IN ('user', 'assistant') GROUP BY conv_id")
def role_evidence(spark, d):
    return filters.role_evidence(_t(spark, d, "conversations"), "conv_id", "turn", TextQuery.phrase("en"), ["user", "assistant"])


@_query("SELECT conv_id, count(*) AS messages FROM conversations WHERE lower(role) = 'user' GROUP BY conv_id")
def role_only(spark, d):
    return _t(spark, d, "conversations").filter(F.lower("role") == "user").groupBy("conv_id").agg(F.count(F.lit(1)).alias("messages"))


@_query("SELECT doc_id, source FROM documents WHERE source IN ('src1', 'src3')")
def provider_scope(spark, d):
    return _t(spark, d, "documents").filter(F.col("source").isin("src1", "src3")).select("doc_id", "source")


@_query(f"SELECT page_id, path FROM (SELECT page_id, {_PATH} AS path FROM pages) WHERE path = '/en' OR starts_with(path, '/en/')")
def path_scope(spark, d):
    return _t(spark, d, "pages").select("page_id", _path().alias("path")).filter(filters.path_scope(F.col("path"), "/en"))


@_query(f"SELECT page_id FROM (SELECT page_id, {_PATH} AS path FROM pages) WHERE NOT (path = '/blog' OR starts_with(path, '/blog/') OR path = '/news' OR starts_with(path, '/news/'))")
def path_deny(spark, d):
    return _t(spark, d, "pages").select("page_id", _path().alias("path")).filter(~filters.denied(F.col("path"), ["/blog", "/news"])).select("page_id")


@_query("SELECT event_id FROM events WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 7 DAY")
def time_window(spark, d):
    events = _t(spark, d, "events")
    now = events.agg(F.max("ts").alias("now"))
    return events.join(F.broadcast(now), filters.recent(events["ts"], now["now"], 7)).select("event_id")


@_query("SELECT event_id FROM events WHERE ts::DATE BETWEEN DATE '2024-01-05' AND DATE '2024-01-09'")
def date_range(spark, d):
    return _t(spark, d, "events").filter(F.to_date("ts").between("2024-01-05", "2024-01-09")).select("event_id")


@_query("SELECT conv_id, turn FROM conversations WHERE NOT (role = 'developer' OR (role = 'user' AND (contains(lower(text), 'agents.md instructions for') OR contains(lower(text), '<environment_context>'))))")
def injected_filter(spark, d):
    return _t(spark, d, "conversations").filter(filters.not_injected(F.col("role"), F.col("text"))).select("conv_id", "turn")


@_query("SELECT event_id, user_id, epoch_us(ts) AS us FROM events ORDER BY ts DESC, user_id, event_id LIMIT 20")
def recency_topk(spark, d):
    return search.top(_t(spark, d, "events").select("event_id", "user_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("us")), 20, F.desc("us"), F.asc("user_id"), F.asc("event_id"))


@_query("SELECT lang AS provider, doc_id AS id FROM documents WHERE lang = 'en' UNION ALL SELECT lang, doc_id FROM documents WHERE lang = 'de'")
def union_providers(spark, d):
    docs = _t(spark, d, "documents").select(F.col("lang").alias("provider"), F.col("doc_id").alias("id"))
    return docs.filter("provider = 'en'").unionByName(docs.filter("provider = 'de'"))


@_query("SELECT page_id, regexp_extract(url, '^([a-z]+)://', 1) AS scheme, regexp_extract(url, '^[a-z]+://(.*)$', 1) AS id FROM pages")
def uri_parse(spark, d):
    return _t(spark, d, "pages").select("page_id", F.regexp_extract("url", "^([a-z]+)://", 1).alias("scheme"), F.regexp_extract("url", "^[a-z]+://(.*)$", 1).alias("id"))


# --- projections --------------------------------------------------------------------


@_query("SELECT conv_id, string_agg(trim(text), chr(10) || chr(10) ORDER BY turn) AS corpus FROM conversations WHERE trim(text) <> '' GROUP BY conv_id")
def corpus_build(spark, d):
    return views.corpus(_t(spark, d, "conversations").withColumnRenamed("turn", "seq"), "conv_id").withColumnRenamed("content", "corpus")


@_query("SELECT doc_id, coalesce(nullif(substring(trim(regexp_replace(CASE WHEN doc_id % 3 = 0 THEN NULL ELSE text END, '[\\s\\x0b\\x1c-\\x1f]+', ' ', 'g')), 1, 100), ''), source, 'Untitled Session') AS title FROM documents")
def title_fallback(spark, d):
    return _t(spark, d, "documents").select("doc_id", text.title(F.when(F.col("doc_id") % 3 != 0, F.col("text")), F.col("source")).alias("title"))


@_query("SELECT conv_id, arg_min(text, turn) AS title FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS r FROM conversations WHERE role = 'user') WHERE r >= 2 GROUP BY conv_id")
def nth_user_title(spark, d):
    users = _t(spark, d, "conversations").filter("role = 'user'").withColumn("r", F.row_number().over(Window.partitionBy("conv_id").orderBy("turn")))
    return users.filter("r >= 2").groupBy("conv_id").agg(F.min_by("text", "turn").alias("title"))


@_query("SELECT doc_id, CASE WHEN length(text) > 60 THEN substring(text, 1, 60) || '...' ELSE text END AS title, coalesce(source, '-') AS cwd FROM documents")
def list_view(spark, d):
    return _t(spark, d, "documents").select("doc_id", F.when(F.length("text") > 60, F.concat(F.substring("text", 1, 60), F.lit("..."))).otherwise(F.col("text")).alias("title"), F.coalesce("source", F.lit("-")).alias("cwd"))


@_query("SELECT page_id, CASE WHEN regexp_matches(url, '^[a-z0-9][a-z0-9._-]{0,119}$') THEN url ELSE '~' || sha256(url) END AS name FROM pages")
def safe_filename(spark, d):
    return _t(spark, d, "pages").select("page_id", text.safe_name(F.col("url")).alias("name"))


@_query(f"SELECT page_id, count(*) OVER (PARTITION BY lower({_PATH})) > 1 AS collides FROM pages")
def path_collision(spark, d):
    pages = _t(spark, d, "pages").select("page_id", F.lower(_path()).alias("key"))
    return relations.count_join(pages, pages, "key", "n").select("page_id", (F.col("n") > 1).alias("collides"))


@_query("SELECT event_id, try_cast(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def json_props(spark, d):
    return _t(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").try_cast("bigint").alias("k"))


# --- joins --------------------------------------------------------------------------


@_query("SELECT o_orderkey, l_linenumber, l_quantity FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey")
def msg_part_join(spark, d):
    orders, parts = _t(spark, d, "orders").select("o_orderkey"), _t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity")
    return orders.join(parts, orders["o_orderkey"] == parts["l_orderkey"], "left").select("o_orderkey", "l_linenumber", "l_quantity")


@_query("SELECT c_custkey, count(o_orderkey) AS messages FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey")
def count_left_join(spark, d):
    return relations.count_join(_t(spark, d, "customer").select("c_custkey"), _t(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "messages")


@_query("SELECT c_custkey, o.p AS latest FROM customer LEFT JOIN (SELECT o_custkey, arg_max(o_orderpriority, struct_pack(a := o_orderdate, b := o_orderkey)) AS p FROM orders GROUP BY o_custkey) o ON o_custkey = c_custkey")
def latest_model_join(spark, d):
    orders = _t(spark, d, "orders").withColumnRenamed("o_custkey", "c_custkey")
    return relations.latest_join(_t(spark, d, "customer").select("c_custkey"), orders, "c_custkey", F.col("o_orderpriority"), F.struct("o_orderdate", "o_orderkey"), "latest")


_EVENTS = "c AS (SELECT user_id, ts, event_id FROM events WHERE event_type = 'click'), r AS (SELECT user_id, ts, event_id FROM events WHERE event_type = 'purchase')"


def _calls(spark, d) -> tuple[DataFrame, DataFrame]:
    events = _t(spark, d, "events").select("user_id", "ts", "event_id", "event_type")
    return tuple(events.filter(F.col("event_type") == k).drop("event_type") for k in ("click", "purchase"))


@_query(f"WITH {_EVENTS} SELECT r.event_id, (SELECT arg_max(c.event_id, struct_pack(a := c.ts, b := c.event_id)) FROM c WHERE c.user_id = r.user_id AND (c.ts < r.ts OR c.ts = r.ts AND c.event_id < r.event_id)) AS call_id FROM r")
def toolcall_backfill(spark, d):
    calls, results = _calls(spark, d)
    return relations.backfill(calls, results, "user_id", ["ts", "event_id"]).select("event_id", F.col("call.event_id").alias("call_id"))


@_query(f"WITH {_EVENTS} SELECT event_id FROM r WHERE user_id NOT IN (SELECT user_id FROM c WHERE user_id % 5 <> 0)")
def orphan_results(spark, d):
    calls, results = _calls(spark, d)
    calls = calls.filter("user_id % 5 <> 0")
    return results.join(calls, "user_id", "left_anti").select("event_id")


@_query("SELECT o_custkey, min(o_orderpriority) AS sole FROM orders GROUP BY o_custkey HAVING count(DISTINCT o_orderpriority) = 1")
def sole_call_join(spark, d):
    return relations.sole_owner(_t(spark, d, "orders"), "o_custkey", "o_orderpriority", "sole")


@_query("WITH RECURSIVE e AS (SELECT doc_id AS child, doc_id // 8 AS parent FROM documents), w(node, depth) AS (SELECT 1::BIGINT, 0 UNION ALL SELECT e.child, w.depth + 1 FROM w JOIN e ON e.parent = w.node AND e.child <> e.parent) SELECT node, min(depth) AS depth FROM w GROUP BY node")
def recursive_expand(spark, d):
    edges = _t(spark, d, "documents").select(F.col("doc_id").alias("child"), F.floor(F.col("doc_id") / 8).alias("parent"))
    return relations.descend(edges, F.col("parent") == 1)


@_query("SELECT conv_id, turn FROM conversations WHERE conv_id IN (SELECT conv_id FROM conversations WHERE role = 'system')")
def semi_scope(spark, d):
    turns = _t(spark, d, "conversations")
    return turns.join(turns.filter("role = 'system'").select("conv_id"), "conv_id", "left_semi").select("conv_id", "turn")


@_query("WITH now AS (SELECT doc_id, n_chars AS sig FROM documents), old AS (SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN n_chars + 1 WHEN doc_id % 7 = 0 THEN NULL ELSE n_chars END AS sig FROM documents WHERE doc_id % 3 <> 0) SELECT now.doc_id, now.sig FROM now LEFT JOIN old USING (doc_id) WHERE old.doc_id IS NULL OR now.sig IS DISTINCT FROM old.sig")
def change_detect(spark, d):
    now = _t(spark, d, "documents").select("doc_id", F.col("n_chars").alias("sig"))
    old = now.filter("doc_id % 3 <> 0").withColumn("sig", F.when(F.col("doc_id") % 5 == 0, F.col("sig") + 1).when(F.col("doc_id") % 7 == 0, F.lit(None)).otherwise(F.col("sig")))
    return relations.changed(now, old, "doc_id", "sig")


@_query("SELECT conv_id, turn, lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS answer FROM (SELECT * FROM conversations WHERE role IN ('user', 'assistant')) QUALIFY role = 'assistant' AND lead(role) OVER (PARTITION BY conv_id ORDER BY turn) = 'user'")
def next_user(spark, d):
    w = Window.partitionBy("conv_id").orderBy("turn")
    turns = _t(spark, d, "conversations").filter(F.col("role").isin("user", "assistant"))
    return turns.withColumns({"answer": F.lead("text").over(w), "__next": F.lead("role").over(w)}).filter("role = 'assistant' and __next = 'user'").select("conv_id", "turn", "answer")


@_query("SELECT n_nationkey, f.format FROM nation, (VALUES ('json'), ('markdown'), ('raw')) f(format)")
def cross_formats(spark, d):
    return _t(spark, d, "nation").select("n_nationkey", F.explode(F.array(*map(F.lit, ("json", "markdown", "raw")))).alias("format"))


# --- aggregates ----------------------------------------------------------------------


@_query("SELECT CASE WHEN grouping(source) = 1 THEN '(all)' ELSE source END AS source, count(*) AS sessions, coalesce(sum(quality), 0)::BIGINT AS known_messages, count(*) FILTER (quality IS NULL) AS unknown_sessions FROM documents LEFT JOIN labels USING (doc_id) GROUP BY ROLLUP (source)")
def stats_by_provider(spark, d):
    rows = _t(spark, d, "documents").select("doc_id", "source").join(_t(spark, d, "labels"), "doc_id", "left")
    return stats.exact_and_unknown(rows, "source", "quality")


@_query("WITH n AS (SELECT max(ts)::DATE AS today FROM events) SELECT CASE WHEN today - ts::DATE <= 0 THEN 'today' WHEN today - ts::DATE = 1 THEN 'yesterday' WHEN today - ts::DATE <= 7 THEN 'this week' WHEN today - ts::DATE <= 30 THEN 'this month' ELSE 'older' END AS bucket, count(*) AS sessions FROM events, n GROUP BY 1")
def stats_by_time(spark, d):
    events = _t(spark, d, "events")
    now = events.agg(F.to_date(F.max("ts")).alias("today"))
    return events.crossJoin(F.broadcast(now)).groupBy(stats.time_group(F.to_date("ts"), F.col("today")).alias("bucket")).agg(F.count(F.lit(1)).alias("sessions"))


@_query("SELECT source, count(*) AS sessions FROM documents GROUP BY source")
def index_stats(spark, d):
    return _t(spark, d, "documents").groupBy("source").agg(F.count(F.lit(1)).alias("sessions"))


@_query("SELECT user_id, count(*) FILTER (json_extract_string(props, '$.k')::BIGINT IN (1, 2)) AS messages FROM events GROUP BY user_id")
def json_filtered_count(spark, d):
    return _t(spark, d, "events").groupBy("user_id").agg(F.count_if(F.get_json_object("props", "$.k").try_cast("bigint").isin(1, 2)).alias("messages"))


@_query("SELECT user_id, arg_min(event_type, r) FILTER (event_type <> 'view') AS first_known FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS r FROM events) WHERE r <= 20 GROUP BY user_id")
def first_nonnull_prefix20(spark, d):
    return stats.first_known(_t(spark, d, "events"), "user_id", "event_id", F.when(F.col("event_type") != "view", F.col("event_type")), 20, "first_known")


@_query("SELECT user_id, count(*) AS n, round(sum(value), 4) AS total, arg_max(event_type, event_id) AS last_type FROM events GROUP BY user_id")
def token_sums(spark, d):
    return _t(spark, d, "events").groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"), F.max_by("event_type", "event_id").alias("last_type"))


@_query("WITH s AS (SELECT DISTINCT p_size, p_brand, min(p_partkey) AS k FROM part GROUP BY p_size, p_brand), r AS (SELECT *, row_number() OVER (PARTITION BY p_size ORDER BY k) AS r FROM s) SELECT p_size, string_agg(p_brand, ',' ORDER BY r) AS items FROM r WHERE r <= 12 GROUP BY p_size")
def merge_distinct(spark, d):
    return collect.merge_items(_t(spark, d, "part"), "p_size", ["p_partkey"], "p_brand").select("p_size", F.array_join("items", ",").alias("items"))


@_query("SELECT source, ceil(round(ln(count(*)) / ln(8), 9))::INTEGER AS depth FROM documents GROUP BY source")
def tree_reduce(spark, d):
    return _t(spark, d, "documents").groupBy("source").agg(collect.tree_levels(F.count(F.lit(1))).alias("depth"))


# --- windows --------------------------------------------------------------------------


@_query("WITH f AS (SELECT *, CASE WHEN role = lag(role) OVER w THEN 0 ELSE 1 END AS new FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)), g AS (SELECT *, sum(new) OVER (PARTITION BY conv_id ORDER BY turn) AS grp FROM f) SELECT conv_id, grp::BIGINT AS grp, min(role) AS role, count(*) AS parts FROM g GROUP BY conv_id, grp")
def assistant_groups(spark, d):
    w = Window.partitionBy("conv_id").orderBy("turn")
    marked = _t(spark, d, "conversations").withColumn("new", F.when(F.col("role") == F.lag("role").over(w), 0).otherwise(1))
    return marked.withColumn("grp", F.sum("new").over(w)).groupBy("conv_id", "grp").agg(F.min("role").alias("role"), F.count(F.lit(1)).alias("parts"))


@_query("SELECT user_id, event_id FROM (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events) WHERE before IS DISTINCT FROM event_type")
def adjacent_dedupe(spark, d):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return _t(spark, d, "events").withColumn("before", F.lag("event_type").over(w)).filter(~F.col("before").eqNullSafe(F.col("event_type"))).select("user_id", "event_id")


@_query("""
WITH RECURSIVE n AS (SELECT conv_id, turn, least(length(text), 280) + 32 AS sz, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS r FROM conversations),
w AS (SELECT conv_id, r, sz::BIGINT AS used, 1::BIGINT AS kept FROM n WHERE r = 1
  UNION ALL SELECT n.conv_id, n.r, CASE WHEN w.used + n.sz > 800 THEN w.used ELSE w.used + n.sz END, CASE WHEN w.used + n.sz > 800 THEN w.kept ELSE w.kept + 1 END FROM w JOIN n ON n.conv_id = w.conv_id AND n.r = w.r + 1)
SELECT conv_id, max(kept) AS kept, max(used) AS used FROM w GROUP BY conv_id""")
def budget_fold(spark, d):
    sized = _t(spark, d, "conversations").withColumn("size", (F.least(F.length("text"), F.lit(280)) + 32).cast("long"))
    packed = sized.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "size"))).alias("events")).withColumn("kept", collect.admit(F.col("events"), 800))
    return packed.select("conv_id", F.size("kept").cast("long").alias("kept"), F.aggregate("kept", F.lit(0).cast("long"), lambda a, e: a + e["size"]).alias("used"))


@_query("""
WITH RECURSIVE n AS (SELECT conv_id, length(text)::BIGINT AS sz, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS r FROM conversations),
w AS (SELECT conv_id, r, sz + 1 AS used, 0::BIGINT AS chunk FROM n WHERE r = 1
  UNION ALL SELECT n.conv_id, n.r, CASE WHEN w.used > 0 AND w.used + n.sz + 1 > 1500 THEN n.sz + 1 ELSE w.used + n.sz + 1 END, CASE WHEN w.used > 0 AND w.used + n.sz + 1 > 1500 THEN w.chunk + 1 ELSE w.chunk END FROM w JOIN n ON n.conv_id = w.conv_id AND n.r = w.r + 1)
SELECT conv_id, max(chunk) + 1 AS chunks FROM w GROUP BY conv_id""")
def chunk_fold(spark, d):
    packed = _t(spark, d, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", F.length("text").cast("long").alias("n")))).alias("m"))
    return packed.select("conv_id", (F.array_max(collect.chunk_numbers(F.transform("m", lambda x: x["n"]), 1500)) + 1).alias("chunks"))


@_query("SELECT conv_id, turn, last_value(CASE WHEN role = 'user' THEN turn END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS user_turn FROM conversations")
def carry_forward(spark, d):
    w = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, 0)
    return _t(spark, d, "conversations").select("conv_id", "turn", F.last(F.when(F.col("role") == "user", F.col("turn")), True).over(w).alias("user_turn"))


@_query("SELECT user_id, event_id, (row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1) // 8 AS grp FROM events")
def group_of_8(spark, d):
    n = F.row_number().over(Window.partitionBy("user_id").orderBy("event_id"))
    return _t(spark, d, "events").select("user_id", "event_id", F.floor((n - 1) / 8).alias("grp"))


@_query("SELECT user_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS a, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS b FROM events) WHERE a <= 3 OR b = 1")
def head_tail(spark, d):
    events = _t(spark, d, "events")
    a, b = (F.row_number().over(Window.partitionBy("user_id").orderBy(o)) for o in (F.asc("event_id"), F.desc("event_id")))
    return events.withColumns({"a": a, "b": b}).filter("a <= 3 or b = 1").select("user_id", "event_id")


# --- collect and scalars -----------------------------------------------------------------


@_query("SELECT conv_id, turn, CASE WHEN role = 'user' THEN 'user_intent' WHEN regexp_matches(text, 'error|exception|traceback|failed|failure|bug|panic|not found', 'i') THEN 'error' WHEN regexp_matches(trim(text), '\\?$|todo|next', 'i') THEN 'open_question' WHEN regexp_matches(text, 'fix|done|resolved?', 'i') THEN 'decision' WHEN role = 'assistant' THEN 'assistant_key' ELSE 'message' END AS kind FROM conversations WHERE trim(text) <> '' AND NOT (length(trim(text)) <= 60 AND regexp_matches(trim(text), '^(hi|hello|thanks|thank you|ok\\b)', 'i'))")
def event_classify(spark, d):
    return _t(spark, d, "conversations").select("conv_id", "turn", text.event_kind(F.col("role"), F.col("text")).alias("kind")).filter("kind is not null")


def _found_paths(x: str) -> str:
    """SQL: the first six paths of a text, distinct by case, marks at their ends taken off."""
    pattern, ends = text.PATH.replace("'", "''"), r"^[.,:;)\]}]+|[.,:;)\]}]+$"
    found = f"list_transform(regexp_extract_all({x}, '{pattern}'), lambda p: regexp_replace(p, '{ends}', '', 'g'))"
    return f"list_filter({found}, lambda p, i: list_position(list_transform({found}, lambda q: lower(q)), lower(p)) = i)[:6]"


@_query(f"SELECT page_id, array_to_string({_found_paths('url')}, '|') AS paths FROM pages")
def path_extract(spark, d):
    return _t(spark, d, "pages").select("page_id", F.array_join(text.find_paths(F.col("url")), "|").alias("paths"))


@_query(f"""
WITH RECURSIVE e AS (SELECT conv_id, turn, CASE WHEN length(trim(text)) <= 280 THEN trim(text) ELSE rtrim(substring(trim(text), 1, 277)) || '...' END AS said FROM conversations
  WHERE role IN ('user', 'assistant') AND trim(regexp_replace(text, '\\s+', ' ', 'g')) <> '' AND NOT (length(trim(regexp_replace(text, '\\s+', ' ', 'g'))) <= 60 AND regexp_matches(trim(regexp_replace(text, '\\s+', ' ', 'g')), '^(hi|hello|thanks|thank you|ok\\b)', 'i'))),
z AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n, length(said) + 32 + coalesce(list_sum(list_transform({_found_paths("said")}, lambda p: length(p))), 0) AS size FROM e),
f AS (SELECT conv_id, 0::BIGINT AS n, 0::HUGEINT AS used, 0::BIGINT AS kept FROM z GROUP BY conv_id
  UNION ALL SELECT f.conv_id, z.n, f.used + CASE WHEN f.kept > 0 AND f.used + z.size > 700 THEN 0 ELSE z.size END, f.kept + CASE WHEN f.kept > 0 AND f.used + z.size > 700 THEN 0 ELSE 1 END FROM f JOIN z ON z.conv_id = f.conv_id AND z.n = f.n + 1)
SELECT conv_id, max(kept) AS events FROM f GROUP BY conv_id""")
def collect_admitted(spark, d):
    """Events within a budget that some sessions pass."""
    return collect.session_events(_t(spark, d, "conversations"), "conv_id", "turn", 700).groupBy("conv_id").agg(F.count(F.lit(1)).alias("events"))


@_query("""SELECT conv_id, count(*) AS events FROM conversations WHERE role IN ('user', 'assistant') AND trim(text) <> '' AND NOT (length(trim(text)) <= 60 AND regexp_matches(trim(text), '^(hi|hello|thanks|thank you|ok\\b)', 'i')) GROUP BY conv_id""")
def collect_plan(spark, d):
    return collect.session_events(_t(spark, d, "conversations"), "conv_id", "turn").groupBy("conv_id").agg(F.count(F.lit(1)).alias("events"))


_TIDY = "trim(regexp_replace(text, '\\s+', ' ', 'g'))"
# event lines of the conversations that no folder denies, and a line for those without events
_EVENT_LINES = f"""h AS (SELECT DISTINCT conv_id FROM conversations WHERE conv_id % 7 = 0 OR conv_id % 5 <> 3),
e AS (SELECT conv_id, turn, role, CASE WHEN role = 'user' THEN 'user_intent' WHEN text LIKE '%```%' THEN 'code' WHEN regexp_matches({_TIDY}, 'error|exception|traceback|failed|failure|bug|panic|not found', 'i') THEN 'error' WHEN regexp_matches({_TIDY}, '\\?$|todo|next', 'i') THEN 'open_question' WHEN regexp_matches({_TIDY}, 'fix|done|resolved?', 'i') THEN 'decision' ELSE 'assistant_key' END AS kind,
  CASE WHEN length(trim(text)) <= 280 THEN trim(text) ELSE rtrim(substring(trim(text), 1, 277)) || '...' END AS said
  FROM conversations JOIN h USING (conv_id) WHERE role IN ('user', 'assistant') AND {_TIDY} <> '' AND NOT (length({_TIDY}) <= 60 AND regexp_matches({_TIDY}, '^(hi|hello|thanks|thank you|ok\\b)', 'i'))),
p AS (SELECT *, {_found_paths("said")} AS paths FROM e),
l AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n, said, '[' || kind || '] role=' || role || CASE WHEN len(paths) > 0 THEN ' files=' || array_to_string(paths, ',') ELSE '' END || ' text=' || said AS line FROM p
  UNION ALL SELECT conv_id, 1, '(empty session)', '[fallback] role=system text=(empty session)' FROM h WHERE conv_id NOT IN (SELECT conv_id FROM e))"""
_COLLECTED = workflow.Range(date(2024, 1, 1), date(2199, 12, 31), "Asia/Shanghai", ("/w/p3",))


def _collected(spark, d) -> tuple[DataFrame, DataFrame]:
    """Conversations as sessions, 90 minutes apart, in five folders, and their messages."""
    turns = _t(spark, d, "conversations")
    id_, made = F.col("conv_id"), F.timestamp_seconds(F.lit(1_704_067_200) + F.col("conv_id") * 5400)
    provider = F.when(id_ % 3 == 0, "codex").otherwise("pi")
    key = [provider.alias("provider"), id_.cast("string").alias("session_id")]
    folder = F.when(id_ % 7 != 0, F.concat(F.lit("/w/p"), id_ % 5))
    heads = turns.select(*key, "conv_id").distinct().select("provider", "session_id", F.concat(F.lit("T"), id_).alias("title"), made.alias("created_at"), made.alias("updated_at"), folder.alias("working_directory"), F.concat("provider", F.lit("://"), "session_id").alias("uri"))
    return heads, turns.select(*key, F.col("turn").alias("seq"), "role", "text")


@_query(f"""WITH RECURSIVE {_EVENT_LINES},
f AS (SELECT conv_id, n, 0::BIGINT AS chunk, length(line) + 1 AS used FROM l WHERE n = 1
  UNION ALL SELECT l.conv_id, l.n, CASE WHEN f.used + length(l.line) + 1 > 3200 THEN f.chunk + 1 ELSE f.chunk END, CASE WHEN f.used + length(l.line) + 1 > 3200 THEN length(l.line) + 1 ELSE f.used + length(l.line) + 1 END FROM f JOIN l ON l.conv_id = f.conv_id AND l.n = f.n + 1)
SELECT conv_id, chunk, max(chunk) OVER (PARTITION BY conv_id) + 1 AS chunks, events, body, 'pi' = CASE WHEN conv_id % 3 = 0 THEN 'codex' ELSE 'pi' END AS pi, length(body) AS sent
FROM (SELECT conv_id, chunk, count(*)::INT AS events, string_agg(line, chr(10) ORDER BY n) AS body FROM f JOIN l USING (conv_id, n) GROUP BY conv_id, chunk)""")
def collect_chunks(spark, d):
    """Chunks of a collect run, and what their prompts say of them."""
    sessions, messages = _collected(spark, d)
    plan = workflow.planned(workflow.selected(sessions, messages, _COLLECTED), messages, zone=_COLLECTED.zone)
    sent = F.try_parse_json(F.element_at(F.split("prompt", "\n"), -1))
    said = F.when(F.try_variant_get(sent, "$.content", "string") == F.col("body"), F.try_variant_get(sent, "$.length", "bigint"))
    return plan.select(F.substring_index("session", "/", -1).cast("long").alias("conv_id"), "chunk", "chunks", "events", "body", F.col("session").startswith("pi:").alias("pi"), said.alias("sent"))


def _first_words(prompt: str) -> str:
    """A stand-in for the model: the beginning of each event as a key action."""
    last = json.loads(prompt.rsplit("\n", 1)[-1])
    if last["untrusted_data"] != "session_events":
        return "{}"
    said = re.split(r"(?:^|\n)\[[a-z_]+\] role=[a-z]+(?: files=\S*)? text=", last["content"])[1:]
    return json.dumps({"key_actions": [x[:16].strip() for x in said]}, ensure_ascii=False)


@_query(f"""WITH {_EVENT_LINES},
i AS (SELECT conv_id, n, trim(regexp_replace(substring(said, 1, 16), '\\s+', ' ', 'g')) AS item FROM l),
one AS (SELECT conv_id, min(n) AS n, arg_min(item, n) AS item FROM i GROUP BY conv_id, lower(item)),
r AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY n) AS k FROM one),
t AS (SELECT arg_min(item, (conv_id, k)) AS item, min((conv_id, k)) AS first FROM r WHERE k <= 12 GROUP BY lower(item) ORDER BY first LIMIT 12),
s AS (SELECT conv_id, 'T' || conv_id || ': ' || string_agg(item, '; ' ORDER BY k) AS line FROM r WHERE k <= 2 GROUP BY conv_id),
b AS (SELECT 'date' AS kind, strftime(make_timestamp((1704067200 + conv_id * 5400 + 28800) * 1000000), '%Y-%m-%d') AS bucket, conv_id, line FROM s
  UNION ALL SELECT 'project', CASE WHEN conv_id % 7 = 0 THEN '(unknown)' ELSE '/w/p' || conv_id % 5 END, conv_id, line FROM s),
m AS (SELECT *, row_number() OVER (PARTITION BY kind, bucket ORDER BY conv_id) AS k FROM b)
SELECT kind, bucket, string_agg(line, '|' ORDER BY k) AS lines FROM m WHERE k <= 6 GROUP BY kind, bucket
UNION ALL SELECT 'total', (SELECT count(*) FROM h)::VARCHAR, string_agg(item, '|' ORDER BY first) FROM t""")
def collect_summaries(spark, d):
    """A collect run up to its report: the total and the highlights by day and project."""
    sessions, messages = _collected(spark, d)
    entries = scratch.settle(workflow.selected(sessions, messages, _COLLECTED), "entries")
    summaries, _ = workflow.summarised(workflow.planned(entries, messages, zone=_COLLECTED.zone), _first_words)
    ordered = summaries.join(entries.select(F.col("uri").alias("session"), "created_at"), "session")
    total = reduction.reduce_tree(ordered, ["created_at", "session"]).select(F.lit("total").alias("kind"), F.col("sessions").cast("string").alias("bucket"), F.array_join("key_actions", "|").alias("lines"))
    return total.unionByName(workflow.buckets(entries, summaries).withColumn("lines", F.array_join("lines", "|")))


@_query("SELECT event_id, coalesce(try_cast(CASE WHEN regexp_matches(trim(s), '^[+-]?[0-9]+$') THEN trim(s) END AS BIGINT), 0) AS n FROM (SELECT event_id, CASE event_id % 4 WHEN 0 THEN ' ' || event_id || ' ' WHEN 1 THEN event_id || '.5' WHEN 2 THEN 'x' ELSE event_id::VARCHAR END AS s FROM events)")
def coerce_int(spark, d):
    e, s = F.col("event_id"), F.col("event_id").cast("string")
    raw = F.when(e % 4 == 0, F.concat(F.lit(" "), s, F.lit(" "))).when(e % 4 == 1, F.concat(s, F.lit(".5"))).when(e % 4 == 2, "x").otherwise(s)
    return _t(spark, d, "events").select("event_id", coerce.safe_int(raw).alias("n"))


@_query("SELECT event_id, CASE WHEN event_id % 3 = 2 THEN 0.0 ELSE value END AS x FROM events")
def coerce_float(spark, d):
    raw = F.when(F.col("event_id") % 3 == 2, "NaN").otherwise(F.col("value").cast("string"))
    return _t(spark, d, "events").select("event_id", coerce.safe_float(raw).alias("x"))


@_query("SELECT event_id, epoch_us(ts) // 1000000 AS s FROM events")
def epoch_parse(spark, d):
    ms = F.unix_millis(F.col("ts").cast("timestamp"))
    return _t(spark, d, "events").select("event_id", F.unix_seconds(coerce.epoch(F.when(F.col("event_id") % 2 == 0, ms).otherwise(F.floor(ms / 1000)))).alias("s"))


@_query("SELECT event_id, CASE WHEN event_id % 5 = 0 THEN 0 ELSE epoch_ms(date_trunc('second', ts)) END AS ms FROM events")
def iso_ms(spark, d):
    iso = F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), F.lit("Z"))
    return _t(spark, d, "events").select("event_id", coerce.iso_ms(F.when(F.col("event_id") % 5 == 0, "soon").otherwise(iso)).alias("ms"))


@_query("SELECT event_id FROM events WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 10 DAY")
def ttl_evict(spark, d):
    events = _t(spark, d, "events").withColumn("last_seen", F.col("ts"))
    now = events.agg(F.max("ts").alias("now"))
    return index.evict(events.join(F.broadcast(now)), F.col("now"), 10).select("event_id")


@_query("SELECT conv_id, string_agg('## ' || (rn) || '. ' || upper(substring(role, 1, 1)) || substring(role, 2) || chr(10) || chr(10) || text, chr(10) || chr(10) ORDER BY rn) AS markdown FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS rn FROM conversations) GROUP BY conv_id")
def fill_markdown(spark, d):
    from tidemark.sources.sinks import markdown

    return markdown(_t(spark, d, "conversations"), "conv_id", "turn")


# --- transcripts ---------------------------------------------------------------------------

_KIND = "CASE WHEN role = 'system' OR (role = 'user' AND turn % 4 = 0) THEN 'turn' ELSE ['reasoning', 'text', 'tool'][length(text) % 3 + 1] END"


def _folded(sticky: bool) -> str:
    """Item by item: the open message, whether it holds text or a tool, and the latest text message."""
    after_tool = "f.cur" if sticky else "f.txt"
    return f"""
WITH RECURSIVE i AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n, {_KIND} AS kind FROM conversations),
f(conv_id, n, msg, kind, cur, has_text, has_tool, txt) AS (
  SELECT conv_id, n, n, kind, CASE WHEN kind <> 'turn' THEN n END, kind = 'text', kind = 'tool', CASE WHEN kind = 'text' THEN n END FROM i WHERE n = 1
  UNION ALL
  SELECT conv_id, n, msg, kind,
    CASE WHEN kind = 'turn' THEN NULL WHEN kind = 'tool' AND joins THEN {after_tool.replace('f.', 'x.')} ELSE msg END,
    CASE WHEN kind = 'turn' THEN false WHEN kind = 'tool' AND joins THEN {'has_text' if sticky else 'true'} WHEN msg = n THEN kind = 'text' ELSE has_text OR kind = 'text' END,
    CASE WHEN kind = 'turn' THEN false WHEN kind = 'tool' AND joins THEN {'has_tool OR cur = txt' if sticky else 'true'} WHEN msg = n THEN kind = 'tool' ELSE has_tool END,
    CASE WHEN kind = 'turn' THEN NULL WHEN kind = 'text' THEN msg ELSE txt END
  FROM (SELECT i.conv_id, i.n, i.kind, f.cur, f.has_text, f.has_tool, f.txt, f.txt IS NOT NULL AS joins,
    CASE WHEN i.kind = 'turn' THEN i.n WHEN i.kind = 'tool' THEN coalesce(f.txt, i.n)
      WHEN f.cur IS NULL OR f.has_tool OR (i.kind = 'reasoning' AND f.has_text) THEN i.n ELSE f.cur END AS msg
    FROM f JOIN i ON i.conv_id = f.conv_id AND i.n = f.n + 1) x)
SELECT conv_id, msg AS seq, string_agg(kind, ',' ORDER BY n) AS kinds, CASE WHEN arg_min(kind, n) = 'tool' THEN 'tool' END AS mode FROM f GROUP BY conv_id, msg"""


def _assembled(spark, d, grouping: str) -> DataFrame:
    role, turn = F.col("role"), F.col("turn")
    kind = F.when((role == "system") | ((role == "user") & (turn % 4 == 0)), "turn").otherwise(F.element_at(F.array(F.lit("reasoning"), F.lit("text"), F.lit("tool")), (F.length("text") % 3 + 1).cast("int")))
    items = _t(spark, d, "conversations").select(*assemble.item(session=F.col("conv_id"), line=turn, item=F.lit(0), kind=kind, role=role, text=F.col("text"), at=turn))
    messages = assemble.assemble(items, grouping)
    return messages.select(F.col("session").cast("long").alias("conv_id"), "seq", F.array_join(F.transform("parts", lambda p: p["kind"]), ",").alias("kinds"), "mode")


@_query(_folded(False))
def transcript_groups(spark, d):
    return _assembled(spark, d, "groups")


@_query(_folded(True))
def transcript_groups_sticky(spark, d):
    return _assembled(spark, d, "sticky")


# --- index upkeep, export and summaries -------------------------------------------------------


@_query("""
WITH d AS (SELECT doc_id, source, n_chars, coalesce(text, '') AS text FROM documents WHERE source IS NOT NULL),
o AS (SELECT source, doc_id, n_chars::VARCHAR AS signature, 'old' AS content FROM d WHERE doc_id % 3 <> 0),
s AS (SELECT source, doc_id, (n_chars + CASE WHEN doc_id % 5 = 0 THEN 1 ELSE 0 END)::VARCHAR AS signature, CASE WHEN doc_id % 11 <> 0 THEN text END AS content FROM d WHERE doc_id % 7 <> 0),
j AS (SELECT coalesce(s.source, o.source) AS provider, coalesce(s.doc_id, o.doc_id)::VARCHAR AS session_id, o.doc_id IS NOT NULL AS known, s.doc_id IS NOT NULL AS seen, o.signature IS DISTINCT FROM s.signature AND s.content IS NOT NULL AND s.doc_id IS NOT NULL AS took, o.signature AS os, s.signature AS ns, o.content AS oc, s.content AS nc
  FROM o FULL JOIN s ON o.source = s.source AND o.doc_id = s.doc_id)
SELECT provider, session_id, CASE WHEN took THEN ns ELSE os END AS signature, sha256(CASE WHEN took THEN nc ELSE oc END) AS content, CASE WHEN seen THEN 40 ELSE 0 END AS day FROM j WHERE known OR took""")
def index_refresh(spark, d):
    docs = _t(spark, d, "documents").filter("source is not null").select(F.col("source").alias("provider"), F.col("doc_id").cast("string").alias("session_id"), "doc_id", "n_chars", F.coalesce("text", F.lit("")).alias("content"))
    start, now = F.lit("2024-01-01").cast("timestamp"), F.lit("2024-02-10").cast("timestamp")
    known = docs.filter("doc_id % 3 <> 0").select(*index.KEY, F.col("n_chars").cast("string").alias("signature"), F.lit("").alias("title"), F.lit("old").alias("content"), start.alias("last_seen"))
    seen = docs.filter("doc_id % 7 <> 0").select(*index.KEY, (F.col("n_chars") + F.when(F.col("doc_id") % 5 == 0, 1).otherwise(0)).cast("string").alias("signature"), F.lit("").alias("title"))
    corpus = docs.select(*index.KEY, F.when(F.col("doc_id") % 11 != 0, F.col("content")).alias("content"))
    rows = index.refresh(known, seen, corpus, now)
    return rows.select(*index.KEY, "signature", F.sha2("content", 256).alias("content"), F.date_diff(F.to_date("last_seen"), F.lit("2024-01-01")).alias("day"))


@_query("SELECT url AS session, f AS format, count(*) OVER (PARTITION BY url, f) > 1 AS collides FROM pages, (VALUES ('json'), ('markdown')) v(f)")
def export_targets(spark, d):
    from tidemark.sources.sinks import export_plan, parse_formats

    return export_plan(_t(spark, d, "pages").select(F.col("url").alias("session")), "session", parse_formats("json,md,JSON"), "/out").drop("target")


@_query("SELECT page_id, '# Session Head' || chr(10) || chr(10) || '- URI: page://' || page_id || chr(10) || '- Title: ' || CASE WHEN length(trim(url)) <= 120 THEN trim(url) ELSE rtrim(substring(trim(url), 1, 117)) || '...' END || chr(10) || '- Model: -' AS head FROM pages")
def session_head(spark, d):
    from tidemark.sources.sinks import head_lines

    return _t(spark, d, "pages").select("page_id", head_lines({"URI": F.concat(F.lit("page://"), F.col("page_id")), "Title": F.col("url"), "Model": F.lit(None)}).alias("head"))


_REDUCED = """
WITH i AS (SELECT 'topics' AS field, conv_id, turn, trim(regexp_replace(substring(text, 1, 12), '\\s+', ' ', 'g')) AS item FROM conversations
  UNION ALL SELECT 'notes', conv_id, turn, role FROM conversations),
f AS (SELECT field, lower(item) AS folded, arg_min(item, struct_pack(a := conv_id, b := turn)) AS item, min(struct_pack(a := conv_id, b := turn)) AS first FROM i WHERE item <> '' GROUP BY ALL)
SELECT field, row_number() OVER (PARTITION BY field ORDER BY first) AS n, item FROM f QUALIFY n <= 12"""


@_query(_REDUCED)
def summary_reduce(spark, d):
    rows = _t(spark, d, "conversations").select("conv_id", "turn", F.array(F.substring("text", 1, 12)).alias("topics"), F.array("role").alias("notes"))
    return collect.reduce_summaries(rows, ["conv_id", "turn"], ("topics", "notes"))


@_query(_REDUCED)
def reduction_tree(spark, d):
    """The same summary level by level, eight neighbours at a time."""
    rows = _t(spark, d, "conversations").select("conv_id", "turn", F.array(F.substring("text", 1, 12)).alias("topics"), F.array("role").alias("notes"))
    fields = ("topics", "notes")
    whole = reduction.reduce_tree(rows, ["conv_id", "turn"], fields)
    piece = F.explode(F.array(*[F.struct(F.lit(name).alias("field"), F.col(name).alias("items")) for name in fields])).alias("f")
    return whole.select(piece).select("f.field", F.posexplode("f.items").alias("at", "item")).select("field", (F.col("at") + 1).alias("n"), "item")


# --- views and reports --------------------------------------------------------------------------


@_query("""SELECT conv_id AS session, turn AS seq, CASE WHEN turn % 5 = 4 THEN 'unknown' ELSE role END AS role,
concat_ws(chr(10) || chr(10), nullif(trim(text), ''), 'a' || turn, CASE WHEN turn % 2 = 0 THEN 'out' END) AS text FROM conversations""")
def transcript_spoken(spark, d):
    none = F.lit(None).cast("string")
    part = lambda kind, text=none, tool=none, arguments=none, output=none: F.struct(F.lit(kind).alias("kind"), text.alias("text"), tool.alias("tool"), arguments.alias("arguments"), output.alias("output"))
    turn = F.col("turn")
    parts = F.array(part("text", F.col("text")), part("tool", none, F.lit("run"), F.concat(F.lit("a"), turn), F.when(turn % 2 == 0, "out")))
    messages = _t(spark, d, "conversations").select(F.col("conv_id").alias("session"), turn.alias("seq"), F.when(turn % 5 != 4, F.upper("role")).alias("role"), parts.alias("parts"))
    return views.spoken(views.transcript(messages))


# each part of a path in turn; what a ".." takes off is what stands before it
@_query("""
WITH RECURSIVE p AS (SELECT page_id, regexp_extract(url, '^[a-z]+://[^/]+([^?#]*)', 1) AS path FROM pages),
g AS (SELECT page_id, CASE page_id % 4 WHEN 0 THEN path || '/../x//./y' WHEN 1 THEN 'rel' || path || '/..' WHEN 2 THEN '~/../..' || path ELSE ' ' || path || '/../../../../..//z ' END AS raw FROM p),
w AS (SELECT page_id, CASE WHEN trim(raw) LIKE '~/%' THEN '/home/u' || substring(trim(raw), 2) WHEN trim(raw) LIKE '/%' THEN trim(raw) ELSE '/w/' || trim(raw) END AS whole FROM g),
f AS (SELECT page_id, string_split(whole, '/') AS parts, 1 AS i, []::VARCHAR[] AS stack FROM w
  UNION ALL SELECT page_id, parts, i + 1, CASE WHEN parts[i] IN ('', '.') THEN stack WHEN parts[i] = '..' THEN stack[:-2] ELSE list_append(stack, parts[i]) END FROM f WHERE i <= len(parts))
SELECT page_id, '/' || array_to_string(stack, '/') AS path FROM f WHERE i > len(parts)""")
def path_normal(spark, d):
    at, n = _path(), F.col("page_id") % 4
    raw = F.when(n == 0, F.concat(at, F.lit("/../x//./y"))).when(n == 1, F.concat(F.lit("rel"), at, F.lit("/.."))).when(n == 2, F.concat(F.lit("~/../.."), at)).otherwise(F.concat(F.lit(" "), at, F.lit("/../../../../..//z ")))
    return _t(spark, d, "pages").select("page_id", text.normal_path(raw, "/w", "/home/u").alias("path"))


@_query("SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'a|b' WHEN 1 THEN lang WHEN 2 THEN '' ELSE '1' END AS targets FROM documents WHERE lang IS NOT NULL")
def json_or_list(spark, d):
    k = F.col("doc_id") % 4
    raw = F.when(k == 0, '["a", "", "b"]').when(k == 1, F.col("lang")).when(k == 2, '{"x": 1}').otherwise("[1]")
    return _t(spark, d, "documents").filter("lang is not null").select("doc_id", F.array_join(views.json_or_list(raw), "|").alias("targets"))


@_query("SELECT conv_id, turn, '[message] role=' || role || CASE WHEN turn % 2 = 1 THEN ' files=a.py,b.py' ELSE '' END || ' text=' || text AS line FROM conversations")
def event_line(spark, d):
    named = F.when(F.col("turn") % 2 == 1, F.array(F.lit("a.py"), F.lit("b.py"))).otherwise(F.array().cast("array<string>"))
    return _t(spark, d, "conversations").select("conv_id", "turn", views.event_line(F.lit("message"), F.col("role"), named, F.col("text")).alias("line"))


@_query("""SELECT event_id, '{"at":' || epoch_us(ts) || ',"files":[{"modified":' || user_id || ',"size":' || CASE WHEN event_id % 3 = 0 THEN 'null' ELSE event_id::VARCHAR END || '}]}' AS signature FROM events""")
def change_signature(spark, d):
    stat = F.struct(F.col("user_id").alias("modified"), F.when(F.col("event_id") % 3 != 0, F.col("event_id")).alias("size"))
    return _t(spark, d, "events").select("event_id", views.signature(F.col("ts").cast("timestamp"), stat).alias("signature"))


@_query("""
WITH l AS (SELECT coalesce(source, '(unknown)') AS bucket, doc_id, coalesce(lang, '-') || ': ' || CASE WHEN doc_id % 4 = 0 THEN '(no highlights)' WHEN lower(left(text, 2)) = lower(substring(text, 3, 2)) THEN left(text, 2) ELSE left(text, 2) || '; ' || substring(text, 3, 2) END AS line
  FROM documents WHERE text IS NOT NULL AND regexp_matches(text, '^[A-Za-z]{4}')),
o AS (SELECT bucket, arg_min(line, doc_id) AS line, min(doc_id) AS first FROM l GROUP BY bucket, lower(line)),
n AS (SELECT *, row_number() OVER (PARTITION BY bucket ORDER BY first) AS n FROM o)
SELECT bucket, string_agg(line, '|' ORDER BY n) AS lines FROM n WHERE n <= 6 GROUP BY bucket""")
def highlight_lists(spark, d):
    docs = _t(spark, d, "documents").filter("text is not null and text rlike '^[A-Za-z]{4}'").withColumn("title", F.coalesce("lang", F.lit("-")))
    fields = docs.withColumns({"key_actions": F.when(F.col("doc_id") % 4 != 0, F.array(F.substring("text", 1, 2))), "decisions": F.when(F.col("doc_id") % 4 != 0, F.array(F.substring("text", 3, 2)))})
    return views.highlights(fields, F.col("source"), ["doc_id"], {"key_actions": 2, "decisions": 1}).select("bucket", F.array_join("lines", "|").alias("lines"))


@_query("SELECT CASE WHEN grouping(source) = 1 THEN '(all)' ELSE source END AS name, count(DISTINCT doc_id) AS sessions, coalesce(sum(n_chars // 1000), 0)::BIGINT AS chunks FROM documents GROUP BY ROLLUP (source)")
def collect_overview(spark, d):
    planned = _t(spark, d, "documents").withColumn("chunks", F.floor(F.col("n_chars") / 1000))
    return views.run_overview(planned, "source", "doc_id", "chunks")


@_query("SELECT bool_or(n_chars > 500) AS any_success, NOT bool_or(n_chars > 500) AS all_failed, count(*) FILTER (n_chars > 500) AS paths FROM documents")
def export_outcome(spark, d):
    return views.outcome(_t(spark, d, "documents").select("doc_id", (F.col("n_chars") > 500).alias("ok")))


@_query(f"WITH {_SESSIONS} SELECT DISTINCT provider, 'json,markdown,raw,print' AS supported FROM s UNION SELECT 'cursor', 'json,markdown,print'")
def capability_matrix(spark, d):
    providers = _sessions(spark, d)[0].select("provider").distinct().unionByName(spark.sql("select 'cursor' as provider"))
    return views.capabilities(providers).select("provider", F.array_join("supported", ",").alias("supported"))


@_query("SELECT doc_id FROM documents WHERE source IS DISTINCT FROM 'src3'")
def index_clear(spark, d):
    return index.clear(_t(spark, d, "documents").withColumnRenamed("source", "provider"), "src3").select("doc_id")


@_query("""
WITH d AS (SELECT source AS provider, doc_id, n_chars FROM documents WHERE source IS NOT NULL), t AS (SELECT * FROM d WHERE doc_id % 3 = 0 OR doc_id % 5 = 0)
SELECT provider, count(*) FILTER (doc_id % 11 <> 0) AS added, count(*) FILTER (doc_id % 11 = 0) AS skipped FROM t GROUP BY provider""")
def index_refresh_counts(spark, d):
    docs = _t(spark, d, "documents").filter("source is not null").select(F.col("source").alias("provider"), F.col("doc_id").cast("string").alias("session_id"), "doc_id", F.col("n_chars").cast("string").alias("signature"))
    known = docs.filter("doc_id % 3 <> 0").withColumn("signature", F.when(F.col("doc_id") % 5 == 0, "old").otherwise(F.col("signature")))
    corpus = docs.select(*index.KEY, F.when(F.col("doc_id") % 11 != 0, "text").alias("content"))
    return index.refresh_counts(known, docs, corpus).drop("sample")
