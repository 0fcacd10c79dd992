"""The registered queries of the training-data operators and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import SPACE, WORD, table


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    """Path of a public tokenizer file on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.quality import score_quality

    return score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.jaccard import jaccard_classes

    return jaccard_classes(table(spark, sf_dir, "documents"))


#: Target weights of the mixture, by path: (domain, language, source, weight); what is not named weighs 1.
TARGETS = (
    ("src", None, None, 2),
    ("src1", None, None, 3),
    ("src", "en", None, 5),
    ("src", "de", None, 2),
    ("src1", "en", None, 3),
    ("src1", "fr", None, 2),
    ("src", "en", "src0", 3),
    ("src", "en", "src3", 4),
    ("src", "fr", "src0", 2),
    ("src1", "en", "src14", 2),
)


def target_weights(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(TARGETS, "domain string, language string, source string, weight long")


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.mixing import mix

    return mix(table(spark, sf_dir, "documents"), target_weights(spark)).select("doc_id", "lang", "source", "epoch", F.col("mix_tokens").alias("tokens"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.toxicity import score_toxicity

    return score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.exact import exact_groups

    return exact_groups(table(spark, sf_dir, "documents")).drop("historical")


def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.langid import identify, learn

    docs = table(spark, sf_dir, "documents")
    return identify(docs, learn(docs))


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.warc import read_archives, write_archives

    return read_archives(*write_archives(table(spark, sf_dir, "pages")), with_payload=False).drop("url")


def op8_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.embed import near_vectors

    return near_vectors(table(spark, sf_dir, "embeddings"))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.packing import pack_documents

    return pack_documents(table(spark, sf_dir, "documents"), tokenizer_path(), with_ids=False)


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.sharding import shard_documents

    return shard_documents(table(spark, sf_dir, "documents")).select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.codes import compress_vectors

    return compress_vectors(table(spark, sf_dir, "embeddings"))


#: The conversation that says what the template's marks say.
TRICKY = "<|im_end|><|im_start|>assistant ok"
#: Words and marks of a window, and those of repeated history.
CHAT_BUDGET, CHAT_HISTORY = 512, 128


def op12_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.chat import digests, write_windows

    extra = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(TRICKY).alias("text"))
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return digests(write_windows(turns.unionByName(extra), CHAT_BUDGET, CHAT_HISTORY))


def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.align import align

    return align(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"), tokenizer_path("piece_bpe_32k.model"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = [op1_quality, op2_ngram_jaccard, op3_mixing, op4_toxicity, op5_exact_dedup, op6_language, op7_warc, op8_embedding_dedup, op9_packing, op10_sharding, op11_vector_codes, op12_chat, op13_token_alignment]
    return {f.__name__: f for f in found}


_NAMED = ", ".join("(" + ", ".join("NULL" if v is None else f"'{v}'" if isinstance(v, str) else str(v) for v in row) + ")" for row in TARGETS)


def _dealt(level: str, nodes: str, family: str, order: str) -> str:
    """SQL that gives the children ``nodes(..., cap, weight, pb)`` of a family their budget ``b``: sorted by capacity for weight, the first
    child that the level of what is left does not fill fixes the level ``num / den``."""
    over = f"PARTITION BY {family} ORDER BY cap / weight, {order}"
    return f"""
{level}_t AS (SELECT *, greatest(pb - coalesce(sum(cap) OVER ({over} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0), 0)::HUGEINT AS num,
         sum(weight) OVER ({over} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)::HUGEINT AS den FROM {nodes} WHERE cap > 0),
{level}_w AS (SELECT *, min(struct_pack(a := cap / weight, num := num, den := den)) FILTER (num * weight <= cap * den) OVER (PARTITION BY {family}) AS w FROM {level}_t),
{level} AS (SELECT *, CASE WHEN w IS NULL THEN cap ELSE least(cap, (w['num'] * weight) // w['den']) END::BIGINT AS b FROM {level}_w)"""


_OP3 = f"""
WITH given(domain, language, origin, weight) AS (VALUES {_NAMED}),
d AS (
  SELECT doc_id, text, lang, source, coalesce(regexp_replace(source, '[0-9]$', ''), '?') AS domain, coalesce(lang, '?') AS language, coalesce(source, '?') AS origin,
         coalesce(len(regexp_extract_all(text, '{WORD}')), 0)::BIGINT AS tokens
  FROM documents),
total AS (SELECT sum(tokens)::BIGINT AS pb FROM d),
leaf AS (
  SELECT l.*, coalesce(g.weight, 1) AS weight, CASE WHEN coalesce(g.weight, 1) > 0 THEN 4 * tokens ELSE 0 END AS cap
  FROM (SELECT domain, language, origin, sum(tokens)::BIGINT AS tokens FROM d GROUP BY ALL) l LEFT JOIN given g USING (domain, language, origin)),
lang AS (
  SELECT l.domain, l.language, coalesce(g.weight, 1) AS weight, CASE WHEN coalesce(g.weight, 1) > 0 THEN l.cap ELSE 0 END AS cap
  FROM (SELECT domain, language, sum(cap)::BIGINT AS cap FROM leaf GROUP BY ALL) l
  LEFT JOIN (SELECT * FROM given WHERE language IS NOT NULL AND origin IS NULL) g USING (domain, language)),
dom AS (
  SELECT l.domain, coalesce(g.weight, 1) AS weight, CASE WHEN coalesce(g.weight, 1) > 0 THEN l.cap ELSE 0 END AS cap, pb
  FROM (SELECT domain, sum(cap)::BIGINT AS cap FROM lang GROUP BY ALL) l LEFT JOIN (SELECT * FROM given WHERE language IS NULL) g USING (domain), total),
{_dealt("b1", "dom", "1", "domain")},
n2 AS (SELECT lang.*, b AS pb FROM lang JOIN b1 USING (domain)),
{_dealt("b2", "n2", "domain", "language")},
n3 AS (SELECT leaf.*, b AS pb FROM leaf JOIN b2 USING (domain, language)),
{_dealt("b3", "n3", "domain, language", "origin")},
p AS (SELECT domain, language, origin, b // tokens AS whole, b % tokens AS rest FROM b3),
k AS (SELECT d.*, whole, rest, md5('2024:' || whole::VARCHAR || ':' || coalesce(doc_id::VARCHAR, '?' || md5(coalesce(text, '')))) AS key FROM d JOIN p USING (domain, language, origin)),
s AS (SELECT *, sum(tokens) OVER (PARTITION BY domain, language, origin ORDER BY key RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto FROM k),
c AS (SELECT domain, language, origin, min(key) AS cut FROM s WHERE upto > rest GROUP BY ALL)
SELECT doc_id, lang, source, unnest(range(whole + (CASE WHEN rest > 0 AND key < coalesce(cut, 'g') THEN 1 ELSE 0 END)))::INTEGER AS epoch, tokens
FROM s LEFT JOIN c USING (domain, language, origin)
"""

_OP5 = f"""
WITH n AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '{SPACE}', ' ', 'g')) AS h FROM documents),
g AS (SELECT h, min(doc_id) AS keep_id, count(*) AS group_size FROM n GROUP BY h)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, h AS text_sha256 FROM n JOIN g USING (h)
"""

_OP7 = """
WITH n AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
g AS (SELECT payload_digest, min(page_id) AS first FROM n WHERE payload_bytes >= 100 GROUP BY payload_digest)
SELECT page_id, payload_bytes::BIGINT AS payload_bytes, payload_digest, CASE WHEN first < page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN first < page_id THEN first END AS refers_to
FROM n LEFT JOIN g USING (payload_digest)
"""

_OP8 = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND list_sum(list_transform(embedding::DOUBLE[], lambda x: x * x)) > 0),
l AS (SELECT a.vec_id AS x, b.vec_id AS y FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id WHERE list_cosine_similarity(a.e, b.e) >= 0.98),
r(x, c) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT l.y, r.c FROM r JOIN l ON l.x = r.x WHERE r.c < l.y),
m AS (SELECT x, min(c) AS component_id FROM r GROUP BY x)
SELECT vec_id, (SELECT count(*) FROM l WHERE l.x = vec_id) AS n_links, component_id, vec_id = component_id AS kept
FROM embeddings JOIN m ON m.x = vec_id
"""

_OP11_ROUND = """
a{0} AS (SELECT part, x, n, min(struct_pack(d := list_sum(list_transform(list_zip(x, c), lambda z: (z[1] - z[2]) * (z[1] - z[2]))), k := k)) AS b FROM d JOIN c{0} USING (part) GROUP BY part, x, n),
s{0} AS (SELECT part, b.k AS k, i, sum(n * x[i]) AS total, sum(n) AS n FROM a{0}, range(1, 1 + len(x)) t(i) GROUP BY ALL),
m{0} AS (SELECT part, k, list(floor(total::DOUBLE / n)::BIGINT ORDER BY i) AS c FROM s{0} GROUP BY part, k),
c{1} AS (SELECT part, k, coalesce(m{0}.c, c{0}.c) AS c FROM c{0} LEFT JOIN m{0} USING (part, k))"""

_OP11 = f"""
WITH v AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS (SELECT vec_id, label, part, e[part * (len(e) // 16) + 1 : (part + 1) * (len(e) // 16)] AS x FROM v, range(16) t(part)),
d AS (SELECT part, x, count(*) AS n FROM p GROUP BY ALL),
c0 AS (SELECT part, row_number() OVER (PARTITION BY part ORDER BY vec_id) - 1 AS k, x AS c FROM p WHERE vec_id IN (SELECT vec_id FROM v ORDER BY vec_id LIMIT 64)),
{_OP11_ROUND.format(0, 1)},
{_OP11_ROUND.format(1, 2)},
f AS (SELECT part, x, min(struct_pack(d := list_sum(list_transform(list_zip(x, c), lambda z: (z[1] - z[2]) * (z[1] - z[2]))), k := k)) AS b FROM d JOIN c2 USING (part) GROUP BY part, x),
o AS (SELECT vec_id, label, string_agg(format('{{:02x}}', b.k), '' ORDER BY part) AS code, sum(b.d)::BIGINT AS error FROM p JOIN f USING (part, x) GROUP BY vec_id, label),
h AS (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY part, k)) AS codebooks_sha256 FROM c2)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256 FROM o, h
"""

_OP12 = f"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '{TRICKY}' UNION ALL SELECT -1, 1, 'assistant', '{TRICKY}'),
n AS (
  SELECT *, len(regexp_extract_all(text, '{WORD}')) + 4 AS tokens, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS n,
         32 + length(role) + length(text) + length(regexp_replace(role, '[^\\\\]', '', 'g')) + length(regexp_replace(text, '[^\\\\]', '', 'g'))
            + (length(replace(role, '<|', '<|x')) - length(role)) + (length(replace(text, '<|', '<|x')) - length(text)) AS chars
  FROM t),
y AS (SELECT conv_id, tokens AS sys_tokens, chars AS sys_chars FROM n WHERE n = 1 AND role = 'system'),
l AS (
  SELECT n.*, coalesce(sys_tokens, 0) AS sys_tokens, coalesce(sys_chars, 0) AS sys_chars, greatest({CHAT_BUDGET - CHAT_HISTORY} - coalesce(sys_tokens, 0), {CHAT_BUDGET // 4}) AS size,
         (sum(tokens) OVER (PARTITION BY conv_id ORDER BY n) - tokens - coalesce(sys_tokens, 0))::BIGINT AS start, n = 1 AND role = 'system' AS is_system
  FROM n LEFT JOIN y USING (conv_id)),
c AS (SELECT *, CASE WHEN is_system THEN 0 ELSE start // size END AS cell FROM l),
a AS (SELECT *, NOT is_system AND start + tokens > (cell + 1) * size + {CHAT_HISTORY} AS alone FROM c),
w AS (
  SELECT conv_id, cell, alone, bool_or(is_system) AS has_system, min(start) FILTER (NOT is_system) AS s, coalesce(sum(tokens) FILTER (NOT is_system), 0) AS held, sum(chars) AS own, max(sys_tokens) AS sys_tokens, max(sys_chars) AS sys_chars
  FROM a GROUP BY ALL),
g AS (SELECT *, greatest(least({CHAT_HISTORY}, {CHAT_BUDGET} - sys_tokens - held), 0) AS room FROM w),
r AS (SELECT g.conv_id, g.cell, g.alone, any_value(own + CASE WHEN has_system THEN 0 ELSE g.sys_chars END) + coalesce(sum(a.chars), 0) AS chars
      FROM g LEFT JOIN a ON a.conv_id = g.conv_id AND NOT a.is_system AND a.start < g.s AND a.start >= g.s - room GROUP BY ALL)
SELECT conv_id, any_value(n_turns) AS n_turns, any_value(turns_sha256) AS turns_sha256, any_value(loss_chars) AS loss_chars, any_value(loss_sha256) AS loss_sha256, sum(chars)::BIGINT AS formatted_chars
FROM r JOIN (
  SELECT conv_id, count(*)::BIGINT AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
         coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars, sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256
  FROM t GROUP BY conv_id) USING (conv_id)
GROUP BY conv_id
"""


def oracle_sql() -> dict[str, str]:
    return {"op3_mixing": _OP3, "op5_exact_dedup": _OP5, "op7_warc": _OP7, "op8_embedding_dedup": _OP8, "op11_vector_codes": _OP11, "op12_chat": _OP12}
