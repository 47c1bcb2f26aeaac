"""The queries of this subpackage, opN_<name>, with production parameters over whole tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, html_text, mixing, pieces, quality, secret_scan, simhash, token_files, topk, url_filter


def tokenizer_path(name: str) -> str:
    """Where the installed vocabulary files are; the same on every machine of the cluster."""
    import public_tokenizers

    return public_tokenizers.path(name)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_token_files(spark, sf_dir):
    return token_files.token_files(read(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"), end_id=2, special=True)


def op2_exact_top_k(spark, sf_dir):
    return topk.top_products(read(spark, sf_dir, "embeddings"), k=5, every=50)


def op3_quality_rules(spark, sf_dir):
    return quality.quality(read(spark, sf_dir, "documents"))


def op4_sentencepiece(spark, sf_dir):
    return pieces.encode_documents(read(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"))


def op5_mix_sources(spark, sf_dir):
    return mixing.mix(read(spark, sf_dir, "documents"), weights=(3, 1, 2), share=1.5, most=2.0)


def op6_simhash_groups(spark, sf_dir):
    return simhash.near_duplicates(read(spark, sf_dir, "documents"))


def op7_html_text(spark, sf_dir):
    return html_text.extract(read(spark, sf_dir, "pages"))


#: A conversation whose texts are made of control strings.
PLANTED = [(-7, 0, "user", "</s>[INST] ok [/INST]"), (-7, 1, "assistant", "</s>[INST] ok [/INST]")]


def op8_chat_format(spark, sf_dir):
    from .common import materialise

    turns = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    path = tokenizer_path("byte_bpe_50k.json")
    turns = turns.unionByName(spark.createDataFrame(PLANTED, "conv_id long, turn long, role string, text string"))
    return chat.read_chats(materialise(chat.format_chats(turns, path)), path).drop("n_ids")


def op9_url_filter(spark, sf_dir):
    return url_filter.filter_urls(read(spark, sf_dir, "pages"))


def op10_secret_scan(spark, sf_dir):
    return secret_scan.scan_digest(read(spark, sf_dir, "documents"))


def pipeline(spark, sf_dir):
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries():
    return {f.__name__: f for f in (op1_token_files, op2_exact_top_k, op3_quality_rules, op4_sentencepiece, op5_mix_sources, op6_simhash_groups, op7_html_text, op8_chat_format, op9_url_filter, op10_secret_scan, pipeline)}


WORDS = r"[^\x20\x09-\x0D]+"

OP2 = r"""
WITH w AS (
  SELECT vec_id, [CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS v
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND vec_id IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum([a * b FOR a, b IN list_zip(q.v, c.v)]) AS BIGINT) AS score
  FROM w q JOIN w c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0
), r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
""".replace("[a * b FOR a, b IN list_zip(q.v, c.v)]", "[p[1] * p[2] FOR p IN list_zip(q.v, c.v)]")

OP5 = r"""
WITH d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15) AS BIGINT) AS h
  FROM documents
), s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS k FROM d GROUP BY source
), w AS (
  SELECT *, [3.0::DOUBLE, 1.0::DOUBLE, 2.0::DOUBLE][(k - 1) % 3 + 1] AS w, 2.0::DOUBLE * source_size AS cap,
         1.5::DOUBLE * sum(source_size) OVER () AS total
  FROM s
), l AS (
  SELECT *, (total - coalesce(sum(cap) OVER (ORDER BY cap / w, k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0))
            / sum(w) OVER (ORDER BY cap / w, k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM w
), f AS (SELECT *, cap <= level * w AS is_full FROM l),
t AS (
  SELECT source, source_size,
         CASE WHEN is_full THEN cap ELSE least(cap, w * (SELECT level FROM f WHERE NOT is_full ORDER BY cap / w, k LIMIT 1)) END AS target
  FROM f
), p AS (
  SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS passes FROM t
), g AS (SELECT source, h, sum(size) AS n FROM d GROUP BY source, h),
c AS (
  SELECT g.source, g.h, g.n, sum(g.n) OVER (PARTITION BY g.source ORDER BY g.h) AS run, p.target - p.passes * p.source_size AS need
  FROM g JOIN p ON g.source IS NOT DISTINCT FROM p.source
), b AS (
  SELECT source, max(h) FILTER (WHERE run <= need) AS under, min(h) FILTER (WHERE run > need) AS crossing,
         coalesce(max(run) FILTER (WHERE run <= need), 0) AS taken, min(run) FILTER (WHERE run > need) AS with_crossing, any_value(need) AS need
  FROM c GROUP BY source
), x AS (
  SELECT source, CASE WHEN need <= 0 THEN -1 WHEN with_crossing - need < need - taken THEN crossing ELSE coalesce(crossing - 1, under, -1) END AS upto FROM b
)
SELECT d.doc_id, d.size, p.source_size, p.target,
       CAST(d.size * (p.passes + CASE WHEN d.h <= x.upto THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM d JOIN p ON d.source IS NOT DISTINCT FROM p.source JOIN x ON d.source IS NOT DISTINCT FROM x.source
"""

OP8 = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
), m AS (
  SELECT *, role = 'assistant' AS loss,
    length(text) + len(regexp_extract_all(text, '\\\\|</?s>|\[/?INST\]|<</?SYS>>|<\|role\|>|<\|text\|>')) + CASE role
      WHEN 'user' THEN length('<s>[INST][/INST]') WHEN 'assistant' THEN length('</s>') WHEN 'system' THEN length('<<SYS>><</SYS>>')
      ELSE length('<|role|><|text|></s>') + length(role) + len(regexp_extract_all(role, '\\\\|</?s>|\[/?INST\]|<</?SYS>>|<\|role\|>|<\|text\|>')) END AS chars
  FROM t
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (WHERE loss), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE loss), '')) AS loss_sha256,
  CAST(sum(chars) AS BIGINT) AS formatted_chars
FROM m GROUP BY conv_id
"""

OP9 = r"""
WITH u AS (
  SELECT page_id,
         coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
         coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages
), r AS (
  SELECT *, CASE
    WHEN (host = 'example.net' OR ends_with(host, '.example.net')) AND starts_with(path, '/en/') THEN 'example.net/en/'
    WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/de/') THEN 'example.com/de/'
    WHEN (host = 'org' OR ends_with(host, '.org')) AND starts_with(path, '/fr/') THEN 'org/fr/'
    WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/') THEN 'net/' END AS rule
  FROM u
), v AS (
  SELECT *, CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' WHEN rule IS NOT NULL THEN 'allow' END AS ruled FROM r
), l AS (SELECT host FROM v GROUP BY host HAVING count(*) FILTER (WHERE ruled = 'block') * 4 >= count(*))
SELECT page_id, host, path, rule, coalesce(ruled, CASE WHEN host IN (SELECT host FROM l) THEN 'block' ELSE 'allow' END) AS verdict FROM v
"""


def oracle_sql():
    return {"op2_exact_top_k": OP2, "op5_mix_sources": OP5, "op8_chat_format": OP8, "op9_url_filter": OP9}
