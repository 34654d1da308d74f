"""The queries of this subpackage and, where SQL can express them, their DuckDB counterparts."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from granula.llm import common, lines, mixing, near_duplicates, packing, pii, quality, runs, sharding, substrings, token_files, tokenizer_alignment, topk, warc

#: Bytes of text a shard may hold.
SHARD_BYTES = 1 << 20


def _table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def op1_substring_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return substrings.digest(substrings.remove_repeats(_table(spark, sf, "documents")))


def op2_extendible_sharding(spark: SparkSession, sf: str) -> DataFrame:
    docs = _table(spark, sf, "documents").select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("bytes"))
    return sharding.shard(docs, "doc_id", F.col("bytes"), SHARD_BYTES)


def op3_quality_rules(spark: SparkSession, sf: str) -> DataFrame:
    rows = quality.quality(_table(spark, sf, "documents"), _table(spark, sf, "labels"))
    first = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    return rows.select(*first, *(c for c in rows.columns if c not in first))


def op4_near_duplicates(spark: SparkSession, sf: str) -> DataFrame:
    return near_duplicates.near_duplicates(_table(spark, sf, "documents"))


def op5_packing(spark: SparkSession, sf: str) -> DataFrame:
    return packing.digest(packing.pack(_table(spark, sf, "documents"), public_tokenizers.path("byte_bpe_50k.json"), remembered=1_000_000))


def op6_topk_search(spark: SparkSession, sf: str) -> DataFrame:
    vectors = _table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), topk.quantise(F.col("embedding")).alias("v"))
    return topk.search(vectors, vectors.where("id % 50 = 0"), 5)


def op7_warc(spark: SparkSession, sf: str) -> DataFrame:
    return warc.round_trip(_table(spark, sf, "pages"))


def op8_token_files(spark: SparkSession, sf: str) -> DataFrame:
    path = common.shared_dir(spark, "tokens")
    token_files.write(_table(spark, sf, "documents"), path, public_tokenizers.path("word_bpe_49k.json"))
    return token_files.digest(token_files.read(spark, path))


def op9_line_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return lines.dedup_lines(_table(spark, sf, "documents").select("doc_id", "text")).select("doc_id", "n_lines", "n_removed", "text")


def op10_mixing(spark: SparkSession, sf: str) -> DataFrame:
    docs = _table(spark, sf, "documents").select("doc_id", "source", common.word_count(F.col("text")).alias("words"))
    return mixing.mix(docs, F.col("words")).drop("words", "source")


def op11_personal_data(spark: SparkSession, sf: str) -> DataFrame:
    return pii.digest(pii.find(_table(spark, sf, "documents")))


def op12_periodic_runs(spark: SparkSession, sf: str) -> DataFrame:
    return runs.digest(runs.periodic_runs(_table(spark, sf, "documents"), plant=True))


def op13_tokenizer_alignment(spark: SparkSession, sf: str) -> DataFrame:
    return tokenizer_alignment.link_counts(_table(spark, sf, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))


QUERIES = {f.__name__: f for f in (
    op1_substring_dedup, op2_extendible_sharding, op3_quality_rules, op4_near_duplicates, op5_packing,
    op6_topk_search, op7_warc, op8_token_files, op9_line_dedup, op10_mixing,
    op11_personal_data, op12_periodic_runs, op13_tokenizer_alignment,
)}

_WORDS = r"regexp_extract_all({text}, '[^\x20\x09-\x0D]+')"
ORACLES = {
    "op1_substring_dedup": f"""
        WITH t AS (SELECT doc_id, {_WORDS.format(text="coalesce(text, '')")} AS w FROM documents),
        win AS (SELECT doc_id, s, array_to_string(w[s : s + 19], ' ') AS k FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS s FROM t)),
        rep AS (SELECT doc_id, s FROM (SELECT doc_id, s, row_number() OVER (PARTITION BY k ORDER BY doc_id, s) AS r FROM win) WHERE r > 1),
        hit AS (SELECT DISTINCT doc_id, unnest(range(s, s + 20)) AS i FROM rep),
        word AS (SELECT doc_id, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS i FROM t),
        kept AS (SELECT doc_id, string_agg(x, ' ' ORDER BY i) AS k, count(*) AS n FROM word ANTI JOIN hit USING (doc_id, i) GROUP BY doc_id)
        SELECT t.doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(k, '')) AS kept_sha256
        FROM t LEFT JOIN kept USING (doc_id)""",
    "op2_extendible_sharding": f"""
        WITH r AS (SELECT doc_id, coalesce(strlen(text), 0)::BIGINT AS bytes, ('0x' || substr(md5(CAST(doc_id AS VARCHAR)), 1, 13))::BIGINT AS h FROM documents),
        n AS (SELECT d, h >> (52 - d) AS p, sum(bytes)::BIGINT AS shard_bytes, count(*) AS shard_rows, min(h) AS lo, max(h) AS hi
              FROM r, (SELECT unnest(range(0, 53))::INTEGER AS d) GROUP BY 1, 2),
        m AS (SELECT r.doc_id, r.bytes, n.*, row_number() OVER (PARTITION BY r.doc_id ORDER BY n.d) AS k
              FROM r JOIN n ON r.h >> (52 - n.d) = n.p WHERE shard_bytes <= {SHARD_BYTES} OR lo = hi)
        SELECT doc_id, bytes, d AS shard_depth, p AS shard_prefix, shard_bytes, shard_rows FROM m WHERE k = 1""",
    "op4_near_duplicates": f"""
        WITH RECURSIVE t AS (SELECT doc_id, {_WORDS.format(text="translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} AS w FROM documents),
        sh AS (SELECT DISTINCT doc_id, s FROM (SELECT doc_id, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i : i + 4], ' '))
               WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s FROM t)),
        n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
        pair AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM sh a JOIN sh b USING (s) WHERE a.doc_id <> b.doc_id GROUP BY 1, 2),
        link AS (SELECT a, b FROM pair JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 75 * (x.n + y.n - c)),
        reach AS (SELECT doc_id AS a, doc_id AS b FROM t UNION SELECT reach.a, link.b FROM reach JOIN link ON link.a = reach.b)
        SELECT t.doc_id, coalesce(max(n.n), 0)::BIGINT AS n_shingles, min(reach.b) AS component_id, t.doc_id = min(reach.b) AS kept
        FROM t JOIN reach ON reach.a = t.doc_id LEFT JOIN n ON n.doc_id = t.doc_id GROUP BY t.doc_id""",
    "op6_topk_search": """
        WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
                   WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        s AS (SELECT a.vec_id AS query_id, b.vec_id, list_dot_product(a.v, b.v)::BIGINT AS score FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0),
        r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s)
        SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5""",
    "op7_warc": """
        WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h FROM pages),
        d AS (SELECT page_id, strlen(html)::BIGINT AS payload_bytes, max(page_id) OVER (PARTITION BY h) AS top,
              array_to_string(list_transform(range(0, 32), lambda j: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
                (((('0x' || substr(h, ((j // 4) * 5 + 1)::INTEGER, 5))::BIGINT >> (15 - 5 * (j % 4))::INTEGER) & 31) + 1)::INTEGER, 1)), '') AS payload_digest FROM p)
        SELECT page_id, payload_bytes, payload_digest, CASE WHEN top = page_id THEN 'response' ELSE 'revisit' END AS record_type,
               CASE WHEN top <> page_id THEN top END AS refers_to FROM d""",
}
