"""The thin registered queries: each applies its operator to whole tables and derives the digest columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.llm._common import temporary
from ledgerline.llm.decontamination import contaminated, decontaminate
from ledgerline.llm.html_extraction import extract_pages
from ledgerline.llm.jaccard_join import similar_components
from ledgerline.llm.license_scan import scan_licenses
from ledgerline.llm.packing import pack_documents
from ledgerline.llm.quality_rules import judge_quality
from ledgerline.llm.sharding import shard_documents
from ledgerline.llm.substring_dedup import remove_repeats
from ledgerline.llm.token_counts import token_counts
from ledgerline.llm.warc_archive import read_archive, write_archive


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _tokenizer(name: str) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op1_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decontaminate(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.encode(F.concat_ws(",", "items"), "UTF-8"), 256).alias("items_sha256"), contaminated(F.col("n_hit"), F.col("n_words")).alias("contaminated"))


def op2_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar_components(_table(spark, sf_dir, "documents"), size=4, percent=85).select("doc_id", "n_shingles", "component_id")


def op3_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = scan_licenses(_table(spark, sf_dir, "documents"))
    starts = F.transform("base", lambda b: b["start"])
    base = F.transform("base", lambda b: b["label"])
    found = F.transform("detections", lambda d: d["label"])
    return out.select(
        "doc_id", "n_words", F.size("base").cast("long").alias("n_base"), F.array_min(starts).cast("long").alias("first_word"), F.array_max(starts).cast("long").alias("last_word"),
        F.array_join(F.array_sort(F.array_distinct(base)), ",").alias("base_labels"), F.array_join(F.array_sort(F.array_distinct(F.concat(base, found))), ",").alias("labels"), "score",
    )


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_quality(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op5_kd_tree_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = shard_documents(_table(spark, sf_dir, "documents"), leaves=16)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def op6_warc_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _table(spark, sf_dir, "pages")
    path = temporary(spark, "warc")
    write_archive(pages, path)
    kind = pages.schema["page_id"].dataType
    return read_archive(spark, path).select(F.col("record_id").cast(kind).alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast(kind).alias("refers_to"))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(_table(spark, sf_dir, "documents"), _tokenizer("piece_bpe_32k.model"), limit=4096)


def op8_vector_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(_table(spark, sf_dir, "documents"), _tokenizer("word_bpe_49k.json"), end_id=2, limit=4096)


def op9_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = extract_pages(_table(spark, sf_dir, "pages"))
    return out.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = remove_repeats(_table(spark, sf_dir, "documents"), window=35)
    kept = F.when(F.col("kept_text").isNull(), F.col("words_sha256")).otherwise(F.sha2(F.encode("kept_text", "UTF-8"), 256))
    return out.select("doc_id", "n_words", "n_removed", kept.alias("kept_sha256"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_benchmark_decontamination, op2_ngram_jaccard_join, op3_license_scans, op4_quality_rules, op5_kd_tree_sharding, op6_warc_archive, op7_token_counts, op8_vector_packing, op9_html_extraction, op10_substring_dedup)}

ORACLE_SQL: dict[str, str] = {
    "op1_benchmark_decontamination": r"""
        WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
        b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
        bw AS (SELECT DISTINCT item_id, least(len(w), 13) AS n, array_to_string(w[i : i + least(len(w), 13) - 1], ' ') AS words
               FROM (SELECT item_id, w, unnest(range(1, len(w) - least(len(w), 13) + 2)) AS i FROM b WHERE len(w) > 0)),
        sizes AS (SELECT DISTINCT n FROM bw),
        dw AS (SELECT doc_id, n, i, array_to_string(w[i : i + n - 1], ' ') AS words
               FROM (SELECT doc_id, n, w, unnest(range(1, len(w) - n + 2)) AS i FROM d, sizes WHERE len(w) >= n)),
        hits AS (SELECT doc_id, item_id, n, i FROM dw JOIN bw USING (n, words)),
        covered AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hits) GROUP BY doc_id),
        listed AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM hits) GROUP BY doc_id)
        SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
               sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
        FROM d LEFT JOIN covered USING (doc_id) LEFT JOIN listed USING (doc_id)""",
    "op2_ngram_jaccard_join": r"""
        WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
        s AS MATERIALIZED (SELECT DISTINCT doc_id, array_to_string(w[i : i + 3], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 2, 2))) AS i FROM d WHERE len(w) > 0)),
        n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
        i AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS i FROM s x JOIN s y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY ALL),
        half AS (SELECT a, b FROM i JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * i >= 85 * (p.n + q.n - i)),
        links AS MATERIALIZED (SELECT a, b FROM half UNION ALL SELECT b, a FROM half),
        reach AS (SELECT DISTINCT a AS doc_id, a AS other FROM links UNION SELECT reach.doc_id, links.b FROM reach JOIN links ON links.a = reach.other),
        least AS (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY doc_id)
        SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, coalesce(component_id, d.doc_id) AS component_id
        FROM d LEFT JOIN n USING (doc_id) LEFT JOIN least USING (doc_id)""",
    "op10_substring_dedup": r"""
        WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
        windows AS (SELECT doc_id, i, array_to_string(w[i : i + 34], ' ') AS words FROM (SELECT doc_id, w, unnest(range(1, len(w) - 33)) AS i FROM d WHERE len(w) >= 35)),
        repeated AS (SELECT words FROM windows GROUP BY words HAVING count(*) > 1),
        gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 35)) AS p FROM windows JOIN repeated USING (words)),
        places AS (SELECT doc_id, list(p) AS gone FROM gone GROUP BY doc_id),
        kept AS (SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(len(gone), 0)::BIGINT AS n_removed, w, gone FROM d LEFT JOIN places USING (doc_id)),
        pieces AS (SELECT doc_id, p, word FROM (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM kept WHERE n_removed > 0)),
        joined AS (SELECT doc_id, string_agg(word, ' ' ORDER BY p) AS text FROM pieces ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id)
        SELECT doc_id, n_words, n_removed, sha256(CASE WHEN n_removed = 0 THEN array_to_string(w, ' ') ELSE coalesce(text, '') END) AS kept_sha256
        FROM kept LEFT JOIN joined USING (doc_id)""",
    "op6_warc_archive": """
        WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages),
        d AS (SELECT page_id, octet_length(payload)::BIGINT AS payload_bytes, sha256(payload) AS payload_digest FROM p),
        f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first_id FROM d)
        SELECT page_id, payload_bytes, payload_digest,
               CASE WHEN payload_bytes >= 100 AND page_id <> first_id THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN payload_bytes >= 100 AND page_id <> first_id THEN first_id END AS refers_to
        FROM f""",
}
