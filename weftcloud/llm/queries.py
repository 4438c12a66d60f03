"""The registered queries opN_<name>: each applies its operator to the whole of its table and derives the digest columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import bpe_transducer, exact_dedup, hilbert, html_layout, minmax_dedup, run_length_index, skip_chain_pii, suffix_decontam, tree_weighting, weak_labels
from .store import ship


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return ship(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def op1_hilbert_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    carry = [(F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32")]
    out = hilbert.hilbert_shards(table(spark, sf_dir, "documents"), [("source", "string"), ("lang", "string"), ("n_chars", "number")], 8, carry=carry)
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "curve")


def op2_html_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_layout.extract(table(spark, sf_dir, "pages"))


def op3_suffix_array_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_decontam.digests(suffix_decontam.find_matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))).drop("longest")


def op4_skip_chain_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return skip_chain_pii.find_personal_data(table(spark, sf_dir, "documents"))


def op5_context_tree_weighting(spark: SparkSession, sf_dir: str) -> DataFrame:
    fold = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(7))
    return tree_weighting.score(table(spark, sf_dir, "documents"), fold != 2)


def op6_weak_label_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return weak_labels.score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_minmax_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minmax_dedup.near_groups(table(spark, sf_dir, "documents"), k=2, percent=80)


def op10_run_length_index_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run_length_index.remove_repeats(table(spark, sf_dir, "documents")).drop("kept")


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def op8_bpe_transducer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_transducer.digests(bpe_transducer.round_trip(table(spark, sf_dir, "documents"), tokenizer_path()))


def op9_extendible_hash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = exact_dedup.exact_groups(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("sha")).alias("text_sha256"))


_OP9_SQL = """
WITH t AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS norm FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept, sha256(norm) AS text_sha256
FROM t WINDOW w AS (PARTITION BY norm)
"""

_OP3_SQL = r"""
WITH RECURSIVE dw AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
iw AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
win AS (SELECT DISTINCT item_id, least(len(w), 10) AS size, array_to_string(list_slice(w, i, i + least(len(w), 10) - 1), ' ') AS grams
        FROM iw, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS u(i) WHERE len(w) > 0),
sizes AS (SELECT DISTINCT size FROM win),
grams AS (SELECT doc_id, i, size, array_to_string(list_slice(w, i, i + size - 1), ' ') AS grams
          FROM dw, sizes, unnest(range(1, greatest(len(w) - size + 1, 0) + 1)) AS u(i)),
hits AS (SELECT g.doc_id, g.i, g.size, win.item_id FROM grams g JOIN win ON g.grams = win.grams AND g.size = win.size),
words AS (SELECT DISTINCT doc_id, unnest(range(i, i + size)) AS at FROM hits),
n AS (SELECT doc_id, count(*) AS n_hit FROM words GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS joined FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hits) GROUP BY doc_id)
SELECT dw.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(joined, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN n USING (doc_id) LEFT JOIN items USING (doc_id)
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_hilbert_shards, op2_html_layout, op3_suffix_array_decontamination, op4_skip_chain_pii, op5_context_tree_weighting, op6_weak_label_quality, op7_minmax_near_dedup, op8_bpe_transducer, op9_extendible_hash_dedup, op10_run_length_index_dedup)}


def oracle_sql() -> dict[str, str]:
    return {"op3_suffix_array_decontamination": _OP3_SQL, "op9_extendible_hash_dedup": _OP9_SQL}
