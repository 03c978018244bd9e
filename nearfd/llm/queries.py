"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .codebooks import codes_sql, vector_codes
from .decontam import contamination
from .hilbert import hilbert_shards
from .htmltext import extract_pages
from .linecrf import score_quality, train
from .mixing import mix_sources
from .neardup import near_duplicates
from .negatives import hard_negatives
from .rules import judged, word_array
from .secrets import find_secrets, secrets_sql
from .separators import token_counts, tokenizer
from .suffixes import remove_repeats
from .urls import judge_urls

SHARDS = 24
HELD_OUT = "crc32(cast(cast(doc_id AS string) AS binary)) % 5 = 0"
THRESHOLD = 0.3
EOD = 50256  # the id that the vocabulary leaves free
RULES = {"net/": "block", "example.net/en/": "allow", "example.com/de/": "block", "org/fr/": "allow"}
LEVELS = ["domain", "lang", "source"]
SHARE, EPOCHS, SEED = 0.6, 2, 7
DOMAIN_WEIGHTS = {"d0": 4, "d1": 3, "d2": 2, "d3": 1}
LANG_WEIGHTS = {"en": 5, "de": 2, "fr": 2, "es": 1}


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def public_tokenizer(name: str = "byte_bpe_multi_50k.tiktoken"):
    import public_tokenizers

    return tokenizer(public_tokenizers.path(name), public_tokenizers.PATTERN)


def op1_separator_scan(spark, sf_dir):
    return token_counts(read(spark, sf_dir, "documents"), public_tokenizer(), EOD)


def op2_decision_lists(spark, sf_dir):
    out = judged(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op3_weighted_minhash(spark, sf_dir):
    return near_duplicates(read(spark, sf_dir, "documents")).drop("text_key")


def op4_simhash_windows(spark, sf_dir):
    return contamination(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op5_suffix_trees(spark, sf_dir):
    return remove_repeats(read(spark, sf_dir, "documents"), with_text=False).drop("kept_text")


def op6_url_models(spark, sf_dir):
    return judge_urls(read(spark, sf_dir, "pages"), RULES).select("page_id", "host", "path", "rule", "verdict", "score")


def op7_hilbert_shards(spark, sf_dir):
    docs = read(spark, sf_dir, "documents")
    raw = F.coalesce("text", F.lit("")).cast("binary")
    rows = docs.select("doc_id", "lang", "source", (F.octet_length(raw) + 8).cast("long").alias("size"),
                       F.crc32(raw).alias("text_crc32"))
    out = hilbert_shards(rows, ["lang", "source", "size"], SHARDS, "doc_id", tie_cols=["text_crc32"])
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
                      F.lit(None).cast("int").alias("grown_shard"))


def op8_line_crf(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    model = train(docs, read(spark, sf_dir, "labels"), ~F.expr(HELD_OUT))
    out = score_quality(docs.select("doc_id", "text"), model, keep=["doc_id"])
    return out.select("doc_id", F.expr(HELD_OUT).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def domain_of(source):
    return F.concat(F.lit("d"), F.pmod(F.crc32(source.cast("binary")), F.lit(4)).cast("string"))


def source_tree(docs: DataFrame) -> DataFrame:
    """Target tree over the (domain, language, source) leaves that the corpus has, with the weights above."""
    def weight(column: str, table: dict[str, int]):
        out = F.lit(1)
        for k, v in table.items():
            out = F.when(F.col(column) == k, v).otherwise(out)
        return out.cast("double")

    return docs.select(*LEVELS).distinct().select(
        *LEVELS, weight("domain", DOMAIN_WEIGHTS).alias("w_domain"), weight("lang", LANG_WEIGHTS).alias("w_lang"), F.lit(1.0).alias("w_source"))


def op9_hierarchical_budgets(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").select(
        "doc_id", domain_of(F.col("source")).alias("domain"), "lang", "source", F.size(word_array(F.col("text"))).cast("long").alias("n_tokens"))
    tree = source_tree(docs.drop("n_tokens"))
    return mix_sources(docs, tree, LEVELS, "doc_id", "n_tokens", share=SHARE, max_epochs=EPOCHS, seed=SEED)


def op10_text_density(spark, sf_dir):
    return extract_pages(read(spark, sf_dir, "pages"))


def op11_value_dictionaries(spark, sf_dir):
    return vector_codes(read(spark, sf_dir, "embeddings"))


def op12_shared_lists(spark, sf_dir):
    rows = read(spark, sf_dir, "embeddings").select("vec_id", "embedding", F.expr(
        "CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END").alias("label"))
    return hard_negatives(rows, F.expr("id % 100 = 0"))


def op13_secret_ownership(spark, sf_dir):
    return find_secrets(read(spark, sf_dir, "documents")).drop("span_list")


def pipeline(spark, sf_dir):
    from corpus_pipeline import run

    return run(spark, sf_dir)


QUERIES = {f.__name__: f for f in (
    op1_separator_scan, op2_decision_lists, op3_weighted_minhash, op4_simhash_windows, op5_suffix_trees, op6_url_models,
    op7_hilbert_shards, op8_line_crf, op9_hierarchical_budgets, op10_text_density, op11_value_dictionaries, op12_shared_lists,
    op13_secret_ownership, pipeline)}

OP12_SQL = """
WITH r AS (SELECT vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings WHERE label IS NOT NULL AND vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS MATERIALIZED (SELECT a.id AS anchor_id, b.id AS id, a.label = b.label AS same,
    CAST(list_sum(list_transform(list_zip(a.v, b.v), lambda z: z[1] * z[2])) AS BIGINT) AS score
  FROM r a JOIN r b ON a.id <> b.id WHERE a.id % 100 = 0),
p AS (SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5)
SELECT anchor_id, positive_id, CAST(row_number() OVER w AS INTEGER) AS rank, n.id AS negative_id, positive_score, n.score AS negative_score
FROM p JOIN s n USING (anchor_id)
WHERE NOT n.same AND 80 * positive_score <= 100 * n.score AND 100 * n.score <= 100 * positive_score
WINDOW w AS (PARTITION BY anchor_id, positive_id ORDER BY n.score DESC, n.id)
QUALIFY row_number() OVER w <= 5
"""

ORACLE_SQL: dict[str, str] = {
    "op11_value_dictionaries": codes_sql(),
    "op12_shared_lists": OP12_SQL,
    "op13_secret_ownership": secrets_sql(),
}
