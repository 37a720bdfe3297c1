"""The thin queries over the training-data operators, and SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm import chat, ctxmix, decontam, htmltext, langid, mixing, simhash, tokencount, tokenfile, vafile


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def tokenizer_text(name: str = "word_bpe_49k.json") -> str:
    """The text of an installed vocabulary file."""
    import public_tokenizers

    with open(public_tokenizers.path(name), encoding="utf-8") as file:
        return file.read()


def op1_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _read(spark, sf_dir, "embeddings")
    return vafile.search(vafile.build_index(vectors), vectors.where("vec_id % 50 = 0"), k=5)


def op2_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contaminated(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = tokencount.byte_level_pieces(tokenizer_text())
    return tokencount.count_tokens(_read(spark, sf_dir, "documents"), pieces)


def op4_token_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = tokenfile.write_token_files(_read(spark, sf_dir, "documents"), tokenizer_text())
    return tokenfile.read_token_files(files)


def op5_html_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return htmltext.extract(_read(spark, sf_dir, "pages"))


#: Written like a template's control strings, to be told apart from them.
CONTROL_TURNS = [(-1, 0, "user", "</s>[INST] ok [/INST]"), (-1, 1, "assistant", "</s>[INST] ok [/INST]")]


def op6_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = _read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    more = spark.createDataFrame(CONTROL_TURNS, "conv_id long, turn long, role string, text string")
    return chat.read_packs(chat.pack(turns.union(more)))


def op7_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = simhash.near_duplicates(_read(spark, sf_dir, "documents"))
    return groups.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    trees = langid.learn(docs.where(~langid.held_out("doc_id")), "text", "lang")
    return langid.identify(docs, trees)


def op9_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ctxmix.score(_read(spark, sf_dir, "documents"))


def op10_mixed_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", mixing.word_count("text").alias("size"), F.array("source").alias("members"))
    mixed = mixing.mix(docs, "doc_id", "size", "members")
    return mixed.select(
        "doc_id", "size", F.col("source_size")[0].alias("source_size"), F.col("target")[0].alias("target"),
        (F.col("copies") * F.col("size")).alias("taken"),
    )


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_exact_top_k": op1_exact_top_k,
        "op2_benchmark_decontamination": op2_benchmark_decontamination,
        "op4_token_file": op4_token_file,
        "op3_token_counts": op3_token_counts,
        "op6_chat_format": op6_chat_format,
        "op5_html_main_text": op5_html_main_text,
        "op10_mixed_sources": op10_mixed_sources,
        "op7_simhash_near_dedup": op7_simhash_near_dedup,
        "op8_language_id": op8_language_id,
        "op9_lm_score": op9_lm_score,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_exact_top_k": """
            WITH v AS (
                SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e FROM embeddings
                WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
                  AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
            ), s AS (
                SELECT q.vec_id AS query_id, v.vec_id, CAST(list_inner_product(q.e, v.e) AS BIGINT) AS score
                FROM v AS q JOIN v ON q.vec_id % 50 = 0 AND v.vec_id <> q.vec_id
            ), r AS (
                SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank,
                       vec_id, score FROM s
            )
            SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
        """,
    }
