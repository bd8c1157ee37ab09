"""One query for each operator over its whole table, the corpus pipeline, and the SQL that some must equal."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import host_rules, prefix_trie, spelling
from ..session import table
from .common import documents, fold, scratch


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .langid import identify

    part = fold(F.col("doc_id"), 5)
    use = F.when((part == 0) | F.col("lang").isNull(), 0).when(part == 4, 2).otherwise(1)
    found = identify(documents(spark, sf_dir), use)
    return found.select("doc_id", (part == 0).alias("held_out"), "lang_pred", "score", "rejected")


def op2_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .token_files import read_token_files, write_token_files

    folder = scratch(spark, "tokens")
    write_token_files(documents(spark, sf_dir), folder, public_tokenizers.path("byte_bpe_50k.json"), end_id=2)
    return read_token_files(spark, folder)


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .pii import detect

    return detect(documents(spark, sf_dir))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .line_dedup import drop_recurring_lines

    text = F.coalesce("text", F.lit(""))
    kept = drop_recurring_lines(documents(spark, sf_dir).select("doc_id", "text"))
    return kept.select("doc_id", F.size(F.split(text, "\n", -1)).cast("long").alias("n_lines_kept"), "n_lines_dropped", F.sha2(text, 256).alias("text_sha256"))


def op5_host_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return host_rules.judge(documents(spark, sf_dir)).select(*host_rules.COLUMNS)


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .suffix_dedup import remove_repeats

    return remove_repeats(documents(spark, sf_dir)).drop("spans")


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .simhash import near_duplicate_groups

    return near_duplicate_groups(documents(spark, sf_dir), words=3)


def op8_hmm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .hmm import score_documents

    scored = score_documents(documents(spark, sf_dir), fold(F.col("doc_id"), 7) != 2)
    return scored.select("doc_id", (~F.col("train")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op9_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .sentencepiece_codec import encode_documents

    return encode_documents(documents(spark, sf_dir), public_tokenizers.path("piece_bpe_32k.model"), check_whole=F.col("doc_id") % 100 == 0, with_ids=False)


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontam import contaminated

    return contaminated(documents(spark, sf_dir), table(spark, sf_dir, "benchmark")).drop("text_key")


def op11_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import toxicity

    held_out = fold(F.col("doc_id"), 4) == 2
    scored = toxicity(documents(spark, sf_dir), table(spark, sf_dir, "labels"), held_out)
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    rebuilt = prefix_trie.graft(prefix_trie.sequences(table(spark, sf_dir, "conversations")))
    return prefix_trie.with_ends_hash(prefix_trie.prefix_trie(rebuilt)).select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(spelling.count_words(documents(spark, sf_dir)).filter("n >= 2"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_language_id": op1_language_id,
    "op2_token_files": op2_token_files,
    "op3_pii": op3_pii,
    "op4_line_dedup": op4_line_dedup,
    "op5_host_rules": op5_host_rules,
    "op6_suffix_dedup": op6_suffix_dedup,
    "op7_simhash": op7_simhash,
    "op8_hmm_score": op8_hmm_score,
    "op9_sentencepiece": op9_sentencepiece,
    "op10_decontamination": op10_decontamination,
    "op11_toxicity": op11_toxicity,
    "op12_prefix_trie": op12_prefix_trie,
    "op13_spelling_variants": op13_spelling_variants,
    "pipeline": pipeline,
}

ORACLES: dict[str, str] = {
    "op5_host_rules": host_rules.ORACLE,
    "op12_prefix_trie": prefix_trie.ORACLE,
    "op13_spelling_variants": spelling.ORACLE,
}
