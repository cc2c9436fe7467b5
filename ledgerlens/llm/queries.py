"""The registered queries: each operator over its whole driver table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens.llm import centroids, chat, fim, jaccard, langid, minhash, mixing, packing, passages, quality, token_counts, topk, urls
from ledgerlens.llm.tables import read


def byte_bpe() -> str:
    """The public tokenizer of the token queries."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents packed into sequences of at most 2048 ids."""
    return packing.pack(read(spark, sf_dir, "documents"), byte_bpe(), capacity=2048, end_id=1)


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents mixed by source, weights 3, 1, 2, 150 % of all words, at most twice each."""
    mixed = mixing.mix(read(spark, sf_dir, "documents"), F.array("source"), weights=(3, 1, 2), share=1.5, most=2)
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


def op3_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten highest inner products of every hundredth vector against all others."""
    return topk.top_k(read(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, k=10)


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every text, learned from the documents that are not held out."""
    return langid.identify(read(spark, sf_dir, "documents"))


def op5_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict on every page's url."""
    return urls.judge(read(spark, sf_dir, "pages"))


def op6_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and one that holds control strings, formatted and read back."""
    rows = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.createDataFrame(
        [(-7, turn, role, "\\### Assistant: </turn> ok") for turn, role in enumerate(("user", "assistant"))],
        "conv_id long, turn long, role string, text string",
    )
    return chat.digests(chat.format_conversations(rows.unionByName(probe)))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measures and verdict of every text."""
    return quality.judge(read(spark, sf_dir, "documents"))


def op8_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents linked by 5-word shingles at 0.8."""
    return jaccard.link(read(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text without the passages that an earlier document holds, and the spans."""
    cut = passages.dedup(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return cut.select("doc_id", "text", F.col("__kept").alias("kept"), F.col("__removed").alias("removed"))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every text."""
    return token_counts.token_counts(read(spark, sf_dir, "documents"), byte_bpe(), limit=512)


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text cut into lines, rearranged around its middle and restored from the output."""
    made = fim.transform(read(spark, sf_dir, "documents"), seed=7, fim_percent=100, spm_percent=50)
    columns = ("doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256")
    return fim.restore(made, columns, with_text=False)


def op12_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents linked by 3-word shingles at 0.85."""
    linked = minhash.link(read(spark, sf_dir, "documents"), words=3, percent=85)
    return linked.select("doc_id", "n_shingles", "component_id", "kept")


def op13_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All vectors of 64 components in 8 clusters after 10 rounds."""
    return centroids.cluster(read(spark, sf_dir, "embeddings"), k=8, rounds=10, dims=64, seed=3)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_packing, op2_mixing, op3_exact_topk, op4_language_id, op5_url_filters, op6_chat_formatting,
        op7_quality_rules, op8_ngram_jaccard, op9_substring_dedup, op10_token_counts,
        op11_fill_in_middle, op12_minhash, op13_centroids,
    )
}
