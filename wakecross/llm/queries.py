"""The queries of this subpackage over the given tables."""

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wakecross.llm import (
    ball_tree, bpe, collocations, decontamination, html_text, jaccard_join, language_id, language_model, passages, quality, secrets,
    topk, toxicity,
)

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of every document and back."""
    return bpe.digests(_table(spark, sf_dir, "documents"), VOCABULARY, "doc_id")


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark passages in every document."""
    found = decontamination.contaminated_spans(
        _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), "doc_id"
    )
    return decontamination.digest(found)


def op3_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near duplicates among all documents."""
    return jaccard_join.near_duplicates(_table(spark, sf_dir, "documents"))


def op9_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log probabilities of every document under a model of nine tenths of them."""
    documents = _table(spark, sf_dir, "documents").select(
        "doc_id", "text", language_model.held_out().alias("held_out")
    )
    model = language_model.train(documents.where("not held_out"))
    scored = language_model.score(documents, model, "doc_id", "held_out")
    return scored.select(
        "doc_id", "held_out", "n_tokens", "n_known", F.lit(model.totals["tokens"]).cast("long").alias("train_tokens"),
        "base_score", "score",
    )


def _judged(scored: DataFrame, held_out) -> DataFrame:
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op1_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document that shares a passage of fifty words or more with others, the spans and the others."""
    return passages.repeated_spans(passages.shared_passages(_table(spark, sf_dir, "documents")))


def op2_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in every document, through all layers of encoding."""
    return secrets.secrets(_table(spark, sf_dir, "documents"), "doc_id")


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The quality of every document."""
    documents = _table(spark, sf_dir, "documents")
    model = quality.fit(documents, _table(spark, sf_dir, "labels"))
    return _judged(quality.score(documents, model, "doc_id"), quality.fold() == 1)


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The toxicity of every document."""
    documents = _table(spark, sf_dir, "documents")
    fitted = toxicity.fit(documents, _table(spark, sf_dir, "labels"))
    return _judged(toxicity.score(documents, fitted, "doc_id"), language_model.held_out(toxicity.FOLDS))


def op5_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nearest vectors of every twentieth."""
    return topk.top_k(_table(spark, sf_dir, "embeddings"))


def op8_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    return html_text.extract(_table(spark, sf_dir, "pages"), "page_id", "url")


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Phrases that keep together in each language."""
    return collocations.collocations(_table(spark, sf_dir, "documents"))


def op12_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document."""
    documents = _table(spark, sf_dir, "documents").withColumn("held_out", language_model.held_out(language_id.FOLDS))
    model = language_id.fit(documents)
    return language_id.identify(documents, model, "doc_id", "held_out")


def op13_ball_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents that rank highest for every benchmark item."""
    return ball_tree.ranked(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


QUERIES = {
    "op1_passages": op1_passages,
    "op2_secrets": op2_secrets,
    "op4_bpe": op4_bpe,
    "op3_jaccard_join": op3_jaccard_join,
    "op5_topk": op5_topk,
    "op6_decontamination": op6_decontamination,
    "op7_quality": op7_quality,
    "op8_html_text": op8_html_text,
    "op9_language_model": op9_language_model,
    "op10_toxicity": op10_toxicity,
    "op11_collocations": op11_collocations,
    "op12_language_id": op12_language_id,
    "op13_ball_tree": op13_ball_tree,
}
