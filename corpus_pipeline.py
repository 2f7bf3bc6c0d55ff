"""Documents to packed token sequences: language ID, line dedup, near-duplicate removal, PII masking, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of docs, extra ones
with any name included. Rows whose text is null or has no letter are rejected by the first stage, so what follows
gets text; the stages also take such rows by themselves. An empty table passes as one.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.llm import language_id, line_dedup, packing, pii, shingle_join
from factloom.llm.common import table, written

#: A document whose likeliest language gets less than this is in none that was learned.
LEAST_SCORE = 0.3


def _with(docs: DataFrame, made: tuple[str, ...], change: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``change`` on docs, whose own columns with the names it makes are set apart meanwhile."""
    names = {c: f"__own_{i}" for i, c in enumerate(docs.columns) if c in made}
    changed = change(docs.withColumnsRenamed(names))
    return changed.select(*(F.col(f"`{names.get(c, c)}`").alias(c) for c in docs.columns))


def _retexted(docs: DataFrame, text: str) -> DataFrame:
    """``docs`` with the text in column ``text`` for its own, and its length."""
    new = {"text": F.col(text)}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(F.col(text).eqNullSafe(F.col("text")), F.col("n_chars")).otherwise(F.length(text)).cast(docs.schema["n_chars"].dataType)
    return docs.withColumns(new)


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that are in no learned language; learns from the labels of those that aren't held out."""
    model = language_id.fit(docs.filter(~language_id.learned_rows(F.col("doc_id"), 4, 2)))
    chosen = (F.col("lang_pred") != "und") & (F.col("score") >= LEAST_SCORE)
    return _with(docs, ("lang_pred", "score"), lambda d: language_id.predict(d, model).filter(chosen))


def remove_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Deletes later copies of repeated runs of lines, and documents that are nothing else."""

    def change(d: DataFrame) -> DataFrame:
        left = line_dedup.dedup_lines(d.withColumn("__old", F.length("text")))
        left = left.filter(~((F.col("n_removed") > 0) & (F.trim("text") == "")))
        return left.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.length("text")).otherwise(F.col("n_chars"))) if "n_chars" in d.columns else left

    kind = docs.schema["n_chars"].dataType if "n_chars" in docs.columns else None
    out = _with(docs, ("n_lines", "n_removed", "__old"), change)
    return out.withColumn("n_chars", F.col("n_chars").cast(kind)) if kind else out


def remove_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the least id of each group of near copies (five words, similarity 0.8 or more), once."""
    groups = written(shingle_join.similar_groups(docs, with_hash=True), "groups")
    later = F.col("component_id").isNotNull() & ~F.col("component_id").eqNullSafe(F.col("doc_id"))
    gone = groups.filter(later).select(F.col("doc_id").alias("__k"), F.col("text_hash").alias("__th")).distinct()
    own = F.xxhash64("text")
    kept = docs.join(gone, docs.doc_id.eqNullSafe(gone["__k"]) & (own == gone["__th"]), "left_anti")
    if groups.groupBy("doc_id", "text_hash").count().filter("count > 1").limit(1).count():
        kept = kept.withColumn("__th", own).dropDuplicates(["doc_id", "__th"]).drop("__th")
    return kept


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Puts the kind in place of each span of personal data."""
    made = ("base", "spans", "__masked", *(f"n_{k}" for k in pii.KINDS))
    return _with(docs, made, lambda d: _retexted(pii.find_pii(d, masked_to="__masked"), "__masked"))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of documents in sequences of 2048 tokens, with their ids."""
    import public_tokenizers

    return packing.pack(docs.select("doc_id", "source", "text"), public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("language ID", identify_language),
    ("line dedup", remove_repeated_lines),
    ("n-gram Jaccard join", remove_near_duplicates),
    ("PII", mask_personal_data),
    ("packing", pack_sequences),
]

#: Models, similarity joins and tokenizers are beyond SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
