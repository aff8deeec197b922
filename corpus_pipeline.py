"""From raw documents to encoded training rows: five stages, each on all that the one before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import common, decontaminate, line_dedup, near_duplicates, quality, segmentations


def _measured(docs: DataFrame, like: DataFrame) -> DataFrame:
    """Documents whose text changed, with ``n_chars``, where there is one, counted anew (null for a null text)."""
    if "n_chars" in like.columns:
        docs = docs.withColumn("n_chars", F.char_length("text").cast(like.schema["n_chars"].dataType))
    return docs.select(*[F.col(f"`{c}`") for c in like.columns])


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base test or whose posterior probability of quality is below a half go.

    Null and empty texts fail the base test and go. Repeated rows and rows with null ids are judged each for itself
    and count as often as they occur in the estimate. No rows give none. All columns come back, whatever their names.
    """
    return quality.passing(docs)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that at least five documents share stay only in the document with the largest id.

    Null ids are one document below all others. Rows that share an id are one document for the counts, each losing
    its own lines. Null and empty texts stay; a text that loses all lines becomes empty. No rows give none.
    """
    return _measured(line_dedup.without_lines(docs), docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document with the smallest id stays, once if its row is repeated.

    A null id is smaller than all others. Null and empty texts are copies of each other: one of them stays. A row
    that shares its id with another text is judged by its own text. No rows give none.
    """
    return near_duplicates.one_of_each(docs)


def cut_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that occur in the benchmark are cut out of the texts; every row stays.

    Rows are treated each for itself, whatever their ids. Null and empty texts stay as they are, a null benchmark
    text cuts nothing, and an empty benchmark or an empty table changes nothing.
    """
    rest = [c for c in docs.columns if c not in ("doc_id", "text")]
    found = decontaminate.removal_spans(docs, common.table(spark, sf_dir, "benchmark"), carry=rest)
    whole = decontaminate.without_spans(found).select("doc_id", F.col("clean").alias("text"), *[F.col("rest")[c].alias(c) for c in rest])
    return _measured(whole, docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sampled segmentations of every text: piece counts, checksums, log-probabilities, inclusion probabilities.

    One row per document row; a null id stays null. Null and empty texts have one segmentation, of no pieces. Other
    columns end here. No rows give none.
    """
    import public_tokenizers

    return segmentations.digests(segmentations.encode_samples(docs, public_tokenizers.path("piece_bpe_32k.model")))


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", drop_lines),
    ("n-gram Jaccard join", drop_near_duplicates),
    ("benchmark decontamination", cut_benchmark),
    ("SentencePiece encoding", encode),
]

#: The first stage estimates its rules' accuracies by iteration, the last samples: neither has an SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``, each written before the next one reads it.

    One row per document that is left, columns as ``encode`` gives them; no documents give no rows. What a stage wrote
    goes when the next has been written, the operators' own tables included.
    """
    docs = common.table(spark, sf_dir, "documents")
    done: list[str] = []
    for name, stage in STAGES:
        with common.tracked() as made:
            docs, at = common.staged(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        common.remove(spark, *done, *(x for x in made if x != at))
        done = [at]
    return docs
