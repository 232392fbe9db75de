"""A training corpus in five stages: quality rules, line dedup, near-dedup, source mixing, tokens.

Each stage is (name, function of (spark, docs, sf_dir)). A stage works on all rows that the one before it kept, and its
decisions take effect: rows go, lines go, rows are repeated. All stages but the last return the columns of the
documents table; the last returns the ids. Empty input passes through every stage.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from segmark.llm import linededup, mixing, pieces, quality, simhash
from segmark.session import cut_path


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that neither the base rules nor the learned list reject.

    A null or empty text has no words and goes. Repeated rows are judged alike; further columns are carried along.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    judged, verdict = quality.judge(docs, quality.fit(docs, labels))
    return judged.filter(F.col(f"`{verdict}`.kept")).select(*docs.columns)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that an earlier document has; ``n_chars`` follows the text, documents left without a word go."""
    out, lines = linededup.deduplicate(docs)
    changed = F.col(f"`{lines}`.n_dropped") > 0
    out = out.withColumn("n_chars", F.when(changed, F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return out.filter(~changed | F.col("text").rlike(r"[^\x20\x09-\x0D]")).select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: five-word shingles alike to 0.8 or more."""
    return simhash.deduplicate_similar(docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them.

    Null is a source of its own; rows without words are taken as their source's rate says. Ties and repeated rows are
    told apart by a row number that is written first. Columns stay.
    """
    return mixing.mix(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of each text, checked to give the text again (up to marks, which read as blanks).

    A row for every row, repeated ones too; a null or empty text has no ids.
    """
    model = public_tokenizers.path("piece_bpe_32k.model")
    out, name = pieces.round_trip(docs, model)
    ids, decoded = F.col(f"`{name}`.ids"), F.col(f"`{name}`.decoded")
    same = decoded == F.translate(F.coalesce("text", F.lit("")), pieces.MARK, " ")
    return out.select("doc_id", "lang", "source", F.size(ids).cast("long").alias("n_tokens"), ids.alias("ids"), same.alias("lossless"))


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", line_dedup),
    ("simhash near-dedup", near_dedup),
    ("source mixing", source_mix),
    ("sentencepiece", tokens),
]

#: The learned rules, the search for near copies and the encoder have no form in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents, each written to the shared folder and read by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        path = cut_path(spark, f"pipeline-{name.replace(' ', '-')}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
