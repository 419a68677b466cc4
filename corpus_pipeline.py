"""Corpus pipeline: language ID, quality rules, near-dedup, secret scans, packing.

Each stage works on all that its predecessor kept. The first four return the columns of documents.

Defined results: texts that are null, empty or without a letter go in the first stage, and all go where no language can be
learned; null lang and source are groups of their own; of rows with equal id and text near-dedup keeps one, and it keeps
rows with a null doc_id, which no class can name; a null text that a later stage is given stays null up to packing, where it is the end id alone; empty tables
give empty results; other columns are left out, so their names cannot clash.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: A text is kept if its best language has this many times the share of an even guess among the languages learned.
MIN_LANGUAGE_LIFT = 1.4


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter, or of no language in particular, go."""
    from wickwork.llm.language_id import identify, train

    net = train(docs)
    least = MIN_LANGUAGE_LIFT / len(net.langs) if net and len(net.langs) > 1 else 0.0
    return identify(docs, net, COLUMNS).filter((F.col("lang_pred") != "und") & (F.col("score") >= least)).select(*COLUMNS)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rule, and robust outliers of their language and source, go."""
    from wickwork.llm.quality_rules import quality_rules as judged

    return judged(docs, carry=COLUMNS).filter("kept").select(*COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal or similar texts stays."""
    from wickwork.llm.minhash_dedup import keep_one

    return keep_one(docs.select(*COLUMNS))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by their kind in brackets; every document stays."""
    from wickwork.llm.secret_scan import redact_secrets

    found = redact_secrets(docs, carry=COLUMNS)
    changed = F.col("n_secrets") > 0
    text = F.when(changed, F.col("redacted")).otherwise(F.col("text"))
    return found.select("doc_id", text.alias("text"), "lang", "source", F.when(changed, F.length("redacted").cast("bigint")).otherwise(F.col("n_chars")).alias("n_chars"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of at most 2048 tokens."""
    import public_tokenizers

    from wickwork.llm.packing import pack_documents

    return pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"), window=2048, end_id=1)


STAGES = [("language ID", language_id), ("quality rules", quality_rules), ("near-dedup", near_dedup), ("secret scans", secret_scan), ("packing", packing)]
#: A trained network and consistent samples are no SQL; tests/llm hold each stage's operator against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage, applied to the table documents."""
    from wickwork.llm.common import staged, table

    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = staged(docs, name.replace(" ", "-"))
    return docs
