"""The registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from wickwork.llm import oracle
from wickwork.llm.common import table


def op1_additive_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    from wickwork.llm.additive_ann import nearest

    return nearest(table(spark, sf_dir, "embeddings"))


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from wickwork.llm.pii import find_pii

    return find_pii(table(spark, sf_dir, "documents"))


def op3_piece_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from wickwork.llm.piece_codec import encode_documents

    return encode_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"), digests=True)


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from wickwork.llm.packing import pack_documents

    return pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), window=2048, end_id=1)


def op5_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from wickwork.llm.minhash_dedup import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "class_id")


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    from wickwork.llm.url_filter import url_filter

    return url_filter(table(spark, sf_dir, "pages"))


def op7_compression_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from wickwork.llm.compression_quality import score_quality

    return score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from wickwork.llm.language_id import predict_language

    return predict_language(table(spark, sf_dir, "documents"))


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from wickwork.llm.secret_scan import find_secrets

    return find_secrets(table(spark, sf_dir, "documents"))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from wickwork.llm.quality_rules import quality_rules

    return quality_rules(table(spark, sf_dir, "documents")).drop("lang", "source")


def op11_parity_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from wickwork.llm.parity_join import set_components

    return set_components(table(spark, sf_dir, "documents"))


def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from wickwork.llm.token_alignment import align_tokenizers

    return align_tokenizers(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"), digests=True)


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    from wickwork.llm.vector_codes import vector_codes

    return vector_codes(table(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_additive_ann": op1_additive_ann,
    "op2_pii": op2_pii,
    "op3_piece_codec": op3_piece_codec,
    "op4_packing": op4_packing,
    "op5_minhash_dedup": op5_minhash_dedup,
    "op6_url_filter": op6_url_filter,
    "op7_compression_quality": op7_compression_quality,
    "op8_language_id": op8_language_id,
    "op9_secret_scan": op9_secret_scan,
    "op10_quality_rules": op10_quality_rules,
    "op11_parity_join": op11_parity_join,
    "op12_token_alignment": op12_token_alignment,
    "op13_vector_codes": op13_vector_codes,
}

ORACLE_SQL: dict[str, str] = {"op11_parity_join": oracle.parity_join_sql(), "op13_vector_codes": oracle.vector_codes_sql()}
