"""The queries and the SQL of this subpackage, for ``__spark_entry__.py``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import ann, mixing, near_dup, packing, passages, quality_lm, quality_rules, secrets, sharding, toxicity
from .common import table


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_ann": lambda s, d: ann.nearest(table(s, d, "embeddings")),
        "op2_near_dup": lambda s, d: near_dup.near_duplicates(table(s, d, "documents")),
        "op3_passages": lambda s, d: passages.repeated_passages(table(s, d, "documents")),
        "op4_packing": lambda s, d: packing.pack(table(s, d, "documents"), tokenizer_path()),
        "op5_toxicity": lambda s, d: toxicity.toxicity(table(s, d, "documents"), table(s, d, "labels")),
        "op6_secrets": lambda s, d: secrets.digest(table(s, d, "documents")),
        "op7_quality_lm": lambda s, d: quality_lm.quality(table(s, d, "documents"), table(s, d, "labels")),
        "op8_quality_rules": lambda s, d: quality_rules.quality_rules(table(s, d, "documents")),
        "op9_mixing": lambda s, d: mixing.mixed(table(s, d, "documents")),
        "op10_sharding": lambda s, d: sharding.shard_documents(table(s, d, "documents")),
    }


def oracle_sql() -> dict[str, str]:
    return {"op2_near_dup": near_dup.oracle(), "op6_secrets": secrets.oracle(), "op8_quality_rules": quality_rules.oracle()}
