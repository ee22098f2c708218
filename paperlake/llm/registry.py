"""Queries of the subpackage, for the driver."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .chat import ORACLE as _CHAT
from .chat import op2_chat
from .html import op6_html
from .jaccard import op9_jaccard
from .mixing import op4_mixing
from .ogg import op10_media
from .quality import op5_quality
from .secrets import op8_secrets
from .sentencepiece import op1_sentencepiece
from .sharding import op13_sharding
from .toxicity import op7_toxicity
from .trie import ORACLE as _TRIE
from .trie import op11_trie
from .warc import op3_warc
from .whitening import op12_whitening

__all__ = ["oracle_sql", "queries"]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _documents(operator: Callable[[DataFrame], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: operator(_table(spark, sf_dir, "documents"))


def _labelled(operator: Callable[[DataFrame, DataFrame], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: operator(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """One query for each numbered operator."""
    return {
        "op1_sentencepiece": _documents(op1_sentencepiece),
        "op2_chat": lambda spark, sf_dir: op2_chat(_table(spark, sf_dir, "conversations")),
        "op3_warc": lambda spark, sf_dir: op3_warc(_table(spark, sf_dir, "pages")),
        "op4_mixing": _documents(op4_mixing),
        "op5_quality": _labelled(op5_quality),
        "op6_html": lambda spark, sf_dir: op6_html(_table(spark, sf_dir, "pages")),
        "op7_toxicity": _labelled(op7_toxicity),
        "op8_secrets": _documents(op8_secrets),
        "op9_jaccard": _documents(op9_jaccard),
        "op10_media": _documents(op10_media),
        "op11_trie": lambda spark, sf_dir: op11_trie(_table(spark, sf_dir, "conversations")),
        "op12_whitening": lambda spark, sf_dir: op12_whitening(_table(spark, sf_dir, "embeddings")),
        "op13_sharding": _documents(op13_sharding),
    }


def oracle_sql() -> dict[str, str]:
    """SQL twins, where SQL can express the operator."""
    return {"op2_chat": _CHAT, "op11_trie": _TRIE}
