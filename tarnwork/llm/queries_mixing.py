"""Queries of the source mix."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tarnwork.llm.mixing import mix, shares, sized
from tarnwork.session import cut, spread, table


def p8_mix(spark: SparkSession, d: str) -> DataFrame:
    """The documents of every mix with their repeat counts."""
    sizes = cut(sized(spread(table(spark, d, "documents").select("doc_id", "text", "source")), "doc_id", "text", "source"))
    return mix(sizes, "doc_id", table(spark, d, "mix_targets"))


def p8_shares(spark: SparkSession, d: str) -> DataFrame:
    """Target shares against the shares reached."""
    return shares(p8_mix(spark, d), table(spark, d, "mix_targets"))


QUERIES = {"p8_mix": p8_mix, "p8_shares": p8_shares}
SQL: dict[str, str] = {}
