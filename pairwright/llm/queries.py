"""The corpus operators' queries, each a thin call of its operator, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from pairwright.llm import audio, base_queries, chat, language, licenses, mixing, neighbours, pieces, secrets, simhash, toxicity


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_simhash": simhash.query,
        "op2_mixing": mixing.query,
        "op3_secrets": secrets.query,
        "op4_toxicity": toxicity.query,
        "op5_neighbours": neighbours.query,
        "op6_audio": audio.query,
        "op7_pieces": pieces.query,
        "op8_licenses": licenses.query,
        "op9_language": language.query,
        "op10_chat": chat.query,
        "pieces_by_scores": pieces.by_scores_query,
        **base_queries.queries(),
    }


def oracle_sql() -> dict[str, str]:
    return {"op5_neighbours": neighbours.SQL, "op10_chat": chat.SQL, **base_queries.oracle_sql()}
