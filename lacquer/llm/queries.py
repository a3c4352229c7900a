"""The queries of the llm operators and their SQL, by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lacquer.llm import canon, entities, glyphs, names, packing, reading, tokens

Query = Callable[[SparkSession, str], DataFrame]


def queries() -> dict[str, Query]:
    return {
        "p1_found": glyphs.p1_found,
        "p2_found": entities.p2_found,
        "p2_confidence": entities.p2_confidence,
        "p4_found": names.p4_found,
        "p4_entities": names.p4_entities,
        "p5_found": canon.p5_found,
        "p8_ids": tokens.p8_ids,
        "p9_containers": packing.p9_containers,
        "p9_certificate": packing.p9_certificate,
        "p10_found": reading.p10_found,
        "p10_profile": reading.p10_profile,
    }


def oracle_sql() -> dict[str, str]:
    return {}
