"""A stream of N-Quads lines through stateless patterns.

The push interface of a parser becomes a streaming read of files as they come;
what a triple pattern or filter does needs no state, so results are appended.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from ..sources.quads import SCHEMA
from ..sources.readers import quad_line


def read_lines(spark: SparkSession, folder: str) -> DataFrame:
    """A streaming table of quads from N-Quads files that appear in a folder."""
    lines = spark.readStream.format("text").load(folder)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            yield pd.DataFrame([q for line in part["value"] for q in quad_line(line, "stream")], columns=["s", "p", "o", "g"])

    return lines.mapInPandas(run, SCHEMA)


def matches(quads: DataFrame, pattern: str):
    """The solutions of a SPARQL group without joins over a stream, as a streaming table."""
    from ..dataset import Dataset

    return Dataset.of_quads(quads).query("SELECT * WHERE " + pattern).df
