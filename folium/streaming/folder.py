"""A growing folder as a stream: each new file goes through the same stateless stages as in a batch."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from folium.operators import flow
from folium.sources.text import decoded

FILES = "path string, modificationTime timestamp, length bigint, content binary"


def texts(spark: SparkSession, path: str, glob: str = "*.{txt,md}") -> DataFrame:
    """doc_id (the path) and text of each file as it arrives."""
    files = spark.readStream.format("binaryFile").schema(FILES).option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(path).select("path", "content")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"doc_id": pdf["path"], "text": pdf["content"].map(decoded)})

    return files.mapInPandas(run, "doc_id string, text string")


def plain_blocks(spark: SparkSession, path: str, glob: str = "*.txt") -> DataFrame:
    """Paragraphs of each text file as it arrives."""
    return flow.plain_blocks(texts(spark, path, glob))
