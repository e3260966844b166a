"""Loading files as they arrive in a folder.

Each micro-batch goes through the same functions as a batch load, under a name made of the stream's own id
and the number of the batch. A batch that is run again after a failure leaves no duplicates, and any number
of streams and batch loads may write into one table.
"""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from factsheet.functions.columns import col
from factsheet.functions.session import spread
from factsheet.functions.text import clean_number
from factsheet.operators.documents import CHUNK_SIZE, OVERLAP, document_units
from factsheet.operators.embed import DIMENSION, embed_text
from factsheet.sources.csv import NA_TOKENS
from factsheet.sources.documents import TXT_FILES, txt_rows
from factsheet.sources.vectors import BUCKETS, add_vectors


def watch_documents(
    spark: SparkSession,
    path: str,
    vectors: str,
    checkpoint: str,
    chunk_size: int = CHUNK_SIZE,
    overlap: int = OVERLAP,
    dimension: int = DIMENSION,
    buckets: int = BUCKETS,
    once: bool = True,
) -> StreamingQuery:
    """Chunk and embed text files as they arrive; ``read_vectors`` reads the resulting table.

    A batch is a load like others: it replaces what the table holds of its files. ``once`` stops after
    the files present at the start.
    """
    files = (
        spark.readStream.option("pathGlobFilter", TXT_FILES)
        .option("recursiveFileLookup", True)
        .text(path, wholetext=True)
    )

    def load(batch: DataFrame, batch_id: int) -> None:
        units = document_units(spread(batch), chunk_size=chunk_size, overlap=overlap)
        embedded = embed_text(units, "full_text", dimension).drop("full_text")
        add_vectors(embedded, vectors, dimension, buckets, key=f"{stream_id(spark, checkpoint)}/{batch_id}")

    return _start(txt_rows(files), load, checkpoint, once)


def watch_rows(
    spark: SparkSession,
    path: str,
    schema: T.StructType,
    output: str,
    checkpoint: str,
    numbers: Sequence[str] = (),
    once: bool = True,
) -> StreamingQuery:
    """Append the rows of CSV files with a known schema to a parquet table.

    Missing-value tokens become null and the text columns named in ``numbers`` are cleaned.
    """
    strings = T.StructType([T.StructField(f.name, T.StringType()) for f in schema.fields])
    files = spark.readStream.schema(strings).option("header", True).option("escape", '"').csv(path)

    def cell(f: T.StructField):
        c = F.when(~col(f.name).isin(*NA_TOKENS), col(f.name))
        return (clean_number(c) if f.name in numbers else c.try_cast(f.dataType)).alias(f.name)

    rows = files.select(*[cell(f) for f in schema.fields])

    def load(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{output}/stream={stream_id(spark, checkpoint)}/batch={batch_id}")

    return _start(rows, load, checkpoint, once)


def stream_id(spark: SparkSession, checkpoint: str) -> str:
    """The id that Spark gave a stream when it made its checkpoint folder."""
    return json.loads(spark.read.text(f"{checkpoint}/metadata", wholetext=True).first()[0])["id"]


def _start(rows: DataFrame, load, checkpoint: str, once: bool) -> StreamingQuery:
    writer = rows.writeStream.foreachBatch(load).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="10 seconds")).start()
