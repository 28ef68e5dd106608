"""Placement of arriving sequences on a fixed backbone (an extension: the batch modes have no streams)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import DataStreamWriter

from strandflow.plans import modes


def place_stream(sequences: DataFrame, backbone: DataFrame, path: str, options: modes.Options | None = None) -> DataStreamWriter:
    """A writer that places each micro-batch of sequences(name, seq) and writes its rows under path/batch=N.

    The backbone stays as it is, so batches are independent and a repeated batch
    overwrites its own folder.
    """

    def write(batch: DataFrame, number: int) -> None:
        rows = modes.place(batch.sparkSession, batch, backbone, options)
        rows.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return sequences.writeStream.foreachBatch(write)
