"""Training over streams of byte records.

``into_state`` trains a codec's model: each micro-batch's blobs go through the
codec's own transforms and are folded into the state of an alias, with the batch
number beside it, so that a restarted stream changes nothing twice. ``live`` and
``into`` count pairs of bytes as they are, in the state store or in a folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions import bits
from ..operators import codec, models, sequence
from ..sources.archive import Archive


def pairs(stream: DataFrame, keys: list[str], data: str = "data") -> DataFrame:
    """(keys, prev, next) of neighbouring bytes within each record; no state is needed."""
    return models.pairs_of_arrays(stream, keys, bits.byte_values(F.col(data)))


def live(stream: DataFrame, keys: list[str], data: str = "data") -> DataFrame:
    """Running cells (keys, prev, next, cnt) for output mode "complete" or "update": at most 65,536 a key."""
    return models.train(pairs(stream, keys, data), keys)


class CellStore:
    """Cells in one Parquet folder per batch number under ``folder``."""

    def __init__(self, spark: SparkSession, folder: str, keys: list[str]):
        self.spark, self.folder, self.keys = spark, folder.rstrip("/"), keys

    def fold(self, batch: DataFrame, number: int) -> None:
        cells = models.train(pairs(batch, self.keys), self.keys)
        # the batch number names the folder: doing a batch again replaces what it wrote before
        cells.write.mode("overwrite").parquet(f"{self.folder}/batch={number}")

    def cells(self) -> DataFrame:
        rows = self.spark.read.option("basePath", self.folder).parquet(self.folder)
        return models.merge(rows.select(*self.keys, "prev", "next", "cnt"), keys=self.keys)


def into(stream: DataFrame, store: CellStore, checkpoint: str, **trigger) -> StreamingQuery:
    """Starts folding ``stream`` (keys, data) into ``store``."""
    write = stream.writeStream.foreachBatch(store.fold).option("checkpointLocation", checkpoint)
    return write.trigger(**(trigger or {"availableNow": True})).start()


def into_state(stream: DataFrame, archive: Archive, addr: str, algorithm: int | str, checkpoint: str, **trigger) -> StreamingQuery:
    """Starts training the state under ``addr`` on ``stream`` (data): each block is a training batch, as in a session's ``train``."""
    number = codec.resolve(algorithm).number

    def fold(batch: DataFrame, batch_id: int) -> None:
        blocks = sequence.chunk(batch.select("data"), min(codec.block_size(algorithm), (1 << 31) - 1))
        cells = codec.training_cells(blocks.select("data"), algorithm, []).collect()  # one state: at most 65,537 cells
        if cells:
            archive.fold_training(addr, number, cells, batch_id)

    write = stream.writeStream.foreachBatch(fold).option("checkpointLocation", checkpoint)
    return write.trigger(**(trigger or {"availableNow": True})).start()


def records(spark: SparkSession, path: str, schema: str, files_per_batch: int | None = None) -> DataFrame:
    """A stream of the Parquet files under a path; ``files_per_batch`` bounds a micro-batch."""
    reader = spark.readStream.schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(path)
