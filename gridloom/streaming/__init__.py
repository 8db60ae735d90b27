"""Files as they arrive: a folder watched with Structured Streaming, each new file's tables in long form.

Rows of a file are decoded by the stream itself (`grids`), without state. A file arrives whole, so detection needs no
state across batches either: `tidy_files` judges each micro-batch's sheets and appends their long form to a table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from gridloom.operators import model
from gridloom.sources import csvgrid, xlsx

_FILES = "path string, modificationTime timestamp, length long, content binary"


def grids(spark: SparkSession, folder: str, files_per_batch: int = 1000) -> DataFrame:
    """A stream of (source, r, cells) of the .csv, .tsv and .xlsx files that come into the folder."""

    def of(kinds: str) -> DataFrame:
        stream = spark.readStream.format("binaryFile").schema(_FILES).option("maxFilesPerTrigger", files_per_batch).option("pathGlobFilter", kinds)
        return stream.load(folder).select(F.col("path").alias("source"), "content")

    return csvgrid.parsed(of("*.{csv,tsv}")).union(xlsx.parsed(of("*.xlsx")))


def tidy_files(spark: SparkSession, folder: str, out: str, checkpoint: str, strategy: str | None = None, **trigger) -> StreamingQuery:
    """Appends (source, table_no, r, c, stubs, labels, value) of every table of every new file to the Parquet table `out`,
    a folder for each batch: a batch run again after a failure replaces its own rows."""

    def batch(rows: DataFrame, number: int) -> None:
        rows = rows.persist()
        model.tidy(rows, model.models(rows, strategy)).write.mode("overwrite").parquet(f"{out}/batch={number}")
        rows.unpersist()

    writer = grids(spark, folder).writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"availableNow": True})).start()
