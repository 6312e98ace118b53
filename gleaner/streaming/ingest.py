"""Incremental ingestion: a folder as a stream of files."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from gleaner.plans.engine import Engine


def watch(engine: Engine, folder: str, progress: str, once: bool = True) -> StreamingQuery:
    """Ingests new files of a folder in micro-batches. A batch that is run again
    after a failure replaces the same documents, so nothing is doubled."""
    stream = engine.spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("recursiveFileLookup", "true").load(folder)

    def batch(rows: DataFrame, _: int) -> None:
        name = F.element_at(F.split("path", "/"), -1)
        found = rows.select(F.col("path").alias("source_path"), name.alias("source_name"), F.lower(F.regexp_extract(name, r"(\.[^.]*)$", 1)).alias("file_type"), "content")
        engine.ingest(found).write.format("noop").mode("overwrite").save()

    writer = stream.writeStream.foreachBatch(batch).option("checkpointLocation", progress)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="30 seconds")).start()
