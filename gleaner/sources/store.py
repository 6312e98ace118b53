"""The tables of a store, committed in batches.

All rows of a batch are written as new files first. The batch counts from the
moment its entry is in the log, which is one exclusive creation of a file: a
writer that fails before leaves nothing behind that is read, and of two writers
at once one fails. A batch says which documents' older rows are gone; readers
leave those out. Adding a batch costs what the batch has, whatever the store
holds; compact() writes all living rows as one batch, from which readers start.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.functions.frames import discard, small, staged

SCHEMAS = {
    "documents": "document_id long, source_path string, source_name string, file_type string, doc_type string, total_pages int, title string, subject string, grade string, chapter string, published_year string, source string, updated_at timestamp",
    "chunks": "document_id long, chunk_id long, page_number int, chunk_index int, content string",
    "parents": "document_id long, parent_chunk_id long, page_number int, parent_index int, title string, section_path string, keywords string, content string",
    "map": "document_id long, child_chunk_id long, parent_chunk_id long",
    "embeddings": "document_id long, chunk_id long, vector array<float>, sig long",
    "postings": "document_id long, chunk_id long, length long, term string, tf long",
}
GONE = "document_id long"


def columns(schema: str) -> list[str]:
    return [c.split()[0] for c in schema.split(", ")]


class Store:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def _fs(self, path: str):
        found = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return found, found.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def log(self) -> list[tuple[int, str, str, int]]:
        """(number, kind, part, documents gone) of the batches that count, from the last base on."""
        folder, fs = self._fs(f"{self.path}/_log")
        if not fs.exists(folder):
            return []
        found = []
        for status in fs.listStatus(folder):
            stream = fs.open(status.getPath())
            try:
                kind, part, gone = self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8").split()
            finally:
                stream.close()
            found.append((int(status.getPath().getName()), kind, part, int(gone)))
        found.sort()
        base = max((i for i, entry in enumerate(found) if entry[1] == "base"), default=0)
        return found[base:]

    def _rows(self, name: str, schema: str, parts: list[str]) -> DataFrame:
        """All rows of these parts, with the number of their batch."""
        if not parts:
            return self.spark.createDataFrame([], f"{schema}, batch int")
        folder = f"{self.path}/{name}"
        rows = self.spark.read.schema(schema).option("basePath", folder).parquet(*[f"{folder}/part={p}" for p in parts])
        return rows.select(*columns(schema), F.split_part("part", F.lit("-"), F.lit(1)).cast("int").alias("batch"))

    def read(self, name: str) -> DataFrame:
        """The living rows of a table."""
        log = self.log()
        rows = self._rows(name, SCHEMAS[name], [part for _, _, part, _ in log])
        dead = [part for _, _, part, gone in log if gone]
        if not dead:
            return rows.drop("batch")
        since = self._rows("gone", GONE, dead).groupBy(F.col("document_id").alias("_gone")).agg(F.max("batch").alias("_since"))
        return rows.join(small(since), F.col("document_id") == F.col("_gone"), "left").filter("_since IS NULL OR batch >= _since").drop("batch", "_gone", "_since")

    def commit(self, tables: dict[str, DataFrame], replaced: DataFrame, kind: str = "add") -> None:
        """Adds a batch. replaced: document_id of those whose older rows go."""
        last = max((number for number, *_ in self.log()), default=0)
        part = f"{last + 1:09d}-{uuid.uuid4().hex[:8]}"
        gone = staged(self.read("documents").join(small(replaced.select("document_id").distinct()), "document_id", "left_semi").select("document_id").distinct(), "gone")
        count = 0 if kind == "base" else gone.count()
        if count:
            gone.write.parquet(f"{self.path}/gone/part={part}")
        for name, schema in SCHEMAS.items():
            rows = tables[name].select(*columns(schema)) if name in tables else self.spark.createDataFrame([], schema)
            if name == "postings":  # neighbours in a file are near in the term: readers skip what they don't ask for
                rows = rows.sortWithinPartitions("term")
            rows.write.parquet(f"{self.path}/{name}/part={part}")
        discard(gone)
        path, fs = self._fs(f"{self.path}/_log/{last + 1:09d}")
        stream = fs.create(path, False)
        stream.write(f"{kind} {part} {count}".encode())
        stream.close()

    def compact(self) -> None:
        """All living rows as one batch; files of older ones are left to readers
        that still have them open, and to sweep()."""
        self.commit({name: self.read(name) for name in SCHEMAS}, self.spark.createDataFrame([], GONE), "base")

    def sweep(self) -> None:
        """Deletes the files of batches that no longer count, and of failed ones."""
        log = self.log()
        kept = {f"part={part}" for _, _, part, _ in log}
        for name in (*SCHEMAS, "gone"):
            folder, fs = self._fs(f"{self.path}/{name}")
            for status in fs.listStatus(folder) if fs.exists(folder) else ():
                if status.getPath().getName() not in kept:
                    fs.delete(status.getPath(), True)
        folder, fs = self._fs(f"{self.path}/_log")
        for status in fs.listStatus(folder) if fs.exists(folder) else ():
            if int(status.getPath().getName()) < min((number for number, *_ in log), default=0):
                fs.delete(status.getPath(), True)
