"""Headline queries on one machine; prints one line of JSON.

BENCH_SF_DIR names the tables, BENCH_CPUS the threads, BENCH_RUNS how often each
query is timed (the median counts) after one run that isn't. BENCH_DUCKDB=1 also
"""

from __future__ import annotations

import json
import os
import shutil
import sys
import time
from pathlib import Path
from statistics import median

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.plans import catalogue, oracles
from gleaner.plans.engine import Engine

HEADLINE = ["dense_topk", "lsh_topk", "bm25_topk", "bm25_multi_variant", "rrf_fuse", "hybrid_retrieve", "evidence_sentences", "chunks_children", "clean_text", "sections", "hydrate_join", "doc_freq"]
#: The store's folder, beside the tables that queries stage; made anew by each run.
WORK = Path(os.environ.get("BENCH_WORK", "/tmp/gleaner-bench"))


def timed(name: str, make, runs: int, clear=lambda: None) -> float:
    """Median seconds; told on the error stream as they come."""
    each = []
    for _ in range(runs + 1):
        clear()
        began = time.perf_counter()
        made = make()
        if isinstance(made, DataFrame):
            made.write.format("noop").mode("overwrite").save()
        each.append(time.perf_counter() - began)
    print(f"{name}: {median(each[1:]):.3f} s", file=sys.stderr, flush=True)
    return round(median(each[1:]), 3)


def with_duckdb(sf_dir: str, cpus: str, runs: int) -> dict[str, float]:
    import duckdb

    con = duckdb.connect(config={"threads": int(cpus)})
    for path in Path(sf_dir).glob("*.parquet"):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM read_parquet('{path}')")
    sql = oracles.sql()
    return {name: timed(f"duckdb {name}", lambda name=name: con.execute(sql[name]).fetchall(), runs) for name in HEADLINE if name in sql}


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus, runs = os.environ.get("BENCH_CPUS", "8"), int(os.environ.get("BENCH_RUNS", "1"))
    shutil.rmtree(WORK, ignore_errors=True)
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.files.maxPartitionBytes", "4m")
        .config("spark.sql.warehouse.dir", f"{WORK}/warehouse")
        .config("spark.checkpoint.dir", f"{WORK}/checkpoints")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    made, seconds = catalogue.queries(), {}
    for name in HEADLINE:
        seconds[name] = timed(name, lambda name=name: made[name](spark, sf_dir), runs, spark.catalog.clearCache)

    # the same questions over a stored index, and what storing costs: each document as a text file
    t = catalogue.Tables(spark, sf_dir)
    files = t.chunks.select("source_path", "source_name", "file_type", F.col("content").cast("binary").alias("content"))
    folder = iter(range(99))
    seconds["ingest"] = timed("ingest", lambda: Engine(spark, f"{WORK}/store{next(folder)}").ingest(files), runs)
    engine = Engine(spark, f"{WORK}/store0")
    seconds["stored_retrieve"] = timed("stored_retrieve", lambda: engine.retrieve(t.questions), runs)
    found = {"metric": "total seconds of headline queries", "value": round(sum(seconds[n] for n in HEADLINE), 3), "unit": "sec", "queries": seconds, "sf": os.path.basename(sf_dir.rstrip("/"))}
    if os.environ.get("BENCH_DUCKDB") == "1":
        found["duckdb"] = with_duckdb(sf_dir, cpus, runs)
    print(json.dumps(found))
    spark.stop()
    shutil.rmtree(WORK, ignore_errors=True)


if __name__ == "__main__":
    main()
