"""Wall time of the headline queries. Prints one JSON line.

Registered queries are timed whole, from the supplied tables to the result. The ``stored_*``
entries time the operators alone on a query log that was ingested once (``ingest_text``), which is
"""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from themelift.operators.gram_match import gram_topk, query_gram_stats, with_gram_text  # noqa: E402
from themelift.operators.hard_match import gram_index, gram_stats, hard_match, hard_match_indexed  # noqa: E402
from themelift.operators.posting_blocks import block_match, posting_blocks, write_blocks  # noqa: E402
from themelift.operators.typo_match import typo_index, typo_join  # noqa: E402
from themelift.operators.vector_match import MIN_SIM, vector_topk  # noqa: E402
from themelift.plans import fixtures  # noqa: E402
from themelift.plans.catalog import REGISTRY  # noqa: E402
from themelift.plans.pipeline import match_themes  # noqa: E402
from themelift.sizing import scratch_dir, stage  # noqa: E402
from themelift.sources.query_log import with_match_text  # noqa: E402

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
VECTOR_TURNS = int(os.environ.get("BENCH_VECTOR_TURNS", "500"))
CPUS = os.environ.get("BENCH_CPUS", "8")
HEADLINE = [
    "flagship_match",
    "hard_match",
    "hard_match_indexed",
    "flagship_vectors",
    "vector_topk",
    "gram_topk",
    "lexical_topk",
    "merge_hits",
    "theme_rollup",
    "rule_labels",
    "validation_requests",
    "job_detail",
]


def session() -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{CPUS}]")
        .appName("bench")
        .config("spark.sql.shuffle.partitions", CPUS)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.ui.retainedStages", "100000")
        .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="bench-"))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shuffle_bytes(spark: SparkSession) -> int:
    sc = spark.sparkContext
    none = sc._gateway.new_array(sc._jvm.double, 0)
    store = sc._jsc.sc().statusStore()
    stages = store.stageList(None, False, False, none, sc._jvm.java.util.ArrayList())
    return sum(stages.apply(i).shuffleWriteBytes() for i in range(stages.size()))


def timed(spark: SparkSession, make) -> dict:
    """Seconds to compute every column of the result; rows are counted on the way."""
    before, start = shuffle_bytes(spark), time.time()
    df: DataFrame = make()
    seen = Observation()
    df.observe(seen, F.count(F.lit(1)).alias("rows")).write.format("noop").mode("overwrite").save()
    return {
        "sec": round(time.time() - start, 3),
        "rows": seen.get["rows"],
        "shuffle_bytes": shuffle_bytes(spark) - before,
    }


def main() -> None:
    spark = session()
    timed(spark, lambda: REGISTRY["flagship_match"](spark, SF_DIR))  # starts the JVM's code paths
    runs = {name: timed(spark, lambda n=name: REGISTRY[n](spark, SF_DIR)) for name in HEADLINE}

    tables: dict[str, DataFrame] = {}

    def ingest() -> DataFrame:
        log = with_gram_text(with_match_text(fixtures.pair_log(spark, SF_DIR)))
        tables["log"] = stage(log, "log")
        tables["kw"] = stage(fixtures.pair_keywords(spark, SF_DIR), "keywords")
        tables["stats"] = stage(gram_stats(tables["log"]), "stats")
        tables["q_stats"] = stage(query_gram_stats(tables["log"]), "q-stats")
        return tables["log"]

    runs["ingest_text"] = timed(spark, ingest)
    kw, log, stats = tables["kw"], tables["log"], tables["stats"]
    vectors = stage(fixtures.rotated_vectors(spark, SF_DIR, VECTOR_TURNS, 0.002), "vectors")
    kw_vectors = stage(fixtures.vector_keywords(spark, SF_DIR), "kw-vectors")
    runs["ingest_index"] = timed(spark, lambda: tables.setdefault("index", stage(gram_index(log), "index")))

    def index_blocks() -> DataFrame:
        path = scratch_dir(spark, "blocks")
        write_blocks(posting_blocks(log), path)
        tables["blocks"] = spark.read.parquet(path)
        return tables["blocks"]

    few = stage(kw.where(F.length("keyword") >= 6).orderBy("keyword").limit(10), "few")
    runs["ingest_blocks"] = timed(spark, index_blocks)
    runs["stored_block_match"] = timed(spark, lambda: block_match(kw, tables["blocks"], log))
    runs["stored_block_match_few"] = timed(spark, lambda: block_match(few, tables["blocks"], log))
    runs["stored_hard_match_few"] = timed(spark, lambda: hard_match(few, log, stats))
    runs["ingest_typos"] = timed(spark, lambda: tables.setdefault("typos", stage(typo_index(log), "typos")))
    runs["stored_typo_join"] = timed(spark, lambda: typo_join(kw, log, tables["typos"]))
    runs["stored_hard_match"] = timed(spark, lambda: hard_match(kw, log, stats))
    runs["stored_hard_match_indexed"] = timed(spark, lambda: hard_match_indexed(kw, tables["index"], log, stats))
    runs["stored_gram_topk"] = timed(spark, lambda: gram_topk(kw, log, min_sim=MIN_SIM, counts=tables["q_stats"]))
    runs["stored_vector_topk"] = timed(spark, lambda: vector_topk(kw_vectors, vectors))
    runs["stored_match_themes"] = timed(spark, lambda: match_themes(kw, log, stats=stats, q_stats=tables["q_stats"], typos=tables["typos"]))
    line = {
        "metric": "total wall time of the headline queries",
        "value": round(sum(r["sec"] for r in runs.values()), 3),
        "unit": "sec",
        "queries": {name: r["sec"] for name, r in runs.items()},
        "sf": os.path.basename(SF_DIR.rstrip("/")).removeprefix("sf"),
        "rows": {name: r["rows"] for name, r in runs.items()},
        "shuffle_bytes": {name: r["shuffle_bytes"] for name, r in runs.items()},
        "cpus": CPUS,
    }
    spark.stop()
    print(json.dumps(line))


if __name__ == "__main__":
    main()
