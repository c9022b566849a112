"""The registered queries: one per operator, over the supplied tables."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from themelift.functions import ids, text, vectors
from themelift.functions.grams import GRAM
from themelift.operators import history, inference, merge, verdicts
from themelift.operators.gram_match import gram_topk, with_gram_text
from themelift.operators.hard_match import gram_index, hard_match, hard_match_indexed, write_gram_index
from themelift.operators.keywords import dedup_keywords
from themelift.operators.lexical import lexical_topk
from themelift.operators.posting_blocks import LONG, block_match, posting_blocks, write_blocks
from themelift.operators.typo_match import typo_join
from themelift.operators.positions import topk_per
from themelift.operators.vector_graph import graph_lists, vector_graph, write_graph
from themelift.operators.vector_match import (
    MIN_SIM,
    TOP_K,
    vector_topk,
    vector_topk_lsh,
    vector_verify,
)
from themelift.plans import fixtures as fx
from themelift.plans.pipeline import finish, match_hits, match_themes, run_job, write_final
from themelift.schemas import KEYWORD_KEY, VERDICT_MAP
from themelift.sizing import scratch_dir, stage
from themelift.sources import growing_store, query_log, sinks, themes, vectors as vector_source
from themelift.sources.markets import language_plan, resolve_market
from themelift.streaming import job_stream
from themelift.streaming.theme_stream import match_counts, progress_events, start_theme_stream, theme_lines

Query = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, Query] = {}

WIDE = text.FULL_SPACE


def query(name: str) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        REGISTRY[name] = fn
        return fn

    return register


def _parts(spark: SparkSession, sf: str) -> DataFrame:
    return fx.table(spark, sf, "part")


def _noun():
    return F.element_at(F.split("p_name", " "), -1)


def _hit_rows(hits: DataFrame) -> DataFrame:
    return hits.select(
        "theme",
        "kw_pos",
        "keyword",
        "id",
        "normalized_query",
        "SRPV",
        "method",
        F.round("relevance", 9).alias("relevance"),
    )


def _inputs(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Keyword table and query log, stored as tables the way a run finds them."""
    log = with_gram_text(query_log.with_match_text(fx.part_log(spark, sf)))
    return stage(fx.part_keywords(spark, sf), "keywords"), stage(log, "log")


def _text_inputs(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    log = with_gram_text(query_log.with_match_text(fx.pair_log(spark, sf)))
    return stage(fx.pair_keywords(spark, sf), "keywords"), stage(log, "log")


def _hits(spark: SparkSession, sf: str) -> DataFrame:
    return match_hits(*_inputs(spark, sf))


def _merged(spark: SparkSession, sf: str) -> DataFrame:
    return merge.merge_hits(_hits(spark, sf))


def _results(spark: SparkSession, sf: str) -> DataFrame:
    return match_themes(*_inputs(spark, sf))


def _labelled(spark: SparkSession, sf: str, results: DataFrame) -> DataFrame:
    """Results with the verdicts of the brand rules."""
    labels = verdicts.rule_labels(results, *fx.brand_tables(spark, sf))
    return labels.withColumnRenamed("is_valid", "AI_Valid").withColumnRenamed("reason", "AI_Reason")


def _answered(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Results, the validation requests on them, and the replies."""
    results = stage(_results(spark, sf), "results")
    requests = stage(inference.validation_requests(results), "requests")
    chunks = inference.validation_chunks(_labelled(spark, sf, results))
    return results, requests, stage(fx.validation_replies(chunks), "replies")


def _task_items(spark: SparkSession, sf: str) -> DataFrame:
    return history.theme_task_items(fx.part_keywords(spark, sf), _final(spark, sf))


def _final(spark: SparkSession, sf: str) -> DataFrame:
    return _labelled(spark, sf, stage(_results(spark, sf), "results"))


# Scans, sources, sinks


def _quoted_log(spark: SparkSession, sf: str) -> DataFrame:
    """Part rows whose texts also hold quotes and commas."""
    q = F.col("normalized_query")
    return fx.part_log_rows(spark, sf).withColumn(
        "normalized_query", F.when(F.col("id") % 5 == 0, F.concat(q, F.lit(' "new", cheap'))).otherwise(q)
    )


@query("scan_query_log")
def scan_query_log_rows(spark, sf):
    path = scratch_dir(spark, "csv")
    rows = _quoted_log(spark, sf).select("normalized_query", "SRPV", "AdClick", "revenue")
    rows.write.options(header=True, escape='"').csv(path)
    return query_log.read_query_log(spark, path, fx.MARKET)


@query("row_id")
def row_id_rows(spark, sf):
    path = scratch_dir(spark, "csv")
    rows = _quoted_log(spark, sf).orderBy("id")
    rows.select("normalized_query", "SRPV", "AdClick", "revenue").write.options(
        header=True, escape='"'
    ).csv(path)
    return query_log.read_query_log(spark, path, fx.MARKET, row_id=True)


@query("materialized_log")
def materialized_log_rows(spark, sf):
    path = scratch_dir(spark, "store")
    market = F.when(F.col("id") % 2 == 0, fx.MARKET).otherwise("Japan")
    log = fx.part_log_rows(spark, sf).withColumn("market", market)
    for name in [fx.MARKET, "Japan", fx.MARKET]:
        query_log.materialize(log, path, name)
    return query_log.read_store(spark, path)


def _grown_store(spark: SparkSession, sf: str) -> str:
    """A store that took the quoted log's files in two increments, the first files twice."""
    base = scratch_dir(spark, "growing")
    rows = _quoted_log(spark, sf).select("id", "normalized_query", "SRPV", "AdClick", "revenue")
    for name, part in (("0", rows.where("id <= 100")), ("1", rows.where("id > 100"))):
        # Ranges of ids in files whose paths have the same order, so no task holds an increment whole.
        ordered = part.repartitionByRange("id").sortWithinPartitions("id").drop("id")
        ordered.write.options(header=True, escape='"').csv(f"{base}/in/{name}")
        for _ in range(2):
            growing_store.ingest(spark, f"{base}/store", fx.MARKET, f"{base}/in")
    return f"{base}/store"


@query("growing_store")
def growing_store_rows(spark, sf):
    rows = growing_store.read_table(spark, _grown_store(spark, sf), "rows")
    return rows.select("id", "normalized_query", "SRPV", "AdClick", "revenue", "market", "match_text")


@query("growing_stats")
def growing_stats_rows(spark, sf):
    """Gram counts of two increments, added up."""
    return growing_store.read_table(spark, _grown_store(spark, sf), "gram_stats")


@query("market_resolve")
def market_resolve_rows(spark, sf):
    asked = fx.table(spark, sf, "customer").select(
        "c_custkey",
        F.concat(F.lit("NATION_"), (F.col("c_custkey") % 30).cast("string")).alias("market"),
    )
    out = resolve_market(asked, fx.nation_markets(spark, sf), "NATION_0")
    return out.withColumn("languages", F.array_join("languages", ", "))


@query("external_adapter")
def external_adapter_rows(spark, sf):
    return query_log.adapt_external(fx.customer_external(spark, sf), fx.nation_markets(spark, sf))


def _external_log(spark: SparkSession, sf: str) -> DataFrame:
    """Customers as external logs: markets of their own tables, the rest shared."""
    rows, dim = fx.customer_external(spark, sf), fx.nation_markets(spark, sf)
    names = [r.dedicated_table for r in dim.where("dedicated_table is not null").orderBy("market").collect()]
    code = {r.dedicated_table: r.code for r in dim.where("dedicated_table is not null").collect()}
    dedicated = {n: query_log.market_slice(rows, code[n]) for n in names}
    return query_log.external_log(rows, dedicated, dim)


@query("external_match")
def external_match_rows(spark, sf):
    """Segments as keywords of every market, matched with the external logs of all markets, the
    text-relevance neighbours as candidates."""
    segments = fx.table(spark, sf, "customer").select(F.lower("c_mktsegment").alias("keyword")).distinct()
    markets = fx.nation_markets(spark, sf).select("market", F.substring("code", 2, 4).cast("bigint").alias("theme_pos"))
    words = markets.join(F.broadcast(segments)).select(
        "theme_pos", F.lower("market").alias("theme"), "market", F.length("keyword").cast("bigint").alias("kw_pos"), "keyword"
    )
    hits = match_hits(stage(words, "keywords"), stage(_external_log(spark, sf), "log"), lexical=True)
    return hits.groupBy("theme_pos", "theme", "kw_pos", "keyword", "method").agg(
        F.count(F.lit(1)).alias("n_hits"), F.sum("id").alias("id_sum")
    )


@query("market_slice")
def market_slice_rows(spark, sf):
    return query_log.market_slice(fx.customer_external(spark, sf), "m7")


@query("theme_lines")
def theme_lines_rows(spark, sf):
    path = scratch_dir(spark, "themes")
    case = F.col("p_partkey") % 4
    line = (
        F.when(case == 0, F.concat(F.lit("  "), "p_name"))
        .when(case == 1, F.concat(F.lit(WIDE), "p_name", F.lit(WIDE)))
        .when(case == 2, F.lit(" " + WIDE))
        .otherwise(F.col("p_name"))
    )
    _parts(spark, sf).select(line.alias("value")).write.text(path)
    return themes.read_themes(spark, path)


@query("theme_clean")
def theme_clean_rows(spark, sf):
    case = F.col("p_partkey") % 5
    raw = (
        F.when(case == 0, F.concat_ws("/", "p_name", "p_type"))
        .when(case == 1, F.concat(F.lit(" "), "p_name", F.lit(" / x")))
        .when(case == 2, F.concat(F.lit("/"), "p_name"))
        .when(case == 3, F.lit(" "))
        .otherwise(F.col("p_name"))
    )
    return themes.clean_theme(_parts(spark, sf).select("p_partkey", raw.alias("raw_input")))


@query("vector_build")
def vector_build_rows(spark, sf):
    scale = (F.col("id") % 3 + 1).cast("float")
    raw = fx.vector_log(spark, sf).withColumn("vec", F.transform("vec", lambda x: x * scale))
    out = vector_source.build_vectors(raw)
    total = F.aggregate("vec", F.lit(0.0), lambda a, x: a + F.abs(x.cast("double")))
    return out.select(
        "market",
        "id",
        F.size("vec").cast("bigint").alias("dim"),
        F.round(vectors.norm(F.col("vec")), 5).alias("norm"),
        F.round(total, 4).alias("abs_sum"),
    )


@query("result_layout")
def result_layout_rows(spark, sf):
    return sinks.result_layout(_final(spark, sf), with_market=True)


# Projections, filters, scalar functions


def _spaced(spark: SparkSession, sf: str) -> DataFrame:
    """Part names with half, full or no spaces, and the market that stores them."""
    case = F.col("p_partkey") % 3
    name = (
        F.when(case == 0, F.replace("p_name", F.lit(" "), F.lit(WIDE)))
        .when(case == 1, F.concat_ws(" ", F.upper("p_name"), "p_type"))
        .otherwise(F.col("p_name"))
    )
    market = F.when(F.col("p_partkey") % 2 == 0, "Japan").otherwise(fx.MARKET)
    return _parts(spark, sf).select(
        "p_partkey", name.alias("query"), market.alias("market"), _noun().alias("noun"), "p_name"
    )


@query("clean_text")
def clean_text_rows(spark, sf):
    cleaned = text.clean(F.col("query"))
    return _spaced(spark, sf).select(
        "p_partkey", cleaned.alias("cleaned"), F.length(cleaned).cast("bigint").alias("n_chars")
    )


@query("clean_by_market")
def clean_by_market_rows(spark, sf):
    cleaned = text.clean_for_market(F.col("query"), F.col("market"))
    return _spaced(spark, sf).select("p_partkey", "market", cleaned.alias("cleaned"))


@query("hard_relevance")
def hard_relevance_rows(spark, sf):
    value = text.hard_relevance(F.col("query"), F.col("noun"))
    return _spaced(spark, sf).select("p_partkey", F.round(value, 9).alias("relevance"))


@query("hard_predicate")
def hard_predicate_rows(spark, sf):
    q, m = F.col("query"), F.col("market")
    pattern = F.concat(F.substring("noun", 1, 1), F.lit("%"), F.substring("noun", -2, 1), F.lit("_"))
    return _spaced(spark, sf).select(
        "p_partkey",
        text.hard_predicate(q, F.upper("p_name"), m).alias("literal_hit"),
        text.hard_predicate(q, pattern, m).alias("literal_pattern_hit"),
        text.hard_predicate(q, pattern, m, wildcards=True).alias("wildcard_hit"),
    )


@query("typo_predicate")
def typo_predicate_rows(spark, sf):
    rows = fx.part_log_rows(spark, sf).join(_parts(spark, sf), F.col("id") == F.col("p_partkey"))
    q = F.col("normalized_query")
    return rows.select(
        "id",
        text.typo(q, F.col("p_name")).alias("name_typo"),
        text.typo(q, _noun()).alias("noun_typo"),
    )


@query("cosine_pairs")
def cosine_pairs_rows(spark, sf):
    rows = fx.table(spark, sf, "embeddings")
    anchors = rows.groupBy("label").agg(F.min_by("embedding", "vec_id").alias("anchor"))
    sim = vectors.cosine(F.col("embedding"), F.col("anchor"))
    return rows.join(anchors, "label").select(
        "vec_id", sim.alias("similarity"), vectors.to_distance(sim).alias("distance")
    )


@query("relevance_floor")
def relevance_floor_rows(spark, sf):
    kept = merge.relevance_floor(_merged(spark, sf))
    return kept.select("theme", "normalized_query", "Relevance")


@query("hierarchical_ids")
def hierarchical_ids_rows(spark, sf):
    job = ids.job_id(F.col("p_brand"), F.col("p_type"))
    rows = _parts(spark, sf).select(
        "p_partkey", "p_size", job.alias("job_id"), F.posexplode(F.split("p_name", " ")).alias("pos", "theme")
    )
    theme = ids.theme_id(F.col("job_id"), F.col("pos"))
    return rows.select(
        "p_partkey",
        "theme",
        "job_id",
        theme.alias("theme_id"),
        ids.batch_id(theme, F.col("p_size")).alias("batch_id"),
    )


@query("utc_text")
def utc_text_rows(spark, sf):
    return fx.table(spark, sf, "events").select("event_id", text.utc_text(F.col("ts")).alias("created_at"))


# Joins


@query("hard_match")
def hard_match_rows(spark, sf):
    return _hit_rows(hard_match(fx.part_keywords(spark, sf), fx.part_log_rows(spark, sf)))


@query("hard_match_text")
def hard_match_text_rows(spark, sf):
    return _hit_rows(hard_match(*_text_inputs(spark, sf)))


@query("hard_match_indexed")
def hard_match_indexed_rows(spark, sf):
    """From an index that is stored once; probe buckets alone are read."""
    log = stage(query_log.with_match_text(fx.part_log_rows(spark, sf)), "log")
    path = scratch_dir(spark, "index")
    write_gram_index(gram_index(log), path, buckets=16)
    words = stage(fx.part_keywords(spark, sf), "keywords")
    return _hit_rows(hard_match_indexed(words, spark.read.parquet(path), log, buckets=16))


@query("hard_match_blocks")
def hard_match_blocks_rows(spark, sf):
    """Every 50th row of the pair log as a keyword, from compressed posting blocks stored once."""
    log = stage(query_log.with_match_text(fx.pair_log(spark, sf)), "log")
    path = scratch_dir(spark, "blocks")
    write_blocks(posting_blocks(log, sizes=(1, 2, GRAM, LONG)), path, buckets=16)
    words = stage(fx.pair_samples(log), "keywords")
    return _hit_rows(block_match(words, spark.read.parquet(path), log, long=LONG))


@query("hard_match_wildcards")
def hard_match_wildcards_rows(spark, sf):
    """Keywords whose second word is replaced by wildcards: its first letter, then anything that
    holds its last letters."""
    words = fx.part_keywords(spark, sf)
    first, last = F.element_at(F.split("keyword", " "), 1), F.element_at(F.split("keyword", " "), -1)
    pattern = F.concat(first, F.substring(last, 1, 1), F.lit("%"), F.substring(last, -2, 1), F.lit("_"))
    words = stage(words.withColumn("keyword", pattern), "keywords")
    return _hit_rows(hard_match(words, fx.part_log_rows(spark, sf), wildcards=True))


@query("vector_topk")
def vector_topk_rows(spark, sf):
    near = vector_topk(fx.vector_keywords(spark, sf), fx.vector_log(spark, sf))
    return near.select("theme", "keyword", "id", "similarity")


@query("attach_metrics")
def attach_metrics_rows(spark, sf):
    words = fx.vector_keywords(spark, sf)
    hits = vector_topk(words, fx.vector_log(spark, sf))
    out = query_log.attach_metrics(hits, fx.part_log_rows(spark, sf), TOP_K * words.count())
    return out.select("theme", "keyword", "id", "similarity", "normalized_query", "SRPV", "AdClick", "revenue")


@query("vector_verify")
def vector_verify_rows(spark, sf):
    near = gram_topk(*_inputs(spark, sf), min_sim=MIN_SIM)
    return _hit_rows(vector_verify(near))


@query("vector_topk_lsh")
def vector_topk_lsh_rows(spark, sf):
    """How the approximate neighbours of each keyword compare with the exact ones, on vectors and
    turned copies of them."""
    words, rows = fx.vector_keywords(spark, sf), fx.rotated_vectors(spark, sf, 4)
    exact = stage(vector_topk(words, rows, TOP_K, MIN_SIM).select("keyword", "id", F.col("similarity").alias("exact")), "exact")
    near = stage(vector_topk_lsh(words, rows, TOP_K, MIN_SIM).select("keyword", "id", F.col("similarity").alias("near")), "near")
    equal = F.when(F.abs(F.col("exact") - F.col("near")) <= 1e-8, 1)  # sums in another order
    pairs = exact.join(near, ["keyword", "id"], "full").withColumn("both", equal)
    counts = pairs.groupBy("keyword").agg(*[F.count(c).alias(f"n_{c}") for c in ("exact", "near", "both")])
    counts = stage(counts.withColumn("run", F.lit(1)), "counts")
    recall = counts.groupBy("run").agg((F.sum("n_both") >= 0.9 * F.sum("n_exact")).alias("found"))  # over all keywords
    rows = counts.join(F.broadcast(recall), "run")  # one row
    return rows.select("keyword", "n_exact", "found", (F.col("n_both") == F.col("n_near")).alias("exact"))


@query("vector_graph_topk")
def vector_graph_topk_rows(spark, sf):
    """What the stored graph finds of each keyword's exact neighbours, on vectors and turned copies of
    them, and whether it compared fewer than half of the rows."""
    words, rows, k = fx.vector_keywords(spark, sf), fx.rotated_vectors(spark, sf, 16), 20
    path = scratch_dir(spark, "graph")
    write_graph(vector_graph(rows), path)
    lists = stage(graph_lists(words, spark.read.parquet(path), k), "lists")
    best = topk_per(lists, KEYWORD_KEY, [F.col("similarity").desc(), F.col("id")], k)
    near = best.select("keyword", "id", F.col("similarity").alias("near"))
    exact = vector_topk(words, rows, k).select("keyword", "id", F.col("similarity").alias("exact"))
    equal = F.when(F.abs(F.col("exact") - F.col("near")) <= 1e-8, 1)  # sums in another order
    pairs = exact.join(near, ["keyword", "id"], "full").withColumn("both", equal)
    counts = pairs.groupBy("keyword").agg(*[F.count(c).alias(f"n_{c}") for c in ("exact", "near", "both")])
    compared = lists.select("keyword", "shard", "compared").distinct().groupBy("keyword").agg(F.sum("compared").alias("compared"))
    total = stage(rows.groupBy("market").agg((F.count(F.lit(1)) / 2).alias("half")), "rows")
    few = compared.withColumn("market", F.lit(fx.MARKET)).join(F.broadcast(total), "market")  # a row for each market
    return counts.join(few, "keyword").select(
        "keyword", "n_exact", (F.col("n_both") >= 0.95 * F.col("n_exact")).alias("enough"), (F.col("compared") < F.col("half")).alias("few")
    )


@query("lexical_topk")
def lexical_topk_rows(spark, sf):
    near = lexical_topk(*_inputs(spark, sf))
    return near.select("theme", "keyword", "id", F.round("score", 6).alias("score"), F.round("similarity", 6).alias("similarity"))


@query("gram_topk")
def gram_topk_rows(spark, sf):
    near = gram_topk(*_inputs(spark, sf))
    return near.select("theme", "keyword", "id", "normalized_query", "similarity")


@query("gram_topk_text")
def gram_topk_text_rows(spark, sf):
    near = gram_topk(*_text_inputs(spark, sf), min_sim=0.6)
    return near.select("theme", "keyword", "id", "normalized_query", "similarity")


@query("typo_join")
def typo_join_rows(spark, sf):
    """Every log row whose id is divisible by 50 as a keyword, against all rows."""
    log = stage(fx.pair_log(spark, sf), "log")
    found = typo_join(stage(fx.pair_samples(log), "keywords"), log)
    return found.select("theme", "kw_pos", "keyword", "id", "normalized_query", "edits", "similarity")


@query("apply_verdicts")
def apply_verdicts_rows(spark, sf):
    docs = fx.table(spark, sf, "documents").select(
        F.col("doc_id").alias("theme_pos"), F.col("source").alias("normalized_query")
    )
    quality = F.col("quality") != 0
    labels = fx.table(spark, sf, "labels").join(
        docs.withColumnRenamed("theme_pos", "doc_id"), "doc_id"
    ).select(
        F.col("doc_id").alias("theme_pos"),
        "normalized_query",
        quality.alias("is_valid"),
        F.when(~quality, "low quality").alias("reason"),
    )
    return verdicts.apply_verdicts(docs, labels)


@query("job_detail")
def job_detail_rows(spark, sf):
    jobs, tasks, batches = fx.history(spark, sf)
    status = history.job_status(tasks).withColumnRenamed("status", "job_status")
    detail = history.job_detail(status.select("job_id", "job_status"), tasks, batches)
    return detail.select(
        "job_id", "job_status", "theme_id", "task_pos", "theme", "status", "created_at", "batch_pos", "batch_index", "n_queries"
    )


def _request_rows(spark, sf):
    rows = fx.table(spark, sf, "customer")
    group = F.floor(F.col("c_custkey") / 8).cast("string")
    name = F.concat_ws(" ", "c_mktsegment", group)
    asked_as = F.when(F.col("c_custkey") % 2 == 0, F.concat(F.lit("  "), F.lower(name))).otherwise(name)
    market = F.concat(F.lit("NATION_"), (F.col("c_nationkey") % 5).cast("string"))
    asked = rows.select("c_custkey", asked_as.alias("theme"), market.alias("market"))
    # Customers of odd keys have an answer already.
    done = rows.where(F.col("c_custkey") % 2 == 1).select(
        name.alias("theme"),
        market.alias("market"),
        F.col("c_name").alias("answer"),
        F.col("c_custkey").alias("answered_at"),
    )
    return asked, done


@query("pending_requests")
def pending_requests_rows(spark, sf):
    return inference.pending_requests(*_request_rows(spark, sf), "theme", ["market"])


@query("reused_requests")
def reused_requests_rows(spark, sf):
    out = inference.reused_requests(
        *_request_rows(spark, sf), "theme", ["market"], "answer", "answered_at"
    )
    return out.select("c_custkey", "market", "request_key", "answer")


# Aggregations


@query("merge_hits")
def merge_hits_rows(spark, sf):
    return _merged(spark, sf)


@query("matched_keyword")
def matched_keyword_rows(spark, sf):
    return _merged(spark, sf).select("theme", "normalized_query", "matched_keyword")


@query("score_distribution")
def score_distribution_rows(spark, sf):
    return merge.score_distribution(_results(spark, sf)).select("theme", "Score", "n_queries")


@query("hits_per_keyword")
def hits_per_keyword_rows(spark, sf):
    words, log = _inputs(spark, sf)
    return merge.hits_per_keyword(match_hits(words, log), words)


@query("floor_removed")
def floor_removed_rows(spark, sf):
    return merge.floor_removed(_merged(spark, sf)).select("theme", "merged_rows", "removed_rows")


@query("theme_counts")
def theme_counts_rows(spark, sf):
    return history.theme_counts(_final(spark, sf), fx.part_keywords(spark, sf))


@query("batch_counts")
def batch_counts_rows(spark, sf):
    chunks = inference.validation_chunks(_final(spark, sf))
    return history.batch_counts(
        chunks.withColumnRenamed("AI_Valid", "is_valid"), ["theme", "batch_index"]
    )


@query("job_status")
def job_status_rows(spark, sf):
    return history.job_status(fx.history(spark, sf)[1])


@query("theme_task_row")
def theme_task_row_rows(spark, sf):
    return _task_items(spark, sf).drop("market")


@query("theme_rollup")
def theme_rollup_rows(spark, sf):
    return history.theme_rollup(_final(spark, sf), fx.part_keywords(spark, sf))


@query("timing_summary")
def timing_summary_rows(spark, sf):
    return history.timing_summary(fx.history(spark, sf)[1])


# Windows, order, limits, set operations


@query("validation_chunks")
def validation_chunks_rows(spark, sf):
    out = inference.validation_chunks(_results(spark, sf))
    return out.select("theme", "normalized_query", "rank_pos", "batch_index")


@query("dedup_keywords")
def dedup_keywords_rows(spark, sf):
    words = _parts(spark, sf).select(
        F.regexp_extract("p_brand", r"(\d+)", 1).cast("bigint").alias("theme_pos"),
        F.col("p_brand").alias("theme"),
        F.lit(fx.MARKET).alias("market"),
        F.col("p_size").cast("bigint").alias("brand_pos"),
        F.col("p_partkey").alias("kw_pos"),
        F.col("p_name").alias("keyword"),
    )
    return dedup_keywords(words).drop("market", "kw_order")


@query("ranked_results")
def ranked_results_rows(spark, sf):
    return merge.rank(_results(spark, sf)).select(
        "theme", "rank_pos", "normalized_query", "Score", "Relevance", "SRPV"
    )


@query("recent_jobs")
def recent_jobs_rows(spark, sf):
    return history.recent_jobs(fx.history(spark, sf)[0])


@query("preview_lists")
def preview_lists_rows(spark, sf):
    out = history.preview(_task_items(spark, sf))
    return out.select("theme", F.array_join("preview", "|").alias("preview"), "n_more")


@query("concat_runs")
def concat_runs_rows(spark, sf):
    labelled = sinks.result_layout(_final(spark, sf))
    plain = _results(spark, sf).withColumnRenamed("theme", "SearchTheme").drop("theme_pos", "market")
    return sinks.concat_runs(labelled, plain)


# Brand rules


def _brand_rows(spark, sf):
    brands, aliases, off_topic = fx.brand_tables(spark, sf)
    table = stage(verdicts.brand_table(brands, aliases, off_topic), "brands")
    return fx.brand_queries(spark, sf), table, verdicts.other_names(brands)


def _flag(rows: DataFrame, name: str) -> DataFrame:
    return rows.select("theme_pos", "theme", "normalized_query", name)


@query("label_identity")
def label_identity_rows(spark, sf):
    rows, table, _ = _brand_rows(spark, sf)
    return _flag(verdicts.label_identity(rows, table), "no_identity")


@query("label_residual_brand")
def label_residual_brand_rows(spark, sf):
    return _flag(verdicts.label_residual_brand(*_brand_rows(spark, sf)), "other_brand")


@query("label_comparison")
def label_comparison_rows(spark, sf):
    return _flag(verdicts.label_comparison(*_brand_rows(spark, sf)), "comparison")


@query("label_off_topic")
def label_off_topic_rows(spark, sf):
    rows, table, _ = _brand_rows(spark, sf)
    return _flag(verdicts.label_off_topic(rows, table), "off_topic")


@query("rule_labels")
def rule_labels_rows(spark, sf):
    rows = verdicts.rule_labels(fx.brand_queries(spark, sf), *fx.brand_tables(spark, sf))
    return rows.drop("market")


@query("keyword_guard")
def keyword_guard_rows(spark, sf):
    words = fx.brand_queries(spark, sf).withColumnRenamed("normalized_query", "keyword")
    parent = fx.brand_tables(spark, sf)[0].where(F.col("parent").isNotNull()).select(
        F.lit(-1).cast("bigint").alias("theme_pos"),
        F.col("brand").alias("theme"),
        F.lit(fx.MARKET).alias("market"),
        F.col("parent").alias("keyword"),
    )
    kept = verdicts.keyword_guard(words.unionByName(parent), *fx.brand_tables(spark, sf))
    return kept.drop("market")


@query("keyword_cap")
def keyword_cap_rows(spark, sf):
    words = REGISTRY["dedup_keywords"](spark, sf).withColumn("market", F.lit(fx.MARKET))
    return verdicts.keyword_cap(words).select("theme", "keyword", "kw_pos")


# Requests and replies


@query("language_plan")
def language_plan_rows(spark, sf):
    return language_plan(fx.nation_markets(spark, sf))


@query("expansion_requests")
def expansion_requests_rows(spark, sf):
    brands = _parts(spark, sf).select(
        F.col("p_partkey").alias("theme_pos"),
        F.col("p_name").alias("theme"),
        F.concat(F.lit("NATION_"), (F.col("p_partkey") % 30).cast("string")).alias("market"),
        F.lit(0).cast("bigint").alias("brand_pos"),
        F.col("p_name").alias("brand"),
    )
    out = inference.expansion_requests(brands, fx.nation_markets(spark, sf))
    return out.select("theme_pos", "market", "request")


@query("validation_requests")
def validation_requests_rows(spark, sf):
    out = inference.validation_requests(_results(spark, sf))
    return out.select("theme", "batch_index", "queries_json", "n_queries")


@query("expansion_replies")
def expansion_replies_rows(spark, sf):
    out = inference.parse_expansion(fx.expansion_replies(spark, sf))
    return out.select(
        "theme",
        F.col("brand_pos").cast("bigint").alias("brand_pos"),
        F.col("kw_pos").cast("bigint").alias("kw_pos"),
        "keyword",
    )


@query("validation_replies")
def validation_replies_rows(spark, sf):
    _, _, replies = _answered(spark, sf)
    return inference.merge_verdicts(inference.parse_verdicts(replies))


@query("verdict_defaults")
def verdict_defaults_rows(spark, sf):
    requests, turns = fx.conversation_requests(spark, sf)
    entry = F.to_json(
        F.create_map(
            F.element_at("queries", 1),
            F.struct(F.lit(False).alias("is_valid"), F.lit("off brand").alias("reason")),
        )
    )
    case = F.col("theme_pos") % 5
    content = (
        F.when(case == 0, F.concat(F.lit("Answer:\n"), entry))
        .when(case == 1, F.lit(""))
        .when(case == 2, F.lit("no object here"))
        .when(case == 3, F.lit('{"a": }'))
    )
    finish_reason = F.when(case == 4, "content_filter").otherwise("length")
    replies = turns.join(requests, ["theme_pos", "batch_index"]).select(
        "theme_pos", "batch_index", content.alias("content"), finish_reason.alias("finish_reason")
    )
    return inference.verdict_defaults(requests, replies)


@query("space_variants")
def space_variants_rows(spark, sf):
    rows = _spaced(spark, sf)
    forms = inference.space_variants(F.col("query"), F.col("market"))
    return rows.select("p_partkey", "market", F.explode(forms).alias("keyword"))


@query("history_json")
def history_json_rows(spark, sf):
    results, requests, replies = _answered(spark, sf)
    batches = history.run_batches("0badcafe", requests, inference.verdict_defaults(requests, replies))
    encoded = history.encode_lists(batches, ["queries", "results"])
    decoded = history.decode_lists(
        encoded.withColumns({"d_queries": F.col("queries"), "d_results": F.col("results")}),
        {"d_queries": "array<string>", "d_results": VERDICT_MAP.simpleString()},
    )
    return decoded.select(
        "batch_id",
        "queries",
        F.size("d_queries").cast("bigint").alias("n_queries"),
        F.size("d_results").cast("bigint").alias("n_results"),
    )


@query("run_batches")
def run_batches_rows(spark, sf):
    """Validation batches of the whole run, their verdicts as rows."""
    results, requests, replies = _answered(spark, sf)
    rows = history.run_batches("0badcafe", requests, inference.verdict_defaults(requests, replies))
    verdict = F.explode("results").alias("normalized_query", "v")
    return rows.select("theme_id", "batch_id", "status", F.size("queries").cast("bigint").alias("n_queries"), verdict).select(
        "theme_id", "batch_id", "status", "n_queries", "normalized_query", "v.is_valid", "v.reason"
    )


@query("run_tasks")
def run_tasks_rows(spark, sf):
    """Theme tasks of the whole run."""
    return history.run_tasks("0badcafe", fx.part_keywords(spark, sf), finish(*_answered(spark, sf)))


def _job_run(spark: SparkSession, sf: str):
    """A run whose replies come from a canned provider: texts of an even length are valid."""

    def provider(batches):
        for batch in batches:
            answers = [
                {q: {"is_valid": len(q) % 2 == 0, "reason": "" if len(q) % 2 == 0 else "odd"} for q in queries} for queries in batch["queries"]
            ]
            yield batch.assign(content=[json.dumps(a) for a in answers], finish_reason="stop")

    words, log = _inputs(spark, sf)
    return run_job(spark, "0badcafe", words, log, lambda requests: inference.reply_with(requests, provider))


@query("run_metrics")
def run_metrics_rows(spark, sf):
    """The steps of a run as they were observed."""
    metrics = _job_run(spark, sf).metrics
    timed = (F.col("elapsed_sec") >= 0) & (F.col("finished_at") >= F.col("started_at"))
    return metrics.select(
        "job_id", "step_no", "step", "status", "rows", *[F.col("counts")[c].alias(c) for c in ("hard", "vector", "valid")], timed.alias("timed")
    )


@query("observed_hits")
def observed_hits_rows(spark, sf):
    """Hits per keyword as stored during a run."""
    return _job_run(spark, sf).tables["keyword_hits"]


@query("timed_tasks")
def timed_tasks_rows(spark, sf):
    """Theme tasks of a run with its times."""
    tasks = _job_run(spark, sf).tasks
    timed = F.col("created_at").isNotNull() & (F.col("finished_at") >= F.col("created_at")) & (F.col("elapsed_sec") > 0)
    return tasks.select("job_id", "theme_pos", "status", "n_keywords", "match_count", "valid_count", "invalid_count", timed.alias("timed"))


# Streaming


@query("stream_theme_matches")
def stream_theme_matches_rows(spark, sf):
    base = scratch_dir(spark, "stream")
    words = fx.part_keywords(spark, sf)
    requests = words.groupBy("theme_pos", "theme", "market").agg(
        F.transform(
            F.array_sort(F.collect_list(F.struct("kw_pos", "keyword"))), lambda s: s["keyword"]
        ).alias("keywords")
    )
    requests.repartition(4, "theme").write.json(f"{base}/in")
    query_log.materialize(fx.part_log(spark, sf), f"{base}/log", fx.MARKET)
    run = start_theme_stream(
        spark, f"{base}/in", query_log.read_store(spark, f"{base}/log"), f"{base}/out", f"{base}/state", files_per_batch=2
    )
    run.awaitTermination()
    return spark.read.parquet(f"{base}/out").drop("batch")


@query("stream_jobs")
def stream_jobs_rows(spark, sf):
    """How each job ends: requests and replies as two streams of files, the replies in reverse."""
    base = scratch_dir(spark, "jobs")
    asked, told = fx.job_streams(spark, sf)
    asked.repartitionByRange(2, "theme_pos").write.json(f"{base}/requests/files")
    told.repartitionByRange(2, F.desc("theme_pos")).write.json(f"{base}/replies/files")
    log = stage(with_gram_text(query_log.with_match_text(fx.part_log(spark, sf))), "log")

    def run() -> None:
        requests = job_stream.read_files(spark, f"{base}/requests/*", job_stream.REQUEST, 1)
        replies = job_stream.read_files(spark, f"{base}/replies/*", job_stream.REPLY, 1)
        answers = job_stream.answered(requests, replies, delay="2 hours")
        job_stream.start_matches(answers, log, f"{base}/out", f"{base}/state").awaitTermination()
        job_stream.start_jobs(spark, f"{base}/out", f"{base}/lines", f"{base}/job-state", delay="2 hours").awaitTermination()

    run()
    for day in (2, 3):  # a job that only moves the streams' time on
        at = F.lit(f"2024-01-0{day} 00:00:00").cast("timestamp")
        clock = asked.agg(F.lit("clock").alias("job_id"), F.lit(day).cast("long").alias("theme_pos"), at.alias("at"))
        clock.select("job_id", "theme_pos", F.lit("none").alias("theme"), F.lit(fx.MARKET).alias("market"), F.lit(9).cast("long").alias("n_themes"), F.col("at").alias("asked_at")).write.json(f"{base}/requests/{day}")
        clock.select("job_id", "theme_pos", F.lit("[]").alias("content"), F.col("at").alias("replied_at")).write.json(f"{base}/replies/{day}")
        run()
    lines = spark.read.parquet(f"{base}/lines").where("job_id <> 'clock' and type in ('complete', 'error')")
    return lines.select("job_id", "type", "n_themes", "done", "failed", "match_count", (F.col("line_no") + 1).alias("n_lines"))


@query("progress_events")
def progress_events_rows(spark, sf):
    return progress_events("0badcafe", theme_lines(match_counts(_final(spark, sf), fx.part_keywords(spark, sf))))


# Whole plan


@query("flagship_match")
def flagship_match_rows(spark, sf):
    """The whole run: match, requests, replies, verdicts, theme order, result file."""
    path = scratch_dir(spark, "results-csv")
    write_final(finish(*_answered(spark, sf)), path)
    return sinks.read_results(spark, path)


@query("flagship_vectors")
def flagship_vectors_rows(spark, sf):
    """The match with vector neighbours as candidates."""
    words, kw_vecs, q_vecs = fx.vector_themes(spark, sf)
    log = query_log.with_match_text(fx.part_log_rows(spark, sf))
    return match_themes(stage(words, "keywords"), stage(log, "log"), kw_vecs, q_vecs, min_sim=0.1).drop("revenue")


@query("flagship_text")
def flagship_text_rows(spark, sf):
    return match_themes(*_text_inputs(spark, sf)).drop("market", "revenue")
