"""Query logs, themes, replies and history derived from the supplied tables.

Each function reads whole tables below ``sf`` and gives one of the library's input tables.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from themelift.operators.inference import BATCH_SIZE
from themelift.operators.positions import with_position

# The task code below travels with the job, so executors need no installed copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

MARKET = "Australia"
WORD_BREAK = r"[^\p{L}\p{N}]+"
# Words of documents whose pairs are counted at a time.
WORDS = 1_000_000


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _documents(spark: SparkSession, sf: str) -> DataFrame:
    """Documents in at least one task per core: a table of one row group would be taken apart by
    one task. A table of many files is left as it is scanned."""
    docs = table(spark, sf, "documents").select("doc_id", "source", "text")
    cores = spark.sparkContext.defaultParallelism
    return docs if docs.rdd.getNumPartitions() >= cores else docs.repartition(cores, "doc_id")


def _metrics(spark: SparkSession, sf: str) -> DataFrame:
    """Line count, returned lines and net price in ten-thousandths per part, exact integers."""
    net = F.round(F.col("l_extendedprice") * 100).cast("bigint") * F.round(
        (1 - F.col("l_discount")) * 100
    ).cast("bigint")
    return (
        table(spark, sf, "lineitem")
        .groupBy(F.col("l_partkey").alias("p_partkey"))
        .agg(
            F.count(F.lit(1)).alias("SRPV"),
            F.count_if(F.col("l_returnflag") == "R").cast("bigint").alias("AdClick"),
            F.sum(net).alias("net"),
        )
    )


def _cents(net):
    return F.expr(f"(({net}) + 50) div 100").cast("double") / 100


def part_text():
    """Part name, its 4th character missing in every 7th part, its type added in every 3rd."""
    name = F.col("p_name")
    short = F.concat(F.substring(name, 1, 3), F.substring(name, 5, 1000))
    text = F.when(F.col("p_partkey") % 7 == 0, short).otherwise(name)
    return F.when(
        F.col("p_partkey") % 3 == 0, F.concat(text, F.lit(" "), F.lower("p_type"))
    ).otherwise(text)


def _part_rows(spark: SparkSession, sf: str) -> DataFrame:
    return (
        table(spark, sf, "part")
        .join(_metrics(spark, sf), "p_partkey", "left")
        .select(
            F.col("p_partkey").alias("id"),
            part_text().alias("normalized_query"),
            F.coalesce("SRPV", F.lit(0)).alias("SRPV"),
            F.coalesce("AdClick", F.lit(0)).alias("AdClick"),
            F.coalesce("net", F.lit(0)).alias("net"),
        )
    )


def part_log(spark: SparkSession, sf: str) -> DataFrame:
    """Query log with one row per part text."""
    return (
        _part_rows(spark, sf)
        .groupBy("normalized_query")
        .agg(
            F.min("id").alias("id"),
            F.sum("SRPV").alias("SRPV"),
            F.sum("AdClick").alias("AdClick"),
            F.sum("net").alias("net"),
        )
        .select(
            "id",
            "normalized_query",
            "SRPV",
            "AdClick",
            _cents("net").alias("revenue"),
            F.lit(MARKET).alias("market"),
        )
    )


def part_log_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Query log with one row per part, so that texts repeat."""
    return _part_rows(spark, sf).select(
        "id",
        "normalized_query",
        "SRPV",
        "AdClick",
        _cents("net").alias("revenue"),
        F.lit(MARKET).alias("market"),
    )


def _noun():
    return F.element_at(F.split("p_name", " "), -1)


def part_keywords(spark: SparkSession, sf: str) -> DataFrame:
    """Theme = noun of the part name at its first part, keywords = its names by length and text.
    Every noun also has a keyword that no text holds, and every region is a theme without any."""
    named = table(spark, sf, "part").select(_noun().alias("theme"), "p_name", "p_partkey")
    themes = named.groupBy("theme").agg(F.min("p_partkey").alias("theme_pos"))
    names = named.select("theme", F.col("p_name").alias("keyword")).distinct()
    idle = themes.select("theme", F.concat(F.lit("zzz "), "theme").alias("keyword"))
    rows = names.unionByName(idle).join(themes, "theme")
    regions = table(spark, sf, "region").select(
        F.lower("r_name").alias("theme"),
        F.lower("r_name").alias("keyword"),
        (-1 - F.col("r_regionkey").cast("bigint")).alias("theme_pos"),
    )
    placed = with_position(rows.unionByName(regions), ["theme"], [F.length("keyword"), F.col("keyword")], "kw_pos")
    return placed.select("theme_pos", "theme", F.lit(MARKET).alias("market"), "kw_pos", "keyword")


PAIR_COUNTS = "normalized_query string, n long, docs long, doc_id long, place long"


def counted_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The word pairs of documents with an id each: occurrences, documents, and the first document
    and place, counted for some documents at a time so that a pair leaves them once."""
    for batch in batches:
        doc_id, words = batch.column("doc_id"), batch.column("words")
        first = doc_id.fill_null(-(2**63)).to_numpy()
        # A missing id stands before all others.
        rank = np.empty(len(batch), np.int64)
        order = np.lexsort((first, pc.is_valid(doc_id).to_numpy(zero_copy_only=False)))
        rank[order] = np.arange(len(batch))
        ends = np.cumsum(pc.list_value_length(words).to_numpy())
        start = 0
        while start < len(batch):
            end = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + WORDS, "right")))
            part = words.slice(start, end - start)
            sizes = pc.list_value_length(part).to_numpy()
            flat, row = part.flatten(), np.repeat(np.arange(start, end), sizes)
            at = np.flatnonzero(row[1:] == row[:-1])
            place = at - np.repeat(np.cumsum(sizes) - sizes, sizes)[at]
            # Words by number: strings are made of the distinct pairs alone.
            coded = flat.dictionary_encode()
            word, kinds = coded.indices.to_numpy().astype(np.int64), len(coded.dictionary)
            pair, n = word[at] * kinds + word[at + 1], end - start
            rows = pa.table({"own": pair * n + row[at] - start, "first": rank[row[at]] << 32 | place})
            own = rows.group_by("own", use_threads=False).aggregate([("first", "min"), ("first", "count")])
            own = own.append_column("pair", pa.array(own["own"].to_numpy() // n))
            sums = own.group_by("pair", use_threads=False).aggregate([("first_min", "min"), ("first_count", "sum"), ("first_count", "count")])
            both = sums["pair"].to_numpy()
            pairs = pc.binary_join_element_wise(coded.dictionary.take(pa.array(both // kinds)), coded.dictionary.take(pa.array(both % kinds)), " ")
            code = sums["first_min_min"].to_numpy()
            columns = [pairs, sums["first_count_sum"], sums["first_count_count"], doc_id.take(pa.array(order[code >> 32])), pa.array(code & (1 << 32) - 1)]
            names = [c.split(" ")[0] for c in PAIR_COUNTS.split(", ")]
            yield from pa.table(columns, names=names).combine_chunks().to_batches()
            start = end


def _pairs_by_id(docs: DataFrame) -> DataFrame:
    """The same, a row for each pair and id, where ids repeat."""
    n = F.size("words") - 1
    pairs = F.zip_with(
        F.slice("words", F.lit(1), n),
        F.slice("words", F.lit(2), n),
        lambda a, b: F.concat_ws(" ", a, b),
    )
    return (
        docs.select("doc_id", F.posexplode(pairs).alias("place", "normalized_query"))
        .groupBy("normalized_query", "doc_id")
        .agg(F.count(F.lit(1)).alias("n"), F.min("place").alias("place"))
        .withColumn("docs", F.lit(1))
    )


def pair_log(spark: SparkSession, sf: str) -> DataFrame:
    """Query log of adjacent lower-case word pairs of the documents' texts. Ids number the pairs
    in the order of their first occurrence, by document and place."""
    docs = _documents(spark, sf)
    words = F.filter(F.split(F.lower("text"), WORD_BREAK), lambda w: F.length(w) > 0)
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), words.alias("words")).where(F.size("words") > 1)
    repeated = table(spark, sf, "documents").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    per_doc = _pairs_by_id(docs) if not repeated.isEmpty() else docs.mapInArrow(counted_pairs, PAIR_COUNTS)
    # Document and place as one number, null ids first: the aggregate of a number needs no sort.
    doc = F.coalesce(F.col("doc_id").cast("decimal(20,0)"), F.lit(str(-(2**63) - 1)).cast("decimal(20,0)"))
    first = (doc * F.lit(2**31).cast("decimal(11,0)") + F.col("place")).cast("decimal(38,0)")
    rows = per_doc.withColumn("first", first).groupBy("normalized_query").agg(
        F.min("first").alias("first"),
        F.sum("n").alias("SRPV"),
        F.sum("docs").alias("AdClick"),
    )
    rows = rows.select("normalized_query", "SRPV", "AdClick", "first", F.lit(MARKET).alias("market"))
    return with_position(rows, ["market"], [F.col("first")], "id").select(
        "id", "normalized_query", "SRPV", "AdClick", F.lit(0.0).alias("revenue"), "market"
    )


def pair_keywords(spark: SparkSession, sf: str) -> DataFrame:
    """Keywords for the pair log: per document source, one word of every length that occurs, the
    last one in text order."""
    docs = _documents(spark, sf)
    words = F.array_distinct(
        F.filter(F.split(F.lower("text"), WORD_BREAK), lambda w: F.length(w) > 0)
    )
    return (
        docs.select("source", F.explode(words).alias("keyword"))
        .groupBy("source", F.length("keyword").cast("bigint").alias("kw_pos"))
        .agg(F.max("keyword").alias("keyword"))
        .select(
            F.substring("source", 4, 10).cast("bigint").alias("theme_pos"),
            F.col("source").alias("theme"),
            F.lit(MARKET).alias("market"),
            "kw_pos",
            "keyword",
        )
    )


def pair_samples(log: DataFrame) -> DataFrame:
    """Keywords: every row of a pair log whose id is divisible by 50, dealt to 20 themes."""
    theme = F.floor(F.col("id") % 1000 / 50).cast("bigint")
    return log.where(F.col("id") % 50 == 0).select(
        theme.alias("theme_pos"),
        F.concat(F.lit("every 50th "), theme.cast("string")).alias("theme"),
        "market",
        F.col("id").alias("kw_pos"),
        F.col("normalized_query").alias("keyword"),
    )


def vector_log(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "embeddings").select(
        F.lit(MARKET).alias("market"), F.col("vec_id").alias("id"), F.col("embedding").alias("vec")
    )


def rotated_vectors(spark: SparkSession, sf: str, turns: int, step: float = 0.2) -> DataFrame:
    """The vector log with turned copies of every vector: the pairs of its components are rotated
    by 0, 1, 2, ... times ``step``, so that a copy's cosine with its vector is that of the angle."""
    rows = vector_log(spark, sf).withColumn("turn", F.explode(F.sequence(F.lit(0), F.lit(turns - 1))))
    angle = F.col("turn") * step

    def turned(x, i):
        other = F.when(i % 2 == 0, -F.get("vec", i + 1)).otherwise(F.get("vec", i - 1))
        return (x.cast("double") * F.cos(angle) + other.cast("double") * F.sin(angle)).cast("float")

    return rows.select("market", (F.col("id") * turns + F.col("turn")).alias("id"), F.transform("vec", turned).alias("vec"))


def vector_keywords(spark: SparkSession, sf: str) -> DataFrame:
    """Keyword vectors: every vector whose id is divisible by 50; a label is a theme."""
    return table(spark, sf, "embeddings").where(F.col("vec_id") % 50 == 0).select(
        F.col("label").cast("bigint").alias("theme_pos"),
        F.concat(F.lit("label "), F.col("label").cast("string")).alias("theme"),
        F.lit(MARKET).alias("market"),
        F.col("vec_id").alias("kw_pos"),
        F.concat(F.lit("vector "), F.col("vec_id").cast("string")).alias("keyword"),
        F.col("embedding").alias("vec"),
    )


def nation_markets(spark: SparkSession, sf: str) -> DataFrame:
    """Nations as a market dimension; the region decides the languages."""
    region = table(spark, sf, "region")
    primary = F.lower("r_name")
    languages = F.when(F.col("r_regionkey") == 0, F.array(F.lit("English"))).otherwise(
        F.array(primary, F.lit("English"))
    )
    return (
        table(spark, sf, "nation")
        .join(region, F.col("n_regionkey") == F.col("r_regionkey"))
        .select(
            F.col("n_name").alias("market"),
            F.concat(F.lit("m"), F.col("n_nationkey").cast("string")).alias("code"),
            languages.alias("languages"),
            F.concat(F.lit("encoder-"), F.lower("r_name")).alias("encoder"),
            F.concat(F.lit("logs/market="), F.col("n_name")).alias("log_path"),
            F.when(F.col("n_nationkey") % 5 == 4, F.concat(F.lit("log_"), F.col("n_name"))).alias(
                "dedicated_table"
            ),
            F.concat(F.lit("keywords-m"), F.col("n_nationkey").cast("string")).alias("search_index"),
        )
    )


def customer_external(spark: SparkSession, sf: str) -> DataFrame:
    """Customers as rows of an external log."""
    return table(spark, sf, "customer").select(
        F.col("c_custkey").alias("Id"),
        F.concat(F.lit("m"), F.col("c_nationkey").cast("string")).alias("TargetMarket"),
        F.concat(F.lower("c_mktsegment"), F.lit(" "), F.lower("c_name")).alias("Query"),
        F.floor(F.abs("c_acctbal")).cast("bigint").alias("Srpv"),
    )


def brand_tables(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Brands (nouns), aliases (plural) and unrelated concepts (adjectives of an even length)."""
    named = table(spark, sf, "part").select(
        _noun().alias("brand"), F.element_at(F.split("p_name", " "), 1).alias("adjective")
    )
    brands = named.select("brand").distinct()
    unrelated = named.where(F.length("adjective") % 2 == 0).select("brand", F.col("adjective").alias("term")).distinct()
    parents = F.when(F.col("brand") == "widget", F.lit("gizmo"))
    return (
        brands.select(
            "brand",
            parents.alias("parent"),
            F.col("brand").isin("ring", "plate").alias("is_common_word"),
        ),
        brands.select("brand", F.concat(F.col("brand"), F.lit("s")).alias("alias")),
        unrelated,
    )


def brand_queries(spark: SparkSession, sf: str) -> DataFrame:
    """Queries that exercise the brand rules: the noun with an adjective, another noun, a
    comparison, a plural, or no brand at all, by part."""
    parts = table(spark, sf, "part").select(
        "p_partkey",
        _noun().alias("theme"),
        F.element_at(F.split("p_name", " "), 1).alias("adjective"),
        F.lower("p_type").alias("kind"),
        "p_size",
    )
    # Nouns that serve as the other brand.
    others = F.array(*[F.lit(w) for w in ["anvil", "gizmo", "rod", "widget"]])
    other = F.element_at(others, (F.col("p_size") % 4 + 1).cast("int"))
    case = F.col("p_partkey") % 6
    text = (
        F.when(case == 0, F.concat_ws(" ", "adjective", "theme"))
        .when(case == 1, F.concat_ws(" ", "theme", F.lit("vs"), other))
        .when(case == 2, F.concat_ws(" ", other, "theme"))
        .when(case == 3, F.concat(F.col("theme"), F.lit("s "), F.col("kind")))
        .when(case == 4, F.concat(F.col("theme"), F.col("adjective")))
        .otherwise(F.concat_ws(" ", "kind", "adjective"))
    )
    return parts.select(
        F.col("p_partkey").alias("theme_pos"), "theme", F.lit(MARKET).alias("market"), text.alias("normalized_query")
    )


def history(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Jobs, theme tasks (event type within a job) and batches (events). A job is a user and a day;
    its key is that pair, whole, so that no two jobs share one."""
    events = table(spark, sf, "events").select(
        F.concat_ws("|", F.col("user_id").cast("string"), F.date_format("ts", "yyyy-MM-dd")).alias("job_id"),
        "event_id",
        "event_type",
        "ts",
        "value",
    )
    tasks = (
        events.groupBy("job_id", F.col("event_type").alias("theme"))
        .agg(
            F.min("ts").alias("created_ts"),
            F.max("ts").alias("finished_ts"),
            F.count(F.lit(1)).alias("match_count"),
            F.sum(F.round(F.col("value") * 100).cast("bigint")).alias("cents"),
        )
        .select(
            "job_id",
            F.concat_ws("-", "job_id", "theme").alias("theme_id"),
            "theme",
            F.when(F.col("theme") == "error", "error").otherwise("done").alias("status"),
            F.date_format("created_ts", "yyyy-MM-dd HH:mm:ss").alias("created_at"),
            F.date_format("finished_ts", "yyyy-MM-dd HH:mm:ss").alias("finished_at"),
            "match_count",
            (F.col("cents").cast("double") / 100).alias("elapsed_sec"),
        )
    )
    jobs = events.groupBy("job_id").agg(
        F.date_format(F.min("ts"), "yyyy-MM-dd HH:mm:ss").alias("created_at"),
        F.date_format(F.max("ts"), "yyyy-MM-dd HH:mm:ss").alias("finished_at"),
    )
    batches = events.select(
        F.concat_ws("-", "job_id", "event_type").alias("theme_id"),
        F.col("event_id").alias("batch_index"),
        F.concat(F.concat_ws("-", "job_id", "event_type"), F.lit("-b"), F.col("event_id").cast("string")).alias(
            "batch_id"
        ),
        F.floor("value").cast("bigint").alias("n_queries"),
    )
    return jobs, tasks, batches


def expansion_replies(spark: SparkSession, sf: str) -> DataFrame:
    """Reply texts that carry each theme's keyword array: fenced, bare, within prose, broken,
    empty or missing, by brand position. The brand is the theme."""
    words = part_keywords(spark, sf)
    arrays = words.groupBy("theme_pos", "theme", "market").agg(
        F.transform(
            F.array_sort(F.collect_list(F.struct("kw_pos", "keyword"))), lambda s: s["keyword"]
        ).alias("keywords")
    )
    body = F.to_json("keywords")
    shapes = F.array(
        F.concat(F.lit("```json\n"), body, F.lit("\n```")),
        body,
        F.concat(F.lit("Here are the keywords: "), body, F.lit(" Done.")),
        F.concat(F.lit("["), F.array_join("keywords", ", ")),
        F.lit("[]"),
        F.lit(None).cast("string"),
    )
    return arrays.select(
        "theme_pos", "theme", "market", F.posexplode(shapes).alias("brand_pos", "content")
    ).withColumn("brand", F.col("theme"))


def job_streams(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Themes as requests of three jobs, and the replies to them, seven minutes later each. Themes of
    four letters are never answered, and the second job waits for a theme that nobody asks for."""
    words = part_keywords(spark, sf)
    ordered = F.array_sort(F.collect_list(F.struct("kw_pos", "keyword")))
    themes = words.groupBy("theme_pos", "theme", "market").agg(F.to_json(F.transform(ordered, lambda s: s["keyword"])).alias("content"))
    number = F.abs("theme_pos") % 3
    themes = themes.withColumn("job_id", F.concat(F.lit("job-"), number.cast("string")))
    sizes = themes.groupBy("job_id").agg((F.count(F.lit(1)) + F.when(F.col("job_id") == "job-1", 1).otherwise(0)).alias("n_themes"))
    asked = F.timestamp_add("MINUTE", F.abs("theme_pos") % 40, F.lit("2024-01-01 00:00:00").cast("timestamp"))
    rows = themes.join(sizes, "job_id").withColumn("asked_at", asked)
    replies = rows.where(F.length("theme") != 4).withColumn("replied_at", F.timestamp_add("MINUTE", F.lit(7), "asked_at"))
    return (
        rows.select("job_id", "theme_pos", "theme", "market", "n_themes", "asked_at"),
        replies.select("job_id", "theme_pos", "content", "replied_at"),
    )


def validation_replies(chunks: DataFrame) -> DataFrame:
    """Reply texts to the validation requests of labelled results (see ``validation_chunks``).

    A reply also takes back the verdict on the first query of the batch before it. Every fourth
    batch has no reply, and every batch after a multiple of four has a second, empty one.
    """
    own = chunks.select("theme_pos", "batch_index", "normalized_query", "AI_Valid", "AI_Reason")
    again = chunks.where(F.col("rank_pos") % BATCH_SIZE == 0).select(
        "theme_pos",
        (F.col("batch_index") + 1).alias("batch_index"),
        "normalized_query",
        (~F.col("AI_Valid")).alias("AI_Valid"),
        F.lit("Second look").alias("AI_Reason"),
    )
    asked = chunks.select("theme_pos", "batch_index").distinct().where(F.col("batch_index") % 4 != 3)
    verdict = F.struct(F.col("AI_Valid").alias("is_valid"), F.col("AI_Reason").alias("reason"))
    entries = F.map_from_entries(F.collect_list(F.struct("normalized_query", verdict)))
    rows = own.unionByName(again).join(asked, ["theme_pos", "batch_index"], "left_semi")
    replies = rows.groupBy("theme_pos", "batch_index").agg(
        F.concat(F.lit("Verdicts: "), F.to_json(entries), F.lit(" end")).alias("content"),
        F.lit("stop").alias("finish_reason"),
    )
    empty = asked.where(F.col("batch_index") % 4 == 1).select(
        "theme_pos", "batch_index", F.lit("").alias("content"), F.lit("length").alias("finish_reason")
    )
    return replies.unionByName(empty)


def vector_themes(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Keywords, keyword vectors and log vectors of parts: part p has the vector of id p - 1, a
    label is a theme, and the part names of its keyword vectors are its keywords."""
    q_vecs = vector_log(spark, sf).withColumn("id", F.col("id") + 1)
    names = table(spark, sf, "part").select((F.col("p_partkey") - 1).alias("kw_pos"), F.col("p_name").alias("keyword"))
    kw_vecs = vector_keywords(spark, sf).drop("keyword").join(names, "kw_pos")
    return kw_vecs.drop("vec"), kw_vecs, q_vecs


def conversation_requests(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """User turns as requests with one query each (the whole turn), and the assistant turns that
    follow them as replies."""
    turns = table(spark, sf, "conversations")
    query = F.col("text")
    requests = turns.where(F.col("role") == "user").select(
        F.col("conv_id").alias("theme_pos"),
        F.col("turn").alias("batch_index"),
        F.array(query).alias("queries"),
    )
    replies = turns.where(F.col("role") == "assistant").select(
        F.col("conv_id").alias("theme_pos"), (F.col("turn") - 1).alias("batch_index"), "text"
    )
    return requests, replies
