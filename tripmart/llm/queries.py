"""The registered queries: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable
from zlib import crc32

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tripmart.llm import (
    chat_format,
    decontamination,
    html_extraction,
    mixing,
    passage_dedup,
    periodic_runs,
    resampling,
    sentence_pieces,
    simhash,
    suffix_dedup,
    topk,
    toxicity,
    url_filter,
)
from tripmart.session import small_table

URL_RULES = [
    ("allow", "org/"),
    ("block", "example.org/es/"),
    ("block", "example.org/en/1"),
    ("allow", "com/fr/"),
    ("block", "com/de/"),
]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = small_table(spark, verdict=[v for v, _ in URL_RULES], rule=[r for _, r in URL_RULES])
    pages = _table(spark, sf_dir, "pages").select("page_id", "url")
    return url_filter.filter_urls(pages, rules).drop("url")


def source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    sized = docs.select("doc_id", "source", mixing.count_words(docs["text"]).alias("words"))
    turns = mixing.fair_queue(sized, F.col("words"))
    taken = F.sum(F.when(F.col("taken"), F.col("size")).otherwise(0)).alias("taken")
    return (
        turns.select("row.doc_id", "size", "source_size", "target", "taken", "queue", "slot", "place")
        .groupBy("queue", "slot", "place", "doc_id", "size", "source_size", "target")
        .agg(taken)
        .select("doc_id", "size", "source_size", "target", "taken")
    )


def simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = simhash.simhash_groups(_table(spark, sf_dir, "documents"))
    print_hex = F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint")
    return groups.select("doc_id", print_hex, "component_id")


def exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = topk.quantised(_table(spark, sf_dir, "embeddings"))
    return topk.top_k(vectors, F.col("vec_id") % 100 == 0)


def benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontamination.decontaminate(docs, _table(spark, sf_dir, "benchmark"))
    return found.select(
        "row.doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )


def suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    cut = suffix_dedup.cut_repeats(docs, with_text=False)
    return cut.select("row.doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def page_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extraction.extract_text(_table(spark, sf_dir, "pages").select("page_id", "url", "html"))


TOOLS = {
    "answer": {
        "properties": {"query": {"type": "string"}, "limit": {"type": "integer"}, "turn": {"type": "integer"}},
        "required": ["query", "limit"],
        "additionalProperties": False,
    },
    "configure": {"properties": {"query": {"type": "string"}, "limit": {"type": "integer", "enum": [0]}}, "required": ["query"]},
}


def chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tool calls that Spark derives from the conversations: a user's turn calls ``answer``, a system's ``configure``.

    The assistant's turn after a call is its result. A call depends on the call of half its turn, so the order has
    some depth; both tools get their length in words as the limit.
    """
    turns = _table(spark, sf_dir, "conversations").where(F.col("role").isNotNull() & F.col("turn").isNotNull())
    call_id = F.concat(F.lit("call-"), F.col("turn"))
    asked = turns.where(F.col("role") != "assistant")
    arguments = F.to_json(
        F.struct(F.coalesce("text", F.lit("")).alias("query"), mixing.count_words(F.col("text")).alias("limit"), "turn")
    )
    calls = asked.select(
        "conv_id", "turn", call_id.alias("call_id"), arguments.alias("arguments"),
        F.when(F.col("role") == "system", "configure").otherwise("answer").alias("name"),
        F.when(F.col("turn") > 0, F.array(F.concat(F.lit("call-"), F.floor(F.col("turn") / 2)))).otherwise(F.array().cast("array<string>")).alias("depends_on"),
    )
    results = turns.where(F.col("role") == "assistant").select(
        "conv_id", F.concat(F.lit("call-"), F.col("turn") - 1).alias("call_id"), F.col("text").alias("result")
    )
    return chat_format.link_calls(calls, results, TOOLS)


def toxicity_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.fit(docs, _table(spark, sf_dir, "labels"))
    scored = toxicity.score_toxicity(docs, model)
    return scored.select(
        "row.doc_id", toxicity.held_out(F.col("row.doc_id")).alias("held_out"), "score",
        (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted"),
    )


def passage_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passage_dedup.document_classes(_table(spark, sf_dir, "documents").select("doc_id", "text"))


def sentence_piece_coding(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers  # only this query needs the files

    model = public_tokenizers.path("piece_bpe_32k.model")
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    encoded = sentence_pieces.encode_texts(docs, model).select("row.doc_id", "ids")
    decoded = sentence_pieces.decode_ids(encoded, model)
    return decoded.select(
        "row.doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def tiled_words(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    """The words that op12 examines: a tenth of the documents repeat a part of themselves up to their end."""
    h = crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 or not words:
        return words
    n, g = len(words), h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + (i - a) % p] for i in range(a, n)]


def periodic_run_detection(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    found = periodic_runs.periodic_runs(docs, rewrite=tiled_words)
    # the least by (-length, start, period)
    longest = F.array_min(F.transform("runs", lambda r: F.struct((-r["length"]).alias("l"), r["start"], r["period"])))
    lines = F.transform("runs", lambda r: F.format_string("%d,%d,%d\n", r["start"], r["length"], r["period"]))
    length, period = -F.col("longest.l"), F.col("longest.period")
    return found.withColumn("longest", longest).select(
        "row.doc_id", F.size("runs").cast("long").alias("n_runs"), F.col("longest.start").alias("start"), length.alias("length"),
        period.alias("period"), F.floor(length * 1000 / period).alias("exponent_milli"),
        F.sha2(F.concat_ws("", lines), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    drawn = resampling.resample(docs, _table(spark, sf_dir, "benchmark"))
    return drawn.select("row.doc_id", "n_features", "weight", "score", "rank")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_url_filters": url_filters,
    "op2_source_mixing": source_mixing,
    "op3_simhash_near_dedup": simhash_near_dedup,
    "op4_exact_top_k": exact_top_k,
    "op5_html_extraction": page_extraction,
    "op6_benchmark_decontamination": benchmark_decontamination,
    "op7_chat_formatting": chat_formatting,
    "op8_suffix_array_dedup": suffix_array_dedup,
    "op9_toxicity": toxicity_scores,
    "op10_substring_dedup": passage_substring_dedup,
    "op11_sentencepiece_coding": sentence_piece_coding,
    "op12_periodic_runs": periodic_run_detection,
    "op13_importance_resampling": importance_resampling,
}
