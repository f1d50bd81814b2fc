"""One query per operator, with production parameters over its whole table."""

from __future__ import annotations

import zlib
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession

from pyspark.sql import functions as F

from matchloom.llm import (decontamination, huffman, language, lines, long_matches, near_duplicates, packing,
                           periodic_runs, pii, secrets, sharding, vector_search, whitening)
from matchloom.llm.common import read
from matchloom.operators.shared import new_folder

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(function: Query) -> Query:
    QUERIES[function.__name__] = function
    return function


@query
def op4_vector_search(spark: SparkSession, folder: str) -> DataFrame:
    return vector_search.top_k(read(spark, folder, "embeddings"), k=5, every=50, scale=256.0)


@query
def op7_best_fit_packing(spark: SparkSession, folder: str) -> DataFrame:
    vocabulary = public_tokenizers.path("byte_bpe_50k.json")
    return packing.pack(read(spark, folder, "documents"), vocabulary, size=2048, end_id=0)


@query
def op8_language_fusion(spark: SparkSession, folder: str) -> DataFrame:
    found = language.identify(read(spark, folder, "documents"))
    return found.select("doc_id", "language", "posterior", "accepted")


@query
def op10_token_files(spark: SparkSession, folder: str) -> DataFrame:
    files = new_folder(spark, "token-files")
    huffman.write(read(spark, folder, "documents"), files, public_tokenizers.path("word_bpe_49k.json"), end_id=1)
    return huffman.read(spark, files).select("doc_id", "start", "n_tokens", "ids_crc32")


@query
def op5_pii(spark: SparkSession, folder: str) -> DataFrame:
    found = pii.find(read(spark, folder, "documents").select("doc_id", "text"))

    def count(kind: str) -> Column:
        return F.size(F.filter("pii", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select(
        "doc_id", *[count(kind) for kind in pii.BASE],
        F.sha2(pii.described(F.col("pii"), *pii.BASE), 256).alias("base_sha256"),
        pii.described(F.col("pii")).alias("spans"),
        F.array_join(F.transform("pii", lambda s: F.format_number(s["score"], 2)), ",").alias("scores"))


@query
def op2_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    return decontamination.decontaminate(
        read(spark, folder, "documents"), read(spark, folder, "benchmark"), size=10)


@query
def op9_line_spread(spark: SparkSession, folder: str) -> DataFrame:
    kept = lines.remove_boilerplate(read(spark, folder, "documents"))
    return kept.select("doc_id", "n_lines", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


@query
def op1_secret_tags(spark: SparkSession, folder: str) -> DataFrame:
    found = secrets.find(read(spark, folder, "documents").select("doc_id", "text"))

    def count(kind: str) -> Column:
        return F.size(F.filter("secrets", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    base = F.filter("secrets", lambda s: s["kind"] != secrets.ADDED)
    return found.select("doc_id", *[count(kind) for kind in secrets.KINDS],
                        F.sha2(pii.described(base), 256).alias("base_sha256"),
                        pii.described(F.col("secrets")).alias("spans"))


@query
def op6_order_minhash(spark: SparkSession, folder: str) -> DataFrame:
    return near_duplicates.near_duplicates(read(spark, folder, "documents"))


@query
def op3_repeated_passages(spark: SparkSession, folder: str) -> DataFrame:
    return long_matches.remove_repeats(read(spark, folder, "documents"), length=400).drop("kept")


@query
def op11_embedding_whitening(spark: SparkSession, folder: str) -> DataFrame:
    return whitening.whiten(read(spark, folder, "embeddings"), components=8, scale=1024.0, shift=100_000)


def repeated_words(doc_id: object, words: list[bytes]) -> list[bytes]:
    """Words of a tenth of the documents, chosen by id, repeat with a period from some word on."""
    h = zlib.crc32(str(doc_id).encode())
    if doc_id is None or h % 10:
        return words
    n, g = len(words), h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + i % p] for i in range(n - a)]


@query
def op12_periodic_runs(spark: SparkSession, folder: str) -> DataFrame:
    docs = read(spark, folder, "documents").select("doc_id", "text")
    found = periodic_runs.periodic_runs(docs, words=repeated_words)
    # Exponents are compared exactly, and of equal ones the first stays.
    best = F.reduce("runs", F.get("runs", F.lit(0)), lambda best, r: F.when(
        r["length"] * best["period"] > best["length"] * r["period"], r).otherwise(best))
    lines = F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    digest = F.concat(F.array_join(lines, "\n"), F.when(F.size("runs") > 0, "\n").otherwise(""))
    return found.withColumn("_best", best).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "_best.start", "_best.length", "_best.period",
        F.expr("1000 * _best.length div _best.period").alias("exponent_milli"),
        F.sha2(digest, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))


@query
def op13_two_pass_shuffle(spark: SparkSession, folder: str) -> DataFrame:
    docs, shards = read(spark, folder, "documents"), new_folder(spark, "shards")
    sharding.write(docs, shards, shards=8)
    text = F.coalesce("text", F.lit(""))
    return sharding.read(spark, shards, docs).select(
        "doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"),
        F.lit(sharding.LAW).alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
