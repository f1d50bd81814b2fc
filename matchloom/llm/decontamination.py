"""Benchmark passages in documents: a prefix-filtered join of word windows.

Windows are the items' runs of ``size`` words (a shorter item is one window). Containment is
exact, so one shingle (two neighbouring words) of a window is a necessary prefix: the one
that the corpus holds least often. Documents are cut into words inside their rows; a shingle
of a document meets the windows whose prefix it is; the window must then fit into the
document at that place (length and position); last, its words are compared one by one, still
in the row, so that only true hits leave it. Words are compared exactly; hashes only
propose.

The windows are dealt into blocks of a bounded number, each block is broadcast, and the
documents are read once per block: benchmarks of usual size are one block.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from matchloom.llm.common import materialize, text_or_empty

SEPARATORS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
CAPITALS, SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BLOCK = 200_000  # windows in a broadcast block: about 40 MB with ten words each


def words(text: Column) -> Column:
    """Words of a text as written; compare them with A-Z lower-cased."""
    return F.array_remove(F.split(text, SEPARATORS, -1), "")


def _plain(word: Column) -> Column:
    """A key that words equal up to A-Z share; folds more than that, so it only proposes."""
    return F.lower(word)


def _shingle(first: Column, second: Column) -> Column:
    return F.xxhash64(_plain(first), F.coalesce(_plain(second), F.lit("")))


def _small(word: Column) -> Column:
    return F.translate(word, CAPITALS, SMALL)


def windows(items: DataFrame, size: int) -> DataFrame:
    """``(item_id, words, n)``: each distinct window of each item, in small letters."""
    base = items.select("item_id", F.transform(words(text_or_empty()), _small).alias("_w")).filter("size(_w) > 0")
    starts = F.sequence(F.lit(1), F.greatest(F.size("_w") - size + 1, F.lit(1)))
    return (base.withColumn("_s", F.explode(starts))
            .select("item_id", F.slice("_w", F.col("_s"), size).alias("words"))
            .withColumn("n", F.size("words")).distinct())


def _prefixes(distinct: DataFrame, docs: DataFrame) -> DataFrame:
    """``(window, joined, n, shift, key)``: each window's rarest shingle and where it stands.

    Shingles are counted over all documents; only those of the benchmark are counted.
    A window of one word has itself and no second word.
    """
    parts = distinct.select(
        "window", "words", "n", F.posexplode(F.sequence(F.lit(1), F.greatest(F.col("n") - 1, F.lit(1)))).alias("shift", "_i"))
    parts = parts.withColumn("key", _shingle(F.get("words", F.col("_i") - 1), F.get("words", F.col("_i"))))
    asked = materialize(parts.filter("n > 1").select("key").distinct(), "benchmark-shingles")
    counts = [_stream(docs).filter("key is not null").join(F.broadcast(block), "key").groupBy("key").agg(
        F.count("*").alias("seen")) for block in _blocks(asked, "key")]
    seen = reduce(DataFrame.unionByName, counts)
    order = Window.partitionBy("window").orderBy(F.coalesce("seen", F.lit(0)), "key", "shift")
    return (parts.join(seen, "key", "left").withColumn("_r", F.row_number().over(order))
            .filter("_r = 1").select("window", F.array_join("words", " ").alias("joined"), "n", "shift", "key"))


def _blocks(table: DataFrame, key: str) -> list[DataFrame]:
    """Parts of at most about ``BLOCK`` rows each."""
    n = max(1, -(-table.count() // BLOCK))
    if n == 1:
        return [table]
    return [table.filter(F.pmod(F.xxhash64(key), F.lit(n)) == i) for i in range(n)]


def _stream(docs: DataFrame) -> DataFrame:
    """Every shingle of every document with its place; the words stay in the row."""
    held = docs.withColumn("_w", words(F.col("_text")))
    # The outer form, as the plain one would cut every text twice, for a filter of its own.
    each = held.select("_doc", "_w", F.posexplode_outer("_w").alias("at", "_first"))
    return each.withColumn("key", F.when(F.col("at") + 1 < F.size("_w"), _shingle(
        F.col("_first"), F.get("_w", F.col("at") + 1))))


def _hits(docs: DataFrame, prefixes: DataFrame) -> DataFrame:
    """``(_doc, start, n, window)``: every place of every window."""
    found = []
    start = F.col("at") - F.col("shift")
    fits = (start >= 0) & (start + F.col("n") <= F.size("_w"))
    # No lambda here: it would end the generated code, and every row would carry its text's words.
    equal = _small(F.array_join(F.slice("_w", start + 1, F.col("n")), " ")) == F.col("joined")
    several, single = prefixes.filter("n > 1"), prefixes.filter("n = 1")
    for block in _blocks(several, "window"):
        met = _stream(docs).join(F.broadcast(block), "key")
        found.append(met.filter(F.when(fits, equal).otherwise(False)).select("_doc", start.alias("start"), "n", "window"))
    if single.take(1):
        alone = docs.withColumn("_w", words(F.col("_text"))).select("_doc", F.posexplode("_w").alias("start", "_first"))
        for block in _blocks(single.select(F.col("joined").alias("_first"), "n", "window"), "window"):
            found.append(alone.withColumn("_first", _small(F.col("_first"))).join(F.broadcast(block), "_first")
                         .select("_doc", "start", "n", "window"))
    return reduce(DataFrame.unionByName, found)


def decontaminate(docs: DataFrame, items: DataFrame, size: int = 10) -> DataFrame:
    """One row per document with n_words, n_hit, n_items, items_sha256, contaminated.

    ``docs(doc_id, text)``, ``items(item_id, text)``; other columns are not read. Null and empty
    texts have no words and are clean; items without words match nothing. ``n_hit`` counts words
    inside any place of a window. Rows are told apart by ``doc_id`` and text: repeated rows get
    equal results, a null ``doc_id`` is one like any other. Items with a null id are left out of
    the list of ids, as they have none. An empty benchmark leaves all clean.
    """
    data = docs.select("doc_id", text_or_empty().alias("_text")).withColumn("_doc", F.struct(
        F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), F.xxhash64("_text").alias("h")))
    everything = windows(items, size).withColumn("window", F.sha2(F.concat_ws(" ", "words"), 256))
    owned = materialize(everything.select("window", "item_id", "words", "n"), "windows")
    distinct = owned.groupBy("window").agg(F.first("words").alias("words"), F.first("n").alias("n"))
    source = data.select("_doc", "_text")
    prefixes = materialize(_prefixes(distinct, source), "prefixes")
    hits = materialize(_hits(source, prefixes), "hits")
    # Words covered: each place adds what lies beyond the furthest end before it.
    line = Window.partitionBy("_doc").orderBy("start", F.desc("n")).rowsBetween(Window.unboundedPreceding, -1)
    ends = hits.select("_doc", "start", "n").distinct().withColumn(
        "_before", F.coalesce(F.max(F.col("start") + F.col("n")).over(line), F.lit(0)))
    covered = ends.groupBy("_doc").agg(F.sum(F.greatest(
        F.col("start") + F.col("n") - F.greatest("start", "_before"), F.lit(0))).cast("long").alias("n_hit"))
    named = (hits.select("_doc", "window").distinct().join(owned.select("window", "item_id"), "window")
             .filter("item_id is not null").select("_doc", F.col("item_id").cast("string").alias("item")).distinct()
             .groupBy("_doc").agg(F.sort_array(F.collect_list("item")).alias("items")))
    return (data.select("doc_id", "_doc", F.size(words(F.col("_text"))).cast("long").alias("n_words"))
            .join(covered.join(named, "_doc", "left"), "_doc", "left")
            .select("doc_id", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
                    F.coalesce(F.size("items"), F.lit(0)).cast("long").alias("n_items"),
                    F.sha2(F.coalesce(F.array_join("items", ","), F.lit("")), 256).alias("items_sha256"),
                    (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated")))
