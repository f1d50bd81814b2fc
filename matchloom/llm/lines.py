"""Lines that many sites share, by their spread over distinct sites.

Lines are hashed; each hash gets a HyperLogLog sketch of its sites, which partial sums merge
in the map tasks and again after the shuffle. Estimates well above the threshold decide for
themselves, estimates well below it too; lines whose estimate is near it get exact
distinct counts.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from matchloom.llm.common import materialize, packed, text_or_empty


@dataclass(frozen=True)
class LineConfig:
    """A line counts if it has ``least_chars`` characters without outer blanks; it is
    boilerplate from ``least_sites`` distinct sites on. ``log2``: sketch size; ``margin``: share
    of the threshold within which an estimate counts as near."""

    least_chars: int = 1
    least_sites: int = 8
    log2: int = 8
    margin: float = 0.5


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def _key(line: Column) -> Column:
    """128 bits of the line without outer blanks."""
    bare = F.trim(line)
    return F.struct(F.xxhash64(bare).alias("a"), F.xxhash64(bare, F.lit(1)).alias("b"))


def each_line(docs: DataFrame, config: LineConfig) -> DataFrame:
    """``(_doc, at, a, b, site)`` of every line that counts."""
    line = F.col("_line")
    return (docs.select("_doc", F.col("_site").alias("site"), F.posexplode(_lines(F.col("_text"))).alias("at", "_line"))
            .filter(F.length(F.trim(line)) >= config.least_chars)
            .select("_doc", "at", _key(line).alias("_k"), "site").select("_doc", "at", "_k.a", "_k.b", "site"))


def boilerplate(lines: DataFrame, config: LineConfig) -> DataFrame:
    """``(a, b, sites)``: hashes of lines from at least ``config.least_sites`` distinct sites."""
    low, high = config.least_sites * (1 - config.margin), config.least_sites * (1 + config.margin)
    # Equal lines of one site meet in the map tasks first; what is left is a row per line and site and task.
    spread = lines.filter("site is not null").groupBy("a", "b").agg(
        F.hll_sketch_agg(F.col("site").cast("string"), config.log2).alias("_s"))
    spread = materialize(spread.select("a", "b", F.hll_sketch_estimate("_s").alias("sites")).filter(F.col("sites") >= low),
                         "line-spread")
    near = spread.filter(F.col("sites") <= high).select("a", "b")
    exact = (lines.filter("site is not null").join(near, ["a", "b"], "left_semi").select("a", "b", "site").distinct()
             .groupBy("a", "b").agg(F.count("*").alias("sites")).filter(F.col("sites") >= config.least_sites))
    return spread.filter(F.col("sites") > high).unionByName(exact)


def remove_boilerplate(docs: DataFrame, site: str = "source", config: LineConfig = LineConfig()) -> DataFrame:
    """``docs`` with text without cross-site lines; adds n_lines and n_removed.

    One copy of each such line stays, the one in the document with the smallest ``doc_id`` and
    there the first, so that of copied documents one keeps its text. Lines end at a line feed;
    blank lines always stay, and so do all lines of rows without a site, unless other
    sites make them boilerplate. Null text stays null and has no line. Rows are told apart by
    ``doc_id`` and text; repeated rows get equal results. A null ``doc_id`` comes first. All other columns stay;
    existing n_lines and n_removed go. An empty table gives no rows.
    """
    names = [c for c in docs.columns if c.lower() not in ("n_lines", "n_removed")]
    data = docs.select(packed(docs, "n_lines", "n_removed"), F.col("doc_id").cast("long").alias("_id"),
                       F.col(site).alias("_site"), text_or_empty().alias("_text")).withColumn("_doc", F.struct(
        F.col("_id").alias("id"), F.xxhash64("_text").alias("h")))
    lines = each_line(data, config)
    shared = materialize(boilerplate(lines, config), "boilerplate")
    met = materialize(lines.join(shared, ["a", "b"]).select("a", "b", "_doc", "at"), "boilerplate-places")
    first = met.groupBy("a", "b").agg(F.min(F.struct("_doc", "at")).alias("_first"))
    gone = (met.join(first, ["a", "b"]).filter(F.struct("_doc", "at") != F.col("_first"))
            .select("_doc", "at").distinct()
            .groupBy("_doc").agg(F.collect_list("at").alias("_gone")))
    same = [F.coalesce("_doc.id", F.lit(0)).alias("_a"), F.col("_doc.id").isNull().alias("_b"), F.col("_doc.h").alias("_c")]
    kept = data.select("*", *same).join(gone.select(*same, "_gone"), ["_a", "_b", "_c"], "left")
    # A map looks up every line in constant time.
    places = F.map_from_arrays("_gone", "_gone")
    rest = F.filter(_lines(F.col("_text")), lambda line, i: ~F.map_contains_key(places, i))
    text = F.when(F.col("_gone").isNull(), F.col("_row.text")).otherwise(F.array_join(rest, "\n"))
    n = F.when(F.col("_row.text").isNull(), 0).otherwise(F.size(_lines(F.col("_text"))))
    return kept.select(*[text.alias(c) if c == "text" else F.col(f"_row.`{c}`") for c in names],
                       n.cast("long").alias("n_lines"),
                       F.when(F.col("_gone").isNull(), 0).otherwise(F.size("_gone")).cast("long").alias("n_removed"))
