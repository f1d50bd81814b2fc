"""Language of texts by Bayesian fusion of four kinds of evidence.

* text: log-likelihood of hashed byte trigrams per language, with an extra class of
  unknown text that gives every trigram the same chance;
* markup: the language that the page declares;
* address: the suffix of its host;
* host: a prior of its host, smoothed toward the prior of its suffix, which is smoothed
  toward the corpus. These come from grouped sums over all rows.

The trigram tables are fitted on a bounded sample of rows with a declared language
(``LanguageConfig.sample`` rows per language); all else covers every row.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from matchloom.llm.common import materialize, packed, slices

BUCKETS = 1 << 16
UNKNOWN = "und"


@dataclass(frozen=True)
class LanguageConfig:
    """Parameters; languages are the declared ones with at least ``least_rows`` rows.

    ``sample``: about so many rows per language, picked by hash, train the trigrams.
    ``weight``: trigrams of one text count as at most so many independent ones.
    ``declared``: trust in a declared language. ``host``, ``suffix``: rows that a host needs
    to outweigh its suffix, and a suffix to outweigh the corpus. ``keep``: least posterior of
    an accepted language.
    """

    sample: int = 500
    least_rows: int = 3
    weight: float = 60.0
    declared: float = 0.8
    host: float = 20.0
    suffix: float = 50.0
    keep: float = 0.5
    unknown: float = 0.005
    floor: float = 0.7


def trigrams(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the byte trigrams of lower-cased texts, and where each text begins."""
    raw = [(" " + t.lower() + " ").encode() if t and t.strip() else b"" for t in texts]
    flat = np.frombuffer(b"".join(raw) + b"\0\0", np.uint8).astype(np.uint32)
    code = flat[:-2] * np.uint32(65536) + flat[1:-1] * np.uint32(256) + flat[2:]
    code = ((code * np.uint32(2654435761)) >> np.uint32(16)).astype(np.int32)
    sizes = np.fromiter(map(len, raw), np.int64, len(raw))
    return code, np.concatenate([[0], np.cumsum(sizes)])


class TextModel:
    """Mean log-likelihood per trigram of each language and of unknown text.

    Only used buckets are stored, bucket by bucket; in all others a language has its ``base``,
    so that the table grows with what its languages use and not with their number.
    """

    def __init__(self, languages: list[str], language: np.ndarray, bucket: np.ndarray, n: np.ndarray):
        self.languages = languages
        total = np.bincount(language, n, minlength=len(languages)) + 0.05 * BUCKETS
        self.base = np.log(0.05 / total)
        order = np.lexsort((language, bucket))
        self.language = language[order].astype(np.int32)
        self.gain = np.log1p(n[order] / 0.05).astype(np.float32)
        self.start = np.searchsorted(bucket[order], np.arange(BUCKETS + 1))

    def scores(self, texts: list[str | None], weight: float, floor: float) -> Iterator[np.ndarray]:
        """For each text: log-likelihoods per language, then of the unknown class."""
        code, edges = trigrams(texts)
        sizes = np.maximum(edges[1:] - edges[:-1] - 2, 0)  # without those that cross into the next text
        # Unknown text: what a trigram costs beyond ``floor`` times the mean of uniform buckets.
        for a, size in zip(edges[:-1], sizes):
            out = np.zeros(len(self.languages) + 1)
            if size:
                used, times = np.unique(code[a:a + size], return_counts=True)
                first, held = self.start[used], self.start[used + 1] - self.start[used]
                at = np.repeat(first - np.cumsum(held) + held, held) + np.arange(held.sum())
                gain = np.bincount(self.language[at], self.gain[at] * np.repeat(times, held), minlength=len(self.languages))
                out[:-1] = (self.base + gain / size) * min(weight, size)
                out[-1] = -floor_cost(floor) * min(weight, size)
            yield out


def floor_cost(floor: float) -> float:
    """Cost per trigram of unknown text: between uniform buckets and certain ones."""
    return float(np.log(BUCKETS) * (0.5 + floor / 2))


def host_of(url: Column) -> Column:
    """Lower-cased host of an address; text that is no address is a host itself."""
    bare = F.lower(F.regexp_replace(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://", ""))
    return F.regexp_extract(bare, r"^(?:[^/?#]*@)?([^/?#:]*)", 1)


def suffix_of(host: Column) -> Column:
    """What follows the last dot; empty for a host without one."""
    return F.when(F.instr(host, ".") > 0, F.substring_index(host, ".", -1)).otherwise("")


def primary(tag: Column) -> Column:
    """Primary part of a language tag in lower case; empty for none.

    Language codes have two or three letters, so there are 26^2 + 26^3 at most, whatever a table declares.
    """
    return F.lower(F.regexp_extract(F.trim(F.coalesce(tag.cast("string"), F.lit(""))), r"^([A-Za-z]{2,3})(?![A-Za-z])", 1))


def fit_text(docs: DataFrame, config: LanguageConfig) -> TextModel:
    """Trigram counts per declared language over the bounded sample."""
    named = docs.select(primary(F.col("_declared")).alias("language"), F.col("_text").alias("text"),
                        F.xxhash64("_row", "_text").alias("_h")).filter(
        "language != '' and text is not null and trim(text) != ''")
    rows = {r["language"]: r["n"] for r in named.groupBy("language").agg(F.count("*").alias("n"))
            .filter(F.col("n") >= config.least_rows).collect()}
    languages = sorted(rows)
    place = {name: i for i, name in enumerate(languages)}
    if not languages:
        return TextModel([], *np.zeros((3, 0), np.int64))
    # A share of each language's rows, by a hash of the row: narrow, and the same on every run. The table of
    # shares has a row per language code; the texts are never what is sent.
    share = docs.sparkSession.createDataFrame(
        [(name, int(min(1.0, config.sample / n) * (1 << 30))) for name, n in rows.items()], "language string, _share long")
    sample = (named.join(F.broadcast(share), "language").filter(F.pmod("_h", F.lit(1 << 30)) <= F.col("_share"))
              .select("language", "text").distinct())

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            names = part.column(0).to_pylist()
            code, edges = trigrams(part.column(1).to_pylist())
            total: dict[str, dict[int, float]] = {}
            for name, a, b in zip(names, edges[:-1], edges[1:]):
                # A text weighs at most as much as 2,000 trigrams, so that none rules the table.
                used, n = np.unique(code[a:max(a, b - 2)], return_counts=True)
                own, scale = total.setdefault(name, {}), min(1.0, 2000 / max(1, b - a))
                for bucket, times in zip(used.tolist(), n.tolist()):
                    own[bucket] = own.get(bucket, 0.0) + times * scale
            for name, own in total.items():
                yield pa.RecordBatch.from_arrays(
                    [pa.array([place[name]] * len(own), pa.int32()), pa.array(list(own), pa.int32()),
                     pa.array(list(own.values()), pa.float64())], ["language", "bucket", "n"])

    # One row per language and bucket that its sample uses.
    found = sample.mapInArrow(count, "language int, bucket int, n double").groupBy(
        "language", "bucket").agg(F.sum("n").alias("n")).toArrow()
    return TextModel(languages, *(found.column(c).to_numpy() for c in ("language", "bucket", "n")))


def host_counts(scored: DataFrame) -> DataFrame:
    """``(_host, _near, _wide)``: how often text alone finds each language on the host and under
    its suffix, as ``(_best, n)`` of those that occur."""
    counts = scored.groupBy("_host", "_best").agg(F.count("*").alias("n"))
    pair = F.struct("_best", "n")
    suffixes = counts.groupBy(suffix_of(F.col("_host")).alias("_suffix"), "_best").agg(F.sum("n").alias("n")).groupBy(
        "_suffix").agg(F.collect_list(pair).alias("_wide"))
    hosts = counts.groupBy("_host").agg(F.collect_list(pair).alias("_near"))
    return hosts.withColumn("_suffix", suffix_of(F.col("_host"))).join(suffixes, "_suffix").select("_host", "_near", "_wide")


def corpus_prior(counts: DataFrame, k: int) -> np.ndarray:
    """Smoothed shares of ``k`` languages and of unknown text in ``counts`` of host_counts."""
    top = np.ones(k + 1)
    for r in counts.select(F.explode("_near").alias("x")).groupBy("x._best").agg(F.sum("x.n").alias("n")).collect():
        top[r["_best"]] += r["n"]
    return top / top.sum()


def smoothed(found: list[dict], above: np.ndarray, strength: float) -> np.ndarray:
    """Shares of the languages in ``found``, as if ``strength`` more rows had those of ``above``."""
    total = above * strength
    for x in found:
        total[x["_best"]] += x["n"]
    return total / total.sum()


def identify(docs: DataFrame, text: str = "text", declared: str | None = "lang", address: str | None = "source",
             config: LanguageConfig = LanguageConfig()) -> DataFrame:
    """``docs`` with language, posterior and accepted added (existing ones of that name go).

    Rejected (accepted is false): no language reaches ``config.keep``, which includes texts
    that look like none of the languages. Null, empty and blank texts have language "und",
    posterior null and are rejected. Null or unknown declared tags and hosts give no evidence.
    Repeated rows are judged each. Without any declared language there is nothing to learn,
    and every row is "und". ``docs`` is read three times, once for each step; texts stay whole.
    """
    none = F.lit(None).cast("string")
    host = host_of(F.col(address)) if address else F.lit("")
    data = docs.select(packed(docs, "language", "posterior", "accepted"), F.col(text).alias("_text"),
                       primary(F.col(declared) if declared else none).alias("_declared"), host.alias("_host"))
    model = fit_text(data, config)
    k = len(model.languages)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    weight, floor = config.weight, config.floor

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "_text"):
            texts = part.column(part.schema.get_field_index("_text")).to_pylist()
            out = shared.value.scores(texts, weight, floor)
            yield pa.RecordBatch.from_arrays(
                [part.column(part.schema.get_field_index("_host")),
                 pa.array([int(o.argmax()) if t and t.strip() else k for o, t in zip(out, texts)], pa.int32())],
                ["_host", "_best"])

    scored = data.select("_host", "_text").mapInArrow(score, "_host string, _best int")
    priors = materialize(host_counts(scored), "host-counts")
    top = corpus_prior(priors, k)
    trust, unknown = config.declared, config.unknown
    kept = data.join(priors, "_host", "left")

    def fuse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        place = {name: i for i, name in enumerate(model.languages)}
        for part in slices(batches, "_text"):
            get = lambda c: part.column(part.schema.get_field_index(c)).to_pylist()
            texts = get("_text")
            # Rows of a host stand next to each other, mostly.
            last, prior = None, None
            near, wide = (part.column(part.schema.get_field_index(c)) for c in ("_near", "_wide"))
            language, sure, good = [], [], []
            for i, (t, row, tag, host) in enumerate(zip(texts, model.scores(texts, weight, floor), get("_declared"),
                                                        get("_host"))):
                if not t or not t.strip() or not k:
                    language.append(UNKNOWN), sure.append(None), good.append(False)
                    continue
                if prior is None or host != last:
                    last, prior = host, np.log(smoothed(
                        near[i].as_py() or [], smoothed(wide[i].as_py() or [], top, config.suffix), config.host))
                row[-1] += np.log(unknown)
                row += prior
                if tag in place:  # a declaration favours its language over each other one
                    row[:k] += np.log((1 - trust) / max(1, k - 1) if k > 1 else 1.0)
                    row[place[tag]] += np.log(trust) - (np.log((1 - trust) / (k - 1)) if k > 1 else 0.0)
                    row[k] += np.log(1.0 / k)
                p = np.exp(row - row.max())
                p /= p.sum()
                best = int(p.argmax())
                language.append(model.languages[best] if best < k else UNKNOWN)
                sure.append(float(p[best]))
                good.append(best < k and float(p[best]) >= keep)
            yield pa.RecordBatch.from_arrays(
                [part.column(part.schema.get_field_index("_row")), pa.array(language, pa.string()),
                 pa.array(sure, pa.float64()), pa.array(good, pa.bool_())],
                ["_row", "language", "posterior", "accepted"])

    keep = config.keep
    schema = data.select("_row").schema
    for name, kind in (("language", "string"), ("posterior", "double"), ("accepted", "boolean")):
        schema = schema.add(name, kind)
    return kept.mapInArrow(fuse, schema).select("_row.*", "language", "posterior", "accepted")
