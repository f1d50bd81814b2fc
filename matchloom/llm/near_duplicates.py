"""Near duplicates by order MinHash, verified by banded alignment.

A document is its sequence of shingles of five words. Each of ``sketches`` hash functions
picks the ``picks`` smallest shingles, where a repeated shingle counts as another one each
time (it is labelled with its occurrence), and keeps them in the order of the text: two texts
agree on a sketch if the same shingles are smallest in both and stand in the same order, so
agreement falls with edit distance and not only with the overlap of sets. As many sketches of the
plain set of shingles, without order and labels, find copies in another order or with other
numbers of repeats.

Texts that agree on a sketch are candidates. In small groups each pair is one. In larger groups
a text meets leaders only, round by round: one order of all texts, by their number of neighbours, makes the same few
texts lead all groups of a family, and texts that are linked already meet nobody. Those that are outside
their group's main component after the last round (the rest) meet every text of such groups that shares one of their rarest
shingles and could be a link by length, place and symmetric difference: filters that lose no
link, so that no pair between two components of a group stays untested. A pair is a link if an alignment of the
shingle sequences, banded by the edits that the threshold allows, matches enough of them, or if their shingle
sets are that similar.

Equal texts are one text with several documents throughout.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from matchloom.llm.common import materialize, packed, slices, text_or_empty
from matchloom.llm.components import components

WORD = re.compile(r"\w+")
SLOTS = 1 << 20


@dataclass(frozen=True)
class NearConfig:
    """``small``: texts in a group up to which all its pairs are candidates. ``rounds``: how often the texts of
    larger groups meet leaders; then all that is left is compared by its rarest shingles."""

    shingle: int = 5
    similarity: float = 0.8
    sketches: int = 16
    picks: int = 3
    small: int = 8
    rounds: int = 2


def words(text: str) -> list[str]:
    return WORD.findall(text.lower())


def shingles(tokens: list[str], size: int) -> list[tuple[str, ...]]:
    """All runs of ``size`` words; a shorter text is one shingle."""
    if len(tokens) <= size:
        return [tuple(tokens)] if tokens else []
    return list(zip(*(tokens[i:] for i in range(size))))


class WordHashes(dict):
    """64-bit hashes of words, the same in every worker."""

    limit = 300_000

    def __missing__(self, word: str) -> int:
        value = self[word] = int.from_bytes(hashlib.blake2b(word.encode("utf-8", "surrogatepass"),
                                                            digest_size=8).digest(), "little")
        return value


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def hashed(hashes: np.ndarray, size: int) -> np.ndarray:
    """Hashes of the shingles."""
    n = max(1, len(hashes) - size + 1)
    total = np.zeros(n, np.uint64)
    for i in range(min(size, len(hashes))):
        total = _mix(total * np.uint64(31) + hashes[i:i + n])
    return total


def labelled(hashes: np.ndarray, size: int) -> tuple[np.ndarray, int]:
    """Hashes of the shingles with their occurrence numbers, and how many are distinct."""
    total = hashed(hashes, size)
    n = len(total)
    order = np.argsort(total, kind="stable")
    ranked = total[order]
    fresh = np.concatenate([[True], ranked[1:] != ranked[:-1]])
    distinct = int(fresh.sum())
    if distinct < n:
        start = np.maximum.accumulate(np.where(fresh, np.arange(n), 0))
        nth = np.empty(n, np.uint64)
        nth[order] = (np.arange(n) - start).astype(np.uint64)
        # A first one is the plain shingle, so that texts with and without repeats can agree.
        total = np.where(nth > 0, _mix(total + nth * np.uint64(0x9E3779B97F4A7C15)), total)
    return total, distinct


def sketch(hashes: np.ndarray, config: NearConfig) -> np.ndarray:
    """One key per hash function."""
    picks = min(config.picks, len(hashes))
    keys = np.empty(config.sketches, np.int64)
    seeds = _mix(np.arange(1, config.sketches + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    block = max(1, min(config.sketches, 2_000_000 // len(hashes)))
    for a in range(0, config.sketches, block):
        value = (hashes[None, :] ^ seeds[a:a + block, None]) * np.uint64(0xFF51AFD7ED558CCD)
        value ^= value >> np.uint64(32)
        least = np.argpartition(value, picks - 1, axis=1)[:, :picks]
        least.sort(axis=1)  # the order of the text
        key = np.zeros(len(least), np.uint64)
        for k in range(picks):
            key = _mix(key * np.uint64(31) + hashes[least[:, k]])
        keys[a:a + block] = key.view(np.int64)
    return keys


def aligned(a: list, b: list, band: int) -> int:
    """Length of the longest common subsequence within ``band`` of the diagonal, 64 cells a step."""
    first = 0
    while first < min(len(a), len(b)) and a[first] == b[first]:
        first += 1
    last = 0
    while last < min(len(a), len(b)) - first and a[-1 - last] == b[-1 - last]:
        last += 1
    a, b = a[first:len(a) - last], b[first:len(b) - last]
    if not a or not b:
        return first + last
    places: dict = {}
    for i, s in enumerate(a):
        places.setdefault(s, []).append(i)
    full = (1 << len(a)) - 1
    row = full
    for j, s in enumerate(b):
        at = places.get(s)
        if at:
            match = 0
            for i in at:
                if -band <= i - j <= band:
                    match |= 1 << i
            u = row & match
            row = ((row + u) | (row - u)) & full
    return first + last + len(a) - row.bit_count()


def linked(a: list, b: list, left: set, right: set, least: float) -> bool:
    """Whether ``similarity`` is from ``least`` on; aligned only if what they share would do in any order."""
    common = len(left & right)
    if common / (len(left) + len(right) - common) >= least:
        return True
    if len(left) == len(a) or len(right) == len(b):  # without repeats on one side, no more can match
        return False
    same = (Counter(a) & Counter(b)).total()
    return same / (len(a) + len(b) - same) >= least and similarity(a, b, least) >= least


def similarity(a: list, b: list, least: float) -> float:
    """Matched share of two shingle sequences, or of their sets if that is more."""
    if not a or not b:
        return 0.0
    band = int((len(a) + len(b)) * (1 - least) / (1 + least)) + 1
    same = aligned(a, b, band)
    left, right = set(a), set(b)
    common = len(left & right)
    return max(same / (len(a) + len(b) - same), common / (len(left) + len(right) - common))


def sketches(docs: DataFrame, config: NearConfig) -> DataFrame:
    """``(doc_id, key, n, u, keys)`` of ``docs(doc_id, text, key)``; no words, no keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordHashes()
        for part in slices(batches):
            if len(known) > known.limit:
                known.clear()
            rows = []
            for doc, text, key in zip(*(c.to_pylist() for c in part.columns)):
                tokens = words(text)
                if not tokens:
                    rows.append((doc, key, 0, 0, []))
                else:
                    hashes = np.fromiter(map(known.__getitem__, tokens), np.uint64, len(tokens))
                    each, distinct = labelled(hashes, config.shingle)
                    # Sorted distinct shingles have one order for all texts, so these keys depend on the set alone.
                    plain = np.unique(hashed(hashes, config.shingle))
                    rows.append((doc, key, len(each), distinct, np.concatenate([sketch(each, config), sketch(plain, config)])))
            kinds = (pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.list_(pa.int64()))
            columns = list(zip(*rows)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)],
                                             ["doc_id", "key", "n", "u", "keys"])

    return docs.select("doc_id", "text", "key").mapInArrow(
        run, "doc_id long, key binary, n long, u long, keys array<long>")


def close(config: NearConfig, one: Callable[[str], Column], other: Callable[[str], Column]) -> Column:
    """Whether the numbers of shingles or of distinct shingles of two texts allow a link."""
    ratio = [F.least(one(x), other(x)) >= config.similarity * F.greatest(one(x), other(x)) for x in ("n", "u")]
    return ratio[0] | ratio[1]


def small_pairs(groups: DataFrame, config: NearConfig) -> DataFrame:
    """All pairs ``(a, b)``, a < b, of groups of up to ``config.small`` texts in ``groups(bucket, size, id, n, u)``."""
    left = groups.filter(F.col("size") <= config.small)
    right = left.select("bucket", *[F.col(c).alias(f"{c}2") for c in ("id", "n", "u")])
    return left.join(right, "bucket").filter("id < id2").filter(
        close(config, F.col, lambda x: F.col(f"{x}2"))).select(
        F.col("id").alias("a"), F.col("id2").alias("b")).distinct()


def rest_of(large: DataFrame, roots: DataFrame | None) -> DataFrame:
    """``(bucket, id, n, u, weight, root, rest)`` of the groups of ``large(buckets, id, n, u, weight)``, one row a text
    there: the root of each text and whether it is outside its group's main component.

    That is the one with the most texts there, then the one with the heaviest text; groups that are one component
    go. All groups follow one order of texts, so related groups agree on their leaders. Without ``roots`` each
    text is a component.
    """
    named = large.withColumn("root", F.col("id")) if roots is None else large.join(roots, "id")
    tied = named.select(F.explode("buckets").alias("bucket"), "id", "n", "u", "weight", "root")
    most = tied.groupBy("bucket", "root").agg(F.count("*").alias("c"), F.max("weight").alias("w")).groupBy("bucket").agg(
        F.max(F.struct("c", "w", "root")).alias("m"), F.count("*").alias("parts")).filter("parts > 1").select(
        "bucket", F.col("m.root").alias("main"))
    return tied.join(most, "bucket").select(*tied.columns, (F.col("root") != F.col("main")).alias("rest"))


def leader_pairs(told: DataFrame, asked: DataFrame, config: NearConfig) -> DataFrame:
    """Pairs ``(id, other)`` of texts outside the main component with a leader.

    In each group of ``told`` (by ``rest_of``) the heaviest text of the main component leads, and so does
    the heaviest outside. Of all leaders of its groups that it has not met (``asked(id, others)``), a text meets
    the heaviest of either kind: two pairs a text at most, however many groups it is in.
    """
    text = F.struct("weight", "id", "n", "u", "root")
    leaders = told.groupBy("bucket").agg(
        F.max(F.when(~F.col("rest"), text)).alias("inside"), F.max(F.when(F.col("rest"), text)).alias("outside"))

    def best(leader: str) -> Column:
        own = F.col(leader)
        new = (own["root"] != F.col("root")) & ~F.coalesce(F.array_contains("others", own["id"]), F.lit(False))
        good = new & close(config, F.col, lambda x: own[x])
        return F.max(F.when(good, F.struct(own["weight"], own["id"])))

    met = told.filter("rest").join(leaders, "bucket").join(asked, "id", "left").groupBy("id").agg(
        best("inside").alias("one"), best("outside").alias("two"))
    return met.select("id", F.explode(F.array_compact(F.array("one.id", "two.id"))).alias("other"))


def joined(roots: DataFrame, links: DataFrame) -> DataFrame:
    """``roots(id, root)`` after more ``links(a, b)``; only links between two components count."""
    one = roots.select(F.col("id").alias("a"), F.col("root").alias("x"))
    two = roots.select(F.col("id").alias("b"), F.col("root").alias("y"))
    between = links.join(one, "a").join(two, "b").filter("x != y").select(
        F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
    moved = components(between).select(F.col("id").alias("root"), F.col("root").alias("_to"))
    return materialize(roots.join(moved, "root", "left").select("id", F.coalesce("_to", "root").alias("root")), "roots")


def verified(pairs: DataFrame, texts: DataFrame, config: NearConfig) -> DataFrame:
    """The pairs that are links; ``texts(id, text)``."""
    size, least = config.shingle, config.similarity

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        recent: dict[int, tuple[list, set]] = {}

        def of(name: int, text: str) -> tuple[list, set]:
            if name not in recent:
                if len(recent) >= 64:
                    recent.clear()
                each = shingles(words(text), size)
                recent[name] = each, set(each)
            return recent[name]

        for part in slices(batches, "text"):
            good = []
            for a, b, x, y in zip(*(c.to_pylist() for c in part.columns)):
                (p, left), (q, right) = of(a, x), of(b, y)
                if p and q and linked(p, q, left, right, least):
                    good.append((a, b))
            yield pa.RecordBatch.from_arrays([pa.array([g[i] for g in good], pa.int64()) for i in (0, 1)], ["a", "b"])

    other = texts.select(F.col("id").alias("b"), F.col("text").alias("text_b"))
    first = texts.select(F.col("id").alias("a"), "text")
    return (pairs.join(other, "b").join(first, "a").select("a", "b", "text", "text_b")
            .mapInArrow(run, "a long, b long"))


def order_counts(texts: DataFrame, config: NearConfig) -> np.ndarray:
    """How many texts have a shingle in each of ``SLOTS`` slots: rare before common, whatever the corpus.

    Repeated shingles count with their labels, first ones without: so the order holds for both kinds.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, total = WordHashes(), np.zeros(SLOTS, np.int64)
        for part in slices(batches):
            for text in part.column(0).to_pylist():
                np.add.at(total, token_sets(text, known, config)[-1] & np.uint64(SLOTS - 1), 1)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array(total[used])], ["slot", "n"])

    found = texts.select("text").mapInArrow(run, "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(SLOTS, np.int64)
    out[found.column("slot").to_numpy()] = found.column("n").to_numpy()
    return out


def token_sets(text: str, known: WordHashes, config: NearConfig) -> list[np.ndarray]:
    """Distinct shingles, and if some repeat, those labelled with their occurrence as well."""
    if len(known) > known.limit:
        known.clear()
    tokens = words(text)
    each, distinct = labelled(np.fromiter(map(known.__getitem__, tokens), np.uint64, len(tokens)), config.shingle)
    plain = bare(tokens, known, config) if distinct < len(each) else each
    return [plain, each] if distinct < len(each) else [plain]


def bare(tokens: list[str], known: WordHashes, config: NearConfig) -> np.ndarray:
    return np.unique(hashed(np.fromiter(map(known.__getitem__, tokens), np.uint64, len(tokens)), config.shingle))


def parities(tokens: np.ndarray) -> np.ndarray:
    """In 1,024 slots, whether the number of shingles is odd, as 16 numbers. Two texts differ in at most as many
    bits as in shingles."""
    odd = np.bincount((tokens >> np.uint64(40)).astype(np.int64) & 1023, minlength=1024) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def rare_shingles(texts: DataFrame, config: NearConfig) -> DataFrame:
    """``(id, root, rest, kind, size, at, token, bits)``: the rarest shingles of each of ``texts(id, text, root, rest)``.

    Two sets of shares from ``config.similarity`` on have one of these in common, in any order of
    shingles that all texts follow. Kind 0: distinct shingles; kind 1: labelled ones, of texts that
    repeat some (if one of two texts repeats none, the distinct ones share no less). ``bits`` are the
    parities of the whole set.
    """
    counts = texts.sparkSession.sparkContext.broadcast(order_counts(texts, config))
    least = config.similarity

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordHashes()
        for part in slices(batches, "text", 200_000):
            out: list[list[np.ndarray]] = [[], [], [], [], [], [], []]
            bits = []
            for name, text, root, rest in zip(*(c.to_pylist() for c in part.columns)):
                for kind, tokens in enumerate(token_sets(text, known, config)):
                    size = len(tokens)
                    n = size - math.ceil(least * size - 1e-6) + 1
                    first = tokens[np.lexsort((tokens, counts.value[tokens & np.uint64(SLOTS - 1)]))[:n]]
                    n = len(first)
                    for column, x in zip(out, (np.full(n, name), np.full(n, root), np.full(n, rest), np.full(n, kind),
                                               np.full(n, size), np.arange(n), first.view(np.int64))):
                        column.append(x)
                    bits.append(np.tile(parities(tokens), n))
            flat = np.concatenate(bits)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) + 1, 16), pa.int32()), pa.array(flat))
            yield pa.RecordBatch.from_arrays([*(pa.array(np.concatenate(c)) for c in out), lists],
                                             ["id", "root", "rest", "kind", "size", "at", "token", "bits"])

    return texts.select("id", "text", "root", "rest").mapInArrow(
        run, "id long, root long, rest boolean, kind long, size long, at long, token long, bits array<long>")


def rest_pairs(told: DataFrame, roots: DataFrame, texts: DataFrame, config: NearConfig) -> DataFrame:
    """Pairs ``(a, b)``, a < b, of two components that could be links, one of them a rest in ``told(id, rest)``."""
    least = config.similarity
    asked = told.groupBy("id").agg(F.max("rest").alias("rest")).join(roots, "id")
    held = materialize(texts.join(asked, "id"), "rest-texts")
    rare = materialize(rare_shingles(held, config), "rare-shingles")
    mine = rare.filter("rest").drop("rest")
    other = rare.select(*[F.col(c).alias(f"{c}2") for c in mine.columns])

    def enough(common: Column) -> Column:
        return common * (1 + least) >= (F.col("size") + F.col("size2")) * least - 1e-6

    # The first one in common stands so early on both sides that what follows suffices; the parities tell
    # how many shingles the two differ in at least.
    apart = reduce(lambda x, y: x + y, [F.bit_count(F.get("bits", F.lit(i)).bitwiseXOR(F.get("bits2", F.lit(i))))
                                        for i in range(16)])
    met = mine.join(other, (F.col("kind") == F.col("kind2")) & (F.col("token") == F.col("token2"))
                    & (F.col("root") != F.col("root2"))
                    & enough(F.least(F.col("size") - F.col("at"), F.col("size2") - F.col("at2")))
                    & enough((F.col("size") + F.col("size2") - apart) / 2))
    return met.select(F.least("id", "id2").alias("a"), F.greatest("id", "id2").alias("b")).distinct()


def members(data: DataFrame, config: NearConfig) -> DataFrame:
    """``(doc_id, key, root)`` of each row of ``data(doc_id, text, key)``; rows of one root are a class, and
    those without words have none."""
    every = materialize(sketches(data, config), "sketches")
    one = every.filter("n > 0").groupBy("key").agg(F.first("n").alias("n"), F.first("u").alias("u"), F.first("keys").alias("keys"))
    # Written once, so the numbers stay what they are.
    distinct = materialize(one.withColumn("id", F.monotonically_increasing_id()), "texts")
    bands = distinct.select("id", "n", "u", F.posexplode("keys").alias("band", "value")).select(
        F.xxhash64("band", "value").alias("bucket"), "id", "n", "u")
    shared = bands.groupBy("bucket").agg(F.count("*").alias("size")).filter("size > 1")
    groups = materialize(bands.join(shared, "bucket"), "groups")
    wanted = groups.select("id").distinct().join(distinct.select("id", "key"), "id")
    texts = materialize(
        data.join(wanted, "key").groupBy("id").agg(F.first("text").alias("text")), "candidate-texts")
    roots = joined(texts.select("id", F.col("id").alias("root")),
                   verified(materialize(small_pairs(groups, config), "pairs"), texts, config))
    # A text is in as many groups as it has sketches, at most.
    weighed = groups.groupBy("id").agg(F.first("n").alias("n"), F.first("u").alias("u"), F.sum("size").alias("weight"),
                                       F.collect_list(F.when(F.col("size") > config.small, F.col("bucket"))).alias("buckets"))
    large = materialize(weighed.filter(F.size("buckets") > 0), "large-groups")
    met = data.sparkSession.createDataFrame([], "id long, other long")
    done = met.select(F.least("id", "other").alias("a"), F.greatest("id", "other").alias("b"))
    for turn in range(config.rounds + 1):
        # Links within small groups say little about large ones: they count from the second round on.
        told = materialize(rest_of(large, roots if turn else None), "rest")
        if not told.take(1):
            break
        if turn < config.rounds:
            # At most two others a text and round.
            asked = met.groupBy("id").agg(F.collect_list("other").alias("others"))
            fresh = materialize(leader_pairs(told, asked, config), "pairs")
            met = met.unionByName(fresh)
            done = met.select(F.least("id", "other").alias("a"), F.greatest("id", "other").alias("b")).distinct()
            pairs = fresh.select(F.least("id", "other").alias("a"), F.greatest("id", "other").alias("b")).distinct()
        else:
            pairs = materialize(rest_pairs(told, roots, texts, config).join(done, ["a", "b"], "left_anti"), "pairs")
        roots = joined(roots, verified(pairs, texts, config))
    return every.join(distinct.select("key", "id"), "key", "left").join(roots, "id", "left").select(
        "doc_id", "key", F.coalesce("root", "id").alias("root"))


def keyed(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long"), text_or_empty().alias("text"), _text_key().alias("key"))


def _text_key() -> Column:
    return F.unhex(F.md5(F.encode(text_or_empty(), "UTF-8")))


def one_of_each(docs: DataFrame, config: NearConfig = NearConfig()) -> DataFrame:
    """Rows of ``docs``: one of each class, and all without words.

    The row with the smallest ``doc_id`` stays (null last, then by a hash of the text); of
    rows that are equal in both, the first by its columns.
    """
    every = materialize(members(keyed(docs), config), "members")
    # Copies are counted before classes, so that no task holds a class.
    pairs = every.groupBy("root", "doc_id", "key").agg(F.count("*").alias("copies"))
    first = pairs.filter("root is not null").groupBy("root").agg(F.min(F.struct(
        F.col("doc_id").isNull().alias("none"), "doc_id", "key", "copies")).alias("x")).select("x.doc_id", "x.key", "x.copies")
    alone = pairs.filter("root is null").select("doc_id", "key", F.lit(1).cast("long").alias("copies"))
    stay = materialize(first.unionByName(alone).select(F.col("doc_id").alias("_i"), F.col("key").alias("_k"), "copies"), "stay")
    rows = docs.select(packed(docs), F.col("doc_id").cast("long").alias("_id"), _text_key().alias("_key"))
    same = F.col("_id").eqNullSafe(F.col("_i")) & (F.col("_key") == F.col("_k"))
    kept = rows.join(stay.filter("copies = 1"), same, "left_semi").select("_row")
    if stay.filter("copies > 1").take(1):
        several = rows.join(stay.filter("copies > 1"), same, "left_semi").groupBy("_id", "_key").agg(
            F.min_by("_row", F.to_json("_row")).alias("_row"))
        kept = kept.unionByName(several.select("_row"))
    return kept.select("_row.*")


def near_duplicates(docs: DataFrame, config: NearConfig = NearConfig()) -> DataFrame:
    """One row per document: doc_id, class_id, class_size, kept.

    ``class_id`` is the smallest ``doc_id`` of the class, and the document that has it is kept.
    Links are pairs of texts with similarity from ``config.similarity`` on; classes are their connected components. Texts without words (null
    and empty ones too) are no copies of each other: each is a class of its own. A row with a null ``doc_id``
    belongs to its class, but names it only if all its rows lack one; it is kept only then. Repeated rows
    are members each. An empty table gives no rows; other columns are not read.
    """
    every = materialize(members(keyed(docs), config), "members")
    member = every.filter("root is not null")
    classes = member.groupBy("root").agg(F.min("doc_id").alias("class_id"), F.count("*").alias("class_size"))
    grouped = member.join(classes, "root").select("doc_id", "class_id", "class_size")
    alone = every.filter("root is null").select(
        "doc_id", F.col("doc_id").alias("class_id"), F.lit(1).cast("long").alias("class_size"))
    return grouped.unionByName(alone).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("class_id")))
