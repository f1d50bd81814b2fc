"""Whitening, periodic runs and shards next to plain computations, and their odd cases."""

import random
import zlib

import numpy as np
import pytest
from brute import sha
from pyspark.sql import functions as F

from matchloom.llm import periodic_runs, sharding, whitening
from matchloom.llm.queries import QUERIES, repeated_words
from matchloom.operators.shared import new_folder


def plain_runs(words, least=24, copies=3):
    """All runs by comparing every word with those at each distance."""
    n, out = len(words), []
    for q in range(1, n // copies + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            run = words[i:j + q]
            if j - i + q >= max(least, copies * q) and not any(run[r:] == run[:-r] for r in range(1, q)):
                out.append((i, j - i + q, q))
            i = j + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def plain_collapse(words, found):
    gone = {i for start, length, q in found for i in range(start + q, start + length)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def blanks(text):
    return (text or "").encode().split()


def test_squared_differences_are_exact():
    rng = np.random.default_rng(4)
    for width, size, offsets in ((8, 32, 15), (16, 32, 16), (512, 1024, 512)):
        a, b = rng.integers(0, 1000, (3, width)), rng.integers(0, 1000, (3, size))
        b[0, 5:5 + width] = a[0]
        got = periodic_runs.squared_differences(a.astype(np.uint64), b.astype(np.uint64), offsets)
        want = [[int(((a[r] - b[r, o:o + width]) ** 2).sum()) for o in range(offsets)] for r in range(3)]
        assert got.tolist() == want and got[0, 5] == 0


def some_words(rng):
    """Random stretches of few or many different words, some of them repeated."""
    out = []
    while len(out) < rng.choice([0, 1, 30, 100, 400]):
        kinds = rng.choice([1, 2, 3, 40])
        unit = [b"%d" % rng.randrange(kinds) for _ in range(rng.randrange(1, 60))]
        out += (unit * 8)[:rng.randrange(len(unit), 7 * len(unit))] if rng.random() < 0.6 else unit
    return out


def test_runs_of_random_words_equal_plain_ones():
    rng, total = random.Random(11), 0
    for _ in range(150):
        texts = [some_words(rng) for _ in range(rng.choice([1, 3]))]
        want = [plain_runs(t) for t in texts]
        assert periodic_runs._batch_runs(texts, 24, 3) == want
        total += sum(map(len, want))
    assert total > 150


def test_edges_of_runs():
    find = lambda words: periodic_runs._batch_runs([words], 24, 3)[0]
    unique = [b"u%d" % i for i in range(50)]
    for q in (1, 2, 7, 8, 9, 15, 16, 17, 31, 32, 33):
        unit, least = unique[:q], max(24, 3 * q)
        for lead in (0, 1, 7, 13):
            head = [b"h%d" % i for i in range(lead)]
            assert find(head + (unit * 30)[:least] + [b"end"]) == [(lead, least, q)]
            assert find(head + (unit * 30)[:least - 1] + [b"end"]) == []
    assert find([]) == [] and find([b"a"]) == [] and find([b"a"] * 23) == []


def test_runs_of_long_texts():
    one = [b"same"] * 200_000
    far = [b"%d" % i for i in range(30_000)] * 4
    assert periodic_runs._batch_runs([one, far], 24, 3) == [[(0, 200_000, 1)], [(0, 120_000, 30_000)]]


def test_periodic_runs_of_odd_rows(spark, odd, none):
    assert periodic_runs.periodic_runs(none).count() == 0
    more = odd.withColumn("runs", F.lit(1)).withColumn("_key", F.lit(2)).unionByName(odd.limit(1).withColumn(
        "runs", F.lit(1)).withColumn("_key", F.lit(2)).withColumn("text", F.repeat(F.lit("a b\x0bc\t"), 20)))
    found = periodic_runs.periodic_runs(more)
    assert set(found.columns) == {*more.columns, "collapsed"}
    rows = found.collect()
    assert len(rows) == odd.count() + 1
    for r in rows:
        words = blanks(r["text"])
        want = plain_runs(words) if len(words) < 1000 else [(0, 4000, 1)] * (words[0] == b"ab")
        assert [tuple(x) for x in r["runs"]] == want
        assert r["collapsed"] == plain_collapse([w.decode() for w in words], want)
    with pytest.raises(ValueError):
        periodic_runs.periodic_runs(odd, least=10)


def test_runs_query(spark, small):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    rows = QUERIES["op12_periodic_runs"](spark, small).collect()
    assert len(rows) == len(docs) and sum(r["n_runs"] for r in rows) > 5
    for r in rows:
        words = blanks(docs[r["doc_id"]])
        words = repeated_words(r["doc_id"], words) if words else words
        if len(words) > 3000:  # too long for the plain version
            continue
        want = plain_runs(words)
        assert r["n_runs"] == len(want)
        assert r["runs_sha256"] == sha("".join(f"{a},{n},{q}\n" for a, n, q in want))
        assert r["collapsed_sha256"] == sha(plain_collapse([w.decode() for w in words], want))
        best = min(want, key=lambda x: (-x[1] / x[2], x[0], x[2]), default=(None,) * 3)
        assert (r["start"], r["length"], r["period"]) == best
        assert r["exponent_milli"] == (1000 * best[1] // best[2] if want else None)


def test_repeated_words_follow_their_rule():
    for doc in (0, 3, 17, 123_456, -5):
        words = [b"%d" % i for i in range(97)]
        h = zlib.crc32(str(doc).encode())
        g, n = h // 10, 97
        a, p = g % n, 1 + (n - g % n) // (3 + g % 8)
        assert repeated_words(doc, words) == (
            [words[i] if i < a else words[a + (i - a) % p] for i in range(n)] if h % 10 == 0 else words)
    assert repeated_words(None, [b"x"]) == [b"x"]


def check_shards(rows, n, shards):
    """Counts at most one apart, slots gapless, and every row once."""
    by = {k: sorted(r["slot"] for r in rows if r["shard"] == k) for k in range(shards)}
    assert sum(map(len, by.values())) == len(rows) == n
    assert max(map(len, by.values())) - min(map(len, by.values())) <= 1
    assert all(v == list(range(len(v))) for v in by.values())


def test_shards_query(spark, small):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    rows = QUERIES["op13_two_pass_shuffle"](spark, small).collect()
    check_shards(rows, len(docs), 8)
    assert {r["doc_id"] for r in rows} == set(docs) and {r["law"] for r in rows} == {"rows"}
    for r in rows:
        raw = (docs[r["doc_id"]] or "").encode()
        assert (r["size"], r["text_crc32"], r["grown_shard"]) == (len(raw) + 1, zlib.crc32(raw), None)


def shards_of(spark, docs, **kw):
    folder = new_folder(spark, "shards")
    sharding.write(docs, folder, **kw)
    return sharding.read(spark, folder, docs)


def test_shards_of_odd_rows(spark, odd, none):
    odd = odd.withColumn("Slot", F.lit("old")).withColumn("h", F.lit(1))
    got = shards_of(spark, odd, shards=3)
    assert set(got.columns) == {c for c in odd.columns if c != "Slot"} | {"slot", "shard"}
    rows = got.collect()
    check_shards(rows, odd.count(), 3)
    want = sorted(odd.drop("Slot").collect(), key=str)
    assert sorted(got.select([c for c in odd.columns if c != "Slot"]).collect(), key=str) == want
    assert shards_of(spark, none).count() == 0
    check_shards(shards_of(spark, odd.limit(2), shards=5).collect(), 2, 5)


def test_shards_are_in_random_order_and_the_same_each_time(spark):
    docs = spark.range(20_000, numPartitions=7).select(F.when(F.col("id") % 3 > 0, F.col("id")).alias("doc_id"), "id",
                                                       F.lit("the same text").alias("text"))
    order = lambda **kw: [r["id"] for r in shards_of(spark, docs, bucket_bytes=50_000, **kw).orderBy(
        "shard", "slot").select("id").collect()]
    first = order(seed=1)
    assert sorted(first) == list(range(20_000))
    assert first == order(seed=1) and first != order(seed=2)
    place = np.empty(20_000)
    place[first] = np.arange(20_000)
    # Rows stand anywhere: no trend, neighbours are far apart, parts of the input are spread evenly.
    assert abs(np.corrcoef(place, np.arange(20_000))[0, 1]) < 0.03
    assert 0.30 < np.abs(np.diff(place)).mean() / 20_000 < 0.37
    parts = np.histogram2d(np.arange(20_000) // 2500, place // 2500, bins=8)[0]
    assert ((parts - 312.5) ** 2 / 312.5).sum() < 100  # chi square of 49 degrees


def test_shards_notice_rows_in_another_order(spark, monkeypatch):
    docs = spark.range(500).select(F.col("id").alias("doc_id"), F.lit("x").alias("text"))
    starts = sharding._starts
    monkeypatch.setattr(sharding, "_starts", lambda b: starts(b.filter("_bucket > 0")))
    with pytest.raises(RuntimeError):
        shards_of(spark, docs)


def dense(rng, k):
    return [("full", rng.normal(size=(k, k))), ("low rank", rng.normal(size=(k, max(1, k // 3)))),
            ("whole numbers", np.round(rng.normal(size=(k, k)))), ("zero", np.zeros((k, k))),
            ("equal roots", np.diag(np.sqrt(rng.integers(0, 3, k))))]


def test_rank_one_updates_equal_dense_ones():
    rng = np.random.default_rng(2)
    for k in (1, 2, 5, 24):
        for name, a in dense(rng, k):
            m = a @ a.T
            roots, basis = np.linalg.eigh(m)
            for v in (rng.normal(size=k), rng.normal(size=k) * 1e-9, np.eye(k)[0], basis[:, -1] * 3, np.zeros(k),
                      np.where(np.arange(k) % 2, 0.0, 1e3)):
                got, turned = whitening.updated(roots, basis, v)
                want = m + np.outer(v, v)
                size = max(np.abs(want).max(), 1e-30)
                assert np.abs(turned @ np.diag(got) @ turned.T - want).max() < 1e-12 * k * size, (k, name)
                assert np.abs(turned.T @ turned - np.eye(k)).max() < 1e-11, (k, name)


def test_merged_spectra_equal_dense_ones():
    rng = np.random.default_rng(6)
    x = np.round(rng.normal(size=(500, 6)) * [1, 5, 0, 20, 100, 1]) + 1000
    whole = whitening.Spectrum.empty(6)
    for a, b in ((0, 1), (1, 200), (200, 350), (350, 500)):
        part = whitening.Spectrum.empty(6)
        for row in x[a:b]:
            part.add(row)
        whole.merge(part) if whole.n else whole.__dict__.update(part.__dict__)
    want = np.cov(x.T, bias=True) * 500
    assert whole.n == 500 and np.allclose(whole.mean, x.mean(axis=0))
    assert np.abs(whole.basis @ np.diag(whole.roots) @ whole.basis.T - want).max() < 1e-10 * want.max()


def check_whitened(rows, vectors, components, scale=1024.0, shift=100_000):
    ids, x = list(vectors), np.array([[int(np.floor(scale * float(c))) + shift for c in v] for v in vectors.values()])
    n, sums = len(x), x.sum(axis=0)
    y = (n * x - sums) / n
    cov = y.T @ y / n
    roots, basis = np.linalg.eigh(cov)
    got = {(r["vec_id"], r["component"]): r for r in rows}
    assert len(rows) == n * components
    white = np.array([[got[i, k + 1]["whitened"] for k in range(components)] for i in ids])
    for k in range(components):
        want = y @ basis[:, -1 - k] / np.sqrt(roots[-1 - k])
        sign = np.sign(want @ white[:, k])
        assert np.abs(white[:, k] - sign * want).max() < 1e-8
        r = got[ids[0], k + 1]
        assert r["n"] == n and abs(r["explained"] / (roots[-1 - k] / np.trace(cov)) - 1) < 1e-9
    spread = white - white.mean(axis=0)
    error = np.abs(spread.T @ spread / n - np.eye(components)).max()
    assert {r["identity_error"] for r in rows} == {rows[0]["identity_error"]}
    assert abs(rows[0]["identity_error"] - error) < 1e-11 and error < 1e-9
    for i, v in zip(ids, x.tolist()):
        assert got[i, 1]["deviation"] == sum((n * c - s) ** 2 for c, s in zip(v, sums.tolist()))


def test_whitening_query(spark, small):
    table = spark.read.parquet(f"{small}/embeddings.parquet").collect()
    good = {r["vec_id"]: r["embedding"] for r in table if r["embedding"] is not None and all(
        c is not None and np.isfinite(c) for c in r["embedding"])}
    check_whitened(QUERIES["op11_embedding_whitening"](spark, small).collect(), good, 8)


def test_whitening_in_many_partitions(spark, monkeypatch):
    monkeypatch.setattr(whitening, "ROWS", 16)
    rng = np.random.default_rng(9)
    vectors = {i: v for i, v in enumerate((rng.normal(size=(700, 5)) @ rng.normal(size=(5, 5))).tolist())}
    table = spark.createDataFrame(list(vectors.items()), "vec_id long, embedding array<double>")
    check_whitened(whitening.whiten(table, components=4).collect(), vectors, 4)


def test_whitening_of_odd_rows(spark):
    rng = np.random.default_rng(1)
    kind = "vec_id long, embedding array<float>, key string, x int, n int"
    good = rng.normal(size=(40, 3)).astype(np.float32).tolist()
    rows = [(i, v, "k", 1, 2) for i, v in enumerate(good)]
    odd = [(100, None, "k", 1, 2), (101, [1.0, None, 2.0], "k", 1, 2), (102, [1.0, float("nan"), 2.0], "k", 1, 2),
           (103, [float("inf"), 0.0, 0.0], "k", 1, 2), (104, [], "k", 1, 2), (105, [1.0], "k", 1, 2)]
    found = whitening.whiten(spark.createDataFrame(rows + odd, kind)).collect()
    check_whitened(found, dict(enumerate(good)), 3)
    frame = lambda rows: whitening.whiten(spark.createDataFrame(rows, kind))
    assert frame(odd[:5]).count() == frame([]).count() == frame(rows[:1]).count() == 0
    assert frame([rows[0]] * 50).count() == 0  # copies of one vector have no direction
    two = frame([rows[0], rows[0], rows[1], (None, rows[1][1], "k", 1, 2)]).collect()
    assert [r["component"] for r in two] == [1] * 4 and {abs(round(r["whitened"], 9)) for r in two} == {1.0}
    assert sum(r["vec_id"] is None for r in two) == 1


def test_deviations_beyond_a_long_are_null():
    x = np.array([[10 ** 9], [0]])
    assert whitening.deviations(x, 100, np.array([10 ** 9])) == [None, 10 ** 18]
