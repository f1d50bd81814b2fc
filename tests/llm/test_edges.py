"""Odd rows, empty tables and clashing columns in every operator, next to plain computations."""

import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from brute import near_classes
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from matchloom.llm import (decontamination, huffman, language, lines, long_matches, near_duplicates, packing, pii,
                           secrets, vector_search)
from matchloom.operators.shared import new_folder

BYTES, WORDS = (public_tokenizers.path(f) for f in ("byte_bpe_50k.json", "word_bpe_49k.json"))


def ids_of(path, text, end):
    return Tokenizer.from_file(path).encode(text or "", add_special_tokens=False).ids + [end]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_secrets(odd, none):
    assert secrets.find(none).count() == 0
    found = secrets.find(odd.withColumn("secrets", F.lit(1)))
    assert set(found.columns) == {*odd.columns, "secrets"}
    rows = found.collect()
    assert len(rows) == odd.count() and all(r["secrets"] == [] for r in rows)
    assert sorted(r["_text"] for r in rows) == sorted(r["_text"] for r in odd.collect())


def test_pii(odd, none):
    assert pii.find(none).count() == 0
    found = pii.find(odd)
    assert set(found.columns) == {*odd.columns, "pii"} and found.count() == odd.count()


def test_language(odd, none):
    assert language.identify(none).count() == 0
    found = language.identify(odd, config=language.LanguageConfig(least_rows=2))
    assert set(found.columns) == {*odd.columns, "language", "posterior", "accepted"}
    rows = {r["id"]: r for r in found.collect()}
    assert len(rows) == odd.count()
    for i in (1, 2, 3, 8):
        assert (rows[i]["language"], rows[i]["posterior"], rows[i]["accepted"]) == ("und", None, False)
    assert rows[0]["accepted"] and rows[0]["language"] == "en"
    bare = language.identify(odd, declared=None, address=None)
    assert bare.filter("accepted").count() == 0


def test_language_of_more_than_200_declared_tags(spark):
    tags = [a + b for a in "abcdefghijklmnop" for b in "abcdefghijklmnop"][:250]
    rng = np.random.default_rng(5)
    rows = []
    for tag in tags:
        own = ["".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), 6)) for _ in range(25)]
        rows += [(f"{tag}{i}", " ".join(rng.choice(own, 80)), tag, f"h{i}.example") for i in range(4)]
    docs = spark.createDataFrame(rows, "doc_id string, text string, lang string, source string")
    got = language.identify(docs).collect()
    assert len(got) == 1000 and all(r["accepted"] and r["language"] == r["lang"] for r in got)


def test_lines(odd, none, spark):
    assert lines.remove_boilerplate(none).count() == 0
    kept = lines.remove_boilerplate(odd)
    assert set(kept.columns) == {*odd.columns, "n_lines", "n_removed"}
    same = {r["id"]: r["text"] for r in odd.collect()}
    assert {r["id"]: r["text"] for r in kept.collect()} == same
    rows = [(i, f"head {i} of its own page\nthe same footer line\nshort\n  the same footer line ", f"s{i % 4}") for i in range(8)]
    rows += [(None, "the same footer line", "s9"), (20, "the same footer line", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    config = lines.LineConfig(least_sites=5)
    got = {r["doc_id"]: (r["text"], r["n_removed"]) for r in lines.remove_boilerplate(docs, config=config).collect()}
    assert got[None] == ("the same footer line", 0)  # the first copy stays
    assert got[20] == ("", 1) and got[3] == ("head 3 of its own page\nshort", 2)
    more = lines.remove_boilerplate(docs, config=lines.LineConfig(least_sites=6))
    assert more.filter("n_removed > 0").count() == 0


def test_decontamination(odd, none, spark):
    items = spark.createDataFrame([(1, None), (2, ""), (3, "..."), (None, "river stone"), (5, "x"), (6, "X")],
                                  "item_id long, text string")
    assert decontamination.decontaminate(none, items).count() == 0
    assert decontamination.decontaminate(odd, items.filter("false")).filter("contaminated").count() == 0
    rows = decontamination.decontaminate(odd, items).collect()
    assert len(rows) == odd.count()
    nine = next(r for r in rows if r["doc_id"] == 9)
    assert (nine["n_words"], nine["n_hit"], nine["n_items"]) == (1, 1, 2)
    assert nine["items_sha256"] == hashlib.sha256(b"5,6").hexdigest()
    long = next(r for r in rows if r["doc_id"] == 5)
    assert long["n_hit"] > 0 and long["n_items"] == 0  # an item without an id
    assert [r["n_words"] for r in rows if r["doc_id"] in (2, 3)] == [0, 0]


def test_decontamination_by_brute_force(odd, spark, monkeypatch):
    monkeypatch.setattr(decontamination, "BLOCK", 7)  # several blocks of windows
    text = next(r["text"] for r in odd.collect() if r["doc_id"] == 5)
    own = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))
    items = {1: " ".join(own[40:53]), 2: " ".join(own[200:210]).upper(), 3: " ".join(own[7:9]), 4: "never met here at all"}
    table = spark.createDataFrame(list(items.items()), "item_id long, text string")
    expected = {}
    for row in odd.collect():
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), row["text"] or ""))
        hit, met = set(), set()
        for name, item in items.items():
            w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), item))
            n = min(10, len(w))
            windows = {tuple(w[i:i + n]) for i in range(len(w) - n + 1)}
            for i in range(len(words) - n + 1):
                if tuple(words[i:i + n]) in windows:
                    hit |= set(range(i, i + n))
                    met.add(name)
        expected[row["doc_id"], row["text"]] = (len(words), len(hit), len(met))
    got = decontamination.decontaminate(odd, table).select("doc_id", "n_words", "n_hit", "n_items").collect()
    assert Counter((r["doc_id"], r["n_words"], r["n_hit"], r["n_items"]) for r in got) == Counter(
        (r["doc_id"], *expected[r["doc_id"], r["text"]]) for r in odd.collect())


def test_near_duplicates(odd, none):
    assert near_duplicates.near_duplicates(none).count() == 0
    rows = near_duplicates.near_duplicates(odd).collect()
    assert len(rows) == odd.count()
    classes = {(r["doc_id"], r["class_size"]): r["class_id"] for r in rows}
    assert classes[6, 3] == 1 and classes[1, 3] == 1
    assert classes[11, 2] == 11 and (None, 2) in classes  # near copies; the null id does not name them
    assert sum(r["class_size"] == 1 for r in rows) == len(rows) - 5


def test_families_inside_a_large_group_next_to_brute_force(spark):
    rng = np.random.default_rng(11)

    def some(n):
        return ["".join(rng.choice(list("abcdefghij"), 5)) for _ in range(n)]

    passage, texts = some(150), {}
    for family in range(60):  # each shares the passage with all others, and half of its own part in the family
        half = some(28)
        for _ in range(2 + family % 2):
            texts[len(texts)] = " ".join(passage + half + some(17))
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    want = near_classes(texts)
    assert len(set(want.values())) == 60
    config = near_duplicates.NearConfig(sketches=8)
    assert {r["doc_id"]: r["class_id"] for r in near_duplicates.near_duplicates(docs, config).collect()} == want


def test_copies_in_another_order_or_with_more_repeats(spark):
    rng, texts = np.random.default_rng(8), {}
    for i in range(12):
        some = ["".join(rng.choice(list("abcdefghij"), 5)) for _ in range(400)]
        blocks = [some[k:k + 40] for k in range(0, 400, 40)]
        texts[4 * i], texts[4 * i + 1] = " ".join(some), " ".join(w for k in rng.permutation(10) for w in blocks[k])
        few = ["".join(rng.choice(list("abcdefghij"), 5)) for _ in range(7)]
        texts[4 * i + 2], texts[4 * i + 3] = " ".join(few * 10), " ".join(few * 100)
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    want = near_classes(texts)
    assert len(set(want.values())) == 24
    assert {r["doc_id"]: r["class_id"] for r in near_duplicates.near_duplicates(docs).collect()} == want


def test_repeats_do_not_change_the_other_keys():
    config, rng = near_duplicates.NearConfig(), np.random.default_rng(2)
    one = rng.integers(1, 1 << 62, 400).astype(np.uint64)
    two = np.concatenate([one, one[:6]])  # repeats two shingles
    keys = [near_duplicates.sketch(near_duplicates.labelled(x, 5)[0], config)[:16] for x in (one, two)]
    assert (keys[0] == keys[1]).sum() >= 8


@pytest.mark.parametrize("group", [256, 2, 0])
def test_long_matches(odd, none, group):
    length = 40
    assert long_matches.remove_repeats(none).count() == 0
    rows = odd.collect()
    texts = [(r["text"] or "").encode() for r in rows]
    met = Counter(t[i:i + length] for t in texts for i in range(len(t) - length + 1))
    expected = Counter()
    for r, t in zip(rows, texts):
        gone = np.zeros(len(t) + 2, bool)
        for i in range(len(t) - length + 1):
            if met[t[i:i + length]] > 1:
                gone[i + 1:i + length + 1] = True
        kept = bytes(np.frombuffer(t, np.uint8)[~gone[1:-1]])
        expected[r["doc_id"], len(t), len(t) - len(kept), int((gone[1:] > gone[:-1]).sum()), kept] += 1
    got = long_matches.remove_repeats(odd, length, group).collect()
    assert Counter((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"])) for r in got) == expected
    assert all(r["kept_sha256"] == hashlib.sha256(r["kept"]).hexdigest() for r in got)


def test_packing(odd, none):
    assert packing.pack(none, BYTES).count() == 0
    size = 64
    rows = packing.pack(odd, BYTES, size=size).collect()
    expected = Counter()
    for r in odd.collect():
        ids = ids_of(BYTES, r["text"], 0)
        edges = [0, *range((len(ids) - 1) % size + 1, len(ids) + 1, size)]
        for k, (a, b) in enumerate(zip(edges, edges[1:])):
            expected[r["doc_id"], k, a, b - a, crc(ids[a:b])] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == expected
    bins = {}
    for r in rows:
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for places in bins.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= size
    rooms = []
    for length in sorted((r["length"] for r in rows), reverse=True):  # plain best-fit decreasing
        fit = min((x for x in rooms if x >= length), default=None)
        if fit is None:
            rooms.append(size - length)
        else:
            rooms[rooms.index(fit)] -= length
    assert sorted(size - sum(x for _, x in p) for p in bins.values()) == sorted(rooms)


def test_token_files(odd, none, spark):
    empty = new_folder(spark, "files")
    huffman.write(none, empty, WORDS)
    assert huffman.read(spark, empty).count() == 0
    files = new_folder(spark, "files")
    huffman.write(odd, files, WORDS)
    rows = huffman.read(spark, files).collect()
    expected = Counter((r["doc_id"], crc(ids_of(WORDS, r["text"], 1))) for r in odd.collect())
    assert Counter((r["doc_id"], r["ids_crc32"]) for r in rows) == expected
    rows.sort(key=lambda r: r["start"])
    assert [r["start"] for r in rows] == [0, *np.cumsum([r["n_tokens"] for r in rows])[:-1].tolist()]
    names = [r["doc_id"] for r in rows]
    assert names == sorted(names, key=lambda d: (d is not None, d or 0))
    for r in rows:
        assert len(r["ids"]) == 4 * r["n_tokens"] and zlib.crc32(r["ids"]) == r["ids_crc32"]


def test_vector_search(spark):
    rows = [(0, [0.5, 0.25]), (50, [0.5, -1.0]), (1, [0.5, 0.25]), (2, [0.5, 0.25]), (3, None), (4, [float("nan"), 1.0]),
            (5, [1.0, float("inf")]), (6, []), (7, [None, 1.0]), (8, [1.0, 1.0, 1.0]), (None, [9.0, 9.0]),
            (100, [1.0, 0.0, 0.0]), (9, [-3.0, 0.1]), (2, [0.5, 0.25])]
    table = spark.createDataFrame([(a, b, "x") for a, b in rows], "vec_id long, embedding array<float>, v string")
    assert vector_search.top_k(table.filter("false")).count() == 0
    good = [(i, [int(np.floor(256 * x)) for x in v]) for i, v in rows
            if i is not None and v and all(x is not None and np.isfinite(x) for x in v)]
    expected = []
    for q, a in [g for g in good if g[0] % 50 == 0]:
        scored = sorted((-sum(x * y for x, y in zip(a, b)), c) for c, b in good if c != q and len(a) == len(b))
        expected += [(q, k + 1, c, -s) for k, (s, c) in enumerate(scored[:5])]
    got = vector_search.top_k(table).select("query_id", "rank", "vec_id", "score").collect()
    assert sorted(map(tuple, got)) == sorted(expected)


def test_pii_of_very_many_matches(spark):
    """Time grows with the number of matches, and positions hold to the last one."""
    import time

    seconds = {}
    for n in (20_000, 20_000, 80_000):
        text = "".join(f"mail a{i}@example.org or +1 555 000 {i % 9000 + 1000} " for i in range(n))
        start = time.time()
        found = pii.find(spark.createDataFrame([(text,)], "text string")).select(
            "text", F.size("pii").alias("n"), F.slice(
                F.filter("pii", lambda s: s["kind"] == "email"), n - 2, 3).alias("last"))
        row = found.first()
        seconds[n] = time.time() - start
        assert row["n"] == 2 * n
        for s in row["last"]:
            assert text[s["start"]:s["end"]] == s["value"]
    assert seconds[80_000] < 10 * max(seconds[20_000], 1)


def test_added_spans_and_scores_of_pii(spark):
    texts = {
        "iban": "Please pay to my bank account DE89 3704 0044 0532 0130 00 today",
        "iban bare": "x GB82WEST12345698765432 y",
        "iban wrong": "Please pay to my bank account DE89 3704 0044 0532 0130 01 today",
        "short card": "amex card 3782 822463 10005 is mine",
        "short card bare": "number 378282246310005 here",
        "short card wrong": "amex card 3782 822463 10006 is mine",
        "email": "my mail is a@b.cd", "email bare": "see a@b.cd"}
    rows = spark.createDataFrame(list(texts.items()), "key string, text string")
    got = {r["key"]: [(s["kind"], r["text"][s["start"]:s["end"]], round(s["score"], 2)) for s in r["pii"]]
           for r in pii.find(rows).collect()}
    assert got == {
        "iban": [("iban", "DE89 3704 0044 0532 0130 00", 0.95)], "iban bare": [("iban", "GB82WEST12345698765432", 0.8)],
        "iban wrong": [], "short card": [("short_card", "3782 822463 10005", 0.55)], "short card bare": [],
        "short card wrong": [], "email": [("email", "a@b.cd", 0.95)], "email bare": [("email", "a@b.cd", 0.8)]}


def test_line_spread_of_short_lines(spark):
    rows = [(i, "Home\n}\nown line %d" % i, f"s{i}") for i in range(9)]
    kept = lines.remove_boilerplate(spark.createDataFrame(rows, "doc_id long, text string, source string")).orderBy("doc_id")
    assert [r["text"] for r in kept.collect()] == ["Home\n}\nown line 0", *[f"own line {i}" for i in range(1, 9)]]
