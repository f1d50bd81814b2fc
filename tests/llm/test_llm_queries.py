"""Every registered query next to its SQL or a plain version, on the smallest tables."""

from collections import Counter

import corpus_pipeline
import numpy as np
import public_tokenizers
import pytest
from brute import (boilerplate, crc, hit_words, language_rows, near_classes, pii as pii_spans, removed,
                   secrets as secret_spans, sha, token_ids)
from check import compare
from matchloom.llm import huffman, language, near_duplicates, secrets
from matchloom.llm.oracle import ORACLE
from matchloom.llm.queries import QUERIES
from matchloom.llm.tokens import Encoder
from pyspark.sql import functions as F
from tokenizers import Tokenizer


@pytest.fixture(scope="module")
def documents(spark, small):
    return spark.read.parquet(f"{small}/documents.parquet").orderBy("doc_id").collect()


def rows_of(spark, small, name):
    return {r["doc_id"]: r for r in QUERIES[name](spark, small).collect()}


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_sql(spark, small, duck, name):
    assert compare(QUERIES[name](spark, small).toPandas(), duck.execute(ORACLE[name]).df()) == ""


def test_secret_spans(spark, small, documents):
    got = rows_of(spark, small, "op1_secret_tags")
    for d in documents:
        want = secret_spans(d["text"])
        order = sorted((a, list(want).index(k), k, b) for k in want for a, b in want[k])
        row = got[d["doc_id"]]
        assert [row[f"n_{k}"] for k in want] == [len(v) for v in want.values()]
        assert row["base_sha256"] == sha(",".join(f"{k}:{a}:{b}" for a, _, k, b in order))
        assert {f"{k}:{a}:{b}" for a, _, k, b in order} <= set(row["spans"].split(",")) | {""}


def test_tagger_finds_what_patterns_miss(documents):
    config = secrets.SecretConfig()
    filler = [d["text"] for d in documents if 200 <= len(d["text"]) < 20_000][:60]
    rng = np.random.default_rng(7)

    def value(n=40):
        return "".join(rng.choice(list("0123456789abcdef"), n))

    marked = [t.replace("\n", f'\ntoken = "{value()}" ', 1) for t in filler if "\n" in t]
    model = secrets.Field().fit(*secrets.training(marked + filler, config), config)
    tagger = secrets.Tagger(model)
    new = [f'{t[:120]} credential = "{value().upper()}" {t[120:240]}' for t in filler]
    found = tagger.spans(new, config.least)
    assert not any(secrets.base_spans(t) for t in new[:5])
    assert sum(any(t[a:b].isalnum() and len(t[a:b]) == 40 for a, b in s) for t, s in zip(new, found)) >= 0.8 * len(new)
    clean = tagger.spans(filler, config.least)
    assert sum(map(len, clean)) <= sum(len(secrets.base_spans(t)) for t in filler)


def test_viterbi_is_the_best_path_and_skips_only_clean_texts():
    rng = np.random.default_rng(3)
    model = secrets.Field(rng.normal(size=(secrets.FEATURES, 3)), rng.normal(size=(3, 3)), True)
    for n in (1, 2, 5):
        score = rng.normal(size=(n, 3)) * 2
        paths = np.array(np.meshgrid(*[range(3)] * n)).reshape(n, -1).T
        total = score[np.arange(n), paths].sum(axis=1) + sum(model.change[paths[:, k], paths[:, k + 1]] for k in range(n - 1))
        assert model.viterbi(score) == paths[total.argmax()].tolist()
        most = secrets.Tagger(model).most
        if (np.maximum(score[:, 1], score[:, 2]) - score[:, 0] + most).max() <= 0:
            assert not any(model.viterbi(score))


def test_repeated_passages(spark, small, documents):
    got = rows_of(spark, small, "op3_repeated_passages")
    for d, gone in zip(documents, removed([d["text"] for d in documents])):
        raw, row = (d["text"] or "").encode(), got[d["doc_id"]]
        kept = bytes(np.frombuffer(raw, np.uint8)[~gone])
        edges = np.diff(np.concatenate([[0], gone.astype(int), [0]]))
        assert (row["n_bytes"], row["n_removed"], row["n_spans"]) == (len(raw), int(gone.sum()), int((edges == 1).sum()))
        assert row["kept_sha256"] == __import__("hashlib").sha256(kept).hexdigest()


def test_personal_data(spark, small, documents):
    got = rows_of(spark, small, "op5_pii")
    for d in documents:
        want, row = pii_spans(d["text"]), got[d["doc_id"]]
        assert [row[f"n_{k}"] for k in want] == [len(v) for v in want.values()]
        assert row["base_sha256"] == sha(",".join(f"{k}:{a}:{b}" for k in want for a, b in want[k]))


def test_near_copies(spark, small, documents):
    got = rows_of(spark, small, "op6_order_minhash")
    want = near_classes({d["doc_id"]: d["text"] for d in documents})
    assert {k: r["class_id"] for k, r in got.items()} == want
    assert {k for k, r in got.items() if r["kept"]} == set(want.values())


def test_sequences(spark, small, documents):
    rows = QUERIES["op7_best_fit_packing"](spark, small).collect()
    check_sequences(rows, {d["doc_id"]: d["text"] for d in documents})


def check_sequences(rows, texts, size=2048):
    expected = Counter()
    for key, text in texts.items():
        ids = token_ids("byte_bpe_50k.json", text, 0)
        edges = [0, *range((len(ids) - 1) % size + 1, len(ids) + 1, size)]
        for k, (a, b) in enumerate(zip(edges, edges[1:])):
            expected[key, k, a, b - a, crc(ids[a:b])] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == expected
    bins = {}
    for r in rows:
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for places in bins.values():
        places.sort()
        assert [o for o, _ in places] == [0, *np.cumsum([n for _, n in places])[:-1].tolist()]
        assert sum(n for _, n in places) <= size
    assert len(bins) <= 1.02 * sum(r["length"] for r in rows) / size + 2


def test_language(spark, small, documents):
    got = rows_of(spark, small, "op8_language_fusion")
    right = sum(got[d["doc_id"]]["language"] == d["lang"] for d in documents)
    assert right >= 0.98 * len(documents)
    assert sum(r["accepted"] for r in got.values()) >= 0.98 * len(documents)


def test_token_files(spark, small, documents):
    got, start = rows_of(spark, small, "op10_token_files"), 0
    for d in documents:
        ids = token_ids("word_bpe_49k.json", d["text"], 1)
        row = got[d["doc_id"]]
        assert (row["start"], row["n_tokens"], row["ids_crc32"]) == (start, len(ids), crc(ids))
        start += len(ids)


def test_pipeline(spark, small, documents):
    names = [name for name, _ in corpus_pipeline.STAGES]
    assert names == ["language_id", "line_dedup", "near_dedup", "decontaminate", "best_fit_packing"]
    known = corpus_pipeline.language_id(spark, spark.read.parquet(f"{small}/documents.parquet"), small)
    assert known.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    left = {r["doc_id"]: r for r in known.collect()}
    assert len(left) >= 0.98 * len(documents)
    texts = boilerplate([(k, r["text"], r["source"]) for k, r in left.items()])
    texts = {k: t for k, t in texts.items() if t.strip(" ") or t == left[k]["text"]}
    first = near_classes(texts)
    texts = {k: t for k, t in texts.items() if first[k] == k}
    items = {r["item_id"]: r["text"] for r in spark.read.parquet(f"{small}/benchmark.parquet").collect()}
    texts = {k: t for k, t in texts.items() if not hit_words(t, items)[1]}
    check_sequences(corpus_pipeline.run(spark, small).collect(), texts)


def test_pipeline_of_odd_rows(spark, small, odd):
    docs = odd
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, odd.filter("false"), small).count() == 0, name
        docs = stage(spark, docs, small)
        assert docs.columns == odd.columns, name
    assert corpus_pipeline.STAGES[-1][1](spark, docs, small).count() >= 0


def test_pipeline_decides_per_row(spark, small):
    item = max((r["text"] for r in spark.read.parquet(f"{small}/benchmark.parquet").collect()), key=len)
    rng = np.random.default_rng(4)

    def words(n=60):
        return " ".join("".join(rng.choice(list("abcdefghij"), 6)) for _ in range(n))

    a, b, c, d, e = (words() for _ in range(5))
    rows = [(7, a, 1), (7, a, 1), (7, a, 2), (8, a + " end", 3), (7, b, 4), (None, c, 5), (None, c, 5), (None, c + " end", 6),
            (None, d, 7), (None, "", 8), (None, "", 8), (9, e, 9), (None, e, 10)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, tag int")
    left = Counter(map(tuple, corpus_pipeline.near_dedup(spark, docs, small).collect()))
    pair = [x for x in left if x[2] in (5, 6)]
    assert len(pair) == 1 and left[pair[0]] == 1
    del left[pair[0]]
    assert left == Counter([(7, a, 1), (7, b, 4), (None, d, 7), (None, "", 8), (None, "", 8), (9, e, 9)])
    rows = [(None, a, 1), (None, f"{b} {item}", 2), (None, None, 3), (5, c, 4), (5, item, 5), (5, c, 4), (6, item, 6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, tag int")
    assert sorted(r["tag"] for r in corpus_pipeline.decontaminate(spark, docs, small).collect()) == [1, 3, 4, 4]


def check_languages(rows, want):
    assert len(rows) == len(want)
    for r, (language, posterior, accepted) in zip(rows, want):
        assert (r["language"], r["accepted"]) == (language, accepted)
        assert r["posterior"] == pytest.approx(posterior, abs=2e-4) if posterior is not None else r["posterior"] is None


def test_languages_of_documents(spark, small, documents):
    got = rows_of(spark, small, "op8_language_fusion")
    check_languages([got[d["doc_id"]] for d in documents], language_rows(
        [(d["text"], d["lang"], d["source"]) for d in documents], language.LanguageConfig()))


def test_languages_of_pages(spark, small):
    """Addresses with suffixes, and the language that the markup declares."""
    pages = spark.read.parquet(f"{small}/pages.parquet").select(
        "page_id", "url", F.regexp_extract("html", '<html[^>]* lang="?([A-Za-z-]+)', 1).alias("lang"),
        F.trim(F.regexp_replace("html", r"(?s)<script.*?</script>|<style.*?</style>|<[^>]*>", " ")).alias("text"))
    config = language.LanguageConfig(host=5.0)
    rows = language.identify(pages, address="url", config=config).orderBy("page_id").collect()
    assert sum(r["lang"] != "" for r in rows) > 10
    check_languages(rows, language_rows([(r["text"], r["lang"], r["url"]) for r in rows], config))


def test_no_text_is_shuffled_or_broadcast_for_languages(spark, small, capsys):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    language.identify(docs).explain("simple")
    plan = capsys.readouterr().out
    assert "Exchange hashpartitioning(language" not in plan and "BuildLeft" not in plan


@pytest.mark.parametrize("file", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_token_ids_of_every_usual_letter(file):
    path = public_tokenizers.path(file)
    letters = [chr(c) for c in range(0x20, 0x250)] + [chr(c) for c in range(0x2010, 0x2028)] + list("\u212a\u212b\u1e9e\u0130\n\t\u00a0")
    texts = [f"{a}{x}{b} {x}. {x.lower()}{x.upper()}" for x in letters for a, b in (("A", "B"), ("q", "n"), ("", "9"))]
    texts += ["BAKI, AZ\u018fRBAYCAN", "\u0181\u0186 It's", ""]
    whole = Tokenizer.from_file(path).encode_batch(texts, add_special_tokens=False)
    for t, got, want in zip(texts, Encoder(path).encode(texts), whole):
        assert got.tolist() == want.ids, t


def test_codes_of_more_ids_than_the_limit_holds():
    lengths = huffman.code_lengths({i: 1 + i % 3 for i in range(40)}, limit=3)
    assert max(lengths.values()) == 6 and sum(2.0 ** -b for b in lengths.values()) <= 1


def test_a_large_family_meets_few_leaders(spark, monkeypatch):
    rng = np.random.default_rng(8)
    base = [f"w{i}" for i in rng.integers(0, 5000, 300)]
    texts = {}
    for i in range(1200):
        own = list(base)
        for at in rng.integers(0, 300, 2):
            own[at] = f"x{rng.integers(0, 10 ** 9)}"
        texts[i] = " ".join(own)
    texts |= {5000 + i: " ".join(f"y{w}" for w in rng.integers(0, 10 ** 9, 200)) for i in range(50)}
    met = []
    pairs = near_duplicates.verified
    monkeypatch.setattr(near_duplicates, "verified", lambda p, *a: met.append(p.count()) or pairs(p, *a))
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r["doc_id"]: r["class_id"] for r in near_duplicates.near_duplicates(docs).collect()}
    assert got == {k: 0 if k < 5000 else k for k in texts}
    assert sum(met) <= 4 * len(texts)
