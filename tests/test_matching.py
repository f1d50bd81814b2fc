"""The match routes against a direct computation, pair by pair."""

import math
import random
import re
from collections import Counter

import pandas as pd
import pytest
from pyspark.sql import functions as F

from matchloom.config import MatchConfig
from matchloom.operators import capped, scoring, text_pairs
from matchloom.operators.sides import text_side
from matchloom.plans import matching

STOP = ("the", "and")
GROUPS = (("python", "java", "c++"), ("sql server", "rest", "api"))


def keywords(text):
    words = re.sub(r"[^a-zA-Z0-9\s+#]", " ", text.lower()).split()
    return {w for w in words if len(w) > 2 and w not in STOP}


def counts(text):
    words = [w for w in re.findall(r"\w\w+", text.lower()) if w not in STOP]
    return Counter(words + [f"{a} {b}" for a, b in zip(words, words[1:])])


def tfidf(one, two, cap):
    """Fit on the two texts, keep the most frequent terms, weigh, normalise, multiply."""
    a, b = counts(one), counts(two)
    terms = sorted(set(a) | set(b), key=lambda t: (-(a[t] + b[t]), t))[:cap]
    idf = {t: math.log(3 / (1 + (t in a) + (t in b))) + 1 for t in terms}
    x, y = ([v[t] * idf[t] for t in terms] for v in (a, b))
    norm = math.sqrt(sum(v * v for v in x)) * math.sqrt(sum(v * v for v in y))
    return sum(u * v for u, v in zip(x, y)) / norm if norm else 0.0


def tagged(text):
    return {m for g in GROUPS for m in re.findall(
        r"\b(" + "|".join(map(re.escape, g)) + r")\b", text.lower())}


def cosine(a, b):
    if a is None or b is None:
        return 0.0
    norm = math.sqrt(sum(x * x for x in a)) * math.sqrt(sum(x * x for x in b))
    return sum(x * y for x, y in zip(a, b)) / norm if norm else 0.0


def direct(resumes, jobs, config, threshold):
    out = {}
    for file, text, skills, vec in resumes:
        mine = f"{text} {' '.join(skills)}"
        for job_id, title, description, listed, job_vec in jobs:
            theirs = f"{title} {description or ''} {' '.join(listed or [])}"
            k1, k2 = keywords(mine), keywords(theirs)
            have = {s.lower() for s in skills} | tagged(mine)
            need = {s.lower() for s in listed or []} | tagged(theirs)
            parts = {
                "keyword": len(k1 & k2) / len(k1 | k2) if k2 else 0.0,
                "tfidf": tfidf(mine, theirs, config.max_terms),
                "semantic": cosine(vec, job_vec) if config.semantic else 0.0,
                "skills": len(have & need) / len(need) if need else 1.0,
            }
            total = min(sum(parts[p] * config.weight(p) for p in parts) * 100, 100)
            if total >= threshold:
                out[file, job_id] = (total, parts)
    return out


def sample(seed, n_resumes=12, n_jobs=60):
    """Short and long texts; one word is in all of them, and many jobs are copies."""
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(60)] + ["python", "java", "rest", "api", "the", "and", "sql server"]

    def text(low, high):
        picked = [words[min(int(rng.expovariate(0.06)), len(words) - 1)] for _ in range(rng.randint(low, high))]
        return " ".join(["common", *picked])

    def vec():
        return [rng.gauss(0, 1) for _ in range(4)]

    resumes = [(f"r{i}", text(0, 30), rng.sample(["Python", "java", "go"], rng.randint(0, 2)), vec())
               for i in range(n_resumes)]
    copied = text(20, 30)
    jobs = [(str(i) if i else None, text(1, 3), copied if i % 3 == 0 else text(0, 60),
             rng.choice([None, [], ["Java"], ["go", "SQL"]]), vec() if i % 7 else None)
            for i in range(n_jobs)]
    return resumes, jobs


def frames(spark, resumes, jobs):
    r = spark.createDataFrame(resumes, "resume_file string, text string, skills array<string>, vec array<float>")
    j = spark.createDataFrame(jobs, "job_id string, title string, description string, skills array<string>, vec array<float>")
    return (r.select("resume_file", "text", "skills"), j.select("job_id", "title", "description", "skills"),
            {"resume_vectors": r.select("resume_file", F.col("vec").alias("embedding")),
             "job_vectors": j.select("job_id", F.col("vec").alias("embedding"))})


def config_of(weights, **more):
    """Without the index that small resume sides get by default, so that the other routes run."""
    more = {"index_rows": 0, **more}
    return MatchConfig(weights=dict(zip(("keyword", "tfidf", "semantic", "skills"), weights)),
                       stop_words=STOP, tfidf_stop_words=STOP, skill_tag_groups=GROUPS, **more)


def check(found, want):
    got = {(m["resume_file"], m["job_id"]): m for m in found.collect()}
    assert set(got) == set(want)
    for key, (total, parts) in want.items():
        assert got[key]["match_score"] == pytest.approx(total, abs=0.0051)
        for p, v in parts.items():
            assert got[key]["score_breakdown"][p] == pytest.approx(v, abs=1e-6)


@pytest.mark.parametrize("seed, weights, threshold, cap, semantic", [
    (1, (0.5, 0.5, 0.0, 0.0), 12, 1000, False),   # pruned, limit never reached
    (2, (0.5, 0.5, 0.0, 0.0), 20, 25, False),     # pruned, limit reached by most pairs
    (3, (0.2, 0.25, 0.25, 0.3), 62, 40, True),    # pruned with all parts
    (4, (0.0, 1.0, 0.0, 0.0), 25, 30, False),     # one text part only
    (5, (1.0, 0.0, 0.0, 0.0), 15, None, False),
    (6, (0.2, 0.25, 0.25, 0.3), 30, 40, True),    # blocks
    (7, (0.1, 0.4, 0.4, 0.1), 0, 20, True),       # blocks, negative totals drop
    (8, (0.2, 0.25, 0.25, 0.3), 25, None, False),  # blocks, no vectors
])
def test_matches_equal_direct_scores(spark, seed, weights, threshold, cap, semantic):
    config = config_of(weights, max_terms=cap, semantic=semantic, threshold=threshold)
    resumes, jobs = sample(seed)
    r, j, options = frames(spark, resumes, jobs)
    want = direct(resumes, jobs, config, threshold)
    assert want
    pruned = matching.text_need(config, threshold) > 0
    assert pruned == (seed <= 5)
    check(matching.score_matches(r, j, config, **options), want)


@pytest.mark.parametrize("seed, cap, n", [(11, 1000, 3), (12, 25, 5), (13, 25, 100)])
def test_best_matches(spark, monkeypatch, seed, cap, n):
    monkeypatch.setattr("matchloom.operators.blocks.JOBS_PER_CELL", 16)
    monkeypatch.setattr("matchloom.operators.blocks.RESUMES_PER_CELL", 5)
    config = config_of((0.2, 0.3, 0.3, 0.2), max_terms=cap)
    resumes, jobs = sample(seed)
    r, j, options = frames(spark, resumes, jobs)
    found = matching.score_matches(r, j, config, threshold=0.0, top_n=n, **options).collect()
    want = direct(resumes, jobs, config, 0.0)
    for file in {f for f, _ in want}:
        order = sorted(((-round(t, 2), job is not None, job or ""), job)
                       for (f, job), (t, _) in want.items() if f == file)[:n]
        got = sorted((m["rank"], m["job_id"]) for m in found if m["resume_file"] == file)
        assert [job for _, job in got] == [job for _, job in order]


def test_full_records_and_matched_skills(spark):
    resumes = spark.createDataFrame(
        [("a.txt", "text python", ["python", "SQL"], "Ann", "a@b.c", "1")],
        "resume_file string, text string, skills array<string>, name string, email string, phone string")
    jobs = spark.createDataFrame(
        [("1", "Dev", "Acme", "Pune", "http://x", ["Python", "SQL"], "text python", "d")],
        "job_id string, title string, company string, location string, url string, skills array<string>, description string, posted_date string")
    config = config_of((0.2, 0.25, 0.25, 0.3), semantic=False, threshold=1.0)
    row = matching.match(resumes, jobs, config).first()
    assert (row["job_title"], row["matched_skills"]) == ("Dev", ["SQL"])
    assert row["score_breakdown"]["skills"] == 1.0
    assert row["resume_data"].asDict() == {"name": "Ann", "email": "a@b.c", "phone": "1", "skills_count": 2}
    assert row["job_data"]["company"] == "Acme"


def test_threshold_reads_the_unrounded_score(spark):
    """A vector part of 0.69996 is below a threshold of 70, though it rounds to 70.00."""
    angle = math.acos(0.69996)
    resumes = [("a", "x", [], [1.0, 0.0])]
    jobs = [("1", "y", "", ["z"], [math.cos(angle), math.sin(angle)])]
    r, j, options = frames(spark, resumes, jobs)
    config = config_of((0.0, 0.0, 1.0, 0.0))
    assert matching.score_matches(r, j, config, threshold=70.0, **options).count() == 0
    assert matching.score_matches(r, j, config, threshold=69.9, **options).first()["match_score"] == 70.0


def test_weights():
    assert MatchConfig(weights={"keyword": 1.0}).weight("skills") == 0.25
    with pytest.raises(ValueError):
        MatchConfig(weights={"keyword": -1.0})


def test_total_is_capped_and_not_floored(spark):
    config = MatchConfig(weights=dict.fromkeys(("keyword", "tfidf", "semantic", "skills"), 1.0))
    df = spark.createDataFrame([(1.0, 1.0, 1.0, 1.0), (0.0, 0.0, -0.5, 0.0)], "a double, b double, c double, d double")
    got = [r["t"] for r in df.select(scoring.total_score(
        F.col("a"), F.col("b"), F.col("c"), F.col("d"), config).alias("t")).collect()]
    assert got == [100.0, -50.0]


def test_encoder(spark):
    @F.pandas_udf("array<float>")
    def encode(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: [float(len(t)), 1.0])

    resumes, jobs = sample(21, 3, 5)
    r, j, _ = frames(spark, resumes, jobs)
    config = config_of((0.2, 0.25, 0.25, 0.3), threshold=0.0)
    found = matching.score_matches(r, j, config, encoder=encode).collect()
    assert len(found) == 15 and all(m["score_breakdown"]["semantic"] > 0 for m in found)


def test_entities_count_as_skills(spark):
    resumes, jobs = [("a", "x", [], None)], [("1", "y", "", [], None)]
    r, j, _ = frames(spark, resumes, jobs)
    entities = spark.createDataFrame(
        [("1", "Acme Ltd", "ORG"), ("1", "ab", "ORG"), ("1", "1234", "PRODUCT"), ("1", "Bob", "PERSON")],
        "doc_id string, text string, label string")
    config = config_of((0.2, 0.25, 0.25, 0.3), threshold=0.0, semantic=False)
    assert matching.score_matches(r, j, config).first()["score_breakdown"]["skills"] == 1.0
    found = matching.score_matches(r, j, config, job_entities=entities).first()
    assert found["score_breakdown"]["skills"] == 0.0


def test_hot_term_pairs_are_not_joined(spark):
    """Documents that share only a word that all of them have never become a pair."""
    from matchloom.operators.term_join import pruned_sums

    n = 40
    docs = [(i, "common " + " ".join(f"u{i}x{k}" for k in range(12))) for i in range(n)]
    df = spark.createDataFrame(docs, "id int, text string")
    config = config_of((0.5, 0.5, 0.0, 0.0), semantic=False)
    side = text_side(df, "id", "text", config)
    pairs = pruned_sums(side, side, config, 0.3).collect()
    assert {(p["r"], p["j"]) for p in pairs} == {(str(i), str(i)) for i in range(n)}
    assert all(p["kw_shared"] == 13 for p in pairs)


def test_cells_spread_one_job_over_many(spark, monkeypatch):
    monkeypatch.setattr(capped, "PAIRS_PER_CELL", 3)
    monkeypatch.setattr(capped, "RESUMES_PER_JOB_CELL", 2)
    resumes, jobs = sample(31, 10, 4)
    config = config_of((0.0, 1.0, 0.0, 0.0), max_terms=10, semantic=False)
    left = text_side(spark.createDataFrame([(i, r[1]) for i, r in enumerate(resumes)], "id int, text string"), "id", "text", config)
    right = text_side(spark.createDataFrame([(i, j[2]) for i, j in enumerate(jobs)], "id int, text string"), "id", "text", config)
    found = {(p["r"], p["j"]): p["score"] for p in text_pairs.tfidf_pairs(left, right, config, 0.05).collect()}
    want = {(str(a), str(b)): tfidf(r[1], j[2], 10) for a, r in enumerate(resumes) for b, j in enumerate(jobs)}
    want = {k: v for k, v in want.items() if v >= 0.05}
    assert found == pytest.approx(want)


@pytest.mark.parametrize("threshold", [30, 0])
def test_missing_mixed_and_repeated_vectors(spark, threshold):
    """No vectors on one side, vectors of two lengths, and two vectors of one document."""
    config = config_of((0.2, 0.25, 0.25, 0.3), threshold=threshold)
    resumes, jobs = sample(21)
    r, j, options = frames(spark, resumes, jobs)
    bare = [(*x[:4], None) for x in jobs]
    check(matching.score_matches(r, j, config, resume_vectors=options["resume_vectors"]), direct(resumes, bare, config, threshold))
    other = options["job_vectors"].select("job_id", F.slice("embedding", 1, 3).alias("embedding"))
    check(matching.score_matches(r, j, config, resume_vectors=options["resume_vectors"], job_vectors=other),
          direct(resumes, bare, config, threshold))
    twice = options["job_vectors"].unionByName(options["job_vectors"])
    check(matching.score_matches(r, j, config, resume_vectors=options["resume_vectors"], job_vectors=twice),
          direct(resumes, jobs, config, threshold))


def test_no_text_weight_and_a_high_threshold(spark):
    config = config_of((0.0, 0.0, 0.5, 0.5), threshold=70, semantic=False)
    resumes, jobs = sample(22)
    r, j, options = frames(spark, resumes, jobs)
    assert direct(resumes, jobs, config, 70) == {}
    assert matching.score_matches(r, j, config, **options).count() == 0


@pytest.mark.parametrize("cap", [1000, 300, 20])
def test_no_more_than_the_best_leave_a_cell(spark, cap):
    from matchloom.operators.blocks import block_sums
    from matchloom.operators.sides import job_side, resume_side

    resumes, jobs = sample(41, 8, 60)
    config = config_of((0.2, 0.5, 0.1, 0.2), max_terms=cap)
    r, j, options = frames(spark, resumes, jobs)
    left, right = resume_side(r, config, options["resume_vectors"]), job_side(j, config, options["job_vectors"])
    out = block_sums(left, right, config, 0.0, 4).groupBy("r").count().collect()  # 60 jobs are one cell
    assert len(out) == 8 and all(x["count"] <= 4 for x in out)
    want = direct(resumes, jobs, config, 0.0)
    found = matching.score_matches(r, j, config, threshold=0.0, top_n=4, **options).collect()
    for file, *_ in resumes:
        best = sorted((round(t, 2) for (f, _), (t, _) in want.items() if f == file), reverse=True)[:4]
        assert sorted((m["match_score"] for m in found if m["resume_file"] == file), reverse=True) == pytest.approx(best)


def test_cells_are_sized_by_entries(spark, monkeypatch):
    from matchloom.operators import blocks

    monkeypatch.setattr(blocks, "ENTRIES_PER_GROUP", 300)
    sizes = []
    real = blocks.cell_partitions
    monkeypatch.setattr(blocks, "cell_partitions", lambda s, cells: sizes.append(cells) or real(s, cells))
    resumes, jobs = sample(6)
    r, j, options = frames(spark, resumes, jobs)
    config = config_of((0.2, 0.25, 0.25, 0.3), max_terms=40, threshold=30)
    check(matching.score_matches(r, j, config, **options), direct(resumes, jobs, config, 30))
    assert sizes[0] > 10
