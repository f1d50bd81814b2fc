"""What grows with the jobs or the matches stays bounded in a task, and results stay those of the plain form."""

import random

import numpy as np
from pyspark.sql import functions as F

from matchloom.functions import skills as sk
from matchloom.operators import blocks, index
from matchloom.operators.sides import job_side, text_side
from matchloom.plans import matching
from tests.test_matching import config_of, frames, sample


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_pairs_leave_a_task_in_small_batches(spark, monkeypatch):
    """A batch of jobs is scored in slices, and its pairs go out in batches of bounded size."""
    monkeypatch.setattr(index, "PAIRS_PER_BATCH", 50)
    monkeypatch.setattr(index, "JOBS_PER_SLICE", 30)
    config = config_of((0.2, 0.3, 0.3, 0.2), index_rows=4096)
    resumes, jobs = sample(5, 8, 60)
    r, j, options = frames(spark, resumes, jobs)
    left = matching.prepare_resumes(r, config, resume_vectors=options["resume_vectors"]).where("key IS NOT NULL").toArrow()
    right = job_side(j, config, options["job_vectors"]).select(*index.READ).toArrow().combine_chunks()
    found = list(index.scored(left, right.to_batches(), config, -100.0, None))
    assert max(b.num_rows for b in found) <= 50
    assert sum(b.num_rows for b in found) == left.num_rows * right.num_rows
    monkeypatch.setattr(index, "WORDS_PER_SLICE", 100)
    sizes = [sum(len(x) for c in ("kw", "words") for x in s[c].to_pylist()) for s in index._slices(right)]
    assert len(sizes) > 3 and sum(s > 100 for s in sizes) <= sum(s.num_rows == 1 for s in index._slices(right))


def test_terms_of_words_are_the_counted_entries(spark):
    config = config_of((0.5, 0.5, 0.0, 0.0))
    rng = random.Random(4)
    texts = [" ".join(rng.choice(["aa", "ab", "a1", "é1", "zzz", "the", "abc_", "abc"]) for _ in range(rng.randrange(40)))
             for _ in range(30)] + [None, "", "aa"]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    side = text_side(df, "id", "text", config).withColumns({"skills": F.lit(None).cast("array<string>")}).orderBy(
        F.col("key").cast("int")).toArrow().combine_chunks()
    plain, words = blocks.Side(side), blocks.WordSide(side.drop_columns(["n_kw", "n_terms", "mass"]))
    left = blocks.Side(side.slice(0, 7))
    for name in ("n_kw", "n_terms", "mass"):
        assert words.column(name).tolist() == plain.column(name).tolist()
    shape = (7, side.num_rows)
    for kind in ("keywords", "terms"):
        one, two = (blocks._shared(getattr(left, kind), getattr(s, kind), shape) for s in (plain, words))
        assert np.array_equal(one, two) and one.any()
    rows, columns = np.arange(7), np.arange(side.num_rows)
    for a, b in zip(*(blocks._term_vectors(left, s, rows, columns) for s in (plain, words))):
        for (codes, tf), (codes2, tf2) in zip(a, b):
            assert np.argsort(codes).tolist() == np.argsort(codes2).tolist() and tf.tolist() == tf2.tolist()


def test_tags_take_one_pass(spark):
    """The default groups are found by one pattern, with the tags and the order of a pattern per group."""
    assert sk._apart([t for g in sk.lexicon.SKILL_TAG_GROUPS for t in g])
    for terms in (["java", "java ee"], ["sql server", "server"], ["c", "c++"], [".net"], ["C"], ["b a", "a c"]):
        assert not sk._apart(terms)
    rng = random.Random(7)
    pool = [t for g in sk.lexicon.SKILL_TAG_GROUPS for t in g] + ["c", "server", "é", "JAVA", "_"]
    rows = [("".join(rng.choice(pool) + rng.choice([" ", "", "-", ".", "+", "é"]) for _ in range(rng.randrange(25))),)
            for _ in range(500)] + [(None,)]
    text = F.col("text")
    groups = sk.lexicon.SKILL_TAG_GROUPS
    plain = F.array_distinct(F.concat(*[F.regexp_extract_all(
        F.lower(F.coalesce(text, F.lit(""))), F.lit(sk.tag_pattern(g)), F.lit(1)) for g in groups]))
    df = spark.createDataFrame(rows, "text string").select(sk.skill_tags(text).alias("a"), plain.alias("b"))
    assert plan_of(df.select("a")).count("regexp_extract_all") == 1
    assert df.where(~F.col("a").eqNullSafe(F.col("b"))).count() == 0 and df.where(F.size("a") > 3).count() > 100
