"""Single text scores take the index where the resumes are few."""

import pytest

from matchloom.operators import text_pairs
from matchloom.operators.shared import materialize
from matchloom.operators.sides import KEYWORD, TERM, counted, text_side
from tests.test_growth import plan_of
from tests.test_matching import config_of, sample


@pytest.mark.parametrize("cap", [None, 25])
def test_text_scores_take_the_index(spark, cap):
    """The same pairs as by the terms, without a shuffle or a copy of the jobs."""
    config = config_of((0.5, 0.5, 0.0, 0.0), max_terms=cap, index_rows=4096)
    off = config_of((0.5, 0.5, 0.0, 0.0), max_terms=cap, index_rows=0)
    resumes, jobs = sample(3)
    texts = ([(i, x[1]) for i, x in enumerate(resumes)], [(i, x[2]) for i, x in enumerate(jobs)])
    for kind, pairs in ((KEYWORD, text_pairs.keyword_pairs), (TERM, text_pairs.tfidf_pairs)):
        left, right = (text_side(spark.createDataFrame(t, "id int, text string"), "id", "text", config, [kind])
                       for t in texts)
        left = materialize(counted(left), "left")
        found = pairs(left, right, config, 0.05)
        assert "MapInArrow" in plan_of(found) and "Exchange" not in plan_of(found)
        got, want = ({(x["r"], x["j"]): x["score"] for x in f.collect()} for f in (found, pairs(left, right, off, 0.05)))
        assert got.keys() == want.keys() and got
        assert all(abs(got[k] - want[k]) < 1e-12 for k in got)


def test_repeated_and_missing_keys(spark):
    """Repeated keys go by the terms, with what these give; rows without a key are in no pair."""
    config, off = (config_of((0.5, 0.5, 0.0, 0.0), index_rows=n) for n in (4096, 0))
    one = [(1, "java spark query"), (2, "java engine query")]
    for texts in (one + [(None, "java spark")], one + [(2, "java rest")]):
        df = spark.createDataFrame(texts, "id int, text string")
        left, right = (text_side(df, "id", "text", config) for _ in range(2))
        left = materialize(counted(left), "left")
        for pairs in (text_pairs.keyword_pairs, text_pairs.tfidf_pairs):
            got, want = (sorted((x["r"], x["j"], round(x["score"], 9)) for x in pairs(left, right, c, 0.1).collect())
                         for c in (config, off))
            assert got == want and got
