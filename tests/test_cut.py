"""Texts cut in the tasks, next to the column expressions."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from matchloom import lexicon
from matchloom.functions.text import keyword_set, lowered, tokens
from matchloom.operators import cut
from matchloom.operators.index import index_sums
from matchloom.operators.sides import job_side, resume_side
from tests.test_matching import config_of, frames, sample

TEXTS = [None, "", "a", "The C++ and C# ab abc abc-def with é12", "x" * 50, "İstanbul ΣΣ straße \U0001d54f\U0001d54f \U00020000",
         "½python n² éa _ __ a_b 1 12 123 +++ ## a+#", " lead trail ", "don't can't it's", "你好世界 abc你abc",
         "abc abc ABC abd", "\n\t end", "�‍ab؀", "".join(map(chr, range(0x20, 0x3000))), " ".join(map(chr, range(0xE000, 0x11000)))]


@pytest.mark.parametrize("stop", [tuple(lexicon.STOP_WORDS), ()])
@pytest.mark.parametrize("size", [1, 40, 1 << 21])
def test_cut_as_the_expressions(spark, monkeypatch, stop, size):
    monkeypatch.setattr(cut, "BYTES_PER_CUT", size)
    t = F.col("t")
    rows = spark.createDataFrame([(str(n), x) for n, x in enumerate(TEXTS)], "key string, t string").coalesce(1)
    want = rows.select("key", lowered(t).alias("low"), keyword_set(t, stop).alias("kw"), tokens(t, stop).alias("words")).collect()
    batch = pa.RecordBatch.from_pydict({"key": [r["key"] for r in want], "low": pa.array([r["low"] for r in want], pa.string())})
    got = pa.Table.from_batches(cut.worded(iter([batch]), cut.letters(spark), stop, stop)).to_pylist()
    assert [(r["key"], sorted(r["kw"]), r["words"]) for r in got] == [(r["key"], sorted(r["kw"]), r["words"]) for r in want]


def test_letters_are_those_of_the_jvm(spark):
    word = np.unpackbits(np.frombuffer(cut.letters(spark), np.uint8)).view(bool)
    assert word[ord("a")] and word[ord("_")] and word[0xBD] and word[0x20000] and not word[ord("+")] and not word[0x301]


def test_jobs_go_to_the_tasks_as_texts(spark):
    config = config_of((0.2, 0.3, 0.3, 0.2), semantic=False, index_rows=4096)
    r, j, _ = frames(spark, *sample(3))
    pairs = index_sums(resume_side(r, config).drop("kw", "words", "low"), job_side(j, config), config, 10.0)
    plan = pairs._jdf.queryExecution().optimizedPlan().toString()
    assert "low#" in plan and "{2,}" not in plan
