"""Lexicons as automata, next to an expression per term and to plain regular expressions."""

import random

import pytest
from pyspark.sql import functions as F

from matchloom import lexicon
from matchloom.functions import lexicons
from matchloom.functions import skills as sk

ODD = [None, "", " ", "JavaScript and java, C++ or c+ +", "node.js-node.js", "sql server sql_server SQL SERVERS", "rest api restapi rest-api",
       "éjava javaé javá jáva ́java", "٣java java٣ java", "a.net .net asp.net", "\U0001f600java\U0001f600 go",
       "java\0go", "x" * 5000 + " java " + "go " * 3000, "STRASSE straße İstanbul"]
TERMS = ["java", "javascript", "sql server", "sql", "c++", "c", "go", "rest", "rest api", "api", ".net", "asp.net",
         "node.js", "node", "straße", "é", "\U0001f600", "java go"]


def rows(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "id int, text string")


def noise(n, seed=1):
    rng = random.Random(seed)
    pieces = [*TERMS, " ", " ", "-", "_", "é", "3", "́", "ab"]
    return ["".join(rng.choice(pieces) for _ in range(rng.randint(0, 30))) for _ in range(n)]


@pytest.mark.parametrize("form", [sk.skill_substrings, lambda t, x: sk.skill_tags(t, (x,)),
                                  lambda t, x: sk.skill_tags(t, (x, ("java", "ab")))])
def test_automaton_equals_expressions(spark, monkeypatch, form):
    df = rows(spark, [*ODD, *noise(400)])
    plain = df.select("id", form(F.col("text"), TERMS).alias("v")).collect()
    monkeypatch.setattr(sk, "AUTOMATON_FROM", 3)
    assert sorted(df.select("id", form(F.col("text"), TERMS).alias("v")).collect()) == sorted(plain)
    assert sum(len(r["v"]) for r in plain) > 400


def test_the_whole_list_of_skills(spark, small, monkeypatch):
    texts = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text")
    both = [(texts.select("doc_id", sk.skill_substrings(F.col("text")).alias("a"), sk.skill_tags(F.col("text")).alias("b")))
            .orderBy("doc_id").collect()]
    monkeypatch.setattr(sk, "AUTOMATON_FROM", 1)
    both.append(texts.select("doc_id", sk.skill_substrings(F.col("text")).alias("a"), sk.skill_tags(F.col("text")).alias("b"))
                .orderBy("doc_id").collect())
    assert both[0] == both[1]


def test_a_hundred_thousand_terms(spark):
    """The plan stays as it is, and what the listed skills give is unchanged by terms that no text has."""
    many = [*lexicon.SKILL_SUBSTRINGS, *(f"zq{i}x" for i in range(100_000))]
    df = rows(spark, [*ODD, "Python and SQL, zq77x zq99999x", *noise(50)])
    out = df.select("id", sk.skill_substrings(F.col("text"), many).alias("v"))
    assert len(out._jdf.queryExecution().executedPlan().toString()) < 2000
    plain = df.select("id", sk.skill_substrings(F.col("text")).alias("v")).collect()
    found = {r["id"]: r["v"] for r in out.collect()}
    assert found.pop(len(ODD))[-2:] == ["zq77x", "zq99999x"]
    assert found == {r["id"]: r["v"] for r in plain if r["id"] != len(ODD)}


def test_empty_lists_and_empty_terms(spark):
    df = rows(spark, ["java go", None, ""])
    got = df.select(lexicons.substrings(F.col("text"), []).alias("a"), lexicons.whole_words(F.col("text"), []).alias("b"),
                    lexicons.substrings(F.col("text"), ["go", "", "java"]).alias("c")).collect()
    assert [(r["a"], r["b"]) for r in got] == [([], [])] * 3
    assert [r["c"] for r in got] == [["go", "", "java"], [""], [""]]
