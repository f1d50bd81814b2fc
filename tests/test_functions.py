"""Column functions on hand-made rows."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

from matchloom import lexicon
from matchloom.functions import formats, profile, skills as sk, text as tx, web
from matchloom.sources.pages import job_cards, job_details, key_values
from matchloom.sources.searches import searches, with_search_url


def value(spark, column, text=None):
    return spark.createDataFrame([(text,)], "text string").select(column.alias("v")).first()["v"]


T = "text"


def of(function, *args):
    return lambda spark, text: value(spark, function(F.col(T), *args), text)


def test_stop_words_are_those_of_spark(spark):
    from pyspark.ml.feature import StopWordsRemover

    assert lexicon.STOP_WORDS == StopWordsRemover.loadDefaultStopWords("english")


@pytest.mark.parametrize("text, want", [
    (None, ""), ("", ""), ("  A-b\tC#  d++ é! ", "a b c# d++"),
])
def test_normalize(spark, text, want):
    assert of(tx.normalize_text)(spark, text) == want


def test_keywords_keep_length_and_signs(spark):
    got = of(tx.keyword_set, lexicon.STOP_WORDS)(spark, "The C++ and C# ab abc abc-def with é12")
    assert got == ["c++", "abc", "def"]


def test_keyword_set_equals_normalise_and_split(spark):
    text = "naïve C++x #tag a_b foo.bar\n\nÉcole 12345 don't can't"
    words = of(tx.normalize_text)(spark, text).split()
    want = {w for w in words if len(w) > 2 and w not in lexicon.STOP_WORDS}
    assert set(of(tx.keyword_set, lexicon.STOP_WORDS)(spark, text)) == want


def test_terms_drop_stop_words_before_bigrams(spark):
    words = tx.tokens(F.col(T), lexicon.STOP_WORDS)
    got = value(spark, tx.term_counts(tx.unigrams_and_bigrams(words)), "Data of data: the x big_data data")
    want = Counter(["data", "data", "big_data", "data", "data data", "data big_data", "big_data data"])
    assert [(r["term"], r["tf"]) for r in got] == sorted(want.items())
    assert value(spark, tx.term_counts(tx.unigrams_and_bigrams(words)), "the of") == []


@pytest.mark.parametrize("text, want", [
    ("Python, java & Javascript", {"python", "java", "javascript"}),
    ("c++ c++x pythonic", {"c++"}),
    ("épython", set()),
    ("Machine Learning on SQL Server with CI/CD", {"machine learning", "sql server", "ci/cd"}),
])
def test_skill_tags(spark, text, want):
    assert set(of(sk.skill_tags)(spark, text)) == want


def test_skill_substrings_hit_inside_words(spark):
    assert set(of(sk.skill_substrings)(spark, "A GOOD trip")) == {"go", "r"}


def test_skill_phrases(spark):
    got = of(sk.skill_phrases)(spark, "Spring\nBoot and AWS, N.A.S.A x IT AveryVeryLongRun Of Many Words")
    assert set(got) == {"spring\nboot", "aws", "n.a.s.a"}


@pytest.mark.parametrize("resume, job, want", [
    (["a"], [], 1.0), (["A"], ["a", "b"], 0.5), ([], ["a"], 0.0), (None, None, 1.0),
    (["x", "X"], ["x", "X"], 1.0),
])
def test_skill_coverage(spark, resume, job, want):
    df = spark.createDataFrame([(resume, job)], "a array<string>, b array<string>")
    assert df.select(sk.skill_coverage(F.col("a"), F.col("b")).alias("v")).first()["v"] == want


def test_matched_skills_compare_as_written(spark):
    df = spark.createDataFrame([(["python", "sql"], ["Python", "sql"])], "a array<string>, b array<string>")
    assert df.select(sk.matched_skills(F.col("a"), F.col("b")).alias("v")).first()["v"] == ["sql"]


@pytest.mark.parametrize("text, want", [
    ("\n\n Ann B. Lee \nx", "Ann B. Lee"),
    ("12 Main St\nJo Li", "Jo Li"),
    ("a\nb\nc\nd\ne\nLate Name", "Unknown"),
    ("One Two Three Four Five\nJo Li", "Jo Li"),
    ("", "Unknown"), (None, "Unknown"),
])
def test_name(spark, text, want):
    assert of(profile.person_name)(spark, text) == want


@pytest.mark.parametrize("text, want", [
    ("call +91-9876543210 or 5", "+91-9876543210"),
    ("5 and 9876543210", "9876543210"),
    ("room 12 at 000 000 0000", "12"),
    ("000 000 0000", "000 000 0000"),
    ("none", ""),
])
def test_phone_patterns_in_order(spark, text, want):
    assert of(profile.phone)(spark, text) == want


def test_email_first_hit(spark):
    assert of(profile.email)(spark, "x a.b+c@d-e.co.uk, z@y.com") == "a.b+c@d-e.co.uk"
    assert of(profile.email)(spark, "none") == ""


def test_links_any_case(spark):
    text = "see LinkedIn.com/in/jo-É_1/ and GITHUB.com/Jo?x"
    assert of(profile.linkedin)(spark, text) == "https://LinkedIn.com/in/jo-É_1"
    assert of(profile.github)(spark, text) == "https://GITHUB.com/Jo"


def test_education_takes_the_next_line(spark):
    got = of(profile.education)(spark, "x\n B.Tech in it \nCollege\n2010 PhD")
    assert [tuple(r) for r in got] == [("B.Tech in it", "College"), ("2010 PhD", "")]


@pytest.mark.parametrize("text, want", [
    ("a\nWork Experience\n\n x \ny\nEducation\nz", ["Work Experience", "x", "y"]),
    ("Skills and experience\nx", []),
    ("experience\nx", ["experience", "x"]),
    ("Education\nexperience\nx", ["experience", "x"]),
    ("none", []),
])
def test_experience(spark, text, want):
    assert of(profile.experience)(spark, text) == want


@pytest.mark.parametrize("url, want", [
    ("https://h/job-listings-x-123?src=a", "123"),
    ("https://h/job-1?a=b-c", "c"),
    ("https://h/job?x=1", "https://h/job"),
    ("", ""), (None, ""),
])
def test_job_id(spark, url, want):
    assert of(web.job_id_from_url)(spark, url) == want


def test_search_urls(spark):
    specs = searches(spark, [
        {"keywords": "Python Developer", "location": "Bangalore", "experience": [2, 5]},
        {"keywords": "a/b+c~d*é", "location": ""},
    ])
    got = [r["search_url"] for r in with_search_url(specs, "https://h/").collect()]
    assert got == ["https://h/jobs?k=Python%20Developer&l=Bangalore&experience=2-5",
                   "https://h/jobs?k=a/b%2Bc~d%2A%C3%A9&experience=0-20"]


def test_key_values_last_one_wins(spark):
    df = spark.createDataFrame([([" Role: ", "Dev", "ROLE", "Lead", "Job Type:", "Full", "odd"],),
                                ([],)], "s array<string>")
    got = [r["v"] for r in df.select(key_values(F.col("s")).alias("v")).collect()]
    assert got == [{"role": "Lead", "job_type": "Full"}, {}]


CARD_PAGE = """<div class="list"><!-- <article><a class="title" href="/x">No</a></article> -->
<article><a href="/job-listings-dev-42?s=1" class="x title"> Dev &amp; Ops </a>
<span class="comp-name">Acme</span><span class="loc-wrap"><span title="P">Pune</span></span>
<ul class="tags-gt"><li>Java</li><li> Go </li></ul></article>
<article><p>no title</p></article><article><span class="title">Bare</span></article></div>"""


def test_cards(spark):
    pages = spark.createDataFrame([(1, CARD_PAGE)], "page_id int, html string")
    rows = job_cards(pages, F.lit("2024-01-01").cast("timestamp"), keep=("page_id",)).orderBy(
        "card_no").collect()
    first, bare = rows
    assert (first["title"], first["company"], first["location"], first["job_id"]) == (
        "Dev & Ops", "Acme", "Pune", "42")
    assert first["skills"] == ["Java", "Go"] and first["salary"] == "Not disclosed"
    assert (bare["title"], bare["url"], bare["job_id"], bare["company"]) == (
        "Bare", None, "", "Not specified")


def test_details(spark):
    html = """<div class="jd-header"><h1>Dev</h1><div class="exp-sal-loc"><span>1-2</span><span>9</span><span>Pune</span></div></div>
    <div class="key-skill"><a>Java</a></div><div class="detail"><span>Location:</span><span>Goa</span>
    <span>Role:</span><span>Lead</span></div>"""
    pages = spark.createDataFrame([(html,), ("<h1>X</h1><div class='exp-sal-loc'></div>",)], "html string")
    full, bare = job_details(pages).collect()
    assert (full["title"], full["experience"], full["location"], full["skills"]) == (
        "Dev", "1-2", "Goa", ["Java"])
    assert full["details"] == {"location": "Goa", "role": "Lead"}
    assert (bare["experience"], bare["company"], bare["skills"]) == (None, None, [])


def test_iso_text(spark):
    df = spark.sql("SELECT timestamp '2024-01-02 03:04:05' a, timestamp '2024-01-02 03:04:05.6' b")
    got = df.select(formats.iso_text(F.col("a")), formats.iso_text(F.col("b"))).first()
    assert tuple(got) == ("2024-01-02T03:04:05", "2024-01-02T03:04:05.600000")
    assert value(spark, formats.iso_time(F.lit("2024-01-02T03:04:05.6"))).microsecond == 600000
    assert value(spark, formats.iso_time(F.lit("some time"))) is None


def test_percent_text(spark):
    assert value(spark, formats.labelled_percent("keyword", F.lit(0.4561))) == "Keyword: 45.6%"


PAGE = """<html><body><article class="advert"><a class="title" href="/x">Advert</a></article>
<div class='list big'><article><div class="head"><a class='title t2' href='https://j/dev-a-b-17?src=x&amp;y=1'>Dev &amp; <b>Ops</b></a></div>
<a class=comp-name>A&#8377;B</a><div class="loc-wrap"><i class="icon"></i><span>Pune<span> East</span></span></div>
<ul class="tags-gt"><li>Go<ul><li>SQL</li></ul></li></ul><!-- <span class="sal-wrap">no</span> --></article></div>"""
DETAIL = """<h1>Site</h1><section class="jd-header"><h1>Dev</h1><div class="comp-name">Acme</div><div class="exp-sal-loc">
<div><span>1-2 Yrs</span></div><div><span>&#x20B9; 5</span></div><span>Pune</span></div></section>
<div class="job-desc"><div>First..</div><div>Second with python</div></div>
<div class="key-skill"><div><a>Go</a></div><div><a>SQL</a></div></div>
<div class="detail"><span>Role:</span><span>Dev</span></div><div class='detail'><span>Open To</span><span>all</span></div>"""


def test_cards_of_nested_markup(spark):
    pages = spark.createDataFrame([(PAGE,), (None,), ("<div class=list><article>",)], "html string")
    row, = job_cards(pages, F.current_timestamp()).collect()
    assert (row["title"], row["url"], row["job_id"]) == ("Dev & Ops", "https://j/dev-a-b-17?src=x&y=1", "17")
    assert (row["company"], row["location"], row["salary"]) == ("A₹B", "Pune East", "Not disclosed")
    assert row["skills"] == ["GoSQL", "SQL"]


def test_details_of_nested_markup(spark):
    row = job_details(spark.createDataFrame([(DETAIL,)], "html string")).first()
    assert (row["title"], row["company"], row["description"]) == ("Dev", "Acme", "First..Second with python")
    assert (row["experience"], row["salary"], row["location"]) == ("1-2 Yrs", "₹ 5", "Pune")
    assert row["skills"] == ["Go", "SQL"] and row["details"] == {"role": "Dev", "open_to": "all"}


def test_unicode_blanks(spark):
    text = "\u00a0 \u2003Ann\u00a0Lee\u3000\nx"
    row = spark.createDataFrame([(text,)], "t string").select(profile.person_name(F.col("t")), tx.strip(F.lit("\u00a0a\x1c"))).first()
    assert list(row) == ["Ann\u00a0Lee", "a"]
