"""DuckDB SQL that computes the same results another way."""

from __future__ import annotations

from matchloom import lexicon
from matchloom.functions.skills import tag_pattern
from workload.queries import EXTRA_TERMS, LEAST, SECTION_STARTS, SECTION_STOPS, TAGS
from workload.views import CUTOFF, EARLY, MIDDLE, NOW

ORACLE: dict[str, str] = {}


def text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def values(items) -> str:
    return "[" + ", ".join(text(i) for i in items) + "]"


def with_(*ctes: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n"


# Table shapes --------------------------------------------------------------------------

JOBS = """jobs AS (
  SELECT cast(d.doc_id AS varchar) AS job_id, split_part(d.text, chr(10), 1) AS title,
         d.source AS company, d.lang AS location, cast(NULL AS varchar) AS experience,
         cast(NULL AS varchar) AS salary,
         'https://example.org/job-listings-x-' || cast(d.doc_id AS varchar) || '?src=a' AS url,
         d.text AS description, e.ts AS scraped_at
  FROM documents d LEFT JOIN events e ON d.doc_id = e.event_id)"""
RESUMES = """resumes AS (
  SELECT 'r' || cast(item_id AS varchar) || '.txt' AS resume_file, text FROM benchmark)"""
MATCHES = """matches AS (
  SELECT event_id AS seq, cast(user_id AS varchar) AS job_id, event_type AS resume_file,
         value AS match_score, ts AS created_at FROM events)"""


def clock(ts: str) -> str:
    return f"strftime({ts}, '%Y-%m-%d %H:%M:%S')"


def iso(ts: str) -> str:
    return f"regexp_replace(strftime({ts}, '%Y-%m-%dT%H:%M:%S.%f'), '\\.000000$', '')"


def strip(value: str) -> str:
    return f"regexp_replace({value}, '^\\s+|\\s+$', '', 'g')"


def listed(value: str) -> str:
    return f"coalesce(array_to_string(list_sort({value}), '|'), '')"


def score(value: str) -> str:
    return f"round({value}, 6) + 0.0"


# Reports -------------------------------------------------------------------------------

COMPANIES = """SELECT company, count(*) AS match_count
  FROM jobs JOIN matches USING (job_id) GROUP BY company"""
ORACLE["company_counts"] = with_(JOBS, MATCHES) + COMPANIES
ORACLE["top_companies"] = with_(JOBS, MATCHES) + COMPANIES + (
    "\nORDER BY match_count DESC, company ASC NULLS FIRST LIMIT 5")
ORACLE["match_statistics"] = with_(JOBS, MATCHES) + """
SELECT (SELECT count(*) FROM jobs) AS total_jobs, (SELECT count(*) FROM matches) AS total_matches,
       round(coalesce((SELECT avg(match_score) FROM matches), 0), 6) + 0.0 AS avg_match_score"""
ORACLE["statistics_record"] = with_(JOBS, MATCHES, f"""top AS ({COMPANIES}
  ORDER BY match_count DESC, company ASC NULLS FIRST LIMIT 5)""") + """
SELECT (SELECT count(*) FROM jobs) AS total_jobs, (SELECT count(*) FROM matches) AS total_matches,
       round(coalesce((SELECT avg(match_score) FROM matches), 0), 6) + 0.0 AS avg_match_score,
       (SELECT string_agg(company || ':' || cast(match_count AS varchar), ','
               ORDER BY match_count DESC, company) FROM top) AS top_companies"""
ORACLE["recent_matches"] = with_(JOBS, MATCHES) + f"""
SELECT seq, job_id, resume_file, match_score, {clock('created_at')} AS created_at,
       title AS job_title, company, location, url AS job_url
FROM matches JOIN jobs USING (job_id) WHERE created_at >= timestamp '{CUTOFF}'"""
ORACLE["stored_job_records"] = with_(JOBS) + f"""
SELECT job_id, title, company, location, experience, salary, url, cast(0 AS bigint) AS n_skills,
       description, cast(NULL AS varchar) AS posted_date, {iso('scraped_at')} AS scraped_at FROM jobs"""
ORACLE["stored_match_records"] = with_(MATCHES) + f"""
SELECT job_id, resume_file, match_score, cast(NULL AS double) AS keyword,
       cast(0 AS bigint) AS n_skills, {iso('created_at')} AS created_at,
       cast(0 AS bigint) AS applied FROM matches"""
RANKED = """ranked AS (
  SELECT *, row_number() OVER (PARTITION BY resume_file
                               ORDER BY match_score DESC, job_id, seq) AS rank FROM matches)"""
ORACLE["ranked_matches"] = with_(MATCHES, RANKED) + (
    "SELECT resume_file, job_id, match_score, seq, rank FROM ranked")
ORACLE["top10_per_resume"] = ORACLE["ranked_matches"] + " WHERE rank <= 10"
ORACLE["resume_groups"] = with_(MATCHES, RANKED) + """
SELECT resume_file, count(*) AS n_matches,
       string_agg(job_id, ',' ORDER BY rank) FILTER (WHERE rank <= 10) AS best_jobs
FROM ranked GROUP BY resume_file"""
ORACLE["unmatched"] = with_(JOBS, MATCHES) + """
SELECT job_id, title FROM jobs WHERE NOT EXISTS (
  SELECT 1 FROM matches m WHERE m.job_id IS NOT DISTINCT FROM jobs.job_id)"""
ORACLE["matched"] = ORACLE["unmatched"].replace("NOT EXISTS", "EXISTS")
LOG = """log AS (
  SELECT job_id, resume_file, created_at AS ts,
         CASE WHEN match_score >= 50 THEN 'applied' ELSE 'withdrawn' END AS status FROM matches)"""
ORACLE["match_status_latest"] = with_(MATCHES, LOG) + """
SELECT job_id, resume_file, max_by(status, ts) AS status FROM log GROUP BY ALL"""
ORACLE["applied_matches"] = with_(MATCHES, LOG, """latest AS (
  SELECT job_id, resume_file, max_by(status, ROW(ts, status)) AS status FROM log GROUP BY ALL)""") + """
SELECT seq, m.job_id, m.resume_file,
       cast(CASE WHEN status = 'applied' THEN 1 ELSE 0 END AS bigint) AS applied
FROM matches m LEFT JOIN latest l ON m.job_id = l.job_id AND m.resume_file = l.resume_file"""
ORACLE["new_matches_insert"] = with_(MATCHES) + f"""
SELECT job_id, resume_file, match_score, {clock('created_at')} AS created_at FROM (
  SELECT *, row_number() OVER (PARTITION BY job_id, resume_file ORDER BY seq) AS n FROM matches m
  WHERE NOT EXISTS (SELECT 1 FROM matches o WHERE o.job_id = m.job_id
                    AND o.resume_file = m.resume_file AND o.created_at < timestamp '{EARLY}'))
WHERE n = 1"""
SCORED = """scored AS (
  SELECT seq, job_id, resume_file, match_score, title AS job_title, company, location,
         url AS job_url FROM matches JOIN jobs USING (job_id))"""
ORACLE["digest_cards"] = with_(JOBS, MATCHES, SCORED, RANKED.replace("FROM matches", "FROM scored")) + """
SELECT resume_file, rank, job_title, company, location, match_score, job_url
FROM ranked WHERE rank <= 10"""


def percent(value: str) -> str:
    """One decimal, halves up, taken from the shortest decimal text of the number."""
    exact = f"cast(cast({value} AS varchar) AS decimal(38, 22))"
    return f"cast(cast(round({exact}, 1) AS decimal(20, 1)) AS varchar) || '%'"


def breakdown(before: str, between: str) -> str:
    share = "(match_score / 100)"
    shares = (("Keyword", share), ("Tfidf", f"({share} / 2)"), ("Semantic", f"({share} / 4)"),
              ("Skills", "1.0"))
    return f" || {between} || ".join(
        f"'{before}{n}: ' || {percent(f'cast({v} AS double) * 100')}" for n, v in shares)


NL = "chr(10)"
RANKED_SCORED = with_(JOBS, MATCHES, SCORED, RANKED.replace("FROM matches", "FROM scored"))
ORACLE["match_report"] = RANKED_SCORED + f"""
SELECT resume_file, rank, cast(rank AS varchar) || '. ' || job_title || ' at ' || company || {NL} ||
  '   Match Score: ' || cast(match_score AS varchar) || '%' || {NL} || '   Location: ' || location
  || {NL} || '   URL: ' || job_url || {NL} || '   Matched Skills: ' ||
  array_to_string(list_sort([location, company]), ', ') || {NL} || '   Score Breakdown:' || {NL} ||
  {breakdown('     - ', NL)} AS entry
FROM ranked"""


def escaped(value: str) -> str:
    for char, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        value = f"replace({value}, '{char}', '{entity}')"
    return value


def words_listed(value: str) -> str:
    return f"list_distinct(regexp_extract_all({value}, '[A-Za-z]+'))"


ORACLE["digest_many_skills"] = with_(
    JOBS, MATCHES, SCORED.replace("url AS job_url", "url AS job_url, description"),
    RANKED.replace("FROM matches", "FROM scored")) + f"""
SELECT resume_file, rank, '<section class=''match''><h3>' || {escaped('job_title')} || '</h3><p>' || company || ', ' ||
  location || '</p><p>Match score: ' || cast(match_score AS varchar) || '%</p><p>' || {breakdown('', "'<br>'")} || '</p>' ||
  CASE WHEN len(skills) > 0 THEN '<ul><li>' || array_to_string(skills, '</li><li>') || '</li></ul>' ELSE '' END ||
  '<a href="' || job_url || '">View job</a></section>' AS card
FROM (SELECT *, list_sort({words_listed('description')})[1:10] AS skills FROM ranked WHERE rank <= 10)"""
ORACLE["matched_skill_lists"] = f"""
SELECT doc_id, array_to_string(skills, '|') AS skills, len(skills) AS n FROM (
  SELECT a.doc_id, list_sort(list_intersect({words_listed('a.text')}, {words_listed('b.text')})) AS skills
  FROM documents a JOIN documents b ON b.doc_id = a.doc_id + 1)"""
ORACLE["resume_groups_unnamed"] = ORACLE["resume_groups"].replace(
    "event_type AS resume_file", "coalesce(nullif(event_type, 'click'), 'Unknown') AS resume_file")
ORACLE["resume_folder"] = """
SELECT md5(text || chr(10)) AS text_md5, length(text) + 1 AS n_chars, true AS named FROM benchmark WHERE length(text) > 0"""
ORACLE["digest"] = RANKED_SCORED + f"""
SELECT resume_file, n_matches, '<section><h2>Resume: ' || resume_file || '</h2><p>Found ' ||
  cast(n_matches AS varchar) || ' matching positions</p>' || cards || '</section>' AS html FROM (
  SELECT resume_file, count(*) AS n_matches, string_agg(card, '' ORDER BY rank)
           FILTER (WHERE rank <= 10) AS cards FROM (
    SELECT resume_file, rank, '<section class=''match''><h3>' || {escaped('job_title')} ||
      '</h3><p>' || company || ', ' || location || '</p><p>Match score: ' ||
      cast(match_score AS varchar) || '%</p><p>' || {breakdown('', "'<br>'")} || '</p><ul>' ||
      '<li>' || array_to_string(list_sort([location, company]), '</li><li>') || '</li></ul>' ||
      '<a href="' || job_url || '">View job</a></section>' AS card FROM ranked)
  GROUP BY resume_file)"""
ORACLE["statistics_report"] = with_(JOBS, MATCHES, f"""top AS ({COMPANIES}
  ORDER BY match_count DESC, company ASC NULLS FIRST LIMIT 5)""") + f"""
SELECT repeat('=', 50) || {NL} || 'MATCH REPORT' || {NL} || repeat('=', 50) || {NL} ||
  'Generated at: {NOW}' || {NL} || 'Total jobs: ' || (SELECT count(*) FROM jobs) || {NL} ||
  'Total matches: ' || (SELECT count(*) FROM matches) || {NL} || 'Average match score: ' ||
  (SELECT {percent('avg(match_score)')} FROM matches) || {NL} || 'Top companies:' || {NL} ||
  (SELECT string_agg('  - ' || company || ': ' || match_count || ' matches', {NL}
          ORDER BY match_count DESC, company) FROM top) || {NL} || repeat('=', 50) AS report"""
ORACLE["stream_window_counts"] = """
SELECT strftime(w, '%Y-%m-%d %H:%M:%S') AS window_start,
       strftime(w + INTERVAL 7 DAY, '%Y-%m-%d %H:%M:%S') AS window_end,
       count(*) AS n_matches, round(avg(value), 6) + 0.0 AS avg_match_score
FROM (SELECT value, time_bucket(INTERVAL 7 DAY, ts, timestamp '1970-01-01') AS w FROM events)
GROUP BY w"""

# Pages ---------------------------------------------------------------------------------

LINK = r"(?is)<a\b[^>]*>(.*?)</a\s*>"


def element(value: str) -> str:
    out = f"regexp_replace({value}, '<[^>]*>', '', 'g')"
    for old, new in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"),
                     ("&nbsp;", " "), ("&amp;", "&")):
        out = f"replace({out}, '{old}', '{new}')"
    return strip(out)


LIVE = """live AS (
  SELECT page_id, regexp_replace(html,
    '(?is)<!--.*?-->|<script\\b.*?</script>|<style\\b.*?</style>', '', 'g') AS page FROM pages)"""


def id_of(url: str) -> str:
    return f"split_part(list_last(string_split({url}, '-')), '?', 1)"


CARDS = f"""cards AS (
  SELECT page_id, card_no, title, url, {id_of('url')} AS job_id FROM (
    SELECT page_id, card_no, {element(f"regexp_extract(card, '{LINK}', 1)")} AS title,
           regexp_extract(card, '(?i)<a\\b[^>]*\\bhref="([^"]*)"', 1) AS url FROM (
      SELECT page_id, cast(generate_subscripts(found, 1) - 1 AS bigint) AS card_no, unnest(found) AS card
      FROM (SELECT page_id,
              regexp_extract_all(page, '(?is)<li\\b[^>]*>(.*?)</li\\s*>', 1) AS found FROM live)))
  WHERE title <> '')"""
ORACLE["page_job_ids"] = f"SELECT page_id, coalesce({id_of('url')}, '') AS job_id FROM pages"
ORACLE["job_cards_nav"] = with_(LIVE, CARDS) + """
SELECT page_id, card_no, title, url, 'Not specified' AS company, 'Not specified' AS location,
       'Not specified' AS experience, 'Not disclosed' AS salary, '' AS skills,
       'Not specified' AS posted_date, job_id FROM cards"""
ARTICLES = f"""articles AS (
  SELECT page_id, {element("regexp_extract(card, '(?is)<h1>(.*?)</h1>', 1)")} AS title,
         list_transform(regexp_extract_all(card, '(?is)<h1>(.*?)</h1>', 1),
                        lambda x: {element('x')}) AS skills
  FROM (SELECT page_id, unnest(regexp_extract_all(page, '(?is)<article>(.*?)</article>', 1)) AS card
        FROM live))"""
ORACLE["job_cards_article"] = with_(LIVE, ARTICLES) + f"""
SELECT page_id, title, cast(NULL AS varchar) AS url, 'Not specified' AS company,
       'Not disclosed' AS salary, '' AS job_id, {listed('skills')} AS skills
FROM articles WHERE title <> ''"""
ORACLE["search_results_union"] = with_(LIVE, CARDS, ARTICLES) + """
SELECT cast(0 AS int) AS batch_no, page_id, card_no, title, job_id FROM cards
UNION ALL SELECT 1, page_id, 0, title, '' FROM articles WHERE title <> ''"""
NEW_JOBS = """SELECT job_id, title, url, 'Not specified' AS company, 'Not disclosed' AS salary,
       '' AS description, '%s' AS scraped_at FROM (
  SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY page_id, card_no) AS n FROM cards
  WHERE %s) WHERE n = 1"""
ORACLE["new_jobs_insert"] = with_(LIVE, CARDS) + NEW_JOBS % (
    NOW, "job_id NOT IN (SELECT job_id FROM cards WHERE card_no = 0)")
ORACLE["stream_ingest"] = with_(LIVE, CARDS) + NEW_JOBS % (NOW, "true")
SPANS = f"""spans AS (
  SELECT page_id, page, list_transform(regexp_extract_all(page, '{LINK}', 1),
                                       lambda x: {element('x')}) AS s FROM live)"""
KEYS = f"""keys AS (
  SELECT page_id, name, max_by(value, i) AS value FROM (
    SELECT page_id, i, s[2 * i] AS value,
           replace(lower(replace({strip('s[2 * i - 1]')}, ':', '')), ' ', '_') AS name
    FROM (SELECT page_id, s, unnest(range(1, len(s) // 2 + 1)) AS i FROM spans))
  GROUP BY page_id, name)"""
ORACLE["job_detail_keys"] = with_(LIVE, SPANS, KEYS) + "SELECT page_id, name, value FROM keys"


def base_field(name: str, value: str) -> str:
    return (f"coalesce((SELECT value FROM keys k WHERE k.page_id = spans.page_id "
            f"AND k.name = '{name}'), {value}) AS {name}")


ORACLE["job_detail_pages"] = with_(LIVE, SPANS, KEYS) + "SELECT page_id, " + ", ".join([
    base_field("title", element("regexp_extract(page, '(?is)<h1>(.*?)</h1>', 1)")),
    base_field("company", "cast(NULL AS varchar)"),
    *[base_field(n, f"CASE WHEN len(s) >= 3 THEN s[{i}] END")
      for i, n in enumerate(("experience", "salary", "location"), 1)],
    base_field("description", element("regexp_extract(page, '(?is)<article>(.*?)</article>', 1)")),
    "array_to_string(s, '|') AS skills"]) + " FROM spans"


def quoted(value: str) -> str:
    return f"replace(url_encode({value}), '%2F', '/')"


ORACLE["search_urls"] = f"""
SELECT doc_id, 'https://jobs.example.org/jobs?' || concat_ws('&',
  CASE WHEN k <> '' THEN 'k=' || {quoted('k')} END, CASE WHEN l <> '' THEN 'l=' || {quoted('l')} END,
  'experience=' || CASE WHEN n_chars > 1000 THEN cast(n_chars % 7 AS varchar) || '-' ||
     cast(n_chars % 7 + 3 AS varchar) ELSE '0-20' END) AS search_url
FROM (SELECT *, split_part(text, chr(10), 1) AS k,
             CASE WHEN lang = 'en' THEN '' ELSE source || '/~*+ ' || lang END AS l FROM documents)"""

# Extraction ----------------------------------------------------------------------------


def edges(value: str) -> str:
    """Other letters and digits become ``_``, which ends no word in an ASCII-only engine;
    other signs become ``!``."""
    signs = f"regexp_replace({value}, '[^\\x{{00}}-\\x{{7F}}\\p{{L}}\\p{{N}}]', '!', 'g')"
    return f"regexp_replace({signs}, '[^\\x{{00}}-\\x{{7F}}]', '_', 'g')"


def tags(value: str, groups) -> str:
    found = ", ".join(f"regexp_extract_all({edges(f'lower({value})')}, {text(tag_pattern(g))}, 1)"
                      for g in groups)
    return f"list_distinct(flatten([{found}]))"


def substrings(value: str, terms) -> str:
    return f"list_filter({values(dict.fromkeys(terms))}, lambda t: contains(lower({value}), t))"


def phrases(value: str) -> str:
    found = ", ".join(f"regexp_extract_all({edges(value)}, {text(p)}, 1)"
                      for p in lexicon.SKILL_PHRASE_PATTERNS)
    low, high = lexicon.SKILL_PHRASE_LENGTH
    return (f"list_distinct(list_transform(list_filter(flatten([{found}]), "
            f"lambda p: length(p) > {low} AND length(p) < {high}), lambda p: lower(p)))")


def profile_skills(value: str) -> str:
    return (f"list_distinct(list_concat({substrings(value, lexicon.SKILL_SUBSTRINGS)}, "
            f"{phrases(value)}))")


def words(value: str) -> str:
    clean = f"regexp_replace(lower({value}), '[^a-zA-Z0-9\\s+#]', ' ', 'g')"
    return f"trim(regexp_replace({clean}, '\\s+', ' ', 'g'))"


def keywords(value: str) -> str:
    return (f"list_distinct(list_filter(string_split({words(value)}, ' '), lambda w: length(w) > 2 "
            f"AND NOT list_contains({values(lexicon.STOP_WORDS)}, w)))")


def phone(value: str) -> str:
    hits = ", ".join(f"nullif(regexp_extract({value}, {text(p)}, 0), '')" for p in lexicon.PHONE_PATTERNS)
    return f"coalesce({hits}, '')"


def name(value: str) -> str:
    lines = f"list_transform(string_split({strip(value)}, chr(10))[1:5], lambda x: {strip('x')})"
    return (f"coalesce(list_filter({lines}, lambda x: length(x) >= 3 "
            "AND NOT regexp_matches(x, '[@#$%&*()0-9]') AND regexp_matches(x, '^[A-Za-z\\s.]+$') "
            "AND len(regexp_split_to_array(x, '\\s+')) <= 4)[1], 'Unknown')")


def education(table: str, key: str) -> str:
    degree = "(?i)" + "|".join(f"(?:{p})" for p in lexicon.DEGREE_PATTERNS)
    return f"""(SELECT {key}, {strip('lines[i]')} AS degree, {strip("coalesce(lines[i + 1], '')")} AS details
  FROM (SELECT {key}, lines, unnest(range(1, len(lines) + 1)) AS i
        FROM (SELECT {key}, string_split(text, chr(10)) AS lines FROM {table}))
  WHERE regexp_matches(lines[i], {text(degree)}))"""


def experience(table: str, key: str) -> str:
    start = " OR ".join(f"contains(lower(line), {text(t)})" for t in SECTION_STARTS)
    stop = " OR ".join(f"contains(lower(line), {text(t)})" for t in SECTION_STOPS)
    return f"""(
  WITH lines AS (
    SELECT {key}, i, all_lines[i] AS line FROM (
      SELECT {key}, all_lines, unnest(range(1, len(all_lines) + 1)) AS i
      FROM (SELECT {key}, string_split(text, chr(10)) AS all_lines FROM {table}))),
  starts AS (SELECT {key}, min(i) AS a FROM lines WHERE {start} GROUP BY {key}),
  stops AS (SELECT {key}, min(i) AS b FROM lines JOIN starts USING ({key})
            WHERE i >= a AND ({stop}) GROUP BY {key})
  SELECT {key}, row_number() OVER (PARTITION BY {key} ORDER BY i) - 1 AS n, {strip('line')} AS line
  FROM lines JOIN starts USING ({key}) LEFT JOIN stops USING ({key})
  WHERE i >= a AND (b IS NULL OR i < b) AND {strip('line')} <> '')"""


def extracted(key: str, value: str) -> None:
    ORACLE[key] = f"SELECT doc_id, {value} AS value FROM documents"


extracted("resume_email", f"regexp_extract(text, {text(lexicon.EMAIL_PATTERN)}, 0)")
extracted("resume_phone", phone("text"))
extracted("resume_name", name("text"))
extracted("skill_tags", listed(tags("text", TAGS)))
extracted("skill_lexicon", listed(substrings("text", (*lexicon.SKILL_SUBSTRINGS, *EXTRA_TERMS))))
extracted("skill_phrases", listed(phrases("text")))
extracted("resume_skills", listed(profile_skills("text")))
extracted("normalized_text", words("text"))
extracted("keyword_sets", listed(keywords("text")))


def link(value: str, pattern: str) -> str:
    found = f"regexp_extract({value}, {text('(?i)' + pattern)}, 0)"
    return f"CASE WHEN {found} = '' THEN '' ELSE 'https://' || {found} END"


ORACLE["resume_links"] = f"""
SELECT doc_id, {link('t', lexicon.LINKEDIN_PATTERN)} AS linkedin,
       {link('t', lexicon.GITHUB_PATTERN)} AS github
FROM (SELECT doc_id, text || CASE WHEN lang = 'en' THEN ' LinkedIn.com/in/User-' || source || '-é.x'
        ELSE ' see GitHub.com/dev_' || source || '/x' END AS t FROM documents)"""
ORACLE["resume_education"] = f"SELECT * FROM {education('documents', 'doc_id')}"
ORACLE["resume_experience"] = f"SELECT * FROM {experience('documents', 'doc_id')}"
ORACLE["resume_records"] = with_(
    RESUMES,
    f"e AS (SELECT resume_file, count(*) AS n FROM {education('resumes', 'resume_file')} GROUP BY ALL)",
    f"x AS (SELECT resume_file, count(*) AS n FROM {experience('resumes', 'resume_file')} GROUP BY ALL)",
) + f"""
SELECT resume_file, {name('text')} AS name,
       regexp_extract(text, {text(lexicon.EMAIL_PATTERN)}, 0) AS email, {phone('text')} AS phone,
       {listed(profile_skills('text'))} AS skills, {link('text', lexicon.LINKEDIN_PATTERN)} AS linkedin,
       {link('text', lexicon.GITHUB_PATTERN)} AS github, coalesce(e.n, 0) AS n_education,
       coalesce(x.n, 0) AS n_experience
FROM resumes LEFT JOIN e USING (resume_file) LEFT JOIN x USING (resume_file)
WHERE length(text) > 0"""
ORACLE["entity_skill_sets"] = """
WITH found AS (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Z][a-z]+|[0-9]{3,}')) AS name
               FROM documents)
SELECT doc_id, array_to_string(list_sort(list(DISTINCT lower(name))), '|') AS skills FROM found
WHERE length(name) % 4 <> 3 AND length(name) > 2 AND NOT regexp_matches(name, '^[0-9]+$')
GROUP BY doc_id"""

# Similarity, by the direct formulas ----------------------------------------------------


def term_tables(side: str, source: str, key: str, value: str) -> list[str]:
    """Term counts of ``value`` per ``key``: words and neighbouring words."""
    stop = values(lexicon.STOP_WORDS)
    return [f"""{side}_words AS (
  SELECT {key} AS k, i, w[i] AS word FROM (SELECT {key}, w, unnest(range(1, len(w) + 1)) AS i FROM (
    SELECT {key}, list_filter(regexp_extract_all(lower({value}), '[\\p{{L}}\\p{{N}}_]{{2,}}'),
                              lambda x: NOT list_contains({stop}, x)) AS w FROM {source})))""",
            f"""{side}_terms AS (
  SELECT k, term, count(*) AS tf FROM (
    SELECT k, word AS term FROM {side}_words
    UNION ALL
    SELECT k, word || ' ' || lead(word) OVER (PARTITION BY k ORDER BY i) FROM {side}_words)
  WHERE term IS NOT NULL GROUP BY k, term)"""]


def cosine(cap: int | None, pairs: str = "") -> list[str]:
    """Per-pair TF-IDF, fitted on the two texts: every term of the pair gets its idf."""
    limit = "" if cap is None else f"""
  WHERE rank <= {cap}"""
    source = pairs or "SELECT DISTINCT x.k AS r, y.k AS j FROM r_terms x JOIN j_terms y USING (term)"
    return [f"common AS ({source})",
            f"""counts AS (
  SELECT r, j, term, a, b FROM (
    SELECT *, row_number() OVER (PARTITION BY r, j ORDER BY a + b DESC, term) AS rank FROM (
      SELECT r, j, term, sum(a) AS a, sum(b) AS b FROM (
        SELECT r, j, term, tf AS a, 0 AS b FROM common JOIN r_terms ON k = r
        UNION ALL SELECT r, j, term, 0, tf FROM common JOIN j_terms ON k = j)
      GROUP BY r, j, term)){limit})""",
            """cosines AS (
  SELECT r, j, sum(x * y) / sqrt(sum(x * x) * sum(y * y)) AS tfidf FROM (
    SELECT r, j, a * idf AS x, b * idf AS y FROM (
      SELECT r, j, cast(a AS double) AS a, cast(b AS double) AS b,
             ln(3.0 / (1 + CASE WHEN a > 0 AND b > 0 THEN 2 ELSE 1 END)) + 1 AS idf FROM counts))
  GROUP BY r, j)"""]


def jaccard_tables() -> list[str]:
    """Keyword lists ``r_kw`` and ``j_kw`` (k, kw) have to be defined before."""
    return ["""kw_shared AS (
  SELECT r, j, count(*) AS c FROM (SELECT k AS r, unnest(kw) AS w FROM r_kw)
  JOIN (SELECT k AS j, unnest(kw) AS w FROM j_kw) USING (w) GROUP BY r, j)""",
            """jaccards AS (
  SELECT r, j, c, c / cast(len(a.kw) + len(b.kw) - c AS double) AS keyword
  FROM kw_shared JOIN r_kw a ON a.k = r JOIN j_kw b ON b.k = j)"""]


BARE_TERMS = [*term_tables("r", "benchmark", "item_id", "text"),
              *term_tables("j", "documents", "doc_id", "text")]
ORACLE["keyword_jaccard"] = with_(
    f"r_kw AS (SELECT item_id AS k, {keywords('text')} AS kw FROM benchmark)",
    f"j_kw AS (SELECT doc_id AS k, {keywords('text')} AS kw FROM documents)",
    *jaccard_tables()) + f"""
SELECT r AS item_id, j AS doc_id, c AS shared, {score('keyword')} AS score FROM jaccards
WHERE keyword >= {LEAST['keyword']}"""
for _name, _cap in (("tfidf_pairs", None), ("tfidf_pairs_capped", 1000)):
    ORACLE[_name] = with_(*BARE_TERMS, *cosine(_cap)) + f"""
SELECT r AS item_id, j AS doc_id, {score('tfidf')} AS score FROM cosines
WHERE tfidf >= {LEAST['tfidf']}"""

VECTORS = """r_vec AS (
  SELECT 'r' || cast(item_id AS varchar) || '.txt' AS k, cast(embedding AS double[]) AS v
  FROM benchmark JOIN embeddings ON vec_id = item_id)""", """j_vec AS (
  SELECT cast(doc_id AS varchar) AS k, cast(embedding AS double[]) AS v
  FROM documents JOIN embeddings ON vec_id = (SELECT count(*) FROM benchmark) + doc_id %
    ((SELECT count(*) FROM embeddings) - (SELECT count(*) FROM benchmark)))"""
ORACLE["semantic_pairs"] = with_(*VECTORS) + f"""
SELECT resume_file, job_id, {score('s')} AS score FROM (
  SELECT r.k AS resume_file, j.k AS job_id, list_cosine_similarity(r.v, j.v) AS s
  FROM r_vec r CROSS JOIN j_vec j) WHERE s >= {LEAST['semantic']}"""
ORACLE["skills_match"] = with_(
    f"r AS (SELECT item_id, {tags('text', TAGS)} AS a FROM benchmark)",
    f"j AS (SELECT doc_id, {tags('text', TAGS)} AS b FROM documents)") + f"""
SELECT item_id, doc_id, {score('s')} AS score FROM (
  SELECT item_id, doc_id, CASE WHEN len(b) = 0 THEN 1.0
    ELSE len(list_intersect(a, b)) / cast(len(b) AS double) END AS s
  FROM r CROSS JOIN j) WHERE s >= {LEAST['skills']}"""

# The whole match: resume text with its skills, job text with its title.
SIDES = [
    RESUMES, JOBS,
    f"""r_side AS (
  SELECT resume_file AS k, skills, text || ' ' || array_to_string(list_sort(skills), ' ') AS t FROM (
    SELECT *, {profile_skills('text')} AS skills FROM resumes WHERE length(text) > 0))""",
    "j_side AS (SELECT job_id AS k, title || ' ' || description || ' ' AS t FROM jobs)",
    f"r_kw AS (SELECT k, {keywords('t')} AS kw FROM r_side)",
    f"j_kw AS (SELECT k, {keywords('t')} AS kw FROM j_side)",
    *jaccard_tables(),
    *term_tables("r", "r_side", "k", "t"), *term_tables("j", "j_side", "k", "t"),
    *cosine(1000),
    f"""r_skill AS (
  SELECT k, list_distinct(list_transform(list_concat(skills, {tags('t', lexicon.SKILL_TAG_GROUPS)}),
                                         lambda s: lower(s))) AS skills FROM r_side)""",
    f"j_skill AS (SELECT k, {tags('t', lexicon.SKILL_TAG_GROUPS)} AS skills FROM j_side)",
]


def totals(weights: dict[str, float], semantic: bool) -> list[str]:
    vectors = (list(VECTORS) if semantic else
               ["r_vec AS (SELECT k, cast(NULL AS double[]) AS v FROM r_side)",
                "j_vec AS (SELECT k, cast(NULL AS double[]) AS v FROM j_side)"])
    total = " + ".join(f"{p} * {weights[p]}" for p in ("keyword", "tfidf", "semantic", "skills"))
    return [*vectors, """part AS (
  SELECT a.k AS resume_file, b.k AS job_id, coalesce(jc.keyword, 0) AS keyword,
         coalesce(co.tfidf, 0) AS tfidf, coalesce(list_cosine_similarity(rv.v, jv.v), 0) AS semantic,
         CASE WHEN len(b.skills) = 0 THEN 1.0::double
              ELSE len(list_intersect(a.skills, b.skills)) / cast(len(b.skills) AS double) END AS skills
  FROM r_skill a CROSS JOIN j_skill b
  LEFT JOIN jaccards jc ON jc.r = a.k AND jc.j = b.k
  LEFT JOIN cosines co ON co.r = a.k AND co.j = b.k
  LEFT JOIN r_vec rv ON rv.k = a.k LEFT JOIN j_vec jv ON jv.k = b.k)""",
            f"total AS (SELECT *, least(({total}) * 100, 100) AS total FROM part)"]


WEIGHTS = {"keyword": 0.20, "tfidf": 0.25, "semantic": 0.25, "skills": 0.30}
TEXT_WEIGHTS = {"keyword": 0.5, "tfidf": 0.5, "semantic": 0.0, "skills": 0.0}
PARTS = ", ".join(f"{score(p)} AS {p}" for p in ("keyword", "tfidf", "semantic", "skills"))
ORACLE["match_scores"] = with_(*SIDES, *totals(WEIGHTS, True)) + f"""
SELECT job_id, resume_file, round(total, 2) AS match_score, {PARTS} FROM total WHERE total >= 35"""
ENTITIES = """(SELECT {key} AS k, list(DISTINCT lower(name)) AS found FROM (
  SELECT {key}, unnest(regexp_extract_all(text, '[A-Z][a-z]+|[0-9]{{3,}}')) AS name FROM {source})
  WHERE length(name) % 4 <> 3 AND length(name) > 2 AND NOT regexp_matches(name, '^[0-9]+$') GROUP BY ALL)"""


def with_entities(skills: str, source: str, key: str) -> str:
    """A table of skills with the labelled phrases of the texts added."""
    name = skills.split()[0]
    return f"""{skills.replace(name, name + '_plain', 1)},
{name} AS (SELECT k, list_distinct(list_concat(skills, coalesce(found, []))) AS skills
  FROM {name}_plain LEFT JOIN {ENTITIES.format(source=source, key=key)} USING (k))"""


ORACLE["match_scores_entities"] = with_(
    *SIDES[:-2], with_entities(SIDES[-2], "resumes", "resume_file"),
    with_entities(SIDES[-1], "(SELECT job_id, description AS text FROM jobs)", "job_id"),
    *totals(WEIGHTS, True)) + f"""
SELECT job_id, resume_file, round(total, 2) AS match_score, {PARTS} FROM total WHERE total >= 35"""
ORACLE["match_scores_text_only"] = with_(*SIDES, *totals(TEXT_WEIGHTS, False)) + f"""
SELECT job_id, resume_file, round(total, 2) AS match_score, {PARTS} FROM total WHERE total >= 10"""
ORACLE["stream_match"] = with_(*SIDES, *totals(TEXT_WEIGHTS, False)) + """
SELECT job_id, resume_file, round(total, 2) AS match_score FROM total WHERE total >= 10"""
ORACLE["match_run_second"] = with_(*SIDES, *totals(TEXT_WEIGHTS, False)) + f"""
SELECT job_id, resume_file, round(total, 2) AS match_score, '{NOW}' AS created_at
FROM total WHERE total >= 10 AND job_id NOT IN (SELECT job_id FROM total WHERE total >= 20)"""
ORACLE["best_matches"] = with_(*SIDES, *totals(WEIGHTS, True)) + """
SELECT job_id, resume_file, match_score, rank FROM (
  SELECT *, row_number() OVER (PARTITION BY resume_file ORDER BY match_score DESC, job_id) AS rank
  FROM (SELECT job_id, resume_file, round(total, 2) AS match_score FROM total WHERE total >= 0))
WHERE rank <= 10"""
ORACLE["match_full_records"] = with_(*SIDES, *totals(WEIGHTS, True)) + f"""
SELECT t.job_id, t.resume_file, j.title AS job_title, j.company, j.location, j.url AS job_url,
       round(total, 2) AS match_score, '' AS matched_skills,
       length(j.description) AS description_length, {name('r.text')} AS name,
       len(s.skills) AS skills_count
FROM total t JOIN jobs j USING (job_id) JOIN resumes r USING (resume_file)
JOIN r_side s ON s.k = t.resume_file WHERE total >= 35"""

ORACLE["match_scores_some_vectors"] = with_(*SIDES, *totals(WEIGHTS, True)).replace(
    "JOIN embeddings ON vec_id = (SELECT", "JOIN embeddings ON embedding[1] >= 0 AND vec_id = (SELECT") + f"""
SELECT job_id, resume_file, round(total, 2) AS match_score, {PARTS} FROM total WHERE total >= 35"""
ORACLE["stored_applied"] = with_(MATCHES) + f"""
SELECT job_id, resume_file, match_score, cast(coalesce((SELECT max(1) FROM matches o WHERE o.match_score >= 60
       AND o.job_id = m.job_id AND o.resume_file = m.resume_file), 0) AS bigint) AS applied
FROM (SELECT *, row_number() OVER (PARTITION BY job_id, resume_file ORDER BY seq) AS n FROM matches
      WHERE created_at < timestamp '{MIDDLE}') m WHERE n = 1"""
ORACLE["matches_in_order"] = with_(MATCHES) + """
SELECT resume_file, job_id, match_score, row_number() OVER (
  PARTITION BY resume_file ORDER BY match_score DESC, job_id) AS rank
FROM (SELECT DISTINCT resume_file, job_id, match_score FROM matches)"""
ORACLE["job_cards_classes"] = """
SELECT page_id, cast(0 AS bigint) AS card_no, 'Dev & Ops ' || page_id AS title,
       'https://j.example.org/dev-x-' || page_id || '?src=a&k=1' AS url, 'A₹B Ltd' AS company,
       'Pune' || page_id % 7 || ' East' AS location, '1-2 Yrs' AS experience, 'Not disclosed' AS salary,
       'GoSQL|SQL' AS skills, '2 days' AS posted_date, cast(page_id AS varchar) AS job_id FROM pages
UNION ALL SELECT page_id, 1, 'Bare', NULL, 'Not specified', 'Not specified', 'Not specified', 'Not disclosed',
       '', 'Not specified', '' FROM pages
UNION ALL SELECT page_id, 3, 'Don''t' || page_id, 'late-t', 'One', 'Not specified', 'Not specified', 'Not disclosed',
       'go|java|sql', 'Not specified', 't' FROM pages
UNION ALL SELECT page_id, 4, 'Last', NULL, 'Not specified', 'Not specified', 'Not specified', 'Not disclosed',
       '', 'Not specified', '' FROM pages"""
ORACLE["job_details_nested"] = """
SELECT page_id, 'Dev ' || page_id AS title, 'Acme' AS company, '1-2 Yrs' AS experience, '₹ 5' AS salary,
       'Pune' AS location, 'First.. Second with python ' || page_id AS description, 'Go|SQL|C|D|E' AS skills,
       'open_to=n' || page_id || '|role=Lead|team=Core' AS details FROM pages"""
ORACLE["digest_header"] = with_(MATCHES, JOBS, SCORED) + f"""
SELECT count(*) AS n_matches, count(DISTINCT resume_file) AS n_resumes, '{NOW}' AS created_at FROM scored"""
ORACLE["stream_best"] = ORACLE["best_by_batch"] = ORACLE["top10_per_resume"]
ORACLE["statistics_by_batch"] = ORACLE["statistics_record"]
ORACLE["skill_lexicon_large"] = ORACLE["skill_lexicon"]
