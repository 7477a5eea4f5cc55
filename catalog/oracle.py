"""The registered queries in DuckDB SQL, over the same whole tables."""

from __future__ import annotations

from pairloom.fixed_values import (
    CHAT_OPENING, CHAT_TEMPLATE, COMPLETION_TEMPLATE, ENGLISH_STOP_WORDS, MENTION_MESSAGE,
    MENTION_WORDS, NOVELTY_STOP_WORDS, OVERLAP_STOP_WORDS, STRUCTURE_MESSAGE, TEACHER_TEMPLATE,
    TECH_KEYWORDS, TRAINING_TEMPLATE,
)

# ------------------------------------------------------------------ SQL pieces

# Python's \s spelled out, one range at a time.
SPACE = (
    r"[\t-\r\x1c-\x20\x85\xa0\x{1680}\x{2000}-\x{200a}"
    r"\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
)


def lit(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def words_list(words) -> str:
    return "[" + ", ".join(lit(w) for w in words) + "]"


def clean(c: str) -> str:
    collapsed = f"regexp_replace(coalesce({c}, ''), '{SPACE}+', ' ', 'g')"
    return f"trim(regexp_replace({collapsed}, '&[a-z]+;', ' ', 'g'), ' ')"


def strip(c: str) -> str:
    return f"regexp_replace({c}, '\\A{SPACE}+|{SPACE}+\\z', '', 'g')"


def hits(c: str) -> str:
    return "(" + " + ".join(f"contains(lower({c}), {lit(w)})::INT" for w in TECH_KEYWORDS) + ")"


def word_set(c: str, stop) -> str:
    """Distinct words of four or more ASCII letters, by splitting and filtering."""
    parts = f"string_split_regex(lower({c}), '[^\\p{{L}}\\p{{N}}_]+')"
    return (
        f"list_distinct(list_filter({parts}, lambda w: regexp_full_match(w, '[a-z]{{4,}}') "
        f"AND NOT list_contains({words_list(stop)}, w)))"
    )


def template(text: str, **fields: str) -> str:
    """Template as a concatenation, one piece between fields at a time."""
    sql = lit(text)
    for name, value in fields.items():
        sql = sql.replace("{" + name + "}", f"' || {value} || '")
    return sql


def blank(c: str) -> str:
    return f"coalesce({c}, '')"


# ------------------------------------------------------------------ fixture CTEs

BASE = """
turns_u AS (SELECT conv_id, turn, text AS user_text FROM conversations WHERE role = 'user'),
turns_a AS (SELECT conv_id, turn - 1 AS turn, text AS assistant_text FROM conversations
            WHERE role = 'assistant'),
exchanges AS (SELECT * FROM turns_u LEFT JOIN turns_a USING (conv_id, turn)),
picked AS (SELECT *, (conv_id * 7 + turn) % (SELECT count(*) FROM documents) AS own_id FROM exchanges),
asked AS (
  SELECT conv_id AS resume_id, turn AS job_id, own_id, user_text, assistant_text FROM picked
  UNION ALL
  SELECT doc_id, -1, doc_id, NULL, NULL FROM documents WHERE doc_id NOT IN (SELECT own_id FROM picked)),
base AS (
  SELECT resume_id, job_id,
         CASE WHEN coalesce(length(user_text), 0) + coalesce(length(assistant_text), 0) = 0 THEN 0
              ELSE round(coalesce(length(user_text), 0)
                         / (coalesce(length(user_text), 0) + coalesce(length(assistant_text), 0)), 6)
         END AS similarity_score,
         d.text AS original_resume, d.source AS job_title, n.text AS job_description,
         CASE WHEN d.lang <> 'en' THEN d.lang END AS job_skills,
         user_text, assistant_text, resume_id * 4294967296 + job_id AS idx
  FROM asked
  LEFT JOIN documents d ON d.doc_id = own_id
  LEFT JOIN documents n ON n.doc_id = (own_id + 1) % (SELECT count(*) FROM documents))
"""

EXAMPLES = BASE + """,
answers AS (SELECT *, CASE WHEN job_id = -1 THEN job_description ELSE assistant_text END AS answer FROM base),
examples AS (
  SELECT idx, resume_id, job_id, similarity_score, original_resume,
         CASE WHEN resume_id % 10 = 7 THEN '' ELSE job_title END AS job_title,
         job_description, job_skills,
         CASE WHEN resume_id % 2 = 0 THEN original_resume ELSE answer END AS tailored_resume,
         (CASE WHEN job_id = 0 THEN replace(answer, chr(10), chr(10) || chr(10)) ELSE answer END)
         || (CASE WHEN resume_id % 3 <> 0 THEN chr(10) || chr(10) || 'This role fits me.' ELSE '' END)
           AS cover_letter
  FROM answers)
"""

RESULTS = BASE + """,
results AS (
  SELECT idx, resume_id, job_id, original_resume, job_title, job_description,
         assistant_text AS tailored_resume, user_text AS cover_letter,
         user_text AS ground_truth_resume, assistant_text AS ground_truth_cover_letter
  FROM base)
"""

# ------------------------------------------------------------------ matching CTEs

STOP = words_list(ENGLISH_STOP_WORDS)
DOCS = f"""
docs AS (
  SELECT 'l' AS side, doc_id AS id, text FROM documents
  UNION ALL
  SELECT 'r', page_id, url || ' ' || html || ' ' FROM pages),
toks AS (
  SELECT side, id, list_filter(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]{{2,}}'),
         lambda w: NOT list_contains({STOP}, w)) AS t FROM docs),
grams AS (
  SELECT side, id, unnest(t) AS term FROM toks
  UNION ALL
  SELECT side, id, unnest(list_transform(range(1, len(t)), lambda i: t[i] || ' ' || t[i + 1]))
  FROM toks),
tf AS (SELECT side, id, term, count(*) AS tf FROM grams GROUP BY ALL),
vocab AS (
  SELECT term, CAST(sum(tf) AS BIGINT) AS total, count(*) AS df FROM tf GROUP BY term
  HAVING count(*) >= 2 ORDER BY total DESC, term LIMIT 1000)
"""
LARGE_DOCS = DOCS.replace("LIMIT 1000)", "LIMIT 100000)")
WEIGHTS = DOCS + """,
raw AS (
  SELECT side, id, term, tf * (ln((1 + (SELECT count(*) FROM docs)) / (1 + df)) + 1) AS w
  FROM tf JOIN vocab USING (term)),
weights AS (
  SELECT side, id, term, w / sqrt(sum(w * w) OVER (PARTITION BY side, id)) AS weight FROM raw)
"""
SCORES = WEIGHTS + """,
scores AS (
  SELECT l.id AS left_id, r.id AS right_id, sum(l.weight * r.weight) AS s
  FROM weights l JOIN weights r ON l.term = r.term AND l.side = 'l' AND r.side = 'r'
  GROUP BY 1, 2),
every_pair AS (
  SELECT d.doc_id AS left_id, p.page_id AS right_id, round(coalesce(s, 0), 6) AS score
  FROM documents d CROSS JOIN pages p
  LEFT JOIN scores ON left_id = d.doc_id AND right_id = p.page_id)
"""


def pairs(k: int, target: int | None) -> str:
    """Left rows by id, the best 2k, k of them in md5 order, cut at the target."""
    cap = "" if target is None else f"LIMIT {target}"
    return SCORES + f""",
candidates AS (
  SELECT * FROM every_pair
  QUALIFY row_number() OVER (PARTITION BY left_id ORDER BY score DESC, right_id) <= {2 * k}),
sampled AS (
  SELECT *, row_number() OVER (PARTITION BY left_id ORDER BY md5('42|' || left_id || '|' || right_id)) AS n
  FROM candidates),
pairs AS (
  SELECT left_id AS resume_id, right_id AS job_id, score AS similarity_score
  FROM sampled WHERE n <= {k} ORDER BY left_id, n {cap})
"""


FULL = """,
full_pairs AS (
  SELECT resume_id, job_id, similarity_score, d.text AS resume_text, p.url AS job_title,
         p.html AS job_description, CAST(NULL AS VARCHAR) AS job_skills,
         CAST(NULL AS VARCHAR) AS company_name, CAST(NULL AS VARCHAR) AS location,
         'any' AS experience_level
  FROM pairs LEFT JOIN documents d ON d.doc_id = resume_id LEFT JOIN pages p ON p.page_id = job_id)
"""

# ------------------------------------------------------------------ responses

_MADE = "(user_text || ' ' || assistant_text || chr(10) || 'end')"
_WHOLE = f"CAST(json_object('tailored_resume', {_MADE}, 'cover_letter', assistant_text) AS VARCHAR)"
_SHORT = "CAST(json_object('tailored_resume', 'short', 'cover_letter', assistant_text) AS VARCHAR)"
_RESUME_RE = lit(rf'"tailored_resume"{SPACE}*:{SPACE}*"(.*?)"(?:,|{SPACE}*\}})')
_LETTER_RE = lit(rf'"cover_letter"{SPACE}*:{SPACE}*"(.*?)"(?:{SPACE}*\}})')
_TRIM = lit(r'\A[ :,"{}]+|[ :,"{}]+\z')
_AFTER = "string_split(t, '\"tailored_resume\"')[2]"

RESPONSES = BASE + f""",
sent AS (
  SELECT *, resume_id % 8 AS form,
    (CASE WHEN resume_id % 8 = 6 THEN 'x' ELSE '' END) || 'resume_' || resume_id || '_job_' || job_id AS key,
    CASE WHEN assistant_text IS NULL THEN NULL ELSE CASE resume_id % 8
      WHEN 1 THEN '```json' || chr(10) || {_WHOLE} || chr(10) || '```'
      WHEN 2 THEN '{{"tailored_resume": "' || {_MADE} || '", "cover_letter": "' || assistant_text || '"}}'
      WHEN 3 THEN '"tailored_resume" ' || {_MADE} || ' "cover_letter" ' || assistant_text
      WHEN 4 THEN '{{"tailored_resume": "' || {_MADE}
      WHEN 5 THEN NULL
      WHEN 7 THEN {_SHORT}
      ELSE {_WHOLE} END END AS raw
  FROM base),
opened AS (
  SELECT *, {strip("regexp_replace(regexp_replace(regexp_replace(" + strip("raw") + ", '\\A```json', ''), '\\A```', ''), '```\\z', '')")} AS t
  FROM sent),
tiers AS (
  SELECT *,
    json_valid(t) AS is_json,
    regexp_matches(t, {_RESUME_RE}, 's') AND regexp_matches(t, {_LETTER_RE}, 's') AS by_pattern,
    regexp_replace(coalesce(string_split({_AFTER}, '"cover_letter"')[1], ''), {_TRIM}, '', 'g') AS r3,
    regexp_replace(coalesce(string_split({_AFTER}, '"cover_letter"')[2], ''), {_TRIM}, '', 'g') AS l3
  FROM opened),
parsed AS (
  SELECT *,
    CASE WHEN is_json THEN json_extract_string(t, '$.tailored_resume')
         WHEN by_pattern THEN regexp_extract(t, {_RESUME_RE}, 1, 's')
         WHEN length(r3) > 100 AND length(l3) > 100 THEN r3 END AS tailored_resume,
    CASE WHEN is_json THEN json_extract_string(t, '$.cover_letter')
         WHEN by_pattern THEN regexp_extract(t, {_LETTER_RE}, 1, 's')
         WHEN length(r3) > 100 AND length(l3) > 100 THEN l3 END AS cover_letter
  FROM tiers),
outcomes AS (
  SELECT CASE WHEN job_id = 4 THEN '' ELSE key END AS key, resume_id, job_id, similarity_score,
    original_resume, job_title, job_description, coalesce(job_skills, '') AS job_skills,
    CASE WHEN job_id = 4 THEN NULL ELSE tailored_resume END AS tailored_resume,
    CASE WHEN job_id = 4 THEN NULL ELSE cover_letter END AS cover_letter,
    CASE WHEN job_id = 4 THEN 'bad_line' WHEN form = 6 THEN 'unknown_key'
         WHEN raw IS NULL THEN 'no_text'
         WHEN tailored_resume IS NULL OR cover_letter IS NULL THEN 'unparsable'
         WHEN length(tailored_resume) < 100 OR length(cover_letter) < 100 THEN 'too_short'
         ELSE 'ok' END AS outcome
  FROM parsed)
"""
INGEST_ROWS = f"""WITH {RESPONSES}
SELECT resume_id, job_id, similarity_score, original_resume, job_title, job_description,
       job_skills, tailored_resume, cover_letter
FROM outcomes WHERE outcome = 'ok'"""

BATCHED = """,
batched AS (
  SELECT resume_id, job_id, (row_number() OVER (ORDER BY resume_id, job_id) - 1) // 100 AS batch_id FROM base)
"""

# ------------------------------------------------------------------ quality


def _bound(c: str, low: int, high: int, name: str) -> str:
    return (
        f"WHEN length({c}) < {low} THEN '{name} too short (' || length({c}) || ' chars)' "
        f"WHEN length({c}) > {high} THEN '{name} too long (' || length({c}) || ' chars)'"
    )


_REQUIRED = ["original_resume", "job_title", "job_description", "tailored_resume", "cover_letter"]
_MISSING = (
    "list_filter([" + ", ".join(
        f"CASE WHEN coalesce({c}, '') = '' THEN '''{c}''' END" for c in _REQUIRED
    ) + "], lambda x: x IS NOT NULL)"
)
QUALITY = EXAMPLES + f""",
sets AS (
  SELECT *, {_MISSING} AS missing,
    {word_set("original_resume", NOVELTY_STOP_WORDS)} AS ow,
    {word_set("tailored_resume", NOVELTY_STOP_WORDS)} AS nw
  FROM examples),
shares AS (
  SELECT *, CASE WHEN len(nw) > 0 THEN
    len(list_filter(nw, lambda w: NOT list_contains(ow, w))) / len(nw) ELSE 0 END AS share FROM sets),
labelled AS (
  SELECT *, CASE
    WHEN len(missing) > 0 THEN 'Missing fields: [' || array_to_string(missing, ', ') || ']'
    {_bound("original_resume", 200, 20000, "Original resume")}
    {_bound("tailored_resume", 200, 20000, "Tailored resume")}
    {_bound("cover_letter", 200, 3000, "Cover letter")}
    {_bound("job_description", 100, 15000, "Job description")}
    WHEN share > 0.3 THEN 'Possible hallucination: ' || printf('%.1f', share * 100) || '% new words'
    WHEN len(list_filter(string_split(cover_letter, chr(10) || chr(10)),
             lambda p: {strip("p")} <> '')) < 2 THEN {lit(STRUCTURE_MESSAGE)}
    WHEN NOT ({" OR ".join(f"contains(lower(cover_letter), '{w}')" for w in MENTION_WORDS)})
      THEN {lit(MENTION_MESSAGE)}
    END AS issue
  FROM shares)
"""
_KIND = "regexp_replace(regexp_replace(issue, ' \\(\\d+ chars\\)\\z', ''), ':.*\\z', '')"

REPORT = f"""WITH {QUALITY} SELECT count(*) AS total_examples,
            count(*) FILTER (WHERE issue IS NULL) AS valid_count, count(issue) AS invalid_count,
            round(count(*) FILTER (WHERE issue IS NULL) / count(*) * 100, 6) AS valid_percentage,
            (SELECT string_agg(kind || '=' || n, ';' ORDER BY kind) FROM
              (SELECT {_KIND} AS kind, count(*) AS n FROM labelled WHERE issue IS NOT NULL GROUP BY 1)) AS reasons,
            (SELECT string_agg(idx || ':' || issue || ':' || md5(tailored_resume), '|' ORDER BY idx) FROM
              (SELECT * FROM labelled WHERE issue IS NOT NULL ORDER BY idx LIMIT 10)) AS first_examples
            FROM labelled"""

# ------------------------------------------------------------------ training text

_TRAINING_FIELDS = {
    "original_resume": blank("original_resume"), "job_title": blank("job_title"),
    "job_description": blank("job_description"),
}
PROMPT = template(TRAINING_TEMPLATE, **_TRAINING_FIELDS, job_skills="coalesce(job_skills, 'Not specified')")
COMPLETION = template(
    COMPLETION_TEMPLATE, tailored_resume=blank("tailored_resume"), cover_letter=blank("cover_letter")
)
RECORDS = EXAMPLES + f""",
records AS (SELECT idx, resume_id, job_id, similarity_score, {PROMPT} AS instruction,
            {COMPLETION} AS output, cover_letter FROM examples)
"""


def section(c: str) -> tuple[str, str]:
    """Resume and letter of a marked text."""
    parts = f"string_split({c}, 'COVER LETTER:')"
    resume = strip(f"replace({parts}[1], 'TAILORED RESUME:', '')")
    return resume, strip(f"{parts}[2]")


_OUT_RESUME, _OUT_LETTER = section(strip("output"))
_TRUTH_RESUME, _TRUTH_LETTER = section("coalesce(cover_letter, '')")
_HAS = "contains({}, 'COVER LETTER:')"

SPLIT = """
ranked AS (
  SELECT doc_id, row_number() OVER (ORDER BY md5('42|' || doc_id), doc_id) AS n,
         (SELECT count(*) FROM documents) AS total FROM documents),
split_rows AS (
  SELECT doc_id, CASE WHEN n <= floor(total * 0.8::DOUBLE) THEN 'train'
    WHEN n <= floor(total * 0.8::DOUBLE) + floor(total * 0.1::DOUBLE) THEN 'val' ELSE 'test' END AS split
  FROM ranked)
"""

# ------------------------------------------------------------------ evaluation


def rouge(source: str, name: str, made: str = "tailored_resume", truth: str = "ground_truth_resume") -> str:
    """CTEs with per-row scores for n = 1, 2 on plain tokens."""
    tokens = "regexp_extract_all(lower({}), '[a-z0-9]+')"
    bi = "list_transform(range(1, len({0})), lambda i: {0}[i] || ' ' || {0}[i + 1])"
    ctes = f""",
{name}_t AS (SELECT idx, {tokens.format(blank(made))} AS p1, {tokens.format(blank(truth))} AS r1 FROM {source}),
{name}_g AS (SELECT idx, p1, r1, {bi.format("p1")} AS p2, {bi.format("r1")} AS r2 FROM {name}_t)"""
    for n in (1, 2):
        ctes += f""",
{name}_m{n} AS (
  SELECT idx, sum(least(cp, cr)) AS m FROM
    (SELECT idx, g, count(*) AS cp FROM (SELECT idx, unnest(p{n}) AS g FROM {name}_g) GROUP BY ALL)
    JOIN (SELECT idx, g, count(*) AS cr FROM (SELECT idx, unnest(r{n}) AS g FROM {name}_g) GROUP BY ALL)
    USING (idx, g) GROUP BY idx),
{name}_s{n} AS (
  SELECT idx, coalesce(m, 0) / greatest(len(p{n}), 1) AS p, coalesce(m, 0) / greatest(len(r{n}), 1) AS r
  FROM {name}_g LEFT JOIN {name}_m{n} USING (idx))"""
    columns = ", ".join(_f_columns(f"s{n}", f"rouge{n}") for n in (1, 2))
    return ctes + f""",
{name} AS (SELECT s1.idx, {columns} FROM {name}_s1 s1 JOIN {name}_s2 s2 USING (idx))"""


def _f_columns(table: str, name: str) -> str:
    p, r = f"{table}.p", f"{table}.r"
    return (
        f"{p} AS {name}_precision, {r} AS {name}_recall, "
        f"CASE WHEN {p} + {r} > 0 THEN 2 * {p} * {r} / ({p} + {r}) ELSE 0 END AS {name}_fmeasure"
    )


def rouge_l(source: str, name: str, made: str = "tailored_resume", truth: str = "ground_truth_resume") -> str:
    """CTEs for the longest common subsequence: one table row of the dynamic programme
    per step. A row only grows to the right, so it is a running maximum."""
    tokens = "regexp_extract_all(lower({}), '[a-z0-9]+')"
    return f""",
{name}_t AS (SELECT idx, {tokens.format(blank(made))} AS p, {tokens.format(blank(truth))} AS r FROM {source}),
{name}_dp AS (
  SELECT idx, 0 AS step, j, 0::BIGINT AS best FROM {name}_t, unnest(range(1, len(r) + 1)) AS u(j)
  UNION ALL
  SELECT idx, step + 1, j, max(grown) OVER (PARTITION BY idx ORDER BY j) FROM (
    SELECT idx, step, j, CASE WHEN p[step + 1] = r[j]
      THEN coalesce(lag(best) OVER (PARTITION BY idx ORDER BY j), 0) + 1 ELSE best END AS grown
    FROM {name}_dp JOIN {name}_t USING (idx) WHERE step < len(p))),
{name}_s AS (
  SELECT idx, coalesce(m, 0) / greatest(len(p), 1) AS p, coalesce(m, 0) / greatest(len(r), 1) AS r
  FROM {name}_t LEFT JOIN (SELECT idx, max(best) AS m FROM {name}_dp GROUP BY idx) USING (idx)),
{name} AS (SELECT s.idx, {_f_columns("s", "rougeL")} FROM {name}_s s)"""


PARTS = ("precision", "recall", "fmeasure")
ROUGE_COLUMNS = [f"rouge{n}_{p}" for n in (1, 2) for p in PARTS]


def _13a(c: str) -> str:
    sql = f"coalesce({c}, '')"
    for old, new in (("'<skipped>'", "''"), ("'-' || chr(10)", "''"), ("chr(10)", "' '")):
        sql = f"replace({sql}, {old}, {new})"
    for old, new in (("&quot;", '"'), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">")):
        sql = f"replace({sql}, '{old}', '{new}')"
    sql = f"' ' || {sql} || ' '"
    for pattern, new in (
        (r"([\{-\~\[-\` -\&\(-\+\:-\@\/])", r" \1 "), (r"([^0-9])([\.,])", r"\1 \2 "),
        (r"([\.,])([^0-9])", r" \1 \2"), (r"([0-9])(-)", r"\1 \2 "),
    ):
        sql = f"regexp_replace({sql}, '{pattern}', '{new}', 'g')"
    return f"list_filter(string_split_regex({sql}, '{SPACE}+'), lambda x: x <> '')"


def _ngram(c: str, n: int) -> str:
    joined = " || ' ' || ".join(f"{c}[i + {k}]" for k in range(n))
    return f"list_transform(range(1, len({c}) - {n - 2}), lambda i: {joined})"


def bleu_ctes(name: str, made: str, truth: str) -> str:
    """CTEs with the corpus counts, one row."""
    ctes = f""",
{name}_t AS (SELECT idx, {_13a(made)} AS p, {_13a(truth)} AS r FROM results)"""
    for n in range(1, 5):
        ctes += f""",
{name}_m{n} AS (
  SELECT coalesce(sum(least(cp, cr)), 0) AS m FROM
    (SELECT idx, g, count(*) AS cp FROM (SELECT idx, unnest({_ngram("p", n)}) AS g FROM {name}_t) GROUP BY ALL)
    JOIN (SELECT idx, g, count(*) AS cr FROM (SELECT idx, unnest({_ngram("r", n)}) AS g FROM {name}_t) GROUP BY ALL)
    USING (idx, g))"""
    orders = ", ".join(
        f"CAST((SELECT m FROM {name}_m{n}) AS BIGINT) AS match_{n}, "
        f"CAST(sum(greatest(len(p) - {n - 1}, 0)) AS BIGINT) AS total_{n}"
        for n in range(1, 5)
    )
    return ctes + f""",
{name} AS (
  SELECT CAST(sum(len(p)) AS BIGINT) AS sys_len, CAST(sum(len(r)) AS BIGINT) AS ref_len, {orders}
  FROM {name}_t)"""


def bleu_row(name: str) -> str:
    """Score and precisions from the counts."""
    return f"""SELECT CASE WHEN sys_len < ref_len THEN exp(1 - ref_len / sys_len) ELSE 1 END
      * exp((ln(p1) + ln(p2) + ln(p3) + ln(p4)) / 4) AS bleu,
      {", ".join(f"p{n} AS bleu_precision_{n}" for n in range(1, 5))}
    FROM (SELECT *, {", ".join(f"{_PRECISION[n]} AS p{n}" for n in range(1, 5))} FROM {name})"""


# Each order without a match has halved the share of the orders from there on.
_HALVED = {
    n: " + ".join(f"(match_{k} = 0)::INT" for k in range(1, n + 1)) for n in range(1, 5)
}
_PRECISION = {
    n: f"CASE WHEN match_{n} > 0 THEN 100.0::DOUBLE * match_{n} / total_{n} "
       f"ELSE 100.0::DOUBLE / (pow(2, {_HALVED[n]}) * total_{n}) END"
    for n in range(1, 5)
}

def overlap_ctes(name: str, target: str) -> str:
    return f""",
{name}_w AS (SELECT idx, {word_set(target, OVERLAP_STOP_WORDS)} AS w,
  {word_set("tailored_resume", OVERLAP_STOP_WORDS)} AS p FROM results),
{name} AS (
  SELECT idx, CASE WHEN len(w) > 0 THEN
    len(list_filter(w, lambda x: list_contains(p, x))) / len(w) END AS overlap FROM {name}_w)"""


TITLE = "coalesce(job_title, '')"
TARGET = TITLE + " || ' ' || coalesce(job_description, '')"
OVERLAP = RESULTS + overlap_ctes("overlap_rows", TARGET)

VECTORS = """
vectors AS (
  SELECT a.vec_id, CAST(a.embedding AS DOUBLE[]) AS p, CAST(b.embedding AS DOUBLE[]) AS r
  FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1),
cosines AS (SELECT vec_id, list_cosine_similarity(p, r) AS cosine FROM vectors)
"""

# ------------------------------------------------------------------ queries


def stage(c: str, table: str) -> str:
    return f"""
SELECT count(*) AS original, count(*) FILTER (WHERE length(t) > 100) AS after_length,
       count(*) FILTER (WHERE length(t) > 100 AND h >= 1) AS after_gate,
       count(DISTINCT CASE WHEN length(t) > 100 AND h >= 1 THEN t END) AS after_dedup
FROM (SELECT t, {hits("t")} AS h FROM (SELECT {clean(c)} AS t FROM {table}))"""


BASELINE = """,
baseline AS (SELECT idx, coalesce(job_description, '') AS tailored_resume, ground_truth_resume FROM results)"""


def evaluate_plain() -> str:
    """Every metric of the run as rows, from the pieces above."""
    sides = (("resume", "tailored_resume", "ground_truth_resume"),
             ("cover_letter", "cover_letter", "ground_truth_cover_letter"))
    ctes, rows = "", []
    for side, made, truth in sides:
        ctes += rouge("results", f"{side}_n", made, truth) + rouge_l("results", f"{side}_l", made, truth)
        ctes += bleu_ctes(f"{side}_b", made, truth) + f", {side}_v AS ({bleu_row(side + '_b')})"
        for table, columns in (
            (f"{side}_n", ROUGE_COLUMNS), (f"{side}_l", [f"rougeL_{p}" for p in PARTS]),
        ):
            rows += [f"SELECT 'rouge_{side}' AS section, '{c}' AS metric, avg({c}) AS value FROM {table}" for c in columns]
        rows += [
            f"SELECT 'bleu_{side}', '{c}', {c} FROM {side}_v"
            for c in ["bleu"] + [f"bleu_precision_{n}" for n in range(1, 5)]
        ]
        rows += [
            f"SELECT 'length_stats_{side}', 'length_{n}', {f}(length({made})) FROM results"
            for n, f in (("mean", "avg"), ("std", "stddev_pop"), ("min", "min"), ("max", "max"))
        ]
    for name, target in (("keyword_overlap", TARGET), ("title_overlap", TITLE)):
        ctes += overlap_ctes(f"{name}_o", target)
        rows += [
            f"SELECT 'keyword_overlap', '{name}_{n}', {f}(overlap) FROM {name}_o"
            for n, f in (("mean", "avg"), ("std", "stddev_pop"))
        ]
    return f"""WITH RECURSIVE {RESULTS} {ctes}
        SELECT section, metric, round(value, 6) AS value FROM ({" UNION ALL ".join(rows)})"""


def _after(marker: str) -> str:
    return strip(f"string_split(line, '{marker}')[2]")


# The line reader as windows: the open section of a line is the last section marker
# before it, and a description starts anew at its last marker.
INSTRUCTION_PARSE = f"""WITH {RECORDS},
lines AS (
  SELECT idx, i, string_split(instruction, chr(10))[i] AS line
  FROM records, unnest(range(1, len(string_split(instruction, chr(10))) + 1)) AS u(i)),
kinds AS (
  SELECT *, CASE WHEN contains(line, 'RESUME:') THEN 'R' WHEN contains(line, 'Title:') THEN 'T'
    WHEN contains(line, 'Description:') THEN 'D' WHEN contains(line, 'Skills:') THEN 'S' ELSE 'N' END AS kind
  FROM lines),
open_lines AS (
  SELECT *, last_value(CASE WHEN kind IN ('R', 'D') THEN kind END IGNORE NULLS)
      OVER (PARTITION BY idx ORDER BY i ROWS UNBOUNDED PRECEDING) AS section,
    max(CASE WHEN kind = 'D' THEN i END) OVER (PARTITION BY idx) AS last_d FROM kinds)
SELECT idx,
  {strip("coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE kind = 'N' AND section = 'R'), '')")} AS resume,
  coalesce(arg_max({_after("Title:")}, i) FILTER (WHERE kind = 'T'), '') AS title,
  {strip("coalesce(max(" + _after("Description:") + ") FILTER (WHERE i = last_d), '') || "
         "coalesce(string_agg(line, ' ' ORDER BY i) FILTER (WHERE kind = 'N' AND section = 'D' AND i > last_d), '')")} AS description,
  coalesce(arg_max({_after("Skills:")}, i) FILTER (WHERE kind = 'S'), '') AS skills
FROM open_lines GROUP BY idx"""


def oracle_sql() -> dict[str, str]:
    improvements = " UNION ALL ".join(
        f"""SELECT 'rouge{n}_fmeasure' AS metric, round(a, 6) AS fine_tuned, round(b, 6) AS baseline,
        round(CASE WHEN b > 0 THEN (a - b) / b * 100 ELSE 0 END, 6) AS improvement
        FROM (SELECT (SELECT avg(rouge{n}_fmeasure) FROM tuned) AS a, (SELECT avg(rouge{n}_fmeasure) FROM base_s) AS b)"""
        for n in (1, 2)
    )
    sql = {
        "clean_pages": f"""SELECT page_id, t AS text FROM (SELECT page_id, {clean("html")} AS t FROM pages)
            WHERE length(t) > 100""",
        "clean_resumes": f"""SELECT doc_id AS "ID", t AS "Resume_str"
            FROM (SELECT doc_id, {clean("text")} AS t FROM documents)
            WHERE length(t) > 100 AND {hits("t")} >= 1
            QUALIFY row_number() OVER (PARTITION BY t ORDER BY doc_id) = 1""",
        "clean_jobs": f"""SELECT page_id AS job_id, a AS title, t AS description, '' AS skills_desc,
              CAST(NULL AS VARCHAR) AS company_name, CAST(NULL AS VARCHAR) AS location,
              'any' AS formatted_experience_level
            FROM (SELECT page_id, {clean("url")} AS a, {clean("html")} AS t FROM pages)
            WHERE length(t) > 100 AND {hits("a || ' ' || t || ' '")} >= 1
            QUALIFY row_number() OVER (PARTITION BY t ORDER BY page_id) = 1""",
        "keyword_gate": f"""SELECT * FROM (SELECT doc_id, {hits("text || ' ' || source")} AS hits FROM documents)
            WHERE hits >= 1""",
        "dedup_first": """SELECT id AS doc_id, length(text)::INTEGER AS n, md5(text) AS text_md5
            FROM (SELECT CASE WHEN doc_id % 5 = 3 THEN doc_id - 1 WHEN doc_id % 7 <> 2 THEN doc_id END AS id, text
                  FROM documents)
            QUALIFY row_number() OVER (PARTITION BY text ORDER BY id NULLS LAST) = 1""",
        "stage_counts": f"""WITH l AS ({stage("text", "documents")}), r AS ({stage("html", "pages")})
            SELECT l.*, l.after_dedup * r.after_dedup AS potential_pairs FROM l, r""",
        "head_rows": "SELECT doc_id, lang FROM documents ORDER BY doc_id LIMIT 50",
        "vocabulary": f"WITH {DOCS} SELECT * FROM vocab",
        "vocabulary_large": f"""WITH {LARGE_DOCS}
            SELECT *, row_number() OVER (ORDER BY total DESC, term) AS rank FROM vocab""",
        "tfidf_topk_large": f"""WITH {SCORES.replace(DOCS, LARGE_DOCS)} SELECT * FROM every_pair
            QUALIFY row_number() OVER (PARTITION BY left_id ORDER BY score DESC, right_id) <= 4""",
        "tfidf_weights": f"WITH {WEIGHTS} SELECT id, term, round(weight, 6) AS weight FROM weights WHERE side = 'l'",
        "tfidf_topk": f"""WITH {SCORES} SELECT * FROM every_pair
            QUALIFY row_number() OVER (PARTITION BY left_id ORDER BY score DESC, right_id) <= 4""",
        "sample_pairs": f"WITH {pairs(100, 10000)} SELECT * FROM pairs",
        "pair_stats": f"""WITH {pairs(2, None)} SELECT count(*) AS pairs,
            round(avg(similarity_score), 6) AS mean_score, min(similarity_score) AS min_score,
            max(similarity_score) AS max_score FROM pairs""",
        "enrich_pairs": f"WITH {pairs(2, None)} {FULL} SELECT * FROM full_pairs",
        "dataset_stats": f"""WITH {pairs(2, None)} {FULL} SELECT count(*) AS pairs,
            count(DISTINCT resume_id) AS left_rows, count(DISTINCT job_id) AS right_rows,
            avg(length(resume_text)) AS mean_left_chars, avg(length(job_description)) AS mean_right_chars
            FROM full_pairs""",
        "batches": f"WITH {BASE} {BATCHED} SELECT * FROM batched",
        "pending_batches": f"""WITH {BASE} {BATCHED} SELECT * FROM batched
            WHERE batch_id NOT IN (SELECT doc_id FROM labels WHERE quality = 1)""",
        "response_outcomes": f"WITH {RESPONSES} SELECT key, outcome, tailored_resume, cover_letter FROM outcomes",
        "ingest_rows": INGEST_ROWS,
        "ingest_stream": INGEST_ROWS,
        "ingest_rejected": f"WITH {RESPONSES} SELECT key, outcome FROM outcomes WHERE outcome <> 'ok'",
        "ingest_inline": f"""WITH {RESPONSES} SELECT key, outcome, tailored_resume, cover_letter FROM outcomes
            WHERE outcome <> 'bad_line'""",
        "outcome_counts": f"""WITH {RESPONSES} SELECT outcome, count(*) AS responses,
            round(count(*) / (SELECT count(*) FROM base) * 100, 6) AS pct_of_sent
            FROM outcomes GROUP BY outcome""",
        "ingest_summary": f"""WITH {RESPONSES} SELECT
            count(*) FILTER (WHERE outcome = 'ok') AS success_count,
            count(*) FILTER (WHERE outcome <> 'ok') AS fail_count,
            round(count(*) FILTER (WHERE outcome = 'ok') / (SELECT count(*) FROM base) * 100, 6) AS success_pct,
            round(count(*) FILTER (WHERE outcome <> 'ok') / (SELECT count(*) FROM base) * 100, 6) AS fail_pct
            FROM outcomes""",
        "batch_progress": f"""WITH {RESPONSES} {BATCHED},
            per AS (SELECT batch_id, count(*) FILTER (WHERE outcome = 'ok') AS processed
                    FROM batched LEFT JOIN (SELECT * FROM outcomes WHERE outcome = 'ok') USING (resume_id, job_id)
                    GROUP BY batch_id)
            SELECT batch_id, processed,
              CAST(sum(processed) OVER (ORDER BY batch_id) AS BIGINT) AS running_total,
              (SELECT count(*) FROM base) AS total_rows FROM per""",
        "quality_issue": f"WITH {QUALITY} SELECT idx, issue, {_KIND} AS kind FROM labelled",
        "quality_routing": f"""WITH {QUALITY} SELECT idx,
            CASE WHEN issue IS NULL THEN 'valid' ELSE 'invalid' END AS route FROM labelled""",
        "quality_counts": f"""WITH {QUALITY} SELECT count(*) AS total_examples,
            count(*) FILTER (WHERE issue IS NULL) AS valid_count, count(issue) AS invalid_count,
            round(count(*) FILTER (WHERE issue IS NULL) / count(*) * 100, 6) AS valid_percentage FROM labelled""",
        "issue_histogram": f"""WITH {QUALITY} SELECT issue, count(*) AS examples, {_KIND} AS issue_kind
            FROM labelled WHERE issue IS NOT NULL GROUP BY issue""",
        "top_issues": f"""WITH {QUALITY} SELECT issue, count(*) AS examples FROM labelled
            WHERE issue IS NOT NULL GROUP BY issue ORDER BY examples DESC, issue LIMIT 10""",
        "first_invalid": f"""WITH {QUALITY} SELECT idx, issue AS issues FROM labelled
            WHERE issue IS NOT NULL ORDER BY idx LIMIT 10""",
        "valid_length_stats": f"""WITH {QUALITY} SELECT
            round(avg(length(tailored_resume)), 6) AS resume_mean, min(length(tailored_resume))::INTEGER AS resume_min,
            max(length(tailored_resume))::INTEGER AS resume_max, round(avg(length(cover_letter)), 6) AS letter_mean,
            min(length(cover_letter))::INTEGER AS letter_min, max(length(cover_letter))::INTEGER AS letter_max
            FROM labelled WHERE issue IS NULL""",
        "quality_report": REPORT,
        "report_file": REPORT,
        "instruction_records": f"""WITH {RECORDS} SELECT instruction, output, resume_id, job_id,
            similarity_score FROM records""",
        "chat_records": f"""WITH {RECORDS} SELECT idx, 0 AS position, 'user' AS role, instruction AS content FROM records
            UNION ALL SELECT idx, 1, 'assistant', output FROM records""",
        "chat_multi_turn": """WITH kept AS (
              SELECT conv_id, turn // 4 AS part, turn, role, text FROM conversations WHERE text <> '' AND role <> ''),
            marked AS (
              SELECT *, (lag(role) OVER w IS DISTINCT FROM role)::INTEGER AS new FROM kept
              WINDOW w AS (PARTITION BY conv_id, part ORDER BY turn, role, text)),
            runs AS (
              SELECT *, sum(new) OVER (PARTITION BY conv_id, part ORDER BY turn, role, text ROWS UNBOUNDED PRECEDING) AS run FROM marked),
            messages AS (
              SELECT conv_id, part, run, any_value(role) AS role, string_agg(text, E'\n\n' ORDER BY turn, role, text) AS content
              FROM runs GROUP BY ALL)
            SELECT conv_id, part, count(*)::INTEGER AS messages,
              coalesce(first(role ORDER BY run) FILTER (role <> 'system') = 'user' AND last(role ORDER BY run) = 'assistant', false) AS answered,
              string_agg(role, ',' ORDER BY run) AS roles, md5(string_agg(role || ': ' || content, E'\n' ORDER BY run)) AS text_md5
            FROM messages GROUP BY conv_id, part""",
        "chat_text": f"""WITH {RECORDS}
            SELECT {template(CHAT_TEMPLATE, instruction="instruction", output="output")} AS text, idx FROM records""",
        "split_exact": f"WITH {SPLIT} SELECT * FROM split_rows",
        "split_files": f"WITH {SPLIT} SELECT * FROM split_rows",
        "sample_record": f"WITH {SPLIT} SELECT * FROM split_rows WHERE split = 'train' ORDER BY doc_id LIMIT 1",
        "split_counts": f"""WITH {SPLIT} SELECT split, count(*) AS examples,
            round(count(*) / (SELECT count(*) FROM documents) * 100, 6) AS percentage FROM split_rows GROUP BY split""",
        "length_stats": f"""WITH {RECORDS}, n AS (SELECT length(instruction) AS p, length(output) AS c FROM records)
            SELECT count(*) AS examples, round(avg(p), 6) AS prompt_mean, min(p)::INTEGER AS prompt_min, max(p)::INTEGER AS prompt_max,
              round(avg(c), 6) AS completion_mean, min(c)::INTEGER AS completion_min, max(c)::INTEGER AS completion_max,
              round(avg(p) / 4, 6) AS prompt_tokens, round(avg(c) / 4, 6) AS completion_tokens,
              round(avg(p) / 4 + avg(c) / 4, 6) AS total_tokens FROM n""",
        "student_prompts": f"""WITH {EXAMPLES} SELECT idx, {template(
            CHAT_OPENING.replace("{instruction}", TRAINING_TEMPLATE), **_TRAINING_FIELDS,
            job_skills="coalesce(nullif(job_skills, ''), 'Not specified')")} AS prompt FROM examples""",
        "sections": f"""WITH {RECORDS} SELECT idx,
            {_OUT_RESUME} AS resume, {_OUT_LETTER} AS letter,
            CASE WHEN {_HAS.format("cover_letter")} THEN {_TRUTH_RESUME} ELSE '' END AS truth_resume,
            CASE WHEN {_HAS.format("cover_letter")} THEN {_TRUTH_LETTER} ELSE '' END AS truth_letter
            FROM records""",
        "inference_results": f"""WITH {RECORDS} SELECT idx, resume_id, job_id,
            {_OUT_RESUME} AS tailored_resume, {_OUT_LETTER} AS cover_letter,
            {_OUT_RESUME} AS ground_truth_resume, {_OUT_LETTER} AS ground_truth_cover_letter FROM records""",
        "rouge_n": f"""WITH {RESULTS} {rouge("results", "tuned")} SELECT idx,
            {", ".join(f"round({c}, 6) AS {c}" for c in ROUGE_COLUMNS)} FROM tuned""",
        "rouge_mean": f"""WITH {RESULTS} {rouge("results", "tuned")} SELECT
            {", ".join(f"round(avg({c}), 6) AS {c}" for c in ROUGE_COLUMNS)} FROM tuned""",
        "rouge_l_plain": f"""WITH RECURSIVE {RESULTS} {rouge_l("results", "longest")} SELECT idx,
            {", ".join(f"round(rougeL_{p}, 6) AS rougeL_{p}" for p in PARTS)} FROM longest""",
        "bleu_counts": f"""WITH {RESULTS} {bleu_ctes("b", "tailored_resume", "ground_truth_resume")}
            SELECT * FROM b""",
        "bleu_score": f"""WITH {RESULTS} {bleu_ctes("b", "tailored_resume", "ground_truth_resume")}
            SELECT round(bleu, 6) AS bleu, {", ".join(f"round(bleu_precision_{n}, 6) AS bleu_precision_{n}" for n in range(1, 5))}
            FROM ({bleu_row("b")})""",
        "evaluate_plain": evaluate_plain(),
        "instruction_parse": INSTRUCTION_PARSE,
        "embedding_cosine": f"WITH {VECTORS} SELECT vec_id, round(cosine, 6) AS cosine FROM cosines",
        "embedding_similarity": f"""WITH {VECTORS} SELECT round(avg(cosine), 6) AS semantic_similarity_mean,
            round(stddev_pop(cosine), 6) AS semantic_similarity_std FROM cosines""",
        "keyword_overlap_rows": f"WITH {OVERLAP} SELECT idx, round(overlap, 6) AS overlap FROM overlap_rows",
        "keyword_overlap_stats": f"""WITH {OVERLAP} SELECT round(avg(overlap), 6) AS keyword_overlap_mean,
            round(stddev_pop(overlap), 6) AS keyword_overlap_std FROM overlap_rows""",
        "text_length_eval": f"""WITH {RESULTS} SELECT round(avg(length(tailored_resume)), 6) AS length_mean,
            round(stddev_pop(length(tailored_resume)), 6) AS length_std,
            min(length(tailored_resume))::INTEGER AS length_min, max(length(tailored_resume))::INTEGER AS length_max FROM results""",
        "token_perplexity": """SELECT round(exp(sum(value / 100 * user_id) / sum(user_id)), 6) AS perplexity
            FROM events""",
        "ground_truth_gate": f"""WITH {RESULTS} SELECT coalesce(bool_or(ground_truth_resume <> ''), FALSE)
            AS has_ground_truth FROM results""",
        "compare_runs": f"""WITH {RESULTS} {BASELINE} {rouge("results", "tuned")} {rouge("baseline", "base_s")}
            {improvements}""",
        "csv_round_trip": f"""SELECT doc_id AS "ID", t AS "Resume_str"
            FROM (SELECT doc_id, {clean("text")} AS t FROM documents) WHERE length(t) > 100""",
        "jsonl_round_trip": f"""WITH {BASE} SELECT resume_id, job_id, similarity_score,
            original_resume AS resume_text, job_title, job_description, job_skills,
            CAST(NULL AS VARCHAR) AS company_name, CAST(NULL AS VARCHAR) AS location,
            CAST(NULL AS VARCHAR) AS experience_level FROM base""",
        "json_document_scan": f"""WITH {RESULTS} SELECT resume_id, job_id, original_resume, job_title, job_description,
            tailored_resume, cover_letter, ground_truth_resume, ground_truth_cover_letter FROM results""",
        "metrics_report_file": evaluate_plain(),
        "evaluate_without_truth": evaluate_plain() + " WHERE section LIKE 'length%' OR section LIKE 'keyword%'",
        "evaluate_vectors": f"""WITH {RESULTS}, cosines AS (
              SELECT list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) AS c
              FROM results JOIN embeddings a ON a.vec_id = resume_id % (SELECT count(*) FROM embeddings)
              JOIN embeddings b ON b.vec_id = (resume_id + 1) % (SELECT count(*) FROM embeddings))
            SELECT section, metric, round(value, 6) AS value FROM
              (SELECT 'semantic_similarity_mean' AS metric, avg(c) AS value FROM cosines
               UNION ALL SELECT 'semantic_similarity_std', stddev_pop(c) FROM cosines),
              (SELECT unnest(['semantic_similarity_resume', 'semantic_similarity_cover']) AS section)""",
    }
    prompt = template(
        TEACHER_TEMPLATE, resume_text=blank("original_resume"), job_title=blank("job_title"),
        job_description=blank("job_description"), job_skills="coalesce(job_skills, 'Not specified')",
    )
    key = "'resume_' || resume_id || '_job_' || job_id"
    sql["request_lines"] = f"""WITH {BASE} SELECT {key} AS key, {prompt} AS prompt, 'user' AS role,
        0.7::DOUBLE AS temperature, 8000 AS max_output_tokens FROM base"""
    sql["request_files"] = f"""WITH {BASE} {BATCHED} SELECT {key} AS key, batch_id, {prompt} AS prompt, 'user' AS role,
        0.7::DOUBLE AS temperature, 8000 AS max_output_tokens FROM base JOIN batched USING (resume_id, job_id)"""
    sql["request_json"] = f"WITH {BASE} SELECT {key} AS key, md5({prompt}) AS prompt_md5 FROM base"
    return sql
