"""Queries of the operators that are one projection, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .license_scan import MIN_DICE, TEMPLATES, scan_licenses, template_bigrams
from .mixing import CAP, ROUNDS, SEED, SHARE, WEIGHTS, mix
from .quality_rules import MAX_REPEAT_PERCENT, MIN_WORDS, RULES, STOP_WORDS, Rule, judge
from .registry import query, table

WORD = r"[^\x20\x09-\x0D]+"


def _rule_sql(rule: Rule) -> str:
    share = f"(1.0 * {rule.part} / {rule.whole})"
    tests = []
    if rule.low is not None:
        tests.append(f"coalesce({rule.whole} > 0 AND {share} >= {rule.low}, false)")
    if rule.high is not None:
        tests.append(f"({rule.whole} = 0 OR {share} <= {rule.high})")
    return " AND ".join(tests)


_STOPS = ", ".join(f"'{w}'" for w in STOP_WORDS)

# relations that end in one row per document with all signals
RULES_WITH = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
w AS (
    SELECT rid, doc_id, t, regexp_extract_all(t, '{WORD}') AS ws,
           list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '{WORD}')) AS ls
    FROM d
),
u AS (SELECT rid, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM w),
v AS (
    SELECT rid, i, w, lead(w) OVER p AS w2, lead(w, 2) OVER p AS w3
    FROM u WINDOW p AS (PARTITION BY rid ORDER BY i)
),
x AS (
    SELECT rid, i, count(*) OVER (PARTITION BY rid, w, w2, w3) AS c FROM v WHERE w3 IS NOT NULL
),
y AS (
    SELECT rid, least(3, i - coalesce(lag(i) OVER (PARTITION BY rid ORDER BY i), i - 3)) AS fresh
    FROM x WHERE c >= 2
),
r AS (SELECT rid, CAST(sum(fresh) AS BIGINT) AS n FROM y GROUP BY rid),
s AS (
    SELECT w.rid, doc_id, CAST(len(ws) AS BIGINT) AS n_words,
        CAST(coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
        CAST(length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g')) AS BIGINT) AS n_symbols,
        CAST(len(ls) AS BIGINT) AS n_lines,
        CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines,
        coalesce(r.n, 0) AS n_repeat_words,
        len(list_filter(ws, lambda x: list_contains([{_STOPS}], x))) AS n_stop_words,
        len(list_filter(ls, lambda x: substr(ltrim(x, ' '), 1, 1) IN ('-', '*', '•')))
            AS n_bullet_lines,
        len(list_filter(ls, lambda x: ends_with(rtrim(x, ' '), '...') OR ends_with(rtrim(x, ' '), '…')))
            AS n_ellipsis_lines
    FROM w LEFT JOIN r ON r.rid = w.rid
),
judged AS (
    SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words
        AS base_failed
    FROM s
)
"""
RULES_SQL = (
    RULES_WITH
    + """SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
    NOT base_failed AND """
    + " AND ".join(_rule_sql(r) for r in RULES)
    + " AS kept FROM judged"
)


@query("op6_quality_rules", RULES_SQL)
def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Signals and verdict of every document."""
    return judge(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        "base_failed", "kept",
    )


def _mix_sql() -> str:
    rounds = []
    for i in range(ROUNDS):
        rounds.append(
            f"""
f{i} AS (
    SELECT r.key, size, rank, s.gap, sum(size) OVER (PARTITION BY r.key ORDER BY rank) AS upto
    FROM r JOIN s{i} s ON s.key = r.key WHERE rank > s.cut AND size <= s.gap
),
s{i + 1} AS (
    SELECT s.key, CASE WHEN coalesce(bool_and(upto <= f.gap), true) THEN 1.0
            ELSE coalesce(max(CASE WHEN upto <= f.gap THEN rank END), any_value(s.cut)) END AS cut,
        any_value(s.gap) - coalesce(max(CASE WHEN upto <= f.gap THEN upto END), 0) AS gap
    FROM s{i} s LEFT JOIN f{i} f ON f.key = s.key GROUP BY s.key
)"""
        )
    drawn = " OR ".join(
        f"(rank > s{i}.cut AND rank <= s{i + 1}.cut AND size <= s{i}.gap)" for i in range(ROUNDS)
    )
    joins = " ".join(f"JOIN s{i} ON s{i}.key = q.key" for i in range(ROUNDS + 1))
    places = " ".join(f"WHEN {i} THEN {float(w)}" for i, w in enumerate(WEIGHTS))
    return f"""
WITH d AS (
    SELECT doc_id, CAST(len(regexp_extract_all(coalesce(text, ''), '{WORD}')) AS BIGINT) AS size,
        coalesce('a' || source, 'b') AS key,
        (CAST(CAST('0x' || substr(md5('{SEED}|' || coalesce(CAST(doc_id AS VARCHAR), 'null')), 1, 13)
            AS BIGINT) AS DOUBLE) + 0.5) / 4503599627370496.0 AS u
    FROM documents
),
a AS (SELECT key, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY key),
b AS (
    SELECT *, CASE (row_number() OVER (ORDER BY key) - 1) % {len(WEIGHTS)} {places} END AS weight,
        source_size * {CAP} AS lim
    FROM a
),
c AS (
    SELECT *, lim / weight AS full_at,
        (sum(source_size) OVER () * CAST({SHARE} AS DOUBLE)
            - coalesce(sum(lim) OVER p, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER p, 0))
            AS level
    FROM b
    WINDOW p AS (ORDER BY lim / weight, key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
),
t AS (
    SELECT key, source_size, coalesce(least(CAST(lim AS DOUBLE),
        max(CASE WHEN level <= full_at THEN level END) OVER () * weight), 0.0) AS target
    FROM c
),
e AS (
    SELECT d.*, t.source_size, t.target,
        CASE WHEN t.source_size > 0 THEN least({float(CAP)}, t.target / t.source_size) ELSE 0.0 END
            AS x
    FROM d JOIN t ON t.key = d.key
),
q AS (
    SELECT *, floor(x) AS certain, CASE WHEN x - floor(x) > 0 THEN
        u * (1 - (x - floor(x))) / (u * (1 - (x - floor(x))) + (1 - u) * (x - floor(x))) END AS rank
    FROM e
),
r AS (SELECT key, size, rank FROM q WHERE rank IS NOT NULL),
s0 AS (
    SELECT key, -1.0 AS cut, any_value(target) - sum(certain * size) AS gap FROM q GROUP BY key
),{",".join(rounds)}
SELECT doc_id, size, source_size, target,
    size * CAST(certain + CASE WHEN {drawn} THEN 1 ELSE 0 END AS BIGINT) AS taken
FROM q {joins}
"""


MIX_SQL = _mix_sql()


@query("op4_mixing", MIX_SQL)
def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that the mix takes of every document."""
    return mix(table(spark, sf_dir, "documents")).select(
        "doc_id", "size", "source_size", "target", "taken"
    )


def _license_sql() -> str:
    def listed(values: list[str]) -> str:
        return "[" + ", ".join(f"'{v}'" for v in values) + "]"

    templates = ", ".join(
        f"('{name}', {listed(template_bigrams(text))})" for name, text in TEMPLATES.items()
    )
    return rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
p AS (
    SELECT rid, unnest(list_distinct(list_concat(
        string_split(t, chr(10)),
        regexp_split_to_array(t, '\n[\x20\x09\r]*\n'), [t]))) AS part
    FROM d
),
w AS (
    SELECT rid, part, list_filter(string_split(regexp_replace(
        lower(part), '[^\pL\pN]+', ' ', 'g'), ' '), lambda x: x <> '') AS ws
    FROM p
),
b AS (
    SELECT rid, part,
        list_distinct(list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1])) AS own
    FROM w
),
k(license, other) AS (VALUES {templates}),
m AS (
    SELECT rid, license, 2.0 * len(list_intersect(own, other)) / (len(own) + len(other)) AS dice
    FROM b JOIN k ON len(own) BETWEEN len(other) * {MIN_DICE / (2 - MIN_DICE)} - 1
        AND len(other) * {(2 - MIN_DICE) / MIN_DICE} + 1
),
g AS (SELECT * FROM m WHERE dice >= {MIN_DICE}),
x AS (
    SELECT rid, count(*) AS n, arg_min(license, (-dice, license)) AS license, max(dice) AS dice
    FROM g GROUP BY rid
)
SELECT doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_matches, license, dice AS license_dice
FROM d LEFT JOIN x ON x.rid = d.rid
"""


@query("op7_license_scan", _license_sql())
def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Matches and best licence of every document."""
    return scan_licenses(table(spark, sf_dir, "documents")).select(
        "doc_id",
        F.size("license_matches").cast("long").alias("n_matches"),
        "license",
        "license_dice",
    )
