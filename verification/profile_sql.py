"""SQL that computes a whole column profile, column by column, for comparison."""

from __future__ import annotations

from verification.datasets import C, D, N, Dataset

QUANTILES = {"p05": 0.05, "p10": 0.1, "q1": 0.25, "median": 0.5, "q3": 0.75, "p90": 0.9, "p95": 0.95}

METRICS = [
    "total", "missing", "missing_rate", "mean", "median", "mode", "std", "variance", "cv_pct",
    "min", "max", "range", "q1", "q3", "iqr", "p05", "p10", "p90", "p95", "skewness", "kurtosis",
    "is_normal_like", "outliers_iqr", "outliers_z", "outlier_ratio", "monotonic",
    "monotonic_inc", "monotonic_dec", "numeric_entropy", "variance_score", "zero_count",
    "negative_count", "n_valid", "n_unique_vals", "is_discrete", "unique_count",
    "cardinality_ratio", "dominant_rate", "categorical_entropy", "normalised_entropy",
    "balance_score", "gini_impurity", "range_days", "unique_dates", "median_gap_days",
    "regularity_pct", "avg_length", "median_length", "max_length", "min_length", "blank_count",
    "blank_rate",
]
LABELS = [
    "type", "skew_type", "distribution", "dominant_value", "min_date", "max_date", "inferred_freq",
    "top_values",
]


def _numeric(relation: str, column: str, position: int, order: tuple[str, ...]) -> str:
    quantiles = ", ".join(f"quantile_cont(v, {p}) AS {name}" for name, p in QUANTILES.items())
    keys = ", ".join(f"k{i}" for i, _ in enumerate(order))
    ordered = ", ".join(f"{key} AS k{i}" for i, key in enumerate(order))
    return f"""(
WITH src AS (SELECT CAST({column} AS DOUBLE) AS v, {ordered} FROM {relation}),
  present AS (SELECT * FROM src WHERE v IS NOT NULL),
  f AS (SELECT v, count(*) AS n FROM present GROUP BY v),
  s AS (SELECT (SELECT count(*) FROM src) AS total, count(v) AS n, avg(v) AS mean,
      stddev_samp(v) AS std, min(v) AS lo, max(v) AS hi, kurtosis_pop(v) AS kurt, {quantiles},
      count_if(v = 0) AS zeros, count_if(v < 0) AS negatives, bool_and(v = floor(v)) AS whole,
      (SELECT count(*) FROM f) AS uniques FROM present),
  m AS (SELECT avg(pow(v - mean, 3)) / nullif(pow(avg(pow(v - mean, 2)), 1.5), 0) AS skew,
      count_if(v < q1 - 1.5 * (q3 - q1) OR v > q3 + 1.5 * (q3 - q1)) AS outliers_iqr,
      count_if(abs(v - mean) / nullif(std, 0) > 3) AS outliers_z FROM present, s),
  d AS (SELECT v - lag(v) OVER (ORDER BY {keys}) AS step FROM present),
  o AS (SELECT coalesce(bool_and(step >= 0), true) AS rising,
      coalesce(bool_and(step <= 0), true) AS falling FROM d),
  r AS (SELECT CASE WHEN lo = hi THEN lo - 0.5 ELSE lo END AS a,
      CASE WHEN lo = hi THEN hi + 0.5 ELSE hi END AS z, least(20, n) AS k FROM s),
  edges AS (SELECT b, k, a + b * ((z - a) / k) AS lo,
      CASE WHEN b = k - 1 THEN z ELSE a + (b + 1) * ((z - a) / k) END AS hi
      FROM r, (SELECT unnest(generate_series(0, 19)) AS b) WHERE b < k)
SELECT '{column}' AS "column", {position} AS position, 'numeric' AS type, total,
  total - n AS missing, round((total - n) * 100.0 / total, 2) AS missing_rate,
  round(mean, 4) AS mean, round(median, 4) AS median,
  round((SELECT v FROM f WHERE n > 1 ORDER BY n DESC, v LIMIT 1), 4) AS mode,
  round(std, 4) AS std, round(std * std, 4) AS variance,
  round(std / abs(nullif(mean, 0)) * 100, 4) AS cv_pct,
  round(lo, 4) AS min, round(hi, 4) AS max, round(hi - lo, 4) AS range,
  round(q1, 4) AS q1, round(q3, 4) AS q3, round(q3 - q1, 4) AS iqr, round(p05, 4) AS p05,
  round(p10, 4) AS p10, round(p90, 4) AS p90, round(p95, 4) AS p95,
  round(skew, 4) AS skewness, round(kurt, 4) AS kurtosis,
  CASE WHEN skew > 1 THEN 'right_skewed' WHEN skew < -1 THEN 'left_skewed'
       ELSE 'symmetric' END AS skew_type,
  CASE WHEN abs(skew) < 0.5 AND abs(kurt) < 1 THEN 'normal_like'
       WHEN abs(skew) < 1 THEN 'mild_skew' ELSE 'highly_skewed' END AS distribution,
  coalesce(abs(skew) < 0.5 AND abs(kurt) < 1, false) AS is_normal_like,
  outliers_iqr, outliers_z, round(outliers_iqr * 100.0 / n, 2) AS outlier_ratio,
  rising OR falling AS monotonic, rising AS monotonic_inc, falling AS monotonic_dec,
  (SELECT round(-sum(c * 1.0 / t * log2(c * 1.0 / t)), 4) FROM
    (SELECT c, sum(c) OVER () AS t FROM
      (SELECT e.b, count(*) AS c FROM edges e JOIN present p
         ON p.v >= e.lo AND (p.v < e.hi OR (e.b = e.k - 1 AND p.v <= e.hi)) GROUP BY e.b))
  ) AS numeric_entropy,
  round(pow(std / abs(nullif(mean, 0)), 2), 4) AS variance_score,
  zeros AS zero_count, negatives AS negative_count, n AS n_valid, uniques AS n_unique_vals,
  whole AND (uniques <= 100 OR uniques * 1.0 / n < 0.10) AS is_discrete
FROM s, m, o)"""


def _categorical(relation: str, column: str, position: int) -> str:
    return f"""(
WITH src AS (SELECT CAST({column} AS VARCHAR) AS v FROM {relation}),
  f AS (SELECT v, count(*) AS c FROM src WHERE v IS NOT NULL GROUP BY v),
  r AS (SELECT v, c, c * 1.0 / sum(c) OVER () AS p,
      row_number() OVER (ORDER BY c DESC, v) AS i FROM f)
SELECT '{column}' AS "column", {position} AS position, 'categorical' AS type,
  (SELECT count(*) FROM src) AS total, (SELECT count(*) - count(v) FROM src) AS missing,
  (SELECT round((count(*) - count(v)) * 100.0 / count(*), 2) FROM src) AS missing_rate,
  CAST(sum(c) AS BIGINT) AS n_valid, count(*) AS unique_count,
  round(count(*) / CAST(sum(c) AS DOUBLE), 4) AS cardinality_ratio,
  max(CASE WHEN i = 1 THEN v END) AS dominant_value, round(max(p) * 100, 2) AS dominant_rate,
  round(-sum(p * log2(p + 1e-12)), 4) AS categorical_entropy,
  round(-sum(p * log2(p + 1e-12)) / CASE WHEN count(*) > 1 THEN log2(count(*)) ELSE 1 END, 4)
    AS normalised_entropy,
  round(1 - max(p), 4) AS balance_score, round(1 - sum(p * p), 4) AS gini_impurity,
  string_agg(CASE WHEN i <= 10 THEN v END, '|' ORDER BY i) AS top_values
FROM r)"""


def _date(relation: str, column: str, position: int) -> str:
    return f"""(
WITH src AS (SELECT CAST({column} AS TIMESTAMP) AS v FROM {relation}),
  g AS (SELECT date_sub('day', lag(v) OVER (ORDER BY v), v) AS gap FROM src WHERE v IS NOT NULL),
  m AS (SELECT quantile_cont(gap, 0.5) AS med FROM g),
  q AS (SELECT avg(CASE WHEN abs(gap - med) / nullif(med, 0) < 0.5 THEN 1.0 ELSE 0.0 END) * 100
      AS share FROM g, m WHERE gap IS NOT NULL)
SELECT '{column}' AS "column", {position} AS position, 'date' AS type, count(*) AS total,
  count(*) - count(v) AS missing, round((count(*) - count(v)) * 100.0 / count(*), 2) AS missing_rate,
  count(v) AS n_valid, strftime(min(v), '%Y-%m-%d') AS min_date,
  strftime(max(v), '%Y-%m-%d') AS max_date, date_sub('day', min(v), max(v)) AS range_days,
  count(DISTINCT v) AS unique_dates, (SELECT round(med, 4) FROM m) AS median_gap_days,
  (SELECT CASE WHEN med <= 1 THEN 'daily' WHEN med <= 8 THEN 'weekly' WHEN med <= 35 THEN 'monthly'
     WHEN med <= 100 THEN 'quarterly' WHEN med IS NOT NULL THEN 'yearly' END FROM m) AS inferred_freq,
  (SELECT CASE WHEN med > 0 THEN round(share, 1) END FROM m, q) AS regularity_pct
FROM src)"""


def _text(relation: str, column: str, position: int) -> str:
    return f"""(
SELECT '{column}' AS "column", {position} AS position, 'text' AS type, count(*) AS total,
  count(*) - count(v) AS missing, round((count(*) - count(v)) * 100.0 / count(*), 2) AS missing_rate,
  count(v) AS n_valid, count(DISTINCT v) AS unique_count, round(avg(length(v)), 4) AS avg_length,
  round(quantile_cont(length(v), 0.5), 4) AS median_length, max(length(v)) AS max_length,
  min(length(v)) AS min_length, count_if(regexp_full_match(v, '\\s*')) AS blank_count,
  round(count_if(regexp_full_match(v, '\\s*')) * 100.0 / count(v), 4) AS blank_rate
FROM (SELECT {column} AS v FROM {relation}))"""


def profile_sql(dataset: Dataset, columns: list[str] | None = None) -> str:
    """A query with one row per column and every metric; unused ones are NULL."""
    parts = []
    for name in columns or list(dataset.columns):
        kind, position = dataset.columns[name], dataset.position(name)
        if kind == N:
            parts.append(_numeric(dataset.relation, name, position, dataset.order))
        else:
            make = {C: _categorical, D: _date}.get(kind, _text)
            parts.append(make(dataset.relation, name, position))
    # a row of absent values gives every metric a column
    doubles = ", ".join(f"CAST(NULL AS DOUBLE) AS {m}" for m in METRICS if m not in BOOLEANS)
    flags = ", ".join(f"CAST(NULL AS BOOLEAN) AS {m}" for m in BOOLEANS)
    labels = ", ".join(f"CAST(NULL AS VARCHAR) AS {m}" for m in LABELS)
    empty = f'(SELECT NULL AS "column", NULL AS position, {doubles}, {flags}, {labels})'
    union = " UNION ALL BY NAME ".join([empty, *parts])
    return f'SELECT * FROM ({union}) WHERE "column" IS NOT NULL'


BOOLEANS = ["is_normal_like", "monotonic", "monotonic_inc", "monotonic_dec", "is_discrete"]


def metrics_sql(dataset: Dataset, metrics: list[str], columns: list[str] | None = None) -> str:
    """(column, metric, value) of the non-null metrics."""
    casts = ", ".join(f"CAST({m} AS DOUBLE) + 0.0 AS {m}" for m in metrics)
    names = ", ".join(metrics)
    return (
        f'SELECT "column", metric, value FROM (UNPIVOT (SELECT "column", {casts}'
        f" FROM ({profile_sql(dataset, columns)})) ON {names} INTO NAME metric VALUE value)"
    )


def labels_sql(dataset: Dataset, columns: list[str] | None = None) -> str:
    casts = ", ".join(f"CAST({m} AS VARCHAR) AS {m}" for m in LABELS)
    names = ", ".join(LABELS)
    return (
        f'SELECT "column", metric, value FROM (UNPIVOT (SELECT "column", {casts}'
        f" FROM ({profile_sql(dataset, columns)})) ON {names} INTO NAME metric VALUE value)"
    )
