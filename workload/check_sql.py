"""Parts of the checking SQL: column metrics and the rules over them, written for DuckDB."""

from __future__ import annotations

Columns = list[tuple[str, str]]

PHYSICAL = {"integer": "bigint", "float": "double", "string": "string", "temporal": "timestamp_ntz",
            "boolean": "boolean"}
# The name patterns of the rules, written as DuckDB reads them.
KEY_RE = "(^|_)(id|key|uuid|guid|pk|sk|code)(_|$)"
ENTITY_RE = (
    "^(pid|uid|sku|upc|ean|uuid|guid)$|(^|_)(player|user|entity|customer|account|member|product|"
    "vendor|tenant)_(id|key|code|no)(_|$)"
)
DATE_RE = "(date|time|timestamp|ts|dt|created|updated)"
PERIOD_RE = "(year|season|period|quarter|month|week|day)"


def null_counts(source: str, columns: Columns) -> str:
    parts = [
        f"""SELECT {i} AS ordinal, '{c}' AS column_name, count(*) AS row_count,
        count(*) - count("{c}") AS null_count, count("{c}") AS non_null_count,
        round((count(*) - count("{c}")) * 100.0 / count(*), 4)::DOUBLE AS null_pct FROM src"""
        for i, (c, _) in enumerate(columns)
    ]
    return f"WITH src AS ({source}) " + " UNION ALL ".join(parts)


def metrics_cte(datasets: dict[str, tuple[str, Columns]]) -> str:
    """CTE ``m``: one row per dataset and column with semantic type and flags."""
    sources, raw = [], []
    for n, (dataset, (source, columns)) in enumerate(datasets.items()):
        sources.append(f"src{n} AS ({source})")
        for i, (c, kind) in enumerate(columns):
            q = f'"{c}"'
            num = kind in ("integer", "float")
            low = f"min({q})::DOUBLE" if num else "NULL::DOUBLE"
            high = f"max({q})::DOUBLE" if num else "NULL::DOUBLE"
            std = f"stddev_samp({q}::DOUBLE)" if num else "NULL::DOUBLE"
            text = kind == "string"
            token = f"lower(trim({q}))"
            words = "('true','false','t','f','yes','no','1','0')"
            booleans = (
                f"coalesce(bool_and({token} IN {words}), true) AND count(DISTINCT {token}) <= 2"
                if text else "false"
            )
            digits = f"count(*) FILTER (regexp_full_match(trim({q}), '[0-9]+'))" if text else "0"
            raw.append(
                f"""SELECT '{dataset}' AS dataset, {i} AS ordinal, '{c}' AS column_name,
                '{kind}' AS kind, count(*) AS row_count, count(*) - count({q}) AS null_count,
                count({q}) AS non_null_count,
                round((count(*) - count({q})) * 100.0 / count(*), 4)::DOUBLE AS null_pct,
                count(DISTINCT {q}) + (count(*) > count({q}))::INT AS unique_count,
                {low} AS min_num, {high} AS max_num, {std} AS std, {booleans} AS booleans,
                {digits} AS digit_rows FROM src{n}"""
            )
    return (
        "WITH " + ", ".join(sources) + ", raw AS (" + " UNION ALL ".join(raw) + ")"
        r""", named AS (SELECT *, lower(regexp_replace(replace(trim(column_name), ' ', '_'),
          '([a-z0-9])([A-Z])', '\1_\2', 'g')) AS snake FROM raw)"""
        f""", strong AS (SELECT *, CASE WHEN regexp_matches(snake, '{KEY_RE}') THEN 3
          WHEN regexp_matches(snake, '{ENTITY_RE}') THEN 2 ELSE 0 END AS s,
          regexp_matches(lower(column_name), '{PERIOD_RE}') AS period_name FROM named)
        , typed AS (SELECT *, CASE WHEN s > 0 THEN 'id_like'
          WHEN kind = 'integer' AND unique_count = row_count THEN 'id_like'
          WHEN kind IN ('integer', 'float') THEN 'numeric' WHEN kind = 'boolean' THEN 'boolean_like'
          WHEN kind = 'temporal' THEN 'datetime'
          WHEN regexp_matches(snake, '{DATE_RE}') THEN 'datetime'
          WHEN booleans THEN 'boolean_like'
          WHEN unique_count < 0.5 * row_count THEN 'categorical' ELSE 'text' END AS semantic_type
          FROM strong)
        , m AS (SELECT *, null_pct > 30 AS high_missingness,
          null_count * 100.0 / row_count > 5 AND semantic_type = 'id_like' AS id_with_nulls,
          unique_count = 1 AS constant_column,
          semantic_type = 'numeric' OR kind IN ('integer', 'float') AS as_number FROM typed)"""
    )


# CTE ``t``: time axes, from ``m``.
TEMPORAL = """, t AS (SELECT dataset, ordinal, column_name,
  CASE WHEN continuous THEN 'continuous_datetime' ELSE 'discrete_period' END AS temporal_kind,
  CASE WHEN continuous OR period_name THEN 'high' ELSE 'medium' END AS confidence
  FROM (SELECT *, NOT as_number AND semantic_type NOT IN ('categorical', 'boolean_like')
    AND (semantic_type = 'datetime' OR kind = 'temporal') AS continuous,
    CASE WHEN kind = 'integer' THEN CASE WHEN non_null_count = 0 THEN period_name
      ELSE (min_num >= 1900 AND max_num <= 2100) OR (period_name AND
        unique_count - (null_count > 0)::INT <= greatest(24, floor(row_count * 0.1))) END
    WHEN kind = 'string' THEN period_name
      AND (non_null_count = 0 OR digit_rows >= 0.8 * non_null_count)
    ELSE false END AS discrete FROM m) WHERE continuous OR discrete)"""

# CTE ``e``: entity columns, from ``m``.
ENTITIES = """, e AS (SELECT dataset, ordinal, column_name, confidence,
  CAST(row_number() OVER (PARTITION BY dataset ORDER BY confidence = 'high' DESC, column_name)
    AS INTEGER) AS rank
  FROM (SELECT *, CASE WHEN null_pct <= CASE WHEN NOT seed AND s >= 3 THEN 2 ELSE 1 END
      THEN 'high' ELSE 'medium' END AS confidence
    FROM (SELECT *, semantic_type = 'id_like' AND NOT as_number AND kind <> 'temporal' AS seed,
      null_pct <= 10 AND s >= 2 AND CASE WHEN semantic_type IN ('categorical', 'text')
        THEN s >= 3 AND unique_count >= 25 WHEN semantic_type = 'numeric' THEN s >= 3
        ELSE semantic_type = 'id_like' END AS merged FROM m) WHERE seed OR merged))"""

FLAGS = """concat_ws('+', CASE WHEN high_missingness THEN 'high_missingness' END,
  CASE WHEN id_with_nulls THEN 'id_with_nulls' END,
  CASE WHEN constant_column THEN 'constant_column' END)"""

# CTE ``issues``: all quality issues, from ``m``.
ISSUES = """, mass AS (SELECT dataset, sum(null_count) / sum(row_count) AS share,
    string_agg(CASE WHEN null_pct > 15 THEN column_name END, '+' ORDER BY ordinal) AS cols
    FROM m GROUP BY dataset)
  , family AS (SELECT dataset, avg((starts_with(lower(column_name), 'gk_') AND null_pct >= 60)::INT)
    AS share FROM m GROUP BY dataset)
  , issues AS (
    SELECT dataset, 'missing_mass' AS issue, 'warning' AS severity, cols AS affected,
      least(25.0, share * 40)::DOUBLE AS score_impact, -1 AS ordinal FROM mass WHERE share > 0.15
    UNION ALL SELECT dataset, 'duplicate_key', 'critical', column_name,
      least(35.0, (1 - unique_count / row_count) * 100 / 2), ordinal FROM m
      WHERE semantic_type = 'id_like' AND unique_count < 0.99 * row_count
    UNION ALL SELECT dataset, 'high_null', CASE WHEN quiet THEN 'info' ELSE 'warning' END,
      column_name, CASE WHEN quiet THEN least(4.0, null_pct / 10) ELSE least(15.0, null_pct / 3) END,
      ordinal FROM (SELECT m.*, starts_with(lower(column_name), 'gk_') AND f.share >= 0.08 AS quiet
        FROM m JOIN family f ON m.dataset = f.dataset WHERE null_pct > 25)
    UNION ALL SELECT dataset, 'constant', 'info', column_name, 2.0, ordinal FROM m
      WHERE constant_column
    UNION ALL SELECT dataset, 'high_cardinality', 'info', column_name, 3.0, ordinal FROM m
      WHERE semantic_type = 'categorical' AND unique_count > 200)"""


def tuple_counts(source: str, keys: list[list[str]]) -> str:
    """CTE ``c``: distinct tuples and rows of each set of columns, nulls as values."""
    parts = []
    for i, key in enumerate(keys):
        names = ", ".join(f'"{n}"' for n in key)
        parts.append(
            f"""SELECT {i} AS position, '{" + ".join(key)}' AS columns, {len(key)} AS size,
            (SELECT count(*) FROM (SELECT DISTINCT {names} FROM src)) AS distinct_count,
            (SELECT count(*) FROM src) AS row_count"""
        )
    return f"WITH src AS ({source}), c AS (" + " UNION ALL ".join(parts) + ")"


# From CTE ``c``: candidates of at least medium confidence, ranked; triples only if nothing is high.
RANKED_KEYS = """, k AS (SELECT *, distinct_count / row_count AS ratio FROM c)
  , kept AS (SELECT * FROM k WHERE ratio >= 0.98 AND (size < 3 OR NOT EXISTS
    (SELECT 1 FROM k WHERE size < 3 AND ratio >= 0.999)))
  , ranked AS (SELECT *, round(ratio, 6) AS uniqueness_ratio,
    CASE WHEN ratio >= 0.999 THEN 'high' ELSE 'medium' END AS confidence,
    CAST(row_number() OVER (ORDER BY ratio >= 0.999 DESC, round(ratio, 6) DESC, size, position)
      AS INTEGER) AS rank FROM kept)"""
