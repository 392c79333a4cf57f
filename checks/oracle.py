"""DuckDB SQL for the driver queries: the same results, written independently.

Common table expressions build on one another; a query takes the ones it needs.
"""

from __future__ import annotations

from checks.fixed_score import COEFFICIENTS, INTERCEPT, MODEL_ID
from riskweave.constants import (
    BOOLEAN_FEATURES, ERROR_MESSAGES, EXPLANATION_WARNING, FEATURE_LABELS, FEATURES,
    INSUFFICIENT_WARNING, NUMERIC_FEATURES, TRIAGE_WARNING, WHITESPACE,
)


def _q(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def _log1p(x: str) -> str:
    # ln(1 + x) alone loses the digits of a small x; this corrects for what 1 + x drops
    return f"(CASE WHEN 1 + {x} = 1 THEN {x} ELSE {x} * ln(1 + {x}) / ((1 + {x}) - 1) END)"


_SPACES = "concat(" + ", ".join(f"chr({ord(c)})" for c in WHITESPACE) + ")"
_USABLE = " + ".join(f"({f} IS NOT NULL)::INT" for f in FEATURES)
_FEATURE_LIST = ", ".join(FEATURES)

CTES: dict[str, str] = {}

CTES["crm"] = """
SELECT account_id, source_dataset, source_order, row_order, label, feature_completeness,
       CASE WHEN full_profile THEN account_age_days END AS account_age_days,
       CASE WHEN full_profile THEN followers_count END AS followers_count,
       CASE WHEN full_profile THEN following_count END AS following_count,
       CASE WHEN full_profile THEN tweet_count END AS tweet_count,
       CASE WHEN full_profile THEN username END AS username,
       CASE WHEN full_profile THEN description END AS description,
       location,
       CASE WHEN full_profile THEN verified END AS verified,
       CASE WHEN full_profile THEN default_profile_image END AS default_profile_image
FROM (
  SELECT c.c_custkey::VARCHAR AS account_id, 'crm' AS source_dataset, 0 AS source_order,
         c.c_custkey AS row_order,
         CASE WHEN c.c_acctbal < 3000 AND c.c_nationkey % 2 = 0 THEN '1' ELSE '0' END
           AS label,
         CASE WHEN c.c_custkey % 4 = 0 THEN 0.75::DOUBLE ELSE 1.0::DOUBLE END
           AS feature_completeness,
         date_diff('day', a.first_order::DATE, DATE '2001-08-02')::INT AS account_age_days,
         floor(c.c_acctbal)::BIGINT AS followers_count,
         coalesce(a.order_count, 0)::BIGINT AS following_count,
         coalesce(a.item_count, 0)::BIGINT AS tweet_count,
         CASE WHEN c.c_custkey % 9 = 0 THEN NULL ELSE c.c_name END AS username,
         CASE WHEN c.c_custkey % 6 = 0 THEN '  ' ELSE ' ' || c.c_mktsegment || ' ' END
           AS description,
         CASE WHEN c.c_custkey % 5 = 0 THEN 'Unknown' ELSE n.n_name END AS location,
         CASE WHEN c.c_nationkey % 2 = 0 THEN 'Yes' WHEN c.c_custkey % 8 = 1 THEN 'maybe'
              ELSE 'f' END AS verified,
         CASE WHEN c.c_custkey % 7 = 0 THEN 'TRUE' ELSE '0' END AS default_profile_image,
         c.c_custkey % 50 <> 7 AS full_profile
  FROM customer c
  LEFT JOIN nation n ON n.n_nationkey = c.c_nationkey
  LEFT JOIN (
    SELECT o.o_custkey, min(o.o_orderdate) AS first_order, count(*) AS order_count,
           sum(coalesce(i.items, 0)) AS item_count
    FROM orders o
    LEFT JOIN (SELECT l_orderkey, count(*) AS items FROM lineitem GROUP BY 1) i
      ON i.l_orderkey = o.o_orderkey
    GROUP BY 1
  ) a ON a.o_custkey = c.c_custkey
)
"""

CTES["ev"] = """
SELECT CASE user_id % 10
         WHEN 3 THEN 'bad-' || user_id::VARCHAR
         WHEN 4 THEN user_id::VARCHAR || '.0'
         WHEN 5 THEN ' ' || user_id::VARCHAR || ' '
         WHEN 6 THEN user_id::VARCHAR || 'E+0'
         WHEN 7 THEN '00' || user_id::VARCHAR
         ELSE user_id::VARCHAR END AS account_id,
       'events' AS source_dataset, 1 AS source_order, user_id AS row_order,
       CASE WHEN user_id % 20 = 9 THEN 'x'
            WHEN count(*) FILTER (event_type = 'error') * 5 > count(*) THEN '1'
            ELSE '0' END AS label,
       CASE WHEN user_id % 3 = 0 THEN NULL ELSE 1.0::DOUBLE END AS feature_completeness,
       (date_diff('day', min(ts)::DATE, max(ts)::DATE) + 1)::INT AS account_age_days,
       count(*)::BIGINT AS tweet_count
FROM events GROUP BY user_id
"""

CTES["bronze"] = "SELECT * FROM crm UNION ALL BY NAME SELECT * FROM ev"

CTES["known"] = """
SELECT * EXCLUDE (account_id, label, d),
       account_id AS raw_id,
       CASE WHEN d >= 0 AND d = floor(d) THEN d::HUGEINT::VARCHAR END AS account_id,
       CASE WHEN try_cast(trim(label) AS DOUBLE) IN (0, 1)
            THEN try_cast(trim(label) AS DOUBLE)::INT END AS label
FROM (SELECT *, try_cast(trim(account_id) AS DECIMAL(38, 18)) AS d FROM bronze)
"""

CTES["valid"] = """
SELECT * EXCLUDE (raw_id) FROM known
WHERE regexp_full_match(account_id, '[0-9]{1,19}') AND label IS NOT NULL
"""

CTES["conflicts"] = """
SELECT account_id, count(DISTINCT label) AS distinct_labels, count(*) AS row_count
FROM valid GROUP BY account_id HAVING count(DISTINCT label) > 1
"""

CTES["clean"] = """
SELECT * EXCLUDE (source_order, row_order) FROM valid
WHERE account_id NOT IN (SELECT account_id FROM conflicts)
QUALIFY row_number() OVER (
  PARTITION BY account_id
  ORDER BY coalesce(feature_completeness, -1) DESC, source_order, row_order) = 1
"""

# hold out ceil(0.3 n), half of it (rounded up) for test, by largest remainder per class
CTES["sizes"] = """
SELECT label, count(*) AS n, (SELECT count(*) FROM clean) AS total,
       ((SELECT count(*) FROM clean) * 3 + 9) // 10 AS hold
FROM clean GROUP BY label
"""
CTES["held"] = """
SELECT label, n, hold,
       (hold * n) // total + CASE WHEN row_number() OVER (
           ORDER BY (hold * n) % total DESC, label)
         <= hold - sum((hold * n) // total) OVER () THEN 1 ELSE 0 END AS held
FROM sizes
"""
CTES["quota"] = """
SELECT label, n, held,
       (t * held) // hold + CASE WHEN row_number() OVER (
           ORDER BY (t * held) % hold DESC, label)
         <= t - sum((t * held) // hold) OVER () THEN 1 ELSE 0 END AS test
FROM (SELECT *, (hold + 1) // 2 AS t FROM held)
"""
CTES["split_rows"] = """
SELECT c.*, CASE WHEN c.place <= q.test THEN 'test' WHEN c.place <= q.held
                 THEN 'validation' ELSE 'train' END AS split
FROM (SELECT *, row_number() OVER (
        PARTITION BY label ORDER BY md5('42:' || account_id), account_id) AS place
      FROM clean) c
JOIN quota q USING (label)
"""


def _features(source: str, extra: str) -> str:
    def amount(name: str, condition: str = ">= 0") -> str:
        return f"CASE WHEN {name}::DOUBLE {condition} THEN {name}::DOUBLE END"

    def known(name: str) -> str:
        return (
            f"CASE WHEN lower(trim({name})) IN ('true','t','yes','y','1') THEN 1.0::DOUBLE "
            f"WHEN lower(trim({name})) IN ('false','f','no','n','0') THEN 0.0::DOUBLE END"
        )

    def said(name: str, more: str = "") -> str:
        return f"(CASE WHEN trim({name}) <> '' {more} THEN 1.0 ELSE 0.0 END)::DOUBLE"

    return f"""
SELECT {extra}, age AS account_age_days, followers AS followers_count,
       following AS following_count,
       (followers + 1) / (following + 1) AS follower_following_ratio,
       tweets AS tweet_count, tweets / age AS posting_frequency,
       description_length, username_length,
       CASE WHEN image IS NULL THEN said / 3 ELSE (said + 1 - image) / 4 END
         AS profile_completeness,
       verified, image AS uses_default_profile_image,
       CASE WHEN description_length > 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END
         AS has_description
FROM (
  SELECT {extra},
         {amount("account_age_days", "> 0")} AS age,
         {amount("followers_count")} AS followers,
         {amount("following_count")} AS following,
         {amount("tweet_count")} AS tweets,
         length(trim(description))::DOUBLE AS description_length,
         length(trim(username))::DOUBLE AS username_length,
         {said("username")} + {said("description")}
           + {said("location", "AND lower(trim(location)) NOT IN ('unknown','none','n/a','na')")}
           AS said,
         {known("verified")} AS verified, {known("default_profile_image")} AS image
  FROM {source}
)
"""


CTES["feats"] = f"""
SELECT *, {_USABLE} AS usable
FROM ({_features("split_rows", "account_id, label, split")})
"""

CTES["prep"] = " UNION ALL ".join(
    f"""SELECT '{f}' AS feature, max(m) AS fill,
       avg({_log1p("coalesce(x, m)")}) AS mean,
       stddev_pop({_log1p("coalesce(x, m)")}) AS std
FROM (SELECT {f} AS x, (SELECT coalesce(median({f}), 0) FROM feats
                        WHERE split = 'train' AND usable >= 6) AS m
      FROM feats WHERE split = 'train' AND usable >= 6)"""
    for f in NUMERIC_FEATURES
) + " UNION ALL " + " UNION ALL ".join(
    f"""SELECT '{f}' AS feature,
       CASE WHEN count(*) FILTER ({f} = 1) > count(*) FILTER ({f} = 0)
            THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS fill, NULL AS mean, NULL AS std
FROM feats WHERE split = 'train' AND usable >= 6"""
    for f in BOOLEAN_FEATURES
)

# one row holding all parameters
CTES["par"] = "SELECT " + ", ".join(
    f"max({c}) FILTER (feature = '{f}') AS {f}_{c}"
    for f in FEATURES for c in ("fill", "mean", "std")
) + " FROM prep"


def _transform(source: str, extra: str) -> str:
    numeric = [
        f"({_log1p(f'coalesce(s.{f}, {f}_fill)')} - {f}_mean)"
        f" / (CASE WHEN {f}_std = 0 THEN 1 ELSE {f}_std END) AS {f}"
        for f in NUMERIC_FEATURES
    ]
    flags = [f"coalesce(s.{f}, {f}_fill) AS {f}" for f in BOOLEAN_FEATURES]
    return f"SELECT {extra}, {', '.join(numeric + flags)} FROM {source} s, par"


_MARGIN = f"{INTERCEPT}::DOUBLE + " + " + ".join(
    f"{f} * ({COEFFICIENTS[f]}::DOUBLE)" for f in FEATURES
)
_P = f"round(1 / (1 + exp(-({_MARGIN}))), 6)"

CTES["transformed"] = _transform("feats", "s.account_id, s.label, s.split, s.usable")
CTES["scored"] = f"SELECT *, {_P} AS probability FROM transformed"

# cut-offs every 0.05 in floating point: medium from 0.10 below 0.66; high below 0.91, from
# 0.40 or 0.10 above medium, whichever is larger
CTES["grid"] = """
SELECT medium, low + unnest(range(0, ceil((0.91::DOUBLE - low) / 0.05::DOUBLE)::BIGINT))
       * ((low + 0.05::DOUBLE) - low) AS high
FROM (SELECT medium, greatest(0.40::DOUBLE, medium + 0.10::DOUBLE) AS low
      FROM (SELECT 0.10::DOUBLE + unnest(range(0, 12))
              * ((0.10::DOUBLE + 0.05::DOUBLE) - 0.10::DOUBLE) AS medium))
"""
CTES["costs"] = """
SELECT g.medium, g.high, count(*) AS scored_rows,
       avg(CASE WHEN v.label = 1 AND v.probability < g.medium THEN 5.0
                WHEN v.label = 1 AND v.probability < g.high THEN 1.0
                WHEN v.label = 0 AND v.probability >= g.high THEN 1.0
                WHEN v.label = 0 AND v.probability >= g.medium THEN 0.25
                ELSE 0.0 END::DOUBLE) AS mean_cost,
       coalesce(count(*) FILTER (v.label = 1 AND v.probability >= g.medium)
                / nullif(count(*) FILTER (v.label = 1), 0), 0)::DOUBLE AS recall
FROM grid g,
     (SELECT * FROM scored WHERE split = 'validation' AND usable >= 6) v
GROUP BY g.medium, g.high
"""
CTES["cuts"] = """
SELECT round(medium, 4) AS medium, round(high, 4) AS high,
       round(mean_cost, 6) AS validation_mean_cost
FROM (SELECT * FROM costs ORDER BY mean_cost, recall DESC, costs.medium, costs.high LIMIT 1)
"""

# every account that requests can refer to, with features, score and decision
CTES["account_feats"] = f"""
SELECT *, {_USABLE} AS usable FROM ({_features("crm", "account_id")})
"""
CTES["account_scores"] = (
    f"SELECT *, {_P} AS probability FROM ("
    + _transform("account_feats", "s.account_id, s.usable") + ")"
)
CTES["decided"] = f"""
SELECT *,
       CASE WHEN usable < 6 THEN NULL WHEN level = 'low' THEN 'monitor'
            WHEN risk_band = 'low' THEN 'no_concern'
            WHEN risk_band = 'medium' THEN 'monitor' ELSE 'prioritise' END
         AS recommendation,
       CASE WHEN usable < 6 THEN {_q(INSUFFICIENT_WARNING)} ELSE {_q(TRIAGE_WARNING)} END
         AS warning
FROM (
  SELECT account_id, usable, round(usable / 12, 3) AS data_completeness,
         CASE WHEN usable < 6 THEN 'insufficient_data' ELSE 'completed' END AS status,
         CASE WHEN usable >= 6 THEN probability END AS risk_probability,
         CASE WHEN usable < 6 THEN NULL WHEN probability < medium THEN 'low'
              WHEN probability < high THEN 'medium' ELSE 'high' END AS risk_band,
         CASE WHEN usable < 6 THEN NULL WHEN usable < 9 THEN 'low'
              WHEN least(abs(probability - medium), abs(probability - high)) < 0.08::DOUBLE
              THEN 'low' ELSE 'high' END AS level,
         CASE WHEN usable < 6 THEN NULL WHEN usable < 9 THEN 'limited_feature_coverage'
              WHEN least(abs(probability - medium), abs(probability - high)) < 0.08::DOUBLE
              THEN 'close_to_decision_thresholds' ELSE 'clear_of_decision_thresholds' END
           AS basis
  FROM account_scores, cuts
)
"""
CTES["impacts"] = " UNION ALL ".join(
    f"SELECT account_id, {i} AS i, '{f}' AS feature, {_q(FEATURE_LABELS[f])} AS wording, "
    f"{f} * ({COEFFICIENTS[f]}::DOUBLE) AS v FROM account_scores WHERE usable >= 6"
    for i, f in enumerate(FEATURES)
)
CTES["factors"] = """
SELECT account_id, string_agg(
         feature || ':' || CASE WHEN v >= 0 THEN 'increases_risk' ELSE 'decreases_risk' END
         || ':' || wording || CASE WHEN v >= 0 THEN ' increased' ELSE ' reduced' END
         || ' the estimated risk.', '|' ORDER BY place) AS top_factors
FROM (SELECT *, row_number() OVER (
        PARTITION BY account_id ORDER BY abs(v) DESC, i DESC) AS place FROM impacts)
WHERE place <= 3 GROUP BY account_id
"""
CTES["asked"] = """
SELECT o_orderkey::VARCHAR AS request_id,
       CASE WHEN o_orderkey % 17 = 0 THEN 'twitter' ELSE 'x' END AS platform,
       CASE WHEN o_orderkey % 13 = 0 THEN 'abc'
            WHEN o_orderkey % 11 = 0 THEN (o_custkey + 1000000000)::VARCHAR
            ELSE o_custkey::VARCHAR END AS account_id
FROM orders
"""


CTES["bodies"] = """
SELECT a.request_id, a.platform,
       CASE WHEN o.o_orderkey % 19 = 0 THEN NULL ELSE a.account_id END AS account_id,
       CASE WHEN a.platform <> 'x' THEN 'Invalid value for platform.'
            WHEN o.o_orderkey % 19 = 0 OR NOT regexp_full_match(a.account_id, '[0-9]{1,19}')
            THEN 'Invalid value for account_id.'
            WHEN o.o_orderkey % 23 = 0 THEN 'Invalid value for note.' END AS problem
FROM asked a JOIN orders o ON a.request_id = o.o_orderkey::VARCHAR
"""


def _message(code: str) -> str:
    return _q(ERROR_MESSAGES[code])


CTES["answered"] = f"""
SELECT q.request_id,
       CASE WHEN code IS NULL
            THEN 'asmt_' || md5(q.request_id || '|{MODEL_ID}') END AS assessment_id,
       CASE WHEN code IS NULL THEN d.status END AS status,
       q.platform, q.account_id,
       CASE WHEN code IS NULL THEN 'dataset' END AS data_source,
       CASE WHEN code IS NULL THEN d.data_completeness END AS data_completeness,
       CASE WHEN code IS NULL THEN d.risk_probability END AS risk_probability,
       CASE WHEN code IS NULL THEN d.risk_band END AS risk_band,
       CASE WHEN code IS NULL THEN d.level END AS confidence_level,
       CASE WHEN code IS NULL THEN d.basis END AS confidence_basis,
       CASE WHEN code IS NULL THEN coalesce(f.top_factors, '') END AS top_factors,
       CASE WHEN code IS NULL THEN d.recommendation END AS recommendation,
       CASE WHEN code IS NULL THEN d.warning END AS warning,
       code AS error_code,
       CASE WHEN q.platform <> 'x' THEN 'Invalid value for platform.'
            WHEN code = 'invalid_request' THEN 'Invalid value for account_id.'
            WHEN code = 'account_not_found' THEN {_message("account_not_found")} END
         AS error_message
FROM (
  SELECT a.*, CASE WHEN platform <> 'x'
                     OR NOT regexp_full_match(a.account_id, '[0-9]{{1,19}}')
                   THEN 'invalid_request'
                   WHEN a.account_id NOT IN (SELECT account_id FROM decided)
                   THEN 'account_not_found' END AS code
  FROM asked a
) q
LEFT JOIN decided d ON d.account_id = q.account_id
LEFT JOIN factors f ON f.account_id = q.account_id
"""

_ARRIVAL = (
    "l_shipdate, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, "
    "l_discount, l_tax"
)
CTES["override_asked"] = f"""
SELECT 'asmt_' || md5(l_orderkey::VARCHAR || '|{MODEL_ID}') AS assessment_id,
       CASE l_returnflag WHEN 'A' THEN 'legitimate' WHEN 'N' THEN 'uncertain'
            WHEN 'R' THEN 'suspicious' END AS override_label,
       CASE WHEN l_partkey % 29 = 0 THEN 'Bad Code!'
            ELSE 'status_' || lower(l_linestatus) END AS reason_code,
       {_ARRIVAL}
FROM lineitem
"""
CTES["override_decided"] = f"""
SELECT * EXCLUDE (error_code),
       CASE WHEN error_code IS NULL THEN 'recorded' END AS outcome, error_code,
       CASE error_code WHEN 'invalid_request' THEN 'Invalid value for reason_code.'
            WHEN 'assessment_not_found' THEN {_message("assessment_not_found")}
            WHEN 'override_already_recorded' THEN {_message("override_already_recorded")}
       END AS error_message
FROM (
  SELECT * EXCLUDE (bad, place),
         CASE WHEN bad THEN 'invalid_request'
              WHEN assessment_id NOT IN (
                SELECT assessment_id FROM answered WHERE status = 'completed')
              THEN 'assessment_not_found'
              WHEN place > 1 THEN 'override_already_recorded' END AS error_code
  FROM (SELECT *, NOT regexp_full_match(reason_code, '[a-z0-9_]{{1,64}}') AS bad,
               row_number() OVER (PARTITION BY assessment_id,
                 regexp_full_match(reason_code, '[a-z0-9_]{{1,64}}')
                 ORDER BY {_ARRIVAL}) AS place
        FROM override_asked)
)
"""


def _with(select: str, last: str) -> str:
    """All CTEs up to ``last``, then the query."""
    names = list(CTES)
    used = names[: names.index(last) + 1]
    body = ",\n".join(f"{n} AS MATERIALIZED ({CTES[n]})" for n in used)
    return f"WITH {body}\n{select}"


_COUNTS = """
SELECT (SELECT count(*) FROM known)
         - (SELECT count(*) FROM valid) AS invalid_rows_removed,
       (SELECT count(*) FROM conflicts) AS conflicting_account_ids_removed,
       ((SELECT count(*) FROM valid) - (SELECT coalesce(sum(row_count), 0) FROM conflicts)
         - (SELECT count(*) FROM clean))::BIGINT AS duplicate_rows_removed,
       (SELECT count(*) FROM clean) AS clean_account_count"""

ORACLE: dict[str, str] = {
    "normalise_ids": _with("""
        SELECT source_order, row_order, raw_id, account_id, label,
               coalesce(regexp_full_match(account_id, '[0-9]{1,19}'), false) AS valid_id,
               account_id IS NOT NULL AND label IS NOT NULL AS valid_row
        FROM known""", "known"),
    "text_fields": f"""
        SELECT doc_id, md5(s) AS stripped_md5, length(s)::DOUBLE AS text_length,
               CASE WHEN s <> '' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS has_text,
               CASE WHEN trim(lang, {_SPACES}) <> '' AND lower(trim(lang, {_SPACES}))
                         NOT IN ('unknown','none','n/a','na')
                    THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS has_lang,
               md5(nullif(s, '')) AS optional_md5,
               CASE WHEN n_chars > 0 THEN n_chars::DOUBLE END AS n_chars_number,
               CASE doc_id % 3 WHEN 0 THEN 0.0::DOUBLE WHEN 1 THEN 1.0::DOUBLE END
                 AS doc_flag,
               CASE WHEN lang NOT IN ('', 'NA', 'null', 'nan', 'None') THEN lang END AS lang
        FROM (SELECT *, trim(text, {_SPACES}) AS s FROM documents)""",
    "line_break_ids": """
        SELECT c_custkey, c_custkey % 3 = 0 AS valid_id, c_custkey % 3 = 0 AS valid_code,
               c_custkey::VARCHAR AS normalised FROM customer""",
    "union_sources": _with("SELECT * FROM bronze", "bronze"),
    "clean_accounts": _with("SELECT * FROM clean", "clean"),
    "cleaning_summary": _with(_COUNTS, "clean"),
    "label_conflicts": _with("SELECT * FROM conflicts", "conflicts"),
    "repeated_ids": _with("""
        SELECT account_id, count(*) AS row_count FROM known
        GROUP BY 1 HAVING count(*) > 1""", "known"),
    "stratified_split": _with("SELECT account_id, label, split FROM split_rows",
                              "split_rows"),
    "split_counts": _with("""
        SELECT split, count(*) AS row_count, count(*) FILTER (label = 1) AS positive_count,
               count(*) FILTER (usable < 6) AS removed_count
        FROM feats GROUP BY split""", "feats"),
    "written_splits": _with(
        "SELECT account_id, label, split, source_dataset FROM split_rows", "split_rows"),
    "demo_listing": _with("""
        SELECT account_id, source_dataset, nullif(trim(username), '') AS username
        FROM (SELECT * FROM split_rows WHERE split = 'test'
              QUALIFY row_number() OVER (PARTITION BY label ORDER BY
                md5((42 + label)::VARCHAR || ':sample:' || account_id), account_id) <= 50)
        ORDER BY account_id LIMIT 20""", "split_rows"),
    "demo_accounts": _with("""
        SELECT * EXCLUDE (label, feature_completeness, split, place) FROM split_rows
        WHERE split = 'test'
        QUALIFY row_number() OVER (PARTITION BY label ORDER BY
          md5((42 + label)::VARCHAR || ':sample:' || account_id), account_id) <= 50""",
        "split_rows"),
    "account_features": _with(f"""
        SELECT account_id, label, {_FEATURE_LIST}, usable,
               round(usable / 12, 3) AS completeness FROM feats""", "feats"),
    "fallback_features": f"""
        SELECT *, {_USABLE} AS usable, round(({_USABLE}) / 12, 3) AS completeness FROM (
          SELECT account_id, account_age_days, followers_count, following_count,
                 coalesce((followers_count + 1) / (following_count + 1), given_ratio)
                   AS follower_following_ratio,
                 tweet_count, coalesce(tweet_count / account_age_days, given_rate)
                   AS posting_frequency,
                 description_length, coalesce(given_length, length(c_name))::DOUBLE
                   AS username_length,
                 1::DOUBLE / 3 AS profile_completeness, NULL::DOUBLE AS verified,
                 NULL::DOUBLE AS uses_default_profile_image,
                 CASE WHEN description_length > 0 THEN 1.0 ELSE 0.0 END::DOUBLE
                   AS has_description
          FROM (SELECT c_custkey::VARCHAR AS account_id, c_name,
                  nullif(c_custkey % 5, 0)::DOUBLE AS account_age_days,
                  CASE WHEN c_custkey % 2 = 0 THEN c_custkey END::DOUBLE AS followers_count,
                  CASE WHEN c_custkey % 3 = 0 THEN c_custkey % 7 END::DOUBLE
                    AS following_count,
                  (c_custkey % 11)::DOUBLE AS given_ratio,
                  CASE WHEN c_custkey % 4 = 0 THEN 8 END::DOUBLE AS tweet_count,
                  c_custkey::DOUBLE / 4 AS given_rate,
                  CASE WHEN c_custkey % 5 <> 0 THEN c_custkey % 13 END::DOUBLE
                    AS description_length,
                  CASE WHEN c_custkey % 6 = 0 THEN length(c_name) END AS given_length
                FROM customer))""",
    "feature_completeness": _with("""
        SELECT usable, count(*) AS account_count,
               count(*) FILTER (usable >= 6) AS sufficient_count,
               round(usable / 12, 3) AS completeness
        FROM account_feats GROUP BY usable""", "account_feats"),
    "usable_accounts": _with(
        "SELECT account_id, split, usable FROM feats WHERE usable >= 6", "feats"),
    "prep_parameters": _with("""
        SELECT feature, round(fill, 9) AS fill, round(mean, 9) AS mean, round(std, 9) AS std
        FROM prep""", "prep"),
    "prep_transform": _with(
        "SELECT account_id, split, "
        + ", ".join(f"round({f}, 9) + 0.0::DOUBLE AS {f}" for f in FEATURES) + " FROM transformed",
        "transformed"),
    "class_weights": _with("""
        SELECT negative_count, positive_count,
               greatest(negative_count, 1) / greatest(positive_count, 1) AS positive_ratio,
               (negative_count + positive_count) / (2 * greatest(negative_count, 1))
                 AS negative_weight,
               (negative_count + positive_count) / (2 * greatest(positive_count, 1))
                 AS positive_weight
        FROM (SELECT count(*) FILTER (label = 0) AS negative_count,
                     count(*) FILTER (label = 1) AS positive_count
              FROM feats WHERE split = 'train' AND usable >= 6)""", "feats"),
    "fixed_scores": _with("SELECT account_id, split, probability FROM scored", "scored"),
    "threshold_grid_costs": _with("""
        SELECT medium, high, scored_rows, round(mean_cost, 9) AS mean_cost,
               round(recall, 9) AS recall FROM costs""", "costs"),
    "risk_thresholds": _with("SELECT * FROM cuts", "cuts"),
    "classification_report": _with("""
        SELECT threshold, tn, fp, fn, tp,
               round(coalesce(tp / nullif(tp + fp, 0), 0), 9) AS precision,
               round(coalesce(tp / nullif(tp + fn, 0), 0), 9) AS recall,
               round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0), 9) AS f1
        FROM (SELECT any_value(medium) AS threshold,
                     count(*) FILTER (label = 0 AND probability < medium) AS tn,
                     count(*) FILTER (label = 0 AND probability >= medium) AS fp,
                     count(*) FILTER (label = 1 AND probability < medium) AS fn,
                     count(*) FILTER (label = 1 AND probability >= medium) AS tp
              FROM scored, cuts WHERE split = 'test' AND usable >= 6)""", "cuts"),
    "roc_auc": _with("""
        SELECT round(sum(pos * (before + neg / 2)) / (sum(pos) * sum(neg)), 9) AS roc_auc
        FROM (SELECT *, coalesce(sum(neg) OVER (ORDER BY probability ROWS BETWEEN
                       UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
              FROM (SELECT probability, count(*) FILTER (label = 1) AS pos,
                           count(*) FILTER (label = 0) AS neg
                    FROM scored GROUP BY probability))""", "scored"),
    "risk_bands": _with("""
        SELECT account_id, status, data_completeness, risk_probability, risk_band
        FROM decided""", "decided"),
    "confidence": _with("SELECT account_id, level, basis FROM decided", "decided"),
    "recommendations": _with("""
        SELECT risk_band, recommendation, warning, count(*) AS account_count
        FROM decided GROUP BY ALL""", "decided"),
    "top_factors": _with("""
        SELECT d.account_id, f.top_factors FROM decided d LEFT JOIN factors f
        ON f.account_id = d.account_id""", "factors"),
    "assess_batch": _with("SELECT * FROM answered", "answered"),
    "assess_without_model": _with(f"""
        SELECT request_id, coalesce(bad, 'model_unavailable') AS error_code,
               CASE WHEN bad IS NULL THEN {_message("model_unavailable")}
                    WHEN platform <> 'x' THEN 'Invalid value for platform.'
                    ELSE 'Invalid value for account_id.' END AS error_message
        FROM (SELECT *, CASE WHEN platform <> 'x' OR NOT
                regexp_full_match(account_id, '[0-9]{{1,19}}')
                THEN 'invalid_request' END AS bad FROM asked)""", "asked"),
    "assess_without_accounts": _with(f"""
        SELECT request_id, coalesce(bad, 'data_adapter_unavailable') AS error_code,
               CASE WHEN bad IS NULL THEN {_message("data_adapter_unavailable")}
                    WHEN platform <> 'x' THEN 'Invalid value for platform.'
                    ELSE 'Invalid value for account_id.' END AS error_message
        FROM (SELECT *, CASE WHEN platform <> 'x' OR NOT
                regexp_full_match(account_id, '[0-9]{{1,19}}')
                THEN 'invalid_request' END AS bad FROM asked)""", "asked"),
    "assess_without_store": _with(f"""
        SELECT request_id, CASE WHEN status <> 'completed' THEN status END AS status,
               CASE WHEN status = 'completed' THEN 'feedback_store_unavailable'
                    ELSE error_code END AS error_code,
               CASE WHEN status = 'completed' THEN {_message("feedback_store_unavailable")}
                    ELSE error_message END AS error_message
        FROM answered""", "answered"),
    "degraded_scores": _with(f"""
        SELECT account_id,
               CASE WHEN usable < 6 THEN status ELSE 'completed_with_warning' END AS status,
               risk_probability, risk_band,
               CASE WHEN usable >= 6 THEN 'monitor' END AS recommendation,
               CASE WHEN usable < 6 THEN {_q(INSUFFICIENT_WARNING)}
                    ELSE {_q(EXPLANATION_WARNING)} END AS warning,
               0 AS factor_count
        FROM decided""", "decided"),
    "parse_requests": _with("SELECT * FROM bodies", "bodies"),
    "recorded_assessments": _with(f"""
        SELECT assessment_id, '{MODEL_ID}' AS model_id, risk_band, status
        FROM answered WHERE status = 'completed'""", "answered"),
    "repeated_assessments": _with("""
        SELECT assessment_id, risk_band, status
        FROM answered WHERE status = 'completed'""", "answered"),
    "duplicate_assessments": _with("""
        SELECT assessment_id, risk_band, status
        FROM answered WHERE status = 'completed'""", "answered"),
    "tied_overrides": _with("""
        SELECT assessment_id, count(*) AS request_count,
               count(*) FILTER (outcome = 'recorded') AS recorded_count
        FROM override_decided GROUP BY assessment_id""", "override_decided"),
    "bad_overrides": _with(f"""
        SELECT {_ARRIVAL},
               CASE WHEN l_linenumber % 4 = 0 THEN substring(assessment_id, 1, 20)
                    ELSE assessment_id END AS assessment_id,
               CASE WHEN l_linenumber % 3 = 0 THEN 'Invalid value for override_label.'
                    WHEN NOT regexp_full_match(reason_code, '[a-z0-9_]{{1,64}}')
                    THEN 'Invalid value for reason_code.'
                    WHEN l_linenumber % 4 = 0 THEN 'Invalid assessment ID.' END AS problem
        FROM override_asked""", "override_asked"),
    "override_intake": _with("SELECT * FROM override_decided", "override_decided"),
    "recorded_overrides": _with("""
        SELECT assessment_id, override_label, reason_code
        FROM override_decided WHERE outcome = 'recorded'""", "override_decided"),
    "list_accounts": _with("""
        SELECT account_id, source_dataset, nullif(trim(username), '') AS username
        FROM crm ORDER BY account_id LIMIT 100""", "crm"),
    "listing_response": _with("""
        SELECT count(*) AS "count", string_agg(account_id, ',' ORDER BY account_id)
          AS account_ids
        FROM (SELECT account_id FROM crm ORDER BY account_id LIMIT 100)""", "crm"),
    "degraded_readiness": _with("""
        SELECT 'degraded' AS status, 'available' AS api, 'unavailable' AS model,
               'loaded' AS data_adapter, count(*) AS demo_account_count,
               'unavailable' AS feedback_store,
               'boosted_model,preprocessor,model_metadata' AS missing_artifacts
        FROM crm""", "crm"),
    "stream_restart": _with("""
        SELECT request_id, 2 AS answer_count,
               count(*) FILTER (status = 'completed') AS record_count
        FROM answered GROUP BY request_id""", "answered"),
    "baseline_gradient": "SELECT unnest(["
        + ", ".join(_q(f) for f in ("intercept", *FEATURES)) + "]) AS term, true AS flat",
    "boosted_additivity": _with("SELECT account_id, true AS adds_up FROM account_feats",
                                "account_feats"),
    "boosted_shape": """
        SELECT 150 AS tree_count, true AS depth_kept, 1.0::DOUBLE AS first_weight,
               '[0.05]' AS other_weights, 'prediction' AS predicted, 'rawPrediction' AS raw,
               'probability' AS probability""",
    "metric_totals": _with("""
        SELECT unnest(['baseline', 'boosted']) AS model, count(*) AS row_count
        FROM feats WHERE split = 'test' AND usable >= 6""", "feats"),
    "readiness_report": _with("""
        SELECT 'ok' AS status, 'available' AS api, 'loaded' AS model,
               'loaded' AS data_adapter, count(*) AS demo_account_count,
               'ready' AS feedback_store, '' AS missing_artifacts
        FROM crm""", "crm"),
    "training_cleaning": _with(f"""
        SELECT s.*, {", ".join(
            f"count(*) FILTER (split = '{p}') AS {p}_count" for p in
            ("train", "validation", "test"))},
               {", ".join(
            f"count(*) FILTER (split = '{p}' AND usable < 6) AS {p}_removed" for p in
            ("train", "validation", "test"))}
        FROM feats, ({_COUNTS}) s GROUP BY ALL""", "feats"),
}
ORACLE["csv_features"] = ORACLE["account_features"]
ORACLE["assess_stream"] = ORACLE["assess_batch"]
ORACLE["override_stream"] = ORACLE["override_intake"]
ORACLE["repeated_and_late_requests"] = """
    WITH days AS (
        SELECT CAST(o_orderkey AS VARCHAR) AS request_id, o_orderkey % 11 = 0 AS moved,
            CAST(epoch(o_orderdate) AS BIGINT) AS day FROM orders
    ),
    ends AS (SELECT min(day) AS low, (max(day) - min(day)) // 3 AS third FROM days),
    placed AS (
        SELECT request_id, day, moved AND day < low + 2 * third AS moved,
            moved OR day >= low + 2 * third AS last
        FROM days, ends
    ),
    -- what the waves before the last have seen, less 30 days
    mark AS (SELECT max(day) FILTER (NOT last) - 30 * 86400 AS mark FROM placed)
    SELECT request_id, 1 AS answer_count, moved AND day <= mark AS late FROM placed, mark
"""
ORACLE["failed_explanations"] = ORACLE["degraded_scores"]
ORACLE["failed_scores"] = _with(f"""
    SELECT request_id,
        CASE WHEN NOT lost THEN status END AS status,
        CASE WHEN NOT lost THEN risk_band END AS risk_band,
        CASE WHEN lost THEN 'internal_error' ELSE error_code END AS error_code,
        CASE WHEN lost THEN {_message("internal_error")} ELSE error_message END AS error_message
    FROM (SELECT *, coalesce(status = 'completed'
        AND TRY_CAST(account_id AS BIGINT) % 5 = 2, false) AS lost FROM answered)""", "answered")
ORACLE["argument_checks"] = """
    SELECT (SELECT count(*) FROM customer) AS account_count, unnest.*
    FROM (SELECT unnest([
        {'check': 'required', 'said': 'ValueError: Columns not found: [''account_id'', ''label'']'},
        {'check': 'labelled', 'said': 'The account table has a label; it must not.'},
        {'check': 'without_id', 'said': 'The account table has no account_id.'},
        {'check': 'repeated', 'said': 'Some account ids occur more than once.'},
        {'check': 'limit_0', 'said': 'ValueError: Limit must be between 1 and 100.'},
        {'check': 'limit_100', 'said': 'fine'},
        {'check': 'limit_101', 'said': 'ValueError: Limit must be between 1 and 100.'},
        {'check': 'extra_column', 'said': 'ValueError: Invalid value for note.'},
        {'check': 'private', 'said':
            'AssertionError: Private columns in a demo sample: [''feature_completeness'', ''label''].'}]) AS unnest)
"""
ORACLE["registered_counts"] = _with("""
    SELECT count(*) AS clean_account_count, true AS named, true AS ordered FROM feats""", "feats")
