"""DuckDB SQL equivalents of the registered queries, over the same Parquet tables.

The texts state the definitions on their own, with joins and windows over base rows where that is the plainest
form; they share no code with the operators.
"""

from __future__ import annotations

# --- the communications table ----------------------------------------------------------------------------------

COMMUNICATIONS = """
base AS (
  SELECT event_id, user_id, event_type, c_mktsegment, c_acctbal,
         CAST(regexp_extract(props, '([0-9]+)', 1) AS INT) AS k, CAST(ts AS DATE) AS sent_date
  FROM events JOIN customer ON user_id = c_custkey
),
flags AS (
  SELECT *,
    CASE WHEN event_type NOT IN ('view', 'click', 'purchase') THEN 0
         WHEN k % 10 = 7 AND k % 40 <> 17 THEN 0
         WHEN c_mktsegment = 'AUTOMOBILE' AND sent_date >= DATE '2024-01-24' AND k % 2 = 1 THEN 0
         ELSE 1 END AS opened,
    CASE WHEN (event_id * 7 + k) % 4 = 0 THEN 1 ELSE 0 END AS response_flag,
    CASE WHEN (event_id * 11 + user_id * 3 + k) % 20 = 0
           OR (event_type = 'error' AND sent_date = DATE '2024-01-15') THEN 1 ELSE 0 END AS complaint_flag,
    CASE WHEN (event_id * 17 + k) % 33 = 0 THEN 1 ELSE 0 END AS escalation_flag,
    CASE WHEN (event_id * 13 + k) % 25 < 2 THEN 1 ELSE 0 END AS opt_out_flag
  FROM base
),
clicks AS (
  SELECT *, CASE WHEN event_type IN ('click', 'purchase') THEN opened ELSE 0 END AS clicked FROM flags
),
scores AS (
  SELECT *, round_even(greatest(0e0, least(1e0,
      0.35e0 * opened + 0.30e0 * clicked + 0.25e0 * response_flag
      - 0.15e0 * complaint_flag - 0.10e0 * opt_out_flag)), 4) AS engagement_score
  FROM clicks
),
comm AS (
  SELECT
    'CUST_' || lpad(CAST(event_id AS VARCHAR), 9, '0') AS customer_id,
    CASE WHEN c_mktsegment = 'AUTOMOBILE' THEN 'Premium'
         WHEN c_mktsegment IN ('BUILDING', 'MACHINERY') THEN 'Standard' ELSE 'Basic' END AS segment,
    CASE user_id % 4 WHEN 0 THEN 'Auto' WHEN 1 THEN 'Home' WHEN 2 THEN 'Life' ELSE 'Health' END AS product_type,
    CASE WHEN event_id % 20 < 9 THEN 'Email' WHEN event_id % 20 < 14 THEN 'SMS'
         WHEN event_id % 20 < 18 THEN 'Phone' ELSE 'Direct Mail' END AS channel,
    'CAMP_' || lpad(CAST(k % 10 + 1 AS VARCHAR), 3, '0') AS campaign_id,
    sent_date,
    CAST(opened AS INT) AS opened, CAST(clicked AS INT) AS clicked,
    CAST(response_flag AS INT) AS response_flag, CAST(complaint_flag AS INT) AS complaint_flag,
    CAST(escalation_flag AS INT) AS escalation_flag, engagement_score,
    CASE WHEN engagement_score >= 0.70e0 THEN 'positive' WHEN engagement_score >= 0.45e0 THEN 'neutral'
         WHEN engagement_score >= 0.25e0 THEN 'mixed' ELSE 'negative' END AS sentiment_text,
    CASE WHEN c_acctbal < 2500 THEN 'Low' WHEN c_acctbal < 7000 THEN 'Mid' ELSE 'High' END AS premium_bucket,
    CAST(1 + user_id * 7 % 120 AS INT) AS tenure_months,
    CAST(event_id * 37 % 181 AS INT) AS days_since_last_contact,
    CAST(opt_out_flag AS INT) AS opt_out_flag,
    CASE WHEN (engagement_score < 0.25e0 AND opened = 0 AND event_id * 37 % 181 < 45)
           OR complaint_flag = 1 OR escalation_flag = 1
           OR (event_id * 37 % 181 > 120 AND response_flag = 0 AND opt_out_flag = 0 AND engagement_score < 0.5e0)
         THEN 1 ELSE 0 END AS needs_intervention
  FROM scores
)
"""

COLUMNS = [
    "customer_id", "segment", "product_type", "channel", "campaign_id", "sent_date", "opened", "clicked",
    "response_flag", "complaint_flag", "escalation_flag", "engagement_score", "sentiment_text", "premium_bucket",
    "tenure_months", "days_since_last_contact", "opt_out_flag", "needs_intervention",
]

_NUMBERED = "numbered AS (SELECT *, CAST(substr(customer_id, 6) AS BIGINT) AS n FROM comm)"


def _raw(bad_dates: bool = False) -> str:
    text = "CAST(sent_date AS VARCHAR)"
    sent = f"CASE WHEN n % 2 = 0 THEN {text} || ' 09:30:00' ELSE {text} END"
    if bad_dates:
        sent = f"CASE WHEN n % 103 = 0 THEN 'not a date' ELSE {sent} END"
    return f"""{COMMUNICATIONS}, {_NUMBERED},
raw AS (
  SELECT
    CASE WHEN n % 101 = 0 THEN NULL
         ELSE 'CUST_' || lpad(CAST(tenure_months * 10 + n % 7 AS VARCHAR), 6, '0') END AS customer_id,
    CASE WHEN n % 97 = 0 THEN NULL WHEN n % 89 = 0 THEN 'Gold'
         WHEN n % 13 = 0 THEN '  ' || segment || ' ' ELSE segment END AS segment,
    product_type,
    CASE WHEN n % 17 = 0 THEN channel || chr(9) || chr(160) ELSE channel END AS channel,
    campaign_id, {sent} AS sent_date,
    CASE WHEN n % 107 = 0 THEN NULL ELSE opened END AS opened, clicked, response_flag,
    CASE WHEN n % 109 = 0 THEN 2 ELSE complaint_flag END AS complaint_flag, escalation_flag,
    CASE WHEN n % 113 = 0 THEN 1.5e0 WHEN n % 127 = 0 THEN -0.2e0 WHEN n % 131 = 0 THEN NULL
         ELSE engagement_score END AS engagement_score,
    CASE WHEN n % 157 = 0 THEN 'angry' ELSE sentiment_text END AS sentiment_text, premium_bucket,
    CASE WHEN n % 139 = 0 THEN 0 ELSE tenure_months END AS tenure_months,
    CASE WHEN n % 149 = 0 THEN 400 WHEN n % 151 = 0 THEN -1 ELSE days_since_last_contact END
      AS days_since_last_contact,
    opt_out_flag,
    CASE WHEN n % 163 = 0 THEN NULL ELSE needs_intervention END AS needs_intervention
  FROM numbered
)"""


RAW, RAW_BAD_DATES = _raw(), _raw(bad_dates=True)


def cases(select: str, *ctes: str) -> str:
    return "WITH " + ",\n".join([COMMUNICATIONS, *ctes]) + "\n" + select


def raw(select: str, *ctes: str) -> str:
    return "WITH " + ",\n".join([RAW, *ctes]) + "\n" + select


def r4(value: str, digits: int = 4) -> str:
    return f"round_even(({value}) * 1e{digits}, 0) / 1e{digits}"


def fixed(value: str, digits: int) -> str:
    return f"printf('%.{digits}f', {value})"


def percent(value: str, digits: int = 1) -> str:
    return fixed(f"({value}) * 1e2", digits) + " || '%'"


# --- quality ---------------------------------------------------------------------------------------------------

CRITICAL = ["customer_id", "segment", "engagement_score", "needs_intervention"]
BINARY = [
    "opened", "clicked", "response_flag", "complaint_flag", "escalation_flag", "opt_out_flag", "needs_intervention",
]
ALLOWED = {
    "segment": "('Premium', 'Standard', 'Basic')",
    "product_type": "('Auto', 'Home', 'Life', 'Health')",
    "channel": "('Email', 'SMS', 'Phone', 'Direct Mail')",
    "premium_bucket": "('Low', 'Mid', 'High')",
    "sentiment_text": "('positive', 'neutral', 'negative', 'mixed')",
}
RANGES = [
    ("engagement_score", 0, 1, "error"),
    ("tenure_months", 1, 120, "warning"),
    ("days_since_last_contact", 0, 365, "warning"),
]


def _dq_nulls() -> str:
    return raw(
        " UNION ALL ".join(
            f"SELECT '{c}' AS column_name, '{'error' if c in CRITICAL else 'warning'}' AS severity,"
            f" count(*) FILTER (WHERE {c} IS NULL) AS nulls FROM raw"
            for c in COLUMNS
        )
    )


def _dq_binary() -> str:
    return raw(
        " UNION ALL ".join(
            f"SELECT '{c}' AS column_name, CAST({c} AS VARCHAR) AS value, count(*) AS failures FROM raw"
            f" WHERE {c} IS NULL OR {c} NOT IN (0, 1) GROUP BY {c}"
            for c in BINARY
        )
    )


def _dq_domain() -> str:
    return raw(
        " UNION ALL ".join(
            f"SELECT '{c}' AS column_name, {c} AS value, count(*) AS failures FROM raw"
            f" WHERE {c} NOT IN {allowed} GROUP BY {c}"
            for c, allowed in ALLOWED.items()
        )
    )


def _dq_ranges() -> str:
    return raw(
        " UNION ALL ".join(
            f"SELECT '{c}' AS column_name, CAST({low} AS BIGINT) AS low, CAST({high} AS BIGINT) AS high,"
            f" '{severity}' AS severity, count(*) FILTER (WHERE {c} < {low} OR {c} > {high}) AS failures FROM raw"
            for c, low, high, severity in RANGES
        )
    )


def _dq_stats() -> str:
    nulls = " + ".join(f"count(*) FILTER (WHERE {c} IS NULL)" for c in COLUMNS)
    return raw(
        f"SELECT count(*) AS row_count, CAST({len(COLUMNS)} AS BIGINT) AS column_count,"
        f" CAST({nulls} AS BIGINT) AS null_total, {r4('avg(engagement_score)')} AS engagement_mean,"
        f" {r4('avg(complaint_flag)')} AS complaint_rate, {r4('avg(needs_intervention)')} AS intervention_rate"
        " FROM raw"
    )


def _dq_report() -> str:
    checks: list[tuple[str, str | None, str, str, str, str]] = []
    for c in CRITICAL:
        checks.append(("nulls", c, "error", f"{c} IS NULL", f"Nulls in critical column ''{c}'': ", " rows"))
    for c in COLUMNS:
        if c not in CRITICAL:
            checks.append(("nulls", c, "warning", f"{c} IS NULL", f"Nulls in ''{c}'': ", " rows"))
    for c in BINARY:
        bad = f"{c} IS NULL OR {c} NOT IN (0, 1)"
        checks.append(("binary", c, "error", bad, f"Column ''{c}'' contains non-binary values: ", " rows"))
    for c, allowed in ALLOWED.items():
        bad = f"{c} NOT IN {allowed}"
        checks.append(("domain", c, "error", bad, f"Column ''{c}'' has unexpected values: ", " rows"))
    for c, low, high, severity in RANGES:
        bad = f"{c} < {low} OR {c} > {high}"
        if severity == "error":
            checks.append(("score_range", c, severity, bad, "engagement_score out of [0,1] range: ", " rows"))
        else:
            after = f" values outside [{low}, {high}]"
            checks.append(("numeric_range", c, severity, bad, f"Column ''{c}'' has ", after))
    parts = [
        f"SELECT {position} AS position, '{check}' AS check_name, '{c}' AS column_name, '{severity}' AS severity,"
        f" count(*) AS failures, '{before}' || CAST(count(*) AS VARCHAR) || '{after}' AS detail"
        f" FROM raw WHERE {bad} HAVING count(*) > 0"
        for position, (check, c, severity, bad, before, after) in enumerate(checks)
    ]
    parts.append(
        "SELECT 33, 'row_count', NULL, 'warning', count(*), 'Dataset has only ' || CAST(count(*) AS VARCHAR) ||"
        " ' rows (expected >= 100)' FROM raw HAVING count(*) < 100"
    )
    rate = percent("avg(needs_intervention)")
    parts.append(
        f"SELECT 34, 'intervention_rate', 'needs_intervention', 'warning', 1, 'Intervention rate very low: ' || {rate}"
        " || ' — model may struggle' FROM raw HAVING avg(needs_intervention) < 0.05e0"
    )
    parts.append(
        f"SELECT 34, 'intervention_rate', 'needs_intervention', 'warning', 1, 'Intervention rate very high: ' || {rate}"
        " || ' — check target definition' FROM raw HAVING avg(needs_intervention) > 0.80e0"
    )
    return raw(" UNION ALL ".join(parts))


def _rules() -> str:
    rules = []
    bounds = {
        "opened": (0, 1), "clicked": (0, 1), "response_flag": (0, 1), "complaint_flag": (0, 1),
        "escalation_flag": (0, 1), "opt_out_flag": (0, 1), "tenure_months": (1, 120),
        "days_since_last_contact": (0, None), "engagement_score": (0, 1),
    }
    for c, (low, high) in bounds.items():
        above = "" if high is None else f" WHEN {c} > {high} THEN '{c}: above {high}'"
        rules.append(f"CASE WHEN {c} < {low} THEN '{c}: below {low}'{above} END")
    rules.append("CASE WHEN NOT regexp_full_match(sent_date, '[0-9]{4}-[0-9]{2}-[0-9]{2}') THEN 'sent_date: not a date' END")
    return f"concat_ws('; ', {', '.join(rules)})"


FILLED = """
filled AS (
  SELECT * REPLACE (coalesce(customer_id, 'UNKNOWN') AS customer_id, coalesce(opened, 0) AS opened,
                    coalesce(engagement_score, 0.5e0) AS engagement_score)
  FROM raw
)"""


def _admission() -> str:
    return f"""WITH {RAW_BAD_DATES},{FILLED}
SELECT customer_id, CASE WHEN length(sent_date) = 10 THEN TRY_CAST(sent_date AS DATE) END AS sent_date, opened, engagement_score,
       {_rules()} = '' AS admitted, {_rules()} AS reasons
FROM filled"""


def _requests() -> str:
    """The rule over the admitted fields."""
    return f"""WITH {RAW_BAD_DATES},{FILLED}
SELECT customer_id, CAST(y AS DOUBLE) AS intervention_score, y AS needs_intervention,
       CASE WHEN y = 1 THEN 'High' ELSE 'Low' END AS risk_band
FROM (
  SELECT customer_id,
    CASE WHEN (engagement_score < 0.25e0 AND opened = 0 AND days_since_last_contact < 45)
           OR complaint_flag = 1 OR escalation_flag = 1
           OR (days_since_last_contact > 120 AND response_flag = 0 AND opt_out_flag = 0 AND engagement_score < 0.5e0)
         THEN 1 ELSE 0 END AS y
  FROM filled WHERE {_rules()} = '')"""


STRIPPED = """
stripped AS (
  SELECT * REPLACE (
    trim(customer_id, ' ' || chr(9) || chr(160)) AS customer_id,
    trim(segment, ' ' || chr(9) || chr(160)) AS segment, trim(channel, ' ' || chr(9) || chr(160)) AS channel, CAST(substr(sent_date, 1, 10) AS DATE) AS sent_date)
  FROM raw
)"""


def _dedup() -> str:
    order = ["sent_date", *[c for c in COLUMNS if c not in ("sent_date", "customer_id")]]
    by = ", ".join(f"{c} ASC NULLS FIRST" for c in order)
    return raw(
        f"SELECT {', '.join(COLUMNS)} FROM (SELECT *, row_number() OVER (PARTITION BY customer_id ORDER BY {by}) AS rn"
        " FROM stripped) WHERE rn = 1",
        STRIPPED,
    )


# --- stand-in score, features, split ---------------------------------------------------------------------------

STAND_IN = f"""
banded AS (
  SELECT *, CAST(p >= 0.45e0 AS INT) AS predicted_intervention, p AS intervention_score,
    CASE WHEN p >= 0.70e0 THEN 'High' WHEN p >= 0.45e0 THEN 'Medium' ELSE 'Low' END AS risk_band
  FROM (SELECT *, {r4('1e0 - engagement_score')} AS p FROM comm)
)"""

INTERACTIONS = f"""
  CASE WHEN days_since_last_contact < 30 AND response_flag = 0 THEN 1 ELSE 0 END AS contact_but_no_response,
  CASE WHEN complaint_flag = 1 AND escalation_flag = 1 THEN 1 ELSE 0 END AS high_risk_combo,
  {r4('engagement_score * ln(1e0 + tenure_months)')} AS engagement_x_tenure,
  CASE WHEN engagement_score < 0.35e0 AND days_since_last_contact > 60 THEN 1 ELSE 0 END
    AS low_engagement_long_silence"""

ENCODED = {
    "segment": ["Premium", "Standard"],
    "product_type": ["Health", "Home", "Life"],
    "channel": ["Email", "Phone", "SMS"],
    "premium_bucket": ["Low", "Mid"],
    "sentiment_text": ["negative", "neutral", "positive"],
}
ONE_HOT = ", ".join(
    f"CASE WHEN {c} = '{level}' THEN 1 ELSE 0 END AS {c}_{level}" for c, levels in ENCODED.items() for level in levels
)
PASSED = (
    "opened, clicked, response_flag, complaint_flag, escalation_flag, engagement_score, tenure_months,"
    " days_since_last_contact, opt_out_flag"
)

FEATURES = [
    *(c.strip() for c in PASSED.split(",")),
    "contact_but_no_response", "high_risk_combo", "engagement_x_tenure", "low_engagement_long_silence",
    *(f"{c}_{level}" for c, levels in ENCODED.items() for level in levels),
]

SPLIT = """
ranked AS (
  SELECT customer_id, needs_intervention,
    row_number() OVER (PARTITION BY needs_intervention ORDER BY md5(customer_id)) AS rn,
    count(*) OVER (PARTITION BY needs_intervention) AS n
  FROM comm
),
sized AS (SELECT *, CAST(ceil(0.2e0 * n) AS BIGINT) AS t FROM ranked),
slotted AS (
  SELECT customer_id, needs_intervention,
    CASE WHEN rn <= t THEN 0
         WHEN rn <= t + ceil((n - t) * 1 / 5e0) THEN 1
         WHEN rn <= t + ceil((n - t) * 2 / 5e0) THEN 2
         WHEN rn <= t + ceil((n - t) * 3 / 5e0) THEN 3
         WHEN rn <= t + ceil((n - t) * 4 / 5e0) THEN 4
         ELSE 5 END AS slot
  FROM sized
)"""

# the rule as a score: what a tree with pure leaves gives
RULED = """
banded AS (
  SELECT *, CAST(needs_intervention AS DOUBLE) AS p, CAST(needs_intervention AS DOUBLE) AS intervention_score,
    needs_intervention AS predicted_intervention,
    CASE WHEN needs_intervention = 1 THEN 'High' ELSE 'Low' END AS risk_band
  FROM comm
)"""
TESTED = """
tested AS (
  SELECT count(*) AS rows, count(*) FILTER (WHERE needs_intervention = 1) AS positives,
    count(*) FILTER (WHERE needs_intervention = 0) AS negatives
  FROM slotted WHERE slot = 0
)"""

MATRIX = """
matrix AS (
  SELECT count(*) FILTER (WHERE needs_intervention = 0 AND predicted_intervention = 0) AS tn,
         count(*) FILTER (WHERE needs_intervention = 0 AND predicted_intervention = 1) AS fp,
         count(*) FILTER (WHERE needs_intervention = 1 AND predicted_intervention = 0) AS fn,
         count(*) FILTER (WHERE needs_intervention = 1 AND predicted_intervention = 1) AS tp
  FROM banded
)"""


def _report_row(label: int, hit: str, missed: str, wrong: str) -> str:
    return (
        f"SELECT {label} AS label, {r4(f'coalesce({hit} / nullif({hit} + {wrong}, 0), 0)')} AS precision,"
        f" {r4(f'coalesce({hit} / nullif({hit} + {missed}, 0), 0)')} AS recall,"
        f" {r4(f'coalesce(2 * {hit} / nullif(2 * {hit} + {wrong} + {missed}, 0), 0)')} AS f1,"
        f" {hit} + {missed} AS support, {r4('(tn + tp) / (tn + fp + fn + tp)')} AS accuracy FROM matrix"
    )


# area under the ROC curve as the normalised rank sum, ties ranked by their mean
ROC_AUC = f"""
SELECT {r4('(positive_ranks - p * (p + 1) / 2e0) / (p * n)')} AS roc_auc
FROM (
  SELECT sum(mean_rank) FILTER (WHERE needs_intervention = 1) AS positive_ranks,
         CAST(count(*) FILTER (WHERE needs_intervention = 1) AS DOUBLE) AS p,
         CAST(count(*) FILTER (WHERE needs_intervention = 0) AS DOUBLE) AS n
  FROM (
    SELECT needs_intervention,
      rank() OVER (ORDER BY p) + (count(*) OVER (PARTITION BY p) - 1) / 2e0 AS mean_rank
    FROM banded
  )
)"""

# --- detectors -------------------------------------------------------------------------------------------------

WEEKS = f"""
today AS (SELECT max(sent_date) AS d FROM comm),
week_now AS (
  SELECT segment, avg(engagement_score) AS c FROM comm, today
  WHERE sent_date >= CAST(d - INTERVAL 6 DAY AS DATE) GROUP BY segment
),
week_before AS (
  SELECT segment, avg(engagement_score) AS b FROM comm, today
  WHERE sent_date BETWEEN CAST(d - INTERVAL 13 DAY AS DATE) AND CAST(d - INTERVAL 7 DAY AS DATE) GROUP BY segment
),
weeks AS (
  SELECT segment, {r4('c')} AS current_week_avg, {r4('b')} AS previous_week_avg,
         {r4('(b - c) / b')} AS drop_pct, {percent('(b - c) / b')} AS drop_pct_label,
         (b - c) / b > 0.15e0 AS flagged
  FROM week_now JOIN week_before USING (segment) WHERE b <> 0
)"""

DAYS = f"""
daily AS (
  SELECT sent_date AS date, CAST(sum(complaint_flag) AS BIGINT) AS complaints, count(*) AS total_sent
  FROM comm GROUP BY sent_date
),
spread AS (SELECT avg(complaints) AS m, stddev_samp(complaints) AS s, count(*) AS days FROM daily),
days AS (
  SELECT date, complaints, total_sent, {r4('complaints / total_sent')} AS complaint_rate,
         CASE WHEN days >= 3 AND s <> 0 THEN {r4('(complaints - m) / s')} END AS zscore,
         coalesce(days >= 3 AND s <> 0 AND (complaints - m) / s > 2e0, false) AS flagged
  FROM daily, spread
)"""

CAMPAIGNS = f"""
sent AS (
  SELECT campaign_id, count(opened) AS total_sent, CAST(sum(complaint_flag) AS BIGINT) AS complaint_count,
         avg(engagement_score) AS e,
         CASE WHEN count(opened) > 0 THEN {r4('sum(opened) / count(opened)')} ELSE 0e0 END AS open_rate
  FROM comm GROUP BY campaign_id
),
middle AS (SELECT median(open_rate) AS m, count(*) AS campaigns FROM sent),
campaigns AS (
  SELECT campaign_id, open_rate, {percent('open_rate')} AS open_rate_label, {r4('m')} AS median_open_rate,
         CASE WHEN m > 0 THEN {r4('open_rate / m')} ELSE 0e0 END AS pct_of_median, total_sent, complaint_count,
         {r4('e')} AS avg_engagement, {r4('m * 0.5e0')} AS cutoff_open_rate, open_rate < m * 0.5e0 AS flagged
  FROM sent, middle
)"""

CAMPAIGN_COLUMNS = (
    "campaign_id, open_rate, open_rate_label, median_open_rate, pct_of_median, total_sent, complaint_count,"
    " avg_engagement"
)


def _as_text(names: str) -> str:
    return ", ".join(f"{n.strip()} := CAST({n.strip()} AS VARCHAR)" for n in names.split(","))


STATUS = f"""
segment_status AS (
  SELECT 1 AS position, 'segment_engagement_drop' AS detector, n > 0 AS flagged,
    CASE WHEN n > 0
      THEN n || ' segment(s) show engagement drops above 15%. Worst: ' || worst || ' dropped ' || label
           || ' week-over-week.'
      ELSE 'No segment engagement drops above 15% detected across ' || compared || ' segment(s).' END AS summary,
    CAST(to_json(struct_pack(threshold := '0.15', segments_compared := names,
      current_week_start := CAST(CAST(d - INTERVAL 6 DAY AS DATE) AS VARCHAR),
      previous_week_start := CAST(CAST(d - INTERVAL 13 DAY AS DATE) AS VARCHAR))) AS VARCHAR) AS metadata,
    n AS n_flagged,
    anomalies
  FROM today, (
    SELECT count(*) FILTER (WHERE flagged) AS n, count(*) AS compared,
      coalesce(string_agg(segment, ', ' ORDER BY segment), '') AS names,
      first(segment ORDER BY drop_pct DESC, segment) FILTER (WHERE flagged) AS worst,
      first(drop_pct_label ORDER BY drop_pct DESC, segment) FILTER (WHERE flagged) AS label,
      coalesce(CAST(to_json(list(struct_pack(
        {_as_text('segment, current_week_avg, previous_week_avg, drop_pct, drop_pct_label')}) ORDER BY segment)
        FILTER (WHERE flagged)) AS VARCHAR), '[]') AS anomalies
    FROM weeks)
),
complaint_status AS (
  SELECT 2 AS position, 'complaint_spike' AS detector, n > 0 AS flagged,
    CASE WHEN days < 3 THEN 'Insufficient data for complaint spike detection (need >= 3 days).'
         WHEN s = 0 THEN 'Complaint counts are uniform — no spike detection possible.'
         WHEN n > 0 THEN n || ' day(s) with complaint spikes detected. Highest: ' || worst || ' with ' || complaints
           || ' complaints (z-score: ' || {fixed('z', 2)} || ').'
         ELSE 'No complaint spikes above z-score 2.0 detected. Daily average: ' || {fixed('m', 1)} || ' complaints.'
    END AS summary,
    CASE WHEN days < 3 THEN '{{"threshold":"2.0"}}'
         WHEN s = 0 THEN CAST(to_json(struct_pack(threshold := '2.0', mean := CAST({r4('m', 2)} AS VARCHAR)))
           AS VARCHAR)
         ELSE CAST(to_json(struct_pack(threshold := '2.0', mean_complaints := CAST({r4('m', 2)} AS VARCHAR),
           std_complaints := CAST({r4('s', 2)} AS VARCHAR), days_analysed := CAST(days AS VARCHAR))) AS VARCHAR)
    END AS metadata,
    n AS n_flagged,
    anomalies
  FROM spread, (
    SELECT count(*) FILTER (WHERE flagged) AS n,
      first(date ORDER BY zscore DESC, date) FILTER (WHERE flagged) AS worst,
      first(complaints ORDER BY zscore DESC, date) FILTER (WHERE flagged) AS complaints,
      first(zscore ORDER BY zscore DESC, date) FILTER (WHERE flagged) AS z,
      coalesce(CAST(to_json(list(struct_pack(
        {_as_text('date, complaints, total_sent, complaint_rate, zscore')}) ORDER BY zscore DESC, date)
        FILTER (WHERE flagged)) AS VARCHAR), '[]') AS anomalies
    FROM days)
),
campaign_status AS (
  SELECT 3 AS position, 'campaign_underperformance' AS detector, n > 0 AS flagged,
    CASE WHEN n > 0
      THEN n || ' campaign(s) underperforming. Median open rate: ' || {percent('m')} || '. Worst: ' || worst || ' at '
           || label || ' (' || {percent('share', 0)} || ' of median).'
      ELSE 'All ' || campaigns || ' campaigns performing above 50% of median open rate (' || {percent('m')} || ').'
    END AS summary,
    CAST(to_json(struct_pack(ratio_threshold := '0.5', median_open_rate := CAST({r4('m')} AS VARCHAR),
      cutoff_open_rate := CAST({r4('m * 0.5e0')} AS VARCHAR), campaigns_checked := CAST(campaigns AS VARCHAR)))
      AS VARCHAR) AS metadata,
    n AS n_flagged,
    anomalies
  FROM middle, (
    SELECT count(*) FILTER (WHERE flagged) AS n,
      first(campaign_id ORDER BY open_rate, campaign_id) FILTER (WHERE flagged) AS worst,
      first(open_rate_label ORDER BY open_rate, campaign_id) FILTER (WHERE flagged) AS label,
      first(pct_of_median ORDER BY open_rate, campaign_id) FILTER (WHERE flagged) AS share,
      coalesce(CAST(to_json(list(struct_pack({_as_text(CAMPAIGN_COLUMNS)}) ORDER BY open_rate, campaign_id)
        FILTER (WHERE flagged)) AS VARCHAR), '[]') AS anomalies
    FROM campaigns)
),
items AS (
  SELECT 'segment_engagement_drop' AS detector, row_number() OVER (ORDER BY segment) AS position, segment AS item,
    CAST(to_json(struct_pack({_as_text('segment, current_week_avg, previous_week_avg, drop_pct, drop_pct_label')}))
      AS VARCHAR) AS fields
  FROM weeks WHERE flagged
  UNION ALL
  SELECT 'complaint_spike', row_number() OVER (ORDER BY zscore DESC, date), CAST(date AS VARCHAR),
    CAST(to_json(struct_pack({_as_text('date, complaints, total_sent, complaint_rate, zscore')})) AS VARCHAR)
  FROM days WHERE flagged
  UNION ALL
  SELECT 'campaign_underperformance', row_number() OVER (ORDER BY open_rate, campaign_id), campaign_id,
    CAST(to_json(struct_pack({_as_text(CAMPAIGN_COLUMNS)})) AS VARCHAR)
  FROM campaigns WHERE flagged
),
status AS (
  SELECT * FROM segment_status UNION ALL SELECT * FROM complaint_status UNION ALL SELECT * FROM campaign_status
),
anomaly_line AS (
  SELECT string_agg('  [' || CASE WHEN flagged THEN '⚠ FLAGGED' ELSE '✓ OK' END || '] ' || detector || ': '
    || summary, chr(10) ORDER BY position) AS anomaly_text FROM status
)"""
DETECTORS = (WEEKS, DAYS, CAMPAIGNS, STATUS)

# --- case texts ------------------------------------------------------------------------------------------------

_PROMPT = f"""
SELECT customer_id,
  'Customer case summary request:' || chr(10) || chr(10)
  || 'Customer ID     : ' || customer_id || chr(10)
  || 'Segment         : ' || segment || chr(10)
  || 'Channel         : ' || channel || chr(10)
  || 'Sentiment       : ' || sentiment_text || chr(10)
  || 'Engagement score: ' || {fixed('engagement_score', 2)} || ' / 1.00' || chr(10)
  || 'Complaint flag  : ' || CASE WHEN complaint_flag <> 0 THEN 'Yes' ELSE 'No' END || chr(10)
  || 'Escalation flag : ' || CASE WHEN escalation_flag <> 0 THEN 'Yes' ELSE 'No' END || chr(10)
  || 'Days since last contact: ' || days_since_last_contact || chr(10)
  || 'Model intervention score: ' || {fixed('p', 2)} || ' (risk: ' || risk_band || ')' || chr(10) || chr(10)
  || 'Anomaly context:' || chr(10) || anomaly_text || chr(10) || chr(10)
  || 'Write a 2-3 sentence next-best-action summary for this customer case.' AS user_prompt
FROM banded, anomaly_line"""

_SUMMARY = f"""
SELECT customer_id,
  CASE WHEN risk_band = 'High' OR escalation_flag <> 0
       THEN 'This ' || segment || ' segment customer is showing elevated intervention risk (score: '
            || {fixed('p', 2)} || ') with ' || sentiment_text || ' sentiment and ' || days_since_last_contact
            || ' days since last contact.'
       WHEN complaint_flag <> 0
       THEN 'A complaint has been raised by this ' || segment || ' customer, with engagement score at '
            || {fixed('engagement_score', 2)} || ' and risk band flagged as ' || risk_band || '.'
       ELSE 'Engagement for this ' || segment || ' customer has declined to ' || {fixed('engagement_score', 2)}
            || ' over the past period, with ' || days_since_last_contact || ' days since last meaningful contact.'
  END || ' ' ||
  CASE channel
    WHEN 'Email' THEN 'Recommend reducing Email frequency and switching to a personalised SMS or phone outreach within the next 7 days.'
    WHEN 'SMS' THEN 'Recommend escalating from SMS to a direct phone call to re-establish engagement and address any outstanding concerns.'
    ELSE 'Recommend a direct follow-up via ' || channel || ' with a personalised retention offer tailored to the '
         || segment || ' segment.'
  END || ' ' ||
  CASE WHEN contains(anomaly_text, 'FLAGGED')
    THEN 'Broader segment-level anomalies have been detected — review campaign messaging for this cohort before next outreach.'
    ELSE 'Monitor engagement over the next 14 days and escalate if intervention score remains above 0.45.'
  END AS summary,
  'stub' AS source, 'stub' AS model
FROM banded, anomaly_line"""

_CONTEXT = """
SELECT coalesce(customer_id, 'Unknown') AS customer_id, coalesce(segment, 'Unknown') AS segment,
  coalesce(channel, 'Unknown') AS channel, coalesce(sentiment_text, 'neutral') AS sentiment,
  coalesce(engagement_score, 0e0) AS engagement_score, coalesce(complaint_flag, 0) AS complaint_flag,
  coalesce(escalation_flag, 0) AS escalation_flag, coalesce(days_since_last_contact, 0) AS days_since_contact,
  0e0 AS intervention_score, 'Unknown' AS risk_band, 'none' AS anomaly_summary
FROM raw"""

_HISTOGRAM = """
SELECT r.range AS bin, r.range / 40e0 AS lower, (r.range + 1) / 40e0 AS upper, coalesce(n, 0) AS n
FROM range(40) r LEFT JOIN (
  SELECT least(CAST(floor(engagement_score * 40) AS BIGINT), 39) AS bin, count(*) AS n
  FROM comm WHERE engagement_score BETWEEN 0 AND 1 GROUP BY 1
) h ON h.bin = r.range"""

CASE_COLUMNS = (
    "customer_id, segment, channel, campaign_id, engagement_score, complaint_flag, escalation_flag,"
    " days_since_last_contact, needs_intervention"
)


def _yes_no(name: str) -> str:
    return f"CASE WHEN {name} <> 0 THEN 'Yes' ELSE 'No' END"


_LOOKUP = (
    "SELECT customer_id, engagement_score, tenure_months, days_since_last_contact,"
    f" {_yes_no('opt_out_flag')} AS opt_out, {_yes_no('complaint_flag')} AS complaint,"
    f" {_yes_no('escalation_flag')} AS escalation FROM comm"
    " WHERE customer_id = (SELECT min(customer_id) FROM comm WHERE needs_intervention = 1)"
)

ORACLES: dict[str, str] = {
    "comm_scan": cases("SELECT * FROM comm"),
    "row_count": cases("SELECT count(*) AS n FROM comm"),
    "limit_scan": cases("SELECT * FROM comm ORDER BY customer_id LIMIT 50"),
    "param_query": cases(
        "SELECT campaign_id, count(*) AS n, count(*) FILTER (WHERE opened = 1) AS opened FROM comm"
        " WHERE segment = 'Basic' AND engagement_score < 0.25e0 GROUP BY campaign_id"
    ),
    "dq_nulls": _dq_nulls(),
    "dq_binary": _dq_binary(),
    "dq_domain": _dq_domain(),
    "dq_ranges": _dq_ranges(),
    "dq_stats": _dq_stats(),
    "dq_report": _dq_report(),
    "admission_split": _admission(),
    "clean_rows": raw(f"SELECT {', '.join(COLUMNS)} FROM stripped", STRIPPED),
    "dedup_cases": _dedup(),
    "engagement_score": cases("SELECT customer_id, engagement_score FROM comm"),
    "intervention_rule": cases("SELECT customer_id, needs_intervention FROM comm"),
    "sentiment_band": cases("SELECT customer_id, sentiment_text AS sentiment FROM comm"),
    "risk_band": cases(
        "SELECT customer_id, intervention_score, predicted_intervention, risk_band FROM banded", STAND_IN
    ),
    "interaction_features": cases(f"SELECT customer_id, {INTERACTIONS} FROM comm"),
    "one_hot": cases(f"SELECT customer_id, {ONE_HOT} FROM comm"),
    "features": cases(f"SELECT customer_id, {PASSED}, {INTERACTIONS}, {ONE_HOT}, needs_intervention FROM comm"),
    "stratified_split": cases(
        "SELECT customer_id, needs_intervention, CASE WHEN slot = 0 THEN 'test' ELSE 'train' END AS part, slot"
        " FROM slotted",
        SPLIT,
    ),
    "cv_folds": cases(
        "SELECT slot AS fold, needs_intervention AS label, count(*) AS n, min(customer_id) AS first_id,"
        " max(customer_id) AS last_id FROM slotted WHERE slot > 0 GROUP BY ALL",
        SPLIT,
    ),
    "class_weights": cases(
        f"SELECT label, rows, {r4('sum(rows) OVER () / (count(*) OVER () * rows)', 6)} AS weight"
        " FROM (SELECT needs_intervention AS label, count(*) AS rows FROM comm GROUP BY 1)"
    ),
    "roc_auc": cases(ROC_AUC, STAND_IN),
    "confusion_matrix": cases(
        "SELECT tn AS true_negatives, fp AS false_positives, fn AS false_negatives, tp AS true_positives FROM matrix",
        STAND_IN,
        MATRIX,
    ),
    "classification_report": cases(
        _report_row(0, "tn", "fp", "fn") + " UNION ALL " + _report_row(1, "tp", "fn", "fp"), STAND_IN, MATRIX
    ),
    "risk_band_counts": cases("SELECT risk_band, count(*) AS n FROM banded GROUP BY risk_band", STAND_IN),
    "segment_weeks": cases("SELECT * FROM weeks", WEEKS),
    "segment_drop": cases("SELECT * EXCLUDE (flagged) FROM weeks WHERE flagged", WEEKS),
    "complaint_days": cases("SELECT * FROM days", DAYS),
    "complaint_spike": cases("SELECT * EXCLUDE (flagged) FROM days WHERE flagged", DAYS),
    "campaign_scorecard": cases("SELECT * FROM campaigns", CAMPAIGNS),
    "campaign_underperformance": cases(f"SELECT {CAMPAIGN_COLUMNS} FROM campaigns WHERE flagged", CAMPAIGNS),
    "detector_status": cases("SELECT detector, flagged, summary, metadata, n_flagged, anomalies FROM status", *DETECTORS),
    "detector_items": cases("SELECT detector, position, item, fields FROM items", *DETECTORS),
    "detector_rollup": cases(
        "SELECT bool_or(flagged) AS any_flagged, count(*) FILTER (WHERE flagged) AS total_flagged FROM status",
        *DETECTORS,
    ),
    "anomaly_text": cases("SELECT anomaly_text FROM anomaly_line", *DETECTORS),
    "kpis": cases(
        f"SELECT count(*) AS total_records, {r4('avg(needs_intervention)')} AS intervention_rate,"
        f" {r4('avg(engagement_score)')} AS avg_engagement, {r4('avg(complaint_flag)')} AS complaint_rate,"
        f" {r4('avg(escalation_flag)')} AS escalation_rate, {r4('avg(opt_out_flag)')} AS opt_out_rate FROM comm"
    ),
    "engagement_histogram": cases(_HISTOGRAM),
    "segment_rate": cases(
        f"SELECT segment, {r4('avg(needs_intervention)')} AS intervention_rate FROM comm GROUP BY segment"
    ),
    "channel_breakdown": cases(
        f"SELECT channel, count(customer_id) AS total, {r4('avg(needs_intervention)')} AS intervention"
        " FROM comm GROUP BY channel"
    ),
    "sentiment_mix": cases("SELECT sentiment_text, count(*) AS n FROM comm GROUP BY sentiment_text"),
    "daily_complaints": cases(
        "SELECT sent_date AS date, CAST(sum(complaint_flag) AS BIGINT) AS complaints, count(complaint_flag) AS total,"
        f" {r4('sum(complaint_flag) / count(complaint_flag)')} AS rate FROM comm GROUP BY sent_date"
    ),
    "open_rate_heatmap": cases(
        "SELECT campaign_id, "
        + ", ".join(
            f"{r4(f"avg(opened) FILTER (WHERE segment = '{s}')")} AS \"{s}\"" for s in ("Basic", "Premium", "Standard")
        )
        + " FROM comm GROUP BY campaign_id"
    ),
    "top_spikes": cases("SELECT date, zscore FROM days WHERE flagged ORDER BY zscore DESC, date LIMIT 3", DAYS),
    "distinct_values": cases(
        "SELECT DISTINCT 'segment' AS column_name, segment AS value FROM comm"
        " UNION ALL SELECT DISTINCT 'channel', channel FROM comm"
    ),
    "case_filter": cases(
        f"SELECT {CASE_COLUMNS} FROM comm WHERE segment IN ('Premium', 'Basic') AND channel IN ('Email', 'Phone')"
        " AND needs_intervention = 1 ORDER BY customer_id LIMIT 200"
    ),
    "candidate_cases": cases(
        "SELECT customer_id FROM comm WHERE needs_intervention = 1 ORDER BY customer_id LIMIT 100"
    ),
    "case_lookup": cases(_LOOKUP),
    "csv_cases": cases("SELECT * FROM comm"),
    "json_cases": cases("SELECT * FROM comm"),
    "ingested_cases": cases("SELECT * FROM comm"),
    "append_batches": cases(
        "SELECT CASE WHEN opened = 1 THEN 'opened' ELSE 'unopened' END AS batch, count(*) AS n,"
        " CAST(sum(tenure_months) AS BIGINT) AS months FROM comm GROUP BY 1"
    ),
    "bucket_lookup": cases(_LOOKUP),
    "dedup_few": _dedup(),
    "dq_missing_columns": "SELECT 'required_columns' AS check_name, CAST(NULL AS VARCHAR) AS column_name,"
    " 'error' AS severity, CAST(2 AS BIGINT) AS failures,"
    " 'Missing required columns: [''segment'', ''channel'']' AS detail",
    "lenient_dates": f"WITH {RAW_BAD_DATES} SELECT customer_id, sent_date, TRY_CAST(sent_date AS DATE) AS day FROM raw",
    "default_columns": cases("SELECT customer_id, 'Auto' AS product_type, segment FROM comm"),
    "scoring_features": cases(
        f"SELECT customer_id, {PASSED}, {INTERACTIONS}, {ONE_HOT} FROM (SELECT * REPLACE ('Email' AS channel) FROM comm)"
    ),
    "aligned_features": cases(
        "SELECT customer_id, opened, 0 AS no_such_feature,"
        " CASE WHEN complaint_flag = 1 AND escalation_flag = 1 THEN 1 ELSE 0 END AS high_risk_combo FROM comm"
    ),
    "detector_choice": cases(
        "SELECT detector, flagged, summary, n_flagged FROM status WHERE detector = 'complaint_spike'", *DETECTORS
    ),
    "rollup_status": cases("SELECT detector, flagged, summary, n_flagged FROM status", *DETECTORS),
    "sample_texts": cases(
        f"SELECT s.* FROM ({_SUMMARY.replace('banded, anomaly_line', "banded, (SELECT '' AS anomaly_text)")}) s"
        " WHERE customer_id IN (SELECT min(customer_id) FROM comm GROUP BY needs_intervention)",
        STAND_IN,
    ),
    "unscored_cases": cases("SELECT customer_id, 0e0 AS intervention_score, 'Unknown' AS risk_band FROM comm"),
    "case_context": raw(_CONTEXT),
    "case_prompts": cases(_PROMPT, STAND_IN, *DETECTORS),
    "case_summaries": cases(_SUMMARY, STAND_IN, *DETECTORS),
    "train_metrics": cases(
        "SELECT rows, positives, CASE WHEN positives > 0 AND negatives > 0 THEN 1e0 END AS roc_auc, 1e0 AS accuracy,"
        " 1e0 AS precision, 1e0 AS recall, 1e0 AS f1, 0.45e0 AS threshold FROM tested",
        SPLIT,
        TESTED,
    ),
    "cross_validation": cases(
        "SELECT slot AS fold, count(*) AS rows, count(*) FILTER (WHERE needs_intervention = 1) AS positives,"
        " true AS ranks_well FROM slotted WHERE slot > 0 GROUP BY slot",
        SPLIT,
    ),
    "feature_importance": "SELECT name AS feature, CAST(position AS BIGINT) AS position, true AS is_share FROM ("
    f"SELECT unnest({FEATURES}) AS name, unnest(range(1, {len(FEATURES) + 1})) AS position)",
    "forest_checks": cases(
        f"SELECT 100 AS trees, {len(FEATURES)} AS features, rows, positives, true AS ranks_well, true AS decides_well"
        " FROM tested",
        SPLIT,
        TESTED,
    ),
    "score_batch": cases(
        f"SELECT {', '.join(COLUMNS)}, intervention_score, predicted_intervention, risk_band FROM banded", RULED
    ),
    "scored_cases": cases(
        f"SELECT {CASE_COLUMNS}, intervention_score, risk_band FROM banded WHERE segment IN ('Premium', 'Basic')"
        " AND channel IN ('Email', 'Phone') ORDER BY customer_id LIMIT 200",
        RULED,
    ),
    "score_requests": _requests(),
    "scored_summaries": cases(_SUMMARY, RULED, *DETECTORS),
}
