"""DuckDB SQL for every registered query: the independent oracle the Spark results are checked
against.  The CTEs restate ``lendflow.sources.derived`` in SQL; keep the two in step.

Conventions that make the two engines agree value for value:
* money stays DECIMAL(18,2); ratios and the amortisation power are DOUBLE;
* every double in an output is rounded; counts are cast to BIGINT;
* regexp_replace takes the 'g' flag (Spark replaces every match);
* word boundaries in the scope guard are spelled out (see ``functions.text``).
"""

from __future__ import annotations

from lendflow import params as P
from lendflow.sources.derived import PROBE_PROMPTS


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


# --- derived views -------------------------------------------------------------------------------
APPS = """
tx AS (
  SELECT l_orderkey, CAST(SUM(CAST(l_extendedprice AS DECIMAL(18,2))) AS DECIMAL(18,2)) AS spend
  FROM lineitem GROUP BY l_orderkey),
apps AS (
  SELECT 'APP-' || CAST(o_orderkey AS VARCHAR) AS application_id,
         c_name AS applicant_name,
         CAST(CAST(90000 AS DOUBLE) + CAST(18 AS DOUBLE) * c_acctbal AS DECIMAL(18,2)) AS gross_annual_income,
         CAST(1500 + (o_orderkey % 21) * 100 AS DECIMAL(18,2)) AS declared_living_expenses,
         CAST(CAST(100000 AS DOUBLE) + CAST(3 AS DOUBLE) * o_totalprice AS DECIMAL(18,2)) AS requested_loan_amount,
         CAST(CAST(125000 AS DOUBLE) + CAST(4 AS DOUBLE) * o_totalprice AS DECIMAL(18,2)) AS property_valuation,
         CAST(CAST(550 + (o_orderkey % 5) * 25 AS DOUBLE) / CAST(10000 AS DOUBLE) AS DECIMAL(9,6)) AS base_interest_rate,
         CAST((o_custkey % 4) * 300 AS DECIMAL(18,2)) AS existing_debts_monthly,
         CAST(900 + COALESCE(spend, CAST(0 AS DECIMAL(18,2))) * CAST(0.01 AS DECIMAL(2,2)) AS DECIMAL(18,2))
           AS cdr_verified_expenses_monthly,
         CASE WHEN o_orderkey % 3 = 0 THEN NULL
              ELSE 'Applicant ' || c_name || ' asks for priority ' || o_orderpriority || '; contact '
                   || lower(replace(c_name, '#', '.')) || '@mail.example.com' END AS applicant_notes,
         c_mktsegment AS segment,
         o_orderdate AS submitted_at,
         o_orderkey AS okey
  FROM orders LEFT JOIN tx ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey)"""

# Metric columns over a relation with the application schema; {src} names it.
METRICS = """
{name}_raw AS (
  SELECT *,
    (CAST(requested_loan_amount AS DOUBLE) + CAST(existing_debts_monthly AS DOUBLE) * CAST(12 AS DOUBLE)
       * CAST({debt_years} AS DOUBLE)) / CAST(gross_annual_income AS DOUBLE) AS dti_raw,
    CAST(greatest(declared_living_expenses, cdr_verified_expenses_monthly, CAST({hem} AS DECIMAL(18,2)))
       AS DECIMAL(18,2)) AS applicable_monthly_expense,
    CAST(cdr_verified_expenses_monthly - declared_living_expenses AS DECIMAL(18,2)) AS expense_discrepancy,
    CAST(base_interest_rate AS DOUBLE) + CAST({buffer} AS DOUBLE) AS srate
  FROM {src}),
{name}_g AS (
  SELECT *, srate / CAST(12 AS DOUBLE) AS mrate,
         pow(CAST(1 AS DOUBLE) + srate / CAST(12 AS DOUBLE), CAST({months} AS DOUBLE)) AS growth
  FROM {name}_raw),
{name} AS (
  SELECT *,
    round(dti_raw, 2) AS calculated_dti,
    CAST({dti_limit} AS DOUBLE) AS apra_limit,
    CASE WHEN dti_raw >= CAST({dti_limit} AS DOUBLE) THEN 'BREACH' ELSE 'PASS' END AS dti_status,
    CASE WHEN expense_discrepancy > CAST({tol} AS DECIMAL(18,2)) THEN 'BREACH' ELSE 'PASS' END AS expense_status,
    round(srate, 4) AS stressed_interest_rate,
    round(repay, 2) AS stressed_monthly_repayment,
    round(surplus, 2) AS net_monthly_surplus,
    CASE WHEN surplus < 0 THEN 'BREACH' ELSE 'PASS' END AS serviceability_status
  FROM (SELECT *,
          CAST(gross_annual_income AS DOUBLE) * CAST({net_ratio} AS DOUBLE) / CAST(12 AS DOUBLE)
            - CAST(applicable_monthly_expense AS DOUBLE) - CAST(existing_debts_monthly AS DOUBLE) - repay AS surplus
        FROM (SELECT *, CASE WHEN mrate = 0 THEN CAST(requested_loan_amount AS DOUBLE) / CAST({months} AS DOUBLE)
                        ELSE CAST(requested_loan_amount AS DOUBLE) * (mrate * growth) / (growth - CAST(1 AS DOUBLE)) END AS repay
              FROM {name}_g)))"""


def metrics_cte(src: str = "apps", name: str = "m", p=P.DEFAULT_POLICY) -> str:
    return METRICS.format(src=src, name=name, debt_years=p.debt_years, hem=p.hem, buffer=p.buffer,
                          months=p.months, dti_limit=p.dti_limit, tol=p.expense_tolerance,
                          net_ratio=p.net_ratio)


# Number echo (see functions.text): input amounts and values rounded to 2 places.
def fmt_in(x: str) -> str:
    return f"regexp_replace(CAST(CAST({x} AS DECIMAL(18,2)) AS VARCHAR), '[.]?0+$', '')"


def fmt_calc(x: str) -> str:
    return f"regexp_replace(CAST(CAST({x} AS DECIMAL(18,2)) AS VARCHAR), '([.][0-9])0$', '\\1')"


POLICY = """
pol AS (
  SELECT *,
    list_filter([
      CASE WHEN dti_status = 'BREACH' THEN 'DTI Breach: ' || {dti} || 'x (Ceiling: ' || {lim} || 'x)' END,
      CASE WHEN expense_status = 'BREACH' THEN 'Living Expense Discrepancy: Declared $' || {decl}
           || ' vs Actual $' || {act} END,
      CASE WHEN serviceability_status = 'BREACH' THEN 'Net Serviceability Deficit: Stressed surplus is -$'
           || {surp} || '/mo at stressed rate of ' || printf('%.2f', stressed_interest_rate * CAST(100 AS DOUBLE)) || '%' END
    ], lambda x: x IS NOT NULL) AS policy_breaches,
    list_filter([
      CASE WHEN dti_status = 'BREACH' THEN 'DTI' END,
      CASE WHEN expense_status = 'BREACH' THEN 'EXPENSE' END,
      CASE WHEN serviceability_status = 'BREACH' THEN 'SERVICEABILITY' END
    ], lambda x: x IS NOT NULL) AS breach_codes
  FROM m),
assessed AS (
  SELECT *, CASE WHEN len(policy_breaches) > 0 THEN 'ESCALATED_REFERRAL' ELSE 'AUTO_APPROVE' END
            AS system_recommendation
  FROM pol)""".format(
    dti=fmt_calc("calculated_dti"), lim=fmt_calc("apra_limit"),
    decl=fmt_in("declared_living_expenses"), act=fmt_in("cdr_verified_expenses_monthly"),
    surp=fmt_calc("abs(net_monthly_surplus)"),
)


def with_ctes(*ctes: str, body: str) -> str:
    return "WITH " + ",".join(ctes) + "\n" + body


ASSESSED = (APPS, metrics_cte(), POLICY)


# --- ledger, decisions, directory, completions, chat ---------------------------------------------
LEDGER = f"""
led AS (
  SELECT event_id,
    CASE WHEN event_type IN ('purchase', 'view') THEN 'SYSTEM' ELSE 'HUMAN' END AS event_type,
    'APP-' || CAST(user_id AS VARCHAR) AS application_id,
    '{P.MASKED_PERSON}' AS applicant_name,
    CASE WHEN event_type = 'purchase' THEN 'AUTO_APPROVE' ELSE 'ESCALATED_REFERRAL' END AS system_recommendation,
    round(value / CAST(5 AS DOUBLE), 2) AS calculated_dti,
    round(CAST(1500 AS DOUBLE) - value * CAST(40 AS DOUBLE), 2) AS net_monthly_surplus,
    CASE WHEN event_type = 'purchase' THEN 'NONE' ELSE 'Net Serviceability Deficit' END AS policy_breaches,
    CASE WHEN event_type = 'purchase' THEN 'SYSTEM_AUTO_EXECUTION' WHEN event_type = 'view' THEN 'PENDING_REVIEW'
         ELSE 'uw_' || CAST(event_id % 7 AS VARCHAR) END AS underwriter_id,
    CASE event_type WHEN 'purchase' THEN 'AUTO_APPROVED' WHEN 'signup' THEN 'APPROVED_OVERRIDE' WHEN 'error' THEN 'DECLINED'
         WHEN 'view' THEN 'PENDING_REVIEW' WHEN 'click' THEN 'INFO_REQUESTED' END AS underwriter_decision,
    CASE WHEN event_type = 'purchase' THEN {_q(P.AUTO_NOTES)} WHEN event_type = 'view' THEN 'N/A'
         ELSE props END AS underwriter_notes,
    ts AS "timestamp",
    CAST(ts AS DATE) AS dt
  FROM events)"""

LATEST = """
lat AS (
  SELECT * EXCLUDE (rn) FROM (
    SELECT *, row_number() OVER (PARTITION BY application_id ORDER BY "timestamp" DESC, event_id DESC) AS rn
    FROM led) WHERE rn = 1)"""

LEDGER_OUT = ('event_id, event_type, application_id, applicant_name, system_recommendation, calculated_dti, '
              'net_monthly_surplus, policy_breaches, underwriter_id, underwriter_decision, underwriter_notes, '
              '"timestamp"')
STATE_OUT = ('application_id, system_recommendation, calculated_dti, net_monthly_surplus, policy_breaches, '
             'underwriter_id, underwriter_decision, underwriter_notes')

DECISIONS = """
dec AS (
  SELECT event_id AS decision_id, 'APP-' || CAST(user_id AS VARCHAR) AS application_id,
    CASE WHEN event_id % 11 = 0 THEN 'MAYBE' WHEN event_type = 'signup' THEN 'APPROVED_OVERRIDE'
         ELSE 'DECLINED' END AS decision,
    CASE event_id % 3 WHEN 0 THEN props WHEN 1 THEN '    ' || props || '  '
         ELSE event_type || ' ' || props END AS notes,
    'uw_' || CAST(user_id % 5 AS VARCHAR) AS underwriter_id,
    CASE WHEN event_id % 2 = 0 THEN ts - INTERVAL 2 HOUR ELSE ts + INTERVAL 2 HOUR END AS event_ts
  FROM events WHERE event_type IN ('signup', 'error'))"""


# White space as str.strip() knows it.
_WS = "[\\t\\n\\x0B\\f\\r\\x1C-\\x1F \\x{85}\\x{A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}]"


def strip(x: str) -> str:
    return f"regexp_replace(regexp_replace({x}, '^{_WS}+', ''), '{_WS}+$', '')"


GATE = f"""
dv AS (
  SELECT *, CASE WHEN decision = 'APPROVED_OVERRIDE' THEN 'APPROVE' ELSE 'DECLINE' END AS action,
         {strip("notes")} AS clean_notes
  FROM dec),
seen AS (
  SELECT * EXCLUDE (rn) FROM (
    SELECT d.decision_id, l.event_id AS seen_event_id, l.underwriter_decision AS seen_decision,
           row_number() OVER (PARTITION BY d.decision_id ORDER BY l."timestamp" DESC, l.event_id DESC) AS rn
    FROM dec d JOIN led l ON l.application_id = d.application_id
         AND (l."timestamp" < d.event_ts OR (l."timestamp" = d.event_ts AND l.event_id < d.decision_id)))
  WHERE rn = 1),
dv2 AS (
  SELECT dv.*, seen_event_id, coalesce(length(clean_notes) >= 10, false) AS notes_valid,
    CASE WHEN NOT coalesce(length(clean_notes) >= 10, false) THEN 'notes_too_short'
         WHEN decision NOT IN ('AUTO_APPROVED', 'PENDING_REVIEW', 'APPROVED_OVERRIDE', 'DECLINED',
                               'APPROVED_WITH_EXCEPTION', 'INFO_REQUESTED') THEN 'unknown_decision'
         WHEN coalesce(seen_decision, '') <> 'PENDING_REVIEW' THEN 'not_pending' END AS reject_reason
  FROM dv LEFT JOIN seen ON dv.decision_id = seen.decision_id),
passed AS (SELECT * FROM dv2 WHERE reject_reason IS NULL),
acc AS (
  SELECT * EXCLUDE (rn) FROM (
    SELECT *, row_number() OVER (PARTITION BY application_id, seen_event_id ORDER BY event_ts, decision_id) AS rn
    FROM passed)
  WHERE rn = 1),
new AS (
  SELECT * EXCLUDE (rn) FROM (
    SELECT *, row_number() OVER (PARTITION BY application_id ORDER BY event_ts DESC, decision_id DESC) AS rn FROM acc)
  WHERE rn = 1),
upd AS (
  SELECT l.event_id, l.event_type, l.application_id, l.applicant_name, l.system_recommendation,
         l.calculated_dti, l.net_monthly_surplus, l.policy_breaches,
         CASE WHEN a.hit THEN a.underwriter_id ELSE l.underwriter_id END AS underwriter_id,
         CASE WHEN a.hit THEN a.decision ELSE l.underwriter_decision END AS underwriter_decision,
         CASE WHEN a.hit THEN a.clean_notes ELSE l.underwriter_notes END AS underwriter_notes,
         l."timestamp"
  FROM led l LEFT JOIN (SELECT *, true AS hit FROM new) a ON l.application_id = a.application_id
       AND (l."timestamp" < a.event_ts OR (l."timestamp" = a.event_ts AND l.event_id < a.decision_id)))"""

RESET = """
rst AS (
  SELECT event_id, event_type, application_id, applicant_name, system_recommendation, calculated_dti,
    net_monthly_surplus, policy_breaches,
    CASE WHEN system_recommendation != 'AUTO_APPROVE' THEN 'PENDING_REVIEW' ELSE underwriter_id END AS underwriter_id,
    CASE WHEN system_recommendation != 'AUTO_APPROVE' THEN 'PENDING_REVIEW' ELSE underwriter_decision END
      AS underwriter_decision,
    CASE WHEN system_recommendation != 'AUTO_APPROVE' THEN 'N/A' ELSE underwriter_notes END AS underwriter_notes,
    "timestamp"
  FROM led)"""

DIRECTORY = """
dir AS (
  SELECT 'APP-' || CAST(o_orderkey AS VARCHAR) AS application_id,
         CASE WHEN o_orderkey % 11 = 0 THEN c_name || ' Jr' ELSE c_name END AS real_name
  FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderkey % 7 != 0)"""

DIRTY = """
dirty AS (
  SELECT * REPLACE (
    CASE WHEN okey % 97 = 0 THEN NULL WHEN okey % 89 = 0 THEN CAST(0 AS DECIMAL(18,2))
         ELSE gross_annual_income END AS gross_annual_income,
    CASE WHEN okey % 83 = 0 THEN '   ' WHEN okey % 79 = 0 THEN NULL ELSE applicant_name END AS applicant_name,
    CASE WHEN okey % 73 = 0 THEN CAST(-0.03 AS DECIMAL(9,6)) ELSE base_interest_rate END AS base_interest_rate)
  FROM apps)"""


def is_blank(x: str) -> str:
    return f"({x} IS NULL OR length({strip(x)}) = 0)"


# This engine has no lookaround: edges are captured and put back, twice, as neighbours share one.
_NUMBERS = (
    ("[0-9]{4}(?:[ -]?[0-9]{4}){3}", "<CARD>"),
    ("(?:[+]?[0-9]{1,2} ?)?[(][0-9]{3}[)] ?[0-9]{3}-[0-9]{4}|(?:[+]?61 ?)?[(]0?[2378][)](?:[ -]?[0-9]{4}){2}"
     "|(?:[+]61 ?|0)[2378](?:[ -]?[0-9]{4}){2}|(?:[+]61 ?|0)4[0-9]{2}(?:[ -]?[0-9]{3}){2}"
     "|1[38]00(?:[ -]?[0-9]{3}){2}|13(?: ?[0-9]{2}){2}", "<PHONE>"),
)


def mask_pii(x: str) -> str:
    out = f"regexp_replace({x}, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+[.][A-Za-z]{{2,}}', '<EMAIL>', 'g')"
    for pattern, token in _NUMBERS:
        for _ in range(2):
            out = f"regexp_replace({out}, '(^|[^0-9])(?:{pattern})([^0-9]|$)', '\\1{token}\\2', 'g')"
    return out


def mask_name(x: str) -> str:
    return f"CASE WHEN {is_blank(x)} THEN {_q(P.REDACTED_PERSON)} ELSE {_q(P.MASKED_PERSON)} END"


def mask_text(text: str, name: str) -> str:
    return mask_own(mask_pii(text), name)


def mask_own(text: str, name: str) -> str:
    """A name's words are tried after the whole of it, as whole words in any case."""
    quoted = f"regexp_escape(trim({name}))"
    words = f"list_filter(string_split(trim({name}), ' '), lambda w: length(w) > 1)"
    either = f"array_to_string(list_prepend({quoted}, list_transform({words}, lambda w: regexp_escape(w))), '|')"
    out = text
    for _ in range(2):
        out = (f"regexp_replace({out}, '([^\\pL\\pN]|^)(?:' || {either} || ')([^\\pL\\pN]|$)', "
               f"'\\1{P.MASKED_PERSON}\\2', 'gi')")
    return f"CASE WHEN {is_blank(name)} THEN {text} ELSE {out} END"


def people_ctes(view: str, ident: str, text: str, tag: str) -> str:
    """Occurrences of directory names in a view's texts, every run of words of every name's length compared:
    ``{tag}_occ`` (ident, j: first word from 1, n, person).  Needs the directory."""
    return f"""
{tag}_names AS (
  SELECT DISTINCT array_to_string(ws, ' ') AS person, len(ws) AS n
  FROM (SELECT list_transform(regexp_extract_all(real_name, '[\pL\pN]+'), lambda w: lower(w)) AS ws FROM dir) WHERE len(ws) > 0),
{tag}_words AS (
  SELECT {ident}, list_transform(regexp_extract_all({text}, '[\pL\pN]+'), lambda w: lower(w)) AS ws FROM {view}),
{tag}_grams AS (
  SELECT {ident}, n, unnest(list_transform(generate_series(1, len(ws) - n + 1), lambda j:
    {{'j': j, 'person': array_to_string(list_slice(ws, j, j + n - 1), ' ')}}), recursive := true)
  FROM {tag}_words, (SELECT DISTINCT n FROM {tag}_names) WHERE len(ws) >= n),
{tag}_occ AS (
  SELECT g.{ident}, g.j, g.n, g.person FROM {tag}_grams g JOIN {tag}_names USING (person, n))"""


def masked_ctes(view: str, ident: str, text: str, tag: str) -> str:
    """``{tag}_masked`` (ident, masked): a word inside an occurrence goes, and the first of a stretch becomes the
    token; what stands before a word goes with it when one occurrence holds the word before as well."""
    return people_ctes(view, ident, text, tag) + f""",
{tag}_cover AS (
  SELECT {ident}, k, bool_or(k > j) AS tied
  FROM (SELECT {ident}, j, unnest(generate_series(j, j + n - 1)) AS k FROM {tag}_occ) GROUP BY {ident}, k),
{tag}_parts AS (
  SELECT {ident}, unnest(list_transform(generate_series(1, len(ws)), lambda i: {{'k': i, 'w': ws[i], 'gap': gaps[i]}}), recursive := true)
  FROM (SELECT {ident}, regexp_extract_all({text}, '[\pL\pN]+') AS ws, string_split_regex({text}, '[\pL\pN]+') AS gaps
        FROM {view} WHERE {ident} IN (SELECT {ident} FROM {tag}_occ))),
{tag}_joined AS (
  SELECT {ident}, string_agg(CASE WHEN c.tied THEN '' WHEN c.k IS NOT NULL THEN gap || '{P.MASKED_PERSON}' ELSE gap || w END, '' ORDER BY p.k) AS body
  FROM {tag}_parts p LEFT JOIN {tag}_cover c USING ({ident}, k) GROUP BY {ident}),
{tag}_masked AS (
  SELECT v.{ident}, coalesce(j.body || list_last(string_split_regex(v.{text}, '[\pL\pN]+')), v.{text}) AS masked
  FROM {view} v LEFT JOIN {tag}_joined j USING ({ident}))"""


# The guard's patterns, written out: family, strict and fixed form.
_L, _R, _IN = r"(^|[^\p{L}\p{N}_])", r"([^\p{L}\p{N}_]|$)", r"[\p{L}\p{N}_]"


def _words(*terms: str) -> str:
    return "|".join(f"{_L}{t}{_R}" for t in terms)


_CODE = ("python", "javascript", "java")
_CODE_MORE = ("bash", "powershell", "sql query", "html", "css")
_GUARD = {
    "strict": (("code", _words(*_CODE) + rf"|{_L}c\+\+{_IN}|" + _words(*_CODE_MORE)),
               ("code_request", _words("write a script", "write code", "generate code", "function to", "while loop", "for loop")),
               ("jailbreak", _words("ignore previous instructions", "system prompt", "jailbreak", "DAN mode", "bypass")),
               ("off_topic", _words("poem", "story", "recipe", "joke", "translate to"))),
    "fixed": (("code", _words(*_CODE, r"c\+\+", *_CODE_MORE)),
              ("code_request", _words("write a script", "write code", "generate code", "function to", "while loop", "for loop")),
              ("jailbreak", _words("ignore previous instructions", "system prompt", "jailbreak", "dan mode", "bypass")),
              ("off_topic", _words("poem", "story", "recipe", "joke", "translate to"))),
}


def scope_family(x: str, mode: str) -> str:
    parts = " ".join(f"WHEN regexp_matches(lower({x}), {_q(p)}) THEN {_q(n)}" for n, p in _GUARD[mode])
    return f"CASE {parts} END"


CHAT = "chat AS (SELECT conv_id, turn, role, CASE WHEN role = 'user' THEN text || ' ' || ({probes})[" \
       "CAST((conv_id + turn) % {n} AS INTEGER) + 1] ELSE text END AS text FROM conversations)".format(
           probes="[" + ", ".join(_q(p) for p in PROBE_PROMPTS) + "]", n=len(PROBE_PROMPTS))

COMPLETIONS = """
comp AS (
  SELECT 'APP-' || CAST(doc_id AS VARCHAR) AS application_id,
    CASE WHEN doc_id % 5 = 1 THEN list_transform(string_split(text, chr(10) || chr(10)), lambda x: {'text': x}) END
      AS blocks,
    CASE WHEN doc_id % 5 >= 2 THEN text END AS plain,
    CASE WHEN doc_id % 5 = 0 THEN 'DeadlineExceeded: model call timed out' END AS error
  FROM documents)"""


def render_sql(template: str, values: dict) -> str:
    """SQL concatenation of a ``{name}`` template (the same fixed text the Spark side renders)."""
    import string
    parts = []
    for literal, field, _, _ in string.Formatter().parse(template):
        if literal:
            parts.append(_q(literal))
        if field is not None:
            parts.append(f"({values[field]})")
    return " || ".join(parts)


def flatten(blocks: str, plain: str, sep: str = "") -> str:
    joined = f"array_to_string(list_transform({blocks}, lambda b: coalesce(b.text, '')), {_q(sep)})"
    return strip(f"coalesce({plain}, {joined})")


SCENARIO_VALUES = None  # filled in oracle_sql from queries.SCENARIOS


# --- queries -------------------------------------------------------------------------------------
def oracle_sql() -> dict[str, str]:
    from lendflow.plans.queries import KNN_K, LEXICAL_K, POINT_ID, RUN_TS, SCENARIOS, SURFACE
    q: dict[str, str] = {}
    run_ts = f"TIMESTAMP '{RUN_TS.isoformat(sep=' ')}'"

    q["app_metrics"] = with_ctes(APPS, metrics_cte(), body="""
SELECT application_id, calculated_dti, dti_status, CAST(applicable_monthly_expense AS DOUBLE) AS applicable_monthly_expense,
       CAST(expense_discrepancy AS DOUBLE) AS expense_discrepancy,
       expense_status, stressed_interest_rate, stressed_monthly_repayment, net_monthly_surplus,
       serviceability_status
FROM m""")

    q["breach_messages"] = with_ctes(*ASSESSED, body="""
SELECT application_id, CAST(len(breach_codes) AS INTEGER) AS n_breaches, array_to_string(breach_codes, ',') AS breach_codes,
       array_to_string(policy_breaches, chr(10)) AS policy_breaches
FROM assessed""")

    q["recommendation_counts"] = with_ctes(*ASSESSED, body="""
SELECT system_recommendation, array_to_string(breach_codes, ',') AS breach_key, CAST(count(*) AS BIGINT) AS n_applications
FROM assessed GROUP BY ALL""")

    q["auto_approve_rows"] = with_ctes(*ASSESSED, body=f"""
SELECT application_id,
  'Application ' || application_id || ' meets all APRA and ASIC credit policies. Clean auto-approval granted.' AS ai_risk_memo,
  '{P.SYSTEM_UNDERWRITER}' AS underwriter_id, '{P.AUTO_APPROVED}' AS underwriter_decision,
  {_q(P.AUTO_NOTES)} AS underwriter_notes
FROM assessed WHERE len(policy_breaches) = 0""")

    audit = f"""
SELECT application_id, {mask_name("applicant_name")} AS applicant_name, system_recommendation, calculated_dti,
  net_monthly_surplus,
  CASE WHEN len(policy_breaches) > 0 THEN array_to_string(policy_breaches, '; ') ELSE 'NONE' END AS policy_breaches,
  CASE WHEN len(policy_breaches) = 0 THEN '{P.SYSTEM_UNDERWRITER}' ELSE 'PENDING_REVIEW' END AS underwriter_id,
  CASE WHEN len(policy_breaches) = 0 THEN '{P.AUTO_APPROVED}' ELSE 'PENDING_REVIEW' END AS underwriter_decision,
  CASE WHEN len(policy_breaches) = 0 THEN {_q(P.AUTO_NOTES)} ELSE 'N/A' END AS underwriter_notes,
  {run_ts} AS "timestamp"
FROM assessed"""
    q["audit_rows"] = with_ctes(*ASSESSED, body=audit)

    rep = ("CASE WHEN ({r}) = 0 THEN CAST(requested_loan_amount AS DOUBLE) / CAST({n} AS DOUBLE) ELSE "
           "CAST(requested_loan_amount AS DOUBLE) * (({r}) * pow(CAST(1 AS DOUBLE) + ({r}), CAST({n} AS DOUBLE))) / "
           "(pow(CAST(1 AS DOUBLE) + ({r}), CAST({n} AS DOUBLE)) - CAST(1 AS DOUBLE)) END")
    base_r = "CAST(base_interest_rate AS DOUBLE) / CAST(12 AS DOUBLE)"
    str_r = "(CAST(base_interest_rate AS DOUBLE) + CAST(0.03 AS DOUBLE)) / CAST(12 AS DOUBLE)"
    q["repayment_grid"] = with_ctes(APPS, body=f"""
SELECT application_id,
  round({rep.format(r=base_r, n=360)}, 2) AS repay_base_360,
  round({rep.format(r=str_r, n=240)}, 2) AS repay_stressed_240,
  round({rep.format(r="CAST(0 AS DOUBLE) / CAST(12 AS DOUBLE)", n=360)}, 2) AS repay_zero_rate
FROM apps""")

    reasons = [
        ("application_id IS NULL", "missing:application_id"),
        ("gross_annual_income IS NULL", "missing:gross_annual_income"),
        ("declared_living_expenses IS NULL", "missing:declared_living_expenses"),
        ("requested_loan_amount IS NULL", "missing:requested_loan_amount"),
        ("base_interest_rate IS NULL", "missing:base_interest_rate"),
        ("existing_debts_monthly IS NULL", "missing:existing_debts_monthly"),
        ("cdr_verified_expenses_monthly IS NULL", "missing:cdr_verified_expenses_monthly"),
        ("gross_annual_income <= 0", "non_positive_income"),
        ("requested_loan_amount <= 0", "non_positive_loan"),
        ("declared_living_expenses < 0", "negative:declared_living_expenses"),
        ("existing_debts_monthly < 0", "negative:existing_debts_monthly"),
        ("cdr_verified_expenses_monthly < 0", "negative:cdr_verified_expenses_monthly"),
        (f"CAST(base_interest_rate AS DOUBLE) + CAST({P.DEFAULT_POLICY.buffer} AS DOUBLE) = 0", "zero_stressed_rate"),
    ]
    arr = "list_filter([" + ", ".join(f"CASE WHEN {c} THEN {_q(r)} END" for c, r in reasons) + "], lambda x: x IS NOT NULL)"
    q["quarantine"] = with_ctes(APPS, DIRTY, body=f"""
SELECT application_id, array_to_string(r, ',') AS reject_reasons
FROM (SELECT application_id, {arr} AS r FROM dirty) WHERE len(r) > 0""")

    fields = ("application_id, applicant_name, gross_annual_income, declared_living_expenses, requested_loan_amount, "
              "property_valuation, base_interest_rate, existing_debts_monthly, cdr_verified_expenses_monthly, "
              "applicant_notes")
    q["submission_split"] = with_ctes(APPS, DIRTY, f"""
sub AS (
  SELECT {fields} FROM dirty UNION ALL SELECT {fields} FROM dirty WHERE okey % 50 = 0
  UNION ALL SELECT * REPLACE (CAST(requested_loan_amount + 1 AS DECIMAL(18,2)) AS requested_loan_amount)
  FROM (SELECT {fields} FROM dirty WHERE okey % 60 = 0)),
tagged AS (SELECT *, {arr} AS r FROM sub),
ranked AS (SELECT *, row_number() OVER (PARTITION BY {fields}) AS rn FROM tagged)""", body="""
SELECT application_id, CAST(requested_loan_amount AS DOUBLE) AS requested_loan_amount,
  CASE WHEN len(r) > 0 THEN array_to_string(r, ',') WHEN rn > 1 THEN 'duplicate_submission' ELSE 'ledger' END AS outcome
FROM ranked""")
    q["stream_submissions"] = f"""
SELECT application_id, outcome, CAST(count(*) AS BIGINT) AS n FROM ({q["submission_split"]}) GROUP BY ALL"""
    q["ledger_round_trip"] = with_ctes(*ASSESSED, body=f"""
SELECT CAST(7 AS BIGINT) * 4294967296 + row_number() OVER (ORDER BY application_id) - 1 AS event_id,
       'SYSTEM' AS event_type, *
FROM ({audit})""")
    q["sql_functions"] = with_ctes(APPS, metrics_cte(), body=f"""
SELECT application_id, calculated_dti AS dti, dti_status, CAST(applicable_monthly_expense AS DOUBLE) AS expense,
  round({rep.format(r=base_r, n=360)}, 2) AS repayment
FROM m""")

    q["notes_default"] = with_ctes(APPS, body=f"""
SELECT application_id, coalesce(applicant_notes, {_q(P.DEFAULT_NOTES)}) AS applicant_notes FROM apps""")

    q["masked_names"] = with_ctes(APPS, DIRTY, body=f"""
SELECT application_id, {mask_name("applicant_name")} AS masked_name,
       {mask_text("applicant_notes", "applicant_name")} AS masked_notes
FROM dirty""")

    reviewed = """
named AS (
  SELECT doc_id, CASE WHEN c_name IS NULL THEN text ELSE text || ' Reviewed by ' ||
         CASE WHEN doc_id % 2 = 0 THEN upper(c_name) ELSE c_name END || '.' END AS text
  FROM documents LEFT JOIN customer ON doc_id = c_custkey)"""
    q["masked_documents"] = f"SELECT doc_id, {mask_pii('text')} AS masked_text FROM documents"
    q["masked_people"] = with_ctes(DIRECTORY, reviewed, f"""
pii AS (SELECT doc_id, {mask_pii('text')} AS text FROM named)""", masked_ctes("pii", "doc_id", "text", "d"), body="""
SELECT doc_id, masked AS masked_text FROM d_masked""")
    q["people_in_documents"] = with_ctes(DIRECTORY, reviewed, people_ctes("named", "doc_id", "text", "d"), body="""
SELECT person, CAST(count(DISTINCT doc_id) AS BIGINT) AS n_documents, CAST(count(*) AS BIGINT) AS n_mentions
FROM d_occ GROUP BY person""")

    q["reidentified"] = with_ctes(LEDGER, LATEST, DIRECTORY, body=f"""
SELECT l.application_id, coalesce(d.real_name, l.applicant_name, {_q(P.UNKNOWN_APPLICANT)}) AS display_name,
       coalesce(d.real_name, {_q(P.UNKNOWN_APPLICANT)}) AS detail_name
FROM lat l LEFT JOIN dir d ON l.application_id = d.application_id""")

    cols = ("raw_notes", "own_masked_notes", "masked_notes", "masked_name")
    checks, found = [], []
    for i, c in enumerate(cols):
        for kind, pattern in (("EMAIL", "[^ ]@[^ ]"), ("CARD", "([0-9][ -]?){13}"), ("PHONE", "([0-9][ ()-]{0,2}){8}")):
            checks.append(f"SELECT '{c}' AS column_name, '{kind}' AS leak_kind, "
                          f"coalesce(regexp_matches({c}, '{pattern}'), false) AS hit FROM r")
        checks.append(f"SELECT '{c}' AS column_name, 'NAME' AS leak_kind, "
                      f"coalesce(len(list_filter(string_split(lower(real_name), ' '), "
                      f"lambda w: length(w) > 2 AND contains(lower({c}), w))) > 0, false) AS hit FROM r")
        found.append(people_ctes("r", "application_id", c, f"p{i}"))
        checks.append(f"SELECT '{c}' AS column_name, 'OTHER_NAME' AS leak_kind, "
                      f"application_id IN (SELECT o.application_id FROM p{i}_occ o JOIN r o2 USING (application_id) "
                      f"WHERE NOT contains(' ' || coalesce(o2.own, '') || ' ', ' ' || o.person || ' ')) AS hit FROM r")
    q["leak_audit"] = with_ctes(APPS, DIRECTORY, f"""
raw AS (SELECT a.application_id, a.applicant_name,
               a.applicant_notes || '; guarantor ' || coalesce(g.c_name, 'none') AS notes
        FROM apps a JOIN orders o ON o.o_orderkey = a.okey LEFT JOIN customer g ON g.c_custkey = o.o_custkey + 1),
pii AS (SELECT application_id, {mask_pii("notes")} AS notes FROM raw)""", masked_ctes("pii", "application_id", "notes", "m"), f"""
r AS (SELECT a.application_id, a.notes AS raw_notes, {mask_text("a.notes", "a.applicant_name")} AS own_masked_notes,
             {mask_own("m.masked", "a.applicant_name")} AS masked_notes,
             {mask_name("a.applicant_name")} AS masked_name, d.real_name,
             array_to_string(list_transform(regexp_extract_all(d.real_name, '[\pL\pN]+'), lambda w: lower(w)), ' ') AS own
      FROM raw a JOIN m_masked m USING (application_id) LEFT JOIN dir d ON a.application_id = d.application_id)""", *found, body=f"""
SELECT column_name, leak_kind, CAST(count(*) FILTER (WHERE hit) AS BIGINT) AS n_rows, CAST(count(*) AS BIGINT) AS n_checked
FROM ({' UNION ALL '.join(checks)}) GROUP BY ALL""")

    q["directory_mismatch"] = with_ctes(APPS, DIRECTORY, body="""
SELECT a.application_id, a.applicant_name, d.real_name
FROM apps a JOIN dir d ON a.application_id = d.application_id
WHERE a.applicant_name IS DISTINCT FROM d.real_name""")

    q["ledger_latest"] = with_ctes(LEDGER, LATEST, body=f"SELECT {LEDGER_OUT} FROM lat")
    q["ledger_latest_agg"] = q["ledger_latest"]
    q["ledger_point"] = with_ctes(LEDGER, body=f"""
SELECT {LEDGER_OUT} FROM led WHERE application_id = {_q(POINT_ID)} ORDER BY "timestamp" DESC, event_id DESC LIMIT 1""")
    q["ledger_newest"] = with_ctes(LEDGER, body=f"""
SELECT {LEDGER_OUT} FROM led ORDER BY "timestamp" DESC, event_id DESC LIMIT 1""")
    q["dashboard_scan"] = with_ctes(LEDGER, body="""
SELECT application_id, system_recommendation, underwriter_decision, "timestamp" FROM led""")
    q["dashboard_counts"] = with_ctes(LEDGER, LATEST, body="""
SELECT CAST(count(*) AS BIGINT) AS total,
       CAST(count(*) FILTER (WHERE underwriter_decision = 'PENDING_REVIEW') AS BIGINT) AS pending,
       CAST(count(*) FILTER (WHERE underwriter_decision IN ('APPROVED_OVERRIDE', 'AUTO_APPROVED')) AS BIGINT) AS approved,
       CAST(count(*) FILTER (WHERE underwriter_decision = 'DECLINED') AS BIGINT) AS declined
FROM lat""")
    q["live_counts"] = q["dashboard_counts"]
    for name, cond in (("pending", "underwriter_decision = 'PENDING_REVIEW'"),
                       ("approved", "contains(underwriter_decision, 'APPROVED')"),
                       ("declined", "underwriter_decision = 'DECLINED'")):
        q[f"queue_{name}"] = with_ctes(LEDGER, LATEST, body=f"""
SELECT application_id, system_recommendation, underwriter_decision FROM lat WHERE {cond}""")

    q["hidden_decisions"] = with_ctes(LEDGER, body="""
SELECT application_id, event_id, "timestamp", underwriter_decision AS latest_decision, hidden_decision
FROM (SELECT *, row_number() OVER w AS rn, lead(underwriter_decision) OVER w AS hidden_decision
      FROM led WINDOW w AS (PARTITION BY application_id ORDER BY "timestamp" DESC, event_id DESC))
WHERE rn = 1 AND underwriter_decision = 'PENDING_REVIEW' AND hidden_decision IN ('APPROVED_OVERRIDE', 'DECLINED')""")

    q["decision_valid"] = with_ctes(LEDGER, LATEST, DECISIONS, GATE, body="""
SELECT decision_id, application_id, action, clean_notes, notes_valid FROM dv2""")
    q["decision_gate"] = with_ctes(LEDGER, LATEST, DECISIONS, GATE, body="""
SELECT decision_id, application_id, decision, clean_notes FROM passed""")
    q["decision_rejected"] = with_ctes(LEDGER, LATEST, DECISIONS, GATE, body="""
SELECT decision_id, application_id, reject_reason FROM dv2 WHERE reject_reason IS NOT NULL""")
    q["ledger_update"] = with_ctes(LEDGER, LATEST, DECISIONS, GATE, body=f"SELECT {LEDGER_OUT} FROM upd")
    q["ledger_decided_state"] = with_ctes(LEDGER, LATEST, DECISIONS, GATE, body=f"""
SELECT {STATE_OUT} FROM (
  SELECT *, row_number() OVER (PARTITION BY application_id ORDER BY "timestamp" DESC, event_id DESC) AS rn FROM upd)
WHERE rn = 1""")
    q["ledger_reset"] = with_ctes(LEDGER, RESET, body=f"SELECT {LEDGER_OUT} FROM rst")
    q["ledger_reset_state"] = with_ctes(LEDGER, RESET, body=f"""
SELECT {STATE_OUT} FROM (
  SELECT *, row_number() OVER (PARTITION BY application_id ORDER BY "timestamp" DESC, event_id DESC) AS rn FROM rst)
WHERE rn = 1""")
    q["decisions_daily"] = with_ctes(LEDGER, body="""
SELECT date_trunc('day', "timestamp") AS window_start, date_trunc('day', "timestamp") + INTERVAL 1 DAY AS window_end,
       underwriter_decision, CAST(count(*) AS BIGINT) AS n
FROM led GROUP BY ALL""")

    q["scope_guard"] = with_ctes(CHAT, body=f"""
SELECT conv_id, turn, {scope_family("text", "strict")} AS family_strict, {scope_family("text", "fixed")} AS family_fixed
FROM chat WHERE role = 'user'""")
    q["guarded_answers"] = with_ctes(CHAT, body=f"""
SELECT u.conv_id, u.turn, ({scope_family("u.text", "strict")}) IS NOT NULL AS blocked,
       CASE WHEN ({scope_family("u.text", "strict")}) IS NOT NULL THEN {_q(P.SCOPE_REFUSAL)} ELSE a.text END AS reply
FROM chat u LEFT JOIN chat a ON a.role = 'assistant' AND a.conv_id = u.conv_id AND a.turn - 1 = u.turn
WHERE u.role = 'user'""")

    q["copilot_answers"] = with_ctes(CHAT, f"""
cc AS (
  SELECT conv_id, turn - 1 AS turn, (conv_id + turn - 1) % 5 AS m, text FROM conversations
  WHERE role = 'assistant' AND (conv_id + turn - 1) % 5 <> 4)""", body=f"""
SELECT u.conv_id, u.turn,
  CASE WHEN ({scope_family("u.text", "strict")}) IS NOT NULL THEN {_q(P.SCOPE_REFUSAL)}
       WHEN c.m = 0 THEN 'Copilot Error: DeadlineExceeded: model call timed out'
       WHEN c.m IS NULL OR c.text IS NULL THEN 'Copilot Error: no completion'
       ELSE {strip("CASE WHEN c.m = 1 THEN replace(c.text, '. ', chr(10)) ELSE c.text END")} END AS answer
FROM chat u LEFT JOIN cc c ON u.conv_id = c.conv_id AND u.turn = c.turn WHERE u.role = 'user'""")

    q["completion_fallback"] = with_ctes(*ASSESSED, COMPLETIONS, body=f"""
SELECT a.application_id,
  CASE WHEN c.error IS NOT NULL OR ({flatten("c.blocks", "c.plain")}) IS NULL THEN {_q(P.MEMO_FALLBACK)}
       ELSE {flatten("c.blocks", "c.plain")} END AS ai_risk_memo,
  (c.error IS NOT NULL OR ({flatten("c.blocks", "c.plain")}) IS NULL) AS completion_failed
FROM assessed a LEFT JOIN comp c ON a.application_id = c.application_id
WHERE len(a.policy_breaches) > 0""")

    notes = f"coalesce({mask_text('applicant_notes', 'applicant_name')}, {_q(P.DEFAULT_NOTES)})"
    q["summary_prompts"] = with_ctes(APPS, body=f"""
SELECT application_id, {render_sql(P.SUMMARY_PROMPT_TEMPLATE, {"notes": notes})} AS summary_prompt FROM apps""")

    q["cdr_expenses"] = with_ctes(APPS, body="""
SELECT application_id, CAST(cdr_verified_expenses_monthly AS DOUBLE) AS cdr_verified_expenses_monthly FROM apps""")

    p = P.DEFAULT_POLICY
    for name, scenarios in (("stress_grid", SCENARIOS), ("stress_surface", SURFACE)):
        values = ", ".join(f"({sid}, CAST({b} AS DOUBLE), CAST({lim} AS DOUBLE))" for sid, b, lim in scenarios)
        q[name] = with_ctes(APPS, f"""
sc(scenario_id, buffer, dti_limit) AS (VALUES {values}),
x AS (
  SELECT sc.scenario_id, sc.buffer, sc.dti_limit,
    (CAST(requested_loan_amount AS DOUBLE) + CAST(existing_debts_monthly AS DOUBLE) * CAST(12 AS DOUBLE)
       * CAST({p.debt_years} AS DOUBLE)) / CAST(gross_annual_income AS DOUBLE) >= sc.dti_limit AS d,
    CAST(cdr_verified_expenses_monthly - declared_living_expenses AS DECIMAL(18,2)) > CAST({p.expense_tolerance} AS DECIMAL(18,2)) AS e,
    CAST(greatest(declared_living_expenses, cdr_verified_expenses_monthly, CAST({p.hem} AS DECIMAL(18,2))) AS DECIMAL(18,2)) AS appl,
    (CAST(base_interest_rate AS DOUBLE) + sc.buffer) / CAST(12 AS DOUBLE) AS r,
    gross_annual_income, existing_debts_monthly, requested_loan_amount
  FROM apps, sc),
y AS (
  SELECT *, CAST(gross_annual_income AS DOUBLE) * CAST({p.net_ratio} AS DOUBLE) / CAST(12 AS DOUBLE)
     - CAST(appl AS DOUBLE) - CAST(existing_debts_monthly AS DOUBLE)
     - CAST(requested_loan_amount AS DOUBLE) * (r * pow(CAST(1 AS DOUBLE) + r, CAST({p.months} AS DOUBLE)))
       / (pow(CAST(1 AS DOUBLE) + r, CAST({p.months} AS DOUBLE)) - CAST(1 AS DOUBLE)) < 0 AS s
  FROM x)""", body="""
SELECT scenario_id, buffer, dti_limit,
  CAST(count(*) FILTER (WHERE d) AS BIGINT) AS n_dti_breach,
  CAST(count(*) FILTER (WHERE e) AS BIGINT) AS n_expense_breach,
  CAST(count(*) FILTER (WHERE s) AS BIGINT) AS n_serviceability_breach,
  CAST(count(*) FILTER (WHERE d OR e OR s) AS BIGINT) AS n_referred,
  CAST(count(*) AS BIGINT) AS n_apps,
  round(CAST(count(*) FILTER (WHERE d OR e OR s) AS DOUBLE) / CAST(count(*) AS DOUBLE), 4) AS referral_rate
FROM y GROUP BY ALL""")

    q["breach_mix"] = with_ctes(*ASSESSED, body="""
SELECT segment, breach_code, CAST(count(*) AS BIGINT) AS n
FROM (SELECT segment, unnest(breach_codes) AS breach_code FROM assessed)
GROUP BY ROLLUP (segment, breach_code)""")

    q["chunks_fixed"] = f"""
SELECT page, CAST(i AS INTEGER) AS chunk_no, substring(content, CAST(i AS BIGINT) * {P.CHUNK_SIZE - P.CHUNK_OVERLAP} + 1, {P.CHUNK_SIZE}) AS chunk
FROM (SELECT doc_id AS page, text AS content,
             unnest(range(0, CAST(greatest(ceil((length(text) - {P.CHUNK_OVERLAP}) / {P.CHUNK_SIZE - P.CHUNK_OVERLAP}), 1) AS BIGINT))) AS i
      FROM documents)
WHERE length(substring(content, CAST(i AS BIGINT) * {P.CHUNK_SIZE - P.CHUNK_OVERLAP} + 1, {P.CHUNK_SIZE})) > 0"""

    corpus = "SELECT '/regulations/' || source || '.pdf' AS source, doc_id AS page, text AS content FROM documents"
    q["chunks_recursive"] = "WITH " + recursive_chunks(corpus) + """
SELECT page, CAST(chunk_no AS INTEGER) AS chunk_no, chunk FROM ch"""

    q["knn_exact"] = knn_sql(KNN_K, body="""
SELECT query_id, CAST(rank AS INTEGER) AS rank, neighbor_id, round(d, 6) AS distance FROM top""")

    dot = "list_dot_product(CAST({a}.embedding AS DOUBLE[]), CAST({b}.embedding AS DOUBLE[]))"
    qc, qq, cc = dot.format(a="q", b="c"), dot.format(a="q", b="q"), dot.format(a="c", b="c")
    q["knn_pivot"] = q["knn_exact"]
    q["knn_cosine"] = q["knn_exact"].replace(SQUARED_L2, f"1 - {qc} / sqrt({qq} * {cc})")
    q["knn_inner"] = q["knn_exact"].replace(SQUARED_L2, f"-{qc}")

    q["citations"] = knn_sql(P.RETRIEVAL_K_DEFAULT, body=f"""
SELECT t.query_id,
  string_agg('[Citation ' || CAST(t.rank AS VARCHAR) || ' - '
             || coalesce(string_split(pg.source, '/')[-1], {_q(P.UNKNOWN_SOURCE)}) || ', Page '
             || coalesce(CAST(pg.page AS VARCHAR), {_q(P.UNKNOWN_PAGE)}) || ']' || chr(10)
             || coalesce(pg.content, '') || chr(10), chr(10) ORDER BY t.rank) AS regulatory_citations
FROM top t LEFT JOIN (SELECT '/regulations/' || source || '.pdf' AS source, doc_id AS page, text AS content
                      FROM documents) pg ON t.neighbor_id = pg.page
GROUP BY t.query_id""")

    q["retrieve_lexical"] = "WITH " + lexical_ctes("SELECT doc_id AS id, text FROM documents",
                                                   "SELECT item_id AS id, text FROM benchmark", LEXICAL_K) + """
SELECT query_id, CAST(rank AS INTEGER) AS rank, neighbor_id, score FROM lx_top"""

    fixed_chunks = f"""
ch AS (
  SELECT row_number() OVER (ORDER BY page, chunk_no) AS chunk_id, source, page, chunk_no, chunk FROM (
    SELECT source, page, CAST(i AS INTEGER) AS chunk_no,
           substring(content, CAST(i AS BIGINT) * {P.CHUNK_SIZE - P.CHUNK_OVERLAP} + 1, {P.CHUNK_SIZE}) AS chunk
    FROM (SELECT '/regulations/' || source || '.pdf' AS source, doc_id AS page, text AS content,
                 unnest(range(0, CAST(greatest(ceil((length(text) - {P.CHUNK_OVERLAP}) / {P.CHUNK_SIZE - P.CHUNK_OVERLAP}), 1) AS BIGINT))) AS i
          FROM documents))
  WHERE length(chunk) > 0)"""
    users = f"""
u AS (
  SELECT conv_id, turn, text, row_number() OVER (ORDER BY conv_id, turn) AS qid, 'APP-' || CAST(conv_id AS VARCHAR) AS application_id,
         ({scope_family("text", "strict")}) IS NOT NULL AS blocked
  FROM chat WHERE role = 'user')"""
    cites = citations_cte("cites") + f""",
ctx AS (
  SELECT u.*, l.calculated_dti, l.net_monthly_surplus, l.system_recommendation, l.policy_breaches,
         l.underwriter_decision, coalesce(d.real_name, l.applicant_name, {_q(P.UNKNOWN_APPLICANT)}) AS display_name,
         c.regulatory_citations
  FROM u LEFT JOIN lat l ON u.application_id = l.application_id
         LEFT JOIN dir d ON u.application_id = d.application_id
         LEFT JOIN cites c ON u.qid = c.qid)"""
    prompt = render_sql(P.COPILOT_PROMPT_TEMPLATE, {
        "application_id": "application_id",
        "name": f"coalesce(display_name, {_q(P.UNKNOWN_APPLICANT)})",
        "calculated_dti": f"coalesce({fmt_calc('calculated_dti')}, {_q(P.NOT_AVAILABLE)})",
        "net_monthly_surplus": f"coalesce({fmt_calc('net_monthly_surplus')}, {_q(P.NOT_AVAILABLE)})",
        "system_recommendation": f"coalesce(system_recommendation, {_q(P.NOT_AVAILABLE)})",
        "policy_breaches": "coalesce(policy_breaches, 'None')",
        "underwriter_decision": f"coalesce(underwriter_decision, {_q(P.PENDING_REVIEW)})",
        "citations": "coalesce(regulatory_citations, '')",
        "question": "coalesce(text, '')",
    })
    lx = lexical_ctes("SELECT chunk_id AS id, chunk AS text FROM ch",
                      "SELECT qid AS id, text FROM u WHERE NOT blocked", P.RETRIEVAL_K)
    narrative = (f"CASE WHEN c.error IS NOT NULL OR ({flatten('c.blocks', 'c.plain')}) IS NULL "
                 f"THEN {_q(P.SUMMARY_FALLBACK)} ELSE {flatten('c.blocks', 'c.plain')} END")
    memo_prompt = render_sql(P.MEMO_PROMPT_TEMPLATE, {
        "application_id": "a.application_id",
        "applicant_name": mask_name("a.applicant_name"),
        "gross_annual_income": fmt_in("a.gross_annual_income"),
        "requested_loan_amount": fmt_in("a.requested_loan_amount"),
        "narrative": narrative,
        "calculated_dti": fmt_calc("a.calculated_dti"),
        "stressed_monthly_repayment": fmt_calc("a.stressed_monthly_repayment"),
        "net_monthly_surplus": fmt_calc("a.net_monthly_surplus"),
        "breaches": "array_to_string(a.policy_breaches, chr(10))",
        "citations": "coalesce(mc.regulatory_citations, '')",
    })
    memo_cites = citations_cte("mc")
    lx_memo = lexical_ctes("SELECT chunk_id AS id, chunk AS text FROM ch",
                           "SELECT okey AS id, array_to_string(policy_breaches, ' ') AS text FROM assessed "
                           "WHERE len(breach_codes) > 0", P.RETRIEVAL_K)
    q["memo_prompts_lexical"] = with_ctes(*ASSESSED, COMPLETIONS, fixed_chunks, lx_memo, memo_cites, body=f"""
SELECT a.application_id, {memo_prompt} AS memo_prompt
FROM assessed a LEFT JOIN comp c ON a.application_id = c.application_id
     LEFT JOIN mc ON a.okey = mc.qid
WHERE len(a.breach_codes) > 0""")

    q["copilot_prompts_lexical"] = with_ctes(CHAT, LEDGER, LATEST, DIRECTORY, users, fixed_chunks, lx, cites, body=f"""
SELECT conv_id, turn, blocked,
  CASE WHEN blocked THEN NULL ELSE {_q(P.COPILOT_SYSTEM_PROMPT)} END AS system_prompt,
  CASE WHEN blocked THEN NULL ELSE {prompt} END AS prompt,
  CASE WHEN blocked THEN {_q(P.SCOPE_REFUSAL)} END AS reply
FROM ctx""")

    # The same three flows over recursive chunks and cosine scores.
    breach_texts = "SELECT okey AS id, array_to_string(policy_breaches, ' ') AS text FROM assessed WHERE len(breach_codes) > 0"
    rc = recursive_chunks(corpus)
    cos_memo = lexical_ctes("SELECT chunk_id AS id, chunk AS text FROM ch", breach_texts, P.RETRIEVAL_K, cosine=True)
    q["retrieve_text"] = with_ctes(*ASSESSED, rc, cos_memo, memo_cites, body="""
SELECT a.application_id, mc.regulatory_citations
FROM assessed a LEFT JOIN mc ON a.okey = mc.qid WHERE len(a.breach_codes) > 0""")
    summary = f"coalesce({mask_text('a.applicant_notes', 'a.applicant_name')}, {_q(P.DEFAULT_NOTES)})"
    q["memo_prompts"] = with_ctes(*ASSESSED, COMPLETIONS, rc, cos_memo, memo_cites, body=f"""
SELECT a.application_id, {render_sql(P.SUMMARY_PROMPT_TEMPLATE, {"notes": summary})} AS summary_prompt,
       {_q(P.MEMO_SYSTEM_PROMPT)} AS system_prompt, {memo_prompt} AS memo_prompt
FROM assessed a LEFT JOIN comp c ON a.application_id = c.application_id
     LEFT JOIN mc ON a.okey = mc.qid
WHERE len(a.breach_codes) > 0""")
    cos = lexical_ctes("SELECT chunk_id AS id, chunk AS text FROM ch",
                       "SELECT qid AS id, text FROM u WHERE NOT blocked", P.RETRIEVAL_K, cosine=True)
    q["copilot_prompts"] = q["copilot_prompts_lexical"].replace(fixed_chunks, rc).replace(lx, cos)
    return q


def recursive_chunks(corpus: str) -> str:
    """CTE ``ch(chunk_id, source, page, chunk_no, chunk)``: the recursive splitter.  Each of the four separators is one
    level: ``rc_n`` holds the texts a level splits, ``rc_p`` their pieces (the separator stays in front), pieces of full size
    go on to the next level, and runs of smaller ones are merged.  ``path`` orders what comes from one page.  A merge steps
    from chunk to chunk over the running lengths of its pieces: a chunk ends before the piece that would pass the size, and
    the next one begins at the first piece from which no more than the overlap, and no more than fits beside that
    piece, is left."""
    size, overlap = P.CHUNK_SIZE, P.CHUNK_OVERLAP
    seps = [" || ".join(f"chr({ord(c)})" for c in s) for s in P.CHUNK_SEPARATORS]
    last = len(seps) - 1
    levels = []
    for j in range(len(seps)):
        nodes = (f"SELECT source, page, CAST([] AS BIGINT[]) AS path, content AS body, 0 AS lev FROM ({corpus}) WHERE content <> ''"
                 if j == 0 else f"SELECT source, page, list_append(path, i) AS path, piece AS body, si + 1 AS lev "
                                f"FROM rc_p{j - 1} WHERE length(piece) >= {size} AND si < {last}")
        which = " ".join(f"WHEN lev <= {n} AND contains(body, {s}) THEN {n}" for n, s in enumerate(seps))
        sep = " ".join(f"WHEN {n} THEN {s}" for n, s in enumerate(seps))
        levels.append(f"""
rc_n{j} AS (SELECT *, CASE {which} ELSE {last + 1} END AS si FROM ({nodes})),
rc_s{j} AS (SELECT source, page, path, si, CASE si {sep} ELSE {seps[last]} END AS sep,
            string_split(body, CASE si {sep} ELSE {seps[last]} END) AS parts FROM rc_n{j}),
rc_p{j} AS (SELECT source, page, path, si, i, CASE WHEN i = 1 THEN part ELSE sep || part END AS piece
            FROM (SELECT *, unnest(parts) AS part, unnest(range(1, len(parts) + 1)) AS i FROM rc_s{j})
            WHERE i > 1 OR part <> ''),
rc_r{j} AS (SELECT *, sum(CASE WHEN length(piece) >= {size} THEN 1 ELSE 0 END) OVER (PARTITION BY page, path ORDER BY i) AS grp
            FROM rc_p{j}),
rc_c{j} AS (SELECT *, CAST(sum(length(piece)) OVER (PARTITION BY page, path, grp ORDER BY i) AS BIGINT) AS upto
            FROM rc_r{j} WHERE length(piece) < {size})""")
    runs = " UNION ALL ".join(
        f"SELECT source, page, list_append(path, min(i)) AS path, list(piece ORDER BY i) AS ps, "
        f"list_prepend(0, list(upto ORDER BY i)) AS pl FROM rc_c{j} GROUP BY source, page, path, grp" for j in range(len(seps)))
    whole = " UNION ALL ".join(
        f"SELECT source, page, list_append(path, i) AS path, 0 AS step, piece AS chunk FROM rc_p{j} "
        f"WHERE length(piece) >= {size} AND si >= {last}" for j in range(len(seps)))
    chunk = strip("array_to_string(ps[s + 1:e], '')")
    end = f"len(list_filter(pl, lambda x: x <= pl[{{}} + 1] + {size})) - 1"
    begin = f"greatest(s, len(list_filter(pl, lambda x: x < pl[e + 1] - least({overlap}, {size} - (pl[e + 2] - pl[e + 1])))))"
    return ",".join(levels) + f""",
rc_runs AS ({runs}),
rc_steps AS (
  WITH RECURSIVE r AS (
    SELECT source, page, path, ps, pl, 0 AS step, CAST(0 AS BIGINT) AS s, CAST({end.format(0)} AS BIGINT) AS e FROM rc_runs
    UNION ALL
    SELECT source, page, path, ps, pl, step + 1, b, CAST({end.format('b')} AS BIGINT)
    FROM (SELECT *, CAST(least(e, {begin}) AS BIGINT) AS b FROM r WHERE e < len(ps)))
  SELECT * FROM r),
ch AS (
  SELECT row_number() OVER (ORDER BY source NULLS FIRST, page, path, step) AS chunk_id, source, page,
         row_number() OVER (PARTITION BY page ORDER BY path, step) - 1 AS chunk_no, chunk
  FROM (SELECT source, page, path, step, {chunk} AS chunk FROM rc_steps UNION ALL {whole}) WHERE chunk <> '')"""


def citations_cte(name: str) -> str:
    """CTE ``name(qid, regulatory_citations)``: the ``lx_top`` hits over chunks ``ch`` rendered as
    citation blocks in rank order, joined by a newline."""
    return f"""
{name} AS (
  SELECT t.query_id AS qid,
    string_agg('[Citation ' || CAST(t.rank AS VARCHAR) || ' - '
               || coalesce(string_split(ch.source, '/')[-1], {_q(P.UNKNOWN_SOURCE)}) || ', Page '
               || coalesce(CAST(ch.page AS VARCHAR), {_q(P.UNKNOWN_PAGE)}) || ']' || chr(10)
               || coalesce(ch.chunk, '') || chr(10), chr(10) ORDER BY t.rank) AS regulatory_citations
  FROM lx_top t JOIN ch ON t.neighbor_id = ch.chunk_id GROUP BY t.query_id)"""


def lexical_ctes(docs: str, queries: str, k: int, cosine: bool = False) -> str:
    """CTEs ending in ``lx_top(query_id, rank, neighbor_id, score)``: TF-IDF dot products of
    lower-cased terms split on non-letters/digits, idf = ln(N / df), score rounded to 6 places,
    ranked by score then id.  ``cosine``: idf = ln((N + 1) / (df + 1)), and documents of unit length.
    ``docs`` / ``queries`` are subqueries yielding (id, text)."""
    split = "'[^\\pL\\pN]+'"
    n = "(SELECT n FROM lx_n)"
    idf = f"ln(({n} + 1) / (CAST(count(*) AS DOUBLE) + 1))" if cosine else f"ln({n} / CAST(count(*) AS DOUBLE))"
    length = "sqrt(sum(CAST(tf AS DOUBLE) * idf * CAST(tf AS DOUBLE) * idf) OVER (PARTITION BY id))"
    weight = f"CAST(tf AS DOUBLE) * idf / nullif({length}, 0)" if cosine else "CAST(tf AS DOUBLE) * idf"
    return f"""
lx_d AS ({docs}),
lx_q AS ({queries}),
lx_dt AS (SELECT id, unnest(regexp_split_to_array(lower(text), {split})) AS term FROM lx_d),
lx_dtf AS (SELECT id, term, count(*) AS tf FROM lx_dt WHERE term <> '' GROUP BY ALL),
lx_n AS (SELECT CAST(count(*) AS DOUBLE) AS n FROM lx_d),
lx_idf AS (SELECT term, {idf} AS idf FROM lx_dtf GROUP BY term),
lx_dw AS (SELECT id, lx_dtf.term, {weight} AS w FROM lx_dtf JOIN lx_idf ON lx_dtf.term = lx_idf.term),
lx_qt AS (SELECT id, unnest(regexp_split_to_array(lower(text), {split})) AS term FROM lx_q),
lx_qtf AS (SELECT id, term, count(*) AS tf FROM lx_qt WHERE term <> '' GROUP BY ALL),
lx_qw AS (SELECT id, lx_qtf.term, CAST(tf AS DOUBLE) * idf AS w FROM lx_qtf JOIN lx_idf ON lx_qtf.term = lx_idf.term),
lx_s AS (SELECT lx_qw.id AS query_id, lx_dw.id AS neighbor_id, round(sum(lx_qw.w * lx_dw.w), 6) AS score
         FROM lx_qw JOIN lx_dw ON lx_qw.term = lx_dw.term GROUP BY ALL HAVING sum(lx_qw.w * lx_dw.w) > 0),
lx_r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, neighbor_id) AS rank FROM lx_s),
lx_top AS (SELECT * FROM lx_r WHERE rank <= {k})"""


SQUARED_L2 = """list_sum(list_transform(range(1, len(q.embedding) + 1),
                  lambda i: (CAST(q.embedding[i] AS DOUBLE) - CAST(c.embedding[i] AS DOUBLE)) ** 2))"""


def knn_sql(k: int, body: str) -> str:
    """Brute-force exact k-NN over embeddings (self excluded), squared L2, ties by id."""
    return f"""
WITH pairs AS (
  SELECT q.vec_id AS query_id, c.vec_id AS neighbor_id,
         {SQUARED_L2} AS d
  FROM embeddings q, embeddings c WHERE q.vec_id != c.vec_id),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY d, neighbor_id) AS rank FROM pairs),
top AS (SELECT * FROM ranked WHERE rank <= {k})
{body}"""
