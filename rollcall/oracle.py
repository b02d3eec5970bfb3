"""Independent DuckDB formulations of the registered queries (the correctness oracle).

Written directly in SQL from the semantics of the source application, not
from the Spark code: naive one-GROUP-BY-per-award plans, explicit joins.
Tables are the driver's pre-registered views.
"""

from __future__ import annotations

from rollcall.sources import fixtures as X

ORACLE: dict[str, str] = {}

#: Award rules as the source's settings state them: id, period, event class, leaders only, measure, threshold.
RULES = (
    (1, "year", "qsource", False, "posts", 25),
    (2, "month", "qsource", False, "posts", 4),
    (3, "month", "workout", True, "posts", 4),
    (4, "month", "workout", True, "posts", 6),
    (5, "week", "workout", True, "posts", 6),
    (6, "month", "workout", True, "sites", 7),
    (7, "year", "workout", True, "posts", 20),
    (8, "year", "workout", False, "posts", 25),
    (9, "year", "workout", False, "posts", 50),
    (10, "year", "workout", False, "posts", 100),
    (11, "year", "workout", False, "posts", 150),
    (12, "year", "workout", False, "posts", 200),
    (13, "week", "workout", False, "posts", 6),
    (14, "year_ao", "workout", False, "posts", 50),
)

# regex: same patterns as the library; DuckDB (RE2) needs an explicit Unicode white-space class
_WS = r"[\t\n\x0B\f\r\x{85}\p{Z}]"
BB_QS = r"q.{0,1}source|q{0,1}[1-9]\.[0-9]" + _WS
AO_QS = r"q.{0,1}source"
AO_NW = r"q.{0,1}source|ruck"


def _d(x) -> str:
    return f"DATE '{x.isoformat()}'"


AWARD_POSTS_CTE = """
award_posts AS (
  SELECT CAST(l.l_suppkey AS VARCHAR) AS email,
         s.s_name AS user_name,
         CAST(l.l_linenumber AS VARCHAR) AS ao_id,
         'ao-' || CAST(l.l_linenumber AS VARCHAR) AS ao,
         CAST(l.l_shipdate AS DATE) AS date,
         CAST(l.l_returnflag = 'R' AS INTEGER) AS q_flag,
         CASE WHEN l.l_quantity = 50 THEN NULL
              WHEN l.l_quantity <= 12 THEN 'Q Source 1.1 ' || p.p_name
              ELSE 'Regular workout ' || p.p_name END AS backblast,
         CAST(s.s_nationkey AS VARCHAR) AS region
  FROM lineitem l
  JOIN supplier s ON l.l_suppkey = s.s_suppkey
  JOIN part p ON l.l_partkey = p.p_partkey
)"""


def award_fact_cte(as_of=X.AWARD_AS_OF, name="fact") -> str:
    return f"""
{name} AS (
  SELECT *,
    coalesce(regexp_matches(lower(substr(backblast, 1, 100)), '{BB_QS}')
             OR regexp_matches(lower(ao), '{AO_QS}'), false) AS is_qs,
    coalesce(NOT regexp_matches(lower(substr(backblast, 1, 100)), '{BB_QS}')
             AND NOT regexp_matches(lower(ao), '{AO_NW}'), false) AS is_w
  FROM award_posts
  WHERE year(date) = {as_of.year} AND date <= {_d(as_of)}
)"""


_PERIOD_SQL = {"year": "year(date)", "month": "month(date)", "week": "week(date)", "year_ao": "year(date)"}


def award_select(aid: int, thresholds=None, fact="fact") -> str:
    """One award as its own GROUP BY (the naive plan)."""
    thresholds = thresholds if thresholds is not None else X.DRIVER_THRESHOLDS
    rule = {r[0]: r for r in RULES}[aid]
    _, period, cls, leaders, measure, default = rule
    t = thresholds.get(aid, default)
    where = "is_qs" if cls == "qsource" else "is_w"
    if leaders:
        where += " AND q_flag = 1"
    p = _PERIOD_SQL[period]
    kind = "year" if period == "year_ao" else period
    group = f"{p}, email, region" + (", ao_id" if period == "year_ao" else "")
    if measure == "sites":
        having = f"count(DISTINCT ao_id) >= {t}"
    elif period == "year_ao":
        having = f"count(ao) >= {t}"
    else:
        having = f"count(ao_id) >= {t}"
    return f"""
  SELECT CAST({aid} AS INTEGER) AS achievement_id, '{kind}' AS period_kind, CAST({p} AS INTEGER) AS period,
         email, region, max(date) AS date_awarded
  FROM {fact} WHERE {where}
  GROUP BY {group}
  HAVING {having}"""


def awards_union(ids=range(1, 15), thresholds=None, fact="fact") -> str:
    return "\nUNION ALL".join(award_select(i, thresholds, fact) for i in ids)


ORACLE["awards_all"] = f"WITH {AWARD_POSTS_CTE}, {award_fact_cte()}\n{awards_union()}"

_AWARD_QUERY_NAMES = {
    1: "award_priest",
    2: "award_monk",
    3: "award_leader_of_men",
    4: "award_boss",
    5: "award_hammer",
    6: "award_cadre",
    7: "award_el_presidente",
    8: "award_posts_tier1",
    9: "award_posts_tier2",
    10: "award_posts_tier3",
    11: "award_posts_tier4",
    12: "award_posts_tier5",
    13: "award_six_pack",
    14: "award_hdtf",
}
for _aid, _name in _AWARD_QUERY_NAMES.items():
    ORACLE[_name] = f"WITH {AWARD_POSTS_CTE}, {award_fact_cte()}\n{award_select(_aid)}"

ORACLE["award_posts"] = f"""WITH {AWARD_POSTS_CTE}, {award_fact_cte()}
SELECT CAST(year(date) AS INTEGER) AS year, email, region, count(ao_id) AS n_posts, max(date) AS last_date
FROM fact WHERE is_w
GROUP BY year(date), email, region"""


# ---------------------------------------------------------------------------
# normalised tables: national fact joins
# ---------------------------------------------------------------------------

NORMALISED_CTE = """
nb AS (
  SELECT CAST(c.c_nationkey AS VARCHAR) AS region, CAST(o.o_custkey AS VARCHAR) AS user_id,
         CAST(l.l_linenumber AS VARCHAR) AS ao_id, CAST(date_trunc('week', l.l_shipdate) AS DATE) AS date,
         l.l_orderkey, l.l_quantity
  FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey JOIN customer c ON o.o_custkey = c.c_custkey
),
n_beatdowns AS (
  SELECT region, ao_id, date AS bd_date, min(user_id) AS q_user_id,
         CASE WHEN max(user_id) <> min(user_id) THEN max(user_id) END AS coq_user_id,
         CASE WHEN min(l_quantity) <= 2 THEN 'Q Source 1.1 lesson' ELSE 'Regular workout at ao-' || ao_id END
         || CASE WHEN max(l_quantity) = 50 THEN chr(10) || 'Achievement: golden_boy'
                 WHEN max(l_quantity) = 49 THEN chr(10) || 'Achievement: run_a_5k' ELSE '' END AS backblast
  FROM nb GROUP BY region, ao_id, date
),
n_attendance AS (
  SELECT nb.region, nb.user_id, nb.ao_id,
         CASE WHEN nb.l_orderkey % 2 = 0 THEN b.q_user_id ELSE coalesce(b.coq_user_id, b.q_user_id) END AS q_user_id,
         nb.date
  FROM nb JOIN n_beatdowns b ON nb.region = b.region AND nb.ao_id = b.ao_id AND nb.date = b.bd_date
),
n_users AS (
  SELECT CAST(c_nationkey AS VARCHAR) AS region, CAST(c_custkey AS VARCHAR) AS user_id,
         CASE WHEN c_acctbal < 0 THEN 'none' ELSE 'pax' || CAST(c_custkey AS VARCHAR) || '@example.org' END AS email,
         c_name AS user_name
  FROM customer
),
n_aos AS (SELECT DISTINCT region, ao_id AS channel_id, 'ao-' || ao_id AS ao FROM nb)"""

_DENY_FACT = "('f3devcommunity', 'f3development', 'f3csra', 'f3texarcana')"

J1_SQL = f"""
  SELECT a.region, u.email, a.user_id, b.bd_date
  FROM n_attendance a
  JOIN n_users u ON a.region = u.region AND a.user_id = u.user_id
  JOIN n_beatdowns b ON a.region = b.region AND a.ao_id = b.ao_id AND a.date = b.bd_date AND a.q_user_id = b.q_user_id
  JOIN n_aos ao ON b.region = ao.region AND b.ao_id = ao.channel_id
  WHERE a.region NOT IN {_DENY_FACT}"""


def j2_sql(as_of, current_year: bool) -> str:
    period = f"year(b.bd_date) = {as_of.year}" if current_year else "b.bd_date IS NOT NULL"
    return f"""
  SELECT u.email, u.user_name, a.ao_id, ao.ao, b.bd_date AS date,
         CASE WHEN a.user_id = b.q_user_id OR a.user_id = b.coq_user_id THEN 1 ELSE 0 END AS q_flag,
         b.backblast, a.region AS site_region, a.user_id
  FROM n_attendance a
  JOIN n_users u ON a.region = u.region AND a.user_id = u.user_id
  JOIN n_beatdowns b ON (a.q_user_id = b.q_user_id OR a.q_user_id = b.coq_user_id)
                    AND a.region = b.region AND a.ao_id = b.ao_id AND a.date = b.bd_date
  JOIN n_aos ao ON b.region = ao.region AND b.ao_id = ao.channel_id
  WHERE {period} AND b.bd_date <= {_d(as_of)} AND u.email <> 'none' AND u.user_name <> 'PAXminer'
    AND b.q_user_id IS NOT NULL AND a.region NOT IN {_DENY_FACT}"""


ORACLE["post_fact_normalised"] = f"WITH {NORMALISED_CTE}\n{J1_SQL}"
ORACLE["post_fact"] = f"WITH {NORMALISED_CTE}\n{j2_sql(X.FACT_AS_OF, True)}"
ORACLE["post_fact_coq"] = f"WITH {NORMALISED_CTE}\n{j2_sql(X.FACT_AS_OF, False)}"

ORACLE["classify_posts"] = f"""WITH {AWARD_POSTS_CTE}
SELECT email, region, ao_id, date, q_flag,
  CASE WHEN coalesce(regexp_matches(lower(substr(backblast, 1, 100)), '{BB_QS}')
                     OR regexp_matches(lower(ao), '{AO_QS}'), false) THEN 'qsource'
       WHEN coalesce(NOT regexp_matches(lower(substr(backblast, 1, 100)), '{BB_QS}')
                     AND NOT regexp_matches(lower(ao), '{AO_NW}'), false) THEN 'workout'
       ELSE 'other' END AS event_class
FROM award_posts"""


# ---------------------------------------------------------------------------
# home region: four look-back sub-queries joined back, as in the source
# ---------------------------------------------------------------------------

HOME_ATT_CTE = """
home_att AS (
  SELECT CAST(s.s_nationkey AS VARCHAR) AS region, CAST(o.o_custkey AS VARCHAR) AS email,
         'U' || CAST(o.o_custkey AS VARCHAR) || '-' || o.o_orderstatus AS user_id,
         CAST(l.l_shipdate AS DATE) AS bd_date
  FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey JOIN supplier s ON l.l_suppkey = s.s_suppkey
)"""


def home_counts_sql(att: str, as_of, by_user: bool) -> str:
    subs = ",\n".join(
        f"""s{n} AS (SELECT region, email, count(user_id) AS attendance FROM {att}
          WHERE datediff('day', bd_date, {_d(as_of)}) < {n} GROUP BY region, email)"""
        for n in (30, 60, 90, 120)
    )
    joins = "\n".join(f"  LEFT JOIN s{n} ON h.region = s{n}.region AND h.email = s{n}.email" for n in (30, 60, 90, 120))
    user_col = ", h.user_id" if by_user else ""
    return f"""{subs},
counts AS (
  SELECT h.region, h.email{user_col},
    CASE WHEN s30.attendance IS NOT NULL THEN s30.attendance
         WHEN s60.attendance IS NOT NULL THEN s60.attendance
         WHEN s90.attendance IS NOT NULL THEN s90.attendance
         WHEN s120.attendance IS NOT NULL THEN s120.attendance
         ELSE count(h.user_id) END AS attendance
  FROM {att} h
{joins}
  WHERE year(h.bd_date) = {as_of.year}
  GROUP BY h.region, h.email{user_col}, s30.attendance, s60.attendance, s90.attendance, s120.attendance
)"""


ORACLE["home_region_counts"] = (
    f"WITH {HOME_ATT_CTE}, {home_counts_sql('home_att', X.HOME_AS_OF, False)}\nSELECT * FROM counts"
)
ORACLE["home_region"] = f"""WITH {HOME_ATT_CTE}, {home_counts_sql('home_att', X.HOME_AS_OF, False)}
SELECT email, region, attendance FROM (
  SELECT *, row_number() OVER (PARTITION BY email ORDER BY attendance DESC, region DESC) AS rn FROM counts
) WHERE rn = 1"""
ORACLE["home_region_by_user"] = (
    f"WITH {HOME_ATT_CTE}, {home_counts_sql('home_att', X.HOME_AS_OF, True)}\nSELECT * FROM counts"
)
ORACLE["home_region_user_pick"] = f"""WITH {HOME_ATT_CTE}, {home_counts_sql('home_att', X.HOME_AS_OF, True)}
SELECT email, region, attendance, user_id FROM (
  SELECT *, row_number() OVER (PARTITION BY email ORDER BY attendance DESC, region DESC, user_id DESC) AS rn
  FROM counts
) WHERE rn = 1"""

# whole award pipeline on the normalised tables: J1 -> home region -> J2 -> J4 -> awards
ORACLE["awards_national"] = f"""WITH {NORMALISED_CTE},
j1 AS ({J1_SQL}),
{home_counts_sql('j1', X.FACT_AS_OF, False)},
home AS (
  SELECT email, region FROM (
    SELECT *, row_number() OVER (PARTITION BY email ORDER BY attendance DESC, region DESC) AS rn FROM counts)
  WHERE rn = 1
),
j2 AS ({j2_sql(X.FACT_AS_OF, True)}),
award_posts AS (
  SELECT j2.email, j2.user_name, j2.ao_id, j2.ao, j2.date, j2.q_flag, j2.backblast, home.region
  FROM j2 JOIN home ON j2.email = home.email
),
{award_fact_cte()}
{awards_union()}"""


# ---------------------------------------------------------------------------
# award diff, counters, messages
# ---------------------------------------------------------------------------

A_USERS_CTE = """
a_users AS (
  SELECT CAST(s_nationkey AS VARCHAR) AS region, 'U' || CAST(s_suppkey AS VARCHAR) AS user_id,
         CAST(s_suppkey AS VARCHAR) AS email, s_name AS user_name
  FROM supplier
)"""


def _catalogue_list() -> str:
    """The seed catalogue as a DuckDB list of structs (one row per award after ``unnest``)."""
    from rollcall.constants import AWARD_CATALOGUE

    def q(s):
        return "'" + s.replace("'", "''") + "'"

    items = ",\n      ".join(
        f"struct_pack(id := {i}, code := {q(code)}, name := {q(name)}, description := {q(desc)}, verb := {q(verb)})"
        for i, (name, desc, verb, code) in enumerate(AWARD_CATALOGUE, start=1)
    )
    return f"[\n      {items}]"


DIFF_CTES = f"""{AWARD_POSTS_CTE},
{A_USERS_CTE},
{award_fact_cte(X.AWARD_AS_OF, 'fact')},
{award_fact_cte(X.AWARD_HISTORY_AS_OF, 'hfact')},
earned AS ({awards_union(fact='fact')}),
hearned AS ({awards_union(fact='hfact')}),
earned_pax AS (
  SELECT e.achievement_id, e.period_kind, e.period, e.region, u.user_id AS pax_id, e.date_awarded
  FROM earned e JOIN a_users u ON e.region = u.region AND e.email = u.email
),
awarded AS (
  SELECT h.region, h.achievement_id, u.user_id AS pax_id, h.date_awarded
  FROM hearned h JOIN a_users u ON h.region = u.region AND h.email = u.email
),
a_list AS (
  SELECT region, c.id, c.code, c.name, c.description, c.verb
  FROM (SELECT CAST(n_nationkey AS VARCHAR) AS region, n_regionkey, unnest({_catalogue_list()}) AS c FROM nation)
  WHERE NOT (n_regionkey = 1 AND c.id = 4)
),
history AS (
  SELECT a.*, l.code FROM awarded a JOIN a_list l ON a.region = l.region AND a.achievement_id = l.id
  WHERE year(a.date_awarded) = {X.AWARD_AS_OF.year}
),
cfg AS (
  SELECT CAST(n_nationkey AS VARCHAR) AS region,
         CASE WHEN n_regionkey = 4 THEN NULL ELSE 'CACH' || CAST(n_nationkey AS VARCHAR) END AS achievement_channel
  FROM nation
),
elig AS (
  SELECT region, achievement_channel FROM cfg
  WHERE achievement_channel IS NOT NULL
    AND region NOT IN ('f3devcommunity', 'f3development', 'f3csra', 'f3texarcana', 'f3yellowhammer')
    AND region IN (SELECT region FROM a_list)
),
unseen AS (
  SELECT e.* FROM earned_pax e
  WHERE NOT EXISTS (
    SELECT 1 FROM history h
    WHERE h.region = e.region AND h.achievement_id = e.achievement_id
      AND h.pax_id IS NOT DISTINCT FROM e.pax_id
      AND (CASE WHEN h.achievement_id IN (2, 3, 4, 6) THEN month(h.date_awarded)
                WHEN h.achievement_id IN (5, 13) THEN week(h.date_awarded)
                ELSE year(h.date_awarded) END) IS NOT DISTINCT FROM e.period)
),
new AS (
  SELECT u.region, u.achievement_id, u.pax_id, u.date_awarded, u.period_kind, u.period
  FROM unseen u
  WHERE u.region IN (SELECT region FROM elig)
    AND EXISTS (SELECT 1 FROM a_list l WHERE l.region = u.region AND l.id = u.achievement_id)
),
counts AS (SELECT region, pax_id, achievement_id, count(*) AS n FROM history GROUP BY ALL),
ordinals AS (
  SELECT *, coalesce(prior_total, 0) + row_number() OVER (
              PARTITION BY region, pax_id ORDER BY achievement_id, k) AS total_awards,
            coalesce(prior_idx, 0) + k AS nth_time
  FROM (
    SELECT n.*, pt.prior_total, pi.n AS prior_idx,
           row_number() OVER (PARTITION BY n.region, n.pax_id, n.achievement_id
                              ORDER BY n.date_awarded, n.period) AS k
    FROM new n
    LEFT JOIN (SELECT region, pax_id, sum(n) AS prior_total FROM counts GROUP BY ALL) pt
      ON n.region = pt.region AND n.pax_id = pt.pax_id
    LEFT JOIN counts pi ON n.region = pi.region AND n.pax_id = pi.pax_id AND n.achievement_id = pi.achievement_id
  )
)"""

ORACLE["awards_region_users"] = f"WITH {DIFF_CTES}\nSELECT * FROM earned_pax"
ORACLE["award_history"] = f"WITH {DIFF_CTES}\nSELECT region, achievement_id, pax_id, date_awarded, code FROM history"
ORACLE["awards_new"] = f"WITH {DIFF_CTES}\nSELECT * FROM unseen"
ORACLE["awards_eligible"] = f"WITH {DIFF_CTES}\nSELECT region, achievement_id, pax_id, date_awarded FROM new"
ORACLE["award_counts"] = f"WITH {DIFF_CTES}\nSELECT * FROM counts"
ORACLE["award_ordinals"] = f"""WITH {DIFF_CTES}
SELECT region, achievement_id, pax_id, date_awarded, period_kind, period,
       CAST(total_awards AS BIGINT) AS total_awards, CAST(nth_time AS BIGINT) AS nth_time
FROM ordinals"""

_SUFFIX = """CASE WHEN nth_time % 100 BETWEEN 11 AND 13 THEN 'th'
              WHEN nth_time % 10 = 1 THEN 'st' WHEN nth_time % 10 = 2 THEN 'nd'
              WHEN nth_time % 10 = 3 THEN 'rd' ELSE 'th' END"""

ORACLE["award_messages"] = f"""WITH {DIFF_CTES}
SELECT o.region, o.achievement_id, o.pax_id, o.date_awarded,
  CASE WHEN o.achievement_id = 13 AND o.nth_time > 1 THEN o.pax_id ELSE e.achievement_channel END AS target,
  CASE WHEN o.achievement_id = 13 AND o.nth_time > 1
       THEN 'Nice work brother. You just earned 6 pack for the ' || o.nth_time || {_SUFFIX} || ' time this year!'
       ELSE 'Congrats to our man <@' || o.pax_id || '>! He just unlocked the achievement *' || l.name
            || '* for ' || l.verb || ' which he earned on ' || strftime(o.date_awarded, '%Y-%m-%d')
            || '. This is achievement #' || o.total_awards || ' for <@' || o.pax_id || '> and the '
            || o.nth_time || {_SUFFIX}
            || ' time this year he''s earned this award. Keep up the good work!' END AS text
FROM ordinals o
JOIN a_list l ON o.region = l.region AND o.achievement_id = l.id
JOIN elig e ON o.region = e.region"""

ORACLE["run_summary"] = f"""WITH {DIFF_CTES},
logs AS (SELECT CAST(n_nationkey AS VARCHAR) AS region, min('CLOG' || CAST(n_nationkey AS VARCHAR)) AS log_channel
         FROM nation GROUP BY 1)
SELECT e.region, logs.log_channel AS target, CAST(coalesce(c.n, 0) AS BIGINT) AS n_new,
  'Successfully ran today''s Rollcall achievements patch. Sent ' || coalesce(c.n, 0) || ' new achievements.' AS text
FROM elig e
LEFT JOIN (SELECT region, count(*) AS n FROM new GROUP BY region) c ON e.region = c.region
LEFT JOIN logs ON e.region = logs.region"""


# ---------------------------------------------------------------------------
# inactivity report (the source's per-region frames, all regions at once)
# ---------------------------------------------------------------------------

def sql_text(s: str) -> str:
    """A SQL string expression for a Python string (newlines as chr(10))."""
    parts = s.split("\n")
    quoted = ["'" + p.replace("'", "''") + "'" for p in parts]
    return " || chr(10) || ".join(quoted)


def _weeks_ago(as_of_sql: str, col: str) -> str:
    return f"({as_of_sql} - CAST(7 * {col} AS INTEGER))"


REPORT_INPUT_CTES = """
rfact AS (
  SELECT CAST(o.o_custkey AS VARCHAR) AS email, o.o_orderpriority AS ao_id, 'ao-' || lower(o.o_orderpriority) AS ao,
         CAST(o.o_orderdate AS DATE) AS date, CAST(o.o_orderstatus = 'F' AS INTEGER) AS q_flag,
         CAST(c.c_nationkey AS VARCHAR) AS region, 'U' || CAST(o.o_custkey AS VARCHAR) AS user_id
  FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey
),
r_aos AS (
  SELECT region, ao_id AS channel_id, ao,
         CASE WHEN ao_id <> '5-LOW' THEN 'UL' || region || '-' || substr(ao_id, 1, 1) END AS site_q_user_id
  FROM (SELECT DISTINCT region, ao_id, ao FROM rfact)
  UNION ALL
  SELECT region, ao_id, ao, 'UL' || region || '-' || substr(ao_id, 1, 1) || 'b'
  FROM (SELECT DISTINCT region, ao_id, ao FROM rfact) WHERE ao_id = '1-URGENT'
)"""


def report_logic_ctes(fact: str, aos: str, as_of) -> str:
    """The source's per-region report frames for all regions at once, over a fact CTE
    (email, ao_id, ao, date, q_flag, region, user_id) and a site CTE (region, channel_id, ao, site_q_user_id)."""
    a = _d(as_of)
    return f"""
cfg AS (
  SELECT CAST(n_nationkey AS VARCHAR) AS region,
         CASE n_regionkey WHEN 1 THEN 'UL' || CAST(n_nationkey AS VARCHAR) || '-2'
                          WHEN 2 THEN 'C' || CAST(n_nationkey AS VARCHAR)
                          ELSE 'UD' || CAST(n_nationkey AS VARCHAR) END AS default_siteq,
         {X.REPORT_WEEKS['NO_POST_THRESHOLD']} AS NO_POST_THRESHOLD,
         {X.REPORT_WEEKS['NO_Q_THRESHOLD_WEEKS']} AS NO_Q_THRESHOLD_WEEKS,
         {X.REPORT_WEEKS['REMINDER_WEEKS']} AS REMINDER_WEEKS,
         {X.REPORT_WEEKS['NO_Q_THRESHOLD_POSTS']} AS NO_Q_THRESHOLD_POSTS,
         {X.REPORT_WEEKS['HOME_AO_CAPTURE']} AS HOME_AO_CAPTURE
  FROM nation
),
siteq AS (SELECT region, channel_id AS home_ao, ao, site_q_user_id FROM {aos} WHERE site_q_user_id IS NOT NULL),
f AS (SELECT {fact}.*, cfg.* EXCLUDE (region, default_siteq) FROM {fact} JOIN cfg ON {fact}.region = cfg.region),
per_site AS (
  SELECT region, email, ao_id, count(ao) AS n FROM f
  WHERE date > {_weeks_ago(a, 'HOME_AO_CAPTURE')} GROUP BY region, email, ao_id
),
best AS (
  SELECT region, email, ao_id AS home_ao FROM (
    SELECT *, row_number() OVER (PARTITION BY region, email ORDER BY n DESC, ao_id DESC) AS rn FROM per_site)
  WHERE rn = 1
),
df AS (SELECT f.*, best.home_ao FROM f JOIN best ON f.region = best.region AND f.email = best.email),
mia AS (
  SELECT m.region, m.home_ao, m.user_id, m.date, s.ao, s.site_q_user_id
  FROM (SELECT region, email, user_id, home_ao, max(date) AS date FROM df GROUP BY region, email, user_id, home_ao) m
  JOIN cfg ON m.region = cfg.region
  LEFT JOIN siteq s ON m.region = s.region AND m.home_ao = s.home_ao
  WHERE m.date BETWEEN {_weeks_ago(a, 'cfg.REMINDER_WEEKS')} AND {_weeks_ago(a, 'cfg.NO_POST_THRESHOLD')}
),
lowq AS (
  SELECT m.region, m.home_ao, m.user_id, m.date, s.ao, s.site_q_user_id
  FROM (SELECT region, email, user_id, home_ao, max(date) AS date FROM df WHERE q_flag = 1
        GROUP BY region, email, user_id, home_ao) m
  JOIN cfg ON m.region = cfg.region
  LEFT JOIN siteq s ON m.region = s.region AND m.home_ao = s.home_ao
  WHERE m.date BETWEEN {_weeks_ago(a, 'cfg.REMINDER_WEEKS')} AND {_weeks_ago(a, 'cfg.NO_Q_THRESHOLD_POSTS')}
    AND m.user_id NOT IN (SELECT user_id FROM mia WHERE mia.region = m.region)
),
noq AS (
  SELECT m.region, m.home_ao, m.user_id, s.ao, s.site_q_user_id
  FROM (
    SELECT DISTINCT df.region, df.email, df.user_id, df.home_ao
    FROM df
    JOIN (SELECT region, email FROM df GROUP BY region, email, user_id HAVING sum(q_flag) = 0) z
      ON df.region = z.region AND df.email = z.email
    JOIN cfg ON df.region = cfg.region
    WHERE df.date BETWEEN {_weeks_ago(a, 'cfg.REMINDER_WEEKS')} AND {_weeks_ago(a, 'cfg.NO_Q_THRESHOLD_WEEKS')}
  ) m
  LEFT JOIN siteq s ON m.region = s.region AND m.home_ao = s.home_ao
  WHERE m.user_id NOT IN (SELECT user_id FROM mia WHERE mia.region = m.region)
    AND m.user_id NOT IN (SELECT user_id FROM lowq WHERE lowq.region = m.region)
),
lines AS (
  SELECT region, site_q_user_id, user_id, 1 AS section, -datediff('day', DATE '1970-01-01', date) AS k1,
         user_id AS k2,
         {sql_text(chr(10) + '- <@')} || user_id || '> last posted ' || strftime(date, '%B %d, %Y') AS line
  FROM mia
  UNION ALL
  SELECT region, site_q_user_id, user_id, 2, datediff('day', date, {a}), user_id,
         {sql_text(chr(10) + '- <@')} || user_id || '>: ' || datediff('day', date, {a}) || '!'
  FROM lowq
  UNION ALL
  SELECT region, site_q_user_id, user_id, 3, 0, user_id, {sql_text(chr(10) + '- <@')} || user_id || '>'
  FROM noq
),
rx AS (
  SELECT DISTINCT region, site_q_user_id AS recipient, false AS is_default FROM lines
  WHERE site_q_user_id IS NOT NULL
  UNION ALL
  SELECT region, default_siteq, true FROM cfg c
  WHERE default_siteq IS NOT NULL
    AND NOT EXISTS (SELECT 1 FROM siteq s WHERE s.region = c.region AND s.site_q_user_id = c.default_siteq)
)"""


REPORT_CTES = REPORT_INPUT_CTES + "," + report_logic_ctes("rfact", "r_aos", X.REPORT_AS_OF)

ORACLE["home_site"] = f"WITH {REPORT_CTES}\nSELECT * FROM best"
ORACLE["report_mia"] = f"WITH {REPORT_CTES}\nSELECT * FROM mia"
ORACLE["report_lowq"] = f"WITH {REPORT_CTES}\nSELECT * FROM lowq"
ORACLE["report_noq"] = f"WITH {REPORT_CTES}\nSELECT * FROM noq"
ORACLE["report_recipients"] = f"WITH {REPORT_CTES}\nSELECT * FROM rx"


REPORT_TEXT_SELECT = f"""
SELECT region, recipient, 0 AS section, 0 AS is_line, CAST(0 AS BIGINT) AS k1, '' AS k2,
  'Howdy, <' || CASE WHEN upper(substr(recipient, 1, 1)) = 'U' THEN '@' || recipient ELSE '!channel' END
  || '>! This is your weekly Rollcall Site Q report. According to my records...' AS text
FROM rx
UNION ALL
SELECT DISTINCT r.region, r.recipient, l.section, 0, CAST(0 AS BIGINT), '', CASE l.section
  WHEN 1 THEN {sql_text(chr(10) * 2 + "The following men haven't posted in a while.")}
  WHEN 2 THEN {sql_text(chr(10) * 2 + "These guys haven't Q'd in a while. Here's how many days it's been:")}
  ELSE {sql_text(chr(10) * 2 + "These guys have never been Q:")} END
FROM rx r JOIN lines l ON l.region = r.region AND (r.is_default OR l.site_q_user_id = r.recipient)
UNION ALL
SELECT r.region, r.recipient, l.section, 1, CAST(l.k1 AS BIGINT), l.k2, l.line
FROM rx r JOIN lines l ON l.region = r.region AND (r.is_default OR l.site_q_user_id = r.recipient)
UNION ALL
SELECT region, recipient, 4, 0, CAST(0 AS BIGINT), '',
  {sql_text(chr(10) * 2 + 'Note: If you have listed your site Qs on your aos table, this information will have gone out to them as well.')}
FROM rx WHERE is_default"""

ORACLE["report_text"] = f"WITH {REPORT_CTES}\n{REPORT_TEXT_SELECT}"

# whole report on the normalised tables: J1 by user -> home -> J2 (all history) -> J4 with user id -> report
ORACLE["report_national"] = f"""WITH {NORMALISED_CTE},
j1 AS ({J1_SQL}),
{home_counts_sql('j1', X.FACT_AS_OF, True)},
home AS (
  SELECT email, region, user_id FROM (
    SELECT *, row_number() OVER (PARTITION BY email ORDER BY attendance DESC, region DESC, user_id DESC) AS rn
    FROM counts)
  WHERE rn = 1
),
j2 AS ({j2_sql(X.FACT_AS_OF, False)}),
nfact AS (
  SELECT j2.email, j2.ao_id, j2.ao, j2.date, j2.q_flag, home.region, home.user_id
  FROM j2 JOIN home ON j2.email = home.email
),
n_sites AS (SELECT region, channel_id, ao, CAST(NULL AS VARCHAR) AS site_q_user_id FROM n_aos),
{report_logic_ctes('nfact', 'n_sites', X.FACT_AS_OF)}
{REPORT_TEXT_SELECT}"""


# ---------------------------------------------------------------------------
# photo archive
# ---------------------------------------------------------------------------

def _epoch(d) -> int:
    import datetime as dt

    return int((dt.datetime(d.year, d.month, d.day) - dt.datetime(1970, 1, 1)).total_seconds())


def _photo_month():
    d = X.PHOTO_AS_OF
    import datetime as dt

    start = dt.date(d.year - 1, 12, 1) if d.month == 1 else dt.date(d.year, d.month - 1, 1)
    return _epoch(start), _epoch(dt.date(d.year, d.month, 1))


def _sites_list() -> str:
    from rollcall.constants import SITE_GPS

    return "[" + ", ".join(f"'{r[0]}'" for r in SITE_GPS) + "]"


def _gps_values() -> str:
    from rollcall.constants import SITE_GPS

    def rational(dms) -> str:
        return ",".join(f"{n}/{d}" for n, d in dms)

    rows = [f"('{c}', '{t[1]}', '{rational(t[2])}', '{t[3]}', '{rational(t[4])}')" for c, t in SITE_GPS]
    return ",\n    ".join(rows)


_LO, _HI = _photo_month()

PHOTO_CTES = f"""
pdocs AS (
  SELECT d.doc_id, d.text, d.lang, d.source, d.n_chars, p.url, d.doc_id // 4 AS msg
  FROM documents d LEFT JOIN pages p ON d.doc_id = p.page_id
),
msgs AS (
  SELECT msg, arg_min(source, doc_id) AS source, arg_min(text, doc_id) AS text0,
    CASE WHEN min(lang) = 'es' AND max(lang) = 'es' THEN NULL ELSE
      list(struct_pack(
        id := 'F' || CAST(doc_id AS VARCHAR),
        filetype := CASE lang WHEN 'en' THEN 'jpg' WHEN 'fr' THEN 'png' WHEN 'de' THEN 'pdf' ELSE 'PNG' END,
        mimetype := CASE lang WHEN 'en' THEN 'image/jpeg' WHEN 'de' THEN 'application/pdf' ELSE 'image/png' END,
        url_private := url,
        original_w := CASE WHEN lang = 'de' THEN NULL ELSE CAST(n_chars AS INTEGER) END) ORDER BY doc_id) END AS files
  FROM pdocs GROUP BY msg
),
messages AS (
  SELECT coalesce(list_extract({_sites_list()}, TRY_CAST(substr(source, 4, 10) AS INTEGER) + 1), 'ao-' || source) AS channel,
         CAST({X.PHOTO_TS_BASE} + ((msg * 104729) % {X.PHOTO_TS_SPAN}) AS VARCHAR) || '.'
           || lpad(CAST(msg % 1000000 AS VARCHAR), 6, '0') AS ts,
         'U' || upper(source) AS "user",
         'Photos by <@U' || upper(source) || '> with <@UX' || CAST(msg AS VARCHAR) || '> ' || text0 AS text,
         files
  FROM msgs
),
flat AS (
  SELECT channel, ts, "user", text, NULL AS file_id, NULL AS filetype, NULL AS mimetype, NULL AS file_url,
         false AS file_is_photo
  FROM messages WHERE files IS NULL
  UNION ALL
  SELECT channel, ts, "user", text, f.id, f.filetype, f.mimetype, f.url_private, f.original_w IS NOT NULL
  FROM (SELECT *, unnest(files) AS f FROM messages WHERE files IS NOT NULL)
),
names AS (
  SELECT id, '@' || replace(CASE WHEN display_name = '' THEN real_name ELSE display_name END, ' ', '_') AS pax,
         '<@' || id || '>' AS mention
  FROM (
    SELECT 'U' || upper(source) AS id,
           CASE WHEN source LIKE '%0' OR source LIKE '%5' THEN '' ELSE 'Pax ' || source END AS display_name,
           'Real Name ' || source AS real_name
    FROM (SELECT DISTINCT source FROM documents)
  )
),
photos AS (
  SELECT * FROM flat
  WHERE file_is_photo AND CAST(ts AS DOUBLE) >= {_LO} AND CAST(ts AS DOUBLE) < {_HI}
),
found AS (
  SELECT p.channel, p.ts, p.file_id, n.mention, n.pax
  FROM (SELECT channel, ts, file_id, unnest(list_distinct(regexp_extract_all(text, '<@[^<>]*>'))) AS mention
        FROM photos) p
  JOIN names n ON p.mention = n.mention
  WHERE n.pax IS NOT NULL
),
rows AS (
  SELECT p.channel, p.ts, p."user",
    list_reduce(
      list_prepend(p.text, coalesce((SELECT list(f.mention || chr(1) || f.pax) FROM found f
                                     WHERE f.channel = p.channel AND f.ts = p.ts AND f.file_id = p.file_id), [])),
      lambda acc, kv: replace(acc, split_part(kv, chr(1), 1), split_part(kv, chr(1), 2))) AS text,
    p.file_id, p.filetype, p.mimetype, p.file_url,
    CAST(make_timestamp(CAST(CAST(p.ts AS DOUBLE) * 1000000 AS BIGINT)) AS DATE) AS date,
    n.pax
  FROM photos p LEFT JOIN names n ON p."user" = n.id
),
contents AS (SELECT 'F' || CAST(doc_id AS VARCHAR) AS file_id, md5(text) AS checksum FROM documents),
seen AS (
  SELECT DISTINCT c.checksum FROM flat f JOIN contents c ON f.file_id = c.file_id
  WHERE f.file_is_photo AND CAST(f.ts AS DOUBLE) < {_LO}
),
dedup AS (
  SELECT * EXCLUDE (rn) FROM (
    SELECT r.*, c.checksum,
           row_number() OVER (PARTITION BY c.checksum ORDER BY CAST(r.ts AS DOUBLE), r.ts, r.file_id) AS rn
    FROM rows r JOIN contents c ON r.file_id = c.file_id
    WHERE c.checksum NOT IN (SELECT checksum FROM seen)
  ) WHERE rn = 1
),
gps(channel, gps_lat_ref, gps_lat, gps_lon_ref, gps_lon) AS (VALUES
    {_gps_values()}
)"""

ORACLE["message_files"] = f"WITH {PHOTO_CTES}\nSELECT * FROM flat"
ORACLE["photo_rows"] = f"WITH {PHOTO_CTES}\nSELECT * FROM rows"
ORACLE["photo_dedup"] = f"WITH {PHOTO_CTES}\nSELECT * FROM dedup"
ORACLE["photo_manifest"] = f"""WITH {PHOTO_CTES}
SELECT d.file_id, d.checksum, d.channel,
  d.file_id || '.' || CASE WHEN lower(d.filetype) = 'png' THEN 'jpg' ELSE d.filetype END AS target_name,
  CASE WHEN lower(d.filetype) = 'png' THEN 'jpg' ELSE d.filetype END AS target_filetype,
  substr('Posted by: ' || coalesce(d.pax, 'nan') || chr(10) || 'Posted on: ' || strftime(d.date, '%Y-%m-%d')
         || chr(10) || 'Posted in:' || d.channel || chr(10) || chr(10) || d.text, 1, 1000) AS description,
  strftime(d.date, '%Y:%m:%d') || ' 06:30:00' AS exif_date, '-06:00' AS exif_offset,
  g.gps_lat_ref, g.gps_lat, g.gps_lon_ref, g.gps_lon
FROM dedup d LEFT JOIN gps g ON d.channel = g.channel"""


# ---------------------------------------------------------------------------
# catalogue view and manual tags
# ---------------------------------------------------------------------------

ORACLE["trophy_view"] = f"""WITH {DIFF_CTES}
SELECT u.region, u.user_name AS pax, u.user_id AS pax_id, l.name, l.description, a.date_awarded
FROM a_users u
JOIN awarded a ON u.region = a.region AND u.user_id = a.pax_id
JOIN a_list l ON a.region = l.region AND a.achievement_id = l.id"""

ORACLE["manual_tags"] = f"""WITH {NORMALISED_CTE},
j1 AS ({J1_SQL}),
{home_counts_sql('j1', X.FACT_AS_OF, False)},
home AS (
  SELECT email, region FROM (
    SELECT *, row_number() OVER (PARTITION BY email ORDER BY attendance DESC, region DESC) AS rn FROM counts)
  WHERE rn = 1
),
j2 AS ({j2_sql(X.FACT_AS_OF, True)}),
fact AS (SELECT j2.*, home.region FROM j2 JOIN home ON j2.email = home.email),
a_list AS (
  SELECT region, c.id, c.code, c.name, c.description, c.verb
  FROM (SELECT CAST(n_nationkey AS VARCHAR) AS region, n_regionkey, unnest({_catalogue_list()}) AS c FROM nation)
  WHERE NOT (n_regionkey = 1 AND c.id = 4)
),
tags AS (
  SELECT region, email, ao_id, date,
         unnest(list_distinct(regexp_extract_all(backblast, '(?m)^Achievement: *(\\S+)', 1))) AS code
  FROM fact
)
SELECT l.id AS achievement_id, t.code, t.email, t.region, t.ao_id, t.date AS date_awarded
FROM tags t JOIN a_list l ON t.region = l.region AND t.code = l.code"""

# people who ever led: the led posts of the full-history national fact
ORACLE["ever_led"] = f"""WITH {NORMALISED_CTE},
j2 AS ({j2_sql(X.FACT_AS_OF, False)})
SELECT DISTINCT email FROM j2 WHERE q_flag = 1"""

ORACLE["ever_led_state"] = ORACLE["ever_led"]


# ---------------------------------------------------------------------------
# the league
# ---------------------------------------------------------------------------

def _league_name(key: str) -> str:
    return (
        f"CASE {key} WHEN 3 THEN 'f3csra' WHEN 7 THEN 'f3devcommunity' WHEN 9 THEN 'x9' WHEN 11 THEN 'f3yellowhammer' "
        f"ELSE 'f3r' || CAST({key} AS VARCHAR) END"
    )


LEAGUE_CTES = f"""
lb AS (
  SELECT {_league_name('c.c_nationkey')} AS region, CAST(o.o_custkey AS VARCHAR) AS user_id,
         CAST(l.l_linenumber AS VARCHAR) AS ao_id, CAST(date_trunc('week', l.l_shipdate) AS DATE) AS date,
         l.l_orderkey, l.l_quantity
  FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey JOIN customer c ON o.o_custkey = c.c_custkey
),
ll AS (
  SELECT region, ao_id, year(date) AS year, min(user_id) AS lo, max(user_id) AS hi FROM lb GROUP BY region, ao_id, year(date)
),
n_beatdowns AS (
  SELECT e.region, e.ao_id, e.date AS bd_date, CASE WHEN k % 11 <> 0 THEN lo END AS q_user_id,
         CASE WHEN hi <> lo THEN hi END AS coq_user_id,
         CASE WHEN maxq >= 49 THEN NULL WHEN minq <= 4 THEN 'QSource 2.1 lesson' ELSE 'Beatdown in the rain' END AS backblast
  FROM (SELECT region, ao_id, date, min(l_orderkey) AS k, min(l_quantity) AS minq, max(l_quantity) AS maxq
        FROM lb GROUP BY region, ao_id, date) e
  JOIN ll ON e.region = ll.region AND e.ao_id = ll.ao_id AND year(e.date) = ll.year
),
n_attendance AS (
  SELECT lb.region, lb.user_id, lb.ao_id, CASE WHEN lb.l_orderkey % 2 = 0 THEN ll.lo ELSE ll.hi END AS q_user_id, lb.date
  FROM lb JOIN ll ON lb.region = ll.region AND lb.ao_id = ll.ao_id AND year(lb.date) = ll.year
),
n_users AS (
  SELECT {_league_name('c_nationkey')} AS region, CAST(c_custkey AS VARCHAR) AS user_id,
         CASE WHEN c_custkey % 53 = 0 THEN NULL WHEN c_acctbal < 0 THEN 'none'
              ELSE 'pax' || CAST(c_custkey AS VARCHAR) || '@example.org' END AS email,
         CASE WHEN c_custkey % 97 = 0 THEN 'PAXminer' ELSE c_name END AS user_name
  FROM customer
),
n_aos AS (
  SELECT region, CAST(no AS VARCHAR) AS channel_id,
         CASE no WHEN 6 THEN '3rd-F-QSource' WHEN 7 THEN 'ao-the-ruck' ELSE 'ao-' || CAST(no AS VARCHAR) END AS ao,
         CASE WHEN no <= 4 THEN 'UL' || region || '-' || CAST(no AS VARCHAR) END AS site_q_user_id
  FROM (SELECT {_league_name('n_nationkey')} AS region, unnest(range(1, 8)) AS no FROM nation)
)"""

_LISTED = "a.region LIKE 'f3%' AND "


def _listed(sql: str) -> str:
    """A national join restricted to the region list."""
    return sql.replace("WHERE ", f"WHERE {_LISTED}", 1)


ORACLE["league_posts"] = f"""WITH {LEAGUE_CTES},
j2 AS ({_listed(j2_sql(X.FACT_AS_OF, True))})
SELECT email, ao_id, ao, date, q_flag,
       coalesce(regexp_matches(lower(substr(backblast, 1, 100)), '{BB_QS}') OR regexp_matches(lower(ao), '{AO_QS}'), false) AS is_qs,
       coalesce(NOT regexp_matches(lower(substr(backblast, 1, 100)), '{BB_QS}')
                AND NOT regexp_matches(lower(ao), '{AO_NW}'), false) AS is_w,
       site_region, user_id
FROM j2"""

ORACLE["league_home"] = f"""WITH {LEAGUE_CTES},
j1 AS ({_listed(J1_SQL)}),
{home_counts_sql('j1', X.FACT_AS_OF, False)}
SELECT email, region, attendance FROM (
  SELECT *, row_number() OVER (PARTITION BY email ORDER BY attendance DESC, region DESC) AS rn FROM counts
) WHERE rn = 1"""

ORACLE["league_lists"] = f"""
SELECT region, c.id, c.name, c.description, c.verb, c.code
FROM (SELECT {_league_name('n_nationkey')} AS region, unnest({_catalogue_list()}) AS c FROM nation)
WHERE region LIKE 'f3%'"""

LEAGUE_REPORT = f"""WITH {LEAGUE_CTES},
j1 AS ({_listed(J1_SQL)}),
{home_counts_sql('j1', X.FACT_AS_OF, True)},
home AS (
  SELECT email, region, user_id FROM (
    SELECT *, row_number() OVER (PARTITION BY email ORDER BY attendance DESC, region DESC, user_id DESC) AS rn
    FROM counts)
  WHERE rn = 1
),
j2 AS ({_listed(j2_sql(X.FACT_AS_OF, False))}),
nfact AS (
  SELECT j2.email, j2.ao_id, j2.ao, j2.date, j2.q_flag, home.region, home.user_id
  FROM j2 JOIN home ON j2.email = home.email
),
{report_logic_ctes('nfact', 'listed_aos', X.FACT_AS_OF)}"""
_CFG = report_logic_ctes("nfact", "listed_aos", X.FACT_AS_OF)
LEAGUE_REPORT = LEAGUE_REPORT.replace(
    _CFG,
    "listed_aos AS (SELECT * FROM n_aos WHERE region LIKE 'f3%'),\n"
    + _CFG.replace("SELECT CAST(n_nationkey AS VARCHAR) AS region,", f"SELECT {_league_name('n_nationkey')} AS region,").replace(
        "FROM nation\n)", f"FROM nation WHERE {_league_name('n_nationkey')} LIKE 'f3%'\n)"
    ),
)
ORACLE["league_noq"] = f"{LEAGUE_REPORT}\nSELECT * FROM noq"
ORACLE["league_report"] = f"{LEAGUE_REPORT}\n{REPORT_TEXT_SELECT}"

ORACLE["award_notifications"] = f"""
SELECT 'award' AS kind, region, target, text, {_d(X.AWARD_AS_OF)} AS run_date FROM ({ORACLE['award_messages']})
UNION ALL
SELECT 'award_summary', region, target, text, {_d(X.AWARD_AS_OF)} FROM ({ORACLE['run_summary']})"""

ORACLE["award_records"] = f"""WITH {DIFF_CTES}
SELECT region, achievement_id, pax_id, date_awarded, {_d(X.AWARD_AS_OF)} AS run_date, count(*) AS n, count(*) AS n_ids
FROM new GROUP BY region, achievement_id, pax_id, date_awarded"""
