"""The windowed reports as queries over one window, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import ranges as R
from . import views as V
from .registry import query
from .view_queries import ALL, ATTRIBUTION, BOOKED, NEWEST, POSITIVE, REPLIES, SENT, SENT_NOW, THREADS

START, END = "2001-03-01", "2024-01-20"
#: The day of the delta report.
DAY = "2000-01-01"


def _in(column: str) -> str:
    return f"({column} BETWEEN timestamp '{START} 00:00:00' AND timestamp '{END} 23:59:59.999')"


WON = f"is_closed_won AND is_outbound_attributed AND {_in('closedate')}"
TOUCH = f"({_in('closedate')} OR {_in('createdate')})"
CAMPAIGNS = f"(SELECT campaign_id, sent_count, replied_count FROM campaign_snapshot WHERE {SENT_NOW} AND {_in('created_at')})"
HERE = f"(SELECT * FROM attribution WHERE {_in('last_activity')})"
SUMS = "cast(coalesce(sum(sent_count), 0) AS bigint) AS sent, cast(coalesce(sum(replied_count), 0) AS bigint) AS replied"

query(
    "q1_headline_by_range",
    f"""SELECT *, '{START}' AS window_start, '{END}' AS window_end FROM (SELECT {SUMS} FROM {CAMPAIGNS}),
    (SELECT count(DISTINCT lead_email) FILTER (is_positive) AS positives, count(DISTINCT lead_email) FILTER (is_call_booked) AS meetings FROM {HERE} WHERE lead_email <> ''),
    (SELECT count(*) AS closed_won, round(coalesce(sum(amount), 0), 2) AS closed_won_amount FROM deal_dim WHERE {WON})""",
    (*ALL, *SENT),
    ATTRIBUTION,
)(lambda t: R.headline(t, START, END))

query(
    "q2_per_rep_mpc_by_range",
    f"""SELECT rep_key, coalesce(sent, 0) AS sent, coalesce(replied, 0) AS replied, coalesce(positives, 0) AS positives, coalesce(mpc_meetings, 0) AS mpc_meetings, coalesce(mpc_meetings, 0) AS calls_booked,
        coalesce(total_meetings, 0) AS total_meetings, coalesce(closed_won, 0) AS closed_won, coalesce(won_amount, 0) AS won_amount
    FROM (SELECT assigned_rep AS rep_key, {SUMS} FROM {CAMPAIGNS} JOIN campaign_dim USING (campaign_id) WHERE is_mpc AND assigned_rep <> '' GROUP BY 1)
    FULL JOIN (SELECT rep_key, count(DISTINCT conv_id) FILTER (is_positive AND campaign_is_mpc) AS positives, count(DISTINCT conv_id) FILTER (is_call_booked AND campaign_is_mpc) AS mpc_meetings,
            count(DISTINCT conv_id) FILTER (is_call_booked) AS total_meetings FROM {HERE} WHERE rep_key <> '' GROUP BY 1 HAVING positives + total_meetings > 0) USING (rep_key)
    FULL JOIN (SELECT attributed_rep AS rep_key, count(*) AS closed_won, round(sum(amount), 2) AS won_amount FROM deal_dim WHERE {WON} AND campaign_is_mpc AND attributed_rep <> '' GROUP BY 1) USING (rep_key)""",
    (*ALL, *SENT),
    ATTRIBUTION,
)(lambda t: R.per_rep_mpc(t, START, END))

query(
    "q3_per_rep_nonmpc_by_range",
    f"""SELECT rep_key, coalesce(threads, 0) AS threads, coalesce(positives, 0) AS positives, coalesce(calls, 0) AS calls, coalesce(closed_won, 0) AS closed_won, coalesce(won_amount, 0) AS won_amount,
        coalesce(active_pipeline, 0) AS active_pipeline, round(CASE WHEN total > 0 THEN closed_won / total ELSE 0 END, 6) AS close_rate
    FROM (SELECT rep_key, count(*) AS threads, count(*) FILTER (is_positive) AS positives, count(*) FILTER (is_call_booked) AS calls FROM {HERE} WHERE rep_key <> '' AND NOT campaign_is_mpc GROUP BY 1)
    FULL JOIN (SELECT attributed_rep AS rep_key, count(*) FILTER (is_closed_won) AS closed_won, round(coalesce(sum(amount) FILTER (is_closed_won), 0), 2) AS won_amount,
            count(*) FILTER (is_closed_won IS NOT true AND coalesce(stage_label, '') NOT ILIKE '%lost%') AS active_pipeline, count(*) AS total
        FROM deal_dim WHERE is_outbound_attributed AND campaign_is_mpc IS NOT true AND attributed_rep <> '' AND {TOUCH} GROUP BY 1) USING (rep_key)""",
    ALL,
    ATTRIBUTION,
)(lambda t: R.per_rep_nonmpc(t, START, END))


def _breakdown(by: str, fallback: str) -> str:
    return f"""SELECT coalesce(nullif(p.{by}, ''), '{fallback}') AS bucket, count(*) AS threads, count(*) FILTER ({POSITIVE}) AS positives, count(*) FILTER ({BOOKED}) AS calls
        FROM thread_snapshot m LEFT JOIN contact_dim p ON p.email = lower(m.lead_email) WHERE {NEWEST} AND m.lead_email <> '' AND {_in('m.last_activity')} GROUP BY 1"""


query("q4_industry_by_range", _breakdown("industry", V.NO_INDUSTRY), ("thread_snapshot", "contact_dim"))(lambda t: R.breakdown(t, "industry", V.NO_INDUSTRY, START, END))
query("q4_job_function_by_range", _breakdown("job_function", V.NO_FUNCTION), ("thread_snapshot", "contact_dim"))(lambda t: R.breakdown(t, "job_function", V.NO_FUNCTION, START, END))

_REPLY = f"SELECT {', '.join(R.REPLY_COLUMNS)} FROM replies"
_shown = lambda df: df.withColumn("label_names", F.array_join("label_names", ","))
query("q5_positive_replies", _REPLY, THREADS, REPLIES)(lambda t: _shown(R.positive_replies(t)))
query("q5_positive_replies_by_range", f"{_REPLY} WHERE {_in('last_activity')}", THREADS, REPLIES)(lambda t: _shown(R.positive_replies(t, START, END)))
query("q5_positive_replies_by_industry", f"{_REPLY} WHERE industry = 'BUILDING' AND {_in('last_activity')}", THREADS, REPLIES)(lambda t: _shown(R.positive_replies(t, START, END, "BUILDING")))

_DEALS = f"SELECT {', '.join(R.DEAL_COLUMNS)} FROM deal_dim WHERE is_outbound_attributed"
query("q6_won_deals", f"{_DEALS} AND is_closed_won", ("deal_dim",))(lambda t: R.deals(t, True))
query("q6_won_deals_by_range", f"{_DEALS} AND is_closed_won AND {_in('closedate')}", ("deal_dim",))(lambda t: R.deals(t, True, START, END))
query("q6_attributed_deals", _DEALS, ("deal_dim",))(lambda t: R.deals(t, False))
query("q6_attributed_deals_by_range", f"{_DEALS} AND {TOUCH}", ("deal_dim",))(lambda t: R.deals(t, False, START, END))

query(
    "q7_cohort_summary_by_range",
    f"""SELECT cohort, coalesce(campaigns, 0) AS campaigns, coalesce(sent, 0) AS sent, coalesce(replied, 0) AS replied, coalesce(positives, 0) AS positives, coalesce(calls, 0) AS calls, coalesce(closed_won, 0) AS closed_won,
        coalesce(revenue, 0) AS revenue, round(CASE WHEN sent > 0 THEN replied / sent ELSE 0 END, 6) AS reply_rate, round(CASE WHEN positives > 0 THEN calls / positives ELSE 0 END, 6) AS meeting_to_positive
    FROM (VALUES ('MPC', true), ('Non-MPC', false)) g(cohort, flagged)
    LEFT JOIN (SELECT is_mpc IS true AS flagged, count(*) AS campaigns, {SUMS} FROM {CAMPAIGNS} LEFT JOIN campaign_dim USING (campaign_id) GROUP BY 1) USING (flagged)
    LEFT JOIN (SELECT campaign_is_mpc AS flagged, count(DISTINCT nullif(lead_email, '')) FILTER (is_positive) AS positives, count(DISTINCT conv_id) FILTER (is_call_booked) AS calls FROM {HERE} GROUP BY 1) USING (flagged)
    LEFT JOIN (SELECT campaign_is_mpc IS true AS flagged, count(*) AS closed_won, round(sum(amount), 2) AS revenue FROM deal_dim WHERE {WON} GROUP BY 1) USING (flagged)""",
    (*ALL, *SENT),
    ATTRIBUTION,
)(lambda t: R.cohort_summary(t, START, END))

query(
    "q7_candidates_by_range",
    f"""SELECT candidate, partner_rep, coalesce(campaigns, 0) AS campaigns, coalesce(sent, 0) AS sent, coalesce(replied, 0) AS replied, coalesce(positives, 0) AS positives, coalesce(calls, 0) AS calls,
        round(CASE WHEN sent > 0 THEN coalesce(positives, 0) / sent ELSE 0 END, 6) AS pos_rate, industry
    FROM (SELECT mpc_candidate AS candidate, count(*) AS campaigns, {SUMS} FROM {CAMPAIGNS} JOIN campaign_dim USING (campaign_id) WHERE is_mpc AND mpc_candidate <> '' GROUP BY 1)
    FULL JOIN (SELECT mpc_candidate AS candidate, count(DISTINCT lead_email) FILTER (is_positive AND lead_email <> '') AS positives, count(DISTINCT conv_id) FILTER (is_call_booked) AS calls
        FROM {HERE} WHERE campaign_is_mpc AND mpc_candidate <> '' GROUP BY 1 HAVING count(*) FILTER ((is_positive AND lead_email <> '') OR is_call_booked) > 0) USING (candidate)
    LEFT JOIN (SELECT mpc_candidate AS candidate, max(assigned_rep) AS partner_rep FROM campaign_dim WHERE is_mpc AND assigned_rep <> '' GROUP BY 1) USING (candidate)
    LEFT JOIN (SELECT mpc_candidate AS candidate, industry FROM attribution JOIN contact_dim ON contact_dim.email = lead_email WHERE campaign_is_mpc AND mpc_candidate IS NOT NULL AND industry <> '{V.NO_INDUSTRY}'
        GROUP BY mpc_candidate, industry QUALIFY row_number() OVER (PARTITION BY mpc_candidate ORDER BY count(*) DESC, industry) = 1) USING (candidate)""",
    (*ALL, *SENT),
    ATTRIBUTION,
)(lambda t: R.candidates(t, START, END))


def _delta(n: str) -> str:
    return f"CASE WHEN b.prior_{n} IS NULL THEN '' WHEN a.{n} = b.prior_{n} THEN '±0' ELSE CASE WHEN a.{n} > b.prior_{n} THEN '+' ELSE '' END || format('{{:,}}', a.{n} - b.prior_{n}) END AS {n}_delta"


_TOTALS = "count(*) AS {p}campaigns, cast(sum(sent_count) AS bigint) AS {p}sent, cast(sum(replied_count) AS bigint) AS {p}replied, cast(sum(positive_reply_count) AS bigint) AS {p}positives"
query(
    "q8_snapshot_delta",
    f"""SELECT a.*, b.*, (SELECT count(*) FROM campaign_snapshot x WHERE x.snapshot_date = date '{DAY}' AND x.campaign_id NOT IN (SELECT campaign_id FROM campaign_snapshot WHERE snapshot_date < date '{DAY}')) AS new_campaigns,
        {_delta("sent")}, {_delta("replied")}, {_delta("positives")}
    FROM (SELECT {_TOTALS.format(p="")} FROM campaign_snapshot WHERE snapshot_date = date '{DAY}') a
    LEFT JOIN (SELECT snapshot_date AS prior_date, {_TOTALS.format(p="prior_")} FROM campaign_snapshot WHERE snapshot_date < date '{DAY}' GROUP BY 1 ORDER BY 1 DESC LIMIT 1) b ON true""",
    SENT,
)(lambda t: R.snapshot_delta(t, DAY))
