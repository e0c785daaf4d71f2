"""The views as queries, each with SQL written independently for DuckDB."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import views as V
from .registry import query

THREADS = ("thread_snapshot", "rep_dim", "appt_backfill", "appt_event", "thread_campaign", "contact_dim", "campaign_dim", "deal_dim")
ALL = (*THREADS, "baseline_thread")
SENT = ("campaign_snapshot",)

POSITIVE = f"(list_contains(label_names, '{V.INTERESTED}') OR list_contains(label_names, '{V.BOOKED}'))"
BOOKED = f"list_contains(label_names, '{V.BOOKED}')"
NEWEST = "snapshot_date = (SELECT max(snapshot_date) FROM thread_snapshot)"
SENT_NOW = "snapshot_date = (SELECT max(snapshot_date) FROM campaign_snapshot)"
WON = "is_closed_won AND is_outbound_attributed"

#: The pieces that several views share: whose thread it is, and what is known of its lead.
PIECES = f"""
signature AS (SELECT s.conv_id, s.snapshot_date, s.lead_email, unnest(s.authors) AS mail, unnest(coalesce(s.author_names, [])) AS who FROM thread_snapshot s WHERE {NEWEST}),
signer AS (SELECT g.conv_id, g.lead_email IS NOT NULL AS addressed, min(r.rep_key) AS signed_rep FROM signature g, rep_dim r
    WHERE lower(g.mail) = lower(r.rep_email) OR lower(split_part(g.mail, '@', 1)) = lower(r.rep_key)
       OR lower(r.rep_key) = lower(split_part(coalesce(g.who, ''), ' ', 1))
       OR (lower(split_part(coalesce(g.who, ''), ' ', 1)) = 'nat' AND r.rep_key = 'NATION_3')
    GROUP BY ALL),
appt AS (SELECT email, rep_key AS appt_rep FROM (
        SELECT lower(email) AS email, rep_key, cast(meeting_date AS timestamp) AS met FROM appt_backfill WHERE email > '' AND rep_key IS NOT NULL
        UNION ALL SELECT lower(lead_email), rep_key, meeting_at FROM appt_event WHERE lead_email > '' AND rep_key IS NOT NULL)
    QUALIFY row_number() OVER (PARTITION BY email ORDER BY met DESC NULLS LAST, rep_key) = 1),
rich AS (SELECT lower(lead_email) AS email, is_mpc AS e_mpc, mpc_candidate AS e_cand, campaign_name AS e_name FROM thread_campaign WHERE lead_email IS NOT NULL
    QUALIFY row_number() OVER (PARTITION BY lower(lead_email) ORDER BY is_mpc DESC NULLS LAST, enriched_at DESC NULLS LAST, conv_id, campaign_name) = 1),
picked AS (SELECT lower(primary_contact_email) AS email, * EXCLUDE (primary_contact_email) FROM deal_dim WHERE primary_contact_email IS NOT NULL
    QUALIFY row_number() OVER (PARTITION BY lower(primary_contact_email) ORDER BY is_closed_won DESC NULLS FIRST, amount DESC NULLS LAST, deal_id) = 1)
"""

ATTRIBUTION = f"""{PIECES},
mailbox AS (SELECT s.* EXCLUDE (lead_email), lower(coalesce(CASE WHEN trim(s.lead_email) <> '' THEN trim(s.lead_email) END, k.known)) AS email
    FROM thread_snapshot s LEFT JOIN (SELECT conv_id, arg_max(lead_email, snapshot_date) AS known FROM thread_snapshot WHERE trim(lead_email) <> '' GROUP BY conv_id) k USING (conv_id) WHERE {NEWEST}),
cand_rep AS (SELECT lower(mpc_candidate) AS cand, min(assigned_rep) AS cand_rep FROM campaign_dim WHERE mpc_candidate IS NOT NULL AND assigned_rep IS NOT NULL GROUP BY 1),
attribution AS (
    SELECT m.snapshot_date, m.conv_id, m.last_activity, m.email AS lead_email, m.label_names, {POSITIVE} AS is_positive, {BOOKED} AS is_call_booked,
        coalesce(appt_rep, cand_rep, c.assigned_rep, signed_rep) AS rep_key, coalesce(e_mpc, b.is_mpc, c.is_mpc, false) AS campaign_is_mpc,
        coalesce(e_cand, b.candidate, c.mpc_candidate) AS mpc_candidate, coalesce(e_name, b.campaign, c.name) AS campaign_name,
        coalesce(first_seen_campaign, picked.attributed_campaign) AS campaign_id, c.archetype AS campaign_archetype
    FROM mailbox m LEFT JOIN contact_dim p ON p.email = m.email LEFT JOIN campaign_dim c ON c.campaign_id = p.first_seen_campaign
        LEFT JOIN (SELECT conv_id, min(signed_rep) AS signed_rep FROM signer GROUP BY 1) sg ON sg.conv_id = m.conv_id
        LEFT JOIN rich ON rich.email = m.email LEFT JOIN appt ON appt.email = m.email LEFT JOIN picked ON picked.email = m.email
        LEFT JOIN baseline_thread b ON lower(b.email) = m.email LEFT JOIN cand_rep ON cand = lower(coalesce(e_cand, b.candidate))
    UNION ALL BY NAME
    SELECT 'base-' || md5(lower(b.email)) AS conv_id, lower(b.email) AS lead_email, [b.label] AS label_names,
        b.label IN ('{V.INTERESTED}', '{V.BOOKED}') AS is_positive, b.label = '{V.BOOKED}' AS is_call_booked, coalesce(appt_rep, cand_rep) AS rep_key,
        coalesce(e_mpc, b.is_mpc, false) AS campaign_is_mpc, coalesce(e_cand, b.candidate) AS mpc_candidate, coalesce(e_name, b.campaign) AS campaign_name
    FROM baseline_thread b LEFT JOIN rich ON rich.email = lower(b.email) LEFT JOIN appt ON appt.email = lower(b.email) LEFT JOIN cand_rep ON cand = lower(coalesce(e_cand, b.candidate))
    WHERE lower(b.email) NOT IN (SELECT lower(lead_email) FROM thread_snapshot WHERE {NEWEST} AND lead_email IS NOT NULL))
"""

BY_CAMPAIGN = f"""{ATTRIBUTION},
ct AS (SELECT coalesce(campaign_name, '{V.NO_CAMPAIGN}') AS campaign_name, bool_or(campaign_is_mpc) AS flagged, count(DISTINCT conv_id) AS threads,
    count(DISTINCT lead_email) FILTER (is_positive) AS positives, count(DISTINCT lead_email) FILTER (is_call_booked) AS calls_booked FROM attribution GROUP BY 1),
cd AS (SELECT coalesce(attributed_campaign, '{V.NO_CAMPAIGN}') AS campaign_name, bool_or(coalesce(campaign_is_mpc, false)) AS flagged, count(*) AS deals, sum(amount) AS won_amount
    FROM deal_dim WHERE {WON} GROUP BY 1),
camp AS (SELECT campaign_name, coalesce(ct.flagged, false) OR coalesce(cd.flagged, false) AS is_mpc, coalesce(threads, 0) AS threads, coalesce(positives, 0) AS positives,
    coalesce(calls_booked, 0) AS calls_booked, coalesce(deals, 0) AS deals, coalesce(won_amount, 0) AS won_amount FROM ct FULL JOIN cd USING (campaign_name))
"""


@query("v01_thread_rep_attribution", "SELECT * REPLACE (array_to_string(label_names, ',') AS label_names) FROM attribution", ALL, ATTRIBUTION)
def v01(t):
    return V.thread_rep_attribution(t).withColumn("label_names", F.array_join("label_names", ","))


query(
    "v02_meetings_by_rep",
    "SELECT rep_key AS rep, count(DISTINCT conv_id) AS meetings, count(DISTINCT lead_email) AS unique_contacts, min(last_activity) AS first_meeting, max(last_activity) AS last_meeting "
    "FROM attribution WHERE is_call_booked AND rep_key IS NOT NULL GROUP BY 1",
    ALL,
    ATTRIBUTION,
)(V.meetings_by_rep)

HEADLINE = f"""SELECT 1 AS id, * FROM (SELECT cast(coalesce(sum(sent_count), 0) AS bigint) AS total_sent, cast(coalesce(sum(replied_count), 0) AS bigint) AS total_replied FROM campaign_snapshot WHERE {SENT_NOW}),
    (SELECT count(DISTINCT CASE WHEN is_positive THEN lead_email END) AS total_positives, count(DISTINCT CASE WHEN is_call_booked THEN lead_email END) AS total_calls_booked FROM attribution),
    (SELECT count(*) AS closed_won_count, round(coalesce(sum(amount), 0), 2) AS closed_won_revenue FROM deal_dim WHERE {WON})"""
query("v03_headline", HEADLINE, (*ALL, *SENT), ATTRIBUTION)(V.headline)

query(
    "v04_per_rep_mpc",
    f"""SELECT coalesce(rep, '{V.NO_REP}') AS rep, cast(sum(sent) AS bigint) AS sent, cast(sum(replied) AS bigint) AS replied, cast(sum(interested) AS bigint) AS interested, cast(sum(calls) AS bigint) AS calls,
        cast(sum(mpc_meetings) AS bigint) AS mpc_meetings, cast(sum(total_meetings) AS bigint) AS total_meetings, cast(sum(deals) AS bigint) AS deals, round(sum(revenue), 2) AS revenue
    FROM (SELECT assigned_rep AS rep, sent_count AS sent, replied_count AS replied, 0 AS interested, 0 AS calls, 0 AS mpc_meetings, 0 AS total_meetings, 0 AS deals, 0.0 AS revenue
            FROM campaign_snapshot JOIN campaign_dim USING (campaign_id) WHERE {SENT_NOW} AND is_mpc
        UNION ALL SELECT rep_key, 0, 0, (campaign_is_mpc AND is_positive)::int, (campaign_is_mpc AND is_call_booked)::int, (campaign_is_mpc AND is_call_booked)::int, is_call_booked::int, 0, 0
            FROM attribution WHERE rep_key IS NOT NULL AND (campaign_is_mpc OR is_call_booked)
        UNION ALL SELECT attributed_rep, 0, 0, 0, 0, 0, 0, coalesce({WON} AND campaign_is_mpc, false)::int, CASE WHEN {WON} AND campaign_is_mpc THEN amount ELSE 0 END FROM deal_dim)
    GROUP BY ALL""",
    (*ALL, *SENT),
    ATTRIBUTION,
)(V.per_rep_mpc)

query(
    "v05_per_rep_nonmpc",
    f"""SELECT rep, coalesce(threads, 0) AS threads, coalesce(positives, 0) AS positives, coalesce(calls, 0) AS calls, coalesce(closed_won, 0) AS closed_won, coalesce(won_amount, 0) AS won_amount,
        coalesce(active_pipeline, 0) AS active_pipeline, coalesce(lost, 0) AS lost, coalesce(total, 0) AS total, round(CASE WHEN total > 0 THEN closed_won / total ELSE 0 END, 6) AS close_rate
    FROM (SELECT coalesce(appt_rep, signed_rep) AS rep, count(*) AS threads, count(*) FILTER ({POSITIVE}) AS positives, count(*) FILTER ({BOOKED}) AS calls
        FROM thread_snapshot m LEFT JOIN contact_dim p ON p.email = lower(m.lead_email) LEFT JOIN campaign_dim c ON c.campaign_id = p.first_seen_campaign
            LEFT JOIN rich ON rich.email = lower(m.lead_email) LEFT JOIN appt ON appt.email = lower(m.lead_email) LEFT JOIN signer ON signer.conv_id = m.conv_id AND signer.addressed
        WHERE {NEWEST} AND NOT coalesce(e_mpc, c.is_mpc, false) AND coalesce(appt_rep, signed_rep) IS NOT NULL GROUP BY 1) th
    FULL JOIN (SELECT coalesce(attributed_rep, '{V.NO_REP}') AS rep, count(*) FILTER (is_closed_won) AS closed_won, round(coalesce(sum(amount) FILTER (is_closed_won), 0), 2) AS won_amount,
            count(*) FILTER (NOT is_closed_won AND NOT contains(lower(coalesce(stage_label, '')), 'lost')) AS active_pipeline,
            count(*) FILTER (NOT is_closed_won AND contains(lower(coalesce(stage_label, '')), 'lost')) AS lost, count(*) AS total
        FROM deal_dim WHERE is_outbound_attributed AND campaign_is_mpc IS NOT true GROUP BY 1) dl USING (rep)""",
    THREADS,
    PIECES,
)(V.per_rep_nonmpc)


def _breakdown(by: str, fallback: str) -> str:
    return f"""SELECT coalesce(p.{by}, '{fallback}') AS {by}, count(*) AS threads, count(*) FILTER ({POSITIVE}) AS positives, count(*) FILTER ({BOOKED}) AS calls
        FROM thread_snapshot m LEFT JOIN contact_dim p ON p.email = lower(m.lead_email) WHERE {NEWEST} GROUP BY 1"""


query("v06_industry_breakdown", _breakdown("industry", V.NO_INDUSTRY), ("thread_snapshot", "contact_dim"))(V.industry_breakdown)
query("v07_job_function_breakdown", _breakdown("job_function", V.NO_FUNCTION), ("thread_snapshot", "contact_dim"))(V.job_function_breakdown)

REPLIES = f"""{PIECES},
replies AS (SELECT m.conv_id, m.subject, m.last_activity, lower(m.lead_email) AS lead_email, array_to_string(m.label_names, ',') AS label_names, p.company, p.job_title, p.industry, p.job_function,
    {BOOKED} AS is_call_booked, list_contains(m.label_names, '{V.INTERESTED}') AS is_interested, coalesce(appt_rep, a.assigned_rep, signed_rep) AS rep_key,
    coalesce(r1.display_name, r2.display_name, r3.display_name) AS rep, coalesce(p.first_seen_campaign, d.attributed_campaign) AS campaign_id, coalesce(e_name, a.name, b.name) AS campaign_name,
    coalesce(e_cand, a.mpc_candidate, b.mpc_candidate) AS mpc_candidate, coalesce(e_mpc, a.is_mpc, b.is_mpc, false) AS campaign_is_mpc, d.deal_id, d.is_closed_won AS deal_is_closed_won,
    d.is_outbound_attributed AS deal_is_outbound_attributed, d.stage_label AS deal_stage, d.amount AS deal_amount
    FROM thread_snapshot m LEFT JOIN contact_dim p ON p.email = lower(m.lead_email) LEFT JOIN rich ON rich.email = lower(m.lead_email) LEFT JOIN picked d ON d.email = lower(m.lead_email)
        LEFT JOIN signer ON signer.conv_id = m.conv_id LEFT JOIN appt ON appt.email = lower(m.lead_email) LEFT JOIN campaign_dim a ON a.campaign_id = p.first_seen_campaign
        LEFT JOIN campaign_dim b ON b.campaign_id = d.attributed_campaign LEFT JOIN rep_dim r1 ON r1.rep_key = appt_rep LEFT JOIN rep_dim r2 ON r2.rep_key = a.assigned_rep LEFT JOIN rep_dim r3 ON r3.rep_key = signed_rep
    WHERE {NEWEST} AND {POSITIVE})"""


@query("v08_positive_replies", "SELECT * FROM replies", THREADS, REPLIES)
def v08(t):
    return V.positive_replies(t).withColumn("label_names", F.array_join("label_names", ","))


query(
    "v09_reconciliation",
    f"""SELECT 1 AS id, *, sent - replied AS drop_sent_to_replied, replied - positives AS drop_replied_to_positive, positives - calls AS drop_positive_to_call, calls - deals AS drop_call_to_deal
    FROM (SELECT cast(coalesce(sum(sent_count), 0) AS bigint) AS sent, cast(coalesce(sum(replied_count), 0) AS bigint) AS replied FROM campaign_snapshot WHERE {SENT_NOW}),
        (SELECT count(*) FILTER ({POSITIVE}) AS positives, count(*) FILTER ({BOOKED}) AS calls FROM thread_snapshot WHERE {NEWEST}),
        (SELECT count(*) AS deals, round(coalesce(sum(amount), 0), 2) AS revenue FROM deal_dim WHERE {WON})""",
    ("thread_snapshot", "campaign_snapshot", "deal_dim"),
)(V.reconciliation)

query(
    "v10_campaign_rankings",
    "SELECT * REPLACE (round(won_amount, 2) AS won_amount), rank() OVER (PARTITION BY is_mpc ORDER BY calls_booked DESC) AS rank_calls_desc, rank() OVER (PARTITION BY is_mpc ORDER BY calls_booked) AS rank_calls_asc FROM camp",
    ALL,
    BY_CAMPAIGN,
)(lambda t: V.campaign_rankings(t).withColumns({c: F.col(c).cast("long") for c in ("rank_calls_desc", "rank_calls_asc")}))

query(
    "v11_campaign_duds",
    f"SELECT campaign_name, flagged AS is_mpc, threads, positives, calls_booked FROM ct WHERE positives + calls_booked = 0 AND threads > 0 AND campaign_name <> '{V.NO_CAMPAIGN}'",
    ALL,
    BY_CAMPAIGN,
)(V.campaign_duds)

query(
    "v12_meeting_deal_ratio",
    """SELECT campaign_name, is_mpc, calls_booked, deals AS deals_won, round(r, 6) AS ratio, coalesce(r > 0 AND r >= hi, false) AS is_top_decile, coalesce(r <= lo, false) AS is_bottom_decile
    FROM (SELECT *, CASE WHEN calls_booked > 0 THEN deals / calls_booked END AS r FROM camp),
        (SELECT quantile_cont(deals / calls_booked, 0.9) AS hi, quantile_cont(deals / calls_booked, 0.1) AS lo FROM camp WHERE calls_booked > 0)""",
    ALL,
    BY_CAMPAIGN,
)(V.meeting_deal_ratio)

query(
    "v13_per_candidate",
    f"""SELECT candidate, partner_rep, coalesce(campaigns, 0) AS campaigns, coalesce(sent, 0) AS sent, coalesce(replied, 0) AS replied, coalesce(positives, 0) AS positives, coalesce(calls, 0) AS calls,
        round(CASE WHEN sent > 0 THEN coalesce(positives, 0) / sent ELSE 0 END, 6) AS pos_rate, industry
    FROM (SELECT mpc_candidate AS candidate, max(assigned_rep) AS partner_rep, count(DISTINCT campaign_id) AS campaigns, cast(coalesce(sum(sent_count), 0) AS bigint) AS sent, cast(coalesce(sum(replied_count), 0) AS bigint) AS replied
        FROM campaign_dim LEFT JOIN (SELECT campaign_id, sent_count, replied_count FROM campaign_snapshot WHERE {SENT_NOW}) USING (campaign_id) WHERE is_mpc AND mpc_candidate IS NOT NULL GROUP BY 1)
    FULL JOIN (SELECT mpc_candidate AS candidate, count(DISTINCT lead_email) FILTER (is_positive) AS positives, count(DISTINCT conv_id) FILTER (is_call_booked) AS calls FROM attribution WHERE campaign_is_mpc AND mpc_candidate IS NOT NULL GROUP BY 1) USING (candidate)
    LEFT JOIN (SELECT mpc_candidate AS candidate, industry FROM attribution JOIN contact_dim ON contact_dim.email = lead_email WHERE campaign_is_mpc AND mpc_candidate IS NOT NULL AND industry <> '{V.NO_INDUSTRY}'
        GROUP BY mpc_candidate, industry QUALIFY row_number() OVER (PARTITION BY mpc_candidate ORDER BY count(*) DESC, industry) = 1) USING (candidate)""",
    (*ALL, *SENT),
    ATTRIBUTION,
)(V.per_candidate)

query(
    "v14_cohort_summary",
    f"""SELECT cohort, coalesce(campaigns, 0) AS campaigns, coalesce(sent, 0) AS sent, coalesce(replied, 0) AS replied, coalesce(positives, 0) AS positives, coalesce(calls, 0) AS calls, coalesce(closed_won, 0) AS closed_won,
        coalesce(revenue, 0) AS revenue, round(CASE WHEN sent > 0 THEN replied / sent ELSE 0 END, 6) AS reply_rate, round(CASE WHEN positives > 0 THEN calls / positives ELSE 0 END, 6) AS meeting_to_positive
    FROM (VALUES ('MPC', true), ('Non-MPC', false)) g(cohort, flagged)
    LEFT JOIN (SELECT is_mpc AS flagged, count(DISTINCT campaign_id) AS campaigns, cast(coalesce(sum(sent_count), 0) AS bigint) AS sent, cast(coalesce(sum(replied_count), 0) AS bigint) AS replied
        FROM campaign_dim LEFT JOIN (SELECT campaign_id, sent_count, replied_count FROM campaign_snapshot WHERE {SENT_NOW}) USING (campaign_id) WHERE is_mpc IS NOT NULL GROUP BY 1) USING (flagged)
    LEFT JOIN (SELECT campaign_is_mpc AS flagged, count(DISTINCT lead_email) FILTER (is_positive) AS positives, count(DISTINCT conv_id) FILTER (is_call_booked) AS calls FROM attribution GROUP BY 1) USING (flagged)
    LEFT JOIN (SELECT campaign_is_mpc IS true AS flagged, count(*) FILTER ({WON}) AS closed_won, round(coalesce(sum(amount) FILTER ({WON}), 0), 2) AS revenue FROM deal_dim GROUP BY 1) USING (flagged)""",
    (*ALL, *SENT),
    ATTRIBUTION,
)(V.cohort_summary)
