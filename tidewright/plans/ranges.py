"""The funnel's figures over any closed window of days.

They are close to the views but not the same: each function follows the rules
of its windowed report (which keys are dropped, which deals touch a window).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewright.operators import aggs as A
from tidewright.operators import joins, snapshots
from tidewright.operators.snapshots import within
from tidewright.sources.funnel import Funnel

from . import views as V


def _threads(t: Funnel, start: str, end: str) -> DataFrame:
    return V.thread_rep_attribution(t).filter(within("last_activity", start, end))


def _campaigns(t: Funnel, start: str, end: str) -> DataFrame:
    """The latest snapshot's campaigns that were created in the window."""
    return snapshots.latest(t["campaign_snapshot"]).filter(within("created_at", start, end)).select("campaign_id", "sent_count", "replied_count")


def _won(t: Funnel, start: str, end: str) -> DataFrame:
    return t["deal_dim"].filter(F.col("is_closed_won") & F.col("is_outbound_attributed") & within("closedate", start, end))


def touching(deals: DataFrame, start: str, end: str) -> DataFrame:
    """Deals that were closed or created in the window."""
    return deals.filter(within("closedate", start, end) | within("createdate", start, end))


def headline(t: Funnel, start: str, end: str) -> DataFrame:
    sent = _campaigns(t, start, end).agg(A.total("sent_count").alias("sent"), A.total("replied_count").alias("replied"))
    threads = _threads(t, start, end).filter(A.known("lead_email"))
    leads = threads.agg(A.distinct_if("lead_email", F.col("is_positive")).alias("positives"), A.distinct_if("lead_email", F.col("is_call_booked")).alias("meetings"))
    won = _won(t, start, end).agg(F.count(F.lit(1)).alias("closed_won"), A.total("amount").alias("closed_won_amount"))
    return sent.crossJoin(leads).crossJoin(won).withColumns({"window_start": F.lit(start), "window_end": F.lit(end)})


def per_rep_mpc(t: Funnel, start: str, end: str) -> DataFrame:
    """Reps of flagged campaigns; rows without a rep are dropped throughout."""
    flagged = t["campaign_dim"].filter("is_mpc").select("campaign_id", F.when(A.known("assigned_rep"), F.col("assigned_rep")).alias("rep_key"))
    sent = _campaigns(t, start, end).join(flagged, "campaign_id").filter("rep_key IS NOT NULL").groupBy("rep_key").agg(A.total("sent_count").alias("sent"), A.total("replied_count").alias("replied"))
    mine = _threads(t, start, end).filter(A.known("rep_key") & A.known("conv_id"))
    threads = (
        mine.filter((F.col("is_positive") & F.col("campaign_is_mpc")) | F.col("is_call_booked"))
        .groupBy("rep_key")
        .agg(
            A.distinct_if("conv_id", F.col("is_positive") & F.col("campaign_is_mpc")).alias("positives"),
            A.distinct_if("conv_id", F.col("is_call_booked") & F.col("campaign_is_mpc")).alias("mpc_meetings"),
            A.distinct_if("conv_id", F.col("is_call_booked")).alias("total_meetings"),
        )
    )
    won = _won(t, start, end).filter(F.col("campaign_is_mpc") & A.known("attributed_rep"))
    deals = won.groupBy(F.col("attributed_rep").alias("rep_key")).agg(F.count(F.lit(1)).alias("closed_won"), A.total("amount").alias("won_amount"))
    counts = ["sent", "replied", "positives", "mpc_meetings", "total_meetings", "closed_won", "won_amount"]
    out = joins.spine([sent, threads, deals], "rep_key", counts)
    # A booked call of a flagged campaign is that rep's meeting.
    return out.withColumn("calls_booked", F.col("mpc_meetings")).orderBy(F.desc("positives"), "rep_key")


def per_rep_nonmpc(t: Funnel, start: str, end: str) -> DataFrame:
    mine = _threads(t, start, end).filter(~A.flag("campaign_is_mpc") & A.known("rep_key"))
    threads = mine.groupBy("rep_key").agg(F.count(F.lit(1)).alias("threads"), A.count_if(F.col("is_positive")).alias("positives"), A.count_if(F.col("is_call_booked")).alias("calls"))
    deals = touching(t["deal_dim"], start, end).filter(F.col("is_outbound_attributed") & ~A.flag("campaign_is_mpc") & A.known("attributed_rep"))
    won = A.flag("is_closed_won")
    lost = F.lower(F.coalesce("stage_label", F.lit(""))).contains("lost")
    deals = deals.groupBy(F.col("attributed_rep").alias("rep_key")).agg(
        A.count_if(won).alias("closed_won"), A.sum_if("amount", won).alias("won_amount"), A.count_if(~won & ~lost).alias("active_pipeline"), F.count(F.lit(1)).alias("total")
    )
    counts = ["threads", "positives", "calls", "closed_won", "won_amount", "active_pipeline", "total"]
    out = joins.spine([threads, deals], "rep_key", counts).withColumn("close_rate", A.ratio("closed_won", "total"))
    return out.drop("total").orderBy(F.desc("positives"), "rep_key")


def breakdown(t: Funnel, by: str, fallback: str, start: str, end: str) -> DataFrame:
    """Threads with an address by a contact field; blank fields count as missing."""
    threads = snapshots.latest(t["thread_snapshot"]).filter(within("last_activity", start, end)).withColumn("email", F.lower("lead_email")).filter(A.known("email"))
    contacts = t["contact_dim"].select("email", F.when(A.known(by), F.col(by)).alias("bucket"))
    rows = threads.join(contacts, "email", "left").groupBy(F.coalesce("bucket", F.lit(fallback)).alias("bucket"))
    return rows.agg(F.count(F.lit(1)).alias("threads"), A.count_if(V._positive()).alias("positives"), A.count_if(V._booked()).alias("calls")).orderBy(F.desc("threads"), "bucket")


REPLY_COLUMNS = (
    "conv_id subject last_activity lead_email label_names company job_title industry job_function is_call_booked is_interested rep_key rep campaign_id campaign_name mpc_candidate campaign_is_mpc"
).split()


def positive_replies(t: Funnel, start: str | None = None, end: str | None = None, industry: str | None = None) -> DataFrame:
    """Positive replies, newest first, optionally of a window or an industry."""
    rows = V.positive_replies(t).select(*REPLY_COLUMNS)
    if industry is not None:
        rows = rows.filter(F.col("industry") == industry)
    if start and end:
        rows = rows.filter(within("last_activity", start, end))
    return rows.orderBy(F.desc_nulls_first("last_activity"), "conv_id")


DEAL_COLUMNS = "deal_id dealname amount stage_label is_closed_won is_outbound_attributed deal_source primary_contact_email attributed_campaign attributed_rep closedate createdate".split()


def deals(t: Funnel, won: bool, start: str | None = None, end: str | None = None) -> DataFrame:
    """Attributed deals: won ones by closing day, or all that touch a window."""
    rows = t["deal_dim"].filter("is_outbound_attributed").select(*DEAL_COLUMNS)
    if won:
        rows = rows.filter("is_closed_won")
    if start and end:
        rows = rows.filter(within("closedate", start, end)) if won else touching(rows, start, end)
    return rows.orderBy(F.desc_nulls_first("closedate") if won else F.desc_nulls_last("closedate"), "deal_id")


def cohort_summary(t: Funnel, start: str, end: str) -> DataFrame:
    """Flagged and unflagged campaigns of the window; no flag counts as unflagged."""
    cohorts = t.spark.createDataFrame([("MPC", True), ("Non-MPC", False)], "cohort string, is_mpc boolean")
    flags = t["campaign_dim"].select("campaign_id", "is_mpc")
    campaigns = _campaigns(t, start, end).join(flags, "campaign_id", "left").groupBy(A.flag("is_mpc").alias("is_mpc"))
    campaigns = campaigns.agg(F.count(F.lit(1)).alias("campaigns"), A.total("sent_count").alias("sent"), A.total("replied_count").alias("replied"))
    threads = _threads(t, start, end).groupBy(A.flag("campaign_is_mpc").alias("is_mpc"))
    threads = threads.agg(A.distinct_if("lead_email", F.col("is_positive") & A.known("lead_email")).alias("positives"), A.distinct_if("conv_id", F.col("is_call_booked")).alias("calls"))
    won = _won(t, start, end).groupBy(A.flag("campaign_is_mpc").alias("is_mpc")).agg(F.count(F.lit(1)).alias("closed_won"), A.total("amount").alias("revenue"))
    counts = ["campaigns", "sent", "replied", "positives", "calls", "closed_won", "revenue"]
    out = cohorts.join(campaigns, "is_mpc", "left").join(threads, "is_mpc", "left").join(won, "is_mpc", "left").fillna(0, subset=counts)
    return out.select("cohort", *counts, A.ratio("replied", "sent").alias("reply_rate"), A.ratio("calls", "positives").alias("meeting_to_positive"))


def candidates(t: Funnel, start: str, end: str) -> DataFrame:
    """Candidates of the window; the partner is the greatest of the assigned reps."""
    dim = t["campaign_dim"].filter(F.col("is_mpc") & A.known("mpc_candidate")).withColumnRenamed("mpc_candidate", "candidate")
    partner = dim.filter(A.known("assigned_rep")).groupBy("candidate").agg(F.max("assigned_rep").alias("partner_rep"))
    campaigns = _campaigns(t, start, end).join(dim.select("campaign_id", "candidate"), "campaign_id").groupBy("candidate")
    campaigns = campaigns.agg(F.count(F.lit(1)).alias("campaigns"), A.total("sent_count").alias("sent"), A.total("replied_count").alias("replied"))
    mine = _threads(t, start, end).filter(F.col("campaign_is_mpc") & A.known("mpc_candidate")).withColumnRenamed("mpc_candidate", "candidate")
    positive = F.col("is_positive") & A.known("lead_email")
    funnel = mine.filter(positive | F.col("is_call_booked")).groupBy("candidate").agg(A.distinct_if("lead_email", positive).alias("positives"), A.distinct_if("conv_id", F.col("is_call_booked")).alias("calls"))
    industry = V.per_candidate(t).select("candidate", "industry")
    counts = ["campaigns", "sent", "replied", "positives", "calls"]
    out = joins.spine([campaigns, funnel], "candidate", counts).join(partner, "candidate", "left").join(industry, "candidate", "left")
    return out.withColumn("pos_rate", A.ratio("positives", "sent")).orderBy(F.desc("positives"), "candidate")


def snapshot_delta(t: Funnel, day: str) -> DataFrame:
    """A day's campaign totals beside those of the snapshot before it, and what is new."""
    all_, d = t["campaign_snapshot"], F.lit(day).cast("date")
    sums = [F.count(F.lit(1)).alias("campaigns"), A.total("sent_count").alias("sent"), A.total("replied_count").alias("replied"), A.total("positive_reply_count").alias("positives")]
    now = all_.filter(F.col("snapshot_date") == d).agg(*sums)
    before = snapshots.latest_before(all_, d).groupBy(F.col("snapshot_date").alias("prior_date")).agg(*(s.alias(f"prior_{n}") for s, n in zip(sums, ("campaigns", "sent", "replied", "positives"), strict=True)))
    new = snapshots.first_seen_on(all_, d, "campaign_id").agg(F.count(F.lit(1)).alias("new_campaigns"))
    out = now.crossJoin(new).join(before, F.lit(True), "left")
    return out.withColumns({f"{n}_delta": signed_delta(F.col(n), F.col(f"prior_{n}")) for n in ("sent", "replied", "positives")})


def signed_delta(now, before):
    """The change with its sign and thousands separators; empty without an earlier value."""
    change = now - before
    shown = F.concat(F.when(change > 0, F.lit("+")).otherwise(F.lit("")), F.format_number(change, 0))
    return F.when(before.isNull(), F.lit("")).when(change == 0, F.lit("±0")).otherwise(shown)
