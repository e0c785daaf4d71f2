"""The funnel's fourteen views.

Each is a function of a ``Funnel``; views that build on the attribution view
call it, and Spark plans the whole as one query. ``VIEWS`` names them with
what they depend on; ``materialise`` writes them in that order.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewright.operators import aggs as A
from tidewright.operators import dedupe, joins, snapshots
from tidewright.sources.funnel import Funnel

INTERESTED, BOOKED = "Interested", "Call Booked"
NO_CAMPAIGN, NO_REP = "(unattributed)", "(unassigned)"
NO_INDUSTRY, NO_FUNCTION = "Several industries", "Several functions"
#: Nicknames under which a rep may sign.
NICKNAMES = {"nat": "NATION_3"}


def _positive():
    return A.has_label("label_names", INTERESTED, BOOKED)


def _booked():
    return A.has_label("label_names", BOOKED)


def signed_reps(t: Funnel, threads: DataFrame) -> DataFrame:
    """(conv_id, signed_rep): the rep who signs a thread; of several the least key."""
    authors = joins.unnest_pairs(threads.select("conv_id", "authors", "author_names"), "authors", "author_names", ("email", "name"))
    aliases = joins.alias_table(t["rep_dim"], "rep_key", "rep_email", NICKNAMES)
    found = joins.match_alias(authors, "email", "name", aliases)
    return found.groupBy("conv_id").agg(F.min("rep_key").alias("signed_rep"))


def appointment_reps(t: Funnel) -> DataFrame:
    """(email, appt_rep): the rep of the latest appointment in either feed.

    The feeds are united before one is chosen, so an address in both stays one row.
    """
    old = t["appt_backfill"].filter(A.known("email") & F.col("rep_key").isNotNull())
    new = t["appt_event"].filter(A.known("lead_email") & F.col("rep_key").isNotNull())
    both = old.select(F.lower("email").alias("email"), "rep_key", F.col("meeting_date").cast("timestamp_ntz").alias("at")).unionByName(
        new.select(F.lower("lead_email").alias("email"), "rep_key", F.col("meeting_at").cast("timestamp_ntz").alias("at"))
    )
    return dedupe.keep_latest(both, ["email"], "at", "rep_key").select("email", F.col("rep_key").alias("appt_rep"))


def enrichment(t: Funnel) -> DataFrame:
    """The best enrichment of each lead: flagged ones first, then the newest."""
    rows = t["thread_campaign"].filter("lead_email IS NOT NULL").withColumn("email", F.lower("lead_email"))
    best = dedupe.keep_one(rows, ["email"], [F.desc_nulls_last("is_mpc"), F.desc_nulls_last("enriched_at"), F.asc("conv_id"), F.asc("campaign_name")])
    return best.select("email", F.col("is_mpc").alias("e_mpc"), F.col("mpc_candidate").alias("e_candidate"), F.col("campaign_name").alias("e_campaign"))


def picked_deals(t: Funnel) -> DataFrame:
    """One deal for each primary contact: unknown outcomes before won before lost, then by amount."""
    rows = t["deal_dim"].filter("primary_contact_email IS NOT NULL").withColumn("email", F.lower("primary_contact_email"))
    return dedupe.keep_one(rows, ["email"], [F.desc_nulls_first("is_closed_won"), F.desc_nulls_last("amount"), F.asc("deal_id")])


def candidate_reps(t: Funnel) -> DataFrame:
    rows = t["campaign_dim"].filter("mpc_candidate IS NOT NULL AND assigned_rep IS NOT NULL")
    return rows.groupBy(F.lower("mpc_candidate").alias("cand")).agg(F.min("assigned_rep").alias("cand_rep"))


def threads_today(t: Funnel) -> DataFrame:
    """The latest snapshot, blank lead addresses filled with the last one known."""
    all_ = t["thread_snapshot"]
    known = all_.filter(A.filled("lead_email").isNotNull())
    known = dedupe.keep_one(known, ["conv_id"], [F.desc("snapshot_date")]).select("conv_id", F.col("lead_email").alias("known_email"))
    today = snapshots.latest(all_).join(known, "conv_id", "left")
    return today.withColumn("lead_email", F.coalesce(A.filled("lead_email"), "known_email")).drop("known_email")


_ATTRIBUTION = ("snapshot_date", "conv_id", "last_activity", "lead_email", "label_names", "is_positive", "is_call_booked", "rep_key", "campaign_is_mpc", "mpc_candidate", "campaign_name", "campaign_id", "campaign_archetype")


def thread_rep_attribution(t: Funnel) -> DataFrame:
    """One row a thread with its rep, flag, candidate and campaign; baseline leads that the latest snapshot lacks come as rows of their own."""
    today = threads_today(t).withColumn("email", F.lower("lead_email"))
    contact = t["contact_dim"].select("email", "first_seen_campaign")
    campaign = t["campaign_dim"].select(F.col("campaign_id").alias("first_seen_campaign"), F.col("name").alias("c_name"), F.col("is_mpc").alias("c_mpc"), F.col("mpc_candidate").alias("c_candidate"), "assigned_rep", "archetype")
    base = t["baseline_thread"].withColumn("email", F.lower("email"))
    base = base.select("email", "label", F.col("is_mpc").alias("b_mpc"), F.col("candidate").alias("b_candidate"), F.col("campaign").alias("b_campaign"))
    rich, appt, reps = enrichment(t), appointment_reps(t), candidate_reps(t)
    deals = picked_deals(t).select("email", "attributed_campaign")
    live = (
        today.join(contact, "email", "left")
        .join(campaign, "first_seen_campaign", "left")
        .join(signed_reps(t, snapshots.latest(t["thread_snapshot"])), "conv_id", "left")
        .join(rich, "email", "left")
        .join(appt, "email", "left")
        .join(deals, "email", "left")
        .join(base, "email", "left")
        .withColumn("cand", F.lower(F.coalesce("e_candidate", "b_candidate", F.lit(""))))
        .join(reps, "cand", "left")
        .select(
            "snapshot_date",
            "conv_id",
            "last_activity",
            F.col("email").alias("lead_email"),
            "label_names",
            _positive().alias("is_positive"),
            _booked().alias("is_call_booked"),
            F.coalesce("appt_rep", "cand_rep", "assigned_rep", "signed_rep").alias("rep_key"),
            F.coalesce("e_mpc", "b_mpc", "c_mpc", F.lit(False)).alias("campaign_is_mpc"),
            F.coalesce("e_candidate", "b_candidate", "c_candidate").alias("mpc_candidate"),
            F.coalesce("e_campaign", "b_campaign", "c_name").alias("campaign_name"),
            F.coalesce("first_seen_campaign", "attributed_campaign").alias("campaign_id"),
            F.col("archetype").alias("campaign_archetype"),
        )
    )
    # Whether a lead is gone is asked of the snapshot's own addresses, not of the filled ones.
    there = snapshots.latest(t["thread_snapshot"]).select(F.lower("lead_email").alias("email"))
    gone = (
        base.join(there, "email", "left_anti")
        .join(rich, "email", "left")
        .join(appt, "email", "left")
        .withColumn("cand", F.lower(F.coalesce("e_candidate", "b_candidate", F.lit(""))))
        .join(reps, "cand", "left")
        .withColumn("label_names", F.array("label"))
        .select(
            F.lit(None).cast("date").alias("snapshot_date"),
            F.concat(F.lit("base-"), F.md5("email")).alias("conv_id"),
            F.lit(None).cast("timestamp_ntz").alias("last_activity"),
            F.col("email").alias("lead_email"),
            "label_names",
            _positive().alias("is_positive"),
            _booked().alias("is_call_booked"),
            F.coalesce("appt_rep", "cand_rep").alias("rep_key"),
            F.coalesce("e_mpc", "b_mpc", F.lit(False)).alias("campaign_is_mpc"),
            F.coalesce("e_candidate", "b_candidate").alias("mpc_candidate"),
            F.coalesce("e_campaign", "b_campaign").alias("campaign_name"),
            F.lit(None).cast("string").alias("campaign_id"),
            F.lit(None).cast("string").alias("campaign_archetype"),
        )
    )
    return live.unionByName(gone)


def meetings_by_rep(t: Funnel) -> DataFrame:
    booked = thread_rep_attribution(t).filter("is_call_booked AND rep_key IS NOT NULL")
    return booked.groupBy(F.col("rep_key").alias("rep")).agg(
        F.count_distinct("conv_id").alias("meetings"),
        F.count_distinct("lead_email").alias("unique_contacts"),
        F.min("last_activity").alias("first_meeting"),
        F.max("last_activity").alias("last_meeting"),
    )


def _volume(t: Funnel, sent: str, replied: str) -> DataFrame:
    return snapshots.latest(t["campaign_snapshot"]).agg(A.total("sent_count").alias(sent), A.total("replied_count").alias(replied))


def _won():
    return F.col("is_closed_won") & F.col("is_outbound_attributed")


def headline(t: Funnel) -> DataFrame:
    """One row: messages of the latest snapshot, distinct leads, won deals."""
    leads = thread_rep_attribution(t).agg(
        A.distinct_if("lead_email", F.col("is_positive")).alias("total_positives"),
        A.distinct_if("lead_email", F.col("is_call_booked")).alias("total_calls_booked"),
    )
    won = t["deal_dim"].agg(A.count_if(_won()).alias("closed_won_count"), A.sum_if("amount", _won()).alias("closed_won_revenue"))
    return _volume(t, "total_sent", "total_replied").crossJoin(leads).crossJoin(won).select(F.lit(1).alias("id"), "*")


def per_rep_mpc(t: Funnel) -> DataFrame:
    """Flagged campaigns by rep; the null rep is a rep of its own."""
    campaign = t["campaign_dim"].filter("is_mpc").select("campaign_id", F.col("assigned_rep").alias("rep"))
    sent = snapshots.latest(t["campaign_snapshot"]).join(campaign, "campaign_id").groupBy("rep").agg(A.total("sent_count").alias("sent"), A.total("replied_count").alias("replied"))
    mine = thread_rep_attribution(t).filter("rep_key IS NOT NULL").withColumnRenamed("rep_key", "rep")
    flagged = mine.filter("campaign_is_mpc").groupBy("rep").agg(
        A.distinct_if("conv_id", F.col("is_positive")).alias("interested"),
        A.distinct_if("conv_id", F.col("is_call_booked")).alias("calls"),
    )
    meetings = mine.filter("is_call_booked").groupBy("rep").agg(
        A.distinct_if("conv_id", F.col("campaign_is_mpc")).alias("mpc_meetings"),
        F.count_distinct("conv_id").alias("total_meetings"),
    )
    won = _won() & A.flag("campaign_is_mpc")
    deals = t["deal_dim"].groupBy(F.col("attributed_rep").alias("rep")).agg(A.count_if(won).alias("deals"), A.sum_if("amount", won).alias("revenue"))
    counts = ["sent", "replied", "interested", "calls", "mpc_meetings", "total_meetings", "deals", "revenue"]
    out = joins.spine([sent, flagged, deals, meetings], "rep", counts)
    return out.select(F.coalesce("rep", F.lit(NO_REP)).alias("rep"), *counts)


def per_rep_nonmpc(t: Funnel) -> DataFrame:
    """Unflagged threads by rep, from the snapshot's own addresses and two kinds of rep only."""
    today = snapshots.latest(t["thread_snapshot"]).withColumn("email", F.lower("lead_email"))
    signed = signed_reps(t, today.filter("lead_email IS NOT NULL"))
    campaign = t["campaign_dim"].select(F.col("campaign_id").alias("first_seen_campaign"), F.col("is_mpc").alias("c_mpc"))
    threads = (
        today.join(t["contact_dim"].select("email", "first_seen_campaign"), "email", "left")
        .join(campaign, "first_seen_campaign", "left")
        .join(enrichment(t).select("email", "e_mpc"), "email", "left")
        .join(signed, "conv_id", "left")
        .join(appointment_reps(t), "email", "left")
        .withColumn("rep", F.coalesce("appt_rep", "signed_rep"))
        .filter(~F.coalesce("e_mpc", "c_mpc", F.lit(False)) & F.col("rep").isNotNull())
        .groupBy("rep")
        .agg(F.count(F.lit(1)).alias("threads"), A.count_if(_positive()).alias("positives"), A.count_if(_booked()).alias("calls"))
    )
    lost = F.lower(F.coalesce("stage_label", F.lit(""))).contains("lost")
    won, other = F.col("is_closed_won"), ~F.col("is_closed_won")
    deals = (
        t["deal_dim"]
        .filter(F.col("is_outbound_attributed") & ~A.flag("campaign_is_mpc"))
        .groupBy(F.coalesce("attributed_rep", F.lit(NO_REP)).alias("rep"))
        .agg(
            A.count_if(won).alias("closed_won"),
            A.sum_if("amount", won).alias("won_amount"),
            A.count_if(other & ~lost).alias("active_pipeline"),
            A.count_if(other & lost).alias("lost"),
            F.count(F.lit(1)).alias("total"),
        )
    )
    counts = ["threads", "positives", "calls", "closed_won", "won_amount", "active_pipeline", "lost", "total"]
    return joins.spine([threads, deals], "rep", counts).select("rep", *counts, A.ratio("closed_won", "total").alias("close_rate"))


def _breakdown(t: Funnel, by: str, fallback: str) -> DataFrame:
    threads = snapshots.latest(t["thread_snapshot"]).withColumn("email", F.lower("lead_email"))
    joined = threads.join(t["contact_dim"].select("email", by), "email", "left")
    return joined.groupBy(F.coalesce(by, F.lit(fallback)).alias(by)).agg(F.count(F.lit(1)).alias("threads"), A.count_if(_positive()).alias("positives"), A.count_if(_booked()).alias("calls"))


def industry_breakdown(t: Funnel) -> DataFrame:
    return _breakdown(t, "industry", NO_INDUSTRY)


def job_function_breakdown(t: Funnel) -> DataFrame:
    return _breakdown(t, "job_function", NO_FUNCTION)


def positive_replies(t: Funnel) -> DataFrame:
    """One wide row for each positive thread of the latest snapshot, with its own addresses."""
    today = snapshots.latest(t["thread_snapshot"])
    signed = signed_reps(t, today)
    campaign = lambda p, on: t["campaign_dim"].select(F.col("campaign_id").alias(on), F.col("name").alias(f"{p}_name"), F.col("mpc_candidate").alias(f"{p}_candidate"), F.col("is_mpc").alias(f"{p}_mpc"), F.col("assigned_rep").alias(f"{p}_rep"))
    shown = lambda on, name: t["rep_dim"].select(F.col("rep_key").alias(on), F.col("display_name").alias(name))
    deal = picked_deals(t).select(
        "email", "deal_id", "attributed_campaign", F.col("is_closed_won").alias("deal_is_closed_won"), F.col("is_outbound_attributed").alias("deal_is_outbound_attributed"), F.col("stage_label").alias("deal_stage"), F.col("amount").alias("deal_amount")
    )
    return (
        today.filter(_positive())
        .withColumn("email", F.lower("lead_email"))
        .join(t["contact_dim"], "email", "left")
        .join(enrichment(t), "email", "left")
        .join(deal, "email", "left")
        .join(signed, "conv_id", "left")
        .join(appointment_reps(t), "email", "left")
        .join(campaign("a", "first_seen_campaign"), "first_seen_campaign", "left")
        .join(campaign("d", "attributed_campaign"), "attributed_campaign", "left")
        .join(shown("appt_rep", "shown_1"), "appt_rep", "left")
        .join(shown("a_rep", "shown_2"), "a_rep", "left")
        .join(shown("signed_rep", "shown_3"), "signed_rep", "left")
        .select(
            "conv_id",
            "subject",
            "last_activity",
            F.col("email").alias("lead_email"),
            "label_names",
            "company",
            "job_title",
            "industry",
            "job_function",
            _booked().alias("is_call_booked"),
            A.has_label("label_names", INTERESTED).alias("is_interested"),
            F.coalesce("appt_rep", "a_rep", "signed_rep").alias("rep_key"),
            F.coalesce("shown_1", "shown_2", "shown_3").alias("rep"),
            F.coalesce("first_seen_campaign", "attributed_campaign").alias("campaign_id"),
            F.coalesce("e_campaign", "a_name", "d_name").alias("campaign_name"),
            F.coalesce("e_candidate", "a_candidate", "d_candidate").alias("mpc_candidate"),
            F.coalesce("e_mpc", "a_mpc", "d_mpc", F.lit(False)).alias("campaign_is_mpc"),
            "deal_id",
            "deal_is_closed_won",
            "deal_is_outbound_attributed",
            "deal_stage",
            "deal_amount",
        )
    )


def reconciliation(t: Funnel) -> DataFrame:
    """Funnel totals counted by thread, and what is lost from step to step."""
    threads = snapshots.latest(t["thread_snapshot"]).agg(A.count_if(_positive()).alias("positives"), A.count_if(_booked()).alias("calls"))
    won = t["deal_dim"].agg(A.count_if(_won()).alias("deals"), A.sum_if("amount", _won()).alias("revenue"))
    return (
        _volume(t, "sent", "replied")
        .crossJoin(threads)
        .crossJoin(won)
        .select(
            F.lit(1).alias("id"),
            "*",
            (F.col("sent") - F.col("replied")).alias("drop_sent_to_replied"),
            (F.col("replied") - F.col("positives")).alias("drop_replied_to_positive"),
            (F.col("positives") - F.col("calls")).alias("drop_positive_to_call"),
            (F.col("calls") - F.col("deals")).alias("drop_call_to_deal"),
        )
    )


def _campaign_threads(t: Funnel) -> DataFrame:
    named = thread_rep_attribution(t).withColumn("campaign_name", F.coalesce("campaign_name", F.lit(NO_CAMPAIGN)))
    return named.groupBy("campaign_name").agg(
        F.bool_or("campaign_is_mpc").alias("thread_is_mpc"),
        F.count_distinct("conv_id").alias("threads"),
        A.distinct_if("lead_email", F.col("is_positive")).alias("positives"),
        A.distinct_if("lead_email", F.col("is_call_booked")).alias("calls_booked"),
    )


def _campaign_deals(t: Funnel) -> DataFrame:
    won = t["deal_dim"].filter(_won()).withColumn("campaign_name", F.coalesce("attributed_campaign", F.lit(NO_CAMPAIGN)))
    return won.groupBy("campaign_name").agg(F.bool_or(A.flag("campaign_is_mpc")).alias("deal_is_mpc"), F.count(F.lit(1)).alias("deals"), A.total("amount").alias("won_amount"))


def _campaigns(t: Funnel) -> DataFrame:
    both = joins.spine([_campaign_threads(t), _campaign_deals(t)], "campaign_name", ["threads", "positives", "calls_booked", "deals", "won_amount"])
    return both.withColumn("is_mpc", A.flag("thread_is_mpc") | A.flag("deal_is_mpc"))


def campaign_rankings(t: Funnel) -> DataFrame:
    """Campaigns by booked calls, from both ends, within flagged and unflagged ones."""
    from pyspark.sql import Window

    within = Window.partitionBy("is_mpc")
    return _campaigns(t).select(
        "campaign_name",
        "is_mpc",
        "threads",
        "positives",
        "calls_booked",
        "deals",
        "won_amount",
        F.rank().over(within.orderBy(F.desc("calls_booked"))).alias("rank_calls_desc"),
        F.rank().over(within.orderBy(F.asc("calls_booked"))).alias("rank_calls_asc"),
    )


def campaign_duds(t: Funnel) -> DataFrame:
    dud = (F.col("threads") > 0) & (F.col("positives") == 0) & (F.col("calls_booked") == 0) & (F.col("campaign_name") != NO_CAMPAIGN)
    return _campaign_threads(t).filter(dud).withColumnRenamed("thread_is_mpc", "is_mpc")


def meeting_deal_ratio(t: Funnel) -> DataFrame:
    """Won deals a booked call, with flags for the outer tenths."""
    rated = _campaigns(t).select("campaign_name", "is_mpc", "calls_booked", F.col("deals").alias("deals_won"), A.ratio("deals", "calls_booked", None).alias("ratio"))
    cuts = rated.filter("calls_booked > 0").agg(F.percentile("ratio", 0.9).alias("top"), F.percentile("ratio", 0.1).alias("bottom"))
    called = F.col("calls_booked") > 0
    return rated.crossJoin(F.broadcast(cuts)).select(
        "campaign_name",
        "is_mpc",
        "calls_booked",
        "deals_won",
        "ratio",
        A.flag(called & (F.col("ratio") > 0) & (F.col("ratio") >= F.col("top"))).alias("is_top_decile"),
        A.flag(called & (F.col("ratio") <= F.col("bottom"))).alias("is_bottom_decile"),
    )


def per_candidate(t: Funnel) -> DataFrame:
    """Campaign figures and funnel figures of each candidate, whichever side knows them."""
    today = snapshots.latest(t["campaign_snapshot"]).select("campaign_id", "sent_count", "replied_count")
    campaigns = (
        t["campaign_dim"]
        .filter("is_mpc AND mpc_candidate IS NOT NULL")
        .join(today, "campaign_id", "left")
        .groupBy(F.col("mpc_candidate").alias("candidate"))
        .agg(F.max("assigned_rep").alias("partner_rep"), F.count_distinct("campaign_id").alias("campaigns"), A.total("sent_count").alias("sent"), A.total("replied_count").alias("replied"))
    )
    mine = thread_rep_attribution(t).filter("campaign_is_mpc AND mpc_candidate IS NOT NULL").withColumnRenamed("mpc_candidate", "candidate")
    funnel = mine.groupBy("candidate").agg(A.distinct_if("lead_email", F.col("is_positive")).alias("positives"), A.distinct_if("conv_id", F.col("is_call_booked")).alias("calls"))
    where = t["contact_dim"].filter(F.col("industry").isNotNull() & (F.col("industry") != NO_INDUSTRY)).select(F.col("email").alias("lead_email"), "industry")
    industry = mine.join(where, "lead_email").groupBy("candidate").agg(F.mode("industry", True).alias("industry"))
    counts = ["campaigns", "sent", "replied", "positives", "calls"]
    both = campaigns.join(funnel, "candidate", "full_outer").fillna(0, subset=counts).join(industry, "candidate", "left")
    return both.select("candidate", "partner_rep", *counts, A.ratio("positives", "sent").alias("pos_rate"), "industry")


def cohort_summary(t: Funnel) -> DataFrame:
    """Two rows, flagged and unflagged; campaigns without a flag are in neither."""
    cohorts = t.spark.createDataFrame([("MPC", True), ("Non-MPC", False)], "cohort string, is_mpc boolean")
    today = snapshots.latest(t["campaign_snapshot"]).select("campaign_id", "sent_count", "replied_count")
    campaigns = t["campaign_dim"].join(today, "campaign_id", "left").groupBy("is_mpc").agg(F.count_distinct("campaign_id").alias("campaigns"), A.total("sent_count").alias("sent"), A.total("replied_count").alias("replied"))
    funnel = thread_rep_attribution(t).groupBy(A.flag("campaign_is_mpc").alias("is_mpc")).agg(A.distinct_if("lead_email", F.col("is_positive")).alias("positives"), A.distinct_if("conv_id", F.col("is_call_booked")).alias("calls"))
    deals = t["deal_dim"].groupBy(A.flag("campaign_is_mpc").alias("is_mpc")).agg(A.count_if(_won()).alias("closed_won"), A.sum_if("amount", _won()).alias("revenue"))
    counts = ["campaigns", "sent", "replied", "positives", "calls", "closed_won", "revenue"]
    out = cohorts.join(campaigns, "is_mpc", "left").join(funnel, "is_mpc", "left").join(deals, "is_mpc", "left").fillna(0, subset=counts)
    return out.select("cohort", *counts, A.ratio("replied", "sent").alias("reply_rate"), A.ratio("calls", "positives").alias("meeting_to_positive"))


#: name: (view, its key, the views it builds on).
VIEWS: dict[str, tuple[Callable[[Funnel], DataFrame], str, tuple[str, ...]]] = {
    "thread_rep_attribution": (thread_rep_attribution, "conv_id", ()),
    "meetings_by_rep": (meetings_by_rep, "rep", ("thread_rep_attribution",)),
    "headline": (headline, "id", ("thread_rep_attribution",)),
    "per_rep_mpc": (per_rep_mpc, "rep", ("thread_rep_attribution",)),
    "per_rep_nonmpc": (per_rep_nonmpc, "rep", ()),
    "industry_breakdown": (industry_breakdown, "industry", ()),
    "job_function_breakdown": (job_function_breakdown, "job_function", ()),
    "positive_replies": (positive_replies, "conv_id", ()),
    "reconciliation": (reconciliation, "id", ()),
    "campaign_rankings": (campaign_rankings, "campaign_name", ("thread_rep_attribution",)),
    "campaign_duds": (campaign_duds, "campaign_name", ("thread_rep_attribution",)),
    "meeting_deal_ratio": (meeting_deal_ratio, "campaign_name", ("thread_rep_attribution",)),
    "per_candidate": (per_candidate, "candidate", ("thread_rep_attribution",)),
    "cohort_summary": (cohort_summary, "cohort", ("thread_rep_attribution",)),
}


def materialise(t: Funnel, folder: str, names: tuple[str, ...] = tuple(VIEWS)) -> dict[str, str]:
    """Write views as Parquet, each after those it builds on; name to path.

    A view whose key repeats is refused: its joins have fanned out.
    """
    done: dict[str, str] = {}

    def build(name: str) -> None:
        if name in done:
            return
        view, key, needs = VIEWS[name]
        for n in needs:
            build(n)
        path = f"{folder}/{name}"
        view(t).write.mode("overwrite").parquet(path)
        if dedupe.repeated_keys(t.spark.read.parquet(path), [key]).limit(1).count():
            raise ValueError(f"{name}: {key} repeats")
        done[name] = path

    for name in names:
        build(name)
    return done
