"""Invariants of the views, and edge rows that the test tables don't have."""

import datetime

from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewright.operators import dedupe
from tidewright.plans import ranges, views
from tidewright.sources.funnel import DOMAIN_TABLES, Funnel

SF = "/root/testdata/sf0.001"
AT = datetime.datetime


def tables(spark, **rows):
    """A funnel whose tables are empty but for the given rows (dicts)."""
    base = Funnel(spark, SF)
    given = {}
    for name in DOMAIN_TABLES:
        schema = T.StructType([T.StructField(f.name, f.dataType) for f in base[name].schema.fields])
        given[name] = spark.createDataFrame([tuple(r.get(c) for c in schema.names) for r in rows.get(name, [])], schema)
    return Funnel(spark, None, given)


def thread(conv, day="2024-01-30", email=None, labels=(), authors=None, who=None, at=AT(2024, 1, 20)):
    return {"snapshot_date": datetime.date.fromisoformat(day), "conv_id": conv, "subject": conv, "last_activity": at, "messages_count": 1, "label_names": list(labels), "lead_email": email, "authors": authors, "author_names": who, "pulled_at": at}


def test_view_keys_are_unique(spark, tmp_path):
    views.materialise(Funnel(spark, SF), str(tmp_path), ("per_rep_mpc", "campaign_rankings", "per_candidate", "cohort_summary"))


def test_fan_out_is_refused(spark, tmp_path, monkeypatch):
    monkeypatch.setitem(views.VIEWS, "twice", (lambda t: t.spark.createDataFrame([(1,), (1,)], "k int"), "k", ()))
    try:
        views.materialise(Funnel(spark, SF), str(tmp_path), ("twice",))
    except ValueError as error:
        assert "repeats" in str(error)
    else:
        raise AssertionError("a repeated key was accepted")


def test_cohorts_share_out_won_deals(spark):
    t = Funnel(spark, SF)
    won = views.cohort_summary(t).agg(F.sum("closed_won")).first()[0]
    assert won == views.headline(t).first()["closed_won_count"]
    assert won == views.campaign_rankings(t).agg(F.sum("deals")).first()[0]


def test_blank_email_is_filled_and_the_gone_lead_kept(spark):
    t = tables(
        spark,
        thread_snapshot=[thread("a", "2024-01-15", "Lead@x"), thread("a", "2024-01-30", " ", ["Call Booked"])],
        baseline_thread=[{"email": "lead@x", "label": "Interested"}],
    )
    rows = {r["conv_id"]: r for r in views.thread_rep_attribution(t).collect()}
    assert rows["a"]["lead_email"] == "lead@x" and rows["a"]["is_call_booked"]
    gone = next(r for c, r in rows.items() if c.startswith("base-"))
    assert len(rows) == 2 and gone["is_positive"] and not gone["is_call_booked"]


def test_rep_rungs_in_order(spark):
    reps = [{"rep_key": k, "rep_email": f"{k.lower()}@firm", "display_name": k} for k in ("Ann", "Bob", "Cy", "Di")]
    t = tables(
        spark,
        rep_dim=reps,
        thread_snapshot=[
            thread("all", email="1@x", authors=["ann@firm"], who=None),
            thread("campaign", email="2@x", authors=["ann@firm"]),
            thread("signed", email="3@x", authors=["no@x", "other@x"], who=["Nobody", "Ann Lee"]),
            thread("local", email="4@x", authors=["bob@home"], who=[]),
            thread("none", email="5@x", authors=[], who=None),
            thread("two", email="6@x", authors=["di@firm", "cy@firm"]),
        ],
        contact_dim=[{"email": "1@x", "first_seen_campaign": "c"}, {"email": "2@x", "first_seen_campaign": "c"}],
        campaign_dim=[{"campaign_id": "c", "name": "c", "assigned_rep": "Bob"}],
        appt_backfill=[{"email": "1@X", "rep_key": "Cy", "meeting_date": datetime.date(2024, 1, 2)}],
        appt_event=[{"lead_email": "1@x", "rep_key": "Di", "meeting_at": AT(2024, 1, 3)}, {"lead_email": "1@x", "rep_key": "Ann", "meeting_at": None}],
    )
    got = {r["conv_id"]: r["rep_key"] for r in views.thread_rep_attribution(t).collect()}
    assert got == {"all": "Di", "campaign": "Bob", "signed": "Ann", "local": "Bob", "none": None, "two": "Cy"}


def test_null_rep_is_a_rep_of_its_own(spark):
    won = {"is_closed_won": True, "is_outbound_attributed": True, "campaign_is_mpc": True, "amount": 2.0}
    t = tables(spark, deal_dim=[{"deal_id": "1", "attributed_rep": None, **won}, {"deal_id": "2", "attributed_rep": "Ann", **won}])
    got = {r["rep"]: r["deals"] for r in views.per_rep_mpc(t).collect()}
    assert got == {views.NO_REP: 1, "Ann": 1}


def test_unknown_outcome_beats_won_when_deals_are_picked(spark):
    row = {"primary_contact_email": "A@x", "amount": 1.0}
    t = tables(spark, deal_dim=[{"deal_id": "won", "is_closed_won": True, **row}, {"deal_id": "open", "is_closed_won": None, **row}])
    assert [r["deal_id"] for r in views.picked_deals(t).collect()] == ["open"]


def test_breakdowns_differ_on_blank_emails_and_fields(spark):
    t = tables(
        spark,
        thread_snapshot=[thread("a", email=None), thread("b", email=""), thread("c", email="1@x"), thread("d", email="2@x")],
        contact_dim=[{"email": "1@x", "industry": ""}, {"email": "2@x", "industry": None}],
    )
    assert {r["industry"]: r["threads"] for r in views.industry_breakdown(t).collect()} == {views.NO_INDUSTRY: 3, "": 1}
    assert {r["bucket"]: r["threads"] for r in ranges.breakdown(t, "industry", "none", "2024-01-01", "2024-01-31").collect()} == {"none": 2}


def test_window_ends_at_the_last_millisecond(spark):
    times = [AT(2024, 1, 2), AT(2024, 1, 2, 23, 59, 59, 999000), AT(2024, 1, 2, 23, 59, 59, 999500), AT(2024, 1, 1, 23, 59, 59), None]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(times)], "i int, at timestamp_ntz")
    from tidewright.operators.snapshots import within

    assert [r["i"] for r in df.filter(within("at", "2024-01-02", "2024-01-02")).orderBy("i").collect()] == [0, 1]


def test_campaign_without_a_flag(spark):
    t = tables(
        spark,
        campaign_dim=[{"campaign_id": "a", "is_mpc": None}, {"campaign_id": "b", "is_mpc": True}],
        campaign_snapshot=[{"snapshot_date": datetime.date(2024, 1, 1), "campaign_id": c, "sent_count": 1, "replied_count": 1, "created_at": AT(2024, 1, 1)} for c in "ab"],
    )
    assert {r["cohort"]: r["campaigns"] for r in views.cohort_summary(t).collect()} == {"MPC": 1, "Non-MPC": 0}
    assert {r["cohort"]: r["campaigns"] for r in ranges.cohort_summary(t, "2024-01-01", "2024-01-02").collect()} == {"MPC": 1, "Non-MPC": 1}


def test_no_calls_give_no_deciles(spark):
    t = tables(spark, thread_snapshot=[thread("a", email="1@x")])
    row = views.meeting_deal_ratio(t).first()
    assert row["ratio"] is None and not row["is_top_decile"] and not row["is_bottom_decile"]


def test_upsert_takes_the_last_of_a_batch(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    new = spark.createDataFrame([(2, "x", 1), (2, "y", 2), (3, "z", 3)], "k int, v string, o int")
    assert sorted(map(tuple, dedupe.upsert(old, new, ["k"], "o").collect())) == [(1, "a"), (2, "y"), (3, "z")]
