"""The relational operators one by one: scans, predicates, joins, aggregates, windows, order, sets."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidewright.functions import times
from tidewright.operators import aggs as A
from tidewright.operators import dedupe, joins, snapshots
from tidewright.operators.snapshots import within

from . import ranges as R
from . import views as V
from .registry import query

THREADS_NOW = "(SELECT * FROM thread_snapshot WHERE snapshot_date = (SELECT max(snapshot_date) FROM thread_snapshot))"
SENT_NOW = "(SELECT * FROM campaign_snapshot WHERE snapshot_date = (SELECT max(snapshot_date) FROM campaign_snapshot))"

# Scans and sinks -----------------------------------------------------------

query("s01_latest_snapshot", f"SELECT * FROM {SENT_NOW}", ("campaign_snapshot",))(lambda t: snapshots.latest(t["campaign_snapshot"]))

query("s02_latest_date", "SELECT snapshot_date FROM campaign_snapshot ORDER BY snapshot_date DESC LIMIT 1", ("campaign_snapshot",))(
    lambda t: t["campaign_snapshot"].select("snapshot_date").orderBy(F.desc("snapshot_date")).limit(1)
)

query(
    "s03_prior_snapshot",
    "SELECT snapshot_date, count(*) AS campaigns, cast(sum(sent_count) AS bigint) AS sent FROM campaign_snapshot WHERE snapshot_date < date '2001-01-01' GROUP BY 1 ORDER BY 1 DESC LIMIT 1",
    ("campaign_snapshot",),
)(lambda t: snapshots.latest_before(t["campaign_snapshot"], "2001-01-01").groupBy("snapshot_date").agg(F.count(F.lit(1)).alias("campaigns"), A.total("sent_count").alias("sent")))

_RAW_TIME = "CASE event_id % 4 WHEN 0 THEN cast(1700000000 + event_id AS string) WHEN 1 THEN strftime(ts, '%Y-%m-%dT%H:%M:%S') WHEN 2 THEN '' END"
query(
    "s04_shaped_times",
    f"""SELECT event_id, CASE WHEN trim(raw) = '' THEN NULL WHEN try_cast(raw AS double) IS NOT NULL THEN strftime(make_timestamp(cast(raw AS bigint) * 1000000), '%Y-%m-%dT%H:%M:%S+00:00') ELSE raw END AS created_at,
        coalesce(nullif(value, 0), 0) AS value FROM (SELECT event_id, value, {_RAW_TIME} AS raw FROM events)""",
)(
    lambda t: t["events"]
    .withColumn("raw", F.expr("CASE event_id % 4 WHEN 0 THEN cast(1700000000 + event_id AS string) WHEN 1 THEN date_format(ts, \"yyyy-MM-dd'T'HH:mm:ss\") WHEN 2 THEN '' END"))
    .select("event_id", times.iso_time(F.col("raw")).alias("created_at"), F.coalesce("value", F.lit(0.0)).alias("value"))
)

query(
    "s11_upsert",
    """SELECT c_custkey, c_name, c_acctbal FROM customer WHERE c_custkey % 3 <> 0
    UNION ALL SELECT k, arg_max(n, o), arg_max(b, o) FROM (SELECT o_custkey - o_custkey % 3 AS k, 'order ' || cast(o_orderkey AS string) AS n, o_totalprice AS b, o_orderkey AS o FROM orders) GROUP BY k
    UNION ALL SELECT c_custkey, c_name, c_acctbal FROM customer WHERE c_custkey % 3 = 0 AND c_custkey NOT IN (SELECT o_custkey - o_custkey % 3 FROM orders)""",
)(
    lambda t: dedupe.upsert(
        t["customer"].select("c_custkey", "c_name", "c_acctbal"),
        t["orders"].select((F.col("o_custkey") - F.col("o_custkey") % 3).alias("c_custkey"), F.concat(F.lit("order "), F.col("o_orderkey").cast("string")).alias("c_name"), F.col("o_totalprice").alias("c_acctbal"), F.col("o_orderkey").alias("ord")),
        ["c_custkey"],
        "ord",
    )
)

query(
    "s12_insert_absent",
    "SELECT min(event_id) AS event_id, user_id FROM events WHERE user_id NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 2 = 0) GROUP BY user_id",
)(
    lambda t: dedupe.insert_absent(
        t["customer"].filter("c_custkey % 2 = 0").select(F.col("c_custkey").alias("user_id")), t["events"].select("event_id", "user_id", F.col("event_id").alias("ord")), ["user_id"], "ord"
    )
)

query("s13_repeated_keys", "SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL HAVING n > 1")(lambda t: dedupe.repeated_keys(t["events"], ["user_id", "event_type"]))

query(
    "s14_freshness",
    """SELECT *, greatest(threads, campaigns, deals) AS overall FROM (SELECT (SELECT max(pulled_at) FROM thread_snapshot) AS threads, (SELECT max(pulled_at) FROM campaign_snapshot) AS campaigns,
        (SELECT max(pulled_at) FROM deal_dim) AS deals, cast(NULL AS timestamp) AS contacts)""",
    ("thread_snapshot", "campaign_snapshot", "deal_dim"),
)(lambda t: snapshots.freshness({"threads": (t["thread_snapshot"], "pulled_at"), "campaigns": (t["campaign_snapshot"], "pulled_at"), "deals": (t["deal_dim"], "pulled_at"), "contacts": (None, "pulled_at")}))

query("s15_renamed_columns", "SELECT p_partkey AS part, p_brand AS brand, p_retailprice AS price FROM part")(lambda t: t["part"].select(F.col("p_partkey").alias("part"), F.col("p_brand").alias("brand"), F.col("p_retailprice").alias("price")))

# Predicates and projections -------------------------------------------------

query(
    "p01_label_flags",
    "SELECT snapshot_date, conv_id, coalesce(list_contains(author_names, 'Nat Doe'), false) AS by_nat, list_contains(label_names, 'Call Booked') AS booked FROM thread_snapshot",
    ("thread_snapshot",),
)(lambda t: t["thread_snapshot"].select("snapshot_date", "conv_id", A.has_label("author_names", "Nat Doe").alias("by_nat"), A.has_label("label_names", V.BOOKED).alias("booked")))

query(
    "p02_backfilled_email",
    f"""SELECT conv_id, coalesce(nullif(trim(lead_email), ''), k.known) AS lead_email FROM {THREADS_NOW} s
        LEFT JOIN (SELECT conv_id, arg_max(lead_email, snapshot_date) AS known FROM thread_snapshot WHERE trim(lead_email) <> '' GROUP BY 1) k USING (conv_id)""",
    ("thread_snapshot",),
)(lambda t: V.threads_today(t).select("conv_id", "lead_email"))

query("p03_waterfall", "SELECT deal_id, coalesce(attributed_rep, attributed_campaign, deal_source) AS credit FROM deal_dim", ("deal_dim",))(
    lambda t: t["deal_dim"].select("deal_id", F.coalesce("attributed_rep", "attributed_campaign", "deal_source").alias("credit"))
)

query("p04_bucket_label", f"SELECT coalesce(attributed_rep, '{V.NO_REP}') AS rep, count(*) AS deals FROM deal_dim GROUP BY 1", ("deal_dim",))(
    lambda t: t["deal_dim"].groupBy(F.coalesce("attributed_rep", F.lit(V.NO_REP)).alias("rep")).agg(F.count(F.lit(1)).alias("deals"))
)

query("p05_not_flagged", "SELECT deal_id FROM deal_dim WHERE NOT coalesce(campaign_is_mpc, false)", ("deal_dim",))(lambda t: t["deal_dim"].filter(~A.flag("campaign_is_mpc")).select("deal_id"))

query("p06_not_lost", "SELECT deal_id, stage_label FROM deal_dim WHERE coalesce(stage_label, '') NOT ILIKE '%LOST%'", ("deal_dim",))(
    lambda t: t["deal_dim"].filter(~F.lower(F.coalesce("stage_label", F.lit(""))).contains("lost")).select("deal_id", "stage_label")
)

query("p07_closed_window", "SELECT deal_id, closedate FROM deal_dim WHERE closedate >= timestamp '1998-01-01' AND closedate <= timestamp '1998-06-30 23:59:59.999'", ("deal_dim",))(
    lambda t: t["deal_dim"].filter(within("closedate", "1998-01-01", "1998-06-30")).select("deal_id", "closedate")
)

query(
    "p08_touched_window",
    "SELECT deal_id FROM deal_dim WHERE (closedate >= timestamp '1998-01-01' AND closedate < timestamp '1998-07-01') OR (createdate >= timestamp '1998-01-01' AND createdate < timestamp '1998-07-01')",
    ("deal_dim",),
)(lambda t: R.touching(t["deal_dim"], "1998-01-01", "1998-06-30").select("deal_id"))

query("p09_null_or_false", "SELECT campaign_id FROM campaign_dim WHERE is_mpc IS NOT true", ("campaign_dim",))(lambda t: t["campaign_dim"].filter(F.col("is_mpc").isNull() | ~F.col("is_mpc")).select("campaign_id"))

query("p10_known_key", "SELECT conv_id, lead_email FROM thread_snapshot WHERE length(lead_email) > 0", ("thread_snapshot",))(lambda t: t["thread_snapshot"].filter(A.known("lead_email")).select("conv_id", "lead_email"))

query("p11_code_prefix", "SELECT o_orderkey FROM orders WHERE starts_with(upper(o_orderpriority), '1-UR')")(lambda t: t["orders"].filter((F.col("o_orderpriority") != "") & F.upper("o_orderpriority").startswith("1-UR")).select("o_orderkey"))

query(
    "p12_safe_ratio",
    "SELECT campaign_id, round(CASE WHEN sent_count > 0 THEN replied_count / sent_count ELSE 0 END, 6) AS reply_rate, round(CASE WHEN replied_count > 0 THEN positive_reply_count / replied_count END, 6) AS positive_rate FROM campaign_snapshot",
    ("campaign_snapshot",),
)(lambda t: t["campaign_snapshot"].select("campaign_id", F.round(A.ratio("replied_count", "sent_count"), 6).alias("reply_rate"), F.round(A.ratio("positive_reply_count", "replied_count", None), 6).alias("positive_rate")))

query("p13_hashed_key", "SELECT conv_id, CASE WHEN lead_email IS NOT NULL THEN 'base-' || md5(lead_email) END AS key FROM thread_snapshot", ("thread_snapshot",))(
    lambda t: t["thread_snapshot"].select("conv_id", F.concat(F.lit("base-"), F.md5("lead_email")).alias("key"))
)

query("p14_constant_rows", "SELECT * FROM (VALUES ('MPC', true), ('Non-MPC', false)) v(cohort, is_mpc)")(lambda t: t.spark.createDataFrame([("MPC", True), ("Non-MPC", False)], "cohort string, is_mpc boolean"))

query("p15_typed_nulls", "SELECT r_name AS name, cast(NULL AS date) AS day FROM region UNION ALL SELECT NULL, cast(max(ts) AS date) FROM events")(
    lambda t: t["region"].select(F.col("r_name").alias("name"), F.lit(None).cast("date").alias("day")).unionByName(t["events"].agg(F.max("ts").cast("date").alias("day")), allowMissingColumns=True)
)

# Joins -----------------------------------------------------------------------

query(
    "j01_star",
    f"""SELECT s.conv_id, p.company, c.name, r.display_name FROM {THREADS_NOW} s LEFT JOIN contact_dim p ON p.email = lower(s.lead_email)
        LEFT JOIN campaign_dim c ON c.campaign_id = p.first_seen_campaign LEFT JOIN rep_dim r ON r.rep_key = c.assigned_rep""",
    ("thread_snapshot", "contact_dim", "campaign_dim", "rep_dim"),
)(
    lambda t: snapshots.latest(t["thread_snapshot"])
    .withColumn("email", F.lower("lead_email"))
    .join(t["contact_dim"], "email", "left")
    .join(t["campaign_dim"].select(F.col("campaign_id").alias("first_seen_campaign"), "name", F.col("assigned_rep").alias("rep_key")), "first_seen_campaign", "left")
    .join(t["rep_dim"], "rep_key", "left")
    .select("conv_id", "company", "name", "display_name")
)

query("j02_inner_with_condition", "SELECT s.campaign_id, s.sent_count FROM campaign_snapshot s JOIN campaign_dim c ON c.campaign_id = s.campaign_id AND c.is_mpc", ("campaign_snapshot", "campaign_dim"))(
    lambda t: t["campaign_snapshot"].join(t["campaign_dim"].filter("is_mpc").select("campaign_id"), "campaign_id").select("campaign_id", "sent_count")
)

query(
    "j03_alias",
    f"""SELECT DISTINCT a.conv_id, r.rep_key FROM (SELECT conv_id, unnest(authors) AS mail, unnest(coalesce(author_names, [])) AS who FROM {THREADS_NOW}) a JOIN rep_dim r
        ON lower(r.rep_email) = lower(a.mail) OR lower(r.rep_key) = lower(split_part(a.mail, '@', 1)) OR lower(r.rep_key) = lower(split_part(coalesce(a.who, ''), ' ', 1)) OR (r.rep_key = 'NATION_3' AND split_part(lower(a.who), ' ', 1) = 'nat')""",
    ("thread_snapshot", "rep_dim"),
)(
    lambda t: joins.match_alias(
        joins.unnest_pairs(snapshots.latest(t["thread_snapshot"]), "authors", "author_names", ("mail", "who")), "mail", "who", joins.alias_table(t["rep_dim"], "rep_key", "rep_email", V.NICKNAMES)
    )
    .select("conv_id", "rep_key")
    .distinct()
)

query(
    "j04_parallel_unnest",
    "SELECT snapshot_date, conv_id, unnest(authors) AS mail, unnest(coalesce(author_names, [])) AS who FROM thread_snapshot",
    ("thread_snapshot",),
)(lambda t: joins.unnest_pairs(t["thread_snapshot"], "authors", "author_names", ("mail", "who")).select("snapshot_date", "conv_id", "mail", "who"))

query(
    "j05_null_safe",
    """SELECT d.rep, d.deals, c.campaigns FROM (SELECT attributed_rep AS rep, count(*) AS deals FROM deal_dim GROUP BY 1) d
        JOIN (SELECT assigned_rep AS rep, count(*) AS campaigns FROM campaign_dim GROUP BY 1) c ON c.rep IS NOT DISTINCT FROM d.rep""",
    ("deal_dim", "campaign_dim"),
)(
    lambda t: (
        lambda d, c: d.join(c, d["rep"].eqNullSafe(c["r"])).select("rep", "deals", "campaigns")
    )(t["deal_dim"].groupBy(F.col("attributed_rep").alias("rep")).agg(F.count(F.lit(1)).alias("deals")), t["campaign_dim"].groupBy(F.col("assigned_rep").alias("r")).agg(F.count(F.lit(1)).alias("campaigns")))
)

query(
    "j06_full_outer",
    """SELECT coalesce(a.brand, b.brand) AS brand, coalesce(parts, 0) AS parts, coalesce(promos, 0) AS promos FROM (SELECT p_brand AS brand, count(*) AS parts FROM part WHERE p_size > 40 GROUP BY 1) a
        FULL JOIN (SELECT p_brand AS brand, count(*) AS promos FROM part WHERE p_type = 'PROMO' GROUP BY 1) b ON a.brand = b.brand""",
)(
    lambda t: t["part"]
    .filter("p_size > 40")
    .groupBy(F.col("p_brand").alias("brand"))
    .agg(F.count(F.lit(1)).alias("parts"))
    .join(t["part"].filter("p_type = 'PROMO'").groupBy(F.col("p_brand").alias("brand")).agg(F.count(F.lit(1)).alias("promos")), "brand", "full_outer")
    .fillna(0, ["parts", "promos"])
)

query("j07_anti", "SELECT c_custkey FROM customer c WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey)")(lambda t: t["customer"].join(t["orders"], F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey"))

query(
    "j08_first_seen",
    "SELECT campaign_id FROM campaign_snapshot GROUP BY 1 HAVING min(snapshot_date) = date '1999-01-01'",
    ("campaign_snapshot",),
)(lambda t: snapshots.first_seen_on(t["campaign_snapshot"], F.lit("1999-01-01").cast("date"), "campaign_id").select("campaign_id"))

query("j09_single_rows", "SELECT (SELECT count(*) FROM orders) AS orders, (SELECT count(*) FROM customer) AS customers")(
    lambda t: t["orders"].agg(F.count(F.lit(1)).alias("orders")).crossJoin(t["customer"].agg(F.count(F.lit(1)).alias("customers")))
)

query(
    "j10_spine",
    """SELECT rep, cast(sum(a) AS bigint) AS deals, cast(sum(b) AS bigint) AS campaigns, cast(sum(c) AS bigint) AS appointments FROM (SELECT attributed_rep AS rep, 1 AS a, 0 AS b, 0 AS c FROM deal_dim
        UNION ALL SELECT assigned_rep, 0, 1, 0 FROM campaign_dim UNION ALL SELECT rep_key, 0, 0, 1 FROM appt_event) GROUP BY rep""",
    ("deal_dim", "campaign_dim", "appt_event"),
)(
    lambda t: joins.spine(
        [
            t["deal_dim"].groupBy(F.col("attributed_rep").alias("rep")).agg(F.count(F.lit(1)).alias("deals")),
            t["campaign_dim"].groupBy(F.col("assigned_rep").alias("rep")).agg(F.count(F.lit(1)).alias("campaigns")),
            t["appt_event"].groupBy(F.col("rep_key").alias("rep")).agg(F.count(F.lit(1)).alias("appointments")),
        ],
        "rep",
        ["deals", "campaigns", "appointments"],
    )
)

query(
    "j11_lookup",
    "SELECT e.event_id, coalesce(c.c_mktsegment, 'none') AS segment FROM events e LEFT JOIN customer c ON c.c_custkey = e.user_id AND c.c_custkey % 2 = 0",
)(lambda t: joins.lookup(t["events"], t["customer"].filter("c_custkey % 2 = 0").select(F.col("c_custkey").alias("user_id"), F.col("c_mktsegment").alias("segment")), "user_id", "segment", "none").select("event_id", "segment"))

_PREFIXES = [("Brand#1", "one"), ("Brand#12", "twelve"), ("Brand#2", "two"), ("Brand#20", "twenty")]
_EXCLUDED = [("Brand#11",), ("Brand#24",)]
query(
    "j12_longest_prefix",
    f"""SELECT p_partkey, CASE WHEN NOT EXISTS (SELECT 1 FROM (VALUES {", ".join(f"('{x}')" for x, in _EXCLUDED)}) e(x) WHERE starts_with(p_brand, x)) THEN label END AS label
        FROM part LEFT JOIN (SELECT p_partkey, arg_max(l, length(x)) AS label FROM part, (VALUES {", ".join(f"('{x}', '{y}')" for x, y in _PREFIXES)}) v(x, l) WHERE starts_with(p_brand, x) GROUP BY 1) USING (p_partkey)""",
)(lambda t: joins.longest_prefix(t["part"].select("p_partkey", "p_brand"), "p_brand", t.spark.createDataFrame(_PREFIXES, "prefix string, label string"), t.spark.createDataFrame(_EXCLUDED, "prefix string")).select("p_partkey", "label"))

query("j13_not_in_state", "SELECT DISTINCT user_id FROM events WHERE event_type = 'signup' EXCEPT SELECT user_id FROM events WHERE event_type = 'purchase'")(
    lambda t: t["events"].filter("event_type = 'signup'").select("user_id").distinct().join(t["events"].filter("event_type = 'purchase'").select("user_id").distinct(), "user_id", "left_anti")
)

# Aggregates --------------------------------------------------------------------

query("a01_totals", "SELECT count(*) AS n, coalesce(sum(o_totalprice), 0) AS total FROM orders WHERE o_orderkey < 0")(lambda t: t["orders"].filter("o_orderkey < 0").agg(F.count(F.lit(1)).alias("n"), A.total("o_totalprice").alias("total")))

query(
    "a02_filtered",
    "SELECT o_orderpriority, count(*) FILTER (o_orderstatus = 'F') AS done, round(coalesce(sum(o_totalprice) FILTER (o_orderstatus = 'P'), 0), 2) AS held FROM orders GROUP BY 1",
)(lambda t: t["orders"].groupBy("o_orderpriority").agg(A.count_if(F.col("o_orderstatus") == "F").alias("done"), F.round(A.sum_if("o_totalprice", F.col("o_orderstatus") == "P"), 2).alias("held")))

query(
    "a03_distinct_filtered",
    "SELECT count(DISTINCT user_id) FILTER (event_type = 'signup') AS signups, count(DISTINCT user_id) FILTER (event_type = 'purchase') AS buyers FROM events",
)(lambda t: t["events"].agg(A.distinct_if("user_id", F.col("event_type") == "signup").alias("signups"), A.distinct_if("user_id", F.col("event_type") == "purchase").alias("buyers")))

query("a04_any", "SELECT attributed_rep, bool_or(campaign_is_mpc) AS any_flagged FROM deal_dim GROUP BY 1", ("deal_dim",))(lambda t: t["deal_dim"].groupBy("attributed_rep").agg(F.bool_or("campaign_is_mpc").alias("any_flagged")))

query("a05_extremes", "SELECT event_type, min(ts) AS first, max(ts) AS last, max(props) AS props FROM events GROUP BY 1")(lambda t: t["events"].groupBy("event_type").agg(F.min("ts").alias("first"), F.max("ts").alias("last"), F.max("props").alias("props")))

query("a06_percentiles", "SELECT round(quantile_cont(value, 0.9), 6) AS top, round(quantile_cont(value, 0.1), 6) AS bottom FROM events WHERE event_type = 'purchase'")(
    lambda t: t["events"].filter("event_type = 'purchase'").agg(F.round(F.percentile("value", 0.9), 6).alias("top"), F.round(F.percentile("value", 0.1), 6).alias("bottom"))
)

query(
    "a07_mode",
    "SELECT c_nationkey, c_mktsegment AS segment FROM customer GROUP BY ALL QUALIFY row_number() OVER (PARTITION BY c_nationkey ORDER BY count(*) DESC, c_mktsegment) = 1".replace("GROUP BY ALL", "GROUP BY c_nationkey, c_mktsegment"),
)(lambda t: t["customer"].groupBy("c_nationkey").agg(F.mode("c_mktsegment", True).alias("segment")))

query("a08_null_group", "SELECT is_mpc, count(*) AS n FROM campaign_dim GROUP BY 1", ("campaign_dim",))(lambda t: t["campaign_dim"].groupBy("is_mpc").agg(F.count(F.lit(1)).alias("n")))

query("a09_sets_by_key", "SELECT user_id, count(*) AS n, count(DISTINCT event_type) AS kinds FROM events GROUP BY 1")(lambda t: t["events"].groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("event_type").alias("kinds")))

query(
    "a12_histogram",
    "SELECT strftime(ts, '%Y-%m-%d') AS day, CASE WHEN value < 5 THEN 'low' WHEN value < 20 THEN 'mid' ELSE 'high' END AS size, count(*) AS n FROM events GROUP BY ALL",
)(lambda t: t["events"].groupBy(F.date_format("ts", "yyyy-MM-dd").alias("day"), F.when(F.col("value") < 5, "low").when(F.col("value") < 20, "mid").otherwise("high").alias("size")).agg(F.count(F.lit(1)).alias("n")))

query(
    "a13_gate",
    "SELECT user_id, CASE WHEN bool_or(event_type = 'error' AND value > 30) THEN 1 WHEN bool_or(event_type = 'error') THEN 2 ELSE 0 END AS code FROM events GROUP BY 1",
)(lambda t: t["events"].groupBy("user_id").agg(A.gate((F.col("event_type") == "error") & (F.col("value") > 30), F.col("event_type") == "error").alias("code")))

query(
    "a14_last_wins",
    "SELECT o_custkey, round(sum(o_totalprice), 2) AS total, arg_max(o_totalprice, o_orderkey) FILTER (o_orderstatus = 'P') AS held FROM orders GROUP BY 1",
)(lambda t: t["orders"].groupBy("o_custkey").agg(F.round(F.sum("o_totalprice"), 2).alias("total"), F.max_by(F.col("o_totalprice"), F.when(F.col("o_orderstatus") == "P", F.col("o_orderkey"))).alias("held")))

# Windows, order, sets ---------------------------------------------------------------

query("w01_latest_of_union", "SELECT email, rep FROM (SELECT lead_email AS email, rep_key AS rep, meeting_at AS met FROM appt_event UNION ALL SELECT lower(email), rep_key, cast(meeting_date AS timestamp) FROM appt_backfill WHERE rep_key IS NOT NULL) QUALIFY row_number() OVER (PARTITION BY email ORDER BY met DESC, rep) = 1", ("appt_event", "appt_backfill"))(
    lambda t: V.appointment_reps(t).withColumnRenamed("appt_rep", "rep")
)

query("w02_rank_both_ways", "SELECT p_partkey, rank() OVER (PARTITION BY p_type ORDER BY p_size DESC) AS down, rank() OVER (PARTITION BY p_type ORDER BY p_size) AS up FROM part")(
    lambda t: t["part"].select(
        "p_partkey", F.rank().over(Window.partitionBy("p_type").orderBy(F.desc("p_size"))).cast("long").alias("down"), F.rank().over(Window.partitionBy("p_type").orderBy("p_size")).cast("long").alias("up")
    )
)

query("w03_distinct_on", "SELECT DISTINCT ON (o_custkey) o_custkey, o_orderkey FROM orders ORDER BY o_custkey, o_totalprice DESC, o_orderkey")(
    lambda t: dedupe.keep_one(t["orders"], ["o_custkey"], [F.desc("o_totalprice"), F.asc("o_orderkey")]).select("o_custkey", "o_orderkey")
)

query("t01_order", "SELECT conv_id, last_activity FROM thread_snapshot", ("thread_snapshot",))(lambda t: t["thread_snapshot"].select("conv_id", "last_activity").orderBy(F.desc("last_activity"), "conv_id"))
query("t02_null_order", "SELECT deal_id, closedate FROM deal_dim", ("deal_dim",))(lambda t: t["deal_dim"].select("deal_id", "closedate").orderBy(F.desc_nulls_last("closedate"), "deal_id"))
query("t03_top_one", "SELECT max(snapshot_date) AS day FROM thread_snapshot", ("thread_snapshot",))(lambda t: t["thread_snapshot"].select(F.col("snapshot_date").alias("day")).orderBy(F.desc("day")).limit(1))
query("t04_top_n", "SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1 ORDER BY n DESC, o_custkey LIMIT 15")(lambda t: t["orders"].groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "o_custkey").limit(15))
query(
    "t06_split_by_predicate",
    "SELECT o_orderkey, CASE WHEN o_orderdate >= timestamp '2000-01-01' THEN 'recent' ELSE 'older' END AS output FROM orders",
)(
    lambda t: (lambda o: o.filter("o_orderdate >= timestamp_ntz '2000-01-01'").withColumn("output", F.lit("recent")).unionByName(o.filter("o_orderdate < timestamp_ntz '2000-01-01'").withColumn("output", F.lit("older"))))(
        t["orders"].orderBy(F.desc("o_orderdate"))
    ).select("o_orderkey", "output")
)

query("u01_two_shapes", "SELECT cast(c_custkey AS string) AS id, c_name AS name, NULL AS size FROM customer UNION ALL SELECT p_name, NULL, p_size FROM part")(
    lambda t: t["customer"].select(F.col("c_custkey").cast("string").alias("id"), F.col("c_name").alias("name")).unionByName(t["part"].select(F.col("p_name").alias("id"), F.col("p_size").alias("size")), allowMissingColumns=True)
)
query("u02_two_feeds", "SELECT lower(email) AS email, rep_key FROM appt_backfill UNION ALL SELECT lead_email, rep_key FROM appt_event", ("appt_backfill", "appt_event"))(
    lambda t: t["appt_backfill"].select(F.lower("email").alias("email"), "rep_key").unionByName(t["appt_event"].select(F.col("lead_email").alias("email"), "rep_key"))
)
query("u03_distinct_keys", "SELECT attributed_rep AS rep FROM deal_dim UNION SELECT assigned_rep FROM campaign_dim", ("deal_dim", "campaign_dim"))(
    lambda t: t["deal_dim"].select(F.col("attributed_rep").alias("rep")).unionByName(t["campaign_dim"].select(F.col("assigned_rep").alias("rep"))).distinct()
)
query(
    "u04_coverage",
    "SELECT c_custkey, (c_custkey IN (SELECT o_custkey FROM orders)) AS caught FROM customer",
)(
    lambda t: (lambda c, o: c.join(o, "c_custkey", "left_semi").withColumn("caught", F.lit(True)).unionByName(c.join(o, "c_custkey", "left_anti").withColumn("caught", F.lit(False))))(
        t["customer"].select("c_custkey"), t["orders"].select(F.col("o_custkey").alias("c_custkey"))
    )
)

# Deduplication ----------------------------------------------------------------------

query("d01_latest", "SELECT user_id, arg_max(event_id, ts) AS event_id FROM events GROUP BY 1")(lambda t: dedupe.keep_latest(t["events"], ["user_id"], "ts", "event_id").select("user_id", "event_id"))
query(
    "d02_best",
    "SELECT lower(primary_contact_email) AS email, deal_id FROM deal_dim WHERE primary_contact_email IS NOT NULL QUALIFY row_number() OVER (PARTITION BY lower(primary_contact_email) ORDER BY is_closed_won DESC NULLS FIRST, amount DESC NULLS LAST, deal_id) = 1",
    ("deal_dim",),
)(lambda t: V.picked_deals(t).select("email", "deal_id"))
query("d03_first_seen", "SELECT user_id, event_type, min(event_id) AS event_id FROM events GROUP BY ALL")(lambda t: dedupe.keep_first(t["events"], ["user_id", "event_type"], "event_id").select("user_id", "event_type", "event_id"))
query("d04_last_seen", "SELECT user_id, event_type, max(event_id) AS event_id FROM events GROUP BY ALL")(lambda t: dedupe.keep_last(t["events"], ["user_id", "event_type"], "event_id").select("user_id", "event_type", "event_id"))
query("d05_recent", "SELECT o_orderpriority, o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderdate DESC, o_orderkey) = 1")(
    lambda t: dedupe.keep_recent(t["orders"], "o_orderpriority", "o_orderdate", "o_orderkey").select("o_orderpriority", "o_orderkey")
)
