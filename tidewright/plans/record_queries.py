"""Functions, rule cascades, refinery jobs and small record operators as queries."""

from __future__ import annotations

from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from tidewright.functions import records, strings, text, times
from tidewright.operators import joins, monitors, names, slots
from tidewright.operators import aggs as A
from tidewright.operators.rules import Rule, RuleSet, cascade, hits
from tidewright.sources import files
from tidewright.streaming import launches

from . import jobs
from .registry import query

# Functions -------------------------------------------------------------------

query(
    "f01_basics",
    "SELECT p_partkey, lower(p_brand) AS low, nullif(trim(' ' || p_type || ' '), 'PROMO') AS type, split_part(p_name, ' ', 2) AS second, split_part(p_name, ' ', 9) AS ninth, md5(p_name) AS digest FROM part",
)(
    lambda t: t["part"].select(
        "p_partkey",
        F.lower("p_brand").alias("low"),
        F.nullif(F.trim(F.concat(F.lit(" "), "p_type", F.lit(" "))), F.lit("PROMO")).alias("type"),
        F.split_part("p_name", F.lit(" "), F.lit(2)).alias("second"),
        F.split_part("p_name", F.lit(" "), F.lit(9)).alias("ninth"),
        F.md5("p_name").alias("digest"),
    )
)

query("f02_edit_distance", "SELECT p_partkey, levenshtein(lower(p_name), 'red widget') AS edits FROM part")(lambda t: t["part"].select("p_partkey", F.levenshtein(F.lower("p_name"), F.lit("red widget")).cast("long").alias("edits")))

query(
    "f03_alike_names",
    """SELECT p_partkey, (a = 'blues' OR (length(a) >= 3 AND starts_with('blues', a)) OR starts_with(a, 'blues') OR levenshtein(a, 'blues') <= 1) AS alike FROM (SELECT p_partkey, lower(split_part(p_name, ' ', 1)) AS a FROM part)""",
)(lambda t: t["part"].select("p_partkey", strings.alike_names(F.split_part("p_name", F.lit(" "), F.lit(1)), F.lit("Blues")).alias("alike")))

_ROSTER = ["Torven Askel", "Brisa Dunmore", "Jorik Dunmore", "Ulfa Lind", "Ulfa Rooke"]
_SPELT = {0: ("torven askel", "Torven Askel"), 1: ("Brisa", "Brisa Dunmore"), 2: ("Jorin Dunmore", "Jorik Dunmore"), 3: ("Ulfa", "Ulfa"), 4: ("Brisan Dunmore", "Brisa Dunmore"), 5: ("Zed", "Zed"), 6: ("Torve Askel", "Torven Askel"), 7: ("Kip Stroud", "Kip Stroud")}


def _cases(column: str, which: int) -> str:
    return f"CASE {column} % 9 " + " ".join(f"WHEN {k} THEN '{v[which]}'" for k, v in _SPELT.items()) + " END"


query("f04_canonical_names", f"SELECT c_custkey, {_cases('c_custkey', 0)} AS name, {_cases('c_custkey', 1)} AS canonical FROM customer")(
    lambda t: names.canonicalise(t["customer"].select("c_custkey", F.expr(_cases("c_custkey", 0)).alias("name")), "name", t.spark.createDataFrame([(n,) for n in _ROSTER], "full string"), "full")
)

_CREDIT = "CASE p_partkey % 3 WHEN 0 THEN 'Focus - ' || p_brand || ' - ' || p_name WHEN 1 THEN 'Re: ' || p_brand || ' for ' || p_type ELSE p_name END"
query(
    "f05_extracted_candidate",
    f"SELECT p_partkey, coalesce(nullif(regexp_extract(x, 'Focus - (\\S+)', 1), ''), nullif(regexp_extract(x, 'Re: (\\S+) for', 1), '')) AS candidate FROM (SELECT p_partkey, {_CREDIT} AS x FROM part)",
)(lambda t: t["part"].select("p_partkey", strings.first_match(F.expr(_CREDIT), [r"Focus - (\S+)", r"Re: (\S+) for"]).alias("candidate")))

query("f06_whole_word", "SELECT p_partkey, regexp_matches(p_name, '\\bred\\b') AS whole, contains(p_name, 'ed') AS part FROM part")(lambda t: t["part"].select("p_partkey", F.col("p_name").rlike(r"\bred\b").alias("whole"), F.col("p_name").contains("ed").alias("part")))

query("f07_cleaned_title", "SELECT p_partkey, trim(regexp_replace('Re: ' || p_name || ' [EXT]', '(?i)^re:\\s*|\\[ext\\]', '', 'g')) AS title FROM part")(
    lambda t: t["part"].select("p_partkey", strings.without(F.concat(F.lit("Re: "), "p_name", F.lit(" [EXT]")), [r"^re:\s*", r"\[ext\]"]).alias("title"))
)

query("f08_email_domain", "SELECT email, split_part(email, '@', 2) AS domain FROM contact_dim", ("contact_dim",))(lambda t: t["contact_dim"].select("email", strings.email_domain(F.col("email")).alias("domain")))

_COMPANY = "CASE c_custkey % 5 WHEN 0 THEN 'ACME ' || c_mktsegment || ', Inc.' WHEN 1 THEN 'Acme (' || c_mktsegment || ') L.L.C' WHEN 2 THEN 'acme-' || lower(c_mktsegment) || ' GmbH & Co. KG' WHEN 3 THEN 'Acme ' || c_mktsegment || ' ApS' END"
query(
    "f09_company_key",
    f"SELECT c_custkey, CASE WHEN x IS NULL THEN '' ELSE 'acme ' || lower(c_mktsegment) END AS key FROM (SELECT *, {_COMPANY} AS x FROM customer)",
)(lambda t: t["customer"].select("c_custkey", strings.company_key(F.expr(_COMPANY)).alias("key")))

query("f10_dedupe_text", "SELECT c_custkey, trim(regexp_replace(regexp_replace(lower(x), '[^a-z0-9\\s]', '', 'g'), '\\s+', ' ', 'g')) AS key FROM (SELECT c_custkey, ' ' || c_name || ' -  ' || c_mktsegment || '!' AS x FROM customer)")(
    lambda t: t["customer"].select("c_custkey", strings.dedupe_key(F.concat(F.lit(" "), "c_name", F.lit(" -  "), "c_mktsegment", F.lit("!"))).alias("key"))
)

query(
    "f11_flat_cells",
    """SELECT snapshot_date, conv_id, array_to_string(label_names, '; ') AS label_names, coalesce(array_to_string(list_filter(author_names, lambda x: x <> ''), '; '), '') AS author_names,
        coalesce(lead_email, '') AS lead_email, cast(messages_count AS string) AS messages_count, '' AS missing FROM thread_snapshot""",
    ("thread_snapshot",),
)(
    lambda t: records.flattened(t["thread_snapshot"].withColumn("day", F.col("snapshot_date")), ["conv_id", "label_names", "author_names", "lead_email", "messages_count", "missing", "day"]).select(
        F.col("day").cast("date").alias("snapshot_date"), "conv_id", "label_names", "author_names", "lead_email", "messages_count", "missing"
    )
)

query("f12_months_apart", "SELECT o_orderkey, (year(o_orderdate) - 1995) * 12 + month(o_orderdate) - 3 AS months FROM orders")(lambda t: t["orders"].select("o_orderkey", times.months_apart(F.col("o_orderdate"), F.lit("1995-03-31").cast("date")).cast("long").alias("months")))

query(
    "f13_date_window",
    """SELECT o_orderkey, strftime(o_orderdate, '%Y-%m') AS month, cast((cast(o_orderdate AS date) - interval 3 month) - interval 6 month AS date) AS window_from,
        cast(o_orderdate - interval 3 month AS date) AS window_to FROM orders""",
)(
    lambda t: t["orders"]
    .withColumn("w", times.window_start(F.col("o_orderdate").cast("date"), 6, 3))
    .select("o_orderkey", F.date_format("o_orderdate", "yyyy-MM").alias("month"), F.col("w.start").alias("window_from"), F.col("w.end").alias("window_to"))
)

query("f14_years_before", "SELECT o_orderkey, cast(cast(o_orderdate AS date) - interval 3 year AS date) AS day FROM orders")(lambda t: t["orders"].select("o_orderkey", times.years_before(F.col("o_orderdate").cast("date"), 3).alias("day")))

# Zones need an extension that DuckDB doesn't carry: checked by tests.
query("f15_zone_parts")(
    lambda t: t["events"].withColumn("own", F.from_utc_timestamp(F.col("ts").cast("timestamp"), "America/New_York")).select("event_id", F.dayofweek("own").alias("weekday"), F.hour("own").alias("hour"), F.to_date("own").alias("day"))
)

_PHONE = "CASE WHEN c_custkey % 3 = 0 THEN cast(5550000000 + c_custkey AS string) WHEN c_custkey % 3 = 1 THEN '+1 ' || cast(c_custkey AS string) ELSE cast(c_custkey AS string) END"
query(
    "f16_phone",
    f"SELECT c_custkey, CASE WHEN length(x) = 10 THEN '(' || x[1:3] || ') ' || x[4:6] || '-' || x[7:10] ELSE x END AS phone FROM (SELECT c_custkey, {_PHONE} AS x FROM customer)",
)(lambda t: t["customer"].select("c_custkey", strings.phone(F.expr(_PHONE)).alias("phone")))

query(
    "f17_address",
    "SELECT c_custkey, CASE WHEN c_custkey % 3 > 0 THEN 'Los Angeles' END AS city, CASE WHEN c_custkey % 3 > 0 THEN 'CA' END AS state, CASE WHEN c_custkey % 3 = 1 THEN '9' || lpad(cast(c_nationkey AS string), 4, '0') END AS zip, CASE WHEN c_custkey % 3 > 0 THEN 'United States' END AS country FROM customer",
)(
    lambda t: t["customer"]
    .withColumn(
        "a",
        strings.address(
            F.expr(
                "CASE c_custkey % 3 WHEN 1 THEN c_custkey || ' Main St, Los Angeles, CA' || coalesce(' 9' || lpad(cast(c_nationkey AS string), 4, '0'), '') || ', United States' WHEN 2 THEN '1 High Rd, Los Angeles, CA, United States' ELSE 'Los Angeles, CA' END"
            )
        ),
    )
    .select("c_custkey", "a.*")
)

_COUNTRIES = {"AUTOMOBILE": "Cars", "MACHINERY": "Machines"}
query("f18_mapped_code", "SELECT c_custkey, CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 'Cars' WHEN 'MACHINERY' THEN 'Machines' ELSE c_mktsegment END AS name FROM customer")(lambda t: t["customer"].select("c_custkey", strings.mapped(F.col("c_mktsegment"), _COUNTRIES).alias("name")))

query("f19_json_fields", "SELECT event_id, json_extract_string(props, '$.k') AS k, CAST(NULL AS string) AS other FROM events")(lambda t: t["events"].select("event_id", *records.fields(F.col("props"), {"k": "$.k", "other": "$.other.deep"})))

#: Pages and what is wrong with each.
_PAGES = [
    ("", "error", "No __NEXT_DATA__ found"),
    ("<p>Sign in to continue</p>", "auth_expired", "Redirected to login"),
    ("<p>Sign in</p> a Company <title>Page not found</title>", "not_found", "404"),
    ("<script>x</script>", "error", "No __NEXT_DATA__ found"),
    ("window.__NEXT_DATA__ = 1", "error", "Malformed __NEXT_DATA__ tag"),
    ('<script id="__NEXT_DATA__" type="x">{"props": 1}', "error", "Unclosed __NEXT_DATA__ script"),
    ('<script id="__NEXT_DATA__"> \n </script>', "error", "Empty __NEXT_DATA__ script"),
    ('<script id="__NEXT_DATA__">{"a": </script>', "error", "JSON parse error"),
    ('<script id="__NEXT_DATA__">{"props": {"pageProps": {"data": null}}}</script>', "error", "Missing company data in JSON"),
    ('<script id="__NEXT_DATA__">{"props": {"pageProps": {"data": {"company": "x"}}}}</script>', "error", "Missing company data in JSON"),
    ("<script type='x' id='__NEXT_DATA__'> {\"props\": {\"pageProps\": {\"data\": {\"company\": {\"id\": 7}}}}} </script>", "success", ""),
    ('<i>__NEXT_DATA__</i><script id="__NEXT_DATA__">{"props": {"pageProps": {"data": {"company": {"id": 7}}}}}</script>', "success", ""),
    ('<div data-id=__NEXT_DATA__>{"props": {"pageProps": {"data": {"company": {"id": 7}}}}}</script>', "success", ""),
]
_SAID = ", ".join(f"({k}, '{status}', '{message}')" for k, (_, status, message) in enumerate(_PAGES))
query("f20_payload", f"SELECT page_id, status, error_msg, CASE WHEN status = 'success' THEN '7' END AS id FROM pages JOIN (VALUES {_SAID}) v(k, status, error_msg) ON k = page_id % {len(_PAGES)}")(
    lambda t: t["pages"]
    .withColumn("p", records.payload(F.element_at(F.array(*(F.lit(p[0]) for p in _PAGES)), (F.col("page_id") % len(_PAGES) + 1).cast("int"))))
    .select("page_id", "p.status", "p.error_msg", F.get_json_object("p.json", "$.props.pageProps.data.company.id").alias("id"))
)

query(
    "f21_url_key",
    "SELECT DISTINCT 'https://' || lower(regexp_extract(url, '://([^/?#]*)', 1)) || regexp_replace(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '/*$', '/') AS url FROM pages",
)(lambda t: t["pages"].select(records.url_key(F.col("url")).alias("url")).distinct())

_WORDS = "len(regexp_extract_all({}, '[A-Za-z0-9'']+'))"
query(
    "f22_tokens",
    f"""SELECT doc_id, {_WORDS.format("text")} AS words, CASE WHEN trim(text) = '' THEN 0 ELSE len(regexp_extract_all(trim(text), '[.!?]\\s+[A-Z0-9"'']')) + 1 END AS sentences, len(string_split(text, chr(10))) AS lines FROM documents""",
)(
    lambda t: t["documents"].select(
        "doc_id", F.size(text.words(F.col("text"))).cast("long").alias("words"), F.size(text.sentences(F.col("text"))).cast("long").alias("sentences"), F.size(F.split("text", "\n")).cast("long").alias("lines")
    )
)

query(
    "f23_rates",
    f"""SELECT doc_id, round(CASE WHEN w > 0 THEN c * 1000 / w ELSE 0 END, 4) AS commas, round(CASE WHEN len(l) >= 3 THEN list_aggregate(l, 'stddev_pop') / list_avg(l) END, 4) AS spread
    FROM (SELECT doc_id, length(text) - length(replace(text, ',', '')) AS c, {_WORDS.format("text")} AS w, list_filter(list_transform(string_split(text, chr(10)), lambda x: {_WORDS.format("x")}), lambda n: n > 0) AS l FROM documents)""",
)(
    lambda t: t["documents"].select(
        "doc_id",
        F.round(text.per_thousand(F.length("text") - F.length(F.replace("text", F.lit(","), F.lit(""))), text.word_count(F.col("text"))), 4).alias("commas"),
        F.round(text.spread(F.filter(text.word_counts(F.split("text", "\n")), lambda n: n > 0)), 4).alias("spread"),
    )
)

_PHRASES = ["released under", "password="]
query(
    "f24_phrase_hits",
    r"""SELECT doc_id, line_no, phrase FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS line_no FROM documents),
        (VALUES ('released under', '(?i)\breleased under\b'), ('password=', '(?i)\bpassword=')) p(phrase, pattern) WHERE NOT starts_with(ltrim(line), '>') AND regexp_matches(line, pattern)""",
)(lambda t: text.phrase_hits(t["documents"], "doc_id", "text", _PHRASES).withColumn("line_no", F.col("line_no").cast("long")))

query("f25_scorable", "SELECT page_id, length(regexp_replace(html, '(?is)<!--\\s*ad.*', '')) AS n FROM pages")(lambda t: t["pages"].select("page_id", F.length(text.scorable(F.col("html"), "ad")).cast("long").alias("n")))

query("f26_formats", "SELECT o_orderkey, format('{:,}', o_orderkey * 1000) AS big, CASE WHEN o_orderkey % 2 = 0 THEN '—' ELSE format('{:.1f}%', cast(o_orderkey % 1000 AS double) / 10) END AS share FROM orders")(
    lambda t: t["orders"].select("o_orderkey", times.thousands(F.col("o_orderkey") * 1000).alias("big"), times.percent(F.when(F.col("o_orderkey") % 2 == 1, (F.col("o_orderkey") % 1000) / 1000.0)).alias("share"))
)

_LABEL = "CASE p_partkey % 4 WHEN 0 THEN 'INT | Q1 | ' || p_name WHEN 1 THEN 'test ' || p_name WHEN 2 THEN 'INT | ' ELSE p_name END"
query("f27_campaign_label", "SELECT p_partkey, CASE p_partkey % 4 WHEN 2 THEN 'Campaign' ELSE p_name END AS label FROM part")(
    lambda t: t["part"].select("p_partkey", strings.campaign_label(F.expr(_LABEL), ["INT", "Q1"], ["test"], "Campaign").alias("label"))
)

query("f28_inbox_class", "SELECT email, regexp_matches(email, '^user(1|22)') AS shared FROM contact_dim", ("contact_dim",))(lambda t: t["contact_dim"].select("email", strings.starts_with_any(F.col("email"), ["user1", "user22"]).alias("shared")))

# The greedy choice isn't SQL: checked by tests.
query("f29_spread_slots")(
    lambda t: t["events"].groupBy("user_id", F.to_date("ts").alias("day")).agg(F.array_sort(F.collect_list("ts")).alias("times")).select("user_id", "day", F.array_join(slots.spread(F.col("times")).cast("array<string>"), ",").alias("chosen"))
)

query(
    "f30_sections",
    "SELECT c_custkey, 'topics' AS header, c_mktsegment AS lines FROM customer UNION ALL SELECT c_custkey, 'summary', 'last,line' FROM customer",
)(
    lambda t: records.sections(t["customer"].select("c_custkey", F.array(F.lit("before"), F.lit("Summary"), "c_name", F.lit("Topics"), "c_mktsegment", F.lit("Summary"), F.lit("last"), F.lit("line")).alias("l")), "c_custkey", "l", ["Summary", "Topics"])
    .withColumn("lines", F.array_join("lines", ","))
)

_LINE = "CASE c_custkey % 4 WHEN 0 THEN 'Ann O''Neil-Day' WHEN 1 THEN 'Acme Labs 9' WHEN 2 THEN 'Austin, United States' ELSE 'Summary of topics' END"
query(
    "f31_line_kinds",
    "SELECT c_custkey, c_custkey % 4 = 2 AS place, c_custkey % 4 = 0 AS person, c_custkey % 4 = 1 AS organisation, cast(c_custkey AS string) AS booth, 'Head' AS title, 'Acme' AS company FROM customer",
)(
    lambda t: t["customer"]
    .withColumn("x", F.expr(_LINE))
    .withColumn("tc", jobs.title_and_company(F.array("x", F.lit("Head, Acme"))))
    .select(
        "c_custkey",
        jobs.is_location(F.col("x")).alias("place"),
        jobs.is_person(F.col("x")).alias("person"),
        jobs.is_organisation(F.col("x"), ["labs", "inc"]).alias("organisation"),
        jobs.booth(F.concat(F.lit("Find me at "), F.col("c_custkey").cast("string"), F.lit(" today"))).alias("booth"),
        "tc.*",
    )
)

query("f32_unused_lines", "SELECT snapshot_date, conv_id, array_to_string(list_filter(label_names, lambda x: x <> 'Other'), ',') AS rest FROM thread_snapshot", ("thread_snapshot",))(
    lambda t: t["thread_snapshot"].select("snapshot_date", "conv_id", F.array_join(records.unused(F.col("label_names"), F.array(F.lit("Other"))), ",").alias("rest"))
)

_ADDRESSES = [
    ("1 Main St, Austin, TX 78701; 2 Oak Rd, Reno, NV 89501", "1 Main St", "78701", "TX", "United States"),
    ("5 King St, Toronto, ON M5V 1J2", "5 King St", "M5V 1J2", "ON", "Canada"),
    ("9 Quay, Dublin, D02 AF30", "9 Quay", "D02 AF30", "", "Ireland"),
    ("3 Mill Ln, Leeds LS1 4AP", "3 Mill Ln", "LS1 4AP", "", "United Kingdom"),
    ("1-2-3 Ginza, Tokyo 104-0061", "1-2-3 Ginza", "104-0061", "", "Japan"),
    ("7 Bay Rd, Sydney NSW 2000, Australia", "7 Bay Rd", "2000", "NSW", "Australia"),
    ("4 Rue X, 75001 Paris, France", "4 Rue X", "75001", "", "France"),
    ("example.com/contact", "", "", "", ""),
    ("somewhere near the sea", "somewhere near the sea", "", "", ""),
]
query("f33_first_address", f"SELECT p_partkey, v.* EXCLUDE (k, raw) FROM part JOIN (VALUES {', '.join(str((k, *a)) for k, a in enumerate(_ADDRESSES))}) v(k, raw, line, postal, state, country) ON k = p_partkey % {len(_ADDRESSES)}")(
    lambda t: t["part"]
    .withColumn("a", jobs.first_address(F.element_at(F.array(*(F.lit(a[0]) for a in _ADDRESSES)), (F.col("p_partkey") % len(_ADDRESSES) + 1).cast("int"))))
    .select("p_partkey", "a.*")
)

query("f34_placeholders", "SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN '' WHEN 1 THEN p_name || ' x' ELSE '' END AS cell FROM part")(
    lambda t: t["part"].select("p_partkey", strings.placeholder_to_blank(F.expr("CASE p_partkey % 3 WHEN 0 THEN ' N/A ' WHEN 1 THEN '[' || p_name || '] |  x' END")).alias("cell"))
)

_PEOPLE = [("T. Orin Veldt", "T. Orin", "Veldt"), ("Halvor Quist Jr.", "Halvor", "Quist Jr."), ("Ysolde", "", "Ysolde"), ("Mira  Tolk", "Mira", "Tolk"), ("Per Ost III", "Per", "Ost III")]
query("f35_split_name", f"SELECT p_partkey, f AS first, l AS last FROM part JOIN (VALUES {', '.join(str((k, *p)) for k, p in enumerate(_PEOPLE))}) v(k, raw, f, l) ON k = p_partkey % {len(_PEOPLE)}")(
    lambda t: t["part"].withColumn("n", strings.split_name(F.element_at(F.array(*(F.lit(p[0]) for p in _PEOPLE)), (F.col("p_partkey") % len(_PEOPLE) + 1).cast("int")))).select("p_partkey", "n.*")
)

# Rule cascades ---------------------------------------------------------------

ARCHETYPE = RuleSet([Rule("fasteners", anywhere=["bolt", "screw"]), Rule("discs", anywhere=["washer"]), Rule("promoted", words=["promo"]), Rule("small", starts=["small"])], "general")
query("r01_archetype", "SELECT p_partkey, CASE WHEN p_name LIKE '%bolt%' OR p_name LIKE '%screw%' THEN 'fasteners' WHEN p_name LIKE '%washer%' THEN 'discs' WHEN p_type = 'PROMO' THEN 'promoted' WHEN p_name LIKE 'small%' THEN 'small' ELSE 'general' END AS archetype FROM part")(
    lambda t: t["part"].select("p_partkey", ARCHETYPE.on(F.concat_ws(" ", "p_name", "p_type")).alias("archetype"))
)

INDUSTRY = RuleSet([Rule(None, words=["household"]), Rule("transport", anywhere=["auto"]), Rule("plant", anywhere=["machin", "build"])])
query("r02_industry", "SELECT c_custkey, CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 'transport' WHEN 'MACHINERY' THEN 'plant' WHEN 'BUILDING' THEN 'plant' END AS industry FROM customer")(lambda t: t["customer"].select("c_custkey", INDUSTRY.on(F.col("c_mktsegment")).alias("industry")))

_HOUSE = "CASE c_custkey % 5 WHEN 0 THEN 'x@big.example' WHEN 1 THEN 'x@mail.example' WHEN 2 THEN 'x@autoshop.example' WHEN 3 THEN 'x@city.gov' ELSE 'x@other.example' END"
DOMAIN = RuleSet([Rule("override", exact=["big.example"]), Rule(None, exact=["mail.example"]), Rule("transport", anywhere=["auto"]), Rule("public", ends=[".gov", ".edu"])], "unsorted")
query("r03_domain_industry", "SELECT c_custkey, list_extract(['override', NULL, 'transport', 'public', 'unsorted'], cast(c_custkey % 5 + 1 AS int)) AS industry FROM customer")(
    lambda t: t["customer"].select("c_custkey", DOMAIN.on(strings.email_domain(F.expr(_HOUSE))).alias("industry"))
)

_TITLE = "CASE c_nationkey % 4 WHEN 0 THEN 'Head of Welding' WHEN 1 THEN 'Intro call' WHEN 2 THEN 'Sales Lead, Cars' ELSE 'Clerk' END"
TITLE = RuleSet([Rule(None, starts=["intro"]), Rule(("Engineering", "plant"), anywhere=["weld"]), Rule(("Sales", "transport"), pattern=r"\bsales\b.*\bcars\b")], ("Other", None), fields=("job_function", "industry"))
query(
    "r04_title_pair",
    "SELECT c_custkey, list_extract(['Engineering', NULL, 'Sales', 'Other'], cast(c_nationkey % 4 + 1 AS int)) AS job_function, list_extract(['plant', NULL, 'transport', NULL], cast(c_nationkey % 4 + 1 AS int)) AS industry FROM customer",
)(lambda t: t["customer"].withColumn("x", TITLE.on(F.expr(_TITLE))).select("c_custkey", "x.*"))

SUBJECT = RuleSet([Rule("billing", words=["priority", "urgent"]), Rule("support", pattern=r"^[45]-")])
query("r05_subject", "SELECT o_orderkey, CASE WHEN o_orderpriority LIKE '%URGENT%' THEN 'billing' WHEN o_orderpriority[1:2] IN ('4-', '5-') THEN 'support' END AS topic FROM orders")(lambda t: t["orders"].select("o_orderkey", SUBJECT.on(F.col("o_orderpriority")).alias("topic")))

query(
    "r06_source_cascade",
    "SELECT c_custkey, coalesce(CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 'transport' WHEN 'MACHINERY' THEN 'plant' WHEN 'BUILDING' THEN 'plant' END, list_extract(['override', NULL, 'transport', 'public', 'unsorted'], cast(c_custkey % 5 + 1 AS int))) AS industry FROM customer",
)(lambda t: t["customer"].select("c_custkey", cascade(INDUSTRY.on(F.col("c_mktsegment")), DOMAIN.on(strings.email_domain(F.expr(_HOUSE)))).alias("industry")))

_JUNK, _PROFILE = ["filters", "sort", "menu"], ["director", "attendee", "summary", "topics"]
_TEXTS = ["", "Menu Filters Sort", "Ann Lee\nDirector\nAttendee summary topics\nUnited States of somewhere far", "a line\nand another line here", "menu filters sort attendee", "tiny", "filters and sort of a director", "Director topics\nattendee in a hall with many people and a long text"]
_CAPTURED = "o_orderkey, o_custkey % 7 * 40 + 20 AS gray_mean, o_orderkey % 3 * 5 AS gray_stddev, o_custkey % 5 * 3 AS edge_mean, o_orderkey % 11 * 5 AS avg_conf"
_HOLDS = lambda words: " + ".join(f"contains(low, '{w}')::int" for w in words)
query(
    "r07_triage",
    f"""SELECT o_orderkey, CASE WHEN gray_mean >= 247 AND gray_stddev < 8 AND n < 20 THEN 'junk' WHEN n < 12 AND avg_conf < 25 THEN 'junk' WHEN list > 0 AND junk >= 2 AND prof = 0 THEN 'junk' WHEN junk >= 3 AND prof <= 1 THEN 'junk'
            WHEN strong >= 4 AND junk <= 1 THEN 'keep' WHEN weak >= 2 THEN 'review' ELSE 'junk' END AS bucket,
        CASE WHEN gray_mean >= 247 AND gray_stddev < 8 AND n < 20 THEN 'mostly_white_blank' WHEN n < 12 AND avg_conf < 25 THEN 'too_little_text' WHEN list > 0 AND junk >= 2 AND prof = 0 THEN 'clear_list_or_menu' WHEN junk >= 3 AND prof <= 1 THEN 'ui_heavy_text'
            WHEN strong >= 4 AND junk <= 1 THEN 'strong_profile_signals' WHEN weak >= 2 THEN 'ambiguous_or_partial_profile' ELSE 'low_signal' END AS reason
        FROM (SELECT *, (prof >= 3)::int + contains(low, 'united states')::int + (role > 0)::int + (n >= 60)::int + (rows >= 3)::int + (avg_conf >= 35)::int + (edge_mean >= 8)::int AS strong,
            (n >= 20)::int + (rows >= 2)::int + (prof >= 1)::int + (edge_mean >= 5)::int AS weak
        FROM (SELECT *, length(x) AS n, len(list_filter(string_split(x, chr(10)), lambda s: trim(s) <> '')) AS rows, {_HOLDS(_JUNK)} AS junk, {_HOLDS(_PROFILE)} AS prof,
            {_HOLDS(["all attendees", "filters", "sort", "search"])} AS list, {_HOLDS(["director", "manager", "chief", "vice president", "vp", "attendee", "representative"])} AS role
        FROM (SELECT {_CAPTURED}, x, lower(x) AS low FROM orders JOIN (VALUES {", ".join(f"({k}, '" + t.replace(chr(10), "' || chr(10) || '") + "')" for k, t in enumerate(_TEXTS))}) v(k, x) ON k = o_orderkey % {len(_TEXTS)})))""",
)(
    lambda t: jobs.triage(
        t.spark.sql(f"SELECT {_CAPTURED} FROM {{orders}}", orders=t["orders"]).withColumn("raw_text", F.element_at(F.array(*(F.lit(x) for x in _TEXTS)), (F.col("o_orderkey") % len(_TEXTS) + 1).cast("int"))),
        _JUNK,
        _PROFILE,
    ).select("o_orderkey", "bucket", "reason")
)

query("r08_signal_counts", "SELECT doc_id, contains(lower(text), 'released')::int + contains(lower(text), 'password')::int + contains(lower(text), 'token')::int AS n FROM documents")(lambda t: t["documents"].select("doc_id", hits(F.col("text"), ["released", "Password", "token"]).alias("n")))

_CAMPAIGN = """o_orderkey, CASE WHEN o_orderstatus = 'O' THEN 'paused' ELSE 'Active' END AS status, o_custkey % 5 * 1000 AS lead_count, o_custkey % 7 * 500 AS completed, o_custkey % 9 * 300 AS contacted,
    o_custkey % 11 AS replied, o_custkey % 4 AS positive, o_custkey % 3 AS away, o_custkey % 6 AS lead_total"""
query(
    "r09_underperformers",
    f"""SELECT o_orderkey, split_part(v, ':', 1) AS decision, split_part(v, ':', 2) AS reason, split_part(v, ':', 1) <> 'skip' AS checked FROM (SELECT o_orderkey, CASE WHEN upper(status) <> 'ACTIVE' THEN 'skip:inactive'
        WHEN lead_count > 0 AND greatest(completed, contacted) >= lead_count THEN 'skip:complete' WHEN lead_total > 0 AND away * 100 / lead_total > 20 THEN 'skip:away' WHEN positive > 0 THEN 'ok:positive'
        WHEN contacted >= 2000 THEN 'pause:no positive' WHEN contacted >= 500 AND replied * 100 / contacted < 0.5 THEN 'pause:low rate' ELSE 'ok:rate' END AS v FROM (SELECT {_CAMPAIGN} FROM orders))""",
)(lambda t: monitors.decide(t.spark.sql(f"SELECT {_CAMPAIGN} FROM {{orders}}", orders=t["orders"])).select("o_orderkey", "decision", "reason", "checked"))

_CARD = "CASE c_custkey % 5 WHEN 0 THEN 'Exhibitor summary' WHEN 1 THEN 'Contributor at the fair' WHEN 2 THEN 'An attendee' WHEN 3 THEN 'Exhibitor' ELSE 'plain' END"
query(
    "r10_record_kind",
    """SELECT c_custkey, list_extract(['exhibitor', 'contributor', 'attendee', 'exhibitor', 'unknown'], cast(c_custkey % 5 + 1 AS int)) AS subtype,
        list_extract(['company', 'person', 'person', 'company', 'company'], cast(c_custkey % 5 + 1 AS int)) AS kind FROM customer""",
)(lambda t: t["customer"].select("c_custkey", jobs.SUBTYPE.on(F.expr(_CARD)).alias("subtype"), jobs.record_kind(F.lit("Acme Labs 9"), F.expr(_CARD), ["labs"]).alias("kind")))

query(
    "r11_detector_gate",
    "SELECT user_id, CASE WHEN count(*) FILTER (event_type = 'view') = 0 THEN 2 WHEN max(value + CASE WHEN event_id % 3 = 0 THEN value / 2 ELSE 0 END) FILTER (event_type = 'view') > 60 THEN 1 ELSE 0 END AS code FROM events GROUP BY 1",
)(
    lambda t: t["events"]
    .withColumn("assisted", F.when(F.col("event_id") % 3 == 0, F.col("value") / 2))
    .groupBy("user_id")
    .agg(A.count_if(F.col("event_type") == "view").alias("asked"), F.max(F.when(F.col("event_type") == "view", monitors.machine_share("value", "assisted"))).alias("most"))
    .select("user_id", F.when(F.col("asked") == 0, 2).when(F.col("most") > 60, 1).otherwise(0).alias("code"))
)

_RECORD = """SELECT c_custkey, CASE WHEN c_custkey % 5 = 0 THEN 'Company' ELSE 'person' END AS record_kind, CASE WHEN c_custkey % 5 IN (1, 2) THEN 'Ann ' || c_nationkey END AS name,
    CASE WHEN c_custkey % 5 IN (0, 1) THEN c_mktsegment || '!' END AS company, CASE WHEN c_custkey % 5 = 2 THEN 'Paris' END AS location, '' AS booth, CASE WHEN c_custkey % 5 = 3 THEN 'Raw  text' END AS raw_text, c_name AS source FROM {customer}"""
query(
    "r12_dedupe_key",
    """SELECT c_custkey, CASE c_custkey % 5 WHEN 0 THEN 'company|' || lower(c_mktsegment) || '||' WHEN 1 THEN 'person|ann ' || c_nationkey || '|' || lower(c_mktsegment) WHEN 2 THEN 'person|ann ' || c_nationkey || '|paris'
        WHEN 3 THEN 'raw|raw text' ELSE 'source|' || c_name END AS key FROM customer""",
)(lambda t: t.spark.sql(_RECORD, customer=t["customer"]).select("c_custkey", jobs.dedupe_key().alias("key")))

_LISTED = """SELECT o_custkey AS project, o_orderkey AS pos, 'Co ' || o_orderkey AS company, CASE o_orderkey % 6 WHEN 0 THEN 'studio_or_network' WHEN 1 THEN 'agency_or_management' WHEN 2 THEN 'odd' WHEN 3 THEN 'sales_or_finance_company'
    WHEN 4 THEN CASE WHEN o_custkey % 3 = 0 THEN 'production_company' END ELSE 'unknown' END AS company_type, CASE WHEN o_orderkey % 5 = 0 THEN 'primary_listing_entity' ELSE 'other' END AS relation FROM {orders}"""
_RANKED = "list_position(['production_company', 'project_specific_entity_or_spv', 'sales_or_finance_company', 'studio_or_network', 'agency_or_management'], company_type)"
query(
    "r13_company_fallback",
    f"""SELECT project, pos, company FROM ({_LISTED.format(orders="orders")}) QUALIFY company_type IS NOT DISTINCT FROM 'production_company'
        OR row_number() OVER (PARTITION BY project ORDER BY coalesce({_RANKED}, 6), relation <> 'primary_listing_entity', pos) = 1""",
)(lambda t: jobs.project_companies(t.spark.sql(_LISTED, orders=t["orders"])).select("project", "pos", "company"))

query(
    "r14_producer_company",
    """SELECT c_custkey AS project, 'Ann Lee' AS person, CASE c_custkey % 4 WHEN 0 THEN 'B' WHEN 1 THEN 'C' WHEN 2 THEN 'A' ELSE '' END AS company, CASE WHEN c_custkey % 4 = 0 THEN 'alee@b.example' ELSE '' END AS email_1, '' AS email_2 FROM customer""",
)(
    lambda t: jobs.producer_companies(
        t["customer"].select(F.col("c_custkey").alias("project"), F.lit("Ann Lee").alias("person")),
        t.spark.sql(
            """SELECT c_custkey AS project, pos, company, CASE WHEN c_custkey % 4 = 2 OR company = 'A' THEN 'unknown' ELSE 'production_company' END AS company_type,
            CASE WHEN company = 'C' THEN 'primary_listing_entity' END AS relation, CASE WHEN company = 'B' AND c_custkey % 4 = 0 THEN array('info@b.example', 'alee@b.example') WHEN company = 'C' THEN array('office@c.example') END AS emails
            FROM {customer}, (VALUES (1, 'A'), (2, 'B'), (3, 'C')) v(pos, company) WHERE c_custkey % 4 < 3""",
            customer=t["customer"],
        ),
    )
)

# Zones again: checked by tests.
query("r15_availability")(
    lambda t: slots.availability(t["events"], "user_id", "ts", F.lit("America/New_York"), F.lit("Europe/Berlin"), F.lit(9), F.lit(17)).withColumn("times", F.array_join(F.col("times").cast("array<string>"), ","))
)

query(
    "r16_fresh_articles",
    """SELECT user_id AS client, event_type AS url, min(event_id) AS ord FROM events WHERE event_id % 10 <> 0 AND cast(ts AS date) >= date '2024-01-23' GROUP BY ALL""",
)(
    lambda t: jobs.fresh_articles(
        t["events"].select(F.col("user_id").alias("client"), F.col("event_type").alias("url"), F.col("event_id").alias("ord"), F.when(F.col("event_id") % 10 == 0, F.lit("soon")).otherwise(F.date_format("ts", "yyyy-MM-dd")).alias("published")),
        F.lit("2024-01-30").cast("date"),
        F.lit("2024-01-20").cast("date"),
    ).select("client", "url", "ord")
)

# The filings refinery ------------------------------------------------------------

_FILINGS = """SELECT l_orderkey * 10 + l_linenumber AS ord, CASE WHEN l_suppkey % 7 = 0 THEN '' ELSE 'Maker ' || l_suppkey % 40 || CASE WHEN l_linenumber % 2 = 0 THEN ', Inc.' ELSE ' LLC' END END AS applicant,
    CASE WHEN l_linenumber > 2 THEN 'Device ' || l_partkey % 5 END AS device, CASE l_returnflag WHEN 'R' THEN 'DENG' WHEN 'A' THEN 'sese' ELSE 'SESK' END AS decision_code,
    {day} AS decided, 'P' || l_partkey % 9 AS product_code, CASE l_partkey % 6 WHEN 0 THEN 'US' WHEN 1 THEN ' de' WHEN 2 THEN 'FR ' WHEN 3 THEN ' ' WHEN 4 THEN 'DE' END AS country, '86' || l_partkey % 10 || '.' || l_suppkey % 4 AS regulation FROM {lineitem}"""
_SCOPE, _VETO = [("862", "chemistry"), ("864", "blood"), ("864.1", "stains"), ("868", "air")], [("862.3",), ("868.0",)]
_SPARK_DAY = "CASE WHEN l_orderkey % 2 = 0 THEN date_format(l_shipdate, 'yyyyMMdd') ELSE date_format(l_shipdate, 'yyyy-MM-dd') END"
query(
    "a10_companies",
    f"""SELECT key, company, filings, codes, categories, last_filing, sample_device, country, lifetime FROM (
        SELECT key, arg_min(applicant, ord) AS company, count(*) AS filings, count(DISTINCT product_code) AS codes, string_agg(DISTINCT category, ' | ' ORDER BY category) AS categories, max(decided) AS last_filing, arg_min(device, ord) AS sample_device
        FROM scoped GROUP BY key)
        JOIN (SELECT key, place AS country FROM (SELECT *, coalesce(nullif(upper(trim(country)), ''), 'US') AS place FROM scoped) GROUP BY key, place QUALIFY row_number() OVER (PARTITION BY key ORDER BY count(*) DESC, min(ord)) = 1) USING (key)
        JOIN (SELECT key, count(*) AS lifetime FROM cleared GROUP BY 1) USING (key) WHERE last_filing >= date '2001-06-01'""",
    ctes=f"""cleared AS (SELECT *, 'maker ' || split_part(split_part(replace(applicant, ',', ''), ' ', 2), ' ', 1) AS key FROM ({_FILINGS.format(day="cast(l_shipdate AS date)", lineitem="lineitem")}) WHERE upper(decision_code) LIKE 'SE%' AND applicant <> ''),
        scoped AS (SELECT *, CASE WHEN regulation LIKE '862%' THEN 'chemistry' WHEN regulation LIKE '864.1%' THEN 'stains' WHEN regulation LIKE '864%' THEN 'blood' ELSE 'air' END AS category FROM cleared
            WHERE regulation[1:3] IN ('862', '864', '868') AND regulation NOT IN ('862.3', '868.0'))""",
)(
    lambda t: jobs.companies(
        t.spark.sql(_FILINGS.replace("{day}", _SPARK_DAY), lineitem=t["lineitem"]), t.spark.createDataFrame(_SCOPE, "prefix string, label string"), t.spark.createDataFrame(_VETO, "prefix string"), F.lit("2001-06-01").cast("date")
    ).select("key", "company", "filings", "codes", "categories", "last_filing", "sample_device", "country", "lifetime")
)

query("a11_lifetime_joined", "SELECT o_orderkey, n AS lifetime FROM orders JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) USING (o_custkey) WHERE o_orderstatus = 'P'")(
    lambda t: t["orders"].filter("o_orderstatus = 'P'").join(t["orders"].groupBy("o_custkey").agg(F.count(F.lit(1)).alias("lifetime")), "o_custkey").select("o_orderkey", "lifetime")
)

# Wrapped JSON -----------------------------------------------------------------------

_JSON = """CASE o_orderkey % 6 WHEN 0 THEN '{{"results": [{{"id": ' || cast(o_orderkey AS string) || '}}, {{"id": -1}}]}}' WHEN 1 THEN '[{{"id": ' || cast(o_orderkey AS string) || '}}]' WHEN 2 THEN '{{"data": [{{"id": ' || cast(o_orderkey AS string) || '}}]}}'
    WHEN 3 THEN '{{"id": ' || cast(o_orderkey AS string) || '}}' WHEN 4 THEN '{{"id": ' ELSE '' END""".replace("{{", "{").replace("}}", "}")
_IDS = "SELECT o_orderkey, o_orderkey AS id FROM orders WHERE o_orderkey % 6 < 4 UNION ALL SELECT o_orderkey, -1 FROM orders WHERE o_orderkey % 6 = 0"
query("s06_bulk_json", _IDS)(lambda t: t["orders"].select("o_orderkey", F.explode(records.wrapped(F.expr(_JSON), "struct<id:bigint>")).alias("r")).select("o_orderkey", "r.id"))
query("s07_wrapped_json", _IDS)(lambda t: t["orders"].select("o_orderkey", F.posexplode(records.wrapped(F.expr(_JSON), "struct<id:bigint>", ("results", "data", "records"))).alias("at", "r")).select("o_orderkey", "r.id"))

# Small operators ------------------------------------------------------------------------

query("n01_not_equal", "SELECT deal_id FROM deal_dim WHERE attributed_rep <> 'NATION_1'", ("deal_dim",))(lambda t: t["deal_dim"].filter(F.col("attributed_rep") != "NATION_1").select("deal_id"))
query("n02_one_element", "SELECT r_regionkey, array_to_string([r_name], ',') AS names FROM region")(lambda t: t["region"].select("r_regionkey", F.array_join(F.array("r_name"), ",").alias("names")))
query("n03_drop_offs", "SELECT count(*) - count(DISTINCT o_custkey) AS repeat_orders FROM orders")(lambda t: t["orders"].agg((F.count(F.lit(1)) - F.count_distinct("o_custkey")).alias("repeat_orders")))
query("n04_oldest_day", "SELECT user_id, least(min(cast(ts AS date)) FILTER (event_id % 10 <> 0), date '2024-01-12') AS oldest FROM events GROUP BY 1")(
    lambda t: t["events"]
    .withColumn("raw", F.when(F.col("event_id") % 10 == 0, "n/a").otherwise(F.date_format("ts", "yyyy-MM-dd")))
    .groupBy("user_id")
    .agg(monitors.oldest_day(F.col("raw"), F.lit("2024-01-12").cast("date")).alias("oldest"))
)
query("n05_numbers", "SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN cast(o_custkey AS double) ELSE 0 END AS n FROM orders")(
    lambda t: t["orders"].select("o_orderkey", times.number(F.expr("CASE o_orderkey % 3 WHEN 0 THEN cast(o_custkey AS string) WHEN 1 THEN 'x' END")).alias("n"))
)
query("n06_defaults", "SELECT deal_id, coalesce(attributed_rep, '(unnamed)') AS rep, coalesce(attributed_campaign, '') AS campaign FROM deal_dim", ("deal_dim",))(
    lambda t: t["deal_dim"].select("deal_id", F.coalesce("attributed_rep", F.lit("(unnamed)")).alias("rep"), F.coalesce("attributed_campaign", F.lit("")).alias("campaign"))
)
query("n06_names", "SELECT c_custkey, coalesce(n_name, cast(c_nationkey AS string)) AS nation FROM customer LEFT JOIN (SELECT n_nationkey AS c_nationkey, n_name FROM nation WHERE n_nationkey < 12) USING (c_nationkey)")(
    lambda t: joins.lookup(t["customer"].select("c_custkey", "c_nationkey"), t["nation"].filter("n_nationkey < 12").select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_name").alias("nation")), "c_nationkey", "nation", F.col("c_nationkey").cast("string")).select("c_custkey", "nation")
)
query("n07_clean_lines", "SELECT c_custkey, c_name || '|' || c_mktsegment || chr(39) || '|a b' || chr(39) AS lines FROM customer")(
    lambda t: t["customer"].select("c_custkey", F.array_join(records.clean_lines(F.array(F.concat(F.lit("** "), "c_name", F.lit(" ,")), F.lit(" - "), F.concat(F.lit("'"), "c_mktsegment", F.lit("'.")), F.lit("\ta \t b'-."))), "|").alias("lines"))
)
query("n08_noise", "SELECT c_custkey, c_mktsegment IN ('BUILDING', 'FURNITURE') OR c_name LIKE '%7' AS noise FROM customer")(
    lambda t: t["customer"].select("c_custkey", (records.is_noise(F.col("c_mktsegment"), ["building"], ["^furn"]) | records.is_noise(F.col("c_name"), [""], ["7$"])).alias("noise"))
)
query("n09_row_per_email", "SELECT c_custkey, unnest(CASE WHEN c_custkey % 2 = 0 THEN ['a@x', 'b@x'] ELSE [''] END) AS emails FROM customer")(
    lambda t: records.per_email(t["customer"].select("c_custkey", F.when(F.col("c_custkey") % 2 == 0, "a@x, b@x,").otherwise(F.lit(None).cast("string")).alias("emails")), "emails")
)
query("n10_to_columns", "SELECT snapshot_date, conv_id, label_names[1] AS label_1, label_names[2] AS label_2 FROM thread_snapshot", ("thread_snapshot",))(
    lambda t: t["thread_snapshot"].select("snapshot_date", "conv_id", *records.to_columns(F.col("label_names"), 2, "label"))
)
query("n11_coerced", "SELECT p_partkey, CASE WHEN p_type IN ('PROMO', 'SMALL') THEN p_type ELSE 'unknown' END AS type FROM part")(lambda t: t["part"].select("p_partkey", strings.coerced(F.col("p_type"), ["PROMO", "SMALL"]).alias("type")))
query("n12_validation", "SELECT p_partkey FROM part WHERE p_type NOT IN ('PROMO', 'SMALL', 'LARGE', 'MEDIUM', 'ECONOMY') OR p_size <= 0")(lambda t: t["part"].filter(~F.col("p_type").isin("PROMO", "SMALL", "LARGE", "MEDIUM", "ECONOMY") | (F.col("p_size") <= 0)).select("p_partkey"))
query("n13_distinct_rows", "SELECT DISTINCT p_brand, p_type FROM part")(lambda t: t["part"].select("p_brand", "p_type").dropDuplicates())
query("n14_producers", "SELECT p_partkey, unnest(CASE p_partkey % 3 WHEN 0 THEN ['Ann Lee', 'Bo Dey Jr'] WHEN 1 THEN ['Cy Dow', 'Ed Fox'] ELSE ['Gil'] END) AS person FROM part")(
    lambda t: t["part"].select("p_partkey", F.explode(jobs.producers(F.expr("CASE p_partkey % 3 WHEN 0 THEN 'Ann Lee - Bo Dey, Jr' WHEN 1 THEN 'Cy Dow (cy@x.example), Ed Fox' ELSE 'Gil' END"))).alias("person"))
)
query("n15_fan_out", "SELECT r_name, unnest(['news', 'deals']) AS angle FROM region")(lambda t: t["region"].select("r_name", F.explode(F.array(F.lit("news"), F.lit("deals"))).alias("angle")))
query("n16_arguments", "SELECT user_id, split_part(x, ' ', 1) AS name, coalesce(nullif(split_part(x, ' ', 2), ''), 'est') AS zone, CASE WHEN user_id % 3 = 2 THEN least(user_id, 60) ELSE 1 END AS days FROM (SELECT DISTINCT user_id, CASE user_id % 3 WHEN 0 THEN 'ann' WHEN 1 THEN 'bo pst' ELSE 'cy pst ' || user_id END AS x FROM events)")(
    lambda t: t["events"]
    .select("user_id")
    .distinct()
    .withColumn("a", strings.arguments(F.expr("CASE user_id % 3 WHEN 0 THEN ' Ann' WHEN 1 THEN 'bo  PST ' ELSE 'cy pst ' || user_id END"), "est", 1, 60))
    .select("user_id", "a.*")
)
query("n17_horizon", "SELECT event_id FROM events WHERE ts < timestamp '2024-01-10' + to_days(CASE WHEN user_id % 2 = 0 THEN 14 ELSE 7 END) AND ts >= timestamp '2024-01-10'")(
    lambda t: t["events"]
    .filter((F.col("ts") >= F.lit("2024-01-10").cast("timestamp_ntz")) & (F.datediff("ts", F.lit("2024-01-10").cast("date")) < F.when(F.col("user_id") % 2 == 0, 14).otherwise(7)))
    .select("event_id")
)
query("n18_status_counts", "SELECT o_orderstatus AS status, count(*) AS n FROM orders GROUP BY 1")(lambda t: t["orders"].groupBy(F.col("o_orderstatus").alias("status")).agg(F.count(F.lit(1)).alias("n")))
query("n19_clean_text", "SELECT p_partkey, '\"' || p_name || ' ' || chr(10) || p_type || '{}' || chr(10) || 'x y' AS text FROM part")(
    lambda t: t["part"].select("p_partkey", strings.clean_text(F.concat(F.lit(" \t\""), "p_name", F.lit("\f\n\n\n[“"), "p_type", F.lit("”]{}\n(x_ \t©@y»)\n "))).alias("text"))
)
query("n20_json_summary", """SELECT o_orderstatus, '{"n":' || count(*) || ',"first":' || min(o_orderkey) || '}' AS summary FROM orders GROUP BY 1""")(
    lambda t: t["orders"].groupBy("o_orderstatus").agg(F.to_json(F.struct(F.count(F.lit(1)).alias("n"), F.min("o_orderkey").alias("first"))).alias("summary"))
)
query("n21_verdict", "SELECT event_id, value <= 20 AS ok FROM events")(lambda t: t["events"].select("event_id", (F.col("value") <= 20).alias("ok")))
query("n22_outcomes", "SELECT * FROM (VALUES ('table', 'data', (SELECT count(*) FROM region)), ('absent', 'missing', NULL), ('broken', 'error', NULL)) v(source, kind, rows)")(
    lambda t: monitors.outcomes(t.spark, {"table": lambda: t["region"], "absent": lambda: t.spark.table("no_such_table"), "broken": lambda: t["region"].select("no_such_column")})
)
query("n23_report_order", "SELECT c_mktsegment, count(*) AS n FROM customer GROUP BY 1")(lambda t: t["customer"].groupBy("c_mktsegment").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "c_mktsegment"))
query("e03_sheet_edits", "SELECT event_id AS row, event_type AS name, cast(ts AS date) AS date FROM events WHERE event_id > 1 AND event_id % 7 = 3 AND event_type IN ('error', 'signup')")(
    lambda t: monitors.edits(
        t["events"].select(
            F.lit("Calls").alias("sheet"), F.col("event_id").alias("row"), (F.col("event_id") % 7).cast("int").alias("col"), F.when(F.col("event_type").isin("error", "signup"), " No show ").otherwise("Show").alias("value"),
            F.col("event_type").alias("name"), F.lit("").alias("email"), F.lit("").alias("domain"), F.col("ts").cast("date").alias("date"),
        ),
        "Calls", 3, 1, "No show",
    ).select("row", "name", "date")
)

# Files and streams --------------------------------------------------------------------


def _pages(t):
    return t["pages"].select(F.concat(F.lit("see "), F.col("page_id").cast("string")).alias("note"), F.col("url").alias("Website URL"))


query("s08_url_column", "SELECT url FROM pages WHERE contains(lower(url), 'example.com')")(lambda t: files.url_column(_pages(t), "example.com"))


@query("s09_csv_sink", "SELECT cast(o_orderkey AS string) AS o_orderkey, o_orderstatus, '' AS missing FROM orders")
def s09(t):
    path = files.scratch(t.spark, "csv")
    files.write_csv(t["orders"], path, ["o_orderkey", "o_orderstatus", "missing"])
    return files.read_csv(t.spark, path, ["o_orderkey", "o_orderstatus", "missing"])


@query("s10_bucket_sink", "SELECT o_orderkey, o_orderstatus AS bucket FROM orders")
def s10(t):
    path = files.scratch(t.spark, "buckets")
    files.write_buckets(t["orders"].select("o_orderkey", F.col("o_orderstatus").alias("bucket")), path, "bucket")
    return files.read_buckets(t.spark, path, "o_orderkey long, bucket string")


@query("e01_first_seen", "SELECT max(ts) AS ts, count(*) AS ids FROM (SELECT user_id, min(ts) AS ts FROM events GROUP BY 1)")
def e01(t):
    """The stream over a folder of events: each user once, whatever the batches are."""
    base, path = files.scratch(t.spark, "seen"), files.scratch(t.spark, "events")
    rows = t["events"].groupBy("user_id").agg(F.min("ts").alias("ts")).unionByName(t["events"].select("user_id", "ts")).withColumn("ord", F.unix_micros(F.col("ts").cast("timestamp")))
    rows.write.parquet(path)
    stream = t.spark.readStream.schema(rows.schema).parquet(path)
    launches.announce_new(stream, "user_id", "ord", f"{base}/seen", f"{base}/out", f"{base}/check").start().awaitTermination()
    return t.spark.read.parquet(f"{base}/seen").agg(F.max("ts").alias("ts"), F.count(F.lit(1)).alias("ids"))


@query("e04_log_and_truth", "SELECT user_id, max(event_id) AS event_id FROM events GROUP BY 1")
def e04(t):
    base, path = files.scratch(t.spark, "log"), files.scratch(t.spark, "events")
    t["events"].select("user_id", "event_id").write.parquet(path)
    stream = t.spark.readStream.schema("user_id long, event_id long").parquet(path)
    launches.append_log(stream, f"{base}/log", f"{base}/check").start().awaitTermination()
    return launches.compacted(t.spark.read.parquet(f"{base}/log"), ["user_id"], "event_id")


def _down():
    raise PySparkException("the source is down")


query("e02_surviving_sources", "SELECT 'events' AS source, count(*) AS n FROM events UNION ALL SELECT 'orders', count(*) FROM orders")(
    lambda t: monitors.survivors({"events": lambda: t["events"].select(F.col("event_id").alias("id")), "gone": _down, "orders": lambda: t["orders"].select(F.col("o_orderkey").alias("id"))})[0]
    .groupBy("source")
    .agg(F.count(F.lit(1)).alias("n"))
)
