"""Functions and record jobs on hand-made rows."""

import datetime
import random
import zoneinfo

import pytest
from pyspark.sql import functions as F

from tidewright.functions import records, strings, text, times
from tidewright.operators import joins, monitors, names, rules, slots
from tidewright.plans import jobs
from tidewright.sources import files
from tidewright.streaming import cadence, launches


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("raw", "key"),
    [("Acme Medical, Inc.", "acme medical"), ("ACME MEDICAL INC", "acme medical"), ("Acme S.A. Labs", "acme labs"), ("Acme ApS", "acme"), ("Acme  aps", "acme aps"), ("apsis Co", "apsis"), ("", ""), (None, "")],
)
def test_company_key(spark, raw, key):
    assert one(spark, strings.company_key(F.lit(raw).cast("string"))) == key


@pytest.mark.parametrize(("raw", "day"), [("20240131", "2024-01-31"), ("2024-01-31", "2024-01-31"), ("", None), ("soon", None), ("20240230", None), (None, None)])
def test_parsed_date(spark, raw, day):
    assert one(spark, times.parsed_date(F.lit(raw).cast("string")).cast("string")) == day


def test_leap_day_is_clamped(spark):
    assert str(one(spark, times.years_before(F.lit("2024-02-29").cast("date"), 1))) == "2023-02-28"


@pytest.mark.parametrize(("raw", "out"), [("0", "1970-01-01T00:00:00+00:00"), ("", None), (None, None), ("2024-01-01T00:00:00Z", "2024-01-01T00:00:00Z")])
def test_iso_time(spark, raw, out):
    assert one(spark, times.iso_time(F.lit(raw).cast("string"))) == out


def test_sentences_and_spread(spark):
    t = "One two three. Four five! Six? seven 8. 9 ten"
    assert one(spark, text.sentences(F.lit(t))) == ["One two three.", "Four five!", "Six? seven 8.", "9 ten"]
    assert one(spark, text.spread(F.array(F.lit(1.0), F.lit(2.0)))) is None
    assert abs(one(spark, text.spread(F.array(F.lit(1.0), F.lit(2.0), F.lit(3.0)))) - (2 / 3) ** 0.5 / 2) < 1e-9
    assert one(spark, text.per_thousand(F.lit(3), F.lit(0))) == 0


def test_phrases_skip_quoted_lines_and_respect_words(spark):
    df = spark.createDataFrame([(1, "a big deal\n> a big deal\nBig deals\nbig deal!")], "k int, t string")
    assert [(r["line_no"], r["phrase"]) for r in text.phrase_hits(df, "k", "t", ["big deal"]).orderBy("line_no").collect()] == [(1, "big deal"), (4, "big deal")]


def test_end_marker(spark):
    assert one(spark, text.scorable(F.lit("keep <!-- score_end --> drop"))) == "keep "


def test_record_files_of_three_shapes(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"data": [{"id": 1}, 5, {"id": 2}]}')
    (tmp_path / "b.jsonl").write_text('{"id": 3}\n\n{"id": \n[{"id": 4}]\n')
    (tmp_path / "c.json").write_text('[{"id": 5}]')
    got = records.read_records(spark, str(tmp_path), "struct<id:bigint>").select("record.id").collect()
    assert sorted(r["id"] for r in got if r["id"] is not None) == [1, 2, 3, 4, 5]


def test_flat_people(spark):
    df = spark.createDataFrame([([("Ann", None, "Acme"), ("", "", "")], None, ["a", "", None, "b"])], "p array<struct<name:string,title:string,company:string>>, q array<string>, r array<string>")
    assert tuple(records.flattened(df, ["p", "q", "r", "s"]).first()) == ("Ann - Acme", "", "a; b", "")


def test_missing_field_voids_nothing_else(spark):
    df = spark.createDataFrame([('{"a": {"b": 1}, "c": null}',), ("{",)], "j string")
    assert [tuple(r) for r in df.select(*records.fields(F.col("j"), {"b": "$.a.b", "c": "$.c.d"})).collect()] == [("1", None), (None, None)]


def test_rows_per_email_lose_nothing(spark):
    df = spark.createDataFrame([("x", "a@x, ,b@x"), ("y", None), (None, ""), ("", " ")], "n string, e string")
    assert sorted((r["n"] or "", r["e"]) for r in records.per_email(df, "e").collect()) == [("x", "a@x"), ("x", "b@x"), ("y", "")]


def test_sections_restart_on_a_repeated_header(spark):
    df = spark.createDataFrame([(1, ["x", "Topics", "a", "Summary", "b", "topics", "c", "d", "Empty"])], "k int, l array<string>")
    got = {r["header"]: r["lines"] for r in records.sections(df, "k", "l", ["Topics", "Summary", "Empty"]).collect()}
    assert got == {"topics": ["c", "d"], "summary": ["b"], "empty": []}


def test_names_never_merge_when_ambiguous(spark):
    roster = spark.createDataFrame([("Ann Lee",), ("Anna Lee",), ("Bob Roy",)], "n string")
    df = spark.createDataFrame([("Ann Lee",), ("Ana Lee",), ("bob",), ("Bobby Roy",), ("Rob Roy",), ("",), (None,)], "x string")
    got = {r["x"]: r["canonical"] for r in names.canonicalise(df, "x", roster, "n").collect()}
    assert got == {"Ann Lee": "Ann Lee", "Ana Lee": "Ana Lee", "bob": "Bob Roy", "Bobby Roy": "Bob Roy", "Rob Roy": "Bob Roy", "": "", None: None}


def test_alias_join_equals_a_disjunction(spark):
    draw = random.Random(3)
    reps = [(f"R{i}", f"r{i}@firm") for i in range(6)]
    rows = [(i, draw.choice(["r1@firm", "R2@home", "x@y", "", None, "r3@firm"]), draw.choice(["R4 Smith", "nick Doe", "", None, "r1"])) for i in range(400)]
    signed, table = spark.createDataFrame(rows, "i int, e string, n string"), spark.createDataFrame(reps, "k string, m string")
    got = {(r["i"], r["k"]) for r in joins.match_alias(signed, "e", "n", joins.alias_table(table, "k", "m", {"nick": "R5"})).collect()}
    want = set()
    for i, e, n in rows:
        first, local = (n or "").split(" ")[0].lower(), (e or "").split("@")[0].lower() if e is not None else None
        want |= {(i, k) for k, m in reps if (e or "").lower() == m or first == k.lower() or local == k.lower() or (k == "R5" and first == "nick")}
    assert got == want


def test_prefixes(spark):
    df = spark.createDataFrame([("862.15",), ("862.9",), ("862.3",), ("900",), ("",), (None,)], "c string")
    got = joins.longest_prefix(df, "c", spark.createDataFrame([("862", "a"), ("862.1", "b")], "prefix string, label string"), spark.createDataFrame([("862.3",)], "prefix string"))
    assert {r["c"]: r["label"] for r in got.collect()} == {"862.15": "b", "862.9": "a", "862.3": None, "900": None, "": None, None: None}


def greedy(pool, count, gap):
    clean = [t for t in pool if t.minute in (0, 30)] or pool
    if len(clean) <= count:
        return clean
    out = [clean[0]]
    for t in clean[1:]:
        if len(out) < count and (t - out[-1]).total_seconds() >= gap * 60:
            out.append(t)
    return out


def test_spread_slots_like_the_greedy_loop(spark):
    draw = random.Random(5)
    rows = []
    for i in range(40):
        minutes = sorted(draw.sample(range(0, 600, draw.choice([5, 15, 30])), draw.randrange(0, 20)))
        rows.append((i, [datetime.datetime(2024, 1, 3, 8) + datetime.timedelta(minutes=m) for m in minutes]))
    got = spark.createDataFrame(rows, "i int, t array<timestamp_ntz>").select("i", slots.spread(F.col("t")).alias("x")).collect()
    assert {r["i"]: r["x"] for r in got} == {i: greedy(t, 4, 45) for i, t in rows}


def test_availability_in_two_zones(spark):
    berlin, york = zoneinfo.ZoneInfo("Europe/Berlin"), zoneinfo.ZoneInfo("America/New_York")
    start = datetime.datetime(2024, 3, 28, 6, tzinfo=datetime.UTC)  # summer time differs between the two zones here
    rows = [("p", (start + datetime.timedelta(minutes=30 * k)).replace(tzinfo=None)) for k in range(48 * 6)]
    got = slots.availability(spark.createDataFrame(rows, "p string, at timestamp_ntz"), "p", "at", F.lit("America/New_York"), F.lit("Europe/Berlin"), F.lit(9), F.lit(17)).orderBy("day").collect()
    days: dict = {}
    for _, at in rows:
        utc = at.replace(tzinfo=datetime.UTC)
        own, shown = utc.astimezone(york), utc.astimezone(berlin)
        if own.weekday() < 5 and 9 <= own.hour < 17 and not (shown.weekday() == 4 and shown.hour >= 14):
            days.setdefault(shown.date(), []).append(shown.replace(tzinfo=None))
    want = {d: greedy(sorted(t), 4, 45) for d, t in sorted(days.items())[:3]}
    assert {r["day"]: r["times"] for r in got} == want


def test_producer_addresses(spark):
    cases = [("alee@x", "Ann", "Lee", True), ("ann@x", "Ann", "Lee", True), ("al@x", "Ann", "Lee", True), ("bo@x", "Bo", "Lee", False), ("info@x", "Info", "Lee", False), ("zed@x", "Ann", "Lee", False)]
    df = spark.createDataFrame(cases, "e string, f string, l string, ok boolean")
    rows = df.select("e", "ok", jobs.fits_person(F.substring_index("e", "@", 1), F.col("f"), F.col("l")).alias("got")).collect()
    assert all(r["ok"] == r["got"] for r in rows), rows


def test_zip_of_an_address_is_no_house_number(spark):
    cases = [
        ("10000 Main St, Los Angeles, CA 90008, United States", "90008"),
        ("10000 Main St, Los Angeles, CA 90008-1234, United States", "90008"),
        ("10000-10004 Main St, Suite 20000, LOS ANGELES, 90034, CA, USA", "90034"),
        ("Tower B, 10000 Main St, Los Angeles, CA 90008, United States", "90008"),
        ("10000 High Rd, Los Angeles, CA, United States", None),
        ("10000B High Rd, Los Angeles, CA, United States", None),
        ("1 High Rd, 10115 Berlin, Germany", "10115"),
        ("Los Angeles 90008, CA, United States", "90008"),
        ("90008, Los Angeles, United States", "90008"),
        ("100000 High Rd, Los Angeles, CA, United States", None),
        ("10000 High Rd, Los Angeles", None),
        (None, None),
    ]
    got = spark.createDataFrame(cases, "a string, zip string").select("a", "zip", strings.address(F.col("a"))["zip"].alias("got")).collect()
    assert all(r["got"] == r["zip"] for r in got), got


def test_url_column_by_header(spark):
    df = spark.createDataFrame([("x", "https://a.example/1"), ("y", "https://b.other/2")], "note string, `Company URL` string")
    assert [r["url"] for r in files.url_column(df, "a.example").collect()] == ["https://a.example/1"]
    bare = spark.createDataFrame([("https://a.example/2",)], "`https://a.example/1` string")
    assert sorted(r["url"] for r in files.url_column(bare, "a.example").collect()) == ["https://a.example/1", "https://a.example/2"]


def test_launches_seed_silently_and_fire_once(spark, tmp_path):
    source, base = str(tmp_path / "in"), str(tmp_path / "state")

    def step(rows):
        spark.createDataFrame(rows, "id string, n int, ord int").coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema("id string, n int, ord int").parquet(source)
        launches.announce_new(stream, "id", "ord", f"{base}/seen", f"{base}/out", f"{base}/check").start().awaitTermination()

    step([("a", 1, 1)])  # the first batch fills the empty seen set
    step([("a", 2, 2), ("b", 1, 3), ("b", 2, 4)])
    step([("b", 3, 5), ("c", 1, 6)])
    assert sorted((r["id"], r["n"]) for r in spark.read.parquet(f"{base}/out").collect()) == [("b", 1), ("c", 1)]
    assert sorted(r["id"] for r in spark.read.parquet(f"{base}/seen").collect()) == ["a", "b", "c"]


def test_outcomes_of_three_kinds(spark):
    assert monitors.outcome(lambda: spark.range(1))[0] == "data"
    assert monitors.outcome(lambda: spark.table("no_such_view"))[0] == "missing"
    assert monitors.outcome(lambda: spark.range(1).select("no_such_column"))[0] == "error"


def test_failed_sources_contribute_nothing(spark):
    rows, failed = monitors.survivors({"a": lambda: spark.range(2), "b": lambda: spark.table("no_such_view")})
    assert rows.count() == 2 and list(failed) == ["b"]


def test_underperformers_at_their_limits(spark):
    base = dict(status="Active", lead_count="0", completed="0", contacted="500", replied="2", positive="0", away="0", lead_total="0")
    cases = [
        ({}, "pause", "low rate"),
        ({"contacted": "499"}, "ok", "rate"),
        ({"replied": "2.5"}, "ok", "rate"),
        ({"contacted": "2000", "replied": "100"}, "pause", "no positive"),
        ({"contacted": "1999", "replied": "100"}, "ok", "rate"),
        ({"positive": "1"}, "ok", "positive"),
        ({"away": "20", "lead_total": "100"}, "pause", "low rate"),
        ({"away": "21", "lead_total": "100"}, "skip", "away"),
        ({"lead_count": "500"}, "skip", "complete"),
        ({"status": None}, "skip", "inactive"),
        ({"contacted": "x"}, "ok", "rate"),
    ]
    df = spark.createDataFrame([{**base, **c, "i": i} for i, (c, _, _) in enumerate(cases)], "i int, status string, lead_count string, completed string, contacted string, replied string, positive string, away string, lead_total string")
    got = {r["i"]: (r["decision"], r["reason"]) for r in monitors.decide(df).collect()}
    assert got == {i: (d, r) for i, (_, d, r) in enumerate(cases)}


def test_rules_of_a_table_keep_their_order(spark):
    rows = [(2, "anywhere", "auto", "transport"), (1, "words", "household", None), (3, "ends", ".gov", "public"), (3, "ends", ".edu", "public"), (2, "pattern", r"\bcars\b", "transport"), (4, "starts", "big", "big")]
    table = spark.createDataFrame(rows, "rank int, test string, token string, label string")
    found = rules.rule_set(table, "unsorted")
    cases = {"household auto": None, "households": "unsorted", "AUTO.gov": "transport", "my cars": "transport", "x.edu": "public", "big": "big", "": "unsorted"}
    df = spark.createDataFrame([(k,) for k in cases], "t string")
    assert {r["t"]: r["x"] for r in df.select("t", found.on(F.col("t")).alias("x")).collect()} == cases
    for bad in ((1, "words", "x", "other"), (9, "no such test", "x", "y"), (2, "pattern", "z", "transport")):
        with pytest.raises(ValueError):
            rules.rule_set(table.union(spark.createDataFrame([bad], table.schema)))
    pairs = spark.createDataFrame([(1, "anywhere", "weld", "Engineering", "plant"), (2, "starts", "intro", None, None)], "rank int, test string, token string, job string, field string")
    both = rules.rule_set(pairs, ("Other", None), ("job", "field"))
    got = spark.createDataFrame([("Welding",), ("Intro",), ("x",)], "t string").select(both.on(F.col("t")).alias("x")).collect()
    assert [tuple(r["x"]) for r in got] == [("Engineering", "plant"), (None, None), ("Other", None)]


def test_zone_parts_like_the_standard_library(spark):
    from tidewright import plans

    york = zoneinfo.ZoneInfo("America/New_York")
    sf = "/root/testdata/sf0.001"
    at = {r["event_id"]: r["ts"] for r in spark.read.parquet(f"{sf}/events.parquet").select("event_id", F.col("ts").cast("timestamp_ntz").alias("ts")).collect()}
    for r in plans.QUERIES["f15_zone_parts"](spark, sf).collect():
        own = at[r["event_id"]].replace(tzinfo=datetime.UTC).astimezone(york)
        assert (r["weekday"], r["hour"], r["day"]) == (own.isoweekday() % 7 + 1, own.hour, own.date())


def test_people_and_cards(spark):
    names = {"Ann Lee": True, "J. O'Neil-Ray": True, "one two three four five six": False, "": False, "Exhibitor Hall": False, "Room 9": False, None: False, "  Ann   Lee ": True}
    df = spark.createDataFrame([(k,) for k in names], "t string")
    assert {r["t"]: r["x"] for r in df.select("t", jobs.is_person(F.col("t")).alias("x")).collect()} == names
    cards = [("Ann Lee", "exhibitor summary", "company"), ("Acme Labs 9", "an attendee", "person"), ("Ann Lee", "text", "person"), ("Acme Labs 9", "text", "company"), ("Room 9", None, "unknown"), ("Room 9", "summary only", "unknown")]
    df = spark.createDataFrame(cards, "first string, t string, want string")
    assert all(r["want"] == r["got"] for r in df.select("want", jobs.record_kind(F.col("first"), F.col("t"), ["labs"]).alias("got")).collect())


def test_triage_like_a_loop(spark):
    draw = random.Random(4)
    junk, profile = ["filters", "sort", "menu", "home"], ["director", "attendee", "united states", "growth"]
    parts = [*junk, *profile, "vp", "search", "some other words", "\n", "\n\n", " ", "x"]
    rows = [(i, draw.choice([None, " ".join(draw.choice(parts) for _ in range(draw.randrange(12)))]), draw.choice([100, 247, 250]), draw.choice([2, 8]), draw.choice([3, 5, 8]), draw.choice([10, 25, 35])) for i in range(300)]
    df = spark.createDataFrame(rows, "i int, raw_text string, gray_mean int, gray_stddev int, edge_mean int, avg_conf int")

    def want(text, mean, deviation, edge, sure):
        low = (text or "").lower()
        n, lines = len(low), sum(1 for s in low.split("\n") if s.strip())
        bad, good = (sum(t in low for t in terms) for terms in (junk, profile))
        any_ = lambda words: any(w in low for w in words)
        if mean >= 247 and deviation < 8 and n < 20:
            return "mostly_white_blank"
        if n < 12 and sure < 25:
            return "too_little_text"
        if any_(jobs.WORDS["listing"]) and bad >= 2 and not good:
            return "clear_list_or_menu"
        if bad >= 3 and good <= 1:
            return "ui_heavy_text"
        strong = [good >= 3, "united states" in low, any_(jobs.WORDS["role"]), n >= 60, lines >= 3, sure >= 35, edge >= 8]
        if sum(strong) >= 4 and bad <= 1:
            return "strong_profile_signals"
        return "ambiguous_or_partial_profile" if sum([n >= 20, lines >= 2, good >= 1, edge >= 5]) >= 2 else "low_signal"

    got = {r["i"]: r["reason"] for r in jobs.triage(df, junk, profile).collect()}
    assert got == {i: want(*rest) for i, *rest in rows} and len(set(got.values())) == 7


def test_cadence_runs_what_is_due(spark, tmp_path):
    now, ran = [0.0], []
    jobs_ = {"fast": cadence.Job(1, lambda: ran.append("fast")), "slow": cadence.Job(3, lambda: ran.append("slow")), "bad": cadence.Job(100, lambda: 1 / 0)}
    failed = cadence.run(jobs_, 4, lambda: now[0], lambda s: now.__setitem__(0, now[0] + s))
    assert ran == ["fast", "slow", "fast", "fast", "fast", "slow"] and failed == {"fast": [], "slow": [], "bad": ["division by zero"]}
    source = str(tmp_path / "in")
    spark.createDataFrame([("a", 1)], "id string, n int").write.parquet(source)
    stream = lambda: launches.append_log(spark.readStream.schema("id string, n int").parquet(source), str(tmp_path / "out"), str(tmp_path / "check"))
    assert cadence.run({"log": cadence.Job(1, stream)}, 1) == {"log": []}
    assert spark.read.parquet(str(tmp_path / "out")).count() == 1


def test_words_are_counted_like_the_array_of_them(spark):
    from tidewright.functions import text

    rows = ["", "a b", "don't stop-me 12", "\x01 x\x01y", "é a1'b ''", "  "]
    df = spark.createDataFrame([(t,) for t in rows], "t string")
    assert all(r["a"] == r["b"] for r in df.select(text.word_count(F.col("t")).alias("a"), F.size(text.words(F.col("t"))).alias("b")).collect())
