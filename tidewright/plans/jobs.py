"""Record jobs: filter, classify, normalise, group and write."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewright.functions import strings, times
from tidewright.operators import joins
from tidewright.operators.rules import Rule, RuleSet, cascade, hits, points

# Prefixes of shared inboxes, and the rank of company types.
GENERIC_INBOXES = ("info", "admin", "contact", "hello", "office", "team", "production", "productions", "general", "mail", "inquiries", "enquiry", "enquiries")
TYPE_RANK = ("production_company", "project_specific_entity_or_spv", "sales_or_finance_company", "studio_or_network", "agency_or_management", "unknown")
PRIMARY = "primary_listing_entity"
# Fixed value: the country of a filing that gives none.
HOME = "US"


def companies(filings: DataFrame, prefixes: DataFrame, excluded: DataFrame, since) -> DataFrame:
    """One row a company over cleared filings in scope, with its lifetime count.

    ``filings`` has ord, applicant, device, decision_code, decided, product_code,
    country, regulation. First-seen values follow ``ord``; of countries the
    most frequent counts, upper-cased and ``HOME`` where none is given, the first
    seen among equals. The companies come by their lifetime count, the highest
    first; those without a filing since ``since`` are left out.
    """
    cleared = filings.filter(F.upper("decision_code").startswith("SE")).withColumn("key", strings.company_key(F.col("applicant"))).filter("key <> ''")
    lifetime = cleared.groupBy("key").agg(F.count(F.lit(1)).alias("lifetime"))
    scope = joins.longest_prefix(cleared.withColumn("regulation", F.trim("regulation")), "regulation", prefixes, excluded, "category").filter("category IS NOT NULL")
    scope = scope.withColumn("day", times.parsed_date(F.col("decided")))
    device = F.nullif(F.trim("device"), F.lit(""))
    rows = scope.groupBy("key").agg(
        F.min_by(F.trim("applicant"), "ord").alias("company"),
        F.count(F.lit(1)).alias("filings"),
        F.count_distinct(F.nullif(F.trim("product_code"), F.lit(""))).alias("codes"),
        F.array_join(F.array_sort(F.collect_set("category")), " | ").alias("categories"),
        F.max("day").alias("last_filing"),
        F.min_by(device, F.when(device.isNotNull(), F.col("ord"))).alias("sample_device"),
    )
    per_country = scope.groupBy("key", F.coalesce(F.nullif(F.upper(strings.stripped("country")), F.lit("")), F.lit(HOME)).alias("country")).agg(F.count(F.lit(1)).alias("n"), F.min("ord").alias("first"))
    country = per_country.groupBy("key").agg(F.max_by("country", F.struct("n", -F.col("first"))).alias("country"))
    return rows.join(country, "key").join(lifetime, "key").filter(F.col("last_filing") >= since).orderBy(F.desc("lifetime"), "key")


# How captures are sorted. A reject is decided by bounds that all hold, the first that fits;
# then points are counted, one for each measure that reaches its bound.
REJECTS = {
    "mostly_white_blank": "gray_mean >= 247 AND gray_stddev < 8 AND chars < 20",
    "too_little_text": "chars < 12 AND avg_conf < 25",
    "clear_list_or_menu": "listing = 1 AND junk >= 2 AND profile = 0",
    "ui_heavy_text": "junk >= 3 AND profile <= 1",
}
STRONG = {"profile": 3, "place": 1, "role": 1, "chars": 60, "lines": 3, "avg_conf": 35, "edge_mean": 8}
WEAK = {"chars": 20, "lines": 2, "profile": 1, "edge_mean": 5}
OUTCOMES = (("keep", "strong_profile_signals"), ("review", "ambiguous_or_partial_profile"), ("junk", "low_signal"))
LEAST_STRONG, MOST_JUNK, LEAST_WEAK = 4, 1, 2
WORDS = {
    "place": ("united states",),
    "role": ("director", "manager", "chief", "vice president", "vp", "attendee", "representative"),
    "listing": ("all attendees", "filters", "sort", "search"),
}


def measures(text: Column, terms: Mapping[str, Sequence[str]]) -> dict[str, Column]:
    """What triage asks of a text: its size, terms held of each list, and 1 or 0 for each list of ``WORDS``."""
    lines = F.filter(F.split(text, "\n"), lambda s: strings.stripped(s) != "")
    sizes = {"chars": F.char_length(text), "lines": F.size(lines)}
    held = {n: hits(text, t) for n, t in terms.items()}
    return sizes | held | {n: F.least(hits(text, w), F.lit(1)) for n, w in WORDS.items()}


def triage(captures: DataFrame, junk_terms: Sequence[str], profile_terms: Sequence[str]) -> DataFrame:
    """Captures with (bucket, reason): hard rejects, then enough strong points and little junk, then enough weak points."""
    measured = captures.select(F.struct(*captures.columns).alias("row"), "gray_mean", "gray_stddev", "edge_mean", "avg_conf", F.coalesce("raw_text", F.lit("")).alias("text"))
    measured = measured.withColumns(measures(F.col("text"), {"junk": junk_terms, "profile": profile_terms}))
    score = lambda table: points(*(F.col(c) >= least for c, least in table.items()))
    say = lambda bucket, reason: F.struct(F.lit(bucket).alias("bucket"), F.lit(reason).alias("reason"))
    rejected = F.coalesce(*(F.when(F.expr(test), say("junk", reason)) for reason, test in REJECTS.items()))
    keep, review, rest = (say(*o) for o in OUTCOMES)
    scored = F.when((score(STRONG) >= LEAST_STRONG) & (F.col("junk") <= MOST_JUNK), keep).when(score(WEAK) >= LEAST_WEAK, review).otherwise(rest)
    return measured.withColumn("v", F.coalesce(rejected, scored)).select("row.*", "v.bucket", "v.reason")


# The words by which a captured card is told to be a person's, a company's or a place.
SUBTYPE = RuleSet(
    [Rule("contributor", anywhere=["contributor at"]), Rule("representative", anywhere=["representative"]), Rule("attendee", anywhere=["attendee"]), Rule("exhibitor", anywhere=["exhibitor"])], "unknown"
)
COMPANY_CARD = Rule("company", pattern="(?s)(?=.*exhibitor).*(?:representatives|summary)")
PEOPLE = ("contributor", "attendee", "representative")
HEADINGS = ("attendee", "representative", "exhibitor", "summary", "designations", "topics")
PLACES = RuleSet([Rule("place", anywhere=["united states", "france"])])
BOOTHS = (r"(?i)find me at\s*([A-Za-z0-9-]+)", r"(?i)\bbooth[:\s#-]*([A-Za-z0-9-]+)\b")
MOST_NAME_WORDS, NAME_WORD = 5, "^[A-Za-z.'-]+$"


def is_location(line: Column, places: RuleSet = PLACES) -> Column:
    return places.on(line).isNotNull()


def is_person(line: Column, headings: Sequence[str] = HEADINGS) -> Column:
    """A few words of letters, points, apostrophes and hyphens, none of them a heading."""
    words = F.filter(F.split(F.lower(line), r"\s+"), lambda w: w != "")
    fits = F.forall(words, lambda w: w.rlike(NAME_WORD) & ~w.isin(*headings))
    return F.coalesce(F.size(words).between(1, MOST_NAME_WORDS) & fits, F.lit(False))


def is_organisation(line: Column, hints: Sequence[str]) -> Column:
    return hits(line, hints) > 0


def booth(text: Column) -> Column:
    return F.coalesce(strings.first_match(text, BOOTHS), F.lit(""))


def record_kind(first: Column, text: Column, hints: Sequence[str]) -> Column:
    """company, person or unknown: by the card's words, its subtype, then its first line."""
    by_card = F.when(COMPANY_CARD.test(F.lower(F.coalesce(text, F.lit("")))), COMPANY_CARD.label)
    by_subtype = F.when(SUBTYPE.on(text).isin(*PEOPLE), "person")
    by_line = F.when(is_person(first), "person").when(is_organisation(first, hints), "company")
    return cascade(by_card, by_subtype, by_line, F.lit("unknown"))


def title_and_company(lines: Column) -> Column:
    """struct(title, company): the second line around its first comma; else the third line, if no place, is the company."""
    second, third = F.coalesce(F.get(lines, F.lit(1)), F.lit("")), F.coalesce(F.get(lines, F.lit(2)), F.lit(""))
    parts = F.split(second, ",", 2)
    right = F.trim(F.coalesce(F.get(parts, F.lit(1)), F.lit("")))
    company = F.when(right != "", right).when(is_location(third), F.lit("")).otherwise(third)
    return F.struct(F.trim(parts[0]).alias("title"), company.alias("company"))


def dedupe_key() -> Column:
    """A record's key: company, person at company, person at place, its raw text, its source."""
    kind, name, company, location, booth_ = (strings.dedupe_key(F.col(c)) for c in ("record_kind", "name", "company", "location", "booth"))
    raw = F.substring(strings.dedupe_key(F.col("raw_text")), 1, 300)
    return (
        F.when((kind == "company") & (company != ""), F.concat_ws("|", F.lit("company"), company, location, booth_))
        .when((name != "") & (company != ""), F.concat_ws("|", F.lit("person"), name, company))
        .when((name != "") & (location != ""), F.concat_ws("|", F.lit("person"), name, location))
        .when(raw != "", F.concat_ws("|", F.lit("raw"), raw))
        .otherwise(F.concat_ws("|", F.lit("source"), F.coalesce("source", F.lit(""))))
    )


def _type_rank() -> Column:
    kind = strings.coerced(F.coalesce("company_type", F.lit("")), TYPE_RANK)
    return F.array_position(F.array(*(F.lit(x) for x in TYPE_RANK)), kind)


def project_companies(rows: DataFrame) -> DataFrame:
    """All primary-type companies of a project, else its one best by type, relation and place in the list.

    ``rows``: project, pos, company, company_type, relation; a project without companies has no row.
    """
    ranked = rows.withColumn("rank", _type_rank())
    order = Window.partitionBy("project").orderBy("rank", (F.col("relation") == PRIMARY).desc(), "pos")
    best = ranked.withColumn("place", F.row_number().over(order))
    return best.filter((F.col("rank") == 1) | (F.col("place") == 1)).drop("rank", "place")


def fits_person(local: Column, first: Column, last: Column) -> Column:
    """Whether an inbox name is a person's: first or last name (3 letters at least), initial and last name, or initials."""
    inbox = F.regexp_replace(F.lower(local), "[^a-z]", "")
    f, l = (F.regexp_replace(F.lower(x), "[^a-z]", "") for x in (first, last))  # noqa: E741
    generic = strings.starts_with_any(local, GENERIC_INBOXES)
    initials = F.concat(F.substring(f, 1, 1), F.substring(l, 1, 1))
    named = (F.length(f) >= 3) & (inbox == f) | (F.length(l) >= 3) & ((inbox == l) | (inbox == F.concat(F.substring(f, 1, 1), l)) | (inbox == F.concat(f, l)))
    return ~generic & (inbox != "") & (named | (F.length(initials) == 2) & (inbox == initials))


def producer_companies(people: DataFrame, rows: DataFrame) -> DataFrame:
    """Each producer's one company: a fitting address, then the primary entity, then the type, then the first listed.

    ``people``: project, person. ``rows``: as for ``project_companies`` with emails (an array).
    """
    name = strings.split_name(F.col("person"))
    both = people.withColumn("n", name).join(rows, "project", "left")
    local = lambda e: F.substring_index(e, "@", 1)
    mine = F.filter(F.coalesce("emails", F.array().cast("array<string>")), lambda e: fits_person(local(e), F.col("n.first"), F.col("n.last")))
    main = F.coalesce(F.col("company_type") == TYPE_RANK[0], F.lit(False))
    rank = F.when(main & (F.size("mine") > 0), 1).when(main & (F.col("relation") == PRIMARY), 2).when(main, 3).otherwise(4)
    ranked = both.withColumn("mine", mine).withColumn("rank", rank)
    best = ranked.withColumn("place", F.row_number().over(Window.partitionBy("project", "person").orderBy("rank", "pos"))).filter("place = 1")
    return best.select("project", "person", F.coalesce("company", F.lit("")).alias("company"), F.coalesce(F.get("mine", F.lit(0)), F.lit("")).alias("email_1"), F.coalesce(F.get("mine", F.lit(1)), F.lit("")).alias("email_2"))


def fresh_articles(rows: DataFrame, today: Column, floor: Column, days: int = 7) -> DataFrame:
    """Articles dated validly, within ``days`` and not before ``floor``; one a client and url, the first seen."""
    day = times.parsed_date(F.col("published"))
    kept = rows.withColumn("day", day).filter(F.col("day").isNotNull() & (F.col("day") >= F.date_sub(today, days)) & (F.col("day") >= floor))
    order = Window.partitionBy("client", "url").orderBy("ord")
    return kept.withColumn("place", F.row_number().over(order)).filter("place = 1").drop("place")


def producers(names: Column, suffixes: Sequence[str] = ("Jr", "Sr", "II", "III", "IV")) -> Column:
    """The people in a credit: parts between dashes or commas, a suffix staying with its name, notes in brackets gone."""
    bare = F.regexp_replace(names, r"\s*\([^)]*\)", "")
    joined = F.regexp_replace(bare, rf",\s*({'|'.join(suffixes)})\b", " $1")
    return F.filter(F.transform(F.split(joined, r"\s+-\s+|\s*,\s*"), lambda p: F.trim(p)), lambda p: p != "")


#: Address shapes by country, tried in this order: (country, postal code, state).
ADDRESS_SHAPES = (
    ("United States", r"\b[A-Z]{2} (\d{5}(?:-\d{4})?)\b", r"\b([A-Z]{2}) \d{5}"),
    ("Canada", r"\b[A-Z]{2} ([A-Z]\d[A-Z] \d[A-Z]\d)\b", r"\b([A-Z]{2}) [A-Z]\d[A-Z]"),
    ("Ireland", r"\b([A-Z]\d[\dW] [A-Z\d]{4})\b", None),
    ("United Kingdom", r"\b([A-Z]{1,2}\d[A-Z\d]? \d[A-Z]{2})\b", None),
    ("Japan", r"\b(\d{3}-\d{4})\b", None),
    ("Australia", r"\b(?:NSW|VIC|QLD|WA|SA|TAS|ACT|NT) (\d{4})\b", r"\b(NSW|VIC|QLD|WA|SA|TAS|ACT|NT) \d{4}"),
    (None, r", (?:[A-Z]-)?(\d{4,5}(?:-\d{3})?) [^,]+, (?:France|Germany|Switzerland|Finland|Spain|Portugal|Italy)$", None),
)


def first_address(raw: Column) -> Column:
    """struct(line, postal, state, country) of the first of several addresses; unknown shapes stay in the line, urls are blank."""
    one = F.trim(F.split_part(F.coalesce(raw, F.lit("")), F.lit(";"), F.lit(1)))
    web = one.rlike(r"^(?:https?://)?[\w-]+(?:\.[\w-]+)+(?:/\S*)?$")
    out = F.when(web, F.struct(F.lit("").alias("line"), F.lit("").alias("postal"), F.lit("").alias("state"), F.lit("").alias("country")))
    for country, postal, state in ADDRESS_SHAPES:
        found = F.struct(
            F.trim(F.split_part(one, F.lit(","), F.lit(1))).alias("line"),
            F.regexp_extract(one, postal, 1).alias("postal"),
            (F.regexp_extract(one, state, 1) if state else F.lit("")).alias("state"),
            (F.lit(country) if country else F.trim(F.substring_index(one, ",", -1))).alias("country"),
        )
        out = out.when(one.rlike(postal), found)
    return out.otherwise(F.struct(one.alias("line"), F.lit("").alias("postal"), F.lit("").alias("state"), F.lit("").alias("country")))
