"""Semi-structured records: wrappers, payloads, flattening, sections."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import strings

WRAPPERS = ("records", "data", "items", "results")


def wrapped(text: Column, record: str, wrappers: Sequence[str] = WRAPPERS) -> Column:
    """The records of a JSON text: a list, a list under the first wrapper there, or the object itself.

    Text that doesn't parse, or a list's members that are no objects, give no records.
    """
    # Members are read as texts first, so that one that is no object voids nothing else.
    members = lambda json: F.transform(F.filter(F.from_json(json, "array<string>"), lambda m: F.ltrim(m).startswith("{")), lambda m: F.from_json(m, record))
    found = [members(F.get_json_object(text, f"$.{w}")) for w in wrappers]
    rows = F.when(F.ltrim(text).startswith("["), members(text)).otherwise(F.coalesce(*found, F.array(F.from_json(text, record))))
    return F.when(F.try_parse_json(text).isNotNull(), F.filter(rows, lambda r: r.isNotNull())).otherwise(F.array().cast(f"array<{record}>"))


def read_records(spark, path: str, record: str, wrappers: Sequence[str] = WRAPPERS) -> DataFrame:
    """Records of JSON and JSONL files with an explicit schema; (file, pos, record).

    A file has one text a line if its first line parses or the whole doesn't,
    else it is one text. Texts that don't parse are skipped.
    """
    files = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), F.col("value").alias("text"))
    by_line = F.try_parse_json(F.regexp_extract("text", r"^\s*([^\r\n]*)", 1)).isNotNull() | F.try_parse_json("text").isNull()
    texts = files.select("file", F.when(~by_line, F.array("text")).otherwise(F.split("text", r"\r?\n")).alias("t"))
    rows = texts.select("file", F.posexplode("t").alias("line", "text")).filter(F.trim("text") != "")
    return rows.select("file", "line", F.posexplode(wrapped(F.col("text"), record, wrappers)).alias("at", "record"))


def flat(value: Column, kind: T.DataType) -> Column:
    """Any value as one cell: null is empty, lists join with ``; ``, people join with `` - ``, the rest is JSON."""
    if isinstance(kind, T.StringType):
        return F.coalesce(value, F.lit(""))
    if isinstance(kind, T.ArrayType):
        cells = F.filter(F.transform(value, lambda v: flat(v, kind.elementType)), lambda c: c != "")
        return F.coalesce(F.array_join(cells, "; "), F.lit(""))
    if isinstance(kind, T.StructType):
        if {"name", "title", "company"} <= set(kind.names):
            parts = F.array(*(F.coalesce(value[n].cast("string"), F.lit("")) for n in ("name", "title", "company")))
            return F.array_join(F.filter(parts, lambda p: p != ""), " - ")
        return F.coalesce(F.to_json(value), F.lit(""))
    return F.coalesce(value.cast("string"), F.lit(""))


def flattened(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Fixed columns in a fixed order, each flattened; an absent column is empty."""
    return df.select(*(flat(F.col(c), df.schema[c].dataType).alias(c) if c in df.columns else F.lit("").alias(c) for c in columns))


# What a page says that is no record, with the status and message for it, and the messages of what is wrong with a payload.
LOGIN, LOGIN_BUT, NOT_FOUND, HEAD_CHARS = "sign in", "company", "page not found", 2000
SAID = {
    "login": ("auth_expired", "Redirected to login"),
    "absent": ("not_found", "404"),
    "none": ("error", "No __NEXT_DATA__ found"),
    "tag": ("error", "Malformed __NEXT_DATA__ tag"),
    "open": ("error", "Unclosed __NEXT_DATA__ script"),
    "empty": ("error", "Empty __NEXT_DATA__ script"),
    "json": ("error", "JSON parse error"),
    "record": ("error", "Missing company data in JSON"),
    "fine": ("success", ""),
}


def payload(html: Column, marker: str = "__NEXT_DATA__", record: str = "$.props.pageProps.data.company") -> Column:
    """struct(status, error_msg, json): the JSON text of a page's script, or what is wrong with the page.

    The script is the element with the id ``marker``; without one, what follows
    the tag that the bare marker stands in. ``record`` is the path of an object
    that the JSON must have. Null is the empty page.
    """
    page = F.coalesce(html, F.lit(""))
    head = F.lower(F.substring(page, 1, HEAD_CHARS))
    element = rf"(?s)<script[^>]*id=[\"']{marker}[\"'][^>]*>(.*)"
    tagged, marked = page.rlike(element), page.contains(marker)
    bare = F.regexp_extract(page, rf"(?s)^.*?{marker}(.*)", 1)
    # All but the last of these are what is left of the page behind the tag.
    rest = F.when(tagged, F.regexp_extract(page, element, 1)).when(marked & bare.contains(">"), F.regexp_extract(bare, "(?s)^[^>]*>(.*)", 1))
    body = strings.stripped(F.regexp_extract(rest, "(?s)^(.*?)</script>", 1))
    found = F.transform(F.array(F.struct(rest.alias("rest"), body.alias("body"))), lambda x: _judged(head, tagged, marked, x["rest"], x["body"], record))
    return found[0]


def _judged(head: Column, tagged: Column, marked: Column, rest: Column, body: Column, record: str) -> Column:
    say = lambda what: F.struct(F.lit(SAID[what][0]).alias("status"), F.lit(SAID[what][1]).alias("error_msg"), (body if what == "fine" else F.lit(None).cast("string")).alias("json"))
    return (
        F.when(head.contains(LOGIN) & ~head.contains(LOGIN_BUT), say("login"))
        .when(head.contains(NOT_FOUND), say("absent"))
        .when(~tagged & ~marked, say("none"))
        .when(rest.isNull(), say("tag"))
        .when(~rest.contains("</script>"), say("open"))
        .when(body == "", say("empty"))
        .when(F.try_parse_json(body).isNull(), say("json"))
        .when(~F.coalesce(F.get_json_object(body, record).startswith("{"), F.lit(False)), say("record"))
        .otherwise(say("fine"))
    )


def fields(json: Column, paths: dict[str, str]) -> list[Column]:
    """One column for each JSON path; a path that is missing voids nothing but itself."""
    return [F.get_json_object(json, p).alias(n) for n, p in paths.items()]


def url_key(url: Column, canonical: str | None = None, path_prefix: str = "/company") -> Column:
    """A url with scheme, lower-case host, no query or fragment and one trailing slash."""
    full = F.when(url.rlike("^(?i)https?://"), url).otherwise(F.concat(F.lit("https://"), F.ltrim(url, F.lit("/"))))
    bare = F.regexp_replace(F.trim(full), r"[?#].*$", "")
    host = F.lower(F.regexp_extract(bare, "^[a-zA-Z]+://([^/]*)", 1))
    path = F.concat(F.rtrim(F.regexp_extract(bare, "^[a-zA-Z]+://[^/]*(.*)$", 1), F.lit("/")), F.lit("/"))
    host = F.when(path.startswith(path_prefix), F.lit(canonical)).otherwise(host) if canonical else host
    return F.concat(F.lit("https://"), host, path)


# Fixed value: what lines don't begin or end with.
LINE_ENDS = " ,.-"


def clean_lines(lines: Column) -> Column:
    """Lines without leading signs, spaces collapsed and ends trimmed; empty ones go."""
    bare = lambda s: F.regexp_replace(F.regexp_replace(s, "^[^A-Za-z0-9]+", ""), r"\s+", " ")
    tidy = F.transform(lines, lambda s: F.btrim(bare(s), F.lit(LINE_ENDS)))
    return F.filter(tidy, lambda s: s != "")


def is_noise(line: Column, exact: Sequence[str], patterns: Sequence[str]) -> Column:
    return F.lower(line).isin(*[e.lower() for e in exact]) | line.rlike("(?i)" + "|".join(f"(?:{p})" for p in patterns))


def sections(df: DataFrame, key: str, lines: str, headers: Sequence[str]) -> DataFrame:
    """(key, header, lines): the lines below each header; of a repeated header the last counts."""
    from pyspark.sql import Window

    rows = df.select(key, F.posexplode(lines).alias("at", "line"))
    is_header = F.lower(F.trim("line")).isin(*[h.lower() for h in headers])
    running = Window.partitionBy(key).orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("start", F.max(F.when(is_header, F.col("at"))).over(running)).filter("start IS NOT NULL")
    heads = rows.filter("at = start").select(key, F.lower(F.trim("line")).alias("header"), "start")
    last = heads.groupBy(key, "header").agg(F.max("start").alias("start"))
    body = rows.filter("at > start").groupBy(key, "start").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "line"))), lambda s: s["line"]).alias("lines"))
    return last.join(body, [key, "start"], "left").select(key, "header", F.coalesce("lines", F.array().cast("array<string>")).alias("lines"))


def unused(kept: Column, consumed: Column) -> Column:
    """The lines that nothing has used, repeats included."""
    return F.filter(kept, lambda x: ~F.array_contains(consumed, x))


def to_columns(values: Column, n: int, prefix: str) -> list[Column]:
    """The first ``n`` different non-empty values in their order, one a column."""
    distinct = F.array_distinct(F.filter(values, lambda v: v.isNotNull() & (v != "")))
    return [F.get(distinct, F.lit(i)).alias(f"{prefix}_{i + 1}") for i in range(n)]


def per_email(df: DataFrame, emails: str) -> DataFrame:
    """One row for each address of a comma-separated cell; rows without any stay once."""
    parts = F.filter(F.transform(F.split(F.col(emails), ","), lambda e: F.trim(e)), lambda e: e != "")
    rest = [c for c in df.columns if c != emails]
    rows = df.withColumn(emails, F.explode_outer(parts)).withColumn(emails, F.coalesce(emails, F.lit("")))
    used = [F.coalesce(F.trim(F.col(c).cast("string")), F.lit("")) != "" for c in [*rest, emails]]
    keep = used[0]
    for u in used[1:]:
        keep = keep | u
    return rows.filter(keep).select(*df.columns)
