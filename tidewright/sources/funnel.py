"""The funnel's domain tables, derived from the synthetic test tables.

One definition serves both engines: the text of each table is SQL that Spark
and DuckDB read alike but for the few spellings in ``Dialect``.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession

BASE_TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "pages")


@dataclass(frozen=True)
class Dialect:
    array: str
    distinct_sorted: str

    def arr(self, *items: str) -> str:
        return self.array.format(", ".join(items))

    def labels(self, item: str) -> str:
        return self.distinct_sorted.format(item)


SPARK = Dialect("array({})", "array_sort(collect_set({}))")
DUCK = Dialect("[{}]", "list_sort(list(distinct {}))")


def _rep(number: str) -> str:
    return f"'NATION_' || cast({number} % 25 as string)"


def _lead(number: str) -> str:
    return f"'user' || cast({number} as string) || '@lead.example'"


def definitions(d: Dialect) -> dict[str, str]:
    """The SQL of every domain table over the test tables."""
    rep = _rep("user_id")
    mail = lambda name, house: f"lower({name}) || '@{house}.example'"
    return {
        "thread_snapshot": f"""
            SELECT snapshot_date, conv_id, 'Thread ' || conv_id AS subject, last_activity, messages_count, label_names,
                CASE WHEN user_id % 17 = 0 THEN NULL WHEN max_id % 7 = 0 THEN ''
                     ELSE 'User' || cast(user_id as string) || '@Lead.example' END AS lead_email,
                CASE user_id % 4 WHEN 0 THEN {d.arr(mail(rep, "firm"))}
                    WHEN 1 THEN {d.arr("'desk@other.example'", mail(rep, "home"))}
                    WHEN 2 THEN {d.arr("'team@other.example'")} ELSE {d.arr("'nobody@other.example'")} END AS authors,
                CASE WHEN user_id % 3 = 0 THEN NULL WHEN user_id % 4 = 2 THEN {d.arr(rep + " || ' Smith'", "'Zed Zed'")}
                    WHEN user_id % 4 = 3 THEN {d.arr("'Nat Doe'")} ELSE {d.arr("'No One'")} END AS author_names,
                last_activity AS pulled_at
            FROM (SELECT CASE WHEN ts < timestamp '2024-01-16 00:00:00' THEN date '2024-01-15' ELSE date '2024-01-30' END AS snapshot_date,
                    cast(user_id as string) || '-' || cast(event_id % 20 as string) AS conv_id, user_id,
                    max(ts) AS last_activity, count(*) AS messages_count, max(event_id) AS max_id,
                    {d.labels("CASE event_type WHEN 'signup' THEN 'Interested' WHEN 'purchase' THEN 'Call Booked' ELSE 'Other' END")} AS label_names
                FROM {{events}} GROUP BY 1, 2, 3) g""",
        "campaign_snapshot": """
            SELECT cast(date_trunc('year', l_shipdate) as date) AS snapshot_date, 'camp-' || cast(l_partkey as string) AS campaign_id,
                cast(sum(l_quantity) as bigint) AS sent_count,
                cast(sum(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) as bigint) AS replied_count,
                cast(sum(CASE WHEN l_returnflag = 'A' THEN 1 ELSE 0 END) as bigint) AS positive_reply_count,
                min(l_shipdate) AS created_at, max(l_shipdate) AS pulled_at
            FROM {lineitem} GROUP BY 1, 2""",
        "campaign_dim": f"""
            SELECT 'camp-' || cast(p_partkey as string) AS campaign_id, p_name || ' ' || cast(p_partkey % 400 as string) AS name,
                CASE WHEN p_partkey % 13 = 0 THEN NULL ELSE p_type = 'PROMO' END AS is_mpc,
                CASE WHEN p_type = 'PROMO' AND p_partkey % 13 <> 0 THEN 'Ann ' || p_brand END AS mpc_candidate,
                CASE WHEN p_partkey % 10 <> 0 THEN {_rep("cast(split_part(p_brand, '#', 2) as int)")} END AS assigned_rep,
                p_type AS archetype
            FROM {{part}}""",
        "contact_dim": f"""
            SELECT {_lead("c_custkey")} AS email, CASE WHEN c_custkey % 5 <> 0 THEN c_mktsegment END AS industry,
                CASE c_nationkey % 4 WHEN 0 THEN 'Engineering' WHEN 1 THEN 'Sales' WHEN 2 THEN '' END AS job_function,
                'camp-' || cast(c_custkey as string) AS first_seen_campaign, c_name AS company,
                'Title ' || cast(c_nationkey as string) AS job_title
            FROM {{customer}}""",
        "rep_dim": """
            SELECT n_name AS rep_key, lower(n_name) || '@firm.example' AS rep_email, 'Rep ' || n_name AS display_name FROM {nation}""",
        "deal_dim": f"""
            SELECT cast(o_orderkey as string) AS deal_id, 'Deal ' || cast(o_orderkey as string) AS dealname, o_totalprice AS amount,
                CASE o_orderstatus WHEN 'F' THEN 'Closed Won' WHEN 'P' THEN 'Closed Lost' ELSE 'Negotiation' END AS stage_label,
                CASE WHEN o_orderkey % 50 = 7 THEN NULL ELSE o_orderstatus = 'F' END AS is_closed_won,
                o_custkey % 3 = 0 AS is_outbound_attributed, o_orderpriority AS deal_source,
                CASE WHEN o_orderkey % 20 <> 3 THEN {_lead("o_custkey")} END AS primary_contact_email,
                CASE WHEN o_orderkey % 4 = 0 THEN NULL WHEN o_orderkey % 4 = 1 THEN 'camp-' || cast(o_custkey as string)
                    ELSE 'small ring ' || cast(o_custkey % 400 as string) END AS attributed_campaign,
                CASE WHEN o_orderkey % 9 <> 0 THEN {_rep("o_custkey")} END AS attributed_rep,
                CASE o_orderkey % 3 WHEN 0 THEN true WHEN 1 THEN false END AS campaign_is_mpc,
                CASE WHEN o_orderstatus <> 'O' THEN o_orderdate + interval '30' day END AS closedate, o_orderdate AS createdate,
                o_orderdate AS pulled_at
            FROM {{orders}}""",
        "appt_backfill": f"""
            SELECT 'USER' || cast(user_id as string) || '@lead.example' AS email,
                CASE WHEN event_id % 11 <> 0 THEN {_rep("event_id")} END AS rep_key, cast(ts as date) AS meeting_date
            FROM {{events}} WHERE event_type = 'purchase' AND event_id % 2 = 0 AND user_id % 3 = 1""",
        "appt_event": f"""
            SELECT {_lead("user_id")} AS lead_email, {_rep("event_id")} AS rep_key, ts AS meeting_at
            FROM {{events}} WHERE event_type = 'purchase' AND event_id % 2 = 1 AND user_id % 6 = 1""",
        "thread_campaign": f"""
            SELECT cast(user_id as string) || '-' || cast(event_id % 20 as string) AS conv_id, {_lead("user_id")} AS lead_email,
                CASE event_id % 3 WHEN 0 THEN true WHEN 1 THEN false END AS is_mpc,
                CASE WHEN event_id % 3 = 0 THEN 'Ann Brand#' || cast(event_id % 25 as string) END AS mpc_candidate,
                'red widget ' || cast(event_id % 400 as string) AS campaign_name, ts AS enriched_at
            FROM {{events}} WHERE event_type = 'signup' AND user_id % 2 = 0""",
        "baseline_thread": f"""
            SELECT {_lead("c_custkey")} AS email, CASE c_custkey % 3 WHEN 0 THEN 'Interested' WHEN 1 THEN 'Call Booked' ELSE 'Other' END AS label,
                CASE c_custkey % 4 WHEN 0 THEN true WHEN 1 THEN false END AS is_mpc,
                CASE WHEN c_custkey % 4 = 0 THEN 'Ann Brand#' || cast(c_custkey % 25 as string) END AS candidate,
                'blue bolt ' || cast(c_custkey % 400 as string) AS campaign
            FROM {{customer}} WHERE c_custkey % 11 = 0""",
    }


DOMAIN_TABLES = tuple(definitions(SPARK))


@dataclass
class Funnel:
    """Lazily built tables by name: given ones first, then derived, then those of ``sf_dir``."""

    spark: SparkSession
    sf_dir: str | None = None
    given: Mapping[str, DataFrame] = field(default_factory=dict)

    @cached_property
    def _sql(self) -> dict[str, str]:
        return definitions(SPARK)

    def __getitem__(self, name: str) -> DataFrame:
        if name in self.given:
            return self.given[name]
        if name in self._sql:
            sources = {t: self[t] for t in BASE_TABLES if f"{{{t}}}" in self._sql[name]}
            return self.spark.sql(self._sql[name], **sources)
        if self.sf_dir is None:
            raise KeyError(name)
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")


def duck_tables(*names: str) -> str:
    """The derived tables as DuckDB common table expressions, without ``WITH``."""
    sql = definitions(DUCK)
    return ", ".join(f"{n} AS ({sql[n].format(**{t: t for t in BASE_TABLES})})" for n in names)
