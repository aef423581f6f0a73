"""Running flows over given tables: captures to domains to requests, asks and answers, the model loop, tables and views changed in place; each with its SQL twin.

Pages are captured part by part: three parts by capture time, some pages twice, some late, some never.
"""

from __future__ import annotations

import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leadmill.functions import extraction as X
from leadmill.operators.buckets import Buckets, JoinView
from leadmill.operators.merge import last_per_key
from leadmill.operators.ranks import scratch
from leadmill.plans.enrich import _HOST, asset_sql, found_sql, quality_sql, reason_sql, system_sql
from leadmill.plans.registry import query, table
from leadmill.plans.views import send_status
from leadmill.streaming import gather
from leadmill.streaming.loops import Parts

END = datetime.datetime(2031, 1, 1)
END_MS = 1924992000000
_MINUTE, _DELAY_MS = 60_000, 60 * 60_000
#: Waiting for a domain's pages, and for a request's domains, in ms.
PATIENCE = (5 * 60 * _MINUTE, 5 * 365 * 24 * 60 * _MINUTE)

# -- captures in parts -----------------------------------------------------------------------------

_CAPTURE = {
    "page_id": "CAST(page_id AS BIGINT)", "domain": _HOST, "ms": "1704067200000 + (CAST(page_id AS BIGINT) * 61 % 960) * 60000", "failed": "page_id % 7 = 2",
    "part": "CASE WHEN page_id % 11 = 3 THEN 2 ELSE CAST(floor((CAST(page_id AS BIGINT) * 61 % 960) / 320) AS INT) END", "html": "html",
}
_MISSED, _TWICE = "page_id % 13 <> 5", "page_id % 5 = 0"


def captures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(page_id, domain, ms, failed, part, html): what comes in, repeats in the part after."""
    columns = [f"{e.replace(chr(92), chr(92) * 2)} AS {c}" for c, e in _CAPTURE.items()]
    one = table(spark, sf_dir, "pages").where(_MISSED).selectExpr(*columns)
    return one.unionByName(one.where(_TWICE).withColumn("part", F.least(F.col("part") + 1, F.lit(2))))


_COLUMNS = ", ".join(f"{e} AS {c}" for c, e in _CAPTURE.items())
CAPTURES_SQL = f"(WITH one AS (SELECT {_COLUMNS} FROM pages WHERE {_MISSED}) SELECT * FROM one UNION ALL SELECT * REPLACE (least(part + 1, 2) AS part) FROM one WHERE {_TWICE})"


def in_three(rows: DataFrame) -> Parts:
    return Parts([rows.where(F.col("part") == k).drop("part").withColumn("ts", F.timestamp_millis("ms")) for k in range(3)])


def _sites(spark, sf_dir):
    """(domain, request, pages, domains): what is expected of each domain and request."""
    s = table(spark, sf_dir, "pages").select(F.expr(_HOST.replace("\\", "\\\\")).alias("domain")).groupBy("domain").agg(F.count("*").cast("int").alias("pages"))
    s = s.withColumn("request", F.concat(F.lit("r"), F.length("domain") % 5))
    return s.join(s.groupBy("request").agg(F.count("*").cast("int").alias("domains")), "request")


_SITES = f"(SELECT domain, 'r' || length(domain) % 5 AS request, pages, CAST(count(*) OVER (PARTITION BY 'r' || length(domain) % 5) AS INTEGER) AS domains FROM (SELECT {_HOST} AS domain, CAST(count(*) AS INTEGER) AS pages FROM pages GROUP BY 1))"


def run_funnel(spark: SparkSession, sf_dir: str, stages: int = 2) -> list[gather.Stage]:
    sites = _sites(spark, sf_dir)

    def pages(stream: DataFrame) -> DataFrame:
        none = F.lit(None).cast("string")
        text = stream.withColumns({"url": none, "final_url": none, "page_type": none, "cleaned_html": F.when(~F.col("failed"), F.col("html")), "markdown": none})
        rows = X.page_emails(text).join(sites.select("domain", "pages"), "domain")
        return rows.select(F.col("domain").alias("key"), F.col("page_id").cast("string").alias("member"), F.col("pages").alias("expected"), "failed", F.col("emails").alias("found"), "ts")

    def domains(stream: DataFrame) -> DataFrame:
        rows = stream.join(sites.select("domain", "request", "domains"), F.col("key") == F.col("domain"))
        return rows.select(F.col("request").alias("key"), F.col("domain").alias("member"), F.col("domains").alias("expected"), (F.col("reason") == "timeout").alias("failed"), "found", "ts")

    return gather.run_chain(in_three(captures(spark, sf_dir)), [pages, domains][:stages], "60 minutes", PATIENCE, END)


def _funnel_steps() -> str:
    """The rounds of domains, part by part, as the watermark lets them be."""
    steps = [
        f"cap AS MATERIALIZED (SELECT DISTINCT part, page_id, c.domain, ms, failed, pages AS expected FROM {CAPTURES_SQL} c JOIN {_SITES} s ON s.domain = c.domain)",
        f"mark AS (SELECT k AS part, CASE WHEN k = 3 THEN {END_MS} ELSE (SELECT max(ms) FROM cap WHERE part <= k) END - {_DELAY_MS} AS w FROM range(4) t(k))",
        "s_ AS (SELECT '' AS domain, 0 AS round, 0::BIGINT AS deadline, false AS closed WHERE false)",
        "m_ AS (SELECT '' AS domain, 0 AS round, 0::BIGINT AS page_id, 0::BIGINT AS ms, false AS failed, 0 AS expected WHERE false)",
    ]
    before = "_"
    for k in range(4):
        low = f"(SELECT w FROM mark WHERE part = {k - 1})" if k else "-1"
        steps += [
            f"a{k} AS MATERIALIZED (SELECT * FROM cap WHERE part = {k} AND ms > {low})",
            f"o{k} AS MATERIALIZED (SELECT * FROM s{before} UNION ALL SELECT domain, {k}, min(ms) + {PATIENCE[0]}, false FROM a{k} WHERE domain NOT IN (SELECT domain FROM s{before}) GROUP BY domain)",
            f"m{k} AS MATERIALIZED (SELECT * FROM m{before} UNION ALL SELECT a.domain, o.round, a.page_id, a.ms, a.failed, a.expected FROM a{k} a JOIN o{k} o ON o.domain = a.domain AND NOT o.closed WHERE NOT EXISTS (SELECT 1 FROM m{before} m WHERE m.domain = a.domain AND m.round = o.round AND m.page_id = a.page_id))",
            f"c{k} AS MATERIALIZED (SELECT m.domain, m.round, max(m.ms) AS ms FROM m{k} m JOIN o{k} o ON o.domain = m.domain AND o.round = m.round AND NOT o.closed GROUP BY 1, 2 HAVING count(*) >= max(expected))",
            f"t{k} AS MATERIALIZED (SELECT o.domain, o.round, o.deadline AS ms FROM o{k} o WHERE NOT closed AND deadline < (SELECT w FROM mark WHERE part = {k}) AND NOT EXISTS (SELECT 1 FROM c{k} c WHERE c.domain = o.domain))",
            f"s{k} AS MATERIALIZED (SELECT o.domain, o.round, deadline, closed OR c.domain IS NOT NULL AS closed FROM o{k} o LEFT JOIN c{k} c ON c.domain = o.domain WHERE deadline >= (SELECT w FROM mark WHERE part = {k}))",
        ]
        before = k
    gone = " UNION ALL ".join(f"SELECT domain, round, '{why}' AS reason, ms FROM {x}{k}" for k in range(4) for x, why in (("c", "complete"), ("t", "timeout")))
    mails = f"SELECT page_id, email FROM (SELECT *, {reason_sql('email')} AS reason FROM ({found_sql('(SELECT page_id, trim(html) AS t FROM pages WHERE page_id % 7 <> 2)', 'page_id', 't')})) WHERE NOT ({system_sql('email')}) AND NOT {asset_sql('email')} AND {quality_sql('email')} >= 50"
    steps += [
        f"gone AS MATERIALIZED ({gone})",
        f"mails AS MATERIALIZED (SELECT DISTINCT page_id::BIGINT AS page_id, email FROM ({mails}))",
        "dom AS MATERIALIZED (SELECT g.domain, g.round, g.reason, count(*) AS pages, CAST(count_if(m.failed) AS BIGINT) AS failed, g.ms FROM gone g JOIN m3 m ON m.domain = g.domain AND m.round = g.round GROUP BY ALL)",
        "their AS MATERIALIZED (SELECT DISTINCT m.domain, m.round, email FROM m3 m JOIN mails USING (page_id))",
    ]
    return "WITH " + ",\n".join(steps)


@query(f"{_funnel_steps()} SELECT domain, reason, pages, failed, coalesce((SELECT string_agg(email, ' ' ORDER BY email) FROM their t WHERE t.domain = dom.domain AND t.round = dom.round), '') AS emails, ms AS closed_ms FROM dom")
def stream_domain_loop(spark, sf_dir):
    """Each domain once per round, when all of its pages are in or its time is up, with the addresses of its pages."""
    out = run_funnel(spark, sf_dir, 1)[0].result()
    return out.select(F.col("key").alias("domain"), "reason", F.col("members").alias("pages"), "failed", F.array_join("found", " ").alias("emails"), F.unix_millis("ts").alias("closed_ms"))


@query(f"""{_funnel_steps()}, one AS (SELECT DISTINCT ON (domain) * FROM dom ORDER BY domain, round),
req AS (SELECT request, max(domains) AS expected, count(*) AS domains, CAST(count_if(reason = 'timeout') AS BIGINT) AS late FROM one JOIN {_SITES} s USING (domain) GROUP BY 1)
SELECT request, CASE WHEN domains = expected THEN 'complete' ELSE 'timeout' END AS reason, r.domains, late,
coalesce((SELECT string_agg(DISTINCT email, ' ' ORDER BY email) FROM one JOIN their USING (domain, round) JOIN {_SITES} s USING (domain) WHERE s.request = r.request), '') AS emails FROM req r""")
def stream_request_funnel(spark, sf_dir):
    """The stage after: each request once, when all of its domains have come out of the stage before."""
    out = run_funnel(spark, sf_dir)[1].result()
    return out.select(F.col("key").alias("request"), "reason", F.col("members").alias("domains"), F.col("failed").alias("late"), F.array_join("found", " ").alias("emails"))


# -- waiting for another request's result ---------------------------------------------------------------

_LATE = "event_id % 97 = 5"
_EVENT_PART = f"CASE WHEN {_LATE} THEN 2 ELSE CAST(floor(day(ts) / 11) AS INT) END"


@query(f"""WITH e AS (SELECT event_id, user_id, event_type, epoch_us(ts) // 1000 AS ms, {_EVENT_PART} AS part FROM events),
w AS (SELECT k AS part, least((SELECT max(ms) FROM e WHERE part <= k AND event_type = 'view'), (SELECT max(ms) FROM e WHERE part <= k AND event_type = 'purchase')) - 3600000 AS w FROM range(3) t(k)),
ok AS (SELECT e.* FROM e LEFT JOIN w ON w.part = e.part - 1 WHERE w.w IS NULL OR e.ms > w.w),
p AS (SELECT a.user_id, a.event_id AS ask_id, b.event_id AS answer_id, b.ms - a.ms AS waited_ms FROM ok a LEFT JOIN ok b ON b.user_id = a.user_id AND b.event_type = 'purchase' AND b.ms BETWEEN a.ms AND a.ms + 3600000 * 6 WHERE a.event_type = 'view')
SELECT DISTINCT ON (ask_id) user_id, ask_id, answer_id, waited_ms FROM p ORDER BY ask_id, waited_ms NULLS LAST, answer_id""")
def stream_wait_reuse(spark, sf_dir):
    """A user's view waits up to six hours for a purchase, and takes the first; rows behind the watermark (an hour) take no part."""
    e = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", F.date_trunc("millisecond", F.col("ts").cast("timestamp")).alias("ts"), F.expr(_EVENT_PART).alias("part"))
    parts = [e.where(F.col("part") == k).drop("part") for k in range(3)]
    # The beats have a key, as rows without one are left out before their time is seen.
    beat = spark.createDataFrame([(None, -1, t, END) for t in ("view", "purchase")], parts[0].schema)
    side = lambda kind: lambda s: s.where(F.col("event_type") == kind).select("user_id", F.col("event_id").alias("id"), "ts")
    pairs = gather.wait_for_answers(Parts([*parts, beat]), side("view"), side("purchase"), "user_id", "6 HOURS", "1 hour")
    return gather.first_answers(pairs.where("ask_id is not null"), "user_id")


# -- the model loop ---------------------------------------------------------------------------------------


def _model_sql() -> str:
    steps = [
        f"cap AS MATERIALIZED (SELECT DISTINCT part, page_id, domain, ms, failed FROM {CAPTURES_SQL})",
        f"mark AS (SELECT k AS part, (SELECT max(ms) FROM cap WHERE part <= k AND NOT failed) - {_DELAY_MS} AS w FROM range(3) t(k))",
        "d_ AS (SELECT 0::BIGINT AS page_id, '' AS domain, 0::BIGINT AS ms, '' AS status WHERE false)",
    ]
    before = "_"
    for k in range(3):
        low = f"(SELECT w FROM mark WHERE part = {k - 1})" if k else "-1"
        steps += [
            f"n{k} AS MATERIALIZED (SELECT page_id, domain, ms, 'succeeded' AS status FROM cap WHERE part = {k} AND NOT failed AND ms > {low} AND page_id NOT IN (SELECT page_id FROM d{before}))",
            f"k{k} AS MATERIALIZED (SELECT * FROM d{before} UNION ALL SELECT * FROM n{k})",
            f"d{k} AS MATERIALIZED (SELECT * FROM k{k} UNION ALL SELECT DISTINCT page_id, domain, ms, 'failed' FROM cap WHERE failed AND ms <= (SELECT max(ms) FROM k{k}) AND page_id NOT IN (SELECT page_id FROM k{k}))",
        ]
        before = k
    return f"WITH {', '.join(steps)} SELECT d.page_id, d.domain, d.status, CASE WHEN d.status = 'succeeded' THEN length(html) END AS found FROM d2 d JOIN pages p ON p.page_id = d.page_id"


@query(_model_sql())
def stream_model_loop(spark, sf_dir):
    """Each page is extracted once, however often it is captured; every second batch folds in the crawls that failed by then.

    The model is a rule here: how long the page is.
    """
    every = captures(spark, sf_dir)
    parts = in_three(every.where(~F.col("failed")))
    lost = every.where("failed").select("page_id", "domain", F.timestamp_millis("ms").alias("ts")).distinct()
    work = lambda batch: batch.select("page_id", "domain", "ts", F.length("html").cast("long").alias("found"))
    return gather.extract_once(parts, "page_id", "60 minutes", work, lost, 2).select("page_id", "domain", "status", "found")


# -- tables in buckets and views by deltas ----------------------------------------------------------------

_HALF = "event_id < (SELECT max(event_id) / 2 FROM events)"


def _event_halves(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "value")
    half = e.agg((F.max("event_id") / 2).alias("_half"))
    first = e.crossJoin(F.broadcast(half))
    old, new = first.where("event_id < _half").drop("_half"), first.where("event_id >= _half").drop("_half")
    return old, new


@query(f"""WITH o AS (SELECT DISTINCT ON (user_id) * EXCLUDE (ts, props) FROM events WHERE {_HALF} ORDER BY user_id, event_id DESC), n AS (SELECT DISTINCT ON (user_id) * EXCLUDE (ts, props) FROM events WHERE NOT {_HALF} AND user_id % 3 = 0 ORDER BY user_id, event_id DESC)
SELECT * FROM n UNION ALL SELECT * FROM o WHERE user_id NOT IN (SELECT user_id FROM n)""")
def bucket_upsert(spark, sf_dir):
    """The newer half's events of every third user replace the older half's, in the buckets they fall into."""
    old, new = _event_halves(spark, sf_dir)
    latest = [F.desc("event_id")]
    t = Buckets(last_per_key(old, ["user_id"], latest), scratch(spark), ["user_id"])
    t.upsert(new.where("user_id % 3 = 0"), latest)
    return t.read()


@query(f"SELECT event_id, user_id, event_type, value FROM events e WHERE NOT {_HALF} AND user_id % 4 = 1 UNION ALL SELECT event_id, user_id, event_type, value FROM events WHERE {_HALF} AND user_id NOT IN (SELECT user_id FROM events WHERE NOT {_HALF} AND user_id % 4 = 1) AND user_id % 10 <> 0")
def bucket_replace(spark, sf_dir):
    """All events of a user are deleted and those of the newer half inserted, for every fourth user; every tenth goes."""
    old, new = _event_halves(spark, sf_dir)
    t = Buckets(old, scratch(spark), ["user_id"])
    t.delete(old.where("user_id % 10 = 0").select("user_id"))
    t.replace(new.where("user_id % 4 = 1"))
    return t.read()


def view_parts(spark, sf_dir):
    """(orders as enrichment, events as tracker), each (lead_id, seen, what) with the batch it comes in."""
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("lead_id"), F.col("o_orderkey").cast("long").alias("seen"), F.col("o_orderpriority").alias("what"), F.expr("CASE WHEN o_custkey % 40 <> 7 THEN 0 WHEN o_orderkey % 2 = 0 THEN 1 ELSE 3 END").alias("batch"))
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("lead_id"), F.col("event_id").cast("long").alias("seen"), F.col("event_type").alias("what"), F.expr("CASE WHEN user_id % 50 <> 3 THEN 0 WHEN event_id % 2 = 0 THEN 2 ELSE 3 END").alias("batch"))
    return o, e


def leads_by_deltas(spark, sf_dir) -> tuple[JoinView, list[list[int]]]:
    o, e = view_parts(spark, sf_dir)
    latest = [F.desc("seen")]
    of = lambda rows, k: rows.where(F.col("batch") == k).drop("batch")
    tables = [Buckets(last_per_key(of(rows, 0), ["lead_id"], latest), scratch(spark), ["lead_id"]) for rows in (o, e)]

    def combine(enriched: DataFrame, tracked: DataFrame) -> DataFrame:
        a = enriched.select("lead_id", F.col("seen").alias("enrichment_id"), F.col("what").alias("priority"))
        b = tracked.select("lead_id", F.col("seen").alias("event_id"), F.col("what").alias("tracker"))
        return a.join(b, "lead_id", "full").withColumn("send_status", send_status(F.col("tracker") == "purchase", F.when(F.col("tracker") == "error", "failed"), F.col("priority")))

    view = JoinView(*tables, scratch(spark), combine)
    touched = [view.apply(latest, left=of(o, 1)), view.apply(latest, right=of(e, 2)), view.apply(latest, of(o, 3), of(e, 3))]
    return view, touched


_BATCHES = {
    "o": "(SELECT o_custkey AS lead_id, o_orderkey::BIGINT AS seen, o_orderpriority AS what, CASE WHEN o_custkey % 40 <> 7 THEN 0 WHEN o_orderkey % 2 = 0 THEN 1 ELSE 3 END AS batch FROM orders)",
    "e": "(SELECT user_id AS lead_id, event_id::BIGINT AS seen, event_type AS what, CASE WHEN user_id % 50 <> 3 THEN 0 WHEN event_id % 2 = 0 THEN 2 ELSE 3 END AS batch FROM events)",
}


@query(f"""WITH o AS (SELECT DISTINCT ON (lead_id) * FROM {_BATCHES['o']} ORDER BY lead_id, batch DESC, seen DESC), e AS (SELECT DISTINCT ON (lead_id) * FROM {_BATCHES['e']} ORDER BY lead_id, batch DESC, seen DESC)
SELECT lead_id, o.seen AS enrichment_id, o.what AS priority, e.seen AS event_id, e.what AS tracker, CASE WHEN e.what = 'purchase' THEN 'CONTACTED' WHEN e.what = 'error' THEN 'READY' ELSE coalesce(o.what, 'VERIFY') END AS send_status FROM o FULL JOIN e USING (lead_id)""")
def view_by_deltas(spark, sf_dir):
    """The leads view after a load and three batches, each of which rewrites only the buckets of its keys."""
    return leads_by_deltas(spark, sf_dir)[0].view.read()
