"""Views and mail queries over the lead tables, each with its SQL twin."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leadmill.functions import text as T
from leadmill.operators import merge, ranks, sheets
from leadmill.plans.leads import lead_table, sql
from leadmill.plans.registry import Sample, query, table
from leadmill.plans.views import mail_status, send_status

E, M, K, A, S = (sql(n) for n in ("enrichment", "mail_content", "mail_tracker", "master", "source"))
_ADDRESS = "CASE WHEN email LIKE '{%' THEN json_extract_string(email, '$.email') END"
KEY = ["request_id", "domain"]


def address(df: DataFrame) -> DataFrame:
    """``df`` with ``address``, the e-mail inside its JSON, NULL if there is none."""
    return df.withColumn("address", F.nullif(F.get_json_object("email", "$.email"), F.lit("")))


def proof(emails_json, wanted):
    """URL of the first evidence of the first entry for an address; evidence may be an object or a list."""
    entries = F.filter(F.from_json(emails_json, "array<struct<email:string,evidence:string>>"), lambda e: e["email"] == wanted)
    first = F.get(entries, F.lit(0))["evidence"]
    return F.coalesce(F.get_json_object(first, "$.url"), F.get_json_object(first, "$[0].url"), F.lit(""))


@query(f"""WITH e AS (SELECT *, nullif({_ADDRESS}, '') AS address FROM {E} WHERE status = 'succeeded'), l AS (SELECT * FROM e WHERE address IS NOT NULL QUALIFY row_number() OVER (PARTITION BY domain ORDER BY created_us DESC, request_id) = 1),
s AS (SELECT DISTINCT email FROM {K} WHERE send_status = 'SENT'), t AS (SELECT request_id, domain, arg_max(coalesce(send_status, ''), (updated_us, email)) AS st FROM {K} GROUP BY 1, 2)
SELECT l.request_id, l.job_id, l.organization, l.domain, coalesce(json_extract_string(l.company, '$.name'), '') AS company, coalesce(json_extract_string(l.company, '$.score'), '') AS company_score, address AS email, coalesce(json_extract_string(l.email, '$.score'), '') AS email_score,
coalesce(l.contacts, '') AS contacts, l.description, coalesce((SELECT coalesce(json_extract_string(x, '$.evidence.url'), json_extract_string(x, '$.evidence[0].url')) FROM (SELECT unnest(from_json(l.emails_json, '["JSON"]')) AS x) WHERE json_extract_string(x, '$.email') = l.address LIMIT 1), '') AS verification_link,
CASE WHEN s.email IS NOT NULL THEN 'CONTACTED' WHEN upper(t.st) = 'FAILED' THEN 'READY' ELSE coalesce(m.send_status, 'VERIFY') END AS send_status
FROM l LEFT JOIN {M} m USING (request_id, domain) LEFT JOIN s ON s.email = address LEFT JOIN t USING (request_id, domain)""")
def leads_sheet(spark, sf_dir):
    """A row per domain with an address: contacted if that address was written to in any request."""
    e = address(lead_table(spark, sf_dir, "enrichment").where("status = 'succeeded'")).where("address is not null")
    e = merge.last_per_key(e, ["domain"], [F.desc("created_us"), F.asc("request_id")])
    k = lead_table(spark, sf_dir, "mail_tracker")
    sent = k.where("send_status = 'SENT'").select(F.col("email").alias("address")).distinct().withColumn("sent", F.lit(True))
    now = k.groupBy(*KEY).agg(F.max_by(F.coalesce("send_status", F.lit("")), F.struct("updated_us", "email")).alias("tracker"))
    mail = lead_table(spark, sf_dir, "mail_content").select(*KEY, F.col("send_status").alias("mail"))
    d = e.join(mail, KEY, "left").join(sent, "address", "left").join(now, KEY, "left")
    text = lambda c, p: F.coalesce(F.get_json_object(c, p), F.lit(""))
    return d.select(
        "request_id", "job_id", "organization", "domain", text("company", "$.name").alias("company"), text("company", "$.score").alias("company_score"), F.col("address").alias("email"), text("email", "$.score").alias("email_score"),
        F.coalesce("contacts", F.lit("")).alias("contacts"), "description", proof(F.col("emails_json"), F.col("address")).alias("verification_link"), send_status(F.coalesce("sent", F.lit(False)), F.col("tracker"), F.col("mail")).alias("send_status"),
    )


_UP = lambda c: f"CASE WHEN coalesce({c}, '') = '' THEN 'NOT_STARTED' ELSE upper({c}) END"
_STATES = ["crawl_status", "extraction_status", "enrichment_status", "mail_write_status"]


@query(f"""WITH c AS (SELECT DISTINCT e.request_id, e.domain FROM (SELECT *, {_ADDRESS} AS address FROM {E}) e JOIN {K} k ON k.email = e.address AND k.request_id = e.request_id WHERE k.send_status = 'SENT')
SELECT row_number() OVER (ORDER BY CASE source WHEN 'hunter' THEN 0 WHEN 'hunter, google_maps' THEN 1 ELSE 2 END, lower(coalesce(organization, '')), lower(trim(a.domain)), a.request_id) AS rank, a.request_id, job_id, coalesce(organization, '') AS organization, source, lower(trim(a.domain)) AS domain,
{', '.join(f'{_UP(s)} AS {s}' for s in _STATES)}, CASE WHEN c.domain IS NOT NULL THEN 'CONTACTED' ELSE {_UP('mail_send_status')} END AS mail_send_status FROM {A} a LEFT JOIN c ON c.request_id = a.request_id AND c.domain = a.domain WHERE lower(trim(a.domain)) <> ''""")
def master_sheet(spark, sf_dir):
    """The funnel of every domain in order of source, name and domain; contacted only within its own request."""
    k = lead_table(spark, sf_dir, "mail_tracker").where("send_status = 'SENT'").select("request_id", F.col("email").alias("address")).distinct()
    sent = address(lead_table(spark, sf_dir, "enrichment")).join(k, ["request_id", "address"], "left_semi").select(*KEY).distinct().withColumn("sent", F.lit(True))
    d = lead_table(spark, sf_dir, "master").join(sent, KEY, "left").withColumn("domain", F.lower(F.trim("domain"))).where("domain <> ''")
    priority = F.when(F.col("source") == "hunter", 0).when(F.col("source") == "hunter, google_maps", 1).otherwise(2)
    d = d.withColumns({"organization": F.coalesce("organization", F.lit("")), "_p": priority, "_o": F.lower(F.coalesce("organization", F.lit("")))})
    d = ranks.numbered(d, [F.col(c) for c in ("_p", "_o", "domain", "request_id")], "rank")
    sending = F.when(F.col("sent"), "CONTACTED").otherwise(T.status_or_not_started(F.col("mail_send_status")))
    return d.select("rank", "request_id", "job_id", "organization", "source", "domain", *(T.status_or_not_started(F.col(s)).alias(s) for s in _STATES), sending.alias("mail_send_status"))


@query(f"""SELECT m.request_id, m.domain, coalesce(m.company, '') AS company, m.email, m.subject, m.content, '' AS test_recipient, CASE WHEN upper(k.send_status) = 'FAILED' THEN 'FAILED' ELSE coalesce(nullif(m.send_status, ''), 'VERIFY') END AS send_status, coalesce(m.comments, '') AS comments, k.thread_id
FROM {M} m LEFT JOIN {K} k ON k.request_id = m.request_id AND k.domain = m.domain WHERE m.content <> ''""")
def mails_sheet(spark, sf_dir):
    """Written mails beside their tracker rows; a domain with several of those has as many rows."""
    k = lead_table(spark, sf_dir, "mail_tracker").select(*KEY, "thread_id", F.col("send_status").alias("tracker"))
    d = lead_table(spark, sf_dir, "mail_content").where("content <> ''").join(k, KEY, "left")
    empty = lambda c: F.coalesce(F.col(c), F.lit("")).alias(c)
    return d.select(*KEY, empty("company"), "email", "subject", "content", F.lit("").alias("test_recipient"), mail_status(F.col("tracker"), F.col("send_status")).alias("send_status"), empty("comments"), "thread_id")


_TIME = lambda c: f"CASE WHEN {c} IS NULL THEN '' ELSE strftime(make_timestamp({c}), '%Y-%m-%d %H:%M:%S') END"


@query(f"SELECT row_number() OVER (ORDER BY sent_us DESC NULLS LAST, created_us DESC, request_id, domain, email) AS rank, domain, email, upper(coalesce(send_status, '')) AS send_status, {_TIME('sent_us')} AS sent_at, upper(coalesce(reply_status, '')) AS reply_status, {_TIME('received_us')} AS received_at FROM {K}")
def tracking_sheet(spark, sf_dir):
    """All tracked mails, the last sent first and the unsent last."""
    d = lead_table(spark, sf_dir, "mail_tracker")
    d = ranks.numbered(d, [F.desc_nulls_last("sent_us"), F.desc("created_us"), F.col("request_id"), F.col("domain"), F.col("email")], "rank")
    shown = lambda c: F.coalesce(F.date_format(F.timestamp_micros(c), "yyyy-MM-dd HH:mm:ss"), F.lit(""))
    upper = lambda c: F.upper(F.coalesce(c, F.lit("")))
    return d.select("rank", "domain", "email", upper("send_status").alias("send_status"), shown("sent_us").alias("sent_at"), upper("reply_status").alias("reply_status"), shown("received_us").alias("received_at"))


TERMS, COUNTRIES, HEADCOUNTS = ["PROMO BURNISHED NICKEL", "economy plated tin"], ["Germany", "Austria"], ["1-10", "11-50", "51-200", "201-500"]
_PLACE = lambda items, x, other: "CASE " + x + " " + " ".join(f"WHEN '{i}' THEN {n}" for n, i in enumerate(items)) + f" ELSE {other} END"
_COUNTRY = "CASE WHEN coalesce(trim(location), '') IN ('', '-') THEN '' ELSE trim(split_part(trim(location), '/', 1)) END"
_ORDER = f"{_PLACE([t.lower() for t in TERMS], 'lower(trim(query))', 999999)}, {_PLACE(COUNTRIES, _COUNTRY, 999999)}, lower(trim(organization)), lower(trim(domain))"


def _place(items, x, other):
    at = F.array_position(F.array(*map(F.lit, items)), x)
    return F.when(at > 0, at - 1).otherwise(other)


def _source_order():
    country = F.when(F.coalesce(F.trim("location"), F.lit("")).isin("", "-"), "").otherwise(F.trim(F.split_part(F.trim("location"), F.lit("/"), F.lit(1))))
    return [_place([t.lower() for t in TERMS], F.lower(F.trim("query")), 999999), _place(COUNTRIES, country, 999999), F.lower(F.trim("organization")), F.lower(F.trim("domain"))]


@query(f"SELECT row_number() OVER (ORDER BY {_PLACE(HEADCOUNTS, 'trim(headcount)', 999)}, {_ORDER}) AS rank, organization, domain, location, headcount, query FROM {S}")
def hunter_sheet(spark, sf_dir):
    """Discovered companies by headcount, the caller's order of queries and countries, name and domain."""
    d = ranks.numbered(lead_table(spark, sf_dir, "source"), [_place(HEADCOUNTS, F.trim("headcount"), 999), *_source_order()], "rank")
    return d.select("rank", *sheets.SPECS["hunter"].columns)


@query(f'SELECT row_number() OVER (ORDER BY {_ORDER}) AS rank, organization AS "Organization", domain AS "Domain", location AS "Location", query AS "Search Query" FROM {S}')
def maps_sheet(spark, sf_dir):
    """Places by the caller's order of queries and countries, name and domain, under the view's headers."""
    d = ranks.numbered(lead_table(spark, sf_dir, "source"), _source_order(), "rank")
    spec = sheets.SPECS["maps"]
    return sheets.Spec(["rank", *spec.columns], ["rank", *spec.headers]).shown(d)


@query(f"SELECT ((rank - 1) // 1000)::BIGINT AS chunk, count(*) + CASE WHEN max(rank) = max(max(rank)) OVER () THEN 2 ELSE 0 END AS n_rows FROM (SELECT row_number() OVER (ORDER BY domain) AS rank FROM {S}) GROUP BY 1")
def sheet_export(spark, sf_dir):
    """A view written in chunks of 1000 rows with two blank rows at its end, and what the chunks hold."""
    return sheets.export(lead_table(spark, sf_dir, "source"), sheets.SPECS["hunter"].columns, [F.col("domain")], ranks.scratch(spark))


@query(f"SELECT e.request_id, max(k.updated_us) AS updated_us, count(*) AS n FROM {K} k JOIN (SELECT *, {_ADDRESS} AS address FROM {E}) e ON k.email = e.address GROUP BY 1")
def tracker_highwater(spark, sf_dir):
    """The last tracker update of each request's selected addresses."""
    k = lead_table(spark, sf_dir, "mail_tracker").select(F.col("email").alias("address"), F.col("updated_us").alias("tracked_us"))
    return address(lead_table(spark, sf_dir, "enrichment")).join(k, "address").groupBy("request_id").agg(F.max("tracked_us").alias("updated_us"), F.count("*").alias("n"))


@query(f"SELECT *, count(*) OVER () AS total FROM (SELECT request_id, domain, updated_us FROM {M} WHERE coalesce(content, '') = '' AND upper(send_status) = 'OK') QUALIFY row_number() OVER (ORDER BY updated_us, request_id, domain) <= 50")
def mail_pending(spark, sf_dir):
    """The next batch of 50 mails to write, and how many wait in all."""
    d = lead_table(spark, sf_dir, "mail_content").where("coalesce(content, '') = '' and upper(send_status) = 'OK'").select(*KEY, "updated_us")
    total = d.agg(F.count("*").alias("total"))
    return d.orderBy("updated_us", *KEY).limit(50).crossJoin(F.broadcast(total))


@query(f"SELECT request_id, count(*) AS n, count(*) FILTER (upper(send_status) = 'OK') AS written FROM {M} GROUP BY 1")
def mail_batch_ingest(spark, sf_dir):
    """Approved mails are written as one batch: upserted under a new job, the request's rows finalized, and counted."""
    m = lead_table(spark, sf_dir, "mail_content")
    batch = m.where("upper(send_status) = 'OK'").withColumns({"job_id": F.lit("new"), "updated_us": F.col("updated_us") + 1})
    after = merge.upsert(m, batch, KEY, [F.desc("updated_us")])
    after, _ = merge.finalize(after, F.col("job_id") == "new", comments="written")
    return after.groupBy("request_id").agg(F.count("*").alias("n"), F.count_if((F.col("job_id") == "new") & (F.col("comments") == "written")).alias("written"))


REPLIES = Sample("thread_id string, reply_status string, received string", (("t1view", "REPLIED", "2024-05-01T10:00:00Z"), ("t1view", "BOUNCED", "2024-05-02T10:00:00+02:00"), ("t2click", "REPLIED", "not a time"), ("none", "REPLIED", None), (None, "REPLIED", None)))


@query(f"SELECT r.thread_id, reply_status, epoch_us(try_cast(received AS TIMESTAMPTZ)) AS received_us, EXISTS (SELECT 1 FROM {K} k WHERE k.thread_id = r.thread_id) AS matched FROM {REPLIES.sql} r")
def mail_replies(spark, sf_dir):
    """Replies come by thread: which of them found their mail."""
    r = REPLIES.df(spark).select("thread_id", "reply_status", F.unix_micros(F.try_to_timestamp("received")).alias("received_us"))
    _, answered = merge.update_by_other_key(lead_table(spark, sf_dir, "mail_tracker"), r, "thread_id", ["received_us", "reply_status"])
    return answered.select("thread_id", "reply_status", "received_us", "matched")


@query(f"""SELECT thread_id, CASE thread_id WHEN 't1view' THEN 'BOUNCED' WHEN 't2click' THEN 'REPLIED' ELSE reply_status END AS reply_status FROM {K}""")
def mail_replies_applied(spark, sf_dir):
    r = REPLIES.df(spark).select("thread_id", "reply_status", F.unix_micros(F.try_to_timestamp("received")).alias("received_us"))
    after, _ = merge.update_by_other_key(lead_table(spark, sf_dir, "mail_tracker"), r, "thread_id", ["received_us", "reply_status"])
    return after.select("thread_id", "reply_status")


@query(f"SELECT thread_id FROM {K} WHERE request_id = 'r1' AND send_status = 'SENT'")
def tracker_search(spark, sf_dir):
    """A search by what is given; what is not asks nothing."""
    return merge.where_all(lead_table(spark, sf_dir, "mail_tracker"), request_id="r1", domain=None, send_status="SENT", email=None).select("thread_id")


@query(f"SELECT thread_id FROM {K} WHERE domain NOT IN (SELECT domain FROM {A} WHERE extraction_status = 'failed')")
def delete_by_key(spark, sf_dir):
    """The rows of domains whose extraction failed are deleted."""
    gone = lead_table(spark, sf_dir, "master").where("extraction_status = 'failed'").select("domain")
    return merge.delete_by_key(lead_table(spark, sf_dir, "mail_tracker"), gone).select("thread_id")


# -- queues and reuse ------------------------------------------------------------------------


@query(f"SELECT DISTINCT sheet_id, request_id FROM {E} WHERE request_id IN (SELECT request_id FROM {A} WHERE coalesce(crawl_status, '') = '')")
def pending_requests(spark, sf_dir):
    """Sheets and requests that still have a domain to crawl."""
    waiting = lead_table(spark, sf_dir, "master").where("coalesce(crawl_status, '') = ''").select("request_id").distinct()
    return lead_table(spark, sf_dir, "enrichment").join(waiting, "request_id", "left_semi").select("sheet_id", "request_id").distinct()


@query(f"SELECT request_id, min(domain) AS domain, count(*) AS waiting FROM {A} WHERE extraction_status IS NOT NULL AND enrichment_status IS NULL GROUP BY 1")
def queue_heads(spark, sf_dir):
    """The next domain of each request's queue, and the queue's length."""
    d = lead_table(spark, sf_dir, "master").where("extraction_status is not null and enrichment_status is null")
    return d.groupBy("request_id").agg(F.min("domain").alias("domain"), F.count("*").alias("waiting"))


@query(f"SELECT request_id, job_id, count(*) AS n, min(created_us) AS first_us FROM {E} GROUP BY 1, 2 ORDER BY first_us DESC, request_id LIMIT 1")
def latest_request(spark, sf_dir):
    """The request that began last, with its size."""
    g = lead_table(spark, sf_dir, "enrichment").groupBy("request_id", "job_id").agg(F.count("*").alias("n"), F.min("created_us").alias("first_us"))
    return g.orderBy(F.desc("first_us"), "request_id").limit(1)


@query(f"""WITH m AS (SELECT request_id, organization, 'n' || (hash % 50) || '.de' AS domain, crawl_status FROM (SELECT *, coalesce(length(organization), 0) * 7 + length(source) + length(domain) AS hash FROM {A})),
d AS (SELECT domain, arg_max(request_id, (coalesce(organization, ''), request_id)) AS donor FROM m WHERE crawl_status = 'succeeded' GROUP BY 1)
SELECT request_id, organization, m.domain, CASE WHEN coalesce(crawl_status, '') = '' AND donor IS NOT NULL THEN 'reused' ELSE crawl_status END AS crawl_status, CASE WHEN coalesce(crawl_status, '') = '' THEN donor END AS donor FROM m LEFT JOIN d USING (domain)""")
def reuse_results(spark, sf_dir):
    """Domains that wait take the results of the last request that succeeded with them."""
    h = F.coalesce(F.length("organization"), F.lit(0)) * 7 + F.length("source") + F.length("domain")
    m = lead_table(spark, sf_dir, "master").select("request_id", "organization", F.concat(F.lit("n"), h % 50, F.lit(".de")).alias("domain"), "crawl_status")
    donors = m.where("crawl_status = 'succeeded'").groupBy("domain").agg(F.max_by("request_id", F.struct(F.coalesce("organization", F.lit("")), "request_id")).alias("_donor"))
    waits = F.coalesce("crawl_status", F.lit("")) == ""
    d = m.join(donors, "domain", "left")
    return d.select("request_id", "organization", "domain", F.when(waits & F.col("_donor").isNotNull(), "reused").otherwise(F.col("crawl_status")).alias("crawl_status"), F.when(waits, F.col("_donor")).alias("donor"))


@query(f"SELECT request_id, domain, 'https://' || domain || '/' AS url, 'failed' AS status FROM {A} WHERE crawl_status = 'failed' AND domain <> '' AND (request_id, domain) NOT IN (SELECT request_id, domain FROM {E} WHERE status = 'succeeded')")
def failed_crawl_rows(spark, sf_dir):
    """Failed crawls without an extraction get a failed one at their home page."""
    failed = lead_table(spark, sf_dir, "master").where("crawl_status = 'failed' and domain <> ''").select(*KEY)
    done = lead_table(spark, sf_dir, "enrichment").where("status = 'succeeded'").select(*KEY)
    rows = failed.join(done, KEY, "left_anti").select(*KEY, F.concat(F.lit("https://"), "domain", F.lit("/")).alias("url"), F.lit("failed").alias("status"))
    return merge.insert_if_absent(rows.limit(0), rows, [*KEY, "url"])


@query(f"SELECT domain, count(DISTINCT request_id) AS requests FROM {K} WHERE domain IN (SELECT domain FROM {E} WHERE status = 'succeeded') GROUP BY 1")
def previously_succeeded(spark, sf_dir):
    """Tracked domains that any request enriched before."""
    good = lead_table(spark, sf_dir, "enrichment").where("status = 'succeeded'").select("domain")
    return lead_table(spark, sf_dir, "mail_tracker").join(good, "domain", "left_semi").groupBy("domain").agg(F.count_distinct("request_id").alias("requests"))


# -- jobs ---------------------------------------------------------------------------------------


@query("SELECT user_id, arg_max(event_type, (epoch_us(ts), event_id)) AS state, min(epoch_us(ts)) AS first_us, max(epoch_us(ts)) AS last_us, count(*) AS n FROM events GROUP BY 1")
def job_states(spark, sf_dir):
    """Events as a log: the last state of each user's job, its first and last entry."""
    from leadmill.plans.registry import micros

    us = micros(F.col("ts"))
    return table(spark, sf_dir, "events").groupBy("user_id").agg(F.max_by("event_type", F.struct(us, F.col("event_id"))).alias("state"), F.min(us).alias("first_us"), F.max(us).alias("last_us"), F.count("*").alias("n"))


@query(f"SELECT request_id, view FROM (SELECT request_id, max(updated_us % 3 = 0) AS e, max(updated_us % 7 = 1) AS m FROM {E} GROUP BY 1), (VALUES ('jobs'), ('master'), ('leads'), ('mails')) v(view) WHERE (e OR m) AND (view = 'master' OR view = 'leads' OR view = 'jobs' AND e OR view = 'mails' AND m)")
def views_to_refresh(spark, sf_dir):
    """Which views a request's changes call for: jobs after enrichment, mails after mail, master and leads after any."""
    from leadmill.operators.funnel import views_due

    flags = lead_table(spark, sf_dir, "enrichment").groupBy("request_id").agg(F.max(F.col("updated_us") % 3 == 0).alias("enrichment_changed"), F.max(F.col("updated_us") % 7 == 1).alias("mail_changed"))
    return views_due(flags, "request_id")


