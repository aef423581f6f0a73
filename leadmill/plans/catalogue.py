"""Registered queries: the engine's operators over the driver's tables, each with its SQL twin.

The driver's tables have no leads, so lead concepts are projected onto them: pages are
captured pages, orders and line items a funnel with its pages, events a mail tracker.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leadmill.functions import domain as D
from leadmill.functions import email as E
from leadmill.functions import text as T
from leadmill.operators import funnel, links, merge, ranks, select
from leadmill.plans import enrich, views
from leadmill.plans.registry import ORACLES, QUERIES, micros, query, table

# Pieces of SQL that several twins share.
HOST_SQL = r"""regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(trim(url)), '^([a-z][a-z0-9+.-]*:)?//', ''), '[/?#].*$', ''), '^www\.', ''), ':\d+$', ''), '^[a-z][a-z0-9+.-]*:', ''), '\.+$', '')"""
DOMAIN_SQL = rf"CASE WHEN contains({HOST_SQL}, '.') AND regexp_matches({HOST_SQL}, '^[a-z0-9]([a-z0-9-]*[a-z0-9])?(\.[a-z0-9]([a-z0-9-]*[a-z0-9])?)*$') THEN {HOST_SQL} END"
ROOT_SQL = "array_to_string(string_split(domain, '.')[-2:], '.')"
REG_SQL = "CASE WHEN len(string_split(domain, '.')) >= 3 AND string_split(domain, '.')[-2] IN ('co','com','org','net','gov','edu') THEN array_to_string(string_split(domain, '.')[-3:], '.') ELSE array_to_string(string_split(domain, '.')[-2:], '.') END"
PAGE_TYPE_SQL = "CASE WHEN regexp_matches(lower(url), 'impressum|imprint') THEN 'impressum' WHEN regexp_matches(lower(url), 'kontakt|contact') THEN 'contact' WHEN regexp_matches(lower(url), 'datenschutz|privacy') THEN 'privacy' ELSE 'other' END"
EMAILS_SQL = r"(SELECT DISTINCT doc_id, lower(unnest(regexp_extract_all(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,24}'))) AS email FROM documents)"


# -- domains and URLs ------------------------------------------------------------------


@query(f"SELECT domain, count(*) AS pages, {ROOT_SQL} AS root, {REG_SQL} AS registrable, string_split(domain, '.')[-1] AS tld, regexp_matches(domain, '(^|\\.)(facebook|instagram)\\.com$') AS social FROM (SELECT {DOMAIN_SQL} AS domain FROM pages) WHERE domain IS NOT NULL GROUP BY domain")
def domain_normalize(spark, sf_dir):
    d = table(spark, sf_dir, "pages").select(D.normalize_domain(F.col("url")).alias("domain")).where("domain is not null")
    c = F.col("domain")
    return d.groupBy("domain").agg(F.count("*").alias("pages")).select("domain", "pages", D.root_domain(c).alias("root"), D.registrable_domain(c).alias("registrable"), D.tld(c).alias("tld"), D.is_social(c).alias("social"))


@query(f"SELECT {PAGE_TYPE_SQL} AS page_type, count(*) AS pages FROM pages GROUP BY ALL")
def page_type_infer(spark, sf_dir):
    return table(spark, sf_dir, "pages").groupBy(D.page_type(F.col("url")).alias("page_type")).agg(F.count("*").alias("pages"))


@query(r"SELECT page_id, regexp_replace(regexp_replace(url, '[?#].*$', ''), '/+$', '') AS canonical FROM pages")
def url_canonical(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", D.canonical_url(F.col("url")).alias("canonical"))


@query(rf"""SELECT page_id, regexp_replace(regexp_replace(regexp_replace(lower(trim(url)), '^[a-z][a-z0-9+.-]*://', ''), '/.*$', ''), '^www\.', '') AS loose,
rtrim(regexp_replace(string_split(replace(replace(lower(trim(url)), 'https://', ''), 'http://', ''), '/')[1], '^www\.', ''), '.') AS literal FROM pages""")
def domain_other_readings(spark, sf_dir):
    u = F.col("url")
    return table(spark, sf_dir, "pages").select("page_id", D.normalize_domain_loose(u).alias("loose"), D.normalize_domain_text(u).alias("literal"))


@query(f"SELECT domain, count(*) AS pages FROM (SELECT {DOMAIN_SQL} AS domain FROM pages UNION ALL SELECT unnest(['xn--bhler-hrimarkt-vpbg.de', 'xn--superimmunitt-mfb.de'])) GROUP BY 1")
def idna_domain(spark, sf_dir):
    """Hosts outside ASCII through the Arrow UDF, the pages' own hosts beside them; what the two must become is stated beside."""
    given = table(spark, sf_dir, "pages").select("url")
    extra = spark.createDataFrame([("http://www.böhler-hörimarkt.de/",), ("https://superimmunität.de/x",)], "url string")
    return D.with_ascii_domain(given.unionByName(extra), "url").groupBy("domain").agg(F.count("*").alias("pages"))


@query(f"""WITH h AS (SELECT DISTINCT {DOMAIN_SQL} AS domain FROM pages), p AS (SELECT DISTINCT {REG_SQL} AS parent FROM h WHERE domain IS NOT NULL)
SELECT domain AS host, parent FROM h JOIN p ON domain = parent OR ends_with(domain, '.' || parent)""")
def suffix_join(spark, sf_dir):
    hosts = table(spark, sf_dir, "pages").select(D.normalize_domain(F.col("url")).alias("host")).where("host is not null").distinct()
    parents = hosts.select(D.registrable_domain(F.col("host")).alias("parent")).distinct()
    return funnel.suffix_join(hosts, parents, "host", "parent").select("host", "parent")


# -- e-mail ------------------------------------------------------------------------------


def _emails(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.explode(E.extract(F.col("text"))).alias("email"))


@query(f"SELECT doc_id, email FROM {EMAILS_SQL}")
def email_extract(spark, sf_dir):
    return _emails(spark, sf_dir)


_LOCAL, _DOM = "split_part(email, '@', 1)", "split_part(email, '@', 2)"
REASON_SQL = enrich.reason_sql("email")
QUALITY_SQL = f"""CASE WHEN reason IS NULL THEN greatest(0, least(100, 100 - CASE WHEN length({_LOCAL}) < 2 THEN 10 ELSE 0 END - CASE WHEN length({_DOM}) < 4 THEN 10 ELSE 0 END
+ CASE WHEN regexp_matches({_LOCAL}, 'info|contact|hello|mail|office') THEN 10 ELSE 0 END - CASE WHEN {_LOCAL} IN ('a','b','c','x','y','z') THEN 30 ELSE 0 END
+ CASE WHEN length(email) BETWEEN 10 AND 50 THEN 5 ELSE 0 END - CASE WHEN length(email) > 100 THEN 20 ELSE 0 END)) ELSE 0 END"""


@query(f"SELECT doc_id, email, reason, {QUALITY_SQL} AS quality, {_LOCAL} IN ('noreply','no-reply','donotreply','do-not-reply','mailer-daemon','postmaster','bounce','bounces','daemon','abuse','spam','webmaster') AS system FROM (SELECT *, {REASON_SQL} AS reason FROM {EMAILS_SQL})")
def email_validate_score(spark, sf_dir):
    e = F.col("email")
    return _emails(spark, sf_dir).select("doc_id", "email", E.reason(e).alias("reason"), E.quality(e).alias("quality"), E.is_system(e).alias("system"))


RANK_SQL = f"coalesce(map {{'info': 0, 'hallo': 1, 'kontakt': 2, 'contact': 2, 'hello': 3, 'mail': 4, 'office': 5, 'service': 6, 'support': 7, 'sales': 8, 'inquiry': 9, 'anfrage': 9}}[{_LOCAL}], 99)"
PRIORITY_SQL = f"round(CASE WHEN {_DOM} = 'example.com' OR ends_with({_DOM}, '.example.com') THEN 1000 ELSE 0 END + 10 * 0.4 + greatest(0, 100 - {RANK_SQL} * 10) * 0.2 + {QUALITY_SQL} * 0.1, 4)::DOUBLE"


@query(f"""SELECT doc_id, email, score, rank FROM (SELECT doc_id, email, score, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, email)::INTEGER AS rank
FROM (SELECT doc_id, email, {PRIORITY_SQL} AS score FROM (SELECT *, {REASON_SQL} AS reason FROM {EMAILS_SQL}))) WHERE rank <= 5""")
def email_priority_rank(spark, sf_dir):
    e = _emails(spark, sf_dir).withColumn("score", E.priority(F.col("email"), F.lit(None).cast("string"), F.lit("example.com")))
    return select.top_n(e, ["doc_id"], [F.desc("score"), F.asc("email")], 5)


@query(f"SELECT doc_id, email FROM (SELECT *, {_DOM} = 'example.com' OR ends_with({_DOM}, '.example.com') AS m FROM {EMAILS_SQL}) QUALIFY m OR NOT max(m) OVER (PARTITION BY doc_id)")
def email_prefer_domain(spark, sf_dir):
    e = _emails(spark, sf_dir)
    return select.prefer_else_all(e, ["doc_id"], D.domains_match(E.domain_part(F.col("email")), F.lit("example.com"))).select("doc_id", "email")


@query(f"SELECT {_DOM} AS domain, count(DISTINCT email) AS emails, count(*) AS mentions FROM {EMAILS_SQL} WHERE NOT ({_DOM} IN ('gmail.com')) GROUP BY ALL")
def email_group_by_domain(spark, sf_dir):
    e = _emails(spark, sf_dir).where(E.domain_part(F.col("email")) != "gmail.com")
    return e.groupBy(E.domain_part(F.col("email")).alias("domain")).agg(F.countDistinct("email").alias("emails"), F.count("*").alias("mentions"))


@query(f"SELECT email, translate(email, 'abcdefghijklmnopqrstuvwxyz', 'nopqrstuvwxyzabcdefghijklm') AS turned FROM (SELECT DISTINCT email FROM {EMAILS_SQL})")
def rot13_email(spark, sf_dir):
    return _emails(spark, sf_dir).select("email").distinct().select("email", F.translate("email", E.ROT13_FROM, E.ROT13_TO).alias("turned"))


@query("""WITH s AS (SELECT o_custkey, o_orderkey, CASE WHEN o_orderpriority = '1-URGENT' THEN 100 ELSE 60 END + CASE WHEN o_orderstatus = 'F' THEN 25 ELSE 0 END + o_orderkey % 30 AS raw, o_orderpriority = '1-URGENT' AS p FROM orders),
t AS (SELECT *, p AND raw >= max(raw) OVER (PARTITION BY o_custkey) - 15 AS e FROM s)
SELECT o_custkey, o_orderkey, CAST(raw AS BIGINT) AS raw, p AS impressum, round(greatest(0.0, least(1.0, raw / 155.0::DOUBLE)), 4) AS confidence FROM t QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY e DESC, raw DESC, o_orderkey) = 1""")
def guardrail_select(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    raw = F.when(F.col("o_orderpriority") == "1-URGENT", 100).otherwise(60) + F.when(F.col("o_orderstatus") == "F", 25).otherwise(0) + F.col("o_orderkey") % 30
    s = o.select("o_custkey", "o_orderkey", raw.alias("raw"), (F.col("o_orderpriority") == "1-URGENT").alias("impressum"))
    best = select.guardrail(s, ["o_custkey"], "raw", F.col("impressum"), [F.asc("o_orderkey")])
    return best.select("o_custkey", "o_orderkey", "raw", "impressum", E.confidence(F.col("raw")).alias("confidence"))


# -- names, words, evidence ---------------------------------------------------------------


@query("""SELECT lower(trim(p_type)) AS key, min_by(trim(p_type), p_partkey) AS value, array_to_string(list(p_brand ORDER BY CASE WHEN p_brand = 'Brand#11' THEN 0 ELSE 1 END, p_partkey), '|') AS evidence
FROM part WHERE trim(p_type) <> '' GROUP BY ALL""")
def company_group_evidence(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    g = select.group_evidence(p, [], F.col("p_type"), F.col("p_brand"), F.col("p_partkey"), F.when(F.col("p_brand") == "Brand#11", 0).otherwise(1))
    return g.select("key", "value", F.array_join("evidence", "|").alias("evidence"))


_SQUEEZE = r"trim(regexp_replace(coalesce({}, ''), '\s+', ' ', 'g'))"


@query(rf"SELECT p_partkey, substr(regexp_replace(regexp_replace(lower({_SQUEEZE.format('p_name')}), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g'), 1, 60) AS slug FROM part")
def slugify(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", T.slugify(F.col("p_name")).alias("slug"))


@query("SELECT lang, sum(len(regexp_extract_all(text, '[A-Za-zÄÖÜäöüß]+(?:-[A-Za-zÄÖÜäöüß]+)*')))::BIGINT AS words FROM documents GROUP BY lang")
def tokenize_count(spark, sf_dir):
    return table(spark, sf_dir, "documents").groupBy("lang").agg(F.sum(F.size(T.words(F.col("text")))).cast("long").alias("words"))


@query(r"""WITH n AS (SELECT s_suppkey, list_filter(string_split(trim(regexp_replace(regexp_replace(replace(lower(trim(s_name)), '&', ' and '), '[.,;:/()\[\]{}|\-\\_"''`]', ' ', 'g'), '\s+', ' ', 'g')), ' '),
lambda t: t NOT IN ('gmbh','ag','se','kg','gbr','ug','ek','e.k','e k','e.u','ltd','inc','llc','corp','sarl','bv','nv','co','co kg','und','u','co.')) AS t, s_name FROM supplier)
SELECT s_suppkey, array_to_string(t, ' ') AS normalized, array_to_string(list_filter(t, lambda x: x NOT IN ('online','shop','store','official','germany','deutschland') AND x <> '')[1:2], ' ') AS brand FROM n""")
def company_normalize(spark, sf_dir):
    n = F.col("s_name")
    return table(spark, sf_dir, "supplier").select("s_suppkey", T.normalize_name(n).alias("normalized"), T.brand_token(n).alias("brand"))


# -- merges and sinks -----------------------------------------------------------------------


@query("""WITH e AS (SELECT c_nationkey % 5 AS r, c_custkey AS k, c_name AS org, c_custkey % 3 AS m FROM customer),
c AS (SELECT s_nationkey % 5 AS r, s_suppkey AS k, CASE WHEN s_suppkey % 4 = 0 THEN NULL ELSE s_name END AS org FROM supplier)
SELECT coalesce(e.r, c.r)::VARCHAR AS request_id, coalesce(e.k, c.k)::VARCHAR AS domain,
CASE WHEN e.k IS NOT NULL AND c.k IS NOT NULL THEN coalesce(c.org, e.org) ELSE coalesce(e.org, c.org) END AS organization,
CASE WHEN c.k IS NULL OR m <> 1 AND e.k IS NOT NULL THEN CASE WHEN m = 0 THEN 'hunter' WHEN m = 1 THEN 'google_maps' ELSE 'hunter, google_maps' END WHEN e.k IS NULL THEN 'hunter' ELSE 'hunter, google_maps' END AS source,
CASE WHEN c.k IS NOT NULL THEN 'new' ELSE 'old' END AS job_id FROM e FULL JOIN c ON e.r = c.r AND e.k = c.k""")
def merge_full_outer(spark, sf_dir):
    m = F.col("c_custkey") % 3
    e = table(spark, sf_dir, "customer").select((F.col("c_nationkey") % 5).cast("string").alias("request_id"), F.col("c_custkey").cast("string").alias("domain"), F.col("c_name").alias("organization"), F.when(m == 0, "hunter").when(m == 1, "google_maps").otherwise("hunter, google_maps").alias("source"), F.lit("old").alias("job_id"))
    c = table(spark, sf_dir, "supplier").select((F.col("s_nationkey") % 5).cast("string").alias("request_id"), F.col("s_suppkey").cast("string").alias("domain"), F.when(F.col("s_suppkey") % 4 != 0, F.col("s_name")).alias("organization"), F.lit("new").alias("job_id"))
    return merge.merge_candidates(e, c, "hunter")


_HALVES = "o AS (SELECT user_id, event_id, event_type, epoch_us(ts) AS us FROM events WHERE event_id % 2 = 0), n AS (SELECT user_id, event_id, event_type, epoch_us(ts) AS us FROM events WHERE event_id % 2 = 1)"


def _halves(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    e = table(spark, sf_dir, "events").select("user_id", "event_id", "event_type", micros(F.col("ts")).alias("us"))
    return e.where("event_id % 2 = 0"), e.where("event_id % 2 = 1")


def _kinds(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """Purchases and signups, and all other events: sides whose users overlap."""
    e = table(spark, sf_dir, "events").select("user_id", "event_id", "event_type", micros(F.col("ts")).alias("us"))
    return e.where("event_type in ('purchase', 'signup')"), e.where("event_type not in ('purchase', 'signup')")


@query(f"WITH {_HALVES}, l AS (SELECT * FROM n QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY us DESC, event_id DESC) = 1) SELECT * FROM o WHERE user_id NOT IN (SELECT user_id FROM l) UNION ALL SELECT * FROM l")
def upsert_last_wins(spark, sf_dir):
    old, new = _halves(spark, sf_dir)
    return merge.upsert(old, new, ["user_id"], [F.desc("us"), F.desc("event_id")])


@query("WITH e AS (SELECT user_id, event_id, event_type, epoch_us(ts) AS us FROM events), o AS (SELECT * FROM e WHERE event_type IN ('purchase', 'signup')), n AS (SELECT * FROM e WHERE event_type NOT IN ('purchase', 'signup')) SELECT * FROM o UNION ALL SELECT * FROM (SELECT * FROM n QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY us DESC, event_id DESC) = 1) WHERE user_id NOT IN (SELECT user_id FROM o)")
def insert_if_absent(spark, sf_dir):
    old, new = _kinds(spark, sf_dir)
    return merge.insert_if_absent(old, merge.last_per_key(new, ["user_id"], [F.desc("us"), F.desc("event_id")]), ["user_id"])


@query("WITH e AS (SELECT user_id, event_id, event_type, epoch_us(ts) AS us FROM events), o AS (SELECT * FROM e WHERE event_type NOT IN ('purchase', 'signup')), b AS (SELECT * FROM e WHERE event_type IN ('purchase', 'signup')) SELECT * FROM o WHERE user_id NOT IN (SELECT user_id FROM b) UNION ALL SELECT * FROM b")
def replace_partition(spark, sf_dir):
    new, old = _kinds(spark, sf_dir)
    return merge.replace_partition(old, new, ["user_id"])


@query("SELECT o_orderkey, coalesce(m, epoch_us(o_orderdate)) AS last_us FROM orders LEFT JOIN (SELECT l_orderkey, max(epoch_us(l_shipdate)) AS m FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey")
def coalesce_update(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", micros(F.col("o_orderdate")).alias("last_us"))
    u = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.max(micros(F.col("l_shipdate"))).alias("last_us"))
    return merge.update_keep_old(o, u, ["o_orderkey"], ["last_us"])


@query("SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' AND (o_orderpriority IS NULL OR o_orderpriority <> '1-URGENT') THEN 'FAILED' ELSE o_orderpriority END AS o_orderpriority FROM orders")
def predicate_update(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority")
    return merge.update_where(o, (F.col("o_orderstatus") == "F") & ~F.col("o_orderpriority").eqNullSafe("1-URGENT"), o_orderpriority="FAILED").drop("o_orderstatus")


@query("SELECT event_id, CASE WHEN EXISTS (SELECT 1 FROM events s WHERE s.event_type = 'purchase' AND s.user_id = e.user_id AND s.event_id <> e.event_id) THEN 'CONTACTED' ELSE event_type END AS event_type FROM events e")
def cross_request_propagate(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type")
    return merge.propagate(e, e.where("event_type = 'purchase'"), "user_id", "event_id", event_type="CONTACTED").drop("user_id")


@query("SELECT c_custkey::VARCHAR AS id, coalesce(c_name, '') AS name, '' AS comments FROM customer")
def sheet_rows(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"))
    return merge.sheet_rows(c, ["id", "name", "comments"])


@query("SELECT p_size AS i, CASE WHEN p_size >= 26 THEN chr(65 + p_size // 26 - 1) ELSE '' END || chr(65 + p_size % 26) AS label FROM (SELECT DISTINCT p_size FROM part)")
def a1_labels(spark, sf_dir):
    return table(spark, sf_dir, "part").select(F.col("p_size").alias("i")).distinct().select("i", T.a1_column(F.col("i")).alias("label"))


# -- queues, joins, funnels -------------------------------------------------------------------


@query("SELECT user_id, event_id, event_type, epoch_us(ts) AS us FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1")
def distinct_on_latest(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("user_id", "event_id", "event_type", micros(F.col("ts")).alias("us"))
    return merge.last_per_key(e, ["user_id"], [F.desc("us"), F.desc("event_id")])


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)")
def queue_anti_join(spark, sf_dir):
    done = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"))
    return funnel.pending(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), done, ["o_orderkey"])


@query("SELECT o_orderkey FROM orders a WHERE EXISTS (SELECT 1 FROM orders b WHERE b.o_custkey = a.o_custkey AND b.o_orderkey <> a.o_orderkey AND b.o_orderstatus = 'P')")
def reuse_semi_theta(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    return merge.has_other(o, o.where("o_orderstatus = 'P'"), "o_custkey", "o_orderkey").where("_hit").select("o_orderkey")


@query("""SELECT o_orderpriority, count(*) AS total, count(*) FILTER (o_orderstatus IN ('F','O')) AS completed, count(*) FILTER (o_orderstatus = 'O') AS succeeded,
count(*) FILTER (o_orderstatus = 'F') AS failed, count(*) FILTER (o_orderstatus NOT IN ('F','O')) AS pending FROM orders GROUP BY 1""")
def funnel_filter_counts(spark, sf_dir):
    return funnel.status_counts(table(spark, sf_dir, "orders"), ["o_orderpriority"], "o_orderstatus", "O", "F")


@query("""SELECT o_orderkey, CASE WHEN n IS NULL OR p > 0 THEN 'pending' WHEN f > 0 THEN 'failed' ELSE 'succeeded' END AS status FROM orders LEFT JOIN
(SELECT l_orderkey, count(*) AS n, count(*) FILTER (l_returnflag = 'N') AS p, count(*) FILTER (l_returnflag = 'R') AS f FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey""")
def domain_status_rollup(spark, sf_dir):
    l = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_returnflag")
    return funnel.rollup_status(table(spark, sf_dir, "orders"), l, "o_orderkey", F.col("l_returnflag") == "N", F.col("l_returnflag") == "R")


@query("SELECT s AS status, count(event_type) AS n FROM (VALUES ('click'), ('purchase'), ('signup'), ('view'), ('never')) v(s) LEFT JOIN events ON event_type = s GROUP BY s")
def status_stats_zero_fill(spark, sf_dir):
    wanted = spark.createDataFrame([(s,) for s in ("click", "purchase", "signup", "view", "never")], "status string")
    n = table(spark, sf_dir, "events").groupBy(F.coalesce("event_type", F.lit("null")).alias("status")).agg(F.count("*").alias("n"))
    return wanted.join(n, "status", "left").select("status", F.coalesce("n", F.lit(0)).alias("n"))


@query("""SELECT o_orderpriority, count(*) AS total, count(l_orderkey) AS done, CASE WHEN count(l_orderkey) >= count(*) THEN 'SUCCEEDED' ELSE 'RUNNING' END AS state
FROM orders LEFT JOIN (SELECT DISTINCT l_orderkey FROM lineitem) ON l_orderkey = o_orderkey GROUP BY 1""")
def count_vs_count_col(spark, sf_dir):
    done = table(spark, sf_dir, "lineitem").select("l_orderkey").distinct()
    j = table(spark, sf_dir, "orders").join(done, F.col("o_orderkey") == F.col("l_orderkey"), "left").groupBy("o_orderpriority").agg(F.count("*").alias("total"), F.count("l_orderkey").alias("done"))
    return j.withColumn("state", F.when(F.col("done") >= F.col("total"), "SUCCEEDED").otherwise("RUNNING"))


@query("SELECT o_custkey, o_orderstatus, n, first_us FROM (SELECT o_custkey, o_orderstatus, count(*) AS n, min(epoch_us(o_orderdate)) AS first_us FROM orders GROUP BY 1, 2) QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY first_us DESC, o_orderstatus) = 1")
def previous_success(spark, sf_dir):
    g = table(spark, sf_dir, "orders").groupBy("o_custkey", "o_orderstatus").agg(F.count("*").alias("n"), F.min(micros(F.col("o_orderdate"))).alias("first_us"))
    return merge.last_per_key(g, ["o_custkey"], [F.desc("first_us"), F.asc("o_orderstatus")])


_CUT = "1_000_000 * 86400"


@query("""WITH a AS (SELECT user_id, max(event_id) FILTER (event_type = 'view') AS enrichment, max(event_id) FILTER (event_type = 'click') AS mail FROM events GROUP BY 1),
b AS (SELECT user_id, max(event_id) FILTER (event_type = 'view') AS e, max(event_id) FILTER (event_type = 'click') AS m FROM events WHERE event_id < (SELECT max(event_id) FROM events) * 0.8 GROUP BY 1)
SELECT user_id, coalesce(enrichment IS NOT NULL AND (e IS NULL OR enrichment > e), false) AS enrichment_changed, coalesce(mail IS NOT NULL AND (m IS NULL OR mail > m), false) AS mail_changed,
coalesce(enrichment IS NOT NULL AND (e IS NULL OR enrichment > e), false) OR coalesce(mail IS NOT NULL AND (m IS NULL OR mail > m), false) AS any_changed FROM a LEFT JOIN b USING (user_id)""")
def highwater_change_flags(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("user_id", "event_id", "event_type")
    marks = lambda d: d.groupBy("user_id").agg(F.max(F.when(F.col("event_type") == "view", F.col("event_id"))).alias("enrichment"), F.max(F.when(F.col("event_type") == "click", F.col("event_id"))).alias("mail"))
    top = F.broadcast(e.agg(F.max("event_id").alias("top")).withColumn("one", F.lit(1)))
    before = e.withColumn("one", F.lit(1)).join(top, "one").where("event_id < top * 0.8").drop("one", "top")
    return funnel.change_flags(marks(e), marks(before), "user_id", "enrichment", "mail")


@query("SELECT n_name, count(*) AS events FROM events JOIN nation ON json_extract_string(props, '$.k') = n_nationkey::VARCHAR GROUP BY 1")
def json_path_join(spark, sf_dir):
    n = table(spark, sf_dir, "nation").select("n_name", F.col("n_nationkey").cast("string").alias("k"))
    return table(spark, sf_dir, "events").select(F.get_json_object("props", "$.k").alias("k")).join(n, "k").groupBy("n_name").agg(F.count("*").alias("events"))


@query("SELECT o_orderkey, row_number() OVER (ORDER BY CASE o_orderpriority WHEN '3-MEDIUM' THEN 0 WHEN '1-URGENT' THEN 1 ELSE 999999 END, o_orderstatus, o_orderkey) AS rank FROM orders")
def custom_order_sort(spark, sf_dir):
    wanted = F.array(F.lit("3-MEDIUM"), F.lit("1-URGENT"))
    at = F.array_position(wanted, F.col("o_orderpriority"))
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", F.when(at > 0, at).otherwise(999999).alias("at"))
    return ranks.numbered(o, [F.col("at"), F.col("o_orderstatus"), F.col("o_orderkey")], "rank").select("o_orderkey", "rank")


@query("""SELECT o_orderkey, row_number() OVER (ORDER BY m DESC NULLS LAST, o_orderkey) AS rank FROM orders LEFT JOIN (SELECT l_orderkey, max(l_shipdate) AS m FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey""")
def nulls_last_sort(spark, sf_dir):
    m = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.max("l_shipdate").alias("m"))
    o = table(spark, sf_dir, "orders").join(m, F.col("o_orderkey") == F.col("l_orderkey"), "left").select("o_orderkey", "m")
    return ranks.numbered(o, [F.desc_nulls_last("m"), F.asc("o_orderkey")], "rank").select("o_orderkey", "rank")


@query("SELECT r_name AS location, f AS headcount, s AS keyword FROM region, (SELECT DISTINCT l_returnflag AS f FROM lineitem), (SELECT DISTINCT c_mktsegment AS s FROM customer)")
def cross_fanout(spark, sf_dir):
    """Requests of a discovery run; the sides are dimensions of fixed size."""
    flags = table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("headcount")).distinct()
    words = table(spark, sf_dir, "customer").select(F.col("c_mktsegment").alias("keyword")).distinct()
    return table(spark, sf_dir, "region").select(F.col("r_name").alias("location")).crossJoin(flags).crossJoin(words)


# -- selection, votes, statistics --------------------------------------------------------------


@query("""WITH q AS (SELECT embedding AS e FROM embeddings WHERE vec_id = 0)
SELECT vec_id, round(list_cosine_similarity(embedding::DOUBLE[], e::DOUBLE[]), 6) AS score FROM embeddings, q ORDER BY score DESC, vec_id LIMIT 20""")
def cosine_topk(spark, sf_dir):
    v = table(spark, sf_dir, "embeddings")
    one = v.where("vec_id = 0").agg(F.min("embedding").alias("query"))
    return select.nearest(v, one, 20).select("vec_id", "score")


@query("""WITH c AS (SELECT user_id, lower(trim(event_type)) AS c, count(DISTINCT event_id) AS n, min(event_id) AS f, min_by(event_type, event_id) AS v FROM events GROUP BY 1, 2)
SELECT user_id, min_by(v, (CASE WHEN n >= 2 THEN -n ELSE 0 END, f)) AS value, max(n) AS votes FROM c GROUP BY 1""")
def vote_majority(spark, sf_dir):
    return select.vote_majority(table(spark, sf_dir, "events"), ["user_id"], "event_id", "event_type")


@query("SELECT user_id, lower(trim(event_type)) AS item, count(DISTINCT event_id) AS votes FROM events GROUP BY 1, 2 HAVING votes >= 2")
def vote_list_items(spark, sf_dir):
    return select.vote_items(table(spark, sf_dir, "events"), ["user_id"], "event_id", "event_type")


@query("SELECT user_id, item, row_number() OVER (PARTITION BY user_id ORDER BY f)::INTEGER AS position FROM (SELECT user_id, lower(trim(event_type)) AS item, min(event_id) AS f FROM events GROUP BY 1, 2)")
def vote_union(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("user_id", "event_id", "event_type")
    return select.vote_union(e, ["user_id"], "event_type", [F.asc("event_id")]).select("user_id", "item", "position")


@query("SELECT event_type, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95, round(quantile_cont(value, 0.99), 6) AS p99, min(value) AS low, max(value) AS high FROM events GROUP BY 1")
def percentiles(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_type", "value")
    p = ranks.percentiles(e, "event_type", "value", {"p50": 0.5, "p95": 0.95, "p99": 0.99})
    ends = e.groupBy("event_type").agg(F.min("value").alias("low"), F.max("value").alias("high"))
    p = p.withColumnRenamed("event_type", "_t")
    return ends.join(p, F.col("event_type").eqNullSafe(F.col("_t")), "left").select("event_type", *(F.round(c, 6).alias(c) for c in ("p50", "p95", "p99")), "low", "high")


@query("SELECT l_partkey, arg_max((l_suppkey)::BIGINT, (l_quantity, -l_orderkey, -l_linenumber)) AS supplier, max(l_quantity) AS priority FROM lineitem GROUP BY 1")
def argmax_source(spark, sf_dir):
    order = F.struct("l_quantity", -F.col("l_orderkey"), -F.col("l_linenumber"))
    return table(spark, sf_dir, "lineitem").groupBy("l_partkey").agg(F.max_by("l_suppkey", order).alias("supplier"), F.max("l_quantity").alias("priority"))


@query("""WITH n AS (SELECT max(ts) AS t FROM events) SELECT event_id, CASE WHEN event_type = 'view' AND ts < t - INTERVAL 5 MINUTES THEN NULL ELSE CASE WHEN event_type = 'view' THEN 'processing' ELSE event_type END END AS status FROM events, n""")
def stale_timeout(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", F.when(F.col("event_type") == "view", "processing").otherwise(F.col("event_type")).alias("status"), "ts")
    now = e.agg(F.max("ts").alias("now"))
    return funnel.release_stale(e.crossJoin(F.broadcast(now)), "status", "ts", F.col("now")).select("event_id", "status")


@query("SELECT event_type, CASE WHEN count(*) FILTER (value > 50) = 0 THEN 0 ELSE count(*) FILTER (value > 90) / count(*) FILTER (value > 50)::DOUBLE END AS rate, count(*) AS n FROM events GROUP BY 1")
def safe_ratio(spark, sf_dir):
    e = table(spark, sf_dir, "events").groupBy("event_type").agg(F.count_if(F.col("value") > 90).alias("a"), F.count_if(F.col("value") > 50).alias("b"), F.count("*").alias("n"))
    return e.select("event_type", F.coalesce(F.try_divide(F.col("a").cast("double"), F.col("b")), F.lit(0.0)).alias("rate"), "n")


# -- pages ----------------------------------------------------------------------------------------

_A = links.ANCHOR.replace("'", "''")


@query(rf"""SELECT page_id, pos::INTEGER - 1 AS pos, href FROM (SELECT page_id, unnest(regexp_extract_all(html, '{_A}', 1)) AS href, generate_subscripts(regexp_extract_all(html, '{_A}', 1), 1) AS pos FROM pages)""")
def anchor_links(spark, sf_dir):
    return links.tagged_links(table(spark, sf_dir, "pages"), links.ANCHOR, 1).select("page_id", "pos", "href")


# -- views and streams ------------------------------------------------------------------------------

from leadmill.plans import crawling, discovery, flows, mailing, markup, paged, projected, telemetry  # noqa: E402, F401

QUERIES["leads_view"], ORACLES["leads_view"] = views.leads_view, views.LEADS_SQL
QUERIES["jobs_view"], ORACLES["jobs_view"] = views.jobs_view, views.JOBS_SQL

from leadmill.streaming import streams  # noqa: E402

QUERIES |= streams.QUERIES
ORACLES |= streams.ORACLES | {"stream_crawl": enrich.CRAWL_SQL}
