"""Queries of the discovery stage: search plans, locations, places and company sources, each with its SQL twin."""

from __future__ import annotations

from pyspark.sql import functions as F

from leadmill.functions import domain as D
from leadmill.operators import places
from leadmill.plans.registry import query, table

_SITE = r"regexp_replace(regexp_replace(lower(url), '^[a-z]+://(www\.)?', ''), '[/?#:].*$', '')"
_FOUND = f"(SELECT page_id AS seq, {_SITE} AS domain, CASE WHEN page_id % 3 = 0 THEN 'a' ELSE 'b' END AS query, 'Org ' || (page_id % 4) AS organization, page_id % 11 = 0 AS excluded FROM pages)"


@query(f"""SELECT query, count(*) FILTER (NOT excluded AND p IS NULL) AS added, count(*) FILTER (NOT excluded AND p IS NOT NULL AND p <> query || organization) AS updated, count(*) FILTER (NOT excluded AND p = query || organization) AS ignored,
count(*) FILTER (excluded) AS excluded, 0::BIGINT AS social, count(*) AS returned, round(count(*) FILTER (NOT excluded AND p IS NULL) / count(*)::DOUBLE, 4) AS kept_rate
FROM (SELECT *, lag(query || organization) OVER (PARTITION BY domain, excluded ORDER BY seq) AS p FROM {_FOUND}) GROUP BY 1""")
def places_run_pages(spark, sf_dir):
    """The same counters over all pages, each taken as a place."""
    p = table(spark, sf_dir, "pages")
    d = p.select(F.col("page_id").alias("call"), F.lit(0).alias("pos"), F.when(F.col("page_id") % 3 == 0, "a").otherwise("b").alias("query"), F.lit("x").alias("location"), F.concat(F.lit("Org "), F.col("page_id") % 4).alias("organization"), D.normalize_domain(F.col("url")).alias("domain"), (F.col("page_id") % 11 == 0).alias("excluded"), F.lit(False).alias("social"))
    return places.run_places(d)[1]


@query("SELECT n_name AS word, trim(regexp_replace(lower(n_name), '[^a-z]', '', 'g')) AS keyword, CASE WHEN n_nationkey % 2 = 0 THEN r_name || '/' || n_name ELSE r_name END AS path, upper(left(r_name, 3)) = upper(left(n_name, 3)) AS alike FROM nation JOIN region ON n_regionkey = r_regionkey")
def location_paths(spark, sf_dir):
    """Paths and search words of all nations."""
    d = table(spark, sf_dir, "nation").join(F.broadcast(table(spark, sf_dir, "region")), F.col("n_regionkey") == F.col("r_regionkey"))
    path = places.location_path(F.col("r_name"), F.lit(" "), F.when(F.col("n_nationkey") % 2 == 0, F.col("n_name")))
    first = lambda c: F.upper(F.substring(c, 1, 3))
    return d.select(F.col("n_name").alias("word"), F.get(places.clean_keywords(F.array("n_name")), F.lit(0)).alias("keyword"), path.alias("path"), (first("r_name") == first("n_name")).alias("alike"))


@query("SELECT s_nationkey % 5 AS request, array_to_string(list_distinct(list(CASE WHEN s_suppkey % 3 = 0 THEN 'Austria' ELSE 'Germany' END)), '|') <> '' AS some, min(s_suppkey) AS first_key FROM supplier GROUP BY 1")
def country_order(spark, sf_dir):
    """Countries of each request's locations in the order first seen."""
    path = F.when(F.col("s_suppkey") % 3 == 0, "Austria/Wien").otherwise("Germany")
    d = table(spark, sf_dir, "supplier").groupBy((F.col("s_nationkey") % 5).alias("request")).agg(F.array_sort(F.collect_list(F.struct("s_suppkey", path.alias("p")))).alias("l"))
    seen = places.first_seen(F.transform("l", lambda s: s["p"]))
    return d.select("request", (F.array_join(seen, "|") != "").alias("some"), F.get(F.col("l"), F.lit(0))["s_suppkey"].alias("first_key"))


@query("SELECT DISTINCT s_nationkey % 3 AS request, lower(trim(n_name)) AS domain, n_name AS organization FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE trim(n_name) <> ''")
def candidate_scan(spark, sf_dir):
    """The distinct candidates of a job's source."""
    d = table(spark, sf_dir, "supplier").join(F.broadcast(table(spark, sf_dir, "nation")), F.col("s_nationkey") == F.col("n_nationkey"))
    return d.where(F.trim("n_name") != "").select((F.col("s_nationkey") % 3).alias("request"), F.lower(F.trim("n_name")).alias("domain"), F.col("n_name").alias("organization")).distinct()


@query("SELECT request, count(*) AS n FROM (SELECT DISTINCT s_nationkey % 3 AS request, n_name FROM supplier JOIN nation ON s_nationkey = n_nationkey) GROUP BY 1")
def candidates_by_request(spark, sf_dir):
    return candidate_scan(spark, sf_dir).groupBy("request").agg(F.count("*").alias("n"))


@query("WITH i AS (SELECT 'v' || (vec_id % 50) AS name FROM embeddings WHERE len(embedding) = (SELECT max(len(embedding)) FROM embeddings)), n AS (SELECT 'v' || n_nationkey * 5 AS name FROM nation) SELECT DISTINCT name FROM n WHERE name NOT IN (SELECT name FROM i)")
def index_missing(spark, sf_dir):
    """Names that a validated index of vectors lacks."""
    v = table(spark, sf_dir, "embeddings").select(F.concat(F.lit("v"), F.col("vec_id") % 50).alias("name"), "embedding")
    width = v.agg(F.max(F.size("embedding")).alias("width"))
    names = table(spark, sf_dir, "nation").select(F.concat(F.lit("v"), F.col("n_nationkey") * 5).alias("name"))
    return places.missing_names(names, places.valid_index(v.crossJoin(F.broadcast(width)), F.col("width")))


