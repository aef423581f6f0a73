"""Places of a paged API, captured from given tables and read back, each query with its SQL twin."""

from __future__ import annotations

from pyspark.sql import functions as F

from leadmill.operators import places
from leadmill.operators.ranks import scratch
from leadmill.plans.projected import Projection
from leadmill.plans.registry import query
from leadmill.sources import paged

PARTS = Projection("part", request="concat('q', 100 + p_size)", part="CAST(p_partkey AS BIGINT)", place="""concat('{"websiteUri": "https://p', p_partkey % 200, '.de/", "displayName": {"text": "', p_brand, '"}, "primaryType": "', CASE WHEN p_partkey % 7 = 0 THEN 'cafe' ELSE 'store' END, '", "types": []}')""")


def answers(spark, sf_dir):
    """(request, pos, place): the parts of a size are the places of a request, in the order of their keys."""
    p = PARTS.df(spark, sf_dir)
    from leadmill.operators.scans import running

    seen = running(p, [F.col("request"), F.col("part")], n=F.lit(1))
    first = seen.groupBy("request").agg(F.min("n").alias("_first"))
    return seen.join(first, "request").select("request", (F.col("n") - F.col("_first")).cast("int").alias("pos"), "place", "part")


_PLACES = "(SELECT concat('q', 100 + p_size) AS request, p_partkey, p_brand, row_number() OVER (PARTITION BY p_size ORDER BY p_partkey) - 1 AS n FROM part)"


@query(f"SELECT request, CAST(n // 20 + 1 AS INTEGER) AS page, CAST(n % 20 AS INTEGER) AS pos, concat('https://p', p_partkey % 200, '.de/') AS site FROM {_PLACES} WHERE n < 60 AND request IN ('q101', 'q107', 'q150')")
def paged_read(spark, sf_dir):
    """Three pages at most of some requests, each by following its tokens; other requests' files are not opened."""
    path = scratch(spark)
    paged.capture(answers(spark, sf_dir), path)
    paged.register(spark)
    rows = spark.read.format("paged").option("path", path).option("mostPages", 3).load().where("request in ('q101', 'q107', 'q150')")
    return rows.select("request", "page", "pos", F.get_json_object("place", "$.websiteUri").alias("site"))


@query(f"""SELECT domain, request AS query, 'x' AS location, p_brand AS organization FROM (SELECT *, concat('p', p_partkey % 200, '.de') AS domain FROM {_PLACES} WHERE p_partkey % 7 <> 0) QUALIFY row_number() OVER (PARTITION BY domain ORDER BY request DESC, n DESC) = 1""")
def paged_stream(spark, sf_dir):
    """All pages as a stream, in two steps from one checkpoint: the leads of what came in."""
    path, out = scratch(spark), scratch(spark)
    rows = answers(spark, sf_dir).persist()
    paged.register(spark)
    for half in (F.col("request") < "q125", F.col("request") >= "q125"):
        paged.capture(rows.where(half), path)
        stream = spark.readStream.format("paged").option("path", path).load()
        stream.writeStream.format("parquet").option("checkpointLocation", f"{out}/offsets").option("path", f"{out}/rows").trigger(availableNow=True).start().awaitTermination()
    rows.unpersist()
    found = spark.read.schema(paged.SCHEMA).parquet(f"{out}/rows")
    calls = found.groupBy("request", "page").agg(F.array_sort(F.collect_list(F.struct("pos", "place"))).alias("l"))
    shown = calls.select((F.substring("request", 2, 9).cast("int") * 100_000 + F.col("page")).alias("call"), F.col("request").alias("text_query"), F.lit("x").alias("location"), F.concat(F.lit("["), F.array_join(F.transform("l", lambda x: x["place"]), ","), F.lit("]")).alias("places"))
    return places.run_places(places.leads_of(shown))[0]
