"""Planted rows for operators of ``plans.discovery``, with the rows they must give."""

from __future__ import annotations
import json
from pyspark.sql import functions as F
from leadmill.functions import domain as D
from leadmill.operators import jobs, merge, places, ranks
from leadmill.plans.registry import Sample
from leadmill.sources import json_store

from planted import case

_J = json.dumps


def _place(site, name="Shop", primary="store", types=()):
    return {"websiteUri": site, "displayName": {"text": name}, "primaryType": primary, "types": list(types)}

ANSWERS = Sample(
    "call int, text_query string, location string, places string",
    (
        (1, "tea", "DE/Berlin", _J([_place("https://www.tea.de/x", " Tea "), _place("https://bar.de", "Bar", "Bar "), _place(None), _place("https://facebook.com/tea"), _place("https://cup.de", None)])),
        (2, "tea", "DE/Berlin", _J([_place("https://tea.de", "Tea"), _place("https://cup.de", "Cup"), _place("https://b.de", types=["shop", " ATM"])])), (3, "mate", "AT", _J([_place("https://tea.de", "Tea"), _place("  ", "x"), _place("localhost", "Local")])), (4, "mate", "AT", None), (5, "mate", "AT", "[]"),
    ),
)
PLACED = Sample("domain string, query string, location string, organization string", (("tea.de", "mate", "AT", "Tea"), ("cup.de", "tea", "DE/Berlin", "Cup"), ("localhost", "mate", "AT", "Local")))
COUNTED = Sample("query string, added long, updated long, ignored long, excluded long, social long, returned long, kept_rate double", (("tea", 2, 1, 1, 2, 1, 7, 0.2857), ("mate", 1, 1, 0, 0, 0, 2, 0.5)))


@case(f"SELECT * FROM {PLACED.sql}")
def places_leads(spark, sf_dir):
    """Leads of captured place answers, the last of each domain; stated beside."""
    return places.run_places(places.leads_of(ANSWERS.df(spark)))[0]


@case(f"SELECT * FROM {COUNTED.sql}")
def places_counters(spark, sf_dir):
    """What became of the places of each query; stated beside."""
    return places.run_places(places.leads_of(ANSWERS.df(spark)))[1]


def _geo(kind, names, status="OK", geometry=True):
    parts = [{"long_name": long, "short_name": short, "types": [t]} for t, long, short in names]
    point = lambda a, b: {"lat": a, "lng": b}
    shape = {"location": point(52.5, 13.4), "viewport": {"northeast": point(52.7, 13.8), "southwest": point(52.3, 13.1)}} if geometry else {}
    return _J({"status": status, "results": [{"types": kind, "address_components": parts, "geometry": shape}] if status == "OK" else []})

_DE, _AT = ("country", "Germany", "DE"), ("country", "Austria", "AT")
GEO = Sample(
    "token string, response string",
    (
        ("Berlin", _geo(["locality", "political"], [("locality", "Berlin", "Berlin"), ("administrative_area_level_1", "Land Berlin", "BE"), _DE])), ("Germany", _geo(["country"], [_DE])), ("Austria", _geo(["country"], [("administrative_area_level_1", "Wien", "W"), _AT])),
        ("Europe", _geo(["continent"], [])), ("Bavaria", _geo(["administrative_area_level_1"], [("locality", "x", "x"), ("administrative_area_level_1", "Bayern", "BY"), _DE])), ("nowhere", _geo([], [], "ZERO_RESULTS")), ("nocode", _geo(["locality"], [("locality", "Q", "Q")])), ("shapeless", _geo(["country"], [_AT], geometry=False)), ("broken", "{"), ("null", None),
    ),
)
GEO_READ = Sample(
    "token string, kind string, city string, state string, country string, country_name string, lat double, lng double, low_lat double, low_lng double, high_lat double, high_lng double",
    (("Berlin", "city", "Berlin", "Land Berlin", "DE", "Germany", 52.5, 13.4, 52.3, 13.1, 52.7, 13.8), ("Austria", "country", None, None, "AT", "Austria", 52.5, 13.4, 52.3, 13.1, 52.7, 13.8), ("Bavaria", "state", None, "Bayern", "DE", "Germany", 52.5, 13.4, 52.3, 13.1, 52.7, 13.8)),
)


@case(f"SELECT * FROM {GEO_READ.sql}")
def geo_resolve(spark, sf_dir):
    """Geocoder answers to locations; a country goes beside a city of it; stated beside."""
    return places.resolved(GEO.df(spark))

DEFAULTED = Sample("case string, country string, lat double", (("given", "DE", 52.5), ("given", "DE", 52.5), ("given", "AT", 52.5), ("none", "AT", 47.516231), ("none", "CH", 46.818188), ("none", "DE", 51.165691)))


@case(f"SELECT * FROM {DEFAULTED.sql}")
def geo_default(spark, sf_dir):
    """Locations where there are any, else the default countries."""
    some = places.resolved(GEO.df(spark))
    given = places.or_default(some).select(F.lit("given").alias("case"), "country", "lat")
    return given.unionByName(places.or_default(some.where("kind = 'planet'")).select(F.lit("none").alias("case"), "country", "lat"))

PLANS = Sample(
    "plan string",
    tuple((p if p is None or isinstance(p, str) else _J(p),) for p in (
        {"request_id": " r1 ", "prompt_target": " ", "prompt_target_en": "Tea shops", "prompt_keywords": ["Tea!", "tea", "Company", "", "Mate 2"], "places_text_queries": ["Tea", " tea ", "Mate", "Cha", "Chai"], "prompt_location": ["Berlin"], "sheet_id": "", "google_sheet_id": "s9",
         "resolved_locations": [{"country": "DE", "city": " Berlin "}, {"country": "DE", "city": "Berlin"}, {"country": "AT", "state": "Wien"}, {"continent": "Europe"}, {"business_region": "EMEA"}, {"city": "lost"}]},
        {"request_id": "r2", "prompt_keywords": ["a", "b", "c", "d", "e", "f", "g", "h", "i", "j", "k"], "global_search": True, "prompt_location": ["x"]}, {"request_id": "r3", "prompt_keywords": ["services"]}, {"prompt_target": "no request"}, "{broken", None,
    )),
)
PLANS_READ = Sample(
    "request_id string, target string, sheet_id string, keywords string, queries string, prompt_location string, locations string, rejected long",
    (("r1", "Tea shops", "s9", "tea mate", "Tea|Mate|Cha", "Berlin", "country=DE;city=Berlin|country=AT|continent=Europe|business_region=EMEA", 4), ("r2", None, None, "a b c d e f g h i j", "", None, "", 4)),
)


@case(f"SELECT * FROM {PLANS_READ.sql}")
def search_plan_parse(spark, sf_dir):
    """Plans to typed requests, and how many lines are none; stated beside."""
    d, bad = places.parse_plans(PLANS.df(spark))
    joined = lambda c, s: F.array_join(c, s).alias(c)
    return d.select("request_id", "target", "sheet_id", joined("keywords", " "), joined("queries", "|"), joined("prompt_location", "|"), joined("locations", "|")).crossJoin(F.broadcast(bad.agg(F.count("*").alias("rejected"))))

RECTANGLES = Sample(
    "id long, country string, state string, city string, low_lat string, low_lng string, high_lat string, high_lng string",
    ((1, "DE", None, "Berlin", "52.3", "13.1", "52.7", "13.8"), (2, "DE", " ", None, "52.3", "x", "52.7", "13.8"), (3, None, None, None, None, "1", "2", "3"), (4, "AT", "Wien", "Wien", "1e2", "-1", "0", " 4 ")),
)


@case(f"""SELECT id, try_cast(low_lat AS DOUBLE) IS NOT NULL AND try_cast(low_lng AS DOUBLE) IS NOT NULL AND try_cast(high_lat AS DOUBLE) IS NOT NULL AND try_cast(high_lng AS DOUBLE) IS NOT NULL AS valid, array_to_string(list_filter([nullif(trim(country), ''), nullif(trim(state), ''), nullif(trim(city), '')], lambda x: x IS NOT NULL), '/') AS path,
coalesce(nullif(array_to_string(list_filter(['COUNTRY:' || nullif(trim(country), ''), 'STATE:' || nullif(trim(state), ''), 'CITY:' || nullif(trim(city), '')], lambda x: x IS NOT NULL), ','), ''), 'NONE') AS shown FROM {RECTANGLES.sql}""")
def rectangles(spark, sf_dir):
    d = RECTANGLES.df(spark)
    corner = lambda a: F.struct(F.col(f"{a}_lat").alias("latitude"), F.col(f"{a}_lng").alias("longitude")).alias(a)
    place = [F.col(c) for c in ("country", "state", "city")]
    return d.select("id", places.valid_rectangle(F.struct(corner("low"), corner("high"))).alias("valid"), places.location_path(*place).alias("path"), places.location_shown(*place).alias("shown"))

DISCOVERED = Sample(
    "call int, headcount string, keyword string, response string",
    (
        (1, "1-10", "tea", _J({"meta": {"results": 3}, "data": [{"domain": "Tea.de", "organization": "Tea"}, {"domain": "facebook.com", "organization": "FB"}, {"domain": "", "organization": "x"}, {"domain": "www.cup.de", "organization": None}]})),
        (2, "11-50", "tea", _J({"meta": {"results": 1}, "data": [{"domain": "tea.de", "organization": "Tea GmbH"}]})), (3, "11-50", "mate", _J({"meta": {}, "data": []})), (4, "11-50", "mate", None), (5, "1-10", "mate", "oops"),
    ),
)
DISCOVERED_READ = Sample("domain string, organization string, headcount string, query string, calls long, total long", (("tea.de", "Tea GmbH", "11-50", "tea", 5, 4), ("cup.de", None, "1-10", "tea", 5, 4)))


@case(f"SELECT * FROM {DISCOVERED_READ.sql}")
def discovery_run(spark, sf_dir):
    """Captured answers of a company search: flattened, social sites out, the last of each domain kept; stated beside."""
    d = DISCOVERED.df(spark).withColumn("r", F.from_json("response", "meta struct<results:bigint>, data array<struct<domain:string,organization:string>>"))
    totals = d.agg(F.count("*").alias("calls"), F.sum(F.coalesce("r.meta.results", F.lit(0))).alias("total"))
    rows = d.select("call", "headcount", F.col("keyword").alias("query"), F.posexplode("r.data").alias("pos", "c"))
    rows = rows.select("call", "pos", D.normalize_domain(F.col("c.domain")).alias("domain"), F.col("c.organization").alias("organization"), "headcount", "query").where("domain is not null").where(~D.is_social(F.col("domain")))
    none = rows.limit(0)
    out = merge.upsert(none, rows, ["domain"], [F.desc("call"), F.desc("pos")])
    return out.select("domain", "organization", "headcount", "query").crossJoin(F.broadcast(totals))

INDEX = Sample("name string, embedding string", (("tea", "[1, 2]"), (" ", "[1, 2]"), ("bad", "[1]"), ("null", "[1, null]"), ("none", None), ("mate", "[0, 0]"), (None, "[1, 2]")))


@case("SELECT name, score::DOUBLE AS score FROM (VALUES ('tea', 0.8), ('mate', 0.0)) t(name, score)")
def index_match(spark, sf_dir):
    """Rows of an index that are valid, scored against one vector."""
    from leadmill.operators.select import cosine

    v = INDEX.df(spark).withColumn("embedding", F.from_json("embedding", "array<double>"))
    return places.valid_index(v, 2).select("name", F.round(cosine(F.col("embedding"), F.array(F.lit(2.0), F.lit(1.0))), 6).alias("score"))

STORE = """{"j1": {"job_id": "j1", "tool": "hunter", "request_id": "r1", "state": "RUNNING", "at_us": 5}, "j2": {"job_id": "j2", "tool": "Google Maps", "request_id": "r1", "state": "SUCCEEDED", "at_us": 9},
"bad": {"tool": "x"}, "worse": 7, "j3": {"job_id": "j3", "tool": "", "request_id": "r2", "state": "QUEUED", "at_us": 7}}"""
STORED = Sample("rank long, job_id string, tool string, state string, updated_us long", ((1, "j2", "google_maps", "SUCCEEDED", 9), (2, "j3", "unknown", "QUEUED", 7), (3, "j1", "hunter", "RUNNING", 5)))


@case(f"SELECT * FROM {STORED.sql}")
def job_store_scan(spark, sf_dir):
    """A store file of jobs, its valid entries newest first; stated beside."""
    path = ranks.scratch(spark)
    spark.createDataFrame([(STORE,)], "value string").coalesce(1).write.option("lineSep", " ").text(path)
    log, _ = jobs.read_log(json_store.entries(spark, path))
    return ranks.numbered(jobs.fold(log), [F.desc("updated_us"), F.asc("job_id")], "rank").select("rank", "job_id", "tool", "state", "updated_us")

INDEX_FILE = '[{"industry": "tea", "embedding": [1, 2]}, {"industry": " ", "embedding": [1, 2]}, {"industry": "short", "embedding": [1]}, {"industry": "text", "embedding": "x"}, 5, {"industry": "holes", "embedding": [1, null]}, {"industry": "mate", "embedding": [0.5, 0]}]'


@case("SELECT name, score::DOUBLE AS score FROM (VALUES ('tea', 1.0), ('mate', 0.447214)) t(name, score)")
def index_file_match(spark, sf_dir):
    """An index file's valid rows against one vector."""
    from leadmill.operators.select import cosine

    path = ranks.scratch(spark)
    spark.createDataFrame([(INDEX_FILE,)], "value string").coalesce(1).write.text(path)
    rows = places.valid_index(json_store.index_rows(spark, path), 2)
    return rows.select("name", F.round(cosine(F.col("embedding"), F.array(F.lit(1.0), F.lit(2.0))), 6).alias("score"))
