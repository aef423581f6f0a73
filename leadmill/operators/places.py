"""Places, locations and search plans: captured API answers to leads, with counters."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leadmill.functions import text as T
from leadmill.functions.domain import is_social, normalize_domain, place_excluded

POINT = "struct<lat:double,lng:double>"
PLACE = "displayName struct<text:string>, primaryType string, types array<string>, websiteUri string"
GEOCODED = f"status string, results array<struct<types:array<string>,address_components:array<struct<long_name:string,short_name:string,types:array<string>>>,geometry:struct<location:{POINT},viewport:struct<northeast:{POINT},southwest:{POINT}>>>>"
LOCATION = "country string, state string, city string, continent string, region string, business_region string"
PLAN = f"request_id string, prompt_target string, prompt_target_en string, normalized_prompt_en string, prompt_keywords array<string>, places_text_queries array<string>, prompt_location array<string>, global_search boolean, sheet_id string, google_sheet_id string, resolved_locations array<struct<{', '.join(f.replace(' ', ':') for f in LOCATION.split(', '))}>>"
#: Words too general to search for, and the countries searched where a plan names none (code, name, latitude, longitude).
BANNED = ["company", "companies", "business", "businesses", "service", "services", "product", "products", "solution", "solutions", "enterprise", "organization", "organisation", "industry", "industries", "market", "global", "international"]
DEFAULTS = [("AT", "Austria", 47.516231, 14.550072), ("CH", "Switzerland", 46.818188, 8.227512), ("DE", "Germany", 51.165691, 10.451526)]
MOST_WORDS, MOST_QUERIES = 10, 3

trimmed = T.blank_to_null


def location_path(country: Column, state: Column, city: Column) -> Column:
    """country/state/city, what there is of it."""
    return F.concat_ws("/", trimmed(country), trimmed(state), trimmed(city))


def location_shown(country: Column, state: Column, city: Column) -> Column:
    tagged = lambda tag, c: F.concat(F.lit(f"{tag}:"), trimmed(c))
    return F.coalesce(T.blank_to_null(F.concat_ws(",", tagged("COUNTRY", country), tagged("STATE", state), tagged("CITY", city))), F.lit("NONE"))


def country_of(path: Column) -> Column:
    """What stands before the first slash; empty for none and for a dash."""
    p = F.trim(F.coalesce(path, F.lit("")))
    return F.when(p.isin("", "-"), "").otherwise(F.trim(F.split_part(p, F.lit("/"), F.lit(1))))


def valid_rectangle(rectangle: Column) -> Column:
    """All four corners of a rectangle of texts are numbers."""
    corners = [rectangle[a][b] for a in ("low", "high") for b in ("latitude", "longitude")]
    return F.coalesce(reduce(lambda x, y: x & y, [c.try_cast("double").isNotNull() for c in corners]), F.lit(False))


def leads_of(answers: DataFrame) -> DataFrame:
    """``answers`` (call, text_query, location, places: JSON list) to a row per place that is no lead for a reason, or is one.

    (call, pos, query, location, organization, domain, excluded, social); a place without a website is no row.
    """
    d = answers.select("call", "text_query", "location", F.posexplode(F.from_json("places", f"array<struct<{_fields(PLACE)}>>")).alias("pos", "p"))
    site = trimmed(F.col("p.websiteUri"))
    d = d.withColumn("domain", F.coalesce(normalize_domain(site), F.lower(site))).withColumn("excluded", place_excluded(F.col("p.primaryType"), F.col("p.types")))
    d = d.where(F.col("excluded") | F.col("domain").isNotNull())
    organization = F.coalesce(trimmed(F.col("p.displayName.text")), F.lit("Unknown"))
    return d.select("call", "pos", F.col("text_query").alias("query"), "location", organization.alias("organization"), "domain", "excluded", (~F.col("excluded") & is_social(F.col("domain"))).alias("social"))


def _fields(ddl: str) -> str:
    """Columns of a DDL string as fields of a struct."""
    depth, out = 0, []
    for part in ddl.split(", "):
        out.append(part.replace(" ", ":", 1) if not depth else part)
        depth += part.count("<") - part.count(">")
    return ",".join(out)


def run_places(found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(leads, counters): of each domain the last lead, and per query how many were added, updated, ignored, excluded and social.

    A lead is added where its domain is first met in order of (call, pos), ignored where it equals the one before, else an update.
    """
    good = found.where(~F.col("excluded") & ~F.col("social"))
    lead = F.struct("query", "location", "organization")
    before = F.lag(lead).over(Window.partitionBy("domain").orderBy("call", "pos"))
    steps = good.withColumn("_b", before).withColumn("step", F.when(F.col("_b").isNull(), "added").when(F.col("_b") == lead, "ignored").otherwise("updated"))
    leads = good.groupBy("domain").agg(F.max_by(lead, F.struct("call", "pos")).alias("l")).select("domain", "l.*")
    bad = found.where(F.col("excluded") | F.col("social")).select("query", F.when(F.col("excluded"), "excluded").otherwise("social").alias("step"))
    names = ["added", "updated", "ignored", "excluded", "social"]
    counted = steps.select("query", "step").unionByName(bad).groupBy("query").agg(*(F.count_if(F.col("step") == n).alias(n) for n in names), F.count("*").alias("returned"))
    return leads, counted.withColumn("kept_rate", F.round(F.coalesce(F.try_divide(F.col("added").cast("double"), F.col("returned")), F.lit(0.0)), 4))


def resolved(answers: DataFrame) -> DataFrame:
    """``answers`` (token, response: JSON of a geocoder) to (token, kind, city, state, country, country_name, lat, lng, low_lat, low_lng, high_lat, high_lng).

    Only cities, states and countries with a code, a location and a viewport resolve; a country has no city or state, a state no city.
    A country goes where a city or state of it is there too.
    """
    d = answers.select("token", F.from_json("response", GEOCODED).alias("r")).where("r.status = 'OK'").select("token", F.get(F.col("r.results"), F.lit(0)).alias("r"))
    has = lambda t: F.coalesce(F.array_contains("r.types", t), F.lit(False))
    kind = F.when(has("locality") | has("sublocality"), "city").when(has("administrative_area_level_1"), "state").when(has("country"), "country").when(has("continent"), "continent").otherwise("unknown")
    part = lambda t, f: F.element_at(F.filter("r.address_components", lambda c: F.array_contains(c["types"], t)), -1)[f]
    listed = F.size(F.coalesce("r.address_components", F.array())) > 0
    of = lambda t, f: F.when(listed & F.exists("r.address_components", lambda c: F.array_contains(c["types"], t)), part(t, f))
    g, v = "r.geometry.location", "r.geometry.viewport"
    d = d.where(f"{g} is not null and {v} is not null").select(
        "token", kind.alias("kind"), of("locality", "long_name").alias("city"), of("administrative_area_level_1", "long_name").alias("state"), of("country", "short_name").alias("country"), of("country", "long_name").alias("country_name"),
        F.col(f"{g}.lat").alias("lat"), F.col(f"{g}.lng").alias("lng"), F.col(f"{v}.southwest.lat").alias("low_lat"), F.col(f"{v}.southwest.lng").alias("low_lng"), F.col(f"{v}.northeast.lat").alias("high_lat"), F.col(f"{v}.northeast.lng").alias("high_lng"),
    )
    d = d.where("kind in ('city', 'state', 'country') and country is not null")
    d = d.withColumns({"city": F.when(F.col("kind") == "city", F.col("city")), "state": F.when(F.col("kind") != "country", F.col("state"))})
    inner = d.where("kind <> 'country'").select("country").distinct().withColumn("_narrow", F.lit(True))
    return d.join(inner, "country", "left").where("kind <> 'country' or _narrow is null").select(d.columns)


def or_default(locations: DataFrame) -> DataFrame:
    """``locations`` (token, country, country_name, lat, lng), or the default countries where there is none."""
    spark = locations.sparkSession
    none = spark.createDataFrame([(None, *d) for d in DEFAULTS], "token string, country string, country_name string, lat double, lng double")
    some = locations.agg((F.count("*") > 0).alias("_some"))
    given = locations.select(none.columns)
    return given.unionByName(none.crossJoin(F.broadcast(some)).where("not _some").drop("_some"))


def clean_keywords(words: Column) -> Column:
    """Letters alone, lower case, no general words, each once, ten at most."""
    low = F.transform(F.coalesce(words, F.array().cast("array<string>")), lambda w: F.regexp_replace(F.lower(F.trim(w)), "[^a-z]", ""))
    return F.slice(F.array_distinct(F.filter(low, lambda w: (w != "") & ~w.isin(BANNED))), 1, MOST_WORDS)


def clean_queries(queries: Column) -> Column:
    """Trimmed, each once without case, three at most."""
    q = F.filter(F.transform(F.coalesce(queries, F.array().cast("array<string>")), lambda x: F.trim(x)), lambda x: x != "")
    keys = F.transform(q, F.lower)
    return F.slice(F.filter(q, lambda x, i: F.array_position(keys, F.lower(x)) == i + 1), 1, MOST_QUERIES)


def effective(location: Column) -> Column:
    """The narrowest usable place: city with country, country, continent, business region; NULL for none."""
    country, city, continent = (trimmed(location[c]) for c in ("country", "city", "continent"))
    region = F.coalesce(trimmed(location["region"]), trimmed(location["business_region"]))
    named = lambda k, c: F.concat(F.lit(f"{k}="), c)
    return F.coalesce(F.concat(named("country", country), F.lit(";"), named("city", city)), named("country", country), named("continent", continent), named("business_region", region))


def parse_plans(plans: DataFrame, column: str = "plan") -> tuple[DataFrame, DataFrame]:
    """(requests, rejected lines): plans with a request id and something to search for; every text trimmed, the first that is not blank."""
    d = plans.select(F.col(column).alias("_line"), F.from_json(column, PLAN).alias("p"))
    first = lambda *names: F.coalesce(*(trimmed(F.col(f"p.{n}")) for n in names))
    where = F.array_distinct(F.array_compact(F.transform(F.coalesce("p.resolved_locations", F.array()), effective)))
    d = d.select(
        "_line", first("request_id").alias("request_id"), first("prompt_target", "prompt_target_en", "normalized_prompt_en").alias("target"), first("sheet_id", "google_sheet_id").alias("sheet_id"), clean_keywords(F.col("p.prompt_keywords")).alias("keywords"),
        clean_queries(F.col("p.places_text_queries")).alias("queries"), F.when(F.coalesce("p.global_search", F.lit(False)), F.lit(None)).otherwise(F.col("p.prompt_location")).alias("prompt_location"), where.alias("locations"),
    )
    ok = F.col("request_id").isNotNull() & (F.col("target").isNotNull() | (F.size("keywords") > 0))
    return d.where(ok).drop("_line"), d.where(~ok).select("_line")


def first_seen(items: Column) -> Column:
    """Each non-blank country of paths once, in order."""
    return F.array_distinct(F.filter(F.transform(items, country_of), lambda c: c != ""))


def valid_index(rows: DataFrame, dimension: int | Column) -> DataFrame:
    """Rows of an index (name, embedding) that have a name and a vector of the index's length."""
    return rows.where((F.trim("name") != "") & (F.size("embedding") == dimension) & ~F.exists("embedding", lambda x: x.isNull()))


def missing_names(names: DataFrame, index: DataFrame) -> DataFrame:
    """Names that the index lacks, each once: what is still to embed and append."""
    return names.select("name").distinct().join(index.select("name"), "name", "left_anti")
