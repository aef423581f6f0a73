"""Paged answers: tokens, ends, filters and offsets."""

from __future__ import annotations

import json
import os

import pytest
from pyspark.sql import functions as F
from pyspark.sql.datasource import EqualTo, GreaterThan, In

from leadmill.sources import paged


@pytest.fixture
def folder(tmp_path):
    def put(request, **pages):
        os.makedirs(tmp_path / request, exist_ok=True)
        for token, body in pages.items():
            (tmp_path / request / f"{token}.json").write_text(body if isinstance(body, str) else json.dumps(body))

    put("a", first={"places": [1, {"x": "é"}], "nextPageToken": "t2"}, t2={"places": [], "nextPageToken": "t3"}, t3={"places": ["z"]})
    put("b", first={"places": [2], "nextPageToken": "gone"})
    put("c", first={"places": [3], "nextPageToken": "first"})  # a circle
    put("d", first="{broken")
    put("e", first={"places": None, "nextPageToken": "t2"}, t2="[]")
    put("f")
    (tmp_path / "_tmp").mkdir()
    return tmp_path, put


def rows(df):
    return sorted((r.request, r.page, r.pos, json.loads(r.place) if r.place[0] != '"' else r.place) for r in df.collect())


def test_pages_are_followed_to_their_end(spark, folder):
    paged.register(spark)
    read = lambda **o: spark.read.format("paged").options(path=f"file://{folder[0]}", **o).load()
    assert rows(read()) == [("a", 1, 0, 1), ("a", 1, 1, {"x": "é"}), ("a", 3, 0, '"z"'), ("b", 1, 0, 2), ("c", 1, 0, 3)]
    assert rows(read(mostPages=1, requestsPerTask=1)) == [("a", 1, 0, 1), ("a", 1, 1, {"x": "é"}), ("b", 1, 0, 2), ("c", 1, 0, 3)]
    assert rows(read().where("request = 'b' or request = 'c'").where("page = 1")) == [("b", 1, 0, 2), ("c", 1, 0, 3)]
    assert spark.read.format("paged").option("path", f"file://{folder[0]}/none").load().count() == 0


def test_a_filter_opens_no_other_request(folder):
    reader = paged.PagedReader({"path": str(folder[0])})
    assert len(list(reader.pushFilters([In(("request",), ["a", "b", "zz"]), EqualTo(("request",), "b"), GreaterThan(("page",), 1)]))) == 1
    assert [p.names for p in reader.partitions()] == [["b"]]


def test_a_stream_goes_on_after_its_offset(spark, folder, tmp_path_factory):
    path, put = folder
    out = tmp_path_factory.mktemp("out")
    paged.register(spark)

    def step():
        stream = spark.readStream.format("paged").option("path", f"file://{path}").load()
        stream.writeStream.format("parquet").option("checkpointLocation", f"file://{out}/c").option("path", f"file://{out}/rows").trigger(availableNow=True).start().awaitTermination()
        return rows(spark.read.schema(paged.SCHEMA).parquet(f"file://{out}/rows"))

    assert [r[0] for r in step()] == ["a", "a", "a", "b", "c"]
    put("g", first={"places": [9, 8]})
    assert [r[0] for r in step()] == ["a", "a", "a", "b", "c", "g", "g"]
    assert [r[0] for r in step()] == ["a", "a", "a", "b", "c", "g", "g"]


def test_what_is_captured_is_read(spark, tmp_path):
    answers = spark.range(95).select(F.concat(F.lit("q"), F.col("id") % 3).alias("request"), F.floor(F.col("id") / 3).cast("int").alias("pos"), F.concat(F.lit('{"id": '), "id", F.lit("}")).alias("place"))
    paged.capture(answers, f"file://{tmp_path}/x", per_page=10)
    paged.register(spark)
    got = spark.read.format("paged").option("path", f"file://{tmp_path}/x").load()
    assert sorted(json.loads(r.place)["id"] for r in got.collect()) == list(range(95))
    assert got.groupBy("request", "page").count().agg(F.max("count"), F.max("page")).first()[:] == (10, 4)
