"""Operators on awkward rows: null keys, ties, empty tables, columns of one side."""

from __future__ import annotations

import math

import pytest
from pyspark.sql import functions as F

from leadmill.functions import email as E
from leadmill.functions import extraction as X
from leadmill.operators import evidence, funnel, jobs, links, merge, places, ranks, records, select, sheets
from leadmill.streaming import loops

TABLE = "k string, v long"


def rows(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=str)


def test_upsert_with_null_keys_and_new_columns(spark):
    old = spark.createDataFrame([("a", 1), ("b", 2), (None, 3)], TABLE)
    new = spark.createDataFrame([("b", 5, "x"), ("b", 4, "y"), (None, 9, "z"), ("c", None, None)], "k string, v long, more string")
    got = rows(merge.upsert(old, new, ["k"], [F.desc("v")]), "k", "v", "more")
    assert got == sorted([("a", 1, None), ("b", 5, "x"), (None, 3, None), (None, 9, "z"), ("c", None, None)], key=str)
    assert merge.upsert(old, new.where("false"), ["k"], [F.desc("v")]).count() == 3
    assert merge.upsert(old.where("false"), new, ["k"], [F.desc("v")]).count() == 3


def test_inserts_replacements_and_deletes_with_null_keys(spark):
    old = spark.createDataFrame([("a", 1), ("b", 2), (None, 3)], TABLE)
    new = spark.createDataFrame([("b", 5), ("c", 6), ("c", 6), (None, 9)], TABLE)
    assert rows(merge.insert_if_absent(old, new, ["k"]), "k", "v") == sorted([("a", 1), ("b", 2), (None, 3), ("c", 6), (None, 9)], key=str)
    assert rows(merge.replace_partition(old, new, ["k"]), "k", "v") == sorted([("a", 1), (None, 3), ("b", 5), ("c", 6), ("c", 6), (None, 9)], key=str)
    assert rows(merge.delete_by_key(old, new.select("k")), "k", "v") == sorted([("a", 1), (None, 3)], key=str)
    assert rows(funnel.pending(old, new, ["k"]), "k") == sorted([("a",), (None,)], key=str)


def test_propagate_needs_another_source(spark):
    t = spark.createDataFrame([("x", 1, "o"), ("x", 2, "o"), ("y", 3, "o"), (None, 4, "o"), ("x", None, "o")], "k string, r long, s string")
    got = rows(merge.propagate(t, t.where("r in (1, 3)"), "k", "r", s="SENT"), "k", "r", "s")
    assert got == sorted([("x", 1, "o"), ("x", 2, "SENT"), ("y", 3, "o"), (None, 4, "o"), ("x", None, "o")], key=str)


def test_first_row_per_key_is_cut_before_the_shuffle(spark):
    df = spark.createDataFrame([("a", i) for i in range(50)], TABLE).repartition(4, "v")
    out = merge.last_per_key(df, ["k"], [F.desc("v")])
    assert [r.v for r in out.collect()] == [49]
    assert "WindowGroupLimit" in out._jdf.queryExecution().executedPlan().toString()


def test_percentiles_are_exact(spark):
    df = spark.createDataFrame([("a", float(i)) for i in range(11)] + [("b", 7.0), ("c", None), (None, 1.0), (None, 2.0)], "k string, v double").repartition(3)
    got = {r.k: (r.low, r.mid) for r in ranks.percentiles(df, "k", "v", {"low": 0.05, "mid": 0.5}).collect()}
    assert got["a"] == (0.5, 5.0) and got["b"] == (7.0, 7.0) and "c" not in got
    assert ranks.percentiles(df.where("false"), "k", "v", {"mid": 0.5}).count() == 0


def test_nearest_without_a_query_or_of_other_lengths(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, [1.0]), (4, None), (5, [1.0, 1.0])], "vec_id long, embedding array<double>")
    q = spark.createDataFrame([([2.0, 0.0],)], "query array<double>")
    assert [(r.vec_id, r.score) for r in select.nearest(v, q, 5).collect()] == [(1, 1.0), (5, round(math.sqrt(0.5), 6)), (2, 0.0)]
    assert select.nearest(v, q.where("false"), 5).count() == 0


@pytest.mark.parametrize(("n", "chunks"), [(0, {0: 2}), (5, {0: 3, 1: 4}), (6, {0: 3, 1: 5})])
def test_sheets_end_in_two_blank_rows(spark, tmp_path, n, chunks):
    df = spark.createDataFrame([(f"k{i}", i) for i in range(n)], TABLE)
    out = sheets.export(df, ["k", "v", "none"], [F.col("k")], f"file://{tmp_path}/s", rows=3)
    assert {r.chunk: r.n_rows for r in out.collect()} == chunks


def test_validation_of_every_kind(spark):
    cases = {None: "empty", "": "empty", "a@b": "short", "x" * 260: "long", "nothing": "Missing", "a@b@c.de": "found 2", "@bcd.de": "Local", "abcde@": "after", "abc@de": "dot", "abc@d..e": "consecutive", "a c@de.fg": "pattern", " Abc@De.fg ": None}
    df = spark.createDataFrame([(k,) for k in cases], "e string").select("e", E.reason(F.col("e")).alias("r"), E.warnings(F.col("e")).alias("w"), X.plausible(F.col("e")).alias("p"))
    for r in df.collect():
        assert (r.r is None and r.p) if cases[r.e] is None else cases[r.e] in r.r and not r.p and r.w == []


def test_empty_tables_give_empty_results(spark):
    none = lambda ddl: spark.createDataFrame([], ddl)
    pages = none("request_id string, domain string, url string, page_type string, seq long, company_json string, description_json string, emails_json string, contacts_json string")
    keys = ["request_id", "domain"]
    for found in (evidence.companies(pages, keys), evidence.emails(pages, keys), evidence.contacts(pages, keys), evidence.plain_emails(pages, keys)):
        assert evidence.grouped(found, keys).count() == 0
    assert evidence.select_emails(evidence.emails(pages, keys), evidence.plain_emails(pages, keys), keys, "domain").count() == 0
    site = none("page_id long, url string, html string, links_json string")
    assert links.discovered(site).count() == 0 and links.site_links(site, none("url string, tail string")).count() == 0
    assert jobs.fold(jobs.read_log(none("value string"))[0]).count() == 0
    assert places.run_places(places.leads_of(none("call int, text_query string, location string, places string")))[1].count() == 0
    assert places.or_default(none("token string, country string, country_name string, lat double, lng double")).count() == 3
    assert records.section_emails(none("id long, section string"), ["id"]).count() == 0
    assert X.emails_of_domains(none("domain string, url string, final_url string, page_type string, cleaned_html string, markdown string")).count() == 0


def test_a_batch_that_runs_again_changes_nothing(spark):
    """The fold of a stream names its output by epoch: the same input twice gives the same state."""
    df = spark.createDataFrame([(k, v, v) for k, v in (("a", 1), ("a", 5), ("b", 2), ("a", 3))], "k string, e long, m long")
    said = loops.watch_changes(loops.in_parts(df, F.col("e") < 3), "k", "e", "m")
    got = rows(said, "epoch", "k", "enrichment_changed", "any_changed")
    assert got == [(0, "a", True, True), (0, "b", True, True), (1, "a", True, True)]
    older = loops.watch_changes(loops.in_parts(df, F.col("e") > 3), "k", "e", "m")
    assert rows(older.where("epoch = 1 and k = 'a'"), "any_changed") == [(False,)]


def test_entities_alone_are_undone_as_in_their_text(spark):
    """Every spelling of an entity, in any surroundings, as the standard library undoes it; Python gets the entities and not the text."""
    import html
    from html.entities import html5

    from leadmill.functions import extraction as X

    texts = [None, "", "&", "a && b", "&amp;amp; &ampx &notit; &notin; &noti", "&#64;&#x40;&#X40 &#0;&#128;&#1114112;&#xD800;&#11;&#;&#x;", "x&" + "y" * 40 + ";z", "&ä&lt\n&gt\t&\U0001f600amp;", "?a=1&b=2&copy=3&amp", "&lt;&gt;" * 50]
    names = sorted(html5)
    texts += ["".join(f"{i}&{n}" for i, n in enumerate(names[at : at + 200])) for at in range(0, len(names), 200)] + ["t " * 5000 + "&amp;"]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, t string").repartition(2)
    got = dict(df.select("id", X.unescaped(F.col("t"))).collect())
    assert [got[i] for i in range(len(texts))] == [None if t is None else html.unescape(t) for t in texts]
    plan = df.select(X.unescaped(F.col("t")).alias("x"))._jdf.queryExecution().executedPlan().toString()
    assert "entities_undone(CASE WHEN Contains" in plan and "regexp_extract_all" in plan


def test_a_log_is_folded_in_one_pass(spark, tmp_path):
    """The log is scanned once, and entries with several metrics, one or none fold as they did apart."""
    rows = [("j1", "t", "r", "RUNNING", 5, None, 1, None, None, {"a": "1", "b": "2"}, None), ("j1", "u", "s", "FAILED", 9, "p", None, 7, "m", {"b": "3"}, "e"), ("j1", "t", "r", None, 7, "q", 4, None, None, {}, None), ("j2", "t", "r", "QUEUED", 1, None, None, None, None, None, None)]
    spark.createDataFrame(rows, jobs.LOG).write.parquet(str(tmp_path / "log"))
    out = jobs.fold(spark.read.parquet(str(tmp_path / "log")))
    got = {r.job_id: r.asDict() for r in out.collect()}
    assert got["j1"] == {"job_id": "j1", "tool": "t", "request_id": "r", "state": "FAILED", "started_us": 5, "finished_us": 9, "updated_us": 9, "phase": "p", "current": 4, "total": 7, "message": "m", "metrics": {"a": "1", "b": "3"}, "error": "e"}
    assert got["j2"]["metrics"] is None and got["j2"]["state"] == "QUEUED" and got["j2"]["started_us"] is None and got["j2"]["error"] is None
    assert out._jdf.queryExecution().optimizedPlan().toString().count("Relation [") == 1
