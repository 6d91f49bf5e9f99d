"""Merging, placeholders, orchestration and the surfaces on top."""

import random

import pytest
from pyspark.sql import functions as F

from veil import sql
from veil.functions import model
from veil.operators import ner
from veil.operators.placeholder import placeholder, replacer
from veil.operators.spans import span
from veil.plans import catalogue, scrub


@pytest.mark.parametrize(
    ("kind", "text", "algorithm", "modulus", "want"),
    [
        ("name", "John Doe", "md5", 10000, "NAME-1729"),
        ("location", "Amsterdam", "md5", 10000, "LOCATION-7006"),
        ("email", "a@b.com", "md5", 10000, "EMAIL-8674"),
        ("private_ip", "10.0.1.2", "md5", 10000, "PRIVATE_IP-1251"),
        ("public_ip", "8.8.8.8", "md5", 10000, "PUBLIC_IP-1254"),
        ("url", "https://example.com", "md5", 10000, "URL-1048"),
        ("custom", "Foo", "md5", 10000, "CUSTOM-8533"),
        ("name", "https://example.com/x", "md5", 1000, "URL-330"),
        ("organization", "ACME", "sha256", 10, "ORGANIZATION-004"),
        ("unknown", "172.15.1.1", "md5", 10000, "UNKNOWN-9747"),
    ],
)
def test_placeholder(column, kind, text, algorithm, modulus, want):
    assert column([text], lambda c: placeholder(F.lit(kind), c, algorithm, modulus)) == [want]
    assert model.placeholder(kind, text, algorithm, modulus) == want


def test_link_keeps_its_brackets(column):
    s = lambda c: span(F.lit(0), F.lit(1), "markdown_url", c, "markdown_url", 0, F.lit("Click"), c, F.lit(2))
    assert column(["http://x"], lambda c: replacer(modulus=1000)(s(c))) == ["[[Click]](URL-900)"]


def test_end_to_end(spark):
    text = "a 172.15.1.1 b 😀 john.nl@foo.com, see www.x.org."
    df = spark.createDataFrame([(1, text), (2, None), (3, "")], "doc_id int, text string")
    wanted = ["url", "email", "private_ip", "public_ip"]
    rows = {r.doc_id: r.text for r in scrub.scrub(df, "en_US", wanted, cleanup=False).collect()}
    assert rows == {1: "a UNKNOWN-9747 b 😀 UNKNOWN-3232, see URL-4765.", 2: None, 3: ""}
    assert scrub.scrub(df, "en_US", wanted).where("doc_id = 1").first().text == "a b 😀 , see URL-4765.\n"


def test_no_shuffle_and_no_python(spark):
    df = spark.createDataFrame([(1, "a@b.com")], "doc_id int, text string")
    plan = scrub.scrub(df, "nl_NL")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan and "Arrow" not in plan


def test_random_texts_against_strings(spark):
    rng = random.Random(11)
    parts = ["John", "in New York", "a@b.com", "172.15.1.1", "8.8.8.8", "[t](example.com)", "[x](https://e.com/x)", "see", "\n", ", ", " ", "😀", "www.x.org", "+1 555 010 1234", "IBM", "born 1980-01-02", "https://t.sharepoint.com/a b"]
    texts = [(i, " ".join(rng.choices(parts, k=rng.randint(0, 10)))) for i in range(400)]
    df = spark.createDataFrame(texts, "doc_id int, text string")
    for locale in catalogue.LOCALES:
        got = {r.doc_id: r.text for r in scrub.scrub(df, locale, cleanup=False).collect()}
        assert got == {i: model.scrub(t, locale) for i, t in texts}


def test_scrubbed_texts_hold_no_addresses(spark):
    df = spark.createDataFrame([(1, "a@b.com x 8.8.8.8 y 192.168.0.1 z c@d.org")], "doc_id int, text string")
    once = scrub.scrub(df, "en_US")
    assert scrub.findings(once, "en_US", ["email", "private_ip", "public_ip"]).count() == 0


def test_selection(caplog):
    assert [s.name for s in catalogue.select("en_US", ["URL", "nope", "email"])] == ["url", "email"] and "nope" in caplog.text
    assert catalogue.select("en_US", []) == []
    assert [n for n, _ in catalogue.builders("nl_NL", None, "Foo")] == ["custom", "markdown_url", "sharepoint_url", "url", "email", "phone", "private_ip", "public_ip", "location", "organization", "name", "application"]
    assert catalogue.locale_selections(["email", "en:spacy_entities", "nl:names", "xx:y"]) == {"en_US": ["email", "spacy_entities"], "nl_NL": ["email", "names"]}
    assert catalogue.locale_selections([]) is None
    assert catalogue.plain_tokens(["en:name", "name", "nl:x", "en:"]) == ["name", "x"]
    generic, english, dutch = catalogue.grouped()
    assert "sharepoint_url" not in generic and "sharepoint_url" in english and "application" in dutch


def test_locales(spark, monkeypatch):
    df = spark.createDataFrame([(1, "John a@b.com")], "doc_id int, text string")
    rows = {r.locale: r for r in scrub.scrub_locales(df).collect()}
    assert rows["en_US"].text.startswith("NAME-") and rows["nl_NL"].text.startswith("John EMAIL-")
    assert {r.locale: r.text for r in scrub.scrub_locales(df, detectors={"en_US": ["email"]}).collect()}["nl_NL"] == "John a@b.com\n"
    assert scrub.scrub_default(df).first().text == "John EMAIL-8674\n"
    assert scrub.combined_text(scrub.scrub_locales(df)).first().text.count("EMAIL-8674") == 2
    monkeypatch.setattr(catalogue, "select", lambda locale, wanted: 1 / 0 if locale == "nl_NL" else [])
    rows = {r.locale: r for r in scrub.scrub_locales(df).collect()}
    assert rows["nl_NL"].error and rows["nl_NL"].text is None and rows["en_US"].error is None
    monkeypatch.setattr(catalogue, "select", lambda locale, wanted: 1 / 0)
    with pytest.raises(ZeroDivisionError):
        scrub.scrub_locales(df)


def test_report_and_summary(spark):
    df = spark.createDataFrame([(1, "see https://example.com now")], "doc_id int, text string")
    found = scrub.findings(df, "en_US", ["url"])
    assert scrub.report(found).first().line == "- url: 'https://example.com' -> 'URL-1048'"
    s = scrub.summary(scrub.scrub_locales(df, "en_US", ["url"], include_spans=True)).first()
    assert (s.texts, s.spans, s.errors) == (1, 1, 0)


def test_registered_detector(spark, monkeypatch):
    from veil.operators.spans import matches

    monkeypatch.setitem(catalogue.BY_LOCALE, "en_US", list(catalogue.BY_LOCALE["en_US"]))
    build = lambda text, rank: F.transform(matches(text, "ticket-\\d+"), lambda m: span(m["beg"], m["end"], "ticket", m["text"], "ticket", rank))
    catalogue.register_detector(catalogue.Spec("ticket", "Ticket numbers", lambda locale: build), "en_US")
    df = spark.createDataFrame([(1, "see ticket-12")], "doc_id int, text string")
    assert scrub.findings(df, "en_US").first().replacement.startswith("TICKET-")


def test_sql(spark):
    sql.register(spark)
    row = spark.sql("SELECT veil_placeholder('email', 'a@b.com') AS p, veil_scrub('John a@b.com', 'en_US') AS s").first()
    assert row.p == "EMAIL-8674" and row.s.endswith("EMAIL-8674")
    rows = spark.sql("SELECT d.id, p.type, p.replacement FROM VALUES (1, 'x a@b.com y'), (2, 'none') AS d(id, t), LATERAL detect_pii(d.t, 'en_US') p").collect()
    assert [tuple(r) for r in rows] == [(1, "email", "EMAIL-8674")]


def test_stream(spark, tmp_path):
    from veil.streaming import scrubbing

    spark.createDataFrame([(1, "a@b.com", "2024-01-01 00:00:00")], "doc_id int, text string, at string").selectExpr("doc_id", "text", "cast(at as timestamp) at").write.parquet(f"{tmp_path}/in")
    schema = "doc_id int, text string, at timestamp"
    stream = scrubbing.read_stream(spark, f"{tmp_path}/in", schema)
    scrubbing.scrub_to(stream, f"{tmp_path}/out", f"{tmp_path}/check", detectors=["email"]).awaitTermination()
    assert spark.read.parquet(f"{tmp_path}/out").first().text == "EMAIL-8674\n"
    counts = scrubbing.counts_by_window(scrubbing.read_stream(spark, f"{tmp_path}/in", schema), "at")
    query = counts.writeStream.outputMode("complete").format("memory").queryName("counts").trigger(availableNow=True).start()
    query.awaitTermination()
    assert [(r.type, r.n) for r in spark.table("counts").collect()] == [("email", 1)]


class Entity:
    def __init__(self, start, end, label):
        self.start_char, self.end_char, self.label_ = start, end, label


class Document:
    def __init__(self, ents):
        self.ents = ents


def test_named_entities(spark, monkeypatch):
    """With a stand-in for the model, which no machine here has."""

    def pipe(locale):
        def run(texts):
            for t in texts:
                yield Document([Entity(t.index(w), t.index(w) + len(w), x) for w, x in (("Ada", "PERSON"), ("Oslo", "GPE"), ("3", "CARDINAL")) if w in t])

        return run

    assert catalogue.builders("en_US", ["spacy_entities"]) == [] and "spacy_entities" not in catalogue.available("en_US")
    monkeypatch.setitem(catalogue.BY_LOCALE, "en_US", list(catalogue.BY_LOCALE["en_US"]))
    catalogue.register_detector(catalogue.Spec("spacy_entities", "", lambda locale: ner.builder(locale, pipe), by_default=False), "en_US")
    df = spark.createDataFrame([(1, "😀 Ada saw 3 in Oslo"), (2, None), (3, "")], "doc_id int, text string")
    found = scrub.findings(df, "en_US", ["spacy_entities"]).orderBy("beg").collect()
    assert [(r.doc_id, r.beg, r.type, r.text) for r in found] == [(1, 2, "name", "Ada"), (1, 15, "location", "Oslo")]


def test_columns_of_any_name_stay(spark):
    df = spark.createDataFrame([(1, "a@b.com", "own", "too")], "doc_id int, text string, _spans string, spans string")
    out = scrub.scrub(df, "en_US", ["email"])
    assert out.columns == df.columns and tuple(out.first())[2:] == ("own", "too")
    row = scrub.scrub_locales(df.withColumnsRenamed({"_spans": "_shared", "spans": "_row"}), detectors=["email"]).where("locale = 'nl_NL'").first()
    assert row.text == "EMAIL-8674\n"


def test_shared_detectors_run_once(spark):
    df = spark.createDataFrame([(1, "John a@b.com")], "doc_id int, text string")
    plan = scrub.scrub_locales(df)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract_all(_text") + plan.count("regexp_extract_all(coalesce(_text") <= 8 and "Union" not in plan


def test_long_texts_with_many_spans(spark):
    import time

    def seconds(n):
        df = spark.createDataFrame([(1, "é 172.15.1.1, a@b.com " * n)], "doc_id int, text string")
        start = time.time()
        text = scrub.scrub(df, "en_US", ["email", "private_ip", "public_ip"], cleanup=False).first().text
        assert text == "é UNKNOWN-9747, EMAIL-8674 " * n
        return time.time() - start

    seconds(500)
    assert seconds(20_000) < 12 * max(seconds(4_000), 0.5)
