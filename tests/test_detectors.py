"""Detectors: examples, and Spark's expressions against the string versions on random texts."""

import random

import pytest

from veil.functions import model
from veil.operators import detectors as D
from veil.operators.gazetteer import Gazetteer, in_order, joined_spans


def hits(column, text, build):
    return [s["text"] for s in column([text], lambda c: build(c, 0))[0]]


def test_custom(column):
    phrase = lambda p: lambda c, r: D.custom(c, r, p)
    assert hits(column, "Zed met Zed and zed", phrase(" Zed ")) == ["Zed", "Zed"]
    assert hits(column, "anything", phrase("")) == [] and hits(column, "", phrase("x")) == []
    assert [s["beg"] for s in column(["aaa"], lambda c: D.custom(c, 0, "aa"))[0]] == [0, 1]
    assert hits(column, "a.b a+b (x) [y]", phrase("a+b (x) [y]")) == ["a+b (x) [y]"]
    assert [s["beg"] for s in column(["(.(.(. é(.(."], lambda c: D.custom(c, 0, "(.(."))[0]] == [0, 2, 8]


def test_markdown_url(column):
    text = "See [the menu](http://kiosk.io/m?day=2&lang=nl), [[Map]](<https://maps.org/z)> or [[torn](nowhere)."
    got = column([text], lambda c: D.markdown_url(c, 0))[0]
    assert [(s["link_text"], s["bracket_pairs"]) for s in got] == [("the menu", 1), ("Map", 2)]
    assert got[0]["url"] == "http://kiosk.io/m?day=2&lang=nl"


@pytest.mark.parametrize(
    ("text", "yes", "no"),
    [
        ("order at kiosk.io/menu or www.Kiosk.org, mirror FTP://files.dev. share epoint.com came from sharepoint", {"kiosk.io/menu", "www.Kiosk.org", "FTP://files.dev"}, {"epoint.com"}),
        ("sharepoint\nmoved to\npoint.com", set(), {"point.com"}),
        ("never Big.Shop.com, but www.Big.com and https://Big.dev", {"www.Big.com", "https://Big.dev"}, {"Big.Shop.com"}),
        ("torn: epoint.com\nharepoint.com\nand point.com, all of one sharepoint", set(), {"epoint.com", "harepoint.com", "point.com"}),
        ("[t](https://e.com/x)", {"e.com/x"}, set()),
        ("main.py", {"main.py"}, set()),
    ],
)
def test_url(column, text, yes, no):
    found = set(hits(column, text, D.url))
    assert yes <= found and not no & found


def test_sharepoint(column):
    text = "minutes: https://acme.sharepoint.com/teams/q3/Plan (draft), budget: HTTPS://Fin.SharePoint.com/b?id=7;"
    assert hits(column, text, D.sharepoint_url) == ["https://acme.sharepoint.com/teams/q3/Plan", "HTTPS://Fin.SharePoint.com/b?id=7"]


def test_ip(column):
    text = "hosts: 192.168.40.7, 10.0.3.77 or 172.31.9.8, outside 1.1.1.1 as well as 208.67.222.222."
    assert hits(column, text, D.private_ip) == ["192.168.40.7", "10.0.3.77", "172.31.9.8"]
    assert hits(column, text, D.public_ip) == ["1.1.1.1", "208.67.222.222"]
    for text, private, public in [("172.15.1.1", 1, 1), ("10.1.2.3", 0, 1), ("999.999.999.999", 0, 1)]:
        assert (len(hits(column, text, D.private_ip)), len(hits(column, text, D.public_ip))) == (private, public)
    assert hits(column, "192.168.1.1.5.6", D.private_ip) == ["192.168.1.1"] and hits(column, "192.168.1.1.5.6", D.public_ip) == ["168.1.1.5"]


def test_phone_and_birth(column):
    assert hits(column, "call +1 (555) 010-1234 or 06-12345678, not 10.20.30.40 or 4111 1111 1111 1111", D.phone) == ["+1 (555) 010-1234", "06-12345678"]
    birth = lambda c, r: D.date_of_birth(c, r, 2025)
    assert hits(column, "Born on 12/03/1980. Met 01/02/1990. DOB: 1999-12-31; born 1 May 2024; date of birth March 5, 1960", birth) == ["12/03/1980", "1999-12-31", "March 5, 1960"]


def test_phone_spans_as_sql(spark, tmp_path):
    import duckdb

    import __spark_entry__ as entry_point

    rng = random.Random(11)
    bits = ["+1 ", "(555) ", "555-010-1234", "555 010.", "555", "010", "1234", "06-12345678", "+31 6 12345678", "٣", "a", "é", "😀", "_", "+", "(", ")", " ", ".", "-", "\n", "38.253.", "4880761348116108"]
    given = ["by 38.253.197.126 4880761348116108", "call +1 (555) 010-1234", "x555-010-1234", "555-010-12345", "555-010-1234-555-010-1234", "٣٣٣-٣٣٣-٣٣٣٣", "", None]
    texts = [*given, *("".join(rng.choices(bits, k=rng.randint(0, 60))) for _ in range(1500))]
    spark.createDataFrame([(i, t, "en", "web") for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(map(tuple, entry_point.queries()["phone_spans"](spark, str(tmp_path)).collect()))
    duckdb.sql(f"CREATE OR REPLACE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    assert got == sorted(duckdb.sql(entry_point.oracle_sql()["phone_spans"]).fetchall())
    assert got[0] == (0, 10, 22, "197.126 4880") and len(got) > 1000


def test_phone_leaves_parts_of_longer_numbers(column):
    assert hits(column, "by 38.253.197.126 4880761348116108, call 555-010-1234", D.phone) == ["555-010-1234"]


ALPHABET = ["a", "b", "Z", "é", "É", "1", "172", "10", "0", "192", "168", ".", ".", " ", "\n", "/", ":", "//", "@", "-", "(", ")", "[", "]", "<", ">", "http", "https://", "www.", "sharepoint.com/", "share", "point.com", "epoint.com", "com", "nl", ",", " ", "😀", "\t", " at ", " dot ", "born ", "1980-01-02", "+1 555 010 1234", "Mia", "New York", "](", "172.16.1.1", "192.168.0.1", "10.0.1.2", "8.8.8.8"]


@pytest.mark.parametrize("name", ["markdown_url", "sharepoint_url", "url", "email", "phone", "private_ip", "public_ip", "date_of_birth"])
def test_against_strings(column, name):
    rng = random.Random(name)
    texts = ["".join(rng.choices(ALPHABET, k=rng.randint(0, 25))) for _ in range(1500)]
    build = getattr(D, name)
    got = [[(s["beg"], s["end"], s["type"], s["text"], s["link_text"]) for s in x] for x in column(texts, lambda c: build(c, 0))]
    want = [[(s.beg, s.end, s.kind, s.text, s.link_text) for s in model.DETECTORS[name](t)] for t in texts]
    assert got == want
    assert sum(map(len, want)) > 2


def places(text, entities, kind="name", stop=()):
    return [text[b:e] for b, e in Gazetteer(kind, tuple(entities), frozenset(stop)).find(text)]


def test_gazetteer_rules():
    assert places("Lea rang from http://lea.org and met Lea Moss by the moss.", ["", "x", "moss", "Lea", "Lea Moss"], stop=["moss"]) == ["Lea", "Lea Moss"]
    assert "Salt & Rye" in places("A Salt & Rye B and S\u200ba\u200blt en \u200bR\u200bye C", ["Salt & Rye"], "organization")
    found = places("qrsq qrs Orbis orbis ORBIS; www.orbis.com", ["qr", "qrs", "Orbis"], "organization")
    assert "Orbis" in found and not {"qrs", "qr", "orbis"} & set(found)
    for text in ("NoteKeeper", "notekeeper", "NOTEKEEPER"):
        assert places(f"Open {text} now.", ["NoteKeeper"], "application") == [text]
    assert [len(places(f"Open {x} now.", ["Ink"], "application")) for x in ("Ink", "ink", "Inkpot")] == [1, 0, 0]
    assert places("go to https://kiosk.io/NoteKeeper/help first", ["NoteKeeper"], "application") == []
    assert places("Both Ledger and TIDE are in use.", ["Ledger", "TIDE"], "application") == ["Ledger", "TIDE"]
    assert places("in New York", ["New York", "York"], "location") == ["New York"]
    assert places("Utrecht.Then on", ["Utrecht"], "location") == []


def test_first_list_keeps_an_entity():
    lists = in_order([Gazetteer("location", ("Bank", "Town", "CRM")), Gazetteer("organization", ("Bank",)), Gazetteer("application", ("crm", "Mail"))])
    assert [g.loaded for g in lists] == [("Bank", "Town", "CRM"), (), ("Mail",)]


def test_join_finds_what_the_automaton_finds(spark):
    rng = random.Random(5)
    words = ["New", "York", "new", "york", "Ann", "ann", "O'Neil", "Coca-Cola", "_Ann_", "É", "Été", "(Ann)", "www.Ann.com", "Ann.", "x", "IBM", "ibm", "[IBM]", "\n", "a.Ann"]
    lists = {"name": ("Ann", "O'Neil", "Été"), "location": ("New York", "York"), "organization": ("IBM", "Coca-Cola", "New")}
    texts = [(i, " ".join(rng.choices(words, k=rng.randint(0, 12)))) for i in range(300)]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    entities = spark.createDataFrame([(k, e) for k, es in lists.items() for e in es], "kind string, match string")
    got = {(r.doc_id, r.kind, r.beg, r.end) for r in joined_spans(docs, entities, []).collect()}
    want = set()
    for kind, es in lists.items():
        g = Gazetteer(kind, es)
        g.__dict__["several_words"] = []
        want |= {(i, kind, b, e) for i, t in texts for b, e in g.find(t)}
    assert got == want and len(want) > 100
