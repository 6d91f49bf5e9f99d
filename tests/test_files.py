"""Readers, sinks, entities and the command line."""

import json
import os

import pytest

from veil import cli, entities
from veil.operators import gazetteer
from veil.plans import catalogue
from veil.sources import readers, sinks
from veil.sources.truetype import read_font


def test_formats():
    assert sinks.infer_format(None, "pdf") == "pdf"
    assert [sinks.infer_format(f"x{e}") for e in (".docx", ".doc", ".pdf", ".md", ".markdown", ".txt", "")] == ["docx", "docx", "pdf", "md", "md", "txt", "txt"]
    with pytest.raises(ValueError):
        sinks.encode("x", "odt")


def test_conversions():
    text = "One & <two>\nthree\n\nfour é"
    assert readers.convert("DOCX", sinks.docx_bytes(text)) == "One & <two>\nthree\nfour é"
    rtf = rb"{\rtf1\ansi{\fonttbl{\f0 Arial;}}{\*\gen x}Hello \b bold\b0\par caf\'e9 \u8364?\tab end}"
    assert readers.convert("rtf", rtf) == "Hello bold\ncafé €\tend"
    for fmt, content in (("odt", b""), ("docx", b"no zip"), ("rtf", b"no rtf")):
        with pytest.raises(readers.ConversionError):
            readers.convert(fmt, content)


def test_pdf_is_well_formed():
    data = sinks.pdf_bytes("\n".join(f"line {i} (x)" for i in range(200)))
    assert data.startswith(b"%PDF-1.4") and data.endswith(b"%%EOF\n") and data.count(b"/Type /Page ") == 4
    start = int(data.rsplit(b"startxref\n", 1)[1].split()[0])
    assert data[start:].startswith(b"xref")
    first = int(data[start:].split(b"\n")[3][:10])
    assert data[first:].startswith(b"1 0 obj")
    assert b"(a b) Tj" in sinks.pdf_bytes("a\nb", wrap=True)


def test_files_round_trip(spark, tmp_path):
    docs = spark.createDataFrame([("a", "One\ntwo"), ("b", "Zwölf"), ("c", None)], "name string, text string")
    for fmt in ("txt", "docx", "md"):
        sinks.write_documents(docs, f"{tmp_path}/{fmt}", fmt)
        rows = {r.path.rsplit("/", 1)[1]: r.text for r in readers.read_files(spark, f"{tmp_path}/{fmt}").collect()}
        assert rows == {f"a.{fmt}": "One\ntwo", f"b.{fmt}": "Zwölf", f"c.{fmt}": ""}
    sinks.write_documents(docs, f"{tmp_path}/pdf", "pdf", pdf_mode="para")
    assert (tmp_path / "pdf" / "a.pdf").read_bytes().startswith(b"%PDF")
    (tmp_path / "bad.txt").write_bytes(b"a\xffb")
    (tmp_path / "x.png").write_bytes(b"no image")
    rows = {r.path.rsplit("/", 1)[1]: r for r in readers.read_files(spark, f"{tmp_path}/*.*", strict=False).collect()}
    assert rows["bad.txt"].text == "a�b" and (rows["x.png"].error or rows["x.png"].text is not None)


FONT = "/usr/share/fonts/truetype/dejavu/DejaVuSans.ttf"


def test_pdf_of_other_characters(tmp_path):
    with pytest.raises(ValueError, match="Helvetica lacks"):
        sinks.pdf_bytes("Zażółć")
    if not os.path.exists(FONT):
        pytest.skip("no TrueType font here")
    data = sinks.pdf_bytes("Zażółć (x)\nλόγος", font=FONT)
    font = read_font(FONT)
    assert b"/FontFile2" in data and b"".join(b"%04X" % font.glyph(c) for c in "λόγος") in data and font.data in data
    assert all(font.glyph(c) and 100 < font.width(font.glyph(c)) < 1500 for c in "Zażółćλόγος")
    wrapped = sinks.pdf_bytes("żółć " * 300, wrap=True, font=FONT)
    assert wrapped.count(b" Tj ") > 10
    (tmp_path / "x.ttf").write_bytes(b"none")
    with pytest.raises(ValueError, match="not a TrueType"):
        read_font(str(tmp_path / "x.ttf"))


def test_many_files_in_and_out(spark, tmp_path, capsys):
    (tmp_path / "in" / "sub").mkdir(parents=True)
    for name, text in (("a.txt", "a@b.com"), ("b.md", "x 10.0.1.2"), ("b.txt", "b"), ("sub/c.txt", "c c@d.org")):
        (tmp_path / "in" / name).write_text(text)
    assert cli.main(["-i", f"{tmp_path}/in/*.*", "-o", f"{tmp_path}/out"], spark) == 0
    assert {p.name: p.read_text() for p in (tmp_path / "out").iterdir()} == {"a.txt": "EMAIL-8674\n", "b.md.txt": "x PRIVATE_IP-1251\n", "b.txt.txt": "b\n"}
    assert cli.main(["-i", f"{tmp_path}/in/{{a.txt,sub/c.txt}}", "-o", f"file:{tmp_path}/two", "--output-format", "docx"], spark) == 0
    assert sorted(str(p.relative_to(tmp_path / "two")) for p in (tmp_path / "two").rglob("*.docx")) == ["a.docx", "sub/c.docx"]
    assert cli.main(["-i", f"{tmp_path}/in/a.txt", "-o", f"{tmp_path}/one.txt"], spark) == 0 and (tmp_path / "one.txt").read_text() == "EMAIL-8674\n"
    assert capsys.readouterr().out.split() == [f"{tmp_path}/out", f"file:{tmp_path}/two", f"{tmp_path}/one.txt"]


def test_added_entities_are_found(spark, tmp_path, capsys, monkeypatch, caplog):
    monkeypatch.setattr(catalogue, "GAZETTEERS", dict(catalogue.GAZETTEERS))
    assert cli.main(["add", str(tmp_path), "-n", "Ada Byron", "-c", "Zwolle"]) == 0
    for locale in catalogue.LOCALES:
        assert cli.main(["-t", "Ada Byron lives in Zwolle, zwolle", "-l", locale, "--entities", str(tmp_path)], spark) == 0
        told = capsys.readouterr().out
        assert told.startswith("NAME-") and "LOCATION-" in told and "Byron" not in told and told.rstrip().endswith("zwolle")
    assert "organizations.json" in caplog.text
    (tmp_path / "organizations.json").write_text("{broken")
    assert [g.loaded for g in catalogue.entity_lists(tmp_path, "en_US")] == [("Ada Byron",), (), ("Zwolle",)]
    assert [r.match for r in gazetteer.load(spark, f"{tmp_path}/names.json", ["the"]).collect()] == ["Ada Byron"]
    assert gazetteer.load(spark, f"{tmp_path}/none.json", []).count() == gazetteer.load(spark, f"{tmp_path}/organizations.json", []).count() == 0


def test_input_order(spark, tmp_path):
    with pytest.raises(ValueError):
        readers.resolve_input(spark, "x", append=True)
    out = tmp_path / "out.txt"
    assert readers.resolve_input(spark, "x", append=True, output_path=str(out)).first().text == "x"
    out.write_text("old")
    assert readers.resolve_input(spark, "x", append=True, output_path=str(out)).first().text == "old"
    (tmp_path / "in.txt").write_text("file")
    assert readers.resolve_input(spark, "x", str(tmp_path / "in.txt")).first().text == "file"


def test_entities(spark, tmp_path):
    have = spark.createDataFrame([("Amsterdam", "location")], "match string, filth_type string")
    new = spark.createDataFrame([("city", "amsterdam"), ("city", "Breda"), ("city", "breda")], "kind string, match string")
    assert [tuple(r) for r in entities.upsert(have, new).collect()] == [("Amsterdam", "location"), ("Breda", "location")]
    (tmp_path / "cities.json").write_text(json.dumps([{"match": "Breda", "filth_type": "location"}]))
    assert not entities.add_entity(tmp_path, "city", "breda") and entities.add_entity(tmp_path, "city", "Ámsterdam") and entities.add_entity(tmp_path, "city", "Assen")
    assert [r["match"] for r in json.loads((tmp_path / "cities.json").read_text())] == ["Assen", "Breda", "Ámsterdam"]
    assert not entities.add_entity(tmp_path, "planet", "Mars") and entities.load_json(tmp_path / "none.json") == []


def test_names_and_training_rows(spark, tmp_path):
    (tmp_path / "q.csv").write_text("M;2000;1; 'Jan'  ;5\nM;2000;1;jan;3\nV;2000;1;Amélie  de  Wit;2\nV;2000;1;;1\n", encoding="utf-8")
    names = entities.import_names(entities.read_names(spark, f"{tmp_path}/q.csv"))
    assert [r.match for r in names.collect()] == ["Amélie de Wit", "Jan"] or [r.match for r in names.collect()] == ["Amélie de Wit", "jan"]
    rows = spark.createDataFrame([("Ann", "name"), ("NL", "location"), ("x", "planet"), ("ACME", "organisation")], "match string, filth_type string")
    got = [(r.text, r.entities[0].end, r.entities[0].label) for r in entities.ner_rows(rows).orderBy("text").collect()]
    assert got == [("ACME", 4, "ORG"), ("Ann", 3, "PERSON"), ("NL", 2, "LOC")]
    a, b = entities.split_ner_rows(entities.ner_rows(rows))
    assert a.count() + b.count() == 3


def test_command_line(spark, tmp_path, capsys):
    assert cli.main(["-ld"]) == 0 and "private_ip" in capsys.readouterr().out
    assert cli.main(["-t", "see https://example.com", "-d", "url", "-v"], spark) == 0
    told = capsys.readouterr()
    assert told.out == "see URL-1048\n\n" and "-> 'URL-1048'" in told.err
    out = str(tmp_path / "sub" / "x.docx")
    assert cli.main(["-t", "Foo a@b.com", "-c", "Foo", "-o", out], spark) == 0
    assert readers.docx_text(open(out, "rb").read()) == "CUSTOM-8533 EMAIL-8674"
    assert cli.main(["-t", "x", "-a"], spark) == 1
    assert cli.preview("file", "en_US", ["en:name", "url"], False, True, "pdf", "para", 12, "markitdown") == 'veil -i <input-file> -l en_US -d "name url" --no-cleanup -v --output-format pdf --pdf-mode para --font-size 12 --pdf-backend markitdown'
