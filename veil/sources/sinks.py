"""Texts as files: plain text, Markdown, DOCX and PDF, one file a row, through a Python data source."""

from __future__ import annotations

import io
import os
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass
from pathlib import Path
from urllib.parse import unquote, urlparse
from xml.sax.saxutils import escape

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

from veil.functions.normalize import text_for_pdf
from veil.sources.truetype import Font, read_font

FORMATS = ("txt", "md", "markdown", "docx", "pdf")
#: An A4 page and its margins of 2 cm, in points.
PAGE_WIDTH, PAGE_HEIGHT, MARGIN = 595.28, 841.89, 56.69


def infer_format(output: str | None, explicit: str | None = None) -> str:
    """The format asked for, or the one of the path's suffix: docx, pdf, md, else txt."""
    if explicit:
        return explicit
    end = Path(output).suffix.lower() if output else ""
    return {".doc": "docx", ".docx": "docx", ".pdf": "pdf", ".md": "md", ".markdown": "md"}.get(end, "txt")


def docx_bytes(text: str) -> bytes:
    """A DOCX file with one paragraph for each line."""
    paragraph = lambda line: f'<w:p><w:r><w:t xml:space="preserve">{escape(_printable(line))}</w:t></w:r></w:p>'
    space = "http://schemas.openxmlformats.org/"
    parts = {
        "[Content_Types].xml": f'<Types xmlns="{space}package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/>'
        '<Override PartName="/word/document.xml" ContentType="application/vnd.openxmlformats-officedocument.wordprocessingml.document.main+xml"/></Types>',
        "_rels/.rels": f'<Relationships xmlns="{space}package/2006/relationships"><Relationship Id="r1" Type="{space}officeDocument/2006/relationships/officeDocument" Target="word/document.xml"/></Relationships>',
        "word/document.xml": f'<w:document xmlns:w="{space}wordprocessingml/2006/main"><w:body>{"".join(map(paragraph, text.splitlines()))}</w:body></w:document>',
    }
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, xml in parts.items():
            z.writestr(zipfile.ZipInfo(name), f'<?xml version="1.0" encoding="UTF-8" standalone="yes"?>{xml}')
    return out.getvalue()


def _printable(line: str) -> str:
    return "".join(c for c in line if c >= " " or c == "\t")


def _lines(text: str, font_size: int, wrap: bool, wide) -> list[tuple[str, float]]:
    """The lines of a PDF and how far down the next one stands; wide(text) is a text's width in thousandths of the size."""
    leading, room = int(font_size * 1.2), (PAGE_WIDTH - 2 * MARGIN) * 1000 / font_size
    if not wrap:
        return [(line, leading) for line in text.split("\n")]
    lines: list[tuple[str, float]] = []
    for block in text.split("\n\n"):
        row, held = "", 0.0
        for word in block.split():
            more = wide(f" {word}" if row else word)
            if row and held + more > room:
                lines.append((row, leading))
                row, held = word, wide(word)
            else:
                row, held = f"{row} {word}" if row else word, held + more
        lines.append((row, leading + 11.34))
    return lines


def pdf_bytes(text: str, font_size: int = 11, wrap: bool = False, font: str | None = None) -> bytes:
    """A PDF of A4 pages; with wrap, lines are broken at blanks to fit, with a space of 0.4 cm after each paragraph.

    font is the path of a TrueType font, which goes into the file; without one text is in Helvetica, and characters that Windows-1252 lacks raise a ValueError.
    """
    own = read_font(font) if font else None
    clean = "\n".join(_printable(line).expandtabs(4) for line in text.split("\n"))
    if own is None and (lacking := sorted({c for c in clean if not _western(c)})):
        raise ValueError(f"Helvetica lacks {' '.join(lacking[:5])!r}: give a font that has them")
    wide = (lambda x: sum(own.width(own.glyph(c)) for c in x)) if own else (lambda x: 500 * len(x))
    leading = int(font_size * 1.2)
    pages: list[list[str]] = [[]]
    left = PAGE_HEIGHT - 2 * MARGIN
    for line, step in _lines(clean, font_size, wrap, wide):
        if left < leading and pages[-1]:
            pages.append([])
            left = PAGE_HEIGHT - 2 * MARGIN
        shown = "<" + "".join(f"{own.glyph(c):04X}" for c in line) + ">" if own else "(" + "".join("\\" + c if c in "()\\" else c for c in line) + ")"
        pages[-1].append(f"{shown} Tj 0 -{step:g} Td")
        left -= step
    objects: list[bytes] = [b"<< /Type /Catalog /Pages 2 0 R >>", b"", *(_embedded(own, clean) if own else [b"<< /Type /Font /Subtype /Type1 /BaseFont /Helvetica /Encoding /WinAnsiEncoding >>"])]
    kids = []
    for page in pages:
        n = len(objects) + 1
        kids.append(f"{n} 0 R")
        body = (f"BT /F1 {font_size} Tf {MARGIN:g} {PAGE_HEIGHT - MARGIN - font_size:g} Td\n" + "\n".join(page) + "\nET").encode("cp1252")
        objects.append(f"<< /Type /Page /Parent 2 0 R /MediaBox [0 0 {PAGE_WIDTH} {PAGE_HEIGHT}] /Resources << /Font << /F1 3 0 R >> >> /Contents {n + 1} 0 R >>".encode())
        objects.append(_stream(body))
    objects[1] = f"<< /Type /Pages /Kids [{' '.join(kids)}] /Count {len(kids)} >>".encode()
    out, places = bytearray(b"%PDF-1.4\n"), []
    for i, x in enumerate(objects, 1):
        places.append(len(out))
        out += b"%d 0 obj\n%s\nendobj\n" % (i, x)
    table = "".join(f"{p:010d} 00000 n \n" for p in places)
    out += f"xref\n0 {len(objects) + 1}\n0000000000 65535 f \n{table}trailer << /Size {len(objects) + 1} /Root 1 0 R >>\nstartxref\n{len(out)}\n%%EOF\n".encode()
    return bytes(out)


def _western(char: str) -> bool:
    try:
        return bool(char.encode("cp1252"))
    except UnicodeEncodeError:
        return False


def _stream(body: bytes, more: str = "") -> bytes:
    return b"<< /Length %d%s >>\nstream\n%s\nendstream" % (len(body), more.encode(), body)


def _embedded(font: Font, text: str) -> list[bytes]:
    """Objects 3 to 7: the font, its glyphs' widths, its measures, the font file, and the characters of its glyphs."""
    used = {font.glyph(c): c for c in sorted(set(text) - {"\n"})}
    widths = " ".join(f"{g} [{font.width(g)}]" for g in sorted(used))
    names = "\n".join(f"<{g:04X}> <{c.encode('utf-16-be').hex().upper()}>" for g, c in sorted(used.items()))
    known = f"/CIDInit /ProcSet findresource begin 12 dict begin begincmap /CMapName /Own def /CMapType 2 def\n1 begincodespacerange <0000> <FFFF> endcodespacerange\n{len(used)} beginbfchar\n{names}\nendbfchar\nendcmap end end"
    box = " ".join(str(font.scaled(v)) for v in font.box)
    return [
        b"<< /Type /Font /Subtype /Type0 /BaseFont /Embedded /Encoding /Identity-H /DescendantFonts [4 0 R] /ToUnicode 7 0 R >>",
        f"<< /Type /Font /Subtype /CIDFontType2 /BaseFont /Embedded /CIDSystemInfo << /Registry (Adobe) /Ordering (Identity) /Supplement 0 >> /FontDescriptor 5 0 R /CIDToGIDMap /Identity /W [{widths}] >>".encode(),
        f"<< /Type /FontDescriptor /FontName /Embedded /Flags 4 /FontBBox [{box}] /ItalicAngle 0 /Ascent {font.scaled(font.ascent)} /Descent {font.scaled(font.descent)} /CapHeight {font.scaled(font.ascent)} /StemV 80 /FontFile2 6 0 R >>".encode(),
        _stream(font.data, f" /Length1 {len(font.data)}"),
        _stream(known.encode()),
    ]


def encode(text: str, fmt: str, font_size: int = 11, wrap: bool = False, font: str | None = None) -> bytes:
    fmt = fmt.lower()
    if fmt not in FORMATS:
        raise ValueError(f"unsupported output format {fmt!r}")
    if fmt == "docx":
        return docx_bytes(text)
    return pdf_bytes(text, font_size, wrap, font) if fmt == "pdf" else text.encode("utf-8", "surrogatepass")


def qualified(spark: SparkSession, path: str) -> str:
    """The path with its scheme, as Spark itself would take it: a plain one is in the cluster's default file system."""
    at = spark._jvm.org.apache.hadoop.fs.Path(str(path))
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(at).toString()


def _store(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system of a URI and the path in it, on whatever machine this runs."""
    if uri.startswith("file:"):
        return fs.LocalFileSystem(), unquote(urlparse(uri).path)
    return fs.FileSystem.from_uri(uri)


def _put(store: fs.FileSystem, path: str, content: bytes) -> None:
    store.create_dir(path.rpartition("/")[0], recursive=True)
    with store.open_output_stream(path) as out:
        out.write(content)


@dataclass
class Written(WriterCommitMessage):
    files: list[tuple[str, str]]


class DocumentWriter(DataSourceWriter):
    """Writes to hidden names in the folder's own file system and renames on commit, so a repeated or failed task leaves nothing half done."""

    def __init__(self, options: dict, overwrite: bool) -> None:
        self.folder, self.fmt, self.font = options["path"].rstrip("/"), options.get("fmt", "txt"), options.get("font") or None
        self.font_size, self.wrap = int(options.get("font_size", 11)), options.get("pdf_mode", "pre") == "para"
        encode("", self.fmt)

    def write(self, rows: Iterator) -> Written:
        import uuid

        store, base = _store(self.folder)
        done = []
        for row in rows:
            folder, _, name = f"{base}/{row['name'].lstrip('/')}".rpartition("/")
            held, target = f"{folder}/.{name}.{uuid.uuid4().hex}", f"{folder}/{name}"
            _put(store, held, encode(row["text"] or "", self.fmt, self.font_size, self.wrap, self.font))
            done.append((held, target))
        return Written(done)

    def commit(self, messages: list[Written | None]) -> None:
        store, _ = _store(self.folder)
        for m in messages:
            for held, target in m.files if m else ():
                store.move(held, target)

    def abort(self, messages: list[Written | None]) -> None:
        store, _ = _store(self.folder)
        for m in messages:
            for held, _ in m.files if m else ():
                if store.get_file_info(held).type != fs.FileType.NotFound:
                    store.delete_file(held)


class DocumentSink(DataSource):
    """format("veil_documents"): (name, text) rows as files of option fmt under the path, a URI that all executors reach."""

    @classmethod
    def name(cls) -> str:
        return "veil_documents"

    def schema(self) -> str:
        return "name string, text string"

    def writer(self, schema, overwrite: bool) -> DocumentWriter:
        return DocumentWriter(dict(self.options), overwrite)


def write_documents(df: DataFrame, folder: str, fmt: str = "txt", pdf_mode: str = "pre", font_size: int = 11, font: str | None = None) -> None:
    """One file for each (name, text) row; names get the format's suffix if they have none.  Executors write, into the file system that the folder is in."""
    fmt = fmt.lower()
    encode("", fmt)
    spark = df.sparkSession
    spark.dataSource.register(DocumentSink)
    end = ".md" if fmt == "markdown" else f".{fmt}"
    text = text_for_pdf(F.col("text"), pdf_mode) if fmt == "pdf" else F.col("text")
    named = df.select(F.when(F.col("name").rlike("\\.[A-Za-z]+$"), F.col("name")).otherwise(F.concat("name", F.lit(end))).alias("name"), text.alias("text"))
    to = named.write.format("veil_documents").mode("append").option("fmt", fmt).option("pdf_mode", pdf_mode).option("font_size", str(font_size))
    (to.option("font", font) if font else to).save(qualified(spark, folder))


def write_output(df: DataFrame, output: str | None, fmt: str | None = None, pdf_mode: str = "pre", font_size: int = 11, font: str | None = None) -> str:
    """Writes the (path, text) rows of a run and returns where: one text to a file, ./output/scrubbed.txt by default, several to a folder.

    Of several, each keeps its place under the folder that all inputs share, with the format's suffix in place of its own; ./output is the default.
    No text at all gives an empty file.
    """
    spark = df.sparkSession
    several = df.select(F.lit(1)).limit(2).count() > 1
    if several:
        low, high = df.agg(F.min("path"), F.max("path")).first()
        shared = os.path.commonprefix([low, high])
        head = shared.rpartition("/")[0] + "/" if "/" in shared else ""
        folder = str(output) if output else str(Path.cwd() / "output")
        fmt = infer_format(None, fmt)
        end = ".md" if fmt == "markdown" else f".{fmt}"
        name = F.substring("path", F.lit(len(head) + 1), F.length("path"))
        twins = F.count("*").over(Window.partitionBy(F.regexp_replace(name, "\\.[^./]*$", ""))) > 1  # a.docx beside a.rtf keep their own suffixes too
        named = df.select(F.concat(F.when(twins, name).otherwise(F.regexp_replace(name, "\\.[^./]*$", "")), F.lit(end)).alias("name"), "text")
        write_documents(named, folder, fmt, pdf_mode, font_size, font)
        return folder
    target = qualified(spark, output) if output else f"file:{Path.cwd()}/output/scrubbed.txt"
    fmt = infer_format(output, fmt)
    text = F.col("text") if fmt != "pdf" else text_for_pdf(F.col("text"), pdf_mode)
    row = df.select(text.alias("t")).first()
    store, path = _store(target)
    _put(store, path, encode((row and row["t"]) or "", fmt, font_size, pdf_mode == "para", font))
    return path
