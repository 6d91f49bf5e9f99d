"""Files as rows of text: plain text, DOCX, RTF, PDF and images, each by its suffix."""

from __future__ import annotations

import importlib.util
import io
import logging
import re
import shutil
import subprocess
import sys
import tempfile
import zipfile
from collections.abc import Iterator
from pathlib import Path
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veil.functions.normalize import normalize_pdf_text

WORD, RTF, PDF = (".doc", ".docx"), (".rtf",), (".pdf",)
IMAGE = (".png", ".jpg", ".jpeg", ".tif", ".tiff", ".bmp", ".webp")
_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


class ConversionError(Exception):
    """A file that cannot be turned into text here, with the reason."""


def _tool(command: list[str], content: bytes, suffix: str) -> str:
    """What a command prints for a file with this content; `{}` stands for its path."""
    if shutil.which(command[0]) is None:
        raise ConversionError(f"{command[0]} is not installed")
    with tempfile.NamedTemporaryFile(suffix=suffix) as f:
        f.write(content)
        f.flush()
        done = subprocess.run([f.name if x == "{}" else x for x in command], capture_output=True, check=False)
    if done.returncode:
        raise ConversionError(done.stderr.decode("utf-8", "replace").strip() or f"{command[0]} failed")
    return done.stdout.decode("utf-8", "replace")


def docx_text(content: bytes) -> str:
    """The paragraphs that are not empty, one a line; tabs and breaks as they are."""
    try:
        with zipfile.ZipFile(io.BytesIO(content)) as z:
            body = ElementTree.fromstring(z.read("word/document.xml")).find(f"{_W}body")
    except (zipfile.BadZipFile, KeyError, ElementTree.ParseError):
        for command in (["docx2txt", "{}", "-"], ["pandoc", "{}", "-t", "plain"]):
            if shutil.which(command[0]):
                return _tool(command, content, ".docx")
        raise ConversionError("not a DOCX file, and neither docx2txt nor pandoc is installed") from None
    signs = {f"{_W}tab": "\t", f"{_W}br": "\n", f"{_W}cr": "\n"}
    lines = ("".join(x.text or "" if x.tag == f"{_W}t" else signs.get(x.tag, "") for x in p.iter()) for p in (body if body is not None else []) if p.tag == f"{_W}p")
    return "\n".join(line for line in lines if line)


#: Destinations of an RTF file that hold no text of the document.
_SKIP = {"fonttbl", "colortbl", "stylesheet", "info", "pict", "header", "footer", "generator", "listtable", "listoverridetable", "themedata", "datastore"}
_SIGNS = {"par": "\n", "line": "\n", "row": "\n", "tab": "\t", "cell": "|", "emdash": "—", "endash": "–", "lquote": "‘", "rquote": "’", "ldblquote": "“", "rdblquote": "”", "bullet": "•"}
_RTF = re.compile(r"\\([a-z]{1,32})(-?\d{1,10})? ?|\\'([0-9a-f]{2})|\\([^a-z])|([{}])|[\r\n]+|(.)", re.IGNORECASE | re.DOTALL)


def rtf_text(content: bytes) -> str:
    """The text of an RTF file, without fonts, styles and pictures."""
    if not content.lstrip().startswith(b"{\\rtf"):
        if shutil.which("pandoc"):
            return _tool(["pandoc", "{}", "-t", "plain"], content, ".rtf")
        raise ConversionError("not an RTF file, and pandoc is not installed")
    out: list[str] = []
    stack: list[tuple[bool, int]] = []
    hidden, width, skip = False, 1, 0
    for word, number, code, sign, brace, char in (m.groups() for m in _RTF.finditer(content.decode("latin-1"))):
        if brace == "{":
            stack.append((hidden, width))
        elif brace == "}":
            hidden, width = stack.pop() if stack else (False, 1)
        elif sign == "*" or word in _SKIP:
            hidden = True
        elif word == "uc":
            width = int(number or 1)
        elif word == "u" and number:
            if not hidden:
                out.append(chr(int(number) % 65536))
            skip = width
        elif hidden:
            continue
        elif word in _SIGNS:
            out.append(_SIGNS[word])
        elif skip and (code or char):
            skip -= 1
        elif code:
            out.append(bytes.fromhex(code).decode("cp1252", "replace"))
        elif sign:
            out.append({"~": "\u00a0", "_": "\u2011", "-": ""}.get(sign, sign))
        elif char:
            out.append(char)
    return "".join(out)


#: What reads PDFs, in the order in which it is tried after the backend asked for.
PDF_BACKENDS = ("pymupdf4llm", "markitdown", "pdftotext", "pdfminer")


def _pdf_by(name: str, content: bytes) -> str:
    if name == "pdftotext":
        return _tool(["pdftotext", "-layout", "-enc", "UTF-8", "{}", "-"], content, ".pdf")
    if name == "pdfminer":
        from pdfminer.high_level import extract_text
        from pdfminer.layout import LAParams

        return extract_text(io.BytesIO(content), laparams=LAParams(line_margin=0.3, char_margin=2.0, word_margin=0.1, boxes_flow=None))
    with tempfile.NamedTemporaryFile(suffix=".pdf") as f:
        f.write(content)
        f.flush()
        module = importlib.import_module(name)
        return module.to_markdown(f.name) if name == "pymupdf4llm" else module.MarkItDown().convert(f.name).text_content or ""


def _there(name: str) -> bool:
    return bool(shutil.which(name)) if name == "pdftotext" else importlib.util.find_spec(name) is not None


def pdf_text(content: bytes, backend: str = "pymupdf4llm") -> str:
    """A PDF's text by the backend asked for, or else by whichever tool is installed.

    The backend `all` gives the texts of all Markdown tools there are, one after the other under their names.
    """
    if backend == "all":
        found = [(name, _pdf_by(name, content)) for name in PDF_BACKENDS[:2] if _there(name)]
        if found:
            return "\n\n".join(f"# {name}\n\n{text}" for name, text in found)
    logging.getLogger("pdfminer").setLevel(logging.ERROR)  # it warns of every font without a box
    for name in dict.fromkeys([backend if backend in PDF_BACKENDS else "markitdown", *PDF_BACKENDS[1:]]):
        if _there(name):
            return _pdf_by(name, content)
    raise ConversionError(f"no tool for PDF files is installed ({', '.join(PDF_BACKENDS)})")


def image_text(content: bytes, suffix: str = ".png", lang: str | None = None) -> str:
    return _tool(["tesseract", "{}", "stdout", *(["-l", lang] if lang else [])], content, suffix)


def convert(fmt: str, content: bytes, lang: str | None = None) -> str:
    """Text of a file of the format pdf, doc, docx, rtf or image."""
    fmt = fmt.lower()
    if fmt == "pdf":
        return pdf_text(content)
    if fmt in ("doc", "docx"):
        return docx_text(content)
    if fmt == "rtf":
        return rtf_text(content)
    if fmt == "image":
        return image_text(content, lang=lang)
    raise ConversionError(f"no conversion for the format {fmt}")


def suffix(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, "(\\.[^./]*)$", 1))


def texts_of_files(files: DataFrame, pdf_backend: str = "pymupdf4llm", strict: bool = True) -> DataFrame:
    """(path, text, error) of (path, content) rows: plain text in the JVM, other formats by suffix in Arrow batches.

    What is no valid UTF-8 in plain text becomes the replacement character.  A file that cannot be converted fails the job if strict, and
    else has its reason in error.
    """

    @F.pandas_udf("struct<text:string,error:string>")
    def rich(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        def one(kind: str, content: bytes) -> tuple[str | None, str | None]:
            try:
                if kind in IMAGE:
                    return image_text(content, kind), None
                return (pdf_text(content, pdf_backend) if kind in PDF else convert(kind[1:], content)), None
            except ConversionError as error:
                if strict:
                    raise
                return None, str(error)

        for kinds, contents in batches:
            yield pd.DataFrame([one(k, c) for k, c in zip(kinds, contents, strict=True)], columns=["text", "error"])

    kind = suffix(F.col("path"))
    plain = F.make_valid_utf8(F.col("content").cast("string"))
    known = kind.isin(*WORD, *RTF, *PDF, *IMAGE)
    simple = files.where(~known).select("path", plain.alias("text"), F.lit(None).cast("string").alias("error"))
    other = files.where(known).select("path", kind.alias("_kind"), rich(kind, F.col("content")).alias("r"))
    text = F.when(F.col("_kind").isin(*PDF), normalize_pdf_text(F.col("r.text"))).otherwise(F.col("r.text"))
    return simple.unionByName(other.select("path", text.alias("text"), F.col("r.error").alias("error")))


def _empty_files(spark: SparkSession, path: str) -> list[str]:
    """Files without a byte under a path or glob, which Spark's file sources pass over."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    found = [x for s in fs.globStatus(at) or [] for x in (fs.listStatus(s.getPath()) if s.isDirectory() else [s])]
    return [str(x.getPath().toString()) for x in found if x.isFile() and not x.getLen() and x.getPath().getName()[0] not in "._"]


def read_files(spark: SparkSession, path: str, pdf_backend: str = "pymupdf4llm", strict: bool = True) -> DataFrame:
    """(path, text, error) of all files under a path or glob; an empty file of plain text has an empty text."""
    files = texts_of_files(spark.read.format("binaryFile").load(path).select("path", "content"), pdf_backend, strict)
    plain = [(p, "", None) for p in _empty_files(spark, path) if not p.lower().endswith((*WORD, *RTF, *PDF, *IMAGE))]
    return files.unionByName(spark.createDataFrame(plain, files.schema)) if plain else files


def resolve_input(spark: SparkSession, text: str | None = None, input_path: str | None = None, append: bool = False, output_path: str | None = None, pdf_backend: str = "pymupdf4llm") -> DataFrame:
    """(path, text) of a run's input: the output to append to if it exists, else the input file, the inline text or stdin."""
    if append and not output_path:
        raise ValueError("appending needs an output path")
    if append and Path(output_path).exists():
        content = Path(output_path).read_text(encoding="utf-8", errors="replace")
        return spark.createDataFrame([(output_path, content)], "path string, text string")
    if input_path:
        return read_files(spark, input_path, pdf_backend).select("path", "text")
    if text is None:
        if sys.stdin is None or sys.stdin.isatty():
            raise ValueError("no input: give a text, a file or standard input")
        text = sys.stdin.read()
    return spark.createDataFrame([(None, text)], "path string, text string")
