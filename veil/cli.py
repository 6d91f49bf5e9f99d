"""Command line: scrub a text or files, list detectors, add entities.

    python -m veil.cli -t "mail me at a@b.com" -l en_US -v
    python -m veil.cli -i "in/*.docx" -o out --output-format md
    python -m veil.cli add entities/ -n "Ada"
    python -m veil.cli -t "Ada called" -l en_US --entities entities/
"""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession

from veil import entities
from veil.plans import catalogue, scrub
from veil.sources import readers, sinks


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="veil", description="Finds and replaces personal data in texts.")
    p.add_argument("-t", "--text")
    p.add_argument("-i", "--input")
    p.add_argument("-o", "--output")
    p.add_argument("--output-format", choices=sinks.FORMATS)
    p.add_argument("--pdf-mode", choices=("pre", "para"), default="pre")
    p.add_argument("--font-size", type=int, default=11)
    p.add_argument("--pdf-font", help="a TrueType font, for characters that Helvetica lacks")
    p.add_argument("--entities", help="a folder of entity lists, as `add` edits them, in place of the built-in ones")
    p.add_argument("--pdf-backend", choices=(*readers.PDF_BACKENDS, "all"), default="pymupdf4llm")
    p.add_argument("-a", "--append", action="store_true")
    p.add_argument("-l", "--locale", choices=catalogue.LOCALES)
    p.add_argument("-d", "--detectors", help="names, apart by blanks")
    p.add_argument("-c", "--custom")
    p.add_argument("--no-cleanup", dest="cleanup", action="store_false")
    p.add_argument("-v", "--verbose", action="store_true")
    p.add_argument("-ld", "--list-detectors", action="store_true")
    return p


def add_parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="veil add")
    p.add_argument("folder")
    for short, kind in zip("cnoa", entities.KINDS, strict=True):
        p.add_argument(f"-{short}", f"--{kind}")
    return p


def preview(source: str = "text", locale: str | None = None, detectors: list[str] | None = None, cleanup: bool = True, verbose: bool = False, output_format: str = "txt", pdf_mode: str = "pre", font_size: int = 11, pdf_backend: str | None = None) -> str:
    """The command that a form's choices amount to."""
    names = " ".join(sorted(catalogue.plain_tokens(detectors)))
    parts = ["veil", "-i <input-file>" if source == "file" else "-t <text>"]
    parts += [f"-l {locale}"] * bool(locale) + [f'-d "{names}"'] * bool(names) + ["--no-cleanup"] * (not cleanup) + ["-v"] * verbose
    parts += [f"--output-format {output_format}"] * (output_format not in ("", "txt"))
    parts += [f"--pdf-mode {pdf_mode} --font-size {font_size}"] * (output_format == "pdf")
    return " ".join(parts + [f"--pdf-backend {pdf_backend}"] * bool(source == "file" and pdf_backend))


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    argv = sys.argv[1:] if argv is None else argv
    if argv[:1] == ["add"]:
        p = add_parser()
        told = p.parse_args(argv[1:])
        wanted = [(kind, value) for kind in entities.KINDS if (value := getattr(told, kind))]
        if not wanted:
            p.print_help()
            return 0
        return int(not all([entities.add_entity(told.folder, kind, value) for kind, value in wanted]))
    o = parser().parse_args(argv)
    if o.list_detectors:
        print(catalogue.listing())
        return 0
    spark = spark or SparkSession.builder.appName("veil").getOrCreate()
    wanted = o.detectors.split() if o.detectors else None
    if o.entities:
        catalogue.use_entities(o.entities)
    try:
        given = readers.resolve_input(spark, o.text, o.input, o.append, o.output, o.pdf_backend)
        done = scrub.scrub_default(given, o.locale, wanted, o.custom, o.cleanup)
        if o.verbose:
            for row in scrub.report(scrub.findings(given, o.locale, wanted, o.custom, id_col="path")).collect():
                print(f"{row['locale']} {row['line']}", file=sys.stderr)
        if o.text is not None and not o.output and not o.output_format:
            print(done.first()["text"])
        else:
            print(sinks.write_output(done, o.output, o.output_format, o.pdf_mode, o.font_size, o.pdf_font))
    except (ValueError, readers.ConversionError) as error:
        print(error, file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
