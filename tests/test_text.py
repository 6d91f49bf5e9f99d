"""Clean-up and normalisation."""

import random
import re

import pytest
from pyspark.sql import functions as F

from veil.functions import normalize as N
from veil.functions import text as T
from veil.operators import cleanup as C


def test_python_string_methods(column):
    rng = random.Random(2)
    texts = ["".join(rng.choices("ab \n\r\t\x0b\x0c\x1c\x1d\x1e\x85  \xa0", k=rng.randint(0, 12))) for _ in range(1500)]
    assert column(texts, T.splitlines) == [t.splitlines() for t in texts]
    assert column(texts, T.strip) == [t.strip() for t in texts]
    assert column(texts, T.rstrip) == [t.rstrip() for t in texts]
    assert column(texts, T.lstrip) == [t.lstrip() for t in texts]


@pytest.mark.parametrize(
    ("given", "want"),
    [
        ("Hello <UNKNOWN-123> world", "Hello world"),
        ("[link](UNKNOWN-456)", "link"),
        ("Text UNKNOWN-789 more", "Text more"),
        ("Email EMAIL-123 and URL-456", "Email EMAIL-123 and URL-456"),
        ("  a\t\tb", " a b"),
    ],
)
def test_remove_unknown(column, given, want):
    assert column([given], C.remove_unknown) == [want]


def test_lines(column):
    assert column(["Line 1\nLine 2\nLine 2\nLine 3", "a\nb\na", "x\nx\nx\n", "a\r\na"], C.dedupe_lines) == ["Line 1\nLine 2\nLine 3", "a\nb\na", "x", "a"]
    assert column(["Hello world", "Hello world\n\n\n"], C.trailing_newline) == ["Hello world\n", "Hello world\n\n\n"]
    assert column(["", None], C.cleanup) == ["", None]


def test_gibberish(column):
    long, edge = "A" * 81, "A" * 80
    short = "A" * 16 + "…" + "A" * 8
    texts = [f"[{edge}]", f"[{long}]", f"({long})", long, f"[x {long} y {long}]({long}) {long}", f"[a ({long})]"]
    assert column(texts, C.collapse_gibberish) == [f"[{edge}]", f"[{short}]", f"({short})", long, f"[x {short} y {short}]({short}) {long}", f"[a ({short})]"]


def test_normalize(column):
    assert column(["Line 1  \n\x0cLine 2    \nLine 3\n"], N.normalize_pdf_text) == ["Line 1\n\nLine 2\nLine 3"]
    assert column(["body", "# Existing\nBody", "\n \n# X"], lambda c: N.insert_h1(c, "Results (en_US)")) == ["# Results (en_US)\n\nbody", "# Existing\nBody", "\n \n# X"]
    assert column(["See https://example.com/path?x=1 and http://sub.domain.tld."], N.wrap_urls) == ["See <https://example.com/path?x=1> and <http://sub.domain.tld.>"]
    assert column(["Visit https://example.\ncom/docs?id=1"], N.normalize_pdf_text) == ["Visit <https://example.com/docs?id=1>"]
    assert column(["Paragraph\n- item 1\n- item 2\n3. x\ny\n4. z"], N.blank_before_lists) == ["Paragraph\n\n- item 1\n- item 2\n3. x\ny\n\n4. z"]


def test_split_urls_to_a_fixpoint(column):
    rng = random.Random(4)
    texts = ["".join(rng.choices(["http://", "https://", "a", "b", "\n", " ", "\n\n", "/"], k=rng.randint(0, 12))) for _ in range(1500)]

    def loop(t):
        while (new := re.sub(r"(https?://\S*?)\n(\S)", r"\1\2", t)) != t:
            t = new
        return t

    assert column(texts, N.join_split_urls) == [loop(t) for t in texts]


def test_pdf_text(column):
    assert column(["Hel-\nlo world \nNext line"], N.text_for_pdf) == ["Hello world \nNext line"]
    assert column(["Intro line.\ncontinues on next line\n\nAnother Para:\nmore text\n"], lambda c: N.text_for_pdf(c, "para")) == ["Intro line. continues on next line\n\nAnother Para: more text"]
    assert column(["co­op and non‑breaking"], N.text_for_pdf) == ["coop and non-breaking"]
    assert column(["a-\nB", "a-\nb-\nc", "a-"], N.text_for_pdf) == ["a-\nB", "ab-\nc", "a-"]


def test_null_texts(column):
    for build in (C.cleanup, N.normalize_pdf_text, N.text_for_pdf, T.splitlines, lambda c: N.insert_h1(c, F.lit("t"))):
        assert column([None], build) == [None]
