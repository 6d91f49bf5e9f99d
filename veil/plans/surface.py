"""More registered queries: whole tables through every default detector, text derived from whole tables, and the surfaces around the engine."""

from __future__ import annotations

import io
import sys
import tempfile
import uuid
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veil import cli, entities, sql
from veil.functions import normalize as N
from veil.operators import cleanup, gazetteer
from veil.operators import detectors as D
from veil.operators.spans import explode_spans, matches, span
from veil.plans import catalogue, scrub
from veil.plans.queries import NUMBER, PHONE, QUAD, _documents, _expect, _literal, query, spans_sql, table
from veil.sources import readers, sinks
from veil.streaming import scrubbing

#: An e-mail address as these tables have them, written apart from the engine's own pattern.
ADDRESS = r"[A-Za-z0-9]+(?:[._-][A-Za-z0-9]+)*@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}"
ZERO = chr(0x200B)


def _scratch(spark: SparkSession, name: str) -> str:
    """A new folder where the cluster shares one, else on this machine."""
    base = spark.conf.get("spark.checkpoint.dir", None) or tempfile.mkdtemp(prefix="veil-")
    return f"{base}/{name}-{uuid.uuid4().hex}"


def _derived(spark: SparkSession, sf_dir: str, head: str = "''", tail: str = "''") -> DataFrame:
    """documents with something before and after the whole text, as SQL that both engines take."""
    return _documents(spark, sf_dir).select("doc_id", F.expr(f"concat({head}, text, {tail})").alias("text"))


# -- the whole engine over whole tables -----------------------------------------------------------

ANY = f"(?:{ADDRESS}|{PHONE}|{QUAD})"


def kind_sql(x: str) -> str:
    private = f"regexp_matches({x}, '^(192\\.168|10\\.0|172\\.(1[6-9]|2[0-9]|3[0-1]))\\.')"
    return f"CASE WHEN contains({x}, '@') THEN 'email' WHEN NOT regexp_full_match({x}, '[0-9.]+') OR length({x}) - length(replace({x}, '.', '')) <> 3 THEN 'phone' WHEN regexp_matches({x}, '^172\\.') AND NOT {private} THEN 'unknown' WHEN {private} THEN 'private_ip' ELSE 'public_ip' END"


def scrubbed_sql(key: str, text: str, source: str) -> str:
    p = _literal(ANY)
    one = f"upper({kind_sql('x')}) || '-' || lpad((('0x' || md5({kind_sql('x')} || ':' || x))::UHUGEINT % 10000)::VARCHAR, 4, '0')"
    return (
        f"SELECT {key}, list_aggregate(list_transform(range(1, len(p) + 1), lambda k: p[k] || coalesce(r[k], '')), 'string_agg', '') AS text FROM"
        f" (SELECT {key}, string_split_regex({text}, {p}) AS p, list_transform(regexp_extract_all({text}, {p}), lambda x: {one}) AS r FROM {source})"
    )


def cleaned_sql(key: str, source: str) -> str:
    """Clean-up of (key, text) without gibberish in brackets: placeholders, blanks, adjacent lines, last line end."""
    return f"""
SELECT {key}, CASE WHEN text = '' THEN '' ELSE t || CASE WHEN suffix(t, chr(10)) THEN '' ELSE chr(10) END END AS text FROM
 (SELECT {key}, text, coalesce(list_aggregate(list_filter(l, lambda x, i: i = 1 OR x <> l[i - 1]), 'string_agg', chr(10)), '') AS t FROM
  (SELECT {key}, text, CASE WHEN l[-1] = '' THEN l[:-2] ELSE l END AS l FROM
   (SELECT {key}, text, string_split_regex(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '<UNKNOWN-[^>]*>', '', 'g'), '\\[([^\\]]+)\\]\\(UNKNOWN-\\d+\\)', '\\1', 'g'), '\\bUNKNOWN-\\d+\\b', '', 'g'), '[ \\t]{{2,}}', ' ', 'g'), '\\r\\n|[\\n\\r\\x0b\\x0c\\x1c-\\x1e]') AS l FROM ({source}))))"""


SCRUBBED = cleaned_sql("doc_id", scrubbed_sql("doc_id", "text", "documents"))


@query(SCRUBBED)
def scrub_en_us(spark, sf_dir):
    return scrub.scrub(_documents(spark, sf_dir), "en_US").select("doc_id", "text")


@query(SCRUBBED)
def scrub_nl_nl(spark, sf_dir):
    return scrub.scrub(_documents(spark, sf_dir), "nl_NL").select("doc_id", "text")


@query(f"SELECT doc_id, x AS locale, text, '' AS error FROM ({SCRUBBED}) CROSS JOIN (VALUES ('en_US'), ('nl_NL')) v(x)")
def scrub_both_locales(spark, sf_dir):
    return scrub.scrub_locales(_documents(spark, sf_dir)).select("doc_id", "locale", "text", F.coalesce("error", F.lit("")).alias("error"))


@query(cleaned_sql("conv_id, turn", scrubbed_sql("conv_id, turn", "text", "conversations")))
def scrub_conversations(spark, sf_dir):
    return scrub.scrub(table(spark, sf_dir, "conversations"), "en_US").select("conv_id", "turn", "text")


HOST = r"@?[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.example\.(?:com|net|org)(?:/[^\s<>]*)?"


@query(f"SELECT page_id, beg, (beg + length(hit))::INT AS \"end\", hit AS text FROM ({spans_sql('pages', HOST, 'page_id', 'html')}) WHERE hit[1] <> '@'")
def url_spans_html(spark, sf_dir):
    each = explode_spans(table(spark, sf_dir, "pages"), D.url(F.col("html"), 0), "page_id")
    return each.select("page_id", "s.beg", "s.end", "s.text")


TAIL = "concat(' https://d', doc_id, '.example.org/a/', lang, '?q=1&r, www.Site', doc_id, '.com; Mixed.Case', doc_id, '.com (in.net) x@in.org ftp://f.io')"


def placed_sql(key: str, source: str, text: str, tail: str, more: str = "", **hits: str) -> str:
    """(key, beg, end, [more,] text) of each hit, an SQL text, where it stands in the tail of the text."""
    parts = (f"SELECT {key}, {more.format(n)}{text} AS t, {tail} AS tail, {x} AS hit FROM {source}" for n, x in hits.items())
    names = "".join(f"{m.split(' AS ')[1]}, " for m in more.split(", ") if " AS " in m)
    return f'SELECT {key}, {names}(length(t) + position(hit IN tail) - 1)::INT AS beg, (length(t) + position(hit IN tail) - 1 + length(hit))::INT AS "end", hit AS text FROM ({" UNION ALL ".join(parts)})'


@query(placed_sql("doc_id", "documents", "text", TAIL, a="'https://d' || doc_id || '.example.org/a/' || lang || '?q=1&r'", b="'www.Site' || doc_id || '.com'", c="'ftp://f.io'"))
def url_spans_documents(spark, sf_dir):
    given = _documents(spark, sf_dir).select("doc_id", F.expr(f"concat(text, {TAIL})").alias("text"))
    each = explode_spans(given, D.url(F.col("text"), 0), "doc_id")
    return each.select("doc_id", "s.beg", "s.end", "s.text")


@query("""
SELECT doc_id, length(text)::INT + 1 AS beg, 't' || doc_id AS link_text, 'http://e' || doc_id || '.com/a' AS url, 1 AS bracket_pairs FROM documents
UNION ALL SELECT doc_id, length(text)::INT + 22 + 2 * length(doc_id::VARCHAR), 'two' || chr(10) || 'lines', 'www.x.org', 2 FROM documents
""")
def markdown_spans_documents(spark, sf_dir):
    tail = "concat(' [t', doc_id, '](http://e', doc_id, '.com/a), [[two\\nlines]](< www.x.org >), [[a](b)')"
    given = _derived(spark, sf_dir, tail=tail)
    each = explode_spans(given, D.markdown_url(F.col("text"), 0), "doc_id")
    return each.select("doc_id", "s.beg", "s.link_text", "s.url", "s.bracket_pairs")


SHARED = "concat(' https://t', doc_id, '.sharepoint.com/sites/', doc_id, '/', chr(10), 'List, (x)')"


@query(
    f"SELECT doc_id, beg, \"end\", 'url' AS type, replace(rtrim(text, ','), chr(10), '') AS text FROM ({placed_sql('doc_id', 'documents', 'text', SHARED, a=chr(39) + 'https://t' + chr(39) + ' || doc_id || ' + chr(39) + '.sharepoint.com/sites/' + chr(39) + ' || doc_id || ' + chr(39) + '/' + chr(39) + ' || chr(10) || ' + chr(39) + 'List,' + chr(39))})"
)
def sharepoint_documents(spark, sf_dir):
    given = _derived(spark, sf_dir, tail=SHARED)
    each = explode_spans(given, D.sharepoint_url(F.col("text"), 0), "doc_id")
    return each.select("doc_id", "s.beg", "s.end", "s.type", "s.text")


@query("SELECT doc_id, 20 AS beg, '1/2/' || (1960 + doc_id % 30) AS text FROM documents")
def birth_dates_documents(spark, sf_dir):
    given = _derived(spark, sf_dir, head="concat('seen 3/4/1990\\nBorn: 1/2/', cast(1960 + doc_id % 30 as string), '. ')")
    each = explode_spans(given, D.date_of_birth(F.col("text"), 0, 2025), "doc_id")
    return each.select("doc_id", "s.beg", "s.text")


@query("""
SELECT doc_id, i::INT AS beg FROM (SELECT doc_id, t, unnest(range(0, length(t) - 2)) AS i FROM (SELECT doc_id, repeat('th', (doc_id % 5 + 2)::INT) || 't ' || text AS t FROM documents))
WHERE substr(t, i + 1, 3) = 'tht'
""")
def custom_overlap_documents(spark, sf_dir):
    given = _derived(spark, sf_dir, head="concat(repeat('th', cast(doc_id % 5 + 2 as int)), 't ')")
    return explode_spans(given, D.custom(F.col("text"), 0, " tht "), "doc_id").select("doc_id", "s.beg")


ADDRESSED = "concat(' a', c_custkey, '@b.com,10.0.1.2 172.15.1.1 8.8.8.8')"


@query(placed_sql("c_custkey", "customer", "c_name", ADDRESSED, "'{}' AS type, ", unknown="'a' || c_custkey || '@b.com,10.0.1.2'", public_ip="'8.8.8.8'") + " UNION ALL " + placed_sql("c_custkey", "customer", "c_name", ADDRESSED, "'{}' AS type, ", unknown="'172.15.1.1'"))
def merge_customers(spark, sf_dir):
    given = table(spark, sf_dir, "customer").selectExpr("c_custkey", f"concat(c_name, {ADDRESSED}) AS text")
    found = scrub.with_spans(given, "en_US", ["email", "private_ip", "public_ip"], "com,10.0")
    return explode_spans(found, "spans", "c_custkey").select("c_custkey", "s.beg", "s.end", "s.type", "s.text")


# -- clean-up and normalisation of whole texts ------------------------------------------------------

RUN = "repeat(md5({x}), 3)"


@query(f"SELECT doc_id, '[x ' || left(r, 16) || '…' || right(r, 8) || '] (' || left(r, 80) || ') (y' || left(r, 16) || '…' || right(r, 8) || ') ' || text AS text FROM (SELECT doc_id, text, {RUN.format(x='text')} AS r FROM documents)".replace("(y' || left(r, 16)", "(y' || left(r, 15)"))
def gibberish_documents(spark, sf_dir):
    run = RUN.format(x="cast(text as binary)")
    given = _documents(spark, sf_dir).select("doc_id", F.expr(f"concat('[x ', {run}, '] (', left({run}, 80), ') (y', {run}, ') ', text)").alias("text"))
    return given.select("doc_id", cleanup.collapse_gibberish(F.col("text")).alias("text"))


MARKED = "concat('<UNKNOWN-', doc_id, '> [t](UNKNOWN-1)  a UNKNOWN-22 b', chr(10), 'b', chr(10), 'b', chr(10), text)"


@query(cleaned_sql("doc_id", f"SELECT doc_id, {MARKED} AS text FROM documents UNION ALL SELECT -1 - doc_id, '' FROM documents"))
def cleanup_documents(spark, sf_dir):
    docs = _documents(spark, sf_dir)
    given = docs.select("doc_id", F.expr(MARKED).alias("text")).unionByName(docs.select((-1 - F.col("doc_id")).alias("doc_id"), F.lit("").alias("text")))
    return given.select("doc_id", cleanup.cleanup(F.col("text")).alias("text"))


@query("SELECT doc_id, 'see https://e.com/a/p' || doc_id || ' end ' || text AS text FROM documents")
def join_urls_documents(spark, sf_dir):
    given = _derived(spark, sf_dir, head="concat('see https://e.com/\\na/\\np', doc_id, ' end ')")
    return given.select("doc_id", N.join_split_urls(F.col("text")).alias("text"))


ITEM = r"'^\s*(?:[-*•]|\d+\.)\s+'"


@query(f"""
SELECT doc_id, list_aggregate(list_transform(l, lambda x, i: CASE WHEN i > 1 AND regexp_matches(x, {ITEM}) AND trim(l[i - 1]) <> '' AND NOT regexp_matches(l[i - 1], '^\\s*[-*•]|^\\s*\\d+\\.\\s') THEN chr(10) || x ELSE x END), 'string_agg', chr(10)) AS text
FROM (SELECT doc_id, string_split(rtrim(replace(text, '. ', '.' || chr(10) || '- '), chr(10)), chr(10)) AS l FROM documents)
""")
def blank_before_list_documents(spark, sf_dir):
    given = _documents(spark, sf_dir).select("doc_id", F.expr("rtrim('\\n', replace(text, '. ', '.\\n- '))").alias("text"))
    return given.select("doc_id", N.blank_before_lists(F.col("text")).alias("text"))


@query("""
SELECT doc_id, coalesce((SELECT string_agg(block, chr(10) || chr(10) ORDER BY n) FROM (
  SELECT n, list_aggregate(list_transform(list_filter(string_split(b, chr(10)), lambda x: trim(x) <> ''), lambda x: trim(x)), 'string_agg', ' ') AS block
  FROM (SELECT unnest(bs) AS b, generate_subscripts(bs, 1) AS n)) WHERE block IS NOT NULL), '') AS text
FROM (SELECT doc_id, string_split_regex(text || chr(10) || chr(10) || 'Last' || chr(10) || 'one', '\n[ \t]*\n') AS bs FROM documents)
""")
def pdf_paragraphs_documents(spark, sf_dir):
    given = _derived(spark, sf_dir, tail="'\\n\\nLast\\none'")
    return given.select("doc_id", N.text_for_pdf(F.col("text"), "para").alias("text"))


@query(f"""
SELECT doc_id, 'One' || chr(10) || chr(10) || 'See <https://e.com/x' || doc_id || '> now' || chr(10) || list_aggregate(list_transform(l, lambda x: regexp_replace(x, '[ \t]+$', '')), 'string_agg', chr(10)) AS text
FROM (SELECT doc_id, CASE WHEN l[-1] = '' THEN l[:-2] ELSE l END AS l FROM (SELECT doc_id, string_split('end ' || regexp_replace(text, '\n{{3,}}', chr(10) || chr(10), 'g'), chr(10)) AS l FROM documents)) WHERE NOT list_contains(list_transform(l, lambda x: regexp_matches(x, {ITEM})), true)
""")
def normalize_pdf_documents(spark, sf_dir):
    item = r"(^|\\n)\\s*([-*•]|\\d+\\.)\\s"
    given = _derived(spark, sf_dir, head="concat('One  ', chr(12), chr(12), 'See https://e.\\ncom/x', doc_id, ' now\\nend ')").where(f"NOT text RLIKE '{item}'")
    return given.select("doc_id", N.normalize_pdf_text(F.col("text")).alias("text"))


# -- gazetteers and entity lists ----------------------------------------------------------------------


def _saved(folder: str, kind: str, values: list[str]) -> None:
    Path(folder).mkdir(parents=True, exist_ok=True)
    for v in values:
        entities.add_entity(folder, kind, v)


def _nations(spark: SparkSession, sf_dir: str) -> list[str]:
    """The 25 nations."""
    return [r["n_name"] for r in table(spark, sf_dir, "nation").orderBy("n_name").collect()]


PLACED = "SELECT c_custkey, n_name, '(' || c_name || ') of ' || n_name || ', x' || n_name || ' ' || lower(n_name) AS text FROM customer JOIN nation ON c_nationkey = n_nationkey"


@query(f"SELECT c_custkey, 'location' AS type, n_name AS text, (position(n_name IN text) - 1)::INT AS beg FROM ({PLACED})")
def entity_lists_from_files(spark, sf_dir):
    """Customers' nations, found by a list that the entity tool has written to a file."""
    folder = tempfile.mkdtemp(prefix="veil-entities-")
    _saved(folder, "city", _nations(spark, sf_dir))
    own = next(g for g in catalogue.entity_lists(folder, "en_US") if g.kind == "location")
    customers = table(spark, sf_dir, "customer").join(F.broadcast(table(spark, sf_dir, "nation")), F.col("c_nationkey") == F.col("n_nationkey"))
    given = customers.select("c_custkey", F.expr("concat('(', c_name, ') of ', n_name, ', x', n_name, ' ', lower(n_name))").alias("text"))
    return explode_spans(given, gazetteer.spans(F.col("text"), 0, own), "c_custkey").select("c_custkey", "s.type", "s.text", "s.beg")


@query("SELECT n_name AS match, 'location' AS filth_type FROM nation UNION ALL SELECT 'Breda', 'location'")
def entity_file(spark, sf_dir):
    """What the entity tool has written, duplicates refused, read back."""
    folder = tempfile.mkdtemp(prefix="veil-entities-")
    _saved(folder, "city", [*(names := _nations(spark, sf_dir)), names[0].lower(), names[-1].upper(), "Breda", "BREDA"])
    rows = entities.load_json(Path(folder) / "cities.json")
    assert entities.load_json(Path(folder) / "none.json") == [] and [r["match"] for r in rows] == sorted((r["match"] for r in rows), key=str.lower)
    return spark.createDataFrame([(r["match"], r["filth_type"]) for r in rows], "match string, filth_type string")


@query("SELECT doc_id, 3 AS beg, 13 AS \"end\", 'New' || chr(8203) || '  York' AS text FROM documents")
def normalised_fallback(spark, sf_dir):
    """An entity with a zero-width character and two blanks inside, before every whole text."""
    given = _documents(spark, sf_dir).select("doc_id", F.concat(F.lit(f"in New{ZERO}  York, "), "text").alias("text"))
    own = gazetteer.Gazetteer("location", ("New York", "Los Angeles"))
    return explode_spans(given, gazetteer.spans(F.col("text"), 0, own), "doc_id").select("doc_id", "s.beg", "s.end", "s.text")


@query("SELECT n_name AS text, 0 AS start, length(n_name)::INT AS \"end\", 'LOC' AS label FROM nation")
def ner_set(spark, sf_dir):
    """Training rows written as JSON and read back by a glob."""
    folder = _scratch(spark, "ner")
    have = table(spark, sf_dir, "nation").select(F.col("n_name").alias("match"), F.lit("location").alias("filth_type"))
    whole = entities.ner_rows(have).unionByName(spark.createDataFrame([("", [])], entities.ner_rows(have).schema)).agg(F.to_json(F.collect_list(F.struct("text", "entities"))).alias("text"))
    sinks.write_documents(whole.select(F.lit("places_spaCy.json").alias("name"), "text"), folder)
    rows = entities.load_ner_rows(spark, f"{folder}/*_spaCy.json")
    return rows.select("text", F.explode("entities").alias("e")).select("text", "e.start", "e.end", "e.label")


@query("SELECT min(match) AS match, 'name' AS filth_type FROM (SELECT regexp_replace(trim(n), '\\s+', ' ', 'g') AS match FROM (SELECT replace(c_name, '#', '  ') AS n FROM customer)) GROUP BY lower(match)")
def names_imported(spark, sf_dir):
    """Customers' names through a semicolon file without a header."""
    folder = _scratch(spark, "names")
    name = F.concat(F.lit("' "), F.replace("c_name", F.lit("#"), F.lit("  ")), F.lit("'"))
    table(spark, sf_dir, "customer").select(F.lit("M"), F.lit(2000), F.lit(1), name, F.lit(5)).write.csv(folder, sep=";", quote="\u0000")
    return entities.import_names(entities.read_names(spark, folder))


# -- files ------------------------------------------------------------------------------------------

LINES = "list_aggregate(list_filter(string_split(text, chr(10)), lambda x: x <> ''), 'string_agg', chr(10))"


@query(f"SELECT doc_id, coalesce({LINES}, '') AS text FROM documents")
def docx_round_trip(spark, sf_dir):
    """Every whole text written as DOCX and read back: its lines that are not empty."""

    @F.pandas_udf("binary")
    def written(texts: pd.Series) -> pd.Series:
        return texts.map(sinks.docx_bytes)

    files = _documents(spark, sf_dir).select(F.concat("doc_id", F.lit(".DOCX")).alias("path"), written("text").alias("content"))
    return readers.texts_of_files(files).select(F.expr("cast(substring_index(path, '.', 1) as long)").alias("doc_id"), "text")


@query(f"SELECT p_partkey, k AS kind, p_name || CASE WHEN k = 'docx' THEN '' ELSE chr(10) || chr(10) || p_partkey END AS text FROM part, (VALUES ('txt'), ('rtf'), ('docx')) v(k)")
def file_dispatch(spark, sf_dir):
    """Parts as plain text, RTF and DOCX files, each read by its suffix."""

    @F.pandas_udf("binary")
    def written(names: pd.Series) -> pd.Series:
        return names.map(sinks.docx_bytes)

    part = table(spark, sf_dir, "part").select("p_partkey", "p_name")
    rtf = F.expr("cast(concat('{\\\\rtf1\\\\ansi{\\\\fonttbl{\\\\f0 Arial;}}\\\\b ', p_name, '\\\\b0\\\\par\\\\par ', p_partkey, '}') as binary)")
    plain = F.expr("cast(concat(p_name, '\\n\\n', p_partkey) as binary)")
    each = [part.select(F.concat(F.lit("f/"), "p_partkey", F.lit(f".{k}")).alias("path"), c.alias("content")) for k, c in (("txt", plain), ("rtf", rtf), ("docx", written(F.concat("p_name", F.lit("\n")))))]
    files = each[0].unionByName(each[1]).unionByName(each[2])
    key, kind = F.expr("cast(regexp_extract(path, '([0-9]+)[.]', 1) as bigint)"), F.expr("substring_index(path, '.', -1)")
    return readers.texts_of_files(files).select(key.alias("p_partkey"), kind.alias("kind"), "text")


@query("SELECT n_nationkey, k AS fmt, n_name || ' of ' || n_regionkey AS text FROM nation, (VALUES ('txt'), ('md'), ('docx')) v(k)")
def files_written(spark, sf_dir):
    """A file for each nation in each format, written by the executors and read back."""
    folder = _scratch(spark, "files")
    rows = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("string").alias("name"), F.concat("n_name", F.lit(" of "), "n_regionkey").alias("text"))
    for fmt in ("txt", "md", "docx"):
        sinks.write_documents(rows, f"{folder}/{fmt}", fmt)
    read = readers.read_files(spark, f"{folder}/*")
    return read.select(F.expr("cast(regexp_extract(path, '([0-9]+)[.][a-z]+$', 1) as bigint)").cast(table(spark, sf_dir, "nation").schema["n_nationkey"].dataType).alias("n_nationkey"), F.expr("substring_index(path, '.', -1)").alias("fmt"), "text")


@query("SELECT doc_id, greatest(1, ceil((length(text) - length(replace(text, chr(10), '')) + 1) / 56.0))::INT AS pages FROM documents")
def pdf_pages(spark, sf_dir):
    """Pages of every whole text as a PDF: 56 lines of 13 points fit on one; what Helvetica lacks is made plain first."""

    @F.pandas_udf("int")
    def pages(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: sinks.pdf_bytes(t.encode("ascii", "replace").decode()).count(b"/Type /Page "))

    return _documents(spark, sf_dir).select("doc_id", pages("text").alias("pages"))


# -- surfaces -----------------------------------------------------------------------------------------

ADDRESSES = ["email", "private_ip", "public_ip"]
EITHER = f"(?:{ADDRESS}|{QUAD})"


@query(f"SELECT doc_id, regexp_replace(text, {_literal(EITHER)}, '[PII]', 'g') AS text FROM documents")
def replace_hook(spark, sf_dir):
    return scrub.scrub(_documents(spark, sf_dir), "en_US", ADDRESSES, cleanup=False, replace=lambda s: F.lit("[PII]")).select("doc_id", "text")


@query(scrubbed_sql("doc_id", "text", "documents").replace(_literal(ANY), _literal(EITHER)))
def streamed_scrub(spark, sf_dir):
    """documents as a stream of files, scrubbed to Parquet and read back."""
    folder = _scratch(spark, "stream")
    schema = table(spark, sf_dir, "documents").schema
    stream = scrubbing.read_stream(spark, f"{sf_dir}/documents.parque[t]", schema).select("doc_id", "text")
    scrubbing.scrub_to(stream, f"{folder}/out", f"{folder}/log", detectors=ADDRESSES, cleanup=False).awaitTermination()
    return spark.read.parquet(f"{folder}/out")


@query(f"SELECT c_custkey, 'NAME-' || lpad({NUMBER(chr(39) + 'name:' + chr(39) + ' || c_name')}::VARCHAR, 4, '0') AS placeholder, {NUMBER('c_name', 97)}::BIGINT AS number FROM customer")
def sql_functions(spark, sf_dir):
    sql.register(spark)
    table(spark, sf_dir, "customer").createOrReplaceTempView("veil_customer")
    return spark.sql("SELECT c_custkey, veil_placeholder('name', c_name) AS placeholder, veil_digest_modulo(c_name, 97) AS number FROM veil_customer")


@query(scrubbed_sql("doc_id", "text", "documents"))
def sql_scrub(spark, sf_dir):
    sql.register(spark)
    _documents(spark, sf_dir).createOrReplaceTempView("veil_documents_view")
    return spark.sql("SELECT doc_id, veil_scrub(text, 'en_US') AS text FROM veil_documents_view")


@query(f"SELECT doc_id, {kind_sql('hit')} AS type, hit AS text, beg FROM ({spans_sql('documents', ANY)})")
def sql_detect(spark, sf_dir):
    sql.register(spark)
    _documents(spark, sf_dir).createOrReplaceTempView("veil_documents_view")
    return spark.sql("SELECT d.doc_id, p.type, p.text, p.beg FROM veil_documents_view d, LATERAL detect_pii(d.text, 'en_US') p")


@query("SELECT doc_id, beg, hit AS text FROM (" + spans_sql("documents", r"[a-z]+tion[.,]") + ")")
def registered_detector(spark, sf_dir):
    """A detector of one's own, registered for a locale and selected by name."""
    before = list(catalogue.BY_LOCALE["en_US"])
    build = lambda text, rank: F.transform(matches(text, r"[a-z]+tion[.,]"), lambda m: span(m["beg"], m["end"], "noun", m["text"], "noun", rank))
    try:
        catalogue.register_detector(catalogue.Spec("noun", "Words in -tion at the end of something", lambda locale: build), "en_US")
        found = scrub.findings(_documents(spark, sf_dir), "en_US", ["noun"])
    finally:
        catalogue.BY_LOCALE["en_US"][:] = before
    return found.select("doc_id", "beg", "text")


@query(f"SELECT doc_id, CASE WHEN text = '' THEN '' ELSE regexp_replace(text, {_literal(ADDRESS)}, '', 'g') END AS text FROM documents")
def combined_texts(spark, sf_dir):
    """Both locales' results under one another; here one locale's text is taken away again, so the other's is left."""
    both = scrub.scrub_locales(_documents(spark, sf_dir), detectors={"en_US": ["email"], "nl_NL": []}, cleanup=False)
    whole = scrub.combined_text(both.withColumn("text", F.regexp_replace("text", "EMAIL-\\d{4}", "")))
    dutch = both.where("locale = 'nl_NL'").select("doc_id", F.col("text").alias("plain"))
    return whole.join(dutch, "doc_id").select("doc_id", F.expr("CASE WHEN plain = '' THEN text ELSE left(text, length(text) - length(plain) - 2) END").alias("text"))


@query(
    f"SELECT x AS locale, count(*) AS texts, sum(length(t))::BIGINT AS characters, sum(n)::BIGINT AS spans, 0::BIGINT AS errors FROM (SELECT doc_id, length(text) AS own, len(regexp_extract_all(text, {_literal(EITHER)})) AS n FROM documents)"
    f" JOIN ({scrubbed_sql('doc_id', 'text', 'documents').replace(_literal(ANY), _literal(EITHER)).replace('AS text FROM', 'AS t FROM', 1)}) USING (doc_id), (VALUES ('en_US'), ('nl_NL')) v(x) GROUP BY x"
)
def run_summary(spark, sf_dir):
    return scrub.summary(scrub.scrub_locales(_documents(spark, sf_dir), detectors=ADDRESSES, cleanup=False, include_spans=True))


@query(_expect("n, token", [(0, "name"), (1, "url"), (2, "x")]))
def selection_tokens(spark, sf_dir):
    return spark.createDataFrame(list(enumerate(catalogue.plain_tokens(["en:name", "url", "nl:name", "nl:x", "url"]))), "n int, token string")


@query(_expect("part, names", [("generic", "email markdown_url phone private_ip public_ip url"), ("en", "date_of_birth location name organization sharepoint_url"), ("nl", "application location name organization sharepoint_url")]))
def detector_groups(spark, sf_dir):
    found = zip(("generic", "en", "nl"), catalogue.grouped(), strict=True)
    return spark.createDataFrame([(p, " ".join(sorted(n for n in d if n != "spacy_entities"))) for p, d in found], "part string, names string")


@query(_expect("n, head", [(0, "generic:"), (1, "  markdown_url    URLs"), (2, "  sharepoint_url  Shar"), (3, "  url             URLs"), (4, "  email           E-ma"), (5, "  phone           Phon"), (6, "  private_ip      Priv"), (7, "  public_ip       Publ")]))
def detector_listing(spark, sf_dir):
    return spark.createDataFrame([(i, line[:22]) for i, line in enumerate(catalogue.listing().split("\n")[:8])], "n int, head string")


@query(_expect("command", [('veil -i <input-file> -l en_US -d "name url" --no-cleanup -v --output-format pdf --pdf-mode para --font-size 12 --pdf-backend markitdown',), ("veil -t <text>",)]))
def command_preview(spark, sf_dir):
    told = [cli.preview("file", "en_US", ["en:name", "url"], False, True, "pdf", "para", 12, "markitdown"), cli.preview()]
    return spark.createDataFrame([(x,) for x in told], "command string")


@query(_expect("source, text", [("text", "own"), ("file", "from a file"), ("append", "from before"), ("append to nothing", "own"), ("stdin", "piped"), ("append alone", "ValueError"), ("nothing", "ValueError")]))
def input_order(spark, sf_dir):
    folder = Path(tempfile.mkdtemp(prefix="veil-input-"))
    (folder / "in.txt").write_text("from a file")
    (folder / "out.txt").write_text("from before")
    out = []
    asked = {
        "text": {"text": "own"}, "file": {"text": "own", "input_path": f"file:{folder}/in.txt"}, "append": {"text": "own", "input_path": f"{folder}/in.txt", "append": True, "output_path": f"{folder}/out.txt"},
        "append to nothing": {"text": "own", "append": True, "output_path": f"{folder}/none.txt"}, "stdin": {}, "append alone": {"text": "own", "append": True}, "nothing": {},
    }
    before = sys.stdin
    try:
        for name, told in asked.items():
            sys.stdin = None if name == "nothing" else io.StringIO("piped")
            try:
                out.append((name, readers.resolve_input(spark, **told).first()["text"]))
            except ValueError:
                out.append((name, "ValueError"))
    finally:
        sys.stdin = before
    return spark.createDataFrame(out, "source string, text string")


@query(_expect("fmt, head", [("docx", "PK"), ("markdown", "é"), ("md", "é"), ("odt", "ValueError"), ("pdf", "%PDF-1.4"), ("txt", "é")]))
def output_formats(spark, sf_dir):
    def head(fmt: str) -> str:
        try:
            return sinks.encode("é", fmt)[: 2 if fmt == "docx" else 8].decode()
        except ValueError:
            return "ValueError"

    return spark.createDataFrame([(f, head(f)) for f in ("docx", "markdown", "md", "odt", "pdf", "txt")], "fmt string, head string")


@query(_expect("fmt, error", [("docx", "ConversionError"), ("odt", "ConversionError"), ("rtf", "ConversionError")]))
def conversion_errors(spark, sf_dir):
    """What is not of its format; the tools that might read it all the same are asked for by name elsewhere."""

    def told(fmt: str) -> str:
        try:
            return readers.convert(fmt, b"not of this format")
        except readers.ConversionError as error:
            return type(error).__name__

    return spark.createDataFrame([(f, told(f)) for f in ("docx", "odt", "rtf")], "fmt string, error string")
