"""Line dedup by winnowing over line hashes, in DataFrame operations only.

A passage that occurs a second time, anywhere, is deleted there: a run of `window` or more lines that follow one another,
blank lines between them passed over, or a long line by itself.  Of every window of lines the one of least hash is its
fingerprint, so equal windows choose the same line: windows are kept with the position that stands for them, positions are joined by their
fingerprints, and those whose fingerprint occurs once drop out.  From each joined position the match is extended both ways, window by window, as far as contents have occurred before.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veil.llm.common import cut, free

#: Lines of the shortest run that is found for certain.
WINDOW = 2
#: A line of so many words, or so many characters (scripts without spaces), is a passage by itself.
LONG_WORDS, LONG_CHARS = 20, 100
#: A line without any of these is blank; runs of them are words.
FULL = r"[^ \t\x0B\f\r\n]"


def _lines(text: str) -> Column:
    return F.split(F.coalesce(F.col(text).cast("string"), F.lit("")), "\n", -1)


def _hashes(lines: Column, salt: int) -> Column:
    return F.transform(lines, lambda x: F.xxhash64(F.lit(salt), x))


def _long(line: Column) -> Column:
    return (F.length(line) >= LONG_CHARS) | ((F.length(line) >= 2 * LONG_WORDS - 1) & (F.regexp_count(line, F.lit(f"{FULL}+")) >= LONG_WORDS))


def later_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """(id, text_hash, runs): the maximal runs [first, end) of lines that repeat earlier ones, in order.

    Earlier is by (id, hash of the text, line).  Windows are of lines with content, blank lines inside a run go with it.
    Contents are compared by two 64-bit hashes of all their lines.  Both aggregates are checkpointed, so the joins with them shuffle both
    sides and AQE can split a hot line's or window's rows.
    """
    at = lambda a, i: F.get(F.col(a), i.cast("int"))
    reach = F.sequence(F.lit(0), F.lit(window - 1))
    span = lambda a, p: F.transform(reach, lambda j: at(a, p + j))
    split = docs.select(F.col(id_col).cast("bigint").alias("id"), F.xxhash64(F.lit(3), F.col(text_col).cast("string")).alias("th"), _lines(text_col).alias("l"))
    full = F.filter(F.transform("l", lambda x, i: F.struct(x.alias("x"), i.alias("i"))), lambda s: s["x"].rlike(FULL))
    lines = split.select("id", "th", full.alias("s")).select("id", "th", F.col("s.x").alias("l"), F.col("s.i").alias("line"))
    hashed = lines.where(F.size("l") >= 1).select("id", "th", "line", _hashes(F.col("l"), 1).alias("h"), _hashes(F.col("l"), 2).alias("k"), F.transform("l", _long).alias("long"))
    least = lambda p: F.array_min(F.transform(reach, lambda j: F.struct(at("h", p + j).alias("h"), (p + j).cast("int").alias("j"))))["j"]

    def content(p: Column, n: int, first: Column, second: Column) -> Column:
        return F.struct(p.cast("int").alias("p"), (p + n).cast("int").alias("q"), at("line", p).alias("s"), (at("line", p + (n - 1)) + 1).alias("e"), F.xxhash64(first).alias("g"), F.xxhash64(second).alias("g2"))

    def stands_for(j: Column) -> Column:
        """The windows whose fingerprint is line j, and that line alone if it is long."""
        low, high = F.greatest(j - (window - 1), F.lit(0)), F.least(j, F.size("h") - window)
        around = F.when(low <= high, F.sequence(low, F.greatest(low, high))).otherwise(F.array().cast("array<int>"))
        runs = F.transform(F.filter(around, lambda p: least(p) == j), lambda p: content(p, window, span("h", p), span("k", p)))
        return F.concat(runs, F.when(at("long", j), F.array(content(j, 1, F.array(at("h", j)), F.array(at("k", j))))).otherwise(F.slice(runs, 1, 0)))

    marks = F.transform(F.sequence(F.lit(0), F.size("h") - 1), lambda j: F.struct(at("h", j).alias("f"), stands_for(j).alias("windows")))
    positions = hashed.select("id", "th", F.explode(marks).alias("m")).select("id", "th", "m.f", "m.windows").where(F.size("windows") > 0)
    repeated = cut(positions.groupBy("f").agg(F.count("*").alias("n")).where("n > 1").select("f"))
    candidates = positions.join(repeated, "f").select("id", "th", F.explode("windows").alias("w")).select("id", "th", "w.*")
    where = F.struct("id", "th", "p")
    first = cut(candidates.groupBy("g", "g2").agg(F.min(where).alias("first"), F.count("*").alias("n")).where("n > 1").select("g", "g2", "first"))
    later = candidates.join(first, ["g", "g2"]).where(~where.eqNullSafe(F.col("first"))).select("id", "th", "p", "q", "s", "e").distinct()
    order = Window.partitionBy("id", "th").orderBy("p", "q")
    gap = (F.col("p") > F.max("q").over(order.rowsBetween(Window.unboundedPreceding, -1))).cast("int")
    islands = later.withColumn("gap", F.coalesce(gap, F.lit(0))).withColumn("run", F.sum("gap").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    runs = islands.groupBy("id", "th", "run").agg(F.min("s").alias("first"), F.max("e").alias("end"))
    return runs.groupBy("id", "th").agg(F.sort_array(F.collect_list(F.struct("first", "end"))).alias("runs"))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, counts: bool = True) -> DataFrame:
    """docs with all columns, the text without later repeated passages, and n_lines, n_removed, n_runs (of the input, and of what went).

    Columns of docs by these three names are replaced; counts=False adds and replaces none.  A null text stays null and an empty one empty, with no lines; a
    text that repeats others whole becomes empty.  Rows equal in id and text count as one and each come out alike.
    Text is shuffled once, to meet its runs; a window in a third of all rows is aggregated before the
    shuffle and joined as one row against many, which AQE splits.  An empty table gives none.
    """
    kept = [c for c in docs.columns if not counts or c not in ("n_lines", "n_removed", "n_runs")]
    key, digest, own_id, own_hash, own_runs = free(docs.columns, "key", "hash", "id", "th", "runs")
    runs = later_runs(docs, id_col, text_col, window).withColumnsRenamed({"id": own_id, "th": own_hash, "runs": own_runs})
    here = docs.select(*(F.col(f"`{c}`") for c in kept), F.col(id_col).cast("bigint").alias(key), F.xxhash64(F.lit(3), F.col(text_col).cast("string")).alias(digest))
    both = here.join(runs.hint("shuffle_hash"), (F.col(digest) == F.col(own_hash)) & F.col(key).eqNullSafe(F.col(own_id)), "left")
    lines, gone = _lines(text_col), F.col(own_runs)
    empty = F.col(text_col).isNull() | (F.col(text_col).cast("string") == "")
    edge = lambda i: F.when(i == 0, 0).otherwise(F.get(gone, (i - 1).cast("int"))["end"])
    stop = lambda i: F.coalesce(F.get(gone, i.cast("int"))["first"], F.size(lines))
    rest = F.flatten(F.transform(F.sequence(F.lit(0), F.size(gone)), lambda i: F.slice(lines, edge(i) + 1, stop(i) - edge(i))))
    text = F.when(gone.isNull(), F.col(text_col).cast("string")).otherwise(F.array_join(rest, "\n"))
    out = [(text.alias(c) if c == text_col else F.col(f"`{c}`")) for c in kept]
    if counts:
        removed = F.coalesce(F.aggregate(gone, F.lit(0), lambda s, r: s + (r["end"] - r["first"])), F.lit(0))
        out += [F.when(empty, 0).otherwise(F.size(lines)).cast("bigint").alias("n_lines"), removed.cast("bigint").alias("n_removed"), F.coalesce(F.size(gone), F.lit(0)).cast("bigint").alias("n_runs")]
    return both.select(*out)


#: The same in SQL: lines with content by number, passages of two of them or of a long one by content, all but a passage's first place marked.
SQL = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, text IS NULL AS nil FROM documents),
l AS (SELECT doc_id, unnest(string_split(t, chr(10))) AS line, generate_subscripts(string_split(t, chr(10)), 1) - 1 AS i FROM d),
f AS (SELECT doc_id, i, line, row_number() OVER o AS p, lead(line) OVER o AS below FROM l WHERE regexp_matches(line, '{FULL}') WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
w AS (SELECT doc_id, p, 2 AS n, line, below FROM f WHERE below IS NOT NULL
      UNION ALL SELECT doc_id, p, 1, line, NULL FROM f WHERE length(line) >= {LONG_CHARS} OR len(regexp_extract_all(line, '{FULL}+')) >= {LONG_WORDS}),
g AS (SELECT doc_id, p, n, row_number() OVER (PARTITION BY n, line, below ORDER BY doc_id, p) AS k FROM w),
gone AS (SELECT DISTINCT doc_id, p + x AS p FROM g, (VALUES (0), (1)) v(x) WHERE k > 1 AND x < n),
m AS (SELECT l.doc_id, l.i, l.line, f.p IS NOT NULL AS filled, count(f.p) OVER (PARTITION BY l.doc_id ORDER BY l.i) AS p FROM l LEFT JOIN f ON l.doc_id = f.doc_id AND l.i = f.i),
c AS (SELECT m.doc_id, m.i, m.line, m.filled, a.p IS NOT NULL AS own, a.p IS NOT NULL AND (m.filled OR b.p IS NOT NULL) AS cut, z.p IS NOT NULL AS above
      FROM m LEFT JOIN gone a ON m.doc_id = a.doc_id AND m.p = a.p LEFT JOIN gone b ON m.doc_id = b.doc_id AND m.p + 1 = b.p LEFT JOIN gone z ON m.doc_id = z.doc_id AND m.p - 1 = z.p),
s AS (SELECT doc_id, count(*) AS n, count(*) FILTER (cut) AS r, count(*) FILTER (filled AND own AND NOT above) AS runs,
      coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT cut), '') AS kept FROM c GROUP BY doc_id)
SELECT d.doc_id, CASE WHEN d.t = '' THEN 0 ELSE s.n END AS n_lines, s.r AS n_removed, s.runs AS n_runs,
       CASE WHEN d.nil THEN NULL ELSE sha256(s.kept) END AS kept_sha256
FROM d JOIN s ON d.doc_id = s.doc_id
"""
