"""Entity lists: adding to them, importing names, and rows for training named-entity models."""

from __future__ import annotations

import json
import logging
from pathlib import Path
from unicodedata import normalize

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from veil.functions.text import strip

log = logging.getLogger(__name__)
KINDS = ("city", "name", "organization", "application")
FILES = {"city": "cities.json", "name": "names.json", "organization": "organizations.json", "application": "applications.json"}
# Labels of named-entity models.
NER_LABELS = {"name": "PERSON", "location": "LOC", "organization": "ORG", "organisation": "ORG"}


def upsert(entities: DataFrame, additions: DataFrame) -> DataFrame:
    """(match, filth_type) with the additions (kind, match) whose lower case is not there yet, by lower case; a city is a location."""
    kind = F.when(F.col("kind") == "city", "location").otherwise(F.col("kind"))
    first = Window.partitionBy(F.lower("match")).orderBy("match")
    new = additions.select("match", kind.alias("filth_type")).withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n")
    have = entities.select(F.lower("match").alias("_low")).distinct()
    fresh = new.join(have, F.lower("match") == F.col("_low"), "left_anti")
    return entities.select("match", "filth_type").unionByName(fresh).orderBy(F.lower("match"), "match")


def load_json(path: str | Path) -> list[dict]:
    """The list in a file; none, with a message, if it is missing, closed or broken."""
    try:
        return json.loads(Path(path).read_text(encoding="utf-8"))
    except (OSError, json.JSONDecodeError) as error:
        log.error("%s: %s", path, error)
        return []


def add_entity(folder: str | Path, kind: str, value: str) -> bool:
    """Adds to the folder's list of that kind; False for an unknown kind, a duplicate (case aside) or a failed write."""
    if kind not in FILES:
        log.error("unknown kind of entity: %s", kind)
        return False
    path = Path(folder) / FILES[kind]
    rows = load_json(path)
    if value.lower() in {r["match"].lower() for r in rows}:
        log.warning("%s is there already", value)
        return False
    rows = sorted([*rows, {"match": value, "filth_type": "location" if kind == "city" else kind}], key=lambda r: r["match"].lower())
    try:
        path.write_text(json.dumps(rows, indent=4, ensure_ascii=False), encoding="utf-8")
    except OSError as error:
        log.error("%s: %s", path, error)
        return False
    return True


def normalise_name(name: Column) -> Column:
    """Stripped, one pair of quotes off, NFC, single blanks."""
    @F.pandas_udf("string")
    def nfc(s: pd.Series) -> pd.Series:
        return s.map(lambda x: None if x is None else normalize("NFC", x))

    bare = strip(name)
    quoted = ((bare.startswith('"') & bare.endswith('"')) | (bare.startswith("'") & bare.endswith("'"))) & (F.length(bare) > 0)
    inner = F.when(quoted, strip(F.substring(bare, F.lit(2), F.greatest(F.length(bare) - 2, F.lit(0))))).otherwise(bare)
    plain = F.when(inner.rlike("[^\\x00-\\x7f]"), nfc(inner)).otherwise(inner)
    return strip(F.regexp_replace(plain, "(?U)[\\s\\x1c-\\x1f]+", " "))


def import_names(rows: DataFrame, name_col: str = "name") -> DataFrame:
    """(match, filth_type): the normalised names, the first of each lower case in the order (ord, if there is one, else name), sorted."""
    order = "ord" if "ord" in rows.columns else name_col
    names = rows.select(normalise_name(F.col(name_col)).alias("match"), F.col(order).alias("_ord")).where("match <> ''")
    first = Window.partitionBy(F.lower("match")).orderBy("_ord", "match")
    kept = names.withColumn("_n", F.row_number().over(first)).where("_n = 1")
    return kept.select("match", F.lit("name").alias("filth_type")).orderBy(F.lower("match"))


def read_names(spark: SparkSession, path: str, encoding: str = "UTF-8") -> DataFrame:
    """(sex, year, month, name, count) of a semicolon file without a header."""
    return spark.read.csv(path, sep=";", header=False, schema="sex string, year int, month int, name string, count long", encoding=encoding)


def decode_best(content: Column) -> Column:
    """Bytes as UTF-8 if they are valid, else as Latin-1."""
    return F.when(F.is_valid_utf8(content.cast("string")), content.cast("string")).otherwise(F.decode(content, "ISO-8859-1"))


def ner_rows(entities: DataFrame) -> DataFrame:
    """(text, entities): one span over the whole of each known kind's entity."""
    label = F.create_map(*(F.lit(x) for pair in NER_LABELS.items() for x in pair))[F.col("filth_type")]
    whole = F.struct(F.lit(0).alias("start"), F.length("match").alias("end"), label.alias("label"))
    return entities.where((F.col("match") != "") & label.isNotNull()).select(F.col("match").alias("text"), F.array(whole).alias("entities"))


def load_ner_rows(spark: SparkSession, pattern: str) -> DataFrame:
    """Training rows of all files of a glob, without empty texts."""
    return spark.read.option("multiLine", True).schema("text string, entities array<struct<start:int,end:int,label:string>>").json(pattern).where("text <> ''")


def split_ner_rows(rows: DataFrame, share: float = 0.9, seed: int = 13) -> tuple[DataFrame, DataFrame]:
    """(training, test) by a hash of the text, the same in every run."""
    mark = F.pmod(F.xxhash64(F.lit(seed), "text"), F.lit(1000)) < int(share * 1000)
    return rows.where(mark), rows.where(~mark)
