"""Times the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one line of JSON."""

from __future__ import annotations

import json
import os
import statistics
import sys
import time
from pathlib import Path

ROOT = str(Path(__file__).resolve().parent)
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = os.pathsep.join([ROOT, os.environ.get("PYTHONPATH", "")])

from pyspark.sql import DataFrame, SparkSession  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

SF = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", str(os.cpu_count() or 8))
RUNS = int(os.environ.get("BENCH_RUNS", "3"))


def main() -> None:
    from veil.operators import cleanup, gazetteer
    from veil.plans import catalogue, scrub

    spark = (
        SparkSession.builder.master(f"local[{CPUS}]").appName("bench")
        .config("spark.sql.shuffle.partitions", CPUS).config("spark.driver.memory", "12g").config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "source", "text").repartition(2 * int(CPUS)).cache()
    n, chars = docs.agg(F.count("*"), F.sum(F.length("text"))).first()
    addresses = ["email", "private_ip", "public_ip"]
    generic = [s.name for s in catalogue.GENERIC]
    names = next(g for g in catalogue.GAZETTEERS["en_US"] if g.kind == "name")
    listed = spark.createDataFrame([("name", x) for x in names.loaded], "kind string, match string")
    queries: dict[str, DataFrame] = {
        "email": scrub.scrub(docs, "en_US", ["email"]),
        "addresses": scrub.scrub(docs, "en_US", addresses),
        "generic": scrub.scrub(docs, "en_US", generic),
        "en_US": scrub.scrub(docs, "en_US"),
        "filth_by_type": scrub.findings(docs, "en_US", addresses).groupBy("type").count(),
        "gazetteer_automaton": docs.select("doc_id", gazetteer.spans(F.col("text"), 0, names).alias("s")),
        "gazetteer_join": gazetteer.joined_spans(docs, listed, []),
        "cleanup": docs.select("doc_id", cleanup.cleanup(F.col("text")).alias("text")),
    }
    took = {}
    for name, df in queries.items():
        runs = []
        for _ in range(RUNS):
            start = time.time()
            df.write.format("noop").mode("overwrite").save()
            runs.append(time.time() - start)
        took[name] = round(statistics.median(runs), 3)
    total = round(sum(took.values()), 3)
    rates = {k: {"docs_per_s": round(n / s), "chars_per_s": round(chars / s)} for k, s in took.items()}
    print(json.dumps({"metric": "total of median seconds", "value": total, "unit": "sec", "queries": took, "sf": SF, "cpus": int(CPUS), "runs": RUNS, "rates": rates}))


if __name__ == "__main__":
    main()
