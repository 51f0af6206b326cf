"""Time the headline queries over BENCH_SF_DIR on local[BENCH_CPUS]; print one JSON line."""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

from pyspark.sql import SparkSession

from denpyo.session import configure
from denpyo.sources import files
from fixtures import catalog

HEADLINE = [
    "normalize_invoices", "normalize_text_documents", "classify_vendor", "extract_tables",
    "line_items", "map_fields", "rule_lookup", "text_screens", "tf_date", "validate_verdict",
    "line_totals_by_document", "vendor_master_match", "resolve_customer", "duplicate_flag",
    "upsert_latest", "hourly_counts",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    builder = (
        SparkSession.builder.master(f"local[{cpus}]").appName("denpyo-bench")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", "16g")
        .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="denpyo-bench-"))
    )
    spark = configure(builder).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    names = sys.argv[1:] or HEADLINE
    # Start the JVM's readers and the code generator before the first timing.
    catalog.QUERIES["hourly_counts"](spark, sf_dir).count()
    seconds: dict[str, float] = {}
    for name in names:
        start = time.perf_counter()
        catalog.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
        print(f"{name}: {seconds[name]}", file=sys.stderr, flush=True)
    files.remove_scratch(spark)
    print(json.dumps({
        "metric": "headline_queries_total", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "sf": os.path.basename(sf_dir.rstrip("/")),
    }))


if __name__ == "__main__":
    main()
