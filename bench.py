"""Headline queries, timed. Prints one JSON line.

BENCH_SF_DIR   table folder (default /root/testdata/sf0.1)
BENCH_CPUS     local threads (default 8)
BENCH_QUERIES  comma-separated names, or "all"
BENCH_RUNS     timed runs per query after one warm-up; the median counts (default 2)
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import DataFrame, SparkSession  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

from leadloom.functions.text import norm_company  # noqa: E402
from leadloom.plans.catalog import QUERIES  # noqa: E402
from leadloom.plans.views import Views  # noqa: E402
from leadloom.session import build_session  # noqa: E402

HEADLINE = ("topk_scored", "score_docs", "keyword_match", "sponsor_match", "upsert_jobs",
            "upsert_companies", "gap_report", "needs_regen", "sendable_drafts", "fallback_enrich",
            "dashboard_stats", "daily_digest", "purge_bad", "draft_documents", "latest_doc",
            "append_with_ids", "distribute_bullets", "extract_cards", "extract_cards_nested",
            "extract_text", "parse_labelled", "render_prompts", "stream_digest")


def naive_link(spark: SparkSession, base: str) -> DataFrame:
    """The pairwise form of sponsor_match, for comparison only."""
    v = Views(spark, base)
    left = v.companies_in_pages().withColumn("n", norm_company("company"))
    right = v.sponsors_in_texts().select(norm_company("name").alias("m"))
    cond = F.contains("n", F.col("m")) | F.contains("m", F.col("n"))
    return left.join(right, cond, "left_semi")


def laid_out(spark: SparkSession, base: str, files: int) -> str:
    """The tables with the text ones in several files, as a store would hold them.

    A test table is one file of one row group, which one task must read; no query
    works around that.
    """
    folder = tempfile.mkdtemp(prefix="bench-")
    for name in sorted(os.listdir(base)):
        source, target = os.path.join(base, name), os.path.join(folder, name)
        if name in ("documents.parquet", "pages.parquet"):
            spark.read.parquet(source).repartition(files).write.parquet(target)
        else:
            os.symlink(os.path.abspath(source), target)
    return folder


def timed(run, runs: int) -> float:
    out = []
    for i in range(runs + 1):
        start = time.perf_counter()
        run().write.format("noop").mode("overwrite").save()
        out.append(time.perf_counter() - start)
    return round(statistics.median(out[1:] or out), 4)


def main() -> None:
    base = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "2"))
    asked = os.environ.get("BENCH_QUERIES", "")
    names = list(QUERIES) if asked == "all" else (asked.split(",") if asked else list(HEADLINE))
    spark = build_session("bench", f"local[{cpus}]", **{
        "spark.sql.shuffle.partitions": cpus, "spark.driver.memory": "16g",
        "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false",
        "spark.log.level": "ERROR"})
    tables = laid_out(spark, base, int(cpus))
    results = {n: timed(lambda n=n: QUERIES[n](spark, tables), runs) for n in names}
    if not asked:
        results["sponsor_match_pairwise"] = timed(lambda: naive_link(spark, tables), runs)
    total = sum(t for n, t in results.items() if n != "sponsor_match_pairwise")
    print(json.dumps({"metric": "headline_total", "value": round(total, 3), "unit": "sec",
                      "queries": results, "sf": os.path.basename(base.rstrip("/")),
                      "cpus": int(cpus), "spark": spark.version}))
    spark.stop()


if __name__ == "__main__":
    main()
