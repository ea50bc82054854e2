"""Headline timings: prints one JSON line.

    BENCH_SF_DIR  folder with the test tables (default /root/testdata/sf0.1)
    BENCH_CPUS    local cores (default 8)
"""

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import SparkSession

from pagesim.operators import lsh
from pagesim.plans import index as store, queries as q
from pagesim.session import configure, ship, work_dir
from pagesim.sources import read_archive

FOLDER = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
CPUS = os.environ.get("BENCH_CPUS", "8")


def run(df):
    df.write.format("noop").mode("overwrite").save()


def main():
    spark = (
        SparkSession.builder.master(f"local[{CPUS}]")
        .appName("bench")
        .config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "8g"))
        .config("spark.sql.shuffle.partitions", CPUS)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    ship(configure(spark))
    # Session start-up (Python workers of every kind) before the clock runs.
    small = os.path.join(os.path.dirname(FOLDER), "sf0.001")
    small = small if os.path.isdir(small) else FOLDER
    run(q.minhash_documents(spark, small))
    run(q.warc_scan(spark, small))

    times = {}

    def timed(name, action):
        start = time.time()
        out = action()
        times[name] = round(time.time() - start, 3)
        return out

    timed("pages_to_features_full_vocabulary", lambda: run(q.features(spark, FOLDER, q.vc.FULL)))
    idx = timed(
        "pages_to_stored_index",
        lambda: store.build_index(
            q.pages(spark, FOLDER).select("url", "html"), work_dir(spark, "bench-index"), q.BLOCK
        ),
    )
    ten = q.pages(spark, FOLDER).orderBy("url").limit(10)
    timed(
        "ten_page_query_on_stored_index",
        lambda: run(lsh.similar_pages(q.tree.page_features(ten, "html", q.BLOCK), idx)),
    )
    timed("minhash_documents", lambda: run(q.minhash_documents(spark, FOLDER)))
    timed("minhash_document_rows", lambda: run(q.minhash_rows(spark, FOLDER)))
    timed("weighted_minhash_pages", lambda: run(q.weighted_minhash(spark, FOLDER)))
    timed("similar_document_pairs", lambda: run(q.similar_pairs(spark, FOLDER)))
    timed("cluster_documents", lambda: run(q.cluster_documents(spark, FOLDER)))
    timed("bucket_contents_documents", lambda: run(q.bucket_contents(spark, FOLDER)))
    path = timed("warc_write", lambda: q._warc_folder(spark, FOLDER, "gzip"))
    timed("warc_scan", lambda: run(read_archive(spark, path, "warc")))
    timed("arc_write_and_scan", lambda: run(q.arc_scan(spark, FOLDER)))
    timed("archive_to_stored_index", lambda: q.archive_ingest(spark, FOLDER).count())
    timed("stream_to_stored_index", lambda: q.stream_index(spark, FOLDER).count())
    print(
        json.dumps(
            {
                "metric": "headline queries, total",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": os.path.basename(FOLDER).removeprefix("sf"),
                "cpus": int(CPUS),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
