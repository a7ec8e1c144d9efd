"""Time the heavy operators on an enlarged copy of the link view, and the readers on long documents.

``python bench_scale.py [factor]`` makes ``factor`` copies of the pages of ``$BENCH_SF_DIR`` with paths of their
own, stores them below a new folder of the warehouse and prints one JSON line of seconds.
"""

from __future__ import annotations

import json
import os
import sys
import time
import uuid

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from hrefmill.catalog import fixtures as fx  # noqa: E402
from hrefmill.operators import dedup, search, similarity, transitions  # noqa: E402
from hrefmill.operators.similarity import Layer  # noqa: E402
from hrefmill.sources import files, formats  # noqa: E402


def main(factor: int) -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("hrefmill-bench-scale")
        .config("spark.sql.shuffle.partitions", str(4 * int(cpus)))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    base = f"{spark.conf.get('spark.sql.warehouse.dir')}/bench-{uuid.uuid4().hex}"
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    n = pages.agg(F.max("page_id") + 1).first()[0]
    copies = pages.crossJoin(spark.range(factor).withColumnRenamed("id", "copy")).select(
        (F.col("page_id") + F.col("copy") * n).alias("page_id"), F.concat("url", F.lit("-"), "copy").alias("url"), "html"
    )
    copies.repartition(4 * int(cpus)).write.parquet(f"{base}/pages.parquet")
    times: dict[str, float] = {}

    def timed(name, make):
        start = time.perf_counter()  # operators keep tables while a plan is made, so that counts as well
        make().write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 2)

    start = time.perf_counter()
    links = fx.links(spark, base)
    times["build_links"] = round(time.perf_counter() - start, 2)
    timed("dedup_execute", lambda: dedup.dedup_execute(links))
    timed("search_components", lambda: search.search_links(links, "host:example path:docs guide"))
    timed("edit_distance_clusters", lambda: similarity.edit_distance_clusters(links, order="binary"))
    timed("filter_similar_execute", lambda: transitions.filter_similar_execute(links))
    timed("filter_similar_three_layers", lambda: transitions.filter_similar_execute(links, [Layer("path_prefix"), Layer("edit_distance", order="binary"), Layer("domain")]))
    lines = fx.long_lines(spark, base)
    stored = f"{base}/lines"
    lines.orderBy("filename", "pos").write.parquet(stored)
    lines = spark.read.parquet(stored)
    start = time.perf_counter()
    profile, scan = formats.read_formats(lines)
    times["read_formats_long"] = round(time.perf_counter() - start, 2)
    timed("extract_links_long", lambda: formats.extract_links(lines, profile, scan=scan))
    timed("content_hashes_long", lambda: files.content_hashes(lines))
    size = lines.agg(F.sum(F.length("line") + 1)).first()[0]
    print(json.dumps({"factor": factor, "links": links.count(), "long_document_chars": size, "cpus": int(cpus), "seconds": times}))
    spark.stop()


if __name__ == "__main__":
    main(int(sys.argv[1]) if len(sys.argv) > 1 else 100)
