from pyspark.sql import functions as F

from hrefmill.functions.urls import with_url_parts
from hrefmill.operators.ingest import build_link_rows
from hrefmill.storage import cut_lineage


def make_links(spark, urls, strategy="normalized"):
    """Link rows in the given order, ids named by position."""
    rows = [(i, u) for i, u in enumerate(urls)]
    df = spark.createDataFrame(rows, "seq long, url string").selectExpr(
        "*", "'TXT' AS type", f"'{strategy}' AS strategy", "'f.txt' AS source_file", "seq AS source_order", "'' AS title"
    )
    built = build_link_rows(with_url_parts(df, "url"), F.timestamp_seconds(F.col("seq") + 1704067200))
    # Operators work on stored links, so the rows are materialised as a table would be.
    return cut_lineage(built.withColumn("id", F.concat(F.lit("L"), F.col("seq"))))
