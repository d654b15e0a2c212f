"""The page lookup: what counts as a fetched page, and URLs that very many messages link to."""

from pyspark.sql import functions as F

from sifter.operators import extract as X
from sifter.operators.skew import salted_join


def test_status_and_content_type(spark):
    ok = "<body>text</body>"
    rows = [(1, "u1", ok, 200, "text/html"), (2, "u2", ok, 404, "text/html"), (3, "u3", ok, 200, "application/pdf"), (4, "u4", ok, None, None),
            (5, "u5", ok, 299, "application/xhtml+xml"), (6, "u6", ok, 301, "text/html"), (7, "u7", ok, 200, "TEXT/HTML"),
            (8, "u8", "<body>error</body>", 500, "text/html"), (9, "u8", ok, 200, "text/html")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, status int, content_type string")
    links = spark.createDataFrame([(f"m{i}", f"u{i}") for i in range(10)] + [("none", None)], "id string, link_url string")
    got = {r.id: r.article for r in X.lookup_page(links, pages).collect()}
    assert got == {f"m{i}": "text" if i in (1, 5, 8) else "" for i in range(10)}
    # a table without these columns holds pages that were fetched
    got = {r.id: r.article for r in X.lookup_page(links, pages.drop("status", "content_type").where("page_id <> 8")).collect()}
    assert got == {f"m{i}": "text" if 1 <= i <= 8 else "" for i in range(10)}


def test_hot_url_is_dealt_over_tasks(spark):
    """A URL on a third of all mail: same rows as a plain join, and no task has them all."""
    n, limit = 30_000, 1000
    links = spark.range(n).select(F.col("id").cast("string").alias("id"), F.when(F.col("id") % 3 == 0, "hot").otherwise(
        F.concat(F.lit("u"), F.col("id") % 5000)).alias("link_url"))
    pages = spark.range(5000).select(F.concat(F.lit("u"), "id").alias("link_url"), F.lit("page").alias("article")).unionByName(
        spark.createDataFrame([("hot", "hot page")], "link_url string, article string"))
    conf = {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.shuffle.partitions": "40"}
    before = {k: spark.conf.get(k) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        joined = salted_join(links, pages, "link_url", "id", limit)
        most = joined.groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0]
        plain = links.join(pages, "link_url", "left")
        assert plain.groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0] >= n / 3
        assert most <= 4 * limit
        assert joined.exceptAll(plain.select(joined.columns)).count() == 0 and joined.count() == n
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
