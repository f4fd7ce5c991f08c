"""Hits of a filter that many requirements ask for are dealt to several tasks, and every one is there."""

from pyspark.sql import functions as F

from tradeloom.operators import search_index


def test_a_common_filter_is_dealt_to_many_tasks(spark):
    n, hits = 40, 1500
    r = spark.createDataFrame([(i, "steel", None, None) for i in range(n)] + [(n, "glass", None, None)], "requirement_id bigint, term string, country string, city string")
    c = spark.createDataFrame([(i, f"c{i:05}", "Steel", "India", "Pune", "active") for i in range(hits)], "company_id bigint, name string, industry string, country string, city string, status string")
    conf = {"spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.shuffle.partitions": "16"}
    was = {k: spark.conf.get(k, None) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        rows = search_index.term_search(r, c, page=None).withColumn("task", F.spark_partition_id()).collect()
    finally:
        for k, v in was.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    assert sorted((x.requirement_id, x.place, x.company_id) for x in rows) == [(i, j + 1, j) for i in range(n) for j in range(hits)]
    assert {(x.matched_on, x.total, x.pages) for x in rows} == {("term", hits, 75)}
    tasks = [x.task for x in rows]
    assert len(set(tasks)) >= 3 and max(map(tasks.count, set(tasks))) <= len(rows) * 0.6
