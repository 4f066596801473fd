import os

import numpy as np
from pyspark.sql import functions as F

from parchmint.llm import chunks as C
from parchmint.llm import common


def test_bucket_numbers_are_those_of_spark(spark):
    ids = np.random.default_rng(0).integers(0, 1 << 62, 200)
    df = spark.createDataFrame([(int(i),) for i in ids], "id long").select("id", F.expr("pmod(hash(id), 7)").alias("b"))
    want = {r.id: r.b for r in df.collect()}
    assert C.bucket_numbers(ids, 7).tolist() == [want[i] for i in ids.tolist()]
    assert all(C.bucket_numbers(np.array([C.new_id(b, 7)]), 7)[0] == b for b in range(7))


def test_a_task_writes_few_files_and_all_buckets_are_filled(spark, docs):
    rows = [(i, "text " * 20) for i in range(640)]
    for tasks in (2, 16):
        df = C.chunked(docs(rows).repartition(tasks), 300)
        where = common._written[-1][0].removeprefix("file://")
        assert sum(f.endswith(".parquet") for f in os.listdir(where)) <= max(4, tasks)
        assert df.select(F.expr("pmod(hash(chunk), 4)").alias("b")).distinct().count() == 4
        assert sorted(r.d for r in df.select(F.explode("doc_ids").alias("d")).collect()) == list(range(640))


def test_scope_removes_its_tables(spark, docs):
    with common.scratch(spark):
        name = C.chunked(docs([(1, "a")])) and common._written[-1][1]
        assert spark.catalog.tableExists(name)
    assert not spark.catalog.tableExists(name)
