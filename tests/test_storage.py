"""Scratch tables: blocks of several threads, kept tables and the end of a session."""

import os
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import functions as F

from leadmill import storage


def _there(table):
    return os.path.exists(storage._PATHS[table].removeprefix("file://"))


def test_blocks_of_two_threads_do_not_delete_each_others_tables(spark):
    def work(n):
        with storage.scratch(spark) as made:
            tables = [storage.materialise(spark.range(10).withColumn("n", F.lit(n * 10 + i)), "t") for i in range(3)]
            made.keep(tables[0])
            assert all(t.select("n").distinct().first()[0] == n * 10 + i for i, t in enumerate(tables))
        return [_there(t) for t in tables], tables[0].agg(F.sum("n")).first()[0]

    with ThreadPoolExecutor(4) as pool:
        for n, (there, total) in enumerate(pool.map(work, range(8))):
            assert there == [True, False, False] and total == 100 * n


def test_a_kept_table_goes_to_the_outer_block_and_then_to_the_session(spark):
    with storage.scratch(spark) as outer:
        with storage.scratch(spark) as inner:
            a, b = (inner.keep(storage.materialise(spark.range(3), "t")) for _ in "ab")
        outer.keep(a)
        assert _there(a) and _there(b)
    assert _there(a) and not _there(b)
    assert storage._LEFT[storage._PATHS[a]] is spark
    storage.clear()
    assert not _there(a) and not storage._LEFT
