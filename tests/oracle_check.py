"""Compares queries with their SQL on a scale factor: python -m tests.oracle_check sf0.01 [name ...]"""

import sys
import time

import duckdb
from pyspark.sql import SparkSession

import __spark_entry__ as entry
from tests.compare_rows import compare, views

if __name__ == "__main__":
    sf = f"/root/testdata/{sys.argv[1]}"
    spark = SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false").config("spark.driver.memory", "6g").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    con = duckdb.connect()
    views(con, sf)
    sql = entry.oracle_sql()
    for name, fn in entry.queries().items():
        if sys.argv[2:] and name not in sys.argv[2:] or name not in sql:
            continue
        t = time.time()
        try:
            print(name, compare(fn(spark, sf), con.execute(sql[name])), round(time.time() - t, 1), flush=True)
        except Exception as e:
            print(name, "ERROR", str(e)[:1200], flush=True)
