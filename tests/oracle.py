"""Runs catalogue queries next to their SQL and compares the rows."""

import math
import sys
import time

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(folder):
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return connection


def plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 9)
    return value


def rows_of(names, rows):
    order = sorted(range(len(names)), key=names.__getitem__)
    return sorted(
        (tuple(plain(row[i]) for i in order) for row in rows),
        key=lambda row: tuple((v is not None, str(v)) for v in row),
    )


def compare(spark, connection, folder, name, query, sql):
    frame = query(spark, folder)
    got = rows_of(frame.columns, frame.collect())
    answer = connection.execute(sql)
    names = [column[0] for column in answer.description]
    want = rows_of(names, answer.fetchall())
    assert sorted(frame.columns) == sorted(names), (name, frame.columns, names)
    assert len(got) == len(want), (name, len(got), len(want))
    for mine, theirs in zip(got, want):
        assert mine == theirs, (name, sorted(names), mine, theirs)
    return len(got)


if __name__ == "__main__":
    from pyspark.sql import SparkSession

    import __spark_entry__ as entry

    folder, wanted = sys.argv[1], sys.argv[2:]
    spark = (
        SparkSession.builder.master("local[8]").config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", "8").config("spark.driver.memory", "16g").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    connection, queries, oracle = connect(folder), entry.queries(), entry.oracle_sql()
    for name in wanted or queries:
        start = time.time()
        try:
            if name in oracle:
                outcome = compare(spark, connection, folder, name, queries[name], oracle[name])
            else:
                outcome = f"{queries[name](spark, folder).count()} (rows only)"
        except Exception as error:  # report and go on with the next query
            outcome = "FAILED " + str(error)[:600].replace("\n", " ")
        print(f"@@ {name}: {outcome} {time.time() - start:.1f}s", flush=True)
