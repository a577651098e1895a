"""Run registered queries next to their SQL and compare whole results.

usage: python tests/oracle_check.py [sf directory] [query ...]
"""

import os
import sys
import time
from collections import Counter

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages"
    " benchmark labels conversations"
).split()


def connect(sf_dir):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return con


def compare(spark, con, sf_dir, query, sql):
    """None when both results hold the same rows, else what differs."""
    df = query(spark, sf_dir)
    names = sorted(df.columns)
    result = con.execute(sql)
    theirs = [d[0] for d in result.description]
    if sorted(theirs) != names:
        return f"columns {names} against {sorted(theirs)}"
    order = [theirs.index(n) for n in names]
    want = Counter(tuple(row[i] for i in order) for row in result.fetchall())
    got = Counter(tuple(row) for row in df.select(names).collect())
    if got == want:
        return None
    extra, missing = got - want, want - got
    return (
        f"{sum(got.values())} rows against {sum(want.values())};"
        f" only here {list(extra)[:2]}; only in SQL {list(missing)[:2]}"
    )


def main():
    here = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    sys.path.insert(0, here)
    from pyspark.sql import SparkSession

    import __spark_entry__ as entry

    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("OFF")
    con = connect(sf_dir)
    sql = entry.oracle_sql()
    for name, query in entry.queries().items():
        if sys.argv[2:] and name not in sys.argv[2:]:
            continue
        start = time.time()
        try:
            if name in sql:
                problem = compare(spark, con, sf_dir, query, sql[name])
            else:
                problem = f"no SQL; {query(spark, sf_dir).count()} rows"
        except Exception as error:  # report and go on with the next query
            problem = f"{type(error).__name__}: {str(error)[:600]}"
        print(f"{name}: {problem or 'same'} ({time.time() - start:.1f}s)", flush=True)


if __name__ == "__main__":
    main()
