"""Compare a registered query with its SQL on the same tables."""

import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connection(sf_dir):
    c = duckdb.connect()
    for t in TABLES:
        if os.path.exists(f"{sf_dir}/{t}.parquet"):
            c.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return c


def rows_of(spark_df):
    names = sorted(spark_df.columns)
    return names, sorted((tuple(map(str, r)) for r in spark_df.select(names).collect()))


def rows_of_sql(c, sql):
    cursor = c.execute(sql)
    names = [d[0] for d in cursor.description]
    order = sorted(range(len(names)), key=names.__getitem__)
    return [names[i] for i in order], sorted(tuple(str(r[i]) for i in order) for r in cursor.fetchall())
