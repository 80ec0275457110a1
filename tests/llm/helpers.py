"""Fixtures of hard cases and slow, plain versions of the operators."""

import duckdb

DATA = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row string, fp long, chunk long, slice int"


def rows(table):
    return duckdb.sql(f"SELECT * FROM '{DATA}/{table}.parquet'").fetchall()


def documents():
    return {r[0]: r[1] for r in duckdb.sql(f"SELECT doc_id, text FROM '{DATA}/documents.parquet'").fetchall()}


def frame(spark, pairs):
    """Documents with columns whose names clash with those that operators use inside."""
    return spark.createDataFrame([(i, t, None, None, None, "x", 1, 2, 3) for i, t in pairs], SCHEMA)


def hard():
    """Nulls, empty and white-space texts, ties, repeated rows, long texts and long words."""
    words = " ".join(f"w{i % 97}x{i % 31}" for i in range(3000))
    return [(1, None), (2, ""), (3, " \n\t "), (4, "one"), (5, "one"), (5, "one"), (None, "two words"), (6, words), (7, words), (8, "a" * 5000), (9, "Grüße 　 \x1c x\x00y \U0001f600"), (10, "A b C d " * 50), (None, None)]


def oracle(sql, at=DATA):
    db = duckdb.connect()
    for t in ("documents", "embeddings", "pages", "benchmark", "labels", "conversations"):
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{at}/{t}.parquet'")
    out = db.execute(sql)
    names = [d[0] for d in out.description]
    return names, out.fetchall()


def matches(df, sql):
    names, want = oracle(sql)
    got = [tuple(r) for r in df.select(*names).collect()]
    key = lambda r: tuple(str(x) for x in r)
    assert sorted(got, key=key) == sorted(want, key=key)
