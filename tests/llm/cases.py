"""Fixtures and brute-force versions for the tests of this folder."""

import random

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Columns that clash with names used inside the operators.
CLASHING = ("doc", "member", "key", "n", "copies", "draws", "cdf", "arrival", "block", "digest", "gone")


def words(rng, n, vocabulary=400):
    return [f"w{rng.randrange(vocabulary)}" for _ in range(n)]


def documents(seed=1):
    """Copies, near copies, shared passages, blanks of all kinds, nulls, empty, short and long texts, repeated rows."""
    rng = random.Random(seed)
    passage = words(rng, 30)
    rows = []
    for i in range(40):
        t = words(rng, rng.choice((3, 12, 60, 140)))
        if i % 4 == 0:
            at = rng.randrange(len(t) + 1)
            t = t[:at] + passage + t[at:]
        rows.append((i, " ".join(t)))
    long = words(rng, 20000, 5000)
    rows += [(40, " ".join(long)), (41, " ".join(long[:19990] + ["x"] * 10))]
    base = words(rng, 200)
    for i in range(42, 54):  # a chain of near copies
        base = base[:]
        base[rng.randrange(200)] = f"new{i}"
        rows.append((i, " ".join(base).upper() if i % 2 else " ".join(base)))
    copy = " ".join(words(rng, 50))
    rows += [(i, copy) for i in range(54, 60)] + [(60, copy.replace(" ", " \t\n")), (61, copy + " \x0b\x0c\r")]
    rows += [(62, None), (63, ""), (64, " \t "), (65, "one two three"), (66, "one  two\nthree"), (67, "a b  c"), (68, "é" * 30), (69, "one two three")]
    rows += [(70, " ".join(passage * 3)), (71, " ".join(passage * 3))]
    return [(i, t, None if i % 9 == 0 else ("en", "fr")[i % 2], None if i == 5 else f"s{i % 3}", None if t is None else len(t)) for i, t in rows]


def frame(spark, rows=None, clash=False, parts=3):
    from pyspark.sql import functions as F

    df = spark.createDataFrame(documents() if rows is None else rows, SCHEMA).repartition(parts)
    return df.select("*", *(F.lit(7).alias(c) for c in CLASHING)) if clash else df


def sql(query, tmp_path, **tables):
    con = duckdb.connect()
    for name, (rows, schema) in tables.items():
        cols = list(zip(*rows, strict=True)) if rows else [[] for _ in schema]
        path = tmp_path / f"{name}.parquet"
        pq.write_table(pa.table({f.name: pa.array(c, f.type) for f, c in zip(schema, cols, strict=True)}), path)
        con.execute(f"CREATE VIEW {name} AS FROM '{path}'").fetchall()
    r = con.execute(query)
    names = [c[0] for c in r.description]
    return sorted((dict(zip(names, x, strict=True)) for x in r.fetchall()), key=repr_sorted)


DOCUMENTS = pa.schema([("doc_id", pa.int64()), ("text", pa.string()), ("lang", pa.string()), ("source", pa.string()), ("n_chars", pa.int64())])


def repr_sorted(d):
    return repr(sorted(d.items()))


def rows_of(df):
    return sorted((r.asDict() for r in df.collect()), key=repr_sorted)


def components(nodes, edges):
    up = {n: n for n in nodes}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}
