"""Runs a query and its SQL over the same tables and compares all rows."""

import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def canonical(rows, columns):
    order = sorted(columns)

    def plain(v):
        return round(v, 6) if isinstance(v, float) else v

    return sorted((tuple(plain(r[c]) for c in order) for r in rows), key=repr)


def same(frame, sql, sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        if os.path.exists(f"{sf_dir}/{t}.parquet"):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    want = canonical([dict(zip(names, r, strict=True)) for r in cur.fetchall()], names)
    assert sorted(frame.columns) == sorted(names)
    got = canonical([r.asDict() for r in frame.collect()], frame.columns)
    assert len(got) == len(want)
    assert got == want
