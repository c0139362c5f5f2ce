"""Row-for-row comparison of a registered query with its SQL in DuckDB."""

from __future__ import annotations

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()
SAME_TYPE = {
    "string": "VARCHAR", "bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "boolean": "BOOLEAN",
}


def connect(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def differences(df, con, sql: str) -> list[str]:
    """What differs: columns, types, row counts or the first unequal row."""
    names = sorted(df.columns)
    got = df.select(*names).collect()
    asked = con.execute(sql)
    described = {d[0]: str(d[1]) for d in asked.description}
    if sorted(described) != names:
        return [f"columns {names} against {sorted(described)}"]
    at = [[d[0] for d in asked.description].index(n) for n in names]
    want = [tuple(row[i] for i in at) for row in asked.fetchall()]
    out = []
    types = dict(df.dtypes)
    for n in names:
        if SAME_TYPE.get(types[n]) != described[n]:
            out.append(f"type of {n}: {types[n]} against {described[n]}")
    if len(got) != len(want):
        out.append(f"{len(got)} rows against {len(want)}")
    left, right = sorted(repr(tuple(r)) for r in got), sorted(repr(r) for r in want)
    if left != right:
        extra, lacking = set(left) - set(right), set(right) - set(left)
        out.append(f"only here {sorted(extra)[:2]} only there {sorted(lacking)[:2]}")
    return out
