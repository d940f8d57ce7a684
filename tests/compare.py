"""Comparison of DataFrames with DuckDB results."""

from __future__ import annotations

import math


def canonical(rows):
    """Rows as comparable tuples; whole floats equal integers and null equals NaN."""

    def one(v):
        if v is None or (isinstance(v, float) and math.isnan(v)):
            return "null"
        if isinstance(v, bool):
            return str(v)
        if isinstance(v, (int, float)):
            return f"{float(v):.12g}"
        return str(v)

    return sorted(tuple(one(v) for v in row) for row in rows)


def same_as_sql(df, con, sql):
    """Asserts that a DataFrame and a DuckDB query have equal columns and rows."""
    names = sorted(df.columns)
    got = canonical(df.select(*[f"`{n}`" for n in names]).collect())
    made = con.execute(sql)
    assert sorted(d[0] for d in made.description) == names
    at = [[d[0] for d in made.description].index(n) for n in names]
    want = canonical([[row[i] for i in at] for row in made.fetchall()])
    assert len(got) == len(want)
    assert got == want, [x for x in zip(got, want, strict=True) if x[0] != x[1]][:3]
