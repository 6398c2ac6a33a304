"""Holds a query's rows against those of its SQL."""

from collections import Counter


def plain(v):
    if isinstance(v, float):
        return None if v != v else round(v, 6)
    if isinstance(v, list | tuple):
        return str([plain(x) for x in v])
    return v if isinstance(v, int | str | bool | None) else str(v)


def rows_of(names, rows):
    return Counter(tuple(str(plain(v)) for v in r) for r in rows)


TYPES = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN", "timestamp_ntz": "TIMESTAMP", "float": "FLOAT"}


def check(query, sql, spark, duck, folder):
    df = query(spark, folder)
    names = sorted(df.columns)
    found = duck.sql(sql)
    assert sorted(found.columns) == names
    kinds = dict(zip(found.columns, map(str, found.types), strict=True))
    assert {f.name: TYPES.get(f.dataType.simpleString()) for f in df.schema} == kinds
    ours = rows_of(names, df.select(names).collect())
    theirs = rows_of(names, found.project(",".join(f'"{n}"' for n in names)).fetchall())
    assert ours == theirs, (list((ours - theirs))[:3], list((theirs - ours))[:3])
