"""Rows of a Spark query and of its SQL as comparable lists."""

import datetime
import math


def norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else (0.0 if v == 0 else v)
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None)
    if isinstance(v, (list, tuple)):
        return tuple(norm(x) for x in v)
    return v


def rows(columns, values):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(repr(tuple(norm(r[i]) for i in order)) for r in values)


def same(spark, sf, duck, query, sql):
    df = query(spark, sf)
    cur = duck.execute(sql)
    names = [c[0] for c in cur.description]
    assert sorted(names) == sorted(df.columns)
    assert rows(df.columns, df.collect()) == rows(names, cur.fetchall())
