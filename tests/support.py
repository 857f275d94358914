"""Comparing a query's rows with those of SQL."""

import datetime
import math


def cell(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return None
    if hasattr(v, "isoformat"):
        return v.isoformat()[:10] if isinstance(v, datetime.date) and not isinstance(v, datetime.datetime) else v.isoformat()
    if isinstance(v, bool):
        return v
    if isinstance(v, (int, float)) or type(v).__name__ == "Decimal":
        return round(float(v), 6)
    return str(v)


def rows_of(df):
    names = sorted(df.columns)
    return names, sorted((tuple(cell(r[n]) for n in names) for r in df.collect()), key=repr)


def rows_of_sql(duck, sql):
    cur = duck.execute(sql)
    names = [d[0] for d in cur.description]
    order = sorted(names)
    at = [names.index(n) for n in order]
    return order, sorted((tuple(cell(r[i]) for i in at) for r in cur.fetchall()), key=repr)
