"""Rows of two engines as sorted tuples of text, columns by name."""

import decimal
import math


def norm(v):
    if v is None:
        return "NULL"
    if isinstance(v, (float, decimal.Decimal)) and not isinstance(v, bool):
        v = float(v)
        return "NaN" if math.isnan(v) else f"{v:.6g}" if v else "0"
    return str(v)


def of_spark(df):
    names = sorted(df.columns)
    return names, sorted(tuple(norm(r[c]) for c in names) for r in df.collect())


def of_duck(con, sql):
    cur = con.execute(sql)
    names = [x[0] for x in cur.description]
    order = sorted(range(len(names)), key=names.__getitem__)
    return sorted(names), sorted(tuple(norm(r[i]) for i in order) for r in cur.fetchall())
