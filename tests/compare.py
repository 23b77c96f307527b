"""Order-insensitive comparison of a Spark result with DuckDB's."""


def _plain(v):
    if isinstance(v, float):
        return round(v, 6) + 0.0
    if isinstance(v, (list, tuple)):
        return tuple(map(_plain, v))
    return v


def rows(columns, records):
    order = [columns.index(c) for c in sorted(columns)]
    return sorted((tuple(_plain(r[i]) for i in order) for r in records), key=repr)


def same(df, con, sql):
    got = con.execute(sql)
    names = [d[0] for d in got.description]
    assert sorted(names) == sorted(df.columns)
    assert rows(df.columns, [tuple(r) for r in df.collect()]) == rows(names, got.fetchall())
