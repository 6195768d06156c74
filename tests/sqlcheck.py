"""Comparison of a query with its SQL twin."""

SF = "/root/testdata/sf0.001"


def rows_of(frame):
    """Sorted rows as text, columns by name."""
    columns = sorted(frame.columns)
    return columns, sorted(tuple(str(x.tolist() if hasattr(x, "tolist") else x) for x in r) for r in frame[columns].itertuples(index=False))


def check_against_sql(spark, duck, name, query, sql):
    got, expected = query(spark, SF).toPandas(), duck.execute(sql).fetchdf()
    assert rows_of(got) == rows_of(expected), name
