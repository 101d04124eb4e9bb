"""Spark rows against DuckDB rows, as the driver compares them: by column name, in any order."""

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def shown(value):
    if value is None or (isinstance(value, float) and value != value):
        return "NULL"
    if hasattr(value, "__len__") and not isinstance(value, (str, bytes)):
        return str([shown(x) for x in value])
    return repr(float(value)) if isinstance(value, float) else str(value)


def rows(frame):
    frame = frame.reindex(sorted(frame.columns), axis=1).astype(object)
    return sorted(tuple(map(shown, r)) for r in frame.itertuples(index=False, name=None))


def oracle(sf_dir, sql):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return c.execute(sql).fetchdf()
