"""Queries by name, and the SQL that says the same for DuckDB."""
QUERIES: dict = {}
ORACLES: dict = {}


def query(sql: str | None = None):
    """Registers f(spark, sf_dir) under its own name, with its SQL if SQL can say it."""

    def add(f):
        if f.__name__ in QUERIES:
            raise ValueError(f"there is a query {f.__name__} already")
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add
