"""Reading results and plans."""

from __future__ import annotations


def tuples(df, *columns):
    """All rows as sorted tuples, of the given columns."""
    chosen = df.select(*columns) if columns else df
    return sorted((tuple(r) for r in chosen.collect()), key=lambda row: [(v is None, str(v)) for v in row])


def by(df, *keys):
    """Rows as dicts under their key."""
    found = {}
    for row in df.collect():
        key = tuple(row[k] for k in keys)
        found[key[0] if len(keys) == 1 else key] = row.asDict(recursive=True)
    return found


def plan(df, run: bool = False) -> str:
    """The physical plan as text; after ``run`` the one that adaptive execution ended with."""
    if run:
        df.collect()
    return df._jdf.queryExecution().executedPlan().toString()
