"""Helpers the test modules share; the name is unique, so that no other ``conftest`` hides it."""


def rows(df, *cols):
    """Rows as a sorted list of tuples."""
    picked = df.select(*cols) if cols else df
    return sorted((tuple(r) for r in picked.collect()), key=repr)
