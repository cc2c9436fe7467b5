"""Helpers the tests share."""


def rows(df, *cols):
    """Collect ``cols`` (default: all) as a list of tuples in row order."""
    sel = df.select(*cols) if cols else df
    return [tuple(r) for r in sel.collect()]
