"""Comparison of results."""


def same_rows(a, b):
    """Equal columns and equal rows in any order; whole numbers equal their doubles."""

    def rows(df):
        cols = sorted(df.columns)
        df = df[cols].astype(object)
        df = df.where(df.notna(), None)
        return sorted((tuple(float(x) if isinstance(x, (int, float)) and not isinstance(x, bool) else x for x in r) for r in df.itertuples(index=False)), key=repr)

    assert sorted(a.columns) == sorted(b.columns)
    assert rows(a) == rows(b)
