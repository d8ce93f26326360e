"""Comparison of results."""


def rows_of(frame) -> list[tuple]:
    """Rows of a pandas frame with sorted columns, as comparable strings."""
    import pandas as pd

    frame = frame[sorted(frame.columns)]
    text = lambda x: "" if not isinstance(x, (list, dict)) and pd.isna(x) else f"{x:.9g}" if isinstance(x, float) else str(x)
    return sorted(tuple(map(text, r)) for r in frame.itertuples(index=False))
