"""Comparing result frames."""


def same(left, right, digits=6):
    """Whether two pandas frames hold the same rows in any order, with equal column names."""
    if sorted(left.columns) != sorted(right.columns) or len(left) != len(right):
        return False

    def plain(frame):
        frame = frame[sorted(frame.columns)].copy()
        for c in frame:
            kind = str(frame[c].dtype)
            frame[c] = frame[c].astype(float).round(digits) + 0.0 if kind.lower().startswith("float") else frame[c].astype(str)
        return frame.sort_values(list(frame.columns)).reset_index(drop=True)

    a, b = plain(left), plain(right)
    return all((a[c].astype(str) == b[c].astype(str)).all() for c in a)
