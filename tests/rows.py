"""Comparison of result tables."""


def same_rows(a, b) -> str:
    """Empty if two pandas frames hold the same rows in any order, else what differs."""
    names = sorted(a.columns)
    if names != sorted(b.columns):
        return f"columns {names} and {sorted(b.columns)}"
    if len(a) != len(b):
        return f"{len(a)} and {len(b)} rows"
    x, y = (f[names].sort_values(names, ignore_index=True) for f in (a, b))
    for c in names:
        for p, q in zip(x[c], y[c], strict=True):
            if not (p == q or (p != p and q != q) or (p is None and q is None)):
                return f"{c}: {p!r} and {q!r}"
    return ""
