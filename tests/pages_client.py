"""A client of two resources' pages, for tests: a token is the number of the next page. It may be called in tasks only."""

from pyspark import TaskContext

PAGES = {"a": [[("a", 1)], [("a", 2), ("a", 3)], []], "b": [[("b", 9)]]}
MANY = 2500


def read(resource, token):
    assert TaskContext.get() is not None
    at = int(token or 0)
    return PAGES[resource][at], str(at + 1) if at + 1 < len(PAGES[resource]) else None


def many(resource, token):
    """MANY pages of two rows for each resource."""
    assert TaskContext.get() is not None
    at = int(token or 0)
    return [(resource, 2 * at), (resource, 2 * at + 1)], str(at + 1) if at + 1 < MANY else None


def window(stream, start, end, closed):
    """A row a minute, with the window that it came by."""
    from datetime import datetime, timedelta

    out, t = [], datetime(2024, 1, 1)
    while t <= end:
        if start <= t < end or closed and t == end:
            out.append((stream, t, start.isoformat()))
        t += timedelta(minutes=1)
    return out
