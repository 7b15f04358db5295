"""Folds that streams of the tests run in workers."""

from fathomgrid.streaming import ordered


class Counted(ordered.Smooth):
    """Fails if more rows than a slot holds are folded at once, or out of order."""

    def __init__(self, share, most):
        super().__init__(share)
        self.most = most

    def folded(self, saved, rows):
        import resource

        assert len(rows) <= self.most and rows["t"].is_monotonic_increasing
        assert resource.getrusage(resource.RUSAGE_SELF).ru_maxrss < 700_000  # kilobytes
        return super().folded(saved, rows)
