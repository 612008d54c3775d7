"""Times of test events, as days after a fixed start."""

from __future__ import annotations

import datetime as dt

START = dt.datetime(2020, 1, 1)


def day(n: float) -> dt.datetime:
    return START + dt.timedelta(days=n)
