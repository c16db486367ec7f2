"""A cache for pure functions that travels to executors with its function's code."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps


def memo(most: int) -> Callable[[Callable], Callable]:
    """Remembers results by the positional arguments; forgets all once there are ``most``. Failures are not kept."""

    def around(f: Callable) -> Callable:
        known: dict = {}

        @wraps(f)
        def cached(*args):
            if args not in known:
                if len(known) >= most:
                    known.clear()
                known[args] = f(*args)
            return known[args]

        return cached

    return around
