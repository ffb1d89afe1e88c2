"""A register of queries and their oracles."""

from __future__ import annotations

from collections.abc import Callable

from pathwise.adapter import over_views


class Plans:
    def __init__(self) -> None:
        self.queries: dict[str, Callable] = {}
        self.oracles: dict[str, str] = {}

    def add(self, name: str, oracle: str | None = None, views: bool = False):
        """Registers the decorated (spark, sf_dir) function; `views` puts the trajectory views in front of its oracle."""

        def keep(function: Callable) -> Callable:
            self.queries[name] = function
            if oracle is not None:
                self.oracles[name] = over_views(oracle) if views else oracle.strip()
            return function

        return keep
