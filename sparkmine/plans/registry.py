"""Where plans register: name -> callable, and name -> SQL twin."""

from collections.abc import Callable

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable:
    def add(f: Callable) -> Callable:
        QUERIES[name] = f
        if sql is not None:
            ORACLE[name] = sql
        return f

    return add
