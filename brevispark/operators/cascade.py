"""Changes that reach dependent tables: a graph of tables with keys, and the propagation of changed keys through it."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Link:
    """A child's columns that hold a parent's key, in the order of that key."""

    child: str
    parent: str
    columns: tuple[str, ...]


class Dependencies:
    """keys: the key columns of each table. links: which table depends on which; there must be no circle."""

    def __init__(self, keys: Mapping[str, Sequence[str]], links: Sequence[Link]):
        self.keys, self.links = {t: tuple(k) for t, k in keys.items()}, tuple(links)
        for x in self.links:
            if not {x.child, x.parent} <= self.keys.keys() or len(x.columns) != len(self.keys[x.parent]):
                raise ValueError(f"{x} does not fit the keys")
        self.order: list[str] = []
        open_ = dict.fromkeys(self.keys)
        while open_:
            free = [t for t in open_ if not any(x.child == t and x.parent in open_ and x.parent != t for x in self.links)]
            if not free or any(x.child == x.parent for x in self.links):
                raise ValueError("tables that depend on each other in a circle: " + ", ".join(open_))
            self.order += free
            for t in free:
                del open_[t]

    def below(self, table: str) -> list[str]:
        """All tables that depend on a table, parents first."""
        reached = {table}
        for t in self.order:
            if any(x.child == t and x.parent in reached for x in self.links):
                reached.add(t)
        return [t for t in self.order if t in reached and t != table]

    def stale(self, tables: Mapping[str, DataFrame], changed: Mapping[str, DataFrame]) -> dict[str, DataFrame]:
        """Keys of the rows that must go, by table: those of `changed` (keys of rows that were changed or deleted; a null in a key matches
        nothing, as in SQL), and those of all rows that depend on one, on any way, once each. Tables that are not given are empty."""
        out: dict[str, DataFrame] = {}
        for t in self.order:
            key = self.keys[t]
            found = [changed[t].select(*key)] if t in changed else []
            for x in self.links:
                if x.child == t and x.parent in out and t in tables:
                    found.append(_matched(tables[t], out[x.parent], x.columns, "left_semi").select(*key))
            if found:
                out[t] = reduce(DataFrame.unionByName, found).distinct()
        return out

    def surviving(self, tables: Mapping[str, DataFrame], changed: Mapping[str, DataFrame], kept: Sequence[str] = ()) -> dict[str, DataFrame]:
        """The tables without what has become stale: rows with a key in `changed`, but in the tables of `kept` (whose changed rows were
        replaced already), and rows that depend on a stale one."""
        stale, out = self.stale(tables, changed), {}
        for t, rows in tables.items():
            if t in changed and t not in kept:
                rows = _matched(rows, changed[t].select(*self.keys[t]).distinct(), self.keys[t], "left_anti")
            for x in self.links:
                if x.child == t and x.parent in stale:
                    rows = _matched(rows, stale[x.parent], x.columns, "left_anti")
            out[t] = rows
        return out


def _matched(rows: DataFrame, keys: DataFrame, columns: Sequence[str], how: str) -> DataFrame:
    renamed = keys.toDF(*[f"_{c}" for c in columns])
    same = reduce(lambda a, b: a & b, [rows[c] == renamed[f"_{c}"] for c in columns])
    return rows.join(renamed, same, how)


def changed_keys(new: DataFrame, old: DataFrame, key: Sequence[str], mark: str) -> DataFrame:
    """Keys that old has with another mark than new, or that new has no more."""
    now = new.select(*key, F.col(mark).alias("_now"))
    both = old.select(*key, F.col(mark).alias("_was")).join(now, list(key), "left")
    return both.where(~F.col("_was").eqNullSafe(F.col("_now"))).select(*key).distinct()
