"""How a query is registered: its DataFrame, the same result in SQL, and the columns that both give."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]


@dataclass
class Registry:
    """Queries by name. Doubles are rounded alike on both sides, as sums are added up in another order."""

    ctes: dict[str, str] = field(default_factory=dict)
    queries: dict[str, Query] = field(default_factory=dict)
    sql: dict[str, str] = field(default_factory=dict)

    #: Frames that the last query keeps in memory or on disk, and how many queries are being made inside one another.
    held: list[DataFrame] = field(default_factory=list)
    depth: int = 0

    def keep(self, df: DataFrame) -> DataFrame:
        """`df`, kept until the next query is asked for; its results stay right after that, as they can be made again."""
        self.held.append(df.persist())
        return df

    def cte(self, name: str, body: str) -> None:
        self.ctes[name] = body

    def add(self, name: str, keys: str, doubles: str, query: Query, sql: str | None, digits: int = 8) -> None:
        own, values = keys.split(), doubles.split()

        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            if not self.depth:
                self._release()
            self.depth += 1
            try:
                rows = query(spark, sf_dir)
            finally:
                self.depth -= 1
            return rows.select(*own, *[(F.round(F.col(c).cast("double"), digits) + 0.0).alias(c) for c in values])

        self.queries[name] = run
        if sql is not None:
            used = self._needed(sql)
            head = "WITH RECURSIVE " + ",\n".join(f"{n} AS ({self.ctes[n]})" for n in used) + "\n" if used else ""
            columns = ", ".join([*(f'"{c}"' for c in own), *(f"round(CAST({c} AS DOUBLE), {digits}) + 0.0 AS {c}" for c in values)])
            self.sql[name] = f"{head}SELECT {columns} FROM ({sql}) AS result"

    def _release(self) -> None:
        for df in self.held:
            if df.sparkSession.sparkContext._jsc is not None:  # its session hasn't been stopped
                df.unpersist()
        self.held.clear()

    def _needed(self, sql: str) -> list[str]:
        """The common table expressions that `sql` names, and those that they name, in the order of their definition."""
        import re

        wanted, todo = set(), [sql]
        while todo:
            words = set(re.findall(r"\w+", todo.pop()))
            new = (words & set(self.ctes)) - wanted
            wanted |= new
            todo += [self.ctes[n] for n in new]
        return [n for n in self.ctes if n in wanted]
