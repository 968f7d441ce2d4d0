"""Copies of tables into a database, all or nothing, with the rows it refuses written down beside it."""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Callable, Iterator
from contextlib import closing
from dataclasses import dataclass
from itertools import batched
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import StructType


#: The attempt of the one row that says that a run has ended.
ENDED = "ended"


@dataclass
class _Staged(WriterCommitMessage):
    attempt: str


@dataclass
class Target:
    """A table of a database reached by DB-API connections.

    ``connect`` gives a connection outside autocommit, on any machine. ``staging`` and ``rejected`` exist: the first has the table's columns and constraints, but
    not its keys, and ``run``, ``attempt``; the second ``run, attempt, row_key, row_json, error``, all texts, and a row of attempt ``ended`` for each run. ``row_errors``: what a driver raises
    for a row that does not fit, by class name; any other error, a lost connection say, fails the task, which Spark tries again.
    """

    connect: Callable[[], Any]
    table: str
    key: str
    columns: list[str]
    staging: str
    rejected: str
    mark: str = "?"
    row_errors: tuple[str, ...] = ("IntegrityError", "DataError")

    def __post_init__(self):
        for name in (self.table, self.key, *self.columns, self.staging, self.rejected):
            if not re.fullmatch(r"\w+(\.\w+)?", name):
                raise ValueError(f"no plain name: {name!r}")

    def marks(self, n: int) -> str:
        return ", ".join([self.mark] * n)


def _stage(cursor: Any, target: Target, tags: tuple[str, str], rows: list[tuple]) -> Iterator[tuple[tuple, str]]:
    """Puts rows into the staging table and gives those that it refuses; a batch that fails is undone and halved."""
    names = ", ".join(["run", "attempt", *target.columns])
    cursor.execute("SAVEPOINT batch")
    try:
        cursor.executemany(f"INSERT INTO {target.staging} ({names}) VALUES ({target.marks(len(target.columns) + 2)})", [(*tags, *r) for r in rows])
    except Exception as e:
        if type(e).__name__ not in target.row_errors:
            raise
        cursor.execute("ROLLBACK TO SAVEPOINT batch")
        if len(rows) == 1:
            yield rows[0], f"{type(e).__name__}: {e}"
        else:
            yield from _stage(cursor, target, tags, rows[: len(rows) // 2])
            yield from _stage(cursor, target, tags, rows[len(rows) // 2 :])
    cursor.execute("RELEASE SAVEPOINT batch")


class _CopyWriter(DataSourceWriter):
    def __init__(self, target: Target, run: str, batch: int):
        self.target, self.run, self.batch = target, run, batch

    def write(self, iterator: Iterator) -> _Staged:
        target, tags = self.target, (self.run, uuid.uuid4().hex)
        place = target.columns.index(target.key)
        with closing(target.connect()) as connection:
            cursor = connection.cursor()
            for some in batched(iterator, self.batch):
                refused = [
                    (*tags, None if r[place] is None else str(r[place]), json.dumps(dict(zip(target.columns, r, strict=True)), default=str), why)
                    for r, why in _stage(cursor, target, tags, [tuple(r) for r in some])
                ]
                if refused:
                    cursor.executemany(f"INSERT INTO {target.rejected} (run, attempt, row_key, row_json, error) VALUES ({target.marks(5)})", refused)
            connection.commit()
            # A run that ended meanwhile has cleared what was there before its mark, so a task that sees the mark clears its own.
            cursor.execute(f"SELECT count(*) FROM {target.rejected} WHERE run = {target.mark} AND attempt = {target.mark}", (self.run, ENDED))
            if cursor.fetchone()[0]:
                for table in (target.staging, target.rejected):
                    cursor.execute(f"DELETE FROM {table} WHERE run = {target.mark} AND attempt = {target.mark}", tags)
                connection.commit()
                raise RuntimeError("the run has ended")
        return _Staged(tags[1])

    def _ended(self) -> None:
        target = self.target
        with closing(target.connect()) as connection:
            connection.cursor().execute(f"INSERT INTO {target.rejected} (run, attempt, row_key, row_json, error) VALUES ({target.marks(5)})", (self.run, ENDED, None, None, ENDED))
            connection.commit()

    def _cleared(self, cursor: Any, kept: list[str], tables: tuple[str, ...]) -> None:
        for table in tables:
            cursor.execute(f"SELECT DISTINCT attempt FROM {table} WHERE run = {self.target.mark}", (self.run,))
            for (attempt,) in cursor.fetchall():
                if attempt not in (*kept, ENDED):
                    cursor.execute(f"DELETE FROM {table} WHERE run = {self.target.mark} AND attempt = {self.target.mark}", (self.run, attempt))

    def commit(self, messages: list) -> None:
        """One transaction inside the database: staged rows of the tasks that count go to the table, those whose key it has do not."""
        target, kept = self.target, [m.attempt for m in messages if m is not None]
        names = ", ".join(target.columns)
        self._ended()
        with closing(target.connect()) as connection:
            cursor = connection.cursor()
            self._cleared(cursor, kept, (target.staging, target.rejected))
            cursor.execute(
                f"INSERT INTO {target.table} ({names}) SELECT {names} FROM {target.staging} WHERE run = {target.mark} ON CONFLICT ({target.key}) DO NOTHING", (self.run,)
            )
            cursor.execute(f"DELETE FROM {target.staging} WHERE run = {target.mark}", (self.run,))
            connection.commit()

    def abort(self, messages: list) -> None:
        self._ended()
        with closing(self.target.connect()) as connection:
            self._cleared(connection.cursor(), [], (self.target.staging, self.target.rejected))
            connection.commit()


def copy_rows(rows: DataFrame, target: Target, batch: int = 1_000) -> str:
    """[K7, K8] Copies the target's columns (null where the rows lack one) and gives the name of the run, under which refused rows are listed.

    Each task puts its rows into the staging table, in one transaction, batch by batch. When all have, rows whose key the table lacks
    move there at once; of rows with one key any one does, so leave one of each before. A failed job leaves nothing, a task that runs twice counts once.
    """
    run = uuid.uuid4().hex

    class Copy(DataSource):
        @classmethod
        def name(cls) -> str:
            return f"lantern_copy_{target.table.replace('.', '_')}"

        def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
            return _CopyWriter(target, run, batch)

    rows.sparkSession.dataSource.register(Copy)
    kept = rows.select(*(F.col(c) if c in rows.columns else F.lit(None).cast("string").alias(c) for c in target.columns))
    kept.write.format(Copy.name()).mode("append").save()
    return run
