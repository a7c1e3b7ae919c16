"""The Python database interface (PEP 249) over a session, in the process that runs Spark."""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from typing import Any

from pyspark.sql import SparkSession

from lodestone.operators.graph.language import GraphError
from lodestone.operators.text.bm25 import SearchError
from lodestone.plans.lexer import SqlError
from lodestone.session import Session

apilevel, threadsafety, paramstyle = "2.0", 1, "named"


class Error(Exception):
    """Whatever goes wrong; the cause is kept."""


class ProgrammingError(Error):
    """A statement that isn't right, or a cursor used out of turn."""


class OperationalError(Error):
    """A statement that failed as it ran, such as a commit that lost a race."""


def connect(spark: SparkSession, folder: str | None = None, autocommit: bool = False, session: Session | None = None) -> Connection:
    return Connection(session or Session(spark, folder), autocommit)


class Connection:
    """Without autocommit the first statement that changes rows opens a transaction, which commit() or rollback() ends."""

    def __init__(self, session: Session, autocommit: bool = False):
        self.session, self.autocommit, self.closed = session, autocommit, False

    def cursor(self) -> Cursor:
        self._open()
        return Cursor(self)

    def _open(self) -> None:
        if self.closed:
            raise ProgrammingError("the connection is closed")

    def _end(self, verb: str) -> None:
        self._open()
        if self.session.staged is not None:
            try:
                self.session.execute(verb)
            except RuntimeError as e:
                raise OperationalError(str(e)) from e

    def commit(self) -> None:
        self._end("COMMIT")

    def rollback(self) -> None:
        self._end("ROLLBACK")

    def close(self) -> None:
        if not self.closed:
            self._end("ROLLBACK")
            self.closed = True

    def __enter__(self) -> Connection:
        return self

    def __exit__(self, kind, *_) -> None:
        self.rollback() if kind else self.commit()
        self.close()


class Cursor:
    """Rows come to the driver partition by partition as they are fetched, never all at once unless fetchall() asks for them."""

    arraysize = 100

    def __init__(self, connection: Connection):
        self.connection, self.description, self.rowcount, self.closed = connection, None, -1, False
        self._rows: Iterator | None = None

    def execute(self, text: str, parameters: dict[str, Any] | None = None) -> Cursor:
        self._open()
        self.description, self.rowcount, self._rows = None, -1, None
        session = self.connection.session
        word = text.split(None, 1)[0].lower() if text.split() else ""
        begins = word in ("insert", "update", "delete", "cypher") and session.staged is None and session.store is not None
        try:
            if begins and not self.connection.autocommit:
                session.execute("BEGIN")
            results = session.execute(text, parameters)
        except (SqlError, GraphError, SearchError) as e:
            raise ProgrammingError(str(e)) from e
        except Exception as e:
            raise OperationalError(str(e)) from e
        last = results[-1] if results else None
        if last is not None and last.rows is not None:
            self.description = [(f.name, f.dataType.simpleString(), None, None, None, None, f.nullable) for f in last.rows.schema.fields]
            self._rows = map(tuple, last.rows.toLocalIterator())
        elif last is not None and last.affected is not None:
            self.rowcount = last.affected
        return self

    def executemany(self, text: str, many: list[dict[str, Any]]) -> Cursor:
        done = 0
        for parameters in many:
            self.execute(text, parameters)
            done += max(0, self.rowcount)
        self.rowcount = done
        return self

    def _open(self) -> None:
        if self.closed:
            raise ProgrammingError("the cursor is closed")
        self.connection._open()

    def _fetched(self) -> Iterator:
        self._open()
        if self._rows is None:
            raise ProgrammingError("the last statement has no rows")
        return self._rows

    def fetchone(self) -> tuple | None:
        return next(self._fetched(), None)

    def fetchmany(self, size: int | None = None) -> list[tuple]:
        return list(itertools.islice(self._fetched(), size or self.arraysize))

    def fetchall(self) -> list[tuple]:
        return list(self._fetched())

    def __iter__(self) -> Iterator:
        return self._fetched()

    def close(self) -> None:
        self.closed, self._rows = True, None

    def setinputsizes(self, sizes) -> None:
        """Nothing to do: kinds follow from the values."""

    def setoutputsize(self, size, column=None) -> None:
        """Nothing to do: texts come whole."""
