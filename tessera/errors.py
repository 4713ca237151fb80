"""Errors of the query layer, by the stage that finds them."""


class TesseraError(Exception):
    """Base of all errors here."""


class CompileError(TesseraError):
    """A query part that can't be built."""


class CastError(TesseraError):
    """A value that doesn't fit its type."""

    def __init__(self, message: str, type_=None, value=None):
        super().__init__(message)
        self.type, self.value = type_, value


class ChangeError(TesseraError):
    """A value that can't be stored."""


class QueryError(TesseraError):
    """A query that is built well but has no meaning."""


class SubQueryError(QueryError):
    """A subquery that can't stand where it does."""


class NoPrimaryKeyFieldError(TesseraError):
    """A schema without a primary key where one is needed."""


class NoPrimaryKeyValueError(TesseraError):
    """A record without its primary key's value."""


class MultiplePrimaryKeyError(TesseraError):
    """Rows that share a primary key."""


class NoResultsError(TesseraError):
    """No row where one was expected."""


class MultipleResultsError(TesseraError):
    """Several rows where one at most was expected."""


class StaleEntryError(TesseraError):
    """A write that meets no row."""


class ConstraintError(TesseraError):
    """A write that breaks a constraint."""

    def __init__(self, message: str, rows=None, kind: str | None = None, name: str | None = None):
        super().__init__(message)
        self.rows, self.kind, self.name = rows, kind, name


class InvalidChangesetError(TesseraError):
    """A changeset with errors where a valid one is needed."""
