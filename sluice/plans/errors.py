"""Errors a query can have: stable codes, the place in the text, a compact form and a rendering."""

from __future__ import annotations

import re
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass
from enum import Enum, IntEnum

from py4j.protocol import Py4JError
from pyspark.errors import PySparkException


# Codes are part of the language and never change.
class Code(IntEnum):
    QUERY_TOO_LARGE = 1
    UNEXPECTED_CHARACTER = 2
    UNTERMINATED_STRING = 3
    TOKEN_TOO_LONG = 4
    EXPECTED_EXPRESSION = 5
    UNEXPECTED_TOKEN = 6
    EXPECTED_TOKEN = 7
    NESTING_TOO_DEEP = 8
    OUT_OF_MEMORY = 9
    UNKNOWN_STAGE = 10
    EXPECTED_SOURCE = 11
    UNEXPECTED_SOURCE = 12
    LIST_TOO_LONG = 13
    UNKNOWN_TABLE = 14
    UNKNOWN_COLUMN = 15
    UNSUPPORTED = 16
    NUMBER_TOO_LARGE = 17
    CONDITION_TOO_LARGE = 18
    DUPLICATE_COLUMN = 19
    AMBIGUOUS_COLUMN = 20
    EXPECTED_AS = 21
    LISTED_TWICE = 22
    NO_COLUMNS_LEFT = 23
    EXPECTED_WORD = 24
    UNKNOWN_FUNCTION = 25
    EXPRESSION_TOO_LARGE = 26
    EXPECTED_NUMBER = 27
    EXPECTED_NAME = 28
    EXPECTED_INTEGER = 29
    EXPECTED_ONE_KIND = 30
    EXPECTED_ONE_TYPE = 31
    EXPECTED_STRING = 32
    ARGUMENT_COUNT = 33
    CHOICES_OF_ONE_TYPE = 34
    NUMBER_CONDITION = 35
    ARITHMETIC_ON_SOME_ROWS = 36
    ARGUMENT_TYPE = 37


# What an UNSUPPORTED error is about.
class Unsupported(IntEnum):
    SELECT_EXPRESSION = 1
    WHERE = 2
    NUMBER_TYPE = 3
    DECIMAL = 4
    LIMIT = 5
    AGGREGATE = 6
    AGGREGATE_TYPE = 7
    GROUP_KEY = 8
    ORDER_BY = 9


_ABOUT = {
    Unsupported.SELECT_EXPRESSION: "this can't be computed as a column",
    Unsupported.WHERE: "a condition compares a column with a literal; compute anything else with EXTEND first",
    Unsupported.NUMBER_TYPE: "a double can't hold this integer exactly",
    Unsupported.DECIMAL: "numbers with a decimal point can't be used",
    Unsupported.LIMIT: "LIMIT and OFFSET take one integer each",
    Unsupported.AGGREGATE: "an aggregate is a function of one column, or count(*)",
    Unsupported.AGGREGATE_TYPE: "the aggregate can't read a column of this type",
    Unsupported.GROUP_KEY: "a group's key is an integer or string column",
    Unsupported.ORDER_BY: "rows are ordered by columns; compute anything else with EXTEND first",
}
_MESSAGES = {
    Code.QUERY_TOO_LARGE: "the query is too large",
    Code.UNEXPECTED_CHARACTER: "this character isn't part of the language",
    Code.UNTERMINATED_STRING: "the string has no closing quote",
    Code.TOKEN_TOO_LONG: "this is too long",
    Code.EXPECTED_EXPRESSION: "an expression should be here",
    Code.UNEXPECTED_TOKEN: "the query should end here, or go on with |>",
    Code.EXPECTED_TOKEN: "something else should be here",
    Code.NESTING_TOO_DEEP: "this is nested too deeply",
    Code.OUT_OF_MEMORY: "there isn't enough memory",
    Code.UNKNOWN_STAGE: "there is no such stage",
    Code.EXPECTED_SOURCE: "a query starts with a source, such as FROM",
    Code.UNEXPECTED_SOURCE: "a source can only start a query",
    Code.LIST_TOO_LONG: "the list is too long",
    Code.UNKNOWN_TABLE: "there is no such table",
    Code.UNKNOWN_COLUMN: "no column here has this name",
    Code.UNSUPPORTED: "this isn't supported",
    Code.NUMBER_TOO_LARGE: "the integer doesn't fit in 64 bits",
    Code.CONDITION_TOO_LARGE: "the condition has too many parts",
    Code.DUPLICATE_COLUMN: "the table has two columns of one name, ignoring case",
    Code.AMBIGUOUS_COLUMN: "more than one column here has this name, ignoring case",
    Code.EXPECTED_AS: "AS should be here",
    Code.LISTED_TWICE: "the list names this column twice",
    Code.NO_COLUMNS_LEFT: "no column would be left",
    Code.EXPECTED_WORD: "a keyword is missing here",
    Code.UNKNOWN_FUNCTION: "there is no such function",
    Code.EXPRESSION_TOO_LARGE: "the expression has too many parts",
    Code.EXPECTED_NUMBER: "arithmetic takes numbers, not strings",
    Code.EXPECTED_NAME: "a computed column needs a name: AS name",
    Code.EXPECTED_INTEGER: "% takes integers",
    Code.EXPECTED_ONE_KIND: "a number can't be compared with a string",
    Code.EXPECTED_ONE_TYPE: "an integer can't be compared with a double, unless it is a literal",
    Code.EXPECTED_STRING: "LIKE takes a string",
    Code.ARGUMENT_COUNT: "the function takes another number of arguments",
    Code.CHOICES_OF_ONE_TYPE: "the choices should all have one type",
    Code.NUMBER_CONDITION: "a condition is a number, not a string",
    Code.ARITHMETIC_ON_SOME_ROWS: "integer arithmetic that only some rows use could overflow on the others; compute it with EXTEND first",
    Code.ARGUMENT_TYPE: "the function takes an argument of another type",
}
_COMPACT = re.compile(r"sluice:E(\d+):(\d+)\+(\d+):(\d+)\Z")


@dataclass(frozen=True)
class Span:
    """Bytes of the query's UTF-8 text."""

    start: int
    length: int = 1


class QueryError(Exception):
    """A query that can't be parsed or compiled."""

    def __init__(self, code: Code, span: Span, detail: int = 0):
        self.code, self.span, self.detail = code, span, int(detail)
        super().__init__(f"{self.compact()}: {self.message()}")

    @classmethod
    def unsupported(cls, about: Unsupported, span: Span) -> QueryError:
        return cls(Code.UNSUPPORTED, span, about)

    def message(self) -> str:
        if self.code == Code.UNSUPPORTED and self.detail in iter(Unsupported):
            return _ABOUT[Unsupported(self.detail)]
        return _MESSAGES[self.code]

    def compact(self) -> str:
        return f"sluice:E{self.code:04}:{self.span.start}+{self.span.length}:{self.detail}"

    @classmethod
    def parse(cls, text: str) -> QueryError | None:
        """The error that a compact form describes; None if it is none."""
        found = _COMPACT.match(text)
        if not found or int(found[1]) not in iter(Code):
            return None
        return cls(Code(int(found[1])), Span(int(found[2]), int(found[3])), int(found[4]))

    def render(self, query: str) -> str:
        """The message with the line of the query, the place marked."""
        raw = query.encode()
        start = min(self.span.start, len(raw))
        line_start = raw.rfind(b"\n", 0, start) + 1
        line = raw[line_start:].split(b"\n", 1)[0].decode(errors="replace")
        number = raw.count(b"\n", 0, start) + 1
        column = len(raw[line_start:start].decode(errors="replace"))
        width = max(1, len(raw[start : start + self.span.length].decode(errors="replace")))
        margin = " " * len(str(number))
        return f"error[E{self.code:04}]: {self.message()}\n{margin}--> {number}:{column + 1}\n{margin} |\n{number} | {line}\n{margin} | {' ' * column}{'^' * width}"


# Why a run can fail.
class Failure(Enum):
    OUT_OF_MEMORY = "OutOfMemory"
    IO = "Io"
    CORRUPT = "Corrupt"
    UNSUPPORTED = "Unsupported"
    OVERFLOW = "Overflow"


#: What Spark's error says, by failure; the first that is found counts.
_SAYS = (
    (Failure.OVERFLOW, ("ARITHMETIC_OVERFLOW", "BINARY_ARITHMETIC_OVERFLOW", "CAST_OVERFLOW", "NUMERIC_VALUE_OUT_OF_RANGE")),
    (Failure.OUT_OF_MEMORY, ("OutOfMemory", "UNABLE_TO_ACQUIRE_MEMORY", "maxResultSize")),
    (Failure.CORRUPT, ("is not a Parquet file", "CANNOT_READ_FILE_FOOTER", "CANNOT_READ_FOOTER", "corrupt", "ChecksumException", "ParquetDecodingException")),
    (Failure.IO, ("FILE_NOT_EXIST", "FileNotFound", "PATH_NOT_FOUND", "FAILED_READ_FILE", "IOException")),
)


class RunError(Exception):
    """A run that failed, and why; Spark's own error is its cause."""

    def __init__(self, failure: Failure, message: str):
        self.failure = failure
        super().__init__(f"{failure.value}: {message}")


@contextmanager
def run_errors() -> Iterator[None]:
    """Spark's errors of running queries as RunError."""
    try:
        yield
    except (PySparkException, Py4JError) as error:
        text = str(error)
        failure = next((f for f, says in _SAYS if any(x in text for x in says)), Failure.UNSUPPORTED)
        raise RunError(failure, text.split("\n", 1)[0]) from error
