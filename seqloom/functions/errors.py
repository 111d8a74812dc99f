"""Errors by code: XS static, XD dynamic, XC of a step."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


class PipelineError(Exception):
    """A failed check, with the code that the standard gives it."""

    def __init__(self, code: str, message: str = ""):
        self.code, self.message = code, message
        super().__init__(f"[{code}] {message}")

    def __reduce__(self):
        return type(self), (self.code, self.message)


def fail(code: str, message: str) -> Column:
    """A column that fails when a row is computed; its message carries the code."""
    return F.raise_error(F.lit(f"[{code}] {message}"))


def code_of(error: BaseException) -> str | None:
    """The code in an error of Spark or of this library, however deep it is wrapped."""
    if isinstance(error, PipelineError):
        return error.code
    found = re.search(r"\[(X[SDC]\d{4}|FU\d{2}|[A-Za-z_][\w.-]*:[\w.-]+)\]", str(error))
    return found[1] if found else None


def check(ok: bool, code: str, message: str) -> None:
    """Raise unless ok."""
    if not ok:
        raise PipelineError(code, message)
