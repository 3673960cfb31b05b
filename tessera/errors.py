"""Failures of statements."""

from __future__ import annotations

import re


class SqlError(Exception):
    """A statement that cannot be parsed, bound or run."""


def reason(e: Exception) -> str:
    """What a failure says, without Spark's frames around an error that the dialect raised."""
    said = re.search(r"\[USER_RAISED_EXCEPTION\] (.*?)(?: SQLSTATE|\n|$)", str(e))
    return said[1] if said else str(e)
