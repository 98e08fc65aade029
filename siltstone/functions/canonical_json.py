"""One form of a JSON value of any depth, and values without secrets.

A value is a JSON text or a variant. Objects' keys are sorted by code point at every depth, with no spaces; other
characters than ASCII stay or are escaped. Of equal keys in an object the last counts. What is no JSON gives null.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Callable
from typing import Any

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType

#: What keys of secrets hold, in any case, and what stands for their values.
SECRET = re.compile("password|hash|token|csrf|secret", re.IGNORECASE)
REDACTED = "[REDACTED]"


def dumped(value: Any, *, ascii_only: bool) -> str:
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=ascii_only)


def without_secrets(value: Any) -> Any:
    """``value`` with the values of secret-looking keys replaced, at every depth."""
    if isinstance(value, dict):
        return {k: REDACTED if SECRET.search(k) else without_secrets(v) for k, v in value.items()}
    if isinstance(value, list):
        return [without_secrets(v) for v in value]
    return value


def _over(c: Column, change: Callable[[Any], Any], ascii_only: bool, said: Callable[[str], str] = str) -> Column:
    """``said`` of each canonical text. Texts are taken from an Arrow batch one at a time, so a batch is never held as Python objects."""

    def one(text: str | None) -> str | None:
        if text is None:
            return None
        try:
            plain = dumped(change(json.loads(text)), ascii_only=ascii_only)
        except ValueError:
            return None
        return said(plain)

    @F.arrow_udf(StringType())
    def run(texts: pa.Array) -> pa.Array:
        return pa.array((one(x.as_py()) for x in texts), pa.string())

    return run(c)


def _sha256(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def canonical(c: Column, *, ascii_only: bool = False) -> Column:
    """The canonical text of a JSON text; of a variant ``v`` pass ``F.to_json(v)``."""
    return _over(c, lambda x: x, ascii_only)


def digest(c: Column, *, ascii_only: bool = False) -> Column:
    """SHA-256 of the canonical text in UTF-8; taken in Python, so that canonical texts are neither kept nor sent back."""
    return _over(c, lambda x: x, ascii_only, _sha256)


def redacted(c: Column) -> Column:
    """The canonical text without secrets."""
    return _over(c, without_secrets, False)


_STRINGS = re.compile(r'"(?:[^"\\]|\\.)*"', re.DOTALL)
_BRACKETS = re.compile(r"[\[\]{}]")


def _depth(text: str) -> int:
    """The deepest nesting of brackets outside strings, found without parsing."""
    now = most = 0
    for m in _BRACKETS.finditer(_STRINGS.sub("", text)):
        now += 1 if m.group() in "[{" else -1
        most = max(most, now)
    return most


@F.pandas_udf(IntegerType())
def depth(texts: pd.Series) -> pd.Series:
    """How deep objects and arrays of a JSON text are nested."""
    return texts.map(_depth, na_action="ignore").astype("Int64")
