"""Secrets taken out of JSON text of any depth."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .normalize import SECRET

REDACTED = "[REDACTED]"
NAME = re.compile(SECRET.removeprefix("(?i)"), re.IGNORECASE)
CREDENTIAL = re.compile(r"(?:bearer|basic)\s+\S+", re.IGNORECASE)
STRING = re.compile(r'"(?:[^"\\]|\\.)*"')
COLON = re.compile(r"\s*:\s*")
HEADERS = ["authorization", "proxy-authorization", "cookie", "set-cookie", "x-api-key", "x-auth-token"]


def redacted(text: str | None) -> str | None:
    """A JSON text without the values of fields with secret names, at any depth and of any kind, and without strings that
    are credentials. All else stays as it is written, spaces and numbers too. Text that isn't JSON is redacted whole."""
    if text is None:
        return None
    try:
        json.loads(text)
    except (ValueError, RecursionError):
        return REDACTED
    out, at, value_end = [], 0, json.JSONDecoder().raw_decode
    while found := STRING.search(text, at):
        out.append(text[at : found.start()])
        said = json.loads(found.group())
        colon = COLON.match(text, found.end())
        if colon and (NAME.search(said) or said.lower() in HEADERS):
            out += [found.group(), colon.group(), json.dumps(REDACTED)]
            at = value_end(text, colon.end())[1]
        else:
            hide = not colon and CREDENTIAL.match(said)
            out.append(json.dumps(REDACTED) if hide else found.group())
            at = found.end()
    return "".join(out) + text[at:]


def redact_json(c: Column) -> Column:
    @F.pandas_udf("string")
    def each(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for p in parts:
            yield p.map(redacted)

    return each(c)
