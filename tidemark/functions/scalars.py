"""Small scalar functions, as Columns and, where the runner needs them on the driver, in Python."""

from __future__ import annotations

import json
import re
import socket
from datetime import datetime, timedelta
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

DURATION = re.compile(r"(\d+)(ms|s|m)")
UNIT_MS = {"ms": 1, "s": 1_000, "m": 60_000}
ELLIPSIS = "…"
ID_LENGTH = 12


def duration_ms(text: str) -> int:
    """Milliseconds of "500ms", "1s" or "2m"."""
    match = DURATION.fullmatch(text.strip())
    if not match:
        raise ValueError(f"not a duration: {text!r} (expected for example 500ms, 1s, 2m)")
    return int(match[1]) * UNIT_MS[match[2]]


def duration_ms_column(text: Column) -> Column:
    """``duration_ms`` of a column; fails on a value that isn't a duration."""
    unit = F.regexp_extract(F.trim(text), r"^(\d+)(ms|s|m)$", 2)
    amount = F.regexp_extract(F.trim(text), r"^(\d+)(ms|s|m)$", 1)
    factor = F.when(unit == "ms", 1).when(unit == "s", 1_000).when(unit == "m", 60_000)
    return F.when(text.isNull(), F.lit(None).cast("long")).otherwise(
        F.when(factor.isNotNull(), F.try_to_number(amount, F.lit("999999999999")).cast("long") * factor).otherwise(F.raise_error(F.concat(F.lit("not a duration: "), text)).cast("long"))
    )


def kebab_case(name: str) -> str:
    """Each upper-case letter but the first is set off by a hyphen: HTTPFeed becomes h-t-t-p-feed."""
    return re.sub(r"(?<!^)([A-Z])", r"-\1", name).lower()


def kebab_case_column(name: Column) -> Column:
    return F.lower(F.regexp_replace(name, "(?<!^)([A-Z])", "-$1"))


def decapitalise(name: str) -> str:
    return name[:1].lower() + name[1:]


def decapitalise_column(name: Column) -> Column:
    return F.concat(F.lower(F.left(name, F.lit(1))), F.substr(name, F.lit(2)))


def capitalise(name: str) -> str:
    """INSERT becomes Insert."""
    return name[:1].upper() + name[1:].lower()


def capitalise_column(name: Column) -> Column:
    return F.concat(F.upper(F.left(name, F.lit(1))), F.lower(F.substr(name, F.lit(2))))


def short_id(text: Column) -> Column:
    """At most ID_LENGTH characters, then an ellipsis."""
    return F.when(F.length(text) > ID_LENGTH, F.concat(F.left(text, F.lit(ID_LENGTH)), F.lit(ELLIPSIS))).otherwise(text)


def plus_days(at: Column, days: Column) -> Column:
    """The time so many days later; null where ``days`` is 0: never."""
    return F.when(days > 0, at + F.make_interval(days=days))


def expiry(at: datetime, days: int) -> datetime | None:
    return at + timedelta(days=days) if days > 0 else None


def latest(*times: datetime | None) -> datetime | None:
    """The most recent of the times that are known."""
    return max((t for t in times if t is not None), default=None)


def latest_column(*times: Column) -> Column:
    return F.greatest(*times)


def seconds_between(start: Column, end: Column) -> Column:
    return F.timestamp_diff("SECOND", start, end)


def from_epoch(seconds: Column) -> Column:
    """The time that many seconds after 1970 began, in no zone."""
    return F.timestamp_add("SECOND", seconds, F.lit("1970-01-01").cast("timestamp_ntz"))


def instance_id(app: str, port: int) -> str:
    """host:app:port of this process."""
    return f"{socket.gethostname()}:{app}:{port}"


def error_signature(error: BaseException, code: int | None = None) -> str:
    name = type(error).__name__
    return name if code is None else f"{name}:{code}"


def error_signature_column(kind: Column, code: Column) -> Column:
    return F.concat_ws(":", kind, code.cast("string"))


def canonical_json(value: Any) -> str:
    """JSON with sorted keys and no blanks: equal documents have equal texts."""
    return json.dumps(value, sort_keys=True, separators=(",", ":"), default=str)


def document_key_json(key: Any) -> str | None:
    """A document key as stored with a dead letter: documents as they are, other values under _id."""
    if key is None:
        return None
    return canonical_json(key if isinstance(key, dict) else {"_id": key})
