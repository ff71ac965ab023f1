"""Parameters of the two queries, checked before any plan is built."""

from __future__ import annotations

import base64
import binascii
import json
import re
from collections.abc import Mapping
from dataclasses import dataclass, replace
from datetime import datetime

from cordwood.functions.times import BUCKETS
from cordwood.schema import LEVELS

DEFAULT_LIMIT = 100
MAX_LIMIT = 1000
GROUPS = ("service", "level")
ATTRIBUTE_PREFIX = "attr."

_ISO = re.compile(
    r"(\d{4}-\d\d-\d\dT\d\d:\d\d)(?::(\d\d)(?:\.(\d+))?)?Z",
    re.ASCII,
)


class QueryError(ValueError):
    """Refused parameters; ``issues`` holds (parameter, message) pairs."""

    def __init__(self, issues: list[tuple[str, str]]):
        self.issues = issues
        super().__init__("; ".join(f"{name}: {message}" for name, message in issues))


def parse_instant(text: str) -> datetime:
    """An ISO datetime ending in Z, cut to milliseconds; ValueError for anything else."""
    match = _ISO.fullmatch(text)
    if match is None:
        raise ValueError("Invalid ISO datetime")
    minute, second, fraction = match.groups()
    millis = ((fraction or "") + "000")[:3]
    try:
        return datetime.fromisoformat(f"{minute}:{second or '00'}.{millis}")
    except ValueError:
        raise ValueError("Invalid ISO datetime") from None


def format_instant(ts: datetime) -> str:
    return ts.isoformat(timespec="milliseconds") + "Z"


@dataclass(frozen=True)
class Cursor:
    """Position after the last row of a page."""

    timestamp: datetime
    id: str

    def encode(self) -> str:
        payload = json.dumps(
            {"timestamp": format_instant(self.timestamp), "id": self.id},
            separators=(",", ":"),
            ensure_ascii=False,
        )
        return base64.urlsafe_b64encode(payload.encode()).decode().rstrip("=")

    @classmethod
    def decode(cls, text: str) -> Cursor:
        try:
            padded = text + "=" * (-len(text) % 4)
            fields = json.loads(base64.urlsafe_b64decode(padded.encode()).decode())
            if not isinstance(fields["timestamp"], str) or not isinstance(fields["id"], str):
                raise TypeError("cursor fields must be strings")
            return cls(parse_instant(fields["timestamp"]), fields["id"])
        except (ValueError, TypeError, KeyError, binascii.Error):
            raise QueryError([("cursor", "Invalid cursor")]) from None


class _Reader:
    """Takes parameters out of a mapping of request parameters and gathers every issue."""

    def __init__(self, raw: Mapping[str, object]):
        self.raw = raw
        self.issues: list[tuple[str, str]] = []

    def text(self, name: str) -> str | None:
        value = self.raw.get(name)
        if value is None:
            return None
        if not isinstance(value, str):
            self.issues.append((name, "expected a single string"))
            return None
        return value

    def choice(self, name: str, allowed, required: bool = False) -> str | None:
        value = self.raw.get(name)
        if value is None and not required:
            return None
        if not isinstance(value, str) or value not in allowed:
            options = "|".join(f'"{option}"' for option in allowed)
            self.issues.append((name, f"Invalid option: expected one of {options}"))
            return None
        return value

    def instant(self, name: str, required: bool = False) -> datetime | None:
        if required and self.raw.get(name) is None:
            self.issues.append((name, "expected a single string"))
            return None
        value = self.text(name)
        if value is None:
            return None
        try:
            return parse_instant(value)
        except ValueError as error:
            self.issues.append((name, str(error)))
            return None

    def limit(self, name: str = "limit") -> int | None:
        value = self.text(name)
        if value is None:
            return None
        if re.fullmatch(r"[0-9]+", value) is None:
            self.issues.append((name, "limit must be a number"))
            return None
        if not 1 <= int(value) <= MAX_LIMIT:
            self.issues.append((name, f"limit must be between 1 and {MAX_LIMIT}"))
            return None
        return int(value)

    def attributes(self) -> tuple[tuple[str, str], ...]:
        """``attr.<key>`` parameters; a repeated one arrives as a list and is ignored."""
        return tuple(
            (name[len(ATTRIBUTE_PREFIX) :], value)
            for name, value in self.raw.items()
            if name.startswith(ATTRIBUTE_PREFIX) and isinstance(value, str)
        )

    def check(self) -> None:
        if self.issues:
            raise QueryError(self.issues)


@dataclass(frozen=True)
class Selection:
    """The filters both queries share. Empty ``service`` and ``q`` filter nothing."""

    service: str | None = None
    level: str | None = None
    since: datetime | None = None
    until: datetime | None = None
    q: str | None = None
    attributes: tuple[tuple[str, str], ...] = ()
    search_mode: str = "wildcard"


@dataclass(frozen=True)
class ListingQuery(Selection):
    limit: int = DEFAULT_LIMIT
    cursor: Cursor | None = None

    @classmethod
    def parse(cls, raw: Mapping[str, object], search_mode: str = "wildcard") -> ListingQuery:
        reader = _Reader(raw)
        service = reader.text("service")
        level = reader.choice("level", LEVELS)
        since, until = reader.instant("since"), reader.instant("until")
        q, limit, cursor = reader.text("q"), reader.limit(), reader.text("cursor")
        reader.check()
        if since and until and since > until:
            raise QueryError([("until", "until must be later than since")])
        return cls(
            service=service,
            level=level,
            since=since,
            until=until,
            q=q,
            attributes=reader.attributes(),
            search_mode=search_mode,
            limit=DEFAULT_LIMIT if limit is None else limit,
            cursor=Cursor.decode(cursor) if cursor else None,
        )

    def after(self, cursor: Cursor | None) -> ListingQuery:
        return replace(self, cursor=cursor)


@dataclass(frozen=True)
class BucketQuery(Selection):
    bucket: str = "1h"
    group_by: str | None = None

    @classmethod
    def parse(cls, raw: Mapping[str, object], search_mode: str = "wildcard") -> BucketQuery:
        reader = _Reader(raw)
        service = reader.text("service")
        bucket = reader.choice("bucket", tuple(BUCKETS), required=True)
        group_by = reader.choice("group_by", GROUPS)
        since = reader.instant("since", required=True)
        until = reader.instant("until", required=True)
        level, q = reader.choice("level", LEVELS), reader.text("q")
        reader.check()
        if since >= until:
            raise QueryError([("until", "until must be later than since")])
        return cls(
            service=service,
            level=level,
            since=since,
            until=until,
            q=q,
            attributes=reader.attributes(),
            search_mode=search_mode,
            bucket=bucket,
            group_by=group_by,
        )
