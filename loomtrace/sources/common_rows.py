import json
import re
from datetime import UTC, datetime
from decimal import Decimal, InvalidOperation

RUN, STEP, CALL = "run", "step", "call"
Row = tuple[str, dict]


def text(value: object) -> str | None:
    """Compact canonical JSON; null for an absent value."""
    return None if value is None else json.dumps(value, ensure_ascii=False, separators=(",", ":"))


def nanoseconds(value: object) -> int | None:
    """RFC 3339 text or Unix seconds as exact nanoseconds; finer or out of range is an error."""
    if value is None or isinstance(value, bool):
        return None
    try:
        if isinstance(value, str):
            m = re.fullmatch(r"(\d{4}-\d\d-\d\d)[T ](\d\d:\d\d:\d\d)(?:\.(\d+))?(Z|z|[+-]\d\d:\d\d)?", value)
            if not m:
                raise ValueError(value)
            zone = "+00:00" if m[4] in ("Z", "z", None) else m[4]
            seconds = int(datetime.fromisoformat(f"{m[1]}T{m[2]}{zone}").astimezone(UTC).timestamp())
            part = (m[3] or "").rstrip("0")
            if len(part) > 9:
                raise ValueError("finer than a nanosecond")
            out = seconds * 10**9 + int(part.ljust(9, "0"))
        else:
            exact = Decimal(str(value)) * 10**9
            if exact != exact.to_integral_value():
                raise ValueError("finer than a nanosecond")
            out = int(exact)
    except InvalidOperation as e:
        raise ValueError(value) from e
    if not -(2**63) <= out < 2**63:
        raise ValueError("out of range")
    return out


def stamp(value: object) -> datetime | None:
    ns = nanoseconds(value)
    return None if ns is None else datetime.fromtimestamp(ns // 10**9, UTC).replace(microsecond=ns % 10**9 // 1000)


def effective_kind(kind: str | None, source: str, calls: list) -> str:
    if kind:
        return kind
    if source == "agent":
        return "autonomous" if calls else "dialogue"
    return "internal" if source == "system" else "dialogue"
