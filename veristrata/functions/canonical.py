"""Canonical JSON of a strict profile: ASCII keys in order, whole numbers up to 2^53 - 1, no spare white space."""

from __future__ import annotations

import json
from typing import Any

MOST = 2**53 - 1
#: Said of a value that is sound but written in another way.
OTHER_FORM = "not in canonical form"


def _pairs(found: list[tuple[str, Any]]) -> dict:
    out = dict(found)
    if len(out) != len(found):
        raise ValueError("repeated key")
    return out


def _check(x: Any) -> None:
    if isinstance(x, bool) or x is None or isinstance(x, str):
        return
    if isinstance(x, int):
        if abs(x) > MOST:
            raise ValueError("integer out of range")
    elif isinstance(x, dict):
        for k, v in x.items():
            if not isinstance(k, str) or not k.isascii():
                raise ValueError("key isn't ASCII")
            _check(v)
    elif isinstance(x, (list, tuple)):
        for v in x:
            _check(v)
    else:
        raise ValueError(f"{type(x).__name__} can't be held")


def encode(x: Any) -> bytes:
    _check(x)
    return json.dumps(x, sort_keys=True, separators=(",", ":"), ensure_ascii=False).encode("utf-8")


def _no_float(text: str) -> float:
    raise ValueError(f"{text} is no whole number")


def parse(data: bytes) -> Any:
    """The value, if ``data`` is exactly its canonical form."""
    x = json.loads(data.decode("utf-8"), object_pairs_hook=_pairs, parse_float=_no_float, parse_constant=_no_float)
    if encode(x) != data:
        raise ValueError(OTHER_FORM)
    return x


_SAFE = frozenset(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-._~ ")


def percent_encode(text: str) -> str:
    return "".join(chr(b) if b in _SAFE else f"%{b:02X}" for b in text.encode("utf-8"))


def percent_decode(text: str) -> str:
    raw, out, i = text.encode("ascii"), bytearray(), 0
    while i < len(raw):
        if raw[i] == 0x25:
            pair = raw[i + 1 : i + 3]
            if len(pair) != 2 or pair != pair.upper():
                raise ValueError("bad escape")
            out.append(int(pair, 16))
            i += 3
        else:
            out.append(raw[i])
            i += 1
    return out.decode("utf-8")


# ---- numbers of the JSON canonicalisation scheme ----


def number(x: float) -> str:
    """The shortest text that reads back as ``x``, in the form that RFC 8785 takes from ECMAScript. Not for NaN or infinities."""
    if x != x or x in (float("inf"), float("-inf")):
        raise ValueError("no JSON number")
    if x == 0:
        return "0"
    mantissa, _, power = repr(abs(float(x))).partition("e")
    whole, _, part = mantissa.partition(".")
    digits = (whole + part).lstrip("0")
    point = len(whole) + int(power or 0) - (len(whole + part) - len(digits))  # digits before the point
    digits = digits.rstrip("0")
    n, sign = len(digits), "-" if x < 0 else ""
    if n <= point <= 21:
        return sign + digits + "0" * (point - n)
    if 0 < point <= 21:
        return f"{sign}{digits[:point]}.{digits[point:]}"
    if -6 < point <= 0:
        return f"{sign}0.{'0' * -point}{digits}"
    power = f"e{'+' if point > 0 else '-'}{abs(point - 1)}"
    return f"{sign}{digits[0]}{'.' + digits[1:] if n > 1 else ''}{power}"


def encode_any(x: Any) -> str:
    """Canonical JSON of nested values with numbers of any kind; keys in order of their UTF-16 units, sets as sorted lists of texts, unknown things as their text."""
    if isinstance(x, dict):
        pairs = sorted(((str(k), v) for k, v in x.items()), key=lambda kv: kv[0].encode("utf-16-be"))
        return "{" + ",".join(f"{json.dumps(k, ensure_ascii=False)}:{encode_any(v)}" for k, v in pairs) + "}"
    if isinstance(x, (set, frozenset)):
        return encode_any(sorted(map(str, x)))
    if isinstance(x, (list, tuple)):
        return "[" + ",".join(map(encode_any, x)) + "]"
    if isinstance(x, bool) or x is None or isinstance(x, str):
        return json.dumps(x, ensure_ascii=False)
    if isinstance(x, int) and abs(x) > MOST:
        raise ValueError("integer out of range")
    return number(x) if isinstance(x, (int, float)) else json.dumps(str(x), ensure_ascii=False)


def number_text(column: Any) -> Any:
    """``number`` as a column function; null for null, NaN and infinities."""
    import math

    import pandas as pd
    from pyspark.sql import functions as F

    @F.pandas_udf("string")
    def text(x):
        return pd.Series([number(v) if v is not None and math.isfinite(v) else None for v in x], index=x.index, dtype=object)

    return text(column)
