"""Ed25519 signatures by RFC 8032, on whole numbers. Slow: for ledgers' records, not for bulk data."""

from __future__ import annotations

import hashlib
from functools import lru_cache

P = 2**255 - 19
L = 2**252 + 27742317777372353535851937790883648493
D = -121665 * pow(121666, P - 2, P) % P
ROOT = pow(2, (P - 1) // 4, P)
Point = tuple[int, int, int, int]


def _add(a: Point, b: Point) -> Point:
    """Extended coordinates, RFC 8032 section 5.1.4."""
    x = (a[1] - a[0]) * (b[1] - b[0]) % P
    y = (a[1] + a[0]) * (b[1] + b[0]) % P
    t, z = 2 * a[3] * b[3] * D % P, 2 * a[2] * b[2] % P
    e, f, g, h = y - x, z - t, z + t, y + x
    return e * f % P, g * h % P, f * g % P, e * h % P


def _times(k: int, p: Point) -> Point:
    out: Point = (0, 1, 1, 0)
    while k:
        if k & 1:
            out = _add(out, p)
        p = _add(p, p)
        k >>= 1
    return out


def _same(a: Point, b: Point) -> bool:
    return (a[0] * b[2] - b[0] * a[2]) % P == 0 and (a[1] * b[2] - b[1] * a[2]) % P == 0


def _x_of(y: int, sign: int) -> int | None:
    if y >= P:
        return None
    x2 = (y * y - 1) * pow(D * y * y + 1, P - 2, P) % P
    if x2 == 0:
        return None if sign else 0
    x = pow(x2, (P + 3) // 8, P)
    if (x * x - x2) % P:
        x = x * ROOT % P
    if (x * x - x2) % P:
        return None
    return P - x if x & 1 != sign else x


_BY = 4 * pow(5, P - 2, P) % P
BASE: Point = (_x_of(_BY, 0), _BY, 1, _x_of(_BY, 0) * _BY % P)


def _pack(p: Point) -> bytes:
    z = pow(p[2], P - 2, P)
    return ((p[1] * z % P) | ((p[0] * z % P & 1) << 255)).to_bytes(32, "little")


def _unpack(data: bytes) -> Point | None:
    n = int.from_bytes(data, "little")
    y = n & ((1 << 255) - 1)
    x = _x_of(y, n >> 255)
    return None if x is None else (x, y, 1, x * y % P)


def _number(*parts: bytes) -> int:
    return int.from_bytes(hashlib.sha512(b"".join(parts)).digest(), "little")


def _secret(seed: bytes) -> tuple[int, bytes]:
    h = hashlib.sha512(seed).digest()
    a = int.from_bytes(h[:32], "little")
    return (a & ((1 << 254) - 8)) | (1 << 254), h[32:]


def public_key(seed: bytes) -> bytes:
    return _pack(_times(_secret(seed)[0], BASE))


def sign(seed: bytes, message: bytes) -> bytes:
    a, prefix = _secret(seed)
    key = _pack(_times(a, BASE))
    r = _number(prefix, message) % L
    head = _pack(_times(r, BASE))
    return head + ((r + _number(head, key, message) % L * a) % L).to_bytes(32, "little")


@lru_cache(maxsize=16_384)
def verify(key: bytes, message: bytes, signature: bytes) -> bool:
    if len(key) != 32 or len(signature) != 64:
        return False
    a, r = _unpack(key), _unpack(signature[:32])
    s = int.from_bytes(signature[32:], "little")
    if a is None or r is None or s >= L:
        return False
    return _same(_times(s, BASE), _add(r, _times(_number(signature[:32], key, message) % L, a)))


def key_id(key: bytes) -> str:
    return hashlib.sha256(key).hexdigest()
