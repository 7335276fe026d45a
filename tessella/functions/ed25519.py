"""Ed25519 as RFC 8032 gives it, on whole numbers: small helpers for signing columns."""

from __future__ import annotations

import hashlib

P = 2**255 - 19
Q = 2**252 + 27742317777372353535851937790883648493
D = -121665 * pow(121666, P - 2, P) % P
ROOT = pow(2, (P - 1) // 4, P)

Point = tuple[int, int, int, int]


def _hash(data: bytes) -> int:
    return int.from_bytes(hashlib.sha512(data).digest(), "little")


def _add(a: Point, b: Point) -> Point:
    e, f = (a[1] - a[0]) * (b[1] - b[0]) % P, (a[1] + a[0]) * (b[1] + b[0]) % P
    g, h = 2 * a[3] * b[3] * D % P, 2 * a[2] * b[2] % P
    x, y, z, t = f - e, h - g, h + g, f + e
    return x * y % P, z * t % P, y * z % P, x * t % P


def _times(n: int, a: Point) -> Point:
    out: Point = (0, 1, 1, 0)
    while n:
        if n & 1:
            out = _add(out, a)
        a = _add(a, a)
        n >>= 1
    return out


def _x_of(y: int, sign: int) -> int | None:
    if y >= P:
        return None
    square = (y * y - 1) * pow(D * y * y + 1, P - 2, P) % P
    if not square:
        return None if sign else 0
    x = pow(square, (P + 3) // 8, P)
    if (x * x - square) % P:
        x = x * ROOT % P
    if (x * x - square) % P:
        return None
    return P - x if x & 1 != sign else x


_Y = 4 * pow(5, P - 2, P) % P
_X = _x_of(_Y, 0)
BASE: Point = (_X, _Y, 1, _X * _Y % P)


def _packed(a: Point) -> bytes:
    inverse = pow(a[2], P - 2, P)
    x, y = a[0] * inverse % P, a[1] * inverse % P
    return (y | (x & 1) << 255).to_bytes(32, "little")


def _unpacked(data: bytes) -> Point | None:
    y = int.from_bytes(data, "little")
    x = _x_of(y & (1 << 255) - 1, y >> 255)
    y &= (1 << 255) - 1
    return None if x is None else (x, y, 1, x * y % P)


def _secret(seed: bytes) -> tuple[int, bytes]:
    h = hashlib.sha512(seed).digest()
    a = int.from_bytes(h[:32], "little") & (1 << 254) - 8 | 1 << 254
    return a, h[32:]


def public_key(seed: bytes) -> bytes:
    return _packed(_times(_secret(seed)[0], BASE))


def sign(seed: bytes, message: bytes) -> bytes:
    a, prefix = _secret(seed)
    own = _packed(_times(a, BASE))
    r = _hash(prefix + message) % Q
    top = _packed(_times(r, BASE))
    return top + ((r + _hash(top + own + message) % Q * a) % Q).to_bytes(32, "little")


def verify(key: bytes, message: bytes, signature: bytes) -> bool:
    if len(key) != 32 or len(signature) != 64:
        return False
    a, r, s = _unpacked(key), _unpacked(signature[:32]), int.from_bytes(signature[32:], "little")
    if a is None or r is None or s >= Q:
        return False
    left, right = _times(s, BASE), _add(r, _times(_hash(signature[:32] + key + message) % Q, a))
    return not ((left[0] * right[2] - right[0] * left[2]) % P or (left[1] * right[2] - right[1] * left[2]) % P)
