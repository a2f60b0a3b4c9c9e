"""Signatures of RFC 8032 (Ed25519), for the few rows that are signed: one head for a run.

Points are (X, Y, Z, T) with x = X/Z, y = Y/Z, xy = T/Z on -x^2 + y^2 = 1 + d x^2 y^2 modulo 2^255 - 19. The arithmetic
does not run in constant time: keys belong on the driver, not on machines that others share.
"""

from __future__ import annotations

import hashlib

P = 2**255 - 19
ORDER = 2**252 + 27742317777372353535851937790883648493
D = -121665 * pow(121666, -1, P) % P
ROOT = pow(2, (P - 1) // 4, P)
ZERO = (0, 1, 1, 0)


def _add(p, q):
    a, b = (p[1] - p[0]) * (q[1] - q[0]) % P, (p[1] + p[0]) * (q[1] + q[0]) % P
    c, d = 2 * p[3] * q[3] * D % P, 2 * p[2] * q[2] % P
    e, f, g, h = b - a, d - c, d + c, b + a
    return e * f % P, g * h % P, f * g % P, e * h % P


def _times(n: int, p):
    out = ZERO
    for bit in bin(n)[2:]:
        out = _add(out, out)
        if bit == "1":
            out = _add(out, p)
    return out


def _encoded(p) -> bytes:
    inverse = pow(p[2], -1, P)
    x, y = p[0] * inverse % P, p[1] * inverse % P
    return (y | (x & 1) << 255).to_bytes(32, "little")


def _decoded(raw: bytes):
    """The point of 32 bytes, None if there is none."""
    n = int.from_bytes(raw, "little")
    y, odd = n & (1 << 255) - 1, n >> 255
    if y >= P:
        return None
    square = (y * y - 1) * pow(D * y * y + 1, -1, P) % P
    x = pow(square, (P + 3) // 8, P)
    if x * x % P != square:
        x = x * ROOT % P
    if x * x % P != square or (x == 0 and odd):
        return None
    if x & 1 != odd:
        x = P - x
    return x, y, 1, x * y % P


BASE = _decoded((4 * pow(5, -1, P) % P).to_bytes(32, "little"))


def _hashed(*parts: bytes) -> int:
    return int.from_bytes(hashlib.sha512(b"".join(parts)).digest(), "little")


def _secret(key: bytes) -> tuple[int, bytes]:
    if len(key) != 32:
        raise ValueError("a private key has 32 bytes")
    h = hashlib.sha512(key).digest()
    n = int.from_bytes(h[:32], "little")
    return n & ((1 << 254) - 8) | 1 << 254, h[32:]


def public_key(key: bytes) -> bytes:
    return _encoded(_times(_secret(key)[0], BASE))


def sign(key: bytes, message: bytes) -> bytes:
    a, prefix = _secret(key)
    public = _encoded(_times(a, BASE))
    r = _hashed(prefix, message) % ORDER
    first = _encoded(_times(r, BASE))
    s = (r + _hashed(first, public, message) * a) % ORDER
    return first + s.to_bytes(32, "little")


def verify(public: bytes, message: bytes, signature: bytes) -> bool:
    """Whether the signature is that of the key's owner; a malformed one is not."""
    if len(public) != 32 or len(signature) != 64:
        return False
    a, r, s = _decoded(public), _decoded(signature[:32]), int.from_bytes(signature[32:], "little")
    if a is None or r is None or s >= ORDER:
        return False
    k = _hashed(signature[:32], public, message) % ORDER
    left, right = _times(s, BASE), _add(r, _times(k, a))
    return (left[0] * right[2] - right[0] * left[2]) % P == 0 and (left[1] * right[2] - right[1] * left[2]) % P == 0
