"""SHA-256 over columns of messages, with chaining states that can be kept, copied and resumed.

A digest in hexadecimal is 64 bytes, one block of SHA-256. A state before any child of a node is thus the eight words
after so many whole blocks, and needs no pending bytes. Arrays hold one message per row; words are unsigned 32-bit.
"""

from functools import cache
from math import isqrt

import numpy as np

_ASCII_HEX = np.frombuffer(b"0123456789abcdef", np.uint8)


def _cube_root(n: int) -> int:
    """Largest integer whose cube is at most ``n``."""
    root = 1 << -(-n.bit_length() // 3)
    while (lower := (2 * root + n // root**2) // 3) < root:
        root = lower
    return root


@cache
def _constants() -> tuple[np.ndarray, np.ndarray]:
    """First 32 bits of the fractions of the roots of the first primes: square roots of 8, cube roots of 64."""
    primes = [p for p in range(2, 312) if all(p % d for d in range(2, isqrt(p) + 1))]
    start = [isqrt(p << 64) & 0xFFFFFFFF for p in primes[:8]]
    return np.array(start, np.uint32), np.array([_cube_root(p << 96) & 0xFFFFFFFF for p in primes], np.uint32)


def initial(rows: int) -> np.ndarray:
    """The state of ``rows`` empty messages."""
    return np.tile(_constants()[0], (rows, 1))


def _turn(x: np.ndarray, n: int) -> np.ndarray:
    return (x >> np.uint32(n)) | (x << np.uint32(32 - n))


def absorb(states: np.ndarray, blocks: np.ndarray) -> np.ndarray:
    """States after one more block of 16 words each."""
    w = [np.ascontiguousarray(blocks[:, i]) for i in range(16)]
    a, b, c, d, e, f, g, h = (np.ascontiguousarray(states[:, i]) for i in range(8))
    for i, k in enumerate(_constants()[1]):
        if i >= 16:
            x, y = w[(i - 15) % 16], w[(i - 2) % 16]
            w[i % 16] = w[i % 16] + (_turn(x, 7) ^ _turn(x, 18) ^ (x >> np.uint32(3))) + w[(i - 7) % 16] + (_turn(y, 17) ^ _turn(y, 19) ^ (y >> np.uint32(10)))
        one = h + (_turn(e, 6) ^ _turn(e, 11) ^ _turn(e, 25)) + (g ^ (e & (f ^ g))) + k + w[i % 16]
        two = (_turn(a, 2) ^ _turn(a, 13) ^ _turn(a, 22)) + ((a & b) | (c & (a | b)))
        h, g, f, e, d, c, b, a = g, f, e, d + one, c, b, a, one + two
    return states + np.stack([a, b, c, d, e, f, g, h], axis=1)


def absorb_where(states: np.ndarray, digests: np.ndarray, chosen: np.ndarray) -> None:
    """Feed the hexadecimal digest of each chosen row to its state, in place."""
    rows = np.flatnonzero(chosen)
    if len(rows):
        states[rows] = absorb(states[rows], hex_blocks(digests[rows]))


def finish(states: np.ndarray, blocks: np.ndarray) -> np.ndarray:
    """Digests of messages of so many whole blocks."""
    last = np.zeros((len(states), 16), np.uint32)
    last[:, 0] = 0x80000000
    bits = np.asarray(blocks, np.uint64) * np.uint64(512)
    last[:, 14], last[:, 15] = bits >> np.uint64(32), bits & np.uint64(0xFFFFFFFF)
    return absorb(states, last)


def hex_blocks(digests: np.ndarray) -> np.ndarray:
    """Digests (rows of 8 words) in lowercase hexadecimal, as rows of 16 words."""
    raw = digests.astype(">u4").view(np.uint8).reshape(len(digests), 32)
    text = np.empty((len(digests), 64), np.uint8)
    text[:, 0::2], text[:, 1::2] = _ASCII_HEX[raw >> 4], _ASCII_HEX[raw & 15]
    return text.view(">u4").astype(np.uint32)


def to_bytes(words: np.ndarray) -> bytes:
    return words.astype(">u4").tobytes()


def from_bytes(raw: bytes) -> np.ndarray:
    """Rows of eight words."""
    return np.frombuffer(raw, ">u4").astype(np.uint32).reshape(-1, 8)


def to_hex(digests: np.ndarray) -> list[str]:
    text = to_bytes(digests).hex()
    return [text[i : i + 64] for i in range(0, len(text), 64)]
