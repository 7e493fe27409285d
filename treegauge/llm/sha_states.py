"""SHA-256 on many messages at once, with states that can be stored and taken up again.

A state is the chaining value after whole blocks of 64 bytes: eight 32-bit words a message. All inputs here are
digests as hex text, which are exactly one block each, so a state stands between any two of them.
"""

from __future__ import annotations

import math

import numpy as np

DIGEST_CHARS = 64


def _root_bits(n: int, root: int) -> int:
    """The first 32 bits after the point of the square or cube root of n."""
    if root == 2:
        return math.isqrt(n << 64) & 0xFFFFFFFF
    target = n << 96
    x = 1 << ((target.bit_length() + 2) // 3)
    while True:
        y = (2 * x + target // (x * x)) // 3
        if y >= x:
            return x & 0xFFFFFFFF
        x = y


_PRIMES = [n for n in range(2, 312) if all(n % k for k in range(2, n))]
_ROUND = np.array([_root_bits(p, 3) for p in _PRIMES], dtype=np.uint32)
_START = np.array([_root_bits(p, 2) for p in _PRIMES[:8]], dtype=np.uint32)


def start_states(n: int) -> np.ndarray:
    """The state before the first block, n times."""
    return np.repeat(_START[None, :], n, axis=0)


def _turned(x: np.ndarray, bits: int) -> np.ndarray:
    return (x >> np.uint32(bits)) | (x << np.uint32(32 - bits))


def take_up(states: np.ndarray, blocks: np.ndarray) -> np.ndarray:
    """States (n, 8) after one more block (n, 16 words) each."""
    words = [blocks[:, i] for i in range(16)]
    a, b, c, d, e, f, g, h = (states[:, i] for i in range(8))
    with np.errstate(over="ignore"):
        for i in range(64):
            if i >= 16:
                x, y = words[i - 15], words[i - 2]
                words.append(words[i - 16] + words[i - 7] + (_turned(x, 7) ^ _turned(x, 18) ^ (x >> np.uint32(3)))
                             + (_turned(y, 17) ^ _turned(y, 19) ^ (y >> np.uint32(10))))
                words[i - 16] = None
            s = _turned(e, 6) ^ _turned(e, 11) ^ _turned(e, 25)
            t = h + s + ((e & f) ^ (~e & g)) + _ROUND[i] + words[i]
            u = (_turned(a, 2) ^ _turned(a, 13) ^ _turned(a, 22)) + ((a & b) ^ (a & c) ^ (b & c))
            h, g, f, e, d, c, b, a = g, f, e, d + t, c, b, a, t + u
        return states + np.stack([a, b, c, d, e, f, g, h], axis=1)


def finish(states: np.ndarray, n_blocks: np.ndarray) -> np.ndarray:
    """Digests (n, 16 words of hex text) of messages of so many whole blocks."""
    last = np.zeros((len(states), 16), dtype=np.uint32)
    last[:, 0] = 0x80000000
    bits = n_blocks.astype(np.uint64) * np.uint64(DIGEST_CHARS * 8)
    last[:, 14], last[:, 15] = (bits >> np.uint64(32)).astype(np.uint32), bits.astype(np.uint32)
    return hex_blocks(take_up(states, last))


def hex_blocks(states: np.ndarray) -> np.ndarray:
    """The hex text of 32-byte values, as blocks of 16 words."""
    raw = np.ascontiguousarray(states.astype(">u4")).view(np.uint8)
    nibbles = np.stack([raw >> 4, raw & 15], axis=2).reshape(len(states), DIGEST_CHARS)
    text = np.where(nibbles < 10, nibbles + 48, nibbles + 87).astype(np.uint8)
    return text.view(">u4").astype(np.uint32)


def blocks_of(digests) -> np.ndarray:
    """Hex texts as blocks of 16 words."""
    joined = "".join(digests).encode("ascii")
    return np.frombuffer(joined, dtype=">u4").reshape(-1, 16).astype(np.uint32)


def texts_of(blocks: np.ndarray) -> list[str]:
    """Blocks as hex texts."""
    joined = np.ascontiguousarray(blocks.astype(">u4")).tobytes().decode("ascii")
    return [joined[i:i + DIGEST_CHARS] for i in range(0, len(joined), DIGEST_CHARS)]


def bytes_of(states: np.ndarray) -> list[bytes]:
    """States as 32 bytes each."""
    joined = np.ascontiguousarray(states.astype(">u4")).tobytes()
    return [joined[i:i + 32] for i in range(0, len(joined), 32)]


def states_of(values) -> np.ndarray:
    """The states that `bytes_of` wrote."""
    return np.frombuffer(b"".join(values), dtype=">u4").reshape(-1, 8).astype(np.uint32)
