"""Ribbon filters in numpy: sets of 64-bit keys in about 1.15 x r bits a key, with no false negatives.

A key hashes to a block, a start slot, a 64-bit band of coefficients (lowest bit set) and an r-bit fingerprint: one row of a
banded linear system over GF(2). All keys of a block are brought to echelon form by elimination on their leading bits and
the system is solved from the last slot back. A key is (probably) in the set if its band times the solution gives its
fingerprint. Elimination runs over all keys at once, back substitution over all blocks at once.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

WIDTH = 64
U = np.uint64
_ONE, _ZERO = U(1), U(0)


def mix(keys: np.ndarray, seed: int) -> np.ndarray:
    """A 64-bit finalizer (xor-shift-multiply) under a seed."""
    with np.errstate(over="ignore"):
        x = keys.astype(U) + U((seed * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) & 0xFFFFFFFFFFFFFFFF)
        x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
        return x ^ (x >> U(31))


def _trailing_zeros(x: np.ndarray) -> np.ndarray:
    """For x != 0."""
    return np.bitwise_count((x & (~x + _ONE)) - _ONE).astype(np.int64)


@dataclass
class Ribbon:
    """blocks x slots of solution, bit-sliced: solution[bit, block, word] holds 64 slots a word."""

    bits: int
    blocks: int
    slots: int
    seed: int
    solution: np.ndarray
    keys: int

    @classmethod
    def build(cls, keys: np.ndarray, bits: int = 12, load: float = 0.87, block_keys: int = 2000) -> Ribbon:
        """Of distinct or repeated 64-bit keys. A system without solution (rare) is tried again with another seed."""
        keys = np.unique(np.asarray(keys).view(U) if np.asarray(keys).dtype == np.int64 else np.asarray(keys, U))
        n = len(keys)
        blocks = max(1, n // block_keys)
        for seed in range(1, 64):
            b = _block(keys, blocks)
            fullest = int(np.bincount(b, minlength=blocks).max()) if n else 0
            slots = -(-int(fullest / (load * 0.985**seed) + WIDTH + 1) // WIDTH) * WIDTH
            made = cls._solve(keys, b, bits, blocks, slots, seed)
            if made is not None:
                return cls(bits, blocks, slots, seed, made, n)
        raise RuntimeError("no solvable system found")

    @staticmethod
    def _solve(keys, b, bits, blocks, slots, seed):
        starts, band, mark = _rows(keys, slots, bits, seed)
        at = b * slots + starts
        size = blocks * slots
        coeff, value = np.zeros(size, U), np.zeros(size, U)
        order = np.argsort(at, kind="stable")
        at, band, mark = at[order], band[order], mark[order]
        while len(at):
            # whoever comes first at a free slot keeps it; all others there subtract its row and move on
            free = coeff[at] == _ZERO
            claim = np.flatnonzero(free)
            slot, first = np.unique(at[claim], return_index=True)
            rows = claim[first]
            coeff[slot], value[slot] = band[rows], mark[rows]
            keep = np.ones(len(at), bool)
            keep[rows] = False
            at, band, mark = at[keep], band[keep], mark[keep]
            band, mark = band ^ coeff[at], mark ^ value[at]
            gone = band == _ZERO
            if gone.any():
                if (mark[gone] != _ZERO).any():
                    return None
                live = ~gone
                at, band, mark = at[live], band[live], mark[live]
            shift = _trailing_zeros(band)
            band = band >> shift.astype(U)
            at = at + shift
        coeff, value = coeff.reshape(blocks, slots), value.reshape(blocks, slots)
        state = np.zeros((bits, blocks), U)  # the next 64 solved slots, nearest in the lowest bit
        out = np.zeros((bits, blocks, slots // WIDTH + 1), U)
        marks = np.array([(value >> U(i)) & _ONE for i in range(bits)])
        for s in range(slots - 1, -1, -1):
            c = coeff[:, s]
            moved = state << _ONE
            bit = (np.bitwise_count(moved & c) & 1).astype(U) ^ marks[:, :, s]
            state = moved | np.where(c != _ZERO, bit, _ZERO)
            if s % WIDTH == 0:
                out[:, :, s // WIDTH] = state
        return out

    def contains(self, keys: np.ndarray) -> np.ndarray:
        keys = np.asarray(keys)
        keys = keys.view(U) if keys.dtype == np.int64 else keys.astype(U)
        if not self.keys or not len(keys):
            return np.zeros(len(keys), bool)
        starts, band, mark = _rows(keys, self.slots, self.bits, self.seed)
        b, word, low = _block(keys, self.blocks), starts // WIDTH, (starts % WIDTH).astype(U)
        hit = np.ones(len(keys), bool)
        up = (U(WIDTH) - low) % U(WIDTH)
        for i in range(self.bits):
            sol = self.solution[i]
            window = (sol[b, word] >> low) | np.where(low == _ZERO, _ZERO, sol[b, word + 1] << up)
            hit &= ((np.bitwise_count(window & band) & 1).astype(U)) == ((mark >> U(i)) & _ONE)
        return hit

    @property
    def bits_per_key(self) -> float:
        return self.solution.size * 64 / max(1, self.keys)

    def pack(self) -> bytes:
        head = np.array([self.bits, self.blocks, self.slots, self.seed, self.keys], np.int64).tobytes()
        return head + self.solution.tobytes()

    @classmethod
    def unpack(cls, data: bytes) -> Ribbon:
        bits, blocks, slots, seed, keys = np.frombuffer(data[:40], np.int64).tolist()
        return cls(bits, blocks, slots, seed, np.frombuffer(data[40:], U).reshape(bits, blocks, slots // WIDTH + 1), keys)


def _block(keys: np.ndarray, blocks: int) -> np.ndarray:
    return ((mix(keys, 0) >> U(32)) * U(blocks) >> U(32)).astype(np.int64)


def _rows(keys: np.ndarray, slots: int, bits: int, seed: int):
    a, c, d = mix(keys, 3 * seed), mix(keys, 3 * seed + 1), mix(keys, 3 * seed + 2)
    starts = ((a >> U(32)) * U(slots - WIDTH + 1) >> U(32)).astype(np.int64)
    return starts, c | _ONE, d & U((1 << bits) - 1)
