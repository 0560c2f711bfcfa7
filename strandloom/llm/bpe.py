"""Byte-level BPE without regex: vectorised pre-tokenisation and cached pair merging.

Code points are mapped to classes by one table lookup. A small automaton over these classes (with what the next one or two
characters are folded in) says where pieces begin. Its transition functions compose associatively, so the states of all
positions come from a blocked scan: compose within blocks, scan over the blocks' functions, then replay each block from its
true entry state. The pieces are merged by rank once and cached.
"""

from __future__ import annotations

import base64
import heapq
import sys
import unicodedata
from collections.abc import Iterator
from itertools import chain

import numpy as np

# classes
_L, _N, _O, _S, _END = range(5)
# symbols: class plus lookahead
L, N, O, SPACE_TEXT, WS_TEXT, WS_WS, APO1, APO2, RESET = range(9)
# states of the automaton
DONE, IN_L, IN_N, IN_O, PREFIX, IN_WS, TAIL1, TAIL2 = range(8)
STATES = 8
_RESET_POINT = 0x110000
#: Code points scanned at once, and columns of a block of the scan.
CHUNK, BLOCK = 1_000_000, 128
#: Pieces kept in the cache of a worker.
CACHE = 300_000

#: The characters with the Unicode property White_Space.
WHITE_SPACE = [9, 10, 11, 12, 13, 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]


def class_table() -> np.ndarray:
    kinds = {"L": _L, "N": _N}
    table = np.full(_RESET_POINT + 1, _O, np.uint8)
    table[: sys.maxunicode + 1] = [kinds.get(unicodedata.category(chr(i))[0], _O) for i in range(sys.maxunicode + 1)]
    table[WHITE_SPACE] = _S
    table[_RESET_POINT] = _END
    return table


def automaton() -> tuple[np.ndarray, np.ndarray]:
    """step[symbol, state] and begins[symbol, state]: the state after a character and whether a piece begins at it."""
    step, begins = np.zeros((9, STATES), np.uint8), np.ones((9, STATES), bool)
    for symbol, state, joins in ((L, IN_L, (IN_L, PREFIX)), (N, IN_N, (IN_N, PREFIX)), (O, IN_O, (IN_O, PREFIX)), (WS_WS, IN_WS, (IN_WS,))):
        step[symbol] = state
        begins[symbol, list(joins)] = False
    step[L, TAIL2], step[L, TAIL1] = TAIL1, DONE  # the letters of a contraction stay with its apostrophe
    begins[L, [TAIL1, TAIL2]] = False
    step[SPACE_TEXT], step[WS_TEXT], step[RESET] = PREFIX, DONE, DONE
    for symbol, state in ((APO1, TAIL1), (APO2, TAIL2)):
        step[symbol] = state
        step[symbol, [IN_O, PREFIX]] = IN_O  # within a run of other characters it is one of them
        begins[symbol, [IN_O, PREFIX]] = False
    return step, begins


_STEP, _BEGINS = automaton()
_STEP_FLAT, _BEGINS_FLAT = _STEP.ravel(), _BEGINS.ravel()
_TABLE: list[np.ndarray] = []


def symbols(points: np.ndarray) -> np.ndarray:
    if not _TABLE:
        _TABLE.append(class_table())
    kind = _TABLE[0][points]
    n1 = np.append(points[1:], _RESET_POINT)
    n2 = np.append(points[2:], [_RESET_POINT] * min(2, len(points)))[: len(points)]
    text_next = np.append(kind[1:], _END) < _S
    out = kind.copy()
    ws = kind == _S
    out[ws] = WS_WS
    out[ws & text_next] = WS_TEXT
    out[(points == 32) & text_next] = SPACE_TEXT
    apo = points == 39
    c = {x: ord(x) for x in "stmdrevl"}
    out[apo & np.isin(n1, [c["s"], c["t"], c["m"], c["d"]])] = APO1
    out[apo & (((n1 == c["r"]) | (n1 == c["v"])) & (n2 == c["e"]) | (n1 == c["l"]) & (n2 == c["l"]))] = APO2
    out[kind == _END] = RESET
    return out


def piece_starts(points: np.ndarray) -> np.ndarray:
    """Mask of the positions where a piece (or a reset point) begins."""
    n = len(points)
    if not n:
        return np.zeros(0, bool)
    rows = -(-n // BLOCK)
    sym = np.full(rows * BLOCK, RESET, np.int64)
    sym[:n] = symbols(points)
    sym = np.ascontiguousarray(sym.reshape(rows, BLOCK).T) * STATES
    # 1. the function of each block: entry state -> exit state
    function = np.tile(np.arange(STATES, dtype=np.uint8), (rows, 1))
    for column in sym:
        function = _STEP_FLAT[column[:, None] + function]
    # 2. inclusive scan of the functions by doubling: composition is associative
    reach = 1
    while reach < rows:
        later = function.copy()
        later[reach:] = np.take_along_axis(function[reach:], function[:-reach].astype(np.int64), 1)
        function = later
        reach *= 2
    # 3. replay from the true entry states
    state = np.concatenate([[DONE], function[:-1, DONE]]).astype(np.uint8)
    begins = np.empty((BLOCK, rows), bool)
    for j, column in enumerate(sym):
        at = column + state
        begins[j] = _BEGINS_FLAT[at]
        state = _STEP_FLAT[at]
    return begins.T.ravel()[:n]


def pieces(texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
    """All pieces of all texts in order, the code point each begins at in its text, and the number of pieces per text."""
    joined = "\x00".join(texts) + "\x00"
    points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    ends = np.cumsum([len(t) + 1 for t in texts]) - 1
    points[ends] = _RESET_POINT
    at = np.flatnonzero(piece_starts(points))
    real = points[at] != _RESET_POINT
    starts, stops = at[real], np.append(at[1:], len(points))[real]
    per_text = np.diff(np.searchsorted(starts, ends), prepend=0)
    begin = np.concatenate([[0], ends[:-1] + 1])
    return [joined[a:b] for a, b in zip(starts.tolist(), stops.tolist(), strict=True)], starts - np.repeat(begin, per_text), per_text


def read_ranks(data: bytes) -> dict[bytes, int]:
    """The ranks of a .tiktoken file."""
    return {base64.b64decode(a): int(b) for a, b in map(bytes.split, data.splitlines()) if a}


class Merger(dict):
    """piece -> ids, merged on first sight and cached; emptied when it holds CACHE pieces."""

    def __init__(self, ranks: dict[bytes, int]):
        super().__init__()
        self.ranks = ranks

    def __missing__(self, piece: str) -> tuple[int, ...]:
        if len(self) >= CACHE:
            self.clear()
        ids = tuple(self.merge(piece.encode("utf-8", "surrogatepass")))
        self[piece] = ids
        return ids

    def merge(self, data: bytes) -> list[int]:
        whole = self.ranks.get(data)
        if whole is not None:
            return [whole]
        return self._merge_long(data) if len(data) > 64 else self._merge_short(data)

    def _merge_short(self, data: bytes) -> list[int]:
        ranks, parts = self.ranks, [data[i : i + 1] for i in range(len(data))]
        none = len(ranks) + 1
        scores = [ranks.get(a + b, none) for a, b in zip(parts, parts[1:], strict=False)]
        while scores:
            best = min(scores)
            if best == none:
                break
            i = scores.index(best)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            del scores[i]
            if i < len(scores):
                scores[i] = ranks.get(parts[i] + parts[i + 1], none)
            if i:
                scores[i - 1] = ranks.get(parts[i - 1] + parts[i], none)
        return [ranks[p] for p in parts]

    def _merge_long(self, data: bytes) -> list[int]:
        """The same with a heap and linked neighbours, for pieces of any length."""
        ranks, n = self.ranks, len(data)
        part: list[bytes | None] = [data[i : i + 1] for i in range(n)]
        right, left = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i, 2) for i in range(n - 1) if (r := ranks.get(data[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, size = heapq.heappop(heap)
            j = right[i] if part[i] is not None else n
            if j >= n or len(part[i]) + len(part[j]) != size:
                continue
            part[i], part[j] = part[i] + part[j], None
            right[i] = k = right[j]
            if k < n:
                left[k] = i
                if (r := ranks.get(part[i] + part[k])) is not None:
                    heapq.heappush(heap, (r, i, len(part[i]) + len(part[k])))
            if (h := left[i]) >= 0 and (r := ranks.get(part[h] + part[i])) is not None:
                heapq.heappush(heap, (r, h, len(part[h]) + len(part[i])))
        return [ranks[p] for p in part if p is not None]


def chunks(texts: list[str], limit: int = CHUNK) -> Iterator[list[str]]:
    """Runs of texts of about ``limit`` code points; a longer text is a run of its own."""
    run, size = [], 0
    for t in texts:
        if run and size + len(t) > limit:
            yield run
            run, size = [], 0
        run.append(t)
        size += len(t) + 1
    if run:
        yield run


def encode(texts: list[str], merger: Merger) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """ids of all texts, how many each text has, and the code point where each id's piece begins in its text."""
    ids, counts, offsets = [], [], []
    for run in chunks(texts):
        found, starts, per_text = pieces(run)
        got = [merger[p] for p in found]
        lengths = np.fromiter(map(len, got), np.int64, len(got))
        ids.append(np.fromiter(chain.from_iterable(got), np.int32, int(lengths.sum())))
        offsets.append(np.repeat(starts, lengths).astype(np.int32))
        total = np.concatenate([[0], np.cumsum(lengths)])
        counts.append(np.diff(total[np.concatenate([[0], np.cumsum(per_text)])]))
    if not ids:
        return np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int32)
    return np.concatenate(ids), np.concatenate(counts), np.concatenate(offsets)


def decode(ids: list[int], words: list[bytes]) -> str:
    return b"".join(words[i] for i in ids).decode("utf-8", "replace")
