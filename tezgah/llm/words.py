"""Words of many texts at once, as numpy arrays.

A word is a maximal run of letters and digits after folding: lower case, diacritics removed (all four Turkish i are one
letter), apostrophes, zero-width characters and combining marks dropped, everything else a separator. Texts are
decoded from the Arrow buffer as a whole; no Python object is made per text or word.
"""

from __future__ import annotations

import ctypes
import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SEPARATOR, DROPPED = 0, 1
#: Characters that join the parts of a word.
JOINERS = "'’‘`´ʼ"
_BASE = 0x9E3779B97F4A7C15
_table: np.ndarray | None = None
_powers = np.ones(1, np.uint64)
_inverse = np.ones(1, np.uint64)


def _fold(ch: str) -> int:
    if ch in JOINERS:
        return DROPPED
    kind = unicodedata.category(ch)
    if kind in ("Mn", "Me", "Cf"):
        return DROPPED
    if ch == "ı":
        return ord("i")
    if not (kind[0] == "L" or kind[0] == "N"):
        return SEPARATOR
    for c in unicodedata.normalize("NFKD", ch):
        if unicodedata.category(c)[0] in "LN":
            c = c.lower()[0]
            return ord("i") if c == "ı" else min(ord(c), 0xFFFF)
    return SEPARATOR


def table() -> np.ndarray:
    """Of each code point of the basic plane, the folded one, or SEPARATOR or DROPPED."""
    global _table
    if _table is None:
        try:  # freed arrays stay with the process, else each new one costs page faults
            libc = ctypes.CDLL(None)
            libc.mallopt(-3, 1 << 30)
            libc.mallopt(-1, 1 << 29)
        except (OSError, AttributeError):
            pass
        _table = np.array([_fold(chr(c)) if not 0xD800 <= c < 0xE000 else 0 for c in range(0x10000)], np.uint16)
    return _table


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers, modulo 2^64, of the odd base of the word hashes, and of its inverse."""
    global _powers, _inverse
    if len(_powers) < n:
        one = np.ones(1, np.uint64)
        m = max(1 << 16, n + n // 2)
        _powers = np.concatenate([one, np.cumprod(np.full(m, _BASE, np.uint64))])
        _inverse = np.concatenate([one, np.cumprod(np.full(m, pow(_BASE, -1, 1 << 64), np.uint64))])
    return _powers, _inverse


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words with good avalanche (the finaliser of splitmix64)."""
    with np.errstate(over="ignore"):
        h = h.astype(np.uint64)
        h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return h ^ (h >> np.uint64(31))


@dataclass
class Words:
    """Words in the order of the texts. ``row``: index of the text; ``first``: of each text, its first word (n + 1 values);
    word k stands at ``at[k]`` to ``end[k]`` of the folded code points ``code`` of all texts."""

    row: np.ndarray
    first: np.ndarray
    hash: np.ndarray
    code: np.ndarray
    at: np.ndarray
    end: np.ndarray

    def word(self, k: int) -> str:
        return "".join(map(chr, (c for c in self.code[self.at[k] : self.end[k]].tolist() if c != DROPPED)))

    def strings(self) -> list[str]:
        """All words, in order."""
        code = self.code[self.code != DROPPED].astype(np.uint32)
        code[code == SEPARATOR] = 32
        return [w for w in code.tobytes().decode("utf-32-le").split(" ") if w]


def words(texts: pa.Array) -> Words:
    """Nulls count as empty texts."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = pc.fill_null(texts, "")
    n = len(texts)
    sizes = np.asarray(pc.utf8_length(texts).to_numpy(zero_copy_only=False), np.int64)
    points = np.frombuffer("\n".join(["", *texts.to_pylist(), ""]).encode("utf-32-le"), np.uint32)
    text_at = np.cumsum(np.concatenate([[1], sizes + 1]))
    if len(points) and points.max() > 0xFFFF:  # few letters lie beyond the basic plane; the rest of it separates
        far = points > 0xFFFF
        code = table()[np.where(far, 0, points)]
        for c in np.unique(points[far]):
            code[points == c] = 0x4000 | (int(c) & 0x3FFF) if unicodedata.category(chr(c))[0] in "LN" else SEPARATOR
    else:
        code = table()[points]
    inside = code != SEPARATOR
    turn = np.flatnonzero(inside[1:] != inside[:-1]) + 1  # texts lie between separators
    at, end = turn[0::2], turn[1::2]
    letter = code > DROPPED
    count = np.cumsum(letter, dtype=np.int32)
    power, inverse = powers(int(count[-1]) + 2)
    value = np.cumsum(np.where(letter, code, 0).astype(np.uint64) * power[count])
    if len(at):
        some = count[end - 1] > count[at - 1]  # more than marks and apostrophes
        at, end = at[some], end[some]
    h = mix((value[end - 1] - value[at - 1]) * inverse[count[at - 1]])
    first = np.searchsorted(at, text_at)
    return Words(np.repeat(np.arange(n, dtype=np.int32), np.diff(first)), first, h, code, at, end)


def slices(batch: pa.RecordBatch, column: str, points: int = 1_500_000) -> Iterator[pa.RecordBatch]:
    """Cuts a batch so that no slice has more bytes of text than that, unless one text alone has them. No row is lost."""
    sizes = np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False), np.int64)
    group = np.cumsum(sizes) // points
    cuts = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), batch.num_rows]
    for a, b in zip(cuts, cuts[1:]):
        if b > a:
            yield batch.slice(a, b - a)


def one(text: str | None) -> list[str]:
    """The words of one text, as strings; for tests and exact checks."""
    w = words(pa.array([text], pa.string()))
    return [w.word(k) for k in range(len(w.hash))]


def near(a: str, b: str) -> bool:
    """The same word but for a slip of a letter or two (one in words under six letters, none under four; digits don't slip). A
    slip is a letter put in, left out or exchanged, or two neighbours that changed places."""
    if a == b:
        return True
    m, n = len(a), len(b)
    most = 0 if min(m, n) < 4 else 1 if min(m, n) < 6 else 2
    if not most or abs(m - n) > most or a.isdigit() or b.isdigit():
        return False
    while a and b and a[0] == b[0]:
        a, b = a[1:], b[1:]
    while a and b and a[-1] == b[-1]:
        a, b = a[:-1], b[:-1]
    m, n = len(a), len(b)
    if max(m, n) <= most:
        return True
    if max(m, n) > 3 * most:  # two slips apart, with what lies between them
        common = Counter(a) & Counter(b)
        if max(m, n) - sum(common.values()) > most:
            return False
    before2, before = None, list(range(n + 1))
    for i in range(1, m + 1):
        row = [i] * (n + 1)
        for j in range(1, n + 1):
            row[j] = min(before[j] + 1, row[j - 1] + 1, before[j - 1] + (a[i - 1] != b[j - 1]))
            if before2 and i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                row[j] = min(row[j], before2[j - 2] + 1)
        if min(row) > most:
            return False
        before2, before = before, row
    return before[n] <= most


def near_many(left: list[str], right: list[str]) -> np.ndarray:
    """Of each pair of different words, whether they are the same but for a slip. All pairs of a length class go through the
    distance table together; only its five diagonals around the main one can hold two slips or fewer."""
    m, n = (np.fromiter(map(len, x), np.int64, len(x)) for x in (left, right))
    short = np.minimum(m, n)
    most = np.where(short < 4, 0, np.where(short < 6, 1, 2))
    digits = np.fromiter((a.isdigit() or b.isdigit() for a, b in zip(left, right)), bool, len(left))
    out = np.zeros(len(left), bool)
    some = np.flatnonzero((most > 0) & (np.abs(m - n) <= most) & ~digits)
    if not len(some):
        return out
    size = np.maximum(m, n)[some]
    for lo, hi in ((0, 12), (12, 24), (24, 1 << 40)):
        at = some[(size > lo) & (size <= hi)]
        if len(at):
            out[at] = _distances([left[i] for i in at], [right[i] for i in at], m[at], n[at]) <= most[at]
    return out


def _distances(left: list[str], right: list[str], m: np.ndarray, n: np.ndarray) -> np.ndarray:
    wide = int(max(m.max(), n.max()))
    a, b = (np.array(x, f"<U{wide}").view(np.uint32).reshape(len(x), wide) for x in (left, right))
    far = np.int16(99)
    rows = [np.full((len(left), 5), far, np.int16) for _ in range(3)]
    out = np.full(len(left), far, np.int16)
    for i in range(wide + 1):
        now, before, before2 = rows[i % 3], rows[(i - 1) % 3], rows[(i - 2) % 3]
        for t in range(5):
            j = i + t - 2
            if j < 0 or j > wide:
                now[:, t] = far
                continue
            if i == 0 or j == 0:
                now[:, t] = i + j
                continue
            best = before[:, t] + (a[:, i - 1] != b[:, j - 1])
            if t < 4:
                best = np.minimum(best, before[:, t + 1] + 1)
            if t > 0:
                best = np.minimum(best, now[:, t - 1] + 1)
            if i > 1 and j > 1:
                turned = (a[:, i - 1] == b[:, j - 2]) & (a[:, i - 2] == b[:, j - 1])
                best = np.where(turned, np.minimum(best, before2[:, t] + 1), best)
            now[:, t] = best
        ends = np.flatnonzero(m == i)
        if len(ends):
            out[ends] = now[ends, (n - m)[ends] + 2]
    return out
