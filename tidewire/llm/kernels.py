"""Vectorised hashing of the words and lines of Arrow string batches, used inside tasks for candidate search."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
#: The byte that stands for a run of digits.
_DIGITS = ord("0")

# A byte's form in a word: lower-case letter, _DIGITS, or 0 between words. Bytes beyond ASCII part words, as the case
# of their letters can't be told from one byte.
_FORM = np.zeros(256, np.uint8)
for _c in range(256):
    if chr(_c).isascii() and chr(_c).isalnum():
        _FORM[_c] = _DIGITS if chr(_c).isdigit() else ord(chr(_c).lower())

# The same with every byte beyond ASCII in words, for texts that ``words`` has folded.
_WIDE = np.where(np.arange(256) < 128, _FORM, np.arange(256)).astype(np.uint8)
#: Scripts written without spaces, whose letters count as words.
UNSPACED = r"[\p{Han}\p{Hiragana}\p{Katakana}\p{Thai}\p{Lao}\p{Khmer}\p{Myanmar}]"

_powers = np.ones((2, 1), np.uint64)


def _power(n: int) -> np.ndarray:
    """Powers of the base and of its inverse, up to n."""
    global _powers
    if _powers.shape[1] < n:
        p = np.empty((2, n), np.uint64)
        p[0], p[1] = _BASE, _INVERSE
        p[:, 0] = 1
        _powers = np.cumprod(p, axis=1, dtype=np.uint64)
    return _powers


def mix(x: np.ndarray) -> np.ndarray:
    """A hash whose every bit depends on every bit of x."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the n + 1 offsets of its rows; a null row is empty."""
    if column.null_count:
        column = column.fill_null("")
    if pa.types.is_large_string(column.type):
        width = np.int64
    else:
        column, width = column.cast(pa.string()), np.int32
    _, ends, data = column.buffers()
    offsets = np.frombuffer(ends, width, len(column) + 1, column.offset * np.dtype(width).itemsize).astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data else np.empty(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def by_size(batches: Iterator[pa.RecordBatch], column: str, most: int = 4_000_000) -> Iterator[pa.RecordBatch]:
    """The batches in slices of at most ``most`` bytes of text in ``column``, or of one row that is longer."""
    for batch in batches:
        _, offsets = text_bytes(batch.column(column))
        at = 0
        while at < len(batch):
            stop = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, "right")) - 1)
            yield batch.slice(at, stop - at)
            at = stop


@dataclass
class Words:
    """Words of some rows, in order: hash and row of each, and the number of rows."""

    code: np.ndarray
    row: np.ndarray
    rows: int


def words(column: pa.Array) -> Words:
    """Words of any script (runs of letters, marks and digits) in lower case with each run of ASCII digits as one, hashed
    to 64 bits. Where a script has no spaces every letter is a word. ASCII words have the codes of ``word_codes``."""
    column = pc.fill_null(column.cast(pa.string()), "")
    wide = pc.invert(pc.string_is_ascii(column))
    if pc.any(wide).as_py():
        folded = pc.utf8_lower(pc.utf8_normalize(column.filter(wide), "NFC"))
        folded = pc.replace_substring_regex(folded, r"[^\x00-\x7F\pL\pM\pN]+", " ")
        column = pc.replace_with_mask(column, wide, pc.replace_substring_regex(folded, f"({UNSPACED})", r" \1 "))
    return word_codes(*text_bytes(column), _WIDE)


def word_codes(data: np.ndarray, offsets: np.ndarray, forms: np.ndarray = _FORM) -> Words:
    """Words (runs of ASCII letters and digits) in lower case with each run of digits as one, hashed to 64 bits;
    ``offsets`` parts the rows."""
    n = len(offsets) - 1
    form = np.take(forms, data)
    digit = form == _DIGITS
    keep = np.ones(len(data), bool)
    keep[1:] = ~(digit[1:] & digit[:-1])
    keep[offsets[:-1][offsets[:-1] < len(data)]] = True
    offsets = np.r_[0, np.cumsum(keep)][offsets]
    form = form[keep]
    inside = form > 0
    before = np.r_[False, inside[:-1]] if len(inside) else inside
    before[offsets[:-1][offsets[:-1] < len(form)]] = False
    after = np.r_[inside[1:], False] if len(inside) else inside
    after[offsets[1:][offsets[1:] > 0] - 1] = False
    start, end = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after)
    power = _power(len(form) + 1)
    total = np.r_[np.uint64(0), np.cumsum(form * power[0, : len(form)], dtype=np.uint64)]
    code = mix((total[end + 1] - total[start]) * power[1][start])
    first = np.zeros(len(form) + 1, np.int32)
    first[start + 1] = 1
    return Words(code, np.repeat(np.arange(n), np.diff(np.cumsum(first)[offsets])), n)


def word_code(word: str) -> np.uint64:
    """The code that ``word_codes`` gives to one word."""
    raw = np.frombuffer(word.encode(), np.uint8)
    return word_codes(raw, np.array([0, len(raw)])).code[0]


def shingles(words: Words, size: int) -> Words:
    """Runs of ``size`` words; a row of fewer words has one shingle of all of them, a row of none has none."""
    row, code = words.row, words.code
    n = np.bincount(row, minlength=words.rows)
    have = np.minimum(n, size)
    first = np.r_[0, np.cumsum(n)[:-1]]
    out = np.zeros(len(code), np.uint64)
    for k in range(size):
        shifted = np.r_[code[k:], np.zeros(min(k, len(code)), np.uint64)]
        out = mix(out + np.where(k < have[row], shifted, np.uint64(k)) * np.uint64(2 * k + 3))
    place = np.arange(len(code)) - first[row]
    whole = place + have[row] <= n[row]
    return Words(out[whole], row[whole], words.rows)


def min_hashes(grams: Words, n: int) -> np.ndarray:
    """MinHash, rows by ``n``: the least code of each row under ``n`` permutations of 64-bit numbers.

    Two rows agree in a column with the probability of their Jaccard similarity. Rows without shingles have all ones.
    """
    out = np.full((grams.rows, n), np.uint64(0xFFFFFFFFFFFFFFFF))
    if len(grams.row):
        first = np.flatnonzero(np.r_[True, grams.row[1:] != grams.row[:-1]])
        seeds = mix(np.arange(1, n + 1, dtype=np.uint64))
        for k, (seed, factor) in enumerate(zip(seeds, mix(seeds) | np.uint64(1), strict=True)):
            code = (grams.code ^ seed) * factor
            out[grams.row[first], k] = np.minimum.reduceat(code ^ (code >> np.uint64(32)), first)
    return out


def bands(signature: np.ndarray, n: int) -> np.ndarray:
    """Hashes of ``n`` equal bands of a signature, rows by bands."""
    rows, bins = signature.shape
    out = np.empty((rows, n), np.uint64)
    for b in range(n):
        h = np.full(rows, np.uint64(b + 1))
        for k in range(b * (bins // n), (b + 1) * (bins // n)):
            h = mix(h * np.uint64(0x9E3779B97F4A7C15) + signature[:, k])
        out[:, b] = h
    return out
