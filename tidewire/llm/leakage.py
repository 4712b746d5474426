"""Passages of evaluation items in a corpus: SimHash windows, multi-index Hamming search, exact verification."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewire.session import cut

#: Longest runs of letters and digits of any script.
WORDS = regex.compile(r"[\p{L}\p{N}]+")
ASCII_WORDS = re.compile(r"[A-Za-z0-9]+")
#: Words in a window. A shared run of so many words is a window that both texts have.
SPAN = 12
#: Fingerprints up to this many bits apart are candidates; RADIUS + 1 blocks of bits guarantee that all are found.
RADIUS = 3
#: Items of up to so many bytes of text are indexed in each task (about 100 MB); the windows of more are joined.
INDEX_BYTES = 4_000_000

#: Words whose windows are hashed at once.
AT_ONCE = 50_000

FOUND = "doc_id bigint, item_id bigint, similarity double, shared_run int"


def words(text: str | None) -> list[str]:
    """The words of ``text`` in lower case."""
    if not text:
        return []
    return (ASCII_WORDS if text.isascii() else WORDS).findall(text.lower())


def word_codes(found: list[str], known: dict[str, int]) -> np.ndarray:
    """64-bit codes of words; ``known`` keeps those met before."""
    for w in found:
        if w not in known:
            known[w] = xxhash.xxh3_64_intdigest(w)
    return np.fromiter((known[w] for w in found), np.uint64, len(found))


def simhashes(codes: np.ndarray, span: int) -> np.ndarray:
    """SimHash of each window of ``span`` words: for each bit, whether most of the window's words have it."""
    if len(codes) < span:
        return np.empty(0, np.uint64)
    bits = np.unpackbits(codes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    total = np.zeros((len(codes) + 1, 64), np.int16)  # sums may wrap around, their differences don't
    np.cumsum(bits, axis=0, out=total[1:], dtype=np.int16)
    most = (total[span:] - total[:-span]) * 2 > span
    return np.packbits(most, axis=1, bitorder="little").view(np.uint64).ravel()


class Index:
    """Windows of the evaluation items, findable by each of ``radius + 1`` blocks of their fingerprints."""

    def __init__(self, item: np.ndarray, codes: np.ndarray, start: np.ndarray, prints: np.ndarray, radius: int):
        self.item, self.codes, self.start, self.prints, self.radius = item, codes, start, prints, radius
        cuts = np.linspace(0, 64, radius + 2).astype(int)
        self.blocks = []
        for low, high in zip(cuts[:-1], cuts[1:], strict=True):
            mask, shift = np.uint64((1 << (high - low)) - 1), np.uint64(low)
            key = (prints >> shift) & mask
            order = np.argsort(key, kind="stable")
            self.blocks.append((shift, mask, key[order], order))

    @classmethod
    def of(cls, items: list[tuple[int, str | None]], span: int, radius: int) -> Index:
        known: dict[str, int] = {}
        item, codes, start, prints, at = [], [], [], [], 0
        for number, text in items:
            c = word_codes(words(text), known)
            p = simhashes(c, span)
            item.append(np.full(len(p), number, np.int64))
            start.append(np.arange(len(p)) + at)
            codes.append(c)
            prints.append(p)
            at += len(c)
        none = [np.empty(0, np.uint64)]
        return cls(np.concatenate([np.empty(0, np.int64), *item]), np.concatenate(none + codes), np.concatenate([np.empty(0, np.int64), *start]), np.concatenate(none + prints), radius)

    def near(self, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (position in ``prints``, window of the index) at most ``radius`` bits apart, each once."""
        left, right = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        for shift, mask, keys, order in self.blocks:
            k = (prints >> shift) & mask
            low = np.searchsorted(keys, k, "left")
            n = np.searchsorted(keys, k, "right") - low
            at = np.repeat(np.arange(len(prints)), n)
            slot = np.repeat(low - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(n.sum())
            window = order[slot]
            close = np.bitwise_count(prints[at] ^ self.prints[window]) <= self.radius
            left.append(at[close])
            right.append(window[close])
        pairs = np.unique(np.concatenate(left) * len(self.prints) + np.concatenate(right)) if len(self.prints) else np.empty(0, np.int64)
        return (pairs // len(self.prints), pairs % len(self.prints)) if len(pairs) else (left[0], right[0])


def _similarity(a: np.ndarray, b: np.ndarray, span: int) -> np.ndarray:
    """Weighted Jaccard similarity of the two-word shingles of windows (rows of ``a`` and ``b``), weights being counts."""
    x = np.sort(a[:, :-1] * np.uint64(0x9E3779B97F4A7C15) + a[:, 1:], axis=1)
    y = np.sort(b[:, :-1] * np.uint64(0x9E3779B97F4A7C15) + b[:, 1:], axis=1)
    i = np.zeros(len(x), np.int64)
    j = np.zeros(len(x), np.int64)
    common = np.zeros(len(x), np.int64)
    rows, last = np.arange(len(x)), span - 2
    for _ in range(2 * (span - 1)):
        live = (i <= last) & (j <= last)
        u, v = x[rows, np.minimum(i, last)], y[rows, np.minimum(j, last)]
        same = live & (u == v)
        common += same
        i += live & (u <= v)
        j += live & (v <= u)
    return common / (2 * (span - 1) - common)


def _joined(batch: pa.RecordBatch, known: dict[str, int], span: int) -> Iterator[tuple[list, np.ndarray, np.ndarray, int, bool]]:
    """The documents of a batch in groups of about AT_ONCE words: their ids, the codes of their words one after the other,
    the document of each word, the place of the first word, and whether the group's documents end here.

    A longer document comes in several groups of its own that share ``span - 1`` words, so that each of its windows is
    whole in just one of them."""
    docs, parts, size = [], [], 0

    def group() -> tuple[list, np.ndarray, np.ndarray, int, bool]:
        return docs, np.concatenate(parts), np.repeat(np.arange(len(parts)), [len(p) for p in parts]), 0, True

    for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
        if len(known) > 1_000_000:
            known.clear()
        codes = word_codes(words(text.as_py()), known)
        if len(codes) > AT_ONCE + span:
            starts = range(0, len(codes) - span + 1, AT_ONCE)
            for start in starts:
                part = codes[start : start + AT_ONCE + span - 1]
                yield [doc], part, np.zeros(len(part), np.int64), start, start == starts[-1]
            continue
        docs.append(doc)
        parts.append(codes)
        size += len(codes)
        if size >= AT_ONCE:
            yield group()
            docs, parts, size = [], [], 0
    if docs:
        yield group()


def _search(items: list[tuple[int, str | None]], span: int, radius: int, least: float):
    """A function over Arrow batches of documents that yields the items of ``items`` found in them."""

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Index.of(items, span, radius)
        known: dict[str, int] = {}
        step = np.arange(span)
        for batch in batches:
            out: list[tuple] = []
            held: list[tuple[np.ndarray, ...]] = []
            for docs, codes, doc, first, last in _joined(batch, known, span):
                prints = simhashes(codes, span)
                start = np.flatnonzero(doc[: len(prints)] == doc[span - 1 :]) if len(prints) else np.empty(0, np.int64)  # windows inside one document
                near, window = index.near(prints[start])
                at = start[near]
                a = codes[at[:, None] + step]
                b = index.codes[index.start[window][:, None] + step]
                equal = (a == b).all(axis=1)
                likeness = np.where(equal, 1.0, _similarity(a, b, span))
                keep = likeness >= least
                held.append((doc[at][keep], at[keep] + first, window[keep], equal[keep], likeness[keep]))
                if not last:
                    continue
                doc_at, at, window, equal, likeness = (np.concatenate(x) for x in zip(*held, strict=True))
                held = []
                if len(at):
                    pair, which = np.unique(np.stack([doc_at, index.item[window]]), axis=1, return_inverse=True)
                    which = which.ravel()
                    best = np.zeros(pair.shape[1])
                    np.maximum.at(best, which, likeness)
                    runs = _runs(at[equal], index.start[window][equal], which[equal], span)
                    out += [(docs[d], int(item), float(best[k]), runs.get(k, 0)) for k, (d, item) in enumerate(pair.T.tolist())]
            yield pa.RecordBatch.from_pylist([dict(zip(("doc_id", "item_id", "similarity", "shared_run"), r, strict=True)) for r in out], _SCHEMA)

    return search


def windows(texts: DataFrame, key: str, span: int) -> DataFrame:
    """(key, at, print, codes): every window of ``span`` words of each text: its place, SimHash and word codes."""
    schema = pa.schema([(key, pa.int64()), ("at", pa.int64()), ("print", pa.int64()), ("codes", pa.binary(8 * span))])

    def cut_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, int] = {}
        for batch in batches:
            batch = batch.rename_columns(["doc_id", "text"])
            for ids, codes, doc, first, _ in _joined(batch, known, span):
                prints = simhashes(codes, span)
                if not len(prints):
                    continue
                start = np.flatnonzero(doc[: len(prints)] == doc[span - 1 :])
                begin = np.searchsorted(doc, doc[start])
                data = pa.py_buffer(np.ascontiguousarray(codes[start[:, None] + np.arange(span)]))
                columns = [pa.array(ids, pa.int64()).take(pa.array(doc[start])), pa.array(start - begin + first), pa.array(prints[start].view(np.int64)), pa.Array.from_buffers(pa.binary(8 * span), len(start), [None, data])]
                yield pa.RecordBatch.from_arrays(columns, schema=schema).cast(pa.schema([*list(schema)[:3], ("codes", pa.binary())]))

    return texts.select(key, "text").mapInArrow(cut_up, f"{key} bigint, at bigint, print bigint, codes binary")


def _joined_windows(documents: DataFrame, items: DataFrame, span: int, radius: int, least: float) -> DataFrame:
    """``leaks`` by a join of windows on a block's number and its bits, for any number of items; adaptive execution splits
    the rows of a frequent block. A pair of windows that meets in several blocks counts in the first."""
    cuts = np.linspace(0, 64, radius + 2).astype(int)
    bits = [(F.shiftrightunsigned("print", int(low)).bitwiseAND(F.lit((1 << int(high - low)) - 1))) for low, high in zip(cuts[:-1], cuts[1:], strict=True)]
    blocks = lambda: F.posexplode(F.array(*bits)).alias("block", "bits")
    left = windows(documents, "doc_id", span).select("doc_id", "at", "print", "codes", blocks())
    right = windows(items, "item_id", span).select("item_id", F.col("at").alias("start"), F.col("print").alias("other"), F.col("codes").alias("other_codes"), blocks())
    apart = F.col("print").bitwiseXOR(F.col("other"))
    met = left.join(right, ["block", "bits"]).filter(F.bit_count(apart) <= radius)
    for k in range(1, radius + 1):
        before = F.lit(False)
        for low, high in zip(cuts[:k], cuts[1 : k + 1], strict=True):
            before = before | (F.shiftrightunsigned(apart, int(low)).bitwiseAND(F.lit((1 << int(high - low)) - 1)) == 0)
        met = met.filter((F.col("block") != k) | ~before)

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint64).reshape(-1, span) for c in ("codes", "other_codes"))
            equal = (a == b).all(axis=1)
            likeness = np.where(equal, 1.0, _similarity(a, b, span))
            columns = [*(batch.column(c) for c in ("doc_id", "item_id", "at", "start")), pa.array(equal), pa.array(likeness)]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "item_id", "at", "start", "equal", "similarity"]).filter(pa.array(likeness >= least))

    found = cut(met.select("doc_id", "item_id", "at", "start", "codes", "other_codes").mapInArrow(verify, "doc_id bigint, item_id bigint, at bigint, start bigint, equal boolean, similarity double"))
    pair = ["doc_id", "item_id"]
    diagonal = Window.partitionBy(*pair, F.col("start") - F.col("at")).orderBy("at")
    runs = found.filter("equal").select(*pair, (F.col("start") - F.col("at")).alias("diagonal"), (F.col("at") - F.row_number().over(diagonal)).alias("run"))
    runs = runs.groupBy(*pair, "diagonal", "run").agg(F.count(F.lit(1)).alias("n")).groupBy(*pair).agg((F.max("n") + span - 1).cast("int").alias("shared_run"))
    best = found.groupBy(*pair).agg(F.max("similarity").alias("similarity"))
    return best.join(runs, pair, "left").select(*pair, "similarity", F.coalesce("shared_run", F.lit(0)).alias("shared_run"))


_SCHEMA = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("similarity", pa.float64()), ("shared_run", pa.int32())])


def _runs(at: np.ndarray, start: np.ndarray, item: np.ndarray, span: int) -> dict[int, int]:
    """The longest run of shared words of each item: equal windows that follow each other on one diagonal."""
    longest: dict[int, int] = {}
    order = np.lexsort((at, start - at, item))
    at, diagonal, item = at[order], (start - at)[order], item[order]
    new = np.r_[True, (np.diff(at) != 1) | (np.diff(diagonal) != 0) | (np.diff(item) != 0)] if len(at) else np.empty(0, bool)
    first = np.flatnonzero(new)
    for i, n in zip(item[first], np.diff(np.r_[first, len(at)]), strict=True):
        longest[int(i)] = max(longest.get(int(i), 0), int(n) + span - 1)
    return longest


def leaks(documents: DataFrame, items: DataFrame, span: int = SPAN, radius: int = RADIUS, least: float = 0.5, index_bytes: int = INDEX_BYTES) -> DataFrame:
    """Documents that hold passages of items: (doc_id, item_id, similarity, shared_run).

    A row is a document and an item with windows of ``span`` words whose SimHashes are at most ``radius`` bits apart
    and whose word pairs have a weighted Jaccard similarity of ``least`` or more; ``similarity`` is the greatest,
    ``shared_run`` the longest run of words that both have (0 if shorter than ``span``). Equal windows have equal
    SimHashes and the blocks of bits find all fingerprints within the radius, so no run of ``span`` words is missed.
    Items of up to ``index_bytes`` of text travel to the tasks as an index, and the corpus is read once and never
    shuffled. Of more items, the windows are joined with those of the corpus on a block's number and bits, and nothing
    passes through the driver. Null, empty and shorter texts have no windows and give no rows; repeated items each count.
    Other columns are ignored.
    """
    documents, items = documents.select("doc_id", "text"), items.select("item_id", "text")
    size = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)) + 100 * F.count(F.lit(1))).first()[0]
    if size > index_bytes:
        return _joined_windows(documents, items, span, radius, least)
    listed = [(r.item_id, r.text) for r in items.collect()]
    found = documents.mapInArrow(_search(listed, span, radius, least), FOUND)
    best = (F.max(c).alias(c) for c in ("similarity", "shared_run"))
    return found.groupBy("doc_id", "item_id").agg(*best)


def shared_runs(found: DataFrame, least: int = SPAN) -> DataFrame:
    """(doc_id, item_id) of documents and items that share a run of at least ``least`` words."""
    return found.filter(F.col("shared_run") >= least).select("doc_id", "item_id")
