"""Encoding a corpus with a public byte-level BPE vocabulary, long texts by tree concatenation."""

from __future__ import annotations

import os
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewire.llm import kernels as K

#: Texts of more than two pieces are encoded in pieces of about this many characters and joined as a tree.
PIECE = 1_024
#: Texts of more characters than this are so long that their pieces are spread over tasks.
SPREAD = 65_536
#: How far after its due place a cut may wait for a place where the pattern always splits.
SEEK = 256
#: Tokens on each side of a join in the first window; doubled until both sides agree.
WINDOW = 16

IDS = "doc_id bigint, ids array<int>"


@lru_cache(maxsize=4)
def _tokenizer(vocabulary: str):
    from tokenizers import Tokenizer

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    t = Tokenizer.from_file(vocabulary)
    t.encode_special_tokens = True
    return t


def _kind(c: str) -> str:
    return "space" if c.isspace() else "letter" if c.isalpha() else "number" if c.isnumeric() else "other"


def _splits(text: str, at: int) -> bool:
    """Whether the pattern splits before ``at`` whatever stands further left or right."""
    left, right = _kind(text[at - 1]), _kind(text[at])
    return left != right and (left in ("letter", "number") or right == "space" and left != "space")


def cut_text(text: str, piece: int = PIECE, seek: int = SEEK) -> list[str]:
    """``text`` in pieces of ``piece`` to ``piece + seek`` characters, cut where the pattern splits if such a place is near."""
    pieces, start = [], 0
    while len(text) - start > piece + seek:
        due = start + piece
        at = next((i for i in range(due, due + seek) if _splits(text, i)), due)
        pieces.append(text[start:at])
        start = at
    return [*pieces, text[start:]]


class Encoded:
    """A text, its ids, and the character at which each id's bytes begin and end."""

    __slots__ = ("text", "ids", "start", "end")

    def __init__(self, text: str, ids: np.ndarray, start: np.ndarray, end: np.ndarray):
        self.text, self.ids, self.start, self.end = text, ids, start, end

    @classmethod
    def of(cls, text: str, vocabulary: str) -> Encoded:
        return cls.all_of([text], vocabulary)[0]

    @classmethod
    def all_of(cls, texts: list[str], vocabulary: str) -> list[Encoded]:
        out = []
        for text, e in zip(texts, _tokenizer(vocabulary).encode_batch(texts, add_special_tokens=False), strict=True):
            spans = np.array(e.offsets, np.int64).reshape(-1, 2)
            out.append(cls(text, np.array(e.ids, np.int32), spans[:, 0], spans[:, 1]))
        return out


def join(a: Encoded, b: Encoded, vocabulary: str, window: int = WINDOW) -> Encoded:
    """The encoding of ``a.text + b.text``.

    Re-encodes a window of tokens around the join, wider and wider, until its first token is the one that ``a`` has
    there and its last the one that ``b`` has. Inside one run of the pattern, a sequence of tokens is the encoding if
    every two neighbours are the encoding of their own text; neighbours inside ``a``, ``b`` and the window are, and an
    agreeing edge token makes the pairs across the edges neighbours inside ``a`` and ``b``. At the left edge the window
    must begin, at the right edge end, where the pattern splits in any context or inside a run of one kind of
    characters. If none agrees, the window is the whole text.
    """
    if not len(a.ids) or not len(b.ids):
        return b if not len(a.ids) else a
    shift = len(a.text)

    def edge(text: str, at: int) -> bool:
        return 0 < at < len(text) and (_splits(text, at) or at > 1 and at + 1 < len(text) and len({_kind(c) for c in text[at - 2 : at + 2]}) == 1 and _kind(text[at]) != "other")

    w = window
    while True:
        i, j = max(0, len(a.ids) - w), min(len(b.ids), w) - 1
        left = int(a.start[i])
        right = int(b.end[j])
        whole_a, whole_b = i == 0, j == len(b.ids) - 1
        clean = (whole_a or a.end[i - 1] == left and edge(a.text, left)) and (whole_b or b.start[j + 1] == right and edge(b.text, right))
        if whole_a:
            left = 0
        if whole_b:
            right = len(b.text)
        if clean:
            m = Encoded.of(a.text[left:] + b.text[:right], vocabulary)
            if (whole_a or m.ids[0] == a.ids[i] and m.end[0] == a.end[i] - left) and (whole_b or m.ids[-1] == b.ids[j] and len(m.text) - m.start[-1] == right - b.start[j]):
                i = 0 if whole_a else i
                j = len(b.ids) - 1 if whole_b else j
                return Encoded(
                    a.text + b.text,
                    np.r_[a.ids[:i], m.ids, b.ids[j + 1 :]],
                    np.r_[a.start[:i], m.start + left, b.start[j + 1 :] + shift],
                    np.r_[a.end[:i], m.end + left, b.end[j + 1 :] + shift],
                )
        w *= 2


def tree(parts: list[Encoded], vocabulary: str, window: int = WINDOW) -> Encoded:
    """Neighbours joined level by level, so that a token is copied only as often as the tree is high."""
    while len(parts) > 1:
        pairs = [join(parts[k], parts[k + 1], vocabulary, window) for k in range(0, len(parts) - 1, 2)]
        parts = pairs + parts[len(parts) - len(parts) % 2 :]
    return parts[0]


def encode_ids(documents: DataFrame, vocabulary: str, piece: int = PIECE, window: int = WINDOW, spread: int = SPREAD) -> DataFrame:
    """(doc_id, ids): the ids of each ``text`` by the byte-level BPE file ``vocabulary``, without special tokens.

    Null and empty texts give an empty list. A text of more than two pieces is cut into pieces that are encoded on their
    own and joined as a tree; a shorter one is a single leaf. Texts of up to ``spread`` characters are whole in the task
    that reads them, without a shuffle; the pieces of longer ones are encoded by any task, and their document joins
    them. Strings of special tokens in a text are ordinary text. Repeated doc_ids with such long texts aren't supported,
    as doc_id is unique; other columns are ignored. No rows in, no rows out.
    """
    documents = documents.select("doc_id", "text")
    long = F.char_length("text") > max(spread, 2 * piece)
    ints = pa.list_(pa.int32())

    def here(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = _tokenizer(vocabulary)
        for batch in K.by_size(batches, "text"):
            texts = [x or "" for x in batch.column("text").to_pylist()]
            leaves = [k for k, x in enumerate(texts) if len(x) <= 2 * piece]
            ids: list = [None] * len(texts)
            for k, e in zip(leaves, t.encode_batch_fast([texts[k] for k in leaves], add_special_tokens=False), strict=True):
                ids[k] = e.ids
            cuts = {k: cut_text(x, piece, min(SEEK, piece)) for k, x in enumerate(texts) if ids[k] is None}
            found = iter(Encoded.all_of([p for parts in cuts.values() for p in parts], vocabulary))
            for k, parts in cuts.items():
                ids[k] = tree([next(found) for _ in parts], vocabulary, window).ids
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(ids, ints)], ["doc_id", "ids"])

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                cut = cut_text(text, piece, min(SEEK, piece))
                yield pa.RecordBatch.from_pydict({"doc_id": [doc] * len(cut), "k": list(range(len(cut))), "text": cut}, pa.schema([("doc_id", pa.int64()), ("k", pa.int32()), ("text", pa.string())]))

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = Encoded.all_of(batch.column("text").to_pylist(), vocabulary)
            columns = [pa.array([getattr(e, c).tolist() for e in found], ints) for c in ("ids", "start", "end")]
            yield pa.RecordBatch.from_arrays([*batch.columns, *columns], [*batch.schema.names, "ids", "start", "end"])

    def joined(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("k")
        parts = [Encoded(r.text, *(np.asarray(x) for x in (r.ids, r.start, r.end))) for r in pdf.itertuples()]
        return pd.DataFrame({"doc_id": [pdf.doc_id.iloc[0]], "ids": [tree(parts, vocabulary, window).ids]})

    direct = documents.filter(~F.coalesce(long, F.lit(False))).mapInArrow(here, IDS)
    parted = documents.filter(long).mapInArrow(pieces, "doc_id bigint, k int, text string").repartition("doc_id", "k")
    spans = parted.mapInArrow(encoded, "doc_id bigint, k int, text string, ids array<int>, start array<int>, end array<int>")
    return direct.unionByName(spans.groupBy("doc_id").applyInPandas(joined, IDS))
