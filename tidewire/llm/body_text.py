"""The article body of web pages: flat text blocks classified by a decision tree."""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import lru_cache
from importlib import resources

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.classification import DecisionTreeClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewire.llm import kernels as K
from tidewire.llm import residue

#: Pages of the labelled table that train the classifier, at most.
MOST_PAGES = 1_000
DEPTH = 8
#: Signs between links of a menu or a trail.
LINKS = r"[|>»›·•/]|\s[-–]\s|\S\s{2,}\S"
TERMINAL = r"[.!?][\"'”’)]*\s*$"
FOLDS = 4

LINE_FEATURES = ["words", "chars", "ended", "small_words", "links", "numbers", "commas", "bullet", "numbered", "quoted", "handle", "colon", "is_title", "names", "at_place", "two_names", "known", "score", "mean_score", "least_score"]
PLACE_FEATURES = ["place", "before_words", "before_ended", "before_links", "before_score", "after_words", "after_ended", "after_links", "after_score"]
FEATURES = LINE_FEATURES + PLACE_FEATURES

TRAINING = "title string, content string, labels string"


def _count(lines: pa.Array, pattern: str) -> np.ndarray:
    return pc.count_substring_regex(lines, pattern).to_numpy(zero_copy_only=False).astype(float)


def _has(lines: pa.Array, pattern: str) -> np.ndarray:
    return pc.match_substring_regex(lines, pattern).to_numpy(zero_copy_only=False).astype(float)


def _grams(lines: pa.Array) -> K.Words:
    """Words and pairs of words; capitalised words but the first are one, lines without small letters are made small."""
    shouted = pc.invert(pc.match_substring_regex(lines, "[a-z]"))
    plain = pc.replace_substring_regex(lines, r"([^\s\"“(]\s+)[A-Z][\w'’.-]*(?:\s+[A-Z][\w'’-]*)*", r"\1Nn")
    words = K.word_codes(*K.text_bytes(pc.if_else(shouted, pc.utf8_lower(lines), plain)))
    pairs = K.shingles(words, 2)
    return K.Words(np.r_[words.code, K.mix(pairs.code + np.uint64(1))], np.r_[words.row, pairs.row], words.rows)


class Scores:
    """How much a word or pair of words speaks for the body: log odds with one count added to each side."""

    def __init__(self, codes: np.ndarray, odds: np.ndarray):
        self.codes, self.odds = codes, odds

    @classmethod
    def of(cls, lines: pa.Array, body: np.ndarray) -> Scores:
        grams = _grams(lines)
        seen = np.unique(np.stack([grams.code, grams.row.astype(np.uint64)]), axis=1)
        codes, which = np.unique(seen[0], return_inverse=True)
        side = body[seen[1].astype(np.int64)]
        yes, no = np.bincount(which[side == 1], minlength=len(codes)), np.bincount(which[side == 0], minlength=len(codes))
        often = yes + no >= 2
        odds = np.log((yes + 1) / (body.sum() + 2)) - np.log((no + 1) / ((body == 0).sum() + 2))
        return cls(codes[often], odds[often])

    def of_lines(self, lines: pa.Array) -> tuple[np.ndarray, ...]:
        """For each line: the share of its words and pairs that are known, the sum, mean and least of their odds."""
        grams = _grams(lines)
        n = len(lines)
        at = np.minimum(np.searchsorted(self.codes, grams.code), max(len(self.codes) - 1, 0))
        known = self.codes[at] == grams.code if len(self.codes) else np.zeros(len(grams.code), bool)
        odds = self.odds[at[known]] if len(self.codes) else np.empty(0)
        row = grams.row[known]
        total, there = np.bincount(row, weights=odds, minlength=n), np.bincount(row, minlength=n)
        least = np.zeros(n)
        np.minimum.at(least, row, odds)
        return there / np.maximum(np.bincount(grams.row, minlength=n), 1), total, total / np.maximum(there, 1), least


def lines_of(content: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The lines of a batch of pages that have something to read, the page of each, and its number from 0."""
    parts = pc.split_pattern(content, "\n")
    n = pc.fill_null(pc.list_value_length(parts), 0).to_numpy(zero_copy_only=False)
    flat = pc.list_flatten(parts)
    page = np.repeat(np.arange(len(content)), n)
    number = np.arange(len(page)) - np.repeat(np.r_[0, np.cumsum(n)[:-1]], n) if len(page) else page
    keep = pc.match_substring_regex(flat, r"[^\s\x{85}\p{Z}\x0b\x1c-\x1f]").to_numpy(zero_copy_only=False)
    return flat.filter(pa.array(keep)), page[keep], number[keep]


def _neighbour(values: np.ndarray, page: np.ndarray, step: int) -> np.ndarray:
    """The value of the line before (-1) or after (1) on the same page; -1 at the edges."""
    out = np.full(len(values), -1.0)
    if len(values) > 1:
        same = page[1:] == page[:-1]
        if step > 0:
            out[:-1][same] = values[1:][same]
        else:
            out[1:][same] = values[:-1][same]
    return out


def features(lines: pa.Array, page: np.ndarray, titles: pa.Array, scores: Scores) -> np.ndarray:
    """The features of FEATURES for each line, rows by columns."""
    n = len(lines)
    words = _count(lines, r"\S+")
    normal = lambda a: pc.utf8_lower(pc.utf8_trim(pc.replace_substring_regex(a, r"\s+", " "), ' "'))
    title = pc.fill_null(titles, "").take(pa.array(page))
    known, total, mean, least = scores.of_lines(lines)
    f = {
        "words": words,
        "chars": pc.utf8_length(lines).to_numpy(zero_copy_only=False).astype(float),
        "ended": _has(lines, TERMINAL),
        "small_words": _count(lines, r"\b[a-z]{2,}") / np.maximum(words, 1),
        "links": _count(lines, LINKS) / np.maximum(words, 1),
        "numbers": _count(lines, r"[0-9]+"),
        "commas": _count(lines, ","),
        "bullet": _has(lines, r"^\s*[-*•–]\s"),
        "numbered": _has(lines, r"^\s*[0-9]+[.)]\s"),
        "quoted": _has(lines, r"^\s*[\"“].*[\"”]\s*$"),
        "handle": _has(lines, r"^\s*[a-z][\w.]*[0-9]*:\s"),
        "colon": _has(lines, r"^[^.]{2,40}:\s"),
        "is_title": pc.equal(normal(lines), normal(title)).to_numpy(zero_copy_only=False).astype(float),
        "names": np.maximum(_count(lines, r"\b[A-Z]") - 1, 0) / np.maximum(words, 1),
        "at_place": _has(lines, r"^(?:\S+ ){1,6}in [A-Z][\w'-]+(?: [A-Z][\w'-]+){0,2}\s*$"),
        "two_names": _has(lines, r"^\s*[A-Z][\w'’-]+ +[A-Z]"),
        "known": known,
        "score": total,
        "mean_score": mean,
        "least_score": least,
    }
    size = np.bincount(page, minlength=1)
    first = np.r_[0, np.cumsum(size)[:-1]]
    f["place"] = (np.arange(n) - first[page]) / np.maximum(size[page] - 1, 1) if n else np.empty(0)
    for name, step in (("before", -1), ("after", 1)):
        for what, of in (("words", "words"), ("ended", "ended"), ("links", "links"), ("score", "mean_score")):
            f[f"{name}_{what}"] = _neighbour(f[of], page, step)
    return np.stack([f[c] for c in FEATURES], axis=1)


class Tree:
    """A trained decision tree as arrays, applied to all lines of a batch level by level."""

    def __init__(self, feature: np.ndarray, threshold: np.ndarray, left: np.ndarray, right: np.ndarray, body: np.ndarray):
        self.feature, self.threshold, self.left, self.right, self.body = feature, threshold, left, right, body

    @classmethod
    def of(cls, model) -> Tree:
        rows: list[list[float]] = []

        def add(node) -> int:
            k = len(rows)
            rows.append([-1, 0.0, k, k, node.prediction()])
            if node.subtreeDepth() > 0:
                split = node.split()
                rows[k][:2] = [split.featureIndex(), split.threshold()]
                rows[k][2:4] = [add(node.leftChild()), add(node.rightChild())]
            return k

        add(model._java_obj.rootNode())
        table = np.array(rows)
        return cls(table[:, 0].astype(int), table[:, 1], table[:, 2].astype(int), table[:, 3].astype(int), table[:, 4] == 1)

    def of_rows(self, x: np.ndarray) -> np.ndarray:
        at = np.zeros(len(x), int)
        while len(x) and (inner := self.feature[at] >= 0).any():
            go = x[np.arange(len(x)), np.maximum(self.feature[at], 0)] <= self.threshold[at]
            at = np.where(inner, np.where(go, self.left[at], self.right[at]), at)
        return self.body[at]


@lru_cache(maxsize=1)
def labelled_pages() -> list[dict]:
    """The labelled table: title, content and, for each of its lines that isn't blank, 1 for body or 0."""
    text = resources.files("tidewire.llm").joinpath("labelled_pages.jsonl").read_text(encoding="utf-8")
    return [json.loads(line) for line in text.splitlines() if line]


def train(spark: SparkSession, pages: list[dict] | None = None, most: int = MOST_PAGES, depth: int = DEPTH) -> tuple[Scores, Tree]:
    """The classifier, from at most ``most`` labelled pages: word odds and a Spark ML decision tree over FEATURES.

    The odds that the tree sees for a page come from the other folds of pages, so that it learns how far to trust them.
    """
    pages = (labelled_pages() if pages is None else pages)[:most]
    lines, page, _ = lines_of(pa.array([p["content"] for p in pages], pa.string()))
    titles = pa.array([p["title"] for p in pages], pa.string())
    body = np.array([int(c) for p in pages for c in p["labels"]])
    x = np.empty((len(lines), len(FEATURES)))
    for fold in range(FOLDS):
        out = page % FOLDS == fold
        scores = Scores.of(lines.filter(pa.array(~out)), body[~out])
        x[out] = features(lines, page, titles, scores)[out]
    rows = [(float(y), [float(v) for v in r]) for y, r in zip(body, x, strict=True)]
    table = spark.createDataFrame(rows, "label double, x array<double>").select("label", array_to_vector("x").alias("features"))
    model = DecisionTreeClassifier(maxDepth=depth, minInstancesPerNode=5, maxBins=128, seed=42).fit(table.coalesce(1))
    return Scores.of(lines, body), Tree.of(model)


def _classified(batches: Iterator[pa.RecordBatch], scores: Scores, tree: Tree) -> Iterator[tuple[pa.RecordBatch, pa.Array, np.ndarray, np.ndarray, np.ndarray]]:
    """Slices of pages with their lines that have something to read, the page and number of each, and whether it is body."""
    for part in K.by_size(batches, "content", 2_000_000):
        lines, page, number = lines_of(part.column("content"))
        body = tree.of_rows(features(lines, page, part.column("title"), scores))
        body &= ~residue.covered(lines).to_numpy(zero_copy_only=False)
        yield part, lines, page, number, body


def _lines(pages: DataFrame, scores: Scores, tree: Tree, body: bool) -> DataFrame:
    def classify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, lines, page, number, inside in _classified(batches, scores, tree):
            hit = inside if body else ~inside
            ids = part.column("record_id").take(pa.array(page[hit]))
            yield pa.RecordBatch.from_arrays([ids, pa.array(number[hit], pa.int32()), lines.filter(pa.array(hit))], ["record_id", "line_no", "line"])

    pages = pages.filter(F.col("content").isNotNull()).select("record_id", "title", "content")
    return pages.mapInArrow(classify, "record_id bigint, line_no int, line string")


def body_lines(pages: DataFrame, scores: Scores, tree: Tree) -> DataFrame:
    """(record_id, line_no, line): the lines of each page's body, numbered from 0 as in ``content``.

    Features of a line come from it and its neighbours on the page, so pages are classified where they are read,
    without a shuffle. Lines made only of template residue are never body. Null and blank contents have no lines, lines
    of white space are never body, a null title is no line. Pages repeated under other ids each count; other columns
    are ignored.
    """
    return _lines(pages, scores, tree, True)


def other_lines(pages: DataFrame, scores: Scores, tree: Tree) -> DataFrame:
    """(record_id, line_no, line): the lines with something to read that ``body_lines`` doesn't give, so that every line
    of a page but those of white space alone is in one of the two."""
    return _lines(pages, scores, tree, False)


def body_texts(pages: DataFrame, scores: Scores, tree: Tree) -> DataFrame:
    """(record_id, body): the body of each page as one text; pages without any body line are left out.

    A page is whole where it is read, so its lines are put together there and nothing is shuffled.
    """

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, lines, page, _, inside in _classified(batches, scores, tree):
            ends = np.searchsorted(page[inside], np.arange(len(part) + 1))
            body = pc.binary_join(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), lines.filter(pa.array(inside)).cast(pa.string())), "\n")
            some = pa.array(np.diff(ends) > 0)
            yield pa.RecordBatch.from_arrays([part.column("record_id").filter(some), body.filter(some)], ["record_id", "body"])

    pages = pages.filter(F.col("content").isNotNull()).select("record_id", "title", "content")
    return pages.mapInArrow(whole, "record_id bigint, body string")
