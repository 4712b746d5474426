"""Lines that repeat across the documents of one source."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewire.llm import kernels as K
from tidewire.session import cut

#: A line repeats if it is on at least LEAST urls of its source and on at least one in ONE_IN of all of them.
LEAST = 3
ONE_IN = 25
#: Up to this many buckets (about 40 MB) are broadcast; more are joined by shuffling.
BROADCAST_BUCKETS = 1_000_000
#: Per-source figures of up to this many sources are broadcast (about 40 MB); more are joined by shuffling.
BROADCAST_SOURCES = 500_000
#: Words, in normal form, whose meaning a line keeps if they are changed.
DATE_WORDS = "january february march april may june july august september october november december monday tuesday wednesday thursday friday saturday sunday januari februari mac mei jun julai ogos oktober disember isnin selasa rabu khamis jumaat sabtu ahad".split()
NAME_MARKS = ["by", "oleh"]

WHITE = r"[\s\x0b\x1c-\x1f\x{85}\p{Z}]+"


def normal_lines(lines: pa.Array) -> pa.Array:
    """The form in which lines are compared: trimmed, runs of white space as a blank, lower case, numbers as '#'."""
    out = pc.replace_substring_regex(lines, WHITE, " ")
    out = pc.utf8_lower(pc.utf8_trim(out, " "))
    return pc.replace_substring_regex(out, r"[0-9]+", "#")


def _lines(content: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All lines of a batch and the row of each; a null content has none."""
    parts = pc.split_pattern(content, "\n")
    n = pc.fill_null(pc.list_value_length(parts), 0).to_numpy(zero_copy_only=False)
    return pc.list_flatten(parts), np.repeat(np.arange(len(content)), n)


def _buckets(lines: pa.Array, row: np.ndarray, source: np.ndarray, source_words: K.Words) -> np.ndarray:
    """A bucket of each line within its source: two MinHash values of its masked pairs of words.

    Numbers, months, weekdays, the words of the source's own name and up to three words after an author mark are
    masked. Equal normal forms have equal words, so they share a bucket; similar lines likely do.
    """
    data, offsets = K.text_bytes(lines)
    words = K.word_codes(data, offsets)
    code = words.code.copy()
    code[np.isin(code, _DATES)] = np.uint64(1)
    own = np.isin(K.mix(code ^ K.mix(row[words.row].astype(np.uint64) + np.uint64(7))), K.mix(source_words.code ^ K.mix(source_words.row.astype(np.uint64) + np.uint64(7))))
    mark = np.isin(words.code, _MARKS)
    for k in range(1, 4):
        after = np.r_[np.zeros(min(k, len(mark)), bool), mark[:-k]] if len(mark) else mark
        own |= after & (np.r_[np.full(min(k, len(mark)), -1), words.row[:-k]] == words.row if len(mark) else mark)
    code[own] = np.uint64(2)
    signature = K.min_hashes(K.shingles(K.Words(code, words.row, words.rows), 2), 2)
    return K.mix(K.bands(signature, 1)[:, 0] ^ source[row]).view(np.int64)


_DATES = np.array([K.word_code(w) for w in DATE_WORDS])
_MARKS = np.array([K.word_code(w) for w in NAME_MARKS])


def _batch_buckets(batch: pa.RecordBatch) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    lines, row = _lines(batch.column("content"))
    names = K.word_codes(*K.text_bytes(batch.column("source_name")))
    source = batch.column("source").to_numpy().astype(np.int64).view(np.uint64)
    return lines, row, _buckets(lines, row, source, names)


def _weights(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in K.by_size(batches, "content"):
        _, row, bucket = _batch_buckets(batch)
        weight = 1.0 / batch.column("need").to_numpy()[row]
        yield pa.RecordBatch.from_arrays([pa.array(bucket), pa.array(weight)], ["bucket", "weight"])


def _candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in K.by_size(batches, "content"):
        lines, row, bucket = _batch_buckets(batch)
        text = normal_lines(lines)
        keep = pc.not_equal(text, "")
        row = pa.array(row)
        columns = [*(batch.column(c).take(row) for c in ("source_name", "link", "urls")), text, pa.array(bucket)]
        yield pa.RecordBatch.from_arrays([c.filter(keep) for c in columns], ["source_name", "link", "urls", "line", "bucket"])


def _sized(pages: DataFrame, least: int, one_in: int) -> DataFrame:
    """Pages of named sources with a hash of source and url, the source's urls and how many a line needs."""
    named = pages.filter((F.col("source_name") != "N/A") & F.col("source_name").isNotNull())
    urls = named.groupBy("source_name").agg(F.count_distinct("url").alias("urls"))
    urls = urls.withColumn("need", F.greatest(F.lit(float(least)), F.col("urls") / one_in)).filter(F.col("urls") >= least)
    if urls.count() <= BROADCAST_SOURCES:
        urls = F.broadcast(urls)
    pages = named.filter(F.col("content").isNotNull() & F.col("url").isNotNull()).select(
        "source_name", "content", F.xxhash64("source_name").alias("source"), F.xxhash64("url").alias("link")
    )
    return pages.join(urls, "source_name")


def repeated_lines(pages: DataFrame, least: int = LEAST, one_in: int = ONE_IN) -> DataFrame:
    """Lines in normal form that are on at least ``least`` urls and one in ``one_in`` of all urls of their source.

    ``pages`` has source_name, url and content. Output: source_name, line, n_urls, urls (of the source, those with null
    content included). First every line of every page adds its share of the needed count to its bucket within the
    source (a locality-sensitive hash of the masked line), summed on the map side, so hot lines shuffle as one row per
    task. Then only lines of buckets that reach the needed count are counted by url exactly. As a bucket holds all copies
    of a line, no line is missed. Pages without source ('N/A' or null), url or content add no lines; lines of white
    space are left out. Empty input gives empty output; extra columns are ignored.
    """
    sized = _sized(pages.select("source_name", "url", "content"), least, one_in)
    heavy = cut(
        sized.mapInArrow(_weights, "bucket bigint, weight double")
        .groupBy("bucket")
        .agg(F.sum("weight").alias("reached"))
        .filter(F.col("reached") >= 1 - 1e-6)
        .select("bucket")
    )
    if heavy.count() <= BROADCAST_BUCKETS:
        heavy = F.broadcast(heavy)
    schema = "source_name string, link bigint, urls bigint, line string, bucket bigint"
    return (
        sized.mapInArrow(_candidates, schema)
        .join(heavy, "bucket", "left_semi")
        .select("source_name", "line", "link", "urls")
        .distinct()
        .groupBy("source_name", "line", "urls")
        .agg(F.count(F.lit(1)).alias("n_urls"))
        .filter((F.col("n_urls") >= least) & (F.col("n_urls") * one_in >= F.col("urls")))
    )


def normal_line(line: Column) -> Column:
    """The normal form of ``normal_lines`` as a column."""
    white = F.regexp_replace(line, r"(?U)[\s\x1c-\x1f]+", " ")
    return F.regexp_replace(F.lower(F.btrim(white)), "[0-9]+", "#")


def without_lines(pages: DataFrame, repeated: DataFrame) -> DataFrame:
    """(record_id, content, removed): each page without the repeated lines of its source, and how many were removed.

    The lines of a source come as one array: each is on one in ONE_IN urls, so they are at most ONE_IN times the mean
    lines of a page. Null contents stay null with 0 removed.
    """
    per_source = repeated.groupBy("source_name").agg(F.collect_set("line").alias("_repeated"))
    if per_source.count() <= BROADCAST_SOURCES // 100:
        per_source = F.broadcast(per_source)
    lines = F.split("content", "\n")
    kept = F.filter(lines, lambda x: ~F.array_contains("_repeated", normal_line(x)))
    kept = F.when(F.col("_repeated").isNull(), lines).otherwise(kept)
    return (
        pages.select("record_id", "source_name", "content")
        .join(per_source, "source_name", "left")
        .select(
            "record_id",
            F.array_join(kept, "\n").alias("content"),
            F.coalesce(F.size(lines) - F.size(kept), F.lit(0)).alias("removed"),
        )
    )
