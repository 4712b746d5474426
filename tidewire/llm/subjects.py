"""Subject areas of documents: term weights, truncated SVD, and seed centroids refined over all sentences."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewire.llm import kernels as K
from tidewire.session import cut

#: Buckets that terms hash to; two terms in a bucket count as one.
BUCKETS = 8192
#: Dimensions kept, and spare ones that make the approximate SVD exact enough.
DIMENSIONS, SPARE = 48, 16
#: Passes of subspace iteration over the corpus, and rounds of centroid refinement.
PASSES, ROUNDS = 2, 4
#: A sentence speaks for its nearest subject if the cosine is at least CLOSE and MARGIN above the next subject's.
CLOSE, MARGIN = 0.5, 0.05
#: A subject with SHARE of the speaking sentences, if they are at least LEAST, or with MUCH of them is the document's.
SHARE, LEAST, MUCH = 0.3, 3, 0.45
#: Labelled documents that seed the centroids, at most.
MOST_LABELLED = 50_000
#: Subject areas whose centroids fit a task (20 MB each way); more raise an error.
MOST_AREAS = 100_000
#: Rows of a matrix that shuffle as one, and partial sums that are added up in one task.
ROWS, SUMS = 64, 64
#: A sentence's embedding is kept as whole numbers of so many parts of 1.
PARTS = 127

BAG = "doc_id bigint, lang string, terms array<smallint>, lengths array<int>"
EMBEDDED = "doc_id bigint, n int, x binary"
FOUND = "doc_id bigint, subject string, share double"


def bag_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashed terms of texts: the row, the sentence within the row, and the bucket of each word."""
    marked = pc.replace_substring_regex(texts, r"([.!?][\"'”’)]*)\s+|\n+", "\\1\n")
    parts = pc.split_pattern(marked, "\n")
    n = pc.fill_null(pc.list_value_length(parts), 0).to_numpy(zero_copy_only=False)
    row = np.repeat(np.arange(len(texts)), n)
    number = np.arange(len(row)) - np.repeat(np.r_[0, np.cumsum(n)[:-1]], n) if len(row) else row
    words = K.words(pc.list_flatten(parts))
    return row[words.row], number[words.row], (words.code % np.uint64(BUCKETS)).astype(np.int32)


def _bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The terms of each document in order, and the number of terms of each of its sentences."""
    for batch in K.by_size(batches, "text"):
        row, sentence, term = bag_of(batch.column("text"))
        new = np.flatnonzero(np.r_[True, (row[1:] != row[:-1]) | (sentence[1:] != sentence[:-1])]) if len(row) else np.empty(0, np.int64)
        lengths = np.diff(np.r_[new, len(row)])
        lists = [
            pa.ListArray.from_arrays(pa.array(np.searchsorted(of, np.arange(len(batch) + 1)), pa.int32()), pa.array(v))
            for of, v in ((row, term.astype(np.int16)), (row[new], lengths.astype(np.int32)))
        ]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("lang"), *lists], ["doc_id", "lang", "terms", "lengths"])


@dataclass
class Rows:
    """Weighted terms of a batch: unit rows (documents or sentences) as row, term and weight of each entry."""

    row: np.ndarray
    term: np.ndarray
    weight: np.ndarray
    n: int

    @classmethod
    def of(cls, row: np.ndarray, term: np.ndarray, idf: np.ndarray, n: int) -> Rows:
        key, count = np.unique(row.astype(np.int64) * BUCKETS + term, return_counts=True)
        row, term = key // BUCKETS, key % BUCKETS
        weight = (1 + np.log(count)) * idf[term]
        norm = np.sqrt(np.bincount(row, weights=weight**2, minlength=n))
        return cls(row, term, (weight / np.maximum(norm[row], 1e-12)).astype(np.float32), n)

    def dense(self) -> np.ndarray:
        out = np.zeros((self.n, BUCKETS), np.float32)
        out[self.row, self.term] = self.weight
        return out

    def times(self, matrix: np.ndarray) -> np.ndarray:
        """Rows by the columns of ``matrix`` (terms by dimensions)."""
        out = np.zeros((self.n, matrix.shape[1]), np.float32)
        if len(self.row):
            first = np.flatnonzero(np.r_[True, self.row[1:] != self.row[:-1]])
            out[self.row[first]] = np.add.reduceat(matrix[self.term] * self.weight[:, None], first, axis=0)
        return out


def _lists(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    n = pc.fill_null(column.value_lengths(), 0).to_numpy(zero_copy_only=False)
    return column.flatten().to_numpy(zero_copy_only=False), np.repeat(np.arange(len(column)), n)


def _parts(batches: Iterator[pa.RecordBatch], size: int = 256) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for k in range(0, len(batch), size):
            yield batch.slice(k, size)


def _in_few(df: DataFrame) -> DataFrame:
    """``df`` in a few partitions for each core, without a shuffle: each task of a matrix pass emits a whole matrix."""
    most = 4 * df.sparkSession.sparkContext.defaultParallelism
    return df.coalesce(most) if df.rdd.getNumPartitions() > most else df


def _summed(df: DataFrame, partial, rows: int, columns: int) -> np.ndarray:
    """The sum over all tasks of the matrix that ``partial`` makes of a task's batches; blocks of rows are added up by
    Spark in groups of SUMS, level by level, so the driver gets one matrix of ``rows`` by ``columns``."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = partial(batches)
        blocks = [m[k : k + ROWS].astype(np.float32).tobytes() for k in range(0, rows, ROWS)]
        yield pa.RecordBatch.from_arrays([pa.array(range(len(blocks)), pa.int32()), pa.array(blocks, pa.binary())], ["block", "data"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for block, data in zip(batch.column("block").to_pylist(), batch.column("data"), strict=True):
                m = np.frombuffer(data.as_buffer(), np.float32).astype(np.float64)
                total[block] = total[block] + m if block in total else m
        data = [m.astype(np.float32).tobytes() for m in total.values()]
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array(data, pa.binary())], ["block", "data"])

    schema = "block int, data binary"
    df = _in_few(df)
    parts, sums = df.rdd.getNumPartitions(), df.mapInArrow(emit, schema)
    while parts > SUMS:
        parts = -(-parts // SUMS)
        group = F.pmod(F.spark_partition_id(), F.lit(parts))
        sums = sums.repartition(parts * max(rows // ROWS, 1), "block", group).mapInArrow(add, schema)
    got = {r.block: np.frombuffer(r.data, np.float32).astype(np.float64) for r in sums.repartition("block").mapInArrow(add, schema).collect()}
    return np.concatenate([got[k] for k in sorted(got)]).reshape(rows, columns) if got else np.zeros((rows, columns))


def inverse_frequencies(bags: DataFrame) -> np.ndarray:
    """The inverse document frequency of each bucket over all documents."""

    def partial(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
        total = np.zeros((BUCKETS + ROWS, 1))
        for batch in _parts(batches):
            term, row = _lists(batch.column("terms"))
            found = np.unique(row.astype(np.int64) * BUCKETS + term)
            total[:BUCKETS, 0] += np.bincount(found % BUCKETS, minlength=BUCKETS)
            total[BUCKETS] += len(batch)
        return total

    # Counts of a task are whole in single precision up to 2**24 documents; beyond, and in sums, they are as exact as weights need.
    counted = _summed(bags.select("terms"), partial, BUCKETS + ROWS, 1)[:, 0]
    n, df = counted[BUCKETS], counted[:BUCKETS]
    return np.where(df > 0, np.log((1 + n) / (1 + df)), 0.0)


def term_vectors(bags: DataFrame, idf: np.ndarray, dimensions: int = DIMENSIONS, passes: int = PASSES) -> np.ndarray:
    """The leading right singular vectors of the documents' weight matrix, terms by ``dimensions``.

    Subspace iteration: each pass reads the corpus once, and a task adds A^T(A Q) of its documents.
    """
    width = dimensions + SPARE
    q, _ = np.linalg.qr(np.random.default_rng(42).standard_normal((BUCKETS, width)))
    for _ in range(passes + 1):
        q = q.astype(np.float32)

        def partial(batches: Iterator[pa.RecordBatch], q: np.ndarray = q) -> np.ndarray:
            total = np.zeros((BUCKETS, width))
            for batch in _parts(batches):
                term, row = _lists(batch.column("terms"))
                a = Rows.of(row, term, idf, len(batch))
                m = a.dense()
                total += m.T @ (m @ q)
            return total

        q, values, _ = np.linalg.svd(_summed(bags.select("terms"), partial, BUCKETS, width), full_matrices=False)
    return q[:, :dimensions].astype(np.float32)


def _unit(m: np.ndarray) -> np.ndarray:
    return m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-12)


def embedded(bags: DataFrame, idf: np.ndarray, vectors: np.ndarray) -> DataFrame:
    """(doc_id, n, x): the unit embeddings of each document's sentences, a byte for each dimension."""

    def embed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _parts(batches):
            term, _ = _lists(batch.column("terms"))
            length, row = _lists(batch.column("lengths"))
            x = _unit(Rows.of(np.repeat(np.arange(len(length)), length), term, idf, len(length)).times(vectors))
            whole = np.rint(x * PARTS).astype(np.int8)
            ends = np.searchsorted(row, np.arange(len(batch) + 1))
            data = [whole[i:j].tobytes() for i, j in zip(ends[:-1], ends[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.diff(ends), pa.int32()), pa.array(data, pa.binary())], ["doc_id", "n", "x"])

    return cut(bags.select("doc_id", "terms", "lengths").mapInArrow(embed, EMBEDDED))


def _sentences(batch: pa.RecordBatch, dimensions: int) -> tuple[np.ndarray, np.ndarray]:
    """The sentence embeddings of a batch, and the row of each."""
    data = b"".join(batch.column("x").to_pylist())
    x = np.frombuffer(data, np.int8).reshape(-1, dimensions).astype(np.float32)
    return _unit(x), np.repeat(np.arange(len(batch)), batch.column("n").to_numpy())


def _add_rows(total: np.ndarray, at: np.ndarray, x: np.ndarray) -> None:
    """Adds each row of ``x`` to the row ``at`` of ``total``."""
    if len(at):
        order = np.argsort(at, kind="stable")
        first = np.flatnonzero(np.r_[True, np.diff(at[order]) != 0])
        total[at[order][first]] += np.add.reduceat(x[order], first, axis=0)


def _nearest(x: np.ndarray, centroids: np.ndarray, of: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each vector the nearest centroid, the best cosine of each subject, and whether the nearest speaks."""
    cosine = x @ centroids.T
    best = np.full((len(x), n), -1.0)
    for s in range(n):
        if (of == s).any():
            best[:, s] = cosine[:, of == s].max(axis=1)
    top = np.sort(best, axis=1)
    speaks = (top[:, -1] >= CLOSE) & (top[:, -1] - (top[:, -2] if n > 1 else 0) >= MARGIN)
    return cosine.argmax(axis=1), best, speaks


def language(lang: Column) -> Column:
    """The language without region and case; null stays null."""
    return F.lower(F.regexp_extract(lang, r"^\s*([A-Za-z]+)", 1))


def seed_centroids(bags: DataFrame, labels: DataFrame, areas: list[tuple[str, str]], idf: np.ndarray, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One centroid for each subject and language of the labelled documents, and one from each description.

    Documents with one label count, at most MOST_LABELLED of the least doc_id; labels of unknown subjects don't.
    """
    names = [a for a, _ in areas]
    place = {a: k for k, a in enumerate(names)}
    single = labels.groupBy("doc_id").agg(F.min("subject").alias("subject"), F.count_distinct("subject").alias("n")).filter("n = 1")
    single = single.join(F.broadcast(labels.sparkSession.createDataFrame([(a,) for a in names], "subject string")), "subject").orderBy("doc_id").limit(MOST_LABELLED)
    sums: dict[tuple[int, str], np.ndarray] = {}

    def embed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _parts(batches):
            term, row = _lists(batch.column("terms"))
            x = _unit(Rows.of(row, term, idf, len(batch)).times(vectors))
            yield pa.RecordBatch.from_arrays([batch.column("subject"), batch.column("lang"), pa.array(list(x), pa.list_(pa.float64()))], ["subject", "lang", "x"])

    total = F.array(*[F.sum(F.col("x")[k]) for k in range(vectors.shape[1])]).alias("x")
    embedded = bags.join(F.broadcast(single.select("doc_id", "subject")), "doc_id").mapInArrow(embed, "subject string, lang string, x array<double>")
    for r in embedded.groupBy("subject", F.coalesce(language(F.col("lang")), F.lit("")).alias("lang")).agg(total).collect():
        sums[place[r.subject], r.lang] = np.array(r.x)
    row, _, term = bag_of(pa.array([f"{a} {d}" for a, d in areas], pa.string()))
    told = _unit(Rows.of(row, term, idf, len(areas)).times(vectors))
    keys = sorted(sums)
    centroids = np.array([sums[k] for k in keys] + list(told))
    return _unit(centroids), np.array([k[0] for k in keys] + list(range(len(areas))))


def refine(sentences: DataFrame, centroids: np.ndarray, of: np.ndarray, n: int, rounds: int = ROUNDS) -> np.ndarray:
    """Centroids moved to the mean of all sentences that speak for them, ``rounds`` times; one nothing speaks for stays."""
    for _ in range(rounds):

        def partial(batches: Iterator[pa.RecordBatch], c: np.ndarray = centroids) -> np.ndarray:
            total = np.zeros(c.shape)
            for batch in _parts(batches):
                x, _ = _sentences(batch, c.shape[1])
                at, _, speaks = _nearest(x, c, of, n)
                _add_rows(total, at[speaks], x[speaks])
            return total

        moved = _summed(sentences.select("n", "x"), partial, *centroids.shape)
        centroids = _unit(centroids + _unit(moved) * (np.linalg.norm(moved, axis=1, keepdims=True) > 0))
    return centroids


def subjects(documents: DataFrame, areas: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, subject, share): the subjects that each document is in a large part about.

    Terms of all documents are weighted and embedded by a truncated SVD; seed centroids from labelled documents and the
    descriptions move to the sentences near them; then each sentence speaks for its nearest subject, if it is close and
    clearly nearer than the next, and a document has the subjects of a share of its speaking sentences. A document
    with no such subject has the one whose centroids are nearest to its sentences in sum. Sentences are embedded once.
    Without areas there are no rows; over MOST_AREAS raise an error, as their centroids travel to the tasks. Null, empty and blank texts and
    texts without any word of the corpus have no rows. What travels to the driver is of fixed size: BUCKETS counts, one
    matrix a pass, the centroids. Other columns are ignored; repeated texts get equal subjects.
    """
    listed = [(r.subject, r.description or "") for r in areas.select("subject", "description").orderBy("subject").limit(MOST_AREAS + 1).collect()]
    if len(listed) > MOST_AREAS:
        raise ValueError(f"over {MOST_AREAS} subject areas")
    if not listed:
        return documents.sparkSession.createDataFrame([], FOUND)
    bags = cut(documents.filter(F.col("text").rlike(r"\S")).select("doc_id", "lang", "text").mapInArrow(_bags, BAG))
    idf = inverse_frequencies(bags)
    vectors = term_vectors(bags, idf)
    centroids, of = seed_centroids(bags, labels, listed, idf, vectors)
    n = len(listed)
    sentences = embedded(bags, idf, vectors)
    centroids = refine(sentences, centroids, of, n)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _parts(batches):
            x, row = _sentences(batch, centroids.shape[1])
            _, best, speaks = _nearest(x, centroids, of, n)
            votes, lean = np.zeros((len(batch), n)), np.zeros((len(batch), n))
            votes += np.bincount(row[speaks] * n + best[speaks].argmax(axis=1), minlength=len(batch) * n).reshape(-1, n)
            _add_rows(lean, row, best)
            share = votes / np.maximum(votes.sum(axis=1, keepdims=True), 1)
            has = (share >= SHARE) & (votes >= LEAST) | (share >= MUCH)
            bare = ~has.any(axis=1) & (np.bincount(row, minlength=len(batch)) > 0)
            top = np.where(votes.sum(axis=1) > 0, (votes * 1000 + lean).argmax(axis=1), lean.argmax(axis=1))
            has[np.flatnonzero(bare), top[bare]] = True
            at, subject = np.nonzero(has)
            ids = batch.column("doc_id").take(pa.array(at))
            names = pa.array([a for a, _ in listed], pa.string()).take(pa.array(subject))
            yield pa.RecordBatch.from_arrays([ids, names, pa.array(share[at, subject])], ["doc_id", "subject", "share"])

    return sentences.mapInArrow(assign, FOUND)
