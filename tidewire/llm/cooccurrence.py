"""Items that appear together: pair counts by sorted 64-bit codes, and how far they exceed chance."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewire.session import cut

#: Records with more frequent items than this are paired block by block in several tasks.
WIDE = 256
#: Items in a block of a wide record, on average.
BLOCK = 128
#: Pairs of blocks in a task, about a million pairs of items; no more tasks than MOST_TASKS.
BLOCK_PAIRS, MOST_TASKS = 64, 20_000
#: Codes sorted at once in a task, 16 MB.
RUN = 2_000_000
#: Dictionaries of up to this many items are broadcast (about 20 MB); larger ones are joined by shuffling.
BROADCAST_ITEMS = 200_000

CODES = "code bigint, n bigint"


def mentions(entities: DataFrame) -> DataFrame:
    """Distinct (record, item) of the entity table, and every record once with a null item.

    An item is its kind, a colon and the array element without blanks and tabs at both ends. A record is the union of
    all rows of one url; a row without url is a record of its own.
    """

    def of(column: str, kind: str) -> Column:
        trimmed = F.transform(F.coalesce(F.col(column), F.array()), lambda x: F.btrim(x, F.lit(" \t")))
        return F.transform(F.filter(trimmed, lambda x: x != ""), lambda x: F.concat(F.lit(f"{kind}:"), x))

    record = F.coalesce(F.concat(F.lit("u:"), "url"), F.concat(F.lit("r:"), F.col("entity_row_id").cast("string")))
    kinds = ("people", "organizations", "locations")
    items = F.concat(*[of(f"{k}_mentioned", k) for k in kinds], F.array(F.lit(None).cast("string")))
    return entities.select(record.alias("record"), F.explode(items).alias("item")).distinct()


def _runs(codes: np.ndarray, n: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Sorted codes as (code, count) by run length."""
    if not len(codes):
        return codes, np.empty(0, np.int64)
    first = np.flatnonzero(np.r_[True, codes[1:] != codes[:-1]])
    return codes[first], np.diff(np.r_[first, len(codes)]) if n is None else np.add.reduceat(n, first)


def _batch(codes: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(codes, pa.int64()), pa.array(n, pa.int64())], ["code", "n"])


def _lists(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Values of all lists, and where each list begins and ends; a null list is empty."""
    lengths = pc.fill_null(column.value_lengths(), 0).to_numpy(zero_copy_only=False)
    return column.flatten().to_numpy(zero_copy_only=False), np.r_[0, np.cumsum(lengths)]


def _emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted runs of the pair codes of each record: all pairs of ``a``, or ``a`` by ``b`` where ``b`` is not null."""
    held: list[np.ndarray] = []
    size = 0
    for batch in batches:
        a, ends = _lists(batch.column("a"))
        b, b_ends = _lists(batch.column("b"))
        alone = batch.column("b").is_null().to_numpy(zero_copy_only=False)
        for k in range(len(batch)):
            left = np.sort(a[ends[k] : ends[k + 1]])
            if alone[k]:
                i, j = np.triu_indices(len(left), 1)
                x, y = left[i], left[j]
            else:
                right = b[b_ends[k] : b_ends[k + 1]]
                x, y = np.repeat(left, len(right)), np.tile(right, len(left))
                x, y = np.minimum(x, y), np.maximum(x, y)
            held.append((x.astype(np.int64) << 32) | y.astype(np.int64))
            size += len(x)
            if size >= RUN:
                yield _batch(*_runs(np.sort(np.concatenate(held))))
                held, size = [], 0
    if size:
        yield _batch(*_runs(np.sort(np.concatenate(held))))


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Run lengths of a partition sorted by code; the last code of a batch waits for the next batch."""
    wait: tuple[int, int] | None = None
    for batch in batches:
        if not len(batch):
            continue
        codes, n = _runs(batch.column("code").to_numpy(), batch.column("n").to_numpy())
        if wait and wait[0] == codes[0]:
            n[0] += wait[1]
        elif wait:
            yield _batch(np.array([wait[0]]), np.array([wait[1]]))
        wait = (int(codes[-1]), int(n[-1]))
        yield _batch(codes[:-1], n[:-1])
    if wait:
        yield _batch(np.array([wait[0]]), np.array([wait[1]]))


def pair_counts(coded: DataFrame) -> DataFrame:
    """(code, n): records that hold both items of each pair, of distinct rows (record, id) with 0 <= id < 2**31.

    A pair's code is the smaller id times 2**32 plus the larger. Tasks emit their codes as sorted runs with counts;
    the shuffle sorts each partition externally (it spills runs and merges them), and one pass counts run lengths. A
    record with more than WIDE items is split into blocks by hash, and its pairs of blocks are spread over tasks, so
    that no task or row holds an unbounded record. Without such records, which is checked first, the blocks and the join
    that tells them apart are left out; a few are told apart by broadcast, many by shuffling.
    """
    alone = F.lit(None).cast("array<int>").alias("b")
    wide = cut(coded.groupBy("record").agg(F.count(F.lit(1)).alias("k")).filter(F.col("k") > WIDE))
    n = F.ceil(F.col("k") / BLOCK)
    n_wide, block_pairs = wide.agg(F.count(F.lit(1)), F.coalesce(F.sum(n * (n + 1) / 2), F.lit(0.0))).first()
    if n_wide and n_wide <= BROADCAST_ITEMS:
        wide = F.broadcast(wide)
    narrow = coded.join(wide.select("record"), "record", "left_anti") if n_wide else coded
    lists = narrow.groupBy("record").agg(F.collect_list("id").alias("a")).select("a", alone)
    runs = lists.mapInArrow(_emit, CODES)
    if n_wide:
        runs = runs.unionAll(blocks_paired(coded.join(wide, "record"), int(block_pairs)).select("a", "b").mapInArrow(_emit, CODES))
    return runs.repartition("code").sortWithinPartitions("code").mapInArrow(_merge, CODES)


def blocks_paired(wide: DataFrame, block_pairs: int) -> DataFrame:
    """(record, low, high, a, b): every two blocks of each record of ``wide`` (record, id, k = its items), and each block
    alone with a null ``b``; ``block_pairs`` is their number.

    A block goes to each of its pairs by the key (record, low, high), never to one task for a record, in a number of
    partitions that follows the number of pairs.
    """
    block = F.pmod(F.xxhash64("id"), F.ceil(F.col("k") / BLOCK)).cast("int")
    blocks = wide.groupBy("record", "k", block.alias("block")).agg(F.collect_list("id").alias("ids"))
    last = (F.ceil(F.col("k") / BLOCK) - 1).cast("int")
    tasks = min(max(block_pairs // BLOCK_PAIRS, 1), MOST_TASKS)
    key = ["record", "low", "high"]
    left = blocks.select("record", F.col("block").alias("low"), F.explode(F.sequence("block", last)).alias("high"), F.col("ids").alias("a")).repartition(tasks, *key)
    right = blocks.select("record", F.explode(F.sequence(F.lit(0), "block")).alias("low"), F.col("block").alias("high"), F.col("ids").alias("b")).repartition(tasks, *key)
    return left.join(right, key).select(*key, "a", F.when(F.col("low") < F.col("high"), F.col("b")).alias("b"))


def numbered(items: DataFrame) -> DataFrame:
    """``items`` (item, ...) with ``id`` from 0 in the order of ``item``: a distributed sort, then each partition's rows
    are counted from where the partitions before it end. Only the partitions' sizes come to the driver."""
    placed = cut(items.sort("item").withColumn("_at", F.monotonically_increasing_id()))
    part = F.shiftright("_at", 33).cast("int")
    sizes = {r.part: r.n for r in placed.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n")).collect()}
    starts, total = [], 0
    for p in sorted(sizes):
        starts.append((p, total))
        total += sizes[p]
    if total >= 2**31:
        raise ValueError("over 2**31 items: their ids don't fit two to a 64-bit code")
    begun = F.broadcast(items.sparkSession.createDataFrame(starts, "_part int, _start bigint"))
    found = placed.withColumn("_part", part).join(begun, "_part")
    return found.withColumn("id", (F.col("_start") + F.col("_at").bitwiseAND((1 << 33) - 1)).cast("int")).drop("_part", "_start", "_at")


def together(mentioned: DataFrame, least: int = 5, least_share: float = 1 / 500) -> DataFrame:
    """Pairs of items in at least ``least`` records and ``least_share`` of all records, by code point order.

    ``mentioned`` is distinct (record, item), with a null item once for every record. Output: item_a < item_b, n_a,
    n_b, n_ab, n_records, lift (times more often than chance) and log_odds, the logarithm of the odds ratio with 0.5
    added to each cell so that empty cells give a finite value. Items in fewer records can't be in such a pair and are
    left out before pairing, which loses nothing; their number is at most the mean items of a record divided by
    ``least_share``. No rows in, no rows out.
    """
    record = F.struct(F.xxhash64("record").alias("a"), F.hash("record").alias("b")).alias("record")  # 96 bits stand for the text
    mentioned = cut(mentioned.select(record, "item"))
    counts = cut(mentioned.groupBy("item").agg(F.count(F.lit(1)).alias("c")))
    n_records = sum(r.c for r in counts.filter(F.col("item").isNull()).collect())
    need = max(least, least_share * n_records)
    items = cut(numbered(counts.filter(F.col("item").isNotNull() & (F.col("c") >= need))))
    sized = F.broadcast if items.count() <= BROADCAST_ITEMS else (lambda df: df)
    coded = mentioned.join(sized(items.select("item", "id")), "item").select("record", "id")
    pairs = pair_counts(coded).filter(F.col("n") >= need)

    def named(side: str, id_: Column) -> DataFrame:
        return items.select(F.col("id").alias(f"id_{side}"), F.col("item").alias(f"item_{side}"), F.col("c").alias(f"n_{side}"))

    a, b, ab, total = (F.col(x).cast("double") for x in ("n_a", "n_b", "n_ab", "n_records"))
    odds = ((ab + 0.5) * (total - a - b + ab + 0.5)) / ((a - ab + 0.5) * (b - ab + 0.5))
    return (
        pairs.select(F.shiftright("code", 32).cast("int").alias("id_a"), F.col("code").bitwiseAND(0x7FFFFFFF).cast("int").alias("id_b"), F.col("n").alias("n_ab"))
        .join(sized(named("a", F.col("id"))), "id_a")
        .join(sized(named("b", F.col("id"))), "id_b")
        .withColumn("n_records", F.lit(n_records).cast("bigint"))
        .withColumn("lift", ab * total / (a * b))
        .withColumn("log_odds", F.log(odds))
        .select("item_a", "item_b", "n_a", "n_b", "n_ab", "n_records", "lift", "log_odds")
    )


def more_than_chance(pairs: DataFrame, times: int = 4) -> DataFrame:
    """Pairs that occur together at least ``times`` as often as chance, compared in whole numbers."""
    return pairs.filter(F.col("n_ab") * F.col("n_records") >= times * F.col("n_a") * F.col("n_b")).select("item_a", "item_b")
