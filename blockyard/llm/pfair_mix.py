"""Mixing sources to target weights by Pfair scheduling.

A source with weight w may send its block i (from 0) from slot floor(i/w) on and must have sent it before slot
ceil((i+1)/w). Sending the released block of earliest deadline in every slot meets all deadlines, so each source is
always less than one block from its share. Weights are used as they are, never rounded. A source that ends leaves its
share to the others: windows are those of all sources sending at once, each at its weight among those left.
"""

from __future__ import annotations

import bisect
import heapq
import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .scratch import fresh, store


def windows(blocks: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Release and deadline (slots) of every block, source by source.

    If all sources sent at once, each at its exact weight among those that still have blocks, the sources together would
    have sent ``fluid(i / w)`` blocks when one of weight w has sent i: a sum of lines that bend where a source ends.
    """
    ends = blocks / weights
    by = np.argsort(ends, kind="stable")
    stops, done = ends[by], np.concatenate(([0], np.cumsum(blocks[by])))
    rest = np.append(np.cumsum(weights[by][::-1])[::-1], 0.0)

    def fluid(v: np.ndarray) -> np.ndarray:
        k = np.searchsorted(stops, v, "left")
        return done[k] + v * rest[k]

    at = np.arange(blocks.sum()) - np.repeat(np.cumsum(blocks) - blocks, blocks)
    w = np.repeat(weights, blocks)
    # Whole numbers stay whole after rounding errors.
    begin, end = fluid(at / w), fluid((at + 1) / w)
    return np.floor(begin + 1e-9 + 1e-12 * begin).astype(np.int64), np.ceil(end - 1e-9 - 1e-12 * end).astype(np.int64)


def planned(sizes: list[int], weights: list[float]) -> Iterator[tuple[int, int]]:
    """(source, number of its block) slot by slot: the released block of earliest deadline, ties to the earlier source.

    Holds one block of each source, so memory grows with the sources alone.
    """
    alive = [i for i, n in enumerate(sizes) if n > 0]
    most = max((weights[i] for i in alive), default=1.0)
    share = [w / most for w in weights]
    by = sorted(alive, key=lambda i: sizes[i] / share[i])
    stops = [sizes[i] / share[i] for i in by]
    done = [0, *itertools.accumulate(sizes[i] for i in by)]
    rest = [*itertools.accumulate((share[i] for i in reversed(by)), initial=0.0)][::-1]

    def fluid(v: float) -> float:
        k = bisect.bisect_left(stops, v)
        return done[k] + v * rest[k]

    def window(i: int, number: int) -> tuple[int, int]:
        begin, end = fluid(number / share[i]), fluid((number + 1) / share[i])
        # Whole numbers stay whole after rounding errors.
        return math.floor(begin + 1e-9 + 1e-12 * begin), math.ceil(end - 1e-9 - 1e-12 * end)

    waiting, ready = [(*window(i, 0), i, 0) for i in alive], []
    waiting = [(release, i, number, deadline) for release, deadline, i, number in waiting]
    heapq.heapify(waiting)
    for slot in range(sum(sizes[i] for i in alive)):
        while waiting and (waiting[0][0] <= slot or not ready):
            _, i, number, deadline = heapq.heappop(waiting)
            heapq.heappush(ready, (deadline, i, number))
        _, i, number = heapq.heappop(ready)
        yield i, number
        if number + 1 < sizes[i]:
            release, deadline = window(i, number + 1)
            heapq.heappush(waiting, (release, i, number + 1, deadline))


def schedule(blocks: dict[str, int], weights: dict[str, float]) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
    """Sources by name; per block, source by source, the source's place among them, its number and its slot."""
    names = sorted(s for s, n in blocks.items() if n > 0)
    sizes = np.array([blocks[s] for s in names], np.int64)
    who = np.repeat(np.arange(len(names)), sizes)
    first = np.cumsum(sizes) - sizes
    slots = np.zeros(len(who), np.int64)
    for slot, (i, number) in enumerate(planned(sizes.tolist(), [weights[s] for s in names])):
        slots[first[i] + number] = slot
    return names, who, np.arange(len(who)) - np.repeat(first, sizes), slots


def tempered(counts: dict[str, int], power: float = 0.5) -> dict[str, float]:
    """Weights between the sources' sizes (power 1) and equal ones (power 0)."""
    return {s: float(n) ** power for s, n in counts.items()}


def _slots(spark: SparkSession, parts: list[tuple[dict[str, int], dict[str, float]]], source: str) -> DataFrame:
    """(source, mix_block, mix_slot): one task goes through the slots in order and writes them; nothing comes to the driver."""
    plans = [(names := sorted(s for s, n in blocks.items() if n > 0), [blocks[s] for s in names], [float(weights[s]) for s in names]) for blocks, weights in parts]

    def run(batches):
        for _ in batches:
            slot = 0
            for names, sizes, weights in plans:
                told = planned(sizes, weights)
                while some := list(itertools.islice(told, 1 << 16)):
                    who, number = zip(*some)
                    yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()).take(pa.array(who)), pa.array(number, pa.int64()), pa.array(np.arange(slot, slot + len(some)))], [source, "mix_block", "mix_slot"])
                    slot += len(some)

    return store(spark.range(1).coalesce(1).mapInArrow(run, f"`{source}` string, mix_block long, mix_slot long"), "slots")


def _placed(docs: DataFrame, weights: dict[str, float] | None = None, block_docs: int = 64, seed: int = 7, bucket_docs: int = 20_000) -> tuple[DataFrame, int]:
    """The rows of ``mix``, and the number of slots."""
    docs = docs.drop("mix_block", "mix_slot", "mix_position")
    source, hash_, bucket, rank, sum_before, many, other = fresh(docs, "_source", "_hash", "_bucket", "_rank", "_before", "_many", "_other")
    # Rows of one id, or of none, differ by their texts, or by what else they hold, so they spread over the ranges, too.
    told = ["text"] if "text" in docs.columns else [c for c in docs.columns if c != "doc_id"]
    named = docs.withColumn(source, F.coalesce(F.col("source").cast("string"), F.lit(""))).withColumn(hash_, F.xxhash64("doc_id", *told, F.lit(seed)))
    counts = {r[source]: r["count"] for r in named.groupBy(source).count().collect()}
    aims = tempered(counts) if weights is None else weights
    blocks = {s: -(-n // block_docs) for s, n in counts.items()}
    first = {s: n for s, n in blocks.items() if aims.get(s, 0) > 0}
    last = {s: n for s, n in blocks.items() if aims.get(s, 0) <= 0}
    table = _slots(docs.sparkSession, [(first, aims), (last, dict.fromkeys(last, 1.0))], source)
    # A source's rows are ranked within ranges of the hash, so that no task gets a whole source.
    buckets = max(1, -(-sum(counts.values()) // bucket_docs))
    in_bucket = F.least(F.floor((F.col(hash_) / float(1 << 64) + 0.5) * buckets), F.lit(buckets - 1))
    ranged = named.withColumn(bucket, in_bucket)
    # Rows repeated so often that they would fill a range are counted, not sorted, and numbered where their range ends.
    hot = store(named.groupBy(source, hash_).agg(F.count("*").alias("n")).filter(F.col("n") > bucket_docs), "repeated")
    some = hot.count()  # at most one for each range
    light = ranged.join(F.broadcast(hot.select(source, hash_)), [source, hash_], "left_anti") if some else ranged
    sizes = ranged.groupBy(source, bucket).agg(F.count("*").alias("n"))
    before = store(sizes.select(source, bucket, (F.sum("n").over(Window.partitionBy(source).orderBy(bucket)) - F.col("n")).alias(sum_before)), "before")
    within = Window.partitionBy(source, bucket).orderBy(hash_, "doc_id", *(["text"] if "text" in docs.columns else []))
    place = light.withColumn(rank, F.row_number().over(within) - 1).join(before, [source, bucket]).withColumn(rank, F.col(rank) + F.col(sum_before))
    ranked = place.select(*docs.columns, source, rank)
    if some:
        kinds = ranged.join(F.broadcast(hot.select(source, hash_)), [source, hash_])
        kinds = store(kinds.groupBy(*docs.columns, source, hash_, bucket).agg(F.count("*").alias(many)), "kinds")
        ahead = light.groupBy(source, bucket).agg(F.count("*").alias("n")).join(before, [source, bucket], "right").select(source, bucket, (F.col(sum_before) + F.coalesce("n", F.lit(0))).alias(sum_before))
        upto = Window.partitionBy(source, bucket).orderBy(hash_, F.xxhash64(*docs.columns))
        starts = kinds.withColumn(rank, F.sum(many).over(upto.rowsBetween(Window.unboundedPreceding, -1))).join(ahead, [source, bucket]).withColumn(rank, F.coalesce(F.col(rank), F.lit(0)) + F.col(sum_before))
        pieces = starts.withColumn(other, F.explode(F.sequence(F.lit(0).cast("long"), F.col(many) - 1, F.lit(bucket_docs).cast("long")))).repartition(buckets, source, hash_, other)
        again = pieces.withColumn(other, F.explode(F.sequence(other, F.least(F.col(other) + bucket_docs, F.col(many)) - 1)))
        ranked = ranked.union(again.select(*docs.columns, source, (F.col(rank) + F.col(other)).alias(rank)))
    placed = ranked.withColumn("mix_block", F.floor(F.col(rank) / block_docs)).join(table, [source, "mix_block"])
    placed = placed.withColumn("mix_position", F.col("mix_slot") * block_docs + F.col(rank) % block_docs)
    return placed.select(*docs.columns, "mix_block", "mix_slot", "mix_position"), sum(blocks.values())


def mix(docs: DataFrame, weights: dict[str, float] | None = None, block_docs: int = 64, seed: int = 7, bucket_docs: int = 20_000) -> DataFrame:
    """The columns of ``docs`` with mix_block, mix_slot and mix_position (long): every row has a place in the mix.

    Blocks hold ``block_docs`` rows of one source in a random order that ``seed`` fixes, by a hash of doc_id and of the
    text where there is one, else of all columns. ``weights`` defaults to the square roots of the sources' sizes; a source
    it lacks gets weight 0 and comes after all others. A null source is the source ''. Null and repeated ids and empty
    texts take part as rows; repeated rows are interchangeable, and those repeated more than ``bucket_docs`` times are
    counted and numbered at the end of their range of hashes. Any number of sources: the driver has their names and sizes,
    and one task goes through the slots of all blocks. Columns of the added names are replaced.
    """
    return _placed(docs, weights, block_docs, seed, bucket_docs)[0]


def mixed(docs: DataFrame, per_range: int = 20_000, **options) -> DataFrame:
    """The rows of ``docs`` in the order of the mix: partition i has the i-th range of positions, in order.

    Written files are in the order of the mix by name; ``by_files`` finds every row's place in them, however they are dealt.
    """
    placed, slots = _placed(docs, **options)
    ranges = max(1, -(-slots * options.get("block_docs", 64) // per_range))
    return placed.repartitionById(ranges, F.floor(F.col("mix_position") / per_range).cast("int")).sortWithinPartitions("mix_position").select(*docs.columns)


def by_files(docs: DataFrame, place: str = "mix_position") -> DataFrame | None:
    """The rows of ``docs`` with their place (long, from 0) in the Parquet files that they were read from: files by the number of their part.

    Only a row per file is added up. None, if the rows are not those of whole files, each once.
    """
    file, row, before = fresh(docs, "_file", "_row", "_before")
    try:
        told = docs.metadataColumn("_metadata")
        read = docs.select(*docs.columns, told["file_path"].alias(file), told["row_index"].alias(row))
    except AnalysisException:
        return None
    sizes = store(read.groupBy(file).agg(F.count("*").alias("n"), (F.max(row) + 1).alias("most"), F.count_distinct(row).alias("once")), "files")
    if sizes.filter("n <> most or n <> once").count():
        return None
    number = F.regexp_extract(F.element_at(F.split(file, "/"), -1), r"^part-(\d+)", 1).try_cast("long")
    ahead = sizes.select(file, (F.sum("n").over(Window.orderBy(number, file)) - F.col("n")).alias(before))
    return read.join(F.broadcast(ahead), file).select(*docs.columns, (F.col(before) + F.col(row)).alias(place))
