"""Counts of pairs of words, of which there are far more than words: no pair is shuffled or stored.

Words get numbers and the lines are written once as arrays of them.  A task
then reads all lines, which are few bytes, and makes and counts the pairs of
its own first words only, so what it gives is final.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.storage import new_folder

#: Pairs of a task, of which at most all are different; pairs made at once; rows of a batch that is given back.
PAIRS_IN_TASK, PAIRS_AT_ONCE, ROWS = 10_000_000, 1_000_000, 200_000


def _files(uri: str) -> tuple[pafs.FileSystem, list[str]]:
    fs, path = pafs.FileSystem.from_uri(uri)
    found = fs.get_file_info(pafs.FileSelector(path, recursive=True))
    return fs, sorted(f.path for f in found if f.path.endswith(".parquet"))


_words: dict[str, pa.Table] = {}


def _vocabulary(uri: str, *columns: str) -> list[pa.Array]:
    """Columns of the table of words, in the order of their hashes, which numbers them; kept for the next task of this process."""
    key = " ".join([uri, *columns])
    if key not in _words:
        _words.clear()
        fs, files = _files(uri)
        (file,) = files
        _words[key] = pq.read_table(file, filesystem=fs, columns=list(columns)).combine_chunks()
    return [c.chunk(0) for c in _words[key].columns]


def _counted(keys: np.ndarray, n: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, and how often they occur, or the sums of ``n``."""
    if n is None:
        keys = np.sort(keys)
    else:
        order = np.argsort(keys)
        keys, n = keys[order], n[order]
    new = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])[: len(keys)])
    return keys[new], np.diff(np.append(new, len(keys))) if n is None else np.add.reduceat(n, new) if len(new) else n


def _made(lists: Iterator[tuple[pa.ListArray, pa.ListArray | None]], block: int, blocks: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys (first word of the block, second word, whether adjacent) and their counts."""
    parts, held = [], 0

    def merged() -> tuple[np.ndarray, np.ndarray]:
        return _counted(*(np.concatenate([np.zeros(0, np.int64), *(p[i] for p in parts)]) for i in (0, 1)))

    for a, b in lists:
        one = a.flatten().to_numpy()
        n = a.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        end = np.cumsum(n)
        at = np.flatnonzero(one % blocks == block)
        row = np.searchsorted(end, at, side="right")
        if b is None:  # all that follow in the line
            two, lo, hi = one, at + 1, end[row]
        else:  # all of the other line
            two, m = b.flatten().to_numpy(), b.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
            hi = np.cumsum(m)[row]
            lo = hi - m[row]
        first = (one[at] // blocks).astype(np.int64) * size
        ends = np.concatenate([[0], np.cumsum(hi - lo)])
        i = 0
        while i < len(at):
            j = max(int(np.searchsorted(ends, ends[i] + PAIRS_AT_ONCE, side="right")) - 1, i + 1)
            k = hi[i:j] - lo[i:j]
            start = ends[i:j] - ends[i]
            place = np.arange(ends[j] - ends[i]) + np.repeat(lo[i:j] - start, k)
            keys = (np.repeat(first[i:j], k) + two[place]) * 2
            if b is None:
                keys[start[k > 0]] += 1
            parts.append(_counted(keys))
            held += len(parts[-1][0])
            if held > 1.5 * len(parts[0][0]) + 2 * PAIRS_AT_ONCE:
                parts = [merged()]
                held = len(parts[0][0])
            i = j
    return merged()


def counts(lines: DataFrame, first: Column, second: Column | None = None, least: int = 0) -> DataFrame:
    """Rows (a, b, joint, adjacent, n_a, n_b) of pairs that occur over ``least`` times.

    A pair is a word of the array ``first`` and one that follows it there, or
    one of ``second``; every pair of places counts, and is adjacent if the
    places are.  ``n_a`` and ``n_b`` count the word's places in ``first`` and
    in what b is from.  Every process holds the table of words.
    """
    spark = lines.sparkSession
    arrays = lines.select(first.alias("a"), *([] if second is None else [second.alias("b")])).where("a IS NOT NULL" + ("" if second is None else " AND b IS NOT NULL"))
    sides = arrays.select(F.explode("a").alias("w"), F.lit(1).alias("x"), F.lit(int(second is None)).alias("y"))
    if second is not None:
        sides = sides.unionAll(arrays.select(F.explode("b"), F.lit(0), F.lit(1)))
    found = sides.groupBy("w").agg(F.sum("x").alias("n_a"), F.sum("y").alias("n_b"))
    work = F.expr("size(a) * (size(a) - 1L) div 2") if second is None else F.expr("size(a) * bigint(size(b))")
    total = arrays.agg(F.sum(work)).first()[0] or 0
    for seed in range(100):  # until no two words have the same hash
        hashed = lambda w: F.xxhash64(w, F.lit(seed))  # noqa: B023, E731
        at = new_folder(spark, "words")
        found.select(hashed(F.col("w")).alias("h"), "w", "n_a", "n_b").repartition(1).sortWithinPartitions("h").write.option("maxRecordsPerFile", 0).parquet(at)
        size, kinds = spark.read.parquet(at).agg(F.count("*"), F.count_distinct("h")).first()
        if size == kinds:
            break
    columns = arrays.columns
    ids = new_folder(spark, "lines")

    def numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (h,) = _vocabulary(at, "h")
        for batch in batches:
            out = []
            for c in batch.columns:
                flat = np.searchsorted(h.to_numpy(), c.flatten().to_numpy()).astype(np.int32)
                out.append(pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(c.value_lengths().to_numpy())]).astype(np.int32)), flat))
            yield pa.RecordBatch.from_arrays(out, columns)

    if size:
        arrays.select(*(F.transform(c, hashed).alias(c) for c in columns)).mapInArrow(numbered, ", ".join(f"{c} array<int>" for c in columns)).write.parquet(ids)
    blocks = max(1, min(size, max(spark.sparkContext.defaultParallelism, math.ceil(total / PAIRS_IN_TASK))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in (b for batch in batches for b in batch.column(0).to_pylist()):
            fs, files = _files(ids)

            def lists() -> Iterator[tuple[pa.ListArray, pa.ListArray | None]]:
                for file in files:
                    with pq.ParquetFile(file, filesystem=fs) as f:
                        for x in f.iter_batches(4096):
                            yield x.column(0), x.column(1) if len(columns) > 1 else None

            keys, n = _made(lists(), block, blocks, size)
            pair = keys >> 1
            new = np.flatnonzero(np.append(True, pair[1:] != pair[:-1])[: len(pair)])
            joint = np.add.reduceat(n, new) if len(new) else n
            near = np.add.reduceat(np.where(keys & 1 == 1, n, 0), new) if len(new) else n
            pair, keep = pair[new], joint > least
            pair, joint, near = pair[keep], joint[keep], near[keep]
            w, n_a, n_b = _vocabulary(at, "w", "n_a", "n_b")
            for i in range(0, len(pair), ROWS):
                a, b = pa.array(pair[i : i + ROWS] // size * blocks + block), pa.array(pair[i : i + ROWS] % size)
                yield pa.RecordBatch.from_arrays([w.take(a), w.take(b), pa.array(joint[i : i + ROWS]), pa.array(near[i : i + ROWS]), n_a.take(a), n_b.take(b)], ["a", "b", "joint", "adjacent", "n_a", "n_b"])

    todo = spark.range(0, blocks if size else 0, 1, blocks)
    return todo.mapInArrow(run, "a string, b string, joint long, adjacent long, n_a long, n_b long")
