"""Near-duplicate documents by min-max hashing."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.llm import _bytes as B
from weftline.llm._shared import components, few, fresh, maybe_broadcast, union_of, written

SIG = "doc_id long, t long, h1 long, h2 long, bands array<long>, sketch binary"
#: Members up to which a bucket is linked in one task, and of a block of a larger one.
IN_TASK = 4096


def _coefficients(permutations: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    r = np.random.default_rng(seed)
    return r.integers(0, 1 << 32, permutations, np.uint32) | np.uint32(1), r.integers(0, 1 << 32, permutations, np.uint32)


def min_max(h: np.ndarray, first: np.ndarray, permutations: int, seed: int) -> np.ndarray:
    """For each text its 2 x ``permutations`` values: the least under every permutation, then the greatest.

    ``h`` are 64-bit shingle hashes, those of text i at first[i] to
    first[i + 1]; each text has at least one.  One evaluation of a permutation
    serves two values.
    """
    a, b = _coefficients(permutations, seed)
    x = (h >> B.U64(32)).astype(np.uint32)
    out = np.empty((len(first) - 1, 2 * permutations), np.uint32)
    at = first[:-1]
    for k in range(permutations):
        v = (x ^ b[k]) * a[k]
        v ^= v >> np.uint32(15)
        out[:, k] = np.minimum.reduceat(v, at)
        out[:, permutations + k] = np.maximum.reduceat(v, at)
    return out


def band_hashes(sig: np.ndarray, rows: int) -> np.ndarray:
    """One 64-bit hash for each run of ``rows`` values, mixed with the band's number.

    Minima and maxima are spread over the bands in an order that puts both
    values of a permutation in different bands.
    """
    bands = sig.shape[1] // rows
    out = np.empty((len(sig), bands), np.uint64)
    for j in range(bands):
        h = np.full(len(sig), j + 1, np.uint64)
        for r in range(rows):
            h = B.mix(h * B.U64(0x9FB21C651E98DF25) + sig[:, j * rows + r].astype(np.uint64) + B.U64(1))
        out[:, j] = h
    return out


def signatures(docs: DataFrame, width: int, permutations: int, rows: int, seed: int) -> DataFrame:
    """Rows (doc_id, t, h1, h2, bands, sketch) of the documents with an id and a word; t hashes the text, h1 and h2 the sequence of its words."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text, ids, t = B.filled(batch.column(2)), batch.column(0), batch.column(1)
            for lo, hi in B.pieces(text, B.STAGE_CHUNK):
                part = text.slice(lo, hi - lo)
                w = B.words(part)
                has = np.flatnonzero(np.diff(w.first) > 0)
                if not len(has):
                    continue
                h, first = B.shingles(w, len(part), width)
                place = np.arange(len(w.hash)) - np.repeat(w.first[:-1], np.diff(w.first))
                pw, _ = B.powers(int(place.max()) + 1)
                begin = w.first[has]
                h1 = np.add.reduceat(w.hash * pw[place], begin)
                h2 = np.add.reduceat(B.mix(w.hash ^ B.U64(0xA5A5A5A5A5A5A5A5)) * pw[place], begin)
                sig = min_max(h, first[np.append(has, len(part))], permutations, seed)
                bands = band_hashes(sig, rows)
                sketch = np.ascontiguousarray((sig ^ (sig >> np.uint32(16))).astype(np.uint16))
                size = sketch.shape[1] * 2
                yield pa.RecordBatch.from_arrays(
                    [
                        ids.take(pa.array(has + lo)),
                        t.take(pa.array(has + lo)),
                        pa.array(h1.view(np.int64)),
                        pa.array(h2.view(np.int64)),
                        pa.ListArray.from_arrays(pa.array(np.arange(len(has) + 1, dtype=np.int32) * bands.shape[1]), pa.array(bands.view(np.int64).ravel())),
                        pa.Array.from_buffers(pa.binary(), len(has), [None, pa.py_buffer(np.arange(len(has) + 1, dtype=np.int32) * np.int32(size)), pa.py_buffer(sketch)]),
                    ],
                    ["doc_id", "t", "h1", "h2", "bands", "sketch"],
                )

    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("t"), "text")
    return src.where("doc_id IS NOT NULL").mapInArrow(sign, SIG)


def _near(sketch: np.ndarray, a: np.ndarray, b: np.ndarray, threshold: float) -> np.ndarray:
    return (sketch[a] == sketch[b]).mean(axis=1) >= threshold


def link_bucket(sketch: np.ndarray, threshold: float, second: int | None = None) -> list[tuple[int, int]]:
    """Links (place, place) that connect all members of one bucket whose estimated similarities connect them.

    From the first member on, each member reached is compared with all that are
    not reached yet, in blocks; a bucket that one member is near to all of takes
    one comparison a member.  With ``second``, members before that place are
    compared with those from it on only, and the links connect what such pairs do.
    """
    out: list[tuple[int, int]] = []
    places = np.arange(len(sketch))
    rest = [places] if second is None else sorted([places[:second], places[second:]], key=len)
    while len(rest[0]) and len(rest[-1]):
        side, front, rest[0] = 0, rest[0][:1], rest[0][1:]
        while len(front):
            side = len(rest) - 1 - side  # of those it is compared with
            reached = [front[:0]]
            for x in front:
                if not len(rest[side]):
                    break
                near = _near(sketch, rest[side], np.full(len(rest[side]), x), threshold)
                out += [(int(x), int(y)) for y in rest[side][near]]
                reached.append(rest[side][near])
                rest[side] = rest[side][~near]
            front = np.concatenate(reached)
    return out


def _links(members: DataFrame, threshold: float) -> DataFrame:
    """Rows (a, b), structs of doc_id and t, that connect the near ones of ``members`` (band, tile, side, doc_id, t, sketch).

    All of a tile are compared in one task: side 2 with each other, side 0 with side 1.
    """

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def firsts(t: pa.Table) -> np.ndarray:
            band, tile = t["band"].to_numpy(), t["tile"].to_numpy()
            return np.flatnonzero(np.append(True, (band[1:] != band[:-1]) | (tile[1:] != tile[:-1])))

        def edges(t: pa.Table) -> pa.RecordBatch:
            side, first = t["side"].to_numpy(), firsts(t)
            ids, texts = t["doc_id"].to_numpy(), t["t"].to_numpy()
            s = np.frombuffer(b"".join(t["sketch"].to_pylist()), np.uint16).reshape(len(side), -1)
            size = np.diff(np.append(first, len(side)))
            pairs = first[size == 2]  # most buckets: all compared at once
            near = pairs[_near(s, pairs, pairs + 1, threshold)]
            a, b = [near], [near + 1]
            for f, n in zip(first[size > 2], size[size > 2], strict=True):
                second = None if side[f] == 2 else int(np.searchsorted(side[f : f + n], 1))
                got = np.array(link_bucket(s[f : f + n], threshold, second), np.int64).reshape(-1, 2) + f
                a.append(got[:, 0])
                b.append(got[:, 1])
            x, y = np.concatenate(a), np.concatenate(b)
            return pa.RecordBatch.from_arrays([pa.array(v) for v in (ids[x], texts[x], ids[y], texts[y])], ["ad", "at", "bd", "bt"])

        held: pa.Table | None = None
        for batch in batches:
            if not batch.num_rows:
                continue
            t = pa.Table.from_batches([batch])
            t = t if held is None else pa.concat_tables([held, t]).combine_chunks()
            cut = int(firsts(t)[-1])  # the last tile may go on
            held = t.slice(cut)
            if cut:
                yield edges(t.slice(0, cut))
        if held is not None:
            yield edges(held)

    rows = members.select("band", "tile", "side", "doc_id", "t", "sketch").repartition("band", "tile").sortWithinPartitions("band", "tile", "side", "doc_id", "t")
    out = rows.mapInArrow(link, "ad long, at long, bd long, bt long")
    return out.select(F.struct(F.col("ad").alias("doc_id"), F.col("at").alias("t")).alias("a"), F.struct(F.col("bd").alias("doc_id"), F.col("bt").alias("t")).alias("b"))


def _leads(members: DataFrame) -> DataFrame:
    """``members`` with the ids ``ld`` and ``lt`` of the least member of their bucket, and the share ``same`` of values equal to its."""
    lead = members.groupBy("band").agg(F.min_by(F.struct("doc_id", "t", "sketch"), F.struct("doc_id", "t")).alias("lead"))
    rows = members.join(maybe_broadcast(lead, 10_000), "band").select("band", "doc_id", "t", "sketch", F.col("lead.doc_id").alias("ld"), F.col("lead.t").alias("lt"), F.col("lead.sketch").alias("ls"))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                a, b = (np.frombuffer(b"".join(batch.column(k).to_pylist()), np.uint16).reshape(batch.num_rows, -1) for k in (3, 6))
                yield pa.RecordBatch.from_arrays([*batch.columns[:6], pa.array((a == b).mean(axis=1))], [*batch.schema.names[:6], "same"])

    return rows.mapInArrow(compare, "band long, doc_id long, t long, sketch binary, ld long, lt long, same double")


def _blocks(n: str) -> Column:
    """Number of blocks for the ``n`` members of a bucket."""
    return F.ceil(F.col(n) / IN_TASK).cast("long")


def _tiled(members: DataFrame, block: Column, other: Column, i: Column, j: Column, side: Column) -> DataFrame:
    """``members`` once for each block ``_o`` they are compared with, in the tile of blocks i and j."""
    cut = members.withColumn("_b", F.pmod(F.xxhash64("doc_id", "t"), block)).withColumn("_o", F.explode(F.sequence(F.lit(0).cast("long"), other - 1)))
    return cut.select("band", F.shiftleft(i, 32).bitwiseOR(j).alias("tile"), side.alias("side"), "doc_id", "t", "sketch")


def _within(members: DataFrame) -> DataFrame:
    """Tiles in which every two of ``members``, ``n`` in a bucket, meet."""
    b, o = F.col("_b"), F.col("_o")
    return _tiled(members, _blocks("n"), _blocks("n"), F.least(b, o), F.greatest(b, o), F.when(b == o, 2).when(b < o, 0).otherwise(1))


def _between(led: DataFrame, threshold: float) -> DataFrame:
    """Tiles in which each of ``led`` that is near its lead meets each that is not, but for pairs that can't be near.

    The share of values that differ is a metric, so two that are near have
    shares to the lead that are 1 - ``threshold`` apart at most.
    """
    near, apart = F.col("same") >= threshold, 1 - threshold + 1e-9
    bounds = led.groupBy("band").agg(F.max(F.when(~near, F.col("same"))).alias("most"), F.min(F.when(near, F.col("same"))).alias("least"))
    able = F.when(near, F.col("same") <= F.col("most") + apart).otherwise(F.col("same") >= F.col("least") - apart)
    able = written(led.join(maybe_broadcast(bounds), "band").where(able).withColumn("near", near).select("band", "doc_id", "t", "sketch", "near"), "able")
    counts = written(able.groupBy("band").agg(F.count_if("near").alias("n1"), F.count_if(~F.col("near")).alias("n2")).where("n1 > 0 AND n2 > 0"), "counts")
    b, o, first = F.col("_b"), F.col("_o"), F.col("near")
    n1, n2 = _blocks("n1"), _blocks("n2")
    pick = lambda x, y: F.when(first, x).otherwise(y)
    return _tiled(able.join(maybe_broadcast(counts), "band"), pick(n1, n2), pick(n2, n1), pick(b, o), pick(o, b), pick(F.lit(0), F.lit(1)))


def link(reps: DataFrame, threshold: float) -> DataFrame:
    """Links (a, b) that connect all ``reps`` (doc_id, t, bands, sketch), each row another text or id, that share a band and are near.

    Of buckets with the same members one is looked at, told by aggregates that
    are made on the map side, so that no bucket is ever an array.  Buckets of at
    most IN_TASK members are linked in one task each.  Larger ones are made
    smaller first: members are compared with the least of them, wherever they
    are; those that are near it are linked to it, compared with those that are
    not, and leave.  Where that takes away too few, what is left is cut into
    blocks of IN_TASK members, and every two blocks are compared in a task.
    Whatever a bucket's size, what its near pairs connect is connected; where
    IN_TASK lies doesn't change the components.
    """
    bands = (
        reps.select("doc_id", "t", F.explode("bands").alias("band"))
        .groupBy("band")
        .agg(F.count("*").alias("n"), F.min("doc_id").alias("lo"), F.bit_xor(F.xxhash64("doc_id", "t")).alias("mark"))
        .where("n > 1")
    )
    chosen = written(bands.groupBy("n", "lo", "mark").agg(F.min("band").alias("band")).select("band", "n"), "bands")
    every = reps.select("doc_id", "t", "sketch", F.explode("bands").alias("band"))
    small = every.join(maybe_broadcast(chosen.where(F.col("n") <= IN_TASK).select("band")), "band")
    out = [_links(small.withColumns({"tile": F.lit(0).cast("long"), "side": F.lit(2)}), threshold)]
    large = chosen.where(F.col("n") > IN_TASK).select("band")
    if few(large, 0):
        return out[0]
    left = written(every.join(maybe_broadcast(large), "band").select("band", "doc_id", "t", "sketch"), "large")
    near, rounds = F.col("same") >= threshold, 0
    while not few(left, 0):
        rounds += 1
        led = written(_leads(left), "led")
        out.append(led.where(near).select(F.struct(F.col("ld").alias("doc_id"), F.col("lt").alias("t")).alias("a"), F.struct("doc_id", "t").alias("b")))
        out.append(_links(_between(led, threshold), threshold))
        size = written(led.groupBy("band").agg(F.count_if(~near).alias("n"), F.count_if(near).alias("gone")).where("n > 0"), "sizes")
        rest = led.where(~near).join(maybe_broadcast(size), "band").select("band", "doc_id", "t", "sketch", "n", "gone")
        again = (F.col("n") > IN_TASK) & ((F.col("gone") * 4 >= F.col("n")) | F.lit(rounds < 3))
        out.append(_links(_within(rest.where(~again)), threshold))
        left = rest.where(again).select("band", "doc_id", "t", "sketch")
    return union_of(out)


def copies(docs: DataFrame, threshold: float, width: int, permutations: int, rows: int, seed: int) -> tuple[DataFrame, DataFrame]:
    """Rows (doc_id, t, kept), each text that is a copy and the struct of doc_id and t of the one that is kept; and the (doc_id, t) that rows repeat."""
    sig = written(signatures(docs, width, permutations, rows, seed), "signatures")
    me = F.struct("doc_id", "t")
    groups = sig.groupBy("h1", "h2").agg(F.min(me).alias("rep"), F.count("*").alias("n")).where("n > 1").select("h1", "h2", "rep")
    flat = sig.select("doc_id", "t", "h1", "h2").join(maybe_broadcast(groups), ["h1", "h2"]).where(me != F.col("rep"))
    exact = written(flat.select("doc_id", "t", "rep").distinct(), "exact")
    reps = sig.join(maybe_broadcast(exact.select("doc_id", "t")), ["doc_id", "t"], "left_anti")
    again = written(sig.groupBy("doc_id", "t").agg(F.count("*").alias("n")).where("n > 1").drop("n"), "again")
    if not few(again, 0):
        hit = maybe_broadcast(again)
        once = reps.join(hit, ["doc_id", "t"], "left_semi").dropDuplicates(["doc_id", "t"])
        reps = written(reps.join(hit, ["doc_id", "t"], "left_anti").unionByName(once), "once")
    near = components(link(reps, threshold))
    moved = exact.join(near, exact.rep == near.node, "left").select("doc_id", "t", F.coalesce("root", "rep").alias("kept"))
    return moved.union(near.select("node.doc_id", "node.t", "root")), again


def near_duplicates(
    docs: DataFrame, threshold: float = 0.5, width: int = 3, permutations: int = 64, rows: int = 4, seed: int = 7
) -> DataFrame:
    """Rows (doc_id, kept_doc_id) for every document that is a near copy of another: the kept one is the least id of its group.

    Shingles are ``width`` consecutive words, case and punctuation ignored.
    Each permutation gives two values of the signature, the least and the
    greatest; all are banded by ``rows``.  Documents that share a band are
    linked if the share of equal values, an unbiased estimate of the Jaccard
    similarity, reaches ``threshold``; groups are the connected components.
    Documents of the same words in the same order are collapsed beforehand,
    which keeps buckets small however often a text is copied.

    Documents without a word, null ids and texts never match anything.  What is
    compared is texts: an id that is repeated with different ones may have a row
    for each, and rows that repeat an id and its text are one.  Ties don't
    occur: of equal ids the text with the lesser hash is kept.  An empty table
    gives no rows; other columns are not read.

    The texts are read once and never shuffled: what moves are ids, band hashes
    and, for those that share a bucket, 16 bits of every value.
    """
    found, _ = copies(docs, threshold, width, permutations, rows, seed)
    return found.select("doc_id", F.col("kept.doc_id").alias("kept_doc_id")).where("doc_id <> kept_doc_id").distinct()


def keep_first(
    docs: DataFrame, threshold: float = 0.5, width: int = 3, permutations: int = 64, rows: int = 4, seed: int = 7
) -> DataFrame:
    """``docs`` without the texts that are copies, as :func:`near_duplicates` has it; one of each group stays, with all its columns.

    A text is left out under the ids it is a copy under only: another text with
    the same id stays.  Rows that repeat id and text become one, that of the
    least hash of all columns.  Rows with a null id, and texts without words,
    stay as they are.
    """
    found, again = copies(docs, threshold, width, permutations, rows, seed)
    left_id, left_t, again_id, again_t, row = fresh(docs, "_gone", "_gone_t", "_again", "_again_t", "_row")
    gone = written(found.select(F.col("doc_id").alias(left_id), F.col("t").alias(left_t)).distinct(), "gone")
    same = lambda i, t: (docs["doc_id"].cast("long") == F.col(i)) & (F.xxhash64(docs["text"]) == F.col(t))
    kept = docs.join(maybe_broadcast(gone), same(left_id, left_t), "left_anti")
    if few(again, 0):
        return kept
    hit = maybe_broadcast(again.toDF(again_id, again_t))
    once, many = kept.join(hit, same(again_id, again_t), "left_anti"), kept.join(hit, same(again_id, again_t), "left_semi")
    plain = [f.name for f in docs.schema.fields if "map<" not in f.dataType.simpleString() and "variant" not in f.dataType.simpleString()]
    one = many.groupBy("doc_id", F.xxhash64("text")).agg(F.min_by(F.struct(*docs.columns), F.xxhash64(*plain)).alias(row))
    return once.unionByName(one.select(f"{row}.*"))
