"""Best-fit packing of documents into token sequences, improved by swap-based local search.

Pieces as long as a sequence stand alone. The rest are dealt at random to groups of bounded size and
each group is packed by best fit in decreasing order; then items of the emptiest bins are moved, and
exchanged one for one or two for one, into fuller bins, which raises the sum of squared fills until
bins are empty. The pieces of the bins that groups leave underfull, one or two a group, are then packed
once more together, so that what is lost does not follow the number of groups.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import encoder
from .scratch import Scratch
from .wordvec import split_batches

GROUP = 20_000
#: Trials of the local search for each group, and items of a source bin that are paired. Both bound time
#: only: where they end the search early, pieces stay where best fit has put them, and none is lost.
SEARCH = 60_000
PAIRED = 24
#: A bin with less of its room used is packed again with those of other groups.
FULL = 0.98


def best_fit(sizes: np.ndarray, capacity: int) -> list[list[int]]:
    """Bins of item numbers; each item goes, largest first, where the least room is left."""
    bins: list[list[int]] = []
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    rooms = 0  # bit r: some bin has room r
    for i in np.argsort(-sizes, kind="stable").tolist():
        s = int(sizes[i])
        fits = rooms >> s
        if fits:
            room = s + (fits & -fits).bit_length() - 1
            b = by_room[room].pop()
            if not by_room[room]:
                rooms &= ~(1 << room)
            bins[b].append(i)
        else:
            room, b = capacity, len(bins)
            bins.append([i])
        by_room[room - s].append(b)
        rooms |= 1 << (room - s)
    return bins


def improve(bins: list[list[int]], sizes: np.ndarray, capacity: int, search: int = SEARCH) -> list[list[int]]:
    """Empty bins by moves and exchanges, each of which raises the sum of squared fills.

    search: trials at most; two-for-one exchanges take the source's PAIRED largest items. A group at its
    lower bound is left as it is.
    """
    least = -(-int(sizes.sum()) // capacity)
    where = np.empty(len(sizes), np.int64)
    for b, items in enumerate(bins):
        where[items] = b
    fill = np.array([int(sizes[x].sum()) for x in bins], np.int64)
    bins = [list(x) for x in bins]
    left, stuck = sum(map(bool, bins)), set()
    while left > least and search > 0:
        open_bins = [b for b in np.flatnonzero((fill > 0) & (fill < capacity)).tolist() if b not in stuck]
        if not open_bins:
            break
        src = min(open_bins, key=fill.__getitem__)
        pool = np.flatnonzero((fill[where] < capacity) & (where != src))
        size, room = sizes[pool], capacity - fill[where[pool]]
        done = False
        items = sorted(bins[src], key=lambda i: -sizes[i])
        # a move
        for i in items:
            search -= 1
            fits = np.flatnonzero((fill > 0) & (capacity - fill >= sizes[i]))
            fits = fits[(fits != src) & (fill[fits] + sizes[i] > fill[src])]
            if len(fits):
                to = int(fits[np.argmax(fill[fits])])
                bins[src].remove(i)
                bins[to].append(i)
                where[i] = to
                fill[to] += sizes[i]
                fill[src] -= sizes[i]
                done = True
                break
        # exchanges: one or two of the source's items for one item of a fuller bin
        if not done and len(pool):
            gives = [(i,) for i in items] + [(i, j) for k, i in enumerate(items[:PAIRED]) for j in items[k + 1 : PAIRED]]
            best = None
            for give in gives:
                search -= 1
                g = int(sizes[list(give)].sum())
                gain = g - size
                ok = (gain > 0) & (gain <= room) & (fill[where[pool]] + gain > fill[src])
                if ok.any():
                    k = int(np.argmax(np.where(ok, gain, -1)))
                    if best is None or gain[k] > best[0]:
                        best = (int(gain[k]), give, int(pool[k]))
            if best:
                gain, give, back = best
                to = int(where[back])
                bins[to].remove(back)
                bins[src].append(back)
                where[back] = src
                for i in give:
                    bins[src].remove(i)
                    bins[to].append(i)
                    where[i] = to
                fill[to] += gain
                fill[src] -= gain
                done = True
        if not done:
            stuck.add(src)
        elif not fill[src]:
            left -= 1
            stuck.clear()
    return [x for x in bins if x]


def pieces_of(
    docs: DataFrame, vocabulary: str, end_id: int, length: int, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of every piece of every document."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))

    def cut(batches):
        enc, end = encoder(vocabulary), struct.pack("<I", end_id)
        for b in split_batches(batches, 1):
            out = []
            for d, x in zip(b.column(0).to_pylist(), enc.encode(b.column(1))):
                x += end
                for k, at in enumerate(range(0, len(x), 4 * length)):
                    part = x[at : at + 4 * length]
                    out.append((d, k, at // 4, len(part) // 4, zlib.crc32(part)))
            cols = list(zip(*out))
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(cols, [pa.int64(), pa.int32(), *[pa.int64()] * 3])],
                names=["doc_id", "piece", "start", "length", "ids_crc32"],
            )

    return rows.mapInArrow(cut, "doc_id long, piece int, start long, length long, ids_crc32 long")


def _pack(length: int):
    def pack(table: pa.Table) -> pa.Table:
        table = table.sort_by([("row", "ascending")])
        sizes = table.column("length").to_numpy().astype(np.int64)
        group = table.column("pack_group")[0].as_py()
        bins = improve(best_fit(sizes, length), sizes, length)
        seq, off = np.empty(len(sizes), np.int64), np.empty(len(sizes), np.int64)
        for b, items in enumerate(bins):
            seq[items] = b
            off[items] = np.cumsum(sizes[items]) - sizes[items]
        out = table.drop_columns(["row", "pack_group"])
        return out.append_column("sequence_id", pa.array(seq + (group << 32))).append_column("offset", pa.array(off))

    return pack


def pack_documents(
    docs: DataFrame,
    vocabulary: str = "word_bpe_49k.json",
    end_id: int = 0,
    length: int = 2048,
    group: int = GROUP,
    scratch: Scratch | None = None,
) -> DataFrame:
    """Place every piece in a sequence: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    A null text is an empty one, and has its end id alone. Repeated ids and rows each have their pieces.
    Very long texts are encoded whole, and cut into whole pieces and a rest. Extra columns are not read. An empty
    table gives no rows. Sequences of whole pieces have negative numbers.
    """
    spark = docs.sparkSession
    scratch = scratch or Scratch(spark, "pack")
    pieces = scratch.table(pieces_of(docs, vocabulary, end_id, length), "pieces")
    short = pieces.where(F.col("length") < length)
    groups = max(1, -(-short.count() // group))
    row = F.monotonically_increasing_id()
    whole = pieces.where(F.col("length") == length).select(
        "*", (-1 - row).alias("sequence_id"), F.lit(0).cast("long").alias("offset")
    )
    packed = _packed(short, groups, length)
    if groups > 1:
        packed = scratch.table(packed, "packed")
        loose = packed.groupBy("sequence_id").agg(F.sum("length").alias("fill")).where(F.col("fill") < FULL * length)
        loose = scratch.table(loose.select("sequence_id"), "loose")  # a few for each group
        again = packed.join(loose, "sequence_id", "left_semi").drop("sequence_id", "offset")
        again = _packed(again, max(1, -(-again.count() // group)), length)
        again = again.withColumn("sequence_id", F.col("sequence_id") + F.lit(1 << 62))
        packed = packed.join(loose, "sequence_id", "left_anti").unionByName(again)
    return whole.unionByName(packed)


def _packed(pieces: DataFrame, groups: int, length: int) -> DataFrame:
    row = F.monotonically_increasing_id()
    dealt = pieces.withColumn("row", row).withColumn("pack_group", F.pmod(F.xxhash64("row"), F.lit(groups)))
    return dealt.groupBy("pack_group").applyInArrow(
        _pack(length), "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    )


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pack all documents into sequences of 2048 tokens."""
    return pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
