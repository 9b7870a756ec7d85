"""SimHash near-duplicates, linked by Golay-code fuzzy hashing.

A 64-bit fingerprint is cut into segments of 22, 21 and 21 bits. With at most 3 differing bits, either
some segment is equal and another differs in one bit at most, or each differs in exactly one. So
fingerprints meet on (an equal segment, the Golay index of another) or on (the Golay indices of the
first two segments, all three parities flipped): each gives its home keys, looks up the keys of all
near indices, and the pairs that meet are verified.

Equal fingerprints are one node. Where over DENSE fingerprints share a home key, those among them that
have a neighbour one bit away in common (at most 65 fingerprints have) are linked first; in such keys
only members of different components are then compared, so that groups of copies never make all pairs.
"""

from __future__ import annotations

from itertools import permutations, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .components import components
from .golay import near_indices
from .scratch import Scratch, shuffled
from .wordvec import split_batches

DISTANCE = 3
DENSE = 64
WIDTHS = (22, 21, 21)
_PAIRS = list(permutations(range(3), 2))
_ONES = ((np.arange(256)[:, None] >> np.arange(8)) & 1).astype(np.int64)
#: Shingles whose hashes are held at once.
HELD = 1 << 17


def fingerprint(words, shingle: int = 3) -> int:
    """Bit b is set if over half of the shingles' XXH64 (seed 42) have it; zero for no words."""
    from xxhash import xxh64_intdigest

    if not words:
        return 0
    if len(words) < shingle:
        return xxh64_intdigest(b" ".join(words), 42)
    n = len(words) - shingle + 1
    counts = np.zeros(64, np.int64)
    for at in range(0, n, HELD):
        m = min(HELD, n - at)
        runs = zip(*[words[at + k : at + k + m] for k in range(shingle)])
        h = np.fromiter(map(xxh64_intdigest, map(b" ".join, runs), repeat(42)), np.uint64, m).view(np.uint8).reshape(m, 8)
        for byte in range(8):
            counts[8 * byte : 8 * byte + 8] += np.bincount(h[:, byte], minlength=256) @ _ONES
    return sum(1 << b for b in np.flatnonzero(counts * 2 > n).tolist())


def fingerprints(docs: DataFrame, shingle: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fp: the fingerprint as a signed 64-bit integer. Null texts are empty: fingerprint zero."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))

    def run(batches):
        for b in split_batches(batches, 1):
            # bytes.split() parts words at \x20 and \x09-\x0D only, bytes.lower() changes A-Z only
            fps = [fingerprint(t.lower().split(), shingle) if t else 0 for t in b.column(1).cast(pa.binary()).to_pylist()]
            fps = np.array(fps, np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps)], names=["doc_id", "fp"])

    return rows.mapInArrow(run, "doc_id long, fp long")


def _segments(fp: np.ndarray) -> list[np.ndarray]:
    out, at = [], 0
    x = fp.view(np.uint64)
    for w in WIDTHS:
        out.append(((x >> np.uint64(at)) & np.uint64((1 << w) - 1)).astype(np.int64))
        at += w
    return out


def _keys(homes: bool):
    """Of batches of (fp, comp): home keys, or the keys to look up."""

    def run(batches):
        for b in batches:
            for at in range(0, b.num_rows, 20_000):
                part = b.slice(at, 20_000)
                fp, comp = (part.column(k).to_numpy() for k in (0, 1))
                seg = _segments(fp)
                near = [near_indices(s) for s in seg]
                odd = [np.bitwise_count(s.astype(np.uint64)).astype(np.int64) & 1 for s in seg]
                keys, who = [], []
                everyone = np.arange(len(fp))

                def add(key, rows):
                    keys.append(key)
                    who.append(rows)

                for t, (i, j) in enumerate(_PAIRS):  # segment i equal, segment j at most one bit apart
                    index, count = near[j]
                    for k in range(1 if homes else 6):
                        has = everyone if k == 0 else np.flatnonzero(count > k)
                        add((t << 40) | (seg[i][has] << 12) | index[has, k], has)
                parity = odd[0] | odd[1] << 1 | odd[2] << 2  # one bit apart in each
                for k in range(1 if homes else 6):
                    for m in range(1 if homes else 6):
                        has = np.flatnonzero((near[0][1] > k) & (near[1][1] > m))
                        p = parity[has] if homes else parity[has] ^ 7
                        add((6 << 40) | (p << 24) | (near[0][0][has, k] << 12) | near[1][0][has, m], has)
                who = np.concatenate(who)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(keys)), pa.array(fp[who]), pa.array(comp[who])], names=["key", "fp", "comp"]
                )

    return run


def _pairs(home: DataFrame, probe: DataFrame, on: list[str]) -> DataFrame:
    h = home.select(*on, F.col("fp").alias("a"), F.col("comp").alias("ca"))
    p = probe.select(*on, F.col("fp").alias("b"), F.col("comp").alias("cb"))
    near = (F.col("ca") != F.col("cb")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= DISTANCE)
    hj, pj = h.alias("h"), p.alias("p")
    cond = near
    for c in on:
        cond = (F.col(f"h.{c}") == F.col(f"p.{c}")) & cond
    return hj.join(shuffled(pj), cond).select("ca", "cb")


def link(fps: DataFrame, scratch: Scratch) -> DataFrame:
    """fps: one column fp of distinct fingerprints. Returns (node, root) of those that have links."""
    fps = fps.select("fp", F.col("fp").alias("comp"))
    home = scratch.table(fps.mapInArrow(_keys(True), "key long, fp long, comp long"), "home")
    dense = scratch.table(home.groupBy("key").count().where(F.col("count") > DENSE).select("key"), "dense")
    crowd = home.join(shuffled(dense), "key", "left_semi").select("fp").distinct()
    balls = crowd.select(
        "fp", F.explode(F.array(F.col("fp"), *[F.col("fp").bitwiseXOR(F.lit(_signed(1 << k))) for k in range(64)])).alias("v")
    )
    balls = balls.groupBy("v").agg(F.collect_list("fp").alias("fps")).where(F.size("fps") > 1)
    first = balls.select(F.explode("fps").alias("a"), F.array_min("fps").alias("b")).where("a <> b").distinct()
    first = scratch.table(components(first, scratch, "balls"), "first")

    labelled = fps.select("fp").join(shuffled(first.withColumnRenamed("node", "fp")), "fp", "left")
    labelled = scratch.table(labelled.select("fp", F.coalesce("root", "fp").alias("comp")), "labelled")
    homes = labelled.mapInArrow(_keys(True), "key long, fp long, comp long")
    probes = labelled.mapInArrow(_keys(False), "key long, fp long, comp long")
    # one shuffle of each by key serves both kinds of keys
    homes, probes = (x.join(shuffled(dense.withColumn("dense", F.lit(True))), "key", "left") for x in (homes, probes))
    thin_h, thin_p = (x.where("dense is null").drop("dense") for x in (homes, probes))
    links = _pairs(thin_h, thin_p, ["key"])

    thick_h, thick_p = (x.where("dense").drop("dense") for x in (homes, probes))
    main = thick_h.groupBy("key", "comp").count().groupBy("key").agg(F.max_by("comp", F.struct("count", "comp")).alias("main"))
    main = scratch.table(main, "main")
    is_main = F.col("comp") == F.col("main")
    h = thick_h.join(shuffled(main), "key").withColumn("side", is_main.cast("int"))
    p = thick_p.join(shuffled(main), "key").withColumn("side", F.explode(F.when(is_main, F.array(F.lit(0))).otherwise(F.array(F.lit(0), F.lit(1)))))
    links = links.unionByName(_pairs(h, p, ["key", "side"]))
    links = links.unionByName(first.select(F.col("node").alias("ca"), F.col("root").alias("cb")))
    out = components(links, scratch, "links")
    scratch.drop(home, dense, first, labelled, main)
    return out


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def classes(docs: DataFrame, scratch: Scratch, shingle: int = 3) -> DataFrame:
    """doc_id, fp, component_id: the smallest doc_id reachable over links.

    One row for each row of ``docs``; rows with a null id have a class, but never name one unless all
    of it are null. Repeated rows are equal fingerprints. Null and empty texts all have fingerprint zero. Very
    long texts are read whole. Extra columns are not read. An empty table gives no rows.
    """
    base = scratch.table(fingerprints(docs, shingle), "fingerprints")
    distinct = scratch.table(base.groupBy("fp").agg(F.min("doc_id").alias("low")), "distinct")
    roots = scratch.table(link(distinct.select("fp"), scratch), "roots")
    named = distinct.join(shuffled(roots.withColumnRenamed("node", "fp")), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    named = scratch.table(named, "named")
    least = named.groupBy("root").agg(F.min("low").alias("component_id"))
    ids = named.select("fp", "root").join(shuffled(least), "root").select("fp", "component_id")
    return base.join(shuffled(ids), "fp").select("doc_id", "fp", "component_id")


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints and near-duplicate classes of all documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = classes(docs, Scratch(spark, "simhash"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
