"""Embedding near-duplicates by randomised-rotation binary codes.

A vector is rotated at random (by several rotations, so that its code has at least MIN_BITS bits) and
its code is the signs; stored beside it is the correction factor <code, vector>. From one vector's code
and another's rotated coordinates, <code, other> / factor estimates their cosine without bias, with an
error bound that the factor gives. Only pairs whose upper bound reaches the threshold are computed
exactly, in double precision.

Which pairs are estimated: those that agree on all of ``bits`` code bits in one of several tables. The
number of bits follows the number of vectors, so that buckets stay small, and the number of tables
follows from both, so that a pair at the threshold is missed with probability ``miss`` at most (and far
less above it). Equal vectors are one row. A bucket of more than BUCKET rows is split into slots, and
each pair of slots is a task, so that no task holds more than twice that.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .components import components, local_components
from .scratch import Scratch

MIN_BITS = 256
BUCKET = 2048
SIGMAS = 5.0
_rotations: dict[tuple[int, int], np.ndarray] = {}


def rotation(dim: int, bits: int) -> np.ndarray:
    """(dim, columns): stacked random rotations with at least ``bits`` columns, scaled to keep lengths."""
    if (dim, bits) not in _rotations:
        n = -(-bits // dim)
        made = [np.linalg.qr(np.random.default_rng([7, dim, k]).standard_normal((dim, dim)))[0] for k in range(n)]
        _rotations[dim, bits] = np.concatenate(made, axis=1) / math.sqrt(n)
    return _rotations[dim, bits]


def plan(n: int, threshold: float, miss: float) -> tuple[int, int]:
    """Bits of a table's key, number of tables."""
    bits = min(32, max(8, math.ceil(math.log2(max(n, 2) / 12))))
    agree = (1 - math.acos(threshold) / math.pi) ** bits
    return bits, max(1, math.ceil(math.log(miss) / math.log(1 - agree)))


def _valid(kind: str):
    def run(batches):
        for b in batches:
            out = []
            for v in b.column(1):
                x = None
                if v.is_valid and len(v.values) and not v.values.null_count:
                    x = v.values.to_numpy(zero_copy_only=False).astype(kind)
                    if not np.isfinite(x).all() or not x.any():
                        x = None
                out.append(None if x is None else x.tobytes())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.binary())], names=["vec_id", "vec"])

    return run


def _matrix(vecs: list[bytes], kind: str) -> np.ndarray:
    return np.frombuffer(b"".join(vecs), kind).reshape(len(vecs), -1).astype(np.float64)


def _unit(m: np.ndarray) -> np.ndarray:
    m = m / np.abs(m).max(1, keepdims=True)  # no overflow of squares
    return m / np.sqrt(np.einsum("ij,ij->i", m, m))[:, None]


def _encode(kind: str, bits: int):
    """Add code and factor to (node, copies, vec)."""

    def run(batches):
        for b in batches:
            for at in range(0, b.num_rows, 2000):
                part = b.slice(at, 2000)
                vecs = part.column(2).to_pylist()
                codes, factors = [b""] * len(vecs), [0.0] * len(vecs)
                for size in {len(v) for v in vecs}:
                    rows = [i for i, v in enumerate(vecs) if len(v) == size]
                    unit = _unit(_matrix([vecs[i] for i in rows], kind))
                    u = unit @ rotation(unit.shape[1], bits)
                    sign = u > 0
                    factor = np.abs(u).sum(1) / math.sqrt(u.shape[1])
                    for i, c, f in zip(rows, np.packbits(sign, axis=1, bitorder="little"), factor):
                        codes[i], factors[i] = c.tobytes(), float(f)
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, pa.array(codes, pa.binary()), pa.array(factors)],
                    names=["node", "copies", "vec", "code", "factor"],
                )

    return run


def _table_keys(codes: list[bytes], bits: int, tables: int) -> np.ndarray:
    """Keys from the first bits * tables bits; codes of vectors of other lengths may go on longer."""
    need = -(-bits * tables // 8)
    m = np.unpackbits(np.frombuffer(b"".join([c[:need] for c in codes]), np.uint8).reshape(len(codes), need), axis=1, bitorder="little")
    m = m[:, : bits * tables].reshape(len(codes), tables, bits).astype(np.int64)
    return m @ (1 << np.arange(bits, dtype=np.int64))


def _spread(bits: int, tables: int):
    def run(batches):
        for b in batches:
            for at in range(0, b.num_rows, 1000):
                part = b.slice(at, 1000)
                keys = _table_keys(part.column(3).to_pylist(), bits, tables)
                sizes = np.array([len(v) for v in part.column(2).to_pylist()])
                rows = np.repeat(np.arange(len(keys)), tables)
                # vectors of other lengths have keys of their own
                bucket = (np.tile(np.arange(tables), len(keys)) << 32 | keys.ravel()) ^ (sizes[rows] << 48)
                taken = part.take(pa.array(rows))
                yield pa.RecordBatch.from_arrays([pa.array(bucket), *taken.columns], names=["bucket", *part.schema.names])

    return run


def _compare(kind: str, bits: int, tables: int, threshold: float):
    """Of rows sorted by (bucket, i, j): per task the links first met in its table."""

    def task(rows: list[tuple]):
        sizes = {len(r[6]) for r in rows}
        if len(sizes) > 1:  # very long vectors whose buckets' keys agree by chance
            for size in sorted(sizes):
                yield from task([r for r in rows if len(r[6]) == size])
            return
        bucket, i, j = rows[0][:3]
        table = (bucket >> 32) & 0xFFFF
        slot = np.array([r[3] for r in rows])
        node = np.array([r[4] for r in rows], np.int64)
        copies = np.array([r[5] for r in rows], np.int64)
        unit = _unit(_matrix([r[6] for r in rows], kind))
        codes = [r[7] for r in rows]
        factor = np.array([r[8] for r in rows])
        turned = unit @ rotation(unit.shape[1], max(MIN_BITS, bits * tables))
        width = turned.shape[1]
        sign = np.unpackbits(np.frombuffer(b"".join(codes), np.uint8).reshape(len(codes), -1), axis=1, bitorder="little")
        sign = (sign[:, :width].astype(np.float32) * 2 - 1) / math.sqrt(width)
        keys = _table_keys(codes, bits, tables)[:, :table]
        left = np.flatnonzero(slot == i)
        right = left if i == j else np.flatnonzero(slot == j)
        turned = turned.astype(np.float32)
        slack = SIGMAS * np.sqrt(np.maximum(0, 1 - factor**2) / (factor**2 * max(1, width - 1))) + 1e-4
        links = np.zeros(len(rows), np.int64)
        xs, ys = [], []
        for at in range(0, len(left), 512):
            block = left[at : at + 512]
            estimate = (sign[block] @ turned[right].T) / factor[block, None].astype(np.float32)
            maybe = estimate + slack[block, None] >= threshold
            if i == j:
                maybe &= block[:, None] < right[None, :]
            r, c = np.nonzero(maybe)
            for k in range(0, len(r), 100_000):
                x, y = block[r[k : k + 100_000]], right[c[k : k + 100_000]]
                new = np.einsum("ij,ij->i", unit[x], unit[y]) >= threshold
                x, y = x[new], y[new]
                if table and len(x):
                    fresh = ~(keys[x] == keys[y]).any(1)
                    x, y = x[fresh], y[fresh]
                np.add.at(links, x, copies[y])
                np.add.at(links, y, copies[x])
                xs.append(x)
                ys.append(y)
        if not links.any():
            return
        root = local_components(len(rows), np.concatenate(xs), np.concatenate(ys))
        has = np.flatnonzero(links)
        yield pa.RecordBatch.from_arrays(
            [pa.array(node[has]), pa.array(links[has]), pa.array(node[root[has]])], names=["node", "links", "other"]
        )

    def run(batches):
        held: list[tuple] = []
        for b in batches:
            cols = [c.to_pylist() for c in b.columns]
            for row in zip(*cols):
                if held and held[0][:3] != row[:3]:
                    if len(held) > 1:
                        yield from task(held)
                    held = []
                held.append(row)
        if len(held) > 1:
            yield from task(held)

    return run


def near_duplicates(
    vectors: DataFrame,
    scratch: Scratch,
    threshold: float = 0.9,
    miss: float = 0.01,
    id_col: str = "vec_id",
    vec_col: str = "embedding",
) -> DataFrame:
    """vec_id, n_links, component_id, kept of every row.

    Vectors that are null, empty, zero or hold null or non-finite components link with nothing, nor do
    rows with a null id (component_id null, kept false) or vectors of different lengths. Rows that
    repeat an id are rows of their own with links among them; in components they are one id. Vectors may be of
    any lengths. Extra columns are not read. An empty table gives no rows.
    """
    element = vectors.schema[vec_col].dataType.elementType
    kind = "<f4" if isinstance(element, T.FloatType) else "<f8"
    col = F.col(f"`{vec_col}`")
    if kind == "<f8":
        col = col.cast("array<double>")
    rows = vectors.select(F.col(f"`{id_col}`").cast("long").alias("vec_id"), col.alias("vec"))
    rows = rows.mapInArrow(_valid(kind), "vec_id long, vec binary")
    base = scratch.table(rows.withColumn("vec", F.when(F.col("vec_id").isNotNull(), F.col("vec"))), "base")
    reps = base.where("vec is not null").groupBy("vec").agg(F.min("vec_id").alias("low"), F.count("*").alias("copies"))
    reps = scratch.table(reps.withColumn("node", F.monotonically_increasing_id()), "reps")
    bits, tables = plan(reps.count(), threshold, miss)
    width = max(MIN_BITS, bits * tables)
    coded = reps.select("node", "copies", "vec").mapInArrow(
        _encode(kind, width), "node long, copies long, vec binary, code binary, factor double"
    )
    coded = scratch.table(coded, "codes")
    spread = coded.mapInArrow(
        _spread(bits, tables), "bucket long, node long, copies long, vec binary, code binary, factor double"
    )
    counts = scratch.table(spread.select("bucket").groupBy("bucket").count().where("count > 1"), "buckets")
    tasks = counts.select("bucket", F.ceil(F.col("count") / BUCKET).cast("int").alias("slots"))
    rows = spread.join(tasks, "bucket").withColumn("slot", F.pmod(F.xxhash64("node"), F.col("slots")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("slots") - 1)))
    rows = rows.select(
        "bucket", F.least("slot", "other").alias("i"), F.greatest("slot", "other").alias("j"), "slot", "node", "copies",
        "vec", "code", "factor",
    )
    rows = rows.repartition("bucket", "i", "j").sortWithinPartitions("bucket", "i", "j")
    met = rows.mapInArrow(_compare(kind, bits, tables, threshold), "node long, links long, other long")
    met = scratch.table(met, "links")
    roots = components(met.select("node", "other").where("node <> other").distinct(), scratch)
    total = met.groupBy("node").agg(F.sum("links").alias("links"))
    known = reps.join(total, "node", "left").join(roots, "node", "left")
    known = known.select(
        "vec", "low", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("root", "node").alias("root")
    )
    known = scratch.table(known, "known")
    least = known.groupBy("root").agg(F.min("low").alias("component_id"))
    named = known.select("vec", "n_links", "root").join(least, "root").select("vec", "n_links", "component_id")
    out = base.where("vec is not null").join(named, "vec").select("vec_id", "n_links", "component_id")
    alone = base.where("vec is null").select(
        "vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id")
    )
    out = out.unionByName(alone)
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


def op5_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and classes of all embeddings at cosine 0.9."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), Scratch(spark, "embed"))
