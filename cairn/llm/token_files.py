"""Token ids in files of directly addressable codes.

Every id is cut into 8-bit chunks. Level 0 holds the lowest chunk of every token; a bitmap says of
which tokens higher chunks follow, and those lie in level 1, and so on. A rank directory counts the
set bits before every 512th bit, so the place of a token's next chunk is one lookup and the count of
at most 512 bits. Any token, or any range of tokens, is read without decoding what stands before it.

A file: magic, JSON header with the places of its parts, doc ids (int64), first tokens (int64, with
the end), then for each level its chunks, bitmap and directory.
"""

from __future__ import annotations

import json
import struct
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import encoder
from .scratch import Scratch
from .wordvec import split_batches

MAGIC = b"CAIRNDAC"
RANK_BITS = 512
NO_ID = -(2**63)


def encode_levels(ids: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Chunks, packed continuation bitmap and rank directory of each level."""
    out, rest = [], ids.astype(np.uint32)
    while True:
        more = rest > 255
        bits = np.packbits(more, bitorder="little")
        pad = np.zeros(-(-len(more) // RANK_BITS) * RANK_BITS, bool)
        pad[: len(more)] = more
        ranks = np.concatenate([[0], np.cumsum(pad.reshape(-1, RANK_BITS).sum(1))]).astype(np.uint64)
        out.append(((rest & 255).astype(np.uint8), bits, ranks))
        if not more.any():
            return out
        rest = rest[more] >> 8


def pack_file(doc_ids: list, ids: list[bytes]) -> bytes:
    """One file of whole documents; ids are packed little-endian unsigned 32-bit integers."""
    starts = np.concatenate([[0], np.cumsum([len(x) // 4 for x in ids])]).astype("<i8")
    parts = [np.array([NO_ID if d is None else d for d in doc_ids], "<i8").tobytes(), starts.tobytes()]
    for chunks, bits, ranks in encode_levels(np.frombuffer(b"".join(ids), "<u4")):
        parts += [chunks.tobytes(), bits.tobytes(), ranks.astype("<u8").tobytes()]
    head = json.dumps({"docs": len(doc_ids), "tokens": int(starts[-1]), "parts": [len(p) for p in parts]}).encode()
    return b"".join([MAGIC, struct.pack("<I", len(head)), head, *parts])


class TokenFile:
    """Random access to a file's bytes."""

    def __init__(self, raw: bytes | memoryview):
        raw = memoryview(raw)
        if bytes(raw[:8]) != MAGIC:
            raise ValueError("not a token file")
        n = struct.unpack_from("<I", raw, 8)[0]
        head = json.loads(bytes(raw[12 : 12 + n]))
        at, cut = 12 + n, []
        for size in head["parts"]:
            cut.append(raw[at : at + size])
            at += size
        self.doc_ids = np.frombuffer(cut[0], "<i8")
        self.starts = np.frombuffer(cut[1], "<i8")
        self.n_tokens = head["tokens"]
        self.levels = [
            (np.frombuffer(cut[k], np.uint8), np.frombuffer(cut[k + 1], np.uint8), np.frombuffer(cut[k + 2], "<u8"))
            for k in range(2, len(cut), 3)
        ]

    @staticmethod
    def _rank(level, i: int) -> int:
        """Set bits before bit i."""
        _, bits, ranks = level
        block = i // RANK_BITS
        first = block * RANK_BITS // 8
        whole = int(np.bitwise_count(bits[first : i // 8]).sum())
        part = int(bits[i // 8]) & ((1 << (i % 8)) - 1) if i % 8 else 0
        return int(ranks[block]) + whole + part.bit_count()

    def token(self, i: int) -> int:
        if not 0 <= i < self.n_tokens:
            raise IndexError(i)
        value = 0
        for k, level in enumerate(self.levels):
            value |= int(level[0][i]) << (8 * k)
            if not level[1][i // 8] >> (i % 8) & 1:
                break
            i = self._rank(level, i)
        return value

    def tokens(self, a: int, b: int) -> np.ndarray:
        """Tokens a to b, b not included."""
        out = np.zeros(b - a, np.uint32)
        place = np.arange(b - a)
        for k, level in enumerate(self.levels):
            if b <= a:
                break
            out[place] |= level[0][a:b].astype(np.uint32) << np.uint32(8 * k)
            more = np.unpackbits(level[1][a // 8 : -(-b // 8)], bitorder="little")[a % 8 : a % 8 + b - a].astype(bool)
            place = place[more]
            a = self._rank(level, a)
            b = a + len(place)
        return out

    def document(self, k: int) -> np.ndarray:
        return self.tokens(int(self.starts[k]), int(self.starts[k + 1]))


def _filesystem(root: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(root) if "://" in root else fs.FileSystem.from_uri("file://" + root)


def write_token_files(
    docs: DataFrame,
    root: str,
    vocabulary: str = "byte_bpe_50k.json",
    end_id: int = 2,
    tokens_per_file: int = 16_000_000,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Write all documents in ascending id order (null ids first) and return a row for each file.

    root: a folder that all executors reach, by any address pyarrow's file systems open.
    Equal ids keep all their rows, in the order of their texts' hashes. A null text is an empty one. Very long
    texts are encoded whole, piece by piece. Extra columns are not read. An empty table gives no file.
    A retried task writes under new names; only files that the returned rows name are part of the result.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    rows = rows.withColumn("tie", F.xxhash64("text")).repartitionByRange("doc_id", "tie")
    rows = rows.sortWithinPartitions("doc_id", "tie").select("doc_id", "text")

    def write(batches):
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        store, folder = _filesystem(root)
        store.create_dir(folder, recursive=True)
        enc, end = encoder(vocabulary), struct.pack("<I", end_id)
        ids, coded, held, seq = [], [], 0, 0

        def flush():
            name = f"{folder}/{part:07d}-{seq:05d}-{uuid.uuid4().hex[:8]}.dac"
            raw = pack_file(ids, coded)
            with store.open_output_stream(name) as f:
                f.write(raw)
            return pa.RecordBatch.from_pydict(
                {
                    "part": pa.array([part], pa.int32()), "seq": pa.array([seq], pa.int32()), "path": [name],
                    "n_docs": pa.array([len(ids)], pa.int64()), "n_tokens": pa.array([held], pa.int64()),
                    "n_bytes": pa.array([len(raw)], pa.int64()),
                }
            )

        for b in split_batches(batches, 1):
            for d, x in zip(b.column(0).to_pylist(), enc.encode(b.column(1))):
                ids.append(d)
                coded.append(x + end)
                held += len(x) // 4 + 1
                if held >= tokens_per_file:
                    yield flush()
                    ids, coded, held, seq = [], [], 0, seq + 1
        if ids:
            yield flush()

    return rows.mapInArrow(write, "part int, seq int, path string, n_docs long, n_tokens long, n_bytes long")


def read_token_files(files: DataFrame, root: str) -> DataFrame:
    """Each document of the files: doc_id, start (over all files), n_tokens, ids_crc32."""
    from pyspark.sql import Window

    order = Window.orderBy("part", "seq").rowsBetween(Window.unboundedPreceding, -1)
    placed = files.select("part", "seq", "path", F.coalesce(F.sum("n_tokens").over(order), F.lit(0)).alias("base"))
    placed = placed.repartitionByRange(max(1, min(files.count(), 4096)), "part", "seq")

    def read(batches):
        store, _ = _filesystem(root)
        for b in batches:
            for path, base in zip(b.column(2).to_pylist(), b.column(3).to_pylist()):
                with store.open_input_file(path) as f:
                    t = TokenFile(f.read())
                n = np.diff(t.starts)
                for i in range(0, len(n), 20_000):
                    some = range(i, min(i + 20_000, len(n)))
                    crc = [zlib.crc32(t.document(k).astype("<u4").tobytes()) for k in some]
                    ids = t.doc_ids[some.start : some.stop]
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(ids, pa.int64(), mask=ids == NO_ID),
                            pa.array(t.starts[some.start : some.stop] + base, pa.int64()),
                            pa.array(n[some.start : some.stop], pa.int64()), pa.array(crc, pa.int64()),
                        ],
                        names=["doc_id", "start", "n_tokens", "ids_crc32"],
                    )

    return placed.mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write all documents' ids and read them back."""
    scratch = Scratch(spark, "tokens")
    root = scratch.path("files")
    files = write_token_files(spark.read.parquet(f"{sf_dir}/documents.parquet"), root)
    return read_token_files(scratch.table(files, "manifest"), root)
