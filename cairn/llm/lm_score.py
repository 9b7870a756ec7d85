"""Language-model scores from a log-frequency Bloom filter.

Bigram counts of the training texts are quantised on a logarithmic scale; a bigram of level q is put
in the filter as (bigram, 1) to (bigram, q), and a count is read back by probing levels until one is
missing. The probability of a word is interpolated: with c the count of the word before it and
share = min(SHARE, c / (c + MU)), it is share * count(both) / c + (1 - share) * base(word), where base
is the add-one unigram probability from exact counts.

Words travel as 64-bit hashes. Texts are cut into blocks; a block holds its distinct words and its
texts as indices into them. The filter grows with the corpus, so that probes err equally often at every
size, and thus is never broadcast whole: it is cut into segments by bigram hash, and the distinct words
and bigrams of each block, with their training counts, are shuffled once, to the tasks of their shards.
A task adds up the counts of its shard, fills the shard's segment, and answers each block with the
totals of its words and with the levels that the segment gives its bigrams. There is one plan for all
sizes; shards hold about SHARD_TOKENS tokens' words and bigrams each.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .folds import fold
from .scratch import Scratch
from .wordvec import BLANK_SPLIT, mix, release, split_batches, word_hashes

BLOCK_TOKENS = 500_000
#: Tokens of the corpus for each shard, at most; a task holds the distinct bigrams of as many.
SHARD_TOKENS = 8_000_000
#: Shards at least.
SHARDS = 16
END, START = np.uint64(1), np.uint64(2)
MU, SHARE = 5.0, 0.4
BASE = 1.5
PROBES = 3
BITS_EACH = 6
_LEVEL = np.uint64(0xA0761D6478BD642F)
_NEXT = np.uint64(0xE7037ED1A0B428DB)


def levels_of(counts: np.ndarray) -> np.ndarray:
    """1 + floor(log_BASE(count)) of counts from 1."""
    return 1 + np.floor(np.log(np.maximum(counts, 1)) / np.log(BASE) + 1e-9).astype(np.int64)


#: the count that each level stands for: the middle of those that have it; none for level 0
def level_counts(top: int = 64) -> np.ndarray:
    low = np.ceil(BASE ** np.arange(top) - 1e-9)
    high = np.maximum(low, np.ceil(BASE ** np.arange(1, top + 1) - 1e-9) - 1)
    return np.concatenate([[0.0], (low + high) / 2])


def pair_hashes(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    return mix(left * _NEXT + right)


def probes(h: np.ndarray, level: int | np.ndarray, size: int) -> list[np.ndarray]:
    """Bit places of (bigram, level) in a segment of ``size`` bits."""
    a = mix(h ^ (np.asarray(level, np.uint64) * _LEVEL))
    b = (a >> np.uint64(32)) | np.uint64(1)
    a = a & np.uint64(0xFFFFFFFF)
    return [((a + np.uint64(k) * b) % np.uint64(size)).astype(np.int64) for k in range(PROBES)]


def fill_segment(h: np.ndarray, counts: np.ndarray, size: int) -> bytes:
    """A segment with all levels of the given bigrams."""
    bits = np.zeros(size, bool)
    level = levels_of(counts)
    for q in range(1, int(level.max(initial=0)) + 1):
        for p in probes(h[level >= q], q, size):
            bits[p] = True
    return np.packbits(bits, bitorder="little").tobytes()


def read_levels(data: np.ndarray, short: np.ndarray, start: np.ndarray, size: int) -> np.ndarray:
    """Levels of shortened bigrams, each in the segment of ``size`` bits that begins at its ``start``."""
    level = np.zeros(len(short), np.int64)
    live, q = np.arange(len(short) if size else 0), 0
    while len(live) and q < 63:
        q += 1
        hit = np.ones(len(live), bool)
        for p in probes(short[live], q, size):
            p = p + start[live]
            hit &= (data[p >> 3] >> (p & 7).astype(np.uint8) & 1).astype(bool)
        live = live[hit]
        level[live] = q
    return level


def shard_of(h: np.ndarray, shards: int) -> np.ndarray:
    """shards: a power of two."""
    bits = shards.bit_length() - 1
    return (h >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(h), np.int64)


def shortened(h: np.ndarray) -> np.ndarray:
    """The low 32 bits: with the shard, enough to tell a shard's bigrams apart."""
    return h & np.uint64(0xFFFFFFFF)


def _z(a: np.ndarray) -> bytes:
    return pa.compress(a.tobytes(), "zstd", asbytes=True)


def _unz(b: bytes, n: int, kind: str) -> np.ndarray:
    return np.frombuffer(pa.decompress(b, n * np.dtype(kind).itemsize, "zstd", asbytes=True), kind) if n else np.zeros(0, kind)


_BLOCK = (
    "block long, doc_ids array<long>, held array<boolean>, sizes array<int>, n_words long, words binary, counts binary, "
    "n_stream long, stream binary, train_tokens long"
)


def _encode(batches):
    """Blocks of (doc_id, held, text)."""
    from pyspark import TaskContext

    first_block = TaskContext.get().partitionId() << 32
    ids, held, hashes, sizes = [], [], [], []
    total = made = 0

    def flush():
        h = np.concatenate(hashes)
        words, stream = np.unique(h, return_inverse=True)
        train = np.repeat(~np.array(held, bool), sizes)
        counts = np.bincount(stream[train], minlength=len(words)).astype("<u4")
        row = {
            "block": pa.array([first_block + made], pa.int64()), "doc_ids": pa.array([ids], pa.list_(pa.int64())),
            "held": pa.array([held], pa.list_(pa.bool_())), "sizes": pa.array([sizes], pa.list_(pa.int32())),
            "n_words": pa.array([len(words)], pa.int64()), "words": pa.array([words.astype("<u8").tobytes()], pa.binary()),
            "counts": pa.array([_z(counts)], pa.binary()), "n_stream": pa.array([len(stream)], pa.int64()),
            "stream": pa.array([_z(stream.astype("<u4"))], pa.binary()), "train_tokens": pa.array([int(train.sum())], pa.int64()),
        }
        return pa.RecordBatch.from_pydict(row)

    for b in split_batches(batches, 2):
        h, first = word_hashes(b.column(2), BLANK_SPLIT)
        n = np.diff(first)
        # an end after each text
        full = np.full(len(h) + len(n), END, np.uint64)
        full[np.arange(len(h)) + np.repeat(np.arange(len(n)), n)] = h
        hashes.append(full)
        ids += b.column(0).to_pylist()
        held += b.column(1).to_pylist()
        sizes += (n + 1).tolist()
        total += len(full)
        if total >= BLOCK_TOKENS:
            yield flush()
            ids, held, hashes, sizes = [], [], [], []
            total, made = 0, made + 1
    if ids:
        yield flush()


def _rows(rows: list[tuple], names: list[str], kinds: list) -> pa.RecordBatch:
    cols = list(zip(*rows)) or [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=names)


def _contexts(stream: np.ndarray, sizes: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of previous words, and of words, for every token."""
    right = words[stream]
    left = np.empty_like(right)
    left[1:] = right[:-1]
    left[np.cumsum(sizes) - sizes] = START
    return left, right


def _block_pairs(stream: np.ndarray, sizes: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct bigrams of a block in order of their hashes, and which of them each token is."""
    left, right = _contexts(stream, sizes, words)
    return np.unique(pair_hashes(left, right), return_inverse=True)


_ASKED = "shard int, block long, n_words long, words binary, counts binary, n_pairs long, pairs binary, pair_counts binary"


def _ask(shards: int):
    """For each block and shard the distinct words and bigrams, with their training counts."""
    kinds = [pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.int64(), pa.binary(), pa.binary()]
    names = [x.split()[0] for x in _ASKED.split(", ")]

    def run(batches):
        for b in batches:
            for block, held, sizes, n_words, words, counts, n_stream, stream in zip(*(b.column(k).to_pylist() for k in range(8))):
                words, counts, sizes = np.frombuffer(words, "<u8"), _unz(counts, n_words, "<u4"), np.array(sizes)
                h, which = _block_pairs(_unz(stream, n_stream, "<u4"), sizes, words)
                train = np.repeat(~np.array(held, bool), sizes)
                c = np.bincount(which[train], minlength=len(h)).astype("<u4")
                low = shortened(h).astype("<u4")
                of_words, of_pairs = (np.searchsorted(shard_of(x, shards), np.arange(shards + 1)).tolist() for x in (words, h))
                rows = []
                for k, (i, j, x, y) in enumerate(zip(of_words, of_words[1:], of_pairs, of_pairs[1:])):
                    if j > i or y > x:
                        rows.append((k, block, j - i, words[i:j].tobytes(), _z(counts[i:j]), y - x, low[x:y].tobytes(), _z(c[x:y])))
                yield _rows(rows, names, kinds)
        release()

    return run


_ANSWERS = "block long, shard int, n_words long, totals binary, n_pairs long, levels binary, known long, tokens long"


def _answer(size: int):
    """What a shard says to each block: total counts of its words, and the levels of its bigrams by the shard's segment."""

    def run(t: pa.Table) -> pa.Table:
        n_words, n_pairs = (t.column(c).to_pylist() for c in ("n_words", "n_pairs"))

        def whole(column, sizes=None, kind="<u4"):
            parts = t.column(column).to_pylist()
            return np.concatenate([np.frombuffer(x, kind) if sizes is None else _unz(x, n, kind) for x, n in zip(parts, sizes or parts)])

        distinct, place = np.unique(whole("words", kind="<u8"), return_inverse=True)
        total = np.bincount(place, whole("counts", n_words).astype(float), len(distinct)).astype("<i8")
        known, tokens = int((total > 0).sum()), int(total.sum())
        totals = [_z(x) for x in np.split(total[place], np.cumsum(n_words)[:-1])]
        del distinct, place

        h = whole("pairs")
        order = np.argsort(h, kind="stable")
        begin = np.flatnonzero(np.diff(h[order].astype(np.int64), prepend=-1))
        levels = np.zeros(len(h), np.uint8)
        if len(h):
            count = np.add.reduceat(whole("pair_counts", n_pairs)[order].astype(np.int64), begin)
            h = h[order[begin]].astype(np.uint64)
            segment = np.frombuffer(fill_segment(h[count > 0], count[count > 0], size), np.uint8)
            level = read_levels(segment, h, np.zeros(len(h), np.int64), size).astype(np.uint8)
            levels[order] = np.repeat(level, np.diff(begin, append=len(order)))
        out = [
            t.column("block"), t.column("shard"), t.column("n_words"), pa.array(totals, pa.binary()), t.column("n_pairs"),
            pa.array([_z(x) for x in np.split(levels, np.cumsum(n_pairs)[:-1])], pa.binary()),
            pa.array([known, *[0] * (len(totals) - 1)], pa.int64()), pa.array([tokens, *[0] * (len(totals) - 1)], pa.int64()),
        ]
        release()
        return pa.table(out, names=[x.split()[0] for x in _ANSWERS.split(", ")])

    return run


def _power(n: float) -> int:
    return 1 << max(0, int(np.ceil(np.log2(max(1.0, n)))))


_OUT = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def score(
    docs: DataFrame,
    held_out,
    scratch: Scratch,
    mu: float = MU,
    most: float = SHARE,
    id_col: str = "doc_id",
    text_col: str = "text",
    bits_each: float = BITS_EACH,
    shard_tokens: int = SHARD_TOKENS,
) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row.

    held_out: a boolean column; the model learns from the other rows. bits_each: bits of the filter for
    each training token. Null and empty texts have the end token alone. Repeated rows count as often as
    they occur. A text longer than a block is a block of its own, taken whole. Other columns are not
    read, whatever their names. Nothing to learn from: every word is unknown. An empty table gives no
    rows.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), held_out.alias("held"), F.col(text_col).cast("string").alias("text"))
    blocks = scratch.table(rows.mapInArrow(_encode, _BLOCK), "blocks")
    size = blocks.agg(
        F.sum("n_stream").alias("stream"), F.sum("train_tokens").alias("tokens"),
        F.sum(F.aggregate("held", F.lit(0), lambda a, h: a + (~h).cast("int"))).alias("train_docs"),
    ).first()
    shards = _power(max(SHARDS, (size.stream or 0) / shard_tokens))
    segment = max(1024, int(bits_each * (size.tokens or 0)) // shards // 64 * 64)
    asked = blocks.select("block", "held", "sizes", "n_words", "words", "counts", "n_stream", "stream").mapInArrow(_ask(shards), _ASKED)
    answers = scratch.table(asked.groupBy("shard").applyInArrow(_answer(segment), _ANSWERS), "answers")
    stats = answers.agg(F.sum("known").alias("known"), F.sum("tokens").alias("tokens")).first()
    vocabulary, tokens = int(stats.known or 0), int(stats.tokens or 0)
    starts = int(size.train_docs or 0)

    def run(block: pa.Table, said: pa.Table) -> pa.Table:
        said = said.sort_by([("shard", "ascending")])
        get = lambda c: block.column(c)[0].as_py()
        words, sizes, stream = np.frombuffer(get("words"), "<u8"), np.array(get("sizes")), _unz(get("stream"), get("n_stream"), "<u4")
        whole = lambda c, n, kind: np.concatenate([_unz(x, k, kind) for x, k in zip(said.column(c).to_pylist(), said.column(n).to_pylist())])
        count = whole("totals", "n_words", "<i8")[stream]
        first = np.cumsum(sizes) - sizes
        base = np.log10(count + 1.0) - np.log10(tokens + vocabulary + 1)
        before = np.empty(len(stream))
        before[1:] = count[:-1]
        before[first] = starts
        both = level_counts()[whole("levels", "n_pairs", "u1")[_block_pairs(stream, sizes, words)[1]]]
        both = np.minimum(both, np.minimum(before, count))
        share = np.minimum(most, before / (before + mu))
        score = np.log10(share * both / np.maximum(before, 1) + (1 - share) * 10**base)
        out = [
            pa.array(get("doc_ids"), pa.int64()), pa.array(get("held"), pa.bool_()), pa.array(sizes, pa.int64()),
            pa.array(np.add.reduceat((count > 0).astype(np.int64), first)), pa.array(np.full(len(sizes), tokens, np.int64)),
            pa.array(np.add.reduceat(base, first)), pa.array(np.add.reduceat(score, first)),
        ]
        release()
        return pa.table(out, names=[x.split()[0] for x in _OUT.split(", ")])

    kept = blocks.select("block", "doc_ids", "held", "sizes", "words", "n_stream", "stream")
    said = answers.select("block", "shard", "n_words", "totals", "n_pairs", "levels")
    return kept.groupBy("block").cogroup(said.groupBy("block")).applyInArrow(run, _OUT)


def op8_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score all documents; those in fold 2 of 7 are held out."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return score(docs, fold("doc_id", 7) == 2, Scratch(spark, "lm"))
