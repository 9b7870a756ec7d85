"""Benchmark decontamination by spaced-seed hashing.

A seed is a fixed mask over consecutive words: the words under its zeros are ignored, so a hash meets
its counterpart across substituted words. Hashes of all positions of the benchmark's items are joined
with those of all positions of the documents. Around a hit, document and item are compared word by
word along the hit's diagonal; the stretches with at least IDENTITY of their words equal count, those
on neighbouring diagonals (inserted or lost words) together. Items of fewer words than the longest mask
have masks of their own, which meet every substitution that IDENTITY allows them.

A table of bits over the benchmark's hashes, of bounded size, goes to the documents first: only hashes
that it may hold, and the words of texts with such hashes, are ever shuffled. Equal texts are compared
once.
"""

from __future__ import annotations

from itertools import combinations, pairwise
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import bit_table
from .scratch import Scratch, fresh
from .wordvec import ALNUM_SPLIT, mix, split_batches, word_hashes

MASKS = ("111111", "1101010011", "1110010101", "110010111")
IDENTITY = 0.8
#: Words of a verified overlap: so many, or IDENTITY of a shorter item's.
WORDS = 13
#: Words of a stretch at least.
STRETCH = 5
#: Words that may be inserted or lost between two stretches: so many, or a tenth of the item's.
SHIFT = 8
#: Words of an item whose overlap removes a document; shorter ones are reported only.
ITEM_WORDS = 5
#: Hashes of the benchmark that are sent to all tasks for the join; more of them are joined by shuffling both sides.
SENT = 1_000_000
#: Bits of the table for each of the benchmark's hashes, places of a hash in it, and bits at most (64 MB).
BITS_A_SEED, MULTIPLIERS, MOST_BITS = 32, (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5), 1 << 29
#: Seeds in common that are held at once.
HITS = 1 << 20
_ROOT = np.uint64(0xD6E8FEB86659FD93)


def seed_hashes(h: np.ndarray, mask: str, salt: int) -> np.ndarray:
    """Hash of the words under the mask's ones, at every position where the mask fits."""
    n = len(h) - len(mask) + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.full(n, salt + 1, np.uint64)
    for k in [k for k, c in enumerate(mask) if c == "1"]:
        out = (out ^ h[k : k + n]) * _ROOT
        out ^= out >> np.uint64(32)
    return mix(out)


def _distinct(*columns: np.ndarray) -> tuple[np.ndarray, ...]:
    """Sorted distinct rows."""
    order = np.lexsort(columns[::-1])
    columns = tuple(c[order] for c in columns)
    fresh = np.ones(len(order), bool)
    fresh[1:] = np.any([c[1:] != c[:-1] for c in columns], axis=0)
    return tuple(c[fresh] for c in columns)


def short_masks(n: int) -> list[tuple[str, tuple[int, ...]]]:
    """Masks, and their places in an item of n words, one of which meets any copy with the words that IDENTITY asks for equal."""
    lost = n - int(np.ceil(IDENTITY * n - 1e-9))
    out: dict[str, set[int]] = {}
    for zeros in combinations(range(n), lost):
        mask = "".join("0" if k in zeros else "1" for k in range(n))
        out.setdefault(mask.strip("0"), set()).add(mask.index("1"))  # ends may lie beyond the document
    return [(mask, tuple(sorted(places))) for mask, places in out.items()]


#: Items of up to so many words have masks beside MASKS: all that short_masks makes below the longest mask, else these.
OWN, OWN_MASKS = 11, ("1110011", "11111")


def own_masks(n: int) -> list[tuple[str, tuple[int, ...]]]:
    """Masks, and their places, that an item of n words has beside MASKS."""
    if n < max(map(len, MASKS)):
        return short_masks(n)
    return [(m, tuple(range(n - len(m) + 1))) for m in OWN_MASKS] if n <= OWN else []


class Index:
    """Seeds of a block of benchmark items."""

    def __init__(self, items: list[tuple[int, str]], masks=MASKS):
        words, first = word_hashes(pa.array([t for _, t in items], pa.string()), ALNUM_SPLIT)
        self.words, self.first = words, first
        self.ids = [i for i, _ in items]
        size = np.diff(first)
        short = {n: own_masks(n) for n in sorted(set(size[(size > 0) & (size <= OWN)].tolist()))}
        self.masks = list(dict.fromkeys([*masks, *(mask for found in short.values() for mask, _ in found)]))
        keys, item, place = [], [], []
        for k in range(len(items)):
            h = words[first[k] : first[k + 1]]
            own = dict(short.get(len(h), ()))
            for s, mask in enumerate(self.masks):
                if s >= len(masks) and mask not in own:
                    continue
                got = seed_hashes(h, mask, s)
                at = np.arange(len(got)) if s < len(masks) else np.array(own[mask])
                keys.append(got[at])
                item.append(np.full(len(at), k))
                place.append(at)
        keys = np.concatenate(keys) if keys else np.zeros(0, np.uint64)
        order = np.argsort(keys, kind="stable")
        self.keys = keys[order]
        self.item = (np.concatenate(item) if item else np.zeros(0, np.int64))[order]
        self.place = (np.concatenate(place) if place else np.zeros(0, np.int64))[order]
        self.bits = max(16, int(len(keys) * 8).bit_length())
        self.filter = np.zeros(1 << self.bits, bool)
        self.filter[(self.keys >> np.uint64(64 - self.bits)).astype(np.int64)] = True

    def hits(self, h: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(document, item, diagonal) of every seed in common, once each. doc: document of each word."""
        none = np.zeros(0, np.int64)
        found = none, none, none
        for s, mask in enumerate(self.masks):
            got = seed_hashes(h, mask, s)
            at = np.flatnonzero(self.filter[(got >> np.uint64(64 - self.bits)).astype(np.int64)])
            at = at[doc[at] == doc[at + len(mask) - 1]]
            lo = np.searchsorted(self.keys, got[at], "left")
            n = np.searchsorted(self.keys, got[at], "right") - lo
            at, lo, n = at[n > 0], lo[n > 0], n[n > 0]
            # a repeated word makes as many hits as its places multiply to, but few diagonals: take some at a time
            part = np.cumsum(n) // HITS
            for a, b in pairwise([0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(at)]):
                many = n[a:b]
                k = np.repeat(lo[a:b], many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
                x = np.repeat(at[a:b], many)
                found = _distinct(*(np.concatenate(c) for c in zip(found, (doc[x], self.item[k], x - self.place[k]))))
        return found

    def overlaps(self, h: np.ndarray, first: np.ndarray) -> list[list[tuple]]:
        """Verified overlaps of each document: (item id, words that agree, words of the item)."""
        n_docs = len(first) - 1
        out: list[list[tuple]] = [[] for _ in range(n_docs)]
        if not len(h) or not len(self.keys):
            return out
        doc = np.repeat(np.arange(n_docs), np.diff(first))
        d, i, g = self.hits(h, doc)
        at = 0
        while at < len(d):
            end = at
            while end < len(d) and d[end] == d[at] and i[end] == i[at]:
                end += 1
            k, lo, hi = int(i[at]), int(first[d[at]]), int(first[d[at] + 1])
            item = self.words[self.first[k] : self.first[k + 1]]
            best = agreeing(h[lo:hi], item, g[at:end] - lo)
            if best:
                out[d[at]].append((self.ids[k], best, len(item)))
            at = end
        return out


def agreeing(h: np.ndarray, item: np.ndarray, diagonals: np.ndarray) -> int:
    """Words of the item that agree with the document's words h in one place of it, on diagonals in rising order; 0 if too few."""
    need = int(np.ceil(IDENTITY * len(item) - 1e-9))
    best, last = 0, None
    covered = np.zeros(len(item), bool)
    for diagonal in diagonals.tolist():
        if last is not None and diagonal - last > max(SHIFT, len(item) // 10):
            covered = np.zeros(len(item), bool)  # another place of the document
        a, b = max(0, -diagonal), min(len(item), len(h) - diagonal)
        same = h[diagonal + a : diagonal + b] == item[a:b]
        found = stretches(same, min(STRETCH, need))
        for x, y in found:
            covered[a + x : a + y] |= same[x:y]
        if found:
            best, last = max(best, int(covered.sum())), diagonal
        if best == len(item):
            break
    return best if best >= min(WORDS, need) else 0


def stretches(same: np.ndarray, least: int) -> list[tuple[int, int]]:
    """Disjoint stretches with IDENTITY of their words equal, and ``least`` equal words: the one with the most, then those beside it."""
    out, todo = [], [(0, len(same))]
    while todo:
        a, b = todo.pop()
        part = same[a:b]
        if part.sum() < least:
            continue
        # from each start, the last end up to which no more words differ than IDENTITY allows
        total = np.concatenate([[0.0], np.cumsum(np.where(part, 1 - IDENTITY, -IDENTITY) + 1e-9)])
        equal = np.concatenate([[0], np.cumsum(part)])
        later = np.maximum.accumulate(total[::-1])  # rising: the greatest total of the last k + 1 ends
        end = len(part) - np.searchsorted(later, total, "left")
        x = int(np.argmax(equal[end] - equal))
        y = int(end[x])
        if equal[y] - equal[x] < least:
            continue
        out.append((a + x, a + y))
        todo += [(a, a + x), (a + y, b)]
    return out


def _items(benchmark: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """item (a number of its own), item_id, n, words: the word hashes of each item that has words."""

    def run(batches):
        for b in split_batches(batches, 1):
            h, first = word_hashes(b.column(1), ALNUM_SPLIT)
            words = [h[x:y].tobytes() for x, y in pairwise(first.tolist())]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.diff(first), pa.int32()), pa.array(words, pa.binary())], names=["item_id", "n", "words"])

    rows = benchmark.select(F.col(id_col).cast("long").alias("item_id"), F.col(text_col).cast("string").alias("text"))
    rows = rows.mapInArrow(run, "item_id long, n int, words binary").where("n > 0")
    return rows.select(F.monotonically_increasing_id().alias("item"), "*")


def _grouped(keys: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, pa.Array]:
    """Distinct keys, and the places of each."""
    order = np.lexsort((places, keys))
    keys, places = keys[order], places[order]
    first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, np.int64)
    ends = np.append(first, len(keys))
    return keys[first], pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(places, pa.int32()))


def _salted(h: np.ndarray, mask: str) -> np.ndarray:
    return seed_hashes(h, mask, crc32(mask.encode()))


def _item_seeds(batches):
    """key, item, places: of each item the places of each of its seeds."""
    for b in batches:
        for item, n, words in zip(*(b.column(k).to_pylist() for k in range(3))):
            h = np.frombuffer(words, np.uint64)
            got = [(_salted(h, m), None) for m in MASKS] + [(_salted(h, m), np.array(at)) for m, at in own_masks(n)]
            keys = np.concatenate([x if at is None else x[at] for x, at in got])
            keys, places = _grouped(keys, np.concatenate([np.arange(len(x)) if at is None else at for x, at in got]))
            yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(np.full(len(keys), item)), places], names=["key", "item", "places"])


def _places(keys: np.ndarray, multiplier: int, bits: int) -> np.ndarray:
    """The places of keys in a table of so many bits, a power of two."""
    return ((keys * np.uint64(multiplier)) >> np.uint64(65 - bits.bit_length())).astype(np.int64)


def _doc_seeds(shared, bits: int, masks: list[str]):
    """Of texts that may share a seed with the benchmark: digest, words and seeds, with the places of each. A task's equal texts give one row."""

    def run(batches):
        table, done = shared.value, set()
        for b in split_batches(batches, 1):
            h, first = word_hashes(b.column(1), ALNUM_SPLIT)
            doc = np.repeat(np.arange(b.num_rows), np.diff(first))
            keys, places = [], []
            for mask in masks:
                got = _salted(h, mask)
                at = np.flatnonzero(doc[: len(got)] == doc[len(h) - len(got) :])  # windows within one text
                got = got[at]
                for m in MULTIPLIERS:  # each on what the ones before have left
                    place = _places(got, m, bits)
                    inside = table[place >> 3] >> (place & 7).astype(np.uint8) & 1 > 0
                    at, got = at[inside], got[inside]
                keys.append(got)
                places.append(at)
            keys, places = np.concatenate(keys), np.concatenate(places)
            digests, out = b.column(0).to_pylist(), ([], [], [], [])
            order = np.argsort(places, kind="stable")
            keys, places = keys[order], places[order]
            for k in np.unique(doc[places]).tolist() if len(places) else []:
                if digests[k] in done:
                    continue
                done.add(digests[k])
                lo, hi = np.searchsorted(places, [first[k], first[k + 1]])
                mine, at = _grouped(keys[lo:hi], places[lo:hi] - first[k])
                for column, x in zip(out, (digests[k], h[first[k] : first[k + 1]].tobytes(), mine.view(np.int64).tolist(), at.to_pylist())):
                    column.append(x)
            kinds = pa.string(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, kinds)], names=["digest", "words", "keys", "places"])

    return run


def _diagonals(hits: list[dict]) -> np.ndarray:
    """Distinct diagonals, in rising order, on which a document's places of seeds meet an item's; a repeated word makes many hits, so some at a time."""
    found = np.zeros(0, np.int64)
    for hit in hits:
        x, y = np.array(hit["at"], np.int64), np.array(hit["places"], np.int64)
        for k in range(0, len(x), max(1, HITS // len(y))):
            found = np.unique(np.concatenate([found, (x[k : k + max(1, HITS // len(y)), None] - y).ravel()]))
    return found


_OVERLAPS = pa.list_(pa.struct([("item_id", pa.int64()), ("matched", pa.int32()), ("item_words", pa.int32())]))
_OVERLAPS_SQL = "array<struct<item_id:bigint,matched:int,item_words:int>>"


def _verify(batches):
    """digest, overlaps of rows (digest, words, met); met: item_id, words and hits of each item that shares a seed."""
    for c in batches:
        for b in split_batches([c], 1):
            digests, overlaps = [], []
            for digest, words, met in zip(*(b.column(k).to_pylist() for k in range(3))):
                h, found = np.frombuffer(words, np.uint64), []
                for m in met:
                    item = np.frombuffer(m["words"], np.uint64)
                    best = agreeing(h, item, _diagonals(m["hits"]))
                    if best:
                        found.append({"item_id": m["item_id"], "matched": best, "item_words": len(item)})
                if found:
                    digests.append(digest)
                    overlaps.append(sorted(found, key=lambda o: (o["item_id"] is None, o["item_id"] or 0, o["matched"], o["item_words"])))
            yield pa.RecordBatch.from_arrays([pa.array(digests, pa.string()), pa.array(overlaps, _OVERLAPS)], names=["digest", "overlaps"])


def digest_of(text: str = "text") -> Column:
    return F.sha2(F.col(f"`{text}`").cast("string").cast("binary"), 256)


def text_overlaps(docs: DataFrame, benchmark: DataFrame, scratch: Scratch, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """digest, overlaps of the distinct texts of docs with a verified overlap.

    Seeds of the texts and of the items are joined on their hashes; then each text, once, is compared with the items that it
    met. The items' seeds, up to SENT of them, are sent to the texts' tasks for that.
    """
    spark = docs.sparkSession
    items = scratch.table(_items(benchmark, id_col, text_col), "items")
    seeds = scratch.table(items.select("item", "n", "words").mapInArrow(_item_seeds, "key long, item long, places array<int>"), "seeds")
    short = [r.n for r in items.where(F.col("n") <= OWN).select("n").distinct().collect()]  # OWN numbers at most
    masks = list(dict.fromkeys([*MASKS, *(m for n in sorted(short) for m, _ in own_masks(n))]))
    many = seeds.count()
    bits = bit_table.size_for(many, BITS_A_SEED, MOST_BITS)

    def places(batches):
        for b in batches:
            for m in MULTIPLIERS:
                yield pa.RecordBatch.from_arrays([pa.array(_places(b.column(0).to_numpy().view(np.uint64), m, bits))], names=["place"])

    table = bit_table.collected(bit_table.rows_of(seeds.select("key").mapInArrow(places, "place long")), bits)
    shared = spark.sparkContext.broadcast(table)  # MOST_BITS at most
    texts = docs.select(digest_of().alias("digest"), F.col("text").cast("string").alias("text")).where("text is not null")
    seen = texts.mapInArrow(_doc_seeds(shared, bits, masks), "digest string, words binary, keys array<long>, places array<array<int>>")
    seen = seen.groupBy("digest").agg(*[F.first(c).alias(c) for c in ("words", "keys", "places")])
    seen = scratch.table(seen, "seen")
    asked = seen.select("digest", F.explode(F.arrays_zip("keys", "places")).alias("s")).select("digest", F.col("s.keys").alias("key"), F.col("s.places").alias("at"))
    met = asked.join(F.broadcast(seeds) if many <= SENT else seeds, "key")
    met = met.groupBy("digest", "item").agg(F.collect_list(F.struct("at", "places")).alias("hits"))  # of one text and one item
    met = met.join(F.broadcast(items) if many <= SENT else items, "item")
    met = met.groupBy("digest").agg(F.collect_list(F.struct("item_id", "words", "hits")).alias("met"))
    out = seen.select("digest", "words").join(met, "digest").mapInArrow(_verify, f"digest string, overlaps {_OVERLAPS_SQL}")
    return scratch.table(out, "overlaps")


def find_overlaps(
    docs: DataFrame, benchmark: DataFrame, keep: list[str], id_col: str = "item_id", text_col: str = "text", name: str = "overlaps"
) -> DataFrame:
    """The columns ``keep`` of every row and its overlaps, by this ``name``: (item_id, matched, item_words) of each item.

    Words are runs of letters and digits, case folded for A-Z; punctuation of any script parts them. Null
    and empty texts have no overlaps, nor have null or wordless items; an empty benchmark gives empty
    lists. Repeated rows each have theirs, repeated items each count. Very long texts are compared whole.
    Columns of docs may have any names but ``name``. Only rows that may have an overlap, by a table of bits over
    the texts that do, are joined with it; the others are read and returned.
    """
    found = text_overlaps(docs, benchmark, Scratch(docs.sparkSession, "overlaps"), id_col, text_col)
    mark, digest, column = fresh("mark", keep), fresh("digest", keep), fresh("found", keep)
    found = found.select(F.col("digest").alias(digest), F.col("overlaps").alias(column))
    rows = docs.select(*[F.col(f"`{c}`") for c in keep], digest_of().alias(digest))
    rows = bit_table.flagged(rows, digest, found.select(digest), mark)
    cols = [F.col(f"`{c}`") for c in keep]
    none = F.array().cast(_OVERLAPS_SQL)
    clean = rows.where(~F.col(mark)).select(*cols, none.alias(name))
    return clean.unionByName(rows.where(mark).join(found, digest, "left").select(*cols, F.coalesce(column, none).alias(name)))


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every verified overlap of a document with a benchmark item."""
    docs, items = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    found = text_overlaps(docs, items, Scratch(spark, "overlaps"))
    rows = docs.select("doc_id", digest_of().alias("digest")).join(found, "digest")
    return rows.select("doc_id", F.explode("overlaps").alias("o")).select("doc_id", "o.item_id", "o.matched", "o.item_words")
