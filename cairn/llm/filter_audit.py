"""Audit of five filters in every order, with duplicates found by partition refinement.

One scan measures each text: which of the conditions A to D it fails, its code points and the hashes of successive
blocks. Classes of possibly equal texts are then refined, by length first and by one block hash after the other;
classes of one row are dropped on the way. Only texts of what is left are compared in full. In each class of equal
texts all rows but those with the smallest id fail E. Then rows are counted by the mask of the conditions that they
fail, and every figure of every order follows from these counts.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import reduce
from itertools import permutations
from math import factorial

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import bit_table
from .scratch import Scratch
from .wordvec import split_batches

FILTERS = "ABCDE"
LEAST_WORDS, DISTINCT_PERCENT, UPPER_PERCENT = 100, 80, 10
SIGNS = b"#$%&*|"
UPPER = bytes(range(65, 91))
#: Where blocks of a text end, in code points; the last block takes the rest.
BLOCK_ENDS = (64, 1024)
BLOCKS = len(BLOCK_ENDS) + 1
#: Words are split from so many bytes at a time.
PIECE = 1 << 20
_REST_OF_WORD = re.compile(rb"[^ \t\n\v\f\r]*")


def word_counts(data: bytes, piece: int = PIECE) -> tuple[int, int]:
    """Words and distinct words. A long text is split piece by piece, between words."""
    seen: set[bytes] = set()
    n = at = 0
    while at < len(data):
        end = _REST_OF_WORD.match(data, min(at + piece, len(data))).end()
        words = data[at:end].split()  # of bytes: at \x20 and \x09-\x0D
        n += len(words)
        seen.update(words)
        at = end
    return n, len(seen)


def failures(data: bytes, n_chars: int) -> int:
    """Bits 1, 2, 4, 8 for the conditions A to D of a UTF-8 text."""
    words, distinct = word_counts(data)
    upper = len(data) - len(data.translate(None, UPPER))
    signs = len(data.translate(None, SIGNS)) < len(data)
    failed = (words < LEAST_WORDS, 100 * distinct < DISTINCT_PERCENT * words, 100 * upper > UPPER_PERCENT * n_chars, signs)
    return sum(bit << k for k, bit in enumerate(failed))


def _measured(rows: DataFrame, keep_text: bool = False) -> DataFrame:
    """Add mask and n_chars to rows, whose last column is the text; it stays behind unless it is kept."""
    at = len(rows.columns) - 1
    kept = at + keep_text

    def run(batches):
        for b in split_batches(batches, at):
            chars = pc.utf8_length(b.column(at)).cast(pa.int64())
            masks = [failures(t.as_py(), n) for t, n in zip(b.column(at).cast(pa.binary()), chars.to_pylist())]
            yield pa.RecordBatch.from_arrays([*b.columns[:kept], pa.array(masks, pa.int32()), chars], names=[*b.schema.names[:kept], "mask", "n_chars"])

    return rows.mapInArrow(run, rows.select(rows.columns[:kept]).schema.add("mask", "integer").add("n_chars", "long"))


def _block_hashes(text: Column, hashed: Callable[[Column], Column]) -> list[Column]:
    """b0, b1, ...: one hash for each block of the text."""
    begins, ends = (0, *BLOCK_ENDS), (*BLOCK_ENDS, 2**31 - 1)
    return [hashed(F.substring(text, a + 1, e - a)).alias(f"b{k}") for k, (a, e) in enumerate(zip(begins, ends))]


def _refined(cls: Column, k: int) -> Column:
    """The class that block k makes of one."""
    return F.xxhash64(cls, F.col(f"b{k}"))


def refine(facts: DataFrame, scratch: Scratch) -> DataFrame:
    """Rows of facts whose length and block hashes other rows have too, with their class in column cls.

    Each round counts the classes, combined before they are shuffled, and leaves those of one row behind.
    """
    rows = facts.withColumn("cls", F.col("n_chars"))
    for k in range(BLOCKS + 1):
        if k:
            rows = rows.withColumn("cls", _refined(F.col("cls"), k - 1))
        shared = rows.groupBy("cls").count().where("count > 1").select("cls")
        rows = scratch.table(rows.join(shared, "cls", "left_semi"), f"round{k}")
        if k:
            scratch.drop(held)
        held = rows
    return rows


def _in_classes(texts: DataFrame, classes: DataFrame) -> DataFrame:
    """Rows of texts whose cls is set in a table of bits over the classes; a few others may pass too."""
    return bit_table.flagged(texts, "cls", classes, "held").where("held").drop("held")


def _repeats(rows: DataFrame, text: list[str]) -> DataFrame:
    """Of rows (part, mask, good, toxic, doc_id and the columns that identify their text): how many of each kind fail E.

    Rows are combined by kind first, so what meets for a text are its kinds, however many copies it has.
    """
    kind = [*text, "part", "mask", "good", "toxic"]
    ids = rows.groupBy(*kind, "doc_id").agg(F.count("*").alias("n"))
    first = F.min(F.struct(F.isnull("doc_id").alias("none"), "doc_id", "n")).alias("first")
    kinds = ids.groupBy(*kind).agg(F.sum("n").alias("n"), first)
    smallest = kinds.groupBy(*text).agg(F.min(F.struct("first.none", "first.doc_id")).alias("smallest"))
    kinds = kinds.join(smallest, text).where(F.col("n") > 0)
    kept = F.when(F.struct("first.none", "first.doc_id").eqNullSafe(F.col("smallest")), F.col("first.n")).otherwise(0)
    return kinds.select("part", "mask", "good", "toxic", (F.col("n") - kept).alias("n")).where("n > 0")


def mask_counts(
    docs: DataFrame, labels: DataFrame, part: Column | None = None, hashed: Callable[[Column], Column] = F.xxhash64
) -> DataFrame:
    """part, mask, n, good, toxic: rows of docs, and those with labels quality=1 and toxic=1, by the conditions that they fail.

    Bits of the mask: 1 to 16 for A to E. part defaults to lang; a null part is ''. A null text is empty, so it is equal
    to empty ones. E fails rows whose text a row with a smaller id has; rows with equal ids do not fail each other, and a
    null id is larger than every other. Labels that repeat an id count if any of them does; rows without one are neither.
    Very long texts are measured and compared whole. Extra columns are not read. An empty table gives no rows. ``hashed``
    makes the blocks' hashes; whatever it returns, texts are compared in full and the counts are the same.
    """
    scratch = Scratch(docs.sparkSession, "audit")
    part = F.coalesce((F.col("lang") if part is None else part).cast("string"), F.lit(""))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), part.alias("part"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    marks = labels.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(
        F.max(F.coalesce((F.col("quality") == 1).cast("int"), F.lit(0))).alias("good"), F.max(F.coalesce((F.col("toxic") == 1).cast("int"), F.lit(0))).alias("toxic")
    )

    def marked(rows: DataFrame) -> DataFrame:
        return rows.join(marks, "doc_id", "left").fillna(0, ["good", "toxic"])

    measured = _measured(texts.select("doc_id", "part", *_block_hashes(F.col("text"), hashed), "text"))
    facts = scratch.table(marked(measured), "facts")
    rows = refine(facts, scratch)
    cls = reduce(_refined, range(BLOCKS), F.char_length("text").cast("long"))
    classed = texts.select("*", *_block_hashes(F.col("text"), hashed)).select("doc_id", "part", "text", cls.alias("cls"))
    compared = _in_classes(classed.select("cls", "text"), rows.select("cls").distinct())
    # one row for each different text of a class; copies are combined before they are shuffled
    parted = scratch.table(compared.distinct().groupBy("cls").count().where("count > 1").select("cls"), "parted")
    repeats = _repeats(rows, ["cls"])
    if not parted.isEmpty():  # different texts with equal length and hashes: their rows are told apart by the texts
        again = _in_classes(classed, parted).join(parted, "cls", "left_semi")
        again = marked(_measured(again.select("doc_id", "part", "cls", "text"), keep_text=True))
        repeats = _repeats(rows.join(parted, "cls", "left_anti"), ["cls"]).union(_repeats(again, ["cls", "text"]))
    moved = repeats.select("part", F.explode(F.array(F.struct("mask", F.negative("n").alias("n")), F.struct((F.col("mask") + 16).alias("mask"), "n"))).alias("m"), "good", "toxic")
    every = facts.groupBy("part", "mask", "good", "toxic").agg(F.count("*").alias("n"))
    every = every.unionByName(moved.select("part", "m.mask", "m.n", "good", "toxic"))
    counted = every.groupBy("part", "mask").agg(
        F.sum("n").alias("n"), F.sum(F.col("n") * F.col("good")).alias("good"), F.sum(F.col("n") * F.col("toxic")).alias("toxic")
    ).where("n > 0")
    counted = scratch.table(counted, "counts")
    scratch.drop(facts, rows, parted)
    return counted


def interactions(counts: DataFrame) -> DataFrame:
    """The figures of every step of every order, from mask_counts: a row of it becomes one for each of the orders' steps."""
    orders = F.array(*[F.lit("".join(p)) for p in permutations(FILTERS)])
    steps = counts.select("*", F.explode(orders).alias("filter_order"))
    steps = steps.select("*", F.explode(F.sequence(F.lit(1), F.lit(len(FILTERS)))).alias("step"))

    def bits(letters: Column) -> Column:
        return reduce(Column.__add__, [F.when(F.contains(letters, F.lit(f)), 1 << k).otherwise(0) for k, f in enumerate(FILTERS)])

    earlier = bits(F.substring("filter_order", F.lit(1), F.col("step") - 1))
    bit = bits(F.substring("filter_order", F.col("step"), F.lit(1)))
    steps = steps.withColumn("before", F.col("mask").bitwiseAND(earlier) != 0).withColumn("bit", bit)
    fails = F.col("mask").bitwiseAND(F.col("bit")) != 0
    removed = fails & ~F.col("before")
    total = lambda what, rows="n": F.sum(F.when(what, F.col(rows)).otherwise(0)).cast("long")
    # of all orders, an equal share begins with each of the filters that a row fails
    share = F.when(fails, F.col("n") * (F.lit(factorial(len(FILTERS))) / F.bit_count("mask"))).otherwise(0)
    return steps.groupBy("part", "filter_order", "step").agg(
        total(~F.col("before") & ~fails).alias("kept"), total(removed).alias("removed"), total(F.col("before") & fails).alias("redundant"),
        total(F.col("mask") == F.col("bit")).alias("unique_fails"), total(removed, "good").alias("good_lost"),
        total(removed, "toxic").alias("toxic_lost"), F.round(F.sum(share)).cast("long").alias("shapley"),
    )


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All orders of the five filters over all documents, by language."""
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    return interactions(mask_counts(docs, labels))


OP13_SQL = r"""
WITH t AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words, min(doc_id) OVER (PARTITION BY text) AS least_id FROM t),
l AS (SELECT doc_id, max(coalesce(quality = 1, false)) AS good, max(coalesce(toxic = 1, false)) AS toxic FROM labels GROUP BY doc_id),
f AS (
  SELECT w.part, coalesce(l.good, false) AS good, coalesce(l.toxic, false) AS toxic, map {
    'A': len(words) < 100, 'B': 100 * len(list_distinct(words)) < 80 * len(words),
    'C': 100 * length(regexp_replace(text, '[^A-Z]+', '', 'g')) > 10 * length(text),
    'D': regexp_matches(text, '[#$%&*|]'), 'E': coalesce(w.doc_id > least_id, least_id IS NOT NULL)} AS fails
  FROM w LEFT JOIN l ON w.doc_id = l.doc_id),
c AS (SELECT part, fails, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM f GROUP BY part, fails),
x AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
o AS (SELECT [a.x, b.x, c.x, d.x, e.x] AS o FROM x a, x b, x c, x d, x e WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
s AS (SELECT o, unnest(range(1, 6)) AS step FROM o),
m AS (
  SELECT part, o, step, o[step] AS filter, fails[o[step]] AS failed, list_bool_or([false] || list_transform(o[:step - 1], lambda y: fails[y])) AS before,
         len(list_filter(map_values(fails), lambda y: y)) AS n_failed, n, good, toxic
  FROM c, s),
r AS (
  SELECT part, o, step, filter, coalesce(sum(n) FILTER (NOT failed AND NOT before), 0)::BIGINT AS kept,
         coalesce(sum(n) FILTER (failed AND NOT before), 0)::BIGINT AS removed, coalesce(sum(n) FILTER (failed AND before), 0)::BIGINT AS redundant,
         coalesce(sum(n) FILTER (failed AND n_failed = 1), 0)::BIGINT AS unique_fails,
         coalesce(sum(good) FILTER (failed AND NOT before), 0)::BIGINT AS good_lost, coalesce(sum(toxic) FILTER (failed AND NOT before), 0)::BIGINT AS toxic_lost
  FROM m GROUP BY ALL)
SELECT part, array_to_string(o, '') AS filter_order, step::INTEGER AS step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
       sum(removed) OVER (PARTITION BY part, filter)::BIGINT AS shapley
FROM r
"""
