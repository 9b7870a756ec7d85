"""Fill-in-middle documents by Spark SQL alone.

A text is an array of units made by ``regexp_extract_all``: blocks of BLOCK code points, and the code points of
the two blocks that a cut falls in, so that a very long text makes no array entry for each of its code points.
``conv`` of substrings of ``sha2`` gives the cuts and the form, ``slice`` and ``array_join`` the parts, which are
arranged around sentinels. ``restored`` parses the sentinels and puts a text together again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .scratch import fresh

PREFIX, SUFFIX, MIDDLE = SENTINELS = ("<P>", "<S>", "<M>")
SEED = "1:"
#: Of 100 documents, those from PLAIN on stay as they are; of 100 others, those below SPM begin with the suffix.
PLAIN, SPM = 90, 20
#: Code points of a block. The pattern's matcher recurses where widths change, so blocks stay small.
BLOCK = 512


def _units(text: Column, size: int) -> Column:
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{size}}}"), F.lit(0))


def _drawn(digest: Column, k: int) -> Column:
    """The k-th group of eight hexadecimal digits as a number."""
    return F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long")


def _cut(rows: DataFrame, blocks: str, at: str, left: str, right: str, size: int) -> DataFrame:
    """Split an array of blocks, all of ``size`` code points but the last, after ``at`` code points: strings left and right."""
    whole, rest = F.floor(F.col(at) / size).cast("int"), (F.col(at) % size).cast("int")
    units, rank = fresh("units", rows.columns), fresh("whole", rows.columns)
    rows = rows.withColumn(rank, whole).withColumn(units, _units(F.coalesce(F.get(blocks, F.col(rank)), F.lit("")), 1))
    head = F.concat(F.array_join(F.slice(blocks, F.lit(1), F.col(rank)), ""), F.array_join(F.slice(units, F.lit(1), rest), ""))
    tail = F.concat(
        F.array_join(F.slice(units, rest + 1, F.size(units)), ""),
        F.array_join(F.slice(blocks, F.col(rank) + 2, F.size(blocks)), ""),
    )
    return rows.withColumn(left, head).withColumn(right, tail).drop(rank, units)


def arrange(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: str = SEED, plain: int = PLAIN, spm: int = SPM, size: int = BLOCK) -> DataFrame:
    """One row a document: doc (a struct of all its columns), n, form, prefix_chars, middle_chars, output.

    n counts code points. The prefix ends after the smaller and the middle after the larger of two places that the
    id's digest draws; form is plain, psm or spm. A null text is empty, an empty one plain, and so is a text that
    holds a sentinel. A null id draws like an empty one. Rows that repeat, or that have the same id, are drawn alike
    and each returned; other columns, whatever their names, only travel inside doc. Very long texts are cut whole.
    An empty table gives no rows.
    """
    rows = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"),
        F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"),
        F.sha2(F.concat(F.lit(seed), F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit(""))).cast("binary"), 256).alias("drawn"),
    )
    held = F.lit(False)
    for s in SENTINELS:
        held = held | F.contains("text", F.lit(s))
    rows = rows.withColumn("blocks", _units(F.col("text"), size))
    last = F.when(F.size("blocks") > 0, F.char_length(F.element_at("blocks", -1))).otherwise(0)
    rows = rows.withColumn("n", (F.greatest(F.size("blocks") - 1, F.lit(0)).cast("long") * size + last).cast("long"))
    form = F.when((F.col("n") == 0) | held | (_drawn(F.col("drawn"), 2) % 100 >= plain), "plain")
    rows = rows.withColumn("form", form.when(_drawn(F.col("drawn"), 3) % 100 < spm, "spm").otherwise("psm"))
    a, b = _drawn(F.col("drawn"), 0) % (F.col("n") + 1), _drawn(F.col("drawn"), 1) % (F.col("n") + 1)
    arranged = F.col("form") != "plain"
    rows = rows.withColumn("first", F.when(arranged, F.least(a, b))).withColumn("second", F.when(arranged, F.greatest(a, b)))
    rows = _cut(rows, "blocks", "second", "head", "suffix", size).drop("blocks").withColumn("blocks", _units(F.col("head"), size))
    rows = _cut(rows, "blocks", "first", "prefix", "middle", size)
    output = (
        F.when(F.col("form") == "psm", F.concat(F.lit(PREFIX), "prefix", F.lit(SUFFIX), "suffix", F.lit(MIDDLE), "middle"))
        .when(F.col("form") == "spm", F.concat(F.lit(SUFFIX), "suffix", F.lit(PREFIX), "prefix", F.lit(MIDDLE), "middle"))
        .otherwise(F.col("text"))
    )
    return rows.select(
        "doc", "n", "form", F.col("first").alias("prefix_chars"), (F.col("second") - F.col("first")).alias("middle_chars"), output.alias("output")
    )


def restored(output: Column, form: Column) -> Column:
    """The text of an arranged one, from its sentinels. They cannot be mistaken: arranged texts hold no other, and none can
    arise where a text meets one, since each begins with its only ``<`` and ends with its only ``>``."""
    parts = F.split(output, "|".join(SENTINELS))
    part = lambda k: F.coalesce(F.get(parts, F.lit(k)), F.lit(""))
    return F.when(form == "psm", F.concat(part(1), part(3), part(2))).when(form == "spm", F.concat(part(2), part(3), part(1))).otherwise(output)


def op12_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Arrange all documents, and the digests of what is made and of what comes back."""
    rows = arrange(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    digest = lambda c: F.sha2(c.cast("binary"), 256)
    return rows.select(
        F.col("doc.doc_id").alias("doc_id"), "n", "form", "prefix_chars", "middle_chars",
        digest(F.col("output")).alias("output_sha256"), digest(restored(F.col("output"), F.col("form"))).alias("restored_sha256"),
    )


OP12_SQL = """
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, '')) AS n, sha256('1:' || coalesce(cast(doc_id AS varchar), '')) AS h FROM documents),
g AS (
  SELECT *, ('0x' || substr(h, 1, 8))::BIGINT AS h1, ('0x' || substr(h, 9, 8))::BIGINT AS h2,
         ('0x' || substr(h, 17, 8))::BIGINT AS h3, ('0x' || substr(h, 25, 8))::BIGINT AS h4 FROM d),
f AS (
  SELECT *, CASE WHEN n = 0 OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain'
                 WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form,
         least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b FROM g),
p AS (SELECT *, substr(t, 1, a) AS pre, substr(t, a + 1, b - a) AS mid, substr(t, b + 1) AS suf FROM f)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
       sha256(CASE form WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid
                        WHEN 'spm' THEN '<S>' || suf || '<P>' || pre || '<M>' || mid ELSE t END) AS output_sha256,
       sha256(t) AS restored_sha256
FROM p
"""
