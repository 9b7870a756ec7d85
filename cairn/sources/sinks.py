"""Writers: delimited and JSON exports, appends, backups."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.records import export_table


def write_csv(df: DataFrame, path: str, limit: int = 5000) -> None:
    """RFC 4180: quotes doubled, a header, lines that end in CRLF, cells as they are; a folder of one part file, for a table within ``limit``."""
    rows = export_table(df, limit)
    cell = lambda x: F.when(F.rlike(x, F.lit('["\\r\\n,]')), F.concat(F.lit('"'), F.replace(x, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(F.coalesce(x, F.lit("")))
    lines = rows.select(F.concat_ws(",", *[cell(F.col(f"`{c}`").cast("string")) for c in rows.columns]).alias("value"))
    head = df.sparkSession.range(1).coalesce(1).select(F.concat_ws(",", *[cell(F.lit(c)) for c in rows.columns]).alias("value"))
    head.unionAll(lines).coalesce(1).write.option("lineSep", "\r\n").text(path)


def write_json(df: DataFrame, path: str) -> None:
    df.write.json(path)


def append_events(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def backup(df: DataFrame, path: str, tag: str = "cairn-backup-1") -> None:
    """Rows as tagged JSON; binary columns, and arrays of tiny integers packed as bytes, as base64."""
    packed = lambda c: F.unhex(F.array_join(F.transform(c, lambda x: F.lpad(F.hex(F.pmod(x.cast("int"), F.lit(256))), 2, "0")), ""))
    cols = [F.base64(c).alias(c) if t == "binary" else F.base64(packed(F.col(c))).alias(c) if t == "array<tinyint>" else F.col(c) for c, t in df.dtypes]
    df.select(F.lit(tag).alias("format"), *cols).write.mode("overwrite").json(path)


def restore(spark, path: str, schema, tag: str = "cairn-backup-1") -> DataFrame:
    """Rows of a backup with the right tag; base64 texts where the schema has binaries, or arrays of tiny integers, as packed vectors are."""
    from pyspark.sql import types as T

    packed = [f.name for f in schema.fields if isinstance(f.dataType, T.ArrayType) and isinstance(f.dataType.elementType, T.ByteType)]
    if packed:
        plain = T.StructType([T.StructField(f.name, T.BinaryType()) if f.name in packed else f for f in schema.fields])
        rows = restore(spark, path, plain, tag)
        # byte by byte in hexadecimal, and above 127 the negative numbers
        byte = lambda c, i: F.conv(F.substring(F.hex(c), 2 * i + 1, F.lit(2)), 16, 10).cast("int")
        signed = lambda x: F.when(x > 127, x - 256).otherwise(x).cast("tinyint")
        whole = lambda c: F.when(F.length(c) > 0, F.transform(F.sequence(F.lit(0), F.length(c) - 1), lambda i: signed(byte(c, i)))).otherwise(F.array().cast("array<tinyint>"))
        return rows.withColumns({c: F.when(F.col(c).isNotNull(), whole(F.col(c))) for c in packed})
    text = T.StructType([T.StructField(f.name, T.StringType() if isinstance(f.dataType, T.BinaryType) else f.dataType) for f in schema.fields])
    rows = spark.read.schema(T.StructType([T.StructField("format", T.StringType()), *text.fields])).json(path).where(F.col("format") == tag)
    return rows.select([F.unbase64(f.name).alias(f.name) if isinstance(f.dataType, T.BinaryType) else F.col(f.name) for f in schema.fields])
