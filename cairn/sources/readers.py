"""Readers: JSON lines, repositories, directories, pages, mail, captions, backups."""

from __future__ import annotations

import re
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as TX
from ..functions import urls as U
from . import files

PAGE = "page_id long, url string, title string, text string, metadata map<string,string>, links array<struct<href:string,text:string>>, headings array<struct<level:int,text:string>>, status string"
_NOISE = frozenset("script style noscript template nav footer aside form svg iframe".split())
_BLOCK = frozenset("p div section article main header li ul ol table tr td th h1 h2 h3 h4 h5 h6 br pre blockquote".split())
# fixed values: what may hold a page's main content, and the text that it must have more of
MAIN_TAGS, MAIN_ROLE, MAIN_IDS, MAIN_CLASSES = ("article", "main"), "main", ("content", "main"), ("post-content", "article-body", "content")
MAIN_LEAST = 200
_VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())


def json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines; corrupt lines are skipped."""
    return spark.read.schema(schema).json(path, mode="DROPMALFORMED")


def json_file(spark: SparkSession, path: str, schema: str, fallback: str | None = None) -> DataFrame:
    """One JSON document per file. Corrupt, empty and missing ones give null fields, or those of ``fallback``, a JSON text."""
    other = F.from_json(F.lit(fallback), schema) if fallback is not None else F.lit(None).cast(f"struct<{schema}>")
    if not files.exists(spark, path.split("*")[0].rstrip("/") or "/"):
        return spark.range(1).select(other.alias("o")).select("o.*")
    text = spark.read.text(path, wholetext=True)
    read = F.from_json("value", schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "__bad"})
    good = F.try_parse_json("value").isNotNull() & (F.substring(F.ltrim("value"), 1, 1) == "{")
    return text.select(F.when(good, read).otherwise(other).alias("o")).select("o.*")


def directory(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """path below the folder, mtime, size, content of all files below it whose kind is known."""
    f = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(path)
    root = files.qualified(spark, path).rstrip("/") + "/"
    plain = lambda x: F.regexp_replace(x, "^file:/+", "file:/")
    f = f.withColumn("path", F.when(F.startswith(plain(F.col("path")), plain(F.lit(root))), F.substring(plain(F.col("path")), F.length(plain(F.lit(root))) + 1, F.length("path"))).otherwise(F.col("path")))
    return f.withColumn("kind", TX.file_kind("path")).where("kind <> 'other'").withColumnRenamed("modificationTime", "mtime").withColumnRenamed("length", "size")


class _Page(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.out, self.title, self.meta, self.links, self.heads = [], "", {}, [], []
        self.stack, self.noise = [], 0
        self.href, self.label, self.head = None, [], None
        self.open, self.best = [], (0, None, None)  # candidates: depth and first text; the longest: length, first, end

    def handle_starttag(self, tag, attrs):
        a = dict(attrs)
        if tag == "meta":
            k = a.get("name") or a.get("property")
            if k and a.get("content") is not None:
                self.meta.setdefault(k, a["content"][:500])
            return
        if tag in _BLOCK:
            self.out.append("\n")
        if tag in _VOID:
            return
        if tag in MAIN_TAGS or a.get("role") == MAIN_ROLE or a.get("id") in MAIN_IDS or set((a.get("class") or "").split()) & set(MAIN_CLASSES):
            self.open.append((len(self.stack), len(self.out)))
        self.stack.append(tag)
        self.noise += tag in _NOISE
        if tag == "a":
            self.href, self.label = a.get("href"), []
        elif tag in ("h1", "h2", "h3"):
            self.head = (int(tag[1]), [])

    def handle_endtag(self, tag):
        if tag not in self.stack:
            return
        while self.stack:
            t = self.stack.pop()
            self.noise -= t in _NOISE
            self.shut()
            if t == tag:
                break
        if tag == "a" and self.href is not None:
            self.links.append((self.href, " ".join("".join(self.label).split())))
            self.href = None
        elif self.head and tag == f"h{self.head[0]}":
            self.heads.append((self.head[0], " ".join("".join(self.head[1]).split())))
            self.head = None
        if tag in _BLOCK:
            self.out.append("\n")

    def shut(self):
        """Weigh the candidates that have ended."""
        while self.open and self.open[-1][0] >= len(self.stack):
            _, first = self.open.pop()
            size = len(" ".join("".join(self.out[first:]).split()))
            if size > self.best[0]:
                self.best = size, first, len(self.out)

    def main(self):
        """Text of the longest candidate if it says enough, else of the whole body."""
        self.stack.clear()
        self.shut()
        return self.out[self.best[1] : self.best[2]] if self.best[0] > MAIN_LEAST else self.out

    def handle_data(self, data):
        if "title" in self.stack and not self.title:
            self.title = " ".join(data.split())
        if self.href is not None:
            self.label.append(data)
        if self.head:
            self.head[1].append(data)
        if not self.noise and "head" not in self.stack and "title" not in self.stack:
            self.out.append(data)


#: The sign before a character reference that no semicolon ends.
_UNCLOSED = re.compile(r"&(?=(?:#\d+|#[xX][0-9a-fA-F]+|[A-Za-z][A-Za-z0-9]*)(?![A-Za-z0-9;]))")


def _extract(batches, unclosed=True, most_links=100, most_heads=50):
    for pdf in batches:
        rows = []
        for r in pdf.itertuples(index=False):
            p = _Page()
            status = "ok"
            try:
                p.feed(r.html or "" if unclosed else _UNCLOSED.sub("&amp;", r.html or ""))
                p.close()
            except Exception:  # a page that cannot be parsed keeps what was read
                status = "partial"
            lines = [" ".join(x.split()) for x in "".join(p.main()).split("\n")]
            text = "\n".join(x for x in lines if x)
            links = list(dict((h, {"href": h, "text": t}) for h, t in reversed(p.links) if t and h and h.lower().startswith(("http://", "https://"))).values())[::-1][:most_links]
            heads = [{"level": n, "text": t} for n, t in p.heads[:most_heads] if t]
            rows.append((r.page_id, r.url, p.title, text, p.meta, links, heads, status if text else "empty"))
        yield pd.DataFrame(rows, columns=["page_id", "url", "title", "text", "metadata", "links", "headings", "status"])


def pages(df: DataFrame, unclosed: bool = True) -> DataFrame:
    """Title, readable text of the main content, metadata, links and headings of pages (page_id, url, html).

    ``unclosed``: decode references without a semicolon, as browsers do; else they stay as they are written.
    """
    return df.select("page_id", "url", "html").mapInPandas(lambda batches: _extract(batches, unclosed), PAGE)


def page_list(urls: DataFrame, col: str, order: str, cap: int = 16) -> DataFrame:
    """http(s) addresses, each once, the first ``cap``."""
    u = urls.where(U.is_http(F.col(col)))
    u = u.withColumn("__k", F.row_number().over(W.partitionBy(col).orderBy(order))).where("__k = 1").drop("__k")
    return u.orderBy(order).limit(cap)


def parse_mail(raw: Column | str) -> Column:
    """RFC 822 messages: headers and the text body."""
    return F.pandas_udf(_mail, "struct<sender:string,recipient:string,subject:string,date:string,body:string>")(raw)


def _mail(raw: pd.Series) -> pd.DataFrame:
    import email
    from email import policy

    rows = []
    for x in raw:
        m = email.message_from_string(x or "", policy=policy.default)
        body = m.get_body(("plain", "html"))
        try:
            text = body.get_content() if body else ""
        except (KeyError, LookupError):
            text = ""
        rows.append((m["from"], m["to"], m["subject"], m["date"], text.strip()))
    return pd.DataFrame([[None if c is None else str(c) for c in r] for r in rows], columns=["sender", "recipient", "subject", "date", "body"])


def captions(df: DataFrame, col: str) -> DataFrame:
    """Caption text to segments: start and end in seconds, text."""
    block = F.explode(F.split(col, r"\r?\n\r?\n"))
    b = df.withColumn("__b", block)
    line = r"((?:\d+:)?\d+:\d+[.,]\d+)\s*-->\s*((?:\d+:)?\d+:\d+[.,]\d+)"
    secs = lambda c: F.aggregate(F.transform(F.split(F.replace(c, F.lit(","), F.lit(".")), ":"), lambda p: p.cast("double")), F.lit(0.0), lambda t, p: t * 60 + p)
    b = b.where(F.col("__b").rlike(line))
    text = F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace("__b", r"(?s)^.*?-->[^\n]*\n?", ""), "<[^>]*>", ""), r"\s+", " "))
    return b.select(*df.columns, secs(F.regexp_extract("__b", line, 1)).alias("start"), secs(F.regexp_extract("__b", line, 2)).alias("end"), text.alias("caption")).where("caption <> ''")


def new_since(df: DataFrame, known: DataFrame, key: str, ts: str, mark) -> DataFrame:
    """Rows at or after the high-water mark whose key is not known."""
    rows = df if mark is None else df.where(F.col(ts) >= F.lit(mark))
    return rows.join(known.select(key), key, "left_anti")


def flatten_tree(spark: SparkSession, view: str) -> DataFrame:
    """Bookmark rows (id, parent, title, url, pos) with the path of their folders."""
    return spark.sql(
        f"""WITH RECURSIVE t(id, title, url, path, ord) AS (
        SELECT id, title, url, CAST('' AS STRING), lpad(CAST(pos AS STRING), 6, '0') FROM {view} WHERE parent IS NULL
        UNION ALL
        SELECT c.id, c.title, c.url, concat(t.path, '/', t.title), concat(t.ord, '.', lpad(CAST(c.pos AS STRING), 6, '0'))
        FROM {view} c JOIN t ON c.parent = t.id)
        SELECT id, title, url, path, ord FROM t WHERE url IS NOT NULL"""
    )
