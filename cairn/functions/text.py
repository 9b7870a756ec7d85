"""Text functions on columns: tokens, labels, titles, redaction, hashes, citations."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: patterns and word lists that results depend on
TOKEN = "[a-z0-9][a-z0-9._-]*"
GRAPH_TERM = "[a-z0-9][a-z0-9.-]*"
FNV_BASIS, FNV_PRIME, MASK32 = 2166136261, 16777619, 4294967295
SAFE_ID = "^[A-Za-z0-9:_#.-]+$"
#: a word's edge by ASCII alone, which the engine's own mark for it is not
EDGE = r"(?:(?<=\w)(?!\w)|(?<!\w)(?=\w))"


def ascii_edges(pattern: str) -> str:
    return pattern.replace(r"\b", EDGE)


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def tokens(x: Column | str) -> Column:
    """Lower-case ASCII tokens in order; dots, dashes and underscores after the first character stay."""
    return F.regexp_extract_all(F.lower(_c(x)), F.lit(TOKEN), F.lit(0))


def token_count(x: Column | str) -> Column:
    """How many tokens a text has, without making them."""
    return F.regexp_count(F.lower(_c(x)), F.lit(TOKEN))


def graph_terms(x: Column | str) -> Column:
    """Distinct terms without underscores."""
    return F.array_distinct(F.regexp_extract_all(F.lower(_c(x)), F.lit(GRAPH_TERM), F.lit(0)))


def long_terms(x: Column | str) -> Column:
    """Distinct tokens of more than two characters."""
    return F.array_distinct(F.filter(tokens(x), lambda t: F.length(t) > 2))


def without(terms: Column, stopwords: list[str]) -> Column:
    return F.array_except(terms, F.array(*[F.lit(w) for w in stopwords]))


def overlap(a: Column, b: Column) -> Column:
    """Distinct shared terms."""
    return F.size(F.array_intersect(a, b))


def has_phrase(text: Column | str, phrase: Column | str) -> Column:
    p = F.lower(squeeze_ends(phrase))
    return (F.length(p) > 0) & F.lower(_c(text)).contains(p)


def squeeze_ends(x: Column | str) -> Column:
    return F.regexp_replace(_c(x), r"(?U)^\s+|\s+$", "")


def clean_text(x: Column | str) -> Column:
    """White space up to a line end goes, blanks in a row are one, ends are trimmed."""
    return squeeze_ends(F.regexp_replace(F.regexp_replace(_c(x), r"(?U)\s+\n", "\n"), r"[ \t]{2,}", " "))


def norm_label(x: Column | str) -> Column:
    """Lower case, white space collapsed and trimmed."""
    return F.trim(F.regexp_replace(F.lower(_c(x)), r"(?U)\s+", " "))


def fnv1a(x: Column | str) -> Column:
    """32-bit FNV-1a over code points, as a long."""
    codes = F.transform(F.filter(F.split(_c(x), ""), lambda c: c != ""), lambda c: F.ascii(c).cast("long"))
    return F.aggregate(
        codes, F.lit(FNV_BASIS).cast("long"), lambda h, c: (h.bitwiseXOR(c) * F.lit(FNV_PRIME)).bitwiseAND(F.lit(MASK32))
    )


def short_hash(x: Column | str) -> Column:
    """Six hex digits of the hash of the normalised text."""
    return F.substring(F.lpad(F.lower(F.hex(fnv1a(norm_label(x)))), 8, "0"), 1, 6)


def sentence_id(doc: Column, chunk: Column, sentence: Column, text: Column) -> Column:
    return F.concat(doc.cast("string"), F.lit(":c"), chunk.cast("string"), F.lit(":s"), sentence.cast("string"), F.lit("#"), short_hash(text))


def collapse(x: Column | str) -> Column:
    return F.trim(F.regexp_replace(_c(x), r"(?U)\s+", " "))


def snippet(x: Column | str, limit: int = 200) -> Column:
    t = collapse(x)
    return F.when(F.length(t) > limit, F.concat(F.substring(t, 1, limit), F.lit("…"))).otherwise(t)


def clip(x: Column | str, limit: int) -> Column:
    """Collapsed text of at most ``limit`` characters: cut at the last space if that is past 60 % of it, with an ellipsis."""
    t = collapse(x)
    cut = F.substring(t, 1, limit - 1)
    last = F.length(cut) - F.instr(F.reverse(cut), " ")  # characters before the last space
    whole = F.when((F.instr(cut, " ") > 0) & (last > limit * 0.6), F.left(cut, last)).otherwise(cut)
    return F.when(F.length(t) <= limit, t).otherwise(F.concat(F.rtrim(whole), F.lit("…")))


def drop_command(x: Column | str) -> Column:
    """Without a leading /command; the command's name if nothing follows it."""
    t = collapse(x)
    whole = r"(?is)^/([a-z0-9-]+)(?:\s+(.+))?$"
    rest = F.regexp_extract(t, whole, 2)
    return F.when(t.rlike(whole), F.when(rest != "", rest).otherwise(F.regexp_extract(t, whole, 1))).otherwise(t)


def title(x: Column | str) -> Column:
    return clip(drop_command(x), 60)


def preview(x: Column | str) -> Column:
    return clip(x, 120)


def summary(x: Column | str) -> Column:
    return clip(x, 240)


def slug(x: Column | str, limit: int | None = 40) -> Column:
    s = F.regexp_replace(F.regexp_replace(F.lower(_c(x)), "[^a-z0-9]+", "-"), "^-+|-+$", "")
    return F.regexp_replace(F.substring(s, 1, limit), "-+$", "") if limit else s


# fixed values: named references that are decoded
REFERENCES = (("nbsp", " "), ("lt", "<"), ("gt", ">"), ("quot", '"'), ("apos", "'"), ("amp", "&"))


def _numbered(t: Column) -> Column:
    """References by decimal numbers decoded, of characters that there are; split at them, so no character needs a pattern of its own."""
    parts = F.split(t, "&#(?=[0-9]{1,7};)")
    return F.array_join(F.transform(parts, lambda x, i: F.when((i > 0) & x.rlike("^[0-9]{1,7};"), F.concat(_char(F.regexp_extract(x, "^([0-9]+);", 1)), F.regexp_replace(x, "^[0-9]+;", ""))).otherwise(x)), "")


def _char(number: Column) -> Column:
    """The character of a code point, by its bytes in UTF-8; nothing for none."""
    n = number.cast("int")
    byte = lambda lead, shift: F.hex((F.shiftright(n, shift).bitwiseAND(F.lit(63)) + F.lit(128)) if lead is None else (F.shiftright(n, shift) + F.lit(lead)))
    tail = lambda k: [byte(None, 6 * x) for x in range(k - 1, -1, -1)]
    code = (
        F.when(n < 128, F.lpad(F.hex(n), 2, "0")).when(n < 0x800, F.concat(byte(0xC0, 6), *tail(1))).when((n >= 0xD800) & (n < 0xE000), F.lit("EFBFBD"))
        .when(n < 0x10000, F.concat(byte(0xE0, 12), *tail(2))).when(n < 0x110000, F.concat(byte(0xF0, 18), *tail(3))).otherwise(F.lit("EFBFBD"))
    )
    return F.when(n == 0, F.lit("\ufffd")).otherwise(F.unhex(code).cast("string"))


def strip_html(x: Column | str, tag: str = " ", numbered: bool = False) -> Column:
    """Text of markup: scripts and styles go, tags become ``tag``, common references are decoded; ``numbered``: those by number too, and unknown ones are blanks."""
    t = F.regexp_replace(_c(x), r"(?is)<(script|style)\b[^>]*>.*?</\1\s*>", " ")
    t = F.regexp_replace(t, r"(?i)<br\s*/?>|</(p|div|li|tr|h[1-6]" + (r"|table|blockquote" if numbered else "") + r")\s*>", "\n")
    t = F.regexp_replace(t, r"(?s)<[^>]*>", tag)
    t = _numbered(t) if numbered else F.replace(t, F.lit("&#39;"), F.lit("'"))
    for ref, char in REFERENCES[:-1]:
        t = F.regexp_replace(t, f"(?i)&{ref};", char)
    if numbered:
        t = F.regexp_replace(t, "(?i)&(?!amp;)[a-z#0-9]+;", " ")
    t = F.regexp_replace(t, "(?i)&amp;", "&")
    t = F.regexp_replace(t, r"[ \t]+", " ")
    return squeeze_ends(F.regexp_replace(t, r" ?\n[ \n]*", "\n"))


# fixed values: shapes of secrets, names of secret fields, and what replaces them, in this order
REDACTED = "[redacted]"
SECRET_SHAPES = (
    r"\bgh[oprsu]_[A-Za-z0-9]{10,}\b",
    r"(?i)\bBearer\s+[A-Za-z0-9._~+/-]{10,}=*",
    r"\bglpat-[A-Za-z0-9_-]{10,}\b",
    r"(?i)\bgl[oa]a-[A-Za-z0-9_-]{10,}\b",
    r"\b(sk|xai)-[A-Za-z0-9_-]{10,}\b",
)
SECRET_KEYS = "access_token|refresh_token|id_token|client_secret|authorization|api_key|code|device_code"
SECRET_FIELDS = (
    (rf'(?i)"({SECRET_KEYS})"\s*:\s*"[^"]{{4,}}"', f'"$1":"{REDACTED}"'),
    (rf"(?i)\b({SECRET_KEYS})=[^&\s\"'}}\],]{{4,}}", f"$1={REDACTED}"),
)
SENSITIVE_KEY = "(?i)(password|secret|token|api_?key|authorization|cookie)"


def redact(x: Column | str) -> Column:
    """Tokens, keys and secret fields replaced."""
    t = _c(x)
    for pattern, to in (*((p, REDACTED) for p in SECRET_SHAPES), *SECRET_FIELDS):
        t = F.regexp_replace(t, ascii_edges(pattern), to)
    return t


def redact_map(m: Column, limit: int = 120) -> Column:
    """Values of sensitive keys are hidden, others redacted and cut."""
    return F.transform_values(m, lambda k, v: F.when(k.rlike(SENSITIVE_KEY), F.lit(REDACTED)).otherwise(F.substring(redact(v), 1, limit)))


def sha256_hex(x: Column | str) -> Column:
    return F.sha2(_c(x).cast("binary"), 256)


def citation_ids(x: Column | str) -> Column:
    """Ids in [[a, b]] groups, safe ones, in order of first appearance."""
    groups = F.regexp_extract_all(_c(x), F.lit(r"\[\[([^\[\]]+)\]\]"), F.lit(1))
    ids = F.flatten(F.transform(groups, lambda g: F.transform(F.split(g, "[,;|]"), lambda s: F.trim(s))))
    return F.array_distinct(F.filter(ids, lambda s: s.rlike(SAFE_ID)))


def slice_to_limit(x: Column | str, limit: int) -> Column:
    """(text, chars, truncated)."""
    t = _c(x)
    return F.struct(F.substring(t, 1, limit).alias("text"), F.length(t).alias("chars"), (F.length(t) > limit).alias("truncated"))


def version_array(x: Column | str, width: int = 4) -> Column:
    """Numeric parts of a dotted version, padded by zeros: compares like a version."""
    parts = F.transform(F.split(F.regexp_replace(_c(x), "^v", ""), r"\."), lambda p: F.coalesce(p.try_cast("int"), F.lit(0)))
    return F.slice(F.concat(parts, F.array_repeat(F.lit(0), width)), 1, width)


def bump_version(x: Column | str) -> Column:
    v = version_array(x, 3)
    return F.concat_ws(".", v[0].cast("string"), v[1].cast("string"), (v[2] + 1).cast("string"))


def front_matter(x: Column | str) -> Column:
    """Map of the key: value lines between leading --- fences; empty without any."""
    body = F.regexp_extract(_c(x), r"(?s)^---\s*\n(.*?)\n---", 1)
    lines = F.filter(F.split(body, "\n"), lambda s: s.rlike(r"^[A-Za-z][\w-]*\s*:"))
    pairs = F.transform(lines, lambda s: F.struct(F.regexp_extract(s, r"^([^:\s]+)", 1).alias("k"), F.trim(F.regexp_extract(s, r"^[^:]*:(.*)$", 1)).alias("v")))
    keys = F.array_distinct(F.transform(pairs, lambda p: p.k))
    return F.map_from_arrays(keys, F.transform(keys, lambda k: F.element_at(F.filter(pairs, lambda p: p.k == k), 1).v))


def clean_list(a: Column, limit: int | None = None) -> Column:
    """Trimmed, non-empty, distinct, the first ``limit``."""
    out = F.array_distinct(F.filter(F.transform(a, lambda s: F.trim(s)), lambda s: s.isNotNull() & (s != "")))
    return F.slice(out, 1, limit) if limit else out


def file_kind(name: Column | str, mime: Column | None = None) -> Column:
    """Kind of a file by its extension, else by its type."""
    ext = F.lower(F.regexp_extract(_c(name), r"\.([A-Za-z0-9]+)$", 1))
    kind = F.when(ext == "pdf", "pdf")
    kind = kind.when(ext.isin("doc docx xls xlsx ppt pptx odt ods odp rtf epub".split()), "office")
    kind = kind.when(ext.isin("eml", "msg"), "mail").when(ext.isin("png jpg jpeg gif webp bmp svg".split()), "image")
    kind = kind.when(ext.isin("txt md markdown csv tsv json xml html htm log yaml yml".split()), "text")
    if mime is not None:
        kind = kind.when(mime == "application/pdf", "pdf").when(mime.startswith("image/"), "image").when(mime.startswith("text/"), "text")
    return kind.otherwise("other")


def json_object(x: Column | str, schema: str) -> Column:
    """The outermost object in prose or a code fence, parsed; malformed: null fields."""
    return F.from_json(F.regexp_extract(_c(x), r"(?s)(\{.*\})", 1), schema, {"mode": "PERMISSIVE"})
