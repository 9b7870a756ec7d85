"""URL functions on columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import collapse, squeeze_ends

_PARTS = r"^([A-Za-z][A-Za-z0-9+.-]*)://([^/?#]*)([^?#]*)"


def without_dots(path: Column) -> Column:
    """A path without its segments of one and two dots, of which the second take the segment before them along."""
    segments = F.split(path, "/")
    dots = lambda s, n: F.lower(F.replace(F.lower(s), F.lit("%2e"), F.lit("."))) == "." * n
    kept = F.aggregate(
        segments, F.array().cast("array<string>"),
        lambda acc, s: F.when(dots(s, 1), acc).when(dots(s, 2), F.when(F.size(acc) > 1, F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(acc)).otherwise(F.array_append(acc, s)),
    )
    last = F.element_at(segments, -1)
    return F.array_join(F.when(dots(last, 1) | dots(last, 2), F.array_append(kept, F.lit(""))).otherwise(kept), "/")


def _authority(scheme: Column, host: Column) -> Column:
    """User as it is, host in lower case, no port that the scheme has anyway."""
    user, rest = F.regexp_extract(host, "^(.*@)?(.*)$", 1), F.lower(F.regexp_extract(host, "^(.*@)?(.*)$", 2))
    port = F.when(F.lower(scheme) == "http", F.regexp_replace(rest, ":(80)?$", "")).when(F.lower(scheme) == "https", F.regexp_replace(rest, ":(443)?$", ""))
    return F.concat(user, F.coalesce(port, rest))


def normalize_url(x: Column) -> Column:
    """Without query, fragment, dot segments and default port, lower-case scheme and host, one trailing slash stripped; other text is trimmed."""
    url = squeeze_ends(x)
    scheme, host, path = (F.regexp_extract(url, _PARTS, k) for k in (1, 2, 3))
    out = F.concat(F.lower(scheme), F.lit("://"), _authority(scheme, host), F.regexp_replace(F.when(path.contains("."), without_dots(path)).otherwise(path), "/$", ""))
    return F.when(url.rlike(_PARTS), out).otherwise(url)


def normalize_host(x: Column) -> Column:
    h = F.regexp_replace(F.lower(F.trim(x)), r"^[a-z][a-z0-9+.-]*://", "")
    return F.regexp_replace(F.regexp_replace(h, r"[/?#].*$", ""), r"^www\.", "")


def canonical_url(x: Column) -> Column:
    return F.regexp_replace(x, "#.*$", "")


def frontier_key(url: Column, query: Column | None = None) -> Column:
    key = F.regexp_replace(canonical_url(url), "/+$", "")
    return key if query is None else F.when(url.isNotNull(), key).otherwise(F.concat(F.lit("q:"), F.lower(collapse(query))))


def host_matches(host: Column, origin: Column) -> Column:
    """Equal or a subdomain, both non-empty."""
    return (host != "") & (origin != "") & ((host == origin) | host.endswith(F.concat(F.lit("."), origin)))


def url_host(x: Column) -> Column:
    return F.lower(F.regexp_extract(x, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))


def is_http(x: Column) -> Column:
    return x.rlike("(?i)^https?://")


# fixed values: the browser's own viewer of documents, extensions of office files, addresses of viewers
PDF_VIEWER = "mhjfbmdgcfjbbpaeojofohoefgiehjai"
OFFICE = r"\.(docx?|docm|pptx?|pptm|ppsx|xlsx?|xlsm|odt|ods|odp|rtf|epub)$"
SHARED = r"(?i)^/:[wxp]:/[a-z](/.*)$"
VIEWER = r"(?i)^(.*)/_layouts/15/(?:doc|wopiframe)\.aspx$"
WOPI = r"(?i)^(https?://[^/?#]+)([^?#]*)/_vti_bin/wopi\.ashx/files/([0-9a-f-]{36})(?:[?#].*)?$"
GUID = r"(?i)^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$"


def _asked(url: Column, *names: str) -> Column:
    """The first of these parameters of the query that there is, decoded; null without any, or for one that cannot be read."""
    found = [F.regexp_extract(url, rf"^[^?#]*\?(?:[^#]*&)?{n}=([^&#]*)", 1) for n in names]
    there = [F.when(url.rlike(rf"^[^?#]*\?(?:[^#]*&)?{n}="), x) for n, x in zip(names, found)]
    return F.try_url_decode(F.coalesce(*there))


def pdf_url(url: Column) -> Column:
    """The address of a PDF file for that of a tab: its own, or what the browser's viewer shows; null for others."""
    path = F.regexp_extract(url, _PARTS, 3)
    viewed = url.rlike(rf"(?i)^chrome-extension://{PDF_VIEWER}(?:[/?#]|$)")
    source = _asked(url, "src")
    fit = source.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:.") & ~source.rlike(r"(?i)^chrome(-extension|-untrusted)?:")
    return F.when(url.rlike(_PARTS) & path.rlike(r"(?i)\.pdf$"), url).when(viewed & fit, source)


def office_url(url: Column) -> Column:
    """The address of an office file's bytes for that of a tab that shows it: links that share it, viewers and editors by the file's id."""
    origin = F.concat(F.lower(F.regexp_extract(url, _PARTS, 1)), F.lit("://"), _authority(F.regexp_extract(url, _PARTS, 1), F.regexp_extract(url, _PARTS, 2)))
    path = without_dots(F.regexp_extract(url, _PARTS, 3))
    shared = F.regexp_extract(path, SHARED, 1)
    by_id = lambda site, guid: F.concat(site, F.lit("/_api/web/GetFileById('"), guid, F.lit("')/$value"))
    wopi = _asked(url, "wopisrc", "WOPISrc", "WopiSrc")
    wopi_id = F.regexp_extract(wopi, WOPI, 3)
    guid = F.regexp_replace(_asked(url, "sourcedoc"), "[{}]", "")
    return (
        F.when(~url.rlike(_PARTS), None).when((shared != "") & F.lower(shared).rlike(OFFICE), F.concat(origin, shared)).when(F.lower(path).rlike(OFFICE), url)
        .when(wopi_id.rlike(GUID), by_id(F.concat(F.lower(F.regexp_extract(wopi, WOPI, 1)), F.regexp_extract(wopi, WOPI, 2)), wopi_id))
        .when(path.rlike(VIEWER) & guid.rlike(GUID), by_id(F.concat(origin, F.regexp_extract(path, VIEWER, 1)), guid))
    )


def document_kind(x: Column) -> Column:
    """pdf or office for addresses of files and of their viewers; null for web pages."""
    return F.when(pdf_url(x).isNotNull(), "pdf").when(office_url(x).isNotNull(), "office")


def resolved(file: Column, base: Column) -> Column:
    """An address as it is read beside ``base``: absolute ones stay, others are joined with its host or folder; null if neither has a host."""
    whole = F.when(file.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), file)
    scheme, host, path = (F.regexp_extract(base, _PARTS, k) for k in (1, 2, 3))
    root = F.concat(F.lower(scheme), F.lit("://"), _authority(scheme, host))
    folder = F.when(path == "", "/").otherwise(F.regexp_extract(path, "^(.*/)", 1))
    way, rest = F.regexp_extract(file, r"(?s)^([^?#]*)(.*)$", 1), F.regexp_extract(file, r"(?s)^([^?#]*)(.*)$", 2)
    made = (
        F.when(file.startswith("//"), F.concat(F.lower(scheme), F.lit(":"), file)).when(way.startswith("/"), F.concat(root, without_dots(way), rest))
        .when(way != "", F.concat(root, without_dots(F.concat(folder, way)), rest))
    )
    return F.when(file != "", F.coalesce(whole, F.when(base.rlike(_PARTS), made)))
