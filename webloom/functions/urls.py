"""URL expressions: Column to Column, built-in functions only."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Characters of a URL that need no percent-encoding.
LEGAL = r"A-Za-z0-9\-._~!$&'()*+,;=:@\[\]/%"


def scheme(url: Column) -> Column:
    return F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.\-]*):", 1)


def host(url: Column) -> Column:
    return F.regexp_extract(url, r"^[^:/?#]+://([^/?#]*)", 1)


def path(url: Column) -> Column:
    return F.regexp_extract(url, r"^[^:/?#]+://[^/?#]*([^?#]*)", 1)


def query(url: Column) -> Column:
    """The raw query, '' if there is none; a fragment is no part of it."""
    return F.regexp_extract(F.substring_index(url, "#", 1), r"\?(.*)$", 1)


def percent_encode(url: Column) -> Column:
    """Illegal characters as %XX of their UTF-8 bytes; URLs that are legal pass unsplit."""
    one = lambda c: F.when(c.rlike(f"^[{LEGAL}]$"), c).otherwise(F.regexp_replace(F.hex(F.encode(c, "UTF-8")), "(..)", "%$1"))
    return F.when(url.rlike(f"^[{LEGAL}]*$"), url).otherwise(F.array_join(F.transform(F.split(url, ""), one), ""))


def normalize_url(url: Column) -> Column:
    """Without query and fragment, percent-encoded, then lower-cased. Scheme, port and trailing slash stay."""
    return F.lower(percent_encode(F.regexp_replace(url, r"(?s)[?#].*$", "")))


def make_absolute(raw: Column, base: Column) -> Column:
    """The fast path's resolution: absolute as is, // with the scheme, / with the host, all else after the base."""
    return (
        F.when((F.length(raw) > 7) & (raw.startswith("http://") | raw.startswith("https:/")), raw)
        .when((F.length(raw) > 2) & raw.startswith("//"), F.concat(scheme(base), F.lit(":"), raw))
        .when(raw.startswith("/"), F.concat(scheme(base), F.lit("://"), host(base), raw))
        .otherwise(F.concat(base, F.when(base.endswith("/"), "").otherwise("/"), raw))
    )


def depth(text: Column) -> Column:
    """A depth carried as text: the whole number that it starts with, 0 without one."""
    return F.coalesce(F.regexp_extract(text, r"^\s*([+-]?[0-9]+)", 1).try_cast("int"), F.lit(0))


def fast_link_kept(raw: Column) -> Column:
    """Not empty, no fragment, script or mail link; case counts."""
    return (raw != "") & ~raw.rlike("^(#|javascript:|mailto:)")


def extension(url: Column) -> Column:
    """'.' and what follows the last dot, up to a '?'; '' without a dot."""
    return F.when(F.instr(url, ".") > 0, F.concat(F.lit("."), F.regexp_replace(F.substring_index(url, ".", -1), r"(?s)\?.*$", ""))).otherwise("")


def is_document_suffix(url: Column, extensions: Sequence[str]) -> Column:
    """Two-tier rule: the lower-cased URL ends with one of the extensions. One look-up for each length that they have."""
    out, low = F.lit(False), F.lower(url)
    for n in sorted({len(e) for e in extensions}):
        out = out | F.right(low, F.lit(n)).isin([e for e in extensions if len(e) == n])
    return out


def is_document_contains(url: Column, extensions: Sequence[str]) -> Column:
    """Single-tier rule: ends with an extension, or holds one before ? or &."""
    out, u = F.lit(False), F.lower(url)
    for e in extensions:
        out = out | u.endswith(e) | u.contains(e + "?") | u.contains(e + "&")
    return out


def is_crawlable(url: Column) -> Column:
    """Has a host, no control characters, and only proper %XX in its path."""
    return (host(url) != "") & ~url.rlike(r"[\x00-\x1F\x7F]") & ~path(url).rlike("%(?![0-9A-Fa-f]{2})")


def seed_url(raw: Column) -> Column:
    """A start URL: null without scheme or host; a scheme other than http or https becomes https."""
    s = scheme(raw)
    return F.when((s == "") | (host(raw) == ""), None).when(F.lower(s).isin("http", "https"), raw).otherwise(F.concat(F.lit("https"), F.substring(raw, F.length(s) + 1, F.length(raw))))


def cut_bytes(text: Column, n: Column | int) -> Column:
    """The first n bytes of a string; a character cut in two becomes a replacement character."""
    return F.decode(F.substring(F.encode(text, "UTF-8"), F.lit(1), F.lit(n) if isinstance(n, int) else n), "UTF-8")


def sanitize_filename(name: Column) -> Column:
    """Path and shell signs as _, at most 200 bytes, the extension kept."""
    clean = F.regexp_replace(name, r"[\\/:*?\"<>|\x00]", "_")
    ext = F.when(F.instr(clean, ".") > 0, F.concat(F.lit("."), F.substring_index(clean, ".", -1))).otherwise("")
    return F.when(F.octet_length(clean) <= 200, clean).otherwise(F.concat(cut_bytes(clean, F.greatest(F.lit(0), 200 - F.octet_length(ext))), ext))


def filename(url: Column, disposition: Column | None = None) -> Column:
    """A file name from an attachment header or the URL's last segment; a hashed one where neither has a dot."""
    last = F.regexp_replace(F.substring_index(url, "/", -1), r"(?s)\?.*$", "")
    named = F.when((last == "") | (F.instr(last, ".") == 0), F.concat(F.lit("download_"), F.hex(F.xxhash64(url)))).otherwise(sanitize_filename(last))
    if disposition is None:
        return named
    start = "attachment; filename="
    given = F.btrim(F.substring(disposition, len(start) + 1, 2**31 - 1), F.lit('"'))
    return F.when(F.coalesce(disposition, F.lit("")).startswith(start), sanitize_filename(given)).otherwise(named)
