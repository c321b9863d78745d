"""URLs: canonical form, redaction, safety checks. Nothing raises under ANSI mode."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_PARTS = r"^([A-Za-z][A-Za-z0-9+.-]*)://([^/?#]*)([^?#]*)"
#: Query keys that sign or identify a request.
SENSITIVE = ["token", "sign", "signature", "key", "auth", "expires", "session", "ref"]


def canonical(url: Column) -> Column:
    """Lower-case scheme and host, no trailing slash, query or fragment; empty for what is no URL."""
    scheme, host, path = (F.regexp_extract(url, _PARTS, i) for i in (1, 2, 3))
    out = F.concat(F.lower(scheme), F.lit("://"), F.lower(host), F.regexp_replace(path, "/+$", ""))
    return F.when(url.rlike(_PARTS), out).otherwise(F.lit(""))


def host(url: Column) -> Column:
    """The host in lower case, without user and port."""
    return F.lower(F.regexp_replace(F.regexp_extract(url, _PARTS, 2), "^.*@|:[0-9]*$", ""))


def redact(url: Column, keys: list[str] | None = None) -> Column:
    """Without fragment and without sensitive query parameters."""
    bare = F.substring_index(url, "#", 1)
    base = F.substring_index(bare, "?", 1)
    query = F.when(F.contains(bare, F.lit("?")), F.substring(bare, F.length(base) + 2, F.length(bare))).otherwise(F.lit(""))
    kept = F.filter(F.split(query, "&"), lambda p: (p != "") & ~F.lower(F.substring_index(p, "=", 1)).isin(keys or SENSITIVE))
    return F.when(F.size(kept) > 0, F.concat(base, F.lit("?"), F.array_join(kept, "&"))).otherwise(base)


def is_signed(url: Column) -> Column:
    """Whether the query carries a signature or an expiry."""
    return url.rlike("(?i)[?&](x-[a-z]+-signature|signature|sign|expires|token)=")


def is_audio(url: Column) -> Column:
    return F.lower(F.substring_index(url, "?", 1)).rlike(r"\.(mp3|m4a|aac|wav|ogg)$")


def allowed_https(url: Column, hosts: list[str]) -> Column:
    """https, on one of the hosts or below it."""
    h = host(url)
    ok = F.lit(False)
    for x in hosts:
        ok = ok | (h == x) | F.endswith(h, F.lit(f".{x}"))
    return url.startswith("https://") & ok


def is_private_host(h: Column) -> Column:
    """localhost and private or link-local IPv4 addresses."""
    return h.rlike(r"^(localhost|10\.[0-9.]+|127\.[0-9.]+|192\.168\.[0-9.]+|169\.254\.[0-9.]+|172\.(1[6-9]|2[0-9]|3[01])\.[0-9.]+)$")


def safe_relative_path(path: Column) -> Column:
    """Relative, without drive, backslash or a parent step."""
    return (path != "") & ~path.rlike(r"^/|^[A-Za-z]:|\\") & ~F.array_contains(F.split(path, "/"), "..")


def redact_errors(text: Column) -> Column:
    """An error text with URLs and bearer tokens replaced."""
    return F.regexp_replace(F.regexp_replace(text, r"https?://[^\s\"'>]+", "[url]"), r"(?i)bearer +[A-Za-z0-9._-]+", "bearer [redacted]")
