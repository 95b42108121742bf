"""URL normalisers, as Column expressions over absolute http(s) URLs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def normalize_url(c: Column) -> Column:
    """No fragment, lower-case scheme and host, no default port, no slashes at the path's end unless it is the root.

    A URL without a path gets "/". Text that is no URL gives null.
    """
    u = F.regexp_replace(F.trim(c), "#.*$", "")
    scheme = F.lower(F.regexp_extract(u, r"^([A-Za-z][A-Za-z0-9+.-]*)://", 1))
    host = F.lower(F.regexp_extract(u, r"^[^:/]+://([^/?]*)", 1))
    host = F.when(scheme == "https", F.regexp_replace(host, ":443$", "")).when(scheme == "http", F.regexp_replace(host, ":80$", "")).otherwise(host)
    path = F.regexp_extract(u, r"^[^:/]+://[^/?]*([^?]*)", 1)
    path = F.regexp_replace(path, "/+$", "")
    rest = F.regexp_extract(u, r"^[^?]*(\?.*)$", 1)
    return F.when((scheme != "") & (host != ""), F.concat(scheme, F.lit("://"), host, F.when(path == "", F.lit("/")).otherwise(path), rest))


def canonical_document_url(c: Column) -> Column:
    """As ``normalize_url``, without .md at the path's end."""
    return normalize_url(F.regexp_replace(F.regexp_replace(c, "#.*$", ""), r"\.md(?=\?|$)", ""))


def allowed(c: Column, origins: list[str], prefixes: list[str]) -> Column:
    """Whether an https URL has an allowed origin and a path at or under an allowed prefix."""
    origin = F.regexp_extract(c, "^([^:/]+://[^/?]+)", 1)
    path = F.regexp_extract(c, r"^[^:/]+://[^/?#]*([^?#]*)", 1)
    under = F.lit(False)
    for p in prefixes:
        under = under | (F.lit(True) if p == "/" else (path == p) | path.startswith(p if p.endswith("/") else p + "/"))
    return c.startswith("https://") & origin.isin(*origins) & under
