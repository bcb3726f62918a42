"""Stable identifiers as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The URL namespace of RFC 4122.
URL_NAMESPACE = "6ba7b8119dad11d180b400c04fd430c8"


def uuid5_url(url: Column) -> Column:
    """UUID5 of a url: SHA-1 of namespace and name, with version and variant set."""
    h = F.sha1(F.concat(F.unhex(F.lit(URL_NAMESPACE)), F.encode(url, "utf-8")))
    variant = F.substr(F.lit("89ab"), (F.conv(F.substring(h, 17, 1), 16, 10).cast("int") % 4 + 1), F.lit(1))
    s = F.concat(F.substring(h, 1, 12), F.lit("5"), F.substring(h, 14, 3), variant, F.substring(h, 18, 15))
    return F.concat_ws("-", F.substring(s, 1, 8), F.substring(s, 9, 4), F.substring(s, 13, 4), F.substring(s, 17, 4), F.substring(s, 21, 12))


def safe_key(doc_id: Column) -> Column:
    """A doc_id that can name a file, else the first 32 hex digits of its SHA-256."""
    ok = doc_id.rlike(r"^[\p{L}\p{N}_\-.]+$") & (F.length(doc_id) <= 200) & ~doc_id.startswith(".")
    return F.when(ok, doc_id).otherwise(F.substring(F.sha2(doc_id, 256), 1, 32))
