"""URL scalars: identifiers, canonical form and owning source."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: the RFC 4122 namespace for URLs.
UUID_NAMESPACE_URL = "6ba7b8119dad11d180b400c04fd430c8"

# scheme (which "//host/path" leaves out), authority, everything after it
_PARTS = r"^(?:([A-Za-z][A-Za-z0-9+.\-]*):)?(?://([^/?#]*))?(.*)$"


def slug(url: Column) -> Column:
    return F.sha1(url)


def document_id(url: Column) -> Column:
    """First 48 bits of the slug as a number."""
    return F.conv(F.substring(F.sha1(url), 1, 12), 16, 10).cast("bigint")


def uuid5(name: Column, namespace: str = UUID_NAMESPACE_URL) -> Column:
    """Name-based UUID, version 5."""
    digest = F.sha1(F.concat(F.unhex(F.lit(namespace)), F.encode(name, "UTF-8")))
    # version nibble is 5; the variant nibble keeps its low two bits under 10xx
    variant = F.translate(
        F.substring(digest, 17, 1), "0123456789abcdef", "89ab89ab89ab89ab")
    return F.concat(
        F.substring(digest, 1, 8), F.lit("-"),
        F.substring(digest, 9, 4), F.lit("-5"),
        F.substring(digest, 14, 3), F.lit("-"), variant,
        F.substring(digest, 18, 3), F.lit("-"),
        F.substring(digest, 21, 12))


def chunk_id(url: Column, index: Column) -> Column:
    return uuid5(F.concat(url, F.lit("#"), index.cast("string")))


def authority(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, _PARTS, 2))


def origin(url: Column) -> Column:
    """scheme://host of a URL, as written."""
    return F.regexp_extract(url, r"^([^:/?#]+://[^/?#]*)", 1)


def path(url: Column) -> Column:
    return F.regexp_extract(
        url, r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?(?://[^/?#]*)?([^?#]*)", 1)


def canonical(url: Column, hosts: Mapping[str, str]) -> Column:
    """Move known hosts to their canonical scheme and host.

    ``hosts`` is site configuration (host -> origin), so it becomes a literal
    map inside the projection: no join, no shuffle.
    """
    if not hosts:
        return url
    host_map = F.create_map(*[F.lit(x) for pair in hosts.items() for x in pair])
    base = F.try_element_at(host_map, authority(url))
    return F.when(base.isNull(), url).otherwise(
        F.concat(base, F.regexp_extract(url, _PARTS, 3)))


def source_of(url: Column, sources: Sequence[str]) -> Column:
    """First source whose name occurs in the host, else null."""
    host = authority(url)
    branches = [F.when(F.contains(host, F.lit(name)), F.lit(name)) for name in sources]
    return F.coalesce(*branches, F.lit(None).cast("string"))
