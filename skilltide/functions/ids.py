"""Deterministic identifiers, computed inside the JVM."""

from __future__ import annotations

import uuid

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import _col, bind, normalize_query

# The key shape of a posting URL and the namespace of catalog rows.
POSTING_PATH_PATTERN = r"/jobs/view/[^/?#]+-(\d+)"
POSTING_KEY_PREFIX = "linkedin:"
CATALOG_NAMESPACE = "6f8d2e4a-9c1b-4e7a-9b2f-1a3c5d7e9f01"
URL_NAMESPACE = str(uuid.NAMESPACE_URL)


def uuid5(namespace: str, name: Column | str) -> Column:
    """RFC 4122 name-based UUID (SHA-1) as lower-case hyphenated text."""
    space = F.unhex(F.lit(namespace.replace("-", "")))

    def hyphenated(digest: Column) -> Column:
        variant = F.conv(F.substring(digest, 17, 1), 16, 10).cast("int") % 4
        return F.concat(
            F.substring(digest, 1, 8), F.lit("-"), F.substring(digest, 9, 4), F.lit("-5"),
            F.substring(digest, 14, 3), F.lit("-"), F.lit("89ab").substr(variant + 1, F.lit(1)),
            F.substring(digest, 18, 3), F.lit("-"), F.substring(digest, 21, 12))

    return bind(F.sha1(F.concat(space, F.encode(_col(name), "UTF-8"))), hyphenated)


def posting_key(url: Column | str, *, pattern: str = POSTING_PATH_PATTERN,
                prefix: str = POSTING_KEY_PREFIX) -> Column:
    """Stable key of a posting URL: the id in its path, else the URL itself."""
    url = _col(url)
    path = F.coalesce(F.try_parse_url(url, F.lit("PATH")),
                      F.regexp_extract(url, r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?(?://[^/?#]*)?([^?#]*)", 1))
    found = F.regexp_extract(path, pattern, 1)
    return F.when(found != "", F.concat(F.lit(prefix), found)).otherwise(url)


def posting_id(url: Column | str, **key_options: str) -> Column:
    """uuid5 of the posting key; NULL when there is no URL."""
    key = posting_key(url, **key_options)
    return uuid5(URL_NAMESPACE, F.nullif(key, F.lit("")))


def _plain(c: Column | str) -> Column:
    return F.coalesce(normalize_query(c), F.lit(""))


def content_key(company: Column | str, title: Column | str, description: Column | str) -> Column:
    """'company|title|description', each lower-cased with single blanks; NULL counts as ''.

    A '|' inside a field is kept as it is, so two different triples may share a key.
    """
    return F.concat_ws("|", _plain(company), _plain(title), _plain(description))


def content_hash(company: Column | str, title: Column | str, description: Column | str) -> Column:
    return uuid5(URL_NAMESPACE, content_key(company, title, description))
