"""URL functions as column expressions. Three rules of the registrable domain are kept apart, since operators differ in them."""

from __future__ import annotations

from urllib.parse import urlsplit

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Second-level labels under two-letter top domains, and the pairs of the import rule.
SECOND_LABELS = ("ac", "co", "com", "edu", "gov", "net", "org")
IMPORT_PAIRS = ("co.uk", "ac.uk", "com.au", "co.ma", "ac.ma", "org.uk", "edu.au")


def host(url: Column) -> Column:
    """Lower-case host without www.; empty where there is none."""
    typed = F.trim(url)
    full = F.when(F.contains(typed, F.lit("://")), typed).otherwise(F.concat(F.lit("https://"), typed))
    own = F.regexp_extract(full, r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)
    return F.regexp_replace(F.lower(own), r"^www\.", "")


def _labels(domain: Column, n: int) -> Column:
    parts = F.split(domain, r"\.")
    return F.array_join(F.when(F.size(parts) > n, F.slice(parts, -n, n)).otherwise(parts), ".")


def registrable(url: Column, second: tuple = SECOND_LABELS) -> Column:
    """The last two labels, or three where a two-letter top domain follows one of the second labels."""
    own = host(url)
    parts = F.split(own, r"\.")
    three = (F.size(parts) > 2) & (F.length(F.element_at(parts, -1)) == 2) & F.try_element_at(parts, F.lit(-2)).isin(*second)
    return F.when(F.coalesce(three, F.lit(False)), _labels(own, 3)).otherwise(_labels(own, 2))


def import_domain(url: Column, pairs: tuple = IMPORT_PAIRS) -> Column:
    """The last two labels, or three where the last two are one of the pairs."""
    own = host(url)
    return F.when((F.size(F.split(own, r"\.")) >= 3) & _labels(own, 2).isin(*pairs), _labels(own, 3)).otherwise(_labels(own, 2))


def path(url: Column) -> Column:
    return F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^?#]*)", 1)


def canonical(url: Column) -> Column:
    """Scheme, lower-case host and path, without query, fragment and closing slashes."""
    bare = F.regexp_replace(url, r"[?#].*$", "")
    head = F.regexp_extract(bare, r"^([a-zA-Z][a-zA-Z0-9+.-]*://[^/]*)", 1)
    return F.regexp_replace(F.concat(F.lower(head), F.regexp_replace(bare, r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/]*", "")), "/+$", "")


@F.pandas_udf(StringType())
def strict_canonical(urls: pd.Series) -> pd.Series:
    """A web address in one spelling, with its query; null where scheme, host, port or user part is not plain."""

    def one(value):
        try:
            parts = urlsplit((value or "").strip())
            if parts.scheme not in ("http", "https") or parts.username or parts.password or (parts.port not in (None, 80, 443)):
                return None
            name = (parts.hostname or "").rstrip(".").encode("idna").decode("ascii").lower()
        except (ValueError, UnicodeError):
            return None
        return f"{parts.scheme}://{name}{parts.path or '/'}{'?' + parts.query if parts.query else ''}" if "." in name else None

    return urls.map(one)


def homepage(url: Column) -> Column:
    """The host where the address has neither path nor query; empty otherwise."""
    deep = (F.regexp_replace(path(url), "/", "") != "") | F.contains(url, F.lit("?"))
    return F.when(deep, "").otherwise(host(url))


def unit_path(url: Column, words: str = "department|dept|school|college|center|centre|institute|lab|labs|program|programs") -> Column:
    """The address is that of a unit inside a larger site."""
    return F.lower(path(url)).rlike(rf"/({words})(/|-|$)")


def key(url: Column) -> Column:
    """The address without scheme, www. and closing slashes, lower case."""
    return F.regexp_replace(F.regexp_replace(F.lower(F.trim(url)), r"^[a-z][a-z0-9+.-]*://(www\.)?", ""), "/+$", "")


def typed(value: Column) -> Column:
    """A typed address with https added to a bare one; null where it cannot be an address."""
    text = F.trim(value)
    full = F.when(text.rlike(r"^(?i)https?://"), text).when(text.rlike(r"^[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+([/?#].*)?$"), F.concat(F.lit("https://"), text))
    return F.when(full.rlike(r"^https?://[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+([:/?#].*)?$"), full)


def profile_kind(url: Column) -> Column:
    """What an address says of a person's page."""
    p = F.lower(path(url))
    return (
        F.when(p.rlike(r"/(people|person|profile|profiles|faculty|staff|team)/[^/]+"), "profile")
        .when(p.rlike(r"/(people|faculty|staff|team|directory)/?$"), "list")
        .when(p.rlike(r"/(news|blog|press|stories)/"), "news")
        .otherwise("other")
    )
