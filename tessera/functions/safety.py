"""What may be fetched and what may be shown: URLs, metadata, text for pages, masks and identifiers."""

from __future__ import annotations

import ipaddress
import json
import re
from collections.abc import Callable
from urllib.parse import urlsplit

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StringType

from tessera.functions.sensitive import line_is_sensitive

# Hosts that give out credentials, networks beyond the ranges that the library calls private, and lengths.
METADATA_HOSTS = ("metadata.google.internal", "metadata.google.com")
BLOCKED_NETWORKS = tuple(ipaddress.ip_network(n) for n in ("0.0.0.0/8", "100.64.0.0/10", "198.18.0.0/15", "240.0.0.0/4", "192.0.2.0/24", "198.51.100.0/24", "203.0.113.0/24", "2001:db8::/32"))
NAT64 = ipaddress.ip_network("64:ff9b::/96")
VALUE_LENGTH, LIST_LENGTH = 512, 50


def address_is_blocked(ip: ipaddress.IPv4Address | ipaddress.IPv6Address) -> bool:
    """Private, local, reserved and multicast addresses, also where IPv6 carries them."""
    if ip.version == 6:
        inner = ip.ipv4_mapped or (ipaddress.IPv4Address(int(ip) & 0xFFFFFFFF) if ip in NAT64 else None)
        if inner is not None:
            return address_is_blocked(inner)
    special = ip.is_private or ip.is_loopback or ip.is_link_local or ip.is_unspecified or ip.is_multicast or ip.is_reserved
    return special or any(ip in n for n in BLOCKED_NETWORKS if n.version == ip.version)


def url_problem(url: str | None, resolve: Callable[[str], list[str]] | None = None) -> str | None:
    """FLT14: why a URL must not be fetched, or null.

    Names are looked up only by resolve, which gives a host's addresses; without it the policy holds
    for schemes, named hosts and literal addresses.
    """
    try:
        parts = urlsplit(url or "")
        host, _ = parts.hostname, parts.port
    except ValueError:
        return "invalid"
    if parts.scheme.lower() not in ("http", "https"):
        return "scheme"
    if not host:
        return "host"
    if host in METADATA_HOSTS:
        return "metadata"
    try:
        addresses = [ipaddress.ip_address(host)]
    except ValueError:
        try:
            addresses = [ipaddress.ip_address(a) for a in resolve(host)] if resolve else []
        except (OSError, ValueError):
            return "unresolved"
        if resolve and not addresses:
            return "unresolved"
    return "address" if any(map(address_is_blocked, addresses)) else None


@F.pandas_udf(StringType())
def url_problem_udf(s: pd.Series) -> pd.Series:
    return s.map(url_problem)


def html_escape(text: Column) -> Column:
    """FN56: the five signs of markup as entities."""
    for sign, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        text = F.replace(text, F.lit(sign), F.lit(name))
    return text


def clean_text(text: Column) -> Column:
    """A string without control characters, escaped, cut to VALUE_LENGTH."""
    return F.substring(html_escape(F.regexp_replace(text, r"[\x00-\x1f\x7f]", "")), 1, VALUE_LENGTH)


def clean_metadata(value):
    """FLT16: a JSON value with clean keys and strings; lists end after LIST_LENGTH items, empty keys go."""
    if isinstance(value, str):
        value = re.sub(r"[\x00-\x1f\x7f]", "", value)
        for sign, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
            value = value.replace(sign, name)
        return value[:VALUE_LENGTH]
    if isinstance(value, list):
        return [clean_metadata(v) for v in value[:LIST_LENGTH]]
    if isinstance(value, dict):
        return {key: clean_metadata(v) for k, v in value.items() if (key := clean_metadata(str(k)))}
    return value


@F.pandas_udf(StringType())
def clean_metadata_udf(s: pd.Series) -> pd.Series:
    """clean_metadata of JSON texts; what is no JSON becomes null."""

    def one(text):
        try:
            return json.dumps(clean_metadata(json.loads(text)), ensure_ascii=False, separators=(",", ":"))
        except (TypeError, ValueError):
            return None

    return s.map(one)


@F.pandas_udf(BooleanType())
def line_is_sensitive_udf(s: pd.Series) -> pd.Series:
    return s.map(lambda x: x is not None and line_is_sensitive(x))


def is_jwt(value: Column) -> Column:
    """FN47: three parts of URL-safe letters, the first one of JSON."""
    return F.rlike(F.trim(value), F.lit(r"^eyJ[A-Za-z0-9_-]*\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+$"))


def has_credentials(url: Column) -> Column:
    """FN48: a URL with a user and a password, one of them not empty, before its host."""
    return F.rlike(F.trim(url), F.lit(r"(?i)^https?://([^/?#:@]+:|:[^/?#@])[^/?#]*@"))


def label_identifiers(label: Column) -> Column:
    """FN50: the identifiers of three letters or more before the first parenthesis."""
    base = F.regexp_replace(label, r"\((?s:.*)$", "")
    return F.filter(F.regexp_extract_all(base, F.lit("([A-Za-z_][A-Za-z0-9_]*)"), F.lit(1)), lambda x: F.length(x) >= 3)


def nodes_found(result: Column) -> Column:
    """FN62: the number in the first 'N nodes found'; null where there is none."""
    return F.nullif(F.regexp_extract(result, r"(?:^|\s)\+?(\d+)\s+nodes?\s+found(?=\s|$)", 1), F.lit("")).try_cast("long")


def make_id(*parts: Column) -> Column:
    """FN2, FN3: the parts without underscores and dots around them, joined by underscores; empty ones go.

    The result is still to be normalized (functions/text.py, normalize_id_udf).
    """
    return F.array_join(F.filter(F.transform(F.array(*parts), lambda p: F.trim(p, F.lit("_."))), lambda p: p != ""), "_")


def mask_markup(source: str) -> tuple[str, str | None]:
    """FN49: a component with all but its scripts blanked, and the scripts' language."""
    keep = [False] * len(source)
    lang = None
    for m in re.finditer(r"(?is)<script\b([^>]*)>(.*?)</script\s*>", source):
        for i in range(m.start(2), m.end(2)):
            keep[i] = True
        named = re.search(r"""\blang\s*=\s*["']?(\w+)""", m[1])
        lang = lang or (named[1].lower() if named else None)
    return "".join(c if k or c in "\r\n" else " " * len(c.encode()) for c, k in zip(source, keep)), lang
