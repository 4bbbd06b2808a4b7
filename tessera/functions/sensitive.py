"""Keys and values that look like secrets, and signals of scientific papers."""

from __future__ import annotations

import base64
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Keys by their letters and digits, endings of keys, and beginnings of vendors' tokens.
HARMLESS = frozenset("publictoken paginationtoken continuationtoken pagetoken nextpagetoken publickey".split())
SECRET = frozenset(
    "authorization proxyauthorization password passwords passwd passphrase pwd secret secrets token tokens credential credentials cookie cookies setcookie connectionstring databaseurl dsn awssecretaccesskey awsaccesskeyid secretaccesskey accesskeyid".split()
)
SECRET_ENDS = tuple("password passwd passphrase secret token apikey privatekey secretkey secretaccesskey credential credentials connectionstring".split())
TOKENS = tuple("ghp_ github_pat_ glpat- xoxb- xoxp- sk-proj- sk-live- sk_live_ sk_test_ rk_live_ rk_test_".split())
PAPER_SIGNALS = (
    r"(?i)\barxiv\b", r"(?i)\bdoi\s*:", r"(?i)\babstract\b", r"(?i)\bproceedings\b", r"(?i)\bjournal\b", r"(?i)\bpreprint\b", r"\\cite\{", r"\[\d+\]",
    r"(?i)eq\.\s*\d+|equation\s+\d+", r"\d{4}\.\d{4,5}", r"(?i)\bwe propose\b", r"(?i)\bliterature\b",
)


def key_is_sensitive(key: str) -> bool:
    """FLT17: whether a key names a secret."""
    name = re.sub(r"[^A-Za-z0-9]", "", key).lower()
    return bool(name) and name not in HARMLESS and (name in SECRET or name.endswith(SECRET_ENDS))


def _basic(value: str) -> bool:
    if not re.fullmatch(r"[\w\-.~+/=]{4,}", value, re.A):
        return False
    try:
        return b":" in base64.b64decode(value + "=" * (-len(value) % 4), validate=True)
    except ValueError:
        return False


def line_is_sensitive(line: str) -> bool:
    """FLT18: whether a line is or assigns a secret."""
    s = line.strip()
    if not s:
        return False
    if s.startswith("-----BEGIN ") and "PRIVATE KEY-----" in s:
        return True
    if m := re.match(r"(?i)(bearer|basic) (.*)", s):
        if m[1].lower() == "bearer" and re.fullmatch(r"[\w\-.~+/=]{16,}", m[2], re.A) or m[1].lower() == "basic" and _basic(m[2]):
            return True
    if re.fullmatch(r"eyJ[\w-]*\.[\w-]+\.[\w-]+", s, re.A) or re.fullmatch(r"A[KS]IA[A-Z0-9]{16}", s):
        return True
    if any(s.startswith(t) and len(s) >= len(t) + 8 for t in TOKENS):
        return True
    if m := re.match(r"(?i)https?://([^/?#]*)@", s):
        user, colon, password = m[1].partition(":")
        if colon and (user or password) or line_is_sensitive(m[1]):
            return True
    s = re.sub(r"(?i)^export ", "", s)
    m = re.match(r"([^=:]*)[=:](.*)", s, re.S)
    return bool(m and m[2].strip() and (key_is_sensitive(m[1].strip()) or m[1].strip().lower() == "auth"))


def value_is_sensitive(value: str) -> bool:
    return any(map(line_is_sensitive, value.splitlines()))


def assigned_secret(line: Column) -> Column:
    """Whether a line assigns a value to a key that names a secret, as a built-in expression."""
    trimmed = F.regexp_replace(F.trim(line), r"(?i)^export ", "")
    key = F.lower(F.regexp_replace(F.regexp_extract(trimmed, r"^([^=:]*)[=:]", 1), "[^A-Za-z0-9]", ""))
    value = F.trim(F.regexp_extract(trimmed, r"^[^=:]*[=:](.*)$", 1))
    named = key.isin(*sorted(SECRET)) | key.rlike("(" + "|".join(SECRET_ENDS) + ")$") | (key == "auth")
    return (key != "") & ~key.isin(*sorted(HARMLESS)) & named & (value != "")


def paper_signals(text: Column) -> Column:
    """SRC9: how many signals of a paper a text has; three make one."""
    hits = [F.coalesce(text.rlike(p), F.lit(False)).cast("long") for p in PAPER_SIGNALS]
    return sum(hits[1:], hits[0])
