"""Paths, ids and dates of nodes, as built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Where facts come from; what is in neither list is unknown.
STRUCTURAL_ORIGINS = ("ast", "fallback", "terraform", "sql", "dotnet", "scip", "diagram", "pdf", "document_package")
OTHER_ORIGINS = ("semantic", "enrichment")


def slashes(path: Column) -> Column:
    return F.replace(path, F.lit("\\"), F.lit("/"))


def stem(path: Column) -> Column:
    """FN31: the path without the extension of its last part; a leading dot begins no extension."""
    return F.regexp_replace(slashes(path), r"(?<=[^/])\.[^./]*$", "")


def relative(path: Column, root: str) -> Column:
    """FN32: the path below root, with slashes; others as they are."""
    clean = slashes(path)
    head = root.replace("\\", "/").rstrip("/") + "/"
    return F.when(F.startswith(clean, F.lit(head)), F.substr(clean, F.lit(len(head) + 1))).otherwise(clean)


def path_key(path: Column) -> Column:
    """FN51: slashes, no leading ./, lower case."""
    return F.lower(F.regexp_replace(slashes(path), r"^(\./)+", ""))


def bare_name(label: Column) -> Column:
    """FN35: a normalized label without one () at its end."""
    return F.regexp_replace(F.lower(label), r"\(\)$", "")


def canonical_key(key: Column) -> Column:
    """FN46: letters and digits in lower case; null if none is left."""
    return F.nullif(F.lower(F.regexp_replace(key, "[^A-Za-z0-9]", "")), F.lit(""))


def id_prefixes(path: Column) -> Column:
    """FN20: the slugs of all ends of the path without its extension."""
    parts = F.split(F.regexp_replace(slashes(path), r"\.[^./]*$", ""), "/")
    slugs = F.filter(F.transform(parts, lambda p: F.trim(F.regexp_replace(F.lower(p), "[^a-z0-9]+", "_"), F.lit("_"))), lambda p: p != "")
    n = F.size(slugs)
    return F.when(n > 0, F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda k: F.array_join(F.slice(slugs, k, n), "_"))).otherwise(F.array().cast("array<string>"))


def defines_id(id_: Column, path: Column) -> Column:
    """FN21: the id is one of the path's prefixes or goes on after one with an underscore."""
    return (id_ != "") & (path != "") & F.exists(id_prefixes(path), lambda p: (id_ == p) | F.startswith(id_, F.concat(p, F.lit("_"))))


def is_structural(origin: Column) -> Column:
    """FLT9: true, false, or null where the origin isn't known."""
    return F.when(origin.isin(*STRUCTURAL_ORIGINS), True).when(origin.isin(*OTHER_ORIGINS), False)


def path_match(a: Column, b: Column) -> Column:
    """FLT11: equal, or one ends with the other after a slash."""
    x, y = slashes(a), slashes(b)
    return (x == y) | F.endswith(x, F.concat(F.lit("/"), y)) | F.endswith(y, F.concat(F.lit("/"), x))


def is_media(file_type: Column, kind: Column, form: Column, origin: Column) -> Column:
    """FLT12: an inventory row of a media file that no enrichment made."""
    media = kind.isin("media", "format_inventory") | form.isin("media", "additional-media") | (file_type == "video")
    return F.coalesce(media, F.lit(False)) & ~F.coalesce(origin == "enrichment", F.lit(False))


def is_remote(source: Column) -> Column:
    """FLT13: a scheme of two letters or more before the first colon, and a slash behind it."""
    return F.rlike(source, F.lit("^[A-Za-z][A-Za-z0-9+.-]+:/"))


def parse_date(text: Column) -> Column:
    """FN37: a timestamp with its offset, or a day at midnight UTC; null for all else."""
    full = F.when(F.rlike(text, F.lit(r"^\d{4}-\d\d-\d\d[Tt ]\d\d:\d\d:\d\d(\.\d+)?([Zz]|[+-]\d\d:\d\d)$")), F.upper(text).try_cast("timestamp"))
    day = F.when(F.rlike(text, F.lit(r"^\d{4}-\d{1,2}-\d{1,2}$")), F.to_utc_timestamp(text.try_cast("date").cast("timestamp"), F.current_timezone()))
    return F.coalesce(full, day)


def rounded_score(score: Column) -> Column:
    """FN38: to nine places."""
    return F.round(score, 9)


def days_old(seconds: Column, now: Column) -> Column:
    """FN39: whole days from one epoch second to another, none if it lies ahead."""
    return F.greatest(F.floor((now - seconds) / 86400), F.lit(0)).cast("long")


def body_content(text: Column) -> Column:
    """FN54: a Markdown text without the front matter between --- lines at its start."""
    return F.regexp_replace(text, r"\A---[ \t]*\r?\n(?s:.*?)\r?\n---[ \t]*(\r?\n|\z)", "")


def content_hash(path: Column, text: Column) -> Column:
    """FN53: SHA-256 of a file's body and path; front matter of Markdown doesn't count."""
    body = F.when(F.endswith(F.lower(path), F.lit(".md")), body_content(text)).otherwise(text)
    return F.sha2(F.concat(body, F.lit("\0"), path_key(path)), 256)


def prompt_fingerprint(prompt: Column) -> Column:
    """FN52: SHA-256 of a prompt without trailing white space on its lines."""
    return F.sha2(F.regexp_replace(F.replace(prompt, F.lit("\r\n"), F.lit("\n")), r"[ \t]+(?=\n|$)", ""), 256)


def enrichment_id(readable: Column, source: Column, profile: Column, salt: str) -> Column:
    """FN61: the readable id with the first 12 bytes of a digest of a salt, source and profile."""
    digest = F.sha2(F.concat(F.lit(salt + "\0"), source, F.lit("\0"), profile), 256)
    return F.concat(readable, F.lit("_"), F.substring(digest, 1, 24))


def elapsed(milliseconds: Column) -> Column:
    """FN63: milliseconds below a second, else seconds, minutes and hours."""
    ms = milliseconds.cast("long")
    s = F.floor(ms / 1000)
    return (
        F.when(ms < 1000, F.concat(ms.cast("string"), F.lit("ms"))).when(s < 60, F.format_string("%.1fs", ms / 1000))
        .when(s < 3600, F.format_string("%dm %02ds", F.floor(s / 60), s % 60)).otherwise(F.format_string("%dh %02dm", F.floor(s / 3600), F.floor(s / 60) % 60))
    )
