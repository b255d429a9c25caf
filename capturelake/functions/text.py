"""Names, paths, URLs and tokens, as column expressions."""

from __future__ import annotations

import os
import re
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Longest names and notes; a feedback target is measured in bytes.
MAX_TAG, MAX_COLLECTION, MAX_NOTE, MAX_TARGET = 64, 120, 10_000, 240
# File extensions that are images, and device names that no file may have.
IMAGE_EXTENSIONS = ("png", "jpg", "jpeg", "gif", "bmp", "webp", "tif", "tiff", "avif")
RESERVED_NAMES = ("CON", "PRN", "AUX", "NUL", *(f"COM{i}" for i in range(1, 10)), *(f"LPT{i}" for i in range(1, 10)))

_ACCENTED = [c for c in map(chr, [*range(0xC0, 0x250), *range(0x1E00, 0x1F00)]) if unicodedata.normalize("NFD", c)[0].isascii() and unicodedata.normalize("NFD", c) != c]
_MARKS = "".join(map(chr, range(0x300, 0x370)))
_PLAIN = [unicodedata.normalize("NFD", c)[0] for c in _ACCENTED]


def capped_name(name: str, most: int, what: str) -> str:
    """A name that a user gave, trimmed and cut to ``most`` characters; an empty one is an error."""
    name = name.strip()[:most]
    if not name:
        raise ValueError(f"a {what} needs a name")
    return name


def is_image(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([^./\\]+)$", 1)).isin(*IMAGE_EXTENSIONS)


def extension(name: Column) -> Column:
    """From the last dot on, if that isn't the first character; else empty."""
    return F.regexp_extract(name, r"^.+(\.[^.]*)$", 1)


def stem(name: Column) -> Column:
    return F.substring(name, F.lit(1), F.length(name) - F.length(extension(name)))


def filename(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*)$", 1)


def parent(path: Column) -> Column:
    return F.regexp_replace(path, r"/[^/]*$", "")


def normalize_path(path: str) -> str:
    """Absolute and without ``.`` and ``..``, by text alone."""
    out = os.path.normpath(os.path.join(os.getcwd(), path))
    return "/" + out.lstrip("/")


def fold_accents(text: Column) -> Column:
    """Latin letters without their marks, in one character or as combining ones."""
    return F.translate(text, "".join(_ACCENTED) + _MARKS, "".join(_PLAIN))  # marks have no counterpart, so they go


def tokens(text: Column) -> Column:
    """Lower-case words of letters and digits, without marks; an empty array for null."""
    lower = F.lower(F.coalesce(text, F.lit("")))
    words = F.split(lower, r"[^\p{L}\p{N}\x{300}-\x{36F}]+")
    beyond = r"[^\x00-\x7F]"  # translating goes letter by letter: only for words that need it
    plain = F.transform(words, lambda w: F.when(w.rlike(beyond), fold_accents(w)).otherwise(w))
    return F.array_remove(F.when(lower.rlike(beyond), plain).otherwise(words), "")


def fold_term(term: str) -> str:
    """A word as :func:`tokens` would have it."""
    return "".join(_PLAIN[_ACCENTED.index(c)] if c in _ACCENTED else c for c in term.lower() if c not in _MARKS)


_URL_STOP = r"\s<>\"'()\[\]{}"


def _url_of(text: Column, scheme: str) -> tuple[Column, Column]:
    """URL and domain at the first mention of a scheme; null if its host has no dot."""
    rest = F.regexp_extract(text, rf"(?s)^.*?{scheme}([^{_URL_STOP}]*)", 1)
    host = F.regexp_replace(F.regexp_extract(rest, r"^([^/]*)", 1), r"^www\.", "")
    ok = F.contains(text, F.lit(scheme)) & F.contains(host, F.lit("."))
    return F.when(ok, F.concat(F.lit(scheme), rest)), F.when(ok, F.lower(host))


def url_and_domain(text: Column) -> tuple[Column, Column]:
    """The first https URL, else the first http one; else a ``www.`` mention gives a domain alone."""
    (u1, d1), (u2, d2) = _url_of(text, "https://"), _url_of(text, "http://")
    www = F.regexp_extract(F.lower(text), r"(www\.[a-z0-9-]*\.[a-z0-9.-]*)", 1)
    return F.coalesce(u1, u2), F.coalesce(d1, d2, F.when(F.length(www) > 0, www))


def escape_like(text: str) -> str:
    """User text for ``ilike`` where a backslash is a plain character."""
    return text.replace("\\", "\\\\")


#: White space as scripts of web pages have it.
_SPACE = r"[\s\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}]"


def display_name(name: Column) -> Column:
    """A capture's file name in lists: without a leading "Screenshot from ", else as it is."""
    return F.regexp_replace(name, r"(?i)^screenshot from ", "")


def plain_title(name: Column) -> Column:
    """A proposal's name without its count and trimmed; the name as it is if nothing is left."""
    rest = F.regexp_replace(F.regexp_replace(name, rf"{_SPACE}·{_SPACE}[0-9]+\z", ""), rf"^{_SPACE}+|{_SPACE}+\z", "")
    return F.when(rest == "", name).otherwise(rest)


def sanitize_term(word: str) -> str:
    return "".join(c for c in word if c.isalnum()).lower()


def safe_basename(name: Column) -> Column:
    """A base name that every file system takes; empty if nothing is left."""
    clean = F.regexp_replace(name, r"[\x00-\x1f\x7f-\x9f<>:\"/\\|?*]", "_")
    clean = F.regexp_replace(clean, r"[ .]+$", "")
    first = F.upper(F.regexp_extract(clean, r"^([^.]*)", 1))
    marked = F.when(extension(clean) != "", F.concat(stem(clean), F.lit("_"), extension(clean))).otherwise(F.concat(clean, F.lit("_")))
    return F.when(first.isin(*RESERVED_NAMES), marked).otherwise(clean)


#: Variables that a naming pattern may have.
TEMPLATE_VARS = ("counter", "date", "time", "year", "month", "day", "original", "collection", "source")


def parse_template(pattern: str) -> list[tuple[str, str]]:
    """('text', ...) and ('var', ...) parts of a naming pattern; unknown or unclosed variables are errors."""
    if not pattern.strip():
        raise ValueError("a naming pattern must not be empty")
    parts, at = [], 0
    for m in re.finditer(r"\{([^}]*)(\}?)", pattern):
        if m.start() > at:
            parts.append(("text", pattern[at : m.start()]))
        if not m[2]:
            raise ValueError("a {variable} of the naming pattern isn't closed")
        if m[1] not in TEMPLATE_VARS:
            raise ValueError(f"unknown variable {m[1]!r}; there are {', '.join(TEMPLATE_VARS)}")
        parts.append(("var", m[1]))
        at = m.end()
    if at < len(pattern):
        parts.append(("text", pattern[at:]))
    return parts


def render_template(pattern: str, counter: Column, padding: int, ts: Column, original: Column, collection: Column, source: Column) -> Column:
    """Base names by a pattern; dates are UTC."""
    width = min(6, max(1, padding))
    digits = counter.cast("string")
    day = F.to_date(F.timestamp_seconds(F.lit(0))) if ts is None else F.date_from_unix_date(F.floor(ts / 86400).cast("int"))
    second = F.pmod(ts, F.lit(86400))
    values = {
        "counter": F.when(F.length(digits) < width, F.lpad(digits, width, "0")).otherwise(digits),
        "date": F.date_format(day, "yyyy-MM-dd"),
        "time": F.format_string("%02d-%02d", F.floor(second / 3600), F.floor(F.pmod(second, F.lit(3600)) / 60)),
        "year": F.date_format(day, "yyyy"),
        "month": F.date_format(day, "MM"),
        "day": F.date_format(day, "dd"),
        "original": original,
        "collection": F.coalesce(collection, F.lit("")),
        "source": F.coalesce(source, F.lit("")),
    }
    return F.concat(*(values[v] if k == "var" else F.lit(v) for k, v in parse_template(pattern)))
