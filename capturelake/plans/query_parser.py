"""The search language: words, quoted phrases, ``key:value`` filters and dates.

Pure Python, with the clock as a parameter; see :func:`parse`.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from datetime import date, timedelta

from capturelake.functions.text import fold_term, normalize_path, sanitize_term

DAY = 86_400
_EPOCH = date(1970, 1, 1).toordinal()
_MONTHS = ("january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december")


@dataclass(frozen=True)
class Filter:
    """kind: after, before, app, site, tag, collection, dir, format, has_text, duplicate, starred."""

    kind: str
    value: object


@dataclass
class ParsedQuery:
    raw: str
    terms: list[str] = field(default_factory=list)
    phrases: list[str] = field(default_factory=list)
    adjacency: list[str] = field(default_factory=list)
    filters: list[Filter] = field(default_factory=list)

    @property
    def units(self) -> list[list[str]]:
        """Token sequences that all must occur: each word, then each phrase."""
        out = [[fold_term(t)] for t in self.terms]
        for p in self.phrases:
            words = [w for w in (fold_term(sanitize_term(x)) for x in p.split()) if w]
            if words:
                out.append(words)
        return out

    @property
    def match_expr(self) -> str | None:
        phrases = [" ".join(w for w in map(sanitize_term, p.split()) if w) for p in self.phrases]
        parts = [f'"{x}"' for x in (*self.terms, *phrases) if x]
        return " ".join(parts) or None

    @property
    def boost_phrase(self) -> str | None:
        """What is worth a boost where the text has it: the first phrase, else the first two words that stand together."""
        return next(iter(self.phrases or self.adjacency), None)


def tokenize(text: str) -> list[tuple[str, ...]]:
    """('word', w), ('phrase', p) and ('pair', key, value) in order. Quotes inside a word are taken off."""
    out, i, n = [], 0, len(text)
    while i < n:
        if text[i].isspace():
            i += 1
        elif text[i] in "\"'":
            end = text.find(text[i], i + 1)
            end = n if end < 0 else end
            out.append(("phrase", text[i + 1 : end]))
            i = end + 1
        else:
            word = []
            while i < n and not text[i].isspace():
                if text[i] in "\"'":
                    end = text.find(text[i], i + 1)
                    end = n if end < 0 else end
                    word.append(text[i + 1 : end])
                    i = end + 1
                else:
                    word.append(text[i])
                    i += 1
            key, colon, value = "".join(word).partition(":")
            out.append(("pair", key, value) if colon else ("word", key))
    return out


def days_from_civil(y: int, m: int, d: int) -> int:
    """Days since 1970; a day beyond the month's end goes on into the next month."""
    return date(y, m, 1).toordinal() - _EPOCH + d - 1


def parse_iso_date(text: str) -> int | None:
    """Days since 1970 of year-month-day; parts after the third are ignored."""
    try:
        y, m, d = (int(x) for x in text.strip().split("-")[:3])
        return days_from_civil(y, m, d) if 1 <= m <= 12 and 1 <= d <= 31 else None
    except (ValueError, OverflowError):
        return None


def month_number(word: str) -> int | None:
    w = word.rstrip(".").lower()
    for i, name in enumerate(_MONTHS, 1):
        if w in (name, name[:3]) or (w, i) == ("sept", 9):
            return i
    return None


def _month(y: int, m: int) -> tuple[int, int]:
    ny, nm = (y + 1, 1) if m == 12 else (y, m + 1)
    return days_from_civil(y, m, 1) * DAY, days_from_civil(ny, nm, 1) * DAY


def _date_pair(first: str, second: str, today: date) -> tuple[int, int] | None:
    days = today.toordinal() - _EPOCH
    if first in ("in", "from"):
        m = month_number(second)
        return m and _month(today.year - (m > today.month), m)
    if first not in ("last", "this"):
        return None
    ago = int(first == "last")
    if second in ("week", "wk"):
        return (days - 7 * (ago + 1) + 1) * DAY, (days - 7 * ago + 1) * DAY
    if second == "month":
        then = today - timedelta(days=30 * ago)
        return _month(then.year, then.month)
    if second == "year":
        y = (today - timedelta(days=365 * ago)).year
        return days_from_civil(y, 1, 1) * DAY, days_from_civil(y + 1, 1, 1) * DAY
    return None


_TEXT_KEYS = {"app": "app", "application": "app", "site": "site", "domain": "site", "url": "site", "tag": "tag", "collection": "collection", "type": "format", "format": "format"}
_FLAGS = {
    "has": {"text": ("has_text", True), "ocr": ("has_text", True), "notext": ("has_text", False), "no-text": ("has_text", False)},
    "is": {"duplicate": ("duplicate", True), "dup": ("duplicate", True), "starred": ("starred", True), "star": ("starred", True), "unstarred": ("starred", False), "notstarred": ("starred", False)},
}


def _filter(key: str, value: str) -> Filter | None:
    key = key.lower()
    if key in ("after", "since", "before", "until"):
        d = parse_iso_date(value)
        return None if d is None else Filter("after" if key in ("after", "since") else "before", d * DAY)
    if key in ("dir", "folder", "path"):
        return Filter("dir", normalize_path(value))
    if key in _TEXT_KEYS:
        return Filter(_TEXT_KEYS[key], value)
    found = _FLAGS.get(key, {}).get(value.lower())
    return found and Filter(*found)


def parse(text: str, now: int) -> ParsedQuery:
    """A query at the time ``now``, in seconds since 1970 (UTC)."""
    today = date.fromordinal(now // DAY + _EPOCH)
    found, out, before, i = tokenize(text), ParsedQuery(text), None, 0
    while i < len(found):
        kind, *rest = found[i]
        if kind == "word":
            word = rest[0]
            pair = found[i + 1][1] if i + 1 < len(found) and found[i + 1][0] == "word" else None
            span = pair and _date_pair(word.lower(), pair.lower(), today)
            if span:
                i += 1
            elif word.lower() in ("today", "yesterday"):
                start = now // DAY * DAY
                span = (start, None) if word.lower() == "today" else (start - DAY, start)
            if span:
                out.filters += [Filter(k, v) for k, v in zip(("after", "before"), span, strict=True) if v is not None]
                before = None
            elif term := sanitize_term(word):
                if before:
                    out.adjacency.append(f"{before} {term}")
                before = term
                out.terms.append(term)
        else:
            before = None
            if kind == "phrase" and rest[0].strip():
                out.phrases.append(rest[0].strip())
            elif kind == "pair" and rest[1].strip():
                f = _filter(rest[0], rest[1].strip())
                if f:
                    out.filters.append(f)
                elif term := sanitize_term(f"{rest[0]} {rest[1]}"):
                    out.terms.append(term)
        i += 1
    return out


def complete(text: str, tags: list[str], collections: list[str], recent: list[str]) -> list[str]:
    """What the last word of a query may become: values of its key, keys, or recent queries."""
    tail = text.rsplit(None, 1)[-1] if text and not text[-1].isspace() else ""
    key, colon, value = tail.partition(":")
    choices = {"tag": (tags, 6), "collection": (collections, 6), "is": (["duplicate", "starred", "unstarred"], 5), "has": (["text", "notext"], 5)}
    if colon and key.lower() in choices:
        names, most = choices[key.lower()]
        return [f'{key}:"{n}"' if " " in n else f"{key}:{n}" for n in names if n.lower().startswith(value.lower())][:most]
    keys = [f"{k}:" for k in ("after", "before", "app", "site", "tag", "collection", "dir", "type", "has", "is")]
    return [k for k in keys if tail and k.startswith(tail.lower())][:8] or [r for r in recent if r.lower().startswith(text.lower())][:8]
