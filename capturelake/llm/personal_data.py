"""Personal data in texts, by weak supervision.

Candidates are spans of six kinds: what the four base patterns match, looser forms of
e-mail addresses and phone numbers, bank accounts, and secrets (keys, tokens, passwords). Five labelers vote on each one yes, no or
abstain: the strict pattern, a structure test (checksum, ranges, digits, entropy), a
gazetteer (top-level domains, card prefixes, calling codes, prefixes of keys, ...), words
before the span, and its neighbours. How often each combination of votes occurs is counted
over all documents; expectation-maximisation on those counts estimates how
reliable each labeler is and how likely each kind, and gives every combination a probability. A
logistic regression on votes and shape, fitted to these probabilities over all counted
combinations, is the final classifier. The combinations are few whatever the corpus, so
only counts reach the driver; texts are read once.

Base spans (patterns ``email``, ``ip``, ``card``, ``phone`` that pass their tests) always
stay. The classifier adds candidates it gives ``ACCEPT`` or more that overlap no base span, whose
structure isn't refuted and that pattern, gazetteer or context speaks for. Names of persons are no kind: without a full gazetteer they can't be told from other words.

All searches take time in proportion to the text, whatever it holds.

Nulls and odd input: a null or empty text has no spans. Equal texts have equal
spans, repeated rows stay. A text of any length is searched whole. Other columns are ignored,
whatever their names. Empty tables give no rows. Offsets are code points, ends
exclusive.
"""

from __future__ import annotations

import bisect
import hashlib
import json
import math
import re
from collections import Counter

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from capturelake.llm.common import add_from_text, written

KINDS = ("email", "ip", "card", "phone", "iban", "secret")
#: Probability from which the classifier adds a span.
ACCEPT = 0.9
YES, NO, ABSTAIN = "y", "n", "-"

# What the gazetteers know.
TOP_DOMAINS = frozenset("com org net edu gov mil int info biz io co ai app dev de fr es it uk us ca au ch at nl be se no dk fi pl pt br mx ar cl jp cn kr in ru eu nz ie za".split())
CARD_PREFIXES = ("4", "51", "52", "53", "54", "55", "34", "37", "6011", "65", "35", "36", "30", "38")
CALLING_CODES = ("1", "7", "20", "27", "30", "31", "32", "33", "34", "36", "39", "40", "41", "43", "44", "45", "46", "47", "48", "49", "51", "52", "54", "55", "56", "57", "60", "61", "62", "63", "64", "65", "66", "81", "82", "84", "86", "90", "91", "92", "94", "98")
IBAN_LENGTHS = {"AT": 20, "BE": 16, "CH": 21, "DE": 22, "DK": 18, "ES": 24, "FI": 18, "FR": 27, "GB": 22, "IE": 22, "IT": 27, "LU": 20, "NL": 18, "NO": 15, "PL": 28, "PT": 25, "SE": 24}
SECRET_PREFIXES = ("AKIA", "ASIA", "ghp_", "gho_", "ghs_", "github_pat_", "glpat-", "xoxb-", "xoxp-", "xoxa-", "AIza", "sk_live_", "rk_live_", "sk-", "eyJ", "npm_", "pypi-")
BEFORE = {
    "email": "email e-mail mail contact write reach correo courriel kontakt",
    "ip": "ip address host server from adresse dirección",
    "card": "card visa mastercard credit debit amex cc karte carte tarjeta",
    "phone": "phone tel telephone call mobile cell fax telefon téléphone teléfono",
    "iban": "iban account konto compte cuenta",
    "secret": "token secret password passwd passphrase pwd key apikey api_key access_key secret_key private_key credential credentials auth authorization bearer passwort kennwort contraseña",
}
AGAINST = frozenset("version ver build release isbn issn order invoice page section chapter ref id no serial sku commit sha sha1 sha256 md5 hash checksum digest etag uuid rev revision".split())

_BEFORE = {k: frozenset(v.split()) for k, v in BEFORE.items()}
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_LOCAL = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_OBFUSCATED = re.compile(r"(?<![\w.-])[\w.-]{1,64}+ ?[\[(]at[\])] ?[\w-]{1,63}(?: ?(?:\.|[\[(]dot[\])]) ?[\w-]{1,63}){1,4}", re.ASCII)
_LOCAL_PHONE = re.compile(r"(?<![\w+.])(?:\([0-9]{2,5}\) ?|[0-9]{2,5}[ /-])[0-9]{2,5}[ -][0-9]{2,6}(?![\w])")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")
_SECRET = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_-]{16,}+={0,2}(?![A-Za-z0-9+/_=-])")
_LETTER = re.compile(r"[A-Za-z]")
_KEY = re.compile(r"(?:AKIA|ASIA)[A-Z0-9]{16}|gh[pos]_[A-Za-z0-9]{36}|AIza[A-Za-z0-9_-]{35}|(?:sk|rk)_live_[A-Za-z0-9]{24,}|xox[abp]-[A-Za-z0-9-]{20,}|glpat-[A-Za-z0-9_-]{20}")
_WORD = re.compile(r"\w+")
#: What stands before an assigned value.
_ASSIGNED = re.compile(r"[=:] ?[\"'`]?\Z")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def _digits(s: str) -> str:
    return "".join(c for c in s if c in "0123456789")


def _emails(text: str) -> list[tuple[int, int]]:
    """Leftmost matches of the e-mail pattern, found from each @ outward."""
    out, last, at = [], 0, text.find("@")
    while at >= 0:
        begin = at
        while begin > last and text[begin - 1] in _LOCAL:
            begin -= 1
        m = _DOMAIN.match(text, at + 1) if begin < at else None
        if m:
            out.append((begin, last := m.end()))
        at = text.find("@", max(at + 1, last))
    return out


def _in_range(s: str) -> bool:
    return all(len(p := x.lstrip("0")) <= 3 and int(p or "0") <= 255 for x in s.split("."))


def matches(text: str) -> list[tuple[str, int, int, bool]]:
    """(kind, start, end, passes) of every match of the four base patterns."""
    out = [("email", a, b, True) for a, b in _emails(text)]
    for m in _IP.finditer(text):
        out.append(("ip", *m.span(), _in_range(m.group())))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 13:
            d = _digits(m.group())
            out.append(("card", *m.span(), 13 <= len(d) <= 19 and luhn(d)))
    for m in _PHONE.finditer(text):
        out.append(("phone", *m.span(), 9 <= len(_digits(m.group())) <= 15))
    return out


def _loose(text: str) -> list[tuple[str, int, int]]:
    """Candidates beyond the base patterns."""
    out = []
    if "at]" in text or "at)" in text:
        out += [("email", *m.span()) for m in _OBFUSCATED.finditer(text)]
    out += [("phone", *m.span()) for m in _LOCAL_PHONE.finditer(text)]
    out += [("iban", *m.span()) for m in _IBAN.finditer(text)]
    out += [("secret", *m.span()) for m in _SECRET.finditer(text) if _DIGIT.search(s := m.group()) and _LETTER.search(s)]
    return out


def _iban_ok(s: str) -> bool:
    s = s.replace(" ", "")
    return IBAN_LENGTHS.get(s[:2]) == len(s) and int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def entropy(s: str) -> float:
    """Bits a character of a string's own distribution."""
    return -sum(n / len(s) * math.log2(n / len(s)) for n in Counter(s).values())


def votes(kind: str, text: str, start: int, end: int, strict: bool) -> str:
    """One letter for each labeler: pattern, structure, gazetteer, context, neighbours."""
    s = text[start:end]
    d = _digits(s)
    pattern = YES if strict else ABSTAIN
    if kind == "email":
        structure = YES if strict and not s.startswith(".") and ".." not in s else ABSTAIN
        gazetteer = YES if re.split(r"[\W_]+", s)[-1].lower() in TOP_DOMAINS else NO
    elif kind == "ip":
        structure, gazetteer = YES if _in_range(s) else NO, NO if s.split(".")[0].lstrip("0") in ("", "255") else ABSTAIN
    elif kind == "card":
        structure, gazetteer = YES if 13 <= len(d) <= 19 and luhn(d) else NO, YES if d.startswith(CARD_PREFIXES) else NO
    elif kind == "phone":
        structure, gazetteer = YES if 9 <= len(d) <= 15 else NO, (YES if d.startswith(CALLING_CODES) else NO) if strict else ABSTAIN
    elif kind == "iban":
        structure, gazetteer = YES if _iban_ok(s) else NO, YES if s[:2] in IBAN_LENGTHS else NO
    else:
        pattern = YES if _KEY.fullmatch(s) else ABSTAIN
        structure = YES if entropy(s) >= 3 and max(map(len, re.split(r"[0-9_/+-]+", s))) < 16 else NO  # else words in a row
        gazetteer = YES if s.startswith(SECRET_PREFIXES) else ABSTAIN
    before = _WORD.findall(text[max(0, start - 40) : start].lower())[-4:]
    context = YES if _BEFORE[kind] & set(before) else NO if AGAINST & set(before[-2:]) else ABSTAIN
    left, right = text[start - 1 : start], text[end : end + 1]
    if kind == "secret":
        return pattern + structure + gazetteer + context + (YES if _ASSIGNED.search(text, max(0, start - 4), start) else ABSTAIN)
    joined = (left.isalnum() or left in ("-", "_", "/", "=", "#") and left) or (right.isalnum() or right in ("_", "=") and right)
    return pattern + structure + gazetteer + context + (NO if joined else YES)


def shape(text: str, start: int, end: int) -> str:
    """Length and share of digits, each in four steps, and whether the span has spaces."""
    s = text[start:end]
    n = len(s)
    return f"{min(3, n // 12)}{min(3, 4 * len(_digits(s)) // n)}{int(' ' in s)}"


SPAN = T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("base", T.BooleanType()), T.StructField("pattern", T.StringType())])
_DIGIT = re.compile(r"[0-9]")


def candidates(text: str | None) -> list[dict]:
    """All candidates of a text with what the labelers say of them, base spans among them."""
    if not text:
        return []
    digits, found = _DIGIT.search(text), []
    if digits or "@" in text:
        found = [(k, a, b, True, ok) for k, a, b, ok in matches(text)]
    if digits or "at]" in text or "at)" in text:
        taken = _merged([(a, b) for _, a, b, _, ok in found if ok])
        found += [(k, a, b, False, False) for k, a, b in _loose(text) if _is_free(taken, a, b)]
    # what fails a base pattern's test is still a candidate, for labelers to learn from
    return [{"kind": k, "start": a, "end": b, "base": ok, "pattern": f"{k}|{votes(k, text, a, b, strict)}|{shape(text, a, b)}"} for k, a, b, strict, ok in found]


def _no_worse_than_chance(sure: np.ndarray) -> np.ndarray:
    """Chances (truth, labeler) of a yes: where a labeler says yes no more often of personal data than of the rest, it says nothing."""
    wrong = sure[1] < sure[0]
    return np.where(wrong, sure.mean(axis=0), sure)


def estimate(counts: dict[str, int], rounds: int = 50) -> dict[tuple[str, str], float]:
    """Probability that a candidate is personal data for each (kind, votes), by EM.

    Labelers are independent given the truth. Each has, for either truth, a chance to say yes where it doesn't
    abstain, shared by all kinds; whether it abstains depends on the kind and says nothing of the truth. Each kind has its own
    prior. A labeler is never worse than chance, or the two truths could change places. Starts from the
    majority of votes, smoothed by one pseudo-count.
    """
    tally: dict[tuple[str, str], int] = {}
    for pattern, n in counts.items():
        kind, v, _ = pattern.split("|")
        tally[kind, v] = tally.get((kind, v), 0) + n
    if not tally:
        return {}
    keys = sorted(tally)
    n = np.array([tally[k] for k in keys], dtype=np.float64)
    yes = np.array([[c == YES for c in k[1]] for k in keys], dtype=np.float64)
    no = np.array([[c == NO for c in k[1]] for k in keys], dtype=np.float64)
    kinds = np.array([KINDS.index(k[0]) for k in keys])
    p = (yes.sum(axis=1) + 0.5) / (yes.sum(axis=1) + no.sum(axis=1) + 1)
    for _ in range(rounds):
        sure = np.array([(1 + w @ yes) / (2 + w @ (yes + no)) for w in (n * (1 - p), n * p)])
        sure = _no_worse_than_chance(sure)
        prior = np.array([(1 + (n * p)[kinds == k].sum()) / (2 + n[kinds == k].sum()) for k in range(len(KINDS))])[kinds]
        odds = np.log(prior) - np.log1p(-prior) + yes @ np.log(sure[1] / sure[0]) + no @ np.log((1 - sure[1]) / (1 - sure[0]))
        p = 1 / (1 + np.exp(-np.clip(odds, -30, 30)))
    return dict(zip(keys, p.tolist(), strict=True))


def _features(pattern: str) -> np.ndarray:
    kind, v, s = pattern.split("|")
    x = [1.0, *(kind == k for k in KINDS)]
    for c in v:
        x += [c == YES, c == NO]
    for i, steps in enumerate((4, 4, 2)):
        x += [int(s[i]) == k for k in range(1, steps)]
    return np.array(x, dtype=np.float64)


def train(counts: dict[str, int], steps: int = 30, ridge: float = 1.0) -> dict[str, float]:
    """The classifier's probability for each counted pattern: logistic regression with the
    estimated probabilities as soft labels and counts as weights, by Newton's method."""
    soft = estimate(counts)
    if not soft:
        return {}
    keys = sorted(counts)
    x = np.array([_features(k) for k in keys])
    y = np.array([soft[tuple(k.split("|")[:2])] for k in keys])
    n = np.sqrt(np.array([counts[k] for k in keys], dtype=np.float64))  # rare patterns count too
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (n * (p - y)) + ridge * w
        hess = (x * (n * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ x + ridge * np.eye(len(w))
        w -= np.clip(np.linalg.solve(hess, grad), -4, 4)
    return dict(zip(keys, (1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))).tolist(), strict=True))


def _merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Disjoint spans in order that cover the same."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a < out[-1][1]:
            out[-1] = out[-1][0], max(b, out[-1][1])
        else:
            out.append((a, b))
    return out


def _is_free(taken: list[tuple[int, int]], start: int, end: int) -> bool:
    i = bisect.bisect_left(taken, (end, -1))  # all before i start before the span ends
    return i == 0 or taken[i - 1][1] <= start


def _vouched(v: str) -> bool:
    """Whether structure doesn't refute a span and pattern, gazetteer or context speaks for it: digits alone never do."""
    return v[1] != NO and YES in (v[0], v[2], v[3])


def choose(found: list[dict], chance: dict[str, float]) -> list[tuple[str, int, int]]:
    """Base spans and accepted others, by kind as listed, then start; the likelier first where others overlap."""
    out = [(s["kind"], s["start"], s["end"]) for s in found if s["base"]]
    more = [s for s in found if not s["base"] and chance.get(s["pattern"], 0) >= ACCEPT and _vouched(s["pattern"].split("|")[1])]
    if more:
        taken = _merged([(a, b) for _, a, b in out])
        for s in sorted(more, key=lambda s: (-chance[s["pattern"]], s["start"], s["end"])):
            if _is_free(taken, s["start"], s["end"]):
                bisect.insort(taken, (s["start"], s["end"]))
                out.append((s["kind"], s["start"], s["end"]))
    return sorted(out, key=lambda s: (KINDS.index(s[0]), s[1], s[2]))


def joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def find_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, dict[str, float]]:
    """A written table (doc_id, found: candidates) and the classifier fitted to all of it."""
    fields = [T.StructField("found", T.ArrayType(SPAN))]
    light = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    table = written(add_from_text(light, "text", fields, lambda: lambda texts: [[candidates(t) for t in texts]]).select("doc_id", "found"), "spans")
    counts = table.select(F.explode("found.pattern").alias("pattern")).groupBy("pattern").count()
    return table, train({r["pattern"]: r["count"] for r in counts.collect()})  # some thousand patterns at most


def personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_spans (all), n_added."""
    table, chance = find_spans(docs, id_col, text_col)
    held = docs.sparkSession.sparkContext.broadcast(chance)
    names = ["n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_spans", "n_added"]
    fields = [T.StructField(c, T.StringType() if c in ("base_sha256", "spans") else T.LongType()) for c in names]

    def make():
        def run(rows):
            out: list[list] = [[] for _ in names]
            for found in rows:
                base = choose([s for s in found if s["base"]], {})
                for i, kind in enumerate(KINDS[:4]):
                    out[i].append(sum(k == kind for k, _, _ in base))
                out[4].append(hashlib.sha256(joined(base).encode()).hexdigest())
                every = choose(found, held.value)
                out[5].append(joined(every))
                out[6].append(len(every))
                out[7].append(len(every) - len(base))
            return out

        return run

    return add_rows(table, fields, make).select("doc_id", *names)


def add_rows(table: DataFrame, fields: list[T.StructField], make) -> DataFrame:
    return add_from_text(table.select("doc_id", F.to_json("found").alias("found")), "found", fields, lambda: (lambda run: lambda rows: run([_read(r) for r in rows]))(make()))


def _read(found: str | None) -> list[dict]:
    return json.loads(found) if found else []
