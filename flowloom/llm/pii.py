"""Personal data by anchor expansion.

An Aho-Corasick automaton finds anchors in one pass over the text: at-signs,
plus signs, digits, address schemes and identifier cues. A small parser per kind
expands each anchor to its boundaries and validates what it found. Emails, IP
addresses, card and phone numbers come out exactly as the leftmost,
non-overlapping matches of the patterns below; addresses behind a scheme and
account numbers and secrets (keys, tokens, passwords) behind a cue are added as kinds
of their own. A cue stands in lower case, capitals or with a capital in front, and
not inside a word.

Offsets are code points, the end is exclusive. A null or empty text has no
spans. Repeated rows are searched each on its own. Other columns are kept.
"""

from __future__ import annotations

import functools
import hashlib
import re

import ahocorasick
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "url", "account", "secret")
SCHEMES = ("http://", "https://", "ftp://", "mailto:", "tel:")
CUES = ("iban", "account", "acct", "ssn", "passport", "konto", "compte", "cuenta")

SECRET_CUES = (
    "token", "secret", "password", "passwd", "api_key", "api-key", "api key", "apikey", "access_key", "access key",
    "private_key", "private key", "client_secret", "auth_key", "credential", "bearer",
)
#: Beginnings of keys that need no cue.
SECRET_HEADS = ("AKIA", "ghp_", "xoxb-", "xoxp-", "sk-")

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_DIGITS = re.compile(r"[0-9]+")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_ADDRESS = re.compile(r"[^\s<>\"']+")
_ACCOUNT = re.compile(r"(?:\s*+(?:number|no\.?|nr\.?|id))?\s*+[:#=]?\s*+([A-Z]{0,2}[0-9](?:[ -]?[A-Z0-9])+)")
_SECRET = re.compile(r"(?:[\"']?\s{0,4}[=:]\s{0,4}|\s{1,4})[\"']?([^\s\"'<>,;():=]+={0,2})")
_KEY = re.compile(r"[A-Za-z0-9+/_=.~-]+")
_TRAILING = ".,;:!?)]}"


def luhn(digits: str) -> bool:
    total = 0
    for place, digit in enumerate(reversed(digits)):
        value = ord(digit) - 48
        if place % 2:
            value = value * 2 - 9 if value > 4 else value * 2
        total += value
    return total % 10 == 0


def iban(code: str) -> bool:
    """Check digits of an international account number."""
    moved = code[4:] + code[:4]
    return int("".join(str(int(c, 36)) for c in moved)) % 97 == 1


def _digits(found: str) -> str:
    return "".join(c for c in found if "0" <= c <= "9")


@functools.cache
def anchors() -> ahocorasick.Automaton:
    automaton = ahocorasick.Automaton()
    automaton.add_word("@", ("email", 1))
    automaton.add_word("+", ("phone", 1))
    for digit in "0123456789":
        automaton.add_word(digit, ("digit", 1))
    for scheme in SCHEMES:
        for form in (scheme, scheme.upper(), scheme.capitalize()):
            automaton.add_word(form, ("url", len(form)))
    for cue in CUES:
        for form in (cue, cue.upper(), cue.capitalize()):
            automaton.add_word(form, ("account", len(form)))
    for cue in SECRET_CUES:
        for form in (cue, cue.upper(), cue.capitalize()):
            automaton.add_word(form, ("secret", len(form)))
    for head in SECRET_HEADS:
        automaton.add_word(head, ("head", len(head)))
    automaton.make_automaton()
    return automaton


def _email(text: str, at: int, free: int) -> tuple[int, int] | None:
    start = at
    while start > free and text[start - 1] in _LOCAL:
        start -= 1
    domain = _DOMAIN.match(text, at + 1) if start < at else None
    return (start, domain.end()) if domain else None


def _url(text: str, at: int) -> tuple[int, int] | None:
    end = _ADDRESS.match(text, at).end()
    while end > at and text[end - 1] in _TRAILING:
        end -= 1
    return at, end


def _account(text: str, after: int) -> tuple[int, int] | None:
    found = _ACCOUNT.match(text, after)
    if not found:
        return None
    code = re.sub("[ -]", "", found[1])
    if code[:2].isalpha():
        # The check digits decide where the number ends.
        for end in range(min(34, len(code)), 14, -1):
            if iban(code[:end]):
                seen = 0
                for place in range(found.start(1), found.end(1)):
                    seen += text[place] not in " -"
                    if seen == end:
                        return found.start(1), place + 1
        return None
    return found.span(1) if 6 <= sum(c.isdigit() for c in code) else None


def _random_looking(value: str, least: int) -> bool:
    """Long enough, with letters and digits, and more than a few different ones."""
    if len(value) < least or not _KEY.fullmatch(value):
        return False
    return any(c.isdigit() for c in value) and any(c.isalpha() for c in value) and len(set(value)) >= 6


def _secret(text: str, after: int, cue: str) -> tuple[int, int] | None:
    found = _SECRET.match(text, after)
    if not found:
        return None
    start, value = found.start(1), found[1].rstrip(_TRAILING)
    stated = any(c in "=:" for c in text[after:start])
    if stated and cue.startswith("passw"):
        return (start, start + len(value)) if len(value) >= 6 else None
    return (start, start + len(value)) if _random_looking(value, 12 if stated else 20) else None


def _headed(text: str, at: int) -> tuple[tuple[int, int] | None, int]:
    """The key that begins at ``at``, and where the run of its characters ends."""
    run = _KEY.match(text, at)[0]
    value = run.rstrip(_TRAILING)
    return (at, at + len(value)) if _random_looking(value, 20) else None, at + len(run)


def _inside_word(text: str, at: int) -> bool:
    return at > 0 and text[at - 1].isalnum()


def find_spans(text: str) -> list[tuple[str, int, int]]:
    """All spans of a text, by kind as in ``KINDS``, then by start."""
    found: dict[str, list[tuple[int, int]]] = {k: [] for k in KINDS}
    free = dict.fromkeys(KINDS, 0)
    runs_to = 0

    for last, (anchor, length) in anchors().iter(text):
        at = last - length + 1
        if anchor == "digit":
            if at >= free["ip"]:
                if match := _IP.match(text, at):
                    free["ip"] = match.end()
                    if all(len(short := p.lstrip("0")) <= 3 and int(short or "0") <= 255 for p in match[0].split(".")):
                        found["ip"].append(match.span())
                else:
                    free["ip"] = _DIGITS.match(text, at).end()
            if at >= free["card"]:
                if match := _CARD.match(text, at):
                    free["card"] = match.end()
                    digits = _digits(match[0]) if match.end() - at >= 13 else ""
                    if 13 <= len(digits) <= 19 and luhn(digits):
                        found["card"].append(match.span())
                else:
                    free["card"] = at + 1
        elif anchor == "phone":
            if at >= free["phone"] and (match := _PHONE.match(text, at)):
                free["phone"] = match.end()
                if 9 <= len(_digits(match[0])) <= 15:
                    found["phone"].append(match.span())
        elif anchor in ("secret", "head"):
            if at >= free["secret"] and not _inside_word(text, at):
                span = None
                if anchor == "secret":
                    span = _secret(text, last + 1, text[at : last + 1].lower())
                elif at >= runs_to:
                    # One run of characters is looked at once.
                    span, runs_to = _headed(text, at)
                if span:
                    free["secret"] = span[1]
                    found["secret"].append(span)
        elif at >= free[anchor]:
            if anchor == "email":
                span = _email(text, at, free["email"])
            elif anchor == "url":
                span = _url(text, at)
            else:
                span = None if _inside_word(text, at) else _account(text, last + 1)
            if span:
                free[anchor] = span[1]
                found[anchor].append(span)
    return [(kind, *span) for kind in KINDS for span in found[kind]]


def written(spans) -> str:
    return ",".join(f"{kind}:{start}:{end}" for kind, start, end in spans)


def redact(text: str, spans=None) -> str:
    """The text with each span replaced by its kind; overlapping spans become one."""
    spans = sorted(find_spans(text) if spans is None else spans, key=lambda s: (s[1], -s[2]))
    out, at = [], 0
    for kind, start, end in spans:
        if start >= at:
            out += [text[at:start], f"[{kind.upper()}]"]
        at = max(at, end)
    return "".join([*out, text[at:]])


def personal_data(docs: DataFrame, text: str = "text") -> DataFrame:
    """Add counts per base kind, base_sha256, spans and n_added to every row."""

    @F.pandas_udf(
        "n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, n_added bigint, "
        "base_sha256 string, spans string"
    )
    def search(texts: pd.Series) -> pd.DataFrame:
        rows = []
        for value in texts:
            spans = find_spans(value) if value else []
            base = [s for s in spans if s[0] in BASE_KINDS]
            counts = [sum(s[0] == k for s in base) for k in BASE_KINDS]
            digest = hashlib.sha256(written(base).encode()).hexdigest()
            rows.append((*counts, len(spans) - len(base), digest, written(spans)))
        names = [*(f"n_{k}" for k in BASE_KINDS), "n_added", "base_sha256", "spans"]
        return pd.DataFrame(rows, columns=names)

    added = docs.withColumn("__pii", search(F.coalesce(F.col(text).cast("string"), F.lit(""))))
    names = [*(f"n_{k}" for k in BASE_KINDS), "n_added", "base_sha256", "spans"]
    kept = [F.col(f"`{c}`") for c in docs.columns if c not in names]
    return added.select(*kept, *[F.col(f"__pii.{n}").alias(n) for n in names])


def redacted(docs: DataFrame, text: str = "text") -> DataFrame:
    """The same rows with personal data replaced in the text; a null text stays null."""

    @F.pandas_udf("string")
    def clean(texts: pd.Series) -> pd.Series:
        return pd.Series([redact(t) if t else t for t in texts], dtype=object)

    return docs.withColumn(text, clean(F.col(text).cast("string")))
