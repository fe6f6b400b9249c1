"""Personal data by anchor expansion: one Aho-Corasick pass finds at-signs, digit marks, schemes and identifier cues; local
parsers expand each anchor to a span and validate it.

Base kinds are email, ip, card and phone, each leftmost and without overlaps of its own kind. The method adds url (after a
scheme; one inside another is part of it), secret (a long key after a cue such as `token =`), account (a number after a cue such as
`iban`: IBANs, also in blocks of four, by their check digits, social security numbers by area, group and serial; and card numbers that a longer run of
digits hides from the base rule: whole groups of digits, parted as cards are, with right check digits) and ip6 (addresses of six characters or more
with a digit). Cues are English, German, French and Spanish; cues and schemes are met in any letter case. Spans are code points, end exclusive, ordered by
start, then kind. Every parser either moves the floor of its kind beyond what it has read or reads a bounded number of
characters, so the work is linear in the text.

Defined results: a null text counts as empty and has no spans (`redact` leaves it null); spans of different kinds may overlap, and
`redact` then replaces their union by the tag of the earliest; repeated rows give repeated results; texts are read whole."""

from __future__ import annotations

import hashlib
import re
from functools import lru_cache
from ipaddress import AddressValueError, IPv6Address

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame

from trackweave.llm.common import map_batches

KINDS = ("email", "ip", "card", "phone", "url", "secret", "account", "ip6")
_ALNUM = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789")
_DIGIT = frozenset("0123456789")
_LOCAL, _LABEL = _ALNUM | frozenset("._%+-"), _ALNUM | frozenset("-")
_PHONE = _DIGIT | frozenset(" ().-")
_URL_END = frozenset(" \t\n\x0b\x0c\r<>\"'`|{}")
SCHEMES = ("http://", "https://", "ftp://", "www.")
SECRET_CUES = (
    "token", "password", "passwd", "secret", "api_key", "apikey", "api-key", "access_key", "passwort", "kennwort", "schl\u00fcssel", "mot de passe", "cl\u00e9 d'acc\u00e8s",
    "contrase\u00f1a", "clave de acceso",
)
SECRET_PREFIXES = ("AKIA", "ghp_", "sk-")
IBAN_CUES, SOCIAL_CUES = ("iban",), ("ssn", "social security")
ACCOUNT_CUES = (
    "account", "acct", "passport", "customer no", "member id", "member no", "kontonummer", "konto-nr", "kundennummer", "kunden-nr", "reisepass", "ausweisnummer",
    "num\u00e9ro de compte", "num\u00e9ro client", "passeport", "n\u00famero de cuenta", "n\u00famero de cliente", "pasaporte",
)
#: Digits in each group of a card number that is written in groups; in one piece it has 13 to 19.
CARD_GROUPS = ((4, 4, 4, 4), (4, 6, 5), (4, 6, 4), (4, 4, 4, 4, 3))
#: Characters between a cue and its number or key, at most so many; the longest number after an account cue that is looked at.
MARKS, MOST_MARKS, LONGEST = frozenset(" =:#\"'"), 4, 64
_KEY = _LABEL | frozenset("_/+")
_HEX = frozenset("0123456789abcdefABCDEF:")
_CUE_WORDS = re.compile(r"(?:\s*(?:no|nr|number|num|id|code)\b\.?)?", re.ASCII | re.IGNORECASE)
_IBAN = re.compile(r"[A-Za-z]{2}[0-9]{2}(?: ?[A-Za-z0-9]){11,30}", re.ASCII)
_SOCIAL = re.compile(r"([0-9]{3})([- ]?)([0-9]{2})\2([0-9]{4})(?![0-9])", re.ASCII)

Span = tuple[int, int, int]


@lru_cache(maxsize=1)
def anchors() -> ahocorasick.Automaton:
    """Anchor strings in lower case, with the parser each calls and its length."""
    out = ahocorasick.Automaton()
    out.add_word("@", ("email", 1))
    for d in "0123456789":
        out.add_word(f"+{d}", ("phone", 2))
        for e in "0123456789":
            out.add_word(f"{d}.{e}", ("ip", 3))
            for between in ("", " ", "-"):
                out.add_word(f"{d}{between}{e}", ("card", 2 + len(between)))
    for d in "0123456789abcdef":
        out.add_word(f"{d}::", ("ip6", 3))
        for e in "0123456789abcdef":
            out.add_word(f"{d}:{e}", ("ip6", 3))
    out.add_word("::", ("ip6", 2))
    kinds = (("url", SCHEMES), ("secret", SECRET_CUES), ("prefix", SECRET_PREFIXES), ("iban", IBAN_CUES), ("social", SOCIAL_CUES), ("account", ACCOUNT_CUES))
    for kind, words in kinds:
        for w in words:
            out.add_word(w.lower(), (kind, len(w)))
    out.make_automaton()
    return out


def lowered(text: str) -> str:
    """The text in lower case with every code point in its place: a letter whose lower form is longer stays."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(c if len(c.lower()) != 1 else c.lower() for c in text)


def _run(text: str, at: int, chars: frozenset) -> int:
    """The end of the run of chars that begins at `at`."""
    n = len(text)
    while at < n and text[at] in chars:
        at += 1
    return at


def parse_email(text: str, sign: int, floor: int) -> Span | None:
    """Expand an at-sign left over the local part, not below `floor`, and right over at least two labels."""
    start = sign
    while start > floor and text[start - 1] in _LOCAL:
        start -= 1
    end = _run(text, sign + 1, _LABEL)
    if start == sign or end == sign + 1:
        return None
    labels = 0
    while end < len(text) and text[end] == "." and (to := _run(text, end + 1, _LABEL)) > end + 1:
        end, labels = to, labels + 1
    return (start, 0, end) if labels else None


def parse_ips(text: str, at: int) -> tuple[list[Span], int]:
    """All addresses in the chain of dotted numbers around a position, four numbers at a time, and the chain's end."""
    first = at
    while first > 0 and (text[first - 1] in _DIGIT or text[first - 1] == "." and first > 1 and text[first - 2] in _DIGIT):
        first -= 1
    parts, end = [], first
    while True:
        to = _run(text, end, _DIGIT)
        parts.append((end, to))
        if to + 1 < len(text) and text[to] == "." and text[to + 1] in _DIGIT:
            end = to + 1
        else:
            break
    found = []
    for k in range(0, len(parts) - 3, 4):
        four = [text[a:b].lstrip("0") for a, b in parts[k : k + 4]]
        if all(len(p) < 3 or len(p) == 3 and p <= "255" for p in four):
            found.append((parts[k][0], 1, parts[k + 3][1]))
    return found, to


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        v = ord(c) - 48
        if k % 2:
            v = 2 * v - 9 * (v > 4)
        total += v
    return total % 10 == 0


def hidden_cards(text: str, start: int, end: int) -> list[Span]:
    """Card numbers among the groups of digits of a run that is none itself: whole groups in a row, parted alike, leftmost first."""
    groups, at = [], start
    while at < end:
        to = _run(text, at, _DIGIT)
        groups.append((at, to))
        at = to + 1
    found, k = [], 0
    while k < len(groups):
        for shape in ((13,), *CARD_GROUPS):
            some = groups[k : k + len(shape)]
            sizes = tuple(b - a for a, b in some)
            marks = {text[b] for _, b in some[:-1]}
            if (13 <= sizes[0] <= 19 if len(shape) == 1 else sizes == shape and len(marks) == 1) and luhn("".join(text[a:b] for a, b in some)):
                found.append((some[0][0], 6, some[-1][1]))
                k += len(shape) - 1
                break
        k += 1
    return found


def parse_card(text: str, at: int) -> tuple[list[Span], int]:
    """The run of digits with single blanks or hyphens between them around a position, if it is a card number, or else those hidden in it; and its end."""
    start = at
    while start > 0 and (text[start - 1] in _DIGIT or start > 1 and text[start - 1] in " -" and text[start - 2] in _DIGIT):
        start -= 1 if text[start - 1] in _DIGIT else 2
    end = start
    while True:
        end = _run(text, end, _DIGIT)
        if end + 1 < len(text) and text[end] in " -" and text[end + 1] in _DIGIT:
            end += 1
        else:
            break
    digits = text[start:end].replace(" ", "").replace("-", "")
    return [(start, 2, end)] if 12 <= len(digits) <= 19 and luhn(digits) else hidden_cards(text, start, end), end


def parse_phone(text: str, plus: int) -> Span | None:
    """From a plus sign and digit over digits, blanks, brackets, points and hyphens to the last digit."""
    end = _run(text, plus + 2, _PHONE)
    while end > plus + 3 and text[end - 1] not in _DIGIT:
        end -= 1
    if end <= plus + 3 or text[end - 1] not in _DIGIT:
        return None
    return (plus, 3, end) if 9 <= sum(map(text[plus:end].count, "0123456789")) <= 15 else None


def parse_url(text: str, start: int, after: int) -> tuple[Span | None, int]:
    """From a scheme to the next blank or mark that ends a URL, without punctuation at its end; and where reading ended."""
    if start and text[start - 1] in _ALNUM:
        return None, after
    end, n = after, len(text)
    while end < n and text[end] not in _URL_END:
        end += 1
    stop = end
    while end > after and text[end - 1] in ".,;:!?)]":
        end -= 1
    return ((start, 4, end) if "." in text[start:end].rpartition("/")[0] + text[after:end] else None), stop


def _value(text: str, at: int) -> int:
    """Where the number or key after a cue begins: a few marks such as ` = "` are skipped."""
    start = at
    while start < len(text) and start - at < MOST_MARKS and text[start] in MARKS:
        start += 1
    return start


def parse_secret(text: str, after: int) -> tuple[Span | None, int]:
    """A key of 16 or more characters with a digit, after a cue and a mark; and where reading ended."""
    at = _value(text, after)
    if not set(text[after:at]) & set("=:"):
        return None, after
    end = _run(text, at, _KEY)
    return ((at, 5, end) if end - at >= 16 and any(c in _DIGIT for c in text[at:end]) else None), end


def parse_prefixed(text: str, start: int, after: int) -> tuple[Span | None, int]:
    """A key of 20 or more characters that begins with a known prefix, in its own letter case."""
    if start and text[start - 1] in _ALNUM or text[start:after] not in SECRET_PREFIXES:
        return None, after
    end = _run(text, after, _LABEL | frozenset("_"))
    return ((start, 5, end) if end - start >= 20 else None), end


def iban_fits(number: str) -> bool:
    """The check digits: the number, its first four characters last and letters as 10 to 35, is 1 modulo 97."""
    moved = number[4:] + number[:4]
    return int("".join(str(int(c, 36)) for c in moved)) % 97 == 1


def _stands_alone(text: str, start: int, after: int) -> bool:
    return not (start and text[start - 1] in _ALNUM or after < len(text) and text[after] in _ALNUM)


def _after_words(text: str, after: int) -> int:
    """Beyond words such as `no.` or `number` that may follow a cue."""
    return _CUE_WORDS.match(text, after, after + LONGEST).end()


def parse_iban(text: str, start: int, after: int) -> Span | None:
    """The longest number after the cue that ends at a word's end and whose check digits fit."""
    if not _stands_alone(text, start, after):
        return None
    at = _value(text, _after_words(text, after))
    found = _IBAN.match(text, at, at + LONGEST) if at > after else None
    end = found.end() if found else at
    while end > at:
        number = text[at:end].replace(" ", "")
        if len(number) < 15:
            return None
        if text[end - 1] != " " and not (end < len(text) and text[end] in _ALNUM) and iban_fits(number):
            return at, 6, end
        end -= 1
    return None


def parse_social(text: str, start: int, after: int) -> Span | None:
    """Nine digits, in one piece or parted alike; area 000, 666 and 900 on, group 00 and serial 0000 are never issued."""
    if not _stands_alone(text, start, after):
        return None
    at = _value(text, _after_words(text, after))
    found = _SOCIAL.match(text, at, at + LONGEST) if at > after else None
    if not found or found[1] in ("000", "666") or found[1] >= "900" or found[3] == "00" or found[4] == "0000":
        return None
    return at, 6, found.end()


def parse_account(text: str, start: int, after: int) -> Span | None:
    """A number of 6 to 34 letters and digits, half of them digits, after a cue that stands alone."""
    if not _stands_alone(text, start, after):
        return None
    at = _value(text, _after_words(text, after))
    if at == after:
        return None
    end = at
    while end < len(text) and end - at < LONGEST and text[end] in _KEY:
        end += 1
    body = text[at:end].rstrip("-_/+")
    digits = sum(map(body.count, "0123456789"))
    return (at, 6, at + len(body)) if 6 <= len(body) <= 34 and 2 * digits >= len(body) and body[0] in _ALNUM else None


def parse_ip6(text: str, at: int) -> tuple[Span | None, int]:
    """The run of hexadecimal digits and colons around a position, if it is an address; and the run's end."""
    start = at
    while start > 0 and text[start - 1] in _HEX:
        start -= 1
    stop = _run(text, at, _HEX)
    end = stop - 1 if text[stop - 1] == ":" and text[stop - 2] != ":" else stop
    if end - start < 6 or end - start > 39 or start and text[start - 1] in _ALNUM or stop < len(text) and text[stop] in _ALNUM:
        return None, stop
    try:
        IPv6Address(text[start:end])
    except AddressValueError:
        return None, stop
    return ((start, 7, end) if any(c in _DIGIT for c in text[start:end]) else None), stop


def find(text: str | None) -> list[Span]:
    """All spans (start, kind, end) in order."""
    if not text:
        return []
    out: set[Span] = set()
    done = dict.fromkeys(("email", "ip", "card", "url", "secret", "prefix", "ip6"), 0)
    for last, (kind, size) in anchors().iter(lowered(text)):
        start, span = last - size + 1, None
        if kind in done and kind != "email" and start < done[kind]:
            continue
        if kind == "card":
            spans, done["card"] = parse_card(text, start)
            out.update(spans)
        elif kind == "ip":
            spans, done["ip"] = parse_ips(text, start)
            out.update(spans)
        elif kind == "email":
            if span := parse_email(text, start, done["email"]):
                done["email"] = span[2]
        elif kind == "phone":
            span = parse_phone(text, start)
        elif kind == "url":
            span, done["url"] = parse_url(text, start, last + 1)
        elif kind == "secret":
            span, done["secret"] = parse_secret(text, last + 1)
        elif kind == "prefix":
            span, done["prefix"] = parse_prefixed(text, start, last + 1)
        elif kind == "ip6":
            span, done["ip6"] = parse_ip6(text, start)
        else:
            span = {"iban": parse_iban, "social": parse_social, "account": parse_account}[kind](text, start, last + 1)
        if span:
            out.add(span)
    return sorted(out)


def joined(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def redacted(text: str | None, spans: list[Span]) -> str | None:
    """The text with each union of overlapping spans replaced by `<KIND>` of its first span."""
    if not spans:
        return text
    out, at, (begin, kind, end) = [], 0, spans[0]
    for a, k, b in [*spans[1:], (len(text) + 1, 0, 0)]:
        if a < end:
            end = max(end, b)
            continue
        out += [text[at:begin], f"<{KINDS[kind].upper()}>"]
        at, begin, kind, end = end, a, k, b
    return "".join(out) + text[at:]


def scan(docs: DataFrame) -> DataFrame:
    """Counts of base spans, the digest of their list, and the list of all spans, for each document."""

    def run(batch: pa.RecordBatch) -> dict:
        found = [find(t) for t in batch.column(1).to_pylist()]
        out = {f"n_{KINDS[k]}": [sum(s[1] == k for s in f) for f in found] for k in range(4)}
        base = [joined([s for s in f if s[1] < 4]) for f in found]
        return {"doc_id": batch.column(0)} | out | {"base_sha256": [hashlib.sha256(b.encode()).hexdigest() for b in base], "spans": [joined(f) for f in found]}

    return map_batches(docs.select("doc_id", "text"), "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string", run)


def redact(docs: DataFrame) -> DataFrame:
    """The documents with all spans replaced, and n_chars set to the new length where the text changed."""
    at, size = docs.columns.index("text"), docs.columns.index("n_chars") if "n_chars" in docs.columns else -1

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        old = batch.column(at).to_pylist()
        new = [redacted(t, find(t)) for t in old]
        cols = list(batch.columns)
        cols[at] = pa.array(new, cols[at].type)
        if size >= 0:
            cols[size] = pa.array([n if a is b else len(b) for n, a, b in zip(cols[size].to_pylist(), old, new)], cols[size].type)
        return pa.RecordBatch.from_arrays(cols, schema=batch.schema)

    return map_batches(docs, docs.schema, run)
