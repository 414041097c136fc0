"""Proposals, validators and context words of personal data in one text."""

from __future__ import annotations

import re
from collections.abc import Iterator

# The kinds in the order in which they are listed, base kinds first.
BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "iban", "national_id")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# Quantifiers never give back what they took, and no proposal starts inside a run of digits, so time is linear also
# where a text is one long run of digits or letters.
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:[\x20]?[A-Z0-9]){11,30}(?![A-Za-z0-9])")
NATIONAL_ID = re.compile(r"(?<![0-9-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9-])")

#: Characters before and after a span in which context words count.
REACH = 48
#: Score of a confirmed proposal without any context word.
PRIOR = {"email": 0.9, "ip": 0.6, "card": 0.8, "phone": 0.7, "iban": 0.8, "national_id": 0.3}
#: Words that make a kind more likely, and words that make any kind less so.
FOR = {
    "email": ("mail", "contact", "kontakt", "correo", "courriel"),
    "ip": ("ip", "host", "server", "client", "address", "adresse"),
    "card": ("card", "visa", "mastercard", "karte", "carte", "tarjeta", "credit"),
    "phone": ("phone", "tel", "call", "mobile", "telefon", "fax"),
    "iban": ("iban", "bank", "account", "konto", "compte", "cuenta"),
    "national_id": ("ssn", "social", "security", "tax", "identity", "insurance"),
}
AGAINST = ("version", "serial", "sku", "isbn", "invoice", "order", "part", "example", "checksum")
GAIN, LOSS, LEAST = 0.3, 0.4, 0.5
WORD = re.compile(r"[^\W\d_]+")


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Each @ has its own run of local characters, so one look back and one ahead decide it."""
    last, at = 0, text.find("@")
    while at >= 0:
        domain, start = DOMAIN.match(text, at + 1), at
        if domain:
            while start > last and text[start - 1] in LOCAL:
                start -= 1
        if start < at:
            last = domain.end()
            yield start, last
            at = text.find("@", last)
        else:
            at = text.find("@", at + 1)


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        value = int(d) << (k & 1)
        total += value - 9 if value > 9 else value
    return total % 10 == 0


def mod_97(code: str) -> bool:
    """Check digits of an account number, letters as two digits from A = 10 on."""
    code = code.replace(" ", "")
    return 15 <= len(code) <= 34 and int("".join(str(int(c, 36)) for c in code[4:] + code[:4])) % 97 == 1


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def small_parts(address: str) -> bool:
    return all(len(p.lstrip("0")) <= 3 and int(p[-3:]) <= 255 for p in address.split("."))


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Confirmed spans of the base kinds, leftmost and not overlapping within a kind; a match that fails is not retried."""
    out = [("email", a, b) for a, b in emails(text)]
    out += [("ip", m.start(), m.end()) for m in IP.finditer(text) if small_parts(m.group())]
    for m in CARD.finditer(text):
        digits = _digits(m.group()) if m.end() - m.start() >= 13 else ""
        if 13 <= len(digits) <= 19 and luhn(digits):
            out.append(("card", m.start(), m.end()))
    if "+" in text:
        out += [("phone", m.start(), m.end()) for m in PHONE.finditer(text) if 9 <= len(_digits(m.group())) <= 15]
    return out


def added_spans(text: str) -> list[tuple[str, int, int]]:
    out = [("iban", m.start(), m.end()) for m in IBAN.finditer(text) if mod_97(m.group())]
    return out + [("national_id", m.start(), m.end()) for m in NATIONAL_ID.finditer(text)]


def score(text: str, kind: str, start: int, end: int) -> float:
    """The kind's prior, more with a word that speaks for it nearby, less with one that speaks against; 0 to 1."""
    near = f"{text[max(0, start - REACH) : start]} {text[end : end + REACH]}".lower()
    words = set(WORD.findall(near))
    value = PRIOR[kind] + GAIN * (not words.isdisjoint(FOR[kind])) - LOSS * (not words.isdisjoint(AGAINST))
    return round(min(1.0, max(0.0, value)), 3)


def find(text: str, least: float = LEAST) -> list[tuple[str, int, int, float, bool]]:
    """(kind, start, end, score, base) in the order of kinds and starts. Base spans stay whatever their score; others need
    `least` and a place of their own."""
    if "@" not in text and not any(d in text for d in "0123456789"):
        return []
    base = base_spans(text)
    out = [(*s, score(text, *s), True) for s in base]
    for kind, start, end in added_spans(text):
        value = score(text, kind, start, end)
        if value >= least and not any(a < end and start < b for _, a, b in base):
            out.append((kind, start, end, value, False))
    return out
