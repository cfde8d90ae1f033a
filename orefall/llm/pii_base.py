"""Personal data by fixed patterns: linear scans in which no match is retried."""

from __future__ import annotations

import re

KINDS = ("email", "ip", "card", "phone")
#: Fixed patterns of the contract. Look-behinds only stop a scan from starting inside a run that it has just refused.
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
ANY = re.compile(r"[0-9@+]")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")


def luhn(digits: str) -> bool:
    double = [0, 2, 4, 6, 8, 1, 3, 5, 7, 9]
    return sum(double[int(d)] if i % 2 else int(d) for i, d in enumerate(reversed(digits))) % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """From each @ the local part is read backwards, at most to the last match or @, so that long runs cost no more than once."""
    out, last, at = [], 0, text.find("@")
    while at >= 0:
        a = at
        while a > last and text[a - 1] in LOCAL:
            a -= 1
        m = DOMAIN.match(text, at + 1) if a < at else None
        if m:
            out.append((a, m.end()))
        last = m.end() if m else at + 1
        at = text.find("@", last)
    return out


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def refused_and_found(text: str) -> tuple[list[tuple[int, int, str]], list[tuple[int, int, str]]]:
    """Spans (start, end, kind) whose pattern matches but whose check fails, and those of the base, by start and kind."""
    if not ANY.search(text):
        return [], []
    found = [(a, b, "email") for a, b in emails(text)]
    refused = []
    for kind, pattern, good in (("ip", IP, _good_ip), ("card", CARD, _good_card), ("phone", PHONE, _good_phone)):
        for m in pattern.finditer(text):
            (found if good(m.group()) else refused).append((m.start(), m.end(), kind))
    found.sort(key=lambda s: (s[0], KINDS.index(s[2])))
    return refused, found


def _good_ip(s: str) -> bool:
    return all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in s.split("."))


def _good_card(s: str) -> bool:
    d = _digits(s)
    return 12 <= len(d) <= 19 and luhn(d)


def _good_phone(s: str) -> bool:
    return 9 <= len(_digits(s)) <= 15
