"""Brute-force versions of operators."""

from __future__ import annotations

import datetime
import hashlib
import re

_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words_of(text):
    return _WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute_windows(text, items, width):
    """(words, hit flag of each, items with a window in the text)."""
    words, names = words_of(text), set()
    hit = [0] * len(words)
    for name, body in items:
        own = words_of(body)
        for at in range(max(1, len(own) - width + 1) if own else 0):
            window = own[at : at + width]
            for k in range(len(words) - len(window) + 1):
                if words[k : k + len(window)] == window:
                    names.add(name)
                    hit[k : k + len(window)] = [1] * len(window)
    return words, hit, names


def _network(symbols, moduli, kind, key, rounds=8):
    half, key = len(symbols) // 2, "pseudonymkey" + key
    left, right = list(symbols[:half]), list(symbols[half:])

    def keyed(k, i, other):
        digest = hashlib.sha256(":".join([key, kind, str(k), str(i // 12), ",".join(map(str, other))]).encode()).hexdigest()
        return int(digest[5 * (i % 12) : 5 * (i % 12) + 5], 16)

    for k in range(rounds):
        if k % 2 == 0:
            left = [(x + keyed(k, i, right)) % moduli[i] for i, x in enumerate(left)]
        else:
            right = [(x + keyed(k, i, left)) % moduli[half + i] for i, x in enumerate(right)]
    return left + right


def feistel(kind, value, key):
    """The pseudonym of a valid value, in plain Python."""
    digits = [int(c) for c in value if c.isdigit()]

    def refill(new, skip=0):
        out, it = [], iter(new)
        for c in value:
            if c.isdigit() and skip:
                skip -= 1
                out.append(c)
            else:
                out.append(str(next(it)) if c.isdigit() else c)
        return "".join(out)

    if kind == "card":
        body = _network(digits[:-1], [10] * (len(digits) - 1), kind, key)
        total = sum(d if i % 2 else d * 2 - 9 * (d > 4) for i, d in enumerate(reversed(body)))
        return refill([*body, -total % 10])
    if kind == "phone":
        first = [i in (0, 3) for i in range(10)]
        moduli = [(8 if d > 1 else 2) if f else 10 for d, f in zip(digits[1:], first, strict=True)]
        base = [2 if m == 8 else 0 for m in moduli]
        new = _network([d - b for d, b in zip(digits[1:], base, strict=True)], moduli, kind, key)
        return refill([x + b for x, b in zip(new, base, strict=True)], 1)
    if kind == "ipv4":
        return ".".join(map(str, _network([int(x) for x in value.split(".")], [256] * 4, kind, key)))
    if kind == "date":
        first = datetime.date(1800, 1, 1)
        day = (datetime.date.fromisoformat(value) - first).days
        a, b = _network([day // 773, day % 773], [189, 773], kind, key)
        return str(first + datetime.timedelta(days=a * 773 + b))
    if kind == "secret":
        name, body = value.split("=")
        return name + "=" + "".join(f"{x:x}" for x in _network([int(c, 16) for c in body], [16] * len(body), kind, key))
    name, rest = value.split("@")
    lead = name[: len(name) - len(name.lstrip("._%+-"))]
    name = name[len(lead) :]
    base = [(48, 10) if c.isdigit() else (97, 26) if c.islower() else (65, 26) if c.isupper() else (ord(c), 1) for c in name]
    new = _network([ord(c) - b if m > 1 else 0 for c, (b, m) in zip(name, base, strict=True)], [m for _, m in base], kind, key)
    return lead + "".join(chr(b + x) if m > 1 else c for c, x, (b, m) in zip(name, new, base, strict=True)) + "@" + rest
