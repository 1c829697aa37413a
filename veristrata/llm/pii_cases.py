"""Labelled cases that the personal-data field learns from: written forms of each kind, and what looks alike but isn't personal.

A case is a text and its spans. Forms are templates filled by a seeded generator,
so that labels don't come from the patterns that give the base spans.
"""

from __future__ import annotations

import random
import string
from collections.abc import Iterator

# Words of templates.
NAMES = "anna ben carla david emma frank gina hugo ines jon lena marc nora oscar paula".split()
HOSTS = "example mailbox post northwind acme university office home".split()
ENDS = "com org net edu de fr es co.uk io info".split()
AROUND = "the report says that we met on our way and then it was over again for this year as before with all of them".split()
LEADS = {
    "email": ["write to", "e-mail:", "contact", "mail"],
    "ip": ["ip", "host", "from server", "address"],
    "card": ["card", "visa", "paid by card", "credit card number:"],
    "phone": ["call", "tel.", "phone:", "mobile", "fax", "ring"],
    "id": ["ssn", "social security number", "national id", "tax id:", "passport no."],
    "iban": ["iban", "account", "transfer to", "iban:"],
    "secret": ["token =", "password:", "api_key =", "secret", "key:", "auth token:", "pwd="],
}


def luhn_number(rng: random.Random, size: int) -> str:
    body = [rng.randrange(10) for _ in range(size - 1)]
    total = sum(d if i % 2 else (d * 2 - 9 if d > 4 else d * 2) for i, d in enumerate(reversed(body)))
    return "".join(map(str, body)) + str(-total % 10)


def digits(rng: random.Random, shape: str) -> str:
    """A shape's nines become digits, the first of each group not zero."""
    out = ""
    for i, c in enumerate(shape):
        out += str(rng.randrange(1 if i == 0 or not shape[i - 1].isdigit() else 0, 10)) if c == "9" else c
    return out


def iban(rng: random.Random) -> str:
    country, size = rng.choice([("DE", 18), ("FR", 23), ("ES", 20), ("GB", 18), ("NL", 14)])
    body = "".join(rng.choice(string.digits) for _ in range(size))
    if country in ("GB", "NL"):
        body = "".join(rng.choice(string.ascii_uppercase) for _ in range(4)) + body[4:]
    value = int("".join(str(int(c, 36)) for c in body + country + "00"))
    whole = f"{country}{98 - value % 97:02d}{body}"
    return " ".join(whole[i : i + 4] for i in range(0, len(whole), 4)) if rng.random() < 0.5 else whole


def secret(rng: random.Random) -> str:
    alphabet, size = rng.choice([("0123456789abcdef", 32), ("0123456789abcdef", 40), ("0123456789abcdef", 64), (string.ascii_letters + string.digits, 20), (string.ascii_letters + string.digits, 36), (string.ascii_letters + string.digits + "_-", 43)])
    return rng.choice(["", "", "sk-", "key_"]) + "".join(rng.choice(alphabet) for _ in range(size))


def entity(rng: random.Random, kind: str) -> str:
    if kind == "email":
        name, host, end = rng.choice(NAMES) + rng.choice(["", ".k", "_7", "99"]), rng.choice(HOSTS), rng.choice(ENDS)
        return rng.choice([f"{name}@{host}.{end}", f"{name} at {host} dot {end.replace('.', ' dot ')}", f"{name}(at){host}(dot){end}", f"{name} [at] {host} [dot] {end}", f"{name} @ {host}.{end}", f"{name} (at) {host}.{end}"])
    if kind == "ip":
        if rng.random() < 0.5:
            return ".".join(str(rng.randrange(256)) for _ in range(4))
        groups = [f"{rng.randrange(1, 1 << 16):x}" for _ in range(8)]
        return ":".join(groups) if rng.random() < 0.5 else ":".join(groups[:3]) + "::" + ":".join(groups[6:])
    if kind == "card":
        n = luhn_number(rng, rng.choice([15, 16, 16, 16]))
        return rng.choice([n, "-".join(n[i : i + 4] for i in range(0, len(n), 4)), " ".join(n[i : i + 4] for i in range(0, len(n), 4)), ".".join(n[i : i + 4] for i in range(0, len(n), 4))])
    if kind == "phone":
        return digits(rng, rng.choice(["+9 (999) 999-9999", "+99 99 999999", "(999) 999-9999", "999-999-9999", "999 999 9999", "+99 999 999 9999", "(099) 9999 9999", "099 9999 9999", "+99.99.99.99.99.99", "099/9999999"]))
    if kind == "id":
        return rng.choice([digits(rng, "999-99-9999"), digits(rng, "999 99 9999"), f"{rng.choice('ABCEHJ')}{rng.choice('ABCEHJ')} " + digits(rng, "99 99 99 ") + rng.choice("ABCD"), f"{rng.choice('ABCEHJ')}{rng.choice('ABCEHJ')}" + digits(rng, "999999") + rng.choice("ABCD")])
    return iban(rng) if kind == "iban" else secret(rng)


def other(rng: random.Random) -> str:
    """Something of digits, or of a like form, that isn't personal."""
    shape = rng.choice(
        "9999 99 9 999,999 9,999,999 9.99 99.9% 9999-99-99 99/99/9999 99.99.9999 99:99 99:99:99 9999-9999 9.9.9 v9.99.9 99-99 9999999 99999999 9999999999999 9999999999999999 (9999) (99) $9,999.99 99x99 "
        "999-9-99-999999-9 99999-9999 9999/99 9e99 999.999.999 99999 99 99 99 999 9999 9999 9999".replace("99 99 99", "99~99~99").replace("999 9999", "999~9999").split()
    ).replace("~", " ")
    hexes = "".join(rng.choice("0123456789abcdef") for _ in range(32))
    words = rng.choice(["look at home. Then dot", "version2beta", "A4 and B5", "at work", "covid19-related-information-page", "chapter-12-of-the-long-story-2019", "THE_2019_ANNUAL_REPORT", f"{hexes[:8]}-{hexes[8:12]}-4{hexes[13:16]}-a{hexes[17:20]}-{hexes[:12]}", "we met at noon, dot com era", "00:1a:2b", "ISBN " + digits(rng, "999-9-999-99999-9")])
    return words if rng.random() < 0.25 else digits(rng, shape)


def cases(n: int, seed: int = 17) -> Iterator[tuple[str, set[tuple[str, int, int]]]]:
    """``n`` texts with an entity each, and as many without."""
    rng = random.Random(seed)
    kinds = list(LEADS)
    for i in range(n):
        kind = kinds[i % len(kinds)]
        before = " ".join(rng.choice(AROUND) for _ in range(rng.randrange(1, 4)))
        after = rng.choice([" ", ", ", ". ", ") ", "; ", "\n", '" ']) + " ".join(rng.choice(AROUND) for _ in range(2))
        lead = rng.choice(LEADS[kind]) if kind == "secret" or rng.random() < (0.7 if kind == "id" else 0.4) else ""
        what = entity(rng, kind)
        quote = '"' if kind == "secret" and rng.random() < 0.4 else ""
        start = f"{before} {lead} {quote}".replace("  ", " ")
        yield start + what + after, {(kind, len(start), len(start) + len(what))}
        yield f"{before} {other(rng)}{after} {other(rng)}", set()
