"""Checks of what a pattern has found."""

from __future__ import annotations

import re

from hushframe.functions import fixed_values as V

_NETWORK = re.compile(V.NETWORK_PREFIX)
_GULF = re.compile(V.GULF_IBAN.replace(r"\z", r"\Z"), re.ASCII)


def digits(s: str) -> str:
    return re.sub(r"[^0-9]", "", s)


def luhn(s: str) -> bool:
    """Mod 10 over 13 to 19 digits."""
    d = [int(c) for c in reversed(digits(s))]
    return 13 <= len(d) <= 19 and sum(x if i % 2 == 0 else (2 * x - 9 if x > 4 else 2 * x) for i, x in enumerate(d)) % 10 == 0


def card(s: str) -> bool:
    """A known first part, and the checksum unless the first part is one of those taken without."""
    d = digits(s)
    return d[:4] in V.MADA_PREFIXES or luhn(d) and bool(_NETWORK.match(d))


def compact(s: str) -> str:
    return re.sub(r"\s", "", s).upper()


def mod97(s: str) -> bool:
    """15 to 34 characters that leave 1 when the first four have gone to the end and letters are 10 to 35."""
    c = compact(s)
    if not 15 <= len(c) <= 34 or not re.fullmatch(r"[A-Z]{2}[0-9]{2}[A-Z0-9]+", c):
        return False
    return int("".join(str(int(x, 36)) for x in c[4:] + c[:4])) % 97 == 1


def gulf(s: str) -> bool:
    return bool(_GULF.match(compact(s)))


def iban_shape(s: str) -> bool:
    c = compact(s)
    return 15 <= len(c) <= 34 and bool(re.fullmatch(r"[A-Z]{2}[0-9]{2}[A-Z0-9]+", c))


def version_like(s: str) -> bool:
    """Four numbers under ten look like a version."""
    return all(int(p) < 10 for p in s.split(".") if p)


def ipv4(s: str) -> bool:
    """Four numbers up to 255 without leading zeros."""
    p = s.split(".")
    return len(p) == 4 and all(x.isdigit() and int(x) <= 255 and x == str(int(x)) for x in p)


def email_parts(s: str) -> bool:
    """Lengths and edges of the local part and the domain."""
    local, _, domain = s.partition("@")
    if "@" in domain or not 1 <= len(local) <= 64 or not 1 <= len(domain) <= 253:
        return False
    return local[0] != "." and local[-1] != "." and domain[0] not in ".-" and "." in domain


def email_strict(s: str) -> bool:
    local, _, domain = s.partition("@")
    if ".." in s or s[0] == "." or s[-1] == "." or "@" in domain or len(local) > 64 or len(domain) > 253:
        return False
    return bool(re.fullmatch(r"[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}", domain))


def ssn(s: str) -> bool:
    d = digits(s)
    return d[:3] not in ("000", "666") and d[0] != "9" and d[3:5] != "00" and d[5:] != "0000"


def has_letter_and_digit(s: str) -> bool:
    return bool(re.search("[A-Za-z]", s)) and bool(re.search("[0-9]", s))


#: Checks that rules can name.
BY_NAME = {"email": email_strict, "luhn": luhn, "ipv4": ipv4, "iban_shape": iban_shape}
