r"""Personal data: format-preserving pseudonyms by a keyed Feistel permutation.

Found and checked are payment card numbers (Luhn), IBANs (mod 97), phone numbers, national numbers of
the form ddd-dd-dddd, IPv4 addresses (octets up to 255), dates that exist, and e-mail addresses. The
digits (for e-mail addresses the letters and digits of the local part) of a value are permuted within
their own number system by a Feistel network keyed with an HMAC; signs and separators stay. Check
digits are computed anew, octets are permuted among octets and dates among days, so the pseudonym is
valid in its format. A match that fails its check may have run into the digits or the upper-case word
after the value; forms of it that end at an earlier separator are then tried. The same value in the
same format always gets the same pseudonym, in every document; values of one kind are linked even
where separators differ. Only a card number whose pseudonym would pass the check together with digits
that follow it gets another one there. Without the key the permutation cannot be undone; with it
`replace(..., back=True)` does.

The work is a function of one text, applied to Arrow batches; nothing is shuffled.

Defined results: a null text stays null; a text without findings stays as it is; an empty table
gives an empty result; equal rows get equal results; other columns are not looked at. Time is linear in the length of a
text, also in long unbroken runs. The local part of an address has 64 characters at most: of a longer run before the
sign, the last 64 are taken.
"""

from __future__ import annotations

import datetime
import hashlib
import hmac
import math
from bisect import bisect_left
from functools import lru_cache

import regex
from pyspark.sql import Column
from pyspark.sql import functions as F

ROUNDS = 10
KINDS = ("email", "iban", "card", "phone", "national", "ip", "date")
#: Forms of the values. Checks follow in code.
FORMS = {
    "email": r"[A-Za-z0-9][A-Za-z0-9._%+\-]{0,63}@[A-Za-z0-9](?:[A-Za-z0-9\-]*[A-Za-z0-9])?(?:\.[A-Za-z0-9](?:[A-Za-z0-9\-]*[A-Za-z0-9])?)+",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "ip": r"(?<![0-9.])(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?![0-9]|\.[0-9])",
    "date": r"(?<![0-9])(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{1,2}/[0-9]{1,2}/[0-9]{4}|[0-9]{1,2}\.[0-9]{1,2}\.[0-9]{4})(?![0-9])",
    "national": r"(?<![0-9\-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9\-])",
    "card": r"(?<![0-9A-Za-z])[0-9](?:[ \-]?[0-9]){12,18}(?![0-9A-Za-z])",
    "phone": r"(?<![0-9A-Za-z])\+[0-9]{1,3}(?:[ .\-]?\([0-9]{1,4}\))?(?:[ .\-]?[0-9]{2,4}){2,5}(?![0-9A-Za-z])"
             r"|(?<![0-9A-Za-z])(?:\([0-9]{3}\) ?|[0-9]{3}[.\-])[0-9]{3}[.\-][0-9]{4}(?![0-9A-Za-z])",
}
#: The forms that are found from their first character. E-mail addresses are found from their sign instead: tried at every
#: letter of a long unbroken run, the search would take the square of its length.
ANY = regex.compile("|".join(f"(?P<{k}>{v})" for k, v in FORMS.items() if k != "email"))
#: Characters of a local part at most; of a longer run before the sign, the last ones.
LOCAL = 64
NOT_LOCAL = regex.compile(r"(?r)[^A-Za-z0-9._%+\-]")
HOST = regex.compile(FORMS["email"].partition("@")[2])
PLAIN = regex.compile(r"[A-Za-z0-9]")
#: Longer values are not remembered.
REMEMBERED = 300
#: A text without any of these holds none of the forms.
HINT = regex.compile(r"[0-9@]")
FIRST_YEAR, LAST_YEAR = 1900, 2099
#: Characters of an IBAN by country.
IBAN_LENGTHS = {country: int(length) for length, countries in (entry.split(":") for entry in (
    "15:NO 16:BE 18:DK,FI,FK,FO,GL,NL,SD 19:MK,SI 20:AT,BA,EE,KZ,LT,LU,MN,XK 21:CH,HR,LI,LV 22:BG,BH,CR,DE,GB,GE,IE,ME,RS,VA "
    "23:AE,GI,IL,IQ,OM,SO,TL 24:AD,CZ,ES,MD,PK,RO,SA,SE,SK,TN,VG 25:LY,PT,ST 26:IS,TR 27:BI,DJ,FR,GR,IT,MC,MR,SM "
    "28:AL,AZ,BY,CY,DO,GT,HN,HU,LB,NI,PL,SV 29:BR,EG,PS,QA,UA 30:JO,KW,MU,YE 31:MT,SC 32:LC 33:RU").split()) for country in countries.split(",")}
#: A card number does not begin with a shorter group, where it is cut from a longer match.
FIRST_GROUP = 4


def _round(key: bytes, tweak: str, r: int, value: int, size: int) -> int:
    digest = hmac.new(key, f"{tweak}|{r}|{value}|{size}".encode(), hashlib.blake2b).digest()
    return int.from_bytes(digest[:16], "big") % size


def permute(value: int, size: int, key: bytes, tweak: str, back: bool = False) -> int:
    """A keyed permutation of 0..size-1: an unbalanced Feistel network over a x b >= size, walked
    until the value lies inside again."""
    if size < 2:
        return value
    a = math.isqrt(size - 1) + 1
    b = -(-size // a)
    while True:
        left, right = divmod(value, b)
        if back:
            for r in reversed(range(ROUNDS)):
                if r % 2:
                    right = (right - _round(key, tweak, r, left, b)) % b
                else:
                    left = (left - _round(key, tweak, r, right, a)) % a
        else:
            for r in range(ROUNDS):
                if r % 2:
                    right = (right + _round(key, tweak, r, left, b)) % b
                else:
                    left = (left + _round(key, tweak, r, right, a)) % a
        value = left * b + right
        if value < size:
            return value


def luhn(digits: str) -> int:
    """The check digit that belongs after `digits`."""
    total = sum(sum(divmod(2 * int(c), 10)) if k % 2 == 0 else int(c) for k, c in enumerate(reversed(digits)))
    return -total % 10


def _mod97(text: str) -> int:
    return int("".join(str(int(c, 36)) for c in text)) % 97


def _fill(form: str, new: str, taken=str.isdigit) -> str:
    """The form with its characters of one class replaced in order."""
    left = iter(new)
    return "".join(next(left) if taken(c) else c for c in form)


def _digits(text: str) -> str:
    return "".join(c for c in text if c.isdigit())


def _number(digits: str, key: bytes, tweak: str, back: bool) -> str:
    return str(permute(int(digits), 10 ** len(digits), key, f"{tweak}{len(digits)}", back)).zfill(len(digits))


def _card(found, key, back):
    digits = _digits(found)
    if luhn(digits[:-1]) != int(digits[-1]) or len(set(digits)) == 1:
        return None
    body = _number(digits[:-1], key, "card", back)
    return _fill(found, body + str(luhn(body)))


def _iban(found, key, back):
    plain = found.replace(" ", "")
    if not 15 <= len(plain) <= 34 or _mod97(plain[4:] + plain[:4]) != 1:
        return None
    numbers = _digits(plain[4:])
    if not numbers:
        return None
    body = _fill(plain[4:], _number(numbers, key, "iban" + plain[:2], back))
    check = str(98 - _mod97(body + plain[:2] + "00")).zfill(2)
    return _fill(found, plain[:2] + check + body, lambda c: c != " ")


def _ip(found, key, back):
    octets = [int(x) for x in found.split(".")]
    if max(octets) > 255 or any(len(x) > 1 and x[0] == "0" for x in found.split(".")):
        return None
    value = permute(int.from_bytes(bytes(octets), "big"), 2**32, key, "ip", back)
    return ".".join(map(str, value.to_bytes(4, "big")))


def _date(found, key, back):
    sign = next(c for c in found if not c.isdigit())
    parts = [int(x) for x in found.split(sign)]
    # with slashes the order is not known unless one number exceeds 12; both kinds keep to themselves
    day_first = sign == "." or sign == "/" and parts[0] > 12
    year, month, day = parts if sign == "-" else (parts[2], *((parts[1], parts[0]) if day_first else parts[:2]))
    try:
        n = datetime.date(year, month, day).toordinal()
    except ValueError:
        return None
    days = _days("all" if sign != "/" else "late" if day > 12 else "early")
    place = bisect_left(days, n)
    if place == len(days) or days[place] != n:
        return None
    new = datetime.date.fromordinal(days[permute(place, len(days), key, f"date{len(days)}", back)])
    if sign == "-":
        return f"{new.year:04}-{new.month:02}-{new.day:02}"
    first, second = (new.day, new.month) if day_first else (new.month, new.day)
    return f"{first:02}{sign}{second:02}{sign}{new.year:04}"


@lru_cache
def _days(which: str) -> list[int]:
    """Days of FIRST_YEAR to LAST_YEAR: all, those of the month above 12, or the others."""
    first, last = datetime.date(FIRST_YEAR, 1, 1).toordinal(), datetime.date(LAST_YEAR, 12, 31).toordinal()
    late = lambda n: datetime.date.fromordinal(n).day > 12
    return [n for n in range(first, last + 1) if which == "all" or late(n) == (which == "late")]


def _email(found, key, back):
    local, _, host = found.rpartition("@")
    letters = "".join(c for c in local.lower() if c.isalpha())
    numbers = _digits(local)
    number = 0
    for c in letters:
        number = number * 26 + ord(c) - 97
    tweak = f"email|{host.lower()}|{''.join('a' if c.isalpha() else '0' if c.isdigit() else c for c in local)}"
    size = 26 ** len(letters) * 10 ** len(numbers)
    value = permute(number * 10 ** len(numbers) + int(numbers or 0), size, key, tweak, back)
    number, rest = divmod(value, 10 ** len(numbers))
    new = ""
    for _ in letters:
        number, c = divmod(number, 26)
        new = chr(97 + c) + new
    out = _fill(local, new, str.isalpha)
    out = "".join(c.upper() if old.isupper() else c for c, old in zip(out, local))
    out = _fill(out, str(rest).zfill(len(numbers)) if numbers else "")
    return f"{out}@{host}"


def _phone(found, key, back):
    digits = _digits(found)
    if not 7 <= len(digits) <= 15:
        return None
    lead = 0
    if found[0] == "+":  # the country code stays
        lead = len(_digits(regex.match(r"\+[0-9]{1,3}(?![0-9])|\+[0-9]", found).group()))
    return _fill(found, digits[:lead] + _number(digits[lead:], key, "phone", back))


def _national(found, key, back):
    return _fill(found, _number(_digits(found), key, "national", back))


HANDLERS = {"email": _email, "iban": _iban, "card": _card, "phone": _phone, "national": _national, "ip": _ip, "date": _date}


def pseudonym(kind: str, found: str, key: bytes, back: bool = False) -> str | None:
    """The pseudonym of a value, or None if the value does not pass the check of its kind."""
    return _remembered(kind, found, key, back) if len(found) <= REMEMBERED else HANDLERS[kind](found, key, back)


@lru_cache(maxsize=100_000)
def _remembered(kind: str, found: str, key: bytes, back: bool) -> str | None:
    return HANDLERS[kind](found, key, back)


class _Finder:
    """The leftmost match of any form from a place on; places are asked for in ascending order. Each character is looked
    at a bounded number of times, whatever runs it stands in."""

    def __init__(self, text: str):
        self.text, self.other, self.sign, self.host = text, None, text.find("@"), None
        self.begun = False

    def _email(self, look: int) -> tuple[int, int] | None:
        """Start and end of the first address that begins at `look` or later."""
        text = self.text
        while self.sign >= 0:
            if self.host is None:
                following = text.find("@", self.sign + 1)  # no host reaches beyond; the match looks no further for its dot
                self.host = HOST.match(text, self.sign + 1, following if following >= 0 else len(text)) or False
            if self.host and self.sign >= look:
                low = max(look, self.sign - LOCAL)
                edge = NOT_LOCAL.search(text, low, self.sign)
                first = PLAIN.search(text, edge.end() if edge else low, self.sign)
                if first:
                    return first.start(), self.host.end()
            self.sign, self.host = text.find("@", self.sign + 1), None
        return None

    def next(self, look: int) -> tuple[str, int, int] | None:
        """Kind, start and end."""
        if not self.begun or self.other is not None and self.other.start() < look:
            self.other, self.begun = ANY.search(self.text, look), True
        email, other = self._email(look), self.other
        if email and (other is None or email[0] <= other.start()):
            return "email", *email
        return (other.lastgroup, other.start(), other.end()) if other else None


def replace(text: str, key: bytes, back: bool = False) -> tuple[str, list[tuple[str, int, int]]]:
    """The text with pseudonyms, and (kind, start, length) of each in the new text."""
    if not HINT.search(text):
        return text, []
    out, spans, at, length, look, finder = [], [], 0, 0, 0, _Finder(text)
    while m := finder.next(look):
        kind, start, end = m
        new, found = _value(text, start, kind, text[start:end], key, back)
        if new is None and kind != "phone":  # another kind may begin at the same place
            kind, new, found = _second(text, start, kind, key, back)
        if new is None:
            look = start + 1
            while look < len(text) and text[look].isalnum():  # a rejected run is not searched from within
                look += 1
            continue
        out += [text[at:start], new]
        length += start - at
        spans.append((kind, length, len(new)))
        length += len(new)
        at = look = start + len(found)
    out.append(text[at:])
    return "".join(out), spans


ONE = {k: regex.compile(v) for k, v in FORMS.items()}


def _ends(text: str, start: int, kind: str, found: str) -> list[int]:
    """The lengths to try of a match, in order. A card number ends before a value of another form, else
    where it matched, else at a separator after 13 digits or more; an IBAN has its country's length."""
    ends = [k for k in range(1, len(found)) if found[k] in " -"]
    if kind == "card" and ends and ends[0] >= FIRST_GROUP:
        ends = [k for k in ends if len(_digits(found[:k])) >= 13]
        stop = next((k for k in ends if any(ONE[x].match(text, start + k + 1) for x in ("ip", "date", "national", "phone"))), len(found))
        return [stop, *[k for k in reversed(ends) if k < stop]]
    if kind == "iban":
        return [*[k for k in ends if len(found[:k].replace(" ", "")) == IBAN_LENGTHS.get(found[:2])], len(found)]
    return [len(found)]


def _value(text: str, start: int, kind: str, found: str, key: bytes, back: bool) -> tuple[str | None, str]:
    """The pseudonym of the first form of a match that passes the check, and what it replaces.

    Where a pseudonym together with what follows passes the check in a form tried before, the
    permutation is walked on, so that the way back finds the same value."""
    ends = _ends(text, start, kind, found)
    for n, end in enumerate(ends):
        if (new := pseudonym(kind, found[:end], key, back)) is not None:
            while any(pseudonym(kind, (new + found[end:])[:k], key, back) is not None for k in ends[:n]):
                new = pseudonym(kind, new, key, back)
            return new, found[:end]
    return None, found


def _second(text, start, tried, key, back):
    for kind in list(FORMS)[list(FORMS).index(tried) + 1:]:
        if m := ONE[kind].match(text, start):
            new, found = _value(text, start, kind, m.group(), key, back)
            if new is not None:
                return kind, new, found
    return tried, None, ""


def pseudonymise(key: bytes, back: bool = False):
    """A vectorised function text -> struct(text, spans array of kind, start, length)."""

    @F.pandas_udf("text string, spans array<struct<kind:string,start:int,length:int>>")
    def of(texts):
        import pandas as pd

        rows = [(None, []) if t is None else replace(t, key, back) for t in texts]
        return pd.DataFrame({"text": [a for a, _ in rows], "spans": [[{"kind": k, "start": s, "length": n} for k, s, n in b] for _, b in rows]})

    def apply(text: Column) -> Column:
        return of(text.cast("string"))

    return apply
