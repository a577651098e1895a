"""Format-preserving pseudonyms for personal data.

Numbers, dates and addresses that pass the checks of their kind are numbered within their format,
and the number is permuted by a keyed Feistel network. The same value always gets the same
pseudonym, wherever it stands; other values get other ones; whoever has the key can turn them back.
"""

from __future__ import annotations

import datetime
import hashlib
import re
from bisect import bisect_left
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from functools import cache

from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from hushlog.llm.arrow import append_columns, free_names

ROUNDS = 8


def permute(value: int, size: int, key: bytes, tweak: str, back: bool = False) -> int:
    """A permutation of ``range(size)``: a balanced Feistel network, walked until it lands inside."""
    if size < 2:
        return value
    half = max(1, ((size - 1).bit_length() + 1) // 2)
    mask, width = (1 << half) - 1, (half + 7) // 8
    rounds = range(ROUNDS)[::-1] if back else range(ROUNDS)

    def mix(n: int, part: int) -> int:
        h = hashlib.blake2b(part.to_bytes(width, "big"), key=key, digest_size=min(64, width + 8))
        h.update(f"{n}/{size}/{tweak}".encode())
        return int.from_bytes(h.digest(), "big") & mask

    while True:
        left, right = value >> half, value & mask
        for n in rounds:
            if back:
                left, right = right ^ mix(n, left), left
            else:
                left, right = right, left ^ mix(n, right)
        value = left << half | right
        if value < size:
            return value


def changed(value: int, size: int, key: bytes, tweak: str, back: bool = False) -> int:
    """As ``permute``, but never the value itself: a cycle of all values, entered by the key.

    The values are taken in the order of a permutation and each is replaced by the next one.
    """
    if size < 2:
        return value
    place = permute(value, size, key, tweak, back=True)
    return permute((place + (-1 if back else 1)) % size, size, key, tweak)


DIGITS, SMALL, LARGE = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
HEX = "0123456789abcdef"


def _letters(text: str, hexadecimal: bool = False) -> list[str | None]:
    """The alphabet that each character stays in; None where it stays as it is."""
    if hexadecimal:
        return [HEX if c in HEX else HEX.upper() for c in text]
    sets = (DIGITS, SMALL, LARGE)
    return [next((s for s in sets if c in s), None) for c in text]


#: Characters permuted as one number. A longer text goes block by block.
BLOCK = 128


def _spelled(text: str, alphabets: Sequence[str | None], key: bytes, tweak: str, back: bool) -> str:
    """``text`` with its characters permuted together, each within its alphabet.

    Each block of a long text is permuted by the text's length and the blocks before it.
    """
    if len(text) <= BLOCK:
        return _block(text, alphabets, key, tweak, back)
    out, before = [], hashlib.blake2b(key=key, digest_size=16)
    for at in range(0, len(text), BLOCK):
        old, chain = text[at : at + BLOCK], f"{tweak}/{len(text)}/{before.hexdigest()}"
        new = _block(old, alphabets[at : at + BLOCK], key, chain, back)
        before.update((new if back else old).encode())
        out.append(new)
    return "".join(out)


def _block(text: str, alphabets: Sequence[str | None], key: bytes, tweak: str, back: bool) -> str:
    number, size = 0, 1
    for c, alphabet in zip(text, alphabets):
        if alphabet:
            number, size = number * len(alphabet) + alphabet.index(c), size * len(alphabet)
    number = changed(number, size, key, tweak, back)
    out = []
    for c, alphabet in zip(reversed(text), reversed(alphabets)):
        if alphabet:
            number, place = divmod(number, len(alphabet))
            c = alphabet[place]
        out.append(c)
    return "".join(reversed(out))


def _in_digits(text: str, make: Callable[[str], str | None]) -> str | None:
    """``make`` on the digits alone; what stands between them stays."""
    digits = re.sub(r"\D", "", text)
    new = make(digits)
    if new is None:
        return None
    rest = iter(new)
    return "".join(next(rest) if c.isdigit() else c for c in text)


def luhn_digit(payload: str) -> str:
    total = 0
    for i, c in enumerate(reversed(payload)):
        n = int(c) * (2 if i % 2 == 0 else 1)
        total += n - 9 if n > 9 else n
    return str(-total % 10)


def card(text: str, key: bytes, back: bool) -> str | None:
    """Payment card number, 13 to 19 digits with a valid check digit; its first digit stays."""

    def make(digits: str) -> str | None:
        if not 13 <= len(digits) <= 19 or luhn_digit(digits[:-1]) != digits[-1]:
            return None
        inner = digits[1:-1]
        new = changed(int(inner), 10 ** len(inner), key, f"card{digits[0]}", back)
        payload = digits[0] + str(new).zfill(len(inner))
        return payload + luhn_digit(payload)

    return _in_digits(text, make)


def phone(text: str, key: bytes, back: bool) -> str | None:
    """Ten digits written as a North American number, with or without its +1."""

    def make(digits: str) -> str | None:
        lead, local = digits[:-10], digits[-10:]
        if len(local) < 10 or lead not in ("", "1"):
            return None
        return lead + str(changed(int(local), 10**10, key, "phone", back)).zfill(10)

    return _in_digits(text, make)


def international(text: str, key: bytes, back: bool) -> str | None:
    """Other numbers behind a plus: 8 to 15 digits, of which the first two stay."""

    def make(digits: str) -> str | None:
        if not 8 <= len(digits) <= 15 or digits[0] in "01":
            return None
        local = digits[2:]
        new = changed(int(local), 10 ** len(local), key, f"call{digits[:2]}", back)
        return digits[:2] + str(new).zfill(len(local))

    return _in_digits(text, make)


def social(text: str, key: bytes, back: bool) -> str | None:
    """Social security number: no area 000, 666 or from 900 on, no group 00, no serial 0000."""
    area, group, serial = (int(part) for part in text.split("-"))
    if area in (0, 666) or area >= 900 or not group or not serial:
        return None
    place = (area - 1 - (area > 666)) * 99 + group - 1  # areas 1 to 665 and 667 to 899
    number = changed(place * 9999 + serial - 1, 898 * 99 * 9999, key, "social", back)
    number, serial = divmod(number, 9999)
    area, group = divmod(number, 99)
    return f"{area + 1 + (area >= 665):03d}-{group + 1:02d}-{serial + 1:04d}"


def address(text: str, key: bytes, back: bool) -> str | None:
    """IPv4 address."""
    parts = text.split(".")
    if any(int(p) > 255 or (len(p) > 1 and p[0] == "0") for p in parts):
        return None
    number = int.from_bytes(bytes(map(int, parts)), "big")
    return ".".join(map(str, changed(number, 1 << 32, key, "ip", back).to_bytes(4, "big")))


def iban(text: str, key: bytes, back: bool) -> str | None:
    """International account number with valid check digits; country and format stay."""
    plain = text.replace(" ", "")
    if not 15 <= len(plain) <= 34:
        return None

    def check(country: str, account: str) -> str:
        number = "".join(str(int(c, 36)) for c in account + country + "00")
        return f"{98 - int(number) % 97:02d}"

    country, account = plain[:2], plain[4:]
    if check(country, account) != plain[2:4]:
        return None
    account = _spelled(account, _letters(account), key, f"iban{country}", back)
    rest = iter(country + check(country, account) + account)
    return "".join(c if c == " " else next(rest) for c in text)


def email(text: str, key: bytes, back: bool) -> str | None:
    """Mail address: every letter and digit but for those of the last domain label."""
    front, dot, last = text.rpartition(".")
    return _spelled(front, _letters(front), key, "mail", back) + dot + last


def access_key(text: str, key: bytes, back: bool) -> str | None:
    """Cloud access key: its four-letter prefix stays."""
    return text[:4] + _spelled(text[4:], [DIGITS + LARGE] * (len(text) - 4), key, "access", back)


def secret(text: str, key: bytes, back: bool) -> str | None:
    """What is assigned to a password, token or key: six characters or more up to a quote, an angle
    bracket, white space or closing punctuation, with a digit among them.

    Keys of known platforms and clouds are those here too, so they stay linked with bare ones.
    """
    for pattern, make in KNOWN:
        if pattern.fullmatch(text):
            return make(text, key, back)
    hexadecimal = len(text) >= 8 and (set(text) <= set(HEX) or set(text) <= set(HEX.upper()))
    alphabets = _letters(text)
    if hexadecimal:
        alphabets = [HEX if set(text) <= set(HEX) else HEX.upper()] * len(text)
    while True:  # a secret has a digit and is no known key, so its pseudonym must be such a text
        text = _spelled(text, alphabets, key, "secret", back)
        if any(c in DIGITS for c in text) and not any(p.fullmatch(text) for p, _ in KNOWN):
            return text


FIRST_DAY, LAST_DAY = datetime.date(1900, 1, 1), datetime.date(2099, 12, 31)
MONTHS = [datetime.date(2000, m, 1).strftime("%B") for m in range(1, 13)]


def _class_of(month: int, day: int) -> tuple[bool, int]:
    """Dates that take the same numbers of digits, and after whose day no month could be meant."""
    return month >= 10, (day >= 10) + (day >= 13)


@cache
def _days() -> dict[tuple[bool, int], list[tuple[int, int, int]]]:
    """All days from the first to the last by class, in order."""
    days: dict[tuple[bool, int], list[tuple[int, int, int]]] = {}
    for number in range(FIRST_DAY.toordinal(), LAST_DAY.toordinal() + 1):
        at = datetime.date.fromordinal(number)
        days.setdefault(_class_of(at.month, at.day), []).append((at.year, at.month, at.day))
    return days


def date(text: str, key: bytes, back: bool) -> str | None:
    """Date of 1900 to 2099 as year-month-day, day.month.year, month/day/year or with a month's name.

    A slashed date whose first number can't be a month is day/month/year. A day is replaced by one of
    its class, so every way of writing it keeps its widths and order, and all share the pseudonym.
    """
    numbers = re.findall(r"\d+", text)
    name = re.search(r"[A-Za-z]{3,}", text)
    if name:
        order = "dy"
    elif len(numbers[0]) == 4:
        order = "ymd"
    else:
        order = "mdy" if "/" in text and int(numbers[0]) <= 12 else "dmy"
    parts = dict(zip(order, map(int, numbers)))
    if name:
        parts["m"] = next((i for i, m in enumerate(MONTHS, 1) if m.lower() == name.group().lower()), 0)
    old = parts["y"], parts["m"], parts["d"]
    days = _days().get(_class_of(*old[1:]), [])
    place = bisect_left(days, old)
    if place == len(days) or days[place] != old:
        return None
    tweak = "day{}{}".format(*_class_of(*old[1:]))
    parts = dict(zip("ymd", days[changed(place, len(days), key, tweak, back)]))
    slots = iter(order)

    def like(match: re.Match) -> str:
        piece = match.group()
        if piece.isdigit():
            return str(parts[next(slots)]).zfill(len(piece))
        full = MONTHS[parts["m"] - 1]
        return full.upper() if piece.isupper() else full.lower() if piece.islower() else full

    return re.sub(r"\d+|[A-Za-z]+", like, text)


def platform_key(text: str, key: bytes, back: bool) -> str | None:
    """Key of a known platform: its prefix up to the first dash or line stays."""
    head = re.match(r"AIza|[a-z]+[_-]", text).end()
    return text[:head] + _spelled(text[head:], _letters(text[head:]), key, "platform", back)


def _group_ends(text: str) -> list[int]:
    """Where a group of digits ends, the longest first."""
    return [m.end() for m in re.finditer(r"\d+\)?", text)][::-1]


def _card_ends(text: str) -> list[int]:
    """All of the text, then shorter ends; one way of grouping, and short groups if there are any."""
    return [
        end
        for end in _group_ends(text)
        if text[:end].isdigit()
        or len(set(re.findall(r"\D", text[:end]))) == 1
        and max(map(len, re.findall(r"\d+", text[:end]))) <= 6
    ]


#: Characters of an account number by country.
IBAN_CHARS = {
    country: int(n)
    for n, countries in (
        entry.split(":")
        for entry in (
            "15:NO 16:BE 18:DK,FI,FK,FO,GL,NL,SD 19:MK,MN,SI 20:AT,BA,EE,KZ,LT,LU,XK 21:CH,HR,LI,LV"
            " 22:BG,BH,CR,DE,GB,GE,IE,ME,RS,VA 23:AE,GI,IL,IQ,OM,SO,TL"
            " 24:AD,CZ,ES,MD,PK,RO,SA,SE,SK,TN,VG 25:LY,PT,ST 26:IS,TR 27:BI,DJ,FR,GR,IT,MC,MR,SM"
            " 28:AL,AZ,BY,CY,DO,GT,HN,HU,LB,NI,PL,SV 29:BR,EG,PS,QA,UA 30:JO,KW,MU 31:MT,SC 32:LC 33:RU"
        ).split()
    )
    for country in countries.split(",")
}


def _account_ends(text: str) -> list[int]:
    """The length of the country first; all of the text; for other countries each group's end."""
    ends = [m.end() for m in re.finditer(r"[A-Z0-9]+", text)][::-1]
    if text[:2] not in IBAN_CHARS:
        return ends
    own = [end for end in ends if end - text.count(" ", 0, end) == IBAN_CHARS[text[:2]]]
    return own + ends[:1]


@dataclass(frozen=True)
class Kind:
    """``make`` gets what the pattern found (its group ``v``, if it has one) and gives the pseudonym,
    or None where a check fails. A text without ``sign`` is not searched. ``ends`` gives the ends of a
    match to try, for patterns that may take in what stands behind a value; where all of them fail,
    the next start is tried."""

    name: str
    pattern: str
    make: Callable[[str, bytes, bool], str | None]
    sign: str = r"\d"
    ends: Callable[[str], list[int]] | None = None


MONTH = "(?:" + "|".join(MONTHS) + ")"
PLATFORM_KEY = r"(?:gh[pousr]_[A-Za-z0-9]{36}|sk-[A-Za-z0-9]{20,64}|xox[baprs]-[A-Za-z0-9-]{10,64}|AIza[\w-]{35})"
ACCESS_KEY = r"(?:AKIA|ASIA|AROA|AIDA)[A-Z0-9]{16}"
#: What may also be assigned as a secret.
KNOWN = [(re.compile(p, re.ASCII), make) for p, make in ((PLATFORM_KEY, platform_key), (ACCESS_KEY, access_key))]

#: Earlier kinds win where two overlap.
KINDS: tuple[Kind, ...] = (
    Kind(
        "email",
        r"(?<![\w.+%-])[A-Za-z0-9._%+-]{1,64}@(?:[A-Za-z0-9-]{1,63}\.){1,8}[A-Za-z]{2,24}(?![\w-])",
        email,
        "@",
    ),
    Kind(
        "secret",
        r"(?i:\b(?:password|passwd|pwd|secret|token|api[_-]?key|access[_-]?key)\b)[\"']?\s{0,3}[:=]\s{0,3}[\"']?"
        r"(?P<v>(?=[^\s\"'<>]*\d)[^\s\"'<>]{5,}[^\s\"'<>.,;:!?)\]}])",
        secret,
    ),
    Kind(
        "platform_key",
        rf"\b{PLATFORM_KEY}\b",
        platform_key,
        "gh._|sk-|xox|AIza",
    ),
    Kind("access_key", rf"\b{ACCESS_KEY}\b", access_key, "A[KSRI]"),
    Kind("iban", r"\b[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?\b", iban, ends=_account_ends),
    Kind("card", r"(?<![\d.-])\d(?:[ -]?\d){12,18}(?!\d|[.-]\d)", card, ends=_card_ends),
    Kind("ip", r"(?<![\d.])\d{1,3}(?:\.\d{1,3}){3}(?!\d|\.\d)", address),
    Kind("social", r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])", social),
    Kind(
        "phone",
        r"(?<![\w+])(?:\+?1[ .-]?)?(?:\(\d{3}\) ?|\d{3}[ .-])\d{3}[ .-]\d{4}(?!\d|-\d)",
        phone,
    ),
    Kind("phone", r"(?<![\w+])\+[2-9]\d{0,2}(?:[ .-]?\(?\d{1,4}\)?){2,6}(?!\d)", international, r"\+", _group_ends),
    Kind("date", r"(?<![\d/.-])\d{4}([-/.])\d{1,2}\1\d{1,2}(?![\d/-]|\.\d)", date),
    Kind("date", r"(?<![\d/.-])\d{1,2}([-/.])\d{1,2}\1\d{4}(?![\d/-]|\.\d)", date),
    Kind("date", rf"(?i:\b\d{{1,2}} {MONTH} \d{{4}}\b)", date),
    Kind("date", rf"(?i:\b{MONTH} \d{{1,2}},? \d{{4}}\b)", date),
)
_PATTERNS = [(kind, re.compile(kind.pattern, re.ASCII), re.compile(kind.sign, re.ASCII)) for kind in KINDS]


#: Characters around crowded values that decide what is found there; no match of a pattern with
#: several ends is longer.
AROUND = 80
#: Start, end, place of the kind in ``KINDS`` and pseudonym.
Found = tuple[int, int, int, str]


def _candidates(rank: int, text: str, taken: bytearray) -> Iterator[tuple[int, int]]:
    """Places to try that nothing has taken yet."""
    kind, pattern, _ = _PATTERNS[rank]
    at = 0
    while match := pattern.search(text, at):
        start, end = match.span("v") if "v" in pattern.groupindex else match.span()
        at = match.start() + 1
        for length in kind.ends(match.group()) if kind.ends else [end - start]:
            end = start + length
            if any(taken[start:end]):
                continue
            yield start, end
            if taken[start] or not kind.ends:
                at = end
                break


def _detected(text: str, key: bytes, back: bool) -> tuple[list[Found], list[tuple[int, int]]]:
    """Values with their pseudonyms, and the places that overlap them and were tried in vain before."""
    taken = bytearray(len(text))
    found, failed = [], []
    for rank, (kind, _, sign) in enumerate(_PATTERNS):
        if not sign.search(text):
            continue
        for start, end in _candidates(rank, text, taken):
            new = kind.make(text[start:end], key, back)
            if new is None:
                failed.append((start, end))
            else:
                taken[start:end] = b"\1" * (end - start)
                found.append((start, end, rank, new))
    return sorted(found), [(a, b) for a, b in failed if any(taken[a:b])]


def _crowds(found: list[Found], failed: list[tuple[int, int]]) -> list[list[Found]]:
    """Values in groups; places tried in vain hold those of a group together."""
    groups: list[list[Found]] = []
    end = -1
    for place in sorted([*found, *failed], key=lambda p: p[:2]):
        if place[0] >= end:
            groups.append([])
        end = max(end, place[1])
        groups[-1].append(place)
    return groups


def _walked(text: str, group: list[Found], key: bytes, back: bool) -> list[Found]:
    """The values of a group replaced again and again, all at once, until the same places are found in
    the new text. So the way back passes the same steps."""
    first, last = min(p[0] for p in group), max(p[1] for p in group)
    values = [p for p in group if len(p) > 2]
    low = max(0, first - AROUND)
    news = [p[3] for p in values]
    while True:
        piece, at, places = text[low:first], first, []
        for (start, end, rank, _), new in zip(values, news):
            piece += text[at:start]
            places.append((len(piece), len(piece) + len(new), rank))
            piece += new
            at = end
        piece += text[at:last]
        inside = range(first - low, len(piece))
        again, _ = _detected(piece + text[last : last + AROUND], key, back)
        if [p[:3] for p in again if p[0] < inside.stop and p[1] > inside.start] == places:
            return [(*p[:3], new) for p, new in zip(values, news)]
        # pseudonyms are values of their kind
        news = [KINDS[p[2]].make(new, key, back) or new for p, new in zip(values, news)]


def pseudonymised(text: str, key: bytes, back: bool = False) -> tuple[str, list[tuple[str, int, int]]]:
    """``text`` with pseudonyms, and the kind and place of each in the new text.

    With ``back`` the pseudonyms are turned into the values they stand for. Where a value stands so
    near others that a pseudonym could make another match, all of them are replaced until it doesn't.
    """
    found, failed = _detected(text, key, back)
    if failed:
        groups = _crowds(found, failed)
        found = [p for g in groups for p in (_walked(text, g, key, back) if any(len(f) == 2 for f in g) else g)]
    out, places, at, length = [], [], 0, 0
    for start, end, rank, new in found:
        out += (text[at:start], new)
        length += start - at
        places.append((KINDS[rank].name, length, length + len(new)))
        length += len(new)
        at = end
    out.append(text[at:])
    return "".join(out), places


def with_pseudonyms(
    docs: DataFrame, key: bytes, text: str = "text", back: bool = False
) -> DataFrame:
    """``docs`` with personal data in the text column replaced, and ``pii``: kind, start and end of
    each pseudonym in the new text, in characters.

    A null text stays null with an empty ``pii``; an empty table gives an empty one. Texts of any
    length are read whole. Values that fail the check of their kind stay as they are. Rows and other columns stay; a column named ``pii`` is replaced. The text column
    keeps its place.
    """
    places = StructType(
        [
            StructField("kind", StringType()),
            StructField("start", IntegerType()),
            StructField("end", IntegerType()),
        ]
    )

    def make(texts: list[str | None]):
        done = [(None, []) if t is None else pseudonymised(t, key, back) for t in texts]
        return (
            [new for new, _ in done],
            [[{"kind": k, "start": a, "end": b} for k, a, b in found] for _, found in done],
        )

    (changed_text,) = free_names(docs.columns, 1, "text")
    fields = [StructField(changed_text, StringType()), StructField("pii", ArrayType(places))]
    made = append_columns(docs, fields, make, text)
    others = [c for c in made.columns if c not in (changed_text, "pii")]
    return made.select(*[made[changed_text].alias(c) if c == text else made[c] for c in others], "pii")
