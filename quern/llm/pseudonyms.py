"""Personal data replaced by format-preserving Feistel pseudonyms.

Numbers, dates, addresses and secrets are found by pattern and checked (Luhn digit, IBAN remainder, octets, calendar);
each is then permuted within its own format by a keyed Feistel network, so equal values get equal pseudonyms in every
document, and different values different ones. A pseudonym of a card number is again a valid card number, one of a date
a valid date.

Results for odd input: a null text stays null with 0 findings; text without findings comes back as it was; overlapping
findings go to the one that starts first, and of these to the kind listed first. A number that runs on into others ends
before a finding of another kind in it, and where its check holds; what is left over is searched again.
"""

from __future__ import annotations

import datetime
import hashlib
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import without

ROUNDS = 10
DIGITS, LOWER, UPPER = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
ALPHABETS = {c: a for a in (DIGITS, LOWER, UPPER) for c in a}
#: Days that dates are permuted among: 1900-01-01 up to 2099-12-31.
FIRST_DAY, LAST_DAY = datetime.date(1900, 1, 1).toordinal(), datetime.date(2099, 12, 31).toordinal()


def feistel(value: int, left: int, right: int, key: bytes, tweak: str) -> int:
    """A keyed permutation of the numbers below left * right: halves take turns at being shifted by the other."""
    a, b = divmod(value, right)
    for i in range(0, ROUNDS, 2):
        a = (a + _shift(b, i, key, tweak)) % left
        b = (b + _shift(a, i + 1, key, tweak)) % right
    return a * right + b


def _shift(half: int, turn: int, key: bytes, tweak: str) -> int:
    said = f"{tweak}|{turn}|{half}".encode()
    return int.from_bytes(hashlib.blake2b(said, key=key, digest_size=64).digest(), "big")


def permute_below(value: int, size: int, key: bytes, tweak: str) -> int:
    """A keyed permutation of the numbers below size: walks on until it is back below size."""
    left = max(2, int(size**0.5))
    right = -(-size // left)
    while True:
        value = feistel(value, left, right, key, tweak)
        if value < size:
            return value


def permute_signs(text: str, key: bytes, tweak: str) -> str:
    """ASCII digits and letters permuted together, each within its class; all other signs stay in place."""
    places = [i for i, c in enumerate(text) if c in ALPHABETS]
    if not places:
        return text
    radices = [len(ALPHABETS[text[i]]) for i in places]
    value, half = 0, len(places) // 2
    for i, radix in zip(places, radices):
        value = value * radix + ALPHABETS[text[i]].index(text[i])
    left = right = 1
    for radix in radices[:half]:
        left *= radix
    for radix in radices[half:]:
        right *= radix
    shape = "".join("0" if c in DIGITS else "a" if c in LOWER else "A" if c in UPPER else c for c in text)
    value = feistel(value, left, right, key, f"{tweak}|{shape}")
    out = list(text)
    for i, radix in zip(reversed(places), reversed(radices)):
        value, at = divmod(value, radix)
        out[i] = ALPHABETS[text[i]][at]
    return "".join(out)


def _filled(shape: str, digits: str) -> str:
    """shape with its digits replaced in order."""
    new = iter(digits)
    return "".join(next(new) if c in DIGITS else c for c in shape)


def luhn_digit(digits: str) -> str:
    """The check digit that makes digits a valid card number."""
    total = sum(sum(divmod(int(c) * (2 if i % 2 == 0 else 1), 10)) for i, c in enumerate(reversed(digits)))
    return str(-total % 10)


def _digits(text: str) -> str:
    return "".join(c for c in text if c in DIGITS)


def is_card(text: str) -> bool:
    digits = _digits(text)
    return 13 <= len(digits) <= 19 and len(set(digits)) > 1 and luhn_digit(digits[:-1]) == digits[-1]


def card(text: str, key: bytes) -> str:
    body = permute_signs(_digits(text)[:-1], key, "card")
    return _filled(text, body + luhn_digit(body))


def _iban_rest(text: str) -> int:
    return int("".join(str(int(c, 36)) for c in text[4:] + text[:4])) % 97


def is_iban(text: str) -> bool:
    plain = text.replace(" ", "")
    return 15 <= len(plain) <= 34 and _iban_rest(plain) == 1


def iban(text: str, key: bytes) -> str:
    plain = text.replace(" ", "")
    body = permute_signs(plain[4:], key, f"iban|{plain[:2]}")
    new = iter(f"{plain[:2]}{98 - _iban_rest(f'{plain[:2]}00{body}'):02d}{body}")
    return "".join(c if c == " " else next(new) for c in text)


def is_ip(text: str) -> bool:
    return all(int(x) < 256 and str(int(x)) == x for x in text.split("."))


def ip(text: str, key: bytes) -> str:
    value = int.from_bytes(bytes(map(int, text.split("."))), "big")
    return ".".join(map(str, permute_below(value, 1 << 32, key, "ip").to_bytes(4, "big")))


def _day(text: str) -> tuple[int, str] | None:
    """Its day number and a format that writes it back; None if it is no date of the range."""
    for form in ("%Y-%m-%d", "%Y/%m/%d", "%d.%m.%Y", "%d/%m/%Y", "%m/%d/%Y"):
        try:
            day = datetime.datetime.strptime(text, form).date()
        except ValueError:
            continue
        if FIRST_DAY <= day.toordinal() <= LAST_DAY and day.strftime(form) == text:
            return day.toordinal(), form
    return None


def date(text: str, key: bytes) -> str:
    day, form = _day(text)
    new = FIRST_DAY + permute_below(day - FIRST_DAY, LAST_DAY - FIRST_DAY + 1, key, "date")
    return datetime.date.fromordinal(new).strftime(form)


def is_ssn(text: str) -> bool:
    area, group, serial = text.split("-")
    return area not in ("000", "666") and area < "900" and group != "00" and serial != "0000"


def ssn(text: str, key: bytes) -> str:
    value = int(_digits(text))
    while True:
        value = permute_below(value, 10**9, key, "ssn")
        new = _filled(text, f"{value:09d}")
        if is_ssn(new):
            return new


def is_phone(text: str) -> bool:
    """Seven to fifteen digits, and not four and twice two, which look like a date."""
    return 7 <= len(_digits(text)) <= 15 and not re.fullmatch(r"\d{4}[-./ ]\d\d[-./ ]\d\d|\d\d[-./ ]\d\d[-./ ]\d{4}", text)


def phone(text: str, key: bytes) -> str:
    """The country code after a plus sign stays; the other digits are permuted."""
    code = re.match(r"\+\d{1,3}(?=\D)", text)
    kept = code[0] if code else ""
    rest = text[len(kept) :]
    return kept + _filled(rest, permute_signs(_digits(rest), key, f"phone|{kept}"))


def email(text: str, key: bytes) -> str:
    """Name and domain are permuted apart, so equal domains stay linked; the last label stays."""
    name, _, domain = text.rpartition("@")
    labels, _, last = domain.rpartition(".")
    return f"{permute_signs(name, key, 'name')}@{permute_signs(labels, key, 'domain')}.{last}"


def secret(text: str, key: bytes) -> str:
    return permute_signs(text, key, "secret")


Check = Callable[[str], object] | None
#: kind, pattern, check, pseudonym. A pattern's group `v`, if it has one, is what gets replaced.
KINDS: tuple[tuple[str, str, Check, Callable[[str, bytes], str]], ...] = (
    ("email", r"(?<![A-Za-z0-9._%+\-])[A-Za-z0-9._%+\-]{1,64}@(?:[A-Za-z0-9\-]{1,63}\.){1,8}[A-Za-z]{2,24}(?![A-Za-z0-9\-])", None, email),
    ("secret", r"(?i:\b(?:password|passwd|pwd|token|secret|api[_\-]?key|access[_\-]?key)\b[\"']?\s{0,4}[=:]\s{0,4}[\"']?)(?P<v>[A-Za-z0-9_\-/+.~]{8,})", lambda t: any(c in DIGITS for c in t), secret),
    ("secret", r"(?<![A-Za-z0-9])(?:AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36}|sk-[A-Za-z0-9]{20,})(?![A-Za-z0-9])", None, secret),
    ("iban", r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])", is_iban, iban),
    ("ip", r"(?<![\w.])\d{1,3}(?:\.\d{1,3}){3}(?!\.?\w)", is_ip, ip),
    ("date", r"(?<![\w\-/.])(?:\d{4}-\d\d-\d\d|\d{4}/\d\d/\d\d|\d\d\.\d\d\.\d{4}|\d\d/\d\d/\d{4})(?![\w\-/])", _day, date),
    ("ssn", r"(?<![\w\-])\d{3}-\d\d-\d{4}(?![\w\-])", is_ssn, ssn),
    ("card", r"(?<![\w\-])\d(?:[ \-]?\d){12,18}(?![\w\-])", is_card, card),
    ("phone", r"(?<![\w+])(?:\+\d{1,3}[ .\-]?)?(?:\(\d{2,4}\)[ .\-]?)?\d{2,4}(?:[ .\-]\d{2,4}){1,4}(?![\w\-])|(?<![\w+])\+\d{7,15}(?!\w)", is_phone, phone),
)
FINDERS = tuple((kind, re.compile(pattern), check, make) for kind, pattern, check, make in KINDS)
#: A text without such signs has no findings.
HINT = re.compile("[0-9@]|(?i:token|secret|passw|pwd|key)")


#: Kinds whose patterns run on over blanks, and so may take in numbers behind the value.
WIDE = frozenset(("iban", "card", "phone"))
CARD, PHONE = (next(i for i, k in enumerate(KINDS) if k[0] == kind) for kind in ("card", "phone"))
#: How cards are written.
LAYOUT = re.compile(r"\d{13,19}|\d{4}(?:[ \-]\d{4}){2,3}(?:[ \-]\d{1,4})?|\d{4}[ \-]\d{6}[ \-]\d{4,5}")
#: Kinds that a card or phone must not take in; a phone no card either, though one in ten numbers has a card's check digit.
APART = frozenset(i for i, k in enumerate(KINDS) if k[0] not in ("ssn", "card", "phone"))
Found = tuple[int, int, int]


def _shorter(text: str, order: int, start: int, end: int) -> int | None:
    """The last end before `end` where a wide match of this start is whole groups and its check holds."""
    _, pattern, check, _ = FINDERS[order]
    for at in range(end - 1, start, -1):
        if text[at] in " ." and pattern.fullmatch(text, start, at) and check(text[start:at]):
            return at
    return None


def _next(text: str, order: int, at: int) -> Found | None:
    """Start, kind's place and end of the next match of a kind whose check holds."""
    kind, pattern, check, _ = FINDERS[order]
    while m := pattern.search(text, at):
        start, end = m.span("v") if "v" in pattern.groupindex else m.span()
        if check is None or check(text[start:end]):
            return start, order, end
        if kind in WIDE and (end := _shorter(text, order, start, end)):
            return start, order, end
        at = m.start() + 1
    return None


def find(text: str) -> list[tuple[int, int, int]]:
    """Start, end and kind's place of what is replaced, in order, without overlap."""
    if not HINT.search(text):
        return []
    coming = {i: f for i in range(len(FINDERS)) if (f := _next(text, i, 0))}
    out = []
    while coming:
        _narrow(text, coming, CARD, APART)
        if min(coming.values())[1] == PHONE and not _narrow(text, coming, PHONE, APART | {CARD}):
            continue
        start, order, end = min(coming.values())
        out.append((start, end, order))
        for i in [i for i, f in coming.items() if f[0] < end]:
            _advance(text, coming, i, end)
    return out


def _narrow(text: str, coming: dict[int, Found], order: int, apart: frozenset[int]) -> bool:
    """Ends a match before the first of other kinds in it, or goes on to the next match: whether the same start stays."""
    moved = False
    while order in coming:
        start, _, end = coming[order]
        inner = min((coming[i][:2] for i in apart if i in coming and start < coming[i][0] < end), default=None)
        if inner is None:
            break
        shorter = _shorter(text, order, start, inner[0])
        if shorter:
            coming[order] = start, order, shorter
        elif inner[1] == CARD and (text[start] in "+(" or not LAYOUT.fullmatch(text, *coming[CARD][::2])):
            break  # rather a phone than a card, whose check digit is chance
        else:
            moved = True
            _advance(text, coming, order, start + 1)
    return not moved


def _advance(text: str, coming: dict[int, Found], order: int, at: int) -> None:
    found = _next(text, order, at)
    if found:
        coming[order] = found
    else:
        del coming[order]


def pseudonymised(text: str, key: bytes) -> tuple[str, list[str]]:
    """The text with pseudonyms, and the kinds found in order."""
    parts, kinds, at = [], [], 0
    for start, end, order in find(text):
        kind, _, _, make = FINDERS[order]
        parts += [text[at:start], make(text[start:end], key)]
        kinds.append(kind)
        at = end
    return ("".join([*parts, text[at:]]), kinds) if kinds else (text, [])


#: Texts that a task holds at once.
TEXTS = 256


def pseudonymise(df: DataFrame, key: bytes, text: str = "text", counts: str | None = "n_private") -> DataFrame:
    """df with its text column replaced, and the number of findings in `counts` (None: left out).

    The text keeps its place among the columns; a column of df named as `counts` is replaced.
    """

    @F.arrow_udf("text string, n long")
    def replaced(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            for at in range(0, len(batch), TEXTS):  # few texts at a time
                rows = [(None, 0) if t is None else ((p := pseudonymised(t, key))[0], len(p[1])) for t in batch.slice(at, TEXTS).to_pylist()]
                yield pa.StructArray.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.int64())], ["text", "n"])

    df = without(df, counts) if counts else df
    # Names are compared as Spark does, in any letter case, or the text itself would be passed on.
    kept = [F.col("__new.text").alias(c) if c.lower() == text.lower() else F.col(f"`{c}`") for c in df.columns]
    out = df.withColumn("__new", replaced(F.col(f"`{text}`")))
    return out.select(*kept, *([F.col("__new.n").alias(counts)] if counts else []))
