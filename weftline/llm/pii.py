"""Personal data replaced by format-preserving pseudonyms: a keyed Feistel permutation of each format's own values."""

from __future__ import annotations

import bisect
import datetime as dt
import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from weftline.llm import _bytes as B
from weftline.llm._shared import fresh

ROUNDS = 10


def permute(x: int, size: int, key: bytes, tweak: str, undo: bool = False) -> int:
    """A permutation of range(size): a balanced Feistel network on the next even number of bits, walked until it is back in range."""
    if size < 2:
        return x
    half = ((size - 1).bit_length() + 1) // 2
    mask, width = (1 << half) - 1, (half + 7) // 8

    def f(r: int, v: int) -> int:
        h = hashlib.blake2b(v.to_bytes(width, "big"), key=key, digest_size=max(width, 8), person=r.to_bytes(4, "big"), salt=b"")
        h.update(tweak.encode())
        return int.from_bytes(h.digest(), "big") & mask

    while True:
        a, b = x >> half, x & mask
        if undo:
            for r in reversed(range(ROUNDS)):
                a, b = b ^ f(r, a), a
        else:
            for r in range(ROUNDS):
                a, b = b, a ^ f(r, b)
        x = a << half | b
        if x < size:
            return x


def luhn_digit(payload: str) -> str:
    t = 0
    for i, c in enumerate(reversed(payload)):
        d = int(c)
        t += d if i % 2 else (d * 2 - 9 if d > 4 else d * 2)
    return str(-t % 10)


def _mod97(s: str) -> int:
    return int("".join(str(int(c, 36)) for c in s)) % 97


_CLASSES = (
    "0123456789",
    "abcdefghijklmnopqrstuvwxyz",
    "ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    "ßàáâãäåæçèéêëìíîïðñòóôõöøùúûüýþÿ",
    "ÀÁÂÃÄÅÆÇÈÉÊËÌÍÎÏÐÑÒÓÔÕÖØÙÚÛÜÝÞ",
)
_CLASS = {c: (k, i) for k, cs in enumerate(_CLASSES) for i, c in enumerate(cs)}


def _classwise(s: str, key: bytes, tweak: str, undo: bool, classes: tuple[str, ...] = _CLASSES) -> str:
    """Characters replaced by others of their class, all as one number of mixed radix; characters of no class stay."""
    where = {c: (cs, i) for cs in classes for i, c in enumerate(cs)} if classes is not _CLASSES else {c: (_CLASSES[k], i) for c, (k, i) in _CLASS.items()}
    x, size, shape = 0, 1, []
    for c in s:
        if c in where:
            cs, i = where[c]
            x, size = x * len(cs) + i, size * len(cs)
            shape.append(cs)
        else:
            shape.append(c)
    pattern = ",".join(cs[0] if len(cs) > 1 else "=" + cs for cs in shape)
    y = permute(x, size, key, tweak + pattern, undo)
    out = []
    for cs in reversed(shape):
        if len(cs) > 1:
            y, i = divmod(y, len(cs))
            out.append(cs[i])
        else:
            out.append(cs)
    return "".join(reversed(out))


_DIGITS = ("0123456789",)


def _refill(form: str, digits: str) -> str:
    it = iter(digits)
    return "".join(next(it) if c.isdigit() else c for c in form)


def _email(s: str, key: bytes, undo: bool) -> str:
    local, _, domain = s.partition("@")
    return _classwise(local, key, "email@" + domain.lower(), undo) + "@" + domain


def _is_card(d: str) -> bool:
    return 13 <= len(d) <= 19 and luhn_digit(d[:-1]) == d[-1] and bool(d.strip("0"))


def _card(d: str, key: bytes, undo: bool) -> str:
    p = _classwise(d[:-1], key, "card", undo, _DIGITS)
    return p + luhn_digit(p)


#: Digits in the groups of printed cards; a single group is one too.
_PRINTED = {(4, 4, 4, 4, 3), (4, 4, 4, 4), (4, 6, 5), (4, 6, 4)}


def _cards(s: str, key: bytes, undo: bool) -> list[tuple[int, int, str]]:
    """Ranges of the cards in ``s``, digits in groups, and what replaces them.

    Runs of groups of 13 to 19 digits are tried, those grouped like printed
    cards first, then the longest, then the first.  A card is replaced by the
    next of its cycle with which no run tried before it becomes valid, so that
    the text is read the same way again.
    """
    groups = [m.span() for m in re.finditer(r"\d+", s)]
    digits = "".join(s[a:b] for a, b in groups)
    first = [0]
    for a, b in groups:
        first.append(first[-1] + b - a)
    # sums of the digits as the Luhn check counts them, those of even and of odd places doubled, and how many are not 0
    sums, some = ([0], [0]), [0]
    for k, c in enumerate(digits):
        d = int(c)
        twice = d * 2 - 9 if d > 4 else d * 2
        sums[k % 2].append(sums[k % 2][-1] + twice)
        sums[1 - k % 2].append(sums[1 - k % 2][-1] + d)
        some.append(some[-1] + (d > 0))
    tries, right = [], set()
    for i in range(len(groups)):
        for j in range(i + 1, len(groups) + 1):
            x, y = first[i], first[j]
            if y - x > 19:
                break
            if y - x >= 13:
                shape = () if j - i > 5 else tuple(b - a for a, b in groups[i:j])
                tries.append((j - i > 1 and shape not in _PRINTED, x - y, i, j))
                if (sums[y % 2][y] - sums[y % 2][x]) % 10 == 0 and some[y] > some[x]:
                    right.add((i, j))
    if not right:
        return []
    used = [False] * len(groups)
    cards, failed = [], []
    for _, _, i, j in sorted(tries):
        if any(used[i:j]):
            continue
        if (i, j) in right:
            used[i:j] = [True] * (j - i)
            cards.append((i, j, len(failed)))
        else:
            failed.append((i, j))
    beside = {g for i, j, _ in cards for g in range(i, j)}
    over: dict[int, list[tuple[int, int, int]]] = {}  # by group of a card: the failed runs that have it, at most 19 groups long each
    for k, (i, j) in enumerate(failed):
        for g in range(i, j):
            if g in beside:
                over.setdefault(g, []).append((k, i, j))
    # each depends on those replaced before it: undone in the opposite order
    parts = list(digits)
    for i, j, n in reversed(cards) if undo else cards:
        near = [(first[x], first[y]) for k, x, y in sorted({r for g in range(i, j) for r in over.get(g, ())}) if k < n]
        a, b = first[i], first[j]
        while True:
            parts[a:b] = _card("".join(parts[a:b]), key, undo)
            if not any(_is_card("".join(parts[x:y])) for x, y in near):
                break
    out = []
    for i, j, _ in cards:
        a, b = groups[i][0], groups[j - 1][1]
        out.append((a, b, _refill(s[a:b], "".join(parts[first[i] : first[j]]))))
    return out


#: Assigned country codes (E.164), none of which begins another; of 21, 22 and so on the third digit counts.
_COUNTRY = re.compile(
    "1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]"
    "|21[1-368]|22\\d|23\\d|24\\d|25[0-8]|26\\d|29[01789]|35\\d|37\\d|38[0-35-79]|42[013]|50\\d|59\\d"
    "|67[02-9]|68[0-35-9]|69[0-2]|80[08]|85[02356]|87[0-48]|88[0-368]|96[0-8]|97[0-79]|99[2-68]"
)


def _phone(s: str, key: bytes, undo: bool) -> str | None:
    """The country code stays: the digits up to a separator within three, else those of the table."""
    m = re.match(r"\+(\d{1,3})(?=\D)", s)
    cc = m.group(1) if m else (c := _COUNTRY.match(s, 1)) and c.group()
    d = re.sub(r"\D", "", s)
    if not cc or not 8 <= len(d) <= 15:
        return None
    return _refill(s, cc + _classwise(d[len(cc) :], key, "phone" + cc, undo, _DIGITS))


def _ssn(s: str, key: bytes, undo: bool) -> str | None:
    a, g, n = map(int, s.split("-"))
    if a in (0, 666) or a >= 900 or not g or not n:
        return None
    x = ((a - 1 - (a > 666)) * 99 + g - 1) * 9999 + n - 1
    x, n = divmod(permute(x, 898 * 99 * 9999, key, "ssn", undo), 9999)
    a, g = divmod(x, 99)
    return f"{a + 1 + (a + 1 >= 666):03d}-{g + 1:02d}-{n + 1:04d}"


def _ip(s: str, key: bytes, undo: bool) -> str | None:
    parts = s.split(".")
    if any(int(p) > 255 or (len(p) > 1 and p[0] == "0") for p in parts):
        return None
    x = permute(int.from_bytes(bytes(map(int, parts)), "big"), 1 << 32, key, "ipv4", undo)
    return ".".join(map(str, x.to_bytes(4, "big")))


def _iban(s: str, key: bytes, undo: bool) -> str | None:
    t = s.replace(" ", "")
    if not 15 <= len(t) <= 34 or _mod97(t[4:] + t[:4]) != 1:
        return None
    body = _classwise(t[4:], key, "iban" + t[:2], undo, _CLASSES[:3])
    t = t[:2] + f"{98 - _mod97(body + t[:2] + '00'):02d}" + body
    it = iter(t)
    return "".join(" " if c == " " else next(it) for c in s)


def _day(y: int, m: int, d: int) -> int | None:
    try:
        return dt.date(y, m, d).toordinal()
    except ValueError:
        return None


def _move(day: int, key: bytes, tweak: str, undo: bool) -> int:
    """Another day of 1900 to 2099 for one of those; for one before or after, another of these."""
    lo, hi, top = dt.date(1900, 1, 1).toordinal(), dt.date(2100, 1, 1).toordinal(), dt.date.max.toordinal()
    if lo <= day < hi:
        return lo + permute(day - lo, hi - lo, key, "date" + tweak, undo)
    gap = hi - lo
    x = permute(day - 1 - (gap if day >= hi else 0), top - gap, key, "far" + tweak, undo)
    return x + 1 + (gap if x + 1 >= lo else 0)


def _date(s: str, key: bytes, undo: bool) -> str | None:
    """Year first; else day first; else, where the second number is over 12, month first.

    A month-first date is walked to another day over 12, so that it is read the same way again.
    """
    a, sep, b, _, c = re.split(r"([-/.])", s)
    x, y, z = int(a), int(b), int(c)
    if len(a) == 4:
        kind, day = "ymd", _day(x, y, z)
    elif (day := _day(z, y, x)) is not None:
        kind = "dmy"
    else:
        kind, day = "mdy", _day(z, x, y)
    if day is None:
        return None
    while True:
        day = _move(day, key, kind + sep, undo)
        d = dt.date.fromordinal(day)
        if kind != "mdy" or d.day > 12:
            break
    return {"ymd": f"{d.year:04d}{sep}{d.month:02d}{sep}{d.day:02d}", "dmy": f"{d.day:02d}{sep}{d.month:02d}{sep}{d.year:04d}", "mdy": f"{d.month:02d}{sep}{d.day:02d}{sep}{d.year:04d}"}[kind]


def _hex(s: str, key: bytes, undo: bool) -> str | None:
    if s.isdigit() or s.isalpha():
        return None
    return _classwise(s, key, "hex", undo, ("0123456789abcdef",) if s == s.lower() else ("0123456789ABCDEF",))


#: Kind, pattern, replacement; of those that begin at a place the first that is valid counts.
KINDS = (
    ("iban", r"(?<![0-9A-Za-z])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![0-9A-Za-z])", _iban),
    ("secret", r"(?<![0-9A-Za-z])(?:[0-9a-f]{32,128}|[0-9A-F]{32,128})(?![0-9A-Za-z])", _hex),
    ("ip", r"(?<![\w.])\d{1,3}(?:\.\d{1,3}){3}(?![\w]|\.\d)", _ip),
    ("date", r"(?<![\w./-])(?:\d{4}([-/.])\d{2}\1\d{2}|\d{2}([-/.])\d{2}\2\d{4})(?![\w]|[-/.]\d)", _date),
    ("ssn", r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w]|-\d)", _ssn),
    ("phone", r"(?<!\w)\+\d{8,15}(?!\d)|(?<!\w)\+\d{1,3}[ .-]?(?:\(\d{1,4}\)[ .-]?)?\d{2,4}(?:[ .-]?\d{2,4}){1,4}(?!\d)", _phone),
)
#: What follows the @ of an address; at most 253 characters are one.
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}")
#: The part before it, which has at most 64 characters.
_LOCAL = re.compile(r"[\w.%+-]+\Z")
#: Digits in groups, among which cards are looked for; other kinds may take some of the groups.
_DIGIT_RUN = re.compile(r"(?<![\w.+-])\d(?:[ -]?\d){12,}(?![\w]|[-.]\d)")
_ONE = [(name, re.compile(p), f) for name, p, f in KINDS]


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Addresses, looked for from every @ outwards, so that a long run without one costs nothing."""
    done, at = 0, text.find("@")
    while at >= 0:
        m = _DOMAIN.match(text, at + 1)
        if m and m.end() - at <= 254:
            local = _LOCAL.search(text[max(done, at - 65) : at])
            if local and at - 65 < (a := at - len(local.group())):
                yield a, m.end()
                done = m.end()
        at = text.find("@", max(done, at + 1))


def pseudonymise(text: str, key: bytes, undo: bool = False) -> tuple[str, int]:
    """``text`` with every validated value replaced, and how many there were; ``undo`` restores the values.

    Kinds are tried one after another, each on what the earlier ones left, and
    cards last.  The time is linear in the text but for sorting the values.
    """
    taken = [(a, b, _email(text[a:b], key, undo)) for a, b in _emails(text)]
    for _, pat, f in _ONE:
        ends = [b for _, b, _ in taken]
        found = []
        for m in pat.finditer(text):
            a, b = m.span()
            k = bisect.bisect_right(ends, a)  # the first of those before that ends after a
            if k < len(taken) and taken[k][0] < b:
                continue
            new = f(m.group(), key, undo)
            if new is not None:
                found.append((a, b, new))
        taken = sorted(taken + found)
    ends = [b for _, b, _ in taken]
    found = []
    for m in _DIGIT_RUN.finditer(text):
        at, end = m.span()
        k = bisect.bisect_right(ends, at)
        while at < end:
            a, b = taken[k][:2] if k < len(taken) and taken[k][0] < end else (end, end)
            if a > at:
                found += [(at + x, at + y, new) for x, y, new in _cards(text[at:a], key, undo)]
            at, k = max(at, b), k + 1
    taken = sorted(taken + found)
    if not taken:
        return text, 0
    out, at = [], 0
    for a, b, new in taken:
        out += [text[at:a], new]
        at = b
    return "".join([*out, text[at:]]), len(taken)


def pseudonyms(docs: DataFrame, key: bytes, count_col: str | None = "n_private", undo: bool = False) -> DataFrame:
    """``docs`` with the personal data of ``text`` replaced, and the number of values replaced in ``count_col``.

    Replaced are e-mail addresses (the part before @), card numbers that pass
    the Luhn check (also beside other numbers, at the bounds of their groups), IBANs that pass theirs, phone numbers with a country code,
    US social security numbers and IPv4 addresses in their valid ranges, dates
    that exist, and hexadecimal secrets.  What isn't valid is left as it is.
    Every replacement is valid again, of the same format and length (addresses
    of the internet apart, whose parts vary in length).  Equal values get equal
    pseudonyms wherever they occur, since only the key and the format count
    (a card beside numbers with which its pseudonym would be read differently
    gets another); with the key the replacement can be undone.

    An address has at most 64 characters before the @ and 253 behind it.  Null
    and empty texts stay, with a count of 0, and repeated rows get the same; all other columns pass
    through, and a column named like ``count_col`` is kept under its name while
    the count takes a fresh one.  A map: nothing is shuffled, and only texts with
    a digit or an @ are looked at in Python.
    """
    at = [c.lower() for c in docs.columns].index("text")
    extra = fresh(docs, count_col) if count_col else []
    schema = T.StructType([*docs.schema.fields, *(T.StructField(c, T.IntegerType()) for c in extra)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = batch.column(at)
            hit = pc.fill_null(pc.match_substring_regex(text, "[0-9]{2}|@"), False)
            new, count = [], [0] * len(text)
            changed = [False] * len(text)
            for i in pc.indices_nonzero(hit).to_pylist():
                s, n = pseudonymise(text[i].as_py(), key, undo)
                if n:
                    new.append(s)
                    count[i], changed[i] = n, True
            cols = list(batch.columns)
            if new:
                cols[at] = pc.replace_with_mask(text, pa.array(changed), pa.array(new, text.type))
            yield pa.RecordBatch.from_arrays([*cols, *([pa.array(count, pa.int32())] if extra else [])], [*batch.schema.names, *extra])

    return docs.mapInArrow(run, schema)
