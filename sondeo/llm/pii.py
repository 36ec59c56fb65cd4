"""Format-preserving pseudonyms for personal data.

Validated numbers and dates are permuted with a keyed Feistel network within their own
format: digits stay digits, separators, length and check digits stay valid, a date becomes
another date of the same layout, an address stays an address.  Equal values get equal
pseudonyms under one key, so documents stay linked; distinct values stay distinct within a
format.  Everything outside a match is left as it was.
"""

from __future__ import annotations

import datetime
import hashlib
import re
import unicodedata
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batches_of_texts, extended

KINDS = ("email", "secret", "iban", "ip", "phone", "card", "ssn", "date")
#: Month names of the dates in words, by language, and short ones of English.
MONTHS = {
    "en": "January February March April May June July August September October November December".split(),
    "short": "Jan Feb Mar Apr May Jun Jul Aug Sep Oct Nov Dec".split(),
    "de": "Januar Februar März April Mai Juni Juli August September Oktober November Dezember".split(),
    "fr": "janvier février mars avril mai juin juillet août septembre octobre novembre décembre".split(),
    "es": "enero febrero marzo abril mayo junio julio agosto septiembre octubre noviembre diciembre".split(),
}
#: Other spellings, read as the month and written as its name.
SPELT = {"sept": ("short", 8), "setiembre": ("es", 8), "jänner": ("de", 0)}
_NAMES = sorted({m.lower() for names in MONTHS.values() for m in names} | SPELT.keys(), key=lambda m: (-len(m), m))
_MONTH = "(?i:" + "|".join(_NAMES) + ")"
#: Fixed patterns, tried in this order at each place.
PATTERN = re.compile(
    r"""
    (?P<email>(?u:(?<![\w.+-])[\w.+-]+@[\w-]+(?:\.[\w-]+)+))
  | (?P<secret>(?<![0-9A-Za-z])(?:[0-9a-f]{32,}|[0-9A-F]{32,}|AKIA[0-9A-Z]{16}|(?:sk|ghp)[-_][0-9A-Za-z]{20,})(?![0-9A-Za-z]))
  | (?P<iban>(?<![0-9A-Za-z])[A-Z]{2}\d{2}(?:[ ]?[0-9A-Z]{4}){2,7}(?:[ ]?[0-9A-Z]{1,3})?(?![0-9A-Za-z]))
  | (?P<ip>(?<![\d.])\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}(?!\d|\.\d))
  | (?P<date>(?<![\d./-])(?:\d{4}(?P<s1>[-/.])\d{1,2}(?P=s1)\d{1,2}|\d{1,2}(?P<s2>[-/.])\d{1,2}(?P=s2)\d{4})(?!\d|[./-]\d)
      |(?<![\d./-])\d{1,2}\.?[ ](?:de[ ])?"""
    + _MONTH
    + r"""\.?,?[ ](?:de[ ]|del[ ])?\d{4}(?!\d)
      |(?u:(?<!\w))"""
    + _MONTH
    + r"""\.?[ ]\d{1,2},?[ ]\d{4}(?!\d))
  | (?P<ssn>(?<![\d-])\d{3}-\d{2}-\d{4}(?!\d|-\d))
  | (?P<phone>(?<![\w+])\+1[ .-]?\(?\d{3}\)?[ .-]?\d{3}[ .-]?\d{4}(?!\d)
      |(?<![\w+])\+\d{1,3}[ .-]?(?:\(\d{1,4}\)[ .-]?)?\d{2,4}(?:[ .-]?\d{2,4}){1,4}(?!\d|[.-]\d)
      |(?<![\w(])\(\d{3}\)[ ]?\d{3}[ .-]\d{4}(?!\d)|(?<![\w.+-])\d{3}(?P<s3>[ .-])\d{3}(?P=s3)\d{4}(?!\d|[.-]\d)
      |(?<![\w.+/-])(?:\(0\d{1,5}\)|0\d{1,5})(?P<s4>[ ./-]{1,3})\d{2,9}(?:[ .-]\d{2,8}){0,4}(?!\d|[./-]\d)|(?<![\w.+/-])0[1-9]\d{8,9}(?!\d|[./-]\d)
      |(?<![\w.+-])(?:[67]\d{2}|9\d{2})[ ]\d{3}[ ](?!000)\d{3}(?!\d|[ .,-]\d)|(?<![\w.+-])(?:[67]\d{2}|9\d{2})(?:[ ]\d{2}){3}(?!\d|[ .,-]\d)|(?<![\w.+-])9\d[ ]\d{3}(?:[ ]\d{2}){2}(?!\d|[ .,-]\d))
  | (?P<card>(?<!\d)(?:\d{13,19}|\d{4}(?:[ -]\d{4}){3}|\d{4}[ -]\d{6}[ -]\d{5})(?!\d))
    """,
    re.ASCII | re.VERBOSE,
)
#: Every kind holds a digit or an @, or begins with one of these heads; the pattern is only tried near one.
HEADS = ("AKIA", "sk-", "sk_", "ghp_", "ghp-")
GATE, HEADED = re.compile("[0-9@]"), re.compile("[0-9@]|" + "|".join(HEADS))
#: What can go on over either end of a window.
RUNNING, RUNS = re.compile(r"[\w.+@-]*"), re.compile(r"[\w.+@-]+\Z")
BEFORE, AFTER = 80, 300
LOWER, UPPER, DIGIT = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
#: Longer strings are permuted in pieces of so many characters.
PIECE = 128
#: Dates stay within their span of so many years (1900 to 2099 is one).
SPAN = 200


@lru_cache(maxsize=1 << 14)
def alphabet(c: str) -> str | None:
    """The letters or digits that a character may become: of ASCII, those of its kind; of
    other scripts, those of its kind in its block of 128 code points; None for other characters."""
    for a in (DIGIT, LOWER, UPPER):
        if c in a:
            return a
    if not c.isalnum():
        return None
    block = ord(c) >> 7 << 7
    return "".join(x for x in map(chr, range(block, block + 128)) if unicodedata.category(x) == unicodedata.category(c) and ord(x) >= 128)


class Pseudonyms:
    """Keyed permutations of numbers below a bound, and of the formats built on them."""

    def __init__(self, key: bytes):
        self.key = key
        self.replace = lru_cache(maxsize=1 << 16)(self._replace)

    def permute(self, x: int, bound: int, tweak: str) -> int:
        """A permutation of range(bound): a ten-round Feistel network over the next even
        number of bits, walked until the value lies below the bound again."""
        half = max(1, ((bound - 1).bit_length() + 1) // 2)
        mask = (1 << half) - 1
        size = (half + 7) // 8
        while True:
            a, b = x >> half, x & mask
            for i in range(10):
                f = hashlib.blake2b(f"{tweak}|{bound}|{i}|{b}".encode(), key=self.key, digest_size=max(8, size)).digest()
                a, b = b, a ^ (int.from_bytes(f, "big") & mask)
            x = (a << half) | b
            if x < bound:
                return x

    def pieces(self, s: str, tweak: str, permuted) -> str:
        """A long string, piece by piece: each is permuted under a tweak that holds a digest of
        the string before it, so distinct strings stay distinct."""
        before, out = hashlib.blake2b(digest_size=16), []
        for at in range(0, len(s), PIECE):
            part = s[at : at + PIECE]
            out.append(permuted(part, f"{tweak}|{at}|{before.hexdigest()}"))
            before.update(part.encode("utf-8", "surrogatepass"))
        return "".join(out)

    def letters(self, s: str, alphabet: str, tweak: str) -> str:
        """A permutation of the strings of this length over an alphabet."""
        if len(s) > PIECE:
            return self.pieces(s, tweak, lambda part, t: self.letters(part, alphabet, t))
        n = 0
        for c in s:
            n = n * len(alphabet) + alphabet.index(c)
        n, out = self.permute(n, len(alphabet) ** len(s), tweak), []
        for _ in s:
            n, d = divmod(n, len(alphabet))
            out.append(alphabet[d])
        return "".join(reversed(out))

    def classes(self, s: str, tweak: str) -> str:
        """Permutes all letters and digits of a string, each within its alphabet and place;
        other characters stay.  A string of few letters may be its own pseudonym, as in
        any permutation: one letter in 26."""
        if len(s) > PIECE:
            return self.pieces(s, tweak, self.classes)
        radix = [alphabet(c) for c in s]
        n, bound = 0, 1
        for c, a in zip(s, radix):
            if a:
                n, bound = n * len(a) + a.index(c), bound * len(a)
        if bound == 1:
            return s
        n, out = self.permute(n, bound, tweak + "|" + "".join(a[0] if a else c for c, a in zip(s, radix))), []
        for c, a in zip(reversed(s), reversed(radix)):
            if a:
                n, d = divmod(n, len(a))
                c = a[d]
            out.append(c)
        return "".join(reversed(out))

    def _replace(self, kind: str, s: str) -> str | None:
        """The pseudonym of a match, or None if it isn't valid for its kind."""
        return getattr(self, kind)(s)

    def email(self, s):
        name, domain = s.rsplit("@", 1)
        return self.classes(name, "email@" + domain.lower()) + "@" + domain

    def secret(self, s):
        head = next((h for h in HEADS if s.startswith(h)), "")
        body = s[len(head) :]
        if not head:
            if len(set(body)) < 8:
                return None
            return self.letters(body, DIGIT + ("ABCDEF" if any(c in "ABCDEF" for c in body) else "abcdef"), "secret")
        return head + self.classes(body, "secret" + head)

    def iban(self, s):
        check = lambda x: int("".join(str(int(c, 36)) for c in x[4:] + x[:4])) % 97
        for end in (len(s), *(m.start() for m in reversed(list(re.finditer(" ", s))))):  # words that follow are not part of it
            flat = s[:end].replace(" ", "")
            if 15 <= len(flat) <= 34 and check(flat) == 1:
                body = self.classes(flat[4:], "iban" + flat[:2])
                return _like(s[:end], flat[:2] + f"{98 - check(flat[:2] + '00' + body):02d}" + body) + s[end:]
        return None

    def ip(self, s):
        parts = s.split(".")
        if any(int(p) > 255 or (len(p) > 1 and p[0] == "0") for p in parts):
            return None
        n = self.permute(int.from_bytes(bytes(map(int, parts)), "big"), 1 << 32, "ip")
        return ".".join(map(str, n.to_bytes(4, "big")))

    def date(self, s):
        """Another date of the same layout and span of years: the year in the same place, the
        same widths of day and month.  With the year last, a first number over 12 is a day
        and a second one over 12 too; where neither is, the pseudonym's numbers are up to 12
        too, so it is a date by either order."""
        if not s.isascii() or re.search("[A-Za-z]", s):
            return self.date_in_words(s)
        sep = next(c for c in s if c in "-/.")
        p = s.split(sep)
        kind, year, m, d = _layout(p)
        try:
            day = datetime.date(year, m, d).toordinal()
        except ValueError:
            return None
        low = max(1, (year - 1900) // SPAN * SPAN + 1900)
        high = min(10_000, (year - 1900) // SPAN * SPAN + 1900 + SPAN)
        begin = datetime.date(low, 1, 1).toordinal()
        n, bound = day - begin, datetime.date(high - 1, 12, 31).toordinal() + 1 - begin
        while True:  # the permutation of all days, walked until the layout is the same again
            n = self.permute(n, bound, f"date{low}")
            new = datetime.date.fromordinal(n + begin)
            parts = {"y": f"{new.year:04d}", "m": str(new.month), "d": str(new.day)}
            out = [parts[c].zfill(len(x)) for c, x in zip(kind[:3], p)]
            if [len(x) for x in out] == [len(x) for x in p] and _layout(out)[0] == kind:
                return sep.join(out)

    def date_in_words(self, s):
        """Another date with its month in the same language and case, as many digits for the
        day, and the same words and signs around."""
        m = re.search(_MONTH, s)
        word, numbers = m[0], list(re.finditer("[0-9]+", s))
        lang, month = SPELT.get(word.lower(), (None, None))
        if lang is None:
            # of languages that share a name, the one whose case is the word's
            lang, month = min(((k, names.index(n)) for k, names in MONTHS.items() for n in names if n.lower() == word.lower()), key=lambda x: (MONTHS[x[0]][x[1]] != word, list(MONTHS).index(x[0])))
        d, y = (numbers[0], numbers[1]) if len(numbers[0][0]) <= 2 else (numbers[1], numbers[0])
        try:
            day = datetime.date(int(y[0]), month + 1, int(d[0])).toordinal()
        except ValueError:
            return None
        low = max(1, (int(y[0]) - 1900) // SPAN * SPAN + 1900)
        high = min(10_000, (int(y[0]) - 1900) // SPAN * SPAN + 1900 + SPAN)
        begin = datetime.date(low, 1, 1).toordinal()
        n, bound = day - begin, datetime.date(high - 1, 12, 31).toordinal() + 1 - begin
        zero = d[0][0] == "0"
        while True:  # all days, walked until the day has as many digits, or may have a zero before it, again
            n = self.permute(n, bound, f"words{low}")
            new = datetime.date.fromordinal(n + begin)
            if (new.day < 10) == (int(d[0]) < 10):
                break
        name = MONTHS[lang][new.month - 1]
        name = name.upper() if word.isupper() else name.lower() if word.islower() else name.capitalize() if word[0].isupper() else name
        put = sorted(((d.span(), f"{new.day:02d}" if zero else str(new.day)), (m.span(), name), (y.span(), f"{new.year:04d}")))
        out, at = [], 0
        for (a, b), x in put:
            out += [s[at:a], x]
            at = b
        return "".join(out) + s[at:]

    def ssn(self, s):
        area, group, serial = int(s[:3]), int(s[4:6]), int(s[7:])
        if area in (0, 666) or area >= 900 or group == 0 or serial == 0:
            return None
        rank = area - 1 - (area > 666)
        n = self.permute((rank * 99 + group - 1) * 9999 + serial - 1, 898 * 99 * 9999, "ssn")
        n, serial = divmod(n, 9999)
        rank, group = divmod(n, 99)
        return f"{rank + 1 + (rank >= 665):03d}-{group + 1:02d}-{serial + 1:04d}"

    def phone(self, s):
        digits = re.sub(r"\D", "", s)
        if not 7 <= len(digits) <= 15:
            return None
        # a country's number stays, and so does the trunk zero of a national one
        keep = len(re.match(r"\+(\d{1,3})[ .(-]|\(?(0)|", s)[1] or re.match(r"\(?(0)|", s)[1] or "")
        return _like(s, digits[:keep] + self.letters(digits[keep:], DIGIT, "phone" + digits[:keep]))

    def card(self, s):
        digits = re.sub(r"\D", "", s)
        if _luhn(digits[:-1]) != int(digits[-1]) or len(set(digits)) == 1:
            return None
        body = self.letters(digits[:-1], DIGIT, "card")
        return _like(s, body + str(_luhn(body)))


def _layout(p: list[str]) -> tuple[str, int, int, int]:
    """The order of a date's three parts, with whether both orders of day and month are
    possible and whether one-digit numbers are written without a zero; year, month, day."""
    a, b, c = map(int, p)
    if len(p[0]) == 4:
        kind, date = "ymd", (a, b, c)
    elif a > 12:
        kind, date = "dmy", (c, b, a)
    elif b > 12:
        kind, date = "mdy", (c, a, b)
    else:
        kind, date = "dmy either", (c, b, a)
    # a part of two digits beside one of one digit has no zero before it
    bare = any(len(x) == 1 for x in p)
    return kind + (" bare" if bare and not any(x[0] == "0" for x in p if len(x) == 2) else ""), *date


def _luhn(body: str) -> int:
    total = 0
    for i, c in enumerate(reversed(body)):
        d = int(c) * (2 if i % 2 == 0 else 1)
        total += d - 9 if d > 9 else d
    return -total % 10


def _like(shape: str, flat: str) -> str:
    """The characters of ``flat`` in the places of letters and digits of ``shape``."""
    it = iter(flat)
    return "".join(next(it) if c.isalnum() else c for c in shape)


def token_start(text: str, at: int, low: int) -> int:
    """Where the token begins that runs over a place, looked for down to ``low``."""
    step = 256
    while at > low:
        run = RUNS.search(text, max(low, at - step), at)
        if run is None or run.start() > max(low, at - step):
            return run.start() if run else at
        at, step = run.start(), 2 * step
    return at


def matches(text: str):
    """Matches of the pattern, looked for only in the surroundings of digits, @ and heads of
    secrets, from the begin to the end of the tokens that run there."""
    start, end = 0, -1
    for g in (HEADED if any(h in text for h in HEADS) else GATE).finditer(text):
        if g.start() - BEFORE > end >= 0:
            end = RUNNING.match(text, end).end()
        if g.start() - BEFORE > end:
            if end >= 0:
                yield from PATTERN.finditer(text, start, end)
            start = max(0, g.start() - BEFORE)
            start = token_start(text, start, max(0, end))
        end = max(end, g.end() + AFTER)
    if end >= 0:
        yield from PATTERN.finditer(text, start, RUNNING.match(text, min(end, len(text))).end())


def pseudonymise(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """``docs`` with the personal data of ``text`` replaced, plus ``pii_<kind>`` counts for
    each kind.  Null texts stay null, with counts of 0; ids, order and any other column
    pass through (columns named like a count are replaced).  Work is one pass, row by row."""
    base = [c for c in docs.columns if c not in {f"pii_{k}" for k in KINDS}]
    at = base.index(text)
    src = docs.select(*[F.col(f"`{c}`").cast("string").alias(c) if c == text else F.col(f"`{c}`") for c in base])
    schema = extended(src.schema, ", ".join(f"pii_{k} long" for k in KINDS))

    def run(batches):
        names = Pseudonyms(hashlib.sha256(key.encode()).digest())
        for batch in batches:
            for first, texts in batches_of_texts(batch.column(at)):
                null = batch.column(at).slice(first, len(texts)).is_null().to_pylist()
                out, counts = [], []
                for t, none in zip(texts, null):
                    t, n, done, parts = t.decode("utf-8", "surrogatepass"), dict.fromkeys(KINDS, 0), 0, []
                    for m in matches(t):
                        kind = next(k for k in KINDS if m[k])
                        new = names.replace(kind, m[0])
                        if new is not None:
                            parts += [t[done : m.start()], new]
                            done = m.end()
                            n[kind] += 1
                    out.append(None if none else "".join(parts) + t[done:])
                    counts.append(list(n.values()))
                cols = [c.slice(first, len(texts)) for c in batch.columns]
                cols[at] = pa.array(out, pa.string())
                yield pa.RecordBatch.from_arrays([*cols, *(pa.array(c, pa.int64()) for c in zip(*counts))], names=[*base, *(f"pii_{k}" for k in KINDS)])

    return src.mapInArrow(run, schema)
