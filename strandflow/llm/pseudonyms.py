"""Format-preserving pseudonyms of validated numbers, dates and other identifiers.

Each kind of value is found by a pattern and validated (card numbers by their
check digit, addresses by their ranges, dates by the calendar). Its digits (or
letters, or its day number) are permuted by a keyed Feistel network over the
values of the same format, without fixed points, so a pseudonym has the same length, punctuation and
validity, differs between keys, and is equal for equal values in all documents.
The network works on two halves of a mixed domain; values outside a domain are
walked on through the permutation (cycle walking), so it stays one to one.

Null texts stay null. Texts without a valid value stay as they are. Rows are
treated one by one, so repeated rows and other columns pass through unchanged.
"""

from __future__ import annotations

import datetime
import hashlib
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from strandflow.llm.common import in_parts, small_batches, trim

PART_ROWS, PART_BYTES = 1000, 4 << 20
from pyspark.sql import functions as F

ROUNDS = 8
FIRST_DAY, LAST_DAY = datetime.date(1900, 1, 1).toordinal(), datetime.date(2099, 12, 31).toordinal()


def feistel(value: int, size: int, key: bytes, tweak: str) -> int:
    """A keyed permutation of 0 .. size - 1."""
    if size < 2:
        return value
    left_size = int(size**0.5)
    while left_size * left_size < size:
        left_size += 1
    right_size = left_size
    salt = hashlib.blake2b(f"{tweak}:{size}".encode(), key=key[:64], digest_size=16).digest()

    def mix(k: int, half: int) -> int:
        return int.from_bytes(hashlib.blake2b(salt + bytes([k]) + half.to_bytes((half.bit_length() + 7) // 8 or 1, "big"), digest_size=24).digest(), "big")

    while True:
        a, b = divmod(value, right_size)
        for k in range(ROUNDS):
            if k % 2:
                b = (b + mix(k, a)) % right_size
            else:
                a = (a + mix(k, b)) % left_size
        value = a * right_size + b
        if value < size:
            return value


def unfeistel(value: int, size: int, key: bytes, tweak: str) -> int:
    """The inverse of feistel()."""
    if size < 2:
        return value
    left_size = int(size**0.5)
    while left_size * left_size < size:
        left_size += 1
    salt = hashlib.blake2b(f"{tweak}:{size}".encode(), key=key[:64], digest_size=16).digest()

    def mix(k: int, half: int) -> int:
        return int.from_bytes(hashlib.blake2b(salt + bytes([k]) + half.to_bytes((half.bit_length() + 7) // 8 or 1, "big"), digest_size=24).digest(), "big")

    while True:
        a, b = divmod(value, left_size)
        for k in reversed(range(ROUNDS)):
            if k % 2:
                b = (b - mix(k, a)) % left_size
            else:
                a = (a - mix(k, b)) % left_size
        value = a * left_size + b
        if value < size:
            return value


def moved(value: int, size: int, key: bytes, tweak: str) -> int:
    """A keyed permutation without fixed points: a step around the one cycle that the network makes."""
    if size < 2:
        return value
    step = 1 + int.from_bytes(hashlib.blake2b(tweak.encode(), key=key[:64], digest_size=8).digest(), "big") % (size - 1)
    return unfeistel((feistel(value, size, key, tweak) + step) % size, size, key, tweak)


def check_digit(digits: str) -> str:
    total = 0
    for k, c in enumerate(reversed(digits)):
        n = int(c) * (1 if k % 2 else 2)
        total += n - 9 if n > 9 else n
    return str(-total % 10)


def _refill(shape: str, digits: str) -> str:
    it = iter(digits)
    return "".join(next(it) if c.isdigit() else c for c in shape)


def _digits(text: str) -> str:
    return "".join(c for c in text if c.isdigit())


def _card(text: str, key: bytes) -> str | None:
    d = _digits(text)
    if not 13 <= len(d) <= 19 or check_digit(d[:-1]) != d[-1] or len(set(d)) == 1:
        return None
    body = str(moved(int(d[1:-1]), 10 ** (len(d) - 2), key, f"card{d[0]}{len(d)}")).zfill(len(d) - 2)
    return _refill(text, d[0] + body + check_digit(d[0] + body))


def _ipv4(text: str, key: bytes) -> str | None:
    parts = text.split(".")
    if any(int(p) > 255 or (len(p) > 1 and p[0] == "0") for p in parts):
        return None
    value = int.from_bytes(bytes(map(int, parts)), "big")
    return ".".join(map(str, moved(value, 1 << 32, key, "ipv4").to_bytes(4, "big")))


def _phone(text: str, key: bytes) -> str | None:
    d = _digits(text)
    if not 8 <= len(d) <= 15 or len(set(d)) == 1:
        return None
    lead = d[: max(1, len(d) - 10)]
    rest = d[len(lead) :]
    return _refill(text, lead + str(moved(int(rest), 10 ** len(rest), key, f"phone{lead}{len(d)}")).zfill(len(rest)))


def _ssn(text: str, key: bytes) -> str | None:
    a, b, c = (int(x) for x in text.split("-"))
    if a in (0, 666) or a > 899 or not b or not c:
        return None
    area = a - 1 - (a > 666)
    value = moved((area * 99 + b - 1) * 9999 + c - 1, 898 * 99 * 9999, key, "ssn")
    value, serial = divmod(value, 9999)
    area, group = divmod(value, 99)
    return f"{area + 1 + (area >= 665):03d}-{group + 1:02d}-{serial + 1:04d}"


def _date(order: str, joiner: str) -> Callable[[str, bytes], str | None]:
    def run(text: str, key: bytes) -> str | None:
        part = dict(zip(order, text.split(joiner), strict=True))
        try:
            day = datetime.date(int(part["y"]), int(part["m"]), int(part["d"])).toordinal()
        except ValueError:
            return None
        if not FIRST_DAY <= day <= LAST_DAY:
            return None
        new = datetime.date.fromordinal(FIRST_DAY + moved(day - FIRST_DAY, LAST_DAY - FIRST_DAY + 1, key, "date"))
        wide = {"y": f"{new.year:04d}", "m": f"{new.month:02d}", "d": f"{new.day:02d}"}
        return joiner.join(wide[c] for c in order)

    return run


def _iban(text: str, key: bytes) -> str | None:
    d = text.replace(" ", "")
    number = "".join(str(int(c, 36)) for c in d[4:] + d[:4])
    if not 15 <= len(d) <= 34 or int(number) % 97 != 1:
        return None
    body = _letters(d[4:], key, f"iban{d[:2]}")
    check = 98 - int("".join(str(int(c, 36)) for c in body + d[:2] + "00")) % 97
    it = iter(f"{d[:2]}{check:02d}{body}")
    return "".join(c if c == " " else next(it) for c in text)


def _letters(text: str, key: bytes, tweak: str) -> str:
    """Digits, lower-case and upper-case ASCII letters permuted within their classes, together."""
    base = [(10, "0") if "0" <= c <= "9" else (26, "a") if "a" <= c <= "z" else (26, "A") if "A" <= c <= "Z" else (1, c) for c in text]
    value = size = 0
    size = 1
    for c, (n, first) in zip(text, base, strict=True):
        value, size = value * n + (ord(c) - ord(first)), size * n
    shape = "".join(first if n > 1 else "." for n, first in base)
    value = moved(value, size, key, f"{tweak}:{shape}")
    out = []
    for n, first in reversed(base):
        value, k = divmod(value, n)
        out.append(chr(ord(first) + k))
    return "".join(reversed(out))


def _hex(text: str, key: bytes, tweak: str) -> str:
    lower = text.lower()
    new = f"{moved(int(lower, 16), 16 ** len(text), key, tweak + str(len(text))):0{len(text)}x}"
    return new.upper() if text != lower else new


def _secret(text: str, key: bytes) -> str | None:
    return _hex(text, key, "hex") if re.fullmatch(r"[0-9a-f]+|[0-9A-F]+", text) else _letters(text, key, "secret")


def _email(text: str, key: bytes) -> str | None:
    name, host = text.rsplit("@", 1)
    return f"{_letters(name, key, 'mail')}@{host}"


#: (kind, pattern, pseudonym of the match's first group or None if it is not valid), tried in this order at each place.
KINDS: list[tuple[str, str, Callable[[str, bytes], str | None]]] = [
    ("email", r"(?<![\w.+-])([A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,})", _email),
    ("iban", r"(?<!\w)([A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?)(?!\w)", _iban),
    ("secret", r"(?i:(?:token|secret|api[_-]?key|password|passwd|pwd|access[_-]?key|auth)\w* ?[:=] ?[\"'])([^\"'\s]{8,})(?=[\"'])", _secret),
    ("key", r"(?<!\w)((?:AKIA|ASIA)[A-Z0-9]{16}|gh[pousr]_[A-Za-z0-9]{36}|sk-[A-Za-z0-9]{20,})(?!\w)", None),
    ("hex", r"(?<![\w])([0-9a-f]{32,}|[0-9A-F]{32,})(?!\w)", _secret),
    ("date", r"(?<![\w/.-])(\d{4}-\d{2}-\d{2})(?![\w/-]|\.\d)", _date("ymd", "-")),
    ("date", r"(?<![\w/.-])(\d{4}/\d{2}/\d{2})(?![\w/-]|\.\d)", _date("ymd", "/")),
    ("date", r"(?<![\w/.-])(\d{2}\.\d{2}\.\d{4})(?![\w/-]|\.\d)", _date("dmy", ".")),
    ("ipv4", r"(?<![\w.])(\d{1,3}(?:\.\d{1,3}){3})(?![\w]|\.\d)", _ipv4),
    ("ssn", r"(?<![\w-])(\d{3}-\d{2}-\d{4})(?![\w-])", _ssn),
    ("card", r"(?<!\d)(\d{13,19}|\d{4}([ -])\d{4}\2\d{4}\2\d{1,7}|\d{4}([ -])\d{6}\3\d{5})(?!\d)", _card),
    ("phone", r"(?<![\w(+])(\+\d{1,3}[ .-]?\(\d{1,4}\)[ .-]?\d{3,4}[ .-]?\d{3,4}|\+\d{1,3}(?:[ .-]?\d{2,4}){2,4}|\(\d{3}\) ?\d{3}[ .-]\d{4}|\d{3}[.-]\d{3}[.-]\d{4})(?!\d)", _phone),
]


def _key(text: str, key: bytes) -> str:
    head = re.match(r"AKIA|ASIA|gh[pousr]_|sk-", text)[0]
    return head + _letters(text[len(head) :], key, f"key{head}")


_DIGIT = re.compile(r"\d")
_HINTS = ("@", '"', "'", "AKIA", "ASIA", "sk-", "ghp_", "gho_", "ghu_", "ghs_", "ghr_")


class Pseudonymizer:
    """Replaces values in texts; holds the pseudonyms of frequent values so that each is computed once."""

    def __init__(self, key: str, kinds: tuple[str, ...] | None = None) -> None:
        self.key = key.encode()
        self.kinds = [(name, re.compile(p), f or _key) for name, p, f in KINDS if kinds is None or name in kinds]
        self.known: dict[tuple[int, str], str | None] = {}

    def __call__(self, text: str) -> tuple[str, list[tuple[str, int, int]]]:
        """The new text, and kind, start and length of each value in it."""
        if not _DIGIT.search(text) and not any(h in text for h in _HINTS):
            return text, []
        found: list[tuple[int, int, str, str]] = []
        taken: list[tuple[int, int]] = []
        for k, (name, pattern, make) in enumerate(self.kinds):
            at = 0
            while m := pattern.search(text, at):
                at = m.start() + 1
                a, b = m.span(1)
                if over := [x for x, y in taken if a < y and x < b]:
                    m = pattern.match(text, m.start(), min(over)) if min(over) > a else None  # the part before what is taken
                    if not m:
                        continue
                    a, b = m.span(1)
                value = m[1]
                if (k, value) not in self.known:
                    if len(self.known) > 100_000:
                        self.known.clear()
                    self.known[k, value] = make(value, self.key)
                new = self.known[k, value]
                if new is not None:
                    taken.append((a, b))
                    found.append((a, b, name, new))
                    at = b
        found.sort()
        out, at, spans, moved = [], 0, [], 0
        for a, b, name, new in found:
            out += [text[at:a], new]
            spans.append((name, a + moved, len(new)))
            moved += len(new) - (b - a)
            at = b
        return "".join([*out, text[at:]]), spans


def _replace(key: str, text_column: str, names: list[str], spans_column: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        change = Pseudonymizer(key)
        spans_type = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("length", pa.int32())]))
        for batch in batches:
            for part in in_parts(batch, [text_column], PART_ROWS, PART_BYTES):
                texts, spans = [], []
                for text in part.column(text_column).to_pylist():
                    new, found = (None, []) if text is None else change(text)
                    texts.append(new)
                    spans.append([{"kind": k, "start": a, "length": n} for k, a, n in found])
                columns = [pa.array(texts, pa.string()) if n == text_column else part.column(n) for n in names]
                yield pa.record_batch([*columns, pa.array(spans, spans_type)], names=[*names, spans_column])
        trim()

    return run


def pseudonymize(docs: DataFrame, key: str, text_column: str = "text", spans_column: str = "pii_spans") -> DataFrame:
    """docs with the text's values replaced, and a new column of spans (kind, start, length) of the new text; a name that docs has already raises an error."""
    if spans_column.lower() in {c.lower() for c in docs.columns}:
        raise ValueError(f"{spans_column} is a column already")
    small_batches(docs.sparkSession)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return docs.mapInArrow(_replace(key, text_column, docs.columns, spans_column), f"{fields}, `{spans_column}` array<struct<kind:string,start:int,length:int>>")
