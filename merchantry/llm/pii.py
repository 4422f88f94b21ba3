"""PII: format-preserving Feistel pseudonyms.

Numbers and dates that pass their validation are permuted within the set of values of their format by a
keyed Feistel network: a card stays a valid card, a date a date, an address an address. The permutation
depends on key and kind only, so equal values get equal pseudonyms in every document, whatever their
separators or case, and two different values never get the same one.
"""

from __future__ import annotations

import datetime
import hashlib
import re
import secrets
from collections import Counter
from collections.abc import Iterator
from math import isqrt

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from merchantry.llm.common import prepare, table, tidied

ROUNDS = 10
#: The session setting that holds the key.
KEY_SETTING = "spark.merchantry.pii.key"
_KEY_OF_RUN = secrets.token_bytes(32)


def key_of(spark: SparkSession) -> bytes:
    """The key of the session's settings; without one, a key drawn for this driver process alone, which nobody can use to undo
    the pseudonyms afterwards, and under which equal values are linked within the run but not from run to run."""
    named = spark.conf.get(KEY_SETTING, None)
    return named.encode() if named else _KEY_OF_RUN


class Feistel:
    """Keyed permutations of 0..size-1, one for each kind."""

    def __init__(self, key: bytes):
        self.key = hashlib.blake2b(key, digest_size=32).digest()

    def _round(self, kind: str, size: int, i: int, half: int) -> int:
        data = f"{kind}|{size}|{i}|{half}".encode()
        return int.from_bytes(hashlib.blake2b(data, key=self.key, digest_size=24).digest(), "big")

    def permute(self, value: int, size: int, kind: str) -> int:
        """Alternating halves; a result outside the set is permuted again, which ends as the network is
        a bijection of a set less than twice as large for all but tiny sizes."""
        if size < 2:
            return value
        a = isqrt(size - 1) + 1
        b = -(-size // a)
        while True:
            left, right = divmod(value, b)
            for i in range(0, ROUNDS, 2):
                left = (left + self._round(kind, size, i, right)) % a
                right = (right + self._round(kind, size, i + 1, left)) % b
            value = left * b + right
            if value < size:
                return value

    def restore(self, value: int, size: int, kind: str) -> int:
        if size < 2:
            return value
        a = isqrt(size - 1) + 1
        b = -(-size // a)
        while True:
            left, right = divmod(value, b)
            for i in range(ROUNDS - 2, -1, -2):
                right = (right - self._round(kind, size, i + 1, left)) % b
                left = (left - self._round(kind, size, i, right)) % a
            value = left * b + right
            if value < size:
                return value


# The alphabets within which a character may move.
ALPHABETS = ("0123456789", "abcdefghijklmnopqrstuvwxyz", "àáâãäåæçèéêëìíîïñòóôõöøùúûüýß")
_PLACE = {c: (i, k) for i, letters in enumerate(ALPHABETS) for k, c in enumerate(letters)}


def _by_class(text: str, net: Feistel, kind: str) -> str:
    """Letters and digits move within their alphabet, case and other characters stay in place."""
    low = [c.lower() if len(c.lower()) == 1 else c for c in text]
    radix = [len(ALPHABETS[_PLACE[c][0]]) if c in _PLACE else 1 for c in low]
    value, size = 0, 1
    for c, r in zip(low, radix, strict=True):
        value, size = value * r + (_PLACE[c][1] if r > 1 else 0), size * r
    value = net.permute(value, size, f"{kind}{''.join(str(_PLACE[c][0]) if c in _PLACE else c for c in low)}")
    out = []
    for c, was, r in zip(reversed(low), reversed(text), reversed(radix), strict=True):
        value, k = divmod(value, r)
        new = ALPHABETS[_PLACE[c][0]][k] if r > 1 else was
        out.append(new.upper() if was != c and len(new.upper()) == 1 else new)
    return "".join(reversed(out))


# The narrowest of these that holds all characters of a secret is its alphabet.
SECRET_ALPHABETS = (
    "0123456789", "0123456789abcdef", "0123456789ABCDEF", "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789abcdefghijklmnopqrstuvwxyz",
    "+-./0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ_abcdefghijklmnopqrstuvwxyz~",
)


def _in_one(text: str, net: Feistel, kind: str) -> str:
    letters = next(a for a in SECRET_ALPHABETS if set(text) <= set(a))
    value = 0
    for c in text:
        value = value * len(letters) + letters.index(c)
    value, out = net.permute(value, len(letters) ** len(text), f"{kind}{len(text)}"), []
    for _ in text:
        value, k = divmod(value, len(letters))
        out.append(letters[k])
    return "".join(reversed(out))


def _fill(form: str, digits: str) -> str:
    """form with its digits replaced in turn."""
    rest = iter(digits)
    return "".join(next(rest) if c.isdigit() else c for c in form)


def _digits(text: str) -> str:
    return "".join(c for c in text if c.isdigit())


def luhn(digits: str) -> bool:
    return sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(digits))) % 10 == 0


def _number(form: str, net: Feistel) -> str:
    """Card numbers keep a right check digit; any other long number keeps its length."""
    digits = _digits(form)
    n = len(digits)
    if luhn(digits):
        head = str(net.permute(int(digits[:-1]), 10 ** (n - 1), f"card{n}")).zfill(n - 1)
        return _fill(form, next(head + c for c in "0123456789" if luhn(head + c)))
    value = int(digits)  # walks on until the result is no card either, so the two sets stay apart
    while True:
        value = net.permute(value, 10 ** n, f"number{n}")
        if not luhn(str(value).zfill(n)):
            return _fill(form, str(value).zfill(n))


def _phone(form: str, net: Feistel) -> str:
    code = re.match(r"(?:\+\d{1,3}(?=[ .(-]))?", form)[0]
    digits = _digits(form[len(code):])
    return code + _fill(form[len(code):], str(net.permute(int(digits), 10 ** len(digits), f"phone{len(digits)}")).zfill(len(digits)))


def _address(form: str, net: Feistel) -> str | None:
    parts = [int(x) for x in form.split(".")]
    if max(parts) > 255 or any(str(p) != x for p, x in zip(parts, form.split("."), strict=True)):
        return None
    value = net.permute(int.from_bytes(bytes(parts), "big"), 1 << 32, "ipv4")
    return ".".join(map(str, value.to_bytes(4, "big")))


FIRST_DAY, LAST_DAY = datetime.date(1900, 1, 1), datetime.date(2099, 12, 31)


def _date(form: str, net: Feistel) -> str | None:
    """The day is permuted; two forms of one day stay two forms of one day."""
    mark = re.search(r"\D", form)[0]
    parts = form.split(mark)
    orders = ["ymd"] if len(parts[0]) == 4 else ["dmy"] if mark == "." else ["mdy", "dmy"]
    for order in orders:
        was = dict(zip(order, parts, strict=True))
        try:
            day = datetime.date(int(was["y"]), int(was["m"]), int(was["d"]))
        except ValueError:
            continue
        if FIRST_DAY <= day <= LAST_DAY:
            new = FIRST_DAY + datetime.timedelta(net.permute((day - FIRST_DAY).days, (LAST_DAY - FIRST_DAY).days + 1, "date"))
            now = {"y": f"{new.year:04d}", "m": f"{new.month:0{len(was['m'])}d}", "d": f"{new.day:0{len(was['d'])}d}"}
            return mark.join(now[k] for k in order)
    return None


def _social(form: str, net: Feistel) -> str | None:
    area, group, serial = (int(x) for x in form.split("-"))
    if area in (0, 666) or area >= 900 or not group or not serial:
        return None
    area -= 1 + (area > 666)
    value = net.permute((area * 99 + group - 1) * 9999 + serial - 1, 898 * 99 * 9999, "ssn")
    value, serial = divmod(value, 9999)
    area, group = divmod(value, 99)
    area += 1
    return f"{area + (area >= 666):03d}-{group + 1:02d}-{serial + 1:04d}"


def _iban_rest(text: str) -> int:
    return int("".join(str(int(c, 36)) for c in text[4:] + text[:4])) % 97


def _iban(form: str, net: Feistel) -> str | None:
    plain = form.replace(" ", "").upper()
    if not 15 <= len(plain) <= 34 or _iban_rest(plain) != 1:
        return None
    account = _by_class(plain[4:], net, f"iban{plain[:2]}")
    new = f"{plain[:2]}{98 - _iban_rest(plain[:2] + '00' + account):02d}{account}"
    rest = iter(new)
    return "".join(c if c == " " else next(rest) for c in form)


def _email(form: str, net: Feistel) -> str:
    """The user and the host move apart, so users of one host stay together; the last label stays."""
    user, _, host = form.rpartition("@")
    name, _, top = host.rpartition(".")
    return f"{_by_class(user, net, 'user')}@{_by_class(name, net, 'host')}.{top}"


def _secret(form: str, net: Feistel) -> str:
    head = re.match(r"(?i)(?:[a-z_-]+\s*[:=]\s*[\"']?)?(?:AKIA|ASIA)?", form)[0]
    body = form[len(head):]
    return head + _in_one(body, net, "secret")


KINDS = {
    "secret": (r"(?i:(?:api[_-]?key|access[_-]?key|auth[_-]?token|token|secret|password|passwd|pwd)\s*[:=]\s*[\"']?)[A-Za-z0-9+/_.~-]{8,}|\b(?:AKIA|ASIA)[A-Z0-9]{16}\b", _secret),
    "email": (r"\b[^\W_](?:[\w.%+-]*\w)?@(?:[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?\.)+[A-Za-z]{2,}", _email),
    "iban": (r"\b[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,4})?\b", _iban),
    "ipv4": (r"(?<![\d.])\d{1,3}(?:\.\d{1,3}){3}(?![\d]|\.\d)", _address),
    "date": (r"(?<![\d/.-])(?:\d{4}-\d{1,2}-\d{1,2}|\d{4}/\d{1,2}/\d{1,2}|\d{1,2}/\d{1,2}/\d{4}|\d{1,2}\.\d{1,2}\.\d{4}|\d{1,2}-\d{1,2}-\d{4})(?![\d/-]|\.\d)", _date),
    "ssn": (r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])", _social),
    "phone": (r"\+\d{1,3}[ .-]?(?:\(\d{1,4}\)[ .-]?)?\d{2,4}(?:[ .-]?\d{2,4}){1,4}(?!\d)|(?<![\d(])\(\d{3}\) ?\d{3}[ .-]\d{4}(?!\d)|(?<![\d.-])\d{3}[ .-]\d{3}[ .-]\d{4}(?![\d-])", _phone),
    "number": (r"(?<![\d.])\d(?:[ -]?\d){12,18}(?![\d])|(?<![\d.])\d{12,30}(?![\d])", _number),
}
_MAYBE = re.compile(r"[0-9@=:]")
_FIND = {kind: re.compile(pattern) for kind, (pattern, _) in KINDS.items()}


def pseudonymise(text: str | None, net: Feistel) -> tuple[str | None, Counter]:
    """The text with every found value replaced, and how many of each kind. Where two kinds overlap, the
    one that comes first in KINDS counts. Values that fail their validation stay."""
    found: Counter = Counter()
    if not text or not _MAYBE.search(text):
        return text, found
    taken: list[tuple[int, int, str]] = []
    for kind, pattern in _FIND.items():
        for m in pattern.finditer(text):
            if all(m.end() <= a or m.start() >= b for a, b, _ in taken) and (new := KINDS[kind][1](m[0], net)) is not None:
                taken.append((m.start(), m.end(), new))
                found[kind] += 1
    out, at = [], 0
    for start, end, new in sorted(taken):
        out += [text[at:start], new]
        at = end
    return "".join([*out, text[at:]]), found


def _mapped(text_col: str, key: bytes, counts: bool):
    @tidied
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = Feistel(key)
        for batch in batches:
            done = [pseudonymise(t, net) for t in batch.column(text_col).to_pylist()]
            at = batch.schema.get_field_index(text_col)
            columns = [pa.array([t for t, _ in done], pa.string()) if i == at else c for i, c in enumerate(batch.columns)]
            names = list(batch.schema.names)
            if counts:
                columns += [pa.array([sum(n.values()) for _, n in done], pa.int64()), pa.array([",".join(f"{k}:{n[k]}" for k in KINDS if n[k]) for _, n in done], pa.string())]
                names += ["n_replaced", "kinds"]
            yield pa.RecordBatch.from_arrays(columns, names)
    return run


def pseudonyms(docs: DataFrame, key: bytes, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, text with pseudonyms, n_replaced, kinds ("email:2,ipv4:1").

    A null text stays null and an empty one empty; a text without private data stays as it is; very long texts are read
    whole; where two kinds claim the same place, the one listed first in KINDS has it; repeated rows give repeated results;
    further columns are not looked at; an empty table gives an empty result."""
    prepare(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(_mapped("text", key, True), "doc_id long, text string, n_replaced long, kinds string")


def replace_private(docs: DataFrame, key: bytes, text_col: str = "text") -> DataFrame:
    """The input with its texts replaced as pseudonyms() does; all columns and rows stay, null and empty texts too."""
    prepare(docs.sparkSession)
    return docs.mapInArrow(_mapped(text_col, key, False), docs.schema)


def op8_pii_pseudonyms(spark, sf_dir):
    return pseudonyms(table(spark, sf_dir, "documents"), key_of(spark))
