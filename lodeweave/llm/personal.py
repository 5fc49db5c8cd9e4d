"""Personal data by anchor expansion: Aho-Corasick anchors, local parsers (operator 9)."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "login", "account", "address")

# What the base kinds consist of, as the local parsers use it.
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_DOTTED = re.compile(r"[0-9.]+")
_DIGITS = re.compile(r"[0-9]+")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
# The added kinds: credentials in a URL, an account number after its cue, a street address around its cue.
_LOGIN = re.compile(r"[A-Za-z0-9._~%!$&'()*+,;=-]+:[^\s@/:]+@[A-Za-z0-9.-]+")
_IBAN = re.compile(r"[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?")
_GAP = re.compile(r"[\x20:=#]{1,3}")
_AFTER = re.compile(r"(?:\x20?(?:number|no\.?|nr\.?|#))?[\x20:=#]{1,3}([A-Z]{0,2}[0-9][0-9\x20-]{4,32}[0-9])")
_HOUSE = re.compile(r"[0-9]{1,5}[A-Za-z]?\x20(?:[A-Z][A-Za-z'.-]{0,30}\x20){1,4}$")
_SCHEMES = ("://",)
_ACCOUNTS = ("IBAN", "iban", "Account", "account", "acct", "Konto", "cuenta", "compte")
_STREETS = ("Street", "Avenue", "Road", "Lane", "Boulevard")


def _luhn(digits: str) -> bool:
    odd, even = digits[-1::-2], digits[-2::-2]
    return (sum(map(int, odd)) + sum(sum(divmod(2 * int(c), 10)) for c in even)) % 10 == 0


def _byte(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) < 4 and int(part or 0) <= 255


def _dotted_quads(text: str, low: int, high: int) -> Iterator[tuple[int, int]]:
    """Of a stretch of digits and dots, runs of digits by fours, each parted by one dot: leftmost, consumed whether or not their parts are bytes. Each run is read once."""
    runs: list[tuple[int, int]] = []
    for m in _DIGITS.finditer(text, low, high):
        if runs and m.start() != runs[-1][1] + 1:
            runs = []
        runs.append(m.span())
        if len(runs) == 4:
            if all(_byte(text[a:b]) for a, b in runs):
                yield runs[0][0], runs[3][1]
            runs = []


def _iban(value: str) -> bool:
    value = value.replace(" ", "")
    return 15 <= len(value) <= 34 and int("".join(str(int(c, 36)) for c in value[4:] + value[:4])) % 97 == 1


def automaton():
    import ahocorasick

    found = ahocorasick.Automaton()
    for kind, words in (("@", "@"), ("+", "+"), ("0", "0123456789"), ("s", _SCHEMES), ("a", _ACCOUNTS), ("r", _STREETS)):
        for word in words:
            found.add_word(word, (kind, len(word)))
    found.make_automaton()
    return found


def find(text: str, anchors) -> list[tuple[int, int, int]]:
    """(start, kind's rank in KINDS, stop) by start, then kind; code points, ends exclusive.

    The base kinds come out as their patterns' leftmost non-overlapping matches would, failing ones dropped: each match holds an
    anchor, and what a kind's parser has consumed is not parsed for that kind again.
    """
    found = []
    mail = dotted = card = 0  # up to where these kinds have consumed the text
    for last, (kind, n) in anchors.iter(text):
        at = last - n + 1
        if kind == "0":
            if at >= dotted:
                dotted = _DOTTED.match(text, at).end()
                if text.count(".", at, dotted) >= 3:
                    found += [(a, 1, b) for a, b in _dotted_quads(text, at, dotted)]
            if at >= card:
                m = _CARD.match(text, at)
                card = m.end() if m else at + 1
                if m and card - at >= 12:
                    digits = m[0].replace(" ", "").replace("-", "")
                    if 12 <= len(digits) <= 19 and _luhn(digits):
                        found.append((at, 2, card))
        elif kind == "@":
            start = at
            while start > mail and text[start - 1] in _LOCAL:
                start -= 1
            if start < at and (m := _DOMAIN.match(text, at + 1)):
                mail = m.end()
                found.append((start, 0, mail))
        elif kind == "+":
            if (m := _PHONE.match(text, at)) and 9 <= sum(c.isdigit() for c in m[0]) <= 15:
                found.append((at, 3, m.end()))
        elif kind == "s":
            if m := _LOGIN.match(text, last + 1):
                found.append((last + 1, 4, m.end()))
        elif kind == "a":
            own = _GAP.match(text, last + 1)
            if own and (m := _IBAN.match(text, own.end())) and _iban(m[0]):
                found.append((m.start(), 5, m.end()))
            elif (m := _AFTER.match(text, last + 1)) and 6 <= sum(c.isdigit() for c in m[1]) <= 20:
                found.append((m.start(1), 5, m.end(1)))
        elif m := _HOUSE.search(text, max(0, at - 140), at):
            found.append((m.start(), 6, last + 1))
    return sorted(set(found))


def personal_data(docs: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256 and spans (array of start, rank in KINDS, stop) of every row of ``docs`` (doc_id, text).

    A null text counts as empty. Rows are independent of each other: nothing is shuffled, repeated rows give repeated results.
    """
    shape = pa.list_(pa.struct([("start", pa.int32()), ("rank", pa.int32()), ("stop", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchors = automaton()
        for batch in batches:
            counts, digests, spans = ([], [], [], []), [], []
            for text in batch.column(1).to_pylist():
                found = find(text, anchors) if text else []
                base = [x for x in found if x[1] < 4]
                for k in range(4):
                    counts[k].append(sum(x[1] == k for x in base))
                digests.append(hashlib.sha256(",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in base).encode()).hexdigest())
                spans.append([{"start": s, "rank": k, "stop": e} for s, k, e in found])
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.int64()) for c in counts), pa.array(digests, pa.string()), pa.array(spans, shape)], ["doc_id", *(f"n_{k}" for k in BASE), "base_sha256", "spans"])

    schema = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans array<struct<start:int,rank:int,stop:int>>"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, schema)
