"""Secret scan with corpus-wide ownership frequency (operator 8)."""

from __future__ import annotations

import hashlib
import re
import uuid
from collections import Counter
from collections.abc import Iterator
from math import log2

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import partition_id, stored
from .words import text_slices

# The base kinds' patterns; a match that is too short is dropped after it has been consumed.
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
_ACCESS = re.compile(r"AKIA[A-Z0-9]{12,}")
_HEX = re.compile(r"[0-9a-f]{32,}")
BASE = ("assign", "access", "hex")
#: Further candidates; they, too, are judged by who holds them.
_MORE = {
    "bearer": re.compile(r"\b[Bb]earer\x20+([A-Za-z0-9._~+/=-]{20,})"),
    "forge": re.compile(r"\bgh[pousr]_[A-Za-z0-9]{36,}"),
    "pem": re.compile(r"-----BEGIN\x20(?:[A-Z]+\x20)*PRIVATE\x20KEY-----[A-Za-z0-9+/=\s]+-----END\x20(?:[A-Z]+\x20)*PRIVATE\x20KEY-----"),
}
KINDS = (*BASE, *_MORE, "live")
# Words that mark a placeholder; short ones only where they stand apart from letters and digits.
_PLACEHOLDER = re.compile(r"example|sample|placeholder|change_?me|your[_-]|password|passwd|foobar|(?<![a-z0-9])(?:test|dummy)(?![a-z0-9])", re.IGNORECASE)

#: A value held by so many owners or more is a widely copied example.
COPIED_BY = 3

#: Texts with live values whose digests and values' hashes (about 100 bytes each) are broadcast at most, to be masked; more are joined by a shuffle.
MOST_LIVE = 1 << 17

_FOUND = "row long, doc_id long, digest binary, repo string, owner string, n_assign long, n_access long, n_hex long, base_sha256 string, found array<struct<start:int,rank:int,stop:int,value_start:int,value_stop:int,hash:string,plausible:boolean>>"


def _in_a_row(value: str) -> int:
    """The longest stretch of equal characters, or of characters that each follow the one before."""
    longest, now, step = 1, 1, None
    for a, b in zip(value, value[1:], strict=False):
        d = ord(b) - ord(a)
        now = now + 1 if d == step else 2 if d in (0, 1) else 1
        step = d if d in (0, 1) else None
        longest = max(longest, now)
    return longest


def looks_live(value: str) -> bool:
    """Whether a value is mixed enough for a generated credential: 8 characters, no placeholder's word, no half of it in a row (0000, 1234), more than 2.5 bits a character."""
    n = len(value)
    if n < 8 or _PLACEHOLDER.search(value) or 2 * _in_a_row(value) >= n:
        return False
    return -sum(c / n * log2(c / n) for c in Counter(value).values()) > 2.5


def candidates(text: str) -> list[tuple[int, int, int, int, int]]:
    """(start, kind's rank in KINDS, stop, value's start, value's stop) by start, then kind; code points, ends exclusive."""
    found = [(m.start(), 0, m.end(), m.start(2), m.end(2)) for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 8]
    for rank, pattern in enumerate((_ACCESS, _HEX), 1):
        found += [(m.start(), rank, m.end(), m.start(), m.end()) for m in pattern.finditer(text)]
    for rank, pattern in enumerate(_MORE.values(), 3):
        found += [(m.start(), rank, m.end(), *m.span(m.re.groups and 1)) for m in pattern.finditer(text)]
    return sorted(found)


def _digest(found: list[tuple]) -> str:
    return hashlib.sha256(",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e, *_ in found).encode()).hexdigest()


def _digest_of(text: str) -> Column:
    """What names a text: rows with one text hold the same values, whatever their ids."""
    return F.unhex(F.sha2(F.col(text).cast("string"), 256))


def scan(docs: DataFrame, repo: str, owner: str) -> DataFrame:
    """Every document's candidates, each with its value's hash; ``docs`` has doc_id, text and the two named columns. ``row`` tells repeated rows apart, ``digest`` (SHA-256) names the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind, row = pa.list_(pa.struct([("start", pa.int32()), ("rank", pa.int32()), ("stop", pa.int32()), ("value_start", pa.int32()), ("value_stop", pa.int32()), ("hash", pa.string()), ("plausible", pa.bool_())])), partition_id() << 33
        for batch in text_slices(batches):
            lists, digests, counts = [], [], ([], [], [])
            for text in batch.column(1).to_pylist():
                found = candidates(text or "")
                base = [x for x in found if x[1] < 3]
                for k in range(3):
                    counts[k].append(sum(x[1] == k for x in base))
                digests.append(_digest(base))
                lists.append([(*x, hashlib.sha256(text[x[3] : x[4]].encode()).hexdigest(), looks_live(text[x[3] : x[4]])) for x in found])
            n = batch.num_rows
            yield pa.RecordBatch.from_arrays([pa.array(range(row, row + n), pa.int64()), batch.column(0), batch.column(4), batch.column(2), batch.column(3), *(pa.array(c, pa.int64()) for c in counts), pa.array(digests, pa.string()), pa.array([[dict(zip(("start", "rank", "stop", "value_start", "value_stop", "hash", "plausible"), x, strict=True)) for x in found] for found in lists], kind)], ["row", "doc_id", "digest", "repo", "owner", "n_assign", "n_access", "n_hex", "base_sha256", "found"])
            row += n

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col(repo).cast("string").alias("repo"), F.col(owner).cast("string").alias("owner"), _digest_of("text").alias("digest")).mapInArrow(run, _FOUND)


def ownership(found: DataFrame) -> DataFrame:
    """For each candidate value's hash: its distinct repositories and owners (a null one counts as one more). Pairs are made distinct before hashes meet, so a value that a third of all documents copy moves as few rows."""
    pairs = found.select("repo", "owner", F.explode("found.hash").alias("hash")).distinct()
    repos = pairs.groupBy("hash").agg(F.count(F.lit(1)).alias("n_repos"))
    owners = pairs.select("hash", "owner").distinct().groupBy("hash").agg(F.count(F.lit(1)).alias("n_owners"))
    return repos.join(owners, "hash")


def secret_scan(docs: DataFrame, repo: str, owner: str, copied_by: int = COPIED_BY) -> tuple[DataFrame, DataFrame]:
    """Documents' spans, and the candidates with their verdicts.

    First: doc_id, n_assign, n_access, n_hex, base_sha256, spans (array of start, rank, stop), n_live, n_copied; one row per
    row of ``docs``. A candidate whose value fewer than ``copied_by`` owners hold, and which looks generated, is live: its value's
    span is added with kind ``live``. Second: doc_id, digest (of the whole text), start, stop, value_start, value_stop, hash, n_repos, n_owners, live.
    A null text counts as empty, and gives no spans.
    """
    found = stored(scan(docs, repo, owner), "secrets")
    each = found.select("row", "doc_id", "digest", F.explode("found").alias("x")).select("row", "doc_id", "digest", "x.*")
    judged = each.join(stored(ownership(found), "ownership", short=True), "hash").withColumn("live", F.col("plausible") & (F.col("n_owners") < copied_by))
    judged = stored(judged, "judged")
    live = F.struct(F.col("value_start").alias("start"), F.lit(KINDS.index("live")).alias("rank"), F.col("value_stop").alias("stop"))
    added = judged.groupBy("row").agg(F.collect_list(F.when(F.col("live"), live)).alias("added"), F.count_if("live").alias("n_live"), F.count_if(F.col("n_owners") >= copied_by).alias("n_copied"))
    base = F.transform("found", lambda x: F.struct(x["start"].alias("start"), x["rank"].alias("rank"), x["stop"].alias("stop")))
    none = F.array().cast("array<struct<start:int,rank:int,stop:int>>")
    spans = F.array_sort(F.concat(base, F.coalesce("added", none)))
    zero = F.lit(0).cast("long")
    return found.join(added, "row", "left").select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", spans.alias("spans"), F.coalesce("n_live", zero).alias("n_live"), F.coalesce("n_copied", zero).alias("n_copied")), judged.drop("row", "rank", "plausible")


def spans_text(spans: str, kinds: tuple[str, ...]):
    """A column of spans as kind:start:end, joined by commas."""
    names = F.array(*(F.lit(k) for k in kinds))
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.element_at(names, x["rank"] + 1), x["start"].cast("string"), x["stop"].cast("string"))), ",")


def redact(docs: DataFrame, judged: DataFrame, mask: str = "[SECRET]") -> DataFrame:
    """``docs`` with every live value replaced by ``mask``; all else, and texts without one, stays as it is.

    A text is found by its digest, so rows without a doc_id and rows that share one are masked like others, and columns may have any names.
    """
    live = judged.where("live").groupBy("digest").agg(F.collect_set(F.unhex("hash")).alias("hashes"))
    key, held = (f"{name}_{uuid.uuid4().hex}" for name in ("digest", "hashes"))
    live = stored(live.select(F.col("digest").alias(key), F.col("hashes").alias(held)), "live", short=True)
    if live.count() <= MOST_LIVE:
        live = F.broadcast(live)

    @F.pandas_udf("string")
    def masked(texts, hashes):
        def one(text, own):
            if text is None or own is None:
                return text
            own, out, at = {bytes(x) for x in own}, [], 0
            for *_, a, b in sorted(candidates(text), key=lambda x: x[3]):
                if a >= at and hashlib.sha256(text[a:b].encode()).digest() in own:
                    out += [text[at:a], mask]
                    at = b
            return "".join([*out, text[at:]])

        return texts.__class__([one(t, h) for t, h in zip(texts, hashes, strict=True)])

    joined = docs.join(live, _digest_of("text") == F.col(key), "left")
    hit = F.col(held).isNotNull()  # other texts stay out of Python
    return joined.withColumn("text", F.when(hit, masked(F.when(hit, F.col("text")), F.col(held))).otherwise(F.col("text"))).select(*docs.columns)
