"""Operators 11 to 13 against brute-force versions: nulls, empty and long texts, ties, repeated rows, empty tables and extra columns."""

import glob
import gzip
import hashlib
import itertools
import os
import random
import re
import zlib

import duckdb
import pytest
from pyspark.sql import functions as F
from test_numbered import make_texts, split

from lodeweave.llm import filter_audit, merkle, queries, warc

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["op11_subset_zeta", "op12_gzip_normaliser", "op13_merkle_manifest"])
def test_query(spark, name):
    df = queries.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    with duckdb.connect() as con:
        for path in glob.glob(f"{SF}/*.parquet"):
            con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
        found = con.execute(queries.ORACLE_SQL[name])
        names = [c[0] for c in found.description]
        theirs = [tuple(r[names.index(c)] for c in columns) for r in found.fetchall()]
    assert sorted(names) == columns
    assert sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr) == sorted(theirs, key=repr)


# 11


def plain_audit(rows, labels):
    first, own = {}, {}
    for d, t, *_ in rows:
        if d is not None:
            first[t or ""] = min(first.get(t or "", d), d)
    for d, q, x in labels:
        own.setdefault(d, set()).update(name for name, v in (("quality", q), ("toxic", x)) if v == 1)
    judged = {}
    for d, t, s in rows:
        t = t or ""
        w = split(t)
        bad = {"A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 2 * len(t), "D": bool(re.search("[#$%&*|]", t)), "E": d is not None and first[t] < d}
        judged.setdefault(s or "", []).append(({k for k, v in bad.items() if v}, own.get(d, set()) if d is not None else set()))
    out = {}
    for part, docs in judged.items():
        total = dict.fromkeys("ABCDE", 0)
        for order in itertools.permutations("ABCDE"):
            left = docs
            for step, f in enumerate(order, 1):
                gone = [x for x in left if f in x[0]]
                left = [x for x in left if f not in x[0]]
                fails = sum(f in x[0] for x in docs)
                total[f] += len(gone)
                out[part, "".join(order), step] = [len(left), len(gone), fails - len(gone), sum(x[0] == {f} for x in docs), sum("quality" in x[1] for x in gone), sum("toxic" in x[1] for x in gone)]
        for (p, order, step), row in out.items():
            if p == part:
                row.append(total[order[step - 1]])
    return out


def test_filter_audit(spark):
    rng = random.Random(3)
    texts = [*make_texts(5, 30), "LOUD Text", "a # b", "a # b", "word " * 250, " ".join(f"w{i}" for i in range(260)) + " A$B", "É" * 40, "\x0b\x0c\r\n", "a\x1cb"]
    rows = [(i if rng.random() < 0.9 else None, t, rng.choice(["s", "t", "", None])) for i, t in enumerate([*texts, *texts[::3], *texts[:4]])]
    rows += [rows[5], rows[5], (rows[5][0], rows[5][1], "t"), (rows[5][0], "other", "t")]
    labels = [(i, i % 3 == 0 or None, i % 4 == 0) for i in range(0, 60, 2)] + [(2, 1, 0), (None, 1, 1)]
    labels = [(d, None if q is None else int(q), int(x)) for d, q, x in labels]
    docs = spark.createDataFrame([(*r, "x", 1, 2) for r in rows], "doc_id long, text string, source string, digest string, n int, part int").repartition(4)
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = {(r["part"], r["filter_order"], r["step"]): [r[c] for c in ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")] for r in filter_audit.audit(docs, marks).collect()}
    assert got == plain_audit(rows, labels)
    assert filter_audit.audit(docs.limit(0), marks).count() == 0
    assert {k: v[:4] for k, v in got.items()} == {(r["part"], r["filter_order"], r["step"]): [r["kept"], r["removed"], r["redundant"], r["unique_fails"]] for r in filter_audit.audit(docs, marks.limit(0)).collect()}


def test_other_filters(spark):
    """Filters are the caller's: three of them, one with a null condition, give 3! orders."""
    docs = spark.createDataFrame([(1, "x", "s", 1), (2, "y", "s", None), (3, "y", "s", 7)], "doc_id long, text string, source string, v int")
    marks = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    rows = filter_audit.audit(docs, marks, {"P": F.col("v") > 5, "Q": F.col("text") == "x"}, repeats="R").collect()
    assert len(rows) == 6 * 3
    assert {r["filter_order"]: r["kept"] for r in rows if r["step"] == 3} == dict.fromkeys(map("".join, itertools.permutations("PQR")), 1)
    assert {r["filter_order"][r["step"] - 1]: r["shapley"] for r in rows} == {"P": 3, "Q": 6, "R": 3}
    survivors = filter_audit.survivors(spark.createDataFrame([("s", m, m + 1) for m in range(8)], "part string, mask int, n long"), 3, ["n"]).first()["n"]
    assert survivors == [sum(m + 1 for m in range(8) if not m & s) for s in range(8)]


# 12


def plain_warc(rows):
    last = {}
    for d, _, h in rows:
        if d is not None and len((h or "").encode()) >= 1000:
            last[h] = max(last.get(h, d), d)
    out = []
    for d, _, h in rows:
        raw = (h or "").encode()
        revisit = h in last and d != last[h]
        out.append((d, len(raw), hashlib.sha1(raw).hexdigest(), "revisit" if revisit else "response", last[h] if revisit else None))
    return sorted(out, key=repr)


NAMES = ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
PAGES = "page_id long, url string, html string, digest string, bytes int, refers_to string"


def make_pages(seed):
    rng = random.Random(seed)
    bodies = ["x" * 999, "y" * 1000, "é" * 500, "WARC/1.1\r\n\r\n" * 90, "\r\n\r\n" * 300, "z" * 1500 + "\n", "\r\n", "", None, "\x00\r\r\n" * 400, "q" * 70000 + "\r\n"]
    rows = [(i - 20, rng.choice(["http://a/é b", None, "http://b/\r\nX: y"]), rng.choice(bodies)) for i in range(90)]
    return rows + rows[:3] + [(None, None, "y" * 1000), (None, None, "only " * 300), (None, None, "only " * 300), (None, None, "")]


def test_warc(spark, tmp_path):
    rows = make_pages(1)
    pages = spark.createDataFrame([(*r, "d", 1, "r") for r in rows], PAGES).repartition(3)
    got = sorted((tuple(r[c] for c in NAMES) for r in warc.write_and_read(pages).collect()), key=repr)
    assert got == plain_warc(rows)
    assert warc.write_and_read(pages.limit(0)).count() == 0


def test_archives(spark, tmp_path):
    """A stream is one gzip member; each record becomes one of its own at the place that the index names, in files of bounded size."""
    streams, path = str(tmp_path / "streams"), str(tmp_path / "archives")
    pages = spark.createDataFrame([(*r, "d", 1, "r") for r in make_pages(2)], PAGES).repartition(3)
    warc.write_streams(warc.records(*warc.deduplicated(pages)), streams)
    whole = b""
    for file in glob.glob(f"{streams}/*.gz"):
        inflate = zlib.decompressobj(31)
        whole += inflate.decompress(open(file, "rb").read())
        assert inflate.eof and not inflate.unused_data
    warc.normalise(spark, streams, path, file_bytes=3000)
    index = warc.read_index(spark, path)
    found, files = index.collect(), {}
    for file in glob.glob(f"{path}/kind=archive/segment=*/part-*"):
        key = int(re.search(r"part-(\d+)", file)[1]), int(re.search(r"segment=(\d+)", file)[1])
        files[key] = open(file, "rb").read()
        assert len(files[key]) < 6000
    assert len(files) > 4 and sum(len(x) for x in files.values()) == sum(r["length"] for r in found)
    assert sorted(b"".join(gzip.decompress(x) for x in files.values()).split(b"WARC/1.1\r\nWARC-Type")) == sorted(whole.split(b"WARC/1.1\r\nWARC-Type"))
    for r in found:
        own = gzip.decompress(files[r["part"], r["segment"]][r["offset"] : r["offset"] + r["length"]])
        assert own.startswith(b"WARC/1.1\r\nWARC-Type: " + r["record_type"].encode()) and own.endswith(b"\r\n\r\n")
        assert f"WARC-Record-ID: {r['id']}\r\n".encode() in own
    some = ["part", "segment", "offset", "length", *NAMES]
    rows = lambda df: sorted((tuple(r[c] for c in some) for r in df.collect()), key=repr)
    assert rows(index) == rows(warc.read_archives(spark, path))
    wanted = warc.fetch(spark, path, index.where("page_id = 7"))
    assert rows(wanted) == rows(index.where("page_id = 7")) and [r["payload"] for r in wanted.collect()] == [r["payload"] for r in warc.read_archives(spark, path, True).where("page_id = 7").collect()]


def test_foreign_streams(spark, tmp_path):
    """Streams of other writers: records of other types, a member for each record already, no line ends at the close, and one that breaks off."""
    block = b"payload with \r\n\r\n inside"
    record = lambda kind, more=b"": b"WARC/1.0\r\nWARC-Type: " + kind + b"\r\nWARC-Record-ID: <urn:x:" + kind + b">\r\nContent-Length: " + str(len(block)).encode() + more + b"\r\n\r\n" + block
    data = {"a": gzip.compress(record(b"warcinfo") + b"\r\n\r\n" + record(b"resource")), "b": b"".join(gzip.compress(record(x) + b"\r\n\r\n") for x in (b"one", b"two")), "c": gzip.compress(b""), "d": gzip.compress(record(b"three") + b"\r\n\r\n\r\n\r\n")}
    (tmp_path / "in").mkdir()
    for name, x in data.items():
        (tmp_path / "in" / f"{name}.warc.gz").write_bytes(x)
    warc.normalise(spark, str(tmp_path / "in"), str(tmp_path / "out"))
    got = warc.read_archives(spark, str(tmp_path / "out"), True).collect()
    assert sorted(r["record_type"] for r in got) == ["one", "resource", "three", "two", "warcinfo"]
    assert {bytes(r["payload"]) for r in got} == {block} and {r["payload_digest"] for r in got} == {hashlib.sha1(block).hexdigest()}
    (tmp_path / "in" / "e.warc.gz").write_bytes(gzip.compress(record(b"four")[:-9]))
    with pytest.raises(Exception, match="ends within a record"):
        warc.normalise(spark, str(tmp_path / "in"), str(tmp_path / "broken"))


def test_large_member():
    """A record of 16 MB or more has a length whose last byte isn't zero: an empty member closes it, and its place counts both."""
    record, small = b"WARC/1.0\r\n" + b"x" * (17 << 20), b"WARC/1.0\r\nsmall"
    data = warc.member(record) + warc.member(small)
    assert warc.member(record)[-1] == 0 == warc.member(small)[-1]
    assert gzip.decompress(data) == record + small
    found = list(warc._members(memoryview(data)))
    assert [x for *_, x in found] == [record, small] and sum(n for _, n, _ in found) == len(data)


def test_records_in_pieces():
    rng = random.Random(4)
    parts = [b"WARC/1.0\r\nContent-Length: %d\r\n\r\n%s\r\n\r\n" % (n, bytes(rng.choice(b"\r\nab") for _ in range(n))) for n in [0, 1, 4, 9, 50, 300]]
    for size in (1, 3, 7, 1000):
        cut, out, whole = warc._Records(), [], b"".join(parts)
        for a in range(0, len(whole), size):
            out += cut.add(whole[a : a + size])
        assert out == parts and cut.rest() == b""
    with pytest.raises(ValueError, match="not a WARC record"):
        list(warc._Records().add(b"something else\r\n\r\n"))


# 13


def plain_manifest(rows, fanout):
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    field = lambda x: "-" if x is None else f"{len(str(x).encode())}:{x}"
    leaf = lambda r: sha("".join(map(field, r)))
    lower = lambda t: t if t is None else re.sub("[A-Z]", lambda m: m[0].lower(), t)

    def tree(nodes):
        levels = [nodes]
        while len(levels[-1]) > 1:
            below = levels[-1]
            levels.append([sha("".join(below[i : i + fanout])) for i in range(0, len(below), fanout)])
        return levels

    trees, order = {}, {}
    for r in rows:
        order.setdefault(r[1], []).append(r)
    for s, own in order.items():
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        trees[s] = tree([leaf(r) for r in own])
    names = sorted(order, key=lambda s: (s is not None, (s or "").encode()))
    over = tree([trees[s][-1][0] for s in names])
    out = []
    for s, own in order.items():
        for k, r in enumerate(own):
            bad = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0
            node, proof = leaf((*r[:4], lower(r[4])) if bad else r), ""
            for levels, i in ((trees[s], k), (over, names.index(s))):
                for below in levels[:-1]:
                    a = i - i % fanout
                    left, right = "".join(below[a:i]), "".join(below[i + 1 : a + fanout])
                    proof, node, i = proof + left + right, sha(left + node + right), i // fanout
            out.append((r[0], leaf(r), trees[s][-1][0], over[-1][0], sha(proof), node, node == over[-1][0]))
    return sorted(out, key=repr)


LEAVES = "doc_id long, source string, lang string, n_chars long, text string, digest string, pos int, key string"


@pytest.mark.parametrize("fanout, levels, n", [(16, 3, 700), (2, 1, 37), (3, 2, 200), (2, 3, 1)])
def test_manifest(spark, fanout, levels, n):
    rng = random.Random(n)
    texts = [*make_texts(7, 10), "UPPER Case", "É ß", "q" * 50000]
    rows = [(i if rng.random() < 0.95 else None, "hot" if rng.random() < 0.6 else rng.choice(["a", None, "", "é", "B", "-"]), rng.choice(["en", None]), rng.choice([None, i]), rng.choice(texts)) for i in range(n)]
    rows += rows[:2] + [(rows[0][0], rows[0][1], "zz", None, "Other")]
    docs = spark.createDataFrame([(*r, "d", 1, "k") for r in rows], LEAVES).repartition(3)
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    lower = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    found = merkle.manifest(docs, {"text": lower}, tampered, fanout=fanout, levels=levels)
    assert sorted(map(tuple, found.collect()), key=repr) == plain_manifest(rows, fanout)


def test_plain_manifest(spark):
    """Without tampering all rows are verified; an empty table has none."""
    docs = spark.createDataFrame([(i, "s", "en", 1, "T", "d", 1, "k") for i in range(40)], LEAVES)
    assert {r["verified"] for r in merkle.manifest(docs).collect()} == {True}
    assert merkle.manifest(docs.limit(0)).count() == 0
