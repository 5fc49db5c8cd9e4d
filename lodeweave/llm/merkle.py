"""Merkle manifest of a dataset: a tree for each source over its rows in order, and one over the sources (operator 13)."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import stored

FANOUT = 16
#: Levels that a block is closed over: FANOUT ** LEVELS nodes are one task's unit, whatever the size of a source.
LEVELS = 3
_HEX = 64


def leaf(fields: Sequence[str | Column]) -> Column:
    """SHA-256 of the fields one after the other: "-" for null, else the UTF-8 byte count, ":" and the value (integers decimal)."""

    def one(x: str | Column) -> Column:
        text = (F.col(x) if isinstance(x, str) else x).cast("string")
        return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))

    return F.sha2(F.concat(*(one(x) for x in fields)), 256)


def _key(column: str) -> Column:
    """A column as a string that is never null, in the same order with null first."""
    text = F.col(column).cast("string")
    return F.when(text.isNull(), F.lit("")).otherwise(F.concat(F.lit("="), text))


def positioned(rows: DataFrame, key: str, order: Sequence[str]) -> DataFrame:
    """``rows`` with ``pos``, each row's place from 0 within its key by ``order`` (nulls first), and ``n``, the key's rows; in a stored table.

    Rows are sorted in ranges over key and order, so a key with most of the rows is spread over all ranges. A range's rows of a key are then numbered
    from the rows of the ranges before, which is a sum over one small row for each range and key in it. ``order`` has to tell all rows apart or alike.
    """
    by = [key, *order]
    rows = rows.repartitionByRange(*(F.col(c).asc_nulls_first() for c in by)).sortWithinPartitions(*(F.col(c).asc_nulls_first() for c in by))
    at = F.monotonically_increasing_id()
    rows = stored(rows.withColumn("at", at), "ordered").withColumn("range", F.shiftright("at", 33))
    ranges = rows.groupBy(key, "range").agg(F.count(F.lit(1)).alias("own"), F.min("at").alias("first"))
    earlier = F.coalesce(F.sum("own").over(Window.partitionBy(key).orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranges = ranges.select(key, "range", (earlier - F.col("first")).alias("shift"), F.sum("own").over(Window.partitionBy(key)).alias("n"))
    found = rows.join(stored(ranges, "ranges", short=True), [key, "range"])
    return found.withColumn("pos", F.col("at") + F.col("shift")).drop("at", "range", "shift")


# within a block


def levels_of(n: int, fanout: int = FANOUT) -> int:
    """Levels above n nodes until one remains."""
    levels = 0
    while n > 1:
        n, levels = -(-n // fanout), levels + 1
    return levels


def _sha(*parts) -> bytes:
    h = hashlib.sha256()
    for p in parts:
        h.update(p)
    return h.hexdigest().encode()


def matrices(digests: np.ndarray, levels: int, fanout: int = FANOUT) -> list[np.ndarray]:
    """The digest matrix (nodes x 64 hex bytes, contiguous) of each level from ``digests`` up: rows of ``fanout`` nodes are hashed as they lie, the last run by itself."""
    found = [np.ascontiguousarray(digests)]
    for _ in range(levels):
        below = found[-1]
        full = len(below) // fanout
        runs = [hashlib.sha256(row).hexdigest() for row in below[: full * fanout].reshape(full, fanout * _HEX)]
        if full * fanout < len(below):
            runs.append(hashlib.sha256(below[full * fanout :].reshape(-1)).hexdigest())
        found.append(np.frombuffer("".join(runs).encode(), np.uint8).reshape(-1, _HEX))
    return found


def siblings(own: list[np.ndarray], i: int, fanout: int = FANOUT) -> Iterator[tuple[memoryview, memoryview]]:
    """For node i of the lowest matrix the bytes of its run to the left and to the right of it, level by level below the top."""
    for below in own[:-1]:
        raw, start = memoryview(below.reshape(-1)), i - i % fanout
        yield raw[start * _HEX : i * _HEX], raw[(i + 1) * _HEX : min(start + fanout, len(below)) * _HEX]
        i //= fanout


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows (key, block, ...) as one batch for each block."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        key, block = batch.column(0).dictionary_encode().indices.to_numpy(), batch.column(1).to_numpy()
        cuts = [0, *(np.flatnonzero((np.diff(key) != 0) | (np.diff(block) != 0)) + 1).tolist(), batch.num_rows]
        if held and (held[0].column(0)[0], held[0].column(1)[0]) != (batch.column(0)[0], batch.column(1)[0]):
            yield pa.concat_batches(held)
            held = []
        for a, b in zip(cuts, cuts[1:], strict=False):
            held.append(batch.slice(a, b - a))
            if b < batch.num_rows:
                yield pa.concat_batches(held)
                held = []
    if held:
        yield pa.concat_batches(held)


def _digests(column: pa.Array) -> np.ndarray:
    return np.frombuffer("".join(column.to_pylist()).encode(), np.uint8).reshape(-1, _HEX)


def _own_levels(n: int, fanout: int, levels: int) -> int:
    """Levels that a block of a key with n nodes has: all, or as many as the key needs."""
    return min(levels, levels_of(n, fanout))


_PATH = "array<struct<left:binary,right:binary>>"
_PAIR = pa.list_(pa.struct([("left", pa.binary()), ("right", pa.binary())]))


def _in_blocks(rows: DataFrame) -> DataFrame:
    """``rows`` (key, block, pos, ...) with each block whole in a partition, by key, block and place. A block has a bounded size, so no key is too large for a task."""
    return rows.repartition("key", "block").sortWithinPartitions("key", "block", "pos")


def tops(nodes: DataFrame, fanout: int = FANOUT, levels: int = LEVELS) -> DataFrame:
    """``nodes`` (key, pos, n, digest): key, pos (the block's number), n (the key's blocks) and digest of each block's top."""
    width = fanout**levels

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = []
        for block in _blocks(batches):
            n = block.column(3)[0].as_py()
            top = matrices(_digests(block.column(4)), _own_levels(n, fanout, levels), fanout)[-1]
            out.append((block.column(0)[0].as_py(), block.column(1)[0].as_py(), -(-n // width), top.tobytes().decode()))
        columns = list(zip(*out, strict=True)) or [[]] * 4
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.int64(), pa.string()), strict=True)], ["key", "pos", "n", "digest"])

    rows = nodes.select("key", F.expr(f"pos div {width}").alias("block"), "pos", "n", "digest")
    return _in_blocks(rows).mapInArrow(run, "key string, pos long, n long, digest string")


def paths(nodes: DataFrame, fanout: int = FANOUT, levels: int = LEVELS) -> DataFrame:
    """``nodes`` (key, pos, n, digest), few in comparison with the rows below: key, pos, top (of the key's tree) and path (siblings on either side, level by level up to it)."""
    tree = stored(tops(nodes, fanout, levels), "tops", short=True)
    width = fanout**levels

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in _blocks(batches):
            n = block.column(3)[0].as_py()
            own = matrices(_digests(block.column(4)), _own_levels(n, fanout, levels), fanout)
            for a in range(0, block.num_rows, 256):
                some = block.slice(a, min(256, block.num_rows - a))
                path = [[{"left": bytes(x), "right": bytes(y)} for x, y in siblings(own, i, fanout)] for i in range(a, a + some.num_rows)]
                tops_of = pa.array([own[-1].tobytes().decode()] * some.num_rows)
                yield pa.RecordBatch.from_arrays([some.column(0), some.column(1), some.column(2), tops_of, pa.array(path, _PAIR)], ["key", "block", "pos", "top", "path"])

    rows = nodes.select("key", F.expr(f"pos div {width}").alias("block"), "pos", "n", "digest")
    own = _in_blocks(rows).mapInArrow(run, f"key string, block long, pos long, top string, path {_PATH}")
    if not tree.where("n > 1").limit(1).count():
        return own.drop("block")
    above = paths(tree, fanout, levels).select("key", F.col("pos").alias("block"), F.col("top").alias("last"), F.col("path").alias("more"))
    return own.join(above, ["key", "block"]).select("key", "pos", F.col("last").alias("top"), F.concat("path", "more").alias("path"))


def _proven(rows: DataFrame, above: DataFrame, fanout: int, levels: int) -> DataFrame:
    """``rows`` (key, block, pos, n, doc_id, digest, seen) with what stands above their blocks (key, block, subroot, root, path): each leaf's proof and the root that ``seen`` folds to.

    A block's path comes as the first row of the block's stretch, so it isn't copied to its rows.
    """
    names = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in _blocks(batches):
            subroot, root, path = (block.column(k)[0].as_py() for k in (7, 8, 9))
            path = [(x["left"], x["right"]) for x in path]
            more = b"".join(x for pair in path for x in pair)
            block = block.slice(1)
            n = block.column(3)[0].as_py()
            own = matrices(_digests(block.column(5)), _own_levels(n, fanout, levels), fanout)
            proofs, roots = [], []
            for i, (digest, seen) in enumerate(zip(block.column(5).to_pylist(), block.column(6).to_pylist(), strict=True)):
                proof, node = hashlib.sha256(), (seen or digest).encode()
                for left, right in siblings(own, i, fanout):
                    proof.update(left)
                    proof.update(right)
                    node = _sha(left, node, right)
                proof.update(more)
                for left, right in path:
                    node = _sha(left, node, right)
                proofs.append(proof.hexdigest())
                roots.append(node.decode())
            k = block.num_rows
            yield pa.RecordBatch.from_arrays([block.column(4), block.column(5), pa.array([subroot] * k), pa.array([root] * k), pa.array(proofs), pa.array(roots)], names)

    none = F.lit(None)
    first = above.select("key", "block", F.lit(-1).cast("long").alias("pos"), none.cast("long").alias("n"), none.cast("long").alias("doc_id"), none.cast("string").alias("digest"), none.cast("string").alias("seen"), "subroot", "root", "path")
    rows = rows.select("key", "block", "pos", "n", "doc_id", "digest", "seen", none.cast("string").alias("subroot"), none.cast("string").alias("root"), none.cast(_PATH).alias("path"))
    return _in_blocks(rows.unionByName(first)).mapInArrow(run, "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string")


def manifest(docs: DataFrame, seen: dict[str, Column] | None = None, tampered: Column | None = None, source: str = "source", fields: Sequence[str] = ("doc_id", "source", "lang", "n_chars", "text"), fanout: int = FANOUT, levels: int = LEVELS) -> DataFrame:
    """For each row of ``docs``: doc_id, leaf, subroot (of its source's tree), root (of the tree over all sources), proof_sha256 (of the siblings from leaf to root), folded_root and verified.

    A source's leaves ascend by doc_id (null first; rows that share one by their leaves) and are hashed in runs of ``fanout``, level by level, until one remains; the sources' tops, null first and
    by their bytes, likewise. ``seen`` replaces columns where ``tampered`` holds (null: it doesn't): folded_root is what the leaf of such a row and its original siblings come to, and verified
    whether that is the root. Null is a source of its own; null fields count as "-"; an empty table has no root and gives no rows.

    Digests and ids alone move: into ranges to be numbered, then into blocks of fanout ** levels leaves. What stands above a block is worked out on one row for each block and reaches its rows once for the block.
    """
    width = fanout**levels
    changed = leaf([seen.get(f, F.col(f)) for f in fields]) if seen else F.lit(None).cast("string")
    if seen:
        changed = F.when(F.coalesce(tampered, F.lit(False)), changed)
    facts = docs.select(_key(source).alias("key"), F.col("doc_id").cast("long").alias("doc_id"), leaf(fields).alias("digest"), changed.alias("seen"))
    facts = stored(facts.withColumn("row", F.monotonically_increasing_id()), "leaves")
    rows = stored(positioned(facts, "key", ["doc_id", "digest", "row"]).drop("row").withColumn("block", F.expr(f"pos div {width}")), "positions")
    lows = stored(tops(rows.select("key", "pos", "n", "digest"), fanout, levels), "block-tops", short=True)
    within = paths(lows, fanout, levels)
    within = stored(within.select("key", F.col("pos").alias("block"), F.col("top").alias("subroot"), "path"), "block-paths", short=True)
    roots = positioned(within.where("block = 0").select(F.lit("").alias("key"), F.col("key").alias("of"), F.col("subroot").alias("digest")), "key", ["of"])
    roots = stored(roots, "subroots", short=True)
    over = paths(roots, fanout, levels).join(roots.select("pos", "of"), "pos").select(F.col("of").alias("key"), F.col("top").alias("root"), F.col("path").alias("more"))
    above = within.join(over, "key").select("key", "block", "subroot", "root", F.concat("path", "more").alias("path"))
    found = _proven(rows, above, fanout, levels)
    return found.withColumn("verified", F.col("folded_root") == F.col("root"))


def _oracle() -> str:
    """SQL for the query: trees as lists of digests, each leaf's way up as a recursion."""
    field = lambda x: f"coalesce(strlen(CAST({x} AS VARCHAR)) || ':' || CAST({x} AS VARCHAR), '-')"
    digest = lambda text: "sha256(" + " || ".join(field(x) for x in ("doc_id", "source", "lang", "n_chars", text)) + ")"
    crc = "xor(4294967295, list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT))), lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda a, z: xor(a >> 1, 3988292384 * (a & 1)))))"
    up = "list_transform(range(0, (len(nodes) + 15) // 16), lambda i: sha256(array_to_string(nodes[i * 16 + 1 : i * 16 + 16], '')))"
    return f"""
    WITH RECURSIVE
      d AS (SELECT doc_id, coalesce('=' || source, '') AS key, {digest("text")} AS leaf, CASE WHEN {crc} % 5 = 0 THEN {digest("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} END AS seen FROM documents),
      l AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos FROM d),
      t AS (SELECT key, 0 AS level, list(leaf ORDER BY pos) AS nodes FROM l GROUP BY key
            UNION ALL SELECT key, level + 1, {up} FROM t WHERE len(nodes) > 1),
      s AS (SELECT key, level AS height, nodes[1] AS subroot, row_number() OVER (ORDER BY key) - 1 AS rank FROM t WHERE len(nodes) = 1),
      u AS (SELECT 0 AS level, list(subroot ORDER BY rank) AS nodes FROM s
            UNION ALL SELECT level + 1, {up} FROM u WHERE len(nodes) > 1),
      c AS (SELECT key, level, nodes FROM t WHERE len(nodes) > 1
            UNION ALL SELECT key, height + level, nodes FROM s, u WHERE len(nodes) > 1),
      w AS (SELECT doc_id, key, pos, 0 AS level, pos AS i, '' AS proof, coalesce(seen, leaf) AS node FROM l
            UNION ALL
            SELECT doc_id, key, pos, level + 1, i // 16, proof || before || after, sha256(before || node || after)
            FROM (SELECT w.* EXCLUDE (i), x.i, array_to_string(nodes[x.i // 16 * 16 + 1 : x.i], '') AS before, array_to_string(nodes[x.i + 2 : x.i // 16 * 16 + 16], '') AS after
                  FROM w JOIN s USING (key) JOIN c ON c.key = w.key AND c.level = w.level, LATERAL (SELECT CASE WHEN w.level = s.height THEN s.rank ELSE w.i END AS i) x)),
      z AS (SELECT key, pos, arg_max(proof, level) AS proof, arg_max(node, level) AS node FROM w GROUP BY key, pos)
    SELECT l.doc_id, l.leaf, s.subroot, r.root, sha256(z.proof) AS proof_sha256, z.node AS folded_root, z.node = r.root AS verified
    FROM l JOIN z USING (key, pos) JOIN s USING (key), (SELECT nodes[1] AS root FROM u WHERE len(nodes) = 1) r
    """


ORACLE_SQL = _oracle()
