"""MinHash near-duplicates by SuperMinHash, banding, verification and union of links (operator 5)."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import free, partition_id, picked, scratch, stored
from .words import gram_hashes, mix, text_slices, word_hashes

SHINGLE = 5
#: Links need 100 * intersection >= PERCENT * union.
PERCENT = 80
SLOTS = 128
#: Bits of each slot that a short signature keeps.
BITS = 4
#: Rounds at least and at most in which each bucket compares with one member alone; between them, rounds go on while one leaves at most STALE of its rows to the next.
PIVOTS, MOST_PIVOTS, STALE = 2, 8, 0.9

#: Members of a bucket that one task compares with the bucket's others; larger buckets are dealt out.
SPLIT = 512
#: Links (16 bytes each) that one task joins by union-find; more are joined by rounds of label propagation.
MOST_LINKS = 1 << 18

#: Sets whose keys (24 bytes each) are broadcast at most; more are joined by a shuffle.
MOST_KEYS = 1 << 19

_U = np.uint64

_SIGNED = "row long, doc_id long, n long, set_key binary, bands array<long>, signature array<long>"


def shingle_sets(texts: pa.Array, n: int = SHINGLE) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text: n lower-cased words, or all of fewer; none without words."""
    words, at = word_hashes(texts, lower=True)
    grams = gram_hashes(words, n)
    out = []
    for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        if b - a >= n:
            out.append(np.unique(grams[a : b - n + 1]))
        else:
            out.append(gram_hashes(words[a:b], b - a, seed=b - a) if b > a else words[:0])
    return out


def _keys(sets: list[np.ndarray]) -> pa.Array:
    """16 bytes for each whole set; null for an empty one."""
    return pa.array([hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets], pa.binary())


def super_min_hash(sets: list[np.ndarray], m: int = SLOTS) -> np.ndarray:
    """SuperMinHash signatures (m values each) of several sets at once.

    Each element runs through the slots in a random order of its own, and its value in its j-th slot lies in [j, j+1): the ranks
    of one element are correlated, which lowers the variance. After j slots, a set whose slots all hold values below j is done:
    no later value can be smaller. The level is a value's top byte. An empty set's slots hold the largest value.
    """
    sizes = np.array([len(s) for s in sets], np.int64)
    out = np.full((len(sets), m), _U(2**64 - 1))
    if not sizes.sum():
        return out
    element = np.concatenate(sets)
    owner = np.repeat(np.arange(len(sets)), sizes)
    order, active = None, np.flatnonzero(sizes > 0)
    with np.errstate(over="ignore"):
        for level in range(m):
            random = mix(element + _U(0xA0761D6478BD642F) * _U(level + 1))
            choice = (level + ((random >> _U(56)) * _U(1) + (random << _U(8) >> _U(32))) % _U(m - level)).astype(np.int64)
            if level == 0:
                slot = choice
            else:
                if order is None:  # the first level's choice, as the shuffle's first exchange
                    order = np.broadcast_to(np.arange(m, dtype=np.uint8), (len(element), m)).copy()
                    rows = np.arange(len(element))
                    order[rows, 0], order[rows, first] = first.astype(np.uint8), 0
                rows = np.arange(len(element))
                slot = order[rows, choice]
                order[rows, choice] = order[rows, level]
                order[rows, level] = slot
                slot = slot.astype(np.int64)
            value = (_U(level) << _U(56)) | (mix(random) >> _U(8))
            np.minimum.at(out.reshape(-1), owner * m + slot, value)
            open_ = out[active].max(axis=1) >= (_U(level + 1) << _U(56))
            if not open_.any():
                break
            if not open_.all() or level == 0:
                active = active[open_]
                kept = np.isin(owner, active) if not open_.all() else np.ones(len(owner), bool)
                element, owner = element[kept], owner[kept]
                if level == 0:
                    first = choice[kept]
                else:
                    order = order[kept]
    return out


def signatures(docs: DataFrame, rows: int, shingle: int = SHINGLE) -> DataFrame:
    """For each document a number of its row, its number of shingles, a key of the whole set, the hashes of its bands of ``rows`` slots, and ``BITS`` bits of each slot, 16 slots to a number."""
    bands = SLOTS // rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = partition_id() << 33
        for batch in text_slices(batches):
            sets = shingle_sets(batch.column(1), shingle)
            full = super_min_hash(sets)
            hashed = np.zeros((len(sets), bands), _U)
            with np.errstate(over="ignore"):
                for i in range(rows):
                    hashed = mix(hashed * _U(31) + full[:, i : bands * rows : rows] + _U(1))
                hashed = mix(hashed + np.arange(bands, dtype=_U))
            held = [h if len(s) else None for h, s in zip(hashed.view(np.int64).tolist(), sets, strict=True)]
            each = 64 // BITS
            short = ((full & _U(2**BITS - 1)).reshape(len(sets), -1, each) << (BITS * np.arange(each, dtype=_U))).sum(axis=2, dtype=_U).view(np.int64).tolist()
            yield pa.RecordBatch.from_arrays([pa.array(range(row, row + len(sets)), pa.int64()), batch.column(0), pa.array([len(s) for s in sets], pa.int64()), _keys(sets), pa.array(held, pa.list_(pa.int64())), pa.array([b if len(s) else None for b, s in zip(short, sets, strict=True)], pa.list_(pa.int64()))], ["row", "doc_id", "n", "set_key", "bands", "signature"])
            row += len(sets)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, _SIGNED)


def full_sets(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """The key and the sorted shingle hashes of each document's set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches):
            sets = shingle_sets(batch.column(1), shingle)
            yield pa.RecordBatch.from_arrays([_keys(sets), pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))], ["set_key", "hashes"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "set_key binary, hashes array<long>")


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b), a stored table, whose full sets are alike enough."""
    sets = picked(sets, pairs.select("a").union(pairs.select("b")), "node")
    left = sets.select(F.col("node").alias("a"), F.col("hashes").alias("x"))
    right = sets.select(F.col("node").alias("b"), F.col("hashes").alias("y"))
    common = F.size(F.array_intersect("x", "y"))
    alike = 100 * F.col("common") >= percent * (F.size("x") + F.size("y") - F.col("common"))
    return pairs.join(left, "a").join(right, "b").withColumn("common", common).where(alike).select("a", "b")


def _union_find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """node and component of all the task's links: each node points at a smaller one of its component, the smallest at itself."""
    above: dict[int, int] = {}

    def find(x: int) -> int:
        top = x
        while above[top] != top:
            top = above[top]
        while above[x] != top:
            above[x], x = top, above[x]
        return top

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            above.setdefault(a, a)
            above.setdefault(b, b)
            x, y = find(a), find(b)
            if x != y:
                above[max(x, y)] = min(x, y)
    nodes = list(above)
    for k in range(0, len(nodes), 1 << 16):
        own = nodes[k : k + (1 << 16)]
        yield pa.RecordBatch.from_arrays([pa.array(own, pa.int64()), pa.array([find(x) for x in own], pa.int64())], ["node", "component"])


def components(links: DataFrame, most: int = MOST_LINKS) -> DataFrame:
    """node and component (the smallest node reachable) of every node in ``links`` (a, b).

    Up to ``most`` distinct links are joined by union-find in one task. Of more, each round gives a node the smallest label among its own and its neighbours',
    then that label's own label; rounds end when nothing changes.
    """
    links = stored(links.select("a", "b").distinct(), "distinct-links", short=True)
    if links.count() <= most:
        return stored(links.coalesce(1).mapInArrow(_union_find, "node long, component long"), "labels", short=True)
    both = stored(links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "links", short=True)
    labels = stored(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("component")), "labels", short=True)
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), "component"), "b").groupBy("a").agg(F.min("component").alias("near"))
        lower = labels.join(near.withColumnRenamed("a", "node"), "node").select("node", "component", F.least("component", "near").alias("lower"))
        lower = stored(lower, "lower", short=True)
        jump = lower.select(F.col("node").alias("lower"), F.col("lower").alias("further"))
        after = stored(lower.join(jump, "lower", "left").select("node", F.coalesce("further", "lower").alias("next"), "component"), "labels", short=True)
        changed = after.where(F.col("next") != F.col("component")).limit(1).count()
        labels = after.select("node", F.col("next").alias("component"))
        if not changed:
            return labels


def _joined(labels: DataFrame | None, links: DataFrame) -> DataFrame | None:
    """Labels after further ``links`` (a, b), whose ends are first replaced by their components."""
    if labels is None:
        return components(links) if links.limit(1).count() else None
    of = lambda name: labels.select(F.col("node").alias(name), F.col("component").alias(f"{name}_of"))
    short = links.join(of("a"), "a", "left").join(of("b"), "b", "left").select(F.coalesce("a_of", "a").alias("a"), F.coalesce("b_of", "b").alias("b")).where("a <> b")
    short = stored(short.distinct(), "contracted", short=True)
    if not short.limit(1).count():
        return labels
    above = components(short).withColumnRenamed("component", "root")
    moved = labels.join(above.withColumnRenamed("node", "component"), "component", "left").select("node", F.coalesce("root", "component").alias("component"))
    new = above.join(labels.select("node"), "node", "left_anti").select("node", F.col("root").alias("component"))
    return stored(moved.unionByName(new), "labels", short=True)


def near_duplicates(docs: DataFrame, percent: int = PERCENT, shingle: int = SHINGLE, pivots: int = PIVOTS) -> DataFrame:
    """doc_id, n_shingles, component_id (the smallest doc_id reachable by links, itself included) of each row of ``docs`` (doc_id, text).

    Equal sets are one node. Nodes that share a band are candidates; pairs whose signatures don't rule a link out are confirmed on their full sets. So that
    no group of copies is compared pair by pair, a bucket's members are compared with one pivot first, round by round with another one, and only as long
    as they lie in different components; what then lies outside its bucket's largest component is compared with all the bucket's members.
    Texts that are null or without words have an empty set and no links. Each row is a document of its own, also where rows share a doc_id or have none: links are found between
    texts, and ids only name what they join. A row that only rows without a doc_id are linked with has no component_id (without a link, and with an id, its own).
    The result is a stored table; what led to it is deleted.
    """
    with scratch(docs.sparkSession):
        return stored(_grouped(docs, percent, shingle, pivots), "groups", keep=True)


def _grouped(docs: DataFrame, percent: int, shingle: int, pivots: int) -> DataFrame:
    rows = 5 if percent >= 85 else 4
    signed = stored(signatures(docs, rows, shingle), "signatures")
    filled = signed.where("n > 0")
    nodes = stored(filled.groupBy("set_key").agg(F.min("row").alias("node"), F.min("doc_id").alias("least")), "nodes", short=True)
    held = picked(filled.withColumnRenamed("row", "node"), nodes.select("node"), "node")
    # Buckets are counted before members meet; both joins move a member once, and split a bucket that most members share.
    members = held.select(F.explode("bands").alias("bucket"), "node")
    shared = stored(members.groupBy("bucket").agg(F.count(F.lit(1)).alias("k")).where("k > 1"), "shared-buckets", short=True)
    members = stored(members.join(shared.hint("merge"), "bucket"), "shared", short=True)
    own = stored(picked(held, members.select("node"), "node"), "own", short=True)
    members = stored(members.join(own.select("node", "n", "signature"), "node"), "members", short=True)
    sets = stored(_own_sets(docs, own.select("node", "doc_id", "set_key"), shingle), "sets")

    labels, turn, before = None, 0, None
    while True:
        now = members if labels is None else members.join(labels, "node", "left")
        now = now.withColumn("component", F.col("node") if labels is None else F.coalesce("component", "node"))
        if turn:  # the first round takes one pivot a member, the second one all of them: then a bucket of two has had its only pair
            now = now.where("k > 2") if turn > 1 else now
            mixed = now.groupBy("bucket").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low < high").select("bucket")
            now = stored(now.join(stored(mixed, "mixed", short=True), "bucket"), "mixed-members", short=True)
            left = now.count()
            if not left:
                break
            free(docs.sparkSession)
            if turn >= MOST_PIVOTS or (turn >= pivots and before is not None and left > STALE * before):
                labels = _joined(labels, stored(_links_within(now, own, sets, percent), "verified", short=True))
                break
            before = left
        order = F.col("node") if turn == 0 else F.xxhash64("node", F.lit(turn))
        best = now.groupBy("bucket").agg(F.min(F.struct(order.alias("order"), "node", "n", "component", "signature")).alias("pivot"), F.ceil(F.max("k") / SPLIT).alias("parts"))
        # a large bucket's members are dealt out in parts, and its pivot goes to each
        best = best.select("bucket", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"), *(F.col(f"pivot.{c}").alias(f"other_{c}") for c in ("node", "n", "component", "signature")))
        dealt = now.withColumn("part", F.pmod(F.xxhash64("node"), F.ceil(F.col("k") / SPLIT)))
        pairs = dealt.join(best, ["bucket", "part"]).where((F.col("component") != F.col("other_component")) & _worth(percent))
        pairs = pairs.select(F.col("other_node").alias("a"), F.col("node").alias("b"))
        pairs = pairs.distinct() if turn else pairs.groupBy("b").agg(F.min("a").alias("a"))
        labels = _joined(labels, stored(verified(stored(pairs, "pairs", short=True), sets, percent), "verified", short=True))
        free(docs.sparkSession)
        turn += 1
    of_set = nodes.select("set_key", "node", "least")
    if labels is not None:
        named = labels.join(nodes.select("node", "least"), "node").groupBy("component").agg(F.min("least").alias("lowest"))
        labels = labels.join(stored(named, "named", short=True), "component").select("node", "lowest", F.lit(True).alias("linked"))
        of_set = of_set.join(labels, "node", "left").select("set_key", F.when(F.col("linked"), F.col("lowest")).otherwise(F.col("least")).alias("least"))
    of_set = stored(of_set.select("set_key", "least"), "components", short=True)
    return signed.join(of_set, "set_key", "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("least", "doc_id").alias("component_id"))


def _own_sets(docs: DataFrame, wanted: DataFrame, shingle: int) -> DataFrame:
    """node and hashes of each of ``wanted`` (node, doc_id, set_key): its text is found by doc_id, and among texts that share one, or have none, by the set itself."""
    docs = docs.select("doc_id", "text")
    texts = picked(docs, wanted.select("doc_id"))
    if wanted.where("doc_id IS NULL").limit(1).count():
        texts = texts.unionByName(docs.where("doc_id IS NULL"))
    keys = wanted.select("node", "set_key")
    found = full_sets(texts, shingle).join(F.broadcast(keys) if keys.count() <= MOST_KEYS else keys, "set_key").select("node", "hashes")
    return found.dropDuplicates(["node"]) if texts.groupBy("doc_id").count().where("count > 1").limit(1).count() else found


def _worth(percent: int):
    """Whether a row's and its ``other_`` partner's sizes and signatures allow a link."""
    similar = F.least("n", "other_n") * 100 >= F.greatest("n", "other_n") * percent
    return similar & _likely("signature", "other_signature", percent)


def _links_within(members: DataFrame, held: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) between members (bucket, node, n, signature, component) of one bucket that lie in different components.

    Members outside their bucket's largest component are compared with all its members, each pair in the first bucket that it shares, by size and signature.
    Members that have a pair there, but not the pairs, are found so that only they carry more: the upper halves of their sets' hashes, which the join itself
    compares. Halves only fall short of the true intersection where two of a set's own hashes share one, so with room for each such case on either side no
    link is lost; what is left is confirmed on the whole hashes.
    """
    names = ("bucket", "node", "n", "signature", "component", "bands", "outside", "parts")

    def dealt(rows: DataFrame) -> DataFrame:
        """The rows, each in one part of its bucket."""
        return rows.withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts"))).repartition("bucket", "part")

    def other(rows: DataFrame, *more: str) -> DataFrame:
        """The rows as partners, in every part of their bucket."""
        every = rows.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
        return every.select(*(F.col(c).alias(f"other_{c}") for c in (*names, "part", *more))).repartition("other_bucket", "other_part")

    sizes = members.groupBy("bucket", "component").agg(F.count(F.lit(1)).alias("size")).groupBy("bucket").agg(F.max(F.struct("size", "component")).alias("most"), F.ceil(F.sum("size") / SPLIT).alias("parts"))
    bands = picked(held.select("node", "bands"), members.select("node"), "node")
    sided = members.join(sizes.select("bucket", F.col("most.component").alias("main"), "parts"), "bucket").withColumn("outside", F.col("component") != F.col("main"))
    sided = stored(sided.join(bands, "node").select(*names), "sided", short=True)
    first = F.array_position(F.zip_with("bands", "other_bands", lambda x, y: x == y), True) == F.array_position("bands", F.col("bucket"))
    meet = (F.col("bucket") == F.col("other_bucket")) & (F.col("part") == F.col("other_part"))
    apart = meet & (F.col("component") != F.col("other_component")) & _worth(percent) & first
    outside = sided.where("outside")
    paired = dealt(outside).join(other(sided), apart, "left_semi").unionByName(dealt(sided.where("NOT outside")).join(other(outside), apart, "left_semi"))
    paired = stored(paired.select(*names), "paired", short=True)
    free(members.sparkSession)
    halves = F.transform("hashes", lambda x: F.shiftright(x, 32).cast("int"))
    extra = picked(sets, paired.select("node"), "node").select("node", halves.alias("halves"), (F.size("hashes") - F.size(F.array_distinct(halves))).alias("room"))
    full = paired.join(extra, "node")
    alike = (100 + percent) * (F.size(F.array_intersect("halves", "other_halves")) + F.col("room") + F.col("other_room")) >= percent * (F.col("n") + F.col("other_n"))
    once = ~F.col("other_outside") | (F.col("node") < F.col("other_node"))
    pairs = dealt(full.where("outside")).join(other(full, "halves", "room"), apart & once & alike).select(F.col("node").alias("a"), F.col("other_node").alias("b"))
    return verified(stored(pairs, "last-pairs", short=True), sets, percent)


def _likely(a: str, b: str, percent: int):
    """Whether two signatures agree in as many slots as a link would make them in all but one of sixteen million cases. Slots of different values still agree in their bits one time in 2**BITS."""
    share = percent / 100
    share += (1 - share) / 2**BITS
    least = SLOTS * share - 6 * (SLOTS * share * (1 - share)) ** 0.5
    differing = F.lit(0)
    for k in range(SLOTS * BITS // 64):
        x = F.get(F.col(a), F.lit(k)).bitwiseXOR(F.get(F.col(b), F.lit(k)))
        x = x.bitwiseOR(F.shiftrightunsigned(x, 1))
        x = x.bitwiseOR(F.shiftrightunsigned(x, 2))
        differing = differing + F.bit_count(x.bitwiseAND(F.lit(0x1111111111111111)))
    return F.lit(SLOTS) - differing >= least
