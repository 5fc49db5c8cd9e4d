"""The pipeline against a brute-force version of each stage, with nulls, repeated rows and empty tables."""

import random
import re
import zlib

import corpus_pipeline
import numpy as np
from test_numbered import edit, make_texts, plain_components, split

from lodeweave.llm import secrets, tokens, toxicity

LIVE = "q9XzR7LkP2vW8sTy"


def tables(spark, folder, seed=21):
    rng = random.Random(seed)
    texts = make_texts(seed, 60)
    plain = [" ".join(f"w{rng.randrange(200)}" for _ in range(60)) for _ in range(90)]
    texts += plain + [t[:90] + " vilewretch vilewretch " + t[90:] for t in plain[::3]]
    texts += [f"{' '.join(f'u{rng.randrange(500)}' for _ in range(30))} token={LIVE} end" for _ in range(2)]
    item = " ".join(f"item{rng.randrange(99)}" for _ in range(20))
    texts += [f"{plain[5][:100]} {item} more"]
    rows = [(i, t, rng.choice(["en", "de", None]), f"s{i % 4}" if i % 9 else None, len(t) if t is not None else None) for i, t in enumerate(texts)]
    rows.append(rows[3])
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    labels = [(i, 1, int("vilewretch" in (t or ""))) for i, t, *_ in rows if i % 7]
    docs.repartition(5).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(0, item), (1, None), (2, "too short")], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return rows, labels, item


def test_pipeline(spark, tmp_path):
    folder = str(tmp_path)
    rows, labels, item = tables(spark, folder)
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    kept, names = docs, docs.columns
    stages = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, kept, folder)
        assert kept.columns == names
        kept = stages[name] = spark.createDataFrame(kept.collect(), docs.schema)

    learned = [(d, t, y) for (d, t, *_), y in ((r, {x[0]: x[2] for x in labels}.get(r[0])) for r in rows) if y is not None and t is not None and zlib.crc32(str(d).encode()) % 3 != 1]
    known = [y for d, _, y in labels if zlib.crc32(str(d).encode()) % 3 != 1]
    model = toxicity.fit(learned, sum(known) / len(known))
    of = model.features()
    first = [r for r in rows if model.score(np.array([of(r[1])]))[0] < 0.7]
    ids = lambda df: sorted(r["doc_id"] for r in df.collect())
    assert ids(stages["toxicity"]) == sorted(r[0] for r in first)
    assert not any("vilewretch" in (r[1] or "") for r in first)

    groups = plain_components([(d, t) for d, t, *_ in first], 80)
    second = {r[0]: r for r in first if groups[r[0]][1] == r[0]}
    assert ids(stages["near_duplicates"]) == sorted(second)

    goal = item.split()
    def holds(text):
        own = [w.lower() for w in split(text)]
        return any(edit(goal, own[a : a + n]) <= 4 for a in range(len(own)) for n in range(16, 25)) if "item" in (text or "") else False

    third = {d: r for d, r in second.items() if not holds(r[1])}
    assert len(third) < len(second) and ids(stages["decontamination"]) == sorted(third)

    masked = {d: (r[1] or "").replace(LIVE, "[SECRET]") for d, r in third.items()}
    got = {r["doc_id"]: r for r in stages["secrets"].collect()}
    assert {d: r["text"] or "" for d, r in got.items()} == masked and sum("[SECRET]" in t for t in masked.values()) == 2
    assert all(r["n_chars"] == (None if r["text"] is None else len(r["text"])) for r in got.values())
    assert secrets.candidates(f"token={LIVE}")

    encode = tokens.Encoder().encode
    packed = corpus_pipeline.run(spark, folder).collect()
    lengths = {}
    for r in packed:
        lengths[r["doc_id"]] = lengths.get(r["doc_id"], 0) + r["length"]
        own = encode(masked[r["doc_id"]]) + b"\0" * 4
        assert zlib.crc32(own[4 * r["start"] : 4 * (r["start"] + r["length"])]) == r["ids_crc32"]
    assert lengths == {d: len(encode(t)) // 4 + 1 for d, t in masked.items()}


def test_near_duplicates_of_odd_ids(spark):
    """Rows without a doc_id stay unless they copy another; one doc_id with two texts keeps only what no other row holds."""
    a, b, c, d = (" ".join(f"{x}{i}" for i in range(30)) for x in "abcd")
    rows = [(1, a, "k"), (2, b, "k"), (2, a, "k"), (None, c, "k"), (None, c, "k"), (None, b, "k"), (None, d, "k"), (None, None, "k"), (3, "", "k"), (3, "", "k")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    got = corpus_pipeline.drop_near_duplicates(spark, docs, "")
    assert got.columns == docs.columns
    expected = [(1, a), (2, b), (None, c), (None, d), (None, None), (3, "")]
    assert sorted(((r["doc_id"], r["text"]) for r in got.collect()), key=repr) == sorted(expected, key=repr)


def test_empty_tables(spark, tmp_path):
    folder = str(tmp_path)
    tables(spark, f"{folder}/full")
    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{folder}/full/{name}.parquet").limit(0).write.parquet(f"{folder}/{name}.parquet")
    assert corpus_pipeline.run(spark, folder).count() == 0
    assert re.fullmatch(r"[\w, ]+", ", ".join(n for n, _ in corpus_pipeline.STAGES))
