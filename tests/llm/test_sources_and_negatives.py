"""Source divergence, mixing and hard negatives against plain versions."""

from __future__ import annotations

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from citelake.llm import divergence, hard_negatives, mixing

UPPER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def rows_of(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)


# ---- divergence


def plain_audit(rows, least, top):
    docs = [((d[2] or ""), (d[3] or ""), re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (d[1] or "").translate(UPPER))) for d in rows]
    df = defaultdict(Counter)
    for lang, _, terms in docs:
        df[lang].update(set(terms))
    out = []
    for lang in {d[0] for d in docs}:
        kept = {t for t, n in df[lang].items() if n >= least}
        counts = defaultdict(Counter)
        for x, source, terms in docs:
            if x == lang:
                counts[source].update(t for t in terms if t in kept)
                counts[source] += Counter()
        every = sum(counts.values(), Counter())

        def share(c, t, kept=kept):
            return 1 + 10**9 * (c[t] + 5) // (sum(c.values()) + 5 * len(kept))

        for source, c in counts.items():
            pairs = [(sum(abs(share(c, t) - share(o, t)) for t in kept), other) for other, o in counts.items() if other != source]
            terms = [(share(c, t) - share(every, t), t) for t in kept if c[t] and share(c, t) > share(every, t)]
            for part, found, most in (("pair", pairs, None), ("term", terms, top)):
                ranked = sorted(found, key=lambda v: (-v[0], v[1].encode()))[:most]
                out += [(lang, source, part, item, value, k + 1) for k, (value, item) in enumerate(ranked)]
    return sorted(out, key=repr)


AUDIT = "lang", "source", "part", "item", "value", "rank"


def test_audit_is_that_of_plain_counts(docs, corpus):
    assert rows_of(divergence.audit(docs, least=5, top=7), *AUDIT) == plain_audit(corpus, 5, 7)


def test_distances_add_up_over_blocks_whichever_source_comes_first(spark, monkeypatch):
    plain, last = divergence._distances, divergence._SLOT_BLOCK

    def turned(table):
        # the second block gets its rows in reverse, as another order of its shuffle would
        return plain(table.take(list(range(len(table)))[::-1]) if table.column("block")[0].as_py() else table)

    monkeypatch.setattr(divergence, "_distances", turned)
    counts = spark.createDataFrame([("xx", "s1", 0, 5), ("xx", "s2", last, 7)], "lang string, source string, slot long, p long")
    groups = spark.createDataFrame([("xx", s, last + 1, 2, 1) for s in ("s1", "s2")], "lang string, source string, terms long, total long, zero long")
    found = divergence._pairs(counts.coalesce(1), groups.coalesce(1)).collect()
    assert sorted(map(tuple, found)) == [("xx", "s1", "s2", 10), ("xx", "s2", "s1", 10)]


def test_audit_in_rounds_and_small_blocks(docs, corpus, monkeypatch):
    monkeypatch.setattr(divergence, "_SHARD_TERMS", 40)
    monkeypatch.setattr(divergence, "_SLOT_BLOCK", 7)
    monkeypatch.setattr(divergence, "_SOURCE_BLOCK", 2)
    assert rows_of(divergence.audit(docs, least=3, round_bytes=600), *AUDIT) == plain_audit(corpus, 3, 50)


def test_audit_of_languages_without_kept_terms(spark, none):
    rows = [(1, "a b", "xx", "s1", 0), (2, None, "xx", "s2", 0), (3, "", "xx", "s2", 0), (4, "alone", None, None, 0)]
    docs = spark.createDataFrame(rows, none.schema)
    assert rows_of(divergence.audit(docs), *AUDIT) == [("xx", "s1", "pair", "s2", 0, 1), ("xx", "s2", "pair", "s1", 0, 1)]
    assert divergence.audit(none).count() == 0


def test_audit_reads_no_other_columns(docs, corpus):
    more = docs.withColumns({c: F.lit("x") for c in ("n", "slot", "p", "q", "rank", "term", "block", "side")})
    assert rows_of(divergence.audit(more, least=5, top=7), *AUDIT) == plain_audit(corpus, 5, 7)


def test_perfect_hash_gives_every_term_its_own_slot():
    terms = pa.array([f"term{k}" for k in range(3000)] + ["é", "日本"])
    hashes = divergence.term_hashes(terms)
    table = divergence.PerfectHash(*divergence.PerfectHash.build(terms, hashes))
    slots = table.slots(terms, hashes)
    assert sorted(slots.tolist()) == list(range(len(terms)))
    others = pa.array([f"other{k}" for k in range(3000)])
    assert (table.slots(others, divergence.term_hashes(others)) == -1).all()
    # strings whose hashes are those of terms: the stored key tells them apart
    assert (table.slots(others, hashes[:3000]) == -1).all()


def test_perfect_hash_of_terms_with_equal_hashes():
    terms, hashes = pa.array(["a", "b", "c", "d"]), np.array([1, 1, 1, 2], np.uint64)
    table = divergence.PerfectHash(*divergence.PerfectHash.build(terms, hashes))
    assert sorted(table.slots(terms, hashes).tolist()) == [0, 1, 2, 3]
    assert table.slots(pa.array(["e"]), np.array([1], np.uint64)).tolist() == [-1]


def test_term_hashes_are_those_of_spark(spark):
    words = ["", "a", "été", "日本語", "x" * 100]
    got = [r[0] for r in spark.createDataFrame([(w,) for w in words], "w string").select(F.xxhash64("w")).collect()]
    assert divergence.term_hashes(pa.array(words)).view(np.int64).tolist() == got


# ---- mixing


def plain_targets(sizes, weights=(5, 2, 1)):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[k % 3] for k, s in enumerate(order)}
    total, target, open_ = 1.5 * sum(sizes.values()), {}, set(order)
    while open_:
        left = total - sum(target.values())
        share = {s: left * weight[s] / sum(weight[t] for t in open_) for s in open_}
        over = {s for s in open_ if share[s] > 2 * sizes[s]}
        if not over:
            target |= share
            break
        target |= {s: 2 * sizes[s] for s in over}
        open_ -= over
    return target


def check_mix(out, rows):
    size = {}
    for d in rows:
        size.setdefault(d[3], 0)
        size[d[3]] += len(re.findall(r"[^\x20\x09-\x0D]+", d[1] or ""))
    target = plain_targets(size)
    got = Counter((r["doc_id"], r["size"]) for r in out)
    assert got == Counter((d[0], len(re.findall(r"[^\x20\x09-\x0D]+", d[1] or ""))) for d in rows)
    by_source = defaultdict(list)
    for r in out:
        assert r["taken"] in (0, r["size"], 2 * r["size"])
        by_source[r["source_size"]].append(r)
    for source, n in size.items():
        same = [s for s in size if size[s] == n]
        mine = by_source[n]
        assert any(abs(mine[0]["target"] - target[s]) < 1e-6 for s in same), source
        if len(same) == 1:
            assert abs(sum(r["taken"] for r in mine) - target[source]) <= max(r["size"] for r in mine)
    assert abs(sum(r["taken"] for r in out) - sum(target.values())) <= max(r["size"] for r in out)


@pytest.mark.parametrize("fan", [4096, 3])
def test_mix_meets_the_targets(docs, corpus, fan):
    check_mix(mixing.mix_sources(docs, fan=fan).collect(), corpus)


def test_mix_reruns_agree(docs):
    columns = "doc_id", "size", "source_size", "target", "taken"
    first = rows_of(mixing.mix_sources(docs, fan=5), *columns)
    assert rows_of(mixing.mix_sources(docs.repartition(7, "n_chars"), fan=5), *columns) == first


def test_mix_of_many_equal_rows(spark, none):
    rows = [(1, "a b c", "en", "s", 0)] * 2000 + [(k, "a " * (k % 50), "en", f"s{k % 3}", 0) for k in range(2, 400)]
    docs = spark.createDataFrame(rows, none.schema)
    check_mix(mixing.mix_sources(docs, fan=100).collect(), rows)


def test_mix_of_nothing(spark, none):
    assert mixing.mix_sources(none).count() == 0
    blank = spark.createDataFrame([(1, None, None, None, None), (2, " ", None, "a", 0)], none.schema)
    assert rows_of(mixing.mix_sources(blank), "doc_id", "size", "target", "taken") == [(1, 0, 0.0, 0), (2, 0, 0.0, 0)]


def test_mix_reads_no_other_columns(docs):
    more = docs.withColumns({c: F.lit("x") for c in ("id", "size", "target", "copies", "n", "part", "docs", "weight", "mark")})
    columns = "doc_id", "size", "source_size", "target", "taken"
    assert rows_of(mixing.mix_sources(more), *columns) == rows_of(mixing.mix_sources(docs), *columns)


def test_settling_keeps_words_and_expectations():
    sizes, start = np.array([90.0, 40, 12, 7, 3]), np.array([0.3, 0.5, 0.25, 0.9, 0.6])
    rng, total = np.random.default_rng(3), np.zeros(5)
    for _ in range(4000):
        parts = start.copy()
        held = mixing.settle(sizes, parts, rng.random(5))
        assert abs((sizes * parts).sum() - (sizes * start).sum()) < 1e-6
        assert all(p in (0, 1) for k, p in enumerate(parts) if k != held)
        total += parts
    assert np.abs(total / 4000 - start).max() < 0.03


# ---- hard negatives


def plain_negatives(rows, anchors, positives=5, k=5, low=80):
    good = []
    for vec_id, vector, label in rows:
        if vec_id is None or label is None or vector is None or any(x is None or not np.isfinite(x) for x in vector):
            continue
        good.append((vec_id, label, [int(np.floor(256 * float(np.float32(x)))) for x in vector]))

    def score(a, b):
        return sum(x * y for x, y in zip(a, b))

    out = []
    for own, label, v in {(i, x, tuple(v)) for i, x, v in good if anchors(i)}:
        others = sorted((-score(v, w), i, x) for i, x, w in good if i != own)
        for s, i in [(-s, i) for s, i, x in others if x == label][:positives]:
            fits = [(-t, j) for t, j, x in others if x != label and low * s <= -100 * t <= 100 * s][:k]
            out += [(own, i, n + 1, j, s, t) for n, (t, j) in enumerate(fits)]
    return sorted(out, key=repr)


SCHEMA = "vec_id long, embedding array<float>, label int"
MINED = "anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"


def vectors(n=400, width=8, seed=5):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(3, width))
    rows = []
    for k in range(n):
        v = rng.normal(size=width) if k % 3 else centres[k % 9 // 3] + 0.05 * rng.normal(size=width)
        rows.append((k, [float(np.float32(x)) for x in v / np.linalg.norm(v) * (1 + k % 4)], k % 4))
    same = rows[33][1]
    rows += [(k, same, k % 3) for k in range(500, 560)]
    rows += [(600, None, 1), (601, [1.0, None], 1), (602, [float("nan")] * width, 1), (603, [float("inf")] * width, 1), (604, same, None), (None, same, 1)]
    rows += [(700, [0.0] * width, 1), (701, [0.5], 2), (702, [0.1] * (width + 3), 2), (20, rows[20][1], 0), (20, rows[20][1], 0), (800, [], 3)]
    return rows


@pytest.mark.parametrize("block", [1 << 20, 300])
def test_negatives_are_those_of_all_pairs(spark, monkeypatch, block):
    monkeypatch.setattr(hard_negatives, "_COMPONENTS", block)
    monkeypatch.setattr(hard_negatives, "_LEAST_BLOCK", 16)
    rows = vectors()
    found = hard_negatives.mine(spark.createDataFrame(rows, SCHEMA), F.col("vec_id") % 20 == 0)
    assert rows_of(found, *MINED) == plain_negatives(rows, lambda i: i % 20 == 0)


def test_negatives_of_huge_vectors(spark):
    rows = [(k, [float((k * 7919 + j * 104729) % 1000 - 500) * 4000.0 for j in range(4)], k % 2) for k in range(60)]
    found = hard_negatives.mine(spark.createDataFrame(rows, SCHEMA), F.col("vec_id") % 10 == 0)
    assert rows_of(found, *MINED) == plain_negatives(rows, lambda i: i % 10 == 0)


def test_negatives_of_nothing(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert hard_negatives.mine(none, F.col("vec_id") % 20 == 0).count() == 0
    alone = spark.createDataFrame([(0, [1.0, 0.0], 1)], SCHEMA)
    assert hard_negatives.mine(alone, F.col("vec_id") % 20 == 0).count() == 0


def test_negatives_with_clashing_columns(spark):
    rows = vectors(120)
    more = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit(1) for c in ("id", "v", "q", "score", "rank", "norm", "angles", "b")})
    assert rows_of(hard_negatives.mine(more, F.col("vec_id") % 20 == 0), *MINED) == plain_negatives(rows, lambda i: i % 20 == 0)


def test_bounds_hold_and_cut():
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(4, 16))
    v = np.floor(256 * (centres[rng.integers(0, 4, 600)] + 0.1 * rng.normal(size=(600, 16)))).astype(np.int64)
    labels, ids = rng.integers(0, 3, 600), np.arange(600)
    norms, angles = hard_negatives.angles_to(v, hard_negatives.reference_directions(v[:200]))
    index = hard_negatives.AngleIndex(ids, labels, v, norms, angles)
    a = hard_negatives.Anchors(ids[:50], labels[:50], v[:50], norms[:50], angles[:50], np.full(50, 1_000_000), np.full(50, 1_200_000))
    down, up = index.group_bounds(a)
    exact = a.vectors @ index.vectors.T
    for g, (i, j) in enumerate(zip(index.starts, index.ends)):
        assert (exact[:, i:j] >= down[:, g, None]).all() and (exact[:, i:j] <= up[:, g, None]).all()
    found = index.scores(a, False)
    inside = (exact >= 1_000_000) & (exact <= 1_200_000) & (a.labels[:, None] != index.labels) & (a.ids[:, None] != index.ids)
    assert (found[inside] == exact[inside]).all()
    assert index.work[1] < index.work[0] / 2 and index.work[2] <= index.work[1]
