from __future__ import annotations

import random
import re
from collections import Counter, defaultdict
from itertools import combinations
from pathlib import Path

import duckdb
import pytest
from conftest import prose
from test_operators import lower, quality_by_hand, spans_by_hand, ws

import corpus_pipeline
from citelake.llm import jaccard_join, queries, secret_scan
from citelake.llm.sql import SQL

SF = "/root/testdata/sf0.001"


def test_stages_in_order_keep_what_they_should(spark, docs):
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality_rules", "near_duplicates", "secrets", "packing"]
    kept = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = {r["doc_id"] for r in kept.select("doc_id").collect()}
        kept = stage(spark, kept, "")
        assert kept.columns == corpus_pipeline.COLUMNS and dict(kept.dtypes) == dict(docs.dtypes)
        after = {r["doc_id"] for r in kept.select("doc_id").collect()}
        assert after <= before
        assert name != "secrets" or after == before
    ids = {r["doc_id"] for r in kept.collect()}
    assert 400 in ids and {k for k in range(100, 160)} & ids and 0 not in ids
    assert len({200, 205, 210, 215} & ids) == 1  # exact copies
    assert jaccard_join.join(kept).where("component_id <> doc_id").count() == 0
    assert all(not r["spans"] for r in secret_scan.scan(kept).collect())
    packed = corpus_pipeline.STAGES[-1][1](spark, kept, "")
    assert {r["doc_id"] for r in packed.collect()} == ids


def test_near_duplicates_by_five_words(spark):
    """52 words, one changed: 43 of 53 shingles of five words, 47 of 53 of three."""
    words = [f"w{k}" for k in range(52)]
    near = [*words[:25], "other", *words[26:]]
    far = [*words[:17], "other", *words[18:34], "another", *words[35:]]
    rows = [(k, " ".join(w), "en", "s", 0) for k, w in enumerate((words, near, far))]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    assert jaccard_join.keep_one(df).count() == 3
    assert sorted(r["doc_id"] for r in corpus_pipeline.near_duplicates(spark, df, "").collect()) == [0, 2]


def lines_by_hand(rows, min_docs=20):
    """Texts without frequent lines, of documents that keep a fifth of their words."""
    def normal(line):
        return re.sub("[0-9]", "0", lower(" ".join(ws(line))))

    texts, first = defaultdict(set), {}
    for i, t, _, host, _ in rows:
        for line in filter(ws, (t or "").split("\n")):
            key = host or "", normal(line)
            texts[key].add(t)
            first[key] = min(first.get(key, i), i)
    out = []
    for i, t, lang, host, _ in rows:
        words = ws(t)
        often = [len(texts[host or "", normal(x)]) > min_docs and first[host or "", normal(x)] != i if ws(x) else False for x in (t or "").split("\n")]
        gone = sum(len(ws(x)) for x, o in zip((t or "").split("\n"), often) if o)
        repeats = quality_by_hand(t)[4]
        if words and 100 * repeats <= 50 * len(words) and len(words) - gone >= 0.2 * len(words):
            kept = "\n".join(x for x, o in zip((t or "").split("\n"), often) if not o)
            out.append((i, kept, lang, host, len(kept)))
    return out


def one_of_each_by_hand(rows, width=5, num=80, den=100):
    def shingles(t):
        w = ws(lower(t))
        return frozenset(tuple(w[k : k + width]) for k in range(max(1, len(w) - width + 1))) if w else frozenset()

    sets, root = [shingles(r[1]) for r in rows], list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in combinations(range(len(rows)), 2):
        both = len(sets[a] & sets[b])
        if both and den * both >= num * (len(sets[a]) + len(sets[b]) - both):
            root[find(a)] = find(b)
    best = {}
    for k, row in enumerate(rows):
        best[find(k)] = min(best.get(find(k), row), row)
    return sorted(best.values())


def redacted_by_hand(t):
    out, at = "", 0
    for s, e, _ in spans_by_hand(t, secret_scan.RULES):
        if s >= at:
            out += t[at:s] + "[SECRET]"
        at = max(at, e)
    return out + t[at:]


def test_all_stages_against_a_plain_version(spark):
    """Distinct ids, boilerplate, copies with and without it, secrets, short and long texts."""
    from tokenizers import Tokenizer

    rng = random.Random(21)
    boiler = prose(rng, 12).replace("\n", " ")
    rows = []
    for i in range(60):
        t = prose(rng, rng.randint(3, 250))
        rows.append((i, t + (f"\n{boiler}" if i % 2 else ""), "en", "src0" if i < 50 else None, 0))
    for i in range(60, 90):
        words = rows[rng.randrange(20)][1].split(" ")
        for _ in range(rng.randint(0, 8)):
            words[rng.randrange(len(words))] = "changed"
        rows.append((i, " ".join(words), "en", "src1", 0))
    rows += [(90, boiler, "en", "src0", 0), (91, "password = hunter2hunter2 " + prose(rng, 60), "en", "src2", 0), (92, None, "en", "src0", 0)]
    rows += [(93, "again and " * 60, "en", "src2", 0), (94, prose(rng, 3000), "en", "src2", 0), (95, rows[94 - 3][1], "en", "src9", 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    kept = corpus_pipeline.quality(spark, df, "")
    want = lines_by_hand(rows)
    assert sorted(map(tuple, kept.collect())) == sorted(want)
    kept = corpus_pipeline.near_duplicates(spark, kept, "")
    before, want = want, one_of_each_by_hand(want)
    assert sorted(map(tuple, kept.collect())) == want and len(want) < len(before)
    kept = corpus_pipeline.secrets(spark, kept, "")
    want = [(i, r := redacted_by_hand(t), lang, host, len(r)) for i, t, lang, host, _ in want]
    assert sorted(map(tuple, kept.collect())) == want and any("[SECRET]" in t for _, t, *_ in want)
    library = Tokenizer.from_file(corpus_pipeline.TOKENIZER)
    pieces = Counter()
    for i, t, *_ in want:
        n = len(library.encode(t, add_special_tokens=False).ids) + 1
        pieces.update((i, k // 2048, k, min(2048, n - k)) for k in range(0, n, 2048))
    packed = corpus_pipeline.pack(spark, kept, "").collect()
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"]) for r in packed) == pieces
    places = defaultdict(list)
    for r in packed:
        places[r["sequence_id"]].append((r["offset"], r["length"]))
    for cells in places.values():
        cells.sort()
        assert cells[0][0] == 0 and all(o + n == p for (o, n), (p, _) in zip(cells, cells[1:])) and sum(n for _, n in cells) <= 2048


@pytest.mark.skipif(not Path(SF).exists(), reason="test tables are not here")
def test_pipeline_runs_on_the_tables(spark):
    out = corpus_pipeline.run(spark, SF)
    assert out.count() > 0 and "sequence_id" in out.columns


@pytest.mark.skipif(not Path(SF).exists(), reason="test tables are not here")
@pytest.mark.parametrize("name", sorted(SQL))
def test_query_says_what_its_sql_says(spark, name):
    con = duckdb.connect()
    for path in Path(SF).glob("*.parquet"):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    df = queries.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    cursor = con.execute(SQL[name])
    at = [[c[0] for c in cursor.description].index(c) for c in columns]
    want = sorted(repr(tuple(r[i] for i in at)) for r in cursor.fetchall())
    assert sorted(repr(tuple(r)) for r in df.select(columns).collect()) == want
