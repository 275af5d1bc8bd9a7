"""Operators that compare documents with each other or with a benchmark, and the pipeline, against plain Python."""

import random
import re
from collections import Counter
from math import log

import corpus_pipeline
import numpy as np
import pytest
from pyspark.sql import functions as F

from collabnet.llm import decontaminate, linededup, neardup, topk

SF = "/root/testdata/sf0.001"


def shingles(text, k):
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    found = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(str.maketrans(upper, lower)))
    if len(found) < k:
        return frozenset([tuple(found)] if found else [])
    return frozenset(tuple(found[i : i + k]) for i in range(len(found) - k + 1))


def plain_components(rows, k, percent=80):
    """(id, shingles, component, kept) by comparing all distinct sets."""
    sets = [(i, shingles(text, k)) for i, text in rows]
    classes = sorted({s for i, s in sets if s and i is not None}, key=sorted)
    root = list(range(len(classes)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(classes)):
        for b in range(a):
            if 100 * len(classes[a] & classes[b]) >= percent * len(classes[a] | classes[b]):
                root[find(a)] = find(b)
    place = {c: i for i, c in enumerate(classes)}
    low = {}
    for i, s in sets:
        if s and i is not None:
            r = find(place[s])
            low[r] = min(i, low.get(r, i))
    named = [(i, len(s), low[find(place[s])] if s and i is not None else i) for i, s in sets]
    return [(*x, x[0] == x[2]) for x in named]


def near_rows():
    """Chains of texts that each change a little more, exact copies, and texts alone."""
    rng = random.Random(5)
    rows = []
    for group in range(12):
        words = [f"g{group}w{rng.randint(0, 400)}" for _ in range(rng.choice([6, 40, 120]))]
        for _ in range(12):
            rows.append(" ".join(words))
            if rng.random() < 0.3:
                rows.append("  ".join(words).upper())
            for _ in range(rng.choice([0, 1, 1, 2])):
                words[rng.randrange(len(words))] = f"new{rng.randint(0, 9999)}"
    rng.shuffle(rows)
    return list(enumerate(rows, 1000))


@pytest.mark.parametrize("k", [4, 5])
def test_components(spark, odd_docs, no_docs, k):
    docs = odd_docs.select("doc_id", "text").union(spark.createDataFrame(near_rows(), "doc_id bigint, text string"))
    want = Counter(plain_components([tuple(r) for r in docs.collect()], k))
    got = neardup.components(docs.withColumns({c: F.lit("c") for c in ("class", "key", "id", "version", "sig")}), k=k)
    assert got.columns == ["doc_id", "n_shingles", "component_id", "kept"]
    assert Counter(map(tuple, got.collect())) == want
    assert neardup.components(no_docs, k=k).count() == 0


def test_one_row_of_each_group_stays(spark, odd_docs):
    rows = odd_docs.select("doc_id", "text").collect()
    judged = plain_components([tuple(r) for r in rows], neardup.WORDS)
    want = {(r.doc_id, r.text) for r, j in zip(rows, judged, strict=True) if j[3] and r.doc_id is not None}
    got = neardup.deduplicate(odd_docs)
    assert got.columns == odd_docs.columns
    kept = Counter((r.doc_id, r.text) for r in got.select("doc_id", "text").collect())
    assert {x: n for x, n in kept.items() if x[0] is not None} == dict.fromkeys(want, 1)
    assert sum(n for x, n in kept.items() if x[0] is None) == sum(r.doc_id is None for r in rows)


def test_similar_pairs_are_not_given_up():
    table = neardup.least_matches(80, neardup.MISS)
    rng = np.random.RandomState(1)
    met = rng.rand(20000, neardup.HASHES) < 0.8
    for n in range(neardup.BATCH, neardup.HASHES + 1, neardup.BATCH):
        assert (met[:, :n].sum(axis=1) >= table[n]).all()
    assert table[neardup.HASHES] > 0.5 * neardup.HASHES  # far pairs are


def plain_search(docs, queries, k):
    words = lambda text: Counter(re.findall(r"[^\W_]+", (text or "").lower()))
    held = [(i, words(t)) for i, t in docs if i is not None]
    n, df = len(held), Counter(w for _, f in held for w in f)
    mean = sum(sum(f.values()) for _, f in held) / max(n, 1)
    asked = {}
    for q, text in queries:
        if q is not None:
            asked.setdefault(q, set()).update(words(text))
    out = {}
    for q, terms in asked.items():
        scored = []
        for i, f in held:
            long = topk.K1 * (1 - topk.B + topk.B * sum(f.values()) / mean)
            score = sum(log(1 + (n - df[w] + 0.5) / (df[w] + 0.5)) * f[w] * (topk.K1 + 1) / (f[w] + long) for w in terms if w in f)
            if score > 0:
                scored.append((-score, i))
        out[q] = [(i, -s) for s, i in sorted(scored)[:k]]
    return out


def same_ranking(got, want):
    found = {}
    for r in sorted(got, key=lambda r: (r.query_id, r.rank)):
        found.setdefault(r.query_id, []).append((r.doc_id, r.score))
    assert set(found) == {q for q, rows in want.items() if rows}
    for q, rows in found.items():
        assert [s for _, s in rows] == pytest.approx([s for _, s in want[q]], abs=2e-6)
        last = rows[-1][1]
        clear = lambda x: Counter(i for i, s in x if s > last + 1e-5)
        assert clear(rows) == clear(want[q])


@pytest.mark.parametrize("shards", [1, 4])
def test_search(spark, shards):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").repartition(shards)
    asked = docs.where("doc_id % 50 = 0").select(F.col("doc_id").alias("query_id"), "text")
    short = asked.select(-F.col("query_id"), F.slice(F.split("text", " "), 3, 4)).toDF("query_id", "words")
    asked = asked.union(short.select("query_id", F.array_join("words", " ")))
    want = plain_search([tuple(r) for r in docs.collect()], [tuple(r) for r in asked.collect()], 10)
    same_ranking(topk.search(docs, asked).collect(), want)


def test_search_of_odd_rows(spark, odd_docs, no_docs):
    docs = odd_docs.select("doc_id", "text")
    asked = odd_docs.withColumnRenamed("doc_id", "query_id")
    want = plain_search([tuple(r) for r in docs.collect()], [tuple(r) for r in asked.select("query_id", "text").collect()], 10)
    got = topk.search(odd_docs, asked)
    assert got.columns == ["query_id", "doc_id", "score", "rank"]
    same_ranking(got.collect(), want)
    assert topk.search(no_docs, asked).count() == 0
    assert topk.search(odd_docs, asked.limit(0)).count() == 0


def test_search_numbers_similar_documents_together(spark):
    """Blocks of like documents are what their maxima can leave out; the answers stay those of brute force."""
    words = [[f"{tongue}{i}" for i in range(60)] for tongue in ("a", "b")]
    rows = [(i, " ".join(words[i % 2][(i * 7 + j * j) % 60] for j in range(5 + i % 11))) for i in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    (shard,) = topk.build(docs, "doc_id", "text").collect()
    order = np.frombuffer(shard.shard_docs, "<i8")
    assert sorted(order) == list(range(600))
    assert np.count_nonzero(np.diff(order % 2)) < topk.GROUPS
    asked = docs.where("doc_id % 50 < 2").withColumnRenamed("doc_id", "query_id")
    want = plain_search(rows, [tuple(r) for r in asked.select("query_id", "text").collect()], 10)
    same_ranking(topk.search(docs, asked).collect(), want)


def folded(text):
    return re.sub(r"[\W_]+", " ", (text or "").lower()).strip()


def least_edits(pattern, text):
    """Edits between a pattern and the part of a text nearest to it."""
    codes, steps = np.array([ord(c) for c in text], np.int64), np.arange(len(text) + 1)
    cost = np.zeros(len(text) + 1, np.int64)
    for c in pattern:
        cost = np.append(cost[0] + 1, np.minimum(cost[1:] + 1, cost[:-1] + (codes != ord(c))))
        cost = np.minimum.accumulate(cost - steps) + steps
    return int(cost.min())


def plain_leak(text, item):
    text, item = folded(text), folded(item)
    if len(item) < decontaminate.SHORTEST:
        return False
    n = min(decontaminate.WINDOW, len(item))
    starts = {*range(0, len(item) - n + 1, decontaminate.STEP), len(item) - n}
    return any(least_edits(item[s : s + n], text) <= decontaminate.budget(n) for s in starts)


def leak_rows():
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abcdefgé漢") for _ in range(rng.randint(2, 7)))
    prose = lambda n: " ".join(word() for _ in range(n))
    items = [(i, prose(rng.choice([5, 12, 40]))) for i in range(6)] + [(6, None), (7, ""), (8, "too short"), (9, "ab " * 40)]
    docs = [prose(60) for _ in range(6)] + [None, "", "ab " * 200]
    for _, item in items[:6]:
        for edits in (0, 2, 5, 7, 8, 14):
            changed = list(item[: rng.choice([96, 130, 500])])
            for _ in range(edits):
                at = rng.randrange(len(changed))
                changed[at : at + 1] = rng.choice([[], [rng.choice("xyz")], [changed[at], "q"]])
            docs.append(f"{prose(rng.randint(0, 20))}, {''.join(changed).upper()}! {prose(rng.randint(0, 20))}")
    return list(enumerate(docs)), items


def test_leaks(spark, odd_docs, no_docs):
    rows, items = leak_rows()
    docs = spark.createDataFrame([*rows, rows[-1], (None, rows[-2][1])], "doc_id bigint, text string").withColumn("m", F.lit(1))
    bench = spark.createDataFrame([*items, items[0]], "item_id bigint, text string").withColumn("doc_id", F.lit(1))
    held = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    want = Counter((d, i) for d, text in held for i, item in items if plain_leak(text, item))
    got = decontaminate.leaks(docs, bench)
    assert Counter((r.doc_id, r.item_id) for r in got.collect()) == want
    clean = decontaminate.without_leaks(docs, bench)
    assert clean.columns == docs.columns
    wanted = Counter((d, t) for d, t in held if not any(plain_leak(t, item) for _, item in items))
    assert Counter((r.doc_id, r.text) for r in clean.collect()) == wanted
    assert decontaminate.without_leaks(odd_docs, bench.limit(0)).count() == odd_docs.count()
    assert decontaminate.leaks(no_docs, bench).count() == decontaminate.leaks(odd_docs, bench.limit(0)).count() == 0


def test_short_passages_and_short_items_are_found():
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(3, 7)))
    prose = lambda n: " ".join(word() for _ in range(n))
    items = [prose(60) for _ in range(20)] + ["what is 2 plus 2", "name a colour"]
    known = decontaminate.index(list(enumerate(items)))
    for i, item in enumerate(items):
        words = item.split()
        for at in range(0, max(1, len(words) - 16), 5):
            passage = " ".join(words[at : at + 16])  # 13 words or more of 64 characters or more
            assert len(words) < 16 or len(passage) >= 64
            found = decontaminate.matches(f"{prose(30)} {passage}, {prose(30)}", known)
            assert [m[0] for m in found] == [i], passage
        if len(words) > 16:
            cut = f"{prose(30)} {item[100:164]} {prose(30)}"
            assert [m[0] for m in decontaminate.matches(cut, known)] == [i]
    assert not decontaminate.matches(prose(500), known)


def test_alignment_finds_the_least_edits():
    rng = random.Random(7)
    for _ in range(60):
        pattern = [rng.choice("abc") for _ in range(rng.randint(1, 20))]
        text = [rng.choice("abc") for _ in range(rng.randint(1, 25))]
        codes = lambda x: np.array([ord(c) for c in x], np.uint32)
        edits, start, stop = decontaminate.align(codes(pattern), codes(text), -len(pattern), len(text))
        assert decontaminate.least_edits(codes(pattern), codes(text)) == edits
        assert edits == least_edits("".join(pattern), "".join(text))


def test_stages_of_the_pipeline(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names = [name for name, _ in corpus_pipeline.STAGES]
    assert names == ["quality", "line_dedup", "near_dedup", "decontamination", "packing"]
    bench = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    held = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = docs
        stage(spark, docs, SF).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        assert docs.columns == before.columns
        old, new = ({r.doc_id: r.text for r in d.collect()} for d in (before, docs))
        assert set(new) <= set(old) and len(new) == docs.count()
        held[name] = old, new
    old, new = held["quality"]
    label = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    assert sum(i in new for i in old if label.get(i) == 1) >= 0.9 * sum(label.get(i) == 1 for i in old)
    old, new = held["line_dedup"]
    found = Counter()
    lines = lambda t: [x.strip(" \t\n\x0b\x0c\r").lower() for x in (t or "").split("\n")]
    for text in new.values():
        found.update({x for x in lines(text) if len(x) >= linededup.MIN_LENGTH})
    repeated = Counter(x for t in old.values() for x in set(lines(t)) if len(x) >= linededup.MIN_LENGTH)
    assert set(old) == set(new) and all(found[x] == 1 for x, n in repeated.items() if n >= linededup.MIN_DOCUMENTS)
    old, new = held["near_dedup"]
    judged = plain_components(list(old.items()), neardup.WORDS)
    assert set(new) == {j[0] for j in judged if j[3]}
    old, new = held["decontamination"]
    # brute force over all whole texts is too slow here (test_leaks has it on short ones): what holds a window as it is
    # has to go, and what goes has to hold one within the edits
    windows = {x[s : s + decontaminate.WINDOW] for x in map(folded, bench) for s in range(0, len(x) - decontaminate.WINDOW + 1, decontaminate.STEP)}
    exact = {i for i, t in old.items() if any(w in folded(t) for w in windows)}
    gone = set(old) - set(new)
    assert exact and exact <= gone and all(any(plain_leak(old[i], x) for x in bench) for i in gone - exact)
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert {r.doc_id for r in packed.select("doc_id").collect()} == set(new)


def test_the_pipeline_runs_all_stages(spark):
    packed = corpus_pipeline.run(spark, SF)
    assert packed.count() > 0 and packed.agg(F.max(F.col("offset") + F.col("length"))).first()[0] <= 2048
