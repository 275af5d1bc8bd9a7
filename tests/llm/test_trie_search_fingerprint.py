"""Prefix trie, max-sketch search and fingerprints against plain Python; their registered queries against SQL."""

import hashlib
import random
import re
from collections import Counter, defaultdict
from math import floor, log

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from collabnet.llm import fingerprint, maxsketch, prefixtrie, queries

SF = "/root/testdata/sf0.001"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


# ---------------------------------------------------------------- trie


def plain_trie(told):
    """Nodes of {id: [(role, text), ...]}."""
    members = defaultdict(list)
    for i, turns in told.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(i)
    children = defaultdict(list)
    for path in members:
        if path:
            children[path[:-1]].append(path)

    def under(path):
        todo, found = [path], []
        while todo:
            found.append(todo.pop())
            todo.extend(children[found[-1]])
        return found

    out = set()
    for path, ids in members.items():
        sub = under(path)
        saved = sum((len(members[p]) - 1) * len(p[-1][1].encode()) for p in sub if p)
        ends = sorted(i for i in ids if len(told[i]) == len(path))
        parent = min(members[path[:-1]]) if path else None
        out.add((len(path), min(ids), parent, len(ids), len(children[path]), sum(not children[p] for p in sub), saved, tuple(ends)))
    return out


def spark_trie(spark, told, rows=None):
    data = [(i, t, *turn) for i, turns in told.items() for t, turn in enumerate(turns)] if rows is None else rows
    turns = spark.createDataFrame(data, "conv_id bigint, turn bigint, role string, text string").withColumn("pos", F.lit("clash"))
    ids = spark.createDataFrame([(i,) for i in told], "id bigint")
    found = prefixtrie.paths(prefixtrie.turn_digests(turns), ids)
    at_end = defaultdict(list)
    for r in found.select("id", prefixtrie.end_name(F.col("path")).alias("end")).collect():
        at_end[bytes(r.end)].append(r.id)
    got = prefixtrie.trie(found).collect()
    assert len(got) == len({(r.depth, r.conv_id) for r in got})
    return {(*tuple(r)[:-1], tuple(sorted(at_end[bytes(r.end)])) if r.end is not None else ()) for r in got}, found


def conversations(rng, n, words="abc"):
    told = {}
    for i in range(n):
        length = rng.choice([0, 1, 2, 3, 5, 9])
        told[i] = [(rng.choice("ua"), rng.choice(words) * rng.randint(0, 2)) for _ in range(length)]
    for i in range(n, 2 * n):  # copies and continuations
        told[i] = told[rng.randrange(n)] + [("u", "é")] * rng.choice([0, 0, 1, 2])
    return told


@pytest.mark.parametrize("block", [2, 5, 20_000])
def test_trie(spark, monkeypatch, block):
    monkeypatch.setattr(prefixtrie, "BLOCK", max(block, 5))
    monkeypatch.setattr(prefixtrie, "SMALL", 1 if block < 100 else 500)
    monkeypatch.setattr(prefixtrie, "LEAST", 2)
    monkeypatch.setattr(prefixtrie, "BLOCK_BYTES", 1 if block == 2 else 1 << 20)  # two entries a block
    told = conversations(random.Random(block), 60)
    assert spark_trie(spark, told)[0] == plain_trie(told)


def test_forest_rounds_without_spark():
    rng = random.Random(3)
    for _ in range(40):
        paths = sorted({bytes(rng.choice(b"ab") for _ in range(rng.randint(0, 6))) for _ in range(rng.randint(1, 25))})
        paths = [b"".join(bytes([c]) * prefixtrie.WIDTH for c in p) for p in paths]
        entries = []
        for i, p in enumerate(paths):
            k = len(p) // prefixtrie.WIDTH
            zero = [0] * (k + 1)
            entries.append({"path": p, "sizes": [3] * k, "low_by": [i] * (k + 1), "n_by": [2] * (k + 1), "children_by": zero, "leaves_by": zero, "saved_by": zero, "ends_by": [None] * k + [b"x"]})
        whole, _ = prefixtrie.forest(entries, True, False)
        made, todo = [], entries
        while len(todo) > 3:
            after = []
            for at in range(0, len(todo), 3):
                nodes, contracted = prefixtrie.forest(todo[at : at + 3], False, todo is not entries)
                made += nodes
                after += contracted
            todo = after
        made += prefixtrie.forest(todo, True, todo is not entries)[0]
        by_key = {n["key"]: n["conv_id"] for n in made if n["key"] is not None}
        show = lambda n: (n["depth"], n["conv_id"], n["parent_conv_id"] if n["above"] is None else by_key[n["above"]], n["n_n"], n["n_children"], n["n_leaves"], n["n_saved"], n["end"])
        assert sorted(map(show, made), key=repr) == sorted(map(show, whole), key=repr)


def test_trie_of_odd_rows(spark):
    rows = [
        (1, None, None, "first"), (1, 3, "a", None), (1, 2, "u", ""), (2, 0, "", "first"), (2, 0, "", "first"),
        (None, 0, "u", "no conversation"), (3, 5, "u", "long " * 50_000), (3, 6, "u", "long " * 50_000), (4, 1, "u", "é\U0001f600"),
    ]
    told = {
        1: [("", "first"), ("u", ""), ("a", "")],
        2: [("", "first"), ("", "first")],
        3: [("u", "long " * 50_000)] * 2,
        4: [("u", "é\U0001f600")],
        5: [],
        6: [("a", f"turn {i}") for i in range(3000)],
    }
    rows += [(6, t, *turn) for t, turn in enumerate(told[6])]
    assert spark_trie(spark, told, rows)[0] == plain_trie(told)
    none = spark.createDataFrame([], "conv_id bigint, turn bigint, role string, text string")
    nothing = prefixtrie.paths(prefixtrie.turn_digests(none), none.select(F.col("conv_id").alias("id")))
    assert prefixtrie.trie(nothing).count() == 0


def test_listed_ids(spark, monkeypatch):
    monkeypatch.setattr(prefixtrie, "BLOCK", 7)
    groups = {b"a": range(0, 200), b"b": [3], b"c": range(1000, 1020)}
    data = [(bytearray(e), i) for e, ids in groups.items() for i in ids]
    random.Random(1).shuffle(data)
    got = prefixtrie.listed_ids(spark.createDataFrame(data, "end binary, id bigint")).collect()
    want = {e: hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest() for e, ids in groups.items()}
    assert {bytes(r.end): r.ids_sha256 for r in got} == want and len(got) == 3


# ---------------------------------------------------------------- search


def plain_terms(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def plain_ranking(docs, items, k):
    docs = [(i, Counter(plain_terms(t))) for i, t in docs if i is not None]
    n, total = sum(bool(c) for _, c in docs), sum(sum(c.values()) for _, c in docs)
    df = Counter(t for _, c in docs for t in c)
    asked = defaultdict(set)
    for i, text in items:
        if i is not None:
            asked[i].update(plain_terms(text))
    out = []
    for item, terms in asked.items():
        scored = []
        for doc, c in docs:
            m = 100 - 50 + (50 * sum(c.values()) * n) // max(total, 1)
            score = sum(floor(1000 * log((2 * n + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 20 * m)) for t in terms if c[t])
            if score > 0:
                scored.append((-score, doc))
        out += [(item, rank, doc, -score) for rank, (score, doc) in enumerate(sorted(scored)[:k], 1)]
    return sorted(out)


@pytest.mark.parametrize("k, block", [(3, 4), (50, 4096)])
def test_search(spark, odd_docs, no_docs, monkeypatch, k, block):
    monkeypatch.setattr(maxsketch, "BLOCK_DOCS", block)
    monkeypatch.setattr(maxsketch, "QUERY_TERMS", 30 if k == 3 else 100_000)
    rng = random.Random(4)
    vocabulary = [f"w{i}" for i in range(60)] + ["É", "Ü", "naïve", "漢字"]
    texts = [(100 + i, " ".join(rng.choice(vocabulary) for _ in range(rng.choice([0, 1, 5, 40, 300])))) for i in range(120)]
    texts += [(400 + i, texts[i][1]) for i in range(40)]  # equal scores
    docs = odd_docs.select("doc_id", "text").union(spark.createDataFrame(texts, "doc_id bigint, text string"))
    asked = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.choice([1, 3, 20])))) for i in range(12)]
    asked += [(50, None), (51, ""), (52, "?!"), (None, "w1"), (53, "W1 w1"), (53, "w2"), (54, "alpha LONG one two"), (55, "unknownterm")]
    items = spark.createDataFrame(asked, "item_id bigint, text string").withColumns({c: F.lit("clash") for c in ("score", "rank", "query", "term")})
    clashing = docs.withColumns({c: F.lit("clash") for c in ("id", "score", "rank", "ids", "n")})
    got = maxsketch.search(clashing, items, k)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted(map(tuple, got.collect())) == plain_ranking([tuple(r) for r in docs.collect()], asked, k)
    assert maxsketch.search(no_docs, items, k).count() == 0
    assert maxsketch.search(docs, items.limit(0), k).count() == 0


def test_bounds_hold_and_prune():
    rng = np.random.RandomState(5)
    vocabulary = rng.randint(0, 2**63, 3000, dtype=np.uint64)
    held = []
    for i in range(300):
        terms = np.sort(rng.choice(vocabulary, rng.choice([0, 1, 20, 400]), replace=False))
        held.append((i, terms, rng.choice([1, 2, 7, 300, 70_000], len(terms))))
    sketches = [maxsketch.sketch(t, c) for _, t, c in held]
    arrays = [
        np.arange(300), np.array([c.sum() for *_, c in held]), np.cumsum([0, *[len(t) for _, t, _ in held]]), np.concatenate([t for _, t, _ in held]),
        np.concatenate([c for *_, c in held]).astype("<u4"), np.array([s.shape[1] for s in sketches]), np.concatenate([s.ravel() for s in sketches]),
    ]
    block = maxsketch.Block(arrays, 300, int(arrays[1].sum()))
    halves = []
    for part in (slice(0, 100), slice(100, 300)):
        starts = arrays[2][part.start : part.stop + 1]
        at = slice(starts[0], starts[-1])
        made = np.concatenate([s.ravel() for s in sketches[part]])
        halves.append([arrays[0][part], arrays[1][part], starts - starts[0], arrays[3][at], arrays[4][at], arrays[5][part], made])
    assert all((a == b).all() for a, b in zip(maxsketch.joined(halves), arrays, strict=True))
    exact_at = 0
    for _ in range(50):
        terms = np.sort(rng.choice(vocabulary, 12, replace=False))
        weights = rng.randint(0, 9000, 12)
        bounds, scores = block.bounds(terms, weights), block.scores(np.arange(300), terms, weights)
        assert (bounds >= scores).all()
        exact_at += (bounds == scores).mean()
        best = maxsketch._Best(5)
        block.search(best, terms, weights)
        order = np.lexsort((np.arange(300), -scores))[:5]
        assert best.scores.tolist() == scores[order][scores[order] > 0].tolist()
    assert exact_at / 50 > 0.8


# ---------------------------------------------------------------- fingerprints


def test_fingerprints(spark, odd_docs, no_docs):
    texts = [(200 + i, "\n".join(f"line {j % 7} of {i % 11}" for j in range(i % 13))) for i in range(60)]
    docs = odd_docs.select("doc_id", "text").union(spark.createDataFrame(texts, "doc_id bigint, text string"))
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("h")).collect()
    rows = sorted(rows, key=lambda r: (r.doc_id is None, -(r.doc_id or 0), r.h))
    want = Counter()
    for r, following in zip(rows, rows[1:] + rows[:1], strict=True):
        changed = fingerprint.edited(r.text, following.text)
        assert changed == r.text[: len(r.text) - len(r.text) // 2] + following.text[: len(r.text) // 2]
        a, b, c = (fingerprint.of_paragraphs(t) for t in (r.text, changed, following.text))
        sha = hashlib.sha256(changed.encode()).hexdigest()
        want[r.doc_id, len(r.text), sha, a.text(), b.text(), fingerprint.likeness(a, b), fingerprint.likeness(a, c)] += 1
    clashing = docs.withColumns({c: F.lit("clash") for c in ("id", "place", "bucket", "guest", "to", "at", "hash", "n_chars", "before", "none")})
    for parts in ("1", "2", "9"):
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        try:
            got = fingerprint.fingerprints(clashing)
            assert got.columns == ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
            assert Counter(map(tuple, got.collect())) == want
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", "2")
    assert fingerprint.fingerprints(no_docs).count() == 0
    one = fingerprint.fingerprints(docs.where("doc_id = 7").limit(1)).first()
    assert one.near_next == 1.0


def test_fingerprint_is_a_sum_over_paragraphs():
    rng = random.Random(6)
    seen = {}
    for _ in range(300):
        parts = ["".join(rng.choice("ab \r\x00é") for _ in range(rng.choice([0, 1, 3, 20, 60]))) for _ in range(rng.randint(1, 6))]
        whole = fingerprint.of_paragraphs("\n".join(parts))
        mixed = rng.sample(parts, len(parts))
        assert whole.same(fingerprint.of_paragraphs("\n".join(mixed)))
        assert whole.same(sum((fingerprint.of_paragraphs(p) for p in parts), fingerprint.ZERO))
        assert (whole - fingerprint.of_paragraphs(parts[0]) + fingerprint.of_paragraphs("new")).same(fingerprint.of_paragraphs("\n".join(["new", *parts[1:]])))
        assert whole.same(fingerprint.Fingerprint.parse(whole.text()))
        assert seen.setdefault(whole.text(), sorted(parts)) == sorted(parts)
    long = "x" * 3_000_000 + "\n" + "y" * 10
    lanes = fingerprint.of_paragraphs(long)
    assert lanes.same(fingerprint.of_paragraphs("y" * 10 + "\n" + "x" * 3_000_000)) and lanes.same(fingerprint.Fingerprint.parse(lanes.text()))


def test_likeness_follows_shared_text():
    rng = random.Random(7)
    words = [f"word{rng.randint(0, 5000)}" for _ in range(400)]
    text = "\n".join(" ".join(words[i : i + 20]) for i in range(0, 400, 20))
    other = " ".join(f"else{rng.randint(0, 5000)}" for _ in range(400))
    of = fingerprint.of_paragraphs
    assert fingerprint.likeness(of(text), of(text)) == 1.0
    half = fingerprint.likeness(of(text), of(fingerprint.edited(text, other)))
    assert 0.35 < half < 0.65 and fingerprint.likeness(of(text), of(other)) < 0.2
    assert fingerprint.likeness(of(text), of("")) < 0.2 and fingerprint.likeness(of(""), of("")) == 1.0


# ---------------------------------------------------------------- registered queries


@pytest.mark.parametrize("name", ["op11_prefix_trie", "op12_max_sketch_search"])
def test_query_equals_its_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "conversations"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    cur = con.execute(queries.SQL[name])
    columns, want = [d[0] for d in cur.description], cur.fetchall()
    df = queries.QUERIES[name](spark, SF)
    assert sorted(df.columns) == sorted(columns)
    assert Counter(map(tuple, df.select(*columns).collect())) == Counter(want) and want


def test_fingerprint_query(spark):
    got = queries.QUERIES["op13_fingerprints"](spark, SF).collect()
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    order = sorted(texts, reverse=True)
    following = dict(zip(order, order[1:] + order[:1], strict=True))
    assert {r.doc_id for r in got} == set(texts) and len(got) == len(texts)
    for r in got:
        changed = fingerprint.edited(texts[r.doc_id], texts[following[r.doc_id]])
        assert r.n_chars == len(texts[r.doc_id])
        assert r.edited_sha256 == hashlib.sha256(changed.encode()).hexdigest()
        assert r.fingerprint == fingerprint.of_paragraphs(texts[r.doc_id]).text()
    by_text = defaultdict(set)
    for r in got:
        by_text[texts[r.doc_id]].add(r.fingerprint)
    assert all(len(x) == 1 for x in by_text.values())
