"""Operators that judge every row by itself or count over rows, against plain Python."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from collabnet.llm import langid, linededup, packing, pii, quality, tokencount, urlfilter, words

BYTES, WORDS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")


def plain_ids(path, texts):
    return [e.ids for e in Tokenizer.from_file(path).encode_batch([t or "" for t in texts], add_special_tokens=False)]


@pytest.mark.parametrize("path", [BYTES, WORDS])
def test_chunks_give_the_tokenizer_s_ids(path):
    rng = random.Random(1)
    parts = "a|b|É|é|e|\u0301| |  |\n|\t|\r|\x1c|\x85|\xa0|\u2003|1|23|'s|'|!|.|<|endoftext|>|<|Σ|ß|İ|漢|😀|한|ㅎ|ᅡ|ﬁ|Word|word,|wörd$$$|a***".split("|")
    parts += ["<|endoftext|>", "<|startoftext|>", "<|ENDOFTEXT|>"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 30))) for _ in range(3000)]
    want = plain_ids(path, texts)
    assert list(words.count_ids(path, texts)) == [len(x) for x in want]
    assert [np.frombuffer(words.packed_ids(path, t), "<u4").tolist() for t in texts] == want



def test_token_counts_and_their_cache(spark, odd_docs, no_docs, tmp_path):
    cache = str(tmp_path / "cache")
    rows = odd_docs.select("doc_id", "text").collect()
    want = Counter(
        (r.doc_id, len((r.text or "").encode()), len(ids)) for r, ids in zip(rows, plain_ids(BYTES, [r.text for r in rows]), strict=True)
    )
    for _ in range(2):  # the second time everything is in the cache
        assert Counter(map(tuple, tokencount.count_tokens(odd_docs, BYTES, cache).collect())) == want
        stored = tokencount.read_cache(spark, cache)
        assert stored.count() == len({r.text or "" for r in rows})
    assert tokencount.count_tokens(no_docs, BYTES, cache).count() == 0


def test_the_cache_is_what_is_asked(spark, tmp_path):
    cache = str(tmp_path / "cache")
    docs = spark.createDataFrame([(1, "kept in the cache")], "doc_id bigint, text string")
    planted = docs.select(
        F.lit(tokencount.tokenizer_digest(BYTES)).alias("tokenizer"),
        tokencount.content_digest(F.col("text")).alias("digest"),
        F.lit(99).cast("bigint").alias("n_tokens"),
    )
    planted.write.parquet(cache)
    assert tokencount.count_tokens(docs, BYTES, cache).first().n_tokens == 99


@pytest.mark.parametrize("capacity", [8, 64])
def test_packing_round_trip(spark, odd_docs, no_docs, capacity):
    rows = odd_docs.select("doc_id", "text").where("doc_id is null or doc_id <> 12").collect()
    docs = odd_docs.where("doc_id is null or doc_id <> 12")
    placed = packing.pack(docs, WORDS, capacity).collect()
    wanted = Counter()
    for r, ids in zip(rows, plain_ids(WORDS, [r.text for r in rows]), strict=True):
        ids = [*ids, 0]
        for k, at in enumerate(range(0, len(ids), capacity)):
            wanted[r.doc_id, k, at, tuple(ids[at : at + capacity])] += 1
    assert Counter((p.doc_id, p.piece, p.start, tuple(np.frombuffer(p.ids, "<u4").tolist())) for p in placed) == wanted
    by_sequence = {}
    for p in placed:
        assert p.length == len(p.ids) // 4
        by_sequence.setdefault(p.sequence_id, []).append((p.offset, p.length))
    for parts in by_sequence.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    assert len(by_sequence) <= 1 + 1.25 * sum(p.length for p in placed) / capacity
    assert packing.pack(no_docs, WORDS, capacity).count() == 0


def test_packing_plans_place_every_piece_once():
    rng = random.Random(2)
    for _ in range(60):
        capacity = rng.choice([1, 2, 3, 10, 64, 2048])
        counts = {x: rng.randint(1, rng.choice([2, 50])) for x in rng.sample(range(1, capacity + 1), rng.randint(1, min(capacity, 200)))}
        filled, seen = {}, Counter()
        for run in packing.plan(counts, capacity):
            for rank in range(run.first, run.stop):
                seen[run.length, rank] += 1
                at = run.sequence + (rank - run.first) // run.each
                filled.setdefault(at, []).append((run.used + (rank - run.first) % run.each * run.length, run.length))
        assert seen == Counter((x, r) for x, n in counts.items() for r in range(n))
        for parts in filled.values():
            assert sum(n for _, n in parts) <= capacity
            assert [o for o, _ in sorted(parts)] == [sum(n for _, n in sorted(parts)[:i]) for i in range(len(parts))]
            assert sum(3 * n > capacity for _, n in parts) <= 2  # large pieces pair at most


def plain_dedup(rows, length=20, documents=3):
    strip = " \t\n\x0b\x0c\r"
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    key = lambda line: line.strip(strip).translate(lower)
    found = {}
    for doc, text in rows:
        for line in (text or "").split("\n"):
            if doc is not None and len(key(line)) >= length:
                found.setdefault(key(line), set()).add(doc)
    out = Counter()
    for doc, text in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if doc is None or len(found.get(key(x), ())) < documents or max(found[key(x)]) == doc]
        out[doc, "\n".join(kept), len(lines), len(lines) - len(kept)] += 1
    return out


def test_line_dedup(spark, odd_docs, no_docs):
    hot = "\n".join(["a line that a third of all documents hold"] + [f"line number {i} of a long document" for i in range(200)])
    more = [(100 + i, hot if i % 3 else f"É only {i}\n" + hot) for i in range(30)] + [(3, "other text of three\n" + hot)]
    docs = odd_docs.select("doc_id", "text").union(spark.createDataFrame(more, "doc_id bigint, text string"))
    rows = [tuple(r) for r in docs.collect()]
    got = linededup.dedup_lines(docs.withColumns({c: F.lit(1) for c in ("keep", "version", "doc", "n_lines")}))
    got = Counter(map(tuple, got.select("row.doc_id", "kept_text", "n_lines", "n_dropped").collect()))
    assert got == plain_dedup(rows)
    assert linededup.dedup_lines(no_docs).count() == 0
    again = linededup.without_repeated_lines(odd_docs)
    assert again.columns == odd_docs.columns and again.count() == odd_docs.count()


def luhn(digits):
    twice = [int(c) * (2 if i % 2 else 1) for i, c in enumerate(reversed(digits))]
    return sum(x - 9 if x > 9 else x for x in twice) % 10 == 0


PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def plain_spans(text):
    out = []
    for kind, pattern in PATTERNS.items():
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            good = {
                "email": lambda: True,
                "ip": lambda: all(int(x) <= 255 for x in m[0].split(".")),  # noqa: B023
                "card": lambda: 13 <= len(digits) <= 19 and luhn(digits),  # noqa: B023
                "phone": lambda: 9 <= len(digits) <= 15,  # noqa: B023
            }[kind]()
            if good:
                out.append((list(PATTERNS).index(kind), m.start(), m.end()))
    return out


def test_base_spans(spark, odd_docs, no_docs):
    rng = random.Random(3)
    parts = "a|b.c|@|x@y.z|a@b.com_q@r.org|1.2.3.4|1.2.3.4.5|256.1.1.1|0001.002.3.4|..|+|+1 (743) 555-3824|+12|4785380592391139|4785-3805 9239 1139| |-|(|)|7|12345678901234567890|é|😀|\n".split("|")
    texts = [(i, "".join(rng.choice(parts) for _ in range(rng.randint(0, 25)))) for i in range(1500)]
    docs = odd_docs.select("doc_id", "text").union(spark.createDataFrame(texts, "doc_id bigint, text string"))
    got = docs.select("doc_id", "text", pii.base_spans(F.coalesce("text", F.lit(""))).alias("base")).collect()
    for r in got:
        assert [tuple(x) for x in r.base] == plain_spans(r.text), r.text
    found = pii.find(docs)
    assert found.count() == docs.count()
    for r in found.select("row.doc_id", "base", "spans").collect():
        base, every = {tuple(x) for x in r.base}, [tuple(x) for x in r.spans]
        assert base <= set(every) and every == sorted(every)
        assert all(a in base or not any(b[1] < a[2] and b[2] > a[1] for b in base) for a in every)
    assert pii.find(no_docs).count() == 0
    assert pii.find(odd_docs).count() == odd_docs.count()


def planted_card(rng):
    digits = "4" + "".join(rng.choice("0123456789") for _ in range(14))
    return next(digits + c for c in "0123456789" if luhn(digits + c))


def test_planted_forms_that_are_no_base_spans_are_added(spark):
    rng = random.Random(5)
    part, name = lambda: str(rng.randint(10, 255)), lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    number = lambda: f"{rng.randint(200, 999)} {rng.randint(200, 999)}-{rng.randint(1000, 9999)}"
    texts = []
    for _ in range(300):
        texts += [f"write to {name()}@{name()}.org today", f"the host {part()}.{part()}.{part()}.{part()} is down"]
        texts += [f"paid by card {planted_card(rng)} then", f"call +1 {number()} now", f"order 4{rng.randint(10**11, 10**12 - 1)} came"]
    planted = {}
    for i in range(20):
        card = planted_card(rng)
        forms = [("email", f"{name()} (at) {name()} (dot) org"), ("phone", f"1 {number()}"), ("phone", f"001 {number()}")]
        forms += [("ip", f"{part()} . {part()} . {part()} . {part()}"), ("card", ".".join(card[k : k + 4] for k in range(0, 16, 4)))]
        before = {"email": "write to ", "phone": "call ", "ip": "the host ", "card": "paid by card "}
        for k, (kind, form) in enumerate(forms):
            planted[10_000 + 10 * i + k] = (pii.KINDS.index(kind), len(before[kind]), len(before[kind]) + len(form))
            texts.append((10_000 + 10 * i + k, f"{before[kind]}{form} and so on"))
    wrong = ["paid by card 4785.3805.9239.1138 then", "the host 300 . 1 . 2 . 3 is down", "call x1 743 555-3824x now", "call 555 3824 now"]
    texts += [(20_000 + i, t) for i, t in enumerate(wrong)]
    docs = spark.createDataFrame([t if isinstance(t, tuple) else (i, t) for i, t in enumerate(texts)], "doc_id bigint, text string")
    got = {r.doc_id: [tuple(x) for x in r.spans] for r in pii.find(docs).where("row.doc_id >= 10000").select("row.doc_id", "spans").collect()}
    missed = {i: texts_of for i, texts_of in planted.items() if texts_of not in got[i]}
    assert len(missed) <= 0.05 * len(planted), missed
    assert {k for i, (k, _, _) in planted.items() if i not in missed} == set(range(4))
    assert all(not got[i] for i in range(20_000, 20_000 + len(wrong)))


def test_a_rare_kind_keeps_its_threshold_beside_a_common_one(spark, monkeypatch):
    rng = random.Random(6)
    part = lambda: str(rng.randint(10, 255))
    texts = [f"the host {part()}.{part()}.{part()}.{part()} is down" for _ in range(200)]
    texts += [f"host {part()} . {part()} . {part()} . {part()} is up" for _ in range(10)]
    texts += [f"id {i:06}{rng.randint(10**6, 10**7)} " * 20 for i in range(300)]  # many failed cards
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    monkeypatch.setattr(pii.boosting, "ROWS", 400)
    monkeypatch.setattr(pii.boosting.sample, "__defaults__", (400,))
    monkeypatch.setattr(pii, "SAMPLE", 50, raising=False)
    seen = []
    thresholds = pii.thresholds
    monkeypatch.setattr(pii, "thresholds", lambda scored, *more: seen.append(scored.groupBy("kind").count().collect()) or thresholds(scored, *more))
    got = pii.find(docs).where("row.doc_id between 200 and 209").select("spans").collect()
    assert all([x["kind"] for x in r.spans] == [pii.KINDS.index("ip")] for r in got) and len(got) == 10
    assert dict(map(tuple, seen[0]))[pii.KINDS.index("card")] > 400  # all rows set aside, not a sample's


def test_redaction(spark):
    docs = spark.createDataFrame([("é x@y.org, +1 (743) 555-3824.",)], "text string")
    base = pii.base_spans(F.col("text"))
    assert docs.select(pii.redact(F.col("text"), base).alias("t")).first().t == "é [email], [phone]."


RULES = [("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/")]


def plain_rule(url):
    if url is None or "://" not in url:
        return "", "", None, None
    rest = re.split(r"[?#]", url.split("://", 1)[1], maxsplit=1)[0]
    host, slash, path = rest.partition("/")
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
    path = slash + path
    best = None
    for action, text in RULES:
        rule_host, _, tail = text.partition("/")
        if (host == rule_host or host.endswith("." + rule_host)) and path.startswith("/" + tail) and (best is None or len(text) > len(best[1])):
            best = action, text
    return host, path, best and best[1], best and best[0]


def test_url_rules_and_verdicts(spark):
    rng = random.Random(4)
    hosts = ["a.example.com", "www.example.com", "EXAMPLE.com", "Ünder.example.COM", "x.net", "net", "com", "notcom", "y.org", "a.b.com:80", ""]
    tails = ["", "/", "/en/1", "/en", "/es/2.html", "/fr/?a=1&b=2", "?q=1", "#f", "/x#y?z", "//en/"]
    urls = [rng.choice(["http://", "https://", "ftp:", "://"]) + rng.choice(hosts) + rng.choice(tails) for _ in range(400)]
    urls += [None, "", "no scheme", "http://", "http://a.com/" + "x" * 5000, "http://a://b.net/es/\nz"]
    pages = spark.createDataFrame([(i, u, "c") for i, u in enumerate(urls)] + [(1, urls[1], "c")], "page_id bigint, url string, host string")
    pages = pages.withColumns({c: F.lit("clash") for c in ("row", "text", "rule", "action", "verdict", "e1", "f_length", "score")})
    got = urlfilter.judge(pages, RULES).select(F.col("row.page_id").alias("page_id"), "host", "path", "rule", "verdict").collect()
    assert len(got) == len(urls) + 1
    for r in got:
        host, path, rule, action = plain_rule(urls[r.page_id])
        assert (r.host, r.path, r.rule) == (host, path, rule), urls[r.page_id]
        assert r.verdict == action if action else r.verdict in ("allow", "block")
    assert urlfilter.judge(pages.limit(0), RULES).count() == 0
    alone = urlfilter.judge(pages.where("url like '%y.org%'"), RULES)  # nothing to learn from
    assert {r.verdict for r in alone.collect()} == {"allow"}


SF = "/root/testdata/sf0.01"


def test_language_id_on_held_out_rows(spark, odd_docs, no_docs):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = langid.identify(docs).select("row.doc_id", "row.lang", "row.text", "lang_pred", "score").collect()
    assert len(got) == docs.count() and all(0 <= r.score <= 1 for r in got)
    held = [r for r in got if zlib.crc32(str(r.doc_id).encode()) % 3 == 1]
    assert sum(r.lang == r.lang_pred for r in held) >= 0.98 * len(held)
    changed = docs.withColumn("lang", F.when(~langid.held_out(F.col("doc_id")), F.col("lang"))).withColumn("source", F.lit("x"))
    again = langid.identify(changed).select("row.doc_id", "lang_pred", "score").collect()
    assert {(r.doc_id, r.lang_pred, r.score) for r in again} == {(r.doc_id, r.lang_pred, r.score) for r in got}
    odd = langid.identify(odd_docs).select("row.text", "lang_pred", "score").collect()
    assert len(odd) == odd_docs.count()
    for r in odd:
        assert (r.lang_pred == "und") == (r.text is None or not any(map(str.isalpha, r.text)))
    assert langid.identify(no_docs).count() == 0
    bare = langid.identify(odd_docs.withColumn("lang", F.lit(None).cast("string")))
    assert {(r.lang_pred, r.score) for r in bare.collect()} == {("und", 0.0)}


def test_kernel_is_that_of_shared_runs():
    texts = ["the cat", "the dog", "un chat"]
    sets = [set(langid.runs(t).tolist()) for t in texts]
    rows = langid.presence(texts)
    want = [[len(a & b) / (len(a) * len(b)) ** 0.5 for b in sets] for a in sets]
    assert np.allclose(langid.kernel(rows, rows), want, atol=1e-5)


def test_quality_on_held_out_rows(spark, odd_docs, no_docs):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    scored = quality.score_quality(docs, labels).select("row.doc_id", "score").join(labels, "doc_id").collect()
    held = [(r.score, r.quality) for r in scored if zlib.crc32(str(r.doc_id).encode()) % 4 == 2]
    good, bad = [s for s, q in held if q == 1], [s for s, q in held if q == 0]
    assert sum((a > b) + (a == b) / 2 for a in good for b in bad) >= 0.99 * len(good) * len(bad)
    assert sum(s >= quality.ACCEPTED for s in good) >= 0.98 * len(good)
    assert sum(s < quality.ACCEPTED for s in bad) >= 0.9 * len(bad)


def test_quality_of_odd_rows(spark, odd_docs, no_docs):
    labels = spark.createDataFrame([(7, 1, None), (7, 1, 0), (8, 0, 1), (None, 1, 0), (10, None, 0)], "doc_id bigint, quality int, toxic int")
    got = quality.score_quality(odd_docs, labels).select("row.doc_id", "score").collect()
    assert len(got) == odd_docs.count() and all(0 <= r.score <= 1 for r in got)
    none = quality.score_quality(odd_docs, labels.limit(0)).select("score").distinct().collect()
    assert [r.score for r in none] == [0.5]
    assert quality.score_quality(no_docs, labels).count() == 0
    kept = quality.good_only(odd_docs, labels.limit(0))
    assert kept.columns == odd_docs.columns and kept.count() == odd_docs.count()


def test_risk_is_minimised_without_labelled_bad_rows():
    rng = np.random.RandomState(0)
    good, bad = rng.randn(3000, quality.N_FEATURES) + 0.5, rng.randn(3000, quality.N_FEATURES) - 0.5
    model = quality.fit(good[:1000], np.vstack([good[1000:2000], bad[:1000]]), 0.5)
    assert (model.margin(good[2000:]) > 0).mean() > 0.95 and (model.margin(bad[1000:]) < 0).mean() > 0.95


