"""Encoding, rules, mixing and SimHash against brute force, on small tables with odd rows."""

import collections
import math
import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from minpair.llm import bpe, components, mixing, rules, simhash
from minpair.llm.queries import QUERIES, word_tokenizer

SF = "/root/testdata/sf0.001"
SPACE = " \t\n\x0b\x0c\r"


def cut_words(text):
    out = (text or "").encode()
    return [w.decode() for w in out.split()]


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls in every column, empty and long texts, repeated rows, a clashing extra column."""
    rnd = random.Random(5)
    vocab = ["the", "of", "Straße", "été", "x" * 60, "###", "a|b", "NO!!", "don't", "1234"]
    rows = [(1, None, None, None, 1.0), (None, "a b c", "en", "s1", None), (2, "", "en", "s1", 2.0),
            (3, "  \n\t ", None, "s2", 3.0), (4, "one", "en", None, 4.0), (4, "one", "en", None, 4.0),
            (5, "ab <|endoftext|> cd<|startoftext|>", "en", "s1", 0.0), (6, "a\x1cb\x0bc", "en", "s3", 0.0),
            (7, " ".join(vocab * 3000), "fr", "s2", 0.0), (8, "line one\nline one\n\nline one", "fr", "s2", 0.0)]
    for i in range(9, 60):
        rows.append((i, " ".join(rnd.choice(vocab) for _ in range(rnd.randint(1, 60))), rnd.choice(["en", "fr", None]),
                     rnd.choice(["s1", "s1", "s2", "é", None]), 1.0))
    rows += [(100 + i, rows[20][1], "en", "s1", 1.0) for i in range(25)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, size double")


def test_bpe_matches_library(spark, odd):
    from tokenizers import Tokenizer
    lib = Tokenizer.from_file(word_tokenizer())
    got = bpe.decode(bpe.encode(odd, word_tokenizer()), word_tokenizer()).collect()
    assert len(got) == odd.count()
    for r in got:
        e = lib.encode(r.text or "", add_special_tokens=False)
        assert r.ids == e.ids
        assert r.decoded == lib.decode(e.ids, skip_special_tokens=False)
    assert bpe.encode(odd.limit(0), word_tokenizer()).count() == 0


def test_bpe_digests_of_odd_texts(spark, odd):
    """One pass gives what encoding and decoding give one by one; null texts and empty tables too."""
    import hashlib
    both = bpe.decode(bpe.encode(odd, word_tokenizer()), word_tokenizer()).collect()
    want = collections.Counter((r.doc_id, tuple(r.ids), len(r.ids), hashlib.sha256(np.array(r.ids, "<u4").tobytes()).hexdigest(),
                                hashlib.sha256(r.decoded.encode()).hexdigest()) for r in both)
    got = bpe.digests(odd, word_tokenizer(), ["doc_id"], ids="ids")
    assert got.columns == ["doc_id", "ids", "n_tokens", "ids_sha256", "decoded_sha256"]
    assert collections.Counter((r[0], tuple(r[1]), *r[2:]) for r in got.collect()) == want
    assert bpe.digests(odd.limit(0), word_tokenizer(), ["doc_id"], ids="ids").count() == 0


def test_bpe_query_digests(spark):
    import hashlib

    from tokenizers import Tokenizer
    lib = Tokenizer.from_file(word_tokenizer())
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = QUERIES["op2_bpe"](spark, SF).collect()
    assert len(rows) == len(texts)
    for r in rows:
        ids = lib.encode(texts[r.doc_id], add_special_tokens=False).ids
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(lib.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def brute_measures(text):
    ws = cut_words(text)
    wins = [tuple(ws[i:i + 8]) for i in range(len(ws) - 7)]
    n = collections.Counter(wins)
    covered = {i + k for i, w in enumerate(wins) if n[w] > 1 for k in range(8)}
    lines = [x for x in (text or "").split("\n") if x.strip(SPACE)]
    return (len(ws), sum(map(len, ws)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(covered))


def test_rules_measures(spark, odd):
    texts = [r.text for r in odd.select("text").collect()]
    got = rules.measure(odd.select("doc_id", "lang", F.col("text"), F.col("text").alias("copy"))).collect()
    assert len(got) == len(texts)
    for r in got:
        want = brute_measures(r.copy)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (want[0] < 20 or 100 * want[4] > 30 * want[0])


@pytest.mark.parametrize("n,p,k", [(50, 0.1, 0), (50, 0.1, 3), (2000, 0.01, 5), (1_000_000, 0.01, 9800), (300, 0.01, 2)])
def test_binomial_tail(spark, n, p, k):
    logs = [math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(p) + (n - i) * math.log1p(-p)
            for i in range(k + 1)]
    want = math.fsum(map(math.exp, logs))
    got = spark.range(1).select(rules.binomial_tail(F.lit(k), F.lit(n), p).alias("x")).first().x
    assert got == pytest.approx(want, rel=1e-6)


def test_rules_cutoffs_limit_false_rejection(spark):
    """Good texts in which one in 500 has many symbols: the cutoff keeps them within the risk, and
    bad texts over it go; a stratum with few labels rejects nothing."""
    rows = [(i, "a" * 9 + "#" * (i % 500 == 0) * 9, "en", 1) for i in range(4000)]
    rows += [(9000 + i, "#" * 9, "en", 0) for i in range(50)] + [(9900 + i, "#" * 9, "de", 1) for i in range(5)]
    docs = spark.createDataFrame([(i, " ".join(f"{w}{k}" for k in range(30)), g) for i, w, g, _ in rows], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, q) for i, _, _, q in rows] + [(0, None), (None, 1)], "doc_id long, quality int")
    m = rules.measure(docs)
    cuts = rules.cutoffs(m, labels, "lang", risk=0.01)
    by = {(r.stratum, r.rule): r.cutoff for r in cuts.collect()}
    assert by["en", "symbol_share"] is not None and by["de", "symbol_share"] is None
    kept = rules.judge(m, cuts, "lang").collect()
    assert sum(not r.kept for r in kept if r.doc_id < 4000) <= 40
    assert not any(r.kept for r in kept if 9000 <= r.doc_id < 9900)
    assert all(r.kept for r in kept if r.doc_id >= 9900)
    empty = rules.judge(m, rules.cutoffs(m, labels.limit(0), "lang"), "lang")
    assert empty.where("not kept and not base_failed").count() == 0 and empty.count() == len(rows)


def brute_targets(sizes, weights, epochs):
    total, clamped = sum(sizes.values()), {s for s in sizes if sizes[s] == 0}
    while True:
        free = sum(weights[s] for s in sizes if s not in clamped)
        level = (total - sum(epochs * sizes[s] for s in clamped)) / free if free else 0
        more = {s for s in sizes if s not in clamped and weights[s] * level > epochs * sizes[s]}
        if not more:
            return {s: epochs * sizes[s] if s in clamped else weights[s] * level for s in sizes}
        clamped |= more


def check_mix(df, got):
    sizes, biggest = collections.Counter(), collections.Counter()
    for r in df.collect():
        sizes[r.source] += len(cut_words(r.text))
        biggest[r.source] = max(biggest[r.source], len(cut_words(r.text)))
    order = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [s for s in sizes if s is None]
    want = brute_targets(sizes, {s: i % 3 + 1 for i, s in enumerate(order)}, 3)
    taken = collections.Counter()
    for r in got:
        assert r.target == pytest.approx(want[r.source]) and r.source_size == sizes[r.source]
        assert 0 <= r.taken <= 3 * r.size and r.taken == r.copies * r.size
        taken[r.source] += r.taken
    return want, taken, biggest


def test_mixing(spark, odd):
    got = mixing.mix(odd).collect()
    assert sorted(map(str, ((r.doc_id, r.text) for r in got))) == sorted(map(str, ((r.doc_id, r.text) for r in odd.collect())))
    check_mix(odd, got)
    assert sorted(map(str, got)) == sorted(map(str, mixing.mix(odd.repartition(3)).collect()))
    assert mixing.mix(odd.limit(0)).count() == 0


def test_mixing_reaches_targets(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    mixed = mixing.mix(docs)
    want, taken, biggest = check_mix(docs, mixed.collect())
    for s, t in want.items():
        assert abs(taken[s] - t) <= biggest[s]
    assert mixing.repeated(mixed, docs.columns).count() == sum(r.copies for r in mixed.collect())


def brute_fingerprint(text):
    ws = [w.encode() for w in cut_words("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))]
    if not ws:
        return 0
    hs = [xxhash.xxh64_intdigest(b" ".join(ws[i:i + 3]), seed=42) for i in range(max(1, len(ws) - 2))]
    return sum((2 * sum(h >> b & 1 for h in hs) > len(hs)) << b for b in range(64))


def brute_components(fps):
    """{id: (fingerprint, smallest id reachable)} by comparing all pairs."""
    ids = sorted(fps)
    parent = {i: i for i in ids}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(ids)):
        for b in range(a):
            if (fps[ids[a]] ^ fps[ids[b]]).bit_count() <= 3:
                x, y = find(ids[a]), find(ids[b])
                parent[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def test_simhash_query(spark):
    fps = {r.doc_id: brute_fingerprint(r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    want = brute_components(fps)
    got = {r.doc_id: (int(r.fingerprint, 16), r.component_id) for r in QUERIES["op8_simhash"](spark, SF).collect()}
    assert got == {i: (fps[i], want[i]) for i in fps}


def test_simhash_odd_rows(spark, odd):
    got = simhash.near_duplicates(odd.withColumn("fp", F.lit(1))).collect()
    assert len(got) == odd.count()
    empty = [r for r in got if r.fp == 0]
    assert {r.doc_id for r in empty} == {1, 2, 3} and {r.component_id for r in empty} == {1}
    kept = simhash.keep_one(odd)
    assert kept.columns == odd.columns
    ids = [r.doc_id for r in kept.collect()]
    assert len(ids) == len({(r.component_id, r.fp if r.component_id is None else 0) for r in got})
    assert set(ids) - {None} == {r.component_id for r in got} - {None}
    assert simhash.near_duplicates(odd.limit(0)).count() == 0


def test_simhash_links_find_every_near_pair(spark):
    """Random balls of fingerprints around centres, one of them longer than a tile."""
    rnd = np.random.default_rng(3)
    fps = set()
    for size in (1, 2, 40, 2500):
        centre = int(rnd.integers(1 << 62))
        for _ in range(size):
            fps.add(centre ^ sum(1 << int(b) for b in rnd.choice(24, rnd.integers(0, 4), replace=False)))
    fps |= {int(x) for x in rnd.integers(1 << 62, size=200)}
    df = spark.createDataFrame([(f,) for f in fps], "fp long")
    got = {r.node: r.root for r in components.components(simhash.links(df)).collect()}
    arr = np.array(sorted(fps), np.uint64)
    near = np.bitwise_count(arr[:, None] ^ arr[None, :]) <= 3
    label = np.arange(len(arr))
    while True:
        new = np.array([label[row].min() for row in near])
        if (new == label).all():
            break
        label = new
    assert {int(a): got.get(int(a), int(a)) for a in arr} == {int(a): int(arr[x]) for a, x in zip(arr, label, strict=True)}


def test_components_long_chain(spark):
    chain = spark.range(0, 200).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    more = chain.unionByName(spark.createDataFrame([(900, 901), (901, 900), (5, 5), (None, 3)], "a long, b long"))
    got = {r.node: r.root for r in components.components(more).collect()}
    assert got == {i: 0 for i in range(201)} | {900: 900, 901: 900}
    assert components.components(more.limit(0)).count() == 0
