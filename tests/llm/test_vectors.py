"""Fingerprints, whitening and clustering against plain Python, and odd rows."""

import hashlib
import math
import random
import struct

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from minpair.llm import bisector, syncmers, whitening
from minpair.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
K, S = syncmers.K, syncmers.S


def signed(data):
    return xxhash.xxh64(data, seed=42).intdigest() - (1 << 64) * (xxhash.xxh64(data, seed=42).intdigest() >> 63)


# --- fingerprints -------------------------------------------------------------------------------

def brute_anchors(text, k=K, s=S):
    """Closed syncmers by their definition; a text without any is one anchor."""
    out = []
    for at in range(len(text) - k + 1):
        part = text[at:at + k]
        inner = [signed(part[i:i + s].encode("utf-32-be")) for i in range(k - s + 1)]
        if min(inner) in (inner[0], inner[-1]):
            out.append((at, signed(part.encode("utf-32-be"))))
    return out or ([(0, signed(text.encode()))] if text else [])


def brute_likeness(a, b):
    def hashed(found):
        link, spot = set(), set()
        for j, (at, key) in enumerate(found):
            before = found[j - 1] if j else None
            link.add((before[1], at - before[0], key) if before else (key,))
            spot.add((at, key))
        return link, spot

    def dice(x, y):
        return 2 * len(x & y) / (len(x) + len(y)) if x or y else 1.0

    return max(dice(x, y) for x, y in zip(hashed(a), hashed(b), strict=True))


def brute_print(found):
    return " ".join(f"{at - (found[j - 1][0] if j else 0)}:{key}" for j, (at, key) in enumerate(found))


def brute_rows(texts):
    """Results for texts in the order of falling ids."""
    out = []
    for i, t in enumerate(texts):
        after = texts[(i + 1) % len(texts)]
        half = len(t) // 2
        edited = t[:len(t) - half] + after[:half]
        a, b, c = brute_anchors(t), brute_anchors(edited), brute_anchors(after)
        out.append((len(t), hashlib.sha256(edited.encode()).hexdigest(), brute_print(a), brute_print(b),
                    brute_likeness(a, b), brute_likeness(a, c)))
    return out


def same_rows(got, want):
    assert len(got) == len(want)
    for g, w in zip(got, want, strict=True):
        assert g[:4] == w[:4] and g[4] == pytest.approx(w[4], abs=1e-12) and g[5] == pytest.approx(w[5], abs=1e-12)


def test_fingerprint_query_equals_brute_force(spark):
    docs = sorted(spark.read.parquet(f"{SF}/documents.parquet").collect(), key=lambda r: -r.doc_id)
    got = {r.doc_id: tuple(r[1:]) for r in QUERIES["op11_fingerprints"](spark, SF).collect()}
    keep = [i for i, r in enumerate(docs) if len(r.text or "") < 3000 and len(docs[(i + 1) % len(docs)].text or "") < 3000]
    assert len(got) == len(docs) and len(keep) > 50
    for i in keep:
        want = brute_rows([docs[i].text or "", docs[(i + 1) % len(docs)].text or ""])[0]
        same_rows([got[docs[i].doc_id]], [want])


@pytest.mark.parametrize(("k", "s"), [(24, 9), (8, 3), (7, 7), (5, 4), (12, 2)])
def test_anchors_of_any_width(spark, k, s):
    rng = random.Random(k)
    texts = ["".join(rng.choice("ab é\U0001f642") for _ in range(n)) for n in (0, 1, k - 1, k, k + 1, 300)]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select(syncmers.anchors(F.col("t"), k, s).alias("a"), "t").collect()
    for r in got:
        want = brute_anchors(r.t, k, s) if len(r.t) >= k else []
        want = [] if want == [(0, signed(r.t.encode()))] else want
        assert [tuple(x) for x in r.a] == want


def test_anchors_have_no_context(spark):
    """Any k - s k-mers in a row hold an anchor, and a passage's anchors stay when it moves."""
    rng = random.Random(3)
    passage = "".join(rng.choice("abcdefgh ") for _ in range(400))
    rows = [(passage,), ("xyz " * 9 + passage,)]
    a, b = (r.a for r in spark.createDataFrame(rows, "t string").select(syncmers.anchors(F.col("t")).alias("a")).collect())
    assert {(x.at + 36, x.key) for x in a} <= {tuple(x) for x in b}
    assert max(y.at - x.at for x, y in zip(a, a[1:])) <= K - S


def next_of(spark, rows, schema, **kw):
    out = syncmers.following(spark.createDataFrame(rows, schema), **kw).where("not borrowed")
    return [(r.doc_id, r.text, r.next_text) for r in out.collect()]


@pytest.mark.parametrize("part_chars", [1, 40, 1000, 10 ** 9])
def test_next_text_over_parts(spark, part_chars):
    rng = random.Random(part_chars)
    ids = rng.sample(range(1000), 60)
    rows = [(i, f"text {i} " + "x" * rng.randrange(30)) for i in ids]
    got = sorted(next_of(spark, rows, "doc_id long, text string", part_chars=part_chars), reverse=True)
    order = sorted(rows, reverse=True)
    assert got == [(*r, order[(n + 1) % len(order)][1]) for n, r in enumerate(order)]


def test_next_text_of_odd_rows(spark):
    schema = "doc_id string, text string, part int"
    hot = [("b", f"hot {i}", 1) for i in range(50)]
    rows = [(None, None, 1), (None, "late", 1), ("a", "one", None), ("c", "two", 3), ("c", "two", 3), *hot]
    for size in (3, 10 ** 6):
        got = next_of(spark, rows, schema, part_chars=size)
        assert sorted((i or "", t) for i, t, _ in got) == sorted((i or "", t or "") for i, t, _ in rows)
        # Following the texts from row to row goes around the whole table.
        assert sorted(n for _, _, n in got) == sorted(t for _, t, _ in got)
        after = {t: n for i, t, n in got if i in ("a", None)}
        assert {after["one"], after["late"], after[""]} <= {"late", "", "two"}
    assert next_of(spark, [(5, "alone")], "doc_id long, text string") == [(5, "alone", "alone")]
    assert next_of(spark, [], "doc_id long, text string") == []


def test_edited_compares_with_the_next_text_without_working_it_out_again(spark):
    """links of a text and of its edited one only, those of the next come from the window (before: three)."""
    rows = [(i, "some words that go on " * i) for i in range(9)]
    out = syncmers.edited(spark.createDataFrame(rows, "doc_id long, text string"))
    plan = QUERIES["op11_fingerprints"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("array_distinct(") == 2
    by_id = {r.doc_id: r for r in out.collect()}
    for i in range(9):
        after = by_id[i - 1 if i else 8]
        assert by_id[i].links_next_anchors == after.links_anchors and by_id[i].spots_next_anchors == after.spots_anchors


def test_edited_odd_rows(spark):
    texts = ["long " * 30000, "", "a", "é\U0001f642\x00" * 20, "same words in a row " * 9, "same words in a row " * 9, None]
    rows = [(100 - i, t, "en", 7) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, anchors string, keep int")
    out = syncmers.edited(docs).withColumns({f"{f.__name__}_{c}": f(F.col(c)) for f in (syncmers.links, syncmers.spots)
                                             for c in ("anchors", "edited_anchors", "next_anchors")})
    pair = [(F.col(f"links_{c}"), F.col(f"spots_{c}")) for c in ("anchors", "edited_anchors", "next_anchors")]
    got = out.orderBy(F.desc("doc_id")).select(
        F.length("text"), F.sha2("edited", 256), syncmers.fingerprint(F.col("anchors")), syncmers.fingerprint(F.col("edited_anchors")),
        syncmers.likeness(pair[0], pair[1]), syncmers.likeness(pair[0], pair[2])).collect()
    want = brute_rows([t or "" for t in texts])
    same_rows([tuple(r) for r in got], want)
    assert want[4][5] == 1.0 and got[4][2] == got[5][2] and got[1][5] == 0.0


# --- whitening ----------------------------------------------------------------------------------

def test_jacobi_of_cholesky_factor():
    rng = np.random.default_rng(1)
    for d, rank in ((1, 1), (2, 1), (5, 5), (9, 4), (40, 40)):
        a = rng.normal(size=(d, rank)) * np.logspace(0, -5, rank)
        v = a @ a.T
        factor = whitening.pivoted_cholesky(v)
        assert factor.shape[1] == rank and np.allclose(factor @ factor.T, v, rtol=1e-10, atol=1e-14)
        values, vectors = whitening.jacobi(factor)
        assert np.allclose(values, np.linalg.eigvalsh(v)[::-1][:rank], rtol=1e-4)
        assert np.allclose(values[:1], np.linalg.eigvalsh(v)[-1], rtol=1e-13)
        assert np.allclose(vectors.T @ vectors, np.eye(rank), atol=1e-12)
    assert whitening.pivoted_cholesky(np.zeros((3, 3))).shape == (3, 0)
    assert len(whitening.jacobi(np.zeros((3, 0)))[0]) == 0
    half = np.array([[2.0, 0, 0], [0, 2.0, 0], [0, 0, 1.0]])  # equal eigenvalues
    assert np.allclose(whitening.jacobi(whitening.pivoted_cholesky(half))[0], [2, 2, 1])


def check_whitened(rows, got, components=4):
    """``rows``: (id, vector) that take part."""
    x = {i: tuple(math.floor(256 * float(e)) for e in v) for i, v in rows}
    fit = np.array(sorted(set(x.values())), dtype=object)
    n, s = len(fit), fit.sum(axis=0)
    v = np.cov(fit.astype(float).T, bias=True)
    values, vectors = np.linalg.eigh(v)
    values, vectors = values[::-1], vectors[:, ::-1]
    assert {(r.vec_id, r.component) for r in got} == {(i, c) for i in x for c in range(1, components + 1)}
    for r in got:
        e = values[r.component - 1]
        off = [n * a - b for a, b in zip(x[r.vec_id], s, strict=True)]
        assert r.n == n and r.deviation == sum(o * o for o in off)
        assert r.explained == pytest.approx(e / np.trace(v), rel=1e-9) and r.identity_error < 1e-9
        w = np.array(off, dtype=float) / n @ vectors[:, r.component - 1] / math.sqrt(e)
        assert abs(abs(r.whitened) - abs(w)) < 1e-7


def test_whitening_query(spark):
    rows = spark.read.parquet(f"{SF}/embeddings.parquet").collect()
    got = QUERIES["op12_whitening"](spark, SF).collect()
    check_whitened([(r.vec_id, r.embedding) for r in rows], got)
    for c in range(1, 5):
        w = np.array([r.whitened for r in got if r.component == c])
        assert abs(w.mean()) < 1e-9 and w.var() == pytest.approx(1, abs=1e-6)


def test_whitening_of_odd_rows(spark):
    rng = random.Random(5)
    good = [(i, [rng.gauss(0, 1 + d) for d in range(6)], "x") for i in range(40)]
    odd = [(50, None, "x"), (51, [1.0, None, 1.0, 1.0, 1.0, 1.0], "x"), (52, [float("nan")] * 6, "x"), (53, [float("inf")] + [0.0] * 5, "x"),
           (54, [1.0], "x"), (55, [], "x")]
    same = [(60, good[0][1], "y"), (61, [-0.0] * 6, "y")]
    got = whitening.whiten(spark.createDataFrame(good + odd + same, "vec_id long, embedding array<double>, component string")).collect()
    check_whitened([r[:2] for r in good + same], got)
    twin = {r.component: r.whitened for r in got if r.vec_id == 60}
    assert twin == {r.component: r.whitened for r in got if r.vec_id == 0}
    null = whitening.whiten(spark.createDataFrame([(None, [0.0, 1.0]), (None, [1.0, 0.0])], "vec_id long, embedding array<float>")).collect()
    assert [(r.component, r.n) for r in null] == [(1, 2)] * 2 and {round(r.whitened, 9) for r in null} == {1.0, -1.0}
    for rows in ([], [(1, [1.0, 2.0])], [(1, [1.0, 2.0]), (2, [1.0, 2.0])], [(1, [])]):
        assert whitening.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect() == []


def test_whitening_of_large_entries(spark):
    rng = random.Random(6)
    rows = [(i, [rng.uniform(-1e12, 1e12) for _ in range(3)]) for i in range(30)]
    got = whitening.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), components=2).collect()
    assert len(got) == 60 and all(r.deviation is None and r.identity_error < 1e-9 for r in got)


# --- clustering ---------------------------------------------------------------------------------

def brute_clusters(rows, k=16, rounds=3, scale=64):
    x = [(i, [math.floor(scale * float(e)) for e in v]) for i, v in rows]
    tag = [hashlib.sha256(f"1:{i if i is not None else ''}".encode()).hexdigest() for i, _ in x]
    cs = [v for _, v in sorted(zip(tag, [v for _, v in x], strict=True))[:k]]

    def dist(a, b):
        return sum((p - q) ** 2 for p, q in zip(a, b, strict=True))

    for _ in range(rounds):
        own = [min(range(len(cs)), key=lambda c: (dist(v, cs[c]), c)) for _, v in x]
        for c in range(len(cs)):
            held = [v for (_, v), o in zip(x, own, strict=True) if o == c]
            if held:
                cs[c] = [sum(col) // len(held) for col in zip(*held, strict=True)]
    own = [min(range(len(cs)), key=lambda c: (dist(v, cs[c]), c)) for _, v in x]
    d = [dist(v, cs[o]) for (_, v), o in zip(x, own, strict=True)]
    return [(i, o, e, sum(f for f, p in zip(d, own, strict=True) if p == o), sum(d), hashlib.sha256(",".join(map(str, cs[o])).encode()).hexdigest())
            for (i, _), o, e in zip(x, own, d, strict=True)]


def test_clusters_query(spark):
    rows = spark.read.parquet(f"{SF}/embeddings.parquet").collect()
    got = [tuple(r) for r in QUERIES["op13_clusters"](spark, SF).collect()]
    assert sorted(got) == sorted(brute_clusters([(r.vec_id, r.embedding) for r in rows]))


@pytest.mark.parametrize("spread", [0.02, 0.5, 1e5, 1e9])
def test_clusters_ties_and_sizes(spark, spread):
    """Small spreads give many equal distances, large ones leave the range of exact doubles."""
    rng = random.Random(7)
    rows = [(i, [rng.uniform(-spread, spread) for _ in range(3)]) for i in range(60)]
    rows += [(i, rows[i % 7][1]) for i in range(60, 80)] + [(5, rows[5][1]), (None, rows[6][1])]
    got = bisector.cluster(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), 3, k=5).collect()
    want = brute_clusters(rows, 5)
    limit = 2 ** 63
    want = [(i, o, d if d < limit else None, ci if ci < limit else None, t if t < limit else None, h) for i, o, d, ci, t, h in want]
    assert sorted(map(str, (tuple(r) for r in got))) == sorted(map(str, want))


def test_clusters_of_odd_rows(spark):
    schema = "vec_id long, embedding array<float>, cluster string"
    rows = [(1, [0.5, 0.25], "a"), (2, None, "a"), (3, [0.5], "a"), (4, [0.5, None], "a"), (5, [float("nan"), 0.0], "a"), (6, [0.0, float("inf")], "a"),
            (7, [0.5, 0.25], "a"), (8, [3.0, -2.0], "a"), (9, [], "a")]
    got = bisector.cluster(spark.createDataFrame(rows, schema), 2, k=16).collect()
    assert sorted(tuple(r) for r in got) == sorted(brute_clusters([(1, rows[0][1]), (7, rows[6][1]), (8, rows[7][1])]))
    assert bisector.cluster(spark.createDataFrame([], schema), 2).collect() == []
    packed = struct.pack("<f", 0.1)  # a float's own value counts, not its decimal
    value = struct.unpack("<f", packed)[0]
    one = bisector.cluster(spark.createDataFrame([(1, [0.1, value])], "vec_id long, embedding array<float>"), 2).collect()
    assert one[0].distance == 0 and one[0].centroid_sha256 == hashlib.sha256(b"6,6").hexdigest()


def test_bisectors_equal_distances():
    rng = np.random.default_rng(2)
    for scale in (2, 50, 2 ** 30, 2 ** 61):
        c = rng.integers(-scale, scale, (9, 4)).tolist()
        x = rng.integers(-scale, scale, (200, 4))
        got = bisector.Bisectors(c).nearest(x)
        want = [min(range(9), key=lambda j: (sum((int(a) - b) ** 2 for a, b in zip(v, c[j], strict=True)), j)) for v in x]
        assert got.tolist() == want
