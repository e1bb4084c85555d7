"""Centroid clustering, whitening and quality rules against brute force in whole numbers."""

import hashlib
import math
import re
from collections import Counter
from fractions import Fraction

import numpy as np
import pandas as pd
import pytest
import xxhash
from pyspark.sql import functions as F

from quillspark.llm import centroid_clustering as cc
from quillspark.llm import quality_rules as qr
from quillspark.llm import whitening as wh

NAN, INF = float("nan"), float("inf")
KIND = "vec_id long, embedding array<float>, label int, id string, cluster string, v int"


def table(spark, rows):
    return spark.createDataFrame([(i, v, 1, "x", "y", 2) for i, v in rows], KIND)


def lloyd(rows, k, rounds, scale, seed):
    x = np.array([[math.floor(scale * float(np.float32(c))) for c in v] for _, v in rows], dtype=object)
    order = sorted(range(len(rows)), key=lambda r: (rows[r][0] is None, hashlib.sha256(f"{seed}:{rows[r][0]}".encode()).hexdigest() if rows[r][0] is not None else "", [float(np.float32(c)) for c in rows[r][1]]))
    c = [list(x[r]) for r in order[:k]]
    for at in range(rounds + 1):
        d = [[sum((a - b) ** 2 for a, b in zip(v, m, strict=True)) for m in c] for v in x]
        own = [min(range(len(c)), key=lambda j: (row[j], j)) for row in d]
        if at < rounds:
            for j in range(len(c)):
                if mine := [x[i] for i in range(len(x)) if own[i] == j]:
                    c[j] = [sum(col) // len(mine) for col in zip(*mine, strict=True)]
    return own, [d[i][own[i]] for i in range(len(x))], c


@pytest.mark.parametrize("dims, k, spread", [(4, 25, 1.0), (3, 30, 100_000.0), (64, 12, 0.3)])
def test_clusters_as_lloyd(spark, dims, k, spread):
    """Ties, equal vectors, null and repeated identifiers, a hot vector; floats and longs for distances."""
    rng = np.random.default_rng(dims)
    rows = [(int(i), (rng.integers(-3, 4, dims) * spread).tolist()) for i in range(150)]
    rows += [(200 + i, [spread] * dims) for i in range(60)] + [(7, rows[7][1]), (None, [0.0] * dims), (None, [spread] * dims)]
    odd = [(900, None), (901, [1.0] * (dims + 1)), (902, []), (903, [None] * dims), (904, [NAN] * dims), (905, [INF] + [0.0] * (dims - 1))]
    got = cc.centroid_clusters(table(spark, rows + odd).repartition(5), k=k, dims=dims).collect()
    own, far, c = lloyd(rows, k, cc.ROUNDS, cc.SCALE, cc.SEED)
    per = Counter()
    for o, f in zip(own, far, strict=True):
        per[o] += f
    name = lambda j: hashlib.sha256(",".join(map(str, c[j])).encode()).hexdigest()
    want = sorted((str(i), o, f, per[o], sum(far), name(o)) for (i, _), o, f in zip(rows, own, far, strict=True))
    assert sorted((str(r["id"]), *r[1:]) for r in got) == want


def test_bounds_pass_over_centroids():
    """Each step equals a full scan, and filters leave out most centroids once these hardly move."""
    rng = np.random.default_rng(5)
    middles = rng.integers(-800, 800, (40, 16))
    x = (middles[rng.integers(0, 40, 3000)] + rng.integers(-40, 40, (3000, 16))).astype(np.int64)
    c, moved, scanned = x[:40].copy(), None, []
    groups = cc.grouped(c)
    assert sorted(np.concatenate(groups)) == list(range(40)) and len(groups) > 1
    for _ in range(8):
        step = cc.Step(c, groups, moved)
        if moved is None:
            own, upper, lower = step.first(x)
        else:
            own, upper, lower, n = step.next(x, own, upper, lower)
            scanned.append(n)
        d = cc.distances(x, c)
        assert (own == d.argmin(axis=1)).all() and (upper >= np.sqrt(d[np.arange(len(x)), own])).all()
        new = np.stack([x[own == j].sum(axis=0) // (own == j).sum() if (own == j).any() else c[j] for j in range(40)])
        moved, c = cc._up(np.sqrt(((new - c) ** 2).sum(axis=1).astype(float))), new
    assert scanned[-1] < 0.1 * x.shape[0] * 40


def test_few_or_no_vectors(spark):
    assert cc.centroid_clusters(table(spark, []), dims=2).count() == 0
    assert cc.centroid_clusters(table(spark, [(1, None)]), dims=2).count() == 0
    got = cc.centroid_clusters(table(spark, [(1, [1.0, 2.0]), (2, [1.0, 2.0])]), dims=2).collect()
    assert [(r["cluster"], r["distance"], r["inertia"]) for r in got] == [(0, 0, 0)] * 2
    with pytest.raises(Exception, match="too large|fit a long"):
        cc.centroid_clusters(table(spark, [(1, [3e30, 0.0]), (2, [0.0, 1.0])]), dims=2).count()


@pytest.mark.parametrize("spread", [1.0, 3e6, 2e15])
def test_whitens_exactly(spark, spread):
    """Sums in floats, longs and beyond; the deviation and the shares against fractions."""
    rng = np.random.default_rng(8)
    dims = 5
    rows = [(i, [float(np.float32(c)) for c in rng.normal(0, 1, dims) * spread * np.arange(1, dims + 1)]) for i in range(120)]
    rows += [(500, rows[0][1]), (None, rows[1][1])]
    odd = [(900, None), (901, [1.0] * 3), (902, []), (903, [None] * dims), (904, [NAN] * dims), (905, [INF] + [0.0] * 4)]
    got = wh.whiten(table(spark, rows + odd).repartition(4)).toPandas()
    x = [[math.floor(64 * c) + 1_000_000 for c in v] for _, v in rows]
    n = len(x)
    s = [sum(col) for col in zip(*x, strict=True)]
    cov = np.array([[float(sum((n * r[i] - s[i]) * (n * r[j] - s[j]) for r in x) / Fraction(n) ** 3) for j in range(dims)] for i in range(dims)])
    e = np.sort(np.linalg.eigvalsh(cov))[::-1]
    assert len(got) == n * dims and set(got["n"]) == {n} and got["identity_error"].max() < 1e-9
    share = got.drop_duplicates("component").sort_values("component")
    assert np.allclose(share["explained"], e / e.sum(), rtol=1e-9)
    want = sorted((str(i), str(sum((n * r[d] - s[d]) ** 2 for d in range(dims)))) for (i, _), r in zip(rows, x, strict=True))
    if max(len(w) for _, w in want) > 38:
        assert got["deviation"].isna().any()
    else:
        first = got[got["component"] == 1]
        ids = ["None" if pd.isna(i) else str(int(i)) for i in first["id"]]
        assert sorted(zip(ids, map(str, first["deviation"]), strict=True)) == want
    w = got[got["id"].notna()].pivot(index="id", columns="component", values="whitened").loc[[i for i, _ in rows if i is not None]]
    centred = (np.array(x, object)[[i for i, (k, _) in enumerate(rows) if k is not None]] * n - np.array(s, object)).astype(float) / n
    vals, vecs = np.linalg.eigh(cov)
    plain = centred @ vecs[:, ::-1] / np.sqrt(vals[::-1])
    for k in range(dims):
        assert min(np.abs(w[k + 1] - plain[:, k]).max(), np.abs(w[k + 1] + plain[:, k]).max()) < 1e-6


def test_limbs_add_up():
    rng = np.random.default_rng(1)
    total, plain = wh.Total((3,)), [0, 0, 0]
    for k in range(60):
        v = np.array([int(a) * (-1) ** k * 2 ** (k * 3) for a in rng.integers(0, 2**31, 3)], object)
        total.add(v if k > 5 else v.astype(np.int64))
        plain = [p + int(a) for p, a in zip(plain, v, strict=True)]
    assert [sum(int(p[i]) << (32 * k) for k, p in enumerate(total.parts)) for i in range(3)] == plain
    big = np.array([[2**40, -(2**41)], [3, 2**45]], np.int64)
    assert (wh.products(big) == big.astype(object).T.dot(big.astype(object))).all()


def test_nothing_to_whiten(spark):
    for rows in ([], [(1, None)], [(1, [])], [(1, [1.0, 2.0])], [(1, [1.0, 2.0]), (2, [1.0, 2.0])]):
        assert wh.whiten(table(spark, rows)).count() == 0
    one = wh.whiten(table(spark, [(1, [1.0, 2.0]), (2, [1.0, 4.0]), (3, [1.0, 9.0])]))  # one direction has no variance
    assert [r["component"] for r in one.collect()] == [1, 1, 1] and one.head()["explained"] == pytest.approx(1.0)
    assert one.columns == ["id", "component", "n", "deviation", "whitened", "explained", "identity_error"]


def brute_rules(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    many = Counter(windows)
    covered = {i + j for i, w in enumerate(windows) if many[w] > 1 for j in range(8)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    failed = len(words) < 20 or 100 * len(covered) > 30 * len(words)
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered), failed)


def brute_grams(text):
    h = lambda s, seed=42: xxhash.xxh64_intdigest(s, seed)
    words = [h(w.encode()) for w in re.findall(r"[^\x20\x09-\x0D]+", text or "")]
    pairs = [h(b.to_bytes(8, "little"), h(a.to_bytes(8, "little"))) for a, b in zip(words, words[1:], strict=False)]
    signs = [h(s.encode()) for s in re.findall(r"(?:(?!\s)[\W_])+", text or "", re.ASCII if (text or "").isascii() else 0)]
    signed = lambda v: v - 2**64 if v >= 2**63 else v
    return [signed(v) % qr.BUCKETS for v in words + pairs + signs]


def quality_texts():
    rng = np.random.default_rng(2)
    vocabulary = [f"w{i}" for i in range(60)]
    clean = [" ".join(rng.choice(vocabulary, int(rng.integers(20, 200)))) + "." for _ in range(40)]
    junk = [" ".join(f"{w}{s}" for w, s in zip(rng.choice(vocabulary, 60), rng.choice(["&&&", "%%%", "###"], 60), strict=True)) for _ in range(6)]
    phrase = " ".join(f"p{i}" for i in range(9))
    odd = [None, "", " \n\t ", "a", "a b\na b\n\n a b\n" * 3, phrase + " x " + phrase, " ".join(["x"] * 500), "é " * 40, "a " * 7, f"{phrase} " * 30, "x\n" * 30_000, "| <b> #1 $2 & 50% *\n" * 2, "ab c " + " ".join(clean)]
    return clean, junk, [*clean, *junk, *odd, clean[0]]


def test_quality_rules(spark):
    clean, junk, texts = quality_texts()
    rows = [(None if i % 7 == 3 else i // 2, t, 1, [2], "y") for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, h int, words array<int>, id string")
    got = qr.quality_rules(docs.repartition(3), spark.createDataFrame([(t,) for t in clean] + [(None,)], "text string")).toPandas()
    raw, good = Counter(g for t in texts for g in brute_grams(t)), Counter(g for t in clean for g in brute_grams(t))
    ratio = lambda g: round(1e6 * (math.log((good[g] + 1) / (good.total() + qr.BUCKETS)) - math.log((raw[g] + 1) / (raw.total() + qr.BUCKETS))))
    want = []
    for (i, t, *_) in rows:
        base, g = brute_rules(t), brute_grams(t)
        r = sum(map(ratio, g)) / (1e6 * len(g)) if g else 0.0
        want.append((str(i), *base, round(r, 9), not base[-1] and r >= qr.THRESHOLD))
    cells = zip(("None" if pd.isna(i) else str(int(i)) for i in got["id"]), *(got[c] for c in got.columns[1:7]), got["ratio"].round(9), got["kept"], strict=True)
    assert sorted(map(repr, (tuple(x.item() if hasattr(x, "item") else x for x in r) for r in cells))) == sorted(map(repr, want))
    by_text = {t: w[-1] for (_, t, *_), w in zip(rows, want, strict=True)}
    assert all(by_text[t] for t in clean) and not any(by_text[t] for t in junk)
    assert got.columns.tolist() == ["id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "ratio", "kept"]


def test_quality_without_trust_or_rows(spark):
    docs = spark.createDataFrame([(1, " ".join(map(str, range(30)))), (2, "short")], "doc_id long, text string")
    none = spark.createDataFrame([], "text string")
    assert sorted((r["id"], r["ratio"], r["kept"]) for r in qr.quality_rules(docs, none).collect()) == [(1, 0.0, True), (2, 0.0, False)]
    assert qr.quality_rules(docs.where("false"), none).count() == 0


def test_quality_is_native(spark):
    docs = spark.createDataFrame([(1, "a b c")], "doc_id long, text string")
    plan = qr.quality_rules(docs, docs.select("text"))._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_trusted_and_held_out(spark):
    """Verdicts against labels that have not been used."""
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    got = qr.quality_rules(docs, qr.trusted_texts(docs, labels.where("doc_id % 2 = 0"))).join(labels.where("doc_id % 2 = 1"), F.col("id") == F.col("doc_id")).toPandas()
    told = got[~got["base_failed"]]
    assert told[told["quality"] == 1]["kept"].mean() > 0.99 and told[told["quality"] == 0]["kept"].mean() < 0.2
