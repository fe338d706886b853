"""Whitening, line quality and alignment of tokenizers on small tables: odd rows and brute force."""

import collections
import hashlib
import math
import random

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from ladle.llm import alignment, lines, queries, whitening
from tests.conftest import SF

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
LONG = " ".join(f"w{i % 977}" for i in range(30_000))
ODD = [(1, None), (2, ""), (3, " \t\n"), (4, LONG), (5, LONG), (6, "One two three."), (6, "One two three."), (None, "One two three four five."), (7, "!!! 123 ...\n\n!!! 123 ...\r\nx")]


@pytest.fixture
def odd(spark):
    """Odd documents, with columns whose names the operators use themselves."""
    return spark.createDataFrame(ODD, "doc_id long, text string").withColumns({c: F.lit("x") for c in ("id", "row", "score", "good", "lines", "n", "a", "b", "n_a")})


@pytest.fixture
def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string")


# 11


def exact_basis(n, seed=1):
    q = np.linalg.qr(np.random.default_rng(seed).normal(size=(n, n)))[0].astype(np.longdouble)
    for _ in range(4):
        q = q + q @ (np.eye(n) - q.T @ q) / 2
    return q


def test_eigenvectors_of_separate_and_clustered_values():
    values = np.concatenate([[5, 5 + 1e-9, 5 + 2e-9], [3, 3, 3], [2, 2 + 1e-5], np.linspace(0.1, 1, 30), [0, 0]]).astype(np.longdouble)
    q = exact_basis(len(values))
    a = (q * values) @ q.T
    found, x = whitening.eigen(a)
    order = np.argsort(-values, kind="stable")
    assert np.abs(found - values[order].astype(float)).max() < 1e-15
    wide = x.astype(np.longdouble)
    assert np.abs(wide.T @ wide - np.eye(len(values))).max() < 2e-15 and np.abs(a @ wide - wide * found).max() < 2e-15
    for k, limit in [*((k, 1e-8) for k in range(3)), (6, 1e-12), (7, 1e-12), *((k, 1e-15) for k in range(8, 38))]:
        exact = q[:, order[k]]
        assert np.abs(wide[:, k] - np.sign(wide[:, k] @ exact) * exact).max() < limit
    # equal values: the space, not the vectors
    same, own = q[:, 3:6], wide[:, 3:6]
    assert np.abs(same @ (same.T @ own) - own).max() < 2e-15
    assert np.array_equal(np.abs(whitening.eigen(np.zeros((3, 3)))[1]), np.eye(3)[:, ::-1]) or whitening.eigen(np.zeros((3, 3)))[0].tolist() == [0, 0, 0]


def test_sums_of_squares_are_exact():
    d = np.random.default_rng(3).integers(-(2**62), 2**62, (9, 7))
    assert whitening.squares(d) == [sum(int(v) ** 2 for v in row) for row in d]


def brute_whitened(vectors, k):
    x = [[math.floor(1024 * float(c)) + 100_000 for c in v] for v in vectors]
    n, d = len(x), len(x[0])
    sums = [sum(r[i] for r in x) for i in range(d)]
    far = np.array([[n * r[i] - sums[i] for i in range(d)] for r in x], float) / n
    v = far.T @ far / n
    value, vector = np.linalg.eigh(v)
    order = np.argsort(-value)[:k]
    return n, [sum((n * r[i] - sums[i]) ** 2 for i in range(d)) for r in x], far @ vector[:, order] / np.sqrt(value[order]), value[order] / value.sum()


def test_whitened_rows_equal_brute_force(spark):
    table = spark.read.parquet(f"{SF}/embeddings.parquet")
    rows = sorted((r["vec_id"], r["embedding"]) for r in table.collect())
    n, deviation, whitened, explained = brute_whitened([v for _, v in rows], 8)
    found = {}
    for r in queries.op11_whitening(spark, SF).collect():
        found.setdefault(r["vec_id"], {})[r["component"]] = r
    assert sorted(found) == [i for i, _ in rows]
    own = np.array([[found[i][c]["whitened"] for c in range(1, 9)] for i, _ in rows])
    signs = np.sign((own * whitened).sum(axis=0))
    assert np.abs(own * signs - whitened).max() < 1e-9
    for (i, _), d in zip(rows, deviation):
        assert all(r["n"] == n and r["deviation"] == d and r["identity_error"] < 1e-12 for r in found[i].values())
    assert np.allclose([found[rows[0][0]][c]["explained"] for c in range(1, 9)], explained, rtol=1e-12)


def test_whitening_odd_rows(spark):
    schema = "vec_id long, embedding array<float>, n long, id string, whitened int"
    good = [(i, [float(i % 3), float(i % 2), 1.0], 5, "x", 1) for i in range(12)] + [(3, [0.0, 0.0, 1.0], 5, "x", 1), (None, [1.0, 1.0, 1.0], None, None, None)]
    bad = [(90, None, 1, "x", 1), (91, [], 1, "x", 1), (92, [1.0, None, 2.0], 1, "x", 1), (93, [1.0, float("nan"), 2.0], 1, "x", 1), (94, [1.0, float("inf"), 2.0], 1, "x", 1), (95, [1.0, 2.0], 1, "x", 1)]
    out = whitening.whiten(spark.createDataFrame(good + bad, schema)).collect()
    assert sorted(str(r["vec_id"]) for r in out) == sorted(str(g[0]) for g in good)
    # the third entry doesn't vary
    assert all(r["n"] == 14 and r["whitened"][2] is None and None not in r["whitened"][:2] and r["explained"][2] == 0 and r["identity_error"] < 1e-12 for r in out)
    assert whitening.whiten(spark.createDataFrame(bad[:5], schema)).count() == 0
    assert whitening.whiten(spark.createDataFrame([], schema)).columns == ["vec_id", "n", "deviation", "whitened", "explained", "identity_error"]
    one = whitening.whiten(spark.createDataFrame([(1, [1e30, -1e30, 0.5], 1, "x", 1)], schema)).first()
    assert one["whitened"] == [None, None, None] and one["deviation"] == 0
    huge = whitening.whiten(spark.createDataFrame([(1, [1e30, 0.5], 1, "x", 1), (2, [-1e30, 0.5], 1, "x", 1)], schema)).collect()
    assert {int(r["deviation"]) for r in huge} == {4 * whitening.LIMIT**2} and sorted(round(r["whitened"][0]) for r in huge) == [-1, 1]


# 12


def brute_measures(t):
    out, seen = [], set()
    for line in (t or "").encode().split(b"\n"):
        w = line.lower().replace(b"\x0b", b" ").replace(b"\x0c", b" ").replace(b"\r", b" ").split()
        blanks = sum(b == 32 or 9 <= b <= 13 for b in line)
        filled, some = max(len(line) - blanks, 1), max(len(w), 1)
        upper, lower = sum(65 <= b <= 90 for b in line), sum(97 <= b <= 122 or b >= 128 for b in line)
        count = lambda own: sum(b in own for b in line)
        digits, symbols, exclaims, bars, stops = count(b"0123456789"), count(b"#*$%&<>{}[]=+/\\^~_@"), count(b"!?"), count(b"|"), count(b".,")
        other = len(line) - blanks - upper - lower - digits - symbols - exclaims - bars - stops
        out.append([math.log1p(len(line)), math.log1p(len(w)), min(filled / some, 40), (upper + lower) / filled, upper / filled, digits / filled, symbols / filled, exclaims / filled, bars / filled, stops / filled, other / filled, (len(w) - len(set(w))) / some, sum(x == y for x, y in zip(w, w[1:])) / some, sum(len(x) <= 4 for x in w) / some, bool(line) and line[-1] in b".!?\"')", bool(w) and tuple(w) in seen, not w])
        seen.add(tuple(w))
    return np.array(out, np.float32)


def test_measures_equal_brute_force(spark):
    texts = [r[0] for r in spark.read.parquet(f"{SF}/documents.parquet").select("text").collect()] + [t for _, t in ODD] + ["a\nA\n\nb\n a \n", "\n", "É é!?\nx | y | x"]
    found = []
    for first, x, to, length in lines.measure(pa.array(texts)):
        assert first == len(found)
        found += np.split(x, to[:-1])
    assert len(found) == len(texts)
    for t, own in zip(texts, found):
        assert own.shape == brute_measures(t).shape and np.allclose(own, brute_measures(t), atol=1e-5), t


def test_passes_equal_sums_over_all_labellings():
    import itertools

    rng = np.random.default_rng(5)
    sizes = [1, 4, 2, 5, 1, 3]
    to, evidence, pairs = np.cumsum(sizes), rng.normal(size=sum(sizes)), rng.normal(size=(2, 2))
    odds, joint, norm = lines._passes(evidence, to, pairs)
    all_joint, at = np.zeros((2, 2)), 0
    for d, size in enumerate(sizes):
        weight = {y: math.exp(sum(evidence[at + k] for k in range(size) if y[k]) + sum(pairs[y[k], y[k + 1]] for k in range(size - 1))) for y in itertools.product((0, 1), repeat=size)}
        total = sum(weight.values())
        assert math.isclose(norm[d], math.log(total))
        for k in range(size):
            chance = sum(w for y, w in weight.items() if y[k]) / total
            assert math.isclose(odds[at + k], math.log(chance / (1 - chance)), rel_tol=1e-9, abs_tol=1e-9)
        for y, w in weight.items():
            for p, q in zip(y, y[1:]):
                all_joint[p, q] += w / total
        at += size
    assert np.allclose(joint, all_joint)


def test_fit_follows_its_gradient():
    rng = np.random.default_rng(6)
    to = np.cumsum([3, 1, 2, 4] * 20)
    good = rng.integers(0, 2, len(to))
    x = rng.normal(size=(int(to[-1]), len(lines.MEASURES))) + np.repeat(good, np.diff(np.append(0, to)))[:, None]
    field = lines.fit(x, to, good)
    assert ((lines.chances(field, x, to)[to - 1] > 0.5) == good.astype(bool)).mean() > 0.95
    p = lines.descend(lambda v: (float(((v - 3) ** 2).sum()), 2 * (v - 3)), np.zeros(4))
    assert np.allclose(p, 3, atol=1e-3)


def test_line_quality_on_held_out_documents(spark):
    """sf0.01: labels of a fifth of the documents are never learned from."""
    sf = "/root/testdata/sf0.01"
    out = queries.op12_lines(spark, sf)
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    rows = out.join(labels, "doc_id").where("held_out").collect()
    assert len(rows) > 50 and np.mean([r["predicted"] == r["quality"] for r in rows]) > 0.97
    assert out.count() == 1000 and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in out.collect())
    turned = labels.withColumn("quality", F.when(lines.held_out(), 1 - F.col("quality")).otherwise(F.col("quality")))
    documents = spark.read.parquet(f"{sf}/documents.parquet")
    again = lines.judge(documents, lines.learn(documents, turned.where(~lines.held_out())))
    assert {(r["doc_id"], r["score"]) for r in again.collect()} == {(r["doc_id"], r["score"]) for r in out.collect()}


def test_line_quality_odd_rows(spark, odd, empty):
    labels = spark.createDataFrame([(1, 0), (2, 1), (4, 1), (5, None), (None, 1), (6, 0), (6, 1), (6, 1), (77, 0)], "doc_id long, quality int").withColumn("text", F.lit("t"))
    field = lines.learn(odd, labels)
    found = lines.judge(odd, field).collect()
    assert sorted(str(r["doc_id"]) for r in found) == sorted(str(i) for i, _ in ODD)
    by_id = {r["doc_id"]: r for r in found}
    assert by_id[1]["n_lines"] == by_id[2]["n_lines"] == 1 and by_id[1]["score"] == by_id[2]["score"] and by_id[7]["n_lines"] == 4 and len(by_id[7]["lines"]) == 4
    assert by_id[4]["score"] == by_id[5]["score"] and all(0 <= r["score"] <= 1 for r in found)
    assert lines.judge(empty, field).count() == 0
    none = lines.learn(empty, labels)
    assert {r["score"] for r in lines.judge(odd, none).collect()} == {0.5}


# 13


def brute_tokens(own, t):
    """(A ids, B ids, groups as text, links) of one text."""
    raw = (" " + t).encode()
    a, b = own.a.encode(" " + t, add_special_tokens=False).ids, own.b.encode(t)
    if not t or b"".join(own.a_bytes[i] for i in a) != raw or b"".join(own.b_bytes[i] for i in b) != raw:
        return [], [], "", []
    spans = []
    for ids, table in ((a, own.a_bytes), (b, own.b_bytes)):
        ends = np.cumsum([len(table[i]) for i in ids]).tolist()
        spans.append(list(zip([0, *ends], ends)))
    links, at = [], 0
    for i, (p, q) in zip(a, spans[0]):
        while spans[1][at][1] <= p:
            at += 1
        k = at
        while k < len(b) and spans[1][k][0] < q:
            links.append((i, b[k]))
            k += 1
    cuts = sorted({e for _, e in spans[0]} & {e for _, e in spans[1]})
    groups, p = [], 0
    i = j = 0
    for cut in cuts:
        x, y = [], []
        while i < len(a) and spans[0][i][1] <= cut:
            x.append(str(a[i]))
            i += 1
        while j < len(b) and spans[1][j][1] <= cut:
            y.append(str(b[j]))
            j += 1
        groups.append(",".join(x) + "|" + ",".join(y))
    return a, b, ";".join(groups), links


def brute_alignment(own, docs):
    each = [brute_tokens(own, t or "") for _, t in docs]
    count = collections.Counter(link for *_, links in each for link in links)
    best = collections.Counter()
    for (_, b), n in count.items():
        best[b] = max(best[b], n)
    return [
        (i, len(a), len(b), groups.count("|") if groups else 0, len(links), sum(count[x] == best[x[1]] for x in links), sum(count[x] for x in links), hashlib.sha256(groups.encode()).hexdigest() if groups else "")
        for (i, _), (a, b, groups, links) in zip(docs, each)
    ], count


@pytest.fixture(scope="module")
def aligner():
    return alignment.Aligner(A, B)


@pytest.mark.parametrize("hot", [alignment.HOT_PAIRS, 40, 0])
def test_alignment_equals_brute_force(spark, monkeypatch, aligner, hot):
    monkeypatch.setattr(alignment, "HOT_PAIRS", hot)
    docs = [(r[0], r[1]) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").orderBy("doc_id").collect()] + ODD
    found, pairs = alignment.align(spark.createDataFrame(docs, "doc_id long, text string").repartition(5), A, B)
    expected, count = brute_alignment(aligner, docs)
    rows = [tuple(r[c] for c in ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")) for r in found.collect()]
    assert sorted(rows, key=repr) == sorted(expected, key=repr)
    assert {(r["a"], r["b"]): r["n"] for r in pairs.collect()} == count


def odd_texts():
    rng = random.Random(2)
    bits = [" ", " ", "\n", "a", "the", "é", "ing", "'s", "1", "23", "$", "▁", "\t", "日", "\x1c", "\x85", "　", "😀"]
    some = ["a", "a ", "  a  b ", "\n a\n\nb\t c", "▁x y", "é ö é x", "don't we'll  x's", "<|endoftext|> <s> </s>", "\x00 a\x1c b", " ", "\n", "ＡＢ ﬁ", "x" * 2_000 + " y " * 50, "a​ b ﻿ c", "!" * 700]
    return some + ["".join(rng.choice(bits) for _ in range(rng.randint(1, 25))) for _ in range(500)]


@pytest.mark.parametrize("fast", [True, False])
def test_units_give_the_tokens_of_whole_texts(monkeypatch, fast):
    own = alignment.Aligner(A, B)
    assert own.by_units and own.fast is not None
    if not fast:
        own.fast = None
    monkeypatch.setattr(alignment, "CACHE_UNITS", 100)
    texts = odd_texts()
    for at in range(0, len(texts), 40):
        for t, (groups, data) in zip(texts[at : at + 40], own.texts(texts[at : at + 40])):
            a, b, expected, links = brute_tokens(own, t)
            packed = np.frombuffer(data, np.uint64)
            assert groups == expected, t
            assert (int(((packed & alignment.NEW_A) != 0).sum()), int(((packed & alignment.NEW_B) != 0).sum())) == (len(a), len(b))
            assert collections.Counter((int(x) >> 32, int(x) & 0xFFFFFFFF) for x in packed & alignment._IDS) == collections.Counter(links)
            for x in packed[(packed & alignment.IRREGULAR) == 0] & alignment._IDS:
                assert own.same[int(x) >> 32] == int(x) & 0xFFFFFFFF
    own.by_units = False
    assert [x[0] for x in own.texts(texts)] == [brute_tokens(own, t)[2] for t in texts]


def test_pair_counts_are_merged(monkeypatch):
    monkeypatch.setattr(alignment, "TASK_PAIRS", 10)
    rng, pairs, total = np.random.default_rng(4), alignment._Pairs(), collections.Counter()
    for _ in range(30):
        keys = rng.integers(0, 50, 7).astype(np.uint64)
        total.update(keys.tolist())
        pairs.add(keys)
    keys, counts = pairs.take()
    assert dict(zip(keys.tolist(), counts.tolist())) == total and not len(pairs.take()[0])


def test_alignment_odd_rows(spark, odd, empty):
    found, pairs = alignment.align(odd, A, B)
    rows = {r["doc_id"]: r for r in found.collect()}
    assert found.count() == len(ODD) and None in rows and rows[1]["groups_sha256"] == rows[2]["groups_sha256"] == "" and rows[1]["n_links"] == 0
    assert rows[4]["groups_sha256"] == rows[5]["groups_sha256"] and rows[4]["count_sum"] == rows[5]["count_sum"] > 0
    assert alignment.align(empty, A, B)[0].count() == 0
    assert pairs.agg(F.sum("n")).first()[0] == found.agg(F.sum("n_links")).first()[0]
