"""The training-data operators on small tables: odd rows, brute force, round trips."""

import collections
import hashlib
import math
import re
import time
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from ladle.llm import graph, language, licences, minhash, mixing, quality, sstable, storage, suffix, text, tiling, tokens, warc
from tests.conftest import SF

WORDS = public_tokenizers.path("word_bpe_49k.json")
RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
LONG = " ".join(f"w{i % 977}" for i in range(30_000))
#: Nulls, empty and long texts, ties and repeated rows.
ODD = [(1, None, "en", "s"), (2, "", "en", None), (3, " \t\n", None, "s"), (4, LONG, "en", "s"), (5, LONG, "en", "s"), (6, "One two three.", "fr", "t"), (6, "One two three.", "fr", "t"), (None, "One two three four five six seven eight.", "de", "t"), (7, "!!! 123 ...", "en", "t")]
SCHEMA = "doc_id long, text string, lang string, source string"


@pytest.fixture
def odd(spark):
    """Odd documents, with columns whose names the operators use themselves."""
    return spark.createDataFrame(ODD, SCHEMA).withColumns({"kept": F.lit("x"), "size": F.lit(1), "rank": F.lit(1), "id": F.lit("i"), "row": F.lit(2)})


@pytest.fixture
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def documents(spark, n=None):
    return [(r["doc_id"], r["text"] or "") for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").orderBy("doc_id").collect()][:n]


def word_list(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


# Words


def test_words_do_not_cross_documents():
    import pyarrow as pa

    texts = ["ab cd", "ef", None, "", "gh\x0bij  ", "é x"]
    chunks = list(text.chunks(pa.array(texts)))
    found = [[c.buf[c.start[k] : c.end[k]].tobytes().decode() for k in range(c.word_from[d], c.word_from[d + 1])] for c in chunks for d in c.docs]
    assert found == [word_list(t) for t in texts]
    small = [h for c in text.chunks(pa.array(texts), size=1) for h in c.hash.tolist()]
    assert small == [h for c in chunks for h in c.hash.tolist()]


@pytest.mark.parametrize("split_from", [graph.SPLIT_FROM, 0])
def test_components(spark, monkeypatch, split_from):
    monkeypatch.setattr(graph, "SPLIT_FROM", split_from)
    monkeypatch.setattr(storage, "HOT_SHARE", 10)
    edges = [(i, i + 1) for i in range(10, 30)] + [(1_000, k) for k in range(1_001, 1_040)] + [(100, 101), (101, 102), (5, 5), (None, 3)]
    found = dict(map(tuple, graph.components(spark.createDataFrame(edges, "a long, b long")).collect()))
    assert found == {**dict.fromkeys(range(10, 31), 10), **dict.fromkeys(range(1_000, 1_040), 1_000), 100: 100, 101: 100, 102: 100}
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


# 1


def brute_components(docs, per_cent=85):
    sets = {}
    for i, t in docs:
        w = t.encode().lower().split()
        sets.setdefault(i, []).append(frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else []))
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[:n]:
            if any(x and y and 100 * len(x & y) >= per_cent * len(x | y) for x in sets[a] for y in sets[b]):
                p, q = find(a), find(b)
                root[max(p, q)] = min(p, q)
    return {i: find(i) for i in ids}


def test_near_duplicates_equal_brute_force(spark):
    base = [f"t{i}" for i in range(60)]
    docs = documents(spark)
    docs += [(10_000 + k, " ".join(base[:k] + [f"x{k}"] + base[k + 1 :])) for k in range(0, 60, 3)] + [(20_000, " ".join(base)), (20_001, " ".join(base).upper())]
    out = minhash.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert {r["doc_id"]: r["component_id"] for r in out} == brute_components(docs)
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in out)


def test_clusters_of_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(minhash, "BLOCK_DOCS", 8)
    monkeypatch.setattr(minhash, "BROADCAST_IDS", 0)
    base = [f"t{i}" for i in range(80)]
    docs = [(k, " ".join(base[:k] + [f"x{k}"] + base[k + 1 :])) for k in range(70)]
    out = minhash.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert {r["doc_id"]: r["component_id"] for r in out} == brute_components(docs)


def test_near_duplicates_odd_rows(odd, empty):
    out = {(r["doc_id"], r["n_shingles"]): (r["component_id"], r["kept"]) for r in minhash.near_duplicates(odd).collect()}
    assert out[1, 0] == (1, True) and out[5, 977][0] == 4 and not out[5, 977][1] and out[6, 1] == (6, True) and out[None, 4] == (None, True)
    assert minhash.near_duplicates(odd).count() == len(ODD)
    assert minhash.near_duplicates(empty).count() == 0


# 2


def test_shards_hold_what_the_tokenizer_gives(spark, tmp_path):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(WORDS)
    extra = [(9_001, "A<|endoftext|>B <|ENDOFTEXT|> don't, été. ΣΟΦΟΣ x\x1cy ...?! a.b, ﬁ"), (9_002, "")]
    docs = documents(spark, 60) + extra
    manifest = sstable.write_shards(spark.createDataFrame(docs, "doc_id long, text string").repartition(3), WORDS, f"file://{tmp_path}/shards")
    found = {r["id"]: r for r in sstable.read_shards(manifest).collect()}
    start = 0
    for i, t in docs:
        ids = [*tokenizer.encode(t, add_special_tokens=False).ids, 2]
        assert (found[i]["start"], found[i]["n_tokens"], np.frombuffer(found[i]["ids"], "<u4").tolist()) == (start, len(ids), ids)
        start += len(ids)
    wanted = spark.createDataFrame([(docs[3][0],), (9_002,), (123_456,), (None,)], "doc_id long")
    assert {r["id"]: bytes(r["ids"]) for r in sstable.lookup(manifest, wanted).collect()} == {i: bytes(found[i]["ids"]) for i in (docs[3][0], 9_002)}


def test_shard_lookup_and_damage(tmp_path):
    path = tmp_path / "s.sst"
    with open(path, "wb") as out:
        writer = sstable.ShardWriter(out, 2)
        for i in [None, *range(-500, 5000, 3), 5000, 5000]:
            writer.add(sstable.key_of(i), np.arange(abs(i or 0) % 90, dtype="<u2").tobytes())
        assert writer.close()[0] == 1837
    shard = sstable.ShardReader(open(path, "rb"))
    assert shard.n_blocks > 1 and [sstable.id_of(k) for k, _ in shard][:2] == [None, -500]
    assert all(len(shard.get(sstable.key_of(i))) == (i % 3 == 1) for i in range(0, 4900))
    assert len(shard.get(sstable.key_of(5000))) == 2 and len(shard.get(b"")) == 1
    data = bytearray(path.read_bytes())
    data[40] ^= 1
    path.write_bytes(data)
    with pytest.raises(ValueError):
        list(sstable.ShardReader(open(path, "rb")))


@pytest.mark.parametrize("limit", [sstable.BROADCAST_SHARDS, 0])
def test_lookup_searches_ranges(spark, monkeypatch, limit):
    monkeypatch.setattr(sstable, "BROADCAST_SHARDS", limit)
    docs = [(i, f"text {i}") for i in range(-50, 200, 2)] + [(100, "again"), (None, "no id")]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        manifest = sstable.write_shards(spark.createDataFrame(docs, "doc_id long, text string"), WORDS)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert manifest.count() > 1
    found = sstable.lookup(manifest, spark.createDataFrame([(i,) for i in (*range(-60, 230), None, 100)], "doc_id long"))
    assert sorted(r["id"] for r in found.collect()) == sorted([*range(-50, 200, 2), 100])
    assert ("NestedLoop" in found._jdf.queryExecution().toString()) == (limit == 0)


def test_shards_of_odd_rows(odd, empty):
    manifest = sstable.write_shards(odd, WORDS)
    rows = sstable.read_shards(manifest).orderBy("start").collect()
    assert [r["id"] for r in rows] == [None, 1, 2, 3, 4, 5, 6, 6, 7] and [r["n_tokens"] for r in rows[1:4]] == [1, 1, 1]
    assert sstable.read_shards(sstable.write_shards(empty, WORDS)).count() == 0
    assert sstable.lookup(sstable.write_shards(empty, WORDS), odd).count() == 0 and sstable.lookup(manifest, empty).count() == 0


def test_word_memory_is_renewed(monkeypatch):
    monkeypatch.setattr(tokens, "CACHE_WORDS", 5)
    encoder = tokens.WordEncoder(WORDS)
    for _ in range(3):
        for t in (b"one two, three. four", b"five six seven eight nine ten", b"one eleven"):
            w = encoder.words(t)
            known = encoder.ids([w])
            assert np.frombuffer(b"".join(known[x] for x in w), "<u2").tolist() == encoder.tokenizer.encode(t.decode(), add_special_tokens=False).ids


def test_workers_forget_the_encoder_if_told(spark, tmp_path):
    """The pipeline's workers serve all its stages, so that words kept of one would take memory of the next."""

    def kept(batches):
        import pyarrow as pa

        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([tokens.word_encoder.cache_info().currsize] * batch.num_rows, pa.int64())], ["n"])

    docs = spark.createDataFrame([(i, f"word{i} and more") for i in range(64)], "doc_id long, text string")
    own = [sstable.read_shards(sstable.write_shards(docs, WORDS, **how)).orderBy("id").collect() for how in ({}, {"cache_words": 3, "keep": False})]
    assert own[0] == own[1]
    fresh = tokens.WordEncoder(WORDS, cache_words=3)
    for t in (b"a b c d", b"e f g h", b"i j"):
        fresh.ids([fresh.words(t)])
    assert set(fresh.recent) == {b"i", b"j"} and len(fresh.older) == 4
    written = sstable._write(f"file://{tmp_path}/shards", WORDS, 2, 2, None, False)

    def write_and_look(batches):
        list(written(batches))
        import pyarrow as pa

        yield from kept([pa.RecordBatch.from_arrays([pa.array([0])], ["x"])])

    assert [r["n"] for r in docs.repartition(2).mapInArrow(write_and_look, "n long").collect()] == [0, 0]


# 3


def test_tiles_are_greedy_and_find_reordered_passages():
    a = np.arange(1, 41, dtype=np.uint64)
    moved = np.concatenate([a[20:], np.array([0, 99], dtype=np.uint64), a[:20]])
    assert sorted(tiling.tiles(a, moved, 5)) == [(20, 0, 22), (20, 20, 0)]
    assert tiling.tiles(a, a[3:7], 5) == []
    assert tiling.tiles(a[:8], np.concatenate([a[:8], np.array([0], dtype=np.uint64), a[:8]]), 5) == [(8, 0, 0)]
    assert tiling.tiles(a, np.concatenate([[np.uint64(7777)] * 3, a]).astype(np.uint64), 5) == [(40, 0, 3)]


def brute_coverage(item, words_):
    """Greedy tiling by trying all pairs of places."""
    a, b = re.findall(r"[a-z0-9\x80-\U0010ffff]+", item.lower()), re.findall(r"[a-z0-9\x80-\U0010ffff]+", words_.lower())
    marked_a, marked_b, covered = [False] * len(a), [False] * len(b), 0
    if len(a) < 5:
        return 0.0
    while True:
        best = (0, 0, 0)
        for i in range(len(a)):
            for j in range(len(b)):
                k = 0
                while i + k < len(a) and j + k < len(b) and a[i + k] == b[j + k] and not marked_a[i + k] and not marked_b[j + k]:
                    k += 1
                if k > best[0]:
                    best = (k, i, j)
        k, i, j = best
        if k < 5:
            return covered / len(a)
        covered += k
        marked_a[i : i + k], marked_b[j : j + k] = [True] * k, [True] * k


@pytest.mark.parametrize("limit", [tiling.BROADCAST_SEEDS, 0])
def test_leaks_equal_brute_force(spark, limit):
    items = [(1, "the quick brown fox jumps over the lazy dog near the old stone bridge"), (2, "five words are quite enough"), (3, "too short"), (None, "an item without an id is not judged here"), (4, "a b c d e f g h i j a b c d e f g h i j")]
    docs = [
        (1, "Near the old stone bridge, indeed! " + "x " * 30 + "THE quick brown fox jumps over the lazy dog"), (2, "the quick brown fox jumps over a dog"), (3, "so five words are quite enough then"), (4, "too short"), (5, "a b c d e f g h i j"), (6, "a b c d e z f g h i j"), (7, None),
    ]
    out = {r["doc_id"]: r for r in tiling.find_leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), broadcast_seeds=limit).collect()}
    for i, t in docs:
        shares = {k: brute_coverage(x, t or "") for k, x in items if k is not None}
        hits = sorted(k for k, s in shares.items() if s >= 0.5)
        assert (out[i]["item_ids"], out[i]["contaminated"]) == (hits, bool(hits)), i
        assert not hits or out[i]["coverage"] == pytest.approx(max(shares.values()))


def test_leaks_odd_rows(spark, odd, empty):
    items = spark.createDataFrame([(1, None), (2, "one two three four five six seven eight")], "item_id long, text string")
    assert [r["doc_id"] for r in tiling.find_leaks(odd, items).where("contaminated").collect()] == [None]
    assert tiling.find_leaks(empty, items).count() == 0
    assert tiling.find_leaks(odd, items.where("false")).where("kept").count() == len(ODD)


# 4


def brute_targets(sizes, weights=(3, 1, 2), share=1.5, most=2.0):
    order = sorted(sizes, key=lambda s: (s is None, s))
    w = {s: weights[k % 3] for k, s in enumerate(order)}
    left, open_, out = share * sum(sizes.values()), set(order), {}
    while open_:
        total = sum(w[s] for s in open_)
        over = [s for s in open_ if left * w[s] / total > most * sizes[s]]
        if not over:
            out |= {s: left * w[s] / total for s in open_}
            break
        for s in over:
            out[s] = most * sizes[s]
            open_.discard(s)
        left = share * sum(sizes.values()) - sum(out.values())
    return out


def test_mix_meets_its_targets(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").withColumn("source", F.when(F.col("doc_id") % 3 == 0, "hot").when(F.col("doc_id") % 11 != 0, F.col("source")))
    rows = mixing.mix_sources(docs).join(docs.select("doc_id", "source", "text"), "doc_id").collect()
    sizes = collections.Counter()
    taken = collections.Counter()
    for r in rows:
        assert r["size"] == len(word_list(r["text"])) and 0 <= r["taken"] <= 2 * r["size"] and r["taken"] == r["copies"] * r["size"]
        sizes[r["source"]] += r["size"]
        taken[r["source"]] += r["taken"]
    targets = brute_targets(sizes)
    for r in rows:
        assert r["source_size"] == sizes[r["source"]] and r["target"] == pytest.approx(targets[r["source"]])
    assert all(abs(taken[s] - targets[s]) <= max(0.02 * targets[s], 100) for s in targets)
    again = {r["doc_id"]: r["taken"] for r in mixing.mix_sources(docs.repartition(7)).collect()}
    assert again == {r["doc_id"]: r["taken"] for r in rows}


def test_certain_copies_and_odd_rows(spark, odd, empty):
    rows = mixing.mix_sources(odd).collect()
    assert len(rows) == len(ODD) and all(r["taken"] == 0 for r in rows if r["size"] == 0)
    assert mixing.mix_sources(empty).count() == 0
    one = spark.createDataFrame([(k, "a b c", "en", "s") for k in range(10)], SCHEMA)
    copies = [r["copies"] for r in mixing.mix_sources(one).collect()]
    assert sorted(copies) == [1] * 5 + [2] * 5


# 5


@pytest.mark.parametrize("rule", tokens.RULES)
def test_attribution_equals_brute_force(spark, rule):
    encode, lengths = tokens._byte_encoder(RANKS, public_tokenizers.PATTERN)
    docs = documents(spark, 20) + [(900, "a\n\nb\n"), (901, ""), (902, "\n \n\n  x")]
    out = {r["doc_id"]: r for r in tokens.attribute_tokens(spark.createDataFrame(docs, "doc_id long, text string"), RANKS, public_tokenizers.PATTERN, rule=rule).collect()}
    for i, t in docs:
        ids, raw = encode(t), t.encode()
        part = np.cumsum([0] + [b == 10 for b in raw[:-1]]) if raw else []
        counts, at, crossing = collections.Counter(), 0, 0
        for x in ids:
            own = [int(part[k]) for k in range(at, at + int(lengths[x]))]
            at += int(lengths[x])
            crossing += own[0] != own[-1]
            counts[own[0] if rule == "first" else own[-1] if rule == "last" else min(set(own), key=lambda p: (-own.count(p), p))] += 1
        assert out[i]["n_tokens"] == len(ids) and out[i]["n_crossing"] == crossing
        assert {k: n for k, n in enumerate(out[i]["section_tokens"]) if n} == dict(counts)
        assert sum(out[i]["section_bytes"]) == len(raw)


def test_attribution_of_fields_and_odd_rows(spark, odd, empty):
    df = spark.createDataFrame([(1, "a title", "some\ntext"), (2, None, None)], "doc_id long, title string, text string")
    out = {r["doc_id"]: r for r in tokens.attribute_tokens(df, RANKS, public_tokenizers.PATTERN, fields=("title", "text")).collect()}
    assert sum(out[1]["field_tokens"]) == out[1]["n_tokens"] and len(out[1]["field_tokens"]) == 2 and len(out[1]["section_tokens"]) == 3
    assert tokens.attribute_tokens(odd, RANKS, public_tokenizers.PATTERN).count() == len(ODD)
    assert tokens.attribute_tokens(empty, RANKS, public_tokenizers.PATTERN).count() == 0


# 6


def test_quality_counts_equal_brute_force(spark):
    docs = documents(spark) + [(900, "a b c d e a b c d e f"), (901, "x x x x x x x x x x"), (902, "l one\n\nl one\n \n \nl one")]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("lang", F.lit("en"))
    out = {r["doc_id"]: r for r in quality.judge(df).collect()}
    for i, t in docs:
        w, lines = word_list(t), [x for x in t.split("\n") if word_list(x)]
        windows = collections.Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4))
        covered = {k + j for k in range(len(w) - 4) if windows[tuple(w[k : k + 5])] > 1 for j in range(5)}
        r = out[i]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered))
        assert r["base_failed"] == (len(w) < 10 or 100 * len(covered) > 20 * len(w)) and not (r["base_failed"] and r["kept"])


def test_distance_and_verdict(spark):
    p, q = [0.5, 0.5, 0.0], [0.25, 0.25, 0.5]
    m = [(a + b) / 2 for a, b in zip(p, q)]
    expected = math.sqrt(sum(a * math.log2(a / c) for x in (p, q) for a, c in zip(x, m) if a) / 2)
    df = spark.range(1).select(F.array(*map(F.lit, p)).alias("p"), F.array(*map(F.lit, q)).alias("q"))
    assert df.select(quality.js_distance(F.col("p"), F.col("q"))).first()[0] == pytest.approx(expected)
    common = ["the", "of", "and", "to", "in", "a", "is", "that"]
    good = [(k, " ".join(common[(j * j + k) % 8] if j % 2 else f"word{k}x{j}" for j in range(120)) + ".", "en") for k in range(40)]
    rows = {r["doc_id"]: r["kept"] for r in quality.judge(spark.createDataFrame([*good, (99, " ".join(f"#{k}%%%$$$" for k in range(200)), "en"), (98, "short one two three four five six seven eight nine ten eleven", None)], "doc_id long, text string, lang string")).collect()}
    assert not rows[99] and rows[98]


def test_quality_odd_rows(odd, empty):
    assert quality.judge(odd).count() == len(ODD)
    assert quality.judge(empty).count() == 0


# 7


def test_licences(spark, odd, empty):
    model = licences.train(spark.read.parquet(f"{SF}/documents.parquet"))
    texts = [("mit", "Some words here.\nReleased under the MIT License."), ("gpl", "This work is licensed under the GNU General Public License, version 3."), ("cc-by-nc", "Licensed under CC BY-NC 4.0."), (None, "A licence is needed to drive.\nThe copyright page is missing."), (None, "Licensed under the Foo Bar terms 7.")]
    texts += [("apache", "Fine text.\n\nThis code is made available under the Apache License, Version 2.0, as it is.")]
    out = [r["licence"] for r in licences.scan(spark.createDataFrame(list(enumerate(t for _, t in texts)), "doc_id long, text string"), model).orderBy("doc_id").collect()]
    assert out == [f for f, _ in texts]
    assert licences.scan(odd, model).count() == len(ODD) and licences.scan(empty, model).count() == 0
    assert licences.LEAST <= licences.train(empty).threshold < 1
    assert all(re.search(licences.CUE, t) for ts in licences.TEMPLATES.values() for t in ts)


# 8


def test_language_accuracy_on_held_out_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    dictionaries = language.learn(docs.where(language.fold() != 1))
    assert set(dictionaries) == {"de", "en", "es", "fr"} and max(map(len, dictionaries.values())) <= language.DICTIONARY_BYTES
    held = docs.where(language.fold() == 1)
    rows = language.identify(held, dictionaries).join(held.select("doc_id", "lang"), "doc_id").collect()
    assert sum(r["lang_pred"] == r["lang"] for r in rows) >= 0.97 * len(rows)
    assert all(0 <= r["score"] <= 1 for r in rows) and sum(r["rejected"] for r in rows) <= 0.03 * len(rows)


def test_languages_equal_a_plain_loop(spark):
    import zstandard

    df = spark.read.parquet(f"{SF}/documents.parquet")
    dictionaries = language.learn(df.where(language.fold() != 1))
    found = {r["doc_id"]: r for r in language.identify(df, dictionaries).collect()}
    for i, t in documents(spark):
        low = re.sub("[^a-z\u0080-\U0010ffff]+", " ", t.lower()).strip(" ").encode()
        sizes = {}
        for lang, content in dictionaries.items():
            sizes[lang] = 0
            for at in range(0, len(low), 1024):
                # another compressor for every block: nothing is carried over
                made = zstandard.ZstdCompressor(level=12, dict_data=zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT), write_content_size=False, write_dict_id=False)
                sizes[lang] += len(made.compress(low[at : at + 1024]))
        best, second = sorted(sizes.values())[:2]
        r = found[i]
        if not any(c.isalpha() for c in t):
            assert (r["lang_pred"], r["score"], r["rejected"]) == ("und", 0, True)
        else:
            assert r["lang_pred"] == min(k for k, v in sizes.items() if v == best) and r["score"] == pytest.approx(1 - best / second) and r["rejected"] == (second / best - 1 < 0.005)


def test_language_odd_rows(spark, odd, empty):
    dictionaries = language.learn(odd)
    out = [(r["lang_pred"], r["rejected"]) for r in language.identify(odd, dictionaries).collect()]
    assert out.count(("und", True)) == 4
    assert language.identify(empty, dictionaries).count() == 0
    assert language.learn(empty) == {} and {r["lang_pred"] for r in language.identify(odd, {}).collect()} == {"und"}
    assert {r["score"] for r in language.identify(odd, {"en": b"the of and"}).where("lang_pred = 'en'").collect()} == {1.0}


# 9


def test_warc_round_trip(spark):
    rows = [(3, "http://a/\r\nX: y", "<p>é</p>"), (1, None, "<p>é</p>"), (2, "http://b", None), (5, "http://c", ""), (4, "http://d", "<p>other</p>"), (4, "http://d", "<p>other</p>"), (None, "http://e", "<p>é</p>"), (None, "http://f", "only")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("record_id", F.lit(1))
    records = warc.read_warc(warc.write_warc(pages))
    assert records.groupBy("type").count().where("type in ('request', 'metadata')").agg(F.sum("count")).first()[0] == 2 * len(rows)
    out = warc.with_referred(warc.assemble(records)).collect()
    got = sorted(((r["page_id"] or 0, r["record_type"], r["refers_to_page"] or 0, r["payload_bytes"], bytes(r["payload"] or b"").decode()) for r in out))
    assert got == sorted([(3, "revisit", 1, 9, ""), (1, "response", 0, 9, "<p>é</p>"), (2, "response", 0, 0, ""), (5, "revisit", 2, 0, ""), (4, "response", 0, 12, "<p>other</p>"), (4, "response", 0, 12, "<p>other</p>"), (0, "revisit", 1, 9, ""), (0, "response", 0, 4, "only")])
    assert all(r["request"] is not None and r["metadata"] is not None for r in out)
    small = warc.with_referred(warc.assemble(warc.read_warc(warc.write_warc(pages, min_payload_bytes=13))))
    assert small.where("record_type = 'revisit'").count() == 0
    assert warc.assemble(warc.read_warc(warc.write_warc(pages.where("false")))).count() == 0


def test_warc_with_digests_that_are_not_broadcast(spark, monkeypatch):
    """Two thirds of the pages are one template; it stays where it is, other repeats are dealt out."""
    monkeypatch.setattr(warc, "BROADCAST_DIGESTS", 0)
    monkeypatch.setattr(storage, "HOT_SHARE", 10)
    rows = [(i, f"http://a/{i}", "<p>same</p>" if i % 3 else f"<p>{i // 12}</p>" if i % 2 else None) for i in range(60)] + [(None, "http://x", "alone"), (7, "http://y", "<p>same</p>")]
    first = {}
    for i, _, h in rows:
        if i is not None:
            first[h or ""] = min(first.get(h or "", i), i)
    out = warc.with_referred(warc.assemble(warc.read_warc(warc.write_warc(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(5)), with_payload=False))).collect()
    expected = [(i, "response" if i is None or first[h or ""] == i else "revisit", None if i is None or first[h or ""] == i else first[h or ""]) for i, _, h in rows]
    assert sorted(((r["page_id"], r["record_type"], r["refers_to_page"]) for r in out), key=repr) == sorted(expected, key=repr)


def test_assembly_of_links_in_either_direction(spark):
    head = "record_id string, type string, concurrent_to string, refers_to string, target_uri string, date string, payload_digest string, payload_bytes long, fields map<string,string>, payload binary"
    rec = lambda i, kind, to=None: (i, kind, to, None, "u", None, None, 0, None, None)
    df = spark.createDataFrame([rec("r1", "response"), rec("q1", "request", "r1"), rec("r2", "response", "q2"), rec("q2", "request"), rec("m2", "metadata", "r2"), rec("q9", "request", "gone"), rec("w", "warcinfo")], head)
    out = {r["record_id"]: (r["request"] and r["request"]["record_id"], r["metadata"] and r["metadata"]["record_id"]) for r in warc.assemble(df).collect()}
    assert out == {"r1": ("q1", None), "r2": ("q2", "m2")}


# 10


def brute_removal(docs, window=13):
    first = {}
    for i, t in docs:
        w = word_list(t)
        for k in range(len(w) - window + 1):
            g = tuple(w[k : k + window])
            if i is not None:
                first[g] = min(first.get(g, i), i)
    out = []
    for i, t in docs:
        w = word_list(t)
        gone = {k + j for k in range(len(w) - window + 1) for j in range(window) if i is not None and first[tuple(w[k : k + window])] < i}
        left = " ".join(x for k, x in enumerate(w) if k not in gone)
        out.append((i, len(w), len(gone), hashlib.sha256(left.encode()).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize("leaves", [suffix.GROUP_LEAVES, 25, 3, 0])
def test_repeats_equal_brute_force(spark, leaves):
    passage = " ".join(f"p{i}" for i in range(40))
    docs = documents(spark) + [(5000 + k, f"{'y' * k} {passage} z{k}") for k in range(6)] + [(6000, passage), (6000, passage + " tail"), (None, passage)]
    out = suffix.without_repeats(spark.createDataFrame(docs, "doc_id long, text string").repartition(3), group_leaves=leaves).collect()
    assert sorted(map(tuple, out), key=repr) == brute_removal(docs)


def test_repeats_odd_rows(odd, empty):
    out = suffix.without_repeats(odd, with_text=True)
    rows = sorted(map(tuple, out.collect()), key=repr)
    assert len(rows) == len(ODD) and (5, 30_000, 30_000, "") in rows and (1, 0, 0, "") in rows
    assert suffix.without_repeats(empty).count() == 0


def test_prefixes_are_lengthened_until_groups_fit(spark, tmp_path):
    """300 documents share the six words around an anchor; longer prefixes part them, and pairs of them share a window."""
    six = "alpha beta gamma delta epsilon zeta"
    docs = [(i, " ".join([*(f"l{i // 2}_{j}" for j in range(9)), six, *(f"r{i // 3}_{j}" for j in range(9))])) for i in range(300)]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    want = brute_removal(docs)
    assert sum(r[2] > 0 for r in want) > 150
    for leaves in (100, 7):
        out = suffix.without_repeats(df, group_leaves=leaves)
        assert sorted(map(tuple, out.collect()), key=repr) == want


def test_hot_prefixes_are_dealt_to_several_tasks(spark):
    """Leaves of a hot anchor don't meet by the anchor, and keep their windows."""
    import numpy as np
    import pyarrow as pa

    texts = [f"a{i} b{i} c{i} alpha beta gamma delta epsilon zeta eta theta iota kappa d{i} e{i} f{i}" for i in range(400)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(400)), pa.array(texts), pa.array(range(400))], ["id", "text", "hash"])
    none, every = np.zeros(suffix.BUCKETS, dtype=bool), np.ones(suffix.BUCKETS, dtype=bool)
    together = pa.Table.from_batches(list(suffix._leaves(13, none)([batch])))
    apart = pa.Table.from_batches(list(suffix._leaves(13, every)([batch])))
    assert together.num_rows == apart.num_rows and len(set(apart["anchor"].to_pylist())) > len(set(together["anchor"].to_pylist()))
    counted = pa.Table.from_batches(list(suffix._counts(13)([batch])))
    assert sum(counted["n"].to_pylist()) >= together.num_rows
    longer = pa.Table.from_batches(list(suffix._lengthened(13)(apart.select(["around", "id", "place", "mask"]).filter(pa.compute.less_equal(apart["mask"], 0)).combine_chunks().to_batches())))
    spans = {m for m, c in zip(longer["mask"].to_pylist(), longer["check"].to_pylist()) if m <= 0}
    assert spans == {suffix._span(0, 4), suffix._span(5, 8)}


def test_passages_are_the_words_that_go(spark, odd, empty):
    passage = " ".join(f"p{i}" for i in range(40))
    docs = documents(spark) + [(5000 + k, f"{'y' * k} {passage} z{k} {passage}") for k in range(6)] + [(6000, passage), (6001, " ".join(passage.split()[:12])), (None, passage)]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    told = {}
    for r in suffix.repeated_passages(df, group_leaves=50).collect():
        assert r["n_words"] >= 13 and r["passage"].split() == word_list(dict(docs)[r["doc_id"]])[r["start"] : r["start"] + r["n_words"]]
        told.setdefault(r["doc_id"], []).append((r["start"], r["n_words"]))
    for i, _, n, _ in brute_removal(docs):
        runs = sorted(told.get(i, []))
        assert sum(k for _, k in runs) == n and all(a + k < b for (a, k), (b, _) in zip(runs, runs[1:]))
    assert told[5003] == [(1, 40), (42, 40)] and told[6000] == [(0, 40)] and 6001 not in told
    assert suffix.repeated_passages(odd).columns == ["doc_id", "start", "n_words", "passage"] and suffix.repeated_passages(odd).count() > 0
    assert suffix.repeated_passages(empty).count() == 0


# The pipeline


def test_pipeline_stages_take_effect(spark, tmp_path):
    import corpus_pipeline as p

    assert [len(x) for x in p.STAGES] == [2] * 5 and p.ORACLE_SQL is None
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    named = p.identify_language(spark, docs, SF)
    verdict = language.identify(docs, language.learn(docs.where(language.fold() != 1)))
    assert {r[0] for r in named.select("doc_id").collect()} == {r["doc_id"] for r in verdict.where("not rejected").collect()} and named.columns == docs.columns
    unique = p.drop_near_duplicates(spark, named, SF)
    roots = brute_components([(r["doc_id"], r["text"] or "") for r in named.collect()], 80)
    assert {r["doc_id"] for r in unique.collect()} == set(roots.values())
    clean = p.decontaminate(spark, unique, SF)
    items = [r["text"] for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    leaks = {r["doc_id"] for r in unique.collect() if any(all(x in (r["text"] or "") for x in item.split("\n")) for item in items)}
    assert leaks and {r["doc_id"] for r in unique.join(clean, "doc_id", "left_anti").collect()} == leaks
    mixed = p.mix(spark, clean, SF)
    copies = {r["doc_id"]: r["copies"] for r in mixing.mix_sources(clean).collect()}
    assert collections.Counter(r["doc_id"] for r in mixed.collect()) == {i: n for i, n in copies.items() if n}
    out = p.write_tokens(spark, mixed, SF).orderBy("start").collect()
    assert [r["doc_id"] for r in out] == sorted(r["doc_id"] for r in mixed.collect()) and all(a["start"] + a["n_tokens"] == b["start"] for a, b in zip(out, out[1:]))


def test_queries_return_one_row_per_document(spark):
    from ladle.llm.queries import queries

    n = spark.read.parquet(f"{SF}/documents.parquet").count()
    for name in ("op3_tiling", "op5_token_counts", "op8_language"):
        rows = queries()[name](spark, SF)
        assert rows.count() == n and "doc_id" in rows.columns
    r = queries()["op8_language"](spark, SF).first()
    assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1)


def test_near_dedup_stage_links_at_80_per_cent(spark):
    import corpus_pipeline as p

    base = [f"t{i}" for i in range(60)]
    texts = [" ".join(base), *(" ".join(base[:k] + [f"x{k}"] + base[k + 1 :]) for k in range(60))]
    texts += [" ".join("z" if k == 20 else f"u{n}_{k}" for k in range(n)) for n in (44, 45, 46, 50, 62)] + [" ".join(f"u{n}_{k}" for k in range(n)) for n in (44, 45, 46, 50, 62)]
    texts += [t for _, t in documents(spark)]
    sets = [{tuple(w[k : k + 5]) for k in range(len(w) - 4)} or {tuple(w)} - {()} for w in (t.encode().lower().split() for t in texts)]
    near = [[b for b in range(len(texts)) if a == b or 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]) > 0] for a in range(len(texts))]
    root = list(range(len(texts)))
    while (least := [min(root[b] for b in bs) for bs in near]) != root:
        root = least
    df = spark.createDataFrame([(i, t, "en", "s") for i, t in enumerate(texts)], SCHEMA)
    assert {r["doc_id"] for r in p.drop_near_duplicates(spark, df, SF).collect()} == set(root)


def test_mix_fills_the_gap_behind_a_long_document(spark):
    docs = [(i, "a b c d e f g", "en", "s") for i in range(500)] + [(1000, "w " * 3000, "en", "s")]
    rows = mixing.mix_sources(spark.createDataFrame(docs, SCHEMA)).collect()
    assert len(rows) == 501 and 0 <= rows[0]["target"] - sum(r["taken"] for r in rows) < 7
    # all short ones are certain of a copy, and the target is nearer with a long one than without
    docs += [(1001, "w " * 3000, "en", "s"), (1002, "w " * 3000, "en", "s")]
    out = {r["doc_id"]: r["taken"] for r in mixing.mix_sources(spark.createDataFrame(docs, SCHEMA)).collect()}
    assert out == {docs[i][0]: n for i, n in brute_mix([(i, x, s) for i, x, _, s in docs]).items()} and abs(sum(out.values()) - 18_750) <= 250


def brute_mix(docs, tilt=mixing.TILT, close=mixing.CLOSE):
    """{row: words taken} of (id, text, source) rows, by the docstring of mix_sources."""
    size = [len(word_list(t)) for _, t, _ in docs]
    whole = {s: sum(z for z, d in zip(size, docs) if d[2] == s) for *_, s in docs}
    targets, copies = brute_targets(whole), {}
    for s in whole:
        mine = [i for i, d in enumerate(docs) if d[2] == s]
        certain = int(targets[s] / whole[s] + 1e-12) if whole[s] else 0
        open_ = targets[s] - certain * whole[s]
        copies |= dict.fromkeys(mine, certain)
        pool = sorted((size[i], i) for i in mine if size[i] and open_ > 0)
        c, rest, odds = None, open_, {}
        for z in sorted({z for z, _ in pool}):
            c = rest / sum(y ** (1 - tilt) for y, _ in pool if y >= z)
            if c <= z**tilt:
                break
            rest, c = rest - sum(y for y, _ in pool if y == z), None
        waiting = []
        for z, i in pool:
            p = 1.0 if c is None else min(1.0, c / z**tilt)
            u = (int(hashlib.md5(f"mix|{'null' if docs[i][0] is None else docs[i][0]}|{z}".encode()).hexdigest()[:13], 16) + 0.5) / (1 << 52)
            if p == 1:
                copies[i], open_ = certain + 1, open_ - z
            else:
                odds[i] = u * (1 - p) / ((1 - u) * p)
                waiting.append((odds[i], z, i))
        waiting.sort()
        while open_ >= 1 and open_ > close * targets[s]:
            waiting = [w for w in waiting if w[1] <= open_]
            stop = None
            for k, (_, z, i) in enumerate(waiting):
                if z > open_:
                    stop = k
                    break
                copies[i], open_ = certain + 1, open_ - z
            if stop is None:
                break
            waiting = waiting[stop + 1 :]
        left = sorted((size[i], odds.get(i, -1), i) for i in mine if size[i] and copies[i] == certain)
        if open_ >= 1 and open_ > close * targets[s] and left and pool:
            wide, _, taken = left[0]
            off, _, _, given = min(((abs(wide - size[i] - open_), size[i], odds.get(i, -1), i) for i in mine if copies[i] > certain), default=(math.inf, 0, 0, None))
            if min(off, abs(wide - open_)) < open_:
                copies[taken] += 1
                if off < abs(wide - open_):
                    copies[given] -= 1
    return {i: copies[i] * size[i] for i in copies}


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_mix_equals_brute_force(spark, sf):
    df = spark.read.parquet(f"/root/testdata/{sf}/documents.parquet").withColumn("source", F.when(F.col("doc_id") % 3 == 0, "hot").when(F.col("doc_id") % 11 != 0, F.col("source"))).select("doc_id", "text", "source")
    docs = sorted(map(tuple, df.collect()))
    expected = brute_mix(docs)
    out = {r["doc_id"]: r["taken"] for r in mixing.mix_sources(df).collect()}
    assert out == {docs[i][0]: n for i, n in expected.items()}


def test_word_ids_are_those_of_whole_texts():
    """Every letter that normalisation changes and every mark, next to closing punctuation and to letters in upper case."""
    import unicodedata

    encoder = tokens.WordEncoder(WORDS)
    normal = encoder.tokenizer.normalizer.normalize_str
    odd_letters = [c for c in map(chr, (*range(0x80, 0xD800), *range(0xE000, 0x20000))) if unicodedata.category(c)[0] in "LM" and (normal(c) != c or unicodedata.category(c)[0] == "M")]
    assert len(odd_letters) > 4_000
    texts = [" ".join(f"a{c}{p} {c}{p} W{c}{p}" for c, p in zip(odd_letters[at : at + 40], ".,!?)" * 8)) for at in range(0, len(odd_letters), 40)]
    for t in texts:
        w = encoder.words(t.encode())
        known = encoder.ids([w])
        assert np.frombuffer(b"".join(known[x] for x in w), "<u2").tolist() == encoder.tokenizer.encode(t, add_special_tokens=False).ids, t


def test_tiles_equal_brute_force_on_random_texts():
    rng = np.random.default_rng(7)
    for _ in range(2_000):
        letters = "abcdefghij"[: rng.integers(2, 10)]
        item = list(rng.choice(list(letters), rng.integers(5, 25)))
        text_ = sum((item[a : a + n] + list(rng.choice(list(letters), k)) for a, n, k in zip(rng.integers(0, len(item), 4), rng.integers(1, 14, 4), rng.integers(0, 4, 4))), [])
        codes = {c: np.uint64(ord(c) * 0x9E3779B97F4A7C15 % (1 << 64)) for c in letters}
        found = tiling.tiles(*(np.array([codes[c] for c in x], dtype=np.uint64) for x in (item, text_)), 5)
        assert sum(k for k, _, _ in found) / len(item) == pytest.approx(brute_coverage(" ".join(item), " ".join(text_)))


def test_near_pairs_share_a_band():
    """Misses among pairs just above the link: the formula gives 2e-7 of them."""
    rng = np.random.default_rng(5)
    pairs = []
    for _ in range(1_500):
        n = int(rng.integers(60, 400))
        shared, own = rng.integers(0, 1 << 62, n, dtype=np.uint64), rng.integers(0, 1 << 62, 2 * max(1, round(n * 0.085)), dtype=np.uint64)
        pairs += [np.unique(np.concatenate([shared, own[::2]])), np.unique(np.concatenate([shared, own[1::2]]))]
    keys = minhash.band_keys(pairs, 48, 8)
    assert (keys[::2] == keys[1::2]).any(axis=1).all()


def test_pipeline_stages_on_odd_rows(spark, odd, empty, tmp_path):
    """Nulls, repeated ids, extra columns with names that stages use, empty tables."""
    import corpus_pipeline as p

    spark.createDataFrame([(1, None), (None, "one two three four five six"), (2, "one two three four five six seven eight")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = odd.withColumns({"copy": F.lit("c"), "copies": F.lit("d"), "mixed": F.lit("e"), "document": F.lit(3), "col": F.lit(4)})
    for table, same in ((docs, docs.columns), (empty, empty.columns)):
        for _, stage in p.STAGES[:-1]:
            out = stage(spark, table, str(tmp_path))
            assert out.columns == same and out.schema == table.schema
            rows = out.collect()
            assert all(r["copy"] == "c" and r["copies"] == "d" and r["document"] == 3 for r in rows if "copy" in same)
            assert bool(rows) == (table is docs)
        assert p.write_tokens(spark, table, str(tmp_path)).count() == table.count()
    kept = {r["doc_id"] for r in p.drop_near_duplicates(spark, docs, str(tmp_path)).collect()}
    assert 4 in kept and 5 not in kept and None in kept
    assert None in {r["doc_id"] for r in p.decontaminate(spark, docs, str(tmp_path)).collect()}


def wrapped(t, n=9):
    w = t.split()
    return "\n".join(" ".join(w[k : k + n]) for k in range(0, len(w), n))


@pytest.fixture(scope="module")
def licence_model(spark):
    return licences.train(spark.read.parquet(f"{SF}/documents.parquet"))


VARIANTS = [
    ("gpl", "Licensed under the GNU General Public License."), ("apache", "// SPDX-License-Identifier: Apache-2.0"), ("mit", "SPDX-License-Identifier: MIT"), ("gpl", "# SPDX-License-Identifier: GPL-2.0-only"), ("apache", "Licensed under the Apache License 2.0"),
    ("cc-by", "The text is under a Creative Commons Attribution 4.0 International License."), ("cc0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work under CC0."), ("proprietary", "Copyright 2019 Foo Inc. All rights reserved."), ("bsd", "We released this under the BSD License in May."),
    ("mpl", "# This Source Code Form is subject to the terms of the Mozilla Public\n# License, v. 2.0. If a copy of the MPL was not distributed with this\n# file, You can obtain one at http://mozilla.org/MPL/2.0/."), ("lgpl", "Distributed under LGPL-2.1-or-later."), ("agpl", "The program is licensed under the AGPL 3.0."),
    ("unlicense", "Released under The Unlicense."), ("cc-by-sa", "Text is available under the Creative Commons Attribution-ShareAlike License."), ("cc-by-nc", "Bilder: CC BY-NC-SA 4.0"),
    ("gpl", "Licensed under GPLv3."), ("cc0", "Released under CC0."), ("lgpl", "Licensed under the LGPL."), ("mpl", "Distributed under the MPL."), ("agpl", "This code is AGPL."), ("gpl", "License: GPLv3"), ("gpl", "GNU GPLv3"), ("mit", "MIT licensed."), ("bsd", "BSD-licensed code."),
    ("cc-by-nd", "Creative Commons Attribution-NoDerivatives 4.0 International License"), ("cc-by-nd", "The photos are CC BY-ND 4.0."), ("cc-by-nc-nd", "Licensed under a Creative Commons Attribution-NonCommercial-NoDerivs License."), ("cc-by", "All texts are CC BY 3.0."), ("cc-by-sa", "Text: CC BY-SA"), ("cc-by-nc", "Creative Commons Attribution Non-Commercial 4.0 International License"),
]
NOT_FAMILIES = ["Licensed under the Boost Software License.", "Released under the terms of the EUPL 1.2 licence.", "This file is distributed under the zlib License.", "SPDX-License-Identifier: ECL-2.0", "Licensed under the Wibble Public License 4."]


def test_licence_notices_as_people_write_them(spark, licence_model):
    cases = [(f, "Some prose stands here.\n" + wrapped(t)) for f, ts in licences.TEMPLATES.items() for t in ts if len(t.split()) > 8] + VARIANTS
    cases += [(f, c.format(t)) for f, ts in licences.TEMPLATES.items() for t in ts if len(t.split()) <= 8 and "SPDX" not in t for c in ("It comes under the {}, as it is.", "Terms: {}")]
    df = spark.createDataFrame([(i, x) for i, (_, x) in enumerate(cases)], "doc_id long, text string")
    found = [r["licence"] for r in licences.scan(df, licence_model).orderBy("doc_id").collect()]
    assert sum(f == g for (f, _), g in zip(cases, found)) >= 0.97 * len(cases)
    assert found[len(cases) - 2 * sum(1 for ts in licences.TEMPLATES.values() for t in ts if len(t.split()) <= 8 and "SPDX" not in t) - len(VARIANTS) :][: len(VARIANTS)] == [f for f, _ in VARIANTS]
    others = licences.scan(spark.createDataFrame(list(enumerate(NOT_FAMILIES)), "doc_id long, text string"), licence_model).collect()
    assert all(r["licence"] is None for r in others) and sum(r["n_unknown"] for r in others) >= 4
    plain = [*licences.DECOYS_HELD, "The river runs to the sea and the town lies at its mouth."]
    assert all(r["licence"] is None and not r["n_unknown"] for r in licences.scan(spark.createDataFrame(list(enumerate(plain)), "doc_id long, text string"), licence_model).collect())
    both = licences.scan(spark.createDataFrame([(1, "Dual-licensed under the MIT License or the Apache License, Version 2.0.")], "doc_id long, text string"), licence_model).first()
    assert both["families"] == ["apache", "mit"]


def brute_licences(model, text_):
    """(families, n_unknown, best probability) by the docstring of scan, from the model's coefficients."""
    coefficients, intercepts = model.regression.coefficientMatrix.toArray(), model.regression.interceptVector.toArray()
    column = {w: k for k, w in enumerate(model.vectorizer.vocabulary)}

    def term_list(t):
        out, narrow = [], ("nc", "nd", "sa", "noncommercial", "noderivatives", "noderivs", "sharealike")
        t = re.sub(r"\b(non|no|share)-(commercial|derivatives|derivs|alike)\b", r"\1\2", t.lower())
        at = 0
        for word in re.finditer(r"(?:[^\W_]|\.)+", t):
            x = word.group().strip(".")
            joins = t[at : word.start()] in ("-", " ") and x in narrow and re.search(r"(?:^|[^\w.])(?:by|attribution)(?:nc|nd|sa|noncommercial|noderivatives|noderivs|sharealike)*$", " " + (out or [""])[-1])
            if x and joins:
                out[-1] += x
            elif x:
                out.append(x)
            at = word.end()
        return out

    def pair_list(w):
        return w if len(w) == 1 else [f"{a} {b}" for a, b in zip(w, w[1:])]

    def confirms(template, w):
        """Four fifths of the template's neighbouring words stand beside each other in the sentence; a template of one word stands in it."""
        if len(template) == 1:
            return template[0] in w
        beside = {(template[k], template[k + 1]) for k in range(len(template) - 1)}
        return sum(any(w[k : k + 2] == [a, b] for k in range(len(w))) for a, b in beside) >= 0.8 * len(beside)

    found, unknown = [], 0
    for block in re.split(r"\r?\n[ \t\r]*\n|(?<=[.!?:;])[ \t\r]*\n", text_):
        for sentence in re.split(r"(?<=[.!?;])\s(?=[A-ZÀ-Þ\"(])", re.sub(r"\s+[*#/]*\s*", " ", block)) if re.search(licences.CUE, block) else []:
            if not re.search(licences.CUE, sentence):
                continue
            w = term_list(sentence)
            raw = intercepts + sum((coefficients[:, column[x]] for x in {*w, *pair_list(w)} if x in column), np.zeros(len(intercepts)))
            shares = np.exp((raw - raw.max()) / model.temperature)
            shares /= shares.sum()
            families = dict(zip(model.labels, shares[: len(licences.TEMPLATES)]))
            confirmed = {f for f, ts in licences.TEMPLATES.items() for t in ts if confirms(term_list(t), w)}
            named = [(-p, f) for f, p in families.items() if f in confirmed and p >= licences.FURTHER * max(families.values())] if max(families.values()) >= model.threshold else []
            found += named
            unknown += not named and shares[model.labels.index("none")] < 0.5
    return sorted({f for _, f in found}), unknown, -min(found)[0] if found else None


def test_licences_equal_brute_force(spark, licence_model):
    docs = documents(spark) + [(10_000 + i, wrapped(x)) for i, x in enumerate([x for _, x in VARIANTS] + NOT_FAMILIES + list(licences.DECOYS))]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    out = {r["doc_id"]: r for r in licences.scan(df, licence_model).collect()}
    for i, t in docs:
        families, unknown, probability = brute_licences(licence_model, t)
        assert (out[i]["families"], out[i]["n_unknown"]) == (families, unknown), t[-200:]
        assert out[i]["probability"] == (None if probability is None else pytest.approx(probability, abs=1e-9))
    # sentences without a cue name nothing
    every = {r["doc_id"]: r["families"] for r in licences.scan(df, licence_model, cue="").collect()}
    assert every == {i: r["families"] for i, r in out.items()}


def test_licences_in_sentences_without_a_cue(spark, licence_model):
    """Most of a template's words name it, cue or not; a sentence that confirms a template always has a stem or an anchor."""
    long = next(t for t in licences.TEMPLATES["mit"] if t.startswith("Permission"))
    text_ = re.sub(r"(?i)permission|sublicense", "consent", long.replace("without limitation the rights", "without limitation, the rights"))
    assert not re.search(licences.CUE, text_)
    rows = spark.createDataFrame([(1, text_), (2, "The river runs to the sea.")], "doc_id long, text string")
    out = {r["doc_id"]: r for r in licences.scan(rows, licence_model).collect()}
    assert (out[1]["families"], out[1]["n_cues"], out[1]["n_unknown"], out[2]["families"]) == (["mit"], 0, 0, [])
    pairs = licences._template_pairs(spark)
    asked = re.compile(licences.anchored(licences.anchors(pairs)))
    assert all(re.search(licences.CUE, f"some{stem}s") for stem in licences.CUE_STEMS)
    for template in [t for ts in pairs.values() for t in ts]:
        kept = [p for p in template if not any(stem in p for stem in licences.CUE_STEMS)]
        need = math.ceil(licences.CONFIRM * len(template))
        # the pairs without an anchor are too few
        assert sum(not asked.search(p) for p in kept) < need


def test_a_written_table_leaves_no_shuffle_files(spark):
    def shuffled():
        blocks = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllBlocks()
        return {b for k in range(blocks.size()) if (b := blocks.apply(k).name()).startswith("shuffle_")}

    before = shuffled()
    table = storage.materialize(spark.range(1000).select("id", F.xxhash64("id").alias("h")).repartition("h").sortWithinPartitions("h"), "sorted")
    for _ in range(50):
        if not shuffled() - before:
            break
        time.sleep(0.1)
    assert not shuffled() - before and spark.conf.get(storage.CLEANUP) == "false"
    assert table.count() == 1000
    storage.discard(table)
