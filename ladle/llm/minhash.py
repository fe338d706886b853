"""Near-duplicate documents by min-max hashing.

Each permutation of the shingles yields two signature values, its minimum and its maximum, so that
half as many hash evaluations fill the same bands. Documents that agree in a whole band become
candidates; what links them is the exact Jaccard similarity of their full shingle sets.

Spark's part: equal sets collapse by an aggregate, bands are an aggregate on their keys that keeps
the least member, candidates form clusters by connected components, and clusters are compared in
blocks of bounded size. No step lists the pairs of a bucket, and none gathers a bucket or a cluster.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ladle.llm import text as words
from ladle.llm.graph import components
from ladle.llm.storage import bound_batches, discard, join_hot, materialize

#: Shingles in a block of a cluster, on average; two blocks are compared in one task's memory.
BLOCK_SHINGLES = 40_000
#: Documents in a block, on average.
BLOCK_DOCS = 256
#: A table of this many ids may be broadcast (8 bytes each, some 30 MB once hashed).
BROADCAST_IDS = 500_000

#: Repeated sets may be broadcast up to this number (some 50 bytes each).
BROADCAST_SETS = 200_000


def shingle_sets(column: pa.Array, n: int = 5) -> Iterator[tuple[int, list[np.ndarray]]]:
    """For chunks of texts: the index of the first, and each text's distinct shingle hashes, sorted."""
    for chunk in words.chunks(column, "lower"):
        grams = chunk.grams(n)
        sets = []
        for d in chunk.docs:
            a, b = chunk.word_from[d], chunk.word_from[d + 1]
            if b - a >= n:
                sets.append(np.unique(grams[a : b - n + 1]))
            else:
                sets.append(words.grams(chunk.hash[a:b], b - a) if b > a else grams[:0])
        yield chunk.first, sets


def _factors(permutations: int) -> np.ndarray:
    rng = np.random.default_rng(9_176_543)
    return rng.integers(1, 1 << 31, permutations, dtype=np.uint32) * np.uint32(2) + np.uint32(1)


def band_keys(sets: list[np.ndarray], bands: int, rows: int) -> np.ndarray:
    """A key for each set and band. A band has rows values: the minima and maxima of rows / 2 permutations."""
    factors = _factors(bands * rows // 2)
    low = np.zeros((len(sets), len(factors)), dtype=np.uint32)
    high = np.zeros_like(low)
    for i, s in enumerate(sets):
        if not len(s):
            continue
        short = (s >> words.U64(32)).astype(np.uint32)
        for at in range(0, len(short), 2048):
            under = short[at : at + 2048, None] * factors
            least, most = under.min(axis=0), under.max(axis=0)
            low[i], high[i] = (np.minimum(low[i], least), np.maximum(high[i], most)) if at else (least, most)
    values = np.stack([low, high], axis=2).reshape(len(sets), bands, rows).astype(words.U64)
    keys = (values * words._GRAM_FACTORS[:rows]).sum(axis=2, dtype=words.U64)
    return words.mix(words.mix(keys) + np.arange(bands, dtype=words.U64) * words._GRAM_FACTORS[63])


def _sketches(bands: int, rows: int, n: int):
    def run(batches):
        for batch in batches:
            ids = batch.column(0)
            for first, sets in shingle_sets(batch.column(1), n):
                keys = band_keys(sets, bands, rows).view(np.int64)
                flat = pa.array(keys.reshape(-1))
                offsets = pa.array(np.arange(len(sets) + 1, dtype=np.int32) * bands)
                halves = [[int(words.mix(s ^ f).sum(dtype=words.U64).astype(np.int64)) for s in sets] for f in words._GRAM_FACTORS[:2]]
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(first, len(sets)), pa.array([len(s) for s in sets], pa.int64()), pa.array(halves[0], pa.int64()), pa.array(halves[1], pa.int64()), pa.ListArray.from_arrays(offsets, flat)],
                    ["id", "n_shingles", "h1", "h2", "bands"],
                )

    return run


def _sets(n: int):
    def run(batches):
        for batch in batches:
            for first, sets in shingle_sets(batch.column(2), n):
                size = len(sets)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(first, size), batch.column(1).slice(first, size), pa.array([len(s) for s in sets], pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())], ["cluster", "id", "n", "shingles"]
                )

    return run


def links_between(left: list[np.ndarray], right: list[np.ndarray], per_cent: int) -> np.ndarray:
    """A matrix: whether 100 * intersection >= per_cent * union, for each set of left and of right."""
    sizes_l, sizes_r = np.array([len(s) for s in left]), np.array([len(s) for s in right])
    members = np.concatenate([*left, *right])
    owner = np.repeat(np.arange(len(left) + len(right)), np.concatenate([sizes_l, sizes_r]))
    values, column = np.unique(members, return_inverse=True)
    shared = np.zeros((len(left), len(right)), dtype=np.float32)
    order = np.argsort(column, kind="stable")
    column, owner = column[order], owner[order]
    step = max(1, 8_000_000 // (len(left) + len(right)))
    edges = np.searchsorted(column, np.arange(0, len(values) + step, step))
    for k, at in enumerate(range(0, len(values), step)):
        part = np.zeros((len(left) + len(right), min(step, len(values) - at)), dtype=np.float32)
        part[owner[edges[k] : edges[k + 1]], column[edges[k] : edges[k + 1]] - at] = 1
        shared += part[: len(left)] @ part[len(left) :].T
    both = shared.astype(np.int64)
    union = sizes_l[:, None] + sizes_r[None, :] - both
    return (100 * both >= per_cent * union) & (union > 0)


def _forest(per_cent: int):
    """Links between the documents of two blocks, as edges of a spanning forest."""

    def run(batches):
        for batch in batches:
            a, b = [], []
            for i in range(batch.num_rows):
                left, right = batch.column(0)[i].as_py(), batch.column(1)[i].as_py()
                ids_l, ids_r = [x["id"] for x in left], [x["id"] for x in right]
                same = ids_l == ids_r
                found = links_between(*([np.frombuffer(x["shingles"], dtype=words.U64) for x in side] for side in (left, right)), per_cent)
                if same:
                    found = np.triu(found, 1)
                parent = list(range(len(ids_l) + len(ids_r)))

                def root(x, parent=parent):
                    while parent[x] != x:
                        parent[x] = parent[parent[x]]
                        x = parent[x]
                    return x

                for x, y in np.argwhere(found).tolist():
                    p, q = root(x), root(y if same else len(ids_l) + y)
                    if p != q:
                        parent[p] = q
                        a.append(ids_l[x])
                        b.append(ids_r[y])
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return run


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", per_cent: int = 85, shingle: int = 5, bands: int = 48, rows: int = 8) -> DataFrame:
    """Classes of documents linked by similar shingle sets: (id_col, n_shingles, component_id, kept), a row per row of docs.

    A document's set: its distinct shingles of lower-cased words; with fewer words, all of them as one;
    without a word or with a null text, empty, and linked with nothing. Two documents are linked if
    100 * intersection >= per_cent * union of their sets. component_id is the smallest id that links
    reach, kept says that it is the document's own. A candidate pair is missed with a chance of
    (1 - s ** rows) ** bands at similarity s: 2e-7 at 0.85 by the defaults.

    Rows that share an id are one document with several sets: a link of any of them counts. A null id
    stands alone: its component_id is null, and it is kept. Other columns of docs are not looked at.
    """
    bound_batches(docs.sparkSession)
    given = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    sketch = materialize(given.mapInArrow(_sketches(bands, rows, shingle), "id long, n_shingles long, h1 long, h2 long, bands array<long>"), "sketches")
    sized = sketch.where("n_shingles > 0 and id is not null")
    keys = ["h1", "h2", "n_shingles"]
    repeated = materialize(sized.groupBy(*keys).agg(F.min("id").alias("rep"), F.count("*").alias("n")).where("n > 1").drop("n"), "repeated")
    # sets that occur once have no entry: with the others at hand, nothing is dealt out by a set that thousands share
    marked = sized.join(F.broadcast(repeated) if repeated.count() <= BROADCAST_SETS else repeated, keys, "left")
    # one representative of each distinct set: only those are banded and compared
    reps = marked.where("rep is null or id = rep")
    band = reps.select("id", F.explode("bands").alias("key"))
    least = materialize(band.groupBy("key").agg(F.min("id").alias("center"), F.max("id").alias("last"), F.count("*").alias("n")).where("center < last").drop("last"), "buckets")
    total = least.agg(F.sum("n")).first()[0] or 0
    candidates = join_hot(band, least, ["key"], "n", total, F.col("id") != F.col("center")).select(F.col("id").alias("a"), F.col("center").alias("b")).distinct()
    clusters = materialize(components(candidates).select(F.col("node").alias("id"), F.col("component").alias("cluster")).distinct(), "clusters")
    discard(least)
    found = _confirmed(given, clusters, per_cent, shingle)
    # equal sets are links as well
    equal = marked.where("id != rep").select(F.col("id").alias("a"), F.col("rep").alias("b"))
    reached = components(found.union(equal))
    discard(found, clusters, repeated)
    return (
        sketch.select("id", "n_shingles")
        .join(reached, F.col("id") == F.col("node"), "left")
        .select(F.col("id").alias(id_col), "n_shingles", F.coalesce("component", "id").alias("component_id"), F.coalesce(F.coalesce("component", "id") == F.col("id"), F.lit(True)).alias("kept"))
    )


def _confirmed(given: DataFrame, clusters: DataFrame, per_cent: int, shingle: int) -> DataFrame:
    """Links inside the clusters, confirmed on the full sets: enough of them to join what is linked."""
    small = clusters.count() <= BROADCAST_IDS
    texts = given.where("id is not null").join(F.broadcast(clusters) if small else clusters, "id").select("cluster", "id", "text")
    sets = materialize(texts.mapInArrow(_sets(shingle), "cluster long, id long, n long, shingles binary").where("n > 0"), "sets")
    blocks = sets.groupBy("cluster").agg(F.greatest(F.ceil(F.sum("n") / BLOCK_SHINGLES), F.ceil(F.count("*") / BLOCK_DOCS)).cast("int").alias("blocks"), F.count("*").alias("members"))
    dealt = join_hot(sets, blocks, ["cluster"], "members", sets.count()).withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    # the block size is bounded by the deal, however large the cluster
    packed = materialize(dealt.groupBy("cluster", "blocks", "block").agg(F.sort_array(F.collect_list(F.struct("id", "shingles"))).alias("docs")), "blocks")
    pairs = (
        packed.select("cluster", F.col("block").alias("left_block"), F.col("docs").alias("left_docs"), F.explode(F.sequence(F.col("block"), F.col("blocks") - 1)).alias("right_block"))
        .join(packed.select("cluster", F.col("block").alias("right_block"), F.col("docs").alias("right_docs")), ["cluster", "right_block"])
        .where((F.col("left_block") != F.col("right_block")) | (F.size("left_docs") > 1))
    )
    links = materialize(pairs.select("left_docs", "right_docs").mapInArrow(_forest(per_cent), "a long, b long"), "links")
    discard(sets, packed)
    return links
