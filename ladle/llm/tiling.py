"""Benchmark decontamination by greedy string tiling.

A document leaks a test item if non-overlapping tiles, runs of words that occur in both, cover enough
of the item, in whatever order they stand in the document.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ladle.llm import text as words
from ladle.llm.storage import bound_batches, materialize

#: The items' seeds are broadcast up to this number (8 bytes each); beyond it all seeds of the documents are joined.
BROADCAST_SEEDS = 2_000_000
#: Where seeds are joined, each is repeated so often, and the documents' seeds are dealt over the repetitions.
SALTS = 16


def _rolling(tokens: np.ndarray, length: int) -> np.ndarray:
    """Karp-Rabin hash, modulo 2 ** 64, of each window of length tokens."""
    if len(tokens) < length:
        return tokens[:0]
    powers, inverses = words.powers(len(tokens) + 1)
    sums = np.zeros(len(tokens) + 1, dtype=words.U64)
    np.cumsum(tokens * powers[: len(tokens)], out=sums[1:])
    return (sums[length:] - sums[:-length]) * inverses[: len(tokens) - length + 1]


def _free_windows(marked: np.ndarray, length: int) -> np.ndarray:
    """First tokens of windows without a marked token."""
    if len(marked) < length:
        return np.empty(0, dtype=np.int64)
    sums = np.concatenate([[0], np.cumsum(marked)])
    return np.flatnonzero(sums[length:] == sums[:-length])


def _shared_windows(item: np.ndarray, text: np.ndarray, item_marked: np.ndarray, text_marked: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The unmarked windows of length that both have: places and hashes in the item and in the text."""
    i, j = _free_windows(item_marked, length), _free_windows(text_marked, length)
    hash_i, hash_j = _rolling(item, length)[i], _rolling(text, length)[j]
    in_i, in_j = np.isin(hash_i, hash_j), np.isin(hash_j, hash_i)
    return i[in_i], hash_i[in_i], j[in_j], hash_j[in_j]


def tiles(item: np.ndarray, text: np.ndarray, least: int) -> list[tuple[int, int, int]]:
    """Greedy tiles (length, place in item, place in text): the longest unmarked match is marked first, then the next, down to least tokens.

    Each round looks for the greatest length at which item and text share an unmarked window, by
    bisection over the lengths with a Karp-Rabin scan of both for each, and marks all matches of this
    length that don't overlap; ties go to the earlier place in the item, then in the text. Lengths only
    shrink, so a match that was partly marked comes back as what is left of it. A window of the text that
    meets a mark is passed over for good: a round is linear in the two lengths, also where one word repeats."""
    item_marked, text_marked = np.zeros(len(item), dtype=bool), np.zeros(len(text), dtype=bool)
    out, most = [], min(len(item), len(text))
    while most >= least:
        low, high, found = least - 1, most, None
        while low < high:
            middle = (low + high + 1) // 2
            shared = _shared_windows(item, text, item_marked, text_marked, middle)
            low, high, found = (middle, high, shared) if len(shared[0]) else (low, middle - 1, found)
        if found is None:
            break
        waiting: dict[int, list[int]] = {}
        for j, h in zip(found[2][::-1].tolist(), found[3][::-1].tolist()):
            waiting.setdefault(h, []).append(j)
        free = 0
        for i, h in zip(found[0].tolist(), found[1].tolist()):
            if i < free:
                continue
            places = waiting[h]
            while places and (text_marked[places[-1]] or text_marked[places[-1] + low - 1]):
                places.pop()
            if places:
                j = places.pop()
                item_marked[i : i + low] = text_marked[j : j + low] = True
                free = i + low
                out.append((low, i, j))
        most = low - 1
    return out


def _item_seeds(least: int):
    def run(batches):
        for batch in batches:
            for chunk in words.chunks(batch.column(1), "letters"):
                grams = chunk.grams(least)
                for d in chunk.docs:
                    a, b = chunk.word_from[d], chunk.word_from[d + 1]
                    if b - a >= least:
                        seeds, times = np.unique(grams[a : b - least + 1], return_counts=True)
                        longs = [pa.array([x.view(np.int64)], pa.list_(pa.int64())) for x in (chunk.hash[a:b], seeds, times)]
                        yield pa.RecordBatch.from_arrays([batch.column(0).slice(chunk.first + d, 1), pa.array([b - a], pa.int64()), *longs], ["item_id", "n", "tokens", "seeds", "times"])

    return run


def _shared(least: int, seeds):
    """For every document, its seeds that items have, and the words they cover: (row, id, seeds, tokens).

    tokens are word hashes; 0 stands for a gap. No tile of least words or more lies outside of them."""

    def run(batches):
        for batch in batches:
            for chunk in words.chunks(batch.column(2), "letters"):
                grams = chunk.grams(least)
                hit = np.zeros(len(grams), dtype=bool)
                if seeds is None:
                    hit[:] = True
                elif len(seeds.value) and len(grams):
                    at = np.minimum(np.searchsorted(seeds.value, grams), len(seeds.value) - 1)
                    hit = seeds.value[at] == grams
                shared, tokens = [], []
                for d in chunk.docs:
                    a, b = int(chunk.word_from[d]), int(chunk.word_from[d + 1])
                    at = np.flatnonzero(hit[a : max(a, b - least + 1)])
                    shared.append(np.unique(grams[a + at]).view(np.int64))
                    cover = np.unique((at[:, None] + np.arange(least)).reshape(-1))
                    mine = chunk.hash[a + cover]
                    gaps = np.flatnonzero(np.diff(cover) > 1) + 1
                    tokens.append(np.insert(mine, gaps, words.U64(0)).view(np.int64))
                size, longs = len(tokens), pa.list_(pa.int64())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(chunk.first, size), batch.column(1).slice(chunk.first, size), pa.array(shared, longs), pa.array(tokens, longs)], ["row", "id", "seeds", "tokens"])

    return run


def _covered(least: int):
    def run(batches):
        for batch in batches:
            out = []
            for i in range(batch.num_rows):
                item, text = (batch.column(k)[i].values.to_numpy(zero_copy_only=False).view(words.U64) for k in (2, 3))
                # a gap in the text never equals a word of the item
                out.append(sum(k for k, _, _ in tiles(item, text, least)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.int64())], ["row", "item_id", "covered"])

    return run


def find_leaks(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", least: int = 5, coverage: float = 0.5, broadcast_seeds: int = BROADCAST_SEEDS) -> DataFrame:
    """Which documents leak test items: (id_col, contaminated, kept, coverage, item_ids), a row per row of docs.

    Words are lower-cased runs of letters and digits. Tiles have least words or more; coverage is the
    largest share of an item's words that a document's tiles cover, item_ids are the items for which it reaches
    the threshold, in order. kept is the opposite of contaminated.

    Items with fewer than least words, or without an id, are not judged; rows that share an item id are
    separate texts under one name. A null or empty text leaks nothing. Each row of docs is judged by itself, also
    where ids repeat or are null. An empty table of items leaves all documents clean. Other columns are not looked at.
    """
    bound_batches(docs.sparkSession)
    kind, item_kind = dict(docs.dtypes)[id_col], dict(items.dtypes)[item_col]
    tests = items.select(F.col(item_col).alias("item_id"), F.col(item_text_col).alias("text")).where("item_id is not null")
    tests = materialize(tests.mapInArrow(_item_seeds(least), f"item_id {item_kind}, n long, tokens array<long>, seeds array<long>, times array<long>").withColumn("item", F.monotonically_increasing_id()), "items")
    seeds = tests.select("item", "item_id", "n", F.explode(F.arrays_zip("seeds", "times")).alias("at")).select("item", "item_id", "n", F.col("at.seeds").alias("seed"), F.col("at.times").alias("times"))
    filter_ = None
    if seeds.count() <= broadcast_seeds:
        found = seeds.select("seed").distinct().toArrow()["seed"].to_numpy().astype(np.int64)
        filter_ = docs.sparkSession.sparkContext.broadcast(np.sort(found.view(words.U64)))
    given = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    shared = materialize(given.mapInArrow(_shared(least, filter_), f"row long, id {kind}, seeds array<long>, tokens array<long>"), "shared")
    own = shared.select("row", F.explode("seeds").alias("seed"))
    if filter_ is not None:
        met = own.join(F.broadcast(seeds), "seed")
    else:
        # a seed that a third of the documents have is spread over tasks
        salted = seeds.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        met = own.withColumn("salt", F.pmod(F.xxhash64("row"), F.lit(SALTS)).cast("int")).join(salted.hint("merge"), ["seed", "salt"])
    pairs = met.groupBy("row", "item", "n").agg(F.sum("times").alias("seeds"))
    # a seed's place in the item covers least words at most: pairs that can't reach the threshold need no tiling
    pairs = pairs.where(F.col("seeds") * least >= coverage * F.col("n"))
    texts = tests.select("item", "item_id", F.col("tokens").alias("item_tokens"))
    full = pairs.join(F.broadcast(texts) if filter_ is not None else texts, "item").join(shared.select("row", "tokens"), "row")
    tiled = full.select("row", F.col("item").alias("item_id"), "item_tokens", "tokens").mapInArrow(_covered(least), "row long, item_id long, covered long").withColumnRenamed("item_id", "item")
    share = F.col("covered") / F.col("n")
    names = tests.select("item", "item_id", "n")
    scored = tiled.join(F.broadcast(names) if filter_ is not None else names, "item").withColumn("share", share)
    found = scored.groupBy("row").agg(F.max("share").alias("coverage"), F.sort_array(F.collect_set(F.when(F.col("share") >= coverage, F.col("item_id")))).alias("item_ids"))
    out = shared.select("row", "id").join(found, "row", "left")
    none = F.array().cast(f"array<{item_kind}>")
    bad = F.coalesce(F.col("coverage") >= coverage, F.lit(False))
    return out.select(F.col("id").alias(id_col), bad.alias("contaminated"), (~bad).alias("kept"), F.coalesce("coverage", F.lit(0.0)).alias("coverage"), F.coalesce("item_ids", none).alias("item_ids"))
