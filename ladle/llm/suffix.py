"""Repeated passages by prefix-partitioned suffix trees.

Of the short word sequences inside a window of 13 words the one with the smallest hash is its anchor: equal
windows have equal anchors in equal places. So it is enough to keep the suffixes that begin at anchors, with
the words before them, a fifth of all. An anchor that occurs in one document only begins no repeat.

Suffixes are dealt out by the prefix that they share and sorted by their words. From the longest common
prefixes of neighbours follow the internal nodes of a group's subtree; a node of depth d, extended to the left by the
words that its leaves share there, is a repeat of all windows that it spans, and runs of such windows are the maximal
repeats. A group's prefix is its anchor, unless more leaves share that than a group may hold. Then the windows of the
leaves are dealt in two, those that begin nearer to the anchor and those that begin farther before it; each half has more words in
common to all its windows, which make its prefix longer, and so on until a group fits or its prefix is a window: one
node, which needs its smallest id only. Leaves that agree in all words are combined before they are dealt out.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ladle.llm import text as words
from ladle.llm.storage import HOT_SHARE, bound_batches, join_hot, materialize

#: Words of an anchor.
ANCHOR_WORDS = 5
#: Leaves of a group, some 150 bytes each. A prefix that more of them share is lengthened.
GROUP_LEAVES = 200_000
#: Anchors are counted by so many hash values before leaves are dealt out.
BUCKETS = 1 << 16


def _windows(chunk: words.Chunk, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For the windows inside documents: first word, document within the chunk, anchor, first word of the anchor."""
    grams = chunk.grams(ANCHOR_WORDS)
    size = len(chunk.hash) - window + 1
    if size <= 0:
        none = np.empty(0, dtype=np.int64)
        return none, none, np.empty(0, dtype=words.U64), none
    anchor, place = grams[:size].copy(), np.zeros(size, dtype=np.int64)
    for k in range(1, window - ANCHOR_WORDS + 1):
        less = grams[k : k + size] < anchor
        place[less] = k
        np.minimum(anchor, grams[k : k + size], out=anchor)
    doc = np.repeat(np.arange(len(chunk.word_from) - 1), np.diff(chunk.word_from))
    at = np.flatnonzero(doc[:size] == doc[window - 1 :])
    return at, doc[at], anchor[at], at + place[at]


def _changes(*columns: np.ndarray) -> np.ndarray:
    """Where a row differs from the row before it."""
    differs = np.zeros(len(columns[0]), dtype=bool)
    differs[:1] = True
    for c in columns:
        differs[1:] |= c[1:] != c[:-1]
    return differs


def _ids(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The ids, which of them are not null, and the hashes of the texts."""
    column = batch.column(0)
    return column.fill_null(0).to_numpy(zero_copy_only=False), column.is_valid().to_numpy(zero_copy_only=False), batch.column(2).to_numpy(zero_copy_only=False)


def _fixed(rows: np.ndarray) -> pa.Array:
    """A binary value for each row of a matrix of words' codes."""
    size = rows.shape[1] * 4
    return pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer((np.arange(len(rows) + 1, dtype=np.int32) * size).tobytes()), pa.py_buffer(np.ascontiguousarray(rows, dtype="<u4").tobytes())])


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return np.frombuffer(column.buffers()[2], dtype="<u4", count=(column.offset + len(column)) * width).reshape(-1, width)[column.offset :]


def _whole(around: np.ndarray, o: int) -> np.ndarray:
    """Whether the leaf stands for the window that begins o words before its anchor."""
    back = around.shape[1] // 2
    inside = np.ones(len(around), dtype=bool) if o == back else around[:, back - o - 1] != 0
    return inside & (around[:, 2 * back - o] != 0) if o else inside


def _masks(around: np.ndarray, low: int, high: int) -> np.ndarray:
    return sum(_whole(around, o).astype(np.int64) << o for o in range(low, high + 1))


def _span(low: int, high: int) -> int:
    """A leaf's mask: not positive, it tells which of the windows with its anchor the leaf stands for, those that begin low to high words before the anchor."""
    return -(low << 6 | high)


def _prefixes(anchor: np.ndarray, around: np.ndarray, low: int, high: int, k: int = 0) -> np.ndarray:
    """Hash of the words that all windows which begin low to high words before an anchor have in common; another one for another k."""
    back = around.shape[1] // 2
    inside = around[:, [*range(back - high), *range(2 * back - low, 2 * back)]].astype(words.U64)
    return words.mix(words.mix((inside * words._GRAM_FACTORS[k : k + inside.shape[1]]).sum(axis=1, dtype=words.U64) + words.U64(low << 6 | high)) ^ anchor * words._GRAM_FACTORS[k])


def _combined(anchor: np.ndarray, around: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order of leaves by anchor and words, and which of them, in that order, agree in all words with a leaf of a smaller id."""
    order = np.lexsort((ids, (around.astype(words.U64) * words._GRAM_FACTORS[: around.shape[1]]).sum(axis=1, dtype=words.U64), anchor))
    anchor, around, ids = anchor[order], around[order], ids[order]
    first = _changes(anchor)
    first[1:] |= (around[1:] != around[:-1]).any(axis=1)
    starts = np.flatnonzero(first)
    return order, ids > np.repeat(ids[starts], np.diff(np.append(starts, len(ids))))


def _buckets(anchor: np.ndarray) -> np.ndarray:
    return (words.mix(anchor) >> words.U64(48)).astype(np.int64)


def _anchored(chunk: words.Chunk, window: int) -> tuple[np.ndarray, ...]:
    """For each anchor in its place: document within the chunk, anchor, first word, how far its windows go to the left, and how near the last one begins."""
    at, doc, anchor, place = _windows(chunk, window)
    starts = np.flatnonzero(_changes(doc, place))
    last = at[np.append(starts[1:], len(at)) - 1] if len(at) else starts
    return doc[starts], anchor[starts], place[starts], place[starts] - at[starts], place[starts] - last


def _counts(window: int):
    """(bucket, n): how many leaves the anchors of a bucket begin."""

    def run(batches):
        n = np.zeros(BUCKETS, dtype=np.int64)
        for batch in batches:
            _, valid, _ = _ids(batch)
            for chunk in words.chunks(batch.column(1)):
                doc, anchor, *_ = _anchored(chunk, window)
                n += np.bincount(_buckets(anchor[valid[chunk.first + doc]]), minlength=BUCKETS)
        some = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(n[some])], ["bucket", "n"])

    return run


_LEAF = "anchor long, around binary, id long, place long, mask long"


def _leaves(window: int, hot: np.ndarray):
    """(anchor, around, id, place, mask): suffixes at anchors. around: codes of the words that follow the anchor in its windows, the
    nearest first, and at the end of those before it, the nearest last; 0 for words that no window with this anchor has. place: hash of the text and place of the anchor.
    mask: the span of the leaf's windows.

    Of the leaves of a batch that agree in all words only the smallest id is a leaf; the others
    are repeats by that, and say so by a mask of the windows that they span. They go wherever their place sends them, and so
    do leaves of hot buckets, whose prefixes are lengthened before they meet; these have their anchor after the words around it."""
    back = window - ANCHOR_WORDS

    def run(batches):
        for batch in batches:
            ids, valid, hashes = _ids(batch)
            parts = []
            for chunk in words.chunks(batch.column(1)):
                doc, anchor, place, far, near = _anchored(chunk, window)
                known = valid[chunk.first + doc]
                doc, anchor, place, far, near = (x[known] for x in (doc, anchor, place, far, near))
                code = np.concatenate([np.maximum(chunk.hash >> words.U64(32), words.U64(1)).astype(np.uint32), np.zeros(1, np.uint32)])
                after, before = np.arange(back), np.arange(back, 0, -1)
                ahead = np.where(after < back - near[:, None], place[:, None] + ANCHOR_WORDS + after, len(code) - 1)
                behind = np.where(before <= far[:, None], place[:, None] - before, len(code) - 1)
                row = chunk.first + doc
                parts.append((anchor, code[np.concatenate([ahead, behind], axis=1)], ids[row], hashes[row] << 32 | place - chunk.word_from[doc]))
            if not parts:
                continue
            anchor, around, id_, place = (np.concatenate(x) for x in zip(*parts))
            order, repeat = _combined(anchor, around, id_)
            anchor, around, id_, place = anchor[order], around[order], id_[order], place[order]
            mask = np.where(repeat, _masks(around, 0, back), _span(0, back))
            apart = hot[_buckets(anchor)] & ~repeat
            for rows, dealt, told in (
                (np.flatnonzero(~repeat & ~apart), anchor.view(np.int64), around),
                (np.flatnonzero(apart), place, _with_anchor(around, anchor)),
                (np.flatnonzero(repeat & (mask > 0)), place, around[:, :0]),
            ):
                yield pa.RecordBatch.from_arrays([pa.array(dealt[rows]), _fixed(told[rows]), pa.array(id_[rows]), pa.array(place[rows]), pa.array(mask[rows])], ["anchor", "around", "id", "place", "mask"])

    return run


def _with_anchor(around: np.ndarray, anchor: np.ndarray) -> np.ndarray:
    return np.concatenate([around, anchor.view("<u4").reshape(-1, 2)], axis=1)


def _lengthened(window: int):
    """Leaves with their anchor in, leaves of both halves of their spans out: (anchor, around, id, place, mask, check). anchor is
    the hash of the longer prefix, and check, for prefixes that are windows, a second one. around holds the words of the half's windows, and the anchor."""
    back = window - ANCHOR_WORDS

    def halves(batch, span):
        rows = np.flatnonzero(batch.column(3).to_numpy() == span)
        batch = batch.take(pa.array(rows))
        low, high = -span >> 6, -span & 63
        middle = (low + high) // 2
        wide, ids, place = _matrix(batch.column(0), 2 * back + 2), batch.column(1).to_numpy(), batch.column(2).to_numpy()
        anchor = np.ascontiguousarray(wide[:, 2 * back :]).view("<u8")[:, 0]
        for lo, hi in ((low, middle), (middle + 1, high)):
            around = wide[:, : 2 * back].copy()
            around[:, back - lo : 2 * back - hi] = 0
            at = np.flatnonzero(_masks(around, lo, hi))
            if not len(at):
                continue
            order, repeat = _combined(anchor[at], around[at], ids[at])
            at = at[order]
            prefix = _prefixes(anchor[at], around[at], lo, hi).view(np.int64)
            check = pa.array(_prefixes(anchor[at], around[at], lo, hi, back).view(np.int64)) if lo == hi else pa.nulls(len(at), pa.int64())
            mask = np.where(repeat, _masks(around[at], lo, hi), 1 << lo if lo == hi else _span(lo, hi))
            told = np.flatnonzero(repeat)
            yield pa.RecordBatch.from_arrays([pa.array(place[at][told]), _fixed(around[:, :0][at][told]), pa.array(ids[at][told]), pa.array(place[at][told]), pa.array(mask[told]), pa.nulls(len(told), pa.int64())], _LONGER_NAMES)
            rest = np.flatnonzero(~repeat)
            # a prefix that is a window needs no words beside it
            kept = around[:, :0][at] if lo == hi else _with_anchor(around[at], anchor[at])
            yield pa.RecordBatch.from_arrays([pa.array(prefix[rest]), _fixed(kept[rest]), pa.array(ids[at][rest]), pa.array(place[at][rest]), pa.array(mask[rest]), check.take(pa.array(rest))], _LONGER_NAMES)

    def run(batches):
        for batch in batches:
            for span in np.unique(batch.column(3).to_numpy()).tolist():
                yield from halves(batch, span)

    return run


_LONGER = _LEAF + ", check long"
_LONGER_NAMES = ["anchor", "around", "id", "place", "mask", "check"]


def repeated_offsets(anchor: np.ndarray, around: np.ndarray, ids: np.ndarray, span: np.ndarray) -> np.ndarray:
    """For each leaf of whole groups, sorted by prefix and words: bit o says that the window which begins o words before it is also in a document with a smaller id.

    Neighbours' common prefixes cut the sorted leaves into the nodes of each depth. A window with o words to the left
    of the anchor is a node of depth window - o, told apart by those o words."""
    back = around.shape[1] // 2
    right, left = around[:, :back], around[:, : back - 1 : -1]
    # common words after the anchor; -1 where it changes
    common = np.full(len(ids), -1, dtype=np.int64)
    common[1:] = np.where(anchor[1:] == anchor[:-1], np.cumprod(right[1:] == right[:-1], axis=1).sum(axis=1), -1)
    mask, before = np.zeros(len(ids), dtype=np.int64), np.zeros(len(ids), dtype=words.U64)
    low, high = -span >> 6, -span & 63
    for o in range(back + 1):
        if o:
            before = words.mix(before + left[:, o - 1].astype(words.U64) * words._GRAM_FACTORS[o])
        at = np.flatnonzero(_whole(around, o) & (low <= o) & (o <= high))
        if not len(at):
            continue
        node = np.cumsum(common < back - o)[at]
        if o:
            order = np.lexsort((before[at], node))
            at, node = at[order], node[order]
        starts = np.flatnonzero(_changes(node, before[at]))
        least = np.repeat(np.minimum.reduceat(ids[at], starts), np.diff(np.append(starts, len(at))))
        mask[at[ids[at] > least]] |= 1 << o
    return mask


_FOUND = "around binary, id long, place long, mask long"


def _found(ids: np.ndarray, place: np.ndarray, mask: np.ndarray, around: pa.Array | None = None) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.nulls(len(ids), pa.binary()) if around is None else around, pa.array(ids), pa.array(place), pa.array(mask)], ["around", "id", "place", "mask"])


def _subtrees(window: int, group_leaves: int, with_anchor: bool):
    """Sorted leaves in; (around, id, place, mask) of those with a repeat out. The group that is still open is carried from batch to
    batch; if it exceeds group_leaves, its leaves come out with their anchor and their spans, for longer prefixes. with_anchor: leaves have their anchors after the words around them;
    those that do where others don't come out too."""
    back = window - ANCHOR_WORDS
    width = 2 * back + 2 * with_anchor

    def marked(parts):
        anchor, ids, place, span = (np.concatenate([b.column(k).to_numpy() for b in parts]) for k in (0, 2, 3, 4))
        around = np.concatenate([_matrix(b.column(1), width)[:, : 2 * back] for b in parts])
        mask = repeated_offsets(anchor, around, ids, span)
        some = np.flatnonzero(mask)
        return _found(ids[some], place[some], mask[some])

    def passed_on(batch):
        around = batch.column(1) if with_anchor else _fixed(_with_anchor(_matrix(batch.column(1), width), batch.column(0).to_numpy()))
        return _found(*(batch.column(k).to_numpy() for k in (2, 3, 4)), around)

    def run(batches):
        parts, flooded = [], None
        for batch in batches:
            mask, size = batch.column(4).to_numpy(), np.diff(np.frombuffer(batch.column(1).buffers()[1], dtype=np.int32, count=batch.column(1).offset + batch.num_rows + 1)[batch.column(1).offset :])
            told = np.flatnonzero(mask > 0)
            if len(told):
                yield _found(batch.column(2).to_numpy()[told], batch.column(3).to_numpy()[told], mask[told])
            apart = np.flatnonzero((mask <= 0) & (size != 4 * width))
            if len(apart):
                hot = batch.take(pa.array(apart))
                yield _found(*(hot.column(k).to_numpy() for k in (2, 3, 4)), hot.column(1))
            if len(told) or len(apart):
                batch = batch.take(pa.array(np.flatnonzero((mask <= 0) & (size == 4 * width))))
            if not batch.num_rows:
                continue
            anchor = batch.column(0).to_numpy()
            if flooded is not None:
                to = int(np.searchsorted(anchor, flooded, side="right"))
                if to:
                    yield passed_on(batch.slice(0, to))
                if to == len(anchor):
                    continue
                batch, anchor, flooded = batch.slice(to), anchor[to:], None
            last = int(np.searchsorted(anchor, anchor[-1]))
            if parts and (last or parts[-1].column(0)[-1].as_py() != anchor[0]):
                # all groups but the batch's last one are whole
                yield marked(parts + [batch.slice(0, last)] if last else parts)
                parts = []
            elif last:
                yield marked([batch.slice(0, last)])
            parts.append(batch.slice(last))
            if sum(b.num_rows for b in parts) > group_leaves:
                yield from map(passed_on, parts)
                parts, flooded = [], anchor[-1]
        if parts:
            yield marked(parts)

    return run


def _gone(n: int, window: int, marks: np.ndarray) -> np.ndarray:
    """Which of n words a marked window covers. marks: (at, mask) pairs."""
    cover = np.zeros(n + 1, dtype=np.int64)
    for o in range(window - ANCHOR_WORDS + 1):
        starts = marks[marks[:, 1] >> o & 1 == 1, 0] - o
        np.add.at(cover, starts, 1)
        np.add.at(cover, starts + window, -1)
    return np.cumsum(cover[:-1]) > 0


def _kept(window: int, with_text: bool):
    """What is left of each text: (id, text, marks) in, marks being null or a flat list of (at, mask) pairs."""

    def run(batches):
        for batch in batches:
            at, data = words.string_buffers(batch.column(1))
            rows = []
            for i in range(batch.num_rows):
                kept = data[at[i] : at[i + 1]].tobytes().split()
                n, mine = len(kept), batch.column(2)[i]
                if mine.is_valid:
                    gone = _gone(n, window, mine.values.to_numpy(zero_copy_only=False).reshape(-1, 2))
                    kept = [w for w, g in zip(kept, gone.tolist()) if not g]
                joined = b" ".join(kept)
                rows.append((n, n - len(kept), joined if with_text else hashlib.sha256(joined).hexdigest()))
            n, removed, last = zip(*rows) if rows else ((), (), ())
            last = pa.array([x.decode() for x in last] if with_text else last, pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), last], ["id", "n_words", "n_removed", "kept"])

    return run


def _passages(window: int):
    """Runs of words that marked windows cover: (id, text, marks) in, (id, start, n_words, passage) out."""

    def run(batches):
        for batch in batches:
            at, data = words.string_buffers(batch.column(1))
            rows = []
            for i in range(batch.num_rows):
                said = data[at[i] : at[i + 1]].tobytes().split()
                gone = np.concatenate([[False], _gone(len(said), window, batch.column(2)[i].values.to_numpy(zero_copy_only=False).reshape(-1, 2)), [False]])
                edges = np.flatnonzero(gone[1:] != gone[:-1]).reshape(-1, 2).tolist()
                rows += [(batch.column(0)[i].as_py(), start, end - start, b" ".join(said[start:end]).decode()) for start, end in edges]
            yield pa.RecordBatch.from_pylist([dict(zip(("id", "start", "n_words", "passage"), r)) for r in rows], pa.schema([("id", pa.int64()), ("start", pa.int64()), ("n_words", pa.int64()), ("passage", pa.string())]))

    return run


def _marks(given: DataFrame, window: int, group_leaves: int) -> DataFrame:
    """(id, place, mask) of the leaves with windows that a document with a smaller id has too."""
    share = min(HOT_SHARE, 2 * int(given.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    # a row for each of the buckets at most
    counted = given.mapInArrow(_counts(window), "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toPandas()
    hot = np.zeros(BUCKETS, dtype=bool)
    hot[counted["bucket"][counted["n"] > max(group_leaves, counted["n"].sum() // share)].to_numpy(dtype=np.int64)] = True

    def subtrees(leaves, with_anchor):
        # what most rows have in common stands together, so that shuffled blocks compress by a few bytes a row more
        dealt = leaves.select("mask", "around", "anchor", "id", "place").repartition("anchor").sortWithinPartitions("anchor", "around")
        return materialize(dealt.select("anchor", "around", "id", "place", "mask").mapInArrow(_subtrees(window, group_leaves, with_anchor), _FOUND), "repeats")

    found = subtrees(given.mapInArrow(_leaves(window, hot), _LEAF), False)
    marks, rest, nodes = found.where("mask > 0").select("id", "place", "mask"), found.where("mask <= 0"), []
    # spans are halved: four times for windows of 13 words
    while not rest.isEmpty():
        longer = materialize(rest.mapInArrow(_lengthened(window), _LONGER), "prefixes")
        marks = marks.union(longer.where("mask > 0 and check is null").select("id", "place", "mask"))
        nodes.append(longer.where("check is not null"))
        open_ = longer.where("mask <= 0").drop("check")
        n = open_.count()
        # fewer than share
        many = materialize(open_.groupBy("anchor").count().where(F.col("count") > max(group_leaves, n // share)).select("anchor", F.lit(True).alias("many")), "many")
        told = open_.join(F.broadcast(many), "anchor", "left")
        found = subtrees(told.where("many is null").drop("many"), True)
        marks = marks.union(found.where("mask > 0").select("id", "place", "mask"))
        rest = told.where("many").select("around", "id", "place", "mask").union(found.where("mask <= 0"))
    if nodes:
        # prefixes that are windows are one node each
        leaves = nodes[0]
        for more in nodes[1:]:
            leaves = leaves.union(more)
        low = materialize(leaves.groupBy("anchor", "check").agg(F.min("id").alias("low"), F.max("id").alias("high"), F.count("*").alias("n")).where("low < high").drop("high"), "nodes")
        marks = marks.union(join_hot(leaves, low, ["anchor", "check"], "n", leaves.count(), F.col("id") > F.col("low")).select("id", "place", "mask"))
    return marks


def _marked(docs: DataFrame, id_col: str, text_col: str, window: int, group_leaves: int, how: str) -> DataFrame:
    """(id, text, marks): marks is a flat list of (place, mask) pairs."""
    bound_batches(docs.sparkSession)
    text = F.col(text_col).cast("string")
    given = docs.select(F.col(id_col).cast("long").alias("id"), text.alias("text"), F.pmod(F.xxhash64(text), F.lit(1 << 31)).alias("hash"))
    at = F.col("place").bitwiseAND(F.lit((1 << 32) - 1))
    by_text = _marks(given, window, group_leaves).groupBy("id", F.shiftright("place", 32).alias("hash")).agg(F.flatten(F.collect_list(F.array(at, "mask"))).alias("marks"))
    return given.join(by_text, ["id", "hash"], how).select("id", "text", "marks")


def repeated_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 13, group_leaves: int = GROUP_LEAVES) -> DataFrame:
    """The passages that ``without_repeats`` removes: (id_col, start, n_words, passage), longest runs of a document's words in windows that a document with a smaller id has too.

    start counts words from 0; words are joined by one space. Documents without such a passage have no row, so null, empty and short texts,
    rows without an id and empty tables give none. Rows with the same id and text have equal rows each."""
    out = _marked(docs, id_col, text_col, window, group_leaves, "inner").mapInArrow(_passages(window), "id long, start long, n_words long, passage string")
    return out.withColumnRenamed("id", id_col)


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 13, with_text: bool = False, group_leaves: int = GROUP_LEAVES) -> DataFrame:
    """Documents without passages of window words or more that occur in a document with a smaller id.

    (id_col, n_words, n_removed, kept_text or kept_sha256), a row per row of docs. A word goes if any
    window that covers it also starts in a document with a smaller id; windows are judged on the
    input. Kept words are joined by one space. Words are runs of characters other than space and
    0x09-0x0D, unchanged; a null text has none. Texts with fewer words than a window stay whole, and so
    do rows without an id, which also take nothing from others. Rows that share an id are one document: none loses a passage to another.
    Other columns of docs are not looked at. window: from 6 to 30 words.

    Anchors are compared by a hash of 64 bits, the words around them by 32 bits each: windows with a common anchor that differ in one
    word are taken for equal with a chance of 2 ** -32. The driver sees the counts of BUCKETS hash values only. A prefix with over group_leaves
    leaves is lengthened, before leaves meet where it has over 1 / HOT_SHARE of all (or half a partition's share).
    """
    marked = _marked(docs, id_col, text_col, window, group_leaves, "left")
    out = marked.mapInArrow(_kept(window, with_text), "id long, n_words long, n_removed long, kept string")
    return out.select(F.col("id").alias(id_col), "n_words", "n_removed", F.col("kept").alias("kept_text" if with_text else "kept_sha256"))
