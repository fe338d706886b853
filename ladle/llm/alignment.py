"""Which tokens of one tokenizer stand for which of another.

A text is encoded by both, the bytes of their tokens are laid side by side, and offsets where tokens of
both end cut them into groups. A group of one token each whose bytes the identity map leads to each other is
counted in a vector as long as the vocabulary; only the links of other groups are pairs that Spark shuffles.
"""

from __future__ import annotations

import functools
import hashlib
import json
import os
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ladle.llm.storage import bound_batches, materialize

#: Units (a space and what follows it up to the next) whose tokens a worker remembers: as many that it met of late, and as many from before.
CACHE_UNITS = 300_000
#: A longer unit, in characters, is encoded each time it comes.
UNIT_CHARS = 64
#: Units up to so many characters are encoded from ranks, whose time grows with the square of a word.
FAST_CHARS = 512
#: Texts of so many characters in all are handled at a time.
CHUNK_CHARS = 1 << 19
#: Distinct irregular pairs of a task's documents that are counted before they are given out.
TASK_PAIRS = 500_000
#: The most frequent irregular pairs whose counts go to every task (16 bytes each); counts of all others are joined.
HOT_PAIRS = 500_000

#: Neither tokenizer has a token with something other than spaces before a space.
_UNIT, _RUN = re.compile(r"(?<=\S) "), re.compile(r"\s ")
#: A link is a number: the A id from bit 32 on, the B id below, and what else is known of it in the topmost bits.
IRREGULAR, NEW_A, NEW_B = (np.uint64(1 << k) for k in (63, 62, 61))
_LOW, _IDS = np.uint64(0xFFFFFFFF), np.uint64((1 << 61) - 1)


def byte_level() -> dict[str, int]:
    """The byte that each letter of a byte-level vocabulary stands for: printable bytes themselves, the others from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = sorted(set(range(256)).difference(plain))
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class Aligner:
    """Encodes units with both tokenizers and aligns their tokens.

    A: a byte-level BPE of the tokenizers library; B: a sentencepiece BPE that puts a space before a text. If B has a
    piece in which a space follows something else, or A isn't split at spaces, texts are encoded whole. Where A's merges
    have rising ids, units are encoded from the ranks of its vocabulary, many in one call."""

    def __init__(self, a_path: str, b_path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(a_path)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        letters = byte_level()
        own = {i: bytes(letters[c] for c in t) if all(c in letters for c in t) else t.encode() for t, i in self.a.get_vocab(with_added_tokens=True).items()}
        self.a_bytes = [own.get(i, b"") for i in range(max(own) + 1)]
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.a_length, self.b_length = (np.array([len(t) for t in x], np.int64) for x in (self.a_bytes, self.b_bytes))
        # the same bytes may be a piece and a byte; the piece is what texts are mostly encoded as
        usual = [i for i in range(len(pieces)) if not (self.b.is_control(i) or self.b.is_unknown(i))]
        by_bytes = {self.b_bytes[i]: i for i in sorted(usual, key=lambda i: (not self.b.is_byte(i), -i))}
        self.same = np.array([by_bytes.get(t, -1) for t in self.a_bytes], np.int64)
        with open(a_path, encoding="utf-8") as f:
            stored = json.load(f)
        before = stored.get("pre_tokenizer") or {}
        splits = before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space") and not stored.get("normalizer")
        self.by_units = bool(splits) and not any("▁" in p.lstrip("▁") for p in pieces)
        self.fast = self._ranked(stored["model"]) if self.by_units else None
        self.space = self.b.piece_to_id("▁")
        signs = [(self.a_bytes, ",|"), (self.b_bytes, ",;\n")]
        #: Every id in decimals with each sign that may follow it; the rows of A, then those of B.
        self.written = np.array([f"{i}{sign}" for x, own in signs for sign in own for i in range(len(x))], object)
        self.recent: dict[str, tuple | None] = {}
        self.older: dict[str, tuple | None] = {}

    def _ranked(self, model: dict):
        """An encoder of long strings of short units, if the order of merges is that of ids."""
        import public_tokenizers
        import tiktoken

        ids = [model["vocab"]["".join(m if isinstance(m, list) else m.split(" "))] for m in model["merges"]]
        if ids != sorted(ids) or model.get("ignore_merges") or model.get("dropout"):
            return None
        added = set(self.a.get_added_tokens_decoder())
        return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks={t: i for i, t in enumerate(self.a_bytes) if t and i not in added}, special_tokens={}).encode_ordinary

    def _encoded(self, units: list[str]) -> tuple[np.ndarray, np.ndarray]:
        if self.fast is not None and max(map(len, units)) <= FAST_CHARS:
            a = self.fast(" " + " ".join(units))
        else:
            a = [i for e in self.a.encode_batch_fast([" " + u for u in units], add_special_tokens=False) for i in e.ids]
        # an empty unit is the space alone
        b = [i for u, x in zip(units, self.b.encode(units, num_threads=1)) for i in (x if u else [self.space])]
        return np.array(a, np.int64), np.array(b, np.int64)

    def aligned(self, units: list[str]) -> list[tuple | None]:
        """Of each unit, a space and its text: (its groups as text, its links packed); None if the bytes of its tokens aren't those of the unit."""
        raw = [b" " + u.encode() for u in units]
        a_ids, b_ids = self._encoded(units)
        whole = b"".join(raw)
        if b"".join([self.a_bytes[i] for i in a_ids.tolist()]) != whole or b"".join([self.b_bytes[i] for i in b_ids.tolist()]) != whole:
            if len(units) == 1:
                return [None]
            half = len(units) // 2
            return self.aligned(units[:half]) + self.aligned(units[half:])
        a_end, b_end = np.cumsum(self.a_length[a_ids]), np.cumsum(self.b_length[b_ids])
        unit_end = np.cumsum([len(r) for r in raw])
        # between two neighbouring ends of either tokenizer lies one overlap of an A token with a B token
        ends = np.sort(np.concatenate([a_end, b_end]))
        cut = ends[1:] == ends[:-1]
        cuts = ends[1:][cut]
        ends = ends[np.append(~cut, True)]
        link_a, link_b = np.searchsorted(a_end, ends), np.searchsorted(b_end, ends)
        group_a, group_b = np.searchsorted(cuts, a_end), np.searchsorted(cuts, b_end)
        alone = (np.bincount(group_a) == 1) & (np.bincount(group_b) == 1)
        links = (a_ids[link_a] << 32 | b_ids[link_b]).astype(np.uint64)
        links[~(alone[group_a[link_a]] & (self.same[a_ids[link_a]] == b_ids[link_b]))] |= IRREGULAR
        links[np.append(True, link_a[1:] != link_a[:-1])] |= NEW_A
        links[np.append(True, link_b[1:] != link_b[:-1])] |= NEW_B
        # tokens in the order of the text: of each group those of A, then those of B
        a_last, b_last = np.append(group_a[1:] != group_a[:-1], True), np.append(group_b[1:] != group_b[:-1], True)
        rows = 2 * len(self.a_bytes)
        last_of_unit = unit_end[np.searchsorted(unit_end, b_end)] == b_end
        written = np.concatenate([a_ids + len(self.a_bytes) * a_last, rows + b_ids + len(self.b_bytes) * (b_last.astype(np.int64) + last_of_unit)])
        order = np.argsort(np.concatenate([2 * group_a, 2 * group_b + 1]), kind="stable")
        texts = "".join(self.written[written[order]].tolist()).split("\n")
        data, to = links.tobytes(), ((np.searchsorted(ends, unit_end) + 1) * 8).tolist()
        return [(t, data[p:q]) for t, p, q in zip(texts, [0, *to], to)]

    def texts(self, texts: list[str]) -> list[tuple[str, bytes]]:
        """Of each text the same as of a unit; empty where the tokens' bytes aren't the text's, or there is no text."""
        if len(self.recent) > CACHE_UNITS:
            self.recent, self.older = {}, self.recent
        split = [([t] if not self.by_units else _UNIT.split(t) if t[0] == " " or _RUN.search(t) else t.split(" ")) if t else [] for t in texts]
        known, older, passing = self.recent, self.older, {}
        short, long = [], []
        for u in set().union(*split).difference(known):
            if u in older:
                known[u] = older[u]
            else:
                (short if len(u) <= UNIT_CHARS else long).append(u)
        for new, into in ((short, known), (long, passing)):
            at = 0
            while at < len(new):
                to, size = at, 0
                while to < len(new) and size < CHUNK_CHARS:
                    size += len(new[to]) + 16
                    to += 1
                into.update(zip(new[at:to], self.aligned(new[at:to])))
                at = to
        look = (lambda u: known[u] if u in known else passing[u]) if passing else known.__getitem__
        out = []
        for text, units in zip(texts, split):
            found = list(map(look, units))
            if None in found:
                # bytes may have moved between units: the whole text decides
                found = [x for x in self.aligned([text]) if x]
            out.append((";".join([x[0] for x in found]), b"".join([x[1] for x in found])))
        return out


@functools.lru_cache(maxsize=2)
def aligner(a_path: str, b_path: str) -> Aligner:
    """The aligner of a worker process, which keeps it from task to task."""
    return Aligner(a_path, b_path)


class _Pairs:
    """Counts of pairs, held as sorted arrays; new ones are merged in when there are many."""

    def __init__(self):
        self.keys, self.counts, self.waiting, self.n = np.empty(0, np.uint64), np.empty(0, np.int64), [], 0

    def add(self, keys: np.ndarray) -> None:
        self.waiting.append(keys)
        self.n += len(keys)
        if self.n > 2 * TASK_PAIRS:
            self.merge()

    def merge(self) -> None:
        if self.n:
            keys, counts = np.unique(np.concatenate(self.waiting), return_counts=True)
            both = np.concatenate([self.keys, keys])
            self.keys, at = np.unique(both, return_inverse=True)
            self.counts = np.bincount(at, weights=np.concatenate([self.counts, counts]).astype(float), minlength=len(self.keys)).astype(np.int64)
            self.waiting, self.n = [], 0

    def take(self) -> tuple[np.ndarray, np.ndarray]:
        self.merge()
        out = self.keys, self.counts
        self.keys, self.counts = np.empty(0, np.uint64), np.empty(0, np.int64)
        return out


def _packed(values: np.ndarray, lengths: np.ndarray) -> pa.Array:
    """The values of each row as bytes."""
    data, to = values.tobytes(), (np.cumsum(lengths) * values.itemsize).tolist()
    return pa.array([data[p:q] for p, q in zip([0, *to], to)], pa.binary())


_COUNTED = ["n_a", "n_b", "n_groups", "n_links", "groups_sha256"]


def _encode(a_path: str, b_path: str, id_kind: pa.DataType):
    """Rows of documents, and at the end of a partition rows of pair counts."""
    fields = ["row", "id", *_COUNTED, "regular", "irregular", "a", "b", "n"]
    kinds = [pa.int64(), id_kind] + [pa.int64()] * 4 + [pa.string(), pa.binary(), pa.binary()]

    def with_counts(keys: np.ndarray, counts: np.ndarray, same: np.ndarray, plain: np.ndarray):
        used = np.flatnonzero(plain)
        a = np.concatenate([used, (keys >> np.uint64(32)).astype(np.int64)])
        b = np.concatenate([same[used], (keys & _LOW).astype(np.int64)])
        n = np.concatenate([plain[used], counts])
        for k in range(0, len(a), 50_000):
            some = [pa.array(x[k : k + 50_000]) for x in (a, b, n)]
            yield pa.RecordBatch.from_arrays([pa.nulls(len(some[0]), t) for t in kinds] + some, fields)

    def run(batches):
        own = aligner(a_path, b_path)
        plain, pairs = np.zeros(len(own.same), np.int64), _Pairs()
        for batch in batches:
            texts, at = batch.column(2).to_pylist(), 0
            while at < len(texts):
                to, size = at, 0
                while to < len(texts) and size < CHUNK_CHARS:
                    size += len(texts[to] or "") + 64
                    to += 1
                found = own.texts([t or "" for t in texts[at:to]])
                links = np.frombuffer(b"".join([f[1] for f in found]), np.uint64)
                n_links = np.array([len(f[1]) // 8 for f in found])
                ends = np.cumsum(n_links)
                n_a, n_b, n_irregular = (np.diff(np.append(0, np.cumsum((links & flag) != 0))[np.append(0, ends)]) for flag in (NEW_A, NEW_B, IRREGULAR))
                odd = (links & IRREGULAR) != 0
                regular, irregular = ((links[~odd] & _IDS) >> np.uint64(32)).astype("<u4"), links[odd] & _IDS
                plain += np.bincount(regular, minlength=len(plain))
                pairs.add(irregular)
                hashes = [hashlib.sha256(f[0].encode()).hexdigest() if f[0] else "" for f in found]
                counts = [pa.array(x.astype(np.int64)) for x in (n_a, n_b, n_a + n_b - n_links, n_links)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(at, to - at), batch.column(1).slice(at, to - at).cast(id_kind), *counts, pa.array(hashes), _packed(regular, n_links - n_irregular), _packed(irregular, n_irregular), *(pa.nulls(to - at, pa.int64()) for _ in range(3))],
                    fields,
                )
                at = to
            if len(pairs.keys) > TASK_PAIRS:
                yield from with_counts(*pairs.take(), own.same, plain * 0)
        yield from with_counts(*pairs.take(), own.same, plain)

    return run


def _score(known):
    """Adds to a document's row the sums over its links that every task can tell: those of the identity map's pairs and of the hot ones.
    The other pairs go on, each with how often the document links it."""

    def rated(plain: np.ndarray, keys: np.ndarray) -> tuple[int, int, list[int], list[int]]:
        of_a, same, best, hot, hot_n = known.value
        n = of_a[plain]
        count_sum, n_best = int(n.sum()), int((n == best[same[plain]]).sum())
        at = np.searchsorted(hot, keys)
        met = at < len(hot)
        met[met] = hot[at[met]] == keys[met]
        n = hot_n[at[met]]
        cold, times = np.unique(keys[~met], return_counts=True)
        return count_sum + int(n.sum()), n_best + int((n == best[(keys[met] & _LOW).astype(np.int64)]).sum()), cold.astype(np.int64).tolist(), times.tolist()

    def run(batches):
        lists = pa.list_(pa.int64())
        for batch in batches:
            found = [rated(np.frombuffer(p.as_buffer(), "<u4"), np.frombuffer(q.as_buffer(), "<u8")) for p, q in zip(batch.column("regular"), batch.column("irregular"))]
            new = [pa.array([x[k] for x in found], t) for k, t in enumerate((pa.int64(), pa.int64(), lists, lists))]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("row", "id", *_COUNTED)), *new], ["row", "id", *_COUNTED, "known_sum", "known_best", "cold", "times"])

    return run


def _counts(encoded: DataFrame) -> DataFrame:
    """(a, b, n): the links of each pair of ids over all documents."""
    return encoded.where("row is null").groupBy("a", "b").agg(F.sum("n").alias("n"))


def _pair():
    return F.shiftleft("a", 32).bitwiseOR(F.col("b"))


def _hot(pairs: DataFrame) -> int:
    """The count from which on a pair is hot, so that there are HOT_PAIRS of them at most."""
    sizes = pairs.groupBy(F.floor(F.log2("n") * 8).alias("size")).agg(F.count("*").alias("pairs"), F.min("n").alias("n")).orderBy(F.desc("size")).collect()
    total, least = 0, 1 << 62
    for row in sizes:
        total += row["pairs"]
        if total > HOT_PAIRS:
            break
        least = row["n"]
    return least


def align(docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(documents, pairs): the aligned tokens of each text, and how often each pair of ids is linked.

    A text is encoded as a space and the text. documents has a row per row of docs: (id_col, n_a, n_b, n_groups, n_links, n_best, count_sum,
    groups_sha256): tokens of A and of B, groups, overlapping A-B pairs of tokens, those of them whose pair has the most links of all
    with its B id (ties count), the sum over links of their pair's links, and the hash of ``a1,a2|b1;a3|b2``. pairs is (a, b, n). A null or empty text, and one whose bytes
    the tokens of A or B do not give back, has zeros and an empty string, and links nothing. Ids may repeat or be null; other columns are not looked at.
    Strings of special tokens in a text are plain text.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    given = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = given.schema["id"].dataType
    of_documents = f"row long, id {kind.simpleString()}, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string"
    encoded = materialize(given.mapInArrow(_encode(a_path, b_path, to_arrow_type(kind)), f"{of_documents}, regular binary, irregular binary, a long, b long, n long"), "aligned")
    pairs = materialize(_counts(encoded), "pair_counts")
    own = aligner(a_path, b_path)
    hot_from = _hot(pairs)
    same = own.same
    of_a, best = np.zeros(len(same), np.int64), np.zeros(len(own.b_bytes), np.int64)
    # a row per id of a vocabulary at most
    identity = spark.createDataFrame([(int(a), int(b)) for a, b in enumerate(same) if b >= 0], "a long, b long")
    for row in pairs.join(F.broadcast(identity), ["a", "b"], "left_semi").select("a", "n").toArrow().to_batches():
        of_a[row.column(0).to_numpy()] = row.column(1).to_numpy()
    for row in pairs.groupBy("b").agg(F.max("n").alias("n")).toArrow().to_batches():
        best[row.column(0).to_numpy()] = row.column(1).to_numpy()
    common = pairs.where(F.col("n") >= hot_from).select(_pair().alias("pair"), "n").toArrow()
    hot, hot_n = (common.column(k).to_numpy() for k in range(2))
    order = np.argsort(hot)
    known = spark.sparkContext.broadcast((of_a, same, best, hot[order].astype(np.uint64), hot_n[order]))
    scored = encoded.where("row is not null").mapInArrow(_score(known), f"{of_documents}, known_sum long, known_best long, cold array<long>, times array<long>")
    most = pairs.groupBy("b").agg(F.max("n").alias("most"))
    rare = pairs.where(F.col("n") < hot_from)
    found = scored.drop("cold", "times").withColumns({"rest_sum": F.lit(0), "rest_best": F.lit(0)})
    if not rare.isEmpty():
        rated = rare.join(F.broadcast(most), "b").select(_pair().alias("pair"), "n", (F.col("n") == F.col("most")).cast("long").alias("is_best"))
        cold = scored.select("row", F.explode(F.arrays_zip("cold", "times")).alias("x")).select("row", F.col("x.cold").alias("pair"), F.col("x.times").alias("times"))
        rest = cold.join(rated.hint("merge"), "pair").groupBy("row").agg(F.sum(F.col("times") * F.col("n")).alias("rest_sum"), F.sum(F.col("times") * F.col("is_best")).alias("rest_best"))
        found = scored.drop("cold", "times").join(rest.hint("merge"), "row", "left")
    n_best, count_sum = (F.col(f"known_{k}") + F.coalesce(F.col(f"rest_{k}"), F.lit(0)) for k in ("best", "sum"))
    return found.select(F.col("id").alias(id_col), "n_a", "n_b", "n_groups", "n_links", n_best.alias("n_best"), count_sum.alias("count_sum"), "groups_sha256"), pairs
