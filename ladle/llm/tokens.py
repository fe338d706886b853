"""Token ids of texts, and the tokens of each part of a document.

``WordEncoder`` encodes with the tokenizers library, word by word through a cache: a vocabulary whose
pieces never cross white space gives a text the concatenation of its words' ids.
``attribute_tokens`` encodes a whole document once, maps each token to the characters it covers, and
joins these spans with the spans of the document's parts.
"""

from __future__ import annotations

import base64
import functools
import os

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ladle.llm.storage import bound_batches, give_back

#: Words whose ids a worker remembers: as many that it met of late, and as many from before.
CACHE_WORDS = 300_000
#: Punctuation that may close a word; an apostrophe may belong to it.
_CLOSING = bytes(b for b in range(33, 127) if not chr(b).isalnum() and b != 0x27)
#: New words that are encoded in one call.
WORDS_PER_CALL = 300

#: Who gets a token that covers characters of several parts.
RULES = ("first", "last", "largest")


class WordEncoder:
    """Ids of words, as little-endian integers of width bytes, from a cache of words met before: cache_words (CACHE_WORDS if None) or more that it met of late, and as many from before.

    The tokenizer must drop white space, as word_bpe_49k does: its pieces lie within words, so that
    encoding the words gives what encoding the text gives."""

    def __init__(self, tokenizer_path: str, width: int = 2, cache_words: int | None = None):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(tokenizer_path)
        give_back()  # what parsing the file took
        self.cache_words = cache_words
        self.width, self.kind = width, f"<u{width}"
        added = self.tokenizer.get_added_tokens_decoder()
        self.added = {t.content: i for i, t in added.items()}
        self.marks = [c.lower().encode() for c in self.added]
        # a special token between words keeps their ids apart in the encoding of many
        self.between = next((t.content for t in added.values() if t.special), None)
        normalizer = self.tokenizer.normalizer
        self.lowers = normalizer is not None and normalizer.normalize_str("A") == "a"
        self.recent: dict[bytes, bytes] = {}
        self.older: dict[bytes, bytes] = {}

    def words(self, text: bytes) -> list[bytes]:
        """The words of a text; in lower case if that makes no difference.

        A-Z compose with combining marks from U+0300 to U+037F only, whose first byte is CC or CD, and not
        always as a-z do: W and U+030A stay two characters, w and U+030A become one."""
        lower = text.lower() if self.lowers and b"\xcc" not in text and b"\xcd" not in text else text
        return (text if any(m in lower.lower() for m in self.marks) else lower).split()

    def ids(self, texts: list[list[bytes]]) -> dict[bytes, bytes]:
        """A dict that has the ids of all words of these texts, and of others."""
        if len(self.recent) > (self.cache_words or CACHE_WORDS):
            self.recent, self.older = {}, self.recent
        recent, older = self.recent, self.older
        missing = []
        for w in set().union(*texts).difference(recent):
            if w in older:
                recent[w] = older[w]
            else:
                missing.append(w)
        if missing:
            self._resolve(missing)
        return recent

    def _resolve(self, missing: list[bytes]) -> None:
        """Words of letters with closing punctuation have the ids of both: pieces end between them.

        That holds for the letters of Latin-1, which normalisation maps to one letter each; others may
        become a letter with a mark, which makes one piece with the punctuation."""
        recent, split, new = self.recent, [], set()
        for w in missing:
            p = w.rstrip(_CLOSING)
            if p and len(p) < len(w) and (p.isalpha() or ((t := p.decode()).isalpha() and max(t) < "\u0100")):
                split.append((w, p, w[len(p) :]))
                new.update(split[-1][1:])
            else:
                new.add(w)
        self._encode(list(new.difference(recent)))
        recent.update((w, recent[p] + recent[q]) for w, p, q in split)

    def _encode(self, words: list[bytes]) -> None:
        for at in range(0, len(words), WORDS_PER_CALL):
            some = words[at : at + WORDS_PER_CALL]
            texts = b"\n".join(some).decode().split("\n")
            if self.between is None or any(c in t for c in self.added for t in texts):
                self.recent.update((w, np.array(self.tokenizer.encode(t, add_special_tokens=False).ids, dtype=self.kind).tobytes()) for w, t in zip(some, texts))
                continue
            ids = np.array(self.tokenizer.encode_batch_fast([self.between.join(texts)], add_special_tokens=False)[0].ids)
            ends = np.append(np.flatnonzero(ids == self.added[self.between]), len(ids)) * self.width
            data, starts = ids.astype(self.kind).tobytes(), [0, *(ends[:-1] + self.width).tolist()]
            self.recent.update((w, data[a:b]) for w, a, b in zip(some, starts, ends.tolist()))


@functools.lru_cache(maxsize=2)
def word_encoder(tokenizer_path: str, width: int = 2, cache_words: int | None = None) -> WordEncoder:
    """The encoder of a worker process, which keeps it from task to task."""
    return WordEncoder(tokenizer_path, width, cache_words)


def vocabulary_size(tokenizer_path: str) -> int:
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenizer_path).get_vocab_size()


@functools.lru_cache(maxsize=4)
def _byte_encoder(ranks_path: str, pattern: str):
    """(encode a text to ids, length in bytes of each id) for a file of byte-pair ranks."""
    import tiktoken

    with open(ranks_path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    lengths = np.zeros(max(ranks.values()) + 1, dtype=np.int64)
    for token, rank in ranks.items():
        lengths[rank] = len(token)
    encoding = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    return encoding.encode_ordinary, lengths


def allocate(token_ends: np.ndarray, part_starts: np.ndarray, rule: str) -> np.ndarray:
    """The part of each token. token_ends: where tokens end, from 0 on without gaps; part_starts: where parts begin, the first at 0.

    A token belongs to the part of its first byte (``first``), of its last byte (``last``), or to the
    part that has most of its bytes, the earlier one in a tie (``largest``)."""
    starts = np.concatenate([token_ends[:1] * 0, token_ends[:-1]])
    first = np.searchsorted(part_starts, starts, side="right") - 1
    if rule == "first":
        return first
    last = np.searchsorted(part_starts, token_ends - 1, side="right") - 1
    if rule == "last":
        return last
    best = first.copy()
    for i in np.flatnonzero(first != last):
        edges = np.clip(np.append(part_starts[first[i] : last[i] + 1], token_ends[i]), starts[i], token_ends[i])
        best[i] = first[i] + int(np.argmax(np.diff(edges)))
    return best


def _attributed(ranks_path: str, pattern: str, rule: str, n_fields: int):
    def run(batches):
        encode, lengths = _byte_encoder(ranks_path, pattern)
        for batch in batches:
            columns = [batch.column(1 + k) for k in range(n_fields)]
            for at in range(0, batch.num_rows, 64):
                rows = range(at, min(at + 64, batch.num_rows))
                n_tokens, crossing, field_tokens, part_tokens, part_bytes = [], [], [], [], []
                for i in rows:
                    fields = [c[i].as_py() or "" for c in columns]
                    text = "\n".join(fields)
                    raw = np.frombuffer(text.encode(), dtype=np.uint8)
                    ids = np.array(encode(text), dtype=np.int64)
                    ends = np.cumsum(lengths[ids])
                    field_starts = np.cumsum([0, *(len(f.encode()) + 1 for f in fields[:-1])])
                    # a line break closes the line that it ends
                    starts = np.unique(np.concatenate([field_starts, np.flatnonzero(raw[:-1] == 10) + 1]))
                    parts = allocate(ends, starts, rule)
                    counts = np.bincount(parts, minlength=len(starts)) if len(ids) else np.zeros(len(starts), np.int64)
                    of_field = np.searchsorted(field_starts, starts, side="right") - 1
                    n_tokens.append(len(ids))
                    crossing.append(int((allocate(ends, starts, "first") != allocate(ends, starts, "last")).sum()))
                    field_tokens.append(np.bincount(of_field, weights=counts, minlength=n_fields).astype(np.int64).tolist())
                    part_tokens.append(counts.tolist())
                    part_bytes.append(np.diff(np.append(starts, len(raw))).tolist())
                lists = pa.list_(pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(at, len(rows)), pa.array(n_tokens, pa.int64()), pa.array(crossing, pa.int64()), pa.array(field_tokens, lists), pa.array(part_tokens, lists), pa.array(part_bytes, lists)],
                    ["id", "n_tokens", "n_crossing", "field_tokens", "section_tokens", "section_bytes"],
                )

    return run


def attribute_tokens(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", fields: tuple[str, ...] = ("text",), rule: str = "first") -> DataFrame:
    """Tokens of each document and of its fields and sections, a row per row of docs.

    (id_col, n_tokens, n_crossing, field_tokens, section_tokens, section_bytes). A document is its
    fields joined by line breaks and encoded once, whole; sections are the lines of a field, each with
    the line break that ends it. Every token goes to one section, by rule (see ``allocate``); n_crossing
    counts the tokens that cover bytes of several. A null field is empty; an empty document has
    one section without tokens per field. Sums over sections equal n_tokens. Other columns are not looked at.
    """
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")
    bound_batches(docs.sparkSession)
    given = docs.select(F.col(id_col).alias("id"), *(F.col(f).cast("string").alias(f"field_{k}") for k, f in enumerate(fields)))
    kind = dict(given.dtypes)["id"]
    out = given.mapInArrow(_attributed(ranks_path, pattern, rule, len(fields)), f"id {kind}, n_tokens long, n_crossing long, field_tokens array<long>, section_tokens array<long>, section_bytes array<long>")
    return out.withColumnRenamed("id", id_col)
