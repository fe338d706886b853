"""Language identification by compression.

Each language has a raw-content dictionary of some of its text. A document, in blocks, is compressed with
every dictionary; the language whose dictionary makes it smallest is the prediction.
"""

from __future__ import annotations

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ladle.llm.storage import bound_batches, materialize

#: Bytes of a language's dictionary.
DICTIONARY_BYTES = 32_768
#: The dictionaries are filled from so many distinct texts of a language at most, and so many characters of each.
SAMPLE_TEXTS, SAMPLE_CHARS = 256, 1_000
#: The languages learned: so many with the most distinct texts, the first in order in a tie.
MAX_LANGUAGES = 128
#: Bytes compressed at a time. In a longer block a document's own beginning would take the dictionary's place.
BLOCK_BYTES = 1_024
LEVEL = 12
#: A prediction is rejected if the second-best size exceeds the best by less than this share.
MARGIN = 0.005
UNKNOWN = "und"

_TO_SPACE = bytes(b if chr(b).isalpha() or b >= 0x80 else 0x20 for b in range(256))


def letters(text: str | None) -> bytes:
    """The text in lower case, with one space for whatever ASCII isn't a letter; empty if there is no letter at all."""
    plain = b" ".join((text or "").lower().encode().translate(_TO_SPACE).split())
    if plain.isascii() or any(c.isalpha() for c in text):
        return plain
    return b""


def _sampled(labelled: DataFrame) -> DataFrame:
    """(lang, text): the beginnings of some distinct texts of each language, those with the smallest hashes."""
    hashed = labelled.where("lang is not null and text is not null").select("lang", F.xxhash64("text").alias("hash"), F.substring("text", 1, SAMPLE_CHARS).alias("text"))
    counts = hashed.select("lang", "hash").distinct().groupBy("lang").agg(F.count("*").alias("texts"))
    common = materialize(counts.orderBy(F.desc("texts"), "lang").limit(MAX_LANGUAGES), "languages")
    # of a language with many texts, a bound on the hashes leaves some three times the sample before rows are dealt out by language
    place = F.pmod("hash", F.lit(1 << 31))
    few = hashed.join(F.broadcast(common), "lang").where((F.col("texts") <= 8 * SAMPLE_TEXTS) | (place < 3 * SAMPLE_TEXTS / F.col("texts") * (1 << 31)))
    first = few.select("lang", "hash").distinct().withColumn("n", F.row_number().over(Window.partitionBy("lang").orderBy(place, "hash"))).where(f"n <= {SAMPLE_TEXTS}")
    return few.join(F.broadcast(first.drop("n")), ["lang", "hash"]).groupBy("lang", "hash").agg(F.min("text").alias("text")).orderBy("lang", "hash")


def learn(labelled: DataFrame, lang_col: str = "lang", text_col: str = "text") -> dict[str, bytes]:
    """A dictionary for each language of the labelled rows, from a sample bounded by MAX_LANGUAGES, SAMPLE_TEXTS and SAMPLE_CHARS.

    Rows without language or text, and texts without letters, teach nothing. A language is learned from its texts only."""
    rows = _sampled(labelled.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text"))).collect()
    found: dict[str, bytearray] = {}
    for row in rows:
        own = found.setdefault(row["lang"], bytearray())
        if len(own) < DICTIONARY_BYTES and (plain := letters(row["text"])):
            own += plain + b" "
    return {lang: bytes(own[:DICTIONARY_BYTES]) for lang, own in sorted(found.items()) if own}


def compressors(dictionaries: dict[str, bytes], level: int = LEVEL) -> dict[str, zstandard.ZstdCompressor]:
    made = {}
    for lang, content in dictionaries.items():
        dictionary = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        dictionary.precompute_compress(level=level)
        made[lang] = zstandard.ZstdCompressor(level=level, dict_data=dictionary, write_checksum=False, write_content_size=False, write_dict_id=False)
    return made


def classify(text: str | None, by_lang: dict[str, zstandard.ZstdCompressor]) -> tuple[str, float, float]:
    """(language, score, margin) of one text. Ties go to the first language in order."""
    plain = letters(text)
    if not plain or not by_lang:
        return UNKNOWN, 0.0, 0.0
    blocks = [plain[a : a + BLOCK_BYTES] for a in range(0, len(plain), BLOCK_BYTES)]
    sizes = sorted((sum(len(c.compress(b)) for b in blocks), lang) for lang, c in by_lang.items())
    if len(sizes) == 1:
        return sizes[0][1], 1.0, 1.0
    best, second = sizes[0][0], sizes[1][0]
    return sizes[0][1], 1 - best / second, second / best - 1


def _predict(dictionaries: dict[str, bytes], margin: float):
    def run(batches):
        by_lang = compressors(dictionaries)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                found = [classify(x.as_py(), by_lang) for x in batch.column(1).slice(at, 256)]
                langs, scores, margins = zip(*found)
                rejected = [lang == UNKNOWN or m < margin for lang, m in zip(langs, margins)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, 256), pa.array(langs), pa.array(scores, pa.float64()), pa.array(rejected)], ["id", "lang_pred", "score", "rejected"])

    return run


def identify(docs: DataFrame, dictionaries: dict[str, bytes], id_col: str = "doc_id", text_col: str = "text", margin: float = MARGIN) -> DataFrame:
    """The language of each document: (id_col, lang_pred, score, rejected), a row per row of docs.

    lang_pred is a language of the dictionaries, or ``und`` where the text is null or has no letter, or nothing
    was learned. score is 1 - best size / second-best size, 1 if there is one language only, 0 for ``und``.
    rejected: ``und``, or the second-best size is within margin of the best. Predictions come from the whole
    text and nothing else; ids may repeat or be null. Other columns are not looked at.
    """
    bound_batches(docs.sparkSession)
    kind = dict(docs.dtypes)[id_col]
    given = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return given.mapInArrow(_predict(dictionaries, margin), f"id {kind}, lang_pred string, score double, rejected boolean").withColumnRenamed("id", id_col)


def fold(id_col: str = "doc_id"):
    """crc32 of the id as text, modulo 3; null for a null id. Documents of fold 1 are held out from learning."""
    return F.crc32(F.col(id_col).cast("string")) % 3
