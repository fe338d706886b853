"""Quality rules: divergence of a document from references of its language.

Two histograms of a document, of character classes and of common words, are compared with those of
its language over the corpus by Jensen-Shannon distance. Built-in functions only.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ladle.llm.storage import materialize

SPACE = r"[\x20\x09-\x0D]"
#: Frequent words of some languages, as listed in any frequency dictionary; lower case.
COMMON_WORDS = {
    "de": ("der", "die", "und", "in", "den", "von", "zu", "das", "mit", "sich", "des", "ist"),
    "en": ("the", "of", "and", "to", "in", "a", "is", "that", "for", "it", "was", "with"),
    "es": ("de", "la", "que", "el", "en", "y", "los", "se", "del", "las", "un", "por"),
    "fr": ("de", "la", "le", "et", "les", "des", "en", "un", "du", "une", "que", "est"),
}
#: Character classes; whatever is in none of them is the last class, letters of the ASCII in lower case.
CLASSES = {"upper": "[A-Z]", "digit": "[0-9]", "punctuation": r"[\x21-\x2F\x3A-\x40\x5B-\x60\x7B-\x7E]", "space": SPACE, "other": r"[^\x00-\x7F]"}
#: Jensen-Shannon distances (base 2, from 0 to 1). A document is dropped whose classes are FAR from the
#: reference, or whose classes and words are both beyond what is NEAR. Chosen on labelled documents.
FAR_CLASSES, NEAR_CLASSES, NEAR_WORDS = 0.25, 0.09, 0.24
#: Documents with fewer words are not compared: their histograms say too little.
MIN_WORDS = 50
#: Each bin of a reference gets so much more, lest it be empty.
SMOOTHING = 0.5
#: The references are broadcast up to so many languages.
BROADCAST_LANGUAGES = 10_000


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value computed once however often body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def words_of(text: Column) -> Column:
    trimmed = F.btrim(text, F.lit(" \t\n\x0b\f\r"))
    return F.when(F.length(trimmed) > 0, F.split(trimmed, f"{SPACE}+")).otherwise(F.array().cast("array<string>"))


def repeated_words(words: Column, window: int = 5) -> Column:
    """How many of the words lie in windows whose word sequence occurs twice or more."""

    def hashed(i: Column) -> Column:
        return F.xxhash64(*[F.get(words, i + k) for k in range(window)])

    def covered(grams: Column) -> Column:
        placed = F.sort_array(F.transform(grams, lambda g, i: F.struct(g.alias("g"), i.alias("i"))))

        def starts(p: Column) -> Column:
            twin = F.filter(p, lambda x, k: F.coalesce(x["g"] == F.get(p, k - 1)["g"], F.lit(False)) | F.coalesce(x["g"] == F.get(p, k + 1)["g"], F.lit(False)))
            return F.sort_array(F.transform(twin, lambda x: x["i"]))

        none = F.struct(F.lit(0).alias("n"), F.lit(-window).alias("last"))
        return _let(placed, lambda p: F.aggregate(starts(p), none, lambda acc, i: F.struct((acc["n"] + F.least(F.lit(window), i - acc["last"])).alias("n"), i.alias("last")), lambda acc: acc["n"]))

    grams = F.transform(F.sequence(F.lit(0), F.size(words) - window), hashed)
    distinct = F.when(F.size(words) <= window, F.lit(0)).otherwise(_let(grams, lambda g: F.when(F.size(F.array_distinct(g)) == F.size(g), F.lit(0)).otherwise(covered(g))))
    return distinct.cast("long")


def duplicate_lines(text: Column) -> Column:
    """How many lines that have a word equal an earlier line."""
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(f"[^{SPACE[1:]}"))
    return _let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long")


def vocabulary(languages: dict[str, tuple[str, ...]] = COMMON_WORDS) -> list[str]:
    return sorted({w for words in languages.values() for w in words})


def histograms(docs: DataFrame, id_col: str, text_col: str, lang_col: str, common: list[str]) -> DataFrame:
    """(id, lang, features) per row: n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, classes, common."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    # a common word is looked up as written, in lower case or with an initial
    listed = [*common, *[w.capitalize() for w in common if w.capitalize() not in common]]

    def features(w: Column, t: Column) -> Column:
        hits = F.transform(F.filter(w, lambda x: x.isin(listed)), lambda x: F.lower(x))
        counts = _let(hits, lambda h: F.array(*[F.size(h) - F.size(F.array_remove(h, c)) for c in common], F.size(w) - F.size(h)))
        per_class = _let(F.array(*[F.regexp_count(t, F.lit(c)) for c in CLASSES.values()]), lambda c: F.concat(c, F.array(F.length(t) - F.aggregate(c, F.lit(0), lambda a, x: a + x))))
        return F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
            F.regexp_count(t, F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
            duplicate_lines(t).alias("n_dup_lines"),
            repeated_words(w).alias("n_repeat_words"),
            per_class.alias("classes"),
            counts.alias("common"),
        )

    return docs.select(F.col(id_col).alias("id"), F.col(lang_col).cast("string").alias("lang"), _let(text, lambda t: _let(words_of(t), lambda w: features(w, t))).alias("f"))


def _shares(counts: Column, smoothing: float) -> Column:
    total = F.aggregate(counts, F.lit(0.0), lambda a, x: a + x + smoothing)
    return _let(total, lambda n: F.transform(counts, lambda x: F.when(n > 0, (x + smoothing) / n).otherwise(0.0)))


def js_distance(p: Column, q: Column) -> Column:
    """Jensen-Shannon distance, base 2, of two arrays of shares."""

    def half(a: Column, b: Column) -> Column:
        return F.when(a > 0, a * F.log2(2 * a / (a + b))).otherwise(0.0)

    terms = F.zip_with(p, q, lambda a, b: half(a, b) + half(b, a))
    return F.sqrt(F.greatest(F.aggregate(terms, F.lit(0.0), lambda acc, x: acc + x) / 2, F.lit(0.0)))


def _reference(measured: DataFrame, key: Column, n_common: int) -> DataFrame:
    sums = {name: [F.sum(F.col(f"f.{name}")[i]).cast("double") for i in range(n)] for name, n in (("classes", len(CLASSES) + 1), ("common", n_common + 1))}
    return measured.groupBy(key.alias("of")).agg(*[_shares(F.array(*c), SMOOTHING).alias(f"ref_{name}") for name, c in sums.items()])


def judge(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", languages: dict[str, tuple[str, ...]] = COMMON_WORDS,
    far_classes: float = FAR_CLASSES, near_classes: float = NEAR_CLASSES, near_words: float = NEAR_WORDS, min_words: int = MIN_WORDS,
) -> DataFrame:
    """Counts, distances and the verdict for each document, a row per row of docs.

    (id_col, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, class_distance, word_distance, base_failed, kept).
    base_failed: fewer than 10 words, or over a fifth of them in repeated windows of five. Otherwise a document of
    min_words or more is dropped if its character classes are farther than far_classes from the reference of its
    language, or farther than near_classes and its common words farther than near_words; a shorter one is kept, with null distances. A reference is made of all documents with that language which have
    min_words and don't fail the base; a document without a language, or whose language has no reference, is compared
    with that of all languages together. A null or empty text has no words and fails. Other columns are not looked at.
    """
    common = vocabulary(languages)
    measured = materialize(histograms(docs, id_col, text_col, lang_col, common), "features")
    failed = (F.col("f.n_words") < 10) | (100 * F.col("f.n_repeat_words") > 20 * F.col("f.n_words"))
    sound = measured.where(~failed & (F.col("f.n_words") >= min_words))
    own = materialize(_reference(sound.where("lang is not null"), F.col("lang"), len(common)).union(_reference(sound, F.lit(None).cast("string"), len(common)).where("ref_classes is not null")), "references")
    few = own.count() <= BROADCAST_LANGUAGES
    known = own.where("of is not null").select(F.col("of").alias("known"))
    keyed = measured.join(F.broadcast(known) if few else known, F.col("lang") == F.col("known"), "left")
    compared = keyed.join(F.broadcast(own) if few else own, F.col("known").eqNullSafe(F.col("of")), "left")
    long_enough = ~failed & (F.col("f.n_words") >= min_words)
    class_distance = F.when(long_enough, js_distance(_shares(F.col("f.classes"), 0.0), F.col("ref_classes")))
    word_distance = F.when(long_enough, js_distance(_shares(F.col("f.common"), 0.0), F.col("ref_common")))
    measures = compared.select(F.col("id").alias(id_col), *[f"f.{n}" for n in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")], class_distance.alias("class_distance"), word_distance.alias("word_distance"), failed.alias("base_failed"))
    strange = (F.col("class_distance") > far_classes) | ((F.col("class_distance") > near_classes) & (F.col("word_distance") > near_words))
    kept = ~F.col("base_failed") & ~F.coalesce(strange, F.lit(False))
    return measures.withColumn("kept", kept)
