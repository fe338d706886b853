"""The registered queries of this subpackage, and their SQL for DuckDB."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ladle.llm import alignment, language, licences, lines, minhash, mixing, quality, sstable, suffix, tiling, tokens, warc, whitening

#: Words of a text in DuckDB: runs of characters other than space and 0x09-0x0D.
_SQL_WORDS = r"list_filter(regexp_split_to_array(coalesce({0}, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '')"
_SQL_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate classes of documents: one row per document."""
    return minhash.near_duplicates(_table(spark, sf_dir, "documents"))


_OP1_SQL = f"""
WITH RECURSIVE w AS (SELECT doc_id, {_SQL_WORDS.format(_SQL_LOWER)} AS w FROM documents),
g AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' '))
    WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM g x JOIN g y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY ALL),
e AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
r AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a)
SELECT d.doc_id, coalesce(any_value(n.n), 0) AS n_shingles, coalesce(least(d.doc_id, min(r.b)), d.doc_id) AS component_id,
  coalesce(least(d.doc_id, min(r.b)), d.doc_id) = d.doc_id AS kept
FROM documents d LEFT JOIN n USING (doc_id) LEFT JOIN r ON r.a = d.doc_id GROUP BY d.doc_id
"""


def op2_sstable(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of all documents, written to shards and read back: a row per document."""
    manifest = sstable.write_shards(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), end_id=2)
    return sstable.read_shards(manifest).select(F.col("id").alias("doc_id"), "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op3_tiling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that leak benchmark items: a row per document."""
    return tiling.find_leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many words of each document a mix of all sources takes: a row per document."""
    return mixing.mix_sources(_table(spark, sf_dir, "documents")).drop("copies")


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every document and of its lines: a row per document."""
    return tokens.attribute_tokens(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN).drop("field_tokens", "section_bytes")


def op6_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality counts, distances and verdict: a row per document."""
    judged = quality.judge(_table(spark, sf_dir, "documents"))
    return judged.withColumns({c: F.round(c, 4) for c in ("class_distance", "word_distance")})


def _op6_sql() -> str:
    common = quality.vocabulary()
    classes = ", ".join(f"len(regexp_extract_all(t, '{c}'))" for c in quality.CLASSES.values())
    counts = ", ".join(f"len(list_filter(w, lambda x: x = '{c}' OR x = '{c.capitalize()}'))" for c in common)
    n, m = len(quality.CLASSES) + 1, len(common) + 1

    def sums(column: str, size: int) -> str:
        return f"[{', '.join(f'sum({column}[{i + 1}]) + {quality.SMOOTHING}' for i in range(size))}]"

    def shares(column: str) -> str:
        return f"list_transform({column}, lambda x: x / greatest(list_sum({column}), 1e-9))"

    def distance(p: str, q: str) -> str:
        half = "CASE WHEN z[{0}] > 0 THEN z[{0}] * log2(2 * z[{0}] / (z[1] + z[2])) ELSE 0 END"
        return f"sqrt(greatest(list_sum(list_transform(list_transform(range(1, len({p}) + 1), lambda i: [{p}[i], {q}[i]]), lambda z: {half.format(1)} + {half.format(2)})) / 2, 0))"

    return f"""
WITH d AS (SELECT doc_id, lang, coalesce(text, '') AS t, {_SQL_WORDS.format("text")} AS w FROM documents),
g AS (SELECT doc_id, unnest(range(1, len(w) - 3)) AS i, w FROM d WHERE len(w) >= 5),
s AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, array_to_string(w[i:i+4], ' ')) AS n FROM g),
r AS (SELECT doc_id, count(DISTINCT j) AS n_repeat_words FROM (SELECT doc_id, unnest(range(i, i + 5)) AS j FROM s WHERE n > 1) GROUP BY doc_id),
l AS (SELECT doc_id, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM d),
f AS (SELECT d.doc_id, lang, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars, len(regexp_extract_all(t, '[#*$%&|<>]')) AS n_symbols,
  len(l) - len(list_distinct(l)) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words, [{classes}] AS c5, length(t) AS n_chars, [{counts}] AS k44
  FROM d JOIN l USING (doc_id) LEFT JOIN r USING (doc_id)),
h AS (SELECT *, list_append(c5, n_chars - list_sum(c5)::BIGINT)::DOUBLE[] AS classes, list_append(k44, n_words - list_sum(k44)::BIGINT)::DOUBLE[] AS common, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM f),
o AS (SELECT * FROM h WHERE NOT base_failed AND n_words >= {quality.MIN_WORDS}),
ref AS (SELECT lang, {sums("classes", n)} AS rc, {sums("common", m)} AS rk FROM o WHERE lang IS NOT NULL GROUP BY lang
  UNION ALL SELECT NULL, {sums("classes", n)}, {sums("common", m)} FROM o),
j AS (SELECT h.*, {shares("classes")} AS pc, {shares("common")} AS pk, {shares("ref.rc")} AS qc, {shares("ref.rk")} AS qk
  FROM h JOIN ref ON (CASE WHEN h.lang IN (SELECT lang FROM ref WHERE lang IS NOT NULL) THEN h.lang END) IS NOT DISTINCT FROM ref.lang),
x AS (SELECT *, CASE WHEN NOT base_failed AND n_words >= {quality.MIN_WORDS} THEN {distance("pc", "qc")} END AS cd,
  CASE WHEN NOT base_failed AND n_words >= {quality.MIN_WORDS} THEN {distance("pk", "qk")} END AS wd FROM j)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, round(cd, 4) AS class_distance, round(wd, 4) AS word_distance, base_failed,
  NOT base_failed AND NOT coalesce(cd > {quality.FAR_CLASSES} OR (cd > {quality.NEAR_CLASSES} AND wd > {quality.NEAR_WORDS}), false) AS kept
FROM x
"""


def op7_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licences that the paragraphs of each document name: a row per document."""
    documents = _table(spark, sf_dir, "documents")
    return licences.scan(documents, licences.train(documents))


def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document, learned from the documents that aren't held out: a row per document."""
    documents = _table(spark, sf_dir, "documents")
    dictionaries = language.learn(documents.where(language.fold() != 1))
    held_out = F.coalesce(language.fold() == 1, F.lit(False)).alias("held_out")
    return language.identify(documents, dictionaries).select("doc_id", held_out, "lang_pred", "score", "rejected")


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages written to WARC archives, read back and assembled: a row per page."""
    records = warc.read_warc(warc.write_warc(_table(spark, sf_dir, "pages")), with_payload=False)
    captures = warc.with_referred(warc.assemble(records))
    return captures.select("page_id", "payload_bytes", "payload_digest", "record_type", F.col("refers_to_page").alias("refers_to"))


_OP9_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS sha FROM pages),
f AS (SELECT sha, min(page_id) AS first FROM p GROUP BY sha),
n AS (SELECT page_id, html, first, ('0x' || sha[1:10])::BIGINT AS a, ('0x' || sha[11:20])::BIGINT AS b, ('0x' || sha[21:30])::BIGINT AS c, ('0x' || sha[31:40])::BIGINT AS d FROM p JOIN f USING (sha))
SELECT page_id, octet_length(encode(html)) AS payload_bytes,
  list_aggregate(list_transform([a, b, c, d], lambda x: list_aggregate(list_transform(range(7, -1, -1), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((x >> (5 * i)) & 31)::INT + 1, 1)), 'string_agg', '')), 'string_agg', '') AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to
FROM n
"""


def op10_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents without the passages that a document with a smaller id has: a row per document."""
    return suffix.without_repeats(_table(spark, sf_dir, "documents"))


_OP10_SQL = f"""
WITH d AS (SELECT doc_id, {_SQL_WORDS.format("text")} AS w FROM documents),
x AS (SELECT doc_id, unnest(range(1, len(w) - 11)) AS i, w FROM d WHERE len(w) >= 13),
g AS (SELECT doc_id, i, array_to_string(w[i:i+12], ' ') AS g FROM x),
f AS (SELECT g, min(doc_id) AS first FROM g GROUP BY g),
c AS (SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS i FROM g JOIN f USING (g) WHERE first < doc_id),
r AS (SELECT doc_id, list(i) AS gone FROM c GROUP BY doc_id),
k AS (SELECT d.doc_id, len(w) AS n, coalesce(len(gone), 0) AS r, CASE WHEN gone IS NULL THEN w ELSE list_transform(list_filter(list_zip(w, range(1, len(w) + 1)), lambda p: NOT list_contains(gone, p[2])), lambda p: p[1]) END AS kept FROM d LEFT JOIN r USING (doc_id))
SELECT doc_id, n AS n_words, r AS n_removed, sha256(coalesce(array_to_string(kept, ' '), '')) AS kept_sha256 FROM k
"""


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whitened embeddings: a row per vector that counts and component."""
    found = whitening.whiten(_table(spark, sf_dir, "embeddings"), components=8)
    by_component = found.select("vec_id", "n", F.col("deviation").try_cast("long").alias("deviation"), F.posexplode("whitened").alias("place", "whitened"), "explained", "identity_error")
    return by_component.select("vec_id", (F.col("place") + 1).alias("component"), "n", "deviation", "whitened", F.element_at("explained", F.col("place") + 1).alias("explained"), "identity_error")


def op12_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The quality of every document from its lines, learned from the labels that aren't held out: a row per document."""
    documents = _table(spark, sf_dir, "documents")
    field = lines.learn(documents, _table(spark, sf_dir, "labels").where(~lines.held_out()))
    found = lines.judge(documents, field)
    return found.select("doc_id", lines.held_out().alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"), "n_lines", "n_bad_lines")


def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of two tokenizers laid side by side: a row per document."""
    return alignment.align(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))[0]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"op1_minhash": op1_minhash, "op2_sstable": op2_sstable, "op3_tiling": op3_tiling, "op4_mixing": op4_mixing, "op5_token_counts": op5_token_counts, "op6_divergence": op6_divergence, "op7_licences": op7_licences, "op8_language": op8_language, "op9_warc": op9_warc, "op10_suffix": op10_suffix, "op11_whitening": op11_whitening, "op12_lines": op12_lines, "op13_alignment": op13_alignment}


def oracle_sql() -> dict[str, str]:
    return {"op1_minhash": _OP1_SQL, "op6_divergence": _op6_sql(), "op9_warc": _OP9_SQL, "op10_suffix": _OP10_SQL}
