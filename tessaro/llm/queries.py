"""The registered queries of the corpus operators: each applies its operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the folder; one that its files don't split into a task for each core is dealt out first."""
    rows, cores = spark.read.parquet(f"{sf_dir}/{name}.parquet"), spark.sparkContext.defaultParallelism
    return rows if name not in ("documents", "pages") or rows.rdd.getNumPartitions() >= cores else rows.repartition(cores)


def op1_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessaro.llm.itq_dedup import near_vectors

    return near_vectors(table(spark, sf_dir, "embeddings"))


def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from tessaro.llm.piece_codec import round_trip

    return round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op3_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessaro.llm.simhash_bk import simhash_groups

    return simhash_groups(table(spark, sf_dir, "documents"))


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessaro.llm.license_scan import license_scan

    return license_scan(table(spark, sf_dir, "documents"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessaro.llm.toxicity_knn import toxicity

    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessaro.llm.compression_bands import quality_rules

    return quality_rules(table(spark, sf_dir, "documents"))


def word_bpe() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op8_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessaro.llm.common import new_path
    from tessaro.llm.token_store import write_store

    store = write_store(table(spark, sf_dir, "documents"), new_path(spark, "token-store"), word_bpe(), end_id=2)
    return store.read(store.lookup(store.entries.select("doc_id", "occurrence")))


def op7_ordinal_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessaro.llm.ordinal_quality import quality_grades

    return quality_grades(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_radix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessaro.llm.radix_dedup import PASSAGES, remove_repeats

    return remove_repeats(table(spark, sf_dir, "documents"), with_text=False, passages=PASSAGES)


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessaro.llm.best_fit_packing import pack, token_pieces
    from tessaro.llm.common import cut

    return pack(cut(token_pieces(table(spark, sf_dir, "documents"), word_bpe(), end_id=0)))


def op11_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessaro.llm.html_text import extract

    return extract(table(spark, sf_dir, "pages"))


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessaro.llm.spelling_variants import spelling_variants

    return spelling_variants(table(spark, sf_dir, "documents"))


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessaro.llm.collocations import collocations

    return collocations(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for k, f in globals().items() if k.startswith("op") and callable(f)}


#: Near words in SQL: a word less one letter is another word, or two words less the letter at the same place are equal.
VARIANTS_SQL = """
WITH RECURSIVE steps(i, s, c) AS (
  SELECT i, 0, i::BIGINT FROM range(256) AS r(i)
  UNION ALL SELECT i, s + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::BIGINT) ELSE c >> 1 END FROM steps WHERE s < 8
),
crc AS (SELECT list(c ORDER BY i) AS tab FROM steps WHERE s = 8),
runs AS (
  SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z\u00C0-\u00FF]+')) AS run FROM documents
),
lower_runs AS (
  SELECT coalesce(doc_id::VARCHAR, '') AS doc, translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run, count(*) AS n
  FROM runs WHERE length(run) >= 6 GROUP BY ALL
),
bytes AS (
  SELECT run, n, flatten(list_transform(string_split(doc || ':' || run, ''), lambda c: CASE WHEN unicode(c) < 128 THEN [unicode(c)::BIGINT] ELSE [195::BIGINT, (unicode(c) - 64)::BIGINT] END)) AS b
  FROM lower_runs
),
hashed AS (
  SELECT run, n, xor(list_reduce(list_prepend(4294967295::BIGINT, b), lambda c, x: xor(c >> 8, tab[(xor(c, x) & 255) + 1])), 4294967295::BIGINT) AS h FROM bytes, crc
),
words AS (
  SELECT CASE WHEN h % 199 = 0 THEN substr(run, 1, (h % length(run))::BIGINT) || substr(run, (h % length(run))::BIGINT + 2) ELSE run END AS word, sum(n)::BIGINT AS n
  FROM hashed GROUP BY 1 HAVING sum(n) >= 5 AND length(word) >= 6
),
less AS (SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS rest FROM words, LATERAL (SELECT unnest(range(1, length(word) + 1)) AS i)),
pairs AS (
  SELECT a.word, b.word AS near FROM less AS a JOIN less AS b ON a.i = b.i AND a.rest = b.rest AND a.word <> b.word
  UNION SELECT l.word, w.word FROM less AS l JOIN words AS w ON l.rest = w.word
  UNION SELECT w.word, l.word FROM less AS l JOIN words AS w ON l.rest = w.word
),
best AS (
  SELECT p.word, count(*) AS n_near, max(w.n) AS most, arg_min(p.near, (-w.n, p.near)) AS near FROM pairs AS p JOIN words AS w ON w.word = p.near GROUP BY p.word
),
forms AS (
  SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN most >= 5 * w.n THEN near END AS form, CASE WHEN most >= 5 * w.n THEN most END AS form_n
  FROM words AS w LEFT JOIN best USING (word)
),
chains(word, last, depth) AS (
  SELECT word, word, 0 FROM forms
  UNION ALL SELECT c.word, f.form, depth + 1 FROM chains AS c JOIN forms AS f ON f.word = c.last WHERE f.form IS NOT NULL
),
ends AS (SELECT word, arg_max(last, depth) AS root FROM chains GROUP BY word)
SELECT word, form, root, n, n_near, form_n FROM forms JOIN ends USING (word)
"""

COLLOCATIONS_SQL = """
WITH docs AS (
  SELECT row_number() OVER () AS d, coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents
),
pieces AS (SELECT d, lang, unnest(p) AS piece, generate_subscripts(p, 1) AS i FROM (SELECT d, lang, string_split_regex(t, '[.,;:!?\x0A-\x0D]') AS p FROM docs)),
split AS (SELECT d, lang, i, list_filter(string_split(replace(piece, chr(9), ' '), ' '), lambda x: x <> '') AS w FROM pieces),
tokens AS (SELECT d, lang, i, unnest(w) AS w1, generate_subscripts(w, 1) AS j FROM split),
near AS (SELECT lang, w1, lead(w1) OVER o AS w2, lead(w1, 2) OVER o AS w3 FROM tokens WINDOW o AS (PARTITION BY d, i ORDER BY j)),
f1 AS (SELECT lang, w1, count(*) AS f FROM near GROUP BY ALL),
f2 AS (SELECT lang, w1, w2, count(*) AS f FROM near WHERE w2 IS NOT NULL GROUP BY ALL HAVING count(*) >= 10),
f3 AS (SELECT lang, w1, w2, w3, count(*) AS f FROM near WHERE w3 IS NOT NULL GROUP BY ALL HAVING count(*) >= 10),
totals AS (SELECT lang, sum(f)::BIGINT AS n FROM f1 GROUP BY lang),
longer AS (SELECT lang, w1, w2, max(f) AS f FROM (SELECT lang, w1, w2, f FROM f3 UNION ALL SELECT lang, w2, w3, f FROM f3) GROUP BY ALL),
kept AS (SELECT f2.* FROM f2 LEFT JOIN longer USING (lang, w1, w2) WHERE longer.f IS NULL OR 100 * longer.f < 50 * f2.f),
cuts AS (
  SELECT lang, p.w1 || ' ' || p.w2 AS phrase, 1 AS k, p.f AS a, x.f AS l, y.f AS r FROM kept AS p JOIN f1 AS x USING (lang) JOIN f1 AS y USING (lang) WHERE x.w1 = p.w1 AND y.w1 = p.w2
  UNION ALL SELECT lang, concat_ws(' ', p.w1, p.w2, p.w3), 1, p.f, x.f, y.f FROM f3 AS p JOIN f1 AS x USING (lang) JOIN f2 AS y USING (lang) WHERE x.w1 = p.w1 AND y.w1 = p.w2 AND y.w2 = p.w3
  UNION ALL SELECT lang, concat_ws(' ', p.w1, p.w2, p.w3), 2, p.f, x.f, y.f FROM f3 AS p JOIN f2 AS x USING (lang) JOIN f1 AS y USING (lang) WHERE x.w1 = p.w1 AND x.w2 = p.w2 AND y.w1 = p.w3
),
scores AS (SELECT *, (1000000 * a::HUGEINT * a // (l::HUGEINT * r))::BIGINT AS score FROM cuts),
lowest AS (SELECT * FROM scores QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM lowest)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN totals USING (lang) WHERE rank <= 2000
"""


def oracle_sql() -> dict[str, str]:
    return {"op12_spelling_variants": VARIANTS_SQL, "op13_collocations": COLLOCATIONS_SQL}
