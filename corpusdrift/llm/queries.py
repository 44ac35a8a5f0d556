"""The operators as named queries over the test tables."""

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusdrift.llm import (
    bpe,
    centroids,
    decontaminate,
    language_id,
    license_scan,
    line_frequency,
    near_duplicates,
    packing,
    phrases,
    shared,
    substring_dedup,
    token_store,
    toxicity,
    warc,
)

VOCABULARY = "byte_bpe_50k.json"
END_ID = 2

Query = Callable[[SparkSession, str], DataFrame]


def op1_token_store(spark: SparkSession, folder: str) -> DataFrame:
    path = shared.shared_folder(spark)
    docs = shared.table(spark, folder, "documents")
    token_store.write(docs, path, shared.tokenizer_file(VOCABULARY), END_ID)
    return token_store.with_starts(token_store.read(spark, path))


def op2_substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    found = substring_dedup.remove_repeats(shared.table(spark, folder, "documents"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op3_line_frequency(spark: SparkSession, folder: str) -> DataFrame:
    return line_frequency.judge_documents(shared.table(spark, folder, "documents"))


def op4_decontaminate(spark: SparkSession, folder: str) -> DataFrame:
    return decontaminate.find_leaks(shared.table(spark, folder, "documents"), shared.table(spark, folder, "benchmark"))


def op5_license_scan(spark: SparkSession, folder: str) -> DataFrame:
    return license_scan.scan(shared.table(spark, folder, "documents")).drop("blocks")


def op6_warc(spark: SparkSession, folder: str) -> DataFrame:
    path = shared.shared_folder(spark)
    warc.write(shared.table(spark, folder, "pages"), path)
    return warc.page_records(warc.read(spark, path))


def op7_near_duplicates(spark: SparkSession, folder: str) -> DataFrame:
    return near_duplicates.near_duplicates(shared.table(spark, folder, "documents"))


def _part(of: int) -> Column:
    """crc32 of the id as text, modulo a number."""
    return F.crc32(F.col("doc_id").cast("string")) % of


def op8_language_id(spark: SparkSession, folder: str) -> DataFrame:
    docs = shared.table(spark, folder, "documents")
    learned = shared.written(language_id.learn_profiles(docs.where(_part(4) != 2)))
    found = language_id.identify(docs, language_id.collect_profiles(learned))
    return found.select("doc_id", F.coalesce(_part(4) == 2, F.lit(False)).alias("held_out"), "lang_pred", "score")


def toxic_training() -> Column:
    """Of these documents the labels may be learned."""
    return _part(5) != 0


def op10_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    docs, labels = shared.table(spark, folder, "documents"), shared.table(spark, folder, "labels")
    net = toxicity.fit(docs, labels, toxic_training())
    held_out = F.coalesce(_part(5) == 0, F.lit(False)).alias("held_out")
    return toxicity.score_documents(docs, net).select("doc_id", held_out, "score", "predicted")


def op9_bpe(spark: SparkSession, folder: str) -> DataFrame:
    docs = shared.table(spark, folder, "documents")
    return bpe.encode_documents(docs, shared.tokenizer_file(VOCABULARY))


def op11_centroids(spark: SparkSession, folder: str) -> DataFrame:
    return centroids.cluster(shared.table(spark, folder, "embeddings"))


def op12_collocations(spark: SparkSession, folder: str) -> DataFrame:
    return phrases.collocations(shared.table(spark, folder, "documents"))


def op13_best_fit(spark: SparkSession, folder: str) -> DataFrame:
    docs = shared.table(spark, folder, "documents")
    return packing.pack_documents(docs, shared.tokenizer_file(VOCABULARY), END_ID)


QUERIES: dict[str, Query] = {
    query.__name__: query
    for query in (
        op1_token_store,
        op2_substring_dedup,
        op3_line_frequency,
        op4_decontaminate,
        op5_license_scan,
        op6_warc,
        op7_near_duplicates,
        op8_language_id,
        op9_bpe,
        op10_toxicity,
        op11_centroids,
        op12_collocations,
        op13_best_fit,
    )
}

_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

OP2_SQL = rf"""
WITH w AS (SELECT doc_id, {_WORDS} AS words FROM documents),
starts AS (SELECT doc_id, words, unnest(range(1, len(words) - 18)) AS s FROM w),
keyed AS (SELECT doc_id, s, list_slice(words, s, s + 19)::VARCHAR AS k FROM starts),
ranked AS (SELECT doc_id, s, row_number() OVER (PARTITION BY k ORDER BY doc_id, s) AS n FROM keyed),
gone AS (SELECT DISTINCT doc_id, unnest(range(s, s + 20)) AS i FROM ranked WHERE n > 1),
each AS (SELECT doc_id, unnest(words) AS word, unnest(range(1, len(words) + 1)) AS i FROM w),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS t, count(*) AS n
         FROM each ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id)
SELECT doc_id, len(words)::BIGINT AS n_words, (len(words) - coalesce(n, 0))::BIGINT AS n_removed,
       sha256(coalesce(t, '')) AS kept_sha256
FROM w LEFT JOIN kept USING (doc_id)
"""

OP3_SQL = rf"""
WITH w AS (SELECT doc_id, coalesce(source, '') AS host, coalesce(text, '') AS t, {_WORDS} AS words FROM documents),
windows AS (SELECT doc_id, words, unnest(range(1, len(words) - 1)) AS s FROM w),
keyed AS (SELECT doc_id, s, list_slice(words, s, s + 2) AS k FROM windows),
again AS (SELECT doc_id, s FROM keyed QUALIFY count(*) OVER (PARTITION BY doc_id, k) > 1),
repeats AS (SELECT doc_id, count(DISTINCT i) AS n FROM (SELECT doc_id, unnest(range(s, s + 3)) AS i FROM again) GROUP BY 1),
raw AS (SELECT doc_id, host, t, unnest(string_split(t, chr(10))) AS line FROM w),
lines AS (
  SELECT doc_id, host, t, line, trim(regexp_replace(
    translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ123456789', 'abcdefghijklmnopqrstuvwxyz000000000'),
    '[\x20\x09-\x0D]+', ' ', 'g'), ' ') AS plain
  FROM raw WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
dup AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n FROM lines GROUP BY 1),
hosts AS (SELECT host, count(DISTINCT t) AS total FROM w GROUP BY 1),
counts AS (SELECT host, plain, count(DISTINCT t) AS n FROM lines GROUP BY 1, 2),
frequent AS (SELECT host, plain FROM counts JOIN hosts USING (host) WHERE n >= 5 AND n * 100 > total),
removed AS (SELECT doc_id, sum(len(string_split(plain, ' '))) AS n FROM lines JOIN frequent USING (host, plain) GROUP BY 1),
figures AS (
  SELECT w.doc_id, len(words)::BIGINT AS n_words, length(array_to_string(words, ''))::BIGINT AS word_chars,
    len(regexp_extract_all(t, '[#*$%&|<>]'))::BIGINT AS n_symbols, coalesce(dup.n, 0)::BIGINT AS n_dup_lines,
    coalesce(repeats.n, 0)::BIGINT AS n_repeat_words, coalesce(removed.n, 0)::BIGINT AS n_words_removed
  FROM w LEFT JOIN dup USING (doc_id) LEFT JOIN repeats USING (doc_id) LEFT JOIN removed USING (doc_id))
SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words)
    AND NOT ((n_words - n_words_removed) * 100 < n_words * 50) AS kept
FROM figures
"""

OP6_SQL = r"""
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
h AS (SELECT page_id, octet_length(b)::BIGINT AS payload_bytes, sha1(b) AS x FROM p),
parts AS (SELECT x, string_agg(letters, '' ORDER BY g) AS payload_digest FROM (
  SELECT x, g, list_aggregate(list_transform([15, 10, 5, 0], lambda s: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (v >> s) % 32 + 1, 1)), 'string_agg', '') AS letters
  FROM (SELECT x, g, ('0x' || substr(x, 5 * g + 1, 5))::INTEGER AS v FROM (SELECT DISTINCT x FROM h), (SELECT unnest(range(0, 8)) AS g))) GROUP BY x),
newest AS (SELECT x, max(page_id) AS top FROM h GROUP BY x)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = top THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id != top THEN top END AS refers_to
FROM h JOIN parts USING (x) JOIN newest USING (x)
"""

OP7_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x20\x09-\x0D]+') AS words FROM documents),
sets AS (
  SELECT doc_id, CASE WHEN len(words) = 0 THEN [] WHEN len(words) < 5 THEN [words]
    ELSE list_distinct([list_slice(words, i, i + 4) FOR i IN range(1, len(words) - 3)]) END AS s FROM w),
sizes AS (SELECT doc_id, len(s)::BIGINT AS n FROM sets),
members AS (SELECT doc_id, unnest(s) AS shingle FROM sets),
pairs AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c
  FROM members a JOIN members b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (
  SELECT x, y FROM pairs JOIN sizes p ON p.doc_id = x JOIN sizes q ON q.doc_id = y
  WHERE 100 * c >= 75 * (p.n + q.n - c)),
both_ways AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
reach AS (SELECT doc_id AS x, doc_id AS y FROM documents
  UNION SELECT r.x, b.y FROM reach r JOIN both_ways b ON r.y = b.x)
SELECT doc_id, n AS n_shingles, component_id, doc_id = component_id AS kept
FROM sizes JOIN (SELECT x AS doc_id, min(y) AS component_id FROM reach GROUP BY x) USING (doc_id)
"""

_NEAREST = """
  SELECT vec_id, v, list_min(list_transform(range(1, len(cs) + 1), lambda k: {
    'd': list_sum(list_transform(range(1, 65), lambda i: (v[i] - cs[k][i]) * (v[i] - cs[k][i])))::BIGINT, 'k': k - 1})) AS near
  FROM kept, (SELECT list(c ORDER BY k) AS cs FROM c%d)"""


def _op11_sql(rounds: int = 10) -> str:
    """Each round is two tables: vectors with their nearest centroid, and the centroids moved."""
    steps = [
        """
kept AS MATERIALIZED (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: isfinite(x))) = 64),
c0 AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY h) - 1 AS k, v AS c
  FROM (SELECT v, sha256('3:' || vec_id) AS h FROM kept ORDER BY h LIMIT 8))"""
    ]
    for i in range(rounds):
        steps.append(f"a{i} AS MATERIALIZED ({_NEAREST % i})")
        steps.append(f"""
c{i + 1} AS MATERIALIZED (
  SELECT c{i}.k, coalesce(m.c, c{i}.c) AS c FROM c{i} LEFT JOIN (
    SELECT k, list(((s - ((s % n) + n) % n) // n)::BIGINT ORDER BY i) AS c FROM (
      SELECT near.k AS k, i, sum(v[i]) AS s, count(*) AS n
      FROM a{i}, (SELECT unnest(range(1, 65)) AS i) GROUP BY 1, 2) GROUP BY k) m USING (k))""")
    return f"""WITH {",".join(steps)},
last AS MATERIALIZED ({_NEAREST % rounds})
SELECT vec_id, near.k::INTEGER AS cluster, near.d AS distance,
  (sum(near.d) OVER (PARTITION BY near.k))::BIGINT AS cluster_inertia, (sum(near.d) OVER ())::BIGINT AS inertia,
  sha256(array_to_string(c, ',')) AS centroid_sha256
FROM last JOIN c{rounds} ON near.k = c{rounds}.k
"""


OP12_SQL = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents),
words AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
totals AS (SELECT lang, sum(len(w))::BIGINT AS n FROM words GROUP BY 1),
runs AS (SELECT lang, w, size, unnest(range(1, len(w) - size + 2)) AS s FROM words, (SELECT unnest(range(1, 6)) AS size)),
f AS (
  SELECT lang, size, array_to_string(list_slice(w, s, s + size - 1), ' ') AS phrase, count(*) AS n
  FROM runs GROUP BY 1, 2, 3 HAVING count(*) >= 100),
inner_runs AS (
  SELECT lang, n, string_split(phrase, ' ') AS w, size, k, unnest(range(1, size - k + 2)) AS s
  FROM f, (SELECT unnest(range(2, 5)) AS k) WHERE k < size),
longer AS (SELECT lang, array_to_string(list_slice(w, s, s + k - 1), ' ') AS phrase, max(n) AS n FROM inner_runs GROUP BY 1, 2),
candidates AS (
  SELECT f.lang, f.size, f.phrase, f.n AS a, string_split(f.phrase, ' ') AS w
  FROM f LEFT JOIN longer USING (lang, phrase) WHERE f.size > 1 AND (longer.n IS NULL OR 100 * longer.n < 100 * f.n)),
cuts AS (SELECT lang, size, phrase, a, w, unnest(range(1, size)) AS k FROM candidates),
scored AS (
  SELECT c.lang, c.phrase, c.a, k, l.n AS l, r.n AS r, t.n,
    ((1000::HUGEINT * c.a * t.n) // (l.n::HUGEINT * r.n))::BIGINT AS score
  FROM cuts c JOIN f l ON l.lang = c.lang AND l.phrase = array_to_string(w[1:k], ' ')
  JOIN f r ON r.lang = c.lang AND r.phrase = array_to_string(w[k + 1:c.size], ' ') JOIN totals t ON t.lang = c.lang),
best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank, phrase, a, l, r, n, score
FROM best QUALIFY rank <= 2000
"""

ORACLES: dict[str, str] = {
    "op2_substring_dedup": OP2_SQL,
    "op3_line_frequency": OP3_SQL,
    "op6_warc": OP6_SQL,
    "op7_near_duplicates": OP7_SQL,
    "op11_centroids": _op11_sql(),
    "op12_collocations": OP12_SQL,
}
