"""The registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from icspark.llm import chat, decontam, extract, langid, lines, minhash, nndescent, packing, substrings, toxicity
from icspark.llm.common import table


def op1_nn_descent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nndescent.near_duplicates(table(spark, sf_dir, "embeddings"))


def op2_phrase_automata(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.report(table(spark, sf_dir, "documents"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = toxicity.score(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))
    return scored.selectExpr("doc_id", "pmod(crc32(cast(cast(doc_id as string) as binary)), 5) = 0 as held_out", "score", "cast(score >= 0.5 as int) as predicted")


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_line_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.report(table(spark, sf_dir, "documents"))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op7_superminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.groups(table(spark, sf_dir, "documents"))


def op8_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.extract(table(spark, sf_dir, "pages"))


#: A conversation whose texts hold the template's own control strings.
CONTROL = r"\### Assistant: </turn> ok"


def op9_chat_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    talk = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.createDataFrame([(-7, 0, "user", CONTROL), (-7, 1, "assistant", CONTROL)], "conv_id long, turn long, role string, text string")
    return chat.digest(chat.windows(talk.unionByName(extra)))


def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "pages"), langid.train(table(spark, sf_dir, "documents")))


QUERIES = {f.__name__: f for f in (op1_nn_descent, op2_phrase_automata, op3_toxicity, op4_decontamination, op5_line_chunks, op6_packing, op7_superminhash, op8_main_text, op9_chat_windows, op10_language)}

_ROOTS = """
, reach(id, root) AS (
  SELECT a, b FROM links UNION SELECT b, a FROM links UNION SELECT r.id, CASE WHEN l.a = r.root THEN l.b ELSE l.a END
  FROM reach r JOIN links l ON l.a = r.root OR l.b = r.root
), roots AS (SELECT id, least(id, min(root)) AS root FROM reach GROUP BY id)
"""

ORACLE_SQL = {
    "op1_nn_descent": f"""
WITH RECURSIVE good AS (
  SELECT vec_id, [CAST(x AS DOUBLE) for x in embedding] AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len([x for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0 AND len([x for x in embedding if x <> 0]) > 0
), links AS (
  SELECT x.vec_id AS a, y.vec_id AS b FROM good x JOIN good y ON x.vec_id < y.vec_id AND len(x.v) = len(y.v) WHERE list_cosine_similarity(x.v, y.v) >= 0.9
){_ROOTS}, degree AS (SELECT id, count(*) AS n FROM (SELECT a AS id FROM links UNION ALL SELECT b FROM links) GROUP BY id)
SELECT e.vec_id, coalesce(d.n, 0) AS n_links, coalesce(r.root, e.vec_id) AS component_id, coalesce(r.root, e.vec_id) = e.vec_id AS kept
FROM embeddings e LEFT JOIN degree d ON d.id = e.vec_id LEFT JOIN roots r ON r.id = e.vec_id
""",
    "op2_phrase_automata": r"""
WITH w AS (
  SELECT doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS words FROM documents
), starts AS (
  SELECT doc_id, s, array_to_string(words[s : s + 49], ' ') AS phrase FROM (SELECT doc_id, words, unnest(range(1, len(words) - 48)) AS s FROM w)
), firsts AS (
  SELECT phrase, min(doc_id) AS first_doc FROM starts GROUP BY phrase HAVING min(doc_id) <> max(doc_id)
), gone AS (
  SELECT DISTINCT doc_id, unnest(range(s, s + 50)) AS i FROM starts JOIN firsts USING (phrase) WHERE first_doc < doc_id
), each_word AS (
  SELECT doc_id, i, words[i] AS word FROM (SELECT doc_id, words, unnest(range(1, len(words) + 1)) AS i FROM w)
), kept AS (
  SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS text, count(*) AS n FROM each_word ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id
)
SELECT w.doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(len(words) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(text, '')) AS kept_sha256
FROM w LEFT JOIN kept USING (doc_id)
""",
    "op4_decontamination": r"""
WITH w AS (
  SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS words FROM documents
), b AS (
  SELECT item_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS words FROM benchmark
), grams AS (
  SELECT DISTINCT item_id, n, array_to_string(words[s : s + n - 1], ' ') AS gram
  FROM (SELECT item_id, words, n, unnest(range(1, len(words) - n + 2)) AS s FROM (SELECT item_id, words, CAST(least(10, len(words)) AS BIGINT) AS n FROM b WHERE len(words) > 0))
), starts AS (
  SELECT doc_id, s, n, array_to_string(words[s : s + n - 1], ' ') AS gram
  FROM (SELECT doc_id, words, n, unnest(range(1, len(words) - n + 2)) AS s FROM w, (SELECT DISTINCT n FROM grams) WHERE len(words) >= n)
), hits AS (
  SELECT doc_id, s, n, item_id FROM starts JOIN grams USING (n, gram)
), covered AS (
  SELECT doc_id, count(DISTINCT i) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + n)) AS i FROM hits) GROUP BY doc_id
), items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS listed FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hits) GROUP BY doc_id
)
SELECT w.doc_id, CAST(len(words) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(listed, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM w LEFT JOIN covered USING (doc_id) LEFT JOIN items USING (doc_id)
""",
    "op5_line_chunks": r"""
WITH each_line AS (
  SELECT doc_id, i, lines[i] AS line, CAST('0x' || substr(md5(lines[i]), 1, 7) AS BIGINT) AS h, len(lines) AS n
  FROM (SELECT doc_id, lines, unnest(range(1, len(lines) + 1)) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS lines FROM documents WHERE text IS NOT NULL))
), ends AS (
  SELECT *, (h + 31 * lag(h, 1, 0) OVER o + 961 * lag(h, 2, 0) OVER o) % 4 = 0 AS last FROM each_line WINDOW o AS (PARTITION BY doc_id ORDER BY i)
), numbered AS (
  SELECT *, coalesce(sum(CAST(last AS INT)) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS chunk FROM ends
), chunks AS (
  SELECT doc_id, chunk, min(i) AS first_line, count(*) AS n_lines, string_agg(line, chr(10) ORDER BY i) AS body FROM numbered GROUP BY doc_id, chunk
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY body ORDER BY doc_id, first_line) AS place FROM chunks WHERE n_lines > 1
), gone AS (SELECT doc_id, chunk, n_lines FROM ranked WHERE place > 1
), kept AS (
  SELECT doc_id, string_agg(line, chr(10) ORDER BY i) AS text, count(*) AS n FROM numbered ANTI JOIN gone USING (doc_id, chunk) GROUP BY doc_id
)
SELECT d.doc_id, coalesce(CAST(len(string_split(d.text, chr(10))) AS BIGINT), 0) AS n_lines, coalesce(CAST(len(string_split(d.text, chr(10))) AS BIGINT) - coalesce(k.n, 0), 0) AS n_removed,
  CASE WHEN d.text IS NOT NULL THEN sha256(coalesce(k.text, '')) END AS kept_sha256
FROM documents d LEFT JOIN kept k USING (doc_id)
""",
    "op7_superminhash": rf"""
WITH RECURSIVE w AS (
  SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'), []) AS words FROM documents
), sets AS (
  SELECT DISTINCT doc_id, array_to_string(words[s : s + 4], ' ') AS g
  FROM (SELECT doc_id, words, unnest(range(1, greatest(len(words) - 4, 1) + 1)) AS s FROM w WHERE len(words) > 0)
), sizes AS (SELECT doc_id, count(*) AS n FROM sets GROUP BY doc_id
), shared AS (
  SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM sets x JOIN sets y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY ALL
), links AS (
  SELECT a, b FROM shared JOIN sizes p ON p.doc_id = a JOIN sizes q ON q.doc_id = b WHERE 100 * c >= 85 * (p.n + q.n - c)
){_ROOTS}
SELECT w.doc_id, coalesce(s.n, 0) AS n_shingles, coalesce(r.root, w.doc_id) AS component_id, coalesce(r.root, w.doc_id) = w.doc_id AS kept
FROM w LEFT JOIN sizes s USING (doc_id) LEFT JOIN roots r ON r.id = w.doc_id
""",
}
