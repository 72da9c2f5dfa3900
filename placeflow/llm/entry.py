"""The queries of this subpackage and their SQL, for __spark_entry__.py."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .conversation_repair import damage, repair_report
from .decontaminate import find_leaks
from .interpolation import score_texts
from .jaccard import jaccard_components
from .langid import identify_language, learn_languages
from .line_dedup import dedup_lines
from .mixing import mix_to_weights
from .secrets import count_of, find_secrets, listing
from .spelling import spelling_forms, text_words
from .suffix_dedup import dedup_suffixes
from .toxicity import learn_toxicity, score_toxicity
from .vector_dedup import vector_links
from .window_dedup import dedup_windows


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def _fold(modulus: int, held: int) -> Column:
    """Whether crc32 of the doc_id's text leaves the remainder; false without doc_id."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % modulus == held, F.lit(False))


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document and benchmark item that occurs in it."""
    found = find_leaks(_read(spark, sf_dir, "documents").select("doc_id", "text"), _read(spark, sf_dir, "benchmark"))
    return found.select("doc_id", F.explode("leaks").alias("leak")).select("doc_id", "leak.item_id", "leak.distance")


def op2_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_texts(_read(spark, sf_dir, "documents").select("doc_id", "text"), _fold(5, 1))


def op3_window_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_windows(_read(spark, sf_dir, "documents").select("doc_id", "text")).drop("kept")


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    model = learn_toxicity(docs.where(~_fold(5, 0)), _read(spark, sf_dir, "labels"))
    return score_toxicity(docs.select("doc_id", "text", "lang"), model).select("doc_id", _fold(5, 0).alias("held_out"), "score", "predicted", "flagged")


def op5_vector_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_links(_read(spark, sf_dir, "embeddings")).drop("audit_recall")


def op6_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_to_weights(_read(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_suffixes(_read(spark, sf_dir, "documents").select("doc_id", "text")).drop("spans")


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    model = learn_languages(docs.where(~_fold(4, 2)))
    return identify_language(docs, model).select("doc_id", _fold(4, 2).alias("held_out"), "lang_pred", "score")


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = dedup_lines(_read(spark, sf_dir, "documents").select("doc_id", "text"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(_read(spark, sf_dir, "documents"))


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_forms(text_words(_read(spark, sf_dir, "documents").select("doc_id", "text"), every=97))


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair_report(damage(_read(spark, sf_dir, "conversations")), F.col("dropped"))


def op13_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, base = find_secrets(_read(spark, sf_dir, "documents")), F.col("base")
    counts = [count_of(base, kind).alias(f"n_{kind}") for kind in ("assign", "access", "hex")]
    return found.select("doc_id", *counts, F.sha2(listing(base), 256).alias("base_sha256"), listing(F.col("secrets")).alias("spans"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name.startswith("op") and callable(f)}


#: Lines of every document with their keys; the rule of op9.
_OP9 = r"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
  FROM documents),
keyed AS (
  SELECT doc_id, pos, line, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k FROM lines),
heavy AS (
  SELECT k, max(doc_id) AS last_doc FROM keyed WHERE length(k) >= 20 GROUP BY k HAVING count(DISTINCT doc_id) >= 3),
marked AS (
  SELECT a.doc_id, a.pos, a.line, h.k IS NOT NULL AND a.doc_id <> h.last_doc AS gone FROM keyed a LEFT JOIN heavy h ON a.k = h.k)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""


#: Windows of 13 words; the rule of op3.
_OP3 = r"""
WITH word AS MATERIALIZED (
  SELECT doc_id, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents)),
win AS (
  SELECT doc_id, i, concat_ws(' ', w, {leads}) AS k FROM word
  WINDOW o AS (PARTITION BY doc_id ORDER BY i) QUALIFY lead(w, 12) OVER o IS NOT NULL),
low AS (SELECT k, min(doc_id) AS lo FROM win GROUP BY k),
gone AS (SELECT DISTINCT doc_id, i + n AS i FROM win JOIN low USING (k), range(0, 13) t(n) WHERE doc_id > lo),
kept AS (
  SELECT word.doc_id, count(*) AS n_words, count(g.i) AS n_removed, string_agg(w, ' ' ORDER BY word.i) FILTER (WHERE g.i IS NULL) AS kept
  FROM word LEFT JOIN gone g ON word.doc_id = g.doc_id AND word.i = g.i GROUP BY word.doc_id)
SELECT doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM documents LEFT JOIN kept USING (doc_id)
""".replace("{leads}", ", ".join(f"lead(w, {n}) OVER o" for n in range(1, 13)))

#: Strings of 50 bytes, as hexadecimal digits; the rule of op7.
_OP7 = """
WITH d AS MATERIALIZED (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
block AS MATERIALIZED (
  SELECT doc_id, base, substr(x, 2 * base + 1, 226) AS x FROM (SELECT doc_id, x, unnest(range(0, length(x) // 2, 64)) AS base FROM d)),
win AS (SELECT doc_id, base + n AS i, substr(x, 2 * n + 1, 100) AS k FROM (SELECT doc_id, base, x, unnest(range(0, 64)) AS n FROM block) WHERE length(x) >= 2 * n + 100),
low AS (SELECT k, min(doc_id) AS lo FROM win GROUP BY k HAVING min(doc_id) < max(doc_id)),
start AS (SELECT doc_id, i FROM win JOIN low USING (k) WHERE doc_id > lo),
gone AS (SELECT DISTINCT doc_id, i + n AS i FROM start, range(0, 50) t(n)),
runs AS (SELECT doc_id, count(*) AS n_removed, count(*) FILTER (WHERE before IS NULL OR before < i - 1) AS n_spans FROM (SELECT doc_id, i, lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS before FROM gone) GROUP BY doc_id),
byte AS (
  SELECT doc_id, substr(x, 2 * n + 1, 2) AS b, base + n AS i FROM (SELECT doc_id, base, x, unnest(range(0, 64)) AS n FROM block WHERE doc_id IN (SELECT doc_id FROM runs)) WHERE length(x) > 2 * n),
kept AS (SELECT doc_id, string_agg(b, '' ORDER BY i) AS x FROM byte ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id)
SELECT doc_id, (length(d.x) // 2)::BIGINT AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans,
  sha256(unhex(CASE WHEN n_removed IS NULL THEN d.x ELSE coalesce(kept.x, '') END)) AS kept_sha256
FROM d LEFT JOIN runs USING (doc_id) LEFT JOIN kept USING (doc_id)
"""

#: All pairs of vectors; the rule of op5.
_OP5 = """
WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings),
s AS MATERIALIZED (
  SELECT vec_id, e, sqrt(list_inner_product(e, e)) AS n FROM v
  WHERE len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
link AS MATERIALIZED (SELECT a.vec_id AS u, b.vec_id AS v FROM s a JOIN s b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) WHERE list_inner_product(a.e, b.e) / (a.n * b.n) >= 0.95),
seen AS (SELECT vec_id, vec_id AS other FROM v UNION SELECT seen.vec_id, link.v FROM seen JOIN link ON other = u)
SELECT vec_id, coalesce(n_links, 0) AS n_links, component_id, vec_id = component_id AS kept FROM (SELECT vec_id, min(other) AS component_id FROM seen GROUP BY 1)
LEFT JOIN (SELECT u AS vec_id, count(*) AS n_links FROM link GROUP BY 1) USING (vec_id)
"""

#: Documents in the order of a digest of their id, until their source's target is met; the rule of op6 and of this library's thresholds.
_OP6 = r"""
WITH d AS MATERIALIZED (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size, ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 12))::BIGINT AS h FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, [5.0::DOUBLE, 2.0::DOUBLE, 1.0::DOUBLE][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS w FROM d GROUP BY source),
r AS (SELECT *, 3.0::DOUBLE * source_size / w AS ratio FROM s),
level AS (
  SELECT *, (sum(source_size) OVER () - coalesce(sum(3.0::DOUBLE * source_size) OVER below, 0.0))::DOUBLE / (sum(w) OVER () - coalesce(sum(w) OVER below, 0.0)) AS level FROM r
  WINDOW below AS (ORDER BY ratio, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
final AS (SELECT level FROM level WHERE ratio > level ORDER BY ratio LIMIT 1),
t AS (
  SELECT source, source_size, CASE WHEN source_size = 0 THEN 0.0 ELSE least(3.0::DOUBLE * source_size, w * coalesce((SELECT level FROM final), 'inf'::DOUBLE)) END AS target FROM r),
g AS (SELECT *, CASE WHEN source_size > 0 THEN least(floor(target / source_size), 3) ELSE 0 END::BIGINT AS whole FROM t),
c AS (
  SELECT d.*, g.source_size, g.target, g.whole, g.target - g.whole * g.source_size AS need, sum(size) OVER (PARTITION BY d.source ORDER BY h) AS upto, sum(size) OVER (PARTITION BY d.source, h) AS own
  FROM d JOIN g ON d.source IS NOT DISTINCT FROM g.source),
edge AS (SELECT source, min(h) AS h, min_by(upto - own, h) AS took, min_by(own, h) AS own, any_value(need) AS need FROM c WHERE upto > need GROUP BY source),
k AS (
  SELECT c.*, whole + CASE WHEN edge.h IS NULL OR c.h < edge.h THEN 1 WHEN c.h = edge.h AND edge.need - took > 0 AND abs(edge.need - took - edge.own) < edge.need - took THEN 1 ELSE 0 END AS copies
  FROM c LEFT JOIN edge ON c.source IS NOT DISTINCT FROM edge.source)
SELECT doc_id, size, source_size, target, (least(copies, 3) * size)::BIGINT AS taken FROM k
"""

#: All pairs of documents that share a shingle; the rule of op10.
_OP10 = r"""
WITH RECURSIVE word AS MATERIALIZED (
  SELECT doc_id, unnest(ws) AS w, generate_subscripts(ws, 1) AS i, len(ws) AS words
  FROM (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents)),
five AS (
  SELECT doc_id, i, words, concat_ws(' ', w, lead(w, 1) OVER o, lead(w, 2) OVER o, lead(w, 3) OVER o, lead(w, 4) OVER o) AS k FROM word WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
sh AS MATERIALIZED (SELECT DISTINCT doc_id, k FROM five WHERE i <= greatest(words - 4, 1)),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM sh GROUP BY 1),
met AS (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS c FROM sh a JOIN sh b ON a.k = b.k AND a.doc_id < b.doc_id GROUP BY ALL),
link AS (SELECT u, v FROM met JOIN n x ON u = x.doc_id JOIN n y ON v = y.doc_id WHERE 100 * c >= 80 * (x.n + y.n - c)),
both_ways AS MATERIALIZED (SELECT u, v FROM link UNION ALL SELECT v, u FROM link),
seen AS (SELECT doc_id, doc_id AS other FROM documents UNION SELECT seen.doc_id, v FROM seen JOIN both_ways ON other = u)
SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id FROM (SELECT doc_id, min(other) AS component_id FROM seen GROUP BY 1) LEFT JOIN n USING (doc_id)
"""

#: The table of crc32, made from its polynomial, and the crc32 of a string's bytes.
_CRC = """
crc AS (SELECT list_transform(range(256), lambda n: list_reduce(list_prepend(n, range(8)), lambda a, b: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END)) AS t)"""


def _crc32(text: str) -> str:
    """Where the one row of crc is in FROM."""
    octets = f"list_transform(range(strlen({text})), lambda i: ('0x' || substr(hex(encode({text})), 2 * i::INT + 1, 2))::BIGINT)"
    return f"xor(list_reduce(list_prepend(4294967295, {octets}), lambda c, b: xor(c >> 8, crc.t[xor(c & 255, b) + 1])), 4294967295)"


#: Words after typing errors; near words share what is left when a place is blanked, or one is the other without a place; the rule of op11.
_OP11 = rf"""
WITH RECURSIVE {_CRC.strip()},
run AS MATERIALIZED (
  SELECT doc_id, run, count(*) AS n FROM (
    SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\x{{C0}}-\x{{FF}}]+')) AS run FROM documents) WHERE length(run) >= 5 GROUP BY ALL),
hashed AS (SELECT run, n, {_crc32("(coalesce(doc_id::VARCHAR, '') || ':' || run)")} AS h FROM run, crc),
typed AS (SELECT n, CASE WHEN h % 97 = 0 THEN left(run, (h % length(run))::INT) || substr(run, (h % length(run))::INT + 2) ELSE run END AS word FROM hashed),
w AS MATERIALIZED (SELECT word, sum(n)::BIGINT AS n FROM typed WHERE length(word) >= 5 GROUP BY 1 HAVING sum(n) >= 3),
place AS MATERIALIZED (SELECT word, n, i, left(word, i::INT) AS head, substr(word, i::INT + 2) AS tail FROM (SELECT word, n, unnest(range(length(word))) AS i FROM w)),
near AS MATERIALIZED (
  SELECT a.word, b.word AS other, b.n AS m FROM place a JOIN place b ON a.i = b.i AND a.head = b.head AND a.tail = b.tail AND a.word <> b.word
  UNION SELECT a.word, b.word, b.n FROM place a JOIN w b ON b.word = a.head || a.tail UNION SELECT b.word, a.word, a.n FROM place a JOIN w b ON b.word = a.head || a.tail),
best AS (SELECT word, count(*) AS n_near, max(m) AS m, min(other) FILTER (WHERE m = top) AS other FROM (SELECT *, max(m) OVER (PARTITION BY word) AS top FROM near) GROUP BY 1),
form AS MATERIALIZED (SELECT w.word, n, coalesce(n_near, 0) AS n_near, CASE WHEN m >= 2 * n THEN other END AS form, CASE WHEN m >= 2 * n THEN m END AS form_n FROM w LEFT JOIN best USING (word)),
up AS (SELECT word, word AS reached, form AS next FROM form UNION ALL SELECT up.word, form.word, form.form FROM up JOIN form ON up.next = form.word)
SELECT f.word, f.form, reached AS root, f.n, f.n_near, f.form_n FROM form f JOIN up ON f.word = up.word AND up.next IS NULL
"""

#: Damage, faults, costs of the rest from every row and state on, and the cheapest edits traced with them; the rule of op12.
_OP12 = rf"""
WITH RECURSIVE {_CRC.strip()},
c AS MATERIALIZED (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, {_crc32("(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '))")} % 20 AS k FROM conversations, crc),
d AS (
  SELECT conv_id, turn, CASE WHEN k = 4 THEN 'user' ELSE role END AS role, CASE k WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text
  FROM c, range(2) t(copy) WHERE k <> 0 AND (copy = 0 OR k = 3)),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(length(role) || ':' || role || text)) AS i, left(role, 1) AS x, rtrim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS e FROM d),
r AS MATERIALIZED (
  SELECT *, CASE WHEN e = '' THEN 'b' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'd' WHEN right(e, 1) NOT IN ('.', '!', '?') THEN 't' ELSE '' END AS f, lag(x) OVER (PARTITION BY conv_id ORDER BY i) || x AS pair FROM o),
n AS (
  SELECT conv_id, count(*) AS n, count(*) FILTER (WHERE f = 'b') AS blank, count(*) FILTER (WHERE f = 'd') AS duplicate, count(*) FILTER (WHERE f = 't') AS truncated,
    count(*) FILTER (WHERE pair NOT IN ('su', 'ua', 'au')) AS illegal, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps FROM r GROUP BY conv_id),
rest AS (
  SELECT conv_id, n + 1 AS i, 0 AS b0, 10 AS b1, 5 AS b2, 0 AS b3 FROM n
  UNION ALL
  SELECT conv_id, i, least(c0, 5 + c2, 10 + c3), least(c1, 5 + c2, 10 + c3), least(c2, 5 + c3), least(c3, 5 + c2) FROM (
    SELECT r.conv_id, r.i, least(2 + b0, keep + CASE x WHEN 's' THEN least(b1, 1 + b2) WHEN 'u' THEN b2 ELSE 1 + b2 END) AS c0, least(2 + b1, keep + CASE x WHEN 'u' THEN 0 ELSE 1 END + b2) AS c1,
      least(2 + b2, keep + CASE x WHEN 'a' THEN 0 ELSE 1 END + b3) AS c2, least(2 + b3, keep + CASE x WHEN 'u' THEN 0 ELSE 1 END + b2) AS c3
    FROM rest JOIN (SELECT *, CASE f WHEN '' THEN 0 WHEN 't' THEN 5 ELSE 1000000 END AS keep FROM r) r ON r.conv_id IS NOT DISTINCT FROM rest.conv_id AND r.i = rest.i - 1)),
b AS MATERIALIZED (SELECT conv_id, i, unnest([0, 1, 2, 3]) AS q, unnest([b0, b1, b2, b3]) AS cost FROM rest),
path AS (
  SELECT conv_id, 1::BIGINT AS i, 0 AS q, '' AS audit, []::VARCHAR[] AS out FROM n
  UNION ALL
  SELECT conv_id, CASE edit WHEN 'I' THEN i ELSE i + 1 END, CASE edit WHEN 'D' THEN q WHEN 'S' THEN 1 ELSE nx END, audit || replace(edit, 'S', 'K'),
    CASE edit WHEN 'D' THEN out WHEN 'I' THEN list_append(out, nrole || ':') WHEN 'R' THEN list_append(out, nrole || ':' || text) ELSE list_append(out, role || ':' || text) END
  FROM (
    SELECT p.*, r.role, r.text, CASE WHEN p.q = 2 THEN 3 ELSE 2 END AS nx, CASE WHEN p.q = 2 THEN 'assistant' ELSE 'user' END AS nrole,
      CASE WHEN r.i IS NOT NULL AND 2 + d.cost = h.cost THEN 'D' WHEN 5 + s.cost = h.cost THEN 'I' WHEN r.i IS NULL THEN 'E'
        WHEN p.q = 0 AND r.x = 's' AND f IN ('', 't') AND CASE f WHEN 't' THEN 5 ELSE 0 END + k.cost = h.cost THEN 'S'
        WHEN r.x = CASE WHEN p.q = 2 THEN 'a' ELSE 'u' END AND f IN ('', 't') AND CASE f WHEN 't' THEN 5 ELSE 0 END + g.cost = h.cost THEN 'K' ELSE 'R' END AS edit
    FROM path p LEFT JOIN r ON r.conv_id IS NOT DISTINCT FROM p.conv_id AND r.i = p.i JOIN b h ON h.conv_id IS NOT DISTINCT FROM p.conv_id AND h.i = p.i AND h.q = p.q
    LEFT JOIN b d ON d.conv_id IS NOT DISTINCT FROM p.conv_id AND d.i = p.i + 1 AND d.q = p.q LEFT JOIN b k ON k.conv_id IS NOT DISTINCT FROM p.conv_id AND k.i = p.i + 1 AND k.q = 1
    LEFT JOIN b g ON g.conv_id IS NOT DISTINCT FROM p.conv_id AND g.i = p.i + 1 AND g.q = CASE WHEN p.q = 2 THEN 3 ELSE 2 END
    JOIN b s ON s.conv_id IS NOT DISTINCT FROM p.conv_id AND s.i = p.i AND s.q = CASE WHEN p.q = 2 THEN 3 ELSE 2 END)
  WHERE edit <> 'E'),
last AS (SELECT p.* FROM path p JOIN n ON n.conv_id IS NOT DISTINCT FROM p.conv_id WHERE p.i = n.n + 1 QUALIFY row_number() OVER (PARTITION BY p.conv_id ORDER BY length(audit) DESC) = 1)
SELECT a.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(b.cost, 0)::BIGINT AS cost,
  coalesce(audit, '') AS audit, sha256(coalesce(array_to_string(out, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) a LEFT JOIN n ON n.conv_id IS NOT DISTINCT FROM a.conv_id LEFT JOIN last ON last.conv_id IS NOT DISTINCT FROM a.conv_id
LEFT JOIN b ON b.conv_id IS NOT DISTINCT FROM a.conv_id AND b.i = 1 AND b.q = 0
"""


def oracle_sql() -> dict[str, str]:
    return {"op3_window_dedup": _OP3, "op5_vector_dedup": _OP5, "op6_mix_sources": _OP6, "op7_suffix_dedup": _OP7, "op9_line_dedup": _OP9, "op10_jaccard_join": _OP10, "op11_spelling_variants": _OP11, "op12_conversation_repair": _OP12}
