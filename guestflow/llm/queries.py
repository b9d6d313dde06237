"""One registered query per corpus operator, and DuckDB SQL where it can express one.

Each query is thin: it runs its operator over the whole intended table with the
production parameters and derives the digest columns of its result."""
from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from guestflow.llm.codes import compress
from guestflow.llm.common import fold, read
from guestflow.llm.decontaminate import report
from guestflow.llm.html import extract
from guestflow.llm.langid import identify
from guestflow.llm.lines import line_dedup
from guestflow.llm.manifest import build, verified
from guestflow.llm.merkle import changed_sections, likeness, with_next
from guestflow.llm.packing import pack
from guestflow.llm.quality import quality
from guestflow.llm.simhash import simhash_components
from guestflow.llm.substring import substring_dedup
from guestflow.llm.toxicity import toxicity
from guestflow.llm.warc import archived
from guestflow.session import scratch_folder


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(read(spark, sf_dir, "documents"), capacity=2048, end_id=0)


def op3_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = with_next(read(spark, sf_dir, "documents"))
    fp, edited = F.col("fingerprint"), F.col("edited_fingerprint")
    return d.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), "fingerprint", "edited_fingerprint",
                    likeness(fp, edited).alias("near_edited"), likeness(fp, F.col("next_fingerprint")).alias("near_next"),
                    F.size(changed_sections(fp, edited)).alias("n_changed_sections"))


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = substring_dedup(read(spark, sf_dir, "documents"), window=20)
    return d.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = report(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"), n=13, share=20)
    return d.drop("hits", "items", "of")


def op6_quality_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = line_dedup(read(spark, sf_dir, "documents"), edits=2, min_chars=20)
    return d.select("doc_id", "n_lines", "n_removed", "n_links",
                    F.array_join(F.transform("first_docs", lambda x: x.cast("string")), ",").alias("first_docs"),
                    F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def op8_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = extract(read(spark, sf_dir, "pages"))
    return d.select("page_id", "url", "text", F.length("text").cast("bigint").alias("n_chars"))


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = simhash_components(read(spark, sf_dir, "documents"), shingle=3, radius=3)
    return d.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(read(spark, sf_dir, "documents"))


def op11_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    lower = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    found = F.when(fold("doc_id", 3) == 0, lower).otherwise(F.col("text"))
    return verified(build(read(spark, sf_dir, "documents"), found)).withColumnRenamed("proof", "proof_sha256")


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = compress(read(spark, sf_dir, "embeddings"), "embedding", parts=16, entries=64, rounds=2)
    return d.select("vec_id", "code", "error", "label_error", "codebooks_sha256")


def op13_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{scratch_folder(spark)}/warc-{uuid.uuid4().hex}"
    d = archived(read(spark, sf_dir, "pages"), path, min_bytes=0)
    return d.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "state")


QUERIES = {f.__name__: f for f in (
    op1_toxicity, op2_best_fit_packing, op3_merkle, op4_substring_dedup, op5_decontamination, op6_quality_rank,
    op7_line_dedup, op8_html_extraction, op9_simhash,
    op10_language_id, op11_manifest, op12_vector_codes, op13_warc)}

_WORDS4 = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"
_WORDS5 = ("regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), "
           r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')")

# DuckDB's levenshtein counts bytes: the corpus's letters beyond ASCII become one byte each.
_FOREIGN = "éèçêóñüäößíÉÈÑÇÊÓÜÖÄÍ"
_BYTES = "".join(chr(c) for c in (*range(1, 9), *range(14, 14 + len(_FOREIGN) - 8)))
_COUNTS = ", ".join(f"length(line) - length(replace(line, '{c}', '')) AS c{c}" for c in "entahirosd")
_NEAR = " AND ".join(f"abs(x.c{c} - y.c{c}) <= 2" for c in "entahirosd")

# crc32 of the digits: per byte one step that takes it in and eight shifts.
_CRC = ("xor(list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(string_split(CAST(doc_id AS VARCHAR), ''), "
        "lambda c: [ascii(c)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))), "
        "lambda acc, x: CASE WHEN x >= 0 THEN xor(acc, x) WHEN acc % 2 = 1 THEN xor(acc // 2, 3988292384) ELSE acc // 2 END), 4294967295)")


def _field(x: str) -> str:
    return f"coalesce(CAST(strlen(CAST({x} AS VARCHAR)) AS VARCHAR) || ':' || CAST({x} AS VARCHAR), '-')"


def _leaf(text: str) -> str:
    return f"sha256({' || '.join(_field(x) for x in ('doc_id', 'source', 'lang', 'n_chars', text))})"


def _tree(name: str, leaves: str) -> str:
    """CTEs: all nodes of the trees over (tree, pos, h, n), and per node the sides of its siblings."""
    return f"""
{name}(tree, level, pos, h, n) AS (
  SELECT tree, 0, pos, h, n FROM {leaves}
  UNION ALL SELECT tree, level + 1, pos // 8, sha256(string_agg(h, '' ORDER BY pos)), (any_value(n) + 7) // 8
  FROM {name} WHERE n > 1 GROUP BY tree, level, pos // 8),
{name}_sides AS (
  SELECT tree, level, pos, n, h,
         coalesce(string_agg(h, '') OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS l,
         coalesce(string_agg(h, '') OVER (w ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS r
  FROM {name} WINDOW w AS (PARTITION BY tree, level, pos // 8 ORDER BY pos))"""


_NEAREST = """
a{k} AS (SELECT vec_id, p, min(list_sum(list_transform(list_zip(q.x, b.x), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) * 64 + e) AS k
         FROM q JOIN b{k} b USING (p) GROUP BY vec_id, p)"""
_MEAN = """
m{k} AS (SELECT p, e, list(floor(s / c)::BIGINT ORDER BY i) AS x FROM (
           SELECT a.p, a.k % 64 AS e, i, sum(q.x[i])::DOUBLE AS s, count(*) AS c
           FROM a{k} a JOIN q USING (vec_id, p), range(1, 65) r(i) WHERE i <= len(q.x) GROUP BY a.p, a.k % 64, i) GROUP BY p, e),
b{n} AS (SELECT p, e, coalesce(m.x, b.x) AS x FROM b{k} b LEFT JOIN m{k} m USING (p, e))"""

ORACLE = {
    "op11_manifest": f"""
WITH RECURSIVE d AS (SELECT doc_id, lang, {_leaf('text')} AS h, CASE WHEN {_CRC} % 3 = 0
         THEN {_leaf("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} ELSE {_leaf('text')} END AS f FROM documents),
leaves AS (SELECT coalesce('=' || lang, '-') AS tree, doc_id, h, f, row_number() OVER (PARTITION BY lang ORDER BY doc_id, h) - 1 AS pos,
                  count(*) OVER (PARTITION BY lang) AS n FROM d),{_tree('t', 'leaves')},
subs AS (SELECT tree, h AS subroot FROM t WHERE n = 1),
tops AS (SELECT 0 AS tree, tree AS of, subroot AS h, row_number() OVER (ORDER BY tree) - 1 AS pos, count(*) OVER () AS n FROM subs),{_tree('u', 'tops')},
steps AS (SELECT l.tree, l.pos, s.level, s.l, s.r FROM leaves l JOIN t_sides s ON s.tree = l.tree AND s.n > 1 AND s.pos = l.pos // (8 ** s.level)::BIGINT
          UNION ALL SELECT l.tree, l.pos, 100 + s.level, s.l, s.r FROM leaves l JOIN tops ON tops.of = l.tree
          JOIN u_sides s ON s.n > 1 AND s.pos = tops.pos // (8 ** s.level)::BIGINT),
proofs AS (SELECT tree, pos, list(struct_pack(l := l, r := r) ORDER BY level) AS p FROM steps GROUP BY tree, pos),
folds(tree, pos, k, acc, p) AS (
  SELECT l.tree, l.pos, 1, l.f, coalesce(p, []) FROM leaves l LEFT JOIN proofs USING (tree, pos)
  UNION ALL SELECT tree, pos, k + 1, sha256(p[k].l || acc || p[k].r), p FROM folds WHERE k <= len(p)),
root AS (SELECT h AS root FROM u WHERE n = 1)
SELECT doc_id, l.h AS leaf, subroot, root, sha256(coalesce(array_to_string(list_transform(p, lambda s: s.l || s.r), ''), '')) AS proof_sha256,
       acc AS folded_root, acc = root AS verified
FROM folds JOIN leaves l USING (tree, pos) JOIN subs USING (tree), root WHERE k > len(p)""",
    "op12_vector_codes": f"""
WITH kept AS (SELECT vec_id, label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS x FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
q AS (SELECT vec_id, p, x[p * (len(x) // 16) + 1:(p + 1) * (len(x) // 16)] AS x FROM kept, range(16) r(p)),
seeds AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS e FROM kept ORDER BY vec_id LIMIT 64),
b0 AS (SELECT p, e, x FROM seeds JOIN q USING (vec_id)),{_NEAREST.format(k=0)},{_MEAN.format(k=0, n=1)},{_NEAREST.format(k=1)},{_MEAN.format(k=1, n=2)},{_NEAREST.format(k=2)},
codes AS (SELECT vec_id, string_agg(lpad(to_hex(k::BIGINT % 64), 2, '0'), '' ORDER BY p) AS code, sum(k // 64)::BIGINT AS error FROM a2 GROUP BY vec_id),
books AS (SELECT sha256(string_agg(array_to_string(list_transform(x, lambda v: CAST(v AS VARCHAR)), ','), ',' ORDER BY p, e)) AS s FROM b2)
SELECT vec_id, lower(code) AS code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, s AS codebooks_sha256
FROM codes JOIN kept USING (vec_id), books""",
    "op13_warc": """
WITH h AS (SELECT page_id, coalesce(html, '') AS html, upper(sha1(coalesce(html, ''))) AS x FROM pages)
SELECT page_id, strlen(html)::BIGINT AS payload_bytes,
       array_to_string(list_transform(range(8), lambda g: array_to_string(list_transform([32768, 1024, 32, 1], lambda d:
         substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (CAST('0x' || substr(x, (5 * g + 1)::INT, 5) AS BIGINT) // d % 32 + 1)::INT, 1)), '')), '') AS payload_digest,
       CASE WHEN page_id = min(page_id) OVER w THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id = min(page_id) OVER w THEN NULL ELSE min(page_id) OVER w END AS refers_to, 'ok' AS state
FROM h WINDOW w AS (PARTITION BY html)""",
    "op7_line_dedup": f"""
WITH RECURSIVE l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line,
                            unnest(range(len(string_split(text, chr(10))))) AS line_no FROM documents),
nb AS (SELECT * FROM l WHERE trim(line, ' ') <> ''),
u AS (SELECT line, translate(line, '{_FOREIGN}', '{_BYTES}') AS t, length(line) AS n, {_COUNTS}
      FROM (SELECT DISTINCT line FROM nb WHERE length(line) >= 20)),
links AS (SELECT x.line AS a, y.line AS b FROM u x JOIN u y ON y.n BETWEEN x.n AND x.n + 2 AND (x.n < y.n OR x.line < y.line)
          AND {_NEAR} WHERE levenshtein(x.t, y.t) <= 2),
sym AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach(x, y) AS (SELECT a, b FROM sym UNION SELECT r.x, s.b FROM reach r JOIN sym s ON r.y = s.a),
root AS (SELECT x AS line, least(min(y), x) AS c FROM reach GROUP BY x),
deg AS (SELECT a AS line, count(*) AS d FROM sym GROUP BY a),
occ AS (SELECT doc_id, line_no, coalesce(root.c, nb.line) AS c, coalesce(d, 0) AS d,
               row_number() OVER (PARTITION BY coalesce(root.c, nb.line) ORDER BY doc_id, line_no) AS k,
               first_value(doc_id) OVER (PARTITION BY coalesce(root.c, nb.line) ORDER BY doc_id, line_no) AS f
        FROM nb LEFT JOIN root ON root.line = nb.line LEFT JOIN deg ON deg.line = nb.line),
doc AS (SELECT doc_id, count(*) AS n, sum(CASE WHEN k > 1 THEN 1 ELSE 0 END) AS gone, sum(d) AS links FROM occ GROUP BY doc_id),
firsts AS (SELECT doc_id, string_agg(f, ',' ORDER BY f) AS f
           FROM (SELECT DISTINCT doc_id, f FROM occ WHERE k > 1) GROUP BY doc_id),
kept AS (SELECT l.doc_id, string_agg(line, chr(10) ORDER BY l.line_no) AS t
         FROM l ANTI JOIN (SELECT * FROM occ WHERE k > 1) o ON o.doc_id = l.doc_id AND o.line_no = l.line_no GROUP BY l.doc_id)
SELECT d.doc_id, coalesce(doc.n, 0)::BIGINT AS n_lines, coalesce(gone, 0)::BIGINT AS n_removed, coalesce(links, 0)::BIGINT AS n_links,
       coalesce(firsts.f, '') AS first_docs, sha256(coalesce(kept.t, '')) AS kept_sha256
FROM documents d LEFT JOIN doc USING (doc_id) LEFT JOIN firsts USING (doc_id) LEFT JOIN kept USING (doc_id)""",
    "op4_substring_dedup": f"""
WITH d AS (SELECT doc_id, {_WORDS4} AS w FROM documents),
s AS (SELECT doc_id, unnest(list_transform(range(1, len(w) - 18), lambda i: {{'i': i, 'g': array_to_string(w[i:i + 19], ' ')}})) AS s
      FROM d WHERE len(w) >= 20),
g AS (SELECT doc_id, s.i AS i, row_number() OVER (PARTITION BY s.g ORDER BY doc_id, s.i) AS k FROM s),
gone AS (SELECT DISTINCT doc_id, i + unnest(range(20)) AS i FROM g WHERE k > 1),
w AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS i FROM d),
kept AS (SELECT w.doc_id, string_agg(word, ' ' ORDER BY w.i) AS t, count(*) AS n
         FROM w ANTI JOIN gone ON w.doc_id = gone.doc_id AND w.i = gone.i GROUP BY w.doc_id)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, (len(d.w) - coalesce(n, 0))::BIGINT AS n_removed,
       sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)""",
    "op5_decontamination": f"""
WITH b AS (SELECT CAST(item_id AS VARCHAR) AS item, {_WORDS5} AS w FROM benchmark),
bw AS (SELECT DISTINCT item, least(len(w), 13) AS k, array_to_string(w[i:i + least(len(w), 13) - 1], ' ') AS g
       FROM (SELECT item, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
d AS (SELECT doc_id, {_WORDS5} AS w FROM documents),
ks AS (SELECT DISTINCT k FROM bw),
s AS (SELECT doc_id, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: {{'i': i, 'g': array_to_string(w[i:i + k - 1], ' ')}})) AS s
      FROM d, ks WHERE len(w) >= k),
h AS (SELECT doc_id, s.s.i AS i, s.k AS k, item FROM s JOIN bw ON bw.g = s.s.g AND bw.k = s.k),
hits AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, i + unnest(range(k)) AS p FROM h) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n, string_agg(item, ',' ORDER BY item) AS t
          FROM (SELECT DISTINCT doc_id, item FROM h) GROUP BY doc_id)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(hits.n, 0)::BIGINT AS n_hit, coalesce(items.n, 0)::BIGINT AS n_items,
       sha256(coalesce(items.t, '')) AS items_sha256,
       (coalesce(hits.n, 0) > 0 AND 20 * coalesce(hits.n, 0) >= len(d.w)) AS contaminated
FROM d LEFT JOIN hits USING (doc_id) LEFT JOIN items USING (doc_id)""",
}
