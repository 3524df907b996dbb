"""The corpus operators as queries over their whole tables: ``(spark, sf_dir) -> DataFrame``, and SQL where it can say the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from recordmill.llm.alignment import align_documents
from recordmill.llm.bytepairs import encoding_digests
from recordmill.llm.html_main import extract_main
from recordmill.llm.langid import language_id
from recordmill.llm.minhash import near_duplicates
from recordmill.llm.neighbours import quality_scores
from recordmill.llm.pieces import round_trip
from recordmill.llm.quality import quality_rules
from recordmill.llm.recount import recount, sample_edits
from recordmill.llm.secrets import secret_scan
from recordmill.llm.spelling import spelling_variants
from recordmill.llm.suffixes import remove_repeats
from recordmill.llm.tables import table
from recordmill.llm.tiling import contaminated_pairs
from recordmill.session import prepare

QUERIES: dict = {}


def query(fn):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return fn(prepare(spark), sf_dir)

    run.__name__ = fn.__name__
    QUERIES[fn.__name__] = run
    return fn


@query
def op1_minhash_near_dedup(spark, sf):
    return near_duplicates(table(spark, sf, "documents"))


@query
def op2_language_id(spark, sf):
    return language_id(table(spark, sf, "documents"))


@query
def op3_secret_scan(spark, sf):
    return secret_scan(table(spark, sf, "documents"))


@query
def op4_quality_rules(spark, sf):
    return quality_rules(table(spark, sf, "documents"))


@query
def op5_suffix_dedup(spark, sf):
    return remove_repeats(table(spark, sf, "documents"))


@query
def op6_benchmark_tiling(spark, sf):
    return contaminated_pairs(table(spark, sf, "documents"), table(spark, sf, "benchmark"))


@query
def op7_sentencepiece(spark, sf):
    return round_trip(table(spark, sf, "documents"))


@query
def op8_html_main_text(spark, sf):
    return extract_main(table(spark, sf, "pages"))

@query
def op9_neighbour_quality(spark, sf):
    return quality_scores(table(spark, sf, "documents"), table(spark, sf, "labels"))


@query
def op10_edit_recount(spark, sf):
    return recount(sample_edits(table(spark, sf, "documents")))


@query
def op11_spelling_variants(spark, sf):
    return spelling_variants(table(spark, sf, "documents"))


@query
def op12_bpe(spark, sf):
    return encoding_digests(table(spark, sf, "documents"))


@query
def op13_token_alignment(spark, sf):
    return align_documents(table(spark, sf, "documents"))


ORACLES: dict[str, str] = {
    "op11_spelling_variants": r"""
WITH RECURSIVE t AS (
  SELECT list_reduce(list_prepend(n, range(8)), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS x, n
  FROM (SELECT unnest(range(256)) AS n)),
crc AS (SELECT list(x ORDER BY n) AS x FROM t),
r AS (
  SELECT coalesce(doc_id::VARCHAR, '') AS d, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[A-Za-zÀ-ÿ]+')) AS w FROM documents),
u AS (SELECT d, w, count(*) AS n FROM r GROUP BY ALL),
h AS (
  SELECT w, n, xor(list_reduce(list_prepend(4294967295, list_transform(range(0, strlen(d || ':' || w)), lambda i:
    ('0x' || substr(hex(encode(d || ':' || w)), 2 * i + 1, 2))::BIGINT)), lambda c, b: xor(crc.x[(xor(c, b) & 255) + 1], c >> 8)), 4294967295) AS h
  FROM u, crc),
c AS (
  SELECT CASE WHEN h % 199 = 0 THEN substr(w, 1, (h % length(w))::BIGINT) || substr(w, (h % length(w))::BIGINT + 2) ELSE w END AS word, sum(n)::BIGINT AS n
  FROM h GROUP BY ALL),
v AS (SELECT word, n FROM c WHERE length(word) >= 6 AND n >= 5),
x AS (SELECT word, k, substr(word, 1, k) || substr(word, k + 2) AS rest FROM (SELECT word, unnest(range(length(word))) AS k FROM v)),
p AS (
  SELECT a.word, b.word AS near FROM x a JOIN x b ON a.rest = b.rest AND a.k = b.k AND a.word <> b.word
  UNION SELECT x.word, v.word FROM x JOIN v ON x.rest = v.word
  UNION SELECT v.word, x.word FROM x JOIN v ON x.rest = v.word),
b AS (
  SELECT p.word, count(*) AS n_near, max(v.n) AS top, arg_min(p.near, (-v.n, p.near)) AS near FROM p JOIN v ON v.word = p.near GROUP BY ALL),
f AS (
  SELECT v.word, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN top >= 5 * v.n THEN near END AS form, CASE WHEN top >= 5 * v.n THEN top END AS form_n
  FROM v LEFT JOIN b USING (word)),
z AS (SELECT word, word AS root, 0 AS step FROM f UNION ALL SELECT z.word, f.form, step + 1 FROM z JOIN f ON f.word = z.root WHERE f.form IS NOT NULL)
SELECT f.word, form, root, n, n_near, form_n FROM f JOIN (SELECT word, arg_max(root, step) AS root FROM z GROUP BY word) USING (word)
""",
    "op1_minhash_near_dedup": r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) < 2 THEN list_transform(w, lambda x: x)
    ELSE list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) END) AS g FROM d),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY ALL),
sets AS (SELECT doc_id, list_sort(list(g)) AS gs FROM s GROUP BY ALL),
class AS (SELECT gs, min(doc_id) AS c FROM sets GROUP BY ALL),
cs AS (SELECT c, unnest(gs) AS g FROM class),
p AS (SELECT a.c AS a, b.c AS b, count(*) AS k FROM cs a JOIN cs b ON a.g = b.g AND a.c < b.c GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 80 * (x.n + y.n - k)),
e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
r AS (SELECT c AS a, c AS b FROM class UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a),
low AS (SELECT a, min(b) AS m FROM r GROUP BY ALL)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(m, d.doc_id) AS component_id, coalesce(m, d.doc_id) = d.doc_id AS kept
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN sets USING (doc_id) LEFT JOIN class USING (gs) LEFT JOIN low ON low.a = class.c
""",
}
