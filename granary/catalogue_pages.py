"""Further registered queries with their SQL: tables over page breaks, JSON of models' answers, reports."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from granary.catalogue import _KNN, _RRF, _knn, query, read, rrf_fusion
from granary.functions import model_json as J
from granary.operators import page_tables, report


def _sheets(docs):
    """Every document as a page: its lines as cells of rows, under heads, notes or other text by its id."""
    cells = F.concat(F.lit("| "), F.replace("text", F.lit("\n"), F.lit(" | ")), F.lit(" |"))
    head, last = F.lit("| name | value |\n|---|---|\n"), F.lit("\n| sum | 0 |\n")
    kind = F.pmod("doc_id", F.lit(7))
    text = (
        F.when(kind == 0, F.concat(F.col("text"), F.lit("\n\n"), head, cells, last))
        .when(kind.isin(1, 2), F.concat(F.lit("(goes on)\n"), head, cells, last, F.lit("\n")))
        .when(kind == 3, F.concat(cells, F.lit("\n\nnote\n"), head, cells))
        .when(kind == 4, F.concat(cells, F.lit("\nend of table\n"), F.col("text")))
        .when(kind == 5, F.concat(F.lit("\n"), head))
        .otherwise(F.concat(head, cells))
    )
    return docs.select(F.col("source").alias("file"), F.col("doc_id").alias("page"), text.alias("text"))


_SHEETS = r"""
WITH RECURSIVE c AS (SELECT source AS file, doc_id AS page, text, '| ' || replace(text, chr(10), ' | ') || ' |' AS cells, '| name | value |' || chr(10) || '|---|---|' || chr(10) AS head, chr(10) || '| sum | 0 |' || chr(10) AS last FROM documents),
s AS (SELECT file, page, CASE page % 7 WHEN 0 THEN text || chr(10) || chr(10) || head || cells || last WHEN 1 THEN '(goes on)' || chr(10) || head || cells || last || chr(10) WHEN 2 THEN '(goes on)' || chr(10) || head || cells || last || chr(10)
  WHEN 3 THEN cells || chr(10) || chr(10) || 'note' || chr(10) || head || cells WHEN 4 THEN cells || chr(10) || 'end of table' || chr(10) || text WHEN 5 THEN chr(10) || head ELSE head || cells END AS text FROM c),
"""
# one step of the recursion is one page of every file; lines are told apart by l (line), k (kind) and h (head)
_FOLD = r"""
l AS (SELECT file, page, row_number() OVER (PARTITION BY file ORDER BY page) AS n, string_split(text, chr(10)) AS l FROM s),
k AS (SELECT *, list_transform(l, lambda x: CASE WHEN regexp_matches(x, '^\s*$') THEN 'b' WHEN regexp_matches(x, '^\s*\|?\s*:?-{2,}:?\s*(\|\s*:?-{2,}:?\s*)+\|?\s*$') OR regexp_matches(x, '^\s*\|[\s:\-|]+\|\s*$') THEN 'r' WHEN regexp_matches(x, '^\s*\|(.+)\|\s*$') OR length(x) - length(replace(x, '|', '')) >= 3 THEN 't' ELSE 'x' END) AS k FROM l),
h AS (SELECT *, list_transform(range(1, len(l) + 1), lambda i: i < len(l) AND k[i + 1] = 'r' AND (starts_with(ltrim(l[i]), '|') OR length(l[i]) - length(replace(l[i], '|', '')) >= 2)) AS h FROM k),
d AS (SELECT *, coalesce(list_position(h[1:11], true), 0) AS dup, list_filter(k, lambda x: x <> 'b') AS shown FROM h),
f AS (SELECT *, coalesce(list_aggregate(list_filter(range(CASE WHEN dup > 0 THEN dup + 2 ELSE 1 END, 13), lambda i: i <= len(l) AND k[i] IN ('r', 't')), 'min'), 13) AS f FROM d),
g AS (SELECT *, list_filter(range(f, len(l) + 1), lambda i: NOT h[i] AND NOT (i > f AND h[i - 1])) AS kept,
  list_filter(range(1, least(f, len(l) + 1)), lambda i: k[i] <> 'b' AND (dup = 0 OR i < dup OR i > dup + 1)) AS lead FROM f),
p AS (SELECT file, page, n, len(list_filter(shown[1:8], lambda x: x = 't')) > 0 AS starts, coalesce(shown[-1] IN ('r', 't'), false) AS alone,
  coalesce(list_filter(kept, lambda i: k[i] <> 'b')[-1], 0) AS stop, coalesce(k[stop] IN ('r', 't'), true) AS after,
  list_transform(lead, lambda i: l[i]) AS lead, list_transform(list_filter(kept, lambda i: i <= stop), lambda i: l[i]) AS body, list_transform(list_filter(kept, lambda i: i > stop), lambda i: l[i]) AS tail,
  coalesce(list_filter(range(1, len(l) + 1), lambda i: k[i] <> 'b')[-1], 0) AS whole, l FROM g),
w AS (SELECT file, CAST(0 AS BIGINT) AS n, CAST(NULL AS BIGINT) AS page, CAST(NULL AS BIGINT) AS page_start, false AS open, false AS goes_on FROM (SELECT DISTINCT file FROM p)
  UNION ALL SELECT w.file, p.n, p.page, CASE WHEN open AND starts THEN w.page_start ELSE p.page END, CASE WHEN open AND starts THEN after ELSE alone END, open AND starts FROM w JOIN p ON w.file IS NOT DISTINCT FROM p.file AND p.n = w.n + 1),
m AS (SELECT w.file, w.n, w.page, page_start, CASE WHEN NOT goes_on OR len(lead) = 0 THEN [] ELSE list_append(lead, '') END AS lead, CASE WHEN goes_on THEN body ELSE l[1:whole] END AS body, CASE WHEN goes_on THEN tail ELSE l[whole + 1:] END AS tail
  FROM w JOIN p ON w.file IS NOT DISTINCT FROM p.file AND w.n = p.n)
SELECT file, page_start, max(page) AS page_end, count(*) AS pages, sha256(array_to_string(flatten(list(lead ORDER BY n DESC)) || flatten(list(body ORDER BY n)) || flatten(list(tail ORDER BY n DESC)), chr(10))) AS text FROM m GROUP BY file, page_start
"""


@query(_SHEETS + _FOLD)
def tables_over_pages(spark, d):
    return page_tables.merged_tables(_sheets(read(spark, d, "documents"))).withColumn("text", F.sha2("text", 256))


def _answers(docs):
    """Every document as a model's answer that holds its text as JSON: fenced, in strings, among words, or none at all."""
    escaped = lambda c: reduce(lambda x, p: F.replace(x, F.lit(p[0]), F.lit(p[1])), (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\t", "\\t"), ("\r", "\\r")), c)
    quoted = lambda c: F.concat(F.lit('"'), escaped(c), F.lit('"'))
    whole = F.concat(F.lit('{"id": '), F.col("doc_id").cast("string"), F.lit(', "text": '), quoted(F.col("text")), F.lit("}"))
    kind = F.pmod("doc_id", F.lit(7))
    fenced = lambda c: F.concat(F.lit("Here it is:\n```json\n"), c, F.lit("\n```\n"))
    answer = (
        F.when(kind == 0, whole).when(kind == 1, fenced(whole)).when(kind == 2, quoted(quoted(whole)))
        .when(kind == 3, F.concat(F.lit("The answer is "), whole, F.lit(" as asked.")))
        .when(kind == 4, F.translate(whole, '"', "“")).when(kind == 5, F.concat(F.lit("["), F.col("text"))).otherwise(fenced(quoted(whole)))
    )
    return docs.select("doc_id", answer.alias("answer"))


_QUOTED = """'"' || replace(replace(replace(replace(replace({}, '\\', '\\\\'), '"', '\\"'), chr(10), '\\n'), chr(9), '\\t'), chr(13), '\\r') || '"'"""
_ANSWERS = f"""
WITH w AS (SELECT doc_id, text, '{{"id": ' || doc_id || ', "text": ' || {_QUOTED.format('text')} || '}}' AS whole FROM documents),
q AS (SELECT *, {_QUOTED.format('whole')} AS once FROM w), z AS (SELECT *, {_QUOTED.format('once')} AS twice FROM q),
a AS (SELECT doc_id, CASE doc_id % 7 WHEN 0 THEN whole WHEN 1 THEN 'Here it is:' || chr(10) || '```json' || chr(10) || whole || chr(10) || '```' || chr(10) WHEN 2 THEN twice WHEN 3 THEN 'The answer is ' || whole || ' as asked.'
  WHEN 4 THEN replace(whole, '"', '“') WHEN 5 THEN '[' || text ELSE 'Here it is:' || chr(10) || '```json' || chr(10) || once || chr(10) || '```' || chr(10) END AS answer FROM z),
t AS (SELECT doc_id, regexp_replace(answer, '^\\s+|\\s+$', '', 'g') AS t FROM a),
f AS (SELECT doc_id, CASE WHEN strpos(t, '```json' || chr(10)) > 0 THEN trim(string_split(string_split(t, '```json' || chr(10))[2], '```')[1], chr(10) || ' ') ELSE t END AS t FROM t),
"""
# a string in a string is taken out three times
_TAKE = "{0} AS (SELECT doc_id, CASE WHEN starts_with(t, '\"') AND ends_with(t, '\"') AND json_valid(t) THEN json_extract_string(t, '$') ELSE t END AS t FROM {1}),"
_ANSWERS += " ".join(_TAKE.format(a, b) for a, b in (("d1", "f"), ("d2", "d1"), ("d3", "d2"))) + r"""
i AS (SELECT doc_id, t, CASE regexp_extract(t, '[{\[]') WHEN '{' THEN regexp_extract(t, '(?s)(\{.*\})', 1) WHEN '[' THEN regexp_extract(t, '(?s)(\[.*\])', 1) ELSE '' END AS inside FROM d3),
o AS (SELECT doc_id, CASE WHEN regexp_matches(t, '^[{\[]') THEN translate(t, '“”', '""') WHEN inside <> '' AND json_valid(inside) THEN translate(inside, '“”', '""') ELSE t END AS json FROM i)
SELECT doc_id, sha256(json) AS json, length(json) AS chars, json_valid(json) AS valid FROM o
"""


@query(_ANSWERS)
def model_answers(spark, d):
    found = _answers(read(spark, d, "documents")).select("doc_id", J.model_json(F.col("answer")).alias("json"))
    return found.select("doc_id", F.sha2("json", 256).alias("json"), F.length("json").cast("long").alias("chars"), J.is_json(F.col("json")).alias("valid"))


_RESPONSES = """
WITH r AS (SELECT doc_id, n_chars, '[{"index": ' || doc_id % 5 || ', "relevance_score": ' || n_chars % 4 || ', "score": 0.25}, {"index": "' || n_chars % 3 || '", "score": "0.5"}, {"score": 1}, {"index": ' || doc_id % 4 - 1 || ', "relevance": ' || n_chars || '}]' AS e FROM documents),
v AS (SELECT doc_id, n_chars, CASE doc_id % 4 WHEN 0 THEN '{"output": {"results": ' || e || '}}' WHEN 1 THEN '{"results": ' || e || '}' WHEN 2 THEN '{"data": ' || e || '}' ELSE '{"error": ' || e || '}' END AS response FROM r)
"""


@query(_RESPONSES + """, l AS (SELECT doc_id, json_extract(coalesce(json_extract(response, '$.output.results'), json_extract(response, '$.results'), json_extract(response, '$.data')), '$[*]') AS e FROM v),
u AS (SELECT doc_id, unnest(range(len(e))) AS place, unnest(e) AS e FROM l),
x AS (SELECT doc_id, place, CAST(json_extract_string(e, '$.index') AS BIGINT) AS i, CAST(json_extract_string(e, '$.relevance_score') AS DOUBLE) AS a, CAST(json_extract_string(e, '$.score') AS DOUBLE) AS b, CAST(json_extract_string(e, '$.relevance') AS DOUBLE) AS c FROM u),
g AS (SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY place) - 1 AS INTEGER) AS place, i AS candidate, coalesce(nullif(a, 0), nullif(b, 0), nullif(c, 0), 0) AS score FROM x WHERE i BETWEEN 0 AND 3)
SELECT v.doc_id, v.doc_id % 4 < 3 AS known, place, candidate, score FROM v LEFT JOIN g ON v.doc_id = g.doc_id""")
def rerank_responses(spark, d):
    """Every document as a re-ranker's response over four candidates; those of no known shape keep one row."""
    text = lambda c: c.cast("string")
    doc, n = F.col("doc_id"), F.col("n_chars")
    entries = F.concat(F.lit('[{"index": '), text(doc % 5), F.lit(', "relevance_score": '), text(n % 4), F.lit(', "score": 0.25}, {"index": "'), text(n % 3), F.lit('", "score": "0.5"}, {"score": 1}, {"index": '), text(doc % 4 - 1), F.lit(', "relevance": '), text(n), F.lit("}]"))
    response = F.when(doc % 4 == 0, F.concat(F.lit('{"output": {"results": '), entries, F.lit("}}")))
    for kind, name in ((1, "results"), (2, "data"), (3, "error")):
        response = response.when(doc % 4 == kind, F.concat(F.lit(f'{{"{name}": '), entries, F.lit("}")))
    scores = read(spark, d, "documents").select("doc_id", J.rerank_scores(response, F.lit(4)).alias("s"))
    return scores.select("doc_id", F.col("s").isNotNull().alias("known"), F.posexplode_outer("s").alias("place", "e")).select("doc_id", "known", "place", F.col("e.index").alias("candidate"), F.col("e.score").alias("score"))


@query(_KNN + """,
a AS (SELECT vec_id AS id, label, vec_id % 100 = 60 AS refusal, vec_id % 200 = 160 AS blank FROM embeddings WHERE vec_id % 20 = 0),
x AS (SELECT id, label, CASE WHEN id % 40 = 0 THEN 1 END AS page FROM a WHERE NOT refusal),
f AS (SELECT x.id, min(k.rank) FILTER (WHERE x.page IS NULL OR k.key % 3 = x.page) AS r, min(k.rank) AS p FROM x JOIN k ON k.query_id = x.id AND k.rank <= 10 JOIN embeddings e ON e.vec_id = k.key AND e.label = x.label GROUP BY x.id),
z AS (SELECT a.id, CASE WHEN refusal OR blank THEN 'skipped' WHEN id % 40 = 0 THEN 'page' ELSE 'file' END AS stratum, r, p FROM a LEFT JOIN f USING (id)),
m AS (SELECT stratum, k, CASE WHEN r <= k THEN 1.0 ELSE 0.0 END::DOUBLE AS hit, CASE WHEN r <= k THEN 1.0 / r ELSE 0.0 END::DOUBLE AS mrr, CASE WHEN p <= k THEN 1.0 ELSE 0.0 END::DOUBLE AS file_hit FROM z, (VALUES (1), (3), (5), (10)) g(k)),
u AS (SELECT * FROM m UNION ALL SELECT 'all', k, hit, mrr, file_hit FROM m WHERE stratum <> 'skipped')
SELECT stratum, k, count(*) AS samples, round(avg(hit) FILTER (WHERE stratum <> 'skipped'), 6) AS hit, round(avg(mrr) FILTER (WHERE stratum <> 'skipped'), 6) AS mrr, round(avg(file_hit) FILTER (WHERE stratum <> 'skipped'), 6) AS file_hit, round(avg(file_hit - hit) FILTER (WHERE stratum <> 'skipped'), 6) AS gap FROM u GROUP BY stratum, k""")
def retrieval_report(spark, d):
    """The query vectors as samples: the label is the expected file, every other one also expects a page."""
    e, number = read(spark, d, "embeddings"), F.col("vec_id")
    asked = e.where("vec_id % 20 = 0")
    samples = asked.select(number.alias("sample_id"), F.when(number % 200 != 160, "what").alias("question"), (number % 100 == 60).alias("expected_refusal"))
    expected = asked.where("vec_id % 100 <> 60").select(number.alias("sample_id"), F.col("label").alias("path"), F.when(number % 40 == 0, F.lit(1)).cast("long").alias("page"))
    files = e.select(number.alias("key"), F.col("label").alias("path"), (number % 3).alias("page"))
    ranked = _knn(spark, d).where("rank <= 10").join(files, "key").select(F.col("query_id").alias("sample_id"), "rank", "path", "page")
    return report.retrieval_report(samples, ranked, expected)


@query(_RRF + "SELECT query_id, count(*) AS candidates, count(rank_v) AS vector_hits, count(rank_b) AS term_hits, count(*) FILTER (WHERE rank_v IS NOT NULL AND rank_b IS NOT NULL) AS both_hits, count(*) FILTER (WHERE rank <= 4) AS evidence FROM x WHERE rank <= 50 GROUP BY query_id")
def trace_counters(spark, d):
    return report.trace_counters(rrf_fusion(spark, d), F.col("rank_v").isNotNull(), F.col("rank_b").isNotNull(), F.col("rank") <= 4)
