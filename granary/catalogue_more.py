"""Further registered queries with their SQL: normalising, payroll recall, builds, evaluation, answers."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from granary.catalogue import _BM25, _METRICS, _REGISTRY, _RUNS, _knn, _registry, _runs, query, questions, read
from granary.functions import text as T
from granary.operators import access, answer, build, evaluation, index, metrics, normalise, payroll
from granary.plans.cluster import shared_folder

# What the queries mix into texts and questions to exercise the rules.
FULL_WIDTH = ("ABCabc", "ＡＢＣａｂｃ")
_PAGE_NO = r"^\s*(第\s*\d{1,4}\s*页|-\s*\d{1,4}\s*-|\d{1,4}\s*/\s*\d{1,4})\s*$"


def _odd_text():
    """Full-width letters, carriage returns, a word read down a column and a page number."""
    head, tail = F.lit("工\r\n 资\r\n表 \r\n"), F.lit("\r\n\r\n\r\n\r\n- 12 -\r\n第 3 页")
    return F.concat(head, F.replace(F.translate("text", *FULL_WIDTH), F.lit("\n"), F.lit("\r\n")), tail)


_NORMAL = r"""
WITH t AS (SELECT doc_id, '工资表' || chr(10) || text AS p, '工' || chr(10) || ' 资' || chr(10) || '表 ' || chr(10) || text || chr(10) || chr(10) || chr(10) || chr(10) || '- 12 -' || chr(10) || '第 3 页' AS c FROM documents),
l AS (SELECT doc_id, c, list_filter(list_transform(string_split(p, chr(10)), lambda x: trim(regexp_replace(x, '[ \t\r\f\x0B]+', ' ', 'g'))), lambda x: NOT regexp_matches(x, '""" + _PAGE_NO + r"""')) AS x FROM t),
n AS (SELECT doc_id, trim(regexp_replace(array_to_string(x, chr(10)), '\n{3,}', chr(10) || chr(10), 'g'), ' ' || chr(10)) AS page, trim(regexp_replace(regexp_replace(c, '[ \t\r\f\x0B]+', ' ', 'g'), '\n{3,}', chr(10) || chr(10), 'g'), ' ' || chr(10)) AS chunk FROM l)
"""


@query(_NORMAL + "SELECT doc_id, sha256(page) AS page, CAST(length(page) AS BIGINT) AS n FROM n")
def page_normaliser(spark, d):
    page = normalise.page_text(_odd_text())
    return read(spark, d, "documents").select("doc_id", page.alias("p")).select("doc_id", F.sha2("p", 256).alias("page"), F.length("p").cast("long").alias("n"))


@query(_NORMAL + "SELECT doc_id, sha256(chunk) AS chunk FROM n")
def chunk_normaliser(spark, d):
    return read(spark, d, "documents").select("doc_id", F.sha2(normalise.chunk_text(_odd_text()), 256).alias("chunk"))


@query(r"""WITH t AS (SELECT doc_id, trim(CASE doc_id % 5 WHEN 0 THEN '  --- ==' WHEN 1 THEN 'x' WHEN 2 THEN ' 工资 ' ELSE text END) AS s FROM documents)
SELECT doc_id, length(s) > 1 AND NOT regexp_full_match(s, '[^\p{L}\p{N}]+') AS informative FROM t""")
def informative_text(spark, d):
    kind = F.col("doc_id") % 5
    c = F.when(kind == 0, "  --- ==").when(kind == 1, "x").when(kind == 2, " 工资 ").otherwise(F.col("text"))
    return read(spark, d, "documents").select("doc_id", normalise.is_informative(c).alias("informative"))


_FILES = """
WITH f AS (SELECT o_orderkey, 'data/' || CASE o_orderkey % 8 WHEN 0 THEN '员工工资表_2026年' || month(o_orderdate) || '月.xlsx' WHEN 1 THEN 'Finance_' || o_custkey || '.pdf' WHEN 2 THEN '员工手册.docx' WHEN 3 THEN 'notes.txt'
  WHEN 4 THEN 'plan.md' WHEN 5 THEN '销售报表.xlsx' WHEN 6 THEN '技术 HR.png' ELSE 'SALARY ' || o_custkey || '.csv' END AS path, CASE o_orderkey % 3 WHEN 0 THEN 'md' WHEN 1 THEN 'contract' END AS given, o_orderkey % 11 = 0 AS ocr, o_orderkey % 13 = 0 AS layout, o_orderstatus AS sheet FROM orders),
b AS (SELECT *, string_split(path, '/')[-1] AS name FROM f)
"""


def _files(spark, d):
    n = F.col("o_orderkey") % 8
    month, customer = F.month("o_orderdate").cast("string"), F.col("o_custkey").cast("string")
    name = (
        F.when(n == 0, F.concat(F.lit("员工工资表_2026年"), month, F.lit("月.xlsx"))).when(n == 1, F.concat(F.lit("Finance_"), customer, F.lit(".pdf"))).when(n == 2, "员工手册.docx").when(n == 3, "notes.txt")
        .when(n == 4, "plan.md").when(n == 5, "销售报表.xlsx").when(n == 6, "技术 HR.png").otherwise(F.concat(F.lit("SALARY "), customer, F.lit(".csv")))
    )
    given = F.when(F.col("o_orderkey") % 3 == 0, "md").when(F.col("o_orderkey") % 3 == 1, "contract")
    return read(spark, d, "orders").select("o_orderkey", F.concat(F.lit("data/"), name).alias("path"), given.alias("given"), (F.col("o_orderkey") % 11 == 0).alias("ocr"), (F.col("o_orderkey") % 13 == 0).alias("layout"), F.col("o_orderstatus").alias("sheet"))


@query(_FILES + """SELECT o_orderkey, CASE WHEN layout THEN 'layout_ocr' WHEN ocr THEN 'ocr' WHEN given = 'md' THEN 'md' WHEN path LIKE '%.pdf' THEN 'layout_ocr' WHEN path LIKE '%.txt' THEN 'txt' WHEN path LIKE '%.md' THEN 'md' WHEN path LIKE '%.docx' THEN 'docx' ELSE 'unknown' END AS source FROM b""")
def text_source(spark, d):
    return _files(spark, d).select("o_orderkey", normalise.text_source(F.col("layout"), F.col("ocr"), F.col("given"), F.col("path")).alias("source"))


@query(_FILES + """, k AS (SELECT *, CASE WHEN contains(lower(name), '工资') OR contains(lower(name), 'salary') THEN 'salary' WHEN contains(name, '报表') OR contains(lower(name), 'finance') THEN 'finance' WHEN contains(name, '手册') OR name LIKE '%.docx' OR name LIKE '%.md' OR name LIKE '%.txt' THEN 'policy' ELSE 'general' END AS kind FROM b)
SELECT o_orderkey, CASE WHEN given = 'contract' THEN given ELSE kind END AS doc_type, CASE WHEN kind IN ('salary', 'finance') THEN 'confidential' ELSE 'internal' END AS sensitivity_level,
  CASE kind WHEN 'salary' THEN 'self' WHEN 'finance' THEN 'finance_admin' ELSE 'employee' END AS owner_role, CASE WHEN kind = 'finance' THEN '财务部' ELSE '' END AS department FROM k""")
def business_metadata(spark, d):
    none = F.lit(None).cast("string")
    return _files(spark, d).select("o_orderkey", normalise.business_metadata(F.col("path"), F.col("given"), none, none, none).alias("m")).select("o_orderkey", "m.*")


@query(_FILES + r"""SELECT o_orderkey, coalesce(try_cast(regexp_extract(name, '(20\d{2})年(\d{1,2})月', 1) AS INTEGER), 0) AS year, coalesce(try_cast(regexp_extract(name, '(20\d{2})年(\d{1,2})月', 2) AS INTEGER), 0) AS month,
CASE WHEN contains(name, '销售') THEN '销售部' WHEN contains(name, '技术') THEN '研发部' WHEN contains(upper(name), 'HR') THEN '人力资源部' ELSE '' END AS department FROM b""")
def payroll_file(spark, d):
    name = normalise.base_name(F.col("path"))
    return _files(spark, d).select("o_orderkey", payroll.month_of_file(name).alias("m"), payroll.department_of(name, F.col("sheet")).alias("department")).select("o_orderkey", "m.*", "department")


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN '【2026年' || month(o_orderdate) || '月工资 - ' || o_clerk || '】' ELSE '【工资 - ' || o_clerk || '】' END || CASE WHEN o_orderkey % 3 = 0 THEN chr(10) || '部门：研发部' ELSE '' END
  || chr(10) || '姓名：' || o_clerk || chr(10) || '实发工资：' || CAST(o_custkey AS VARCHAR) || ' 元' || chr(10) || '出勤天数：' || CAST(o_shippriority AS VARCHAR) || ' 天' AS text FROM (SELECT *, 'C' || o_custkey AS o_clerk, o_custkey % 31 AS o_shippriority FROM orders)""")
def payroll_row_text(spark, d):
    clerk = F.concat(F.lit("C"), F.col("o_custkey").cast("string"))
    headers = F.array(*[F.lit(x) for x in ("姓名", "实发工资", "", "出勤天数", "备注")])
    values = F.array(clerk, F.col("o_custkey").cast("string"), F.lit("no header"), (F.col("o_custkey") % 31).cast("string"), F.lit("  "))
    even = F.col("o_orderkey") % 2 == 0
    text = payroll.row_text(headers, values, clerk, F.when(even, 2026).otherwise(0), F.when(even, F.month("o_orderdate")).otherwise(0), F.when(F.col("o_orderkey") % 3 == 0, "研发部"))
    return read(spark, d, "orders").select("o_orderkey", text.alias("text"))


_PAY = """
WITH r AS (SELECT o_orderkey AS key, month(o_orderdate) AS m, CASE WHEN o_orderkey % 40 <> 0 THEN 'n' || lpad(CAST(o_custkey AS VARCHAR), 7, '0') END AS name,
  CASE o_orderkey % 4 WHEN 0 THEN '合计 应发工资' WHEN 1 THEN '基本工资 社保' WHEN 2 THEN '个税 公积金' ELSE '备注' END AS text FROM orders),
q AS (SELECT c_custkey AS query_id, 'n' || lpad(CAST(c_custkey AS VARCHAR), 7, '0') AS identity, 1 + c_custkey % 12 AS month, CASE c_custkey % 6 WHEN 0 THEN '我' || (1 + c_custkey % 12) || '月的实发工资' WHEN 1 THEN 'n' || lpad(CAST(c_custkey AS VARCHAR), 7, '0') || ' 社保和公积金' WHEN 2 THEN '所有人' || (1 + c_custkey % 12) || '月工资总额' WHEN 3 THEN '本部门个税合计' WHEN 4 THEN '社保' ELSE '年假怎么请' END AS query FROM customer),
a AS (SELECT *, CASE WHEN c THEN month END AS asked FROM (SELECT *, contains(query, '月') AS c FROM q) WHERE contains(query, '工资') OR contains(query, '社保') OR contains(query, '公积金') OR contains(query, '个税')),
s AS (SELECT query_id, key, CASE WHEN asked IS NOT NULL THEN 20 ELSE 0 END
  + CASE WHEN name IS NOT NULL AND contains(query, name) THEN 100 WHEN name IS NOT NULL AND name = identity AND (contains(query, '我') OR contains(query, identity)) THEN 100
    WHEN name IS NULL AND (contains(text, '合计') OR contains(query, '总额')) AND (contains(query, '合计') OR contains(query, '总额') OR contains(query, '汇总') OR contains(query, '所有') OR contains(query, '全体') OR contains(query, '本部门')) THEN 50 WHEN name IS NOT NULL THEN 1 ELSE 0 END
  + 10 * list_sum(list_transform(['实发工资', '应发工资', '基本工资', '绩效工资', '岗位津贴', '社保', '公积金', '个税', '工资'], lambda f: CAST(contains(query, f) AND contains(text, f) AS INTEGER))) AS score FROM a JOIN r ON asked IS NULL OR asked = m),
k AS (SELECT query_id, key, CAST(score AS BIGINT) AS score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, key) AS INTEGER) AS rank FROM s WHERE score > 0)
SELECT query_id, key, rank, score FROM k WHERE rank <= 10
"""


@query(_PAY)
def structured_recall(spark, d):
    n = F.col("o_orderkey") % 4
    person = lambda c: F.concat(F.lit("n"), F.lpad(F.col(c).cast("string"), 7, "0"))
    text = F.when(n == 0, "合计 应发工资").when(n == 1, "基本工资 社保").when(n == 2, "个税 公积金").otherwise("备注")
    rows = read(spark, d, "orders").select(F.col("o_orderkey").alias("key"), F.month("o_orderdate").alias("month"), F.when(F.col("o_orderkey") % 40 != 0, person("o_custkey")).alias("name"), text.alias("text"))
    kind, month = F.col("c_custkey") % 6, (F.col("c_custkey") % 12 + 1).cast("string")
    q = (
        F.when(kind == 0, F.concat(F.lit("我"), month, F.lit("月的实发工资"))).when(kind == 1, F.concat(person("c_custkey"), F.lit(" 社保和公积金"))).when(kind == 2, F.concat(F.lit("所有人"), month, F.lit("月工资总额")))
        .when(kind == 3, "本部门个税合计").when(kind == 4, "社保").otherwise("年假怎么请")
    )
    asked = read(spark, d, "customer").select(F.col("c_custkey").alias("query_id"), q.alias("query"), person("c_custkey").alias("identity"))
    return payroll.structured(asked, rows, 10)


_QUESTIONS = "WITH q AS (SELECT conv_id, turn, trim(CASE turn % 5 WHEN 0 THEN '怎么' || text WHEN 1 THEN substr(text, 1, 7) WHEN 2 THEN 'STEPS ' || text WHEN 3 THEN text || '年假' ELSE text END) AS q FROM conversations)"


def _questions(spark, d):
    n = F.col("turn") % 5
    q = F.when(n == 0, F.concat(F.lit("怎么"), "text")).when(n == 1, F.substring("text", 1, 7)).when(n == 2, F.concat(F.lit("STEPS "), "text")).when(n == 3, F.concat("text", F.lit("年假"))).otherwise(F.col("text"))
    return read(spark, d, "conversations").select("conv_id", "turn", F.trim(q).alias("q"))


@query(_QUESTIONS + f" SELECT conv_id, turn, {' OR '.join(f'''contains(lower(q), '{w}')''' for w in normalise.PROCEDURAL)} AS procedural, q <> '' AND (length(q) <= 4 OR (length(q) <= 8 AND NOT regexp_matches(q, '[，。？！、；：,.?!]')) OR {' OR '.join(f'''contains(q, '{w}')''' for w in normalise.LEAVE_WORDS)}) AS rewrite FROM q")
def question_gates(spark, d):
    return _questions(spark, d).select("conv_id", "turn", normalise.is_procedural(F.col("q")).alias("procedural"), normalise.wants_rewrite(F.col("q")).alias("rewrite"))


@query(r"""SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'emp-' || user_id WHEN 1 THEN 'name-' || event_type WHEN 2 THEN 'doc-' || event_id || '-f' || user_id || '.xlsx' ELSE 'doc-' || event_id END AS key FROM events""")
def parent_keys(spark, d):
    n = F.col("event_id") % 4
    file = F.when(n != 3, F.concat(F.lit("data/f"), F.col("user_id").cast("string"), F.lit(".xlsx")))
    return read(spark, d, "events").select("event_id", normalise.parent_key(F.when(n == 0, F.col("user_id")), F.when(n <= 1, F.col("event_type")), file, F.col("event_id")).alias("key"))


@query(r"""WITH l AS (SELECT doc_id, unnest(string_split(CASE doc_id % 3 WHEN 0 THEN '| a | b |' || chr(10) || '|---|:--:|' || chr(10) || 'x | y | z | w' || chr(10) ELSE '' END || text, chr(10))) AS raw FROM documents), s AS (SELECT doc_id, trim(raw) AS s FROM l)
SELECT doc_id, CAST(count(*) FILTER (WHERE regexp_matches(s, '^\s*\|?\s*:?-{2,}:?\s*(\|\s*:?-{2,}:?\s*)+\|?\s*$') OR regexp_matches(s, '^\s*\|(.+)\|\s*$') OR length(s) - length(replace(s, '|', '')) >= 3) AS BIGINT) AS table_lines FROM s GROUP BY doc_id""")
def table_lines(spark, d):
    head = F.when(F.col("doc_id") % 3 == 0, F.lit("| a | b |\n|---|:--:|\nx | y | z | w\n")).otherwise("")
    lines = F.filter(F.split(F.concat(head, "text"), "\n"), normalise.is_table_line)
    return read(spark, d, "documents").select("doc_id", F.size(lines).cast("long").alias("table_lines"))


@query(r"""WITH t AS (SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN '----------' || chr(10) || '详见第三章。' || chr(10) ELSE '' END || text AS t FROM documents)
SELECT doc_id, sha256(array_to_string(list_filter(string_split(t, chr(10)), lambda x: NOT regexp_matches(x, '^\s*[-*_=#·•…\s]{8,}\s*$') AND x <> '详见第三章。'), chr(10))) AS text FROM t""")
def noise_lines(spark, d):
    head = F.when(F.col("doc_id") % 3 == 0, F.lit("----------\n详见第三章。\n")).otherwise("")
    return read(spark, d, "documents").select("doc_id", F.sha2(T.without_noise_lines(F.concat(head, "text")), 256).alias("text"))


@query(r"""SELECT event_id, CASE WHEN event_id % 20 < 14 THEN CASE WHEN event_id % 20 BETWEEN 1 AND 12 THEN CAST(event_id % 20 AS INTEGER) END END AS month,
least(50, 2 * (event_id % 40) + CAST(floor(50 * (event_id % 40) / 100.0) AS BIGINT)) + least(20, user_id) + least(20, 5 * (event_id % 7)) + greatest(0, 10 - 2 * (event_id % 9)) AS quality,
CASE WHEN event_id % 3 = 0 THEN NULL ELSE greatest(0.0, least(1.0, CAST(value AS DOUBLE) - 1)) END AS clamped FROM events""")
def row_scores(spark, d):
    n = F.col("event_id") % 20
    said = F.when(n < 14, F.concat(F.lit("今年"), n.cast("string"), F.lit("月的工资"))).otherwise("no month")
    quality = T.quality_score(F.col("event_id") % 40, F.lit(100), F.col("user_id"), F.col("event_id") % 7, F.col("event_id") % 9)
    score = F.when(F.col("event_id") % 3 == 0, "none").otherwise((F.col("value").cast("double") - 1).cast("string"))
    return read(spark, d, "events").select("event_id", T.month_of(said).alias("month"), quality.alias("quality"), T.clamped_score(score).alias("clamped"))


_ANSWERS = f"""WITH a AS (SELECT conv_id, turn, CASE turn % 4 WHEN 0 THEN '  ' || text || ' ' WHEN 1 THEN substr(text, 1, 3) WHEN 2 THEN text || '资料不足' ELSE '抱歉，您没有权限' || text END AS a, CASE turn % 3 WHEN 0 THEN 'salary' WHEN 1 THEN 'finance' ELSE 'general' END AS k FROM conversations),
n AS (SELECT *, trim(a) AS s, CASE k WHEN 'salary' THEN '{answer.HR_NOTE}' WHEN 'finance' THEN '{answer.FINANCE_NOTE}' END AS note FROM a)
SELECT conv_id, turn, CASE WHEN length(s) < 6 OR contains(s, '资料不足') THEN '{answer.INSUFFICIENT}' WHEN starts_with(s, '抱歉，您没有权限') THEN '{answer.NO_PERMISSION}' WHEN note IS NULL THEN s ELSE trim(rtrim(a) || chr(10) || chr(10) || note) END AS answer FROM n"""


@query(_ANSWERS)
def answer_notes(spark, d):
    n = F.col("turn") % 4
    a = F.when(n == 0, F.concat(F.lit("  "), "text", F.lit(" "))).when(n == 1, F.substring("text", 1, 3)).when(n == 2, F.concat("text", F.lit("资料不足"))).otherwise(F.concat(F.lit("抱歉，您没有权限"), "text"))
    kind = F.when(F.col("turn") % 3 == 0, "salary").when(F.col("turn") % 3 == 1, "finance").otherwise("general")
    return read(spark, d, "conversations").select("conv_id", "turn", answer.post_process(a, kind).alias("answer"))


_ROLES = ("admin", "hr_admin", "finance_admin", "manager", "employee")
_SCOPES = ("company", "department", "self")
_KINDS = ("salary", "finance", "policy", "general")


@query("""WITH u AS (SELECT r.role, s.scope FROM (VALUES ('admin'), ('hr_admin'), ('finance_admin'), ('manager'), ('employee')) r(role), (VALUES ('company'), ('department'), ('self')) s(scope)),
d AS (SELECT o_orderkey, CAST(o_custkey AS VARCHAR) AS owner, n_name AS dep, CASE o_orderkey % 4 WHEN 0 THEN 'salary' WHEN 1 THEN 'finance' WHEN 2 THEN 'policy' ELSE 'general' END AS kind,
  CASE o_orderkey % 7 WHEN 0 THEN 'restricted' WHEN 1 THEN 'internal' WHEN 2 THEN 'public' WHEN 3 THEN 'confidential' END AS given FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey),
e AS (SELECT *, coalesce(given, CASE WHEN kind IN ('salary', 'finance') THEN 'confidential' WHEN kind = 'policy' THEN 'internal' ELSE 'public' END) AS level FROM d),
x AS (SELECT *, scope = 'company' OR role IN ('admin', 'hr_admin', 'finance_admin') AS wide, level IN ('public', 'internal') OR (level = 'confidential' AND role <> 'employee') OR role = 'admin' AS seen FROM e, u),
z AS (SELECT *, CASE WHEN kind = 'salary' AND NOT (wide OR owner = '7') THEN 'owner' WHEN kind = 'salary' AND NOT wide THEN 'ok' WHEN NOT seen THEN 'sensitivity' WHEN NOT (scope = 'company' OR dep = (SELECT n_name FROM nation WHERE n_nationkey = 3)) THEN 'department' ELSE 'ok' END AS reason FROM x)
SELECT role, scope, kind, level, reason, count(*) AS n, min(o_orderkey) AS first FROM z GROUP BY ALL""")
def acl_grid(spark, d):
    """Decisions of five roles with three scopes over four kinds and levels of documents."""
    return access.decide(_grid(spark, d)).groupBy("role", "scope", F.col("doc_type").alias("kind"), "level", "reason").agg(F.count("*").alias("n"), F.min("o_orderkey").alias("first"))


def _grid(spark, d):
    nation = read(spark, d, "nation")
    docs = read(spark, d, "orders").join(read(spark, d, "customer"), F.col("c_custkey") == F.col("o_custkey")).join(F.broadcast(nation), F.col("n_nationkey") == F.col("c_nationkey"))
    pick = lambda names, n: F.element_at(F.array(*[F.lit(x) for x in names]), (n + 1).cast("int"))
    n7 = F.col("o_orderkey") % 7
    given = F.when(n7 == 0, "restricted").when(n7 == 1, "internal").when(n7 == 2, "public").when(n7 == 3, "confidential")
    docs = docs.select("o_orderkey", pick(_KINDS, F.col("o_orderkey") % 4).alias("doc_type"), given.alias("sensitivity_level"), F.col("o_custkey").cast("string").alias("owner_id"), F.lit("").alias("owner_name"), F.col("n_name").alias("doc_department"), F.lit("").alias("path"))
    readers = F.array(*[F.struct(F.lit(r).alias("role"), F.lit(s).alias("scope")) for r in _ROLES for s in _SCOPES])
    own = nation.where("n_nationkey = 3").select(F.col("n_name").alias("department"))  # one row
    rows = docs.withColumn("u", F.explode(readers)).select("*", "u.*").drop("u").join(F.broadcast(own)).select("*", F.lit("7").alias("user_id"), F.lit("").alias("user_name"), F.array("role").alias("roles"), F.col("scope").alias("data_scope"))
    return rows.withColumn("level", access.sensitivity_of(F.col("sensitivity_level"), F.col("doc_type")))


_BUILD = """
WITH d AS (SELECT 'd' || doc_id AS document_id, doc_id, sha256(text) AS h, length(text) AS n FROM documents),
r AS (SELECT document_id, CASE WHEN doc_id % 5 = 0 THEN 'old' ELSE h END AS version, CASE WHEN doc_id % 7 = 0 THEN 'failed' ELSE 'active' END AS status, 1 + doc_id % 3 AS chunk_count, doc_id FROM d WHERE doc_id % 3 <> 0),
c AS (SELECT document_id, version, document_id || '-' || i AS chunk_id FROM r, (SELECT unnest(range(3)) AS i) WHERE i <= doc_id % 3 AND status = 'active'),
p AS (SELECT document_id, h AS version, document_id || '-new-' || i AS chunk_id FROM d, (SELECT unnest(range(4)) AS i) WHERE doc_id % 2 = 0 AND i <= doc_id % 4),
f AS (SELECT document_id FROM d WHERE doc_id % 10 = 4), ok AS (SELECT DISTINCT document_id FROM p WHERE document_id NOT IN (FROM f))
"""


def _build_tables(spark, d):
    docs = read(spark, d, "documents").select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("document_id"), "doc_id", F.sha2("text", 256).alias("h"))
    registry = docs.where("doc_id % 3 <> 0").select("document_id", F.when(F.col("doc_id") % 5 == 0, "old").otherwise(F.col("h")).alias("version"), F.when(F.col("doc_id") % 7 == 0, "failed").otherwise("active").alias("status"), (F.col("doc_id") % 3 + 1).alias("chunk_count"), F.lit("then").alias("created_at"), F.lit("then").alias("updated_at"), "doc_id")
    parts = lambda df, n, mark: df.withColumn("i", F.explode(F.sequence(F.lit(0), n.cast("int")))).select("document_id", "version", F.concat_ws("-", "document_id", *([F.lit(mark)] if mark else []), F.col("i").cast("string")).alias("chunk_id"))
    chunks = parts(registry.where("status = 'active'"), F.col("doc_id") % 3, "")
    produced = parts(docs.where("doc_id % 2 = 0").withColumnRenamed("h", "version"), F.col("doc_id") % 4, "new")
    return registry.drop("doc_id"), chunks, produced, docs.where("doc_id % 10 = 4").select("document_id")


@query(_BUILD + "SELECT document_id, version, chunk_id FROM c WHERE document_id NOT IN (FROM ok) UNION ALL SELECT * FROM p WHERE document_id IN (FROM ok)")
def commit_chunks(spark, d):
    _, chunks, produced, failed = _build_tables(spark, d)
    return build.committed_chunks(chunks, produced, failed)


_COMMITTED = _BUILD + """, m AS (SELECT document_id, max(version) AS nv, count(*) AS n FROM p GROUP BY document_id),
g AS (SELECT coalesce(r.document_id, m.document_id, f.document_id) AS document_id, r.version, r.status, r.chunk_count, r.document_id IS NOT NULL AS known, nv, n, f.document_id IS NOT NULL AS bad FROM r FULL JOIN m ON r.document_id = m.document_id FULL JOIN f ON f.document_id = coalesce(r.document_id, m.document_id)),
k AS (SELECT *, nv IS NOT NULL AND NOT bad AS ok, bad AND coalesce(status, '') <> 'active' AS mark FROM g),
n AS (SELECT document_id, CASE WHEN ok OR mark THEN coalesce(nv, version) ELSE version END AS version, CASE WHEN ok THEN 'active' WHEN mark THEN 'failed' ELSE status END AS status, CAST(CASE WHEN ok THEN n WHEN mark THEN 0 ELSE chunk_count END AS BIGINT) AS chunk_count,
  CASE WHEN known THEN 'then' ELSE 'now' END AS created_at, CASE WHEN ok OR mark THEN 'now' ELSE 'then' END AS updated_at FROM k)
"""


@query(_COMMITTED + "SELECT * FROM n")
def commit_registry(spark, d):
    registry, _, produced, failed = _build_tables(spark, d)
    return build.committed_registry(registry, produced, failed, "now")


@query(_COMMITTED + ", after AS (SELECT document_id, version, chunk_id FROM c WHERE document_id NOT IN (FROM ok) UNION ALL SELECT * FROM p WHERE document_id IN (FROM ok)) SELECT a.* FROM after a JOIN n ON n.document_id = a.document_id AND n.version = a.version AND n.status = 'active'")
def visible_chunks(spark, d):
    registry, chunks, produced, failed = _build_tables(spark, d)
    return build.visible(build.committed_chunks(chunks, produced, failed), build.committed_registry(registry, produced, failed, "now"))


@query(_BUILD + "SELECT status, count(*) AS documents, CAST(sum(chunk_count) AS BIGINT) AS chunks FROM r GROUP BY status")
def rebuild_counts(spark, d):
    return build.rebuild(_build_tables(spark, d)[0])[1]


@query(_REGISTRY + """, a2 AS (SELECT d.doc_id, CASE WHEN r.path IS NOT NULL THEN 'skip' WHEN a.path <> d.path THEN 'duplicate' ELSE 'process' END AS action FROM d LEFT JOIN r ON r.path = d.path AND r.h = d.h AND r.status = 'active' LEFT JOIN a ON a.h = d.h)
SELECT CASE WHEN doc_id % 17 = 0 THEN 'failed' ELSE action END AS action, count(*) AS files FROM a2 GROUP BY 1""")
def load_report(spark, d):
    from granary.operators import registry

    disk, rows = _registry(spark, d)
    failed = disk.where(F.substring("path", 2, 20).cast("long") % 17 == 0).select("path")
    return build.build_report(registry.plan_build(disk, rows), failed)


@query(_METRICS + """, g2 AS (SELECT k.query_id, k.rank, e.label, e.vec_id % 3 AS page FROM k JOIN embeddings e ON e.vec_id = k.key WHERE rank <= 10),
w AS (SELECT vec_id AS query_id, label FROM embeddings WHERE vec_id % 20 = 0),
n AS (SELECT w.query_id, count(*) FILTER (WHERE g2.label = w.label) AS path_hits, count(*) FILTER (WHERE g2.label = w.label AND page = 1) AS page_hits FROM w LEFT JOIN g2 ON g2.query_id = w.query_id GROUP BY w.query_id)
SELECT query_id AS sample_id, CAST(least(2, path_hits) AS BIGINT) AS hits, CAST(2 AS BIGINT) AS expected, round(least(2, path_hits) / 2.0, 9)::DOUBLE AS recall FROM n""")
def claimed_recall(spark, d):
    e = read(spark, d, "embeddings")
    rows = _knn(spark, d).where("rank <= 10").join(e.select(F.col("vec_id").alias("key"), F.col("label").cast("string").alias("path"), (F.col("vec_id") % 3).alias("page")), "key").select(F.col("query_id").alias("sample_id"), "rank", "path", "page")
    asked = e.where("vec_id % 20 = 0")
    any_page = F.lit(None).cast("long")
    wanted = asked.select(F.col("vec_id").alias("sample_id"), F.posexplode(F.array(F.struct(F.col("label").cast("string").alias("path"), any_page.alias("page")), F.struct(F.col("label").cast("string").alias("path"), any_page.alias("page")))).alias("place", "x")).select("sample_id", "place", "x.*")
    return evaluation.claimed(rows, wanted)


@query("""WITH s AS (SELECT c_custkey AS sample_id, c_custkey % 3 <> 0 AS refusal, CASE c_custkey % 4 WHEN 0 THEN 'no_permission' WHEN 1 THEN 'cross_dept_salary' ELSE 'other' END AS kind, 'C' || c_custkey AS who, CASE WHEN c_custkey % 5 = 0 THEN 'company' ELSE 'self' END AS scope, CASE WHEN c_custkey % 7 = 0 THEN 'hr_admin' ELSE 'employee' END AS role FROM customer),
e AS (SELECT o_custkey AS sample_id, o_orderkey % 3 AS n, CASE WHEN o_orderkey % 2 = 0 THEN 'C' || o_custkey ELSE 'C0' END AS name FROM orders),
h AS (SELECT DISTINCT s.sample_id FROM s JOIN e USING (sample_id) WHERE refusal AND kind IN ('no_permission', 'cross_dept_salary') AND ((n = 0 AND name <> who AND scope <> 'company' AND role <> 'hr_admin') OR (n = 1 AND scope <> 'company')))
SELECT (SELECT count(*) FROM h) AS hits, count(*) AS at_risk, round((SELECT count(*) FROM h) / count(*), 6) AS rate FROM s WHERE refusal AND kind IN ('no_permission', 'cross_dept_salary')""")
def unauthorised_hits(spark, d):
    c, n = F.col("c_custkey"), F.col("c_custkey") % 4
    who = F.concat(F.lit("C"), c.cast("string"))
    samples = read(spark, d, "customer").select(c.alias("sample_id"), (c % 3 != 0).alias("expected_refusal"), F.when(n == 0, "no_permission").when(n == 1, "cross_dept_salary").otherwise("other").alias("refusal_type"), who.alias("user_name"), F.when(c % 5 == 0, "company").otherwise("self").alias("data_scope"), F.array(F.when(c % 7 == 0, "hr_admin").otherwise("employee")).alias("roles"), F.lit("").alias("department"))
    k = F.col("o_orderkey") % 3
    evidence = read(spark, d, "orders").select(F.col("o_custkey").alias("sample_id"), F.when(k == 0, "salary").when(k == 1, "finance_report").otherwise("policy").alias("doc_type"), F.when(F.col("o_orderkey") % 2 == 0, F.concat(F.lit("C"), F.col("o_custkey").cast("string"))).otherwise("C0").alias("employee_name"), F.lit("").alias("sensitivity"), F.lit("").alias("doc_department"))
    return evaluation.unauthorised(samples, evidence)


@query("""SELECT event_id, substr(md5('{"k": ' || user_id || ', "kind": "' || event_type || '", "on": ' || CASE WHEN event_id % 2 = 0 THEN 'true' ELSE 'false' END || '}'), 1, 12) AS hash FROM events""")
def params_hash(spark, d):
    params = {"k": F.col("user_id"), "kind": evaluation.json_text(F.col("event_type")), "on": F.col("event_id") % 2 == 0}
    return read(spark, d, "events").select("event_id", evaluation.params_hash(params).alias("hash"))


_KEPT = _RUNS + ", t AS (SELECT params_hash, max(run_at) AS last FROM r GROUP BY params_hash), h AS (SELECT params_hash FROM t ORDER BY last DESC, params_hash LIMIT 100)"


@query(_KEPT + " SELECT params_hash, run_id FROM r WHERE params_hash IN (FROM h)")
def experiment_hashes(spark, d):
    runs = read(spark, d, "events").select(F.col("user_id").alias("params_hash"), F.col("event_id").alias("run_id"), F.col("ts").alias("run_at"))
    return evaluation.latest_hashes(runs, 100).select("params_hash", "run_id")


@query(_RUNS + ", m AS (SELECT metric, count(DISTINCT params_hash) AS experiments FROM a GROUP BY metric) SELECT metric, experiments, CAST(row_number() OVER (ORDER BY experiments DESC, metric) AS INTEGER) AS place FROM m QUALIFY place <= 3")
def metric_ranking(spark, d):
    return evaluation.metric_ranking(metrics.aggregate_runs(_runs(spark, d)), 3)


@query(_RUNS + ", t AS (SELECT params_hash, max(run_at) AS last_run FROM l GROUP BY params_hash) SELECT params_hash, last_run, metric, avg, lag(avg) OVER (PARTITION BY metric ORDER BY last_run, params_hash) AS before FROM a JOIN t USING (params_hash)")
def metric_trend(spark, d):
    runs = _runs(spark, d)
    return evaluation.trend(runs, metrics.aggregate_runs(runs)).withColumn("last_run", F.col("last_run").cast("timestamp_ntz"))


@query("WITH r AS (SELECT user_id AS params_hash, event_id AS run_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events) SELECT params_hash, run_id FROM r WHERE n <= 10")
def last_ten_runs(spark, d):
    runs = read(spark, d, "events").select(F.col("user_id").alias("params_hash"), F.col("event_id").alias("run_id"), F.col("ts").alias("run_at"))
    return metrics.latest_runs(runs, 10).select("params_hash", "run_id")


@query(_METRICS + ", j AS (SELECT t.query_id, t.rank, t.label, t.label = x.label AS relevant FROM t JOIN x USING (query_id)) SELECT query_id AS sample_id, max(relevant) AS hit, string_agg(CAST(label AS VARCHAR), ',' ORDER BY rank) FILTER (WHERE rank <= 3) AS labels FROM j GROUP BY query_id")
def hit_attribution(spark, d):
    e = read(spark, d, "embeddings").select("vec_id", "label")
    rows = _knn(spark, d).where("rank <= 10").join(e.select(F.col("vec_id").alias("key"), "label"), "key").join(e.select(F.col("vec_id").alias("query_id"), F.col("label").alias("own")), "query_id")
    return evaluation.attribution(rows.select(F.col("query_id").alias("sample_id"), "rank", "label", (F.col("label") == F.col("own")).alias("relevant")))


@query("SELECT event_id, CASE WHEN user_id % 5 = 0 THEN NULL WHEN event_id % 4 = 0 THEN 'company' WHEN event_id % 4 = 1 THEN 'department' ELSE 'self' END AS scope FROM events")
def sample_scope(spark, d):
    n = F.col("event_id") % 4
    given = F.when(n == 0, "company").when(n == 1, "department").when(n == 2, "everything")
    return read(spark, d, "events").select("event_id", evaluation.scope_of(F.when(F.col("user_id") % 5 != 0, F.col("user_id").cast("string")), given).alias("scope"))


_MONTH_FILES = "list_transform({0}, lambda m: 'pay/' || m || '.xlsx')"
_MONTHLY = evaluation.MonthlyFiles("pay/{}.xlsx", r"员工工资表_2026年(\d{1,2})月", r"2026年(\d{1,2})月", "工资", "员工工资表", {"Q1": (1, 2, 3), "Q2": (4, 5, 6)}, (1, 2, 3, 4, 5, 6))
_NAMED = {"finance.pdf": ("财务报表", "利润表", "营业收入", "净利润"), "handbook.docx": ("知识库",)}


@query(f"""WITH s AS (SELECT event_id, event_id % 6 AS n, 1 + event_id % 12 AS m FROM events)
SELECT event_id, array_to_string(CASE n WHEN 0 THEN {_MONTH_FILES.format('[m]')} WHEN 1 THEN {_MONTH_FILES.format('[1, 2, 3]')} WHEN 2 THEN {_MONTH_FILES.format('[1, 2, 3, 4, 5, 6]')} WHEN 3 THEN ['finance.pdf', 'handbook.docx']
  WHEN 4 THEN {_MONTH_FILES.format('[m]')} || ['finance.pdf'] ELSE ['given.md'] END, '|') AS sources FROM s""")
def inferred_sources(spark, d):
    n, m = F.col("event_id") % 6, (F.col("event_id") % 12 + 1).cast("string")
    question = F.when(n == 0, F.concat(F.lit("2026年"), m, F.lit("月工资"))).when(n == 1, "q1 pay").when(n == 2, "员工工资表").when(n == 3, "净利润").when(n == 4, F.concat(F.lit("营业收入 员工工资表_2026年"), m, F.lit("月"))).otherwise("?")
    hints = F.when(n == 3, F.array(F.lit("内部知识库"))).otherwise(F.array().cast("array<string>"))
    samples = read(spark, d, "events").select("event_id", question.alias("question"), hints.alias("hints"), F.when(n == 5, F.array(F.lit("given.md"))).alias("expected_sources"), F.lit(False).alias("expected_refusal"))
    return evaluation.with_sources(samples, _MONTHLY, _NAMED).select("event_id", F.array_join("expected_sources", "|").alias("sources"))


@query(_BM25 + "SELECT query_id, key, rank, score FROM b WHERE rank <= 40")
def bm25_index_topk(spark, d):
    """The stored index after three builds: shortened texts, others beside them, then the whole texts in their place."""
    chunks = read(spark, d, "documents").select(F.col("doc_id").alias("key"), "text")
    stored = index.Bm25Index(spark, f"{shared_folder(spark)}/bm25-{uuid.uuid4().hex}")
    part = F.pmod(F.xxhash64("key"), F.lit(3))  # who comes with which build; all have come by the third
    stored.build(chunks.where(part < 2).withColumn("text", F.concat(F.lit("former words "), F.substring("text", 1, 200))))
    stored.build(chunks.where(part == 2), removed=chunks.where(part == 0).select("key"))
    stored.build(chunks.where(part < 2))
    return stored.search(questions(spark, d), 40)
