"""Queries over documents, vectors, scalar functions and calendars."""

from __future__ import annotations

import uuid
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from finstrata.core.tables import checkpoint_dir, table
from finstrata.functions import calendar as C
from finstrata.functions import text as T
from finstrata.operators import relational as R
from finstrata.plans.views import day

QUERIES, ORACLES = {}, {}
WORDS = ["revenue", "storage", "million"]


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return keep


_TOK = "list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\\p{L}\\p{Nd}]+'), lambda x: length(x) > 0)"


@query(f"SELECT doc_id, len(list_distinct(t)) AS n_tokens, t[1] AS first_token FROM (SELECT doc_id, {_TOK} AS t FROM documents)")
def fn_tokenise(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", T.tokens(F.coalesce("text", F.lit(""))).alias("t")).select("doc_id", F.size("t").cast("bigint").alias("n_tokens"), F.get("t", 0).alias("first_token"))


def _bm25_sql(every: bool) -> str:
    tf = ", ".join(f"len(list_filter(t, lambda x: x = '{w}')) AS tf{i}" for i, w in enumerate(WORDS))
    df = ", ".join(f"count(*) FILTER (WHERE tf{i} > 0) AS df{i}" for i in range(3))
    part = " + ".join(f"CASE WHEN tf{i} > 0 THEN ln(1 + (docs - df{i} + 0.5) / (df{i} + 0.5)) * tf{i} * 2.2 / (tf{i} + 1.2 * (0.25 + 0.75 * n / a)) ELSE 0 END" for i in range(3))
    keep = (" AND " if every else " OR ").join(f"tf{i} > 0" for i in range(3))
    return f"""WITH t AS (SELECT doc_id, {_TOK} AS t FROM documents), c AS (SELECT doc_id, len(t) AS n, {tf} FROM t), s AS (SELECT count(*) AS docs, avg(n) AS a, {df} FROM c)
SELECT doc_id, round({part}, 6) AS score FROM c, s WHERE {keep} ORDER BY score DESC, doc_id LIMIT 50"""


def text_index(spark: SparkSession, d: str) -> str:
    """The inverted index of a directory's documents, written once a session in the shared folder."""
    known = spark.sparkContext.__dict__.setdefault("_finstrata_indexes", {})
    if d not in known:
        path = f"{checkpoint_dir(spark).rstrip('/')}/index-{uuid.uuid4().hex}"
        T.build_index(table(spark, d, "documents"), "doc_id", "text", path)
        known[d] = path
    return known[d]


@query(_bm25_sql(True))
def top_bm25_all_words(spark, d):
    return T.search_index(spark, text_index(spark, d), "doc_id", WORDS, 50, every=True)


@query(_bm25_sql(False))
def top_bm25_any_word(spark, d):
    return T.search_index(spark, text_index(spark, d), "doc_id", WORDS, 50)


@query(_bm25_sql(False))
def top_bm25_scan(spark, d):
    """The same without an index: texts are read and split for this one search."""
    return T.bm25(table(spark, d, "documents"), "doc_id", "text", WORDS, 50)


_COS = "CASE WHEN sqrt(list_dot_product(e.v, e.v)) * sqrt(list_dot_product(q.v, q.v)) > 0 THEN list_dot_product(e.v, q.v) / (sqrt(list_dot_product(e.v, e.v)) * sqrt(list_dot_product(q.v, q.v))) ELSE 0 END"
_VEC = "(SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings)"


def _query_vector(spark, d, vec_id=7):
    row = table(spark, d, "embeddings").filter(F.col("vec_id") == vec_id).select("embedding").first()
    return [float(x) for x in row[0]]


@query(f"SELECT e.vec_id, round({_COS}, 6) AS similarity FROM {_VEC} e, (SELECT v FROM {_VEC} WHERE vec_id = 7) q ORDER BY similarity DESC, e.vec_id LIMIT 20")
def top_nearest_vectors(spark, d):
    return T.nearest(table(spark, d, "embeddings"), "vec_id", "embedding", _query_vector(spark, d), 20)


@query(f"SELECT * FROM (SELECT e.vec_id, round({_COS}, 6) AS similarity FROM {_VEC} e, (SELECT v FROM {_VEC} WHERE vec_id = 7) q) WHERE similarity >= 0.3 ORDER BY similarity DESC, vec_id LIMIT 500")
def top_nearest_threshold(spark, d):
    return T.nearest(table(spark, d, "embeddings"), "vec_id", "embedding", _query_vector(spark, d), 500, 0.3)


@query(f"""WITH a AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS r FROM ({_bm25_sql(False)})), v AS (SELECT e.vec_id AS doc_id, round({_COS}, 6) AS s FROM {_VEC} e, (SELECT v FROM {_VEC} WHERE vec_id = 7) q ORDER BY s DESC, e.vec_id LIMIT 50),
b AS (SELECT doc_id, row_number() OVER (ORDER BY s DESC, doc_id) AS r FROM v) SELECT coalesce(a.doc_id, b.doc_id) AS doc_id, round(coalesce(1.0 / (60 + a.r), 0) + coalesce(1.0 / (60 + b.r), 0), 8) AS fused FROM a FULL JOIN b ON a.doc_id = b.doc_id""")
def set_rank_fusion(spark, d):
    """Keyword and vector ranks fused; the test vectors' ids stand for documents."""
    words = T.bm25(table(spark, d, "documents"), "doc_id", "text", WORDS, 50)
    near = T.nearest(table(spark, d, "embeddings"), "vec_id", "embedding", _query_vector(spark, d), 50).withColumnRenamed("vec_id", "doc_id")
    return T.fuse_ranks(words, near, "doc_id", "score", "similarity")


@query(r"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line_no FROM documents WHERE text IS NOT NULL),
h AS (SELECT *, contains(lower(translate(line, chr(160), ' ')), 'cold storage') AS is_hit FROM l)
SELECT doc_id, CAST(line_no AS INT) AS line_no, length(line) AS n_chars, is_hit FROM (SELECT *, max(CAST(is_hit AS INT)) OVER (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS near FROM h) WHERE near = 1""")
def fn_keyword_lines(spark, d):
    found = T.keyword_lines(table(spark, d, "documents"), "doc_id", "text", "cold storage")
    return found.select("doc_id", "line_no", F.length("line").cast("bigint").alias("n_chars"), "is_hit")


@query("SELECT doc_id, array_to_string(string_split(text, chr(10))[1:2], chr(10)) AS head FROM documents WHERE text IS NOT NULL")
def fn_line_range(spark, d):
    return table(spark, d, "documents").filter(F.col("text").isNotNull()).select("doc_id", T.line_range(F.col("text"), 1, 2).alias("head"))


@query(r"""WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(text, '\s+'), lambda x: length(x) > 0) AS w FROM documents WHERE text IS NOT NULL), c AS (SELECT doc_id, w, unnest(range(CAST(greatest(ceil((len(w) - 16) / 112.0), 1) AS BIGINT))) AS chunk FROM w WHERE len(w) > 0)
SELECT doc_id, CAST(chunk AS INT) AS chunk, CAST(chunk * 112 AS INT) AS first_word, CAST(len(w[chunk * 112 + 1 : chunk * 112 + 128]) AS INT) AS n_words, length(array_to_string(w[chunk * 112 + 1 : chunk * 112 + 128], ' ')) AS n_chars FROM c""")
def fn_chunks(spark, d):
    """Windows of 128 words with 16 in common, over whole texts."""
    docs = table(spark, d, "documents").filter(F.col("text").isNotNull())
    return T.chunks(docs, "doc_id", "text", 128, 16).select("doc_id", "chunk", "first_word", "n_words", F.length("content").cast("bigint").alias("n_chars"))


@query("SELECT source, coalesce(lang, '') AS lang, count(*) AS n, CAST(sum(n_chars) AS BIGINT) AS chars, strftime(max(reporting_date), '%Y-%m-%d') AS latest FROM documents GROUP BY 1, 2")
def agg_documents(spark, d):
    docs = table(spark, d, "documents")
    return docs.groupBy("source", F.coalesce("lang", F.lit("")).alias("lang")).agg(F.count("*").alias("n"), F.sum("n_chars").alias("chars"), day(F.max("reporting_date")).alias("latest"))


@query("""SELECT common_stock_id, regexp_replace(regexp_replace(lower(name), '[^a-z0-9]+', '-', 'g'), '^-|-$', '', 'g') AS slug, ltrim(trim(cik), '0') AS bare_cik, lpad(ltrim(trim(cik), '0'), 10, '0') AS padded_cik FROM common_stock""")
def fn_slug_and_cik(spark, d):
    c = T.cik_spellings(F.col("cik"))
    return table(spark, d, "common_stock").select("common_stock_id", T.slug(F.col("name")).alias("slug"), c["bare"].alias("bare_cik"), c["padded"].alias("padded_cik"))


@query("""WITH v(name, label) AS (VALUES ('country:DE', 'Germany'), ('country:ZZZ', 'ZZZ'), ('x:IPhoneMember', 'IPhone'), ('x:USSegmentMember', 'US Segment'), ('Member', 'Member')),
r AS (SELECT DISTINCT revenue_row_id, axis, member FROM dimensional_revenue_row), s AS (SELECT revenue_row_id, regexp_replace(regexp_replace(axis, '^.*:', ''), '(Member|Domain|Axis)$', '') AS a, regexp_replace(regexp_replace(member, '^.*:', ''), '(Member|Domain|Axis)$', '') AS m FROM r)
SELECT revenue_row_id, trim(regexp_replace(a, '([a-z0-9])([A-Z])', '\\1 \\2', 'g')) AS axis_label, trim(regexp_replace(m, '([a-z0-9])([A-Z])', '\\1 \\2', 'g')) AS member_label FROM s
UNION ALL SELECT -row_number() OVER (ORDER BY name), name, label FROM v""")
def fn_humanise(spark, d):
    """Labels of all axes and members; country codes and runs of capitals in rows of their own."""
    rows = table(spark, d, "dimensional_revenue_row").select("revenue_row_id", T.humanise(F.col("axis")).alias("axis_label"), T.humanise(F.col("member")).alias("member_label")).distinct()
    named = spark.createDataFrame([(-1, "Member"), (-2, "country:DE"), (-3, "country:ZZZ"), (-4, "x:IPhoneMember"), (-5, "x:USSegmentMember")], "revenue_row_id bigint, axis_label string")
    return rows.unionByName(named.withColumn("member_label", T.humanise(F.col("axis_label"), T.country_names(spark))))


@query("""SELECT t.revenue_row_id, CAST(year(period_end) + CASE WHEN month(period_end) > m THEN 1 ELSE 0 END AS INT) AS fiscal_year, CAST(((month(period_end) - m - 1) % 12 + 12) % 12 // 3 + 1 AS INT) AS fiscal_quarter,
CASE WHEN n BETWEEN 350 AND 380 THEN 'FY' WHEN n BETWEEN 80 AND 100 THEN 'Q' WHEN n BETWEEN 170 AND 190 THEN 'H1' WHEN n BETWEEN 260 AND 280 THEN '9M' END AS span_kind
FROM (SELECT DISTINCT revenue_row_id, common_stock_id, period_end, date_diff('day', period_start, period_end) AS n FROM dimensional_revenue_row) t JOIN (SELECT common_stock_id, fiscal_year_end_month AS m FROM common_stock WHERE fiscal_year_end_month IS NOT NULL) USING (common_stock_id)""")
def fn_fiscal_period(spark, d):
    rows = table(spark, d, "dimensional_revenue_row").select("revenue_row_id", "common_stock_id", "period_start", "period_end").distinct()
    stocks = table(spark, d, "common_stock").select("common_stock_id", "fiscal_year_end_month").filter(F.col("fiscal_year_end_month").isNotNull())
    p = C.fiscal_period(F.col("period_end"), F.col("fiscal_year_end_month"))
    return rows.join(stocks, "common_stock_id").select(
        "revenue_row_id", p["fiscal_year"].alias("fiscal_year"), p["fiscal_quarter"].alias("fiscal_quarter"), C.span_kind(F.col("period_start"), F.col("period_end")).alias("span_kind")
    )


def _sessions_sql(first: int, last: int) -> str:
    closed = ", ".join(f"DATE '{x}'" for y in range(first, last + 1) for x in sorted(C.holidays(y)))
    return f"(SELECT session, row_number() OVER (ORDER BY session) AS ordinal FROM (SELECT unnest(generate_series(DATE '{first}-01-01', DATE '{last}-12-31', INTERVAL 1 DAY))::DATE AS session) WHERE dayofweek(session) BETWEEN 1 AND 5 AND session NOT IN ({closed}))"


_SESS = _sessions_sql(2018, 2025)
_SESS_WIDE = _sessions_sql(1990, 2050)


@query(f"SELECT strftime(session, '%Y-%m-%d') AS session, ordinal FROM {_SESS}")
def fn_sessions(spark, d):
    return C.sessions(spark, 2018, 2025).select(day("session").alias("session"), F.col("ordinal").cast("bigint").alias("ordinal"))


@query(f"""WITH s AS {_SESS_WIDE}, t AS (SELECT DISTINCT transaction_id, transaction_date FROM insider_transaction WHERE transaction_date IS NOT NULL)
SELECT t.transaction_id, strftime(n.session, '%Y-%m-%d') AS settles FROM t ASOF LEFT JOIN s ON t.transaction_date >= s.session LEFT JOIN s n ON n.ordinal = s.ordinal + 2""")
def fn_add_sessions(spark, d):
    """Two trading days after each transaction."""
    rows = table(spark, d, "insider_transaction").select("transaction_id", "transaction_date").distinct().filter(F.col("transaction_date").isNotNull())
    return C.shift_sessions(rows, "transaction_date", C.sessions_of(rows, "transaction_date"), 2, "s").select("transaction_id", day("s").alias("settles"))


@query("""SELECT holding_id, CASE WHEN x >= 1e12 THEN '$' || printf('%.1f', round(x / 1e12, 1)) || 'T' WHEN x >= 1e9 THEN '$' || printf('%.1f', round(x / 1e9, 1)) || 'B' WHEN x >= 1e6 THEN '$' || printf('%.1f', round(x / 1e6, 1)) || 'M'
WHEN x >= 1e3 THEN '$' || printf('%.1f', round(x / 1e3, 1)) || 'K' ELSE '$' || printf('%.0f', round(x)) END AS label FROM (SELECT DISTINCT holding_id, CAST(value AS DOUBLE) AS x FROM institutional_holding)""")
def fn_compact_usd(spark, d):
    rows = table(spark, d, "institutional_holding").select("holding_id", "value").distinct()
    return rows.select("holding_id", T.compact_usd(F.col("value")).alias("label"))


@query("""SELECT fact_id, common_stock_id FROM (SELECT *, row_number() OVER (PARTITION BY common_stock_id, as_of ORDER BY CASE WHEN form LIKE '%/A' THEN 1 ELSE 0 END, CASE WHEN form LIKE '10-K%' THEN 0 WHEN form LIKE '10-Q%' THEN 1 ELSE 2 END, filed NULLS LAST, accession_number NULLS LAST, fact_id) AS rn FROM shares_fact WHERE as_of IS NOT NULL) WHERE rn = 1""")
def fn_pick_original_fact(spark, d):
    """Of the facts of one date, the one as first reported: originals before amendments, then form, then filed."""
    rows = table(spark, d, "shares_fact").filter(F.col("as_of").isNotNull())
    form = F.when(F.col("form").startswith("10-K"), 0).when(F.col("form").startswith("10-Q"), 1).otherwise(2)
    order = [F.when(F.col("form").endswith("/A"), 1).otherwise(0), form, F.asc_nulls_last("filed"), F.asc_nulls_last("accession_number"), F.col("fact_id")]
    return R.nth_latest(rows, ["common_stock_id", "as_of"], order).select("fact_id", "common_stock_id")


@query("""SELECT common_stock_id, strftime(as_of, '%Y-%m-%d') AS as_of, shares, n_facts, restated FROM (SELECT common_stock_id, as_of, arg_max(shares, (coalesce(filed, DATE '1900-01-01'), -fact_id)) AS shares, count(*) AS n_facts, count(DISTINCT shares) > 1 AS restated FROM shares_fact WHERE as_of IS NOT NULL GROUP BY 1, 2)""")
def fn_collapse_natural_key(spark, d):
    """One row a natural key, the latest filed, with whether it was restated."""
    rows = table(spark, d, "shares_fact").filter(F.col("as_of").isNotNull())
    latest = F.struct(F.coalesce("filed", F.lit(date(1900, 1, 1))), -F.col("fact_id"))
    return rows.groupBy("common_stock_id", "as_of").agg(F.max_by("shares", latest).alias("shares"), F.count("*").alias("n_facts"), (F.count_distinct("shares") > 1).alias("restated")).select(
        "common_stock_id", day("as_of").alias("as_of"), "shares", "n_facts", "restated"
    )


@query("""SELECT member, axis, count(DISTINCT revenue_row_id) AS n, count(DISTINCT common_stock_id) AS stocks FROM dimensional_revenue_row GROUP BY GROUPING SETS ((member, axis), (axis))""")
def agg_rollup_members(spark, d):
    rows = table(spark, d, "dimensional_revenue_row")
    fine = rows.groupBy("member", "axis").agg(F.count_distinct("revenue_row_id").alias("n"), F.count_distinct("common_stock_id").alias("stocks"))
    coarse = rows.groupBy("axis").agg(F.count_distinct("revenue_row_id").alias("n"), F.count_distinct("common_stock_id").alias("stocks")).withColumn("member", F.lit(None).cast("string"))
    return fine.unionByName(coarse)
