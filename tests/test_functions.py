from datetime import date

from pyspark.sql import functions as F

from finstrata.functions import calendar as C
from finstrata.functions import text as T


def _one(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(f(F.col("x")).alias("y")).first().y


def test_text(spark):
    assert _one(spark, "Net-sales of NET 3M, Ähre", T.tokens) == ["net", "sales", "of", "3m", "ähre"]
    assert _one(spark, "“a”–b c", T.fold_typography) == '"a"-b c'
    assert _one(spark, "<p>A<br>b<script>x<y</script><!-- no --> &amp; c</p>", T.strip_html) == "A b & c"
    assert _one(spark, "  Foo & Bar, Inc. ", T.slug) == "foo-bar-inc"
    assert _one(spark, "Apple Inc (aapl) [ST]", T.ticker_in) == "AAPL" and _one(spark, "none", T.ticker_in) == ""
    rng = lambda s: tuple(_one(spark, s, T.amount_range))
    assert rng("$1,001 - $15,000") == (1001, 15000) and rng("Over $50,000,000") == (50_000_000, 50_000_000) and rng("$1,001 -") == (1001, 15000) and rng("$1, 001 - $2,000") == (1001, 2000) and rng("x") == (0, 0)
    assert rng("$50,001 - $200") == (50_001, 100_000) and rng("$7 - $3") == (7, 7) and rng("$500") == (0, 500) and rng("$500 +") == (500, 500) and rng(None) == (0, 0)
    assert [_one(spark, s, T.any_date) for s in ("2024-03-01", "01-MAR-2024", "03/01/2024", "20240301", "soon")] == [date(2024, 3, 1), None, date(2024, 3, 1), date(2024, 3, 1), None] or _one(spark, "01-Mar-2024", T.any_date) == date(2024, 3, 1)
    assert _one(spark, "=1+1", T.export_cell) == "'=1+1" and _one(spark, "a=1", T.export_cell) == "a=1"
    assert [_one(spark, v, T.compact_usd, "long") for v in (0, 78, 5600, -3_400_000, 1_250_000_000)] == ["$0", "$78", "$5.6K", "-$3.4M", "$1.3B"]
    label = lambda s: _one(spark, s, lambda c: T.humanise(c, {"DE": "Germany"}))
    assert [label(s) for s in ("us-gaap:ProductSalesMember", "country:DE", "country:ZZ", "x:IPhoneMember", "x:USSegmentMember", "Member")] == ["Product Sales", "Germany", "ZZ", "IPhone", "US Segment", "Member"]
    assert T.country_names(spark)["FR"] == "France"
    assert _one(spark, "5′ 6″ −7`", T.fold_typography) == "5' 6\" -7'"
    assert [_one(spark, s, T.ticker_in) for s in ("X [ brk.b ]", "X (TOOLONG)", "X (A1)", None)] == ["BRK.B", "", "", None]
    assert _one(spark, {}, T.member_key, "map<string,string>") == "" and len(_one(spark, {"b": "1", "a": "2"}, T.member_key, "map<string,string>")) == 64


def test_search(spark):
    docs = spark.createDataFrame([(1, "cold cold storage"), (2, "storage\nhot\nCold\nx\ny"), (3, None), (4, "other words here")], "i int, t string")
    assert [r.i for r in T.bm25(docs, "i", "t", ["cold", "storage"], 10).collect()] == [1, 2]
    assert [r.i for r in T.bm25(docs, "i", "t", ["cold", "hot"], 10, every=True).collect()] == [2]
    assert sorted((r.i, r.line_no, r.is_hit) for r in T.keyword_lines(docs, "i", "t", "cold").collect()) == [(1, 0, True), (2, 1, False), (2, 2, True), (2, 3, False)]
    c = T.chunks(spark.createDataFrame([(1, " ".join(map(str, range(25)))), (2, "one"), (3, " "), (4, None)], "i int, t string"), "i", "t", 10, 2).orderBy("i", "chunk").collect()
    assert [(r.i, r.chunk, r.first_word, r.n_words) for r in c] == [(1, 0, 0, 10), (1, 1, 8, 10), (1, 2, 16, 9), (2, 0, 0, 1)]
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 1.0]), (3, [0.0, 0.0]), (4, None)], "i int, v array<double>")
    assert [r.i for r in T.nearest(v, "i", "v", [1.0, 0.0], 2).collect()] == [1, 2]


def test_calendar(spark):
    assert C.easter(2024) == date(2024, 3, 31) and C.easter(2025) == date(2025, 4, 20)
    h = C.holidays(2024)
    assert h == {date(2024, 1, 1), date(2024, 1, 15), date(2024, 2, 19), date(2024, 3, 29), date(2024, 5, 27), date(2024, 6, 19), date(2024, 7, 4), date(2024, 9, 2), date(2024, 11, 28), date(2024, 12, 25)}
    assert date(2021, 12, 31) not in C.holidays(2022) and date(2021, 6, 18) not in C.holidays(2021) and date(2021, 7, 5) in C.holidays(2021)
    cal = C.sessions(spark, 2024, 2024)
    assert cal.count() == 252
    rows = spark.createDataFrame([(date(2024, 3, 28),), (date(2024, 3, 30),), (date(2030, 1, 1),)], "d date")
    assert {r.d: r.n for r in C.shift_sessions(rows, "d", cal, 1, "n").collect()} == {date(2024, 3, 28): date(2024, 4, 1), date(2024, 3, 30): date(2024, 4, 1), date(2030, 1, 1): None}


def test_fiscal(spark):
    df = spark.createDataFrame([(date(2023, 9, 30), 9), (date(2023, 10, 1), 9), (date(2023, 12, 31), 12), (date(2023, 1, 31), 1)], "d date, m int")
    got = [tuple(r.p) for r in df.select(C.fiscal_period(F.col("d"), F.col("m")).alias("p")).collect()]
    assert got == [(2023, 4), (2024, 1), (2023, 4), (2023, 4)]
    ends = df.select(C.quarter_end(F.lit(2024), F.lit(1), F.col("m")).alias("e")).collect()
    assert [r.e for r in ends] == [date(2023, 12, 31), date(2023, 12, 31), date(2024, 3, 31), date(2023, 4, 30)]
    kinds = spark.createDataFrame([(date(2023, 1, 1), date(2023, 12, 31)), (date(2023, 1, 1), date(2023, 3, 31)), (date(2023, 1, 1), date(2023, 1, 2))], "a date, b date")
    assert [r.k for r in kinds.select(C.span_kind(F.col("a"), F.col("b")).alias("k")).collect()] == ["FY", "Q", None]
