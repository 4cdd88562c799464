from datetime import date

from pyspark.sql import functions as F

from finstrata.functions import calendar as C
from finstrata.functions import documents as D
from finstrata.operators import facts as X
from finstrata.operators import series as S
from finstrata.sources import markup as M
from finstrata.streaming import incremental as I


def test_windows_end_with_sentences(spark):
    text = "One two three. Four five six seven.\nEight nine ten eleven twelve. Thirteen"
    got = D.token_windows(spark.createDataFrame([(1, text), (2, ""), (3, None), (4, " \n "), (5, "a b c d e f")], "i int, t string"), "i", "t", 8, 3).orderBy("i", "chunk").collect()
    one = [r for r in got if r.i == 1]
    assert one[0].content == "One two three. Four five six seven." and one[0].start_line == 1 and one[0].n_tokens == 7
    assert one[1].content.startswith("five six seven.") and one[1].start_line == 1
    assert all(text[r.start_char : r.end_char] == r.content and r.n_tokens <= 8 for r in one)
    assert one[-1].end_char == len(text)
    assert [r.content for r in got if r.i == 5] == ["a b c d e f"] and {r.i for r in got} == {1, 5}


def test_long_text_without_sentences_moves_on():
    spans = D.word_spans("x " * 5000)
    got = list(D.windows("x " * 5000, spans, 100, 99))
    assert got[-1][1] == spans[-1][1] and len(got) < 5000


def test_markdown(spark):
    html = """<html><head><title>t</title></head><body><ix:header>hidden</ix:header><h2>Item 1</h2><p>Some <b>bold</b>&nbsp;text</p><div style="display: none">no</div>
    <ul><li>a</li><li>b<ol><li>c</li></ol></li></ul><table><tr><td>Sales</td><td>$</td><td>(5</td><td>)</td><td></td></tr><tr><td>Margin</td><td>4</td><td>%</td></tr></table><p>12</p><p>Table of Contents</p><table><tr><td>only text</td></tr></table></body></html>"""
    out = D.to_markdown(html)
    assert out.splitlines()[0] == "## Item 1" and "Some bold text" in out and "hidden" not in out and "\nno" not in out
    assert "- a\n- b\n  1. c" in out and "| Sales | $(5) |\n| --- | --- |\n| Margin | 4% |" in out
    assert "12" not in out and "Contents" not in out and out.endswith("only text")
    rows = D.markdown(spark.createDataFrame([(1, html), (2, None), (3, "<p>un<closed")], "i int, h string"), "i", "h").orderBy("i").collect()
    assert rows[0].markdown == out and rows[1].markdown is None and rows[2].markdown.startswith("un")


def test_columns(spark):
    df = spark.createDataFrame([("Sale (Partial) of purchase", "Doe, Jane Q."), ("bought", "Hon. John A. Smith, Jr."), (None, None)], "a string, n string")
    got = df.select(D.classify(F.col("a"), [("sale", "sale"), ("purchase", "purchase|bought")], "other").alias("k"), D.person_name(F.col("n")).alias("p")).collect()
    assert [tuple(r) for r in got] == [("sale", "Doe, Jane Q."), ("purchase", "John A. Smith, Jr."), ("other", None)]
    names = spark.createDataFrame([("Scott Mr Franklin",), ("Scott  scott Franklin",), ("C. C. Franklin",), ("Mark Dr. Green",), ("Mraz",), ("",)], "n string")
    assert [r.n for r in names.select(D.person_name(F.col("n")).alias("n")).collect()] == ["Scott Franklin", "Scott Franklin", "C. C. Franklin", "Mark Green", "Mraz", ""]
    ch = spark.createDataFrame([(1, 20, "b", 2), (1, 10, "a", 5), (2, 1, "z", 1)], "d int, s int, c string, r int")
    assert {r.d: (r.best_rank, r.context) for r in D.excerpts(ch, "d", "s", "c", "r").collect()} == {1: (2, "a\n...\nb"), 2: (1, "z")}


def test_settlements(spark):
    got = {r.settlement: (r.due, r.published) for r in C.settlement_cycle(C.sessions(spark, 2024, 2024)).collect()}
    assert got[date(2024, 3, 15)] == (date(2024, 3, 19), date(2024, 3, 28)) and date(2024, 3, 28) in got


def test_series_and_facts(spark):
    b = spark.createDataFrame([(1, date(2023, 1, 1), 100001), (1, date(2023, 8, 1), 100001), (2, date(2023, 1, 1), 7)], "k long, d date, p long")
    s = spark.createDataFrame([(1, date(2023, 6, 15), 2, 1), (1, date(2024, 1, 1), 3, 1)], "k long, effective_date date, numerator int, denominator int")
    assert {(r.k, r.d): r.restated for r in S.restate_history(b, s, "k", "d", "p").collect()} == {(1, date(2023, 1, 1)): 16667, (1, date(2023, 8, 1)): 33334, (2, date(2023, 1, 1)): 7}
    pos = spark.createDataFrame([(1, 1, date(2023, 1, 5)), (1, 2, date(2023, 1, 5)), (2, 9, date(2023, 1, 5))], "g int, k long, since date")
    assert {r.g: r.usable_from for r in S.usable_start(pos, b, ["g"], "k", "since", "d").collect()} == {1: date(2023, 1, 5), 2: None}
    legs = spark.createDataFrame([("geo", "x", "seg", "y", 1), ("seg", "y", "geo", "x", 1), ("seg", "q", "prod", "w", 2)], "a string, m string, oa string, om string, v int")
    assert sorted(tuple(r) for r in X.orient_axes(legs, "a", "m", "oa", "om", ["geo"]).collect()) == [("geo", "x", "seg", "y", 1)]
    pay = spark.createDataFrame([(1, 2.0, "Feed"), (1, 3.0, "Feed"), (1, 4.0, "Manual"), (2, 5.0, "Other")], "k int, amount double, source string")
    assert {r.k: (r.source, r.amount, r.parts) for r in X.combine_payments(pay, ["k"], "amount", "source", ["Manual", "Feed"]).collect()} == {1: ("Manual", 4.0, 1), 2: ("Other", 5.0, 1)}


def test_feeds_and_failures(spark):
    atom = '<?xml version="1.0"?><feed xmlns="http://www.w3.org/2005/Atom"><entry><title>10-K - ACME CORP (0000001234) (Filer)</title><updated>2024-03-01T10:00:00-05:00</updated><category term="10-K"/><id>urn:tag:x,2008:accession-number=0000001234-24-000001</id></entry></feed>'
    r = M.atom_entries(spark.createDataFrame([(1, atom), (2, None)], "i int, x string"), "i", "x").collect()
    assert [(x.form, x.cik, x.accession) for x in r] == [("10-K", "0000001234", "0000001234-24-000001")]
    lines = ["Form Type   Company Name   CIK   Date Filed  File Name", "-----", "13F-HR       ACME  CAPITAL LP          1234        20240215    edgar/data/1.txt", "SC 13D       B CO    99  2024-02-16  e/2.txt"]
    got = M.index_rows(spark.createDataFrame([(x,) for x in lines], "value string"), ["13F-HR", "SC 13D"]).collect()
    assert [(x.form, x.cik, x.filed, x.path) for x in got] == [("13F-HR", "0000001234", date(2024, 2, 15), "edgar/data/1.txt"), ("SC 13D", "0000000099", date(2024, 2, 16), "e/2.txt")]
    df = spark.createDataFrame([(1, 5), (2, None), (3, None)], "k int, v int")
    good, dead = I.split_failures(df, F.col("v").isNotNull(), "k", spark.createDataFrame([(3, 4)], "k int, attempts int"))
    assert [x.k for x in good.collect()] == [1] and {x.k: (x.attempts, x.wait_hours) for x in dead.collect()} == {2: (1, 1), 3: (5, None)}
    assert I.start_from(spark, df.limit(0), "v", None) == "2020-01-01" and I.start_from(spark, df, "v") == "5" and I.stale(df, "v", 6).count() == 3
