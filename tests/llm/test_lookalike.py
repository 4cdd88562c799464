import itertools
import unicodedata

from pyspark.sql import functions as F

from finstrata.llm.lookalike import look_classes, look_pairs, one_form, plain_form

BASE = "The office in Café Ñandú sold 1,204 shares."
LOOKS = [
    BASE, BASE.replace(" ", " "), BASE.replace("office", "oﬃce"), unicodedata.normalize("NFD", BASE), "﻿" + BASE.replace("sold", "so​l­d"),
    BASE.replace("sold", "ｓｏｌｄ").replace("1,204", "１，２０４"), BASE.replace("shares", "ѕһаrеѕ").replace("The", "Тһе"), BASE.replace("in ", "in "), BASE.replace("o", "ο"),
]
OTHER = [BASE.replace("Café", "Cafe"), BASE.replace("1,204", "1,20⁴"), BASE.replace("shares", "Shares"), BASE.replace("sold", "µold"), BASE + " ", BASE.replace("1,204", "1,20²"), "", "​", " "]


def _docs(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("canonical_id", F.lit("clash"))


def test_pairs_that_look_the_same(spark):
    df = _docs(spark, LOOKS + OTHER + [BASE, None, None])
    got = {(r.doc_id_a, r.doc_id_b) for r in look_pairs(look_classes(df)).collect()}
    n, copy = len(LOOKS), len(LOOKS) + len(OTHER)
    want = set(itertools.combinations(range(n), 2)) | {(i, copy) for i in range(1, n)} | {(n + 6, n + 7)}
    assert got == want


def test_one_form_of_a_class(spark):
    df = _docs(spark, LOOKS + OTHER)
    rows = {r.doc_id: r for r in one_form(df).collect()}
    assert len(rows) == len(LOOKS + OTHER)
    assert {rows[i].form for i in range(len(LOOKS))} == {BASE} and {rows[i].canonical_id for i in range(len(LOOKS))} == {0}
    assert rows[len(LOOKS)].canonical_id == len(LOOKS)


def test_long_texts_and_repeats(spark):
    long = "wörd " * 200_000
    df = _docs(spark, [long, unicodedata.normalize("NFD", long), "x"]).union(_docs(spark, [long]))
    assert [tuple(r) for r in look_pairs(look_classes(df)).collect()] == [(0, 1)]


def test_other_scripts(spark):
    texts = ["한국어 텍스트", "й Ёлка Άθήνα", "日本 ガギ 金", "हिन्दी क़लम"]
    both = [unicodedata.normalize(f, t) for t in texts for f in ("NFC", "NFD")]
    want = {(i, i + 1) for i in range(0, len(both), 2) if both[i] != both[i + 1]}
    assert {(r.doc_id_a, r.doc_id_b) for r in look_pairs(look_classes(_docs(spark, both))).collect()} == want and len(want) >= 3
    mixed = _docs(spark, ["Ёлка", "\u00cbлка", "Ёлка", "Ἀθήνα", "A\u0313θήνα"])
    assert {(r.doc_id_a, r.doc_id_b) for r in look_pairs(look_classes(mixed)).collect()} == {(0, 1), (1, 2), (3, 4)}
    df = _docs(spark, ["日本語の文", "日本語の本", "русский", "русскии"])
    assert look_classes(df).count() == 0


def test_key_is_shared_whatever_the_spelling(spark):
    from finstrata.llm.lookalike import coarse_key

    seen = [chr(c) for c in range(0x20, 0x3400) if unicodedata.category(chr(c))[0] in "LNPS"]
    df = spark.createDataFrame([(c, unicodedata.normalize("NFD", c), unicodedata.normalize("NFC", c)) for c in seen], "a string, b string, c string")
    key = lambda c: coarse_key(F.col(c))
    assert df.filter((key("a") != key("b")) | (key("a") != key("c"))).count() == 0


def test_empty(spark):
    df = _docs(spark, ["x"]).limit(0)
    assert look_pairs(look_classes(df)).count() == 0 and one_form(df).count() == 0


def test_null_stays_null(spark):
    assert _docs(spark, [None]).select(plain_form(F.col("text"))).first()[0] is None
