"""Texts that look the same, brought to one form.

``plain_form`` maps characters that cannot be told apart by eye to one of them: blanks to a
space, full-width forms and ligatures to plain letters, look-alike Cyrillic and Greek letters to
Latin ones, invisible characters to nothing. What is left to decide (composed against combining
accents, ignorable characters) is decided by accent- and case-sensitive Unicode collation in
SQL: texts equal under it are one class, whose canonical member is the smallest id.

Collating every text would be the dear part, so texts are first reduced to a 64-bit key that
equal-looking texts always share (letters without accents, ASCII only); only texts whose key
another stored text bears too are collated. Equal stored texts count once until the end.
"""

from __future__ import annotations

import unicodedata
from functools import cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

COLLATION = "UNICODE"

# Letters of other scripts that look like a Latin letter.
CYRILLIC = dict(zip("АВЕЅІЈКМНОРСТУХаеорсухѕіјԁԛԝһӏ", "ABESIJKMHOPCTYXaeopcyxsijdqwhl"))
GREEK = dict(zip("ΑΒΕΖΗΙΚΜΝΟΡΤΥΧο", "ABEZHIKMNOPTYXo"))
ARMENIAN = dict(zip("օՕ", "oO"))
LETTERS = CYRILLIC | GREEK | ARMENIAN
# Ligatures.
LIGATURES = {"ﬀ": "ff", "ﬁ": "fi", "ﬂ": "fl", "ﬃ": "ffi", "ﬄ": "ffl", "ﬅ": "st", "ﬆ": "st"}


@cache
def accented_map() -> dict[str, str]:
    """Look-alike letters that bear accents in one character to the Latin letter with the same ones."""
    out = {}
    for cp in range(0x80, 0x10000):
        parts = unicodedata.normalize("NFD", chr(cp))
        if len(parts) > 1 and parts[0] in LETTERS:
            out[chr(cp)] = unicodedata.normalize("NFC", LETTERS[parts[0]] + parts[1:])
    return out


@cache
def character_map() -> dict[str, str]:
    """One-to-one replacements, from rules; the empty string for what can't be seen."""
    out = LETTERS | {a: b for a, b in accented_map().items() if len(b) == 1}
    for cp in range(0xFF01, 0xFF5F):  # full-width forms
        out[chr(cp)] = chr(cp - 0xFEE0)
    for cp in range(0x110000):
        ch = chr(cp)
        kind = unicodedata.category(ch)
        if kind == "Zs" or ch == "\t":
            out[ch] = " "
        elif kind == "Cf" or 0xFE00 <= cp <= 0xFE0F or ch in "͏ᅟᅠㅤ":
            out[ch] = ""
    return {a: b for a, b in out.items() if a != b}


@cache
def key_map() -> dict[str, str]:
    """Characters to the plain one they are built on; accents, blanks and invisible ones to nothing."""
    out, looks = {}, character_map()
    for cp in range(0x110000):
        ch = chr(cp)
        kind = unicodedata.category(ch)
        if 0xAC00 <= cp <= 0xD7A3 or kind in ("Cn", "Co", "Cs"):
            continue
        if kind[0] in "MZ" or kind in ("Cf", "Cc") or looks.get(ch) == "":
            out[ch] = ""
            continue
        base = unicodedata.normalize("NFD", looks.get(ch, ch))[0]
        base = LETTERS.get(base, base)
        if base != ch:
            out[ch] = base
    return out


def _translate(text: Column, table: dict[str, str]) -> Column:
    """``translate`` by a table; those without a replacement come last and are deleted."""
    kept = [(a, b) for a, b in table.items() if b]
    gone = [a for a, b in table.items() if not b]
    return F.translate(text, "".join(a for a, _ in kept) + "".join(gone), "".join(b for _, b in kept))


def _is_ascii(text: Column) -> Column:
    return F.length(text) == F.octet_length(text)


def plain_form(text: Column) -> Column:
    """The text with look-alike characters mapped; a null stays null. Line breaks are kept."""
    wide = text
    for a, b in LIGATURES.items():
        wide = F.replace(wide, F.lit(a), F.lit(b))
    # rare: accents that no Latin letter bears in one character
    rare = {a: b for a, b in accented_map().items() if len(b) > 1}
    spelt = wide
    for a, b in rare.items():
        spelt = F.replace(spelt, F.lit(a), F.lit(b))
    wide = F.when(text.rlike(f"[{''.join(rare)}]"), spelt).otherwise(wide)
    return F.when(_is_ascii(text), F.replace(text, F.lit("\t"), F.lit(" "))).otherwise(_translate(wide, character_map()))


def coarse_key(text: Column) -> Column:
    """64 bits that texts of equal looks share: the text without accents, blanks and what can't be seen.

    One pass over the characters. Korean syllables, which come apart into several letters, are left out.
    """
    wide = text
    for a, b in LIGATURES.items():
        wide = F.replace(wide, F.lit(a), F.lit(b))
    bare = _translate(wide, key_map())
    korean = r"[\uAC00-\uD7A3\u1100-\u11FF\uA960-\uA97F\uD7B0-\uD7FF]+"
    bare = F.when(text.rlike(korean), F.regexp_replace(bare, korean, "")).otherwise(bare)
    return F.xxhash64(F.when(_is_ascii(text), F.regexp_replace(text, r"[\x00-\x20\x7f]+", "")).otherwise(bare))


def look_classes(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", with_form: bool = False) -> DataFrame:
    """(doc_id, canonical_id, variant): documents of which another text looks the same.

    ``with_form`` adds ``form``, the canonical member's plain form.

    ``canonical_id`` is the smallest document of the class, ``variant`` tells the stored texts of
    a class apart. Documents whose text is null or that only exact copies share are left out.
    A repeated row counts once. Extra columns are ignored.
    """
    rows = docs.select(F.col(doc_id).alias("_id"), F.col(text).alias("_text")).filter(F.col("_text").isNotNull() & F.col("_id").isNotNull())
    keyed = rows.select("_id", coarse_key(F.col("_text")).alias("_key"), F.md5("_text").alias("_variant"))
    variants = keyed.groupBy("_key", "_variant").agg(F.min("_id").alias("_rep"))
    shared = variants.groupBy("_key").agg(F.count("*").alias("_n")).filter(F.col("_n") > 1)
    reps = variants.join(shared, "_key", "left_semi").select("_rep", "_variant")
    texts = rows.join(reps, F.col("_id") == F.col("_rep")).select("_variant", plain_form(F.col("_text")).alias("_plain")).dropDuplicates(["_variant"])
    classes = (
        texts.groupBy(F.collate("_plain", COLLATION).alias("_look"))
        .agg(F.collect_set("_variant").alias("_variants"))
        .filter(F.size("_variants") > 1)
        .select(F.array_min("_variants").alias("_class"), F.explode("_variants").alias("_variant"))
    )
    members = keyed.select("_id", "_variant").distinct().join(classes, "_variant")
    canonical = members.groupBy("_class").agg(F.min("_id").alias("canonical_id"), F.min_by("_variant", "_id").alias("_chosen"))
    if with_form:
        canonical = canonical.join(texts.select(F.col("_variant").alias("_chosen"), F.col("_plain").alias("form")), "_chosen")
    return members.join(canonical, "_class").select(
        F.col("_id").alias(doc_id), "canonical_id", F.col("_variant").alias("variant"), *(["form"] if with_form else [])
    )


def look_pairs(classes: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """(doc_id_a, doc_id_b), a < b: documents of a class whose stored texts differ."""
    a = classes.select(F.col("canonical_id"), F.col(doc_id).alias("doc_id_a"), F.col("variant").alias("_va"))
    b = classes.select(F.col("canonical_id"), F.col(doc_id).alias("doc_id_b"), F.col("variant").alias("_vb"))
    return (
        a.join(b, "canonical_id").filter((F.col("doc_id_a") < F.col("doc_id_b")) & (F.col("_va") != F.col("_vb")))
        .select("doc_id_a", "doc_id_b").distinct()
    )


def one_form(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, canonical_id, form): every document with the one form of its class.

    A document of no class is its own canonical member.
    """
    rows = docs.select(F.col(doc_id).alias("_id"), plain_form(F.col(text)).alias("_form")).dropDuplicates(["_id"])
    named = look_classes(docs, doc_id, text, with_form=True).dropDuplicates([doc_id]).select(F.col(doc_id).alias("_m"), "canonical_id", "form")
    return rows.join(named, F.col("_id") == F.col("_m"), "left").select(
        F.col("_id").alias(doc_id), F.coalesce("canonical_id", "_id").alias("canonical_id"), F.coalesce("form", "_form").alias("form")
    )
