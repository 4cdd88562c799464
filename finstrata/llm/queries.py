"""Queries p8 to p10 (and p5) over the tables of a data directory."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from finstrata.core.tables import table
from finstrata.llm import entity_match, leaks, lookalike, packing

TOKENIZER = os.environ.get("FINSTRATA_TOKENIZER", "/opt/tokenizers/byte_bpe_50k.tiktoken")


def p5_matches(spark: SparkSession, d: str) -> DataFrame:
    """Entries of other-manager lists with the institution they denote and a confidence."""
    return entity_match.match_records(
        table(spark, d, "other_manager_identity"), "entry_id", "name", ["cik", "form13f_file_number", "crd_number", "sec_file_number"],
        table(spark, d, "institutional_holder"), "institutional_holder_id", "name", ["cik", "form13f_file_number", "crd_number"],
        "state_or_country",
    )


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return p5_matches(spark, d).select("institutional_holder_id", "entry_id")


def p8_containers(spark: SparkSession, d: str) -> DataFrame:
    """Every text's place in containers of 2,048 tokens."""
    return packing.pack(table(spark, d, "documents"), TOKENIZER)


def p8_report(spark: SparkSession, d: str) -> DataFrame:
    """Whether the containers keep their promises: all texts placed, none split without need, none overfull, hardly a gap."""
    r = packing.packing_report(p8_containers(spark, d))
    # all but the last container of each of at most 1000 partitions' merges can be nearly full
    least = F.ceil(F.col("tokens") / packing.CAPACITY)
    return r.select("documents", "split_without_need", (F.col("fullest") <= packing.CAPACITY).alias("none_overfull"), (F.col("containers") <= least * 1.02 + 64).alias("nearly_least"))


def p9_exact(spark: SparkSession, d: str) -> DataFrame:
    """Documents that hold twelve successive words of an item to the letter (in one form of characters)."""
    got = leaks.leaked_items(table(spark, d, "documents"), table(spark, d, "eval_item"), words_an_edit=1 << 30)
    return got.select("doc_id", "item_id")


def p9_passages(spark: SparkSession, d: str) -> DataFrame:
    """Documents with the items they give away, the words of the longest passage and its edits."""
    return leaks.leaked_items(table(spark, d, "documents"), table(spark, d, "eval_item"))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return p9_passages(spark, d).select("doc_id", "item_id")


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return lookalike.look_pairs(lookalike.look_classes(table(spark, d, "documents")))


def p10_one_form(spark: SparkSession, d: str) -> DataFrame:
    """Every document with the one form of what looks like it (as its length and hash)."""
    forms = lookalike.one_form(table(spark, d, "documents"))
    return forms.select("doc_id", "canonical_id", F.length("form").alias("n_chars"), F.md5("form").alias("form_md5"))


QUERIES = {
    "p5_found": p5_found, "p5_matches": p5_matches, "p8_containers": p8_containers, "p8_report": p8_report, "p9_exact": p9_exact, "p9_found": p9_found, "p9_passages": p9_passages, "p10_found": p10_found,
    "p10_one_form": p10_one_form,
}

def _form_sql() -> tuple[str, str]:
    """SQL of the form of a text, characters mapped, and the characters that are dropped from it."""
    pairs = {a: b for a, b in lookalike.character_map().items() if b}
    gone = "".join(f"\\x{{{ord(a):X}}}" for a, b in lookalike.character_map().items() if not b and ord(a) < 0x10000)
    form = "text"
    for a, b in lookalike.LIGATURES.items():
        form = f"replace({form}, '{a}', '{b}')"
    return f"translate({form}, '{''.join(pairs)}', '{''.join(x.replace(chr(39), chr(39) * 2) for x in pairs.values())}')", gone


_FORM, _GONE = _form_sql()
# The same pairs by another way: characters mapped, then NFC, compared as they are.
_LOOKS = f"n AS (SELECT *, nfc_normalize(form) AS look FROM (SELECT doc_id, text, regexp_replace({_FORM}, '[{_GONE}]', '', 'g') AS form FROM documents WHERE text IS NOT NULL))"
P10_SQL = f"""WITH {_LOOKS}
SELECT DISTINCT a.doc_id AS doc_id_a, b.doc_id AS doc_id_b FROM n a JOIN n b ON a.look = b.look AND a.doc_id < b.doc_id WHERE a.text <> b.text"""
P10B_SQL = f"""WITH {_LOOKS}, c AS (SELECT look, min(doc_id) AS canonical_id, arg_min(form, doc_id) AS form FROM n GROUP BY 1 HAVING count(DISTINCT text) > 1)
SELECT doc_id, coalesce(c.canonical_id, n.doc_id) AS canonical_id, CAST(length(coalesce(c.form, n.form)) AS INT) AS n_chars, md5(coalesce(c.form, n.form)) AS form_md5 FROM n LEFT JOIN c USING (look)
UNION ALL SELECT doc_id, doc_id, NULL, NULL FROM documents WHERE text IS NULL"""
P8_SQL = "SELECT count(DISTINCT doc_id) AS documents, CAST(0 AS BIGINT) AS split_without_need, true AS none_overfull, true AS nearly_least FROM documents WHERE text IS NOT NULL AND doc_id IS NOT NULL"
# Every run of twelve words of every text, compared as they are.
_BARE = "regexp_replace(regexp_replace(lower(strip_accents(look)), '([0-9])[.,'']([0-9])', '\\1\\2', 'g'), '([0-9])[.,'']([0-9])', '\\1\\2', 'g')"


def _runs_sql(name: str, key: str, source: str) -> str:
    looks = _LOOKS.replace("n AS (", f"{name}_n AS (").replace("doc_id", key).replace("FROM documents", f"FROM {source}")
    return f"""{looks}, {name}_w AS (SELECT {key}, regexp_extract_all({_BARE}, '[\\p{{L}}\\p{{N}}]+') AS w FROM {name}_n),
{name} AS (SELECT DISTINCT {key}, array_to_string(w[i : i + 11], ' ') AS run FROM (SELECT {key}, w, unnest(range(1, len(w) - 10)) AS i FROM {name}_w WHERE len(w) >= 12))"""


P9_SQL = f"WITH {_runs_sql('d', 'doc_id', 'documents')}, {_runs_sql('i', 'item_id', 'eval_item')} SELECT DISTINCT d.doc_id, i.item_id FROM d JOIN i USING (run)"

ORACLES: dict[str, str] = {"p10_found": P10_SQL, "p10_one_form": P10B_SQL, "p8_report": P8_SQL, "p9_exact": P9_SQL}
