"""Text functions as Spark columns, and keyword search over documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Typographic characters and the plain ones they are read as; one for one, so offsets stay.
TYPOGRAPHY = (
    "\u2018\u2019\u201a\u201b\u2032`\u00b4\u201c\u201d\u201e\u201f\u2033\u2010\u2011\u2012\u2013\u2014\u2015\u2212\u00a0",
    "'''''''\"\"\"\"\"------- ",
)
# The brackets in which amounts are disclosed; a lower bound tells its upper one.
BRACKETS = {
    1_001: 15_000, 15_001: 50_000, 50_001: 100_000, 100_001: 250_000, 250_001: 500_000, 500_001: 1_000_000,
    1_000_001: 5_000_000, 5_000_001: 25_000_000, 25_000_001: 50_000_000,
}


def tokens(c: Column) -> Column:
    """Words in lower case, in the order of their first place, each once."""
    return F.array_distinct(F.filter(F.split(F.lower(c), r"[^\p{L}\p{Nd}]+"), lambda x: F.length(x) > 0))


def all_tokens(c: Column) -> Column:
    return F.filter(F.split(F.lower(c), r"[^\p{L}\p{Nd}]+"), lambda x: F.length(x) > 0)


def fold_typography(c: Column) -> Column:
    return F.translate(c, *TYPOGRAPHY)


def strip_html(c: Column) -> Column:
    """Text of HTML: scripts, styles and comments dropped, text nodes joined by a space."""
    bare = F.regexp_replace(c, r"(?is)<(script|style)\b[^>]*>.*?</\1\s*>|<!--.*?-->", " ")
    bare = F.regexp_replace(bare, r"(?s)<[^>]+>", " ")
    for entity, ch in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        bare = F.replace(bare, F.lit(entity), F.lit(ch))
    return F.trim(F.regexp_replace(bare, r"\s+", " "))


def slug(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(c), "[^a-z0-9]+", "-"), "^-|-$", "")


def cik_spellings(c: Column) -> Column:
    """A CIK padded to ten digits and without leading zeros."""
    bare = F.ltrim(F.trim(c), F.lit("0"))
    return F.struct(F.lpad(bare, 10, "0").alias("padded"), bare.alias("bare"))


def ticker_in(c: Column) -> Column:
    """A ticker in brackets, as in "Name Inc. (TICK)"; the empty string if there is none.

    One to five letters, a point and a class of one or two letters if there is one; round or square
    brackets, blanks inside them don't count.
    """
    round_ = F.translate(c, "[]", "()")
    return F.upper(F.regexp_extract(round_, r"\((?:\p{Z}|\t)*(\p{Alpha}{1,5}+(?:[.]\p{Alpha}\p{Alpha}?)?)(?:\p{Z}|\t)*\)", 1))


def amount_range(c: Column) -> Column:
    """(low, high) of "$1,001 - $15,000"; thousands broken by a blank are joined.

    A single amount is the upper bound, unless it says "over" or ends in "+" (both bounds) or its other
    end was lost ("$1,001 -"), which the bracket it begins tells; so it does for a high below its low.
    No amount at all gives (0, 0).
    """
    text = F.trim(F.coalesce(c, F.lit("")))
    joined = F.regexp_replace(text, r"(\d),\s+(\d{3})", "$1,$2")
    found = F.transform(F.regexp_extract_all(joined, F.lit(r"\$\s*([\d,]+)"), 1), lambda x: F.coalesce(F.replace(x, F.lit(","), F.lit("")).try_cast("bigint"), F.lit(0)))
    one, two = F.get(found, 0), F.get(found, 1)
    ceiling = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x).cast("bigint") for pair in BRACKETS.items() for x in pair]), one), one)
    single = F.when(text.endswith("+") | F.lower(text).contains("over"), one).when(text.endswith("-"), ceiling)
    low = F.when(one.isNull(), 0).when(two.isNotNull() | single.isNotNull(), one).otherwise(0)
    high = F.when(one.isNull(), 0).when(two.isNull(), F.coalesce(single, one)).when(two < one, ceiling).otherwise(two)
    return F.struct(low.cast("bigint").alias("low"), high.cast("bigint").alias("high"))


def any_date(c: Column) -> Column:
    """A date in one of the formats that filings use, or null."""
    return F.coalesce(*[F.try_to_date(F.trim(c), f) for f in ("yyyy-MM-dd", "dd-MMM-yyyy", "MM/dd/yyyy", "M/d/yyyy", "yyyyMMdd")])


def export_cell(c: Column) -> Column:
    """Text for CSV that no spreadsheet takes for a formula."""
    return F.when(c.rlike(r"^[=+\-@\t\r]"), F.concat(F.lit("'"), c)).otherwise(c)


def compact_usd(c: Column) -> Column:
    """$1.2B, $3.4M, $5.6K or $78."""
    x, sign = F.abs(c.cast("double")), F.when(c < 0, "-").otherwise("")
    text = F.lit(None).cast("string")
    for least, letter in ((1e12, "T"), (1e9, "B"), (1e6, "M"), (1e3, "K")):
        text = F.coalesce(text, F.when(x >= least, F.concat(F.lit("$"), F.format_string("%.1f", F.round(x / least, 1)), F.lit(letter))))
    return F.concat(sign, F.coalesce(text, F.concat(F.lit("$"), F.format_string("%.0f", F.round(x)))))


def country_names(spark) -> dict[str, str]:
    """English names of the countries by their two letters, as the Java runtime has them."""
    locale = spark.sparkContext._jvm.java.util.Locale
    return {code: locale("", code).getDisplayCountry(locale.ENGLISH) for code in locale.getISOCountries()}


def humanise(c: Column, countries: dict[str, str] | None = None) -> Column:
    """"us-gaap:ProductSalesMember" as "Product Sales", "country:DE" as "Germany".

    Words begin at a capital after a small letter or digit, and at the last capital of several
    before a small one, if it isn't the second letter ("IPhone" is one word).
    """
    bare = F.regexp_replace(F.regexp_replace(c, "^.*:", ""), "(?<=.)(Member|Domain|Axis)$", "")
    words = F.regexp_replace(F.regexp_replace(bare, "([a-z0-9])([A-Z])", "$1 $2"), "([^ ][A-Z])([A-Z][a-z])", "$1 $2")
    words = F.trim(F.regexp_replace(words, "( [A-Z])([A-Z][a-z])", "$1 $2"))
    if not countries:
        return words
    named = F.try_element_at(F.create_map(*[F.lit(x) for pair in countries.items() for x in pair]), F.upper(bare))
    return F.when(c.startswith("country:"), F.coalesce(named, bare)).otherwise(words)


def member_key(members: Column) -> Column:
    """Canonical key of a map of axis to member: sorted pairs, hashed; empty for none."""
    pairs = F.array_sort(F.transform(F.map_entries(members), lambda e: F.concat_ws("=", e["key"], e["value"])))
    return F.when(F.size(pairs) == 0, F.lit("")).otherwise(F.sha2(F.array_join(pairs, "|"), 256))


def keyword_lines(docs: DataFrame, doc_id: str, text: str, word: str, around: int = 1) -> DataFrame:
    """(doc_id, line_no, line, is_hit): lines with the word and those next to them, each once.

    A line is kept by looking at its neighbours, not by joining hits back to lines.
    """
    lines = docs.select(doc_id, F.posexplode(F.split(text, "\n")).alias("line_no", "line"))
    hit = F.contains(F.lower(fold_typography(F.col("line"))), F.lit(word.lower()))
    w = Window.partitionBy(doc_id).orderBy("line_no").rowsBetween(-around, around)
    marked = lines.withColumn("is_hit", F.coalesce(hit, F.lit(False))).withColumn("_near", F.max("is_hit").over(w))
    return marked.filter("_near").drop("_near")


def line_range(c: Column, start: int, n: int) -> Column:
    """Lines start to start + n - 1 (from 1, at most 2000 of them)."""
    return F.array_join(F.slice(F.split(c, "\n"), start, max(1, min(n, 2000))), "\n")


def chunks(docs: DataFrame, doc_id: str, text: str, size: int = 1024, overlap: int = 128) -> DataFrame:
    """(doc_id, chunk, first_word, n_words, content): windows of words that overlap."""
    step = size - overlap
    words = docs.select(doc_id, F.filter(F.split(text, r"\s+"), lambda x: F.length(x) > 0).alias("_w")).filter(F.size("_w") > 0)
    last = F.greatest(F.ceil((F.size("_w") - overlap) / step), F.lit(1)).cast("int")
    at = words.withColumn("chunk", F.explode(F.sequence(F.lit(0), last - 1)))
    part = F.slice("_w", F.col("chunk") * step + 1, size)
    return at.select(doc_id, "chunk", (F.col("chunk") * step).alias("first_word"), F.size(part).alias("n_words"), F.array_join(part, " ").alias("content"))


def bm25(docs: DataFrame, doc_id: str, text: str, query: list[str], k: int, k1: float = 1.2, b: float = 0.75, every: bool = False) -> DataFrame:
    """(doc_id, score): the k documents that fit the words best; ``every`` asks for all words.

    Term counts come from one pass per document inside the JVM; only the query's words leave it,
    so the shuffle is by document frequency of few words. Counts cover all documents.
    """
    words = [w.lower() for w in dict.fromkeys(query)]
    toks = docs.select(doc_id, all_tokens(F.coalesce(F.col(text), F.lit(""))).alias("_t"))
    count = lambda w: F.size(F.filter("_t", lambda x: x == F.lit(w)))
    tf = [count(w).alias(f"tf{i}") for i, w in enumerate(words)]
    counted = toks.select(doc_id, F.size("_t").alias("_n"), *tf)
    stats = counted.agg(F.count("*").alias("_docs"), F.avg("_n").alias("_avg"), *[F.count_if(F.col(f"tf{i}") > 0).alias(f"df{i}") for i in range(len(words))])
    hit = [F.col(f"tf{i}") > 0 for i in range(len(words))]
    keep = hit[0]
    for h in hit[1:]:
        keep = keep & h if every else keep | h
    score = F.lit(0.0)
    for i in range(len(words)):
        df, f = F.col(f"df{i}"), F.col(f"tf{i}").cast("double")
        idf = F.log(1 + (F.col("_docs") - df + 0.5) / (df + 0.5))
        score = score + F.when(f > 0, idf * f * (k1 + 1) / (f + k1 * (1 - b + b * F.col("_n") / F.col("_avg")))).otherwise(0.0)
    found = counted.filter(keep).crossJoin(F.broadcast(stats))
    return found.select(doc_id, F.round(score, 6).alias("score")).orderBy(F.desc("score"), doc_id).limit(k)


def build_index(docs: DataFrame, doc_id: str, text: str, path: str, parts: int = 64) -> None:
    """Writes an inverted index: a posting (term, document, count, document's words) a pair, by hash of the term.

    Texts are read and split once, counts are combined map-side, and a search reads the parts of its words only.
    """
    split = docs.select(F.col(doc_id).alias("doc"), all_tokens(F.coalesce(F.col(text), F.lit(""))).alias("_t"))
    split.select("doc", F.size("_t").alias("n")).write.mode("overwrite").parquet(f"{path}/lengths")
    each = split.select("doc", F.size("_t").alias("n"), F.explode("_t").alias("term"))
    postings = each.groupBy("doc", "n", "term").agg(F.count("*").cast("int").alias("tf")).withColumn("part", F.pmod(F.xxhash64("term"), F.lit(parts)).cast("int"))
    postings.repartition("part").sortWithinPartitions("part", "term").write.mode("overwrite").partitionBy("part").parquet(f"{path}/postings")


def search_index(spark, path: str, doc_id: str, query: list[str], k: int, k1: float = 1.2, b: float = 0.75, every: bool = False, parts: int = 64) -> DataFrame:
    """(doc_id, score): what ``bm25`` finds, from an index that ``build_index`` wrote."""
    words = [w.lower() for w in dict.fromkeys(query)]
    asked = spark.createDataFrame([(w,) for w in words], "term string").withColumn("part", F.pmod(F.xxhash64("term"), F.lit(parts)).cast("int"))
    where = sorted({r.part for r in asked.collect()})
    hits = spark.read.parquet(f"{path}/postings").filter(F.col("part").isin(where) & F.col("term").isin(words))
    stats = spark.read.parquet(f"{path}/lengths").agg(F.count("*").alias("_docs"), F.avg("n").alias("_avg"))
    held = hits.groupBy("term").agg(F.count("*").alias("_df"))  # one row a word of the query
    rows = hits.join(F.broadcast(held), "term").crossJoin(F.broadcast(stats))
    f = F.col("tf").cast("double")
    idf = F.log(1 + (F.col("_docs") - F.col("_df") + 0.5) / (F.col("_df") + 0.5))
    part = idf * f * (k1 + 1) / (f + k1 * (1 - b + b * F.col("n") / F.col("_avg")))
    scored = rows.groupBy("doc").agg(F.sum(part).alias("s"), F.count("*").alias("m"))
    kept = scored.filter(F.col("m") == len(words)) if every else scored
    return kept.select(F.col("doc").alias(doc_id), F.round("s", 6).alias("score")).orderBy(F.desc("score"), doc_id).limit(k)


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays up to the shorter one's length; 0 if either has no length."""
    n = F.least(F.size(a), F.size(b))
    x, y = F.slice(a, F.lit(1), n), F.slice(b, F.lit(1), n)
    dot = lambda u, v: F.aggregate(F.zip_with(u, v, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, z: s + z)
    norm = F.sqrt(dot(x, x)) * F.sqrt(dot(y, y))
    return F.when(norm > 0, dot(x, y) / norm).otherwise(F.lit(0.0))


def _total(terms: list[Column]) -> Column:
    """The sum of columns as a tree of even depth."""
    while len(terms) > 1:
        terms = [a + b for a, b in zip(terms[::2], terms[1::2])] + terms[len(terms) & ~1 :]
    return terms[0]


def _cosine_to(v: Column, query: list[float], most: int = 512) -> Column:
    """``cosine`` with a given vector: written out term by term, which compiles, unless it is very long or v is shorter."""
    slow = cosine(v, F.array(*[F.lit(float(x)) for x in query]))
    if not 0 < len(query) <= most:
        return slow
    at = [F.get(v, F.lit(i)).cast("double") for i in range(len(query))]
    norm = F.sqrt(_total([x * x for x in at])) * float(sum(x * x for x in query)) ** 0.5
    dot = _total([x * float(q) for x, q in zip(at, query)])
    return F.when(F.size(v) >= len(query), F.when(norm > 0, dot / norm).otherwise(F.lit(0.0))).otherwise(slow)


def nearest(vectors: DataFrame, vec_id: str, vector: str, query: list[float], k: int, least: float | None = None) -> DataFrame:
    """(vec_id, similarity): the k vectors nearest by cosine; exact, one pass, top-k by partition."""
    scored = vectors.select(vec_id, F.round(_cosine_to(F.col(vector), query), 6).alias("similarity"))
    if least is not None:
        scored = scored.filter(F.col("similarity") >= least)
    return scored.orderBy(F.desc("similarity"), vec_id).limit(k)


def fuse_ranks(a: DataFrame, b: DataFrame, key: str, score_a: str, score_b: str, constant: int = 60) -> DataFrame:
    """(key, fused): reciprocal ranks of two top-k lists added up."""
    ra = a.select(key, F.row_number().over(Window.orderBy(F.desc(score_a), key)).alias("_ra"))
    rb = b.select(key, F.row_number().over(Window.orderBy(F.desc(score_b), key)).alias("_rb"))
    part = lambda c: F.coalesce(1.0 / (constant + F.col(c)), F.lit(0.0))
    return ra.join(rb, key, "full").select(key, F.round(part("_ra") + part("_rb"), 8).alias("fused"))
