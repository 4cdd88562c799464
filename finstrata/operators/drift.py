"""Files whose layout drifts, read into one table with a log of the changes.

Headers are read in parallel and every column is placed in a field: by its heading where that is
known, else by its content, which is compared with the profile of each field (how often its cells
have which shape) that the columns of known headings give over all files. Which headings are known
is a parameter; one a field is enough to learn the profiles. Each field of each file has
a type; types form a lattice (integer < decimal < text) and are folded up it to the type of the
union schema. Changes are differences between a file and the one published before it in its feed.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from finstrata.core.tables import checkpoint_dir

# Fields, the headings they are known to bear, and what their cells look like.
FIELDS = {
    "accession_number": (["accessionnumber", "accn", "filingaccession", "submissionref"], r"\d{10}-\d{2}-\d{6}"),
    "sequence_number": (["sequencenumber", "seqno", "mgrordinal", "othermanagersk"], r"[A-Za-z]?\d{1,5}(\.\d+)?"),
    "name": (["name", "firm", "managername", "othermanager"], r"(?=.*[A-Za-z]{3}).{3,}"),
    "cik": (["cik", "filercik", "centralindexkey", "registrantkey"], r"\d{7,10}(\.\d+)?"),
    "form13f_file_number": (["form13ffilenumber", "form13ffileno", "fileno028", "thirteenfnr"], r"0?28-?\d{5,8}"),
    "crd_number": (["crdnumber", "crd", "iardcrd", "advisercrdno"], r"0*\d{5,9}(\.\d+)?"),
    "sec_file_number": (["secfilenumber", "secno801", "advfileno", "adviserfile"], r"801-?\d{5,8}"),
    "state_or_country": (["stateorcountry", "statectry", "domicile"], r"[A-Z0-9]{2}"),
    "filing_date": (["filingdate", "datefiled", "filedon"], r"\d{4}-\d{2}-\d{2}"),
}
NAMES = list(FIELDS)
#: The lattice of types, from the least; a field's type in the union is the greatest it ever has.
TYPES = ["integer", "decimal", "text"]
#: Share of a column's filled cells that must fit a field for its content to speak for the field.
FITS = 0.8
#: Share below which a shape says no more about a field than one that it never had.
SHAPE_FLOOR = 1e-6


def plain_heading(h: Column) -> Column:
    """A heading without case, blanks and punctuation (a byte order mark is such)."""
    return F.regexp_replace(F.lower(h), r"[^\p{L}\p{N}]", "")


def headings(files: DataFrame) -> DataFrame:
    """(file_id, pos, heading) of every column of every file that has a header line."""
    return (
        files.select("file_id", F.posexplode(F.split("header_line", "\t", -1)).alias("pos", "h"))
        .select("file_id", "pos", plain_heading(F.col("h")).alias("heading"))
    )


def cells(lines: DataFrame) -> DataFrame:
    """(file_id, line_no, pos, cell) of the filled cells; empty lines have none."""
    return (
        lines.select("file_id", "line_no", F.posexplode(F.split("raw_line", "\t", -1)).alias("pos", "c"))
        .select("file_id", "line_no", "pos", F.trim("c").alias("cell"))
        .filter(F.col("cell") != "")
    )


def type_of(cell: Column) -> Column:
    """Place in TYPES of one cell."""
    return F.when(cell.rlike(r"^(0|[1-9]\d*)$"), 0).when(cell.rlike(r"^\d+\.\d+$"), 1).otherwise(2)


def shape_of(cell: Column) -> Column:
    """What a cell looks like: digits as 9, letters as a, words as w; a number without padding and fraction.

    A short group of digits before a mark ("028-") stays: such prefixes tell registers apart.
    """
    number = F.regexp_replace(F.regexp_replace(cell, r"^0+(?=\d)", ""), r"\.\d+$", "")
    bare = F.when(cell.rlike(r"^\d+(\.\d+)?$"), number).otherwise(cell)
    prefix = F.regexp_extract(cell, r"^\d{1,3}(?=[^\d.])", 0)
    words = F.regexp_replace(F.regexp_replace(F.regexp_replace(bare, r"\d", "9"), r"\p{L}{3,}", "w"), r"\p{L}", "a")
    return F.concat(prefix, F.regexp_replace(words, r"w(?:[^9a]*w)*[^9a]*", "w"))


def placed_columns(files: DataFrame, lines: DataFrame, fields: dict = FIELDS) -> DataFrame:
    """(file_id, pos, heading, field, type): every file's columns that hold a known field.

    ``fields``: of each field the headings known for it and the pattern of its cells. A known heading
    decides unless most of the column's cells fit another field's pattern and hardly any fit its own.
    Any other column goes to the field whose profile its shapes are likeliest under, if at least FITS of
    its cells have a shape of that profile; where no profile fits, to the first pattern most cells fit.
    Of two columns for one field the one with a known heading, else the first, counts. A field without
    filled cells has no type.
    """
    names = list(fields)
    fits = [F.count_if(F.col("cell").rlike(f"^(?:{pattern})$")).alias(f) for f, (_, pattern) in fields.items()]
    kinds = [F.min(type_of(F.col("cell"))).alias("least"), F.max(type_of(F.col("cell"))).alias("most")]
    # lines are read once: what is asked of them fits in a few rows a column, which are cut off here
    checkpoint_dir(files.sparkSession)
    shapes = cells(lines).groupBy("file_id", "pos", shape_of(F.col("cell")).alias("shape")).agg(F.count("*").alias("n"), *kinds, *fits).checkpoint()
    whole = F.when(F.min("least") == F.max("most"), F.min("least")).otherwise(F.lit(len(TYPES) - 1)).alias("type")
    content = shapes.groupBy("file_id", "pos").agg(whole, *[(F.sum(f) / F.sum("n")).alias(f) for f in fields])
    heads = headings(files).join(content, ["file_id", "pos"], "left")
    named = reduce(
        lambda acc, f: F.when(F.col("heading").isin(fields[f][0]), F.lit(f)).otherwise(acc), names, F.lit(None).cast("string")
    )
    own = reduce(lambda acc, f: F.when(named == f, F.col(f)).otherwise(acc), names, F.lit(None).cast("double"))
    # by pattern, the narrow ones first and a name, which fits most things, last
    order = ["accession_number", "filing_date", "form13f_file_number", "sec_file_number", "state_or_country", "cik", "crd_number", "sequence_number", "name"]
    alike = F.coalesce(*[F.when(F.col(f) >= FITS, F.lit(f)) for f in order if f in fields])
    by_heading = F.when(named.isNotNull() & (own.isNull() | (own >= 1 - FITS) | alike.isNull()), named)
    placed = heads.select("file_id", "pos", "heading", "type", by_heading.alias("named"), alike.alias("alike"))

    shapes = shapes.select("file_id", "pos", "shape", "n")
    known = placed.filter(F.col("named").isNotNull()).select("file_id", "pos", F.col("named").alias("field"))
    seen = shapes.join(known, ["file_id", "pos"]).groupBy("field", "shape").agg(F.sum("n").alias("m"))
    total = F.sum("m").over(Window.partitionBy("field"))
    profile = seen.withColumn("gain", F.log(F.col("m") / total) - F.log(F.lit(SHAPE_FLOOR))).drop("m")
    open_ = shapes.join(placed.filter(F.col("named").isNull()).select("file_id", "pos"), ["file_id", "pos"])
    likely = open_.join(profile, "shape").groupBy("file_id", "pos", "field").agg(F.sum(F.col("n") * F.col("gain")).alias("score"), F.sum("n").alias("hit"))
    sizes = open_.groupBy("file_id", "pos").agg(F.sum("n").alias("all"))
    guess = likely.join(sizes, ["file_id", "pos"]).filter(F.col("hit") >= FITS * F.col("all")).groupBy("file_id", "pos").agg(
        F.max_by("field", F.struct("score", "field")).alias("guess")
    )
    first = F.row_number().over(Window.partitionBy("file_id", "field").orderBy(F.col("named").isNull(), "pos"))
    return (
        placed.join(guess, ["file_id", "pos"], "left")
        .withColumn("field", F.coalesce("named", "guess", "alike")).filter(F.col("field").isNotNull())
        .withColumn("_n", first).filter(F.col("_n") == 1).select("file_id", "pos", "heading", "type", "field")
    )


def layout_changes(files: DataFrame, lines: DataFrame, fields: dict = FIELDS) -> DataFrame:
    """(file_id, field_name, change_kind, previous_file_id): ordered differences within feeds.

    Files of a feed follow by published_on, then file_id; the first has no changes. Files
    without feed or date are left out. A field that is empty in either file isn't retyped.
    """
    layout = placed_columns(files, lines, fields).groupBy("file_id").agg(
        F.map_from_entries(F.collect_list(F.struct("field", F.struct("heading", "type")))).alias("layout")
    )
    w = Window.partitionBy("feed_id").orderBy("published_on", "file_id")
    paired = (
        files.select("file_id", "feed_id", "published_on").distinct()
        .filter(F.col("feed_id").isNotNull() & F.col("published_on").isNotNull() & F.col("file_id").isNotNull())
        .join(layout, "file_id", "left")
        .withColumns({"before": F.lag("layout").over(w), "previous_file_id": F.lag("file_id").over(w)})
        .filter(F.col("previous_file_id").isNotNull())
    )
    both = paired.withColumn("field_name", F.explode(F.array(*[F.lit(f) for f in fields]))).withColumns({
        "a": F.try_element_at("before", "field_name"), "b": F.try_element_at("layout", "field_name"),
    })
    a, b = F.col("a"), F.col("b")
    kinds = F.array_compact(F.array(
        F.when(a.isNull() & b.isNotNull(), "added"),
        F.when(a.isNotNull() & b.isNull(), "removed"),
        F.when(a["heading"] != b["heading"], "renamed"),
        F.when(a["type"] != b["type"], "retyped"),
    ))
    return both.select("file_id", "field_name", F.explode(kinds).alias("change_kind"), "previous_file_id")


def union_types(placed: DataFrame) -> dict[str, str]:
    """The folded type of each field: one row a field, whatever the number of files."""
    top = {r["field"]: r["t"] for r in placed.groupBy("field").agg(F.max("type").alias("t")).collect()}
    return {f: TYPES[top[f]] if top.get(f) is not None else "text" for f in NAMES}


def unified_table(files: DataFrame, lines: DataFrame, types: dict[str, str] | None = None, fields: dict = FIELDS) -> DataFrame:
    """(file_id, line_no, the fields): all lines in the union schema; repeated lines count once.

    ``types``: the union schema, by default folded from the files. Cells that are missing or empty are
    null; a line with none in a known field has no row. Of lines that bear one number the greatest cells
    count. Text keeps the cell as written; integer is bigint, decimal is double. Each file's map of
    fields to places is joined once and cells are picked by it, so lines are shuffled, cells aren't.
    """
    placed = placed_columns(files, lines, fields)
    types = types or union_types(placed)
    maps = placed.groupBy("file_id").agg(F.map_from_entries(F.collect_list(F.struct("field", "pos"))).alias("_at"))
    parts = lines.select("file_id", "line_no", F.split("raw_line", "\t", -1).alias("_c")).join(maps, "file_id")
    pick = lambda f: F.nullif(F.trim(F.get("_c", F.try_element_at("_at", F.lit(f)))), F.lit(""))
    rows = parts.select("file_id", "line_no", *[pick(f).alias(f) for f in fields])
    sql = {"integer": "bigint", "decimal": "double", "text": "string"}
    some = F.coalesce(*[F.col(f) for f in fields]).isNotNull()
    return rows.filter(some).groupBy("file_id", "line_no").agg(*[F.max(f).try_cast(sql[types[f]]).alias(f) for f in fields])
