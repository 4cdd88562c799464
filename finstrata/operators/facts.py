"""Selection and reconciliation of reported facts."""

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def pick_best(facts: DataFrame, keys: list[str], concepts: list[str], forms: list[str], as_first_reported: bool = False, days: tuple[int, int] = (0, 380)) -> DataFrame:
    """One fact a key: plausible span, latest period, form's rank, concept's rank, then filing order.

    Facts have concept, form, period_start (null for an instant), period_end, filed, accession.
    ``as_first_reported`` takes the earliest filing instead of the latest.
    """
    place = lambda c, xs: F.coalesce(F.array_position(F.array(*[F.lit(x) for x in xs]), F.col(c)), F.lit(0))
    rank = lambda c, xs: F.when(place(c, xs) > 0, place(c, xs)).otherwise(len(xs) + 1)
    span = F.col("period_start").isNull() | F.date_diff("period_end", "period_start").between(*days)
    filed = F.asc_nulls_last("filed") if as_first_reported else F.desc_nulls_last("filed")
    acc = F.asc_nulls_last("accession") if as_first_reported else F.desc_nulls_last("accession")
    w = Window.partitionBy(*keys).orderBy(F.desc("period_end"), rank("form", forms), rank("concept", concepts), filed, acc)
    return facts.filter(span & F.col("concept").isin(concepts)).withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn")


def one_per_span(facts: DataFrame, keys: list[str]) -> DataFrame:
    """The latest filed fact of each reporting span."""
    w = Window.partitionBy(*keys, "period_start", "period_end").orderBy(F.desc_nulls_last("filed"), F.desc_nulls_last("accession"))
    return facts.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn")


def with_fourth_quarters(facts: DataFrame, keys: list[str]) -> DataFrame:
    """Adds quarters that were filed under the full year, as fiscal_period Q4.

    A quarter-long fact counts if a year-long one of the same keys ends the same day and no Q4 is there.
    """
    n = F.date_diff("period_end", "period_start")
    year = facts.filter(n.between(350, 380)).select(*keys, "period_end").distinct()
    have = facts.filter(F.col("fiscal_period") == "Q4").select(*keys, "period_end").distinct()
    late = facts.filter(n.between(80, 100) & (F.col("fiscal_period") == "FY"))
    promoted = late.join(year, [*keys, "period_end"], "left_semi").join(have, [*keys, "period_end"], "left_anti")
    return facts.unionByName(promoted.withColumn("fiscal_period", F.lit("Q4")).select(*facts.columns))


def reconcile(members: DataFrame, totals: DataFrame, keys: list[str], value: str, total: str, filing: str, tolerance: float = 0.005) -> DataFrame:
    """The members of the latest filing whose sum is the total; else each member's latest value.

    Adds ``reconciled``. Filings are compared as wholes, so members of different filings never mix
    when one filing adds up.
    """
    sums = members.groupBy(*keys, filing).agg(F.sum(value).alias("_sum"))
    fits = sums.join(totals.select(*keys, F.col(total).alias("_total")), keys).filter(
        (F.col("_total") != 0) & (F.abs(F.col("_sum") / F.col("_total") - 1) <= tolerance)
    )
    chosen = fits.groupBy(*keys).agg(F.max(filing).alias("_chosen"))
    joined = members.join(chosen, keys, "left")
    whole = joined.filter(F.col("_chosen") == F.col(filing)).withColumn("reconciled", F.lit(True))
    w = Window.partitionBy(*keys, "member").orderBy(F.desc(filing), F.desc(value))
    rest = joined.filter(F.col("_chosen").isNull()).withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn").withColumn("reconciled", F.lit(False))
    return whole.unionByName(rest).drop("_chosen")


class Unfinished(Exception):
    """A search that stopped before it could tell."""


def subset_with_sum(values: list[int], target: int, least: int = 1, most_nodes: int = 200_000) -> list[int] | None:
    """Places of at least so many values that add up to the target, by depth-first search; None if there are none.

    Larger values come first; a branch ends when what is left can't reach the target. A search of more
    than ``most_nodes`` steps raises ``Unfinished``.
    """
    order = sorted(range(len(values)), key=lambda i: (-abs(values[i]), i))
    up, down = [0] * (len(order) + 1), [0] * (len(order) + 1)
    for k in range(len(order) - 1, -1, -1):
        v = values[order[k]]
        up[k], down[k] = up[k + 1] + max(v, 0), down[k + 1] + min(v, 0)
    nodes = 0
    stack: list[tuple[int, int, tuple[int, ...]]] = [(0, target, ())]
    while stack:
        k, left, taken = stack.pop()
        nodes += 1
        if left == 0 and len(taken) >= least:
            return sorted(taken)
        if nodes > most_nodes:
            raise Unfinished
        if k == len(order) or not down[k] <= left <= up[k]:
            continue
        stack.append((k + 1, left, taken))
        stack.append((k + 1, left - values[order[k]], (*taken, order[k])))
    return None


def rollup_members(cells: dict[str, dict[str, int]], least_periods: int, most_members: int) -> tuple[set[str], bool]:
    """(members that are sums of two or more others in enough periods, whether the search was finished)."""
    if len({m for c in cells.values() for m in c}) > most_members:
        return set(), False
    seen: dict[str, int] = {}
    try:
        for period in cells.values():
            for m, v in period.items():
                others = [w for n, w in period.items() if n != m and w]
                if v and subset_with_sum(others, v, 2):
                    seen[m] = seen.get(m, 0) + 1
    except Unfinished:
        return set(), False
    return {m for m, n in seen.items() if n >= least_periods}, True


def without_rollups(rows: DataFrame, keys: list[str], period: str, member: str, value: str, least_periods: int = 2, most_members: int = 12) -> DataFrame:
    """Members without those that are sums of others in at least ``least_periods`` periods; adds ``searched``.

    The search is exponential in a group's members, so it is done for up to ``most_members`` of them;
    larger groups, and those whose search doesn't end, are left whole and told by ``searched`` false.
    Rows of one group, period and member must be one.
    """
    kinds = dict(rows.dtypes)
    cells = F.collect_list(F.struct(F.col(period).cast("string").alias("p"), F.col(member).alias("m"), F.round(value, 0).cast("bigint").alias("v")))
    wide = rows.groupBy(*keys).agg(cells.alias("_rows"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, gone, done = [], [], []
            for i, items in enumerate(b.column(len(keys)).to_pylist()):
                by: dict[str, dict[str, int]] = {}
                for x in items:
                    if x["v"] is not None and x["m"] is not None:
                        by.setdefault(x["p"], {})[x["m"]] = x["v"]
                sums, searched = rollup_members(by, least_periods, most_members)
                at.append(i)
                gone.append(sorted(sums))
                done.append(searched)
            yield pa.record_batch({k: b.column(j).take(pa.array(at, pa.int64())) for j, k in enumerate(keys)} | {"_gone": pa.array(gone, pa.list_(pa.string())), "searched": pa.array(done, pa.bool_())})

    judged = wide.mapInArrow(run, ", ".join([*[f"{k} {kinds[k]}" for k in keys], "_gone array<string>", "searched boolean"]))
    return rows.join(judged, keys).filter(~F.coalesce(F.array_contains("_gone", F.col(member)), F.lit(False))).drop("_gone")


def collapse_schemes(rows: DataFrame, keys: list[str], member: str, value: str, total: str, most_members: int = 20) -> DataFrame:
    """One scheme of members where several of them each add up to the total; adds ``collapsed`` and ``searched``.

    The members of a key (with the same ``total``) are left as they are unless they fall, all of them, into
    two or more disjoint sets with that sum; then the set with the most members stays, of equals the one
    that comes first by its members' names. Sums are exact in whole units. Keys with more than
    ``most_members`` members aren't searched, which ``searched`` tells.
    """
    kinds = dict(rows.dtypes)
    cells = F.array_sort(F.collect_list(F.struct(F.col(member).alias("m"), F.round(value, 0).cast("bigint").alias("v"))))
    wide = rows.groupBy(*keys).agg(cells.alias("_rows"), F.max(F.round(total, 0).cast("bigint")).alias("_total"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            kept, done = [], []
            for items, t in zip(b.column(len(keys)).to_pylist(), b.column(len(keys) + 1).to_pylist()):
                names, values = [x["m"] for x in items], [x["v"] or 0 for x in items]
                done.append(len(names) <= most_members)
                best = partition_by_sum(values, t) if done[-1] and t else None
                kept.append(None if best is None else [names[i] for i in min(best, key=lambda s: (-len(s), [names[i] or "" for i in s]))])
            yield pa.record_batch({k: b.column(j) for j, k in enumerate(keys)} | {"_kept": pa.array(kept, pa.list_(pa.string())), "searched": pa.array(done, pa.bool_())})

    judged = wide.mapInArrow(run, ", ".join([*[f"{k} {kinds[k]}" for k in keys], "_kept array<string>", "searched boolean"]))
    stays = F.col("_kept").isNull() | F.coalesce(F.array_contains("_kept", F.col(member)), F.lit(False))
    return rows.join(judged, keys).filter(stays).withColumn("collapsed", F.col("_kept").isNotNull()).drop("_kept")


def partition_by_sum(values: list[int], total: int) -> list[list[int]] | None:
    """Places of all values in two or more disjoint sets, each with this sum; None if there are none."""
    if sum(values) == total or total == 0 or sum(values) % total:
        return None

    def rest(left: tuple[int, ...]) -> list[list[int]] | None:
        if not left:
            return []
        # the first place left belongs to some set: try all sets with it
        first, others = left[0], left[1:]
        stack: list[tuple[int, int, tuple[int, ...]]] = [(0, total - values[first], (first,))]
        while stack:
            k, need, taken = stack.pop()
            if need == 0:
                more = rest(tuple(i for i in others if i not in taken))
                if more is not None:
                    return [list(taken), *more]
            if k < len(others):
                stack.append((k + 1, need, taken))
                stack.append((k + 1, need - values[others[k]], (*taken, others[k])))
        return None

    found = rest(tuple(range(len(values))))
    return found if found and len(found) >= 2 else None


def scale_errors(facts: DataFrame, keys: list[str], period: str, value: str) -> DataFrame:
    """Adds ``scale_error``: 1000 or 1000000 where a value is that many times (or that part of) its neighbours'.

    Both neighbours in time must agree with each other and with the factor.
    """
    w = Window.partitionBy(*keys).orderBy(period)
    v = lambda c: F.abs(c.cast("double"))
    a, b, x = v(F.lag(value).over(w)), v(F.lead(value).over(w)), v(F.col(value))
    near = (a > 0) & (b > 0) & (x > 0) & (F.abs(F.log10(a / b)) < 0.7)
    off = F.log10(x / F.sqrt(a * b))
    size = lambda n: F.abs(F.abs(off) - n) < 0.35
    return facts.withColumn("scale_error", F.when(near & size(3), 1_000).when(near & size(6), 1_000_000))


def statement(facts: DataFrame, lines: list[tuple[str, list[str]]], keys: list[str]) -> DataFrame:
    """(keys, line_no, line, concept, value): each line from the first of its concepts that is reported.

    Only facts of each key's latest period count. Facts have concept, period_end and value, one a concept and period.
    """
    spark = facts.sparkSession
    tags = spark.createDataFrame([(i, name, c, k) for i, (name, cs) in enumerate(lines) for k, c in enumerate(cs)], "line_no int, line string, concept string, _rank int")
    newest = F.max("period_end").over(Window.partitionBy(*keys))
    latest = facts.withColumn("_new", newest).filter(F.col("period_end") == F.col("_new"))
    w = Window.partitionBy(*keys, "line_no").orderBy("_rank")
    return latest.join(F.broadcast(tags), "concept").withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").select(*keys, "line_no", "line", "concept", "value")


def margins(revenue: DataFrame, income: DataFrame, keys: list[str]) -> DataFrame:
    """Income over revenue, in percent, where both are there and revenue is positive."""
    j = revenue.select(*keys, F.col("value").alias("revenue")).join(income.select(*keys, F.col("value").alias("income")), keys)
    return j.filter(F.col("revenue") > 0).withColumn("margin", F.round(F.col("income") / F.col("revenue") * 100, 4))


# Numbers as words.
NUMBER_WORDS = {
    "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9", "ten": "10", "eleven": "11", "twelve": "12",
    "fifteen": "15", "twenty": "20", "twenty-five": "25", "thirty": "30", "forty": "40", "fifty": "50", "hundred": "100", "one-half": "0.5", "half": "0.5", "one-third": "0.333333", "one-fourth": "0.25", "one-tenth": "0.1",
}


def depositary_ratio(c: Column) -> Column:
    """Ordinary shares a depositary share stands for, from phrases like "each ADS represents two ordinary shares"."""
    number = r"(\d[\d,]*(?:\.\d+)?|" + "|".join(sorted(NUMBER_WORDS, key=len, reverse=True)) + ")"
    share = r"(?:ads|adr|american\s+depositary\s+(?:share|receipt))"
    pattern = rf"(?:each|one|1)\s+{share}\s+represent(?:s|ing)\s+(?:the\s+right\s+to\s+receive\s+)?{number}\s*(?:\(\d+\)\s*)?(?:of\s+(?:an?|one)\s+)?(?:class\s+\w+\s+)?(?:ordinary|common)"
    said = F.regexp_extract(F.lower(c), pattern, 1)
    words = F.try_element_at(F.create_map(*[F.lit(x) for pair in NUMBER_WORDS.items() for x in pair]), said)
    return F.coalesce(words, F.replace(said, F.lit(","), F.lit(""))).try_cast("decimal(18,6)")


def orient_axes(legs: DataFrame, axis: str, member: str, other_axis: str, other_member: str, wanted: list[str]) -> DataFrame:
    """Facts with two axes seen from each wanted one: a leg whose axis is wanted, and its mirror image."""
    same = legs.filter(F.col(axis).isin(wanted))
    swap = {axis: other_axis, member: other_member, other_axis: axis, other_member: member}
    mirror = legs.filter(F.col(other_axis).isin(wanted)).select(*[F.col(swap.get(c, c)).alias(c) for c in legs.columns])
    return same.unionByName(mirror).distinct()


def combine_payments(payments: DataFrame, keys: list[str], amount: str, source: str, precedence: list[str]) -> DataFrame:
    """One payment a key: the amounts of the preferred source added up; other sources' are left out."""
    rank = F.array_position(F.array(*[F.lit(s) for s in precedence]), F.col(source))
    place = F.when(F.coalesce(rank, F.lit(0)) > 0, rank).otherwise(len(precedence) + 1)
    g = payments.groupBy(*keys, source).agg(F.sum(amount).alias(amount), F.count("*").alias("parts")).withColumn("_p", place)
    w = Window.partitionBy(*keys).orderBy("_p", source)
    return g.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn", "_p")
