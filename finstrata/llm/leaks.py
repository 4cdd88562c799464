"""Passages of held-out items found in a corpus.

Every window of ``WINDOW`` words, of the items and of each whole document, gets a 64-bit SimHash of
its words. Two fingerprints within ``RADIUS`` bits differ in at most ``RADIUS`` of ``RADIUS`` + 2 blocks
of bits, so they agree wholly in at least one pair of blocks; looking windows up by every pair of
blocks and comparing the bits of what is found misses no pair within the radius. A hit is a seed;
around it document and item are aligned word by word, across words that were altered, dropped or
added, and the passage is kept if it is long enough and few of its words differ. Where a document's
words differ from an item but are just what another item says there, they are no alteration: the
document quotes that other item, and the passage ends there. The similarity of its weighted word shingles is checked too (a shingle weighs 1 + 1 / the number of items, of all,
that bear it; at the permitted number of edits that can't fall below ``SIMILARITY``).

The windows are shorter than a passage so that one untouched stretch of a partly altered passage is
enough to seed it: with at most one word in nine altered, a passage of twelve words has an untouched
stretch of five.

Scale: the corpus is read once in full. A Bloom filter of the items' keys, of at most ``FILTER_BITS``
bits whatever the number of items, lets few other windows pass; those are joined to the items' windows
by key. Only documents with a seed are read again, and only the words around seeds go on. Items are
never collected, so their number isn't bounded and what is found doesn't depend on it.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_right
from collections.abc import Iterator
from functools import reduce
from itertools import accumulate, combinations, groupby, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from finstrata.core.tables import checkpoint_dir
from finstrata.llm.lookalike import LETTERS, LIGATURES, character_map

WINDOW = 5
RADIUS = 2
PASSAGE = 12
#: One edit in so many words of a passage is allowed ("at most about one in nine").
WORDS_AN_EDIT = 8
SIMILARITY = 0.5
SHINGLE = 2
#: The largest Bloom filter, and its bits for each key of an item's window where that is less.
FILTER_BITS = 1 << 28
BITS_A_KEY = 64
HASHES = 3
#: Words whose fingerprints are made at a time.
STEP = 100_000

def _fold_table() -> dict[int, str]:
    """Characters to lower-case accent-free letters; the map of looks comes first."""
    out: dict[int, str] = {}
    bare = lambda t: "".join(c for c in unicodedata.normalize("NFKD", t) if unicodedata.category(c) != "Mn").lower()
    for a, b in (character_map() | LIGATURES).items():
        out[ord(a)] = bare(b)
    for cp in range(0x80, 0x3000):
        ch = chr(cp)
        if cp in out:
            continue
        if unicodedata.category(ch) in ("Mn", "Me"):
            out[cp] = ""
            continue
        plain = "".join(c for c in unicodedata.normalize("NFKD", ch) if unicodedata.category(c) != "Mn")
        folded = "".join(LETTERS.get(c, c) for c in plain).lower()
        if folded != ch:
            out[cp] = folded
    return out


_fold: dict[int, str] = {}
_IN_NUMBER = re.compile(r"(?<=[0-9])[.,'](?=[0-9])")
_WORD = re.compile(r"[^\W_]+")


def words(text: str) -> list[str]:
    """Words as they count here: folded, without punctuation; separators inside numbers go."""
    if not _fold:
        _fold.update(_fold_table())
    if not text.isascii():
        text = text.translate(_fold)
    return _WORD.findall(_IN_NUMBER.sub("", text.lower()))


class Vocabulary:
    """Word to 64-bit hash, and to the row of its bits as signs."""

    def __init__(self, most: int = 400_000):
        self.ids: dict[str, int] = {}
        self.most = most
        self.hashes = np.zeros(1024, dtype=np.uint64)

    def rows(self, ws: list[str]) -> np.ndarray:
        if len(self.ids) > self.most:  # bounded memory: ids only have to agree within one call
            self.ids.clear()
        ids = self.ids
        out = np.fromiter(map(ids.get, ws, repeat(-1)), dtype=np.int64, count=len(ws))
        for i in np.flatnonzero(out < 0).tolist():
            w = ws[i]
            r = ids.get(w)
            if r is None:
                r = ids[w] = len(ids)
                if r >= len(self.hashes):
                    self.hashes = np.concatenate([self.hashes, np.zeros_like(self.hashes)])
                self.hashes[r] = word_hash(w)
            out[i] = r
        return out

    def hashes_of(self, ws: list[str]) -> np.ndarray:
        rows = self.rows(ws)
        return self.hashes[rows]


def word_hash(w: str) -> np.uint64:
    return np.uint64(xxhash.xxh64_intdigest(w, 7))


def simhash(hashes: np.ndarray, window: int) -> np.ndarray:
    """SimHash of every window of the words with these hashes: the sign of each bit's sum."""
    n = len(hashes) - window + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    bits = np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    total = bits[:n].copy()
    for j in range(1, window):
        total += bits[j : j + n]
    signs = total > window // 2
    return np.packbits(signs, axis=1, bitorder="little").view("<u8").reshape(-1)


def block_pairs(radius: int) -> list[tuple[tuple[int, int], tuple[int, int]]]:
    """All pairs of (first bit, bits) out of radius + 2 blocks that make up 64 bits."""
    edges = [round(64 * i / (radius + 2)) for i in range(radius + 3)]
    return list(combinations([(a, b - a) for a, b in zip(edges, edges[1:])], 2))


def block_keys(prints: np.ndarray, radius: int) -> np.ndarray:
    """A row of keys a table: the bits of two blocks side by side."""
    cut = lambda first, bits: (prints >> np.uint64(first)) & np.uint64((1 << bits) - 1)
    return np.stack([cut(*one) | (cut(*two) << np.uint64(one[1])) for one, two in block_pairs(radius)]).astype(np.int64)


def _places(keys: np.ndarray, tab: int, bits: int, which: int) -> np.ndarray:
    """The bit of a filter of 2 ** bits bits that a key of a table sets, by one of HASHES hashes."""
    odd = np.uint64((2 * (tab * HASHES + which) + 1) * 0x9E3779B97F4A7C15 % 2**64)
    return ((keys.view(np.uint64) + np.uint64(tab + 1)) * odd) >> np.uint64(64 - bits)


def _passing(prints: np.ndarray, radius: int, bits: int, words_of_filter: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(position, table, key) of the keys that may be an item's."""
    out = []
    for tab, keys in enumerate(block_keys(prints, radius)):
        pos = np.arange(len(keys))
        for which in range(HASHES):
            at = _places(keys[pos], tab, bits, which)
            pos = pos[(words_of_filter[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1) > 0]
        out.append((pos, np.full(len(pos), tab, dtype=np.int32), keys[pos]))
    return tuple(np.concatenate(x) for x in zip(*out))


#: Ways on from a mismatch: words skipped in the document and in the item.
_STEPS = ((1, 1), (1, 0), (0, 1), (2, 2), (1, 2), (2, 1), (2, 0), (0, 2))


def _extend(a: list[str], b: list[str], i: int, j: int, step: int) -> list[tuple[int, int, int, int, int]]:
    """From words that match at (i, j), onwards by ``step``: (item words and edits so far, end of the
    stretch in the document and in the item, its words) after each matched stretch."""
    na, nb, edits, j0 = len(a), len(b), 0, j
    out = []

    def run(x: int, y: int) -> int:
        n = 0
        while 0 <= x < na and 0 <= y < nb and a[x] == b[y]:
            n, x, y = n + 1, x + step, y + step
        return n

    n = run(i, j)
    matched = 0
    while True:
        i, j, matched = i + n * step, j + n * step, matched + n
        out.append((abs(j - j0), edits, i, j, n))
        best = (0, 0, 0, 0)
        for da, db in _STEPS:
            n = run(i + da * step, j + db * step)
            cost = max(da, db)
            if n and (n - 2 * cost, -cost) > (best[0] - 2 * best[1], -best[1]) and (n >= 2 or cost == 1):
                best = (n, cost, da, db)
        if not best[0] or (best[0] == 1 and edits + 1 > 1 + matched // WORDS_AN_EDIT):
            return out
        n, cost, da, db = best
        i, j, edits = i + da * step, j + db * step, edits + cost


def passage(doc: list[str], item: list[str], i: int, j: int, least: int, words_an_edit: int) -> list[tuple[int, int, int, int, int]] | None:
    """The longest passage through the match at (i, j) with few enough edits, as its matched stretches:
    (document from, to, item from, to, edits since the stretch before)."""
    right = _extend(doc, item, i, j, 1)
    left = _extend(doc, item, i - 1, j - 1, -1)
    best = None
    for x, (ln, le, *_) in enumerate(left):
        for y, (rn, re_, *_) in enumerate(right):
            if ln + rn >= least and (le + re_) * words_an_edit <= ln + rn and (best is None or ln + rn > best[0]):
                best = (ln + rn, x, y)
    if best is None:
        return None
    _, x, y = best
    out = []
    for k in range(x, 0, -1):
        _, _, p, q, n = left[k]
        out.append([p + 1, p + 1 + n, q + 1, q + 1 + n, left[k + 1][1] - left[k][1] if k < x else 0])
    before = left[1][1] - left[0][1] if x else 0
    out.append([left[0][2] + 1, right[0][2], left[0][3] + 1, right[0][3], before])
    for k in range(1, y + 1):
        _, e, p, q, n = right[k]
        out.append([p - n, p, q - n, q, e - right[k - 1][1]])
    return [tuple(r) for r in out]


def longest_part(stretches: list, splits: set[int], least: int, words_an_edit: int) -> tuple[int, int] | None:
    """(item words, edits) of the longest run of stretches that crosses no split and has few enough edits."""
    best = None
    for x in range(len(stretches)):
        edits = 0
        for y in range(x, len(stretches)):
            if y > x:
                if y in splits:
                    break
                edits += stretches[y][4]
            n = stretches[y][3] - stretches[x][2]
            if n >= least and edits * words_an_edit <= n and (best is None or n > best[0]):
                best = (n, edits)
    return best


def _similar(item: list[str], counts: list[int], span: tuple[int, int], doc: list[str], i: int, j: int) -> float:
    """Share of the weight of the passage's shingles that the document has near by."""
    lo, hi = span
    inside = {tuple(item[k : k + SHINGLE]): 1 + 1 / counts[k] for k in range(lo, hi - SHINGLE + 1)}
    a, b = max(0, i - (j - lo) - 8), i + (hi - j) + 8
    there = {tuple(doc[k : k + SHINGLE]) for k in range(a, min(b, len(doc)) - SHINGLE + 1)}
    total = sum(inside.values())
    return sum(w for s, w in inside.items() if s in there) / total if total else 0.0


def _windows(items: DataFrame, window: int) -> DataFrame:
    """(i, at, n, print, shingle): every word of every item, with the window and the shingle that begin there if any do."""
    kind = dict(items.dtypes)["i"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = Vocabulary()
        for batch in batches:
            for k, text in enumerate(batch.column(1).to_pylist()):
                ws = words(text)
                n = len(ws)
                if not n:
                    continue
                h = vocabulary.hashes_of(ws)
                prints = simhash(h, window)
                shingles = [xxhash.xxh64_intdigest(" ".join(ws[a : a + SHINGLE])) - 2**63 for a in range(n - SHINGLE + 1)]
                pad = lambda x, m: np.arange(n) >= m
                fill = np.zeros(n, dtype=np.int64)
                fill[: len(prints)] = prints.view(np.int64)
                more = np.zeros(n, dtype=np.int64)
                more[: len(shingles)] = shingles
                yield pa.record_batch({
                    "i": batch.column(0).take(pa.array(np.full(n, k))), "at": pa.array(np.arange(n), pa.int32()), "n": pa.array(np.full(n, n), pa.int32()),
                    "print": pa.array(fill, mask=pad(fill, len(prints))), "shingle": pa.array(more, mask=pad(more, len(shingles))),
                })

    return items.select("i", "t").mapInArrow(run, f"i {kind}, at int, n int, print bigint, shingle bigint")


def _keyed(windows: DataFrame, radius: int) -> DataFrame:
    """(tab, key) of every window with a fingerprint, beside its columns."""
    cut = lambda first, bits: F.shiftrightunsigned("print", first).bitwiseAND(F.lit((1 << bits) - 1))
    keys = [cut(*one).bitwiseOR(F.shiftleft(cut(*two), one[1])) for one, two in block_pairs(radius)]
    return windows.filter(F.col("print").isNotNull()).select("*", F.posexplode(F.array(*keys)).alias("tab", "key"))


def _key_filter(keyed: DataFrame, bits: int) -> np.ndarray:
    """The Bloom filter of all keys: the driver gets no more than its 2 ** bits bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tab, key = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for t in np.unique(tab).tolist():
                at = np.unique(np.concatenate([_places(key[tab == t], t, bits, w) for w in range(HASHES)]))
                yield pa.record_batch({"word": pa.array((at >> np.uint64(6)).astype(np.int64)), "bit": pa.array((np.uint64(1) << (at & np.uint64(63))).view(np.int64))})

    found = keyed.select("tab", "key").distinct().mapInArrow(run, "word bigint, bit bigint").groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()
    out = np.zeros(1 << max(bits - 6, 0), dtype=np.uint64)
    out[found.column("word").to_numpy()] = found.column("bits").to_numpy().view(np.uint64)
    return out


def _spots(rows: DataFrame, shared, window: int, radius: int) -> DataFrame:
    """(d, pos, print, tab, key): the documents' windows whose key passes the filter."""
    kind = dict(rows.dtypes)["d"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, (bits, table) = Vocabulary(), shared.value
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            for a in range(0, batch.num_rows, 500):
                some = [words(t) for t in texts.slice(a, 500).to_pylist()]
                n = np.array([len(ws) for ws in some])
                first = np.cumsum(n) - n
                flat = [w for ws in some for w in ws]
                for c in range(0, len(flat), STEP):  # bounded memory, however long a text is
                    prints = simhash(vocabulary.hashes_of(flat[c : c + STEP + window - 1]), window)
                    pos, tab, key = _passing(prints, radius, bits, table)
                    doc = np.searchsorted(first, pos + c, "right") - 1
                    ok = pos + c + window <= (first + n)[doc]  # not across two documents
                    pos, tab, key, doc = pos[ok], tab[ok], key[ok], doc[ok]
                    if len(pos):
                        yield pa.record_batch({
                            "d": ids.take(pa.array(doc + a)), "pos": pa.array((pos + c - first[doc]).astype(np.int32)),
                            "print": pa.array(prints[pos].view(np.int64)), "tab": pa.array(tab), "key": pa.array(key),
                        })

    return rows.mapInArrow(run, f"d {kind}, pos int, print bigint, tab int, key bigint")


def join_near(spots: DataFrame, keyed: DataFrame, radius: int) -> DataFrame:
    """(d, pos, i, at, n): pairs of windows within the radius, each once: at the first pair of blocks they agree in."""
    theirs = keyed.select("i", "at", "n", F.col("print").alias("p2"), "tab", "key")
    apart = F.col("print").bitwiseXOR(F.col("p2"))
    masks = [((1 << a[1]) - 1) << a[0] | ((1 << b[1]) - 1) << b[0] for a, b in block_pairs(radius)]
    signed = lambda m: m - (1 << 64) if m >> 63 else m
    before = [(F.col("tab") > t) & (apart.bitwiseAND(F.lit(signed(m)).cast("bigint")) == 0) for t, m in enumerate(masks)]
    return spots.join(theirs, ["tab", "key"]).filter((F.bit_count(apart) <= radius) & ~reduce(lambda x, y: x | y, before)).select("d", "pos", "i", "at", "n")


def _around(docs: DataFrame, ikind: str, window: int) -> DataFrame:
    """(d, i, lo, ws, pos, at): the words of a document from lo on around the seeds of one item; seeds far apart make rows of their own."""
    kind = dict(docs.dtypes)["d"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0)
            for k, (text, seeds) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())):
                ws, rows = words(text), []
                for i, its in groupby(sorted(((x["i"], x["pos"], x["at"], x["n"]) for x in seeds), key=lambda x: (str(x[0]), x[1])), key=lambda x: x[0]):
                    group: list = []
                    for _, pos, at, n in its:
                        reach = n + n // WORDS_AN_EDIT + 16
                        if group and pos - group[-1][0] > 2 * reach:
                            rows.append((i, group, reach))
                            group = []
                        group.append((pos, at))
                    rows.append((i, group, reach))
                for i, group, reach in rows:
                    lo = max(0, group[0][0] - reach)
                    yield pa.record_batch({
                        "d": ids.slice(k, 1), "i": pa.array([i], _arrow(ikind)), "lo": pa.array([lo], pa.int32()), "ws": pa.array([" ".join(ws[lo : group[-1][0] + window + reach])]),
                        "pos": pa.array([[p - lo for p, _ in group]], pa.list_(pa.int32())), "at": pa.array([[q for _, q in group]], pa.list_(pa.int32())),
                    })

    return docs.mapInArrow(run, f"d {kind}, i {ikind}, lo int, ws string, pos array<int>, at array<int>")


def _arrow(kind: str) -> pa.DataType:
    return pa.string() if kind == "string" else pa.int64() if kind == "bigint" else pa.int32()


_STRETCHES = "array<struct<a:int,b:int,ia:int,ib:int,e:int>>"


def _aligned(rows: DataFrame, window: int, least: int, words_an_edit: int, similarity: float) -> DataFrame:
    """(d, i, stretches): the passages at each row's seeds, each as its matched stretches."""
    kinds = dict(rows.dtypes)
    kind = pa.list_(pa.struct([(c, pa.int32()) for c in ("a", "b", "ia", "ib", "e")]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lo, ws, pos, at, text, counts = (batch.column(c).to_pylist() for c in ("lo", "ws", "pos", "at", "t", "counts"))
            hit, told = [], []
            for k in range(batch.num_rows):
                a, b, seen = ws[k].split(" "), words(text[k]), set()
                for i, j in zip(pos[k], at[k]):
                    # a seed may be within the radius without its words being equal: start where words match
                    start = next((s for s in range(window) if a[i + s] == b[j + s]), None)
                    found = None if start is None else passage(a, b, i + start, j + start, least, words_an_edit)
                    if found and tuple(found) not in seen and _similar(b, counts[k], (found[0][2], found[-1][3]), a, i, j) >= similarity:
                        seen.add(tuple(found))
                        hit.append(k)
                        told.append([dict(zip(("a", "b", "ia", "ib", "e"), (x + lo[k], y + lo[k], *z))) for x, y, *z in found])
            take = pa.array(hit, pa.int64())
            yield pa.record_batch({"d": batch.column("d").take(take), "i": batch.column("i").take(take), "stretches": pa.array(told, kind)})

    return rows.mapInArrow(run, f"d {kinds['d']}, i {kinds['i']}, stretches {_STRETCHES}")


def own_words(passages: list[tuple], least: int, words_an_edit: int) -> dict:
    """By item, (item words, edits) of the longest part of a document's passages, given as (item,
    stretches), none of whose edits is what another item says there."""
    said: dict[tuple[int, int], set] = {}
    for i, stretches in passages:
        for a, b, *_ in stretches:
            said.setdefault((a, b), set()).add(i)
    spans, out = sorted(said), {}
    ends = list(accumulate((b for _, b in spans), max))
    for i, stretches in passages:
        splits = set()
        for k in range(1, len(stretches)):
            lo, hi = stretches[k - 1][1] - 1, stretches[k][0] + 1
            at = bisect_right(spans, (lo, 1 << 62)) - 1
            while at >= 0 and ends[at] >= hi:
                if spans[at][1] >= hi and said[spans[at]] != {i}:
                    splits.add(k)
                    break
                at -= 1
        best = longest_part(stretches, splits, least, words_an_edit)
        if best and (i not in out or best[0] > out[i][0]):
            out[i] = best
    return out


def _own_words(found: DataFrame, least: int, words_an_edit: int) -> DataFrame:
    """(d, i, n, e) of each document's passages, judged side by side."""
    kinds = dict(found.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, rows in enumerate(batch.column(1).to_pylist()):
                got = own_words([(x["i"], [tuple(y.values()) for y in x["stretches"]]) for x in rows], least, words_an_edit)
                yield pa.record_batch({
                    "d": batch.column(0).take(pa.array(np.full(len(got), k))), "i": pa.array(list(got), _arrow(kinds["i"])),
                    "n": pa.array([n for n, _ in got.values()], pa.int32()), "e": pa.array([e for _, e in got.values()], pa.int32()),
                })

    by_doc = found.groupBy("d").agg(F.collect_list(F.struct("i", "stretches")).alias("rows"))
    return by_doc.mapInArrow(run, f"d {kinds['d']}, i {kinds['i']}, n int, e int")


def leaked_items(
    docs: DataFrame, items: DataFrame, window: int = WINDOW, radius: int = RADIUS, least: int = PASSAGE,
    words_an_edit: int = WORDS_AN_EDIT, similarity: float = SIMILARITY, filter_bits: int = FILTER_BITS,
    doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text",
) -> DataFrame:
    """(doc_id, item_id, n_words, n_edits): documents that hold a passage of an item.

    Null texts and ids hold nothing. An item given twice counts once with its longest text; a
    document given twice is reported once, with its longest passage. Ids are int, bigint or string.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(doc_id).alias("d"), F.col(text).alias("t")).filter(F.col("d").isNotNull() & F.col("t").isNotNull())
    given = (
        items.select(F.col(item_id).alias("i"), F.col(item_text).alias("t")).filter(F.col("i").isNotNull() & F.col("t").isNotNull())
        .groupBy("i").agg(F.max_by("t", F.struct(F.length("t"), "t")).alias("t"))
    )
    # what is known of the items' words is used by several steps: cut here, so that texts are split once
    checkpoint_dir(spark)
    windows = _windows(given, window).checkpoint()
    keyed = _keyed(windows, radius)
    most = max(windows.filter(F.col("print").isNotNull()).count(), 1) * len(block_pairs(radius)) * BITS_A_KEY
    bits = max(6, (min(most, filter_bits) - 1).bit_length())
    shared = spark.sparkContext.broadcast((bits, _key_filter(keyed, bits)))
    near = join_near(_spots(rows, shared, window, radius), keyed, radius)
    # successive seeds on one diagonal are one: its first
    line = Window.partitionBy("d", "i", F.col("pos") - F.col("at")).orderBy("pos")
    seeds = near.distinct().withColumn("_last", F.lag("pos").over(line)).filter(F.col("_last").isNull() | (F.col("_last") < F.col("pos") - 1))
    by_doc = seeds.groupBy("d").agg(F.collect_list(F.struct("i", "pos", "at", "n")).alias("seeds"))
    ikind = dict(given.dtypes)["i"]
    some = _around(rows.join(by_doc, "d").select("d", "t", "seeds"), ikind, window)
    shingles = windows.filter(F.col("shingle").isNotNull()).select("i", "at", "shingle")
    often = shingles.groupBy("shingle").agg(F.countDistinct("i").alias("c"))
    counts = shingles.join(often, "shingle").groupBy("i").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "c"))), lambda x: x["c"]).alias("counts"))
    found = _own_words(_aligned(some.join(given.join(counts, "i"), "i"), window, least, words_an_edit, similarity), least, words_an_edit)
    return found.select(F.col("d").alias(doc_id), F.col("i").alias(item_id), F.col("n").alias("n_words"), F.col("e").alias("n_edits"))
