"""Matching records of two tables that share no key.

1. Graph. A record is tied to its attributes (its name, its identifiers), an attribute to its
   tokens: words, and identifiers, which count wherever they stand, since filers mix up columns.
2. Random walks. A walk goes from a record over an attribute to one of its tokens (rare ones are
   likelier), on to another record with that token, and so on for ``STEPS`` records. All records walk at
   once: for each step every record draws a token, and with it a neighbour at that token; frequent
   tokens are salted to groups of at most ``MEET`` records, in which the neighbour is the next one.
3. Skip-gram. Tokens and attributes on a walk predict each other, with negative samples. A token's
   vector is the mean of its character n-grams' rows in a table of fixed size, so that a misspelt or
   abbreviated word lies near the one meant and the model has a proven size. Models train
   from the same start on the walks of some ``WALKERS`` records each; their tables are averaged by use.
4. Blocking, both tables in one. Name vectors are cut by random hyperplanes into several tables of
   keys; the left side also looks into the buckets across its narrowest planes; pairs whose sketches
   (128 more planes) differ too much to be near are left out at once, then those whose names aren't near. Records that share an identifier
   or a telling word (adjacent words without their blank too) meet by equality: at the token where at
   most ``OFTEN`` right records bear it, else at pairs of such tokens, else at the whole core of the name.
   Buckets hold distinct names and are salted.
5. Rerank. Candidates are compared exactly: identifiers that agree, and names word by word
   (abbreviations, one slip of the pen a word, a lost or added blank, cut ends, any order). The record that most of the
   evidence supports is the match if no other has as much.
6. Confidence. A logistic on the cosine of name vectors, the name level and the identifiers that agree
   and that don't, fitted to candidates (at most ``CALIBRATION`` of them) whose first identifier, which
   is kept from the features, settles the question; records whose identifiers contradict each other don't.

Repeated left records (same name and identifiers) are matched once.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from finstrata.core.tables import checkpoint_dir, shuffle_partitions
from finstrata.llm.lookalike import plain_form

BUCKETS = 1 << 15  # rows of the n-gram table
DIM = 32
MEET = 128  # records that can meet at one salt of a token
WALKS, STEPS = 2, 3  # walks from each record, and records on each
NEGATIVES = 4
TABLES = 24
WALKERS = 4000  # records for which one more model trains, in a partition of its own as long as there are any
PROBES = 3  # buckets across the narrowest planes that the left side looks into
SKETCH_APART = 40  # of the 128 bits of two sketches; at a cosine of 0.55 they differ in 40 on average
OFTEN = 32  # right records that may meet at one token
SALTS = 4  # parts into which the left records of a bucket are cut
NEAR = 0.6  # cosine from which names that share no token are compared
CALIBRATION = 20_000
#: A word is common if one record in so many bears it (and at least COMMON_LEAST do).
COMMON_SHARE = 200
COMMON_LEAST = 30
#: A word tells sister firms apart if one right record in so many bears it (and KIND_LEAST do).
KIND_SHARE = 50
KIND_LEAST = 4
#: Words that a partition's model keeps the n-grams of at a time.
MOST_WORDS = 500_000
#: Least digits of an identifier; shorter ones are fillers.
ID_DIGITS = 6

# Legal forms, which say nothing about who a firm is.
LEGAL = {
    "sa", "lp", "llc", "llp", "ltd", "limited", "inc", "incorporated", "corp", "corporation", "gmbh", "na", "national",
    "association", "partnership", "plc", "ag", "nv", "bv", "spa", "kg", "liability",
}


def identifier(c: Column) -> Column:
    """Digits without leading zeros, or null for what is too short to identify anything."""
    digits = F.regexp_replace(F.regexp_replace(c, "[^0-9]", ""), "^0+", "")
    return F.when(F.length(digits) >= ID_DIGITS, digits)


def name_key(c: Column) -> Column:
    """A name in lower case with single blanks and without points; the empty string for null."""
    plain = F.regexp_replace(F.lower(plain_form(F.coalesce(c, F.lit("")))), r"[\[(][^\])]*[\])]|\bet al\b\.?", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(plain, r"[.']", ""), r"[^\p{L}\p{N}/-]+", " "))


_TAIL = re.compile(r"(?: - ([a-z0-9]{2})| /[a-z]+/?)$")


def name_words(key: str) -> tuple[list[str], str]:
    """(words without legal forms, the place that ends a name like "x y - ny")."""
    place = ""
    m = _TAIL.search(key)
    while m:
        place = m.group(1) or place
        key = key[: m.start()]
        m = _TAIL.search(key)
    ws = [w for w in re.split(r"[^0-9a-zà-￿]+", key) if w]
    kept = [w for i, w in enumerate(ws) if w not in LEGAL and not (w in ("co", "company") and i and ws[i - 1] == "liability")]
    while len(kept) > 1 and len(kept[-1]) == 1:
        kept.pop()
    return kept, place


def _grams(token: str) -> list[int]:
    if token[0].isdigit():  # an identifier is whole or nothing
        return [xxhash.xxh32_intdigest(token, s) % BUCKETS for s in (1, 2)]
    w = f"<{token}>"
    parts = [w[i : i + n] for n in (3, 4) for i in range(len(w) - n + 1)] + [w]
    return [xxhash.xxh32_intdigest(p, 0) % BUCKETS for p in parts]


def start_table() -> np.ndarray:
    """Where all partitions start: rows of random directions."""
    return np.random.default_rng(11).standard_normal((BUCKETS, DIM)).astype(np.float32) / math.sqrt(DIM)


def _merged(df: DataFrame) -> DataFrame:
    """To be joined by sorting and merging. Spark's guess of a size ignores that a step multiplies rows (96 buckets
    a name, a row a token) and that files are compressed; by it tables that grow with the input were broadcast,
    which the driver has to hold whole."""
    return df.hint("merge")


class SkipGram:
    """Skip-gram with negative sampling over n-gram rows, trained in batches."""

    def __init__(self, rate: float = 0.2):
        self.v, self.c = start_table(), np.zeros((BUCKETS, DIM), dtype=np.float32)
        self.used = np.zeros(BUCKETS, dtype=np.int64)
        self.rate, self.rng = rate, np.random.default_rng(5)
        self.known: dict[str, int] = {}
        self.grams = np.zeros(1 << 16, dtype=np.int32)  # the n-grams of all words, one after the other
        self.first = np.zeros(1 << 12, dtype=np.int64)  # where a word's begin
        self.size = np.zeros(1 << 12, dtype=np.int64)
        self.end = 0

    def ids(self, tokens: list[str]) -> np.ndarray:
        if len(self.known) > MOST_WORDS:  # bounded memory: numbers only have to agree within one call
            self.known.clear()
            self.end = 0
        for t in tokens:
            if t in self.known:
                continue
            g, k = _grams(t), len(self.known)
            if self.end + len(g) > len(self.grams):
                self.grams = np.concatenate([self.grams, np.zeros(max(len(self.grams), len(g)), dtype=np.int32)])
            if k == len(self.first):
                self.first, self.size = np.concatenate([self.first, self.first]), np.concatenate([self.size, self.size])
            self.grams[self.end : self.end + len(g)] = g
            self.first[k], self.size[k] = self.end, len(g)
            self.known[t] = k
            self.end += len(g)
        return np.array([self.known[t] for t in tokens], dtype=np.int64)

    def vector(self, token: str) -> np.ndarray:
        return self.v[_grams(token)].mean(0)

    def train(self, center: np.ndarray, context: np.ndarray, batch: int = 8192) -> None:
        """Batches of pairs; gradients are summed by word before they are spread over its n-grams."""
        for a in range(0, len(center), batch):
            x, y = center[a : a + batch], context[a : a + batch] % BUCKETS
            ws, at = np.unique(x, return_inverse=True)
            n = self.size[ws]
            start = np.cumsum(n) - n
            g = self.grams[np.repeat(self.first[ws] - start, n) + np.arange(n.sum())]
            share = (1.0 / n).astype(np.float32)[:, None]
            h = (np.add.reduceat(self.v[g], start, axis=0) * share)[at]
            out = np.concatenate([y[:, None], self.rng.choice(y, (len(x), NEGATIVES))], axis=1)
            c = self.c[out]
            score = 1 / (1 + np.exp(-np.matmul(c, h[:, :, None])[:, :, 0]))
            score[:, 0] -= 1
            step = (-self.rate * score).astype(np.float32)
            dh = np.matmul(step[:, None, :], c)[:, 0, :]
            _add_means(self.c, out.reshape(-1), (step[:, :, None] * h[:, None, :]).reshape(-1, DIM))
            by_word = np.zeros((len(ws), DIM), dtype=np.float32)
            _add_means(by_word, at, dh)
            _add_means(self.v, g, np.repeat(by_word * share, n, axis=0))
            self.used += np.bincount(g, np.repeat(np.bincount(at, minlength=len(ws)), n), BUCKETS).astype(np.int64)


def _add_means(to: np.ndarray, at: np.ndarray, rows: np.ndarray) -> None:
    """Adds to each place the mean of its rows: a word that fills a batch moves no further than a rare one."""
    order = np.argsort(at, kind="stable")
    sorted_at = at[order]
    first = np.flatnonzero(np.concatenate(([True], sorted_at[1:] != sorted_at[:-1])))
    n = np.diff(np.append(first, len(at)))[:, None].astype(np.float32)
    to[sorted_at[first]] += np.add.reduceat(rows[order], first, axis=0) / n


@dataclass
class Model:
    """The n-gram table and the common words with their weights; both of proven size."""

    table: np.ndarray
    common: dict[str, float] = field(default_factory=dict)
    kinds: frozenset[str] = frozenset()

    def __post_init__(self):
        self._words: dict[str, np.ndarray] = {}
        self._kind: dict[str, bool] = {}

    def word(self, w: str) -> np.ndarray:
        got = self._words.get(w)
        if got is None:
            if len(self._words) > 200_000:
                self._words.clear()
            x = self.table[_grams(w)].mean(0)
            got = self._words[w] = x / max(float(np.linalg.norm(x)), 1e-9)
        return got

    def weight(self, w: str) -> float:
        return self.common.get(w, 1.0)

    def core(self, key: str) -> list[str]:
        """The words of a name that don't stand for a kind of firm, if there are any."""
        ws, _ = name_words(key)
        return [w for w in ws if not self.of_kind(w)] or ws

    def joined(self, key: str) -> list[str]:
        """Adjacent words of a name without their blank, unless both stand for a kind of firm."""
        ws, _ = name_words(key)
        return [a + b for a, b in zip(ws, ws[1:]) if not (self.of_kind(a) and self.of_kind(b))]

    def of_kind(self, w: str) -> bool:
        got = self._kind.get(w)
        if got is None:
            if len(self._kind) > 200_000:
                self._kind.clear()
            got = self._kind[w] = w in self.kinds or any(_short_for(w, k) or (len(w) > 3 and _one_slip(w, k)) for k in self.kinds)
        return got

    def name(self, key: str) -> np.ndarray | None:
        ws = self.core(key)
        if not ws:
            return None
        x = sum(self.weight(w) * self.word(w) for w in ws)
        n = float(np.linalg.norm(x))
        return x / n if n > 1e-6 else None


def _frequent_words(records: DataFrame, least: float) -> dict[str, int]:
    """Words that at least so many names bear; for a share of all names, a bounded number."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ws = [w for k in b.column(0).to_pylist() for w in dict.fromkeys(name_words(k)[0])]
            yield pa.record_batch({"w": pa.array(ws, pa.string())})

    counts = records.select("name").mapInArrow(each, "w string").groupBy("w").count()
    return {r["w"]: r["count"] for r in counts.filter(F.col("count") >= least).collect()}


def random_walks(records: DataFrame) -> DataFrame:
    """(rec, walk, bags, attrs, meets): the tokens of the records on each walk, and between them the
    attribute and the token at which it went on. A record without tokens walks nowhere."""

    def nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: dict[str, list] = {"rec": [], "attr": [], "tok": [], "bag": []}
            for k, i in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                words_, ids_ = dict.fromkeys(name_words(k)[0]), dict.fromkeys(i or [])
                bag = " ".join([*words_, *ids_])
                rec = xxhash.xxh64_intdigest(f"{k}|{bag}") - (1 << 63)
                for attr, ts in (("@name", words_), ("@identifier", ids_)):
                    for t in ts:
                        for c, v in zip(out, (rec, attr, t, bag)):
                            out[c].append(v)
                        bag = None  # it travels with the record's first token only
            yield pa.record_batch({c: pa.array(v, pa.int64() if c == "rec" else pa.string()) for c, v in out.items()})

    checkpoint_dir(records.sparkSession)
    tied = records.select("name", "ids").mapInArrow(nodes, "rec bigint, attr string, tok string, bag string").dropDuplicates(["rec", "attr", "tok"]).checkpoint()
    sizes = tied.groupBy("tok").agg(F.count("*").alias("n"))
    salted = tied.join(_merged(sizes), "tok").withColumn("salt", F.pmod(F.xxhash64("rec", "tok"), F.ceil(F.col("n") / MEET)).cast("int"))
    group = Window.partitionBy("tok", "salt")
    turn = F.xxhash64("rec", F.lit(1))
    near = salted.withColumn("next", F.coalesce(F.lead("rec").over(group.orderBy(turn, "rec")), F.first("rec").over(group.orderBy(turn, "rec"))))
    # a draw by weight 1 / n: the least of exponential waiting times
    wait = lambda k: F.log((F.pmod(F.xxhash64("rec", "tok", F.lit(k)), F.lit(1 << 30)) + 1) / float(1 << 30)) * -F.col("n")
    draws = [F.min_by(F.struct("attr", "tok", "next"), F.struct(wait(k), F.col("tok"))).alias(f"d{k}") for k in range(WALKS * (STEPS - 1))]
    drawn = near.groupBy("rec").agg(F.max("bag").alias("bag"), *draws).checkpoint()  # each step joins it again
    at = lambda w, k: f"d{w * (STEPS - 1) + k}"
    steps = drawn.select("rec", F.posexplode(F.array(*[F.struct("bag", F.array(*[F.col(at(w, k)) for k in range(STEPS - 1)]).alias("go")) for w in range(WALKS)])).alias("walk", "s")).select("rec", "walk", "s.bag", "s.go")
    # the walk stands at ``stand``; each further record brings its own draw for its place on the walk
    out = steps.select("rec", "walk", F.array("bag").alias("bags"), F.array(F.col("go")[0]["attr"]).alias("attrs"), F.array(F.col("go")[0]["tok"]).alias("meets"), F.col("go")[0]["next"].alias("stand"))
    for k in range(1, STEPS):
        there = steps.select(F.col("rec").alias("stand"), "walk", F.col("bag").alias("_bag"), F.col("go").alias("_go"))
        out = out.join(_merged(there), ["stand", "walk"])
        more = lambda c, x: F.array_append(c, x)
        last = k == STEPS - 1
        go = F.col("_go")[min(k, STEPS - 2)]
        out = out.select(
            "rec", "walk", more("bags", F.col("_bag")).alias("bags"), (F.col("attrs") if last else more("attrs", go["attr"])).alias("attrs"),
            (F.col("meets") if last else more("meets", go["tok"])).alias("meets"), go["next"].alias("stand"),
        )
    return out.drop("stand")


def train_model(records: DataFrame, total: int, kinds: frozenset[str] = frozenset()) -> Model:
    """``records``: (name, ids) of both sides, each as often as it is distinct."""
    counts = _frequent_words(records, max(total / COMMON_SHARE, COMMON_LEAST))
    common = {w: max(0.05, math.log(total / n) / math.log(2 * COMMON_SHARE)) for w, n in counts.items()}

    walks = random_walks(records)
    parts = max(1, min(shuffle_partitions(records.sparkSession), math.ceil(total / WALKERS)))
    shuffled = walks.repartition(parts, "rec").sortWithinPartitions("rec", "walk")

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net, rng, walked = SkipGram(), np.random.default_rng(3), 0
        used, moved = np.zeros(BUCKETS, dtype=np.int64), np.zeros((BUCKETS, DIM), dtype=np.float32)

        def add() -> None:
            nonlocal used, moved
            used, moved = used + net.used, moved + net.used[:, None] * net.v

        for b in batches:
            if walked >= WALKERS * WALKS:  # a model that trains on more is drawn to one direction, and all names to one bucket
                add()
                net, walked = SkipGram(), 0
            walked += b.num_rows
            centers: list[str] = []
            contexts: list[str] = []
            for bags, attrs, meets in zip(*(b.column(c).to_pylist() for c in ("bags", "attrs", "meets"))):
                here = [t for t in bags[0].split(" ") if t]
                for k, (attr, meet) in enumerate(zip(attrs, meets)):
                    there = [t for t in bags[k + 1].split(" ") if t]
                    draw = rng.integers(len(there), size=len(here)).tolist()
                    for w, at in zip(here, draw):
                        centers += [w, w, there[at]]
                        contexts += [meet, there[at], w]
                    centers += [meet, attr]
                    contexts += [attr, meet]
                    here = there
            if centers:
                net.train(net.ids(centers), net.ids(contexts))
        add()
        hit = np.flatnonzero(used)
        for a in range(0, len(hit), 5000):
            h = hit[a : a + 5000]
            yield pa.record_batch({
                "bucket": pa.array(h, pa.int32()), "n": pa.array(used[h], pa.int64()),
                "v": pa.FixedSizeListArray.from_arrays(pa.array((moved[h] / used[h, None]).astype(np.float32).reshape(-1), pa.float32()), DIM).cast(pa.list_(pa.float32())),
            })

    trained = shuffled.mapInArrow(walk, "bucket int, n bigint, v array<float>")
    average = trained.groupBy("bucket").agg(
        *[(F.sum(F.col("n") * F.col("v")[i]) / F.sum("n")).cast("float").alias(f"x{i}") for i in range(DIM)]
    )
    table = start_table()
    for r in average.collect():  # at most BUCKETS rows
        table[r[0]] = r[1:]
    return Model(table, common, kinds)


def _planes(bits: int) -> np.ndarray:
    return np.random.default_rng(17).standard_normal((TABLES, bits, DIM)).astype(np.float32)


def _bucket_keys(df: DataFrame, model, bits: int, probes: int) -> DataFrame:
    """(rid, key, s0, s1): the buckets of each record's name vector, in which a key tells the table too, and its sketch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, planes = model.value, _planes(bits)
        flat, powers = planes.reshape(-1, DIM), (1 << np.arange(bits)).astype(np.int64)
        more = np.random.default_rng(19).standard_normal((128, DIM)).astype(np.float32)
        for b in batches:
            vecs = [(i, x) for i, x in enumerate(m.name(k) for k in b.column(1).to_pylist()) if x is not None]
            if not vecs:
                continue
            x = np.stack([v for _, v in vecs])
            side = (x @ flat.T).reshape(len(vecs), TABLES, bits)
            base = ((side > 0) * powers).sum(2)
            found = [base]
            if probes:
                near = np.argsort(np.abs(side), axis=2)[:, :, :probes]
                found += [base ^ powers[near[:, :, j]] for j in range(probes)]
            keys = np.stack(found, axis=2)  # record, table, probe
            n = keys.shape[2]
            sketch = np.packbits(x @ more.T > 0, axis=1).view("<i8").reshape(-1, 2)
            each = TABLES * n
            yield pa.record_batch({
                "rid": b.column(0).take(pa.array(np.repeat([i for i, _ in vecs], each))),
                "key": pa.array((keys * TABLES + np.arange(TABLES)[:, None]).reshape(-1), pa.int64()), "s0": pa.array(np.repeat(sketch[:, 0], each), pa.int64()), "s1": pa.array(np.repeat(sketch[:, 1], each), pa.int64()),
            })

    kind = dict(df.dtypes)["rid"]
    return df.select("rid", "name").mapInArrow(run, f"rid {kind}, key bigint, s0 bigint, s1 bigint")


def _tokens(df: DataFrame, model) -> DataFrame:
    """(rid, toks, core): the tokens of each record, identifiers and core words, as a set; and the core as one key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        for b in batches:
            names, ids = b.column(1).to_pylist(), b.column(2).to_pylist()
            cores = [m.core(k) for k in names]
            toks = [list(dict.fromkeys([*(i or []), *c, *m.joined(k)])) for k, i, c in zip(names, ids, cores)]
            yield pa.record_batch({"rid": b.column(0), "toks": pa.array(toks, pa.list_(pa.string())), "core": pa.array([" ".join(sorted(c)) for c in cores])})

    kind = dict(df.dtypes)["rid"]
    return df.select("rid", "name", "ids").mapInArrow(run, f"rid {kind}, toks array<string>, core string")


def _candidates(signatures: DataFrame, rs: DataFrame, model, bits: int) -> DataFrame:
    """(lid, rid, shared): pairs that meet in a bucket and whose sketches are near, or that share a token."""
    # buckets hold names, not records: a name that many records bear is looked up once
    names = lambda df: df.select(F.xxhash64("name").alias("rid"), "name").filter(F.col("name") != "").dropDuplicates(["rid"]).repartition(shuffle_partitions(df.sparkSession))
    lk = _bucket_keys(names(signatures), model, bits, PROBES).withColumnsRenamed({"rid": "ln", "s0": "t0", "s1": "t1"}).withColumn("key", F.col("key") * SALTS + F.pmod("ln", F.lit(SALTS)))
    rk = _bucket_keys(names(rs), model, bits, 0).withColumnRenamed("rid", "rn").withColumn("key", F.explode(F.transform(F.sequence(F.lit(0), F.lit(SALTS - 1)), lambda salt: F.col("key") * SALTS + salt)))
    apart = F.bit_count(F.col("s0").bitwiseXOR(F.col("t0"))) + F.bit_count(F.col("s1").bitwiseXOR(F.col("t1")))
    near = lk.join(_merged(rk), "key").filter(apart <= SKETCH_APART).select("ln", "rn").repartition("ln").distinct()
    # most of what sketches let through isn't near: looked up by name, before it is multiplied by the records that bear the names
    named = lambda df, key, name: _merged(names(df).select(F.col("rid").alias(key), F.col("name").alias(name)))
    near = _near(near.join(named(signatures, "ln", "lname"), "ln").join(named(rs, "rn", "rname"), "rn"), model)
    bearers = lambda df, key, name: _merged(df.select(F.col("rid").alias(key), F.xxhash64("name").alias(name)))
    near = near.join(bearers(signatures, "lid", "ln"), "ln").join(bearers(rs, "rid", "rn"), "rn").select("lid", "rid")

    lt, rt = _tokens(signatures, model).withColumnRenamed("rid", "lid"), _tokens(rs, model)
    one = lambda df, key: df.select(key, F.explode("toks").alias("tok"))
    right = one(rt, "rid")
    few = right.groupBy("tok").agg(F.count("*").alias("n"))
    by_token = one(lt, "lid").join(_merged(right.join(_merged(few.filter(F.col("n") <= OFTEN)), "tok")), "tok").select("lid", "rid")
    # tokens that too many bear: pairs of them, and where a pair is borne by too many the whole core
    often = few.filter(F.col("n") > OFTEN).select("tok")

    def pairs(df, key):
        own = one(df, key).join(_merged(often), "tok", "left_semi").groupBy(key).agg(F.array_sort(F.collect_set("tok")).alias("ts"))
        two = own.select(key, F.explode(F.flatten(F.transform("ts", lambda x: F.transform(F.filter("ts", lambda y: y > x), lambda y: F.concat_ws(" ", x, y))))).alias("two"))
        return two

    rp = pairs(rt, "rid")
    held = rp.groupBy("two").agg(F.count("*").alias("n"))
    by_pair = pairs(lt, "lid").join(_merged(rp.join(_merged(held.filter(F.col("n") <= OFTEN)), "two")), "two").select("lid", "rid")
    by_core = lt.filter(F.col("core") != "").join(_merged(rt), "core").select("lid", "rid")
    told = by_token.unionByName(by_pair).unionByName(by_core).withColumn("shared", F.lit(True))
    return near.withColumn("shared", F.lit(False)).unionByName(told).groupBy("lid", "rid").agg(F.bool_or("shared").alias("shared"))


def _one_slip(a: str, b: str) -> bool:
    """Whether one letter changed, dropped, added or swapped with the next makes a into b."""
    if abs(len(a) - len(b)) > 1:
        return False
    n = min(len(a), len(b))
    i = 0
    while i < n and a[i] == b[i]:
        i += 1
    if len(a) == len(b):
        return a[i + 1 :] == b[i + 1 :] or (a[i : i + 2] == b[i : i + 2][::-1] and a[i + 2 :] == b[i + 2 :])
    return a[i + 1 :] == b[i:] if len(a) > len(b) else a[i:] == b[i + 1 :]


def _short_for(a: str, b: str) -> bool:
    """Whether a is b with letters left out, the first kept."""
    if len(a) < 2 or len(a) >= len(b) or a[0] != b[0]:
        return False
    at = 0
    for ch in a:
        at = b.find(ch, at) + 1
        if not at:
            return False
    return True


def _joined(one: str, two: str, slip: bool) -> bool:
    """Whether a word is two words without their blank, or one slip away from that."""
    return len(one) > 3 and (_one_slip(one, two) if slip else one == two)


def name_level(left: list[str], right: list[str], kinds) -> float:
    """How far two names are one: 1 every word has its like; 0.5 the left lacks the common words
    that tell sister firms apart; 0 some word differs. Two adjacent words of either side can be
    one word of the other."""
    if not left or not right:
        return 0.0
    free, told = list(range(len(right))), 0
    rest = []
    for i, w in enumerate(left):
        same = next((j for j in free if right[j] == w), None)
        if same is None:
            rest.append(i)
        else:
            free.remove(same)
            told += w in kinds
    for slip in (False, True):  # words joined or parted by a blank: equal first, then one slip away
        at = 0
        while at < len(rest):
            i, w = rest[at], left[rest[at]]
            if slip and any(len(w) > 3 and _one_slip(w, right[j]) for j in free):
                at += 1
                continue
            two = next((j for j in free if j + 1 in free and _joined(w, right[j] + right[j + 1], slip)), None)
            if two is not None:
                told += (right[two] in kinds) + (right[two + 1] in kinds)
                free = [j for j in free if j not in (two, two + 1)]
                del rest[at]
                continue
            if at + 1 < len(rest) and rest[at + 1] == i + 1:
                one = next((j for j in free if _joined(right[j], w + left[i + 1], slip)), None)
                if one is not None:
                    told += right[one] in kinds
                    free.remove(one)
                    del rest[at : at + 2]
                    continue
            at += 1
    free = [right[j] for j in free]
    for w in (left[i] for i in rest):
        like = next((x for x in free if len(w) > 3 and _one_slip(w, x)), None)
        if like is None:
            like = next((x for x in free if x in kinds and _short_for(w, x)), None)
        if like is None and w == left[-1]:
            like = next((x for x in free if x.startswith(w)), None)
            if like is not None and len(w) < 3:
                free.remove(like)
                continue
        if like is None:
            return 0.0
        free.remove(like)
        told += like in kinds
    if any(x not in kinds for x in free):
        return 0.0
    if not free:
        return 1.0
    return 0.9 if told else 0.5


def _cosines(m: Model, vecs: dict[str, np.ndarray], ln: list[str], rn: list[str]) -> np.ndarray:
    """Cosines of pairs of names; ``vecs`` holds vectors from one call to the next."""

    def vec(k: str) -> np.ndarray:
        got = vecs.get(k)
        if got is None:
            x = m.name(k)
            got = vecs[k] = np.zeros(DIM) if x is None else x
        return got

    if len(vecs) > 200_000:
        vecs.clear()
    return np.einsum("ij,ij->i", np.stack([vec(k) for k in ln]), np.stack([vec(k) for k in rn]))


def _near(pairs: DataFrame, model) -> DataFrame:
    """(ln, rn) of the pairs whose names' cosine is ``NEAR`` at least."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vecs: dict[str, np.ndarray] = {}
        for b in batches:
            if b.num_rows:
                cos = _cosines(model.value, vecs, b.column("lname").to_pylist(), b.column("rname").to_pylist())
                yield b.select(["ln", "rn"]).take(pa.array(np.flatnonzero(cos >= NEAR)))

    return pairs.select("ln", "rn", "lname", "rname").mapInArrow(run, "ln bigint, rn bigint")


def _compare(pairs: DataFrame, model) -> DataFrame:
    """Candidates with their evidence: identifiers that agree, name level, cosine. Names that share no token
    and aren't near by their vectors themselves (sketches only guess) are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        vecs: dict[str, np.ndarray] = {}
        parts: dict[str, tuple[list[str], str]] = {}

        def words(k: str):
            if k not in parts:
                parts[k] = name_words(k)
            return parts[k]

        for b in batches:
            if not b.num_rows:
                continue
            ln, rn = b.column("lname").to_pylist(), b.column("rname").to_pylist()
            cos = _cosines(m, vecs, ln, rn)
            at = np.flatnonzero(b.column("shared").to_numpy(zero_copy_only=False) | (cos >= NEAR))
            b = b.take(pa.array(at))
            li, ri, place = (b.column(c).to_pylist() for c in ("lids", "rids", "place"))
            agree, level, here, first = [], [], [], []
            for k, x, y, p in zip(at.tolist(), li, ri, place):
                (lw, lp), (rw, _) = words(ln[k]), words(rn[k])
                agree.append(len(set(x or ()) & set(y or ())))
                first.append(x[0] in (y or ()) if x else None)
                level.append(name_level(lw, rw, m.kinds))
                here.append(bool(lp and p and lp == p.lower()))
            if len(parts) > 200_000:
                parts.clear()
            yield pa.record_batch({
                "lid": b.column("lid"), "rid": b.column("rid"), "agree": pa.array(agree, pa.int32()), "told": pa.array([len(x or ()) for x in li], pa.int32()),
                "level": pa.array(level, pa.float64()), "cosine": pa.array(cos[at], pa.float64()), "here": pa.array(here, pa.bool_()), "first": pa.array(first, pa.bool_()),
            })

    kind = dict(pairs.dtypes)["rid"]
    return pairs.mapInArrow(run, f"lid string, rid {kind}, agree int, told int, level double, cosine double, here boolean, first boolean")


#: What the confidence starts from: weights of one, cosine, level, identifiers that agree, and that don't.
FEATURES = ["cosine", "level", "agree", "missed"]
PRIOR = np.array([-6.0, 4.0, 6.0, 4.0, -1.0])


def settled_candidates(scored: DataFrame) -> DataFrame:
    """(lid, rid, FEATURES, y): candidates of left records whose first identifier one candidate bears, if no
    other candidate bears another of their identifiers.

    ``y`` tells whether this candidate does; that identifier is left out of what agrees and what doesn't.
    """
    borne = scored.filter(F.col("agree") > 0).groupBy("lid").agg(F.count("*").alias("n"), F.bool_or("first").alias("first"))
    known = borne.filter((F.col("n") == 1) & F.col("first")).select("lid")
    agree = F.col("agree") - F.col("first").cast("int")
    rows = scored.join(_merged(known), "lid", "left_semi").withColumn("agree", agree)
    return rows.select("lid", "rid", "cosine", "level", "agree", (F.col("told") - 1 - F.col("agree")).alias("missed"), F.col("first").alias("y"))


def fit_confidence(rows: list) -> np.ndarray:
    """Logistic weights by Newton's method, drawn a little to ``PRIOR`` so that separable rows stay finite."""
    if not rows:
        return PRIOR
    x = np.array([[1.0, *(float(r[c]) for c in FEATURES)] for r in rows])
    y, t, shrink = np.array([float(r["y"]) for r in rows]), PRIOR.copy(), 0.1 * np.eye(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ t, -30, 30)))
        w = np.maximum(p * (1 - p), 1e-9)
        t = t + np.clip(np.linalg.solve((x * w[:, None]).T @ x + shrink, x.T @ (y - p) - shrink @ (t - PRIOR)), -5, 5)
    return t


def drawn_candidates(settled: DataFrame) -> DataFrame:
    """(FEATURES, y) of at most ``CALIBRATION`` candidates, in one partition: collected right after a limit,
    every task would send as many to the driver."""
    return settled.orderBy(F.xxhash64("lid", "rid"), "lid", "rid").limit(CALIBRATION).select(*FEATURES, "y").repartition(1)


def _calibrate(scored: DataFrame) -> np.ndarray:
    return fit_confidence(drawn_candidates(settled_candidates(scored)).collect())


def calibration_report(scored: DataFrame) -> tuple[float, list[tuple[float, float, int]]]:
    """(Brier score, (mean confidence, share right, candidates) by tenth) of one half by the weights of the other."""
    rows = settled_candidates(scored).withColumn("_h", F.pmod(F.xxhash64("lid"), F.lit(2)))
    t = fit_confidence(drawn_candidates(rows.filter("_h = 0")).collect())
    tested = rows.filter("_h = 1").withColumn("p", confidence_of(t))
    brier = tested.agg(F.avg(F.pow(F.col("p") - F.col("y").cast("int"), 2))).first()[0]
    tenths = tested.groupBy(F.least(F.floor(F.col("p") * 10), F.lit(9)).alias("b")).agg(F.avg("p"), F.avg(F.col("y").cast("int")), F.count("*")).orderBy("b").collect()
    return brier, [tuple(r)[1:] for r in tenths]


def confidence_of(weights: np.ndarray) -> Column:
    odds = F.lit(float(weights[0]))
    for c, w in zip(FEATURES, weights[1:]):
        odds = odds + F.col(c) * float(w)
    return 1 / (1 + F.exp(-odds))


def scored_candidates(
    left: DataFrame, left_id: str, left_name: str, left_ids: list[str],
    right: DataFrame, right_id: str, right_name: str, right_ids: list[str], right_place: str | None = None,
) -> tuple[DataFrame, DataFrame]:
    """(left records with their signatures, scored pairs of signature and right record)."""
    spark = left.sparkSession
    ids = lambda cols: F.array_sort(F.array_distinct(F.array_compact(F.array(*[identifier(F.col(c)) for c in cols]))))
    rs = right.select(
        F.col(right_id).alias("rid"), name_key(F.col(right_name)).alias("name"), ids(right_ids).alias("ids"),
        (F.upper(F.col(right_place)) if right_place else F.lit(None).cast("string")).alias("place"),
    ).filter(F.col("rid").isNotNull()).dropDuplicates(["rid"])
    ls = left.select(F.col(left_id).alias("_left"), name_key(F.col(left_name)).alias("name"), ids(left_ids).alias("ids")).filter(F.col("_left").isNotNull())
    ls = ls.withColumn("rid", F.md5(F.concat_ws("|", "name", F.array_join("ids", ","))))
    # names are folded once: both sides are used by every step that follows
    checkpoint_dir(spark)
    ls, rs = ls.checkpoint(), rs.checkpoint()
    signatures = ls.groupBy("rid").agg(F.first("name").alias("name"), F.first("ids").alias("ids")).checkpoint()
    both = signatures.select("name", "ids").unionByName(rs.select("name", "ids"))
    n_right, n_both = rs.count(), both.count()
    kinds = frozenset(_frequent_words(rs, max(n_right / KIND_SHARE, KIND_LEAST)))
    model = spark.sparkContext.broadcast(train_model(both, max(n_both, 1), kinds))
    bits = max(4, min(40, (max(n_right, 2) - 1).bit_length()))
    full = (
        _candidates(signatures, rs, model, bits)
        .join(_merged(signatures.select(F.col("rid").alias("lid"), F.col("name").alias("lname"), F.col("ids").alias("lids"))), "lid")
        .join(_merged(rs.select("rid", F.col("name").alias("rname"), F.col("ids").alias("rids"), "place")), "rid")
        .select("lid", "rid", "shared", "lname", "rname", "lids", "rids", "place")
    )
    return ls, _compare(full, model).filter((F.col("agree") > 0) | (F.col("level") > 0) | (F.col("cosine") > 0.5))


def match_records(
    left: DataFrame, left_id: str, left_name: str, left_ids: list[str],
    right: DataFrame, right_id: str, right_name: str, right_ids: list[str], right_place: str | None = None,
) -> DataFrame:
    """(left_id, right_id, confidence, agree, level, cosine): each left record's one match, if any.

    A left record is matched to the right record with the most evidence: identifiers in common,
    plus one for a name that fits whole. It needs one identifier or a whole name, and more
    evidence than any other right record; the place that ends a name breaks ties. Null or
    filler values are no evidence. Right records must be unique by id. Extra columns are ignored.
    """
    ls, scored = scored_candidates(left, left_id, left_name, left_ids, right, right_id, right_name, right_ids, right_place)
    # the candidates are used twice, by the fit and by the choice: cut here, so that neither is worked out again
    checkpoint_dir(left.sparkSession)
    scored = scored.checkpoint()
    weights = _calibrate(scored)
    evidence = F.col("agree") + F.col("level") + F.when(F.col("here"), 0.1).otherwise(0.0)
    w = Window.partitionBy("lid").orderBy(F.desc("evidence"), F.desc("cosine"), "rid")
    best = (
        scored.withColumn("evidence", evidence).withColumns({
            "_rank": F.row_number().over(w), "_next": F.lead("evidence").over(w),
        })
        .filter((F.col("_rank") == 1) & ((F.col("agree") >= 1) | (F.col("level") >= 0.9)))
        .filter(F.col("_next").isNull() | (F.col("evidence") > F.col("_next") + 0.05))
    )
    chosen = best.withColumn("missed", F.col("told") - F.col("agree")).select("lid", "rid", confidence_of(weights).alias("confidence"), "agree", "level", "cosine")
    return ls.select("_left", F.col("rid").alias("lid")).join(_merged(chosen), "lid").select(
        F.col("_left").alias(left_id), F.col("rid").alias(right_id), "confidence", "agree", "level", "cosine"
    ).dropDuplicates([left_id, right_id])
