import random

import numpy as np
from pyspark.sql import functions as F

from finstrata.llm.leaks import _key_filter, _keyed, _passing, _windows, block_keys, join_near, leaked_items, simhash, word_hash, words

R = random.Random(6)
LEXICON = ["".join(R.choice("bcdfglmnprst") + R.choice("aeiou") for _ in range(R.randrange(2, 4))) for _ in range(3000)]
ITEMS = [[R.choice(LEXICON) for _ in range(60)] for _ in range(12)]


def _noise(n):
    return [R.choice(LEXICON) for _ in range(n)]


def _alter(ws, every, how):
    out = list(ws)
    for k in range(every - 1, len(ws) - 3, every):
        out[k] = {"swap": "zzalter", "drop": "", "add": out[k] + " zzadded"}[how]
    return [w for w in out if w]


def test_finds_what_was_planted(spark):
    docs, want = [], {}
    for k, item in enumerate(ITEMS):
        for how, ws in (
            ("plain", item[5:17]), ("long", item[:50]), ("swap", _alter(item[10:40], 10, "swap")), ("drop", _alter(item[10:40], 10, "drop")), ("add", _alter(item[10:40], 10, "add")),
            ("upper", [w.upper() + "," for w in item[20:40]]), ("wide", ["".join(chr(ord(c) + 0xFEE0) for c in w) for w in item[20:40]]), ("looks", [w.replace("a", "а").replace("o", "о") for w in item[20:40]]),
            ("wrapped", ["\n".join(item[20:34])]), ("short", item[5:13]), ("altered too much", _alter(item[5:40], 3, "swap")), ("shuffled", R.sample(item, 60)),
        ):
            i = len(docs)
            docs.append((i, " ".join(_noise(40) + list(ws) + _noise(40))))
            if how not in ("short", "altered too much", "shuffled"):
                want[i] = k
    docs += [(len(docs), None), (len(docs) + 1, ""), (len(docs) + 2, "​...")]
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumn("item_id", F.lit("clash"))
    items = spark.createDataFrame([(k, " ".join(x)) for k, x in enumerate(ITEMS)] + [(0, "again"), (77, None), (78, ""), (79, "two words")], "item_id long, text string")
    got = leaked_items(d.union(d.limit(20)), items)
    assert {(r.doc_id, r.item_id) for r in got.collect()} == set(want.items())
    several = leaked_items(d, items, filter_bits=1 << 8)  # a filter that nearly all windows pass changes nothing
    assert {(r.doc_id, r.item_id) for r in several.collect()} == set(want.items())
    assert leaked_items(d.limit(0), items).count() == 0 and leaked_items(d, items.limit(0)).count() == 0


def test_shared_sentence_is_a_case_of_both(spark):
    shared = _noise(14)
    items = spark.createDataFrame([(1, " ".join(_noise(10) + shared + _noise(9))), (2, " ".join(shared + _noise(20)))], "item_id long, text string")
    docs = spark.createDataFrame([(1, " ".join(_noise(30) + shared + _noise(30)))], "doc_id long, text string")
    assert {tuple(r)[:2] for r in leaked_items(docs, items).collect()} == {(1, 1), (1, 2)}


def test_a_passage_far_into_a_very_long_text(spark):
    docs = spark.createDataFrame([(1, " ".join(_noise(250_000) + ITEMS[3][:20] + _noise(10)))], "doc_id long, text string")
    items = spark.createDataFrame([(3, " ".join(ITEMS[3]))], "item_id long, text string")
    assert [tuple(r) for r in leaked_items(docs, items).collect()] == [(1, 3, 20, 0)]


def test_a_sentence_that_many_items_share(spark):
    shared = _noise(12)
    items = spark.createDataFrame([(k, " ".join(_noise(20) + shared[:11] + [f"own{k}"] + _noise(9))) for k in range(30)], "item_id long, text string")
    docs = spark.createDataFrame([(1, " ".join(_noise(30) + shared[:11] + ["another"] + _noise(30))), (2, " ".join(_noise(30) + shared[:6] + ["another"] + shared[7:11] + ["other"] + _noise(9)))], "doc_id long, text string")
    got = [tuple(r)[:2] for r in leaked_items(docs, items).collect()]
    assert not got  # eleven words are no passage
    middle = spark.createDataFrame([(k, " ".join(_noise(20) + shared[:6] + [f"own{k}"] + shared[7:] + _noise(9))) for k in range(30)], "item_id long, text string")
    once = spark.createDataFrame([(1, " ".join(_noise(30) + shared[:6] + ["another"] + shared[7:] + _noise(30)))], "doc_id long, text string")
    assert sorted(tuple(r) for r in leaked_items(once, middle).collect()) == [(1, k, 12, 1) for k in range(30)]
    items = items.withColumn("text", F.regexp_replace("text", " own", " same own"))
    docs = docs.withColumn("text", F.regexp_replace("text", " another", " same another"))
    assert sorted(tuple(r)[:2] for r in leaked_items(docs, items).collect()) == [(1, k) for k in range(30)]


def test_items_that_word_things_alike(spark):
    a, b = _noise(6), _noise(6)
    items = spark.createDataFrame([(1, " ".join(_noise(9) + a + ["mine"] + b + _noise(9))), (2, " ".join(a + ["yours"] + b + _noise(9)))], "item_id long, text string")
    docs = spark.createDataFrame([(1, " ".join(_noise(9) + a + ["yours"] + b + _noise(9))), (2, " ".join(_noise(9) + a + ["other"] + b + _noise(9)))], "doc_id long, text string")
    # the first document quotes item 2 to the letter, the second alters a word of both
    assert sorted(tuple(r)[:2] for r in leaked_items(docs, items).collect()) == [(1, 2), (2, 1), (2, 2)]


def test_blocks_miss_nothing_within_the_radius(spark):
    windows = _windows(spark.createDataFrame([(k, " ".join(x)) for k, x in enumerate(ITEMS)], "i long, t string"), 5)
    keyed = _keyed(windows, 2)
    mine = [r for r in windows.collect() if r.print is not None]
    base = np.array([r.print for r in mine], dtype=np.int64).view(np.uint64)
    rng = np.random.default_rng(1)
    flips = np.array([sum(1 << int(b) for b in rng.choice(64, k % 4, replace=False)) for k in range(len(base))], dtype=np.uint64)
    table = _key_filter(keyed, 16)
    pos, tab, key = _passing(base ^ flips, 2, 16, table)
    assert (block_keys(base, 2)[0] >= 0).all()
    spots = spark.createDataFrame([(0, int(p), int((base ^ flips)[p].astype(np.int64)), int(t), int(k)) for p, t, k in zip(pos, tab, key)], "d int, pos int, print long, tab int, key long")
    found = [(r.pos, r.i, r.at) for r in join_near(spots, keyed, 2).collect()]
    want = {(i, mine[j].i, mine[j].at) for i, p in enumerate(base ^ flips) for j in np.flatnonzero(np.bitwise_count(base ^ p) <= 2).tolist()}
    assert len(found) == len(set(found)) and set(found) == want


def test_simhash_is_the_sign_of_each_bit():
    h = np.array([word_hash(w) for w in LEXICON[:9]], dtype=np.uint64)
    for i, p in enumerate(simhash(h, 5).tolist()):
        for bit in range(64):
            ones = sum(int(x) >> bit & 1 for x in h[i : i + 5].tolist())
            assert (p >> bit & 1) == (ones > 2)


def test_words():
    assert words("The ＴＥＸＴ, 71,226 cafés; ﬁne​ly Ѕold") == ["the", "text", "71226", "cafes", "finely", "sold"]
