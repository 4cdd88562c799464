import random

import pytest
from pyspark.sql import functions as F

from finstrata.llm.packing import Packer, encoder, pack

VOCAB = "/opt/tokenizers/byte_bpe_50k.tiktoken"


def test_packer_never_overfills():
    r = random.Random(4)
    p, sizes, done = Packer(100, 8), [r.randrange(1, 101) for _ in range(3000)], []
    for i, s in enumerate(sizes):
        full = p.put(s, [i])
        if full:
            done.append(full)
    done += list(p.rest())
    seen = sorted(i for _, items in done for i in items)
    assert seen == list(range(3000))
    for room, items in done:
        assert room == 100 - sum(sizes[i] for i in items) >= 0
    assert len(done) < 1.12 * sum(sizes) / 100
    assert len(p.open) <= 8


@pytest.fixture(scope="module")
def docs(spark):
    r = random.Random(5)
    texts = ["word " * r.randrange(1, 900) for _ in range(300)] + ["long " * 9000, "", None, "word " * 2047 + "w"]
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("room", F.lit("clash")).repartition(6)


def test_whole_texts_in_full_containers(spark, docs):
    rows = pack(docs, VOCAB).collect()
    texts = {r.doc_id: r.text for r in docs.collect()}
    enc = encoder(VOCAB)
    by, parts = {}, {}
    for r in rows:
        by[r.container_id] = by.get(r.container_id, 0) + r.n_tokens
        parts.setdefault(r.doc_id, []).append((r.part, r.first_token, r.n_tokens))
    assert set(parts) == {i for i, t in texts.items() if t is not None}
    assert max(by.values()) <= 2048
    for i, ps in parts.items():
        n, ps = len(enc.encode_ordinary(texts[i])), sorted(ps)
        assert sum(x[2] for x in ps) == n
        assert len(ps) == max(1, -(-n // 2048))
        assert [x[1] for x in ps] == [2048 * k for k in range(len(ps))]
    assert len(by) <= 1.05 * sum(by.values()) / 2048 + 2


def test_empty(spark, docs):
    assert pack(docs.limit(0), VOCAB).count() == 0
