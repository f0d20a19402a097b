"""Importance resampling against a plain version, and the selection against sorting."""

import collections
import hashlib
import math
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from loomcast.llm import resample

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
SCHEMA = "doc_id bigint, text string, n_words string, score string, rank string, _part string"


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def runs(text, longest):
    words = WORD.findall(lower(text))
    return words, [" ".join(words[k : k + n]) for n in range(1, longest + 1) for k in range(len(words) - n + 1)]


def brute(docs, target, n, longest, share, least):
    bucket = lambda w: zlib.crc32(w.encode()) % n
    s, t = collections.Counter(), collections.Counter()
    for counts, texts in ((s, [x for _, x in docs]), (t, target)):
        for x in texts:
            counts.update(map(bucket, runs(x, longest)[1]))
    gain = [math.floor(1000 * math.log((t[k] + 1) * (s.total() + n) / ((s[k] + 1) * (t.total() + n)))) for k in range(n)]
    out = []
    for i, x in docs:
        words, found = runs(x, longest)
        weight = sum(gain[bucket(w)] for w in found) // len(found) if found else 0
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append((i, len(words), len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    pool = sorted((r for r in out if r[1] >= least), key=lambda r: (-r[4], r[0] is None, r[0] or 0))
    k = share[0] * len(pool) // share[1]
    ranks = collections.defaultdict(list)
    for place, r in enumerate(pool[:k], 1):
        ranks[(r[0], r[4])].append(place)
    return out, ranks, k


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(8)
    texts = [" ".join(rng.choices("Alpha beta gamma Delta ÄÖ x1 y-z 日本 the".split(), k=rng.choice((0, 5, 19, 20, 21, 60)))) for _ in range(180)]
    rows = [(i * 7 - 300, t) for i, t in enumerate(texts)] + [(None, texts[5] * 9), (None, None), (5, None), (6, ""), (6, "  ,;\n"), (1 << 62, "long " * 40_000), (-(1 << 62), "word " * 30)]
    rows += [(77, "same text again " * 12)] * 40
    return rows, spark.createDataFrame([(*r, "a", "b", "c", "d") for r in rows], SCHEMA).repartition(5)


@pytest.mark.parametrize(("longest", "n", "share", "least"), [(1, 10_000, (10, 100), 20), (2, 50, (1, 3), 5), (1, 7, (1, 1), 0), (1, 10, (1, 100_000), 1)])
def test_equals_the_plain_version(spark, docs, longest, n, share, least):
    rows, df = docs
    target = ["gamma Delta the the", None, "日本 x1", ""]
    got = resample.resample(df, spark.createDataFrame([(t,) for t in target], "text string"), share, least, n_buckets=n, longest=longest).collect()
    want, ranks, k = brute(rows, target, n, longest, share, least)
    assert collections.Counter((r.doc_id, r.n_words, r.n_features, r.weight, r.score) for r in got) == collections.Counter(want)
    drawn = [r for r in got if r["rank"] is not None]
    assert sorted(r["rank"] for r in drawn) == list(range(1, k + 1))
    found = collections.defaultdict(list)
    for r in drawn:
        found[(r.doc_id, r.score)].append(r["rank"])
    assert {key: sorted(v) for key, v in found.items()} == ranks


def test_empty_tables(spark, docs):
    _, df = docs
    empty = df.limit(0)
    assert resample.resample(empty, empty).collect() == []
    assert resample.resample(df, empty).count() == df.count()


@pytest.mark.parametrize("spread", [1, 300, 1 << 40, 1 << 62])
def test_selection_finds_the_kth_key(spark, spread):
    rng = random.Random(spread)
    keys = [(rng.randint(-spread, spread), rng.randint(-3, 3)) for _ in range(500)]
    df = spark.createDataFrame(keys, "a bigint, b bigint").repartition(4).cache()
    for k in (0, 1, 17, 250, 499, 500):
        got = sorted(tuple(r) for r in df.where(resample.upto_kth(df, [F.col("a"), F.col("b")], k)).collect())
        last = sorted(keys)[k - 1] if k else None
        assert got == (sorted(x for x in keys if x <= last) if k else [])


def test_ranks_over_many_parts(spark):
    df = spark.range(5000).select((F.col("id") * 37 % 1000).alias("v"))
    got = resample.ranked(df, [F.desc("v")], per=300).collect()
    assert [r.v for r in sorted(got, key=lambda r: r["rank"])] == sorted((r.v for r in got), reverse=True)
    assert sorted(r["rank"] for r in got) == list(range(1, 5001))
