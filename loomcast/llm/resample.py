"""Importance resampling towards a target distribution.

Every document is weighed by how much likelier its word runs are in a target
set than in the corpus, both counted into a fixed number of hashed buckets.
The gain of a bucket is a whole number; a document's weight is the floored mean
of the gains of its features.  Gumbel noise from a hash of the id makes the
highest scores a sample without replacement, the same on every run.

Three steps, none of which holds more than a bounded part of the corpus:

1. *Counts.*  Each task folds its rows into one array of bucket counts; the
   arrays are summed by bucket, and ``n_buckets`` numbers reach the driver.
2. *Weights.*  The gains go to the tasks as one array of ``n_buckets`` numbers;
   a document's weight is a sum over array places.  Scores are stored.
3. *Selection.*  The k-th key in the order (score falling, doc_id rising) is
   found digit by digit: each pass counts the rows that agree with the digits
   found so far by their next 16 bits (at most 65,536 numbers for the driver)
   and goes into the digit that holds the k-th.  Digits that all rows share are
   passed over.  Only the rows up to that key are range-sorted and ranked; rows
   that share a key or a score are spread over tasks by a number of their own.

Word hashes are unsigned crc32 of UTF-8 bytes, as the definition asks.

Defined cases: a null text has no words (weight 0, never drawn); a null doc_id
hashes as an empty one and comes last among equal scores; rows that repeat a
doc_id are drawn each for themselves, equal keys in any order (their results
are equal but for the weight); very long texts are counted whole; an empty
table gives no rows, an empty target only negative evidence; extra columns are
ignored, and clashing ones do not matter.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomcast.llm import _shared

#: Bits of a digit of the selection.
DIGIT = 16
#: Words of which a task remembers the bucket.
KEPT = 500_000
_SIGN = -(1 << 63)
#: Other characters than ASCII letters and digits part words, as far as they are ASCII; A-Z are lower-cased.
_WORDS = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


class _Buckets(dict):
    """word run -> bucket, for a bounded number of runs."""

    def __init__(self, n: int) -> None:
        self.n = n

    def __missing__(self, run: bytes) -> int:
        found = zlib.crc32(run) % self.n
        if len(self) >= KEPT:
            self.clear()
        self[run] = found
        return found


def features(text: str | None, longest: int, buckets: _Buckets) -> tuple[int, np.ndarray]:
    """(words, buckets of the runs of 1 to ``longest`` words) of a text."""
    words = (text or "").encode().translate(_WORDS).split()
    found = [buckets[w] for w in words]
    for n in range(2, longest + 1):
        found += [buckets[b" ".join(words[k : k + n])] for k in range(len(words) - n + 1)]
    return len(words), np.array(found, np.int64)


def _fold(n_buckets: int, longest: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        buckets, total = _Buckets(n_buckets), np.zeros(n_buckets, np.int64)
        for batch in batches:
            for text in batch.column(0):
                total += np.bincount(features(text.as_py(), longest, buckets)[1], minlength=n_buckets)
        found = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(total[found])], names=["bucket", "n"])

    return run


def bucket_counts(docs: DataFrame, text: str, n_buckets: int, longest: int) -> np.ndarray:
    """How many features of all texts fall in each bucket."""
    each = docs.select(F.col(f"`{text}`").cast("string").alias("text")).mapInArrow(_fold(n_buckets, longest), "bucket bigint, n bigint")
    out = np.zeros(n_buckets, np.int64)
    for r in each.groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r.bucket] = r.n
    return out


def gains(source: np.ndarray, target: np.ndarray, scale: int = 1000) -> np.ndarray:
    """The scaled log ratio of each bucket, floored."""
    n, s_all, t_all = len(source), float(source.sum()), float(target.sum())
    return np.array([math.floor(scale * math.log((float(t) + 1.0) * (s_all + n) / ((float(s) + 1.0) * (t_all + n)))) for s, t in zip(source, target, strict=True)], np.int64)


def _weigh(gain, longest: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = gain.value
        buckets = _Buckets(len(table))
        for batch in batches:
            words, size, weight = [], [], []
            for text in batch.column(1):
                n, found = features(text.as_py(), longest, buckets)
                words.append(n)
                size.append(len(found))
                weight.append(int(table[found].sum()) // len(found) if len(found) else 0)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(c, pa.int64()) for c in (words, size, weight))], names=["doc_id", "n_words", "n_features", "weight"])

    return run


def noise(doc_id: Column, seed: int, scale: int = 1000) -> Column:
    """Scaled, floored Gumbel noise from a hash of the id."""
    hashed = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"), 256)
    h = F.conv(F.substring(hashed, 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-float(scale)) * F.log(-F.log((h + F.lit(0.5)) / F.lit(4294967296.0)))).cast("bigint")


def weigh(docs: DataFrame, target: DataFrame, seed: int = 2024, n_buckets: int = 10_000, longest: int = 1, id_col: str = "doc_id", text: str = "text", target_text: str = "text") -> DataFrame:
    """``doc_id, n_words, n_features, weight, score`` of every row of ``docs``."""
    spark = docs.sparkSession
    _shared.ship(spark)
    gain = spark.sparkContext.broadcast(gains(bucket_counts(docs, text, n_buckets, longest), bucket_counts(target, target_text, n_buckets, longest)))
    source = docs.select(F.col(f"`{id_col}`").cast("bigint").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text"))
    weighed = source.mapInArrow(_weigh(gain, longest), "doc_id bigint, n_words bigint, n_features bigint, weight bigint")
    return weighed.withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed))


def _ordered(c: Column) -> Column:
    """A long whose unsigned order is the order of ``c``."""
    return c.cast("bigint").bitwiseXOR(F.lit(_SIGN).cast("bigint"))


def key_digits(part: Column, low: int, high: int) -> list[Column]:
    """The 16-bit digits of one part of a key, from the first in which its least and largest value differ."""
    width = ((low ^ high) & ((1 << 64) - 1)).bit_length()
    return [F.shiftrightunsigned(part, shift).bitwiseAND(F.lit((1 << DIGIT) - 1).cast("bigint")) for shift in range(DIGIT * (-(-width // DIGIT) - 1), -1, -DIGIT)]


def upto_kth(rows: DataFrame, parts: list[Column], k: int) -> Column:
    """A condition that holds for the rows whose keys are up to the k-th in the rising order of the key's parts.

    ``parts`` are longs.  With equal keys at the k-th place the condition holds for all of them.
    """
    if k <= 0:
        return F.lit(False)
    names = [f"_part{i}" for i in range(len(parts))]
    keyed = rows.select(*[_ordered(p).alias(n) for p, n in zip(parts, names, strict=True)])
    spans = rows.select(*[p.cast("bigint").alias(n) for p, n in zip(parts, names, strict=True)]).agg(*[F.min(n).alias(f"{n}_low") for n in names], *[F.max(n).alias(f"{n}_high") for n in names]).head()
    if spans[f"{names[0]}_low"] is None:
        return F.lit(False)
    digits = [(i, d) for i, n in enumerate(names) for d in range(len(key_digits(F.col(n), spans[f"{n}_low"], spans[f"{n}_high"])))]

    def digit(i: int, d: int, part: Column) -> Column:
        return key_digits(part, spans[f"{names[i]}_low"], spans[f"{names[i]}_high"])[d]

    found: list[int] = []
    left = k
    for i, d in digits:
        same = F.lit(True)
        for (a, b), value in zip(digits, found, strict=False):
            same = same & (digit(a, b, F.col(names[a])) == value)
        counted = {r.digit: r.n for r in keyed.where(same).groupBy(digit(i, d, F.col(names[i])).alias("digit")).agg(F.count(F.lit(1)).alias("n")).collect()}
        for value in sorted(counted):
            if left <= counted[value]:
                break
            left -= counted[value]
        found.append(value)
        if left == counted[value]:  # all of this digit belong to it
            break
    # as one comparison of digits, the first that differs deciding
    own = [_ordered(p) for p in parts]
    out = F.lit(True)
    for (i, d), value in reversed(list(zip(digits, found, strict=False))):
        here = digit(i, d, own[i])
        out = (here < value) | ((here == value) & out)
    return out


def ranked(rows: DataFrame, order: list[Column], per: int = 200_000, name: str = "rank") -> DataFrame:
    """Adds the place of each row (1, 2, 3 ...) in ``order``: a range sort, a count for each sorted part, then sums of counts."""
    spark = rows.sparkSession
    n = rows.count()
    parts = max(1, -(-n // per))
    spread = rows.withColumn("_own", F.monotonically_increasing_id())  # deals equal keys over tasks
    order = [*order, F.col("_own")]
    dealt = spread.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    placed, _ = _shared.materialize(dealt.drop("_own").withColumn("_part", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))), name)
    before, sums = 0, {}
    for r in sorted(placed.groupBy("_part").agg(F.count(F.lit(1)).alias("n")).collect()):
        sums[r._part] = before
        before += r.n
    schema = T.StructType([T.StructField("_part", T.IntegerType()), T.StructField("_before", T.LongType())])
    offsets = spark.createDataFrame(sorted(sums.items()), schema)
    return placed.join(F.broadcast(offsets), "_part").withColumn(name, F.col("_before") + F.col("_at") + 1).drop("_part", "_at", "_before")


def draw(weighed: DataFrame, share: tuple[int, int] = (10, 100), least_words: int = 20) -> DataFrame:
    """Adds ``rank`` for the floor(share * N) highest scores of the N rows of at least ``least_words`` words; null for the rest."""
    stored, _ = _shared.materialize(weighed, "scores")
    fit = F.col("n_words") >= least_words
    pool = stored.where(fit)
    k = share[0] * pool.count() // share[1]
    # ~score falls where the score rises, over all longs
    parts = [F.bitwise_not("score"), F.col("doc_id").isNull().cast("bigint"), F.coalesce("doc_id", F.lit(0).cast("bigint"))]
    chosen = fit & upto_kth(pool, parts, k)
    top = ranked(stored.where(chosen), parts)
    return top.withColumn("rank", F.when(F.col("rank") <= k, F.col("rank"))).unionByName(stored.where(~chosen).withColumn("rank", F.lit(None).cast("bigint")))


def resample(docs: DataFrame, target: DataFrame, share: tuple[int, int] = (10, 100), least_words: int = 20, **settings) -> DataFrame:
    """``weigh``, then ``draw``."""
    return draw(weigh(docs, target, **settings), share, least_words)


def query(spark, sf_dir):
    out = resample(_shared.table(spark, sf_dir, "documents"), _shared.table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_features", "weight", "score", "rank")


SQL = r"""
WITH RECURSIVE bits(i, c, step) AS (
  SELECT i, CAST(i AS BIGINT), 0 FROM range(256) r(i)
  UNION ALL SELECT i, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, step + 1 FROM bits WHERE step < 8),
crc AS (SELECT list(c ORDER BY i) AS t FROM bits WHERE step = 8),
d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
b AS (SELECT regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark),
dw AS (SELECT rid, unnest(ws) AS w FROM d), bw AS (SELECT unnest(ws) AS w FROM b),
words AS (SELECT w, hex(encode(w)) AS x FROM (SELECT w FROM dw UNION SELECT w FROM bw)),
bytes AS (SELECT w, list_transform(range(0, length(x) // 2), lambda k: CAST('0x' || substr(x, CAST(2 * k + 1 AS INT), 2) AS BIGINT)) AS bs FROM words),
hashed AS (SELECT w, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), bs), lambda c, v: xor(c >> 8, t[(xor(c, v) & 255) + 1])), 4294967295) % 10000 AS k FROM bytes, crc),
s AS (SELECT k, count(*) AS n FROM dw JOIN hashed USING (w) GROUP BY k), t AS (SELECT k, count(*) AS n FROM bw JOIN hashed USING (w) GROUP BY k),
sums AS (SELECT CAST((SELECT coalesce(sum(n), 0) FROM s) AS DOUBLE) AS sa, CAST((SELECT coalesce(sum(n), 0) FROM t) AS DOUBLE) AS ta),
g AS (SELECT k, CAST(floor(1000 * ln((coalesce(t.n, 0)::DOUBLE + 1) * (sa + 10000) / ((coalesce(s.n, 0)::DOUBLE + 1) * (ta + 10000)))) AS BIGINT) AS gain
      FROM s FULL JOIN t USING (k), sums),
m AS (SELECT rid, count(*) AS n, sum(gain) AS total FROM dw JOIN hashed USING (w) JOIN g USING (k) GROUP BY rid),
f AS (SELECT doc_id, coalesce(n, 0) AS n_features, CAST(CASE WHEN n IS NULL THEN 0 ELSE (total - ((total % n) + n) % n) // n END AS BIGINT) AS weight,
  CAST('0x' || substr(sha256('2024:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8) AS BIGINT) AS h FROM d LEFT JOIN m USING (rid)),
p AS (SELECT doc_id, CAST(n_features AS BIGINT) AS n_features, weight, weight + CAST(floor(-1000.0 * ln(-ln((h + 0.5::DOUBLE) / 4294967296.0::DOUBLE))) AS BIGINT) AS score FROM f),
r AS (SELECT *, row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id NULLS LAST) AS place, count(*) FILTER (n_features >= 20) OVER () AS pool FROM p)
SELECT doc_id, n_features, weight, score, CAST(CASE WHEN n_features >= 20 AND place <= 10 * pool // 100 THEN place END AS BIGINT) AS rank FROM r
"""
