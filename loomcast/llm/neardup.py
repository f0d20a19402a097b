"""Near-duplicate classes by BagMinHash signatures over five-word shingles.

A document is the multiset of its shingles (five consecutive lower-cased
words; a shorter document is one shingle).  The weight of a shingle is its
count.  BagMinHash: the weight axis is cut into the intervals [0,1), [1,2),
[2,4), [4,8) ...; every (shingle, interval) owns a Poisson process whose points
carry an arrival time, a signature position and a weight coordinate.  A point
counts when its coordinate lies below the shingle's weight, and a signature
position keeps its earliest arrival, so two documents agree at a position with
probability equal to their weighted Jaccard similarity.  Processes are advanced
together and stop once they are past the latest arrival that still matters.

Signatures are banded.  Documents with equal multisets are folded first.  In a
band bucket no pairs are emitted: one *centre* is compared with the other
members, first by short signatures (128 places of 8 bits; a pair at the
threshold disagrees in too many of them with probability below 1e-9), then by
the exact multiset overlap of the texts, and verified links are merged into
components; that settles groups of copies.  Documents of buckets that still
hold several components are compared again by an exact filter, their rarest
tokens (no similar pair lacks a common one, and positions rule out pairs that
share too little), again centres against members, with more centres each round
until no group is open.  Every pair of a bucket is thus verified, already in
one class, or ruled out.  32 bands of 4 miss a pair at similarity 0.8 with
probability below 5e-8.

Rows are stored once in buckets of a row id; pairs travel to the texts.

Defined cases: texts without words are in a class of their own; rows that
repeat a doc_id are one document, whose texts' classes become one; a row with a
null doc_id takes the class of an identified similar text, else null; ties go
to the least doc_id; very long texts are hashed whole; an empty table gives an
empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomcast.llm import _shared, _words
from loomcast.llm._words import mix
from loomcast.llm.components import components

_U = np.uint64
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32


def shingles(texts: pa.Array, k: int = 5) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """(row, shingle hash, count) of the distinct shingles of each row, by row then hash, and the number of rows."""
    w = _words.Words(texts)
    h = w.hashes(0, _LOWER[w.data])
    at = _words.window_starts(w, k)
    row, value = w.rows()[at] if len(at) else np.zeros(0, np.int64), _words.windows(h, k)[at] if len(at) else np.zeros(0, _U)
    short = np.flatnonzero((w.counts > 0) & (w.counts < k))
    if len(short):
        whole = np.zeros(len(short), _U)
        for j in range(k - 1):
            has = w.counts[short] > j
            whole[has] = whole[has] * _U(0xC2B2AE3D27D4EB4F) + h[w.first[short[has]] + j]
        row, value = np.concatenate([row, short]), np.concatenate([value, mix(whole + w.counts[short].astype(_U))])
    order = np.lexsort((value, row))
    row, value = row[order], value[order]
    new = np.ones(len(row), dtype=bool)
    new[1:] = (row[1:] != row[:-1]) | (value[1:] != value[:-1])
    count = np.diff(np.append(np.flatnonzero(new), len(row)))
    return row[new], value[new], count, len(w.counts)


def signatures(row: np.ndarray, value: np.ndarray, count: np.ndarray, rows: int, m: int) -> np.ndarray:
    """rows x m earliest arrivals as uint64 bit patterns (rows without shingles are all infinite)."""
    sig = np.full(rows * m, np.inf)
    seeds, owner, low, width, weight = [], [], [], [], []
    j, lo = 0, 0
    mine = np.arange(len(row))
    while len(mine):
        size = 1 if j == 0 else lo
        seeds.append(mix(value[mine] + _U((j + 1) * 0x9E3779B97F4A7C15 & (2**64 - 1))))
        owner.append(row[mine])
        low.append(np.full(len(mine), float(lo)))
        width.append(np.full(len(mine), float(size)))
        weight.append(count[mine].astype(float))
        lo += size
        j += 1
        mine = mine[count[mine] > lo]
    if not seeds:
        return sig.view(_U).reshape(rows, m)
    seed, own, low, width, weight = (np.concatenate(x) for x in (seeds, owner, low, width, weight))
    t = np.zeros(len(seed))
    step = 0
    while len(seed):
        burst = 1 if step < 3 else 16
        k = np.arange(step + 1, step + burst + 1, dtype=_U)
        x = mix(seed[:, None] + k * _U(0xD1B54A32D192ED03))
        y = mix(x ^ _U(0x8CB92BA72F3D8DD7))
        gap = -np.log1p(-((x >> _U(11)).astype(float) * 2.0**-53)) / width[:, None]
        gap[:, 0] += t
        time = np.add.accumulate(gap, axis=1)
        where = own[:, None] * m + (y % _U(m)).astype(np.int64)
        inside = low[:, None] + (y >> _U(32)).astype(float) * 2.0**-32 * width[:, None] < weight[:, None]
        np.minimum.at(sig, where[inside], time[inside])
        t = time[:, -1]
        step += burst
        live = np.unique(own)
        latest = np.zeros(rows)
        latest[live] = sig.reshape(rows, m)[live].max(axis=1)
        go = t < latest[own]
        seed, own, low, width, weight, t = (a[go] for a in (seed, own, low, width, weight, t))
    return sig.view(_U).reshape(rows, m)


def _sign(bands: int, per: int, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in _words.slices(batch, "text"):
                row, value, count, rows = shingles(piece.column(2), k)
                sig = signatures(row, value, count, rows, bands * per)
                size = np.bincount(row, weights=count, minlength=rows).astype(np.int64)
                some = size > 0
                prints = []
                for salt in (0x51ED270B7A1C3F95, 0xB492B66FBE98F273):
                    part = np.zeros(rows, _U)
                    np.add.at(part, row, mix(value ^ _U(salt)) * count.astype(_U))
                    prints.append(part.view(np.int64))
                keys = np.zeros((rows, bands), _U)
                for j in range(per):
                    keys = mix(keys + sig.reshape(rows, bands, per)[:, :, j]) + np.arange(bands, dtype=_U)
                flat = pa.array(keys[some].view(np.int64).ravel())
                offsets = np.concatenate([[0], np.cumsum(some * bands)]).astype(np.int32)
                short = mix(sig).astype(np.uint8)
                yield pa.RecordBatch.from_arrays(
                    [piece.column(0), piece.column(1), pa.array(size), pa.array(prints[0]), pa.array(prints[1]),
                     pa.array([x.tobytes() for x in short], pa.binary()), pa.ListArray.from_arrays(pa.array(offsets), flat)],
                    names=["rid", "doc_id", "n", "fp1", "fp2", "sig", "bands"],
                )

    return run


def _alike(least: int):
    """Pairs whose short signatures agree in ``least`` places or more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            a, b = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(batch.num_rows, -1) for c in (2, 3))
            ok = pa.array((a == b).sum(axis=1) >= least)
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(ok), batch.column(1).filter(ok)], names=["u", "v"])

    return run


def _overlap(threshold: float, k: int):
    """Exact weighted Jaccard of the two texts of each pair row; keeps the linked ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in _words.slices(batch, "text_v", 1 << 20):
                n = piece.num_rows
                ra, va, ca, _ = shingles(piece.column(2), k)
                rb, vb, cb, _ = shingles(piece.column(3), k)
                row, value = np.concatenate([ra, rb]), np.concatenate([va, vb])
                count = np.concatenate([ca, cb])
                order = np.lexsort((value, row))
                row, value, count = row[order], value[order], count[order]
                pair = np.flatnonzero((row[1:] == row[:-1]) & (value[1:] == value[:-1]))
                both = np.bincount(row[pair], weights=np.minimum(count[pair], count[pair + 1]), minlength=n)
                total = np.bincount(row, weights=count, minlength=n)
                ok = pa.array(both >= threshold * (total - both) - 1e-9)
                yield pa.RecordBatch.from_arrays([piece.column(0).filter(ok), piece.column(1).filter(ok)], names=["u", "v"])

    return run


def _tokens(k: int):
    """(rep, n, key) rows: the k-th occurrence of a shingle is a token of its own, so overlap is set overlap."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in _words.slices(batch, "text"):
                row, value, count, rows = shingles(piece.column(1), k)
                size = np.bincount(row, weights=count, minlength=rows).astype(np.int64)
                at = np.repeat(np.arange(len(row)), count)
                nth = np.arange(len(at)) - np.repeat(np.cumsum(count) - count, count)
                token = mix(value[at] + nth.astype(_U) * _U(0x9E3779B97F4A7C15))
                ids = piece.column(0).take(pa.array(row[at]))
                yield pa.RecordBatch.from_arrays([ids, pa.array(size[row[at]]), pa.array(token.view(np.int64))], names=["rep", "n", "key"])

    return run


class _Links:
    """The components that verified links make so far, and the pairs already looked at.

    ``texts`` (rid, text) is stored in buckets of rid, so pairs travel to the
    texts; ``sigs`` (rep, n, sig) rules pairs out before any text moves.
    """

    def __init__(self, texts: DataFrame, sigs: DataFrame, threshold: float, k: int, least: int) -> None:
        spark = texts.sparkSession
        self.texts, self.sigs, self.t, self.k, self.least = texts, sigs, threshold, k, least
        self.n_tested = self.n_links = 0
        self.tested = spark.createDataFrame([], "u bigint, v bigint")
        self.label = spark.createDataFrame([], "node bigint, comp bigint")
        self.spent: list[str] = []

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        out, path = _shared.materialize(df, name)
        self.spent.append(path)
        return out

    def drop_spent(self) -> None:
        _shared.discard(self.texts.sparkSession, *self.spent)
        self.spent = []

    def add(self, edges: DataFrame) -> None:
        """Merge components along ``edges`` (u, v)."""
        self.n_links += edges.count()
        known = self.label.where("node <> comp").select(F.col("node").alias("u"), F.col("comp").alias("v"))
        self.label = components(_shared.snug(known.unionByName(edges), 2 * self.n_links))

    def labelled(self, members: DataFrame) -> DataFrame:
        named = self.label.withColumnRenamed("node", "rep")
        return members.join(named, "rep", "left").withColumn("comp", F.coalesce("comp", "rep"))

    def verified(self, pairs: DataFrame) -> DataFrame:
        """The pairs (u, v) whose texts are similar.  First the short signatures, then the texts, each by its own side."""
        n_bits = self.sigs.select(F.col("rep").alias("u"), F.col("sig").alias("sig_u"))
        v_bits = self.sigs.select(F.col("rep").alias("v"), F.col("sig").alias("sig_v"))
        near = pairs.join(n_bits, "u").join(v_bits, "v").select("u", "v", "sig_u", "sig_v").mapInArrow(_alike(self.least), "u bigint, v bigint")
        near = self.keep(near, "near")
        # centres are few and may be hot: their texts are a table of their own, so that Spark can split the join on u
        centres = self.keep(self.texts.join(near.select(F.col("u").alias("rid")).distinct(), "rid").select(F.col("rid").alias("u"), F.col("text").alias("text_u")), "centres")
        held = near.join(self.texts.select(F.col("rid").alias("v"), F.col("text").alias("text_v")), "v")
        both = held.join(centres, "u").select("u", "v", "text_u", "text_v")
        return self.keep(both.mapInArrow(_overlap(self.t, self.k), "u bigint, v bigint").distinct(), "links")

    def settle(self, pairs: DataFrame) -> None:
        """Verify the pairs that were not looked at before, and merge along the links."""
        pairs = pairs.distinct().join(self.tested, ["u", "v"], "left_anti")
        pairs, _ = _shared.materialize(pairs, "pairs")
        n = pairs.count()
        if not n:
            return
        self.n_tested += n
        found = self.verified(_shared.snug(pairs, n))
        self.tested = _shared.snug(self.tested.unionByName(pairs), self.n_tested)
        if not found.isEmpty():
            self.add(found)
        self.drop_spent()

    def still_open(self, members: DataFrame) -> DataFrame:
        """Members of keys whose members that were no centres yet belong to several components."""
        now = self.labelled(members.drop("comp"))
        spread = now.where("not used").groupBy("key").agg(F.min("comp").alias("a"), F.max("comp").alias("b")).where("a < b").select("key")
        held, _ = _shared.materialize(now.join(_shared.materialize(spread, "keys")[0], "key"), "open")
        return _shared.snug(held, held.count())

    def one_round(self, members: DataFrame, slots: int) -> DataFrame:
        """Compare up to ``slots`` new centres of every key with its members (both with their components)."""
        slot = F.pmod(F.xxhash64("rep"), F.lit(slots))
        chosen = (
            members.where("not used").groupBy("key", slot.alias("slot")).agg(F.min(F.struct("rep", "n", "comp", "pos")).alias("c"))
            .select("key", F.col("c.rep").alias("c"), F.col("c.n").alias("c_n"), F.col("c.comp").alias("c_comp"), F.col("c.pos").alias("c_pos"))
        )
        chosen, path = _shared.materialize(chosen, "chosen")  # stored, so that Spark can split hot keys of the join
        sizes = f"least(n, c_n) >= {self.t} * greatest(n, c_n) - 1e-9"
        places = f"least(n - pos, c_n - c_pos) >= {self.t / (1 + self.t)} * (n + c_n) - 1e-9"
        met = members.join(chosen, "key").where(f"rep <> c and comp <> c_comp and {sizes} and {places}")
        self.settle(met.select(F.least("rep", "c").alias("u"), F.greatest("rep", "c").alias("v")))
        done = chosen.select("key", F.col("c").alias("rep"), F.lit(True).alias("now_used"))
        out = members.join(done, ["key", "rep"], "left").select("key", "rep", "n", F.coalesce("now_used", "used").alias("used"), "pos")
        out, _ = _shared.materialize(out, "members")
        _shared.discard(self.texts.sparkSession, path)
        return out

    def prefixes(self, wanted: DataFrame) -> DataFrame:
        """Rows (key, rep, n, used, pos): the prefix tokens of the wanted documents, rarest first.

        Two sets with Jaccard similarity t or more share a token among the first
        n - ceil(t n) + 1 of each, in any common order.  In order of rarity, what
        many documents share comes last, so a common passage makes no candidates.
        """
        docs = self.texts.join(wanted.withColumnRenamed("rep", "rid"), "rid", "left_semi")
        tokens, path = _shared.materialize(docs.select("rid", "text").mapInArrow(_tokens(self.k), "rep bigint, n bigint, key bigint"), "tokens")
        common, freq = _shared.materialize(tokens.groupBy("key").agg(F.count(F.lit(1)).alias("df")).where("df > 1"), "frequencies")
        mine = Window.partitionBy("rep")
        ranked = tokens.join(common, "key").select(
            "key", "rep", "n",
            (F.col("n") - F.count(F.lit(1)).over(mine) + F.row_number().over(mine.orderBy("df", "key")) - 1).alias("pos"),
        )
        prefix = F.col("n") - F.ceil(F.col("n") * self.t - 1e-9) + 1
        out, _ = _shared.materialize(ranked.where(F.col("pos") < prefix).select("key", "rep", "n", F.lit(False).alias("used"), "pos"), "members")
        _shared.discard(self.texts.sparkSession, path, freq)
        return out


def _agreement(threshold: float, places: int) -> int:
    """The least number of equal places of two short signatures that a pair at the threshold misses with probability under 1e-9."""
    from math import comb

    tail, k = 0.0, 0
    while True:
        tail += comb(places, k) * threshold**k * (1 - threshold) ** (places - k)
        if tail > 1e-9:
            return k
        k += 1


def _classes(base: DataFrame, threshold: float, k: int, bands: int, per: int, centres: int) -> tuple[DataFrame, DataFrame]:
    """From stored rows (rid, doc_id, text, in buckets of rid): signed rows, and per group of equal multisets (fp1, fp2) its node and component."""
    spark = base.sparkSession
    signed, _ = _shared.materialize(
        base.select("rid", "doc_id", "text").mapInArrow(
            _sign(bands, per, k), "rid bigint, doc_id bigint, n bigint, fp1 bigint, fp2 bigint, sig binary, bands array<bigint>"), "signed")
    # copies are folded before anything else travels; a group is named after its least row
    groups, _ = _shared.materialize(
        signed.where("n > 0").groupBy("fp1", "fp2").agg(
            F.min("rid").alias("rep"), F.count(F.lit(1)).alias("size"), F.first("n").alias("n"), F.first("sig").alias("sig"), F.first("bands").alias("bands")), "groups")
    rows = groups.select("rep", "n", F.explode("bands").alias("key"))
    held = rows.groupBy("key").agg(F.min("rep").alias("c"), F.max("rep").alias("hi")).where("c < hi").select("key", "c")
    held, keys_at = _shared.materialize(held, "keys")
    members, _ = _shared.materialize(rows.join(held, "key").select("key", "rep", "n", (F.col("rep") == F.col("c")).alias("used"), F.lit(0).cast("bigint").alias("pos"), "c"), "members")
    _shared.discard(spark, keys_at)
    state = _Links(base.select("rid", "text"), groups.select("rep", "n", "sig"), threshold, k, _agreement(threshold, bands * per))
    # every member of a bucket against one centre: this settles groups of copies
    state.settle(members.where("rep <> c").select(F.col("c").alias("u"), F.col("rep").alias("v")))
    left = state.still_open(members.drop("c")).select("rep").distinct()
    if not left.isEmpty():
        members, slots = state.prefixes(left), centres
        while True:
            live = state.still_open(members)
            if live.isEmpty():
                break
            members = state.one_round(live, slots)
            slots *= 4  # few keys stay open for long: rounds stay logarithmic in their size
    found = groups.select("fp1", "fp2", "rep", "size").join(state.label.withColumnRenamed("node", "rep"), "rep", "left")
    return signed, found.select("fp1", "fp2", F.coalesce("comp", "rep").alias("comp"), ((F.col("size") > 1) | F.col("comp").isNotNull()).alias("shared"))


def _stored(docs: DataFrame) -> DataFrame:
    """``docs`` with a row id ``rid``, stored in buckets of it: texts travel once, whatever is joined to them later."""
    spark = docs.sparkSession
    rows = docs.select(F.monotonically_increasing_id().alias("rid"), "*")
    return _shared.bucketed(rows, "rid", _shared.buckets(spark, docs.rdd.getNumPartitions()), "rows")


def near_duplicates(
    docs: DataFrame,
    id_col: str = "doc_id",
    text: str = "text",
    threshold: float = 0.8,
    k: int = 5,
    bands: int = 32,
    per: int = 4,
    centres: int = 8,
) -> DataFrame:
    """One row per input row: ``doc_id, class_id`` (least doc_id of the class), ``n_shingles``."""
    _shared.ship(docs.sparkSession)
    base = _stored(docs.select(F.col(f"`{id_col}`").cast("bigint").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text")))
    signed, found = _classes(base, threshold, k, bands, per, centres)
    found, _ = _shared.materialize(found.where("shared").drop("shared"), "classes")
    own = signed.select("doc_id", "n", "fp1", "fp2")
    shared = own.where("n > 0").join(found, ["fp1", "fp2"]).where("doc_id is not null")
    # a doc_id with several texts is one document: its texts' components are one class
    twice, _ = _shared.materialize(own.where("doc_id is not null").groupBy("doc_id").agg(F.count(F.lit(1)).alias("rows")).where("rows > 1").select("doc_id"), "twice")
    least, _ = _shared.materialize(shared.groupBy("comp").agg(F.min("doc_id").alias("class_id")), "least")
    if not twice.isEmpty():
        doc, part = F.xxhash64(F.lit("doc"), "doc_id"), F.xxhash64(F.lit("part"), "comp")
        meets = shared.join(twice, "doc_id", "left_semi").select(doc.alias("u"), part.alias("v")).distinct()
        joined = components(_shared.materialize(meets, "meets")[0]).withColumnRenamed("comp", "joint")
        named = least.withColumn("node", part).join(joined, "node", "left")
        lowest = named.where("joint is not null").groupBy("joint").agg(F.min("class_id").alias("lowest"))
        least = named.join(lowest, "joint", "left").select("comp", F.coalesce("lowest", "class_id").alias("class_id"))
        least, _ = _shared.materialize(least, "least")
    named, _ = _shared.materialize(found.join(least, "comp").select("fp1", "fp2", "class_id"), "named")
    full = own.where("n > 0").join(named, ["fp1", "fp2"], "left").select("doc_id", F.coalesce("class_id", "doc_id").alias("class_id"), F.col("n").alias("n_shingles"))
    out = full.unionByName(own.where("n = 0").select("doc_id", F.col("doc_id").alias("class_id"), F.col("n").alias("n_shingles")))
    if twice.isEmpty():
        return out
    # rows of a repeated doc_id that have no component of their own take the class of the others
    some = out.join(twice, "doc_id", "left_semi").groupBy("doc_id").agg(F.min("class_id").alias("joint"))
    some, _ = _shared.materialize(some, "joint")
    return out.join(some, "doc_id", "left").select("doc_id", F.coalesce("joint", "class_id").alias("class_id"), "n_shingles")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """One row, unchanged, of each group of similar texts: that of the least doc_id (null last; then the least text hash).

    Rows are judged by their own texts, so that no text goes without a similar
    one staying, also where a doc_id holds several; rows without words stay.
    """
    _shared.ship(docs.sparkSession)
    inner = [F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(docs.columns)]
    base = _stored(docs.select(F.struct(*inner).alias("row")))
    own = lambda name, kind: F.col(f"row.c{docs.columns.index(name)}").cast(kind)
    signed, found = _classes(base.select("rid", own(id_col, "bigint").alias("doc_id"), own(text, "string").alias("text")), 0.8, 5, 32, 4, 8)
    shared, _ = _shared.materialize(found.where("shared").drop("shared"), "classes")
    rows, _ = _shared.materialize(signed.where("n > 0").select("rid", "doc_id", "fp1", "fp2").join(shared, ["fp1", "fp2"]).select("rid", "doc_id", "fp1", "comp"), "shared")
    rank = F.struct(F.col("doc_id").isNull().alias("no"), "doc_id", "fp1", "rid")
    first, _ = _shared.materialize(rows.groupBy("comp").agg(F.min(rank).alias("f")).select("comp", F.col("f.rid").alias("first")), "first")
    gone, _ = _shared.materialize(rows.join(first, "comp").where("rid <> first").select("rid"), "gone")
    rest = base.join(gone.hint("shuffle_hash"), "rid", "left_anti")
    return rest.select(*[F.col(f"row.c{k}").alias(c) for k, c in enumerate(docs.columns)])


def query(spark, sf_dir):
    return near_duplicates(_shared.table(spark, sf_dir, "documents"))
