"""Substring dedup by level-wise doubling of repeated windows.

A window of ``window`` consecutive words is removed from every place but its
first (smaller doc_id, then earlier start); a word goes when any removed window
covers it.  Comparing every window of the corpus at full length would shuffle a
row for each word, so windows grow by levels:

1. Every full-length window has one *anchor*: its least-hashed run of ``base``
   words.  Equal windows have equal anchors, so only anchors (about one word in
   eight for base 5) are compared at the first level.
2. Anchors whose run repeats somewhere survive, and theirs alone are extended:
   the runs of twice the length around them are compared next, and so on while
   twice the length is below ``window``.  The first level that no candidate
   reaches ends the work.
3. Full-length windows whose anchor survived every level are compared by a
   128-bit hash, and the first place of each is found.

Each level is one small exchange.  Documents are dealt once into blocks of
neighbouring doc_ids, kept in a table bucketed by block.  A block sends each
distinct hash once per bucket of the hash space (so a window copied a million
times costs a row per block, never a row per copy), packed as one binary row;
the bucket answers with one bit per hash, and the answers are joined back to
the bucketed blocks without moving texts again.  There is a bucket for each
``bucket_bytes`` of text, so that what one group holds does not grow with the
corpus.  False matches of the 64-bit hashes of the lower levels only let more
candidates through; the last level compares two independent 64-bit hashes.

Defined cases: null texts have no words; a null doc_id sorts first; rows that
repeat a doc_id are judged in the order of their text; of equal windows the first
in that order stays; very long texts are one row of a block; rows are never
dropped; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomcast.llm import _shared, _words

_FULL = {"uid": "bigint", "texts": "array<string>", "ids": "array<bigint>"}


def anchors(runs: np.ndarray, starts: np.ndarray, span: int) -> np.ndarray:
    """For windows at ``starts``, the position of the least of the ``span`` run hashes from there (leftmost on ties)."""
    at = np.arange(len(runs))
    size = 1
    while size < span:
        step = min(size, span - size)
        left, right = at[: len(at) - step], at[step:]
        at = np.where(runs[left] <= runs[right], left, right)
        size += step
    return at[starts]


class Slice:
    """The words of a slice of a block and the hashes of its windows."""

    def __init__(self, texts: pa.Array, window: int, base: int) -> None:
        self.w = _words.Words(texts)
        self.h = self.w.hashes()
        self.window, self.base = window, base
        self.starts = _words.window_starts(self.w, window)
        runs = _words.windows(self.h, base)
        owner = anchors(runs, self.starts, window - base + 1) if len(self.starts) else np.zeros(0, np.int64)
        #: anchor positions, and for each window the index of its anchor
        self.anchor, self.owner = np.unique(owner, return_inverse=True)
        self.low = self.w.first[:-1].repeat(self.w.counts)
        self.high = self.w.first[1:].repeat(self.w.counts)

    def level(self, length: int) -> tuple[np.ndarray, np.ndarray]:
        """(hash, anchor index) of the runs of ``length`` words that contain an anchor's base run, in steps of base."""
        hashes, who = [], []
        runs = _words.windows(self.h, length)
        every = np.arange(len(self.anchor))
        for j in range(length // self.base):
            at = self.anchor - j * self.base
            ok = (at >= self.low[self.anchor]) & (at + length <= self.high[self.anchor])
            hashes.append(runs[at[ok]])
            who.append(every[ok])
        return np.concatenate(hashes) if hashes else np.zeros(0, np.uint64), np.concatenate(who) if who else every

    def full(self, alive: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Windows whose anchor is alive: two hashes and the start word."""
        at = self.starts[alive[self.owner]] if len(self.starts) else self.starts
        return _words.windows(self.h, self.window)[at], _words.windows(self.w.hashes(1), self.window)[at], at


class Block:
    """All slices of one block row, and the levels replayed from the answers so far."""

    def __init__(self, texts: pa.Array, window: int, base: int) -> None:
        batch = pa.RecordBatch.from_arrays([texts], names=["t"])
        self.slices = [Slice(b.column(0), window, base) for b in _words.slices(batch, "t")]
        self.alive = [np.ones(len(s.anchor), dtype=bool) for s in self.slices]
        self.window, self.base = window, base

    def hashes(self, length: int) -> tuple[np.ndarray, np.ndarray, list]:
        """Distinct hashes of a level, whether each occurs twice or more here, and where each came from."""
        parts = []
        for s, alive in zip(self.slices, self.alive, strict=True):
            h, who = s.level(length)
            parts.append((h[alive[who]], who[alive[who]]))
        every = np.concatenate([p[0] for p in parts]) if parts else np.zeros(0, np.uint64)
        distinct, back, count = np.unique(every, return_inverse=True, return_counts=True)
        return distinct, count > 1, [back, [p[1] for p in parts]]

    def keep(self, repeated: np.ndarray, source: list) -> None:
        back, who = source
        at = 0
        for k, mine in enumerate(who):
            hit = repeated[back[at : at + len(mine)]]
            at += len(mine)
            alive = np.zeros_like(self.alive[k])
            alive[mine[hit]] = True
            self.alive[k] &= alive

    def replay(self, answers: dict[int, np.ndarray]) -> None:
        for length in sorted(answers):
            distinct, local, source = self.hashes(length)
            self.keep(local | answers[length], source)

    def final(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, list]:
        """Distinct full windows (two hashes), index of the first occurrence of each, and all occurrences."""
        parts = [s.full(a) for s, a in zip(self.slices, self.alive, strict=True)]
        a, b = (np.concatenate([p[i] for p in parts]) if parts else np.zeros(0, np.uint64) for i in (0, 1))
        order = np.lexsort((b, a))
        new = np.ones(len(a), dtype=bool)
        sa, sb = a[order], b[order]
        new[1:] = (sa[1:] != sa[:-1]) | (sb[1:] != sb[:-1])
        back = np.empty(len(a), dtype=np.int64)
        back[order] = np.cumsum(new) - 1
        first = order[new]  # lexsort is stable: the earliest occurrence leads its group
        return sa[new], sb[new], first, [back, [p[2] for p in parts]]


def buckets_of(h: np.ndarray, n: int) -> np.ndarray:
    return (h >> np.uint64(33)) % np.uint64(n)


def _read(column: pa.Array, i: int) -> pa.Array:
    return column.slice(i, 1).flatten()


def _unpack(batch: pa.RecordBatch, i: int) -> dict[int, dict[int, bytes]]:
    """level -> bucket -> bits, from the joined answers of a block."""
    got: dict[int, dict[int, bytes]] = {}
    for a in batch.column(batch.schema.get_field_index("answers"))[i].as_py() or ():
        got.setdefault(a["level"], {})[a["bucket"]] = a["bits"]
    return got


def _bits(distinct: np.ndarray, by_bucket: dict[int, bytes], n: int) -> np.ndarray:
    out = np.zeros(len(distinct), dtype=bool)
    bucket = buckets_of(distinct, n)
    order = np.argsort(bucket, kind="stable")
    edges = np.searchsorted(bucket[order], np.arange(n + 1))
    for k, raw in by_bucket.items():
        at = order[edges[k] : edges[k + 1]]
        out[at] = np.unpackbits(np.frombuffer(raw, np.uint8), count=len(at)).astype(bool)
    return out


def _restore(batch: pa.RecordBatch, i: int, window: int, base: int, n: int) -> Block:
    block = Block(_read(batch.column(batch.schema.get_field_index("texts")), i), window, base)
    got = _unpack(batch, i)
    for length in sorted(k for k in got if k > 0):
        distinct, local, source = block.hashes(length)
        block.keep(local | _bits(distinct, got[length], n), source)
    return block


def _send(block: int, level: int, n: int, hashes: list[np.ndarray]) -> Iterator[tuple]:
    bucket = buckets_of(hashes[0], n)
    order = np.argsort(bucket, kind="stable")
    edges = np.searchsorted(bucket[order], np.arange(n + 1))
    for k in range(n):
        at = order[edges[k] : edges[k + 1]]
        if len(at):
            yield level, k, block, b"".join(h[at].tobytes() for h in hashes), len(at)


_SENT = "level int, bucket int, block bigint, packed binary, n int"
_SENT_ARROW = pa.schema([("level", pa.int32()), ("bucket", pa.int32()), ("block", pa.int64()), ("packed", pa.binary()), ("n", pa.int32())])
_ANSWER = "block bigint, level int, bucket int, bits binary"


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [[] for _ in schema]
    return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def _emit(length: int, window: int, base: int, n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(batch.schema.get_field_index("block"))
            for i in range(batch.num_rows):
                block = _restore(batch, i, window, base, n)
                if length < window:
                    hashes = [block.hashes(length)[0]]
                else:
                    a, b, *_ = block.final()
                    hashes = [a, b]
                rows = list(_send(ids[i].as_py(), length if length < window else 0, n, hashes))
                del block
                yield _batch(rows, _SENT_ARROW)

    return run


def _settle(first: bool):
    """Answer a bucket: lower levels, is the hash also in another block; full windows, is an earlier block the first."""

    def run(table: pa.Table) -> pa.Table:
        block = table.column("block").to_numpy()
        order = np.argsort(block, kind="stable")
        packed = table.column("packed").combine_chunks() if table.num_rows else []
        sizes = table.column("n").to_numpy()[order]
        raw = [np.frombuffer(packed[int(i)].as_buffer(), np.uint64) for i in order]
        ends = np.cumsum(sizes)
        a = np.concatenate([r[:m] for r, m in zip(raw, sizes, strict=True)])
        at = np.lexsort((np.concatenate([r[m:] for r, m in zip(raw, sizes, strict=True)]), a)) if first else np.argsort(a, kind="stable")
        same = a[at][1:] == a[at][:-1]
        if first:
            b = np.concatenate([r[m:] for r, m in zip(raw, sizes, strict=True)])
            same &= b[at][1:] == b[at][:-1]
        flag = np.zeros(len(a), dtype=bool)
        flag[at[1:]] = same  # the sorts are stable: all but the first block's entry
        if not first:
            flag[at[:-1]] |= same
        bits = [np.packbits(flag[e - m : e]).tobytes() for e, m in zip(ends, sizes, strict=True)]
        level, bucket = table.column("level")[0].as_py(), table.column("bucket")[0].as_py()
        k = len(bits)
        return pa.table({"block": pa.array(block[order]), "level": pa.array([level] * k, pa.int32()),
                         "bucket": pa.array([bucket] * k, pa.int32()), "bits": pa.array(bits, pa.binary())})

    return run


def _pack(limit: int):
    """Turn a doc_id-sorted partition into block rows of about ``limit`` text bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, k = TaskContext.get().partitionId(), 0
        held: list[pa.RecordBatch] = []
        size = 0

        def flush():
            nonlocal k, held, size
            t = pa.Table.from_batches(held).combine_chunks()
            out = pa.RecordBatch.from_arrays(
                [pa.array([(part << 32) + k], pa.int64()), pa.array([0], pa.int32()),
                 *[pa.ListArray.from_arrays(pa.array([0, t.num_rows], pa.int32()), t.column(c).combine_chunks()) for c in ("doc_id", "text")]],
                names=["block", "spare", "ids", "texts"],
            )
            k, held, size = k + 1, [], 0
            return out

        for batch in batches:
            for piece in _words.slices(batch, "text", limit):
                held.append(piece)
                size += piece.column(1).nbytes
                if size >= limit:
                    yield flush()
        if held:
            yield flush()

    return run


def _apply(window: int, base: int, n: int, out_type):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                block = _restore(batch, i, window, base, n)
                a, _, first, (back, starts) = block.final()
                late = _bits(a, _unpack(batch, i).get(0, {}), n)
                gone = late[back]
                gone |= first[back] != np.arange(len(back))
                ids = _read(batch.column(batch.schema.get_field_index("ids")), i)
                row = at = 0
                for s, mine in zip(block.slices, starts, strict=True):
                    bad = mine[gone[at : at + len(mine)]]
                    at += len(mine)
                    count = len(s.w.counts)
                    yield _kept(s, bad, window, ids.slice(row, count))
                    row += count
                del block

    return run


def _kept(s: Slice, bad: np.ndarray, window: int, ids: pa.Array) -> pa.RecordBatch:
    """Texts of a slice without the words under the windows at ``bad``."""
    w = s.w
    total = len(w.starts)
    delta = np.zeros(total + 1, dtype=np.int32)
    np.add.at(delta, bad, 1)
    np.add.at(delta, bad + window, -1)
    keep = np.cumsum(delta[:-1]) == 0
    kept_before = np.concatenate([[0], np.cumsum(keep)])
    n_kept = kept_before[w.first[1:]] - kept_before[w.first[:-1]]
    # bytes of the kept words, each followed by one space
    starts, ends = w.starts[keep], w.ends[keep]
    lens = ends - starts
    sizes = lens + 1
    to = np.cumsum(sizes) - sizes
    out = np.full(int(sizes.sum()), 0x20, dtype=np.uint8)
    shift = np.repeat(starts - to, lens)
    place = np.repeat(to, lens) + (np.arange(int(lens.sum())) - np.repeat(np.cumsum(lens) - lens, lens))
    out[place] = w.data[place + shift]
    edge = np.concatenate([to, [len(out)]])[np.concatenate([[0], np.cumsum(n_kept)])]
    data = out.tobytes()
    texts = [data[a : b - 1] if b > a else b"" for a, b in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True)]
    return pa.RecordBatch.from_arrays(
        [ids, pa.array(w.counts.astype(np.int64)), pa.array((w.counts - n_kept).astype(np.int64)),
         pa.array([hashlib.sha256(t).hexdigest() for t in texts]), pa.array([t.decode("utf-8", "surrogatepass") for t in texts])],
        names=["doc_id", "n_words", "n_removed", "kept_sha256", "kept_text"],
    )


def levels(window: int, base: int) -> list[int]:
    out, k = [], base
    while k < window:
        out.append(k)
        k *= 2
    return out


def dedup_substrings(
    docs: DataFrame,
    id_col: str = "doc_id",
    text: str = "text",
    window: int = 20,
    base: int = 5,
    block_bytes: int = 4 << 20,
    bucket_bytes: int = 64 << 20,
) -> DataFrame:
    """Per row: ``doc_id, n_words, n_removed, kept_sha256, kept_text``."""
    if not 0 < base <= window:
        raise ValueError("base must be from 1 to window")
    spark = docs.sparkSession
    _shared.ship(spark)
    source = docs.select(F.col(f"`{id_col}`").cast("bigint").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text"))
    size = source.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).head()[0]
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // bucket_bytes))
    name, path = f"loomcast_blocks_{_shared.uuid.uuid4().hex}", _shared.scratch(spark, "blocks")
    (
        # the beginning of the text tells rows of a hot or null id apart and keeps their order
        source.repartitionByRange("doc_id", F.substring("text", 1, 64))
        .sortWithinPartitions("doc_id", "text")
        .mapInArrow(_pack(block_bytes), "block bigint, spare int, ids array<bigint>, texts array<string>")
        .drop("spare")
        .write.bucketBy(_shared.buckets(spark, n), "block").option("path", path).option("compression", "zstd").saveAsTable(name)
    )
    blocks = spark.table(name)
    answers = spark.createDataFrame([], _ANSWER)

    def joined() -> DataFrame:
        got = answers.groupBy("block").agg(F.collect_list(F.struct("level", "bucket", "bits")).alias("answers"))
        return blocks.join(got.hint("shuffle_hash"), "block", "left")

    for length in [*levels(window, base), window]:
        sent = joined().mapInArrow(_emit(length, window, base, n), _SENT)
        settle = _settle(length == window)
        new, _ = _shared.materialize(sent.groupBy("bucket").applyInArrow(settle, _ANSWER), "answers")
        answers = answers.unionByName(new)
        if new.isEmpty():
            break  # no candidate survived the level before
    out = "doc_id bigint, n_words bigint, n_removed bigint, kept_sha256 string, kept_text string"
    return joined().mapInArrow(_apply(window, base, n, None), out)


def query(spark, sf_dir):
    return dedup_substrings(_shared.table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", "kept_sha256")
