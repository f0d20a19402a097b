"""Benchmark decontamination with one Aho-Corasick automaton.

Texts are normalised by lower-casing A-Z and reading every other ASCII byte
outside ``0-9a-z`` as a word break; bytes of non-ASCII characters belong to
words.  Every run of ``window`` item words (or a whole shorter item) is one
pattern.  Each document is scanned once; hits are mapped back to word numbers
and, on request, to code point offsets of the original text.

Patterns are made from the items by tasks and their bytes are added up.  An
automaton takes about 32 bytes of memory for each of them, so at most
``max_bytes`` of patterns (6 MB, some 200 MB of memory in a Python worker) make
one automaton: a benchmark of that size is one broadcast automaton and one scan.
A larger one is dealt by hash into as many automata as it needs; they are built
one at a time, each scans the documents once, and the hits of all scans are
merged.  There is no upper limit, and no item is dropped.

Defined cases: null texts have no words; empty items give no pattern; an item
id that repeats counts once; items without an id hit like others, count together
as one item and are not in the list of ids; an empty benchmark leaves every
document clean; very long texts are scanned whole; repeated rows are scanned
each; extra columns are ignored, also those named like outputs.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomcast.llm._shared import discard, materialize, ship, table

#: ASCII word characters are 0-9 and a-z after lower-casing; other ASCII breaks words.
_FOLD = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20
    for b in range(256)
)
_AUTOMATA: dict = {}


def words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(_FOLD).split()


def windows_of(text: str | None, window: int) -> list[tuple[bytes, int]]:
    """(pattern, words in it) of an item."""
    w = words(text)
    n = min(window, len(w))
    return [(b" ".join([b"", *w[i : i + n], b""]), n) for i in range(len(w) - n + 1)] if n else []


def build(rows: list[tuple]):
    """The automaton of (pattern, words, item id) rows, or None where there are none."""
    import ahocorasick

    found: dict[bytes, tuple[int, set]] = {}
    for pattern, n, item in rows:
        found.setdefault(bytes(pattern), (n, set()))[1].add(item)
    if not found:
        return None
    made = ahocorasick.Automaton()
    for pattern, value in found.items():
        made.add_word(pattern.decode("latin-1"), value)
    made.make_automaton()
    return made


def _automaton(shard: tuple):
    """The automaton of a shard (name, broadcast); a worker holds one at a time."""
    name, rows = shard
    if name not in _AUTOMATA:
        _AUTOMATA.clear()
        _AUTOMATA[name] = build(rows.value)
    return _AUTOMATA[name]


def scan(text: str | None, automaton) -> tuple[int, list[tuple[int, int]], set]:
    """Number of words, merged hit runs [first word, past last), and items found."""
    w = words(text)
    runs: list[tuple[int, int]] = []
    items: set = set()
    if w and automaton is not None:
        hay = b" ".join([b"", *w, b""]).decode("latin-1")
        ends: np.ndarray | None = None
        for at, (n, ids) in automaton.iter(hay):
            if ends is None:
                ends = np.cumsum([len(x) + 1 for x in w])
            last = int(np.searchsorted(ends, at))
            runs.append((last - n + 1, last + 1))
            items |= ids
        runs = _merge(runs)
    return len(w), runs, items


def _merge(runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted(runs):
        if out and a <= out[-1][1]:
            out[-1][1] = max(b, out[-1][1])
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def original_spans(text: str, runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Code point offsets in ``text`` of runs of word numbers."""
    if not runs:
        return []
    raw = text.encode("utf-8", "surrogatepass")
    folded = np.frombuffer(raw.translate(_FOLD), dtype=np.uint8)
    gap = folded == 0x20
    start = np.flatnonzero(~gap & np.concatenate([[True], gap[:-1]]))
    end = np.flatnonzero(~gap & np.concatenate([gap[1:], [True]])) + 1
    chars = np.concatenate([[0], np.cumsum((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80)])
    return [(int(chars[start[a]]), int(chars[end[b - 1]])) for a, b in runs]


def _dealt(benchmark: DataFrame, item_id: str, item_text: str, window: int, max_bytes: int) -> Iterator:
    """The patterns of the items as broadcast shards of about ``max_bytes``, one after the other."""
    spark = benchmark.sparkSession

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(p, n, i) for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for p, n in windows_of(t, window)]
            columns = list(zip(*rows, strict=True)) if rows else [(), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.binary(), pa.int32(), pa.string()), strict=True)], names=["pattern", "n", "item"])

    items = benchmark.select(F.col(f"`{item_id}`").cast("string").alias("item"), F.col(f"`{item_text}`").cast("string").alias("text"))
    rows, path = materialize(items.mapInArrow(cut, "pattern binary, n int, item string").distinct(), "patterns")
    size = rows.agg(F.coalesce(F.sum(F.octet_length("pattern")), F.lit(0))).head()[0]
    shards = max(1, -(-size // max_bytes))
    for k in range(shards):
        mine = rows.where(F.pmod(F.xxhash64("pattern", "item"), F.lit(shards)) == k) if shards > 1 else rows
        yield k, shards, (f"{path} {k}", spark.sparkContext.broadcast([tuple(r) for r in mine.collect()]))
    discard(spark, path)


def keep_clean(
    docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text",
    window: int = 10, max_bytes: int = 6 << 20,
) -> DataFrame:
    """The rows of ``docs``, unchanged, that hold no window of any item."""
    ship(docs.sparkSession)
    at = docs.columns.index(text)
    for k, shards, shard in _dealt(benchmark, item_id, item_text, window, max_bytes):

        def run(batches: Iterator[pa.RecordBatch], shard=shard) -> Iterator[pa.RecordBatch]:
            automaton = _automaton(shard)
            for batch in batches:
                yield batch.filter(pa.array([not scan(t.as_py(), automaton)[1] for t in batch.column(at)], pa.bool_()))

        docs = docs.mapInArrow(run, docs.schema)
        if k + 1 < shards:
            docs, _ = materialize(docs, "clean")
    return docs


_SPANS = pa.list_(pa.struct([("first", pa.int32()), ("past", pa.int32()), ("start", pa.int32()), ("end", pa.int32())]))
_HITS = "n_words bigint, runs array<struct<first:int,past:int,start:int,end:int>>, items array<string>"
_OUT = pa.schema([
    ("n_words", pa.int64()), ("n_hit", pa.int64()), ("n_items", pa.int64()), ("items_sha256", pa.string()),
    ("contaminated", pa.bool_()), ("spans", pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))),
    ("item_ids", pa.list_(pa.string())),
])
OUT = (
    "n_words bigint, n_hit bigint, n_items bigint, items_sha256 string, contaminated boolean, "
    "spans array<struct<start:int,end:int>>, item_ids array<string>"
)


def _scanned(shard):
    """(id, n_words, runs in words and code points, items) of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = _automaton(shard)
        for batch in batches:
            counts, runs, items = [], [], []
            for value in batch.column(1):
                t = value.as_py()
                n, found, ids = scan(t, automaton)
                counts.append(n)
                runs.append([{"first": a, "past": b, "start": x, "end": y} for (a, b), (x, y) in zip(found, original_spans(t or "", found), strict=True)])
                items.append(list(ids))
            made = [pa.array(counts, pa.int64()), pa.array(runs, _SPANS), pa.array(items, pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *made], names=["id", "n_words", "runs", "items"])

    return run


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Output columns of rows (id, n_words, runs, items), the runs of several scans merged."""
    for batch in batches:
        cols: list[list] = [[] for _ in _OUT]
        for n, runs, items in zip(*(batch.column(k).to_pylist() for k in (1, 2, 3)), strict=True):
            chars = {}
            for r in runs:
                chars[r["first"]] = min(chars.get(r["first"], r["start"]), r["start"])
                chars[-r["past"]] = max(chars.get(-r["past"], r["end"]), r["end"])
            merged = _merge([(r["first"], r["past"]) for r in runs])
            every = set(items)
            ids = sorted(x for x in every if x is not None)
            row = (n, sum(b - a for a, b in merged), len(every), hashlib.sha256(",".join(ids).encode("utf-8", "surrogatepass")).hexdigest(), bool(merged),
                   [{"start": chars[a], "end": chars[-b]} for a, b in merged], ids)
            for c, x in zip(cols, row, strict=True):
                c.append(x)
        yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, type=f.type) for c, f in zip(cols, _OUT, strict=True))], names=["doc_id", *_OUT.names])


def decontaminate(
    docs: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    window: int = 10,
    max_bytes: int = 6 << 20,
) -> DataFrame:
    """Per row: word and hit counts, items found, and hit spans in the original text."""
    ship(docs.sparkSession)
    source = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text}`").cast("string").alias("text"))
    kind = source.schema["id"].dataType.simpleString()
    hits = []
    for k, shards, shard in _dealt(benchmark, item_id, item_text, window, max_bytes):
        if shards == 1:
            return source.mapInArrow(_scanned(shard), f"id {kind}, {_HITS}").mapInArrow(_digest, f"doc_id {kind}, {OUT}")
        if not hits:
            source, _ = materialize(source.select(F.monotonically_increasing_id().alias("rid"), "id", "text"), "rows")
        found = source.select("rid", "text").mapInArrow(_scanned(shard), f"id bigint, {_HITS}")
        # the first scan keeps every row, for the number of words; the others those with hits
        hits.append(materialize(found.where("size(runs) > 0") if k else found, "hits")[0])
    every = reduce(DataFrame.unionByName, hits).groupBy("id").agg(
        F.max("n_words").alias("n_words"), F.flatten(F.collect_list("runs")).alias("runs"), F.flatten(F.collect_list("items")).alias("items"))
    named = every.withColumnRenamed("id", "rid").join(source.select("rid", "id"), "rid").select("id", "n_words", "runs", "items")
    return named.mapInArrow(_digest, f"doc_id {kind}, {OUT}")


def query(spark, sf_dir):
    return decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
