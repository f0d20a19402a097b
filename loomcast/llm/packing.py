"""Lexical retrieval packing.

Every document is tokenised once.  Document frequencies, the number of
documents and their mean length are counted over the whole corpus.  Documents
are then dealt in *lexical order*: by the tokens that a weighted min-hash picks
from them (rarer tokens are picked more often), so that copies and documents on
one subject come to lie side by side.  A run of ``shard_bytes`` in that order
is a shard with a BM25 index of its own, under the statistics of the corpus.

In a shard the first unused document is the seed of a window.  All its terms
are looked up, and its unused neighbours fill the window greedily, best first;
where a document crosses the end of the window, its rest seeds the next one.
Where no unused neighbour shares a term, the next unused document is taken.
Windows are full, so padding is nil: what is left at the end of a task is cut
at powers of two.

Within a shard retrieval is exact (no term, posting or neighbour is left out);
neighbours in other shards are not seen.  The README states the share of true
nearest neighbours that lie in a document's shard.  Shards are cut by bytes and
a hot lexical key runs over several, so the work grows with the corpus and a
task's memory does not.

Tokens: ids of the tokenizer file, then one end id.  Where the same vocabulary
is also at hand as ranks, they are used for speed; both give equal ids (tested
over all code points), and a text that the fast encoder refuses goes to the
tokenizer file.  The files are read on the driver and sent to the executors.

Defined cases: a null text is empty and yields one end id; rows that repeat a
doc_id are packed each as its own document; null ids stay null; ties are in
lexical order; very long texts are tokenised whole and cut over windows; an
empty table gives no pieces; extra columns are ignored.
"""

from __future__ import annotations

import base64
import zlib
from collections.abc import Callable, Iterator
from functools import cache
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomcast.llm import _shared
from loomcast.llm._words import mix

_U = np.uint64
#: From so many neighbours of one window on they are ranked at once instead of being looked for one by one.
MANY = 12
#: Terms in more than this share of a shard's documents have a row of weights over all of them instead of postings.
COMMON = 0.125
_ENCODERS: dict[int, Callable] = {}


def encoder(vocabulary: bytes, ranks: bytes | None = None, pattern: str | None = None, specials: tuple = ()) -> Callable[[str], np.ndarray]:
    """text -> uint32 token ids, from the contents of a tokenizer file and, for speed, of the same vocabulary as ranks."""
    key = hash((vocabulary, ranks))
    if key in _ENCODERS:
        return _ENCODERS[key]
    slow: list = []

    def by_file(text: str) -> np.ndarray:
        if not slow:
            from tokenizers import Tokenizer

            slow.append(Tokenizer.from_str(vocabulary.decode()))
        return np.asarray(slow[0].encode(text, add_special_tokens=False).ids, dtype=np.uint32)

    made = by_file
    if ranks:
        import tiktoken

        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines())}
        fast = tiktoken.Encoding("packing", pat_str=pattern, mergeable_ranks=table, special_tokens=dict(specials))

        def made(text: str) -> np.ndarray:
            try:
                return fast.encode_to_numpy(text, allowed_special="all")
            except (KeyboardInterrupt, SystemExit):
                raise
            except BaseException:  # the pattern's backtracking limit, or a panic of the native code
                return by_file(text)

    _ENCODERS[key] = made
    return made


class Index:
    """BM25 weights of documents over token ids, under the statistics of a corpus (df by id, n, mean length).

    Rare terms have postings.  Common ones, most of what a seed looks up, have a row each, and rows are added up
    (in single precision, as weights are held) where postings are gathered one by one; a row has at most eight times as
    many cells as the term has postings.
    """

    def __init__(self, docs: list[np.ndarray], corpus: tuple | None = None, k1: float = 1.2, b: float = 0.75) -> None:
        self.own, counts = zip(*[np.unique(d, return_counts=True) for d in docs], strict=True)
        length = np.array([len(d) for d in docs], np.float32)
        held = np.array([len(t) for t in self.own])
        who, term, tf = np.repeat(np.arange(len(docs), dtype=np.int32), held), np.concatenate(self.own), np.concatenate(counts)
        order = np.argsort(term, kind="stable")
        self.terms, here = np.unique(term[order], return_counts=True)
        df, n, mean = (corpus[0][self.terms], *corpus[1:]) if corpus else (here, len(docs), length.mean())
        idf = np.repeat(np.log1p((n - df + 0.5) / (df + 0.5)).astype(np.float32), here)
        tf, who = tf[order].astype(np.float32), who[order].astype(np.intp)
        weight = idf * tf * np.float32(k1 + 1) / (tf + np.float32(k1) * (np.float32(1 - b) + np.float32(b / mean) * length[who]))
        self.n, self.live = len(docs), np.arange(len(docs))  # the columns of the rows
        common = here > COMMON * self.n
        self.row = np.where(common, np.cumsum(common) - 1, -1)
        self.rows = np.zeros((int(common.sum()), self.n), np.float32)
        row = np.repeat(self.row, here)
        rare = row < 0
        self.rows[row[~rare], who[~rare]] = weight[~rare]
        self.who, self.weight = who[rare], weight[rare].astype(float)  # as bincount takes them
        self.at = np.cumsum([0, *np.where(common, 0, here)])

    def drop(self, used: np.ndarray) -> None:
        """Leave out the weights of documents that are used, once a fifth of those at hand are."""
        if self.n - used.sum() > 0.8 * len(self.live):
            return
        keep = ~used[self.who]
        self.at = np.concatenate([[0], np.cumsum(keep)])[self.at]
        self.who, self.weight = self.who[keep], self.weight[keep]
        keep = ~used[self.live]
        self.live, self.rows = self.live[keep], np.compress(keep, self.rows, axis=1)

    def scores(self, seed: int) -> np.ndarray:
        """The BM25 score of every document for all terms of the seed."""
        held = np.searchsorted(self.terms, self.own[seed])
        row = self.row[held]
        rare, out = held[row < 0], np.zeros(self.n)
        out[self.live] = self.rows[row[row >= 0]].sum(axis=0)
        if len(rare):
            spans = [slice(a, b) for a, b in zip(self.at[rare].tolist(), self.at[rare + 1].tolist(), strict=True)]
            who, weight = np.concatenate([self.who[s] for s in spans]), np.concatenate([self.weight[s] for s in spans])
            out += np.bincount(who, weights=weight, minlength=self.n)
        return out

    def neighbours(self, seed: int) -> np.ndarray:
        """Other documents with a positive score, best first."""
        score = self.scores(seed)
        score[seed] = 0
        found = np.flatnonzero(score)
        return found[np.argsort(-score[found], kind="stable")]


def plan(lengths: list[int], index: Index, window: int) -> list[tuple[int, int, int, int, int]]:
    """(document, start, length, sequence, offset) pieces that use up every token."""
    n = len(lengths)
    used = np.zeros(n, dtype=bool)
    pieces: list[tuple[int, int, int, int, int]] = []
    seq = fill = cursor = start = 0
    doc = -1  # the document at hand, ``start`` tokens of which are placed
    score = np.zeros(n)
    picks, ranked = 0, iter(())
    while True:
        if doc < 0:
            if fill:
                picks += 1
                if picks < MANY:
                    score[used] = 0
                    best = int(score.argmax())
                    doc = best if score[best] > 0 else -1
                else:  # many small documents fill this window: rank the neighbours once
                    if picks == MANY:
                        score[used] = 0
                        found = np.flatnonzero(score > 0)
                        ranked = iter(found[np.argsort(-score[found], kind="stable")].tolist())
                    doc = next(ranked, -1)
            if doc < 0:
                while cursor < n and used[cursor]:
                    cursor += 1
                if cursor == n:
                    return _tail(pieces, seq, fill, window)
                doc = cursor
            used[doc], start = True, 0
        if not fill and lengths[doc] - start < window:
            index.drop(used)
            score, picks = index.scores(doc), 0
        take = min(lengths[doc] - start, window - fill)
        pieces.append((doc, start, take, seq, fill))
        start, fill = start + take, fill + take
        if start == lengths[doc]:
            doc = -1
        if fill == window:
            seq, fill = seq + 1, 0


def _tail(pieces: list, seq: int, fill: int, window: int) -> list:
    """Cut the unfilled last sequence into sequences whose lengths are powers of two."""
    if not fill:
        return pieces
    last = [p for p in pieces if p[3] == seq]
    out = [p for p in pieces if p[3] != seq]
    at, left = 0, fill
    room = 1 << (left.bit_length() - 1)
    for doc, start, length, _, _ in last:
        while length:
            take = min(length, room - at)
            out.append((doc, start, take, seq, at))
            start, length, at, left = start + take, length - take, at + take, left - take
            if at == room and left:
                seq, at, room = seq + 1, 0, 1 << (left.bit_length() - 1)
    return out


_OUT = pa.schema([
    ("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()),
    ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64()),
])


def _press(values: np.ndarray) -> bytes:
    """Whole numbers as bytes: two each where they fit, else four; the first byte says which."""
    wide = bool(len(values)) and int(values.max()) >= 1 << 16
    return bytes([wide]) + values.astype("<u4" if wide else "<u2").tobytes()


def _open(data: bytes) -> np.ndarray:
    return np.frombuffer(data, "<u4" if data[0] else "<u2", offset=1)


@cache
def _costs(k: int, size: int) -> np.ndarray:
    """The cost of each token id in the k-th choice.  Ids of byte-pair vocabularies run from frequent to rare, hence the weights."""
    ids = np.arange(size)
    u = ((mix(ids.astype(_U) * _U(0x9E3779B97F4A7C15) + _U(k + 1)) >> _U(11)).astype(float) + 1) * 2.0**-53
    return -np.log(u) / np.log1p(ids + 1.0) ** 2


def lexical_key(ids: np.ndarray, depth: int) -> list[int]:
    """``depth`` tokens of a document by weighted min-hash: two documents agree in one with probability equal to
    their weighted Jaccard similarity."""
    size = 1 << int(ids.max()).bit_length()
    return [int(ids[_costs(k, max(size, 1 << 16))[ids].argmin()]) for k in range(depth)]


def _tokenise(end_id: int, vocabulary, depth: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(*vocabulary.value)
        for batch in batches:
            tokens, length, keys = [], [], []
            for x in batch.column(1):
                ids = np.append(encode(x.as_py() or ""), np.uint32(end_id))
                tokens.append(_press(ids))
                length.append(len(ids))
                keys.append(lexical_key(ids, depth))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(tokens, pa.binary()), pa.array(length, pa.int64()), pa.array(keys, pa.list_(pa.int32()))],
                names=["doc_id", "tokens", "length", "keys"])

    return run


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    df = np.zeros(1 << 16, np.int64)
    for batch in batches:
        for x in batch.column(0).to_pylist():
            ids = _open(x)
            if int(ids.max()) >= len(df):
                df = np.append(df, np.zeros(2 * int(ids.max()) - len(df), np.int64))
            df[ids] += 1  # an index that repeats counts once
    found = np.flatnonzero(df)
    yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(df[found])], names=["term", "n"])


def _pack(window: int, shard_bytes: int, statistics):
    """Cut a partition in lexical order into shards and pack each; one shard is held at a time."""

    def shard(ids: list, tokens: list[np.ndarray], first: int) -> tuple[pa.RecordBatch, int]:
        made = plan([len(t) for t in tokens], Index(tokens, statistics.value), window)
        rows = [(ids[d], s, n, zlib.crc32(tokens[d][s : s + n].astype("<u4").tobytes()), len(tokens[d]), first + q, o) for d, s, n, q, o in made]
        out = pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*rows, strict=True), _OUT, strict=True)], schema=_OUT)
        return out, made[-1][3] + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        first = TaskContext.get().partitionId() << 40
        ids, tokens, size = [], [], 0
        for batch in batches:
            for i, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids.append(i)
                tokens.append(_open(x))
                size += 4 * len(tokens[-1])
                if size >= shard_bytes:
                    out, n = shard(ids, tokens, first)
                    yield out
                    ids, tokens, size, first = [], [], 0, first + n
        if ids:
            yield shard(ids, tokens, first)[0]

    return run


def tokenised(docs: DataFrame, vocabulary, end_id: int, depth: int, id_col: str, text: str) -> DataFrame:
    source = docs.select(F.col(f"`{id_col}`").cast("bigint").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text"))
    return source.mapInArrow(_tokenise(end_id, vocabulary, depth), "doc_id bigint, tokens binary, length bigint, keys array<int>")


def corpus_statistics(kept: DataFrame) -> tuple[np.ndarray, int, float, int]:
    """(df by token id, documents, mean length, tokens).  What comes back is a number for each id of the vocabulary."""
    size = kept.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("length"), F.lit(0)).alias("tokens")).head()
    counted = kept.select("tokens").mapInArrow(_frequencies, "term bigint, n bigint").groupBy("term").agg(F.sum("n").alias("n")).collect()
    df = np.zeros(max((r.term for r in counted), default=0) + 1, np.int64)
    for r in counted:
        df[r.term] = r.n
    return df, size.n, size.tokens / max(size.n, 1), size.tokens


def pack(
    docs: DataFrame,
    tokenizer: str,
    ranks: str | None = None,
    pattern: str | None = None,
    specials: tuple = (),
    id_col: str = "doc_id",
    text: str = "text",
    window: int = 2048,
    end_id: int = 1,
    shard_bytes: int = 8 << 20,
    depth: int = 4,
) -> DataFrame:
    """Pieces ``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset``."""
    spark = docs.sparkSession
    _shared.ship(spark)
    contents = [Path(tokenizer).read_bytes(), Path(ranks).read_bytes() if ranks else None]
    vocabulary = spark.sparkContext.broadcast((*contents, pattern, specials))
    kept, _ = _shared.materialize(tokenised(docs, vocabulary, end_id, depth, id_col, text), "tokens")
    df, n, mean, total = corpus_statistics(kept)
    statistics = spark.sparkContext.broadcast((df, n, mean))
    # the last parts of the order tell the documents of a hot key apart, so that it is dealt over several tasks
    order = [F.col("keys")[k] for k in range(depth)] + [F.xxhash64("doc_id", "tokens"), F.col("doc_id")]
    dealt = kept.repartitionByRange(max(1, -(-4 * int(total) // shard_bytes)), *order).sortWithinPartitions(*order)
    return dealt.select("doc_id", "tokens").mapInArrow(
        _pack(window, shard_bytes, statistics),
        "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint",
    )


def public_pack(docs: DataFrame) -> DataFrame:
    """Production parameters: the public byte-level vocabulary."""
    import public_tokenizers

    return pack(
        docs,
        public_tokenizers.path("byte_bpe_50k.json"),
        public_tokenizers.path("byte_bpe_50k.tiktoken"),
        public_tokenizers.PATTERN,
        (("<|endoftext|>", 50256),),
    )


def query(spark, sf_dir):
    return public_pack(_shared.table(spark, sf_dir, "documents"))
