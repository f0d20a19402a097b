"""Exact token counts of every prefix of a text, by dynamic programming over prefixes.

Byte-pair encoding has a property that makes prefixes cheap: where a text is
encoded as t1 .. tn, its part up to the end of tk is encoded as t1 .. tk.  So
the last token of a prefix decides everything: it is the one token that ends
there and may follow the last token of the prefix before it.  Going through a
piece once therefore gives the count of each of its prefixes.  Two states are
kept for each place, since the tokenizer marks the last symbol of a piece: the
piece going on, and the piece ending here.

``prefix_counts`` stores for every document how the count changes with each
code point, as bytes (a text's counts are the running sums).  Questions are
answered from that relation without encoding anything again: ``totals``,
``truncate`` (the longest prefix within a budget) and ``tokens_at`` (the count
at given places).  Counts may fall from one prefix to the next, where a longer
piece merges further or a special string is completed; ``truncate`` minds that.

The tokenizer file (JSON of the ``tokenizers`` library) is a parameter; its
normaliser and its splitting are the library's own.  It has to be a byte-level
BPE whose pieces hold no white space, whose special strings hold none and are
matched in the raw text; others are refused with ValueError.  Special strings
inside texts count as the library's default has it: one token.

A worker keeps what it has computed for pieces and for runs between spaces, up
to a bounded number.  Time is proportional to the text, but for
combining marks of several classes mixed on one letter, which cost the square
of their number.  One text and its counts are in memory at a time.

Defined cases: a null text is empty (no bytes, no tokens); an empty text has an
empty table; repeated rows are counted one by one; null ids stay null; ties do
not arise; very long texts are counted whole; an empty table gives an empty
one; extra columns are ignored.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Iterator
from functools import cache
from itertools import accumulate
from pathlib import Path

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomcast.llm import _shared

#: Most entries of a worker's tables; a full table starts anew.
KEPT = 250_000
#: Symbols at the start of a piece whose states are kept for other pieces.
STEM = 6
_NEVER = 1 << 60
_NOTHING = (None, None)
_START = ("", 0)
#: White space of the texts that are split here; what else counts as white space is left to the library.
_WHITE = "\t\n\r "
#: Runs between spaces of at most so many code points are kept.
SHORT = 40


@cache
def _joining() -> frozenset[str]:
    """Characters that may join or reorder with what stands before them under NFC."""
    out = {chr(c) for c in range(0x1161, 0x11C3)}  # vowels and finals of Hangul syllables
    for c in map(chr, range(0x110000)):
        if unicodedata.combining(c):
            out.add(c)
        parts = unicodedata.decomposition(c).split()
        if len(parts) == 2 and not parts[0].startswith("<"):
            out.add(chr(int(parts[1], 16)))
    return frozenset(out)


def _byte_symbols() -> list[str]:
    """The character by which byte-level vocabularies write each byte: printable ones stand for themselves."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = iter(range(0x100, 0x200))
    return [chr(b) if b in plain else chr(next(others)) for b in range(256)]


class _Kept(dict):
    """Results of a function of short strings, a bounded number of them; a full table grows old, and what is asked again moves on."""

    def __init__(self, made) -> None:
        self.made = made
        self.old: dict[str, bytes] = {}

    def __missing__(self, key: str) -> bytes:
        made = self.old.get(key)
        if made is None:
            made = self.made(key)
        if len(key) <= SHORT:
            if len(self) >= KEPT:
                self.old = dict(self)
                self.clear()
            self[key] = made
        return made


class Wide(Exception):
    """A step that does not fit a byte."""


class Counter:
    """Counts of prefixes under one tokenizer file."""

    def __init__(self, vocabulary: bytes) -> None:
        from tokenizers import Tokenizer

        said = json.loads(vocabulary)
        model, kinds = said["model"], json.dumps([said["normalizer"], said["pre_tokenizer"]])
        added = [t for t in said["added_tokens"] if t["special"]]
        split = next((x["pattern"]["Regex"] for x in (said["pre_tokenizer"] or {}).get("pretokenizers", []) if x["type"] == "Split" and x["invert"] and x["behavior"] == "Removed"), None)
        refused = (
            model["type"] != "BPE" or '"ByteLevel"' not in kinds or not split or '"add_prefix_space": true' in kinds or model.get("dropout") or model.get("ignore_merges")
            or model.get("continuing_subword_prefix") or len(added) != len(said["added_tokens"]) or set(regex.findall(r'"type": "(\w+)"', kinds)) - {"Sequence", "NFC", "Replace", "Lowercase", "Split", "ByteLevel"}
            or any(t["normalized"] or t["single_word"] or regex.search(r"\s", t["content"]) for t in added)
        )
        if refused:
            raise ValueError("this tokenizer file is not a byte-level BPE of the supported kind")
        self.tokenizer = Tokenizer.from_str(vocabulary.decode())
        self.end = model.get("end_of_word_suffix") or ""
        self.tokens = set(model["vocab"])
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self.rank = {m: k for k, m in enumerate(merges)}
        self.longest = max(map(len, self.tokens))
        self.made = {a + b: (k, a, b) for k, (a, b) in enumerate(merges)}
        grown = len(self.made) == len(merges) and all(k > max(self.made.get(a, (-1,))[0], self.made.get(b, (-1,))[0]) for k, a, b in self.made.values())
        if not grown:
            raise ValueError("the merges of this tokenizer file are not in the order in which its tokens arose")
        # end of a token -> the token that it is, and the token that it is at the end of a piece
        self.tails: dict[str, tuple[str | None, str | None]] = {}
        for t in self.tokens:
            ends = bool(self.end) and t.endswith(self.end)
            body = t[: -len(self.end)] if ends else t
            for k in range(len(body)):
                self.tails.setdefault(body[k:], _NOTHING)
        for t in self.tokens:
            if self.end and t.endswith(self.end):
                body = t[: -len(self.end)]
                self.tails[body] = (self.tails[body][0], t)
            else:
                self.tails[t] = (t, self.tails[t][1] if self.end else t)
        self.symbols = _byte_symbols()
        self.special = regex.compile("|".join(regex.escape(t["content"]) for t in sorted(added, key=lambda t: -len(t["content"]))) or r"(?!)")
        # below U+0300 the normaliser works on each character alone; odd white space is left to the library
        self.simple = regex.compile(r"[\t\n\r -~¡-įı-˿]*")
        self.pattern = regex.compile(split)
        # the same pattern for characters below U+0300, and the white space between
        of = {kind: "".join(c for c in map(chr, range(0x300)) if regex.match(kind, c)) for kind in (r"\p{L}", r"\p{N}")}
        self.everything = re.compile(split.replace(r"\p{L}", of[r"\p{L}"]).replace(r"\p{N}", of[r"\p{N}"]) + r"|\s+")
        self.follows: dict[str, dict[str, bool]] = {}
        self.n_follows = 0
        self.stems: dict[str, tuple[tuple, tuple]] = {}
        self.edges: dict[str, tuple[list, list] | None] = {}
        self.piece_steps = _Kept(lambda text: _as_steps(self.piece(text)))
        self.runs = _Kept(self.steps)

    # -- one piece -----------------------------------------------------------------------------------------------
    def _merges_of(self, token: str) -> tuple[list, list] | None:
        """The left and the right edge of a token as it grows: (symbol, rank of the merge that takes it up), from one
        symbol to the token itself.  None where the merges never make this token from its symbols."""
        found = self.edges.get(token, 0)
        if found == 0:
            made = self.made.get(token)
            if made is None:
                one = token[: len(token) - len(self.end)] if self.end and token.endswith(self.end) else token
                found = ([(token, _NEVER)], [(token, _NEVER)]) if len(one) == 1 else None
            else:
                rank, left, right = made
                of_left, of_right = self._merges_of(left), self._merges_of(right)
                found = None
                if of_left and of_right and self._meet(of_left[1], of_right[0], rank):
                    found = ([*of_left[0][:-1], (left, rank), (token, _NEVER)], [*of_right[1][:-1], (right, rank), (token, _NEVER)])
            self.edges[token] = found
        return found

    def _meet(self, right_edge: list, left_edge: list, until: int) -> bool:
        """Whether two neighbours grow to their full size before any merge joins them (of rank below ``until``)."""
        i = j = 0
        while True:
            (u, dies), (v, ends) = right_edge[i], left_edge[j]
            joins = self.rank.get((u, v), _NEVER)
            # of equal merges the one further left comes first
            if joins < until and joins < dies and joins <= ends:
                return False
            if dies == _NEVER and ends == _NEVER:
                return True
            if dies <= ends:
                i += 1
            else:
                j += 1

    def _may_follow(self, before: str, token: str) -> bool:
        known = self.follows.get(before)
        if known is None:
            known = self.follows[before] = {}
        found = known.get(token)
        if found is None:
            if self.n_follows >= 4 * KEPT:
                self.n_follows = 0
                self.follows.clear()
                known = self.follows[before] = {}
            self.n_follows += 1
            own = self._merges_of(token)
            found = known[token] = bool(own) and (not before or self._meet(self._merges_of(before)[1], own[0], _NEVER))
        return found

    def _walk(self, text: str, inner: list[tuple[str, int]], size: int) -> list[int]:
        """Counts of the prefixes of the piece ``text`` that end at characters; ``inner`` holds the first ``size`` + 1 states and is extended."""
        if text.isascii() and text.isprintable():
            raw, stops = text, None
        else:
            raw = "".join([self.symbols[b] for b in text.encode()])
            stops = set(accumulate([len(c.encode()) for c in text]))
        get, nothing, follows, may_follow, out = self.tails.get, _NOTHING, self.follows, self._may_follow, []
        stem = raw[:STEM] if not size and stops is None and len(raw) > STEM and inner[0] == _START else ""
        if stem in self.stems:
            states, n = self.stems[stem]
            inner[:], out, size, stem = states, [*n], STEM, ""
        for i in range(size + 1, len(raw) + 1):
            if stem and i == STEM + 1:
                if len(self.stems) >= KEPT // 2:
                    self.stems.clear()
                self.stems[stem] = tuple(inner), tuple(out)
            fits = []
            for k in range(i - 1, -1, -1):
                found = get(raw[k:i])
                if found is None:
                    break
                if found is not nothing:
                    fits.append((k, found))
            fits.reverse()  # the one that fits is mostly long
            for k, (token, _) in fits:
                if token:
                    before, n = inner[k]
                    known = follows.get(before)
                    fit = known.get(token) if known else None
                    if may_follow(before, token) if fit is None else fit:
                        inner.append((token, n + 1))
                        break
            else:
                raise ValueError(f"no token ends {text!r}")
            if stops is None or i in stops:
                for k, (_, token) in fits:
                    if token:
                        before, n = inner[k]
                        known = follows.get(before)
                        fit = known.get(token) if known else None
                        if may_follow(before, token) if fit is None else fit:
                            out.append(n + 1)
                            break
                else:
                    raise ValueError(f"no token ends {text!r}")
        return out

    def piece(self, text: str) -> list[int]:
        """The count of each prefix of a piece of the splitter."""
        if not text.strip(_WHITE):
            return [0] * len(text)
        if len(text) == 1 or text.isalpha() or (not regex.search(r"\p{L}|\p{N}", text)):
            return self._walk(text, [_START], 0)
        # a prefix may be split where the whole is not
        found = [sum(self.piece(text[:k][x:y])[-1] for x, y in self._split(text[:k])) for k in range(1, len(text))]
        return [*found, self._walk(text, [_START], 0)[-1]]

    # -- a run of text -------------------------------------------------------------------------------------------
    def _normal(self, text: str) -> str:
        return self.tokenizer.normalizer.normalize_str(text)

    def _split(self, normal: str) -> list[tuple[int, int]]:
        return [span for _, span in self.tokenizer.pre_tokenizer.pre_tokenize_str(normal)]

    def _normal_counts(self, normal: str, spans: list[tuple[int, int]]) -> list[int]:
        """The count at each place of a normalised text, 0 included."""
        out, total, at = [0], 0, 0
        for a, b in spans:
            out += [total] * (a - at)
            each = self.piece(normal[a:b])
            out += [total + n for n in each]
            total, at = total + each[-1], b
        return out + [total] * (len(normal) - at)

    def _starts(self, text: str) -> list[int]:
        """Places at which the text may be cut so that its parts are normalised each alone."""
        joining = _joining()
        starts = [k for k, c in enumerate(text) if not k or c not in joining]
        more = []
        for a, b in zip(starts, [*starts[1:], len(text)], strict=True):
            # marks of one class keep their order, and after one that stays a mark none joins the letter
            if b - a > 6 and len(set(map(unicodedata.combining, text[a + 1 : b]))) == 1 and unicodedata.combining(text[a + 1]) and self._normal(text[a : a + 6]).endswith(text[a + 5]):
                more += range(a + 6, b)
        return sorted([*starts, *more]) if more else starts

    def counts(self, text: str) -> list[int]:
        """The count of each prefix of a text without special strings, the empty one left out."""
        if self.simple.fullmatch(text):
            normal = text.lower()
            return self._normal_counts(normal, [m.span() for m in self.pattern.finditer(normal)])[1:]
        starts = self._starts(text)
        parts = [self._normal(text[a:b]) for a, b in zip(starts, [*starts[1:], len(text)], strict=True)]
        normal = self._normal(text)
        if "".join(parts) != normal:  # not met; exact all the same
            return [len(self.tokenizer.encode(text[:k], add_special_tokens=False).ids) for k in range(1, len(text) + 1)]
        spans = self._split(normal)
        table = self._normal_counts(normal, spans)
        out, at, which, owner = [], 0, 0, -1
        states: list[tuple[str, int]] = []
        size: list[int] = []
        for part, a, b in zip(parts, starts, [*starts[1:], len(text)], strict=True):
            while which < len(spans) and spans[which][1] < at:
                which += 1
            for j in range(a + 1, b):  # a letter whose marks are cut off
                first = spans[which][0] if which < len(spans) and spans[which][0] < at else at
                ahead = spans[which - 1] if which and which <= len(spans) else (0, 0)
                if at - first < 2 and ahead[1] == first and normal[ahead[0]] == "'":
                    first = ahead[0]  # with the letters as they now are, an apostrophe may take them up
                tail = self._normal(text[a:j])
                if which < len(spans) and first == spans[which][0] and at - first > 2 and tail.isalpha() and (owner == first or normal[slice(*spans[which])].isalpha()):
                    # the piece of letters goes on from where its own states stand; no token reaches back further than the window
                    if owner != first:
                        owner, states, whole = first, [_START], normal[slice(*spans[which])]
                        self._walk(whole, states, 0)
                        size = [0, *np.cumsum([len(c.encode()) for c in whole]).tolist()]
                    back = max(first, at - self.longest)
                    here = states[size[back - first] : size[at - first] + 1]
                    n = self._walk(normal[back:at] + tail, here, len(here) - 1)[-1]
                else:
                    piece = normal[first:at] + tail
                    n = sum(self.piece(piece[x:y])[-1] for x, y in self._split(piece))
                out.append(table[first] + n)
            at += len(part)
            out.append(table[at])
        return out

    def all_counts(self, text: str) -> list[int]:
        """The count of each prefix of any text, the empty one left out."""
        out: list[int] = []
        base = at = 0
        for m in self.special.finditer(text):
            # until its last character stands there, a special string is ordinary text
            here = self.counts(text[at : m.end() - 1])
            out += [base + n for n in here]
            base += (here[m.start() - at - 1] if m.start() > at else 0) + 1
            out.append(base)
            at = m.end()
        return out + [base + n for n in self.counts(text[at:])] if at < len(text) else out

    def steps(self, run: str) -> bytes:
        """How the count changes with each code point, a signed byte each."""
        return _as_steps(self.all_counts(run))

    def table(self, text: str) -> tuple[int, bytes]:
        """(tokens, stored form) of a text: width of a step in its first byte, then the steps."""
        try:
            # pieces and special strings hold no spaces, so runs between spaces add up
            if self.simple.fullmatch(text) and not self.special.search(text):
                steps = b"".join(map(self.piece_steps.__getitem__, self.everything.findall(text.lower())))
            else:
                steps = b"\0".join(map(self.runs.__getitem__, text.split(" ")))
        except Wide:
            counts = self.all_counts(text)
            wide = np.diff(np.asarray([0, *counts], np.int32)).astype("<i4")
            return (counts[-1] if counts else 0), b"\4" + wide.tobytes()
        return int(np.frombuffer(steps, np.int8).sum(dtype=np.int64)), b"\1" + steps


def _as_steps(counts) -> bytes:
    steps = [b - a for a, b in zip([0, *counts], counts, strict=False)]
    if steps and (max(steps) > 127 or min(steps) < -128):
        raise Wide
    return bytes([n & 255 for n in steps])


def running(stored: bytes) -> np.ndarray:
    """The counts of all prefixes, the empty one left out, from their stored form."""
    return np.cumsum(np.frombuffer(stored, np.int8 if stored[0] == 1 else "<i4", offset=1), dtype=np.int64)


_COUNTERS: dict[int, Counter] = {}


def counter(vocabulary: bytes) -> Counter:
    key = hash(vocabulary)
    if key not in _COUNTERS:
        _COUNTERS[key] = Counter(vocabulary)
    return _COUNTERS[key]


def _count(vocabulary):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = counter(vocabulary.value)
        for batch in batches:
            text = [x or "" for x in batch.column(1).to_pylist()]
            made = [tool.table(t) for t in text]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([len(t.encode()) for t in text], pa.int64()), pa.array([len(t) for t in text], pa.int64()), pa.array([n for n, _ in made], pa.int64()), pa.array([s for _, s in made], pa.binary())],
                names=["doc_id", "n_bytes", "n_chars", "n_tokens", "steps"])

    return run


def prefix_counts(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """A row for each document: ``doc_id, n_bytes, n_chars, n_tokens, steps`` (counts of every prefix, see ``running``)."""
    spark = docs.sparkSession
    _shared.ship(spark)
    contents = Path(tokenizer).read_bytes()
    Counter(contents)  # refuses here what it cannot count
    vocabulary = spark.sparkContext.broadcast(contents)
    source = docs.select(F.col(f"`{id_col}`").cast("bigint").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text"))
    return source.mapInArrow(_count(vocabulary), "doc_id bigint, n_bytes bigint, n_chars bigint, n_tokens bigint, steps binary")


def truncate(stored: DataFrame, budget: int) -> DataFrame:
    """Adds ``keep_chars``, the length of the longest prefix of at most ``budget`` tokens, and ``keep_tokens``, its count."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep, held = [], []
            for chars, tokens, steps in zip(*(batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("n_chars", "n_tokens", "steps")), strict=True):
                if tokens > budget:
                    counts = running(steps)
                    fits = np.flatnonzero(counts <= budget)
                    chars, tokens = (int(fits[-1]) + 1, int(counts[fits[-1]])) if len(fits) else (0, 0)
                keep.append(chars)
                held.append(tokens)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(keep, pa.int64()), pa.array(held, pa.int64())], names=[*batch.schema.names, "keep_chars", "keep_tokens"])

    rest = stored.drop("keep_chars", "keep_tokens")
    fields = ", ".join(f"`{n}` {t}" for n, t in rest.dtypes)
    return rest.mapInArrow(run, f"{fields}, keep_chars bigint, keep_tokens bigint")


def tokens_at(stored: DataFrame, places: str) -> DataFrame:
    """Adds ``tokens_at``: the counts at the prefix lengths in the array column ``places`` (null where a place is outside)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for at, steps in zip(*(batch.column(batch.schema.get_field_index(c)).to_pylist() for c in (places, "steps")), strict=True):
                counts = np.append(0, running(steps))
                out.append(None if at is None else [int(counts[k]) if k is not None and 0 <= k < len(counts) else None for k in at])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.list_(pa.int64()))], names=[*batch.schema.names, "tokens_at"])

    rest = stored.drop("tokens_at")
    fields = ", ".join(f"`{n}` {t}" for n, t in rest.dtypes)
    return rest.mapInArrow(run, f"{fields}, tokens_at array<bigint>")


def totals(stored: DataFrame, limit: int) -> DataFrame:
    """``n_tokens`` of whole texts and whether they pass the limit."""
    return stored.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))


#: Tokens of a training window.
LIMIT = 2048


def query(spark, sf_dir):
    import public_tokenizers

    counted = prefix_counts(_shared.table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    stored, _ = _shared.materialize(counted, "prefixes")
    cut = truncate(stored, LIMIT)
    return cut.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > LIMIT).alias("over_limit"), "n_chars", "keep_chars", "keep_tokens")
