"""Secret scan: fixed patterns plus a randomness test battery.

Base spans come from three patterns (assignment, access key, hexadecimal run).
The battery looks at every remaining token of ``[A-Za-z0-9+/_=-]`` of 20
characters or more.  Its encoding is the narrowest alphabet that holds its
characters (padding removed).  Under the hypothesis "characters are drawn
uniformly from that alphabet" three p-values are computed: chi-squared
uniformity, Wald-Wolfowitz runs of two kinds of characters (letters and digits,
lower case and others) and lag-1 serial correlation.  Fisher's sum combines them into one statistic F.

A secret is a token that looks random, so the hypothesis to reject is "ordinary
token".  For each encoding a line ``ln F = a + b ln n`` with its spread is
fitted on ordinary tokens made by rule (words joined, capitalised, numbered,
stamped), so F is judged against what a token *of that length* would show.  The
p-value of a token is the lower tail of F there; where the battery itself
rejects randomness at ``REJECT`` it is 1.  The Benjamini-Hochberg threshold is
found for each length bin over the whole corpus, from one bounded histogram of
(length bin, p-value bin) counts.  Short tokens of one case cannot be told from
words by these tests, and are left; the README has recall by encoding and length.

Defined cases: a null text is an empty one; repeated rows are scanned each; very
long texts are scanned whole, in time in proportion to their length; spans that
start together are ordered by kind; an empty table returns no rows; extra
columns are ignored.
"""

from __future__ import annotations

import bisect
import math
import random
import re
import string
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomcast.llm._shared import materialize, ship, table

# Fixed patterns.
ASSIGN = re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.I | re.A)
# Runs are maximal, so the least length can stand in these two patterns; an assignment that is too
# short still uses up its text, so there it is checked afterwards.
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
#: Share of false ones among the spans that the battery adds.
RATE = 0.05
KINDS = ("assign", "access", "hex", "random")
TOKEN = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
_LOW, _UP, _DIGITS = string.ascii_lowercase, string.ascii_uppercase, string.digits
#: encodings, narrowest first: name, alphabet.  Decimal numbers are never candidates.
ENCODINGS = (
    ("decimal", _DIGITS),
    ("hex", _DIGITS + "abcdef"),
    ("hex-upper", _DIGITS + "ABCDEF"),
    ("lower", _LOW),
    ("upper", _UP),
    ("base32", _UP + "234567"),
    ("base32-lower", _LOW + "234567"),
    ("base36", _DIGITS + _LOW),
    ("base36-upper", _DIGITS + _UP),
    ("letters", _UP + _LOW),
    ("alnum", _DIGITS + _UP + _LOW),
    ("base64", _UP + _LOW + _DIGITS + "+/"),
    ("base64-url", _UP + _LOW + _DIGITS + "-_"),
)
_SETS = [(name, alphabet, frozenset(alphabet)) for name, alphabet in ENCODINGS]
_INDEX = {name: {c: i for i, c in enumerate(alphabet)} for name, alphabet in ENCODINGS}
#: The two kinds of characters whose runs are counted: letters and others, or lower case and others; else the halves of the alphabet.
_HIGH = {
    name: np.array([c.islower() if set(alphabet) > set(_UP + _LOW) or name == "letters" else c.isalpha() if name != "lower" and name != "upper" else c.lower() >= "n" for c in alphabet])
    for name, alphabet in ENCODINGS
}
#: A battery with a combined p-value below this has rejected randomness.
REJECT = 1e-3
#: p-value histogram: bin k holds p in (10^-(k+1)/4, 10^-k/4].
P_BINS = 160
LENGTH_BINS = (24, 32, 40, 64, 128, 512)


def base_spans(text: str) -> list[tuple[int, int, str]]:
    found = [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    found += [(*m.span(), "access") for m in ACCESS.finditer(text)]
    found += [(*m.span(), "hex") for m in HEX.finditer(text)]
    return sorted(found, key=lambda s: (s[0], KINDS.index(s[2])))


def encoding(body: str) -> str:
    chars = set(body)
    return next((name for name, _, letters in _SETS if chars <= letters), "other")


def _upper_normal(z: float) -> float:
    return max(0.5 * math.erfc(z / math.sqrt(2)), 1e-300)


def battery(body: str, name: str) -> tuple[float, float, float]:
    """p-values of chi-squared uniformity, runs and serial correlation over the alphabet of the encoding."""
    index = _INDEX[name]
    n, k = len(body), len(index)
    x = np.array([index[c] for c in body])
    counts = np.bincount(x, minlength=k)
    chi = float(((counts - n / k) ** 2).sum()) * k / n
    # Wilson-Hilferty approximation of the chi-squared tail
    df = k - 1
    p_chi = _upper_normal(((chi / df) ** (1 / 3) - (1 - 2 / (9 * df))) / math.sqrt(2 / (9 * df)))
    high = _HIGH[name][x]
    n1 = int(high.sum())
    n2 = n - n1
    if n1 and n2:
        runs = 1 + int((high[1:] != high[:-1]).sum())
        mean = 1 + 2 * n1 * n2 / n
        var = max((mean - 1) * (mean - 2) / (n - 1), 1e-9)
        p_runs = min(1.0, 2 * _upper_normal(abs(runs - mean) / math.sqrt(var)))
    else:
        p_runs = 2.0 ** (1 - n) if n < 900 else 1e-300
    centred = x - (k - 1) / 2
    r = float((centred[1:] * centred[:-1]).sum()) / (n * (k * k - 1) / 12)
    p_serial = min(1.0, 2 * _upper_normal(abs(r) * math.sqrt(n)))
    return p_chi, p_runs, p_serial


def combined(body: str, name: str) -> float:
    """Fisher's sum of the three tests: about chi-squared with 6 degrees of freedom for random characters."""
    return -2 * sum(map(math.log, battery(body, name)))


def _fisher_tail(f: float) -> float:
    half = f / 2
    return math.exp(-half) * (1 + half + half * half / 2)


#: Words that ordinary tokens are made of (fixed values).
_WORDS = (
    "the of and to in for is on that by this with you it not or be are from at as your all have new more an was we will home can us about if page my has "
    "search free but our one other do no information time they site he up may what which their news out use any there see only so his when contact here "
    "business who web also now help get view online first been would how were services some these click its like service than find price date back top "
    "people list name just over state year day into email two health world next used go work last most products music buy data make them should product "
    "system post city policy number please available copyright support message after best software then good video well where info rights public books "
    "high school through each links she review years order very privacy book items company read group need many user said set under general research "
    "university january mail full map reviews program life know games way days management part could great united hotel real item international center"
).split()
_STAMPS = ("0000", "2024", "1234", "0001", "1000", "1999", "abcd", "ffff", "dead", "beef", "cafe", "2023", "0123", "00ff", "aaaa", "1111")


def _ordinary(rng: random.Random, name: str, n: int) -> str:
    """A token of ``n`` characters such as people write, in the alphabet of the encoding."""
    out = ""
    while len(out) < n:
        word = rng.choice(_WORDS)
        if name.startswith("hex"):
            out += rng.choice(_STAMPS) if name == "hex" else rng.choice(_STAMPS).upper()
        elif name.startswith("base32"):
            out += word + (str(rng.choice((2, 22, 23, 24, 32, 64, 256))) if rng.random() < 0.3 else "")
        elif name in ("lower", "upper"):
            out += word
        elif name.startswith("base36"):
            out += word + (str(rng.choice((1, 2, 10, 19, 100, 2023, 2024))) if rng.random() < 0.4 else "")
        elif name == "letters":
            out += word.capitalize()
        else:
            mark = {"alnum": "", "base64": "/", "base64-url": rng.choice("-_")}[name]
            out += (word.capitalize() if rng.random() < 0.5 else word) + (str(rng.choice((1, 2, 10, 2023, 2024))) if rng.random() < 0.3 else "") + mark
    out = out[:n]
    return out.upper() if name in ("upper", "base32", "base36-upper") else out


@cache
def null_model() -> dict[str, tuple[float, float, float]]:
    """Encoding -> (a, b, spread) of ln F over ordinary tokens; made once, by rule."""
    rng, out = random.Random(17), {}
    for name, _ in ENCODINGS[1:]:
        sizes = [n for n in (20, 24, 32, 48, 80, 160, 320) for _ in range(60)]
        y = np.log([max(combined(_ordinary(rng, name, n), name), 1e-3) for n in sizes])
        x = np.log(sizes)
        b, a = np.polyfit(x, y, 1)
        out[name] = (float(a), float(b), float(np.std(y - a - b * x)))
    return out


def p_ordinary(token: str) -> float:
    """The p-value of the hypothesis that a token is an ordinary one."""
    body = token.rstrip("=")
    name = encoding(body)
    if len(body) < 16 or name in ("decimal", "other"):
        return 1.0
    f = combined(body, name)
    if _fisher_tail(f) < REJECT:
        return 1.0
    a, b, spread = null_model()[name]
    return _upper_normal((a + b * math.log(len(body)) - math.log(max(f, 1.0))) / spread)


def candidates(text: str, taken: list[tuple[int, int, str]]) -> list[dict]:
    """Tokens outside base spans that the battery takes for random, with their bins of length and p-value."""
    out: list[dict] = []
    starts, reach = [a for a, _, _ in taken], []
    for _, b, _ in taken:  # furthest end so far: spans are in order of their start
        reach.append(max(b, reach[-1]) if reach else b)
    for m in TOKEN.finditer(text):
        a, b = m.span()
        k = bisect.bisect_left(starts, b)
        if k and reach[k - 1] > a:
            continue
        p = p_ordinary(m.group())
        if p < 1:
            out.append({"start": a, "end": b, "len_bin": bisect.bisect_right(LENGTH_BINS, b - a), "p_bin": min(int(-4 * math.log10(p)), P_BINS - 1)})
        else:
            out.append({"start": a, "end": b, "len_bin": bisect.bisect_right(LENGTH_BINS, b - a), "p_bin": 0})
    return out


_CAND = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("len_bin", pa.int32()), ("p_bin", pa.int32())]))
_SPAN = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.string())]))


_SPANS = "base array<struct<start:int,end:int,kind:string>>, cand array<struct<start:int,end:int,len_bin:int,p_bin:int>>"


def _surveyed(texts: pa.Array) -> list[pa.Array]:
    spans, cands = [], []
    for value in texts:
        text = value.as_py() or ""
        base = base_spans(text)
        spans.append([{"start": a, "end": b, "kind": k} for a, b, k in base])
        cands.append(candidates(text, base))
    return [pa.array(spans, type=_SPAN), pa.array(cands, type=_CAND)]


def _survey(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_arrays([batch.column(0), *_surveyed(batch.column(1))], names=["doc_id", "base", "cand"])


def survey(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Base spans and battery candidates of every row."""
    ship(docs.sparkSession)
    source = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text"))
    kind = source.schema["doc_id"].dataType.simpleString()
    return source.mapInArrow(_survey, f"doc_id {kind}, {_SPANS}")


def fdr_thresholds(surveyed: DataFrame, rate: float = RATE) -> dict[int, int]:
    """Length bin -> smallest p-bin accepted, by Benjamini-Hochberg within each length bin.

    Reads one histogram of at most ``len(LENGTH_BINS) + 1`` x ``P_BINS`` counts.
    """
    hist = (
        surveyed.select(F.explode("cand").alias("c"))
        .groupBy("c.len_bin", "c.p_bin")
        .agg(F.count(F.lit(1)).alias("n"))
        .collect()
    )
    limits: dict[int, int] = {}
    for length in {r.len_bin for r in hist}:
        counts = np.zeros(P_BINS, dtype=np.int64)
        for r in hist:
            if r.len_bin == length:
                counts[r.p_bin] += r.n
        above = np.cumsum(counts[::-1])[::-1]
        upper = 10.0 ** (-np.arange(P_BINS) / 4)
        ok = np.flatnonzero((above > 0) & (upper <= rate * above / max(above[0], 1)))
        if len(ok):
            limits[length] = int(ok[0])
    return limits


def decide(surveyed: DataFrame, limits: dict[int, int]) -> DataFrame:
    """Join base spans with the accepted candidates into one ordered ``found`` array."""
    accepted = F.lit(False)
    if limits:
        table = F.create_map(*[F.lit(x) for pair in limits.items() for x in pair])
        picked = F.filter("cand", lambda c: c["p_bin"] >= F.coalesce(F.try_element_at(table, c["len_bin"]), F.lit(P_BINS)))
    else:
        picked = F.filter("cand", lambda c: accepted)
    order = {k: i for i, k in enumerate(KINDS)}
    rank = F.create_map(*[F.lit(x) for pair in order.items() for x in pair])
    item = lambda s, kind: F.struct(s["start"].alias("start"), F.try_element_at(rank, kind).alias("rank"), s["end"].alias("end"), kind.alias("kind"))
    return surveyed.select(
        "doc_id",
        "base",
        F.array_sort(
            F.concat(F.transform("base", lambda s: item(s, s["kind"])), F.transform(picked, lambda s: item(s, F.lit("random"))))
        ).alias("found"),
    )


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text: str = "text", rate: float = RATE) -> DataFrame:
    """One row per input row: ``base`` spans and ``found`` (base and battery spans, by start then kind)."""
    surveyed, _ = materialize(survey(docs, id_col, text), "secrets")
    return decide(surveyed, fdr_thresholds(surveyed, rate))


def redact(text: str, spans: list[tuple[int, int, str]]) -> str:
    out, at = [], 0
    for a, b, kind in sorted(spans):
        if b <= at:
            continue
        out.append(text[at : max(a, at)])
        out.append(f"[{kind}]" if a >= at else "")
        at = b
    return "".join(out) + text[at:]


def redact_secrets(docs: DataFrame, text: str = "text", count: str | None = "n_chars", rate: float = RATE) -> DataFrame:
    """The rows of ``docs`` with every span found replaced by ``[kind]``; ``count`` is set to the new length.

    Rows are surveyed once and stored with their spans; the threshold is then applied to those.
    """
    ship(docs.sparkSession)
    columns = docs.columns
    whole = docs.select(F.struct(*[F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(columns)]).alias("row"), F.col(f"`{text}`").cast("string").alias("text"))

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = _surveyed(batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), *made], names=["row", "base", "cand"])

    row = whole.schema["row"].dataType.simpleString()
    surveyed, _ = materialize(whole.mapInArrow(look, f"row {row}, {_SPANS}"), "secrets")
    limits = fdr_thresholds(surveyed, rate)
    at, length_at = columns.index(text), columns.index(count) if count in columns else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols = batch.column(0).flatten()
            texts = cols[at].to_pylist()
            lengths = cols[length_at].to_pylist() if length_at is not None else []
            for i, (base, cand) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)):
                spans = [(x["start"], x["end"], x["kind"]) for x in base]
                spans += [(c["start"], c["end"], "random") for c in cand if c["p_bin"] >= limits.get(c["len_bin"], P_BINS)]
                if spans:
                    texts[i] = redact(texts[i], spans)
                    if lengths:
                        lengths[i] = len(texts[i])
            cols[at] = pa.array(texts, cols[at].type)
            if length_at is not None:
                cols[length_at] = pa.array(lengths, cols[length_at].type)
            yield pa.RecordBatch.from_arrays(cols, names=columns)

    return surveyed.mapInArrow(run, docs.schema)


def query(spark, sf_dir):
    found = find_secrets(table(spark, sf_dir, "documents"))
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    joined = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    return found.select(
        "doc_id", count("assign"), count("access"), count("hex"),
        F.sha2(joined("base"), 256).alias("base_sha256"), joined("found").alias("spans"),
    )
