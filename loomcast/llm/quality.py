"""Quality rules kept as a bitmask ledger.

Every rule is evaluated once per document.  The ledger stores the integer
measurements and one ``fail_bits`` long in which bit k is set when rule k
fails.  A policy is a named, versioned mask over those bits: a document is kept
when no bit of the mask is set, so policies are compared and ablated by bit
arithmetic over the stored ledger, without touching the texts again.

Only built-in column functions are used.  Defined cases: a null text counts as
an empty one (no words, fails ``few_words``); repeated rows are judged one by
one; very long texts are measured whole; ties do not arise; an empty table gives
an empty ledger; extra input columns are ignored, and replaced where they bear
the name of a measurement.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomcast.llm._shared import table

WORD_BREAK = r"[ \t\n\x0B\f\r]+"
#: Words counted by the measurement behind the ``insults`` rule (fixed values).
INSULTS = ("clown", "disgusting", "idiot", "loser", "moron", "pathetic", "scum", "stupid", "trash", "worthless")

#: name -> failing condition over the measurements, in bit order.
RULES: dict[str, str] = {
    "few_words": "n_words < 50",
    "repeated_trigrams": "100 * n_repeat_words > 50 * n_words",
    "symbol_heavy": "3 * n_symbols > n_words",
    "duplicate_lines": "100 * n_dup_lines > 30 * n_lines",
    "shouting": "2 * n_exclaims > n_words",
    "short_words": "word_chars < 2 * n_words",
    "long_words": "word_chars > 20 * n_words",
    "insults": "n_insults > 0",
}
BIT = {name: 1 << k for k, name in enumerate(RULES)}
BASE_MASK = BIT["few_words"] | BIT["repeated_trigrams"]
#: version -> mask of the rules that reject.
POLICIES: dict[str, int] = {
    "base-1": BASE_MASK,
    "default-1": sum(BIT.values()) - BIT["insults"],
    "default-2": sum(BIT.values()),
}
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_exclaims", "n_insults")


def _count_chars(text: Column, chars: str) -> Column:
    return F.char_length(text) - F.char_length(F.translate(text, chars, ""))


def _repeat_words(out: DataFrame) -> DataFrame:
    """Add ``_n``: words covered by a 3-word window that occurs twice or more, from the window hashes ``_g``.

    The hashes are sorted with their positions, equal neighbours mark repeated
    windows, and the marked positions are folded into the words they cover.
    """
    tagged = F.sort_array(F.transform(F.col("_g"), lambda g, i: F.struct(g.alias("g"), i.alias("i"))))
    none = F.array().cast("array<struct<g:bigint,i:int>>")
    out = out.select("*", F.when(F.size(F.array_distinct("_g")) < F.size("_g"), tagged).otherwise(none).alias("_s"))
    out = out.select("*", F.col("_s.g").alias("_a"), F.col("_s.i").alias("_i"))
    out = out.select(
        "*",
        F.arrays_zip(
            F.col("_i").alias("i"),
            F.col("_a").alias("a"),
            F.concat(F.array(F.lit(None).cast("bigint")), F.col("_a")).alias("before"),
            F.slice("_a", 2, F.greatest(F.size("_a"), F.lit(1))).alias("after"),
        ).alias("_z"),
    )
    marked = "filter(_z, z -> z.i is not null and (z.a <=> z.before or z.a <=> z.after))"
    return out.select(
        "*",
        F.expr(
            f"aggregate(sort_array(transform({marked}, z -> z.i)), struct(0 as n, -3 as last), "
            "(acc, p) -> struct(acc.n + least(3, p - acc.last) as n, p as last), acc -> acc.n)"
        ).alias("_n"),
    )


def measure(df: DataFrame, text: str = "text") -> DataFrame:
    """Add the measurements and ``fail_bits`` to ``df`` (columns of the same names are replaced)."""
    keep = [F.col(f"`{c}`") for c in df.columns if c not in (*MEASURES, "fail_bits")]
    t = F.col("_t")
    out = df.select(*keep, F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("_t"))
    out = out.select(
        "*",
        F.filter(F.split(t, WORD_BREAK), lambda w: w != "").alias("_w"),
        F.filter(F.split(t, "\n"), lambda s: s.rlike(r"[^ \t\n\x0B\f\r]")).alias("_l"),
    )
    out = out.select(
        "*",
        F.size("_w").cast("long").alias("n_words"),
        F.when(
            F.size("_w") >= 3,
            F.expr("transform(sequence(0, size(_w) - 3), i -> xxhash64(_w[i], _w[i + 1], _w[i + 2]))"),
        ).otherwise(F.array().cast("array<bigint>")).alias("_g"),
    )
    out = _repeat_words(out)
    out = out.select(
        *[c for c in out.columns if not c.startswith("_")],
        F.char_length(F.array_join("_w", "")).cast("long").alias("word_chars"),
        _count_chars(t, "#*$%&|<>").cast("long").alias("n_symbols"),
        (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long").alias("n_dup_lines"),
        F.col("_n").cast("long").alias("n_repeat_words"),
        F.size("_l").cast("long").alias("n_lines"),
        _count_chars(t, "!").cast("long").alias("n_exclaims"),
        F.regexp_count(F.lower(t), F.lit(r"\b(" + "|".join(INSULTS) + r")\b")).cast("long").alias("n_insults"),
    )
    bits = F.lit(0).cast("long")
    for name, fails in RULES.items():
        bits = bits.bitwiseOR(F.when(F.expr(fails), F.lit(BIT[name])).otherwise(F.lit(0)).cast("long"))
    # A non-deterministic term of value 0: filters on the measurements then stay above this projection.
    # Pushed below it they would be inlined, and lambdas would evaluate whole arrays anew for every element.
    return out.select("*", bits.bitwiseOR(F.spark_partition_id().cast("long") * 0).alias("fail_bits"))


def ledger(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per input row: id, measurements, ``fail_bits``."""
    return measure(docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text}`").alias("text"))).drop("text")


def passes(policy: str = "default-2") -> Column:
    return F.col("fail_bits").bitwiseAND(F.lit(POLICIES[policy]).cast("long")) == 0


def judge(ledger_df: DataFrame, policy: str = "default-2") -> DataFrame:
    """Apply a versioned policy to a stored ledger."""
    return ledger_df.select(
        "*",
        (F.col("fail_bits").bitwiseAND(F.lit(BASE_MASK).cast("long")) != 0).alias("base_failed"),
        passes(policy).alias("kept"),
    )


def ablations(ledger_df: DataFrame, policy: str = "default-2") -> DataFrame:
    """Per rule of the policy: documents that fail it, and documents that only it rejects.

    The ledger is first folded to its distinct bit patterns (at most 2^rules
    rows whatever the corpus), then every rule is ablated on those.
    """
    mask = POLICIES[policy]
    patterns = ledger_df.groupBy(F.col("fail_bits").bitwiseAND(F.lit(mask).cast("long")).alias("bits")).agg(
        F.count(F.lit(1)).alias("n")
    )
    rules = F.explode(
        F.array(*[F.struct(F.lit(r).alias("rule"), F.lit(BIT[r]).cast("long").alias("bit")) for r in RULES if mask & BIT[r]])
    )
    each = patterns.select("bits", "n", rules.alias("r")).select("bits", "n", "r.rule", "r.bit")
    return each.groupBy("rule").agg(
        F.sum(F.when(F.col("bits").bitwiseAND(F.col("bit")) != 0, F.col("n")).otherwise(0)).alias("n_failed"),
        F.sum(F.when(F.col("bits") == F.col("bit"), F.col("n")).otherwise(0)).alias("n_only"),
        F.sum(F.when(F.col("bits").bitwiseAND(F.bitwise_not(F.col("bit"))) == 0, F.col("n")).otherwise(0)).alias("n_kept_without"),
    )


def keep_passing(docs: DataFrame, text: str = "text", policy: str = "default-2") -> DataFrame:
    """The rows of ``docs``, unchanged, that the policy keeps."""
    row = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(f"`{text}`").alias("text"))
    return measure(row).where(passes(policy)).select("row.*")


def query(spark, sf_dir):
    out = judge(ledger(table(spark, sf_dir, "documents")))
    return out.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        "base_failed", "kept", "fail_bits", "n_lines", "n_exclaims", "n_insults",
    )


_FAIL_SQL = " | ".join(f"CASE WHEN {c} THEN {BIT[r]} ELSE 0 END" for r, c in RULES.items())
SQL = rf"""
WITH t AS (SELECT doc_id, row_number() OVER () AS rid, coalesce(text, '') AS text FROM documents),
w AS (SELECT rid, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws FROM t),
g AS (SELECT rid, i, ws[i] || ' ' || ws[i+1] || ' ' || ws[i+2] AS g
      FROM (SELECT rid, ws, unnest(range(1, len(ws) - 1)) AS i FROM w WHERE len(ws) >= 3)),
d AS (SELECT rid, i FROM g QUALIFY count(*) OVER (PARTITION BY rid, g) >= 2),
c AS (SELECT rid, count(*) AS n FROM (SELECT DISTINCT rid, i + k AS p FROM d, range(3) r(k)) GROUP BY rid),
l AS (SELECT rid, list_filter(string_split(text, chr(10)), lambda s: regexp_matches(s, '[^\x20\x09-\x0D]')) AS ls FROM t),
m AS (SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(length(array_to_string(ws, '')), 0) AS BIGINT) AS word_chars,
  CAST(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
  CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines, CAST(coalesce(c.n, 0) AS BIGINT) AS n_repeat_words,
  CAST(len(ls) AS BIGINT) AS n_lines, CAST(length(regexp_replace(text, '[^!]', '', 'g')) AS BIGINT) AS n_exclaims,
  CAST(len(regexp_extract_all(lower(text), '\b({"|".join(INSULTS)})\b')) AS BIGINT) AS n_insults
  FROM t JOIN w USING (rid) JOIN l USING (rid) LEFT JOIN c USING (rid)),
b AS (SELECT *, CAST({_FAIL_SQL} AS BIGINT) AS fail_bits FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  (fail_bits & {BASE_MASK}) <> 0 AS base_failed, (fail_bits & {POLICIES["default-2"]}) = 0 AS kept,
  fail_bits, n_lines, n_exclaims, n_insults FROM b
"""
