"""Keys of records to fields: who wins a field, who competes, who translates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomcast.plans.config import SchemaConfig, Words

RECORD = ["source_id", "rec"]
#: The same to sort and deal by: numbers first, since texts of a source are all equal.
KEYS = ["rec", "source_id"]


def use_of(cfg: SchemaConfig, scalar: Column, doc_field: Column, is_container: Column, top_field: Column) -> Column:
    """What a document-level key is used for: type, doc, container, top or unmapped."""
    return (
        F.when(F.col("key").eqNullSafe(F.col("type_key")), "type")
        .when(scalar & doc_field.isNotNull(), "doc")
        .when(F.lit(cfg.has_lines) & F.coalesce(is_container, F.lit(False)), "container")
        .when(F.lit(cfg.has_lines) & scalar & top_field.isNotNull(), "top")
        .otherwise("unmapped")
    )


def mark_document_keys(doc: DataFrame, km: DataFrame, cfg: SchemaConfig) -> DataFrame:
    """Give every document-level cell its use: type, doc, container, top or unmapped.

    Whether a key is used by the document fields depends on the key alone, so
    the three passes over one pool of keys need no anti-joins.
    """
    mine = km.where(F.col("schema") == cfg.name).drop("schema")
    cols = ["field", "score", "weak", "language", "languages", "ambiguous", "refusals"]
    d = mine.where("scope = 'doc'").select("key", *[F.col(c).alias(f"d_{c}") for c in cols], "expansions", "is_container")
    t = mine.where("scope = 'top'").select("key", *[F.col(c).alias(f"t_{c}") for c in cols])
    out = doc.join(d, "key", "left").join(t, "key", "left")
    scalar = ~F.col("kind").isin("list", "object")
    use = use_of(cfg, scalar, F.col("d_field"), F.col("is_container"), F.col("t_field"))
    return out.withColumn("use", use).withColumn("scalar", scalar)


def rank_matches(mapped: DataFrame, cfg: SchemaConfig, words: Words) -> DataFrame:
    """Add ``role`` (winner, translation, competing) and the winner's key and value to mapped cells.

    ``mapped`` has (source_id, rec, scope, line, field, key, kind, text, score, weak, language, languages).
    """
    names = [s.name for s in cfg.all_specs if s.translatable]
    translatable = F.col("field").isin(*names) if names else F.lit(False)
    late = [F.when(translatable & F.col("language").isNotNull() & (F.col("language") != F.lit(words.preferred)), 1).otherwise(0)] if names else []
    group = [*KEYS, "scope", "line", "field"]
    order = Window.partitionBy(*group).orderBy("weak", *late, F.desc("score"), "key")
    best = ("key", "text", "kind", "language")
    mapped = mapped.withColumn("rn", F.row_number().over(order)).withColumn("best", F.first(F.struct(*best)).over(order))
    mapped = mapped.select("*", *[F.col(f"best.{c}").alias(f"winner_{c}") for c in best]).drop("best")
    if not names:
        return mapped.withColumn("role", F.when(F.col("rn") == 1, "winner").otherwise("competing"))
    other = translatable & (F.col("language") != F.col("winner_language"))
    again = Window.partitionBy(*group, "language").orderBy("rn")
    first = F.row_number().over(again) == 1
    role = F.when(F.col("rn") == 1, "winner").when(F.coalesce(other, F.lit(False)) & first, "translation").otherwise("competing")
    return mapped.withColumn("role", role)


def document_languages(mapped: DataFrame) -> Column:
    """Languages of all mapped keys of a record, over a window on the record."""
    w = Window.partitionBy(*KEYS)
    return F.array_sort(F.array_distinct(F.flatten(F.collect_set("languages").over(w))))
