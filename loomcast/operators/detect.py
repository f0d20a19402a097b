"""Which schema a dataset belongs to: declared types first, then structural similarity."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomcast.operators.keys import type_score
from loomcast.plans.config import SchemaConfig, Words

RECORD = ["source_id", "rec"]
SCALAR = "kind not in ('list', 'object', 'record_error', 'source_error', 'source_note', 'line_error', 'line_empty')"


def type_spec_of(cfg: SchemaConfig):
    from loomcast.plans.config import FieldSpec

    return FieldSpec("schema_type", "text", False, aliases=cfg.discriminator["aliases"], weak_aliases=cfg.discriminator["weak_aliases"])


def score_types(values: DataFrame, words: list[Words]) -> DataFrame:
    """Distinct (schema, text) -> closeness of a type value to the schema's names."""
    by_name = {w.name: w for w in words}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield b.assign(type_score=[type_score(t or "", by_name[s]) for s, t in zip(b["schema"], b["text"], strict=True)])

    return values.select("schema", "text").distinct().mapInPandas(run, "schema string, text string, type_score double")


def classify_records(cells: DataFrame, km: DataFrame, words: list[Words]) -> DataFrame:
    """(source_id, rec, status, schema, names, type_key, type_text, type_languages) of every record."""
    found = cells.where("line is null").where(SCALAR).join(km.where("scope = 'type' and field is not null").drop("expansions"), "key")
    first = Window.partitionBy(*RECORD, "schema").orderBy("weak", F.desc("score"), "key")
    winners = found.withColumn("rn", F.row_number().over(first)).where("rn = 1")
    scored = winners.join(score_types(winners, words), ["schema", "text"])
    limits = F.create_map(*[F.lit(x) for w in words for x in (w.name, float(w.settings["discriminator_threshold"]))])
    order = F.create_map(*[F.lit(x) for i, w in enumerate(words) for x in (w.name, i)])
    hit = F.struct(
        F.col("type_score").alias("score"), (-F.try_element_at(order, "schema")).alias("place"), F.col("schema").alias("schema"),
        F.col("key").alias("key"), F.col("text").alias("text"), F.col("languages").alias("languages"),
    )
    passes = F.col("type_score") >= F.try_element_at(limits, "schema")
    per = scored.groupBy(*RECORD).agg(
        F.array_sort(F.collect_list(F.when(passes, hit)), lambda a, b: F.when(a["place"] > b["place"], -1).otherwise(1)).alias("hits"),
        F.max(F.when(passes, F.col("type_score"))).alias("best"),
        F.max(F.when(~passes & ~F.col("weak"), hit)).alias("rejected"),
    )
    top = F.filter("hits", lambda h: h["score"] == F.col("best"))
    per = per.select(*RECORD, top.alias("top"), "rejected")
    status = F.when(F.size("top") > 1, "ambiguous").when(F.size("top") == 1, "resolved").when(F.col("rejected").isNotNull(), "unrecognised").otherwise("none")
    one = F.coalesce(F.get("top", F.lit(0)), F.col("rejected"))
    per = per.select(
        *RECORD, status.alias("status"), F.when(F.size("top") == 1, one["schema"]).alias("schema"), F.transform("top", lambda t: t["schema"]).alias("names"),
        F.when(status.isin("resolved", "ambiguous"), one["key"]).alias("type_key"), one["text"].alias("type_text"),
        F.when(status == "resolved", one["languages"]).alias("type_languages"),
    )
    records = cells.where("rec > 0").select(*RECORD).distinct()
    return records.join(per, RECORD, "left").withColumn("status", F.coalesce("status", F.lit("none")))


def key_profile(cells: DataFrame, by: list[str]) -> DataFrame:
    """The distinct keys of each group."""
    return cells.where("key is not null").select(*by, "key").distinct()


def structural_scores(cells: DataFrame, km: DataFrame, cfgs: list[SchemaConfig], by: list[str]) -> DataFrame:
    """(*by, schema, similarity): weighted shares of signature fields, required fields and explained keys."""
    profile = key_profile(cells, by)
    total = profile.groupBy(*by).agg(F.count(F.lit(1)).alias("n_keys"))
    known = profile.join(km.where("scope = 'profile'").select("schema", "key", "field"), "key")
    agg = known.groupBy(*by, "schema").agg(F.collect_set("field").alias("fields"), F.count("field").alias("n_explained")).join(total, by)

    def similarity(cfg: SchemaConfig) -> Column:
        weights = cfg.settings["similarity_weights"]
        parts = [(weights["coverage"], F.col("n_explained") / F.col("n_keys"))]
        for name in ("signature", "required"):
            need = sorted({s.name for s in cfg.all_specs if getattr(s, name)})
            if need:
                parts.append((weights[name], F.size(F.array_intersect("fields", F.array(*map(F.lit, need)))) / len(need)))
        whole = sum(w for w, _ in parts)
        return F.round(sum((F.lit(float(w)) * c for w, c in parts), F.lit(0.0)) / whole, 4) if whole else F.lit(0.0)

    value = F.coalesce(*[F.when(F.col("schema") == c.name, similarity(c)) for c in cfgs])
    return agg.select(*by, "schema", value.alias("similarity"))


def first_records(records: DataFrame, status: str, text: Column, name: str, most: int = 10) -> DataFrame:
    """(source_id, ``name``): the ``most`` least records of a status.  Spark ranks within each task first, so no source is gathered."""
    order = Window.partitionBy("source_id").orderBy("rec", "t")
    least = records.where(F.col("status") == status).select("source_id", "rec", text.alias("t")).where("t is not null")
    least = least.withColumn("rn", F.row_number().over(order)).where(F.col("rn") <= most)
    return least.groupBy("source_id").agg(F.array_sort(F.collect_list(F.struct("rec", "t"))).alias(name))


def choose_schemas(sources: DataFrame, records: DataFrame, scores: DataFrame, cfgs: list[SchemaConfig], forced: str | None) -> DataFrame:
    """One decision per source: ``schema`` or ``errors``, with ``warnings`` and ``schema_scores``."""
    candidates = ", ".join(c.name for c in cfgs)
    first = cfgs[0].settings
    unknown = F.concat(F.lit("record "), F.col("rec").cast("string"), F.lit(": '"), F.col("type_text"), F.lit("'"))
    several = F.concat(F.lit("record "), F.col("rec").cast("string"), F.lit(": "), F.array_join("names", ", "))
    named = records.groupBy("source_id").agg(F.array_sort(F.collect_set("schema")).alias("named"))
    said = named.join(first_records(records, "unrecognised", unknown, "unknown"), "source_id", "left").join(first_records(records, "ambiguous", several, "several"), "source_id", "left")
    place = F.create_map(*[F.lit(x) for i, c in enumerate(cfgs) for x in (c.name, i)])
    ranked = scores.groupBy("source_id").agg(
        F.array_sort(F.collect_list(F.struct((-F.col("similarity")).alias("minus"), F.try_element_at(place, "schema").alias("place"), "schema", "similarity"))).alias("ranked"),
        F.map_from_entries(F.collect_list(F.struct("schema", "similarity"))).alias("schema_scores"),
    )
    best, second = F.get("ranked", F.lit(0)), F.get("ranked", F.lit(1))
    texts = lambda c: F.array_join(F.transform(c, lambda x: x["t"]), "; ")
    gap = best["similarity"] - second["similarity"]
    margin = float(first["min_schema_margin"])
    low = best["similarity"] < float(first["min_schema_score"])
    tie = F.round(gap, 6) < margin
    out = sources.join(said, "source_id", "left").join(ranked, "source_id", "left")
    declared = F.array_compact(F.array(
        F.when(F.size("unknown") > 0, F.concat(F.lit("record(s) declare a type that matches no candidate schema ("), texts("unknown"), F.lit(f"); candidate schemas: {candidates}"))),
        F.when(F.size("several") > 0, F.concat(F.lit("record type matches several schemas ("), texts("several"), F.lit(")"))),
        F.when(F.size("named") > 1, F.concat(F.lit("the dataset mixes records of different schemas ("), F.array_join("named", ", "), F.lit("); split it by type and transform each part separately"))),
    ))
    out = out.withColumn("declared", F.coalesce(declared, F.array().cast("array<string>")))
    guess = F.when(F.size("named") == 1, F.get("named", F.lit(0)))
    if forced:
        guess = F.coalesce(guess, F.lit(forced))
    inferred = F.when(~low & ~F.coalesce(tie, F.lit(False)), best["schema"])
    tied = F.array_join(F.transform(F.filter("ranked", lambda r: F.round(best["similarity"] - r["similarity"], 6) < margin), lambda r: r["schema"]), ", ")
    why = (
        F.when(F.col("ranked").isNull(), F.lit("no usable records"))
        .when(low, F.concat(F.lit("no configured schema is similar enough to the data (best: '"), best["schema"], F.lit("' at "), F.format_string("%.2f", best["similarity"]), F.lit(f", minimum {float(first['min_schema_score']):.2f})")))
        .when(tie, F.concat(F.lit("schema could not be determined; ambiguous between "), tied))
    )
    out = out.withColumn("given", F.when(F.size("declared") == 0, guess)).withColumn("inferred", F.when((F.size("declared") == 0) & guess.isNull(), inferred))
    schema = F.coalesce("given", "inferred")
    return out.select(
        "source_id", schema.alias("schema"), F.col("given").isNull().alias("was_inferred"), "schema_scores",
        F.when(F.size("declared") > 0, F.col("declared")).when(schema.isNull(), F.array(why)).otherwise(F.array().cast("array<string>")).alias("errors"),
        F.when(F.col("inferred").isNotNull(), F.array(F.concat(F.lit("schema type was not supplied; inferred '"), F.col("inferred"), F.lit("' from the fields present (similarity "), F.format_string("%.2f", best["similarity"]), F.lit(")")))).otherwise(F.array().cast("array<string>")).alias("warnings"),
    )
