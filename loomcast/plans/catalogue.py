"""Queries over the test tables: one for each operator, with SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomcast.functions import text as T
from loomcast.functions import validators as V
from loomcast.functions import values as N
from loomcast.plans.registry import CENTS, ORACLES, QUERIES, TODAY, cents_of, frac, query, shipped, table, whole


def queries() -> dict:
    from loomcast.plans import record_queries  # noqa: F401

    return {name: shipped(f) for name, f in QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    queries()
    return dict(ORACLES)


def join_list(c, sep: str = "|"):
    return F.array_join(c, sep)


# ---- paths, labels, keys -------------------------------------------------------------------------------------
@query("""SELECT c_custkey, array_to_string(list_filter(list_transform(string_split_regex(regexp_replace(c_mktsegment || ' > ' || c_name || '.acct', '\\.([0-9A-Za-z_])', ' > \\1', 'g'), '\\s*>\\s*'), lambda x: trim(x)), lambda x: x <> ''), '|') AS segments,
 CAST(3 AS INTEGER) AS n_segments FROM customer""")
def q_split_path(spark, sf_dir):
    key = F.concat("c_mktsegment", F.lit(" > "), "c_name", F.lit(".acct"))
    parts = T.split_path(key)
    return table(spark, sf_dir, "customer").select("c_custkey", join_list(parts).alias("segments"), F.size(parts).alias("n_segments"))


@query("""SELECT doc_id, md5(lower(strip_accents(replace(text, 'œ', 'oe')))) AS folded FROM documents""")
def q_fold_text(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(T.fold(F.col("text"))).alias("folded"))


@query("""SELECT doc_id, md5(regexp_replace(lower(strip_accents(text)), '[^a-z0-9]', '', 'g')) AS squashed FROM documents""")
def q_squash(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(T.squash(F.col("text"))).alias("squashed"))


@query("""SELECT p_partkey, array_to_string(list_transform(string_split_regex(p_name || ' / ' || p_brand, '\\s*[/|]\\s*'), lambda x: trim(x)), '|') AS variants FROM part""")
def q_bilingual_split(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", join_list(T.variants(F.concat("p_name", F.lit(" / "), "p_brand"))).alias("variants"))


@query("""SELECT p_partkey, array_to_string(list_filter(string_split(lower(trim(regexp_replace(regexp_replace(replace('the' || 'Of' || p_brand || '_' || p_type, '#', ' number '), '([a-z0-9])([A-Z])', '\\1 \\2', 'g'), '[^A-Za-z0-9]+', ' ', 'g'))), ' '),
 lambda w: w <> '' AND w NOT IN ('of', 'the', 'a', 'an', 'for', 'and', 's')), ' ') AS tokens FROM part""")
def q_camel_tokens(spark, sf_dir):
    from loomcast.plans.defaults import PACKS

    key = F.concat(F.lit("theOf"), "p_brand", F.lit("_"), "p_type")
    return table(spark, sf_dir, "part").select("p_partkey", join_list(T.camel_tokens(key, PACKS["en"]["stopwords"]), " ").alias("tokens"))


_PLURAL_SQL = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in T.PLURALS.items())


@query(f"""SELECT o_orderkey, array_to_string(list_transform(string_split(t, ' '), lambda w: CASE w {_PLURAL_SQL} ELSE w END), ' ') AS folded
 FROM (SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN 'service fees' WHEN 1 THEN 'couts bus' ELSE 'item prices' END AS t FROM orders)""")
def q_fold_plurals(spark, sf_dir):
    t = F.element_at(F.array(F.lit("service fees"), F.lit("couts bus"), F.lit("item prices")), (F.col("o_orderkey") % 3 + 1).cast("int"))
    return table(spark, sf_dir, "orders").select("o_orderkey", join_list(T.fold_plurals(F.split(t, " ")), " ").alias("folded"))


@query("""SELECT p_partkey, round(len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b))), 6) AS overlap FROM
 (SELECT p_partkey, list_distinct(string_split(lower(p_name), ' ')) AS a, list_distinct(string_split(lower(p_type), ' ')) AS b FROM part)""")
def q_jaccard_similarity(spark, sf_dir):
    a, b = F.array_distinct(F.split(F.lower("p_name"), " ")), F.array_distinct(F.split(F.lower("p_type"), " "))
    return table(spark, sf_dir, "part").select("p_partkey", F.round(T.word_overlap(a, b), 6).alias("overlap"))


@query("""SELECT p_partkey, CASE WHEN t[len(t)] = 'fr' THEN 'fr' WHEN t[1] = 'en' THEN 'en' END AS lang, array_to_string(CASE WHEN t[len(t)] = 'fr' THEN t[1:len(t)-1] WHEN t[1] = 'en' THEN t[2:] ELSE t END, ' ') AS rest
 FROM (SELECT p_partkey, string_split(CASE p_partkey % 3 WHEN 0 THEN 'name ' || p_size || ' fr' WHEN 1 THEN 'en label ' || p_size ELSE 'plain ' || p_size END, ' ') AS t FROM part)""")
def q_language_tag(spark, sf_dir):
    n = F.col("p_size").cast("string")
    key = F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit("name "), n, F.lit(" fr"))).when(F.col("p_partkey") % 3 == 1, F.concat(F.lit("en label "), n)).otherwise(F.concat(F.lit("plain "), n))
    out = T.strip_language_tag(F.split(key, " "), {"en": ["en"], "fr": ["fr"]})
    return table(spark, sf_dir, "part").select("p_partkey", out["lang"].alias("lang"), join_list(out["tokens"], " ").alias("rest"))


# ---- detection -----------------------------------------------------------------------------------------------
@query("""SELECT event_type, count(*) AS n, CASE WHEN event_type IN ('click', 'purchase') THEN event_type END AS schema FROM events GROUP BY event_type""")
def q_classify_type(spark, sf_dir):
    from loomcast.operators.detect import score_types
    from loomcast.plans.config import Words, build_schema_config

    cfgs = [build_schema_config({"schema_name": n, "document_fields": {"x": {"validator": "text"}}, "discriminator": {"values": [n], "aliases": ["event type"]}}) for n in ("click", "purchase")]
    counted = table(spark, sf_dir, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))
    names = F.explode(F.array(*[F.lit(c.name) for c in cfgs]))
    scored = score_types(counted.select(F.col("event_type").alias("text"), names.alias("schema")), [Words(c) for c in cfgs])
    best = scored.where("type_score >= 0.9").groupBy("text").agg(F.max_by("schema", "type_score").alias("schema"))
    return counted.join(best, counted.event_type == best.text, "left").select("event_type", "n", "schema")


@query("""SELECT t, round(0.5 * sig / 2.0 + 0.2 * req / 2.0 + 0.3 * cov / n, 4) AS similarity FROM (VALUES ('orders', 2, 2, 3, 6), ('lineitem', 0, 0, 0, 11), ('customer', 0, 0, 0, 5)) v(t, sig, req, cov, n)""")
def q_structural_score(spark, sf_dir):
    """Similarity of three tables' column names to an order schema."""
    from loomcast.operators.detect import structural_scores
    from loomcast.operators.keys import key_match
    from loomcast.plans.config import Words, build_schema_config

    cfg = build_schema_config({"schema_name": "order", "document_fields": {
        "o_totalprice": {"validator": "money", "signature": True}, "o_orderkey": {"validator": "identifier", "signature": True},
        "o_orderdate": {"validator": "date", "required": False}}})
    rows = [(t, c) for t in ("orders", "lineitem", "customer") for c in table(spark, sf_dir, t).columns]
    keys = spark.createDataFrame(rows, "t string, key string")
    km = key_match(keys, [("order", "profile", cfg.all_specs, Words(cfg), False)])
    return structural_scores(keys, km, [cfg], ["t"]).select("t", "similarity")


# ---- values --------------------------------------------------------------------------------------------------
def _amounts(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", cents_of("l_extendedprice").alias("c"))


def _money_query(name: str, render, locale: str, sql: str | None = None):
    def run(spark, sf_dir):
        # a select for each step: what is used twice is worked out once
        rows = _amounts(spark, sf_dir).withColumn("t", render()).withColumn("got", N.parse_money(F.col("t"), locale))
        return rows.select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", (F.col("got.value") * 100).cast("bigint").alias("cents"), F.col("got.error").isNotNull().alias("failed"))

    run.__name__ = name
    return query(sql or f"SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, {CENTS} AS cents, false AS failed FROM lineitem")(run)


def grouped(c: str, mark: str):
    """Whole units with a mark between groups of three digits."""
    return F.regexp_replace(whole(c), r"(?<=\d)(?=(?:\d{3})+$)", mark)


q_money_en = _money_query("q_money_en", lambda: F.concat(F.lit("$"), grouped("c", ","), F.lit("."), frac("c")), "en")
q_money_fr = _money_query("q_money_fr", lambda: F.concat(grouped("c", "\u202f"), F.lit(","), frac("c"), F.lit(" $ CA")), "fr")
q_money_dots = _money_query("q_money_dots", lambda: F.concat(grouped("c", "."), F.lit(","), frac("c"), F.lit(" €")), "fr")
q_money_mixed = _money_query("q_money_mixed", lambda: F.concat(whole("c"), F.lit(","), frac("c")), "mixed")
q_money_negative = _money_query(
    "q_money_negative", lambda: F.concat(F.lit("(USD "), whole("c"), F.lit("."), frac("c"), F.lit(")")), "en",
    f"SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, CASE WHEN {CENTS} IS NULL THEN 0 END AS cents, false AS failed FROM lineitem WHERE false "
    f"UNION ALL SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, -{CENTS}, false FROM lineitem",
)
q_money_negative_trailing = _money_query(
    "q_money_negative_trailing", lambda: F.concat(whole("c"), F.lit("."), frac("c"), F.lit("-")), "en",
    f"SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, -{CENTS} AS cents, false AS failed FROM lineitem",
)
_AMBIGUOUS = "CAST(o_orderkey % 900 + 100 AS VARCHAR)"


@query("""SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN 'negative' WHEN c_acctbal > 5000 THEN 'high' ELSE 'ok' END AS verdict FROM customer""")
def q_money_limits(spark, sf_dir):
    cents = F.round(F.col("c_acctbal") * 100).cast("bigint")
    raw = F.concat(F.when(cents < 0, "-").otherwise(""), (F.abs(cents) / 100).cast("decimal(18,2)").cast("string"))
    out = V.VALIDATORS["money"](raw, F.lit("string"), {"limit": "m"}, V.Scope(limits={"m": (0, 5000)}, name="acctbal"))
    verdict = F.when(out["error"].contains("negative"), "negative").when(out["error"].contains("exceeds"), "high").when(out["error"].isNull(), "ok").otherwise("other")
    return table(spark, sf_dir, "customer").select("c_custkey", verdict.alias("verdict"))


@query(f"""SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, ({CENTS} * 10 + 5 + 5) // 10 AS cents, true AS warned FROM lineitem""")
def q_money_round(spark, sf_dir):
    """A third decimal of 5 is rounded half up, with a warning."""
    a = _amounts(spark, sf_dir)
    raw = F.concat(whole("c"), F.lit("."), frac("c"), F.lit("5"))
    rows = a.withColumn("t", raw).withColumn("out", V.VALIDATORS["money"](F.col("t"), F.lit("string"), {}, V.Scope(name="price")))
    return rows.select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", (F.col("out.number") * 100).cast("bigint").alias("cents"), (F.size("out.warnings") > 0).alias("warned"))


@query("""SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, CASE WHEN l_quantity BETWEEN 1 AND 30 THEN CAST(l_quantity AS BIGINT) ELSE -1 END AS value, l_quantity NOT BETWEEN 1 AND 30 AS failed FROM lineitem""")
def q_number_range(spark, sf_dir):
    raw = F.col("l_quantity").cast("bigint").cast("string")
    rows = table(spark, sf_dir, "lineitem").withColumn("t", raw).withColumn("out", V.VALIDATORS["number"](F.col("t"), F.lit("string"), {"minimum": 1, "maximum": 30}, V.Scope()))
    return rows.select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", F.coalesce(F.col("out.number").cast("bigint"), F.lit(-1).cast("bigint")).alias("value"), F.col("out.error").isNotNull().alias("failed"))


@query("""SELECT p_partkey, p_size % 2 = 1 AS failed FROM part""")
def q_integer_only(spark, sf_dir):
    raw = F.when(F.col("p_size") % 2 == 1, F.concat(F.col("p_size").cast("string"), F.lit(".5"))).otherwise(F.col("p_size").cast("string"))
    out = V.VALIDATORS["number"](raw, F.lit("string"), {"integer": True}, V.Scope())
    return table(spark, sf_dir, "part").select("p_partkey", out["error"].isNotNull().alias("failed"))


def _date_query(name: str, render, languages=("en",), sql: str = "SELECT o_orderkey, CAST(o_orderdate AS DATE) AS day FROM orders"):
    def run(spark, sf_dir):
        rows = table(spark, sf_dir, "orders").select("o_orderkey", render(F.col("o_orderdate").cast("date")).alias("t"))
        return rows.select("o_orderkey", N.parse_date(F.col("t"), True, languages)["value"].alias("day"))

    run.__name__ = name
    return query(sql)(run)


q_date_iso = _date_query("q_date_iso", lambda d: F.concat(F.date_format(d, "yyyy-MM-dd"), F.lit("T10:30:00Z")))
q_date_dmy = _date_query("q_date_dmy", lambda d: F.date_format(d, "dd/MM/yyyy"))
q_date_compact = _date_query("q_date_compact", lambda d: F.date_format(d, "yyyyMMdd"))
q_date_textual = _date_query("q_date_textual", lambda d: F.concat(F.date_format(d, "EEEE, MMMM d"), F.lit("th, "), F.date_format(d, "yyyy")))
q_date_french = _date_query(
    "q_date_french",
    lambda d: F.concat(F.lit("le "), F.dayofmonth(d).cast("string"), F.lit(" "), F.element_at(F.array(*[F.lit(x) for x in "janvier février mars avril mai juin juillet août septembre octobre novembre décembre".split()]), F.month(d)),
                       F.lit(" "), F.year(d).cast("string"), F.lit(" à 20 h 15")),
    ("en", "fr"),
)


@query("""SELECT o_orderkey, CASE WHEN date_diff('day', CAST(o_orderdate AS DATE), DATE '2002-01-01') > 730 THEN 'old' ELSE 'ok' END AS verdict FROM orders""")
def q_date_age(spark, sf_dir):
    out = V.VALIDATORS["date"](F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit("string"), {}, V.Scope(today=TODAY))
    return table(spark, sf_dir, "orders").select("o_orderkey", F.when(out["error"].contains("older"), "old").when(out["error"].isNull(), "ok").otherwise("other").alias("verdict"))


@query("""SELECT l_orderkey, CASE WHEN bool_or(l_returnflag = 'R') AND bool_or(l_returnflag = 'N') THEN 'mixed' WHEN bool_or(l_returnflag = 'R') THEN 'fr' ELSE 'en' END AS locale FROM lineitem GROUP BY l_orderkey""")
def q_locale_by_document(spark, sf_dir):
    lang = F.when(F.col("l_returnflag") == "R", "fr").when(F.col("l_returnflag") == "N", "en").otherwise("en2")
    g = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_set(lang).alias("langs"))
    # without evidence every active language counts, so orders of neither flag are kept to English here
    langs = F.when(F.size(F.array_intersect("langs", F.array(F.lit("en"), F.lit("fr")))) == 0, F.array(F.lit("en"))).otherwise(F.col("langs"))
    return g.select("l_orderkey", N.number_locale(langs, ("en", "fr")).alias("locale"))


# ---- validators ----------------------------------------------------------------------------------------------
def check(kind: str, raw, params: dict | None = None):
    return V.VALIDATORS[kind](raw, F.lit("string"), params or {}, V.Scope(today=TODAY))


@query("""SELECT p_partkey, trim(p_name) AS value, length(trim(p_name)) > 20 AS failed FROM part WHERE length(trim(p_name)) <= 20 UNION ALL SELECT p_partkey, NULL, true FROM part WHERE length(trim(p_name)) > 20""")
def q_text_length(spark, sf_dir):
    out = check("text", F.concat(F.lit("\t "), "p_name", F.lit("\u00a0")), {"max_length": 20})
    return table(spark, sf_dir, "part").select("p_partkey", out["value"].alias("value"), out["error"].isNotNull().alias("failed"))


@query("""SELECT c_custkey, regexp_matches(c_name, '[0-9#]') AS failed FROM customer""")
def q_person_name(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", check("person_name", F.col("c_name"))["error"].isNotNull().alias("failed"))


@query("""SELECT s_suppkey, NOT regexp_full_match(s_name, '[A-Za-z0-9][A-Za-z0-9/ .-]{0,39}') AS failed FROM supplier""")
def q_identifier(spark, sf_dir):
    return table(spark, sf_dir, "supplier").select("s_suppkey", check("identifier", F.col("s_name"))["error"].isNotNull().alias("failed"))


@query("""SELECT c_custkey, lpad(CAST(c_custkey AS VARCHAR), 10, '5') || ' x12' AS value FROM customer""")
def q_phone(spark, sf_dir):
    n = F.lpad(F.col("c_custkey").cast("string"), 10, "5")
    raw = F.concat(F.lit("("), F.substr(n, F.lit(1), F.lit(3)), F.lit(") "), F.substr(n, F.lit(4), F.lit(3)), F.lit("-"), F.substr(n, F.lit(7)), F.lit(" ext. 12"))
    return table(spark, sf_dir, "customer").select("c_custkey", check("phone", raw)["value"].alias("value"))


@query("""SELECT c_custkey, c_custkey % 2 = 1 AS warned, false AS failed FROM customer""")
def q_address(spark, sf_dir):
    raw = F.when(F.col("c_custkey") % 2 == 0, F.concat(F.col("c_custkey").cast("string"), F.lit(" Main Street"))).otherwise(F.lit("Old Mill Road"))
    out = check("address", raw)
    return table(spark, sf_dir, "customer").select("c_custkey", (F.size(out["warnings"]) > 0).alias("warned"), out["error"].isNotNull().alias("failed"))


@query("""SELECT p_partkey, CASE WHEN regexp_full_match(upper(replace(p_brand, '#', '')), 'BRAND[1-3][0-9]*') THEN upper(replace(p_brand, '#', '')) END AS value FROM part""")
def q_regex_code(spark, sf_dir):
    out = check("regex", F.lower("p_brand"), {"upper": True, "strip": "#", "patterns": [r"BRAND[1-3]\d*"]})
    return table(spark, sf_dir, "part").select("p_partkey", out["value"].alias("value"))


@query("""SELECT p_type, n, CASE WHEN contains(lower(p_type), 'steel') THEN 'steel' WHEN contains(lower(p_type), 'brass') THEN 'brass' END AS term FROM (SELECT p_type, count(*) AS n FROM part GROUP BY p_type)""")
def q_vocabulary(spark, sf_dir):
    """Distinct values against a vocabulary, by containment."""
    from loomcast.operators.keys import vocabulary_term
    from loomcast.plans.config import Words, build_schema_config

    terms = {"steel": {"aliases": ["steel"]}, "brass": {"aliases": ["brass"]}}
    cfg = build_schema_config({"schema_name": "part", "vocabularies": {"metals": terms}, "document_fields": {"metal": {"validator": "vocabulary", "params": {"vocabulary": "metals"}}}})
    words = Words(cfg)

    def run(batches):
        for b in batches:
            got = [vocabulary_term(t, cfg.vocabularies["metals"], words) for t in b["p_type"]]
            yield b.assign(term=[g[0] if g[1] >= 0.9 else None for g in got])

    counted = table(spark, sf_dir, "part").groupBy("p_type").agg(F.count(F.lit(1)).alias("n"))
    return counted.mapInPandas(run, "p_type string, n bigint, term string")


# ---- lines, totals, rules ------------------------------------------------------------------------------------
def _documents(spark, sf_dir):
    """Orders as documents: the claimed total is the exact sum, off by a cent for every seventh order."""
    sums = table(spark, sf_dir, "lineitem").select("l_orderkey", cents_of("l_extendedprice").alias("c")).groupBy("l_orderkey").agg(F.sum("c").alias("lines_cents"), F.count(F.lit(1)).alias("n_lines"))
    o = table(spark, sf_dir, "orders").join(sums, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    return o.withColumn("claimed", F.col("lines_cents") + F.when(F.col("o_orderkey") % 7 == 0, 1).otherwise(0))


_DOC_SQL = """SELECT o_orderkey, o_custkey, o_orderdate, lines_cents, n_lines, lines_cents + CASE WHEN o_orderkey % 7 = 0 THEN 1 ELSE 0 END AS claimed FROM orders LEFT JOIN
 (SELECT l_orderkey, CAST(sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS BIGINT) AS lines_cents, count(*) AS n_lines FROM lineitem GROUP BY l_orderkey) ON o_orderkey = l_orderkey"""


@query(f"""SELECT o_orderkey, CAST(o_custkey AS VARCHAR) AS customer, CAST(o_orderdate AS DATE) AS day, coalesce(claimed, 0) AS total_cents, coalesce(lines_cents, 0) AS lines_cents, coalesce(n_lines, 0) AS n_lines,
 CASE WHEN n_lines IS NULL THEN 'no line items found' WHEN claimed <> lines_cents THEN 'total does not equal the sum of the line items' END AS error FROM ({_DOC_SQL})""")
def q_flagship_documents(spark, sf_dir):
    """Documents with nested lines: amounts and dates parsed from text, totals checked exactly."""
    d = _documents(spark, sf_dir)
    total = N.parse_money(F.concat(F.lit("$"), F.expr("claimed div 100").cast("string"), F.lit("."), F.lpad(F.expr("claimed % 100").cast("string"), 2, "0")), "en")["value"]
    day = N.parse_date(F.date_format("o_orderdate", "MMMM d, yyyy"))["value"]
    out = d.select("o_orderkey", check("identifier", F.col("o_custkey").cast("string"))["value"].alias("customer"), day.alias("day"), F.coalesce((total * 100).cast("bigint"), F.lit(0).cast("bigint")).alias("total_cents"),
                   F.coalesce("lines_cents", F.lit(0).cast("bigint")).alias("lines_cents"), F.coalesce("n_lines", F.lit(0)).cast("bigint").alias("n_lines"))
    error = F.when(F.col("n_lines") == 0, "no line items found").when(F.col("total_cents") != F.col("lines_cents"), "total does not equal the sum of the line items")
    return out.withColumn("error", error)


@query("""SELECT c_custkey, length(c_name) < 3 OR c_mktsegment NOT IN ('BUILDING', 'MACHINERY', 'AUTOMOBILE') AS violates FROM customer""")
def q_target_schema(spark, sf_dir):
    from loomcast.plans.target import compile_schema, violations

    schema = compile_schema({"type": "object", "required": ["name"], "properties": {"name": {"type": "string", "minLength": 3}, "segment": {"enum": ["BUILDING", "MACHINERY", "AUTOMOBILE"]}}})

    def run(batches):
        import pandas as pd

        for b in batches:
            yield pd.DataFrame({"c_custkey": b["c_custkey"], "violates": [bool(violations({"name": n, "segment": s}, schema)) for n, s in zip(b["c_name"], b["c_mktsegment"], strict=True)]})

    return table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_mktsegment").mapInPandas(run, "c_custkey bigint, violates boolean")


ORDER_SCHEMA = {
    "schema_name": "order", "languages": ["en"], "line_containers": ["lines"],
    "document_fields": {
        "order_key": {"validator": "identifier", "signature": True, "aliases": ["order key", "order number"]},
        "order_date": {"validator": "date", "aliases": ["order date"], "params": {"max_age_days": None}},
        "total_amount": {"validator": "money", "required": False, "aliases": ["total price"]},
    },
    "line_fields": {
        "part": {"validator": "identifier", "signature": True, "aliases": ["part key"]},
        "amount": {"validator": "money", "signature": True, "sums_to_total": True, "aliases": ["extended price"]},
        "quantity": {"validator": "number", "required": False},
    },
}


@query(f"""SELECT o_orderkey AS order_key, CASE WHEN n_lines IS NULL THEN false ELSE claimed = lines_cents END AS is_valid, coalesce(n_lines, 0) AS n_lines,
 CASE WHEN n_lines IS NULL THEN 'no line items found: supply a list (e.g. ''lines'') or the line fields themselves'
 WHEN claimed <> lines_cents THEN 'total does not equal the sum of the line items' END AS error FROM ({_DOC_SQL})""")
def q_transform_orders(spark, sf_dir):
    """The whole engine over orders with their lines, read from columns."""
    from loomcast.plans.engine import prepare, transform_cells
    from loomcast.sources.readers import frame_cells

    li = table(spark, sf_dir, "lineitem").select("l_orderkey", F.struct(F.col("l_partkey").alias("part_key"), F.round(F.col("l_extendedprice"), 2).cast("decimal(18,2)").alias("extended_price"), F.col("l_quantity").alias("quantity")).alias("s"))
    docs = _documents(spark, sf_dir).drop("l_orderkey").join(li.groupBy("l_orderkey").agg(F.collect_list("s").alias("lines")), F.col("o_orderkey") == F.col("l_orderkey"), "left")
    docs = docs.select("o_orderkey", F.date_format("o_orderdate", "yyyy-MM-dd").alias("d"), (F.col("claimed") / 100).cast("decimal(18,2)").alias("t"), "lines")
    scalars = {"order key": "o_orderkey", "order date": "d", "total price": "t"}
    cells = frame_cells(docs.where("lines is not null"), "orders", "o_orderkey", scalars, "lines").unionByName(frame_cells(docs.where("lines is null"), "orders", "o_orderkey", scalars))
    report = transform_cells(cells, prepare([ORDER_SCHEMA]), "order", None, TODAY)
    lines = F.coalesce(F.json_array_length(F.get_json_object("normalized", "$.lines")), F.lit(0))
    error = F.regexp_replace(F.get("errors", F.lit(0)), r"^total_amount [\d.]+ does not equal the sum of the line items [\d.]+$", "total does not equal the sum of the line items")
    return report.results.select(F.col("rec").cast("bigint").alias("order_key"), "is_valid", lines.cast("bigint").alias("n_lines"), error.alias("error"))
