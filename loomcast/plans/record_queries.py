"""Queries that run the record operators over relations made from the test tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from loomcast.functions import text as T
from loomcast.functions import values as N
from loomcast.operators import checks, detect
from loomcast.operators.keys import key_match
from loomcast.operators.mapping import mark_document_keys, rank_matches
from loomcast.plans import engine
from loomcast.plans.config import Words, build_schema_config, register_record_rule
from loomcast.plans.defaults import SETTINGS
from loomcast.plans.registry import CENTS, TODAY, cents_of, frac, query, table, whole
from loomcast.plans.store import keep
from loomcast.sources import readers


def none():
    return F.lit(None)


def schema(name: str, fields: dict, lines: dict | None = None, **more):
    return build_schema_config({"schema_name": name, "document_fields": fields, **({"line_fields": lines} if lines else {}), **more})


def contents(df, path, text):
    return df.select(path.cast("string").alias("path"), F.encode(text, "UTF-8").alias("content"))


# ---- sources -------------------------------------------------------------------------------------------------
def _event_cells(spark, sf_dir):
    """Every event's properties as a JSON source of its own."""
    return readers.parse_contents(contents(table(spark, sf_dir, "events"), F.col("event_id"), F.col("props")))


@query("""SELECT event_id, 'k' AS key, 'int' AS kind, json_extract_string(props, '$.k') AS value FROM events""")
def q_flatten_props(spark, sf_dir):
    return _event_cells(spark, sf_dir).select(F.col("source_id").cast("bigint").alias("event_id"), "key", "kind", F.col("text").alias("value"))


@query("""SELECT fmt, count(*) AS n FROM (SELECT CASE WHEN left(ltrim(t), 1) = '<' THEN 'xml' WHEN left(ltrim(t), 1) IN ('{', '[') THEN 'json' ELSE 'csv' END AS fmt
 FROM (SELECT html AS t FROM pages UNION ALL SELECT props FROM events UNION ALL SELECT text FROM documents)) GROUP BY fmt""")
def q_sniff_format(spark, sf_dir):
    of = lambda name, c: contents(table(spark, sf_dir, name), F.lit(name), F.col(c))
    files = of("pages", "html").unionByName(of("events", "props")).unionByName(of("documents", "text"))
    return readers.source_formats(files).groupBy(F.col("format").alias("fmt")).agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT event_type, count(*) AS n, count(DISTINCT k) AS n_keys FROM (SELECT event_type, unnest(json_keys(props)) AS k FROM events) GROUP BY event_type""")
def q_profile_keys(spark, sf_dir):
    types = table(spark, sf_dir, "events").select(F.col("event_id").cast("string").alias("source_id"), "event_type")
    each = detect.key_profile(_event_cells(spark, sf_dir), ["source_id"]).join(types, "source_id")
    return each.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("key").alias("n_keys"))


_WRITTEN = """SELECT l_orderkey % 3 AS part, CAST(l_orderkey AS VARCHAR) AS "order", CAST(l_linenumber AS VARCHAR) AS line, CAST(CAST(l_quantity AS BIGINT) AS VARCHAR) AS "lot size",
 l_returnflag || '"' || chr(10) || l_linestatus || ',' AS note FROM lineitem"""


@query(f"""SELECT part, key, count(*) AS n, CAST(sum(length(text)) AS BIGINT) AS n_chars, min(text) AS least, max(text) AS most FROM ({_WRITTEN}) UNPIVOT (text FOR key IN ("order", line, "lot size", note)) GROUP BY ALL""")
def q_large_csv(spark, sf_dir):
    """Line items written as quoted CSV with line ends inside fields, a few files, and read back block by block."""
    from loomcast.plans.store import scratch
    from loomcast.sources import large

    rows = table(spark, sf_dir, "lineitem").select(
        (F.col("l_orderkey") % 3).alias("part"), F.col("l_orderkey").alias("order"), F.col("l_linenumber").alias("line"), F.col("l_quantity").cast("bigint").alias("lot size"),
        F.concat("l_returnflag", F.lit('"\n'), "l_linestatus", F.lit(",")).alias("note"))
    folder = scratch(spark, "written")
    rows.repartitionByRange(3, "part").write.partitionBy("part").option("header", True).option("escape", '"').csv(folder)
    cells = large.read_csv_files(spark, f"{folder}/part=*")
    part = F.regexp_extract("source_id", r"part=(\d)", 1).cast("bigint")
    return cells.where("kind = 'string'").groupBy(part.alias("part"), "key").agg(F.count(F.lit(1)).alias("n"), F.sum(F.char_length("text")).alias("n_chars"), F.min("text").alias("least"), F.max("text").alias("most"))


_LINES = """SELECT c_mktsegment, CAST(c_custkey AS VARCHAR) AS cust, c_name || ' é' AS name FROM customer"""


@query(f"""SELECT c_mktsegment, key, kind, count(*) AS n, min(text) AS least, max(text) AS most, max(rec) AS n_records FROM (
 SELECT c_mktsegment, row_number() OVER (PARTITION BY c_mktsegment ORDER BY cust) AS rec, unnest([{{'key': 'id', 'kind': 'int', 'text': cust}}, {{'key': 'who > name', 'kind': 'string', 'text': name}}], recursive := true) FROM ({_LINES})) GROUP BY ALL""")
def q_json_lines(spark, sf_dir):
    """Customers written as JSON lines, a file for each segment, and read back block by block."""
    from loomcast.plans.store import scratch
    from loomcast.sources import large

    rows = table(spark, sf_dir, "customer").select("c_mktsegment", F.to_json(F.struct(F.col("c_custkey").alias("id"), F.struct(F.concat("c_name", F.lit(" é")).alias("name")).alias("who"))).alias("value"))
    folder = scratch(spark, "written")
    rows.repartition("c_mktsegment").write.partitionBy("c_mktsegment").text(folder)
    cells = large.read_json_lines(spark, f"{folder}/c_mktsegment=*")
    segment = F.regexp_extract("source_id", r"c_mktsegment=([^/]*)/", 1)
    return cells.groupBy(segment.alias("c_mktsegment"), "key", "kind").agg(F.count(F.lit(1)).alias("n"), F.min("text").alias("least"), F.max("text").alias("most"), F.max("rec").alias("n_records"))


@query("""SELECT nation, key, kind, count(*) AS n, min(text) AS least, max(text) AS most, max(rec) AS n_records FROM (
 SELECT s_nationkey AS nation, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) AS rec, unnest([{'key': 'id', 'kind': 'string', 'text': CAST(s_suppkey AS VARCHAR)}, {'key': 'name', 'kind': 'string', 'text': s_name || ' <&>'}], recursive := true)
 FROM supplier) GROUP BY ALL""")
def q_xml_records(spark, sf_dir):
    """Suppliers written as XML, one root over all, and read record by record."""
    from loomcast.plans.store import scratch
    from loomcast.sources import large

    rows = table(spark, sf_dir, "supplier").select(
        F.format_string("<supplier nation='%d'><id>%d</id><name>%s &lt;&amp;&gt;</name></supplier>", "s_nationkey", "s_suppkey", "s_name").alias("value"), "s_suppkey")
    ends = spark.createDataFrame([("<?xml version='1.0'?><suppliers>", -1), ("</suppliers>", 1 << 62)], "value string, s_suppkey bigint")
    folder = scratch(spark, "written")
    rows.unionByName(ends).coalesce(1).sortWithinPartitions("s_suppkey").select("value").write.text(folder)  # one file is the feature shown
    cells = large.read_xml_records(spark, folder)
    nation = cells.where("key = 'nation'").select("rec", F.col("text").cast("int").alias("nation"))
    each = cells.where("key <> 'nation'").join(nation, "rec").withColumn("rec", F.dense_rank().over(Window.partitionBy("nation").orderBy("rec")).cast("bigint"))
    return each.groupBy("nation", "key", "kind").agg(F.count(F.lit(1)).alias("n"), F.min("text").alias("least"), F.max("text").alias("most"), F.max("rec").alias("n_records"))


@query("""SELECT s_suppkey, rec, key, kind, value FROM (SELECT s_suppkey, s_name, CAST(round(s_acctbal * 100) AS BIGINT) AS c, unnest([1, 2]) AS rec FROM supplier),
 LATERAL (VALUES ('name', 'string', CASE rec WHEN 1 THEN s_name ELSE 'a "b"; c' END), ('cents', 'string', CAST(c * rec AS VARCHAR)), ('note', 'string', '')) v(key, kind, value)""")
def q_read_csv(spark, sf_dir):
    """Semicolon tables with quotes, a trailing column and an empty row."""
    c = cents_of("s_acctbal")
    text = F.concat(F.lit("name;cents;note;\n"), "s_name", F.lit(";"), c.cast("string"), F.lit(";;\n\n\"a \"\"b\"\"; c\";"), (c * 2).cast("string"), F.lit(";\n"))
    cells = readers.parse_contents(contents(table(spark, sf_dir, "supplier"), F.col("s_suppkey"), text), "csv")
    return cells.select(F.col("source_id").cast("bigint").alias("s_suppkey"), F.col("rec").cast("int").alias("rec"), "key", "kind", F.col("text").alias("value"))


@query("""SELECT s_suppkey, CASE s_suppkey % 4 WHEN 0 THEN 'CSV would lose or mis-assign data: duplicate column ''a''' WHEN 1 THEN 'CSV would lose or mis-assign data: row 2: value(s) beyond the 1 header column(s)'
 WHEN 2 THEN 'CSV contains no data rows' ELSE 'source is empty' END AS error FROM supplier""")
def q_reject_csv(spark, sf_dir):
    text = F.element_at(F.array(*map(F.lit, ("a,a\n1,2", "a\n1,2", "a,b\n", " \n"))), (F.col("s_suppkey") % 4 + 1).cast("int"))
    cells = readers.parse_contents(contents(table(spark, sf_dir, "supplier"), F.col("s_suppkey"), text), "csv")
    return cells.where("kind = 'source_error'").select(F.col("source_id").cast("bigint").alias("s_suppkey"), F.col("text").alias("error"))


@query("""SELECT c_custkey, line, key, value FROM customer, LATERAL (VALUES (NULL, 'id', CAST(c_custkey AS VARCHAR)), (NULL, 'owner > name', c_name), (NULL, 'items', NULL), (1, 'n', '1'), (2, 'n', '2')) v(line, key, value)""")
def q_read_xml(spark, sf_dir):
    """Attributes, nested elements, namespaces and a list of lines."""
    text = F.concat(F.lit("<?xml version='1.0'?><x:r xmlns:x='u' id='"), F.col("c_custkey").cast("string"), F.lit("'><x:owner><name> "), "c_name", F.lit(" </name></x:owner><items><i><n>1</n></i><i><n>2</n></i></items></x:r>"))
    cells = readers.parse_contents(contents(table(spark, sf_dir, "customer"), F.col("c_custkey"), text), None, None, frozenset({"items"}))
    return cells.select(F.col("source_id").cast("bigint").alias("c_custkey"), "line", "key", F.col("text").alias("value"))


@query("""SELECT s_suppkey, 'source is not valid XML: document type declarations are not accepted' AS error FROM supplier""")
def q_refuse_doctype(spark, sf_dir):
    text = F.concat(F.lit('<!DOCTYPE r [<!ENTITY e "'), "s_name", F.lit('">]><r>&e;</r>'))
    cells = readers.parse_contents(contents(table(spark, sf_dir, "supplier"), F.col("s_suppkey"), text))
    return cells.where("kind = 'source_error'").select(F.col("source_id").cast("bigint").alias("s_suppkey"), F.col("text").alias("error"))


@query("""SELECT s_suppkey, 'é ' || s_name AS value, CASE s_suppkey % 3 WHEN 0 THEN 'source is not UTF-8; decoded as Windows-1252 (cp1252)' WHEN 1 THEN 'source is UTF-16 encoded' END AS note FROM supplier""")
def q_decode(spark, sf_dir):
    text = F.concat(F.lit('{"a": "é '), "s_name", F.lit('"}'))
    content = F.when(F.col("s_suppkey") % 3 == 0, F.encode(text, "ISO-8859-1")).when(F.col("s_suppkey") % 3 == 1, F.encode(text, "UTF-16")).otherwise(F.encode(text, "UTF-8"))
    cells = readers.parse_contents(table(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("string").alias("path"), content.alias("content")), "json")
    at = cells.groupBy("source_id").agg(F.max(F.when(F.col("key") == "a", F.col("text"))).alias("value"), F.max(F.when(F.col("kind") == "source_note", F.col("text"))).alias("note"))
    return at.select(F.col("source_id").cast("bigint").alias("s_suppkey"), "value", "note")


@query("""SELECT c_custkey, line, key, kind, value FROM customer, LATERAL (VALUES (NULL, 'who > name', 'string', c_name), (NULL, 'who > home > nation', 'int', CAST(c_nationkey AS VARCHAR)), (NULL, 'who > seen', 'bool', 'true'),
 (NULL, 'who > orders', 'list', NULL), (1, 'who > n', 'int', '1'), (2, NULL, 'line_error', 'line 2 must be an object')) v(line, key, kind, value)""")
def q_flatten_nested(spark, sf_dir):
    """Objects are paths, dots in keys too; the lines of a nested list keep their parent's path."""
    text = F.concat(F.lit('{"who": {"name": "'), "c_name", F.lit('", "home.nation": '), F.col("c_nationkey").cast("string"), F.lit(', "seen": true, "orders": [{"n": 1}, 5]}}'))
    cells = readers.parse_contents(contents(table(spark, sf_dir, "customer"), F.col("c_custkey"), text))
    return cells.select(F.col("source_id").cast("bigint").alias("c_custkey"), "line", "key", "kind", F.col("text").alias("value"))


# ---- keys ----------------------------------------------------------------------------------------------------
_WORDS = ("anvil", "blue", "bolt", "cold", "gear", "gizmo", "hot", "large", "new", "old", "plate", "red", "ring", "rod", "small", "widget")
_ALIASES = ("cold rod", "plated", "anvil", "wide gear")


def _blocks(a: str, b: str) -> int:
    """Letters in matching blocks, by the definition: the longest common run (earliest in a, then b), then both sides."""
    best = max(((n, -i, -j) for i in range(len(a)) for j in range(len(b)) for n in range(1, min(len(a) - i, len(b) - j) + 1) if a[i : i + n] == b[j : j + n]), default=None)
    if not best:
        return 0
    n, i, j = best[0], -best[1], -best[2]
    return n + _blocks(a[:i], b[:j]) + _blocks(a[i + n :], b[j + n :])


def _ratio(word: str, alias: str) -> float:
    bare, both = alias.replace(" ", ""), set(alias.split())
    return round(max(len({word} & both) / len({word} | both), 2 * _blocks(word, bare) / (len(word) + len(bare))), 6)


@query("SELECT DISTINCT word, alias, ratio FROM (SELECT unnest(string_split(lower(p_name), ' ')) AS word FROM part) JOIN (VALUES "
       + ", ".join(f"('{w}', '{a}', CAST({_ratio(w, a)} AS DOUBLE))" for w in _WORDS for a in _ALIASES) + ") v(word, alias, ratio) USING (word)")
def q_ratio_similarity(spark, sf_dir):
    """Matching-block similarity of distinct name words with each alias of a fixed list."""
    words = table(spark, sf_dir, "part").select(F.explode(F.split(F.lower("p_name"), " ")).alias("word")).distinct()

    def run(batches):
        import pandas as pd

        for b in batches:
            yield pd.DataFrame([(w, a, round(T.similarity(w, a), 6)) for w in b["word"] for a in _ALIASES], columns=["word", "alias", "ratio"])

    return words.mapInPandas(run, "word string, alias string, ratio double")


@query("""SELECT p_partkey, p_brand = 'Brand#2' AS ambiguous, CASE p_brand WHEN 'Brand#1' THEN 'maker' WHEN 'Brand#3' THEN 'vendor' END AS field FROM part""")
def q_ambiguous_keys(spark, sf_dir):
    cfg = schema("goods", {"maker": {"validator": "text", "aliases": ["Brand#1", "Brand#2"]}, "vendor": {"validator": "text", "aliases": ["Brand#2", "Brand#3"]}})
    parts = table(spark, sf_dir, "part").select("p_partkey", F.col("p_brand").alias("key"))
    km = key_match(parts, [("goods", "doc", cfg.document_fields, Words(cfg), True)])
    return parts.join(km, "key").select("p_partkey", "ambiguous", "field")


_KEY_FORMS = (
    ("accountBalance", "balance", False), ("acct_balance", "balance", False), ("patient > account balance", "balance", False), ("client > account balance", None, None),
    ("amount", "balance", True), ("acount balance", "balance", False), ("min account balance", None, None), ("account balance / solde du compte", "balance", False),
)


@query("SELECT c_custkey, k AS key, field, weak FROM customer JOIN (VALUES " + ", ".join(
    f"({i}, '{k}', {'NULL' if f is None else repr(f)}, {'NULL' if w is None else w})" for i, (k, f, w) in enumerate(_KEY_FORMS)) + ") v(i, k, field, weak) ON c_custkey % 8 = i")
def q_alias_match(spark, sf_dir):
    """Eight ways to write a key: camel case, abbreviations, parents, typing errors, two languages, generic names."""
    cfg = schema(
        "account", {"balance": {"validator": "money", "aliases": ["account balance"], "weak_aliases": ["amount"], "i18n": {"fr": {"aliases": ["solde du compte"]}}}},
        languages=["en", "fr"], owner_role_keywords={"patient": ["patient"]}, disqualifying_key_words=["min"], abbreviation_rules=[{"abbreviation": "acct", "expansion": "account", "confidence": 0.95}])
    keys = F.element_at(F.array(*[F.lit(k) for k, _, _ in _KEY_FORMS]), (F.col("c_custkey") % len(_KEY_FORMS) + 1).cast("int"))
    rows = table(spark, sf_dir, "customer").select("c_custkey", keys.alias("key"))
    km = key_match(rows, [("account", "doc", cfg.document_fields, Words(cfg), True)])
    return rows.join(km, "key").select("c_custkey", "key", "field", "weak")


_DOUBLED = "left(p_name, CAST(p_partkey % 3 + 1 AS INT)) || substr(p_name, CAST(p_partkey % 3 + 1 AS INT))"


@query(f"""SELECT p_partkey, {_DOUBLED} AS key, replace(p_name, ' ', '_') AS field, false AS weak FROM part""")
def q_key_similarity_join(spark, sf_dir):
    """Keys with a letter doubled against all part names as fields: a similarity join through the index of names."""
    rows = table(spark, sf_dir, "part")
    names = [r.p_name for r in rows.select("p_name").distinct().orderBy("p_name").limit(5000).collect()]  # the fields of a configuration
    cfg = schema("parts", {n.replace(" ", "_"): {"validator": "text"} for n in names})
    keyed = rows.select("p_partkey", F.expr(_DOUBLED).alias("key"))
    km = key_match(keyed, [("parts", "doc", cfg.document_fields, Words(cfg), True)])
    return keyed.join(km, "key").select("p_partkey", "key", "field", "weak")


# ---- mapping -------------------------------------------------------------------------------------------------
_PART_KEYS = "SELECT p_partkey % 500 AS rec, 'k' || p_partkey AS key, 'f' || (p_size % 7) AS field, p_size % 3 / 2 AS score, p_size % 2 = 0 AS weak FROM part"


def _ranked(spark, sf_dir):
    """Keys of the parts, ranked for the fields they were matched with."""
    cfg = schema("parts", {f"f{i}": {"validator": "text"} for i in range(7)})
    key = F.concat(F.lit("k"), F.col("p_partkey").cast("string"))
    mapped = table(spark, sf_dir, "part").select(
        F.lit("parts").alias("source_id"), (F.col("p_partkey") % 500).alias("rec"), F.lit("doc").alias("scope"), none().cast("int").alias("line"), F.lit(0).alias("ord"), key.alias("key"),
        F.lit("string").alias("kind"), F.col("p_name").alias("text"), F.concat(F.lit("f"), (F.col("p_size") % 7).cast("string")).alias("field"), (F.col("p_size") % 3 / 2).alias("score"),
        (F.col("p_size") % 2 == 0).alias("weak"), none().cast("string").alias("language"), F.array().cast("array<string>").alias("languages"))
    return rank_matches(mapped, cfg, Words(cfg))


@query(f"""SELECT rec, field, key, score FROM (SELECT *, row_number() OVER (PARTITION BY rec, field ORDER BY weak, score DESC, key) AS rn FROM ({_PART_KEYS})) WHERE rn = 1""")
def q_best_key_per_field(spark, sf_dir):
    return _ranked(spark, sf_dir).where("role = 'winner'").select("rec", "field", "key", "score")


@query(f"""SELECT rec, field, winner_key, count(*) AS n_keys, max(score) AS best FROM (SELECT *, row_number() OVER w AS rn, first(key) OVER w AS winner_key FROM ({_PART_KEYS}) WINDOW w AS (PARTITION BY rec, field ORDER BY weak, score DESC, key))
 WHERE rn > 1 GROUP BY rec, field, winner_key""")
def q_competing_keys(spark, sf_dir):
    lost = _ranked(spark, sf_dir).where("role = 'competing'")
    return lost.groupBy("rec", "field", "winner_key").agg(F.count(F.lit(1)).alias("n_keys"), F.max("score").alias("best"))


@query("""SELECT p_partkey, lang AS language, CASE WHEN lang = 'en' THEN 'winner' WHEN n = 1 THEN 'translation' ELSE 'competing' END AS role FROM (SELECT p_partkey, 'en' AS lang, 1 AS n FROM part
 UNION ALL SELECT p_partkey, 'fr', 1 FROM part UNION ALL SELECT p_partkey, 'fr', 2 FROM part WHERE p_size % 2 = 0)""")
def q_translations(spark, sf_dir):
    """A translatable field with values in two languages: the preferred one wins, the first of the other is its translation."""
    cfg = schema("goods", {"label": {"validator": "text", "translatable": True}}, languages=["en", "fr"])
    one = lambda key, language, score, on: F.struct(F.lit(key).alias("key"), F.lit(language).alias("language"), F.lit(score).alias("score"), on.alias("on"))
    said = F.array(one("nom", "fr", 1.0, F.lit(True)), one("name", "en", 0.9, F.lit(True)), one("titre", "fr", 0.85, F.col("p_size") % 2 == 0))
    rows = table(spark, sf_dir, "part").select("p_partkey", "p_name", F.explode(said).alias("x")).where("x.on")
    mapped = rows.select(
        F.lit("parts").alias("source_id"), F.col("p_partkey").alias("rec"), F.lit("doc").alias("scope"), none().cast("int").alias("line"), F.lit(0).alias("ord"), "x.key", F.lit("string").alias("kind"), F.col("p_name").alias("text"),
        F.lit("label").alias("field"), "x.score", F.lit(False).alias("weak"), "x.language", F.array("x.language").alias("languages"))
    return rank_matches(mapped, cfg, Words(cfg)).select(F.col("rec").alias("p_partkey"), "language", "role")


@query("""SELECT c_custkey, field, CASE WHEN same THEN 'DUP' ELSE 'CONFLICT' END AS code FROM (SELECT c_custkey, unnest([{'field': 'call', 'same': c_custkey % 4 <> 0}, {'field': 'nation', 'same': c_custkey % 3 <> 0},
 {'field': 'segment', 'same': c_mktsegment <> 'BUILDING'}], recursive := true) FROM customer)""")
def q_competing_kinds(spark, sf_dir):
    """Two spellings of phones, numbers and vocabulary terms: each kind has its own notion of the same value."""
    names = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]
    cfg = schema("customer", {"call": {"validator": "phone"}, "nation": {"validator": "number"}, "segment": {"validator": "vocabulary", "params": {"vocabulary": "segments"}}},
                 vocabularies={"segments": {n.lower(): {"aliases": [f"the {n.lower()} trade"]} for n in names}})
    k, segment = F.col("c_custkey"), F.lower("c_mktsegment")
    digits = lambda d: F.lpad((k + d).cast("string"), 7, "2")
    dotted = lambda x: F.concat(F.lit("555."), F.substr(x, F.lit(1), F.lit(3)), F.lit("."), F.substr(x, F.lit(4)))
    bracketed = lambda x: F.concat(F.lit("(555) "), F.substr(x, F.lit(1), F.lit(3)), F.lit("-"), F.substr(x, F.lit(4)))
    pair = lambda field, a, b: F.struct(F.lit(field).alias("field"), a.alias("text"), b.alias("winner_text"))
    nation = F.col("c_nationkey")
    pairs = F.array(
        pair("call", bracketed(digits(F.when(k % 4 == 0, 1).otherwise(0))), dotted(digits(F.lit(0)))),
        pair("nation", F.concat((nation + F.when(k % 3 == 0, 1).otherwise(0)).cast("string"), F.lit(".0")), nation.cast("string")),
        pair("segment", F.when(segment == "building", F.lit("the furniture trade")).otherwise(F.concat(F.lit("the "), segment, F.lit(" trade"))), segment))
    mapped = table(spark, sf_dir, "customer").select(k, F.explode(pairs).alias("p")).select(
        F.lit("customers").alias("source_id"), k.cast("bigint").alias("rec"), F.lit("doc").alias("scope"), none().cast("int").alias("line"), F.lit(0).alias("ord"), F.lit("second").alias("key"), F.lit("first").alias("winner_key"),
        "p.text", "p.winner_text", F.lit("string").alias("kind"), F.lit("string").alias("winner_kind"), "p.field", F.lit("en").alias("locale"), none().cast("string").alias("language"), none().cast("string").alias("winner_language"),
        F.lit("competing").alias("role"))
    found = engine.competing_findings(mapped, cfg, Words(cfg), TODAY)
    return found.select(F.col("rec").alias("c_custkey"), F.regexp_extract("message", "'(call|nation|segment)'", 1).alias("field"), "code")


@query(f"""SELECT l_orderkey, CASE WHEN l_linenumber % 3 = 0 THEN 'error' ELSE 'warning' END AS severity, count(*) AS n FROM lineitem WHERE {CENTS} IS NOT NULL GROUP BY 1, 2""")
def q_competing_values(spark, sf_dir):
    """Two spellings of every line's amount compete: equal ones repeat, every third differs by a cent and is in conflict."""
    cfg = schema("order", {"amount": {"validator": "money"}})
    li = table(spark, sf_dir, "lineitem").withColumn("c", cents_of("l_extendedprice")).withColumn("d", F.col("c") + F.when(F.col("l_linenumber") % 3 == 0, 1).otherwise(0))
    mapped = li.select(
        F.lit("orders").alias("source_id"), F.col("l_orderkey").alias("rec"), F.lit("line").alias("scope"), F.col("l_linenumber").alias("line"), F.lit(0).alias("ord"), F.lit("paid").alias("key"), F.lit("amount").alias("winner_key"),
        F.concat(whole("d"), F.lit("."), frac("d")).alias("text"), F.concat(F.lit("$"), whole("c"), F.lit("."), frac("c")).alias("winner_text"), F.lit("string").alias("kind"), F.lit("string").alias("winner_kind"),
        F.lit("amount").alias("field"), F.lit("en").alias("locale"), none().cast("string").alias("language"), none().cast("string").alias("winner_language"), F.lit("competing").alias("role"))
    found = engine.competing_findings(mapped, cfg, Words(cfg))
    return found.groupBy(F.col("rec").alias("l_orderkey"), "severity").agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT c_custkey AS rec, key, use FROM customer, (VALUES ('customer name', 'doc'), ('market segment', 'doc'), ('nation', 'unmapped'), ('rows', 'container'), ('extended price', 'top'), ('sort', 'type')) v(key, use)""")
def q_unmapped_keys(spark, sf_dir):
    """The use of every document-level key: type, field, container, line field, or none."""
    cfg = schema("client", {"client": {"validator": "text", "aliases": ["customer name"]}, "segment": {"validator": "text", "aliases": ["market segment"]}}, {"amount": {"validator": "money", "aliases": ["extended price"]}},
                 discriminator={"aliases": ["sort"], "values": ["client"]})
    c = table(spark, sf_dir, "customer").withColumn("t", F.lit("client"))
    cells = readers.frame_cells(c, "customers", "c_custkey", {"customer name": "c_name", "market segment": "c_mktsegment", "nation": "c_nationkey", "extended price": "c_acctbal", "sort": "t", "rows": "t"})
    cells = cells.withColumn("kind", F.when(F.col("key") == "rows", "list").otherwise(F.col("kind"))).withColumn("type_key", F.lit("sort"))
    km = key_match(cells, engine.match_plans([cfg], {"client": Words(cfg)}))
    return mark_document_keys(cells, km, cfg).select("rec", "key", "use")


# ---- detection -----------------------------------------------------------------------------------------------
@query(f"""SELECT source, CASE WHEN best >= {SETTINGS["min_schema_score"]} AND round(best - coalesce(second, 0), 6) >= {SETTINGS["min_schema_margin"]} THEN lang END AS chosen, CASE WHEN best < {SETTINGS["min_schema_score"]} THEN 'low' WHEN
 round(best - coalesce(second, 0), 6) < {SETTINGS["min_schema_margin"]} THEN 'tie' ELSE 'clear' END AS why FROM (SELECT source, arg_max(lang, share) AS lang, max(share) AS best, max(share) FILTER (WHERE rn = 2) AS second FROM
 (SELECT source, lang, round(0.4 + count(*) / sum(count(*)) OVER (PARTITION BY source), 4) AS share, row_number() OVER (PARTITION BY source ORDER BY count(*) DESC, lang) AS rn FROM documents GROUP BY source, lang) GROUP BY source)""")
def q_select_with_margin(spark, sf_dir):
    """The most similar schema of a source, if it is similar enough and beats the next by the margin."""
    d = table(spark, sf_dir, "documents").groupBy("source", "lang").agg(F.count(F.lit(1)).alias("n"))
    share = F.round(0.4 + F.col("n") / F.sum("n").over(Window.partitionBy("source")), 4)
    scores = d.select(F.col("source").alias("source_id"), F.col("lang").alias("schema"), share.alias("similarity"))
    cfgs = [schema(name, {"x": {"validator": "text"}}) for name in sorted(r.lang for r in d.select("lang").distinct().collect())]
    sources = scores.select("source_id").distinct()
    empty = none().cast("string")
    records = sources.select("source_id", F.lit(1).cast("bigint").alias("rec"), F.lit("none").alias("status"), empty.alias("schema"), F.array().cast("array<string>").alias("names"), empty.alias("type_text"))
    got = detect.choose_schemas(sources, records, scores, cfgs, None)
    said = F.get("errors", F.lit(0))
    why = F.when(said.startswith("no configured"), "low").when(said.contains("ambiguous between"), "tie").otherwise("clear")
    return got.select(F.col("source_id").alias("source"), F.col("schema").alias("chosen"), why.alias("why"))


_W = SETTINGS["similarity_weights"]


@query(f"""SELECT event_id, round(CASE event_id % 3 WHEN 0 THEN 1.0 WHEN 1 THEN {_W["coverage"]} + ({_W["signature"]} + {_W["required"]}) / 2 ELSE 0.0 END, 4) AS similarity, event_id % 3 = 0 OR (event_id % 3 = 1 AND
 {_W["coverage"]} + ({_W["signature"]} + {_W["required"]}) / 2 >= {SETTINGS["min_schema_score"]}) AS fits FROM events""")
def q_record_fit(spark, sf_dir):
    """How well the keys of each record fit a schema."""
    cfg = schema("event", {"event_type": {"validator": "text", "signature": True}, "value": {"validator": "number", "signature": True}})
    e = table(spark, sf_dir, "events")
    text = F.when(F.col("event_id") % 3 == 0, F.lit('{"event type": "x", "Value": 1}')).when(F.col("event_id") % 3 == 1, F.lit('{"eventType": "x"}')).otherwise(F.col("props"))
    cells = readers.parse_contents(contents(e, F.col("event_id"), text))
    km = key_match(cells, [("event", "profile", cfg.all_specs, Words(cfg), False)])
    got = detect.structural_scores(cells, km, [cfg], ["source_id", "rec"])
    return got.select(F.col("source_id").cast("bigint").alias("event_id"), "similarity", (F.col("similarity") >= cfg.settings["min_schema_score"]).alias("fits"))


# ---- lines, totals, rules ------------------------------------------------------------------------------------
def _numbered(spark, sf_dir):
    """Order lines with a number of their own in their order."""
    at = Window.partitionBy("l_orderkey").orderBy("l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice")
    return table(spark, sf_dir, "lineitem").withColumn("line", F.row_number().over(at)).select(F.lit("orders").alias("source_id"), F.col("l_orderkey").alias("rec"), "*")


_NUMBERED = "(SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice) AS line FROM lineitem)"
_CLAIMED = f"(SELECT l_orderkey, CAST(sum({CENTS}) AS BIGINT) AS cents, CAST(sum({CENTS}) + CASE WHEN l_orderkey % 7 = 0 THEN 1 ELSE 0 END AS BIGINT) AS claimed FROM lineitem GROUP BY l_orderkey)"


def _two(c: str) -> str:
    """SQL: cents as an amount with two decimals."""
    return f"({c} // 100) || '.' || lpad(CAST({c} % 100 AS VARCHAR), 2, '0')"


def out_of(value=None, number=None):
    """The outcome of a validator, as the checks take it."""
    return F.struct((none() if value is None else value).cast("string").alias("value"), (none() if number is None else number).cast(N.DECIMAL).alias("number"))


ORDER = {"order_key": {"validator": "identifier"}, "total_amount": {"validator": "money", "required": False}}
LINE = {"amount": {"validator": "money", "sums_to_total": True}, "quantity": {"validator": "number", "required": False}, "brand": {"validator": "text", "required": False}}


@query(f"""SELECT l_orderkey AS rec, 'error' AS severity, 'total_amount ' || {_two("claimed")} || ' does not equal the sum of the line items ' || {_two("cents")} AS message FROM {_CLAIMED} WHERE claimed <> cents""")
def q_total_check(spark, sf_dir):
    """Claimed totals against the exact sums of the lines; every seventh order is a cent off."""
    li = _numbered(spark, sf_dir).withColumn("c", cents_of("l_extendedprice"))
    lines = li.select("source_id", "rec", "line", F.lit("amount").alias("field"), out_of(number=F.col("c").cast("decimal(20,0)") / 100).alias("out"))
    sums = li.groupBy("source_id", "rec").agg((F.sum("c") + F.when(F.col("rec") % 7 == 0, 1).otherwise(0)).alias("c"))
    docs = sums.select("source_id", "rec", F.lit("total_amount").alias("field"), out_of(number=F.col("c").cast("decimal(20,0)") / 100).alias("out"))
    return checks.total_findings(docs, lines, lines.select("source_id", "rec", "line"), schema("order", ORDER, LINE)).select("rec", "severity", "message")


def _rule_lines(spark, sf_dir):
    li = _numbered(spark, sf_dir).join(table(spark, sf_dir, "part").select("p_partkey", "p_brand"), F.col("l_partkey") == F.col("p_partkey"))
    brand = F.when(F.col("p_brand").isin("Brand#1", "Brand#2"), F.replace("p_brand", F.lit("#"), F.lit(" ")))
    field = lambda name, out: F.struct(F.lit(name).alias("field"), out.alias("out"))
    price = field("amount", out_of(number=cents_of("l_extendedprice").cast("decimal(20,0)") / 100))
    fields = F.explode(F.array(price, field("quantity", out_of(number=F.col("l_quantity"))), field("brand", out_of(brand))))
    return li.select("source_id", "rec", "line", fields.alias("f")).select("source_id", "rec", "line", "f.field", "f.out")


def _rule(spark, sf_dir, rule: dict):
    cfg = schema("order", ORDER, LINE, rules=[rule], vocabularies={"brands": {"Brand 1": {"limit": 10}, "Brand 2": {"limit": 20}}})
    docs = spark.createDataFrame([], "source_id string, rec bigint, field string, out struct<value:string,number:decimal(38,10)>")
    lines = _rule_lines(spark, sf_dir)
    (found,) = checks.rule_findings(docs, lines, cfg, lines.select("source_id", "rec").distinct())
    return found.select("rec", "severity", "message")


@query(f"""SELECT l_orderkey AS rec, 'error' AS severity, 'line ' || line || ': quantity ' || CAST(l_quantity AS BIGINT) || '.00 exceeds the reasonable maximum ' || most || '.00 for ''' || what || '''' AS message FROM (SELECT *,
 CASE p_brand WHEN 'Brand#1' THEN 10 WHEN 'Brand#2' THEN 20 ELSE 45 END AS most, CASE WHEN p_brand IN ('Brand#1', 'Brand#2') THEN replace(p_brand, '#', ' ') ELSE 'unknown brand' END AS what FROM {_NUMBERED} JOIN part ON l_partkey = p_partkey) WHERE l_quantity > most""")
def q_max_by_vocabulary(spark, sf_dir):
    return _rule(spark, sf_dir, {"kind": "max_by_vocabulary", "amount_field": "quantity", "type_field": "brand", "vocabulary": "brands", "attribute": "limit", "default": 45})


@query(f"""SELECT l_orderkey AS rec, 'warning' AS severity, 'line ' || line || ': ' || {_two(CENTS)} || ' for ' || CAST(l_quantity AS BIGINT) || ' pieces is an unusually high rate' AS message FROM {_NUMBERED} JOIN part ON l_partkey = p_partkey
 WHERE l_quantity <> 0 AND l_extendedprice / l_quantity > 3500""")
def q_rate_limit(spark, sf_dir):
    return _rule(spark, sf_dir, {"kind": "rate_limit", "amount_field": "amount", "unit_field": "quantity", "unit_label": "pieces", "max_rate": 3500})


@register_record_rule("many pieces")
def _many_pieces(doc, lines, rule):
    pieces = sum(line["quantity"] for line in lines)
    if pieces > rule["most"]:
        yield "warning", f"{int(pieces)} pieces in {len(lines)} lines"


@query("""SELECT l_orderkey AS rec, 'warning' AS severity, CAST(sum(l_quantity) AS BIGINT) || ' pieces in ' || count(*) || ' lines' AS message FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY l_orderkey HAVING sum(l_quantity) > 120""")
def q_record_rule(spark, sf_dir):
    """A rule that sees one record at a time: its document values and its lines."""
    return _rule(spark, sf_dir, {"kind": "custom", "name": "many pieces", "most": 120})


_TARGETED = """SELECT c_custkey AS rec, c_mktsegment AS segment, CAST(round(c_acctbal) AS BIGINT) AS n_bal, c_custkey % 3 = 0 AS hall, c_custkey % 4 <> 0 AS keyed FROM customer"""


@query(f"""SELECT rec, 'target schema: ' || said AS message FROM ({_TARGETED}), LATERAL (VALUES
 (segment = 'BUILDING' AND NOT hall, '(root): ''hall'' is a required property'), (segment <> 'BUILDING' AND n_bal > 5000, 'n_bal: ' || n_bal || ' is greater than the maximum of 5000'),
 (n_bal < 0, 'n_bal: ' || n_bal || ' is less than the minimum of 0'), (hall AND NOT keyed, '(root): ''key'' is a dependency of ''hall'''),
 (segment = 'MACHINERY', 'tags: ["MACHINERY", 1] does not contain an item matching the given schema')) v(wrong, said) WHERE wrong""")
def q_target_keywords(spark, sf_dir):
    """Conditional, pattern and dependency keywords of a target schema, a finding for each violation."""
    target = {
        "if": {"properties": {"segment": {"const": "BUILDING"}}}, "then": {"required": ["hall"]}, "else": {"properties": {"n_bal": {"maximum": 5000}}}, "patternProperties": {"^n_": {"minimum": 0}},
        "dependentRequired": {"hall": ["key"]}, "properties": {"tags": {"contains": {"type": "string", "not": {"const": "MACHINERY"}}}}}
    cfg = schema("customer", {"name": {"validator": "text"}}, target_schema=target)
    k, segment = F.col("c_custkey"), F.col("c_mktsegment")
    record = F.to_json(F.struct(segment.alias("segment"), F.round("c_acctbal").cast("bigint").alias("n_bal"), F.when(k % 3 == 0, F.lit(True)).alias("hall"), F.when(k % 4 != 0, F.lit(1)).alias("key")))
    whole = F.concat(F.substr(record, F.lit(1), F.char_length(record) - 1), F.lit(', "tags": ["'), segment, F.lit('", 1]}'))
    results = table(spark, sf_dir, "customer").select(F.lit("customers").alias("source_id"), k.cast("bigint").alias("rec"), whole.alias("normalized"))
    none_yet = spark.createDataFrame([], engine.FINDING)
    return checks.target_findings(results, none_yet, cfg).select("rec", "message")


@query("""SELECT 'nation ' || s_nationkey AS source_id, string_agg(CASE WHEN s_suppkey % 23 = 0 THEN 'row ' || place || ': supplier is torn' END, '; ' ORDER BY place) AS torn,
 CAST(CASE WHEN bool_or(s_suppkey % 23 = 0) THEN 0 ELSE 1 END AS BIGINT) AS n_records FROM (SELECT *, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) AS place FROM supplier) GROUP BY s_nationkey
 HAVING NOT bool_and(s_suppkey % 23 = 0)""")
def q_barred_tables(spark, sf_dir):
    """A table of suppliers for each nation, rows folded into one document; one bad row bars its table."""
    cfg = build_schema_config({
        "schema_name": "suppliers", "csv": {"layout": "lines"}, "line_containers": ["vendors"], "document_fields": {"nation": {"validator": "text"}},
        "line_fields": {"vendor_name": {"validator": "text", "signature": True}, "vendor_key": {"validator": "identifier", "signature": True}}})
    place = F.row_number().over(Window.partitionBy("s_nationkey").orderBy("s_suppkey")).cast("bigint")
    rows = table(spark, sf_dir, "supplier").select(F.concat(F.lit("nation "), F.col("s_nationkey").cast("string")).alias("source_id"), place.alias("rec"), "s_suppkey", "s_name", "s_nationkey")
    cell = lambda k, key, text, kind="string": F.struct(F.lit(k).alias("ord"), F.lit(key).cast("string").alias("key"), F.lit(kind).alias("kind"), text.cast("string").alias("text"))
    good = F.array(cell(0, "nation", F.col("s_nationkey")), cell(1, "vendor name", F.col("s_name")), cell(2, "vendor key", F.col("s_suppkey")))
    torn = F.array(cell(0, None, F.lit("supplier is torn"), "record_error"))
    cells = rows.select("source_id", F.lit("csv").alias("format"), "rec", F.lit(None).cast("int").alias("line"), F.lit(None).cast("string").alias("container"), F.explode(F.when(F.col("s_suppkey") % 23 == 0, torn).otherwise(good)).alias("c"))
    report = engine.transform_cells(cells.select("source_id", "format", "rec", "line", "c.ord", "container", "c.key", "c.kind", "c.text"), [cfg], "suppliers", None, TODAY)
    bar = F.regexp_extract(F.array_join("errors", ""), "^CSV rows cannot be combined into one document: (.*)$", 1)
    return report.header.select("source_id", F.nullif(bar, F.lit("")).alias("torn"), "n_records").where("n_records > 0 or torn is not null")


@query(f"""SELECT l_orderkey AS rec, line, strftime(o_orderdate, '%Y-%m-%d') AS day FROM {_NUMBERED} JOIN orders ON l_orderkey = o_orderkey WHERE l_linenumber % 2 <> 0""")
def q_line_inherit(spark, sf_dir):
    """Lines without a date take the document's."""
    li = _numbered(spark, sf_dir)
    own = li.where("l_linenumber % 2 = 0").select("source_id", "rec", "line", F.lit("day").alias("field"))
    shared = table(spark, sf_dir, "orders").select(F.lit("orders").alias("source_id"), F.col("o_orderkey").alias("rec"), F.lit("day").alias("field"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"))
    return engine.lend(li.select("source_id", "rec", "line"), shared, own).select("rec", "line", "day")


@query("""SELECT l_orderkey AS rec, 'error' AS severity, 'required field ''mode'' is missing' AS message FROM lineitem GROUP BY l_orderkey HAVING NOT bool_and(l_linenumber % 5 <> 0)""")
def q_doc_field_on_all_lines(spark, sf_dir):
    """A document field that every line has is not missing."""
    li = _numbered(spark, sf_dir)
    given = li.where("l_linenumber % 5 <> 0").select("source_id", "rec", "line", F.lit("mode").alias("field"), F.lit("1").alias("json"))
    docs = spark.createDataFrame([], "source_id string, rec bigint, field string, json string")
    ids = li.select("source_id", "rec", "line")
    (found,) = engine.missing_fields(ids.select("source_id", "rec").distinct(), docs, given, ids, schema("order", {"mode": {"validator": "text"}}, LINE))
    return found.select("rec", "severity", "message")


@query("""SELECT documents.doc_id, severity, message FROM documents LEFT JOIN labels USING (doc_id) JOIN (VALUES ('error', 'required field ''quality'' is missing'), ('warning', '''toxic'' was not provided')) v(severity, message) ON quality IS NULL""")
def q_required_missing(spark, sf_dir):
    cfg = schema("label", {"quality": {"validator": "number"}, "toxic": {"validator": "number", "required": False, "warn_if_missing": True}})
    rec = [F.lit("labels").alias("source_id"), F.col("doc_id").alias("rec")]
    both = F.explode(F.array(F.lit("quality"), F.lit("toxic")))
    docs = table(spark, sf_dir, "labels").where("quality is not null").select(*rec, both.alias("field"), F.lit("1").alias("json"))
    nothing = spark.createDataFrame([], "source_id string, rec bigint, line int, field string, json string")
    found = engine.missing_fields(table(spark, sf_dir, "documents").select(*rec), docs, nothing, nothing.select("source_id", "rec", "line"), cfg)
    return found[0].unionByName(found[1]).select(F.col("rec").alias("doc_id"), "severity", "message")


@query(f"""SELECT l_orderkey AS rec, 'line ' || line || ': ' || CASE line % 2 WHEN 0 THEN 'required field ''amount'' is missing' ELSE '''weight'' was not provided' END AS message FROM {_NUMBERED}""")
def q_missing_on_lines(spark, sf_dir):
    """Required and expected line fields that neither the line nor its document has."""
    cfg = schema("order", ORDER, {"amount": {"validator": "money"}, "weight": {"validator": "number", "required": False, "warn_if_missing": True}})
    li = _numbered(spark, sf_dir)
    have = li.select("source_id", "rec", "line", F.when(F.col("line") % 2 == 0, "weight").otherwise("amount").alias("field"))
    docs = spark.createDataFrame([], "source_id string, rec bigint, field string, json string")
    loose = spark.createDataFrame([], "source_id string, rec bigint, line int, ord int, key string, scalar boolean, field string")
    found = engine.missing_on_lines(li.select("source_id", "rec", "line"), have, docs, loose, cfg)
    return found[0].unionByName(found[1]).select("rec", "message")


# ---- rows to documents ---------------------------------------------------------------------------------------
def _folded(df, source: str, rec, columns: dict, name: str):
    """Rows of one table per source, folded: what is the same throughout goes up, the rest are lines."""
    cfg = schema(name, {"status": {"validator": "text", "required": False}}, {"item": {"validator": "text", "required": False}}, csv={"layout": "lines"}, line_containers=["entries"])
    words = Words(cfg)
    cell = lambda i, key, column: F.struct(F.lit(i).alias("ord"), F.lit(key).alias("key"), F.col(column).cast("string").alias("text"))
    placed = df.withColumn("source_id", F.col(source).cast("string")).repartition("source_id")  # rows, before they are cut into cells
    rows = placed.select("source_id", rec.cast("bigint").alias("rec"), F.explode(F.array(*[cell(i, k, c) for i, (k, c) in enumerate(columns.items())])).alias("c"))
    cells = rows.select("source_id", F.lit("csv").alias("format"), "rec", none().cast("int").alias("line"), "c.ord", none().cast("string").alias("container"), "c.key", F.lit("string").alias("kind"), "c.text")
    # stored as the engine stores it, so that its size is known and cells need not move to be joined with it
    km = keep(key_match(df.sparkSession.createDataFrame([(k,) for k in columns], "key string"), engine.match_plans([cfg], {name: words})), "keys")
    records = df.sparkSession.createDataFrame([], "source_id string, rec bigint, type_key string")
    return engine.fold_rows(cells, km, records, cfg, words)


def _order_rows(spark, sf_dir):
    li = _numbered(spark, sf_dir)
    return _folded(li, "l_orderkey", F.col("line"), {"status": "l_linestatus", "part": "l_partkey", "supplier": "l_suppkey", "number": "l_linenumber"}, "order")


@query("""SELECT l_orderkey, count(*) AS n_lines, md5(string_agg(l_partkey || ':' || l_suppkey || ':' || l_linenumber, ',' ORDER BY l_partkey, l_suppkey, l_linenumber)) AS lines FROM lineitem GROUP BY l_orderkey""")
def q_fold_lines(spark, sf_dir):
    value = lambda key: F.max(F.when(F.col("key") == key, F.col("text").cast("bigint"))).alias(key)
    lines = _order_rows(spark, sf_dir).where("line is not null").groupBy("source_id", "line").agg(value("part"), value("supplier"), value("number"))
    per = lines.groupBy("source_id").agg(F.count(F.lit(1)).alias("n_lines"), F.array_sort(F.collect_list(F.struct("part", "supplier", "number"))).alias("a"))
    text = F.transform("a", lambda x: F.concat_ws(":", *[x[c].cast("string") for c in ("part", "supplier", "number")]))
    return per.select(F.col("source_id").cast("bigint").alias("l_orderkey"), "n_lines", F.md5(F.array_join(text, ",")).alias("lines"))


@query("""SELECT l_orderkey, CASE WHEN count(DISTINCT l_linestatus) = 1 THEN min(l_linestatus) END AS hoisted FROM lineitem GROUP BY l_orderkey""")
def q_hoist_columns(spark, sf_dir):
    up = F.max(F.when((F.col("key") == "status") & F.col("line").isNull(), F.col("text")))
    return _order_rows(spark, sf_dir).groupBy("source_id").agg(up.alias("hoisted")).select(F.col("source_id").cast("bigint").alias("l_orderkey"), "hoisted")


@query("""SELECT conv_id, count(*) AS n_turns, string_agg(role, '>' ORDER BY turn) AS roles, CAST(sum(length(text)) AS BIGINT) AS n_chars FROM conversations GROUP BY conv_id""")
def q_conversation_documents(spark, sf_dir):
    """Turns folded into conversations."""
    turns = _folded(table(spark, sf_dir, "conversations"), "conv_id", F.col("turn") + 1, {"role": "role", "words": "text"}, "talk").where("line is not null")
    per = turns.groupBy("source_id").agg(
        F.count_distinct("line").alias("n_turns"), F.array_sort(F.collect_list(F.when(F.col("key") == "role", F.struct("line", "text")))).alias("r"),
        F.sum(F.when(F.col("key") == "words", F.char_length("text"))).alias("n_chars"))
    return per.select(F.col("source_id").cast("bigint").alias("conv_id"), "n_turns", F.array_join(F.transform("r", lambda x: x["text"]), ">").alias("roles"), "n_chars")


# ---- the whole engine over sources of unknown layout ---------------------------------------------------------
CLIENT = {
    "schema_name": "client", "languages": ["en"], "discriminator": {"aliases": ["record type"], "values": ["client"]},
    "document_fields": {
        "name": {"validator": "text", "signature": True, "aliases": ["customer name"]}, "balance": {"validator": "money", "signature": True, "aliases": ["account balance"]},
        "segment": {"validator": "text", "aliases": ["market segment"]}},
}
VENDOR = {
    "schema_name": "vendor", "languages": ["en"], "document_fields": {
        "supplier_name": {"validator": "text", "signature": True}, "supplier_code": {"validator": "identifier", "signature": True}, "debt": {"validator": "number", "required": False, "aliases": ["money owed"], "params": {"minimum": -100000}}},
}


def _unforced(spark, sf_dir):
    """Customers and suppliers by nation as files of JSON lines, read block by block; the schema of each is to be found out."""
    from loomcast.plans.store import scratch
    from loomcast.sources import large

    c = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("nation"), F.struct(
        F.col("c_name").alias("Customer Name"), F.round("c_acctbal", 2).cast("decimal(18,2)").alias("accountBalance"), F.col("c_mktsegment").alias("market_segment")).alias("r"))
    v = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("nation"), F.struct(
        F.col("s_name").alias("Supplier Name"), F.col("s_suppkey").alias("supplier_code"), F.round("s_acctbal", 2).cast("decimal(18,2)").alias("Money Owed"), F.lit(1).alias("zeal")).alias("r"))
    folder = scratch(spark, "written")
    for df, kind in ((c, "c"), (v, "s")):  # a file a nation, written row by row
        rows = df.select(F.concat(F.lit(kind), F.col("nation").cast("string")).alias("source"), F.to_json("r").alias("value"))
        rows.repartition("source").write.mode("append").partitionBy("source").text(folder)
    cells = large.read_json_lines(spark, f"{folder}/source=*")
    cells = cells.withColumn("source_id", F.concat(F.regexp_extract("source_id", r"source=([^/]*)/", 1), F.lit(".json")))
    return engine.transform_cells(cells, engine.prepare([CLIENT, VENDOR]), None, None, TODAY)


_SOURCES = """SELECT 'c' || c_nationkey || '.json' AS source_id, 'client' AS schema, c_acctbal >= 0 AS good, 0 AS extra FROM customer UNION ALL SELECT 's' || s_nationkey || '.json', 'vendor', true, 1 FROM supplier"""


@query(f"""SELECT source_id, schema, 'json' AS format, count(*) AS n_records, bool_and(good) AS is_valid FROM ({_SOURCES}) GROUP BY ALL""")
def q_select_schema(spark, sf_dir):
    return _unforced(spark, sf_dir).header.select("source_id", "schema", "format", "n_records", "is_valid")


@query(f"""SELECT source_id, severity, code, text AS message, count(*) AS n FROM ({_SOURCES}), (VALUES ('error', 'VAL_ERROR', 'negative', false, 0), ('warning', 'UNMAPPED', 'ignored unrecognised field(s): zeal', true, 1)) v(severity, code, text, g, e)
 WHERE (e = 1 AND extra = 1) OR (e = 0 AND NOT good) GROUP BY ALL""")
def q_report_summary(spark, sf_dir):
    """Messages of a run by source, severity and code."""
    found = _unforced(spark, sf_dir).findings
    text = F.when(F.col("message").contains("negative"), "negative").otherwise(F.col("message"))
    return found.groupBy("source_id", "severity", "code", text.alias("message")).agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN '1,' || lpad(CAST(o_orderkey % 1000 AS VARCHAR), 3, '0') WHEN 1 THEN '1,' || (o_orderkey % 90 + 10) ELSE CAST(o_orderkey AS VARCHAR) END AS t, o_orderkey % 3 = 0 AS ambiguous FROM orders""")
def q_money_ambiguous(spark, sf_dir):
    """Amounts that mean different things in English and French, among others that do not."""
    k = F.col("o_orderkey")
    t = F.when(k % 3 == 0, F.concat(F.lit("1,"), F.lpad((k % 1000).cast("string"), 3, "0"))).when(k % 3 == 1, F.concat(F.lit("1,"), (k % 90 + 10).cast("string"))).otherwise(k.cast("string"))
    return table(spark, sf_dir, "orders").select("o_orderkey", t.alias("t")).select("o_orderkey", "t", N.parse_money(F.col("t"), "mixed")["error"].isNotNull().alias("ambiguous"))


@query("""SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H') AS hour, event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY 1, 2""")
def q_event_windows(spark, sf_dir):
    """Tumbling windows over the event table, by the operator of the stream."""
    from loomcast.streaming.files import event_counts

    e = event_counts(table(spark, sf_dir, "events"))
    return e.select(F.date_format("window.start", "yyyy-MM-dd HH").alias("hour"), "event_type", "n", F.round("total", 2).alias("total"))
