import copy
import json

import pytest

from loomcast.plans import config as C

#: A ferry line's tickets: a configuration that uses every kind of block.
FERRY = {
    "schema_name": "ticket", "languages": ["en", "fr"], "default_language": "en", "source_formats": ["json", "csv"], "csv": {"delimiter": ";", "layout": "lines"},
    "settings": {"number_locale": "auto", "fuzzy_threshold": 0.8}, "limits": {"fare": [1, 90]}, "output": {"type_key": "kind"},
    "vocabularies": {"deck": {"upper": {"aliases": ["sun deck"]}, "lower": {"aliases": []}}}, "discriminator": {"aliases": ["ticket type"], "values": ["crossing"]},
    "document_fields": {
        "passenger": {"validator": "text", "aliases": ["traveller"], "i18n": {"fr": {"aliases": ["voyageur"]}}},
        "sailing": {"validator": "date", "required": False},
        "fare_total": {"validator": "money", "params": {"limit": "fare"}, "required": False},
    },
    "line_fields": {"deck": {"validator": "vocabulary", "params": {"vocabulary": "deck"}}, "fare": {"validator": "money", "sums_to_total": True}},
    "total_field": "fare_total", "line_containers": ["legs"], "abbreviation_rules": [{"abbreviation": "psgr", "expansion": "passenger", "confidence": 0.9}],
    "i18n": {"fr": {"line_containers": ["trajets"]}}, "rules": [{"kind": "rate_limit", "amount_field": "fare", "unit_field": "deck", "max_rate": 5}],
}


def places(form, body, path=()):
    """(path, form) of every place of a configuration that its grammar knows."""
    yield path, form
    if isinstance(body, dict):
        for key, part in body.items():
            inner = (form.keys or {}).get(key) or form.each
            if inner:
                yield from places(inner, part, (*path, key))
    elif isinstance(body, list) and form.each:
        for k, part in enumerate(body):
            yield from places(form.each, part, (*path, k))


def changed(path, value=None, drop=None, add=None):
    """FERRY with another value at a path, or one key less or more there."""
    out = copy.deepcopy(FERRY)
    at = out
    for step in path[:-1]:
        at = at[step]
    if drop or add:
        at = at[path[-1]] if path else at
        at.pop(drop, None)
        at.update({add: 1} if add else {})
    else:
        at[path[-1]] = value
    return out


PLACES = [(path, form) for path, form in places(C.SCHEMA, FERRY) if path]


def test_the_ferry_is_accepted():
    cfg = C.build_schema_config(FERRY)
    assert (cfg.name, cfg.languages, cfg.total_field, [f.name for f in cfg.line_fields]) == ("ticket", ("en", "fr"), "fare_total", ["deck", "fare"])


def test_every_place_refuses_another_type():
    typed = [(path, form) for path, form in PLACES if form.of is not object]
    assert len(typed) > 20
    for path, _ in typed:
        with pytest.raises(C.ConfigError):
            C.build_schema_config(changed(path, 17))


def test_every_object_refuses_strange_keys_and_misses_needed_ones():
    closed = [(path, form) for path, form in [((), C.SCHEMA), *PLACES] if form.keys]
    assert len(closed) > 8
    for path, form in closed:
        with pytest.raises(C.ConfigError, match="unknown key"):
            C.build_schema_config(changed(path, add="wheelhouse"))
        for key in form.need:
            with pytest.raises(C.ConfigError, match=f"missing '{key}'|required"):
                C.build_schema_config(changed(path, drop=key))
        C.build_schema_config(changed(path, add="_remark"))


@pytest.mark.parametrize(("path", "value"), [
    (("languages",), []), (("languages",), ["welsh"]), (("settings", "number_locale"), "cy"), (("limits", "fare"), [90, 1]), (("limits", "fare"), ["1", 2]), (("source_formats",), ["xls"]),
    (("csv", "layout"), "columns"), (("document_fields", "fare_total", "params", "limit"), "toll"), (("line_fields", "deck", "params", "vocabulary"), "cabin"), (("document_fields", "passenger", "validator"), "sailor"),
    (("abbreviation_rules", 0, "confidence"), 7), (("rules", 0, "kind"), "tide"), (("rules", 0), {"kind": "custom", "name": "not there"}), (("line_fields",), {}), (("schema_name",), None),
    (("document_fields", "passenger"), {"validator": "regex", "params": {"patterns": ["[a"]}}), (("target_schema",), {"fathoms": 3}), (("target_schema",), {"anyOf": []}),
    (("target_schema",), {"$ref": "#/$defs/ship", "$defs": {"ship": {"$ref": "#/$defs/ship"}}}),
])
def test_values_that_make_no_sense(path, value):
    with pytest.raises(C.ConfigError):
        C.build_schema_config(changed(path, value))


def test_a_fleet_of_configurations(tmp_path):
    """Grandparent, parent and child: blocks merge, lists are replaced, null takes a field away, the last word counts."""
    sea = {"languages": ["en"], "settings": {"fuzzy_threshold": 0.7, "day_first": False}, "document_fields": {"vessel": {"validator": "text", "aliases": ["ship", "boat"]}, "berth": {"validator": "text"}}}
    harbour = {"extends": ["_sea.json"], "settings": {"day_first": True}, "document_fields": {"pilot": {"validator": "text", "required": False}, "vessel": {"aliases": ["hull"]}}}
    quay = {"extends": ["_harbour.json"], "schema_name": "quay", "document_fields": {"berth": None, "pilot": {"required": True}}}
    for name, body in (("_sea", sea), ("_harbour", harbour), ("quay", quay)):
        (tmp_path / f"{name}.json").write_text(json.dumps(body))
    (cfg,) = C.load_schema_configs(tmp_path)
    assert [f.name for f in cfg.document_fields] == ["vessel", "pilot"]
    vessel, pilot = cfg.document_fields
    assert vessel.aliases["en"] == ["hull"] and pilot.required
    assert (cfg.settings["fuzzy_threshold"], cfg.settings["day_first"]) == (0.7, True)


def test_configurations_that_extend_each_other(tmp_path):
    ring = ["_a", "_b", "_c"]
    for name, other in zip(ring, [*ring[1:], ring[0]], strict=True):
        (tmp_path / f"{name}.json").write_text(json.dumps({"extends": [f"{other}.json"]}))
    with pytest.raises(C.ConfigError, match="circular"):
        C.resolve(tmp_path / "_b.json")


def test_a_configuration_as_python(tmp_path):
    (tmp_path / "ferry.py").write_text(f"CONFIG = {FERRY!r}")
    (cfg,) = C.load_schema_configs(tmp_path / "ferry.py")
    assert cfg.name == "ticket"


def test_words_of_several_languages_say_nothing():
    words = {"en": ["telephone", "phone"], "fr": ["téléphone"], "*": ["tel"], "de": ["telefon"]}
    assert C.active(words, ("en", "fr")) == [("telephone", "*"), ("phone", "en"), ("tel", "*")]


def test_target_keywords():
    from loomcast.plans.target import compile_schema, violations

    schema = compile_schema({
        "$defs": {"day": {"type": "string", "format": "date"}}, "type": "object", "minProperties": 1,
        "properties": {
            "day": {"$ref": "#/$defs/day"}, "n": {"anyOf": [{"type": "null"}, {"type": "number", "exclusiveMinimum": 0, "multipleOf": 0.1}]},
            "kind": {"oneOf": [{"const": "a"}, {"enum": ["a", "b"]}], "not": {"const": "c"}}, "tags": {"type": "array", "maxItems": 2, "uniqueItems": True},
        }})
    assert violations({"day": "2024-02-03", "n": 0.3, "kind": "b", "tags": [1, 2]}, schema) == [] and violations({"n": None}, schema) == []
    bad = violations({"day": "3 May", "n": 0, "kind": "a", "tags": [1, 1, 2]}, schema)
    assert [p[0] for p, _ in bad] == ["day", "kind", "n", "tags", "tags"] and [p for p, _ in violations({}, schema)] == [()]
