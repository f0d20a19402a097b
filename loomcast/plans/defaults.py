"""Fixed values of the configuration: settings, output names, language packs."""

SETTINGS = {
    "abbreviation_confidence_without_warning": 0.90,
    "allow_future_dates": False,
    "ambiguous_number_policy": "error",
    "conflicting_values_policy": "error",
    "day_first": True,
    "discriminator_threshold": 0.75,
    "fuzzy_threshold": 0.80,
    "inherit_shared_fields": False,
    "interpret_root_amount_as_total": False,
    "leaf_only_match_penalty": 0.95,
    "max_age_days": 730,
    "min_schema_margin": 0.05,
    "min_schema_score": 0.50,
    "number_locale": "auto",
    "preferred_language": None,
    "similarity_weights": {"signature": 0.5, "required": 0.2, "coverage": 0.3},
    "single_line_total_as_amount": False,
    "total_mismatch_severity": "error",
    "vocabulary_threshold": 0.75,
    "weak_alias_confidence": 0.85,
}
OUTPUT = {"type_key": "schema", "fields_key": "fields", "lines_key": "lines"}
LANGUAGES = ("en",)
PACKS = {
    "en": {
        "stopwords": ["of", "the", "a", "an", "for", "and", "s"],
        "generic_aliases": ["amount", "cost", "fee", "charge", "price", "date", "code", "type"],
        "generic_line_containers": ["lines", "line items", "items", "details", "services", "claim lines", "service lines", "entries", "rows"],
    },
    "fr": {
        "stopwords": ["de", "du", "des", "d", "la", "le", "les", "l", "un", "une", "et", "au", "aux", "a", "pour", "s"],
        "generic_aliases": ["montant", "cout", "frais", "prix", "tarif", "date", "code", "type"],
        "generic_line_containers": ["lignes", "lignes de service", "articles", "details", "services", "entrées", "éléments", "rangées"],
    },
}
LANGUAGE_TAGS = {"en": ["en", "eng", "english", "anglais"], "fr": ["fr", "fra", "fre", "french", "francais", "français"]}
