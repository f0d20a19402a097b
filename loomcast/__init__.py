"""loomcast: schema detection, mapping, validation and normalisation of records on Spark."""

from loomcast.functions.validators import fail, ok, outcome, register_validator
from loomcast.plans.config import ConfigError, FieldSpec, SchemaConfig, SourceError, build_schema_config, load_schema_config, load_schema_configs, register_record_rule, register_rule
from loomcast.plans.engine import Report, transform

__all__ = [
    "ConfigError", "FieldSpec", "Report", "SchemaConfig", "SourceError", "build_schema_config", "fail", "load_schema_config", "load_schema_configs",
    "ok", "outcome", "register_record_rule", "register_rule", "register_validator", "transform",
]
