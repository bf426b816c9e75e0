"""Column-name rules: normalisation, identifier and time patterns, quoting."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The words that make a column name an identifier, an entity key or a time axis.
KEY_WORDS = ["id", "key", "uuid", "guid", "pk", "sk", "code"]
WHOLE_NAME_KEYS = ["pid", "uid", "sku", "upc", "ean", "uuid", "guid"]
ENTITY_WORDS = [
    "player", "user", "entity", "customer", "account", "member", "product", "vendor", "tenant",
]
ENTITY_SUFFIXES = ["id", "key", "code", "no"]
DATE_WORDS = ["date", "time", "timestamp", "ts", "dt", "created", "updated"]
PERIOD_WORDS = ["year", "season", "period", "quarter", "month", "week", "day"]
BOOLEAN_TOKENS = ["true", "false", "t", "f", "yes", "no", "1", "0"]


def _any(words: list[str]) -> str:
    return "|".join(words)


KEY_SEGMENT = f"(^|_)({_any(KEY_WORDS)})(_|$)"
ENTITY_NAME = (
    f"^({_any(WHOLE_NAME_KEYS)})$|(^|_)({_any(ENTITY_WORDS)})_({_any(ENTITY_SUFFIXES)})(_|$)"
)
DATE_ANYWHERE = f"({_any(DATE_WORDS)})"
DATE_SEGMENT = f"(^|_)({_any(DATE_WORDS)})(_|$)"
PERIOD_ANYWHERE = f"({_any(PERIOD_WORDS)})"


def quoted(name: str) -> str:
    """A column name as a Spark identifier, whatever characters it holds."""
    return "`" + name.replace("`", "``") + "`"


def text_literal(text: str) -> str:
    """A Python string as a Spark SQL literal."""
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def col(name: str) -> Column:
    return F.col(quoted(name))


def snake_name(name: Column) -> Column:
    """Trim, blanks to ``_``, camelCase to snake_case, lower."""
    spaced = F.replace(F.trim(name), F.lit(" "), F.lit("_"))
    return F.lower(F.regexp_replace(spaced, "([a-z0-9])([A-Z])", "$1_$2"))


def is_identifier_name(name: Column) -> Column:
    snake = snake_name(name)
    return snake.rlike(KEY_SEGMENT) | snake.rlike(ENTITY_NAME)


def name_strength(name: Column) -> Column:
    """3 for a key word as a whole segment, 2 for an entity name only, else 0."""
    snake = snake_name(name)
    return F.when(snake.rlike(KEY_SEGMENT), 3).when(snake.rlike(ENTITY_NAME), 2).otherwise(0)


def is_date_name(name: Column, strict: bool = False) -> Column:
    """Loose: a date word anywhere in the name. Strict: a date word as a whole segment."""
    return snake_name(name).rlike(DATE_SEGMENT if strict else DATE_ANYWHERE)


def is_period_name(name: Column) -> Column:
    return F.lower(name).rlike(PERIOD_ANYWHERE)
