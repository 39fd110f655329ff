"""Text out of records: JSON lines, typed rows and stored response streams."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.functions.text import strip

# Keys and columns in order of preference.
TEXT_KEYS = ("text", "content", "instruction", "prompt")
TEXT_COLUMNS = ("text", "content", "instruction", "prompt", "input")
RESPONSE_KEY = "response"

# Fixed value: every line end Python's ``str.splitlines`` knows.
LINE_ENDS = "\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029]"

_STRICT = {"allowSingleQuotes": "false"}


def is_json(line: Column) -> Column:
    """Whether the line is one JSON value and nothing else.

    Spark's JSON functions ignore what follows the first value; inside an array it shows.
    """
    return F.coalesce(F.json_array_length(F.concat(F.lit("["), line, F.lit(",0]"))) == 2, F.lit(False))


def _kind(value: Column) -> Column:
    return F.schema_of_variant(value)


def _text_of(value: Column) -> Column:
    return F.try_variant_get(value, "$", "string")


def _spelled(value: Column, raw: Column) -> Column:
    """A value as text: strings as they are, true and false capitalised, the rest as JSON."""
    kind = _kind(value)
    return (
        F.when(kind == "STRING", _text_of(value))
        .when(kind == "BOOLEAN", F.initcap(_text_of(value)))
        .when(kind == "VOID", F.lit("None"))
        .otherwise(raw)
    )


def _truthy(value: Column) -> Column:
    """Empty text, zero, false, null and empty containers do not count; blanks do."""
    kind = _kind(value)
    number = kind.rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT)")
    return (
        F.when(kind == "VOID", F.lit(False))
        .when(number, F.try_variant_get(value, "$", "double") != 0)
        .when(kind == "STRING", _text_of(value) != "")
        .otherwise(~_text_of(value).isin("false", "[]", "{}"))
    )


def _last_value(entries: Column, key: str) -> Column:
    """The value of a key; of a repeated key the last value counts."""
    return F.try_element_at(F.filter(entries, lambda e: e["key"] == key), F.lit(-1))["value"]


def with_json_text(
    df: DataFrame,
    line: str,
    keys: Sequence[str] = TEXT_KEYS,
    fallback: str = "first",
    text: str = "text",
) -> DataFrame:
    """Add the text of the JSON line in column ``line``; null where it holds none.

    An object gives its first truthy key; without one, ``fallback`` takes the first non-blank
    string value (``first``) or all of them joined by a space (``join``), in the object's order.
    Any other JSON value gives its own spelling, and a line that is not JSON is the text itself.
    Parsing is a step of its own, so the optimizer keeps it to one run per line.
    """
    if fallback not in ("first", "join"):
        raise ValueError(f"unknown fallback: {fallback!r}")
    quoted = [key for key in keys if "'" in key]
    if quoted:
        raise ValueError(f"keys hold quotes: {quoted!r}")
    stripped = df.withColumn("_line", strip(F.col(f"`{line}`")))
    content = F.col("_line")
    is_object = content.startswith("{")
    as_map = F.from_json(content, T.MapType(T.StringType(), T.VariantType()), _STRICT)
    checked = stripped.withColumn("_valid", is_json(content))
    parsed = checked.withColumns(
        {
            "_entries": F.when(F.col("_valid") & is_object, F.map_entries(as_map)),
            "_other": F.when(F.col("_valid") & ~is_object, F.try_parse_json(content)),
        }
    )
    found = parsed.withColumns({f"_key{i}": _last_value(F.col("_entries"), k) for i, k in enumerate(keys)})
    named = []
    for i, key in enumerate(keys):
        value = F.col(f"_key{i}")
        raw = F.get_json_object(content, f"$['{key}']")
        named.append(F.when(_truthy(value), _spelled(value, raw)))
    strings = F.filter(
        F.transform("_entries", lambda e: F.when(_kind(e["value"]) == "STRING", _text_of(e["value"]))),
        lambda s: F.length(strip(s)) > 0,
    )
    rest = (
        F.try_element_at(strings, F.lit(1))
        if fallback == "first"
        else F.nullif(F.array_join(strings, " "), F.lit(""))
    )
    result = (
        F.when(F.length(content) == 0, F.lit(None))
        .when(F.col("_entries").isNotNull(), F.coalesce(*named, rest))
        .when(F.col("_other").isNotNull(), _spelled(F.col("_other"), content))
        .otherwise(content)
    )
    return found.select(*[F.col(f"`{c}`") for c in df.columns if c != text], result.alias(text))


def row_text(df: DataFrame, keys: Sequence[str] = TEXT_KEYS, fallback: str = "join") -> Column:
    """The text of a typed row: the first truthy key column, else its non-blank string columns."""
    named = []
    for key in keys:
        if key not in df.columns:
            continue
        kind = df.schema[key].dataType
        value = F.col(f"`{key}`")
        if isinstance(kind, T.StringType):
            named.append(F.when(value != "", value))
        elif isinstance(kind, T.BooleanType):
            named.append(F.when(value, F.lit("True")))
        elif isinstance(kind, T.NumericType):
            named.append(F.when(value != 0, value.cast("string")))
        elif isinstance(kind, (T.ArrayType, T.MapType)):
            named.append(F.when(F.size(value) > 0, F.to_json(value)))
        elif isinstance(kind, T.StructType):
            named.append(F.to_json(value))
        else:
            named.append(value.cast("string"))
    strings = [
        F.when(F.length(strip(F.col(f"`{f.name}`"))) > 0, F.col(f"`{f.name}`"))
        for f in df.schema
        if isinstance(f.dataType, T.StringType)
    ]
    if not strings:
        rest = F.lit(None).cast("string")
    elif fallback == "join":
        rest = F.nullif(F.concat_ws(" ", *strings), F.lit(""))
    else:
        rest = F.coalesce(*strings)
    return F.coalesce(*named, rest)


def pick_text(df: DataFrame, columns: Sequence[str] = TEXT_COLUMNS) -> Column:
    """The first known text column of the table, else the whole row as JSON."""
    for name in columns:
        if name in df.columns:
            return F.col(f"`{name}`").alias("text")
    return F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("text")


def joined_responses(body: Column, field: str = RESPONSE_KEY) -> Column:
    """Concatenate one string field over all lines of a stored NDJSON response.

    Of a repeated key the last value counts. Lines that are no JSON object and values that are not strings add
    nothing.
    """
    kind = T.MapType(T.StringType(), T.VariantType())
    # A line that does not end with a brace has more after its object or is none.
    lines = F.filter(
        F.transform(F.split(body, LINE_ENDS), strip), lambda line: line.startswith("{") & line.endswith("}")
    )
    entries = F.transform(
        lines, lambda line: F.when(is_json(line), F.map_entries(F.from_json(line, kind, _STRICT)))
    )
    values = F.transform(entries, lambda found: _last_value(found, field))
    texts = F.transform(values, lambda value: F.when(_kind(value) == "STRING", _text_of(value)))
    return F.array_join(texts, "")
