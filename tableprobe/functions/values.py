"""Column expressions over single cells. Text follows one rule set whatever its source: see each function."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# What counts as blank, as a literal, and as a number or date by shape.
BLANK_ENDS = r"^[\s\x{00a0}\x{feff}]+|[\s\x{00a0}\x{feff}]+$"
NOT_BLANK = r"[^\s\x{00a0}\x{feff}]"
BLANKS = (" ", "\t", "\n", "\x0b", "\f", "\r", "\u00a0", "\ufeff")
BOOLEAN_WORDS = ("true", "false", "yes", "no")
TRUE_WORDS, FALSE_WORDS = ("true", "yes", "1"), ("false", "no", "0")
INTEGER = r"^[+-]?\d+$"
FLOAT = r"^[+-]?(\d+\.\d*|\.\d+)([eE][+-]?\d+)?$"
NUMBER = r"^[+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?$"
PADDED_NUMBER = r"^[\s\x{00a0}\x{feff}]*[+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?[\s\x{00a0}\x{feff}]*$"
ISO_SHAPE = r"(?i)^\d{4}-(\d{2})-(\d{2})(t\d{2}:\d{2}(:\d{2})?(\.\d+)?(z|[+-]\d{2}:?\d{2})?)?$"
SHORT_SHAPE = r"^(\d{1,2})[/.-](\d{1,2})[/.-]\d{2,4}$"
# Least percentage for error and for warning, by check.
SEVERITY_LIMITS = {"missing-values": (30, 5), "duplicate-rows": (5, 1), "mixed-types": (20, 5), "outliers": (5, 1)}
INCONSISTENT_ERROR = 50


def col(name: str) -> Column:
    """A column by its name as it is, whatever dots, blanks or backticks it holds."""
    return F.col(quoted(name))


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def trimmed(c: Column) -> Column:
    """Without white space, no-break spaces and byte-order marks at its ends. Most cells have none: a look at two
    characters tells."""
    blank = F.substring(c, 1, 1).isin(*BLANKS) | F.substring(c, -1, 1).isin(*BLANKS)
    return F.when(blank, F.regexp_replace(c, BLANK_ENDS, "")).otherwise(c)


def is_empty(c: Column, kind: T.DataType = T.StringType()) -> Column:
    """Null, not a number, or blank."""
    if isinstance(kind, T.StringType):  # most cells begin with what is no blank
        return c.isNull() | F.when((c == "") | F.substring(c, 1, 1).isin(*BLANKS), ~c.rlike(NOT_BLANK)).otherwise(F.lit(False))
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        return c.isNull() | F.isnan(c)
    return c.isNull()


def empty_of(df: DataFrame, name: str) -> Column:
    return is_empty(col(name), df.schema[name].dataType)


def is_date_like(s: Column) -> Column:
    """An ISO or short date by shape, its month (the first of a short date's parts) and day within range."""
    part = lambda shape, k: F.expr("cast(null as int)") if shape is None else F.regexp_extract(s, shape, k).try_cast("int")
    fits = lambda shape: s.rlike(shape) & part(shape, 1).between(1, 12) & part(shape, 2).between(1, 31)
    return fits(ISO_SHAPE) | fits(SHORT_SHAPE)


def _typed(c: Column, kind: T.DataType, whole: str, part: str) -> Column | None:
    if isinstance(kind, T.BooleanType):
        return F.lit("boolean")
    if isinstance(kind, T.IntegralType):
        return F.lit(whole)
    if isinstance(kind, (T.FractionalType, T.DecimalType)):
        return F.when(c == F.floor(c), whole).otherwise(part)
    if isinstance(kind, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return F.lit("date")
    return None if isinstance(kind, T.StringType) else F.lit("string")


def classify_value(c: Column, kind: T.DataType = T.StringType()) -> Column:
    """boolean, integer, float, date or string; null for empty cells."""
    typed = typed_class(c, kind)
    return F.when(~is_empty(c, kind), classify_text(c.cast("string")) if typed is None else typed)


def typed_class(c: Column, kind: T.DataType) -> Column | None:
    """The class of a cell by its column's type; null where cells are text."""
    return _typed(c, kind, "integer", "float")


def typed_bucket(c: Column, kind: T.DataType) -> Column | None:
    return _typed(c, kind, "number", "number")


def classify_text(c: Column) -> Column:
    """The class of a text that isn't empty."""
    return trimmed_class(trimmed(c))


def trimmed_class(s: Column) -> Column:
    """The class of a trimmed text: best a column of its own, as each name of an expression computes it again."""
    number = F.when(s.rlike(INTEGER), "integer").when(s.rlike(FLOAT), "float").when(is_date_like(s), "date").otherwise("string")
    return F.when(_numeric_lead(s), number).otherwise(_word(s))


def bucket_text(c: Column) -> Column:
    return trimmed_bucket(trimmed(c))


def trimmed_bucket(s: Column) -> Column:
    return F.when(_numeric_lead(s), F.when(s.rlike(NUMBER), "number").when(is_date_like(s), "date").otherwise("string")).otherwise(_word(s))


def _numeric_lead(s: Column) -> Column:
    """Whether a text begins as all numbers and dates do: others cost no pattern."""
    lead = F.substring(s, 1, 1)
    return lead.between("0", "9") | lead.isin("+", "-", ".")


def _word(s: Column) -> Column:
    return F.when((F.length(s) <= 5) & F.lower(s).isin(*BOOLEAN_WORDS), "boolean").otherwise("string")


def classify_bucket(c: Column, kind: T.DataType = T.StringType()) -> Column:
    """The coarser number, boolean, date or string of the mixed-type check; null for empty cells."""
    typed = typed_bucket(c, kind)
    return F.when(~is_empty(c, kind), bucket_text(c.cast("string")) if typed is None else typed)


def to_number(c: Column, kind: T.DataType = T.StringType()) -> Column:
    """The finite number a cell holds or spells in decimal notation, else null; dates count as milliseconds."""
    if isinstance(kind, T.BooleanType):
        return F.lit(None).cast("double")
    if isinstance(kind, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return F.unix_millis(c.cast("timestamp")).cast("double")
    if isinstance(kind, T.NumericType):
        x = c.cast("double")
    else:
        x = F.when(c.rlike(PADDED_NUMBER), trimmed(c).try_cast("double"))  # c is named few times, as it may be long itself
    return F.when(~F.isnan(x) & (F.abs(x) != float("inf")), x)


def coerce_to_number(c: Column, kind: T.DataType = T.StringType()) -> Column:
    """As to_number, but of numbers and text only."""
    if isinstance(kind, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return F.lit(None).cast("double")
    return to_number(c, kind)


def normalize_category(c: Column) -> Column:
    return F.regexp_replace(F.lower(trimmed(c)), r"\s+", " ")


def percentage_of(count: Column, total: Column) -> Column:
    return F.when(total == 0, F.lit(0.0)).otherwise(count * 100.0 / total)


def severity_of(check: str, count: Column, percentage: Column) -> Column:
    error, warning = SEVERITY_LIMITS[check]
    return F.when(count == 0, "info").when(percentage >= error, "error").when(percentage >= warning, "warning").otherwise("info")


def severity_rank(severity: Column) -> Column:
    return F.when(severity == "error", 0).when(severity == "warning", 1).otherwise(2)


def csv_cell(c: Column) -> Column:
    """Quoted only where a quote, a comma or a line end demands it; null is empty."""
    text = F.coalesce(c.cast("string"), F.lit(""))
    return F.when(text.rlike('[",\r\n]'), F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(text)


def markdown_cell(c: Column) -> Column:
    """For a table's cell: bars escaped, line ends as blanks."""
    text = F.coalesce(c.cast("string"), F.lit(""))
    return F.regexp_replace(F.replace(text, F.lit("|"), F.lit("\\|")), r"\r?\n", " ")


def coerce_value(c: Column, target: str) -> tuple[Column, Column]:
    """(canonical text or the cell itself, whether a cell that is not empty could be coerced)."""
    from tableprobe.functions.dates import iso_or_parsed

    s = trimmed(c)
    number = F.when(s.rlike(NUMBER), s.try_cast("double"))
    whole = F.when(number < 0, F.ceil(number)).otherwise(F.floor(number))
    made = {
        "string": c,
        "integer": whole.cast("string"),
        "float": number.cast("string"),
        "number": number.cast("string"),
        "boolean": F.when(F.lower(s).isin(*TRUE_WORDS), "true").when(F.lower(s).isin(*FALSE_WORDS), "false"),
        "date": iso_or_parsed(c),
    }[target]
    filled = ~is_empty(c)
    return F.when(filled, F.coalesce(made, c)).otherwise(c), filled & made.isNotNull()
