"""Lenient text to value conversions, all as built-in column expressions."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from arqueo.schemas import MONEY, RATE

# What separates words besides the space, white space trimmed at the ends, and the
# date layouts in the order they are tried.
WORD_BREAKS = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f\x85\u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000$"
)
PADDING = " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\u00a0\u2007\u202f\u3000"
# Layouts for text that is not three numbers.
NAMED_MONTH_LAYOUTS = ("yyyyMMdd", "d-MMM-yyyy", "d MMM yyyy", "MMM d, yyyy", "d-MMMM-yyyy", "d MMMM yyyy", "MMMM d, yyyy")
_TIME = r"(?:[T ]+[0-9]{1,2}:[0-9]{2}(?::[0-9]{2}(?:[.,][0-9]+)?)?\s*(?:[AaPp][Mm])?\s*(?:Z|UTC|[+-][0-9]{2}:?[0-9]{2})?)?$"
_NUMBERS = "^(?:([0-9]{4})[-/.]([0-9]{1,2})[-/.]([0-9]{1,2})|([0-9]{1,2})[-/.]([0-9]{1,2})[-/.]([0-9]{4}))" + _TIME
_DAY_FIRST, _MONTH_FIRST = "$1$6-$2$5-$3$4", "$1$6-$2$4-$3$5"  # groups that take no part are empty


def clean(text: Column) -> Column:
    return F.trim(text.cast("string"), F.lit(PADDING))


def clean_upper(text: Column) -> Column:
    return clean(F.upper(text))


def to_money(text: Column) -> Column:
    """Bad text becomes NULL; NaN never gets in because decimals have none."""
    return clean(text).try_cast(MONEY)


def to_rate(text: Column) -> Column:
    return clean(text).try_cast(RATE)


def to_day(text: Column, day_first: bool = False) -> Column:
    """Year, month and day in any of the usual orders and marks, with or without a time, which is cut off.

    Where the year comes last, ``day_first`` says what the first number is; if it cannot be that, the numbers
    change places. Text that is no date becomes NULL.
    """
    trimmed = clean(text)
    orders = (_DAY_FIRST, _MONTH_FIRST) if day_first else (_MONTH_FIRST, _DAY_FIRST)
    # A cast reads three numbers without the exception that a layout throws for each text that does not fit it.
    numbers = [F.regexp_replace(trimmed, _NUMBERS, order).try_cast("date") for order in orders]
    named = [F.try_to_timestamp(trimmed, F.lit(layout)).cast("date") for layout in NAMED_MONTH_LAYOUTS]
    return F.when(trimmed.rlike(_NUMBERS), F.coalesce(*numbers)).when(trimmed.rlike("[0-9]"), F.coalesce(*named))


def _count(text: Column, mark: str) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(mark), F.lit("")))


def _drop(text: Column, mark: str) -> Column:
    return F.replace(text, F.lit(mark), F.lit(""))


def _comma_is_later(text: Column) -> Column:
    backwards = F.reverse(text)
    return F.instr(backwards, ",") < F.instr(backwards, ".")


def rate_number(text: Column) -> Column:
    """Published rate text to a number. With both marks present the later one is the decimal mark."""
    bare = F.regexp_replace(clean(text), "[$ ]", "")
    has_comma, has_dot = F.contains(bare, F.lit(",")), F.contains(bare, F.lit("."))
    plain = (
        F.when(has_comma & has_dot & _comma_is_later(bare), F.replace(_drop(bare, "."), F.lit(","), F.lit(".")))
        .when(has_comma & has_dot, _drop(bare, ","))
        .otherwise(F.replace(bare, F.lit(","), F.lit(".")))
    )
    return plain.try_cast(RATE)


def _word_number(word: Column) -> Column:
    commas, dots = _count(word, ","), _count(word, ".")
    after_comma = F.length(F.substring_index(word, ",", -1))
    after_dot = F.length(F.substring_index(word, ".", -1))
    comma_as_point = F.replace(word, F.lit(","), F.lit("."))
    plain = (
        F.when((commas > 0) & (dots > 0) & _comma_is_later(word), F.replace(_drop(word, "."), F.lit(","), F.lit(".")))
        .when((commas > 0) & (dots > 0), _drop(word, ","))
        .when((commas == 1) & (after_comma <= 2), comma_as_point)
        .when(commas > 0, _drop(word, ","))
        .when((dots > 1) | ((dots == 1) & (after_dot == 3)), _drop(word, "."))
        .otherwise(word)
    )
    size = F.regexp_replace(plain, "[^0-9.]", "").try_cast("double")
    negative = F.contains(word, F.lit("-")) | (F.contains(word, F.lit("(")) & F.contains(word, F.lit(")")))
    return F.when(negative, -size).otherwise(size)


# A whole word with a digit in it; each character is looked at once.
_NUMBER_WORD = "(?<![^ ])[^ 0-9]*+[0-9][^ ]*+"


def last_number(text: Column) -> Column:
    """Rightmost word of a cell that reads as a number, NULL when there is none."""
    spaced = F.translate(text, WORD_BREAKS, " " * len(WORD_BREAKS))
    words = F.reverse(F.regexp_extract_all(spaced, F.lit(_NUMBER_WORD), F.lit(0)))
    numbers = F.filter(F.transform(words, _word_number), lambda number: number.isNotNull())
    return F.when(text.rlike("[0-9]"), F.get(numbers, F.lit(0)))


# A field of a CSV record with the comma before it: quoted with what may follow the closing quote, or else all up to the next comma.
_FIELD = r',("[^"]*+(?:""[^"]*+)*+"[^,]*+|[^,]*+)'
_QUOTED = r'(?s)^"([^"]*+(?:""[^"]*+)*+)"(.*+)$'
_START, _PLAIN, _INSIDE, _CLOSED = range(4)  # where a quote may stand: at the start of a field, in a bare one, in a quoted one, after a quote there


def ends_quoted(line: Column, inside: bool = False) -> Column:
    """Whether a quoted field is still open at the end of a line that starts at the start of a record, or ``inside`` a quoted field.

    A quote opens a field only at its start; anywhere else in a bare field it is a character like any other.
    """
    parts = F.split(line, '"', -1)

    def next_quote(state: Column, part: Column) -> Column:
        at = F.when((state == _INSIDE) | ((part == "") & (state != _PLAIN)), state).when(F.endswith(part, F.lit(",")), _START).otherwise(_PLAIN)
        return F.when((at == _START) | (at == _CLOSED), F.lit(_INSIDE)).when(at == _INSIDE, F.lit(_CLOSED)).otherwise(F.lit(_PLAIN))

    first = F.lit(_INSIDE if inside else _START)
    before_last = F.slice(parts, F.lit(1), F.size(parts) - 1)
    return F.when(F.contains(line, F.lit('"')), F.aggregate(before_last, first, next_quote) == _INSIDE).otherwise(F.lit(inside))


def csv_fields(line: Column) -> Column:
    """Fields of one CSV record, without the spaces around them; an empty field is NULL.

    A quote at the start of a field hides commas and line breaks up to the closing quote; a doubled one inside is a quote. Any other
    quote, and one that is never closed, stands for itself.
    """
    def bare(field: Column) -> Column:
        quoted = F.startswith(field, F.lit('"')) & field.rlike(_QUOTED)
        inner = F.concat(F.replace(F.regexp_extract(field, _QUOTED, 1), F.lit('""'), F.lit('"')), F.regexp_extract(field, _QUOTED, 2))
        return F.nullif(clean(F.when(quoted, inner).otherwise(field)), F.lit(""))

    return F.transform(F.regexp_extract_all(F.concat(F.lit(","), line), F.lit(_FIELD), F.lit(1)), bare)
