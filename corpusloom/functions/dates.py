"""Free-form date strings to timestamps, German reading first."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from corpusloom.functions.text import let

# German and English month names and their usual short forms.
MONTHS = {
    1: ("januar", "jänner", "january", "jan"),
    2: ("februar", "february", "feb"),
    3: ("märz", "maerz", "march", "mär", "mar"),
    4: ("april", "apr"),
    5: ("mai", "may"),
    6: ("juni", "june", "jun"),
    7: ("juli", "july", "jul"),
    8: ("august", "aug"),
    9: ("september", "sept", "sep"),
    10: ("oktober", "october", "okt", "oct"),
    11: ("november", "nov"),
    12: ("dezember", "december", "dez", "dec"),
}
# German and English weekday names and their usual short forms.
WEEKDAYS = (
    "montag", "dienstag", "mittwoch", "donnerstag", "freitag", "samstag", "sonnabend", "sonntag",
    "monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday",
    "mo", "di", "mi", "do", "fr", "sa", "so", "mon", "tue", "wed", "thu", "fri", "sat", "sun",
)

_TIME = r"(?:[ t]+(\d{1,2}):(\d{2})(?::(\d{2})(?:\.0+)?)?)?z?"
_NAME = r"([a-zä]+)"
_NUMERIC = rf"^(\d{{1,2}})[./-](\d{{1,2}})[./-](\d{{4}}){_TIME}$"
_ISO = rf"^(\d{{4}})-(\d{{1,2}})-(\d{{1,2}}){_TIME}$"
_DAY_NAME = rf"^(\d{{1,2}})(?:st|nd|rd|th)?[. ] ?{_NAME}[., ]+(\d{{4}}){_TIME}$"
_NAME_DAY = rf"^{_NAME}\.? (\d{{1,2}})(?:st|nd|rd|th)?[., ]+(\d{{4}}){_TIME}$"


def parse_date(text: Column) -> Column:
    """``timestamp_ntz`` or null: day-month-year first, then ISO, then English month-day-year."""
    s = F.lower(F.trim(text))
    s = F.regexp_replace(s, rf"^(?:{'|'.join(sorted(WEEKDAYS, key=len, reverse=True))})[., ]+", "")
    s = F.regexp_replace(s, r",? um |, (?=\d{1,2}:)", " ")
    s = F.regexp_replace(s, r" uhr$", "")

    return let(s, _read)


def _read(s: Column) -> Column:
    # As SQL text: one parse instead of a call per name.
    number = F.expr("map(" + ", ".join(f"'{m}', {n}" for n, names in MONTHS.items() for m in names) + ")")

    def field(pattern: str, i: int) -> Column:
        return F.regexp_extract(s, pattern, i)

    def build(pattern: str, year: int, month: int, day: int, named: bool = False) -> Column:
        def clock(i: int) -> Column:
            return F.coalesce(F.try_to_number(F.nullif(field(pattern, i), F.lit("")), F.lit("99")), F.lit(0)).cast("int")

        month_no = F.try_element_at(number, field(pattern, month)) if named else field(pattern, month).try_cast("int")
        return F.when(
            s.rlike(pattern),
            F.try_make_timestamp_ntz(
                field(pattern, year).try_cast("int"),
                month_no,
                field(pattern, day).try_cast("int"),
                clock(4),
                clock(5),
                clock(6),
            ),
        )

    return F.coalesce(
        build(_NUMERIC, 3, 2, 1),
        build(_ISO, 1, 2, 3),
        build(_DAY_NAME, 3, 2, 1, named=True),
        build(_NAME_DAY, 3, 1, 2, named=True),
        build(_NUMERIC, 3, 1, 2),
    )
