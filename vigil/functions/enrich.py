"""Typed values, flags and labels from raw report fields, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Codes and labels of the published files.
EVENT_LABELS = {"D": "Death", "IN": "Injury", "M": "Malfunction", "*": "Other"}
OUTCOME_LABELS = {
    "D": "death",
    "L": "life_threatening",
    "H": "hospitalization",
    "S": "disability",
    "C": "congenital_anomaly",
    "R": "required_intervention",
    "O": "other",
}
SERIOUS = ("D", "L", "H", "S", "C", "R")
SOURCE_LABELS = {
    "M": "Manufacturer", "U": "User facility", "D": "Distributor",
    "I": "Importer", "V": "Voluntary", "P": "Patient", "C": "Consumer",
}
OCCUPATION_LABELS = {
    "001": "Physician", "002": "Nurse", "003": "Non-healthcare professional",
    "0HP": "Health professional", "0LP": "Lay user / patient",
    "100": "Other healthcare professional", "101": "Audiologist",
    "102": "Dental hygienist", "103": "Dietician", "104": "EMT",
    "105": "Medical technologist", "106": "Nuclear medicine technologist",
    "107": "Occupational therapist", "108": "Paramedic", "109": "Pharmacist",
    "110": "Phlebotomist", "111": "Physical therapist",
    "112": "Physician assistant", "113": "Radiologic technologist",
    "114": "Respiratory therapist", "115": "Speech therapist",
    "116": "Dentist", "117": "Nurse practitioner",
}
#: Years in one unit of a patient's age, and days in one unit of a device's.
PATIENT_AGE_UNITS = {"HR": 1 / (24.0 * 365.25), "DY": 1 / 365.25, "WK": 7.0 / 365.25, "MO": 1 / 12.0, "YR": 1.0, "DEC": 10.0}
DEVICE_AGE_UNITS = {"YR": 365.25, "MO": 30.4375, "WK": 7.0, "DY": 1.0, "HR": 1 / 24.0}

_NUMBER = r"([0-9]+\.?[0-9]*)"
_LETTERS = "([A-Za-z]+)"


def parsed_date(c: Column) -> Column:
    """Yyyymmdd or m/d/yyyy; anything else is null."""
    text = F.trim(c)
    return F.coalesce(
        F.when(text.rlike("^[0-9]{8}$"), F.try_to_date(text, "yyyyMMdd")),
        F.when(text.rlike("^[0-9]{1,2}/[0-9]{1,2}/[0-9]{4}$"), F.try_to_date(text, "M/d/yyyy")),
    )


def _scaled(c: Column, units: dict[str, float], default: str | None) -> Column:
    value = F.regexp_extract(c, _NUMBER, 1).try_cast("double")
    unit = F.upper(F.regexp_extract(c, _LETTERS, 1))
    if default:
        unit = F.when(unit == "", default).otherwise(unit)
    out = F.when(F.lit(False), F.lit(0.0))
    for name, factor in units.items():
        out = out.when(unit == name, value * factor)
    return out


def age_years(c: Column) -> Column:
    """Patient age text in years; no unit means years, an unknown unit is null."""
    return _scaled(c, PATIENT_AGE_UNITS, "YR")


def device_age_days(c: Column) -> Column:
    """Device age text in days; a missing or unknown unit is null."""
    return _scaled(c, DEVICE_AGE_UNITS, None)


def is_rwd(report_number: Column) -> Column:
    """E05"""
    return report_number.ilike("RWD%")


def month(c: Column) -> Column:
    """E07"""
    return F.date_format(c, "yyyy-MM")


def lag_raw(event: Column, received: Column) -> Column:
    """Days from the event to the report, of any sign."""
    return F.datediff(received, event)


def within(c: Column, low, high) -> Column:
    return F.when(c.between(low, high), c)


def is_supplement(c: Column) -> Column:
    """Blank and 0 mean an initial report."""
    return ~F.coalesce(F.trim(c), F.lit("")).isin("", "0")


def supplement_number(c: Column) -> Column:
    return F.nullif(F.trim(c), F.lit("")).try_cast("int")


def yes(c: Column) -> Column:
    """E10"""
    return F.upper(F.trim(F.coalesce(c, F.lit("")))) == "Y"


def canonical(c: Column) -> Column:
    """E11"""
    return F.upper(F.trim(c))


def code_list(c: Column) -> Column:
    """The trimmed codes of a comma-separated list, blanks dropped."""
    return F.filter(F.transform(F.split(F.upper(F.coalesce(c, F.lit(""))), ","), lambda x: F.trim(x)), lambda x: x != "")


def has_outcome(codes: Column, code: str) -> Column:
    """E12, on a code list."""
    return F.array_contains(codes, code)


def is_serious(codes: Column) -> Column:
    return F.arrays_overlap(codes, F.array(*[F.lit(c) for c in SERIOUS]))


def labelled(c: Column, labels: dict[str, str]) -> Column:
    """The label of a code, or the code."""
    out = F.when(F.lit(False), F.lit(""))
    for code, label in labels.items():
        out = out.when(c == code, label)
    return out.otherwise(c)


def age_band(c: Column) -> Column:
    """E14"""
    out = F.when(c.isNull(), "Unknown")
    for below, label in ((1, "<1 year"), (18, "1-17"), (35, "18-34"), (50, "35-49"), (65, "50-64"), (80, "65-79")):
        out = out.when(c < below, label)
    return out.otherwise("80+")


def sex(c: Column) -> Column:
    """Of the first person listed."""
    first = F.upper(F.left(F.coalesce(c, F.lit("U")), F.lit(1)))
    return F.when(first == "F", "Female").when(first == "M", "Male").otherwise("Unknown")
