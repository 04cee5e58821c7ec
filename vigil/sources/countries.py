"""The country dimension (E16): two-letter codes with their three-letter codes and English names."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Codes in use beside the standard's.
ALIASES = {"UK": "GB"}


def countries(spark: SparkSession) -> DataFrame:
    """(country, iso3, name) of ISO 3166, as the Java runtime knows it: some 250 rows."""
    locale = spark.sparkContext._jvm.java.util.Locale
    codes = {c: c for c in locale.getISOCountries()} | ALIASES
    known = [(code, locale("", own)) for code, own in codes.items()]
    return spark.createDataFrame([(code, x.getISO3Country(), x.getDisplayCountry(locale.ENGLISH)) for code, x in known], "country string, iso3 string, name string")
