"""Cohorts: a filter record that compiles to one boolean Column."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, fields
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .build import KEY


@dataclass(frozen=True)
class Cohort:
    product_code: str = ""
    manufacturer: str = ""
    device_terms: tuple[str, ...] = ()
    narrative: str = ""
    report_key: str = ""
    year_lo: int | None = None
    year_hi: int | None = None
    event_types: tuple[str, ...] = ()
    exclude_forwarded: bool = False
    exclude_rwd: bool = False
    initial_only: bool = False
    implant_only: bool = False
    serious_only: bool = False

    def parts(self) -> list[Column]:
        """The predicates that are set; text is matched literally and without case."""
        if self.report_key:
            return [F.col(KEY).cast("string") == self.report_key]
        has = lambda c, text: F.coalesce(F.lower(c).contains(text.lower()), F.lit(False))
        flag = lambda c: F.coalesce(F.col(c), F.lit(False))
        out: list[Column] = []
        if self.year_lo is not None:
            out.append(F.col("report_year") >= self.year_lo)
        if self.year_hi is not None:
            out.append(F.col("report_year") <= self.year_hi)
        if self.product_code:
            out.append(F.col("product_code") == self.product_code.strip().upper())
        if self.manufacturer:
            out.append(has("manufacturer", self.manufacturer))
        if self.device_terms:
            out.append(reduce(lambda a, b: a | b, [has(c, t) for t in self.device_terms for c in ("BRAND_NAME", "GENERIC_NAME", "MODEL_NUMBER")]))
        if self.narrative:
            out.append(has("narrative_desc", self.narrative))
        if 0 < len(self.event_types) < 3:
            out.append(F.col("EVENT_TYPE").isin(*self.event_types))
        if self.exclude_forwarded:
            out.append(~flag("IS_FORWARDED_803_22_B2"))
        if self.exclude_rwd:
            out.append(~flag("IS_RWD_SOURCED"))
        if self.initial_only:
            out.append(F.coalesce("initial_report", F.lit(True)))
        if self.implant_only:
            out.append(flag("implant_flag"))
        if self.serious_only:
            out.append(flag("any_serious_outcome"))
        return out

    def column(self) -> Column:
        return reduce(lambda a, b: a & b, self.parts(), F.lit(True))

    def of(self, reports: DataFrame) -> DataFrame:
        # one filter a predicate, so that each can reach the scan
        return reduce(lambda df, p: df.filter(p), self.parts(), reports)

    def to_json(self) -> str:
        """C14: what differs from the default."""
        default = asdict(Cohort())
        return json.dumps({k: v for k, v in asdict(self).items() if v != default[k]}, sort_keys=True)

    @classmethod
    def from_json(cls, text: str) -> Cohort:
        given = json.loads(text)
        known = {f.name for f in fields(cls)}
        return cls(**{k: tuple(v) if isinstance(v, list) else v for k, v in given.items() if k in known})

    @classmethod
    def from_terms(cls, terms: str, **rest) -> Cohort:
        """Device terms as typed, separated by semicolons."""
        return cls(device_terms=tuple(t.strip() for t in terms.split(";") if t.strip()), **rest)

    def to_sql(self) -> str:
        """The criteria as SQL with values inlined, for a methods record; it is never executed."""
        quote = lambda s: "'" + s.replace("'", "''") + "'"
        if self.report_key:
            return f"{KEY} = {quote(self.report_key)}"
        contains = lambda c, t: f"contains(lower({c}), {quote(t.lower())})"
        out = []
        if self.year_lo is not None:
            out.append(f"report_year >= {self.year_lo}")
        if self.year_hi is not None:
            out.append(f"report_year <= {self.year_hi}")
        if self.product_code:
            out.append(f"product_code = {quote(self.product_code.strip().upper())}")
        if self.manufacturer:
            out.append(contains("manufacturer", self.manufacturer))
        if self.device_terms:
            out.append("(" + " OR ".join(contains(c, t) for t in self.device_terms for c in ("BRAND_NAME", "GENERIC_NAME", "MODEL_NUMBER")) + ")")
        if self.narrative:
            out.append(contains("narrative_desc", self.narrative))
        if 0 < len(self.event_types) < 3:
            out.append(f"EVENT_TYPE IN ({', '.join(map(quote, self.event_types))})")
        for on, c in (("exclude_forwarded", "NOT coalesce(IS_FORWARDED_803_22_B2, false)"), ("exclude_rwd", "NOT coalesce(IS_RWD_SOURCED, false)"),
                      ("initial_only", "coalesce(initial_report, true)"), ("implant_only", "coalesce(implant_flag, false)"), ("serious_only", "coalesce(any_serious_outcome, false)")):
            if getattr(self, on):
                out.append(c)
        return " AND ".join(out) or "true"


def saying(reports: DataFrame, narrative: DataFrame, phrase: str) -> DataFrame:
    """N06 on whole texts: reports of which some description part holds the phrase, wherever it stands. The filter
    `Cohort.narrative` sees only the characters that the reports table keeps."""
    parts = narrative.filter((F.upper(F.trim("TEXT_TYPE_CODE")) == "D") & F.contains(F.lower("FOI_TEXT"), F.lit(phrase.lower())))
    return reports.join(parts.select(KEY), KEY, "left_semi")


def eligible(from_year: int) -> Column:
    """Reports that may carry a problem code."""
    return F.col("report_year").isNull() | (F.col("report_year") >= from_year)


def of_cohort(child: DataFrame, cohort: DataFrame) -> DataFrame:
    """The rows of a child table that belong to a cohort's reports."""
    return child.join(cohort.select(KEY), KEY, "left_semi")


def with_terms(coded: DataFrame, dictionary: DataFrame) -> DataFrame:
    """Adds `term`, the dictionary's word for `code`, or the code itself."""
    terms = dictionary.select(F.trim("FDA_CODE").alias("code"), F.col("TERM").alias("term")).dropDuplicates(["code"])
    return coded.join(terms, "code", "left").withColumn("term", F.coalesce("term", "code"))
