"""Personal data: patterns propose spans, checksums confirm them, and the words around adjust their score.

Four base kinds are always reported once their pattern and their check agree: e-mail addresses, IPv4 addresses (parts
at most 255), payment cards (16 to 19 digits, Luhn) and international phone numbers (8 to 15 digits). Added kinds are
reported only from `THRESHOLD` on and where they touch no span of a kind before them: bank accounts (mod-97), national identity numbers
(valid ranges) and local phone numbers; the last two need a word nearby that speaks for them. Matches are leftmost and
do not overlap within a kind; one that fails its check is dropped and nothing inside it is tried again.

Patterns that a hostile text could make quadratic (a megabyte of letters without an @, of digits without a point) are
anchored on what is rare, the @, or run over maximal runs, with the same matches; each text is read whole in one pass a
kind, row by row, without a shuffle.

Defined cases: null text is empty and has no span; repeated rows, ties and extra columns stay as they are; offsets are
code points, end exclusive; a column of the name given for the spans is replaced.
"""

from __future__ import annotations

import bisect
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

BASE = ("email", "ip", "card", "phone")
ADDED = ("iban", "ssn", "local_phone")
THRESHOLD = 0.5
#: Code points before and after a span whose words count.
BEFORE, AFTER = 48, 24

# Words that speak for a kind, and for none.
SPEAKS_FOR = {
    "email": ("email", "mail", "contact", "correo", "courriel"),
    "ip": ("ip", "host", "server", "address", "login"),
    "card": ("card", "visa", "mastercard", "credit", "debit", "payment", "karte", "carte", "tarjeta"),
    "phone": ("phone", "tel", "telephone", "call", "mobile", "fax", "telefon", "téléphone", "teléfono"),
    "iban": ("iban", "account", "bank", "konto", "compte", "cuenta"),
    "ssn": ("ssn", "social", "security", "taxpayer", "identity"),
    "local_phone": ("phone", "tel", "telephone", "call", "mobile", "fax", "telefon", "téléphone", "teléfono"),
}
SPEAKS_AGAINST = ("order", "invoice", "version", "isbn", "sku", "serial", "part", "ticket", "tracking")
FIRST_SCORE = {"email": 0.7, "ip": 0.5, "card": 0.7, "phone": 0.6, "iban": 0.7, "ssn": 0.3, "local_phone": 0.3}
FOR, AGAINST = 0.25, 0.3

_LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_DOTTED = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++)++")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_IBAN = re.compile(r"\b[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}\b", re.ASCII)
_SSN = re.compile(r"\b([0-9]{3})-([0-9]{2})-([0-9]{4})\b", re.ASCII)
_LOCAL_PHONE = re.compile(r"(?:\([0-9]{3}\) ?|\b[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}\b", re.ASCII)
_WORD = re.compile(r"[^\W\d_]+")

SPANS = T.ArrayType(
    T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("value", T.StringType()), T.StructField("score", T.DoubleType())])
)
_ARROW = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("value", pa.string()), ("score", pa.float64())]))


def luhn(digits: str) -> bool:
    """Every second digit from the right is doubled, 9 taken off where that makes two digits; the sum ends in 0."""
    other = sum(2 * d - 9 * (d > 4) for d in map(int, digits[-2::-2]))
    return (sum(map(int, digits[-1::-2])) + other) % 10 == 0


def mod97(account: str) -> bool:
    """Country and check digits behind the rest, letters as 10 to 35: the number leaves 1."""
    return int("".join(str(int(c, 36)) for c in account[4:] + account[:4])) % 97 == 1


def _digits(text: str) -> str:
    return "".join(c for c in text if c in "0123456789")


def emails(text: str) -> Iterator[tuple[int, int]]:
    """As [A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\\.[A-Za-z0-9-]+)+ finds them, from each @ to both sides."""
    free, at = 0, text.find("@")
    while at >= 0:
        start = free + len(text[free:at].rstrip(_LOCAL))
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            yield start, domain.end()
        free = domain.end() if domain else at + 1
        at = text.find("@", free)


def addresses(text: str) -> Iterator[tuple[int, int]]:
    """Four numbers joined by points, taken four by four from each run of such numbers."""
    for run in _DOTTED.finditer(text):
        at, parts = run.start(), run[0].split(".")
        for i in range(0, len(parts) - 3, 4):
            four = parts[i : i + 4]
            end = at + len(".".join(four))
            if all(len(x) <= 3 and int(x) <= 255 for x in (p.lstrip("0") or "0" for p in four)):
                yield at, end
            at = end + 1


def cards(text: str) -> Iterator[tuple[int, int]]:
    for m in _CARD.finditer(text):
        digits = _digits(m[0])
        if 16 <= len(digits) <= 19 and luhn(digits):
            yield m.span()


def phones(text: str) -> Iterator[tuple[int, int]]:
    for m in _PHONE.finditer(text):
        if 8 <= len(_digits(m[0])) <= 15:
            yield m.span()


def accounts(text: str) -> Iterator[tuple[int, int]]:
    for m in _IBAN.finditer(text):
        if mod97(m[0].replace(" ", "")):
            yield m.span()


def identities(text: str) -> Iterator[tuple[int, int]]:
    for m in _SSN.finditer(text):
        if m[1] not in ("000", "666") and m[1] < "900" and m[2] != "00" and m[3] != "0000":
            yield m.span()


def local_phones(text: str) -> Iterator[tuple[int, int]]:
    for m in _LOCAL_PHONE.finditer(text):
        yield m.span()


_FINDERS = {"email": emails, "ip": addresses, "card": cards, "phone": phones, "iban": accounts, "ssn": identities, "local_phone": local_phones}


def score(text: str, kind: str, start: int, end: int) -> float:
    """The kind's first score, more if a word nearby speaks for it, less if one speaks for something else."""
    near = {w.lower() for w in _WORD.findall(text[max(start - BEFORE, 0) : start] + " " + text[end : end + AFTER])}
    value = FIRST_SCORE[kind] + FOR * any(w in near for w in SPEAKS_FOR[kind]) - AGAINST * any(w in near for w in SPEAKS_AGAINST)
    return min(max(value, 0.0), 1.0)


def spans(text: str | None, threshold: float = THRESHOLD) -> list[dict]:
    """All spans of a text by kind and start."""
    found: list[dict] = []
    if not text:
        return found
    taken: list[tuple[int, int]] = []
    for kind in (*BASE, *ADDED):
        mine = []
        for start, end in _FINDERS[kind](text):
            value = score(text, kind, start, end)
            if kind in BASE or (value >= threshold and not _touches(taken, start, end)):
                mine.append({"kind": kind, "start": start, "end": end, "value": text[start:end], "score": value})
        found += mine
        taken = _merged(taken, [(x["start"], x["end"]) for x in mine])
    return found


def _merged(*spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans as sorted ranges that do not overlap."""
    out: list[tuple[int, int]] = []
    for start, end in sorted(x for s in spans for x in s):
        if out and start < out[-1][1]:
            out[-1] = (out[-1][0], max(end, out[-1][1]))
        else:
            out.append((start, end))
    return out


def _touches(ranges: list[tuple[int, int]], start: int, end: int) -> bool:
    at = bisect.bisect_left(ranges, (end,))
    return at > 0 and ranges[at - 1][1] > start


def _mapped(docs: DataFrame, text: str, out: str, make, kind: T.DataType, arrow: pa.DataType) -> DataFrame:
    """docs with `make` of each text in a column of the name `out`."""
    schema = T.StructType([f for f in docs.schema.fields if f.name != out] + [T.StructField(out, kind)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = pa.array([make(t) for t in batch.column(batch.schema.get_field_index(text)).to_pylist()], type=arrow)
            names = [n for n in batch.schema.names if n != out]
            yield pa.RecordBatch.from_arrays([*[batch.column(batch.schema.get_field_index(n)) for n in names], made], [*names, out])

    return docs.mapInArrow(run, schema)


def find(docs: DataFrame, text: str = "text", out: str = "spans", threshold: float = THRESHOLD) -> DataFrame:
    """docs with an array of (kind, start, end, value, score)."""
    return _mapped(docs, text, out, lambda t: spans(t, threshold), SPANS, _ARROW)


def masked(text: str | None, threshold: float = THRESHOLD) -> str | None:
    """The text with each span, or run of spans that overlap, as the first one's kind in angle brackets."""
    out, free = [], 0
    for x in sorted(spans(text, threshold), key=lambda x: (x["start"], -x["end"])):
        if x["start"] >= free:
            out += [text[free : x["start"]], f"<{x['kind']}>"]
        free = max(free, x["end"])
    return "".join([*out, text[free:]]) if out else text


def redact(docs: DataFrame, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """docs with the personal data in their text masked, the columns in their order."""
    return _mapped(docs, text, text, lambda t: masked(t, threshold), T.StringType(), pa.string()).select(*[F.col(f"`{c}`") for c in docs.columns])


def _listed(found: Column) -> Column:
    return F.array_join(F.transform(found, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")


def op12(docs: DataFrame) -> DataFrame:
    found = find(docs.select("doc_id", "text")).select("doc_id", "spans")
    many = lambda *kinds: F.size(F.filter("spans", lambda x: x["kind"].isin(*kinds))).cast("long")
    base = F.filter("spans", lambda x: x["kind"].isin(*BASE))
    return found.select("doc_id", *[many(k).alias(f"n_{k}") for k in BASE], F.sha2(_listed(base), 256).alias("base_sha256"), _listed(F.col("spans")).alias("spans"), many(*ADDED).alias("n_added"))


# ---- the same in DuckDB: matches and the gaps between them give the places --------------------

_PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "iban": _IBAN.pattern, "ssn": _SSN.pattern, "local_phone": _LOCAL_PHONE.pattern,
}
_DIGITS = "regexp_replace(value, '[^0-9]', '', 'g')"
_CHECKS = {
    "email": "true", "ip": "list_bool_and(list_transform(string_split(value, '.'), lambda p: len(ltrim(p, '0')) <= 3 AND CAST('0' || left(ltrim(p, '0'), 3) AS INTEGER) <= 255))",
    "card": f"len({_DIGITS}) BETWEEN 16 AND 19 AND list_sum(list_transform(range(len({_DIGITS})), lambda i: CAST({_DIGITS}[len({_DIGITS}) - i] AS INTEGER) * (1 + i % 2) - 9 * CAST(CAST({_DIGITS}[len({_DIGITS}) - i] AS INTEGER) * (1 + i % 2) > 9 AS INTEGER))) % 10 = 0",
    "phone": f"len({_DIGITS}) BETWEEN 8 AND 15",
    "iban": """list_reduce(list_concat([0::BIGINT], list_transform(string_split(array_to_string(list_transform(string_split(substr(replace(value, ' ', ''), 5) || left(replace(value, ' ', ''), 4), ''),
      lambda c: CASE WHEN c BETWEEN '0' AND '9' THEN c ELSE CAST(ascii(c) - 55 AS VARCHAR) END), ''), ''), lambda c: CAST(c AS BIGINT))), lambda x, y: (x * 10 + y) % 97) = 1""",
    "ssn": "value[1:3] NOT IN ('000', '666') AND value[1:3] < '900' AND value[5:6] <> '00' AND value[8:11] <> '0000'", "local_phone": "true",
}


def _sql() -> str:
    quoted = lambda words: ", ".join(f"'{w}'" for w in words)
    kinds = " UNION ALL ".join(f"SELECT doc_id, d, text, {k} AS place, '{name}' AS kind, regexp_extract_all(text, '{p}') AS found, string_split_regex(text, '{p}') AS gaps FROM docs" for k, (name, p) in enumerate(_PATTERNS.items()))
    checked = " ".join(f"WHEN '{k}' THEN {c}" for k, c in _CHECKS.items())
    first = " ".join(f"WHEN '{k}' THEN {v}" for k, v in FIRST_SCORE.items())
    speaks = " ".join(f"WHEN '{k}' THEN list_has_any(near, [{quoted(w)}])" for k, w in SPEAKS_FOR.items())
    free = lambda *names: " AND ".join(f"NOT EXISTS (SELECT 1 FROM {n} b WHERE b.d = a.d AND b.start < a.stop AND a.start < b.stop)" for n in names)
    added = [f"s{i} AS (SELECT * FROM good a WHERE kind = '{k}' AND score >= {THRESHOLD} AND {free('base', *[f's{j}' for j in range(i)])})" for i, k in enumerate(ADDED)]
    every = " UNION ALL ".join(["SELECT * FROM base", *[f"SELECT * FROM s{i}" for i in range(len(ADDED))]])
    many = lambda *names: f"count(*) FILTER (WHERE kind IN ({quoted(names)}))"
    listed = "string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY place, start)"
    return f"""WITH docs AS (SELECT doc_id, row_number() OVER () AS d, coalesce(text, '') AS text FROM documents),
matches AS ({kinds}),
spots AS (
  SELECT doc_id, d, text, place, kind, found[i] AS value, CAST(list_sum(list_transform(gaps[1:i], lambda g: len(g))) + coalesce(list_sum(list_transform(found[1:i - 1], lambda g: len(g))), 0) AS BIGINT) AS start
  FROM (SELECT *, unnest(range(1, len(found) + 1)) AS i FROM matches)),
spans AS (SELECT *, start + len(value) AS stop, regexp_extract_all(lower(substr(text, greatest(start - {BEFORE}, 0) + 1, start - greatest(start - {BEFORE}, 0)) || ' ' || substr(text, start + len(value) + 1, {AFTER})), '\\p{{L}}+') AS near
  FROM spots WHERE CASE kind {checked} END),
good AS (SELECT *, CASE kind {first} END + CASE WHEN CASE kind {speaks} END THEN {FOR} ELSE 0 END - CASE WHEN list_has_any(near, [{quoted(SPEAKS_AGAINST)}]) THEN {AGAINST} ELSE 0 END AS score FROM spans),
base AS (SELECT * FROM good WHERE kind IN ({quoted(BASE)})), {', '.join(added)},
told AS (SELECT d, {', '.join(f"{many(k)} AS n_{k}" for k in BASE)}, {listed} FILTER (WHERE kind IN ({quoted(BASE)})) AS own, {listed} AS spans, {many(*ADDED)} AS n_added FROM ({every}) GROUP BY d)
SELECT doc_id, {', '.join(f'coalesce(n_{k}, 0) AS n_{k}' for k in BASE)}, sha256(coalesce(own, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(n_added, 0) AS n_added FROM docs LEFT JOIN told USING (d)"""


SQL = _sql()
