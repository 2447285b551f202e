"""Detection and redaction of personal data."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

# Kind, label and pattern, in the order they are applied.
KINDS = (
    ("email", "CORREO", r"(?Ui)\b[A-Z0-9._%+-]+@[A-Z0-9.-]+\.[A-Z]{2,}\b"),
    ("dni", "DOCUMENTO", r"(?Ui)\b(?:\d{8}[A-Z]|[XYZ]\d{7}[A-Z])\b"),
    ("phone", "TELÉFONO", r"(?U)(?<!\w)(?:\+?34[ .-]?)?[6789]\d{2}(?:[ .-]?\d{3}){2}(?!\w)"),
    ("card", "TARJETA", r"(?U)(?<!\d)(?:\d[ -]?){13,19}(?!\d)"),
    ("ip", "DIRECCIÓN IP",
     r"(?U)\b(?:25[0-5]|2[0-4]\d|1?\d?\d)(?:\.(?:25[0-5]|2[0-4]\d|1?\d?\d)){3}\b"),
)
NAME_SUFFIX = " · anonimizada"


def is_card(value: Column) -> Column:
    digits = F.regexp_replace(value, r"\D", "")
    return F.length(digits).between(13, 19) & F.call_function("luhn_check", digits)


def mask(value: Column) -> Column:
    n = F.length(value)
    return F.when(n <= 4, F.repeat(F.lit("•"), n)).otherwise(
        F.concat(F.left(value, F.lit(2)), F.repeat(F.lit("•"), F.least(F.lit(8), n - 4)),
                 F.right(value, F.lit(2))))


def _matches(text: Column, order: int) -> Column:
    kind, _, pattern = KINDS[order]
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    found = F.filter(found, is_card) if kind == "card" else found
    return F.transform(found, lambda v, i: F.struct(
        F.lit(kind).alias("kind"), F.lit(order).alias("kind_order"), i.alias("n"), v.alias("value")))


def findings_of(text: Column) -> Column:
    """ARRAY<STRUCT<kind, kind_order, n, value>> of all matches, in kind then text order."""
    return F.concat(*[_matches(text, k) for k in range(len(KINDS))])


def find_sensitive(df: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """One row per finding; the text column itself is not carried along."""
    hits = df.select(*keys, F.explode(findings_of(F.col(text))).alias("f"))
    return hits.select(*keys, "f.kind", "f.kind_order", "f.n", mask(F.col("f.value")).alias("preview"))


def redaction_counts(df: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    return find_sensitive(df, keys, text).groupBy(*keys, "kind").agg(F.count(F.lit(1)).alias("findings"))


def _redact_cards(text: Column, label: str, pattern: str) -> Column:
    """Replace only the matches that pass the checksum: cut at the matches and join again."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    return F.array_join(F.zip_with(F.split(text, pattern, -1), found, lambda piece, m: F.concat(
        piece, F.when(m.isNull(), "").when(is_card(m), f"[{label}]").otherwise(m))), "")


def redact(text: Column) -> Column:
    for kind, label, pattern in KINDS:
        text = (_redact_cards(text, label, pattern) if kind == "card"
                else F.regexp_replace(text, pattern, f"[{label}]"))
    return text
