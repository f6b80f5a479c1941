"""Identifiers of publications: their scheme, canonical form and the tokens that two records may share."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lodestone.functions import text as T

# The forms of identifiers.
UUID = r"^[0-9A-Fa-f]{8}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{12}$"
DOI = r"(10\.\d{4,9}/\S+)"


def _entry(scheme: str, value: Column | None = None, isbn13: Column | None = None, valid: bool | None = None) -> Column:
    text = F.lit(None).cast("string")
    return F.struct(
        F.lit(scheme).alias("scheme"),
        (text if value is None else value).alias("value"),
        (text if isbn13 is None else isbn13).alias("isbn13"),
        F.lit(valid).cast("boolean").alias("valid"),
    )


def normalize_identifier(raw: Column, hint: Column | None = None) -> Column:
    """Scheme, value, ISBN-13 and validity of an identifier; "other" where no form fits. A null gives a null.

    A UUID wins over a DOI, a DOI over an ISBN, an ISBN over a URI. An ISBN that fails its check
    is "other" and invalid, and so is a declared UUID without 32 hexadecimal digits.
    """
    value = F.trim(raw)
    low = F.lower(value)
    said = F.lower(F.trim(F.coalesce(hint if hint is not None else F.lit(None), F.lit(""))))
    invalid, other = _entry("other", valid=False), _entry("other")

    hexa = F.lower(F.regexp_replace(F.regexp_replace(value, "(?i)^urn:uuid:", ""), r"[{}-]", ""))
    parts = [F.substring(hexa, at, n) for at, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    uuid = F.when(hexa.rlike("^[0-9a-f]{32}$"), _entry("uuid", F.concat_ws("-", *parts), valid=True)).otherwise(invalid)

    doi = F.regexp_extract(value, DOI, 1)
    names_doi = low.startswith("doi:") | low.contains("doi.org/") | (low.startswith("10.") & low.contains("/")) | (said == "doi")

    digits = F.regexp_replace(F.regexp_replace(value, "(?i)^urn:isbn:", ""), r"[\s-]", "")
    said_isbn = low.startswith("urn:isbn:") | (said == "isbn")
    of_ten = T.isbn13_of_10(F.upper(digits))
    return (
        F.when(raw.isNull(), None)
        .when(low.startswith("urn:uuid:") | (said == "uuid") | value.rlike(UUID), uuid)
        .when(names_doi & (doi != ""), _entry("doi", doi, valid=True))
        .when(digits.rlike(r"^\d{13}$"), F.when(T.isbn13_valid(digits), _entry("isbn13", digits, digits, True)).otherwise(invalid))
        .when((F.length(digits) == 10) & of_ten.isNotNull(), _entry("isbn10", F.upper(digits), of_ten, True))
        .when(said_isbn, invalid)
        .when(low.rlike("^(https?://|urn:)"), _entry("uri", value, valid=True))
        .otherwise(other)
    )


def canonical(identifier: Column) -> Column:
    """Scheme and value that identifiers are compared by: ISBN-13, DOI and UUID; null for the rest."""
    scheme = F.when(identifier["isbn13"].isNotNull(), "isbn13").when(identifier["scheme"].isin("doi", "uuid"), identifier["scheme"])
    return F.when(scheme.isNotNull(), F.struct(scheme.alias("scheme"), F.coalesce(identifier["isbn13"], identifier["value"]).alias("value")))


def tokens(identifiers: Column) -> Column:
    """Distinct tokens (isbn:, doi:, uuid:) of a list of identifiers, sorted; of a null list an empty one."""
    known = F.filter(F.transform(identifiers, canonical), lambda c: c.isNotNull())
    named = F.transform(known, lambda c: F.concat(F.regexp_replace(c["scheme"], "^isbn13$", "isbn"), F.lit(":"), c["value"]))
    return F.coalesce(F.array_sort(F.array_distinct(named)), F.array().cast("array<string>"))
