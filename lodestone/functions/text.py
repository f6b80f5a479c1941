"""Column functions for text: pure expressions, no Python per row but for composing characters."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

WORD = r"[\p{L}\p{N}]+"


@F.arrow_udf(StringType())
def nfc(texts: pa.Array) -> pa.Array:
    """The composed form of texts, for which Spark has no function (Arrow's leaves combining marks apart)."""
    if pc.all(pc.string_is_ascii(texts)).as_py() is not False:
        return texts
    return pa.array([x and unicodedata.normalize("NFC", x) for x in texts.to_pylist()], pa.string())


def nul() -> Column:
    """The NUL character."""
    return F.decode(F.unhex(F.lit("00")), "UTF-8")


def collapse(c: Column) -> Column:
    """White space runs as one space, none at the ends."""
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def title_key(c: Column) -> Column:
    """Composed, lower case, punctuation and symbols as spaces, spaces collapsed, at most 1000 characters."""
    return F.substring(collapse(F.regexp_replace(F.lower(F.trim(nfc(c))), r"[\p{P}\p{S}]+", " ")), 1, 1000)


def name_key(c: Column) -> Column:
    """Composed, lower case, spaces collapsed, punctuation kept, at most 500 characters."""
    return F.substring(F.lower(collapse(nfc(c))), 1, 500)


def publisher_key(c: Column) -> Column:
    return F.nullif(F.lower(collapse(c)), F.lit(""))


def year(c: Column) -> Column:
    """The first run of four digits, if it lies in 1400..2100."""
    found = F.nullif(F.regexp_extract(c, r"(\d{4})", 1), F.lit("")).cast("int")
    return F.when(found.between(1400, 2100), found)


def utf16_length(c: Column) -> Column:
    return (F.octet_length(F.encode(c, "UTF-16LE")) / 2).cast("long")


def words(c: Column) -> Column:
    """Lower-cased runs of letters and digits, in order."""
    return F.regexp_extract_all(F.lower(c), F.lit(f"({WORD})"), F.lit(1))


def any_terms(c: Column, most: int = 12) -> Column:
    """Terms of the fallback query: distinct words of 3 letters or more (else all), the first `most`."""
    distinct = F.array_distinct(words(c))
    long = F.filter(distinct, lambda w: F.length(w) >= 3)
    return F.slice(F.when(F.size(long) > 0, long).otherwise(distinct), 1, most)


def weighed(c: Column, weight: Callable[[Column], Column]) -> Column:
    """The sum of digits (X is 10) by the weight of their place, from 0; null if another character is there."""
    value = lambda d: F.when(d == "X", 10).otherwise(d.try_cast("int"))
    return F.aggregate(F.transform(F.split(c, ""), lambda d, i: value(d) * weight(i)), F.lit(0), lambda a, x: a + x)


def isbn13_valid(c: Column) -> Column:
    """Whether 13 digits carry the right check digit."""
    return c.rlike(r"^\d{13}$") & (weighed(c, lambda i: 1 + i % 2 * 2) % 10 == 0)


def isbn13_of_10(c: Column) -> Column:
    """ISBN-13 of an ISBN-10, null if its own check character is wrong."""
    body = F.concat(F.lit("978"), F.substring(c, 1, 9))
    check = F.pmod(10 - weighed(body, lambda i: 1 + i % 2 * 2) % 10, F.lit(10))
    return F.when(c.rlike(r"^\d{9}[\dX]$") & (weighed(c, lambda i: 10 - i) % 11 == 0), F.concat(body, check.cast("string")))


def url_verdict(c: Column) -> Column:
    """remote, blocked or ok, after dropping control characters and spaces and lower-casing."""
    v = F.lower(F.regexp_replace(c, r"[\x00-\x20]", ""))
    return F.when(v.startswith("//") | v.rlike("^(https?|ftp):"), "remote").when(v.rlike("^[a-z][a-z0-9+.-]*:"), "blocked").otherwise("ok")


def backoff_seconds(attempt: Column) -> Column:
    """Waits of 30, 120 and then 600 seconds."""
    return F.element_at(F.array(F.lit(30), F.lit(120), F.lit(600)), F.least(F.greatest(attempt, F.lit(1)), F.lit(3)))


def index_backoff_seconds(attempt: Column) -> Column:
    """Waits that double from 30 to at most 600 seconds."""
    return F.least(F.lit(600), (30 * F.pow(F.lit(2), attempt - 1)).cast("int"))


def like_escape(c: Column) -> Column:
    """A literal for LIKE: backslash, percent and underscore with a backslash before them."""
    return F.regexp_replace(c, r"([\\%_])", r"\\$1")


def heading_text(path: Column) -> Column:
    """A heading path as one line of at most 1000 characters, null if it is empty."""
    return F.nullif(F.substring(F.array_join(path, " › "), 1, 1000), F.lit(""))


def embedding_text(heading: Column, body: Column) -> Column:
    """What is embedded of a chunk: its heading and an empty line before its text, if it has a heading."""
    return F.when(F.coalesce(heading, F.lit("")) == "", body).otherwise(F.concat(heading, F.lit("\n\n"), body))


def excerpt(c: Column, overlap: Column, most: int = 700) -> tuple[Column, Column]:
    """What is shown of a chunk after its overlap, and whether that is cut."""
    return F.substring(c, overlap + 1, F.lit(most)), F.length(c) - overlap > most


def cap_bytes(c: Column, most: int) -> Column:
    """The longest start of whole characters within a number of bytes, ends trimmed; empty for a null."""
    utf8 = F.encode(F.coalesce(F.trim(c), F.lit("")), "UTF-8")
    # a character has at most four bytes: one of four cuts is between two
    starts = [F.substring(utf8, 1, most - k).cast("string") for k in range(4)]
    return F.coalesce(*[F.when(F.is_valid_utf8(s), s) for s in starts])


def display(raw: Column, most: int = 1024) -> Column:
    """Bytes as readable text, U+FFFD for what is no text, at most so many characters."""
    return F.substring(F.make_valid_utf8(raw.cast("string")), 1, most)


def encode_path(raw: Column) -> Column:
    """Bytes of a path as text that keeps them exactly."""
    return F.base64(raw)


def decode_path(stored: Column) -> Column:
    """The bytes that encode_path stored; none where it is no such text."""
    return F.coalesce(F.try_to_binary(stored, F.lit("base64")), F.lit(b""))


def duration_seconds(a: Column, b: Column) -> Column:
    """Whole seconds between two moments in either order, null if one is missing."""
    return F.abs(F.timestamp_diff("SECOND", a, b))


def version_before(c: Column, limit: str) -> Column:
    """Whether a version of numbers and dots comes before another; a missing number is 0."""
    parts = [int(x) for x in limit.split(".")]
    have = F.transform(F.split(c, r"\."), lambda x: F.coalesce(x.try_cast("int"), F.lit(0)))
    width = F.greatest(F.size(have), F.lit(len(parts)))
    filled = lambda a: F.concat(a, F.array_repeat(F.lit(0), F.greatest(width - F.size(a), F.lit(0))))
    return filled(have) < filled(F.array(*[F.lit(x) for x in parts]))


def unsafe_path(c: Column) -> Column:
    """Whether a member's name leaves its archive: an absolute path, a drive, or a step upwards."""
    path = F.translate(c, "\\", "/")
    return path.startswith("/") | path.rlike("^[A-Za-z]:") | F.array_contains(F.split(path, "/"), "..")
