"""Identifiers and hashes, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The Base32 alphabet of RFC 4648.
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
ID_PATTERN = "^[A-Z2-7]{22}(--0*[1-9][0-9]*)?$"


def base32_of_hex(digest: Column, chars: int = 22) -> Column:
    """Leading bits of a hexadecimal digest in groups of five."""
    bits = F.array_join(F.transform(F.split(F.substr(digest, F.lit(1), F.lit(-(-chars * 5 // 4))), ""), lambda c: F.lpad(F.conv(c, 16, 2), 4, "0")), "")
    one = F.transform(F.array(bits), lambda b: F.transform(F.sequence(F.lit(0), F.lit(chars - 1)), lambda i: F.lit(BASE32).substr(F.conv(b.substr(i * 5 + 1, F.lit(5)), 2, 10).cast("int") + 1, F.lit(1))))
    return F.array_join(F.element_at(one, 1), "")


def year_text(c: Column) -> Column:
    """A year in an id's payload; none and zero are empty."""
    return F.when(c.isNull() | (c == 0), "").otherwise(c.cast("string"))


def global_id(name: Column, birth: Column, death: Column) -> Column:
    """22 Base32 characters: the leading 110 bits of SHA-256 over name|birth|death."""
    return base32_of_hex(F.sha2(F.concat(name, F.lit("|"), year_text(birth), F.lit("|"), year_text(death)), 256))


def compact_id(name: Column, birth: Column, death: Column) -> Column:
    """Variant over the parts that are present only."""
    parts = F.array_compact(F.array(name, F.nullif(year_text(birth), F.lit("")), F.nullif(year_text(death), F.lit(""))))
    return base32_of_hex(F.sha2(F.array_join(parts, "|"), 256))


def is_global_id(c: Column) -> Column:
    return c.rlike(ID_PATTERN)


def shadow_hash(c: Column) -> Column:
    return F.substr(F.sha2(F.coalesce(c, F.lit("")), 256), F.lit(1), F.lit(16))


def orcid_check_digit(digits15: Column) -> Column:
    """ISO 7064 mod 11-2 over fifteen digits: 0 to 9 or X."""
    total = F.aggregate(F.split(digits15, ""), F.lit(0), lambda a, d: (a + d.cast("int")) * 2 % 11)
    check = (F.lit(12) - total % 11) % 11
    return F.when(check == 10, "X").otherwise(check.cast("string"))


def is_orcid(c: Column) -> Column:
    plain = F.replace(c, F.lit("-"), F.lit(""))
    formed = c.rlike("^[0-9]{4}-[0-9]{4}-[0-9]{4}-[0-9]{3}[0-9X]$")
    return F.when(formed, orcid_check_digit(plain.substr(1, 15)) == plain.substr(16, 1)).otherwise(False)


def treatment(c: Column, share: int) -> Column:
    """Arm of an A/B split: SHA-256 as a number modulo 100, below share is A."""
    rest = F.aggregate(F.split(F.sha2(c, 256), ""), F.lit(0), lambda a, d: (a * 16 + F.conv(d, 16, 10).cast("int")) % 100)
    return F.when(rest < share, "A").otherwise("B")


def json_hash(*columns: str) -> Column:
    """SHA-256 of the columns as one JSON object with its keys in order; nulls are left out."""
    return F.sha2(F.to_json(F.struct(*sorted(columns))), 256)
