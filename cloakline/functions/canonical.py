"""Canonical forms, by which equal entities of a document get equal numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from cloakline.functions import fixed


def squeezed(v: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(v, r"(?U)\s+", " ")))


def digits(v: Column) -> Column:
    return F.regexp_replace(v, r"[^0-9]+", "")


def phone(v: Column) -> Column:
    d = F.regexp_replace(digits(v), "^0048", "")
    return F.when((F.length(d) == 11) & d.startswith("48"), F.substring(d, 3, 9)).otherwise(d)


def email(v: Column) -> Column:
    return F.lower(F.trim(v))


def alnum(v: Column) -> Column:
    return F.upper(F.regexp_replace(v, "[^0-9A-Za-z]+", ""))


def person(v: Column) -> Column:
    """Lower case without the marks that decompose (ł has none to lose), each name cut to its stem."""
    plain = F.translate(squeezed(v), "ąćęńóśźż", "acenoszz")
    # the lazy head leaves as much as it can to the longest suffix
    stem = rf"^(.{{3,}}?)(?:{'|'.join(fixed.NAME_SUFFIXES)})$"
    return F.array_join(F.transform(F.split(plain, " "), lambda t: F.regexp_replace(t, stem, "$1")), " ")


FORMS = {c: digits for c in ("pesel", "nip", "regon", "krs", "npwz", "imei")}
FORMS |= {c: alnum for c in ("iban", "land_register", "id_card", "vehicle_vin", "passport", "vehicle_plate", "case_number", "notarial_act", "usc_act")}
FORMS |= {"phone": phone, "email": email, "legal_role_person": person}


def canonical(category: Column, v: Column) -> Column:
    out = None
    for form in dict.fromkeys(FORMS.values()):
        names = [c for c, f in FORMS.items() if f is form]
        out = (F.when if out is None else out.when)(category.isin(names), form(v))
    return out.otherwise(squeezed(v))


def hmac_sha256(key: Column, message: Column) -> Column:
    """HMAC-SHA256 in hexadecimal; the key is a binary column of up to 64 bytes."""
    block = F.rpad(F.hex(key), 128, "0")
    padded = lambda byte: F.unhex(F.array_join(F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: F.lpad(F.hex(F.conv(F.substring(block, i * 2 + 1, F.lit(2)), 16, 10).cast("int").bitwiseXOR(F.lit(byte))), 2, "0")), ""))
    inner = F.unhex(F.sha2(F.concat(padded(0x36), F.encode(message, "utf-8")), 256))
    return F.sha2(F.concat(padded(0x5C), inner), 256)
