"""Checks of identifiers as Spark expressions, also of values in which text recognition confused characters."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from cloakline.functions import fixed


def _position(c: Column) -> Column:
    """Value of a character in base 36."""
    return F.when(c.between("0", "9"), F.ascii(c) - 48).otherwise(F.ascii(F.upper(c)) - 55)


def _digit(v: Column, i: int) -> Column:
    return F.substring(v, i + 1, 1).cast("int")


def _weighted(v: Column, weights: tuple, number=lambda c: c.cast("int")) -> Column:
    """Sum of the first characters' values times weights."""
    return sum((number(F.substring(v, i + 1, 1)) * w for i, w in enumerate(weights)), F.lit(0))


def _when(shape: Column, check: Column) -> Column:
    return F.when(shape, F.coalesce(check, F.lit(False))).otherwise(False)


def pesel(v: Column) -> Column:
    return _when(v.rlike(r"^[0-9]{11}$"), F.pmod(10 - _weighted(v, fixed.PESEL_WEIGHTS) % 10, F.lit(10)) == _digit(v, 10))


def nip(value: Column) -> Column:
    v = F.regexp_replace(value, "-", "")
    return _when(v.rlike(r"^[0-9]{10}$"), _weighted(v, fixed.NIP_WEIGHTS) % 11 == _digit(v, 9))


def regon(v: Column) -> Column:
    short = _weighted(v, fixed.REGON_WEIGHTS) % 11 % 10 == _digit(v, 8)
    long = short & (_weighted(v, fixed.REGON14_WEIGHTS) % 11 % 10 == _digit(v, 13))
    return F.when(v.rlike(r"^[0-9]{9}$"), short).when(v.rlike(r"^[0-9]{14}$"), long).otherwise(False)


def _mod97(compact: Column) -> Column:
    """Whether the number of up to 34 characters, letters as two digits and the first four last, leaves one: sixteen digits
    at a time, behind what the ones before leave."""
    turned = F.upper(F.concat(F.substring(compact, 5, 60), F.substring(compact, 1, 4)))
    digits = turned
    for i in range(26):
        digits = F.replace(digits, F.lit(chr(65 + i)), F.lit(str(10 + i)))

    def rest(d):
        out = F.substring(d, 1, 16).cast("long") % 97
        for i in range(17, 69, 16):
            out = F.concat(out.cast("string"), F.substring(d, i, 16)).cast("long") % 97
        return out == 1

    return F.transform(F.array(F.when(turned.rlike("[A-Z]"), digits).otherwise(turned)), rest)[0]


def iban(value: Column) -> Column:
    v = F.regexp_replace(value, " ", "")
    national = F.concat(F.lit("PL"), v)
    return F.when(v.rlike(r"^[0-9]{26}$"), _mod97(national)).when(v.rlike(r"^[A-Za-z]{2}[0-9]{2}[0-9A-Za-z]{11,30}$"), _mod97(v)).otherwise(False)


def land_register(v: Column) -> Column:
    """Court code letters count as their number in base 36, written out; weights run from the right."""
    number = _position
    digits = F.concat(F.array_join(F.transform(F.filter(F.split(F.substring(v, 1, 4), ""), lambda c: c != ""), lambda c: number(c).cast("string")), ""), F.substring(v, 6, 8))
    turned = F.filter(F.split(F.reverse(digits), ""), lambda c: c != "")
    weight = lambda i: F.element_at(F.array(*[F.lit(w) for w in fixed.LAND_REGISTER_WEIGHTS]), (i % 3 + 1).cast("int"))
    total = F.aggregate(F.transform(turned, lambda c, i: c.cast("int") * weight(i)), F.lit(0), lambda a, x: a + x)
    return _when(v.rlike(r"^[0-9A-Za-z]{4}/[0-9]{8}/[0-9]$"), total % 10 == F.substring(v, 15, 1).cast("int"))


def id_card(v: Column) -> Column:
    return _when(v.rlike(r"^[A-Za-z]{3}[0-9]{6}$"), _weighted(v, fixed.ID_CARD_WEIGHTS, _position) % 10 == _digit(v, 3))


def passport(v: Column) -> Column:
    return F.coalesce(v.rlike(r"^[A-Z]{2}[0-9]{7}$"), F.lit(False))


def vin(v: Column) -> Column:
    letters = "".join(fixed.VIN_LETTERS)
    values = "".join(str(x) for x in fixed.VIN_LETTERS.values())
    check = _weighted(F.translate(v, letters, values), fixed.VIN_WEIGHTS) % 11
    return _when(v.rlike(r"^[A-HJ-NPR-Z0-9]{17}$"), F.when(check == 10, F.substring(v, 9, 1) == "X").otherwise(F.substring(v, 9, 1) == check.cast("string")))


def plate(v: Column) -> Column:
    return F.length(F.regexp_replace(v, r"(?U)\s", "")).between(5, 8)


def ip(v: Column) -> Column:
    parts = F.split(v, r"\.")
    four = (F.size(parts) == 4) & F.forall(parts, lambda p: p.rlike("^[0-9]+$") & (F.length(p) <= 3) & (p.cast("int") <= 255))
    return F.when(v.contains("."), four).otherwise(True)


def ocr_digits(v: Column, check) -> Column:
    """Whether a value with one or two letters read for digits passes a check of digits only."""
    letters = F.length(F.regexp_replace(v, "[0-9-]", ""))
    return letters.between(1, fixed.MOST_CONFUSED) & v.rlike("^[0-9OIlSBZ-]+$") & check(F.translate(v, "OIlSBZ", "011582"))


def corrected(v: Column, check) -> Column:
    """Whether one or two substitutions of confused characters make a value of letters and digits pass a check."""
    others = F.create_map(*[x for c, to in fixed.CONFUSED.items() for x in (F.lit(c), F.array(*[F.lit(t) for t in to]))])

    def replaced(text, first):
        """(text, at) with one confused character from the given place on replaced."""
        at_each = lambda i: F.transform(
            F.coalesce(F.try_element_at(others, F.substring(text, i, F.lit(1))), F.array().cast("array<string>")),
            lambda t: F.struct(F.concat(F.substring(text, F.lit(1), i - 1), t, F.substring(text, i + 1, F.length(text))).alias("text"), i.alias("at")),
        )
        return F.flatten(F.transform(F.filter(F.sequence(F.lit(1), F.length(text)), lambda i: i >= first), at_each))

    one = lambda each: F.exists(each, lambda x: check(x["text"]))
    two = lambda each: F.exists(each, lambda x: one(replaced(x["text"], x["at"] + 1)))
    # the many pairs are only made if no single one passes
    return F.transform(F.array(replaced(v, F.lit(1))), lambda each: one(each) | two(each))[0]


EXPRESSIONS = {"pesel": pesel, "nip": nip, "regon": regon, "iban": iban, "land_register": land_register, "id_card": id_card, "passport": passport, "vehicle_vin": vin, "vehicle_plate": plate, "ip_address": ip}
#: Those whose values hold digits only, so that every letter must be one that was read for a digit.
DIGITS_ONLY = ("pesel", "nip", "regon")


def passes_corrected(category: str, v: Column) -> Column:
    check = EXPRESSIONS[category]
    return ocr_digits(v, check) if category in DIGITS_ONLY else corrected(v, check)
