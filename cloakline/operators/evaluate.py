"""Synthetic documents with known entities, noise of text recognition, recall and precision."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cloakline.functions import fixed


def _bound(value: Column, body) -> Column:
    return F.get(F.transform(F.array(value), body), F.lit(0))


def check_digits(number: Column, weights: tuple, modulus: int) -> Column:
    total = F.lit(0)
    for i, w in enumerate(weights):
        total = total + w * F.substring(number, i + 1, 1).cast("int")
    return total % modulus


def pesel(n: Column) -> Column:
    """A valid PESEL from a number."""
    body = F.lpad(F.pmod(n * 7919 + 44051401, F.lit(10**10)).cast("string"), 10, "0")
    return _bound(body, lambda b: F.concat(b, F.pmod(10 - check_digits(b, fixed.PESEL_WEIGHTS, 10), F.lit(10)).cast("string")))


def nip(n: Column) -> Column:
    """A valid NIP from a number; a body whose check is ten takes the next one's last digit."""
    body = F.lpad(F.pmod(n * 104729 + 526000124, F.lit(10**9)).cast("string"), 9, "0")
    other = lambda b: F.concat(F.substring(b, 1, 8), F.pmod(F.substring(b, 9, 1).cast("int") + 1, F.lit(10)).cast("string"))
    body = _bound(body, lambda b: F.when(check_digits(b, fixed.NIP_WEIGHTS, 11) == 10, other(b)).otherwise(b))
    return _bound(body, lambda b: F.concat(b, check_digits(b, fixed.NIP_WEIGHTS, 11).cast("string")))


def regon(n: Column) -> Column:
    body = F.lpad(F.pmod(n * 15485863 + 1234567, F.lit(10**8)).cast("string"), 8, "0")
    return _bound(body, lambda b: F.concat(b, (check_digits(b, fixed.REGON_WEIGHTS, 11) % 10).cast("string")))


def phone(n: Column) -> Column:
    d = F.lpad(F.pmod(n * 32452843 + 601234567, F.lit(10**9)).cast("string"), 9, "6")
    return F.concat_ws("-", F.substring(d, 1, 3), F.substring(d, 4, 3), F.substring(d, 7, 3))


def email(n: Column) -> Column:
    return F.concat(F.lit("osoba"), n.cast("string"), F.lit("@example.com"))


def iban(n: Column) -> Column:
    """A valid Polish IBAN without spaces."""
    body = F.concat(F.lit("1090"), F.lpad(F.pmod(n * 982451653 + 12345, F.lit(10**15)).cast("string"), 20, "0"))
    rest = lambda b: F.lpad((98 - F.concat(b, F.lit("252100")).cast("decimal(38,0)") % 97).cast("int").cast("string"), 2, "0")
    return _bound(body, lambda b: F.concat(F.lit("PL"), rest(b), b))


def id_card(n: Column) -> Column:
    """A valid identity card number: letters, check digit, five digits."""
    places = [F.pmod(F.floor(n / d), F.lit(26)).cast("int") for d in (1, 7, 31)]
    digits = F.lpad(F.pmod(n * 7919, F.lit(10**5)).cast("string"), 5, "0")
    total = sum(((p + 10) * w for p, w in zip(places, fixed.ID_CARD_WEIGHTS, strict=False)), F.lit(0))
    total = total + sum((F.substring(digits, i + 1, 1).cast("int") * w for i, w in enumerate(fixed.ID_CARD_WEIGHTS[4:])), F.lit(0))
    return F.concat(*[F.char(p + 65) for p in places], F.pmod(total, F.lit(10)).cast("string"), digits)


def vin(n: Column) -> Column:
    """A valid vehicle number: the ninth character is its check."""
    body = F.concat(F.lit("WVWZZZ1J0AW"), F.lpad(F.pmod(n * 7919, F.lit(10**6)).cast("string"), 6, "0"))
    digits = F.translate(body, "".join(fixed.VIN_LETTERS), "".join(map(str, fixed.VIN_LETTERS.values())))
    rest = _bound(digits, lambda d: check_digits(d, fixed.VIN_WEIGHTS, 11))
    return F.concat(F.substring(body, 1, 8), _bound(rest, lambda r: F.when(r == 10, "X").otherwise(r.cast("string"))), F.substring(body, 10, 8))


def _one_of(n: Column, *options: str) -> Column:
    return F.element_at(F.array(*[F.lit(o) for o in options]), (F.pmod(n, F.lit(len(options))) + 1).cast("int"))


def entry(n: Column) -> Column:
    """A number and year of a register."""
    return F.concat((n % 9999 + 1).cast("string"), F.lit("/"), (n % 35 + 1990).cast("string"))


def case_number(n: Column) -> Column:
    return F.concat(_one_of(n, "I C", "II K", "III Ns", "V GC"), F.lit(" "), (n % 9999 + 1).cast("string"), F.lit("/"), (n % 15 + 10).cast("string"))


def court(n: Column) -> Column:
    return F.concat(_one_of(n, "Sąd Rejonowy", "Sąd Okręgowy", "Sąd Apelacyjny"), F.lit(" w "), _one_of(F.floor(n / 3), "Krakowie", "Łodzi", "Gdańsku", "Poznaniu"))


def postal(n: Column) -> Column:
    digits = F.lpad(F.pmod(n * 7907, F.lit(10**5)).cast("string"), 5, "0")
    return F.concat(F.substring(digits, 1, 2), F.lit("-"), F.substring(digits, 3, 3), F.lit(" "), _one_of(n, "Kraków", "Zielona Góra", "Łódź"))


def person(n: Column) -> Column:
    return F.concat(_one_of(n, "Anna", "Jan", "Łucja", "Piotr", "Maria"), F.lit(" "), _one_of(F.floor(n / 5), "Nowak", "Żak", "Kowalczyk", "Zając"))


#: Document types: texts and, in braces, the entities that go into them.
TEMPLATES = {
    "appeal": "Apelacja od wyroku o sygnaturze {case_number}. Wyrok zapadł, gdy rozprawę prowadził {court}. PESEL apelującego: {pesel}, adres poczty {email}. "
    "Apelujący mieszka pod adresem: {address}. Zarzuty dotyczą oceny dowodów i kosztów postępowania, o które wnosimy osobno. Telefon do odpowiedzi: {phone}.",
    "enforcement": "Wniosek egzekucyjny. Dłużnik, NIP {nip}, telefon {phone}, prowadzi rachunek {iban}. Tytuł wykonawczy wydał {court} do sprawy {case_number}. "
    "Wierzyciel prosi o zajęcie rachunku oraz ruchomości, w tym pojazdu o numerze nadwozia {vehicle_vin}. Dłużnik ma także REGON {regon}.",
    "hearing": "Protokół rozprawy. Sprawa ma sygnaturę {case_number}. Staje świadek {person}, podaje PESEL {pesel} i telefon {phone}. "
    "Okazano dowód {id_card}. Zeznano, że strony nie zawarły ugody, a termin zapłaty minął. Doręczenia na adres poczty {email}.",
    "inheritance": "Stwierdzenie nabycia spadku. Dołączono akt zgonu nr {usc_act}. PESEL spadkodawcy {pesel}. W skład spadku wchodzi rachunek {iban}. "
    "Postępowanie prowadzi {court}, sygnatura {case_number}. Ostatni adres spadkodawcy: {address}.",
    "judgment": "Wyrok, który wydał {court}, w sprawie spółki, REGON {regon}, NIP {nip}. Sygnatura {case_number}. "
    "Powództwo jest zasadne w całości. Zasądza się należność na rachunek {iban} w terminie dwóch tygodni. Pytania: {email}.",
    "lawsuit": "Pozew o zapłatę. Powód mieszka: {address}. PESEL powoda {pesel}, telefon {phone}, poczta {email}. Sprawę rozpozna {court}. "
    "Pozwana spółka ma NIP {nip} i REGON {regon}. Należność przypada na rachunek {iban}. Powód wezwał do zapłaty bez skutku.",
    "lease": "Umowa najmu pojazdu o numerze nadwozia {vehicle_vin}. Najemca, PESEL {pesel}, poczta {email}. Czynsz wpływa na rachunek {iban}. "
    "Zwrot pojazdu nastąpi pod adresem: {address}. W razie szkody dzwonić: {phone}. Tożsamość stwierdza dowód {id_card}.",
    "notarial": "Akt notarialny, Rep. A Nr {notarial_act}. Stawający okazuje dowód {id_card}, PESEL {pesel} oraz NIP {nip}. Mieszka pod adresem: {address}. "
    "Cena wpłynie na rachunek {iban}. Odpisy aktu wyda się stronom, a zawiadomienia trafią na adres poczty {email}.",
    "payment": "Wezwanie do zapłaty na rachunek {iban} dla firmy o REGON {regon}, telefon {phone}. Firma ma NIP {nip}. "
    "Brak wpłaty oznacza pozew, który rozpozna {court}. Odpowiedź prosimy wysłać na {email} albo pod adres: {address}.",
    "power": "Pełnomocnictwo. Mocodawca, PESEL {pesel}, dowód {id_card}, telefon {phone}. Obejmuje sprawę o sygnaturze {case_number}, którą prowadzi {court}. "
    "Pełnomocnik odbiera pisma pod adresem: {address} oraz pod adresem poczty {email}.",
}
MAKERS = {
    "pesel": pesel, "nip": nip, "regon": regon, "phone": phone, "email": email, "iban": iban, "id_card": id_card, "vehicle_vin": vin, "case_number": case_number,
    "usc_act": entry, "notarial_act": entry, "court": court, "address": postal, "person": person,
}


_ENTITIES = "array<struct<category:string,start:int,end:int,value:string>>"


def golden(numbers: DataFrame, n: str = "id") -> DataFrame:
    """(doc_id, doc_type, text, entities): documents of all types in turn, with the places of their entities.

    Only the entities of a document's own type are made for it."""
    kinds = sorted(TEMPLATES)
    at, pieces = F.col(n) % len(kinds), None
    for i, kind in enumerate(kinds):
        # texts and names of entities alternate
        parts = [(None, F.lit(p)) if j % 2 == 0 else (p, MAKERS[p](F.col(n))) for j, p in enumerate(re.split(r"\{(\w+)\}", TEMPLATES[kind]))]
        own = F.array(*[F.struct(F.lit(name).cast("string").alias("category"), value.alias("value")) for name, value in parts])
        pieces = (F.when if pieces is None else pieces.when)(at == i, own)
    rows = numbers.select(F.col(n).alias("doc_id"), F.element_at(F.array(*[F.lit(k) for k in kinds]), (at + 1).cast("int")).alias("doc_type"), pieces.alias("pieces"))

    def step(a, m):
        end = a["at"] + F.length(m["value"])
        span = F.struct(m["category"].alias("category"), a["at"].alias("start"), end.alias("end"), m["value"].alias("value"))
        return F.struct(end.alias("at"), F.when(m["category"].isNotNull(), F.concat(a["out"], F.array(span))).otherwise(a["out"]).alias("out"))

    begin = F.struct(F.lit(0).alias("at"), F.array().cast(_ENTITIES).alias("out"))
    text = F.array_join(F.transform("pieces", lambda m: m["value"]), "")
    return rows.select("doc_id", "doc_type", text.alias("text"), F.aggregate("pieces", begin, step, lambda a: a["out"]).alias("entities"))


#: Categories whose checked values text recognition spoils.
NOISED = ("pesel", "nip", "regon", "iban", "id_card", "vehicle_vin")


def noised(value: Column, key: Column, substitutions: int = 1, seed: int = 0) -> Column:
    """Up to `substitutions` digits of a value read as letters, chosen by key; the length stays.

    One or two are what the detectors make good; three (severe noise) are beyond that."""
    letters = F.translate(value, "01582", "OISBZ")
    order = lambda at: F.md5(F.concat_ws("|", F.lit(seed), key, at))
    places = F.filter(F.sequence(F.lit(1), F.length(value)), lambda i: F.substring(value, i, F.lit(1)) != F.substring(letters, i, F.lit(1)))
    ranked = F.array_sort(F.transform(places, lambda i: F.struct(order(i).alias("rank"), i.alias("at"))))
    chosen = F.transform(F.slice(ranked, 1, substitutions), lambda x: x["at"])
    read = lambda chosen: F.transform(F.sequence(F.lit(1), F.length(value)), lambda i: F.substring(F.when(F.array_contains(chosen, i), letters).otherwise(value), i, F.lit(1)))
    return F.array_join(_bound(chosen, read), "")  # bound, or it would be chosen again for every character


def recall(truth: DataFrame, replaced: DataFrame) -> DataFrame:
    """(category, planted, matched): planted spans (doc_id, category, start, end) that some replacement overlaps."""
    other = replaced.select(F.col("doc_id").alias("_doc"), F.col("start").alias("_start"), F.col("end").alias("_end"))
    hit = truth.join(other, (F.col("doc_id") == F.col("_doc")) & (F.col("start") < F.col("_end")) & (F.col("_start") < F.col("end")), "left_semi")
    every = truth.groupBy("category").agg(F.count("*").alias("planted"))
    return every.join(hit.groupBy("category").agg(F.count("*").alias("matched")), "category", "left").fillna(0, ["matched"])


def precision(truth: DataFrame, replaced: DataFrame) -> DataFrame:
    """(replacements, planted): all replacements, and those that overlap a planted span."""
    other = truth.select(F.col("doc_id").alias("_doc"), F.col("start").alias("_start"), F.col("end").alias("_end"))
    hit = replaced.join(other, (F.col("doc_id") == F.col("_doc")) & (F.col("start") < F.col("_end")) & (F.col("_start") < F.col("end")), "left_semi")
    both = replaced.select(F.lit(1).alias("a"), F.lit(0).alias("b")).unionByName(hit.select(F.lit(0).alias("a"), F.lit(1).alias("b")))
    return both.agg(F.sum("a").alias("replacements"), F.sum("b").alias("planted"))


def recall_delta(before: DataFrame, after: DataFrame, group: tuple = NOISED) -> DataFrame:
    """(category, checked, before, after): shares matched of two evaluations, and whether a category is of the checked group."""
    a = before.select("category", (F.col("matched") / F.col("planted")).alias("before"))
    both = a.join(after.select("category", (F.col("matched") / F.col("planted")).alias("after")), "category", "full")
    return both.select("category", F.col("category").isin(*group).alias("checked"), "before", "after")


def same_replacements(before: DataFrame, after: DataFrame) -> bool:
    """Whether two runs replace the same spans: a model that only notes must change none."""
    columns = ["doc_id", "block_ix", "start", "end", "category", "label"]
    one, two = before.select(columns), after.select(columns)
    return not one.exceptAll(two).limit(1).count() and not two.exceptAll(one).limit(1).count()
