"""The patterns, tables and word lists that results depend on.

Patterns are in the dialect of Python's `re`; `java()` turns them into that of
Spark's expressions. The group `value` is the identifier itself; the whole match
is what gets replaced.
"""

from __future__ import annotations

UPPER = "A-ZĄĆĘŁŃÓŚŹŻ"
LOWER = "a-ząćęłńóśźż"
CAP = f"[{UPPER}]"
WORD = rf"[{UPPER}][{LOWER}]+"

# --- fixed values: identifier shapes; F is a digit or a letter that text recognition takes for one
F = "[0-9OoIiLlSsBbZz]"
PESEL = r"(?<!\d)(?P<value>\d{11})(?!\d)"
PESEL_FUZZY = rf"(?<!{F})(?P<value>{F}{{11}})(?!{F})"
NIP = r"(?<!\d)(?P<value>\d{3}-?\d{3}-?\d{2}-?\d{2}|\d{3}-\d{2}-\d{2}-\d{3})(?!\d)"
NIP_FUZZY = rf"(?<!{F})(?P<value>{F}{{3}}-?{F}{{3}}-?{F}{{2}}-?{F}{{2}}|{F}{{3}}-{F}{{2}}-{F}{{2}}-{F}{{3}})(?!{F})"
REGON = r"(?<!\d)(?P<value>\d{9}|\d{14})(?!\d)"
REGON_FUZZY = rf"(?<!{F})(?P<value>{F}{{9}}|{F}{{14}})(?!{F})"
IBAN = r"(?<![A-Za-z0-9])(?P<value>[A-Z]{2}\d{2}(?:[ ]?\d{4}){2,7}|\d{2}(?:[ ]?\d{4}){6})(?![A-Za-z0-9])"
IBAN_FUZZY = rf"(?<![A-Za-z0-9])(?P<value>[A-Z]{{2}}{F}{{2}}(?:[ ]?{F}{{4}}){{2,7}}|{F}{{2}}(?:[ ]?{F}{{4}}){{6}})(?![A-Za-z0-9])"
LAND_REGISTER = r"\b(?P<value>[A-Z0-9]{4}/\d{8}/\d)\b"
LAND_REGISTER_FUZZY = rf"\b(?P<value>[A-Z0-9]{{4}}/{F}{{8}}/{F})\b"
ID_CARD = r"\b(?P<value>[A-Z]{3}\d{6})\b"
ID_CARD_FUZZY = rf"\b(?P<value>[A-Z]{{3}}{F}{{6}})\b"
PASSPORT = r"\b(?P<value>[A-Z]{2}\d{7})\b"
VIN = r"\b(?P<value>[A-HJ-NPR-Z0-9]{17})\b"
VIN_FUZZY = r"\b(?P<value>[A-Z0-9]{17})\b"
PLATE = r"\b(?P<value>[A-Z]{2,3}\s?[A-Z0-9]{4,5})\b"
KRS = r"(?i)\bKRS[:\s]*?(?P<value>\d{10})\b"
NPWZ = r"(?i)(?:NPWZ|prawo wykonywania zawodu)\W{0,20}?(?P<value>\d{7})\b"
NOTARIAL_ACT = r"(?:Rep(?:ertorium)?\.?\s*A\s*(?:Nr|Numer)\.?\s*)(?P<value>\d{1,6}/\d{4})"
USC_ACT = r"(?:akt(?:u)?\s+(?:urodzenia|małżeństwa|zgonu)\s+nr\s*)(?P<value>\d+/\d{4})"
INHERITANCE = r"poświadczenie dziedziczenia\W{0,30}?(?:Rep\.\s*A\s*Nr\s*)(?P<value>\d+/\d{4})"
INHERITANCE_REGISTER = r"(?:Rejestr Spadkowy|NORS)\W{0,15}?(?P<value>[A-Z0-9-/]+/\d{4})"
PHONE = r"(?<!\d)(?:(?:(?:\+48|0048)[\s-]?)?\d{3}[\s-]\d{3}[\s-]\d{3}|(?:\+48|0048)\d{9}|\d{9}|\(?\d{2}\)?[\s-]?\d{3}[\s-]?\d{2}[\s-]?\d{2})(?!\d)"
EMAIL = r"[a-zA-Z0-9_.+-]+@[a-zA-Z0-9-]+\.[a-zA-Z0-9-.]+"
IP = r"(?P<value>(?:\d{1,3}\.){3}\d{1,3}|(?:[0-9a-fA-F]{1,4}:){7}[0-9a-fA-F]{1,4})"
IMEI = r"(?:IMEI[:\s]?)?(?P<value>\d{15})"
URL = r"(?P<value>https?://\S+|(?:\w+\.com/\w+)|(?:@\w+))"
CASE_SUBTYPES = {
    "cywilne_gospodarcze": r"\b[IVX]{1,3}\s+(?:C|Nc|GC|Ns|Co)\s+\d{1,5}/\d{2,4}\b",
    "karne": r"\b[IVX]{1,3}\s+(?:K|Ko|Kp)\s+\d{1,5}/\d{2,4}\b",
    "prokuratorskie": r"\b(?:PR\s+\d+\s+)?Ds\.\s?\d{1,6}\.\d{2,4}\b",
    "policyjne": r"\bRSD[\s-]\d{1,6}[/-]\d{2,4}\b",
    "administracyjne": r"\b(?:[IVX]{1,3}\s+SA/[A-Za-z]{2,3}|[IVX]{1,3}\s+OSK)\s+\d{1,5}/\d{2,4}\b",
    "sn_kio": r"\b(?:[IVX]{1,3}\s+CSK|KIO)\s+\d{1,5}/\d{2,4}\b",
    "komornicze": r"\b(?:G)?Km[p]?\s+\d{1,6}/\d{2,4}\b",
}
CASE_NUMBER = "|".join(f"(?:{p})" for p in CASE_SUBTYPES.values())

# --- fixed values: dates and amounts
MONTHS = ("stycznia", "lutego", "marca", "kwietnia", "maja", "czerwca", "lipca", "sierpnia", "września", "października", "listopada", "grudnia")
DATE_CORE = rf"(?:\d{{1,2}}[./-]\d{{1,2}}[./-]\d{{4}})|(?:\d{{4}}-\d{{2}}-\d{{2}})|(?:\d{{1,2}}\s+(?:{'|'.join(MONTHS)})\s+\d{{4}}\s*(?:r\.|roku)?)"
DATE = rf"(?P<value>{DATE_CORE})"
BIRTH_DATE = rf"(?:urodzon[ay]|ur\.|data urodzenia|urodzony w dniu)\s+(?P<value>{DATE_CORE})"
AMOUNT = r"(?i)(?<!\d)(?P<value>(?:\d+(?:[ .]\d{3})*,\d{2}\s*(?:zł|PLN|EUR|USD))|(?:\d+(?:[ .]\d{3})*\s*(?:zł|PLN|EUR|USD))|(?:kwotę\s+\d+\s*\([^)]+\)\s+złotych))"

# --- fixed values: persons and institutions
ROLES = (
    r"Pan|Pani|Mec\.|notariusz|adwokat|radca prawny|pełnomocnik|powód|pozwany|świadek|wnioskodawca|uczestnik"
    r"|wynajmujący|najemca|wierzyciel|dłużnik|mocodawca|apelujący|spadkobierca"
)
ROLE_PERSON = rf"(?i:{ROLES})\s+(?P<value>{WORD}\s+{WORD})"
COURT = rf"(?P<value>(?:Sąd|Prokuratura|Komenda)\s+(?:Rejonowy|Rejonowa|Okręgowy|Okręgowa|Apelacyjny|Powiatowa|Miejska|Wojewódzka)\s+(?:Policji\s+)?w\s+{WORD})"
_NAME = rf"[{UPPER}][\wąćęłńóśźż{UPPER}.\-]*"
LEGAL_FORMS = (
    r"[Ss]p\.?\s*[Zz]\s*[Oo]\.?[Oo]\.?|[Ss]półka\s+[Zz]\s*[Oo]graniczonią\s+Odpowiedzialności(?:ą)?|S\.?\s*A\.?|[Ss]półka\s+[Aa]kcyjna"
    r"|[Ss]p\.?\s*[KkJjPp]\.?|[Ss]półka\s+(?:Komandytowa|Jawna|Partnerska|Cywilna)|[Ss]\.?[Cc]\.?|sp\.\s*z\s+o\.\s*o\.\s*[Ss]p\.\s*[KkJj]\.?"
)
COMPANY = rf"(?P<value>{_NAME}(?:\s+(?:{_NAME}|[iw])){{0,5}}\s+(?:{LEGAL_FORMS}))"
NAME_PAIR = rf"(?P<a>{WORD})\s+(?P<b>{WORD})"

# --- fixed values: addresses
STREET = r"\b(?i:ul(?:ica|icy)?|al(?:eja|ei)?|pl(?:ac|acu)?|os(?:iedle|iedlu)?)\.?"
_STREET_WORD = rf"[{UPPER}][\wąćęłńóśźżĄĆĘŁŃÓŚŹŻ.\-]*"
_STREET_NAME = rf"{_STREET_WORD}(?:\s+{_STREET_WORD})*"
_BUILDING = r"\d+[A-Za-z]?(?:/\d+[A-Za-z]?)?"
ADDRESS_STREET = rf"(?P<value>{STREET}\s+{_STREET_NAME}\s+{_BUILDING})"
ADDRESS_NO_NUMBER = rf"(?P<value>{STREET}\s+{_STREET_NAME})(?!\s+{_BUILDING})"
ADDRESS_LIST = rf"ulic(?:ami|ą|y|a)\s*:?\s+(?P<value>{_STREET_NAME}(?:\s*,\s*{_STREET_NAME}|\s+i\s+{_STREET_NAME})*)(?=\s+w\s+{CAP}|[.;\n]|$)"
ADDRESS_POSTAL = rf"(?P<value>\d{{2}}-\d{{3}}\s+{WORD}(?:[\s-]{WORD})*)"
_ANCHOR = (
    r"zamieszkał[ay]?|zamieszkując[ay]?|zameldowan[ayi]+|z siedzibą|adres(?:em)?(?:\s+zamieszkania|\s+do korespondencji)?"
    r"|legitymując(?:y|a)? się|działając(?:y|a)?\s+w imieniu"
)
ADDRESS_ANCHOR = rf"(?:{_ANCHOR})\s+w\s+(?P<value>{CAP}[^.,;\n]{{2,80}}?)(?=[.,;\n]|$)"

# --- fixed values: checksums
PESEL_WEIGHTS = (1, 3, 7, 9, 1, 3, 7, 9, 1, 3)
NIP_WEIGHTS = (6, 5, 7, 2, 3, 4, 5, 6, 7)
REGON_WEIGHTS = (8, 9, 2, 3, 4, 5, 6, 7)
REGON14_WEIGHTS = (2, 4, 8, 5, 0, 9, 7, 3, 6, 1, 2, 4, 8)
ID_CARD_WEIGHTS = (7, 3, 1, 0, 7, 3, 1, 7, 3)
LAND_REGISTER_WEIGHTS = (1, 3, 7)
VIN_WEIGHTS = (8, 7, 6, 5, 4, 3, 2, 10, 0, 9, 8, 7, 6, 5, 4, 3, 2)
VIN_LETTERS = {
    "A": 1, "B": 2, "C": 3, "D": 4, "E": 5, "F": 6, "G": 7, "H": 8, "J": 1, "K": 2, "L": 3, "M": 4, "N": 5, "P": 7, "R": 9,
    "S": 2, "T": 3, "U": 4, "V": 5, "W": 6, "X": 7, "Y": 8, "Z": 9,
}
#: Characters that text recognition takes for each other, and how many of them a value may hold.
CONFUSED = {"O": "0", "0": "O", "I": "1l", "l": "1I", "1": "Il", "S": "5", "5": "S", "B": "8", "8": "B", "Z": "2", "2": "Z"}
MOST_CONFUSED = 2
OCR_SCORE, BOOSTED_SCORE, GAZETTEER_SCORE, CONTEXT_CHARS = 0.4, 0.85, 0.5, 40
ZERO_SHOT_THRESHOLD = 0.5

# --- fixed values: words near an identifier that confirm it
TRIGGERS = {
    "pesel": ("pesel", "ur.", "urodzony", "urodzona", "zamieszkały", "zamieszkała"),
    "nip": ("nip", "podatnik", "vat"),
    "regon": ("regon",),
    "iban": ("iban", "rachunek", "konto", "przelew", "nr rachunku"),
    "land_register": ("kw", "księga wieczysta", "nr księgi"),
    "id_card": ("dowód", "dowodu", "seria i numer", "legitymujący"),
    "passport": ("paszport", "paszportu"),
    "vehicle_vin": ("vin", "nadwozia", "pojazd"),
    "vehicle_plate": ("rej.", "rejestracyjny", "tablica"),
}

# --- fixed values: label of each category, and the categories that are left or not numbered
LABELS = {
    "phone": "numer telefonu", "email": "adres e-mail", "address": "adres", "pesel": "PESEL", "nip": "NIP", "regon": "REGON", "krs": "KRS",
    "land_register": "numer księgi wieczystej", "iban": "numer rachunku", "id_card": "dowód osobisty", "passport": "paszport", "vehicle_vin": "VIN",
    "vehicle_plate": "numer rejestracyjny", "npwz": "NPWZ", "case_number": "sygnatura akt", "notarial_act": "akt notarialny",
    "usc_act": "akt stanu cywilnego", "poswiadczenie_dziedziczenia": "poświadczenie dziedziczenia", "rejestr_spadkowy": "wpis w Rejestrze Spadkowym",
    "legal_role_person": "Osoba", "institution": "instytucja", "ip_address": "adres IP", "imei": "IMEI", "url": "adres URL",
    "birth_date": "data urodzenia", "amount": "kwota",
}
NUMBER, NO_NUMBER, LEAVE = "usun_i_numeruj", "usun_bez_numeru", "zostaw"
POLICIES = {category: NUMBER for category in LABELS} | {"date": LEAVE, "amount": NO_NUMBER}

# --- fixed values: Polish words
POLISH_WORDS = ("na", "nie", "że", "się", "jest", "dla", "oraz", "przez", "który", "która", "które", "być", "są", "był", "była", "były", "ze", "we", "czy", "tak", "ale", "gdy", "aby", "bez", "pod", "nad", "jak", "co")
PAGE_WORDS = ("i", "w", "na", "do", "nie", "jest", "się", "z", "że", "przez", "który", "która", "które", "dla", "oraz", "art")
COMMON_CAPITALISED = (
    "sąd", "sądu", "sądowi", "sądem", "sądzie", "prokuratura", "prokuratury", "prokuraturze", "prokuraturą", "urząd", "urzędu", "urzędem", "urzędzie",
    "kodeks", "kodeksu", "kodeksem", "kodeksie", "artykuł", "artykułu", "artykule", "artykułem", "ustawa", "ustawy", "ustawie", "ustawą", "rzeczpospolita",
    "rzeczypospolitej", "polska", "polski", "polskiej", "polską", "pan", "pani", "państwo", "państwa", "rejonowy", "rejonowego", "rejonowym", "okręgowy",
    "okręgowego", "okręgowym", "apelacyjny", "apelacyjnego", "apelacyjnym",
)
NAME_SUFFIXES = (
    "skiego", "skiemu", "skimi", "skich", "skiej", "skim", "ska", "ski", "ckiego", "ckiemu", "ckimi", "ckich", "ckiej", "ckim", "cka", "cki",
    "owi", "ego", "emu", "ie", "em", "om", "y", "a", "e",
)
#: Ending of a surname, characters cut from it, endings of its forms; the first that fits holds.
INFLECTION = (
    ("ski", 3, ("ski", "skiego", "skiemu", "skim")),
    ("ska", 3, ("ska", "skiej", "ską")),
    ("cki", 3, ("cki", "ckiego", "ckiemu", "ckim")),
    ("cka", 3, ("cka", "ckiej", "cką")),
    ("icz", 0, ("a", "owi", "em", "u")),
    ("a", 1, ("a", "y", "ą", "ę", "o")),
    ("y", 1, ("y", "ego", "emu", "ym")),
    ("k", 0, ("a", "owi", "iem", "u")),
    ("g", 0, ("a", "owi", "iem", "u")),
    ("", 0, ("a", "owi", "em", "u")),
)


def java(pattern: str) -> str:
    """The pattern for Java's engine, with Python's meaning of \\d, \\w, \\s, \\b, $ and of ignoring case."""
    flags = "(?dU)"
    if pattern.startswith("(?i)"):
        flags, pattern = "(?dUiu)", pattern[4:]
    return flags + pattern.replace("(?P<", "(?<").replace("(?i:", "(?iu:")
