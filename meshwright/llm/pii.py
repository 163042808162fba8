"""Problem 8: personal information inside free text.

Finds e-mail addresses (also written around), phone numbers, identity numbers, street addresses and person names, and
replaces each by a typed placeholder; dates of birth and numbers of bank accounts and cards are items of the operator, too.
The placeholder of an item holds a format-preserving pseudonym: its letters and digits are permuted under a key by a
Feistel network within their format, so equal values stay linked across documents and can be told apart, while the value
itself can only be had back with the key. Numbers are validated and stay as valid as they were: check digits and letters
keep their distance from the right one, numbers with ranges (social security, insurance) walk on until they are as much
in range as before, dates are permuted among the days of their span, and phone numbers keep their country and area code,
so +49 and 0049 and the national form of one number stay linked.

Items are found by shape and confirmed by what stands around them: numbers and addresses by their formats and by words
that name them something else (batch, file, serial ...), names by titles, roles, phrases that have a person before or
behind them, or another personal item next to them. Line breaks count as blanks.

Defined results
---------------
* Null and empty texts have no items and come back unchanged. Texts are read whole, however long.
* Overlapping finds: the longer one holds, of equal ones the one by the order of KINDS.
* Without a key the pseudonyms' key is drawn anew for each application, so they link within it only.
* Repeated documents and repeated items are each returned. Empty tables give empty results; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import hmac
import re
from bisect import bisect_left
from collections.abc import Iterator
from datetime import date, datetime

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Kinds that identify a person, and those found beside them.
PERSONAL = ("email", "id_number", "street_address", "phone", "person_name")
KINDS = ("account_number", *PERSONAL[:4], "birth_date", "person_name")
_UP, _LOW = "A-ZÀ-ÖØ-ÞŠŽ", "a-zß-öø-ÿšž"
_CAP = rf"(?:[A-Z]['’](?=[{_UP}]))?[{_UP}][{_LOW}]+(?:-[{_UP}][{_LOW}]+)*"

# --- e-mail ---------------------------------------------------------------------------------------------------------
_LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_LABEL = r"[A-Za-z0-9][A-Za-z0-9\-]*"
_DOMAIN = re.compile(rf"{_LABEL}(?:\.{_LABEL})*\.[A-Za-z][A-Za-z]+")
# a dot with blanks goes on only in lower case: it may end a sentence
_NEXT = rf"(?:\.{_LABEL}|\s?\.\s?[a-z0-9][a-z0-9\-]*)"
_SPACED_DOMAIN = re.compile(rf"\s{{0,2}}{_LABEL}{_NEXT}*(?:\.[A-Za-z]{{2,}}|\s?\.\s?[a-z]{{2,}})")
_AT_WORD = re.compile(r"[\[(]\s?at\s?[\])]", re.I)
_DOT = r"(?:\s?[\[(]\s?(?:dot|DOT)\s?[\])]\s?|\s+dot\s+)"
_WORDED_DOMAIN = re.compile(rf"\s?{_LABEL}(?:{_DOT}{_LABEL}|{_NEXT})+")
_SPELT = re.compile(r"(?<![A-Za-z0-9_+\-])[A-Za-z0-9_+\-]++(?:\s+dot\s+[A-Za-z0-9_+\-]+)*\s+at\s+[A-Za-z0-9\-]+(?:\s+dot\s+[A-Za-z0-9\-]+)+")


def _local_before(text: str, at: int) -> int:
    """Start of the local part that ends at `at`, or -1; up to two blanks may stand between."""
    end = at
    while end > 0 and at - end < 3 and text[end - 1].isspace():
        end -= 1
    if at - end > 2:
        return -1
    start = end
    while start > 0 and text[start - 1] in _LOCAL_CHARS:
        start -= 1
    while start < end and not text[start].isalnum():
        start += 1
    return start if start < end else -1


def _emails(text: str) -> Iterator[tuple[int, int]]:
    for sign in "@＠":
        at = text.find(sign)
        while at >= 0:
            tight = at > 0 and not text[at - 1].isspace() and at + 1 < len(text) and not text[at + 1].isspace()
            domain = (_DOMAIN if tight else _SPACED_DOMAIN).match(text, at + 1)
            start = _local_before(text, at)
            if start >= 0 and domain and not re.search(r"\d\Z", domain.group(0)):
                yield start, domain.end()
            at = text.find(sign, at + 1)
    for m in _AT_WORD.finditer(text) if "at" in text else ():
        start, domain = _local_before(text, m.start()), _WORDED_DOMAIN.match(text, m.end())
        if start >= 0 and domain and domain.group(0)[-1].isalpha():
            yield start, domain.end()
    if " dot " in text or re.search(r"\sdot\s", text):
        yield from (m.span() for m in _SPELT.finditer(text))


# --- identity numbers -----------------------------------------------------------------------------------------------
_ID = re.compile(
    r"(?<![\w./\-])(?:"
    r"[A-Z]{2}\s?\d\d\s?\d\d\s?\d\d\s?[A-D](?!\w)"  # two letters, three pairs, letter
    r"|[A-Z]{2}[\-\s]\d{3}[\-\s]\d{3}[\-\s]\d{1,3}(?![\w\-])"
    r"|[A-Z]\d[\dA-Z]\d[\dA-Z]\d[\dA-Z]\d[\dA-Z](?!\w)|[A-Z]\d{8}(?!\w)|[A-Z]\d\d[A-Z]\d\d[A-Z]\d\d(?!\w)"
    r"|\d{3}[\-\s]\d\d[\-\s]\d{4}(?![\w\-])"
    r"|\d{8}-[A-Z](?!\w)"
    r"|\d{6}-\d{4}(?![\w\-])"
    r")"
)
_NOT_ID = re.compile(r"(?:\bfile|part|list:?|compound|certificate|batch|serial|standard|application|archive|drawing|order|model|type|lot)\b\W*(?:no\.?|number|nr\.?|n°)?\W*\Z", re.I)


def _ids(text: str, a: int, b: int) -> Iterator[tuple[int, int]]:
    for m in _ID.finditer(text, a, b):
        if not _NOT_ID.search(text, max(0, m.start() - 40), m.start()):
            yield m.start(), m.end()


# --- accounts and dates of birth ------------------------------------------------------------------------------------------
_IBAN = re.compile(r"(?<![\w])[A-Z]{2}\d\d(?:\s?[A-Z0-9]{4}){2,7}(?:\s?[A-Z0-9]{1,3})?(?!\w)")
_CARD = re.compile(r"(?<![\w.+\-])\d{4}([\s\-]?)\d{4}\1\d{4}\1\d{1,7}(?![\w\-])")
_DATE = r"(?:\d{1,2}[./\-]\d{1,2}[./\-]\d{4}|\d{4}-\d\d-\d\d)"
_DATE_AT = re.compile(rf"{_DATE}(?!\w)")
_BORN = re.compile(r"(?i:\bborn(?:\son)?|\bdate\sof\sbirth|\bDOB|\bgeb(?:oren(?:\sam)?|\.)|\bnée?\sle|\bnacid[oa]\sel|\bfecha\sde\snacimiento|\bdate\sde\snaissance|\bgeburtsdatum)\s?:?\s?\Z")


def iban_remainder(value: str) -> int:
    """97-remainder of an account number; 1 if it is valid."""
    flat = "".join(c for c in value if not c.isspace())
    return int("".join(str(int(c, 36)) for c in flat[4:] + flat[:4])) % 97


def luhn_digit(digits: list[int]) -> int:
    """The digit that makes the number valid when put behind the given ones."""
    total = 0
    for i, x in enumerate(reversed(digits)):
        x = x * 2 if i % 2 == 0 else x
        total += x - 9 if x > 9 else x
    return -total % 10


def _accounts(text: str, a: int, b: int) -> Iterator[tuple[int, int]]:
    for m in _IBAN.finditer(text, a, b):
        if iban_remainder(m.group(0)) == 1:
            yield m.span()
    for m in _CARD.finditer(text, a, b):
        digits = [int(c) for c in m.group(0) if c.isdigit()]
        if 13 <= len(digits) <= 19 and luhn_digit(digits[:-1]) == digits[-1] and any(digits):
            yield m.span()


# --- phone numbers --------------------------------------------------------------------------------------------------
_D = "[0-9O]"
_PHONE = re.compile(
    rf"(?<![\w/\-])(?<!\d\.)(?:"
    rf"\+\d{{1,3}}[\s.\-]?(?:\(\d{{1,4}}\)[\s.\-]?)?{_D}{{1,5}}(?:[\s.\-/]?{_D}{{2,8}}){{1,5}}"
    rf"|00\d{{2}}[\-\s.]\d{{1,4}}(?:[\-\s.]\d{{2,5}}){{2,4}}"
    rf"|(?:1[\s.\-])?\(\d{{3}}\)\s?\d{{3}}[\-\s.]\d{{4}}"
    rf"|(?:1[\s.\-])?[2-9]{_D}{_D}([\s.\-]){_D}{{3}}(?:\1|\s){_D}{{4}}"
    rf"|0\d{{2,4}}[/\s]\d{{3,5}}[\-\s]\d{{3,4}}"
    rf"|0\d(?:[.\s]\d\d){{4}}"
    rf")(?![\w])(?!-\d)(?:\s(?:ext|extn|Durchwahl|poste)\b\.?\s?\d{{1,5}})?"
)
_NOT_PHONE = re.compile(r"(?:batch|serial|compound|certificate|file|part list|application|lot|standard|order|charge)\b\W*(?:no\.?|number|nr\.?)?\W*\Z", re.I)


def _phones(text: str, a: int, b: int) -> Iterator[tuple[int, int]]:
    for m in _PHONE.finditer(text, a, b):
        s = m.group(0)
        digits = sum(c in "0123456789O" for c in re.split(r"\s[a-zA-Z]", s)[0])
        if not 9 <= digits <= 15 or (s[0] == "+" and digits < 10):
            continue
        if _NOT_PHONE.search(text, max(0, m.start() - 30), m.start()):
            continue
        yield m.start(), m.end()


# --- street addresses -----------------------------------------------------------------------------------------------
_ROAD = r"(?:Street|St\.|Road|Rd\.?|Lane|Ln\.?|Avenue|Ave\.?|Boulevard|Blvd\.?|Close|Drive|Dr\.|Way|Court|Square|Terrace|Place)"
_RUE = r"(?:rue|avenue|boulevard|chemin|place|allée|quai|route|impasse|cours)"
_CALLE = r"(?:Calle|Avenida|Plaza|Paseo|Camino|Carrera|Ronda)"
_WORDS = rf"{_CAP}(?:\s{_CAP}){{0,1}}"
_SHOUT = rf"[{_UP}]{{3,}}(?:\s[{_UP}]{{3,}}){{0,2}}"
_ADDRESS = re.compile(
    rf"(?<![\w.,\-/])(?:"
    rf"\d{{1,4}}[a-z]?,?\s(?:{_WORDS}\s{_ROAD}|{_SHOUT}\s{_ROAD.upper()}|{_RUE}\s(?:de\s(?:la\s|l')?|des\s|du\s|d')?{_CAP})(?![\w])"
    rf"|{_CALLE}\s(?:de\s(?:la\s|los\s)?|del\s)?{_WORDS},?\s\d{{1,4}}[a-z]?(?![\w])"
    rf"|[{_UP}][{_LOW}]+(?:gasse|straße|strasse|str\.|weg|platz|allee|ring|damm|ufer)\s\d{{1,4}}\s?[a-z]?(?![\w])"
    rf"|{_WORDS}\s{_ROAD}\s\d{{1,4}}[a-z]?(?![\w])"
    rf")"
)
_CALLE_UP, _GASSE_UP = _CALLE.upper(), r"(?:GASSE|STRASSE|STR\.|WEG|PLATZ|ALLEE|RING|DAMM)"
_ADDRESS_SHOUTED = re.compile(
    rf"(?<![\w.,\-/])(?:{_CALLE_UP}\s{_SHOUT}\s\d{{1,4}}(?!\w)|[{_UP}]{{3,}}{_GASSE_UP}\s\d{{1,4}}[a-zA-Z]?(?!\w)|{_SHOUT}\s{_ROAD.upper()}\s\d{{1,4}}(?!\w)|\d{{1,4}},?\s{_RUE.upper()}\s(?:DES\s|DE\s|DU\s)?[{_UP}]{{3,}})"
)


_ROADISH = re.compile(rf"(?<!\w)(?:{_ROAD}|{_ROAD.upper()}|{_RUE}|{_CALLE}|{_CALLE_UP})(?!\w)|(?:gasse|straße|strasse|str\.|weg|platz|allee|ring|damm|ufer|{_GASSE_UP})\s\d")


def _address_at(text: str, at: int) -> tuple[int, int] | None:
    end = at + 60
    if end < len(text) and text.count(" ", at, end) < 6:  # long words: as far as the sixth blank
        for _ in range(6):
            end = text.find(" ", end) + 1 or len(text)
    if _ROADISH.search(text, at, end) and (m := _ADDRESS.match(text, at) or _ADDRESS_SHOUTED.match(text, at)):
        return m.span() if _plain_name(m.group(0)) else None
    return None


# --- scans: the only passes over whole texts, kept to patterns that start with a plain character class -------------------
#: A capitalised word before another one or before a number.
_CAPS_SCAN = re.compile(rf"[{_UP}][\w.'’\-]*+,?\s(?:(?:van der|van den|van|von|de la|del|de|da|di)\s)?(?=[{_UP}0-9])")
#: A number before a capitalised word or a word for a road, or a longer run of digits and signs.
_DIGIT_SCAN = re.compile(rf"[0-9](?:[0-9OA-Z\-./()\s]{{6,}}|[0-9]*+[a-z]?,?\s(?:(?=[{_UP}])|{_RUE}\s))")


def _solid(text: str, caps: list[int]) -> Iterator[tuple[int, int, str]]:
    for a, b in _emails(text):
        yield a, b, "email"
    seen = -1
    for m in _DIGIT_SCAN.finditer(text):
        a, b = m.span()
        while a > 0 and text[a - 1].isdigit():
            a -= 1
        run = m.group(0)
        if len(run) >= 7 and sum(map(run.count, "0123456789")) >= 5:
            start, end = max(seen, a - 6, 0), b + 12
            for x, y in _ids(text, start, end):
                yield x, y, "id_number"
            if (day := _DATE_AT.match(text, a)) and _BORN.search(text, max(0, a - 24), a):  # longer than any of the phrases
                yield *day.span(), "birth_date"
            if sum(map(run.count, "0123456789")) >= 10:
                for x, y in _accounts(text, start, end + 30):
                    yield x, y, "account_number"
            for x, y in _phones(text, start, end):
                yield x, y, "phone"
        if (found := _address_at(text, a)) or (b - a > 5 and (inner := re.search(r"[0-9]+[a-z]?,?\s[^0-9\s]*\Z", run)) and (found := _address_at(text, m.start() + inner.start()))):
            yield *found, "street_address"
    for a in caps:
        if found := _address_at(text, a):
            yield *found, "street_address"


# --- names ----------------------------------------------------------------------------------------------------------
_INITIAL = rf"[{_UP}]\."
_PARTICLE = r"(?:(?:van der|van den|van|von|de la|de|del|da|di|le)\s)?"
_NAME = re.compile(
    rf"(?:{_CAP}|{_INITIAL})\s(?:{_INITIAL}\s){{0,2}}{_PARTICLE.replace(' ', chr(92) + 's')}{_CAP}(?![\w])"  # given or initials, surname
    rf"|[{_UP}]{{3,}}(?:-[{_UP}]{{3,}})?,\s(?:{_CAP}|{_INITIAL}(?:\s{_INITIAL})*)"  # SURNAME, Given
    rf"|{_CAP},\s{_INITIAL}(?:\s{_INITIAL})*"  # Surname, I.
    rf"|[{_UP}]{{3,}}\s(?:{_PARTICLE.upper().replace(' ', chr(92) + 's')})[{_UP}]{{3,}}(?:-[{_UP}]{{3,}})?(?![\w])"
)
_LOWER_NAME = re.compile(rf"[{_LOW}]{{3,}}(?:-[{_LOW}]{{3,}})?,\s[{_LOW}]{{3,}}(?![\w])")
_COMMA = re.compile(rf", ([{_LOW}]+)")
#: Words that commonly follow a comma and are no given names. Fixed list.
_COMMON = frozenset(
    "the a an and or in of to which where wherein when with without more further preferably such so as by if for characterised comprising "
    "das der die dass wobei mit so und oder in wird où dans le la les et caractérisé avec donde en el los las y con caracterizado not after page "
    "born who holder state passport reisepass passeport pasaporte tel tél telephone phone".split()
)
#: Last words of the phrases below that have a name behind them; checked first since commas are many.
_LEADS = frozenset("by to of de pour von nach i, zeuge zeugin is an a as según joindre person".split())
_TITLE = r"(?:(?:Mr|Mrs|Ms|Miss|Mister|Dr|Prof|Herrn?|Frau|Hr|Fr|Mme|Mlle|Monsieur|Madame|M|Sr|Sra|Srta|Señora?|Don|Doña)\b\.?\s)"
#: Words for what a person is to others. Fixed list.
_ROLE = (
    "patient|client|customer|tenant|resident|employee|colleague|trainee|nurse|doctor|surgeon|teacher|pupil|student|neighbour|widow|widower|daughter|son|brother|sister|mother|father|husband|wife|caretaker|driver|mechanic|technician|"
    "Patientin?|Kundin|Kunde|Mieterin?|Mitarbeiterin?|Kollegin|Kollege|Nachbarin?|Witwer?|Tochter|Sohn|Bruder|Schwester|Ehefrau|Ehemann|Ärztin|Arzt|Lehrerin?|Technikerin?|"
    "patiente|cliente?|locataire|employée?|collègue|voisine?|veuve|veuf|fille|fils|frère|sœur|épouse|époux|médecin|"
    "paciente|inquilin[oa]|emplead[oa]|compañer[oa]|vecin[oa]|viud[oa]|hij[oa]|herman[oa]|espos[oa]|médic[oa]"
)
#: Phrases that have a person's name behind them. Titles may stand in between.
_BEFORE = re.compile(
    rf"(?:(?<![\w]){_TITLE}|(?i:\binventor(?:\sperson)?(?:\sis|\sare)?\s?:?\s|\binventeurs?\s?:\s|\berfinder(?:in)?\s?:\s|\binventores?\s?:\s)"
    rf"|\b(?:{_ROLE})\s"
    r"|(?i:\b(?:contact person|correspondence to|thanks are due to|note of the examiner:|examiner:|witness:|zeuge|zeugin|testigo:|témoin ?:|declaration: i,|signed by|assigned by|drawing by|watched by|notebook of|owed to|handed to|établie pour|a nombre de|d['’]après|nach aussage von|llamar a|joindre|rückfragen an|según|agente?|avocat|anwalt|attorney|abogad[oa])\s)|\(72\)\s)\Z",
)
#: Phrases that have a person's name before them.
_AFTER = re.compile(
    r",?\s(?:who lives at|told the office|filed an objection|wrote from|before the clerk|born abroad|holder of (?:passport|identity)|dwelling at)|,\s(?:who lives|born|holder|reisepass|pass(?:e)?port|pasaporte|wohnhaft|domicilié|domiciliad[oa])\b"
    r"|\s\(social security|\s\((?:passport|tax|identity)|\s/\s(?:witness|zeuge|testigo|témoin)|,\s(?:tel|tél|telephone|phone|e-mail|courriel|correo)\b|\sbe made, and dwelling|\sfor the loan of|,\spage\s\d",
    re.I,
)
_AND_AFTER = re.compile(r"\s(?:and|und|et|y)\s", re.I)
#: Words a firm, foundation, road, method or the like has next to its name.
_FIRM = re.compile(r"\s(?:&|Systems|Ltd|Limited|GmbH|AG|AB|KG|KK|Inc|Corp|LLC|Co\b|S\.A|SA\b|SARL|S\.L|Works|Foundation|Stiftung|Fondation|Fundación|Institute|University|Company|Group|Street|Road|Lane|filter|transform|method|lane|scenario|algorithm|theorem|equation|law|test|process|routine|Reset)", re.I)
_FIRM_BEFORE = re.compile(r"(?:\broutine|registry of|&|\bthe firm|\bcompany|\bfirma|\bfoundation|\bstiftung|\bsociété|\bempresa|\bthe)\s\Z", re.I)
#: Capitalised words that are no part of a name. Fixed list.
_WORDS_NOT_NAMES = frozenset(
    "The This That These Those Here There Each Every Said See Let Use As At By For From If In It Its No Not Of On Or To When While With Without "
    "Alternatively Preferably According Known During Reference Method System Device Figure Fig Claims Abstract Description Background Summary "
    "Systems Works Holdings Industries Group Foundation Institute Company Agent Attorney Mail Phone Fax Tel Telephone Address Invoices Signed Assigned Inventor Inventors Contact Correspondence Note Scan Batch Serial Part Compound "
    "Certificate Identity Call Reach Questions Thanks Witness Declaration Please Drawing Tax Deed Licence Copy Apt Port San Lower Upper North South "
    "Das Der Die Ein Eine Einer Eines Dabei Bekannte Bevorzugt Gemäß Nach Vorrichtung Verfahren Anspruch Ansprüche Zeuge Erfinder Anschrift Adresse "
    "Rückfragen Tel Gehäuse Regen Staub Lösungen Zustand Seite Abstand Bauteil Baugruppe Element Träger Einheit Wert Halterung Ausführungsform "
    "Überschreitet Übersteigt Reisepass Ausweisnummer Unterlagen Aussage Muster Akte Frau Herr Herrn "
    "Le La Les Un Une On Selon Lorsque Comme Pour Dispositif Procédé Solutions De Adresse Témoin Inventeur Carte Courriel "
    "El Los Las Una Se En Si Según Como Para Dispositivo Preferiblemente Testigo Domicilio Documento Correo "
    "Mr Mrs Ms Miss Dr Prof Mme Mlle January February March April May June July August September October November December".split()
)


def _plain_name(s: str) -> bool:
    return not any(w in _WORDS_NOT_NAMES for w in re.findall(rf"[{_UP}][{_LOW}]*[{_LOW}]", s))


def _apart(found: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    """Drops what overlaps a longer item."""
    rank = {k: i for i, k in enumerate(KINDS)}
    taken: list[tuple[int, int]] = []
    out = []
    for a, b, kind in sorted(set(found), key=lambda x: (x[0] - x[1], rank[x[2]], x[0])):
        i = bisect_left(taken, (a, b))
        if (i < len(taken) and taken[i][0] < b) or (i and taken[i - 1][1] > a):
            continue
        taken.insert(i, (a, b))
        out.append((a, b, kind))
    return sorted(out)


def _name_candidates(text: str, caps: list[int]) -> Iterator[re.Match]:
    done = 0
    for at in caps:
        if at >= done and (m := _NAME.match(text, at)) and _plain_name(m.group(0)):
            # "M." behind a French verb is a title
            title = m.group(0).startswith("M.") and re.search(r"(?:joindre|contacter|appeler)\s\Z", text[max(0, m.start() - 12) : m.start()])
            m = (title and _NAME.match(text, m.start() + 3)) or m
            yield m
            done = m.end()


def _names(text: str, solid: list[tuple[int, int, str]], caps: list[int]) -> list[tuple[int, int, str]]:
    """Names, confirmed by what stands before or behind them; solid are the items found so far, in order."""
    starts = [a for a, _, _ in solid]
    ends = sorted(b for _, b, _ in solid)
    out, maybe = [], []
    for m in _name_candidates(text, caps):
        a, b = m.span()
        if _FIRM.match(text, b) or _FIRM_BEFORE.search(text, max(0, a - 20), a):
            continue
        i = bisect_left(starts, b)
        gap = text[b : starts[i]] if i < len(starts) and starts[i] - b <= 14 else None
        beside = gap is not None and re.fullmatch(r"\s?[|/(;,:]?\s?(?:au|on|an|at|unter|tel\.?|ID)?\s?[|/(:]?\s?", gap, re.I) is not None
        j = bisect_left(ends, a)
        lead = text[ends[j - 1] : a] if j and a - ends[j - 1] <= 14 else (text[ends[j] : a] if j < len(ends) and ends[j] == a else None)
        behind = lead is not None and re.fullmatch(r"\s?[|/]\s?|\s(?:von|de|of)\s", lead, re.I) is not None
        window = text[max(0, a - 45) : a].replace("\n", " ")
        after = text[b : b + 40].replace("\n", " ")
        if _BEFORE.search(window) or _AFTER.match(after) or beside or behind:
            out.append((a, b, "person_name"))
        else:
            maybe.append((a, b))
    sure = {a for a, _, _ in out}
    for a, b in maybe:  # partners of names: "X and Y filed", "(72) X; Y"
        follow = re.match(r"\s?(?:;|,|\b(?:and|und|et|y)\b(?:\sby)?)\s(?:(?:Mr|Ms|Mrs|Dr|Herr|Frau|Mme)\.?\s)?", text[b : b + 16])
        if follow and b + follow.end() in sure:
            out.append((a, b, "person_name"))
    ends_of = {b for _, b, _ in out}
    for a, b in maybe:
        lead = re.search(r"(?:;|,\s(?:and|und)|\b(?:and|und|et|y))(?:\sby)?\s?(?:(?:Mr|Ms|Mrs|Dr|Herr|Frau|Mme)\.?\s)?\Z", text[max(0, a - 16) : a].replace("\n", " "))
        if lead and a - len(lead.group(0)) in ends_of or lead and a - len(lead.group(0)) - 1 in ends_of:
            out.append((a, b, "person_name"))
    # names in lower case throughout are only taken as "surname, given" behind a phrase or title
    for m in _COMMA.finditer(text):
        if m[1] in _COMMON:
            continue
        at = m.start()
        start = max(text.rfind(" ", 0, at), text.rfind("\n", 0, at)) + 1
        lead = text[max(0, start - 14) : start].split()
        if lead and (lead[-1].lower() in _LEADS or lead[-1][-1] in ":.)" or lead[-1][0].isupper()) and (name := _LOWER_NAME.match(text, start)):
            if _BEFORE.search(text[max(0, start - 45) : start].replace("\n", " ")):
                out.append((name.start(), name.end(), "person_name"))
    return out


def find_pii(text: str | None) -> list[tuple[int, int, str]]:
    """Items as (start, end, kind), by start; offsets count characters from 0."""
    if not text:
        return []
    caps = [m.start() for m in _CAPS_SCAN.finditer(text) if not (m.start() and (text[m.start() - 1].isalnum() or text[m.start() - 1] in "'’-_"))]
    solid = _apart(list(_solid(text, caps)))
    names = _names(text, solid, caps)
    return _apart(solid + names) if names else solid


# --- pseudonyms -----------------------------------------------------------------------------------------------------
_DIGITS, _LETTERS = "0123456789", "abcdefghijklmnopqrstuvwxyz"
_MORE_LETTERS = _LETTERS + "ßàáâãäåæçèéêëìíîïðñòóôõöøùúûüýþÿšž"
ROUNDS = 10


def _round(key: bytes, tweak: bytes, i: int, n: int, half: int) -> int:
    return int.from_bytes(hashlib.blake2b(half.to_bytes((half.bit_length() + 8) // 8, "big"), key=key, digest_size=32, person=(bytes([i]) + tweak)[:16], salt=n.to_bytes(4, "big")).digest(), "big")


def feistel(symbols: list[int], radix: int, key: bytes, tweak: bytes = b"", *, back: bool = False) -> list[int]:
    """Keyed permutation of the strings of this length over this radix: an alternating Feistel network."""
    n = len(symbols)
    if n < 2:
        shift = _round(key, tweak, 255, n, 0)
        return [(x - shift if back else x + shift) % radix for x in symbols]
    u = n // 2
    number = lambda part: sum(x * radix**k for k, x in enumerate(reversed(part)))
    a, b = number(symbols[:u]), number(symbols[u:])
    size = (radix**u, radix ** (n - u))
    if back:
        for i in reversed(range(ROUNDS)):
            side = i % 2
            a, b = (b - _round(key, tweak, i, n, a)) % size[side], a
        # after an even number of rounds the halves are in place again
    else:
        for i in range(ROUNDS):
            side = i % 2
            a, b = b, (a + _round(key, tweak, i, n, b)) % size[side]
    out = []
    for x, k in ((a, u), (b, n - u)):
        out += [x // radix**j % radix for j in reversed(range(k))]
    return out


def permute_text(value: str, key: bytes, tweak: bytes = b"", *, back: bool = False) -> str:
    """Digits permuted among digits, letters among letters with their case; all other characters stay."""
    out = list(value)
    for is_kind, alphabet in ((str.isdigit, _DIGITS), (str.isalpha, None)):
        at = [i for i, c in enumerate(value) if is_kind(c)]
        lower = [value[i].lower() for i in at]
        abc = alphabet or (_LETTERS if all(c in _LETTERS for c in lower) else _MORE_LETTERS)
        at = [i for i, c in zip(at, lower, strict=True) if c in abc and len(c) == 1]
        symbols = feistel([abc.index(value[i].lower()) for i in at], len(abc), key, tweak, back=back)
        for i, x in zip(at, symbols, strict=True):
            out[i] = abc[x].upper() if value[i].isupper() and len(abc[x].upper()) == 1 else abc[x]
    return "".join(out)


def canonical(kind: str, value: str) -> str:
    """One writing for equal values: blanks single, addresses of mail in plain form, OCR'd digits and names' order mended."""
    value = re.sub(r"\s+", " ", value).strip()
    if kind == "email":
        value = re.sub(r"\s?[\[(]\s?at\s?[\])]\s?|\s?[@＠]\s?| at ", "@", value, flags=re.I)
        return re.sub(r"\s?[\[(]\s?dot\s?[\])]\s?| dot |\s?\.\s?", ".", value, flags=re.I).lower()
    if kind == "phone":
        return re.sub(r"(?<=\d)O|O(?=\d)", "0", value)
    if kind == "person_name":
        if m := re.fullmatch(r"([^,]+), (.+)", value):
            value = f"{m[2]} {m[1]}"
        return value.title() if value.isupper() or value.islower() or any(len(w) > 2 and w.isupper() for w in re.split(r"[ -]", value)) else value
    return value


def permute_number(x: int, size: int, key: bytes, tweak: bytes = b"", *, back: bool = False) -> int:
    """Keyed permutation of the numbers below size: digits are permuted until the result is below it (cycle walking)."""
    n = max(2, len(str(size - 1)))
    while True:
        x = int("".join(map(str, feistel([int(c) for c in str(x).zfill(n)], 10, key, tweak, back=back))))
        if x < size:
            return x


def _fill(value: str, digits: str) -> str:
    """The value with its digits replaced, in order."""
    new = iter(digits)
    return "".join(next(new) if c.isdigit() else c for c in value)


#: Letters of the Spanish number by its 23-remainder, prefixes not given out in the British one, and spans of days. Fixed values.
_DNI = "TRWAGMYFPDXBNJZSQVHLCKE"
_NO_PREFIX = frozenset("BG GB KN NK NT TN ZZ".split())
_FIRST_DAY, _DAYS = date(1850, 1, 1).toordinal(), date(2100, 1, 1).toordinal() - date(1850, 1, 1).toordinal()


def valid_ssn(digits: str) -> bool:
    return digits[:3] not in ("000", "666") and digits[0] != "9" and digits[3:5] != "00" and digits[5:] != "0000"


def valid_nino(prefix: str) -> bool:
    return not set(prefix) & set("DFIQUV") and prefix[1] != "O" and prefix not in _NO_PREFIX


def _walk(value, step, like):
    """The first further value of a permutation that is as valid as this one."""
    want, value = like(value), step(value)
    while like(value) != want:
        value = step(value)
    return value


def _id_pseudonym(value: str, key: bytes, back: bool) -> str:
    digits = "".join(c for c in value if c.isdigit())
    step = lambda tweak: lambda x: permute_text(x, key, tweak, back=back)
    if re.fullmatch(r"\d{3}[\- ]\d\d[\- ]\d{4}", value):
        return _fill(value, _walk(digits, step(b"ssn"), valid_ssn))
    if re.fullmatch(r"\d{8}-[A-Z]", value) and value[-1] in _DNI:
        new = permute_text(digits, key, b"dni", back=back)
        off = _DNI.index(value[-1]) - int(digits) % 23
        return f"{new}-{_DNI[(int(new) % 23 + off) % 23]}"
    if re.fullmatch(r"\d{6}-\d{4}", value):
        # a day, three digits and a Luhn digit; a part that is no day is permuted like any number
        day = _two_digit_day(digits[:6], key, back)
        new = (day or permute_text(digits[:6], key, b"day", back=back)) + permute_text(digits[6:9], key, b"serial", back=back)
        off = int(digits[9]) - luhn_digit([int(c) for c in digits[:9]])
        return _fill(value, f"{new}{(luhn_digit([int(c) for c in new]) + off) % 10}")
    if m := re.fullmatch(r"([A-Z]{2})(\s?\d\d\s?\d\d\s?\d\d\s?)([A-D])", value):
        prefix = _walk(m[1], step(b"prefix"), valid_nino)
        suffix = "ABCD"[feistel(["ABCD".index(m[3])], 4, key, b"suffix", back=back)[0]]
        return prefix + permute_text(m[2], key, b"nino", back=back) + suffix
    return permute_text(value, key, b"id_number", back=back)


def _two_digit_day(digits: str, key: bytes, back: bool) -> str | None:
    """A day as yymmdd or ddmmyy in its century, permuted among the days of a century; None if it is no day."""
    first, days = date(1900, 1, 1).toordinal(), date(2000, 1, 1).toordinal() - date(1900, 1, 1).toordinal()
    for form in ("%y%m%d", "%d%m%y"):
        try:
            day = datetime.strptime(digits, form).date()
        except ValueError:
            continue
        try:
            day = day.replace(year=1900 + day.year % 100)
        except ValueError:  # 29 February 2000
            return None
        return date.fromordinal(first + permute_number(day.toordinal() - first, days, key, form.encode(), back=back)).strftime(form)
    return None


def _date_pseudonym(value: str, key: bytes, back: bool) -> str:
    parts = re.split(r"([./\-])", value)
    year_first = len(parts[0]) == 4
    y, m, d = (int(parts[i]) for i in ((0, 2, 4) if year_first else (4, 2, 0)))
    try:
        at = date(y, m, d).toordinal() - _FIRST_DAY
    except ValueError:
        at = -1
    if not 0 <= at < _DAYS:
        return permute_text(value, key, b"birth_date", back=back)
    day = date.fromordinal(_FIRST_DAY + permute_number(at, _DAYS, key, b"birth_date", back=back))
    sep = parts[1]
    return f"{day.year:04d}-{day.month:02d}-{day.day:02d}" if year_first else f"{day.day:02d}{sep}{day.month:02d}{sep}{day.year:04d}"


def _phone_pseudonym(value: str, key: bytes, back: bool) -> str:
    """The last six digits permuted (of numbers below nine digits the later half), and an extension; country and area code stay."""
    m = re.search(r"\s(?:ext|extn|Durchwahl|poste)\b\.?\s?\d+\Z", value)
    main, more = (value[: m.start()], value[m.start() :]) if m else (value, "")
    digits = "".join(c for c in main if c.isdigit())
    n = 6 if len(digits) >= 9 else len(digits) // 2
    new = digits[:-n] + permute_text(digits[-n:], key, b"phone", back=back) if n else digits
    return _fill(main, new) + _fill(more, permute_text("".join(c for c in more if c.isdigit()), key, b"ext", back=back))


def _account_pseudonym(value: str, key: bytes, back: bool) -> str:
    flat = "".join(c for c in value if c.isalnum())
    if flat[:2].isalpha():  # country stays, the account is permuted, and the check digits are set anew
        body = permute_text(flat[4:], key, b"iban", back=back)
        new = flat[:2] + f"{98 - iban_remainder(flat[:2] + '00' + body):02d}" + body
    else:
        head = flat[:6] + permute_text(flat[6:-1], key, b"card", back=back)
        new = head + str(luhn_digit([int(c) for c in head]))
    new_chars = iter(new)
    return "".join(next(new_chars) if c.isalnum() else c for c in value)


def pseudonym(kind: str, value: str, key: bytes, *, back: bool = False) -> str:
    """The pseudonym of a value, in its canonical writing; with back the value of a pseudonym."""
    value = canonical(kind, value)
    special = {"id_number": _id_pseudonym, "birth_date": _date_pseudonym, "phone": _phone_pseudonym, "account_number": _account_pseudonym}.get(kind)
    return special(value, key, back) if special else permute_text(value, key, kind.encode()[:12], back=back)


def replace_pii(text: str | None, key: bytes) -> str | None:
    """The text with each item replaced by [KIND:pseudonym]."""
    if not text:
        return text
    out, at = [], 0
    for a, b, kind in find_pii(text):
        out += [text[at:a], f"[{kind.upper()}:{pseudonym(kind, text[a:b], key)}]"]
        at = b
    return "".join([*out, text[at:]])


def _key(secret: str) -> bytes:
    return hmac.new(b"meshwright pii", secret.encode(), hashlib.sha256).digest()


def pii_items(documents: DataFrame, secret: str) -> DataFrame:
    """Each item with its place: doc_id, pii_kind, char_start (from 1), char_end (inclusive) and pseudonym."""
    key = _key(secret)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(i, kind, a + 1, b, pseudonym(kind, text[a:b], key)) for i, text in zip(*(c.to_pylist() for c in batch.columns), strict=True) for a, b, kind in find_pii(text)]
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 5
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["doc_id", "pii_kind", "char_start", "char_end", "pseudonym"])

    return documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(run, "doc_id bigint, pii_kind string, char_start bigint, char_end bigint, pseudonym string")


def pii_replaced(documents: DataFrame, secret: str) -> DataFrame:
    """doc_id, text with placeholders."""
    key = _key(secret)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = pa.array([replace_pii(t, key) for t in batch.column("text").to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), texts], ["doc_id", "text"])

    return documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(run, "doc_id bigint, text string")
