"""Personal information in free text: detection, typed placeholders, and keyed surrogates.

Detection is one scan of each text in Arrow batches (no shuffle).  Numbers are
found by the grammar of their format, by check digits where a format has them,
by a label in front of them, or as a field of a record beside another mention.
Persons are a known given name or an initial together with a known family name,
or two names after a title or an introduction.

Surrogates replace a mention by one of the same kind, script and format.  They
belong to the entity behind the mention, not to its spelling: case, order of the
names, initials, blanks, abbreviations and disguises are taken off first, and a
person's names have surrogates of their own, so that all spellings of a person,
an address or a number lead to the same one (coreference).  Names keep gender and
script; an initial becomes the initial of the surrogate.  A collision check
gives a new salt to every entity whose surrogate is taken or is itself found in
the data (distinctness); salts make the surrogate longer in the end, so that there
is always a free one.

Scale: surrogates are a function of (key, entity, salt), so only the entities
with a salt above 0 need a table.  It goes to the workers while it is small (a
checked bound), and texts are rewritten in one scan; beyond the bound it is joined
to the mentions.
"""

from __future__ import annotations

import hashlib
import random
import re
import unicodedata
from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from anamnesis.session import cut, ship_package

KINDS = ("email", "phone", "id_number", "address", "person")
#: Most names that the name lists may hold; the lists are sent to every worker.
MAX_NAMES = 100_000
#: Most salted entities that are sent to every worker; more are joined.
MAX_SALTS = 100_000

# Email addresses

_LOCAL = r"[A-Za-z0-9](?:[A-Za-z0-9._+\-]*[A-Za-z0-9])?"
_LABEL = r"[A-Za-z0-9](?:[A-Za-z0-9\-]*[A-Za-z0-9])?"
_AT = r"(?:[@＠]|%40| [@＠] | ?\(at\) ?| ?\[at\] ?| ?\{at\} ?)"
_DOT = r"(?:\.| ?\[dot\] ?| ?\(dot\) ?| ?\{dot\} ?| dot )"
_TOP = r"(?:example|invalid|test|com|net|org|edu|gov|io|de|cn|uk|fr|es|it|nl|ch|at|eu|info)"
_END = r"(?![A-Za-z0-9])(?!:[\w/~])"
EMAIL = re.compile(rf"(?<![A-Za-z0-9._+\-/])(?:{_LOCAL}(?:{_AT}{_LABEL}(?:{_DOT}{_LABEL})*{_DOT}[A-Za-z]{{2,}}| at {_LABEL}(?:{_DOT}{_LABEL})*{_DOT}{_TOP})|{_LABEL}(?: dot {_LABEL})+ at {_LABEL}(?: dot {_LABEL})* dot {_TOP}){_END}", re.I)
EMAIL_SIGNS = ("@", "＠", "%40", "(at)", "[at]", "{at}", " at ")
_AT_SIGN = re.compile(rf"{_AT}| at ", re.I)
_DOT_SIGN = re.compile(_DOT, re.I)

# Numbers

_RUN = re.compile(r"[0-9][0-9 ().\-/]{5,}")
_OVER = r"(?![0-9A-Za-z_])(?!-[0-9A-Za-z])(?!\.\d)"
_PHONES = re.compile(
    rf"""(?:
      \+[ ]?1[ .\-]?\(?\d{{3}}\)?[ .\-]?\d{{3}}[ .\-]?\d{{4}}
    | (?:\+|00)44[ ]?(?:\(0\)[ ]?)?\d{{2,4}}[ ]\d{{3,4}}[ ]\d{{3,4}}
    | (?:\+|00)\d{{2}}[ ](?:\(0\)[ ]?)?\d{{1,5}}[ ]?[/\-][ ]?\d{{3,8}}(?:-\d{{1,5}})?
    | (?:\+|00)\d{{1,3}}(?:[ .\-]\d{{1,5}}){{2,5}}
    | \+\d{{9,14}}
    | \(0?\d{{1,4}}\)[ ]?\d{{3,4}}[ \-]\d{{3,4}}
    | 1-\d{{3}}-\d{{3}}-\d{{4}} | \d{{3}}-\d{{3}}-\d{{4}} | \d{{3}}\.\d{{3}}\.\d{{4}}
    | 0\d{{4}}[ ]\d{{6}} | 0\d{{3}}[ ]\d{{3}}[ ]\d{{3}} | 0\d{{2}}[ ]\d{{4,5}}[ ]\d{{3,4}} | 0\d{{1,4}}[ ]?/[ ]?\d{{5,8}}(?:-\d{{1,4}})?
    | 0\d(?:\.\d{{2}}){{4}} | 0\d(?:[ ]\d{{2}}){{4}}
    | 1[3-9]\d{{9}} | 1[3-9]\d[ \-]\d{{4}}[ \-]\d{{4}}
    )(?:[ ]?(?:ext\.?|x)[ ]?\d{{1,5}})?{_OVER}""",
    re.X | re.I,
)
_DATE = re.compile(r"\d{4}-\d{2}-\d{2}")
_CITIZEN = r"\d{6}(?:19|20)\d{2}(?:0[1-9]|1[0-2])(?:0[1-9]|[12]\d|3[01])\d{3}[\dX]"
_IDS = re.compile(rf"(?:\d{{3}}-\d{{2}}-\d{{4}}|\d{{3}} \d{{2}} \d{{4}}|{_CITIZEN}|\d{{3}}\.\d{{3}}\.\d{{3}}-\d{{2}}|756\.\d{{4}}\.\d{{4}}\.\d{{2}}|\d{{8}}-?[A-Z]|[12] ?\d{{2}} ?\d{{2}} ?\d{{2}} ?\d{{3}} ?\d{{3}} ?\d{{2}}){_OVER}", re.I)
_NINE = re.compile(rf"\d{{9}}{_OVER}")
_NOT_PERSONAL = re.compile(r"(?:订单号?|单号|(?<![a-z])(?:order|ticket|commit|epoch|version|request|build|sku|invoice|item|row|case|parcel|tracking|batch)s?)(?: no\.?| number| id)?\s*[:：#=]*\s*", re.I)
_LETTER_IDS = re.compile(r"(?<![0-9A-Za-z_\-])(?:[A-Z]{2}[ \-]?\d{2}[ \-]?\d{2}[ \-]?\d{2}[ \-]?[A-D]|(?-i:[A-Z]{2})\d{7}|[XYZ]\d{7}-?[A-Z]|[A-Z]\d{4}-\d{4}-[A-Z])(?![0-9A-Za-z_])(?!-[0-9A-Za-z])", re.I)
_LETTER_SIGN = re.compile(r"[a-z][ \-]?\d{2}[ \-]?\d{2}|\d{4}-\d{4}-[a-z]", re.I)
#: Words that name an identity number in the languages of the texts.
_ID_LABELS = (
    r"ssn|social[ _]security|social[ _]insurance|national[ _](?:insurance|identity|id)|passport|taxpayer|tax|citizen|identity|identification|nino|tin|nhs|"
    r"dni|nie|nif|nir|pasaporte|passeport|codice fiscale|steuer-?(?:id|nummer|identifikationsnummer)|personalausweis|reisepass|ausweis|身份证|护照|证件|税号|社保"
)
_ID_MARK = r"(?:[ _\-]*(?:id|i\.d\.|no\.?|nr\.?|nº|number|nummer|num|n[uú]mero|card|号码?|号))"
_LABELLED_ID = re.compile(rf"(?:(?<![A-Za-z])(?:(?:{_ID_LABELS}){_ID_MARK}*|(?:my|your|his|her|their|the) id{_ID_MARK}*|id{_ID_MARK}+))\"?\s*(?:,?\s*(?:which )?(?:is|was|ist|es|est)\b|[:：=#]+|=>|->)?[ \"]*(?=\w)", re.I)
_LABEL_SIGNS = ("ssn", "social", "national", "passport", "passeport", "pasaporte", "tax", "citizen", "identi", "nino", "tin", "nhs", "dni", "nie", "nif", "nir", "fiscale", "steuer", "ausweis", "身份", "护照", "证件", "税号", "社保", " id")
_ID_TOKEN = re.compile(rf"(?:(?-i:[A-Z]{{1,3}})[ \-]?)?\d[0-9A-Z]*(?:[ \-./][0-9A-Z]*\d[0-9A-Z]*)*(?:[ \-]?(?-i:[A-Z]))?{_OVER}", re.I)
_LABELLED_PHONE = re.compile(r"(?<![A-Za-z])(?:tel(?:ephone|efon|[eé]fono)?|phone|mobile|cell|fax|handy|hotline|whatsapp|电话|手机|联系电话)\.?(?: (?:no\.?|number|nr\.?))?\"?\s*(?:,?\s*(?:which )?(?:is|ist|es)\b|[:：=]+)?[ \"]*(?=[+(\d])", re.I)
_PHONE_SIGNS = ("tel", "phone", "mobile", "cell", "fax", "handy", "hotline", "whatsapp", "电话", "手机")
_PHONE_TOKEN = re.compile(rf"[+(]?\d[\d ()./\-]{{5,18}}\d{_OVER}")

# Addresses

#: Words that end a street's name.
_STREETS = r"(?:Street|St|Avenue|Ave|Road|Rd|Lane|Ln|Close|Boulevard|Blvd|Terrace|Drive|Dr|Court|Ct|Place|Pl|Square|Sq|Crescent|Way|Row|Highway|Parkway)"
_NAME = r"[A-Za-zÀ-ɏ'’\-]+"
_UPPER = r"(?-i:[A-ZÀ-Þ])[A-Za-zÀ-ɏ'’\-]+"
_NUMBERED = re.compile(rf"(?<![\w.\-/])\d{{1,5}}[a-z]?(?: (?:[NSEW]\.? )?(?:{_NAME} ){{1,2}}?{_STREETS}\b\.?|(?: bis| ter)?,? (?:rue (?:(?:de|du|des|la|le|l['’]|d['’]) ?)*{_NAME}|(?:avenue|boulevard|place|quai|chemin|all[ée]e|impasse) (?:(?:de|du|des|la|le) |l['’]|d['’])*{_UPPER}))", re.I)
_LETTERED = re.compile(
    rf"(?<![A-Za-zÀ-ɏ])(?:{_NAME}(?:str\.|straße|strasse)|(?-i:[A-ZÄÖÜ][a-zäöüß\-]{{2,}}(?:weg|platz|allee|gasse|damm|chaussee|promenade))|Calle (?:(?:de|del|la|las|los) )*{_NAME}|(?-i:Avenida|Avda\.|Plaza|Paseo|Camino|Via|Viale|Piazza|Rua|Praça) (?:(?:de|del|la|las|los|da|do|das|dos|dei|della) )*{_UPPER}(?: {_UPPER})?),? ?\d{{1,5}}[a-z]?(?![\w])",
    re.I,
)
_LETTERED_SIGNS = ("str", "weg ", "platz ", "allee ", "gasse ", "damm ", "chaussee ", "promenade ", "calle ", "avenida ", "avda", "plaza ", "paseo ", "camino ", "via ", "viale ", "piazza ", "rua ", "praça ")
_HAN = re.compile(r"([一-鿿]+?(?:路|大街|街|大道|巷|胡同|弄))(?:[东西南北中]段)? ?\d{1,5} ?[号弄](?: ?\d{1,4} ?(?:单元|室|栋|楼|号))*")
#: Characters that end what stands before a Chinese street name.
_HAN_BEFORE = re.compile(r".*[在到于至往去从了住址寄送是为来给叫搬往]", re.S)
_FOLLOWING = re.compile(r",\s{1,2}[A-ZÄÖÜÀ-Þ][a-zà-ɏ]+(?=[.,;!?\n\"]|$)")

# Names

_WORD_BACK = re.compile(r"[A-Za-zÀ-ɏ]")
_WORD = re.compile(r"[A-Za-zÀ-ɏ]+")
_NAME_AFTER = re.compile(r"(,?)\s+(?:([A-Za-zÀ-ɏ]+(?:-[A-Za-zÀ-ɏ]+)?)(?![A-Za-zÀ-ɏ0-9_@\-])(\s+[A-Z]\.(?![A-Za-zÀ-ɏ0-9_@]))?|([A-Z]\.)(?![A-Za-zÀ-ɏ0-9_@]))", re.I)
#: Titles and introductions after which two capitalised words are a person.
_INTRODUCED = re.compile(r"(?:(?<![A-Za-z])(?:Mr|Mrs|Ms|Dr|Prof|Herr|Frau|Sra|Señora?|Mme|Mlle|Monsieur|Madame)\.? |(?<![A-Za-z])(?:[Mm]y name is|[Mm]ein Name ist|[Jj]e m['’]appelle|[Mm]e llamo) )((?:[A-ZÀ-Þ][a-zà-ɏ]+|[A-Z]\.)(?:-[A-ZÀ-Þ][a-zà-ɏ]+)? (?:[A-Z]\. )?[A-ZÀ-Þ][a-zà-ɏ]+(?:-[A-ZÀ-Þ][a-zà-ɏ]+)?)(?![A-Za-zÀ-ɏ])")

_INTRODUCED_SIGNS = ("Mr", "Ms", "Dr", "Prof", "Herr ", "Frau ", "Sra", "Señor", "Mme", "Mlle", "Monsieur", "Madame", "y name is ", "ein Name ist ", "e m'appelle ", "e m’appelle ", "e llamo ")


def _letter(c: str) -> bool:
    return c == "_" or c.isdigit() or (c.isalpha() and ord(c) < 0x2E80)


def _digits(text: str) -> str:
    return "".join(c for c in text if c.isdigit())


_DNI_LETTERS = "TRWAGMYFPDXBNJZSQVHLCKE"


def valid_number(text: str) -> bool:
    """Whether a number in a format with check digits fits them; formats without any are valid."""
    d = _digits(text)
    if m := re.fullmatch(r"([XYZxyz]?)(\d{7,8})-?([A-Za-z])", text):
        return len(m[1] + m[2]) == 8 and _DNI_LETTERS[int((str("XYZ".index(m[1].upper())) if m[1] else "") + m[2]) % 23] == m[3].upper()
    if re.fullmatch(r"\d{3}\.\d{3}\.\d{3}-\d{2}", text):
        for n in (9, 10):
            if int(d[n]) != sum(int(x) * (n + 1 - i) for i, x in enumerate(d[:n])) * 10 % 11 % 10:
                return False
        return True
    if d.startswith("756") and "." in text:
        return (10 - sum(int(x) * (3 if i % 2 else 1) for i, x in enumerate(d[:12])) % 10) % 10 == int(d[12])
    if len(d) == 15 and d[0] in "12":
        return 97 - int(d[:13]) % 97 == int(d[13:])
    return True


class Detector:
    """Finds the mentions in one text; built once per worker from the name lists."""

    def __init__(self, given: list[str], family: list[str], cities: list[str] = ()):
        import ahocorasick

        known = "|".join(sorted(map(re.escape, cities), key=len, reverse=True)) or "(?!)"
        self.city = re.compile(rf", Apt \w+|,\s{{1,2}}(?:\d{{5}} (?:{known}|[A-Z][a-zÀ-ɏ]+)|(?:{known}|[A-Z][a-zÀ-ɏ]+(?= \d{{5}}))(?: \d{{5}})?)(?![A-Za-z0-9])", re.I)
        self.given, self.family = {g.lower() for g in given}, {f.lower() for f in family}
        self.families = None
        if given and family:
            self.families = ahocorasick.Automaton()
            for name in self.family:
                self.families.add_word(name, len(name))
            self.families.make_automaton()

    def find(self, text: str) -> list[tuple[str, int, int]]:
        """(kind, start, end) of the mentions, in order, without overlaps."""
        return [m[:3] for m in self.mentions(text)]

    def mentions(self, text: str) -> list[tuple[str, int, int, tuple]]:
        """(kind, start, end, parts) of the mentions; the parts of a person are (role, start, end) of its names."""
        starts: list[int] = []
        taken: list[tuple[int, int, str, tuple]] = []

        def add(kind: str, lo: int, hi: int, parts: tuple = ()) -> bool:
            at = bisect_left(starts, hi)
            if at and taken[at - 1][1] > lo:
                return False
            while lo < hi and not text[lo].isalnum():
                lo += 1
            starts.insert(at, lo)
            taken.insert(at, (lo, hi, kind, parts))
            return True

        low = text.lower()
        if any(s in low for s in EMAIL_SIGNS):
            for m in EMAIL.finditer(text):
                add("email", m.start(), m.end())
        runs = [(m.start(), m.end()) for m in _RUN.finditer(text)]
        nines: list[tuple[int, int]] = []
        if runs or _LETTER_SIGN.search(text):
            impersonal: set[int] | None = None

            def personal(at: int) -> bool:
                nonlocal impersonal
                if impersonal is None:
                    impersonal = {m.end() for m in _NOT_PERSONAL.finditer(text)}
                return at not in impersonal

            for lo, hi in runs:
                self._numbers(text, lo, hi, personal, nines, add)
            for m in _LETTER_IDS.finditer(text):
                if valid_number(m.group()) and personal(m.start()):
                    add("id_number", m.start(), m.end())
            if any(s in low for s in _LABEL_SIGNS):
                for label in _LABELLED_ID.finditer(text):
                    if (m := _ID_TOKEN.match(text, label.end())) and 5 <= len(_digits(m.group())) and 6 <= len(m.group()) <= 24 and not _DATE.fullmatch(m.group()):
                        add("id_number", m.start(), m.end())
            if runs and any(s in low for s in _PHONE_SIGNS):
                for label in _LABELLED_PHONE.finditer(text):
                    if (m := _PHONE_TOKEN.match(text, label.end())) and 7 <= len(_digits(m.group())) <= 15 and not _DATE.match(m.group()):
                        add("phone", m.start(), m.end())
        for m in _NUMBERED.finditer(text):
            add("address", m.start(), self._city(text, m.end()))
        if any(s in low for s in _LETTERED_SIGNS):
            for m in _LETTERED.finditer(text):
                end = self._city(text, m.end())
                if end == m.end() and (f := _FOLLOWING.match(text, end)):
                    end = f.end()
                add("address", m.start(), end)
        if "号" in text or "弄" in text:
            for m in _HAN.finditer(text):
                lo = m.start()
                if before := _HAN_BEFORE.match(m[1][:-1]):
                    # A street has two characters at least, the word for street left out.
                    lo += max(0, min(before.end(), len(m[1]) - (4 if m[1].endswith(("大道", "大街", "胡同")) else 3)))
                add("address", lo, m.end())
        if self.families is not None:
            same = low if len(low) == len(text) else "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
            for last, n in self.families.iter(same):
                for found in self._persons(text, same, last + 1 - n, last + 1):
                    if add("person", *found):
                        break
        for m in _INTRODUCED.finditer(text) if any(s in text for s in _INTRODUCED_SIGNS) else ():
            lo, (first, *_, family) = m.start(1), m[1].split(" ")
            add("person", lo, m.end(1), (("initial" if first.endswith(".") else "given", lo, lo + len(first)), ("family", m.end(1) - len(family), m.end(1))))
        for lo, hi in nines:
            # Nine bare digits are a number of a person as a field beside another mention.
            at = bisect_left(starts, lo)
            if at and re.fullmatch(r"\s*[;|,\t]\s*", text[taken[at - 1][1] : lo][:8]) or at < len(starts) and re.fullmatch(r"\s*[;|,\t]\s*[+(]{0,2}", text[hi : starts[at]][:8]):
                add("id_number", lo, hi)
        return [(kind, lo, hi, parts) for lo, hi, kind, parts in taken]

    def _city(self, text: str, end: int) -> int:
        """End of an address with the flat or the city that follows it, if one does."""
        m = self.city.match(text, end)
        return m.end() if m else end

    @staticmethod
    def _numbers(text: str, lo: int, hi: int, personal, nines: list[tuple[int, int]], add) -> None:
        at = lo
        while at < hi:
            if not text[at].isdigit() or (at > lo and text[at - 1].isdigit()):
                at += 1
                continue
            start = at
            while start > 0 and text[start - 1] in "+(" and at - start < 2:
                start -= 1
            prev = text[start - 1] if start else " "
            step = at + 1
            if not _letter(prev) and prev not in "-.#/" or (prev in "-./" and start > 1 and not _letter(text[start - 2]) and text[start - 2] not in "-./"):
                if (m := _IDS.match(text, at)) and valid_number(m.group()) and personal(start):
                    if add("id_number", m.start(), m.end()):
                        step = m.end()
                elif not _DATE.match(text, at) and (m := _PHONES.match(text, start) or _PHONES.match(text, at)) and personal(start):
                    if add("phone", m.start(), m.end()):
                        step = m.end()
                elif (m := _NINE.match(text, at)) and personal(start):
                    nines.append((m.start(), m.end()))
                    step = m.end()
            at = step

    def _known(self, name: str) -> bool:
        return name in self.given or "-" in name and all(n in self.given for n in name.split("-"))

    def _persons(self, text: str, same: str, lo: int, hi: int) -> Iterator[tuple[int, int, tuple]]:
        """(start, end, parts) of the person whose family name stands at lo..hi: names before it first, then after it."""
        if (lo and _letter(text[lo - 1])) or (hi < len(text) and _letter(text[hi])):
            return
        if "一" <= text[lo] <= "鿿":
            own = hi + text[hi : hi + 1].isspace()
            for n in (2, 1):
                if same[own : own + n] in self.given and len(same[own : own + n]) == n:
                    yield lo, own + n, (("family", lo, hi), ("given", own, own + n))
        if hi < len(text) and text[hi] == "-" and (m := _WORD.match(text, hi + 1)) and same[hi + 1 : m.end()] in self.family:
            hi = m.end()
        first, last = lo, hi
        if lo > 1 and text[lo - 1] == "-" and (b := self._word_before(text, lo - 1)) is not None and same[b : lo - 1] in self.family:
            first = b
        # The given name, or its initial, and perhaps a middle initial stand before.
        at = self._blank_before(text, first)
        if at < first:
            for middle in (True, False):
                end = at
                if middle:
                    if not (end > 2 and text[end - 1] == "." and text[end - 2].isascii() and text[end - 2].isalpha() and not _letter(text[end - 3])):
                        continue
                    end = self._blank_before(text, end - 2)
                b = self._word_before(text, end)
                if b is not None and self._known(same[b:end]):
                    yield b, hi, (("given", b, end), ("family", first, last))
                if end > 1 and text[end - 1] == "." and text[end - 2].isascii() and text[end - 2].isalpha() and (end == 2 or not _letter(text[end - 3])):
                    yield end - 2, hi, (("initial", end - 2, end), ("family", first, last))
        # Or they come after it.
        m = _NAME_AFTER.match(text, last)
        if m and m[2] and self._known(same[m.start(2) : m.end(2)]):
            yield lo, m.end(), (("family", lo, last), ("given", m.start(2), m.end(2)))
        if m and m[4] and m[1]:
            yield lo, m.end(), (("family", lo, last), ("initial", m.start(4), m.end(4)))

    @staticmethod
    def _blank_before(text: str, at: int) -> int:
        while at and text[at - 1].isspace():
            at -= 1
        return at

    @staticmethod
    def _word_before(text: str, end: int) -> int | None:
        """Start of the word (letters, single hyphens inside) that ends here; None if there is none."""
        at = end
        while at and (_WORD_BACK.match(text[at - 1]) or text[at - 1] == "-" and at > 1 and at < end and _WORD_BACK.match(text[at - 2])):
            at -= 1
        return at if at < end and not (at and _letter(text[at - 1])) else None


def name_lists(entities: DataFrame) -> tuple[list[str], list[str], list[str]]:
    """Given names, family names and cities of the entity list (bounded by MAX_NAMES, which is checked)."""
    rows = entities.where("entity_type IN ('person', 'city') AND entity_name IS NOT NULL").select("entity_type", "entity_name").distinct().limit(MAX_NAMES + 1).collect()
    if len(rows) > MAX_NAMES:
        raise ValueError(f"more than {MAX_NAMES} names in the entity list")
    given, family, cities = set(), set(), set()
    for r in rows:
        name = r.entity_name.strip()
        if r.entity_type == "city":
            cities.add(name)
        elif "," in name:
            f, _, g = name.partition(",")
            given.add(g.strip()), family.add(f.strip())
        elif len(parts := name.split()) >= 2:
            han = "一" <= name[0] <= "鿿"
            given.add(parts[-1 if han else 0]), family.add(parts[0 if han else -1])
        elif 2 <= len(name) <= 4 and all("一" <= c <= "鿿" for c in name):
            cut_at = 2 if len(name) == 4 else 1
            given.add(name[cut_at:]), family.add(name[:cut_at])
    return sorted(given - {""}), sorted(family - {""}), sorted(cities - {""})


_DETECTORS: dict[tuple, Detector] = {}


def _detector(names: tuple) -> Detector:
    if names not in _DETECTORS:
        _DETECTORS[names] = Detector(*names)
    return _DETECTORS[names]


def _sent_names(entities: DataFrame):
    return entities.sparkSession.sparkContext.broadcast(tuple(tuple(x) for x in name_lists(entities)))


def _scan(names):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = _detector(names.value).mentions
        for batch in batches:
            rows: list[tuple] = []
            for tbl, no, text in zip(*(batch.column(i).to_pylist() for i in range(3))):
                if text:
                    rows += [(tbl, no, kind, lo + 1, hi, text[lo:hi]) for kind, lo, hi, _ in find(text)]
            cols = list(zip(*rows)) if rows else [[]] * 6
            types = [pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], ["tbl", "ingest_no", "kind", "start_pos", "end_pos", "mention"])

    return run


def texts_of(messages: DataFrame, notes: DataFrame) -> DataFrame:
    """tbl, ingest_no, content of both tables."""
    pick = lambda df, name: df.select(F.lit(name).alias("tbl"), F.col("ingest_no").cast("bigint").alias("ingest_no"), "content")
    return pick(messages, "messages").unionByName(pick(notes, "notes"))


def find_mentions(texts: DataFrame, entities: DataFrame) -> DataFrame:
    """tbl, ingest_no, kind, start_pos, end_pos, mention of every mention in every row.

    Defined cases: null and empty contents have no mentions; repeated rows are
    all reported; positions count code points from 1, end_pos is the last one;
    without person names in the entity list only introduced persons are found;
    empty tables give no rows; further columns are ignored.
    """
    ship_package(texts.sparkSession)
    return texts.select("tbl", "ingest_no", "content").where("content IS NOT NULL").mapInArrow(_scan(_sent_names(entities)), "tbl string, ingest_no bigint, kind string, start_pos bigint, end_pos bigint, mention string")


# Entities behind mentions

_ABBREVIATED = {"st": "street", "ave": "avenue", "rd": "road", "ln": "lane", "blvd": "boulevard", "dr": "drive", "ct": "court", "pl": "place", "sq": "square"}
_FIXED_WORDS = re.compile(rf"{_STREETS}|str|straße|strasse|rue|calle|avenida|avda|plaza|paseo|camino|via|viale|piazza|rua|praça|quai|chemin|impasse|all[ée]e|apt|bis|ter|de|du|des|del|la|le|las|los|da|do|dei|della|[nsew]", re.I)
_WITH_TYPE = re.compile(r"(.+?)(straße|strasse|str|weg|platz|allee|gasse|damm|chaussee|promenade|路|大街|街|大道|巷|胡同|弄)", re.I)


def _phone_digits(text: str) -> tuple[str, str]:
    """(country code or nothing, the other digits): 00 counts as +, a (0) after the country code doesn't count."""
    bare = re.sub(r"\(0\)", "", text)
    bare, _, ext = re.sub(r"(?:ext\.?|x)", "x", bare, flags=re.I).partition("x")
    d = _digits(bare)
    if text.lstrip("( ").startswith("+") or not text[:1] == "+" and re.match(r"\(?00[1-9]", text):
        d = d[2:] if re.match(r"\(?00", text) else d
        code = "1" if d[:1] == "1" else d[:2]
        return code, d[len(code) :] + _digits(ext)
    # A country code without its + (positions start at the first digit).
    m = re.match(r"(\d{1,3}) ?\(0\)|(\d{2})(?: \d+){3,}|(1)[ \-.]\d{3}[ \-.]", text)
    code = next((g for g in m.groups() if g), "") if m else ""
    return code, d[len(code) :] + _digits(ext)


def entity_of(kind: str, text: str, parts: tuple = (), lo: int = 0) -> list[tuple[str, str]]:
    """(kind, normalised name) of the entities a mention stands for; a person gives its family and its given name."""
    if kind == "person":
        names = {role: text[a - lo : b - lo].lower() for role, a, b in parts}
        out = [("family", names["family"])]
        return out + [("given", f"{names['family']}\0{names['given']}")] if "given" in names else out
    if kind == "email":
        at = _AT_SIGN.search(text)
        return [("email", ".".join(_DOT_SIGN.split(text[: at.start()])).lower() + "@" + ".".join(_DOT_SIGN.split(text[at.end() :])).lower())]
    if kind == "phone":
        code, rest = _phone_digits(text)
        return [("phone", f"+{code} {rest}" if code else rest)]
    if kind == "id_number":
        return [("id_number", "".join(c for c in text if c.isalnum()).upper())]
    words = [_ABBREVIATED.get(w, w) for w in re.findall(r"[^\W_]+", text.lower())]
    return [("address", " ".join(re.sub(r"(?:strasse|str)$", "straße", w) if len(w) > 3 else w for w in words))]


# Surrogates

_VOWELS, _CONSONANTS = "aeiou", "bdfgklmnprstvz"
#: Endings of made-up names by gender, and of family names.
_FEMALE = ("a", "ia", "elle", "ine", "ena", "ita", "ara", "ette")
_MALE = ("o", "an", "en", "or", "us", "ik", "ard", "in")
_FAMILY = ("er", "man", "sen", "berg", "ton", "ley", "ford", "well", "stad", "ov")
#: Frequent Chinese family names, and characters of given names by gender.
_HAN_FAMILY = "王李张刘陈杨赵黄周吴徐孙胡朱高林何郭马罗梁宋郑谢韩唐冯于董萧程曹袁邓许傅沈曾彭吕苏卢蒋蔡贾丁魏薛叶阎余潘杜戴夏钟汪田任姜范方石姚谭廖邹熊金陆郝孔白崔康毛邱秦江史顾侯邵孟龙万段雷钱汤尹黎易常武乔贺赖龚文"
_HAN_FEMALE = "芳丽敏静娟艳霞燕玲桂秀英华慧巧美娜淑惠珠翠雅芝玉萍红娥芬彩春菊兰凤洁梅琳素云莲真环雪荣爱妹香月莺媛瑞凡佳嘉琼勤珍贞莉"
_HAN_MALE = "伟刚勇毅俊峰强军平保东文辉力明永健世广志义兴良海山仁波宁贵福生龙元全国胜学祥才发武新利清飞彬富顺信子杰涛昌成康星光天达安岩中茂进林有坚和彪博诚先敬震振壮"
#: Male given names that end like female ones, and the other way round.
_MALE_NAMES = frozenset("luca andrea joshua noah elia ezra nikita sasha ilya mischa jona".split())
_FEMALE_NAMES = frozenset("carmen ruth karen ingrid astrid ellen susan kathleen karin iris doris ines agnes margaret elizabeth judith miriam helen jane anne marie sophie zoe chloe irene".split())
#: Salt from which surrogates grow, so that a free one is always found.
GROWING = 6


def _random(key: str, *parts) -> random.Random:
    return random.Random(hashlib.blake2b("\0".join(map(str, parts)).encode(), key=key.encode()[:64], digest_size=16).digest())


def female(name: str) -> bool:
    """Gender of a given name by its ending, with the exceptions listed."""
    name = name.split("-")[0].lower()
    if "一" <= name[:1] <= "鿿":
        return any(c in _HAN_FEMALE for c in name) and not any(c in _HAN_MALE for c in name)
    return name in _FEMALE_NAMES or name.endswith(("a", "ia", "elle", "ine", "ette", "ie", "lyn", "wen")) and name not in _MALE_NAMES


def _syllables(r: random.Random, n: int, first: str = "") -> str:
    out = first
    for _ in range(n):
        out += (r.choice(_VOWELS) + r.choice(_CONSONANTS)) if out and out[-1] not in _VOWELS else (r.choice(_CONSONANTS) + r.choice(_VOWELS))
    return out


def _initial(key: str, family: str, letter: str) -> str:
    """The letter that stands for an initial beside a family name: a keyed permutation without fixed letters."""
    letter = unicodedata.normalize("NFD", letter.lower())[0]
    abc = "abcdefghijklmnopqrstuvwxyz"
    if letter not in abc:
        return _random(key, "initial", family, letter).choice(abc)
    order = list(abc)
    _random(key, "initial", family).shuffle(order)
    return order[(order.index(letter) + 1) % 26]


def surrogate(kind: str, entity: str, key: str, salt: int = 0) -> str:
    """The keyed replacement of a normalised entity; differs from the entity in every part that tells something."""
    r = _random(key, kind, entity, salt)
    more = max(0, salt - GROWING + 1)
    if kind == "family":
        if "一" <= entity[:1] <= "鿿":
            return "".join(r.sample(_HAN_FAMILY, 1 if salt < GROWING else 1 + more))
        made = "-".join(_syllables(r, 2 + more, r.choice(_CONSONANTS)) + r.choice(_FAMILY) for _ in entity.split("-"))
        return made
    if kind == "given":
        family, _, name = entity.partition("\0")
        if "一" <= name[:1] <= "鿿":
            return "".join(r.choice(_HAN_FEMALE if female(name) else _HAN_MALE) for _ in range(len(name) + more))
        made = []
        for i, part in enumerate(name.split("-")):
            first = _initial(key, family, part[0]) if not i else r.choice(_CONSONANTS)
            stem = _syllables(r, 1 + more, first)
            made.append((stem + r.choice(_CONSONANTS) if stem[-1] in _VOWELS else stem) + r.choice(_FEMALE if female(part) else _MALE))
        return "-".join(made)
    if kind == "email":
        local, _, domain = entity.partition("@")
        *labels, top = domain.split(".")
        words = re.split(r"([^a-z0-9]+)", local)
        made = "".join(w if i % 2 else _like(r, w, more) for i, w in enumerate(words))
        return made + "@" + ".".join([_syllables(_random(key, "domain", label), 3) for label in labels] + [top if top in ("example", "invalid", "test") else "example"])
    if kind == "phone":
        code, _, rest = entity.rpartition(" ")
        lead = "0" if rest.startswith("0") else ""
        made = lead + "".join(str(r.randrange(1 if i == 0 and not lead else 0, 10)) for i in range(len(rest) - len(lead) + more))
        return f"{code} {made}" if code else made
    if kind == "id_number":
        return _id_like(r, entity, more)
    return " ".join(w if _FIXED_WORDS.fullmatch(w) else _address_word(key, entity, w, salt) for w in entity.split(" "))


def _like(r: random.Random, word: str, more: int = 0) -> str:
    """Letters for letters and digits for digits."""
    if word.isdigit():
        return "".join(str(r.randrange(10)) for _ in range(len(word) + more))
    return _syllables(r, max(2, (len(word) + 1) // 2) + more)


def _id_like(r: random.Random, entity: str, more: int) -> str:
    """A number of the same letters and digits; dates stay dates and check digits fit."""
    if re.fullmatch(_CITIZEN, entity, re.I) and not more:
        body = f"{r.randrange(11, 66)}{r.randrange(10**4):04}{r.randrange(1950, 2006)}{r.randrange(1, 13):02}{r.randrange(1, 29):02}{r.randrange(1000):03}"
        return body + "10X98765432"[sum(int(c) * pow(2, 17 - i, 11) for i, c in enumerate(body)) % 11]
    if re.fullmatch(r"\d{8}[A-Z]", entity) and not more:
        body = f"{r.randrange(10**8):08}"
        return body + _DNI_LETTERS[int(body) % 23]
    if re.fullmatch(r"\d{9}", entity) and not more:
        return f"{r.choice([n for n in range(1, 900) if n != 666]):03}{r.randrange(1, 100):02}{r.randrange(1, 10**4):04}"
    return "".join(str(r.randrange(10)) if c.isdigit() else r.choice("ABCDEFGHJKLMNPRSTUVWXYZ") for c in entity) + "".join(str(r.randrange(10)) for _ in range(2 * more))


def _address_word(key: str, entity: str, word: str, salt: int) -> str:
    r = _random(key, "address", entity, word, salt)
    more = max(0, salt - GROWING + 1)
    if word.isdigit():
        return "".join(str(r.randrange(1 if i == 0 else 0, 10)) for i in range(len(word) + more))
    if m := re.fullmatch(r"(\d+)(\D+)", word):
        return str(r.randrange(1, 10 ** len(m[1]))) + (m[2] if len(m[2]) > 1 else r.choice("abcdef"))
    if "一" <= word[0] <= "鿿":
        out = re.sub(r"\d+", lambda d: str(r.randrange(1, 10 ** len(d[0]))), word)
        m = re.match(r"([一-鿿]+?)(路|大街|街|大道|巷|胡同|弄|单元|室|栋|楼|号|$)", out)
        return "".join(r.sample(_HAN_MALE + _HAN_FEMALE, len(m[1]) + more)) + out[m.end(1) :] if m and m[1] else out
    m = _WITH_TYPE.fullmatch(word)
    return _syllables(r, 2 + more, r.choice(_CONSONANTS)) + (m[2] if m else r.choice(("well", "ton", "field", "ley")))


def _cased(word: str, like: str) -> str:
    letters = [c for c in like if c.isalpha()]
    if len(letters) > 1 and all(c.isupper() for c in letters):
        return word.upper()
    return "-".join(w[:1].upper() + w[1:] for w in word.split("-")) if letters and letters[0].isupper() else word


def replacement(kind: str, text: str, parts: tuple, lo: int, key: str, salt_of) -> str:
    """The mention rewritten with the surrogates of its entities, in its own format.

    ``salt_of``: salt of a (kind, entity).
    """
    entities = entity_of(kind, text, parts, lo)
    made = {k: surrogate(k, e, key, salt_of((k, e))) for k, e in entities}
    if kind == "person":
        family = dict(entities)["family"]
        out, at = [], 0
        for role, a, b in sorted(parts, key=lambda p: p[1]):
            out.append(_middle(text[at : a - lo], key, family))
            own = text[a - lo : b - lo]
            new = _initial(key, family, own[0]) + own[1:] if role == "initial" else made[role]
            out.append(_cased(new, own) if role != "initial" else (new.upper() if own[0].isupper() else new))
            at = b - lo
        return "".join(out) + _middle(text[at:], key, family)
    if kind == "email":
        at = _AT_SIGN.search(text)
        local, _, domain = made["email"].partition("@")
        new = _fill(text[: at.start()], local) + at.group() + _fill(text[at.end() :], domain)
        return new.upper() if text[: at.start()].isupper() else new
    if kind == "phone":
        code, rest = _phone_digits(text)
        new = made["phone"].rpartition(" ")[2]
        skip = len(code) + (2 if re.match(r"\(?00[1-9]", text) and code else 0)
        zero = re.search(r"\(0\)", text)
        out, i = [], 0
        for pos, c in enumerate(text):
            if not c.isdigit() or skip or zero and zero.start() <= pos < zero.end():
                out.append(c)
                skip -= bool(skip and c.isdigit())
            else:
                out.append(new[i] if i < len(new) else "")
                i += 1
        return "".join(out) + new[i:]
    if kind == "id_number":
        new = iter(made["id_number"])
        out = "".join((n.lower() if c.islower() else n) if c.isalnum() and (n := next(new, "")) is not None else c for c in text)
        return out + "".join(new)
    words = dict(zip(dict(entities)["address"].split(" "), made["address"].split(" ")))
    return re.sub(r"[^\W_]+", lambda m: _place_word(m[0], words), text)


def _middle(text: str, key: str, family: str) -> str:
    return re.sub(r"[A-Za-z](?=\.)", lambda m: _initial(key, family, m[0]).upper(), text)


def _fill(text: str, made: str) -> str:
    """Dots of a made address in the spelling of the mention's dots."""
    dot = _DOT_SIGN.search(text)
    return made.replace(".", dot.group()) if dot else made


def _place_word(word: str, words: dict[str, str]) -> str:
    low = word.lower()
    if _FIXED_WORDS.fullmatch(low):
        return word
    new = words.get(_ABBREVIATED.get(low, low)) or words.get(re.sub(r"(?:strasse|str)$", "straße", low))
    if new is None:
        return word
    if (own := _WITH_TYPE.fullmatch(low)) and (other := _WITH_TYPE.fullmatch(new)):
        new = other[1] + own[2]
    return _cased(new, word)


# Frames

def _entities(names):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = _detector(names.value).mentions
        for batch in batches:
            rows = {e for text in batch.column(0).to_pylist() if text for kind, lo, hi, parts in find(text) for e in entity_of(kind, text[lo:hi], parts, lo)}
            rows = sorted(rows)
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.string())], ["kind", "entity"])

    return run


def entities_in(texts: DataFrame, entities: DataFrame) -> DataFrame:
    """Distinct kind, entity (normalised) behind all mentions; kinds email, phone, id_number, address, family, given."""
    ship_package(texts.sparkSession)
    return texts.select("content").where("content IS NOT NULL").mapInArrow(_entities(_sent_names(entities)), "kind string, entity string").distinct()


def _make(key: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            kind, entity, salt = (b.column(i).to_pylist() for i in range(3))
            made = [surrogate(k, e, key, s) for k, e, s in zip(kind, entity, salt)]
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(made, pa.string())], ["kind", "entity", "salt", "surrogate"])

    return run


def assign_surrogates(found: DataFrame, key: str) -> DataFrame:
    """kind, entity, salt, surrogate of the entities ``found`` (kind, entity).

    Surrogates differ within their kind (given names: beside the same family
    name), and none is the name of an entity of its kind (family and given names:
    of either kind).  An entity whose surrogate is taken by a smaller entity or is
    an entity gets the next salt.  Salts from GROWING on lengthen the surrogate,
    so the rounds end.
    """
    ship_package(found.sparkSession)
    schema = "kind string, entity string, salt int, surrogate string"
    entities = cut(found.select("kind", "entity").where("kind IS NOT NULL AND entity IS NOT NULL").distinct())
    name = F.when(F.col("kind") == "given", F.substring_index("entity", "\0", -1)).otherwise(F.col("entity"))
    group = F.when(F.col("kind").isin("family", "given"), "name").otherwise(F.col("kind"))
    real = cut(entities.select(group.alias("real_group"), name.alias("real_name")).distinct())
    scope = F.when(F.col("kind") == "given", F.substring_index("entity", "\0", 1)).otherwise(F.lit(""))
    fresh, done = entities.withColumn("salt", F.lit(0)), None
    while True:
        made = cut(fresh.mapInArrow(_make(key), schema))
        taken = made.select("*", scope.alias("scope")) if done is None else made.select("*", scope.alias("scope")).unionByName(done.select("kind", "entity", F.lit(-1).alias("salt"), "surrogate", scope.alias("scope")))
        # Entities that have their surrogate already (salt -1 here) go before fresh ones.
        winner = taken.groupBy("kind", "scope", "surrogate").agg(F.min(F.struct(F.when(F.col("salt") < 0, 0).otherwise(1), "entity"))["entity"].alias("winner"))
        marked = made.withColumn("scope", scope).join(winner, ["kind", "scope", "surrogate"]).join(real, (group == F.col("real_group")) & (F.col("surrogate") == F.col("real_name")), "left")
        marked = cut(marked.withColumn("free", (F.col("entity") == F.col("winner")) & F.col("real_name").isNull()))
        won = marked.where("free").select("kind", "entity", "salt", "surrogate")
        done = won if done is None else done.unionByName(won)
        fresh = marked.where("NOT free").select("kind", "entity", (F.col("salt") + 1).cast("int").alias("salt"))
        if fresh.isEmpty():
            return done


def _rewrite(names, key: str | None, salts):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = _detector(names.value).mentions
        for batch in batches:
            out, counts = [], []
            own = batch.column(3).to_pylist() if batch.num_columns > 3 else None
            for i, text in enumerate(batch.column(2).to_pylist()):
                if not text:
                    out.append(text), counts.append(0)
                    continue
                table = salts.value if salts is not None else dict(((s["kind"], s["entity"]), s["salt"]) for s in own[i] or ()) if own else {}
                new, at, found = [], 0, find(text)
                for kind, lo, hi, parts in found:
                    new += [text[at:lo], f"[{kind.upper()}]" if key is None else replacement(kind, text[lo:hi], parts, lo, key, lambda e: table.get(e, 0))]
                    at = hi
                out.append("".join(new) + text[at:] if found else text), counts.append(len(found))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.string()), pa.array(counts, pa.int32())], ["tbl", "ingest_no", "content", "n_mentions"])

    return run


_REWRITTEN = "tbl string, ingest_no bigint, content string, n_mentions int"


def redact(texts: DataFrame, entities: DataFrame) -> DataFrame:
    """tbl, ingest_no, content, n_mentions: every mention replaced by ``[KIND]``, the rest unchanged, in one scan.

    Null and empty contents stay as they are; repeated rows stay repeated;
    further columns are left out.
    """
    ship_package(texts.sparkSession)
    return texts.select("tbl", "ingest_no", "content").mapInArrow(_rewrite(_sent_names(entities), None, None), _REWRITTEN)


def replace_by_surrogates(texts: DataFrame, entities: DataFrame, key: str, max_salts: int = MAX_SALTS) -> DataFrame:
    """tbl, ingest_no, content, n_mentions: every mention replaced by a surrogate of its entity.

    Cases as for :func:`redact`.  ``key`` must not be empty; the same key gives
    the same surrogates.
    """
    if not key:
        raise ValueError("surrogates need a key")
    spark, names = texts.sparkSession, _sent_names(entities)
    ship_package(spark)
    salted = cut(assign_surrogates(entities_in(texts, entities), key).where("salt > 0").select("kind", "entity", "salt"))
    rows = salted.limit(max_salts + 1).collect()
    if len(rows) <= max_salts:
        table = spark.sparkContext.broadcast({(r.kind, r.entity): r.salt for r in rows})
        return texts.select("tbl", "ingest_no", "content").mapInArrow(_rewrite(names, key, table), _REWRITTEN)
    numbered = cut(texts.select("tbl", "ingest_no", "content", F.monotonically_increasing_id().alias("row")))
    held = numbered.where("content IS NOT NULL").select("row", "content").mapInArrow(_entities_by_row(names), "row bigint, kind string, entity string")
    own = held.join(salted, ["kind", "entity"]).groupBy("row").agg(F.collect_set(F.struct("kind", "entity", "salt")).alias("salts"))
    return numbered.join(own, "row", "left").select("tbl", "ingest_no", "content", "salts").mapInArrow(_rewrite(names, key, None), _REWRITTEN)


def _entities_by_row(names):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = _detector(names.value).mentions
        for batch in batches:
            rows = [(no, *e) for no, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) if text for e in {e for kind, lo, hi, parts in find(text) for e in entity_of(kind, text[lo:hi], parts, lo)}]
            cols = list(zip(*rows)) if rows else [[]] * 3
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.string(), pa.string()))], ["row", "kind", "entity"])

    return run
