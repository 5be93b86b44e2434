"""Personal data in free text: found, and replaced by typed placeholders that keep equal values linked.

E-mail addresses, phone numbers, identity numbers and postal addresses are found by their formats;
names of people by the words that the corpus's own name columns hold as family and given names. Those
words travel as two Bloom filters sized by their number up to a bound, and what they let through is held
against the words themselves, so that the filters' size has no effect on what is found.
Placeholders carry pseudonyms: the digits and letters of a number are permuted within their format by
a keyed Feistel network (equal values give equal pseudonyms, different ones different ones), other
items get a keyed digest of 128 bits.

Numbers are read before they are permuted: blanks and marks, the international prefix and a trunk zero
make no difference, so a phone number in two spellings gets one pseudonym in two spellings. Country codes,
the first figures of a phone number, the letters of an identity number and the ranges of its figures stay;
check digits and letters are validated and computed anew, so that a valid number becomes a valid one and a
misread one stays invalid. Everything is a permutation: two numbers never share a pseudonym.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import date, timedelta

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm import names as N
from quillon.runtime import staged

KINDS = ("email", "phone", "id_number", "address", "name")
#: Bits of a filter for each word, and at most (64 MB); slices of it are built by tasks of their own.
BLOOM_PER_WORD, BLOOM_LEAST, BLOOM_MOST, BLOOM_HASHES = 32, 1 << 19, 1 << 29, 6

# --- formats ----------------------------------------------------------------------------------------

_S = r"\s+"
EMAIL = re.compile(r"(?<![\w.+-])[A-Za-z0-9][A-Za-z0-9._%+-]*(?:@|\s?[(\[]at[)\]]\s?)(?:[A-Za-z0-9-]+\.)+(?:[A-Za-z]{2,12})(?![\w-])", re.I)
PHONE = re.compile(
    r"(?<![\w+/,.-])(?:"
    r"(?:\+|00\s?)33\s?(?:\(0\)\s?)?[1-9](?:[\s.-]?\d\d){4}|0[1-9](?:[\s.-]?\d\d){4}"  # French
    r"|(?:\+|00\s?)44\s?(?:\(0\)\s?)?\d{2,4}[\s-]\d{3,4}[\s-]?\d{3,4}|020\s\d{4}\s\d{4}|07\d{3}[\s-]\d{6}"  # British
    r"|(?:\+|00\s?)49\s?(?:\(0\)\s?)?\d{2,4}[\s/-]?\d{4,8}(?:[\s-]\d{2,4})?|\(0\d{2,4}\)\s?\d{4,6}(?:-\d{2,4})?|0\d{2}[\s/]\d{4,6}[\s-]\d{2,4}"  # German
    r"|(?:\+|00\s?)34\s?\d{3}(?:\s?\d{2}\s\d{2}\s\d{2,3}|[\s-]?\d{3}[\s-]?\d{3})|(?:555|[679]\d\d)([\s-])\d{3}\1\d{3}"  # Spanish
    r")(?![\w/-]|[.,]\d|\s?(?:EUR|€|euros?)\b)"
)
ID_NUMBER = re.compile(
    r"(?<![\w+/,.-])(?:[12]\d{14}|[12]\s\d\d\s\d\d\s\d[\dAB]\s\d{3}\s\d{3}\s\d\d"  # French social security
    r"|\d\d\s\d\d\s\d{3}\s\d{3}\s\d{3}|\d{2}[A-Z]{2}\d{5}"  # French tax, passport
    r"|[A-CEGHJ-PQR-TW-Z][A-CEGHJ-NPQR-TW-Z]\s\d\d\s\d\d\s\d\d\s[A-D]|[A-CEGHJ-PR-TW-Z][A-CEGHJ-NPR-TW-Z]\d{6}[A-D]"  # British national insurance
    r"|[CFGHJKLMNPRTVWXYZ]\d{8}|\d{2}\s\d{3}\s\d{3}\s\d{3}"  # German identity card, tax
    r"|\d{8}-?[A-HJ-NP-TV-Z]|[XYZ]-?\d{7}-?[A-HJ-NP-TV-Z]"  # Spanish
    r")(?![\w/-]|[.,]\d|\s?(?:EUR|€|euros?)\b)"
)
_WORDS = r"[^\W\d_][\w@'’.-]*"
_TOWN = r"(?:(?:Les|Le|La|El|San|Santa|Bad|St\.?)\s+)?[^\W\d_a-zà-ÿ][\w@'’-]*(?:\s+(?:am|an\s+der|sur|de|del|la|le)\s+[^\W\d_a-zà-ÿ][\w@'’-]*|\s+[^\W\d_a-zà-ÿ][a-zà-ÿ@0-9]+(?=\s*[,.;(]))?"
_STREET = r"(?:rue|avenue|boulevard|all[eé6]e|cours|quai|chemin|impasse|route|passage|place|square|sentier|voie|villa|cit[eé]|faubourg|ruelle|esplanade|promenade)"
ADDRESS = re.compile(
    r"(?<![\w/,.-])(?:"
    # French: number, street, then a postcode with the town, or the town in capitals.
    rf"\d{{1,4}}(?:\s?(?:bis|ter|quater)\b|\s?[A-F]\b)?,?\s+(?:{_STREET}\b[^,.;:()\d]{{3,45}}?|[a-zé@\d]{{3,10}}\s+(?:de|du|des|d['’])[^,.;:()\d]{{3,45}}?)(?:,\s+\d{{5}}\s+{_TOWN}|\s+[A-ZÀ-Ý][A-ZÀ-Ý'’-]{{3,}}(?:\s+[A-ZÀ-Ý][A-ZÀ-Ý'’-]+)*)"
    # British: number and street, town and postcode.
    rf"|\d{{1,4}}[A-F]?,?\s+(?:[A-Z][\w@'’]+\s+){{1,4}}?(?:Road|Street|Row|Lane|Avenue|Close|Terrace|Mews|Way|Drive|Court|Gardens|Square|Place|Hill|Green|Crescent|Yard|Walk|Rise|Quay|Park|Bank|End|Grove|View|Fields?),\s+[A-Z][\w@'’-]*(?:\s+(?:upon|on|under|of|[A-Z][a-z@0-9]+)){{0,2}}(?:\s+[A-Z]{{1,2}}\d[A-Z\d]?\s+\d[A-Z]{{2}})?"
    # German: street and number, postcode and town.
    rf"|[A-ZÄÖÜ][\w@ßäöü-]*(?:stra[sß5]s?e|str\.|weg|gasse|allee|platz|ring|damm|ufer|hof|steig|pfad)\s+\d{{1,4}}\s?[a-f]?,\s+\d{{5}}\s+{_TOWN}"
    rf"|(?:Am|An\s+de[rmn]|Im|In\s+der|Zu[mr]|Auf\s+de[rmn]|Unter\s+de[rmn]|Hinter\s+de[rmn]|Alte[rs]?|Neue[rs]?)\s+(?:[A-ZÄÖÜ][\w@ßäöü-]+\s+){{1,3}}\d{{1,4}}\s?[a-f]?,\s+\d{{5}}\s+{_TOWN}"
    # Spanish: street and number, postcode and town.
    rf"|(?:[Cc]alle|[Pp]laza|[Aa]venida|[Cc]amino|[Pp]aseo|[Rr]onda|[Cc]arretera|[Tt]raves[ií]a)\s+[^,.;:()\d]{{3,40}}?\s+\d{{1,4}}\s?[A-F]?,\s+\d{{5}}\s+{_TOWN}"
    r")"
)
_WORD = re.compile(r"[^\W\d_]+(?:-[^\W\d_]+)*(?:[-‐­]\s+[^\W\d_]+)?")
_HYPHENATED = re.compile(r"[-‐­]\s+")
_GAP = re.compile(r"^\s+$")
_TITLED = re.compile(r"(?<![\w.])(?:M\.|Mr|Mme|Mlle|Me|Ma[iî]tre|Dr|Docteur|Monsieur|Madame|Mrs|Ms|Herrn?|Frau|Sr\.|Sra\.|don|doña)\s+(?=([^\W\d_a-zà-ÿ][a-zà-ÿ]+(?:-[^\W\d_a-zà-ÿ][a-zà-ÿ]+)?)\s+[^\W\d_a-zà-ÿ]{3,}(?![\w'’]))")
_INITIALS_BEFORE = re.compile(r"(?:(?<=\s)|(?<=^)|(?<=[(«\"]))((?:[^\W\d_a-zà-ÿ]\.-?){1,3}|[A-ZÀ-Ý]{2}(?=\s))\s*$")
_INITIALS_AFTER = re.compile(r"^\s+((?:[^\W\d_a-zà-ÿ]\.-?)+|[^\W\d_a-zà-ÿ](?![\w'’]))")


# --- names --------------------------------------------------------------------------------------------


def _positions(word: str, bits: int, hashes: int = BLOOM_HASHES) -> list[int]:
    d = hashlib.blake2b(word.encode(), digest_size=16).digest()
    a, b = int.from_bytes(d[:8], "big"), int.from_bytes(d[8:], "big") | 1
    return [(a + i * b) % bits for i in range(hashes)]


def bloom(words: DataFrame) -> bytes:
    """A Bloom filter of (word), a bitmap of 32 bits a word and 64 MB at most, built from slices and gathered on the driver."""
    slice_bits = BLOOM_LEAST
    n = words.count()
    bits = min(BLOOM_MOST, max(BLOOM_LEAST, 1 << (n * BLOOM_PER_WORD - 1).bit_length() if n else 0))

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            at = [p for w in b["word"] for p in _positions(w, bits)]
            yield pd.DataFrame({"slice": [p // slice_bits for p in at], "bit": [p % slice_bits for p in at]})

    def build(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        marks = np.zeros(slice_bits, np.uint8)
        marks[group["bit"].to_numpy()] = 1
        return pd.DataFrame({"slice": [key[0]], "blob": [np.packbits(marks).tobytes()]})

    placed = words.select("word").mapInPandas(place, "slice int, bit int").distinct()
    parts = placed.groupBy("slice").applyInPandas(build, "slice int, blob binary").collect()
    out = bytearray(bits // 8)
    for r in parts:
        out[r["slice"] * slice_bits // 8 : (r["slice"] + 1) * slice_bits // 8] = r["blob"]
    return bytes(out)


def name_words(values: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(family words, given words), each (word), of the people among (name)."""
    people = N.read_persons(N.spellings(values))
    family = people.filter("given <> '' and length(word) >= 3").select("word").distinct()
    given = people.select(F.explode(F.array_distinct(F.concat(F.array("given"), F.split("given", "-")))).alias("word")).filter("length(word) >= 2").distinct()
    return family, given


class NameFinder:
    """Spans of people's names in a text, titles left out."""

    FAMILY, GIVEN = 1, 2

    def __init__(self, family: bytes, given: bytes):
        self.blooms, self.known = ((self.FAMILY, family), (self.GIVEN, given)), {}

    def role(self, token: str) -> int:
        r = self.known.get(token)
        if r is None:
            if len(self.known) > 400_000:
                self.known.clear()
            word = N.fold(_HYPHENATED.sub("", token))
            r = 0
            if word not in N.LEGAL and word not in N.BUSINESS and len(word) >= 2:
                for mark, bits in self.blooms:
                    if all(bits[p >> 3] & (128 >> (p & 7)) for p in _positions(word, 8 * len(bits))):
                        r |= mark
            self.known[token] = r
        return r

    def spans(self, text: str) -> list[tuple[int, int]]:
        found: list[tuple[int, int]] = []
        tokens = [(m.start(), m.end(), m.group()) for m in _WORD.finditer(text)]
        roles = [self.role(t[2]) for t in tokens]
        # Behind a title, a capitalised word and one in capitals are a name even if no name column has them.
        titled = {m.start(1) for m in _TITLED.finditer(text)}
        if titled:
            for i in range(len(tokens) - 1):
                if tokens[i][0] in titled and not roles[i] and not roles[i + 1] and N.fold(tokens[i + 1][2]) not in N.LEGAL and N.fold(tokens[i + 1][2]) not in N.BUSINESS:
                    roles[i], roles[i + 1] = self.GIVEN, self.FAMILY
        used = -1
        big = lambda w: len(w) >= 4 and w.isupper()
        for i, r in enumerate(roles):
            if i <= used or not (r or big(tokens[i][2])):
                continue
            s, e, w = tokens[i]
            nxt = tokens[i + 1] if i + 1 < len(tokens) else None
            gap = text[e : nxt[0]] if nxt else ""
            family, given = r & self.FAMILY, r & self.GIVEN
            if nxt and _GAP.match(gap):
                r2, w2 = roles[i + 1], nxt[2]
                forward = given and (r2 & self.FAMILY or (big(w2) and not r2 and N.fold(w2) not in N.LEGAL and N.fold(w2) not in N.BUSINESS))
                backward = (family or (big(w) and not r)) and r2 & self.GIVEN
                if forward and family and backward and w.isupper() and not w2.isupper():
                    forward = 0
                if forward or (backward and N.fold(w) not in N.LEGAL and N.fold(w) not in N.BUSINESS):
                    if not (nxt[1] == len(text) and not (r2 and r)):  # a word that the text's end cut is none
                        found.append((s, nxt[1]))
                        used = i + 1
                        continue
            if family and nxt and re.match(r"^\s?,\s+$", gap) and roles[i + 1] & self.GIVEN and not w.isupper():
                after = tokens[i + 2] if i + 2 < len(tokens) else None
                if not (after and _GAP.match(text[nxt[1] : after[0]]) and (roles[i + 2] & self.FAMILY or big(after[2]))):
                    found.append((s, nxt[1]))
                    used = i + 1
                    continue
            if not family or not w[:1].isupper():
                continue
            before = _INITIALS_BEFORE.search(text[max(0, s - 10) : s])
            after = _INITIALS_AFTER.match(text[e : e + 12])
            if before and N.fold(before[1].replace(".", "")) not in N.LEGAL and not (nxt and _GAP.match(gap) and N.fold(nxt[2]) in N.BUSINESS):
                found.append((max(0, s - 10) + before.start(1), e))
                used = i
            elif after:
                end = e + after.end(1)
                if after[1].endswith(".") and not w.isupper() and len(after[1]) == 2:
                    end -= 1  # the stop is the sentence's
                found.append((s, end))
                used = i
                while used + 1 < len(tokens) and tokens[used + 1][0] < end:
                    used += 1
        return found


def find(text: str, finder: NameFinder) -> list[tuple[int, int, str]]:
    """(start, end, kind) of all items of a text, in order, without overlaps; the kinds found first by format win."""
    taken: list[tuple[int, int, str]] = []

    def free(s: int, e: int) -> bool:
        return all(e <= a or s >= b for a, b, _ in taken)

    low = None
    if "@" in text or "at)" in (low := text.lower()) or "at]" in low:
        for m in EMAIL.finditer(text):
            tld = m.group().rsplit(".", 1)[-1].lower()
            if m.end() < len(text) or tld in ("example", "invalid", "test", "com", "fr", "org", "net", "de", "es", "uk", "eu"):
                taken.append((m.start(), m.end(), "email"))
    if re.search(r"\d", text):
        for pattern, kind in ((ID_NUMBER, "id_number"), (PHONE, "phone"), (ADDRESS, "address")):
            for m in pattern.finditer(text):
                if free(m.start(), m.end()) and not (kind == "address" and m.end() == len(text)):
                    taken.append((m.start(), m.end(), kind))
    for s, e in finder.spans(text):
        if free(s, e):
            taken.append((s, e, "name"))
    return sorted(taken)


# --- pseudonyms -----------------------------------------------------------------------------------------


def _round(key: bytes, i: int, n: int, base: int, half: int) -> int:
    return int.from_bytes(hashlib.blake2b(f"{i}|{n}|{base}|{half}".encode(), key=key, digest_size=16).digest(), "big")


def feistel(value: int, digits: int, base: int, key: bytes, rounds: int = 10, back: bool = False) -> int:
    """A keyed permutation of the numbers of so many digits of a base; `back` undoes it."""
    if digits < 2:  # one digit: a keyed shift is a permutation
        shift = _round(key, 0, digits, base, 0) % base
        return (value - shift if back else value + shift) % base
    u = digits // 2
    low, high = base**u, base ** (digits - u)
    a, b = divmod(value, high)  # a below low, b below high
    for i in range(rounds - 1, -1, -1) if back else range(rounds):
        if i % 2 == 0:
            f = _round(key, i, digits, base, b)
            a = (a - f if back else a + f) % low
        else:
            f = _round(key, i, digits, base, a)
            b = (b - f if back else b + f) % high
    return a * high + b


def permuted(value: int, size: int, key: bytes, back: bool = False) -> int:
    """A keyed permutation of the numbers below size: the Feistel network over enough digits, walked until it comes back into the range."""
    digits = max(len(str(size - 1)), 2)
    value = feistel(value, digits, 10, key, back=back)
    while value >= size:
        value = feistel(value, digits, 10, key, back=back)
    return value


def mixed(values: list[int], sizes: list[int], key: bytes, back: bool = False) -> list[int]:
    """A keyed permutation of tuples of numbers, each below its size."""
    n, size = 0, 1
    for v, m in zip(values, sizes):
        n, size = n * m + v, size * m
    n = permuted(n, size, key, back)
    out = []
    for m in reversed(sizes):
        n, v = divmod(n, m)
        out.append(v)
    return out[::-1]


def laid_out(value: str, plain: str) -> str:
    """plain, a string of letters and digits, with the blanks and marks that value has between its own."""
    rest = iter(plain)
    return "".join(next(rest) if c.isascii() and c.isalnum() else c for c in value)


# Check digits and letters, as published for each number.


def _social_security(body: str) -> int:
    """The key of 13 places of a French social security number."""
    return 97 - int(body.replace("2A", "19", 1).replace("2B", "18", 1) if not body.isdigit() else body) % 97


def _weights_731(body: str) -> int:
    """The check digit of the nine places of a German identity card: weights 7, 3, 1 over digits and letters."""
    return sum((int(c) if c.isdigit() else ord(c) - 55) * (7, 3, 1)[i % 3] for i, c in enumerate(body)) % 10


def _mod_11_10(body: str) -> int:
    """The check digit of a German tax number (ISO 7064, mod 11, 10)."""
    p = 10
    for c in body:
        p = ((int(c) + p) % 10 or 10) * 2 % 11
    return (11 - p) % 10


_SPANISH = "TRWAGMYFPDXBNJZSQVHLCKE"


def _figures(text: str, key: bytes, back: bool, keep: int = 0) -> str:
    """The digits behind the first `keep` characters permuted among numbers of their length."""
    d = text[keep:]
    return text[:keep] + (f"{permuted(int(d), 10 ** len(d), key, back):0{len(d)}d}" if d else "")


def _check(was: str, check: int, now: int, size: int, width: int) -> str:
    """The new check digits: as far from the right ones as the old ones were, so that valid stays valid and invalid stays invalid."""
    return f"{(now + int(was) - check) % size:0{width}d}"


def id_pseudonym(value: str, key: bytes, back: bool = False) -> str:
    """Another identity number of the same kind, valid if and only if this one is; unknown kinds have their digits permuted."""
    x = "".join(c for c in value if c.isascii() and c.isalnum()).upper()
    salt = lambda kind: hashlib.blake2b(kind.encode(), key=key, digest_size=32).digest()
    if re.fullmatch(r"[12]\d{5}[\dAB]\d{8}", x) and (x[6].isdigit() or x[5] == "2"):
        if 1 <= int(x[3:5]) <= 12:  # sex and department stay
            year, month, rest = mixed([int(x[1:3]), int(x[3:5]) - 1, int(x[7:13])], [100, 12, 10**6], salt("nir"), back)
            body = f"{x[0]}{year:02d}{month + 1:02d}{x[5:7]}{rest:06d}"
        else:
            body = f"{x[0]}{_figures(x[1:3], salt('nir2'), back)}{x[3:7]}{_figures(x[7:13], salt('nir3'), back)}"
        plain = body + _check(x[13:], _social_security(x[:13]), _social_security(body), 100, 2)
    elif re.fullmatch(r"\d{13}", x):
        body = _figures(x[:10], salt("spi"), back, 1)
        plain = body + _check(x[10:], int(x[:10]) % 511, int(body) % 511, 1000, 3)
    elif re.fullmatch(r"\d{2}[A-Z]{2}\d{5}", x):
        a, b, c, d = mixed([int(x[:2]), ord(x[2]) - 65, ord(x[3]) - 65, int(x[4:])], [100, 26, 26, 10**5], salt("passport"), back)
        plain = f"{a:02d}{chr(65 + b)}{chr(65 + c)}{d:05d}"
    elif re.fullmatch(r"[A-Z]{2}\d{6}[A-D]", x):
        a, b = mixed([int(x[2:8]), ord(x[8]) - 65], [10**6, 4], salt("nino" + x[:2]), back)
        plain = f"{x[:2]}{a:06d}{chr(65 + b)}"
    elif re.fullmatch(r"[A-Z]\d{8,9}", x):  # the serial number, with or without its check digit
        body = _figures(x[:9], salt("card" + x[0]), back, 1)
        plain = body + (_check(x[9], _weights_731(x[:9]), _weights_731(body), 10, 1) if x[9:] else "")
    elif re.fullmatch(r"\d{11}", x):
        body = _figures(x[:10], salt("tax"), back, 1)
        plain = body + _check(x[10], _mod_11_10(x[:10]), _mod_11_10(body), 10, 1)
    elif m := re.fullmatch(r"([XYZ]?)(\d{7,8})([A-Z])", x):
        number = lambda d: int("XYZ".find(m[1]) * 10**7 if m[1] else 0) + int(d)
        d = _figures(m[2], salt("nif" + m[1]), back)
        at = _SPANISH.find(m[3])
        # A letter that no number has stays; the others keep their distance from the right one.
        plain = m[1] + d + (m[3] if at < 0 else _SPANISH[(number(d) + at - number(m[2])) % 23])
    else:
        return pseudonym(value, key, back)
    return laid_out(value, plain)


def phone_parts(value: str) -> tuple[str, str, str]:
    """(country, kept, rest) of a phone number: what stands before the national number, its first figures, and the figures behind them."""
    d = "".join(c for c in value if "0" <= c <= "9" or c == "+")
    trunk = "(0)" in value
    if d.startswith("00") or d.startswith("+"):
        d = d.lstrip("+")
        d = d[2:] if d.startswith("00") else d
        country, national = d[:2], d[2:]
        national = national[1:] if trunk else national
    else:
        country = "33" if re.match(r"0[1-9](?:[\s.-]?\d\d){4}$", value) else "44" if re.match(r"020\s|07\d{3}[\s-]", value) else "49" if value.startswith(("0", "(0")) else "34"
        national = d[1:] if d.startswith("0") else d
    keep = 1 if country in ("33", "34") else 2
    return country, national[:keep], national[keep:]


def phone_pseudonym(value: str, key: bytes, back: bool = False) -> str:
    """Another phone number of the same country and first figures, spelled in the same way; spellings of one number stay spellings of one."""
    country, kept, rest = phone_parts(value)
    if not rest:
        return value
    own = hashlib.blake2b(f"phone{country}{kept}".encode(), key=key, digest_size=32).digest()
    new = f"{permuted(int(rest), 10 ** len(rest), own, back):0{len(rest)}d}"
    out, at = list(value), len(new)
    for i in range(len(out) - 1, -1, -1):  # from the right, so that whatever stands before stays
        if at and "0" <= out[i] <= "9":
            at -= 1
            out[i] = new[at]
    return "".join(out)


def pseudonym(value: str, key: bytes, back: bool = False) -> str:
    """A value of the same format: its digits permuted among digits, its capitals among capitals."""
    out = list(value)
    for base, first, at in ((10, "0", [i for i, c in enumerate(value) if "0" <= c <= "9"]), (26, "A", [i for i, c in enumerate(value) if "A" <= c <= "Z"])):
        if not at:
            continue
        n = 0
        for i in at:
            n = n * base + ord(value[i]) - ord(first)
        n = feistel(n, len(at), base, key, back=back)
        for i in reversed(at):
            n, d = divmod(n, base)
            out[i] = chr(ord(first) + d)
    return "".join(out)


def date_pseudonym(day: date, key: bytes, back: bool = False, first: date = date(1900, 1, 1)) -> date:
    """Another day within ten thousand days' span: dates keep being dates, equal ones equal."""
    span = 10_000
    block, offset = divmod((day - first).days, span)
    return first + timedelta(days=block * span + feistel(offset, 4, 10, key, back=back))


DATE = re.compile(r"(?<![\w/.-])(?:(?P<d>[0-3]?\d)(?P<s>[/.-])(?P<m>[01]?\d)(?P=s)(?P<y>(?:19|20)\d\d)|(?P<y2>(?:19|20)\d\d)-(?P<m2>[01]\d)-(?P<d2>[0-3]\d))(?![\w/-]|\.\d)")


def dates_replaced(text: str, key: bytes) -> str:
    """A text with every date in figures that exists permuted, in the format in which it stands."""

    def one(m: re.Match) -> str:
        iso = m["y2"] is not None
        try:
            day = date(int(m["y2" if iso else "y"]), int(m["m2" if iso else "m"]), int(m["d2" if iso else "d"]))
        except ValueError:  # no such day: no date
            return m[0]
        new = date_pseudonym(day, key)
        if iso:
            return new.isoformat()
        pad = lambda n, was: f"{n:0{2 if len(was) == 2 else 1}d}"
        return f"{pad(new.day, m['d'])}{m['s']}{pad(new.month, m['m'])}{m['s']}{new.year}"

    return DATE.sub(one, text)


def placeholder(kind: str, value: str, key: bytes) -> str:
    one = " ".join(value.split())
    if kind == "phone":
        return f"[PHONE {phone_pseudonym(one, key)}]"
    if kind == "id_number":
        return f"[ID_NUMBER {id_pseudonym(one, key)}]"
    plain = N.fold(one) if kind == "name" else one.lower()
    return f"[{kind.upper()} {base64.b32encode(hashlib.blake2b(plain.encode(), key=key, digest_size=16).digest()).decode().rstrip('=').lower()}]"


# --- operators --------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Lexicon:
    """The words of people's names, as tables (word) and as Bloom filters."""

    family: DataFrame
    given: DataFrame
    blooms: tuple[bytes, bytes]

    @classmethod
    def of(cls, values: DataFrame) -> Lexicon:
        """From the spellings of (name)."""
        family, given = (staged(x, "name_words") for x in name_words(values))
        return cls(family, given, (bloom(family), bloom(given)))


def _run(texts: DataFrame, lexicon: Lexicon, emit, schema: str) -> DataFrame:
    shared = texts.sparkSession.sparkContext.broadcast(lexicon.blooms)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        finder = NameFinder(*shared.value)
        for b in batches:
            yield emit(b, finder)

    return texts.mapInPandas(run, schema)


def found(texts: DataFrame, lexicon: Lexicon) -> DataFrame:
    """(field_name, record_id, kind, value) of texts (field_name, record_id, text); values stand on one line. Nulls have none.

    Names in whose favour only a filter spoke, and none of the words themselves, are left out.
    """

    def emit(b: pd.DataFrame, finder: NameFinder) -> pd.DataFrame:
        rows = []
        for f, i, t in zip(b["field_name"], b["record_id"], b["text"]):
            for s, e, kind in find(t, finder):
                value = t[s:e]
                known = [w for x in _WORD.findall(value) if finder.role(x) and (w := N.fold(_HYPHENATED.sub("", x)))] if kind == "name" else None
                rows.append((f, i, kind, " ".join(value.split()), known))
        return pd.DataFrame(rows, columns=["field_name", "record_id", "kind", "value", "known"])

    all_ = _run(texts.filter("text is not null and record_id is not null"), lexicon, emit, "field_name string, record_id string, kind string, value string, known array<string>").distinct()
    all_ = staged(all_, "items")
    words = lexicon.family.union(lexicon.given).distinct()
    doubtful = all_.select(F.explode("known").alias("word")).distinct().join(words, "word", "left_anti")  # what the filters let through wrongly
    wrong = all_.select("known").distinct().withColumn("word", F.explode("known")).join(doubtful, "word").select("known").distinct()
    return all_.join(wrong, "known", "left_anti").select("field_name", "record_id", "kind", "value").distinct()


def redacted(texts: DataFrame, lexicon: Lexicon, key: bytes, dates: bool = False) -> DataFrame:
    """(field_name, record_id, text): the texts with a placeholder for each item and the rest unchanged; null stays null.

    With `dates`, dates in figures become other dates of the same format, equal ones equal.
    """

    def emit(b: pd.DataFrame, finder: NameFinder) -> pd.DataFrame:
        out = []
        plain = (lambda t: dates_replaced(t, key)) if dates else (lambda t: t)
        for t in b["text"]:
            if t is None:
                out.append(None)
                continue
            parts, at = [], 0
            for s, e, kind in find(t, finder):
                parts += [plain(t[at:s]), placeholder(kind, t[s:e], key)]
                at = e
            out.append("".join(parts) + plain(t[at:]))
        return pd.DataFrame({"field_name": b["field_name"], "record_id": b["record_id"], "text": out})

    return _run(texts, lexicon, emit, "field_name string, record_id string, text string")
