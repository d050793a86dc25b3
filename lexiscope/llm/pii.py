"""Problem 6: personal data inside free text, found by a BiLSTM-CRF over pieces of characters and replaced by typed placeholders.

Windows. The tagger reads every character of every text, by windows of at most ``MAX_WINDOW`` characters that overlap by
``OVERLAP``. All windows of a batch are decoded together, equal ones once; where two overlap, each decides up to the middle.

Decision. What the tagger decodes is what is found. Afterwards a span is only widened to the end of the word it stops in,
and pieces of one type with nothing but one blank or joint between them become one span. No pattern, word list or form
stands behind the tagger.

Training, on labelled spans made at run time from at most ``TRAIN_ROWS`` rows of the table, drawn by hash:

* values of each type are generated from public formats, invented words and the words of the sample, and put at random
  places of the sample's own texts, with and without a cue word; so are values that only look alike (versions, addresses of
  machines, hashes, remotes, package coordinates, handles, products);
* names and addresses of the author columns are values too, and a text that holds a first and a last name of that column
  side by side is labelled there (distant supervision);
* the first round is short and trained on stretches with planted values and look-alikes only. The tagger then labels the
  untouched texts itself; texts in which it finds nothing are what the next round plants into, lest their own data count as
  none, and a window in which it finds something even with label O favoured, or nothing even with label O disfavoured
  (``SURE``), joins the next round as labelled, the others stay out. So carriers, headings and code of the table are learnt without being written down here.
  Two facts of the table correct it: the phrase by which a record was collected is no personal data, nor is wording that
  stands in ``COMMON`` or more windows of the sample (digits alike), unless it is in the author columns.

Types: email, phone, id_number, street_address, person_name. In the author's name, a person's name is no case. Null and
empty texts hold nothing and stay as they are. Placeholders are ``[EMAIL]``, ``[PHONE]``, ``[ID_NUMBER]``,
``[STREET_ADDRESS]`` and ``[PERSON_NAME]``; all other characters are kept.
"""

from __future__ import annotations

import hashlib
import random
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from pathlib import Path

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiscope.llm.tagger import Tagger, encode_pieces, pad
from lexiscope.session import fingerprint, remembered

TYPES = ["email", "phone", "id_number", "street_address", "person_name"]
LABELS = ["O", *(f"{p}-{t}" for t in TYPES for p in "BI")]
TRAIN_ROWS = 10_000
INSERTED = 12_000
#: untouched windows per window with planted values in each round
SHARES = (0.0, 0.4, 0.7)
ROUND_STEPS = (500, 450, 850)
#: log-odds a character by which label O is favoured where something was found, and disfavoured where nothing was, for a window to be learnt from
SURE = (0.3, 0.8)
COMMON = 8
TRAIN_WINDOW = 200
MAX_WINDOW = 480
OVERLAP = 80
BATCH_WINDOWS = 256

UP = "A-ZÀ-ÖØ-ÞĀĆĘŁŃŚŹŻŠŽČ"
#: fixed values: how English spells digits
DIGIT_WORDS = "zero oh one two three four five six seven eight nine".split()


def stretches(text: str) -> list[tuple[int, int]]:
    """What of a text is read: all of it."""
    return [(0, len(text))] if text else []


def windows_of(text: str) -> list[tuple[int, int]]:
    """Overlapping windows of at most ``MAX_WINDOW`` characters over the whole text."""
    out = []
    for s, e in stretches(text):
        while e - s > MAX_WINDOW:
            out.append((s, s + MAX_WINDOW))
            s += MAX_WINDOW - OVERLAP
        out.append((s, e))
    return out


# ---- generated values ----------------------------------------------------------------------------------------------


@dataclass
class Words:
    """What values are made of: words of the sample, and full names and addresses of its author columns."""

    plain: list[str] = field(default_factory=list)
    names: list[list[str]] = field(default_factory=list)
    mails: list[str] = field(default_factory=list)

    @classmethod
    def of(cls, bodies: list[str], authors: list[str], mails: list[str]) -> Words:
        plain = sorted({w for b in bodies[:4000] for w in re.findall(r"(?<![\w])[a-z]{3,10}(?![\w])", b)})
        names = sorted({tuple(a.split()) for a in authors if re.fullmatch(rf"[{UP}][^\W\d_]+(?: [{UP}][^\W\d_]+){{1,2}}", a)})
        return cls(plain, [list(n) for n in names], sorted({m for m in mails if re.fullmatch(r"[^\s@<>]+@[^\s@<>]+\.[a-z]+", m)}))


def _digits(r: random.Random, n: int) -> str:
    return "".join(r.choice("0123456789") for _ in range(n))


def _invented(r: random.Random, most: int = 3) -> str:
    """A word of one to ``most`` syllables."""
    part = lambda: r.choice("b br c ch d dr f fl g gr h j k kl l m n p pr qu r s sch st t th tr v w y z".split()) + r.choice("a a e e i o o u ai ei ia ou é ö".split()) + r.choice("  l ll n n nd r r rt s st x m ck ng sk v".split(" "))
    return "".join(part() for _ in range(r.randint(1, most)))


def _word(r: random.Random, w: Words) -> str:
    return r.choice(w.plain) if w.plain and r.random() < 0.5 else _invented(r)


def _full_name(r: random.Random, w: Words) -> tuple[str, str]:
    first, last = _invented(r, 2).capitalize(), _invented(r).capitalize()
    if w.names and r.random() < 0.75:
        first = r.choice(w.names)[0]
    if w.names and r.random() < 0.6:
        last = r.choice(w.names)[-1]
    if r.random() < 0.12:
        last = r.choice(["van ", "de ", "da ", "dos ", "von ", "van der ", "van den ", "di ", "O'", "Mc", "bin ", "al-", "del ", "le ", "D'"]) + last
    if r.random() < 0.05:
        first += "-" + _invented(r, 2).capitalize()
    if r.random() < 0.05:
        last += "-" + _invented(r, 2).capitalize()
    return first, last


def person_name(r: random.Random, w: Words) -> str:
    first, last = _full_name(r, w)
    shape = r.random()
    out = f"{first} {last}"
    if shape < 0.14:
        out = f"{last}, {first}"
    elif shape < 0.28:
        out = f"{first[0]}. {last}"
    elif shape < 0.42:
        out = f"{first} {r.choice('ABCDEFGHIJKLMNOPRSTVW')}. {last}"
    elif shape < 0.48:
        out = f"{first} {_full_name(r, w)[r.randint(0, 1)]} {last}"
    elif shape < 0.51:
        out = f"{r.choice(['Dr.', 'Mr.', 'Ms.', 'Prof.', 'Sr.', 'Frau'])} {last}"
    return out.upper() if r.random() < 0.14 else out


def email(r: random.Random, w: Words) -> str:
    if w.mails and r.random() < 0.4:
        local, host = r.choice(w.mails).split("@")
    else:
        first, last = (re.sub(r"[^a-z]", "", x.lower()) or "x" for x in _full_name(r, w))
        local = r.choice([f"{first}.{last}", f"{first}_{last}", f"{first[0]}{last}", f"{first}{last[0]}", f"{last}{_digits(r, r.randint(1, 4))}", first, f"{first}-{last}", f"{first}+{_word(r, w)}", f"{first}.{last}{_digits(r, 2)}"])
        host = ".".join(_word(r, w) for _ in range(r.choice([1, 1, 1, 2]))) + "." + r.choice("com com org net edu io dev de fr br pt es eu example example test invalid co.uk com.br".split())
        host = host.replace("é", "e").replace("ö", "o")
        if r.random() < 0.2:
            host = _word(r, w).replace("é", "e").replace("ö", "o") + "-" + host
    shape = r.random()
    if shape < 0.6:
        out = f"{local}@{host}"
    elif shape < 0.68:
        out = local + r.choice([" @ ", "@ ", " @"]) + host
    else:
        at = r.choice([" at ", " at ", " AT ", "(at)", "[at]", " [at] ", " (at) ", "(a)", "{at}", "_at_", "[AT]"])
        dot = r.choice([".", " dot ", "(dot)", "[dot]"] if at.strip().lower() != "at" else [".", " dot ", " dot "])
        out = local + at + host.replace(".", dot.upper() if at.isupper() else dot)
        if r.random() < 0.15:
            out = out.replace(".", " dot ")
    return out.upper() if r.random() < 0.1 else out


def phone(r: random.Random, w: Words) -> str:
    """A country or area prefix and groups of digits, in the separators of many countries; at times in words."""
    if r.random() < 0.05:
        return " ".join(r.choice(DIGIT_WORDS) for _ in range(r.randint(7, 11)))
    sep = r.choice([" ", " ", " ", "-", "-", "."])
    area = lambda: ("0" if r.random() < 0.5 else str(r.randint(1, 9))) + _digits(r, r.randint(1, 4))
    prefix, zero = str(r.choice([1, r.randint(7, 99), r.randint(7, 99), r.randint(200, 999)])), "0" + _digits(r, r.randint(1, 4))
    head = r.choice([
        lambda: f"+{prefix}{sep}", lambda: f"+{prefix} ", lambda: f"+{prefix}{sep}{_digits(r, r.randint(2, 4))}{sep}", lambda: f"+{prefix}{r.choice([' ', ''])}({area()}){r.choice([' ', ''])}", lambda: f"00{prefix}{sep}", lambda: f"00{prefix}{sep}{_digits(r, r.randint(2, 4))}{sep}",
        lambda: f"({area()}){r.choice([' ', ' ', '-', ''])}", lambda: f"({_digits(r, 3)}) ", lambda: zero + sep, lambda: zero + sep, lambda: zero + "/", lambda: _digits(r, 3) + sep, lambda: f"1{sep}{_digits(r, 3)}{sep}", lambda: "+" + prefix,
    ])()
    need = max(4, r.choice([7, 8, 9, 10, 10, 11, 12]) - sum(c.isdigit() for c in head))
    if len(head) <= 4 and head.isdigit():
        need = max(need, 7)
    groups = []
    while need > 0:
        n = min(need, r.choice([2, 2, 3, 3, 4, 4, 5, 6, 8]))
        n = need if need - n == 1 else n
        groups.append(_digits(r, n))
        need -= n
    return head + sep.join(groups)


def id_number(r: random.Random, w: Words) -> str:
    """Identity, tax and passport numbers in the written forms of several countries, with digits of chance."""
    d = lambda n: _digits(r, n)
    up = lambda n: "".join(r.choice("ABCDEFGHJKLMNPQRSTVWXYZ") for _ in range(n))
    usual = [lambda: f"{d(3)}-{d(2)}-{d(4)}", lambda: f"{d(3)}.{d(3)}.{d(3)}-{d(2)}", lambda: f"{up(2)}{d(6)}{r.choice('ABCD')}", lambda: f"{up(2)} {d(2)} {d(2)} {d(2)} {r.choice('ABCD')}", lambda: f"{d(3)} {d(2)} {d(4)}"]
    if r.random() < 0.35:  # what the most people have
        return r.choice(usual)()
    return r.choice([
        lambda: f"{d(3)}-{d(2)}-{d(4)}", lambda: f"{d(3)} {d(2)} {d(4)}", lambda: f"{up(2)}{d(6)}{r.choice('ABCD')}", lambda: f"{up(2)} {d(2)} {d(2)} {d(2)} {r.choice('ABCD')}",
        lambda: f"{d(3)}.{d(3)}.{d(3)}-{d(2)}", lambda: f"{d(2)}.{d(3)}.{d(3)}/{d(4)}-{d(2)}", lambda: f"{d(3)}.{d(3)}.{d(3)}-{d(2)}", lambda: f"{d(8)}{up(1)}", lambda: f"{d(8)}-{up(1)}", lambda: f"{r.choice('XYZ')}{d(7)}{up(1)}", lambda: f"{r.choice('XYZ')}-{d(7)}-{up(1)}",
        lambda: f"{d(3)} {d(3)} {d(3)}", lambda: f"{d(1)} {d(2)} {d(2)} {d(2)} {d(3)} {d(3)} {d(2)}", lambda: f"{up(1)}{d(2)}{up(1)}{d(5)}", lambda: f"{up(1)}{d(2)}{up(1)}{d(2)}{up(1)}{d(2)}", lambda: f"{d(2)} {d(3)} {d(3)} {d(3)}",
        lambda: f"{up(6)}{d(2)}{up(1)}{d(2)}{up(1)}{d(3)}{up(1)}", lambda: f"{d(4)} {d(4)} {d(4)}", lambda: f"{up(5)}{d(4)}{up(1)}", lambda: f"{d(6)}-{d(4)}", lambda: f"{up(1)}{d(7)}", lambda: f"{up(1)}{d(8)}", lambda: f"{up(2)}{d(6)}", lambda: f"{up(2)}{d(7)}", lambda: f"{d(2)}{up(2)}{d(5)}",
    ])()


def street_address(r: random.Random, w: Words) -> str:
    name = " ".join(_word(r, w).capitalize() for _ in range(r.choice([1, 1, 1, 2])))
    town = r.choice([lambda: _invented(r).capitalize(), lambda: _word(r, w).capitalize(), lambda: f"{r.choice('Santa San Port New Bad Saint Nova Ville'.split())} {_word(r, w).capitalize()}"])()
    n = str(r.randint(1, 9999) if r.random() < 0.5 else r.randint(1, 220)) + (r.choice("abc") if r.random() < 0.06 else "")
    shape = r.random()
    if shape < 0.5:
        kind = r.choice("Street St St. Road Rd Rd. Lane Ln Avenue Ave Ave. Boulevard Blvd Drive Dr Court Ct Close Row Way Place Square Terrace Crescent Gardens Grove Hill Walk Mews Parkway Highway".split())
        out = f"{n}{r.choice([' ', ' ', ', '])}{name} {kind}"
        if r.random() < 0.25:
            out += f", {r.choice(['Apt', 'Apt.', 'Flat', 'Unit', 'Suite', '#'])} {r.randint(1, 90)}"
        if r.random() < 0.2:
            out = f"{r.choice(['Flat', 'Unit', 'Apt', 'Floor'])} {r.randint(1, 60)}, " + out
    elif shape < 0.66:
        out = r.choice([f"{name.split()[0]}{r.choice(['straße', 'strasse', 'str.', 'weg', 'gasse', 'allee', 'platz', 'ring', 'ufer', 'straat', 'laan'])} {n}", f"{r.choice(['Am', 'An der', 'Im', 'Alte'])} {name} {n}"])
        if r.random() < 0.4:
            town = f"{_digits(r, 5)} {town}"
    elif shape < 0.76:
        out = f"{n}{r.choice(['', ','])} {r.choice('rue avenue boulevard chemin impasse place quai allée'.split())} {r.choice(['du ', 'de la ', 'des ', 'de ', 'd’', ''])}{name}"
    else:
        out = f"{r.choice('Rua Avenida Av. Travessa Largo Praça Calle Paseo Plaza Camino Via Viale Piazza Corso'.split())} {r.choice(['', 'das ', 'dos ', 'da ', 'do ', 'de ', 'del ', 'de la ', 'di '])}{name}{r.choice([' ', ', ', ', nº '])}{n}"
        if r.random() < 0.3:
            out += f", {r.randint(1, 12)}º{r.choice(['', ' izq.', ' dcha.', ' esq.', ' D', ' A'])}"
    if r.random() < 0.6:
        out += f"{r.choice([', ', ', ', ', ', ' '])}{town}" if not town[0].isdigit() else f", {town}"
        if r.random() < 0.1:
            out += " " + r.choice([_digits(r, 5), "".join(r.choice("ABCEHKLNSW") for _ in range(2)) + f"{r.randint(1, 20)} {r.randint(1, 9)}AB"])
    return out.upper() if r.random() < 0.03 else out


#: fixed values: things that are numbered
GOODS = "part order lot serial invoice ticket batch item model article build case issue version firmware ISBN SKU".split()


#: fixed values: nouns that make a name before them a product's
TECHNICAL = "Gateway Server Service Client Engine Library Parser Driver Plugin Protocol Framework Pipeline Adapter Scheduler Theme Toolkit Router Cache Module Index Queue".split()


def look_alike(r: random.Random, w: Words) -> str:
    """What only looks like personal data: numbered goods, versions, addresses of machines, code, products, headings."""
    d, word = lambda n: _digits(r, n), lambda: _word(r, w)
    cap = lambda: word().capitalize()
    mix = lambda n: "".join(r.choice("0123456789abcdef") for _ in range(n))
    parts = lambda sep, lo, hi, n: sep.join(d(r.randint(lo, hi)) for _ in range(r.randint(2, n)))
    goods = lambda: r.choice([str.lower, str.capitalize])(r.choice(GOODS)) + r.choice([" ", " ", " number ", " no. ", " #", ": "])
    tech = lambda: r.choice([*TECHNICAL, cap()])
    first = _full_name(r, w)[0]
    kinds = [
        [lambda: goods() + parts(r.choice("--./"), 1, 5, 4), lambda: goods() + parts("-", 2, 4, 3), lambda: goods() + parts(".", 1, 3, 4), lambda: goods() + chr(65 + r.randint(0, 25)) + d(r.randint(3, 7)), lambda: f"#{d(4)}", lambda: goods() + d(r.randint(4, 12))],
        [lambda: "v" + parts(".", 1, 3, 4), lambda: parts(".", 1, 3, 4) + ":" + d(4), lambda: f"20{d(2)}-0{d(1)}-1{d(1)}T0{d(1)}:{d(2)}:{d(2)}Z", lambda: f"{d(4)}x{d(4)}", lambda: f"{d(1)},{d(3)},{d(3)} bytes", lambda: f"{d(4)}-{d(5)} bytes", lambda: f"{d(13)} ms", lambda: f"-{d(2)}.{d(6)}, {d(2)}.{d(6)}", lambda: f"{d(4)}..{d(4)}"],
        [lambda: r.choice(["", "I", "sha ", "0x"]) + mix(r.choice([7, 8, 12, 16, 32, 40, 40])), lambda: f"{mix(8)}-{mix(4)}-{mix(4)}-{mix(4)}-{mix(12)}", lambda: "".join(r.choice("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/") for _ in range(r.randint(20, 70)))],
        [lambda: f"git@{word()}.{r.choice(['example', 'com', 'org'])}:{word()}/{word()}-{word()}.git", lambda: f"git@{word()}.{r.choice(['example', 'com', 'org'])}:{word()}/{word()}.git", lambda: f"from {word()}.{word()[:3]}", lambda: f"ssh://git@{word()}.{word()}.com/{word()}/{word()}", lambda: f"@{word()}/{word()}@{d(1)}.{d(1)}.{d(2)}", lambda: f"{word()}@{d(1)}.{d(2)}.{d(1)}", lambda: f"{word()}/{word()}@v{d(1)}", lambda: f"{word()}@sha256:{mix(24)}", lambda: f"{word()}@{r.choice(['localhost', word()])}"],
        [lambda: f"cc @{word()}-{word()}", lambda: f"@{word()}-{word()}", lambda: f"@{word()}{d(2)}", lambda: f"@{cap()}({word()} = {d(2)})", lambda: f"{d(2)} {word()} at {word()}.{word()}", lambda: f"{word()} at {word()} {word()}"],
        [lambda: f"the {first} {tech()}", lambda: f"The {first} {tech()}", lambda: f"{cap()} {tech()}", lambda: f"{first} {tech()} {d(1)}.{d(1)}", lambda: f"{first} {tech()}", lambda: f"{d(3)} {cap()} {tech()} {word()}"],
        [lambda: f"self.{word()}.{word()}_{word()}({word()}=True)", lambda: f"{word().upper()}_{word().upper()}_{d(2)}[{d(2)}] = {word()};", lambda: f'File "{word()}/{word()}.py", line {d(3)}, in {cap()}{cap()}', lambda: f"{cap()}{cap()}({word()}, {d(3)})", lambda: f"line {d(3)} of {cap()}{cap()}"],
        [lambda: f"{cap()} {cap()}", lambda: " ".join(word() for _ in range(r.randint(2, 5))).upper(), lambda: f"{cap()}, {d(2)} {word()}", lambda: f"{cap()} {d(2)} {word()}", lambda: f"{d(3)} {cap()} {word()}", lambda: f"{word()} {word()} {cap()} {word()} {d(3)} {cap()}", lambda: f"{cap()} {word()} {cap()}, {cap()} {word()}", lambda: f"## {cap()}\n{cap()} {word()}"],
    ]
    return r.choice(r.choice(kinds))()


VALUES = {"email": email, "phone": phone, "id_number": id_number, "street_address": street_address, "person_name": person_name}
#: fixed values: common cue words before each type; none at all is as frequent
CUES = {
    "email": "e-mail:|mail|contact|from|cc|author:|mailto:|to|user=|Reply-To:|write to|email".split("|"),
    "phone": "tel|tel.|Tel:|phone:|call|mobile:|fax|phone=|dial|SMS to|cell|WhatsApp|ring|at|number|text".split("|"),
    "id_number": "SSN|SSN:|CPF|CPF:|CNPJ|NIF|DNI|NIE|NINO|passport|passport no.|ID card|ID card no.|tax id|tax_id=|national id|id number|Passport:|PESEL|Ausweis|identity".split("|"),
    "street_address": "address:|lives at|based at|ship to|addr=|addr:|in|at|office:|deliver to".split("|"),
    "person_name": "cc|by|thanks to|--|author:|ask|from|Reviewed-by:|with|for|Best,|signed|said|and|obrigado a|gracias a|danke|merci à|Regards,".split("|"),
    "": "see|at|in|on|for|use|with|the".split("|"),
}


def _piece(texts: list[str], r: random.Random, most: int) -> str:
    """Up to ``most`` characters of one of the texts, from the start of a word on."""
    text = r.choice(texts)
    at = r.randrange(len(text))
    at = text.find(" ", at) + 1 if r.random() < 0.7 else text.find("\n", at) + 1
    piece = text[at : at + r.randint(0, most)]
    return piece[: piece.rfind(" ")] if " " in piece else piece


def _item(kind: str, r: random.Random, w: Words) -> list[tuple[str, str]]:
    """A value of ``kind`` ('' for a look-alike) with cue and marks, as (text, kind or '') in order."""
    value = VALUES[kind](r, w) if kind else look_alike(r, w)
    if " " in value and r.random() < 0.07:
        k = r.choice([m.start() for m in re.finditer(" ", value)])
        value = value[:k] + "\n" + value[k + 1 :]
    cue = r.choice(CUES[kind]) if r.random() < 0.5 else ""
    if kind == "id_number" and r.random() < 0.15:  # digits alone are one only by their cue
        value, cue = _digits(r, r.choice([8, 9, 10, 11, 11, 13])), cue or r.choice(CUES[kind])
    if cue and r.random() < 0.3:
        cue = cue[0].upper() + cue[1:]
    if cue and cue[-1] != "=":
        cue += r.choice(["", " "]) if cue[-1] == ":" else r.choice([" ", " ", " ", ": "])
    left, right = r.choice([("", "")] * 8 + [("(", ")"), ("<", ">"), ('"', '"'), ("[", "]"), ("`", "`") if not kind else ("", "")])
    tail = r.choice(["", "", "", ",", ".", ".", ";", ":"])
    out = [(cue + left, ""), (value, kind), (right, "")]
    if kind == "person_name" and r.random() < 0.5:  # a signature
        trailer = r.choice([f"{_word(r, w).capitalize()}-by: "] * 3 + ["", "-- ", "From: "])
        mail, call = email(r, w), phone(r, w)
        more = r.choice([[(" <", ""), (mail, "email"), (">", "")]] * 3 + [[(", ", ""), (mail, "email"), (r.choice([", tel. ", ", ", ", phone ", ", mobile "]), ""), (call, "phone")]] * 4 + [[(", ", ""), (mail, "email")], [(", ", ""), (mail, "email"), (r.choice([", ", ", tel. ", "\n"]), ""), (call, "phone")], [(" (", ""), (mail, "email"), (")", "")], [(r.choice([", ", " (", ": ", ", tel "]), ""), (call, "phone")]])
        return [(trailer, ""), (value, kind), *more, (tail, "")]
    return [*out, (tail, "")]


def planted(kinds: list[str], texts: list[str], r: random.Random, w: Words) -> tuple[str, list[tuple[int, int, str]]]:
    """A stretch of pieces of ``texts`` with values of ``kinds`` between them, and the spans of the values."""
    text, spans = _piece(texts, r, 90) if r.random() < 0.9 else "", []
    for kind in kinds:
        lead = r.choice([" ", " ", " ", ". ", "\n", "\n", "\n\n", "\n// ", "\n# ", "\n    // ", "\n * "]) if text else ""
        text += lead
        for part, name in _item(kind, r, w):
            if name:
                spans.append((len(text), len(text) + len(part), name))
            text += part
        text += r.choice([" ", " ", "\n", "\n\n", ""]) + _piece(texts, r, 70)
    return text, spans


def generated(n: int, texts: list[str], w: Words, seed: int = 5) -> list[tuple[str, list[tuple[int, int, str]]]]:
    """``n`` stretches with one to three planted values, look-alikes among them."""
    r = random.Random(seed)
    kinds = [*TYPES, *TYPES, "person_name", "phone", "id_number", "id_number", "", "", "", ""]
    return [planted([r.choice(kinds) for _ in range(r.choice([1, 1, 2, 2, 3]))], texts, r, w) for _ in range(n)]


def known_names(text: str, w: Words) -> list[tuple[int, int, str]]:
    """Places where a first and a last name of the author column stand side by side."""
    first, last = {n[0] for n in w.names}, {n[-1] for n in w.names}
    out = []
    for m in re.finditer(rf"(?<![\w@])([{UP}][^\W\d_]+),?[ \n](?:[{UP}]\.[ \n])?([{UP}][^\W\d_]+)(?!\w)", text):
        a, b = m.group(1), m.group(2)
        if (a in first and b in last) or (a in last and b in first and "," in m.group()):
            out.append((*m.span(), "person_name"))
    return out


# ---- training ------------------------------------------------------------------------------------------------------


def _labels(n: int, spans: list[tuple[int, int, str]]) -> np.ndarray:
    out = np.zeros(n, np.int32)
    for s, e, kind in spans:
        b = 1 + 2 * TYPES.index(kind)
        out[s:e] = b + 1
        out[s] = b
    return out


def _cut(text: str, spans: list[tuple[int, int, str]], r: random.Random) -> list[tuple[str, list[tuple[int, int, str]]]]:
    """The text in windows of ``TRAIN_WINDOW`` characters, from a place of chance on if it is longer, with the spans in them."""
    out = []
    for s in range(-r.randrange(TRAIN_WINDOW) if len(text) > TRAIN_WINDOW else 0, len(text), TRAIN_WINDOW):
        s, e = max(0, s), min(len(text), s + TRAIN_WINDOW)
        if text[s:e].strip():
            out.append((text[s:e], [(max(a, s) - s, min(b, e) - s, k) for a, b, k in spans if a < e and b > s]))
    return out


def _of_pieces(y: np.ndarray, bodies: np.ndarray) -> np.ndarray:
    return y[np.minimum(bodies, len(y) - 1)]


def _of_chars(n: int, path: np.ndarray, starts: np.ndarray, bodies: np.ndarray) -> np.ndarray:
    """Labels of characters from those of pieces; a blank before a piece belongs to it only inside a span."""
    out = np.zeros(n, np.int32)
    some = np.flatnonzero(path)
    ends = np.append(starts[1:], n) if len(some) else starts
    for k in some:
        label = int(path[k])
        if label % 2:
            out[bodies[k] : ends[k]] = label + 1
            out[bodies[k]] = label
        else:
            out[starts[k] : ends[k]] = label
    return out


def train(rows: list[tuple[str | None, str | None, str | None, str | None]], steps: tuple[int, ...] = ROUND_STEPS, inserted: int = INSERTED) -> Tagger:
    """Fit on ``rows`` (author_name, author_email, matched_expression, body_text); without texts, on invented sentences."""
    r = random.Random(17)
    bodies = [b for *_, b in rows if b]
    w = Words.of(bodies, [a for a, *_ in rows if a], [x[1] for x in rows if x[1]])
    names = {" ".join(n) for n in w.names}
    own = [(text, known_names(text, w), phrase) for *_, phrase, text in rows if text] + [(a, [(0, len(a), "person_name")] if a in names else [], None) for a, *_ in rows if a and r.random() < 0.3]
    loose = [(*x, phrase, k) for k, (text, spans, phrase) in enumerate(own) for x in _cut(text, spans, r)]
    loose_codes = encode_pieces([t for t, *_ in loose])
    told = [_labels(len(t), s) for t, s, *_ in loose]
    phrases = [[m.span() for m in re.finditer(re.escape(p.strip()).replace(r"\ ", r"\s+"), t, re.I)] if p and p.strip() else [] for t, _, p, _ in loose]
    invented = [" ".join(_invented(r) for _ in range(30)) + "." for _ in range(max(0, 200 - len(bodies)))]
    learnt: list[tuple[np.ndarray, np.ndarray]] = []
    held: set[int] = set()  # texts in which something was found
    tagger = Tagger(len(LABELS))
    for turn, (n, share) in enumerate(zip(steps, SHARES)):
        free = [t for k, (t, *_) in enumerate(own[: len(bodies)]) if k not in held] + invented
        sure = [x for text, spans in generated(inserted, free or bodies, w, 5 + turn) for x in _cut(text, spans, r)]
        shown = r.sample(learnt, min(len(learnt), int(share * len(sure))))
        pieces = encode_pieces([t for t, _ in sure])
        tagger.fit([c for c, *_ in pieces] + [c for c, _ in shown], [_of_pieces(_labels(len(t), s), b) for (t, s), (_, _, b) in zip(sure, pieces)] + [y for _, y in shown], n, sum(steps))
        if turn < len(steps) - 1:
            kept, wide = _decode_all(tagger, [t for t, *_ in loose], loose_codes, (SURE[0], -SURE[1]))
            for labels in (kept, wide):
                _correct([t for t, *_ in loose], labels, told, phrases, names | set(w.mails))
            learnt = [(c, _of_pieces(k, b)) for (c, _, b), k, x in zip(loose_codes, kept, wide) if k.any() or not x.any()]
            held = {k for (*_, k), x in zip(loose, wide) if x.any()}
    return tagger


def _wording(span: str) -> str:
    """Words of a span in lower case, digits as 0."""
    return " ".join(re.sub(r"\d", "0", span.lower()).split())


def _correct(texts: list[str], labels: list[np.ndarray], told: list[np.ndarray], phrases: list[list[tuple[int, int]]], known: set[str]) -> None:
    """Put told labels in, take labels off spans that touch the record's phrase or are common wording."""
    spans = [_spans(t, {int(at): (0, int(y[at])) for at in np.flatnonzero(y)}) for t, y in zip(texts, labels)]
    often = Counter(x for t, found in zip(texts, spans) for x in {_wording(t[s:e]) for s, e, _ in found})
    known = {k.lower() for k in known}
    for t, y, told_y, found, inside in zip(texts, labels, told, spans, phrases):
        for s, e, _ in found:
            words = _wording(t[s:e])
            wording = often[words] >= COMMON and words not in known and "@" not in words and re.search(r"[^\W\d_]{2}", words)
            if wording or any(a < e and b > s for a, b in inside):
                y[s:e] = 0
        y[:] = np.where(told_y > 0, told_y, y)


def _decode_all(tagger: Tagger, texts: list[str], pieces: list[tuple], against: tuple[float, ...] = ()) -> list[list[np.ndarray]]:
    """Labels of each text's characters; for each number of ``against`` once, which is added to the score of label O."""
    out: list[list] = [[None] * len(texts) for _ in against or (0,)]
    order = sorted(range(len(texts)), key=lambda k: len(pieces[k][0]))
    for lo in range(0, len(order), BATCH_WINDOWS):
        part = order[lo : lo + BATCH_WINDOWS]
        codes = pad([pieces[k][0] for k in part])
        if against:
            e = tagger.emissions(codes)
            paths = [tagger.paths(codes, e + np.eye(1, len(LABELS), dtype=np.float32)[0] * np.float32(b)) for b in against]
        else:
            paths = [tagger.decode(codes)]
        for path, labels in zip(paths, out):
            for j, k in enumerate(part):
                own, starts, bodies = pieces[k]
                labels[k] = _of_chars(len(texts[k]), path[: len(own), j], starts, bodies)
    return out


# ---- decoding ------------------------------------------------------------------------------------------------------


def _spans(text: str, own: dict[int, tuple[int, int]]) -> list[tuple[int, int, str]]:
    """Spans of the labelled characters of a text; ``own``: position to (depth, label).

    Runs of labels become spans, a span grows to the ends of its words, and pieces of one type with one blank or joint
    between them are joined. Of overlapping spans the longer stays.
    """
    runs: list[list[int]] = []
    for at in sorted(own):
        label = own[at][1]
        kind = (label - 1) // 2
        if runs and runs[-1][1] == at and (runs[-1][2] == kind) and label % 2 == 0:
            runs[-1][1] = at + 1
        else:
            runs.append([at, at + 1, kind])
    for run in runs:
        while run[0] > 0 and text[run[0] - 1].isalnum() and text[run[0]].isalnum():
            run[0] -= 1
        while run[1] < len(text) and text[run[1]].isalnum() and text[run[1] - 1].isalnum():
            run[1] += 1
    joined: list[list[int]] = []
    for s, e, kind in runs:
        last = joined[-1] if joined else None
        if last and s < last[1]:  # two runs in one word
            if e - s > last[1] - last[0]:
                last[2] = kind
            last[1] = max(e, last[1])
        elif last and kind == last[2] and s - last[1] <= 1:
            last[1] = e
        else:
            joined.append([s, e, kind])
    return [(s, e, TYPES[k]) for s, e, k in joined]


def find_spans(texts: list[str], tagger: Tagger) -> list[list[tuple[int, int, str]]]:
    """Reconciled spans of each text, in order, without overlap."""
    where: dict[str, list[tuple[int, int, int, int]]] = {}
    for i, t in enumerate(texts):
        windows = windows_of(t) if t else []
        for k, (s, e) in enumerate(windows):
            lo, hi = s + OVERLAP // 2 if k else s, e - OVERLAP // 2 if k < len(windows) - 1 else e
            where.setdefault(t[s:e], []).append((i, s, lo, hi))
    keys = list(where)
    found: dict[int, dict[int, tuple[int, int]]] = {}
    for key, tags in zip(keys, _decode_all(tagger, keys, encode_pieces(keys))[0]):
        at = np.flatnonzero(tags)
        if len(at):
            for i, s, lo, hi in where[key]:
                found.setdefault(i, {}).update((s + k, (0, int(tags[k]))) for k in at.tolist() if lo <= s + k < hi)
    out: list[list[tuple[int, int, str]]] = [[] for _ in texts]
    for i, own in found.items():
        out[i] = _spans(texts[i], own)
    return out


def mask(text: str | None, spans: list[tuple[int, int, str]]) -> str | None:
    if not spans:
        return text
    parts, at = [], 0
    for s, e, kind in spans:
        parts += [text[at:s], f"[{kind.upper()}]"]
        at = e
    return "".join([*parts, text[at:]])


def _scan(weights: bytes, masked: bool, names: bool = True):
    """Types and masked text of a column; without ``names``, a person's name is left as it is."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        tagger = Tagger.from_bytes(weights)
        for texts in batches:
            plain = [t if isinstance(t, str) else "" for t in texts]
            spans = [[x for x in s if names or x[2] != "person_name"] for s in find_spans(plain, tagger)]
            out = {"types": pd.Series([sorted({k for _, _, k in s}) for s in spans], dtype=object)}
            if masked:
                out["masked"] = pd.Series([mask(t if isinstance(t, str) else None, s) for t, s in zip(texts, spans)], dtype=object)
            yield pd.DataFrame(out)

    return F.pandas_udf(run, "types array<string>" + ", masked string" * masked)


def fit(occurrences: DataFrame, rows: int = TRAIN_ROWS, anew: bool = False) -> Tagger:
    """The tagger, trained on at most about ``rows`` rows with the smallest hashes.

    The weights are kept in the shared folder under a hash of sample, parameters and code, and read from there, unless
    ``anew``, which trains in any case.
    """
    columns = [c if c in occurrences.columns else F.lit(None).cast("string").alias(c) for c in ("author_name", "author_email", "matched_expression", "body_text")]
    own = occurrences.select(*columns, F.xxhash64("body_text", "artifact_id").alias("h")).where(F.col("body_text").isNotNull())
    total = own.count()
    if total > rows:
        own = own.where(F.col("h") < F.lit(int(-(2**63) + 2**64 * (rows / total))))
    sample = own.drop("h").distinct()
    code = b"".join(p.read_bytes() for p in map(Path, (__file__, __file__.replace("pii.py", "tagger.py"))) if p.exists())
    key = hashlib.sha256(repr((SHARES, ROUND_STEPS, INSERTED, fingerprint(sample))).encode() + code).hexdigest()[:32]
    return Tagger.from_bytes(remembered(occurrences.sparkSession, f"pii-{key}", lambda: _train_in_task(sample), anew))


def _train_in_task(sample: DataFrame) -> bytes:
    """The weights, trained by one task on the whole (bounded) sample; only they reach the driver."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = sorted(tuple(x or "" for x in row) for b in batches for row in b.itertuples(index=False, name=None))
        yield pd.DataFrame({"blob": [train(rows).to_bytes()]})

    done = sample.repartition(1).mapInPandas(run, "blob binary").collect()
    return bytes(done[0].blob) if done else train([]).to_bytes()


def found_types(occurrences: DataFrame, tagger: Tagger, key: list[str]) -> DataFrame:
    """(key..., field_name, pii_type), distinct."""
    weights = tagger.to_bytes()
    one = lambda name, names: occurrences.where(F.col(name).isNotNull()).select(*key, F.lit(name).alias("field_name"), _scan(weights, False, names)(F.col(name)).alias("s"))
    out = one("body_text", True).unionByName(one("author_name", False))
    return out.select(*key, "field_name", F.explode("s.types").alias("pii_type")).distinct()


def masked_table(occurrences: DataFrame, tagger: Tagger) -> DataFrame:
    """The table with body_text and author_name masked; a name in author_name stays."""
    weights = tagger.to_bytes()
    return occurrences.withColumn("body_text", _scan(weights, True)(F.col("body_text"))["masked"]).withColumn("author_name", _scan(weights, True, False)(F.col("author_name"))["masked"])
