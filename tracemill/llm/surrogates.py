"""Personal data replaced by keyed surrogates of the same type and form.

Detectors find e-mail addresses, phone numbers, IPv4 addresses, payment cards, US social security numbers, IBANs,
access keys, passwords and tokens, and persons named after a title. The surrogate of an entity is drawn from a keyed
hash of its type and canonical form, so every mention of it anywhere gets the same replacement (coreference); letters
stay letters of their case and script, digits stay digits, separators stay where they are, check digits are
computed, and first names keep the gender their title gives them, or another title gives them elsewhere.

Distinct entities must get distinct surrogates, and no surrogate may be an entity of the corpus. Both are checked
over the table of distinct entities; whoever collides draws again, until nothing collides. Where a form has few values
or all of them are in use, draws after the first ``LONGER`` are longer or from a wider range of the type, so they end.
Only those few carry an attempt number that is joined to the documents that mention them; all other surrogates are
computed in place.
"""

from __future__ import annotations

import hashlib
import hmac
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracemill.llm.common import merged, stage

# Titles by the gender they tell (empty: none).
TITLES = {
    "Mr": "m", "Mister": "m", "Sir": "m", "Herr": "m", "Herrn": "m", "Monsieur": "m", "Señor": "m", "Sr": "m", "Don": "m",
    "Mrs": "f", "Ms": "f", "Miss": "f", "Frau": "f", "Madame": "f", "Mme": "f", "Mlle": "f", "Señora": "f", "Sra": "f", "Doña": "f",
    "Dr": "", "Prof": "",
}
NAME = r"[^\W\d_][\w'’]*(?:-[^\W\d_][\w'’]*)*"
PATTERNS = {
    "email": r"(?<![\w.+-])[A-Za-z0-9](?:[A-Za-z0-9._%+-]*[A-Za-z0-9])?@(?:[A-Za-z0-9-]+\.)+[A-Za-z]{2,}(?![\w-])",
    "secret": r"\bAKIA[0-9A-Z]{16}\b",
    "assigned": r"(?<=password=)[^\s\"',;]+|(?<=token = \")[^\"\s]+(?=\")|(?<=token=)[^\s\"',;]+|(?<=secret=)[^\s\"',;]+",
    "iban": r"\b[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?\b",
    "card": r"(?<![\d.])\d(?:[ -]?\d){12,18}(?![\d])",
    "ssn": r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])",
    "phone": r"(?<![\w+])(?:\+\d{1,3}[ .-]?(?:\(\d{1,4}\)[ .-]?)?\d{2,4}(?:[ .-]?\d{2,4}){1,4}|\(\d{3}\) ?\d{3}-\d{4}|\d{3}[.-]\d{3}[.-]\d{4})(?!\w)",
    "ip": r"(?<![\d.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?![\d]|\.\d)",
    "person": rf"(?<=\b)(?:{'|'.join(sorted(TITLES, key=len, reverse=True))})\.?[ \u00a0]{NAME}(?:[ \u00a0]{NAME})?",
}
ENTITY = re.compile("|".join(f"(?P<{kind}>{pattern})" for kind, pattern in PATTERNS.items()))
#: What every entity holds, found fast; the detectors only look around these places.
ANCHOR = re.compile(rf"[0-9]+|@|=|\bAKIA|\b(?:{'|'.join(sorted(TITLES, key=len, reverse=True))})\b")
AROUND = 40
PERSON = re.compile(rf"(?P<title>{'|'.join(sorted(TITLES, key=len, reverse=True))})(?P<gap>\.?[ \u00a0])(?P<names>.*)", re.S)

# Syllables of surrogate names by script; female first names end in one of FEMALE_ENDS.
SYLLABLES = {
    "latin": "ba be bo da de do fa fe fi ga ge go ka ke ko la le li lo ma me mi mo na ne ni no pa pe po ra re ri ro sa se si so ta te to va ve vi".split(),
    "cyrillic": "ба бе бо да де до ка ке ко ла ле ли ло ма ме ми мо на не ни но па пе по ра ре ри ро са се си со та те то ва ве ви".split(),
    "greek": "βα βε βο δα δε δο κα κε κο λα λε λι λο μα με μι μο να νε νι νο πα πε πο ρα ρε ρι ρο σα σε σι σο τα τε το".split(),
}
ENDS = {"latin": ("n", "s", "r"), "cyrillic": ("н", "с", "р"), "greek": ("ν", "ς", "ρ")}
FEMALE_ENDS = {"latin": "a", "cyrillic": "а", "greek": "α"}
# What letters outside a-z, symbols of a password and the additions to short values are drawn from.
LETTERS = {"latin": "abcdefghijklmnopqrstuvwxyz", "cyrillic": "абвгдежзийклмнопрстуфхцчшщъыьэюя", "greek": "αβγδεζηθικλμνξοπρστυφχψω"}
SYMBOLS = "!#$%&*+-?^_~"
SENTENCE_END = ".!?:)]}>"
#: Attempts that keep the length of an entity; names get a syllable more with each.
LONGER = 4
#: The kinds of names; a person is one or more of them.
FIRST, FAMILY = "first", "family"
#: Attempt, and gender told elsewhere (null: its own), of entities by kind and canonical form.
Chosen = dict[tuple[str, str], tuple[int, str | None]]


def luhn_sum(digits: str) -> int:
    total = 0
    for place, digit in enumerate(reversed(digits)):
        value = int(digit) * (1 + place % 2)
        total += value - 9 if value > 9 else value
    return total


def _iban_number(text: str) -> int:
    moved = text[4:] + text[:4]
    return int("".join(str(int(c, 36)) for c in moved))


def _windows(text: str) -> Iterator[tuple[int, int]]:
    """Disjoint parts of a text that hold all entities, from word start to word end."""
    start = stop = -1
    for anchor in ANCHOR.finditer(text):
        a, b = anchor.span()
        if b + AROUND <= stop:
            continue
        begin = max(text.rfind(" ", 0, max(a - AROUND, 0)), 0)
        # Two words more: the names after a title may be long.
        end = text.find(" ", b + AROUND)
        end = text.find(" ", end + 1) if end >= 0 else end
        end = len(text) if end < 0 else end
        if begin > stop:
            if stop > 0:
                yield start, stop
            start = begin
        stop = end
    if stop > 0:
        yield start, stop


def find_entities(text: str | None) -> list[tuple[int, int, str, str]]:
    """(start, stop, type, canonical form) of the entities of a whole text, left to right."""
    found = []
    if not text:
        return found
    for match in (m for window in _windows(text) for m in ENTITY.finditer(text, *window)):
        kind, value = match.lastgroup, match[0]
        start, stop = match.span()
        if kind == "card":
            digits = re.sub(r"\D", "", value)
            if luhn_sum(digits) % 10 and len(digits) < 15:
                continue  # a long number without a check digit
            canonical = digits
        elif kind == "iban":
            canonical = value.replace(" ", "")
            if not 15 <= len(canonical) <= 34 or _iban_number(canonical) % 97 != 1:
                continue
        elif kind == "person":
            parts = PERSON.match(value)
            names = [n for n in re.split(r"[ \u00a0]", parts["names"]) if n]
            kept = [n for n in names if n[0].isupper()]
            if not kept or not names[0][0].isupper():
                continue
            if len(kept) < len(names):  # the second word is no name
                names = names[:1]
                stop = start + parts.start("names") + len(names[0])
            canonical = TITLES[parts["title"]] + "|" + " ".join(names)
        elif kind == "email":
            canonical = value.lower()
        elif kind == "phone":
            canonical = re.sub(r"[^\d+]", "", value)
        else:
            canonical = value
        found.append((start, stop, kind, canonical))
    return found


class Draw:
    """A stream of numbers from a keyed hash of an entity and its attempt."""

    def __init__(self, key: bytes, kind: str, canonical: str, attempt: int):
        self.key, self.seed, self.at, self.pool = key, f"{kind}\0{canonical}\0{attempt}".encode(), 0, b""

    def below(self, bound: int) -> int:
        if len(self.pool) < 8:
            self.pool += hmac.new(self.key, self.seed + self.at.to_bytes(4, "big"), hashlib.sha256).digest()
            self.at += 1
        value, self.pool = int.from_bytes(self.pool[:8], "big"), self.pool[8:]
        return value % bound


def _same_form(value: str, draw: Draw) -> str:
    """Letters of the same case and script, digits, and everything else unchanged; hexadecimal words stay hexadecimal."""
    hexadecimal = len(value) >= 8 and re.fullmatch(r"[0-9a-f]*[a-f][0-9a-f]*", value) is not None
    out = []
    for c in value:
        if hexadecimal:
            out.append("0123456789abcdef"[draw.below(16)])
        elif c.isdigit():
            out.append(str(draw.below(10)))
        elif "a" <= c <= "z":
            out.append(chr(97 + draw.below(26)))
        elif "A" <= c <= "Z":
            out.append(chr(65 + draw.below(26)))
        elif c.isalpha():
            letters = LETTERS[_script(c)]
            made = letters[draw.below(len(letters))]
            out.append(made.upper() if c.isupper() else made)
        else:
            out.append(c)
    return "".join(out)


def _more(draw: Draw, attempt: int) -> str:
    """What is added to a value whose own form is used up: nothing in the first attempts."""
    return "".join("abcdefghijklmnopqrstuvwxyz0123456789"[draw.below(36)] for _ in range(12 if attempt >= LONGER else 0))


def _password(value: str, draw: Draw, attempt: int) -> str:
    """Symbols are drawn too; the end of a sentence after a letter or digit stays."""
    body = value.rstrip(SENTENCE_END)
    if not any(c.isalnum() for c in body):
        body = value
    made = "".join(c if c.isalnum() else SYMBOLS[draw.below(len(SYMBOLS))] for c in _same_form(body, draw))
    return made + _more(draw, attempt) + value[len(body):]


def _script(word: str) -> str:
    point = ord(word[0])
    return "cyrillic" if 0x400 <= point < 0x530 else "greek" if 0x370 <= point < 0x400 else "latin"


def _name(word: str, gender: str, first: bool, draw: Draw, attempt: int) -> str:
    script = _script(word)
    syllables = SYLLABLES[script]
    made = "".join(syllables[draw.below(len(syllables))] for _ in range(2 + draw.below(2) + attempt))
    if first and gender == "f":
        made = made[:-1] + FEMALE_ENDS[script]
    elif first and gender == "m" or draw.below(2):
        made += ENDS[script][draw.below(3)]
    return made


def names_of(canonical: str) -> list[tuple[str, str, str]]:
    """(kind, canonical form, word) of each name of a person in canonical form (``gender|names``).

    Names are entities of their own, so a family or a first name alone refers to the same surrogate, drawn again or not.
    """
    gender, names = canonical.split("|", 1)
    *first, family = names.split(" ")
    return [(FIRST, f"{gender}|{word.casefold()}", word) for word in first] + [(FAMILY, family.casefold(), family)]


def person(canonical: str, key: bytes, chosen: Chosen) -> str:
    """The surrogate of a person: that of each name, in the letter case it is written in."""
    made = []
    for kind, name, word in names_of(canonical):
        attempt, told = chosen.get((kind, name), (0, None))
        gender = "" if kind == FAMILY else name.rsplit("|", 1)[0] if told is None else told
        drawn = f"{gender}|{word.casefold()}" if kind == FIRST else name
        plain = surrogate(kind, drawn, attempt, key)
        made.append(plain.upper() if word.isupper() and len(word) > 1 else plain[0].upper() + plain[1:])
    return " ".join(made)


def surrogate(kind: str, canonical: str, attempt: int, key: bytes) -> str:
    """The surrogate of an entity in canonical form; of a name (first names: ``gender|name``) in small letters."""
    # A first name draws one stem for each gender.
    draw = Draw(key, kind, canonical.rsplit("|", 1)[1] if kind == FIRST else canonical, attempt)
    if kind == "email":
        local, domain = canonical.split("@")
        labels = domain.split(".")
        # The top-level domain stays; the domain is drawn for itself, so addresses of one domain share one.
        within = Draw(key, "domain", domain, 0)
        return _same_form(local, draw) + _more(draw, attempt) + "@" + ".".join([*[_same_form(x, within) for x in labels[:-1]], labels[-1]])
    if kind == "ip":
        if attempt >= LONGER:  # of the reserved addresses, which no host has
            return ".".join([str(240 + draw.below(16)), *[str(draw.below(256)) for _ in range(3)]])
        first, *rest = canonical.split(".")
        if first in ("10", "127"):
            return ".".join([first, *[str(draw.below(256)) for _ in rest]])
        if canonical.startswith("192.168."):
            return f"192.168.{draw.below(256)}.{draw.below(256)}"
        return ".".join([str(11 + draw.below(100)), *[str(draw.below(256)) for _ in rest]])
    if kind == "card":
        body = canonical[0] + "".join(str(draw.below(10)) for _ in canonical[1:-1])
        check = -luhn_sum(body + "0") % 10
        if luhn_sum(canonical) % 10:  # the original has no valid check digit: neither has its surrogate
            check = (check + 1 + draw.below(9)) % 10
        return body + str(check)
    if kind == "ssn":
        if attempt >= LONGER:
            return f"{draw.below(1000):03d}-{draw.below(100):02d}-{draw.below(10_000):04d}"
        return f"{900 + draw.below(100)}-{10 + draw.below(90)}-{1000 + draw.below(9000)}"
    if kind == "iban":
        body = _same_form(canonical[4:], draw)
        return canonical[:2] + f"{98 - _iban_number(canonical[:2] + '00' + body) % 97:02d}" + body
    if kind == "phone":
        # Country code (after a plus: up to two digits) stays.
        kept = 3 if canonical.startswith("+") and not canonical.startswith("+1") else 2 if canonical.startswith("+") else 0
        more = 8 if attempt >= LONGER and len(canonical) - kept < 9 else 0
        return canonical[:kept] + "".join(str(draw.below(10)) for _ in range(len(canonical) - kept + more))
    if kind == "secret":
        return "AKIA" + "".join("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"[draw.below(32)] for _ in canonical[4:])
    if kind in (FIRST, FAMILY):
        gender, word = canonical.rsplit("|", 1) if kind == FIRST else ("", canonical)
        return _name(word, gender, kind == FIRST, draw, attempt).casefold()
    return _password(canonical, draw, attempt)


def dressed(value: str, kind: str, made: str) -> str:
    """A surrogate in the form its entity was written in: separators, spaces, case, title."""
    if kind == "person":
        parts = PERSON.match(value)
        gap = "\u00a0" if "\u00a0" in parts["names"] else " "
        return parts["title"] + parts["gap"] + made.replace(" ", gap)
    if kind == "email":
        size = value.index("@")  # of the surrogate the local part may be longer
        more = made.index("@") - size
        kept = made[:size] + made[size + more:]
        cased = "".join(m.upper() if v.isupper() and m.isalpha() else m for v, m in zip(value, kept, strict=True))
        return cased[:size] + made[size:size + more] + cased[size:]
    if kind in ("card", "phone", "iban"):
        letters = iter(made.lstrip("+"))
        return "".join([*[next(letters) if c.isalnum() else c for c in value], *letters])
    return made


def replace_entities(text: str | None, key: bytes, chosen: Chosen | None = None) -> tuple[str | None, int]:
    """The text with surrogates, and the number of replacements."""
    found = find_entities(text)
    if not found:
        return text, 0
    out, at, chosen = [], 0, chosen or {}
    for start, stop, kind, canonical in found:
        if kind == "person":
            made = person(canonical, key, chosen)
        else:
            made = surrogate(kind, canonical, chosen.get((kind, canonical), (0, None))[0], key)
        out += [text[at:start], dressed(text[start:stop], kind, made)]
        at = stop
    return "".join([*out, text[at:]]), len(found)


def _row_key() -> Column:
    """A key of a row by id and text: rows without id, and texts that share an id, stay apart.

    Two rows that share a key by chance only share their tables of redrawn entities, which hold for every row.
    """
    return F.xxhash64("doc_id", "text").alias("key")


def mentions(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(``key`` of the row, ``kind``, ``canonical``) of the distinct entities of every row, names of persons one by one."""
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text")).select(_row_key(), "text")

    def parts(kind: str, canonical: str) -> list[tuple[str, str]]:
        return [name[:2] for name in names_of(canonical)] if kind == "person" else [(kind, canonical)]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [(row, *entity) for row, text in zip(batch["key"], batch["text"], strict=True)
                     for entity in sorted({part for _, _, kind, canonical in find_entities(text) for part in parts(kind, canonical)})]
            yield pd.DataFrame(found, columns=["key", "kind", "canonical"])

    return rows.mapInPandas(run, "key bigint, kind string, canonical string")


def _word() -> Column:
    """What a surrogate must not equal: a first name without its gender, anything else as it is."""
    return F.when(F.col("kind") == FIRST, F.substring_index("canonical", "|", -1)).otherwise(F.col("canonical"))


def told_genders(entities: DataFrame) -> DataFrame:
    """(``kind``, ``canonical``, ``told``) of first names after a title of no gender that one with a gender goes with elsewhere.

    They take the surrogate of that gender. A name told both ways takes one of them, the same everywhere.
    """
    gender = F.substring_index("canonical", "|", 1)
    firsts = entities.where(F.col("kind") == FIRST).select("kind", "canonical", gender.alias("gender"), _word().alias("word"))
    known = firsts.where("gender <> ''").groupBy("word").agg(F.max("gender").alias("told"))
    return firsts.where("gender = ''").join(known, "word").select("kind", "canonical", "told", F.concat("told", F.lit("|"), "word").alias("as"))


def _collisions(drawn: DataFrame) -> DataFrame:
    """Entities that must draw again: all but the first of those with one surrogate, and those whose surrogate exists."""
    holders = drawn.groupBy("kind", "made").agg(F.count("*").alias("n"), F.min("canonical").alias("holder"))
    shared = drawn.join(holders.where("n > 1").drop("n"), ["kind", "made"]).where("canonical <> holder")
    real = drawn.select("kind", _word().alias("made")).distinct()
    taken = drawn.join(real, ["kind", "made"], "left_semi")
    return shared.select("kind", "canonical").unionAll(taken.select("kind", "canonical")).distinct()


def assign(entities: DataFrame, key: bytes) -> DataFrame:
    """(``kind``, ``canonical``, ``attempt``) of the entities whose first draw collides, drawn until none does."""

    def draw(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            made = [surrogate(k, c, a, key) for k, c, a in zip(batch["kind"], batch["canonical"], batch["attempt"], strict=True)]
            yield batch.assign(made=made)

    schema = "kind string, canonical string, attempt int, made string"
    current = stage(entities.withColumn("attempt", F.lit(0)).mapInPandas(draw, schema), "surrogates")
    while True:
        again = stage(_collisions(current), "collisions")
        if again.isEmpty():
            return current.where("attempt > 0").select("kind", "canonical", "attempt")
        marked = current.join(again.withColumn("again", F.lit(1)), ["kind", "canonical"], "left")
        current = stage(marked.select("kind", "canonical", (F.col("attempt") + F.coalesce("again", F.lit(0))).alias("attempt"))
                        .mapInPandas(draw, schema), "surrogates")


def pseudonymise(docs: DataFrame, key: bytes, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(``doc_id``, ``text`` with surrogates, ``n_entities``) of every row.

    * null texts stay null, empty ones empty; texts without entities are unchanged; long texts are read whole
    * the same entity gets the same surrogate in every row, repeated rows and rows without id included; the result
      depends on the key and on the set of entities only
    * an empty table gives an empty result; other columns, whatever their names, are not read
    """
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    named = stage(mentions(docs, id_col, text_col), "mentions")
    entities = stage(named.select("kind", "canonical").distinct(), "entities")
    told = stage(told_genders(entities), "told-genders")
    redrawn = stage(assign(entities.join(told, ["kind", "canonical"], "left_anti"), key), "redrawn")
    same = told.join(redrawn.select(F.col("kind").alias("of"), F.col("canonical").alias("drawn_as"), "attempt"),
                     (F.col("kind") == F.col("of")) & (F.col("as") == F.col("drawn_as")), "left")
    chosen = redrawn.withColumn("told", F.lit(None).cast("string")).unionByName(
        same.select("kind", "canonical", F.coalesce("attempt", F.lit(0)).alias("attempt"), "told"))
    special = named.join(stage(chosen, "chosen"), ["kind", "canonical"]).groupBy("key").agg(
        F.collect_set(F.struct("kind", "canonical", "attempt", "told")).alias("redrawn"))
    joined = rows.withColumn("key", _row_key()).join(merged(stage(special, "special")), "key", "left").select("doc_id", "text", "redrawn")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            made = []
            for text, found in zip(batch["text"], batch["redrawn"], strict=True):
                chosen = {(r["kind"], r["canonical"]): (r["attempt"], r["told"]) for r in found} if found is not None else None
                made.append(replace_entities(text, key, chosen))
            yield pd.DataFrame({"doc_id": batch["doc_id"], "text": [m[0] for m in made], "n_entities": [m[1] for m in made]})

    return joined.mapInPandas(run, f"doc_id {dict(rows.dtypes)['doc_id']}, text string, n_entities bigint")
