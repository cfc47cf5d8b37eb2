"""PII surrogates: detected entities get keyed replacements of their own type, format, script and gender.

1. Detection in whole texts: e-mail addresses, telephone numbers, IPv4 and IPv6
   addresses, payment cards, IBANs, social security numbers, MAC addresses,
   secrets (values of key, token or password assignments, and keys with a
   known prefix), and names after a form of address, a phrase or field that
   introduces a person, an initial, or a listed first name. Numbers without a layout of
   their own are telephone numbers after a word that says so. Once a document names
   a person so, every capitalised mention of either name in it is that person's.
2. Each mention has a canonical form (digits of a number, lower case of an
   address or name), so mentions of one entity in other formats, in any document, corefer.
   A given name is one entity whatever the forms of address; its gender is what they say over all documents.
3. Each distinct entity draws a surrogate by HMAC of the secret key, its type
   and its canonical form: digits for digits, letters for letters, of the
   mention's script; given names by gender; check digits are right where the entity's are.
4. Collision checks over all distinct entities: a surrogate that another entity
   has, or that is itself an entity of the corpus, is drawn anew, until every
   surrogate is unique; given and family names are one space. So distinct entities stay distinct. After a few draws in
   too small a space (say two digits) surrogates get longer; addresses, cards and
   IBANs can't, so it is an error when their entities outnumber the format's values.
5. Each mention is replaced in its own format: separators, case and punctuation stay.

Defined cases: a null text stays null; a text without entities stays as it is;
documents without doc_id are treated as all others; repeated rows get the same
text; other columns stay, whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import hmac
import ipaddress
import re
import string
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import pieces
from .state import dropped, fresh, settled, written

# Forms of address and common first names by gender, and surnames to draw from, by script.
TITLES_M = "Mr Mister Sir Herr Monsieur Señor Sr Signor Don"
TITLES_F = "Mrs Ms Miss Mme Madame Mlle Frau Señora Señorita Sra Srta Signora Doña Lady"
TITLES_N = "Dr Prof Professor"
FIRST_M = "James John Robert Michael William David Thomas Peter Paul Daniel Martin Richard Joseph Charles Christopher Matthew Anthony Andrew Steven Kevin Brian George Edward Henry Hans Klaus Jürgen Wolfgang Stefan Andreas Uwe Pierre Jean Jacques Michel François Philippe Carlos Juan José Luis Miguel Antonio Javier Pedro Иван Сергей Дмитрий Алексей Николай Νίκος Γιώργος"
FIRST_F = "Mary Patricia Jennifer Linda Elizabeth Susan Sarah Anna Maria Laura Julia Emma Barbara Jessica Karen Nancy Margaret Helen Emily Alice Ursula Monika Petra Sabine Claudia Heike Marie Sophie Camille Isabelle Nathalie Claire Carmen Lucía Ana Elena Rosa Isabel Pilar Мария Анна Ольга Елена Наталья Μαρία Ελένη"
#: Words before a name, and fields that hold one.
BEFORE = "My name is|my name is|Name is|I am called|Dear|Sincerely,|Regards,|Mein Name ist|mein Name ist|Ich heiße|ich heiße|Liebe|Lieber|Je m'appelle|je m'appelle|Chère|Cher|Me llamo|me llamo|Mi nombre es|mi nombre es|Estimado|Estimada"
FIELDS = "Name|name|Full name|Contact|Patient|Customer|Employee|Nom|Nombre|Kunde|Имя"
#: Words before a telephone number.
PHONES = "tel|telephone|phone|mobile|cell|fax|call|telefon|handy|téléphone|teléfono|móvil"
DRAW_M = {"latin": "Adrian Bruno Conrad Dominic Edgar Felix Gregor Hugo Ivo Jasper Kilian Leon Marius Nestor Oscar Quentin Rufus Silvan Tristan Victor", "cyrillic": "Аркадий Богдан Вадим Глеб Захар Кирилл Лев Макар Назар Роман", "greek": "Ανδρέας Βασίλης Θάνος Κώστας Λευτέρης Μάριος Πέτρος Στέλιος"}
DRAW_F = {"latin": "Adela Bianca Clara Dora Edith Flora Greta Hilda Irma Judith Klara Livia Mona Nora Olivia Paula Ruth Silvia Tessa Vera", "cyrillic": "Алла Вера Галина Дина Жанна Зоя Инна Лидия Нина Раиса", "greek": "Αγγελική Βάσω Δήμητρα Ζωή Ιωάννα Κατερίνα Λένα Σοφία"}
SYLLABLES = {"latin": "bar ben dor fal gar hol kel lan mar nor pel ros sel tor val wen".split(), "cyrillic": "бар вен дор гал кор лан мар нов пет рос сел тор".split(), "greek": "βαρ δορ γαλ κορ λαν μαρ νικ πετ ροσ σελ τορ φαν".split()}
UPPER = r"A-ZÀ-ÖØ-ÞĀ-ŽА-ЯЁΑ-ΩΆΈΉΊΌΎΏ"
NAME_PART = rf"[{UPPER}][^\W\d_]+(?:[-'’][{UPPER}][^\W\d_]+)*"

PATTERNS = {
    "email": r"[\w.%+\-]+@[\w\-]+(?:\.[\w\-]+)*\.[^\W\d_]{2,}",
    "secret": r"(?i:(?:api[_-]?key|access[_-]?key|secret|token|password|passwd|pwd|bearer|auth(?:orization|[_-]?token)?)[\"']?\s*(?:[:=]|:=|=>)\s*[\"']?)(?P<secret_value>(?=[^\s\"'<>,;]*\d|[^\s\"'<>,;]{20})[^\s\"'<>,;]{6,})",
    "key": r"\b(?:AKIA[0-9A-Z]{16}|gh[pousr]_[0-9A-Za-z]{20,}|sk-[0-9A-Za-z_\-]{20,}|xox[abprs]-[0-9A-Za-z\-]{10,}|AIza[0-9A-Za-z_\-]{30,}|glpat-[0-9A-Za-z_\-]{16,})",
    "iban": r"\b[A-Z]{2}\d{2}(?:[ ]?[A-Z0-9]{4}){2,7}(?:[ ]?[A-Z0-9]{1,3})?\b",
    "called": rf"\b(?i:{PHONES})\b[.:]{{0,2}}[ ]?(?i:no\.?|number|nr\.?)?[:]?[ ]?(?P<called_value>(?:\+|\b)\d[\d \-./()]{{4,18}}\d)\b",
    "mac": r"\b[0-9A-Fa-f]{2}(?:[:-][0-9A-Fa-f]{2}){5}\b",
    "ipv6": r"(?<![\w:])(?:[0-9A-Fa-f]{1,4}:){3,7}(?::?[0-9A-Fa-f]{1,4})+(?![\w:])",
    "ipv4": r"(?<!\d)(?<!\d\.)(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?!\.?\d)",
    "card": r"(?<!\d)(?<!\d[.\-])(?:\d{4}[ \-]\d{4}[ \-]\d{4}[ \-]\d{1,7}|\d{4}[ \-]\d{6}[ \-]\d{5}|\d{13,19})(?!\d|-\d)",
    "ssn": r"(?<![\d\-])\d{3}-\d{2}-\d{4}(?![\d\-])",
    "phone": r"(?<![\w+])(?:\+\d{1,3}[ .\-/]?)?(?:\(\d{1,4}\)[ .\-/]?)\d{2,4}(?:[ .\-/]?\d{2,4}){1,4}(?!\w|-\d)|(?<![\w+])\+\d{1,3}(?:[ .\-/]?\d{2,4}){2,5}(?!\w|-\d)|(?<!\w)(?<!\d[.\-])\d{3}[ .\-]\d{3}[ .\-]\d{4}(?!\w|-\d)|(?<!\w)(?<!\d[.\-])0\d{2,4}[ /\-]\d{4,8}(?:[ \-]\d{2,5})?(?!\w|-\d)",
}
NUMBERS = re.compile("|".join(f"(?P<{k}>{p})" for k, p in PATTERNS.items()))
_title = "|".join((TITLES_M + " " + TITLES_F + " " + TITLES_N).split())
_first = "|".join((FIRST_M + " " + FIRST_F).split())
_told = rf"(?:(?:{BEFORE})[ \n]|(?:{FIELDS}):[ ])(?P<told>{NAME_PART}[ ]{NAME_PART})"
NAMES = re.compile(
    rf"\b(?=[{UPPER}])(?:(?P<title>{_title})\.?[ ](?P<name>{NAME_PART}(?:[ ]{NAME_PART})?)|{_told}"
    rf"|(?P<given>{_first})[ ](?:[{UPPER}]\.[ ])?(?P<family>{NAME_PART})|(?<![.!?] )[{UPPER}]\.[ ]?(?:[{UPPER}]\.[ ]?)?(?P<initialled>{NAME_PART})(?=[ ](?:said|says|wrote|told|asked|replied)\b))\b"
)
TOLD = re.compile(rf"\b{_told}\b")
#: Texts with one of these may introduce a person after a small letter.
INTRODUCTIONS = [x for x in (BEFORE + "|" + FIELDS).split("|") if x[0].islower()]
WORDS = re.compile(rf"\b{NAME_PART}\b")
#: A text without any of these has no entity but names.
HINT, KEY_STARTS = re.compile(r"[@\d:=_]"), ("AKIA", "AIza", "sk-", "xox", "glpat-")

_man, _woman = frozenset(FIRST_M.split()), frozenset(FIRST_F.split())
_title_m, _title_f = frozenset(TITLES_M.split()), frozenset(TITLES_F.split())


@dataclass(frozen=True)
class Mention:
    start: int
    end: int
    kind: str
    canon: str
    gender: str = ""


def script_of(text: str) -> str:
    for c in text:
        if "Ͱ" <= c <= "Ͽ" or "ἀ" <= c <= "῿":
            return "greek"
        if "Ѐ" <= c <= "ӿ":
            return "cyrillic"
    return "latin"


def _persons(text: str) -> list[Mention]:
    """Given and family names where something says that a person is named, and then all their other capitalised mentions in the text."""
    found: list[Mention] = []
    told = TOLD.finditer(text) if any(x in text for x in INTRODUCTIONS) else ()
    for m in (*NAMES.finditer(text), *told):
        gender, held = "", m.groupdict()
        if held.get("initialled"):
            found.append(Mention(*m.span("initialled"), "family", m["initialled"].lower()))
            continue
        if held.get("title"):
            gender = "m" if m["title"] in _title_m else "f" if m["title"] in _title_f else ""
        group = "name" if held.get("title") else "told" if held["told"] else ""
        parts = m[group].split(" ") if group else [m["given"], m["family"]]
        at, last = (m.start(group), m.end(group)) if group else (m.start("given"), m.end("family"))
        if len(parts) == 2:
            gender = gender or ("m" if parts[0] in _man else "f" if parts[0] in _woman else "")
            found.append(Mention(at, at + len(parts[0]), "given", parts[0].lower(), gender))
        found.append(Mention(last - len(parts[-1]), last, "family", parts[-1].lower()))
    if found:
        kinds: dict[str, str] = {}
        for m in found:
            kinds.setdefault(m.canon, m.kind)
        taken = {m.start for m in found}
        for m in WORDS.finditer(text):
            kind = kinds.get(m[0].lower())
            if kind and m.start() not in taken:
                found.append(Mention(*m.span(), kind, m[0].lower()))
    return found


def mentions(text: str | None) -> list[Mention]:
    """Entities of a text in order; where two overlap, the earlier one."""
    if not text:
        return []
    found: list[Mention] = []
    if HINT.search(text) or any(k in text for k in KEY_STARTS):
        for m in NUMBERS.finditer(text):
            kind = m.lastgroup
            if m["secret"]:
                found.append(Mention(*m.span("secret_value"), "secret", m["secret_value"]))
            elif m["called"]:
                found.append(Mention(*m.span("called_value"), "phone", "+" * m["called_value"].startswith("+") + re.sub(r"\D", "", m["called_value"])))
            elif kind == "key":
                found.append(Mention(*m.span(), "secret", m[0]))
            elif kind == "email":
                found.append(Mention(*m.span(), kind, m[0].lower()))
            elif kind in ("ipv6", "mac", "iban"):
                found.append(Mention(*m.span(), kind, re.sub(r"[ \-]", "" if kind != "mac" else ":", m[0]).lower()))
            elif kind == "ipv4":
                found.append(Mention(*m.span(), kind, str(ipaddress.ip_address(".".join(str(int(x)) for x in m[0].split("."))))))
            else:
                found.append(Mention(*m.span(), kind, "+" * m[0].startswith("+") + re.sub(r"\D", "", m[0])))
    found += _persons(text)
    found.sort(key=lambda m: (m.start, -m.end))
    out: list[Mention] = []
    for m in found:
        if not out or m.start >= out[-1].end:
            out.append(m)
    return out


class Stream:
    """Keyed numbers for one entity and draw."""

    def __init__(self, key: bytes, kind: str, canon: str, draw: int):
        self.seed, self.count, self.pool = hmac.new(key, f"{kind}\0{canon}\0{draw}".encode(), hashlib.sha256).digest(), 0, b""

    def below(self, n: int) -> int:
        if len(self.pool) < 4:
            self.pool += hashlib.sha256(self.seed + self.count.to_bytes(4, "big")).digest()
            self.count += 1
        value, self.pool = int.from_bytes(self.pool[:4], "big"), self.pool[4:]
        return value % n

    def pick(self, choices: str | list[str]) -> str:
        return choices[self.below(len(choices))]


def _like(c: str, s: Stream) -> str:
    if c.isdigit():
        return s.pick(string.digits)
    if not c.isalpha():
        return c
    if "а" <= c.lower() <= "я":
        new = s.pick("абвгдежзиклмнопрстуфхцчшэюя")
    elif "α" <= c.lower() <= "ω":
        new = s.pick("αβγδεζηθικλμνξοπρστυφχψω")
    else:
        new = s.pick(string.ascii_lowercase)
    return new.upper() if c.isupper() else new


def surrogate(kind: str, canon: str, key: bytes, draw: int = 0, gender: str = "") -> str:
    """The canonical surrogate of an entity; later draws differ, and from the fourth on they get longer where the format allows."""
    s, longer = Stream(key, kind, canon, draw), max(0, draw - 3)
    if kind == "email":
        local, _, domain = canon.partition("@")
        name = "".join(_like(c, s) for c in local) + "".join(s.pick(string.ascii_lowercase) for _ in range(longer))
        *labels, top = domain.split(".")
        return f"{name}@{'.'.join(''.join(_like(c, s) for c in x) for x in labels)}.{top}"
    if kind == "given":
        script = script_of(canon)
        names = [*(DRAW_M[script].split() if gender != "f" else []), *(DRAW_F[script].split() if gender != "m" else [])]
        extra = "".join(f"-{s.pick(names)}" for _ in range(longer + (draw > 0)))
        return (s.pick(names) + extra).lower()
    if kind == "family":
        parts = SYLLABLES[script_of(canon)]
        return "".join(s.pick(parts) for _ in range(max(2, min(4, len(canon) // 3)) + longer))
    if kind == "ipv4":
        return ".".join(str(1 + s.below(254)) for _ in range(4))
    if kind in ("ipv6", "mac"):
        return "".join(s.pick("0123456789abcdef") if c != ":" else c for c in canon)
    if kind == "iban":
        body = "".join(_like(c, s) for c in canon[4:])
        return canon[:2] + (iban_digits(canon[:2], body) if iban_digits(canon[:2], canon[4:]) == canon[2:4] else "".join(_like(c, s) for c in canon[2:4])) + body
    if kind == "card":
        body = canon[0] + "".join(s.pick(string.digits) for _ in canon[1:-1])
        return body + str(luhn_digit(body)) if luhn_digit(canon[:-1]) == int(canon[-1]) else body + str((luhn_digit(body) + 1 + s.below(9)) % 10)
    if kind == "secret":
        hexed = all(c in string.hexdigits for c in canon)
        return "".join((s.pick("0123456789abcdef") if c.islower() or c.isdigit() else s.pick("0123456789ABCDEF")) if hexed else _like(c, s) for c in canon) + "".join(s.pick(string.digits) for _ in range(longer))
    fixed = 0 if canon[0] != "+" else 2 if canon[1] in "17" else 3  # a country's code, or the zero before an area's
    fixed = fixed or int(canon[0] == "0")
    return canon[:fixed] + "".join(s.pick(string.digits) for _ in canon[fixed:]) + "".join(s.pick(string.digits) for _ in range(longer))


def luhn_digit(body: str) -> int:
    total = sum(sum(divmod(int(c) * 2, 10)) if i % 2 == 0 else int(c) for i, c in enumerate(reversed(body)))
    return -total % 10


def iban_digits(country: str, body: str) -> str:
    """The check digits of an account's body, by ISO 7064 modulo 97-10."""
    return f"{98 - int(''.join(str(int(c, 36)) for c in body + country) + '00') % 97:02d}"


def styled(kind: str, mention: str, new: str) -> str:
    """The canonical surrogate in the format of a mention."""
    if kind in ("phone", "card", "ssn", "iban", "mac"):
        digits, out = iter(new.replace(":", "").replace("+", "")), []
        for c in mention:
            if c.isalnum():
                d = next(digits, "")
                out.append(d.upper() if c.isupper() or kind == "iban" else d)
            else:
                out.append(c)
        return "".join(out) + "".join(digits)
    if kind in ("given", "family"):
        return new.upper() if mention.isupper() and len(mention) > 1 else "-".join(p[:1].upper() + p[1:] for p in new.split("-"))
    if kind == "email" and mention != mention.lower():
        return "".join(n.upper() if i < len(mention) and mention[i].isupper() else n for i, n in enumerate(new))
    return new.upper() if kind == "ipv6" and mention.isupper() else new


def entities(docs: DataFrame) -> DataFrame:
    """(row_key, kind, canon, m, f): the distinct entities of each document, and whether it speaks of a man or a woman there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text"):
            keys, held = [], []
            for key, text in zip(batch.column("row_key").to_pylist(), batch.column("text"), strict=True):
                genders: dict[tuple[str, str], set[str]] = {}
                for m in mentions(text.as_py()):
                    genders.setdefault((m.kind, m.canon), set()).add(m.gender)
                keys += [key] * len(genders)
                held += [(*k, "m" in g, "f" in g) for k, g in sorted(genders.items())]
            kinds = (pa.string(), pa.string(), pa.bool_(), pa.bool_())
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), *[pa.array([x[i] for x in held], t) for i, t in enumerate(kinds)]], ["row_key", "kind", "canon", "m", "f"])

    return docs.mapInArrow(run, "row_key long, kind string, canon string, m boolean, f boolean")


ENTITY = "space string, kind string, canon string, gender string"


def drawn(found: DataFrame, key: bytes, draw: int) -> DataFrame:
    """found (ENTITY) with its surrogate of this draw."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            new = [surrogate(k, c, key, draw, g) for k, c, g in zip(*[batch.column(x).to_pylist() for x in ("kind", "canon", "gender")], strict=True)]
            yield batch.append_column("new", pa.array(new, pa.string()))

    return found.select(*[x.split()[0] for x in ENTITY.split(", ")]).mapInArrow(run, ENTITY + ", new string")


def assign(found: DataFrame, key: bytes, max_draws: int = 60) -> DataFrame:
    """(ENTITY, new) for the entities (kind, canon, m, f), with every `new` unique in its space and no entity itself.

    Of entities that draw the same surrogate, the one with the smallest canonical form keeps it.
    """
    gender = F.when(F.bool_or("m") & ~F.bool_or("f"), "m").when(F.bool_or("f") & ~F.bool_or("m"), "f").otherwise("").alias("gender")
    space = F.when(F.col("kind").isin("given", "family"), "name").otherwise(F.col("kind")).alias("space")
    waiting = found = written(found.groupBy("kind", "canon").agg(gender).select(space, "kind", "canon", "gender"), "pii-entities")
    done = None
    for draw in range(max_draws):
        made = written(drawn(waiting, key, draw), "pii-drawn")
        free = made.join(found.select("space", F.col("canon").alias("new")).distinct(), ["space", "new"], "left_anti")
        if done is not None:
            free = free.join(done.select("space", "new"), ["space", "new"], "left_anti")
        first = free.groupBy("space", "new").agg(F.min(F.struct("canon", "kind", "gender")).alias("e")).select("space", "e.kind", "e.canon", "e.gender", "new")
        good = written(first if done is None else done.unionByName(first), "pii-surrogates")
        rest = written(waiting.join(good.select("kind", "canon"), ["kind", "canon"], "left_anti"), "pii-waiting")
        dropped(made, *[x for x in (done, waiting) if x is not None and x is not found])
        done, waiting = good, rest
        if waiting.isEmpty():
            return done
    raise ValueError(f"no unique surrogates after {max_draws} draws; entities of one format outnumber the format's values")


def replaced(text: str, new: dict[tuple[str, str], str]) -> tuple[str, int]:
    parts, at, n = [], 0, 0
    for m in mentions(text):
        parts += [text[at : m.start], styled(m.kind, text[m.start : m.end], new[m.kind, m.canon])]
        at, n = m.end, n + 1
    return "".join([*parts, text[at:]]), n


def pseudonymise(docs: DataFrame, key: bytes) -> DataFrame:
    """The columns of docs, `text` with surrogates for all entities, and last the number of mentions.

    A document's entities and its text meet in one sorted partition, entities first, so a task holds the map of one document.
    """
    (count,) = fresh(docs, "_mentions")
    own = F.coalesce(docs["doc_id"].cast("long"), F.xxhash64(docs["text"]))
    made = settled(lambda: _mapped(entities(docs.select(own.alias("row_key"), docs["text"].alias("text"))), key), "pii-maps")
    doc = F.struct(*[docs[c] for c in docs.columns])
    rows = docs.select(own.alias("row_key"), *[F.lit(None).cast("string").alias(c) for c in ("kind", "canon", "new")], doc.alias("doc"))
    both = rows.unionByName(made.withColumn("doc", F.lit(None).cast(rows.schema["doc"].dataType))).repartition("row_key").sortWithinPartitions("row_key", F.col("kind").isNull())
    schema = docs.withColumn(count, F.lit(0).cast("long")).schema
    at, names = docs.columns.index("text"), [f.name for f in schema]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, new = None, {}
        for batch in batches:
            is_doc = batch.column("kind").is_null().to_numpy(zero_copy_only=False)
            columns = batch.filter(pa.array(is_doc)).column("doc").flatten()
            texts, counts, changed = columns[at], np.zeros(int(is_doc.sum()), np.int64), {}
            keys, row = batch.column("row_key").to_numpy(), -1
            parts = [batch.column(c) for c in ("kind", "canon", "new")]
            for i, k in enumerate(keys.tolist()):
                if k != last:
                    last, new = k, {}
                if not is_doc[i]:
                    kind, canon, value = (c[i].as_py() for c in parts)
                    new[kind, canon] = value
                    continue
                row += 1
                if new and texts[row].is_valid:
                    changed[row], counts[row] = replaced(texts[row].as_py(), new)
            if changed:
                runs, start = [], 0
                for row, value in changed.items():
                    runs += [texts.slice(start, row - start), pa.array([value], texts.type)]
                    start = row + 1
                columns[at] = pa.concat_arrays([*runs, texts.slice(start)])
            if len(counts):
                yield pa.RecordBatch.from_arrays([*columns, pa.array(counts)], names)

    return both.mapInArrow(run, schema)


def _mapped(found: DataFrame, key: bytes) -> DataFrame:
    """(row_key, kind, canon, new): each document's entities with their surrogates."""
    seen = written(found, "pii-mentions")
    return seen.select("row_key", "kind", "canon").distinct().join(assign(seen.select("kind", "canon", "m", "f"), key).select("kind", "canon", "new"), ["kind", "canon"]).select("row_key", "kind", "canon", "new")
