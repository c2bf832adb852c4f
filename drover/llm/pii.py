"""Personal data: detected entities are replaced by keyed surrogates of the same
type, gender, script and format.  One entity has one surrogate in the whole
corpus; a check over all entities keeps different ones apart."""

from __future__ import annotations

import functools
import hashlib
import hmac
import itertools
import math
import re
import unicodedata

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from drover.llm.common import keep, map_texts, row_of

# Given names by gender and script, and forms of address with the gender they tell.
GIVEN = {
    ("f", "latin"): "Anna Maria Emma Laura Julia Sophie Claire Marie Elena Lucia Carmen Sarah Emily Alice Hannah "
                    "Olivia Katharina Ingrid Nathalie Isabel",
    ("m", "latin"): "John James Robert Michael William David Thomas Peter Paul Martin Stefan Hans Pierre Jacques "
                    "Carlos Miguel Antonio Pablo Daniel Andreas",
    ("f", "cyrillic"): "Анна Мария Елена Ольга Наталья Ирина Светлана Татьяна",
    ("m", "cyrillic"): "Иван Алексей Дмитрий Сергей Андрей Михаил Николай Павел",
}
GIVEN = {k: v.split() for k, v in GIVEN.items()}
ADDRESS = {"Mr": "m", "Mrs": "f", "Ms": "f", "Miss": "f", "Dr": "", "Prof": "", "Herr": "m", "Frau": "f", "Monsieur": "m",
           "Madame": "f", "Mme": "f", "Señor": "m", "Señora": "f", "Sr": "m", "Sra": "f", "Господин": "m", "Госпожа": "f"}
SYLLABLES = {"latin": "ba ber cor dal den el far gan hol ing kar lan mar nor ol per ran sel tan ver wes yor zan mil "
                      "tor hal bren fis kel lor".split(),
             "cyrillic": "бо вар гор дан зел кал лит мар нов ор пет рад сол тар фед хол чер бел".split()}
ENDING = {("f", "cyrillic"): "ова", ("m", "cyrillic"): "ов", ("", "cyrillic"): "ко"}

_NAMES = "|".join(sorted({n for v in GIVEN.values() for n in v}, key=len, reverse=True))
_ADDRESS = "|".join(sorted(ADDRESS, key=len, reverse=True))
_CAPITAL = r"[A-ZÀ-ÖØ-ÞА-ЯЁ][\w’'-]+"
PATTERNS = {
    "email": r"[A-Za-z0-9](?:[A-Za-z0-9._%+-]*[A-Za-z0-9_%+-])?@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}",
    "ip": r"(?<![0-9.])(?:(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])\.){3}(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])(?![0-9]|\.[0-9])",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "phone": r"(?<![\w+])(?:\+[0-9]{1,3}[ .-]?(?:\([0-9]{1,4}\)|[0-9]{1,4})(?:[ .-]?[0-9]{2,4}){2,4}"
             r"|(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4})(?![0-9])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "card": r"(?<![0-9A-Za-z])(?:[0-9]{13,19}|[0-9]{4}(?:[ -][0-9]{4}){2,3}(?:[ -][0-9]{1,3})?|[0-9]{4}[ -][0-9]{6}[ -][0-9]{5})(?![0-9A-Za-z])",
    "name": rf"\b(?:(?P<address>{_ADDRESS})\.?[ ]+(?:(?P<given>{_NAMES})[ ]+)?|(?P<only>{_NAMES})[ ]+)(?P<family>{_CAPITAL})",
}
_WORD = re.compile(rf"(?<!\w){_CAPITAL}")
_POSSESSIVE = re.compile(r"(?:['’]s|['’-]+)$")
FIND = re.compile("|".join(f"(?P<{k}>{p})" for k, p in PATTERNS.items()))
#: What the JVM looks for first: texts without a match hold no entity.
#: Every alternative is part of each match of some pattern, without what stands around it.
TRIGGER = (r"[A-Za-z0-9_%+-]@[A-Za-z0-9-]|[0-9][0-9 .()-]{5,}[0-9]|\+[0-9][0-9 .()-]{5}|[A-Z]{2}[0-9]{2} ?[A-Z0-9]{4}|"
           rf"(?<!\w)(?:{_ADDRESS}|{_NAMES})\.? +[A-ZÀ-ÖØ-ÞА-ЯЁ]")


def script_of(text: str) -> str:
    return "cyrillic" if any("CYRILLIC" in unicodedata.name(c, "") for c in text) else "latin"


def luhn(digits: str) -> bool:
    total = sum(int(d) if i % 2 == 0 else sum(divmod(2 * int(d), 10)) for i, d in enumerate(reversed(digits)))
    return total % 10 == 0


EXACT = -1  # the attempt number of a surrogate by the permutation of its space
WIDE = 1000  # from this attempt on, surrogates are longer than their entities
_PRIVATE = re.compile(r"(10|127|192\.168|172\.(1[6-9]|2\d|3[01]))\.")


@functools.lru_cache(1 << 16)
def _next(key: bytes, space: str, number: int, size: int) -> int:
    """The number after ``number`` in one keyed cycle through 0 to size - 1."""
    seed = hmac.new(key, space.encode("utf-8", "surrogatepass"), hashlib.sha256).digest()
    half = max(1, ((size - 1).bit_length() + 1) // 2)
    n_bytes, mask = (half + 7) // 8, (1 << half) - 1

    def mix(r: int, v: int) -> int:
        return int.from_bytes(hashlib.shake_256(seed + bytes([r]) + v.to_bytes(n_bytes, "big")).digest(n_bytes), "big") & mask

    def there(v: int) -> int:  # a Feistel network, walked until inside
        while True:
            a, b = v >> half, v & mask
            for r in range(8):
                a, b = b, a ^ mix(r, b)
            v = a << half | b
            if v < size:
                return v

    def back(v: int) -> int:
        while True:
            a, b = v >> half, v & mask
            for r in reversed(range(8)):
                a, b = b ^ mix(r, a), a
            v = a << half | b
            if v < size:
                return v

    return there((back(number) + 1) % size)


class Surrogates:
    """Keyed surrogates.  ``tries`` holds the attempt number of the entities whose
    first surrogates collided."""

    def __init__(self, key: str, tries: dict[tuple[str, str], int] | None = None):
        self.key, self.tries = key.encode(), tries or {}

    def _stream(self, *what):
        """An endless keyed stream of numbers."""
        block = 0
        while True:
            message = "\x1f".join(map(str, (*what, block))).encode("utf-8", "surrogatepass")
            yield from hmac.new(self.key, message, hashlib.sha256).digest()
            block += 1

    def _fill(self, shape: str, numbers) -> str:
        """Digits for digits, letters for letters of the same case."""
        out = []
        for c in shape:
            n = next(numbers) * 256 + next(numbers)
            if c.isdigit():
                c = str(n % 10)
            elif c.isascii() and c.isalpha():
                c = chr((97 if c.islower() else 65) + n % 26)
            out.append(c)
        return "".join(out)

    def _permuted(self, text: str, space: str, fits=None) -> str:
        """Another text of the same shape by a keyed permutation of the shape's
        texts (those that fit): different texts get different ones."""
        radix = [10 if c.isdigit() else 26 if c.isascii() and c.isalpha() else 1 for c in text]
        zero = ["0" if r == 10 else "a" if c.islower() else "A" for c, r in zip(text, radix)]
        number, size = 0, math.prod(radix)
        for c, r, z in zip(text, radix, zero):
            number = number * r + (ord(c) - ord(z) if r > 1 else 0)
        space += "\x1f" + "".join(z if r > 1 else c for c, r, z in zip(text, radix, zero))
        while True:
            number = _next(self.key, space, number, size)
            out, n = [], number
            for c, r, z in zip(reversed(text), reversed(radix), reversed(zero)):
                n, k = divmod(n, r)
                out.append(chr(ord(z) + k) if r > 1 else c)
            made = "".join(reversed(out))
            if fits is None or fits(made):
                return made

    def _host(self, domain: str) -> str:
        names = domain.split(".")
        return ".".join([*(self._permuted(x, "host\x1f" + ".".join(names[i + 1:])) for i, x in enumerate(names[:-1])), names[-1]])

    @staticmethod
    def space(kind: str, canon: str) -> str:
        """What the exact surrogate has in common with its entity; entities with
        the same space have surrogates in one space that no others use."""
        shape = lambda t: re.sub("[a-z]", "a", re.sub("[A-Z]", "A", re.sub("[0-9]", "0", t)))
        if kind == "email":
            local, domain = canon.split("@", 1)
            return shape(local) + "@" + domain
        if kind == "ip":
            private = _PRIVATE.match(canon)
            return private.group(1) if private else ""
        if kind == "iban":
            return canon[:2] + shape(canon[2:])
        if kind == "phone":
            code, rest = canon.split("|")
            return code + "|" + shape(rest)
        return f"{canon[0]}|{len(canon)}|{luhn(canon)}" if kind == "card" else shape(canon)

    def exact(self, kind: str, canon: str) -> str:
        """The surrogate by a keyed permutation of the entity's space."""
        space = kind + "\x1f" + self.space(kind, canon)
        if kind == "email":
            local, domain = canon.split("@", 1)
            return self._permuted(local, space) + "@" + self._host(domain)
        if kind == "ip":
            head = self.space(kind, canon).split(".") if _PRIVATE.match(canon) else []
            rest = list(map(int, canon.split(".")[len(head):]))
            number = int.from_bytes(bytes(rest), "big")
            while True:
                number = _next(self.key, space, number, 256 ** len(rest))
                made = ".".join([*head, *map(str, number.to_bytes(len(rest), "big"))])
                if head or not _PRIVATE.match(made):
                    return made
        if kind == "iban":
            return canon[:2] + self._permuted(canon[2:], space)
        if kind == "phone":
            code, rest = canon.split("|")
            return code + "|" + self._permuted(rest, space)
        if kind == "card":
            return canon[0] + self._permuted(canon[1:], space, lambda t: luhn(canon[0] + t) == luhn(canon))
        return self._permuted(canon, space)  # ssn

    def make(self, kind: str, canon: str, attempt: int) -> str:
        """Canonical surrogate of a canonical entity."""
        if attempt == EXACT:
            return self.exact(kind, canon)
        numbers = self._stream(kind, canon, attempt)
        more = "0" * (1 + (attempt - WIDE) // 4) if attempt >= WIDE else ""
        if kind == "email":
            local, domain = canon.split("@", 1)
            return self._fill(local + more.replace("0", "a"), numbers) + "@" + self._host(domain)
        if kind == "ip":
            private = _PRIVATE.match(canon)
            head = ["10"] if private and more else private.group(1).split(".") if private else [str(11 + next(numbers) % 100)]
            return ".".join([*head, *(str(1 + next(numbers) % 254) for _ in range(4 - len(head)))])
        if kind == "iban":
            return canon[:2] + self._fill(canon[2:] + more, numbers)
        if kind == "phone":
            code, rest = canon.split("|")
            return code + "|" + self._fill(rest + more, numbers)
        if kind == "card":
            body = canon[0] + self._fill(canon[1:-1] + more, numbers)
            last = [d for d in "0123456789" if luhn(body + d) == luhn(canon)]
            return body + last[next(numbers) % len(last)]
        if kind == "family":
            gender, script, _ = canon.split("|")
            parts = SYLLABLES[script]
            n = 2 + next(numbers) % 2 + attempt // 3  # longer the more collide
            return "|".join([gender, script, "".join(parts[(next(numbers) * 256 + next(numbers)) % len(parts)]
                                                      for _ in range(n + 1)) + ENDING.get((gender, script), "")])
        return self._fill(canon + more, numbers)  # ssn

    def given(self, name: str, gender: str, script: str) -> str:
        """A keyed permutation of the names of one gender and script."""
        names = GIVEN[gender, script]
        order = sorted(names, key=lambda n: hmac.new(self.key, f"given{n}".encode(), hashlib.sha256).digest())
        return order[(order.index(name) + 1) % len(order)]

    def canonical(self, kind: str, found: str) -> str:
        if kind == "email":
            return found.lower()
        if kind == "phone":
            code = re.match(r"\+\d{1,3}(?=\D)|\+\d", found)
            code = code.group() if code else ""
            return code + "|" + re.sub(r"\D", "", found[len(code):])
        if kind == "iban":
            return found.replace(" ", "")
        return re.sub(r"\D", "", found) if kind in ("card", "ssn") else found

    @staticmethod
    def shown(kind: str, made: str, found: str) -> str:
        """The canonical surrogate in the format of the mention."""
        if kind == "email":
            return made.upper() if found.isupper() else made
        if kind == "ip":
            return made
        code, _, made = made.rpartition("|")
        rest = iter(made)
        return code + "".join(next(rest) if c.isalnum() else c for c in found[len(code):]) + "".join(rest)

    def entities(self, text: str):
        """(start, end, kind, canonical) of the parts to replace, in order; a
        name gives its given and its family name, and so does every bare mention
        (a whole capitalised word) of a name found anywhere in the text."""
        found = list(self._found(text))
        names: dict[str, tuple[str, str]] = {}
        for start, end, kind, canon in found:
            if kind in ("given", "family"):
                names.setdefault(text[start:end].lower(), (kind, canon))
        if not names:
            yield from found
            return
        at = 0
        for start, end, *what in [*found, (len(text), len(text))]:
            for m in _WORD.finditer(text, at, start):
                for word in (m.group(), _POSSESSIVE.sub("", m.group())):
                    if word.lower() in names:
                        yield m.start(), m.start() + len(word), *names[word.lower()]
                        break
            if what:
                yield start, end, *what
            at = end

    def _found(self, text: str):
        """The entities that the patterns find."""
        for m in FIND.finditer(text):
            kind = m.lastgroup if m.lastgroup in PATTERNS else next(k for k in PATTERNS if m.group(k))
            if kind != "name":
                yield m.start(), m.end(), kind, self.canonical(kind, m.group())
                continue
            which = "given" if m.group("given") else "only"
            given, family = m.group(which), _POSSESSIVE.sub("", m.group("family"))
            script = script_of(family)
            gender = ADDRESS.get(m.group("address") or "", "")
            if given:
                gender = next(g for g, s in GIVEN if given in GIVEN[g, s])
                yield m.start(which), m.end(which), "given", f"{gender}|{script_of(given)}|{given}"
            yield m.start("family"), m.start("family") + len(family), "family", \
                f"{gender if script == 'cyrillic' else ''}|{script}|{family.lower()}"

    def replace(self, text: str) -> tuple[str, int]:
        out, at, n = [], 0, 0
        for start, end, kind, canon in self.entities(text):
            found = text[start:end]
            if kind == "given":
                gender, script, name = canon.split("|")
                new = self.given(name, gender, script)
                new = new.upper() if found.isupper() else new
            else:
                made = self.make(kind, canon, self.tries.get((kind, canon), 0))
                if kind == "family":
                    new = made.split("|")[2]
                    new = new.upper() if found.isupper() else new.capitalize()
                else:
                    new = self.shown(kind, made, found)
            out += [text[at:start], new]
            at, n = end, n + 1
        return "".join([*out, text[at:]]), n


def attempts(entities: DataFrame, key: str, rounds: int = 20) -> DataFrame:
    """Collision check over all distinct entities (kind, canon): the attempt
    number that gives each a surrogate no other entity has and that is no entity
    itself.  Only those that collide go on to the next round; the table of
    settled ones stays in the shared folder.

    Names grow longer with the attempts, so that all of them get settled.  Of
    the other kinds, what still collides after ``rounds`` is in a space that its
    entities (nearly) fill: all entities of that space then get surrogates by a
    keyed permutation of it (``EXACT``), as far as these are no entities.  For
    the rest the format has no free text left: their surrogates grow longer,
    attempt by attempt (private addresses go to the largest private range), so
    that a surrogate is never another entity's text."""

    def made_by(attempt: int):
        def make():
            s = Surrogates(key)

            def run(canons: list) -> dict:
                return {"made": [s.make(*c.split("\x1e"), attempt) for c in canons]}
            return run
        return make

    def spaces():
        return lambda both: {"space": [Surrogates.space(*b.split("\x1e")) for b in both]}

    names = entities.select("kind", "canon").filter("kind <> 'given'").distinct()
    names = keep(names.withColumn("both", F.concat_ws("\x1e", "kind", "canon")), "pii-entities")
    open_, settled = names, None
    for attempt in itertools.chain(range(rounds), itertools.count(WIDE)):
        if attempt == WIDE:
            full = map_texts(left.filter("kind <> 'family'"), spaces, {"space": ("string", pa.string())}, text_col="both")
            full = keep(full.select("kind", "space").distinct(), "pii-full")
            rest = map_texts(names.filter("kind <> 'family'"), spaces, {"space": ("string", pa.string())}, text_col="both")
            rest = keep(rest.join(full, ["kind", "space"], "left_semi").drop("space"), "pii-full-entities")
            exact = map_texts(rest, made_by(EXACT), {"made": ("string", pa.string())}, text_col="both") \
                .select("kind", "canon", "made", F.lit(EXACT).alias("attempt")) \
                .join(names.select("kind", F.col("canon").alias("made")), ["kind", "made"], "left_anti")
            kept = settled.join(rest.select("kind", "canon"), ["kind", "canon"], "left_anti")
            settled = keep(kept.unionByName(exact), "pii-settled")
            open_ = keep(names.join(settled, ["kind", "canon"], "left_anti"), "pii-open")
        made = map_texts(open_, made_by(attempt), {"made": ("string", pa.string())}, text_col="both")
        taken = names.select("kind", F.col("canon").alias("made"), F.lit(0).alias("who"))
        if settled is not None:
            taken = taken.unionByName(settled.select("kind", "made", F.lit(0).alias("who")))
        # the first of those that want a surrogate gets it, unless it is taken
        first = made.groupBy("kind", "made").agg(F.min("canon").alias("canon"))
        free = first.join(taken, ["kind", "made"], "left_anti").withColumn("attempt", F.lit(attempt))
        now = free.select("kind", "canon", "made", "attempt")
        settled = keep(now if settled is None else settled.unionByName(now), "pii-settled")
        left = open_ = keep(names.join(settled, ["kind", "canon"], "left_anti"), "pii-open")
        if left.isEmpty():
            return settled


def replace_private(docs: DataFrame, key: str = "change-this-key", id_col: str = "doc_id", text_col: str = "text",
                    out: str | None = None) -> DataFrame:
    """Replace the personal data of every whole text by surrogates; ``out``
    (default: the text column) gets the new text, ``n_entities`` is added.

    Found: e-mail addresses, IPv4 addresses, IBANs, phone, social security and
    card numbers, and names after a form of address or a known given name; in a
    text that has such a name, also the bare mentions of its given or family
    name.  E-mail hosts, family and given names have surrogates of their own, so
    that mentions in part agree; phones keep the country code, cards the validity of
    the check digit, addresses private or public range, names gender and script,
    all of them case, digits, letters and separators.

    Null texts stay null, empty ones empty; repeated rows are replaced alike;
    an empty table stays empty; columns named like an output are replaced, all
    others stay.  The key is a secret of the caller.

    Scale: the JVM picks the texts that can hold an entity; only these go to
    Python.  Distinct entities, not documents, are shuffled for the check.
    Attempts other than the first reach the documents by a join."""
    out = out or text_col
    text = F.col(f"`{text_col}`")
    maybe = F.coalesce(text.rlike(TRIGGER), F.lit(False))
    some = keep(docs.filter(maybe).select(row_of(docs).alias("row"), text.alias("t"), F.xxhash64(text).alias("key")), "pii-texts")

    def find():
        s = Surrogates(key)

        def run(texts: list) -> dict:
            return {"found": [list(dict.fromkeys("\x1e".join(e[2:]) for e in s.entities(t))) for t in texts]}
        return run

    # repeated texts are looked at once
    found = map_texts(some.select("t").distinct(), find, {"found": ("array<string>", pa.list_(pa.string()))}, text_col="t")
    found = keep(found.select(F.xxhash64("t").alias("key"), F.explode("found").alias("both"))
                 .select("key", F.split("both", "\x1e")[0].alias("kind"), F.split("both", "\x1e")[1].alias("canon")),
                 "pii-found")
    again = attempts(found, key).filter("attempt <> 0").select("kind", "canon", "attempt")
    pairs = F.collect_set(F.concat_ws("\x1e", "kind", "canon", F.col("attempt").cast("string")))
    tries = found.join(again, ["kind", "canon"]).groupBy("key").agg(F.concat_ws("\x1d", pairs).alias("tries"))
    some = some.join(tries, "key", "left").withColumn("both", F.concat_ws("\x1c", F.coalesce("tries", F.lit("")), "t"))

    def put():
        def run(texts: list) -> dict:
            new, n = [], []
            for both in texts:
                listed, _, t = both.partition("\x1c")
                parts = [x.split("\x1e") for x in listed.split("\x1d") if x]
                r = Surrogates(key, {(k, c): int(a) for k, c, a in parts}).replace(t)
                new.append(r[0])
                n.append(r[1])
            return {"new": new, "n": n}
        return run

    done = map_texts(some, put, {"new": ("string", pa.string()), "n": ("int", pa.int32())}, text_col="both", keep_cols=["row"])
    rest = docs.filter(~maybe | text.isNull()).select(row_of(docs).alias("row"), text.alias("new"), F.lit(0).alias("n"))
    columns = [F.col("new").alias(c) if c == out else F.col("row").getField(c).alias(c) for c in docs.columns if c != "n_entities"]
    columns += [] if out in docs.columns else [F.col("new").alias(out)]
    return rest.unionByName(done).select(*columns, F.col("n").alias("n_entities"))
