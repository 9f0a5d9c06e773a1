"""Surrogates for personal data: keyed, of the same type and format, distinct, consistent.

Entities are found by patterns (e-mail, phone, IPv4 and IPv6, card and account numbers, IBAN,
US social security numbers, and names after a title: all capitalised tokens that follow, with
particles such as "van der" between them, up to the next title).  A surrogate is a keyed permutation of
the entity's own characters within their classes (a Feistel network over digits, letters,
vowels and consonants), so one entity has one surrogate everywhere and two entities never
share one: a permutation that leads into a form with one of its own is applied again until
it leads back.  Kept are: punctuation and case, the country code, reserved mail
domains, a fictional 555 exchange, private or public address space, the groups of an IPv6
address, ::ffff: before an IPv4 address in it, the Luhn or IBAN check (valid stays valid), title and hence gender, and the script
of a name; known given names become given names of the same gender.  Letters are permuted
without their marks, which stay (an umlaut keeps its dots); letters that decompose into no
letter of the script's list stay.

Collision check: the distinct entities of the whole corpus (a small table, combined
map-side) must have distinct surrogates, none of which is another real entity; else the
key moves to its next epoch, up to ``MAX_EPOCHS``; shared surrogates at the end are an error.

Defined results: a null text stays null; overlapping findings count from the left, the
longest first; digits of other scripts become those of ASCII; a domain that is not reserved
goes under .example, and one of several labels there goes a level deeper; a name token found after a title is replaced wherever the document has it
capitalised; 0.0.0.0, 127.0.0.1 and 255.255.255.255 are not personal; one-character parts may
keep their value; repeated rows change alike; other columns pass through.
"""

from __future__ import annotations

import hashlib
import ipaddress
import re
import unicodedata
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

from subjex.llm.common import unnested
from subjex.session import written

MAX_EPOCHS = 4
DEFAULT_KEY = b"subjex-surrogates"
KINDS = ("email", "iban", "card", "ssn", "phone", "ip", "person")
#: Titles by gender (m, f, or n for none).  Fixed values.
TITLES = {"m": ("Mr", "Herr", "Monsieur", "Señor", "Sr", "Г-н", "господин", "Κύριος"),
          "f": ("Mrs", "Ms", "Miss", "Frau", "Madame", "Mme", "Señora", "Sra", "Г-жа", "госпожа", "Κυρία"),
          "n": ("Dr", "Prof")}
#: Given names by script and gender; each list is permuted within itself.  Fixed values.
GIVEN = {("latin", "m"): ("james", "john", "robert", "michael", "thomas", "peter", "paul", "hans", "pierre", "jean", "carlos", "juan"),
         ("latin", "f"): ("mary", "anna", "maria", "julia", "laura", "sarah", "emma", "claire", "marie", "carmen", "lucia", "ingrid"),
         ("cyrillic", "m"): ("иван", "пётр", "сергей", "андрей", "николай", "павел"),
         ("cyrillic", "f"): ("анна", "мария", "ольга", "елена", "ирина", "наталья"),
         ("greek", "m"): ("γιώργος", "νίκος", "κώστας", "δημήτρης"),
         ("greek", "f"): ("μαρία", "ελένη", "κατερίνα", "σοφία")}
#: Letters by script: vowels, consonants.  Fixed values.
LETTERS = {"latin": ("aeiou", "bcdfghjklmnpqrstvwxyz"), "cyrillic": ("аеиоуыэюя", "бвгджзклмнпрстфхцчшщ"),
           "greek": ("αεηιουω", "βγδζθκλμνξπρστφχψ")}
_TITLE = "|".join(sorted((re.escape(t) for ts in TITLES.values() for t in ts), key=len, reverse=True))
_OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
DIGITS = re.compile(r"\d")
NUMBERS = re.compile("|".join((
    r"(?P<iban>(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9]))",
    rf"(?P<ip>(?<![\d.]){_OCTET}(?:\.{_OCTET}){{3}}(?!\.?\d))",
    r"(?P<ssn>(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-]))",
    r"(?P<card>(?<![\w.+-])\d(?:[ -]?\d){12,18}(?![\w-]))",
    r"(?P<phone>(?<![\w+])(?:\+1[ .-]?)?(?:\(\d{3}\)[ .-]?|\d{3}[ .-])\d{3}[ .-]\d{4}(?![\w-])"
    r"|(?<![\w+])(?:\+\d{1,3}[ .-]?)?(?:\(\d{2,4}\)[ .-]?|\d{2,4}[ .-])(?:\d{2,4}[ .-]){1,3}\d{2,4}(?![\w-])"
    r"|(?<![\w+])\+\d{1,3}(?:[ .-]?\(?\d{2,8}\)?){1,5}(?!\w))")))
EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
#: Words in lower case that may stand between the tokens of a name.  Fixed values.
PARTICLES = frozenset("af al av bin d da das de del della den der des di dos du e el ibn la le ten ter van vom von y zu zum zur".split())
#: A title; its full stop goes along, or a capitalised token without one.
TITLE = re.compile(rf"(?<!\w)(?P<title>{_TITLE})(?!\w)\.?")
TOKEN = re.compile(r" +(?P<token>[^\W\d_](?:\w|['’-](?=[^\W\d_]))*)")
IPV6 = re.compile(r"(?<![\w:.])(?:[0-9A-Fa-f]{0,4}:){2,7}[0-9A-Fa-f]{0,4}(?![\w:]|\.\d)")
RESERVED = re.compile(r"^(.*?)((?:(?:^|\.)example\.(?:com|org|net)|\.(?:example|test|invalid)))$")


class Keyed:
    """Keyed permutations; ``epoch`` selects another key."""

    def __init__(self, key: bytes = DEFAULT_KEY, epoch: int = 0):
        self.key = hashlib.blake2b(key + epoch.to_bytes(4, "big"), digest_size=32).digest()
        self.surrogate = lru_cache(maxsize=100_000)(self._surrogate)

    def _number(self, tweak: str, i: int, x: int) -> int:
        return int.from_bytes(hashlib.blake2b(f"{tweak}\x00{i}\x00{x}".encode(), key=self.key, digest_size=24).digest(), "big")

    def permute(self, tweak: str, values: list[int], radices: list[int]) -> list[int]:
        """A permutation of the tuples with these ``radices``: a Feistel network on the two halves."""
        half = len(values) // 2
        sides, sizes = [], []
        for a, b in ((0, half), (half, len(values))):
            x, size = 0, 1
            for v, r in zip(values[a:b], radices[a:b]):
                x, size = x * r + v, size * r
            sides.append(x)
            sizes.append(size)
        for i in range(8):
            k = i % 2
            if sizes[k] > 1:
                sides[k] = (sides[k] + self._number(f"{tweak}\x00{radices}", i, sides[1 - k])) % sizes[k]
        out: list[int] = []
        for x, (a, b) in zip(sides, ((0, half), (half, len(values)))):
            part = []
            for r in reversed(radices[a:b]):
                x, v = divmod(x, r)
                part.append(v)
            out += reversed(part)
        return out

    def within(self, tweak: str, text: str, classes: tuple[str, ...]) -> str:
        """``text`` with the characters of each class permuted; others stay and select the permutation."""
        at = [(i, k, alphabet) for i, c in enumerate(text) for alphabet in classes if (k := alphabet.find(c)) >= 0]
        chars = list(text)
        for i, _, alphabet in at:
            chars[i] = f"<{classes.index(alphabet)}>"
        new = self.permute(f"{tweak}\x00{''.join(chars)}", [k for _, k, _ in at], [len(a) for _, _, a in at])
        for (i, _, alphabet), k in zip(at, new):
            chars[i] = alphabet[k]
        return "".join(chars)

    def _surrogate(self, kind: str, norm: str) -> str:
        return getattr(self, f"_{kind}")(norm)

    def _email(self, norm: str) -> str:
        local, domain = norm.split("@")
        m = RESERVED.match(domain)
        head, tail = m.groups() if m else (domain, ".example")
        classes = ("abcdefghijklmnopqrstuvwxyz", "0123456789")
        under = tail == ".example"  # two kinds of domains meet there: the count of .example tells them apart
        while under and head.endswith(".example"):
            head, tail = head.removesuffix(".example"), tail + ".example"
        if under and m and "." in head and not RESERVED.match(head):
            tail += ".example"
        new = self.within("domain" + tail, head, classes)
        while under and new.endswith(".example"):
            new = self.within("domain" + tail, new, classes)
        return f"{self.within('local', local, classes)}@{new}{tail}"

    def _phone(self, norm: str) -> str:
        country, number = norm.split(":")
        if len(number) == 10:  # area and exchange start with 2-9; a fictional 555 exchange stays
            form = fictional, low = _phone_form(number)
            free = [i for i in range(10) if not (fictional and 3 <= i < 6)]
            while True:  # walk the cycle back into the same form
                new = self.permute(f"phone{fictional}{low}", [int(number[i]) - low[i] for i in free], [10 - low[i] for i in free])
                out = list(number)
                for i, v in zip(free, new):
                    out[i] = str(v + low[i])
                number = "".join(out)
                if _phone_form(number) == form:
                    return f"{country}:{number}"
        return f"{country}:{self.within('phone' + country, number, ('0123456789',))}"

    def _ssn(self, norm: str) -> str:
        return self.within("ssn", norm, ("0123456789",))

    def _ip(self, norm: str) -> str:
        if ":" in norm:
            return self._ip6(norm)
        octets = [int(x) for x in norm.split(".")]
        space, fixed = _space(octets)
        if space == "none":
            return norm
        while space in ("public", "reserved"):  # walk the cycle back into the same space
            octets = self.permute("ip", octets, [256] * 4)
            if _space(octets)[0] == space:
                return ".".join(map(str, octets))
        low, size = (16, 16) if space == "private172" else (0, 256)
        free = octets[fixed:]
        new = self.permute(space, [free[0] - low, *free[1:]], [size, *[256] * (len(free) - 1)])
        return ".".join(map(str, [*octets[:fixed], new[0] + low, *new[1:]]))

    def _card(self, norm: str) -> str:
        check = (int(norm[-1]) - _luhn(norm[:-1])) % 10  # 0 for a valid number
        body = norm[0] + self.within(f"card{norm[0]}{check}", norm[1:-1], ("0123456789",))
        return body + str((_luhn(body) + check) % 10)

    def _iban(self, norm: str) -> str:
        country, digits, account = norm[:2], int(norm[2:4]), norm[4:]
        off = (digits - _mod97(country, account)) % 100  # 0 for a valid number
        new = self.within(f"iban{country}{off}", account, ("0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"))
        return f"{country}{(_mod97(country, new) + off) % 100:02d}{new}"

    def _person(self, norm: str) -> str:
        """``norm``: gender:role:token."""
        gender, role, token = norm.split(":", 2)
        script = _script(token)
        for (s, g), names in GIVEN.items():
            if s == script and token in names and role == "given" and gender in (g, "n"):
                return names[self.permute(f"given{s}{g}", [names.index(token)], [len(names)])[0]]
        new = self._letters(token, script)
        known = {n for (_, g), names in GIVEN.items() for n in names if gender in (g, "n")}
        while role == "given" and new in known:  # stay outside the names permuted above
            new = self._letters(new, script)
        return new

    def _letters(self, token: str, script: str) -> str:
        """The letters permuted below their marks."""
        apart = unicodedata.normalize("NFD", token)
        return unicodedata.normalize("NFC", self.within("name", apart, LETTERS.get(script, ())))

    def _ip6(self, norm: str) -> str:
        """The hex digits of the groups permuted, but a reserved first group (and 2001:db8, ::ffff: before an IPv4 address)."""
        kept = _ip6_kept(norm)
        new = self._groups(norm, kept)
        while _ip6_kept(new) != kept:  # walk the cycle back
            new = self._groups(new, kept)
        return new

    def _groups(self, norm: str, kept: int) -> str:
        """The hex digits of all groups but the first ``kept`` permuted."""
        groups = norm.split(":")
        free = [(i, j) for i, g in enumerate(groups) if i >= kept for j in range(len(g))]
        low = [int(j == 0) for _, j in free]  # a group keeps its length: no leading zero
        zero = [groups[i] == "0" for i, _ in free]
        free = [(p, m) for p, m, z in zip(free, low, zero) if not z]
        form = ":".join(g if i < kept or g in ("", "0") else str(len(g)) for i, g in enumerate(groups))
        new = self.permute(f"ip6{form}", [int(groups[i][j], 16) - m for (i, j), m in free], [16 - m for _, m in free])
        out = [list(g) for g in groups]
        for ((i, j), m), v in zip(free, new):
            out[i][j] = f"{v + m:x}"
        return ":".join(map("".join, out))


def _phone_form(number: str) -> tuple[bool, list[int]]:
    """Of ten digits: a fictional exchange or not, and the smallest digit by place."""
    return number[3:6] == "555", [2 if i in (0, 3) and number[i] in "23456789" else 0 for i in range(10)]


def _ip6_kept(norm: str) -> int:
    """How many groups of a compressed address stay."""
    if re.fullmatch(r"::ffff:[0-9a-f]+:[0-9a-f]+", norm):
        return 3
    return 2 if norm.startswith("2001:db8:") else 1 if re.match(r"f[cdef]", norm) else 0


def _space(o: list[int]) -> tuple[str, int]:
    """The address space and how many octets it fixes."""
    if o in ([0, 0, 0, 0], [127, 0, 0, 1], [255] * 4):
        return "none", 4
    if o[0] in (0, 10, 127):
        return f"private{o[0]}", 1
    if o[0] == 172 and 16 <= o[1] < 32:
        return "private172", 1
    if o[:2] == [192, 168]:
        return "private192", 2
    return ("public" if o[0] < 224 else "reserved"), 0


def _luhn(body: str) -> int:
    total = sum(sum(divmod(2 * int(c), 10)) if i % 2 == 0 else int(c) for i, c in enumerate(reversed(body)))
    return -total % 10


def _mod97(country: str, account: str) -> int:
    digits = "".join(str(int(c, 36)) for c in account + country + "00")
    return 98 - int(digits) % 97


def _script(token: str) -> str:
    c = next((c for c in token if c.isalpha()), "a")
    return "cyrillic" if "Ѐ" <= c <= "ӿ" else "greek" if "Ͱ" <= c <= "Ͽ" else "latin"


def _name_tokens(text: str, at: int) -> list[tuple[str, bool]]:
    """(token, after a particle) of the name that begins at ``at``: capitalised tokens, however
    many, and particles as long as a capitalised token follows; a title ends it."""
    out, particle, pending = [], False, False
    while m := TOKEN.match(text, at):
        token = re.sub(r"['’]s$", "", m["token"])
        if token in PARTICLES:
            pending = True
        elif not token[0].isupper() or any(token in ts for ts in TITLES.values()):
            break
        else:
            particle, pending = particle or pending and bool(out), False
            out.append((token, particle))
        at = m.end()
    return out


def _ip6_norm(raw: str) -> str:
    """The compressed form of an address that may be personal, else the empty string."""
    try:
        ip = ipaddress.IPv6Address(raw)
    except ValueError:
        return ""
    if ip.is_loopback or ip.is_unspecified:
        return ""
    # some Python versions write the last groups of an embedded IPv4 address with dots
    return f"::ffff:{int(ip) >> 16 & 0xffff:x}:{int(ip) & 0xffff:x}" if ip.ipv4_mapped else ip.compressed


def find(text: str) -> list[tuple[int, int, str, str]]:
    """(start, end, kind, norm) of the entities of a text, in order and without overlap."""
    found = []
    if "@" in text:
        found += [(m.start(), m.end(), "email", m[0].lower()) for m in EMAIL.finditer(text)]
    if DIGITS.search(text):
        for m in NUMBERS.finditer(text):
            kind, raw = m.lastgroup, "".join(str(int(c)) if c.isdecimal() else c for c in m[0])
            digits = "".join(c for c in raw if c.isdigit())
            if kind == "phone":
                if not 7 <= len(digits) <= 15:
                    continue
                country = ""
                if raw[0] == "+":
                    lead = re.match(r"\+(\d{1,3})(?=[ .(-])", raw)
                    country = lead[1] if lead else "1" if digits[0] == "1" else digits[:2]
                    digits = digits[len(country):]
                norm = f"{country if country != '1' else ''}:{digits}"
            else:
                norm = digits if kind in ("card", "ssn") else raw.replace(" ", "")
            if kind != "ip" or _space([int(x) for x in raw.split(".")])[0] != "none":
                found.append((m.start(), m.end(), kind, norm))
    if text.count(":") > 1:
        for m in IPV6.finditer(text):
            norm = _ip6_norm(m[0])
            if norm:
                found.append((m.start(), m.end(), "ip", norm))
    names = {}
    for m in TITLE.finditer(text):
        gender = next(g for g, ts in TITLES.items() if m["title"] in ts)
        kept = _name_tokens(text, m.end())
        for i, (t, after_particle) in enumerate(kept):
            role = "given" if i < len(kept) - 1 and not after_particle else "family"
            lower = unicodedata.normalize("NFC", t.lower())
            norm = f"{gender}:given:{lower}" if role == "given" else f"n:family:{lower}"
            names.setdefault(t, norm)
            if len(t) > 1:
                names.setdefault(t.upper(), norm)
    if names:
        every = re.compile(r"(?<!\w)(?:" + "|".join(map(re.escape, sorted(names, key=len, reverse=True))) + r")(?!\w)")
        found += [(m.start(), m.end(), "person", names[m[0]]) for m in every.finditer(text)]
    found.sort(key=lambda x: (x[0], -x[1]))
    out, end = [], 0
    for x in found:
        if x[0] >= end:
            out.append(x)
            end = x[1]
    return out


def _written_like(original: str, kind: str, new: str) -> str:
    """The surrogate in the form of the original: its punctuation and its case."""
    if kind == "email":
        return "".join(n.upper() if i < len(original) and original[i].isupper() else n for i, n in enumerate(new))
    if kind == "person":
        if original.isupper() and len(original) > 1:
            return new.upper()
        old, new = unicodedata.normalize("NFD", original), unicodedata.normalize("NFD", new)
        return unicodedata.normalize("NFC", "".join(n.upper() if i < len(old) and old[i].isupper() else n for i, n in enumerate(new)))
    if kind == "ip":
        if ":" in original and len(original) == 39:
            new = ":".join(re.findall("....", f"{int(ipaddress.IPv6Address(new)):032x}"))
        return new.upper() if ":" in original and original.upper() == original else new
    if kind == "phone":
        new = new.split(":")[1]
    fresh, skip = iter(new), 0
    if kind == "phone":  # the country code stays
        skip = sum(c.isdigit() for c in original) - len(new)
    out = []
    for c in original:
        if c.isalnum() and skip <= 0:
            out.append(next(fresh))
        else:
            skip -= c.isdigit()
            out.append(c)
    return "".join(out)


def replace(text: str, keyed: Keyed) -> tuple[str, list[str]]:
    """The text with surrogates, and the kinds replaced."""
    found, out, at = find(text), [], 0
    for start, end, kind, norm in found:
        out += [text[at:start], _written_like(text[start:end], kind, keyed.surrogate(kind, norm))]
        at = end
    return "".join([*out, text[at:]]), [x[2] for x in found]


def _entities(batches):
    seen: set[tuple[str, str]] = set()
    for batch in batches:
        new = {(kind, norm) for t in batch.column("text").to_pylist() if t for _, _, kind, norm in find(t)} - seen
        if len(seen) < 100_000:
            seen |= new
        yield pa.RecordBatch.from_pydict({"kind": pa.array([k for k, _ in new], pa.string()), "norm": pa.array([n for _, n in new], pa.string())})


def _mapped(key: bytes, epoch: int):
    def run(batches):
        keyed = Keyed(key, epoch)
        for batch in batches:
            new = [keyed.surrogate(k, n) for k, n in zip(*(batch.column(c).to_pylist() for c in ("kind", "norm")))]
            # given and family tokens live in one space of names
            new = [n if k != "person" else o.rsplit(":", 1)[0] + ":" + n for k, n, o in zip(batch.column("kind").to_pylist(), new, batch.column("norm").to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column("kind"), batch.column("norm"), pa.array(new, pa.string())], ["kind", "norm", "surrogate"])
    return run


def surrogates(entities: DataFrame, key: bytes = DEFAULT_KEY, epoch: int = 0) -> DataFrame:
    """``entities`` (kind, norm) with their surrogates."""
    return entities.mapInArrow(_mapped(key, epoch), "kind string, norm string, surrogate string")


def collisions(mapped: DataFrame) -> tuple[int, int]:
    """(surrogates shared by two entities, surrogates that are a real entity)."""
    shared = mapped.groupBy("kind", "surrogate").agg(F.count("*").alias("n")).where("n > 1").count()
    real = mapped.select("kind", F.col("norm").alias("surrogate")).join(mapped, ["kind", "surrogate"], "left_semi").count()
    return shared, real


def choose_epoch(docs: DataFrame, key: bytes = DEFAULT_KEY) -> int:
    """The first key epoch without collisions over all entities of ``docs``; else, of those
    without shared surrogates, the one with the fewest that are real entities."""
    entities = written(docs.select("text").mapInArrow(_entities, "kind string, norm string").distinct(), "entities")
    tried = []
    for epoch in range(MAX_EPOCHS):
        shared, real = collisions(surrogates(entities, key, epoch))
        if not shared:
            tried.append((real, epoch))
            if not real:
                break
    if not tried:
        raise RuntimeError(f"surrogates collide in {MAX_EPOCHS} key epochs")
    return min(tried)[1]


def _anonymised(key: bytes, epoch: int):
    def run(batches):
        keyed = Keyed(key, epoch)
        for batch in batches:
            texts, kinds = [], []
            for t in batch.column("text").to_pylist():
                new, found = replace(t, keyed) if t else (t, [])
                texts.append(new)
                kinds.append(found)
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(texts, pa.string()), pa.array(kinds, pa.list_(pa.string()))],
                                             ["row", "text", "replaced"])
    return run


def anonymise(docs: DataFrame, key: bytes = DEFAULT_KEY, out: str = "replaced") -> DataFrame:
    """``docs`` with surrogates in ``text`` and the kinds replaced in ``out``, which replaces a
    column of that name; all other columns pass through, whatever their names."""
    epoch = choose_epoch(docs, key)
    rest = [c for c in docs.columns if c not in ("text", out)]
    # without other columns a constant keeps the struct from being empty
    row = F.struct(*[F.col(f"`{c}`") for c in rest], *([] if rest else [F.lit(0).alias("none")]))
    rows = docs.select(row.alias("row"), "text")
    shape = StructType([*rows.schema.fields, StructField("replaced", ArrayType(StringType()))])
    done = rows.mapInArrow(_anonymised(key, epoch), shape)
    return unnested(done, docs.columns, text=F.col("text"), **{out: F.col("replaced")}) \
        .select(*[c for c in docs.columns if c != out], out)
