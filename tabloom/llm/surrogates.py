"""Personal data replaced by surrogates that keep type, format, script and gender.

Numbers, addresses, accounts and secrets are replaced by a keyed permutation of all values of their format: letters become
letters of the same alphabet and case, digits digits, marks stay, and so do country codes, top level
domains, private address ranges and the validity of check digits. Being a permutation without fixed points, it gives different values
different surrogates, the same value the same one everywhere, and nobody their own; no table is needed.

Names (found by a title, which tells the gender: all capitalised words behind it with particles, hyphens and apostrophes, and
every further mention of these words in the same text; persons who nowhere have a title are not found) cannot be permuted, as the set of names is open. All distinct names of the corpus are
gathered with partial aggregation; each draws a surrogate from the list of its gender and script, by key, and all
draws are checked against each other, against those settled before, and against the names that occur.
Colliding names draw again, from combinations of more names each second time, until none collide. The
map goes back by join to those texts only that have names.

Defined cases: a null text stays null and has no entities; equal entities in different spelling (case, spaces,
brackets) keep their own spelling and share the surrogate; values without letters or digits to change stay; texts may be of any length; repeated
rows give equal rows; an empty table gives an empty result; other columns are ignored (``replace_report``) or carried along (``replace``).
"""

from __future__ import annotations

import hashlib
import hmac
import re
from bisect import bisect
from collections.abc import Iterator
from functools import lru_cache
from ipaddress import IPv6Address
from math import prod

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabloom.llm.common import as_rows, in_slices, per_text, stage, text_of

KEY = b"change this key"
ROUNDS = 8
MAX_ATTEMPTS = 200

# Alphabets, one per script.
LOWER = ("abcdefghijklmnopqrstuvwxyz", "àáâãäåæçèéêëìíîïðñòóôõöøùúûüýþÿœß", "абвгдежзийклмнопрстуфхцчшщъыьэюя", "αβγδεζηθικλμνξοπρστυφχψω")
# Titles by gender, and given names and surnames by script.
TITLES = {
    "f": ("Mrs.", "Ms.", "Mrs", "Ms", "Miss", "Frau", "Mme", "Madame", "Señora", "Sra.", "Doña", "госпожа", "Госпожа", "Κυρία"),
    "m": ("Mr.", "Mr", "Herr", "Herrn", "Monsieur", "M.", "Señor", "Sr.", "Don", "господин", "Господин", "Κύριος"),
    "u": ("Dr.", "Prof.", "Dr", "Prof"),
}
NAMES = {
    ("f", "latin"): "Ada Berta Clara Dora Elena Frida Greta Hanna Irene Julia Klara Laura Maria Nora Olga Paula Rita Sofia Tina Vera".split(),
    ("m", "latin"): "Adam Bruno Carl David Emil Felix Georg Hugo Ivan Jonas Karl Leo Martin Nils Oscar Paul Robert Simon Thomas Victor".split(),
    ("u", "latin"): "Alex Kim Robin Sascha Jamie Taylor Morgan Riley Casey Jordan".split(),
    ("f", "cyrillic"): "Анна Вера Дарья Елена Ирина Мария Нина Ольга Софья Юлия".split(),
    ("m", "cyrillic"): "Антон Борис Виктор Денис Егор Иван Максим Олег Павел Юрий".split(),
    ("u", "cyrillic"): "Саша Женя Валя Шура Слава".split(),
    ("f", "greek"): "Άννα Ελένη Μαρία Σοφία Δάφνη".split(),
    ("m", "greek"): "Ανδρέας Γιώργος Νίκος Πέτρος Σπύρος".split(),
    ("u", "greek"): "Άρης Φώτης Ρένα Βίκυ Λίνα".split(),
    ("s", "latin"): "Abel Berger Castro Duval Ekberg Fischer Garnier Holm Iversen Jansen Keller Lindt Moreau Novak Ortega Petit Quist Roth "
                    "Santos Thorne Ulrich Vidal Weber Young Zeller".split(),
    ("s", "cyrillic"): "Белов Волков Громов Зуев Котов Лебедев Морозов Орлов Соколов Титов".split(),
    ("s", "greek"): "Βλάχος Δήμου Καραλής Λάμπρου Μακρής Νικολάου Παππάς Ρήγας".split(),
}

OCTET = r"(?:25[0-5]|2[0-4]\d|1?\d?\d)"
# Order is priority where matches overlap.
PATTERNS = (
    ("secret", re.compile(
        r"(?i)(?<![^\W_])(?:token|api[_-]?key|secret|password|passwd|pwd|access[_-]?key|auth[_-]?key|private[_-]?key)[\"']?"
        r"\s{0,3}[:=]\s{0,3}[\"']?(?P<value>[A-Za-z0-9_\-/+=.]{8,})")),
    ("secret", re.compile(r"(?<!\w)(?P<value>AKIA[0-9A-Z]{16}(?!\w)|gh[pousr]_[A-Za-z0-9_\-]{20,}|sk-[A-Za-z0-9_\-]{20,})")),
    ("email", re.compile(r"(?<![\w.%+-])(?P<value>[\w.%+-]{1,64}@(?:[A-Za-z0-9-]{1,63}\.){1,8}[A-Za-z]{2,24})(?![A-Za-z0-9-])")),
    ("iban", re.compile(r"(?<!\w)(?P<value>[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?)(?!\w)")),
    ("phone", re.compile(r"(?<![\w.])(?P<value>(?:\+\d{1,3}[ .-]?)?(?:\(\d{2,4}\)[ .-]?|\d{3}[ .-])\d{3}[ .-]\d{4})(?!\w)")),
    ("phone", re.compile(r"(?P<value>\+(?<![\w.+]\+)(?:[ ./()-]{0,2}\d){7,15})(?!\w)")),
    ("phone", re.compile(r"(?P<value>\d(?<![\w.+-]\d)\d{9})(?!\w|[.-]\d)")),
    ("card", re.compile(r"(?<!\w)(?P<value>\d(?:[ -]?\d){12,18})(?!\w)")),
    ("ssn", re.compile(r"(?<!\w)(?P<value>\d{3}-\d{2}-\d{4})(?!\w)")),
    ("ip", re.compile(rf"(?<![\w.])(?P<value>{OCTET}(?:\.{OCTET}){{3}})(?!\w|\.\d)")),
    ("ip6", re.compile(rf"(?<![\w:.])(?P<value>(?=[0-9a-fA-F]{{0,4}}:)[0-9a-fA-F:]{{2,39}}(?:(?<=:){OCTET}(?:\.{OCTET}){{3}})?)(?![\w:]|\.\d)")),
)
_GENDER = {title: gender for gender, titles in TITLES.items() for title in titles}
_TITLE_WORDS = "|".join(sorted(map(re.escape, _GENDER), key=len, reverse=True))
TITLE = re.compile(rf"(?<!\w)(?P<title>{_TITLE_WORDS})[ \u00a0]{{1,3}}(?=[^\W\d_])")
WORD = re.compile(r"[^\W\d_]+(?:['’-][^\W\d_]+)*")
GAP = re.compile(r"\.?[ \u00a0]{1,3}(?=[^\W\d_])")
POSSESSIVE = ("'s", "’s")
PARTICLES = frozenset("von vom van der den dem de del della di da do dos das du la le ter ten zu zum zur af av bin ibn al el y e".split())
NAMED_IN_SPARK = "(?:" + "|".join(re.escape(t) for t in _GENDER) + ")[ \u00a0]{1,3}\\p{L}"


# Keyed permutations -----------------------------------------------------------------

def _permuted(key: bytes, tweak: str, value: int, size: int, back: bool) -> int:
    # Long values are not worth keeping.
    return (_permuted_long if size.bit_length() > 4096 else _permuted_short)(key, tweak, value, size, back)


def _permuted_long(key: bytes, tweak: str, value: int, size: int, back: bool) -> int:
    """A balanced Feistel network over [0, size), walking on until it lands inside."""
    # Decimal digits are limited in length, hexadecimal ones are not.
    spelled = f"{size:x}" if size.bit_length() > 4096 else str(size)
    half = max(1, (max(2, size - 1).bit_length() + 1) // 2)
    mask = (1 << half) - 1
    while True:
        left, right = value >> half, value & mask
        for i in range(ROUNDS):
            turn = ROUNDS - 1 - i if back else i
            known = left if back else right
            data = (f"{tweak}|{spelled}|{turn}|{known:x}" if size.bit_length() > 4096 else f"{tweak}|{spelled}|{turn}|{known}").encode()
            mixed = int.from_bytes(hmac.digest(key, data, "sha256"), "big") & mask
            if half > 256:
                wide = hashlib.shake_256(hmac.digest(key, data, "sha512")).digest(half // 8 + 1)
                mixed = int.from_bytes(wide, "big") & mask
            left, right = (right ^ mixed, left) if back else (right, left ^ mixed)
        value = left << half | right
        if value < size:
            return value


_permuted_short = lru_cache(maxsize=65_536)(_permuted_long)


def exchanged(key: bytes, tweak: str, value: int, size: int) -> int:
    """A keyed permutation of [0, size) without fixed points: permute, step on, permute back."""
    if size < 2:
        return value
    step = 1 + int.from_bytes(hmac.digest(key, f"step|{tweak}|{size:x}".encode() if size.bit_length() > 4096 else f"step|{tweak}|{size}".encode(), "sha256"), "big") % (size - 1)
    place = (_permuted(key, tweak, value, size, False) + step) % size
    return _permuted(key, tweak, place, size, True)


def _alphabet(char: str) -> str:
    if char.isascii() and char.isdigit():
        return "0123456789"
    for letters in LOWER:
        if char in letters:
            return letters
    return char


def _packed(places: list[int], sizes: list[int]) -> tuple[int, int]:
    """A number with one digit per place, the first the highest, and the number of such numbers; by halves, as texts may be long."""
    if len(places) <= 64:
        value, size = 0, 1
        for at, n in zip(places, sizes):
            value, size = value * n + at, size * n
        return value, size
    half = len(places) // 2
    (high, above), (low, below) = _packed(places[:half], sizes[:half]), _packed(places[half:], sizes[half:])
    return high * below + low, above * below


def _unpacked(value: int, sizes: list[int]) -> list[int]:
    if len(sizes) <= 64:
        out = []
        for n in reversed(sizes):
            value, at = divmod(value, n)
            out.append(at)
        return out[::-1]
    half = len(sizes) // 2
    high, low = divmod(value, prod(sizes[half:]))
    return _unpacked(high, sizes[:half]) + _unpacked(low, sizes[half:])


def respelled(key: bytes, tweak: str, text: str, hexadecimal: bool = False) -> str:
    """The text with its letters and digits exchanged; case, marks and other characters stay."""
    small = [c.lower() if len(c.lower()) == 1 and c.lower().upper() == c else c for c in text]
    sets = ["0123456789abcdef" if hexadecimal and c in "0123456789abcdef" else _alphabet(c) for c in small]
    sizes = [len(letters) for letters in sets]
    value, size = _packed([letters.index(c) for c, letters in zip(small, sets)], sizes)
    shape = tweak + "|" + ",".join(s if len(s) == 1 else f"#{len(s)}{s[0]}" for s in sets)
    value = exchanged(key, shape, value, size)
    out = [letters[at] for letters, at in zip(sets, _unpacked(value, sizes))]
    if hexadecimal:
        fresh = "".join(out)
        return fresh.upper() if text == text.upper() else fresh
    return "".join(o.upper() if c != s else o for c, s, o in zip(text, small, out))


def _into(pattern: str, chars: str) -> str:
    """The letters and digits of ``pattern`` replaced by ``chars`` in turn."""
    rest = iter(chars)
    return "".join(next(rest) if c.isalnum() else c for c in pattern)


def _luhn(digits: str) -> int:
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = int(c) * (2 if i % 2 == 0 else 1)
        total += n - 9 if n > 9 else n
    return -total % 10


def _card(key: bytes, text: str) -> str:
    digits = "".join(c for c in text if c.isdigit())
    body, offset = digits[:-1], (int(digits[-1]) - _luhn(digits[:-1])) % 10
    fresh = respelled(key, "card", body)
    return _into(text, fresh + str((_luhn(fresh) + offset) % 10))


def _private(octets: list[int]) -> int:
    """How many leading octets name a private or special range."""
    a, b = octets[:2]
    return 1 if a in (0, 10, 127) or a >= 224 else 2 if (a, b) in ((192, 168), (169, 254)) or a == 172 and 16 <= b < 32 else 0


def _ip(key: bytes, text: str) -> str:
    octets = [int(o) for o in text.split(".")]
    kept = _private(octets)
    value, size = 0, 256 ** (4 - kept)
    for o in octets[kept:]:
        value = value * 256 + o
    while True:
        value = exchanged(key, f"ip|{octets[:kept]}", value, size)
        fresh = octets[:kept] + [value >> 8 * i & 255 for i in reversed(range(4 - kept))]
        if _private(fresh) == kept and fresh != octets:
            return ".".join(map(str, fresh))
        if fresh == octets:
            return text


# Country codes of one and two digits; all others have three.
CODES = frozenset("1 7 20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98".split())


def _phone(key: bytes, text: str) -> str:
    digits = "".join(c for c in text if c.isdigit())
    kept = max(0, len(digits) - 10)
    if text[0] == "+":
        kept = next((n for n in (1, 2) if digits[:n] in CODES), 3)
    return _into(text, digits[:kept] + respelled(key, "phone", digits[kept:]))


def _is_ip6(text: str) -> bool:
    """Valid, with a digit (a::b may be code), and neither unspecified nor the loopback."""
    try:
        return int(IPv6Address(text)) > 1 and any(c.isdigit() for c in text)
    except ValueError:
        return False


def _ip6(key: bytes, text: str) -> str:
    """The groups that are not zero exchanged, so that every spelling of an address gets the same one."""
    if "." in text:
        head, _, tail = text.rpartition(":")
        return head + ":" + _ip(key, tail)
    whole = int(IPv6Address(text))
    groups = [whole >> 16 * i & 0xFFFF for i in reversed(range(8))]
    if groups[:5] == [0] * 5 and groups[5] == 0xFFFF:
        fresh = list(map(int, _ip(key, ".".join(str(g >> k & 255) for g in groups[6:] for k in (8, 0))).split(".")))
        new = groups[:6] + [fresh[0] << 8 | fresh[1], fresh[2] << 8 | fresh[3]]
    else:
        shape = "ip6|" + "".join("0" if g == 0 else "x" for g in groups)
        value, size = _packed([g - 1 for g in groups if g], [65_535] * sum(g > 0 for g in groups))
        rest = iter(_unpacked(exchanged(key, shape, value, size), [65_535] * sum(g > 0 for g in groups)))
        new = [next(rest) + 1 if g else 0 for g in groups]
    # Groups of the text in order; a gap stands for zeros.
    before, gap, after = text.partition("::")
    own = [before.split(":") if before else [], after.split(":") if after else []]
    fresh = [new[:len(own[0])], new[8 - len(own[1]):] if own[1] else []]
    sides = [":".join(f"{v:0{len(g) if g[0] == '0' else 1}x}" for g, v in zip(*x)) for x in zip(own, fresh)]
    out = sides[0] + gap + sides[1]
    return out.upper() if text == text.upper() else out


def surrogate(key: bytes, kind: str, text: str) -> str:
    """The surrogate of an entity that is not a name, in the spelling of this mention."""
    if kind == "email":
        local, _, domain = text.rpartition("@")
        labels, _, top = domain.rpartition(".")
        return respelled(key, "local|" + domain.lower(), local) + "@" + respelled(key, "domain", labels) + "." + top
    if kind == "phone":
        return _phone(key, text)
    if kind == "card":
        return _card(key, text)
    if kind == "ip":
        return _ip(key, text)
    if kind == "iban":
        return text[:2] + _into(text[2:], respelled(key, "iban" + text[:2], "".join(c for c in text[2:] if c.isalnum())))
    if kind == "secret":
        bare = text.lower()
        one_case = text in (bare, text.upper())
        return respelled(key, "secret", text, one_case and all(c in "0123456789abcdef" for c in bare))
    if kind == "ip6":
        return _ip6(key, text)
    return respelled(key, kind, text)


# Finding -------------------------------------------------------------------------------

def entities(text: str) -> list[tuple[int, int, str]]:
    """Places and kinds of all entities but names, without overlaps, in order."""
    found: list[tuple[int, int, str]] = []
    digits = re.search(r"\d", text) is not None
    marks = {"email": "@" in text, "secret": True, "ip6": text.count(":") > 1}
    for kind, pattern in PATTERNS:
        if not (marks.get(kind, digits) and digits >= (kind == "ip6")):
            continue
        if kind == "secret" and not ("=" in text or ":" in text or "AKIA" in text or "gh" in text or "sk-" in text):
            continue
        found += [(*m.span("value"), kind) for m in pattern.finditer(text) if kind != "ip6" or _is_ip6(m["value"])]
    rank = {kind: i for i, (kind, _) in reversed(list(enumerate(PATTERNS)))}
    kept: list[tuple[int, int, str]] = []
    for start, end, kind in sorted(found, key=lambda f: (rank[f[2]], f[0], -f[1])):
        # The kept places do not overlap, so only the neighbours in order can.
        at = bisect(kept, (start, end, kind))
        if (at == 0 or kept[at - 1][1] <= start) and (at == len(kept) or end <= kept[at][0]):
            kept.insert(at, (start, end, kind))
    return kept


def script_of(word: str) -> str:
    first = ord(word[0])
    return "cyrillic" if 0x400 <= first < 0x530 else "greek" if 0x370 <= first < 0x400 or 0x1F00 <= first < 0x2000 else "latin"


def _phrase(text: str, at: int, title: str) -> tuple[list[tuple[int, int, str]], str, int]:
    """Words of the name that begins behind a title, the gender, and where the name ends."""
    gender, found, end, particles = _GENDER[title], [], at, 0
    while m := WORD.match(text, at):
        further = TITLE.match(text, at)
        if further:
            gender = _GENDER[further["title"]] if gender == "u" else gender
            at = further.end()
            continue
        word, stop = m[0], m.end()
        if word.endswith(POSSESSIVE):
            word, stop = word[:-2], stop - 2
        if word[0].isupper():
            found.append((at, stop, word))
            end, particles = stop, 0
        elif word in PARTICLES and particles < 3:
            particles += 1
        else:
            break
        gap = GAP.match(text, stop)
        # A full stop ends the name, but not an initial.
        if not gap or stop < m.end() or gap[0][0] == "." and len(word) > 1:
            break
        at = gap.end()
    return found, gender, end


def names(text: str) -> list[tuple[int, int, str]]:
    """Places of the words of names, with ``kind/word``: s a surname, f m u a given name, i an initial. Further
    mentions of the words in the same text count too; they have the kind of the first."""
    if not any(title in text for title in _GENDER):
        return []
    kinds: dict[str, str] = {}
    found = []
    after = 0
    for m in TITLE.finditer(text):
        if m.start() < after:
            continue
        words, gender, after = _phrase(text, m.end(), m["title"])
        for i, (start, stop, word) in enumerate(words):
            if len(word) == 1:
                found.append((start, stop, f"i/{word}"))
                continue
            kind = "s" if i == len(words) - 1 else gender
            # A given name beside a surname tells more than a name alone.
            kinds[word] = min(kinds.get(word, kind), kind)
            found.append((start, stop, f"{kind}/{word}"))
    if not kinds:
        return found
    for m in WORD.finditer(text):
        start = m.start()
        whole = m[0] in kinds
        for part in [m[0]] if whole else re.split("(['’-])", m[0]):
            if part in kinds:
                found.append((start, start + len(part), f"{kinds[part]}/{part}"))
            start += len(part)
    return sorted({(a, b): (a, b, e if e[0] == "i" else f"{kinds[e[2:]]}/{e[2:]}") for a, b, e in found}.values())


def words_of(text: str) -> list[str]:
    """The distinct ``kind/word`` of a text that are looked up in the map."""
    return sorted({e for _, _, e in names(text) if e[0] != "i"})


def drawn_name(key: bytes, entity: str, attempt: int) -> str:
    """The name drawn at the given attempt: longer combinations as attempts go on."""
    kind, _, word = entity.partition("/")
    pool = NAMES[kind, script_of(word)]
    parts = []
    for i in range(1 + attempt // 2):
        mark = hmac.digest(key, f"name|{entity}|{attempt}|{i}".encode(), "sha256")
        parts.append(pool[int.from_bytes(mark[:8], "big") % len(pool)])
    return "-".join(parts)


def name_map(docs_text: DataFrame, key: bytes = KEY) -> DataFrame:
    """``(entity, surrogate)`` for all words of names in column ``_text``, distinct and staged. A word has one entry, whatever
    its place in a name; its kind is the first of f, m, s, u that occurs."""

    def make():
        return lambda data: (words_of(data.decode("utf-8", "replace")),)

    found = per_text(docs_text.select("_text"), make, "entities array<string>")
    words = found.select(F.explode("entities").alias("_e")).select(F.substring_index("_e", "/", -1).alias("entity"), F.substring_index("_e", "/", 1).alias("kind"))
    wanted = stage(words.groupBy("entity").agg(F.min("kind").alias("kind")), "names")
    # No surrogate may be a name of the corpus.
    real = wanted.select(F.col("entity").alias("_real"))

    @F.pandas_udf("string")
    def draw(entity, attempt):
        return entity.combine(attempt, lambda e, a: drawn_name(key, e, a))

    settled = wanted.select("entity", F.lit("").alias("surrogate")).limit(0)
    left = wanted
    for attempt in range(MAX_ATTEMPTS):
        if left.isEmpty():
            return settled
        draws = stage(left.select("entity", draw(F.concat_ws("/", "kind", "entity"), F.lit(attempt)).alias("surrogate")), "draws")
        first = draws.groupBy("surrogate").agg(F.min("entity").alias("entity"))
        free = first.join(real, F.col("surrogate") == F.col("_real"), "left_anti").join(
            settled.select(F.col("surrogate").alias("_taken")), F.col("surrogate") == F.col("_taken"), "left_anti")
        settled = stage(settled.unionAll(free.select("entity", "surrogate")), "settled")
        left = stage(left.join(settled.select("entity"), "entity", "left_anti"), "left")
    raise RuntimeError(f"names still collide after {MAX_ATTEMPTS} draws")


# Replacing -----------------------------------------------------------------------------

def _rewritten(text: str, known: dict[str, str], key: bytes) -> tuple[str, int, list[str]]:
    spots = [(a, b, kind, surrogate(key, kind, text[a:b])) for a, b, kind in entities(text)]
    for a, b, e in names(text):
        if e[0] == "i":
            spots.append((a, b, "name", respelled(key, "initial", e[2:])))
        elif e[2:] in known:
            spots.append((a, b, "name", known[e[2:]]))
    spots.sort()
    out, at, kinds = [], 0, []
    for start, end, kind, fresh in spots:
        if start >= at:
            out += [text[at:start], fresh]
            kinds.append(kind)
            at = end
    out.append(text[at:])
    return "".join(out), len(kinds), kinds


def _replaced(rows: DataFrame, key: bytes) -> DataFrame:
    """``rows`` with ``_new``, ``_n`` and ``_kinds`` in place of ``_text``."""
    named = F.coalesce(F.col("_text").rlike(NAMED_IN_SPARK), F.lit(False))
    plain, with_names = rows.filter(~named), rows.filter(named)
    table = name_map(with_names, key)
    # Texts with names get the part of the map that they need; equal texts share it.
    def make_lookup():
        return lambda data: (sorted({e[2:] for e in words_of(data.decode("utf-8", "replace"))}),)

    texts = with_names.select(F.sha2("_text", 256).alias("_sha"), "_text").dropDuplicates(["_sha"])
    pairs = per_text(texts, make_lookup, "entities array<string>").select("_sha", F.explode("entities").alias("entity"))
    needed = pairs.join(table, "entity").groupBy("_sha").agg(
        F.map_from_entries(F.collect_set(F.struct("entity", "surrogate"))).alias("_known"))
    needed = stage(needed.withColumnRenamed("_sha", "_key"), "needed")
    joined = with_names.join(needed, F.sha2("_text", 256) == F.col("_key"), "left").drop("_key")
    none = F.lit(None).cast("map<string,string>")
    both = plain.withColumn("_known", none).unionAll(joined.select(*rows.columns, "_known"))
    kept = [c for c in rows.columns if c != "_text"]
    schema = ", ".join(f"`{c}` {t}" for c, t in both.dtypes if c in kept) + ", _new string, _n bigint, _kinds array<string>"

    def rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_slices(batches, "_text"):
            texts, maps = batch.column("_text").to_pylist(), batch.column("_known").to_pylist()
            made = [(None, 0, []) if t is None else _rewritten(t.decode("utf-8", "replace"), dict(m or ()), key) for t, m in zip(texts, maps)]
            fresh = [pa.array([r[0] for r in made], pa.string()), pa.array([r[1] for r in made], pa.int64()),
                     pa.array([r[2] for r in made], pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), *fresh], [*kept, "_new", "_n", "_kinds"])

    return both.select(*kept, F.col("_text").cast("binary").alias("_text"), "_known").mapInArrow(rewrite, schema)


def _count(kind: str) -> Column:
    return F.size(F.filter("_kinds", lambda k: k == kind)).cast("long").alias(f"n_{kind}")


def replace_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", key: bytes = KEY) -> DataFrame:
    """``doc_id, text, n_entities`` and a count per kind, for every document."""
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("_text"))
    kinds = [*dict.fromkeys(kind for kind, _ in PATTERNS), "name"]
    return _replaced(rows, key).select("doc_id", F.col("_new").alias("text"), F.col("_n").alias("n_entities"), *[_count(k) for k in kinds])


def replace(docs: DataFrame, text_col: str = "text", key: bytes = KEY) -> DataFrame:
    """The documents with the text replaced and all other columns as they are."""
    rows = docs.select(as_rows(docs).alias("_row"), F.col(f"`{text_col}`").cast("string").alias("_text"))
    kept = [F.col("_new").alias(c) if c == text_col else F.col(f"_row.`{c}`") for c in docs.columns]
    return _replaced(rows, key).select(*kept)


def shared_surrogates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", key: bytes = KEY) -> DataFrame:
    """The check of distinctness over the corpus: ``(kind, surrogate, n)`` of surrogates that two or more
    different entities got. Empty by construction."""

    def make():
        def pairs(data: bytes):
            text = data.decode("utf-8", "replace")
            return ([f"{k}\t{bare(k, text[a:b])}\t{bare(k, surrogate(key, k, text[a:b]))}" for a, b, k in entities(text)],)

        return pairs

    rows = docs.select(text_of(f"`{text_col}`").alias("_text"))
    found = per_text(rows, make, "pairs array<string>").select(F.explode("pairs").alias("pair")).distinct()
    found = found.select(F.split("pair", "\t").alias("p"))
    return found.groupBy(F.col("p")[0].alias("kind"), F.col("p")[2].alias("surrogate")).agg(F.count("*").alias("n")).filter("n > 1")


def bare(kind: str, text: str) -> str:
    """An entity without its spelling."""
    if kind in ("card", "ssn", "iban"):
        return "".join(c for c in text if c.isalnum())
    if kind == "phone":
        return "+" * (text[0] == "+") + "".join(c for c in text if c.isdigit())
    if kind == "ip6":
        return str(int(IPv6Address(text)))
    return text if kind == "secret" else text.lower()
