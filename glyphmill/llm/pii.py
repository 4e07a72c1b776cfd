"""Personal data under format-preserving pseudonyms: keyed Feistel permutations of validated values."""

from __future__ import annotations

import datetime
import functools
import hashlib
import ipaddress
import re
import string
import unicodedata

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from glyphmill.llm import _io

#: Rounds of the Feistel network; pseudonyms that a worker keeps; most characters that are permuted at once.
ROUNDS, KEPT, CHUNK = 8, 100_000, 64
#: Days whose dates are permuted among themselves; others are no dates of living people.
FIRST_DAY, LAST_DAY = datetime.date(1900, 1, 1).toordinal(), datetime.date(2099, 12, 31).toordinal()
KINDS = ("email", "phone", "card", "iban", "ssn", "ip", "date", "secret")

_RUN = re.compile(r"\d[\d ().+/-]*")
_NUMBER = re.compile(
    r"""(?<![\w.])(?:
      (?P<date>\d{4}-\d\d?-\d\d?|\d{4}/\d\d?/\d\d?|\d\d?(?P<sep>[./-])\d\d?(?P=sep)\d{4})
    | (?P<ip>\d{1,3}(?:\.\d{1,3}){3})
    | (?P<ssn>\d{3}-\d\d-\d{4})
    | (?P<area>0[1-9](?:[ .]\d\d){4} | 0[1-9]\d{0,3}[ /-]\d{3,8}(?:[ ]\d{2,4}){0,3})
    | (?P<phone>\+\d{1,3}[ .-]?(?:\(\d{1,4}\)[ .-]?)?\d{1,4}(?:[ .-]?\d{2,4}){1,4} | \(\d{3}\)[ ]?\d{3}[ .-]\d{4} | \d{3}(?P<mark>[.-])\d{3}(?P=mark)\d{4})
    | (?P<card>\d(?:[ -]?\d){12,18})
    )(?!\w|\.?\d)""",
    re.VERBOSE,
)
_GROUP = re.compile(r"\d+")
_IBAN = re.compile(r"[A-Z]{2}\d\d(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?!\w)|[a-z]{2}\d\d(?: ?[a-z0-9]{4}){2,7}(?: ?[a-z0-9]{1,3})?(?!\w)")
_LOCAL = re.compile(r"[\w.%+-]+\Z")
_DOMAIN = re.compile(r"(?:[^\W_](?:[\w-]*[^\W_])?\.)+(?:[^\W\d_]{2,}|xn--[a-z0-9-]+)")
#: Ten or nine digits are a phone or social security number only where a word says so just before.
_PHONE_NAMED = re.compile(r"(?i:\b(?:tel|telephone|telefon|téléphone|teléfono|phone|mobile|handy|cell|fax|call|fon)\b[.:]?[ ]*(?:no\.?|number)?[ :]*)\Z")
_SSN_NAMED = re.compile(r"(?i:\b(?:ssn|social security)\b(?: no\.?| number)?[ :#]*)(?P<value>\d{3}[ ]?\d\d[ ]?\d{4})(?!\d)")
_TEN = re.compile(r"(?<![\w.,+-])[1-9]\d{9}(?![\w-]|[.,]\d)")
# Names of the months in the languages of the texts.
MONTHS = {
    "en": "january february march april may june july august september october november december".split(),
    "de": "januar februar märz april mai juni juli august september oktober november dezember".split(),
    "fr": "janvier février mars avril mai juin juillet août septembre octobre novembre décembre".split(),
    "es": "enero febrero marzo abril mayo junio julio agosto septiembre octubre noviembre diciembre".split(),
}
#: The month and language that a name counts for, the first one's where several have it.
_MONTH = {name: (k, lang) for lang in reversed(MONTHS) for k, name in enumerate(MONTHS[lang])}
_NAMES = "|".join(sorted(_MONTH, key=len, reverse=True))
_WORDY = re.compile(
    rf"(?<![\w.])(?:(?P<d1>\d\d?)(?:st|nd|rd|th|er|\.)?(?: de| of)? (?P<m1>{_NAMES})(?: de| del|,)? (?P<y1>\d{{4}})|(?P<m2>{_NAMES}) (?P<d2>\d\d?)(?:st|nd|rd|th)?,? (?P<y2>\d{{4}}))(?!\w|[.,]\d)",
    re.IGNORECASE,
)
_PEM = re.compile(r"-----BEGIN (?P<name>[A-Z ]*PRIVATE KEY)-----(?P<value>[A-Za-z0-9+/=\s]+?)-----END (?P=name)-----")
_SECRET = re.compile(r"""[=:]\s*(?P<quote>["']?)(?P<value>[A-Za-z0-9_/+.=!@#$%^&*-]{6,})""")
_SECRET_NAME = re.compile(r"""(?:token|secret|passwd|password|pwd|passphrase|api[_-]?key|access[_-]?key|private[_-]?key)["']?\s*\Z""")
_BEARER = re.compile(r"(?i:\bbearer)[ ]+(?P<value>[A-Za-z0-9_/+.=-]{16,})")
# Public beginnings of keys that need no name beside them.
_KEY = re.compile(r"(?<![A-Za-z0-9_])(?:sk-|sk_live_|sk_test_|rk_live_|ghp_|gho_|ghs_|github_pat_|glpat-|xox[abprs]-|AKIA|ASIA|AIza|hf_|npm_|pypi-|eyJ)(?P<value>[A-Za-z0-9_/+.=-]{16,})")
_IP6 = re.compile(r"(?<![\w:.])(?=[0-9A-Fa-f:]*:[0-9A-Fa-f]*:)[0-9A-Fa-f:]{4,39}(?![\w:]|\.\w)")
_VERSION = re.compile(r"(?i:\bv(?:ersion|er\.?)?[ :]*)\Z")


def luhn(digits: str) -> bool:
    odd = [int(c) for c in digits[::-1]]
    return sum(d if i % 2 == 0 else d * 2 - 9 * (d > 4) for i, d in enumerate(odd)) % 10 == 0


def _mod97(bban: str) -> int:
    return int("".join(str(int(c, 36)) for c in bban)) % 97


def _is_card(s: str) -> bool:
    return luhn(re.sub(r"\D", "", s))


def _is_iban(s: str) -> bool:
    v = s.replace(" ", "")
    return 15 <= len(v) <= 34 and _mod97(v[4:] + v[:4]) == 1


#: Kinds that are read again with other ends where a check digit fails.
_CHECKS = {"card": _is_card, "iban": _is_iban}


@functools.lru_cache(maxsize=4096)
def _alphabet(c: str) -> str:
    """The characters among which one is permuted: digits, letters of its case; beyond ASCII those of its 256 code points."""
    if c.isascii():
        return next((z for z in (string.digits, string.ascii_lowercase, string.ascii_uppercase) if c in z), c)
    if unicodedata.category(c) not in ("Lu", "Ll", "Lo"):  # ordinal signs are no letters of a name
        return c
    base = max(0x80, ord(c) & ~0xFF)
    kind = (c.islower(), c.isupper())
    out = "".join(x for x in map(chr, range(base, (ord(c) | 0xFF) + 1)) if unicodedata.category(x) == unicodedata.category(c) and not unicodedata.normalize("NFKD", x).isascii() and (x.islower(), x.isupper()) == kind and len(x.lower()) == 1 and (not kind[0] or x.lower() == x))
    return out if c in out else c


class Pseudonyms:
    """Keyed permutations of formats; one key gives one value the same pseudonym in every document."""

    def __init__(self, key: bytes):
        self.key = hashlib.blake2b(key, digest_size=32).digest()
        self.kept: dict[tuple[str, str], str | None] = {}

    def _round(self, kind: str, n: int, i: int, x: int, bits: int) -> int:
        h = hashlib.blake2b(f"{kind}:{n}:{i}:{x}".encode(), key=self.key, digest_size=(bits + 7) // 8 + 8).digest()
        return int.from_bytes(h, "big") & ((1 << bits) - 1)

    def permute(self, kind: str, n: int, x: int, back: bool = False) -> int:
        """A permutation of 0 .. n - 1: a balanced Feistel network on the next even number of bits,
        repeated until the value is in range (cycle walking); back undoes it."""
        half = max(1, ((n - 1).bit_length() + 1) // 2)
        mask = (1 << half) - 1
        while True:
            a, b = x >> half, x & mask
            for i in reversed(range(ROUNDS)) if back else range(ROUNDS):
                if back:
                    a, b = b ^ self._round(kind, n, i, a, half), a
                else:
                    a, b = b, a ^ self._round(kind, n, i, b, half)
            x = a << half | b
            if x < n:
                return x

    def digits(self, kind: str, s: str, back: bool = False) -> str:
        return str(self.permute(kind, 10 ** len(s), int(s), back)).zfill(len(s)) if s else s

    def classes(self, kind: str, s: str, back: bool = False) -> str:
        """Letters stay letters of their case and script, digits digits; other characters stay as they are."""
        if len(s) > CHUNK:  # what is too long for one round function, piece by piece
            return "".join(self.classes(f"{kind}:{i}", s[i : i + CHUNK], back) for i in range(0, len(s), CHUNK))
        sets = [_alphabet(c) for c in s]
        x, n = 0, 1
        for c, z in zip(s, sets):
            x, n = x * len(z) + z.index(c), n * len(z)
        if n == 1:
            return s
        x = self.permute(f"{kind}/{''.join('a' if len(z) == 26 else '0' if len(z) == 10 else z[0] for z in sets)}", n, x, back)
        out = []
        for z in reversed(sets):
            x, at = divmod(x, len(z))
            out.append(z[at])
        return "".join(reversed(out))

    def of(self, kind: str, s: str, back: bool = False) -> str | None:
        """The pseudonym of a value as it is written, or None if it isn't a valid value of its kind."""
        found = (kind, s) if not back else (kind + "-", s)
        if found not in self.kept:
            if len(self.kept) >= KEPT:
                self.kept.clear()
            self.kept[found] = getattr(self, "_" + kind)(s, back)
        return self.kept[found]

    @staticmethod
    def _refill(shape: str, values: str) -> str:
        it = iter(values)
        return "".join(next(it) if c.isalnum() else c for c in shape)

    def _email(self, s: str, back: bool) -> str | None:
        local, _, domain = s.rpartition("@")
        return f"{self.classes('email', local.lower(), back)}@{domain}"

    def _phone(self, s: str, back: bool) -> str | None:
        keep = re.match(r"\+\d{1,3}(?=[ .(-])|\+\d|", s).group()
        rest = re.sub(r"\D", "", s[len(keep) :])
        if not 7 <= len(rest) + len(keep) - keep.count("+") <= 15:
            return None
        if not keep and rest[0] == "0":  # an area code in its national form stays one
            if len(rest) < 8:
                return None
            new = self.digits("phone", rest[1:], back)
            while new[0] == "0":
                new = self.digits("phone", new, back)
            return self._refill(s, "0" + new)
        if not keep and re.fullmatch(r"\d{10}", s):
            new = self.digits("phone", s, back)
            while not _TEN.fullmatch(new):
                new = self.digits("phone", new, back)
            return new
        return keep + self._refill(s[len(keep) :], self.digits("phone", rest, back))

    def _card(self, s: str, back: bool) -> str | None:
        if not _is_card(s):
            return None
        d = re.sub(r"\D", "", s)
        body = self.digits("card", d[:-1], back)
        return self._refill(s, next(body + c for c in "0123456789" if luhn(body + c)))

    def _iban(self, s: str, back: bool) -> str | None:
        if not _is_iban(s):
            return None
        if s != s.upper():
            return self._iban(s.upper(), back).lower()
        v = s.replace(" ", "")
        body = self.classes("iban" + v[:2], v[4:], back)
        return self._refill(s, f"{v[:2]}{98 - _mod97(body + v[:2] + '00'):02d}{body}")

    def _ssn(self, s: str, back: bool) -> str | None:
        if "-" not in s:  # as a word names it: with spaces or none
            d = re.sub(r"\D", "", s)
            new = self._ssn(f"{d[:3]}-{d[3:5]}-{d[5:]}", back)
            return new and self._refill(s, new.replace("-", ""))
        a, b, c = map(int, s.split("-"))
        if a in (0, 666) or a > 899 or not b or not c:
            return None
        areas = 898  # 001-665 and 667-899
        x = ((a - 1 - (a > 666)) * 99 + b - 1) * 9999 + c - 1
        x, c = divmod(self.permute("ssn", areas * 99 * 9999, x, back), 9999)
        a, b = divmod(x, 99)
        return f"{a + 1 + (a > 664):03d}-{b + 1:02d}-{c + 1:04d}"

    def _ip(self, s: str, back: bool) -> str | None:
        if ":" in s:
            return self._ip6(s, back)
        parts = [int(x) for x in s.split(".")]
        if max(parts) > 255 or any(len(x) > 1 and x[0] == "0" for x in s.split(".")):
            return None
        x = self.permute("ip", 1 << 32, int.from_bytes(bytes(parts), "big"), back)
        return ".".join(map(str, x.to_bytes(4, "big")))

    def _wordy(self, s: str, back: bool) -> str | None:
        """A date with its month's name, in the name's language and with as many digits: cycle walking over the dates."""
        m = _WORDY.fullmatch(s)
        k = "1" if m["m1"] else "2"
        name = m["m" + k]
        month, language = _MONTH[name.lower()]
        try:
            day = datetime.date(int(m["y" + k]), month + 1, int(m["d" + k])).toordinal() - FIRST_DAY
        except ValueError:
            return None
        if not 0 <= day <= LAST_DAY - FIRST_DAY:
            return None
        while True:
            day = self.permute("date", LAST_DAY - FIRST_DAY + 1, day, back)
            t = datetime.date.fromordinal(FIRST_DAY + day)
            shown = MONTHS[language][t.month - 1]
            if _MONTH[shown][1] == language and (len(m["d" + k]) == 2 or t.day < 10):
                break
        shown = shown.upper() if name.isupper() else shown.capitalize() if name[0].isupper() else shown
        out, done = [], 0
        for part, new in sorted([("d", str(t.day).zfill(len(m["d" + k]))), ("m", shown), ("y", str(t.year))], key=lambda x: m.start(x[0] + k)):
            out += [s[done : m.start(part + k)], new]
            done = m.end(part + k)
        return "".join(out) + s[done:]

    def _date(self, s: str, back: bool) -> str | None:
        if re.search(r"[^\W\d_]", s):
            return self._wordy(s, back)
        sep = re.search(r"\D", s).group()
        p = s.split(sep)
        ymd = len(p[0]) == 4
        tries = [(p[0], p[1], p[2])] if ymd else [(p[2], p[1], p[0]), (p[2], p[0], p[1])][: 1 if sep == "." else 2]
        for k, (y, m, d) in enumerate(tries):
            try:
                day = datetime.date(int(y), int(m), int(d)).toordinal()
            except ValueError:
                continue
            if not FIRST_DAY <= day <= LAST_DAY:
                return None
            t = datetime.date.fromordinal(FIRST_DAY + self.permute("date", LAST_DAY - FIRST_DAY + 1, day - FIRST_DAY, back))
            new = (f"{t.year:04d}", f"{t.month:02d}", f"{t.day:02d}")
            return sep.join(new if ymd else (new[2], new[1], new[0]) if k == 0 else (new[1], new[2], new[0]))
        return None

    def _ip6(self, s: str, back: bool) -> str | None:
        """Its hex digits as they are written, the colons where they are; of one case."""
        try:
            ipaddress.IPv6Address(s)
        except ValueError:
            return None
        digits = s.replace(":", "")
        if len(digits) < 4 or not re.search(r"\d", digits):
            return None
        kind, n = "ip6/" + re.sub("[^:]", "0", s), 16 ** len(digits)
        x = self.permute(kind, n, int(digits, 16), back)
        while not re.search(r"\d", new := f"{x:0{len(digits)}x}"):  # cycle walking keeps a digit, as the search asks for one
            x = self.permute(kind, n, x, back)
        return self._refill(s, new if digits.lower() == digits else new.upper())

    def _secret(self, s: str, back: bool) -> str | None:
        mixed = lambda v: re.search(r"\d", v) and re.search(r"[A-Za-z]", v)
        if len(s) <= 2 * CHUNK and mixed(s) and re.fullmatch(r"[0-9a-f]+|[0-9A-F]+", s):
            show = "X" if s.upper() == s else "x"
            x = self.permute("hex", 16 ** len(s), int(s, 16), back)
            while not mixed(new := f"{x:0{len(s)}{show}}"):
                x = self.permute("hex", 16 ** len(s), x, back)
            return new
        return self.classes("secret", s, back)


def _iban_ends(text: str, start: int) -> list[int]:
    """Where an IBAN that starts here may end, the longest reading first."""
    m = _IBAN.match(text, start)
    return [e for e in range(m.end(), start + 14, -1) if not text[e : e + 1].isalnum() and _IBAN.fullmatch(text, start, e)] if m else []


def _card_ends(text: str, start: int, end: int, whole: bool) -> tuple[list[int], int]:
    """Where a card number that starts here may end, the longest reading first, and the next group's start.

    The whole span may be grouped in any way if `whole`; other readings have groups of four digits or more before the last.
    """
    groups = [(start + g.start(), start + g.end()) for g in _GROUP.finditer(text[start:end])]
    ends, n = [], 0
    for k, (x, y) in enumerate(groups):
        n += y - x
        if n >= 13 and (all(q - p >= 4 for p, q in groups[:k]) or (whole and y == end)):
            ends.append(y)
    return ends[::-1], groups[1][0] if len(groups) > 1 else end


def _named(text: str) -> list[tuple[int, int, str, list[tuple[int, int]]]]:
    """Values that words around them tell: dates by a month, numbers by their kind, keys between their marks."""
    out = [(*m.span(), "date", []) for m in _WORDY.finditer(text)]
    out += [(*m.span("value"), "ssn", []) for m in _SSN_NAMED.finditer(text)]
    out += [(*m.span(), "phone", []) for m in _TEN.finditer(text) if _PHONE_NAMED.search(text, max(0, m.start() - 24), m.start())]
    if "PRIVATE KEY" in text:
        out += [(*m.span("value"), "secret", []) for m in _PEM.finditer(text)]
    return out


def spans(text: str) -> list[tuple[int, int, str, list[tuple[int, int]]]]:
    """(start, end, kind, failed) of what may be personal data, in order; validation comes later.

    Cards and IBANs are read with shorter ends and from later groups until a check digit holds;
    failed are the readings before that one that overlap it.
    """
    out: list[tuple[int, int, str, list[tuple[int, int]]]] = []
    done = 0
    for run in _RUN.finditer(text):
        start, end = run.span()
        if end <= done:
            continue
        if start >= max(2, done) and text[start - 1].isascii() and text[start - 1].isalpha() and (start < 3 or not text[start - 3].isalnum()):
            ends = _iban_ends(text, start - 2)
            k = next((k for k, e in enumerate(ends) if _is_iban(text[start - 2 : e])), None)
            if k is not None:
                out.append((start - 2, ends[k], "iban", [(start - 2, e) for e in ends[:k]]))
                done = ends[k]
        if end - max(done, start) < 7:
            continue
        at, failed, read = max(done, start - 2), [], 0
        while m := _NUMBER.search(text, at, min(len(text), end + 2)):
            a, b = m.span()
            if m.lastgroup != "card":
                at = done = b
                if m.group("ip") and max(map(int, m.group().split("."))) < 100 and _VERSION.search(text, max(0, a - 12), a):
                    continue
                kind = "phone" if m.group("area") else m.lastgroup if m.lastgroup in KINDS else next(k for k in KINDS if k in m.groupdict() and m.group(k))
                out.append((a, b, kind, []))
                continue
            ends, after = _card_ends(text, a, b, a >= read)
            k = next((k for k, e in enumerate(ends) if _is_card(text[a:e])), None)
            failed += [(a, e) for e in ends[:k]]
            if k is None:
                at, read = after, max(read, b)
            else:
                out.append((a, ends[k], "card", [x for x in failed if x[1] > a]))
                at = done = ends[k]
    at = text.find("@")
    while at >= 0:
        base = max(0, at - 64)
        if (a := _LOCAL.search(text, base, at)) and (b := _DOMAIN.match(text, at + 1)):
            start = a.start() + re.match(r"[.%+-]*", a.group()).end()
            if start < at:
                out.append((start, b.end(), "email", []))
        at = text.find("@", at + 1)
    if text.count(":") > 1:
        out += [(*m.span(), "ip", []) for m in _IP6.finditer(text)]
    for m in _SECRET.finditer(text):
        v = m["value"].rstrip(".=")
        mixed = re.search(r"[A-Za-z]", v) and re.search(r"[\d!@#$%^&*]", v)
        telling = mixed or len(v) >= 16 and (m["quote"] or (re.search("[A-Z]", v[1:]) and re.search("[a-z]", v)))
        if len(v) >= 6 and telling and _SECRET_NAME.search(text[max(0, m.start() - 20) : m.start()].lower()):
            out.append((m.start("value"), m.start("value") + len(v), "secret", []))
    if "earer" in text or "EARER" in text:
        out += [(*m.span("value"), "secret", []) for m in _BEARER.finditer(text) if re.search(r"\d", m["value"])]
    out += _named(text)
    out += [(*m.span("value"), "secret", []) for m in _KEY.finditer(text) if re.search(r"[A-Z0-9]", m["value"])]
    out.sort(key=lambda x: (x[0], -x[1]))
    return out


def mask(text: str, names: Pseudonyms, back: bool = False) -> tuple[str, dict[str, int]]:
    """The text with every valid value under its pseudonym (or back), and how many of each kind."""
    parts, done, n = [], 0, {}
    for start, end, kind, failed in spans(text):
        if start < done or (new := names.of(kind, text[start:end], back)) is None:
            continue
        # Cycle walking: a pseudonym with which a failed reading would hold is permuted again, so the same span is read back.
        while any(_CHECKS[kind]((text[s:start] + new + text[end : max(e, end)])[: e - s]) for s, e in failed):
            new = names.of(kind, new, back)
        parts += [text[done:start], new]
        done = end
        n[kind] = n.get(kind, 0) + 1
    return ("".join(parts) + text[done:] if parts else text), n


def pseudonymise(docs: DataFrame, key: bytes, text_col: str = "text", counts: bool = False, back: bool = False) -> DataFrame:
    """docs with personal data in text_col under pseudonyms; with counts also a column n_<kind> each.

    Kinds: e-mail addresses (local part), phone numbers (country code stays), payment cards (Luhn),
    IBANs (mod 97), social security numbers, IPv4 and IPv6 addresses (but not what stands after `version` with parts below 100), dates of
    1900-2099 and secrets: named ones (also as quoted keys), bearer tokens, keys of public beginnings.
    A value that fails its check stays; a card or IBAN is read with shorter ends and from later groups
    before it counts as failed. The permutation depends on key and kind only, so equal values have
    equal pseudonyms in every row, partition and run (but where digits beside a card or IBAN would
    make a longer reading of the pseudonym valid, it is permuted again), and back=True restores them
    (letter case of e-mail addresses aside). Row by row without a shuffle: all rows and columns
    come back; null and empty texts stay; an empty table gives an empty result.
    """
    names = [f"n_{k}" for k in KINDS] if counts else []
    if clash := set(names) & set(docs.columns):
        raise ValueError(f"{sorted(clash)} are taken")
    _io.small_batches(docs.sparkSession)
    at = docs.columns.index(text_col)

    def run(batches):
        p = Pseudonyms(key)
        for b in batches:
            texts, found = [], {k: [] for k in KINDS}
            for t in b.column(at).to_pylist():
                new, n = (t, {}) if not t else mask(t, p, back)
                texts.append(new)
                for k in KINDS if counts else ():
                    found[k].append(n.get(k, 0))
            cols = list(b.columns)
            cols[at] = pa.array(texts, b.schema.field(at).type)
            cols += [pa.array(found[k], pa.int32()) for k in KINDS] if counts else []
            yield pa.RecordBatch.from_arrays(cols, [*b.schema.names, *names])

    fields = [T.StructField(f.name, f.dataType, True) for f in docs.schema.fields]
    return docs.mapInArrow(run, T.StructType([*fields, *(T.StructField(n, T.IntegerType()) for n in names)]))
