"""Reading places as typed: which part is town, county and country, whatever the order, separators and slips."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable
from functools import lru_cache

# Texts that state no place.
NO_PLACE = {
    "", "-", "--", "?", "??", "???", "n/a", "na", "nil", "none", "none given", "unknown", "unknown place", "place unknown", "unk", "unbekannt", "unbek", "ort unbekannt",
    "inconnu", "inconnue", "desconocido", "lugar desconocido", "not stated", "not given", "no record", "not recorded", "illegible", "unleserlich", "illisible", "blank",
    "same as father", "same as mother", "same", "as above", "ditto", "tbd", "0000",
}
# Words of places that lie on no map.
OFF_MAP = re.compile(r"\b(at sea|on sea|auf see|en mer|en el mar|a bord|aboard|on board|an bord|voyage|crossing|in camp|in a wagon|in wagon|on the road|on the trail|in the field|in transit|unterwegs)\b")
# Countries under the names people write.
COUNTRIES = {
    "england": "england|eng|engl|angleterre|inghilterra|inglaterra|great britain|gt britain|gb|gr brit|gt brit|great brit|united kingdom|uk|britain",
    "scotland": "scotland|scot|schottland|ecosse|escocia|n britain|north britain|n brit|great britain|gb",
    "ireland": "ireland|irl|irlande|irland|irlanda|eire|ire",
    "germany": "germany|ger|deutschland|allemagne|alemania|german empire|prussia|germ",
    "france": "france|fr|frankreich|francia",
    "austria": "austria|aust|osterreich|osterrich|autriche|oesterreich",
    "netherlands": "netherlands|the netherlands|neth|nederland|niederlande|holland|pays bas|paises bajos|ned",
    "poland": "poland|pol|polska|polen|pologne|polonia",
    "spain": "spain|sp|spanien|espana|espagne",
    "sweden": "sweden|swe|schweden|sverige|suede|suecia|swed",
    "usa": "usa|u s a|us|u s|united states|united states of america|america|amerika|etats unis|vereinigte staaten|estados unidos",
    "canada": "canada|can|kanada|british north america|b n a|brit n america|british n america|br n america",
}
# Words for a kind of county, at either end of its name.
COUNTY_WORDS = r"county|cty|cnty|co|district|dist|barony|vale|moor|township|twp|territory|terr|lan|prov|province"
# Remarks and qualifiers around a name.
LEADS = r"near|nr|bei|in|of|b|born|born in|born at|at|zu|aus|von|nahe|gemeinde|parish of|village of|town of|par of|pres|pres de|probably|prob|poss|possibly|vicinity of|farm near|commune de|paroisse de"
TAILS = r"hof|farm|chapel|parish|par reg|parish register|par|reg|sic|see note|see notes|note|no \d+|nr \d+|area|register|house|village"
# Short forms of the first word of a name.
FIRST_WORDS = {"st": "saint", "s": "saint", "ste": "saint", "sankt": "saint", "sct": "saint", "upr": "upper", "up": "upper", "u": "upper", "nthr": "nether", "neth": "nether", "n": "new", "nw": "new", "neu": "new", "olde": "old", "o": "old"}

_LEAD, _TAIL = re.compile(rf"^(?:(?:{LEADS})\s+)+"), re.compile(rf"(?:\s+(?:{TAILS}))+$")
_TAIL_ONLY = re.compile(rf"^(?:{TAILS})$")
_QUALIFIERS = ("hof", "farm", "chapel", "see note", "par reg", "sic", "note", "reg")
_COUNTY_WORD = re.compile(rf"^(?:(?:{COUNTY_WORDS})\s+(?:of\s+)?)|\s+(?:{COUNTY_WORDS})$")
# spellings that stand for one letter, folded the same way in every name
_DIGRAPHS = (("ae", "a"), ("oe", "o"), ("ue", "u"), ("rn", "m"))
_PLAIN = str.maketrans("0łøđ", "olod")
# the same for plain text: what is no letter or digit is a blank
_ASCII = {i: " " for i in range(128) if not chr(i).isalnum()} | {ord("0"): "o"}
_ONE, _PARTS, _BRACKETS = re.compile(r"(?<=[a-z])1|1(?=[a-z])"), re.compile(r"[,;/|\n]|\s[-–—]+\s"), re.compile(r"[\[(][^\])]*[\])]")


def fold_letters(text: str) -> str:
    """Lower-case letters and digits with single blanks; accents and look-alike digits are folded."""
    if text.isascii():
        s = text.lower().translate(_ASCII)
    else:
        s = unicodedata.normalize("NFKD", text.casefold()).translate(_PLAIN)
        s = "".join(c if c.isalnum() else " " for c in s if not unicodedata.combining(c))
    return " ".join((_ONE.sub("l", s) if "1" in s else s).split())


def fold_name(text: str) -> str:
    """As `fold_letters`, with umlaut spellings and rn for m folded too."""
    s = fold_letters(text)
    for a, b in _DIGRAPHS:
        s = s.replace(a, b)
    return s


#: Parts of places recur in many texts.
_folded_part = lru_cache(100_000)(fold_name)


@lru_cache(100_000)
def _is_remark(part: str) -> bool:
    """A part that only qualifies the others."""
    return bool(_TAIL_ONLY.match(part)) or any(len(q) > 3 and within(part, q, 1) <= 1 for q in _QUALIFIERS)


def within(a: str, b: str, k: int) -> int:
    """Edit distance with adjacent swaps if it is at most k, else k + 1; computed in a band."""
    if a == b:
        return 0
    if abs(len(a) - len(b)) > k:
        return k + 1
    big, m = k + 1, len(b)
    before: list[int] = []
    row = [j if j <= k else big for j in range(m + 1)]
    for i, x in enumerate(a, 1):
        now = [big] * (m + 1)
        if i <= k:
            now[0] = i
        best = now[0]
        for j in range(max(1, i - k), min(m, i + k) + 1):
            y = b[j - 1]
            v = row[j - 1] + (x != y)
            if row[j] + 1 < v:
                v = row[j] + 1
            if now[j - 1] + 1 < v:
                v = now[j - 1] + 1
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y and before[j - 2] + 1 < v:
                v = before[j - 2] + 1
            now[j] = v
            if v < best:
                best = v
        if best > k:
            return big
        before, row = row, now
    return row[m] if row[m] <= k else big


def letters(name: str) -> int:
    """Which letters a name has, as bits; k edits change at most 2 k of them."""
    m = 0
    for ch in name:
        m |= 1 << (ord(ch) & 63)
    return m


class Near:
    """Finds the nearest of a fixed list of words within k edits, letter sets first."""

    def __init__(self, words: list[str]) -> None:
        self.words = [(len(w), letters(w), w) for w in words]

    def best(self, word: str, k: int) -> str:
        n, m, best, found = len(word), letters(word), k + 1, ""
        for size, mask, w in self.words:
            if -k <= size - n <= k and (mask ^ m).bit_count() <= 2 * k and (d := within(word, w, best - 1)) < best:
                best, found = d, w
                if best == 0:
                    break
        return found


def bigrams(name: str) -> list[str]:
    """Padded letter pairs, a repeated one numbered, so that a name is a set."""
    padded, seen, out = f"^{name}$", {}, []
    for i in range(len(padded) - 1):
        g = padded[i : i + 2]
        n = seen[g] = seen.get(g, 0) + 1
        out.append(g if n == 1 else f"{g}{n}")
    return out


class PlaceReader:
    """Splits a place as typed with the counties and countries of a reference list, which is fixed and small."""

    def __init__(self, counties: list[str], aliases: dict[str, str] | None = None, countries: list[str] | None = None) -> None:
        self.aliases, self.stated = aliases or {}, countries or []
        # names of two countries mean both; the reader gives the pair
        shared: dict[str, set[str]] = {}
        for c, names in COUNTRIES.items():
            for a in names.split("|"):
                shared.setdefault(fold_name(a), set()).add(c)
        # countries that the list has and the fixed table has not
        for c in self.stated:
            if fold_name(c) not in shared:
                shared[fold_name(c)] = {fold_name(c)}
        self.countries = {a: "|".join(sorted(cs)) for a, cs in shared.items()}
        self.near_country = Near([a for a in self.countries if len(a) >= 5])
        self.names = counties
        self.counties: dict[str, str] = {}
        for c in counties:
            f = fold_name(c)
            core = self.core(f)
            self.counties[f] = core
            self.counties.setdefault(core, core)
            if core.endswith("shire"):
                self.counties.setdefault(core[:-5], core)
        self.county_list = list(self.counties)
        self.near_county = Near(self.county_list)
        self.county_of = lru_cache(100_000)(self._county_of)
        self.country_of = lru_cache(100_000)(self._country_of)
        self._remembered = lru_cache(50_000)(self.read)

    def __reduce__(self) -> tuple:
        return PlaceReader, (self.names, self.aliases, self.stated)  # caches stay behind

    @staticmethod
    def core(folded: str) -> str:
        return _COUNTY_WORD.sub("", folded).strip() or folded

    def _country_of(self, part: str) -> str:
        if part in self.countries:
            return self.countries[part]
        return self.countries.get(self.near_country.best(part, 1), "") if len(part) >= 6 else ""

    def _county_of(self, part: str) -> str:
        words = part.split()
        words[:1] = [FIRST_WORDS.get(words[0], words[0])] if len(words) > 1 else words[:1]
        part = " ".join(words)
        if part in self.counties:
            return self.counties[part]
        core = self.core(part)
        if core in self.counties:
            return self.counties[core]
        if core.endswith("s") and core[:-1] in self.counties and self.counties[core[:-1]].endswith("shire"):
            return self.counties[core[:-1]]
        if len(core) >= 6:
            if found := self.near_county.best(core, 1 if len(core) < 9 else 2):
                return self.counties[found]
            if len(core) >= 7:
                cut = [c for c in self.county_list if c.startswith(core)]
                if cut and len({self.counties[c] for c in cut}) == 1:
                    return self.counties[cut[0]]
        return ""

    def read(self, text: str | None) -> tuple[int, list[str], str, str, bool]:
        """(levels, towns, county, country, off_map): how many of town, county and country are stated, and which.

        towns holds the candidate names of the town, likeliest first. A text that states no place has 0 levels.
        """
        if text is None or not text.strip():
            return 0, [], "", "", False
        raw = text
        if ("[" in text or "(" in text) and re.search(r"\w", bare := _BRACKETS.sub(" ", text)):
            raw = bare
        flat = fold_name(raw)
        if text.strip().casefold() in NO_PLACE or flat in NO_PLACE:
            return 0, [], "", "", False
        if OFF_MAP.search(flat):
            return 1, [], "", "", True
        parts = [p for p in map(_folded_part, _PARTS.split(raw)) if p]
        parts = [p for p in parts if not _is_remark(p)] or parts[:1]
        county = country = ""
        towns: list[str] = []
        # a known spelling of the country decides; only without one are slips looked for, at the ends
        at = next((i for i in (*range(len(parts) - 1, -1, -1),) if parts[i] in self.countries), -1)
        if at < 0 and len(parts) > 1:
            at = next((i for i in (len(parts) - 1, 0) if self.country_of(parts[i])), -1)
        if at >= 0:
            country = self.country_of(parts[at])
        rest = [p for i, p in enumerate(parts) if i != at]
        if len(rest) > 1:
            # the county is the part that reads as one; a first part only if another one is left to be the town
            for i in [*range(1, len(rest)), 0]:
                p = rest[i]
                if c := self.county_of(p):
                    county = c
                    del rest[i]
                    break
        elif len(rest) == 1 and len(parts) == 1 and " " in rest[0]:
            words = rest[0].split()
            country, words = self._cut(words, self.country_of, 3)
            county, words = self._cut(words, self._exact_county, 4)
            rest = [" ".join(words)]
        elif len(rest) == 1 and (c := self._exact_county(_LEAD.sub("", rest[0]))):
            county, rest = c, []
        for p in rest:
            bare = _TAIL.sub("", _LEAD.sub("", p)).strip() or p
            words = bare.split()
            if len(words) > 1 and words[0] in FIRST_WORDS:
                bare = " ".join([FIRST_WORDS[words[0]], *words[1:]])
            if bare:
                towns.append(bare)
            if len(words) > 1 and within(words[-1], "hof", 1) <= 1 and len(words[-1]) <= 4:
                towns.append(" ".join(bare.split()[:-1]))
        levels = min(3, bool(towns) + bool(county) + bool(country))
        if levels < 3 and len(towns) > 1 and not county:
            levels += 1  # a county that the list does not hold
        return max(1, levels), towns, county, country, False

    @staticmethod
    def _cut(words: list[str], of: Callable[[str], str], most: int) -> tuple[str, list[str]]:
        """What `of` reads in the last or else the first words, and the words that are left; at least one is."""
        for n in range(most, 0, -1):
            if len(words) > n and (c := of(" ".join(words[-n:]))):
                return c, words[:-n]
        for n in range(most, 0, -1):
            if len(words) > n and (c := of(" ".join(words[:n]))):
                return c, words[n:]
        return "", words

    def read_once(self, text: str | None) -> tuple[int, list[str], str, str, bool]:
        """As `read`, remembering texts that were read before."""
        return self._remembered(text)

    def _exact_county(self, part: str) -> str:
        return self.counties.get(part) or (self.county_of(part) if len(part) >= 8 else "")
