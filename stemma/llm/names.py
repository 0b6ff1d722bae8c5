"""Reading names as typed: the surname, the given names and the suffix of a person, the words of an organisation.

Which given names and which words stand for each other isn't listed here; `stemma.llm.aliases` learns it from the names.
"""

from __future__ import annotations

import re
from functools import lru_cache

from stemma.llm.placetext import fold_name

# Titles, and suffixes that tell namesakes apart.
TITLES = frozenset("mrs mr ms miss mme mlle frau herr fraulein rev revd dr capt hon sgt col maj lt sir lady prof wwe wid widow witwe don dona senora senor pfr".split())
ELDER, YOUNGER = frozenset(("sr", "sen", "snr", "elder", "senior")), frozenset(("jr", "jun", "jnr", "younger", "junior"))
# Words of organisations that name no one.
FILLERS = frozenset("and son sons bro bros brothers company co comp inc ltd the of for in at der die das und et de la le del".split())

_SOUNDS = tuple((re.compile(a), b) for a, b in (("eau|au", "o"), ("sch", "sh"), ("ck|c", "k"), ("ph", "f"), ("qu", "kv"), ("x", "ks"), ("dt", "t"), ("th", "t"), ("tz|z", "s"), ("w", "v"), ("ie|y|j", "i"), ("ai|ay|ey", "ei"), (r"(.)\1+", r"\1")))
_FOLDED = lru_cache(200_000)(fold_name)
_BREAK, _LETTER, _SLASHED = re.compile(r"[\s,/]+"), re.compile(r"\w"), re.compile(r"/([^/]+)/")


@lru_cache(200_000)
def sound(word: str) -> str:
    """One spelling for the ways in which a name is written by ear."""
    s = fold_name(word).replace(" ", "")
    for a, b in _SOUNDS:
        s = a.sub(b, s)
    return s


@lru_cache(200_000)
def token(word: str) -> str:
    """A word folded; an abbreviation keeps its full stop, an initial is one letter."""
    w = _FOLDED(word).replace(" ", "")
    return w + "." if len(w) > 1 and word.endswith(".") else w


@lru_cache(200_000)
def _says(word: str) -> str | None:
    """The suffix that a word is; empty for a title or an article, None for a part of the name."""
    f = _FOLDED(word)
    if f in ELDER or f in YOUNGER:
        return "elder" if f in ELDER else "younger"
    return "" if f in TITLES and len(f) > 1 or f in ("the", "der", "die", "of") else None


def _words(text: str) -> list[str]:
    words = _BREAK.split(text) if "," in text or "/" in text else text.split()
    return [w for w in words if w.isalnum() or _LETTER.search(w)]


def read_words(text: str | None) -> list[str]:
    """The words of an organisation's name without its fillers; all of them if there are no others."""
    every = [t for w in _words(text or "") if (t := token(w))]
    return sorted({t for t in every if t.strip(".") not in FILLERS} or set(every))


def read_name(text: str | None) -> tuple[str, str, str, str]:
    """(surname by sound, first, middle, suffix) of a person's name as typed; each may be empty.

    Given names are folded words; an initial is one letter, an abbreviation ends with a full stop. A name of titles or
    suffixes only has their sound as its surname.
    """
    if not text or not text.strip():
        return "", "", "", ""
    slashed = _SLASHED.search(text) if "/" in text else None
    bare = text.replace("/", " ") if not slashed else text[: slashed.start()] + " " + text[slashed.end() :]
    suffix, kept = "", []
    # a comma after the first words marks the surname before it
    head, comma, tail = bare.partition(",")
    parts = [(w, bool(comma)) for w in _words(head)] + ([(w, False) for w in _words(tail)] if tail else [])
    for part in parts:
        said = _says(part[0])
        if said is None:
            kept.append(part)
        elif said:
            suffix = said
    if slashed:
        sur, names = slashed.group(1), [w for w, _ in kept]
    elif any(first for _, first in kept) and not all(first for _, first in kept):
        sur, names = " ".join(w for w, first in kept if first), [w for w, first in kept if not first]
    elif len(kept) > 1:
        ws = [w for w, _ in kept]
        ends = (ws[0], ws[-1])
        shout = [w.isupper() and len(w.strip(".")) > 1 for w in ends]
        brief = [len(w.strip(".")) == 1 or w.endswith(".") for w in ends]
        turned = (shout[0] and not shout[-1]) or (brief[-1] and not brief[0] and not (shout[-1] and not shout[0]))
        sur, names = (ws[0], ws[1:]) if turned else (ws[-1], ws[:-1])
    else:
        sur, names = (kept[0][0] if kept else " ".join(w for w, _ in parts)), []
    g = [t for w in names if (t := token(w))]
    return sound(sur), (g[0] if g else ""), (g[1] if len(g) > 1 else ""), suffix
