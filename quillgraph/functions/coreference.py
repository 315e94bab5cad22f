"""Which mentions of a short window of text mean the same thing: sieves from the surest rule to the least sure.

Mentions are names (capitalised words with numbers after them), definite nouns ("the company") and pronouns, in English. Clusters
start from names. The sieves, after the multi-pass design of Raghunathan et al. (2010): equal names; initials of a name; names that are
part of one longer name only; definite nouns with the last word or the kind of one name only; pronouns, by the nearest sentence and in it
the first mention that fits in number and gender. Pronouns of the first and second person aren't mentions.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections import defaultdict

# Words that the rules look up.
MALE = frozenset("he him his himself".split())
FEMALE = frozenset("she her hers herself".split())
THING = frozenset("it its itself".split())
PLURAL = frozenset("they them their theirs themselves".split())
MALE_TITLES = frozenset("mr sir king prince lord".split())
FEMALE_TITLES = frozenset("mrs ms miss madam queen princess lady".split())
TITLES = MALE_TITLES | FEMALE_TITLES | frozenset("dr prof professor president judge".split())
COMPANY = frozenset("inc corp corporation company co ltd llc plc gmbh group bank firm".split())
COMPANY_NOUNS = frozenset("company firm corporation business organization organisation employer".split())
NOT_NAMES = frozenset(
    "the a an this that these those and or but nor so yet if when while where who what which why how there here then also however moreover i we you my your our me us"
    " in on at by for from to of with as after before since until during under over is are was were be been being has have had do does did will would can could may might"
    " shall should must not no yes all any each every some many most few both later now today yesterday once again still perhaps only even".split()
)

_WORD = re.compile(r"[^\W_]+(?:[-'’&][^\W_]+)*\.?")
_PLEONASTIC = re.compile(r"\s+(?:is|was|seems|seemed|appears|appeared)\s+(?:[^\W\d_]+\s+){0,2}(?:that|to)\b|\s+(?:rains|rained|snows|snowed)\b")
_LOOK_BACK = 2


class _Cluster:
    def __init__(self) -> None:
        self.best, self.mentions = "", []
        self.gender: str | None = None  # m, f, thing or plural once it is known

    def add(self, start: int, end: int, text: str) -> None:
        self.mentions.append((start, end))
        if len(text) > len(self.best):
            self.best = text


def _words(text: str) -> list[tuple[int, int, str]]:
    """Words with their places; the full stop of a title or an initial belongs to it, another one doesn't."""
    out = []
    for m in _WORD.finditer(text):
        word, end = m.group(), m.end()
        if word[-1] == ".":
            bare = word[:-1]
            if bare.lower() not in TITLES and not (len(bare) == 1 and bare.isupper()):
                word, end = bare, end - 1
        for possessive in ("'s", "’s"):
            if word.endswith(possessive) and len(word) > 2:
                word, end = word[:-2], end - 2
        out.append((m.start(), end, word))
    return out


def _sentences(text: str, words) -> list[int]:
    """Where sentences start: words after a mark that isn't part of the word before, and after empty lines."""
    starts = [0]
    for (_, a, _), (b, _, _) in zip(words, words[1:]):
        gap = text[a:b]
        if any(c in ".!?" for c in gap) or gap.count("\n") > 1:
            starts.append(b)
    return starts


def _names(words, text: str, starts: set[int]) -> list[tuple[int, int, str]]:
    """Runs of capitalised words. A single word that only ever starts sentences is a name if it has a second capital or a digit."""
    runs, i = [], 0
    capital = lambda w: w[0].isupper() and w.rstrip(".").lower() not in NOT_NAMES
    while i < len(words):
        start, end, word = words[i]
        j = i + 1
        if capital(word) and word.lower() not in MALE | FEMALE | THING | PLURAL:
            while j < len(words) and text[end : words[j][0]] in (" ", "\n") and (capital(words[j][2]) or words[j][2].isdigit()):
                end, j = words[j][1], j + 1
            runs.append((start, end, text[start:end], j - i))
        i = j
    inside = {t.lower() for s, _, t, _ in runs if s not in starts}
    inside |= {w.lower() for _, _, t, n in runs if n > 1 for w in t.split()}
    return [(s, e, t) for s, e, t, n in runs if n > 1 or s not in starts or t.lower() in inside or sum(c.isupper() or c.isdigit() for c in t) > 1]


def _gender(name: str) -> str | None:
    words = [w.rstrip(".").lower() for w in name.split()]
    if words[0] in MALE_TITLES:
        return "m"
    if words[0] in FEMALE_TITLES:
        return "f"
    return "thing" if words[-1] in COMPANY else None


def _pronoun(word: str) -> str | None:
    low = word.lower()
    return "m" if low in MALE else "f" if low in FEMALE else "thing" if low in THING else "plural" if low in PLURAL else None


def _fits(cluster: _Cluster, kind: str) -> bool:
    """A company may be "they"; a name of unknown kind may be any single thing, until a pronoun has settled it."""
    if kind == "plural":
        return cluster.gender in ("plural", "thing") and (cluster.gender == "plural" or cluster.best.split()[-1].rstrip(".").lower() in COMPANY)
    return cluster.gender in (None, kind)


def clusters(text: str) -> list[tuple[str, list[tuple[int, int]]]]:
    """(longest mention, places in order) of each thing that is mentioned more than once."""
    words = _words(text)
    starts = _sentences(text, words)
    names = _names(words, text, set(starts))
    of_key: dict[str, _Cluster] = {}
    for start, end, name in names:
        key = " ".join(w.rstrip(".") for w in name.lower().split())
        of_key.setdefault(key, _Cluster()).add(start, end, name)
    merged = _merge_names(of_key)
    told = {place: c for c in merged for place in c.mentions}
    for c in merged:
        c.gender = _gender(c.best)
    _link_rest(text, words, starts, merged, told)
    return sorted(((c.best, sorted(c.mentions)) for c in merged if len(c.mentions) > 1), key=lambda x: x[1])


def _merge_names(of_key: dict[str, _Cluster]) -> list[_Cluster]:
    """Initials and parts of names go to the one longer name that has them; with several such names they stay alone."""
    whole = {k: tuple(w for w in k.split() if w not in TITLES) or tuple(k.split()) for k in of_key}
    initials, holders = defaultdict(set), defaultdict(set)
    for key, own in whole.items():
        if len(own) > 1:
            initials["".join(w[0] for w in own)].add(key)
            initials["".join(w[0] for w in own if w not in COMPANY)].add(key)
            for w in set(own):
                holders[w].add(key)
    goes: dict[str, str] = {}
    for key, own in whole.items():
        if len(own) == 1 and of_key[key].best.isupper() and len(own[0]) > 1 and len(initials[own[0]]) == 1:
            goes[key] = next(iter(initials[own[0]]))
            continue
        rarest = min((holders[w] for w in own), key=len)
        longer = [k for k in rarest if k != key and (len(whole[k]), k) > (len(own), key) and any(whole[k][i : i + len(own)] == own for i in range(len(whole[k]) - len(own) + 1))]
        if len({whole[k] for k in longer}) == 1 and not (own[-1] in COMPANY and len(own) == 1):
            goes[key] = max(longer)
    out: dict[str, _Cluster] = {}
    for key, c in of_key.items():
        top = key
        while top in goes:
            top = goes[top]
        into = out.setdefault(top, _Cluster())
        for start, end in c.mentions:
            into.add(start, end, c.best)
    return list(out.values())


def _link_rest(text: str, words, starts: list[int], merged: list[_Cluster], told: dict) -> None:
    """Definite nouns and pronouns, from left to right; what a pronoun shows about a name counts for later ones."""
    by_last, companies = defaultdict(list), []
    for c in merged:
        by_last[c.best.split()[-1].rstrip(".").lower()].append(c)
        if c.gender == "thing":
            companies.append(c)
    begins = {s: (e, c) for (s, e), c in told.items()}
    recent: list[list[_Cluster]] = [[] for _ in starts]
    skip = -1
    for i, (start, end, word) in enumerate(words):
        sentence = bisect_right(starts, start) - 1
        if start in begins:
            skip, c = begins[start]
            recent[sentence].append(c)
            continue
        if start < skip:
            continue
        low, found = word.lower(), None
        if low in ("the", "this", "that") and i + 1 < len(words) and text[end : words[i + 1][0]] == " " and words[i + 1][2].islower():
            noun = words[i + 1][2]
            near = [c for c in by_last.get(noun, ()) if c.mentions[0][0] < start]
            if not near and noun in COMPANY_NOUNS:
                near = [c for c in companies if c.mentions[0][0] < start]
            if len(near) == 1:
                found, end = near[0], words[i + 1][1]
        elif (kind := _pronoun(word)) and not (low == "it" and _PLEONASTIC.match(text, end)):
            for back in range(sentence, max(-1, sentence - _LOOK_BACK - 1), -1):
                found = next((c for c in recent[back] if _fits(c, kind)), None)
                if found is not None:
                    found.gender = found.gender or kind
                    break
        if found is not None:
            found.mentions.append((start, end))
            recent[sentence].append(found)
            skip = end


def replacements(before: str | None, content: str | None) -> list[tuple[int, int, str]]:
    """(start, end, mention) for the short mentions in ``content`` that mean something named longer in it or in the chunk before."""
    if not content:
        return []
    lead = f"{before}\n\n" if before else ""
    at = len(lead)
    window = lead + content
    return sorted((s - at, e - at, best) for best, places in clusters(window) for s, e in places if s >= at and window[s:e] != best and len(window[s:e].split()) <= 3)
