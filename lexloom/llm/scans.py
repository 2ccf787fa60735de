"""Noise in text from scanned pages, and the continuous text without it.

The lines of a text are labelled body, break, header or page by a linear-chain conditional model over layout features of a
line: how it agrees with the document's title, whether it is a number with the signs around page numbers, how the lines
around it begin and end. It is fitted to texts of the corpus set as printed pages, of which the labels are known. Paragraphs are
put together again from the body lines. Broken and misread words, in any script, are told by the counts of words over the whole
corpus: a rare word that a usual misreading makes of a word many times as frequent. Usual misreadings are those of a table for
Latin letters, and those that the counts themselves show. No word is too rare to be counted: the distinct words of the texts and
what they may have been are looked up by joins with the table of counts, and each run of texts gets the verdicts on its own words.
"""

from __future__ import annotations

import math
import random
import re
import textwrap
import unicodedata
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexloom.operators.skew import spread_join
from lexloom.tables import cut, drop

#: A word of at least this share of all words stands by itself; a rarer one may be the part of a broken word.
SHARE = 5e-6
#: So many texts, or characters of texts, are a run, which is repaired with the verdicts on its own words.
RUN_TEXTS, RUN_CHARACTERS = 2_000, 16_000_000
#: The longest word that is judged, and the matches of BROKEN that it can hold, of at least three characters each.
LONGEST, TOUCHING = 40, 14
#: A word is misread only from one that is at least so many times as frequent, and has at least so many rows.
RATIO, LEAST = 25, 8
#: A sign is usually read for another if so many words with FREQUENT rows, and this share of those that hold the other, are read with it.
FREQUENT, LEARNT_WORDS, LEARNT_SHARE = 1_000, 5, 0.5
#: What is read in place of what; the first is read, each of the others may have been printed.
READ_FOR = {
    "1": ["l", "i"], "0": ["o"], "5": ["s"], "8": ["b"], "6": ["b"], "9": ["g"], "|": ["l", "i"], "!": ["l", "i"], "$": ["s"], "@": ["a"],
    "l": ["i"], "i": ["l"], "j": ["i"], "b": ["h"], "h": ["b"], "u": ["n"], "n": ["u"], "c": ["e"], "e": ["c"], "f": ["t"], "t": ["f"],
    "q": ["g"], "g": ["q"], "v": ["y"], "y": ["v"], "m": ["rn", "nn"], "rn": ["m"], "nn": ["rm", "m"], "cl": ["d"], "d": ["cl"],
    "vv": ["w"], "ii": ["u"], "li": ["h"], "ri": ["n"], "iii": ["m"], "in": ["m"], "tn": ["m"], "lo": ["b"],
}
LETTER = "[A-Za-zÀ-῿‌‍]"
WORD = re.compile(rf"{LETTER}+(?:-{LETTER}+)*")
TOKEN = re.compile(rf"[A-Za-z0-9|!$@À-῿‌‍]+(?:-{LETTER}+)*")
#: A word broken at a line's end, the break kept or lost.
BROKEN = re.compile(rf"(?<!{LETTER})({LETTER}++)(?:([-‐])[ \t]*\n\s*|([-‐])[ \t]+|([¬­])\s*)({LETTER}+)")
#: What every match of BROKEN holds; far quicker to look for.
BREAK_SIGN = re.compile(r"[-‐][ \t\n]|[¬\u00ad]")
#: Words that follow a hyphen left open, as in "in- and outgoing".
OPEN_AFTER = frozenset("and or to nor but with as und oder හෝ සහ மற்றும் அல்லது".split())
PAGE = re.compile(r"^[\s\[({<|.~*–—-]*(?:(?:page|pg|p)[\s.]*)?[0-9]{1,4}(?:\s*of\s*[0-9]{1,4})?[\s\])}>|~*–—-]*$", re.IGNORECASE)
PLAIN_NUMBER = re.compile(r"^[0-9]{1,4}$")
NUMBERS = re.compile(r"^[\s0-9.,;:()-]+$")
BESIDE = re.compile(r"^(?:[\s|–—-]*([0-9]{1,4})[\s|–—-]{1,}(?=\D))?(.*?)(?:[\s|–—-]+([0-9]{1,4})[\s|–—-]*)?$", re.DOTALL)
#: A number after these belongs to the sentence; a title after these is cited.
TAKES_NUMBER = re.compile(r"(?:\brs\.?|\bnos?\.?|(?<!-)\bsections?|\bpages?|\bchapter|\bact|\bparagraphs?|\bform)$", re.IGNORECASE)
CITES = re.compile(r"(?:cited|known|called|referred to|entitled|titled)(?:\s+as)?(?:\s+t(?:he|be|lie))?[\s“\"‘']*$", re.IGNORECASE)
SENTENCE_END = re.compile(r"[.!?:;][\"'”’)\]]*$")


def _letter(c: str) -> bool:
    return c.isalpha() or c > "\u02ff" and (unicodedata.category(c)[0] == "M" or c in "\u200c\u200d")


def _digits(word: str) -> bool:
    return not word.isalpha() and any(c != "-" and not _letter(c) for c in word)


def candidate(token: str) -> str | None:
    """A token in lower case; None if it can't be a misread word."""
    word = token.lower()
    if not 2 <= len(word) <= LONGEST:
        return None
    if word.isalpha():
        return word
    letters = sum(map(_letter, word))
    if not letters:
        return None
    # Capitals and digits in one, or a number with one letter, are codes and numbers of sections.
    if _digits(word) and (token[1:] != word[1:] and token != token.upper() or token != word and len(word) <= 3 or letters < 2 and len(word) > 2 or token == token.upper() and token != word and letters < 4):
        return None
    return word


def options(word: str, depth: int | None = None, table: dict[str, list[str]] = READ_FOR) -> list[set[str]]:
    """What may have been printed, by the number of misreadings; at most two, in a short word without digits one."""
    steps: list[set[str]] = []
    edge = {word}
    for _ in range(depth or (2 if _digits(word) or len(word) > 4 else 1)):
        step = set()
        for w in edge:
            for i in range(len(w)):
                for size in (1, 2, 3):
                    for printed in table.get(w[i : i + size], ()) if i + size <= len(w) else ():
                        step.add(w[:i] + printed + w[i + size :])
        steps.append({x for x in step if len(x) > 1 and x != word and ((y := x.replace("-", "")).isalpha() or y and not y.isascii() and all(map(_letter, y)))})
        edge = step
    return steps


def splits(word: str) -> list[int]:
    """Where a word may be two that ran together: never before a mark, which belongs to the letter before it."""
    if _digits(word) or "-" in word:
        return []
    return [at for at in range(1, len(word)) if (min(at, len(word) - at) > 1 or word[:at] == "a") and word[at].isalpha()]


def breaks(first: str, second: str, sure: bool, kept: bool, counts: tuple[int, int, int, int], floor: int) -> bool:
    """Whether a word of two parts with a hyphen at a line's end is one broken in two; counts of the whole, the compound and the parts."""
    whole, compound, one, two = counts
    if second.lower() in OPEN_AFTER:
        return False
    if sure:
        return True
    if whole or compound:
        return whole > compound
    if second[:1].isupper() and not first.isupper():
        return False
    # Two words that stand by themselves make a compound; a part that doesn't was broken off.
    return not (one > 4 * floor and two > 4 * floor) if kept else not (one >= floor and two >= floor)


class Words:
    """What is told by the counts of words, in lower case, where all of them are at hand; judged() tells the same by joins."""

    def __init__(self, counts: dict[str, int], floor: int = 1, table: dict[str, list[str]] = READ_FOR):
        self.counts, self.floor, self.table = counts, floor, table
        self.ordered = sorted(w for w, n in counts.items() if n >= LEAST)

    def count(self, word: str) -> int:
        return self.counts.get(word, 0)

    def least(self, word: str) -> int:
        return max(LEAST, RATIO * self.count(word))

    def misread(self, word: str) -> bool:
        """Whether a word, however many rows it has, is itself read for one many times as frequent; then it is no print."""
        return any(self.count(x) >= self.least(word) for x in options(word, 1, self.table)[0])

    def printed(self, token: str) -> str | None:
        """What a misread token was in print, in lower case; None if it isn't taken to be misread."""
        word = candidate(token)
        if word is None:
            return None
        for step in options(word, None, self.table):
            if known := [(-self.count(x), x) for x in step if self.count(x) >= LEAST and not self.misread(x)]:
                n, best = min(known)
                if -n >= self.least(word):
                    return best
                break
        n, at = max(((min(self.count(word[:at]), self.count(word[at:])), -at) for at in splits(word)), default=(0, 0))
        return f"{word[:-at]} {word[-at:]}" if n >= 4 * self.least(word) else None

    def fixes(self, tokens: set[str]) -> dict[str, str]:
        """What each of the tokens that are misread was in print."""
        return {t: p for t in tokens if (p := self.printed(t))}

    def touches(self, body: str) -> bool:
        return True

    def begins(self, token: str) -> bool:
        """Whether a longer word begins with a token."""
        word = token.lower()
        at = bisect_right(self.ordered, word)
        return at < len(self.ordered) and self.ordered[at].startswith(word)

    def breaks(self, first: str, second: str, sure: bool, kept: bool) -> bool:
        a, b = first.lower(), second.lower()
        return breaks(first, second, sure, kept, (self.count(a + b), self.count(f"{a}-{b}"), self.count(a), self.count(b)), self.floor)


class Verdicts:
    """What was told of the words and broken words of one run of texts."""

    def __init__(self, floor: int):
        self.floor = floor
        self.words: dict[str, tuple[str, bool]] = {}
        self.sound: set[str] = set()  # tokens seen that aren't misread
        self.finder = None  # of the misread words, made when the first text comes
        self.pairs: dict[tuple[str, str], tuple[int, int, int, int]] = {}

    def printed(self, token: str) -> str | None:
        found = self.words.get(token.lower())
        return found[0] if found and candidate(token) else None

    def fixes(self, tokens: set[str]) -> dict[str, str]:
        out = {}
        for t in tokens - self.sound:
            if p := self.printed(t):
                out[t] = p
            else:
                self.sound.add(t)
        return out

    def touches(self, body: str) -> bool:
        """Whether a misread word may stand in a body; what is quick to look for."""
        if not self.words:
            return False
        if self.finder is None:
            try:
                import ahocorasick
            except ImportError:
                return True
            self.finder = ahocorasick.Automaton(ahocorasick.STORE_LENGTH)
            for w in self.words:
                self.finder.add_word(w)
            self.finder.make_automaton()
        return next(self.finder.iter(body.lower()), None) is not None

    def begins(self, token: str) -> bool:
        return self.words[token.lower()][1]

    def breaks(self, first: str, second: str, sure: bool, kept: bool) -> bool:
        return breaks(first, second, sure, kept, self.pairs[first.lower(), second.lower()], self.floor)


BODY, BREAK, HEADER, PAGE_LINE = range(4)


@lru_cache(50_000)
def _bare(title: str) -> str:
    """Letters and digits only, those that are misread for each other made alike."""
    s = re.sub(r"[\x00-/:-`{-\x7f]+", "", title.lower())
    if not s.isascii():
        s = "".join(c for c in s if c.isalnum() or _letter(c) and c not in "\u200c\u200d")
    s = s.replace("rn", "m").replace("nn", "m").replace("vv", "w").replace("cl", "d")
    return s.translate(str.maketrans("10568|b", "loshhlh")).translate(str.maketrans("iuceft", "lnoott"))


def agrees(line: str, title: str | None) -> tuple[float, bool]:
    """How far a line holds the title or its beginning (0 to 1), and whether a page number stands beside it."""
    if not title or len(line) > len(title) + 30:
        return 0.0, False
    whole = _bare(title)
    if len(whole) < 3:
        return 0.0, False
    best = (0.0, False)
    m = BESIDE.match(line.strip())
    options = [(line, False)]
    if m and (m.group(1) or m.group(3)):
        options.append((m.group(2), True))
        if m.group(1) and m.group(3):
            options += [(line[: line.rindex(m.group(3))], True), (line[line.index(m.group(1)) + len(m.group(1)) :], True)]
    for text, beside in options:
        own = _bare(text)
        # A beginning of the title says something if it is two words of some length, a whole title in any case.
        if own == whole or len(own) >= 8 and len(text.split()) >= 2 and whole.startswith(own):
            score = 0.5 + 0.5 * len(own) / len(whole)
            if score > best[0]:
                best = (score, beside)
    return best


#: What a line can show. Those of titles and pages are told only of lines that may be one.
FEATURES = [
    "blank", "text", "title", "title_whole", "title_beside", "title_capitals", "title_breaks_sentence", "title_cited", "title_stopped", "title_goes_on", "title_then_stop",
    "page", "page_signs", "page_plain", "page_breaks_sentence", "page_signs_near_number", "page_plain_near_number", "page_plain_taken", "page_plain_after_colon", "page_in_brackets",
]
_AT = {f: i for i, f in enumerate(FEATURES)}
#: Texts and titles from which the line model is fitted, and rounds of fitting.
SAMPLE_TEXTS, ROUNDS = 800, 6


def line_features(lines: list[str], title: str | None) -> list[list[int]] | None:
    """The features of each line; None where no line can be a header or page number, so that nothing is to be decided."""
    n = len(lines)
    bare = [x.strip() for x in lines]
    told = [agrees(x, title) if i and x else (0.0, False) for i, x in enumerate(bare)]
    paged = [bool(x) and bool(PAGE.match(x)) for x in bare]
    if not any(paged) and not any(t[0] for t in told):
        return None
    before: list[str] = []
    last = ""
    for i, x in enumerate(bare):
        before.append(last)
        if x and not paged[i] and not told[i][0]:
            last = x
    near = [x for x in bare if x]
    out, k = [], -1
    for i, x in enumerate(bare):
        if not x:
            out.append([_AT["blank"]])
            continue
        k += 1
        breaks = bool(before[i]) and not SENTENCE_END.search(before[i])
        after = bare[i + 1] if i + 1 < n else ""
        own = []
        if told[i][0]:
            # "cited as" before and "the" after: what lies between isn't what is cited.
            cited = bool(CITES.search(before[i])) and not (re.match(r"t(?:he|be|lie)\b", after) and not re.search(r"\bt(?:he|be|lie)$", before[i]))
            rest = _bare(title or "")[len(_bare(x)) :]
            own += ["title"] + [f for f, on in (
                ("title_whole", told[i][0] > 0.99), ("title_beside", told[i][1]), ("title_capitals", x.isupper()), ("title_breaks_sentence", breaks), ("title_cited", cited),
                ("title_stopped", x[-1] in ".,;”"), ("title_goes_on", bool(rest and after and _bare(after)[: len(rest)] == rest)), ("title_then_stop", bool(re.match(r"^[.,;”]", after)))) if on]
        if paged[i]:
            signs = not PLAIN_NUMBER.match(x)
            number = any(NUMBERS.match(s) for s in ([near[k - 1]] if k else []) + ([near[k + 1]] if k + 1 < len(near) else []))
            own += ["page", "page_signs" if signs else "page_plain"] + [f for f, on in (
                ("page_breaks_sentence", breaks), ("page_signs_near_number", signs and number), ("page_plain_near_number", not signs and number), ("page_plain_taken", not signs and bool(TAKES_NUMBER.search(before[i]))),
                ("page_plain_after_colon", not signs and before[i].endswith(":")), ("page_in_brackets", bool(re.match(r"^\(?[0-9]{1,3}\)$", x)))) if on]
        out.append([_AT[f] for f in own or ["text"]])
    return out


@dataclass
class LineModel:
    """A linear-chain model: weights of each label for each feature, and of each label after each other."""

    weights: list[list[float]]
    moves: list[list[float]]

    def path(self, features: list[list[int]]) -> list[int]:
        w, moves = self.weights, self.moves
        value = [sum(w[s][f] for f in features[0]) for s in range(4)]
        back = []
        for own in features[1:]:
            step, origin = [], []
            for s in range(4):
                best = max(range(4), key=lambda r: value[r] + moves[r][s])
                step.append(value[best] + moves[best][s] + sum(w[s][f] for f in own))
                origin.append(best)
            back.append(origin)
            value = step
        path = [max(range(4), key=lambda s: value[s])]
        for origin in reversed(back):
            path.append(origin[path[-1]])
        return path[::-1]

    def labels(self, lines: list[str], title: str | None) -> list[tuple[int, bool]]:
        """(label, whether a page number stands beside) of each line."""
        features = line_features(lines, title)
        if features is None:
            return [(BODY if x.strip() else BREAK, False) for x in lines]
        return [(s, s == HEADER and _AT["title_beside"] in f) for s, f in zip(self.path(features), features, strict=True)]


def printed_page(text: str, title: str, rng: random.Random) -> tuple[list[str], list[int]]:
    """A text set in lines with running heads and page numbers as printers set them, and the label of each line."""
    lines, labels = [], []
    width = rng.randrange(44, 80)
    for part in re.split(r"(?<=[.!?”]) (?=\(\d)", " ".join(text.split()))[:8]:
        if lines and rng.random() < 0.3:
            lines.append("")
            labels.append(BREAK)
        if (kind := rng.random()) < 0.08:
            start = rng.randrange(1, 90)
            own = [f"{rng.choice(part.split() or ['Items']).strip('.,;:”“').capitalize()}:", *[str(start + rng.randrange(1, 4) * i) for i in range(rng.randrange(3, 8))]]
        elif kind < 0.16:
            own = [f"{rng.choice(['This', 'These', 'It', 'The same'])} {rng.choice(['may be', 'shall be', 'is'])} {rng.choice(['cited', 'known', 'referred to', 'called'])} as the", *textwrap.wrap(f"{title}.", width)]
        elif kind < 0.2:
            own = [f"({rng.randrange(2, 9)})", *textwrap.wrap(part, width)]
        else:
            own = textwrap.wrap(part, width)
        lines += own
        labels += [BODY] * len(own)
    for _ in range(rng.choice([0, 1, 1, 2])):
        if len(lines) < 2:
            break
        at = rng.randrange(1, len(lines))
        cited = CITES.search(lines[at - 1]) or NUMBERS.match(lines[at - 1]) or NUMBERS.match(lines[at])
        if cited or labels[at - 1] in (HEADER, PAGE_LINE) or labels[at] in (HEADER, PAGE_LINE):
            continue
        n = rng.randrange(1, 300)
        new, told = [], []
        if (kind := rng.random()) < 0.6:
            words = title.split()
            head = title if rng.random() < 0.7 or len(words) < 5 else " ".join(words[: rng.randrange(4, len(words))])
            head = head.upper() if rng.random() < 0.5 else head
            head = f"{n}   {head}" if kind < 0.12 else f"{head}    {n}" if kind < 0.24 else head
            new, told = [head], [HEADER]
        if kind > 0.5:
            new.append(rng.choice([f"- {n} -", f"— {n} —", f"[{n}]", f"Page {n}", f"p. {n}", f"Page {n} of {n + 40}", f"{n} |", f"{n}"]))
            told.append(PAGE_LINE)
        lines[at:at], labels[at:at] = new, told
    return lines, labels


def fit_lines(texts: list[str], titles: list[str], rounds: int = ROUNDS, seed: int = 11) -> LineModel:
    """A model fitted by the averaged perceptron to texts set as printed pages, whose labels are known because they were set here."""
    rng = random.Random(seed)
    titles = [t for t in titles if t and len(t.split()) > 2] or ["General Matters and Other Things Act, No. 1 of 2000"]
    texts = [t for t in texts if t and len(t) > 120] or ["The Council shall hear the appeal before the end of the year and publish what it finds. (2) No fee is due, unless the Council so directs." * 2]
    pages = []
    for i in range(max(len(texts), 400)):
        title = titles[i % len(titles)]
        lines, labels = printed_page(texts[i % len(texts)][:4000], title, rng)
        features = line_features(lines, title) if lines else None
        if features:
            pages.append((features, labels))
    model = LineModel([[0.0] * len(FEATURES) for _ in range(4)], [[0.0] * 4 for _ in range(4)])
    total = LineModel([[0.0] * len(FEATURES) for _ in range(4)], [[0.0] * 4 for _ in range(4)])
    steps = 0
    for _ in range(rounds):
        rng.shuffle(pages)
        for features, labels in pages:
            steps += 1
            told = model.path(features)
            if told == labels:
                continue
            for sign, way in ((1.0, labels), (-1.0, told)):
                for i, s in enumerate(way):
                    for f in features[i]:
                        model.weights[s][f] += sign
                        total.weights[s][f] += sign * steps
                    if i:
                        model.moves[way[i - 1]][s] += sign
                        total.moves[way[i - 1]][s] += sign * steps
    mean = lambda now, sums: [[x - y / max(1, steps) for x, y in zip(a, b, strict=True)] for a, b in zip(now, sums, strict=True)]
    return LineModel(mean(model.weights, total.weights), mean(model.moves, total.moves))


def body_of(text: str, title: str | None, model: LineModel) -> tuple[str, set[str]]:
    """The text without the lines that are headers or page numbers, and the kinds of those."""
    kinds: set[str] = set()
    if "\n" not in text:
        return text, kinds
    lines = text.split("\n")
    kept = []
    for line, (state, beside) in zip(lines, model.labels(lines, title), strict=True):
        if state == HEADER:
            kinds.add("header")
            if beside:
                kinds.add("page")
        elif state == PAGE_LINE:
            kinds.add("page")
        else:
            kept.append(line)
    return "\n".join(kept), kinds


def _unbroken(m: re.Match[str]) -> str:
    first, kept, lost, soft, second = m.groups()
    return m.group() if lost else f"{first}{kept or soft}{second}"


def asked_of(body: str) -> tuple[set[str], set[tuple[str, str]]]:
    """The tokens of a body, whether or not its broken words are joined, and the parts of those."""
    tokens = set(TOKEN.findall(body))
    found = list(BROKEN.finditer(body)) if BREAK_SIGN.search(body) else []
    at = 0
    while at < len(found):
        # Broken words without a blank between them may come to stand in one token.
        end = at + 1
        while end < len(found) and not re.search(r"\s", body[found[end - 1].end() : found[end].start()]):
            end += 1
        left = ("." + body[max(0, found[at].start() - 4 * LONGEST) : found[at].start()] + ".").split()[-1][:-1]
        right = re.match(r"\S*", body[found[end - 1].end() : found[end - 1].end() + 4 * LONGEST]).group()
        for start in range(at, max(at, end - TOUCHING) + 1):
            own = found[start : min(end, start + TOUCHING)]
            forms = [left if start == at else ""]
            for k, m in enumerate(own):
                after = body[m.end() : own[k + 1].start()] if k + 1 < len(own) else right if own[-1] is found[end - 1] else ""
                forms = [f"{x}{y}{after}" for x in forms for y in {m[1] + m[5], _unbroken(m)}]
            for x in forms:
                tokens.update(TOKEN.findall(x))
        at = end
    return tokens, {(m[1].lower(), m[5].lower()) for m in found}


def repair(text: str, title: str | None, words: Words, model: LineModel) -> tuple[str, list[str]]:
    """The text without its noise, as one line a paragraph, and the kinds of noise found in it, in alphabetical order."""
    body, kinds = body_of(text, title, model)
    return mended(body, kinds, words)


def mended(body: str, kinds: set[str], words: Words | Verdicts) -> tuple[str, list[str]]:
    """The same from a body and the kinds of its lines that are gone."""

    def join(m: re.Match[str]) -> str:
        first, kept, lost, soft, second = m.groups()
        if words.breaks(first, second, bool(soft), bool(kept)):
            kinds.add("hyphen")
            return first + second
        return _unbroken(m)

    if BREAK_SIGN.search(body):
        body = BROKEN.sub(join, body)

    fixes = words.fixes(set(TOKEN.findall(body))) if words.touches(body) else {}
    if fixes:
        # The last word of a text without an end may be the beginning of a word cut off, which isn't misread.
        ends = re.search(r"[^\W_]+$", body)
        if ends and ends.group() in fixes and body.count(ends.group()) == 1 and words.begins(ends.group()):
            del fixes[ends.group()]
        fixes = {t: p for t, p in fixes.items() if re.search(rf"(?<![\w/-]){re.escape(t)}(?![\w/]|-\w)", body)}
    if fixes:
        kinds.add("char")
        body = re.sub(r"(?<![\w/-])(?:" + "|".join(sorted(map(re.escape, fixes), key=len, reverse=True)) + r")(?![\w/]|-\w)", lambda m: _cased(fixes[m.group()], m.group()), body)
    return paragraphs(body), sorted(kinds)


def _cased(printed: str, read: str) -> str:
    if read.isupper() and len(read) > 1:
        return printed.upper()
    return printed[:1].upper() + printed[1:] if read[:1].isupper() else printed


def paragraphs(text: str) -> str:
    """Lines of one paragraph joined by blanks; a blank line, or one that opens with a number or letter in brackets, parts them."""
    if "\n" not in text:
        return text
    out: list[str] = []
    fresh = True
    for line in text.split("\n"):
        line = line.strip()
        if not line:
            fresh = True
            continue
        if fresh or not out or re.match(r"^(?:\([0-9a-zA-Z]{1,4}\)|[0-9]{1,3}[A-Z]?\.)\s", line) or NUMBERS.match(line) or "|" in line:
            out.append(line)
        else:
            out[-1] += " " + line
        fresh = False
    return "\n".join(out)


def count_words(texts: DataFrame) -> DataFrame:
    """(word, n): how often each word, in lower case and with its hyphens, stands in the texts; counted in the tasks first."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[str] = Counter()
        for batch in batches:
            for text in batch.column(0).to_pylist():
                counts.update(WORD.findall(text.lower()))
            if len(counts) > 400_000:
                yield _batch(counts)
                counts = Counter()
        yield _batch(counts)

    def _batch(counts: Counter[str]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], names=["word", "n"])

    return texts.where("text is not null").select("text").mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def looked_up(rows: DataFrame, column: str, counts: DataFrame, name: str) -> DataFrame:
    """rows with the count of a column's word as `name`, 0 where there is none."""
    own = counts.select(F.col("word").alias("_word"), F.col("n").alias("_n"))
    return rows.join(own, F.col(column) == F.col("_word"), "left").withColumn(name, F.coalesce("_n", F.lit(0))).drop("_word", "_n")


def learnt(counts: DataFrame, frequent: int = FREQUENT, words: int = LEARNT_WORDS, share: float = LEARNT_SHARE) -> dict[str, list[str]]:
    """What is read in place of what, by the counts of words: READ_FOR and what frequent words are usually read with.

    Words that differ in one sign meet under what they have in common, of which no more can hang together than there are signs.
    Endings and other words that happen to differ in one letter do so in few of the words with it; a misreading does in most.
    """
    own = counts.where((F.length("word") >= 3) & (F.length("word") <= LONGEST))
    place = F.explode(F.sequence(F.lit(1), F.length("word"))).alias("i")
    gap = F.concat(F.left("word", F.col("i") - 1), F.lit("\u0001"), F.substring("word", F.col("i") + 1, F.lit(LONGEST)))
    spots = lambda df, sign, n: df.select("word", "n", place).select("word", gap.alias("gap"), F.substring("word", F.col("i"), F.lit(1)).alias(sign), F.col("n").alias(n))
    often = own.where(F.col("n") >= frequent)
    pairs = spots(own, "read", "few").drop("word").join(spots(often, "printed", "many"), "gap").where((F.col("read") != F.col("printed")) & (F.col("few") * RATIO <= F.col("many")))
    met = pairs.groupBy("read", "printed").agg(F.count_distinct("word").alias("words")).where(F.col("words") >= words)
    held = often.select(F.explode(F.array_distinct(F.split("word", ""))).alias("printed")).groupBy("printed").agg(F.count("*").alias("all"))
    # No more rows than there are pairs of signs.
    rows = met.join(held, "printed").where(F.col("words") >= share * F.col("all")).collect()
    table = {k: list(v) for k, v in READ_FOR.items()}
    for r in sorted(rows, key=lambda r: (r["read"], -r["words"], r["printed"])):
        if r["printed"] not in table.setdefault(r["read"], []):
            table[r["read"]].append(r["printed"])
    return table


def tried(words: DataFrame, counts: DataFrame, depth: int | None = None, table: dict[str, list[str]] = READ_FOR) -> DataFrame:
    """(word, least, depth, at, part, n): the options of each word that are words with LEAST rows, and at depth 3 the parts of its splits."""

    def attempt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 500):
                out: list[tuple] = []
                some = batch.slice(start, 500)
                for word, least in zip(some.column("word").to_pylist(), some.column("least").to_pylist(), strict=True):
                    out += [(word, least, k, 0, x) for k, step in enumerate(options(word, depth, table), 1) for x in step]
                    out += [(word, least, 3, at, x) for at in splits(word) if not depth for x in (word[:at], word[at:])]
                columns = list(zip(*out, strict=True)) if out else [[]] * 5
                yield pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.int32(), pa.int32(), pa.string()), strict=True)], names=["word", "least", "depth", "at", "part"])

    rows = words.select("word", "least").mapInArrow(attempt, "word string, least long, depth int, at int, part string")
    return rows.join(counts.where(F.col("n") >= LEAST).select(F.col("word").alias("part"), "n"), "part")


def judged(words: DataFrame, counts: DataFrame, table: dict[str, list[str]] = READ_FOR) -> DataFrame:
    """(word, printed, begins) of the distinct words that are misread; begins: a longer word begins with it. As Words tells it."""
    spark = words.sparkSession
    least = lambda n: F.greatest(F.lit(LEAST).cast("long"), RATIO * F.col(n))
    own = looked_up(words.select("word").distinct(), "word", counts, "own").select("word", least("own").alias("least"))
    hits = cut(tried(own, counts, None, table))
    found = hits.where("depth < 3")
    misread = tried(found.select(F.col("part").alias("word"), least("n").alias("least")).distinct(), counts, 1, table).where("n >= least").select(F.col("word").alias("part")).distinct()
    best = found.join(misread, "part", "left_anti").groupBy("word", "least").agg(F.min(F.struct("depth", (-F.col("n")).alias("less"), "part")).alias("best"))
    one = best.where(-F.col("best.less") >= F.col("least")).select("word", F.col("best.part").alias("printed"))
    parts = hits.where("depth = 3").groupBy("word", "least", "at").agg(F.count("*").alias("parts"), F.min("n").alias("n")).where("parts = 2 and n >= 4 * least")
    two = parts.groupBy("word").agg(F.max(F.struct("n", (-F.col("at")).alias("before"))).alias("best")).select("word", (-F.col("best.before")).alias("at"))
    two = two.select("word", F.concat(F.expr("left(word, at)"), F.lit(" "), F.expr("substr(word, at + 1)")).alias("printed")).join(one, "word", "left_anti")
    told = cut(one.unionByName(two))
    drop(spark, hits)
    starts = counts.where((F.col("n") >= LEAST) & (F.length("word") > 1)).select(F.explode(F.expr("transform(sequence(1, length(word) - 1), i -> left(word, i))")).alias("word"))
    return told.join(starts.distinct().withColumn("begins", F.lit(True)), "word", "left").select("word", "printed", F.coalesce("begins", F.lit(False)).alias("begins"))


def fitted_lines(chunks: DataFrame, docs: DataFrame, rows: int = SAMPLE_TEXTS) -> LineModel:
    """The line model of a corpus, from the texts and titles with the smallest hashes, `rows` of each."""

    def sample(df: DataFrame, key: str, value: str) -> list[str]:
        some = df.where(F.col(value).isNotNull()).select(key, F.substring(value, 1, 4000).alias("value"))
        share = min(1.0, 4.0 * rows / max(1, some.count()))
        place = F.pmod(F.xxhash64(key), F.lit(1 << 30))
        return [r.value for r in some.where(place < int(share * (1 << 30))).orderBy(place, "value").limit(rows).select("value").collect()]

    return fit_lines(sample(chunks, "id", "text"), sample(docs, "doc_key", "title"))


RUNS = "run long, place int, id string, text string, noise array<string>, a string, b string, counts array<long>"
_RUNS = pa.schema([("run", pa.int64()), ("place", pa.int32()), ("id", pa.string()), ("text", pa.string()), ("noise", pa.list_(pa.string())), ("a", pa.string()), ("b", pa.string()), ("counts", pa.list_(pa.int64()))])


def in_runs(texts: DataFrame, model: LineModel) -> DataFrame:
    """(id, text, title) as runs of texts: at place 0 the words of a run that may be misread (a), at 1 its broken words (a, b), at 2 its bodies."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        run, size, rows = TaskContext.get().partitionId() << 32, 0, 0
        tokens: set[str] = set()
        pairs: set[tuple[str, str]] = set()

        def asked() -> pa.RecordBatch:
            words = {w for t in tokens if (w := candidate(t))}
            n, m = len(words), len(pairs)
            first, second = [*words, *(a for a, _ in pairs)], [None] * n + [b for _, b in pairs]
            return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(([run] * (n + m), [0] * n + [1] * m, [None] * (n + m), [None] * (n + m), [None] * (n + m), first, second, [None] * (n + m)), _RUNS, strict=True)], schema=_RUNS)

        for batch in batches:
            out = []
            for id_, text, title in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                if rows >= RUN_TEXTS or size >= RUN_CHARACTERS:
                    yield asked()
                    run, size, rows = run + 1, 0, 0
                    tokens.clear()
                    pairs.clear()
                body, kinds = body_of(text, title, model)
                own, broken = asked_of(body)
                tokens |= own
                pairs |= broken
                size, rows = size + len(body), rows + 1
                out.append({"run": run, "place": 2, "id": id_, "text": body, "noise": sorted(kinds)})
            yield pa.RecordBatch.from_pylist(out, schema=_RUNS)
        yield asked()

    return texts.select("id", "text", "title").mapInArrow(build, RUNS)


def repaired(chunks: DataFrame, docs: DataFrame, with_text: bool = True, model: LineModel | None = None, share: float = SHARE, frequent: int = FREQUENT) -> DataFrame:
    """(id, text, noise) of every chunk with a text: the repaired text, or null without with_text, and the kinds of noise found.

    docs gives the titles (doc_key, title); of repeated keys the last title by bytes counts, and a chunk without a title has
    no headers. Null texts give no row, empty ones an empty text; texts of any length are read whole; repeated ids come out
    each. Only texts with line breaks are joined with titles; a document with very many chunks is spread over tasks.
    """
    counts = cut(count_words(chunks))
    floor = max(1, math.ceil((counts.agg(F.sum("n")).first()[0] or 0) * share))
    texts = chunks.where("text is not null").select("id", "doc_key", "text")
    lined = F.col("text").contains("\n")
    titles = docs.where("doc_key is not null").groupBy(F.col("doc_key").alias("key")).agg(F.max("title").alias("title"))
    sizes = chunks.groupBy(F.col("doc_key").alias("size_key")).agg(F.count("*").alias("rows"))
    known = titles.join(sizes, F.col("key") == F.col("size_key")).select("key", "rows", "title")
    joined = spread_join(texts.where(lined), known, "doc_key", "rows", ["title"]).select("id", "text", "title")
    plain = texts.where(~lined).select("id", "text", F.lit(None).cast("string").alias("title"))
    runs = cut(in_runs(joined.unionByName(plain), model or fitted_lines(chunks, docs)))

    asked = runs.where("place = 0").select("run", F.col("a").alias("word"))
    words = judged(asked, counts, learnt(counts, frequent)).join(asked, "word").select("run", F.lit(0).alias("place"), F.col("word").alias("a"), F.col("printed").alias("b"), F.array(F.col("begins").cast("long")).alias("counts"))
    broken = runs.where("place = 1").select("run", "a", "b")
    pairs = broken.select("a", "b").distinct().withColumns({"ab": F.concat("a", "b"), "a_b": F.concat("a", F.lit("-"), "b")})
    for column in ("ab", "a_b", "a", "b"):
        pairs = looked_up(pairs, column, counts, f"n_{column}")
    pairs = broken.join(pairs, ["a", "b"]).select("run", F.lit(1).alias("place"), "a", "b", F.array("n_ab", "n_a_b", "n_a", "n_b").alias("counts"))

    def mend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, own = None, Verdicts(floor)
        for batch in batches:
            out = []
            for run, place, id_, text, noise, a, b, counted in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if run != at:
                    at, own = run, Verdicts(floor)
                if place == 0:
                    own.words[a] = (b, bool(counted[0]))
                elif place == 1:
                    own.pairs[a, b] = tuple(counted)
                else:
                    out.append((id_, *mended(text, set(noise), own)))
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.string()), pa.array([x[1] if with_text else None for x in out], pa.string()), pa.array([x[2] for x in out], pa.list_(pa.string()))], names=["id", "text", "noise"])

    every = runs.where("place = 2").unionByName(words, allowMissingColumns=True).unionByName(pairs, allowMissingColumns=True)
    return every.repartition("run").sortWithinPartitions("run", "place").mapInArrow(mend, "id string, text string, noise array<string>")
