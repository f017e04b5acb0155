"""Operator 5: personal data by a semi-Markov conditional random field.

Candidate segments are cut out of a text by entity kind: what stands around an at-sign (written as such or
spelled out) and ends with a label of its domain, and runs of neighbouring groups of digits with as many
digits as a kind can have. Features of the whole segment (its form, its groups and check digit),
of its edges and of its surroundings (cue words, line ends) score it as an email address, an IP address, a card or a
phone number; a second set of weights scores the kinds of two entities that stand near each other. Dynamic
programming over end positions and kinds picks boundaries and types together; what lies between entities
scores 0. Entities are bounded by their kinds: 19 digits for cards, 15 for phones, four parts for
addresses; names and domains of email are as long as they run. So the work grows in proportion to the text.

The weights are fitted by maximum likelihood, with the forward and backward sums of the same
dynamic programming, on FIT_LINES lines that a seeded generator writes and labels. Spans in the fixed formats of the contract
always stay; the field adds spans that touch none of them.
"""

from __future__ import annotations

import bisect
import math
import random
import re
from collections import defaultdict
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache
from typing import Any, NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from cladeworks.llm.common import text_or_empty

KINDS = ("email", "ip", "card", "phone")
# The formats of the contract.
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")  # a match starts where digits start, so long runs are read once
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

HINT = r"[0-9@]|[\[({]at[\])}]| dot "  # a text without any of these has no entity
MOST_DIGITS = 19
NEAR = 8  # characters between two entities up to which their kinds are scored as a pair
FIT_LINES = 420
FIT_ROUNDS = 60


class Span(NamedTuple):
    start: int
    rank: int  # of the kind
    stop: int


def luhn(digits: str) -> bool:
    """Whether the last digit is the right check digit."""
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def _byte(part: str) -> bool:
    """Whether digits are a number of at most 255, however many zeros lead it."""
    part = part.lstrip("0")
    return len(part) < 3 or (len(part) == 3 and part <= "255")


def base_spans(text: str) -> list[Span]:
    """Spans in the fixed formats: leftmost and non-overlapping in each kind, failing ones dropped."""
    out: list[Span] = []
    end = 0
    at = text.find("@")
    while at >= 0:
        if at >= end:
            start = at
            while start > end and text[start - 1] in LOCAL:
                start -= 1
            found = DOMAIN.match(text, at + 1) if start < at else None
            if found:
                end = found.end()
                out.append(Span(start, 0, end))
        at = text.find("@", at + 1)
    for m in IP.finditer(text):
        if all(_byte(x) for x in m[0].split(".")):
            out.append(Span(m.start(), 1, m.end()))
    for m in CARD.finditer(text):
        digits = _digits(m[0])
        if 12 <= len(digits) <= 19 and luhn(digits):
            out.append(Span(m.start(), 2, m.end()))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 9 <= len(_digits(m[0])) <= 15:
                out.append(Span(m.start(), 3, m.end()))
    return sorted(out)


# --- candidate segments and their features

FEATURES = (
    "any", "plain_at", "spelled_at", "worded_at", "letters_last", "whole_domain", "quad", "quad_over", "one_run", "fours", "even", "luhn", "card_length", "plus",
    "abroad", "national", "brackets", "calendar", "few", "many", "glued_left", "glued_right", "chain_left", "chain_right", "odd_bracket",
    "cue_email", "cue_ip", "cue_card", "cue_phone", "cue_other", "line_start", "line_end", "dots",
)
AT = {name: i for i, name in enumerate(FEATURES)}
WIDTH = len(FEATURES)

SIGN = re.compile(r"@| ?[\[({]at[\])}] ?| at (?=[A-Za-z0-9-]+ dot )")
LABEL = re.compile(r"[A-Za-z0-9-]+")
POINT = re.compile(r"\.| ?[\[({]dot[\])}] ?| dot ")
GROUP = re.compile(r"[0-9]++")
BETWEEN = frozenset(" .-()/")  # may stand between groups of digits of one number
WORD = re.compile(r"[^\W\d_]+")
CUES = {
    "cue_email": "email mail mailto correo courriel contact contacto write kontakt",
    "cue_ip": "ip host server address addr login client node",
    "cue_card": "card visa mastercard amex credit debit karte tarjeta carte kreditkarte",
    "cue_phone": "tel phone telephone telefon call mobile cell fax handy anruf movil sms",
    "cue_other": "order isbn version ref reference id no number total eur usd invoice page release build serial year date rev",
}
CUE_OF = {word: AT[cue] for cue, words in CUES.items() for word in words.split()}
LOOKBACK = 24  # characters before a segment in which a cue word counts


class Segment(NamedTuple):
    start: int
    stop: int
    rank: int  # of the kind
    features: tuple[int, ...]  # numbers of those that hold


ANY, GLUED_LEFT, GLUED_RIGHT, LINE_START, LINE_END = (AT[x] for x in ("any", "glued_left", "glued_right", "line_start", "line_end"))
CHAIN_LEFT, CHAIN_RIGHT = AT["chain_left"], AT["chain_right"]
DATES = frozenset(((4, 2, 2), (2, 2, 4), (4, 1, 2), (4, 2, 1)))
DOUBLED = (0, 2, 4, 6, 8, 1, 3, 5, 7, 9)  # a digit twice, its digits summed
KNOWN = 50_000  # looks of runs that a task remembers before it starts anew


def _left(text: str, start: int) -> tuple[int, ...]:
    """Features of what stands before a segment."""
    before = text[max(0, start - LOOKBACK) : start]
    line = before[before.rfind("\n") + 1 :]
    out = []
    if before and (before[-1].isalnum() or before[-1] in "@_%+-/."):
        out.append(GLUED_LEFT)
    if not line.strip():
        if start <= LOOKBACK or "\n" in before:
            out.append(LINE_START)
    else:
        out += {CUE_OF[w] for w in WORD.findall(line.lower())[-2:] if w in CUE_OF}
    return tuple(out)


def _right(text: str, stop: int) -> tuple[int, ...]:
    """Features of what stands behind a segment."""
    after = text[stop : stop + 2]
    if not after or after[0] == "\n":
        return (LINE_END,)
    if after[0].isalnum() or (after[0] in "@_-./%" and after[1:].isalnum()):
        return (GLUED_RIGHT,)
    return ()


def address_segments(text: str) -> Iterator[Segment]:
    """Around every at-sign: what can be a name, with the domain cut behind each of its labels from the second on."""
    for sign in SIGN.finditer(text):
        start = sign.start()
        while start and text[start - 1] in LOCAL:
            start -= 1
        while start < sign.start() and text[start] in "._%+-":
            start += 1
        if start == sign.start():
            continue
        form = AT["plain_at" if sign[0] == "@" else "worded_at" if sign[0] == " at " else "spelled_at"]
        left = None
        label, labels = LABEL.match(text, sign.end()), 0
        while label:
            labels += 1
            point = POINT.match(text, label.end())
            follows = LABEL.match(text, point.end()) if point else None
            if labels > 1:
                left = _left(text, start) if left is None else left
                own = [ANY, form]
                if len(label[0]) > 1 and label[0].isalpha():
                    own.append(AT["letters_last"])
                if not follows:
                    own.append(AT["whole_domain"])
                yield Segment(start, label.end(), 0, (*own, *left, *_right(text, label.end())))
            label = follows


Judge = Callable[[int, tuple[int, ...]], Any]


def number_segments(text: str) -> Iterator[Segment]:
    """Runs of neighbouring groups of digits that an address, a card or a phone number can have, with a sign or bracket before them."""
    for at, stop, kinds in number_runs(text, lambda rank, features: 0, {}):
        for rank, features, _ in kinds:
            yield Segment(at, stop, rank, features)


def number_runs(text: str, judge: Judge, known: dict) -> Iterator[tuple[int, int, list[tuple[int, tuple[int, ...], Any]]]]:
    """(start, stop, kinds) of the same runs, where judge has something to say on one kind at least: kinds has (rank, features, judge's word).

    What a run looks like is kept up to date group by group, from its last group backwards, and runs that look the same share their kinds through known, so
    a long table of numbers costs a few steps for each group that a number can have.
    """
    chain: list[tuple[int, int, str]] = []  # start, stop, what stands before it in the number
    lefts: dict[int, tuple[int, ...]] = {}
    ahead = GROUP.search(text)
    while ahead:
        start, stop = ahead.span()
        ahead = GROUP.search(text, stop)
        between = text[chain[-1][1] : start] if chain else ""
        if not (chain and len(between) <= 3 and BETWEEN.issuperset(between)):
            chain, lefts = [], {}
        chain.append((start, stop, between))
        if stop - start > MOST_DIGITS:
            chain, lefts = [], {}
            continue
        right: tuple[int, ...] | None = None
        n = groups = fours = widest = check = 0
        alike, slash, open_, point = True, False, 0, True
        last, sep, behind = stop - start, "", ""
        second = third = 0  # sizes of the groups behind the first
        for first in range(len(chain) - 1, -1, -1):
            begin, end, before = chain[first]
            size = end - begin
            if n + size > MOST_DIGITS:
                break
            if groups:  # behind stands between this group and the one after it
                if groups == 1:
                    sep = behind
                elif behind != sep:
                    alike = False
                if behind != ".":
                    point = False
                    if behind != " ":
                        slash = slash or "/" in behind
                        open_ += behind.count("(") - behind.count(")")
            for c in text[end - 1 : begin - 1 if begin else None : -1]:
                d = ord(c) - 48
                check += d if n % 2 == 0 else DOUBLED[d]
                n += 1
            groups += 1
            fours += size == 4
            if size > widest:
                widest = size
            if n >= 7 or (groups == 4 and n >= 4):
                if right is None:
                    linked = ahead and ahead.start() - stop <= 3 and BETWEEN.issuperset(text[stop : ahead.start()])
                    right = (*_right(text, stop), CHAIN_RIGHT) if linked else _right(text, stop)
                left = lefts.get(begin)
                if left is None:
                    left = lefts[begin] = (*_left(text, begin), CHAIN_LEFT) if first else _left(text, begin)
                quad = groups == 4 and widest <= 3 and point
                if n >= 7 or quad:
                    dated = slash or (groups > 2 and (size, second, third) in DATES)
                    in_fours = groups > 2 and last <= 4 and size == 4 and fours >= groups - 1
                    key = (
                        n, groups if groups < 4 else 4, alike and sep == ".", alike, open_ != 0, dated, quad and all([_byte(text[x:y]) for x, y, _ in chain[first:]]), quad,
                        n >= 12 and check % 10 == 0, in_fours, groups == 3 and (size, second, third) == (3, 3, 4), left, right,
                    )
                    kinds = known.get(key)
                    if kinds is None:
                        if len(known) > KNOWN:
                            known.clear()
                        kinds = known[key] = [(s.rank, s.features, word) for s in _numbers(text, begin, stop, n, chain[first:], left + right) if (word := judge(s.rank, s.features)) is not None]
                    if kinds:
                        yield begin, stop, kinds
                if begin and text[begin - 1] in "+(":
                    for at in _begins(text, begin):
                        if at < begin:
                            if at not in lefts:
                                lefts[at] = (*_left(text, at), CHAIN_LEFT) if first else _left(text, at)
                            kinds = [(s.rank, s.features, word) for s in _numbers(text, at, stop, n, chain[first:], lefts[at] + right) if (word := judge(s.rank, s.features)) is not None]
                            if kinds:
                                yield at, stop, kinds
            second, third, behind = size, second, before
        # groups further back than the digits of a number can't start one any more; one more shows that the number goes on
        if len(chain) > 2 * MOST_DIGITS:
            chain = chain[-MOST_DIGITS - 1 :]
            lefts = {}


def _begins(text: str, begin: int) -> Iterator[int]:
    yield begin
    while begin and text[begin - 1] in "+(":
        begin -= 1
        yield begin
        if text[begin] == "+":
            break


def _numbers(text: str, at: int, stop: int, n: int, groups: list, around: tuple[int, ...]) -> Iterator[Segment]:
    """The kinds that a run of groups can be."""
    begin = groups[0][0]
    between = [g[2] for g in groups[1:]]
    sizes = [g[1] - g[0] for g in groups]
    own = [ANY]
    if not between:
        own.append(AT["one_run"])
    elif between.count(between[0]) == len(between):
        own.append(AT["even"])
        if between[0] == ".":
            own.append(AT["dots"])
    plus = at < begin and "+" in text[at:begin]
    if plus:
        own.append(AT["plus"])
    body = text[at:stop]
    if body.count("(") != body.count(")"):
        own.append(AT["odd_bracket"])
    if n < 9:
        own.append(AT["few"])
    elif n > 15:
        own.append(AT["many"])
    if tuple(sizes[:3]) in DATES or "/" in body:
        own.append(AT["calendar"])
    shared = (*own, *around)
    if len(groups) == 4 and at == begin and max(sizes) <= 3 and between == [".", ".", "."]:
        fine = all(_byte(text[a:b]) for a, b, _ in groups)
        yield Segment(at, stop, 1, (AT["quad" if fine else "quad_over"], *shared))
    if n >= 12 and at == begin:
        own = []
        if luhn("".join([text[a:b] for a, b, _ in groups])):
            own.append(AT["luhn"])
        if len(groups) > 2 and sizes[-1] <= 4 and sizes.count(4) >= len(sizes) - 1 and sizes[0] == 4:
            own.append(AT["fours"])
        if n in (15, 16):
            own.append(AT["card_length"])
        yield Segment(at, stop, 2, (*own, *shared))
    if 7 <= n <= 15:
        own = []
        if plus and n >= 9:
            own.append(AT["abroad"])
        if sizes == [3, 3, 4]:
            own.append(AT["national"])
        if at < begin and "(" in text[at:begin] and between and ")" in between[0]:
            own.append(AT["brackets"])
        yield Segment(at, stop, 3, (*own, *shared))


def segments(text: str) -> Iterator[Segment]:
    yield from address_segments(text)
    yield from number_segments(text)


# --- the field

class Field(NamedTuple):
    weights: np.ndarray  # features x kinds
    pairs: np.ndarray  # kind before x kind behind, of entities near each other


def best_segments(found: list[Segment], scores: Iterable[float], pairs: np.ndarray) -> list[int]:
    """The best labelling: numbers of its segments, in order.

    Of every end position and kind only the best labelling that ends so is kept; a segment follows
    the best of all that ended more than NEAR characters before it, or one of those that ended nearer, with the score of the pair.
    """
    scores, links = list(map(float, scores)), pairs.tolist()
    by_end: dict[int, dict[int, tuple[float, int]]] = {}  # end -> kind -> (value, segment)
    before: list[int | None] = [None] * len(found)
    ends: list[int] = []  # in order, with the best value up to each
    tops: list[tuple[float, int | None]] = []
    starts = sorted(range(len(found)), key=lambda k: (found[k].stop, found[k].start))
    for k in starts:
        start, stop, rank = found[k].start, found[k].stop, found[k].rank
        far = bisect.bisect_left(ends, start - NEAR)
        value, after = tops[far - 1] if far else (0.0, None)
        for end in ends[far : bisect.bisect_right(ends, start, lo=far)]:
            for kind, (v, j) in by_end[end].items():
                if v + links[kind][rank] > value:
                    value, after = v + links[kind][rank], j
        value += scores[k]
        before[k] = after
        if not ends or ends[-1] != stop:
            ends.append(stop)
            tops.append(tops[-1] if tops else (0.0, None))
            by_end[stop] = {}
        if rank not in by_end[stop] or value > by_end[stop][rank][0]:
            by_end[stop][rank] = (value, k)
        if value > tops[-1][0]:
            tops[-1] = (value, k)
    out = []
    k = tops[-1][1] if tops else None
    while k is not None:
        out.append(k)
        k = before[k]
    return out[::-1]


def _log_sum(values: list[float]) -> float:
    top = max(values)
    return top + math.log(sum(math.exp(v - top) for v in values)) if top > -math.inf else top


def expected(found: list[Segment], scores: Iterable[float], pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """Probability of each segment, expected number of each near pair of kinds, log of the sum over all labellings."""
    scores, links = list(map(float, scores)), pairs.tolist()
    kinds = len(links)
    ended, begun = defaultdict(list), defaultdict(list)
    for k, s in enumerate(found):
        ended[s.stop].append(k)
        begun[s.start].append(k)
    stops, starts = sorted(ended), sorted(begun)
    # ahead[k]: of all labellings that end with segment k, without its own score; so far: of all that ended by then
    ahead, sums = [0.0] * len(found), [0.0]
    last: dict[int, list[float]] = {}  # end -> by kind
    for stop in stops:
        by_kind: list[list[float]] = [[] for _ in range(kinds)]
        for k in ended[stop]:
            start, rank = found[k].start, found[k].rank
            far = bisect.bisect_left(stops, start - NEAR)
            ways = [sums[far]]
            for end in stops[far : bisect.bisect_right(stops, start, lo=far)]:
                ways += [v + links[kind][rank] for kind, v in enumerate(last[end])]
            ahead[k] = _log_sum(ways)
            by_kind[rank].append(ahead[k] + scores[k])
        last[stop] = [_log_sum(v) if v else -math.inf for v in by_kind]
        sums.append(_log_sum([sums[-1], *last[stop]]))
    total = sums[-1]
    # the same from the other end
    behind, later = [0.0] * len(found), [0.0]  # later[i]: of all labellings of what begins at the last i starts
    first: dict[int, list[float]] = {}
    mass = np.zeros((kinds, kinds))
    for start in reversed(starts):
        by_kind = [[] for _ in range(kinds)]
        for k in begun[start]:
            stop, rank = found[k].stop, found[k].rank
            near = bisect.bisect_left(starts, stop)
            far = bisect.bisect_right(starts, stop + NEAR)
            ways = [later[len(starts) - far]]
            for s in starts[near:far]:
                for kind, v in enumerate(first[s]):
                    ways.append(v + links[rank][kind])
                    if v > -math.inf:
                        mass[rank, kind] += math.exp(ahead[k] + scores[k] + links[rank][kind] + v - total)
            behind[k] = _log_sum(ways)
            by_kind[rank].append(scores[k] + behind[k])
        first[start] = [_log_sum(v) if v else -math.inf for v in by_kind]
        later.append(_log_sum([later[-1], *first[start]]))
    chance = np.exp(np.array([a + s + b - total for a, s, b in zip(ahead, scores, behind)])) if found else np.zeros(0)
    return chance, mass, total


def written_lines(n: int, seed: int = 5) -> Iterator[tuple[str, list[Span]]]:
    """Labelled lines: invented words and cue words around entities in many forms and around numbers that are none."""
    rng = random.Random(seed)
    pick = rng.choice

    def digits(k: int, first: str = "0123456789") -> str:
        return pick(first) + "".join(pick("0123456789") for _ in range(k - 1))

    def word() -> str:
        return "".join(pick(("an", "th", "er", "que", "ung", "os", "re", "lich", "do", "mi")) for _ in range(rng.randint(1, 4)))

    def card(length: int = 16) -> str:
        body = digits(length - 1, "3456")
        return next(body + c for c in "0123456789" if luhn(body + c))

    def spaced(s: str, sep: str) -> str:
        return sep.join(s[i : i + 4] for i in range(0, len(s), 4))

    def host(point: str = ".") -> str:
        return point.join([word() + pick(("", digits(1))), *[word() for _ in range(pick((0, 0, 1, 2, 4)))], pick(("com", "org", "net", "co", "info"))])

    def plain() -> str:
        return next(x for x in iter(lambda: digits(rng.randint(12, 19)), "") if not luhn(x))

    makers = [
        (0, lambda: word() + pick((".", "_", "")) + pick(("", digits(2))) + "@" + host()),
        (0, lambda: word() + pick((" [at] ", "[at]", " (at) ", "(at)", "{at}")) + host(pick((".", ".", " [dot] ", "(dot)")))),
        (0, lambda: word() + " at " + host(" dot ")),
        (1, lambda: ".".join(str(rng.randint(0, 255)) for _ in range(4))),
        (2, lambda: card(pick((15, 16, 16)))),
        (2, lambda: spaced(card(), pick((" ", "-", ".", "  ")))),
        (3, lambda: f"+{digits(1, '123456789')} ({digits(3)}) {digits(3)}-{digits(4)}"),
        (3, lambda: f"+{digits(2, '123456789')}{pick((' ', '-'))}{digits(3)} {digits(rng.randint(4, 6))}"),
        (3, lambda: pick((f"({digits(3)}) {digits(3)}-{digits(4)}", f"{digits(3)}-{digits(3)}-{digits(4)}", f"{digits(3)}.{digits(3)}.{digits(4)}", f"{digits(3)} {digits(3)} {digits(4)}"))),
        (None, lambda: digits(rng.randint(4, 11))),
        (None, plain),
        (None, lambda: spaced(next(x for x in iter(lambda: digits(16), "") if not luhn(x)), pick((" ", "-")))),
        (None, lambda: pick((f"20{digits(2)}-{digits(2, '01')}-{digits(2, '012')}", f"{digits(2)}/{digits(2)}/20{digits(2)} {digits(2)}:{digits(2)}", f"{digits(2)}.{digits(2)}.{digits(4, '12')}"))),
        (None, lambda: f"{digits(1)},{digits(3)}.{digits(2)}"),
        (None, lambda: ".".join(digits(k) for k in (1, 2, rng.randint(4, 6)))),
        (None, lambda: ".".join(str(rng.randint(256, 999)) for _ in range(4))),
        (None, lambda: "".join(pick("0123456789abcdef") for _ in range(rng.randint(16, 40)))),
        (None, lambda: f"{word()}@{word()} {digits(4)}"),
        (None, lambda: digits(rng.randint(20, 30))),
        (None, lambda: f"{digits(2)}:{digits(2)} {digits(4)} {digits(4)} {digits(4)}"),
        (None, lambda: " ".join(digits(rng.randint(1, 5)) for _ in range(rng.randint(3, 9)))),
        (None, lambda: f"978-{digits(1)}-{digits(rng.randint(2, 4))}-{digits(5)}-{digits(1)}"),
    ]
    cues = {0: ("mail", "email", "contact"), 1: ("ip", "host", "server"), 2: ("card", "visa", "credit card"), 3: ("tel", "call", "phone", "fax")}
    for i in range(n):
        line, spans = "", []
        kind, make = makers[i % len(makers)]
        for nth in range(rng.randint(1, 3)):
            if nth:
                line += pick((" ", " ", ". ", ", ", "\n", ") ")) if not line[-1].isspace() else ""
                near = rng.random() < 0.4
                # entities stand in lists of contacts: mostly a phone number behind an address or behind a phone number
                kind, make = pick([m for m in makers if m[0] in (0, 3)]) if near and kind in (0, 3) else pick(makers)
                line = line.rstrip(" .,)") + pick((", ", "; ", " / ", " or ", "\n")) if near else line +  "".join(word() + pick((" ", " ", ", ", ". ", "\n")) for _ in range(rng.randint(2, 4)))
            else:
                line += "".join(word() + pick((" ", " ", ", ", ". ", "\n")) for _ in range(rng.randint(0, 4)))
            if rng.random() < 0.3:
                line += pick(cues.get(kind, ("order", "no", "ref", "version", "id", "isbn"))) + pick((": ", " ", " "))
            body = make()
            if kind is not None:
                spans.append(Span(len(line), kind, len(line) + len(body)))
            line += body
        yield line + pick((" ", ". ", ", ", "\n", ") ")) + word(), spans


@lru_cache(maxsize=1)
def fitted() -> Field:
    """The field of greatest penalised likelihood on the written lines."""
    lines = []
    for line, spans in written_lines(FIT_LINES):
        found = list(segments(line))
        want = {(s.start, s.stop, s.rank) for s in spans}
        truth = np.array([float((c.start, c.stop, c.rank) in want) for c in found])
        if not found or truth.sum() != len(want):
            continue  # an entity that stands in no candidate can't be learned
        seen = np.zeros((len(KINDS), len(KINDS)))
        for a, b in zip(spans, spans[1:]):
            seen[a.rank, b.rank] += b.start - a.stop <= NEAR
        x = np.zeros((len(found), WIDTH))
        for k, c in enumerate(found):
            x[k, list(c.features)] = 1
        lines.append((found, x, np.eye(len(KINDS))[[c.rank for c in found]], truth, seen))
    w, pairs = np.zeros((WIDTH, len(KINDS))), np.zeros((len(KINDS), len(KINDS)))
    w[0] = -2.0
    state = [np.zeros_like(w), np.zeros_like(w), np.zeros_like(pairs), np.zeros_like(pairs)]
    for t in range(1, FIT_ROUNDS + 1):
        slope, turn = -0.02 * w, -0.02 * pairs
        for found, x, kinds, truth, seen in lines:
            chance, mass, _ = expected(found, ((x @ w) * kinds).sum(axis=1), pairs)
            slope += x.T @ (kinds * (truth - chance)[:, None])
            turn += seen - mass
        for i, (value, by) in enumerate(((w, slope / len(lines)), (pairs, turn / len(lines)))):
            state[2 * i] = 0.8 * state[2 * i] + 0.2 * by
            state[2 * i + 1] = 0.95 * state[2 * i + 1] + 0.05 * by**2
            value += 0.4 * (state[2 * i] / (1 - 0.8**t)) / (np.sqrt(state[2 * i + 1] / (1 - 0.95**t)) + 1e-6)
    return Field(w, pairs)


def field_spans(text: str, field: Field) -> list[Span]:
    """Spans of the best labelling.

    A segment that scores less than any pairs could make up for is in no best labelling and is not kept.
    """
    least = -(2 * max(0.0, field.pairs.max()) - min(0.0, field.pairs.min()))
    weights = field.weights.T.tolist()
    kept: list[Segment] = []
    scores: list[float] = []

    def judged(rank: int, features: tuple[int, ...]) -> float | None:
        own = weights[rank]
        score = sum([own[i] for i in features])
        return score if score > least else None

    for s in address_segments(text):
        if (score := judged(s.rank, s.features)) is not None:
            kept.append(s)
            scores.append(score)
    for at, stop, kinds in number_runs(text, judged, _looks(field)):
        for rank, features, score in kinds:
            kept.append(Segment(at, stop, rank, features))
            scores.append(score)
    return sorted(Span(kept[k].start, kept[k].rank, kept[k].stop) for k in best_segments(kept, scores, field.pairs))


_LOOKS: dict[int, tuple[Field, dict]] = {}


def _looks(field: Field) -> dict:
    """What a process remembers of the runs that it has judged by this field."""
    if id(field) not in _LOOKS:
        _LOOKS.clear()
        _LOOKS[id(field)] = (field, {})  # the field is held, so its id stays its own
    return _LOOKS[id(field)][1]


def all_spans(text: str, field: Field) -> tuple[list[Span], list[Span]]:
    """Base spans, and those with the ones that the field adds where no base span is touched."""
    base = base_spans(text)
    added, at = [], 0
    taken: list[list[int]] = []
    for s in base:
        if taken and s.start <= taken[-1][1]:
            taken[-1][1] = max(taken[-1][1], s.stop)
        else:
            taken.append([s.start, s.stop])
    for s in field_spans(text, field):
        while at < len(taken) and taken[at][1] <= s.start:
            at += 1
        if at == len(taken) or taken[at][0] >= s.stop:
            added.append(s)
    return base, sorted(base + added)


SPANS = "array<struct<start:bigint,rank:int,kind:string,stop:bigint>>"


def _listed(spans: list[Span]) -> list[dict]:
    return [{"start": s.start, "rank": s.rank, "kind": KINDS[s.rank], "stop": s.stop} for s in spans]


def find_personal(df: DataFrame, text: str = "text") -> DataFrame:
    """Add base and personal, arrays of spans (start, rank, kind, stop), to every row.

    base holds the fixed formats, personal those and what the field adds; by start, then kind.
    Offsets are code points, ends exclusive. Null, empty and hintless texts have none and stay in the JVM.
    Repeated rows stay repeated; input columns named like an output are replaced.
    """
    field = fitted()
    span = pa.struct([("start", pa.int64()), ("rank", pa.int32()), ("kind", pa.string()), ("stop", pa.int64())])
    kind = pa.struct([("base", pa.list_(span)), ("personal", pa.list_(span))])

    @arrow_udf(f"struct<base:{SPANS},personal:{SPANS}>")
    def find(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            rows = []
            for x in batch.to_pylist():
                base, every = all_spans(x, field) if x else ([], [])
                rows.append({"base": _listed(base), "personal": _listed(every)})
            yield pa.array(rows, kind)

    body = text_or_empty(text)
    found = df.withColumn("_found", find(F.when(body.rlike(HINT), body)))
    return found.withColumns({"base": F.col("_found.base"), "personal": F.col("_found.personal")}).drop("_found")


def redact(df: DataFrame, text: str = "text") -> DataFrame:
    """Replace every span of personal data by its kind in brackets; overlapping spans fall under the first."""
    field = fitted()

    @arrow_udf("string")
    def masked(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield pa.array([mask(x, all_spans(x, field)[1]) if x else x for x in batch.to_pylist()], pa.string())

    body = F.col(text).cast("string")
    return df.withColumn(text, F.coalesce(masked(F.when(body.rlike(HINT), body)), body))


def mask(text: str, spans: Iterable[Span]) -> str:
    out, at = [], 0
    for s in spans:
        if s.start >= at:
            out += [text[at : s.start], f"[{KINDS[s.rank].upper()}]"]
            at = s.stop
        elif s.stop > at:
            at = s.stop
    return "".join([*out, text[at:]])


def joined(spans: Column) -> Column:
    """`kind:start:stop` of all spans, comma-joined."""
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))), ","
    )


def count_kind(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")
