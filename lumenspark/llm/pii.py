"""Personal data by base patterns and a semi-Markov conditional random field.

Base spans follow fixed patterns. Beyond them, the field looks where a text holds what could be personal data in
another guise: seven digits or more with little between them, an at sign, a spelled-out address, a run of colons. There
it scores whole segments, of SPAN tokens at most, by features of the span as a whole (its shape, its digits and their
check sum, what stands beside it), and dynamic programming picks the boundaries and kinds that are best together.
Outside such places no segment is a candidate, so the parts of a text are independent and texts are searched whole.
The weights are trained by conditional likelihood, here and from a fixed seed, on sentences made from templates; no
document takes part. Found segments that touch a base span, or an earlier found one, are dropped; base spans stay.
"""

from __future__ import annotations

import functools
import math
import random
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenspark.llm.common import bounded_batches, sliced

#: Fixed values of the contract: kinds in their order, and the patterns.
KINDS = ("email", "ip", "card", "phone")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
#: Tokens of a segment at most; tokens to each side of a place; how far a path must be above none to be believed.
SPAN = 44
AROUND = 6
MARGIN = 1.0
#: Training: sentences of each sort, rounds, step, weight of the squares.
SENTENCES, ROUNDS, STEP, RIDGE = 60, 10, 0.3, 1e-3


def luhn(digits: str) -> bool:
    double = (0, 2, 4, 6, 8, 1, 3, 5, 7, 9)
    return (sum(map(int, digits[-1::-2])) + sum(double[int(d)] for d in digits[-2::-2])) % 10 == 0


def byte_sized(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) < 3 or (len(part) == 3 and part <= "255")


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end), by kind as listed, then start; leftmost without overlap in each kind, in linear time."""
    found = []
    if "@" in text:
        edge = 0
        for m in DOMAIN.finditer(text):
            start = m.start()
            while start > edge and text[start - 1] in LOCAL:
                start -= 1
            if start < m.start():
                edge = m.end()
                found.append((0, start, edge))
    for m in IP.finditer(text):
        if all(map(byte_sized, m[0].split("."))):
            found.append((1, m.start(), m.end()))
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 13:
            digits = m[0].replace(" ", "").replace("-", "")
            if 13 <= len(digits) <= 19 and luhn(digits):
                found.append((2, m.start(), m.end()))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 9 <= sum(c in "0123456789" for c in m[0]) <= 15:
                found.append((3, m.start(), m.end()))
    return found


#: Places around which segments are looked for.
PLACES = re.compile(r"[0-9](?:[ ().:/_-]{0,3}[0-9]){6}|@|(?<![A-Za-z0-9])[0-9A-Fa-f]{1,4}:[0-9A-Fa-f:]{2,}|(?<=[A-Za-z0-9] )(?:at|AT)(?= [A-Za-z0-9.-]+ (?:dot|DOT) [A-Za-z])|[\[({]\s?(?:at|AT)\s?[\])}]")
TOKEN = re.compile(r"[^\W\d_]+|[0-9]+|\s+|.", re.DOTALL)
MARKS = frozenset("+-().:/_@[]{} %")
#: Words before a span that say what it is.
CUES = {"call": "phone", "phone": "phone", "tel": "phone", "fax": "phone", "mobile": "phone", "cell": "phone", "mail": "email", "email": "email", "write": "email", "card": "card", "visa": "card", "pay": "card", "ip": "ip", "host": "ip", "server": "ip", "address": "ip"}
NOT_CUES = frozenset("isbn order id no number date version code invoice ref account page total serial tracking build".split())


@dataclass(frozen=True)
class Part:
    """A stretch of tokens and its candidate segments: first and last token, and features."""

    tokens: list[tuple[int, int, str]]
    segments: list[tuple[int, int]]
    features: list[list[str]]


def part_of(text: str, first: int, last: int) -> Part:
    """The part from ``first`` to ``last``, with the segments that could be personal data."""
    tokens = [(m.start() + first, m.end() + first, m[0]) for m in TOKEN.finditer(text[first:last])]
    segments, features = [], []
    for i, (_, _, word) in enumerate(tokens):
        if word.isspace() or not (word in "+([" or word[0].isalnum() or word == ":"):
            continue
        for j in range(i, min(len(tokens), i + SPAN)):
            mark = tokens[j][2]
            if len(mark) > 64 or (not mark[0].isalnum() and mark not in MARKS and not mark == "  "):
                break
            if mark.isspace() or not (mark[0].isalnum() or mark == ")"):
                continue
            if own := span_features(text, tokens, i, j):
                segments.append((i, j))
                features.append(own)
    return Part(tokens, segments, features)


def span_features(text: str, tokens: list[tuple[int, int, str]], i: int, j: int) -> list[str] | None:
    """Features of the whole span, None if it can't be personal data."""
    words = [t[2] for t in tokens[i : j + 1]]
    body = text[tokens[i][0] : tokens[j][1]]
    groups = [w for w in words if w.isdigit() and w.isascii()]
    digits = "".join(groups)
    letters = [w.lower() for w in words if w[0].isalpha()]
    spelled = "at" in letters[1:-1]
    before = text[tokens[i][0] - 1 : tokens[i][0]]
    after = text[tokens[j][1] : tokens[j][1] + 1]
    left = next((t[2].lower() for t in reversed(tokens[max(0, i - 4) : i]) if t[2][0].isalpha()), "")
    out = ["any", f"cue={CUES.get(left, 'not' if left in NOT_CUES else '-')}"]
    out.append("before=" + ("A" if before.isalnum() else "E" if before and before in "-./:@_#=+&%$" else "-"))
    out.append("after=" + ("A" if after.isalnum() else "E" if after and after in "-/:@_=&%$" else "-"))
    if after == "." and text[tokens[j][1] + 1 : tokens[j][1] + 2].isalnum():
        out.append("goes on")
    if "@" in words or spelled:
        local, _, domain = body.replace("@", " at ").lower().partition(" at ") if "@" in words else re.sub(r"\s*[\[({]?\s?\bat\b\s?[\])}]?\s*", " at ", body.lower(), count=1).partition(" at ")
        labels = [x for x in re.split(r"\s*[\[({]?\s?\bdot\b\s?[\])}]?\s*|\.", domain.strip()) if x]
        plain = bool(re.fullmatch(r"[a-z0-9._%+-]+", local.strip())) and bool(labels) and all(re.fullmatch(r"[a-z0-9-]+", x) for x in labels)
        out += ["address", f"address plain={plain}", f"labels={min(len(labels), 4)}", f"top={'a' if labels and labels[-1].isalpha() and 2 <= len(labels[-1]) <= 6 else 'x'}", f"spelled={spelled}", f"dot={'dot' in letters}", f"dots={'.' in domain}", f"spaces={min(3, sum(w.isspace() for w in words))}"]
        return out
    if ":" in words and re.fullmatch(r"[0-9A-Fa-f:]+", body):
        parts = body.split(":")
        out += ["colons", f"parts={min(len(parts), 9)}", f"short={body.count('::')}", f"fits={all(len(x) <= 4 for x in parts)}", f"hexes={any(c.isalpha() for c in body)}", f"wide={sum(len(x) > 2 for x in parts) > 1}"]
        return out
    if letters or not 7 <= len(digits) <= 24:
        return None
    marks = "".join(sorted({w if not w.isspace() else " " for w in words if not w.isdigit()}))
    sizes = [min(len(g), 6) for g in groups]
    out += ["digits", f"n={min(len(digits), 20)}", f"marks={marks}", f"groups={min(len(groups), 6)}", f"last={sizes[-1]}", "sizes=" + "-".join(map(str, sizes[:6])), f"plus={words[0] == '+'}", f"paren={words[0] == '('}"]
    if 13 <= len(digits) <= 19:
        out.append(f"check={luhn(digits)}")
        out.append(f"check={luhn(digits)} fours={sizes[:3] == [4, 4, 4]}")
    if len(groups) == 4 and set(marks) <= {".", " "} and all(map(byte_sized, groups)):
        out.append("bytes")
    if len(groups[0]) == 4 and groups[0][:2] in ("19", "20") and len(groups) > 1 and len(groups[1]) == 2:
        out.append("date")
    if len(groups) > 2 and len(groups[0]) <= 2 and len(groups[1]) <= 2 and len(groups[2]) == 4:
        out.append("date")
    out.append("sizes=" + "-".join(map(str, sizes[-3:])) + f" marks={marks}")
    return out


def _added(*values: float) -> float:
    top = max(values)
    return top + math.log(sum(math.exp(v - top) for v in values)) if top > -math.inf else top


@dataclass(frozen=True)
class Field:
    """Weights of features by kind."""

    names: dict[str, int]
    weights: np.ndarray

    def scores(self, part: Part) -> np.ndarray:
        out = np.zeros((len(part.segments), len(KINDS)))
        for s, own in enumerate(part.features):
            out[s] = self.weights[[self.names[f] for f in own if f in self.names]].sum(axis=0)
        return out

    def best(self, part: Part) -> list[tuple[int, int, int]]:
        """(kind, start, end) of the segments on the best path; each must be MARGIN better than none."""
        if not part.segments:
            return []
        scores = self.scores(part)
        kind, gain = scores.argmax(axis=1), scores.max(axis=1) - MARGIN
        best, step = [0.0] * (len(part.tokens) + 1), [-1] * (len(part.tokens) + 1)
        by_end: dict[int, list[int]] = {}
        for s, (_, j) in enumerate(part.segments):
            by_end.setdefault(j, []).append(s)
        for t in range(1, len(part.tokens) + 1):
            best[t] = best[t - 1]
            for s in by_end.get(t - 1, ()):
                if (value := best[part.segments[s][0]] + gain[s]) > best[t]:
                    best[t], step[t] = value, s
        out, t = [], len(part.tokens)
        while t > 0:
            if step[t] < 0:
                t -= 1
                continue
            i, j = part.segments[step[t]]
            out.append((int(kind[step[t]]), part.tokens[i][0], part.tokens[j][1]))
            t = i
        return out[::-1]

    def marginals(self, part: Part, scores: np.ndarray) -> np.ndarray:
        """The probability of each segment and kind, over all segmentations of the part."""
        n = len(part.tokens)
        both = [_added(*row) for row in scores.tolist()]
        ahead, behind = [0.0] * (n + 1), [0.0] * (n + 1)
        ends: dict[int, list[int]] = {}
        begins: dict[int, list[int]] = {}
        for s, (i, j) in enumerate(part.segments):
            ends.setdefault(j + 1, []).append(s)
            begins.setdefault(i, []).append(s)
        for t in range(1, n + 1):
            ahead[t] = _added(ahead[t - 1], *(ahead[part.segments[s][0]] + both[s] for s in ends.get(t, ())))
        for t in range(n - 1, -1, -1):
            behind[t] = _added(behind[t + 1], *(behind[part.segments[s][1] + 1] + both[s] for s in begins.get(t, ())))
        edge = np.array([ahead[i] + behind[j + 1] - ahead[n] for i, j in part.segments])
        return np.exp(scores + edge[:, None])


def places_of(text: str) -> list[tuple[int, int]]:
    return [m.span() for m in PLACES.finditer(text)]


def parts_of(text: str, places: list[tuple[int, int]]) -> Iterator[Part]:
    """Parts around places, joined where they meet."""
    reach = 60
    at = 0
    while at < len(places):
        first, last, upto = max(0, places[at][0] - reach), places[at][1] + reach, at + 1
        while upto < len(places) and places[upto][0] - reach <= last:
            last = places[upto][1] + reach
            upto += 1
        while first > 0 and first > places[at][0] - 2 * reach and text[first - 1].isalnum():
            first -= 1
        while last < len(text) and last < places[upto - 1][1] + 2 * reach and text[last].isalnum():
            last += 1
        yield part_of(text, first, min(last, len(text)))
        at = upto


def spans(text: str, field: Field) -> list[tuple[int, int, int]]:
    """Base spans and those that the field adds, by kind, then start."""
    found = base_spans(text)
    taken = sorted((a, b) for _, a, b in found)
    free, at = [], 0
    for a, b in places_of(text):  # one inside a base span gives nothing new
        while at < len(taken) and taken[at][1] < b:
            at += 1
        if at == len(taken) or taken[at][0] > a:
            free.append((a, b))
    if free:
        more = []
        for part in parts_of(text, free):
            more += [s for s in field.best(part) if not any(a < s[2] and s[1] < b for a, b in taken)]
        edge = 0
        for s in sorted(more, key=lambda s: s[1]):
            if s[1] >= edge:
                found.append(s)
                edge = s[2]
    return sorted(found)


def written(found: Iterable[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in found)


def _sentences(rng: random.Random) -> Iterator[tuple[str, list[tuple[int, int, int]]]]:
    """Sentences from templates with the spans that they hold."""

    def n(size: int, first: str = "123456789") -> str:
        return rng.choice(first) + "".join(rng.choice("0123456789") for _ in range(size - 1))

    def word() -> str:
        return "".join(rng.choice("abcdefghijklmnoprstuvwy") for _ in range(rng.randint(2, 9)))

    def card() -> str:
        body = rng.choice("3456") + "".join(rng.choice("0123456789") for _ in range(14))
        return body + next(d for d in "0123456789" if luhn(body + d))

    def fours(x: str, mark: str) -> str:
        return mark.join(x[i : i + 4] for i in range(0, 16, 4))

    def bad_card() -> str:
        x = card()
        return x[:-1] + str((int(x[-1]) + rng.randint(1, 9)) % 10)

    def address() -> tuple[str, str]:
        return rng.choice([word(), f"{word()}.{word()}", word() + n(2)]), rng.choice([word(), f"{word()}-{word()}"])

    def email() -> str:
        who, host = address()
        top = rng.choice(["com", "org", "net", "io", "edu", "fr"])
        return rng.choice([f"{who} at {host} dot {top}", f"{who} [at] {host} [dot] {top}", f"{who}(at){host}.{top}", f"{who} @ {host}.{top}", f"{who}[at]{host}.{top}", f"{who} (at) {host} (dot) {top}", f"{who} AT {host} DOT {top}", f"{who} at {host} dot co dot uk", f"{who}@{host}.{top}"])

    def phone() -> str:
        a, b, c = n(3, "23456789"), n(3, "23456789"), n(4)
        return rng.choice([f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"1-{a}-{b}-{c}", f"({a}) {b} {c}", f"1 ({a}) {b}-{c}", f"({a}){b}-{c}", f"{a} {b} {c}", f"00{n(2)} {n(2)} {b} {c}", f"1.{a}.{b}.{c}", f"+1 ({a}) {b}-{c}", f"+{n(2)} {n(1)} {b} {c}", f"+1-{a}-{b}-{c}"])

    def ip() -> str:
        h = lambda: f"{rng.randrange(1 << 16):x}"
        return rng.choice([":".join(f"{rng.randrange(1 << 16):04x}" for _ in range(8)), f"2001:db8:{h()}:{h()}::{h()}", f"fe80::{h()}:{h()}:{h()}:{h()}", ":".join(h() for _ in range(8)), *[".".join(str(rng.randrange(256)) for _ in range(4)) for _ in range(2)]])

    def other_card() -> str:
        return rng.choice([card(), fours(card(), rng.choice([".", "_", "/", ": ", " - ", " ", "-"]))])

    def nothing() -> str:
        y, m, d = f"{rng.choice(['19', '20'])}{n(2, '0123456789')}", f"{rng.randint(1, 12):02}", f"{rng.randint(1, 28):02}"
        clock = f"{rng.randrange(24):02}:{rng.randrange(60):02}:{rng.randrange(60):02}"
        return rng.choice([
            f"{y}-{m}-{d} {clock}", f"{d}/{m}/{y} {clock}", f"{y}{m}{d}", f"{y}-{m}-{d}T{clock}", f"978-{n(1)}-{n(2)}-{n(6)}-{n(1)}", n(rng.randint(7, 12)), n(rng.randint(17, 24)), bad_card(), fours(bad_card(), rng.choice([" ", "-", "."])),
            f"{n(3)}-{n(3)}-{n(3)}-{n(3)}", f"{n(4)} {n(4)} {n(4)}", f"{n(1)}.{n(2)}.{n(3)}.{n(4)}", f"{n(2)}.{n(7)}", f"{n(3)}.{n(6)}", f"{y}-{n(4)}-{n(5)}", f"{y} {m} {d} {n(4)}", f"{n(3)}.{n(3)}.{n(3)}", f"{word()}{n(8)}", f"0x{n(9)}", f"@{word()}", f"{word()} @ {word()}", f"{n(2)} @ {n(3)}", clock + f":{n(2)}", f"{n(1)}:{n(2)}:{n(2)}:{n(2)}", f"{m}:{d}:{y}", f"{n(5)}-{n(4)}", f"{n(2)}-{n(7)}", f"#{n(8)}", f"{n(6)}/{n(6)}", f"{y}/{m}/{d}/{n(4)}", "ab:cd:ef:01:23:45", f"{word()} at {word()} dot", f"{n(3)} {n(3)} {n(3)} {n(3)}",
        ])

    cues = {"phone": ["call", "phone", "tel", "mobile"], "email": ["mail", "write", "email"], "card": ["card", "visa", "pay"], "ip": ["ip", "host", "server"]}
    makers = {"phone": phone, "email": email, "card": other_card, "ip": ip}
    for _ in range(SENTENCES):
        for kind, make in makers.items():
            for _ in range(2 if kind in ("phone", "email") else 1):
                cue = rng.choice([*cues[kind], word(), word(), ""])
                head = f"{word()} {word()} {cue}{rng.choice([' ', ': ', ' '])}"
                body = make()
                yield f"{head}{body}{rng.choice(['', '.', ',', ' ', ' ' + word(), '. ' + word(), ')'])}", [(KINDS.index(kind), len(head), len(head) + len(body))]
        for _ in range(3):  # neighbours, whose base patterns may run into each other
            one, two = rng.choice(KINDS), rng.choice(KINDS)
            head, body, next_ = f"{word()} {word()} ", makers[one](), makers[two]()
            at = len(head) + len(body) + 1
            yield f"{head}{body} {next_} {word()}", [(KINDS.index(one), len(head), at - 1), (KINDS.index(two), at, at + len(next_))]
        for _ in range(6):
            yield f"{word()} {rng.choice([word(), word(), *sorted(NOT_CUES)])} {nothing()}{rng.choice(['', '.', ' ' + word()])}", []


@functools.cache
def trained(seed: int = 5) -> Field:
    """The field, by steps along the gradient of the conditional likelihood, each feature's step shrinking as it adds up."""
    rng = random.Random(seed)
    names: dict[str, int] = {}
    examples = []
    for text, gold in _sentences(rng):
        part = part_of(text, 0, len(text))
        ids = [[names.setdefault(f, len(names)) for f in own] for own in part.features]
        right = {(a, b): k for k, a, b in gold}
        target = np.zeros((len(part.segments), len(KINDS)))
        for s, (i, j) in enumerate(part.segments):
            if (k := right.get((part.tokens[i][0], part.tokens[j][1]))) is not None:
                target[s, k] = 1
        if part.segments:
            rows = np.repeat(np.arange(len(ids)), [len(x) for x in ids])
            examples.append((part, rows, np.array([f for x in ids for f in x]), target))
    weights = np.zeros((len(names), len(KINDS)))
    seen = np.full_like(weights, 1e-8)
    field = Field(names, weights)
    for _ in range(ROUNDS):
        rng.shuffle(examples)
        for part, rows, flat, target in examples:
            scores = np.zeros(target.shape)
            np.add.at(scores, rows, weights[flat])
            change = target - field.marginals(part, scores)
            used, place = np.unique(flat, return_inverse=True)
            slope = np.zeros((len(used), len(KINDS)))
            np.add.at(slope, place, change[rows])
            slope -= RIDGE * weights[used]
            seen[used] += slope * slope
            weights[used] += STEP * slope / np.sqrt(seen[used])
    return field


def find(docs: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    """The columns ``keep``, and ``base`` and ``spans``: arrays of (kind, start, end), in code points, end exclusive.

    A null text is empty. Rows are independent: repeated rows have equal spans, no rows give none. Each text is
    searched whole, in one pass, where it is read; the field's weights are a few thousand numbers.
    """
    bounded_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(trained())
    now = docs.select(*keep, F.col(text).alias("_text"))
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        field = sent.value

        def rows(found: list[tuple[int, int, int]]) -> list[dict]:
            return [{"kind": KINDS[k], "start": a, "end": b} for k, a, b in found]

        for batch in batches:
            for part in sliced(batch):
                texts = [t or "" for t in part.column(len(keep)).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns[: len(keep)], pa.array([rows(base_spans(t)) for t in texts], kind), pa.array([rows(spans(t, field)) for t in texts], kind)], names=[*keep, "base", "spans"])

    schema = "".join(f"`{c}` {now.schema[c].dataType.simpleString()}, " for c in keep)
    one = "array<struct<kind:string,start:bigint,end:bigint>>"
    return now.mapInArrow(run, f"{schema}base {one}, spans {one}")


def as_text(column: str):
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(column, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")
