"""Personal data by base patterns and a semi-Markov conditional random field.

The base patterns find e-mail addresses, IP addresses, card and phone numbers; each is scanned in linear time. The
random field adds what they miss: spelled-out addresses, national phone numbers, grouped card numbers, account
numbers. It scores whole candidate segments of at most MOST_TOKENS tokens by features of the span (digit groups,
check sums, separators, the words before), and a dynamic program over segment ends picks boundaries and kinds of a
region together. Only regions around trigger tokens (numbers, spelled-out dots, account codes) are decoded: an entity
must hold a trigger, so the rest of a text has a single reading. A region of any length is read in one pass that holds
a window of tokens. An added span never overlaps a base span.

The weights are trained here, by likelihood, on sentences that a seeded generator writes (TRAIN_SENTENCES of them).

Defined results: null or empty text has no spans; repeated rows give repeated results; an empty table gives no rows;
extra columns are ignored by find and kept by redact.
"""

from __future__ import annotations

import random
import re
from array import array
from bisect import bisect_left
from collections.abc import Iterator
from functools import lru_cache
from itertools import accumulate

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import trimmed

BASE = ("email", "ip", "card", "phone")
#: Kinds that the random field gives.
KINDS = (*BASE, "iban")
#: Bound of an entity, in tokens.
MOST_TOKENS = 14
#: Tokens that are looked at side by side when a text is read.
WINDOW = 1024
#: Bound of the training set, in sentences.
TRAIN_SENTENCES = 260

_domain = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_local = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_chain = re.compile(r"[0-9]+(?:\.[0-9]+)*")
_card = re.compile(r"[0-9](?:[\x20-]?[0-9])*")
_phone = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_not_digit = re.compile(r"[^0-9]+")
_digits = re.compile(r"[0-9]+")
_token = re.compile(r"[^\W_]+|[^\w\s]|_")
#: Texts without a match hold neither base nor added spans.
MAYBE = r"[0-9@]|(?i)[\s(\[{]dot[\s)\]}]"


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        v = int(d) * (1 + k % 2)
        total += v - 9 * (v > 9)
    return total % 10 == 0


def emails(text: str) -> Iterator[tuple[int, int]]:
    free, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _local:
            start -= 1
        if start < at and (m := _domain.match(text, at + 1)):
            yield start, m.end()
            free = m.end()
            at = text.find("@", free)
        else:
            free = at + 1  # no local part reaches back over it
            at = text.find("@", at + 1)


def addresses(text: str) -> Iterator[tuple[int, int]]:
    for m in _chain.finditer(text):
        parts = m.group().split(".")
        start = m.start()
        for k in range(0, len(parts) - 3, 4):
            end = start + sum(map(len, parts[k : k + 4])) + 3
            # without leading zeros: a number of thousands of digits is no int
            if all(len(p) <= 3 and int(p or "0") <= 255 for p in (x.lstrip("0") for x in parts[k : k + 4])):
                yield start, end
            start = end + 1


def cards(text: str) -> Iterator[tuple[int, int]]:
    for m in _card.finditer(text):
        if m.end() - m.start() >= 16:
            digits = _not_digit.sub("", m.group())
            if 16 <= len(digits) <= 19 and luhn(digits):
                yield m.span()


def phones(text: str) -> Iterator[tuple[int, int]]:
    for m in _phone.finditer(text):
        if 8 <= sum(c.isdigit() for c in m.group()) <= 15:
            yield m.span()


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) by kind as in BASE, then start."""
    found = [("email", *s) for s in emails(text)] if "@" in text else []
    for kind, find in (("ip", addresses), ("card", cards), ("phone", phones)):
        found += [(kind, *s) for s in find(text)]
    return found


# ---------------------------------------------------------------- the random field

_before = {
    "call": 0, "phone": 0, "tel": 0, "mobile": 0, "fax": 0, "telephone": 0, "dial": 0,
    "mail": 1, "email": 1, "contact": 1, "write": 1, "reach": 1,
    "card": 2, "visa": 2, "credit": 2, "mastercard": 2,
    "iban": 3, "account": 3,
    "ip": 4, "host": 4, "server": 4, "address": 4,
}
_endings = frozenset("com org net edu gov info io de fr es uk eu co us".split())
_iban = re.compile(r"[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}")
_codes = re.compile(r"[A-Z]{2}[0-9]{2}")
_plain = frozenset("- ().")
_groups = {"3-3-4": 0, "(3)3-4": 1, "3-4": 2, "4-4-4-4": 3, "4-6-5": 4, "2-2-2-2-2": 5, "3-3-3": 6, "4-2-2": 7, "4": 8, "4-4": 9}
FEATURES = 56
LABELS = 1 + len(KINDS)  # 0: outside


def _trigger(token: str) -> bool:
    if token.isdigit():
        return len(token) >= 2
    return token.lower() == "dot" or bool(_codes.match(token))


def _mod97(code: str) -> bool:
    turned = code[4:] + code[:4]
    return int("".join(str(int(c, 36)) for c in turned)) % 97 == 1


def _spelled(words: list[str], low: list[str]) -> list[int]:
    """Features of spelled-out signs in a segment with a dot among its words."""
    if "at" not in low or low.index("at") > low.index("dot"):
        return [35]
    at, dot = low.index("at"), len(low) - 1 - low[::-1].index("dot")
    inner = [k for k, x in enumerate(words) if x.isalnum() and low[k] not in ("at", "dot")]
    neat = low.count("at") == 1 and 0 < at and dot < len(low) - 1
    # words only between the spelled signs: one before at, one between, one after the last dot
    exact = neat and len([k for k in inner if k < at]) == 1 and len([k for k in inner if k > at]) == low.count("dot") + 1
    return [29 if exact else 30, 31 if low[-1] in _endings else 32, 33 if at > 0 and words[at - 1] in "([{" else 34]


def _segments(text: str, tokens: list[tuple[int, int]], words: list[str], trigger: list[bool], i: int) -> Iterator[tuple[int, list[int]]]:
    """(j, active features) of the candidate segments of tokens i to j (exclusive): with a trigger, and a word at the end."""
    near = [x.lower() for x in words[max(0, i - 3) : i]]
    fixed = [0, *sorted({38 + _before[x] for x in near if x in _before})]
    if words[i] in "(+":
        fixed.append(44 if words[i] == "(" else 45)
    if i and tokens[i - 1][1] == tokens[i][0]:
        fixed.append(47)  # glued to what is before
    if i and words[i - 1].isdigit() and tokens[i][0] - tokens[i - 1][1] <= 1:
        fixed.append(50)
    digits = shape = compact = ""
    letters = spelled = lines = wide = held = False
    code = True
    seps: set[str] = set()
    for j in range(i + 1, min(len(tokens), i + MOST_TOKENS) + 1):
        word = words[j - 1]
        if j - 1 > i and tokens[j - 1][0] > tokens[j - 2][1]:
            gap = text[tokens[j - 2][1] : tokens[j - 1][0]]
            seps.update(gap)
            shape += gap
            lines, wide = lines or "\n" in gap, wide or "  " in gap
        alnum = word.isalnum()
        if not alnum:
            seps.add(word)
            shape += word
        elif word.isascii() and word.isdigit():
            digits += word
            shape += str(len(word))
        else:
            digits += _not_digit.sub("", word)
            shape += _digits.sub(lambda m: str(len(m.group())), word)
            letters = letters or any(map(str.isalpha, word))
            spelled = spelled or word.lower() == "dot"
        if code and alnum:
            compact += word
            code = "A" <= compact[0] <= "Z"
        held = held or trigger[j - 1]
        if not (held and alnum):
            continue
        n = len(digits)
        on = [*fixed, 1 if n == 0 else 2 if n < 7 else 3 if n < 9 else 4 if n == 9 else 5 if n == 10 else 6 if n < 16 else 7 if n < 20 else 8]
        on.append(10 if not seps else 11 if seps == {"-"} else 12 if seps == {" "} else 13 if seps == {"."} else 14 if seps <= _plain else 15)
        if letters:
            on.append(9)
        else:
            if len(shape) < 20 and (k := _groups.get(shape.replace(") ", ")").replace(" ", "-").replace(".", "-"))) is not None:
                on.append(16 + k)
            if 16 <= n <= 19:
                on.append(27 if luhn(digits) else 28)
        if spelled:
            on += _spelled(words[i:j], [x.lower() for x in words[i:j]])
        if code and len(compact) <= 34 and _iban.fullmatch(compact):
            on.append(36 if _mod97(compact) else 37)
        if j < len(tokens):
            apart = tokens[j][0] - tokens[j - 1][1]
            if not apart and words[j][0] not in ".,;:!?)\"'":
                on.append(48)
            if apart <= 1 and words[j].isdigit():
                on.append(49)  # a number follows at once
        if lines:
            on.append(51)
        if wide:
            on.append(52)
        on.append(53 if j - i <= 3 else 54 if j - i <= 8 else 55)
        yield j, on


class Region:
    """Tokens of a training sentence with all its candidate segments."""

    def __init__(self, text: str, tokens: list[tuple[int, int]]):
        self.text, self.tokens = text, tokens
        n = len(tokens)
        words = [text[a:b] for a, b in tokens]
        trigger = [_trigger(x) for x in words]
        found = [(i, j, on) for i in range(n) if words[i].isalnum() or words[i] in "(+" for j, on in _segments(text, tokens, words, trigger, i)]
        self.segments = [(i, j) for i, j, _ in found]
        self.matrix = np.zeros((len(found), FEATURES))
        for k, (_, _, on) in enumerate(found):
            self.matrix[k, on] = 1
        self.outside = np.array(trigger, float)
        self.ending: list[list[int]] = [[] for _ in range(n + 1)]
        for k, (_, j) in enumerate(self.segments):
            self.ending[j].append(k)

    def scores(self, w: np.ndarray, out: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return self.matrix @ w, out[0] + self.outside * out[1]

    def gradient(self, truth: list[tuple[int, int, int]], w: np.ndarray, out: np.ndarray, trans: np.ndarray):
        """Of the log-likelihood of the true segments: observed less expected features."""
        seg, single = self.scores(w, out)
        n = len(self.tokens)
        lse = lambda x: (m := x.max(0)) + np.log(np.exp(x - m).sum(0))
        small = -1e30
        fore = np.full((n + 1, LABELS), small)
        fore[0, 0] = 0
        for j in range(1, n + 1):
            fore[j, 0] = lse(fore[j - 1] + trans[:, 0]) + single[j - 1]
            for k in self.ending[j]:
                i = self.segments[k][0]
                fore[j, 1:] = np.logaddexp(fore[j, 1:], lse(fore[i][:, None] + trans[:, 1:]) + seg[k])
        rear = np.full((n + 1, LABELS), small)
        rear[n] = 0
        starting: list[list[int]] = [[] for _ in range(n + 1)]
        for k, (i, _) in enumerate(self.segments):
            starting[i].append(k)
        for i in range(n - 1, -1, -1):
            rear[i] = trans[:, 0] + single[i] + rear[i + 1, 0]
            for k in starting[i]:
                step = trans[:, 1:] + seg[k] + rear[self.segments[k][1], 1:]
                rear[i] = np.logaddexp(rear[i], lse(step.T))
        total = lse(fore[n])
        gw, go, gt = np.zeros_like(w), np.zeros(2), np.zeros_like(trans)
        for i in range(n):
            p = np.exp(fore[i] + trans[:, 0] + single[i] + rear[i + 1, 0] - total)
            gt[:, 0] -= p
            go -= p.sum() * np.array([1, self.outside[i]])
        for k, (i, j) in enumerate(self.segments):
            p = np.exp(fore[i][:, None] + trans[:, 1:] + seg[k] + rear[j, 1:] - total)
            gt[:, 1:] -= p
            gw -= self.matrix[k][:, None] * p.sum(0)
        number = {s: k for k, s in enumerate(self.segments)}
        at, label = 0, 0
        starts = {i: (j, y) for i, j, y in truth}
        while at < n:
            if at in starts and (at, starts[at][0]) in number:
                j, y = starts[at]
                gw[:, y] += self.matrix[number[at, j]]
                gt[label, y + 1] += 1
                at, label = j, y + 1
            else:
                go += np.array([1, self.outside[at]])
                gt[label, 0] += 1
                at, label = at + 1, 0
        return gw, go, gt


def _iban_like(rng: random.Random, good: bool) -> str:
    body = rng.choice(["DE", "FR", "ES", "GB"]) + "00" + "".join(rng.choice("0123456789") for _ in range(rng.choice([14, 18, 20])))
    turned = body[4:] + body[:4]
    check = 98 - int("".join(str(int(c, 36)) for c in turned)) % 97
    code = body[:2] + f"{check if good else (check + 7) % 97:02d}" + body[4:]
    return " ".join(code[k : k + 4] for k in range(0, len(code), 4)) if rng.random() < 0.5 else code


def _card_like(rng: random.Random, good: bool) -> str:
    digits = "4" + "".join(rng.choice("0123456789") for _ in range(14))
    last = next(d for d in "0123456789" if luhn(digits + d) == good)
    code = digits + last
    return rng.choice([" ", "-", "."]).join(code[k : k + 4] for k in range(0, 16, 4)) if rng.random() < 0.7 else code


def sentences(count: int, seed: int) -> list[tuple[str, list[tuple[int, int, str]]]]:
    """Texts with labelled spans (start, end, kind), and numbers that are no personal data."""
    rng = random.Random(seed)
    letters = "abcdefghijklmnopqrstuvwxyz"
    word = lambda: "".join(rng.choice(letters) for _ in range(rng.randint(2, 9)))
    num = lambda k: "".join(rng.choice("0123456789") for _ in range(k))
    octet = lambda: str(rng.randint(0, 255))

    def entity() -> tuple[str, str, list[str]]:
        kind = rng.choice(KINDS)
        if kind == "email":
            at, dot = rng.choice([(" at ", " dot "), (" [at] ", " [dot] "), (" (at) ", " (dot) "), ("[at]", "[dot]"), ("(at)", "(dot)")])
            host = dot.join([word()] * rng.choice([1, 1, 2]) + [rng.choice(["com", "org", "net", "de", "fr"])])
            return kind, f"{word()}{at}{host}", ["email", "mail", "contact", "write to", "reach me", ""]
        if kind == "ip":
            return kind, rng.choice([" . ", "[.]", " dot "]).join(octet() for _ in range(4)), ["host", "server", "ip", "address"]
        if kind == "card":
            return kind, _card_like(rng, True), ["card", "visa", "credit card", ""]
        if kind == "phone":
            shape = rng.choice(["({}) {}-{}", "{}-{}-{}", "{} {} {}", "{}.{}.{}", "({}){}-{}"])
            return kind, shape.format(num(3), num(3), num(4)), ["call", "phone", "tel", "mobile", "fax", "dial"]
        return kind, _iban_like(rng, True), ["iban", "account", ""]

    def decoy() -> str:
        return rng.choice([
            lambda: str(rng.randint(1900, 2030)), lambda: num(16), lambda: _card_like(rng, False), lambda: f"{num(4)}-{num(2)}-{num(2)}",
            lambda: f"{rng.randint(1, 99)}.{num(2)}", lambda: f"{num(2)}:{num(2)}", lambda: num(rng.randint(2, 9)), lambda: num(rng.randint(17, 24)),
            lambda: "dot", lambda: f"at the dot {word()}", lambda: f"{num(3)}-{num(3)}", lambda: f"{word()} dot {word()}", lambda: f"{num(4)} {num(4)}",
            lambda: _iban_like(rng, False), lambda: f"{num(2)}, {num(3)}, {num(4)}", lambda: f"{num(3)} {num(2)}", lambda: f"{num(5)}-{num(4)}",
            lambda: f"{num(3)} {num(3)} {num(4)}" , lambda: " ".join(num(rng.randint(1, 4)) for _ in range(rng.randint(3, 9))),
        ])()

    made = []
    for _ in range(count):
        text, spans = "", []
        for _ in range(rng.randint(1, 3)):
            text += " ".join(word() for _ in range(rng.randint(1, 4))) + rng.choice([" ", " ", ", ", ": "])
            if rng.random() < 0.5:
                kind, said, cues = entity()
                cue = rng.choice(cues)
                text += cue + rng.choice([" ", ": "]) * bool(cue)
                spans.append((len(text), len(text) + len(said), kind))
                text += said
            else:
                text += decoy()
            text += rng.choice([" ", ". ", ", ", "\n"])
        made.append((text + word(), spans))
    return made


@lru_cache(maxsize=2)
def train(count: int = TRAIN_SENTENCES, seed: int = 7, rounds: int = 12) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Weights of span features, of outside tokens and of transitions, by AdaGrad on the penalised likelihood."""
    data = []
    for text, spans in sentences(count, seed):
        tokens = [m.span() for m in _token.finditer(text)]
        first, last = {a: k for k, (a, _) in enumerate(tokens)}, {b: k + 1 for k, (_, b) in enumerate(tokens)}
        data.append((Region(text, tokens), [(first[a], last[b], KINDS.index(kind)) for a, b, kind in spans]))
    w, out, trans = np.zeros((FEATURES, len(KINDS))), np.zeros(2), np.zeros((LABELS, LABELS))
    sums = [np.full_like(x, 1e-3) for x in (w, out, trans)]
    order = list(range(len(data)))
    rng = random.Random(seed)
    for _ in range(rounds):
        rng.shuffle(order)
        for k in order:
            for x, s, g in zip((w, out, trans), sums, data[k][0].gradient(data[k][1], w, out, trans)):
                g = g - 2e-4 * x
                s += g * g
                x += 0.4 * g / np.sqrt(s)
    return w, out, trans


def reading(text: str, starts: np.ndarray, ends: np.ndarray, weights: tuple[np.ndarray, np.ndarray, np.ndarray]) -> list[tuple[int, int, int]]:
    """Segments (i, j, kind) of the best reading of a stretch of tokens of any length.

    Values reach MOST_TOKENS ahead, so only that many are held; a token leaves the steps back to it, some bytes.
    """
    w, out, trans = weights
    rows, bias, plain, cross = w.tolist(), out.tolist(), trans[:, 0], trans[:, 1:]
    n, ring = len(starts), MOST_TOKENS + 1
    came, label = np.zeros((n + 1, LABELS), np.int8), np.zeros((n + 1, LABELS), np.int8)
    value = [[-np.inf] * LABELS for _ in range(ring)]
    value[0][0] = 0.0
    for first in range(0, n, WINDOW):
        a, b = max(0, first - 3), min(n, first + WINDOW + ring)
        tokens = list(zip(starts[a:b].tolist(), ends[a:b].tolist()))
        words = [text[x:y] for x, y in tokens]
        trigger = [_trigger(x) for x in words]
        for i in range(first - a, min(n, first + WINDOW) - a):
            at = i + a
            now = np.array(value[at % ring])
            value[at % ring] = [-np.inf] * LABELS
            into = now + plain
            best, ahead = int(into.argmax()), value[(at + 1) % ring]
            if (step := float(into[best]) + bias[0] + bias[1] * trigger[i]) > ahead[0]:
                ahead[0], came[at + 1, 0], label[at + 1, 0] = step, 1, best
            if not (words[i].isalnum() or words[i] in "(+"):
                continue
            every = now[:, None] + cross
            top, of = every.max(0).tolist(), every.argmax(0)
            for j, on in _segments(text, tokens, words, trigger, i):
                some, ahead = [rows[k] for k in on], value[(j + a) % ring]
                for y, start in enumerate(top):
                    if (step := start + sum([r[y] for r in some])) > ahead[y + 1]:
                        ahead[y + 1], came[j + a, y + 1], label[j + a, y + 1] = step, j - i, of[y]
    found, at, now = [], n, int(np.argmax(value[n % ring]))
    while at:
        step, before = int(came[at, now]), int(label[at, now])
        if now:
            found.append((at - step, at, now - 1))
        at, now = at - step, before
    return found[::-1]


def added_spans(text: str, weights: tuple[np.ndarray, np.ndarray, np.ndarray], taken: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """Spans of the best reading that overlap no taken one."""
    starts, ends, hits = array("q"), array("q"), array("q")
    for k, m in enumerate(_token.finditer(text)):
        starts.append(m.start())
        ends.append(m.end())
        if m.end() - m.start() > 1 and _trigger(m.group()):
            hits.append(k)
    starts, ends, hits = (np.array(x, np.int64) for x in (starts, ends, hits))
    # stretches of tokens within reach of a trigger
    breaks = np.flatnonzero(np.diff(hits) > 2 * MOST_TOKENS)
    found = []
    for low, high in zip(hits[np.r_[0, breaks + 1]].tolist(), hits[np.r_[breaks, len(hits) - 1]].tolist()) if len(hits) else ():
        s = slice(max(0, low - MOST_TOKENS), high + MOST_TOKENS + 1)
        some, until = starts[s], ends[s]
        found += [(KINDS[y], int(some[i]), int(until[j - 1])) for i, j, y in reading(text, some, until, weights)]
    held = sorted((a, b) for _, a, b in taken)
    before, reach = [a for a, _ in held], list(accumulate((b for _, b in held), max))
    # of the taken spans that start before its end, none reaches beyond its start
    return [s for s in found if not (k := bisect_left(before, s[2])) or reach[k - 1] <= s[1]]


def all_spans(text: str, weights) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
    """Base spans, and base and added ones by kind and start."""
    base = base_spans(text)
    return base, sorted([*base, *added_spans(text, weights, base)], key=lambda s: (KINDS.index(s[0]), s[1]))


def _said(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def find(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, n_email, n_ip, n_card, n_phone, base, spans) of every row; base and spans as kind:start:end lists."""
    weights = train()
    counts = [f"n_{k}" for k in BASE]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            numbers, base_said, said = np.zeros((n, len(BASE)), np.int64), [""] * n, [""] * n
            maybe = pc.match_substring_regex(batch.column(1), MAYBE).fill_null(False).to_numpy(zero_copy_only=False)
            for k in np.flatnonzero(maybe).tolist():
                base, every = all_spans(batch.column(1)[k].as_py(), weights)
                for kind, _, _ in base:
                    numbers[k, BASE.index(kind)] += 1
                base_said[k], said[k] = _said(base), _said(every)
            yield pa.record_batch([batch.column(0), *(pa.array(numbers[:, k]) for k in range(len(BASE))), pa.array(base_said, pa.string()), pa.array(said, pa.string())], ["id", *counts, "base", "spans"])

    some = df.select(df[id_col].alias("id"), df[text_col].cast("string").alias("text"))
    kind = some.schema["id"].dataType.simpleString()
    return some.mapInArrow(trimmed(run), f"id {kind}, {', '.join(f'{c} bigint' for c in counts)}, base string, spans string").withColumnRenamed("id", id_col)


def masked(text: str, spans: list[tuple[str, int, int]]) -> str:
    """text with each union of overlapping spans replaced by the kind of its first one."""
    out, at = [], 0
    for kind, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
        if a >= at:
            out += [text[at:a], f"[{kind.upper()}]"]
        at = max(at, b)
    return "".join([*out, text[at:]])


def redact(df: DataFrame, text_col: str = "text") -> DataFrame:
    """df with every span in text_col replaced by the name of its kind; a null text stays null."""
    weights = train()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            col = batch.column(text_col)
            maybe = pc.match_substring_regex(col, MAYBE).fill_null(False)
            if pc.any(maybe).as_py():
                fresh = col.to_pylist()
                for k in np.flatnonzero(maybe.to_numpy(zero_copy_only=False)).tolist():
                    fresh[k] = masked(fresh[k], all_spans(fresh[k], weights)[1])
                batch = batch.set_column(batch.schema.get_field_index(text_col), batch.schema.field(text_col), pa.array(fresh, col.type))
            yield batch

    return df.withColumn(text_col, F.col(text_col).cast("string")).mapInArrow(trimmed(run), df.schema)
