"""Personal data: exact patterns, and a linear-chain conditional random field that adds what the patterns miss.

The field labels the words of a line as email, ip, card, phone or other. Its features are word shapes (letters and digit
runs), a few cue words and punctuation, of the word itself and of its neighbours. It is trained here, by gradient ascent on
the exact likelihood, from the small labelled table that `labelled_lines` builds. Lines are decoded by Viterbi in numpy
batches. A line is skipped only where a bound proves that "other" throughout is its best labelling.

Defined cases: a null text counts as empty; an empty text has no spans. Spans are code points, end exclusive. Words that a
pattern has taken end the field's sequence, so spans never overlap and the patterns' stay as they are. Texts, lines and words of
any length are read whole. Repeated rows are scanned one by one.
"""

from __future__ import annotations

import hashlib
import random
import re
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Memo, carried, column_texts, fields_of, held, pieces

KINDS = ("email", "ip", "card", "phone")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
#: The contract's patterns; the look-behind and possessive runs only keep them linear on long digit runs.
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGITS = re.compile(r"[0-9]")
WORDS = re.compile(r"\S+")
SPANS = "array<struct<kind:string,start:int,end:int,source:string>>"
#: Types that a field remembers between batches, and words whose type it remembers; neither changes results.
MOST_TYPES, MOST_WORDS = 200_000, 75_000


def luhn(digits: str) -> bool:
    odd = sum(map(int, digits[-1::-2]))
    return (odd + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])) % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost non-overlapping addresses, found from each @ outwards."""
    out, end, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in LOCAL:
            start -= 1
        hit = DOMAIN.match(text, at + 1) if start < at else None
        if hit:
            out.append((start, end := hit.end()))
        at = text.find("@", max(end, at + 1))
    return out


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """The patterns' spans, by kind, then start."""
    out = [("email", a, b) for a, b in emails(text)]
    if DIGITS.search(text):
        out += [("ip", m.start(), m.end()) for m in IP.finditer(text) if all(len(p := x.lstrip("0")) <= 3 and int(p or 0) <= 255 for x in m[0].split("."))]
        for m in CARD.finditer(text):
            digits = m[0].replace(" ", "").replace("-", "")
            if 13 <= len(digits) <= 19 and luhn(digits):
                out.append(("card", m.start(), m.end()))
        if "+" in text:
            out += [("phone", m.start(), m.end()) for m in PHONE.finditer(text) if 9 <= len(DIGITS.findall(m[0])) <= 15]
    return out


# The labelled table. Each line is a list of (word, label); numbers and names are drawn by a fixed seed.


def labelled_lines(seed: int = 7, copies: int = 24) -> list[list[tuple[str, str]]]:
    """Training lines: patterns of personal data that plain expressions miss or split, and look-alikes that are none."""
    rnd = random.Random(seed)
    number = lambda n: "".join(rnd.choice("0123456789") for _ in range(n))
    name = lambda: "".join(rnd.choice(("ba", "ko", "li", "mar", "tin", "sa", "en", "jo", "ru")) for _ in range(rnd.randint(2, 3)))
    text = lambda n: [(rnd.choice(("the", "of", "und", "que", "une", "der", "Then", "it", "los", "was", name(), name(), name() + ",", name().title(), name() + ".", "%", "|", "-", "a")), "other") for _ in range(n)]
    cue = {"email": ("email:", "mail", "contact", "write", "E-Mail"), "ip": ("ip", "address", "host", "server", "IP:"), "card": ("card", "visa", "card:", "Karte"), "phone": ("phone", "call", "tel", "Tel.:", "phone:", "fax", "mobile")}
    people = {
        "email": (lambda: f"{name()} (at) {name()} (dot) com", lambda: f"{name()} [at] {name()} [dot] org", lambda: f"{name()}.{name()} (at) {name()}.{rnd.choice(('com', 'de', 'org'))}", lambda: f"{name()}.{number(2)}@{name()}{number(1)}.{name()}.com", lambda: f"{name()} {{at}} {name()} {{dot}} net", lambda: f"{name()}[at]{name()}.com"),
        "ip": (lambda: ".".join(str(rnd.randint(1, 255)) for _ in range(4)), lambda: ":".join(f"{rnd.randint(4096, 65535):x}" for _ in range(8)), lambda: f"{rnd.randint(1, 255)}[.]{rnd.randint(1, 255)}[.]{rnd.randint(1, 255)}[.]{rnd.randint(1, 255)}"),
        "card": (lambda: "4" + number(15), lambda: " ".join(number(4) for _ in range(4)), lambda: "-".join(number(4) for _ in range(4)), lambda: ".".join(number(4) for _ in range(4)), lambda: f"3{number(3)} {number(6)} {number(5)}"),
        "phone": (lambda: f"({number(3)}) {number(3)}-{number(4)}", lambda: f"+1 ({number(3)}) 555-{number(4)}", lambda: f"{number(3)}-{number(3)}-{number(4)}", lambda: f"+{number(2)} {number(3)} {number(7)}", lambda: f"{number(3)}.{number(3)}.{number(4)}", lambda: f"00{number(2)} {number(3)} {number(6)}"),
    }
    never = (
        lambda: f"version {number(1)}.{number(1)}.", lambda: "Version 2.0.", lambda: "BY-NC 4.0.", lambda: f"{number(4)}-{number(2)}-{number(2)}", lambda: f"{number(2)}.{number(2)}.{number(4)}", lambda: f"{number(2)}:{number(2)}", lambda: f"{number(3)} {name()}", lambda: f"{number(1)},{number(3)}.{number(2)}",
        lambda: f"${number(4)}", lambda: f"AKIA{name().upper()}{number(2)}{name().upper()}{number(2)}", lambda: f"{number(1)}.{number(1)}.{number(1)}", lambda: f"isbn {number(3)}-{number(1)}-{number(2)}-{number(6)}-{number(1)}", lambda: f"page {number(2)}-{number(2)}", lambda: f"{name()} at {name()} dot", lambda: f"{number(1)}.", lambda: f"x{number(2)} = {number(3)};",
        lambda: f"{number(3)} {number(3)}", lambda: f"{number(7)}", lambda: f"{number(10)}", lambda: f"({number(1)})", lambda: f"({number(4)})", lambda: f"[{number(2)}]", lambda: "(at) the", lambda: f"call {number(2)}", lambda: f"id-{number(4)}-{number(4)}", lambda: f"{number(24)}", lambda: f"0x{number(8)}", lambda: f"{name()}_{number(3)}", lambda: f"§ {number(3)} {number(1)}", lambda: f"{number(4)} {number(4)} {number(2)}",
        lambda: f"|{number(2)}|{number(3)}|", lambda: f"{number(2)}% {number(2)}%", lambda: f"{number(4)}/{number(4)}", lambda: f"token = \"{name()}{number(6)}\"", lambda: "10:30 - 11:45", lambda: f"std::{name()}::{name()}", lambda: f"@{name()}", lambda: f"{name()}@{name()}", lambda: f"{number(4)} {number(4)} {number(4)}",
    )
    lines = []
    for _ in range(copies):
        for kind, forms in people.items():
            for form in forms:
                lead = [(rnd.choice(cue[kind]), "other")] if rnd.random() < 0.5 else []
                tail = rnd.choice(("", "", ".", ","))
                words = (form() + tail).split()
                lines.append([*text(rnd.randint(0, 5)), *lead, *[(w, kind) for w in words], *text(rnd.randint(0, 5))])
        for form in never:
            lines.append([*text(rnd.randint(0, 5)), *[(w, "other") for w in form().split()], *text(rnd.randint(0, 5))])
        lines.append(text(rnd.randint(1, 12)))
    return lines


CUES = frozenset("at dot phone call tel fax mobile card visa karte email e-mail mail ip address host server version isbn page".split())
SHAPE = re.compile(r"[0-9]+|[^\W\d_]+|.", re.S)
EDGE = ".,;:!?\"'"


def features(word: str) -> tuple[str, ...]:
    """What the field sees of a word; plain words of letters all look alike."""
    core = word.strip(EDGE)
    low = core.lower()
    if core.isalpha():
        return ("letters", f"cue={low}") if low in CUES else ("letters",)
    shape = "".join([f"d{min(len(p), 17)}" if p.isdigit() else "a" if p.isalpha() else p for p in SHAPE.findall(core)])
    digits = sum(map(str.isdigit, core))
    marks = "".join(sorted({c for c in core if not c.isalnum()}))[:6]
    if not digits and not any(c in core for c in "@()[]{}:"):
        return ("mixed", f"cue={low}") if low in CUES else ("mixed",)
    hexed = "hex" if core and all(c in "0123456789abcdefABCDEF:" for c in core) and core.count(":") > 3 else "nohex"
    return (f"shape={shape}", f"digits={min(digits, 20)}", f"marks={marks}", hexed, f"cue={low}" if low.strip("()[]{}") in CUES else "nocue")


class Field:
    """Weights of a trained field. A type is the set of a word's features that carry weight, so there are only as many types as
    the training table has combinations of features, whatever the texts hold. `table` scores types at offset 0, -1, +1."""

    def __init__(self, names: dict[str, int], weights: np.ndarray, moves: np.ndarray):
        self.names, self.weights, self.moves = names, weights, moves  # weights: (3, features, labels)
        self.memo = Memo(self.type_of, MOST_WORDS)
        self.forget()
        extra = moves - moves[0, 0]
        self.slack = max(0.0, float(extra.max()))
        # what two moves can gain at most by a word that is not "other", instead of one that is, between any neighbours
        one = (moves - moves[:, :1]).max(), (moves - moves[:1]).max()
        both = (moves[:, :, None] + moves[None] - (moves[:, 0][:, None] + moves[0])[:, None, :]).max()
        self.most = MOST_TYPES
        self.pull = max(0.0, float(both), *map(float, one)) + 1e-9

    def forget(self) -> None:
        """Empties the memory of types and words. Only between batches: numbers of types mean nothing afterwards."""
        self.types: dict[tuple[int, ...], int] = {}
        self.table = np.zeros((3, 256, len(KINDS) + 1))
        self.memo.clear()

    def type_of(self, word: str) -> int:
        ids = tuple(self.names[f] for f in features(word) if f in self.names)
        if ids not in self.types:
            n = self.types[ids] = len(self.types)
            if n >= self.table.shape[1]:
                self.table = np.concatenate([self.table, np.zeros_like(self.table)], 1)
            self.table[:, n] = self.weights[:, list(ids)].sum(1)
        return self.types[ids]

    def emissions(self, types: np.ndarray) -> np.ndarray:
        """Scores (words x labels) of one or more lines; types hold -1 between lines."""
        out = np.where(types[:, None] >= 0, self.table[0][types], 0)
        out[1:] += np.where(types[:-1, None] >= 0, self.table[1][types[:-1]], 0)
        out[:-1] += np.where(types[1:, None] >= 0, self.table[2][types[1:]], 0)
        return out

    def _gain(self, types: np.ndarray) -> np.ndarray:
        """What the best label other than "other" gains at most, at each word, before moves."""
        n = len(self.types)
        gain = (self.table[:, :n, 1:] - self.table[:, :n, :1]).max(2)
        gain = np.concatenate([gain, np.zeros((3, 1))], 1)  # type -1
        bound = gain[0][types]
        bound[1:] += gain[1][types[:-1]]
        bound[:-1] += gain[2][types[1:]]
        return bound

    def suspects(self, types: np.ndarray) -> np.ndarray:
        """True for words where a label other than "other" could pay, if all around are "other"; elsewhere the bound rules it out."""
        return (self._gain(types) + 2 * self.slack > 0) & (types >= 0)

    def settled(self, types: np.ndarray) -> np.ndarray:
        """True for words that are "other" whatever their neighbours are: sequences can be decoded apart on either side of them."""
        return (self._gain(types) + self.pull < 0) & (types >= 0)

    def viterbi(self, lines: list[np.ndarray]) -> list[np.ndarray]:
        """Best labels of each line of types."""
        return self.decode([self.emissions(np.concatenate([[-1], x, [-1]]))[1:-1] for x in lines])

    def decode(self, scores: list[np.ndarray]) -> list[np.ndarray]:
        """Best labels of sequences, given their words' scores; those of like length are decoded together."""
        out: list[np.ndarray] = [np.zeros(0, int)] * len(scores)
        order = sorted(range(len(scores)), key=lambda i: len(scores[i]))
        while order:
            longest = len(scores[order[-1]])
            take = [i for i in order[-max(1, 200_000 // max(1, longest)) :] if 2 * len(scores[i]) >= longest]
            del order[-len(take) :]
            lengths = np.array([len(scores[i]) for i in take])
            score = np.zeros((len(take), longest, len(KINDS) + 1))
            for row, i in enumerate(take):
                score[row, : len(scores[i])] = scores[i]
            state, back = score[:, 0].copy(), np.zeros((longest, len(take), score.shape[2]), np.int8)
            for t in range(1, longest):
                step = state[:, :, None] + self.moves
                back[t] = step.argmax(1)
                state = np.where((t < lengths)[:, None], step.max(1) + score[:, t], state)
            label = np.zeros((len(take), longest), np.int8)
            best = state.argmax(1)
            for t in range(longest - 1, -1, -1):
                label[:, t] = best
                best = np.where((t < lengths) & (t > 0), back[t][np.arange(len(take)), best], best)
            for row, i in enumerate(take):
                out[i] = label[row, : lengths[row]]
        return out


class Likelihood:
    """The regularised log likelihood of labelled lines and its gradient, by forward and backward sums over all lines at once."""

    def __init__(self, lines: Sequence[Sequence[tuple[str, str]]], decay: float):
        labels = ("other", *KINDS)
        self.names: dict[str, int] = {}
        for line in lines:
            for word, _ in line:
                for f in features(word):
                    self.names.setdefault(f, len(self.names))
        self.n, self.longest, self.k, self.decay = len(lines), max(map(len, lines)), len(labels), decay
        types: dict[tuple[str, ...], int] = {}
        grid, self.gold = np.full((self.n, self.longest + 2), -1), np.zeros((self.n, self.longest), int)
        for i, line in enumerate(lines):
            for t, (word, label) in enumerate(line):
                grid[i, t + 1] = types.setdefault(features(word), len(types))
                self.gold[i, t] = labels.index(label)
        self.there = grid[:, 1:-1] >= 0
        self.member = np.zeros((len(types), len(self.names)))
        for seen, i in types.items():
            self.member[i, [self.names[f] for f in seen]] = 1
        self.sides = [grid[:, 1:-1], grid[:, :-2], grid[:, 2:]]

    def at(self, weights: np.ndarray, moves: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        """Value and both gradients at some weights."""
        n, longest, k, there, sides = self.n, self.longest, self.k, self.there, self.sides
        table = np.concatenate([self.member @ weights, np.zeros((3, 1, k))], 1)
        score = sum(table[s][sides[s]] for s in range(3))
        fwd, bwd = np.zeros((n, longest, k)), np.zeros((n, longest, k))
        lse = lambda x, axis: (m := x.max(axis, keepdims=True)).squeeze(axis) + np.log(np.exp(x - m).sum(axis))
        fwd[:, 0] = score[:, 0]
        for t in range(1, longest):
            fwd[:, t] = np.where(there[:, t, None], lse(fwd[:, t - 1, :, None] + moves, 1) + score[:, t], fwd[:, t - 1])
        for t in range(longest - 2, -1, -1):
            bwd[:, t] = np.where(there[:, t + 1, None], lse(moves[None] + (score[:, t + 1] + bwd[:, t + 1])[:, None, :], 2), 0)
        z = lse(fwd[:, -1], 1)
        p = np.exp(fwd + bwd - z[:, None, None]) * there[:, :, None]
        gold = np.eye(k)[self.gold] * there[:, :, None]
        residual = gold - p
        grad = np.zeros_like(weights)
        for s in range(3):
            at = np.zeros((len(self.member) + 1, k))
            np.add.at(at, sides[s].ravel(), residual.reshape(-1, k))
            grad[s] = self.member.T @ at[:-1]
        pair = np.exp(fwd[:, :-1, :, None] + moves + (score[:, 1:] + bwd[:, 1:])[:, :, None, :] - z[:, None, None, None]) * there[:, 1:, None, None]
        seen = np.zeros((k, k))
        np.add.at(seen, (self.gold[:, :-1][there[:, 1:]], self.gold[:, 1:][there[:, 1:]]), 1)
        value = (gold * score).sum() + (seen * moves).sum() - z.sum() - self.decay * n / 2 * ((weights**2).sum() + (moves**2).sum())
        return float(value), grad - self.decay * n * weights, seen - pair.sum((0, 1)) - self.decay * n * moves


def train_field(lines: Sequence[Sequence[tuple[str, str]]], rounds: int = 120, rate: float = 0.3, decay: float = 0.002) -> Field:
    """Maximises the regularised likelihood by adaptive gradient steps over all lines."""
    goal = Likelihood(lines, decay)
    weights, moves = np.zeros((3, len(goal.names), goal.k)), np.zeros((goal.k, goal.k))
    square = [np.full_like(weights, 1e-8), np.full_like(moves, 1e-8)]
    for _ in range(rounds):
        _, *steps = goal.at(weights, moves)
        for value, step, total in zip((weights, moves), steps, square):
            total += step * step
            value += rate * step / np.sqrt(total)
    return Field(goal.names, weights, moves)


def merged(spans: Sequence[tuple[int, int]]) -> list[tuple[int, int]]:
    """The same places as disjoint spans in order."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def runs_of(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of true values."""
    edges = np.flatnonzero(np.diff(mask.astype(np.int8), prepend=0, append=0))
    return edges[::2], edges[1::2]


def crf_spans(texts: Sequence[str], field: Field, taken: Sequence[Sequence[tuple[int, int]]] | None = None) -> list[list[tuple[str, int, int]]]:
    """What the field finds in each text, edges trimmed of punctuation. Words that touch a span in `taken` end a line's sequence. The
    work grows in proportion to the texts, however many spans or words a line has."""
    if len(field.types) >= field.most:
        field.forget()
    memo, flat, starts, owners = field.memo.__getitem__, [], [], []
    for i, text in enumerate(texts):
        begin, spans, k = 0, merged(taken[i]) if taken else [], 0
        for line in text.split("\n"):
            end = begin + len(line)
            if words := line.split():
                starts.append(len(flat))
                owners.append((i, begin, end))
                while k < len(spans) and spans[k][1] <= begin:
                    k += 1
                if k < len(spans) and spans[k][0] < end:
                    for m in WORDS.finditer(text, begin, end):
                        while k < len(spans) and spans[k][1] <= m.start():
                            k += 1
                        flat.append(-1 if k < len(spans) and spans[k][0] < m.end() else memo(m[0]))
                else:
                    flat += map(memo, words)
                flat.append(-1)
            begin = end + 1
    out: list[list[tuple[str, int, int]]] = [[] for _ in texts]
    if not flat:
        return out
    types, starts = np.array(flat), np.array(starts)
    word, settled = types >= 0, field.settled(types)
    first, last = runs_of(word & ~settled)
    hits = np.concatenate([[0], np.cumsum(field.suspects(types))])
    hot = np.flatnonzero(hits[last] > hits[first])
    if not len(hot):
        return out
    first, last = first[hot], last[hot]
    first = first - ((first > 0) & settled[first - 1])  # the settled neighbours are part of a sequence: moves to them count
    last = last + settled[np.minimum(last, len(settled) - 1)]
    score, line, words = field.emissions(types), -1, []
    for a, found in zip(first, field.decode([score[a:b] for a, b in zip(first, last)])):
        if not found.any():
            continue
        at = int(np.searchsorted(starts, a, "right")) - 1
        i, begin, end = owners[at]
        if at != line:
            line, words = at, [(m.start(), m.end()) for m in WORDS.finditer(texts[i], begin, end)]
        edges = np.flatnonzero(np.diff(found, prepend=-1))
        for x, y in zip(edges, [*edges[1:], len(found)]):
            if found[x]:
                lo, hi = words[a - starts[at] + x][0], words[a - starts[at] + y - 1][1]
                piece = texts[i][lo:hi]
                lo += len(piece) - len(piece.lstrip(EDGE))
                hi -= len(piece) - len(piece.rstrip(EDGE))
                if lo < hi:
                    out[i].append((KINDS[found[x] - 1], lo, hi))
    return out


def find_in(texts: Sequence[str], field: Field) -> list[list[tuple[str, int, int, str]]]:
    """All spans of each text by kind and start, with their source: pattern or field."""
    out = []
    bases = [base_spans(t) for t in texts]
    for base, more in zip(bases, crf_spans(texts, field, [[(a, b) for _, a, b in base] for base in bases])):
        base = [(*s, "pattern") for s in base]
        extra = [(k, a, b, "field") for k, a, b in more]
        out.append(sorted([*base, *extra], key=lambda s: (KINDS.index(s[0]), s[1])))
    return out


def redact(text: str, spans: Sequence[tuple[str, int, int, str]]) -> str:
    """The text with each span, or run of overlapping spans, replaced by its kind."""
    out, end = [], 0
    for kind, a, b, _ in sorted(spans, key=lambda s: (s[1], -s[2])):
        if a >= end:
            out += [text[end:a], f"<{kind.upper()}>"]
        end = max(end, b)
    return "".join([*out, text[end:]])


def find_personal_data(documents: DataFrame, keep: Sequence[str] = ("doc_id",), text: str = "text", redacted: bool = False) -> DataFrame:
    """Returns keep and `spans` (kind, start, end, source), by kind and start; with `redacted`, also the text with the kinds
    in place of the spans (null stays null). The field is trained on the driver, in about a second."""
    trained = train_field(labelled_lines())
    key = "pii-" + hashlib.sha256(trained.weights.tobytes() + trained.moves.tobytes()).hexdigest()
    shared = documents.sparkSession.sparkContext.broadcast((trained.names, trained.weights, trained.moves))
    taken, names, read = carried(documents, keep, text)
    kinds = ["spans " + SPANS, *(["redacted string"] if redacted else [])]
    schema = ", ".join([*fields_of(taken, names), *kinds])
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("source", pa.string())]))

    def run(batches):
        field = held(key, lambda: Field(*shared.value))
        for whole in batches:
            for batch in pieces(whole, read):
                raw = column_texts(batch.column(read))
                found = find_in([t or "" for t in raw], field)
                columns = [*(batch.column(n) for n in names), pa.array([[{"kind": k, "start": a, "end": b, "source": s} for k, a, b, s in x] for x in found], kind)]
                if redacted:
                    columns.append(pa.array([t if t is None or not x else redact(t, x) for t, x in zip(raw, found)], pa.string()))
                yield pa.RecordBatch.from_arrays(columns, names=[*names, "spans", *(["redacted"] if redacted else [])])

    out = taken.mapInArrow(run, schema)
    return out.select(*[F.col(f"k{i}").alias(c) for i, c in enumerate(keep)], "spans", *(["redacted"] if redacted else []))


def joined(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def digests(found: DataFrame, keep: Sequence[str] = ("doc_id",)) -> DataFrame:
    """Counts and digest of the patterns' spans, and all spans as text."""
    base = F.filter("spans", lambda s: s["source"] == "pattern")
    of = lambda kind: F.filter(base, lambda s: s["kind"] == kind)
    counts = [F.size(of(k)).cast("long").alias(f"n_{k}") for k in KINDS]
    return found.select(*keep, *counts, F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"), F.size(F.filter("spans", lambda s: s["source"] == "field")).cast("long").alias("n_added"))
