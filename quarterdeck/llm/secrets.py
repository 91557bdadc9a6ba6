"""Secrets by inferred grammars.

Labelled credentials of each format form a prefix tree with counts. States whose next-symbol and
ending frequencies do not differ by more than their counts explain (a Hoeffding bound) are merged,
with all their successors, until none is left to merge: a probabilistic automaton of the format.
Every candidate of a text, a run of token characters or a part of one between joints (as in
``KEY=value``, paths and query strings), is scored by the log-likelihood of the best format, its end
included, against that of a model of ordinary tokens, and taken above a margin set on held-out
examples. Plain patterns find the base spans first; those always stay.
"""

from __future__ import annotations

import hashlib
import random
import re
import string
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache
from math import log, log2, sqrt

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Base patterns: fixed values of the contract.
_ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII
)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX_LONG = re.compile(r"(?<![0-9a-f])[0-9a-f]{24,}")
_ASSIGN_LEAST, _ACCESS_LEAST = 6, 20
_KEYWORDS = ("password", "passwd", "secret", "token", "api")
CLASSES = (string.ascii_lowercase, string.ascii_uppercase, string.digits, "+/_=-")
KINDS = ("assign", "access", "hex", "learned")

#: Shortest learned span, and characters at which a run may hold another string's end or start.
LEAST, JOINTS = 16, frozenset("=/_-+")
_CANDIDATE = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{16,}")

_ALNUM = string.ascii_letters + string.digits
_UPPER = string.ascii_uppercase + string.digits
_HEXDIGITS = "0123456789abcdef"
# Public credential formats: fixed prefixes, then (alphabet, length) parts or literal text.
FORMATS = {
    "cloud access key": ("AKIA", (_UPPER, 16)),
    "hex digest": ((_HEXDIGITS, 40),),
    "upper hex digest": (("0123456789ABCDEF", 40),),
    "repository token": ("ghp_", (_ALNUM, 36)),
    "payment key": ("sk_live_", (_ALNUM, 24)),
    "chat token": ("xoxb-", (string.digits, 12), "-", (string.digits, 12), "-", (_ALNUM, 24)),
    "web api key": ("AIza", (_ALNUM + "_-", 35)),
    "signed web token": ("eyJ", (_ALNUM + "_-", 33)),
    "mixed secret": ((_ALNUM + "+/", 40),),
}


def labelled_credentials(count: int = 150, seed: int = 11) -> dict[str, list[str]]:
    """Random credentials of each format."""
    draw = random.Random(seed)
    return {
        name: [
            "".join(p if isinstance(p, str) else "".join(draw.choices(p[0], k=p[1])) for p in parts) for _ in range(count)
        ]
        for name, parts in FORMATS.items()
    }


def ordinary_tokens(count: int = 4000, seed: int = 12) -> list[str]:
    """Random tokens that are no credentials: words, compounds, identifiers, numbers, dates, paths."""
    draw = random.Random(seed)
    vowels, others = "aeiou", "bcdfghjklmnprstvwz"

    def word(syllables: int) -> str:
        return "".join(draw.choice(others) + draw.choice(vowels) + draw.choice(["", "n", "r", "s"]) for _ in range(syllables))

    def number(digits: int) -> str:
        return "".join(draw.choices(string.digits, k=digits))

    makers = (
        lambda: word(draw.randint(6, 10)), lambda: word(draw.randint(6, 9)).capitalize(), lambda: word(7).upper(),
        lambda: "-".join(word(draw.randint(1, 3)) for _ in range(4)), lambda: "_".join(word(2) for _ in range(4)),
        lambda: "".join(word(2).capitalize() for _ in range(4)), lambda: "/".join(word(2) for _ in range(4)),
        lambda: number(draw.randint(16, 20)), lambda: f"{number(4)}-{number(2)}-{number(2)}-{word(3)}",
        lambda: word(5) + number(draw.randint(1, 4)), lambda: "=" * draw.randint(16, 40), lambda: "-" * draw.randint(16, 40),
        lambda: "_" * draw.randint(16, 40), lambda: "-".join(number(4) for _ in range(4)), lambda: "/".join([number(4)] * 4),
    )
    return [draw.choice(makers)() for _ in range(count)]


class Automaton:
    """Probabilistic automaton: per state, symbol -> (log2 probability, next), and ending log2 probability."""

    def __init__(self, moves: list[dict[str, tuple[float, int]]], ends: list[float]):
        self.moves, self.ends = moves, ends

    def score(self, text: str) -> float:
        """log2 likelihood of the whole string, its end included; minus infinity if the automaton has no path."""
        return dict(self.prefixes(text, 0)).get(len(text), float("-inf"))

    def prefixes(self, text: str, start: int) -> Iterator[tuple[int, float]]:
        """(end, log2 likelihood) of all strings from ``start`` that the automaton may end, in one walk."""
        state, total = 0, 0.0
        for at in range(start, len(text)):
            step = self.moves[state].get(text[at])
            if step is None:
                return
            total += step[0]
            state = step[1]
            if self.ends[state] > float("-inf"):
                yield at + 1, total + self.ends[state]


def infer(samples: list[str], alpha: float = 0.05) -> Automaton:
    """Merge the prefix tree of ``samples`` into a probabilistic automaton."""
    following: list[dict[str, int]] = [{}]
    passed, ended = [0], [0]
    for text in samples:
        state = 0
        passed[0] += 1
        for c in text:
            if c not in following[state]:
                following[state][c] = len(following)
                following.append({})
                passed.append(0)
                ended.append(0)
            state = following[state][c]
            passed[state] += 1
        ended[state] += 1
    width = sqrt(0.5 * log(2 / alpha))

    # Transitions keep their own counts once states are shared.
    weight: list[dict[str, int]] = [{c: passed[t] for c, t in moves.items()} for moves in following]

    def fold(into: int, other: int) -> None:
        stack = [(into, other)]
        while stack:
            a, b = stack.pop()
            passed[a] += passed[b]
            ended[a] += ended[b]
            for c, target in following[b].items():
                weight[a][c] = weight[a].get(c, 0) + weight[b][c]
                if c in following[a]:
                    if following[a][c] != target:
                        stack.append((following[a][c], target))
                else:
                    following[a][c] = target

    def share(a: int, c: str) -> float:
        return weight[a].get(c, 0) / passed[a]

    def apart(a: int, b: int) -> float | None:
        """How far two states differ; None if they or any common successors differ by more than chance explains."""
        first, stack = None, [(a, b)]
        while stack:
            a, b = stack.pop()
            bound = width * (1 / sqrt(passed[a]) + 1 / sqrt(passed[b]))
            total = abs(ended[a] / passed[a] - ended[b] / passed[b])
            if total > bound:
                return None
            for c in weight[a].keys() | weight[b].keys():
                gap = abs(share(a, c) - share(b, c))
                if gap > bound:
                    return None
                total += gap
            first = total if first is None else first
            # The second state is in the tree part still, so this ends.
            stack += [(following[a][c], t) for c, t in following[b].items() if c in following[a]]
        return first

    settled = [0]
    while True:
        settled_set = set(settled)
        border = {t: (s, c) for s in settled for c, t in following[s].items() if t not in settled_set}
        if not border:
            break
        blue = max(border, key=lambda t: (passed[t], -t))
        near = [(d, s) for s in settled if (d := apart(s, blue)) is not None]
        if near:
            source, symbol = border[blue]
            following[source][symbol] = min(near)[1]
            fold(min(near)[1], blue)
        else:
            settled.append(blue)
    number = {s: i for i, s in enumerate(settled)}
    moves = [{c: (log2(share(s, c)), number[following[s][c]]) for c in weight[s]} for s in settled]
    # A state that has met several symbols of a class may meet its others.
    for state, own in zip(settled, moves, strict=True):
        for group in CLASSES:
            seen = [c for c in group if c in own]
            if len(seen) >= 3:
                usual = max(seen, key=lambda c: weight[state][c])
                for c in group:
                    own.setdefault(c, (log2(0.5 / passed[state]), own[usual][1]))
    ends = [log2(ended[s] / passed[s]) if ended[s] else float("-inf") for s in settled]
    return Automaton(moves, ends)


class OrdinaryModel:
    """Ordinary tokens: the better of smoothed character pairs and runs of one character class."""

    _STAY = 0.94

    def __init__(self, tokens: list[str]):
        pairs: dict[str, dict[str, int]] = defaultdict(lambda: defaultdict(int))
        for token in tokens:
            for a, b in zip("^" + token, token, strict=False):
                pairs[a][b] += 1
        size = len(_ALNUM) + 4
        self.known = {
            a: (log2(1 / (sum(n.values()) + size)), {b: log2((v + 1) / (sum(n.values()) + size)) for b, v in n.items()})
            for a, n in pairs.items()
        }
        self.other = (log2(1 / size), {})
        self.kind = {c: (i, -log2(len(own))) for i, own in enumerate(CLASSES) for c in own}
        self.strange = (len(CLASSES), -6.0)  # any other character, as one of 64
        self.stay, self.leave = log2(self._STAY), log2((1 - self._STAY) / (len(CLASSES) - 1))

    def score(self, text: str) -> float:
        paired, runs, last = 0.0, 0.0, None
        for a, b in zip("^" + text, text, strict=False):
            rest, own = self.known.get(a, self.other)
            paired += own.get(b, rest)
            kind, within = self.kind.get(b, self.strange)
            runs += within + (self.stay if kind == last or last is None else self.leave)
            last = kind
        return max(paired, runs)


class Grammar:
    """Automata of all formats, the ordinary model and the margin between them."""

    def __init__(self, credentials: dict[str, list[str]], ordinary: list[str]):
        split = {name: (own[: len(own) * 4 // 5], own[len(own) * 4 // 5 :]) for name, own in credentials.items()}
        held = len(ordinary) * 4 // 5
        self.formats = {name: infer(own) for name, (own, _) in split.items()}
        self.ordinary = OrdinaryModel(ordinary[:held])
        high = sorted(self.gain(x) for _, (_, own) in split.items() for x in own)
        low = sorted(self.gain(x) for x in ordinary[held:])
        # Between the best ordinary held-out token and the lower end of held-out credentials.
        self.margin = max((high[len(high) // 20] + low[-1]) / 2, 8.0)

    def gain(self, token: str) -> float:
        """Bits by which the best format explains a token better than the ordinary model."""
        best = max(a.score(token) for a in self.formats.values())
        return best - self.ordinary.score(token) if best > float("-inf") else float("-inf")

    def found(self, run: str) -> list[tuple[int, int]]:
        """Parts (start, end) of a run that are taken, leftmost first and never overlapping.

        A part starts with the run or after a joint and ends with the run or before a joint, where
        an automaton may end. From one start the end with the greatest gain is taken.
        """
        out, upto = [], 0
        starts = [0, *(i + 1 for i, c in enumerate(run) if c in JOINTS)]
        for start in starts:
            if start < upto or len(run) - start < LEAST:
                continue
            likely: dict[int, float] = {}
            for automaton in self.formats.values():
                for end, value in automaton.prefixes(run, start):
                    if end - start >= LEAST and (end == len(run) or run[end] in JOINTS):
                        likely[end] = max(value, likely.get(end, float("-inf")))
            gains = [(value - self.ordinary.score(run[start:end]), end) for end, value in likely.items()]
            if gains and max(gains)[0] > self.margin:
                upto = max(gains)[1]
                out.append((start, upto))
        return out


@lru_cache(maxsize=1)
def trained() -> Grammar:
    return Grammar(labelled_credentials(), ordinary_tokens())


def grammar_of(
    labelled: DataFrame, format_column: str = "format", text_column: str = "text", max_rows: int = 20_000
) -> Grammar:
    """Grammar of a table of labelled credentials, read up to ``max_rows`` rows in order of format and text.

    Formats of fewer than ten strings, null and empty strings are left out.
    """
    rows = labelled.select(F.col(format_column).cast("string").alias("f"), F.col(text_column).cast("string").alias("t"))
    rows = rows.where("f IS NOT NULL AND length(t) > 0").distinct().orderBy("f", "t").limit(max_rows).collect()
    by_format: dict[str, list[str]] = defaultdict(list)
    for r in rows:
        by_format[r["f"]].append(r["t"])
    kept = {f: random.Random(f).sample(own, len(own)) for f, own in by_format.items() if len(own) >= 10}
    if not kept:
        raise ValueError("No format has ten labelled credentials.")
    return Grammar(kept, ordinary_tokens())


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of the plain patterns' matches."""
    spans = []
    lowered = text.lower()
    if any(k in lowered for k in _KEYWORDS):
        spans += [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if len(m[2]) >= _ASSIGN_LEAST]
    if "AKIA" in text:
        spans += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= _ACCESS_LEAST]
    # Runs are maximal, so short ones need not be matched to be dropped.
    spans += [(m.start(), 2, m.end()) for m in _HEX_LONG.finditer(text)]
    return spans


def learned_spans(text: str, grammar: Grammar, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Candidates that the grammar takes and no base span overlaps."""
    found = []
    for m in _CANDIDATE.finditer(text):
        for start, end in grammar.found(m[0]):
            start, end = start + m.start(), end + m.start()
            if not any(a < end and start < b for a, _, b in base):
                found.append((start, 3, end))
    return found


def _listed(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in sorted(spans))


def find_secrets(
    docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", grammar: Grammar | None = None
) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, n_learned, base_sha256, spans) per row of ``docs``.

    Spans are kind:start:end in code points, end exclusive, by start and then kind. Null and
    empty texts have none; very long ones are searched whole. Repeated rows and null ids keep a row
    each; other columns are not read. ``grammar`` is that of public formats unless given (``grammar_of``).
    """
    grammar = grammar or trained()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, digests, listed = [[], [], [], []], [], []
            for text in batch.column("text").to_pylist():
                base = base_spans(text or "")
                spans = base + learned_spans(text or "", grammar, base)
                for kind in range(4):
                    counts[kind].append(sum(k == kind for _, k, _ in spans))
                digests.append(hashlib.sha256(_listed(base).encode()).hexdigest())
                listed.append(_listed(spans))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *[pa.array(c, pa.int64()) for c in counts], pa.array(digests), pa.array(listed, pa.string())],
                ["doc_id", "n_assign", "n_access", "n_hex", "n_learned", "base_sha256", "spans"],
            )

    source = docs.select(F.col(id_column).alias("doc_id"), F.col(text_column).cast("string").alias("text"))
    kind = source.schema["doc_id"].dataType.simpleString()
    return source.mapInArrow(
        run, f"doc_id {kind}, n_assign long, n_access long, n_hex long, n_learned long, base_sha256 string, spans string"
    )
