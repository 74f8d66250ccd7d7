"""Secret scans (operator 3): fixed patterns, and probabilistic automata inferred from what they find.

The credentials that the base patterns find in a sample are the labelled examples. For each kind their prefix tree is
folded into a probabilistic automaton over classes of characters. Its nodes are first merged within each level, where
many examples tell whether outgoing and final frequencies agree within Hoeffding bounds and those of all successors
do; then states of different levels that agree so, each seen often enough to tell. Formats of one length so keep it (their states
differ in how far the end is), lists of free length become loops. Every other run of credential characters in every
text, and its parts between separators, is then scored by each automaton against a bigram model of ordinary runs, and
reported where the format is likely enough.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lumenlog.llm.common import lean, strings

KINDS = ("assign", "access", "hex")
# The base patterns. Letters of the first are in either case (ASCII only).
ASSIGN = re.compile(r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
#: Words one of which, in some case, is in every assignment.
STEMS = ("passw", "secret", "token", "api")
#: Characters of a credential, the fewest that are scored (never fewer than the shortest example has), and what parts of a run stand between.
RUN, SHORTEST, PARTS = r"[A-Za-z0-9+/_.=-]", 6, re.compile(r"[^/=.]+")
#: Documents (about; chosen by a hash) in which examples are looked for, and examples of a kind and of ordinary runs
#: that are learned from.
FIT_DOCS, EXAMPLES = 20_000, 400
#: Hashes of examples are ranked in this many parts of each kind.
SALTS = 16
#: Confidence of the merge test, and nats by which a format has to be likelier than an ordinary run.
ALPHA, MARGIN = 0.05, 12.0
#: How often states of different levels have to be seen for a merge, and examples without which a kind has no automaton.
MIN_COUNT, MIN_EXAMPLES = 20, 8


def base_spans(text: str) -> list[tuple[int, int, int, int]]:
    """(start, kind number, end, start of the credential itself) by start, then kind."""
    out = []
    low = text.lower()
    if any(s in low for s in STEMS):
        out += [(m.start(), 0, m.end(), m.start(1)) for m in ASSIGN.finditer(text) if m.end(1) - m.start(1) >= 6]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end(), m.start()) for m in ACCESS.finditer(text)]
    out += [(m.start(), 2, m.end(), m.start()) for m in HEX.finditer(text)]
    return sorted(out)


def shape(token: str) -> str:
    """The token over a small alphabet: digits, hex and other letters in either case, other characters as they are."""
    return token.translate(_SHAPE)


_SHAPE = {ord(c): "0" for c in "0123456789"} | {ord(c): "a" for c in "abcdef"} | {ord(c): "g" for c in "ghijklmnopqrstuvwxyz"}
_SHAPE |= {ord(c): "A" for c in "ABCDEF"} | {ord(c): "G" for c in "GHIJKLMNOPQRSTUVWXYZ"}


@dataclass
class Automaton:
    """to[s][c]: next state; p[s][c], miss[s] and stop[s]: log-probabilities of a symbol, of one that was not seen there
    (which goes where most went, other[s]) and of the end; floor: lowest mean log-probability a symbol may have;
    shortest: the shortest example."""

    to: list[dict[str, int]] = field(default_factory=list)
    p: list[dict[str, float]] = field(default_factory=list)
    stop: list[float] = field(default_factory=list)
    miss: list[float] = field(default_factory=list)
    other: list[int] = field(default_factory=list)
    symbols: set[str] = field(default_factory=set)
    floor: float = 0.0
    shortest: int = 0

    def loglik(self, s: str) -> float:
        """Log-probability of the string; minus infinity if the automaton can't read it."""
        at, total = 0, 0.0
        if not self.to:
            return -math.inf
        for c in s:
            if c in self.to[at]:
                total += self.p[at][c]
                at = self.to[at][c]
            elif self.to[at] and c in self.symbols:
                total += self.miss[at]
                at = self.other[at]
            else:
                return -math.inf
        return total + self.stop[at]


class _Merging:
    """A prefix tree whose nodes are merged: a class of nodes is named by its root and has the sums of its members."""

    def __init__(self, examples: list[str], alpha: float):
        self.to: list[dict[str, int]] = [{}]
        self.count: list[Counter] = [Counter()]
        self.ends = [0]
        for s in examples:
            at = 0
            for c in s:
                self.count[at][c] += 1
                if c not in self.to[at]:
                    self.to[at][c] = len(self.to)
                    self.to.append({})
                    self.count.append(Counter())
                    self.ends.append(0)
                at = self.to[at][c]
            self.ends[at] += 1
        self.root = list(range(len(self.to)))
        self.factor = math.sqrt(0.5 * math.log(2 / alpha))

    def find(self, x: int) -> int:
        while self.root[x] != x:
            self.root[x] = x = self.root[self.root[x]]
        return x

    def total(self, x: int) -> int:
        return self.ends[x] + self.count[x].total()

    def next(self, states: list[int]) -> list[int]:
        """Successors, the most frequent first."""
        return sorted({self.find(z) for s in states for z in self.to[s].values()}, key=lambda z: (-self.total(z), z))

    def alike(self, a: int, b: int, least: int = 1) -> bool:
        """Whether the frequencies of two states and of all that follow on both agree, where both were seen `least`
        times; the two themselves have to be."""
        if min(self.total(a), self.total(b)) < least:
            return False
        todo, seen = [(a, b)], set()
        while todo:
            x, y = (self.find(v) for v in todo.pop())
            if x == y or (x, y) in seen:
                continue
            seen.add((x, y))
            n, m = self.total(x), self.total(y)
            if min(n, m) < least:
                continue
            bound = self.factor * (1 / math.sqrt(n) + 1 / math.sqrt(m))
            if abs(self.ends[x] / n - self.ends[y] / m) > bound:
                return False
            for c in self.to[x].keys() | self.to[y].keys():
                if abs(self.count[x][c] / n - self.count[y][c] / m) > bound:
                    return False
                if c in self.to[x] and c in self.to[y]:
                    todo.append((self.to[x][c], self.to[y][c]))
        return True

    def merge(self, a: int, b: int) -> None:
        """Put two classes together, and what one symbol leads to from both."""
        todo = [(a, b)]
        while todo:
            x, y = (self.find(v) for v in todo.pop())
            if x == y:
                continue
            self.root[y] = x
            self.ends[x] += self.ends[y]
            self.count[x] += self.count[y]
            for c, z in self.to[y].items():
                if c in self.to[x]:
                    todo.append((self.to[x][c], z))
                else:
                    self.to[x][c] = z


def infer(examples: list[str], alpha: float = ALPHA, least: int = MIN_COUNT) -> Automaton:
    """The automaton of the examples; without any it reads nothing."""
    if not examples:
        return Automaton()
    m = _Merging(examples, alpha)
    level = [0]
    while level:
        kept: list[int] = []
        for z in m.next(level):
            z = m.find(z)
            if z in map(m.find, kept):
                continue
            same = next((k for k in kept if m.alike(m.find(k), z)), None)
            if same is None:
                kept.append(z)
            else:
                m.merge(m.find(same), z)
        level = sorted(set(map(m.find, kept)))
    red = [0]
    while new := [z for z in m.next(red) if z not in red]:
        z = new[0]
        same = next((r for r in red if m.alike(r, z, least)), None)
        if same is None:
            red.append(z)
        else:
            m.merge(same, z)
            red = list(dict.fromkeys(map(m.find, red)))
    place = {s: k for k, s in enumerate(red)}
    out = Automaton(shortest=min(map(len, examples)), symbols=set().union(*examples))
    for s in red:
        n = m.total(s) + 1.0
        out.to.append({c: place[m.find(z)] for c, z in m.to[s].items()})
        out.p.append({c: math.log(k / n) for c, k in m.count[s].items()})
        out.stop.append(math.log((m.ends[s] + 0.5) / n))
        out.miss.append(math.log(0.5 / n))
        out.other.append(out.to[-1][max(sorted(m.count[s]), key=m.count[s].__getitem__)] if m.count[s] else -1)
    each = sorted(out.loglik(s) / (len(s) + 1) for s in examples)
    out.floor = each[len(each) // 50]
    return out


@dataclass
class Model:
    """Automata by kind (those with examples) and the bigram model of ordinary runs."""

    automata: dict[int, Automaton]
    pairs: dict[str, float]
    unseen: float

    def kind_of(self, token: str) -> tuple[int, float] | None:
        """The likeliest kind whose format the token has, and by how many nats it beats an ordinary run."""
        s = shape(token)
        plain = sum(self.pairs.get(s[i : i + 2], self.unseen) for i in range(len(s) - 1))
        best = None
        for k, a in self.automata.items():
            if len(s) < a.shortest:
                continue
            got = a.loglik(s)
            if got / (len(s) + 1) >= a.floor and got - plain >= MARGIN and (best is None or got - plain > best[1]):
                best = (k, got - plain)
        return best


    @property
    def shortest(self) -> int:
        """Characters of the shortest run that can be scored; 0 without automata."""
        return max(SHORTEST, min(a.shortest for a in self.automata.values())) if self.automata else 0


def _runs(text: str, spans: list[tuple[int, int, int, int]], pattern: re.Pattern) -> Iterator[re.Match]:
    """Candidates that no base span touches."""
    at, last = 0, -1
    for m in pattern.finditer(text):
        while at < len(spans) and spans[at][0] < m.end():
            last = max(last, spans[at][2])
            at += 1
        if last <= m.start():
            yield m


def _scored(model: Model, token: str) -> list[tuple[int, int, int, float]]:
    """(start, end, kind number, score) of the run if it has a kind's format, else of its parts that have."""
    if hit := model.kind_of(token):
        return [(0, len(token), *hit)]
    parts = [m for m in PARTS.finditer(token) if model.shortest <= len(m.group()) < len(token)]
    return [(m.start(), m.end(), *hit) for m in parts if (hit := model.kind_of(m.group()))]


def fit(docs: DataFrame, fit_docs: int = FIT_DOCS, examples: int = EXAMPLES) -> Model:
    """Learn from about `fit_docs` documents: at most `examples` different credentials of each kind, and as many
    ordinary runs, chosen by hash. A kind with fewer than MIN_EXAMPLES has no automaton: without documents the model
    finds nothing more than the base patterns."""
    n = docs.count()
    part = F.pmod(F.xxhash64("text", F.lit("secrets")), F.lit(1_000_000)) < (1_000_000 if n <= fit_docs else -(-1_000_000 * fit_docs // n))

    pattern = re.compile(f"{RUN}{{{SHORTEST},}}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = set()
            for t in strings(b.column("text")):
                spans = base_spans(t)
                got |= {(k, t[v:e]) for _, k, e, v in spans}
                got |= {(-1, m.group()) for m in _runs(t, spans, pattern)}
            kind, token = zip(*sorted(got), strict=True) if got else ((), ())
            yield pa.RecordBatch.from_arrays([pa.array(kind, pa.int32()), pa.array(token, pa.string())], names=["kind", "token"])

    found = docs.where(part).select("text").mapInArrow(lean(run), "kind int, token string").distinct()
    # Lowest hashes: within parts of a kind first, so none is ranked whole in one task; examples * SALTS rows a kind.
    keyed = found.withColumn("h", F.xxhash64("token"))
    rank = F.row_number().over(W.partitionBy("kind", F.pmod("h", F.lit(SALTS))).orderBy("h", "token"))
    few = sorted(keyed.withColumn("n", rank).where(F.col("n") <= examples).select("kind", "h", "token").collect())
    by: dict[int, list[str]] = {}
    for r in few:
        own = by.setdefault(r.kind, [])
        if len(own) < examples:
            own.append(shape(r.token))
    pairs = Counter(s[i : i + 2] for s in by.get(-1, []) for i in range(len(s) - 1))
    left = Counter()
    for p, c in pairs.items():
        left[p[0]] += c
    plain = {p: math.log((c + 0.5) / (left[p[0]] + 5)) for p, c in pairs.items()}
    return Model({k: infer(sorted(v)) for k, v in by.items() if k >= 0 and len(v) >= MIN_EXAMPLES}, plain, math.log(0.5 / 20))


def find_secrets(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and spans (kind, start, end, base, score) of every row, ordered by start, then kind; code points, end
    exclusive. `base`: found by a pattern; others were added by the automata, with their score in nats: runs of credential
    characters that no base span touches, or their parts between / = and ., of at least as many characters as the
    shortest example of a kind. A null text is empty; repeated rows stay; an empty table gives no rows; other columns are
    not read."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("base", pa.bool_()), ("score", pa.float64())]))
    pattern = re.compile(f"{RUN}{{{model.shortest},}}") if model.automata else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, list] = {}
        for b in batches:
            out = []
            for t in strings(b.column(1)):
                spans = base_spans(t)
                got = [(s, k, e, True, None) for s, k, e, _ in spans]
                for m in _runs(t, spans, pattern) if pattern else ():
                    token = m.group()
                    if (hits := known.get(token)) is None:
                        hits = _scored(sent.value, token)
                        if len(token) <= 200:
                            if len(known) > 100_000:
                                known.clear()
                            known[token] = hits
                    got += [(m.start() + a, k, m.start() + z, False, score) for a, z, k, score in hits]
                got.sort(key=lambda x: x[:3])
                out.append([{"kind": KINDS[k], "start": s, "end": e, "base": base, "score": score} for s, k, e, base, score in got])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, kind)], names=["doc_id", "spans"])

    schema = "doc_id long, spans array<struct<kind:string,start:long,end:long,base:boolean,score:double>>"
    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(lean(run), schema)


def span_text(spans: Column) -> Column:
    """kind:start:end, joined by commas."""
    return F.concat_ws(",", F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))))
