"""Chat formatting (operator 5): transcripts to canonical turns.

A conversation is a sequence of rows, a row a sequence of lines. A hidden Markov model, whose states are the roles,
sees each line's speaker marker ("User:", "### Assistant", "<|im_start|>system", or the row's own speaker on its first
line) and line features, and Viterbi recovers the role of every line; runs of lines of one role within a row become
turns in one rendering.

Conversations of any length: rows are range-partitioned in conversation order, so a long conversation spans many
partitions. Each partition sums up its first and last conversation as a max-plus matrix; from these (as many as there
are partitions) come the scores with which each partition starts and ends, and each is decoded by itself to the path
that is best for whole conversations.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenlog.session import materialize

ROLES = ("system", "user", "assistant", "tool")
# Names of speakers.
ALIASES = {
    "system": "system", "instruction": "system", "context": "system", "developer": "system",
    "user": "user", "human": "user", "prompter": "user", "customer": "user", "question": "user", "q": "user", "you": "user",
    "assistant": "assistant", "bot": "assistant", "ai": "assistant", "gpt": "assistant", "model": "assistant", "agent": "assistant",
    "answer": "assistant", "a": "assistant", "response": "assistant",
    "tool": "tool", "function": "tool", "observation": "tool",
}
MARKER = re.compile(r"^\s*(?:<\|(?:im_start\|>)?|\[|#{1,4}\s*|\*\*)?([A-Za-z]{1,12})(?:\|>|\]|\*\*)?\s*(:|\|>|\]|$)\s*")
#: Rows (about; chosen by a hash) whose speakers are learned from.
FIT_ROWS = 50_000
#: Rows and characters that a partition holds (about).
PART_ROWS, PART_CHARS = 20_000, 16 << 20
#: Counts added to every event.
SMOOTH = 0.5
N = len(ROLES)
#: Number of values of each feature: marker, first line of its row, ends as a question, length, opening.
WIDTHS = (N + 2, 2, 2, 4, 4)


def marker(line: str) -> tuple[int, str]:
    """(role number, rest of the line); N if the line has no speaker marker."""
    m = MARKER.match(line)
    if m and m.group(1).lower() in ALIASES:
        plain = m.group(2) == "" and m.group(0).strip() == m.group(1)
        if not plain:  # a lone word is a marker only in some dress
            return ROLES.index(ALIASES[m.group(1).lower()]), line[m.end() :]
    return N, line


def features(text: str, speaker: str | None) -> tuple[np.ndarray, list[str]]:
    """Features of each line, and the lines without their markers. The marker is N if there is none and N + 1 if the
    row's speaker is no known name."""
    rows, lines = [], []
    for k, raw in enumerate(text.split("\n")):
        who, line = marker(raw)
        if who == N and k == 0 and speaker is not None:
            who = ROLES.index(ALIASES[speaker.strip().lower()]) if speaker.strip().lower() in ALIASES else N + 1
        own = line.strip()
        size = 0 if not own else 1 if len(own) <= 40 else 2 if len(own) <= 160 else 3
        start = 1 if own[:1] in "-*>|`{" and own else 2 if own[:1].isdigit() else 3 if own[:1].isupper() else 0
        rows.append((who, int(k == 0), int(own.endswith("?")), size, start))
        lines.append(line)
    return np.array(rows, dtype=np.int64), lines


class Hmm:
    """Log-probabilities: start (role), turn (role of the row before, role), line (role of the line before in the
    row, role), and emissions per feature (role, value)."""

    def __init__(self, counts: np.ndarray):
        at, parts = 0, []
        for shape in ((1, N), (N, N), *((N, w) for w in WIDTHS)):
            parts.append(counts[at : at + shape[0] * shape[1]].reshape(shape) + SMOOTH)
            at += shape[0] * shape[1]
        start, turn, *emit = (np.log(p / p.sum(1, keepdims=True)) for p in parts)
        self.start, self.turn, self.emit = start[0], turn, emit
        # A speaker seldom changes within a row unless the line says so; a marker is nearly always right.
        self.line = np.log(np.full((N, N), 0.02 / (N - 1)) + np.eye(N) * (0.98 - 0.02 / (N - 1)))
        said = np.full((N, N + 2), 1e-4)
        said[np.arange(N), np.arange(N)] = 0.9
        self.said = np.log(said)

    def emissions(self, f: np.ndarray) -> np.ndarray:
        out = self.said[:, f[:, 0]].T.copy()
        out[f[:, 0] >= N] = 0
        for k in range(1, len(WIDTHS)):
            out += self.emit[k][:, f[:, k]].T
        return out

    def row_matrix(self, e: np.ndarray) -> np.ndarray:
        """Best score of the row's lines from the first line's role (rows) to the last line's (columns)."""
        m = np.where(np.eye(N, dtype=bool), e[0][None, :], -np.inf)
        for x in e[1:]:
            m = (m[:, :, None] + self.line[None]).max(1) + x
        return m

    def path(self, e: np.ndarray, first: int, last: int) -> list[int]:
        """The best roles of a row's lines between given ends."""
        score = np.full(N, -np.inf)
        score[first] = e[0][first]
        back = []
        for x in e[1:]:
            step = score[:, None] + self.line
            back.append(step.argmax(0))
            score = step.max(0) + x
        out = [last]
        for b in reversed(back):
            out.append(int(b[out[-1]]))
        return out[::-1]


def maxplus(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a[..., :, None] + b[None]).max(-2)


def _ordered(df: DataFrame, conv: str, turn: str, role: str, text: str) -> DataFrame:
    """part, seq, conv, turn, role, text: rows in conversation order, dealt by ranges."""
    own = df.select(F.col(conv).cast("long").alias("conv"), F.col(turn).cast("long").alias("turn"), F.col(role).cast("string").alias("role"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"), F.xxhash64(F.col(text), F.col(role)).alias("h"))
    keys = ["conv", "turn", "h"]

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, at = TaskContext.get().partitionId(), 0
        for b in batches:
            n = b.num_rows
            yield pa.RecordBatch.from_arrays([pa.array([part] * n, pa.int64()), pa.array(range(at, at + n), pa.int64()), *b.columns[:4]], names=["part", "seq", "conv", "turn", "role", "text"])
            at += n

    size = own.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("c")).first()
    least = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    n = min(max(1, size.n), max(least, -(-size.n // PART_ROWS), -(-size.c // PART_CHARS)))
    dealt = own.repartitionByRange(n, *map(F.col, keys)).sortWithinPartitions(*keys)
    return materialize(dealt.mapInArrow(number, "part long, seq long, conv long, turn long, role string, text string"), "chats")


def fit(df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> Hmm:
    """A model of the rows whose role has a known name; about FIT_ROWS of them give the line features."""
    return _fit(_ordered(df, conv, turn, role, text))


def _fit(ordered: DataFrame) -> Hmm:
    # The last row of every partition, which is the one before the next partition's first.
    ends = ordered.groupBy("part").agg(F.max_by(F.struct("conv", "role"), "seq").alias("z"), F.count("*").alias("n")).collect()  # as many as partitions
    n = sum(r.n for r in ends)
    share = 1.0 if n <= FIT_ROWS else FIT_ROWS / n
    prior, last_end = {}, None
    for r in sorted(ends, key=lambda r: r.part):
        prior[r.part], last_end = last_end, (r.z.conv, r.z.role)

    def known(role: str | None) -> int | None:
        name = (role or "").strip().lower()
        return ROLES.index(ALIASES[name]) if name in ALIASES else None

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        start, turns, emit = np.zeros(N), np.zeros((N, N)), [np.zeros((N, w)) for w in WIDTHS]
        before = None  # conversation and role number of the row before; None before the first row of all
        for b in batches:
            for part, seq, conv, role, text, take in zip(*(b.column(c).to_pylist() for c in ("part", "seq", "conv", "role", "text", "take")), strict=True):
                if seq == 0:
                    before = prior[part] and (prior[part][0], known(prior[part][1]))
                k = known(role)
                if k is not None and (before is None or before[0] != conv):
                    start[k] += 1
                elif k is not None and before[1] is not None:
                    turns[before[1], k] += 1
                before = (conv, k)
                if take and k is not None:
                    f, _ = features(text, None)
                    for j, w in enumerate(WIDTHS):
                        emit[j][k] += np.bincount(f[:, j], minlength=w)
        flat = np.concatenate([start, turns.ravel(), *(e.ravel() for e in emit)])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(flat))), pa.array(flat)], names=["slot", "n"])

    take = F.pmod(F.xxhash64("text", F.lit("chat")), F.lit(1_000_000)) < int(1_000_000 * share)
    sums = ordered.select("part", "seq", "conv", "role", "text", take.alias("take")).mapInArrow(count, "slot long, n double").groupBy("slot").agg(F.sum("n").alias("n"))
    counts = np.zeros(N + N * N + N * sum(WIDTHS))
    for r in sums.collect():  # as many as the model has parameters
        counts[r.slot] = r.n
    return Hmm(counts)


def parse(df: DataFrame, model: Hmm | None = None, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """conv_id, turn, part, role, n_lines, content, rendered: the turns of every row, in order (`part` counts them
    within the row). Rows of a conversation are ordered by turn, then by a hash of text and role; those without a
    conversation id are one conversation. A null text is one empty line. `role` may be null or any name; where it
    says nothing, it is recovered. Without a model one is fitted to `df` itself. Repeated rows are repeated turns; an
    empty table has none; other columns are not read.
    """
    ordered = _ordered(df, conv, turn, role, text)
    hmm = model or _fit(ordered)
    spark = df.sparkSession

    def load(t: pa.Table) -> tuple:
        t = t.sort_by("seq")
        own = [t.column(c).to_pylist() for c in ("conv", "turn", "role", "text")]
        return own, [features(x, r) for x, r in zip(own[3], own[2], strict=True)]

    def step(first: bool, m: np.ndarray) -> np.ndarray:
        return (hmm.start[None, :] + np.zeros((N, 1)) if first else hmm.turn)[:, :, None] + m[None]

    def ends(t: pa.Table) -> pa.Table:
        own, feats = load(t)
        convs, part = own[0], t.column("part")[0].as_py()
        runs: list[list] = []
        for c, (f, _) in zip(convs, feats, strict=True):
            m = hmm.row_matrix(hmm.emissions(f))
            if not runs or runs[-1][0] != c:
                runs.append([c, m])
            else:
                runs[-1][1] = maxplus(maxplus(runs[-1][1], hmm.turn), m)
        a, z = runs[0], runs[-1]
        return pa.table({"part": [part], "one": [len(runs) == 1], "first": pa.array([a[0]], pa.int64()), "last": pa.array([z[0]], pa.int64()), "a": [a[1].ravel().tolist()], "z": [z[1].ravel().tolist()]})

    sums = ordered.groupBy("part").applyInArrow(ends, "part long, one boolean, first long, last long, a array<double>, z array<double>").collect()
    sums.sort(key=lambda r: r.part)  # as many as partitions
    before: dict[int, list[float]] = {}
    after: dict[int, list[float]] = {}
    state = None  # (conversation, scores of its roles so far)
    for r in sums:
        a, z = (np.array(x).reshape(N, N) for x in (r.a, r.z))
        if state and state[0] == r.first:
            before[r.part] = (state[1][:, None] + hmm.turn).max(0).tolist()
        head = np.array(before.get(r.part, hmm.start))
        state = (r.last, ((head if r.one else hmm.start)[:, None] + (a if r.one else z)).max(0))
    state = None
    for r in reversed(sums):
        a = np.array(r.a).reshape(N, N)
        if state and state[0] == r.last:
            after[r.part] = (hmm.turn + state[1][None, :]).max(1).tolist()
        tail = np.array(after.get(r.part, [0.0] * N)) if r.one else np.zeros(N)
        state = (r.first, (a + tail[None, :]).max(1))
    edges = spark.sparkContext.broadcast((before, after))

    def decode(t: pa.Table) -> pa.Table:
        own, feats = load(t)
        convs, part = own[0], t.column("part")[0].as_py()
        out: list[tuple] = []
        i = 0
        while i < len(convs):
            j = i
            while j < len(convs) and convs[j] == convs[i]:
                j += 1
            es = [hmm.emissions(f) for f, _ in feats[i:j]]
            ms = [hmm.row_matrix(e) for e in es]
            head = np.array(edges.value[0][part]) if i == 0 and part in edges.value[0] else hmm.start
            score, back = head[:, None] + ms[0], []
            entry = score.argmax(0)
            firsts = [entry]
            score = score.max(0)
            for m in ms[1:]:
                jump = score[:, None] + hmm.turn
                inn = jump.max(0)[:, None] + m
                firsts.append(inn.argmax(0))
                back.append(jump.argmax(0))
                score = inn.max(0)
            if j == len(convs) and part in edges.value[1]:
                score = score + np.array(edges.value[1][part])
            last = int(score.argmax())
            labels = []
            for k in range(j - i - 1, -1, -1):
                first = int(firsts[k][last])
                labels.append(hmm.path(es[k], first, last))
                if k:
                    last = int(back[k - 1][first])
            for k, path in zip(range(i, j), reversed(labels), strict=True):
                lines, at, number = feats[k][1], 0, 0
                for n in range(1, len(path) + 1):
                    if n == len(path) or path[n] != path[at]:
                        out.append((convs[k], own[1][k], number, ROLES[path[at]], n - at, "\n".join(lines[at:n]).strip()))
                        at, number = n, number + 1
            i = j
        cols = list(zip(*out, strict=True)) if out else [()] * 6
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string())
        return pa.table({n: pa.array(c, k) for n, c, k in zip(("conv_id", "turn", "part", "role", "n_lines", "content"), cols, kinds, strict=True)})

    turns = ordered.groupBy("part").applyInArrow(decode, "conv_id long, turn long, part long, role string, n_lines long, content string")
    return turns.withColumn("rendered", render(F.col("role"), F.col("content")))


def render(role: F.Column, content: F.Column) -> F.Column:
    """The canonical form of a turn; marker strings within the content are broken up, so that it can be read back."""
    safe = F.regexp_replace(content, r"<\|(im_start|im_end)\|>", "<| $1 |>")
    return F.concat(F.lit("<|im_start|>"), role, F.lit("\n"), safe, F.lit("<|im_end|>\n"))
