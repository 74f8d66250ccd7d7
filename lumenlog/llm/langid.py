"""Language identification (operator 1) of whole, possibly mixed-language texts.

A text is cut into words: runs of letters of one script. The script narrows a word's candidates to the languages that
were seen with it, each word gets a score per candidate (sum of the log-likelihoods of its character n-grams), and
Viterbi with a switching penalty labels the words, so that spans of one language come out. The prediction is the
language with most letters, its share of the letters the score.

The model is learned from (text, lang) rows alone: hashed n-gram counts per language, added up on the executors. Its
size is 3 * BUCKETS floats per language, whatever the corpus.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenlog.llm.common import lean, slices, strings

#: Buckets of hashed n-grams for each n of 1 to 3.
BITS = 14
BUCKETS = 1 << BITS
#: Labelled documents per language that the model is fitted on (about; chosen by a hash of the row).
FIT_DOCS = 2000
#: Languages a model can hold; bounds what is gathered and broadcast to about 100 MB.
MAX_LANGS = 512
#: What a change of language between two words costs, in nats.
SWITCH = 12.0
#: A language is a candidate for a script in which at least this share of its training letters is written.
MIN_SHARE = 0.01
SLICE_CHARS = 1 << 17
#: Words whose scores are held together.
HOLD_WORDS = 1 << 19

# First and last code points of scripts.
SCRIPTS = [
    ("latin", 0x0041, 0x024F), ("latin", 0x1E00, 0x1EFF), ("greek", 0x0370, 0x03FF), ("greek", 0x1F00, 0x1FFF),
    ("cyrillic", 0x0400, 0x052F), ("armenian", 0x0530, 0x058F), ("hebrew", 0x0590, 0x05FF), ("arabic", 0x0600, 0x06FF),
    ("arabic", 0x0750, 0x077F), ("devanagari", 0x0900, 0x097F), ("bengali", 0x0980, 0x09FF), ("gurmukhi", 0x0A00, 0x0A7F),
    ("gujarati", 0x0A80, 0x0AFF), ("tamil", 0x0B80, 0x0BFF), ("telugu", 0x0C00, 0x0C7F), ("kannada", 0x0C80, 0x0CFF),
    ("malayalam", 0x0D00, 0x0D7F), ("sinhala", 0x0D80, 0x0DFF), ("thai", 0x0E00, 0x0E7F), ("lao", 0x0E80, 0x0EFF),
    ("tibetan", 0x0F00, 0x0FFF), ("myanmar", 0x1000, 0x109F), ("georgian", 0x10A0, 0x10FF), ("hangul", 0x1100, 0x11FF),
    ("ethiopic", 0x1200, 0x137F), ("khmer", 0x1780, 0x17FF), ("kana", 0x3040, 0x30FF), ("han", 0x3400, 0x4DBF),
    ("han", 0x4E00, 0x9FFF), ("hangul", 0xAC00, 0xD7AF), ("han", 0x20000, 0x3134F),
]
NAMES = ["other", *dict.fromkeys(s for s, _, _ in SCRIPTS)]
_KIND: list[np.ndarray] = []


def kinds() -> np.ndarray:
    """For each code point 0 if it's no letter or mark, else 1 + the number of its script; marks are 255."""
    if not _KIND:
        k = np.zeros(0x110000, dtype=np.uint8)
        for i in range(0x110000):
            c = unicodedata.category(chr(i))[0]
            k[i] = 1 if c == "L" else 255 if c == "M" else 0
        for name, a, b in SCRIPTS:
            own = k[a : b + 1]
            own[own == 1] = 1 + NAMES.index(name)
        _KIND.append(k)
    return _KIND[0]


def lowered(text: str) -> str:
    """Lower case, character by character, so that places stay."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(x if len(x := c.lower()) == 1 else c for c in text)


@dataclass
class Words:
    """The words of some texts: where they start and end in the joined code points, their script and text."""

    points: np.ndarray
    start: np.ndarray
    end: np.ndarray
    script: np.ndarray
    text: np.ndarray
    origin: np.ndarray


def words_of(texts: list[str]) -> Words:
    low = [lowered(t) for t in texts]
    joined = " " + " ".join(low) + " "
    points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype="<u4")
    size = np.fromiter(map(len, low), dtype=np.int64, count=len(low)) + 1
    origin = np.cumsum(size) - size + 1
    kind = kinds()[points]
    marks = np.flatnonzero(kind == 255)
    if len(marks):  # a mark belongs to the letter before it
        at = np.where(kind == 255, -1, np.arange(len(kind)))
        kind = kind[np.maximum.accumulate(at)]
    edge = np.flatnonzero(np.diff(kind, prepend=0))
    end = np.append(edge[1:], len(kind))
    own = kind[edge] > 0
    start, end = edge[own], end[own]
    own = np.searchsorted(origin, start, side="right") - 1
    return Words(points, start.astype(np.int32), end.astype(np.int32), kind[start] - 1, own.astype(np.int32), origin)


def grams(w: Words) -> tuple[list[tuple[np.ndarray, np.ndarray]], np.ndarray]:
    """(bucket, word) of all n-grams for n of 1 to 3, by word, and the words' sizes. Words of 2- and 3-grams have a
    blank at either side."""
    n = len(w.points)
    size = w.end - w.start
    inside = np.repeat(w.start, size) + (np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size))
    p = np.full(n, 32, dtype=np.uint64)
    p[inside] = w.points[inside]
    before = w.start - 1
    out = []
    h = p.copy()
    for k in range(3):
        if k:
            h[:-k] = h[:-k] * np.uint64(0x9E3779B97F4A7C15) + p[k:] + np.uint64(k)
        mixed = h ^ h >> np.uint64(31)
        b = ((mixed * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(64 - BITS)).astype(np.int64) & (BUCKETS - 1)
        out.append(b)
    # Valid starts: n-gram k of word i starts in [start - (k > 0), end - k] (the closing blank is at end).
    first = np.repeat(before, size + 1) + (np.arange(int((size + 1).sum())) - np.repeat(np.cumsum(size + 1) - size - 1, size + 1))
    owner = np.repeat(np.arange(len(size)), size + 1)
    left = np.repeat(w.end, size + 1) - first  # places to the closing blank
    result = []
    for k in range(3):
        ok = (left >= k) & ((k > 0) | (first >= np.repeat(w.start, size + 1)))
        result.append((out[k][first[ok]], owner[ok]))
    return result, size


@dataclass
class Model:
    """`scores`: log-likelihood of each bucket, (3 * BUCKETS, languages); `share`: of each script (rows) in each
    language's letters; `fallback`: the language with most of them."""

    langs: list[str]
    scores: np.ndarray
    share: np.ndarray
    fallback: int

    def score(self, w: Words) -> np.ndarray:
        """(words, languages): the scores; a language that isn't a candidate for the word's script gets the
        lowest of all less the switching penalty."""
        out = np.zeros((len(w.start), len(self.langs)), dtype=np.float32)
        got, _ = grams(w)
        for k, (bucket, owner) in enumerate(got):
            if len(owner):
                rows = self.scores[k * BUCKETS + bucket]
                first = np.flatnonzero(np.diff(owner, prepend=-1))
                out[owner[first]] += np.add.reduceat(rows, first, axis=0)
        can = self.share[w.script] >= MIN_SHARE
        some = can.any(1)
        out[~some] = 0
        floor = out.min(axis=1, initial=0, keepdims=True) - 4 * SWITCH
        return np.where(can | ~some[:, None], out, floor)


def viterbi(score: np.ndarray, counts: np.ndarray, switch: float = SWITCH) -> np.ndarray:
    """The best label of each word; `counts` are the words of each text, whose paths are found side by side."""
    n_words, n_langs = score.shape
    label = np.zeros(n_words, dtype=np.int16)
    if not n_words or n_langs == 1:
        return label
    order = np.argsort(-counts, kind="stable")
    size = counts[order]
    offset = (np.cumsum(counts) - counts)[order]
    back = np.zeros((n_words, n_langs), dtype=bool)
    best = np.zeros(n_words, dtype=np.int16)
    active = np.searchsorted(-size, -np.arange(1, size[0] + 1), side="right")
    delta = score[offset[: active[0]]].astype(np.float64)
    for t in range(1, int(size[0])):
        k = active[t]
        d = delta[:k]
        top = d.argmax(1)
        jump = d[np.arange(k), top][:, None] - switch
        at = offset[:k] + t
        change = d < jump
        back[at], best[at] = change, top
        delta[:k] = np.where(change, jump, d) + score[at]
    now = delta.argmax(1)
    for t in range(int(size[0]) - 1, -1, -1):
        k = active[t]
        at = offset[:k] + t
        label[at] = now[:k]
        if t:
            now[:k] = np.where(back[at, now[:k]], best[at], now[:k])
    return label


def labelled_scores(model: Model, texts: list[str]) -> Iterator[tuple[int, int, Words, np.ndarray]]:
    """(first text, end, words, labels) of consecutive texts."""
    held, n, a = [], 0, 0
    for i, j in [*slices(texts, SLICE_CHARS), (len(texts), -1)]:
        if held and (j < 0 or n >= HOLD_WORDS):
            counts = np.concatenate([np.bincount(w.text, minlength=q - p) for p, q, w, _ in held])
            label, at = viterbi(np.concatenate([h.pop() for h in held]), counts), 0
            for p, q, w in held:
                yield p, q, w, label[at : at + len(w.start)]
                at += len(w.start)
            held, n = [], 0
        if j >= 0:
            w = words_of(texts[i:j])
            held.append([i, j, w, model.score(w)])
            w.points = w.points[:0]  # not needed any more
            n += len(w.start)


def predict_texts(model: Model, texts: list[str], spans: bool = False) -> Iterator[tuple[str, float, list | None]]:
    """(lang, score, spans) of each text; spans are (start, end, lang) in code points."""
    for i, j, w, label in labelled_scores(model, texts):
        letters = np.zeros((j - i, len(model.langs)))
        np.add.at(letters, (w.text, label), w.end - w.start)
        total, top = letters.sum(1), letters.argmax(1)
        known = np.zeros(j - i, dtype=bool)
        known[w.text[(model.share[w.script] >= MIN_SHARE).any(1)]] = True
        cut: list[list] = [[] for _ in range(j - i)]
        if spans:
            for d, a, b, k in zip(w.text.tolist(), (w.start - w.origin[w.text]).tolist(), (w.end - w.origin[w.text]).tolist(), label.tolist(), strict=True):
                if cut[d] and cut[d][-1][2] == model.langs[k]:
                    cut[d][-1] = (cut[d][-1][0], b, model.langs[k])
                else:
                    cut[d].append((a, b, model.langs[k]))
        for d in range(j - i):
            if not total[d]:
                yield "und", 0.0, []
            elif not known[d]:
                yield model.langs[model.fallback], 0.0, cut[d]
            else:
                yield model.langs[top[d]], float(letters[d, top[d]] / total[d]), cut[d]


def fit(labelled: DataFrame, fit_docs: int = FIT_DOCS) -> Model | None:
    """A model of (text, lang) rows; None if there is no row with both, as in an empty table. About `fit_docs` different
    texts of each language are read, chosen by a hash of the text; a text that a language has more than once counts
    once. Counts are added up before anything is gathered."""
    rows = labelled.select("text", F.col("lang").cast("string").alias("lang")).where("text is not null and lang is not null")
    rows = rows.withColumn("h", F.xxhash64("text", F.lit("fit")))
    sizes = {r.lang: r.n for r in rows.groupBy("lang").agg(F.approx_count_distinct("h", 0.02).alias("n")).limit(MAX_LANGS + 1).collect()}
    if len(sizes) > MAX_LANGS:
        raise ValueError(f"more than {MAX_LANGS} languages")
    if not sizes:
        return None
    langs = sorted(sizes)
    part = F.pmod("h", F.lit(1_000_000))
    share = F.create_map(*[x for k in langs for x in (F.lit(k), F.lit(min(1_000_000, -(-1_000_000 * fit_docs // max(1, sizes[k])))))])
    chosen = rows.where(part < share[F.col("lang")]).groupBy("lang", "h").agg(F.first("text").alias("text")).select("text", "lang")
    width = len(NAMES)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for b in batches:
            texts, own = strings(b.column("text")), b.column("lang").to_pylist()
            for lang in set(own):
                mine = [t for t, x in zip(texts, own, strict=True) if x == lang]
                acc = total.setdefault(lang, np.zeros(3 * BUCKETS + width, dtype=np.int64))
                for i, j in slices(mine, SLICE_CHARS):
                    w = words_of(mine[i:j])
                    got, size = grams(w)
                    for k, (bucket, _) in enumerate(got):
                        acc[k * BUCKETS : (k + 1) * BUCKETS] += np.bincount(bucket, minlength=BUCKETS)
                    acc[3 * BUCKETS :] += np.bincount(w.script, weights=size, minlength=width).astype(np.int64)
        for lang, acc in total.items():
            at = np.flatnonzero(acc)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at)), pa.array(at), pa.array(acc[at])], names=["lang", "slot", "n"])

    sums = chosen.mapInArrow(lean(count), "lang string, slot long, n long").groupBy("lang", "slot").agg(F.sum("n").alias("n"))
    sums = sums.groupBy("lang").agg(F.collect_list(F.struct("slot", "n")).alias("v"))
    table = np.zeros((3 * BUCKETS + width, len(langs)))
    for r in sums.toLocalIterator():  # 3 * BUCKETS + scripts numbers a language at most
        for x in r.v:
            table[x.slot, langs.index(r.lang)] = x.n
    scores = np.zeros((3 * BUCKETS, len(langs)), dtype=np.float32)
    for k in range(3):
        own = table[k * BUCKETS : (k + 1) * BUCKETS]
        scores[k * BUCKETS : (k + 1) * BUCKETS] = np.log((own + 0.5) / (own.sum(0) + 0.5 * BUCKETS))
    letters = table[3 * BUCKETS :]
    return Model(langs, scores, letters / np.maximum(letters.sum(0), 1), int(letters.sum(0).argmax()))


def identify(docs: DataFrame, model: Model | None, spans: bool = False) -> DataFrame:
    """`docs` with lang_pred, score and, if asked for, spans (start, end, lang; in code points); columns of these
    names are replaced. A text that is null or has no letter is `und` with score 0; one with letters of scripts only
    that no language was seen in gets the language with most training letters and score 0; so does, as `und`, every
    text without a model. Every row is judged by itself: repeated rows get the same, an empty table gives no rows."""
    rest = [c for c in docs.columns if c not in ("lang_pred", "score", "spans")]
    name = {c: f"c{i}" for i, c in enumerate(rest)}
    base = docs.select(*[F.col(f"`{c}`").alias(n) for c, n in name.items()])
    fields = [f"{f.name} {f.dataType.simpleString()}" for f in base.schema]
    at = rest.index("text")
    sent = base.sparkSession.sparkContext.broadcast(model)
    extra = ", spans array<struct<start:long,end:long,lang:string>>" if spans else ""
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("lang", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = strings(b.column(at))
            got = list(predict_texts(sent.value, texts, spans)) if sent.value else [("und", 0.0, [])] * len(texts)
            cols = [*b.columns, pa.array([x[0] for x in got], pa.string()), pa.array([x[1] for x in got], pa.float64())]
            if spans:
                cols.append(pa.array([[{"start": s, "end": e, "lang": x} for s, e, x in g[2]] for g in got], kind))
            yield pa.RecordBatch.from_arrays(cols, names=[*name.values(), "lang_pred", "score", *(["spans"] if spans else [])])

    out = base.mapInArrow(lean(run), ", ".join([*fields, "lang_pred string", "score double"]) + extra)
    return out.select(*[F.col(n).alias(c) for c, n in name.items()], "lang_pred", "score", *(["spans"] if spans else []))


def held_out(doc_id: str = "doc_id") -> F.Column:
    """Whether the row is kept from learning: crc32 of the id's text is divisible by 5 (a null id: of no text)."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % 5 == 0


def language_id(docs: DataFrame, spans: bool = False) -> DataFrame:
    """`docs` with lang_pred, score and spans by a model of its own rows that aren't held out."""
    return identify(docs, fit(docs.where(~held_out())), spans)
