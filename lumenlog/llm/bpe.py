"""BPE encoding and decoding (operator 6) with a word-level BPE vocabulary file.

The ids are those of the `tokenizers` library for the same file. A text is normalised and split into pretokens,
and each distinct pretoken is merged once per cache life, for thousands of them together in numpy.

Tree concatenation encodes what is long. A text longer than `piece_chars` is cut anywhere, in the middle of a word
too; its pieces are encoded by many tasks, each as if it were the whole text, and then joined pairwise: a window of
characters around the seam is re-encoded and grown until it starts and ends at a blank and what it holds of either
side is encoded as that side has it (`WordBpe.join_texts`). Within one pretoken of over `LEAF` bytes there are no
blanks: there the leaves are joined by windows of tokens, grown until the first and last tokens agree with the tokens
already there and the pairs at both ends are stable (`WordBpe.join`).
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from collections.abc import Iterator
from itertools import compress
from operator import not_

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenlog.llm.common import held, lean, slices, strings

#: Pretokens of more bytes than this are encoded as a tree of leaves of at most this many bytes.
LEAF = 512
#: Characters encoded together; bounds the memory of a task.
SLICE_CHARS = 1 << 19
#: Pretokens kept with their ids; the cache is emptied when full.
CACHE = 200_000
#: Characters at either side of a seam that are re-encoded first, and beyond which a seam within one pretoken is joined by tokens.
WINDOW, UNSPLIT = 64, 2048
_NONE = np.int32(2**31 - 1)


def _byte_chars() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    keep = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out, extra = [], 0
    for b in range(256):
        if b in keep:
            out.append(chr(b))
        else:
            out.append(chr(256 + extra))
            extra += 1
    return out


def _plain_pattern(limit: int) -> re.Pattern:
    """The vocabulary's split pattern for texts whose characters are all below `limit`."""
    kind = {"L": "", "N": ""}
    for i in range(limit):
        k = unicodedata.category(chr(i))[0]
        if k in kind:
            kind[k] += re.escape(chr(i))
    blank = "\t\n\x0b\x0c\r \x85\xa0"
    return re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{kind['L']}]+|[{kind['N']}]|[^{blank}{kind['L']}{kind['N']}]+")


class WordBpe:
    """Encoder and decoder for one vocabulary file whose model is BPE with an end-of-word suffix over bytes."""

    #: Below this code point NFC changes nothing and lower-casing is by single characters.
    PLAIN = 0x250

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, self.suffix = spec["model"], spec["model"]["end_of_word_suffix"]
        vocab: dict[str, int] = model["vocab"]
        self.size = max([*vocab.values(), *(a["id"] for a in spec["added_tokens"])]) + 1
        self.texts = [""] * self.size
        for t, i in vocab.items():
            self.texts[i] = t
        self.added = {a["content"]: a["id"] for a in spec["added_tokens"]}
        for t, i in self.added.items():
            self.texts[i] = t
        self.split_added = re.compile("|".join(f"({re.escape(t)})" for t in self.added)) if self.added else None
        whole = Tokenizer.from_file(path)
        self.normalizer, self.pre = whole.normalizer, whole.pre_tokenizer
        chars = _byte_chars()
        self.byte_of = {c: b for b, c in enumerate(chars)}
        self.first = np.array([vocab[c] for c in chars] + [vocab[c + self.suffix] for c in chars], dtype=np.int32)
        self._pairs(vocab, model["merges"])
        self.pattern = _plain_pattern(self.PLAIN)
        self.beyond = re.compile(f"[^\x00-{chr(self.PLAIN - 1)}]")
        self.fixed = {i: i.to_bytes(4, "little") for i in self.added.values()}
        self.known: dict[str | int, bytes] = dict(self.fixed)
        self.limit = CACHE

    def _pairs(self, vocab: dict[str, int], merges: list) -> None:
        """An open-addressing table from a pair of ids to the rank of its merge and the id it makes."""
        left, right = (np.array([vocab[m[k]] for m in merges], dtype=np.int64) for k in (0, 1))
        made = np.array([vocab[m[0] + m[1]] for m in merges], dtype=np.int32)
        self.mask = (1 << max(4, (8 * len(merges) - 1).bit_length())) - 1
        self.keys = np.full(self.mask + 1, -1, dtype=np.int64)
        self.ranks = np.full(self.mask + 1, _NONE, dtype=np.int32)
        self.makes = np.zeros(self.mask + 1, dtype=np.int32)
        rank, self.probes = np.arange(len(merges), dtype=np.int32), 0
        keys = left << 32 | right
        at = self._slot(left, right)
        while len(keys):
            free = self.keys[at] == -1
            _, one = np.unique(at[free], return_index=True)
            put = np.flatnonzero(free)[one]
            self.keys[at[put]], self.ranks[at[put]], self.makes[at[put]] = keys[put], rank[put], made[put]
            rest = np.ones(len(keys), dtype=bool)
            rest[put] = False
            keys, rank, made, at = keys[rest], rank[rest], made[rest], (at[rest] + 1) & self.mask
            self.probes += 1

    def _slot(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        h = left.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + right.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)
        return ((h ^ h >> np.uint64(29)) & np.uint64(self.mask)).astype(np.int64)

    def _rank(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and made id of each pair; the largest rank where the pair has no merge."""
        key, at = left.astype(np.int64) << 32 | right.astype(np.int64), self._slot(left, right)
        got = self.keys[at]
        rank, made = np.where(got == key, self.ranks[at], _NONE), self.makes[at]
        open_ = np.flatnonzero((got != key) & (got != -1))
        for _ in range(self.probes - 1):
            if not len(open_):
                break
            at[open_] = (at[open_] + 1) & self.mask
            got = self.keys[at[open_]]
            hit = got == key[open_]
            rank[open_[hit]], made[open_[hit]] = self.ranks[at[open_[hit]]], self.makes[at[open_[hit]]]
            open_ = open_[~hit & (got != -1)]
        return rank, made

    def _merge_rows(self, ids: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Apply merges to every row of the padded id matrix, lowest rank first and leftmost among equals."""
        rows, width = ids.shape
        rank = np.full((rows, max(1, width - 1)), _NONE, dtype=np.int32)
        made = np.zeros_like(rank)
        if width > 1:
            r, c = np.nonzero(np.arange(width - 1) < (n - 1)[:, None])
            rank[r, c], made[r, c] = self._rank(ids[r, c], ids[r, c + 1])
        live, out_ids, out_n = np.arange(rows), ids.copy(), n.copy()
        while len(live) and width > 1:
            p = rank.argmin(1)
            go = rank[np.arange(len(live)), p] != _NONE
            if not go.all():
                out_ids[live[~go], :width], out_n[live[~go]] = ids[~go], n[~go]
                live, ids, n, rank, made, p = live[go], ids[go], n[go], rank[go], made[go], p[go]
                if not len(live):
                    break
            k = np.arange(len(live))
            new = made[k, p]
            cols = np.arange(width)
            take = np.minimum(cols + (cols > p[:, None]), width - 1)
            ids = np.take_along_axis(ids, take, 1)
            ids[k, p] = new
            n = n - 1
            edge = np.arange(width - 1)
            take = np.minimum(edge + (edge > p[:, None]), width - 2)
            rank, made = np.take_along_axis(rank, take, 1), np.take_along_axis(made, take, 1)
            for q in (p - 1, p):
                ok = (q >= 0) & (q < n - 1)
                if ok.any():
                    i, j = k[ok], q[ok]
                    rank[i, j], made[i, j] = self._rank(ids[i, j], ids[i, j + 1])
            over = edge >= (n - 1)[:, None]
            rank[over] = _NONE
        out_ids[live, :width], out_n[live] = ids, n
        return out_ids, out_n

    def merged(self, words: list[bytes], ended: bool = True) -> Iterator[tuple[list[int], np.ndarray, list[int]]]:
        """Groups of words of like size: their numbers, their ids one after the other, and how many each has.
        `ended`: a word's last byte carries the end-of-word suffix."""
        size = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        order = np.argsort(size, kind="stable")
        grown = size[order]
        at = 0
        while at < len(order):
            width = max(1, int(grown[at]))
            to = int(np.searchsorted(grown, width + max(2, width // 4), side="right"))
            to = min(max(to, at + 1), at + max(1, (1 << 20) // width))
            part = order[at:to].tolist()
            n = grown[at:to]
            width = max(1, int(n[-1]))
            flat = np.frombuffer(b"".join([words[i] for i in part]), dtype=np.uint8)
            ids = np.zeros((len(part), width), dtype=np.int32)
            cols = np.arange(width)
            ids[cols < n[:, None]] = self.first[flat]
            if ended:
                has = np.flatnonzero(n)
                last = np.cumsum(n)[has] - 1
                ids[has, n[has] - 1] = self.first[256 + flat[last].astype(np.int64)]
            ids, n = self._merge_rows(ids, n)
            yield part, ids[cols < n[:, None]], n.tolist()
            at = to

    def merge(self, words: list[bytes], ended: bool = True) -> list[np.ndarray]:
        """Ids of each byte string."""
        out: list = [None] * len(words)
        for part, ids, n in self.merged(words, ended):
            for i, x in zip(part, np.split(ids, np.cumsum(n)[:-1]), strict=True):
                out[i] = x
        return out

    # Tree concatenation of one long pretoken.

    def leaves(self, word: bytes, leaf: int = LEAF) -> list[bytes]:
        return [word[i : i + leaf] for i in range(0, len(word), leaf)]

    def _bytes(self, i: int) -> bytes:
        t = self.texts[i]
        return bytes(self.byte_of[c] for c in (t.removesuffix(self.suffix) if len(t) > len(self.suffix) else t))

    def _stable(self, a: int, b: int) -> bool:
        """Whether the pair's own text is encoded as just this pair."""
        ended = self.texts[b].endswith(self.suffix) and len(self.texts[b]) > len(self.suffix)
        return self.merge([self._bytes(a) + self._bytes(b)], ended)[0].tolist() == [a, b]

    def join(self, left: np.ndarray, right: np.ndarray, last: bool, most: int | None = None) -> np.ndarray | None:
        """The ids of the joined text: re-encode a window of tokens around the seam, doubled until it starts and
        ends with two tokens of either side unchanged (or reaches that side's end) and its outer pairs are stable.
        None if that takes more than `most` bytes of a side."""
        if not len(left) or not len(right):
            return np.concatenate([left, right])
        w = 8
        while True:
            a, b = max(0, len(left) - w), min(len(right), w)
            before, after = (b"".join(map(self._bytes, v.tolist())) for v in (left[max(0, a - 1) :], right[: b + 1]))
            if most is not None and max(len(before), len(after)) >= most:
                return None
            text = b"".join(map(self._bytes, [*left[a:].tolist(), *right[:b].tolist()]))
            mid = self.merge([text], ended=last and b == len(right))[0]
            left_ok = a == 0 or len(mid) > 2 and (mid[:2] == left[a : a + 2]).all() and self._stable(int(left[a - 1]), int(mid[0]))
            right_ok = b == len(right) or len(mid) > 2 and (mid[-2:] == right[b - 2 : b]).all() and self._stable(int(mid[-1]), int(right[b]))
            if left_ok and right_ok:
                return np.concatenate([left[:a], mid, right[b:]])
            w *= 2

    def tree(self, parts: list[np.ndarray], last: bool = True) -> np.ndarray:
        """Join neighbouring halves level by level; `last`: the end of the parts is the end of the word."""
        while len(parts) > 1:
            pairs = range(0, len(parts) - 1, 2)
            odd = parts[-1:] if len(parts) % 2 else []
            parts = [self.join(parts[i], parts[i + 1], last and i + 2 == len(parts)) for i in pairs] + odd
        return parts[0]

    def encode_long(self, word: bytes, leaf: int = LEAF) -> np.ndarray:
        parts = self.leaves(word, leaf)
        return self.tree(self.merge(parts[:-1], ended=False) + self.merge(parts[-1:]))

    # Tree concatenation of a long text.

    def join_texts(self, left: tuple[str, np.ndarray], right: tuple[str, np.ndarray]) -> tuple[str, np.ndarray]:
        """The text and ids of two neighbouring pieces of a text, each encoded as if it were a text of its own."""
        (a, x), (b, y) = left, right
        if not a or not b:
            return a + b, np.concatenate([x, y])
        w = WINDOW
        while True:
            own, other = a[-w:], b[:w]
            # What is left of the first blank and right of the last is not looked at, unless the piece ends there.
            if w < len(a):
                own = own[1 + min((k for c in " \n" if (k := own.find(c)) >= 0), default=len(own)) :]
            if w < len(b):
                other = other[: max(other.rfind(c) for c in " \n") + 1]
            if (own or w >= len(a)) and (other or w >= len(b)):
                old = [np.frombuffer(i, dtype="<u4").astype(np.int32) for i in self.encode([own, other])]
                m, n = map(len, old)
                if (x[len(x) - m :] == old[0]).all() and (y[:n] == old[1]).all():
                    mid = np.frombuffer(next(self.encode([own + other])), dtype="<u4").astype(np.int32)
                    return a + b, np.concatenate([x[: len(x) - m], mid, y[n:]])
            elif w >= UNSPLIT and (ids := self._join_unsplit(a[-w:], x, b[:w], y)) is not None:
                return a + b, ids
            w *= 2

    def _join_unsplit(self, own: str, x: np.ndarray, other: str, y: np.ndarray) -> np.ndarray | None:
        """The ids of two pieces whose ends `own` and `other` are parts of one pretoken; None if they aren't, or if a
        window of tokens would reach beyond them."""
        both, left, right = self.split(own + other), self.split(own), self.split(other)
        if not len(both) == len(left) == len(right) == 1 or isinstance(both[0], int) or both[0] != left[0] + right[0]:
            return None
        return self.join(x, y, True, min(len(left[0].encode()), len(right[0].encode())))

    def tree_texts(self, parts: list[tuple[str, np.ndarray]]) -> np.ndarray:
        """The ids of a text from those of its pieces: neighbouring halves are joined level by level."""
        while len(parts) > 1:
            odd = parts[-1:] if len(parts) % 2 else []
            parts = [self.join_texts(parts[i], parts[i + 1]) for i in range(0, len(parts) - 1, 2)] + odd
        return parts[0][1]

    # Texts.

    def split(self, text: str) -> list[str | int]:
        """Normalised pretokens, and ids of added tokens, in order."""
        if "<|" in text and self.split_added and (parts := self.split_added.split(text))[1:]:
            out: list[str | int] = []
            for p in parts:
                if p in self.added:
                    out.append(self.added[p])
                elif p:
                    out.extend(self.split(p))
            return out
        if text.isascii() or not self.beyond.search(text):
            return self.pattern.findall(text.lower())
        out = []
        for chunk in text.replace("\n", " ").split(" "):
            if chunk.isascii() or not self.beyond.search(chunk):
                out.extend(self.pattern.findall(chunk.lower()))
            else:
                norm = self.normalizer.normalize_str(chunk)
                out.extend(bytes(map(self.byte_of.__getitem__, p)).decode() for p, _ in self.pre.pre_tokenize_str(norm))
        return out

    def _learn(self, new: list[str | int]) -> None:
        words = [w.encode() for w in new]
        if max(map(len, words), default=0) > LEAF:
            for w, p in zip(words, new, strict=True):
                if len(w) > LEAF:
                    self.known[p] = self.encode_long(w).astype("<u4").tobytes()
            new = [p for w, p in zip(words, new, strict=True) if len(w) <= LEAF]
            words = [w for w in words if len(w) <= LEAF]
        known = self.known
        for part, ids, sizes in self.merged(words):
            data, at = ids.astype("<u4").tobytes(), 0
            for i, n in zip(part, sizes, strict=True):
                to = at + 4 * n
                known[new[i]] = data[at:to]
                at = to

    def encode(self, texts: list[str]) -> Iterator[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers."""
        for a, b in slices(texts, SLICE_CHARS):
            split = [self.split(t) for t in texts[a:b]]
            known = self.known
            if len(known) > self.limit:  # what this slice needs stays
                known = self.known = self.fixed | {p: known[p] for p in set().union(*split) if p in known}
            found = [list(map(known.get, s)) for s in split]
            gaps = [list(compress(range(len(v)), map(not_, v))) if None in v else () for v in found]
            self._learn(list({s[i] for s, g in zip(split, gaps, strict=True) for i in g}))
            for s, v, g in zip(split, found, gaps, strict=True):
                for i in g:
                    v[i] = known[s[i]]
                yield b"".join(v)

    def decode(self, ids: bytes) -> str:
        """The token texts joined by blanks, which is what a file without a decoder gives."""
        return " ".join(map(self.texts.__getitem__, np.frombuffer(ids, dtype="<u4").tolist()))


_LOADED: dict[str, WordBpe] = held("bpe")


def load(path: str) -> WordBpe:
    """One encoder per Python worker and file."""
    if path not in _LOADED:
        _LOADED[path] = WordBpe(path)
    return _LOADED[path]


def encode_texts(df: DataFrame, path: str, text: str = "text", ids: str = "ids", piece_chars: int = 1 << 16, joins: str | None = None) -> DataFrame:
    """`df` without `text` and with a binary column `ids`: the ids as little-endian unsigned 32-bit integers.

    A null or empty text has no ids; an empty table gives no rows. Rows are kept as they are, repeated rows too; a
    column of `df` that is already called `ids` is replaced. Texts of more than `piece_chars` characters are cut into
    pieces of that size, wherever that is, which are encoded in parallel and joined per text; all others never leave
    their partition. `joins` names a column for the number of seams that were joined.
    """
    other = [c for c in df.columns if c not in (text, ids, joins)]
    name = {c: f"c{i}" for i, c in enumerate(other)}
    base = df.select(*[F.col(f"`{c}`").alias(n) for c, n in name.items()], F.col(f"`{text}`").alias("t"))
    small = F.length(F.coalesce(F.col("t"), F.lit(""))) <= piece_chars
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in base.schema if f.name != "t")
    fields = f"{fields}, " if fields else ""

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path)
        for b in batches:
            for i, j in _runs(b.column(b.num_columns - 1)):
                part = b.slice(i, j - i)
                got = pa.array(list(bpe.encode(strings(part.column(b.num_columns - 1)))), pa.binary())
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], got, pa.array(np.zeros(j - i, dtype=np.int64))], names=[*b.schema.names[:-1], "ids", "joins"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(b.num_rows):
                row, t = b.slice(k, 1), b.column(b.num_columns - 1)[k].as_py()
                for seq, at in enumerate(range(0, len(t), piece_chars)):
                    yield pa.RecordBatch.from_arrays([*row.columns[:-1], pa.array([seq], pa.int64()), pa.array([t[at : at + piece_chars]], pa.string())], names=[*b.schema.names[:-1], "seq", "piece"])

    def piece(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path)
        for b in batches:
            got = pa.array(list(bpe.encode(b.column("piece").to_pylist())), pa.binary())
            yield pa.RecordBatch.from_arrays([*b.columns, got], names=[*b.schema.names, "data"])

    def glue(t: pa.Table) -> pa.Table:
        bpe, t = load(path), t.sort_by("seq")
        parts = [(p, np.frombuffer(d, dtype="<u4").astype(np.int32)) for p, d in zip(t.column("piece").to_pylist(), t.column("data").to_pylist(), strict=True)]
        out, keep = bpe.tree_texts(parts).astype("<u4").tobytes(), t.slice(0, 1).select(list(name.values()))
        return keep.append_column("ids", pa.array([out], pa.binary())).append_column("joins", pa.array([t.num_rows - 1], pa.int64()))

    short = base.where(small).mapInArrow(lean(whole, "bpe"), f"{fields}ids binary, joins long")
    long = base.where(~small).withColumn("t_uid", F.monotonically_increasing_id())
    long = long.select(*name.values(), "t_uid", "t")
    pieces = long.mapInArrow(lean(cut, "bpe"), f"{fields}t_uid long, seq long, piece string")
    n = max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    done = pieces.repartition(n, "t_uid", "seq").mapInArrow(lean(piece, "bpe"), f"{fields}t_uid long, seq long, piece string, data binary")
    long = done.groupBy("t_uid").applyInArrow(glue, f"{fields}ids binary, joins long")
    out = short.unionByName(long)
    return out.select(*[F.col(n).alias(c) for c, n in name.items()], F.col("ids").alias(ids), *([F.col("joins").alias(joins)] if joins else []))


def _runs(texts: pa.Array) -> Iterator[tuple[int, int]]:
    """Consecutive ranges of texts of about SLICE_CHARS bytes."""
    end = np.cumsum(np.nan_to_num(pc.binary_length(texts).to_numpy(zero_copy_only=False)).astype(np.int64))
    at = 0
    while at < len(end):
        to = int(np.searchsorted(end, (end[at - 1] if at else 0) + SLICE_CHARS)) + 1
        yield at, min(to, len(end))
        at = min(to, len(end))


def decode_ids(df: DataFrame, path: str, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """`df` with `text` added: the decoded ids, special tokens included; null ids give the empty text."""

    @F.pandas_udf("string")
    def dec(s):
        bpe = load(path)
        return s.map(lambda x: bpe.decode(bytes(x or b"")))

    return df.withColumn(text, dec(F.col(f"`{ids}`")))


def digest(df: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of rows with doc_id and ids; decodes within the same batch."""
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path)
        for b in batches:
            ids = [bytes(x or b"") for x in b.column("ids").to_pylist()]
            cols = [b.column("doc_id"), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array([hashlib.sha256(x).hexdigest() for x in ids]), pa.array([hashlib.sha256(bpe.decode(x).encode()).hexdigest() for x in ids])]
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return df.select("doc_id", "ids").mapInArrow(lean(run, "bpe"), schema)
