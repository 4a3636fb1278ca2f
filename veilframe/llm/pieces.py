"""Subword encoding and decoding by vectorised merge rounds (operator 7).

A piece model (BPE with byte fallback, identity normaliser) is read from its file. The distinct words of a batch lie
in one flat array of symbol ids. Each round takes the segmented minimum of the pair ranks per word, merges the
occurrences of that rank from the left, compacts the array, and looks up only the pairs that changed, until no word
has a pair left. Words never influence one another, because no piece of the model has a word mark after another
character; models that do are refused.

A merge may make a pair that ranks as early as the one just merged (the runs of spaces do). Such ranks are found from the
model when it is loaded; for them a round merges only the leftmost occurrence, which is what a queue would do.
"""

from __future__ import annotations

import functools
import hashlib
import re
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from veilframe.llm._shared import byte_slices, lean

MARK = "▁"
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
NO_PAIR = np.iinfo(np.int32).max


def _fields(data: bytes) -> Iterator[tuple[int, object]]:
    """The fields of one protocol-buffer message: (number, int or bytes)."""

    def varint(at: int) -> tuple[int, int]:
        value = shift = 0
        while True:
            b = data[at]
            at += 1
            value |= (b & 127) << shift
            shift += 7
            if b < 128:
                return value, at

    at = 0
    while at < len(data):
        key, at = varint(at)
        kind = key & 7
        if kind == 0:
            value, at = varint(at)
        elif kind == 1:
            value, at = data[at : at + 8], at + 8
        elif kind == 5:
            value, at = data[at : at + 4], at + 4
        elif kind == 2:
            n, at = varint(at)
            value, at = data[at : at + n], at + n
        else:
            raise ValueError(f"not a piece model: wire type {kind}")
        yield key >> 3, value


class PieceModel:
    """A BPE piece model: pieces, the table of pairs, and which ranks must be merged one at a time."""

    def __init__(self, data: bytes):
        self.pieces: list[str] = []
        self.kinds: list[int] = []
        scores: list[float] = []
        self.dummy_prefix, kind_of_model = True, 1
        for number, value in _fields(data):
            if number == 1:
                one = dict(_fields(value))
                self.pieces.append(one[1].decode())
                scores.append(struct.unpack("<f", one[2])[0] if 2 in one else 0.0)
                self.kinds.append(one.get(3, NORMAL))
            elif number == 2:
                kind_of_model = dict(_fields(value)).get(3, 1)
            elif number == 3:
                spec = dict(_fields(value))
                self.dummy_prefix = bool(spec.get(3, 1))
                if spec.get(2) or spec.get(4, 1) or not spec.get(5, 1):
                    raise ValueError("only identity normalisation with escaped white space is supported")
        if kind_of_model != 2 or any(k in (USER, UNUSED) for k in self.kinds):
            raise ValueError("only plain BPE models are supported")
        normal = {p: i for i, (p, k) in enumerate(zip(self.pieces, self.kinds)) if k == NORMAL}
        if any(re.search(f"[^{MARK}]{MARK}", p) for p in normal):
            raise ValueError("pieces that span words are not supported")
        self.bytes_ = np.full(256, -1, np.int64)
        for i, (p, k) in enumerate(zip(self.pieces, self.kinds)):
            if k == BYTE:
                self.bytes_[int(p[3:5], 16)] = i
        self.unknown = self.kinds.index(UNKNOWN)
        # Symbols: ids of pieces, then one more for each character that only occurs inside pieces.
        self.symbol = dict(normal)
        for c in sorted({c for p in normal for c in p} - set(normal)):
            self.symbol[c] = len(self.pieces) + len(self.symbol)
        ranks = {s: r for r, s in enumerate(sorted({scores[i] for i in normal.values()}, reverse=True))}
        keys, made = [], []
        for p, i in normal.items():
            for cut in range(1, len(p)):
                left, right = self.symbol.get(p[:cut]), self.symbol.get(p[cut:])
                if left is not None and right is not None:
                    keys.append(left << 24 | right)
                    made.append(i)
        self.pair_key, self.pair_made = np.array(keys, np.int64), np.array(made, np.int32)
        rank_of = np.full(len(self.pieces), NO_PAIR, np.int32)
        for i in normal.values():
            rank_of[i] = ranks[scores[i]]
        self.pair_rank = rank_of[self.pair_made]
        # A rank is safe if no pair with its result on either side comes as early.
        self.safe = np.ones(len(ranks) + 1, bool)
        for side in (self.pair_key >> 24, self.pair_key & 0xFFFFFF):
            inner = side < len(self.pieces)
            own = rank_of[np.where(inner, side, 0)]
            early = inner & (own != NO_PAIR) & (self.pair_rank <= own)
            self.safe[own[early]] = False
        self._index()
        self.code_symbol = -1 - np.arange(0x110000, dtype=np.int32)
        for c, i in self.symbol.items():
            if len(c) == 1:
                self.code_symbol[ord(c)] = i
        self._char: dict[int, list[int]] = {}
        self.digits = [str(i) for i in range(len(self.pieces))]
        self.plain = [p.replace(MARK, " ") if k == NORMAL else None for p, k in zip(self.pieces, self.kinds)]
        self.known: dict[str, tuple[str, str]] = {}

    @classmethod
    @functools.lru_cache(maxsize=4)
    def of(cls, data: bytes) -> PieceModel:
        """The model of a file's bytes; a Python worker builds it once for all its tasks."""
        return cls(data)

    @classmethod
    def load(cls, path: str) -> PieceModel:
        with open(path, "rb") as f:
            return cls.of(f.read())

    def _index(self, bits: int = 20) -> None:
        """A hash table of the pairs with linear probing; the probes of the longest chain are counted."""
        mult = np.uint64(0x9E3779B97F4A7C15)
        self._shift, self._mult = np.uint64(64 - bits), mult
        self.slot = np.full((1 << bits) + 64, -1, np.int32)
        home = ((self.pair_key.astype(np.uint64) * mult) >> self._shift).astype(np.int64)
        rest, self.probes = np.arange(len(home)), 0
        while len(rest):
            at = home[rest] + self.probes
            free = self.slot[at] < 0
            self.slot[at[free][::-1]] = rest[free][::-1]
            rest = rest[self.slot[at] != rest]
            self.probes += 1
        filled = self.slot >= 0
        self.slot_key = np.where(filled, self.pair_key[self.slot], -1)
        self.slot_made = np.where(filled, self.pair_made[self.slot], -1).astype(np.int32)
        self.slot_rank = np.where(filled, self.pair_rank[self.slot], NO_PAIR).astype(np.int32)

    def _lookup(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and result of each pair of symbols; NO_PAIR where the model has none."""
        key = left.astype(np.int64) << 24 | right
        key[(left < 0) | (right < 0)] = -2
        home = ((key.view(np.uint64) * self._mult) >> self._shift).astype(np.int64)
        at = home.copy()
        open_ = np.flatnonzero(self.slot_key[home] != key)
        for probe in range(1, self.probes):
            if not len(open_):
                break
            at[open_] = home[open_] + probe
            open_ = open_[self.slot_key[at[open_]] != key[open_]]
        rank, made = self.slot_rank[at], self.slot_made[at]
        rank[open_] = NO_PAIR
        return rank, made

    def merge_words(self, words: list[str], block: int = 16_384) -> list[list[int]]:
        """Piece ids of each word, by merge rounds over a block of words at once."""
        out: list[list[int]] = []
        for at in range(0, len(words), block):
            out += self._merge(words[at : at + block])
        return out

    def _merge(self, words: list[str]) -> list[list[int]]:
        codes = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
        sym = self.code_symbol[codes]
        word = np.repeat(np.arange(len(words), dtype=np.int32), np.fromiter(map(len, words), np.int64, len(words)))
        done_sym, done_word = [], []
        rank = np.full(len(sym), NO_PAIR, np.int32)
        made = np.full(len(sym), -1, np.int32)
        if len(sym) > 1:
            rank[:-1], made[:-1] = self._lookup(sym[:-1], sym[1:])
            rank[:-1][word[1:] != word[:-1]] = NO_PAIR
        while len(sym):
            starts = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
            least = np.minimum.reduceat(rank, starts)
            low = np.repeat(least, np.diff(np.r_[starts, len(sym)]))
            if least.max() == NO_PAIR:
                over = low == NO_PAIR
                done_sym.append(sym[over])
                done_word.append(word[over])
                if len(done_sym[-1]) == len(sym):
                    break
                sym, word, rank, made, low = (x[~over] for x in (sym, word, rank, made, low))
            at = np.flatnonzero(rank == low)
            gap = at[1:] != at[:-1] + 1
            if not gap.all():  # of occurrences that overlap, every other one from the left
                order = np.arange(len(at))
                run = np.maximum.accumulate(np.where(np.r_[True, gap], order, 0))
                at = at[(order - run) % 2 == 0]
            at = at[np.r_[True, word[at[1:]] != word[at[:-1]]] | self.safe[rank[at]]]
            sym[at] = made[at]
            keep = np.ones(len(sym), bool)
            keep[at + 1] = False
            at -= np.arange(len(at))  # where the merged symbols are after compaction
            sym, word, rank, made = sym[keep], word[keep], rank[keep], made[keep]
            fresh = np.concatenate([at, at[at > 0] - 1])
            rank[-1] = NO_PAIR
            fresh = fresh[fresh < len(sym) - 1]
            new, made[fresh] = self._lookup(sym[fresh], sym[fresh + 1])
            new[word[fresh] != word[fresh + 1]] = NO_PAIR
            rank[fresh] = new
        if not done_sym:
            return [[] for _ in words]
        sym, word = np.concatenate(done_sym), np.concatenate(done_word)
        order = np.argsort(word, kind="stable")
        sym = sym[order]
        bounds = np.searchsorted(word[order], np.arange(len(words) + 1)).tolist()
        flat = sym.tolist()
        if len(sym) and 0 <= sym.min() and sym.max() < len(self.pieces):
            return [flat[a:b] for a, b in zip(bounds, bounds[1:])]
        return [[i for s in flat[a:b] for i in ([s] if 0 <= s < len(self.pieces) else self._fallback(s))] for a, b in zip(bounds, bounds[1:])]

    def _fallback(self, s: int) -> list[int]:
        if s not in self._char:
            c = chr(-1 - s) if s < 0 else next(c for c, i in self.symbol.items() if i == s)
            ids = [int(self.bytes_[b]) for b in c.encode()]
            self._char[s] = ids if min(ids) >= 0 else [self.unknown]
        return self._char[s]

    def split(self, text: str) -> list[str]:
        """The words of a text, each with the word marks before it."""
        if not text:
            return []
        return re.findall(f"{MARK}+[^{MARK}]*|[^{MARK}]+", (MARK if self.dummy_prefix else "") + text.replace(" ", MARK))

    def encode(self, text: str) -> list[int]:
        words = self.split(text)
        distinct = list(dict.fromkeys(words))
        ids = dict(zip(distinct, self.merge_words(distinct)))
        return [i for w in words for i in ids[w]]

    def decode(self, ids: list[int], first: bool = True) -> str:
        """Text of ids: byte pieces are read as UTF-8, what is not UTF-8 becomes U+FFFD for each byte."""
        out: list[str] = []
        held = bytearray()

        def flush() -> None:
            at = 0
            while at < len(held):
                for n in (1, 2, 3, 4):
                    try:
                        out.append(held[at : at + n].decode())
                        at += n
                        break
                    except UnicodeDecodeError:
                        if n == 4 or at + n >= len(held):
                            out.append("�")
                            at += 1
                            break
            held.clear()

        for n, i in enumerate(ids):
            kind, piece = self.kinds[i], self.pieces[i]
            if kind == BYTE:
                held.append(int(piece[3:5], 16))
                continue
            flush()
            if kind == UNKNOWN:
                out.append(" ⁇ ")
            elif kind != CONTROL:
                if n == 0 and first and self.dummy_prefix and piece.startswith(MARK):
                    piece = piece[1:]
                out.append(piece.replace(MARK, " "))
        flush()
        return "".join(out)

    def remember(self, words: set[str], most: int = 100_000) -> None:
        """Encodes words not yet known; when the store would grow over ``most`` words, only those of this call stay."""
        if len(self.known) > most:
            self.known = {w: self.known[w] for w in words if w in self.known}
        new = [w for w in words if w not in self.known]
        digits, plain = self.digits.__getitem__, self.plain.__getitem__
        for w, ids in zip(new, self.merge_words(new)):
            try:
                text = "".join(map(plain, ids))
            except TypeError:  # byte pieces have no text of their own
                text = self.decode(ids, first=False)
            self.known[w] = (",".join(map(digits, ids)), text)


def encode_documents(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text", full: bool = False) -> DataFrame:
    """One row per input row: id, n_tokens, ids_sha256, decoded_sha256; with ``full`` also ids and decoded.

    Null and empty texts have no ids and decode to the empty string. Repeated rows each get their result; a null id is
    carried along; other columns of the input are not read. Texts are encoded whole, whatever their length.
    """
    from pyspark.sql import types as T

    fields = [docs.schema[id_col], T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())]
    if full:
        fields += [T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("decoded", T.StringType())]
    schema = T.StructType(fields)

    # The file is the driver's; workers get its bytes, of a size that the vocabulary fixes.
    with open(model_path, "rb") as f:
        data = docs.sparkSession.sparkContext.broadcast(f.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = PieceModel.of(data.value)
        for batch in batches:
            for part in byte_slices(batch, 1):
                split = [model.split(t or "") for t in part.column(1).to_pylist()]
                model.remember({w for ws in split for w in ws})
                known = model.known
                n, ids, decoded = [], [], []
                for ws in split:
                    s = ",".join([known[w][0] for w in ws])
                    t = "".join([known[w][1] for w in ws])
                    n.append(s.count(",") + 1 if s else 0)
                    ids.append(s)
                    decoded.append(t[1:] if model.dummy_prefix and t.startswith(" ") else t)
                sha = lambda xs: [hashlib.sha256(x.encode()).hexdigest() for x in xs]
                columns = [part.column(0), pa.array(n, pa.int64()), pa.array(sha(ids)), pa.array(sha(decoded))]
                if full:
                    columns += [pa.array([[int(i) for i in s.split(",")] if s else [] for s in ids], pa.list_(pa.int32())), pa.array(decoded)]
                yield pa.RecordBatch.from_arrays(columns, names=[f.name for f in fields])
        model.known.clear()

    return docs.select(id_col, text_col).mapInArrow(lean(run), schema)
