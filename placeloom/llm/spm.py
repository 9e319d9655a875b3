"""SentencePiece encoding by streaming Viterbi, and decoding.

The piece table (pieces, scores, kinds) is read on the driver and travels to the
executors with the function: it is as large as the vocabulary file, about 1 MB.
The path is a parameter; executors do not need the file.

Encoding maximises the sum of piece scores. The lattice is walked character by
character and only a window is held: scores of the positions that a piece from here
can reach (as many as the longest piece has characters), and the back pointers that
surviving paths still share. Paths that no open position stands on are dropped at every
character, and as soon as all that survive run through one boundary, the ids before it
are committed. A character that no piece covers costs the lowest score less 10 and
becomes byte pieces. Ties go to the path whose last piece starts earliest (the longest
last piece).

Boundaries that no piece spans (before a word, beside a line break) are
convergence points of every text: whatever came before, all paths meet there and
the ids are committed. So each distinct stretch between them is encoded once a
batch: those no longer than the longest piece, which fit in one window, side by side
in numpy (a lane each, one step of all lanes a character), longer ones through the
window.

Defined results: null text has null ids, empty text no ids; a literal U+2581 is
kept apart from a space by byte pieces, so decode(encode(text)) is the text
itself for every valid string; texts of any length need memory for their ids and
one window only; repeated rows are encoded each for itself; an id that
the table lacks decodes to nothing.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from itertools import chain
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import documents

#: Where the public vocabulary files lie by default.
MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"
#: Stretches that run in lanes at once; characters encoded at once.
LANES, CHARS = 10_000, 1_500_000
#: Odd multipliers of the piece hash and of its table.
BASE, SPREAD = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


class Table(NamedTuple):
    """prefixes: each prefix of a piece -> (id, score), or None if it is no piece itself. as_bytes: what each id stands for."""

    prefixes: dict
    longest: int
    byte_ids: list[int]
    unknown: float
    as_bytes: list[bytes]
    stretches: str


def load(path: str = MODEL) -> Table:
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    prefixes: dict = {}
    byte_ids, as_bytes, inner, letters, lowest, longest = [0] * 256, [], set(), set(), 0.0, 1
    for i in range(sp.get_piece_size()):
        piece = sp.id_to_piece(i)
        if sp.is_byte(i):
            b = int(piece[3:5], 16)
            byte_ids[b] = i
            as_bytes.append(bytes([b]))
        elif sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i):
            as_bytes.append(b"")
        else:
            as_bytes.append(piece.replace(SPACE, " ").encode())
            score = sp.get_score(i)
            for n in range(1, len(piece)):
                prefixes.setdefault(piece[:n], None)
            prefixes[piece] = (i, score)
            longest = max(longest, len(piece))
            letters.update(piece)
            inner.update(zip(piece, piece[1:], strict=False))
            if score > -1e8:
                lowest = min(lowest, score)
    alone = "".join(c for c in "\n\t\r" if c not in letters)
    if any(b == SPACE and a != SPACE for a, b in inner):
        stretches = f"[{re.escape(alone)}]|[^{re.escape(alone)}]+" if alone else "(?s:.+)"
    else:
        stretches = f"[{re.escape(alone)}]|{SPACE}+[^{SPACE}{re.escape(alone)}]*|[^{SPACE}{re.escape(alone)}]+" if alone else f"{SPACE}+[^{SPACE}]*|[^{SPACE}]+"
    return Table(prefixes, longest, byte_ids, lowest - 10, as_bytes, stretches)


def viterbi(chars: str, t: Table, watch: Callable[[int], None] | None = None) -> list[int]:
    """Ids of one stretch. watch is told at each character how many boundaries are held.

    The settled positions that surviving paths run through form a tree: parent and last piece, and the
    positions that hang on each. A position is dropped when nothing hangs on it any more and no open position
    stands on it; while only one path leads on from the root, that step is committed and the root moves.
    """
    prefixes, unknown, byte_ids, longest = t.prefixes, t.unknown, t.byte_ids, t.longest
    low, n, out, root = float("-inf"), len(chars), [], 0
    last: dict[int, tuple[int, int | None]] = {}
    hanging: dict[int, set[int]] = {0: set()}
    scores, pieces, open_ = [0.0] + [low] * longest, [(0, None)] * (longest + 1), set()  # of positions i to i + longest
    for i in range(n):
        here = scores[0]
        for k in range(1, min(longest, n - i) + 1):
            sub = chars[i : i + k]
            found = prefixes.get(sub, 0)
            if found:
                if (s := here + found[1]) > scores[k]:
                    scores[k], pieces[k] = s, (i, found[0])
            elif k == 1 and here + unknown > scores[1]:
                scores[1], pieces[1] = here + unknown, (i, None)
            if found == 0:
                break
        # position i + 1 is settled (one character always leads to it) and hangs on where its best piece starts
        scores, pieces = [*scores[1:], low], [*pieces[1:], (0, None)]
        last[i + 1], hanging[i + 1] = pieces[0], set()
        hanging[pieces[0][0]].add(i + 1)
        before, open_ = open_, {x[0] for x, s in zip(pieces[1:], scores[1:], strict=True) if s > low}
        for p in [i, *(before - open_)]:
            while p in hanging and p != root and not hanging[p] and p not in open_ and p <= i:
                del hanging[p]
                hanging[parent := last.pop(p)[0]].discard(p)
                p = parent
        while root <= i and root not in open_ and len(hanging[root]) == 1:
            (following,) = hanging.pop(root)
            out += _ids(chars, root, following, last.pop(following)[1], byte_ids)
            root = following
        if watch:
            watch(len(hanging))
    rest = []
    while n > root:
        start, piece = last[n]
        rest.append(_ids(chars, start, n, piece, byte_ids))
        n = start
    return out + list(chain.from_iterable(reversed(rest)))


def _ids(chars: str, start: int, end: int, piece: int | None, byte_ids: list[int]) -> list[int]:
    return [piece] if piece is not None else [byte_ids[b] for b in chars[start:end].encode("utf-8", "surrogatepass")]


class Lanes:
    """Viterbi over many short stretches at once: a lane each, one step of all lanes a character.

    Pieces are found by a 64-bit polynomial hash of their characters in an open table. Scores and ties are those of viterbi().
    """

    def __init__(self, t: Table):
        self.t = t
        pieces = [(p, *x) for p, x in t.prefixes.items() if x]
        self.longest = t.longest
        self.power = np.ones(t.longest + 1, np.uint64)
        self.power[1:] = np.multiply.accumulate(np.full(t.longest, BASE))
        self.bits = max(8, (len(pieces) * 8).bit_length())
        size = 1 << self.bits
        self.keys, self.ids, self.scores = np.zeros(size + 1, np.uint64), np.full(size + 1, -1, np.int32), np.full(size + 1, -np.inf)
        self.probes = 1
        for piece, i, score in pieces:
            h = 0
            for c in piece:
                h = (h * int(BASE) + ord(c)) & (2**64 - 1)
            at, n = self._slot(h), 1
            while self.ids[at] >= 0:
                assert int(self.keys[at]) != h
                at, n = (at + 1) % size, n + 1
            self.keys[at], self.ids[at], self.scores[at] = h, i, score
            self.probes = max(self.probes, n)

    def _slot(self, h: int) -> int:
        return ((h * int(SPREAD)) & (2**64 - 1)) >> (64 - self.bits)

    def find(self, h: np.ndarray) -> np.ndarray:
        """The slot of each hash; an empty slot where it is no piece."""
        at = ((h * SPREAD) >> np.uint64(64 - self.bits)).astype(np.int64)
        open_ = np.flatnonzero((self.keys[at] != h) & (self.ids[at] >= 0))
        for _ in range(self.probes):
            if not len(open_):
                break
            at[open_] = (at[open_] + 1) & ((1 << self.bits) - 1)
            open_ = open_[(self.keys[at[open_]] != h[open_]) & (self.ids[at[open_]] >= 0)]
        at[open_] = 1 << self.bits
        return at

    def run(self, chars: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """chars: (lanes, length) code points. Ids in order, ids a lane, and which lanes hold a character that no piece covers."""
        n, size = chars.shape
        hashes = np.zeros((size + 1, n), np.uint64)
        for j in range(size):
            hashes[j + 1] = hashes[j] * BASE + chars[:, j]
        best = np.full((size + 1, n), -np.inf)
        best[0] = 0
        length, piece = np.zeros((size + 1, n), np.int8), np.full((size + 1, n), -1, np.int32)
        unknown = np.zeros(n, bool)
        for j in range(1, size + 1):
            for k in range(min(self.longest, j), 0, -1):
                at = self.find(hashes[j] - hashes[j - k] * self.power[k])
                ids = self.ids[at]
                if k == 1:
                    unknown |= ids < 0
                better = np.flatnonzero((ids >= 0) & (best[j - k] + self.scores[at] > best[j]))
                if len(better):
                    best[j, better] = best[j - k, better] + self.scores[at[better]]
                    length[j, better], piece[j, better] = k, ids[better]
        ends = np.zeros((n, size), bool)
        lanes, place = np.flatnonzero(~unknown), np.full(n - int(unknown.sum()), size)
        while len(lanes):
            ends[lanes, place - 1] = True
            place = place - length[place, lanes]
            lanes, place = lanes[place > 0], place[place > 0]
        return piece[1:].T[ends], ends.sum(axis=1), unknown


def spans(starts: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """The places starts[0] .. starts[0] + lens[0] - 1, starts[1] ..."""
    return np.arange(lens.sum()) + np.repeat(starts - (np.cumsum(lens) - lens), lens)


class Codec:
    def __init__(self, table: Table):
        self.t, self.lanes, self.split = table, Lanes(table), re.compile(table.stretches).findall
        sizes = np.array([len(b) for b in table.as_bytes], np.int64)
        self.blob, self.sizes, self.starts = np.frombuffer(b"".join(table.as_bytes), np.uint8), sizes, np.cumsum(sizes) - sizes
        # an id that the table lacks stands for nothing
        self.sizes_or_none, self.starts_or_none = np.append(sizes, 0), np.append(self.starts, 0)
        self.literal = [table.byte_ids[b] for b in SPACE.encode()]

    def _stretches(self, text: str) -> list[str]:
        """Escaped stretches; a literal U+2581 stands as a mark of its own."""
        first, *rest = text.split(SPACE)
        out = self.split(SPACE + first.replace(" ", SPACE))
        for part in rest:
            out.append("")
            out += self.split(part.replace(" ", SPACE))
        return out

    def _distinct(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of each stretch, one after another, and how many each has."""
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        counts, parts, owners = np.zeros(len(words), np.int64), [], []

        def alone(g: int) -> None:
            parts.append(np.array(viterbi(words[g], self.t) if words[g] else self.literal, np.int32))
            owners.append(np.array([g]))
            counts[g] = len(parts[-1])

        order = np.argsort(sizes, kind="stable")
        cuts = np.flatnonzero(np.diff(sizes[order])) + 1
        for group in np.split(order, cuts) if len(order) else []:
            size = int(sizes[group[0]])
            if size == 0 or size > self.t.longest or len(group) < 4:
                for g in group.tolist():
                    alone(g)
                continue
            for at in range(0, len(group), LANES):
                part = group[at : at + LANES]
                chars = np.frombuffer("".join([words[g] for g in part]).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(-1, size)
                ids, n, unknown = self.lanes.run(chars.astype(np.uint64))
                parts.append(ids)
                owners.append(part[~unknown])
                counts[part] = n
                for g in part[unknown].tolist():
                    alone(g)
        if not parts:
            return np.zeros(0, np.int32), counts
        flat, owner = np.concatenate(parts), np.concatenate(owners)
        ends = np.cumsum(counts[owner])
        starts = np.zeros(len(words), np.int64)
        starts[owner] = ends - counts[owner]
        return flat[spans(starts, counts)], counts

    def encode_all(self, texts: list[str | None]) -> pa.ListArray:
        split = [self._stretches(t) if t else [] for t in texts]
        per_text = np.fromiter(map(len, split), np.int64, len(split))
        d = pa.array(chain.from_iterable(split), pa.string()).dictionary_encode()
        codes = d.indices.to_numpy(zero_copy_only=False)
        flat, counts = self._distinct(d.dictionary.to_pylist())
        ids = flat[spans((np.cumsum(counts) - counts)[codes], counts[codes])] if len(codes) else flat
        ends = np.append(0, np.cumsum(counts[codes] if len(codes) else codes))[np.cumsum(per_text)]
        none = np.array([t is None for t in texts] + [False])
        offsets = pa.array(np.append(0, ends).astype(np.int32), mask=none if none.any() else None)
        return pa.ListArray.from_arrays(offsets, pa.array(ids, pa.int32()))

    def encode(self, text: str | None) -> list[int] | None:
        return self.encode_all([text])[0].as_py()

    def decode_all(self, ids: pa.ListArray) -> list[str | None]:
        """Texts of ids: pieces joined, one leading space (the encoder's own) removed, broken bytes replaced."""
        out: list[str | None] = []
        for part in (ids.slice(i, 512) for i in range(0, len(ids), 512)):
            flat = part.flatten().to_numpy(zero_copy_only=False)
            flat = np.where((flat >= 0) & (flat < len(self.sizes)), flat, len(self.sizes))
            counts = pc.fill_null(pc.list_value_length(part), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            size = self.sizes_or_none[flat]
            data = self.blob[spans(self.starts_or_none[flat], size)].tobytes() if len(flat) else b""
            ends = np.append(0, np.cumsum(size))[np.cumsum(counts)] if len(counts) else counts
            at = 0
            for end, valid in zip(ends.tolist(), part.is_valid().to_pylist(), strict=True):
                s = data[at:end].decode("utf-8", "replace")
                out.append((s[1:] if s[:1] == " " else s) if valid else None)
                at = end
        return out

    def decode(self, ids) -> str | None:
        return self.decode_all(pa.array([ids], pa.list_(pa.int32())))[0]


def _blocks(texts: pa.Array) -> Iterator[pa.Array]:
    """Slices of about CHARS bytes of text."""
    block = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)) // CHARS
    cuts = [0, *(np.flatnonzero(np.diff(block)) + 1).tolist(), len(texts)]
    for a, b in zip(cuts, cuts[1:], strict=False):
        yield texts.slice(a, b - a)


def encode_pieces(df: DataFrame, text_col: str = "text", out_col: str = "ids", model: str = MODEL) -> DataFrame:
    """df with the ids of each text. One pass, no shuffle."""
    table = df.sparkSession.sparkContext.broadcast(load(model))

    @F.arrow_udf(T.ArrayType(T.IntegerType()))
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        codec = Codec(table.value)
        for texts in batches:
            yield pa.concat_arrays([codec.encode_all(b.to_pylist()) for b in _blocks(texts)])

    return df.withColumn(out_col, run(F.col(text_col)))


def decode_pieces(df: DataFrame, ids_col: str = "ids", out_col: str = "decoded", model: str = MODEL) -> DataFrame:
    """df with the text of each list of ids (null: null)."""
    table = df.sparkSession.sparkContext.broadcast(load(model))

    @F.arrow_udf(T.StringType())
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        codec = Codec(table.value)
        for ids in batches:
            yield pa.array(codec.decode_all(ids), pa.string())

    return df.withColumn(out_col, run(F.col(ids_col)))


def op3_streaming_viterbi(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every whole text, and whether decoding them gives the text again."""
    coded = decode_pieces(encode_pieces(documents(spark, sf_dir).select("doc_id", "text")))
    return coded.select("doc_id", F.length("text").cast("long").alias("n_chars"), F.size("ids").cast("long").alias("n_ids"), "ids", F.col("decoded").eqNullSafe(F.col("text")).alias("round_trip"))
