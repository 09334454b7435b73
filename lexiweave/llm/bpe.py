"""Encoding of texts with a public byte-level tokenizer.

Pre-tokens are found for a whole batch at once: each code point becomes a
class, each class a transition between scanner states, and the states before
all positions follow from an associative scan over the transitions. The
slices between boundaries are merged once each and looked up afterwards.
"""

from __future__ import annotations

import base64
import heapq
import os
import unicodedata
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The vocabulary by default: ranks of a byte-level BPE.
VOCABULARY = "byte_bpe_50k.tiktoken"
#: The folder of public tokenizers by default.
TOKENIZERS = "/opt/tokenizers"
#: Slices kept with their ids in a worker; beyond it the store starts anew. Only speed depends on it.
CACHE_SLICES = 400_000
#: Characters scanned at a time, so that a worker's arrays stay small.
SCAN_CHARS = 1 << 20

#: Letters and numbers of Unicode 16, which the tokenizer knows and Python's tables may not; fixed values, first and last.
NEW_LETTERS = (
    (0x1C89, 0x1C8A), (0xA7CB, 0xA7CD), (0xA7DA, 0xA7DC), (0x105C0, 0x105F3), (0x10D4A, 0x10D65), (0x10D6F, 0x10D85), (0x10EC2, 0x10EC4), (0x11380, 0x11389), (0x1138B, 0x1138B), (0x1138E, 0x1138E),
    (0x11390, 0x113B5), (0x113B7, 0x113B7), (0x113D1, 0x113D1), (0x113D3, 0x113D3), (0x11BC0, 0x11BE0), (0x13460, 0x143FA), (0x16100, 0x1611D), (0x16D40, 0x16D6C), (0x18CFF, 0x18CFF),
    (0x1E5D0, 0x1E5ED), (0x1E5F0, 0x1E5F0),
)
NEW_NUMBERS = ((0x10D40, 0x10D49), (0x116D0, 0x116E3), (0x11BF0, 0x11BF9), (0x16130, 0x16139), (0x16D70, 0x16D79), (0x1CCF0, 0x1CCF9), (0x1E5F1, 0x1E5FA))

LETTER, NUMBER, OTHER, SPACE, BLANK, APOSTROPHE = range(6)
# classes by what follows: a space before something visible, white space before white space, an apostrophe before a suffix
JOINING, INNER, SUFFIX1, SUFFIX2 = 6, 7, 8, 9
CLASSES = 10
#: Scanner states: what the pre-token so far is.
START, LETTERS, NUMBERS, OTHERS, SPACES, LEAD, REST2, REST1, CLOSED = range(9)
STATES = 9


def vocabulary_path(name: str = VOCABULARY) -> str:
    """Where a vocabulary file lies: a path as given, or a name in the folder of public tokenizers."""
    return name if os.path.sep in name else os.path.join(TOKENIZERS, name)


@cache
def ranks(path: str) -> dict[bytes, int]:
    """The vocabulary's pieces and their ranks, which are their ids."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


@cache
def class_table() -> np.ndarray:
    """The class of each code point, by its general category and the property White_Space; unassigned ones are marks."""
    table = np.full(0x110000, OTHER, np.uint8)
    of = {"L": LETTER, "N": NUMBER}
    for c in range(0x110000):
        table[c] = of.get(unicodedata.category(chr(c))[0], OTHER)
    for ranges, cls in ((NEW_LETTERS, LETTER), (NEW_NUMBERS, NUMBER)):
        for first, last in ranges:
            table[first : last + 1] = cls
    table[[*range(0x09, 0x0E), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]] = BLANK
    table[ord(" ")] = SPACE
    table[ord("'")] = APOSTROPHE
    return table


@cache
def transitions() -> tuple[np.ndarray, np.ndarray]:
    """(next state, whether a pre-token starts here) by class and state."""
    step = np.zeros((CLASSES, STATES), np.uint8)
    cut = np.ones((CLASSES, STATES), bool)
    step[LETTER], step[NUMBER], step[OTHER], step[APOSTROPHE] = LETTERS, NUMBERS, OTHERS, OTHERS
    step[INNER], step[BLANK], step[SPACE] = SPACES, CLOSED, CLOSED
    step[JOINING] = LEAD
    step[SUFFIX1], step[SUFFIX2] = REST1, REST2
    for cls, run in ((LETTER, LETTERS), (NUMBER, NUMBERS), (OTHER, OTHERS), (APOSTROPHE, OTHERS)):
        cut[cls, [run, LEAD]] = False
    for cls in (SUFFIX1, SUFFIX2):  # within a run of marks, or after a space, an apostrophe begins no suffix
        step[cls, [OTHERS, LEAD]] = OTHERS
        cut[cls, [OTHERS, LEAD]] = False
    cut[INNER, SPACES] = False
    # a run of white space gives its last character to what follows: alone, or joined where it is a space
    step[LETTER, REST2], step[LETTER, REST1] = REST1, CLOSED
    cut[LETTER, [REST2, REST1]] = False
    return step, cut


def _classes(codes: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The class at each position, what follows included; ``ends`` are the texts' last positions."""
    c = class_table()[codes]
    after = np.empty_like(c)
    after[:-1] = c[1:]
    after[ends] = 255
    white = (c == SPACE) | (c == BLANK)
    then_white = (after == SPACE) | (after == BLANK) | (after == 255)
    c = np.where(white & then_white, INNER, np.where(white & (c == SPACE), JOINING, c)).astype(np.uint8)
    at = np.flatnonzero(c == APOSTROPHE)
    if len(at):
        last = np.zeros(len(codes) + 2, bool)
        last[ends] = True
        padded = np.concatenate([codes, np.zeros(2, codes.dtype)])
        one, two = padded[at + 1], padded[at + 2]
        has1, has2 = ~last[at], ~last[at] & ~last[at + 1]
        short = has1 & np.isin(one, [ord(x) for x in "stmd"])
        pair = has2 & (((one == ord("r")) & (two == ord("e"))) | ((one == ord("v")) & (two == ord("e"))) | ((one == ord("l")) & (two == ord("l"))))
        c[at[short]] = SUFFIX1
        c[at[pair]] = SUFFIX2
    return c


def _states_before(step: np.ndarray, classes: np.ndarray, begins: np.ndarray, width: int = 64) -> np.ndarray:
    """The state before each position, by an associative scan of the transition functions.

    The functions of a row of ``width`` positions are composed first, all rows
    at once; the rows' functions are scanned by doubling; then each row runs
    from its own first state. A text's first position maps every state to what
    START gives, so no state passes from one text to the next.
    """
    n = len(classes)
    rows = -(-n // width)
    padded = np.zeros(rows * width, np.uint8)
    padded[:n] = classes
    first = np.zeros(rows * width, bool)
    first[begins] = True
    padded, first = padded.reshape(rows, width), first.reshape(rows, width)
    whole = np.tile(np.arange(STATES, dtype=np.uint8), (rows, 1))
    for j in range(width):
        before = np.where(first[:, j, None], START, whole)
        whole = step[padded[:, j, None], before]
    reach = 1
    while reach < rows:  # whole[i] becomes the composition of all rows up to i
        nxt = whole.copy()
        nxt[reach:] = np.take_along_axis(whole[reach:], whole[:-reach].astype(np.intp), 1)
        whole, reach = nxt, reach * 2
    state = np.empty(rows, np.uint8)
    state[0] = START
    state[1:] = whole[:-1, START]
    out = np.empty((rows, width), np.uint8)
    for j in range(width):
        out[:, j] = np.where(first[:, j], START, state)
        state = step[padded[:, j], out[:, j]]
    return out.reshape(-1)[:n]


def boundaries(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(positions at which pre-tokens start, positions at which texts start) in the joined texts; no text may be empty."""
    codes = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    begins = np.concatenate([[0], np.cumsum(sizes)])
    classes = _classes(codes, begins[1:] - 1)
    step, cut = transitions()
    states = _states_before(step, classes, begins[:-1])
    starts = cut[classes, states]
    starts[begins[:-1]] = True
    return np.flatnonzero(starts), begins


def merge_pieces(piece: bytes, rank: dict[bytes, int]) -> list[int]:
    """The ids of one pre-token: the pair of lowest rank is merged, the first one of ties, until none is left.

    A heap over a linked list keeps long pre-tokens from taking quadratic time.
    """
    if piece in rank:
        return [rank[piece]]
    n = len(piece)
    start, nxt, prev = list(range(n)), [*range(1, n), -1], [-1, *range(n - 1)]
    stop = [i + 1 for i in range(n)]
    heap = []
    for i in range(n - 1):
        r = rank.get(piece[i : i + 2])
        if r is not None:
            heap.append((r, i, i + 1, i + 2))
    heapq.heapify(heap)
    alive = [True] * n
    while heap:
        _, i, mid, end = heapq.heappop(heap)
        j = nxt[i]
        if not alive[i] or j < 0 or stop[i] != mid or stop[j] != end:
            continue
        stop[i], alive[j] = end, False
        nxt[i] = nxt[j]
        if nxt[j] >= 0:
            prev[nxt[j]] = i
            r = rank.get(piece[i : stop[nxt[j]]])
            if r is not None:
                heapq.heappush(heap, (r, i, end, stop[nxt[j]]))
        if prev[i] >= 0:
            p = prev[i]
            r = rank.get(piece[p:end])
            if r is not None:
                heapq.heappush(heap, (r, p, i, end))
    out, i = [], 0
    while i >= 0:
        out.append(rank[piece[start[i] : stop[i]]])
        i = nxt[i]
    return out


class Encoder:
    """Ids of texts by one vocabulary, with a store of the slices met so far."""

    def __init__(self, path: str):
        self.rank = ranks(path)
        self.store: dict[str, list[int]] = {}

    def slices(self, text: str) -> list[str]:
        """The pre-tokens of one text."""
        if not text:
            return []
        cuts = [*boundaries([text])[0].tolist(), len(text)]
        return [text[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]

    def ids(self, part: str) -> list[int]:
        got = self.store.get(part)
        if got is None:
            if len(self.store) >= CACHE_SLICES:
                self.store.clear()
            got = self.store[part] = merge_pieces(part.encode(), self.rank)
        return got

    def encode_batch(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(all ids, where each text's ids start and the last end). Null and empty texts have none."""
        parts, counts = [], np.zeros(len(texts) + 1, np.int64)
        for group in self._groups(texts):
            kept = [texts[i] for i in group]
            joined = "".join(kept)
            starts, begins = boundaries(kept)
            cuts = starts.tolist()
            cuts.append(len(joined))
            get, ids = self.store.get, self.ids
            encoded = [get(s) or ids(s) for s in map(joined.__getitem__, map(slice, cuts, cuts[1:]))]
            sizes = np.fromiter(map(len, encoded), np.int64, len(encoded))
            owner = np.searchsorted(begins, starts, "right") - 1
            counts[np.asarray(group) + 1] = np.bincount(owner, sizes, len(group)).astype(np.int64)
            flat = np.empty(int(sizes.sum()), np.int32)
            at = 0
            for e in encoded:
                flat[at : at + len(e)] = e
                at += len(e)
            parts.append(flat)
        return np.concatenate(parts) if parts else np.empty(0, np.int32), np.cumsum(counts)

    def _groups(self, texts: list[str | None]) -> Iterator[list[int]]:
        """Indexes of texts with something in them, about SCAN_CHARS characters at a time; a text is never cut."""
        group, size = [], 0
        for i, t in enumerate(texts):
            if t:
                if group and size + len(t) > SCAN_CHARS:
                    yield group
                    group, size = [], 0
                group.append(i)
                size += len(t)
        if group:
            yield group


@cache
def encoder(path: str) -> Encoder:
    """The worker's encoder of a vocabulary."""
    return Encoder(path)


def encode(df: DataFrame, row_id: str, text: str, vocabulary: str = VOCABULARY, offsets: bool = False) -> DataFrame:
    """(row_id, ids ARRAY<INT>[, offsets ARRAY<INT>]): the token ids of each text, without special tokens.

    Null and empty texts have an empty array; strings of special tokens are
    ordinary text. Offsets are the byte in the UTF-8 text at which each token
    starts, so a token's bytes can be cut out again. Repeated rows come out
    each; other columns are not read. There is no shuffle.
    """
    kept = df.select(F.col(row_id), F.col(text).alias("_text"))
    fields = [kept.schema.fields[0], T.StructField("ids", T.ArrayType(T.IntegerType(), False), False)]
    if offsets:
        fields.append(T.StructField("offsets", T.ArrayType(T.IntegerType(), False), False))
    schema = T.StructType(fields)
    path = vocabulary_path(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        length = _piece_lengths(path) if offsets else None
        for b in batches:
            ids, at = enc.encode_batch(b.column(1).to_pylist())
            where = pa.array(at, pa.int32())
            cols = [b.column(0), pa.ListArray.from_arrays(where, pa.array(ids, pa.int32()))]
            if offsets:
                ends = np.concatenate([[0], np.cumsum(length[ids])])
                starts = ends[:-1] - np.repeat(ends[at[:-1]], np.diff(at))
                cols.append(pa.ListArray.from_arrays(where, pa.array(starts.astype(np.int32))))
            yield pa.RecordBatch.from_arrays(cols, schema=pa.schema([pa.field(f.name, c.type, f.nullable) for f, c in zip(fields, cols, strict=True)]))

    return kept.mapInArrow(run, schema)


@cache
def _piece_lengths(path: str) -> np.ndarray:
    out = np.zeros(max(ranks(path).values()) + 1, np.int64)
    for piece, i in ranks(path).items():
        out[i] = len(piece)
    return out


def count_tokens(df: DataFrame, keys: list[str], text: str, vocabulary: str = VOCABULARY, out: str = "n_tokens") -> DataFrame:
    """(keys, n_tokens): the size of each text in tokens; null and empty texts have 0."""
    kept = df.select(*keys, F.col(text).alias("_text"))
    schema = T.StructType([*kept.schema.fields[:-1], T.StructField(out, T.LongType(), False)])
    path, n = vocabulary_path(vocabulary), len(keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for b in batches:
            _, at = enc.encode_batch(b.column(n).to_pylist())
            cols = [*b.columns[:n], pa.array(np.diff(at), pa.int64())]
            yield pa.RecordBatch.from_arrays(cols, names=[*keys, out])

    return kept.mapInArrow(run, schema)


def decode(df: DataFrame, row_id: str, ids: str = "ids", vocabulary: str = VOCABULARY, out: str = "text") -> DataFrame:
    """(row_id, text): the text of the ids; a null array gives null. Bytes that are no UTF-8 come out as replacement characters."""
    kept = df.select(F.col(row_id), F.col(ids).alias("_ids"))
    schema = T.StructType([kept.schema.fields[0], T.StructField(out, T.StringType())])
    path = vocabulary_path(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = {i: p for p, i in ranks(path).items()}
        for b in batches:
            texts = [None if x is None else b"".join(map(pieces.__getitem__, x)).decode("utf-8", "replace") for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], names=[row_id, out])

    return kept.mapInArrow(run, schema)
