"""The language of documents and of their segments.

Each language has a probability for every piece of a fixed public vocabulary.
The score of a word is the sum over all its segmentations into pieces, by a
forward algorithm that runs for all languages and many words at once. The
probabilities are fitted by expectation maximisation on a bounded sample of
labelled documents. Sentences are scored from their words, and a best path
over a document's sentences gives its segments.
"""

from __future__ import annotations

import base64
import math
import unicodedata
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from functools import cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexiweave.functions.keys import trimmed
from lexiweave.llm.bpe import vocabulary_path

#: The vocabulary whose pieces are used.
VOCABULARY = "byte_bpe_multi_50k.tiktoken"
#: The sample that the driver fits on: documents a language, characters a document of it may have, characters of all of it.
SAMPLE_DOCS, SAMPLE_CHARS, SAMPLE_TOTAL = 400, 20_000, 24_000_000
#: Rows the table of languages may have: it is a dimension of fixed size and is collected.
MAX_LANGUAGES = 2_000
ROUNDS = 3
#: How often a word of a text is quoted from any other language: what a word can say for one language over another is bounded by this chance.
QUOTED = 0.03
#: Letters that count as one word in a run of letters: in scripts without spaces, and in others.
RUN_LETTERS, LONG_LETTERS = 3, 24
#: Nats that a change of language between sentences costs.
SWITCH_COST = 7.0
#: Scored words kept in a worker; only speed depends on it.
CACHE_WORDS = 400_000

#: Where sentences end: behind a mark and its closing quotes before white space or mark-up, behind an ideographic mark, or at a line's end.
_SENTENCE_END = regex.compile(r"""[.!?…]["'”’»)\]*_]{0,3}(?=\s|</?[a-z])|[。！？][」』”]{0,2}|[\r\n]+""")
_MARKUP = regex.compile(r"</?[A-Za-z][A-Za-z0-9]*(?:\s[^<>]*)?/?>")
_WORD = regex.compile(r"[\p{L}\p{M}]+")
_UNSPACED = regex.compile(r"[\p{Han}\p{Hiragana}\p{Katakana}\p{Thai}\p{Lao}\p{Khmer}\p{Myanmar}\p{Tibetan}]")
_MARKS = regex.compile(r"\p{Mn}+")
#: Letters that accents do not part from their plain form by decomposition; fixed values.
_PLAIN = str.maketrans({"ł": "l", "đ": "d", "ø": "o", "ı": "i", "æ": "ae", "œ": "oe"})
#: Beginnings of Unicode names by ISO 15924 script; fixed values.
SCRIPT_NAMES = {
    "Latn": ("LATIN",), "Cyrl": ("CYRILLIC",), "Grek": ("GREEK",), "Deva": ("DEVANAGARI",), "Arab": ("ARABIC",), "Hebr": ("HEBREW",), "Jpan": ("HIRAGANA", "KATAKANA", "CJK"),
    "Kore": ("HANGUL",), "Hans": ("CJK",), "Hant": ("CJK",), "Hani": ("CJK",), "Thai": ("THAI",), "Armn": ("ARMENIAN",), "Geor": ("GEORGIAN",), "Beng": ("BENGALI",), "Taml": ("TAMIL",),
}


def plain(text: str) -> str:
    """The text in lower case and without accents, as shouted and stripped texts are."""
    t = text.casefold()
    return t if t.isascii() else unicodedata.normalize("NFC", _MARKS.sub("", unicodedata.normalize("NFKD", t))).translate(_PLAIN)


def sentences(text: str) -> list[tuple[int, int]]:
    """(start, end) of each sentence, without white space before it."""
    out, at, n = [], 0, len(text)
    for m in _SENTENCE_END.finditer(text):
        end = m.start() if m[0][0] in "\r\n" else m.end()
        while at < end and text[at].isspace():
            at += 1
        if at < end:
            out.append((at, end))
        at = m.end()
    while at < n and text[at].isspace():
        at += 1
    if at < n:
        out.append((at, n))
    return out


def words(sentence: str) -> list[str]:
    """The runs of letters of a sentence without mark-up."""
    return _WORD.findall(_MARKUP.sub(" ", sentence) if "<" in sentence else sentence)


def unit(word: str) -> str:
    """A run of letters as it is scored: in plain form behind a space."""
    return " " + plain(word)


def words_in(unit: str) -> float:
    """How many words a run of letters counts as."""
    n = len(unit) - 1
    return max(1.0, n / (RUN_LETTERS if _UNSPACED.search(unit) else LONG_LETTERS))


class Pieces:
    """A vocabulary as a tree of letters in arrays, so that many words are looked up at once.

    ``number`` has the pieces; one for each block of 128 code points, named by
    NUL and the block, stands for any other character in it.
    """

    def __init__(self, number: dict[str, int]):
        self.number = number
        self.block = np.full(0x110000 >> 7, -1, np.int32)
        step: dict[tuple[int, int], int] = {}
        piece = [-1]
        for p, k in number.items():
            if p[0] == "\0":
                self.block[int(p[1:])] = k
                continue
            at = 0
            for c in p:
                at = step.setdefault((at, ord(c)), len(piece))
                if at == len(piece):
                    piece.append(-1)
            piece[at] = k
        keys = np.array([a << 21 | c for a, c in step], np.int64)
        order = keys.argsort()
        self.keys, self.to, self.piece = keys[order], np.fromiter(step.values(), np.int64, len(step))[order], np.array(piece, np.int32)

    def lattice(self, words: list[str]) -> np.ndarray:
        """The piece at each start and length of words of equal length, by its number; -1 where there is none."""
        n = len(words[0])
        letters = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        start, node, layers = np.arange(len(letters)), np.zeros(len(letters), np.int64), []
        for length in range(1, n + 1):
            if length > 1:
                inside = start % n + length <= n
                start, node = start[inside], node[inside]
            key = node << 21 | letters[start + length - 1]
            at = np.minimum(self.keys.searchsorted(key), len(self.keys) - 1)
            known = self.keys[at] == key
            start, node = start[known], self.to[at[known]]
            if not len(start):
                break
            layer = np.full(len(letters), -1, np.int32)
            layer[start] = self.piece[node]
            layers.append(layer)
        while layers and layers[-1].max() < 0:
            layers.pop()
        if not layers:
            layers.append(np.full(len(letters), -1, np.int32))
        layers[0] = np.where(layers[0] < 0, self.block[letters >> 7], layers[0])
        return np.stack(layers, 1).reshape(len(words), n, len(layers))


@cache
def _vocabulary(path: str) -> Pieces:
    """The vocabulary's pieces of letters in plain form."""
    pieces: dict[str, int] = {}
    with open(path, "rb") as f:
        for line in f:
            try:
                s = base64.b64decode(line.split()[0]).decode()
            except UnicodeDecodeError:
                continue
            p = plain(s)
            bare = p[1:] if p[:1] == " " else p
            if p and (not bare or _WORD.fullmatch(bare)):
                pieces.setdefault(p, len(pieces))
    for block in range(0x110000 >> 7):
        pieces[f"\0{block}"] = len(pieces)
    return Pieces(pieces)


#: A running probability below TINY is raised by its inverse, which is counted.
TINY = 1e-100


def _forward(grid: np.ndarray, prob: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(alpha, raised)[word, position, language]: the probability of all segmentations up to each position is alpha times TINY to the power of raised.

    The last row of prob is 0.
    """
    words, n, width = grid.shape
    alpha = np.zeros((words, n + 1, prob.shape[1]))
    raised = np.zeros((words, n + 1, prob.shape[1]), np.int32)
    alpha[:, 0] = 1.0
    for i in range(n + 1):
        if i:
            raised[:, i] = raised[:, i - 1]
        if i % 8 == 7 and (low := alpha[:, i] < TINY).any():
            alpha[:, i : i + width] *= np.where(low, 1 / TINY, 1.0)[:, None]
            raised[:, i] += low
        for length in range(1, min(width, n - i) + 1):
            ids = grid[:, i, length - 1]
            if (ids >= 0).any():
                alpha[:, i + length] += alpha[:, i] * prob[ids]
    return alpha, raised


def _by_length(words: list[str], letters: int = 200_000) -> Iterator[list[str]]:
    """The words by length, so many letters at once."""
    groups: dict[int, list[str]] = {}
    for w in words:
        groups.setdefault(len(w), []).append(w)
    for n, ws in groups.items():
        at_once = max(1, letters // n)
        for i in range(0, len(ws), at_once):
            yield ws[i : i + at_once]


@dataclass
class Model:
    """Piece probabilities of each language; the size is that of the vocabulary times the languages.

    Words scored so far are kept: their units, and the units' rows in ``table``.
    """

    languages: list[str]
    vocabulary: str
    prob: np.ndarray
    rows: dict[str, int] = field(default_factory=dict)
    spelt: dict[str, str] = field(default_factory=dict)
    table: np.ndarray = field(default_factory=lambda: np.empty((0, 0)))

    def forget(self) -> None:
        self.rows.clear()
        self.spelt.clear()

    def learn(self, groups: Iterable[tuple[list[str], np.ndarray]]) -> None:
        """Scores words, given by length with their lattices.

        A word is of a text's language, or else quoted: then it is of any
        language alike. Its score is the logarithm of the probability of both
        together; the last column has the number of words that it counts as.
        """
        k = len(self.languages)
        for group, grid in groups:
            alpha, raised = _forward(grid, self.prob)
            own = np.log(alpha[:, -1] + 1e-300) + raised[:, -1] * math.log(TINY)
            top = own.max(1, keepdims=True)
            any_language = top + np.log(np.exp(own - top).mean(1, keepdims=True))
            size = np.array([[words_in(w)] for w in group])
            at = len(self.rows)
            if self.table.shape[0] < at + len(group):
                grown = np.empty((max(2 * (at + len(group)), 1024), k + 1))
                if at:
                    grown[:at] = self.table[:at]
                self.table = grown
            self.table[at : at + len(group), :k] = np.logaddexp(math.log(1 - QUOTED) + own, size * math.log(QUOTED) + any_language)
            self.table[at : at + len(group), k:] = size
            self.rows.update(zip(group, range(at, at + len(group)), strict=True))

    def gains(self, found: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
        """(what each sentence says for each language, its number of words): sums over its units. A sentence is a list of units that is not empty."""
        if not found:
            return np.empty((0, len(self.languages))), np.empty(0)
        words = [w for ws in found for w in ws]
        pieces = _vocabulary(self.vocabulary)
        self.learn((group, pieces.lattice(group)) for group in _by_length([w for w in dict.fromkeys(words) if w not in self.rows]))
        index = np.fromiter(map(self.rows.__getitem__, words), np.int64, len(words))
        starts = np.cumsum([0, *map(len, found[:-1])])
        sums = np.add.reduceat(self.table[index], starts)
        return sums[:, :-1], sums[:, -1]

    def segment(self, texts: list[str | None]) -> list[list[tuple[int, int, int, float]]]:
        """For each text (start, end, language, confidence) of each longest run of sentences of one language; none where no sentence has a letter or the model has no language."""
        spans, found, per = [], [], []
        for t in texts if self.languages else ():
            n = len(spans)
            for a, b in sentences(t) if t else ():
                ws = words(t[a:b])
                if ws:
                    spans.append((a, b))
                    found.append(ws)
            per.append((n, len(spans)))
        if max(len(self.rows), len(self.spelt)) > CACHE_WORDS:
            self.forget()
        spelt = self.spelt
        for w in {w for ws in found for w in ws}:
            if w not in spelt:
                spelt[w] = unit(w)
        gain, size = self.gains([[spelt[w] for w in ws] for ws in found])
        best = gain.argmax(1) if len(gain) else gain
        out = [[] for _ in texts] if not self.languages else []
        for a, b in per:
            runs = []
            if a < b:
                # where every sentence is likeliest in one language, that is the best path
                lang = best[a:b] if (best[a:b] == best[a]).all() else _best_path(gain[a:b])
                ends = [*(np.flatnonzero(lang[1:] != lang[:-1]) + 1).tolist(), b - a]
                i = 0
                for j in ends:
                    total = gain[a + i : a + j].sum(0) / math.sqrt(size[a + i : a + j].sum())  # words of a text are not independent
                    share = np.exp(total - total.max())
                    k = int(lang[i])
                    runs.append((spans[a + i][0], spans[a + j - 1][1], k, float(share[k] / share.sum())))
                    i = j
            out.append(runs)
        return out

    def segments(self, text: str) -> list[tuple[int, int, int, float]]:
        """The segments of one text."""
        return self.segment([text])[0]


def _best_path(gain: np.ndarray) -> np.ndarray:
    """The languages of sentences that together say most, where each change costs SWITCH_COST."""
    n, k = gain.shape
    back = np.empty((n, k), np.int64)
    best = gain[0]
    for i in range(1, n):
        top = int(best.argmax())
        change = best[top] - SWITCH_COST
        back[i] = np.where(best >= change, np.arange(k), top)
        best = np.maximum(best, change) + gain[i]
    lang = np.empty(n, np.int64)
    lang[-1] = best.argmax()
    for i in range(n - 1, 0, -1):
        lang[i - 1] = back[i, lang[i]]
    return lang


def _in_script(words: list[str], script: str | None) -> bool:
    """Whether at least half of the words begin in the script; true for a script that is not listed."""
    names = SCRIPT_NAMES.get(script or "")
    return names is None or 2 * sum(unicodedata.name(w.strip()[0], "").startswith(names) for w in words) >= len(words)


def _prior(languages: list[tuple[str, str | None]], pieces: dict[str, int]) -> np.ndarray:
    """Where a language has little text: pieces of its script alike, others seldom."""
    names = sorted({n for v in SCRIPT_NAMES.values() for n in v})
    of = np.zeros(len(pieces), np.int32)
    for p, i in pieces.items():
        c = chr(int(p[1:]) << 7 | 0x40) if p[0] == "\0" else p.strip()[:1]
        name = unicodedata.name(c, "") if c else ""
        of[i] = 1 + next((k for k, n in enumerate(names) if name.startswith(n)), -1)
    out = np.full((len(of), len(languages)), 0.02)
    for k, (_, script) in enumerate(languages):
        own = [1 + names.index(n) for n in SCRIPT_NAMES.get(script or "", ())]
        out[np.isin(of, own), k] = 1.0
    return out / out.sum(0)


def fit(labelled: list[tuple[str, str]], languages: list[tuple[str, str | None]], vocabulary: str = VOCABULARY) -> Model:
    """A model of (text, code) pairs for the languages given as (code, script).

    Labels may be wrong and documents mixed. So sentences in another script
    than the language's are left out, and after a fit those that the model
    gives to another language than their document's label, before it is fitted
    again. A language without any text left has its script alone.
    """
    path = vocabulary_path(vocabulary)
    pieces = _vocabulary(path)
    codes = [c for c, _ in languages]
    number = {c: i for i, c in enumerate(codes)}
    scripts = dict(languages)
    told = [(u, number[c]) for t, c in labelled if c in number for a, b in sentences(t) if (u := [unit(w) for w in words(t[a:b])]) and _in_script(u, scripts[c])]
    said, of = [u for u, _ in told], np.array([k for _, k in told], np.int64)
    prior = _prior(languages, pieces.number)
    model = Model(codes, path, np.vstack([prior, np.zeros((1, len(codes)))]))
    lattices = [(g, pieces.lattice(g)) for g in _by_length(list(dict.fromkeys(w for u in said for w in u)))]
    for clean in (False, True, True):
        counts = [Counter() for _ in codes]
        model.forget()
        if clean:
            model.learn(lattices)
        kept = (model.gains(said)[0].argmax(1) == of) if clean and said else np.ones(len(said), bool)
        for s, k, keep in zip(said, of.tolist(), kept.tolist(), strict=True):
            if keep:
                counts[k].update(s)
        groups = [(grid, np.array([[c[w] for c in counts] for w in g], float)) for g, grid in lattices]
        for _ in range(ROUNDS):
            expected = np.zeros_like(model.prob)
            for grid, weight in groups:
                _expect(grid, model.prob, weight, expected)
            smooth = expected[:-1] + 50.0 * prior
            model.prob[:-1] = smooth / smooth.sum(0)
    model.forget()
    return model


def _expect(grid: np.ndarray, prob: np.ndarray, weight: np.ndarray, expected: np.ndarray) -> None:
    """Adds the expected uses of each piece over all segmentations of the words, weighted by their counts."""
    words, n, width = grid.shape
    alpha, raised = _forward(grid, prob)
    beta, lifted = np.zeros_like(alpha), np.zeros_like(raised)
    beta[:, n] = 1.0
    for i in range(n - 1, -1, -1):
        lifted[:, i] = lifted[:, i + 1]
        for length in range(1, min(width, n - i) + 1):
            beta[:, i] += beta[:, i + length] * prob[grid[:, i, length - 1]]
        if i % 8 == 0 and (low := beta[:, i] < TINY).any():
            beta[:, i : i + width] *= np.where(low, 1 / TINY, 1.0)[:, None]
            lifted[:, i : i + width] += low[:, None]
    share = weight / np.maximum(alpha[:, n], 1e-300)
    plain_scale = not raised.any() and not lifted.any()
    for i in range(n):
        for length in range(1, min(width, n - i) + 1):
            ids = grid[:, i, length - 1]
            at = ids >= 0
            if at.any():
                after = beta[:, i + length] if plain_scale else beta[:, i + length] * np.power(TINY, (raised[:, i] + lifted[:, i + length] - raised[:, n]).astype(float))
                np.add.at(expected, ids[at], (alpha[:, i] * prob[ids] * after * share)[at])


def label_codes(label: Column, languages: list[tuple[str, str]]) -> Column:
    """The code a label names: the code itself or the English name, in any letter case, with a region or not; else null."""
    names = {c.lower(): c for c, _ in languages} | {n.lower(): c for c, n in languages if n}
    key = F.lower(trimmed(label))
    table = F.create_map(*[F.lit(x) for kv in sorted(names.items()) for x in kv]) if names else None
    if table is None:
        return F.lit(None).cast("string")
    return F.coalesce(F.try_element_at(table, key), F.try_element_at(table, F.regexp_extract(key, r"^([a-z]{2,3})[-_][a-z0-9_-]+$", 1)))


def language_rows(languages: DataFrame) -> list[tuple[str, str, str | None]]:
    """(code, name, script) of each language with a code, in order of code. The table is a dimension of at most MAX_LANGUAGES rows."""
    rows = languages.filter("code IS NOT NULL AND trim(code) <> ''").select("code", "name", "script").limit(MAX_LANGUAGES + 1).collect()
    if len(rows) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    return sorted({r.code: (r.code, r["name"], r.script) for r in rows}.values())


def labelled_sample(
    docs: DataFrame, doc_id: str, text: str, label: Column, languages: int = 1, per_language: int = SAMPLE_DOCS, max_chars: int = SAMPLE_CHARS, total_chars: int = SAMPLE_TOTAL
) -> list[tuple[str, str]]:
    """(text, code) of at most ``per_language`` documents a language, drawn by a hash of the id, with at most ``total_chars`` among ``languages``.

    The ids are drawn first, each task keeping its own first ones, and only
    then are texts read. The sample fits a model and no result depends on the
    rest of it.
    """
    d = docs.select(F.col(doc_id).alias("_id"), label.alias("_code"), F.length(text).alias("_n")).filter(F.col("_code").isNotNull() & F.col("_n").between(20, max_chars))
    place = F.row_number().over(Window.partitionBy("_code").orderBy(F.xxhash64("_id"), "_id"))
    drawn = d.select("_id", "_code", "_n", place.alias("_p")).filter(F.col("_p") <= per_language)
    so_far = F.sum("_n").over(Window.partitionBy("_code").orderBy("_p").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    drawn = drawn.select("_id", "_code", so_far.alias("_s")).filter(F.col("_s") <= total_chars // max(languages, 1)).select("_id", "_code")
    rows = docs.select(F.col(doc_id).alias("_id"), F.col(text).alias("_text")).join(F.broadcast(drawn), "_id").filter(F.length("_text") <= max_chars).select("_text", "_code", "_id")
    return [(r[0], r[1]) for r in sorted(rows.collect(), key=lambda r: (r[2], r[0]))]


SEGMENTS = "seg_no int, n_segments int, lang string, confidence double, seg_start int, seg_end int"


def segment_languages(docs: DataFrame, keys: list[str], text: str, model: Model) -> DataFrame:
    """(keys, seg_no, n_segments, lang, confidence, seg_start, seg_end): the segments of each text, numbered from 1.

    A segment is a longest run of whole sentences of one language; its bounds
    are characters of the text. Null and blank texts and texts without letters
    have none. Confidence is the posterior of the language with the evidence
    of n words counted as that of their root. There is no shuffle.
    """
    kept = docs.select(*keys, F.col(text).alias("_text"))
    schema = T.StructType([*kept.schema.fields[:-1], *T._parse_datatype_string(SEGMENTS).fields])
    sent = docs.sparkSession.sparkContext.broadcast((model.languages, model.vocabulary, model.prob))
    n = len(keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = Model(*sent.value)
        for b in batches:
            rows, at = [], []
            texts = b.column(n).to_pylist()
            for lo in range(0, len(texts), 500):  # many texts' words are scored at once, not many texts' arrays kept
                for i, path in enumerate(m.segment(texts[lo : lo + 500])):
                    for k, seg in enumerate(path, 1):
                        rows.append((k, len(path), m.languages[seg[2]], seg[3], seg[0], seg[1]))
                        at.append(lo + i)
            cols = list(zip(*rows, strict=True)) or [()] * 6
            kinds = (pa.int32(), pa.int32(), pa.string(), pa.float64(), pa.int32(), pa.int32())
            yield pa.RecordBatch.from_arrays(
                [*[b.column(i).take(pa.array(at, pa.int32())) for i in range(n)], *[pa.array(c, k) for c, k in zip(cols, kinds, strict=True)]], names=schema.names
            )

    return kept.mapInArrow(run, schema)


def document_languages(segments: DataFrame, doc_id: str) -> DataFrame:
    """(doc_id, lang, confidence, n_segments): the language of most of a document's characters, the first code among ties."""
    per = segments.groupBy(doc_id, "lang").agg(F.sum(F.col("seg_end") - F.col("seg_start")).alias("n"), F.max("confidence").alias("confidence"), F.count("*").alias("s"))
    return per.groupBy(doc_id).agg(F.min_by(F.struct("lang", "confidence"), F.struct(-F.col("n"), F.col("lang"))).alias("b"), F.sum("s").cast("int").alias("n_segments")).select(doc_id, "b.lang", "b.confidence", "n_segments")
