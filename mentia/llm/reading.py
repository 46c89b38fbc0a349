"""Problem 10: the level a reader needs for each document.

A proportional-odds model with ridge penalty over lexical diversity, word rarity, connectives, a proxy
of clause depth and lengths, fitted in numpy on the texts graded by hand. Counts of words come from all
documents, in a sketch of fixed size, so that rarity costs one small copy an executor however large the
corpus is. Texts are scanned in blocks, by the classes of their characters, and no text is cut.
"""

from __future__ import annotations

import functools
import itertools
import math
import re
import sys
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import xxhash
from pyspark.sql import DataFrame, functions as F

#: Rows and cells of the sketch of word counts: 8 MB however many words there are. A word's count is the least of its cells.
ROWS, CELL_BITS = 2, 20
CELLS = 1 << CELL_BITS
#: Most graded documents that the model is fitted on, taken by the hash of their id.
MAX_GRADED = 20_000
MIN_LETTERS, BANDS = 10, (1, 2, 3)
RIDGE, STEPS = 1e-2, 400
#: Characters of the texts that are scanned at once, beside those of the first of them.
BLOCK = 1 << 18
WINDOW = 60
_WORD, _SENTENCE = re.compile(r"[^\W\d_]+"), re.compile(r"[.!?…]+(?:\s|$)|\n+")
_LETTER, _DIGIT, _SPACE, _STOP, _CLAUSE, _LINE = (1 << i for i in range(6))

# Words that join clauses, by language.
CONNECTIVES = {
    "en": "because although though whereas while since unless therefore thereby however moreover nevertheless notwithstanding insofar whereby which whose given considering despite irrespective",
    "vi": "vì nên tuy dù mặc nhưng mà rằng trong khi bởi nếu nhằm qua đó theo hơn nữa tuy nhiên do bất kể xét giả sử",
    "es": "porque aunque mientras pues sino por tanto embargo además cuando pese según cuyo cuya habida supuesto medida que si bien no obstante",
    "de": "weil obwohl während da sofern daher jedoch außerdem dennoch wobei wodurch dass deren dessen soweit gleichwohl ungeachtet indem nachdem",
    "fr": "parce bien quoique tandis puisque car donc cependant néanmoins lorsque selon dont lequel laquelle pour autant quand nonobstant afin alors",
}
_JOINING = frozenset(w for words in CONNECTIVES.values() for w in words.split())
FEATURES = ("log_words", "word_letters", "long_words", "very_long_words", "diversity", "rarity", "rare_share", "rarity_spread", "connectives", "clauses", "log_sentence", "sentence_spread", "digits", "hapax")


def cells(word: str) -> list[int]:
    """Place of a word in each row of the sketch, the rows one after another."""
    h = xxhash.xxh64_intdigest(word.encode("utf-8", "surrogatepass"))
    return [row * CELLS + (h >> row * CELL_BITS & CELLS - 1) for row in range(ROWS)]


@functools.cache
def _classes() -> np.ndarray:
    """Classes of every code point, as the patterns see them."""
    every, out = np.arange(sys.maxunicode + 1, dtype="<u4").tobytes().decode("utf-32-le", "surrogatepass"), np.zeros(sys.maxunicode + 1, np.uint8)
    for flag, pattern in ((_LETTER, _WORD), (_DIGIT, re.compile(r"\d+")), (_SPACE, re.compile(r"\s+"))):
        for m in pattern.finditer(every):
            out[m.start() : m.end()] |= flag
    for flag, characters in ((_STOP, ".!?…"), (_CLAUSE, ",;:()–—"), (_LINE, "\n")):
        out[[ord(c) for c in characters]] |= flag
    return out


def _blocks(texts: list[str]) -> Iterator[list[str]]:
    """All texts in their order, parted by BLOCK characters."""
    ends = np.cumsum([len(t) for t in texts]) // BLOCK
    at = 0
    for _, group in itertools.groupby(ends.tolist()):
        until = at + sum(1 for _ in group)
        yield texts[at:until]
        at = until


class Scan:
    """Words of a block of texts in lower case, one text after another, and what each text has beside them.

    Texts are joined by line ends, which end words and sentences. A sentence ends at a stop before white space, or
    at a line end; one without words counts nothing.
    """

    def __init__(self, texts: list[str]):
        lower = [t.lower() for t in texts]
        codes = np.frombuffer("\n".join([*lower, ""]).encode("utf-32-le", "surrogatepass"), "<u4")
        ends = np.cumsum([len(t) + 1 for t in lower])
        kinds = _classes()[codes]
        letter = (kinds & _LETTER).view(bool)
        self.words = str(np.where(letter, codes, 32).astype("<u4", copy=False), "utf-32-le").split()
        starts = np.flatnonzero(np.diff(letter.view(np.int8), prepend=np.int8(0)) == 1)
        until = np.searchsorted(starts, ends)
        self.counts = np.diff(until, prepend=0)
        self.clauses, self.digits = (np.diff(np.searchsorted(np.flatnonzero(kinds & flag), ends), prepend=0) for flag in (_CLAUSE, _DIGIT))
        self._ends, self._starts, self._until, self._kinds = ends, starts, until, kinds
        # the one letter whose lower case is cut in two by a mark
        self._cut = [i for i, t in enumerate(texts) if "İ" in t]
        self._texts = texts

    def sentences(self) -> tuple[np.ndarray, np.ndarray]:
        """Mean and spread of the words a sentence, by text."""
        mean, spread = np.zeros(len(self.counts)), np.zeros(len(self.counts))
        some = self.counts > 0
        if some.any():
            kinds = self._kinds
            stops = np.flatnonzero(kinds & _STOP)
            ends = np.zeros(len(kinds), np.int8)
            ends[stops[kinds[stops + 1] & _SPACE != 0]] = 1
            ends[kinds & _LINE != 0] = 1
            place = np.cumsum(ends, dtype=np.int32)[self._starts]
            first = np.flatnonzero(np.diff(place, prepend=-1))
            lengths = np.diff(first, append=len(place)).astype(float)
            of_text = np.searchsorted(first, (self._until - self.counts)[some])
            n = np.diff(of_text, append=len(lengths))
            mean[some] = np.add.reduceat(lengths, of_text) / n
            spread[some] = np.sqrt(np.add.reduceat((lengths - np.repeat(mean[some], n)) ** 2, of_text) / n)
        for i in self._cut:
            lengths = np.array([k for part in _SENTENCE.split(self._texts[i]) if (k := len(_WORD.findall(part)))] or [0], float)
            mean[i], spread[i] = lengths.mean(), lengths.std()
        return mean, spread


def _plain(text: str) -> list[str]:
    return Scan([text]).words


#: Words a worker remembers.
KNOWN = 300_000


def word_counts(documents: DataFrame, text: str = "text") -> np.ndarray:
    """Occurrences of the words of all documents, in the rows of a sketch."""
    import pyarrow as pa

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, met = np.zeros(ROWS * CELLS, np.int64), Counter()

        def add() -> None:
            if met:
                # as long as the places: values that are broadcast are added wrongly by NumPy 2.3
                np.add.at(sums, np.array([cells(word) for word in met]).ravel(), np.repeat(np.fromiter(met.values(), np.int64, len(met)), ROWS))
            met.clear()

        for batch in batches:
            for block in _blocks([value for value in batch.column(0).to_pylist() if value]):
                met.update(Scan(block).words)
                if len(met) > KNOWN:
                    add()
        add()
        at = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(sums[at], pa.int64())], ["cell", "n"])

    rows = documents.select(text).mapInArrow(run, "cell int, n bigint").groupBy("cell").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(ROWS * CELLS)
    out[rows["cell"].to_numpy(np.int64)] = rows["n"].to_numpy(float)
    return out


class Words(dict):
    """Numbers of the words that a worker has met, with their facts as arrays: length, rarity, whether they join clauses."""

    def __init__(self, rarity: np.ndarray):
        super().__init__()
        self.rarity, self.facts, self.new = rarity, np.zeros((3, KNOWN)), []

    def __missing__(self, word: str) -> int:
        at = self[word] = len(self)
        self.new.append(word)
        return at

    def of(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(number of each word, their facts)."""
        if len(self) + len(words) > self.facts.shape[1]:
            self.clear()
            if len(words) > self.facts.shape[1]:
                self.facts = np.zeros((3, len(words)))
        numbers = np.fromiter(map(self.__getitem__, words), np.int64, len(words))
        if self.new:
            met = slice(len(self) - len(self.new), len(self))
            self.facts[0, met] = [len(w) for w in self.new]
            self.facts[1, met] = self.rarity[np.array([cells(w) for w in self.new])].max(1)
            self.facts[2, met] = [w in _JOINING for w in self.new]
            self.new.clear()
        return numbers, self.facts[:, numbers]


def _last_and_only(numbers: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place of each word's last occurrence before it in its text or -1, whether it has no other there)."""
    order = np.argsort((numbers & 0xFFFF).astype(np.uint16), kind="stable")  # 16 bits are sorted by radix
    if numbers.max() > 0xFFFF:
        order = order[np.argsort((numbers[order] >> 16).astype(np.uint16), kind="stable")]
    a, b = order[:-1], order[1:]
    again = (numbers[a] == numbers[b]) & (owner[a] == owner[b])
    last, only = np.full(len(numbers), -1), np.ones(len(numbers), bool)
    last[b[again]] = a[again]
    only[a[again]] = only[b[again]] = False
    return last, only


def _diversity(last: np.ndarray, n: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Mean share of different words over windows of whole texts: 60 words each, the last one ends at the last word."""
    beyond, length = np.maximum(n - WINDOW, 0), np.minimum(n, WINDOW)
    windows = -(-beyond // WINDOW) + 1
    of_text = np.cumsum(windows) - windows
    owner = np.repeat(np.arange(len(n)), windows)
    nth = np.arange(len(owner)) - of_text[owner]
    start = first[owner] + np.minimum(nth * WINDOW, beyond[owner])
    size = length[owner]
    of_window = np.cumsum(size) - size
    new = last[np.arange(size.sum()) + np.repeat(start - of_window, size)] < np.repeat(start, size)
    return np.add.reduceat(np.add.reduceat(new, of_window, dtype=np.int64), of_text) / windows / length


def feature_rows(texts: list[str], known: Words) -> np.ndarray:
    """FEATURES of each text. The rarity of a word is the highest of its cells' surprises."""
    return np.concatenate([np.zeros((0, len(FEATURES))), *(_block_features(block, known) for block in _blocks(texts))])


def _block_features(texts: list[str], known: Words) -> np.ndarray:
    scan = Scan(texts)
    out, n = np.zeros((len(texts), len(FEATURES))), np.maximum(scan.counts, 1)
    column = dict(zip(FEATURES, out.T))
    mean, spread = scan.sentences()
    column["log_words"][:] = np.log1p(n)
    column["clauses"][:], column["digits"][:] = scan.clauses / n, scan.digits / n
    column["log_sentence"][:], column["sentence_spread"][:] = np.log1p(mean), np.log1p(spread)
    column["diversity"][:] = column["hapax"][:] = 1
    some = scan.counts > 0
    if some.any():
        n = n[some]
        first = np.cumsum(n) - n
        mean_of = lambda values: np.add.reduceat(values, first, dtype=float) / n
        numbers, (lengths, surprise, joins) = known.of(scan.words)
        last, only = _last_and_only(numbers, np.repeat(np.arange(len(n)), n))
        rarity = mean_of(surprise)
        for name, values in (
            ("word_letters", mean_of(lengths)),
            ("long_words", mean_of(lengths >= 9)),
            ("very_long_words", mean_of(lengths >= 12)),
            ("diversity", _diversity(last, n, first)),
            ("rarity", rarity),
            ("rare_share", mean_of(surprise > 9)),
            ("rarity_spread", np.sqrt(mean_of((surprise - np.repeat(rarity, n)) ** 2))),
            ("connectives", mean_of(joins)),
            ("hapax", mean_of(only)),
        ):
            column[name][some] = values
    return out


def features(text: str, known: Words) -> list[float]:
    """FEATURES of one text."""
    return feature_rows([text], known)[0].tolist()


@dataclass
class OrdinalModel:
    """Proportional odds: P(band <= k) = 1 / (1 + exp(-(cut_k - x.w)))."""

    mean: np.ndarray
    scale: np.ndarray
    weight: np.ndarray
    cuts: np.ndarray

    def bands(self, x: np.ndarray) -> np.ndarray:
        score = expand((x - self.mean) / self.scale) @ self.weight
        below = 1 / (1 + np.exp(np.clip(score[:, None] - self.cuts[None, :], -50, 50)))
        p = np.diff(np.concatenate([np.zeros((len(x), 1)), below, np.ones((len(x), 1))], axis=1), axis=1)
        return np.array(BANDS)[p.argmax(1)]


def expand(z: np.ndarray) -> np.ndarray:
    """Standardised features with their squares and products: the lengths of words mean different things by language."""
    z = np.clip(z, -4, 4)
    i, j = np.triu_indices(z.shape[1])
    return np.concatenate([z, z[:, i] * z[:, j]], axis=1)


def fit(x: np.ndarray, band: np.ndarray, robust: bool = True) -> OrdinalModel:
    """Ridge-penalised maximum likelihood by accelerated gradient; grades that the first fit finds absurd count no more."""
    mean, scale = x.mean(0), x.std(0) + 1e-6
    z, y = expand((x - mean) / scale), np.searchsorted(BANDS, band)
    n, d = z.shape
    spread = z.std(0) + 1e-6
    z = z / spread
    weight, cuts = np.zeros(d), np.array([-1.0, 1.0])
    keep = np.ones(n)
    for _ in range(2 if robust else 1):
        mw, mc, vw, vc = np.zeros(d), np.zeros(2), np.zeros(d), np.zeros(2)
        for t in range(1, STEPS + 1):
            s = z @ weight
            edges = np.concatenate([np.full((n, 1), -1e9), cuts[None, :] - s[:, None], np.full((n, 1), 1e9)], axis=1)
            f = 1 / (1 + np.exp(-np.clip(edges, -40, 40)))
            hi, lo = f[np.arange(n), y + 1], f[np.arange(n), y]
            p = np.maximum(hi - lo, 1e-9)
            ghi, glo = hi * (1 - hi) / p * keep, lo * (1 - lo) / p * keep
            gs = (ghi - glo) / n
            gw = z.T @ gs + RIDGE * weight
            gc = np.array([-(ghi[y == k].sum() - glo[y == k + 1].sum()) / n for k in (0, 1)])
            mw, vw = 0.9 * mw + 0.1 * gw, 0.99 * vw + 0.01 * gw**2
            mc, vc = 0.9 * mc + 0.1 * gc, 0.99 * vc + 0.01 * gc**2
            rate = 0.05 * (1 - 0.9 * t / STEPS)
            weight = weight - rate * (mw / (1 - 0.9**t)) / (np.sqrt(vw / (1 - 0.99**t)) + 1e-8)
            cuts = np.sort(cuts - rate * (mc / (1 - 0.9**t)) / (np.sqrt(vc / (1 - 0.99**t)) + 1e-8))
        keep = np.where(p < 0.05, 0.0, 1.0)
    return OrdinalModel(mean, scale, weight / spread, cuts)


def _feature_rows(documents: DataFrame, key: str, text: str, surprise, finish, ddl: str, carry: list[str] = []) -> DataFrame:
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    schema = to_arrow_schema(StructType.fromDDL(ddl))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Words(surprise.value)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            yield pa.RecordBatch.from_arrays([batch.column(0), *(batch.column(2 + i) for i in range(len(carry))), finish(feature_rows(texts, known))], schema=schema)

    return documents.select(F.col(key).cast("bigint").alias("id"), text, *carry).mapInArrow(run, ddl)


def graded(documents: DataFrame, text: str = "text") -> DataFrame:
    """Documents with enough letters to have a level."""
    return documents.filter(F.col(text).rlike(rf"^(?:\P{{L}}*+\p{{L}}){{{MIN_LETTERS}}}"))


def reading_bands(documents: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", limit: int = MAX_GRADED) -> DataFrame:
    """(key, band bigint) of every document with at least ten letters.

    ``labels`` has (key, band); grades of documents that don't exist or have no level are ignored. Null,
    empty and letterless texts have no row; repeated rows each have one. Without any grades the result
    is empty, as there is no scale.
    """
    import pyarrow as pa

    sc = documents.sparkSession.sparkContext
    usable = graded(documents)
    counts = word_counts(documents, text)
    surprise = sc.broadcast((math.log(counts.sum() / ROWS + 1) - np.log(counts + 1)).astype(np.float32))
    grades = labels.filter(F.col("band").isin(*BANDS)).select(F.col(key), F.col("band").cast("bigint").alias("band")).orderBy(F.xxhash64(key), "band").limit(limit)
    width = len(FEATURES)
    as_list = lambda x: pa.ListArray.from_arrays(pa.array(np.arange(0, (len(x) + 1) * width, width), pa.int32()), pa.array(x.ravel(), pa.float64()))
    # the grades are few, so they go to the texts
    sample = _feature_rows(usable.select(key, text).join(F.broadcast(grades), key), key, text, surprise, as_list, "id bigint, band bigint, x array<double>", ["band"]).toPandas()
    if sample.empty:
        return documents.select(F.col(key), F.lit(0).cast("bigint").alias("band")).limit(0)
    sample = sample.sort_values(["id", "band"])
    model = sc.broadcast(fit(np.stack(sample["x"].to_numpy()), sample["band"].to_numpy()))
    bands = lambda x: pa.array(model.value.bands(x) if len(x) else [], pa.int64())
    return _feature_rows(usable, key, text, surprise, bands, "id bigint, band bigint").withColumnRenamed("id", key)
