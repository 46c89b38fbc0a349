"""Problem 5: missing or wrong language labels, and foreign lines inside a document.

A text is the mean of the embeddings of its hashed subwords, followed by a linear softmax; both are
trained by stochastic gradient descent in numpy on a bounded sample of labelled documents. Confidences
are calibrated by a temperature on held-out pieces, and a piece under the confidence that keeps the
held-out error small is rejected: it says nothing against the language around it.
"""

from __future__ import annotations

import re
import unicodedata
import zlib
from collections import Counter
from collections.abc import Iterable
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame, functions as F

LANGUAGES = ("en", "vi", "es", "de", "fr")
BUCKETS, DIM = 1 << 16, 16
#: Most labelled documents that the model is fitted on, taken by the hash of their id.
SAMPLE_DOCUMENTS = 2000
EPOCHS, RATE, BATCH = 4, 0.25, 64
#: Words of an average training piece, and the bounds of a text's evidence in pieces.
PIECE_WORDS, EVIDENCE = 8, (0.5, 8.0)
#: Share of wrong pieces among the accepted ones that the rejection aims at.
ACCEPTED_ERROR = 0.01
#: Confidence from which a document's language counts: held-out texts of the five languages have 0.77 and more, most of others under 0.5.
MAIN_ACCEPT = 0.6
#: A line is foreign where its language is this many times as likely as the document's: few lines are.
FOREIGN_ODDS = 33.0
#: Words besides names from which a line can be foreign.
FOREIGN_WORDS = 3
#: Words a worker remembers.
CACHE = 200_000
_WORD = re.compile(r"[^\W\d_]+")

# The codes and names of the languages in tags.
TAG_NAMES = {
    "en": ["en", "eng", "english", "anglais", "inglés", "ingles", "englisch"],
    "vi": ["vi", "vie", "vietnamese", "vietnamien", "vietnamita", "vietnamesisch", "tiếng việt", "tieng viet", "việt", "viet"],
    "es": ["es", "spa", "spanish", "español", "espanol", "castellano", "espagnol", "spanisch"],
    "de": ["de", "deu", "ger", "german", "deutsch", "allemand", "alemán", "aleman"],
    "fr": ["fr", "fra", "fre", "french", "français", "francais", "francés", "frances", "französisch"],
}
TAG_CODES = {name: code for code, names in TAG_NAMES.items() for name in names}


def tag_code(tag: str | None) -> str | None:
    """Language code that a tag names in any notation, None where it names none of LANGUAGES."""
    if not tag:
        return None
    low = " ".join(unicodedata.normalize("NFC", tag).lower().split())
    return TAG_CODES.get(low) or TAG_CODES.get(re.split(r"[-_.@ ;(]", low)[0])


def subwords(word: str) -> list[int]:
    """Buckets of a word and of its runs of two to four letters, ends marked."""
    marked = f"<{word}>"
    grams = [marked] + [marked[i : i + n] for n in (2, 3, 4) for i in range(len(marked) - n + 1) if n < len(marked)]
    return [zlib.crc32(g.encode("utf-8", "surrogatepass")) & (BUCKETS - 1) for g in grams]


def spoken(text: str, vocabulary: frozenset) -> list[str]:
    """Lower-case words of a text without its names: capitalised words that are never met in lower case."""
    out = []
    for word in _WORD.findall(text):
        low = word.lower()
        if word == low or low in vocabulary:
            out.append(low)
    return out


def unmarked(text: str) -> str:
    """A text without diacritics, as some people type it."""
    plain = "".join(c for c in unicodedata.normalize("NFD", text) if not unicodedata.combining(c))
    return plain.replace("đ", "d").replace("Đ", "D")


@dataclass
class LanguageModel:
    """The trained table: one row of scores a bucket, which is its embedding times the softmax weights."""

    table: np.ndarray
    bias: np.ndarray
    temperature: float = 1.0
    accept: float = 0.6
    vocabulary: frozenset = frozenset()
    known: dict = field(default_factory=dict, repr=False)

    def __getstate__(self):
        return {**self.__dict__, "known": {}}

    def scores(self, texts: list[str]) -> np.ndarray:
        """Probabilities, a row a text; even where a text has no words."""
        sums, counts = np.zeros((len(texts), len(LANGUAGES))), np.zeros(len(texts))
        rows, owner, lengths = [], [], np.zeros(len(texts))
        for i, text in enumerate(texts):
            found = spoken(text, self.vocabulary)
            lengths[i] = len(found)
            owner += [i] * len(found)
            for word in found:
                row = self.known.get(word)
                if row is None:
                    at = subwords(word)
                    row = (*self.table[at].sum(0), len(at))
                    if len(self.known) >= CACHE:
                        self.known.clear()
                    self.known[word] = row
                rows.append(row)
        if rows:
            data, owner = np.array(rows), np.array(owner)
            for c in range(len(LANGUAGES)):
                sums[:, c] = np.bincount(owner, data[:, c], len(texts))
            counts = np.bincount(owner, data[:, -1], len(texts))
        # the temperature is that of a training piece; evidence adds up over the pieces of a longer text
        evidence = np.clip(lengths / PIECE_WORDS, *EVIDENCE)[:, None]
        logits = (sums / np.maximum(counts, 1)[:, None] + self.bias) / self.temperature * evidence
        logits[counts == 0] = 0
        e = np.exp(logits - logits.max(1, keepdims=True))
        return e / e.sum(1, keepdims=True)

    def label(self, texts: list[str]) -> list[tuple[str, float]]:
        """(language, confidence) of each text."""
        p = self.scores(texts)
        return [(LANGUAGES[k], float(p[i, k])) for i, k in enumerate(p.argmax(1))]


def pieces(text: str, rng: np.random.Generator) -> Iterable[str]:
    """Runs of three to fifteen words of a text, one in three without diacritics."""
    found = text.split()
    at = 0
    while at < len(found):
        n = int(rng.integers(3, 16))
        piece = " ".join(found[at : at + n])
        yield unmarked(piece) if rng.random() < 1 / 3 else piece
        at += n


def train(labelled: list[tuple[str, str]], seed: int = 7, per_document: int = 4) -> LanguageModel:
    """The model of (text, language) pairs. A twentieth of the pieces is held out for calibration."""
    rng = np.random.default_rng(seed)
    data: list[tuple[np.ndarray, int]] = []
    met = Counter(w for text, _ in labelled for w in _WORD.findall(text) if w.islower())
    vocabulary = frozenset(x for w, n in met.items() if n > 1 for x in (w, unmarked(w)))
    memo: dict[str, list[int]] = {}
    for text, language in labelled:
        if language not in LANGUAGES:
            continue
        cut = list(pieces(text, rng))
        for k in rng.permutation(len(cut))[:per_document]:
            at = [b for w in spoken(cut[k], vocabulary) for b in (memo.get(w) or memo.setdefault(w, subwords(w)))]
            if at:
                data.append((np.array(at, np.int64), LANGUAGES.index(language)))
    classes = len(LANGUAGES)
    if not data:
        return LanguageModel(np.zeros((BUCKETS, classes), np.float32), np.zeros(classes))
    order = rng.permutation(len(data))
    held, kept = order[: max(1, len(data) // 20)], order[len(data) // 20 :]
    embed = rng.normal(0, 1 / DIM, (BUCKETS, DIM)).astype(np.float32)
    weight, bias = rng.normal(0, 0.5, (DIM, classes)).astype(np.float32), np.zeros(classes, np.float32)
    steps, done = EPOCHS * (len(kept) // BATCH + 1), 0
    for _ in range(EPOCHS):
        kept = rng.permutation(kept)
        for at in range(0, len(kept), BATCH):
            batch = [data[i] for i in kept[at : at + BATCH]]
            sizes = np.array([len(x) for x, _ in batch])
            flat, owner = np.concatenate([x for x, _ in batch]), np.repeat(np.arange(len(batch)), sizes)
            starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
            hidden = np.add.reduceat(embed[flat], starts, axis=0) / sizes[:, None]
            logits = hidden @ weight + bias
            p = np.exp(logits - logits.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            p[np.arange(len(batch)), [y for _, y in batch]] -= 1
            rate = RATE * (1 - done / steps)
            back = (p @ weight.T).astype(np.float32)
            weight -= rate * hidden.T @ p / len(batch)
            bias -= rate * p.mean(0)
            # each subword takes the whole step of its text, as the mean spreads it thinly
            np.add.at(embed, flat, -rate * back[owner] * (8.0 / sizes[owner])[:, None])
            done += 1
    model = LanguageModel((embed @ weight).astype(np.float32), bias, vocabulary=vocabulary)
    return calibrate(model, [data[i] for i in held])


def calibrate(model: LanguageModel, held: list[tuple[np.ndarray, int]]) -> LanguageModel:
    """Temperature of least held-out loss; least confidence whose accepted pieces err at most ACCEPTED_ERROR."""
    logits = np.array([model.table[x].mean(0) + model.bias for x, _ in held])
    y = np.array([c for _, c in held])

    def soft(t: float) -> np.ndarray:
        e = np.exp(logits / t - (logits / t).max(1, keepdims=True))
        return e / e.sum(1, keepdims=True)

    loss = lambda t: -np.log(np.maximum(soft(t)[np.arange(len(y)), y], 1e-9)).mean()
    model.temperature = min(np.geomspace(0.05, 3, 60), key=loss)
    p = soft(model.temperature)
    right, top = p.argmax(1) == y, p.max(1)
    for level in np.arange(0.4, 0.96, 0.02):
        if (top >= level).sum() and (~right[top >= level]).mean() <= ACCEPTED_ERROR:
            model.accept = float(level)
            break
    else:
        model.accept = 0.8
    return model


def fit(documents: DataFrame, text: str = "text", label: str = "lang", key: str = "doc_id", limit: int = SAMPLE_DOCUMENTS) -> LanguageModel:
    """The model of at most ``limit`` labelled documents; the sample is the same in every run."""
    usable = documents.filter(F.col(label).isNotNull() & (F.length(text) >= 40)).withColumn("__at", F.xxhash64(key))
    # the sample is chosen by its hashes alone, so that no more than its texts travel to the driver
    chosen = usable.select("__at").orderBy("__at").limit(limit).agg(F.max("__at")).first()[0]
    rows = usable.filter(F.col("__at") <= F.lit(chosen)).select(F.col(text).alias("text"), F.col(label).alias("label")).collect() if chosen is not None else []
    rows.sort(key=lambda r: (r["text"], r["label"]))
    pairs = [(r["text"], tag_code(r["label"])) for r in rows]
    first = train([(t, c) for t, c in pairs if c])
    # labels are wrong here and there: what the first model contradicts with confidence is left out
    guess = first.label([t for t, _ in pairs])
    kept = [(t, c) for (t, c), (g, p) in zip(pairs, guess) if c and (g == c or p < 0.9)]
    return train(kept) if len(kept) < len(pairs) else first


def _groups(numbers: list[int], texts: list[str]) -> list[list[int]]:
    """Indexes of lines that belong together: a wrapped paragraph goes on where a line ends inside a sentence."""
    out: list[list[int]] = []
    for i, text in enumerate(texts):
        before = texts[i - 1] if i else ""
        if out and numbers[i] == numbers[i - 1] + 1 and len(before) >= 45 and not re.search(r"[.!?…:][\"'»”’)]*\s*$", before) and text:
            out[-1].append(i)
        else:
            out.append([i])
    return out


def languages_of(model: LanguageModel, numbers: list[int], texts: list[str]) -> tuple[str | None, float, float, list[dict]]:
    """(main language, its share of the text, the confidence in it, [{line_no, lang_code, confidence}] of the other lines).

    The confidence is the calibrated one of the paragraphs that speak for the language, by their lengths. Under
    MAIN_ACCEPT the main language is rejected: None, and no line is foreign to it.
    """
    if not texts:
        return None, 0.0, 0.0, []
    groups = _groups(numbers, texts)
    joined = [" ".join(texts[i] for i in g) for g in groups]
    p = model.scores(joined)
    best, top = p.argmax(1), p.max(1)
    sizes = np.array([len(t) for t in joined], float)
    sure = top >= model.accept
    weights = (p * sizes[:, None]).sum(0)
    main = int(weights.argmax())
    mine = best == main
    confidence = float((top * sizes)[mine].sum() / max(sizes[mine].sum(), 1)) if mine.any() else 0.0
    if confidence < MAIN_ACCEPT:
        return None, 0.0, confidence, []
    foreign = [
        {"line_no": numbers[i], "lang_code": LANGUAGES[best[k]], "confidence": float(top[k])}
        for k, g in enumerate(groups)
        if sure[k] and best[k] != main and p[k, best[k]] >= FOREIGN_ODDS * p[k, main] and len(spoken(joined[k], model.vocabulary)) >= FOREIGN_WORDS
        for i in g
    ]
    return LANGUAGES[main], float(weights[main] / max(weights.sum(), 1)), confidence, foreign


def foreign_and_main(pages: DataFrame, labelled: DataFrame, model: LanguageModel | None = None, counted: DataFrame | None = None) -> DataFrame:
    """(record_table, record_id, residue, lines, main, share, confidence, foreign) of documents_of rows.

    ``main`` is the language of most of an article's text and ``share`` its part of it; ``foreign`` has
    the lines of other languages with their confidence. Where residue stands in place of the article,
    or there is none, or the confidence is under MAIN_ACCEPT, ``main`` is null. ``labelled`` has the texts the model is fitted on,
    ``counted`` the documents whose lines are counted, if more than ``pages``.
    """
    from mentia.llm.style_tree import extract

    shared = pages.sparkSession.sparkContext.broadcast(model or fit(labelled))

    def each(numbers: list[int], texts: list[str]) -> tuple:
        return languages_of(shared.value, numbers, texts)

    return extract(pages, each, "main string, share double, confidence double, foreign array<struct<line_no:int,lang_code:string,confidence:double>>", counted)


def wrong_tags(df: DataFrame, tag: str, main: str) -> DataFrame:
    """Rows of ``df`` whose tag is missing or doesn't name the language ``main``, which isn't null."""
    low = F.lower(F.trim(F.regexp_replace(tag, r"[\s\u00a0]+", " ")))
    codes = F.create_map(*(F.lit(x) for pair in TAG_CODES.items() for x in pair))
    code = F.coalesce(F.element_at(codes, low), F.element_at(codes, F.element_at(F.split(low, r"[-_.@ ;(]"), 1)))
    return df.filter(F.col(main).isNotNull() & (code.isNull() | (code != F.col(main))))
