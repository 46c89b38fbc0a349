"""Problem 7: new batches deduplicated against everything accepted before.

The distance of two texts is 1 - LCS / length of the longer, over their words; LCS is the longest common
subsequence. Both it and the bag distance 1 - |common words| / length, which is never larger, are
metrics. The index keeps the texts in blocks, range-partitioned by their nearest pivot and by length, with
the bag distance of each text to every pivot. A block of a batch meets a stored block only where the
ranges of all their pivot distances and lengths come within the radius 0.4 of each other, and a pair of
texts only where their own distances do: the triangle inequality rules out all others. Distances to any
pivot are nearly alike among texts of this length, so within two blocks the common words of all pairs are
counted besides, over bits and inverted lists, which leaves out no pair within the radius; what is left is verified
by the exact distance. Blocks of history are read, never compared with each other and never written
again: the accepted rows of a batch are appended as blocks of their own.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import xxhash
from pyspark.sql import DataFrame, SparkSession, functions as F

from mentia.session import cut, scratch

RADIUS = 0.4
#: Words of a block of texts. Words of more than COMMON of a block's texts are kept as bits, others as lists of texts;
#: TOP x 64 bits are looked at first.
BLOCK, COMMON, TOP = 3_000_000, 0.02, 12
#: Pairs of blocks a task compares, one after another.
PAIRS = 2
#: Earlier neighbours that are verified of a text before its state is looked at; where more could follow, it is asked again.
FIRST = 16
# The pivots, common words of each language in the bag of an average text.
PIVOT_WORDS = (
    "the of a in to and on for with by that said at from after as was is it my",
    "de la el que en los un una por con se del para las al no su lo le mi",
    "der die das und in den von zu mit für auf ein eine im dem nicht sich ist ich mein",
    "le la de les et des un une en du pour que à dans sur par au il est mon",
    "của và là các cho một những được trong với người có không này đã khi từ đến về tôi",
)
INDEX = "id bigint, class bigint, n int, near int, pivots array<float>"
_PIVOT_BAGS = [{w: words.split().count(w) for w in words.split()} for words in PIVOT_WORDS]
_PIVOT_SIZES = [len(words.split()) for words in PIVOT_WORDS]
_PIVOT_ALL = frozenset(w for bag in _PIVOT_BAGS for w in bag)
#: Distance of the codes of two occurrences of one word.
_STEP = np.uint64(0x9E3779B97F4A7C15)


def split_words(text: str) -> list[str]:
    """Words of a text, case aside."""
    return text.lower().split()


def lcs_length(a: list, b: list) -> int:
    """Length of the longest common subsequence, bit-parallel."""
    if not a or not b:
        return 0
    at: dict = {}
    for i, word in enumerate(a):
        at[word] = at.get(word, 0) | (1 << i)
    full = (1 << len(a)) - 1
    row = full
    for word in b:
        hit = row & at.get(word, 0)
        if hit:
            row = ((row + hit) | (row - hit)) & full
    return len(a) - row.bit_count()


def lcs_share(a: list, b: list) -> float:
    """Length of the longest common subsequence over that of the longer list; 0 for two empty ones."""
    return lcs_length(a, b) / max(len(a), len(b), 1)


def pivot_distances(words: list[str]) -> list[float]:
    """Bag distance to each pivot: 1 less the common words over the length of the longer of the two."""
    met: dict[str, int] = {}
    for w in words:
        if w in _PIVOT_ALL:
            met[w] = met.get(w, 0) + 1
    return [1 - sum(min(met[w], k) for w, k in bag.items() if w in met) / max(len(words), size) for bag, size in zip(_PIVOT_BAGS, _PIVOT_SIZES)]


def _index(batches: Iterator) -> Iterator:
    import pyarrow as pa

    for batch in batches:
        out: dict[str, list] = {"id": batch.column(0).to_pylist(), "class": [], "n": [], "near": [], "pivots": []}
        for text in batch.column(1).to_pylist():
            words = split_words(text)
            pivots = pivot_distances(words)
            out["class"].append(xxhash.xxh64_intdigest(" ".join(words)) - (1 << 63))
            out["n"].append(len(words))
            out["near"].append(min(range(len(pivots)), key=pivots.__getitem__))
            out["pivots"].append(pivots)
        yield pa.RecordBatch.from_arrays([pa.array(out["id"], pa.int64()), pa.array(out["class"], pa.int64()), pa.array(out["n"], pa.int32()), pa.array(out["near"], pa.int32()), pa.array(out["pivots"], pa.list_(pa.float32()))], list(out))


def index_rows(df: DataFrame, key: str = "cand_id", text: str = "text") -> DataFrame:
    """INDEX rows of the texts that aren't null: their class of equal words, length and pivot distances."""
    return df.filter(F.col(text).isNotNull()).select(F.col(key).cast("bigint").alias("id"), F.col(text).alias("text")).mapInArrow(_index, INDEX)


# ---------------------------------------------------------------- blocks


BLOCKS = "block bigint, near int, length int, low int, high int, least array<float>, most array<float>, ids binary, sizes binary, pivots binary, words binary, places binary, seq binary"
HEADER = ["folder", "block", "near", "length", "low", "high", "least", "most"]


class _Numbers(dict):
    """A number for each word met."""

    def __missing__(self, word: str) -> int:
        at = self[word] = len(self)
        return at


def _block(key, rows):
    """One row with the texts of a block, by id: a word is a code of 64 bits, kept once, and its number in each text."""
    import pyarrow as pa

    rows = rows.sort_by("id")
    known, sizes, flat = _Numbers(), [], []
    for text in rows.column("text").to_pylist():
        words = split_words(text)
        sizes.append(len(words))
        flat.append(np.fromiter(map(known.__getitem__, words), np.int64, len(words)))
    word, owner = np.concatenate(flat), np.repeat(np.arange(len(sizes)), sizes)
    # the how-manieth of its word in its text each word is
    of = owner * len(known) + word
    order = np.argsort(of, kind="stable")
    ordered, at = of[order], np.arange(len(of))
    first = np.maximum.accumulate(np.where(np.r_[True, ordered[1:] != ordered[:-1]], at, 0))
    place = np.empty(len(of), np.int64)
    place[order] = at - first
    # an occurrence has a code of its own, so that equal bags have equal sets of codes
    codes = np.fromiter(map(xxhash.xxh64_intdigest, known), np.uint64, len(known))
    occurrences, seq = np.unique(word + place * len(known), return_inverse=True)
    words, places = codes[occurrences % len(known)], (occurrences // len(known)).astype(np.uint32)
    order = np.argsort(words + places * _STEP)
    back = np.empty(len(order), np.int32)
    back[order] = np.arange(len(order))
    pivots = np.array(rows.column("pivots").to_pylist(), np.float32)
    one = lambda x, kind: pa.array([x], kind)
    ends = [one(x.tolist(), pa.list_(pa.float32())) for x in (pivots.min(0), pivots.max(0))]
    packed = [rows.column("id").to_numpy().astype(np.int64), np.array(sizes, np.int32), pivots, words[order], places[order], back[seq]]
    head = [one(key[0].as_py(), pa.int64()), one(rows.column("near")[0].as_py(), pa.int32()), one(rows.column("length")[0].as_py(), pa.int32()), one(min(sizes), pa.int32()), one(max(sizes), pa.int32())]
    return pa.Table.from_arrays([*head, *ends, *[one(x.tobytes(), pa.binary()) for x in packed]], [c.split()[0] for c in BLOCKS.split(", ")])


def write_blocks(texts: DataFrame, index: DataFrame, folder: str) -> bool:
    """Store the ``texts`` (id, text) of the rows of ``index`` (id, n, near, pivots) as blocks below ``folder``; whether there were any."""
    width = -math.log(1 - RADIUS)
    index = index.filter("n > 0").withColumn("length", F.floor(F.log("n") / width).cast("int"))
    words = {(r.near, r.length): r.words for r in index.groupBy("near", "length").agg(F.sum("n").alias("words")).collect()}
    if not words:
        return False
    spread = F.lit(0)
    for (near, length), w in words.items():
        spread = F.when((F.col("near") == near) & (F.col("length") == length), F.pmod(F.xxhash64("id"), F.lit(math.ceil(w / BLOCK)))).otherwise(spread)
    block = ((F.col("near") * 256 + F.col("length")).cast("bigint") * (1 << 32) + spread).alias("block")
    texts.join(index.select("id", block, "near", "length", "pivots"), "id").select("block", "id", "near", "length", "pivots", "text").groupBy("block").applyInArrow(_block, BLOCKS).withColumn("at", F.col("block")).write.option("compression", "zstd").partitionBy("at").parquet(folder)
    return True


def _headers(spark: SparkSession, folders: list[str]) -> DataFrame:
    out = None
    for folder in folders:
        rows = spark.read.parquet(folder).withColumn("folder", F.lit(folder)).select(*HEADER)
        out = rows if out is None else out.unionByName(rows)
    return out


class _Block:
    """A stored block, as read by a task."""

    def __init__(self, folder: str, block: int):
        import pyarrow.parquet as pq
        from pyarrow import fs

        uri = folder.replace("s3a://", "s3://", 1).replace("file:/", "file:///", 1) if not folder.startswith("file://") else folder
        system, path = fs.FileSystem.from_uri(uri)
        row = pq.ParquetDataset(f"{path}/at={block}", filesystem=system, partitioning=None).read(columns=["ids", "sizes", "pivots", "words", "places", "seq"]).to_pylist()[0]
        take = lambda c, kind: np.frombuffer(row[c], kind)
        self.ids, self.sizes, self.words, self.seq = take("ids", np.int64), take("sizes", np.int32), take("words", np.uint64), take("seq", np.int32)
        self.pivots = take("pivots", np.float32).reshape(len(self.ids), -1)
        self.tokens = self.words + take("places", np.uint32) * _STEP
        self.starts = np.concatenate([[0], np.cumsum(self.sizes)])
        self.need = np.ceil((1 - RADIUS) * self.sizes - 1e-6).astype(np.int64)

    @property
    def often(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(bit of each token or -1, most frequent first; bits of the texts, words of 64 bits by texts; number of other tokens)."""
        if not hasattr(self, "_often"):
            met = np.bincount(self.seq, minlength=len(self.tokens))
            often = np.flatnonzero(met > COMMON * len(self.ids))
            often = often[np.argsort(-met[often], kind="stable")]
            bit = np.full(len(self.tokens), -1, np.int32)
            bit[often] = np.arange(len(often))
            self._often = bit, *self.bits(bit[self.seq], len(often))
        return self._often

    def bits(self, bit: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray]:
        """(words of 64 bits by texts, number of places without a bit of each text), given the bit of each place or -1."""
        size = count // 64 + 1
        set_ = np.zeros((len(self.ids), size * 64), np.uint8)
        has = bit >= 0
        owner = np.repeat(np.arange(len(self.ids)), self.sizes)
        set_[owner[has], bit[has]] = 1
        packed = np.packbits(set_, axis=1, bitorder="little").view(np.uint64)
        return np.ascontiguousarray(packed.T), self.sizes - np.bincount(owner[has], minlength=len(self.ids)).astype(np.int32)

    @property
    def lists(self) -> tuple[np.ndarray, np.ndarray]:
        """(texts by token, starts of the tokens' lists), of the tokens that are no bits."""
        if not hasattr(self, "_lists"):
            rare = np.flatnonzero(self.often[0][self.seq] < 0)
            tokens = self.seq[rare]
            owner = np.searchsorted(self.starts, rare, "right") - 1
            start = np.concatenate([[0], np.cumsum(np.bincount(tokens, minlength=len(self.tokens)))])
            self._lists = owner[np.argsort(tokens, kind="stable")], start
        return self._lists

    def count(self, texts: np.ndarray, tokens: np.ndarray) -> np.ndarray:
        """How many of ``tokens``, none of them a bit, each of ``texts`` has."""
        lists, start = self.lists
        parts = [lists[x:y] for x, y in zip(start[tokens].tolist(), start[tokens + 1].tolist())]
        return np.bincount(np.concatenate(parts), minlength=len(self.ids))[texts] if parts else np.zeros(len(texts), np.int64)

    def text(self, i: int) -> list[int]:
        """Word codes of a text in order."""
        return self.words[self.seq[self.starts[i] : self.starts[i + 1]]].tolist()


def common_words(a: _Block, b: _Block) -> Iterator[tuple[int, np.ndarray]]:
    """(j, texts i of ``a``) of the texts j of ``b`` that have 1 - RADIUS of the longer text's words in common with them.

    None within the radius is missing, whatever the words: the count is that of the common bag.
    """
    at = np.minimum(np.searchsorted(a.tokens, b.tokens), len(a.tokens) - 1)
    met = a.tokens[at] == b.tokens
    # a text has no more words in common with any text of a than a has at all
    known = np.add.reduceat(met[b.seq].astype(np.int64), b.starts[:-1])
    open_b = np.flatnonzero(known >= np.maximum(b.need, a.need.min()))
    if not len(open_b):
        return
    bit, bits_a, rest_a = a.often
    here = np.where(met, at, -1)[b.seq]
    bits_b, _ = b.bits(np.where(here >= 0, bit[here], -1), int(bit.max()) + 1)
    # places of b's tokens that a has too, without those that are bits
    rest_b = known - np.bitwise_count(bits_b).sum(0, dtype=np.int64)
    # the most frequent words are counted of all pairs, the others only where those leave it open
    top_a, top_b, more_a, more_b = bits_a[:TOP], bits_b[:TOP], np.ascontiguousarray(bits_a[TOP:].T), np.ascontiguousarray(bits_b[TOP:].T)
    beside_a = (a.sizes - np.bitwise_count(top_a).sum(0, dtype=np.int32)).astype(np.int16 if a.sizes.max() < 30_000 else np.int32)
    beside_b = known - np.bitwise_count(top_b).sum(0, dtype=np.int64)
    # no text of a block in short numbers has as many words as their bound
    small, bound = beside_a.dtype.type, 30_000 if beside_a.dtype == np.int16 else 2**31 - 1
    need_a, same = a.need.astype(small), a is b
    # of one block each pair counts once; of blocks of different lengths only texts of like length: by size, in a row
    by_size = None if same or (1 - RADIUS) * max(a.sizes.max(), b.sizes.max()) <= min(a.sizes.min(), b.sizes.min()) else np.argsort(a.sizes, kind="stable")
    if by_size is not None:
        top_a, beside_a, need_a, ordered = np.ascontiguousarray(top_a[:, by_size]), beside_a[by_size], need_a[by_size], a.sizes[by_size]
    for j in open_b.tolist():
        low, high = 0, j if same else len(a.ids)
        if by_size is not None:
            low, high = np.searchsorted(ordered, [b.need[j], math.floor(b.sizes[j] / (1 - RADIUS) + 1e-6) + 1]).tolist()
        if low >= high:
            continue
        both = np.bitwise_count(top_a[:, low:high] & top_b[:, j, None]).sum(0, dtype=beside_a.dtype)
        i = np.flatnonzero(both + np.minimum(beside_a[low:high], small(min(beside_b[j], bound))) >= np.maximum(need_a[low:high], small(min(b.need[j], bound))))
        if not len(i):
            continue
        both = both[i].astype(np.int64)
        if by_size is not None:
            i = by_size[low + i]
            order = np.argsort(i)
            i, both = i[order], both[order]
        need = np.maximum(a.need[i], b.need[j])
        if more_a.shape[1]:
            both += np.bitwise_count(more_a[i] & more_b[j]) @ np.ones(more_a.shape[1], np.int64)
            left = both + np.minimum(rest_a[i], rest_b[j]) >= need
            i, both, need = i[left], both[left], need[left]
            if not len(i):
                continue
        mine = here[b.starts[j] : b.starts[j + 1]]
        mine = mine[mine >= 0]
        mine = mine[bit[mine] < 0]
        count = a.count(i, mine)
        i = i[both + count >= need]
        if len(i):
            yield j, i[np.abs(a.pivots[i] - b.pivots[j]).max(1) <= RADIUS + 1e-6]


def _meet(first: int | None, any_order: bool):
    """Task: neighbours within two blocks. ``first`` bounds how many each text gets before ``more`` is set."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        held: dict[tuple, _Block] = {}

        def of(folder: str, block: int) -> _Block:
            found = held.pop((folder, block), None) or _Block(folder, block)
            while len(held) > 1:
                held.pop(next(iter(held)))
            held[folder, block] = found
            return found

        for batch in batches:
            for row in batch.to_pylist():
                a, b = of(row["a_folder"], row["a_block"]), of(row["b_folder"], row["b_block"])
                own, same = row["own"], row["own"] and row["a_block"] == row["b_block"]
                dropped = np.isin(a.ids, np.array(row["dropped"] or [], np.int64))
                got_a, more_a, more_b = np.zeros(len(a.ids), np.int64), np.zeros(len(a.ids), bool), np.zeros(len(b.ids), bool)
                texts: dict[int, list] = {}
                found = []
                for j, near in common_words(a, b):
                    near = near[~dropped[near] & (a.ids[near] != b.ids[j])]
                    mine = None
                    before = near[a.ids[near] < b.ids[j]] if not any_order else near
                    met = 0
                    for i in before.tolist():
                        if first is not None and met >= first:
                            more_b[j] = True
                            break
                        mine = mine or b.text(j)
                        share = lcs_share(texts.get(i) or texts.setdefault(i, a.text(i)), mine)
                        if share >= 1 - RADIUS:
                            met += 1
                            found.append((int(b.ids[j]), int(a.ids[i]), share, False))
                    # of two blocks of the batch, each has rows before some of the other's; rows come by id
                    after = near[a.ids[near] > b.ids[j]] if own and not same else near[:0]
                    full = got_a[after] >= first if first is not None else np.zeros(len(after), bool)
                    more_a[after[full]] = True
                    for i in after[~full].tolist():
                        mine = mine or b.text(j)
                        share = lcs_share(texts.get(i) or texts.setdefault(i, a.text(i)), mine)
                        if share >= 1 - RADIUS:
                            got_a[i] += 1
                            found.append((int(a.ids[i]), int(b.ids[j]), share, False))
                    if len(texts) > 4000:
                        texts.clear()
                found += [(int(x), None, None, True) for x in (*a.ids[more_a], *b.ids[more_b])]
                if found:
                    x = list(zip(*found))
                    yield pa.RecordBatch.from_arrays([pa.array(x[0], pa.int64()), pa.array(x[1], pa.int64()), pa.array(x[2], pa.float64()), pa.array(x[3], pa.bool_())], ["id", "other", "share", "more"])

    return run


def neighbours(spark: SparkSession, asked: str, stores: list[str], own: bool = False, dropped: DataFrame | None = None, first: int | None = None, any_order: bool = False) -> DataFrame:
    """(id, other, share, more) of the texts in the blocks of ``asked``: their neighbours in the blocks of ``stores``.

    ``own`` adds those within ``asked`` itself. Only neighbours of a smaller id count, but with ``any_order``.
    With ``first``, each pair of blocks verifies no more than so many neighbours of a text, the smallest ids, and marks
    the text by a row with ``more`` where others could follow. ``dropped`` has DROPPED rows of texts in the stores to leave out.
    """
    side = lambda s, folders: _headers(spark, folders).select(*[F.col(c).alias(f"{s}_{c}") for c in HEADER])
    b = side("b", [asked])
    folders = [*stores, *([asked] if own else [])]
    reach = lambda low, high: (F.col(high) >= (1 - RADIUS) * F.col(low) - 1e-6)
    # an equi-join over length classes; beyond the next class the shorter text is too short
    pairs = side("a", folders).withColumn("at", F.col("a_length")).join(b.withColumn("at", F.explode(F.array(F.col("b_length") - 1, F.col("b_length"), F.col("b_length") + 1))), "at")
    is_own = F.col("a_folder") == F.col("b_folder")
    apart = F.exists(F.zip_with(F.arrays_zip("a_least", "a_most"), F.arrays_zip("b_least", "b_most"), lambda x, y: (x["a_least"] - y["b_most"] > RADIUS + 1e-6) | (y["b_least"] - x["a_most"] > RADIUS + 1e-6)), lambda x: x)
    pairs = pairs.filter(reach("a_low", "b_high") & reach("b_low", "a_high") & ~apart & (~is_own | (F.col("a_block") <= F.col("b_block"))))
    gone = (dropped if dropped is not None else spark.createDataFrame([], DROPPED)).select(F.col("folder").alias("a_folder"), F.col("block").alias("a_block"), F.col("ids").alias("dropped"))
    pairs = cut(pairs.select("a_folder", "a_block", "b_folder", "b_block", is_own.alias("own"), (F.col("a_near") == F.col("b_near")).alias("like")))
    # a few pairs of blocks are a task's work, those of one block together; blocks of unlike texts share few words and cost little
    tasks = max(1, min(pairs.count() // PAIRS, 50_000))
    met = pairs.join(gone, ["a_folder", "a_block"], "left").repartitionByRange(tasks, "like", "a_folder", "a_block", "b_folder", "b_block")
    return met.select("a_folder", "a_block", "b_folder", "b_block", "own", "dropped").mapInArrow(_meet(first, any_order), "id bigint, other bigint, share double, more boolean")


# ---------------------------------------------------------------- what was accepted


DROPPED = "folder string, block bigint, ids array<bigint>"


class Accepted:
    """What was accepted so far, below ``path`` in a folder that all executors share.

    A batch adds its blocks, the ids in them that repeat something, its classes and its hashes, and counts from the
    moment its mark exists; marks are created without overwriting, so that of two runs of one batch one is refused.
    """

    def __init__(self, spark: SparkSession, path: str | None = None):
        self.spark, self.path = spark, (path or scratch(spark, "accepted")).rstrip("/")
        self._Path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._Path(self.path).getFileSystem(spark._jsc.hadoopConfiguration())
        self._fs.mkdirs(self._Path(self.path))

    def parts(self) -> list[str]:
        """Folders of the batches accepted, in order."""
        marks = sorted(s.getPath().getName() for s in self._fs.listStatus(self._Path(self.path)) if s.getPath().getName().startswith("mark-"))
        return [self.spark.read.text(f"{self.path}/{m}").first()[0] for m in marks]

    def table(self, name: str, ddl: str) -> DataFrame:
        found = [f"{p}/{name}" for p in self.parts()]
        return self.spark.read.schema(ddl).parquet(*found) if found else self.spark.createDataFrame([], ddl)

    def blocks(self) -> list[str]:
        return [f"{p}/blocks" for p in self.parts() if self._fs.exists(self._Path(f"{p}/blocks"))]

    def commit(self, part: str, number: int) -> None:
        out = self._fs.create(self._Path(f"{self.path}/mark-{number:08d}"), False)
        out.write(bytearray(part.encode()))
        out.close()

    def check(self, batch: DataFrame, key: str = "cand_id", text: str = "text", content_hash: str = "content_hash") -> DataFrame:
        """``repeats`` of a batch whose keys are all larger than those accepted before; what it accepts is added."""
        done = self.parts()
        part = f"{scratch(self.spark, 'batch')}"
        found = _check(batch, key, text, content_hash, self, part)
        rows = batch.select(F.col(key).cast("bigint").alias("id"), F.trim(content_hash).alias("content_hash")).filter("content_hash <> ''")
        rows.join(found.select(F.col(key).alias("id")), "id", "left_anti").write.parquet(f"{part}/hashes")
        self.commit(part, len(done))
        return found


def repeats(df: DataFrame, key: str = "cand_id", text: str = "text", content_hash: str = "content_hash") -> DataFrame:
    """(accepted_id, cand_id): each row of ``df`` that repeats something accepted, with what it repeats.

    ``df`` is taken in order of ``key``, which is unique. A text repeats an earlier accepted one within the
    radius; of several the nearest counts, then the earliest. A row is accepted only once all its earlier
    neighbours are known to repeat something. A null text repeats the earliest accepted row of the same
    hash; null and blank hashes repeat nothing. Empty texts repeat nothing and are accepted. Rows of one
    text form one class, compared once. An empty table has no repeats; other columns are ignored.
    """
    return Accepted(df.sparkSession).check(df, key, text, content_hash)


def _check(df: DataFrame, key: str, text: str, content_hash: str, store: Accepted, part: str) -> DataFrame:
    spark = store.spark
    own = cut(index_rows(df, key, text).filter("n > 0"))
    before = store.table("classes", "id bigint, class bigint").withColumn("here", F.lit(False))
    # a class is led by its first row
    leads = own.select("id", "class", F.lit(True).alias("here")).unionByName(before).groupBy("class").agg(F.min(F.struct("id", "here")).alias("lead"))
    members = cut(own.select("id", "class").join(leads, "class").select("id", "class", F.col("lead.id").alias("lead"), F.col("lead.here").alias("here")))
    # later copies are few ids, or many; either way no more than ids travel to leave them out
    copies = members.filter("id <> lead").select("id")
    texts = df.filter(F.col(text).isNotNull()).select(F.col(key).cast("bigint").alias("id"), F.col(text).alias("text"))
    index = cut(own.drop("class").join(copies, "id", "left_anti"))

    folder = f"{part}/blocks"
    picked, repeated = spark.createDataFrame([], "lead bigint, accepted bigint, share double"), spark.createDataFrame([], "id bigint")
    if write_blocks(texts, index, folder):
        old, gone = store.blocks(), store.table("dropped", DROPPED)
        states, edges = _states(spark, texts, index, folder, old, gone, part)
        repeated = cut(states.filter("s = 2").select("id"))
        _drop_rows(folder, repeated).write.parquet(f"{part}/dropped")
        # the nearest accepted one is among the neighbours known, those before and those after, which matter to later
        # copies; where a text may have more than were verified, all are looked for among what was accepted
        ever = states.filter("ever")
        twice = members.filter("id <> lead").select(F.col("lead").alias("id"))
        open_rows = spark.createDataFrame([], "id bigint")
        if not ever.isEmpty():
            open_rows = cut(ever.select("id").join(repeated, "id", "left_semi").unionByName(repeated.join(twice, "id", "left_semi")).distinct())
        known = edges.unionByName(edges.select(F.col("other").alias("id"), F.col("id").alias("other"), "share"))
        picked = known.join(repeated, "id", "left_semi").join(repeated.withColumnRenamed("id", "other"), "other", "left_anti").join(open_rows, "id", "left_anti").select(F.col("id").alias("lead"), F.col("other").alias("accepted"), "share")
        if not open_rows.isEmpty():
            write_blocks(texts, index.join(open_rows, "id", "left_semi"), f"{part}/open")
            masked = gone.unionByName(spark.read.schema(DROPPED).parquet(f"{part}/dropped"))
            near = neighbours(spark, f"{part}/open", [*old, folder], dropped=masked, any_order=True)
            picked = picked.unionByName(near.select(F.col("id").alias("lead"), F.col("other").alias("accepted"), "share"))
    else:
        spark.createDataFrame([], DROPPED).write.parquet(f"{part}/dropped")
    # every row of a class takes the nearest of those accepted before it
    taken = members.join(repeated.withColumnRenamed("id", "lead"), "lead", "left_semi").join(picked, "lead").filter("accepted < id")
    taken = taken.groupBy("id").agg(F.max(F.struct("share", (-F.col("accepted")).alias("neg"))).alias("best")).select("id", (-F.col("best.neg")).alias("accepted"))
    copied = members.filter("id <> lead").join(repeated.withColumnRenamed("id", "lead"), "lead", "left_anti").select("id", F.col("lead").alias("accepted"))
    by_text = cut(taken.unionByName(copied))
    members.filter("id = lead").join(repeated, "id", "left_anti").select("id", "class").write.parquet(f"{part}/classes")
    found = by_text.unionByName(_by_hash(df, key, text, content_hash, by_text, store.table("hashes", "id bigint, content_hash string")))
    return cut(found.select(F.col("accepted").alias("accepted_id"), F.col("id").alias(key)))


def _ids(batches: Iterator) -> Iterator:
    import pyarrow as pa

    for batch in batches:
        for block, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            found = np.frombuffer(ids, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(found), block)), pa.array(found)], ["block", "id"])


def _drop_rows(folder: str, ids: DataFrame) -> DataFrame:
    """DROPPED rows of a folder: which of its texts repeat something. At most a block's texts each."""
    stored = ids.sparkSession.read.parquet(folder).select("block", "ids").mapInArrow(_ids, "block bigint, id bigint")
    return stored.join(ids, "id").groupBy("block").agg(F.collect_list("id").alias("ids")).select(F.lit(folder).alias("folder"), "block", "ids")


def _states(spark: SparkSession, texts: DataFrame, index: DataFrame, folder: str, old: list[str], gone: DataFrame, part: str) -> tuple[DataFrame, DataFrame]:
    """((id, s, more, ever), (id, other, share)) of the rows with an earlier neighbour: s is 1 for accepted, 2 for a repeat.

    ``more`` says that a row may have more neighbours than were verified, ``ever`` that it may have had at some time.
    """
    met = cut(neighbours(spark, folder, old, own=True, dropped=gone, first=FIRST))
    edges, turn = met.filter("not more").drop("more"), 0
    states = cut(met.groupBy("id").agg(F.max("more").alias("more")).select("id", F.lit(0).alias("s"), "more", F.col("more").alias("ever")))
    left = states.count()
    while left:
        # rows that are in no state have no earlier neighbour and are accepted, as is all history
        judged = edges.join(states.select(F.col("id").alias("other"), F.col("s").alias("t")), "other", "left").groupBy("id").agg(F.max(F.coalesce("t", F.lit(1)) == 1).alias("any"), F.min(F.coalesce("t", F.lit(1)) == 2).alias("all"))
        s = F.when(F.col("s") != 0, F.col("s")).when(F.col("any"), 2).when(F.col("all") & ~F.col("more"), 1).otherwise(0)
        states = cut(states.join(judged, "id", "left").select("id", s.alias("s"), "more", "ever"))
        open_rows = states.filter("s = 0").select("id")
        now = open_rows.count()
        if now == left:
            # all known neighbours of these repeat something, and there are more: compared with what doesn't
            turn += 1
            write_blocks(texts, index.join(open_rows, "id", "left_semi"), f"{part}/again-{turn}")
            dropped = cut(gone.unionByName(_drop_rows(folder, states.filter("s = 2").select("id"))))
            met = cut(neighbours(spark, f"{part}/again-{turn}", [*old, folder], dropped=dropped, first=FIRST))
            fresh, more = met.filter("not more").drop("more"), met.filter("more").select("id").distinct().withColumn("m", F.lit(True))
            edges = cut(edges.join(open_rows, "id", "left_anti").unionByName(fresh))
            # a row whose neighbours all went has none any more, and is accepted by having no edge
            bare = fresh.select("id").distinct().withColumn("has", F.lit(True))
            again = states.join(more, "id", "left").join(bare, "id", "left")
            opened = F.col("s") == 0
            states = cut(again.select("id", F.when(opened & F.col("has").isNull(), 1).otherwise(F.col("s")).alias("s"), F.when(opened, F.coalesce("m", F.lit(False))).otherwise(F.col("more")).alias("more"), "ever"))
            now = states.filter("s = 0").count()
        left = now
    return states, edges


def _by_hash(df: DataFrame, key: str, text: str, content_hash: str, by_text: DataFrame, before: DataFrame) -> DataFrame:
    """(id, accepted) of the rows with a null text that repeat an accepted row's hash."""
    rows = df.select(F.col(key).cast("bigint").alias("id"), F.trim(content_hash).alias("h"), F.col(text).isNull().alias("bare")).filter("h <> ''")
    bare = rows.filter("bare").select("id", "h")
    full = rows.filter("not bare").join(by_text, "id", "left_anti").select("id", "h").unionByName(before.select("id", F.col("content_hash").alias("h")))
    first = full.groupBy("h").agg(F.min("id").alias("first"))
    first_bare = bare.groupBy("h").agg(F.min("id").alias("first_bare"))
    met = bare.join(first_bare, "h").join(first, "h", "left")
    return met.select("id", F.least("first", "first_bare").alias("accepted")).filter("accepted < id")
