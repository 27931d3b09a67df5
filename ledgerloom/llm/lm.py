"""Log-bilinear language model, trained with noise-contrastive estimation in numpy.

The model's units are the most frequent words (``HEAD`` at most), classes of all other words by
their last bytes, and the end of a text. Every unit has an output vector and two context vectors: the two
preceding units predict the next by the sum of their vectors times its own. Units are put in
groups by frequency; a group is predicted first and then the unit within it, so that exact
normalisation takes two matrix products of the root of the vocabulary. A word of a class has its smoothed share of the
class's training counts.

All training documents take part: tokens are counted by Spark, and each task trains a copy of the
model on its documents with drawn noise; per unit, what the copies have learned is averaged by
the tokens it was learned from. Counts of the head and of the next ``MORE`` words go to the tasks that score; those of all other
tokens are joined to the tokens of the texts, so they grow with the corpus.

Cases: a null text is the empty one, which is its end alone; repeated rows score
alike, since rows are told apart by a stored row number and not by their id; without
training documents counts are 0 and all units are equally likely; a very long text is one row
whose tokens are scored in parts; an empty table gives an empty result.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DataType

from ledgerloom.llm._common import id_crc, shared_table, slices, utf8

#: Words that are units of the model and whose counts every scoring task holds.
HEAD = 32_768
#: Classes of all other words.
CLASSES = 256
#: Words after the head, by frequency, whose counts every task holds, too; those of all others are joined.
MORE = 262_144
#: Distinct tokens that a counting task holds before it passes them on.
HELD = 400_000
DIMENSIONS = 16
#: Noise drawn for the tokens of a step: groups, and units of each group.
NOISE = (64, 16)
#: Tokens of a training step, and tokens that are scored at once.
STEP, AT_ONCE = 8192, 65_536
#: Tokens whose scores of all groups are held at once: they stay in a core's cache.
BLOCK = 1024
RATE = 0.05
#: Tokens that the driver's first fit reads on average, and how often; it gives all copies the same start.
WARM, EPOCHS = 1_000_000, 2
#: Copies that are trained at most, and units whose vectors travel together.
COPIES, ROWS = 1024, 64
SEED = 11
END = b""  # no word is empty
UNKNOWN = 1 << 40  # no place


def tokens(text: bytes | None) -> list[bytes]:
    """Words between ASCII white space, A-Z lower-cased, without the end."""
    return text.lower().split() if text else []


def word_class(word: bytes) -> int:
    """A class from a word's last two bytes, which tell languages and kinds of words apart."""
    return zlib.crc32(word[-2:]) % CLASSES


def class_column(token: Column) -> Column:
    """``word_class`` of a binary column."""
    return (F.crc32(F.substring(token, -2, 2)) % CLASSES).cast("int")


def count_tokens(docs: DataFrame) -> DataFrame:
    """(token, n) over all texts, ends included; tasks sum before the shuffle."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: Counter = Counter()

        def batch_of() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(sums), pa.binary()), pa.array(list(sums.values()), pa.int64())], ["token", "n"])

        for batch in slices(batches, "text"):
            for text in utf8(batch, "text"):
                sums.update(tokens(text))
            sums[END] += batch.num_rows
            if len(sums) > HELD:
                yield batch_of()
                sums.clear()
        yield batch_of()

    return docs.select("text").mapInArrow(count, "token binary, n long").groupBy("token").agg(F.sum("n").alias("n"))


@dataclass
class Vocabulary:
    """Counts of the training tokens, as far as every task needs them, and the model's units, the most frequent first."""

    total: int = 0
    distinct: int = 0
    ends: int = 0
    least: int = 1
    head: dict[bytes, int] = field(default_factory=dict)  # place of a token in the arrays below
    counts: np.ndarray = field(default_factory=lambda: np.zeros(0))
    more: dict[bytes, int] = field(default_factory=dict)  # place of a word in the arrays of the words after the head
    more_counts: np.ndarray = field(default_factory=lambda: np.zeros(0))
    more_class: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    class_totals: np.ndarray = field(default_factory=lambda: np.zeros(CLASSES))
    class_words: np.ndarray = field(default_factory=lambda: np.zeros(CLASSES))

    @property
    def base_denominator(self) -> float:
        return math.log10(self.total + 0.1 * (self.distinct + 1))

    @property
    def class_denominators(self) -> np.ndarray:
        return np.log10(self.class_totals + 0.1 * (self.class_words + 1))

    def ordered(self) -> tuple[np.ndarray, np.ndarray]:
        """Unit by place, where classes and the end follow the head; and the counts of the units."""
        counts = np.r_[self.counts, self.class_totals, self.ends]
        order = np.argsort(-counts, kind="stable")
        units = np.empty(len(counts), np.int32)
        units[order] = np.arange(len(counts), dtype=np.int32)
        return units, counts[order]


class _Classes(dict):
    """The class of each ending of two bytes that has been seen."""

    def __missing__(self, ending: bytes) -> int:
        self[ending] = found = word_class(ending)
        return found


def vocabulary(counts: DataFrame) -> Vocabulary:
    """Totals, head and classes of a stored (token, n) table."""
    sums = counts.agg(F.sum("n").alias("total"), F.count("*").alias("distinct"), F.sum(F.when(F.col("token") == F.lit(END), F.col("n"))).alias("ends")).first()
    v = Vocabulary(sums["total"] or 0, sums["distinct"], sums["ends"] or 0)
    words = counts.where(F.col("token") != F.lit(END))
    # At what counts the head begins and the words after it end: from a histogram of a few hundred steps.
    steps = words.groupBy(F.floor(F.log2("n") * 8).alias("step")).agg(F.count("*").alias("words"), F.min("n").alias("least")).collect()
    held, head_from, v.least = 0, 1 << 62, 1 << 62
    for r in sorted(steps, key=lambda r: -r["step"]):
        held += r["words"]
        if held > HEAD + MORE:
            break
        v.least = r["least"]
        if held <= HEAD:
            head_from = r["least"]
    every = sorted(((r["n"], bytes(r["token"])) for r in words.where(F.col("n") >= v.least).collect()), key=lambda x: (-x[0], x[1]))
    top, more = [x for x in every if x[0] >= head_from], [x for x in every if x[0] < head_from]
    v.head = {word: i for i, (_, word) in enumerate(top)}
    v.counts = np.array([n for n, _ in top], float)
    v.more = {word: j for j, (_, word) in enumerate(more)}
    v.more_counts, v.more_class = np.array([n for n, _ in more], float), np.array([word_class(w) for _, w in more], np.int64)
    for r in words.groupBy(class_column(F.col("token")).alias("class")).agg(F.sum("n").alias("n"), F.count("*").alias("words")).collect():
        v.class_totals[r["class"]], v.class_words[r["class"]] = r["n"], r["words"]
    for n, word in top:
        v.class_totals[word_class(word)] -= n
        v.class_words[word_class(word)] -= 1
    return v


class Net:
    """The model's vectors: of units as earlier and later context and as outputs, and of the groups; log-probabilities are natural."""

    NAMES = ("far", "near", "out", "group")

    def __init__(self, counts: np.ndarray) -> None:
        n = len(counts)
        self.size = math.isqrt(n - 1) + 1
        self.groups = -(-n // self.size)
        rng = np.random.default_rng(SEED)
        draw = lambda: rng.normal(0, 0.3, (n, DIMENSIONS)).astype(np.float32)
        self.far, self.near = draw(), draw()
        smooth = counts + 0.1
        self.starts = np.arange(0, n, self.size)
        of_group = np.add.reduceat(smooth, self.starts)
        within = smooth / of_group[np.arange(n) // self.size]
        # Vectors and biases in one, the bias last: at first the unigram model.
        self.out = np.c_[np.zeros((n, DIMENSIONS)), np.log(within)].astype(np.float32)
        self.group = np.c_[np.zeros((self.groups, DIMENSIONS)), np.log(of_group / of_group.sum())].astype(np.float32)
        self.unigram, self.group_unigram = within, of_group / of_group.sum()
        self.steps = np.cumsum(smooth / smooth.sum())
        self.squares = {k: np.full(len(getattr(self, k)), 1e-3, np.float32) for k in self.NAMES}

    def context(self, far: np.ndarray, near: np.ndarray) -> np.ndarray:
        h = np.empty((len(far), DIMENSIONS + 1), np.float32)
        h[:, -1] = 1
        np.add(np.take(self.far, far, axis=0), np.take(self.near, near, axis=0), out=h[:, :-1])
        return h

    def segments(self, group: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """(group, start, end) of sorted groups."""
        cuts = np.flatnonzero(np.r_[True, group[1:] != group[:-1], True])
        yield from zip(group[cuts[:-1]].tolist(), cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)

    def log_probabilities(self, far: np.ndarray, near: np.ndarray, unit: np.ndarray) -> np.ndarray:
        """Of each unit after its two predecessors, normalised over all units."""
        found = np.empty(len(unit))
        for at in range(0, len(unit), AT_ONCE):
            u = unit[at : at + AT_ONCE]
            order = _order(u, len(self.unigram))
            u = u[order]
            group = u // self.size
            h = self.context(far[at : at + AT_ONCE][order], near[at : at + AT_ONCE][order])
            logs = np.concatenate([_normalised(h[i : i + BLOCK] @ self.group.T, group[i : i + BLOCK]) for i in range(0, len(u), BLOCK)])
            for g, a, b in self.segments(group):
                first = g * self.size
                own = self.out[first : first + self.size].T
                for i in range(a, b, BLOCK):
                    end = min(i + BLOCK, b)
                    logs[i:end] += _normalised(h[i:end] @ own, u[i:end] - first)
            found[at : at + AT_ONCE][order] = logs
        return found

    def train(self, far: np.ndarray, near: np.ndarray, unit: np.ndarray, rng: np.random.Generator) -> None:
        """One step of noise-contrastive estimation over all tokens given: groups against drawn groups, units against units drawn from their group."""
        order = _order(unit, len(self.unigram))
        far, near, unit = far[order], near[order], unit[order]
        group = unit // self.size
        h = self.context(far, near)
        noise = np.searchsorted(self.steps[self.starts[1:] - 1], rng.random(NOISE[0]), "right")
        shift = np.log(NOISE[0] * self.group_unigram[noise]).astype(np.float32)
        drawn, back = self.group[noise], np.empty_like(h)
        pushed = np.zeros(drawn.shape, np.float32)
        against = _shifted(drawn, shift).T
        for i in range(0, len(h), BLOCK):
            own = h[i : i + BLOCK]
            false = _sigmoid_of_negative(own @ against)
            back[i : i + BLOCK] = -(false @ drawn)
            pushed += false.T @ own
        grads = self._real(h, self.group, group, NOISE[0] * self.group_unigram, back)
        segments = list(self.segments(group))
        present, firsts = np.array([g for g, _, _ in segments]), np.array([a for _, a, _ in segments])
        sums = np.zeros(self.group.shape, np.float32)
        np.subtract.at(sums, noise, pushed)
        sums[present] += np.add.reduceat(grads, firsts, axis=0)
        self._step("group", np.union1d(present, noise), sums)
        low = np.r_[0.0, self.steps[self.starts[1:] - 1]]
        noise = np.searchsorted(self.steps, low[:, None] + rng.random((self.groups, NOISE[1])) * self.group_unigram[:, None], "right")
        noise = np.clip(noise, self.starts[:, None], np.minimum(self.starts[:, None] + self.size, len(self.unigram)) - 1)
        shift = np.log(NOISE[1] * self.unigram[noise]).astype(np.float32)
        drawn, false = self.out[noise], np.empty((len(unit), NOISE[1]), np.float32)
        against = _shifted(drawn, shift).transpose(0, 2, 1)
        for g, a, b in segments:
            np.matmul(h[a:b], against[g], out=false[a:b])
        false = _sigmoid_of_negative(false)
        pushed = np.zeros(drawn.shape, np.float32)
        for g, a, b in segments:
            back[a:b] -= false[a:b] @ drawn[g]
            np.matmul(false[a:b].T, h[a:b], out=pushed[g])
        grads = self._real(h, self.out, unit, NOISE[1] * self.unigram, back)
        self._move("out", np.r_[unit, noise[present].ravel()], np.concatenate([grads, -pushed[present].reshape(-1, pushed.shape[2])]))
        self._move("far", far, back[:, :-1])
        self._move("near", near, back[:, :-1])

    def _real(self, h: np.ndarray, table: np.ndarray, target: np.ndarray, expected: np.ndarray, back: np.ndarray) -> np.ndarray:
        """Ascent of the log-likelihood that targets are data: added to ``back`` by context, and returned by target."""
        vectors = np.take(table, target, axis=0)
        real = _sigmoid_of_negative(np.einsum("ij,ij->i", h, vectors) - np.take(np.log(expected).astype(np.float32), target))[:, None]
        vectors *= real
        back += vectors
        return real * h

    def _move(self, name: str, rows: np.ndarray, grads: np.ndarray) -> None:
        """A step along summed gradients, by Adagrad with one sum of squares a row."""
        order = _order(rows, len(getattr(self, name)))
        rows = rows[order]
        starts = np.flatnonzero(np.r_[True, rows[1:] != rows[:-1]])
        self._step(name, rows[starts], np.add.reduceat(np.take(grads, order, axis=0), starts, axis=0))

    def _step(self, name: str, rows: np.ndarray, sums: np.ndarray) -> None:
        """A step of distinct rows along their sums; ``sums`` are of these rows, or of all."""
        sums = sums if len(sums) == len(rows) else sums[rows]
        squares = self.squares[name]
        squares[rows] += np.einsum("ij,ij->i", sums, sums) / sums.shape[1]
        getattr(self, name)[rows] += RATE * sums / np.sqrt(squares[rows])[:, None]


def _order(x: np.ndarray, most: int) -> np.ndarray:
    """Stable order of numbers below ``most``; short ones are sorted by their digits, which is faster."""
    return np.argsort(x.astype(np.uint16) if most <= 1 << 16 else x, kind="stable")


def _shifted(vectors: np.ndarray, shift: np.ndarray) -> np.ndarray:
    """Vectors, bias last, whose products with contexts are those of the given ones less a shift, negated."""
    out = -vectors
    out[..., -1] += shift
    return out


def _sigmoid_of_negative(x: np.ndarray) -> np.ndarray:
    """1 / (1 + exp(x)), in place; 0 where the exponential is infinite."""
    with np.errstate(over="ignore"):
        np.exp(x, out=x)
    x += 1
    return np.reciprocal(x, out=x)


def _normalised(scores: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The log-softmax of each row at one column; scores are near log-probabilities, so they seldom need scaling."""
    if scores.size and (scores.max() > 60 or scores[:, 0].min() < -60):
        scores -= scores.max(axis=1, keepdims=True)
    found = scores[np.arange(len(at)), at].astype(float)
    np.exp(scores, out=scores)
    return found - np.log(scores @ np.ones(scores.shape[1], np.float32))


class Reader:
    """Units of texts and their predecessors, from the vocabulary's places."""

    def __init__(self, v: Vocabulary, units: np.ndarray) -> None:
        # A word's place in the head, or from -1 - CLASSES downwards its place after the head.
        self.places = v.head | {word: -1 - CLASSES - j for word, j in v.more.items()}
        self.classes, self.units, self.n_head, self.more_class = _Classes(), units, len(v.head), v.more_class

    def read(self, texts: Iterable[list[bytes]]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Per token, ends included: its place (-1 - its class if the word is in no table), and the units before and before that, and its own; before a text stand ends."""
        sizes = np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))
        last = np.cumsum(sizes) - 1
        place = np.empty(int(sizes.sum()), np.int64)
        inside = np.ones(len(place), bool)
        inside[last] = False
        words = list(chain.from_iterable(texts))
        found = np.fromiter(map(self.places.get, words, repeat(UNKNOWN)), np.int64, len(words))
        other = np.flatnonzero(found == UNKNOWN)
        found[other] = [-1 - self.classes[words[i][-2:]] for i in other.tolist()]
        place[inside] = found
        place[last] = self.n_head + CLASSES
        at = np.where(place < 0, self.n_head - 1 - place, place)
        more = np.flatnonzero(place < -CLASSES)
        at[more] = self.n_head + self.more_class[-1 - CLASSES - place[more]]
        unit = self.units[at]
        end, first = self.units[-1], last - sizes + 1
        near = np.r_[end, unit[:-1]][: len(unit)]
        near[first] = end
        far = np.r_[end, near[:-1]][: len(unit)]
        far[first] = end
        return place, far, near, unit


def _trained(docs: DataFrame, v: Vocabulary, net: Net, units: np.ndarray) -> Net:
    """The net after one pass over all texts: tasks train copies, and each row becomes the mean of the copies that changed it, weighed by tokens."""
    shared = docs.sparkSession.sparkContext.broadcast((v, net, units))

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import copy

        v, start, units = shared.value
        own, reader, rng = copy.deepcopy(start), Reader(v, units), np.random.default_rng(SEED)
        times = {k: np.zeros(len(getattr(own, k)), np.float32) for k in Net.NAMES}
        for batch in slices(batches, "text"):
            _, far, near, unit = reader.read([tokens(t) for t in utf8(batch, "text")])
            for at in range(0, len(unit), STEP):
                part = slice(at, at + STEP)
                own.train(far[part], near[part], unit[part], rng)
            for k, rows in (("far", far), ("near", near), ("out", unit), ("group", unit // own.size)):
                times[k] += np.bincount(rows, minlength=len(times[k]))
        for k in Net.NAMES:
            change = (getattr(own, k) - getattr(start, k)) * times[k][:, None]
            blocks = [b for b in range(0, len(change), ROWS) if times[k][b : b + ROWS].any()]
            sums = [np.c_[times[k][b : b + ROWS], change[b : b + ROWS]].astype(np.float32).tobytes() for b in blocks]
            yield pa.RecordBatch.from_arrays([pa.array([k] * len(blocks), pa.string()), pa.array(blocks, pa.int32()), pa.array(sums, pa.binary())], ["name", "block", "sums"])

    def total(group: pa.Table) -> pa.Table:
        added = sum(np.frombuffer(x.as_py(), np.float32).astype(float) for x in group.column("sums"))
        return pa.table({"name": group.column("name")[:1], "block": group.column("block")[:1], "sums": pa.array([added.astype(np.float32).tobytes()], pa.binary())})

    kind = "name string, block int, sums binary"
    copies = docs.select("text").coalesce(COPIES).mapInArrow(learn, kind)
    for r in copies.groupBy("name", "block").applyInArrow(total, kind).toLocalIterator():
        table = getattr(net, r["name"])
        sums = np.frombuffer(r["sums"], np.float32).reshape(-1, table.shape[1] + 1)
        rows = np.flatnonzero(sums[:, 0])
        table[r["block"] + rows] += sums[rows, 1:] / sums[rows, :1]
    return net


def fit(docs: DataFrame, v: Vocabulary) -> tuple[Net, np.ndarray]:
    """The model of all texts, and the unit of each place."""
    units, counts = v.ordered()
    net, reader, rng = Net(counts), Reader(v, units), np.random.default_rng(SEED)
    if not v.total:
        return net, units
    some = docs.where(F.rand(SEED) < min(1.0, WARM / v.total)).select("text")
    # About ``WARM`` words, so a few megabytes.
    texts: list[list[bytes]] = []
    for batch in some.toArrow().to_batches():
        texts += [tokens(t) for t in utf8(batch, "text")]
    for _ in range(EPOCHS if texts else 0):
        _, far, near, unit = reader.read(texts)
        for at in range(0, len(unit), STEP):
            net.train(far[at : at + STEP], near[at : at + STEP], unit[at : at + STEP], rng)
    return _trained(docs, v, net, units), units


def scored(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: held_out, n_tokens, n_known, train_tokens, the unigram score and the model's, both log10."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    training = rows.where(id_crc(F.col("id")) % 10 != 0)
    counts = shared_table(count_tokens(training), "lm-counts")
    v = vocabulary(counts)
    shared = docs.sparkSession.sparkContext.broadcast((v, *fit(training, v)))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v, net, units = shared.value
        reader = Reader(v, units)
        # By place, classes and the end last: the base's logarithm, and a word's share of its class. Words of a class get their own counts later.
        base = np.r_[np.log10(v.counts + 0.1), np.zeros(CLASSES), math.log10(v.ends + 0.1)] - v.base_denominator
        known = np.r_[np.ones(len(v.counts)), np.zeros(CLASSES), v.ends > 0]
        within = np.r_[np.zeros(len(v.counts)), -v.class_denominators, 0.0]
        log_more = np.log10(v.more_counts + 0.1)
        for batch in slices(batches, "text"):
            texts = [tokens(t) for t in utf8(batch, "text")]
            place, far, near, unit = reader.read(texts)
            inside = place != len(v.counts) + CLASSES
            tail, more = (place < 0) & (place >= -CLASSES), np.flatnonzero(place < -CLASSES)
            held = -1 - CLASSES - place[more]
            counted = np.zeros(len(place))
            counted[more] = log_more[held]
            place[more] = len(v.counts) + v.more_class[held]
            place[tail] = len(v.counts) - 1 - place[tail]
            sizes = np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))
            first = np.cumsum(sizes) - sizes
            logs = net.log_probabilities(far, near, unit) / math.log(10) + within[place] + counted
            is_known = known[place]
            is_known[more] = 1
            sums = [np.add.reduceat(x, first) if len(texts) else np.zeros(0) for x in (is_known, base[place] + counted, logs)]
            ends = np.r_[0, np.cumsum(np.add.reduceat(tail.astype(np.int64), first))] if len(texts) else np.zeros(1, np.int64)
            words = list(chain.from_iterable(texts))
            rare = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array([words[i] for i in np.flatnonzero(tail[inside]).tolist()], pa.binary()))
            columns = [pa.array(sizes), pa.array(sums[0].astype(np.int64)), pa.array(sums[1]), pa.array(sums[2]), rare]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], ["id", "n_tokens", "known", "base", "model", "tail"])

    schema = rows.select("id").schema
    for name, kind in (("n_tokens", "long"), ("known", "long"), ("base", "double"), ("model", "double")):
        schema = schema.add(name, kind)
    partial = rows.mapInArrow(score, schema.add("tail", DataType.fromDDL("array<binary>")))
    partial = shared_table(partial.withColumn("row", F.monotonically_increasing_id()), "lm-partial")
    rare = counts.where((F.col("n") < v.least) & (F.col("token") != F.lit(END)))
    exploded = partial.select("row", F.explode("tail").alias("token")).join(rare, "token", "left")
    tails = exploded.groupBy("row").agg(F.sum(F.log10(F.coalesce("n", F.lit(0)) + 0.1)).alias("tail_log"), F.count("n").alias("tail_known"))
    joined = partial.drop("tail").join(tails, "row", "left")
    log = F.coalesce("tail_log", F.lit(0.0))
    return joined.select(
        F.col("id").alias(id_col),
        (id_crc(F.col("id")) % 10 == 0).alias("held_out"),
        "n_tokens",
        (F.col("known") + F.coalesce("tail_known", F.lit(0))).cast("long").alias("n_known"),
        F.lit(v.total).cast("long").alias("train_tokens"),
        (F.col("base") + log).alias("base_score"),
        (F.col("model") + log).alias("score"),
    )
