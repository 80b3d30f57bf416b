"""Language-model scores of whole texts by Brown class-based bigrams (operator 6).

``P(word | word before) = P(class | class before) P(word | class)``, mixed with the
smoothed share of the word. Every word that occurs ``OFTEN`` times or more is clustered by
itself, all others by their endings, so that every word, seen or not, has a class.

The exchange algorithm moves a type at a time to the class that raises the likelihood of
the class bigrams most. The driver does so for the most frequent words and the endings,
until a pass over them moves few. The other clustered words, as many as the corpus has,
start in their ending's class and move in rounds: a Spark table holds how often each stands
before and after each class, and tasks find the best class of a share of them, against
class bigrams that are counted anew for each round.

Texts are read twice: words are counted, then each text is written down as the types of its
words, four bytes each. All further passes go over these numbers. Counts are of all training
tokens: words in a table as long as the vocabulary, bigrams of types in a table bounded by
the square of ``TYPES``, which the driver clusters, and words by classes in a table that
grows with the clustered words. Tasks know these by a hash of 64 bits, a type and a class. A
score splits into a sum over classes and a sum over word counts. Counts of the ``HEAD`` most
frequent words go to all tasks; the other words of a text meet the count table in a join, so
the vocabulary may be of any size.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialise
from .arrow import flat_bytes, raw_texts, slices, text_slices
from .chunks import ASCII_WHITE, Chunks, Growing
from .lookup import Lookup
from .shingles import word_hashes

FOLDS = 10
#: Frequent words clustered by themselves, and endings (bytes) of the others.
WORDS, ENDINGS, ENDING = 512, 511, 3
TYPES = WORDS + ENDINGS + 2
CLASSES = 48
PASSES = 8
#: Occurrences from which a word is clustered by itself; rounds in which shares of these words move.
OFTEN, ROUNDS = 100, 2
#: Pairs that a task counts before it passes them on.
PAIRS = 2_000_000
#: Words whose counts every task holds.
HEAD = 100_000
ADDED = 0.1
#: Weight of the class bigrams against the plain share of a word, and pseudo-counts of a transition.
MIXED, TRANSITION = 0.95, 5.0
#: Bytes of texts that are worked on at once.
SLICE = 1 << 20
#: Type of the end of a text, and of words with a rare ending.
END, OTHER = 0, 1


def hashes_of(words: list[bytes]) -> np.ndarray:
    """Hashes of words of 64 bits, the same as texts are read by."""
    return word_hashes(b"\n".join(words))[0].view(np.int64) if words else np.zeros(0, np.int64)


class Words:
    """Types of the clustered words: the most frequent by themselves, the others by sorted hashes."""

    def __init__(self, head: dict[bytes, int], hashes: np.ndarray, first: int):
        self.head, self.hashes, self.first = head, hashes, first

    def __len__(self) -> int:
        return len(self.head) + len(self.hashes)

    def get(self, word: bytes) -> int | None:
        own = self.head.get(word)
        if own is None and len(self.hashes):
            mark = hashes_of([word])[0]
            at = int(self.hashes.searchsorted(mark))
            if at < len(self.hashes) and self.hashes[at] == mark:
                own = self.first + at
        return own


class Line:
    """The words of some texts, one after the other: hashes, where each lies in ``data``, and the offsets of the texts."""

    def __init__(self, texts: list[bytes]):
        self.data = np.frombuffer(b"\n".join(texts), np.uint8)
        hashes, self.starts = word_hashes(self.data.tobytes())
        self.hashes = hashes.view(np.int64)
        inside = ~ASCII_WHITE[self.data]
        self.ends = np.flatnonzero(inside & ~np.append(inside[1:], False)) + 1
        self.offsets = np.concatenate([[0], np.searchsorted(self.starts, np.cumsum([len(text) + 1 for text in texts]))])

    def endings(self, at: np.ndarray) -> np.ndarray:
        """A number for the last bytes of some of the words, A-Z as a-z."""
        starts, ends = self.starts[at], self.ends[at]
        codes = np.minimum(ends - starts, ENDING) << (8 * ENDING)
        for k in range(ENDING):
            place = ends - 1 - k
            byte = self.data[np.maximum(place, 0)].astype(np.int64)
            byte += ((byte >= 65) & (byte <= 90)) * 32
            codes += np.where(place >= starts, byte, 0) << (8 * k)
        return codes

    def word(self, at: int) -> bytes:
        return self.data[self.starts[at] : self.ends[at]].tobytes().lower()


class Types:
    """The type of every word of a line: its own, or that of its ending."""

    def __init__(self, words: dict[bytes, int] | Words, endings: dict[bytes, int]):
        head = words if isinstance(words, dict) else words.head
        marks, kinds = hashes_of(list(head)), np.array(list(head.values()), np.int64)
        if not isinstance(words, dict):
            marks = np.concatenate([marks, words.hashes])
            kinds = np.concatenate([kinds, words.first + np.arange(len(words.hashes))])
        self.lookup, self.kinds = Lookup(marks), kinds
        line = Line(list(endings))
        codes, order = np.unique(line.endings(np.arange(len(endings))), return_index=True)
        self.codes, self.ending_kinds = codes, np.array(list(endings.values()), np.int64)[order]

    def of(self, line: Line) -> np.ndarray:
        found = self.lookup.find(line.hashes)
        kinds = self.kinds[found] if len(self.kinds) else np.zeros(len(found), np.int64)
        other = np.flatnonzero(found < 0)
        kinds[other] = OTHER
        if len(other) and len(self.codes):
            codes = line.endings(other)
            at = np.minimum(np.searchsorted(self.codes, codes), len(self.codes) - 1)
            same = self.codes[at] == codes
            kinds[other[same]] = self.ending_kinds[at[same]]
        return kinds


@dataclass
class Vocabulary:
    """The types, and the one that each clustered word would have by its ending."""

    words: Words
    endings: dict[bytes, int]
    starts: np.ndarray


@dataclass
class ClassModel:
    """What scoring needs beside the counts of words."""

    words: Words
    endings: dict[bytes, int]
    classes: np.ndarray
    step: np.ndarray
    tokens: int
    vocabulary: int
    ends: int

    @property
    def base_mass(self) -> float:
        return self.tokens + ADDED * (self.vocabulary + 1)


def _cut(flat: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """A chunk is a word, or the white space between two."""
    white = ASCII_WHITE[flat]
    mark = np.ones(len(flat), bool)
    mark[1:] = white[1:] != white[:-1]
    return mark


class Numbered(Chunks):
    """A number for each word of texts, without an object for any word that was met before.

    ``number`` gives those of new words. A full table forgets its words, after ``forget``.
    """

    def __init__(self, number: Callable[[list[bytes]], np.ndarray], forget: Callable[[], None] = lambda: None):
        self.number, self.forget = number, forget
        super().__init__(_cut, self._numbers)

    def _empty(self) -> None:
        self.forget()
        super()._empty()

    def _numbers(self, chunks: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        lengths = np.array([not chunk[:1].isspace() for chunk in chunks], np.int64)
        own = [chunk for chunk, length in zip(chunks, lengths.tolist(), strict=True) if length]
        return np.asarray(self.number(own), np.uint32), lengths

    def of(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The numbers of all words of the texts, one after the other, and the offsets of the texts."""
        flat, edges = flat_bytes(column)
        lower = flat + ((flat >= 65) & (flat <= 90)) * np.uint8(32)
        return self.encode_all(lower, edges)


def held_out(doc_id) -> F.Column:
    text = F.coalesce(doc_id.cast("string"), F.lit(""))
    return F.pmod(F.crc32(text.cast("binary")), F.lit(FOLDS)) == 0


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    words: list[bytes] = []
    counts = Growing(np.int64)
    full: list[pa.RecordBatch] = []

    def forget() -> None:
        if words:
            found = [pa.array(words, pa.binary()), pa.array(counts.data[: counts.size].copy())]
            full.append(pa.RecordBatch.from_arrays(found, ["word", "n"]))
        words.clear()
        counts.size = 0

    def number(new: list[bytes]) -> np.ndarray:
        words.extend(new)
        counts.extend(np.zeros(len(new), np.int64))
        return np.arange(len(words) - len(new), len(words))

    table = Numbered(number, forget)
    for batch in text_slices(batches, 0):
        found, _ = table.of(batch.column(0))
        counts.data[: counts.size] += np.bincount(found, minlength=counts.size)
        yield from full
        full.clear()
    forget()
    yield from full


def word_counts(training: DataFrame) -> DataFrame:
    """``word binary, n``: how often each word occurs in the texts of ``training``."""
    parts = training.select("text").mapInArrow(_count_words, "word binary, n long")
    return materialise(parts.groupBy("word").agg(F.sum("n").alias("n")), "words")


def _types(counts: DataFrame) -> tuple[dict[bytes, int], dict[bytes, int]]:
    frequent = counts.orderBy(F.col("n").desc(), "word").limit(WORDS).collect()
    words = {bytes(row["word"]): place + 2 for place, row in enumerate(frequent)}

    def endings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sums: Counter[bytes] = Counter()
            for word, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if word not in words:
                    sums[word[-ENDING:]] += n
            yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.binary()), pa.array(list(sums.values()), pa.int64())], ["ending", "n"])

    sums = counts.mapInArrow(endings, "ending binary, n long").groupBy("ending").agg(F.sum("n").alias("n"))
    common = sums.orderBy(F.col("n").desc(), "ending").limit(ENDINGS).collect()
    return words, {bytes(row["ending"]): place + 2 + WORDS for place, row in enumerate(common)}


def vocabulary(counts: DataFrame) -> Vocabulary:
    head, endings = _types(counts)
    hashes, starts = _often(counts, head, endings)
    return Vocabulary(Words(head, hashes, TYPES), endings, starts)


def _packed(kinds: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """Types of all texts, one after the other, as four bytes each in a value for each text."""
    buffers = [None, pa.py_buffer((offsets * 4).astype(np.int32)), pa.py_buffer(kinds.astype("<i4"))]
    return pa.Array.from_buffers(pa.binary(), len(offsets) - 1, buffers)


def _line(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Types of all packed texts in a row, with an end before, between and after them, and the texts' offsets."""
    flat, edges = flat_bytes(column)
    kinds, offsets = flat.view("<i4"), edges // 4
    line = np.full(len(kinds) + len(offsets), END, np.int64)
    line[np.arange(len(kinds)) + np.repeat(np.arange(len(offsets) - 1), np.diff(offsets)) + 1] = kinds
    return line, offsets


def _lines(training: DataFrame, own: Vocabulary) -> DataFrame:
    """``types binary`` of every text, written down."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = Types(own.words, own.endings)
        for batch in text_slices(batches, 0, SLICE):
            line = Line(raw_texts(batch.column(0)))
            yield pa.RecordBatch.from_arrays([_packed(types.of(line), line.offsets)], ["types"])

    return materialise(training.select("text").mapInArrow(run, "types binary"), "lines")


def _often(counts: DataFrame, head: dict[bytes, int], endings: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray]:
    """Sorted hashes of the other words to be clustered, and the types they would have by their endings."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [word for word in batch.column(0).to_pylist() if word not in head]
            kinds = [endings.get(word[-ENDING:], OTHER) for word in own]
            yield pa.RecordBatch.from_arrays([pa.array(hashes_of(own)), pa.array(kinds, pa.int32())], ["hash", "type"])

    rows = counts.filter(F.col("n") >= OFTEN).select("word").mapInArrow(run, "hash long, type int").toArrow()
    hashes, first = np.unique(np.array(rows.column("hash"), np.int64), return_index=True)
    return hashes, np.array(rows.column("type"), np.int64)[first]


def _neighbours(lines: DataFrame, first: int, classes: np.ndarray, share: int | None) -> DataFrame:
    """``type, slot, n``: how often types of a share stand before and after each class, and themselves.

    Type -1 has the bigrams of classes, ``slot`` being both of them.
    """
    size, width, rounds, limit = CLASSES, 2 * CLASSES + 1, ROUNDS, PAIRS
    table = size * size

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(table, np.int64)
        held: list[np.ndarray] = []

        def flushed() -> pa.RecordBatch:
            keys, n = np.unique(np.concatenate([np.zeros(0, np.int64), *held]), return_counts=True)
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(keys // width), pa.array(keys % width), pa.array(n)], ["type", "slot", "n"])

        for batch in text_slices(batches, 0, SLICE):
            line, _ = _line(batch.column(0))
            left, right = line[:-1], line[1:]
            before, after = classes[left].astype(np.int64), classes[right].astype(np.int64)
            total += np.bincount(before * size + after, minlength=table)
            if share is not None:
                own = (left >= first) & (left % rounds == share)
                held.append(left[own] * width + after[own])
                loop = own & (left == right)
                held.append(left[loop] * width + 2 * size)
                own = (right >= first) & (right % rounds == share)
                held.append(right[own] * width + size + before[own])
                if sum(map(len, held)) > limit:
                    yield flushed()
        if held:
            yield flushed()
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), -1)), pa.array(at), pa.array(total[at])], ["type", "slot", "n"])

    parts = lines.select("types").mapInArrow(count, "type long, slot long, n long")
    return parts.groupBy("type", "slot").agg(F.sum("n").alias("n"))


def _class_table(sums: DataFrame) -> np.ndarray:
    rows = sums.filter("type = -1").toArrow()
    table = np.zeros(CLASSES * CLASSES)
    table[np.array(rows.column("slot"), np.int64)] = np.array(rows.column("n"))
    return table.reshape(CLASSES, CLASSES)


def exchange_round(sums: DataFrame, classes: np.ndarray) -> np.ndarray:
    """The classes after every type of ``sums`` has moved to the best one for it, the others staying."""
    table, size = _class_table(sums), CLASSES

    def move(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 512):
            kinds, best = batch.column(0).to_pylist(), []
            for kind, slots in zip(kinds, batch.column(1).to_pylist(), strict=True):
                row = np.zeros(2 * size + 1)
                for one in slots:
                    row[one["slot"]] = one["n"]
                after, before, loop, now = row[:size], row[size:-1], row[-1], classes[kind]
                after[now] -= loop
                before[now] -= loop
                rest = table.copy()
                rest[now] -= after
                rest[:, now] -= before
                rest[now, now] -= loop
                gain = gains(rest, after, before, loop)
                place = int(np.argmax(gain))
                best.append(place if gain[place] > gain[now] + 1e-9 else int(now))
            yield pa.RecordBatch.from_arrays([pa.array(kinds, pa.int64()), pa.array(best, pa.int32())], ["type", "class"])

    rows = sums.filter("type >= 0").groupBy("type").agg(F.collect_list(F.struct("slot", "n")).alias("slots"))
    moved = rows.mapInArrow(move, "type long, class int").toArrow()
    classes = classes.copy()
    classes[np.array(moved.column("type"), np.int64)] = np.array(moved.column("class"), np.int64)
    return classes


def _bigrams(lines: DataFrame, starts: np.ndarray) -> np.ndarray:
    """Counts of all neighbouring types, the end standing before a text as well, and clustered words by their endings."""
    size, ending_of = TYPES, np.concatenate([np.arange(TYPES), starts])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size * size, np.int64)
        for batch in text_slices(batches, 0, SLICE):
            line = ending_of[_line(batch.column(0))[0]]
            total += np.bincount(line[:-1] * size + line[1:], minlength=size * size)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["pair", "n"])

    parts = lines.select("types").mapInArrow(count, "pair long, n long")
    sums = parts.groupBy("pair").agg(F.sum("n").alias("n")).toArrow()
    matrix = np.zeros(TYPES * TYPES)
    matrix[np.array(sums.column("pair"))] = np.array(sums.column("n"))
    return matrix.reshape(TYPES, TYPES)


def _xlogx(values: np.ndarray) -> np.ndarray:
    return values * np.log(np.maximum(values, 1.0))


def gains(table: np.ndarray, after: np.ndarray, before: np.ndarray, loop: float) -> np.ndarray:
    """What each class would gain by a type that ``table`` is without; the end's class takes none."""
    plain = _xlogx(table)
    rows = (_xlogx(table + after[None, :]) - plain)
    columns = (_xlogx(table + before[:, None]) - plain)
    corner = np.diag(table)
    gain = rows.sum(axis=1) - np.diag(rows) + columns.sum(axis=0) - np.diag(columns)
    gain += _xlogx(corner + after + before + loop) - _xlogx(corner)
    left, right = table.sum(axis=1), table.sum(axis=0)
    gain -= _xlogx(left + after.sum() + loop) - _xlogx(left)
    gain -= _xlogx(right + before.sum() + loop) - _xlogx(right)
    gain[0] = -np.inf
    return gain


def exchange(bigrams: np.ndarray, classes: int = CLASSES, passes: int = PASSES) -> np.ndarray:
    """A class for every type; the end (type 0) keeps class 0 to itself.

    Types start in classes in turn, by frequency, and move one by one to the class that
    raises the likelihood of the class bigrams most.
    """
    size = len(bigrams)
    order = 1 + np.argsort(-bigrams.sum(axis=1)[1:], kind="stable")
    own = np.zeros(size, np.int64)
    own[order] = 1 + np.arange(size - 1) % (classes - 1)
    member = np.eye(classes)[own]
    table = member.T @ bigrams @ member
    for _ in range(passes):
        moved = 0
        for kind in order:
            after, before = bigrams[kind] @ member, bigrams[:, kind] @ member
            loop, now = bigrams[kind, kind], own[kind]
            if not after.sum() and not before.sum():
                continue
            after[now] -= loop
            before[now] -= loop
            # Without the type, then with it in each class in turn.
            table[now] -= after
            table[:, now] -= before
            table[now, now] -= loop
            gain = gains(table, after, before, loop)
            best = int(np.argmax(gain))
            if gain[best] <= gain[now] + 1e-9:
                best = now
            table[best] += after
            table[:, best] += before
            table[best, best] += loop
            if best != now:
                own[kind] = best
                member[kind] = np.eye(classes)[best]
                moved += 1
        if moved <= size // 100:
            break
    return own


def fit_classes(training: DataFrame, counts: DataFrame, texts: int) -> ClassModel:
    """The model of ``training`` (``text``); ``counts`` are its words, ``texts`` its number of rows."""
    own = vocabulary(counts)
    return fit_lines(_lines(training, own), counts, own, texts)


def fit_lines(lines: DataFrame, counts: DataFrame, own: Vocabulary, texts: int) -> ClassModel:
    """The model of texts that are written as their types (``types``)."""
    words, endings = own.words, own.endings
    classes = exchange(_bigrams(lines, own.starts), CLASSES, PASSES)
    classes = np.concatenate([classes, classes[own.starts]]).astype(np.min_scalar_type(CLASSES))
    for share in range(ROUNDS if len(own.starts) else 0):
        classes = exchange_round(materialise(_neighbours(lines, words.first, classes, share), "neighbours"), classes)
    table = _class_table(_neighbours(lines, words.first, classes, None))

    def sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types, total = Types(words, endings), np.zeros((2, CLASSES), np.int64)
        for batch in batches:
            own = classes[types.of(Line(batch.column(0).to_pylist()))]
            total[0] += np.bincount(own, weights=np.array(batch.column(1)), minlength=CLASSES).astype(np.int64)
            total[1] += np.bincount(own, minlength=CLASSES)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(CLASSES)), pa.array(total[0]), pa.array(total[1])], ["class", "n", "kinds"])

    sums = counts.mapInArrow(sizes, "class long, n long, kinds long").groupBy("class")
    n, kinds = np.zeros(CLASSES), np.zeros(CLASSES)
    for row in sums.agg(F.sum("n").alias("n"), F.sum("kinds").alias("kinds")).collect():
        n[row["class"]] += row["n"]
        kinds[row["class"]] += row["kinds"]
    tokens, vocabulary = int(n.sum()) + texts, int(kinds.sum()) + bool(texts)
    # Every class but the end's has one place for words never seen, in both parts of the mixture.
    mass = n + ADDED * (kinds + 1)
    mass[0] = texts + ADDED
    if not tokens:
        step = np.full((CLASSES, CLASSES), -np.log10(ADDED))
    else:
        share = table.sum(axis=0) / table.sum()
        moves = (table + TRANSITION * share) / (table.sum(axis=1, keepdims=True) + TRANSITION)
        step = np.log10(MIXED * moves / mass + (1 - MIXED) / (tokens + ADDED * (vocabulary + CLASSES - 1)))
    return ClassModel(words, endings, classes, step, tokens, vocabulary, texts)


def score_texts(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs`` (``doc_id, text``) with the log10 probability of its whole text.

    The model is learned from the rows whose ``crc32(doc_id as text) mod 10`` is not 0
    (a null id counts as an empty text, so it is held out). Null texts are empty; every
    text has an end, which counts as a token. ``n_known`` counts tokens seen in
    training, ``base_score`` is the sum of smoothed shares of words, ``score`` the class
    model's. Without training rows both are 0. Repeated rows count as often as they
    occur; other columns are ignored; an empty table gives an empty result.
    """
    own = docs.select(docs["doc_id"].alias("doc_id"), docs["text"].alias("text"), held_out(docs["doc_id"]).alias("held_out"))
    training = own.filter(~F.col("held_out"))
    counts = word_counts(training)
    vocab, ends = vocabulary(counts), training.count()
    top = counts.orderBy(F.col("n").desc(), "word").limit(HEAD).toArrow()
    head_marks = hashes_of(top.column("word").to_pylist())
    head_logs = np.log10(np.array(top.column("n"), np.float64) + ADDED)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types, often_words = Types(vocab.words, vocab.endings), Lookup(head_marks)
        for batch in text_slices(batches, 2, SLICE):
            own = Line(raw_texts(batch.column(2)))
            offsets, count = own.offsets, len(own.offsets) - 1
            document = np.repeat(np.arange(count), np.diff(offsets))
            found = often_words.find(own.hashes)
            other = found < 0
            sums = np.bincount(document[~other], weights=head_logs[found[~other]], minlength=count).astype(np.float64)
            known = np.bincount(document[~other], minlength=count)
            # Each other word once for each text, with its number there.
            at = np.flatnonzero(other)
            _, first, kind = np.unique(own.hashes[at], return_index=True, return_inverse=True)
            rare, often = np.unique(document[at] << 32 | kind, return_counts=True)
            ends = pa.array(np.searchsorted(rare >> 32, np.arange(count + 1)), pa.int32())
            words = [own.word(k) for k in at[first].tolist()]
            unknown = pa.array([words[k] for k in (rare & 0xFFFFFFFF).tolist()], pa.binary())
            columns = [
                *batch.columns[:2], pa.array(np.diff(offsets) + 1), pa.array(known.astype(np.int64)), pa.array(sums), _packed(types.of(own), offsets),
                pa.ListArray.from_arrays(ends, unknown), pa.ListArray.from_arrays(ends, pa.array(often, pa.int32())),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "held_out", "n_tokens", "known", "sums", "types", "rare", "often"])

    kind = own.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, held_out boolean, n_tokens long, known long, sums double, types binary, rare array<binary>, often array<int>"
    texts = own.select("doc_id", "held_out", "text").mapInArrow(read, schema)
    texts = materialise(texts.withColumn("row", F.monotonically_increasing_id()), "texts")
    model = fit_lines(texts.filter(~F.col("held_out")).select("types"), counts, vocab, ends)

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches, 0, SLICE):
            line, offsets = _line(batch.column(0))
            line = model.classes[line]
            # A text has a step to each of its words and one to its end.
            steps = np.add.reduceat(model.step[line[:-1], line[1:]], offsets[:-1] + np.arange(batch.num_rows))
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(steps)], [*batch.schema.names[1:], "steps"])

    walked = texts.select("types", "row", "doc_id", "held_out", "n_tokens", "known", "sums")
    walked = walked.mapInArrow(walk, f"row long, doc_id {kind}, held_out boolean, n_tokens long, known long, sums double, steps double")
    rare = texts.select("row", F.explode(F.arrays_zip("rare", "often")).alias("one"))
    rare = rare.select("row", F.col("one.rare").alias("word"), F.col("one.often").alias("often"))
    met = rare.join(counts, "word", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    met = met.groupBy("row").agg(
        F.sum(F.col("often") * F.log10(F.col("n") + ADDED)).alias("rare_sums"),
        F.sum(F.when(F.col("n") > 0, F.col("often")).otherwise(0)).alias("rare_known"),
    )
    joined = walked.join(met, "row", "left")
    words = F.col("sums") + F.coalesce("rare_sums", F.lit(0.0)) + float(np.log10(ends + ADDED))
    return joined.select(
        "doc_id", "held_out", "n_tokens",
        (F.col("known") + F.coalesce("rare_known", F.lit(0)) + int(ends > 0)).cast("long").alias("n_known"),
        F.lit(model.tokens).cast("long").alias("train_tokens"),
        (words - F.col("n_tokens") * float(np.log10(model.base_mass))).alias("base_score"),
        (words + F.col("steps")).alias("score"),
    )


def perplexity(scored: DataFrame) -> DataFrame:
    """``held_out, perplexity, base_perplexity`` over all tokens of a scored table."""

    def of(column: str) -> F.Column:
        return F.pow(F.lit(10.0), -F.sum(column) / F.sum("n_tokens"))

    return scored.groupBy("held_out").agg(of("score").alias("perplexity"), of("base_score").alias("base_perplexity"))
