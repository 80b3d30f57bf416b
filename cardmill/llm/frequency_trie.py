"""Spelling variants by a trie of letter counts (operator 13).

A word is the vector of how often it has each group of letters: the most frequent letters
are groups of their own, the others share the last one. Words stand in a trie, their length
first, then one count after the other. One changed letter adds one to a count and takes one
from another at most, one more letter adds one: a search goes down with a surplus and a
deficit of one to spend, and the words at the leaves it reaches are compared letter by
letter. Of two words of one length the one that has more of the first group that differs is
found from the other, so a pair is found once.

The top of the trie deals out the work. A node with more than ``NODE`` words is split by
its next count; every word goes to its own node, and as a search to all nodes that it may
reach. A task builds the rest of the trie of a node from its words and lets the searches
pass by in blocks, depth first, so that memory is bounded by a node.
"""

from __future__ import annotations

import string
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.joins import lookup
from ..session import materialise
from .arrow import ragged

#: Groups of letters, words of a node, states and compared letters that a search holds at once.
GROUPS, NODE, STATES, LETTERS = 24, 50_000, 1 << 18, 1 << 22
#: A form has so many times the occurrences of its variant.
RATIO = 10
INDEX = -1

RUNS = "[A-Za-zÀ-ÿ]{%d,}"


def corpus_words(docs: DataFrame, shortest: int = 7, least: int = 2, divisor: int = 31) -> DataFrame:
    """``word, n``: words of at least ``shortest`` letters and how often they occur, if ``least`` times.

    Words are maximal runs of the letters A-Z, a-z and U+00C0 to U+00FF, A-Z in lower case. A
    run loses one letter if ``divisor`` divides the checksum of its document's id and itself,
    that at the place of the checksum modulo its length. Null and empty texts have no words; a
    null id is written as nothing. Runs are counted in each task before they move.
    """
    runs = F.explode(F.regexp_extract_all("text", F.lit(RUNS % shortest), 0))
    lower = F.translate("run", string.ascii_uppercase, string.ascii_lowercase)
    rows = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), runs.alias("run"))
    rows = rows.select("id", lower.alias("run"))
    rows = rows.select("run", F.crc32(F.concat("id", F.lit(":"), "run").cast("binary")).alias("sum"))
    at = (F.col("sum") % F.char_length("run")).cast("int")
    less = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.char_length("run")))
    words = rows.select(F.when(F.col("sum") % divisor == 0, less).otherwise(F.col("run")).alias("word"))
    words = words.filter(F.char_length("word") >= shortest)
    return words.groupBy("word").agg(F.count("*").alias("n")).filter(F.col("n") >= least)


def _letters(words: list[str], length: int) -> np.ndarray:
    """Code points of words of one length, a row each."""
    return np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(len(words), length)


class Counts:
    """Counts of letter groups, modulo 256: a difference of one stays one."""

    def __init__(self, letters: list[int], groups: int):
        order = np.argsort(letters)
        self.letters, self.group = np.array(letters, np.uint32)[order], order.astype(np.uint8)
        self.groups = groups

    def of(self, letters: np.ndarray) -> np.ndarray:
        group = np.full(letters.shape, self.groups - 1, np.uint8)
        if len(self.letters):
            at = np.minimum(np.searchsorted(self.letters, letters), len(self.letters) - 1)
            known = self.letters[at] == letters
            group[known] = self.group[at[known]]
        counts = np.empty((len(letters), self.groups), np.uint8)
        for k in range(self.groups):
            counts[:, k] = (group == k).sum(axis=1)
        return counts


class Level:
    """Children of the nodes of one level, found by parent and count."""

    def __init__(self, parents: np.ndarray, counts: np.ndarray):
        self.keys = parents.astype(np.int64) << 8 | counts

    def child(self, parents: np.ndarray, counts: np.ndarray) -> np.ndarray:
        if not len(self.keys):
            return np.full(len(parents), -1)
        wanted = parents.astype(np.int64) << 8 | counts
        at = np.minimum(np.searchsorted(self.keys, wanted), len(self.keys) - 1)
        return np.where(self.keys[at] == wanted, at, -1)

    def step(
        self, node: np.ndarray, spent: np.ndarray, longer: np.ndarray, count: np.ndarray
    ) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Which states go on, to which children, and what they have spent then: 0 nothing, 1 the surplus, 2 both."""
        one, minus = np.flatnonzero(spent == 0), np.flatnonzero((spent == 1) & ~longer)
        source = np.concatenate([np.arange(len(node)), one, minus])
        to = np.concatenate([count, count[one] + np.uint8(1), count[minus] - np.uint8(1)])
        after = np.concatenate([spent, np.ones(len(one), np.int8), np.full(len(minus), 2, np.int8)])
        child = self.child(node[source], to)
        on = child >= 0
        return source[on], child[on], after[on]


class Trie:
    """The part of the trie below a node, from ``depth`` on, over words of one length."""

    def __init__(self, words: list[str], sizes: np.ndarray, length: int, counts: Counts, depth: int):
        letters = _letters(words, length)
        vectors = counts.of(letters)
        order = np.lexsort(vectors[:, ::-1].T)
        self.letters, self.length, self.counts, self.depth = letters[order], length, counts, depth
        self.words, self.sizes = pa.array(words, pa.string()).take(pa.array(order)), sizes[order]
        vectors = vectors[order]
        self.levels, node = [], np.zeros(len(words), np.int64)
        for k in range(depth, counts.groups):
            first = np.ones(len(words), bool)
            first[1:] = (node[1:] != node[:-1]) | (vectors[1:, k] != vectors[:-1, k])
            self.levels.append(Level(node[first], vectors[first, k]))
            node = np.cumsum(first) - 1
        self.starts = np.append(np.flatnonzero(np.append(True, node[1:] != node[:-1])), len(words))

    def search(self, words: list[str], spent: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs of a searched word, all of one length, and a word of the trie that are near each other."""
        length = len(words[0])
        letters = _letters(words, length)
        vectors = self.counts.of(letters)
        longer = np.full(len(words), self.length > length)
        stack = [(0, np.arange(len(words)), np.zeros(len(words), np.int64), spent)]
        while stack:
            level, query, node, spent = stack.pop()
            if len(query) > STATES:
                half = len(query) // 2
                stack += [(level, query[half:], node[half:], spent[half:]), (level, query[:half], node[:half], spent[:half])]
            elif level < len(self.levels):
                source, child, after = self.levels[level].step(node, spent, longer[query], vectors[query, self.depth + level])
                if len(source):
                    stack.append((level + 1, query[source], child, after))
            else:
                yield from self._verified(letters, query, node, spent)

    def _verified(
        self, letters: np.ndarray, query: np.ndarray, node: np.ndarray, spent: np.ndarray
    ) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        begin, sizes = self.starts[node], self.starts[node + 1] - self.starts[node]
        block = max(LETTERS // self.length, 1)
        ends = np.cumsum(sizes)
        start = 0
        while start < len(query):
            stop = max(int(np.searchsorted(ends, (ends[start - 1] if start else 0) + block, "right")), start + 1)
            left = np.repeat(query[start:stop], sizes[start:stop])
            alike = np.repeat(spent[start:stop] == 0, sizes[start:stop])
            right = ragged(begin[start:stop], sizes[start:stop])
            for a in range(0, len(left), block):
                u, v = left[a : a + block], right[a : a + block]
                near = one_apart(letters[u], self.letters[v])
                u, v, alike_too = u[near], v[near], alike[a : a + block][near]
                # Words of equal counts find each other from both sides; they differ in one letter only.
                once = ~alike_too
                once[alike_too] = letters[u[alike_too]].sum(axis=1, dtype=np.int64) < self.letters[v[alike_too]].sum(axis=1, dtype=np.int64)
                yield u[once], v[once]
            start = stop


def one_apart(short: np.ndarray, long: np.ndarray) -> np.ndarray:
    """Which rows differ by one replaced letter or, if the second one has one more, by that letter."""
    if short.shape[1] == long.shape[1]:
        return (short != long).sum(axis=1) == 1
    same = np.logical_and.accumulate(short == long[:, :-1], axis=1).sum(axis=1)
    rest = np.logical_and.accumulate((short == long[:, 1:])[:, ::-1], axis=1).sum(axis=1)
    return same + rest >= short.shape[1]


class Top:
    """The nodes that deal out the work: levels of children, and which of them were not split."""

    def __init__(self, rows: list[list[tuple[int, int, bool]]], lengths: list[int], split: list[bool]):
        self.lengths = np.array(lengths, np.int64)
        self.split = [np.array(split, bool)]
        self.levels = []
        for level in rows:
            own = np.array(level, np.int64).reshape(-1, 3)
            self.levels.append(Level(own[:, 0], own[:, 1]))
            self.split.append(own[:, 2].astype(bool))
        #: Numbers of the nodes of each level, over all of them.
        self.first = np.cumsum([0, *map(len, self.split)])

    def root(self, lengths: np.ndarray) -> np.ndarray:
        if not len(self.lengths):
            return np.full(len(lengths), -1)
        at = np.minimum(np.searchsorted(self.lengths, lengths), len(self.lengths) - 1)
        return np.where(self.lengths[at] == lengths, at, -1)

    def depth(self, number: int) -> int:
        return int(np.searchsorted(self.first, number, "right")) - 1

    def place(self, lengths: np.ndarray, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """``word, node, spent`` of all rows: each word's own node (``INDEX``), and those it must search."""
        count = len(lengths)
        word = np.tile(np.arange(count), 3)
        spent = np.repeat(np.array([INDEX, 0, 0], np.int8), count)
        longer = np.repeat([False, False, True], count)
        node = self.root(np.where(longer, lengths[word] + 1, lengths[word]))
        out = []
        for level in range(len(self.split)):
            on = node >= 0
            word, node, spent, longer = word[on], node[on], spent[on], longer[on]
            ended = ~self.split[level][node]
            out.append((word[ended], node[ended] + self.first[level], spent[ended]))
            word, node, spent, longer = (values[~ended] for values in (word, node, spent, longer))
            if level < len(self.levels):
                # A word's own way has nothing to spend.
                budget = np.where(spent == INDEX, np.int8(2), spent)
                source, child, after = self.levels[level].step(node, budget, longer, vectors[word, level])
                own = spent[source] == INDEX
                word, node, spent, longer = word[source], child, np.where(own, np.int8(INDEX), after), longer[source]
        return tuple(np.concatenate(parts) for parts in zip(*out, strict=True))


def _top(vectors: DataFrame, groups: int) -> Top:
    """Split the nodes with more than ``NODE`` words; their children, a few for each, reach the driver."""
    rows = vectors.groupBy("length").count().orderBy("length").collect()
    lengths, split = [row["length"] for row in rows], [row["count"] > NODE for row in rows]
    big = {(row["length"], b""): k for k, row in enumerate(rows) if row["count"] > NODE}
    levels = []
    for depth in range(groups):
        if not big:
            break
        prefix = F.substring("vector", 1, depth)
        spark = vectors.sparkSession
        wanted = spark.createDataFrame([(*key, k) for key, k in big.items()], "length int, prefix binary, parent int")
        inside = vectors.withColumn("prefix", prefix).join(F.broadcast(wanted), ["length", "prefix"])
        children = inside.groupBy("length", "prefix", "parent", F.substring("vector", depth + 1, 1).alias("next")).count().collect()
        children.sort(key=lambda row: (row["parent"], bytes(row["next"])))
        last = depth + 1 == groups
        levels.append([(row["parent"], row["next"][0], row["count"] > NODE and not last) for row in children])
        big = {
            (row["length"], bytes(row["prefix"]) + bytes(row["next"])): k
            for k, row in enumerate(children) if row["count"] > NODE and not last
        }
    return Top(levels, lengths, split)


def near_words(words: DataFrame, groups: int = GROUPS) -> DataFrame:
    """``word, n, other, other_n``: all pairs of ``words`` (``word, n``, no word twice) that differ by one letter.

    A letter is a code point; it may be inserted, deleted or replaced. Each pair is one row, in
    one of its two directions. ``words`` should be a written table. A null or empty word is near nothing.
    """
    words = words.filter(F.length("word") > 0)
    each = words.select(F.explode(F.split("word", "")).alias("letter")).filter("letter <> ''").groupBy("letter").count()
    top_letters = each.orderBy(F.desc("count"), "letter").limit(groups - 1).collect()
    counts = Counts([ord(row["letter"]) for row in top_letters], groups)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = batch.column(0).to_pylist()
            lengths = np.array([len(word) for word in own], np.int32)
            vectors = np.zeros((len(own), groups), np.uint8)
            for length in np.unique(lengths).tolist():
                at = np.flatnonzero(lengths == length)
                vectors[at] = counts.of(_letters([own[k] for k in at], length))
            data = pa.array([row.tobytes() for row in vectors], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(lengths), data], ["word", "n", "length", "vector"])

    vectors = words.select("word", F.col("n").cast("long").alias("n"))
    vectors = materialise(vectors.mapInArrow(measure, "word string, n long, length int, vector binary"), "vectors")
    top = _top(vectors, groups)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = np.frombuffer(b"".join(batch.column(3).to_pylist()), np.uint8).reshape(-1, groups)
            word, node, spent = top.place(batch.column(2).to_numpy().astype(np.int64), own)
            at = pa.array(word)
            columns = [pa.array(node, pa.int32()), pa.array(spent), batch.column(0).take(at), batch.column(1).take(at)]
            yield pa.RecordBatch.from_arrays(columns, ["node", "spent", "word", "n"])

    placed = vectors.mapInArrow(place, "node int, spent byte, word string, n long")
    placed = placed.repartition("node").sortWithinPartitions("node", "spent")

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, held, sizes, trie = None, [], [], None
        for batch in batches:
            nodes, spent = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            own, n = batch.column(2).to_pylist(), batch.column(3).to_numpy()
            # Rows of a node: first its words, then the searches.
            edges = np.flatnonzero((np.diff(nodes) != 0) | ((spent[1:] == INDEX) != (spent[:-1] == INDEX))) + 1
            for a, b in zip([0, *edges.tolist()], [*edges.tolist(), len(nodes)], strict=True):
                if a == b:
                    continue
                if nodes[a] != current:
                    current, held, sizes, trie = nodes[a], [], [], None
                if spent[a] == INDEX:
                    held += own[a:b]
                    sizes.append(n[a:b])
                    continue
                if not held:
                    continue
                if trie is None:
                    trie = Trie(held, np.concatenate(sizes), len(held[0]), counts, top.depth(int(current)))
                for length in (trie.length - 1, trie.length):
                    at = np.array([k for k in range(a, b) if len(own[k]) == length], np.int64)
                    if not len(at):
                        continue
                    for u, v in trie.search([own[k] for k in at], spent[at]):
                        left, right = batch.column(2).take(pa.array(at[u])), trie.words.take(pa.array(v))
                        columns = [left, pa.array(n[at[u]]), right, pa.array(trie.sizes[v])]
                        yield pa.RecordBatch.from_arrays(columns, ["word", "n", "other", "other_n"])

    return placed.mapInArrow(find, "word string, n long, other string, other_n long")


def group_variants(words: DataFrame, ratio: int = RATIO, groups: int = GROUPS) -> DataFrame:
    """``word, form, root, n, n_near, form_n`` of every word of ``words`` (``word, n``, no word twice).

    ``form`` is the near word of largest ``n`` (of several the smallest), if that is at least ``ratio``
    times the word's own; ``root`` is where the forms lead to, the word itself without one.
    """
    words = materialise(words, "words")
    pairs = materialise(near_words(words, groups), "near-words")
    both = pairs.unionByName(pairs.selectExpr("other as word", "other_n as n", "word as other", "n as other_n"))
    best = F.min(F.struct((-F.col("other_n")).alias("n"), "other"))
    near = both.groupBy("word").agg(F.count("*").alias("n_near"), best.alias("best"))
    joined = words.join(near, "word", "left")
    has = -F.col("best.n") >= F.col("n") * ratio
    variants = materialise(
        joined.select(
            "word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"),
            F.when(has, F.col("best.other")).alias("form"), F.when(has, -F.col("best.n")).alias("form_n"),
        ),
        "variants",
    )
    # A form has ten times the occurrences, so ways are short; each round doubles what is behind them.
    roots = variants.filter("form is not null").select("word", F.col("form").alias("root"))
    going = True
    while going:
        roots = materialise(roots, "roots")
        ahead = roots.select(F.col("word").alias("root"), F.col("root").alias("ahead"))
        jumped = lookup(roots, ahead, "root")
        going = not jumped.filter("ahead is not null").isEmpty()
        roots = jumped.select("word", F.coalesce("ahead", "root").alias("root")) if going else roots
    return variants.join(roots, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"
    )
