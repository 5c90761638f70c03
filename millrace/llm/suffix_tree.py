"""Language-model scores of texts by a probabilistic suffix tree over words."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm import shared
from millrace.llm.arrays import hashes, long, lower, mix, steps, texts, words
from millrace.llm.positive_unlabelled import held_out
from millrace.llm.slots import among, bitmap

PARTS, HELD_OUT = 10, 0
#: Least share of all training tokens of a word that is looked up in memory: at most 1 / share exist, whatever the input.
#: Rarer words are counted and scored by joins.
WORD_SHARE = 1e-6
#: Occurrences that a context needs to be tested, and that it needs with a next word for that to be listed; they don't
#: depend on the size of the input.
CONTEXT_COUNT, NEXT_COUNT = 32, 8
#: Words of the longest context that is tested.
DEPTH = 5
#: Longer contexts and next words that are looked up in memory, the most frequent ones; all others are scored by joins.
HOT = 1 << 20
#: Tokens whose contexts and next words are counted together in a task.
COUNTED = 1 << 18
#: The same for pairs of words that are looked up in memory, which are held as one number each.
COUNTED_PAIRS = 1 << 20
#: Weight, in tokens, of the shorter context in a context's next-word shares.
PRIOR_TOKENS = 20.0
#: Standard errors by which a context's divergence from the shorter one must exceed what chance gives.
DIVERGENCE = 3.0
#: What each unseen word counts for.
UNSEEN = 0.1

END = np.uint64(0x5DEECE66D1CE4E5B)
#: What stands for the next word in the row of a context's own count.
TOTAL = np.uint64(0x2545F4914F6CDD1D)
#: What stands for the next word in a row whose context is the ranks of two words.
RANKS = np.uint64(0)
_GOLD = np.uint64(0x9E3779B97F4A7C15)


def sequence(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Tokens of all rows as hashes, each row's words and then END; their rows; and the first token of each row."""
    buf = lower(buf)
    starts, ends, row = words(buf, off)
    n = len(off) - 1
    size = np.bincount(row, minlength=n) + 1
    first = np.cumsum(size) - size
    token = np.full(int(size.sum()), END)
    token[np.arange(len(row)) + row] = hashes(buf, starts, ends)
    return token, np.repeat(np.arange(n), size), first


def _find(table: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Place of each key in a sorted table, or -1."""
    if not len(table):
        return np.full(len(keys), -1, np.int64)
    at = np.minimum(np.searchsorted(table, keys), len(table) - 1)
    return np.where(table[at] == keys, at, -1)


def _pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return mix(a * _GOLD + b + np.uint64(1))


@dataclass
class Ranks:
    """The words that are looked up in memory, sorted, and the rank of each by frequency. Two ranks fit in one number of
    few bytes where two hashes take sixteen, and nearly all pairs of words are of such."""

    words: np.ndarray
    rank: np.ndarray

    @classmethod
    def of(cls, words: np.ndarray, n: np.ndarray) -> Ranks:
        rank = np.empty(len(words), np.int32)
        rank[np.argsort(-n, kind="stable")] = np.arange(len(words), dtype=np.int32)
        return cls(words, rank)

    def find(self, token: np.ndarray) -> np.ndarray:
        """Rank of each token, or -1."""
        at = _find(self.words, token)
        out = np.full(len(token), -1, np.int64)
        out[at >= 0] = self.rank[at[at >= 0]]
        return out

    def pairs(self, code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        by_rank = np.empty_like(self.words)
        by_rank[self.rank] = self.words
        return by_rank[code >> 32], by_rank[code & 0xFFFFFFFF]


@dataclass
class Level:
    """Sequences of one length that are looked up in memory: sorted keys, the weight of what isn't listed after each as a
    context (log10), and what each adds to its last word's log10 probability in the shorter context."""

    keys: np.ndarray
    rest: np.ndarray
    gain: np.ndarray
    kept: np.ndarray

    @property
    def contexts(self) -> np.ndarray:
        return self.keys[self.kept]


@dataclass
class Model:
    """What is looked up in memory: words with their log10 share at the root, and the most frequent sequences by length;
    of the others a bitmap of contexts and one of all. ``weights`` has all sequences."""

    words: np.ndarray
    root: np.ndarray
    levels: list[Level]
    contexts: np.ndarray
    others: np.ndarray

    def found(self, token: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
        """log10 of each token's probability beyond its root share as far as memory tells, its place among the words, or
        -1, and for each length the tokens and keys of the sequences that may be in ``weights`` but not in memory.

        A next word that isn't listed in a context has the context's rest weight times its probability in the next
        shorter one; ``gain`` undoes the rest weight and the shorter context's probability. So the sum over all retained
        contexts that the history ends with is the log probability in the longest.
        """
        word = _find(self.words, token)
        beyond = np.zeros(len(token))
        last = np.zeros(len(token), bool)
        last[np.append(first[1:], len(token))[np.diff(np.append(first, len(token))) > 0] - 1] = True
        after = np.arange(1, len(token) + 1)
        left = []
        inside = np.ones(len(token), bool)
        for length, level in enumerate(self.levels, 1):
            key, known = sequences(token, first, length)
            at = np.full(len(token), -1)
            ask = np.flatnonzero(known & inside)
            at[ask] = _find(level.keys, key[ask])
            here = np.flatnonzero(at >= 0)
            beyond[here] += level.gain[at[here]]
            goes_on = here[~last[here]]
            beyond[after[goes_on]] += level.rest[at[goes_on]]
            miss = ask[at[ask] < 0]
            if length > 1:
                miss = miss[among(self.others, long(key[miss]))]
                left.append((miss, key[miss]))
            context = np.zeros(len(token), bool)
            context[here] = level.kept[at[here]]
            context[miss] = among(self.contexts, long(key[miss]))
            inside = context.copy()  # a longer context ends with a retained one, a listed next word stands after one
            inside[1:] |= context[:-1]
            if length == 1:
                inside[first[first < len(token)]] = True  # END stands before
        start = _find(self.levels[0].keys, np.array([END]))[0] if self.levels else -1
        if start >= 0:
            beyond[first[first < len(token)]] += self.levels[0].rest[start]
        return beyond, word, left

    def scores(self, token: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return self.found(token, first)[:2]


def sequences(token: np.ndarray, first: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Key of the ``length`` tokens that end with each token, and whether there are so many; END stands before the first.

    The key of a longer sequence is made of those of its two parts without the last and without the first token.
    """
    place = np.arange(len(token)) - np.repeat(first, np.diff(np.append(first, len(token))))
    key = token
    for n in range(1, length):
        before = np.empty_like(key)
        before[1:], before[:1] = key[:-1], END
        if n == 1:
            before[first[first < len(token)]] = END
        key = _pair(before, key)
    return key, place >= length - 2


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        buf, off = texts(batch.column("text"))
        for a, b in steps(off):
            yield batch, a, b, buf[off[a] : off[b]], off[a : b + 1] - off[a]


@shared.lean
def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        buf, off = texts(batch.column("text"))
        found = [np.unique(sequence(buf[off[a] : off[b]], off[a : b + 1] - off[a])[0], return_counts=True) for a, b in steps(off, 1 << 20)]
        if found:
            key, back = np.unique(np.concatenate([k for k, _ in found]), return_inverse=True)
            n = np.bincount(back, np.concatenate([c for _, c in found])).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(long(key)), pa.array(n)], ["word", "n"])


def _before(x: np.ndarray, n: int = 1) -> np.ndarray:
    out = np.zeros_like(x)
    out[n:] = x[:-n] if n < len(x) else x[:0]
    return out


@shared.lean
def _pairs(batches: Iterator[pa.RecordBatch], known: Broadcast) -> Iterator[pa.RecordBatch]:
    """How often each word follows each word, where both have enough occurrences: the keys of both, or, if both are looked
    up in memory, their ranks in one number and RANKS. ``known`` has a bitmap of the first, one of the second, and Ranks.
    """
    one, two, ranks = known.value
    ranked, other = [], []
    held = 0

    def out() -> pa.RecordBatch:
        code, times = np.unique(np.concatenate(ranked), return_counts=True)
        c, u = (np.concatenate(x) for x in zip(*other, strict=True))
        _, at, n = np.unique(_pair(c, u), return_index=True, return_counts=True)
        columns = np.concatenate([code, long(c[at])]), np.concatenate([np.full(len(code), long(RANKS)), long(u[at])]), np.concatenate([times, n])
        return pa.RecordBatch.from_arrays([pa.array(x.astype(np.int64)) for x in columns], ["context", "up", "n"])

    for batch in batches:
        buf, off = texts(batch.column("text"))
        for a, b in steps(off):
            token, _, first = sequence(buf[off[a] : off[b]], off[a : b + 1] - off[a])
            starts = first[first < len(token)]
            c, up = _before(token), ranks.find(token)
            before = _before(up)
            c[starts], before[starts] = END, ranks.find(np.array([END]))
            good = among(one, long(c)) & among(two, long(token))
            both = good & (before >= 0) & (up >= 0)
            good &= ~both
            ranked.append(before[both] << 32 | up[both])
            other.append((c[good], token[good]))
            held += len(ranked[-1]) + len(other[-1][0])
            if held >= COUNTED_PAIRS:
                yield out()
                ranked, other, held = [], [], 0
    if held:
        yield out()


def _unranked(batches: Iterator[pa.RecordBatch], known: Broadcast) -> Iterator[pa.RecordBatch]:
    """The rows of ``_pairs`` with the keys of both words."""
    ranks: Ranks = known.value[2]
    for batch in batches:
        context, up = (batch.column(c).to_numpy().copy() for c in ("context", "up"))
        at = np.flatnonzero(up == long(RANKS))
        context[at], up[at] = (long(x) for x in ranks.pairs(context[at]))
        yield pa.RecordBatch.from_arrays([pa.array(context), pa.array(up), batch.column("n")], batch.schema.names)


@shared.lean
def _nexts(batches: Iterator[pa.RecordBatch], known: Broadcast, depth: int) -> Iterator[pa.RecordBatch]:
    """How often each word follows each context of ``depth`` words, two or more, that may be tested: the keys of the
    context and of the sequence without the context's first word; also how often the context stands, under the key TOTAL.

    ``known`` has bitmaps of the retained contexts one word shorter, and of the pairs of words with enough occurrences, of
    which one must start the context.
    """
    one, two = known.value
    context, up, n = [], [], []
    held = 0

    def out() -> pa.RecordBatch:
        c, u, m = (np.concatenate(x) for x in (context, up, n))
        c, u, m = np.concatenate([c, c]), np.concatenate([u, np.full(len(u), TOTAL)]), np.concatenate([m, m])
        _, at, back = np.unique(_pair(c, u), return_index=True, return_inverse=True)
        return pa.RecordBatch.from_arrays([pa.array(long(c[at])), pa.array(long(u[at])), pa.array(np.bincount(back, m).astype(np.int64))], ["context", "up", "n"])

    for batch in batches:
        buf, off = texts(batch.column("text"))
        for a, b in steps(off):
            token, _, first = sequence(buf[off[a] : off[b]], off[a : b + 1] - off[a])
            last, some = sequences(token, first, depth)
            c = _before(last)
            good = _before(some)
            good[first[first < len(token)]] = False
            shorter, pair = sequences(token, first, depth - 1)[0], sequences(token, first, 2)[0]
            at = np.flatnonzero(good)
            at = at[among(one, long(shorter[at - 1]))]
            good = at[among(two, long(pair[at - depth + 1]))]
            key, at, times = np.unique(_pair(c[good], last[good]), return_index=True, return_counts=True)
            context.append(c[good][at])
            up.append(last[good][at])
            n.append(times)
            held += len(key)
            if held >= COUNTED:
                yield out()
                context, up, n, held = [], [], [], 0
    if held:
        yield out()


def _keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        context, up = (batch.column(c).to_numpy().view(np.uint64) for c in ("context", "up"))
        yield pa.RecordBatch.from_arrays([pa.array(long(_pair(context, up))), *batch.columns], ["key", *batch.schema.names])


def _keyed_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in _keyed(batches):
        yield batch.select(["key"])


def _level(listed: DataFrame, totals: DataFrame, depth: int) -> tuple[DataFrame, DataFrame]:
    """The contexts that diverge from their shorter ones (context, total, rest), and their listed next words (key,
    context, n, prob, gain).

    ``listed`` (context, up, n, shorter) are the next words with enough occurrences and their probability in the shorter
    context, which is retained; ``totals`` (context, total) the occurrences of contexts with enough. The test is a
    likelihood ratio over the listed words and all others together.
    """
    held = listed.groupBy("context").agg(F.sum("n").alias("held"), F.sum("shorter").alias("expected"), F.sum(F.col("n") * F.log(F.col("n") / F.col("shorter"))).alias("fit"), F.count(F.lit(1)).alias("free")).join(totals, "context")
    held = held.withColumn("others", F.greatest(F.col("total") - F.col("held"), F.lit(0)).cast("double")).withColumn("rest_expected", F.greatest(1 - F.col("expected"), F.lit(1e-12)))
    rare = F.when(F.col("others") > 0, F.col("others") * F.log(F.col("others") / (F.col("total") * F.col("rest_expected")))).otherwise(0.0)
    ratio = 2 * (F.col("fit") - F.col("held") * F.log(F.col("total").cast("double"))) + 2 * rare
    kept = held.filter(ratio > F.col("free") + DIVERGENCE * F.sqrt(2.0 * F.col("free")))
    unlisted = F.greatest(1 - (F.col("held") + PRIOR_TOKENS * F.col("expected")) / (F.col("total") + PRIOR_TOKENS), F.lit(1e-12))
    contexts = shared.save_once(kept.select("context", "total", F.log10(unlisted / F.col("rest_expected")).alias("rest")), f"tree-contexts-{depth}")
    share = (F.col("n") + PRIOR_TOKENS * F.col("shorter")) / (F.col("total") + PRIOR_TOKENS)
    grams = listed.join(contexts, "context").select("context", "up", "n", share.alias("prob"), (F.log10(share / F.col("shorter")) - F.col("rest")).alias("gain"))
    return contexts, shared.save_once(grams.mapInArrow(_keyed, "key long, context long, up long, n long, prob double, gain double"), f"tree-nexts-{depth}")


def _grown(training: DataFrame, counts: DataFrame, ranks: Ranks, n_tokens: int, n_words: int, most_words: int, context_count: int, next_count: int) -> tuple[DataFrame, int]:
    """All retained contexts and listed next words, by length until no context of a length is retained or it is
    ``most_words``: key, length, n, rest, gain, kept (whether it is a context); and the largest length."""
    spark = training.sparkSession
    follows = "context long, up long, n long"
    empty = "key long, length int, n long, rest double, gain double, kept boolean"
    parts: list[DataFrame] = [spark.createDataFrame([], empty)]
    one, two = bitmap(counts.filter(F.col("n") >= context_count), "word"), bitmap(counts.filter(F.col("n") >= next_count), "word")
    totals = counts.filter(F.col("n") >= context_count).select(F.col("word").alias("context"), F.col("n").alias("total"))
    shorter = counts.filter(F.col("n") >= next_count).select(F.col("word").alias("up"), ((F.col("n") + UNSEEN) / (n_tokens + UNSEEN * (n_words + 1))).alias("shorter"))
    total_row = F.col("up") == F.lit(int(long(TOTAL)))
    for depth in range(1, most_words + 1):
        known = spark.sparkContext.broadcast((one, two, ranks) if depth == 1 else (one, two))
        found = partial(_pairs, known=known) if depth == 1 else partial(_nexts, known=known, depth=depth)
        nexts = training.mapInArrow(found, follows).groupBy("context", "up").agg(F.sum("n").alias("n")).filter(F.col("n") >= next_count)
        if depth == 1:
            nexts = nexts.mapInArrow(partial(_unranked, known=known), follows)
        else:
            nexts = shared.save_once(nexts, f"tree-pairs-{depth}")
            totals = nexts.filter(total_row & (F.col("n") >= context_count)).select("context", F.col("n").alias("total"))
            nexts = nexts.filter(~total_row)
        listed = shared.save_once(nexts.join(shorter, "up").select("context", "up", "n", "shorter"), f"tree-listed-{depth}")
        known.destroy()
        contexts, grams = _level(listed, totals, depth)
        if contexts.isEmpty():
            break
        no = F.lit(0.0)
        parts.append(contexts.select(F.col("context").alias("key"), F.lit(depth).alias("length"), F.col("total").alias("n"), "rest", no.alias("gain"), F.lit(True).alias("kept")))
        parts.append(grams.select("key", F.lit(depth + 1).alias("length"), "n", no.alias("rest"), "gain", F.lit(False).alias("kept")))
        if depth == 1:
            two = bitmap(listed.filter(F.col("n") >= context_count).mapInArrow(_keyed_pairs, "key long"), "key")
        one = bitmap(contexts, "context")
        shorter = grams.select(F.col("key").alias("up"), F.col("prob").alias("shorter"))
    return shared.save_once(_union(parts), "tree-weights"), len(parts) // 2 + 1


def _union(parts: list[DataFrame]) -> DataFrame:
    all_ = parts[0]
    for part in parts[1:]:
        all_ = all_.unionByName(part)
    return all_.groupBy("key", "length").agg(F.max("n").alias("n"), F.sum("rest").alias("rest"), F.sum("gain").alias("gain"), F.max("kept").alias("kept"))


def _table(df: DataFrame, *columns: str) -> list[np.ndarray]:
    got = df.select(*columns).toArrow()
    return [got.column(c).to_numpy() for c in columns]


def fit(training: DataFrame, counts: DataFrame, n_tokens: int, n_words: int, depth: int = DEPTH, context_count: int = CONTEXT_COUNT, next_count: int = NEXT_COUNT) -> Model:
    """The tree from ``training`` (text) and its word counts, as far as it is looked up in memory."""
    return _fit(training, counts, n_tokens, n_words, depth, context_count, next_count)[0]


def _fit(training: DataFrame, counts: DataFrame, n_tokens: int, n_words: int, depth: int, context_count: int, next_count: int) -> tuple[Model, DataFrame]:
    """The model in memory and all of the tree as a table; only tables with a proven bound reach the driver."""
    most = counts.filter(F.col("n") >= max(1.0, WORD_SHARE * n_tokens))
    word, n = _table(most, "word", "n")
    order = np.argsort(word.view(np.uint64))
    listed, n = word.view(np.uint64)[order], n[order]
    root = np.log10((n + UNSEEN) / (n_tokens + UNSEEN * (n_words + 1)))
    weights, lengths = _grown(training, counts, Ranks.of(listed, n), n_tokens, n_words, depth, context_count, next_count)

    # Words as contexts go with the words; of longer sequences those at the top of a histogram of frequencies do.
    bin_ = F.floor(16 * F.log(F.col("n").cast("double")))
    sizes = weights.filter("length > 1").groupBy(bin_.alias("bin")).agg(F.count(F.lit(1)).alias("keys")).collect()
    least, room = max((r["bin"] for r in sizes), default=0) + 1, HOT
    for r in sorted(sizes, key=lambda r: -r["bin"]):
        room -= r["keys"]
        if room < 0:
            break
        least = r["bin"]
    hot = F.when(F.col("length") == 1, F.col("n") >= max(1.0, WORD_SHARE * n_tokens)).otherwise(bin_ >= least)
    key, length, rest, gain, kept = _table(weights.filter(hot), "key", "length", "rest", "gain", "kept")
    levels = []
    for k in range(1, lengths + 1):
        mine = np.flatnonzero(length == k)
        mine = mine[np.argsort(key[mine].view(np.uint64))]
        levels.append(Level(key[mine].view(np.uint64), rest[mine], gain[mine], kept[mine].astype(bool)))
    others = weights.filter(~hot)
    return Model(listed, root, levels, bitmap(others.filter("kept"), "key"), bitmap(others.filter("length > 1"), "key")), others


@shared.lean
def _scored(batches: Iterator[pa.RecordBatch], model: Broadcast) -> Iterator[pa.RecordBatch]:
    """What a row's text tells without joins, and its words and longer sequences that aren't in memory with their numbers."""
    tree: Model = model.value
    for batch, a, b, buf, off in _slices(batches):
        token, row, first = sequence(buf, off)
        beyond, word, left = tree.found(token, first)
        n, seen = b - a, word >= 0
        base = np.bincount(row[seen], tree.root[word[seen]], n)
        r, t = (np.concatenate(x) for x in zip((row[~seen], token[~seen]), *((row[at], key) for at, key in left), strict=True))
        longer = np.arange(len(t)) >= np.count_nonzero(~seen)
        order = np.lexsort((t, r))
        r, t = r[order], t[order]
        new = np.ones(len(t), bool)
        new[1:] = (r[1:] != r[:-1]) | (t[1:] != t[:-1])
        at = np.flatnonzero(new)
        edges = pa.array(np.concatenate([[0], np.cumsum(np.bincount(r[at], minlength=n))]).astype(np.int32))
        times = np.diff(np.append(at, len(t))).astype(np.int32)
        times[longer[order][at]] *= -1  # of longer sequences
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id").slice(a, n), pa.array(np.bincount(row, minlength=n)), pa.array(np.bincount(row[seen], minlength=n)), pa.array(base), pa.array(np.bincount(row, beyond, n)), pa.ListArray.from_arrays(edges, pa.array(long(t[at]))), pa.ListArray.from_arrays(edges, pa.array(times))],
            ["doc_id", "n_tokens", "listed", "base", "beyond", "rare", "times"],
        )


def scores(docs: DataFrame, depth: int = DEPTH, context_count: int = CONTEXT_COUNT, next_count: int = NEXT_COUNT) -> DataFrame:
    """One row per input row: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Rows whose crc32 of the doc_id leaves HELD_OUT of PARTS teach nothing; rows without doc_id teach. Tokens are the
    words, A-Z as a-z, then one end; null texts are the end alone. Words are known by a 64-bit hash. Contexts have at most
    ``depth`` words and need ``context_count`` occurrences, their listed next words ``next_count``. Words below WORD_SHARE,
    and contexts and next words that aren't among the HOT most frequent, are scored by a join with all of them. Repeated
    rows count and score one by one; an empty table gives no rows; other columns are not read.
    """
    shared.small_batches(docs.sparkSession)
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    training = rows.filter(~held_out(F.col("doc_id"), PARTS, HELD_OUT)).select("text")
    counts = shared.save_once(training.mapInArrow(_counted, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")), "tree-counts")
    n_tokens, n_words = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    tree, others = _fit(training, counts, n_tokens, n_words, depth, context_count, next_count)
    model = spark.sparkContext.broadcast(tree)
    schema = "doc_id long, n_tokens long, listed long, base double, beyond double, rare array<long>, times array<int>"
    parts = shared.save_once(rows.mapInArrow(partial(_scored, model=model), schema).withColumn("row", F.monotonically_increasing_id()), "tree-parts")
    model.destroy()

    rare = parts.select("row", F.explode(F.arrays_zip("rare", "times")).alias("w")).select("row", F.col("w.rare").alias("word"), F.abs("w.times").alias("times"), (F.col("w.times") > 0).alias("single"))
    seldom = counts.filter(F.col("n") < max(1.0, WORD_SHARE * n_tokens))
    seldom = seldom.select("word", "n", F.lit(0.0).alias("beyond"))
    longer = others.select(F.col("key").alias("word"), F.lit(None).cast("long").alias("n"), (F.col("rest") + F.col("gain")).alias("beyond"))
    seldom = seldom.unionByName(longer).groupBy("word").agg(F.max("n").alias("n"), F.sum("beyond").alias("beyond"))
    n = F.coalesce("n", F.lit(0))
    root = F.log10((n + F.lit(UNSEEN)) / F.lit(n_tokens + UNSEEN * (n_words + 1)))
    sums = rare.join(seldom, "word", "left").groupBy("row").agg(
        F.sum(F.when(F.col("single"), F.col("times") * root)).alias("rare_base"),
        F.sum(F.when(F.col("single") & (n > 0), F.col("times")).otherwise(0)).alias("rare_known"),
        F.sum(F.col("times") * F.coalesce(F.col("beyond"), F.lit(0.0))).alias("rare_beyond"),
    )
    joined = parts.drop("rare", "times").join(sums, "row", "left")
    base = F.col("base") + F.coalesce("rare_base", F.lit(0.0))
    known = (F.col("listed") + F.coalesce("rare_known", F.lit(0))).cast("long")
    beyond = F.col("beyond") + F.coalesce("rare_beyond", F.lit(0.0))
    return joined.select("doc_id", held_out(F.col("doc_id"), PARTS, HELD_OUT).alias("held_out"), "n_tokens", known.alias("n_known"), F.lit(n_tokens).cast("long").alias("train_tokens"), base.alias("base_score"), (base + beyond).alias("score"))
