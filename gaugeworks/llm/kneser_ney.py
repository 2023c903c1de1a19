"""Quality classifier: perplexity under an interpolated modified Kneser-Ney model.

The model counts trigrams of characters, as they are, over all trusted text. Its
tables grow with that text, so they stay tables: texts are reduced to their
distinct trigrams with counts, those meet the model's probabilities in joins on
the trigram, and the sums per document make its perplexity.

A slice of texts asks for each of its distinct trigrams once, so no trigram,
however common, has more rows than there are slices. The answers meet the
slice's postings, which list the texts that hold each trigram in about a byte
per text and trigram.

A text of a few words over and over can have an ordinary perplexity, each word
being one of the language. So a text's echo, how far its own last ``RECENT``
symbols foretell the next one, is the low side of the cut.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugeworks.llm import kernels as K
from gaugeworks.sources.scratch import Scratch

#: Bits of a symbol; a trigram is three of them in a long.
BITS = 21
#: Symbol of a text's edges, beyond all code points; two stand before its first character.
EDGE = 0x110000
#: Symbols of a text that its own later ones are held against.
RECENT = 32
#: Most texts of one slice.
MOST_TEXTS = 1 << 16


def grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Trigram of each character and of each text's end, in order; and the index
    of each text's first (n + 1 values)."""
    points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), dtype="<u4")
    lens = np.array([len(t) for t in texts], dtype=np.int64)
    first = np.zeros(len(texts) + 1, np.int64)
    np.cumsum(lens + 1, out=first[1:])
    # a text is laid out as edge, edge, its characters, edge
    spaced = np.full(first[-1] + 2 * len(texts), EDGE, dtype=np.int64)
    doc = np.repeat(np.arange(len(texts)), lens)
    spaced[np.arange(len(points)) + 3 * doc + 2] = points
    begin = first[:-1] + 2 * np.arange(len(texts))
    last = np.ones(len(spaced), dtype=bool)
    last[begin], last[begin + 1] = False, False
    at = np.flatnonzero(last)
    return (spaced[at - 2] << 2 * BITS) | (spaced[at - 1] << BITS) | spaced[at], first


def counts(docs: DataFrame) -> DataFrame:
    """``(gram, n)`` over the whole texts: a task adds up its own slices, then
    the counts are summed by gram."""

    def run(batches):
        for batch in batches:
            for part in K.slices(batch):
                found, n = np.unique(grams([t or "" for t in part.column("text").to_pylist()])[0], return_counts=True)
                yield pa.record_batch([pa.array(found), pa.array(n)], names=["gram", "n"])

    return docs.select("text").mapInArrow(run, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))


# ---------------------------------------------------------------- model
def _head(gram: Column) -> Column:
    """All but a gram's last symbol."""
    return F.shiftright(gram, BITS)


def _tail(gram: Column, symbols: int) -> Column:
    """A gram's last symbols."""
    return gram.bitwiseAND(F.lit((1 << symbols * BITS) - 1))


def _discounts(table: DataFrame) -> tuple[float, float, float]:
    """The discounts of counts 1, 2 and over, from the counts of counts; one
    half where those are too few for the estimate, or it is not above zero: a
    context must leave a share to what it was never followed by."""
    few = {int(r.n): r.k for r in table.where("n <= 4").groupBy("n").agg(F.count(F.lit(1)).alias("k")).collect()}
    n = [few.get(i, 0) for i in range(5)]
    if not all(n[1:]):
        return 0.5, 0.5, 0.5
    y = n[1] / (n[1] + 2 * n[2])
    found = [i - (i + 1) * y * n[i + 1] / n[i] for i in (1, 2, 3)]
    return tuple(float(d) if d > 0 else 0.5 for d in found)


class Level:
    """One order of the model: ``own (gram, own)``, the discounted share of each
    gram that was seen, and ``rest (context, gamma)``, what its context leaves to
    the lower order."""

    def __init__(self, table: DataFrame, name: str, scratch: Scratch):
        d = _discounts(table)
        off = F.when(F.col("n") == 1, d[0]).when(F.col("n") == 2, d[1]).otherwise(d[2])
        table = table.withColumn("context", _head(F.col("gram")))
        of = table.groupBy("context").agg(F.sum("n").alias("total"), F.sum(off).alias("off"))
        self.rest = scratch.keep(of.select("context", (F.col("off") / F.col("total")).alias("gamma")), f"{name}-rest")
        self.own = scratch.keep(table.join(of, "context").select("gram", ((F.col("n") - off) / F.col("total")).alias("own")), f"{name}-own")

    def over(self, asked: DataFrame, lower: str, p: str) -> DataFrame:
        """``asked`` with ``p``: of its column ``gram`` in this order, given the
        probability ``lower`` of the gram without its first symbol. A context
        never seen leaves all to that."""
        met = asked.withColumn("context", _head(F.col("gram"))).join(self.own, "gram", "left").join(self.rest, "context", "left")
        return met.select(*asked.columns, (F.coalesce("own", F.lit(0.0)) + F.coalesce("gamma", F.lit(1.0)) * F.col(lower)).alias(p))


class Model:
    """Counts of three orders over the trusted texts, as tables."""

    def __init__(self, trusted: DataFrame, scratch: Scratch):
        self.scratch = scratch
        three = scratch.keep(counts(trusted), "trigrams")
        # lower orders count the distinct symbols before them
        two = scratch.keep(three.groupBy(_tail(F.col("gram"), 2).alias("gram")).agg(F.count(F.lit(1)).alias("n")), "bigrams")
        one = scratch.keep(two.groupBy(_tail(F.col("gram"), 1).alias("gram")).agg(F.count(F.lit(1)).alias("n")), "symbols")
        self.levels = [Level(t, name, scratch) for t, name in ((one, "one"), (two, "two"), (three, "three"))]
        #: Symbols that share what the first order leaves: those seen, and one for all others.
        self.symbols = one.count() + 1

    def log_probabilities(self, grams: DataFrame) -> DataFrame:
        """``(gram, logp)`` of distinct ``grams (gram)``, seen or not. A shorter
        gram is asked once for all longer ones that end in it."""
        asked = grams
        for order, level in enumerate(self.levels, 1):
            known = grams.select(_tail(F.col("gram"), order).alias("gram")).distinct() if order < 3 else grams
            if order == 1:
                known = known.withColumn("lower", F.lit(1.0 / self.symbols))
            else:
                known = known.join(asked.select(F.col("gram").alias("ends"), F.col("p").alias("lower")), _tail(F.col("gram"), order - 1) == F.col("ends")).drop("ends")
            asked = self.scratch.keep(level.over(known, "lower", "p").drop("lower"), f"asked-{order}")
        return asked.select("gram", F.log("p").alias("logp"))


# --------------------------------------------------------------- scoring
def _foretold(g: np.ndarray, first: np.ndarray) -> np.ndarray:
    """How far each symbol is foretold: the share of its trigram among those of
    its context in the ``RECENT`` places of its text before; zero where the
    context is not among them."""
    context = g >> BITS
    place = np.arange(len(g)) - np.repeat(first[:-1], np.diff(first))
    same, of = np.zeros(len(g), dtype=np.uint8), np.zeros(len(g), dtype=np.uint8)
    for back in range(1, min(RECENT, len(g) - 1) + 1):
        own = place[back:] >= back
        of[back:] += (context[back:] == context[:-back]) & own
        same[back:] += (g[back:] == g[:-back]) & own
    return same / np.maximum(of, 1)


def _mean(x: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Mean of each text and its deviation."""
    n = np.diff(first)
    mean = np.add.reduceat(x, first[:-1]) / n
    return mean, np.sqrt(np.clip(np.add.reduceat(x * x, first[:-1]) / n - mean**2, 0, None))


#: A posting is a byte: how far its text is from the one before, and how often it
#: holds the trigram. None often: as many times ``_FAR`` further. More often: once more at the same text.
_FAR, _OFTEN = 32, 7


def _postings(g: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, list[bytes]]:
    """The distinct trigrams of a slice in order, and the postings of each."""
    text = np.repeat(np.arange(len(first) - 1), np.diff(first))
    order = np.argsort(g, kind="stable")  # texts stay in order
    g, text = g[order], text[order]
    other = np.concatenate([[True], g[1:] != g[:-1]])
    at = np.flatnonzero(other | np.concatenate([[True], text[1:] != text[:-1]]))
    often, gram, text, lead = np.diff(np.append(at, len(g))), g[at], text[at], other[at]
    away = np.where(lead, text, text - np.append(0, text[:-1]))
    # bytes that lead there, then the bytes there
    way = -(-(away // _FAR) // (_FAR - 1))
    there = -(-often // _OFTEN)
    own, nth = K.ranges(way + there)
    here = nth - way[own]
    far = np.clip(away[own] // _FAR - nth * (_FAR - 1), 0, _FAR - 1)
    near = np.where(here == 0, away[own] % _FAR, 0)
    code = np.where(here < 0, far << 3, (near << 3) | np.clip(often[own] - here * _OFTEN, 0, _OFTEN)).astype(np.uint8)
    begin = np.append(np.flatnonzero(lead[own] & (nth == 0)), len(own)).tolist()
    raw = code.tobytes()
    return gram[lead], [raw[a:b] for a, b in zip(begin, begin[1:])]


def _read(held: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Postings as ``(trigram's number, text, often)``."""
    sizes = np.array([len(h) for h in held], dtype=np.int64)
    code = np.frombuffer(b"".join(held), dtype=np.uint8).astype(np.int64)
    often = code & 7
    to = np.cumsum(np.where(often == 0, _FAR, 1) * (code >> 3))
    ends = np.cumsum(sizes)
    base = np.concatenate([[0], to[ends[:-1] - 1]])
    return np.repeat(np.arange(len(held)), sizes), to - np.repeat(base, sizes), often


_ROW = "slice long, gram long, held binary, number int, doc_id long, lang string, n_symbols long, echo double, echo_off double"
_NAMES = [f.split()[0] for f in _ROW.split(", ")]


def reduced(docs: DataFrame) -> DataFrame:
    """Slices of the texts, in rows of two kinds. With a ``gram``: ``held`` lists
    the slice's texts that hold it. Without: ``number`` is that of a text, its
    id, language, symbols, mean of what is foretold and deviation of that."""

    def run(batches):
        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            for whole in K.slices(batch):
                for lo in range(0, whole.num_rows, MOST_TEXTS):
                    part = whole.slice(lo, MOST_TEXTS)
                    g, first = grams([t or "" for t in part.column("text").to_pylist()])
                    echo, off = _mean(_foretold(g, first), first)
                    gram, held = _postings(g, first)
                    columns = [pa.array(np.full(len(gram), number)), pa.array(gram), pa.array(held, pa.binary()), *_nulls(len(gram), _NAMES[3:])]
                    yield pa.record_batch(columns, names=_NAMES)
                    n = part.num_rows
                    columns = [pa.array(np.full(n, number)), *_nulls(n, _NAMES[1:3]), pa.array(np.arange(n, dtype=np.int32)), part.column("doc_id"), part.column("lang")]
                    yield pa.record_batch([*columns, pa.array(np.diff(first)), pa.array(echo), pa.array(off)], names=_NAMES)
                    number += 1

    return docs.select(F.col("doc_id").cast("long"), F.col("lang").cast("string"), "text").mapInArrow(run, _ROW)


_KINDS = {"gram": pa.int64(), "held": pa.binary(), "number": pa.int32(), "doc_id": pa.int64(), "lang": pa.string(), "n_symbols": pa.int64(), "echo": pa.float64(), "echo_off": pa.float64()}


def _nulls(n: int, names: list[str]) -> list[pa.Array]:
    return [pa.nulls(n, _KINDS[x]) for x in names]


def _sums(answers: DataFrame, held: DataFrame) -> DataFrame:
    """``(slice, number, nll, squares)``: per text, the sum of its trigrams'
    negative log probabilities and of their squares. ``answers (slice, gram,
    logp)`` and ``held (slice, gram, held)`` have the same trigrams; a slice's
    meet in one task, sorted, and a task adds up its slices one by one."""

    def added(own: int, logp: list[np.ndarray], held: list[bytes]):
        gram, text, often = _read(held)
        nll = -np.concatenate(logp)[gram]
        first, second = np.bincount(text, often * nll), np.bincount(text, often * nll * nll)
        columns = [np.full(len(first), own), np.arange(len(first), dtype=np.int32), first, second]
        return pa.record_batch([pa.array(c) for c in columns], names=["slice", "number", "nll", "squares"])

    def run(batches):
        now, logp, held = None, [], []
        for batch in batches:
            slices = batch.column("slice").to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(slices)) + 1).tolist(), len(slices)]
            for a, b in zip(cuts, cuts[1:]):
                if a == b:
                    continue
                if slices[a] != now:
                    if held:
                        yield added(now, logp, held)
                    now, logp, held = int(slices[a]), [], []
                logp.append(batch.column("logp").slice(a, b - a).drop_null().to_numpy())
                held += batch.column("held").slice(a, b - a).drop_null().to_pylist()
        if held:
            yield added(now, logp, held)

    both = answers.unionByName(held, allowMissingColumns=True).select("slice", "gram", "logp", "held")
    return both.repartition("slice").sortWithinPartitions("slice", "gram").mapInArrow(run, "slice long, number int, nll double, squares double")


def score(docs: DataFrame, model: Model, sigmas: float = 2.0) -> DataFrame:
    """``(doc_id, lang, n_symbols, perplexity, floor, echo)`` of each row."""
    rows = model.scratch.keep(reduced(docs), "reduced")
    held = rows.where("gram is not null").select("slice", "gram", "held")
    known = model.log_probabilities(held.select("gram").distinct())
    sums = _sums(held.select("slice", "gram").join(known, "gram"), held)
    texts = rows.where("gram is null").drop("gram", "held")
    n = F.col("n_symbols")
    mean = F.col("nll") / n
    # a text of few symbols has a spread too small by chance: never under 1 nat
    off = F.greatest(F.sqrt(F.greatest(F.col("squares") / n - mean * mean, F.lit(0.0))), F.lit(1.0)) / F.sqrt(n)
    echo = F.col("echo") - sigmas * F.greatest("echo_off", F.lit(0.5)) / F.sqrt(n)
    return texts.join(sums, ["slice", "number"]).select("doc_id", "lang", "n_symbols", F.exp(mean).alias("perplexity"), F.exp(mean - sigmas * off).alias("floor"), echo.alias("echo"))


def _quantile(known: DataFrame, by: list[str], value: Column, quantile: float) -> DataFrame:
    """``(by, q)``: the exact quantile of ``value`` rounded to four digits, from
    the counts of its distinct values."""
    bins = known.groupBy(*by, F.round(value, 4).alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    return bins.groupBy(*by).agg(F.expr(f"percentile(bin, {float(quantile)!r}D, n)").alias("q"))


def classify(docs: DataFrame, labels: DataFrame, quantile: float = 0.99, slack: float = 1.05, sigmas: float = 2.0) -> DataFrame:
    """``(doc_id, lang, n_symbols, perplexity, floor, threshold, echo, limit,
    keep)`` of each row.

    Trusted are the documents that ``labels`` call of good quality and not
    toxic; the model counts all of their texts. A document's floor is the
    perplexity that it surely exceeds, ``sigmas`` standard errors below its own,
    so that a short text is not rejected by chance. A language's threshold is
    the ``quantile`` of the floors of its trusted documents, times ``slack``; a
    language without any, or a null one, gets that of all trusted documents.

    On the low side, a document's echo is the share of its symbols that its own
    recent ones surely foretell, by the same standard errors; a language's limit
    is the ``quantile`` of the echoes of its trusted documents, times ``slack``.
    (A low perplexity alone rejects nothing: a text of well known lines is left
    to line dedup.) A document is kept if its floor is at most its threshold and
    its echo at most its limit; with no trusted document at all, every one is.
    The quantiles are exact, of log perplexities and echoes of four digits.

    Null and empty texts are one edge symbol, kept like any other; labels of
    unknown doc_ids or with nulls are not trusted; a doc_id labelled both ways
    is not trusted; repeated rows each get a row. Other columns are ignored.
    """
    scratch = Scratch(docs.sparkSession, "kneser-ney")
    trusted = scratch.keep(
        labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id"))
        .agg(F.min(F.coalesce("quality", F.lit(0))).alias("q"), F.max(F.coalesce("toxic", F.lit(0))).alias("t"))
        .where("q = 1 and t = 0").select("doc_id"),
        "trusted",
    )
    text = docs.select(F.col("doc_id").cast("long"), "text")
    scored = scratch.keep(score(docs, Model(text.join(trusted, "doc_id", "left_semi"), scratch), sigmas), "scored")
    known = scored.join(trusted, "doc_id", "left_semi")
    sides = {"threshold": (F.log("floor"), lambda q: F.exp(q) * slack), "limit": (F.col("echo"), lambda q: F.abs(q) * slack)}
    limits = scored.select("lang").distinct().withColumnRenamed("lang", "of")
    for name, (value, wide) in sides.items():
        every = _quantile(known, [], value, quantile).select(wide(F.col("q")).alias("q")).first().q
        own = _quantile(known.where("lang is not null"), ["lang"], value, quantile).select(F.col("lang").alias("is"), wide(F.col("q")).alias(name))
        limits = limits.join(own, F.col("of") == F.col("is"), "left").drop("is")
        limits = limits.withColumn(name, F.coalesce(name, F.lit(float("inf") if every is None else every)))
    met = scored.join(limits, F.col("lang").eqNullSafe(F.col("of")), "left")
    keep = (F.col("floor") <= F.col("threshold")) & (F.col("echo") <= F.col("limit"))
    return met.select("doc_id", "lang", "n_symbols", "perplexity", "floor", "threshold", "echo", "limit", keep.alias("keep"))
