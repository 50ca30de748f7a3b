"""Language of a text by a byte convolutional network, trained in numpy and applied to fixed-length windows."""

from __future__ import annotations

import copy
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from pathwatch.session import ship_code, written

#: Bytes in a window; windows overlap by the widest filter less one, so that no position is lost.
WINDOW = 128
WIDTHS = (2, 3, 4)
FILTERS = 12
STRIDE = WINDOW - max(WIDTHS) + 1
#: Bound of the training sample: documents of each language, and windows taken from one of them.
PER_LANGUAGE, WINDOWS_EACH = 500, 4
FOLDS, HELD_OUT = 5, 0
UNKNOWN = "und"
#: A recognizer is trained on blocks that hold all texts: bytes of the first, growth from one to the next, bytes of a task, passes over the
#: first and rates of the first and the others. One scrambled window comes to so many.
FIRST, GROWTH, EACH_TASK, FIRST_PASSES, RATES, PER_SCRAMBLED = 2 << 20, 8, 8 << 20, 4, (0.01, 0.002), 2
#: Parts of one in sums of weights, so that these are exact; places that texts are dealt to; steps of a score, and steps that are counted together.
FIXED, PLACES, GRID, COARSE = 1 << 24, 1 << 30, 1_000_000, 1000
#: Windows that one step of the forward pass holds in memory.
STEP = 512
LETTER = r"\p{L}"


def windows(text: bytes) -> np.ndarray:
    """The text cut into overlapping windows, zero-padded, shape (n, WINDOW)."""
    n = max(1, -(-(len(text) - (WINDOW - STRIDE)) // STRIDE))
    padded = np.zeros(n * STRIDE + WINDOW - STRIDE, dtype=np.uint8)
    padded[: len(text)] = np.frombuffer(text, dtype=np.uint8)
    return np.lib.stride_tricks.sliding_window_view(padded, WINDOW)[::STRIDE]


@dataclass
class Network:
    """Filters of several widths over one-hot bytes, maximum over the window, softmax.

    filters[k]: (width, 256, FILTERS); bias: (all filters,); out: (all filters, languages).
    """

    languages: list[str]
    filters: list[np.ndarray]
    bias: np.ndarray
    out: np.ndarray
    out_bias: np.ndarray

    def responses(self, x: np.ndarray) -> Iterator[np.ndarray]:
        """Each width's responses, (windows, positions, FILTERS): sums of table rows, one for each byte under the filter."""
        for w in self.filters:
            width, n = len(w), x.shape[1] - len(w) + 1
            r = w[0].take(x[:, :n], axis=0)
            for k in range(1, width):
                r += w[k].take(x[:, k : n + k], axis=0)
            yield r

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        """Softmax of every window. Pairs of bytes look up the sum of two table rows at once."""
        pairs = self._pairs()
        made = []
        for at in range(0, len(x), STEP):
            b = x[at : at + STEP].astype(np.intp)
            two = b[:, :-1] * 256 + b[:, 1:]
            best = []
            for w, tables in zip(self.filters, pairs):
                n = b.shape[1] - len(w) + 1
                r = tables[0].take(two[:, :n], axis=0)
                if len(w) == 3:
                    r += w[2].take(b[:, 2:], axis=0)
                elif len(w) == 4:
                    r += tables[1].take(two[:, 2:], axis=0)
                best.append(r.max(axis=1))
            made.append(self._soft(np.maximum(np.concatenate(best, axis=1) + self.bias, 0)))
        return np.concatenate(made)

    def _pairs(self) -> list[list[np.ndarray]]:
        if not hasattr(self, "_tables"):
            join = lambda a, b: (a[:, None, :] + b[None, :, :]).reshape(65536, -1)
            self._tables = [[join(w[0], w[1])] + ([join(w[2], w[3])] if len(w) == 4 else []) for w in self.filters]
        return self._tables

    def params(self) -> list[np.ndarray]:
        return [*self.filters, self.bias, self.out, self.out_bias]

    def release(self) -> None:
        """Let the tables of byte pairs go; they are made again in a moment."""
        self.__dict__.pop("_tables", None)

    def _soft(self, h: np.ndarray) -> np.ndarray:
        z = h @ self.out + self.out_bias
        e = np.exp(z - z.max(axis=1, keepdims=True))
        return e / e.sum(axis=1, keepdims=True)

    def predict(self, texts: list[bytes]) -> tuple[list[str], np.ndarray]:
        """Language and mean probability over all windows of each text, a window counting by the text in it."""
        sums = self.means(texts)
        best = sums.argmax(axis=1)
        return [self.languages[i] for i in best], sums[np.arange(len(best)), best]

    def means(self, texts: list[bytes]) -> np.ndarray:
        """The mean probabilities of each text, (texts, languages)."""
        parts = [windows(t) for t in texts]
        of = np.repeat(np.arange(len(parts)), [len(p) for p in parts])
        sums = np.zeros((len(parts), len(self.languages)))
        weight = np.concatenate([np.minimum(len(t) - STRIDE * np.arange(len(p)), WINDOW) for t, p in zip(texts, parts)])
        at, total = 0, len(of)
        flat = (p for p in parts)
        held: list[np.ndarray] = []
        kept = 0
        for p in flat:
            held.append(p)
            kept += len(p)
            if kept >= 4 * STEP or at + kept == total:
                q = self.probabilities(np.concatenate(held)) * weight[at : at + kept, None]
                np.add.at(sums, of[at : at + kept], q)
                at, kept, held = at + kept, 0, []
        return sums / np.maximum(sums.sum(axis=1, keepdims=True), 1e-12)


def untrained(languages: list[str], g: np.random.Generator) -> Network:
    total = FILTERS * len(WIDTHS)
    return Network(languages, [(g.normal(size=(w, 256, FILTERS)) * 0.1).astype(np.float32) for w in WIDTHS], np.zeros(total, np.float32),
                   (g.normal(size=(total, len(languages))) * 0.1).astype(np.float32), np.zeros(len(languages), np.float32))


class Adam:
    """Steps on the cross entropy. Only the position of each maximum gets a gradient, so a step touches few table rows."""

    def __init__(self, net: Network, rate: float):
        self.net, self.rate, self.t = net, rate, 0
        self.first, self.second = [np.zeros_like(p) for p in net.params()], [np.zeros_like(p) for p in net.params()]

    def over(self, x: np.ndarray, y: np.ndarray, order: np.ndarray, batch: int = 64) -> None:
        """One pass over the windows in this order."""
        for at in range(0, len(x), batch):
            i = order[at : at + batch]
            self.step(x[i].astype(np.intp), y[i])

    def step(self, b: np.ndarray, y: np.ndarray) -> None:
        net, m = self.net, len(b)
        tops, where = [], []
        for r in net.responses(b):
            where.append(r.argmax(axis=1))
            tops.append(np.take_along_axis(r, where[-1][:, None, :], axis=1)[:, 0])
        pre = np.concatenate(tops, axis=1) + net.bias
        h = np.maximum(pre, 0)
        d = net._soft(h)
        d[np.arange(m), y] -= 1
        d /= m
        dh = (d @ net.out.T) * (pre > 0)
        grads = [np.zeros_like(w) for w in net.filters]
        for k, w in enumerate(WIDTHS):
            part = dh[:, k * FILTERS : (k + 1) * FILTERS]
            for o in range(w):
                np.add.at(grads[k][o], (np.take_along_axis(b, where[k] + o, axis=1), np.arange(FILTERS)[None, :]), part)
        grads += [dh.sum(axis=0), h.T @ d, d.sum(axis=0)]
        self.t += 1
        for p, q, a, s in zip(net.params(), grads, self.first, self.second):
            a += 0.1 * (q - a)
            s += 0.001 * (q * q - s)
            p -= self.rate * (a / (1 - 0.9**self.t)) / (np.sqrt(s / (1 - 0.999**self.t)) + 1e-8)


def train(x: np.ndarray, y: np.ndarray, languages: list[str], epochs: int = 6, batch: int = 64, rate: float = 0.01, seed: int = 7) -> Network:
    """A network after so many passes over the windows, see Adam."""
    g = np.random.default_rng(seed)
    net = untrained(languages, g)
    adam = Adam(net, rate)
    for _ in range(epochs):
        adam.over(x, y, g.permutation(len(x)), batch)
    return net


def training_rows(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", lang: str = "lang", held_out: bool = False) -> DataFrame:
    """(lang, bit): pieces of text of a bounded sample of labelled documents outside (or inside) the held-out fold.

    About PER_LANGUAGE different texts of each language (chosen by a hash of the text, never more than twice as many), and
    WINDOWS_EACH evenly placed pieces of each. Copies of a text count once.
    """
    usable = docs.where(F.col(lang).isNotNull() & F.col(text).rlike(LETTER) & ((F.coalesce(fold(F.col(doc_id)), F.lit(1)) == HELD_OUT) == held_out))
    usable = usable.select(F.col(lang).alias("lang"), F.col(text).alias("text"), F.xxhash64(F.col(text)).alias("h"))
    # one row for each language; a sketch is enough to set the share
    sizes = {r["lang"]: r["n"] for r in usable.groupBy("lang").agg(F.approx_count_distinct("h").alias("n")).collect()}
    share = F.coalesce(*[F.when(F.col("lang") == k, F.lit(PER_LANGUAGE / n)) for k, n in sizes.items()], F.lit(0.0))
    size = F.char_length("text")
    places = F.transform(F.sequence(F.lit(0), F.lit(WINDOWS_EACH - 1)), lambda k: (k * F.greatest(size - WINDOW, F.lit(0)) / WINDOWS_EACH).cast("int") + 1)
    bits = F.transform(F.array_distinct(places), lambda p: F.substring(F.col("text"), p, F.lit(WINDOW)))
    drawn = usable.where(F.pmod("h", F.lit(1_000_000)) < share * 1_000_000).select("lang", "h", bits.alias("bits")).dropDuplicates(["lang", "h"])
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("h"))
    return drawn.withColumn("rank", rank).where(F.col("rank") <= 2 * PER_LANGUAGE).select("lang", F.explode("bits").alias("bit"), "h").orderBy("h", "bit", "lang")


def fold(doc_id: Column) -> Column:
    """The document's fold: CRC-32 of the id as text, modulo FOLDS. Null for a null id."""
    return F.crc32(doc_id.cast("string").cast("binary")) % FOLDS


def fit(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", lang: str = "lang") -> Network | None:
    """A network from the sample of training_rows, which is bounded and all that comes to the driver; None if there is none."""
    rows = training_rows(docs, text, doc_id, lang).select("lang", "bit").collect()
    if not rows:
        return None
    languages = sorted({r["lang"] for r in rows})
    x = np.stack([windows(r["bit"].encode("utf-8", "surrogatepass")[:WINDOW])[0] for r in rows])
    return train(x, np.array([languages.index(r["lang"]) for r in rows]), languages)


def scrambled(x: np.ndarray, seed: int = 5) -> np.ndarray:
    """The windows with their bytes in a random order, and every second one with random bytes; what lies beyond the text stays empty."""
    g, out = np.random.default_rng(seed), x.copy()
    for k, row in enumerate(out):
        n = int(np.flatnonzero(row).max(initial=-1)) + 1
        row[:n] = g.permutation(row[:n]) if k % 2 == 0 else g.integers(1, 256, n)
    return out


@dataclass
class Recognizer:
    """A network that also knows scrambled text, as UNKNOWN, and the mean probability of that (in GRID-ths) above which a text is rejected.

    windows, held_out: how many windows it was trained on, and on how many documents' scores the limit rests.
    """

    net: Network
    most: int
    windows: int
    held_out: int


def blocks(size: int) -> list[tuple[int, int, int]]:
    """(from, to, tasks): ranges of places that together are all of them; the first holds about FIRST of ``size`` bytes, each further one GROWTH times more."""
    ends, one = [], FIRST
    while (ends[-1] if ends else 0) + 2 * one < size:
        ends.append((ends[-1] if ends else 0) + one)
        one *= GROWTH
    edges = [0, *[e * PLACES // size for e in ends], PLACES]
    return [(a, b, -(-(b - a) * size // (PLACES * EACH_TASK))) for a, b in zip(edges, edges[1:])]


def trained_further(net: Network, rows: DataFrame, tasks: int, rate: float, passes: int) -> tuple[Network, int]:
    """The network after training on all windows of ``rows`` (lang, text, place), and the number of windows.

    Every task starts from ``net`` and goes over the windows of its texts, a batch of texts being shuffled; the weights
    of the tasks are averaged by their windows. Spark sums them, so the driver sees one number for each weight.
    """
    shared = rows.sparkSession.sparkContext.broadcast(net)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own, g, n = copy.deepcopy(shared.value), np.random.default_rng(5), 0
        adam, noise = Adam(own, rate), len(own.languages) - 1
        number = {k: i for i, k in enumerate(own.languages[:-1])}
        for b in batches:
            parts = [windows(t.encode("utf-8", "surrogatepass")) for t in b["text"]]
            x = np.concatenate(parts)
            y = np.repeat([number[k] for k in b["lang"]], [len(p) for p in parts])
            n += len(x)
            for _ in range(passes):
                bad = scrambled(x[g.permutation(len(x))[::PER_SCRAMBLED]], int(g.integers(1 << 30)))
                adam.over(np.concatenate([x, bad]), np.concatenate([y, np.full(len(bad), noise)]), g.permutation(len(x) + len(bad)))
        if n:
            flat = np.concatenate([p.ravel() for p in own.params()]).astype(float)
            yield pd.DataFrame({"i": np.arange(len(flat), dtype=np.int32), "s": np.rint(flat * FIXED).astype(np.int64) * n, "n": np.int64(n)})

    made = rows.repartition(tasks, "place").select("lang", "text").mapInPandas(run, "i int, s long, n long")
    found = made.groupBy("i").agg(F.sum("s").alias("s"), F.sum("n").alias("n")).collect()
    if not found:
        return net, 0
    flat = np.empty(len(found), np.float32)
    for r in found:
        flat[r["i"]] = r["s"] / r["n"] / FIXED
    out, at = copy.deepcopy(net), 0
    for p in out.params():
        p[...] = flat[at : at + p.size].reshape(p.shape)
        at += p.size
    return out, found[0]["n"]


def limit(scores: DataFrame, lost: float) -> tuple[int, int]:
    """The least of the scores (whole, column ``score``), GRID / 2 at least, above which at most a share ``lost`` of all rows lies; and the number of rows.

    Exact: rows are counted by score, the counts by ranges of COARSE scores, and only one range is looked into.
    """
    counts = written(scores.groupBy("score").agg(F.count("*").alias("n")), "scores").withColumn("range", F.floor(F.col("score") / COARSE))
    total, allowed, inside = 0, 0, counts
    for key in ("range", "score"):
        found = sorted(((r["k"], r["n"]) for r in inside.groupBy(F.col(key).alias("k")).agg(F.sum("n").alias("n")).collect()), reverse=True)
        if not found:
            return GRID // 2, 0
        if key == "range":
            total = sum(n for _, n in found)
            allowed = int(lost * total)
        for k, n in found:
            if n > allowed:
                break
            allowed -= n
        inside = counts.where(F.col("range") == k)
    return max(GRID // 2, k), total


def fit_recognizer(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", lang: str = "lang", lost: float = 0.001) -> Recognizer | None:
    """Trained on every window of every text with a language and a letter outside the held-out fold, and on scrambled windows.

    Texts are dealt to blocks of growing size; the network goes over one after the other, each text being in one of them
    (see trained_further). The limit is calibrated on all such texts of the held-out fold (see limit). None if there is
    nothing to learn from.
    """
    spark = docs.sparkSession
    ship_code(spark)
    # copies of a text differ in the id, so they don't meet in one task
    place = F.pmod(F.xxhash64(text, doc_id), F.lit(PLACES))
    usable = docs.where(F.col(lang).isNotNull() & F.col(text).rlike(LETTER)).select(
        F.col(lang).alias("lang"), F.col(text).alias("text"), place.alias("place"), (F.coalesce(fold(F.col(doc_id)), F.lit(1)) == HELD_OUT).alias("held_out"))
    rows = usable.where("NOT held_out")
    # one row for each language
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.sum(F.octet_length("text")).alias("n")).collect()}
    if not sizes:
        return None
    net, n = untrained([*sorted(sizes), UNKNOWN], np.random.default_rng(7)), 0
    for k, (a, b, tasks) in enumerate(blocks(sum(sizes.values()))):
        part = rows.where((F.col("place") >= a) & (F.col("place") < b))
        net, more = trained_further(net, part, tasks, RATES[min(k, 1)], 1 if k else FIRST_PASSES)
        n += more
    most, held_out = limit(usable.where("held_out").select(scrambling(spark, F.col("text"), net).alias("score")), lost)
    return Recognizer(net, most, n, held_out)


def steps(noise: np.ndarray) -> np.ndarray:
    """Probabilities in GRID-ths, rounded up."""
    return np.ceil(noise * GRID).astype(np.int64)


def scrambling(spark: SparkSession, text: Column, net: Network) -> Column:
    """The mean probability that a text (not null) is scrambled, in GRID-ths."""
    shared = spark.sparkContext.broadcast(net)

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        n = shared.value
        try:
            for b in batches:
                yield pd.Series(steps(n.means([t.encode("utf-8", "surrogatepass") for t in b])[:, -1]) if len(b) else [], dtype="int64")
        finally:
            n.release()

    return pandas_udf(run, "long")(text)


def recognize(spark: SparkSession, text: Column, known: Recognizer | None) -> Column:
    """The language of a text, or null if it is rejected: no text, no letter, or like scrambled text."""
    ship_code(spark)
    shared = spark.sparkContext.broadcast(known)

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        r = shared.value
        try:
            for b in batches:
                out = pd.Series([None] * len(b), dtype=object)
                some = np.flatnonzero(b.notna().to_numpy())
                if r is not None and len(some):
                    p = r.net.means([b.iloc[i].encode("utf-8", "surrogatepass") for i in some])
                    best = p[:, :-1].argmax(axis=1)
                    out.loc[some] = [r.net.languages[k] if noise <= r.most else None for k, noise in zip(best, steps(p[:, -1]))]
                yield out
        finally:
            if r is not None:
                r.net.release()  # the worker lives on; the next stage needs the memory

    return pandas_udf(run, "string")(F.when(text.rlike(LETTER), text))


def guess(spark: SparkSession, text: Column, net: Network | None) -> Column:
    """Column struct<lang,score> of the predicted language; see predict."""
    ship_code(spark)
    known = spark.sparkContext.broadcast(net)

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        n = known.value
        for b in batches:
            out = pd.DataFrame({"lang": [UNKNOWN] * len(b), "score": np.zeros(len(b))})
            some = np.flatnonzero(b.notna().to_numpy())
            if n is not None and len(some):
                lang, score = n.predict([b.iloc[i].encode("utf-8", "surrogatepass") for i in some])
                out.loc[some, "lang"], out.loc[some, "score"] = lang, score
            yield out

    return pandas_udf(run, "lang string, score double")(F.when(text.rlike(LETTER), text))


def predict(docs: DataFrame, net: Network | None, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, held_out, lang_pred, score) for every row of ``docs``.

    Only the text decides. Null texts and texts without a letter are ``und`` with score 0, as is everything when there
    was nothing to learn from. Null ids are never held out; repeated rows are kept; other columns are not read; an
    empty table gives none. Every window of a text counts; a text goes through in blocks of bounded memory.
    """
    made = guess(docs.sparkSession, F.col(text), net)
    return docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(fold(F.col(doc_id)) == HELD_OUT, F.lit(False)).alias("held_out"), made.alias("g")).select(
        "doc_id", "held_out", F.col("g.lang").alias("lang_pred"), F.col("g.score").alias("score"))


def with_known_language(docs: DataFrame, known: Recognizer | None, text: str = "text", lang: str = "lang") -> DataFrame:
    """The rows of ``docs`` whose text is in a recognized language (see ``recognize``); null languages are filled in, all columns stay."""
    # all of a row's columns in one, so that no name can clash
    packed = docs.select(F.struct(*docs.columns).alias("all"), recognize(docs.sparkSession, F.col(text), known).alias("found")).where("found IS NOT NULL")
    return packed.select(*[F.coalesce(F.col("all")[c], F.col("found")).alias(c) if c == lang else F.col("all")[c].alias(c) for c in docs.columns])


def crc_fold(doc_id: int) -> int:
    """The same fold in plain Python, for tests."""
    return zlib.crc32(str(doc_id).encode()) % FOLDS


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicted language of every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return predict(docs, fit(docs))
