"""Exact token counts of a byte-fallback BPE vocabulary, by a finite-state transducer whose transitions carry counts."""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator
from typing import NamedTuple

import ahocorasick
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from pathwatch.session import ship_code

#: The vocabulary writes a space so.
SPACE = "▁"
LIMIT = 4096
#: Characters whose state map is made at once.
CHUNK = 1 << 15
#: Words whose counts a task keeps, prefixes whose states it keeps, and the longest of either that it keeps.
KEPT, KEPT_STATES, KEPT_CHARS = 1 << 19, 1 << 20, 48


def read_pieces(path: str) -> dict[str, float]:
    """The mergeable pieces and their scores. Control and byte pieces never come out of a merge."""
    import sentencepiece

    m = sentencepiece.SentencePieceProcessor(model_file=path)
    plain = (i for i in range(m.get_piece_size()) if not (m.is_control(i) or m.is_byte(i) or m.is_unknown(i)))
    return {m.id_to_piece(i): m.get_score(i) for i in plain}


class StateMap(NamedTuple):
    """What reading one chunk does to the transducer, whatever its state before.

    A state is the unfinished word. ``head`` finishes or extends the word that is open at the chunk's start, ``count``
    tokens are emitted for words that lie wholly inside, ``tail`` is open at its end. ``tail`` None: the chunk has no
    word boundary, and ``head`` only extends the open word.
    """

    head: str
    count: int
    tail: str | None


class Transducer:
    """Reads text, emits token counts.

    A word is a run of spaces and the run of other characters after it. No piece of the vocabulary goes on over the
    start of a word (checked when it is built), so merges never cross it; the same holds for a line end that no longer
    piece holds. Inside a word a state is what has been read of it, and the transition over one more character is
    annotated with the change of the emitted tokens' number: the last token of the longer prefix is the one that ends
    there and is compatible with the last token before it, that is, whose letters and the other's merge into just these
    two. States are compiled when first entered; those of short prefixes are kept and shared by all words that begin
    so. Words of any length go this way.

    A run of several spaces has numbered states, its length modulo that of the longest piece of spaces: such pieces are
    of one score and the leftmost merge comes first, so as many spaces as the longest piece holds, which merge into it
    alone, also do so at the start of a longer run, and what follows is a run of its own. Pieces of spaces score below
    all others, so the letters after the run have taken the last space before, or never take it: the state of their
    word tells which. What this rests on is checked when it is built.
    """

    def __init__(self, pieces: dict[str, float]):
        if any(SPACE in p.lstrip(SPACE) for p in pieces):
            raise ValueError("a piece goes on over the start of a word")
        self.pieces = {p.replace(SPACE, " "): s for p, s in pieces.items()}
        runs = {len(p): s for p, s in self.pieces.items() if not p.strip(" ")}
        others = [s for p, s in self.pieces.items() if len(p) > 1 and p.strip(" ")]
        longest = max(runs, default=1)
        if len(set(runs.values())) > 1 or any(p.startswith("  ") and p.strip(" ") for p in self.pieces) or (longest > 1 and min(others, default=0.0) <= runs[longest]):
            raise ValueError("pieces of spaces do not merge last and leftmost first")
        if len(self.merged(" " * longest)) > 1:
            raise ValueError("the longest piece of spaces never comes out of a merge")
        # tokens of a run shorter than that piece, by its state
        self.runs = [len(self.merged(" " * n)) for n in range(longest)]
        line = "" if any("\n" in p and len(p) > 1 for p in pieces) else "\n"
        self.words = re.compile(f" *[^ {line}]+| +" + "|\n" * bool(line)).findall
        self.matcher = ahocorasick.Automaton()
        for p in self.pieces:
            self.matcher.add_word(p, len(p))
        self.matcher.make_automaton()
        self.emits: dict[str, int] = {}
        # prefix -> tokens so far, the last of them, whether the first is a space alone
        self.states: dict[str, tuple[int, str, bool]] = {"": (0, "", False)}
        self.fits: dict[tuple[str, str], bool] = {}

    def merged(self, word: str) -> list[str]:
        """The tokens of a word by the vocabulary's merges: best score first, leftmost among equals; O(n log n)."""
        score = self.pieces
        part: list[str | None] = list(word)
        n = len(part)
        left, right = list(range(-1, n - 1)), list(range(1, n + 1))
        heap: list[tuple[float, int, int]] = []

        def offer(i: int) -> None:
            j = right[i]
            if j < n and (s := score.get(part[i] + part[j])) is not None:
                heapq.heappush(heap, (-s, i, len(part[i]) + len(part[j])))

        for i in range(n - 1):
            offer(i)
        while heap:
            _, i, size = heapq.heappop(heap)
            if part[i] is None or right[i] >= n or len(part[i]) + len(part[right[i]]) != size:
                continue  # one of the two has been merged meanwhile
            j = right[i]
            part[i] += part[j]
            part[j] = None
            right[i] = right[j]
            if right[j] < n:
                left[right[j]] = i
            offer(i)
            if left[i] >= 0:
                offer(left[i])
        return [p for p in part if p is not None]

    def weight(self, token: str) -> int:
        """A character that no piece covers costs a token for each byte."""
        return 1 if token in self.pieces else len(token.encode("utf-8", "surrogatepass"))

    def compatible(self, a: str, b: str) -> bool:
        ok = self.fits.get((a, b))
        if ok is None:
            ok = self.fits[a, b] = self.merged(a + b) == ([a, b] if a else [b])
        return ok

    def run(self, spaces: int) -> int:
        """Tokens of a run of spaces."""
        whole, state = divmod(spaces, len(self.runs))
        return whole + self.runs[state]

    def compile(self, word: str) -> int:
        """Tokens of one word: those of its letters with one space before them, and of the other spaces."""
        letters = word.lstrip(" ")
        spaces = len(word) - len(letters)
        if spaces < 2:
            return self.read(word)[0]
        if not letters:
            return self.run(spaces)
        n, _, lone = self.read(" " + letters)
        return n - 1 + self.run(spaces) if lone else n + self.run(spaces - 1)

    def read(self, word: str) -> tuple[int, str, bool]:
        """The state after a word: from the longest known prefix, one transition for each further character."""
        kept = self.states
        if len(kept) >= KEPT_STATES:
            kept.clear()
            kept[""] = (0, "", False)
        known = min(len(word), KEPT_CHARS)
        while word[:known] not in kept:
            known -= 1
        states = [kept.get(word[:k]) for k in range(known + 1)]  # None: left out when the table was full
        if None in states:
            known, states = 0, states[:1]
        # pieces by where they end, the longest first; a character that no piece holds is a token of its own
        ending: list[list[int]] = [[] for _ in range(len(word) + 1)]
        for end, size in self.matcher.iter(word):
            ending[end + 1].append(size)
        for end in range(known + 1, len(word) + 1):
            for size in (*sorted(ending[end], reverse=True), 1):
                token = word[end - size : end]
                n, before, lone = states[end - size]
                if self.compatible(before, token):
                    states.append((n + self.weight(token), token, lone if size < end else token == " "))
                    break
            if end <= KEPT_CHARS:
                kept[word[:end]] = states[end]
        return states[-1]

    def emitted(self, word: str) -> int:
        """The count on the path over ``word``."""
        n = self.emits.get(word)
        if n is None:
            n = self.compile(word)
            if len(word) <= KEPT_CHARS:
                if len(self.emits) >= KEPT:
                    self.emits.clear()
                self.emits[word] = n
        return n

    def total(self, words: list[str]) -> int:
        n, emits = 0, self.emits
        for w in words:
            k = emits.get(w)
            n += self.emitted(w) if k is None else k
        return n

    def map_of(self, chunk: str) -> StateMap:
        words = self.words(chunk)
        if len(words) < 2:
            return StateMap(chunk, 0, None)
        return StateMap(words[0], self.total(words[1:-1]), words[-1])

    def compose(self, a: StateMap, b: StateMap) -> StateMap:
        """The map of chunk a and then chunk b; associative."""
        between = self.words((a.head if a.tail is None else a.tail) + b.head)
        if a.tail is None and b.tail is None:
            if len(between) < 2:
                return StateMap(a.head + b.head, 0, None)
            return StateMap(between[0], self.total(between[1:-1]), between[-1])
        if a.tail is None:
            return StateMap(between[0], self.total(between[1:]) + b.count, b.tail)
        if b.tail is None:
            return StateMap(a.head, a.count + self.total(between[:-1]), between[-1])
        return StateMap(a.head, a.count + self.total(between) + b.count, b.tail)

    def count(self, text: str | None, chunk: int = CHUNK) -> int:
        """Tokens of a text: the state maps of its chunks, composed pairwise, level by level, like a parallel prefix scan."""
        if not text:
            return 0
        text = " " + text.replace(SPACE, " ")  # the vocabulary puts a space before every text
        maps = [self.map_of(text[i : i + chunk]) for i in range(0, len(text), chunk)]
        while len(maps) > 1:
            maps = [self.compose(*maps[i : i + 2]) if i + 1 < len(maps) else maps[i] for i in range(0, len(maps), 2)]
        (m,) = maps
        return self.total(self.words(m.head)) if m.tail is None else self.total([m.head, m.tail]) + m.count


_compiled: dict[int, Transducer] = {}


def token_count(spark: SparkSession, text: Column, model_path: str) -> Column:
    """Column: the number of tokens. The vocabulary (fixed size, read once on the driver) goes to the tasks as a broadcast."""
    ship_code(spark)
    pieces = spark.sparkContext.broadcast(read_pieces(model_path))

    def counts(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        value = pieces.value
        t = _compiled.get(hash(model_path)) or _compiled.setdefault(hash(model_path), Transducer(value))
        for x in texts:
            yield x.map(t.count, na_action=None).astype("int64")

    return pandas_udf(counts, "long")(text)


def count_tokens(docs: DataFrame, model_path: str, text: str = "text", doc_id: str = "doc_id", limit: int = LIMIT) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) for every row of ``docs``.

    Null texts count as empty (0 bytes, 0 tokens); null ids and repeated rows are kept as they are; other columns are
    not read; an empty table gives none.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    counted = docs.select(F.col(doc_id).alias("doc_id"), F.octet_length(body).cast("long").alias("n_bytes"), token_count(docs.sparkSession, body, model_path).alias("n_tokens"))
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of every document under the 32k byte-fallback vocabulary."""
    import public_tokenizers

    return count_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("piece_bpe_32k.model"))
