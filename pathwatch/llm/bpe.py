"""Exact BPE encoding by longest matches with backtracking, and decoding from an offset table."""

from __future__ import annotations

import hashlib
import json
import unicodedata
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from pathwatch.session import ship_code

#: Fixed values of the vocabulary file's format: word end, special tokens, the pattern of its pre-tokenizer.
WORD_END = "</w>"
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\p{White_Space}\p{L}\p{N}]+"
#: Stands for WORD_END inside; not a byte's letter.
END = ""
#: What a task keeps: encoded pieces of text, pieces with their digests, pairs of the pair table, beginnings; and the longest piece that it keeps.
KEPT, KEPT_DIGESTS, KEPT_PAIRS, KEPT_BEGINNINGS, KEPT_CHARS = 1 << 17, 1 << 19, 1 << 18, 1 << 16, 48
#: Letters of a beginning, for which the longest token is kept.
BEGINNING = 5

#: What a later Unicode version than the library's (16.0) has made a letter or a number, or may make one. It is neither here.
LATER = (
    "\u0558\u058b-\u058c\u088f\u0c5c\u0cdc\u208f\u209d-\u209f\ua7ce-\ua7cf\ua7d2\ua7d4\ua7dd\ua7e2\ua7f1\uab6c-\uab6d"
    "\U000107bb-\U000107bf\U00010940-\U00010959\U00010ec5-\U00010ec7\U00010ed9-\U00010eee\U00011b0a\U00011db0-\U00011ddb\U00011de0-\U00011de9\U00011df1"
    "\U0001246f\U00012475-\U0001247f\U00012550-\U00012686\U00016ea0-\U00016eb8\U00016ebb-\U00016ed3\U00016ff2-\U00016ff6\U000187f8-\U000187ff"
    "\U00018cd6-\U00018cda\U00018d09-\U00018d20\U00018d80-\U00018df2\U00018e00-\U00019191\U000191a0-\U000191d2\U0001b123-\U0001b128\U0001b168"
    "\U0001d6a6\U0001df1f-\U0001df24\U0001df2b-\U0001df81\U0001df90-\U0001df96\U0001dfcd-\U0001dfff\U0001e6c0-\U0001e6de\U0001e6e0-\U0001e6e2"
    "\U0001e6e4-\U0001e6e5\U0001e6e7-\U0001e6ed\U0001e6f0-\U0001e6f4\U0001e6fe-\U0001e6ff\U0002b73a-\U0002b73f\U0002b81e\U0002cea2-\U0002cead"
    "\U000323b0-\U00033479\U0003d000-\U0003fc3f"
)
#: Capital letters newer than the standard library's tables, and their small letters.
CAPITALS = {0x1C89: 0x1C8A, 0xA7CB: 0x264, 0xA7CC: 0xA7CD, 0xA7CE: 0xA7CF, 0xA7D2: 0xA7D3, 0xA7D4: 0xA7D5, 0xA7DA: 0xA7DB, 0xA7DC: 0x19B}
CAPITALS |= {c: c + 0x20 for c in range(0x10D50, 0x10D66)} | {c: c + 0x1B for c in range(0x16EA0, 0x16EB9)}
#: The one composition that is newer than the library's tables.
UNCOMPOSED, COMPOSED = "\U00011935\U00011930", "\U00011938"

_words = regex.compile(WORDS)
_later = regex.compile(f"[{LATER}]")
_words_without_later = regex.compile(WORDS.replace(r"[\p{L}]+", rf"[\p{{L}}--[{LATER}]]+").replace(r"[\p{N}]", rf"[\p{{N}}--[{LATER}]]").replace(r"[^\p{White_Space}\p{L}\p{N}]+", rf"[[^\p{{White_Space}}\p{{L}}\p{{N}}]||[{LATER}]]+"), regex.V1)
_capitals = regex.compile("[" + "".join(map(chr, CAPITALS)) + "]")
#: str.split() takes these for space, the pattern doesn't.
_not_space = regex.compile("[\x1c-\x1f]")
_space = regex.compile(r"\p{White_Space}+")


def nfc(text: str) -> str:
    """Canonical composition as the library has it."""
    if UNCOMPOSED[0] not in text:
        return unicodedata.normalize("NFC", text)
    return COMPOSED.join([unicodedata.normalize("NFC", x).replace(COMPOSED, UNCOMPOSED) for x in text.split(COMPOSED)])


def byte_letters() -> list[str]:
    """The letter that stands for each byte: printable Latin-1 for itself, the others from U+0100 on, in order."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


class Vocabulary:
    """A BPE vocabulary with word ends, read from its JSON text."""

    def __init__(self, source: str):
        j = json.loads(source)
        vocab = {t: i for t, i in j["model"]["vocab"].items()}
        self.special = {a["content"]: a["id"] for a in j["added_tokens"]}
        self.rank = {(self._inner(a), self._inner(b)): r for r, (a, b) in enumerate(j["model"]["merges"])}
        self.id_of = {self._inner(t): i for t, i in vocab.items() if t not in self.special}
        # decoding: all tokens in one string, and where each begins
        names = {i: t for t, i in (vocab | self.special).items()}
        self.letters = "".join(names[i] for i in range(len(names)))
        self.offsets = np.concatenate([[0], np.cumsum([len(names[i]) for i in range(len(names))])]).tolist()
        self.symbols = {i: self._symbols(t) for t, i in self.id_of.items()}
        self.size = {i: len(t) for t, i in self.id_of.items()}
        # the longest token that a token begins with, itself left out; -1: none
        self.shorter = {i: next((self.id_of[t[:k]] for k in range(len(t) - 1, 0, -1) if t[:k] in self.id_of), -1) for t, i in self.id_of.items()}
        self.matcher = ahocorasick.Automaton()
        for t, i in self.id_of.items():
            self.matcher.add_word(t, (i, len(t)))
        self.matcher.make_automaton()
        self.fits: dict[int, bool] = {}
        self.longer = {t[:BEGINNING] for t in self.id_of if len(t) > BEGINNING}
        self.beginnings: dict[str, int] = {}
        self.byte_of = byte_letters()
        self.split_special = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None
        self.encoded: dict[str, tuple[int, ...]] = {}

    @staticmethod
    def _inner(token: str) -> str:
        return token[: -len(WORD_END)] + END if token.endswith(WORD_END) and len(token) > len(WORD_END) else token

    @staticmethod
    def _symbols(token: str) -> list[str]:
        return [*token[:-2], token[-2:]] if token[-1:] == END else [*token]

    def merged(self, symbols: list[str]) -> list[str]:
        """The merges in order of rank, as the vocabulary defines them; for the table of pairs only, on a few symbols."""
        parts = list(symbols)
        while len(parts) > 1:
            ranks = [self.rank.get(p, len(self.rank)) for p in zip(parts, parts[1:])]
            best = min(ranks)
            if best == len(self.rank):
                break
            at = ranks.index(best)
            pair = (parts[at], parts[at + 1])
            out, i = [], 0
            while i < len(parts):
                if i + 1 < len(parts) and (parts[i], parts[i + 1]) == pair:
                    out.append(parts[i] + parts[i + 1])
                    i += 2
                else:
                    out.append(parts[i])
                    i += 1
            parts = out
        return parts

    def compatible(self, a: int, b: int) -> bool:
        """The pair table: may token b follow token a? Only if merging their letters together gives just these two. a < 0: none before."""
        key = (a << 32) + b
        ok = self.fits.get(key)
        if ok is None:
            both = [b] if a < 0 else [a, b]
            want = ["".join(self.symbols[t]) for t in both]
            if len(self.fits) >= KEPT_PAIRS:
                self.fits.clear()
            ok = self.fits[key] = self.merged([s for t in both for s in self.symbols[t]]) == want
        return ok

    def encode_word(self, word: str) -> tuple[int, ...]:
        """Ids of one word. From each place the longest token is tried that fits the one before; a dead end is never entered twice."""
        # printable ASCII stands for itself
        plain = word.isascii() and word.isprintable()
        letters = (word if plain else "".join(map(self.byte_of.__getitem__, word.encode("utf-8", "surrogatepass")))) + END
        n, at, last = len(letters), 0, -1
        dead = bytearray(n + 1)
        out: list[int] = []
        fits, size, shorter, beginnings, longest = self.fits, self.size, self.shorter, self.beginnings, self.longest
        token = beginnings.get(letters[:BEGINNING])
        if token is None:
            token = longest(letters, 0)
        while at < n:
            while token >= 0:
                end = at + size[token]
                if not dead[end]:
                    ok = fits.get((last << 32) + token)
                    if ok or (ok is None and self.compatible(last, token)):
                        break
                token = shorter[token]
            if token >= 0:
                out.append(token)
                at, last = end, token
                token = beginnings.get(letters[at : at + BEGINNING])
                if token is None and at < n:
                    token = longest(letters, at)
            elif out:  # nothing fits here: go back and take a shorter token there
                dead[at] = 1
                token = shorter[out.pop()]
                at -= size[last]
                last = out[-1] if out else -1
            else:
                raise ValueError("a text that the vocabulary cannot spell")
        return tuple(out)

    def longest(self, letters: str, at: int) -> int:
        """The longest token from this place on, -1 if none begins here. Kept where the next few letters decide it."""
        end, (token, size) = next(self.matcher.iter_long(letters, at), (0, (-1, 0)))
        found = token if end + 1 - size == at else -1
        start = letters[at : at + BEGINNING]
        if start not in self.longer:
            if len(self.beginnings) >= KEPT_BEGINNINGS:
                self.beginnings.clear()
            self.beginnings[start] = found
        return found

    @staticmethod
    def words(piece: str) -> list[str]:
        """The words of a piece of normalized text without white space."""
        if piece.isalpha() and (piece.isascii() or max(piece) < "\u0180"):
            return [piece]
        spelled = piece.translate(CAPITALS) if not piece.isascii() and _capitals.search(piece) else piece
        return (_words_without_later if not spelled.isascii() and _later.search(spelled) else _words).findall(spelled)

    def encode_piece(self, piece: str) -> tuple[int, ...]:
        """Ids of a piece of normalized text without white space."""
        ids = self.encoded.get(piece)
        if ids is None:
            words = self.words(piece)
            ids = self.encode_word(words[0]) if len(words) == 1 else tuple([i for w in words for i in self.encode_piece(w)])
            if len(piece) <= KEPT_CHARS:
                if len(self.encoded) >= KEPT:
                    self.encoded.clear()
                self.encoded[piece] = ids
        return ids

    def parts(self, text: str) -> Iterator[tuple[str, int | None]]:
        """The text between special tokens' strings, and these strings with their ids."""
        for p in self.split_special.split(text) if self.split_special and "<|" in text else [text]:
            yield p, self.special.get(p)

    @staticmethod
    def pieces(text: str) -> list[str]:
        """Normalized pieces between white space."""
        if not text.isascii():
            text = nfc(text).replace("Σ", "σ")  # lower case letter by letter: no final sigma
        text = text.lower()
        return [x for x in _space.split(text) if x] if _not_space.search(text) else text.split()

    def encode(self, text: str | None) -> list[int]:
        out: list[int] = []
        for part, special in self.parts(text or ""):
            if special is None:
                for x in self.pieces(part):
                    out.extend(self.encode_piece(x))
            else:
                out.append(special)
        return out

    def decode(self, ids) -> str:
        """Tokens cut from the offset table. The vocabulary names no decoder: tokens are joined by one space, word ends stay."""
        letters, at = self.letters, self.offsets
        return " ".join([letters[at[i] : at[i + 1]] for i in ids])


class Digest:
    """Count and hashes of a text's ids and of their decoded text; what a piece contributes is kept."""

    def __init__(self, v: Vocabulary):
        self.v, self.known = v, {}

    def piece(self, x: str) -> tuple[int, str, str]:
        words = self.v.words(x)
        if len(words) == 1:
            ids = self.v.encode_word(words[0])
            got = (len(ids), " ".join(map(str, ids)), self.v.decode(ids))
        else:
            sizes, ids, decoded = zip(*[self.known.get(w) or self.piece(w) for w in words])
            got = (sum(sizes), " ".join(ids), " ".join(decoded))
        if len(x) <= KEPT_CHARS:
            if len(self.known) >= KEPT_DIGESTS:
                self.known.clear()
            self.known[x] = got
        return got

    def of(self, text: str | None) -> tuple[int, str, str]:
        known, got = self.known, []
        for part, special in self.v.parts(text or ""):
            if special is None:
                pieces = self.v.pieces(part)
                found = [*map(known.get, pieces)]
                got += [g or self.piece(x) for g, x in zip(found, pieces)] if None in found else found
            else:
                got.append((1, str(special), self.v.decode([special])))
        sizes, ids, decoded = zip(*got) if got else ((), (), ())
        sha = lambda x: hashlib.sha256(" ".join(x).encode("utf-8")).hexdigest()
        return sum(sizes), sha(ids), sha(decoded)


_loaded: dict[int, tuple[Vocabulary, Digest]] = {}


def _load(source: str) -> tuple[Vocabulary, Digest]:
    """One vocabulary for all tasks of a worker."""
    key = hash(source)
    if key not in _loaded:
        v = Vocabulary(source)
        _loaded[key] = (v, Digest(v))
    return _loaded[key]


def _source(spark: SparkSession, path: str):
    """The vocabulary file (fixed size), read on the driver and sent as a broadcast."""
    ship_code(spark)
    with open(path, encoding="utf-8") as f:
        return spark.sparkContext.broadcast(f.read())


def encode(spark: SparkSession, text: Column, path: str) -> Column:
    """array<int>: the ids of a text; null texts count as empty."""
    source = _source(spark, path)

    def ids(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        v = _load(source.value)[0]
        try:
            for t in texts:
                yield pd.Series([np.array(v.encode(x), dtype=np.int32) for x in t], dtype=object)
        finally:
            v.encoded.clear()  # the worker lives on; the next task of another stage needs the memory

    return pandas_udf(ids, "array<int>")(text)


def decode(spark: SparkSession, ids: Column, path: str) -> Column:
    """string: the decoded text of an array of ids; null counts as empty."""
    source = _source(spark, path)

    def texts(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        v = _load(source.value)[0]
        for b in batches:
            yield b.map(lambda x: "" if x is None else v.decode(x), na_action=None)

    return pandas_udf(texts, "string")(ids)


def digests(docs: DataFrame, path: str, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) for every row: each text is encoded, decoded, and both are hashed in one pass.

    Null texts count as empty; null ids and repeated rows are kept; other columns are not read; an empty table gives none.
    """
    source = _source(docs.sparkSession, path)

    def both(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        d = _load(source.value)[1]
        for t in texts:
            yield pd.DataFrame([d.of(x) for x in t], columns=["n_tokens", "ids_sha256", "decoded_sha256"]).astype({"n_tokens": "int64"})

    made = pandas_udf(both, "n_tokens long, ids_sha256 string, decoded_sha256 string")(F.coalesce(F.col(text), F.lit("")))
    return docs.select(F.col(doc_id).alias("doc_id"), made.alias("d")).select("doc_id", "d.*")


def op9_bpe_encode_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document encoded with the 49k word-end vocabulary and decoded again."""
    import public_tokenizers

    return digests(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("word_bpe_49k.json"))
