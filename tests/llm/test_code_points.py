"""Both tokenizers against the libraries on unusual characters and on long words."""

import random
import unicodedata

import pytest

from pathwatch.llm import bpe, token_counts

tokenizers = pytest.importorskip("tokenizers")


def test_classes_of_all_scripts():
    """Every code point but most ideographs, syllables and private ones, of which each sixteenth is tried."""
    import public_tokenizers

    path = public_tokenizers.path("word_bpe_49k.json")
    known, own = tokenizers.Tokenizer.from_file(path), bpe.Vocabulary(open(path, encoding="utf-8").read())
    uniform = lambda c: unicodedata.category(chr(c)) in ("Lo", "Co", "Cn") and c > 0x3400 and c % 16
    points = [c for c in range(0x110000) if not 0xD800 <= c <= 0xDFFF and not (uniform(c) and (c > 0x1FFFF or 0x3400 <= c <= 0xD7FF or 0xE000 <= c <= 0xF8FF))]
    for at in range(0, len(points), 256):
        text = " ".join(f"a{chr(c)}b {chr(c)}1!{chr(c)}" for c in points[at : at + 256])
        assert known.encode(text, add_special_tokens=False).ids == own.encode(text), hex(points[at])
    for text in ("\U00011935\U00011930", "a\U00011938\U00011935\U00011930b́", "ꟋA"):
        assert known.encode(text, add_special_tokens=False).ids == own.encode(text)


def test_long_words_go_through_the_transducer(monkeypatch):
    import public_tokenizers
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    known, own = sentencepiece.SentencePieceProcessor(model_file=path), token_counts.Transducer(token_counts.read_pieces(path))
    g = random.Random(3)
    texts = ["".join(g.choice("abcdefghijklmnopqrstuvwxyz0123中文字符のは한국어ÀéÖß—") for _ in range(g.randint(40, 400))) for _ in range(150)]
    texts += ["".join(g.choice(["the", "ing", "un", "和", "の", "日本"]) for _ in range(200)) for _ in range(50)] + ["中文" * 300, "the" * 300, "ab" * 5000, "=-" * 200]
    want = [len(known.encode(x)) for x in texts]
    monkeypatch.setattr(own, "merged", _short_only(own.merged))
    assert [own.count(x) for x in texts] == want


def _short_only(merged):
    def run(word):
        assert len(word) <= 64, "only pairs of tokens are merged"
        return merged(word)

    return run
