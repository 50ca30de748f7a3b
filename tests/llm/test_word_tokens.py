"""The 49k vocabulary's encoder: what it keeps must not change what it gives, and few letters must decide most longest tokens."""

import random

import pytest

from pathwatch.llm import bpe


@pytest.fixture(scope="module")
def path():
    return __import__("public_tokenizers").path("word_bpe_49k.json")


def odd_texts():
    g = random.Random(3)
    letters = "aabcdeehinorst'.!éüßЖ中0 \U0001f600"
    return ["", " ", "<|endoftext|>", *["".join(g.choice(letters) for _ in range(g.randrange(1, 60))) for _ in range(300)],
            *["ab" * k + "abe" * (k % 3) for k in range(1, 60)], *["".join(g.choices(["chach", "keit", "ción", "thand", "ing"], k=g.randrange(1, 9))) for _ in range(300)]]


def test_small_caches_give_the_library_s_ids(path, monkeypatch):
    import tokenizers

    known, v = tokenizers.Tokenizer.from_file(path), bpe.Vocabulary(open(path, encoding="utf-8").read())
    for name in ("KEPT", "KEPT_DIGESTS", "KEPT_PAIRS", "KEPT_BEGINNINGS"):
        monkeypatch.setattr(bpe, name, 7)
    d = bpe.Digest(v)
    for x in odd_texts():
        want = known.encode(x, add_special_tokens=False).ids
        assert v.encode(x) == want
        n, ids, decoded = d.of(x)
        assert n == len(want)
        assert (ids, decoded) == tuple(bpe.hashlib.sha256(y.encode()).hexdigest() for y in (" ".join(map(str, want)), known.decode(want, skip_special_tokens=False)))


def test_few_letters_decide_the_longest_token(path):
    v = bpe.Vocabulary(open(path, encoding="utf-8").read())
    words = [w for x in odd_texts() for p in v.pieces(x) for w in v.words(p) if w.isascii()]
    asked = [0]
    plain = v.longest

    def longest(letters, at):
        asked[0] += 1
        got = plain(letters, at)
        fits = [t for n, t in ((n, v.id_of.get(letters[at : at + n], -1)) for n in range(1, len(letters) - at + 1)) if t >= 0]
        assert got == (fits[-1] if fits else -1)
        return got

    v.longest = longest
    first = [v.encode_word(w) for w in words]
    cold, asked[0] = asked[0], 0
    assert [v.encode_word(w) for w in words] == first
    assert 0 < asked[0] < cold / 2 + len(words)
