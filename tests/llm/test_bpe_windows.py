"""The tree's windows: equal tokens, and little encoded again, whatever the script."""

import random

import pytest

from entwine.llm import bpe
from entwine.llm.queries import tokenizer


@pytest.fixture(scope="module")
def loaded():
    return bpe.load_encoding(*tokenizer())


def counting(enc, pieces, leaf=1024, reach=256):
    seen = [0, 0]

    def encode(text):
        seen[0] += len(text)
        seen[1] = max(seen[1], len(text))
        return enc.encode_ordinary(text)

    def piece(data):
        seen[0] += len(data)
        return enc._encode_single_piece(data)

    return bpe.TreeCodec(encode, pieces, leaf, piece, reach), seen


def texts(n):
    rng = random.Random(3)
    pick = lambda chars, k: "".join(rng.choices(chars, k=k))
    chinese = [chr(c) for c in range(0x4E00, 0x4E00 + 900)]
    yield "spaces", " ".join(pick("etaoinshrdlu", rng.randrange(1, 12)) for _ in range(n // 6))
    yield "lines", "\n".join(pick("etaoinshrdlu.,", rng.randrange(1, 30)) for _ in range(n // 15))
    yield "han", pick(chinese, n)
    yield "han with stops", pick(chinese * 9 + list("。，"), n)
    yield "base64", pick("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", n)
    yield "one letter", "a" * n
    yield "two letters", pick("ab", n)
    yield "digits", pick("0123456789", n)
    yield "rule", "-" * n + "=" * (n // 2)
    yield "hindi", pick("कखगघचछजझटठडढतथदधनपफबभमयरलवशषसह" "ािीुूेैोौ्ं", n)
    yield "thai", pick([chr(c) for c in range(0xE01, 0xE2F)], n)
    yield "cyrillic", pick([chr(c) for c in range(0x430, 0x450)], n)


def test_little_is_encoded_again(loaded):
    enc, pieces = loaded
    n = 60_000
    for name, text in texts(n):
        codec, seen = counting(enc, pieces)
        assert codec.encode(text) == enc.encode_ordinary(text), name
        if name in ("one letter", "rule"):  # a remainder of a run of one character moves through all of it: no token stays
            continue
        bytes_per_char = len(text.encode()) / len(text)
        assert seen[0] < (1 + bytes_per_char) * len(text) and seen[1] <= 4096, (name, seen)


@pytest.mark.parametrize("leaf,reach", [(1, 8), (3, 8), (16, 12), (64, 40)])
def test_small_leaves_give_the_same_tokens(loaded, leaf, reach):
    enc, pieces = loaded
    rng = random.Random(leaf)
    parts = ["a", "the", " ", "  ", "\n", "\t", " ", "　", "'s", "'", "'ll", "''", "22", "½", "!", "...", "é", "é", "中", "中文字", "\U0001F600", "\x1c", "\x85", " the", "ll", "re", "ß", "ﬁ", "​", "กั", "Ⅷ", "\U00010400", "\U0001E900"]
    for _ in range(300):
        s = "".join(rng.choice(parts) for _ in range(rng.randrange(90)))
        if rng.random() < 0.3:
            s += rng.choice(["a", "中", "1", "-", " ", "\n"]) * rng.randrange(80) + rng.choice(parts)
        codec, _ = counting(enc, pieces, leaf, reach)
        ids = codec.encode(s)
        assert ids == enc.encode_ordinary(s) and codec.decode(ids) == s.encode(), repr(s)


def test_kinds_part_only_matches(loaded):
    """A cut between two characters holds whatever stands around: the parts' tokens are the whole's."""
    enc, _ = loaded
    rng = random.Random(8)
    alphabet = list("ab'sdlm 1.\n\t!") + ["é", "中", "́", "½", " "]
    for _ in range(4000):
        s = "".join(rng.choices(alphabet, k=rng.randrange(2, 9)))
        for i in range(1, len(s)):
            if bpe.parted(bpe.KINDS[s[i - 1]], bpe.KINDS[s[i]]):
                assert enc.encode_ordinary(s[:i]) + enc.encode_ordinary(s[i:]) == enc.encode_ordinary(s), (s, i)


def test_decoding_refuses_a_name_that_is_taken(spark):
    df = spark.createDataFrame([([464],), (None,), ([],)], "ids array<int>")
    assert [r.decoded for r in bpe.decode(df, *tokenizer()).collect()] == [bytearray(b"The"), None, bytearray(b"")]
    with pytest.raises(ValueError):
        bpe.decode(df, *tokenizer(), out_col="ids")
