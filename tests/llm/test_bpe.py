"""The tokenizer against the library that it stands for, and its automaton against a dictionary."""

import hashlib
import random

import pytest
from tokenizers import Tokenizer

from lodestar.llm import bpe

ODD = [
    "", "   ", "a", "İstanbul ΟΔΟΣ ΣΑΣ ß ǅ", "<|endoftext|>x<|startoftext|> <|endoftext|>", "<|end", "don't I'LL we've 's'S 12345 ½ ² 'T 'Re",
    "é Å \x1c \x1d a\x1fb \x85 ​ ﻿ x　y z", "日本語 テスト 🙂👩‍👩‍👧", "a" * 50_000, "ab" * 30, "!?" * 3_000, "\u0000 nul", "ﬁ ﬀ Ⅷ", "\n\t\r\v\f", "x y", "₏ Ᲊ ㈻0",
]


@pytest.fixture(scope="module")
def reference():
    t = Tokenizer.from_file(bpe.vocabulary_path())
    t.no_truncation()
    t.no_padding()
    return t


@pytest.fixture(scope="module")
def vocab():
    return bpe.Vocabulary(bpe.vocabulary_path())


def random_texts(n):
    rng = random.Random(2)
    for _ in range(n):
        kinds = [lambda: rng.choice("abcdefgh tion"), lambda: chr(rng.randrange(32, 127)), lambda: chr(rng.randrange(0xA0, 0x250))]
        yield "".join(rng.choice(kinds)() for _ in range(rng.randrange(80)))


def test_ids_equal_the_librarys(vocab, reference):
    merger = bpe.Merger(vocab)
    for text in [*ODD, *random_texts(500)]:
        words = vocab.words(text)
        want = reference.encode(text, add_special_tokens=False).ids
        assert [i for w in words for i in vocab.merge(w)] == want, text[:50]
        assert [i for ids in merger.merge(words) for i in ids] == want, text[:50]
        assert vocab.decode(want) == reference.decode(want, skip_special_tokens=False)


def test_every_character_is_normalised_alike(reference):
    """White space aside, which cuts words and is never part of one."""
    characters = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    text = " ".join(f"a{c}b" for c in characters if not c.isspace())
    assert bpe._normal(text) == reference.normalizer.normalize_str(text)


def test_words_of_every_character_are_the_librarys(vocab, reference):
    characters, merger = [chr(c) for c in range(0x21, 0x110000) if not 0xD800 <= c < 0xE000], bpe.Merger(vocab)
    for at in range(0, len(characters), 4096):
        text = " ".join(f"a{c}b {c}" for c in characters[at : at + 4096])
        assert [i for ids in merger.merge(vocab.words(text)) for i in ids] == reference.encode(text, add_special_tokens=False).ids, hex(ord(characters[at]))


def test_long_words_merge_alike(vocab):
    rng = random.Random(1)
    for n in (2, bpe.LONG_WORD, bpe.LONG_WORD + 1, 300):
        word = "".join(rng.choice("abethin") for _ in range(n))
        parts = [*map(vocab.letters.__getitem__, word.encode()[:-1]), vocab.endings[ord(word[-1])]]
        assert vocab._merge_long(list(parts)) == vocab.merge(word) == bpe.Merger(vocab).merge([word])[0]


def test_lexicon_is_a_minimal_map():
    rng = random.Random(3)
    words = {"".join(rng.choice("abcé") for _ in range(rng.randrange(1, 7))): [n, n + 1][: 1 + n % 2] for n in range(600)}
    lexicon = bpe.Lexicon.mapped(bpe.Lexicon.compile(words))
    assert all(lexicon.find(w) == ids for w, ids in words.items())
    assert all(lexicon.find(w) is None for w in ("", "zz", "abcabcabc", "x") if w not in words)
    chain = bpe.Lexicon(bpe.Lexicon.compile({p + "tion": [1] for p in ("a", "b", "c", "na")}))
    assert len(chain.final) == 7  # one suffix for all: root, n, and the five states of tion
    assert bpe.Lexicon(bpe.Lexicon.compile({})).find("a") is None


def digests(reference, text):
    ids = reference.encode(text or "", add_special_tokens=False).ids
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return len(ids), sha(" ".join(map(str, ids))), sha(reference.decode(ids, skip_special_tokens=False))


def test_digest_encode_decode(spark, reference, monkeypatch):
    texts = [*ODD, None, "a repeated row", "a repeated row", *random_texts(40)]
    docs = spark.createDataFrame([(i if i else None, t, "ids") for i, t in enumerate(texts)], "doc_id long, text string, ids string")
    found = {r["doc_id"]: tuple(r)[1:] for r in bpe.digest(docs, bpe.vocabulary_path()).collect()}
    assert found == {i if i else None: digests(reference, t) for i, t in enumerate(texts)}
    assert {tuple(r) for r in bpe.digest(docs, bpe.vocabulary_path(), chunks=3, rows=2).collect()} == {(k, *v) for k, v in found.items()}
    decoded = bpe.decode(bpe.encode(docs, bpe.vocabulary_path()), bpe.vocabulary_path()).collect()
    for r in decoded:
        ids = reference.encode(texts[r["doc_id"] or 0] or "", add_special_tokens=False).ids
        assert list(r["ids"]) == ids and r["decoded"] == reference.decode(ids, skip_special_tokens=False)


def test_small_tables_change_nothing(spark, reference, monkeypatch):
    vocab = bpe.Vocabulary(bpe.vocabulary_path())
    known = bpe._Known(vocab, bpe.Lexicon.compile({"tion": vocab.merge("tion")}))
    monkeypatch.setattr(bpe, "KNOWN_CHUNKS", 10)
    for text in random_texts(50):
        assert " ".join(x[0] for x in known.of([text])[0]) == " ".join(map(str, reference.encode(text, add_special_tokens=False).ids))


def test_empty_table(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert bpe.digest(empty, bpe.vocabulary_path()).collect() == []
    assert bpe.encode(empty, bpe.vocabulary_path()).collect() == []
