import os
import random

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from lodestone.llm import bpe
from lodestone.llm.lexicon import Lexicon, compile_words
from lodestone.llm.words import blocks
from tokenizers import Tokenizer

PATH = public_tokenizers.path("word_bpe_49k.json")
ODD = [
    "", " ", "Hello, WORLD's 12345 don't 'sun we'll x", "İstanbul ΣΑΣ Σ ß ﬁ", "éä ñ 한국어 日本語 ٣٤",
    "a\x1cb\x85c\xa0d e​f", "<|endoftext|>x<|startoftext|> <|endof", "a" * 500, "abc" * 400 + "!!", "***$$$ a_b-c 'S 'LL",
    "\0<|endoftext|>", "\0", "½ ² ⅷ 10²", "😀👍🏽 x", "tab\tnew\nline\r\n\x0b\x0c.",
]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def _texts():
    rng = random.Random(5)
    letters = "abcdeißÉéñ'’.,!?0123456789 \n\t<|>*ABCЖшΣσ中😀́\x1c\x85"
    return ODD + ["".join(rng.choices(letters, k=rng.randint(0, 80))) for _ in range(400)]


def split_rows(encoder, texts):
    out = []
    for block in blocks(pa.array(texts, pa.string()), 600):
        ids, size = encoder.encode(block)
        out += [x.tolist() for x in np.split(ids, np.cumsum(size)[:-1])]
    return out


def test_encode_and_decode_equal_the_library(library):
    v = bpe.Vocabulary(PATH)
    texts = _texts()
    for text, got in zip(texts, split_rows(bpe.Encoder(v, None), texts)):
        want = library.encode(text, add_special_tokens=False).ids
        assert got == want, text
        assert " ".join(v.tokens[i] for i in got) == library.decode(want, skip_special_tokens=False)


def test_lexicon_shares_suffixes_and_finds_its_words_only(tmp_path):
    rng = random.Random(1)
    stems = ["".join(rng.choices("abcde", k=rng.randint(1, 6))) for _ in range(300)]
    words = {(s + e).encode() for s in stems for e in ("", "ing", "tion", "é")}
    entries = {w: [rng.randrange(60000) for _ in range(rng.randint(1, 4))] for w in words}
    path = os.path.join(tmp_path, "l.bin")
    with open(path, "wb") as f:
        f.write(compile_words(entries))
    lexicon = Lexicon(path)
    assert len(lexicon) == len(words)
    assert lexicon.states < sum(map(len, words)) / 4
    asked = [*sorted(words), b"", b"zz", b"a\xc3", *[w + b"x" for w in words], *[w[:-1] for w in words]]
    for w, r in zip(asked, lexicon.rank(asked)):
        assert (r >= 0) == (w in entries)
        if r >= 0:
            assert lexicon.output(r).tolist() == entries[w]


def test_queries_operator_on_odd_rows(spark, library):
    rows = [(i, t, i) for i, t in enumerate(_texts()[:60])] + [(None, None, 1), (3, None, 2), (3, "the the the", 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids int").withColumnRenamed("ids", "decoded")
    name = bpe.ship_lexicon(docs, PATH, limit=50)
    got = bpe.encode(docs, PATH, name).collect()
    want = sorted((str(i), library.encode(t or "", add_special_tokens=False).ids) for i, t, _ in rows)
    assert sorted((str(r.doc_id), r.ids) for r in got) == want
    back = bpe.decode(bpe.encode(docs, PATH, name).drop("decoded"), PATH).collect()
    assert sorted(r.decoded for r in back) == sorted(library.decode(w, skip_special_tokens=False) for _, w in want)
    assert bpe.encode(docs.limit(0), PATH, bpe.ship_lexicon(docs.limit(0), PATH)).count() == 0


def test_pieces_with_equal_hashes_are_told_apart(library, monkeypatch):
    from lodestone.llm import pieces

    real = pieces.hashes
    monkeypatch.setattr(pieces, "hashes", lambda *a: real(*a) % np.uint64(7))
    encoder = bpe.Encoder(bpe.Vocabulary(PATH), None)
    for _ in range(2):
        assert split_rows(encoder, _texts()) == [library.encode(t, add_special_tokens=False).ids for t in _texts()]


def thue_morse(n):
    """A word of 2**n letters and its complement: every polynomial hash modulo 2**64 gives both the same value from n = 10 on."""
    s, t = "a", "b"
    for _ in range(n):
        s, t = s + t, t + s
    return s, t


@pytest.mark.parametrize("kind", ["transducer", "library"])
def test_words_that_polynomials_confuse(library, kind, monkeypatch):
    from lodestone.llm import library_tokens, words

    for long in (words.LONG, 1 << 30):  # with the hash of long words, and with polynomials alone
        monkeypatch.setattr(words, "LONG", long)
        for n in (9, 10, 11, 12):
            s, t = thue_morse(n)
            texts = [f"{s} {t}", s, t, f"x {t} {s} {s}", ""]
            want = [library.encode(x, add_special_tokens=False).ids for x in texts]
            for size in (600, 1 << 20):  # one block a text, and one for all
                encoder = bpe.Encoder(bpe.Vocabulary(PATH), None) if kind == "transducer" else library_tokens.LibraryEncoder(PATH)
                got = []
                for block in blocks(pa.array(texts, pa.string()), size):
                    ids, sizes = encoder.encode(block)
                    got += [x.tolist() for x in np.split(ids, np.cumsum(sizes)[:-1])]
                assert got == want
