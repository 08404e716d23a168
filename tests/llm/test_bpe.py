"""BPE against the tokenizers library, word by word and through Spark."""

import hashlib
import json

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from glucolake.llm import bpe

FILE = public_tokenizers.path("byte_bpe_50k.json")
TEXTS = [
    "", " ", "a", "hello world", "<|endoftext|>", "a<|endoftext|> b<|endoftext|><|endoftext|>", "  \n\n x\t\ty  ", "👩‍👩‍👧 é́ 日本語 Ωmega", "a" * 3000, "ab" * 2000 + "!?" * 700,
    "\x85\xa0　x", "don't I'LL we've 3.14 1000000", "\x00\x01�", "ſtraße ﬁ", "antidisestablishmentarianism" * 9,
]


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(FILE)
    t.no_truncation()
    t.no_padding()
    return t


def ids(coded):
    return np.frombuffer(coded, "<u4").tolist()


def test_equals_library(library):
    for text, coded in zip(TEXTS, bpe.tokenizer(FILE).encode(TEXTS), strict=True):
        want = library.encode(text, add_special_tokens=False).ids
        assert ids(coded) == want
        assert bpe.tokenizer(FILE).decode(coded) == library.decode(want, skip_special_tokens=False)


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=80))
def test_any_text_equals_library(text):
    library = Tokenizer.from_file(FILE)
    coded = bpe.tokenizer(FILE).encode([text])[0]
    assert ids(coded) == library.encode(text, add_special_tokens=False).ids
    assert bpe.tokenizer(FILE).decode(coded) == text


def test_both_trees_agree():
    rng, b = np.random.default_rng(1), bpe.tokenizer(FILE)
    words = ["".join(rng.choice(list("theraing on"), n)).encode() for n in rng.integers(1, 33, 500)]
    for width in (32,):
        assert b.merge_many(words, width) == [b.merge_one(w) for w in words]


def wide_file(path, merges: int, **model):
    """A tokenizer file of that many merges: all pairs of bytes, then such pairs with one byte more."""
    chars = list(bpe.byte_characters())
    pairs = [(a, b) for a in chars for b in chars]
    pairs += [(a + b, c) for a, b in pairs[: 1 + (merges - len(pairs)) // len(chars)] for c in chars]
    pairs = pairs[:merges]
    vocab = {t: i for i, t in enumerate([*chars, *(a + b for a, b in pairs)])}
    kind = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}
    spec = {"version": "1.0", "truncation": None, "padding": None, "added_tokens": [], "normalizer": None, "pre_tokenizer": kind, "post_processor": None, "decoder": kind}
    spec["model"] = {"type": "BPE", "dropout": None, "unk_token": None, "continuing_subword_prefix": None, "end_of_word_suffix": None, "fuse_unk": False, "byte_fallback": False, "ignore_merges": False, "vocab": vocab, "merges": [f"{a} {b}" for a, b in pairs]} | model
    path.write_text(json.dumps(spec))
    return str(path)


def test_tables_of_any_number_of_merges(tmp_path):
    file = wide_file(tmp_path / "wide.json", 300_000)
    own, library = bpe.SegmentTreeBPE(file), Tokenizer.from_file(file)
    texts = ["hello wide world 123", "\x00\x01\x02\x03 !!??", "日本語 é"]
    assert [ids(c) for c in own.encode(texts)] == [library.encode(t).ids for t in texts]
    assert own.decode(own.encode(texts)[0]) == texts[0]


def test_options_that_change_ids_are_refused(tmp_path):
    with pytest.raises(ValueError, match="dropout"):
        bpe.SegmentTreeBPE(wide_file(tmp_path / "odd.json", 100, dropout=0.1))


def test_memory_is_emptied_by_bytes(monkeypatch):
    b = bpe.SegmentTreeBPE(FILE)
    monkeypatch.setattr(bpe, "MEMORY_BYTES", 5000)
    for k in range(30):
        b.encode([f"{chr(97 + k % 26) * 200} and {k}"])
        assert b.held <= 5000 + 5000 and len(b.memory) < 40


def test_decode_of_partial_characters(library):
    some = library.encode("日本語é", add_special_tokens=False).ids
    for cut in range(len(some)):
        assert bpe.tokenizer(FILE).decode(np.array(some[cut:], "<u4").tobytes()) == library.decode(some[cut:], skip_special_tokens=False)


def test_documents(spark, library):
    rows = [(i, t, "x") for i, t in enumerate(TEXTS)] + [(99, None, "x"), (99, None, "x"), (None, "word " * 30000, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    got = {(r["doc_id"], r["n_tokens"], r["ids_sha256"], r["decoded_sha256"], tuple(r["ids"])) for r in bpe.encode_documents(df, FILE).collect()}
    want = set()
    for i, t, _ in rows:
        e = library.encode(t or "", add_special_tokens=False).ids
        want.add((i, len(e), hashlib.sha256(np.array(e, "<u4").tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest(), tuple(e)))
    assert got == want
    back = bpe.decode_ids(bpe.encode_documents(df, FILE), FILE)
    assert {r["doc_id"]: r["text"] for r in back.collect()}[3] == "hello world"
    assert bpe.encode_documents(df.where("false"), FILE).count() == 0


def test_words_that_come_again_stay_in_memory(monkeypatch):
    """A word of every batch is merged once, however often new words fill the memory."""
    b, learned = bpe.SegmentTreeBPE(FILE), []
    learn = b.learn
    monkeypatch.setattr(bpe, "MEMORY_BYTES", 20_000)
    monkeypatch.setattr(b, "learn", lambda words: learn([learned.append(w) or w for w in words]))
    for k in range(40):
        b.encode([" ".join(["always", *(f"x{chr(97 + k % 26)}{chr(97 + j)}{'y' * (k // 26)}" for j in range(20))])])
    assert learned.count("always") == 1 and len(learned) == 1 + 40 * 20


def test_latin_texts_are_cut_as_others():
    rng, pattern = np.random.default_rng(4), bpe.regex.compile(bpe.PATTERN)
    some = [chr(c) for c in range(256)], list(" \t\n\x0b\x0c\r\x1c\x85\xa0a1!'"), list("'stremdvl Aé9²ªº_-\x1f")
    for k in range(3000):
        text = "".join(rng.choice(some[k % 3], 12))
        assert bpe.latin_words().findall(text) == pattern.findall(text), repr(text)
