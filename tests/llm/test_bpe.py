import hashlib
import random
import struct

import pytest

from siteloom.llm import bpe

from .fixtures import documents, empty, rows


@pytest.fixture(scope="module")
def own():
    return bpe.Bpe(bpe.vocabulary())


@pytest.fixture(scope="module")
def library():
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    t.no_truncation()
    t.no_padding()
    return t


PIECES = ["a", "b", "é", "ß", " ", "\n", "\t", "Σ", "ς", "σ", "İ", "ı", "Å", "Ẍ", "ǅ", "½", "²", "٣", "中", "文", "\U0001f642", "‍", "\x85", "\xa0", "\x1c", "'s", "'RE", "'ll", "<|endoftext|>", "<|startoftext|>", "the", "ͅ", "́", "Ⅷ", ".", "!!", "12"]


def test_equals_the_library(own, library):
    r = random.Random(5)
    for _ in range(1500):
        text = "".join(r.choice(PIECES) for _ in range(r.randint(0, 40)))
        ids = library.encode(text, add_special_tokens=False).ids
        assert own.encode(text) == ids, text
        assert own.decode(ids) == library.decode(ids, skip_special_tokens=False)


def test_stream_equals_merging_all_at_once(own):
    r = random.Random(6)
    for k in range(100):
        word = "".join(r.choice(["in", "th", "an", "a", "e", "on", "ing", "ll", "q", "tion"]) for _ in range(r.randint(1, 900))) if k % 3 else r.choice("aehs") * r.randint(1, 3000)
        raw = word.encode()
        assert own.word(word) == own.merged([own.inner[b] for b in raw[:-1]] + [own.last[raw[-1]]])


def test_tokens_come_before_the_word_ends(own):
    """The transducer emits as it reads, not at the end of a word, and holds its lookahead at most."""
    r = random.Random(8)
    word = "".join(r.choice(["inter", "nation", "al", "iz", "ation", "counter", "revolution", "ary", "x", "qu"]) for _ in range(4000)).encode()
    w, early, held = bpe.Word(own), [], 0
    for b in word:
        early += w.feed(bytes([b]))
        held = max(held, len(w.buffer))
    assert own.lookahead == max(own.lookaheads.values()) and len(set(own.lookaheads.values())) > 10
    rest = w.close()
    assert len(early) > 9 * len(rest) and held <= 2 * (own.lookahead + max(own.lengths.values())) + bpe.STEP
    assert early + rest == own.merged([own.inner[b] for b in word[:-1]] + [own.last[word[-1]]])


def test_pieces_end_anywhere_safe(own, library, monkeypatch):
    monkeypatch.setattr(bpe, "PIECE", 16)
    r = random.Random(9)
    for k in range(600):
        pieces = [p for p in PIECES if p not in (" ", "\n", "\t")] if k % 2 else PIECES
        text = "".join(r.choice(pieces) for _ in range(r.randint(0, 120)))
        assert own.encode(text) == library.encode(text, add_special_tokens=False).ids, text


def test_constant_memory_without_spaces(own):
    """Ten megabytes without white space: what is held besides the text does not grow."""

    def resident():
        with open("/proc/self/statm") as f:
            return int(f.read().split()[1]) * 4096

    text = "中文字" * 1_165_000
    start, most, count = None, 0, 0
    for chunk in own.stream(text):
        count += len(chunk) // 4
        start = start or resident()
        most = max(most, resident())
    assert len(text.encode()) > 10_000_000 and count > 5_000_000
    assert most - start < 12 << 20


def test_text_goes_back_through_the_state_machine(own):
    for text in ("héllo wörld 中文 \U0001f642", "a b c", ""):
        ids = own.encode(text)
        assert "".join(own.text(ids)).split() == text.split()
        d, whole = bpe.Decoder(own), own.decode(ids)
        assert "".join([d.feed(ids[i : i + 2]) for i in range(0, len(ids), 2)] + [d.close()]) == whole


def test_documents(spark, library):
    out = bpe.digest_documents(documents(spark)).collect()
    assert len(out) == len(rows())
    texts = {i: t or "" for i, t, *_ in rows()}
    for r in out:
        ids = library.encode(texts[r.doc_id], add_special_tokens=False).ids
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    full = bpe.encode_documents(documents(spark)).collect()
    assert sorted((r.doc_id, r.n_tokens, r.ids_sha256) for r in full) == sorted((r.doc_id, r.n_tokens, r.ids_sha256) for r in out)
    assert all(len(r.ids) == r.n_tokens for r in full)
    back = {r.doc_id: r.text for r in bpe.decode_documents(bpe.encode_documents(documents(spark))).collect()}
    assert back[13].split() == ["one", "two", "three"] and back[10] == "" and "\U0001f642" in back[21]
    assert bpe.digest_documents(empty(spark)).collect() == []
