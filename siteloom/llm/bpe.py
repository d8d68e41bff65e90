"""Byte-pair encoding as a bounded-lookahead streaming transducer, and decoding as a byte-to-text state machine.

The vocabulary is a ``tokenizers`` JSON file with an end-of-word suffix, lower-casing and NFC. Its merge list alone
fixes how far to the right of each token the text can still change it (``lookaheads``): a token that has so much
text behind it is stable and leaves the transducer, whose buffer holds the rest only. Texts are read in pieces that may
end anywhere where neither normalisation nor a pattern looks across, so a word of any length needs constant memory.

Result for odd input: null and empty texts have no tokens (hash of nothing, decoded to nothing); rows that repeat are
each encoded; an empty table gives an empty result; extra columns are ignored. A run of combining marks, which
normalisation orders as a whole, is held as a whole.
"""

from __future__ import annotations

import codecs
import hashlib
import json
import re
import unicodedata
from array import array
from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from .shared import table
from .textvec import give_back

#: Symbols that the transducer takes in, at least, before it looks for stable tokens again.
STEP = 32
#: Buffers below this size look for the least rank after each merge; longer ones first make all merges of a rank.
SHORT = 48
#: Words whose tokens a worker remembers, of so many characters at most; all are forgotten when full.
REMEMBERED, LONGEST = 1 << 18, 64
#: Characters that are read of a text at once, about.
PIECE = 1 << 16

#: White space as the pre-tokeniser's ``\s`` has it. Fixed values.
_SPACE = "\\t-\\r \x85\xa0  -     　"
_SUFFIXES = "'s|'t|'re|'ve|'m|'ll|'d"
#: Letters and numbers below U+0250, where NFC changes nothing.
_LATIN_L = "a-zA-Z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-ɏ"
_LATIN_N = "0-9\xb2\xb3\xb9\xbc-\xbe"
_LATIN = re.compile(f"{_SUFFIXES}|[{_LATIN_L}]+|[{_LATIN_N}]|[^{_SPACE}{_LATIN_L}{_LATIN_N}]+")
_ANY = regex.compile(rf"{_SUFFIXES}|\p{{L}}+|\p{{N}}|[^{_SPACE}\p{{L}}\p{{N}}]+")
_BEYOND = re.compile("[^\x00-įı-ɏ]")  # U+0130 has a lower case of two characters
_CUT = re.compile(r"[ \t\n\r]")
#: Where white space is far, a piece may end before such a character: it combines with nothing before it and starts no suffix.
_STARTER = regex.compile(r"[\p{L}\p{Nd}--[\u1100-\u11ff\ua960-\ua97f\ud7b0-\ud7ff\u0130]]", regex.V1)
_LETTER, _OTHER = regex.compile(r"\p{L}"), regex.compile(r"[^\s\p{L}\p{N}]")


def byte_characters() -> list[str]:
    """The printable character that stands for each byte in the vocabulary's token strings."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out, extra = [""] * 256, 0
    for b in range(256):
        if b in plain:
            out[b] = chr(b)
        else:
            out[b] = chr(256 + extra)
            extra += 1
    return out


class Bpe:
    """Encoder and decoder of one vocabulary, from the JSON text of its file."""

    def __init__(self, source: str):
        spec = json.loads(source)
        model = spec["model"]
        self.vocab: dict[str, int] = model["vocab"]
        self.suffix: str = model["end_of_word_suffix"] or ""
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"] if t.get("special") or t["content"] not in self.vocab}
        self.special_ids = set(self.special.values())
        self.strings: dict[int, str] = {i: s for s, i in self.vocab.items()} | {i: s for s, i in self.special.items()}
        self.shift = max(self.strings).bit_length() + 1
        self.parts = [(self.vocab[a], self.vocab[b]) for a, b in merges]
        self.made = [self.vocab[a + b] for a, b in merges]
        self.rank: dict[int, int] = {}
        for r, (a, b) in enumerate(self.parts):
            self.rank.setdefault((a << self.shift) | b, r)
        chars = byte_characters()
        self.inner = [self.vocab.get(c) for c in chars]
        self.last = [self.vocab.get(c + self.suffix) for c in chars]
        self.bytes_of = {c: b for b, c in enumerate(chars)}
        self.cut_special = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.lookaheads = self.sufficient_lookaheads()
        self.lookahead = max(self.lookaheads.values(), default=0)
        self.lengths = {i: max(1, len(x.removesuffix(self.suffix) if self.suffix else x)) for i, x in self.strings.items()}
        self.known: dict[str, tuple[int, bytes]] = {}

    def sufficient_lookaheads(self) -> dict[int, int]:
        """For each token, the symbols after it beyond which no text can change it or where it ends.

        What follows reaches left only through merges that compete for a symbol, each of a later rank than the one
        to its right: rule (u, v) waits for a rule (s, x) of an earlier rank where s ends v or one of its last parts.
        One pass in rank order keeps, for each left part, the longest such reach; a token's lookahead is that of
        itself and its last parts.
        """
        size: dict[int, int] = {}
        right: dict[int, int] = {}
        reach: dict[int, int] = {}

        def along(v: int) -> int:
            most = reach.get(v, 0)
            while v in right:
                v = right[v]
                most = max(most, reach.get(v, 0))
            return most

        for (u, v), w in zip(self.parts, self.made, strict=True):
            reach[u] = max(reach.get(u, 0), size.get(v, 1) + along(v))
            size[w] = size.get(u, 1) + size.get(v, 1)
            right.setdefault(w, v)
        return {i: along(i) for i in self.strings}

    def merged(self, ids: list[int]) -> list[int]:
        """All merges of a buffer: least rank first, leftmost of equals."""
        none, shift, get = len(self.parts), self.shift, self.rank.get
        ranks = [get((a << shift) | b, none) for a, b in zip(ids, ids[1:], strict=False)]
        while ranks and (r := min(ranks)) != none:
            i = ranks.index(r)
            while True:
                ids[i : i + 2] = [self.made[r]]
                del ranks[i]
                lower = len(ranks) < SHORT
                if i:
                    ranks[i - 1] = get((ids[i - 1] << shift) | ids[i], none)
                    lower = lower or ranks[i - 1] < r
                if i < len(ranks):
                    ranks[i] = get((ids[i] << shift) | ids[i + 1], none)
                    lower = lower or ranks[i] < r
                if lower or r not in ranks[i:]:
                    break
                i = ranks.index(r, i)
        return ids

    def word(self, text: str) -> list[int]:
        """The tokens of one pre-token, through the transducer."""
        w = Word(self)
        return [*w.feed(text.encode()), *w.close()]

    def pieces(self, text: str) -> Iterator[tuple[list[str | int], bool, bool]]:
        """A text in pieces: normalised pre-tokens in order, special tokens as their ids.

        The flags say whether the first goes on with the last of the piece before, and whether the last may go on.
        """
        lo, n, before = 0, len(text), ""
        while lo < n:
            hi, open_ = self._end(text, lo)
            words: list[str | int] = []
            first = last = ""
            for part in self.cut_special.split(text[lo:hi]) if self.cut_special and self.cut_special.search(text, lo, hi) else (text[lo:hi],):
                if part in self.special:
                    words.append(self.special[part])
                    last = ""
                    continue
                if _BEYOND.search(part):
                    # Lower-casing is by character: a capital sigma has no final form here.
                    part = unicodedata.normalize("NFC", part).replace("Σ", "σ").lower()
                    words += _ANY.findall(part)
                else:
                    part = part.lower()
                    words += _LATIN.findall(part)
                if not words:
                    continue
                first, last = first or (part[:1] if not isinstance(words[0], int) else ""), part[-1:]
            yield words, bool(before and first) and any(k.match(before) and k.match(first) for k in (_LETTER, _OTHER)), open_
            before = last if open_ else ""
            lo = hi

    def _end(self, text: str, lo: int) -> tuple[int, bool]:
        """Where the piece that starts at lo ends, and whether a pre-token may go on beyond."""
        hi, n = lo + PIECE, len(text)
        if hi >= n:
            return n, False
        m = _CUT.search(text, hi - PIECE // 8, hi)
        if m:
            return m.end(), False
        reach = max(map(len, self.special), default=1)
        for m in _STARTER.finditer(text, hi):
            at = m.start()
            if "'" not in text[at - 3 : at] and not text[at - 1].isspace() and text[at - 1] != "\u0130" and not (self.cut_special and self.cut_special.search(text[at - reach + 1 : at + reach - 1])):
                return at, True
        return n, False

    def entry(self, w: str | int) -> tuple[int, bytes]:
        ids = [w] if isinstance(w, int) else self.word(w)
        out = len(ids), array("I", ids).tobytes()
        if len(self.known) >= REMEMBERED:
            self.known.clear()
        if isinstance(w, int) or len(w) <= LONGEST:
            self.known[w] = out
        return out

    def stream(self, text: str) -> Iterator[bytes]:
        """The ids of a text as little-endian unsigned 32-bit integers, in chunks, each as soon as it is stable."""
        get, entry, open_word = self.known.get, self.entry, None
        for words, goes_on, may_go_on in self.pieces(text):
            at, end = 0, len(words)
            if open_word is not None and not goes_on:
                yield array("I", open_word.close()).tobytes()
                open_word = None
            if goes_on and open_word is not None:
                yield array("I", open_word.feed(words[0].encode())).tobytes()
                at = 1
                if end > 1 or not may_go_on:
                    yield array("I", open_word.close()).tobytes()
                    open_word = None
            if may_go_on and end > at and isinstance(words[-1], str):
                end -= 1
                open_word = Word(self)
            for i in range(at, end, 4096):
                yield b"".join([(get(w) or entry(w))[1] for w in words[i : min(end, i + 4096)]])
            if end < len(words):
                yield array("I", open_word.feed(words[-1].encode())).tobytes()
        if open_word is not None:
            yield array("I", open_word.close()).tobytes()

    def encode(self, text: str) -> list[int]:
        ids = array("I")
        for chunk in self.stream(text):
            ids.frombytes(chunk)
        return ids.tolist()

    def digest(self, text: str, keep: array | None = None) -> tuple[int, str, str]:
        """Number of tokens, hash of the ids, hash of what they decode to, in constant memory.

        What is decoded are the ids that were emitted. They go to ``keep`` too, if there is one.
        """
        n, ids, decoded, decoder = 0, hashlib.sha256(), hashlib.sha256(), Decoder(self)
        for chunk in self.stream(text):
            n += len(chunk) // 4
            ids.update(chunk)
            if keep is not None:
                keep.frombytes(chunk)
            decoded.update(decoder.feed(memoryview(chunk).cast("I")).encode())
        decoded.update(decoder.close().encode())
        return n, ids.hexdigest(), decoded.hexdigest()

    def decode(self, ids: list[int]) -> str:
        """As the library's ``decode`` with special tokens."""
        d = Decoder(self)
        return d.feed(ids) + d.close()

    def text(self, ids: Iterable[int]) -> Iterator[str]:
        """Readable text, chunk by chunk: words apart by a space."""
        d = Decoder(self, readable=True)
        for i in ids:
            yield d.feed((i,))
        yield d.close()


class Word:
    """The transducer within one pre-token: bytes in, tokens out as soon as they are stable.

    What is left after a token is emitted starts at a token boundary, and what follows a boundary is encoded as if it
    stood alone; so the buffer forgets what it emitted. It looks again when it has grown by what it had, so the work
    is in proportion to the text.
    """

    def __init__(self, bpe: Bpe):
        self.bpe = bpe
        self.buffer: list[int] = []
        self.held: int | None = None  # the last byte, which is another symbol where the word ends
        self.due = STEP

    def feed(self, raw: bytes) -> list[int]:
        bpe, buffer, out = self.bpe, self.buffer, []
        inner = bpe.inner
        if self.held is not None:
            raw = bytes([self.held]) + raw
        self.held = raw[-1]
        at, end = 0, len(raw) - 1
        while at < end:
            to = min(end, at + max(1, self.due - len(buffer)))
            buffer += [inner[b] for b in raw[at:to]]
            at = to
            if len(buffer) >= self.due:
                out += self._stable()
                self.due = len(buffer) + max(STEP, len(buffer))
        return out

    def _stable(self) -> list[int]:
        bpe, cut, out = self.bpe, 0, []
        for token in bpe.merged(self.buffer.copy()):
            after = cut + bpe.lengths[token]
            if len(self.buffer) - after < bpe.lookaheads[token]:
                break
            out.append(token)
            cut = after
        del self.buffer[:cut]
        return out

    def close(self) -> list[int]:
        if self.held is None:
            return []
        self.buffer.append(self.bpe.last[self.held])
        return self.bpe.merged(self.buffer)


class Decoder:
    """The state machine from token ids to text: feed ids in chunks of any size, then close.

    A vocabulary without a decoder has each token as its string, all apart by a space: the state is whether one came
    before. Readable text comes from the bytes that the strings stand for: an incomplete character waits in the state
    for the next token, the end of a word is a space, and what is no UTF-8 becomes U+FFFD.
    """

    def __init__(self, bpe: Bpe, readable: bool = False):
        self.bpe, self.readable, self.begun = bpe, readable, False
        self.bytes = codecs.getincrementaldecoder("utf-8")("replace")

    def feed(self, ids: Sequence[int]) -> str:
        strings = self.bpe.strings
        if not self.readable:
            out = " ".join(map(strings.__getitem__, ids))
            out, self.begun = (" " + out if self.begun and len(ids) else out), self.begun or len(ids) > 0
            return out
        out, suffix, bytes_of = [], self.bpe.suffix, self.bpe.bytes_of
        for i in ids:
            s = strings[i]
            if i in self.bpe.special_ids:
                out += [self.bytes.decode(b"", True), s]
                self.bytes.reset()
                continue
            ends = bool(suffix) and s.endswith(suffix)
            out.append(self.bytes.decode(bytes([bytes_of[c] for c in (s.removesuffix(suffix) if ends else s)]), ends))
            if ends:
                out.append(" ")
        return "".join(out)

    def close(self) -> str:
        return self.bytes.decode(b"", True)


def vocabulary(path: str | None = None) -> str:
    """The JSON text of a vocabulary file, read on the driver."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("word_bpe_49k.json")
    with open(path, encoding="utf-8") as f:
        return f.read()


_LOADED: dict[str, Bpe] = {}


def _loaded(source: str) -> Bpe:
    key = hashlib.sha256(source.encode()).hexdigest()
    if key not in _LOADED:
        _LOADED.clear()
        _LOADED[key] = Bpe(source)
    return _LOADED[key]


def encode_documents(docs: DataFrame, path: str | None = None, carry: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, n_tokens, ids, ids_sha256, decoded_sha256) and the columns ``carry``: the tokens of every text, and what they decode to.

    The vocabulary is broadcast: a file of fixed size, here 1.7 MB.
    """
    held = docs.sparkSession.sparkContext.broadcast(vocabulary(path))
    schema = T.StructType([*T.StructType.fromDDL("doc_id long, n_tokens long, ids array<int>, ids_sha256 string, decoded_sha256 string").fields, *[docs.schema[c] for c in carry]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _loaded(held.value)
        for batch in batches:
            for lo in range(0, batch.num_rows, 64):
                texts = [x.as_py() or "" for x in batch.column(1).slice(lo, 64)]
                ids = [array("I") for _ in texts]
                rows = [bpe.digest(x, k) for x, k in zip(texts, ids, strict=True)]
                flat = np.frombuffer(b"".join(k.tobytes() for k in ids), np.int32)
                ids = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum([len(k) for k in ids])]).astype(np.int32)), pa.array(flat))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, 64), pa.array([r[0] for r in rows], pa.int64()), ids, pa.array([r[1] for r in rows]), pa.array([r[2] for r in rows]), *[batch.column(2 + i).slice(lo, 64) for i in range(len(carry))]], schema.names)
            del batch
        give_back()

    return docs.select("doc_id", "text", *carry).mapInArrow(run, schema)


def decode_documents(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, text): readable text of (doc_id, ids), as the vocabulary keeps it: lower-cased, words apart by a space."""
    held = encoded.sparkSession.sparkContext.broadcast(vocabulary(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _loaded(held.value)
        for batch in batches:
            for lo in range(0, batch.num_rows, 64):
                part = batch.slice(lo, 64)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(["".join(bpe.text(x.as_py() or [])) for x in part.column(1)], pa.string())], ["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def digest_documents(docs: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of every text."""
    held = docs.sparkSession.sparkContext.broadcast(vocabulary(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _loaded(held.value)
        for batch in batches:
            rows = [bpe.digest(x.as_py() or "") for x in batch.column(1)]
            n, ids, decoded = zip(*rows, strict=True) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(decoded, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest_documents(table(spark, sf_dir, "documents"))
