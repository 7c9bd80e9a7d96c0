"""Byte-level BPE encoding and decoding with the tokenizers library.

The vocabulary is a rank file (base64 token, rank).  Ranks become a BPE
model of the tokenizers library: bytes map to printable characters by the
usual byte table, and every split of a token into two tokens is a merge
with the token's rank, as rank order defines.  Pre-tokens (matches of the
published pattern) are encoded separately.  Texts are cut where a single
space starts a word - always a pattern boundary - and the pieces' ids
are remembered, so that a frequent word is encoded once per worker.
Decoding reverses the byte table; ids that cut a character give its bytes,
and the decoded text marks an unfinished character with U+FFFD.

Cases: a null text is an empty one (no ids); texts of any length are encoded
whole; strings that look like special tokens are ordinary text.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import re
from array import array

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tractus.llm.common import Memory, id_text, map_slices

#: Pieces remembered per worker and generation.
MEMORY = 250_000
#: Longest text handed to the library at once when it isn't cut into words.
SEGMENT = 1 << 16

_L, _N = "a-zA-Zªµºß-öø-ɏÀ-ÖØ-Þ", "0-9²³¹¼-¾"
#: Any character outside the range where the pattern's classes are spelled
#: out here, or white space next to a space: such texts take the library's own
#: pre-tokenizer.
_SLOW = re.compile(r"[^\t\n\r\x20-\x7e\xa1-\xac\xae-ɏ]| \s|\s ")
_PIECES = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{_L}]+| ?[{_N}]+| ?[^\s{_L}{_N}]+|\s+(?!\S)|\s+")


def default_ranks() -> str:
    import public_tokenizers
    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def byte_table() -> list[str]:
    """The printable character of each byte: printable Latin-1 bytes stand
    for themselves, the others follow from U+0100 on in byte order."""
    printable = set(range(33, 127)) | set(range(161, 173)) | set(range(174, 256))
    free = iter(range(256, 512))
    return [chr(b if b in printable else next(free)) for b in range(256)]


class ByteBPE:
    def __init__(self, path: str):
        import public_tokenizers
        from tokenizers import Regex, Tokenizer, models, pre_tokenizers
        with open(path, "rb") as f:
            ranks = {base64.b64decode(t): int(r) for t, r in (line.split() for line in f if line.strip())}
        chars = byte_table()
        show = lambda token: "".join(chars[b] for b in token)
        merges = [(rank, at, token) for token, rank in ranks.items() for at in range(1, len(token))
                  if token[:at] in ranks and token[at:] in ranks]
        merges.sort()
        model = lambda: models.BPE(vocab={show(t): r for t, r in ranks.items()},
                                   merges=[(show(t[:at]), show(t[at:])) for _, at, t in merges], ignore_merges=True)
        self._model = model()
        self._whole = Tokenizer(self._model)
        self._whole.pre_tokenizer = pre_tokenizers.Sequence([
            pre_tokenizers.Split(Regex(public_tokenizers.PATTERN), behavior="isolated"),
            pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        self._table = str.maketrans({chr(b): c for b, c in enumerate(chars)})
        back = {c: b for b, c in enumerate(chars)}
        self._bytes = {r: bytes(back[c] for c in show(t)) for t, r in ranks.items()}
        self._piece = Memory(self._encode_piece, MEMORY // 4)
        self._word = Memory(self._encode_word, MEMORY)

    def _encode_piece(self, piece: str) -> bytes:
        s = piece.encode("utf-8").decode("latin-1").translate(self._table)
        return array("I", [t.id for t in self._model.tokenize(s)]).tobytes()

    def _encode_word(self, word: str) -> bytes:
        """A word and the space before it; a word of letters is one piece."""
        if word.isascii() and word.isalpha():
            return self._encode_piece(" " + word)
        return self._encode_words(" " + word)

    def _encode_words(self, text: str) -> bytes:
        word, piece = self._word, self._piece
        return b"".join(word[p[1:]] if p[0] == " " and p[1:].isalpha() and p.isascii() else piece[p]
                        for p in _PIECES.findall(text))

    def _encode_whole(self, text: str) -> bytes:
        out = []
        while text:
            cut = len(text)
            if cut > SEGMENT:
                m = re.compile(r"\S(?= \S)").search(text, SEGMENT)
                cut = m.end() if m else cut
            out.append(np.array(self._whole.encode(text[:cut], add_special_tokens=False).ids, dtype="<u4").tobytes())
            text = text[cut:]
        return b"".join(out)

    def encode_bytes(self, text: str) -> bytes:
        """The ids as little-endian unsigned 32-bit integers."""
        if not text:
            return b""
        if _SLOW.search(text):
            return self._encode_whole(text)
        first, *rest = text.split(" ")
        return self._encode_words(first) + b"".join(map(self._word.__getitem__, rest))

    def encode(self, text: str) -> np.ndarray:
        return np.frombuffer(self.encode_bytes(text), dtype="<u4")

    def token_bytes(self, ids) -> bytes:
        return b"".join(map(self._bytes.__getitem__, ids))

    def decode(self, ids) -> str:
        """Text of the ids; a character whose bytes are not all there is U+FFFD."""
        return self.token_bytes(ids).decode("utf-8", "replace")

    def offsets(self, text: str, ids) -> tuple[np.ndarray, np.ndarray]:
        """Code points that each token covers (end exclusive); tokens that
        split a character cover it each."""
        if not len(ids):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        raw = np.frombuffer(text.encode("utf-8"), dtype=np.uint8)
        char = np.cumsum((raw & 0xC0) != 0x80) - 1
        ends = np.cumsum([len(self._bytes[i]) for i in ids])
        starts = np.concatenate([[0], ends[:-1]])
        return char[starts], char[ends - 1] + 1


@functools.lru_cache(maxsize=2)
def codec(path: str) -> ByteBPE:
    """One codec per worker process and rank file."""
    return ByteBPE(path)


def encode(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, ids, starts, ends): ids of every whole text and the code
    points each covers."""
    def run(b):
        c, out = codec(path), {"doc_id": b.column(0), "ids": [], "starts": [], "ends": []}
        for t in b.column(1):
            ids = c.encode(t.as_py()).tolist()
            s, e = c.offsets(t.as_py(), ids)
            out["ids"].append(ids)
            out["starts"].append(s.tolist())
            out["ends"].append(e.tolist())
        return out
    return map_slices(id_text(docs), run, "doc_id long, ids array<int>, starts array<int>, ends array<int>", rows=64)


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """(doc_id, bytes, text) of id lists (null: none); ids outside the
    vocabulary are an error."""
    def run(b):
        c = codec(path)
        raw = [c.token_bytes(ids or []) for ids in b.column(1).to_pylist()]
        return {"doc_id": b.column(0), "bytes": raw, "text": [r.decode("utf-8", "replace") for r in raw]}
    return map_slices(encoded.select(F.col("doc_id").cast("long").alias("doc_id"), "ids"), run,
                      "doc_id long, bytes binary, text string", rows=64)


def digest(docs: DataFrame, path: str) -> DataFrame:
    """Encode and decode every text; the columns of the registered query."""
    def run(b):
        c, out = codec(path), {"doc_id": b.column(0), "n_tokens": [], "ids_sha256": [], "decoded_sha256": []}
        for t in b.column(1):
            raw = c.encode_bytes(t.as_py())
            out["n_tokens"].append(len(raw) // 4)
            out["ids_sha256"].append(hashlib.sha256(raw).hexdigest())
            out["decoded_sha256"].append(hashlib.sha256(c.token_bytes(np.frombuffer(raw, dtype="<u4").tolist())).hexdigest())
        return out
    return map_slices(id_text(docs), run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
