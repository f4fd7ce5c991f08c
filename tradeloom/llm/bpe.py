"""Byte-pair encoding and decoding with a contiguous rank array per word.

The vocabulary file (JSON with `vocab` and `merges`) is a parameter and is read by each worker. A text is cut into
words by the pattern that the file names (byte-level files without one have that of their library); a file of a kind
not known is refused. Each distinct word is encoded once per worker and kept in a bounded table,
so a long text costs one table look-up per word. Within a word, two parallel lists hold the parts and the rank of
each adjacent pair; the smallest rank is found by a scan, one boundary goes, and the two neighbouring ranks are
looked up anew. Words beyond `SHORT` parts use a heap over the same ranks, which gives the same result without the
quadratic scan.

Nulls encode as the empty text; the strings of special tokens in a text become their ids, as in the file's library.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SHORT = 200
TABLE_WORDS = 400_000
NO_RANK = 1 << 62
#: Fixed value: the words of byte-level files that name no pattern of their own.
BYTE_LEVEL_WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Blanks to str.split() that the pattern's \\s does not take for blanks.
ODD_BLANKS = re.compile("[\x1c-\x1f]").search


def byte_alphabet() -> list[str]:
    """The printable stand-in of each byte: itself if printable Latin-1, else the next code point from 256."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    out, spare = [""] * 256, 256
    for b in range(256):
        if b in shown:
            out[b] = chr(b)
        else:
            out[b], spare = chr(spare), spare + 1
    return out


def word_pattern(spec: dict) -> str:
    """The pattern of words that a vocabulary file names; ValueError for a file of another kind."""
    normal, cut = spec.get("normalizer") or {}, spec.get("pre_tokenizer") or {}
    steps = cut.get("pretokenizers", [cut])
    first, last = steps[0], steps[-1]
    if any("<|" not in t["content"] for t in spec.get("added_tokens", [])) or last.get("type") != "ByteLevel" or last.get("add_prefix_space"):
        raise ValueError("special tokens with <| and byte-level words are known, no others")
    if not normal and len(steps) == 1 and last.get("use_regex"):
        return BYTE_LEVEL_WORDS
    if [x.get("type") for x in normal.get("normalizers", [])] == ["NFC", "Replace", "Lowercase"] and len(steps) == 2 and first.get("type") == "Split" and first.get("invert"):
        return first["pattern"]["Regex"]
    raise ValueError("no pre-tokenisation is known for a vocabulary file of this kind")


class Bpe:
    def __init__(self, path: str, width: int = 4):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        vocab: dict[str, int] = model["vocab"]
        self.suffix: str = model.get("end_of_word_suffix") or ""
        self.tokens: list[str] = [""] * (max(vocab.values()) + 1)
        for token, i in vocab.items():
            self.tokens[i] = token
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        for token, i in self.special.items():
            self.tokens.extend([""] * (i + 1 - len(self.tokens)))
            self.tokens[i] = token
        self.merges: dict[int, int] = {}  # left id and right id -> rank and merged id
        for rank, pair in enumerate(model["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            self.merges[vocab[a] << 32 | vocab[b]] = rank << 32 | vocab[a + b]
        alphabet = byte_alphabet()
        self.first = [vocab.get(c, -1) for c in alphabet]
        self.last = [vocab.get(c + self.suffix, -1) for c in alphabet]
        self.at_specials = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None
        self.lower = spec.get("normalizer") is not None
        self.words = regex.compile(word_pattern(spec)).findall
        self.byte_decoder = (spec.get("decoder") or {}).get("type") == "ByteLevel"
        self.as_bytes = {c: b for b, c in enumerate(alphabet)}
        self.pieces: list[bytes] | None = None
        self.type = np.dtype("<u4" if width == 4 else "<u2")
        self.table: dict[str, bytes] = {}
        self.chunks: dict[str, bytes] = {}

    def merge(self, parts: list[int]) -> list[int]:
        """Scan, delete a boundary, refresh the ranks on both sides."""
        rank_of, none = self.merges.get, NO_RANK
        if len(parts) > SHORT:
            return self.merge_long(parts)
        ranks = [rank_of(a << 32 | b, none) for a, b in zip(parts, parts[1:])]
        while ranks:
            best = min(ranks)
            if best == none:
                break
            i = ranks.index(best)
            parts[i] = best & 0xFFFFFFFF
            del parts[i + 1], ranks[i]
            if i:
                ranks[i - 1] = rank_of(parts[i - 1] << 32 | parts[i], none)
            if i < len(ranks):
                ranks[i] = rank_of(parts[i] << 32 | parts[i + 1], none)
        return parts

    def merge_long(self, parts: list[int]) -> list[int]:
        rank_of, n = self.merges.get, len(parts)
        after, before, gone = list(range(1, n + 1)), list(range(-1, n - 1)), bytearray(n)
        heap = [(r, i, a << 32 | b) for i, (a, b) in enumerate(zip(parts, parts[1:])) if (r := rank_of(a << 32 | b)) is not None]
        heapq.heapify(heap)
        while heap:
            best, i, pair = heapq.heappop(heap)
            j = after[i]
            if gone[i] or j >= n or parts[i] << 32 | parts[j] != pair:
                continue
            parts[i], gone[j] = best & 0xFFFFFFFF, 1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
            for left, right in ((before[i], i), (i, k)):
                if left >= 0 and right < n and (r := rank_of(parts[left] << 32 | parts[right])) is not None:
                    heapq.heappush(heap, (r, left, parts[left] << 32 | parts[right]))
        return [p for p, x in zip(parts, gone) if not x]

    def word(self, word: str) -> bytes:
        raw = word.encode("utf-8", "surrogatepass")
        parts = [self.first[b] for b in raw[:-1]] + [self.last[raw[-1]]]
        out = np.array(self.merge([p for p in parts if p >= 0]), self.type).tobytes()
        if len(self.table) >= TABLE_WORDS:
            self.table.clear()
        self.table[word] = out
        return out

    def chunk(self, chunk: str) -> bytes:
        """A stretch between blanks, which no word crosses: encode its words and remember it."""
        got, new = self.table.get, self.word
        out = b"".join([got(w) or new(w) for w in self.words(chunk)])
        if len(self.chunks) >= TABLE_WORDS:
            self.chunks.clear()
        self.chunks[chunk] = out
        return out

    def plain(self, text: str) -> bytes:
        if self.lower:
            if not text.isascii():
                text = unicodedata.normalize("NFC", text).replace("Σ", "σ")  # letter by letter: no final form
            text = text.lower()
            whole, chunks = ODD_BLANKS(text), None
            if not whole:
                chunks = text.split()
        elif not (whole := "  " in text or text[-1:] == " "):
            first, *rest = text.split(" ")
            chunks = [first, *[" " + x for x in rest]] if rest else [first]
        if whole:
            got, new = self.table.get, self.word
            return b"".join([got(w) or new(w) for w in self.words(text)])
        got, new = self.chunks.get, self.chunk
        return b"".join([x if (x := got(c)) is not None else new(c) for c in chunks])

    def encode(self, text: str | None) -> bytes:
        """Ids of a whole text, as little-endian unsigned integers of the chosen width."""
        if not text:
            return b""
        if "<|" not in text or self.at_specials is None:
            return self.plain(text)
        return b"".join(self.type.type(self.special[x]).tobytes() if x in self.special else self.plain(x) for x in self.at_specials.split(text) if x)

    def decode(self, ids: np.ndarray) -> str:
        if not self.byte_decoder:
            return " ".join(map(self.tokens.__getitem__, ids.tolist()))
        if self.pieces is None:
            special = set(self.special.values())
            self.pieces = [t.encode() if i in special else bytes(map(self.as_bytes.__getitem__, t)) for i, t in enumerate(self.tokens)]
        return b"".join(map(self.pieces.__getitem__, ids.tolist())).decode("utf-8", "replace")


@lru_cache(4)
def load(path: str, width: int = 4) -> Bpe:
    return Bpe(path, width)


def encode_decode(docs: DataFrame, tokenizer: str, text: str = "text", keep: tuple[str, ...] = (), ids: bool = True) -> DataFrame:
    """Per row: the columns `keep`, ids array<int> (if asked for), n_tokens, ids_sha256, decoded_sha256.

    A narrow map: no shuffle. Null and empty texts have no ids; repeated rows give repeated rows.
    """
    kept = docs.select(*[F.col(f"`{k}`") for k in keep], F.col(f"`{text}`").cast("string").alias("__text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(tokenizer)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                out: list[list] = [[], [], [], []]
                for text in part.column(part.num_columns - 1):
                    raw = bpe.encode(text.as_py())
                    values = np.frombuffer(raw, "<u4")
                    out[0].append(values.astype(np.int32) if ids else None)
                    out[1].append(len(values))
                    out[2].append(hashlib.sha256(raw).hexdigest())
                    out[3].append(hashlib.sha256(bpe.decode(values).encode("utf-8", "surrogatepass")).hexdigest())
                columns = [*part.columns[:-1]] + [pa.array(out[0], pa.list_(pa.int32()))] * ids + [pa.array(out[1], pa.int64()), pa.array(out[2], pa.string()), pa.array(out[3], pa.string())]
                yield pa.RecordBatch.from_arrays(columns, names)

    names = [*keep] + ["ids"] * ids + ["n_tokens", "ids_sha256", "decoded_sha256"]
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields[:-1]] + ["ids array<int>"] * ids + ["n_tokens bigint", "ids_sha256 string", "decoded_sha256 string"])
    return kept.mapInArrow(run, schema)


def op2(docs: DataFrame, tokenizer: str) -> DataFrame:
    return encode_decode(docs, tokenizer, keep=("doc_id",), ids=False)
