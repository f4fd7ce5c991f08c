"""Exact token counts of every prefix of a text, for a byte-pair model file of the sentencepiece library.

A sequence of tokens is the model's own exactly if each token is the encoding of itself and each two neighbours are the
encoding of their joined text: merges are ordered by score, then from the left, and the first merge across a boundary
would show in the pair alone. So of the tokens that end at a place one only can be the last token of the prefix up to
there, and

    count[i] = count[i - length of the last token] + 1

walks a text once, keeping the last token at each place. Letters that the model does not know are as many tokens as
they have UTF-8 bytes, and nothing merges with them. The walk starts anew where no piece of the model crosses, so a text
is cut there into words, before each run of spaces. The words of some texts are walked in sorted order, each from where
it leaves the one before, and kept in a bounded table.

The counts answer how many tokens a prefix has and which prefix fits a budget by array look-ups, without encoding again.
A model whose counts differ from this walk on `PROBES` (another algorithm or normal form) is refused.

Null texts are empty and have no tokens and no prefixes; repeated rows give repeated rows; very long texts are walked
whole (their counts take four bytes a code point); empty tables give no rows; other columns pass only if named in `keep`.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Words kept by a worker, and the longest one of which each count fits into a byte.
TABLE_WORDS, SHORT = 600_000, 60
#: Code points handed on at once (one text at least).
CHUNK = 4 << 20
NEVER = float("inf")
SPACE = "▁"  # fixed value: how the library writes a space
WORDS = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+").findall
PROBES = ("", " ", "  two  spaces ", "word", "<s>x</s><unk>", "\n\ttabs\r\n", "ａ①é é", "▁x▁", "\U0001f600 中文", "aaaaaaaaaaaaaaaaaaa", "Hello, wOrld! 0123456789", "​﻿\u0000")


class PrefixCounter:
    def __init__(self, path: str):
        library = sentencepiece.SentencePieceProcessor(model_file=path)
        ids = [i for i in range(library.get_piece_size()) if not (library.is_control(i) or library.is_unknown(i) or library.is_byte(i) or library.is_unused(i))]
        self.pieces = {library.id_to_piece(i): -library.get_score(i) for i in ids}
        self.loss = self.pieces.get
        if not set().union(*self.pieces) <= self.pieces.keys():
            raise ValueError("each letter of a piece must be a piece")
        #: end of a piece -> number of the token that it is, 0 if none
        self.kind = {p[i:]: 0 for p in self.pieces for i in range(len(p))}
        self.tokens = ["", *[p for p in self.pieces if self.merged(p) == [p]]]
        self.kind.update({p: i for i, p in enumerate(self.tokens) if i})
        self.pairs: dict[int, bool] = {}
        self.table: dict[str, bytes] = {}
        self.apart = not any(b == SPACE != a for p in self.pieces for a, b in zip(p, p[1:]))
        for probe, counts in zip(PROBES, self.counts(list(PROBES))):
            if (int(counts[-1]) if len(counts) else 0) != len(library.encode(probe)):
                raise ValueError("the model's counts differ from a byte-pair model's without normal forms")

    def cut(self, text: str) -> list[str]:
        """Words that no piece crosses."""
        if not text:
            return []
        if not self.apart:
            return [SPACE + text.replace(" ", SPACE)]
        if "  " in text or SPACE in text or text[0] == " " or text[-1] == " ":
            return WORDS(SPACE + text.replace(" ", SPACE))
        return [SPACE + w for w in text.split(" ")]

    def merged(self, text: str) -> list[str]:
        """Plain greedy merging of a short text: the best score, then the leftmost pair."""
        parts, loss = list(text), self.loss
        losses = [loss(a + b, NEVER) for a, b in zip(parts, parts[1:])]
        while losses and (best := min(losses)) != NEVER:
            i = losses.index(best)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            del losses[i]
            if i:
                losses[i - 1] = loss(parts[i - 1] + parts[i], NEVER)
            if i < len(losses):
                losses[i] = loss(parts[i] + parts[i + 1], NEVER)
        return parts

    def walk(self, words: list[str]) -> Iterator[list[int]]:
        """For each of some sorted words: tokens of word[:i] for i = 0 .. length."""
        kind, follows, tokens = self.kind.get, self.pairs.get, self.tokens
        if len(self.pairs) > 1 << 20:
            self.pairs.clear()
        count, last, before = [0], [0], ""
        for word in words:
            same = 0
            for a, b in zip(word, before):
                if a != b:
                    break
                same += 1
            del count[same + 1 :], last[same + 1 :]
            before = word
            for i in range(same + 1, len(word) + 1):
                at = i - 1
                while (token := kind(word[at:i], -1)) >= 0:
                    if token:
                        left = last[at]
                        if not left:
                            break
                        if (ok := follows(left << 20 | token)) is None:
                            a, b = tokens[left], tokens[token]
                            ok = self.pairs[left << 20 | token] = self.merged(a + b) == [a, b]
                        if ok:
                            break
                    at -= 1
                if token > 0:
                    count.append(count[at] + 1)
                    last.append(token)
                elif at == i - 1:  # a letter that the model does not know
                    count.append(count[at] + len(word[at].encode("utf-8", "surrogatepass")))
                    last.append(0)
                else:
                    raise AssertionError("no token ends here")
            yield count

    def counts(self, texts: list[str]) -> list[np.ndarray]:
        """For each text: tokens of text[:i] for i = 1 .. length."""
        cut = [self.cut(t) for t in texts]
        seen = set().union(*cut)
        table = self.table
        if len(table) + len(seen) > TABLE_WORDS:
            table.clear()
        new = sorted(w for w in seen if w not in table)
        long: dict[str, np.ndarray] = {}
        for word, count in zip(new, self.walk(new)):
            if len(word) <= SHORT:
                table[word] = bytes(count[1:])
            else:
                long[word] = np.array(count[1:], np.int32)
        return [self.joined(words, long) for words in cut]

    def joined(self, words: list[str], long: dict[str, np.ndarray]) -> np.ndarray:
        if not words:
            return np.zeros(0, np.int32)
        if long and any(len(w) > SHORT for w in words):
            parts = [np.frombuffer(self.table[w], np.uint8) if len(w) <= SHORT else long[w] for w in words]
            counts = np.concatenate(parts).astype(np.int32)
        else:
            parts = [*map(self.table.__getitem__, words)]
            counts = np.frombuffer(b"".join(parts), np.uint8).astype(np.int32)
        sizes = np.fromiter(map(len, parts), np.int64, len(parts))
        ends = counts[np.cumsum(sizes) - 1]
        return (counts + np.repeat(np.cumsum(ends, dtype=np.int32) - ends, sizes))[1:]  # the space put in front is no prefix


@lru_cache(2)
def load(path: str) -> PrefixCounter:
    return PrefixCounter(path)


def prefix_counts(docs: DataFrame, model: str, text: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """Per row: the columns `keep`, n_bytes (UTF-8), prefix_tokens array<int>: the token count of the first 1, 2, ...
    code points. A narrow map, no shuffle."""
    kept = docs.select(*[F.col(f"`{k}`") for k in keep], F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("__text"))
    names = [*keep, "n_bytes", "prefix_tokens"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = load(model)
        for batch in batches:
            texts = batch.column(batch.num_columns - 1)
            at, part, held = 0, [], 0
            for i in range(batch.num_rows):
                part.append(texts[i].as_py())
                held += len(part[-1])
                if held >= CHUNK or i + 1 == batch.num_rows:
                    counts = counter.counts(part)
                    offsets = np.zeros(len(counts) + 1, np.int32)
                    np.cumsum([len(c) for c in counts], out=offsets[1:])
                    lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(counts)))
                    sizes = pa.array([len(t) if t.isascii() else len(t.encode("utf-8", "surrogatepass")) for t in part], pa.int64())
                    yield pa.RecordBatch.from_arrays([*batch.slice(at, i + 1 - at).columns[:-1], sizes, lists], names)
                    at, part, held = i + 1, [], 0

    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields[:-1]] + ["n_bytes bigint", "prefix_tokens array<int>"])
    return kept.mapInArrow(run, schema)


def tokens_of(prefix_tokens: str | Column, n_chars: int | Column | None = None) -> Column:
    """Tokens of the first n_chars code points (of all without n_chars, or beyond the end)."""
    counts = F.col(prefix_tokens) if isinstance(prefix_tokens, str) else prefix_tokens
    whole = F.coalesce(F.try_element_at(counts, F.lit(-1)), F.lit(0))
    if n_chars is None:
        return whole.cast("bigint")
    n = F.lit(n_chars) if isinstance(n_chars, int) else n_chars
    return F.when(n <= 0, 0).when(n >= F.size(counts), whole).otherwise(F.try_element_at(counts, F.greatest(n, F.lit(1)).cast("int"))).cast("bigint")


def chars_within(prefix_tokens: str | Column, budget: int | Column) -> Column:
    """Code points of the longest prefix of at most `budget` tokens. A longer prefix can have fewer tokens, so the last
    place within the budget counts."""
    counts = F.col(prefix_tokens) if isinstance(prefix_tokens, str) else prefix_tokens
    most = F.lit(budget) if isinstance(budget, int) else budget
    last = F.array_max(F.transform(counts, lambda c, i: F.when(c <= most, i + 1).otherwise(0)))
    return F.when(tokens_of(counts) <= most, F.size(counts)).otherwise(F.coalesce(last, F.lit(0))).cast("bigint")


def op13(docs: DataFrame, model: str, limit: int = 4096) -> DataFrame:
    counted = prefix_counts(docs, model, keep=("doc_id",))
    n = tokens_of("prefix_tokens")
    return counted.select("doc_id", "n_bytes", n.alias("n_tokens"), (n > limit).alias("over_limit"), chars_within("prefix_tokens", limit).alias("chars_within_limit"))
