"""SentencePiece encoding and decoding over a trie of marked words.

A text is cut into marked words (a word with the mark of the space before it), and every distinct word is encoded once.
Distinct words are sorted, which lays them out as a trie in depth-first order: a word keeps the forward table of the
longest prefix that it shares with the word before, and extends it by its own letters only.

The vocabulary given is a byte-pair one, and its segmentation is not the one of the largest summed score, so a plain
Viterbi would give other pieces than the tokenizer does. The forward table therefore holds, for every position, the
last piece of the encoding of the prefix up to there. It is found as in Viterbi, from the entries of shorter prefixes:
it is the one piece that ends there and may follow the last piece of the prefix before it. Two pieces may follow each
other if no merge across their border comes before the merges that make them. The result equals the tokenizer's.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from array import array
from collections.abc import Iterable, Iterator
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sondera.llm.common import table

MODEL = "piece_bpe_32k.model"
MARK = "▁"
#: Characters whose words are encoded together, and distinct words that a worker remembers, twice: of late and before.
SLICE, MEMORY = 1 << 20, 200_000
#: Rows that a task hands on at a time.
ROWS = 256
_NEVER = 1 << 40


class Codec:
    """Encodes and decodes with one model file. Holds plain tables only; loaded once in each worker."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        self.pieces = [model.id_to_piece(i) for i in range(n)]
        byte_ids = [i for i in range(n) if model.is_byte(i)]
        plain = [i for i in range(n) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))]
        self.byte_of = {int(self.pieces[i][3:-1], 16): i for i in byte_ids}
        self.id_of = {self.pieces[i]: i for i in plain}
        order = sorted(plain, key=lambda i: -model.get_score(i))
        self.rank, last = {}, None  # equal scores share a rank: the leftmost merge is made first
        for place, i in enumerate(order):
            if last is None or model.get_score(i) != last[0]:
                last = (model.get_score(i), place)
            self.rank[i] = last[1]
        letters = {c for p in self.id_of for c in p}
        alone = "".join(re.escape(c) for c in "\n\t\r" if c not in letters)
        self.units = re.compile(f"{MARK}+[^{MARK}{alone}]*|[{alone}]|[^{MARK}{alone}]+" if alone else f"{MARK}+[^{MARK}]*|[^{MARK}]+")
        if any(MARK in p.lstrip(MARK) for p in self.id_of):
            raise ValueError("a piece goes on over a space: words can't be encoded singly")
        self.lengths = list(map(len, self.pieces))
        self.text_of = [b""] * n
        for i in plain:
            self.text_of[i] = self.pieces[i].replace(MARK, " ").encode()
        for value, i in self.byte_of.items():
            self.text_of[i] = bytes([value])
        self.parts: dict[int, tuple[int, int]] = {}
        self.usable: dict[str, int] = {}
        for piece, i in self.id_of.items():
            made = self._merge(piece)
            if len(made[0]) == 1 and made[0][0] == i:
                self.usable[piece] = i
                if made[1]:
                    self.parts[i] = made[1]
        self.follows: list[dict[int, bool]] = [{} for _ in self.pieces]
        self.memory: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self._build_automaton()

    def _merge(self, unit: str) -> tuple[list[int], tuple[int, int] | None]:
        """Pieces of a unit by making merges one by one, best rank first, then leftmost; and the parts of the last merge.

        A letter outside the vocabulary is its code point below zero.
        """
        symbols: list[str | None] = list(unit)
        after, before, last = list(range(1, len(unit) + 1)), list(range(-1, len(unit) - 1)), None
        heap: list[tuple[int, int, int, str]] = []

        def offer(a: int) -> None:
            b = after[a] if a >= 0 else len(symbols)
            if a >= 0 and b < len(symbols):
                made = symbols[a] + symbols[b]
                if (i := self.id_of.get(made)) is not None:
                    heapq.heappush(heap, (self.rank[i], a, b, made))

        for a in range(len(unit) - 1):
            offer(a)
        while heap:
            _, a, b, made = heapq.heappop(heap)
            if symbols[a] is None or after[a] != b or symbols[b] is None or symbols[a] + symbols[b] != made:
                continue
            last = (self.id_of.get(symbols[a], -1), self.id_of.get(symbols[b], -1))
            symbols[a], symbols[b] = made, None
            after[a] = after[b]
            if after[b] < len(symbols):
                before[after[b]] = a
            offer(before[a])
            offer(a)
        return [self.id_of.get(s, -ord(s[0]) - 1) for s in symbols if s is not None], last

    def may_follow(self, a: int, b: int) -> bool:
        """Whether piece ``b`` may stand behind ``a``: no merge over their border comes before those within them."""
        if a < 0 or b < 0:
            return True
        known = self.follows[b].get(a)
        if known is None:
            known = self.follows[b][a] = self._may_follow(a, b)
        return known

    def _spine(self, piece: int, side: int) -> list[int]:
        """What stood at the border of a piece while it was made, from a single letter to the piece."""
        out = [piece]
        while (parts := self.parts.get(out[-1])) is not None:
            out.append(parts[side])
        return out[::-1]

    def _may_follow(self, a: int, b: int) -> bool:
        left, right, i, j = self._spine(a, 1), self._spine(b, 0), 0, 0
        while True:
            next_a = self.rank[left[i + 1]] if i + 1 < len(left) else _NEVER
            next_b = self.rank[right[j + 1]] if j + 1 < len(right) else _NEVER
            over = self.id_of.get(self.pieces[left[i]] + self.pieces[right[j]])
            at = self.rank[over] if over is not None else _NEVER
            if at < next_a and at <= next_b and at != _NEVER:
                return False
            if next_a == _NEVER and next_b == _NEVER:
                return True
            if next_a <= next_b:
                i += 1
            else:
                j += 1

    def _build_automaton(self) -> None:
        """An automaton over letters whose states know all pieces that end there, the longest first."""
        self.step: list[dict[str, int]] = [{}]
        self.ends: list[tuple[tuple[int, int], ...]] = [()]
        own: list[tuple[tuple[int, int], ...]] = [()]
        for piece, i in self.usable.items():
            state = 0
            for c in piece:
                if c not in self.step[state]:
                    self.step[state][c] = len(self.step)
                    self.step.append({})
                    own.append(())
                state = self.step[state][c]
            own[state] = ((len(piece), i),)
        self.back = [0] * len(self.step)
        self.ends = list(own)
        level = list(self.step[0].values())
        while level:
            deeper = []
            for state in level:
                for c, to in self.step[state].items():
                    at = self.back[state]
                    while at and c not in self.step[at]:
                        at = self.back[at]
                    self.back[to] = self.step[at].get(c, 0)
                    self.ends[to] = own[to] + self.ends[self.back[to]]
                    deeper.append(to)
            level = deeper
        self.known_steps: list[dict[str, int]] = [dict(s) for s in self.step]
        # a letter that is a piece by itself needs no test once all longer pieces have failed: one of them always fits
        self.letter = [e[-1][1] if e and e[-1][0] == 1 else -1 for e in self.ends]
        self.longer = [e[:-1] if x >= 0 else e for e, x in zip(self.ends, self.letter)]

    def _step(self, state: int, c: str) -> int:
        at = state
        while at and c not in self.step[at]:
            at = self.back[at]
        to = self.known_steps[state][c] = self.step[at].get(c, 0)
        return to

    def encode_words(self, words: Iterable[str]) -> dict[str, list[int]]:
        """The pieces of distinct words, visited in sorted order: shared prefixes are gone through once."""
        out: dict[str, list[int]] = {}
        before, last, states = "", [0], [0]  # of each prefix length: its last piece, and the automaton's state
        longer, letter, known_steps, follows, twice = self.longer, self.letter, self.known_steps, self.follows, MARK + MARK
        lengths = self.lengths
        for word in sorted(words):
            if word.startswith(twice):  # runs of spaces share one rank: merged step by step
                out[word] = self._merge(word)[0]
                continue
            if word.startswith(before):
                same = len(before)
            else:
                same, most = 0, min(len(word), len(before))
                while same < most and word[same] == before[same]:
                    same += 1
                del last[same + 1 :], states[same + 1 :]
            state, end = states[same], same
            for c in word[same:]:
                end += 1
                try:
                    state = known_steps[state][c]
                except KeyError:
                    state = self._step(state, c)
                for length, piece in longer[state]:
                    if length == end or (left := last[end - length]) < 0:
                        break
                    fits = follows[piece].get(left)
                    if self.may_follow(left, piece) if fits is None else fits:
                        break
                else:
                    piece = letter[state]
                    if piece < 0:
                        piece = -ord(c) - 1
                last.append(piece)
                states.append(state)
            before, found = word, []
            while end:
                piece = last[end]
                found.append(piece)
                end -= lengths[piece] if piece >= 0 else 1
            found.reverse()
            out[word] = found
        return out

    def _known(self, words: Iterable[str]) -> None:
        """See to it that the memory holds all of ``words``. When it is full, what was not used of late is let go."""
        new = set(words).difference(self.memory)
        if not new:
            return
        if len(self.memory) + len(new) > MEMORY:
            self.memory, self.older = {}, self.memory
            new = set(words)
        for word in new.intersection(self.older):
            self.memory[word] = self.older[word]
        for word, ids in self.encode_words(new.difference(self.older)).items():
            if min(ids) < 0:  # letters outside the vocabulary are spelled in bytes
                ids = [x for i in ids for x in ([i] if i >= 0 else [self.byte_of[b] for b in chr(-i - 1).encode()])]
            self.memory[word] = array("i", ids).tobytes()

    def _slices(self, text: str) -> Iterator[list[str]]:
        """Marked words of a whole text, some ten thousand at a time; no word is cut."""
        marked = MARK + text.replace(" ", MARK)
        at = 0
        while at < len(marked):
            to = at + SLICE
            while to < len(marked) and (to := marked.find(MARK, to)) >= 0 and marked[to - 1] == MARK:
                to += 1
            to = len(marked) if to < 0 else to
            yield self.units.findall(marked, at, to)
            at = to

    def _joined(self, words: list[str]) -> bytes:
        try:
            return b"".join(map(self.memory.__getitem__, words))
        except KeyError:
            self._known(words)
            return b"".join(map(self.memory.__getitem__, words))

    def encode(self, texts: Iterable[str | None]) -> Iterator[np.ndarray]:
        """Piece ids of whole texts, in order; null and empty texts have none.

        The words of several short texts are gone through together, in one trie; a long text by itself, slice by slice.
        """
        group: list[list[str]] = []
        size = 0

        def done() -> Iterator[np.ndarray]:
            self._known(set().union(*group))
            yield from (np.frombuffer(self._joined(words), np.int32) for words in group)
            group.clear()

        for text in texts:
            if text and len(text) > SLICE:
                yield from done()
                yield np.frombuffer(b"".join(map(self._joined, self._slices(text))), np.int32)
                continue
            group.append([w for words in self._slices(text) for w in words] if text else [])
            size += len(text or "")
            if size > SLICE:
                yield from done()
                size = 0
        yield from done()

    def decode(self, ids: Iterable[int]) -> str:
        """The text of piece ids: marks are spaces, and the first word's mark is taken off."""
        return b"".join(map(self.text_of.__getitem__, ids)).removeprefix(b" ").decode("utf-8", "replace")


@cache
def codec(model: str = MODEL) -> Codec:
    import os

    import public_tokenizers

    return Codec(model if os.path.isabs(model) else public_tokenizers.path(model))


def decoder(model: str = MODEL) -> Column:
    """A column function: text of an array of piece ids."""

    @F.pandas_udf("string")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = codec(model)
        for batch in batches:
            yield pd.Series([None if ids is None else own.decode(ids.tolist()) for ids in batch], dtype="object")

    return of


def _coded(docs: DataFrame, text: str, model: str, checked: bool) -> DataFrame:
    """``docs`` with piece_ids, and if ``checked`` with the digest of the decoded text and whether it is the text.

    Tasks hand rows on in small blocks, so that neither they nor the executor hold the ids of many documents at once.
    """
    new = [("piece_ids", pa.list_(pa.int32())), *([("decoded_sha256", pa.string()), ("round_trip", pa.bool_())] if checked else [])]
    kept = docs.drop(*(n for n, _ in new))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(model)
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                texts = part.column(text).to_pylist()
                ids = list(own.encode(texts))
                ends = np.concatenate(([0], np.cumsum([len(x) for x in ids]))).astype(np.int32)
                found = [pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(ids) if ids else np.zeros(0, np.int32)))]
                if checked:
                    decoded = [own.decode(x.tolist()) for x in ids]
                    found.append(pa.array([hashlib.sha256(t.encode()).hexdigest() for t in decoded]))
                    found.append(pa.array([t == (g or "").replace(MARK, " ") for t, g in zip(decoded, texts)]))
                yield pa.RecordBatch.from_arrays([*part.columns, *found], [*part.schema.names, *(n for n, _ in new)])

    types = {"piece_ids": T.ArrayType(T.IntegerType()), "decoded_sha256": T.StringType(), "round_trip": T.BooleanType()}
    schema = T.StructType([*kept.schema.fields, *(T.StructField(name, types[name]) for name, _ in new)])
    return kept.mapInArrow(run, schema).withColumn("n_pieces", F.size("piece_ids").cast("long"))


def encode(docs: DataFrame, text: str = "text", model: str = MODEL) -> DataFrame:
    """``docs`` with piece_ids (array<int>) and n_pieces. A null or empty text has none. Rows are independent.

    Texts are encoded whole. Columns of those names are replaced.
    """
    return _coded(docs, text, model, checked=False)


def round_trip(docs: DataFrame, text: str = "text", model: str = MODEL) -> DataFrame:
    """As ``encode``, and decoded in the same pass: decoded_sha256 and round_trip (whether decoding gives the text again)."""
    return _coded(docs, text, model, checked=True)


def decode(docs: DataFrame, ids: str = "piece_ids", model: str = MODEL) -> DataFrame:
    """``docs`` with decoded, the text of ``ids``: null for null, empty for none. A mark in the original reads as a space."""
    return docs.withColumn("decoded", decoder(model)(ids))


def op7_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = round_trip(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_pieces", "piece_ids", "decoded_sha256", "round_trip")
