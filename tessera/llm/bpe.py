"""Encoding with a public byte-level BPE vocabulary (p8).

Exact BPE without running the merge loop over each text. A sequence of vocabulary tokens is the BPE result of its bytes
exactly if every two neighbours are the BPE result of *their* bytes. So an encoder may take the longest token at each
position, found by an Aho-Corasick automaton over the bytes written as Latin-1 characters, and step back to a shorter one
whenever a pair of neighbours turns out incompatible. Pair verdicts and encoded pre-tokens are memoised per worker.
"""

from __future__ import annotations

import base64
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Entries kept in a worker's memo of encoded pre-tokens before it starts afresh; bounds memory, never results.
MEMO = 400_000


def load_ranks(data: bytes) -> dict[bytes, int]:
    """Token bytes -> id, which is also the merge rank."""
    ranks = {}
    for line in data.splitlines():
        if line.strip():
            token, rank = line.split()
            ranks[base64.b64decode(token)] = int(rank)
    return ranks


def pretoken_patterns():
    """The splitting pattern of the byte-level vocabularies in terms of Python's re: for texts without other numbers, for texts with them, and those numbers.

    Python's word class counts numbers that are no decimal digits (such as fractions) among the letters; the second pattern parts them.
    """
    import re
    import sys

    others = frozenset(chr(c) for c in range(sys.maxunicode + 1) if unicodedata.category(chr(c)) in ("No", "Nl"))
    rest = "".join(re.escape(c) for c in sorted(others))
    form = r" ?{letter}+| ?{number}+|'(?:[stmd]|re|ve|ll)| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+"
    plain = form.replace("{letter}", r"[^\W\d_]").replace("{number}", r"\d")
    full = form.replace("{letter}", rf"[^\W\d_{rest}]").replace("{number}", rf"[\d{rest}]")
    return re.compile(plain), re.compile(full), others


class Encoder:
    """Encodes pre-tokens by backtracking over longest matches."""

    def __init__(self, ranks: dict[bytes, int]):
        import ahocorasick

        self.ranks = ranks
        self.bytes_of = {i: t for t, i in ranks.items()}
        self.automaton = ahocorasick.Automaton()
        for token, rank in ranks.items():
            self.automaton.add_word(token.decode("latin-1"), (len(token), rank))
        self.automaton.make_automaton()
        self.plain, self.full, self.numbers = pretoken_patterns()
        self.pairs: dict[tuple[int, int], bool] = {}
        self.words: dict[str, bytes] = {}

    def merge(self, data: bytes) -> list[int]:
        """The definition: merge the pair of lowest rank until none is left."""
        parts = [data[i : i + 1] for i in range(len(data))]
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                rank = self.ranks.get(parts[i] + parts[i + 1])
                if rank is not None and (best is None or rank < best):
                    best, at = rank, i
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [self.ranks[p] for p in parts]

    def compatible(self, left: int, right: int) -> bool:
        """Whether BPE leaves these two tokens as they are when they stand together."""
        key = (left, right)
        known = self.pairs.get(key)
        if known is None:
            if len(self.pairs) > 4 * MEMO:
                self.pairs.clear()
            known = self.pairs[key] = self.merge(self.bytes_of[left] + self.bytes_of[right]) == [left, right]
        return known

    def encode_word(self, word: str) -> list[int]:
        """Token ids of one pre-token."""
        data = word.encode("utf-8")
        whole = self.ranks.get(data)
        if whole is not None:
            return [whole]
        size = len(data)
        at_start: list[list[tuple[int, int]]] = [[] for _ in range(size)]
        for end, (length, rank) in self.automaton.iter(data.decode("latin-1")):
            at_start[end - length + 1].append((length, rank))
        for found in at_start:
            found.sort(reverse=True)
        # dead[i]: no compatible continuation exists from byte i after the token that was tried there
        out: list[int] = []
        choice: list[int] = []
        starts: list[int] = []
        dead: set[tuple[int, int]] = set()
        position, pick = 0, 0
        while position < size:
            options = at_start[position]
            previous = out[-1] if out else -1
            while pick < len(options):
                length, rank = options[pick]
                if (position, rank) not in dead and (previous < 0 or self.compatible(previous, rank)):
                    break
                pick += 1
            if pick < len(options):
                out.append(options[pick][1])
                choice.append(pick)
                starts.append(position)
                position += options[pick][0]
                pick = 0
            else:  # step back: the last token leads nowhere
                if not out:
                    return self.merge(data)
                position, last = starts.pop(), out.pop()
                dead.add((position, last))
                pick = choice.pop() + 1
        return out

    def encode_packed(self, text: str) -> bytes:
        """Ids of a text as packed int32."""
        words = self.words
        parts = (self.plain if self.numbers.isdisjoint(text) else self.full).findall(text)
        try:
            return b"".join([words[p] for p in parts])
        except KeyError:
            if len(words) > MEMO:
                words.clear()
            for p in parts:
                if p not in words:
                    words[p] = np.array(self.encode_word(p), dtype=np.int32).tobytes()
            return b"".join([words[p] for p in parts])


_ENCODERS: dict[int, Encoder] = {}


def worker_encoder(data: bytes) -> Encoder:
    """One encoder per worker process and vocabulary."""
    key = hash(data)
    if key not in _ENCODERS:
        _ENCODERS[key] = Encoder(load_ranks(data))
    return _ENCODERS[key]


def _vocabulary(df: DataFrame, path: str):
    with open(path, "rb") as f:
        return df.sparkSession.sparkContext.broadcast(f.read())  # under 1 MB, fixed


def encode(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """(id, ids ARRAY<INT>) of every row. Null and empty texts give an empty list; strings that look like special tokens are ordinary text.

    Repeated rows are encoded each; an empty table gives an empty table; other columns are not carried along.
    """
    shared = _vocabulary(df, vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = worker_encoder(shared.value)
        for batch in batches:
            for start in range(0, batch.num_rows, 1000):
                part = batch.slice(start, 1000)
                packed = [encoder.encode_packed(t) if t else b"" for t in part.column(1).to_pylist()]
                offsets = np.zeros(len(packed) + 1, dtype=np.int32)
                np.cumsum([len(p) >> 2 for p in packed], out=offsets[1:])
                values = pa.array(np.frombuffer(b"".join(packed), dtype=np.int32), type=pa.int32())
                ids = pa.ListArray.from_arrays(pa.array(offsets, type=pa.int32()), values)
                yield pa.RecordBatch.from_arrays([part.column(0), ids], names=["id", "ids"])

    kind = dict(df.dtypes)[id_col]
    narrow = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return narrow.mapInArrow(run, f"id {kind}, ids array<int>").withColumnRenamed("id", id_col)


def count_tokens(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """(id, tokens INT) of every row; null and empty texts have 0."""
    shared = _vocabulary(df, vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = worker_encoder(shared.value)
        for batch in batches:
            sizes = [len(encoder.encode_packed(t)) >> 2 if t else 0 for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, type=pa.int32())], names=["id", "tokens"])

    kind = dict(df.dtypes)[id_col]
    narrow = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return narrow.mapInArrow(run, f"id {kind}, tokens int").withColumnRenamed("id", id_col)
