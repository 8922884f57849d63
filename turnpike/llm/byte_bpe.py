"""Byte-level BPE encoding and decoding with exact merges in linear time.

A token sequence is the merge result of its bytes exactly when every adjacent pair of tokens is the
merge result of the pair's bytes. So no merge loop runs over a piece: an Aho-Corasick automaton over
the vocabulary (bytes mapped to Latin-1 characters) gives the longest token at every position, and a
backtracking walk takes the longest token compatible with its left neighbour, falling back to shorter
prefix tokens and then to the previous token. Positions that turned out to be dead ends are marked, so
each position is left at most once. Compatibility of two tokens is memoised; it is decided by undoing
their merges at the border.
"""

from __future__ import annotations

import base64
import hashlib
import os
import re
from collections.abc import Callable, Iterable, Iterator
from itertools import chain

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from turnpike.llm._memory import released

#: Pieces in a generation of what one worker remembers. It bounds memory and changes no result.
PIECE_MEMORY = 150_000
#: Token pairs whose compatibility one worker remembers.
PAIR_MEMORY = 300_000
#: Bytes of a rank file at most; it goes to every executor once.
MOST_RANK_BYTES = 64 << 20
#: Longer pieces are encoded anew each time.
LONGEST_KEPT = 64
_NEVER = 1 << 60


class _Pieces(dict):
    """Ids of pieces seen before, in two generations; looks up and, at need, encodes."""

    def __init__(self, bpe: ByteBpe):
        super().__init__()
        self.bpe = bpe
        self.old: dict[str, tuple[int, ...]] = {}

    def __missing__(self, piece: str) -> tuple[int, ...]:
        if (ids := self.old.get(piece)) is None:
            ids = tuple(self.bpe.encode_piece(piece.encode("utf-8")))
        if len(piece) <= LONGEST_KEPT:
            if len(self) >= PIECE_MEMORY:
                self.old = dict(self)
                self.clear()
            self[piece] = ids
        return ids


def ascii_pattern(pattern: str) -> str:
    """The same split of ASCII text for the faster ``re`` with its ASCII flag: letters and digits are spelt out."""
    out, at, inside = [], 0, False
    while at < len(pattern):
        for name, plain in ((r"\p{L}", "a-zA-Z"), (r"\p{N}", "0-9")):
            if pattern.startswith(name, at):
                out.append(plain if inside else f"[{plain}]")
                at += len(name)
                break
        else:
            if pattern[at] == "\\":
                out.append(pattern[at : at + 2])
                at += 2
                continue
            inside = pattern[at] == "[" or (inside and pattern[at] != "]")
            out.append(pattern[at])
            at += 1
    return "".join(out)


class ByteBpe:
    """Encoder and decoder for one rank file and split pattern."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks = ranks
        self.tokens = {rank: token for token, rank in ranks.items()}
        self.split_any = regex.compile(pattern).findall
        self.split_ascii = re.compile(ascii_pattern(pattern), re.ASCII).findall
        self.pairs: dict[int, bool] = {}
        self.shorter_of: dict[int, int] = {}
        self.last_merge: dict[int, tuple[int, int] | None] = {}
        self.unreachable: dict[int, bool] = {}
        self.trie = ahocorasick.Automaton()
        for token, rank in ranks.items():
            if self.reachable(rank):
                self.trie.add_word(token.decode("latin-1"), (rank, len(token)))
        self.trie.make_automaton()
        self.pieces = _Pieces(self)

    @classmethod
    def from_bytes(cls, data: bytes, pattern: str) -> ByteBpe:
        """From the content of a rank file: a line per token, its bytes in Base64 and its rank."""
        return cls({base64.b64decode(token): int(rank) for token, rank in (line.split() for line in data.splitlines() if line.strip())}, pattern)

    @classmethod
    def from_file(cls, path: str, pattern: str) -> ByteBpe:
        with open(path, "rb") as file:
            return cls.from_bytes(file.read(), pattern)

    def halves(self, token: int) -> tuple[int, int] | None:
        """The two tokens of the last merge that makes this one from its bytes; None for a byte.

        A token that merging its own bytes doesn't reach has no halves either and is marked as such.
        """
        if token in self.last_merge:
            return self.last_merge[token]
        data, ranks = self.tokens[token], self.ranks
        parts = [data[i : i + 1] for i in range(len(data))]
        while len(parts) > 2:
            options = [ranks.get(x + y, _NEVER) for x, y in zip(parts, parts[1:], strict=False)]
            rank = min(options)
            if rank == _NEVER:
                break
            at = options.index(rank)
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        self.unreachable[token] = len(parts) > 2
        found = self.last_merge[token] = (ranks[parts[0]], ranks[parts[1]]) if len(parts) == 2 else None
        return found

    def reachable(self, token: int) -> bool:
        """Whether merging the token's own bytes gives the token."""
        if token not in self.unreachable:
            self.halves(token)
        return not self.unreachable[token]

    def compatible(self, left: int, right: int) -> bool:
        """Whether merging the bytes of both gives just these two tokens."""
        key = left << 32 | right
        if (known := self.pairs.get(key)) is None:
            if len(self.pairs) >= PAIR_MEMORY:
                self.pairs.clear()
            known = self.pairs[key] = self._keeps_border(left, right)
        return known

    def _keeps_border(self, left: int, right: int) -> bool:
        """Walk back through the merges on both sides of the border, the latest first.

        Merges happen by rising rank, at equal rank from the left. Between two steps back the border lies
        between ``left`` and ``right``; a token of both would have come first if its rank is below that of
        the merge undone last, or equal to it where that merge was on the right.
        """
        tokens, ranks, bound = self.tokens, self.ranks, _NEVER
        while True:
            if ranks.get(tokens[left] + tokens[right], _NEVER) < bound:
                return False
            x, y = self.halves(left), self.halves(right)
            if x is None and y is None:
                return True
            if y is None or (x is not None and left > right):
                bound, left = left, x[1]
            else:
                bound, right = right + 1, y[0]

    def shorter(self, token: int) -> int:
        """The longest reachable token that is a proper prefix of this one; -1: none."""
        if (known := self.shorter_of.get(token)) is None:
            data, known = self.tokens[token], -1
            for end in range(len(data) - 1, 0, -1):
                if (found := self.ranks.get(data[:end])) is not None and self.reachable(found):
                    known = found
                    break
            self.shorter_of[token] = known
        return known

    def encode_piece(self, piece: bytes) -> list[int]:
        """Ids of one match of the split pattern; a piece that is itself in the vocabulary is that token."""
        if (rank := self.ranks.get(piece)) is not None:
            return [rank]
        chars, size, out, at = piece.decode("latin-1"), len(piece), [], 0
        for end, (rank, length) in self.trie.iter_long(chars):
            if end - length + 1 != at or (out and not self.compatible(out[-1], rank)):
                break
            out.append(rank)
            at = end + 1
        if at == size:
            return out
        # The longest matches don't fit here: walk on with backtracking, from the state reached so far.
        longest = [-1] * size
        for end, (rank, length) in self.trie.iter(chars):
            longest[end - length + 1] = rank
        tokens, open_ = self.tokens, bytearray(b"\x01") * (size + 1)
        token = longest[at]
        while at < size:
            left = out[-1] if out else -1
            while token >= 0:
                end = at + len(tokens[token])
                if open_[end] and (left < 0 or self.compatible(left, token)):
                    break
                token = self.shorter(token)
            if token >= 0:
                out.append(token)
                at = end
                token = longest[at] if at < size else -1
            else:
                if not out:
                    raise ValueError("the vocabulary lacks single bytes of this text")
                open_[at] = 0
                last = out.pop()
                at -= len(tokens[last])
                token = self.shorter(last)
        return out

    def encode(self, text: str) -> list[int]:
        split = self.split_ascii if text.isascii() else self.split_any
        return list(chain.from_iterable(map(self.pieces.__getitem__, split(text))))

    def decode(self, ids: Iterable[int]) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))


_loaded: dict[tuple[str, str], ByteBpe] = {}


def _shipped(spark: SparkSession, rank_file: str, pattern: str) -> Callable[[], ByteBpe]:
    """A function that gives a Python worker its encoder, made once from the rank file that the driver broadcasts."""
    with open(rank_file, "rb") as file:
        data = file.read()
    if len(data) > MOST_RANK_BYTES:
        raise ValueError(f"the rank file holds {len(data)} bytes, over {MOST_RANK_BYTES}")
    name, held = hashlib.sha256(data).hexdigest(), spark.sparkContext.broadcast(data)

    def encoder() -> ByteBpe:
        if (name, pattern) not in _loaded:
            _loaded[name, pattern] = ByteBpe.from_bytes(held.value, pattern)
        return _loaded[name, pattern]

    return encoder


def encode_decode(
    docs: DataFrame,
    rank_file: str,
    pattern: str,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    with_ids: bool = False,
) -> DataFrame:
    """Encode every text, decode the ids again, and report digests (and the ids themselves if asked).

    Returns ``id_col, n_tokens long, ids_sha256, decoded_sha256`` and, with ``with_ids``, ``ids array<int>``.
    Null text counts as the empty text: no tokens and the digests of nothing. Repeated rows give repeated rows;
    other columns are neither read nor returned. A narrow map: no shuffle, one batch of texts in memory.
    The rank file is read by the driver and broadcast; ``MOST_RANK_BYTES`` bounds it.
    """
    encoder = _shipped(docs.sparkSession, os.fspath(rank_file), pattern)
    id_type = docs.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {id_type}, n_tokens bigint, ids_sha256 string, decoded_sha256 string" + (", ids array<int>" if with_ids else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder()
        sha = hashlib.sha256
        for batch in batches:
            counts, id_digests, digests, lists = [], [], [], []
            for text in batch.column(1):
                ids = bpe.encode(text.as_py() or "")
                packed = np.array(ids, dtype="<u4")
                counts.append(len(ids))
                id_digests.append(sha(packed.tobytes()).hexdigest())
                digests.append(sha(bpe.decode(ids)).hexdigest())
                if with_ids:
                    lists.append(packed.astype(np.int32))
            columns = [batch.column(0), pa.array(counts, pa.int64()), pa.array(id_digests, pa.string()), pa.array(digests, pa.string())]
            names = [id_col, "n_tokens", "ids_sha256", "decoded_sha256"]
            if with_ids:
                columns.append(pa.array(lists, pa.list_(pa.int32())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(columns, names)

    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(released(run), schema)


def decode_ids(encoded: DataFrame, rank_file: str, pattern: str, *, ids_col: str = "ids", out_col: str = "bytes") -> DataFrame:
    """Add the bytes that ``ids_col`` stands for; null ids give null bytes."""
    encoder = _shipped(encoded.sparkSession, os.fspath(rank_file), pattern)

    @F.pandas_udf("binary")
    def to_bytes(ids):
        bpe = encoder()
        return ids.map(lambda x: None if x is None else bpe.decode(np.asarray(x).tolist()))

    return encoded.withColumn(out_col, to_bytes(F.col(ids_col)))
