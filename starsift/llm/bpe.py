"""Byte-level BPE by a lazily determinised transducer, and streaming decoding.

The merges of a rank table are compiled into a transducer over bytes. Its
states are the token beginnings that the bytes read may stand in, a trie with
fallbacks to shorter beginnings; a transition is determinised when a text first
takes it and then remembered. With each byte a token ends: the longest that may
follow the token before it. One token may follow another if merging the bytes
of both gives the two back, which is read off the two tokens' own merges along
their seam and remembered too. Only beginnings still open can change what was
read, so tokens are emitted with a lag below the longest token.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from starsift.llm.words import utf8

#: Entries that each memo of a task holds before it is emptied.
MEMO_ENTRIES = 400_000
#: Places where no match of the usual split pattern can reach across.
_JOINT = re.compile(r"(?<=\S)(?= \S)")


class _Seams:
    """Whether the merges of two tokens' bytes give the two back."""

    def __init__(self, ranks: dict[bytes, int], bytes_of: dict[int, bytes]):
        self.ranks, self.bytes_of = ranks, bytes_of
        self.spines: dict[tuple[int, bool], list[tuple[bytes, float]]] = {}

    def spine(self, token: int, left: bool) -> list[tuple[bytes, float]]:
        """The parts of a token at its left (right) edge, from one byte to all, and when each forms."""
        found = self.spines.get((token, left))
        if found is None:
            parts = halves(self.bytes_of[token], self.ranks)
            if parts is None:
                found = []
            elif len(parts) == 1:
                found = [(parts[0], -1)]
            else:
                edge = self.ranks[parts[0] if left else parts[1]]
                inner = self.spine(edge, left)
                found = inner and [*inner, (self.bytes_of[token], token)]
            self.spines[token, left] = found
        return found

    def holds(self, before: int, token: int) -> bool:
        own = self.spine(token, True)
        if before == START or not own:
            return bool(own)
        other = self.spine(before, False)
        at = to = 0
        never = float("inf")
        while True:
            joined = self.ranks.get(other[at][0] + own[to][0], never)
            left = other[at + 1][1] if at + 1 < len(other) else never
            right = own[to + 1][1] if to + 1 < len(own) else never
            if joined < left and joined <= right:
                return False  # the seam closes before either side grows
            if left == right == never:
                return True
            if left <= right:
                at += 1
            else:
                to += 1


class _After(dict):
    """token before -> whether ``token`` may follow it; at most one entry per token."""

    def __init__(self, token: int, seams: _Seams):
        super().__init__()
        self.token, self.seams = token, seams

    def __missing__(self, before: int) -> bool:
        found = self[before] = self.seams.holds(before, self.token)
        return found


def halves(piece: bytes, ranks: dict[bytes, int]) -> tuple[bytes, ...] | None:
    """The two parts whose merge makes a token; itself if one byte; None if its merges do not make it."""
    if len(piece) == 1:
        return (piece,)
    parts = [piece[i : i + 1] for i in range(len(piece))]
    while len(parts) > 2:
        joins = [(ranks[x + y], at) for at, (x, y) in enumerate(zip(parts, parts[1:])) if x + y in ranks]
        if not joins:
            return None
        at = min(joins)[1]
        parts[at : at + 2] = [parts[at] + parts[at + 1]]
    return tuple(parts)


#: Stands for the token before the first one.
START = 0x7FFFFFFF


class Transducer:
    """Deterministic transducer from the bytes of a piece to its tokens, built as it is used."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.bytes_of = {rank: piece for piece, rank in ranks.items()}
        self.length = {rank: len(piece) for piece, rank in ranks.items()}
        self.trie: list[dict[int, int]] = [{}]
        self.ends: list[int] = [-1]
        self.depth: list[int] = [0]
        for piece, rank in ranks.items():
            node = 0
            for byte in piece:
                if byte not in self.trie[node]:
                    self.trie[node][byte] = len(self.trie)
                    self.trie.append({})
                    self.ends.append(-1)
                    self.depth.append(self.depth[node] + 1)
                node = self.trie[node][byte]
            self.ends[node] = rank
        seams = _Seams(ranks, self.bytes_of)
        self.after = {rank: _After(rank, seams) for rank in self.bytes_of}
        self.fallback: list[int] = [-1] * len(self.trie)
        #: state -> byte -> next state, filled on demand (at most trie nodes x 256)
        self.moves: list[dict[int, int]] = [{} for _ in self.trie]
        #: state -> tokens that end in it, longest first: token, length, what it may follow
        self.closing: list[tuple[tuple[int, int, _After], ...] | None] = [None] * len(self.trie)

    def _move(self, state: int, byte: int) -> int:
        """The longest token beginning at the end of the bytes read, after one more byte."""
        to = self.moves[state].get(byte)
        if to is None:
            to = self.trie[state].get(byte)
            shorter = self._move(self._fallback(state), byte) if state else 0
            if to is None:
                to = shorter
            else:
                self.fallback[to] = shorter
            self.moves[state][byte] = to
            self._closing(to)
        return to

    def _fallback(self, state: int) -> int:
        if state and self.fallback[state] < 0:
            raise AssertionError("a state is entered by a move only")
        return self.fallback[state] if state else 0

    def _closing(self, state: int) -> tuple[tuple[int, int, _After], ...]:
        found = self.closing[state]
        if found is None:
            shorter = self._closing(self._fallback(state)) if state else ()
            own = self.ends[state]
            found = self.closing[state] = ((own, self.length[own], self.after[own]), *shorter) if own >= 0 else shorter
        return found

    def _back(self, ended: list[int], start: int, at: int) -> list[int]:
        path = []
        while at > start:
            path.append(ended[at])
            at -= self.length[ended[at]]
        return path[::-1]

    def _agreed(self, state: int, ended: list[int], start: int) -> list[int]:
        """Tokens after ``start`` that stay, whichever open beginning becomes a token."""
        paths = [self._back(ended, start, len(ended) - 1)]
        while state:
            paths.append(self._back(ended, start, len(ended) - 1 - self.depth[state]))
            state = self._fallback(state)
        first, count = min(paths, key=len), 0
        while count < len(first) and all(p[count] == first[count] for p in paths):
            count += 1
        return first[:count]

    def stream(self, pieces: Iterator[bytes], window: int = 4096) -> Iterator[list[int]]:
        """Tokens of one piece that comes in parts; holds back what is not yet agreed on."""
        state, ended, at = 0, [START], 0
        moves, closing = self.moves, self.closing
        for part in pieces:
            for byte in part:
                try:
                    state = moves[state][byte]
                except KeyError:
                    state = self._move(state, byte)
                at += 1
                for token, size, after in closing[state]:
                    if after[ended[at - size]]:
                        break
                else:
                    raise ValueError("the rank table lacks a single byte")
                ended.append(token)
            if at >= window:
                sure = self._agreed(state, ended, 0)
                if sure:
                    gone = sum(map(self.length.__getitem__, sure))
                    del ended[:gone]
                    at -= gone
                    yield sure
        yield self._back(ended, 0, at)

    def _short(self, piece: bytes) -> list[int]:
        """``stream`` for a piece that is at hand and short."""
        moves, closing, length = self.moves, self.closing, self.length
        state, ended, at = 0, [START], 0
        for byte in piece:
            to = moves[state].get(byte)
            state = self._move(state, byte) if to is None else to
            at += 1
            for token, size, after in closing[state]:
                if after[ended[at - size]]:
                    break
            else:
                raise ValueError("the rank table lacks a single byte")
            ended.append(token)
        path = []
        while at:
            path.append(ended[at])
            at -= length[ended[at]]
        path.reverse()
        return path

    def encode(self, piece: bytes) -> list[int]:
        """Tokens of one piece. A piece that is itself a token is that token."""
        whole = self.ranks.get(piece)
        if whole is not None:
            return [whole]
        if len(piece) <= 256:
            return self._short(piece)
        parts = (piece[i : i + 256] for i in range(0, len(piece), 256))
        return list(chain.from_iterable(self.stream(parts)))


class Codec:
    """Encoder of whole texts. One copy serves all tasks of a Python worker, with its memos."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, limit: int = MEMO_ENTRIES):
        self.ranks, self.pattern, self.limit = ranks, pattern, limit
        self.transducer = None

    def __getstate__(self):
        return {"ranks": self.ranks, "pattern": self.pattern, "limit": self.limit, "transducer": None}

    def _open(self) -> None:
        self.transducer = Transducer(self.ranks)
        self.split = regex.compile(self.pattern)
        # Two generations each: what the older one still serves moves to the younger.
        self.chunks: dict[str, tuple[int, ...]] = {}
        self.older: dict[str, tuple[int, ...]] = {}
        self.pieces: dict[str, list[int]] = {}
        self.vocabulary = [self.transducer.bytes_of.get(i, b"") for i in range(max(self.ranks.values()) + 1)]

    def _chunk(self, chunk: str) -> tuple[int, ...]:
        tokens: list[int] = []
        for piece in self.split.findall(chunk):
            found = self.pieces.get(piece)
            if found is None:
                found = self.transducer.encode(piece.encode("utf-8", "surrogatepass"))
                if len(piece) < 64:
                    self.pieces[piece] = found
            tokens += found
        return tuple(tokens)

    def encode(self, text: str | None) -> np.ndarray:
        """Token ids of a whole text; null counts as empty.

        The text is cut before each blank that stands alone between other
        characters. No match of a pattern whose alternatives take a blank only
        in front reaches across, so each chunk is encoded by itself and common
        ones are remembered.
        """
        if self.transducer is None:
            self._open()
        if not text:
            return np.zeros(0, dtype="<u4")
        if len(self.chunks) > self.limit:
            self.chunks, self.older = {}, self.chunks
        if len(self.pieces) > self.limit:
            self.pieces.clear()
        chunks, older, parts = self.chunks, self.older, text.split(" ")
        known = list(map(chunks.get, parts))
        for at in [at for at, found in enumerate(known) if found is None]:
            part = parts[at]
            found = chunks.get(part)  # it may have come up before in this text
            if found is None:
                if not part or part[0].isspace() or part[-1].isspace():
                    return self._apart(text)
                found = older.get(part) or self._chunk(" " + part)
                if len(part) < 64:
                    chunks[part] = found
            known[at] = found
        known[0] = self._chunk(parts[0])
        return np.fromiter(chain.from_iterable(known), dtype="<u4")

    def _apart(self, text: str) -> np.ndarray:
        """The same for a text in which blanks meet other white space or its ends."""
        return np.fromiter(chain.from_iterable(map(self._chunk, _JOINT.split(text))), dtype="<u4")

    def decode(self, ids: np.ndarray, block: int = 65_536) -> Iterator[str]:
        """Text of token ids in blocks of tokens, never cut inside a character."""
        if self.transducer is None:
            self._open()
        decoder = Utf8Stream()
        for at in range(0, len(ids), block):
            yield decoder.feed(b"".join(map(self.vocabulary.__getitem__, ids[at : at + block].tolist())))
        yield decoder.finish()


class Utf8Stream:
    """Incremental UTF-8 decoder: holds back the bytes of a character not yet complete."""

    def __init__(self):
        self.held = b""

    @staticmethod
    def open_bytes(data: bytes) -> int:
        """How many bytes at the end begin a character that more bytes could complete."""
        for back in range(1, min(3, len(data)) + 1):
            lead = data[-back]
            if lead < 0x80:
                return 0
            if lead >= 0xC0:
                need = 2 if lead < 0xE0 else 3 if lead < 0xF0 else 4
                return back if back < need else 0
        return 0

    def feed(self, data: bytes) -> str:
        data = self.held + data
        cut = len(data) - self.open_bytes(data)
        self.held = data[cut:]
        return data[:cut].decode("utf-8", "replace")

    def finish(self) -> str:
        rest, self.held = self.held, b""
        return rest.decode("utf-8", "replace")


def load_ranks(path: str) -> dict[bytes, int]:
    """A rank file: a base64 token and its rank on each line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line.strip())}


def shared_codec(spark: SparkSession, path: str, pattern: str):
    """A broadcast codec of a vocabulary file (its size bounds what is sent)."""
    return spark.sparkContext.broadcast(Codec(load_ranks(path), pattern))


def encode(docs: DataFrame, codec, text: str = "text", out: str = "ids") -> DataFrame:
    """``docs`` with a column of token ids (array<int>) of the whole texts; null is empty."""

    @F.pandas_udf("array<int>")
    def ids(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([codec.value.encode(t).astype(np.int32) for t in batch], dtype=object)

    return docs.withColumn(out, ids(F.col(text)))


def decode(docs: DataFrame, codec, ids: str = "ids", out: str = "text") -> DataFrame:
    """``docs`` with the text of a column of token ids; null stays null."""

    @F.pandas_udf("string")
    def text(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series(
                [None if x is None else "".join(codec.value.decode(np.asarray(x))) for x in batch], dtype=object
            )

    return docs.withColumn(out, text(F.col(ids)))


def round_trip_digests(docs: DataFrame, codec) -> DataFrame:
    """Per row: doc_id, n_tokens, and SHA-256 of the ids and of the text decoded from them.

    Ids are hashed as little-endian unsigned 32-bit integers. Null and empty texts have no tokens.
    """

    @F.pandas_udf("n_tokens long, ids_sha256 string, decoded_sha256 string")
    def digests(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for text in batch:
                ids = codec.value.encode(text)
                decoded = hashlib.sha256()
                for part in codec.value.decode(ids):
                    decoded.update(utf8(part))
                rows.append((len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), decoded.hexdigest()))
            yield pd.DataFrame(rows, columns=["n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select("doc_id", digests(F.col("text")).alias("d")).select("doc_id", "d.*")
