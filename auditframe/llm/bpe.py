"""Byte-level BPE as a lazily determinised transducer, and streaming decoding.

A sequence of tokens is what the merges give for its bytes exactly when every two neighbours are: their
bytes together give these two tokens. So a piece of text can be encoded from left to right. A hypothesis is an open
token: the bytes since its start, the tokens before it that are not yet sent, and the last token before it.
A state of the transducer is the set of live hypotheses (those whose bytes begin a token); reading a byte moves all
of them and opens a new one where a token may end. Tokens that all hypotheses share are sent, so the delay is bounded
by the longest token. States and transitions are made when first met and kept in a bounded table.

Decoding joins the tokens' bytes; a small state machine holds back the bytes of a character that is not complete.

Encoding splits the text by a pattern and takes each match alone; a match that is a token as a whole is that
token. NULL counts as the empty text, which has no tokens. Special tokens are ordinary text. Repeated rows are
encoded each; an empty table gives an empty result; other columns are not read.
"""
from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from auditframe.llm.base import map_texts, table
from auditframe.llm.registry import query

#: Entries of a worker's tables of states, pieces and neighbours, beyond which a table starts anew. Full tables of this size
#: take some 550 MB; where an executor has less to spare, a share of them is enough (smaller tables are made anew more often).
STATES, PIECES, PAIRS = 1 << 18, 1 << 20, 1 << 20
BYTES = [bytes((b,)) for b in range(256)]
#: Tokens decoded at a time, and texts held as strings at a time.
BLOCK, TEXTS = 4096, 512


def read_ranks(raw: bytes) -> dict[bytes, int]:
    """Ranks from the lines of a rank file: the token in base 64 and its rank."""
    return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, raw.splitlines()) if token}


class Transducer:
    """Encodes one piece at a time; see the module's description."""

    def __init__(self, ranks: dict[bytes, int], states: int = STATES, pairs: int = PAIRS):
        self.ranks, self.limit, self.pair_limit = ranks, states, pairs
        self.open = {token[:k] for token in ranks for k in range(1, len(token))}
        self.own: dict[int, tuple] = {}
        self.pairs: dict[tuple[int, int], bool] = {}
        self.bytes_of = {rank: token for token, rank in ranks.items()}
        self._restart()

    def _restart(self) -> None:
        start = ((b"", (), -1),)
        self.states, self.hypotheses, self.moves, self.last = {start: 0}, [start], {}, [()]

    def trace(self, token: bytes) -> tuple[bool, list[tuple[bytes, int, int]], list[tuple[bytes, int, int]]]:
        """Whether the merges give the token itself, and the parts that ever stood at its left and at its right end.

        Each part comes with the rank at which it was made and the one at which it was joined with more. The
        pair of lowest rank is joined first, of several the leftmost.
        """
        ranks, never = self.ranks, 1 << 60
        parts = [token[i : i + 1] for i in range(len(token))]
        left, right = [(parts[0], -1)], [(parts[-1], -1)]
        while len(parts) > 1:
            found = [ranks.get(parts[i] + parts[i + 1], never) for i in range(len(parts) - 1)]
            rank = min(found)
            if rank == never:
                break
            i = found.index(rank)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            if i == 0:
                left.append((parts[0], rank))
            if i == len(parts) - 1:
                right.append((parts[-1], rank))
        until = lambda side: [(part, made, side[k + 1][1] if k + 1 < len(side) else never) for k, (part, made) in enumerate(side)]
        return len(parts) == 1, until(left), until(right)

    def spine(self, token: int):
        if token not in self.own:
            self.own[token] = self.trace(self.bytes_of[token])
        return self.own[token]

    def fits(self, before: int, token: int) -> bool:
        """Whether the merges leave the two tokens, or the one when nothing is before, as they are.

        They do when no part that stands at the end of the first while a part stands at the start of the second is
        joined with it before either is joined within its own token.
        """
        if before < 0:
            return self.spine(token)[0]
        key = (before, token)
        known = self.pairs.get(key)
        if known is None:
            if len(self.pairs) > self.pair_limit:
                self.pairs.clear()
            known = self.pairs[key] = self.spine(token)[0] and not self._joined(self.spine(before)[2], self.spine(token)[1])
        return known

    def _joined(self, ends, starts) -> bool:
        ranks = self.ranks
        for end, end_made, end_until in ends:
            for start, start_made, start_until in starts:
                if end_made < start_until and start_made < end_until:  # both stand at the same time
                    rank = ranks.get(end + start)
                    if rank is not None and rank < end_until and rank <= start_until:
                        return True
        return False

    def _move(self, state: int, byte: int) -> tuple[int, tuple[int, ...]]:
        """Makes the transition: (next state, tokens sent)."""
        live, closed, after, ranks = [], None, BYTES[byte], self.ranks
        for text, waiting, before in self.hypotheses[state]:
            longer = text + after
            if closed is None and longer in ranks:
                token = ranks[longer]
                if self.fits(before, token):
                    closed = (b"", (*waiting, token), token)
            if longer in self.open:
                live.append((longer, waiting, before))
        live.append(closed)
        first, shared = live[0][1], 0
        # The longest open token has the fewest tokens before it.
        while shared < len(first) and all([len(h[1]) > shared and h[1][shared] == first[shared] for h in live]):
            shared += 1
        key = tuple([(text, waiting[shared:], before) for text, waiting, before in live]) if shared else tuple(live)
        found = self.states.get(key)
        if found is None:
            found = self.states[key] = len(self.hypotheses)
            self.hypotheses.append(key)
            self.last.append(key[-1][1])
        made = self.moves[state << 8 | byte] = (found, first[:shared])
        return made

    def encode(self, piece: bytes) -> tuple[int, ...]:
        whole = self.ranks.get(piece)
        if whole is not None:
            return (whole,)
        if len(self.hypotheses) > self.limit:
            self._restart()
        out: list[int] = []
        state, moves = 0, self.moves
        for byte in piece:
            move = moves.get(state << 8 | byte)
            if move is None:
                move = self._move(state, byte)
            state, sent = move
            if sent:
                out += sent
        out += self.last[state]
        return tuple(out)


class Utf8Stream:
    """Decodes chunks of bytes; the bytes of an unfinished character wait for the next chunk."""

    def __init__(self) -> None:
        self.waiting = b""

    def feed(self, chunk: bytes) -> str:
        data = self.waiting + chunk
        keep = 0
        for back in range(1, min(3, len(data)) + 1):
            byte = data[-back]
            if byte < 0x80:
                break
            if byte >= 0xC0:  # a first byte: its character is unfinished if it needs more than ``back`` bytes
                if (2 if byte < 0xE0 else 3 if byte < 0xF0 else 4) > back:
                    keep = back
                break
        self.waiting = data[len(data) - keep :]
        return data[: len(data) - keep].decode("utf-8", "replace")

    def end(self) -> str:
        rest, self.waiting = self.waiting, b""
        return rest.decode("utf-8", "replace")


class Codec:
    """Texts to tokens and back."""

    def __init__(self, ranks: dict[bytes, int], pattern: str = public_tokenizers.PATTERN, share: float = 1.0):
        self.transducer, self.find = Transducer(ranks, int(share * STATES), int(share * PAIRS)), regex.compile(pattern).findall
        self.limit = int(share * PIECES)
        self.known: dict[str, tuple[int, ...]] = {}
        self.token_bytes = self.transducer.bytes_of

    def encode(self, text: str | None) -> list[int]:
        pieces = self.find(text or "")
        known, encode = self.known, self.transducer.encode
        if len(known) > self.limit:
            known.clear()
        for piece in pieces:
            if piece not in known:
                known[piece] = encode(piece.encode())
        return list(chain.from_iterable(map(known.__getitem__, pieces)))

    def stream(self, ids: Iterable[int]) -> Iterator[tuple[bytes, str]]:
        """(bytes, characters) of the tokens, block by block."""
        ids, utf8 = list(ids), Utf8Stream()
        for at in range(0, len(ids), BLOCK):
            chunk = b"".join(map(self.token_bytes.__getitem__, ids[at : at + BLOCK]))
            yield chunk, utf8.feed(chunk)
        rest = utf8.end()
        if rest:
            yield b"", rest

    def decode(self, ids: Iterable[int]) -> str:
        return "".join(part for _, part in self.stream(ids))


_CODECS: dict[bytes, Codec] = {}


def codec_of(raw: bytes, pattern: str = public_tokenizers.PATTERN, share: float = 1.0) -> Codec:
    """The worker's codec of a rank file: one is kept, with its tables."""
    key = hashlib.sha256(raw + pattern.encode() + str(share).encode()).digest()
    if key not in _CODECS:
        _CODECS.clear()
        _CODECS[key] = Codec(read_ranks(raw), pattern, share)
    return _CODECS[key]


def rank_file(path: str) -> bytes:
    with open(path, "rb") as file:
        return file.read()


def encode_rows(docs: DataFrame, raw: bytes, id_column: str = "doc_id", text_column: str = "text", pattern: str = public_tokenizers.PATTERN) -> DataFrame:
    """doc_id, ids array<int> of every whole text. The rank file travels once per executor (its size is its bound)."""
    shared = docs.sparkSession.sparkContext.broadcast(raw)

    def make():
        codec = codec_of(shared.value, pattern)
        return lambda texts: pd.DataFrame({"ids": [np.array(codec.encode(t), np.int32) for t in texts]})

    return map_texts(docs, id_column, text_column, {"ids": ("array<int>", pa.list_(pa.int32()))}, make)


def decode_rows(tokens: DataFrame, raw: bytes, pattern: str = public_tokenizers.PATTERN) -> DataFrame:
    """doc_id, text of rows (doc_id, ids)."""
    shared = tokens.sparkSession.sparkContext.broadcast(raw)
    kind = tokens.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = codec_of(shared.value, pattern)
        for batch in batches:
            texts = pa.array([codec.decode(ids or []) for ids in batch.column(1).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), texts], ["doc_id", "text"])

    return tokens.select("doc_id", "ids").mapInArrow(run, f"doc_id {kind}, text string")


def digest_rows(docs: DataFrame, raw: bytes, pattern: str = public_tokenizers.PATTERN, share: float = 1.0) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256, n_chars: encoded, then decoded from the ids, in one pass.

    ``share`` is that of the tables' full size; it changes memory and time, not the result.
    """
    shared = docs.sparkSession.sparkContext.broadcast(raw)
    columns = {"n_tokens": ("long", pa.int64()), "ids_sha256": ("string", pa.string()), "decoded_sha256": ("string", pa.string()), "n_chars": ("long", pa.int64())}

    def make():
        codec = codec_of(shared.value, pattern, share)
        names = {rank: str(rank) for rank in codec.token_bytes}

        def work(texts: list[str | None]) -> pd.DataFrame:
            rows = []
            for text in texts:
                ids = codec.encode(text)
                digest, chars = hashlib.sha256(), 0
                for chunk, part in codec.stream(ids):
                    digest.update(chunk)
                    chars += len(part)
                rows.append((len(ids), hashlib.sha256(",".join(map(names.__getitem__, ids)).encode()).hexdigest(), digest.hexdigest(), chars))
            return pd.DataFrame(rows, columns=list(columns))

        return work

    return map_texts(docs, "doc_id", "text", columns, make, rows=TEXTS)


@query("op6_byte_bpe")
def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = rank_file(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    return digest_rows(table(spark, sf_dir, "documents"), raw)
