"""Byte-level BPE as a lazily determinised finite-state transducer.

A sequence of tokens is what the merges make of a text if and only if each two neighbours are: no merge across their
border comes before the merges that made them. That is decided from the two tokens alone, so the tokens of a text are
the path of a nondeterministic transducer whose states are the border left by the token before, as far as it can still
matter, and the bytes of the token in progress. It is made
deterministic as texts are read: a state of the result holds the paths that are still possible. One of them stands
between tokens, as what was read so far has one sequence of tokens; the state tells its last token. The tokens of a
text are read off the states passed, from the end of the text, or in a long text from where the paths still possible
part. A path dies or ends within the longest token, which bounds the lookahead. The parts before merging (matches of
the pattern) are texts of their own; a bounded memory holds what the transducer made of a part, and both the memory
and the states start anew when they are full.

Decoding reads tokens as a stream: a state machine over the bytes of UTF-8, carried over tokens, gives text as soon as
it is complete and the replacement character for bytes that are no text.

Defined cases: null and empty texts have no ids, the check sums are those of the empty string, and the decoded text is
empty; a very long text is read in blocks of parts; equal texts get equal rows; an empty table gives no rows; other
columns are not touched.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from functools import lru_cache
from itertools import accumulate, islice
from operator import getitem
from typing import Iterator, Sequence

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

#: Bounds of the memory of a worker: states of the transducer, remembered parts, and the longest of them.
STATES = 150_000
PARTS = 200_000
PART_BYTES = 64
#: Parts read at a time, and bytes of a part.
BLOCK = 1 << 16
STRETCH = 1 << 16

VOCABULARY = "byte_bpe_multi_50k.tiktoken"


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as file:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}


class Merges:
    """What the ranks say about the pieces at a token's two borders."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.tokens = {rank: token for token, rank in ranks.items()}
        #: Starts of tokens, each with the least rank of a token that starts so.
        self.starts = {token[:n]: rank for token, rank in sorted(ranks.items(), key=lambda x: -x[1]) for n in range(1, len(token) + 1)}
        self._last: dict[bytes, tuple[bytes, bytes]] = {}
        self._sides: dict[tuple[int, bool], dict[bytes, float]] = {}

    def last_merge(self, token: bytes) -> tuple[bytes, bytes]:
        """The two parts whose merge makes the token: what is left when only lower ranks merge."""
        if token not in self._last:
            parts, own = [token[i : i + 1] for i in range(len(token))], self.ranks[token]
            while len(parts) > 2:
                rank, at = min((self.ranks.get(a + b, own), i) for i, (a, b) in enumerate(zip(parts, parts[1:])))
                if rank >= own:
                    break
                parts[at : at + 2] = [parts[at] + parts[at + 1]]
            if len(parts) != 2:
                raise ValueError(f"no merge makes token {own}")
            self._last[token] = (parts[0], parts[1])
        return self._last[token]

    def side(self, token: int, right: bool) -> dict[bytes, float]:
        """The pieces that stand at the token's right (or left) border in turn, each with the rank of the merge that ends it."""
        pieces = self._sides.get((token, right))
        if pieces is None:
            piece = self.tokens[token]
            pieces = self._sides[token, right] = {piece: float("inf")}
            while len(piece) > 1:
                ended, piece = self.ranks[piece], self.last_merge(piece)[right]
                pieces[piece] = ended
        return pieces


#: A path: bytes of the token in progress, what may still merge with it from the left (pieces at the border, with the
#: rank that ends each), and what would (the start of the token it merges with, and the rank).
Path = tuple[bytes, tuple[tuple[bytes, float], ...], tuple[tuple[bytes, int], ...]]
START: Path = (b"", (), ())


class State(dict):
    """The states after it by byte, made when they are asked for; its paths by number, and the last token of what was read."""

    __slots__ = ("owner", "paths", "token", "size")

    def __init__(self, owner: Transducer, paths: tuple[int, ...], token: int, size: int):
        self.owner, self.paths, self.token, self.size = owner, paths, token, size

    def __missing__(self, byte: int) -> State:
        self[byte] = after = self.owner.state_after(self, byte)
        return after


class Transducer:
    """Bytes in, tokens out.

    Of the token before, a path keeps only what can still matter, so paths and states recur and are numbered.
    """

    def __init__(self, ranks: dict[bytes, int]):
        self.merges = Merges(ranks)
        self.states: dict[tuple[int, ...], State] = {}
        self._reset()

    def _reset(self) -> None:
        for state in self.states.values():  # they refer to each other
            state.clear()
        self.paths, self.path_numbers = [START], {START: 0}
        self.steps: dict[int, tuple[int, int]] = {}
        self.between: dict[int, int] = {}
        self.root = State(self, (0,), -1, 0)
        self.states = {self.root.paths: self.root}

    def _path(self, path: Path) -> int:
        number = self.path_numbers.get(path)
        if number is None:
            number = self.path_numbers[path] = len(self.paths)
            self.paths.append(path)
        return number

    def _step(self, number: int, now: bytes) -> tuple[int, int]:
        """The path with a byte more, and the token that ends there, if it may stand after the one before; else -1."""
        starts, ranks = self.merges.starts, self.merges.ranks
        _, border, merging = self.paths[number]
        if border:
            border = tuple([(x, until) for x, until in border if starts.get(x + now, until) < until])
            merging += tuple([(now, rank) for x, until in border if (rank := ranks.get(x + now, until)) < until])
        token = ranks.get(now, -1)
        if token >= 0 and merging:
            ends = self.merges.side(token, False)
            # a merge across the border comes first, from the left if ranks are equal
            if any(rank <= ends.get(start, -1) for start, rank in merging):
                token = -1
        return self._path((now, border, merging)), token

    def state_after(self, state: State, byte: int) -> State:
        starts, paths, steps = self.merges.starts, self.paths, self.steps
        on, last, more = [], -1, bytes((byte,))
        for number in state.paths:
            now = paths[number][0] + more
            if now in starts:
                step = steps.get(number << 8 | byte)
                if step is None:
                    step = steps[number << 8 | byte] = self._step(number, now)
                on.append(step[0])
                if step[1] >= 0:
                    last = step[1]
        after = self.between.get(last)
        if after is None:
            after = self.between[last] = self._path((b"", tuple(self.merges.side(last, True).items()), ()))
        key = (*on, after)
        found = self.states.get(key)
        if found is None:
            found = self.states[key] = State(self, key, last, len(self.merges.tokens[last]))
        return found

    @staticmethod
    def _back(passed: list[State], end: int) -> list[int]:
        """The tokens up to ``end``, read off the states passed."""
        out = []
        while end:
            state = passed[end]
            out.append(state.token)
            end -= state.size
        out.reverse()
        return out

    def encode(self, part: bytes) -> tuple[int, ...]:
        if len(self.states) > STATES:
            self._reset()
        if len(part) > STRETCH:
            return tuple(self._long(part))
        return tuple(self._back(list(accumulate(part, getitem, initial=self.root)), len(part)))

    def _long(self, part: bytes) -> Iterator[int]:
        """The same by stretches; of those before, the states since the paths still possible part are kept."""
        passed = [self.root]
        for at in range(0, len(part), STRETCH):
            passed += islice(accumulate(part[at : at + STRETCH], getitem, initial=passed[-1]), 1, None)
            ends = {len(passed) - 1 - len(self.paths[number][0]) for number in passed[-1].paths}
            while len(ends) > 1:
                end = max(ends)
                ends.remove(end)
                ends.add(end - passed[end].size)
            end = ends.pop()
            yield from self._back(passed, end)
            del passed[:end]
        yield from self._back(passed, len(passed) - 1)


#: The state machine of UTF-8: by state, ranges of bytes and the state after; state 0 is between characters.
UTF8 = (
    ((0x00, 0x7F, 0), (0xC2, 0xDF, 1), (0xE0, 0xE0, 2), (0xE1, 0xEC, 3), (0xED, 0xED, 4), (0xEE, 0xEF, 3), (0xF0, 0xF0, 5), (0xF1, 0xF3, 6), (0xF4, 0xF4, 7)),
    ((0x80, 0xBF, 0),),
    ((0xA0, 0xBF, 1),),
    ((0x80, 0xBF, 1),),
    ((0x80, 0x9F, 1),),
    ((0x90, 0xBF, 3),),
    ((0x80, 0xBF, 3),),
    ((0x80, 0x8F, 3),),
)


class Decoder:
    """Tokens in, text out; what a token does in a state is worked out once."""

    def __init__(self, tokens: dict[int, bytes]):
        self.tokens = tokens
        self.steps = [{b: after for low, high, after in ranges for b in range(low, high + 1)} for ranges in UTF8]
        self.known: dict[tuple[int, bytes], dict[int, tuple[str, tuple[int, bytes]]]] = {(0, b""): {}}
        #: Texts by token; None, and marked as cut, for a token that is not of whole characters.
        self.whole = np.full(max(tokens, default=-1) + 1, None, object)
        for i, data in tokens.items():
            text, state = self.step((0, b""), data)
            if state == (0, b"") and "�" not in text:
                self.whole[i] = text
        self.cut = np.equal(self.whole, None).astype(bool)

    def step(self, state: tuple[int, bytes], data: bytes) -> tuple[str, tuple[int, bytes]]:
        """Text that ``data`` completes, and the state after: (state of the machine, bytes of the character begun)."""
        at, begun, out = state[0], state[1], []
        for byte in data:
            after = self.steps[at].get(byte)
            if after is None and at:  # the character broke off; the byte may begin the next
                out.append("�")
                at, begun, after = 0, b"", self.steps[0].get(byte)
            if after is None:
                out.append("�")
                continue
            at, begun = after, begun + bytes((byte,))
            if not at:
                out.append(begun.decode())
                begun = b""
        return "".join(out), (at, begun)

    def stream(self, ids: Sequence[int], state: tuple[int, bytes]) -> tuple[str, tuple[int, bytes]]:
        """The text of the next tokens of a stream, and the state after them."""
        ids = np.asarray(ids, np.uint32)
        texts, at = self.whole.take(ids).tolist(), 0
        cuts = np.flatnonzero(self.cut.take(ids)).tolist()
        for i in [0, *cuts] if state[0] else cuts:  # most tokens are whole characters
            at = max(at, i)
            while at < len(texts) and (state[0] or texts[at] is None):
                token, table = int(ids[at]), self.known.setdefault(state, {})
                if token not in table:
                    table[token] = self.step(state, self.tokens[token])
                texts[at], state = table[token]
                at += 1
        return "".join(texts), state

    @staticmethod
    def end(state: tuple[int, bytes]) -> str:
        return "�" if state[0] else ""


#: Ids of a batch of results, in bytes: about so much is held at a time, whatever the batch of texts.
OUTPUT_BYTES = 1 << 21


class Coder(dict):
    """Encodes and decodes texts; as a dict it remembers the ids of parts, as bytes."""

    def __init__(self, path: str, pattern: str):
        super().__init__()
        self.transducer = Transducer(read_ranks(path))
        self.decoder = Decoder(self.transducer.merges.tokens)
        self.parts = regex.compile(pattern)

    def __missing__(self, part: str) -> bytes:
        data = part.encode()
        found = self.transducer.encode(data)
        ids = struct.pack(f"<{len(found)}I", *found)
        if len(data) <= PART_BYTES:
            if len(self) >= PARTS:
                self.clear()
            self[part] = ids
        return ids

    def blocks(self, text: str) -> Iterator[bytes]:
        """The ids of a text as bytes (four each, little-endian), some parts at a time."""
        if len(text) <= BLOCK:
            yield b"".join(map(self.__getitem__, self.parts.findall(text)))
            return
        parts = (m.group() for m in self.parts.finditer(text))
        while block := list(islice(parts, BLOCK)):
            yield b"".join(map(self.__getitem__, block))

    def round_trip(self, text: str | None, keep: bool = False) -> tuple[int, str, str, bytes | None]:
        """Number of ids, SHA-256 of the ids and of the decoded text, and with ``keep`` the ids."""
        n, ids_sum, text_sum, state, kept = 0, hashlib.sha256(), hashlib.sha256(), (0, b""), []
        for data in self.blocks(text or ""):
            ids = np.frombuffer(data, "<u4")
            decoded, state = self.decoder.stream(ids, state)
            n += len(ids)
            ids_sum.update(data)
            text_sum.update(decoded.encode())
            if keep:
                kept.append(data)
        text_sum.update(self.decoder.end(state).encode())
        return n, ids_sum.hexdigest(), text_sum.hexdigest(), b"".join(kept) if keep else None


@lru_cache(maxsize=1)
def coder(path: str, pattern: str) -> Coder:
    """One for each worker process; it reads the vocabulary from the library installed there."""
    return Coder(path, pattern)


def round_trips(docs: DataFrame, path: str, pattern: str, key: str = "doc_id", text: str = "text", ids: bool = False) -> DataFrame:
    """For every document ``key``, n_tokens, ids_sha256 and decoded_sha256; with ``ids`` also the ids themselves."""
    kind = docs.schema[key].dataType.simpleString()
    names = ["key", "n_tokens", "ids_sha256", "decoded_sha256"] + ["ids"] * ids
    schema = f"key {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = coder(path, pattern)
        for batch in batches:
            at, size, found = 0, 0, []
            for i, value in enumerate(batch.column(1)):
                found.append(own.round_trip(value.as_py(), ids))
                size += 4 * found[-1][0] if ids else 0
                if size >= OUTPUT_BYTES or i + 1 == batch.num_rows:
                    yield told(batch.column(0).slice(at, len(found)), found)
                    at, size, found = i + 1, 0, []
        pa.default_memory_pool().release_unused()

    def told(keys: pa.Array, found: list) -> pa.RecordBatch:
        n, a, b, raw = zip(*found)
        columns = [keys, pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())]
        if ids:
            ends = np.concatenate([[0], np.cumsum(n, dtype=np.int64)]).astype(np.int32)
            columns.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(raw), "<i4"))))
        return pa.RecordBatch.from_arrays(columns, names=names)

    return docs.select(key, text).mapInArrow(run, schema)


def encoded(docs: DataFrame, name: str = VOCABULARY) -> DataFrame:
    """The query's digest with the vocabulary of the contract."""
    import public_tokenizers

    return round_trips(docs, public_tokenizers.path(name), public_tokenizers.PATTERN).withColumnRenamed("key", "doc_id")
