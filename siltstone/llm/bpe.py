"""Byte-level BPE by a lazily determinised finite-state transducer, and a streaming decoder.

Encoding. A rank file gives every token's bytes and rank; merging always joins the adjacent pair
whose concatenation has the lowest rank, leftmost first. The tokens of a string are then the only
sequence of tokens in which every adjacent pair is itself a fixed point of merging, so they can be
found from left to right: after each byte the last token of the prefix is the longest one ending there
that may follow the token before it. Tokens may start anywhere, so the recogniser of the vocabulary's trie is
nondeterministic; its subset states are made deterministic when first reached. Each is named by its
deepest trie node, since the others are suffixes of that. An arc leads to the next state and to the
tokens that end there. Every ``lookahead`` bytes the paths back from the places where a token may still be growing
are followed to where they meet; what lies before is certain and emitted. Those places reach no further
back than the state's depth, at most the longest token.

All distinct words of some documents are run in step, a byte of each at a time, so that an arc is a lookup in an
array. Words are kept with their output, like longer arcs, in a bounded table, since a corpus says the same ones over
and over.

Decoding. Ids are turned into bytes chunk by chunk; a byte-level UTF-8 state machine holds back an
unfinished character until the next chunk and replaces ill-formed sequences, so that any split of
the stream gives the same text.
"""

from __future__ import annotations

import base64
import hashlib
import re
from array import array
from collections.abc import Iterable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from siltstone.llm._common import held, slices


def splitter(pattern: str | None = None):
    """Finds the pieces of a text by ``pattern``, by default ``public_tokenizers.PATTERN``.

    ``\\s`` and ``\\S`` are read as the Unicode property White_Space, as tokenizer libraries read them; Python's
    engines count four control characters in.
    """
    import regex

    if pattern is None:
        import public_tokenizers

        pattern = public_tokenizers.PATTERN
    return regex.compile(pattern.replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}")).findall


def load_ranks(path: str) -> dict[bytes, int]:
    """Reads a rank file: a line for each token with its bytes in base64 and its rank."""
    lines = (line.split() for line in Path(path).read_bytes().splitlines() if line)
    return {base64.b64decode(token): int(rank) for token, rank in lines}


class Merges:
    """What the transducer needs of a rank file; a few MB, independent of the corpus."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.bytes_of = {rank: token for token, rank in ranks.items()}
        self.length = {rank: len(token) for token, rank in ranks.items()}
        self.longest = max(self.length.values())
        self.first: dict[int, int] = {}
        self.second: dict[int, int] = {}
        #: (a << 20 | b) -> the rank of the token that a and b make, for all that make one
        self.joined = {
            ranks[token[:i]] << 20 | ranks[token[i:]]: rank
            for token, rank in ranks.items()
            for i in range(1, len(token))
            if token[:i] in ranks and token[i:] in ranks
        }
        self.dead: set[int] = set()
        for token, rank in ranks.items():
            if len(token) > 1:
                parts = self._merge(token, rank)
                if len(parts) == 2:
                    self.first[rank], self.second[rank] = ranks[parts[0]], ranks[parts[1]]
                else:
                    self.dead.add(rank)

    def _merge(self, token: bytes, below: int) -> list[bytes]:
        """Merges the bytes of a token with ranks below its own; a live token ends as two parts."""
        ranks, parts = self.ranks, [token[i : i + 1] for i in range(len(token))]
        while len(parts) > 2:
            best, at = below, -1
            for i in range(len(parts) - 1):
                if (r := ranks.get(parts[i] + parts[i + 1], below)) < best:
                    best, at = r, i
            if at < 0:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts


class Table:
    """A map of 63-bit numbers to 63-bit numbers whose lookups take arrays: open addressing, at most half full."""

    def __init__(self, bits: int = 14):
        self.bits, self.size = bits, 0
        self.keys, self.values = np.full(1 << bits, -1, np.int64), np.zeros(1 << bits, np.int64)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return ((keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def get(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Values, and which keys there are."""
        slot = self._slot(keys)
        held = self.keys[slot]
        there = held == keys
        out = self.values[slot]
        (rest,) = np.nonzero(~there & (held >= 0))
        mask = (1 << self.bits) - 1
        at = slot[rest]
        while len(rest):
            at = at + 1 & mask
            held = self.keys[at]
            hit = held == keys[rest]
            there[rest[hit]] = True
            out[rest[hit]] = self.values[at[hit]]
            on = ~hit & (held >= 0)
            rest, at = rest[on], at[on]
        return out, there

    def put(self, keys: np.ndarray, values: np.ndarray) -> None:
        """Adds keys that aren't there; all differ."""
        if 2 * (self.size + len(keys)) > 1 << self.bits:
            old, kept = self.keys, self.values
            self.bits = max(self.bits + 1, (4 * (self.size + len(keys))).bit_length())
            self.keys, self.values, self.size = np.full(1 << self.bits, -1, np.int64), np.zeros(1 << self.bits, np.int64), 0
            self.put(old[old >= 0], kept[old >= 0])
        self.size += len(keys)
        slot, mask = self._slot(keys), (1 << self.bits) - 1
        while len(keys):
            free = self.keys[slot] < 0
            _, first = np.unique(slot, return_index=True)  # of several for one place the first gets it
            take = np.zeros(len(keys), bool)
            take[first] = True
            take &= free
            self.keys[slot[take]], self.values[slot[take]] = keys[take], values[take]
            keys, values, slot = keys[~take], values[~take], slot[~take] + 1 & mask


class Transducer:
    """Emits the tokens of byte strings while it reads them. ``max_arcs`` and ``max_borders`` bound what is kept."""

    ROOT = 0
    #: Tokens that may end at a place besides the first so many are asked for one by one.
    WIDE = 6

    def __init__(self, merges: Merges, lookahead: int = 64, max_arcs: int = 400_000, max_borders: int = 500_000):
        self.merges, self.lookahead, self.max_arcs, self.max_borders = merges, lookahead, max_arcs, max_borders
        self.child: dict[int, int] = {}  # node << 8 | byte -> node
        self.token_at: dict[int, int] = {}
        self.above, self.depth = [(0, 0)], [0]  # parent and byte of each node; its length
        for token, rank in merges.ranks.items():
            if rank in merges.dead:
                continue
            node = self.ROOT
            for n, b in enumerate(token, 1):
                nxt = self.child.get(node << 8 | b)
                if nxt is None:
                    nxt = self.child[node << 8 | b] = len(self.depth)
                    self.above.append((node, b))
                    self.depth.append(n)
                node = nxt
            self.token_at[node] = rank
        self.shorter: dict[int, int] = {}
        self.length = np.zeros(max(merges.length) + 2, np.int64)  # by token + 1
        for rank, n in merges.length.items():
            self.length[rank + 1] = n
        self._reset()
        self.borders = Table()

    def _reset(self) -> None:
        """No states but the start. A state has a number, its trie node, and the tokens that end there."""
        self.arcs, self.number, self.node = Table(), {self.ROOT: 0}, [self.ROOT]
        self.ending: list[tuple[int, ...]] = [()]
        self.first = np.full((1024, self.WIDE), -1, np.int64)  # the longest of them, for lookups by arrays

    def _suffix(self, node: int) -> int:
        """The longest proper suffix of the node's string that is in the trie."""
        if self.depth[node] < 2:
            return self.ROOT
        if (known := self.shorter.get(node)) is None:
            parent, byte = self.above[node]
            known = self.shorter[node] = self._next(self._suffix(parent), byte)
        return known

    def _next(self, node: int, byte: int) -> int:
        while (found := self.child.get(node << 8 | byte)) is None:
            if node == self.ROOT:
                return self.ROOT
            node = self._suffix(node)
        return found

    def _state(self, node: int) -> int:
        """The number of the subset state whose deepest node is ``node``."""
        if (known := self.number.get(node)) is None:
            known = self.number[node] = len(self.node)
            self.node.append(node)
            ending = []
            while node != self.ROOT:  # longest first
                if (token := self.token_at.get(node)) is not None:
                    ending.append(token)
                node = self._suffix(node)
            self.ending.append(tuple(ending))
            if known >= len(self.first):
                self.first = np.concatenate([self.first, np.full_like(self.first, -1)])
            self.first[known, : min(len(ending), self.WIDE)] = ending[: self.WIDE]
        return known

    def step(self, state: np.ndarray, byte: np.ndarray) -> np.ndarray:
        """The next states; arcs that aren't there yet are made."""
        key = state << 8 | byte
        to, there = self.arcs.get(key)
        if not there.all():
            new = np.unique(key[~there])
            made = np.array([self._state(self._next(self.node[k >> 8], k & 255)) for k in new.tolist()], np.int64)
            self.arcs.put(new, made)
            to, _ = self.arcs.get(key)
        return to

    def may_follow(self, a: int, b: int) -> bool:
        """Whether merging leaves the border between tokens a and b alone; a of -1 is the start of the string.

        Undoes the merges at the border from the last to the first; a pair that would have joined
        across it earlier than the merge undone rules the border out. Of equal ranks the left one
        is merged first.
        """
        joined, first, second, before = self.merges.joined.get, self.merges.first, self.merges.second, 1 << 40
        while a >= 0:
            if joined(a << 20 | b, before) < before:
                return False
            born_a, born_b = a if a in first else -1, b if b in first else -1
            if born_a < 0 and born_b < 0:
                return True
            if born_a > born_b:
                before, a = born_a, second[a]
            else:
                before, b = born_b + 1, first[b]
        return True

    def _border(self, before: np.ndarray, token: np.ndarray) -> np.ndarray:
        key = before + 1 << 20 | token
        ok, there = self.borders.get(key)
        if not there.all():
            new = np.unique(key[~there])
            made = np.array([self.may_follow((k >> 20) - 1, k & 0xFFFFF) for k in new.tolist()], np.int64)
            if self.borders.size + len(new) > self.max_borders:
                self.borders = Table()
            self.borders.put(new, made)
            ok = ok.copy()
            ok[~there] = made[np.searchsorted(new, key[~there])]
        return ok > 0

    def run(self, pieces: list[bytes]) -> list[bytes]:
        """The tokens of each piece, as little-endian 32-bit numbers."""
        if self.arcs.size > self.max_arcs:
            self._reset()
        sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
        order = np.argsort(-sizes, kind="stable")  # the pieces that are still being read come first
        made: list[list[np.ndarray]] = []  # (piece, tokens) of each window
        n = np.searchsorted(-sizes[order], -np.arange(1, sizes.max(initial=0) + 1), "right")
        begins = (np.cumsum(sizes) - sizes)[order]
        flat = np.frombuffer(b"".join(pieces), np.uint8)
        state = np.zeros(len(pieces), np.int64)
        depth = np.array(self.depth)
        # ends[i, at]: the token that ends at byte ``at`` since the last one emitted, which itself is at 0
        width = 2 * self.lookahead + self.merges.longest + 1
        ends = np.full((len(pieces), min(width, int(sizes.max(initial=0)) + 1)), -1, np.int64)
        at = np.zeros(len(pieces), np.int64)
        for place, m in enumerate(n.tolist()):
            if ends.shape[0] > 2 * m:
                ends = ends[:m].copy()
            state[:m] = self.step(state[:m], flat[begins[:m] + place].astype(np.int64))
            at[:m] += 1
            open_ = np.arange(m)
            for k in range(self.WIDE):
                token = self.first[state[open_], k]
                if (token < 0).any():
                    raise ValueError("the ranks lack a token for a single byte")
                ok = self._border(ends[open_, at[open_] - self.length[token + 1]], token)
                ends[open_[ok], at[open_[ok]]] = token[ok]
                open_ = open_[~ok]
                if not len(open_):
                    break
                if k == self.WIDE - 1 or (self.first[state[open_], k + 1] < 0).any():
                    for i in open_.tolist():
                        self._late(ends, i, int(at[i]), int(state[i]), k + 1)
                    break
            if place + 1 < len(n) and place + 1 >= self.lookahead:
                going = int(n[place + 1])
                for i in np.flatnonzero(at[:going] >= 2 * self.lookahead - 1).tolist() if (place + 1) % self.lookahead == 0 or ends.shape[1] - 2 <= at[:going].max() else ():
                    sure = self._sure(ends[i], int(at[i]), int(depth[self.node[state[i]]]))
                    if sure:
                        made.append((order[i : i + 1], self._back(ends[i], sure)))
                        ends[i, : at[i] - sure + 1] = ends[i, sure : at[i] + 1].copy()
                        at[i] -= sure
                if going and ends.shape[1] - 2 <= at[:going].max():  # nothing was certain for long: go on with more room
                    ends = np.concatenate([ends, np.full_like(ends, -1)], 1)
            done = int(n[place + 1]) if place + 1 < len(n) else 0
            if done < m:
                made += self._finish(ends, at, order, done, m)
        parts: dict[int, list[bytes]] = {}
        out: list[bytes] = [b""] * len(pieces)
        for who, tokens in made:
            if len(who) == 1 and tokens.ndim == 1:
                parts.setdefault(int(who[0]), []).append(tokens.astype("<u4").tobytes())
                continue
            count = (tokens >= 0).sum(1)
            data = tokens[tokens >= 0].astype("<u4").tobytes()
            stop = np.cumsum(count * 4)
            for i, a, b in zip(who.tolist(), (stop - count * 4).tolist(), stop.tolist(), strict=True):
                out[i] = data[a:b]
        for i, before in parts.items():
            out[i] = b"".join([*before, out[i]])
        return out

    def _late(self, ends: np.ndarray, i: int, at: int, state: int, k: int) -> None:
        """The first of the shorter tokens ending here that fits."""
        for token in self.ending[state][k:]:
            if self.may_follow(int(ends[i, at - self.merges.length[token]]), token):
                ends[i, at] = token
                return
        raise ValueError("the ranks lack a token for a single byte")

    def _finish(self, ends: np.ndarray, at: np.ndarray, order: np.ndarray, low: int, high: int) -> list[tuple[np.ndarray, np.ndarray]]:
        """Tokens of the pieces low to high, which end here, by the paths back; -1 fills the rows up."""
        who, left, columns = np.arange(low, high), at[low:high].copy(), []
        while (left > 0).any():
            token = np.where(left > 0, ends[who, left], -1)
            columns.append(token)
            left -= self.length[token + 1]
        rows = np.stack(columns[::-1], 1) if columns else np.zeros((len(who), 0), np.int64)
        return [(order[low:high], rows)]

    def _back(self, ends: np.ndarray, n: int) -> np.ndarray:
        path = []
        while n > 0:
            path.append(int(ends[n]))
            n -= self.merges.length[path[-1]]
        return np.array(path[::-1])

    def _sure(self, ends: np.ndarray, at: int, depth: int) -> int:
        """Where the paths back from every place a token may still grow from come together."""
        length, live = self.merges.length, set(range(at - depth, at + 1))
        while len(live) > 1:
            n = max(live)
            live.discard(n)
            live.add(n - length[int(ends[n])])
        return max(0, live.pop())


class Encoder:
    """Splits texts into pieces and runs the transducer over the distinct ones.

    A single space before a character that isn't white space always starts a piece, so text without
    runs of spaces is first cut there, and whole words are looked up; up to ``max_words`` of at most ``longest``
    characters are kept between calls. ``at_once`` pieces are run in step.
    """

    def __init__(self, merges: Merges, pattern: str | None = None, max_words: int = 150_000, longest: int = 40, at_once: int = 16_384):
        self.pieces, self.fst = splitter(pattern), Transducer(merges)
        self.max_words, self.longest, self.at_once = max_words, longest, at_once
        self.words: dict[str, bytes] = {}  # keys have the space before the word
        #: Tokens that merging never makes; a piece that is one is that token all the same.
        self.whole = {merges.bytes_of[rank].decode(): rank for rank in merges.dead if _is_text(merges.bytes_of[rank])}

    def _run(self, pieces: list[str], known: dict[str, bytes]) -> None:
        """Puts the tokens of pieces into ``known``."""
        pieces.sort(key=len)
        for i in range(0, len(pieces), self.at_once):
            part = pieces[i : i + self.at_once]
            known.update(zip(part, self.fst.run([p.encode() for p in part]), strict=True))
        for piece in self.whole.keys() & pieces if self.whole else ():
            known[piece] = array("I", [self.whole[piece]]).tobytes()

    def encode_all(self, texts: list[str | None]) -> list[np.ndarray]:
        """The ids of each text."""
        known, split = self.words, []
        for text in texts:
            if not text:
                split.append([])
            elif "  " in text or text[-1] == " " or "\n" in text and " \n" in text:
                split.append(self.pieces(text))
            else:
                first, *rest = text.split(" ")
                split.append([*self.pieces(first), *map(" ".__add__, rest)])
        new = set().union(*split).difference(known)
        if len(known) + len(new) > self.max_words:
            known = self.words = {}
            new = set().union(*split)
        # words of letters alone are one piece; of others the pieces are found first
        several = {word: found for word in new if not word[1:].isalpha() and len(found := self.pieces(word)) > 1}
        missing = new.difference(several)
        missing.update(p for found in several.values() for p in found if p not in known)
        self._run(list(missing), known)
        for word, found in several.items():
            known[word] = b"".join(map(known.__getitem__, found))
        out = [np.frombuffer(b"".join(map(known.__getitem__, words)), "<u4") for words in split]
        if len(known) > self.max_words:
            self.words = {}
        else:
            for word in new:
                if len(word) > self.longest:
                    del known[word]
        return out

    def encode(self, text: str) -> np.ndarray:
        return self.encode_all([text])[0]


def _is_text(data: bytes) -> bool:
    try:
        return bool(data.decode())
    except UnicodeDecodeError:
        return False


class Decoder:
    """Ids to bytes, by chunks of ids."""

    def __init__(self, bytes_of: dict[int, bytes], chunk: int = 65_536):
        self.chunk = chunk
        n = max(bytes_of) + 1
        self.length = np.array([len(bytes_of.get(i, b"")) for i in range(n)], np.int64)
        self.at = np.concatenate([[0], np.cumsum(self.length)])[:-1]
        self.flat = np.frombuffer(b"".join(bytes_of.get(i, b"") for i in range(n)), np.uint8)

    def stream(self, ids: np.ndarray) -> Iterator[bytes]:
        """Ids outside the vocabulary raise IndexError."""
        for i in range(0, len(ids), self.chunk):
            part = ids[i : i + self.chunk].astype(np.int64)
            length = self.length[part]
            ends = np.cumsum(length)
            total = int(ends[-1]) if len(ends) else 0
            yield self.flat[np.arange(total) + np.repeat(self.at[part] - (ends - length), length)].tobytes()


def _utf8_states() -> list[bytes]:
    """The next state for each state and byte. 0: between characters; 1, 2, 3: so many bytes to come, of any value; 4 to 7:
    after E0, ED, F0 and F4, whose second byte is restricted; 8: ill-formed."""
    tables = [bytearray([8]) * 256 for _ in range(8)]

    def arc(state: int, low: int, high: int, to: int) -> None:
        tables[state][low : high + 1] = bytes([to]) * (high + 1 - low)

    for state, low, high, to in (
        (0, 0x00, 0x7F, 0), (0, 0xC2, 0xDF, 1), (0, 0xE0, 0xE0, 4), (0, 0xE1, 0xEF, 2), (0, 0xED, 0xED, 5), (0, 0xF0, 0xF0, 6), (0, 0xF1, 0xF3, 3),
        (0, 0xF4, 0xF4, 7), (1, 0x80, 0xBF, 0), (2, 0x80, 0xBF, 1), (3, 0x80, 0xBF, 2), (4, 0xA0, 0xBF, 1), (5, 0x80, 0x9F, 1), (6, 0x90, 0xBF, 2), (7, 0x80, 0x8F, 2),
    ):
        arc(state, low, high, to)
    return [bytes(t) for t in tables]


_NEXT = _utf8_states()
_HIGH = re.compile(rb"[\x80-\xff]+")


class Utf8Stream:
    """Incremental UTF-8 state machine; ill-formed sequences become U+FFFD, one for each maximal part.

    Bytes below 0x80 never change the state between characters, so the machine is run over the runs of other bytes;
    what it has accepted is converted in one go.
    """

    def __init__(self) -> None:
        self.state, self.held = 0, b""

    def feed(self, data: bytes, last: bool = False) -> str:
        begun = len(self.held)
        data, state, out = self.held + data, self.state, []
        first, char = 0, 0  # what isn't emitted yet, and the character being read
        for run in _HIGH.finditer(data, begun):
            if state and run.start() > begun:  # an ASCII byte cuts the held character short
                out += data[first:char].decode(), "\ufffd"
                first, state = begun, 0
            for at, byte in enumerate(run[0], run.start()):
                if not state:
                    char = at
                state = _NEXT[state][byte]
                while state == 8:
                    out += data[first:char].decode(), "\ufffd"
                    cut = at if at > char else at + 1
                    first = char = cut
                    state = _NEXT[0][byte] if cut == at else 0
            if state and (run.end() < len(data)):
                out += data[first:char].decode(), "\ufffd"
                first, state = run.end(), 0
        if state and begun and char == 0 and not _HIGH.search(data, begun) and len(data) > begun:
            out.append("\ufffd")
            first, state = begun, 0
        end = char if state else len(data)
        out.append(data[first:end].decode())
        if state and last:
            out.append("\ufffd")
            state, end = 0, len(data)
        self.state, self.held = state, data[end:] if state else b""
        return "".join(out)


def decode_text(decoder: Decoder, ids: Iterable[int]) -> str:
    """Streams ids through the decoder and the UTF-8 machine."""
    machine = Utf8Stream()
    parts = [machine.feed(chunk) for chunk in decoder.stream(np.asarray(ids, np.uint32))]
    return "".join([*parts, machine.feed(b"", last=True)])


def encode_documents(docs: DataFrame, rank_file: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """A row for each row of ``docs``: n_tokens, digests of the ids and of the decoded bytes, and whether the text came back.

    With ``with_ids`` also ``ids`` (array of int) and ``decoded`` (text from the streaming decoder).
    Null text counts as empty; repeated rows are encoded one by one; other columns are not read. The
    rank file is read on the driver and its tables (a few MB) are sent to the workers. Rows never
    leave their partition.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(load_ranks(rank_file))
    schema = "id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string, round_trip boolean"
    schema += ", ids array<int>, decoded string" if with_ids else ""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, decoder = _tools(shared)
        for batch in slices(batches):
            count, of_ids, of_bytes, same, ids_out, text_out = [], [], [], [], [], []
            texts = batch.column(1).to_pylist()
            for text, ids in zip(texts, encoder.encode_all(texts), strict=True):
                digest, machine, parts = hashlib.sha256(), Utf8Stream(), []
                for chunk in decoder.stream(ids):
                    digest.update(chunk)
                    parts.append(machine.feed(chunk))
                decoded = "".join([*parts, machine.feed(b"", last=True)])
                count.append(len(ids))
                of_ids.append(hashlib.sha256(ids.tobytes()).hexdigest())
                of_bytes.append(digest.hexdigest())
                same.append(decoded == (text or ""))
                if with_ids:
                    ids_out.append(ids.astype(np.int32))
                    text_out.append(decoded)
            columns = [batch.column(0), pa.array(count, pa.int64()), pa.array(of_ids, pa.string()), pa.array(of_bytes, pa.string()), pa.array(same, pa.bool_())]
            names = ["id", "n_tokens", "ids_sha256", "decoded_sha256", "round_trip"]
            if with_ids:
                columns += [pa.array(ids_out, pa.list_(pa.int32())), pa.array(text_out, pa.string())]
                names += ["ids", "decoded"]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    out = docs.select(docs[id_col].cast("bigint").alias("id"), docs[text_col].alias("text")).mapInArrow(run, schema)
    return out.withColumnRenamed("id", id_col)


def _tools(shared) -> tuple[Encoder, Decoder]:
    """The worker's encoder and decoder; kept over tasks, as their tables are worth keeping."""

    def make() -> tuple[Encoder, Decoder]:
        merges = Merges(shared.value)
        return Encoder(merges), Decoder(merges.bytes_of)

    return held(("bpe", getattr(shared, "_bid", id(shared))), make)
