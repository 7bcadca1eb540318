"""Byte-level BPE as a lazily determinised transducer, and decoding with an incremental UTF-8 state machine.

A sequence of tokens is what the merges make of its bytes if and only if no merge goes across any of its
seams, which is a matter of two neighbours (`Merges.parts`). So the merges are a nondeterministic
transducer: a state is a last token and the bytes of the next one so far; reading a byte goes on with that
token or, where the bytes are a token that parts from the last one, ends it. Determinised, a state is all
of these at once, each with the tokens that it has ahead of what is common to all; what becomes common is
emitted. No token waits for more bytes than the longest token has. States are made as texts need them, and
forgotten when there are too many, so memory is bounded whatever the texts hold.

Null and empty texts have no ids. Texts of any length are encoded whole, in one pass. Rows are encoded each,
with or without the same id as others; a null id stays null. Strings of special tokens are ordinary text. An
empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import base64
import gc
import hashlib
import re
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

RANKS = "byte_bpe_50k.tiktoken"
#: States of a transducer, seams and whole matches that a task remembers.
MOST_STATES, MOST_SEAMS, MOST_MATCHES = 200_000, 500_000, 400_000
#: Ids that are decoded at once.
AT_ONCE = 4_096

Config = tuple[tuple[int, ...], int, int]  # tokens ahead, last token or -1, node of the next token so far


def read_ranks(name: str = RANKS) -> dict[bytes, int]:
    import public_tokenizers

    with open(public_tokenizers.path(name), "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


class Merges:
    """Which two tokens may stand side by side, by the ranks of tokens' bytes."""

    def __init__(self, ranks: dict[bytes, int]):
        missing = [b for b in range(256) if bytes([b]) not in ranks]
        if missing:
            raise ValueError(f"bytes without a token: {missing[:5]}")
        self.ranks, self.bytes_of = ranks, {r: t for t, r in ranks.items()}
        self._edges: dict[int, tuple[list[bytes], list[bytes]]] = {}
        self._seams: dict[int, bool] = {}

    def edges(self, token: int) -> tuple[list[bytes], list[bytes]]:
        """The pieces that stand at the token's left and right edge while it is merged, first to last."""
        if token not in self._edges:
            text = self.bytes_of[token]
            parts = [text[i : i + 1] for i in range(len(text))]
            left, right = [parts[0]], [parts[-1]]
            while len(parts) > 1:
                rank, i = min((self.ranks.get(parts[i] + parts[i + 1], len(self.ranks)), i) for i in range(len(parts) - 1))
                if rank == len(self.ranks):
                    break
                parts[i : i + 2] = [parts[i] + parts[i + 1]]
                if parts[0] != left[-1]:
                    left.append(parts[0])
                if parts[-1] != right[-1]:
                    right.append(parts[-1])
            # a token that its own merges don't reach never comes of them, and has no edges
            self._edges[token] = (left, right) if len(parts) == 1 else ([], [])
        return self._edges[token]

    def parts(self, first: int, second: int) -> bool:
        """No merge goes across the seam of two tokens; before a text's first token stands none (-1).

        Both sides are merged in order of rank, the left one first on a tie, and at each time the two pieces
        at the seam must not make a token that would come before what either side does next.
        """
        seam = first << 32 | second
        if (known := self._seams.get(seam)) is not None:
            return known
        b = self.edges(second)[0]
        a = self.edges(first)[1] if first >= 0 else []
        i = j = 0
        none = len(self.ranks)
        out = bool(b) and (bool(a) or first < 0)
        while out and a:
            here = self.ranks.get(a[i] + b[j], none)
            on_left = self.ranks[a[i + 1]] if i + 1 < len(a) else none
            on_right = self.ranks[b[j + 1]] if j + 1 < len(b) else none
            if here < on_left and here <= on_right and here < none:
                out = False
            elif on_left == on_right == none:
                break
            elif on_left <= on_right:
                i += 1
            else:
                j += 1
        if len(self._seams) >= MOST_SEAMS:
            self._seams.clear()
        self._seams[seam] = out
        return out


class Transducer:
    """From the bytes of one match to its tokens."""

    def __init__(self, ranks: dict[bytes, int], most_states: int = MOST_STATES):
        self.merges, self.most_states = Merges(ranks), most_states
        # a trie of all tokens: node * 256 + byte gives the next node, 0 is the root
        self.next: dict[int, int] = {}
        self.token, self.inner = [-1], [True]
        for text, rank in ranks.items():
            node = 0
            for byte in text:
                self.inner[node] = True
                key = node << 8 | byte
                if (node := self.next.get(key, 0)) == 0:
                    node = self.next[key] = len(self.token)
                    self.token.append(-1)
                    self.inner.append(False)
            self.token[node] = rank
        self._forget()

    def _forget(self) -> None:
        start: tuple[Config, ...] = (((), -1, 0),)
        self.numbers, self.states = {start: 0}, [start]
        self.moves: dict[int, tuple[int, tuple[int, ...]]] = {}  # by state * 256 + byte

    def step(self, number: int, byte: int) -> tuple[int, tuple[int, ...]]:
        """The state after a byte and the tokens that are sure by then; determinised when it is first asked for.

        The bytes read so far have one sequence of tokens, so just one of the tokens that end here parts
        from what stands before it, and the last one that is left needs no look.
        """
        found: list[Config] = []
        ends: list[tuple[tuple[int, ...], int, int]] = []
        next_of, inner, tokens = self.next.get, self.inner, self.token
        for ahead, last, node in self.states[number]:
            if node := next_of(node << 8 | byte, 0):
                if inner[node]:
                    found.append((ahead, last, node))
                if (token := tokens[node]) >= 0:
                    ends.append((ahead, last, token))
        parts = self.merges.parts
        for ahead, last, token in ends:
            if token == ends[-1][2] or parts(last, token):
                found.append(((*ahead, token), token, 0))
                break
        sure = found[0][0]
        if sure:
            for ahead, _, _ in found:
                n = 0
                while n < len(sure) and n < len(ahead) and sure[n] == ahead[n]:
                    n += 1
                sure = sure[:n]
            if sure:
                found = [(ahead[len(sure) :], last, node) for ahead, last, node in found]
        state = tuple(found)
        if (to := self.numbers.get(state)) is None:
            if len(self.states) >= self.most_states:
                self._forget()
                number = -1
            to = self.numbers[state] = len(self.states)
            self.states.append(state)
        move = to, sure
        if number >= 0:
            self.moves[number << 8 | byte] = move
        return move

    def encode(self, data: bytes) -> list[int]:
        """The tokens of the bytes: those that became sure byte by byte, and in the end those that were still open."""
        number, out = 0, []
        for byte in data:
            number, sure = self.moves.get(number << 8 | byte) or self.step(number, byte)
            if sure:
                out += sure
        for ahead, _, node in reversed(self.states[number]):
            if node == 0:
                out += ahead
                break
        return out


class Matcher:
    """The matches of the public pattern in a text, with characters classed as the library classes them that the ids must agree with.

    Libraries know different editions of Unicode. Texts with a character that they class differently (odd)
    are matched with the classes spelled out, which takes longer. Made once, on the driver.
    """

    def __init__(self) -> None:
        import public_tokenizers
        import regex
        import tiktoken

        self.pattern = public_tokenizers.PATTERN
        every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
        one_byte = {bytes([b]): b for b in range(256)}
        spelled, odd = {}, np.zeros(0x110000, bool)
        for c in (r"\p{L}", r"\p{N}", r"\s"):
            theirs = tiktoken.Encoding("class", pat_str=c + "+", mergeable_ranks=one_byte, special_tokens={}).encode_to_numpy(every)
            theirs = self._flags(theirs.astype("uint8").tobytes().decode())
            odd |= theirs != self._flags("".join(regex.findall(c + "+", every)))
            starts, ends = np.flatnonzero(theirs[1:] & ~theirs[:-1]) + 1, np.flatnonzero(theirs[:-1] & ~theirs[1:])
            spelled[c] = "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in zip(starts, ends, strict=True))
        self.odd = frozenset(map(chr, np.flatnonzero(odd)))
        letters, numbers, spaces = spelled.values()
        exact = self.pattern.replace(r"[^\s\p{L}\p{N}]", f"[^{spaces}{letters}{numbers}]").replace(r"\S", f"[^{spaces}]").replace(r"\s", f"[{spaces}]")
        self.spelled = exact.replace(r"\p{L}", f"[{letters}]").replace(r"\p{N}", f"[{numbers}]")

    @staticmethod
    def _flags(text: str) -> np.ndarray:
        out = np.zeros(0x110000, bool)
        out[np.frombuffer(text.encode("utf-32-le"), "u4")] = True
        return out

    def compiled(self) -> Callable[[str], list[str]]:
        import regex

        plain, exact, odd = regex.compile(self.pattern).findall, re.compile(self.spelled).findall, self.odd
        return lambda text: plain(text) if text.isascii() or odd.isdisjoint(text) else exact(text)


class Encoder:
    """Ids of whole texts: each match of the public pattern by itself. Matches that come again are remembered, up to a bound."""

    def __init__(self, ranks: dict[bytes, int], matcher: Matcher, most_matches: int = MOST_MATCHES):
        self.transducer, self.matches = Transducer(ranks), matcher.compiled()
        self.known: dict[str, list[int]] = {}
        self.most = most_matches

    def encode(self, text: str) -> list[int]:
        out: list[int] = []
        known = self.known
        for match in self.matches(text):
            ids = known.get(match)
            if ids is None:
                ids = self.transducer.encode(match.encode())
                if len(match) <= 64:
                    if len(known) >= self.most:
                        known.clear()
                    known[match] = ids
            out += ids
        return out


#: What may follow in a character: the least and the greatest next byte, and how many bytes after that one.
_PLAIN = {n: (0x80, 0xBF, n - 1) for n in (1, 2, 3)}
_LEADS = {b: _PLAIN[1] for b in range(0xC2, 0xE0)} | {b: _PLAIN[2] for b in range(0xE1, 0xF0)} | {b: _PLAIN[3] for b in range(0xF1, 0xF4)}
_LEADS |= {0xE0: (0xA0, 0xBF, 1), 0xED: (0x80, 0x9F, 1), 0xF0: (0x90, 0xBF, 2), 0xF4: (0x80, 0x8F, 2)}


class Utf8:
    """Incremental UTF-8: gives on whole characters and holds back the bytes of one that has only begun.

    The state is what a next byte must be, None between characters. Only the last three bytes can belong to
    a character that isn't whole, so the machine runs from the last leading byte among them.
    """

    def __init__(self) -> None:
        self.held = b""

    @staticmethod
    def state(tail: bytes) -> tuple[int, int, int] | None:
        """The state after a leading byte and what follows it."""
        at = _LEADS.get(tail[0])
        for byte in tail[1:]:
            if at is None or not at[0] <= byte <= at[1]:
                return None
            at = _PLAIN.get(at[2])
        return at

    def feed(self, data: bytes) -> bytes:
        data = self.held + data
        for k in range(1, min(3, len(data)) + 1):
            if data[-k] in _LEADS:
                if self.state(data[-k:]) is not None:
                    self.held = data[-k:]
                    return data[:-k]
                break
        self.held = b""
        return data

    def end(self) -> bytes:
        """What is left: bytes that never became a character."""
        rest, self.held = self.held, b""
        return rest


def decoded(ids: Iterable[int], bytes_of: dict[int, bytes]) -> Iterator[bytes]:
    """The bytes of ids in parts that end between characters; bytes that are no character at all are given on as they are."""
    machine, ids = Utf8(), list(ids)
    for i in range(0, len(ids), AT_ONCE):
        yield machine.feed(b"".join([bytes_of[t] for t in ids[i : i + AT_ONCE]]))
    yield machine.end()


def encode(docs: DataFrame, ranks: str = RANKS) -> DataFrame:
    """(doc_id, ids) of every row of docs (doc_id, text)."""

    matcher = Matcher()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        gc.disable()  # as below
        encoder = Encoder(read_ranks(ranks), matcher)
        for pdf in batches:
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "ids": [np.array(encoder.encode(t or ""), "int32") for t in pdf["text"]]})

    rows = docs.select(F.col("doc_id").cast("string").alias("doc_id"), "text").mapInPandas(run, "doc_id string, ids array<int>")
    return rows.select(F.col("doc_id").cast("long").alias("doc_id"), "ids")


def decode(rows: DataFrame, ranks: str = RANKS) -> DataFrame:
    """(doc_id, text) of every row of rows (doc_id, ids); what is no character becomes U+FFFD, null ids give null."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bytes_of = Merges(read_ranks(ranks)).bytes_of
        for pdf in batches:
            texts = [None if ids is None else "".join(part.decode("utf-8", "replace") for part in decoded(ids, bytes_of)) for ids in pdf["ids"]]
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "text": texts})

    out = rows.select(F.col("doc_id").cast("string").alias("doc_id"), "ids").mapInPandas(run, "doc_id string, text string")
    return out.select(F.col("doc_id").cast("long").alias("doc_id"), "text")


def round_trip(docs: DataFrame, ranks: str = RANKS) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): digests of every text's ids and of the bytes that they decode to.

    Both ways run in one task, text by text, so that ids needn't be shuffled or stored.
    """

    matcher = Matcher()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        gc.disable()  # states and matches are many and hold no cycles; looking through them again and again takes half the time
        encoder = Encoder(read_ranks(ranks), matcher)
        bytes_of = encoder.transducer.merges.bytes_of
        for pdf in batches:
            out = []
            for doc_id, text in zip(pdf["doc_id"], pdf["text"], strict=True):
                ids, back = encoder.encode(text or ""), hashlib.sha256()
                for part in decoded(ids, bytes_of):
                    back.update(part)
                out.append((doc_id, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), back.hexdigest()))
            yield pd.DataFrame(out, columns=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    rows = docs.select(F.col("doc_id").cast("string").alias("doc_id"), "text").mapInPandas(run, "doc_id string, n_tokens long, ids_sha256 string, decoded_sha256 string")
    return rows.select(F.col("doc_id").cast("long").alias("doc_id"), "n_tokens", "ids_sha256", "decoded_sha256")
