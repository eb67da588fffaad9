"""Byte-level BPE encoding and decoding with a lazily determinised transducer.

The merges (given as ranks, in tiktoken's file format) are compiled into a finite-state
transducer that reads a piece of text byte by byte. Two facts about BPE make it finite:
a part of an encoding is the encoding of its bytes, and a token sequence is an encoding
exactly if every two neighbours are the encoding of their joined bytes. So after each
byte one token ends the encoding of what was read, and only positions from which a longer
token may still grow matter later. A state holds, for each such position, the bytes since
it (a node of the tokens' trie) and the token before it; a transition writes the token that
ends at its byte. Open positions lie no further back than the longest token, so after that
lookahead the tokens on which the ways back from all of them agree are emitted. States and
transitions are made when first needed and kept; a state without exactly one way on (ranks
that no merge order explains) sends the piece to plain merging, so results are right for
any rank file.

Decoding maps ids to bytes and runs an incremental UTF-8 state machine over chunks.

Edge cases: null text is the empty text (no ids, the digests of nothing); repeated rows
give repeated results; an empty table gives an empty table; further columns are passed
through by ``encode_documents`` only if named in ``keep``.
"""

from __future__ import annotations

import base64
import gc
import hashlib
import re
from array import array
from collections.abc import Iterable, Iterator

from pyspark.sql import DataFrame

from candlewick.llm.common import map_documents, per_worker

#: Fixed value: pieces are split by this pattern before merging (also in public_tokenizers.PATTERN).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: The same for ASCII texts, in classes that the standard library's faster engine has.
ASCII_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-z]+| ?[0-9]+| ?[^\sA-Za-z0-9]+|\s+(?!\S)|\s+"""
#: Kept pieces and transitions per worker (some 150 MB); beyond, the tables are emptied and grow anew.
TABLES = (400_000, 300_000)
NEVER = 1 << 62
#: Bits of a token id in a packed number; bytes between two emissions of a long piece.
LOW, EMIT = 24, 4096
MASK = (1 << LOW) - 1


def load_ranks(path: str) -> dict[bytes, int]:
    """Token bytes to rank from a .tiktoken file."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


class Transducer:
    """Pieces of bytes to token ids; see the module's text."""

    def __init__(self, ranks: dict[bytes, int], most: int = TABLES[1]):
        self.ranks, self.most = ranks, most
        self.token = {i: t for t, i in ranks.items()}
        self.size = {i: len(t) for t, i in ranks.items()}
        # the tokens' trie, node 0 being the empty span: a span that leaves it can't grow into a token
        self.child: dict[int, int] = {}
        self.ends, self.inner, self.depth = [None], [True], [0]
        for t, i in ranks.items():
            node = 0
            for byte in t:
                self.inner[node] = True
                key = node << 8 | byte
                node = self.child.get(key)
                if node is None:
                    node = self.child[key] = len(self.ends)
                    self.ends.append(None)
                    self.inner.append(False)
                    self.depth.append(self.depth[key >> 8] + 1)
            self.ends[node] = i
        self.edges: dict[int, list[tuple[bytes, int]] | None] = {}
        self.reset()

    def reset(self) -> None:
        # a state: a number per open position by falling length of its span, the last span being empty:
        # trie node << LOW | token before it + 1
        self.states: list[tuple[int, ...]] = [(0,)]
        self.number = {(0,): 0}
        # state << 8 | byte to next state << LOW | token that ends here, -1: no single way on
        self.steps: dict[int, int] = {}
        self.pairs: dict[int, bool] = {}

    def merged(self, piece: bytes) -> list[int]:
        """Plain merging of the lowest-ranked neighbours, leftmost first."""
        parts, ranks = [piece[i : i + 1] for i in range(len(piece))], self.ranks
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                r = ranks.get(parts[i] + parts[i + 1])
                if r is not None and (best is None or r < best):
                    best, at = r, i
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [ranks[p] for p in parts]

    def split(self, token: bytes) -> tuple[bytes, bytes] | None:
        """The two parts whose merge makes the token; None for a byte or a token that merges never make."""
        parts, ranks = [token[i : i + 1] for i in range(len(token))], self.ranks
        while len(parts) > 2:
            best, at = None, -1
            for i in range(len(parts) - 1):
                r = ranks.get(parts[i] + parts[i + 1])
                if r is not None and (best is None or r < best):
                    best, at = r, i
            if best is None:
                return None
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return (parts[0], parts[1]) if len(parts) == 2 else None

    def edge(self, token: int, right: bool) -> list[tuple[bytes, int]] | None:
        """The parts that stand at the token's edge while it is merged, each with the rank that makes
        the next one; None if merges never make the token."""
        key = token << 1 | right
        if key not in self.edges:
            made, text = [], self.token[token]
            while len(text) > 1:
                parts = self.split(text)
                if parts is None:
                    break
                made.append((parts[right], self.ranks[text]))
                text = parts[right]
            self.edges[key] = None if len(text) > 1 else [*made[::-1], (self.token[token], NEVER)]
        return self.edges[key]

    def follows(self, a: int, b: int) -> bool:
        """Whether token b may stand right after token a (-1: at the start): no merge across their
        border comes before the merges that make them."""
        key = b << LOW | a + 1
        ok = self.pairs.get(key)
        if ok is None:
            if a < 0:
                ok = self.edge(b, False) is not None and self.edge(b, True) is not None
            else:
                ok = self.follows(-1, b) and self.keeps_border(self.edge(a, True), self.edge(b, False))
            self.pairs[key] = ok
        return ok

    def keeps_border(self, left: list[tuple[bytes, int]] | None, right: list[tuple[bytes, int]]) -> bool:
        if left is None:
            return False
        i = j = 0
        while True:
            (x, next_x), (y, next_y) = left[i], right[j]
            across = self.ranks.get(x + y)
            # of equal ranks the leftmost merges first
            if across is not None and across < next_x and across <= next_y:
                return False
            if next_x == next_y == NEVER:
                return True
            if next_x <= next_y:
                i += 1
            else:
                j += 1

    def step(self, state: int, byte: int) -> int:
        """Make the transition: next state and the token ending here, -1 if there is not exactly one way."""
        child, ends, inner, pairs = self.child, self.ends, self.inner, self.pairs
        found, live = None, []
        for span in self.states[state]:
            node = child.get(span >> LOW << 8 | byte)
            if node is None:
                continue
            last = span & MASK
            token = ends[node]
            if token is not None:
                ok = pairs.get(token << LOW | last)
                if ok or ok is None and self.follows(last - 1, token):
                    if found is not None:
                        return -1
                    found = token
            if inner[node]:
                live.append(node << LOW | last)
        if found is None:
            return -1
        live.append(found + 1)
        new = tuple(live)
        number = self.number.get(new)
        if number is None:
            number = self.number[new] = len(self.states)
            self.states.append(new)
        return number << LOW | found

    def way(self, ending: list[int], at: int, stop: int) -> list[int]:
        """Tokens from ``stop`` to ``at``, read backwards over the token ending at each position."""
        out, size = [], self.size
        while at > stop:
            token = ending[at - 1]
            out.append(token)
            at -= size[token]
        out.reverse()
        return out

    def encode(self, piece: bytes) -> list[int]:
        known = self.ranks.get(piece)
        if known is not None:
            return [known]
        if len(self.steps) > self.most:
            self.reset()
        out: list[int] = []
        ending: list[int] = []  # the token that ends at each byte since the last emission
        state, steps = 0, self.steps
        for byte in piece:
            key = state << 8 | byte
            go = steps.get(key)
            if go is None:
                go = steps[key] = self.step(state, byte)
            if go < 0:
                return self.merged(piece)
            state = go >> LOW
            ending.append(go & MASK)
            if not len(ending) % EMIT:
                done = self.agreed(ending, state)
                out += done
                del ending[: sum(self.size[t] for t in done)]
        return out + self.way(ending, len(ending), 0)

    def agreed(self, ending: list[int], state: int) -> list[int]:
        """Tokens that the ways back from all open positions share."""
        starts = [len(ending) - self.depth[span >> LOW] for span in self.states[state]]
        if min(starts) <= 0:
            return []
        ways = [self.way(ending, p, 0) for p in starts]
        shared = 0
        while all(len(w) > shared and w[shared] == ways[0][shared] for w in ways):
            shared += 1
        return ways[0][:shared]


class Pieces(dict):
    """Piece of text to its ids as little-endian unsigned 32-bit integers; made on first use."""

    def __init__(self, transducer: Transducer, most: int = TABLES[0]):
        self.transducer, self.most = transducer, most

    def __missing__(self, piece: str) -> bytes:
        ids = array("I", self.transducer.encode(piece.encode()))
        if ids.itemsize != 4:  # pragma: no cover
            raise TypeError("32-bit integers expected")
        if len(self) >= self.most:
            self.clear()
        self[piece] = found = ids.tobytes()
        return found


class Encoder:
    """Texts to ids: splits by a pattern, then the transducer on each piece."""

    def __init__(self, ranks: dict[bytes, int], pattern: str = PATTERN, tables: tuple[int, int] = TABLES):
        import regex

        self.split = regex.compile(pattern).findall
        self.split_ascii = re.compile(ASCII_PATTERN, re.ASCII).findall if pattern == PATTERN else self.split
        self.transducer = Transducer(ranks, tables[1])
        self.pieces = Pieces(self.transducer, tables[0])

    def encode_bytes(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        split = self.split_ascii if text.isascii() else self.split
        return b"".join(map(self.pieces.__getitem__, split(text)))

    def encode(self, text: str) -> list[int]:
        return array("I", self.encode_bytes(text)).tolist()


class Utf8Stream:
    """Incremental UTF-8 decoding: text for what is complete, the rest waits for the next chunk.

    The state is the unfinished character at the end of what was read (0 to 3 bytes). Bytes
    that can't continue a character become U+FFFD, as in bytes.decode(errors="replace").
    """

    def __init__(self) -> None:
        self.rest = b""

    @staticmethod
    def unfinished(data: bytes) -> int:
        """Bytes at the end that start a character but don't end it."""
        for back in range(1, min(3, len(data)) + 1):
            b = data[-back]
            if b & 0xC0 == 0x80:  # continues a character
                continue
            need = 2 if 0xC2 <= b <= 0xDF else 3 if b & 0xF0 == 0xE0 else 4 if 0xF0 <= b <= 0xF4 else 1
            if need <= back:
                return 0
            if back >= 2:  # the second byte's range rules out overlong forms, surrogates and what lies beyond
                second = data[-back + 1]
                low = {0xE0: 0xA0, 0xF0: 0x90}.get(b, 0x80)
                high = {0xED: 0x9F, 0xF4: 0x8F}.get(b, 0xBF)
                if not low <= second <= high:
                    return 0
            return back
        return 0

    def feed(self, chunk: bytes) -> str:
        data = self.rest + chunk
        cut = len(data) - self.unfinished(data)
        self.rest = data[cut:]
        return data[:cut].decode("utf-8", errors="replace")

    def close(self) -> str:
        left, self.rest = self.rest, b""
        return left.decode("utf-8", errors="replace")


class Decoder:
    """Ids back to bytes or, chunk by chunk, to text."""

    def __init__(self, ranks: dict[bytes, int]):
        self.table: list[bytes | None] = [None] * (max(ranks.values(), default=-1) + 1)
        for t, i in ranks.items():
            self.table[i] = t

    def decode_bytes(self, ids: Iterable[int]) -> bytes:
        return b"".join(map(self.table.__getitem__, ids))

    def stream(self, ids: Iterable[int], chunk: int = 4096) -> Iterator[str]:
        """Text in parts, each ending at a whole character."""
        ids, utf8 = array("I", ids), Utf8Stream()
        for at in range(0, len(ids), chunk):
            yield utf8.feed(self.decode_bytes(ids[at : at + chunk]))
        yield utf8.close()


def encode_documents(docs: DataFrame, ranks_path: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",), pattern: str = PATTERN) -> DataFrame:
    """``keep`` columns and ``ids`` (binary, little-endian unsigned 32-bit) of every whole text."""
    schema = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)

    def factory():
        encoder = Encoder(load_ranks(ranks_path), pattern)

        def apply(*cols):
            *kept, texts = cols
            return dict(zip(keep, kept)) | {"ids": [encoder.encode_bytes(t or "") for t in texts]}

        return apply

    return map_documents(docs.select(*keep, text), f"{schema}, ids binary", factory)


def decode_documents(encoded: DataFrame, ranks_path: str, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns and ``text`` decoded from ``ids``."""
    schema = ", ".join(f"`{c}` {encoded.schema[c].dataType.simpleString()}" for c in keep)

    def factory():
        decoder = Decoder(load_ranks(ranks_path))

        def apply(*cols):
            *kept, ids = cols
            return dict(zip(keep, kept)) | {"text": ["".join(decoder.stream(array("I", x or b""))) for x in ids]}

        return apply

    return map_documents(encoded.select(*keep, "ids"), f"{schema}, text string", factory)


def token_digests(docs: DataFrame, ranks_path: str, pattern: str = PATTERN, tables: tuple[int, int] = TABLES) -> DataFrame:
    """Per document: doc_id, n_tokens, ids_sha256, decoded_sha256; ids are made and decoded in one pass.

    Smaller ``tables`` (kept pieces, kept transitions) take less memory and more time.
    """

    def coders():
        ranks = load_ranks(ranks_path)
        return Encoder(ranks, pattern, tables), Decoder(ranks)

    def factory():
        gc.set_threshold(1_000_000)  # the tables are large and hold no cycles
        encoder, decoder = per_worker(f"bpe {ranks_path} {pattern} {tables}", coders)

        def apply(doc_id, texts):
            n, ids_sha, text_sha = [], [], []
            for t in texts:
                ids = encoder.encode_bytes(t or "")
                n.append(len(ids) // 4)
                ids_sha.append(hashlib.sha256(ids).hexdigest())
                digest = hashlib.sha256()
                for part in decoder.stream(array("I", ids), 1 << 16):
                    digest.update(part.encode())
                text_sha.append(digest.hexdigest())
            return {"doc_id": doc_id, "n_tokens": n, "ids_sha256": ids_sha, "decoded_sha256": text_sha}

        return apply

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    return map_documents(docs.select(docs["doc_id"].cast("long"), "text"), schema, factory)
