"""BPE encoding and decoding as streaming transducers.

Encoding. Symbols of a pre-token are read one by one. For every position the transducer keeps only the last
token of the encoding of what was read so far: it is the one token ending there whose pair with the last token
of the remaining prefix is itself left unmerged by the merge list. A token is emitted once every later
encoding must contain it: when the open positions agree on it, or when it lies further back than the
merge list's sufficient lookahead (``lookahead``). What the transducer holds is therefore bounded by that lookahead,
not by the text. Every pre-token passes it, whatever its length; short ones that recur are remembered in a bounded
cache. A text is read in pieces that end at white space, and its ids go out piece by piece.

Decoding. Token ids become bytes and pass a byte-to-text state machine that holds back at most three bytes; it takes
the ids as they come, so neither all ids nor the decoded text are held.

Defined results: a null text encodes as an empty one (no tokens, empty decoded text); rows are independent,
so ties, repeated rows and extra columns do not matter.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from array import array
from collections.abc import Iterable, Iterator

import regex
from pyspark.sql import DataFrame

from tessera.llm.common import map_rows

WORD_END = chr(0xE000)  # stands for the word-end mark inside the transducer
CACHED_WORDS = 200_000  # pre-tokens remembered by a worker
CACHED_CHUNKS = 60_000  # stretches without white space remembered by a worker
CACHED_PAIRS = 200_000  # token pairs whose verdict a worker remembers
LONG_WORD = 64  # longer pre-tokens are not remembered
PIECE = 1 << 16  # characters of a text, or ids, that go out together

#: Characters with the Unicode property White_Space.
SPACES = "".join(map(chr, [*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))
#: Characters that Python takes for white space and Unicode doesn't.
SEPARATORS = "".join(map(chr, range(28, 32)))

# Letters, numbers and capitals (first, last, first small letter) that are younger than the tables of one
# of the two sides, which the tokenizers library reads as neither letters nor numbers, or lower-cases.
YOUNG_LETTERS = "558 58b-58c 88f c5c cdc 208f 209d-209f a7ce-a7cf a7d2 a7d4 a7dd a7e2 a7f1 ab6c-ab6d 107bb-107bf 10940-10959 10ec5-10ec7 10ed9-10eee 11b0a 11db0-11ddb 11df1 16ea0-16eb8 16ebb-16ed3 16ff2-16ff3 187f8-187ff 18cd6-18cda 18d09-18d20 18d80-18df2 18e00-19191 191a0-191d2 1b123-1b128 1b168 1d6a6 1df1f-1df24 1df2b-1df81 1df90-1df96 1dfcd-1dfff 1e6c0-1e6de 1e6e0-1e6e2 1e6e4-1e6e5 1e6e7-1e6ed 1e6f0-1e6f4 1e6fe-1e6ff 2b73a-2b73f 2b81e 2cea2-2cead 323b0-33479 3d000-3fc3f"
YOUNG_NUMBERS = "11de0-11de9 1246f 12475-1247f 12550-12686 16ff4-16ff6"
YOUNG_CAPITALS = ((0x1C89, 0x1C89, 0x1C8A), (0xA7CB, 0xA7CB, 0x264), (0xA7CC, 0xA7CC, 0xA7CD), (0xA7CE, 0xA7CE, 0xA7CF), (0xA7D2, 0xA7D2, 0xA7D3), (0xA7D4, 0xA7D4, 0xA7D5), (0xA7DA, 0xA7DA, 0xA7DB), (0xA7DC, 0xA7DC, 0x19B), (0x10D50, 0x10D65, 0x10D70), (0x16EA0, 0x16EB8, 0x16EBB))


def _class(ranges: str) -> str:
    """Hexadecimal ranges as the inside of a character class."""
    return "".join("-".join(f"\\U{x:0>8}" for x in r.split("-")) for r in ranges.split())


def byte_letters() -> dict[int, str]:
    """The printable stand-in of each byte: itself where printable, else the next letter from 256 on."""
    keep = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(keep)]
    return {b: chr(b) for b in keep} | {b: chr(256 + i) for i, b in enumerate(rest)}


class Vocabulary:
    """A merge list, its tokens, their merge trees and its sufficient lookahead."""

    def __init__(self, data: bytes):
        spec = json.loads(data)
        model = spec["model"]
        self.suffix = model.get("end_of_word_suffix") or ""
        self.ids: dict[str, int] = {}
        for token, i in model["vocab"].items():
            self.ids[self._inner(token)] = i
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.merges: dict[tuple[int, int], tuple[int, int]] = {}  # pair of ids -> rank, id
        self.parts: dict[int, tuple[int, int]] = {}
        self.rank: dict[int, int] = {}
        for rank, merge in enumerate(model["merges"]):
            left, right = (self._inner(x) for x in (merge if isinstance(merge, list) else merge.split(" ")))
            a, b, made = self.ids[left], self.ids[right], self.ids[left + right]
            self.merges.setdefault((a, b), (rank, made))
            if made not in self.parts:
                self.parts[made] = (a, b)
                self.rank[made] = rank
        # A token that no merges make can only be a single symbol; others never come out of an encoding.
        self.tokens = {t: i for t, i in self.ids.items() if i in self.parts or len(t.rstrip(WORD_END)) == 1}
        self.longest = max(len(t) for t in self.tokens)
        # Every ending of a token, with the token that it is itself: walked backwards from a position, they give the
        # tokens that end there.
        self.endings: dict[str, int] = {t[k:]: -1 for t in self.tokens for k in range(len(t))} | self.tokens
        self.lookahead = self._lookahead()
        self.text = {i: t.replace(WORD_END, self.suffix).encode() for t, i in self.ids.items()} | {i: t.encode() for t, i in self.added.items()}
        self.letters = byte_letters()
        self._pairs: dict[tuple[int, int], bool] = {}
        self._right: dict[int, list] = {}
        self._left: dict[int, list] = {}

    def _inner(self, token: str) -> str:
        return token[: -len(self.suffix)] + WORD_END if self.suffix and token.endswith(self.suffix) else token

    def _lookahead(self) -> int:
        """Symbols after which a token can no longer change. A symbol read later can undo a merge only by an
        earlier-ranked merge to its right, which frees its left part for a later-ranked one, and so on:
        along such a chain ranks rise from right to left. The longest chain, times the longest token, bounds it."""
        reach: dict[int, int] = {}
        longest = 0
        for (a, b), _ in sorted(self.merges.items(), key=lambda kv: kv[1][0]):
            piece, here = b, reach.get(b, 0)
            while piece in self.parts:
                piece = self.parts[piece][1]
                here = max(here, reach.get(piece, 0))
            longest = max(longest, here + 1)
            reach[a] = max(reach.get(a, 0), here + 1)
        return (longest + 1) * self.longest

    def _spine(self, token: int, side: int) -> list[tuple[int, int, int]]:
        """The pieces at one edge of a token, outermost first: id, rank that makes it, rank that uses it up."""
        out, used = [], len(self.merges) + 1
        while True:
            born = self.rank.get(token, -1)
            out.append((token, born, used))
            if token not in self.parts:
                return out
            used, token = born, self.parts[token][side]

    def apart(self, a: int, b: int) -> bool:
        """Whether two tokens side by side stay two tokens: no merge crosses the border between them while
        the pieces it needs are both there. Of equal ranks the left one goes first."""
        got = self._pairs.get((a, b))
        if got is None:
            if len(self._pairs) >= CACHED_PAIRS:
                self._pairs.clear()
                self._right.clear()
                self._left.clear()
            right = self._right.get(a) or self._right.setdefault(a, self._spine(a, 1))
            left = self._left.get(b) or self._left.setdefault(b, self._spine(b, 0))
            got = self._pairs[a, b] = not any(
                (found := self.merges.get((x, y))) and found[0] < x_used and found[0] <= y_used
                for x, x_born, x_used in right
                for y, y_born, y_used in left
                if x_born <= y_used and y_born < x_used
            )
        return got


class Encoder:
    """The transducer for one pre-token: ``push`` its symbols, then ``finish``."""

    def __init__(self, vocabulary: Vocabulary):
        self.v = vocabulary
        self.text = ""  # symbols since the last emitted token
        self.last: list[tuple[int, int]] = [(-1, 0)]  # for each position: last token (-2: none), where it starts
        self.before = -1  # the last emitted token
        self.window = 2 * vocabulary.longest

    def _extend(self, start: int) -> None:
        """The token that ends here: of the tokens that do, the one that stays apart from the token before it."""
        text, last = self.text, self.last
        endings, pairs, apart = self.v.endings.get, self.v._pairs, self.v.apart
        while start >= 0:
            token = endings(text[start:])
            if token is None:
                break
            if token >= 0:
                left = last[start][0] if start else self.before
                if left == -1:
                    last.append((token, start))
                    return
                if left >= 0:
                    verdict = pairs.get((left, token))
                    if apart(left, token) if verdict is None else verdict:
                        last.append((token, start))
                        return
            start -= 1
        last.append((-2, 0))

    def push(self, symbol: str) -> list[int]:
        self._extend_by(symbol)
        return self._settle() if len(self.text) > self.window else []

    def _extend_by(self, symbol: str) -> None:
        start = len(self.text)
        self.text += symbol
        self._extend(start)

    def finish(self, symbol: str) -> list[int]:
        """The last symbol, with the word-end mark where the vocabulary has one."""
        self._extend_by(symbol + WORD_END if self.v.suffix else symbol)
        if self.v.suffix:  # the mark is a position of its own, which only whole tokens reach
            self.last.insert(-1, (-2, 0))
        return [t for t, _ in self._path(len(self.text))]

    def _path(self, at: int) -> list[tuple[int, int]]:
        """Tokens and their ends, first to last, of the encoding up to ``at``."""
        out = []
        while at:
            token, start = self.last[at]
            if token < 0:
                raise ValueError("a symbol is not in the vocabulary")
            out.append((token, at))
            at = start
        return out[::-1]

    def _settle(self) -> list[int]:
        """Emit the tokens that all open positions share, or that lie beyond the lookahead."""
        n = len(self.text)
        if self.last[n][0] < 0:
            return []
        agreed = self._path(n)
        for at in range(max(1, n - self.v.longest + 1), n):
            if self.last[at][0] < 0:
                continue
            other = self._path(at)
            same = 0
            while same < min(len(agreed), len(other)) and agreed[same] == other[same]:
                same += 1
            agreed = agreed[:same]
            if not agreed:
                break
        if not agreed and n > self.v.lookahead + self.v.longest:
            agreed = [x for x in self._path(n) if x[1] <= n - self.v.lookahead]
        if not agreed:
            return []
        cut = agreed[-1][1]
        self.before = agreed[-1][0]
        self.text = self.text[cut:]
        self.last = [(-1, 0), *((t, s - cut) if s >= cut else (-2, 0) for t, s in self.last[cut + 1 :])]
        return [t for t, _ in agreed]


class Tokenizer:
    """Normalises, splits into pre-tokens, and runs the transducer on each."""

    def __init__(self, data: bytes):
        self.v = Vocabulary(data)
        self.pattern = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|\p{{L}}+|\p{{N}}|[^{SPACES}\p{{L}}\p{{N}}]+")
        # The same with young characters as the library takes them, for the few texts that hold one.
        letter, number = rf"[\p{{L}}--[{_class(YOUNG_LETTERS)}]]", rf"[\p{{N}}--[{_class(YOUNG_NUMBERS)}]]"
        self.careful = regex.compile(rf"(?V1)'s|'t|'re|'ve|'m|'ll|'d|{letter}+|{number}|[^{SPACES}{letter}{number}]+")
        self.capitals = {a + i: c + i for a, b, c in YOUNG_CAPITALS for i in range(b - a + 1)}
        self.young = re.compile(f"[{_class(YOUNG_LETTERS)}{_class(YOUNG_NUMBERS)}{re.escape(''.join(map(chr, self.capitals)))}]")
        self.special = regex.compile("(" + "|".join(map(regex.escape, self.v.added)) + ")") if self.v.added else None
        self.late = re.compile(r"[\u0558-\U0010FFFF]")  # no young character comes before
        self.spaces = re.compile(f"[{SPACES}]+")
        self.words: dict[str, bytes] = {}
        self.old_words: dict[str, bytes] = {}
        self.chunks: dict[str, bytes] = {}
        self.old_chunks: dict[str, bytes] = {}

    def is_young(self, text: str) -> bool:
        """Whether a text holds a young character: rare, and cheap to rule out."""
        return not text.isascii() and self.late.search(text) is not None and self.young.search(text) is not None

    def chunks_of(self, text: str) -> list[str]:
        """The normalised text between white space; no pre-token reaches across it."""
        text = unicodedata.normalize("NFC", text)
        if "Σ" in text:  # letters are lower-cased one by one, so a final one is no exception
            text = text.replace("Σ", "σ")
        if self.is_young(text):
            return self.spaces.split(text.lower().translate(self.capitals))
        if any(c in text for c in SEPARATORS):
            return self.spaces.split(text.lower())
        return text.lower().split()

    def chunk(self, chunk: str) -> bytes:
        """The ids of a short stretch without white space."""
        packed = self.old_chunks.get(chunk)
        if packed is None:
            packed = b"".join(self.word(m[0]) for m in self.pattern_for(chunk).finditer(chunk))
        if len(self.chunks) >= CACHED_CHUNKS:  # two generations: what is used again is kept
            self.old_chunks, self.chunks = self.chunks, {}
        self.chunks[chunk] = packed
        return packed

    def pattern_for(self, chunk: str):
        return self.careful if self.is_young(chunk) else self.pattern

    def word(self, word: str) -> bytes:
        """The ids of a short pre-token, packed."""
        packed = self.words.get(word)
        if packed is None:
            packed = self.old_words.get(word)
            if packed is None:
                packed = b"".join(self.transduce(word))
            if len(self.words) >= CACHED_WORDS:
                self.old_words, self.words = self.words, {}
            self.words[word] = packed
        return packed

    def transduce(self, word: str) -> Iterator[bytes]:
        """The ids of a pre-token, packed, as they come out."""
        run, letters = Encoder(self.v), self.v.letters
        data = word.encode("utf-8")
        held: list[int] = []
        for b in data[:-1]:
            out = run.push(letters[b])
            if out:
                held += out
                if len(held) >= PIECE:
                    yield array("I", held).tobytes()
                    held = []
        yield array("I", held + run.finish(letters[data[-1]])).tobytes()

    def stream(self, text: str) -> Iterator[bytes]:
        """Ids as packed unsigned 32-bit integers, little-endian, piece by piece."""
        parts = self.special.split(text) if self.special and "<|" in text else [text]
        for k, part in enumerate(parts):
            if k % 2:
                yield array("I", [self.v.added[part]]).tobytes()
                continue
            for piece in self.pieces(part):
                out: list[bytes] = []
                known = self.chunks.get
                for c in self.chunks_of(piece):
                    if len(c) <= LONG_WORD:
                        if c:
                            out.append(known(c) or self.chunk(c))
                            known = self.chunks.get
                        continue
                    for m in self.pattern_for(c).finditer(c):
                        if len(m[0]) <= LONG_WORD:
                            out.append(self.word(m[0]))
                        else:
                            out += self.transduce(m[0])
                        if len(out) >= PIECE:
                            yield b"".join(out)
                            out = []
                yield b"".join(out)

    def pieces(self, text: str) -> Iterator[str]:
        """A text cut before white space, which nothing reaches across, at every PIECE characters or later."""
        at = 0
        while len(text) - at > PIECE:
            m = self.spaces.search(text, at + PIECE)
            if not m:
                break
            yield text[at : m.start()]
            at = m.start()
        if at < len(text):
            yield text[at:] if at else text

    def encode(self, text: str) -> bytes:
        return b"".join(self.stream(text))

    def decode(self, packed: bytes) -> str:
        run = Decoder(self.v)
        return run.push(array("I", packed)) + run.finish()

    def digests(self, text: str) -> tuple[int, str, str]:
        """Number of ids, and SHA-256 of the ids and of the text decoded from them, without holding either."""
        count, ids, decoded, run = 0, hashlib.sha256(), hashlib.sha256(), Decoder(self.v)
        for packed in self.stream(text):
            count += len(packed) // 4
            ids.update(packed)
            decoded.update(run.push(array("I", packed)).encode("utf-8"))
        decoded.update(run.finish().encode("utf-8"))
        return count, ids.hexdigest(), decoded.hexdigest()


class Decoder:
    """Ids in, text out: tokens as written in the vocabulary with one space between them."""

    def __init__(self, vocabulary: Vocabulary):
        self.text, self.machine, self.first = vocabulary.text, TextMachine(), True

    def push(self, ids: Iterable[int]) -> str:
        data = b" ".join(map(self.text.__getitem__, ids))
        if not data:
            return ""
        data, self.first = data if self.first else b" " + data, False
        return self.machine.push(data)

    def finish(self) -> str:
        return self.machine.finish()


class TextMachine:
    """Bytes in, text out: complete characters go out at once, an incomplete one (three bytes at most) waits."""

    def __init__(self) -> None:
        self.held = b""

    def push(self, data: bytes) -> str:
        data = self.held + data
        keep = 0
        for back in range(1, min(3, len(data)) + 1):
            lead = data[-back]
            if lead >= 0xC0:
                need = 2 if lead < 0xE0 else 3 if lead < 0xF0 else 4
                keep = back if need > back else 0
                break
            if lead < 0x80:
                break
        self.held = data[len(data) - keep :]
        return data[: len(data) - keep].decode("utf-8", "replace")

    def finish(self) -> str:
        out, self.held = self.held.decode("utf-8", "replace"), b""
        return out


_LOADED: dict[str, Tokenizer] = {}


def load(data: bytes) -> Tokenizer:
    """One tokenizer a worker process and vocabulary."""
    key = hashlib.sha256(data).hexdigest()
    if key not in _LOADED:
        _LOADED[key] = Tokenizer(data)
    return _LOADED[key]


def encode_column(df: DataFrame, key: str, text: str, vocabulary: str) -> DataFrame:
    """Encode every whole text and decode it again. Ids and decoded text come out as digests and counts.
    ``vocabulary``: path of the tokenizer's file, read by the driver and sent to the workers (its size is fixed)."""
    with open(vocabulary, "rb") as f:
        shared = df.sparkSession.sparkContext.broadcast(f.read())
    keyed = df.select(df[key].alias("k"), df[text].alias("t"))

    def rows(parts):
        tokenizer = load(shared.value)
        for part in parts:
            out = [(k, *tokenizer.digests(t or "")) for k, t in zip(part["k"], part["t"])]
            yield list(zip(*out)) if out else [[] for _ in range(4)]

    return map_rows(keyed, f"{key} {keyed.schema['k'].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string", rows)


def tokens_column(df: DataFrame, key: str, text: str, vocabulary: str) -> DataFrame:
    """The ids and the decoded text themselves."""
    with open(vocabulary, "rb") as f:
        shared = df.sparkSession.sparkContext.broadcast(f.read())
    keyed = df.select(df[key].alias("k"), df[text].alias("t"))

    def rows(parts):
        tokenizer = load(shared.value)
        for part in parts:
            ids = [tokenizer.encode(t or "") for t in part["t"]]
            yield [part["k"], [array("I", i).tolist() for i in ids], [tokenizer.decode(i) for i in ids]]

    return map_rows(keyed, f"{key} {keyed.schema['k'].dataType.simpleString()}, ids array<long>, decoded string", rows)
