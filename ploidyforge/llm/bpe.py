"""Byte-pair encoding: vocabularies, merging, whole-token shortcut, and a dynamic program over prefixes.

Merging takes the learned pair of lowest rank again and again. Two faster exact ways stand on it:
``WholeTokens`` counts tokens of pre-tokens, most of which are one proven vocabulary entry, and
``PrefixEncoder`` finds the ids of a word without merging it.
"""

from __future__ import annotations

import gc
import heapq
import json
import re
import unicodedata
from array import array
from sys import byteorder, getsizeof

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex

#: Fixed patterns of the two public vocabularies.
BYTE_LEVEL_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Largest vocabulary file that may be broadcast.
MAX_VOCABULARY_BYTES = 64 << 20


def byte_alphabet() -> dict[int, str]:
    """The printable stand-in of every byte: itself where printable in Latin-1, otherwise from U+0100 on."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    table = {b: chr(b) for b in printable}
    for b in range(256):
        table.setdefault(b, chr(256 + len(table) - len(printable)))
    return table


STAND_IN = byte_alphabet()


def stand_ins(text: str) -> str:
    return text.encode("utf-8").decode("latin-1").translate(STAND_IN)


def read_vocabulary(path: str) -> str:
    """Text of a vocabulary file, checked against the broadcast bound."""
    with open(path, encoding="utf-8") as f:
        text = f.read()
    if len(text) > MAX_VOCABULARY_BYTES:
        raise ValueError(f"{path} is larger than {MAX_VOCABULARY_BYTES} bytes")
    return text


def special_split(special: dict[str, int]):
    """A pattern that cuts a text around special strings and keeps them; None without any."""
    return regex.compile("(" + "|".join(map(regex.escape, special)) + ")") if special else None


class Vocabulary:
    """Token ids, merge ranks, word-end mark and special strings of a tokenizer file in JSON."""

    def __init__(self, text: str) -> None:
        spec = json.loads(text)
        model = spec["model"]
        self.ids: dict[str, int] = model["vocab"]
        self.ranks = {tuple(m if isinstance(m, list) else m.split(" ")): k for k, m in enumerate(model["merges"])}
        self.word_end: str = model.get("end_of_word_suffix") or ""
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.strings = {i: s for s, i in (self.ids | self.special).items()}
        self.special_split = special_split(self.special)

    def symbols(self, mapped: str) -> list[str]:
        return [*mapped[:-1], mapped[-1] + self.word_end] if mapped else []

    def merge(self, symbols: list[str]) -> list[str]:
        """Tokens of a symbol list: the adjacent pair of lowest rank, leftmost first, is joined until none is left."""
        return self._merge_short(symbols) if len(symbols) <= 48 else self._merge_long(symbols)

    def _merge_short(self, parts: list[str]) -> list[str]:
        ranks, none, parts = self.ranks, len(self.ranks), list(parts)
        while len(parts) > 1:
            at = [ranks.get(pair, none) for pair in zip(parts, parts[1:])]
            best = min(at)
            if best == none:
                break
            k = at.index(best)
            parts[k:k + 2] = [parts[k] + parts[k + 1]]
        return parts

    def _merge_long(self, symbols: list[str]) -> list[str]:
        """The same with a heap over a linked list, for texts without word breaks."""
        parts: list[str | None] = list(symbols)
        n = len(parts)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, k, parts[k], parts[k + 1]) for k in range(n - 1) if (r := self.ranks.get((parts[k], parts[k + 1]))) is not None]
        heapq.heapify(heap)
        while heap:
            _, k, left, right = heapq.heappop(heap)
            m = after[k]
            if parts[k] != left or m >= n or parts[m] != right:
                continue
            parts[k], parts[m] = left + right, None
            after[k] = after[m]
            if after[k] < n:
                before[after[k]] = k
            for i, j in ((before[k], k), (k, after[k])):
                if i >= 0 and j < n and (r := self.ranks.get((parts[i], parts[j]))) is not None:
                    heapq.heappush(heap, (r, i, parts[i], parts[j]))
        return [p for p in parts if p is not None]

    def proven(self) -> list[str]:
        """Vocabulary strings that encode alone as the one token that they name. Worked out once, on the driver."""
        marked = self.word_end
        found = []
        for token in self.ids:
            if marked:
                core, last = (token[:-len(marked)], marked) if token.endswith(marked) and token != marked else (token, "")
                symbols = [*core[:-1], core[-1] + last] if core else [token]
            else:
                symbols = list(token)
            if self.merge(symbols) == [token]:
                found.append(token)
        return found


#: Bytes that the table of one operator may take in a Python worker, and of the longest key that is kept in it.
TABLE_BYTES, KEY_BYTES = 64 << 20, 160
#: What an entry takes besides its key and value, roughly: its place in the dictionary.
SLOT_BYTES = 80


class Memo(dict):
    """A table that works out missing entries and stays within most bytes, whatever the entries.

    It has two generations of half the size each: when the young one is full it becomes the old one, whose entries
    come back as they are used and else go with the next change. Keys over KEY_BYTES are not kept.
    """

    def __init__(self, work, most: int = TABLE_BYTES) -> None:
        super().__init__()
        self.work, self.most, self.size, self.old = work, most // 2, 0, {}

    def __missing__(self, key):
        value = self.old.pop(key, None)
        if value is None:
            value = self.work(key)
        size = getsizeof(key)
        if size > KEY_BYTES:
            return value
        self.size += SLOT_BYTES + size + getsizeof(value)
        if self.size > self.most:
            self.old, self.size = dict(self), 0
            self.clear()
        self[key] = value
        return value


_HELD: dict = {}


def held(name: tuple, build):
    """What an operator keeps between the tasks of a Python worker: built once, and let go as soon as another operator
    keeps something, so that a worker never holds the tables of two."""
    if name not in _HELD:
        _HELD.clear()
        gc.collect()  # encoders and their tables refer to each other
        _HELD[name] = build()
    return _HELD[name]


class WholeTokens:
    """Counts the tokens of texts under a byte-level vocabulary.

    Offline every vocabulary string is merged alone; those that come out as one token are the whole
    tokens. In a text the pre-tokens among them count one each, and only the rest are merged, once for
    each distinct form while it is in a table of bounded size.
    """

    def __init__(self, vocabulary: Vocabulary, proven: list[str], most: int = 2 * TABLE_BYTES) -> None:
        self.vocabulary = vocabulary
        self.pattern = regex.compile(BYTE_LEVEL_PATTERN)
        back = {ord(c): b for b, c in STAND_IN.items()}
        self.whole: set[str] = set()
        for token in proven:
            try:
                self.whole.add(bytes(back[ord(c)] for c in token).decode("utf-8"))
            except UnicodeDecodeError:  # part of a character: never a whole pre-token
                continue
        self.chunks = Memo(lambda chunk: self.merged(" " + chunk), most)
        self.uneven = regex.compile(r" \s| $")

    def merged(self, text: str) -> int:
        whole, total = self.whole, 0
        for piece in self.pattern.findall(text):
            total += 1 if piece in whole else len(self.vocabulary.merge(list(stand_ins(piece))))
        return total

    def plain(self, text: str) -> int:
        """Tokens of a text without special strings. Before a space that a non-space follows a pre-token always ends."""
        if self.uneven.search(text):
            return self.merged(text)
        first, *rest = text.split(" ")
        return self.merged(first) + sum(map(self.chunks.__getitem__, rest))

    def count(self, text: str) -> int:
        split = self.vocabulary.special_split
        if split is None or not any(s in text for s in self.vocabulary.special):
            return self.plain(text)
        return sum(1 if part in self.vocabulary.special else self.plain(part) for part in split.split(text) if part)


class WordSplitter:
    """Cuts texts into special strings and words as the word vocabulary's file says: canonical composition, white
    space to a space, case folded by character, then runs of letters, single digits and runs of other signs."""

    def __init__(self, special: dict[str, int]) -> None:
        self.special, self.split = special, special_split(special)
        self.pattern = regex.compile(WORD_PATTERN)
        self.space = regex.compile(r"\s+")
        # most stretches of a text are of this kind: Latin-1 letters (already composed), then ASCII signs but apostrophes
        self.plain = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]+)([!-&(-/:-@\[-`{-~]*)").fullmatch

        # unless a special string could lie within such a stretch
        self.quick = not any(re.fullmatch(r"[A-Za-zÀ-ÖØ-öø-ÿ]*[!-&(-/:-@\[-`{-~]*", x) for x in special)

    def words(self, text: str) -> list[str]:
        """Words of a text without special strings, in the byte alphabet."""
        if found := self.plain(text):
            return self._plain_words(found)
        folded = "".join(map(str.lower, self.space.sub(" ", unicodedata.normalize("NFC", text))))
        return list(map(stand_ins, self.pattern.findall(folded)))

    @staticmethod
    def _plain_words(found: re.Match) -> list[str]:
        word = found[1].lower()
        word = word if word.isascii() else stand_ins(word)
        return [word, found[2]] if found[2] else [word]

    def encode(self, text: str, ids_of) -> list[int]:
        """Ids of a text, given those of its words."""
        if self.quick and (found := self.plain(text)):
            return [i for word in self._plain_words(found) for i in ids_of(word)]
        special, ids = self.special, []
        parts = self.split.split(text) if any(s in text for s in special) else [text]
        for part in parts:
            if part in special:
                ids.append(special[part])
            elif part:
                for word in self.words(part):
                    ids += ids_of(word)
        return ids


class LibraryEncoder:
    """Packed ids by the tokenizers library: its model encodes each stretch between spaces once while it is in a table of
    bounded size. Spaces and line ends never lie inside a word or a special string."""

    def __init__(self, text: str, width: int, most: int = TABLE_BYTES + TABLE_BYTES // 2) -> None:
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_str(text)
        self.splitter = WordSplitter({t.content: i for i, t in self.library.get_added_tokens_decoder().items()})
        self.kind = {2: "H", 4: "I"}[width]
        self.model = self.library.model.tokenize
        self.signs = Memo(self.tokens, 1 << 20)
        self.chunks = Memo(self.packed, most)

    def tokens(self, word: str) -> list[int]:
        return [t.id for t in self.model(word)]

    def packed(self, chunk: str) -> bytes:
        """Ids of a stretch, little-endian, of the encoder's width."""
        found = self.splitter.plain(chunk) if self.splitter.quick else None
        if found:
            word, signs = found.groups()
            word = word.lower()
            ids = [t.id for t in self.model(word if word.isascii() else stand_ins(word))]
            if signs:
                ids += self.signs[signs]
        else:
            ids = self.splitter.encode(chunk, self.tokens)
        packed = array(self.kind, ids)
        if byteorder == "big":
            packed.byteswap()
        return packed.tobytes()

    def encode(self, text: str) -> bytes:
        return b"".join(map(self.chunks.__getitem__, text.replace("\n", " ").split(" ")))


def spread(flat: np.ndarray, sizes: np.ndarray, numbers: np.ndarray, owner: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids of n texts back to back, and where each text's begin and the last one's end. flat has the ids of distinct stretches, sizes of
    them each; numbers are the stretches of all texts in order, owner the text of each."""
    given = sizes[numbers]
    ends = np.cumsum(given)
    kind = np.int32 if given.sum() < 1 << 31 else np.int64
    at = np.repeat(((np.cumsum(sizes) - sizes)[numbers] - ends + given).astype(kind), given)
    at += np.arange(at.size, dtype=kind)
    return flat.take(at), np.concatenate([[0], np.cumsum(np.bincount(owner, given, n).astype(np.int64))])


class SuffixAutomaton:
    """The suffix automaton of a set of tokens, each a tuple of symbol numbers: its states stand for the substrings of all
    tokens. Read over a text it keeps the longest suffix of what was read that lies in some token; the tokens among
    that suffix's own suffixes are found along the suffix links.

    length: of each state's longest substring; link: the state of the next shorter suffixes; token: the token that a state's
    longest substring is, or -1; nearest: the next state along the links that is a token, or 0.
    """

    SYMBOL_BITS = 14

    def __init__(self, tokens: dict[tuple[int, ...], int]) -> None:
        after: list[dict[int, int]] = [{}]
        length, link, token = [0], [-1], [-1]

        def state(n: int, moves: dict[int, int], to: int) -> int:
            after.append(moves), length.append(n), link.append(to), token.append(-1)
            return len(after) - 1

        def split(p: int, symbol: int, q: int) -> int:
            """The state of p's substring and the symbol: q, or a part of q that ends there."""
            if length[p] + 1 == length[q]:
                return q
            part = state(length[p] + 1, dict(after[q]), link[q])
            link[q] = part
            while p >= 0 and after[p].get(symbol) == q:
                after[p][symbol] = part
                p = link[p]
            return part

        for symbols, number in tokens.items():
            last = 0
            for symbol in symbols:
                if (q := after[last].get(symbol)) is not None:
                    last = split(last, symbol, q)
                    continue
                new, p = state(length[last] + 1, {}, 0), last
                while p >= 0 and symbol not in after[p]:
                    after[p][symbol] = new
                    p = link[p]
                if p >= 0:
                    link[new] = split(p, symbol, after[p][symbol])
                last = new
            token[last] = number
        nearest = [0] * len(after)
        for k in sorted(range(1, len(after)), key=length.__getitem__):
            up = link[k]
            nearest[k] = up if token[up] >= 0 else nearest[up]
        self.length, self.link, self.token, self.nearest = (array("i", x) for x in (length, link, token, nearest))
        self.moves = {k << self.SYMBOL_BITS | symbol: to for k, found in enumerate(after) for symbol, to in found.items()}


class ProvenTokens:
    """What the driver works out for a PrefixEncoder: the proven tokens' symbols and their suffix automaton. The last symbol
    of a word carries the word-end mark; it is written as a symbol of its own (its code point plus SHIFT)."""

    SHIFT = 0x1000

    def __init__(self, vocabulary: Vocabulary, proven: list[str]) -> None:
        self.spelled: dict[int, list[str]] = {}
        keys, mark = {}, vocabulary.word_end
        for token in proven:
            ends = bool(mark) and token.endswith(mark) and token != mark
            core = token[:-len(mark)] if ends else token
            i = vocabulary.ids[token]
            self.spelled[i] = [*core[:-1], core[-1] + mark] if ends else list(core)
            keys[self.key(core, ends)] = i
        self.automaton = SuffixAutomaton(keys)

    @classmethod
    def key(cls, core: str, ends: bool) -> tuple[int, ...]:
        numbers = list(map(ord, core))
        if ends:
            numbers[-1] += cls.SHIFT
        return tuple(numbers)


class Hashed:
    """A fixed map of non-negative 64-bit keys to numbers, looked up for many keys at once: open addressing in numpy."""

    def __init__(self, keys: np.ndarray, values: np.ndarray) -> None:
        self.bits = max(4, int(4 * len(keys)).bit_length())
        self.keys, self.values = np.full(1 << self.bits, -1, np.int64), np.zeros(1 << self.bits, np.int32)
        at = self.place(keys)
        left = np.arange(len(keys))
        while left.size:
            here = at[left]
            free = self.keys[here] < 0
            self.keys[here[free]] = keys[left[free]]  # of several for a place one stays
            stays = self.keys[here] == keys[left]
            self.values[here[stays]] = values[left[stays]]
            left = left[~stays]
            at[left] = at[left] + 1 & len(self.keys) - 1

    def place(self, keys: np.ndarray) -> np.ndarray:
        return (keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - self.bits)).astype(np.int64)

    def get(self, keys: np.ndarray, none: int = -1) -> np.ndarray:
        at = self.place(keys)
        here = self.keys.take(at)
        out = np.where(here == keys, self.values.take(at), none)
        left = np.flatnonzero((here != keys) & (here >= 0))
        while left.size:
            at[left] = at[left] + 1 & len(self.keys) - 1
            here = self.keys[at[left]]
            hit = here == keys[left]
            out[left[hit]] = self.values[at[left[hit]]]
            left = left[~hit & (here >= 0)]
        return out


class PrefixSteps:
    """PrefixEncoder's program over many words at once: a step reads one more symbol of every word that has one. States,
    candidates and pair tests are looked up in arrays; verdicts of pairs are kept in a table of fixed size."""

    KEPT_BITS = 20

    def __init__(self, encoder: PrefixEncoder) -> None:
        found, vocabulary = encoder.automaton, encoder.vocabulary
        self.encoder, self.never, self.ids = encoder, len(vocabulary.ranks), vocabulary.ids
        self.moves = Hashed(np.fromiter(found.moves.keys(), np.int64, len(found.moves)), np.fromiter(found.moves.values(), np.int32, len(found.moves)))
        self.link, self.length, self.token, self.nearest = (np.array(x, np.int32) for x in (found.link, found.length, found.token, found.nearest))
        self.first = np.where(self.token >= 0, np.arange(len(self.token), dtype=np.int32), self.nearest)
        self.first[0] = 0
        ranks = [(self.ids[a] << 32 | self.ids[b], k) for (a, b), k in vocabulary.ranks.items() if a in self.ids and b in self.ids]
        self.ranks = Hashed(*np.array(ranks, np.int64).reshape(-1, 2).T)
        self.kept = np.full(1 << self.KEPT_BITS, -1, np.int64)
        # pieces at the left (0) and right (1) ends of the tokens met so far: where a token's begin, how many, and the pieces
        top = max(self.ids.values()) + 1
        self.begin, self.count = np.full((2, top), -1, np.int64), np.zeros((2, top), np.int64)
        self.pieces = [array("q"), array("q")]

    def _meet(self, tokens: np.ndarray) -> None:
        for token in np.unique(tokens[self.begin[0][tokens] < 0]).tolist():
            for side, flat, pieces in zip((0, 1), self.pieces, self.encoder._sides(token)):
                self.begin[side, token], self.count[side, token] = len(flat) // 3, len(pieces)
                for piece, made, gone in pieces:
                    flat.extend((self.ids[piece], made, gone))

    def _work(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """PrefixEncoder._apart for many pairs: every piece at the right end of the one with every piece at the left end of the other."""
        self._meet(left), self._meet(right)
        n, m = self.count[1][left], self.count[0][right]
        pair = np.repeat(np.arange(left.size), n * m)
        k = np.arange(pair.size) - np.repeat(np.cumsum(n * m) - n * m, n * m)
        i, j = np.divmod(k, m[pair])
        a, made_a, gone_a = np.array(self.pieces[1]).reshape(-1, 3)[self.begin[1][left][pair] + i].T
        b, made_b, gone_b = np.array(self.pieces[0]).reshape(-1, 3)[self.begin[0][right][pair] + j].T
        rank = self.ranks.get(a << 32 | b)
        joined = (rank >= 0) & (made_a < rank) & (rank < gone_a) & (made_b < rank) & (rank <= gone_b)
        out = np.ones(left.size, bool)
        out[pair[joined]] = False
        return out

    def apart(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        keys = left.astype(np.int64) << 32 | right
        at = (keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - self.KEPT_BITS)).astype(np.int64)
        kept = self.kept.take(at)
        out = (kept & 1).astype(bool)
        new = np.flatnonzero(kept >> 1 != keys)
        if new.size:
            fresh, back = np.unique(keys[new], return_inverse=True)
            out[new] = self._work(fresh >> 32, fresh & 0xFFFFFFFF)[back]
            self.kept[at[new]] = keys[new] << 1 | out[new]
        return out

    def words(self, symbols: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words, none empty, whose symbols lie back to back: all ids in one array, and how many each word has."""
        n, symbols = len(lengths), symbols.astype(np.int64)
        ends = np.cumsum(lengths)
        if self.encoder.vocabulary.word_end:
            symbols[ends - 1] += ProvenTokens.SHIFT
        order = np.argsort(-lengths, kind="stable")  # those that have one more symbol come first
        base = ends - lengths + np.arange(n)  # prefixes of a word: of 0 symbols, 1, and so on
        last, size = np.full(symbols.size + n, -1, np.int32), np.zeros(symbols.size + n, np.int32)
        starts, base, lengths = (ends - lengths)[order], base[order], lengths[order]
        state, held = np.zeros(n, np.int64), np.zeros(n, np.int64)
        bits = SuffixAutomaton.SYMBOL_BITS
        longer = n - np.searchsorted(lengths[::-1], np.arange(1, int(lengths[0]) + 1)) if n else []
        for end, m in enumerate(map(int, longer), 1):
            symbol = symbols[starts[:m] + end - 1]
            to = self.moves.get(state[:m] << bits | symbol)
            held[:m] += 1
            lost = np.flatnonzero(to < 0)
            while lost.size:
                root = state[lost] == 0
                to[lost[root]], held[lost[root]] = 0, 0
                lost = lost[~root]
                state[lost] = self.link[state[lost]]
                held[lost] = self.length[state[lost]] + 1
                to[lost] = self.moves.get(state[lost] << bits | symbol[lost])
                lost = lost[to[lost] < 0]
            state[:m] = to
            at = self.first.take(to)
            open_ = np.flatnonzero(at)
            at = at[open_]
            while open_.size:
                length, token = self.length.take(at), self.token.take(at)
                fits = length <= held[open_]
                left = last[base[open_] + end - np.where(fits, length, 0)]
                done = fits & (length == end)
                asked = np.flatnonzero(fits & ~done & (left >= 0))
                done[asked] = self.apart(left[asked], token[asked])
                here = base[open_[done]] + end
                last[here], size[here] = token[done], length[done]
                open_, at = open_[~done], self.nearest.take(at[~done])
                open_, at = open_[at > 0], at[at > 0]
        rounds, counts, at, open_ = [], np.zeros(n, np.int64), lengths.copy(), np.arange(n)
        while open_.size:
            here = base[open_] + at[open_]
            if not size[here].all():
                k = open_[size[here] == 0][0]
                word = "".join(chr(x % ProvenTokens.SHIFT) for x in symbols[starts[k]:starts[k] + lengths[k]].tolist())
                raise ValueError(f"the vocabulary has no encoding of {word!r}")
            rounds.append((open_, last[here]))
            counts[open_] += 1
            at[open_] -= size[here]
            open_ = open_[at[open_] > 0]
        given = np.empty_like(counts)  # in the order of the words that were given
        given[order] = counts
        ends, ids = np.cumsum(given), np.empty(int(given.sum()), np.int64)
        for k, (who, token) in enumerate(rounds):
            ids[ends[order[who]] - 1 - k] = token
        return ids, given


#: Bytes of the longest stretch that PrefixEncoder works out together with others.
LONG_WORD = 64
#: Symbols of bytes; what a byte is in a plain stretch: of a letter (0xC3 begins those of Latin-1), a sign, or neither.
SYMBOLS = np.array([ord(STAND_IN[b]) for b in range(256)], np.int64)
LETTER, SIGN = 1, 2
BYTE_KIND = np.zeros(256, np.uint8)
BYTE_KIND[[0xC3, *range(0x41, 0x5B), *range(0x61, 0x7B)]] = LETTER
BYTE_KIND[[b for b in range(0x21, 0x7F) if b != 0x27 and not chr(b).isalnum()]] = SIGN


class PrefixEncoder:
    """Ids of words by dynamic programming over prefixes.

    The suffix automaton of the proven tokens gives, for each prefix of a word, the tokens that end there. The
    encoding of a prefix has exactly one last token: the one whose pair with the last token of the
    remaining shorter prefix is left apart by merging. It is stored for every prefix, and the pointers are followed back
    from the end.
    """

    def __init__(self, vocabulary: Vocabulary, tokens: ProvenTokens, most: int = TABLE_BYTES) -> None:
        self.vocabulary, self.spelled, self.automaton = vocabulary, tokens.spelled, tokens.automaton
        self.pairs, self.chunks = Memo(self._apart, most // 2), Memo(self._chunk, 3 * most // 4)
        self.ending: list[tuple | None] = [None] * len(tokens.automaton.length)
        self.words, self.jumps, self.sides = Memo(lambda word: self._packed(self._word(word)), 3 * most // 4), Memo(self._jump, most // 4), Memo(self._sides, most // 4)
        self.splitter, self.strings = WordSplitter(vocabulary.special), vocabulary.strings
        self.steps = PrefixSteps(self)

    def _sides(self, token: int) -> tuple[list, list]:
        """The pieces that lie at the left and at the right end of a token while it is merged, with the ranks at which each
        is made (-1: a symbol) and merged on (past all ranks: the token itself)."""
        ranks, parts = self.vocabulary.ranks, list(self.spelled[token])
        left, right, never = [[parts[0], -1, len(ranks)]], [[parts[-1], -1, len(ranks)]], len(ranks)
        while len(parts) > 1:
            at = [ranks.get(pair, never) for pair in zip(parts, parts[1:])]
            rank = min(at)
            k = at.index(rank)
            parts[k:k + 2] = [parts[k] + parts[k + 1]]
            for side, here, piece in ((left, k == 0, parts[0]), (right, k == len(parts) - 1, parts[-1])):
                if here:
                    side[-1][2] = rank
                    side.append([piece, rank, never])
        return left, right

    def _apart(self, pair: int) -> bool:
        """Whether merging the two tokens' symbols (left << 32 | right) gives back just these two tokens: no piece at the
        right end of the one is merged with a piece at the left end of the other while both are there. Merges go by rank,
        and of equal ranks the leftmost goes first. A piece is always made at a lower rank than it is merged on."""
        ranks = self.vocabulary.ranks
        for a, made_a, gone_a in self.sides[pair >> 32][1]:
            for b, made_b, gone_b in self.sides[pair & 0xFFFFFFFF][0]:
                rank = ranks.get((a, b))
                if rank is not None and made_a < rank < gone_a and made_b < rank <= gone_b:
                    return False
        return True

    def _ending(self, state: int) -> tuple[tuple[int, int], ...]:
        """(token, length) of the tokens that are suffixes of a state's longest substring, the longest first; kept by state,
        of which there are as many as the vocabulary makes."""
        found, at, out = self.automaton, state, []
        while at:
            if found.token[at] >= 0:
                out.append((found.token[at], found.length[at]))
            at = found.nearest[at]
        self.ending[state] = tuple(out)
        return self.ending[state]

    def _jump(self, move: int) -> int:
        """Where a state without the move goes over its links: the state, and the length that is kept, as state << 16 | length."""
        found, bits = self.automaton, self.automaton.SYMBOL_BITS
        state, symbol, to = move >> bits, move & (1 << bits) - 1, None
        while to is None and state:
            state = found.link[state]
            to = found.moves.get(state << bits | symbol)
        return 0 if to is None else to << 16 | found.length[state] + 1

    def _word(self, mapped: str) -> list[int]:
        n, pairs, jumps, ending = len(mapped), self.pairs, self.jumps, self.ending
        moves, bits = self.automaton.moves.get, self.automaton.SYMBOL_BITS
        symbols = list(map(ord, mapped))
        if self.vocabulary.word_end:
            symbols[-1] += ProvenTokens.SHIFT
        # state and held: the longest suffix of the prefix read so far that lies in a token, and its length
        state = held = end = 0
        last, size = [-1] * (n + 1), [0] * (n + 1)  # the last token of each prefix (-1: it has none), and its length
        for symbol in symbols:
            end += 1
            move = state << bits | symbol
            if (to := moves(move)) is not None:
                state, held = to, held + 1
            else:
                to = jumps[move]
                state, held = to >> 16, to & 0xFFFF
            for token, length in ending[state] or self._ending(state):
                if length < end:
                    left = last[end - length]
                    if left < 0 or length > held or not pairs[left << 32 | token]:
                        continue
                elif length > held:
                    continue
                last[end], size[end] = token, length
                break
        ids, at = [], n
        while at:
            if not size[at]:
                raise ValueError(f"the vocabulary has no encoding of {mapped[:80]!r}")
            ids.append(last[at])
            at -= size[at]
        return ids[::-1]

    def _packed(self, ids: list[int]) -> bytes:
        return np.array(ids, "<u4").tobytes() if byteorder == "big" else array("I", ids).tobytes()

    def _chunk(self, chunk: str) -> bytes:
        found = self.splitter.plain(chunk) if self.splitter.quick else None
        if found:
            word, signs = found.groups()
            word = word.lower()
            packed = self.words[word if word.isascii() else stand_ins(word)]
            return packed + self.words[signs] if signs else packed
        words = self.words
        return self._packed(self.splitter.encode(chunk, lambda word: np.frombuffer(words[word], "<u4").tolist()))

    def stretches(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of stretches without spaces and line ends: all ids in one array, and how many each stretch has. Plain stretches
        (WordSplitter.plain) are told by their bytes and worked out together, the others one by one as by encode."""
        n, texts = len(texts), texts.cast(pa.string())
        offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset:texts.offset + n + 1].astype(np.int64) if n else np.zeros(1, np.int64)
        raw = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0]:offsets[-1]]
        starts, lengths = offsets[:-1] - offsets[0], np.diff(offsets)
        some = lengths > 0
        kind, second = BYTE_KIND[raw], np.zeros(raw.size, bool)
        second[1:] = raw[:-1] == 0xC3
        kind[second & (raw != 0x97) & (raw != 0xB7)] = LETTER  # but the signs for times and divided
        begins, sign = np.zeros(raw.size, bool), kind == SIGN
        begins[starts[some]] = True
        after = np.zeros(raw.size, bool)
        after[1:] = sign[:-1]
        odd = (kind == 0) | np.where(begins, sign, after & ~sign)
        plain = some & (lengths <= LONG_WORD) & self.splitter.quick
        plain[np.flatnonzero(some)[np.logical_or.reduceat(odd, starts[some])] if raw.size else []] = False
        lower = raw + ((raw >= 65) & (raw <= 90) | second & (raw <= 0x9E)) * np.uint8(32)
        kept = np.repeat(plain, lengths)
        first = np.flatnonzero((begins | sign & ~after)[kept])
        ids, counts = self.steps.words(SYMBOLS[lower[kept]], np.diff(first, append=int(kept.sum())))
        total = np.bincount(np.repeat(np.arange(n), lengths)[kept][first], counts, n).astype(np.int64)
        rest = {k: np.frombuffer(self.chunks[texts[k].as_py()], "<u4") for k in np.flatnonzero(some & ~plain).tolist()}
        if not rest:
            return ids, total
        joined = total.copy()
        joined[list(rest)] = list(map(len, rest.values()))
        ends, out = np.cumsum(joined), np.empty(int(joined.sum()), np.int64)
        out[np.repeat(plain, joined)] = ids
        for k, found in rest.items():
            out[ends[k] - len(found):ends[k]] = found
        return out, joined

    def encode_all(self, texts: pa.Array) -> list[np.ndarray]:
        """Ids of texts as by encode, null as of an empty one; a stretch that many of them share is worked out once."""
        parts = pc.split_pattern(pc.replace_substring(pc.fill_null(texts, ""), "\n", " "), " ")
        found = parts.flatten().dictionary_encode()
        flat, sizes = self.stretches(found.dictionary)
        owner = np.repeat(np.arange(len(texts)), np.diff(parts.offsets.to_numpy()))
        ids, at = spread(flat.astype("<u4"), sizes, found.indices.to_numpy(), owner, len(texts))
        return [ids[lo:hi] for lo, hi in zip(at[:-1].tolist(), at[1:].tolist())]

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers. Spaces and line ends never lie inside a word or a special
        string, so the stretches between them are encoded on their own and kept in a table of bounded size."""
        return b"".join(map(self.chunks.__getitem__, text.replace("\n", " ").split(" ")))

    def decode(self, packed: bytes | np.ndarray) -> str:
        """The vocabulary strings of the ids, with a space between (the files define no other decoder)."""
        return " ".join(map(self.strings.__getitem__, np.frombuffer(packed, "<u4").tolist()))
