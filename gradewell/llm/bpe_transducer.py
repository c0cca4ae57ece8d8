"""A byte-pair tokenizer compiled to a deterministic finite-state transducer.

The transducer reads one word (a pre-token) as a sequence of symbols: byte values
0-255, and 256 + byte for the last byte of a word, because this vocabulary marks word
ends. It rests on one property of byte-pair encoding: the encoding of a prefix of a word
ends in exactly one token t, and is the encoding of the prefix before t followed by t.
Whether t may follow a token depends on that token alone. So a state is the set of
positions from which a longer token may still grow, each with its trie node, the token
that ends there and the number of tokens emitted since. A transition carries

* the next state (a word's last symbol always leads back to the start state), and
* the change of the number of tokens (an earlier split may be taken back, so it can be
  zero or negative), and the last token of the encoding so far.

States are determinised when text first reaches them, and kept in dense tables. The
number of states depends on the vocabulary and the words met; beyond ``max_states`` the
tables are emptied and built again, so memory is bounded and results are the same.

A run cuts the symbol stream of a batch into equal chunks and steps all chunks together
(one numpy gather per symbol position). A chunk's state map is (head, count, exit
state): the head is what comes before the first word end, the only part that depends on
the entering state; from there on the map is constant. Maps compose by running a head
from the exit state to its left, and counts compose by a prefix sum, so all chunks are
scanned in parallel and only heads are read twice. Chunks inside one long word have no
constant part: all together are run from the entry states that can occur there (mostly the
one that a short run-up gives), and these maps are composed from the left.
"""

from __future__ import annotations

import json
import unicodedata
from array import array

import numpy as np

END = 256
START, UNKNOWN = 0, 1
UNSET = -1
#: Symbols that a chunk without a word end is run up by, from a state as at a word's begin.
RUN_UP = 32
#: A run may compile so many states, and one more for every so many symbols; a stream that goes
#: beyond is given to the library, as compiling would cost more than reading it.
FEW_STATES, SYMBOLS_PER_STATE = 4096, 32
NO_WEIGHT = -128
SPACE, LETTER, NUMBER, OTHER = 1, 2, 3, 4


def byte_alphabet() -> dict[str, int]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    keep = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(keep)]
    return {chr(b): b for b in keep} | {chr(256 + i): b for i, b in enumerate(rest)}


class TooManyStates(Exception):
    """A run met more new states than it may compile."""


class Merges:
    """Merge rules over symbols, and which tokens may stand side by side."""

    def __init__(self, model: dict):
        suffix = model["end_of_word_suffix"]
        letters = byte_alphabet()
        self.ids: dict[tuple[int, ...], int] = {}
        for text, i in model["vocab"].items():
            word = text[: -len(suffix)] if text.endswith(suffix) and text != suffix else text
            if all(c in letters for c in word):
                symbols = [letters[c] for c in word]
                if word is not text:
                    symbols[-1] += END
                self.ids[tuple(symbols)] = i
        spelled = {i: s for s, i in self.ids.items()}
        known = model["vocab"]
        self.rank: dict[tuple[int, int], int] = {}
        self.made: dict[int, tuple[int, int, int]] = {}
        for r, pair in enumerate(model["merges"]):
            left, right = pair if isinstance(pair, list) else pair.split(" ")
            a, b, whole = known[left], known[right], known[left + right]
            self.rank[a, b] = r
            if whole in self.made:
                raise ValueError("two merges spell the same token; the transducer needs one")
            self.made[whole] = (a, b, r)
        self.edges: tuple[dict, dict] = ({}, {})
        self.reach: dict[int, bool] = {}
        self.spelled = {i: s for i, s in spelled.items() if self.reachable(i)}

    def spine(self, token: int, side: int) -> list[tuple[int, int, float]]:
        """(piece, rank that makes it, rank that consumes it) along one edge of a token."""
        out = self.edges[side].get(token)
        if out is None:
            out, piece, consumed = [], token, 1 << 60
            while piece is not None:
                made = self.made.get(piece)
                out.append((piece, made[2] if made else -1, consumed))
                piece, consumed = (made[side], made[2]) if made else (None, 0)
            self.edges[side][token] = out
        return out

    def crossed(self, left: int, right: int, whole: bool) -> bool:
        """Would a merge across the border of two tokens come before they are complete?"""
        rank, heads = self.rank, self.spine(right, 0)
        for a, made_a, used_a in self.spine(left, 1):
            for b, made_b, used_b in heads:
                if made_b >= used_a or made_a >= used_b:
                    continue
                r = rank.get((a, b))
                if r is not None and r < used_a and r <= used_b and not (whole and a == left and b == right):
                    return True
        return False

    def reachable(self, token: int) -> bool:
        got = self.reach.get(token)
        if got is None:
            made = self.made.get(token)
            got = made is None or (
                self.reachable(made[0]) and self.reachable(made[1]) and not self.crossed(made[0], made[1], True)
            )
            self.reach[token] = got
        return got

    def follows(self, left: int, right: int) -> bool:
        return not self.crossed(left, right, False)


class Transducer:
    """Determinised on demand; see the module's text."""

    few = 24  # nodes with so few tokens below them are looked through in ``matters``

    def __init__(self, merges: Merges, max_states: int = 150_000):
        self.merges = merges
        self.max_states = max_states
        self.child: dict[int, int] = {}
        self.token = array("i", [UNSET])
        self.grows = bytearray([True])
        for i, symbols in merges.spelled.items():
            node = 0
            for s in symbols:
                self.grows[node] = True
                key = node * 512 + s
                nxt = self.child.get(key)
                if nxt is None:
                    nxt = self.child[key] = len(self.token)
                    self.token.append(UNSET)
                    self.grows.append(False)
                node = nxt
            self.token[node] = i
        self.below: list[list[int] | None] = [[] for _ in self.token]
        for key, node in sorted(self.child.items(), key=lambda kv: -kv[1]):  # children are numbered after parents
            own, up = self.below[node], self.below[key // 512]
            if up is None or own is None or len(up) + len(own) >= self.few:
                self.below[key // 512] = None
            else:
                up.extend(own)
                if self.token[node] >= 0:
                    up.append(self.token[node])
        self.below = [None if x is None else tuple(x) for x in self.below]
        self.useful: dict[tuple[int, int], int | None] = {}
        self.length = np.zeros(max(merges.spelled) + 1, dtype=np.int64)
        for i, symbols in merges.spelled.items():
            self.length[i] = len(symbols)
        self.id_type = np.uint16 if max(merges.spelled) < 1 << 16 else np.int32
        merges.ids, merges.spelled = {}, {}  # the trie has them now
        self.column = np.full(512, UNSET, dtype=np.int64)
        self.columns = 0
        self.width = 64
        self.reset()

    def reset(self) -> None:
        self.keys: dict[tuple, int] = {}
        self.states: list[tuple] = []
        self.room, self.allowed = 4096, self.max_states
        self.next = np.full(self.room * self.width, UNSET, dtype=np.int32)
        self.weight = np.full(self.room * self.width, NO_WEIGHT, dtype=np.int8)
        self.last = np.zeros(self.room * self.width, dtype=self.id_type)
        self.state_of((0, UNSET, 0))
        self.state_of(("unknown",))

    def matters(self, node: int, before: int) -> int | None:
        """What a state must remember of the token before a growing one: the token itself, UNSET
        where all that may grow can follow it, None where nothing can (the position is dropped)."""
        tokens = self.below[node]
        if tokens is None or before < 0:
            return before
        got = self.useful.get((node, before), 0)
        if got == 0:
            ok = [self.merges.follows(before, t) for t in tokens]
            got = UNSET if all(ok) else before if any(ok) else None
            self.useful[node, before] = got
        return got

    def state_of(self, key: tuple) -> int:
        got = self.keys.get(key)
        if got is None:
            got = self.keys[key] = len(self.states)
            self.states.append(key)
            if got >= self.room:
                grow = self.room * self.width
                self.next = np.concatenate([self.next, np.full(grow, UNSET, dtype=np.int32)])
                self.weight = np.concatenate([self.weight, np.full(grow, NO_WEIGHT, dtype=np.int8)])
                self.last = np.concatenate([self.last, np.zeros(grow, dtype=self.id_type)])
                self.room *= 2
        return got

    def columns_for(self, symbols: np.ndarray) -> np.ndarray:
        """Dense column numbers of a stream's symbols; tables widen when new symbols come."""
        cols = self.column[symbols]
        if (cols < 0).any():
            for s in np.unique(symbols[cols < 0]).tolist():
                self.column[s] = self.columns
                self.columns += 1
            if self.columns > self.width:
                wide = self.width
                while wide < self.columns:
                    wide *= 2
                for name, none in (("next", UNSET), ("weight", NO_WEIGHT), ("last", 0)):
                    old = getattr(self, name).reshape(self.room, self.width)
                    new = np.full((self.room, wide), none, dtype=old.dtype)
                    new[:, : self.width] = old
                    setattr(self, name, new.reshape(-1))
                self.width = wide
            cols = self.column[symbols]
        return cols.astype(np.int32)

    def compile(self, state: int, symbol: int) -> None:
        """Fill one transition."""
        at = state * self.width + int(self.column[symbol])
        if state == UNKNOWN:
            self.next[at], self.weight[at] = (START if symbol >= END else UNKNOWN), 0
            return
        found = None
        grown: list[int] = []
        entries = iter(self.states[state])
        for node, before, since in zip(entries, entries, entries):
            child = self.child.get(node * 512 + symbol)
            if child is None:
                continue
            t = self.token[child]
            if found is None and t >= 0 and (before < 0 or self.merges.follows(before, t)):
                found = (t, 1 - since)
            if self.grows[child]:
                before = self.matters(child, before)
                if before is not None:
                    grown += (child, before, since)
        t, weight = found
        if symbol >= END:
            target = START
        else:
            grown[2::3] = [since + weight for since in grown[2::3]]
            target = self.state_of((*grown, 0, t, 0))
        self.next[at], self.weight[at], self.last[at] = target, weight, t

    def step(self, state: np.ndarray, cols: np.ndarray, symbols: np.ndarray) -> np.ndarray:
        """Table positions of the transitions taken, compiled where they are new."""
        at = state * self.width + cols
        new = self.next[at] < 0
        if new.any():
            if len(self.states) > self.allowed:
                raise TooManyStates
            for key in np.unique(state[new].astype(np.int64) * 512 + symbols[new]).tolist():
                self.compile(key // 512, key % 512)
        return at

    def run(self, symbols: np.ndarray, table: str, chunk: int = 64) -> np.ndarray:
        """What ``table`` says at each symbol of a stream of whole words: "weight" (change of
        the token count) or "last" (last token of the encoding so far)."""
        n = len(symbols)
        if n == 0:
            return np.zeros(0, dtype=getattr(self, table).dtype)
        if len(self.states) > self.max_states:
            self.reset()
        self.allowed = len(self.states) + FEW_STATES + n // SYMBOLS_PER_STATE
        cols = self.columns_for(symbols)
        chunk = max(1, min(chunk, n))
        lanes = -(-n // chunk)
        fill = lanes * chunk - n  # after the last word: symbols that end words at once
        stream, cols = (np.concatenate([x, np.full(fill, x[-1], dtype=x.dtype)]) for x in (symbols, cols))
        by_step = [np.ascontiguousarray(x.reshape(lanes, chunk).T) for x in (stream, cols)]
        out = np.empty((chunk, lanes), dtype=getattr(self, table).dtype)
        state = np.full(lanes, UNKNOWN, dtype=np.int32)
        state[0] = START
        for k in range(chunk):
            at = self.step(state, by_step[1][k], by_step[0][k])
            out[k] = getattr(self, table)[at]
            state = self.next[at]
        flat = np.ascontiguousarray(out.T).reshape(-1)
        # chunks without a word end: their maps aren't constant. They are made for the entry states that
        # may occur, a guess by a short run-up and what the left neighbour's map leaves, until these are
        # closed; then the maps are composed from the left
        inner = np.flatnonzero(state == UNKNOWN)

        def run_on(lane: np.ndarray, entry: np.ndarray, steps: range, write: bool = False) -> np.ndarray:
            for k in steps:
                place = lane * chunk + k
                at = self.step(entry, cols[place], stream[place])
                if write:
                    flat[place] = getattr(self, table)[at]
                entry = self.next[at]
            return entry

        if len(inner):
            guess = run_on(inner, np.full(len(inner), START, dtype=np.int32), range(-min(RUN_UP, chunk), 0))
            left = state[inner - 1]
            maps: dict[int, dict[int, int]] = {lane: {} for lane in inner.tolist()}
            new = dict.fromkeys(zip(inner.tolist(), np.where(left == UNKNOWN, guess, left).tolist()))
            while new:
                lane, entry = (np.array(x, dtype=np.int32) for x in zip(*new))
                leave = run_on(lane.astype(np.int64), entry, range(chunk)).tolist()
                for (i, e), x in zip(new, leave):
                    maps[i][e] = x
                new = dict.fromkeys((i + 1, x) for (i, _), x in zip(new, leave) if i + 1 in maps and x not in maps[i + 1])
            for i in inner.tolist():
                state[i] = maps[i][int(state[i - 1])]
            run_on(inner, state[inner - 1], range(chunk), write=True)
        # heads: from each boundary on to the next word end
        headed = np.ones(lanes, dtype=bool)
        headed[inner] = False
        where = np.flatnonzero(headed[1:]) + 1
        where, state = where * chunk, state[where - 1]
        state, where = state[where < n], where[where < n]
        while len(where):
            s = symbols[where]
            at = self.step(state, cols[where], s)
            flat[where] = getattr(self, table)[at]
            going = s < END
            where, state = where[going] + 1, self.next[at][going]
        return flat[:n]

    def split(self, symbols: np.ndarray, last: np.ndarray) -> np.ndarray:
        """Marks the last symbol of each token, read back from each word's end along the last tokens."""
        mark = np.zeros(len(symbols), dtype=bool)
        first = np.zeros(len(symbols) + 1, dtype=bool)
        first[0] = True
        first[1:] = symbols >= END
        at = np.flatnonzero(symbols >= END)
        while len(at):
            mark[at] = True
            at = at - self.length[last[at]]
            at = at[~first[at + 1]]
        return mark


class Counter:
    """Tokens of whole texts as ``tokenizers`` gives them for one vocabulary file.

    The transducer covers lower-casing byte-pair vocabularies that mark word ends. Texts
    with the vocabulary's special strings, or with characters that the library normalises
    unlike Python, are given to the library itself, and so are slices of texts that need very many
    new states, such as long random strings.
    """

    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        kinds = [x["type"] for x in (spec["normalizer"] or {}).get("normalizers", [])]
        if spec["model"]["type"] != "BPE" or not spec["model"]["end_of_word_suffix"] or kinds != ["NFC", "Replace", "Lowercase"]:
            raise ValueError(f"{path}: not a lower-casing byte-pair vocabulary with word ends")
        # normaliser and pre-tokenizer without the model; the whole library only for texts that need it
        self.front = Tokenizer.from_str(json.dumps(spec | {"model": spec["model"] | {"vocab": {}, "merges": []}, "added_tokens": []}))
        self.path, self.whole = path, None
        self.special = [x["content"] for x in spec["added_tokens"]]
        self.transducer = Transducer(Merges(spec["model"]))
        self.kind = np.zeros(0x110000 + 1, dtype=np.uint8)
        self.plain: set[str] = set()
        self.odd: set[str] = set()

    @property
    def library(self):
        if self.whole is None:
            from tokenizers import Tokenizer

            self.whole = Tokenizer.from_file(self.path)
        return self.whole

    @staticmethod
    def lowered(text: str) -> str:
        if text.isascii():
            return text.lower()
        if not unicodedata.is_normalized("NFC", text):
            text = unicodedata.normalize("NFC", text)
        return text.replace("Σ", "σ").lower()

    def needs_library(self, text: str) -> bool:
        if "<|" in text and any(s in text for s in self.special):
            return True
        if text.isascii():
            return False
        chars = set(text)
        for c in chars - self.plain - self.odd:
            same = " ".join(self.lowered(c).split()) == " ".join(self.front.normalizer.normalize_str(c).split())
            (self.plain if same else self.odd).add(c)
        return bool(self.odd) and not chars.isdisjoint(self.odd)

    def kinds(self, points: np.ndarray) -> np.ndarray:
        got = self.kind[points]
        if (got == 0).any():
            pieces = self.front.pre_tokenizer.pre_tokenize_str
            for p in np.unique(points[got == 0]).tolist():
                c = chr(p)
                if not pieces(c):
                    kind = SPACE
                elif len(pieces("a" + c)) == 1:
                    kind = LETTER
                elif len(pieces("!" + c)) == 1:
                    kind = OTHER
                else:
                    kind = NUMBER
                self.kind[p] = kind
            got = self.kind[points]
        return got

    def symbols(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Symbol stream of the texts' words, and where each text's symbols begin (and the end)."""
        texts = [self.lowered(t) for t in texts]
        whole = " ".join(texts) + "    "
        narrow = whole.isascii()
        if narrow:
            points = np.frombuffer(whole.encode("ascii"), dtype=np.uint8)
        else:
            points = np.frombuffer(whole.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        kind = self.kinds(points)
        used = kind != SPACE
        start = np.empty(len(kind), dtype=bool)
        start[0] = used[0]
        start[1:] = used[1:] & ((kind[1:] != kind[:-1]) | (kind[1:] == NUMBER))
        quotes = np.flatnonzero((points == 39) & start)
        if len(quotes):
            a, b = points[quotes + 1], points[quotes + 2]
            one = np.isin(a, [ord(c) for c in "stmd"])
            two = ((a == ord("r")) & (b == ord("e"))) | ((a == ord("v")) & (b == ord("e"))) | ((a == ord("l")) & (b == ord("l")))
            start[quotes[one | two] + 1] = False
            for picked, size in ((quotes[one], 2), (quotes[two], 3)):
                after = picked + size
                start[after] |= kind[after] == LETTER
        end = np.empty(len(kind), dtype=bool)
        end[-1] = False
        end[:-1] = used[:-1] & (~used[1:] | start[1:])
        sizes = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts)) + 1
        begin = np.concatenate([[0], np.cumsum(sizes)])
        begin[-1] = len(points)
        if narrow:
            data = points.astype(np.int16)
        else:
            width = 1 + (points >= 0x80) + (points >= 0x800) + (points >= 0x10000)
            data = np.frombuffer(whole.encode("utf-8", "surrogatepass"), dtype=np.uint8).astype(np.int16)
            stop = np.cumsum(width)
            used = np.repeat(used, width)
            at_end = np.zeros(len(data), dtype=bool)
            at_end[stop - 1] = end
            end = at_end
            begin = np.concatenate([[0], stop])[begin]
        data = data + end * np.int16(END)
        kept = np.concatenate([[0], np.cumsum(used)])
        return data[used], kept[begin]

    def groups(self, texts: list[str]) -> tuple[list[int], list[int], list[int]]:
        """Indexes of the texts in ASCII, of the others, and of those that the library must take."""
        out: tuple[list[int], list[int], list[int]] = ([], [], [])
        for i, t in enumerate(texts):
            out[2 if self.needs_library(t) else 0 if t.isascii() else 1].append(i)
        return out

    def transduced(self, stream: np.ndarray, table: str) -> np.ndarray | None:
        """What the transducer says of a stream; none where it would need too many new states (those
        it has made so far stay)."""
        try:
            return self.transducer.run(stream, table)
        except TooManyStates:
            return None

    def count(self, texts: list[str]) -> np.ndarray:
        """Number of tokens of each text."""
        counts = np.zeros(len(texts), dtype=np.int64)
        *easy, hard = self.groups(texts)
        for own in filter(None, easy):
            stream, begin = self.symbols([texts[i] for i in own])
            weight = self.transduced(stream, "weight")
            if weight is None:
                hard += own
                continue
            total = np.concatenate([[0], np.cumsum(weight, dtype=np.int64)])[begin]
            counts[own] = total[1:] - total[:-1]
        for i in hard:
            counts[i] = len(self.library.encode(texts[i], add_special_tokens=False).ids)
        return counts

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Token ids of each text, 32 bits unsigned."""
        out: list[np.ndarray] = [np.zeros(0, dtype="<u4")] * len(texts)
        *easy, hard = self.groups(texts)
        for own in filter(None, easy):
            stream, begin = self.symbols([texts[i] for i in own])
            last = self.transduced(stream, "last")
            if last is None:
                hard += own
                continue
            mark = self.transducer.split(stream, last)
            ids = last[mark].astype("<u4")
            total = np.concatenate([[0], np.cumsum(mark)])[begin]
            for k, i in enumerate(own):
                out[i] = ids[total[k] : total[k + 1]]
        for i in hard:
            out[i] = np.array(self.library.encode(texts[i], add_special_tokens=False).ids, dtype="<u4")
        return out


_COUNTERS: dict[str, Counter] = {}


def counter(path: str) -> Counter:
    """One per worker process: compiled states are shared by all its batches."""
    if path not in _COUNTERS:
        _COUNTERS[path] = Counter(path)
    return _COUNTERS[path]


def compiled() -> bool:
    """Does this worker process hold compiled states?"""
    return bool(_COUNTERS)


def forget() -> None:
    """Drop the compiled states: for tasks of other operators in the same worker process."""
    _COUNTERS.clear()


def slices(texts: list[str], chars: int = 500_000):
    """Index ranges of consecutive texts of about so many characters."""
    begin, size = 0, 0
    for i, t in enumerate(texts):
        size += len(t)
        if size >= chars:
            yield begin, i + 1
            begin, size = i + 1, 0
    if begin < len(texts):
        yield begin, len(texts)
