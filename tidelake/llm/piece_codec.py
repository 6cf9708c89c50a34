"""Exact merge-type encoding by backtracking, and decoding, for sentencepiece BPE models.

No piece has a space mark inside or at its end after another character, so merges never cross the start of a word and
a text is encoded word by word (a word: space marks, then other characters). Inside a word the encoder takes, from
left to right, the longest piece an Aho-Corasick automaton finds that is compatible with the piece before it; two
pieces are compatible when merging their joined characters from scratch gives just these two. A position from which
no piece fits is marked in a bitfield, and the encoder steps back to the next shorter piece there. The sequence whose
neighbours are all compatible is unique, and it is the one that merging the whole word gives.

Many new words are encoded together (``Together``): the automaton's matches in all of them go through numpy, place by
place from the left, longer pieces first. Of the pieces that end at a place just one is compatible with the last piece of the text before it,
so the backtracking is done once every place knows its last piece: from the word's end to its start.

Words for which this argument does not hold are merged directly: those with several space marks together (their
pieces share one score) and those with characters outside the vocabulary (these become bytes).
"""

from __future__ import annotations

import heapq
import re

import ahocorasick
import numpy as np

SPACE = "▁"
ENDING = ".,!*$#%&?;:"
_WORD = re.compile(f"{SPACE}+[^{SPACE}]*|[^{SPACE}]+")
#: Words of more characters are encoded one by one, others so many characters at a time; texts are taken until they have so many.
LONG_WORD, AT_ONCE, TEXTS_AT_ONCE = 64, 100_000, 1_000_000


class PieceCodec:
    """Reads a sentencepiece BPE model with byte fallback, the identity normaliser and a dummy prefix."""

    def __init__(self, path: str, cache: int = 250_000):
        from sentencepiece import sentencepiece_model_pb2

        model = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        spec = model.normalizer_spec
        if spec.precompiled_charsmap or spec.remove_extra_whitespaces or not spec.escape_whitespaces:
            raise ValueError("only the identity normaliser is supported")
        if model.trainer_spec.model_type != 2 or not model.trainer_spec.byte_fallback:
            raise ValueError("only BPE models with byte fallback are supported")
        kinds = model.SentencePiece
        self.prefix = SPACE if spec.add_dummy_prefix else ""
        self.pieces = [p.piece for p in model.pieces]
        self.rank = {p.piece: (-p.score, i) for i, p in enumerate(model.pieces) if p.type == kinds.NORMAL}
        if any(re.search(f"[^{SPACE}]{SPACE}", p) for p in self.rank):
            raise ValueError("a piece crosses the start of a word")
        self.bytes = {int(p.piece[3:5], 16): i for i, p in enumerate(model.pieces) if p.type == kinds.BYTE}
        special = {i for i, p in enumerate(model.pieces) if p.type in (kinds.CONTROL, kinds.UNKNOWN)}
        self.begin, self.end = self.pieces.index("<s>"), self.pieces.index("</s>")
        values = {i: bytes([b]) for b, i in self.bytes.items()}
        self.value = [
            b"" if i in special else values.get(i) or p.replace(SPACE, " ").encode() for i, p in enumerate(self.pieces)
        ]
        #: Pieces whose own merges don't come in the order of their scores; where they stand, pairs are merged from scratch.
        self.early: set[str] = set()
        self.tails, self.heads = {}, {}
        self.automaton = ahocorasick.Automaton()
        for piece, (_, i) in self.rank.items():
            tail, head = self._spines(piece)
            if tail:
                self.tails[i], self.heads[i] = tail, head
                self.automaton.add_word(piece, (len(piece), i))
        self.automaton.make_automaton()
        self.inside = {p[k : k + 2] for p in self.rank for k in range(len(p) - 1)}
        self.pairs: dict[int, bool] = {}
        self.words: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.cache = cache
        self.together: Together | None = None

    def _score(self, piece: str) -> float:
        return self.rank[piece][0]

    def _merges(self, word: str) -> tuple[list[str], dict[str, tuple[str, str]]]:
        """Merge from scratch: always the neighbours whose joined piece has the best score, the leftmost of ties."""
        part, rank, halves, before = list(word), self.rank, {}, float("-inf")
        while len(part) > 1:
            best, at = None, -1
            for k in range(len(part) - 1):
                found = rank.get(part[k] + part[k + 1])
                if found and (best is None or found[0] < best):
                    best, at = found[0], k
            if best is None:
                break
            joined = part[at] + part[at + 1]
            if best < before:
                halves[""] = ("", "")  # not in the order of the scores
            before = best
            halves[joined] = (part[at], part[at + 1])
            part[at : at + 2] = [joined]
        return part, halves

    def merged(self, word: str) -> list[str]:
        return self._merges(word)[0] if len(word) < 200 else self._merged_long(word)

    def _merged_long(self, word: str) -> list[str]:
        """The same with a heap, for words whose length makes rescanning slow."""
        part, rank = list(word), self.rank
        right, left = list(range(1, len(part) + 1)), list(range(-1, len(part) - 1))
        heap: list[tuple[float, int, int, str]] = []

        def offer(a: int) -> None:
            b = right[a]
            if b < len(part) and (joined := part[a] + part[b]) in rank:
                heapq.heappush(heap, (rank[joined][0], a, b, joined))

        for a in range(len(part)):
            offer(a)
        while heap:
            _, a, b, joined = heapq.heappop(heap)
            if part[a] and right[a] == b and part[a] + part[b] == joined:
                part[a], part[b], right[a] = joined, "", right[b]
                if right[b] < len(part):
                    left[right[b]] = a
                offer(a)
                if left[a] >= 0:
                    offer(left[a])
        return [p for p in part if p]

    def _spines(self, piece: str) -> tuple[list, list]:
        """What stands at the piece's right and left end while it is merged, from the first character to the whole.

        Each entry is (piece, score of the merge that takes it in). Both are empty if merging the piece's characters
        doesn't give the piece.
        """
        part, halves = self._merges(piece)
        if part != [piece]:
            return [], []
        if "" in halves:
            self.early.add(piece)
        spines = []
        for side in (1, 0):
            spine, now, until = [], piece, float("inf")
            while True:
                spine.append((now, until))
                if now not in halves:
                    break
                until, now = self._score(now), halves[now][side]
            spines.append(spine[::-1])
        return spines[0], spines[1]

    def compatible(self, a: int, b: int) -> bool:
        """Whether merging the two pieces' joined characters from scratch gives just these two.

        The merge is replayed at the seam only: while the pieces grow side by side, a joined piece of what stands left
        and right of the seam must never be due before the next merge on either side takes these in.
        """
        key = a << 20 | b
        if (known := self.pairs.get(key)) is None:
            if len(self.pairs) > 300_000:
                self.pairs.clear()
            known = self.pairs[key] = self._replayed(a, b)
        return known

    def _replayed(self, a: int, b: int) -> bool:
        x, y = self.pieces[a], self.pieces[b]
        if x in self.early or y in self.early:
            return self.merged(x + y) == [x, y]
        tail, head, rank = self.tails[a], self.heads[b], self.rank
        i = j = 0
        while True:
            (left, left_until), (right, right_until) = tail[i], head[j]
            found = rank.get(left + right)
            if found:
                if found[0] < left_until and found[0] <= right_until:
                    return False
            if left_until == right_until == float("inf"):
                return True
            if left_until <= right_until:
                i += 1
            else:
                j += 1

    def direct(self, word: str) -> list[int]:
        out: list[int] = []
        for piece in self.merged(word):
            if piece in self.rank:
                out.append(self.rank[piece][1])
            else:
                out.extend(self.bytes[b] for b in piece.encode())
        return out

    def backtracked(self, word: str) -> list[int] | None:
        """The ids, or None where a character has no piece or no sequence of compatible pieces exists."""
        n = len(word)
        ids, last, end = [], -1, 0
        for at_end, (size, piece) in self.automaton.iter_long(word):  # the longest matches, one after the other
            if at_end - size + 1 != end or (last >= 0 and not self.compatible(last, piece)):
                break
            ids.append(piece)
            last, end = piece, at_end + 1
        if end == n:
            return ids
        at: list[list[tuple[int, int]]] = [[] for _ in range(n)]
        for last, (size, piece) in self.automaton.iter(word):
            at[last - size + 1].append((size, piece))
        if any(not x for x in at):
            return None
        if len(at[0]) and at[0][-1][0] == n:  # matches at a start come shortest first: the whole word is a piece
            whole = at[0][-1][1]
            return [whole]
        failed = 0  # bit i: no way on from position i with any piece before it
        ids: list[int] = []
        starts: list[int] = []
        pos, choice = 0, len(at[0]) - 1
        picks: list[int] = []
        compatible = self.compatible
        while pos < n:
            options = at[pos]
            while choice >= 0:
                size, piece = options[choice]
                if not failed >> (pos + size) & 1 and (not ids or compatible(ids[-1], piece)):
                    break
                choice -= 1
            if choice >= 0:
                ids.append(piece)
                starts.append(pos)
                picks.append(choice)
                pos += size
                choice = len(at[pos]) - 1 if pos < n else 0
            elif ids:
                failed |= 1 << pos
                ids.pop()
                pos = starts.pop()
                choice = picks.pop() - 1
            else:
                return None
        return ids

    def word_ids(self, word: str) -> list[int]:
        if SPACE * 2 in word:
            return self.direct(word)
        found = self.backtracked(word)
        return self.direct(word) if found is None else found

    def word_bytes(self, word: str) -> bytes:
        """The ids of a word as bytes. An ending is cut off where no piece holds the two characters at the cut."""
        core = word.rstrip(ENDING)
        if core and len(core) < len(word) and core[-1] + word[len(core)] not in self.inside:
            return self._cached(core) + self._cached(word[len(core) :])
        return b"".join([i.to_bytes(4, "little") for i in self.word_ids(word)])

    def _cached(self, part: str) -> bytes:
        known = self.words.get(part)
        if known is None:
            known = self.old.get(part)
            if known is None:
                known = b"".join([i.to_bytes(4, "little") for i in self.word_ids(part)])
            self.words[part] = known
        return known

    def encode_all(self, texts: list[str]) -> list[bytes]:
        """``encode`` of each text; new words of several texts are encoded together."""
        out: list[bytes] = []
        group: list[list[str]] = []
        size = 0
        for text in texts:
            group.append(_WORD.findall(self.prefix + text.replace(" ", SPACE)) if text else [])
            size += len(text)
            if size > TEXTS_AT_ONCE:
                out += self._joined(group)
                group, size = [], 0
        return out + self._joined(group)

    def _joined(self, texts: list[list[str]]) -> list[bytes]:
        words = self.words
        distinct = set().union(*texts)
        if missing := [w for w in distinct if w not in words]:
            if len(words) + len(missing) > self.cache:
                self.old, self.words = words, {}
                words, missing = self.words, list(distinct)
            old = self.old
            words.update([(w, old[w]) for w in missing if w in old])
            unknown = [w for w in missing if w not in old]
            if self.together is None:
                self.together = Together(self)
            words.update(zip(unknown, self.together.encoded(unknown), strict=True))
        return [b"".join(map(words.__getitem__, parts)) for parts in texts]

    def encode(self, text: str) -> bytes:
        """The ids of a text, without begin and end, as little-endian unsigned 32-bit integers."""
        if not text:
            return b""
        parts = _WORD.findall(self.prefix + text.replace(" ", SPACE))
        words = self.words
        distinct = set(parts)
        if missing := [w for w in distinct if w not in words]:
            if len(words) + len(missing) > self.cache:
                self.old, self.words = words, {}
                words, missing = self.words, distinct
            for w in missing:
                known = self.old.get(w)
                words[w] = self.word_bytes(w) if known is None else known
        return b"".join(map(words.__getitem__, parts))

    def decode(self, ids: list[int]) -> str:
        """The text of the ids: control ids vanish, the dummy prefix goes, broken bytes become U+FFFD."""
        value = self.value
        data = b"".join([value[i] for i in ids])
        first = next((i for i in ids if value[i]), None)
        if self.prefix and first is not None and self.pieces[first].startswith(SPACE):
            data = data[1:]
        return data.decode("utf-8", "replace")


class Together:
    """Encodes many words at a time, each as ``PieceCodec.word_ids`` does."""

    #: Slots of the table of known pairs; a pair takes the place of another one in its slot.
    SLOTS = 1 << 19

    def __init__(self, codec: PieceCodec):
        self.codec = codec
        self._automaton()
        # the spines of all pieces one after the other; their members, single characters too, are numbered
        numbers: dict[str, int] = {}
        n = len(codec.pieces)
        self.spines = []
        for spines in (codec.tails, codec.heads):
            at, parts, until = np.zeros(n, np.int64), [], []
            for i, spine in spines.items():
                at[i] = len(parts)
                for part, score in spine:
                    parts.append(numbers.setdefault(part, len(numbers)))
                    until.append(score)
            self.spines.append((at, np.array(parts, np.int64), np.array(until, np.float64)))
        joins = {}
        for piece, (score, _) in codec.rank.items():
            for k in range(1, len(piece)):
                left, right = numbers.get(piece[:k]), numbers.get(piece[k:])
                if left is not None and right is not None:
                    joins[left << 20 | right] = score
        self.joins = np.array(sorted(joins), np.int64)
        self.scores = np.array([joins[k] for k in self.joins.tolist()], np.float64)
        self.early = np.zeros(n, bool)
        self.early[[codec.rank[p][1] for p in codec.early]] = True
        self.known = np.full(self.SLOTS, -1, np.int64)
        self.fits = np.zeros(self.SLOTS, bool)
        self.byte_ids = np.array([codec.bytes[b] for b in range(256)], np.int64)

    def _automaton(self) -> None:
        """The Aho-Corasick automaton in arrays: steps and where they lead, fall-backs, and of each state the longest piece
        that ends there and the state of the next shorter one (0: none)."""
        pieces = [(self.codec.pieces[i], size, i) for _, (size, i) in self.codec.automaton.items()]
        letters = sorted(set().union(*self.codec.rank))
        self.letters = np.zeros(0x110000, np.uint16)
        self.letters[[ord(x) for x in letters]] = np.arange(1, len(letters) + 1)
        number = {x: k for k, x in enumerate(letters, 1)}
        steps, parents, came, size, piece = {}, [0], [0], [0], [0]
        for text, n, i in pieces:
            state = 0
            for x in text:
                key = state << 16 | number[x]
                following = steps.get(key)
                if following is None:
                    following = steps[key] = len(size)
                    parents.append(state)
                    came.append(number[x])
                    size.append(0)
                    piece.append(0)
                state = following
            size[state], piece[state] = n, i
        fall, ends, depth = [0] * len(size), [0] * len(size), [0] * len(size)
        for state in range(1, len(size)):
            depth[state] = depth[parents[state]] + 1
        for state in sorted(range(1, len(size)), key=depth.__getitem__):
            back, x = parents[state], came[state]
            while back:
                back = fall[back]
                if (known := steps.get(back << 16 | x)) is not None:
                    fall[state] = known
                    break
            ends[state] = state if size[state] else ends[fall[state]]
        shorter = [ends[f] for f in fall]
        self.steps = np.array(sorted(steps), np.int64)
        self.leads = np.array([steps[k] for k in self.steps.tolist()], np.int32)
        self.fall, self.ends, self.shorter = (np.array(x, np.int32) for x in (fall, ends, shorter))
        self.size, self.piece = np.array(size, np.int32), np.array(piece, np.int32)
        #: Between words; no piece has it.
        self.gap = next(chr(c) for c in range(0x110000) if not self.letters[c])

    def _step(self, state: np.ndarray, letter: np.ndarray) -> np.ndarray:
        """Where the letter leads to from each state, -1 where no piece goes on with it."""
        key = state.astype(np.int64) << 16 | letter
        at = np.minimum(np.searchsorted(self.steps, key), len(self.steps) - 1)
        return np.where(self.steps[at] == key, self.leads[at], -1)

    def _next(self, state: np.ndarray, letter: np.ndarray) -> np.ndarray:
        """The automaton's state after the letter."""
        out = self._step(state, letter)
        rows = np.flatnonzero(out < 0)
        now = state[rows]
        while len(rows):
            out[rows[now == 0]] = 0
            rows, now = rows[now > 0], self.fall[now[now > 0]]
            found = self._step(now, letter[rows])
            out[rows] = found
            rows, now = rows[found < 0], now[found < 0]
        return out

    def _replayed(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """``PieceCodec._replayed`` of many pairs."""
        (tail_at, tails, tail_until), (head_at, heads, head_until) = self.spines
        out = np.zeros(len(a), bool)
        odd = self.early[a] | self.early[b]
        for k in np.flatnonzero(odd).tolist():
            out[k] = self.codec._replayed(int(a[k]), int(b[k]))
        rows = np.flatnonzero(~odd)
        i, j = tail_at[a[rows]], head_at[b[rows]]
        while len(rows):
            left_until, right_until = tail_until[i], head_until[j]
            key = tails[i] << 20 | heads[j]
            at = np.minimum(np.searchsorted(self.joins, key), len(self.joins) - 1)
            score = np.where(self.joins[at] == key, self.scores[at], np.inf)
            lost = (score < left_until) & (score <= right_until)
            done = np.isinf(left_until) & np.isinf(right_until)
            out[rows[done & ~lost]] = True
            go = ~(lost | done)
            left = (left_until <= right_until)[go]
            rows, i, j = rows[go], i[go] + left, j[go] + ~left
        return out

    def compatible(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """``PieceCodec.compatible`` of many pairs."""
        key = a << 20 | b
        slot = (key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(45)).astype(np.int64)
        out = self.fits[slot]
        new = np.flatnonzero(self.known[slot] != key)
        if len(new):
            keys, back = np.unique(key[new], return_inverse=True)
            fits = self._replayed(keys >> 20, keys & 0xFFFFF)
            out[new] = fits[back]
            # of keys that share a slot the last one written stays, with its own answer
            slots, first = np.unique(slot[new], return_index=True)
            self.known[slots], self.fits[slots] = key[new][first], out[new][first]
        return out

    def encoded(self, words: list[str]) -> list[bytes]:
        """The ids of each word as bytes."""
        out, some, size = [b""] * len(words), [], 0
        one_by_one = []
        for k, word in enumerate(words):
            if len(word) > LONG_WORD or SPACE * 2 in word:
                one_by_one.append(k)
                continue
            some.append(k)
            size += len(word)
            if size > AT_ONCE:
                one_by_one += self._encoded(words, some, out)
                some, size = [], 0
        if some:
            one_by_one += self._encoded(words, some, out)
        for k in one_by_one:
            out[k] = self.codec.word_bytes(words[k])
        return out

    def _encoded(self, words: list[str], some: list[int], out: list[bytes]) -> list[int]:
        """Put the ids of some words in their places; returns those for which no single sequence was found."""
        some = sorted(some, key=lambda k: -len(words[k]))
        text = self.gap + self.gap.join([words[k] for k in some]) + self.gap
        points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        letters = self.letters[points]
        sizes = np.array([len(words[k]) for k in some])
        starts = np.cumsum(sizes + 1) - sizes
        ends = starts + sizes - 1
        # the last piece of each word up to a place; -1: no piece holds the character, so that nothing merges across it
        last, length = np.where(letters == 0, -1, -2), np.ones(len(points), np.int64)
        state = np.zeros(len(some), np.int32)
        for place in range(int(sizes[0])):
            going = int(np.searchsorted(-sizes, -place))  # longer words come first
            at = starts[:going] + place
            state = self._next(state[:going], letters[at])
            node = self.ends[state]
            at, node = at[node > 0], node[node > 0]
            while len(at):
                size, piece = self.size[node], self.piece[node].astype(np.int64)
                before = last[at - size]
                fits = before == -1
                ask = np.flatnonzero(before >= 0)
                fits[ask] = self.compatible(before[ask], piece[ask])
                last[at[fits]], length[at[fits]] = piece[fits], size[fits]
                node = np.where(fits, 0, self.shorter[node])
                at, node = at[node > 0], node[node > 0]
        bad = last == -2
        wrong = np.add.reduceat(bad, starts - 1) > 0
        taken = np.zeros(len(points), bool)
        at, first = ends[~wrong], starts[~wrong]
        while len(at):
            taken[at] = True
            at = at - length[at]
            inside = at >= first
            at, first = at[inside], first[inside]
        chosen = np.flatnonzero(taken)
        ids = last[chosen]
        counts = np.ones(len(chosen), np.int64)
        byte_wise = np.flatnonzero(ids == -1)
        codes = points[chosen[byte_wise]]
        utf8 = [chr(c).encode() for c in codes.tolist()]
        counts[byte_wise] = [len(x) for x in utf8]
        stops = np.cumsum(counts)
        ids = np.repeat(ids, counts)
        for stop, x in zip(stops[byte_wise].tolist(), utf8, strict=True):
            ids[stop - len(x) : stop] = self.byte_ids[list(x)]
        data = ids.astype("<u4").tobytes()
        upto = np.concatenate([np.zeros(1, np.int64), stops * 4])
        begins = upto[np.searchsorted(chosen, starts)].tolist()
        stops = upto[np.searchsorted(chosen, ends, side="right")].tolist()
        for k, b, e in zip(some, begins, stops, strict=True):
            out[k] = data[b:e]
        return [some[k] for k in np.flatnonzero(wrong).tolist()]


_CODECS: dict[str, PieceCodec] = {}


def codec(path: str) -> PieceCodec:
    """One codec for each worker process and model, so that its tables outlive a task."""
    if path not in _CODECS:
        _CODECS[path] = PieceCodec(path)
    return _CODECS[path]
