"""SentencePiece models as data: the normaliser, pieces, costs, and which pieces
BPE keeps apart."""

from __future__ import annotations

import math
import re
from collections.abc import Callable

import numpy as np
from pyspark import Broadcast
from pyspark.sql import SparkSession

SPACE = "▁"
LETTER = re.compile(r"[^\W\d_]")
PUNCTUATION = ".,;:!?#$%&*|)"
#: Bytes that a worker's table holds, about, before the older half goes; what
#: an entry takes beside its texts; and the longest key that is kept at all.
TABLE_BYTES = 20 << 20
ENTRY_BYTES = 240
LONGEST_KEPT = 200


class Bounded(dict):
    """A table computed on first use that holds two generations of entries of at
    most ``most`` bytes each. Keys that are long texts are computed every time."""

    def __init__(self, compute: Callable, most: int = TABLE_BYTES):
        super().__init__()
        self.compute, self.most, self.older, self.held = compute, most, {}, 0

    def __missing__(self, key):
        if len(key) > LONGEST_KEPT:
            return self.compute(key)
        value = self.older.pop(key, None)
        if value is None:
            value = self.compute(key)
        self.held += ENTRY_BYTES + (len(value) if isinstance(value, bytes | str | tuple) else 0) + len(key)
        if self.held > self.most:
            self.older = dict(self)
            self.clear()
            self.held = 0
        self[key] = value
        return value


def rules_of(charsmap: bytes) -> dict[str, str]:
    """The replacements of a compiled normaliser: a double-array trie of keys
    (32-bit units), and the texts its values point at, each ended by a zero.

    A unit holds a label (bits 0-7 and 31), whether a key ends there (bit 8),
    and the offset of its children (bits 10-30, shifted by 8 if bit 9 is set).
    """
    if not charsmap:
        return {}
    size = int.from_bytes(charsmap[:4], "little")
    units, texts = np.frombuffer(charsmap[4 : 4 + size], dtype="<u4").astype(np.int64), charsmap[4 + size :]
    children = np.arange(len(units)) ^ ((units >> 10) << ((units & 512) >> 6))
    labels, rules = np.arange(1, 256), {}
    level = [(b"", int(children[0]))]
    while level:
        at = np.array([base for _, base in level])[:, None] ^ labels
        inside = at < len(units)
        found = inside & ((units[np.where(inside, at, 0)] & 0x800000FF) == labels)
        following = []
        for row, column in zip(*np.nonzero(found), strict=True):
            key, unit = level[row][0] + bytes([column + 1]), int(at[row, column])
            base = int(children[unit])
            if units[unit] & 256:
                start = int(units[base]) & 0x7FFFFFFF
                rules[key.decode()] = texts[start : texts.index(b"\0", start)].decode()
            following.append((key, base))
        level = following
    return rules


class Normaliser:
    """The first part of the machine: rewrites a text by the longest rule at each
    place (user-defined pieces stay as they are), marks spaces, and puts one in
    front; with ``trim``, runs of spaces become one, and ends have none."""

    def __init__(self, spec, user: list[str]):
        self.front, self.trim, self.mark = spec.add_dummy_prefix, spec.remove_extra_whitespaces, SPACE if spec.escape_whitespaces else " "
        self.rules: dict = {}
        for key, text in rules_of(spec.precompiled_charsmap).items():
            node = self.rules
            for char in key:
                node = node.setdefault(char, {})
            node[""] = text
        self.user = pattern_of(user).match if user else None
        self.identity = not self.rules and not self.trim

    def longest(self, text: str, at: int) -> tuple[str, int]:
        """What the longest rule at a place writes, and where it ends."""
        if self.user and (found := self.user(text, at)):
            return found[0], found.end()
        node, best, i = self.rules, (text[at], at + 1), at
        while i < len(text) and (node := node.get(text[i])) is not None:
            i += 1
            if "" in node:
                best = node[""], i
        return best

    def __call__(self, text: str) -> str:
        if not text:
            return ""
        first = self.mark if self.front else ""
        if self.identity:
            return first + text.replace(" ", self.mark)
        parts, at, spaced = [], 0, self.trim
        while at < len(text):
            written, at = self.longest(text, at)
            if spaced:
                written = written.lstrip(" ")
            if written:
                parts.append(written)
                spaced = self.trim and written.endswith(" ")
        body = "".join(parts).replace(" ", self.mark)
        if self.trim:
            body = body.removesuffix(self.mark)
            return first + body if body else ""
        return first + body


def pattern_of(pieces: list[str]) -> re.Pattern:
    return re.compile("|".join(map(re.escape, sorted(pieces, key=len, reverse=True))))


class Pieces:
    """The pieces of a BPE or unigram model, with or without byte fallback.

    ``identity``: the normaliser only marks spaces, puts one in front, and no
    piece is user-defined, so that prefixes of texts are prefixes of what the
    machine reads. ``most`` bounds a generation of the table of pairs.
    """

    def __init__(self, model: bytes, most: int = TABLE_BYTES):
        from sentencepiece import sentencepiece_model_pb2 as proto

        spec = proto.ModelProto()
        spec.ParseFromString(model)
        norm, kind = spec.normalizer_spec, proto.ModelProto.SentencePiece
        if spec.trainer_spec.model_type not in (proto.TrainerSpec.BPE, proto.TrainerSpec.UNIGRAM):
            raise ValueError("only BPE and unigram models are supported")
        if spec.trainer_spec.treat_whitespace_as_suffix or any(p.type == kind.UNUSED for p in spec.pieces):
            raise ValueError("models with spaces behind words or unused pieces are not supported")
        self.is_bpe = spec.trainer_spec.model_type == proto.TrainerSpec.BPE
        self.text = [p.piece for p in spec.pieces]
        self.user = {p.piece: i for i, p in enumerate(spec.pieces) if p.type == kind.USER_DEFINED}
        self.normalised = Normaliser(norm, list(self.user))
        self.identity = self.normalised.identity and self.normalised.front and not self.user and norm.escape_whitespaces
        self.ids = {p.piece: i for i, p in enumerate(spec.pieces) if p.type == kind.NORMAL}
        self.cost = {p.piece: -p.score for p in spec.pieces if p.type == kind.NORMAL}
        self.byte_ids = {int(p.piece[3:5], 16): i for i, p in enumerate(spec.pieces) if p.type == kind.BYTE}
        self.unknown = next(i for i, p in enumerate(spec.pieces) if p.type == kind.UNKNOWN)
        self.unknown_text = spec.trainer_spec.unk_surface
        self.control = {i for i, p in enumerate(spec.pieces) if p.type == kind.CONTROL}
        if self.byte_ids and len(self.byte_ids) != 256:
            raise ValueError("the model has pieces for some bytes only")
        #: Fixed value: a character that no piece has costs 10 more than the dearest piece.
        self.unknown_cost = max(self.cost.values(), default=0.0) + 10.0
        if not self.is_bpe:
            least = min(self.cost.values(), default=0.0)
            self.ids |= self.user
            self.cost |= {p: len(p.encode()) * least + 0.1 for p in self.user}
        self.apart_from = pattern_of(list(self.user)) if self.is_bpe and self.user else None
        self.back: dict = {}
        for piece in self.ids:
            node = self.back
            for char in reversed(piece):
                node = node.setdefault(char, {})
            node[""] = piece
        self.split = self._split()
        self.halves: dict[str, tuple[str, str]] = {}
        self.apart = Bounded(self._apart, most)

    def _split(self) -> Callable[[str], list[str]]:
        """Cuts a normalised text into chunks that no piece spans; into one chunk
        if pieces have spaces inside, or runs of unknown characters are one id."""
        if any(SPACE in p.lstrip(SPACE) for p in self.ids) or not self.byte_ids or self.normalised.mark != SPACE:
            return lambda text: [text] if text else []
        # No piece spans the place before a space, the places around a character that
        # no piece has, or that between a letter and a mark that follows none in any piece.
        inside = set("".join(self.ids))
        lone = "".join(c for c in "\n\t\r" if c not in inside)
        stop = re.escape(SPACE + lone)
        follows = {p[i] for p in self.ids for i in range(1, len(p)) if LETTER.fullmatch(p[i - 1])}
        ends = re.escape("".join(c for c in PUNCTUATION if c not in follows))
        word = f"{SPACE}*[^\\W\\d_]+(?=[{stop}{ends}]|$)|" if SPACE not in follows else ""
        return re.compile(f"{word}{SPACE}*[^{stop}]+|{SPACE}+" + (f"|[{re.escape(lone)}]" if lone else "")).findall

    def chunks(self, text: str) -> list[str]:
        """What is read one by one: chunks of the normalised text, and, for BPE,
        user-defined pieces, which no other piece may cross."""
        text = self.normalised(text)
        if self.apart_from is None:
            return self.split(text)
        found, at = [], 0
        for m in self.apart_from.finditer(text):
            found += [*self.split(text[at : m.start()]), m[0]]
            at = m.end()
        return found + self.split(text[at:])

    def fallback(self, char: str) -> list[int]:
        return [self.byte_ids[b] for b in char.encode("utf-8", "surrogatepass")] if self.byte_ids else [self.unknown]

    def relaxed(self, chunk: str) -> list[str]:
        """The last piece on the shortest path to each place of a chunk, by
        relaxing the arcs into the places from left to right.

        A unigram arc weighs its piece's cost. A BPE arc weighs 0 if BPE keeps
        its piece apart from the path's last one, else infinity; each place has
        just one arc of finite weight, so the first that is found is it. A
        character that no piece has is an arc of byte fallback.
        """
        back, last = self.back, [""]
        if self.is_bpe:
            apart = self.apart
            for i in range(1, len(chunk) + 1):
                node, at = back, i - 1
                while at >= 0 and (node := node.get(chunk[at])) is not None:
                    if "" in node and apart[last[at], node[""]]:
                        last.append(node[""])
                        break
                    at -= 1
                else:
                    last.append(chunk[i - 1])
            return last
        best, cost = [0.0], self.cost
        for i in range(1, len(chunk) + 1):
            node, at, least, piece = back, i - 1, math.inf, chunk[i - 1]
            if piece not in cost:
                least = best[at] + self.unknown_cost
            while at >= 0 and (node := node.get(chunk[at])) is not None:
                if "" in node and (total := best[at] + cost[node[""]]) <= least:
                    least, piece = total, node[""]
                at -= 1
            best.append(least)
            last.append(piece)
        return last

    def shortest(self, chunk: str) -> list[int]:
        """Ids on the shortest path over a chunk."""
        if chunk in self.user:
            return [self.user[chunk]]
        last, at, path = self.relaxed(chunk), len(chunk), []
        while at:
            path.append(last[at])
            at -= len(last[at])
        ids = self.ids
        return [i for p in reversed(path) for i in ([ids[p]] if p in ids else self.fallback(p))]

    def _next(self, parts: list[str]) -> int | None:
        joins = [(self.cost[p], i) for i in range(len(parts) - 1) if (p := parts[i] + parts[i + 1]) in self.cost]
        return min(joins)[1] if joins else None

    def _halves(self, piece: str) -> tuple[str, str]:
        """The two parts whose join made a piece; empty parts if BPE never makes it."""
        if piece not in self.halves:
            parts = list(piece)
            while len(parts) > 2 and (at := self._next(parts)) is not None:
                parts[at : at + 2] = [parts[at] + parts[at + 1]]
            self.halves[piece] = (parts[0], parts[1]) if len(parts) == 2 else ("", "")
        return self.halves[piece]

    def _made(self, piece: str) -> bool:
        return len(piece) == 1 or self._halves(piece) != ("", "")

    def _apart(self, pair: tuple[str, str]) -> bool:
        """Whether BPE of the joined text is this very pair.

        Walks back in time from the finished pieces: at each step the part
        made last is undone at the border, and the two parts that then met
        must not have joined before that.
        """
        left, right = pair
        if not left:
            return self._made(right)
        if not (self._made(left) and self._made(right)):
            return False
        until, ties = math.inf, False  # ties: the border is left of the join undone last, so it goes first
        while True:
            cost = self.cost.get(left + right, math.inf)
            if cost < until or ties and cost == until:
                return False
            made = [self.cost[p] if len(p) > 1 else -math.inf for p in (left, right)]
            until, ties = max(made), made[0] <= made[1]
            if until == -math.inf:
                return True
            if ties:
                right = self._halves(right)[0]
            else:
                left = self._halves(left)[1]


def shared_model(spark: SparkSession, path: str) -> Broadcast:
    """The model file's bytes, read by the driver; a vocabulary file has a fixed size."""
    with open(path, "rb") as file:
        return spark.sparkContext.broadcast(file.read())


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")
