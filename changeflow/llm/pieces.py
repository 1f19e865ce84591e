"""The piece lattice of a SentencePiece vocabulary: segments of a text, matches by Aho-Corasick, sums over paths.

A text is read with a space in front and with spaces as pieces write them. No piece goes on past a space that follows
another character, so a text is the chain of its segments: a run of spaces with the characters up to the next space. Equal
segments have equal lattices, and these are built for all distinct segments of a batch at once: the automaton and the
sums go through the segments side by side, a character at a time.

A character that is no piece itself is spelled with the vocabulary's byte pieces, and so is the space sign ``▁`` where a
text has it. Control pieces match nothing.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass
from functools import lru_cache
from itertools import chain

import numpy as np
import sentencepiece

SPACE = "▁"
BREAK = "\n"  # no piece holds it
UNKNOWN_PENALTY = 10.0
_parts = re.compile(f"{SPACE}| *[^ {SPACE}]+| +")


class Automaton:
    """Aho-Corasick over pieces, for many strings side by side: a state for each, and one step for all of them.

    ``step`` looks up the frequent characters in a table with failure links followed beforehand; for others it follows
    them. The pieces that end in state s are ``pieces[starts[s] : starts[s + 1]]``, longest first.
    """

    FREQUENT = 96

    def __init__(self, pieces: dict[str, int]) -> None:
        children: list[dict[str, int]] = [{}]
        own: list[int] = [-1]
        for piece, i in pieces.items():
            state = 0
            for char in piece:
                following = children[state].get(char)
                if following is None:
                    following = children[state][char] = len(children)
                    children.append({})
                    own.append(-1)
                state = following
            own[state] = i
        n = len(children)
        uses = Counter(chain.from_iterable(pieces))
        common = [c for c, _ in uses.most_common(self.FREQUENT)]
        self.column = np.full(0x110000, -1, np.int16)
        self.column[[ord(c) for c in common]] = np.arange(len(common))
        place = {c: k for k, c in enumerate(common)}
        self.fail, self.table = np.zeros(n, np.int32), np.zeros((n, len(common)), np.int32)
        ends: list[list[int]] = [[] for _ in range(n)]
        queue = [0]
        for state in queue:
            fail = self.fail[state]
            if state:
                self.table[state] = self.table[fail]
                ends[state] = ([own[state]] if own[state] >= 0 else []) + ends[fail]
            for char, child in children[state].items():
                back = fail
                while state and back and char not in children[back]:
                    back = self.fail[back]
                self.fail[child] = children[back].get(char, 0) if state else 0
                queue.append(child)
            for char, child in children[state].items():
                if char in place:
                    self.table[state, place[char]] = child
        rare = sorted((state << 21 | ord(c), child) for state in range(n) for c, child in children[state].items() if c not in place)
        self.edge = np.array([e for e, _ in rare], np.int64)
        self.target = np.array([t for _, t in rare], np.int32)
        self.starts = np.r_[0, np.cumsum([len(e) for e in ends])]
        self.pieces = np.fromiter(chain.from_iterable(ends), np.int32)

    def step(self, state: np.ndarray, codes: np.ndarray) -> np.ndarray:
        column = self.column[codes]
        out = self.table[state, column]
        todo = np.flatnonzero(column < 0)
        if len(todo):
            out[todo] = 0
            now = state[todo].astype(np.int64)
            while len(todo) and len(self.edge):
                key = now << 21 | codes[todo]
                at = np.minimum(np.searchsorted(self.edge, key), len(self.edge) - 1)
                hit = self.edge[at] == key
                out[todo[hit]] = self.target[at[hit]]
                more = ~hit & (now > 0)
                todo, now = todo[more], self.fail[now[more]].astype(np.int64)
        return out


@dataclass(frozen=True)
class Vocabulary:
    """``scores`` and ``lengths`` of ids (length 0: no match), the id of each byte, and what decoding puts for an id."""

    automaton: Automaton
    lengths: np.ndarray
    scores: np.ndarray
    byte_ids: np.ndarray
    decoded: tuple[bytes, ...]
    unknown: float


@lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    n = model.vocab_size()
    lengths, scores, byte_ids = np.zeros(n, np.int32), np.zeros(n), np.full(256, -1, np.int64)
    decoded, pieces = [], {}
    for i in range(n):
        piece = model.id_to_piece(i)
        scores[i] = model.get_score(i)
        if model.is_byte(i):
            byte_ids[int(piece[1:-1], 16)] = i
            decoded.append(bytes([int(piece[1:-1], 16)]))
        elif model.is_control(i) or model.is_unknown(i) or model.is_unused(i):
            decoded.append(b"")
        else:
            if BREAK in piece or (SPACE in piece.lstrip(SPACE)):
                raise ValueError(f"piece {i} spans segments")
            lengths[i] = len(piece)
            pieces[piece] = i
            decoded.append(piece.replace(SPACE, " ").encode())
    if (byte_ids < 0).any():
        raise ValueError("the vocabulary lacks byte pieces")
    return Vocabulary(Automaton(pieces), lengths, scores, byte_ids, tuple(decoded), float(scores[lengths > 0].min()) - UNKNOWN_PENALTY)


def segments(text: str) -> list[str]:
    """Segments of a text: without their space if they have one space in front, else whole behind a ``▁``."""
    if not text:
        return []
    if SPACE not in text:
        parts = text.split(" ")
        if "" not in parts:
            return parts
    found = _parts.findall(" " + text)
    return [s[1:] if s[0] == " " and len(s) > 1 and s[1] != " " else SPACE + s for s in found]


def spelled(segment: str) -> str:
    """A segment as pieces write it; the space sign itself as ``BREAK``, which no piece matches."""
    if segment[:1] != SPACE:
        return SPACE + segment
    return BREAK if segment == SPACE + SPACE else segment[1:].replace(" ", SPACE)


@dataclass
class Lattice:
    """The lattices of some segments side by side. Nodes are places between characters, those of a level (characters before
    them) together; ``first`` and ``last`` are the outer nodes of each segment.

    Edges have ``start``, ``end`` and ``piece`` (-1 - byte length for a spelled character); they are sorted by end node,
    longer ones first, and ``bounds`` has where each level's begin.
    """

    names: list[str]
    written: list[str]
    longest_first: np.ndarray
    base: np.ndarray
    first: np.ndarray
    last: np.ndarray
    start: np.ndarray
    end: np.ndarray
    piece: np.ndarray
    bounds: list[int]
    nodes: int

    def levels(self):
        """(edges, where each end node's edges begin among them) of each level."""
        for low, high in zip(self.bounds[:-1], self.bounds[1:], strict=True):
            if high > low:
                end = self.end[low:high]
                yield slice(low, high), np.flatnonzero(np.r_[True, end[1:] != end[:-1]])

    def spelled_bytes(self, edges: np.ndarray, vocab: Vocabulary) -> list[np.ndarray]:
        """Byte pieces of spelled characters, by edge."""
        level = np.searchsorted(self.base, self.end[edges], side="right") - 1
        owner = self.longest_first[self.end[edges] - self.base[level]]
        made = []
        for k, at in zip(owner, level - 1, strict=True):
            char = SPACE if self.names[k] == SPACE + SPACE else self.written[k][at]
            made.append(vocab.byte_ids[np.frombuffer(char.encode("utf-8", "surrogatepass"), np.uint8)])
        return made


def lattice(names: list[str], vocab: Vocabulary) -> Lattice:
    machine = vocab.automaton
    written = [spelled(s) for s in names]
    sizes = np.fromiter(map(len, written), np.int64, len(written))
    order = np.argsort(-sizes, kind="stable")
    codes = np.frombuffer("".join(written).encode("utf-32-le", "surrogatepass"), np.uint32)
    offset = (np.cumsum(sizes) - sizes)[order]
    longest = int(sizes.max(initial=0))
    active = len(sizes) - np.searchsorted(sizes[order][::-1], np.arange(longest + 1))  # segments with so many characters
    base = np.r_[0, np.cumsum(active)]
    sign = np.fromiter((names[k] == SPACE + SPACE for k in order), bool, len(order))
    state = np.zeros(len(order), np.int32)
    starts, ends, pieces, bounds = [], [], [], [0]
    for level in range(1, longest + 1):
        n = int(active[level])
        at = codes[offset[:n] + (level - 1)]
        state = machine.step(state[:n], at)
        low = machine.starts[state]
        count = machine.starts[state + 1] - low
        owner = np.repeat(np.arange(n), count)
        piece = machine.pieces[np.arange(len(owner)) + np.repeat(low - np.cumsum(count) + count, count)]
        length = vocab.lengths[piece]
        alone = np.ones(n, bool)
        alone[owner[length == 1]] = False
        lone = np.flatnonzero(alone)
        if len(lone):  # behind the longer edges to the same place
            c = at[lone]
            size = 1 + (c >= 0x80).astype(np.int32) + (c >= 0x800) + (c >= 0x10000)
            size[sign[lone]] = 3  # the space sign, which stands as BREAK
            owner, piece, length = np.r_[owner, lone], np.r_[piece, -1 - size], np.r_[length, np.ones(len(lone), np.int32)]
            sort = np.argsort(owner, kind="stable")
            owner, piece, length = owner[sort], piece[sort], length[sort]
        starts.append((base[level - length] + owner).astype(np.int32))
        ends.append((base[level] + owner).astype(np.int32))
        pieces.append(piece.astype(np.int32))
        bounds.append(bounds[-1] + len(owner))
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    empty = [np.empty(0, np.int32)]
    joined = []
    for made in (starts, ends, pieces):
        joined.append(np.concatenate(made or empty))
        made.clear()
    return Lattice(names, written, order, base, rank, base[sizes] + rank, *joined, bounds, int(base[-1]))


def best_counts(names: list[str], vocab: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """Pieces and score of the best path of each segment. Of equal paths to a place the one whose last piece is longest
    stays, as the tokenizer keeps the first of equal candidates."""
    lat = lattice(names, vocab)
    best, count = np.full(lat.nodes, -np.inf), np.zeros(lat.nodes, np.int64)
    best[lat.first] = 0.0
    for edges, groups in lat.levels():
        piece = lat.piece[edges]
        reach = best[lat.start[edges]] + np.where(piece >= 0, vocab.scores[piece], vocab.unknown)
        top = np.maximum.reduceat(reach, groups)
        sizes = np.diff(np.r_[groups, len(reach)])
        equal = np.flatnonzero(reach == np.repeat(top, sizes))
        owner = np.repeat(np.arange(len(groups)), sizes)[equal]
        winner = equal[np.r_[True, owner[1:] != owner[:-1]]]
        ends = lat.end[edges][groups]
        best[ends] = top
        count[ends] = count[lat.start[edges][winner]] + np.where(piece[winner] >= 0, 1, -1 - piece[winner])
    return count[lat.last], best[lat.last]
