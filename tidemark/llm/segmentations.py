"""SentencePiece encoding by sampled segmentations without replacement, and decoding.

The lattice of a text has a node before each character and an edge for each piece; a segmentation is a path and its
probability is the product of its edges' weights over the sum for all paths. Each node's edges are normalised by the
weight of all paths beyond them, so a walk that draws edge after edge draws a whole segmentation.

Gumbel top-k: give every segmentation its log-probability plus Gumbel noise, and the k largest values are a sample of
k distinct ones without replacement. A-star search finds them without listing any others: the largest value of a set
of paths is itself Gumbel with the set's log-probability, so the frontier holds sets (what a found path did not take
at one of its nodes), each with its largest value, drawn below that of the set it was split from. The set with the
largest value is opened, a walk completes its best path, and what the walk did not take joins the frontier. The value
left on top after k paths gives each sample its inclusion probability.

No piece reaches over the beginning of a word, so the lattice is a chain of word lattices; each distinct one is built
once, and the walks of all texts of a batch go step by step together.
"""

from __future__ import annotations

import itertools
import math
import re
import struct
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import common

SPACE = "▁"
EDGE = np.dtype([("to", "<u4"), ("id", "<u4"), ("p", "<f8"), ("cum", "<f8")])
PACK = struct.Struct("<IIdd")
#: Word lattices kept during a task, of about 800 bytes each; a batch adds at most as many as it has characters.
KEPT = 80_000
#: Characters of texts sampled together.
TOGETHER = 60_000
#: Characters in the transition table of the trie, the most frequent in the vocabulary.
FREQUENT = 254
SAMPLES = "array<struct<ids:binary,log_prob:double,value:double,inclusion:double>>"
OUT = pa.schema([("row_id", pa.int64()), ("samples", pa.list_(pa.struct([("ids", pa.binary()), ("log_prob", pa.float64()), ("value", pa.float64()), ("inclusion", pa.float64())]))), ("round_trip", pa.bool_())])


def mix(x: np.ndarray) -> np.ndarray:
    """Splitmix64's finaliser: independent-looking 64 bits for every counter."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


GOLD = np.uint64(0x9E3779B97F4A7C15)


def uniform(x: np.ndarray) -> np.ndarray:
    """In (0, 1)."""
    return ((mix(x) >> np.uint64(12)).astype(np.float64) + 0.5) * 2.0**-52


def stretches(begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The numbers begin, begin + 1, ... of each stretch, one stretch after the other."""
    return np.repeat(begin - np.cumsum(size) + size, size) + np.arange(int(size.sum()))


class Index(dict):
    """Numbers of words; new ones get the next number when first asked for, and wait in ``new``."""

    def __init__(self, words=()):
        super().__init__(words)
        self.new: list[str] = []

    def __missing__(self, word: str) -> int:
        self[word] = k = len(self)
        self.new.append(word)
        return k


class Pieces:
    """The vocabulary: weights by Zipf's law over the order of the pieces, as a BPE model stores ranks and no
    probabilities; ``theta`` above 1 sharpens the distribution."""

    def __init__(self, path: str, theta: float):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        size = model.get_piece_size()
        self.ids: dict[str, int] = {}
        self.byte_ids = [model.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        self.raw = [b""] * size
        rank = 0
        weights = np.zeros(size)
        for i in range(size):
            if model.is_byte(i):
                self.raw[i] = bytes([int(model.id_to_piece(i)[3:5], 16)])
            elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
                piece = model.id_to_piece(i)
                self.ids[piece] = i
                self.raw[i] = piece.replace(SPACE, " ").encode()
                rank += 1
                weights[i] = (1 + rank) ** -theta
        self.blob = np.frombuffer(b"".join(self.raw), dtype=np.uint8)
        self.blob_at = np.concatenate(([0], np.cumsum([len(x) for x in self.raw])))
        self.weights = weights.tolist()
        self.longest = max(map(len, self.ids))
        self.log_weights = np.log(np.maximum(weights, 1e-300))
        # a trie over the most frequent characters: state and character give the next state, 0 if no piece goes on so
        common_chars = [c for c, _ in Counter(itertools.chain.from_iterable(self.ids)).most_common(FREQUENT)]
        self.letter = np.zeros(0x110000, dtype=np.uint8)
        self.letter[[ord(c) for c in common_chars]] = np.arange(1, len(common_chars) + 1)
        states: dict[str, int] = {"": 0}
        for p in self.ids:
            if all(self.letter[ord(c)] for c in p):
                for length in range(1, len(p) + 1):
                    states.setdefault(p[:length], len(states))
        self.moves = np.zeros((len(states), FREQUENT + 1), dtype=np.uint16 if len(states) < 1 << 16 else np.int32)
        self.piece_at = np.full(len(states), -1, dtype=np.int64)
        for text, state in states.items():
            if text:
                self.moves[states[text[:-1]], self.letter[ord(text[-1])]] = state
                self.piece_at[state] = self.ids.get(text, -1)
        if any(SPACE in p.lstrip(SPACE) for p in self.ids):
            self.words = re.compile(r".+", re.S)
        elif any("\n" in p for p in self.ids):
            self.words = re.compile(rf"{SPACE}*[^{SPACE}]+|{SPACE}+")
        else:
            self.words = re.compile(rf"\n|{SPACE}*[^{SPACE}\n]+|{SPACE}+")
        # the store of word lattices: arrays over the edges and nodes of all words
        self.first_edge = np.zeros(1, dtype=np.int64)
        self.step = np.zeros(0, dtype=np.uint8 if self.longest < 256 else np.uint32)  # nodes passed
        self.id = np.zeros(0, dtype=np.uint16 if size <= 1 << 16 else np.uint32)
        self.cum, self.p = np.zeros(0), np.zeros(0)
        self.begin, self.end, self.uses = (np.zeros(0, dtype=np.int64) for _ in range(3))
        self.index = Index()
        self.nodes = self.edges = 0

    def split(self, text: str) -> list[str]:
        return self.words.findall(SPACE + text.replace(" ", SPACE)) if text else []

    def forget(self) -> None:
        """Keep the words used most since they came, half the bound at most, and none used but once."""
        k = len(self.index)
        uses, begin, end = self.uses[:k], self.begin[:k], self.end[:k]
        keep = np.flatnonzero(uses > 1)
        if len(keep) > KEPT // 2:
            keep = np.sort(keep[np.argpartition(uses[keep], len(keep) - KEPT // 2)[len(keep) - KEPT // 2 :]])
        n = len(keep)
        old, sizes, first = begin[keep], end[keep] - begin[keep] + 1, self.first_edge[begin[keep]]
        counts = self.first_edge[end[keep]] - first
        new, new_first = np.cumsum(sizes) - sizes, np.cumsum(counts) - counts
        node, edge = stretches(old, sizes), stretches(first, counts)
        self.first_edge[: len(node)] = self.first_edge[node] + np.repeat(new_first - first, sizes)
        self.first_edge[len(node)] = len(edge)
        for name in ("step", "id", "cum", "p"):
            own = getattr(self, name)
            own[: len(edge)] = own[edge]
        self.begin[:n], self.end[:n], self.uses[:n] = new, new + sizes - 1, uses[keep] // 2
        words = list(self.index)
        self.index = Index((words[i], at) for at, i in enumerate(keep.tolist()))
        self.nodes, self.edges = len(node), len(edge)

    def _room(self, name: str, size: int) -> np.ndarray:
        own = getattr(self, name)
        if len(own) < size:
            own = np.concatenate((own, np.zeros(max(size - len(own), len(own) // 4, 1 << 16), dtype=own.dtype)))
            setattr(self, name, own)
        return own

    def _store(self, numbers: np.ndarray, edges: tuple, counts: np.ndarray, sizes: np.ndarray) -> None:
        """Words by their numbers: ``edges`` (step, id, p, cum) in order of nodes, ``counts`` of each node with the zero
        of each word's end, ``sizes`` in nodes."""
        step, ids, p, cum = edges
        starts = np.concatenate(([0], np.cumsum(counts)))
        ends = np.cumsum(sizes)
        base, a, top = self.nodes + ends - sizes, self.edges, len(self.index)
        b = a + len(step)
        self._room("first_edge", self.nodes + len(counts) + 1)[self.nodes : self.nodes + len(counts) + 1] = a + starts
        self._room("step", b)[a:b] = step
        self._room("id", b)[a:b] = ids
        self._room("cum", b)[a:b] = cum
        self._room("p", b)[a:b] = p
        self._room("begin", top)[numbers] = base
        self._room("end", top)[numbers] = base + sizes - 1
        self._room("uses", top)[numbers] = 0
        self.nodes, self.edges = self.nodes + len(counts), b

    def lattice(self, word: str) -> tuple[bytes, bytes]:
        """Packed edges ordered by node, and the number of edges of each node (the last has none)."""
        ids, weights = self.ids, self.weights
        units: list = []
        for c in word:
            units += [c] if c in ids else list(c.encode())
        n = len(units)
        edges: list[list[tuple[int, int, float]]] = []
        for i in range(n):
            if type(units[i]) is int:
                edges.append([(i + 1, self.byte_ids[units[i]], 1.0)])
                continue
            own, piece = [], ""
            for j in range(i, min(n, i + self.longest)):
                if type(units[j]) is int:
                    break
                piece += units[j]
                k = ids.get(piece)
                if k is not None:
                    own.append((j + 1, k, weights[k]))
            edges.append(own[::-1])
        # weight of all paths from each node; scaled as logs, for words of any length
        beyond = [0.0] * (n + 1)
        parts, counts = [], []
        for i in range(n - 1, -1, -1):
            own = edges[i]
            if len(own) == 1:
                to, k, w = own[0]
                beyond[i] = math.log(w) + beyond[to]
                parts.append(PACK.pack(to, k, 1.0, 1.0))
            else:
                top = max([beyond[e[0]] for e in own])
                share = [w * math.exp(beyond[to] - top) for to, _, w in own]
                total = sum(share)
                beyond[i] = top + math.log(total)
                cum, out = 0.0, []
                for (to, k, _), s in zip(own, share):
                    cum += s
                    out.append(PACK.pack(to, k, s / total, cum / total))
                out[-1] = PACK.pack(own[-1][0], own[-1][1], share[-1] / total, 1.0)
                parts.append(b"".join(out))
            counts.append(len(own))
        parts.reverse()
        counts.reverse()
        return b"".join(parts), np.array([*counts, 0], dtype="<u4").tobytes()

    def add(self) -> None:
        """Store the lattices of the index's new words: all go down the trie, and their weights add up from the end,
        together. Words with a rare character are built one by one."""
        words, self.index.new = self.index.new, []
        if not words:
            return
        numbers = np.arange(len(self.index) - len(words), len(self.index))
        text = np.frombuffer("".join(words).encode("utf-32-le"), dtype="<u4")
        size = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        letter = self.letter[text]
        plain = np.logical_and.reduceat(letter > 0, np.cumsum(size) - size)
        if not plain.all():
            packed, counts = zip(*[self.lattice(w) for w, ok in zip(words, plain.tolist()) if not ok])
            edges = np.frombuffer(b"".join(packed), dtype=EDGE)
            sizes = np.array([len(c) // 4 for c in counts])
            counts = np.frombuffer(b"".join(counts), dtype="<u4").astype(np.int64)
            node = np.repeat(np.arange(len(counts)) - np.repeat(np.cumsum(sizes) - sizes, sizes), counts)
            self._store(numbers[~plain], (edges["to"] - node, edges["id"], edges["p"], edges["cum"]), counts, sizes)
            numbers = numbers[plain]
        letter, size = letter[np.repeat(plain, size)], size[plain]
        n = len(letter)
        if not n:
            return
        end = np.repeat(np.cumsum(size), size)
        live, state, parts = np.arange(n), np.zeros(n, dtype=self.moves.dtype), []
        for length in range(1, self.longest + 1):
            keep = live + length <= end[live]
            live = live[keep]
            state = self.moves[state[keep], letter[live + length - 1]]
            keep = state > 0
            live, state = live[keep], state[keep]
            if not len(live):
                break
            found = self.piece_at[state]
            hit = found >= 0
            parts.append((live[hit], found[hit]))
        # edges in order of their nodes, longest first: those are the likely ones, which a draw finds soonest
        counts = np.bincount(np.concatenate([x for x, _ in parts]), minlength=n)
        first = np.cumsum(counts) - counts
        free, total_edges = first + counts - 1, int(counts.sum())
        node, length, piece = (np.empty(total_edges, dtype=np.int64) for _ in range(3))
        for k, (at, found) in enumerate(parts, 1):
            place = free[at]
            node[place], length[place], piece[place] = at, k, found
            free[at] = place - 1
        # nodes from the end of their words on, all of one distance together
        value, total = self.log_weights[piece], np.zeros(n + 1)
        left = end[node] - node
        by_left = np.argsort(left.astype(np.uint16) if len(left) and left.max() < 1 << 16 else left, kind="stable")
        cuts = np.concatenate(([0], np.flatnonzero(np.diff(left[by_left])) + 1, [len(node)]))
        to, inside = node + length, left > length
        for a, b in zip(cuts, cuts[1:]):
            e = by_left[a:b]
            value[e] += np.where(inside[e], total[to[e]], 0.0)
            own = node[e]
            starts = np.flatnonzero(np.concatenate(([True], own[1:] != own[:-1])))
            total[own[starts]] = np.logaddexp.reduceat(value[e], starts)
        p = np.exp(value - total[node])
        run = np.cumsum(p)
        cum = np.minimum(run - np.repeat(run[first] - p[first], counts), 1.0)
        last = first + counts - 1
        cum[last] = 1.0
        p[last[counts == 1]] = 1.0
        self._store(numbers, (length, piece, p, cum), np.insert(counts, np.cumsum(size), 0), size + 1)

    def round_trips(self, texts: list[str], samples: list[list[np.ndarray]]) -> list[bool]:
        """Whether all samples of each text decode to it, by the bytes of all of them together."""
        plain = [(" " + t if t else "").replace(SPACE, " ").encode() for t in texts]
        ids = np.concatenate([np.zeros(0, dtype=np.int64), *[i for own in samples for i in own]]).astype(np.int64)
        decoded = self.blob[stretches(self.blob_at[ids], self.blob_at[ids + 1] - self.blob_at[ids])]
        if decoded.tobytes() == b"".join(x for x, own in zip(plain, samples) for _ in own):
            cuts = np.cumsum([0, *(len(i) for own in samples for i in own)])
            sizes = np.concatenate(([0], np.cumsum(self.blob_at[ids + 1] - self.blob_at[ids])))[cuts]
            if np.diff(sizes).tolist() == [len(x) for x, own in zip(plain, samples) for _ in own]:
                return [True] * len(texts)
        return [all(self.decode(i.tolist()) == t.replace(SPACE, " ") for i in own) for t, own in zip(texts, samples)]

    def decode(self, ids) -> str:
        """The text of a sequence of ids: bytes of the pieces, without the space put before the first word."""
        return b"".join(map(self.raw.__getitem__, ids)).decode(errors="replace")[1:]


class Batch:
    """The words of several texts, as places in the store of lattices."""

    def __init__(self, pieces: Pieces, words: list[list[str]], seeds: np.ndarray):
        if len(pieces.index) > KEPT:
            pieces.forget()
        self.pieces = pieces
        sizes = np.array([len(x) for x in words], dtype=np.int64)
        self.doc_start = np.concatenate(([0], np.cumsum(sizes)))
        occurrences = np.fromiter(map(pieces.index.__getitem__, itertools.chain.from_iterable(words)), dtype=np.int64, count=int(sizes.sum()))
        pieces.add()
        pieces.uses[: len(pieces.index)] += np.bincount(occurrences, minlength=len(pieces.index))
        self.begin, self.end = pieces.begin[occurrences], pieces.end[occurrences]
        doc_of = np.repeat(np.arange(len(words)), sizes)
        self.stream = mix(seeds[doc_of] + GOLD * (np.arange(len(occurrences), dtype=np.uint64) - self.doc_start[doc_of].astype(np.uint64) + np.uint64(1)))

    def walk(self, occurrences: np.ndarray, nodes: np.ndarray, turn: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Draw edges from ``nodes`` to the end of each occurrence: edges in order, edges of each occurrence, noise."""
        seed = mix(self.stream[occurrences] + GOLD * np.array([turn], dtype=np.uint64))
        first_edge, cum, passed = self.pieces.first_edge, self.pieces.cum, self.pieces.step
        live, at, step = np.flatnonzero(nodes != self.end[occurrences]), nodes, 0
        at = at[live]
        found: list[tuple[np.ndarray, np.ndarray]] = []
        length = np.zeros(len(occurrences), dtype=np.int64)
        while len(live):
            u = uniform(seed[live] + np.uint64(step))
            edge = first_edge[at]
            on = np.flatnonzero(u >= cum[edge])  # the last edge of a node has a share of 1
            while len(on):
                edge[on] += 1
                on = on[u[on] >= cum[edge[on]]]
            found.append((live, edge))
            length[live] += 1
            at = at + passed[edge]
            on = at != self.end[occurrences[live]]
            live, at, step = live[on], at[on], step + 1
        offset = np.cumsum(length) - length
        path = np.empty(int(length.sum()), dtype=np.int64)
        for k, (who, edge) in enumerate(found):
            path[offset[who] + k] = edge
        number = np.repeat(np.arange(len(occurrences)), length)
        noise = mix(seed[number] + np.uint64(1 << 40) + (np.arange(len(path)) - offset[number]).astype(np.uint64))
        return path, length, ((noise >> np.uint64(12)).astype(np.float64) + 0.5) * 2.0**-52


def below(location, bound, u):
    """A Gumbel value at ``location``, known to be below ``bound``."""
    return -np.logaddexp(-bound, np.log(-np.log(u)) - location)


class Found:
    """A path: edges, log-probability before each, the occurrence of each, its value."""

    def __init__(self, edges, before, occurrence, log_prob, value):
        self.edges, self.before, self.occurrence, self.log_prob, self.value = edges, before, occurrence, log_prob, value


def top_places(values: np.ndarray, k: int) -> np.ndarray:
    if len(values) > k:
        values_at = np.argpartition(values, len(values) - k)[len(values) - k :]
    else:
        values_at = np.arange(len(values))
    return values_at[values[values_at] > -np.inf]


def sample(pieces: Pieces, texts: list[str], keys: list[int | None], k: int, seed: int) -> list[list[tuple[np.ndarray, float, float, float]]]:
    """For each text up to ``k`` distinct segmentations: ids, log-probability, value, inclusion probability."""
    raw = np.array([(0x7FFF_FFFF_0000_0001 if x is None else x) & 0xFFFF_FFFF_FFFF_FFFF for x in keys], dtype=np.uint64)
    seeds = mix(mix(raw + GOLD) + np.uint64(seed & 0xFFFF_FFFF_FFFF_FFFF))
    batch = Batch(pieces, [pieces.split(t) for t in texts], seeds)
    n = len(texts)
    root = -np.log(-np.log(uniform(seeds + np.uint64(77))))
    paths: list[list[Found]] = [[] for _ in range(n)]
    frontier: list[list[tuple]] = [[] for _ in range(n)]
    # each turn: for every text, the path to complete: what is fixed of it, and where the walk goes on
    everything = np.arange(len(batch.begin))
    todo = [(d, None, None, root[d]) for d in range(n)]
    for turn in range(k):
        if turn:
            todo = []
            for d in range(n):
                if frontier[d]:
                    best = max(range(len(frontier[d])), key=lambda i: frontier[d][i][0])
                    value, path, place, taken = frontier[d].pop(best)
                    todo.append((d, path, (place, taken), value))
        occ_parts, node_parts, heads, leftovers = [], [], [], []
        for d, path, at, value in todo:
            a, b = batch.doc_start[d], batch.doc_start[d + 1]
            if path is None:
                heads.append(None)
                leftovers.append(None)
                occ_parts.append(everything[a:b])
                node_parts.append(batch.begin[a:b])
                continue
            place, taken = at
            first = pieces.first_edge[: pieces.nodes + 1]
            node = int(np.searchsorted(first, path.edges[place], side="right")) - 1
            options = [e for e in range(int(first[node]), int(first[node + 1])) if e not in taken]
            p = pieces.p[options]
            u = uniform(seeds[d] + GOLD * np.array([turn * 1_000_003 + 5, turn * 1_000_003 + 6], dtype=np.uint64))
            pick = min(int(np.searchsorted(np.cumsum(p), u[0] * p.sum(), side="right")), len(options) - 1)
            edge = options[pick]
            rest = float(sum(x for e, x in zip(options, p.tolist()) if e != edge))
            left = (float(below(path.before[place] + math.log(rest), value, u[1])), place, (*taken, edge)) if rest > 0 else None
            leftovers.append(left)
            heads.append((path, place, edge))
            o = int(path.occurrence[place])
            occ_parts.append(everything[o:b])
            node_parts.append(np.concatenate(([node + int(pieces.step[edge])], batch.begin[o + 1 : b])))
        if not todo:
            break
        occurrences, nodes = np.concatenate(occ_parts), np.concatenate(node_parts)
        edges, length, noise = batch.walk(occurrences, nodes, turn + 1)
        owner = np.repeat(occurrences, length)
        sizes = np.cumsum([0, *map(len, occ_parts)])
        ends = np.concatenate(([0], np.cumsum(length)))[sizes]
        taken_p = pieces.p[edges]
        with np.errstate(divide="ignore"):  # the only edge of a node leaves nothing
            steps, rests = np.log(taken_p), np.log1p(-taken_p)
        # sums of each text for itself, so that they are the same in any batch
        begins = [float(head[0].before[head[1]]) + math.log(pieces.p[head[2]]) if head else 0.0 for head in heads]
        behind = np.empty(len(steps))
        for a, b in zip(ends.tolist(), ends[1:].tolist()):
            np.cumsum(steps[a:b], out=behind[a:b])
        counts = np.diff(ends)
        behind += np.repeat(begins, counts)
        all_before = behind - steps
        # the largest value of what each node of the walk did not take
        all_values = -np.logaddexp(-np.repeat(np.array([float(x[3]) for x in todo]), counts), np.log(-np.log(noise)) - rests - all_before)
        for (d, _, _, value), head, left, begin, a, b in zip(todo, heads, leftovers, begins, ends.tolist(), ends[1:].tolist()):
            own, before, values = edges[a:b], all_before[a:b], all_values[a:b]
            total = float(behind[b - 1]) if b > a else begin
            shift = 0
            if head:
                old, place, edge = head
                shift = place + 1
                path = Found(np.concatenate((old.edges[:place], [edge], own)), np.concatenate((old.before[: place + 1], before)), np.concatenate((old.occurrence[: place + 1], owner[a:b])), total, value)
                if left:
                    frontier[d].append((left[0], path, left[1], left[2]))
            else:
                path = Found(own, before, owner[a:b], total, value)
            paths[d].append(path)
            for i in top_places(values, k - turn):
                frontier[d].append((float(values[i]), path, int(i) + shift, (int(own[i]),)))
    out = []
    for d in range(n):
        kappa = max((x[0] for x in frontier[d]), default=-np.inf)
        out.append([(pieces.id[p.edges].astype("<u4"), p.log_prob, float(p.value), inclusion(p.log_prob, kappa)) for p in paths[d]])
    return out


def inclusion(log_prob: float, kappa: float) -> float:
    """Probability that a segmentation's value exceeds the threshold ``kappa``; 1 when nothing is left out."""
    return 1.0 if kappa == -np.inf else -math.expm1(-math.exp(min(700.0, log_prob - kappa)))


def _sampler(model: str, theta: float, k: int, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = Pieces(model, theta)
        for batch in batches:
            keys, texts = batch.column(0).to_pylist(), [x or "" for x in batch.column(1).to_pylist()]
            at = 0
            while at < len(texts):
                to, held = at, 0
                while to < len(texts) and (to == at or held + len(texts[to]) <= TOGETHER):
                    held += len(texts[to])
                    to += 1
                found = sample(pieces, texts[at:to], keys[at:to], k, seed)
                rows = [[{"ids": i.tobytes(), "log_prob": p, "value": v, "inclusion": q} for i, p, v, q in got] for got in found]
                fits = pieces.round_trips(texts[at:to], [[i for i, *_ in got] for got in found])
                yield pa.RecordBatch.from_arrays([pa.array(keys[at:to], pa.int64()), pa.array(rows, OUT.types[1]), pa.array(fits, pa.bool_())], schema=OUT)
                at = to

    return common.lean(run)


def encode_samples(docs: DataFrame, model: str, *, id_col: str = "doc_id", text_col: str = "text", k: int = 2, theta: float = 1.0, seed: int = 7) -> DataFrame:
    """One row per document row: id, ``samples`` (ids as little-endian u32, log_prob, value, inclusion; by descending
    value) and ``round_trip``: whether every sample decodes to the text.

    The noise depends on ``seed``, the row's id and the place in the text alone, so any partitioning gives the same
    samples, and rows that share id and text get the same. A text with fewer than ``k`` segmentations gives all of
    them. Null and empty texts have one segmentation, of no pieces. U+2581 counts as a space, as the library has it.
    Characters without a piece become their bytes. Empty tables give no rows. Other columns are ignored.
    """
    common.tuned(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("row_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(_sampler(model, theta, k, seed), f"row_id long, samples {SAMPLES}, round_trip boolean").withColumnRenamed("row_id", id_col)


def digests(samples: DataFrame) -> DataFrame:
    """Counts, checksums, log-probabilities and inclusion probabilities in place of the ids of ``encode_samples``, in
    its order of samples; a null id stays null, a text without pieces has one sample of no ids, no rows give none."""
    each = lambda f: F.transform("samples", f)
    return samples.select(
        "doc_id",
        F.size("samples").alias("n_samples"),
        each(lambda s: (F.length(s["ids"]) / 4).cast("long")).alias("n_pieces"),
        each(lambda s: F.crc32(s["ids"])).alias("ids_crc32"),
        each(lambda s: s["log_prob"]).alias("log_prob"),
        each(lambda s: s["inclusion"]).alias("inclusion"),
        "round_trip",
    )


def op7_segmentations(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return digests(encode_samples(common.table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model")))
