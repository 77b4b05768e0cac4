"""SentencePiece encoding with sampled segmentations, and decoding.

The text is cut into units: a run of letters, of digits or of other signs (underscores and carriage returns
too) with the spaces before it, of 200 characters at most for either; what is left of spaces; other white space
by characters. No piece of the model reaches over an end of a unit but where a run is longer. A unit's lattice has an edge for every piece of the vocabulary that
matches, and one by bytes for every character that is no piece, so any text can be encoded and decodes to
itself.
Of each lattice the `best` likeliest paths are listed, and the exact mass of all its other paths is kept beside
them, from forward sums. Where a draw falls on the others, one of them is drawn from the lattice itself, from its
end to its start, with the mass of listed and excluded paths taken off at every step: every path of every unit has
its own probability, and the list only saves work.

The segmentations of a text are the products of its units' paths. k of them are drawn without
replacement by Gumbel top-k: every segmentation has its log-probability plus Gumbel noise as its key,
and A-star search finds the k largest keys without listing the others. A subtree holds the segmentations
that share some choices; its largest key is drawn first, given the bound from its parent, and the
queue opens subtrees in order of that key. An opened subtree gives one segmentation and splits into
one subtree for each unit at which others deviate first.
"""

from __future__ import annotations

import bisect
import functools
import gc
import heapq
import itertools
import math
import re

import numpy as np
import xxhash
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.batches import map_batches

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SAMPLES, BEST, SHARPNESS = 3, 4, 1.0
# One piece, "².", joins a letter (of re's classes) with a sign, so signs after that letter are in its unit.
UNIT = re.compile(r" {0,200}[^\W\d_]{1,200}(?:(?<=²)(?:[^\w\s]|[_\r]){1,200})?| {0,200}\d{1,200}| {0,200}(?:[^\w\s]|[_\r]){1,200}| {1,200}|.", re.S)
SPACE = "▁"
LONGEST = 16  # characters of MODEL's longest piece; a vocabulary takes its own
ZIPF = 100  # pieces are as likely as 1 / (rank + ZIPF): the model's ids are in order of merges, as are its scores but for runs of spaces
BYTE_COST = 14.0
_HASH, _SLOT, _MASK, PROBES = 0x9E3779B97F4A7C15, 0xD1B54A32D192ED03, (1 << 64) - 1, 3
KEPT = 300_000  # units whose paths a worker keeps; beyond, the half met most often stays
LATTICES = 4_000  # units whose whole lattices a worker keeps
TOGETHER = 32_768  # units, or one text's, that are drawn at once


class Vocabulary:
    """Pieces, their log-probabilities, and the ids of single bytes, read from a model file."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        if model.get_piece_size() > 1 << 16:
            raise ValueError("ids are packed in 16 bits")
        self.text: list[str | int] = []
        self.ids: dict[str, int] = {}
        self.byte_ids = [0] * 256
        ranked = []
        for i in range(model.get_piece_size()):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                self.byte_ids[int(piece[1:-1], 16)] = i
                self.text.append(int(piece[1:-1], 16))
            elif model.is_control(i) or model.is_unknown(i) or model.is_unused(i):
                self.text.append("")
            else:
                self.text.append(piece)
                ranked.append((piece, i))
        self.longest = max(len(piece) for piece, _ in ranked)
        whole = math.log(sum(1 / (r + ZIPF) for r in range(1, len(ranked) + 1)))
        self.logp = {}
        for r, (piece, i) in enumerate(ranked, 1):
            self.ids[piece] = i
            self.logp[piece] = -math.log(r + ZIPF) - whole
        self.bytes = [bytes([p]) if isinstance(p, int) else p.replace(SPACE, " ").encode("utf-8") for p in self.text]
        # The same in rows of one width, filled up with a byte that UTF-8 doesn't have.
        width = max(map(len, self.bytes))
        self.rows = np.frombuffer(b"".join(b.ljust(width, b"\xff") for b in self.bytes), f"V{width}")
        # Every prefix of a piece by its hash, with the piece's id or -1, for the lattices of many units at once.
        prefixes: dict[int, int] = {}
        self.weights: dict[str, float | None] = {}  # of every prefix, None where it is no piece
        for piece, i in self.ids.items():
            h = 0
            self.weights.update((piece[:j], self.logp.get(piece[:j])) for j in range(1, len(piece) + 1))
            for j, c in enumerate(piece):
                h = (h * _HASH + ord(c) + 1) & _MASK
                if j + 1 < len(piece):
                    prefixes.setdefault(h, -1)
            if prefixes.get(h, -1) >= 0:
                raise ValueError("two pieces share a hash")
            prefixes[h] = i
        self._fill(prefixes)
        self.id_logp = np.full(len(self.text), -np.inf, np.float32)
        self.exact_logp = np.full(len(self.text), -BYTE_COST)
        for piece, i in self.ids.items():
            self.id_logp[i] = self.exact_logp[i] = self.logp[piece]
        self.byte_table = np.array(self.byte_ids, np.int32)

    def _fill(self, prefixes: dict[int, int]) -> None:
        """An open table of the prefixes' hashes in which each lies within PROBES slots of its own."""
        bits = 19
        while True:
            size = 1 << bits
            keys, ids, fits = np.zeros(size + PROBES, np.uint64), np.full(size + PROBES, -1, np.int32), True
            taken = bytearray(size + PROBES)
            for h, i in sorted(prefixes.items()):
                slot = ((h * _SLOT) & _MASK) >> (64 - bits)
                at = next((slot + k for k in range(PROBES) if not taken[slot + k]), None)
                if at is None:
                    fits = False
                    break
                taken[at], keys[at], ids[at] = 1, h, i
            if fits:
                self.shift, self.keys, self.slot_id = np.uint64(64 - bits), keys, ids
                return
            bits += 1

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which hashes are prefixes of pieces, and for these the piece's id or -1. No prefix has hash 0."""
        slot = ((h * np.uint64(_SLOT)) >> self.shift).astype(np.int64)
        hit = self.keys.take(slot) == h
        for k in range(1, PROBES):
            other = self.keys.take(slot + k) == h
            slot += k * other
            hit |= other
        on = np.flatnonzero(hit)
        return on, self.slot_id.take(slot.take(on))

    def decode(self, ids) -> str:
        """The text of a sequence of ids; byte pieces are put together, control pieces are nothing."""
        ids = np.asarray(ids, np.int64)
        if (ids == self.byte_ids[255]).any():  # in no text's encoding
            return b"".join(map(self.bytes.__getitem__, ids.tolist())).decode("utf-8", "surrogatepass")
        return b"".join(self.rows.take(ids[a : a + TOGETHER]).tobytes().translate(None, b"\xff") for a in range(0, len(ids), TOGETHER)).decode("utf-8", "surrogatepass")

    def paths(self, units: list[str], best: int = BEST) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The likeliest paths of lattices of one length: log-probabilities and sizes (units by paths), and all ids in turn."""
        return self.paths_and_mass(units, best)[:3]

    def paths_and_mass(self, units: list[str], best: int = BEST, sharpness: float = 1.0) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Those of `paths`, and of each whole lattice the log of the sum over all paths (weights to the power sharpness) and their number.

        Missing paths have log-probability -inf and no ids. All lattices go forward together: at each place
        the candidates of every edge that ends there are ranked and the best kept.
        """
        n, m = len(units[0]), len(units)
        own = np.frombuffer("".join(units).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(m, n)
        code = np.ascontiguousarray(np.where(own == 32, ord(SPACE), np.where(own == ord(SPACE), 0, own)).T.astype(np.uint64) + np.uint64(1))
        # By place and length of the edge that ends there, then by unit: what one step reads or writes lies together.
        cand = np.full((n + 1, min(n, self.longest), m, best), np.inf, np.float32)  # costs, so the least are best
        edge = np.full((n + 1, min(n, self.longest), m), -1, np.int32)
        cost = np.full((n + 1, m, best), np.inf, np.float32)
        back = np.zeros((n + 1, m, best), np.int16)
        cost[0, :, 0] = 0
        # Short units are summed as they are, as no path can underflow; others as logs.
        plain = 4 * BYTE_COST * n * sharpness < 690
        weight = np.exp(sharpness * self.exact_logp) if plain else sharpness * self.exact_logp
        mass, ways = np.full((n + 1, m), 0.0 if plain else -np.inf), np.zeros((n + 1, m))
        mass[0], ways[0] = float(plain), 1
        deepest = [1] * (n + 1)  # the longest edge of any unit that ends at a place
        rows = np.arange(m)
        for i in range(n):
            if i:
                cost[i], back[i] = _best(cand[i, : deepest[i]])
            live, h = rows, None
            for size in range(1, min(self.longest, n - i) + 1):
                h = code[i].copy() if h is None else h * np.uint64(_HASH) + code[i + size - 1].take(live)
                on, piece = self.find(h)
                if not len(on):
                    break
                live, h = live.take(on), h.take(on)
                whole = np.flatnonzero(piece >= 0)
                if len(whole):
                    r, piece = live.take(whole), piece.take(whole)
                    deepest[i + size] = max(deepest[i + size], size)
                    edge[i + size, size - 1][r] = piece
                    cand[i + size, size - 1][r] = cost[i].take(r, 0) - self.id_logp.take(piece)[:, None]
                    if plain:
                        mass[i + size][r] += mass[i].take(r) * weight.take(piece)
                    else:
                        mass[i + size][r] = np.logaddexp(mass[i + size].take(r), mass[i].take(r) + weight.take(piece))
                    ways[i + size][r] += ways[i].take(r)
            bare = np.flatnonzero(edge[i + 1, 0] < 0)
            if len(bare):
                by_bytes = BYTE_COST * _utf8(own[bare, i])[1]
                cand[i + 1, 0][bare] = cost[i].take(bare, 0) + by_bytes[:, None].astype(np.float32)
                if plain:
                    mass[i + 1][bare] += mass[i].take(bare) * np.exp(-sharpness * by_bytes)
                else:
                    mass[i + 1][bare] = np.logaddexp(mass[i + 1].take(bare), mass[i].take(bare) - sharpness * by_bytes)
                ways[i + 1][bare] += ways[i].take(bare)
        cost[n], back[n] = _best(cand[n, : deepest[n]])

        # Back from the end: each step gives one piece, or the bytes of one character.
        lane = np.repeat(rows, best)
        place, rank = np.full(m * best, n), np.tile(np.arange(best), m)
        logs = -cost[n].reshape(-1)
        place[np.isneginf(logs)] = 0
        steps = []
        while True:
            on = np.flatnonzero(place > 0)
            if not len(on):
                break
            step = np.full((m * best, 4), -1, np.int32)
            slot = back[place[on], lane[on], rank[on]]
            kind = slot // best
            piece = edge[place[on], kind, lane[on]]
            as_bytes = piece < 0
            step[on, 0] = piece
            b = on[as_bytes]
            if len(b):
                raw = _utf8(own[lane[b], place[b] - 1])[0]
                step[b] = np.where(raw >= 0, self.byte_table[raw], -1)
            steps.append(step)
            rank[on], place[on] = slot % best, place[on] - (kind + 1)
        ids = np.stack(steps[::-1], 1).reshape(m * best, -1)
        given = ids >= 0
        return logs.reshape(m, best), given.sum(1).reshape(m, best), ids[given], np.log(mass[n]) if plain else mass[n], ways[n]


def _best(cand: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The least costs of each unit in order, and the edges and ranks they come from; ties go to the shorter edge.

    cand: edge lengths by units by ranks, none negative. Bits of such floats are ordered like the floats, so cost
    and origin are sorted as one integer.
    """
    lengths, m, best = cand.shape
    packed = (cand.transpose(1, 0, 2).reshape(m, -1).view(np.uint32).astype(np.int64) << 15) | np.arange(lengths * best)
    if lengths > 1:
        packed = np.partition(packed, best - 1, axis=1)[:, :best]
    packed.sort(axis=1)
    return (packed >> 15).astype(np.uint32).view(np.float32), (packed & 32767).astype(np.int16)


def _utf8(code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of each code point (four columns, -1 beyond its width) and the widths."""
    c = code.astype(np.int32)
    width = 1 + (c >= 0x80) + (c >= 0x800) + (c >= 0x10000)
    out = np.full((*c.shape, 4), -1, np.int32)
    lead = np.array([0, 0, 0xC0, 0xE0, 0xF0])
    for k in range(4):
        shift = np.maximum(6 * (width - 1 - k), 0)
        byte = (c >> shift) & 0x3F | 0x80
        first = np.where(width == 1, c, lead[width] | (c >> (6 * (width - 1))))
        out[..., k] = np.where(k < width, first if k == 0 else byte, -1)
    return out, width


class _Lattice:
    """All paths of one unit but the listed ones. A path is the tuple of its places from the unit's end to 0."""

    def __init__(self, v: Vocabulary, unit: str, sharpness: float, listed: list[list[int]]):
        self.v, self.unit, n = v, unit, len(unit)
        s = unit.replace(SPACE, "\0").replace(" ", SPACE)
        self.into: list[list[tuple[int, float]]] = [[] for _ in range(n + 1)]
        self.mass, self.ways = [-math.inf] * (n + 1), [0] * (n + 1)
        self.mass[0], self.ways[0] = 0.0, 1
        step = v.weights.get
        for i in range(n):
            if i:
                self._sum(i)
            for j in range(i + 1, min(n, i + v.longest) + 1):
                w = step(s[i:j], 1.0)
                if w == 1.0 and j > i + 1:
                    break
                if w is None or w == 1.0:
                    if j > i + 1:
                        continue
                    w = -BYTE_COST * len(unit[i].encode("utf-8", "surrogatepass"))
                self.into[j].append((i, w * sharpness))
        self._sum(n)
        self.s, self.steps = s, {}
        self.listed = {p: self.logp(p) for p in map(self.places, listed)}

    def _sum(self, j: int) -> None:
        """The mass and number of the paths to a place, from those of the places before it."""
        logs = [self.mass[i] + w for i, w in self.into[j]]
        most = max(logs)
        self.mass[j] = most + math.log(sum([math.exp(x - most) for x in logs]))
        self.ways[j] = sum([self.ways[i] for i, _ in self.into[j]])

    def places(self, ids: list[int]) -> tuple[int, ...]:
        at, k, out = 0, 0, [0]
        while k < len(ids):
            piece = self.v.text[ids[k]]
            k += 1 if isinstance(piece, str) else len(self.unit[at].encode("utf-8", "surrogatepass"))
            at += len(piece) if isinstance(piece, str) else 1
            out.append(at)
        return tuple(out[::-1])

    def ids(self, path: tuple[int, ...]) -> list[int]:
        out = []
        for j, i in zip(path[-2::-1], path[:0:-1], strict=True):
            piece = self.v.ids.get(self.s[i:j]) if self.unit[i] != SPACE else None
            out += [piece] if piece is not None else [self.v.byte_ids[b] for b in self.unit[i].encode("utf-8", "surrogatepass")]
        return out

    def logp(self, path: tuple[int, ...]) -> float:
        return sum([dict(self.into[b])[a] for b, a in itertools.pairwise(path)]) - self.mass[-1]

    def _step(self, suffix: tuple[int, ...], weight: float, out: dict) -> tuple[list[float], list[tuple[int, float]]]:
        """The running masses of the edges into a suffix's first place, without the paths in out, and the edges."""
        at, near, run, edges, whole = len(suffix), [p for p in out if p[: len(suffix)] == suffix], [], [], 0.0
        for i, w in self.into[suffix[-1]]:
            gone = [p for p in near if p[at] == i]
            if self.ways[i] > len(gone):
                whole += max(math.exp(self.mass[i] + w + weight - self.mass[-1]) - sum(math.exp(out[p]) for p in gone), 1e-300)
                run.append(whole)
                edges.append((i, w))
        return run, edges

    def draw(self, more: tuple, rng: np.random.Generator) -> tuple[tuple[int, ...], float]:
        """A path that is neither listed nor in more, and its log-probability among all paths."""
        out = self.listed | {p: self.logp(p) for p in more} if more else self.listed
        path, weight, free = (len(self.unit),), 0.0, False
        while path[-1]:
            # A suffix that no excluded path has goes on by its place alone; masses are in proportion.
            free = free or not any(p[: len(path)] == path for p in out)
            key = path[-1] if free else path
            step = None if more and not free else self.steps.get(key)
            if step is None:
                step = self._step(path[-1:], self.mass[-1] - self.mass[path[-1]], {}) if free else self._step(path, weight, out)
                if free or not more:
                    self.steps[key] = step
            run, edges = step
            i, w = edges[min(bisect.bisect_right(run, rng.random() * run[-1]), len(run) - 1)] if len(run) > 1 else edges[0]
            path, weight = (*path, i), weight + w
        return path, weight - self.mass[-1]


class _Others:
    """The paths beyond the listed ones that one text's draws fall on; each has a number from `best` on."""

    def __init__(self, units: _Units, numbers: np.ndarray, rng: np.random.Generator):
        self.units, self.numbers, self.rng = units, numbers, rng
        self.number_of: dict[tuple, int] = {}
        self.known: list[tuple[int, tuple, float]] = []

    def mass(self, at: int, whole: float, gone: list[int]) -> float:
        """What is left of the others' mass of a unit without those numbered."""
        if not gone:
            return whole
        if self.units.lattice(int(self.numbers[at])).ways[-1] <= self.units.best + len(gone):
            return 0.0
        return max(whole - sum(math.exp(self.known[x - self.units.best][2]) for x in gone), 1e-300)

    def draw(self, at: int, gone: list[int]) -> tuple[int, float]:
        unit = int(self.numbers[at])
        path, logp = self.units.lattice(unit).draw(tuple(self.known[x - self.units.best][1] for x in gone), self.rng)
        x = self.number_of.get((unit, path))
        if x is None:
            self.number_of[unit, path] = x = self.units.best + len(self.known)
            self.known.append((unit, path, logp))
        return x, self.known[x - self.units.best][2]


class _Grown:
    """A flat array that grows by doubling; what is added isn't copied with every batch."""

    def __init__(self, kind):
        self.array, self.n = np.empty(1 << 16, kind), 0

    def extend(self, more: np.ndarray) -> None:
        need = self.n + len(more)
        if need > len(self.array):
            grown = np.empty(max(need, 2 * len(self.array)), self.array.dtype)
            grown[: self.n] = self.array[: self.n]
            self.array = grown
        self.array[self.n : need] = more
        self.n = need


class _Units(dict):
    """Unit to number; the paths of all numbered units lie in flat arrays."""

    def __init__(self, vocabulary: Vocabulary, best: int, sharpness: float):
        super().__init__()
        self.vocabulary, self.best, self.sharpness = vocabulary, best, sharpness
        self.reset()

    def reset(self) -> None:
        self.clear()
        self.new: list[str] = []
        self.texts: list[str] = []
        self.lattices: dict[int, _Lattice] = {}
        self.used = np.zeros(0, np.int64)
        self.logs, self.starts, self.sizes, self.pool = _Grown(np.float64), _Grown(np.int64), _Grown(np.int32), _Grown(np.uint16)

    def __missing__(self, unit: str) -> int:
        self[unit] = number = len(self)
        self.new.append(unit)
        self.texts.append(unit)
        return number

    def count(self, numbers: np.ndarray) -> None:
        """Take down that these units were met."""
        if len(self.used) < len(self):
            self.used = np.concatenate([self.used, np.zeros(len(self) - len(self.used), np.int64)])
        np.add.at(self.used, numbers, 1)

    def trim(self) -> None:
        """Keep the units met most often and more than once, half of KEPT at most, under new numbers; older meetings count half."""
        often = np.argsort(-self.used, kind="stable")[: KEPT // 2]
        keep = np.sort(often[self.used[often] > 1])
        entries = (keep[:, None] * self.best + np.arange(self.best)).reshape(-1)
        logs, size, (ids, ends) = self.logs.array[: self.logs.n].reshape(-1, self.best + 1)[keep], self.sizes.array[entries], self.ids(entries)
        texts, used, lattices = [self.texts[k] for k in keep.tolist()], self.used[keep] // 2, self.lattices
        self.reset()
        self.update(zip(texts, range(len(texts)), strict=True))
        self.texts, self.used = texts, used
        number = dict(zip(keep.tolist(), range(len(texts)), strict=True))
        self.lattices = {number[k]: lattice for k, lattice in lattices.items() if k in number}
        self.logs.extend(logs.reshape(-1))
        self.sizes.extend(size)
        self.starts.extend(ends - size)
        self.pool.extend(ids)

    def lattice(self, number: int) -> _Lattice:
        found = self.lattices.get(number)
        if found is None:
            if len(self.lattices) >= LATTICES:
                self.lattices.clear()
            first = number * self.best
            listed = [self.pool.array[a : a + k].tolist() for a, k in zip(self.starts.array[first : first + self.best], self.sizes.array[first : first + self.best], strict=True) if k]
            found = self.lattices[number] = _Lattice(self.vocabulary, self.texts[number], self.sharpness, listed)
        return found

    def settle(self) -> None:
        """Find the paths of the units met since the last call, in groups of one length."""
        count = len(self.new)
        if not count:
            return
        groups: dict[int, list[int]] = {}
        for k, u in enumerate(self.new):
            groups.setdefault(len(u), []).append(k)
        logs = np.full((count, self.best + 1), -np.inf)
        sizes, starts = (np.zeros((count, self.best), t) for t in (np.int32, np.int64))
        for n, members in groups.items():
            step = max(1, 60_000 // n)
            for at in range(0, len(members), step):
                part = np.array(members[at : at + step])
                lp, size, ids, mass, ways = self.vocabulary.paths_and_mass([self.new[k] for k in members[at : at + step]], self.best, self.sharpness)
                ends = size.reshape(-1).cumsum()
                # Each path is summed by itself, so that its value doesn't depend on the units it is found with.
                exact = np.bincount(np.repeat(np.arange(size.size), size.reshape(-1)), self.vocabulary.exact_logp.take(ids), size.size)
                exact = np.where(size > 0, exact.reshape(size.shape), -np.inf)
                scaled = self.sharpness * (exact - exact[:, :1])
                among = np.log(np.exp(scaled).sum(1))
                more = ways > self.best
                among[more] = mass[more] - self.sharpness * exact[more, 0]
                own = scaled - among[:, None]
                logs[part, : self.best] = own
                logs[part[more], self.best] = np.log(np.maximum(1 - np.exp(own[more]).sum(1), 1e-300))
                sizes[part] = size
                starts[part] = (self.pool.n + ends - size.reshape(-1)).reshape(size.shape)
                self.pool.extend(ids.astype(np.uint16))
        self.logs.extend(logs.reshape(-1))
        self.sizes.extend(sizes.reshape(-1))
        self.starts.extend(starts.reshape(-1))
        self.new = []

    def ids(self, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of a sequence of paths (unit times best, plus path), one after another, and where each path's end."""
        size = self.sizes.array[entries]
        ends = size.cumsum(dtype=np.int64)
        return self.pool.array[np.repeat(self.starts.array[entries] - ends + size, size) + np.arange(ends[-1] if len(ends) else 0)], ends


def _below(location, bound: float, uniform):
    """A Gumbel variable of that location, given that it is below the bound."""
    return location - np.log(np.exp(np.minimum(location - bound, 700.0)) - np.log(uniform))


def draw(logs: np.ndarray, k: int, rng: np.random.Generator) -> list[tuple[np.ndarray, float, float]]:
    """k distinct choices for one text, whose units are the rows of logs."""
    return draw_all(logs, [np.arange(len(logs))], k, [rng])[0]


@np.errstate(divide="ignore", over="ignore")
def draw_all(logs: np.ndarray, numbers: list[np.ndarray], k: int, rngs: list[np.random.Generator], others: list[_Others] | None = None) -> list[list[tuple[np.ndarray, float, float]]]:
    """For each text k distinct choices (one path for each unit) without replacement: (choice, log-probability, inclusion).

    numbers: each text's units, as rows of logs. logs: units by paths, each row normalised, -inf where there is no path. With others
    (one for each text), the last column is the mass of a unit's other paths, of which others draws and numbers one wherever a choice
    falls there. The inclusion score of a choice is its probability of being among the k, given the (k + 1)-th key: 1 - exp(-exp(logp - key)). Fewer
    than k are returned if there are fewer, and all have inclusion 1. All texts open a subtree at a time together; each has its
    own generator and sums, so what it gets doesn't depend on the others.
    """
    m = logs.shape[1]
    flat = np.ascontiguousarray(logs).reshape(-1)
    last = m if others is None else m - 1
    # A subtree: -key, order, the choices of its parent, their log-probability before the first free unit, that unit, the paths excluded there.
    queues: list[list] = [[(-float(rng.gumbel()), 0, None, 0.0, 0, frozenset())] if len(number) else [] for number, rng in zip(numbers, rngs, strict=True)]
    found: list[list] = [[] if len(number) else [(np.empty(0, np.int64), 0.0)] for number in numbers]
    order = 1
    for need in range(k, 0, -1):
        active = [t for t, queue in enumerate(queues) if queue]
        if not active:
            break
        opened = [heapq.heappop(queues[t]) for t in active]
        # What lies before the first free unit is the parent's, so only the rest is drawn.
        unit = np.concatenate([numbers[t][o[4] :] for t, o in zip(active, opened, strict=True)])
        sizes = [len(numbers[t]) - o[4] for t, o in zip(active, opened, strict=True)]
        ends = list(itertools.accumulate(sizes))
        starts = [0, *ends[:-1]]
        u = np.empty((2, len(unit)))
        for t, a, b in zip(active, starts, ends, strict=True):
            rngs[t].random(out=u[0, a:b])
            rngs[t].random(out=u[1, a:b])
        slot = unit * m
        tail = np.zeros(len(unit), np.int64)
        if m > 1:
            on = np.flatnonzero(u[0] >= np.exp(flat.take(slot)))
            run, own = np.exp(flat.take(slot.take(on))), u[0].take(on)
            past = np.ones(len(on), np.int64)
            for x in range(1, m - 1):
                run += np.exp(flat.take(slot.take(on) + x))
                past += own >= run
            tail[on] = past
        lefts: list[list[float]] = [[]] * len(active)
        for at, (t, o, a) in enumerate(zip(active, opened, starts, strict=True)):
            if o[2] is not None:
                lefts[at] = left = np.exp(logs[unit[a]]).tolist()
                for x in o[5]:
                    if x < last:
                        left[x] = 0.0
                beyond = [x for x in o[5] if x >= last]
                if beyond:
                    left[last] = others[t].mass(o[4], left[last], beyond)
                sums = list(itertools.accumulate(left))
                tail[a] = bisect.bisect_right(sums, u[0, a] * sums[-1])
        own = flat.take(slot + np.minimum(tail, m - 1))
        bad = np.flatnonzero(np.isneginf(own) | (tail >= m))
        if len(bad):  # rounding led past a unit's last path
            tail[bad] = np.minimum(tail[bad], (~np.isneginf(logs[unit[bad]])).sum(1) - 1)
            own[bad] = flat.take(slot[bad] + tail[bad])
        if others is not None:
            for x in np.flatnonzero(tail == last).tolist():
                at = bisect.bisect_right(ends, x)
                o, first = opened[at], x == starts[at]
                tail[x], own[x] = others[active[at]].draw(o[4] + x - starts[at], [y for y in o[5] if y >= last] if first else [])
        before = np.empty(len(unit))
        rest = np.maximum(-np.expm1(own), 0)  # 0 where a unit has one path
        choices = []
        for t, o, a, b, left in zip(active, opened, starts, ends, lefts, strict=True):
            sums = np.empty(b - a + 1)
            sums[0], sums[1:] = o[3], own[a:b]
            sums = sums.cumsum()
            before[a:b] = sums[:-1]
            choice = tail[a:b]
            if o[2] is not None:
                x = int(tail[a])
                if x < last:
                    left[x] = 0.0
                else:
                    left[last] = others[t].mass(o[4], math.exp(logs[unit[a], last]), [*(y for y in o[5] if y >= last), x])
                *_, rest[a] = itertools.accumulate(left)
                choice = np.concatenate([o[2][: o[4]], choice])
            choices.append(choice)
            found[t].append((choice, float(sums[-1])))
        branch = _below(before + np.log(rest), np.repeat([-o[0] for o in opened], sizes), np.maximum(u[1], 1e-300))
        for t, o, a, b, choice in zip(active, opened, starts, ends, choices, strict=True):
            own = branch[a:b]
            best = np.argpartition(-own, need - 1)[:need] if len(own) > need else np.arange(len(own))
            for x in best[np.argsort(-own[best], kind="stable")].tolist():
                key = float(own[x])
                if rest[a + x] > 0 and key > -math.inf:
                    at = o[4] + x
                    gone = (o[5] if x == 0 else frozenset()) | {int(choice[at])}
                    heapq.heappush(queues[t], (-key, order, choice, float(before[a + x]), at, gone))
                    order += 1
    # The largest key that is left is the (k + 1)-th.
    tops = [queue[0][0] if queue else math.inf for queue in queues]
    return [[(c, lp, -math.expm1(-math.exp(min(lp + top, 700.0)))) for c, lp in rows] for rows, top in zip(found, tops, strict=True)]


class Encoder:
    """Best and sampled segmentations of texts; keeps the paths of units between batches."""

    def __init__(self, path: str, samples: int = SAMPLES, best: int = BEST, sharpness: float = SHARPNESS):
        self.vocabulary = Vocabulary(path)
        self.units = _Units(self.vocabulary, best, sharpness)
        self.samples, self.best = samples, best

    def encode(self, texts: list[str], keys: list) -> list[dict]:
        units = self.units
        if len(units) > KEPT:
            units.trim()
        numbers = [np.fromiter(map(units.__getitem__, UNIT.findall(t)), np.int64) for t in texts]
        units.settle()
        out, at = [], 0
        while at < len(numbers):
            to, size = at + 1, len(numbers[at])
            while to < len(numbers) and size + len(numbers[to]) <= TOGETHER:
                size += len(numbers[to])
                to += 1
            out += self._encode(numbers[at:to], keys[at:to])
            at = to
        return out

    def _encode(self, numbers: list[np.ndarray], keys: list) -> list[dict]:
        """Rows of texts whose units are numbered and settled."""
        units = self.units
        logs = units.logs.array[: units.logs.n].reshape(-1, self.best + 1)
        held = units.pool.n, units.starts.n, units.sizes.n
        for number in numbers:
            units.count(number)
        rngs = [np.random.Generator(np.random.Philox(key=xxhash.xxh64_intdigest(str(key).encode()))) for key in keys]
        others = [_Others(units, number, rng) for number, rng in zip(numbers, rngs, strict=True)]
        out, paths = [], []
        for number, drawn, other in zip(numbers, draw_all(logs, numbers, self.samples, rngs, others), others, strict=True):
            first, beyond = number * self.best, units.starts.n - self.best
            if other.known:
                more = [units.lattice(n).ids(path) for n, path, _ in other.known]
                size = np.array([len(x) for x in more])
                units.starts.extend(units.pool.n + size.cumsum() - size)
                units.sizes.extend(size)
                units.pool.extend(np.concatenate(more))
            paths += [first, *(np.where(c < self.best, first + c, beyond + c) if other.known else first + c for c, _, _ in drawn)]
            out.append({"units": len(number), "best_logp": float(logs[number, 0].sum()), "samples": drawn})
        ids, ends = units.ids(np.concatenate(paths) if paths else np.empty(0, np.int64))
        last = np.concatenate([[0], ends]).take(np.cumsum([0] + [len(p) for p in paths])).tolist()
        parts = iter([ids[a:b] for a, b in itertools.pairwise(last)])
        for row in out:
            row["best"] = next(parts)
            row["samples"] = [(next(parts), lp, q) for _, lp, q in row["samples"]]
        units.pool.n, units.starts.n, units.sizes.n = held  # the paths beyond the listed ones are these texts' alone
        return out


@functools.lru_cache(maxsize=1)
def worker_encoder(path: str, samples: int, best: int, sharpness: float) -> Encoder:
    """The encoder that a Python worker keeps for all its tasks."""
    encoder = Encoder(path, samples, best, sharpness)
    gc.freeze()  # the vocabulary stays, so later collections needn't look through it
    return encoder


DDL = "id bigint, n_units bigint, n_tokens bigint, logp double, ids binary, round_trip boolean, samples array<struct<ids:binary,n_tokens:int,logp:double,inclusion:double>>"


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: str = MODEL, samples: int = SAMPLES, best: int = BEST, sharpness: float = SHARPNESS) -> DataFrame:
    """One row for each row of docs: id, n_units, n_tokens, logp, ids, round_trip, samples.

    ids are unsigned 16-bit numbers, low byte first: the likeliest segmentation, whose decoding is compared
    with the text in round_trip. samples are distinct and come in order of their keys; noise depends on
    the row's id alone, so rows that share an id and a text get the same ones. Null counts as empty: no
    tokens, and one empty sample. Texts with fewer segmentations than asked for give all of them. An
    empty table gives an empty result; other columns are ignored. Very long texts are encoded whole: memory
    grows with a text's units, time in proportion. Models of over 65,536 pieces are refused.
    """
    spark = docs.sparkSession
    name = model.rsplit("/", 1)[-1]
    spark.sparkContext.addFile(model)  # executors get the vocabulary file from the driver

    def start():
        encoder = worker_encoder(SparkFiles.get(name), samples, best, sharpness)

        def work(batch):
            texts = [t or "" for t in batch["text"]]
            gc.disable()  # nothing here makes cycles, and a collection looks through all lattices kept
            try:
                rows = encoder.encode(texts, batch["id"])
            finally:
                gc.enable()
            pack = lambda a: a.astype("<u2").tobytes()
            return {
                "id": batch["id"], "n_units": [r["units"] for r in rows], "n_tokens": [len(r["best"]) for r in rows], "logp": [r["best_logp"] for r in rows], "ids": [pack(r["best"]) for r in rows],
                "round_trip": [encoder.vocabulary.decode(r["best"]) == t for r, t in zip(rows, texts, strict=True)],
                "samples": [[{"ids": pack(a), "n_tokens": len(a), "logp": lp, "inclusion": q} for a, lp, q in r["samples"]] for r in rows],
            }

        return work

    return map_batches(docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text")), start, DDL, rows=1024)


def decode(encoded: DataFrame, ids_col: str = "ids", model: str = MODEL) -> DataFrame:
    """id and text of encoded rows (id and a column of packed ids); null ids give null."""
    name = model.rsplit("/", 1)[-1]
    encoded.sparkSession.sparkContext.addFile(model)

    def start():
        vocabulary = Vocabulary(SparkFiles.get(name))
        return lambda batch: {"id": batch["id"], "text": [None if b is None else vocabulary.decode(np.frombuffer(b, "<u2")) for b in batch["ids"]]}

    return map_batches(encoded.select("id", F.col(ids_col).alias("ids")), start, "id bigint, text string")
