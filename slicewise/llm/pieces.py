"""SentencePiece BPE encoding and decoding in vectorised merge rounds.

A text is cut into segments that no piece crosses: a run of blanks with the word after
it.  New segments of a batch stand one after another in a flat numpy array of symbols;
each round finds the lowest pair rank of every segment, merges all its leftmost
non-overlapping occurrences at once, and compacts the arrays, until no pair remains.
Results are kept in a bounded table, for most words recur: segments are found, hashed
(128 bits) and looked up on the UTF-8 bytes of a whole batch at a time, and only new
ones become strings.

Exactness.  One merge after another, best score first and leftmost among equals, is
what the library does.  Merging all occurrences of the best pair at once gives the
same where a merge makes no pair of an equal or better rank; pieces for which it can
are merged one occurrence a round.  Runs of blanks, whose pieces all score alike and
last, are put together by the sequential rule once per run length.  Long segments
without a blank run the same rounds with a bucket of pairs per rank, so that a round
costs what it merges, not the segment's length.  Characters without a piece become byte
pieces.

Defined results: null is the empty text, which has no ids; rows are independent, so
repeated rows are equal; an empty table gives an empty result.
"""

from __future__ import annotations

import heapq
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import byte_codes, col, pieces_of, shipped, span_hashes, spread, text_buffer

BLANK = "▁"
NO_RANK = np.int32(2**31 - 1)
LONG_SEGMENT = 3000
KEPT_SEGMENTS = 800_000
TABLE_BITS = 21
CHUNK = 512 << 10


_CODES = (byte_codes(lower=False), spread(0xC0DE, 256))


class PieceModel:
    """The tables of one model file; made once in each Python worker."""

    _loaded: dict[str, PieceModel] = {}

    @classmethod
    def load(cls, path: str) -> PieceModel:
        if path not in cls._loaded:
            cls._loaded[path] = cls(path)
        return cls._loaded[path]

    def __init__(self, path: str):
        import sentencepiece

        lib = sentencepiece.SentencePieceProcessor(model_file=path)
        n = lib.get_piece_size()
        pieces = [lib.id_to_piece(i) for i in range(n)]
        special = [lib.is_control(i) or lib.is_unknown(i) or lib.is_byte(i) or lib.is_unused(i) for i in range(n)]
        self.lib = lib
        probe = "".join(lib.encode("  a  B é ", out_type=str))
        self.prefix = BLANK if probe.startswith(BLANK * 3) else ""
        if probe != self.prefix + "  a  B é ".replace(" ", BLANK):
            raise ValueError("only models that leave the text as it is, but for a blank before it, are supported")
        self.ids = {p: i for i, p in enumerate(pieces) if not special[i]}
        score = {p: lib.get_score(i) for p, i in self.ids.items()}
        self.byte_ids = np.zeros(256, np.int32)
        for i in range(n):
            if lib.is_byte(i):
                self.byte_ids[int(pieces[i][3:5], 16)] = i

        # Symbols: pieces by their id, and the characters of pieces that are none, from n on.
        self.symbols = dict(self.ids)
        for p in self.ids:
            for c in p:
                self.symbols.setdefault(c, n + len(self.symbols) - len(self.ids))
        self.lone = {s: c for c, s in self.symbols.items() if s >= n}
        self.n_pieces, self.n_symbols = n, n + len(self.lone)
        self.of_point = np.full(0x110000, -1, np.int32)
        for c, s in self.symbols.items():
            if len(c) == 1:
                self.of_point[ord(c)] = s

        levels = sorted({s for p, s in score.items() if len(p) > 1}, reverse=True)
        rank_of = {s: i for i, s in enumerate(levels)}
        blanks = [p for p in self.ids if len(p) > 1 and set(p) == {BLANK}]
        inner = [p for p in self.ids if BLANK in p[1:] and set(p) != {BLANK}]
        others = [rank_of[score[p]] for p in self.ids if len(p) > 1 and set(p) != {BLANK}]
        self.cut = not inner  # no piece goes from a word to the blank after it
        self.blanks_last = self.cut and all(rank_of[score[p]] > max(others, default=-1) for p in blanks)
        self.blank_scores = {len(p): score[p] for p in blanks}
        self._blank_runs: dict[int, list[int]] = {}
        self.newline = newline = self.cut and not any("\n" in p and len(p) > 1 for p in self.ids)
        self.segment = re.compile("(?s).+" if not self.cut else f"{BLANK}*[^{BLANK}\n]+|{BLANK}+|\n" if newline else f"{BLANK}*[^{BLANK}]+|{BLANK}+")

        joins = np.ones((256, 256), bool)  # whether some piece may hold these two bytes in a row; those of longer characters may
        joins[:128, :128] = False
        for p in self.ids:
            for x, y in zip(p.replace(BLANK, " "), p.replace(BLANK, " ")[1:], strict=False):
                if ord(x) < 128 and ord(y) < 128:
                    joins[ord(x), ord(y)] = True
        if self.cut:
            joins[128:, 32] = False
        if newline:
            joins[10, :] = joins[:, 10] = False
        self.joins = joins.reshape(-1)

        keys, ranks, made = [], [], []
        for p, i in self.ids.items():
            if len(p) < 2 or (self.blanks_last and set(p) == {BLANK}):
                continue
            for k in range(1, len(p)):
                a, b = self.symbols.get(p[:k]), self.symbols.get(p[k:])
                if a is not None and b is not None:
                    keys.append(a * self.n_symbols + b)
                    ranks.append(rank_of[score[p]])
                    made.append(i)
        order = np.argsort(np.array(keys, np.int64))
        self.keys = np.append(np.array(keys, np.int64)[order], np.int64(2**62))
        self.ranks = np.append(np.array(ranks, np.int32)[order], NO_RANK)
        self.made = np.append(np.array(made, np.int32)[order], np.int32(0))
        self._hash_pairs()
        own = np.full(self.n_symbols, -1, np.int64)
        for p, i in self.ids.items():
            if len(p) > 1:
                own[i] = rank_of[score[p]]
        self.careful = np.zeros(self.n_symbols, bool)
        for part in (self.keys[:-1] // self.n_symbols, self.keys[:-1] % self.n_symbols):
            self.careful[part[(self.ranks[:-1] <= own[part])]] = True
        shared = np.zeros(len(levels), np.int64)
        for p in self.ids:
            if len(p) > 1:
                shared[rank_of[score[p]]] += 1
        for p, i in self.ids.items():
            if len(p) > 1 and shared[rank_of[score[p]]] > 1:
                self.careful[i] = True

        parts = [bytes([int(pieces[i][3:5], 16)]) if lib.is_byte(i) else b"" if lib.is_control(i) else b" \xe2\x81\x87 " if lib.is_unknown(i) else pieces[i].replace(BLANK, " ").encode() for i in range(n)]
        self.part_size = np.array([len(p) for p in parts], np.int64)
        self.part_begin = np.cumsum(self.part_size) - self.part_size
        self.part_bytes = np.frombuffer(b"".join(parts), np.uint8)
        self._reset()

    def _hash_pairs(self) -> None:
        """Open addressing for the pairs: a slot by product hash, then the next ones."""
        bits = max(4, int(np.ceil(np.log2(len(self.keys) * 4))))
        self.shift, size = np.uint64(64 - bits), 1 << bits
        self.slot_key, self.slot_at = np.full(size + 64, -1, np.int64), np.full(size + 64, len(self.keys) - 1, np.int32)
        self.probes = 1
        home = ((self.keys[:-1].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)
        for at in np.argsort(home, kind="stable"):
            h = home[at]
            while self.slot_key[h] >= 0:
                h += 1
            self.slot_key[h], self.slot_at[h] = self.keys[at], at
            self.probes = max(self.probes, int(h - home[at]) + 1)

    def pairs(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Places of the pairs (a, b) in the pair tables, the last place where there is none."""
        key = a.astype(np.int64) * self.n_symbols + b
        slot = ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)
        found = self.slot_key[slot]
        out = np.where(found == key, self.slot_at[slot], np.int32(len(self.keys) - 1))
        open_ = np.flatnonzero((found != key) & (found >= 0))
        for step in range(1, self.probes):
            if not len(open_):
                break
            found = self.slot_key[slot[open_] + step]
            hit = found == key[open_]
            out[open_[hit]] = self.slot_at[slot[open_[hit]] + step]
            open_ = open_[~hit & (found >= 0)]
        out[(a < 0) | (b < 0)] = len(self.keys) - 1
        return out

    # ------------------------------------------------------------ encoding

    def _reset(self) -> None:
        self.known = 0
        self.slot_hash = np.zeros(((1 << TABLE_BITS) + 1024, 2), np.uint64)
        self.slot_segment = np.full((1 << TABLE_BITS) + 1024, -1, np.int32)
        self.flat = np.zeros(1 << 16, np.int32)
        self.begin = np.zeros(1 << 14, np.int64)
        self.size = np.zeros(1 << 14, np.int64)
        self.used = 0

    def _rounds(self, points: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Symbols (negative: a code point without one) and their number for each segment of code points."""
        symbols = self.of_point[points]
        symbols = np.where(symbols < 0, -1 - points.astype(np.int32), symbols)
        segment = np.repeat(np.arange(len(sizes)), sizes)
        place = np.arange(len(symbols))  # of each symbol's first code point: results are put back in this order
        done_place, done_symbol, done_segment = [], [], []
        nothing = len(self.keys) - 1

        def pair_at(at):
            """Pairs of the entries ``at`` with the next ones."""
            nxt = np.minimum(at + 1, len(symbols) - 1)
            out = self.pairs(symbols[at], symbols[nxt])
            out[(at + 1 >= len(symbols)) | (segment[at] != segment[nxt])] = nothing
            return out

        pair = pair_at(np.arange(len(symbols)))
        while len(symbols):
            rank = self.ranks[pair]
            first = np.flatnonzero(np.concatenate(([True], segment[1:] != segment[:-1])))
            count = np.diff(np.append(first, len(segment)))
            low = np.minimum.reduceat(rank, first)
            if (low == NO_RANK).any():  # these segments are done
                over = np.repeat(low == NO_RANK, count)
                done_place.append(place[over])
                done_symbol.append(symbols[over])
                done_segment.append(segment[over])
                live = ~over
                symbols, segment, place, pair, rank = symbols[live], segment[live], place[live], pair[live], rank[live]
                count, low = count[low != NO_RANK], low[low != NO_RANK]
                if not len(symbols):
                    break
            best = np.flatnonzero(rank == np.repeat(low, count))
            fresh = np.concatenate(([True], (best[1:] != best[:-1] + 1) | (segment[best[1:]] != segment[best[:-1]])))
            run = np.maximum.accumulate(np.where(fresh, np.arange(len(best)), 0))
            best = best[(np.arange(len(best)) - run) % 2 == 0]
            made = self.made[pair[best]]
            leftmost = np.concatenate(([True], segment[best[1:]] != segment[best[:-1]]))
            chosen = leftmost | ~self._careful_segments(segment[best], made)
            best, made = best[chosen], made[chosen]
            symbols[best] = made
            keep = np.ones(len(symbols), bool)
            keep[best + 1] = False
            moved = (np.cumsum(keep) - 1)[best]
            symbols, segment, place, pair = symbols[keep], segment[keep], place[keep], pair[keep]
            before = moved[(moved > 0)] - 1
            pair[before] = pair_at(before)
            pair[moved] = pair_at(moved)
        place, symbols, segment = np.concatenate(done_place), np.concatenate(done_symbol), np.concatenate(done_segment)
        order = np.argsort(place, kind="stable")
        return symbols[order], np.bincount(segment, minlength=len(sizes))

    def _careful_segments(self, segment: np.ndarray, made: np.ndarray) -> np.ndarray:
        """Whether an entry's segment has a best piece that may make a pair of its own rank or a better one."""
        careful = self.careful[made]
        if not careful.any():
            return careful
        return np.isin(segment, segment[careful])

    def _long_rounds(self, points: np.ndarray) -> np.ndarray:
        """``_rounds`` for one long segment: the same rounds, but pairs wait in a bucket per rank, so a round touches only the pairs of the least rank.

        Simultaneous merges of a round end after the first whose new pair has that rank or
        a better one: in order, that pair would be next.
        """
        points = points.astype(np.int64)
        n = len(points)
        symbols = np.append(np.where(self.of_point[points] < 0, -1 - points, self.of_point[points]), -1)  # the last entry stands for no neighbour
        left, right = np.append(np.arange(-1, n - 1), -1), np.append(np.arange(1, n + 1), n)
        alive = np.append(np.ones(n, bool), False)
        pair = np.full(n + 1, len(self.keys) - 1)
        buckets: dict[int, list[np.ndarray]] = {}
        queue: list[int] = []

        def wait(at):
            pair[at] = self.pairs(symbols[at], symbols[right[at]])
            rank = self.ranks[pair[at]]
            some = np.argsort(rank, kind="stable")
            some = some[rank[some] != NO_RANK]
            cut = np.flatnonzero(np.diff(rank[some])) + 1
            for part in np.split(some, cut) if len(some) else ():
                r = int(rank[part[0]])
                if r not in buckets:
                    buckets[r] = []
                    heapq.heappush(queue, r)
                buckets[r].append(at[part])

        wait(np.arange(n))
        while queue:
            r = heapq.heappop(queue)
            best = np.unique(np.concatenate(buckets.pop(r)))
            best = best[alive[best] & (self.ranks[pair[best]] == r)]
            if not len(best):
                continue
            fresh = np.concatenate(([True], right[best[:-1]] != best[1:]))
            run = np.maximum.accumulate(np.where(fresh, np.arange(len(best)), 0))
            best = best[(np.arange(len(best)) - run) % 2 == 0]
            made, second = self.made[pair[best]].astype(np.int64), right[best]
            after = right[second]
            beside = np.concatenate(([False], after[:-1] == best[1:]))  # right after the merge before it
            before = np.where(beside, np.append(-1, made[:-1]), symbols[left[best]])
            sooner = np.minimum(self.ranks[self.pairs(before, made)], self.ranks[self.pairs(made, symbols[after])]) <= r
            if sooner.any():
                stop = int(sooner.argmax()) + 1
                if stop < len(best):
                    buckets[r] = [best[stop:]]
                    heapq.heappush(queue, r)
                best, made, second, after = best[:stop], made[:stop], second[:stop], after[:stop]
            symbols[best], alive[second], right[best] = made, False, after
            left[after] = best
            left[n] = -1
            around = np.concatenate([left[best], best])
            wait(np.unique(around[around >= 0]))
        return symbols[:n][alive[:n]]

    def blank_run(self, n: int) -> list[int]:
        """Pieces of a run of n blanks: best score first, leftmost among equals."""
        if n not in self._blank_runs:
            size, right, left, heap = [1] * n, list(range(1, n + 1)), list(range(-1, n - 1)), []

            def push(i):
                if i >= 0 and right[i] < n and size[i] + size[right[i]] in self.blank_scores:
                    heapq.heappush(heap, (-self.blank_scores[size[i] + size[right[i]]], i, size[i], size[right[i]]))

            for i in range(n):
                push(i)
            while heap:
                _, i, a, b = heapq.heappop(heap)
                if size[i] != a or right[i] >= n or size[right[i]] != b:
                    continue
                j = right[i]
                size[i], size[j], right[i] = a + b, 0, right[j]
                if right[j] < n:
                    left[right[j]] = i
                push(left[i])
                push(i)
            self._blank_runs[n] = [self.symbols[BLANK * s] for s in size if s]
        return self._blank_runs[n]

    def _join_blanks(self, symbols: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Put lone blanks that stand together into pieces."""
        blank = self.symbols.get(BLANK, -1)
        segment = np.repeat(np.arange(len(counts)), counts)
        two = np.flatnonzero((symbols[1:] == blank) & (symbols[:-1] == blank) & (segment[1:] == segment[:-1]))
        if not len(two):
            return symbols, counts
        new_run = np.concatenate(([True], two[1:] != two[:-1] + 1))
        starts, ends = two[new_run], two[np.append(np.flatnonzero(new_run)[1:] - 1, len(two) - 1)] + 2
        parts, at, counts = [], 0, counts.copy()
        for s, e in zip(starts.tolist(), ends.tolist(), strict=True):
            run = self.blank_run(e - s)
            parts += [symbols[at:s], np.array(run, np.int32)]
            counts[segment[s]] -= e - s - len(run)
            at = e
        return np.concatenate([*parts, symbols[at:]]), counts

    def _to_ids(self, symbols: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids for symbols; characters without a piece become their bytes."""
        odd = np.flatnonzero((symbols < 0) | (symbols >= self.n_pieces))
        if not len(odd):
            return symbols.astype(np.int32), counts
        raw = [(chr(-1 - s) if s < 0 else self.lone[s]).encode("utf-8") for s in symbols[odd].tolist()]
        width = np.ones(len(symbols), np.int64)
        width[odd] = [len(r) for r in raw]
        out = np.repeat(symbols, width)
        first = np.cumsum(width) - width
        out[np.concatenate([np.arange(first[o], first[o] + len(r)) for o, r in zip(odd.tolist(), raw, strict=True)])] = self.byte_ids[np.frombuffer(b"".join(raw), np.uint8)]
        segment = np.repeat(np.arange(len(counts)), counts)
        return out.astype(np.int32), np.bincount(segment, weights=width, minlength=len(counts)).astype(np.int64)

    def _add(self, texts: list[str]) -> np.ndarray:
        """Encode new segments; their numbers in the table of results."""
        long_ones = [i for i, t in enumerate(texts) if len(t) > LONG_SEGMENT]
        order = np.array([i for i, t in enumerate(texts) if len(t) <= LONG_SEGMENT] + long_ones, np.int64)
        short, long_ones = [texts[i] for i in order[: len(texts) - len(long_ones)].tolist()], [texts[i] for i in long_ones]
        symbols, counts = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for i in range(0, len(short), 20_000):
            some = short[i : i + 20_000]
            s, c = self._rounds(np.frombuffer("".join(some).encode("utf-32-le"), np.uint32), np.array([len(t) for t in some]))
            symbols.append(s)
            counts.append(c)
        for t in long_ones:
            s = self._long_rounds(np.frombuffer(t.encode("utf-32-le"), np.uint32))
            symbols.append(s)
            counts.append(np.array([len(s)]))
        symbols, counts = np.concatenate(symbols), np.concatenate(counts)
        if self.blanks_last:
            symbols, counts = self._join_blanks(symbols, counts)
        flat, counts = self._to_ids(symbols, counts)
        n = self.known
        while self.used + len(flat) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        while n + len(counts) > len(self.begin):
            self.begin, self.size = (np.concatenate([x, np.zeros_like(x)]) for x in (self.begin, self.size))
        self.flat[self.used : self.used + len(flat)] = flat
        self.begin[n : n + len(counts)] = self.used + np.cumsum(counts) - counts
        self.size[n : n + len(counts)] = counts
        self.used += len(flat)
        self.known += len(counts)
        numbers = np.empty(len(texts), np.int32)
        numbers[order] = np.arange(n, self.known)
        return numbers

    def _gathered(self, segments: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of segments in a row, and where each segment's ids end."""
        sizes = self.size[segments]
        ends = np.cumsum(sizes)
        return self.flat[np.repeat(self.begin[segments] - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0)], ends

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids and the number of ids of each text."""
        words, per_text = [], []
        for t in texts:
            found = self.segment.findall(self.prefix + t.replace(" ", BLANK)) if t else []
            words += found
            per_text.append(len(found))
        if self.known > KEPT_SEGMENTS:
            self._reset()
        new = list(dict.fromkeys(words))
        index = dict(zip(new, self._add(new).tolist(), strict=True)) if new else {}
        ids, ends = self._gathered(np.array([index[w] for w in words], np.int64))
        last = np.cumsum(per_text)
        total = np.append(0, ends)
        return ids, total[last] - total[last - np.array(per_text, np.int64)]

    def encode_flat(self, flat: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """``encode`` for texts as UTF-8 bytes and their offsets."""
        raw = flat.tobytes()
        if not self.cut or b"\xe2\x96\x81" in raw:  # a blank sign in a text is a blank to the model
            return self.encode([raw[a:b].decode("utf-8", "replace") for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)])
        lead = b" " if self.prefix else b""
        raw = b"".join([x for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True) if b > a for x in (lead, raw[a:b])])
        at = at + len(lead) * np.append(0, np.cumsum(at[1:] > at[:-1]))
        if not raw:
            return np.zeros(0, np.int32), np.zeros(len(at) - 1, np.int64)
        flat = np.frombuffer(raw, np.uint8)
        begins = np.ones(len(flat), bool)
        begins[1:] = ~self.joins[(flat[:-1].astype(np.int32) << 8) | flat[1:]]
        begins[at[:-1][at[1:] > at[:-1]]] = True
        starts = np.flatnonzero(begins)
        stops = np.append(starts[1:], len(flat))
        if self.known > KEPT_SEGMENTS:
            self._reset()
        one, two = (span_hashes(codes[flat], starts, stops) for codes in _CODES)
        found = self._look_up(one, two)
        missing = np.flatnonzero(found < 0)
        if len(missing):
            _, first, which = np.unique(one[missing], return_index=True, return_inverse=True)
            new = missing[first]
            if (two[missing] != two[new][which]).any():  # two segments share a 64-bit hash: by strings then
                return self.encode([raw[a + len(lead) : b].decode("utf-8", "replace") if b > a else "" for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)])
            texts = [raw[a:b].decode("utf-8", "replace").replace(" ", BLANK) for a, b in zip(starts[new].tolist(), stops[new].tolist(), strict=True)]
            known = self._add(texts)
            self._keep(one[new], two[new], known)
            found[missing] = known[which]
        ids, ends = self._gathered(found)
        total = np.append(0, ends)[np.searchsorted(starts, at)]
        return ids, np.diff(total)

    def _look_up(self, one: np.ndarray, two: np.ndarray) -> np.ndarray:
        """Known segments by their hashes, -1 for the others."""
        slot = (one >> np.uint64(64 - TABLE_BITS)).astype(np.int64)
        out = np.full(len(one), -1, np.int32)
        open_ = np.arange(len(one))
        while len(open_):
            at = slot[open_]
            held = self.slot_segment[at]
            hit = (self.slot_hash[at, 0] == one[open_]) & (self.slot_hash[at, 1] == two[open_]) & (held >= 0)
            out[open_[hit]] = held[hit]
            open_ = open_[~hit & (held >= 0)]
            slot[open_] += 1
        return out

    def _keep(self, one: np.ndarray, two: np.ndarray, segment: np.ndarray) -> None:
        slot = (one >> np.uint64(64 - TABLE_BITS)).astype(np.int64)
        open_ = np.arange(len(one))
        while len(open_):
            free = open_[self.slot_segment[slot[open_]] < 0]
            free = free[np.unique(slot[free], return_index=True)[1]]
            self.slot_segment[slot[free]] = segment[free]
            self.slot_hash[slot[free], 0], self.slot_hash[slot[free], 1] = one[free], two[free]
            open_ = np.setdiff1d(open_, free, assume_unique=True)
            slot[open_] += 1

    # ------------------------------------------------------------ decoding

    def decode(self, flat: np.ndarray, counts: np.ndarray) -> list[str]:
        """Texts for rows of ids."""
        sizes = self.part_size[flat]
        ends = np.cumsum(sizes)
        raw = self.part_bytes[np.repeat(self.part_begin[flat] - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0)].tobytes()
        cut, total = np.append(0, np.cumsum(counts)), np.append(0, ends)
        out = []
        blank_first = self.part_bytes[self.part_begin[flat]] == 32 if self.prefix and len(flat) else np.zeros(len(flat), bool)
        for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
            try:
                out.append(raw[total[a] + int(a < b and blank_first[a]) : total[b]].decode("utf-8"))
            except UnicodeDecodeError:  # byte pieces that are no character: the library's replacement rule
                out.append(self.lib.decode(flat[a:b].tolist()))
        return out


def encode_decode(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, ids (array<int>, the text's pieces) and decoded (the text they stand for)."""

    def run(batches):
        pieces = PieceModel.load(model)
        for batch in batches:
            for part in pieces_of(batch, "text", CHUNK):
                ids, counts = pieces.encode_flat(*text_buffer(part.column(1)))
                arrays = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(counts)), pa.int32()), pa.array(ids, pa.int32()))
                yield pa.RecordBatch.from_arrays([part.column(0), arrays, pa.array(pieces.decode(ids, counts), pa.string())], names=["id", "ids", "decoded"])

    rows = docs.select(col(id_col).alias("id"), col(text_col).cast("string").alias("text"))
    return shipped(rows).mapInArrow(run, T.StructType([T.StructField("id", docs.schema[id_col].dataType), T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("decoded", T.StringType())]))


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def digests(rows: DataFrame) -> DataFrame:
    return rows.select(
        F.col("id").alias("doc_id"),
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ",").cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


def op6_piece_rounds(spark, sf_dir: str) -> DataFrame:
    return digests(encode_decode(spark.read.parquet(f"{sf_dir}/documents.parquet"), default_model()))
