"""A run-length index: run-compressed Burrows-Wheeler transform with suffix samples at run ends.

Built for a shard of short texts. Patterns stream through it right to left; where the transform
doesn't continue a pattern, the search moves to the nearest end of a run that does, whose sample
tells how much still matches. So each pattern position gets a row of the index and how long it
matches there, capped at the length that matters. All patterns step at once in numpy.
"""

from __future__ import annotations

import numpy as np


def _ranks(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys)
    k = keys[order]
    rank = np.empty(len(keys), dtype=np.int64)
    rank[order] = np.cumsum(np.concatenate(([0], k[1:] != k[:-1])))
    return rank, order


class RunIndex:
    """Index of texts (a list of uint8 arrays); match lengths count up to long.

    text, starts: the texts joined, each followed by a separator, and where each begins. Rows are
    suffixes in order; separators sort before all bytes, by text.
    """

    def __init__(self, texts: list[np.ndarray], long: int = 100):
        self.long = long
        lengths = np.array([len(t) for t in texts], dtype=np.int64)
        self.starts = np.concatenate(([0], np.cumsum(lengths + 1)))[:-1]
        n = int((lengths + 1).sum())
        self.text = np.zeros(n + long, dtype=np.int16)
        sym = np.empty(n, dtype=np.int64)
        for t, (a, x) in enumerate(zip(self.starts, texts, strict=True)):
            sym[a : a + len(x)] = x
            sym[a + len(x)] = -1 - t
        self.text[:n] = np.where(sym < 0, -1, sym)
        self.text[n:] = -1
        # Separators are numbers below all bytes, a different one for each text, so no tie outlives a text.
        many = len(texts)
        sym = np.where(sym < 0, -1 - sym, sym + many)
        rank, order = _ranks(sym)
        width, at_long = 1, None
        longest = int(lengths.max(initial=0)) + 1

        def shifted(r: np.ndarray, by: int) -> np.ndarray:
            return np.concatenate((r[by:], np.full(min(by, n), -1)))[:n]

        while width < longest or at_long is None:
            if 2 * width >= long and at_long is None:
                at_long = _ranks(rank * (n + 1) + shifted(rank, long - width) + 1)[0] if width < long else rank
                continue
            rank, order = _ranks(rank * (n + 1) + shifted(rank, width) + 1)
            width *= 2
        self.n = n
        before = np.where(order > 0, self.text[order - 1], -1)
        # Rows preceded by a separator never continue a pattern; they form runs of their own.
        head = np.flatnonzero(np.concatenate(([True], before[1:] != before[:-1])))
        self.run_start, self.run_char = head, before[head]
        tail = np.append(head[1:], n) - 1
        self.sample_first, self.sample_last, self.run_end = order[head], order[tail], tail
        by_char = np.argsort(before, kind="stable")
        lf = np.empty(n, dtype=np.int64)
        lf[by_char] = np.arange(n) - int((before == -1).sum()) + many
        self.run_lf = lf[head]
        self.char_runs = np.sort((self.run_char.astype(np.int64) + 1) * len(head) + np.arange(len(head)))
        # Rows that share their first `long` symbols stand together; each such block has its first place in the texts.
        block = at_long[order]
        cut = np.flatnonzero(np.concatenate(([True], block[1:] != block[:-1])))
        self.block_start, self.block_first = cut, np.minimum.reduceat(order, cut)

    def _common(self, a: np.ndarray, pattern: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Length of the match of text at a and pattern at b, up to long; separators match nothing."""
        out = np.zeros(len(a), dtype=np.int64)
        span = np.arange(self.long)
        for lo in range(0, len(a), 4096):
            x, y = self.text[a[lo : lo + 4096, None] + span], pattern[b[lo : lo + 4096, None] + span]
            same = (x == y) & (x >= 0)
            out[lo : lo + 4096] = np.where(same.all(axis=1), self.long, np.argmin(same, axis=1))
        return out

    def matching_statistics(self, pattern: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each place of each pattern[starts[i]:ends[i]]: a row, and its match length (capped).

        pattern: int16, negative outside patterns, with `long` places to spare at the end.
        """
        row, length = np.zeros(len(pattern), dtype=np.int64), np.zeros(len(pattern), dtype=np.int64)
        lane_row, lane_len = np.zeros(len(starts), dtype=np.int64), np.zeros(len(starts), dtype=np.int64)
        at = ends - 1
        live = np.flatnonzero(at >= starts)
        runs = len(self.run_start)
        while len(live):
            p = at[live]
            c = pattern[p].astype(np.int64)
            r, n = lane_row[live], lane_len[live]
            run = np.searchsorted(self.run_start, r, "right") - 1
            off = np.flatnonzero(self.run_char[run] != c)
            if len(off):
                key = (c[off] + 1) * runs + run[off]
                after = np.searchsorted(self.char_runs, key)
                best_row, best_len = np.zeros(len(off), dtype=np.int64), np.full(len(off), -1, dtype=np.int64)
                for pick, rows, samples in ((after, self.run_start, self.sample_first), (after - 1, self.run_end, self.sample_last)):
                    inside = (pick >= 0) & (pick < len(self.char_runs))
                    cand = self.char_runs[np.where(inside, pick, 0)]
                    ok = np.flatnonzero(inside & (cand // runs == c[off] + 1))
                    which = cand[ok] % runs
                    got = np.minimum(self._common(samples[which], pattern, p[off[ok]] + 1), n[off[ok]])
                    better = got > best_len[ok]
                    best_row[ok[better]], best_len[ok[better]] = rows[which[better]], got[better]
                n[off] = best_len
                r[off] = np.where(best_len >= 0, best_row, 0)
                run[off] = np.searchsorted(self.run_start, r[off], "right") - 1
            found = n >= 0
            r = np.where(found, self.run_lf[run] + r - self.run_start[run], 0)
            n = np.where(found, np.minimum(n + 1, self.long), 0)
            row[p], length[p] = r, n
            lane_row[live], lane_len[live] = r, n
            at[live] -= 1
            live = live[at[live] >= starts[live]]
        return row, length

    def first_place(self, row: np.ndarray) -> np.ndarray:
        """The first place, in the joined texts, of the long string that begins row's suffix."""
        return self.block_first[np.searchsorted(self.block_start, row, "right") - 1]
