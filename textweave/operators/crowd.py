"""An index searched with its own texts, where shingles count that thousands of texts share.

Shingles that always stand one behind the other are made one unit, so a shared passage is one
entry a text. The commonest units of a text that together can't make a span are no way to find it; they count once it
is found by another. A query's units, and all texts that have one of them, meet in one block.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from textweave.functions.portable import shingle_hashes
from textweave.functions.text import SHINGLE, words
from textweave.operators.index import spread, tasks
from textweave.operators.itself import BUCKET_BYTES, PACKED, _narrow, _wide
from textweave.plans.options import SearchOptions

#: Match points that are laid out at once.
POINTS = 1 << 19
#: Kinds of rows: shingles by hash; by the texts that hold it; units of a text; places of too common ones; lengths.
PLACE, CLASS, ENTRY, GONE, LENGTH = range(5)
SENT = pa.schema([("to", pa.int32()), ("kind", pa.int8()), *[(f"c{i}", pa.binary()) for i in range(6)]])
ROWS = "to int, kind tinyint, c0 binary, c1 binary, c2 binary, c3 binary, c4 binary, c5 binary"
HITS = pa.schema([(c, pa.int64()) for c in ("qid", "did", "matched_shingles", "q_total", "d_total")] + [(c, pa.float64()) for c in ("C", "Cq", "Cd")])
FOUND = "qid long, did long, matched_shingles long, q_total long, d_total long, C double, Cq double, Cd double"
Step = Callable[[pa.Table], pa.Table]


def _changes(*columns: np.ndarray) -> np.ndarray:
    """Whether a row differs from the one before it."""
    out = np.ones(len(columns[0]), bool)
    out[1:] = False
    for c in columns:
        out[1:] |= c[1:] != c[:-1]
    return out


def _follows(of: np.ndarray, unit: np.ndarray, pos: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Whether an entry is the same unit as the one before it and begins where that ends."""
    out = ~_changes(of, unit)
    out[1:] &= pos[1:] == (pos + length)[:-1]
    return out


def _ranges(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """starts[0], starts[0] + 1, ... ``counts[0]`` of them, then those from starts[1] on."""
    return np.arange(int(counts.sum())) + np.repeat(starts - (np.cumsum(counts) - counts), counts)


def _sent(to: np.ndarray, kind: int, *columns: np.ndarray) -> list[tuple]:
    """One row a target, of whole numbers as a first one and steps; steps wrap, and so does their sum."""
    order = np.argsort(to, kind="stable")
    to = to[order]
    cuts = np.flatnonzero(_changes(to)) if len(to) else to
    rows = []
    for low, high in zip(cuts, [*cuts[1:], len(to)], strict=False):
        packed = [c[order[low:high]].astype(np.int64) for c in columns]
        rows.append((int(to[low]), kind, *[c[:1].tobytes() + _narrow(np.diff(c)) for c in packed], *[None] * (6 - len(columns))))
    return rows


def _sheet(rows: list[tuple]) -> list[pa.Array]:
    return [pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True) if rows else [()] * len(SENT), SENT, strict=True)]


def _got(table: pa.Table, kind: int, n: int) -> list[np.ndarray]:
    """The columns of a kind of rows, one behind the other."""
    mine = table.filter(pc.equal(table.column("kind"), kind))
    parts = ([np.cumsum(np.concatenate((np.frombuffer(x, np.int64, 1), _wide(x[8:])))) for x in mine.column(f"c{i}").to_pylist()] for i in range(n))
    return [np.concatenate(p) if p else np.empty(0, np.int64) for p in parts]


def _passed(table: pa.Table, *kinds: int) -> list[tuple]:
    """The rows of kinds that a step only hands on."""
    mine = table.filter(pc.is_in(table.column("kind"), pa.array(kinds, pa.int8())))
    return list(zip(*(mine.column(c).to_pylist() for c in SENT.names), strict=True))


def _part(keys: np.ndarray, parts: int, shift: int = 0) -> np.ndarray:
    return ((keys.view(np.uint64) >> np.uint64(shift)) % np.uint64(parts)).astype(np.int64)


def _mixed(x: np.ndarray) -> np.ndarray:
    """Ids to even 64 bits, one to one."""
    x = x.view(np.uint64) + np.uint64(0x9E3779B97F4A7C15)
    for shift, times in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(times)
    return x ^ (x >> np.uint64(31))


def _holders(h: np.ndarray, did: np.ndarray) -> np.ndarray:
    """For each place, a number that tells the texts of its hash; the places of a hash stand together."""
    starts = np.flatnonzero(_changes(h))
    return np.repeat(np.add.reduceat(_mixed(did), starts), np.diff(np.append(starts, len(h)))).view(np.int64)


def _dealt(buckets: int, later: int, most: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Token hashes of texts to shingles by hash, and lengths. Places of a hash beyond ``most`` + 1 go without it."""

    def parts(did: np.ndarray, n: np.ndarray, hashes: np.ndarray) -> pa.RecordBatch:
        each = np.maximum(n - SHINGLE + 1, 0)
        some = each > 0
        row = np.repeat(np.arange(len(n)), each)
        pos = np.arange(len(row)) - (np.cumsum(each) - each)[row]
        h = shingle_hashes(hashes, (np.cumsum(n) - n)[row] + pos)
        of = did[row]
        kept = np.ones(len(h), bool)
        if len(h) > most + 1:  # the most + 1 before it are equal
            order = np.argsort(h, kind="stable")
            by = h[order]
            kept[order[most + 1 :]] = by[most + 1 :] != by[: -most - 1]
        rows = _sent(_part(did[some], later), LENGTH, did[some], each[some]) + _sent(_part(of[~kept], later), GONE, of[~kept], pos[~kept])
        key = h[kept].view(np.int64)
        return pa.RecordBatch.from_arrays(_sheet(rows + _sent(_part(key, buckets), PLACE, key, of[kept], pos[kept])), schema=SENT)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            did = batch.column(0).to_numpy(zero_copy_only=False)
            n = batch.column(1).value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            hashes = batch.column(1).flatten().to_numpy(zero_copy_only=False).view(np.uint64)
            ends = np.cumsum(n)
            low = 0
            while low < len(n):
                base = ends[low] - n[low]
                high = max(low + 1, int(np.searchsorted(ends, base + PACKED, "right")))
                yield parts(did[low:high], n[low:high], hashes[base : ends[high - 1]])
                low = high

    return run


def _shared(later: int, most: int) -> Step:
    """Shingles by hash: those of one place are dropped, those of more than ``most`` are gone, the rest go by the texts that hold them."""

    def run(table: pa.Table) -> pa.Table:
        rows = _passed(table, GONE, LENGTH)
        h, did, pos = _got(table, PLACE, 3)
        if len(h):
            order = np.argsort(h, kind="stable")  # a text's places stay together, in order
            h, did, pos = h[order], did[order], pos[order]
            fresh = _changes(h)
            df = np.diff(np.append(np.flatnonzero(fresh), len(h)))
            df = np.repeat(df, df)
            gone = df > most
            rows += _sent(_part(did[gone], later), GONE, did[gone], pos[gone])
            some = (df > 1) & ~gone
            h, did, pos = h[some], did[some], pos[some]
        if len(h):
            rows += _sent(_part(_holders(h, did), later), CLASS, h, did, pos)
        return pa.Table.from_arrays(_sheet(rows), schema=SENT)

    return run


def _units(later: int) -> Step:
    """Shingles of which each place is followed by one of the other, and none of the other stands elsewhere, to units: (first hash, places, did, pos, length)."""

    def run(table: pa.Table) -> pa.Table:
        rows = _passed(table, GONE, LENGTH)
        h, did, pos = _got(table, CLASS, 3)
        if len(h):
            texts = _holders(h, did)
            order = np.lexsort((pos, did, texts))
            texts, h, did, pos = texts[order], h[order], did[order], pos[order]
            number = np.unique(h, return_inverse=True)[1]
            df = np.bincount(number)
            same = ~_changes(texts, did)[1:]
            after = np.full(len(h), -1)
            after[:-1] = np.where(same & (pos[1:] == pos[:-1] + 1), number[1:], -1)
            by = np.argsort(number, kind="stable")
            starts = np.cumsum(df) - df
            low, high = np.minimum.reduceat(after[by], starts), np.maximum.reduceat(after[by], starts)
            linked = (low == high) & (low >= 0) & (df[low] == df)
            first = np.flatnonzero(np.concatenate(([True], ~(same & linked[number[:-1]]))))
            length = np.diff(np.append(first, len(h)))
            rows += _sent(_part(did[first], later), ENTRY, h[first], df[number[first]], did[first], pos[first], length)
        return pa.Table.from_arrays(_sheet(rows), schema=SENT)

    return run


def _texts(later: int, least: int) -> Step:
    """A text's units, told which of them are free: its commonest, whose places are fewer than ``least``. A text's block is that of its commonest other unit."""

    def run(table: pa.Table) -> pa.Table:
        ids, n = _got(table, LENGTH, 2)
        u, df, did, pos, length = _got(table, ENTRY, 5)
        gone, place = _got(table, GONE, 2)
        order = np.argsort(ids)
        ids, n = ids[order], n[order]
        block = _part(ids, later)
        alone = np.ones(len(ids), bool)
        rows: list[tuple] = []
        if len(u):
            order = np.lexsort((pos, u, -df, did))
            u, did, pos, length = u[order], did[order], pos[order], length[order]
            new = _changes(did, u)
            group = np.cumsum(new) - 1
            text = np.searchsorted(ids, did)
            of = text[new]
            places = np.bincount(group, length).astype(np.int64)
            head = np.flatnonzero(_changes(of))
            sums = np.cumsum(places)
            free = sums - np.repeat((sums - places)[head], np.diff(np.append(head, len(of)))) < least
            by = np.lexsort((free, of))
            by = by[_changes(of[by])]
            block[of[by]] = _part(u[new][by], later, 20)
            alone[of] = False
            rows += _sent(_part(u, later, 8), ENTRY, u, did, n[text], pos, length, block[text] * 2 + free[group])
        rows += _sent(block[np.searchsorted(ids, gone)], GONE, gone, place) + _sent(block[alone], LENGTH, ids[alone], n[alone])
        return pa.Table.from_arrays(_sheet(rows), schema=SENT)

    return run


def _lists(later: int) -> Step:
    """All entries of a unit to each block that has one of its texts, told whether that is the text's own block."""

    def run(table: pa.Table) -> pa.Table:
        rows = _passed(table, GONE, LENGTH)
        u, did, n, pos, length, flags = _got(table, ENTRY, 6)
        if len(u):
            order = np.argsort(u, kind="stable")
            u, did, n, pos, length, flags = (c[order] for c in (u, did, n, pos, length, flags))
            head = np.flatnonzero(_changes(u))
            size = np.diff(np.append(head, len(u)))
            pairs = np.unique(np.repeat(np.arange(len(head)), size) * later + (flags >> 1))
            unit, block = pairs // later, pairs % later
            for b in np.unique(block):
                mine = unit[block == b]
                k = _ranges(head[mine], size[mine])
                rows += _sent(np.full(len(k), b), ENTRY, u[k], did[k], n[k], pos[k], length[k], (flags[k] & 1) + 2 * (flags[k] >> 1 == b))
        return pa.Table.from_arrays(_sheet(rows), schema=SENT)

    return run


def _runs(d: np.ndarray, delta: np.ndarray, start: np.ndarray, length: np.ndarray, options: SearchOptions) -> list[np.ndarray]:
    """(d, delta, q_from, length) of the islands on each diagonal that are long enough, the best ones of each d only."""
    across, along = int(delta.max() - delta.min()) + 1, int(start.max()) + 1
    if (int(d.max()) + 1) * across * along < 1 << 62:
        order = np.argsort((d * across + (delta - delta.min())) * along + start)
    else:
        order = np.lexsort((start, delta, d))
    d, delta, start, end = d[order], delta[order], start[order], (start + length)[order]
    new = _changes(d, delta)
    new[1:] |= start[1:] - end[:-1] >= 1 + options.span_gap
    first = np.flatnonzero(new)
    out = [d[first], delta[first], start[first], end[np.append(first[1:], len(d)) - 1] - start[first]]
    return _best([c[out[3] >= options.span_min_len] for c in out], options)


def _best(runs: list[np.ndarray], options: SearchOptions) -> list[np.ndarray]:
    d, delta, start, length = runs
    order = np.lexsort((delta, start, -length, d))
    runs = [c[order] for c in runs]
    if not len(d):
        return runs
    head = np.flatnonzero(_changes(runs[0]))
    rank = np.arange(len(d)) - np.repeat(head, np.diff(np.append(head, len(d))))
    return [c[rank < options.max_spans_per_doc] for c in runs]


def _pair_runs(mine: tuple, other: tuple, own: bool, more: list[np.ndarray], options: SearchOptions, most: int) -> list[np.ndarray]:
    """The best runs of one pair, by windows of diagonals of at most ``most`` points, if they aren't one diagonal. mine, other: (unit, pos, length) by unit and place."""
    (unit, pos, length), (units, places, _) = mine, other
    key = units << 32 | places
    last = int(max(pos.max(), places.max())) + 1
    best = more
    todo = [(-last, last)]
    while todo:
        low, high = todo.pop()
        begin = np.searchsorted(key, unit << 32 | np.maximum(pos + low, 0))
        count = np.maximum(np.searchsorted(key, unit << 32 | np.maximum(pos + high, 0)) - begin, 0)
        if count.sum() > most and high - low > 1:
            todo += [(low, (low + high) // 2), ((low + high) // 2, high)]
            continue
        q = np.repeat(np.arange(len(pos)), count)
        delta = places[_ranges(begin, count)] - pos[q]
        if own:
            q, delta = q[delta != 0], delta[delta != 0]
        if len(q):
            runs = _runs(np.zeros(len(q), np.int64), delta, pos[q], length[q], options)
            best = _best([np.concatenate(c) for c in zip(best, runs, strict=True)], options)
    return best


def _answers(options: SearchOptions, least: int, most: int) -> Step:
    """The best hits of the texts of a block. Found by units that aren't free; told of by all."""

    def own_runs(n: int, gone: np.ndarray) -> list[np.ndarray]:
        """A text's runs with itself: all its places but those gone; a gap within the allowed one is bridged."""
        there = np.ones(n, bool)
        there[gone] = False
        edge = np.flatnonzero(np.diff(there.astype(np.int8), prepend=0, append=0))
        start, end = edge[::2], edge[1::2]
        zero = np.zeros(len(start), np.int64)
        return _runs(zero, zero, start, end - start, options) if len(start) else [zero] * 4

    def share(n: int, totals: np.ndarray, matched: np.ndarray) -> tuple[np.ndarray, ...]:
        cq, cd = np.minimum(1.0, matched / n), np.minimum(1.0, matched / totals)
        return 100 * np.minimum(1.0, np.maximum(0.0, options.alpha * cq + (1 - options.alpha) * cd)), cq, cd

    def scored(q: int, n: int, dids: np.ndarray, totals: np.ndarray, matched: np.ndarray) -> list[np.ndarray]:
        c, cq, cd = share(n, totals, matched)
        top = np.lexsort((dids, -c))[: options.topk]
        return [np.full(len(top), q), dids[top], matched[top], np.full(len(top), n), totals[top], c[top], 100 * cq[top], 100 * cd[top]]

    def run(table: pa.Table) -> pa.Table:
        out: list[list[np.ndarray]] = []
        u, did, n, pos, length, flags = _got(table, ENTRY, 6)
        gone_did, gone_pos = _got(table, GONE, 2)
        order = np.argsort(gone_did, kind="stable")
        gone_did, gone_pos = gone_did[order], gone_pos[order]

        def gone_of(q: int) -> np.ndarray:
            return gone_pos[np.searchsorted(gone_did, q) : np.searchsorted(gone_did, q, "right")]

        for q, m in zip(*(c.tolist() for c in _got(table, LENGTH, 2)), strict=True):  # nothing in common with any text
            lost = gone_of(q)
            if m - len(lost) >= least and len(runs := own_runs(m, lost)[3]):
                out.append(scored(q, m, np.array([q]), np.array([m]), np.array([runs.sum()])))
        if len(u):
            ids, text = np.unique(did, return_inverse=True)
            unit = np.unique(u, return_inverse=True)[1]
            order = np.lexsort((pos, unit, text))
            text, unit, pos, length, flags, n = (c[order] for c in (text, unit, pos, length, flags, n))
            at = np.searchsorted(text, np.arange(len(ids) + 1))
            total = n[at[:-1]]
            known = np.flatnonzero(flags & 1 == 0)  # entries that find a text, by unit
            known = known[np.argsort(unit[known], kind="stable")]
            lists = np.searchsorted(unit[known], np.arange(unit.max() + 2))
            known_text, known_length = text[known], length[known].astype(np.float64)
            free = np.flatnonzero(flags & 1)
            free_at = np.searchsorted(text[free], np.arange(len(ids) + 1))
            free_text, free_unit, free_length = text[free], unit[free], length[free]
            rank = np.full(len(ids), -1)
            times = np.zeros(int(unit.max()) + 1, np.int64)
            seen: dict[tuple, list[np.ndarray]] = {}

            def spans(mine: tuple, k: np.ndarray, of: np.ndarray, own: np.ndarray, whole: list[np.ndarray]) -> np.ndarray:
                """The length of the best runs with each of some texts, of entries k; ``own`` tells which is the query's, whose main diagonal is ``whole``."""
                me = int(np.argmax(own)) if own.any() else -1
                first = np.flatnonzero(~_follows(of, unit[k], pos[k], length[k]))
                b = np.diff(np.append(first, len(k)))  # entries that follow each other, as of one word again and again, are one train
                train = np.flatnonzero(~_follows(np.zeros(len(mine[0]), np.int64), *mine))
                a = np.diff(np.append(train, len(mine[0])))
                low = np.searchsorted(mine[0][train], unit[k[first]])
                each = np.searchsorted(mine[0][train], unit[k[first]], "right") - low
                x, y = _ranges(low, each), np.repeat(np.arange(len(first)), each)
                places = a[x] + b[y] - 1  # diagonals on which two trains meet
                runs = [np.full(len(whole[3]), me), *whole[1:]] if me >= 0 else [np.empty(0, np.int64)] * 4
                if places.sum() > most:  # pair by pair
                    parts = []
                    for one in range(len(own)):
                        s = k[of == one]
                        more = [c if one == me else c[:0] for c in runs]
                        best = _pair_runs(mine, (unit[s], pos[s], length[s]), one == me, [np.zeros(len(more[3]), np.int64), *more[1:]], options, most) if len(s) else more
                        parts.append([np.full(len(best[3]), one), *best[1:]])
                    runs = [np.concatenate(c) for c in zip(*parts, strict=True)]
                elif len(k):
                    step = _ranges(1 - a[x], places)
                    x, y = np.repeat(x, places), np.repeat(y, places)
                    q, late, ahead = train[x], np.maximum(0, -step), np.maximum(0, step)
                    size = mine[2][q]
                    d, start = of[first[y]], mine[1][q] + late * size
                    delta = pos[k[first[y]]] - mine[1][q] + step * size
                    size = size * np.minimum(a[x] - late, b[y] - ahead)
                    s = (d != me) | (delta != 0)
                    if s.any():
                        runs = _best([np.concatenate(c) for c in zip(runs, _runs(d[s], delta[s], start[s], size[s], options), strict=True)], options)
                return np.bincount(runs[0], runs[3], len(own)).astype(np.int64)

            for q in np.unique(text[flags >= 2]).tolist():
                low, high = at[q], at[q + 1]
                mine = unit[low:high], pos[low:high], length[low:high]
                m, lost = int(total[q]), gone_of(ids[q])
                whole = int(mine[2].sum()) + len(lost) == m  # then all texts of these units and places are equal
                key = tuple(c.tobytes() for c in (*mine, lost)) if whole else ()
                if whole and key in seen:
                    out.append([np.full_like(seen[key][0], ids[q]), *seen[key][1:]])
                    continue
                new = np.flatnonzero(_changes(mine[0]))
                units = mine[0][new]
                times[units] = np.diff(np.append(new, high - low))
                k = _ranges(lists[units], lists[units + 1] - lists[units])
                if len(k) > len(ids) // 8:
                    hits = np.bincount(known_text[k], known_length[k], len(ids))
                    found = np.flatnonzero(hits)
                    hits = hits[found].astype(np.int64)
                else:
                    found, which = np.unique(known_text[k], return_inverse=True)
                    hits = np.bincount(which, known_length[k], len(found)).astype(np.int64)
                count = free_at[found + 1] - free_at[found]
                f = _ranges(free_at[found], count)
                hits += np.bincount(np.repeat(np.arange(len(found)), count), free_length[f] * (times[free_unit[f]] > 0), len(found)).astype(np.int64)
                others = (found != q) & (hits >= least)
                found, hits = found[others], hits[others]
                if m - len(lost) >= least:
                    found, hits = np.append(found, q), np.append(hits, m - len(lost))
                found = found[np.lexsort((found, -hits))[: options.candidates_topn]]
                rank[found] = np.arange(len(found))
                k = np.sort(np.concatenate((known[k[rank[known_text[k]] >= 0]], free[f[(times[free_unit[f]] > 0) & (rank[free_text[f]] >= 0)]])))
                of = rank[text[k]]
                rank[found] = -1
                points = np.bincount(of, times[unit[k]] * length[k], len(found)).astype(np.float64) * (1 + options.span_gap)
                points[found == q] = np.inf
                bound = share(m, total[found], np.minimum(points, options.max_spans_per_doc * np.minimum(m, total[found])))[0]
                order = np.lexsort((found, -bound))
                found, bound = found[order], bound[order]
                again = np.empty_like(order)
                again[order] = np.arange(len(order))
                of = again[of]
                order = np.argsort(of, kind="stable")
                k, of = k[order], of[order]
                answer = scored(int(ids[q]), m, ids[:0], total[:0], total[:0])
                done, size = 0, 2 * options.topk
                while done < len(found):  # the best bounds first, until no other can be among the best
                    if len(answer[0]) == options.topk and (-answer[5][-1], answer[1][-1]) < (-bound[done], ids[found[done]]):
                        break
                    part = slice(*np.searchsorted(of, (done, done + size)))
                    some = found[done : done + size]
                    matched = spans(mine, k[part], of[part] - done, some == q, own_runs(m, lost))
                    there = np.flatnonzero(matched)
                    new = [np.append(answer[1], ids[some[there]]), np.append(answer[4], total[some[there]]), np.append(answer[2], matched[there])]
                    answer = scored(int(ids[q]), m, *new)
                    done, size = done + size, 2 * size
                times[units] = 0
                if whole:
                    seen[key] = answer
                out.append(answer)
        columns = [np.concatenate(c) for c in zip(*out, strict=True)] if out else [()] * len(HITS)
        return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(columns, HITS, strict=True)], schema=HITS)

    return run


def search_crowd(records: DataFrame, options: SearchOptions, segment: str = "all", points: int = POINTS) -> DataFrame:
    """The hits of every record's text (did, doc_id, text) in the index of all of them, without caps on texts and without spans; did is unique."""
    records = spread(records.select("did", "doc_id", "text"))
    size = records.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(1, -(-size // BUCKET_BYTES))
    later = max(min(buckets, tasks(records.sparkSession)), buckets // 4)
    least = max(options.min_hits, 1 - (1 - options.span_min_len) // (1 + options.span_gap))  # places that make the shortest span
    keyed = records.select("did", F.transform(words(F.col("text")), lambda t: F.xxhash64(t)).alias("keys"))
    rows = keyed.mapInArrow(_dealt(buckets, later, options.max_postings_per_hash), ROWS)
    for parts, step in ((buckets, _shared(later, options.max_postings_per_hash)), (later, _units(later)), (later, _texts(later, least)), (later, _lists(later))):
        rows = rows.repartition(min(4 * parts, 4096), "to").groupBy("to").applyInArrow(step, ROWS)
    found = rows.repartition(min(4 * later, 4096), "to").groupBy("to").applyInArrow(_answers(options, least, points), FOUND)
    told = found.join(records.select("did", "doc_id"), "did").withColumns({"segment": F.lit(segment), "alpha": F.lit(options.alpha)})
    return told.withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("C"), "doc_id")))
