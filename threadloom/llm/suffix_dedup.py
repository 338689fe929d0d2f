"""Operator 10, removal of repeated byte strings by run-length indexes.

Every 50-byte window of a text belongs to its anchor, the least of its 20-byte hashes; equal windows
have equal anchors. A run of neighbouring windows with one anchor is a span. Hashes only tell which
strings go into one index; what is a repeat is decided by matching statistics on bytes.
1. Spans meet by anchor. Anchors that one document alone has are done.
2. The spans of a part of the anchors go into a run-length index: a run-compressed Burrows-Wheeler
   transform with sampled run ends, and the smallest document for each 50 bytes that its suffixes begin
   with. Each span is streamed through, and a match of 50 bytes that a smaller document has is marked.
3. Spans of anchors that very many documents share go into an index of their batch of documents first,
   which marks most of them; the windows left are dealt out by a hash of their bytes, and each part's
   windows go into an index of their own.
4. Marks meet the texts again, which are cut.

Documents go to homes and indexes to groups by hashes, one packed row for each pair of both: homes and
groups hold a fixed number of bytes, so a row holds less the larger the input is, but never a single span.

Of whole texts that are equal (by SHA-256) only the smallest document's goes this way: all bytes of the
others are covered by its strings.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadloom.llm.common import MARKS as BITS
from threadloom.llm.common import batches, rows_marked, spent, spread_join, worker_state, written
from threadloom.llm.shingles import mixed, powers

WIDTH, GRAM = 50, 20
SPREAD = WIDTH - GRAM + 1
#: Documents taken together; an anchor that more than one in HOT of them holds is dealt out by windows, as is one with MANY spans in all.
BATCH, HOT, MANY = 1024, 64, 4096
_CHUNK = 1 << 19
_LOW = np.uint64((1 << 20) - 1)
_BYTE = mixed(np.arange(1000, 1256, dtype=np.uint64))
_FACTOR = 0x9E3779B97F4A7C15 | 1


_UP = powers(_FACTOR, _CHUNK + 256)
_DOWN = powers(pow(_FACTOR, -1, 1 << 64), _CHUNK + 256)


def _least(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` neighbours, by doubling."""
    size, total = 1, len(x)
    while 2 * size <= width:
        x = np.minimum(x[:-size], x[size:])
        size *= 2
    rest = width - size
    return np.minimum(x[: total - width + 1], x[rest : rest + total - width + 1]) if rest else x


def spans(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, first window, windows - 1, anchor) of every span of every text."""
    out: list[tuple] = []
    for own, starts, data in _pieces(texts):
        n = len(data)
        if n < WIDTH:
            continue
        total = np.zeros(n + 1, np.uint64)
        np.cumsum(_BYTE[data] * _UP[:n], out=total[1:])
        h = mixed((total[GRAM:] - total[:-GRAM]) * _DOWN[: n - GRAM + 1])
        least = _least((h & ~_LOW) | np.arange(len(h), dtype=np.uint64), SPREAD)
        piece = np.repeat(np.arange(len(own)), np.diff(np.append(starts, n)))
        valid = piece[: n - WIDTH + 1] == piece[WIDTH - 1 :]
        same = np.zeros(len(valid) + 1, bool)
        same[1:-1] = (least[1:] == least[:-1]) & (piece[1 : len(valid)] == piece[: len(valid) - 1])
        lo = np.flatnonzero(valid & ~same[:-1])
        hi = np.flatnonzero(valid & ~(same[1:] & np.append(valid[1:], False)))
        k = piece[lo]
        number, offset = np.array([x for x, _ in own]), np.array([y for _, y in own])
        out.append((number[k], lo - starts[k] + offset[k], hi - lo, mixed(least[lo] >> np.uint64(20))))
    if not out:
        return (*(np.empty(0, np.int64) for _ in range(3)), np.empty(0, np.uint64))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _pieces(texts: list[bytes]) -> Iterator[tuple[list[tuple[int, int]], np.ndarray, np.ndarray]]:
    """Texts put together up to a size, longer ones cut with an overlap that leaves no window out."""
    own, parts, size = [], [], 0

    def ready():
        lengths = np.array([len(p) for p in parts])
        return own, np.cumsum(lengths) - lengths, np.frombuffer(b"".join(parts), np.uint8)

    for k, text in enumerate(texts):
        for at in range(0, max(1, len(text) - WIDTH + 1), _CHUNK // 2):
            piece = text[at : at + _CHUNK // 2 + WIDTH - 1]
            if len(piece) < WIDTH:
                continue
            if size + len(piece) > _CHUNK:
                yield ready()
                own, parts, size = [], [], 0
            own.append((k, at))
            parts.append(piece)
            size += len(piece)
    if own:
        yield ready()


ENTRY = np.dtype([("anchor", "<u4"), ("where", "<u2"), ("first", "<u4")])
#: A span whose anchor others have: its document among the row's, the cell of its anchor, whether it goes on by windows.
SPAN = np.dtype([("doc", "<u4"), ("cell", "<u4"), ("first", "<u4"), ("more", "u1"), ("crowded", "?")])
WINDOW = np.dtype([("doc", "<u4"), ("at", "<u4"), ("bytes", f"V{WIDTH}")])
#: A covered run of bytes: its document among the row's.
MARK = np.dtype([("doc", "<u4"), ("from", "<u4"), ("to", "<u4")])
#: What a row of ``meet`` holds: marks, and open spans, of a home's documents; windows of a document.
MARKS, OPEN, CUT_WINDOWS = 0, 1, 2
#: Sections of a batch: spans by their anchor, marks, windows, anchors that are crowded in the batch.
_SPANS, _MARKS, _WINDOWS, _CROWDED = 0, 1, 2, 3
FOUND = "doc_id long, text_hash long, kind int, home int, spans binary, ids binary, names binary"


def home_of(ids: np.ndarray, names: np.ndarray, homes: int) -> np.ndarray:
    """Where documents meet their open spans again."""
    return (mixed(ids.view(np.uint64) ^ mixed(names.view(np.uint64))) % np.uint64(homes)).astype(np.int64)


def meet(docs: DataFrame, buckets: int, homes: int, cells: int) -> DataFrame:
    """Spans that have to be looked up in the indexes, and marks that batches found on their own, packed by home;
    windows that batches leave, by document."""

    def split(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_state("suffix_dedup", None, lambda: None)  # what another operator left in the worker goes
        for b in batches(it, BATCH, sized=1):
            ids, names = b.column(0).to_numpy(), b.column(2).to_numpy()
            order = np.argsort(ids, kind="stable")
            _, first = np.unique(names[order], return_index=True)  # the first of equal texts stands for them
            keep = np.sort(order[first])
            ids, names = ids[keep], names[keep]
            texts = [b.column(1)[int(k)].as_py() or b"" for k in keep]
            text, lo, more, anchor = spans(texts)
            if not len(text):
                continue
            key = anchor & ~np.uint64(2 * BATCH - 1) | text.astype(np.uint64)
            by = np.argsort(key)
            key = key[by]
            other = np.concatenate([[True], key[1:] != key[:-1]])
            key >>= np.uint64((2 * BATCH).bit_length() - 1)
            group = np.cumsum(np.concatenate([[True], key[1:] != key[:-1]])) - 1
            crowded = np.zeros(len(text), bool)
            crowded[by] = (np.bincount(group, other) > max(8, len(texts) // HOT))[group]
            out: list[tuple] = []
            # crowded anchors: the batch's own index marks what its smaller documents have; the other windows go on
            own = np.flatnonzero(crowded)
            if len(own):
                strings = [texts[t][x : x + n] for t, x, n in zip(text[own].tolist(), lo[own].tolist(), (more[own] + WIDTH).tolist(), strict=True)]
                hit, at, left, left_at = marked_by_index(strings, ids[text[own]])
                for t, starts in _by(text[own[hit]], lo[own[hit]] + at):
                    out.append((int(mixed(names[t : t + 1].view(np.uint64))[0] % np.uint64(buckets)), _MARKS, _intervals(starts).tobytes(), ids[t : t + 1].tobytes(), names[t : t + 1].tobytes()))
                for t, starts in _by(text[own[left]], lo[own[left]] + left_at):
                    windows = np.zeros(len(starts), WINDOW)
                    windows["at"] = starts
                    windows["bytes"] = _windows(np.frombuffer(texts[t], np.uint8), starts)
                    out.append((int(mixed(names[t : t + 1].view(np.uint64))[0] % np.uint64(buckets)), _WINDOWS, windows.tobytes(), ids[t : t + 1].tobytes(), names[t : t + 1].tobytes()))
            told = np.unique(anchor[own])
            for k, part in _by((told >> np.uint64(32)) % np.uint64(buckets), told):
                out.append((int(k), _CROWDED, part.tobytes(), b"", b""))
            # the others by anchor
            rest = np.flatnonzero(~crowded)
            bucket = ((anchor[rest] >> np.uint64(32)) % np.uint64(buckets)).astype(np.int64)
            entry = np.empty(len(rest), ENTRY)
            entry["anchor"], entry["where"], entry["first"] = anchor[rest] & np.uint64(0xFFFFFFFF), text[rest] << 6 | more[rest], lo[rest]
            for k, order, used, place in _dealt(bucket, text[rest]):
                part = entry[order]
                part["where"] = place << 6 | part["where"] & 63
                out.append((k, _SPANS, part.tobytes(), ids[used].tobytes(), names[used].tobytes()))
            columns = list(zip(*out, strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary()), strict=True)], ["bucket", "section", "packed", "ids", "names"])

    def gather(t: pa.Table) -> pa.Table:
        bucket = t.column("bucket")[0].as_py()
        parts, ids, names, base = [], [np.empty(0, np.int64)], [np.empty(0, np.int64)], 0
        told = [np.empty(0, np.uint64)]
        out: list[tuple] = []
        marks: list[tuple] = []
        for section, x, i, n in zip(t.column("section").to_pylist(), t.column("packed"), t.column("ids"), t.column("names"), strict=True):
            x = x.as_py()
            i, n = np.frombuffer(i.as_py(), np.int64), np.frombuffer(n.as_py(), np.int64)
            if section == _CROWDED:
                told.append(np.frombuffer(x, np.uint64))
            elif section == _MARKS:
                marks.append((i, n, x))
            elif section == _WINDOWS:
                out.append((int(i[0]), int(n[0]), CUT_WINDOWS, None, x, None, None))
            else:
                own = np.frombuffer(x, ENTRY)
                parts.append((own["anchor"].astype(np.uint64) | np.uint64(bucket) << np.uint64(32), own["first"], own["where"] & 63, base + (own["where"] >> 6).astype(np.int64)))
                ids.append(i)
                names.append(n)
                base += len(i)
        ids, names, told = np.concatenate(ids), np.concatenate(names), np.unique(np.concatenate(told) & np.uint64(0xFFFFFFFF) | np.uint64(bucket) << np.uint64(32))
        if parts:
            anchor, first, more, doc = (np.concatenate(c) for c in zip(*parts, strict=True))
            # the first of equal texts stands for them here too
            by = np.lexsort((ids, names))
            chosen = np.zeros(len(ids), bool)
            chosen[by[np.concatenate([[True], names[by][1:] != names[by][:-1]])]] = True
            keep = chosen[doc]
            anchor, first, more, doc = anchor[keep], first[keep], more[keep], doc[keep]
            key = anchor << np.uint64(32) | doc.astype(np.uint64)  # a bucket's anchors differ in the lower half
            by = np.argsort(key)
            key = key[by]
            other = np.concatenate([[True], key[1:] != key[:-1]])
            new = np.concatenate([[True], key[1:] >> np.uint64(32) != key[:-1] >> np.uint64(32)])
            group = np.cumsum(new) - 1
            holders = np.bincount(group, other)
            crowded = np.isin(anchor[by[new]], told) | (np.bincount(group) > MANY)
            asked = (crowded | (holders > 1))[group]
            at, crowded = by[asked], crowded[group[asked]]
            span = np.empty(len(at), SPAN)
            span["cell"], span["first"], span["more"], span["crowded"] = mixed(anchor[at]) % np.uint64(cells), first[at], more[at], crowded
            for home, order, used, place in _dealt(home_of(ids, names, homes)[doc[at]], doc[at]):
                part = span[order]
                part["doc"] = place
                out.append((None, None, OPEN, home, part.tobytes(), ids[used].tobytes(), names[used].tobytes()))
        if marks:
            ids, names = (np.concatenate(c) for c in list(zip(*marks, strict=True))[:2])
            pairs = [np.frombuffer(x, "<u4").reshape(-1, 2) for _, _, x in marks]
            doc = np.repeat(np.arange(len(ids)), list(map(len, pairs)))
            out += [(None, None, MARKS, *row) for row in packed_marks(doc, np.concatenate(pairs), ids, names, homes)]
        columns = list(zip(*out, strict=True)) or [[]] * 7
        types = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary())
        return pa.table({c: pa.array(v, p) for c, v, p in zip(("doc_id", "text_hash", "kind", "home", "spans", "ids", "names"), columns, types, strict=True)})

    return docs.mapInArrow(split, "bucket int, section int, packed binary, ids binary, names binary").groupBy("bucket").applyInArrow(gather, FOUND)


def _by(key: np.ndarray, value: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Values of each key, in order."""
    order = np.argsort(key.astype(np.uint16) if len(key) and key.max() < 1 << 16 else key, kind="stable")
    key, value = key[order], value[order]
    cut = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.empty(0, np.int64)
    yield from zip(key[cut].tolist(), np.split(value, cut[1:]) if len(cut) else [], strict=True)


def _dealt(key: np.ndarray, doc: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """Rows of each key by document: (key, rows, its documents, each row's place among these)."""
    both = key.astype(np.uint64) << np.uint64(32) | doc.astype(np.uint64)
    order = np.argsort(both, kind="stable")
    both = both[order]
    other = np.concatenate([[True], both[1:] != both[:-1]])[: len(both)]
    number, used = np.cumsum(other) - 1, doc[order[other]]
    key = key[order]
    cut = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])[: len(key)]).tolist()
    for x, y in zip(cut, [*cut[1:], len(key)], strict=False):
        yield int(key[x]), order[x:y], used[number[x] : number[y - 1] + 1], number[x:y] - number[x]


def _intervals(starts: np.ndarray) -> np.ndarray:
    """Byte intervals (start, end) as 32-bit pairs that windows cover."""
    return _runs(starts).astype("<u4")


def _runs(starts: np.ndarray) -> np.ndarray:
    """(start, end) of every run of bytes that windows cover."""
    starts = np.sort(starts)
    run = np.flatnonzero(np.concatenate([[True], starts[1:] > starts[:-1] + WIDTH]))
    return np.stack([starts[run], starts[np.append(run[1:], len(starts)) - 1] + WIDTH], 1)


def _windows(data: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The bytes of windows."""
    return np.ascontiguousarray(data[starts[:, None] + np.arange(WIDTH)]).view(f"V{WIDTH}").ravel()


class RunLengthIndex:
    """Run-compressed Burrows-Wheeler transform of many short strings, each with its own end mark.

    ``heads`` and ``starts`` are the runs; per symbol the lengths of its runs are summed for LF steps. At both
    ends of every run the place of its suffix in the strings is sampled: from there matching statistics go on
    where a run has another symbol than the streamed string. Rows are also sampled where their first WIDTH
    bytes change, with the smallest document that has these bytes.
    """

    def __init__(self, texts: list[bytes], docs: np.ndarray) -> None:
        lengths = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
        n, count = int(lengths.sum()), len(texts)
        ends = np.cumsum(lengths) - 1
        data = np.frombuffer(b"\0".join(texts) + b"\0", np.uint8).astype(np.int64) + count
        data[ends] = np.arange(count)  # end marks are smaller than all bytes, each a symbol of its own
        # ranks by as many symbols as one key holds, then by two or three times as many; all end marks are one symbol
        # that nothing follows, and suffixes that are equal up to there are put in the order of their strings
        left = np.repeat(ends, lengths) - np.arange(n)
        used = np.bincount(np.maximum(data - count, -1) + 1, minlength=257)[1:] > 0
        bits = max(1, int(used.sum()).bit_length())
        size = min(63 // bits, WIDTH)
        symbol = np.concatenate([np.zeros(count, np.int64), np.cumsum(used) * used])[data]
        symbol = np.concatenate([symbol, np.zeros(size, np.int64)])
        key, times = symbol[:n].copy(), 3 if n < (1 << 21) - 1 else 2
        for k in range(1, size):
            key <<= bits
            key |= np.where(left >= k, symbol[k : n + k], 0)
        del symbol  # an index is large for its strings: what isn't needed any more goes at once
        firsts: tuple[int, np.ndarray] = (0, left)
        while True:
            order = np.argsort(key)
            sorted_ = key[order]
            rank = np.cumsum(np.concatenate([[False], sorted_[1:] != sorted_[:-1]]))
            del key, sorted_
            ranks = np.empty(n, np.int64)
            ranks[order] = rank
            if size <= WIDTH:
                firsts = size, ranks
            if size >= WIDTH // 3 and size >= int(lengths.max()):
                break
            del order, rank
            key = ranks.copy()
            for step in range(size, times * size, size):
                key *= n + 2
                key[: max(0, n - step)] += np.where(left[: max(0, n - step)] >= step, ranks[step:] + 1, 0)
            size *= times
        del ranks
        rank *= n
        order += rank
        order.sort()
        order -= rank
        del rank
        symbols = data[order - 1]
        symbols[order == 0] = data[n - 1]
        self.starts = np.flatnonzero(np.concatenate([[True], symbols[1:] != symbols[:-1]]))
        self.heads = symbols[self.starts]
        del symbols
        lasts = np.append(self.starts[1:], n) - 1
        self.sorted_key = np.sort(self.heads * (len(self.heads) + 1) + np.arange(len(self.heads)))
        self.by_symbol = self.sorted_key % (len(self.heads) + 1)
        self.step = np.empty(len(self.heads), np.int64)
        lengths_of = (lasts - self.starts + 1)[self.by_symbol]
        self.step[self.by_symbol] = np.cumsum(lengths_of) - lengths_of  # rows before, all symbols in order
        self.step -= self.starts  # from a row of the run to the row that LF gives
        self.first_at, self.last_at, self.lasts = order[self.starts], order[lasts], lasts  # sampled run ends
        self.count, self.data = count, np.concatenate([data, np.full(WIDTH, -1)])
        # rows that begin with the same WIDTH bytes: pieces that cover them, of one size, have equal ranks
        size, ranks = firsts
        change = np.concatenate([[True], np.zeros(n - 1, bool)])
        inside = left[order] >= WIDTH
        change[1:] = ~(inside[1:] & inside[:-1])
        for step in (*range(0, WIDTH - size, size), WIDTH - size):
            piece = ranks[np.minimum(order + step, n - 1)]
            change[1:] |= piece[1:] != piece[:-1]
        del firsts, ranks, piece, inside, left
        self.samples = np.flatnonzero(change)
        # directories: the run, and the sample, that a row belongs to
        self.run_of, self.sample_of = (np.repeat(np.arange(len(x), dtype=np.int32), np.diff(np.append(x, n))) for x in (self.starts, self.samples))
        self.least = np.minimum.reduceat(np.repeat(docs, lengths)[order], self.samples)

    def stream(self, strings: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """Matching statistics of strings, of whatever origin, from their ends: batches of (string, position,
        length, row), ``length`` of the longest match that starts there (at most WIDTH), ``row`` of a suffix that has it."""
        sizes = np.fromiter(map(len, strings), np.int64, len(strings))
        first = np.cumsum(sizes) - sizes
        flat = np.concatenate([np.frombuffer(b"".join(strings), np.uint8).astype(np.int64) + self.count, np.full(WIDTH, -2)])
        live = np.flatnonzero(sizes)
        row, length, at = np.zeros(len(live), np.int64), np.zeros(len(live), np.int64), sizes[live] - 1
        runs = len(self.heads)
        while len(live):
            place = first[live] + at
            symbol = flat[place]
            run = self.run_of[row]
            jump = np.flatnonzero(self.heads[run] != symbol)
            if len(jump):
                # the nearest runs of the symbol above and below; the better of their ends by the bytes it shares
                key = symbol[jump] * (runs + 1) + run[jump]
                below = np.searchsorted(self.sorted_key, key)
                best, best_row = np.full(len(jump), -1), row[jump].copy()
                for number, sample, at_row in ((below - 1, self.last_at, self.lasts), (below, self.first_at, self.starts)):
                    found = self.by_symbol[np.clip(number, 0, runs - 1)]
                    fits = (number >= 0) & (number < runs) & (self.heads[found] == symbol[jump])
                    shared = np.where(fits, self._shared(sample[found], flat, place[jump] + 1, length[jump]), -1)
                    better = shared > best
                    best, best_row = np.where(better, shared, best), np.where(better, at_row[found], best_row)
                there = best >= 0
                row[jump], length[jump] = best_row, np.maximum(best, 0)
                run = self.run_of[row]
            row, length = row + self.step[run], np.minimum(length + 1, WIDTH)
            if len(jump):
                lost = jump[~there]  # no string has the symbol
                row[lost], length[lost] = 0, 0
            yield live, at, length, row
            more = at > 0
            live, row, length, at = live[more], row[more], length[more], at[more] - 1

    def _shared(self, sample: np.ndarray, flat: np.ndarray, place: np.ndarray, most: np.ndarray) -> np.ndarray:
        """Bytes that suffixes of the index and of streamed strings share, ``most`` at most."""
        out = np.zeros(len(sample), np.int64)
        on = np.flatnonzero(most > 0)
        while len(on):  # eight at a time
            k = out[on, None] + np.arange(8)
            same = (self.data[np.minimum(sample[on, None] + k, len(self.data) - 1)] == flat[np.minimum(place[on, None] + k, len(flat) - 1)]) & (k < most[on, None])
            step = np.where(same.all(1), 8, same.argmin(1))
            out[on] += step
            on = on[step == 8]
        return out

    def least_of(self, strings: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(string, position, document) of every WIDTH-byte match: the smallest document that has these bytes."""
        found: list[tuple] = [(np.empty(0, np.int64),) * 3]
        for live, at, length, row in self.stream(strings):
            hit = length >= WIDTH
            found.append((live[hit], at[hit], self.least[self.sample_of[row[hit]]]))
        return tuple(np.concatenate(c) for c in zip(*found, strict=True))


def marked_by_index(strings: list[bytes], docs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(string, position) of the windows that a smaller document's string has, then of all other windows. An
    index is built over the strings, each once, and each is streamed through it."""
    number: dict[bytes, int] = {}
    own = np.fromiter((number.setdefault(s, len(number)) for s in strings), np.int64, len(strings))
    least = np.full(len(number), np.iinfo(np.int64).max)
    np.minimum.at(least, own, docs)
    distinct = list(number)
    string, at, smallest = RunLengthIndex(distinct, least).least_of(distinct) if distinct else (np.empty(0, np.int64),) * 3
    order = np.argsort(string.astype(np.uint16) if len(distinct) <= 1 << 16 else string, kind="stable")
    string, at, smallest = string[order], at[order], smallest[order]
    times = np.bincount(string, minlength=len(distinct))
    each = times[own]  # every holder of a string has its windows
    index = np.arange(each.sum()) - np.repeat(np.cumsum(each) - each, each) + np.repeat((np.cumsum(times) - times)[own], each)
    who = np.repeat(np.arange(len(own)), each)
    hit = smallest[index] < docs[who]
    return who[hit], at[index[hit]], who[~hit], at[index[~hit]]


MARKED = "home int, spans binary, ids binary, names binary"
CELL = "part int, settled boolean, heads binary, bytes binary, ids binary, names binary"
#: A string of a group: its document among the row's, its place in there, its length (of a span, at most WIDTH + SPREAD - 1), its cell in the group.
HEAD = np.dtype([("doc", "<u4"), ("first", "<u4"), ("size", "u1"), ("cell", "u1")])
#: Bytes of crowded spans that are looked up in an index of their own; of windows, which grow with crowded anchors and not with texts.
_OWN, _WINDOW_LOT = 1 << 20, 1 << 19


def window_hash(flat: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Hashes of the windows that start at ``at``."""
    value = np.zeros(len(at), np.uint64)
    for k in range(WIDTH):
        value = value * np.uint64(_FACTOR) + _BYTE[flat[at + k]]
    return mixed(value)


def lots(own: np.ndarray, size: np.ndarray, start: np.ndarray, flat: np.ndarray) -> Iterator[np.ndarray]:
    """The strings of a cell as they go into indexes. Strings of one window each have nothing in common but with
    their equals: by a hash of their bytes they go into as many indexes as hold a fixed number of bytes."""
    many = -(-len(own) * WIDTH // _WINDOW_LOT)
    if many > 1 and int(size[own].max()) == WIDTH:
        for _, k in _by(mixed(window_hash(flat, start[own])) % np.uint64(many), own):
            yield k
    else:
        yield own


def packed_marks(doc: np.ndarray, pairs: np.ndarray, ids: np.ndarray, names: np.ndarray, homes: int) -> list[tuple]:
    """Byte intervals of documents, packed by home."""
    out = []
    for home, order, used, place in _dealt(home_of(ids, names, homes)[doc], doc):
        mark = np.empty(len(order), MARK)
        mark["doc"], mark["from"], mark["to"] = place, pairs[order, 0], pairs[order, 1]
        out.append((home, mark.tobytes(), ids[used].tobytes(), names[used].tobytes()))
    return out


def texts_at_home(docs: DataFrame, asked: DataFrame, homes: int) -> DataFrame:
    """Texts with their homes; those that no packed row names aren't shuffled."""
    bits = bits_of(asked)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            rows = rows_marked(pc.bit_wise_and(b.column(2), BITS - 1), bits)
            for k in range(0, len(rows), 1000):
                own = b.take(pa.array(rows[k : k + 1000]))
                home = home_of(own.column(0).to_numpy(), own.column(2).to_numpy(), homes)
                yield pa.RecordBatch.from_arrays([pa.array(home, pa.int32()), *own.columns], ["home", "doc_id", "text", "text_hash"])

    return docs.where("doc_id is not null").select("doc_id", "text", "text_hash").mapInArrow(run, "home int, doc_id long, text binary, text_hash long")


def met(left: pa.Table, right: pa.Table, kind: np.dtype) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(ids, names) of a home's texts, what its packed rows hold, and the text that each of these entries means."""
    ids, names = (left.column(c).to_numpy() for c in ("doc_id", "text_hash"))
    number = dict(zip(zip(ids.tolist(), names.tolist(), strict=True), range(len(ids)), strict=True))
    parts, places = [], []
    for s, i, n in zip(right.column("spans"), right.column("ids"), right.column("names"), strict=True):
        parts.append(np.frombuffer(s.as_py(), kind))
        keys = zip(np.frombuffer(i.as_py(), np.int64).tolist(), np.frombuffer(n.as_py(), np.int64).tolist(), strict=True)
        places.append(np.fromiter((number[k] for k in keys), np.int64)[parts[-1]["doc"]])
    return ids, names, np.concatenate(parts), np.concatenate(places)


def bits_of(asked: DataFrame) -> np.ndarray:
    """A bitmap, of fixed size, of the texts that packed rows name."""

    def fill(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros(BITS, bool)
        for b in it:
            for x in b.column(0):
                bits[np.frombuffer(x.as_py(), np.int64) & (BITS - 1)] = True
        parts = np.packbits(bits, bitorder="little").reshape(64, -1)
        some = np.flatnonzero(parts.any(1))
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array([parts[k].tobytes() for k in some], pa.binary())], ["part", "bits"])

    def unite(t: pa.Table) -> pa.Table:
        total = np.zeros(BITS // 512, np.uint8)
        for x in t.column("bits"):
            total |= np.frombuffer(x.as_py(), np.uint8)
        return pa.table({"part": t.column("part").slice(0, 1).cast(pa.int32()), "bits": pa.array([total.tobytes()], pa.binary())})

    out = np.zeros((64, BITS // 512), np.uint8)
    for r in asked.select("names").mapInArrow(fill, "part int, bits binary").groupBy("part").applyInArrow(unite, "part int, bits binary").toArrow().to_pylist():
        out[r["part"]] = np.frombuffer(r["bits"], np.uint8)
    return out.ravel().view(np.uint64)


def by_indexes(docs: DataFrame, found: DataFrame, homes: int, groups: int, cells: int, window_cells: int) -> DataFrame:
    """Marks of open spans. Those of crowded anchors are marked by an index of their home's first, and what it
    leaves goes on as windows, dealt out by a hash of their bytes; the others go on whole, by anchor. An
    index of each cell marks them; a group has several cells, and works through them one by one."""

    def spans_of(left: pa.Table, right: pa.Table) -> pa.Table:
        if not right.num_rows:
            return pa.Table.from_batches([record([])])
        ids, names, span, doc = met(left, right, SPAN)
        text = pa.chunked_array([c.cast(pa.large_binary()) for c in left.column("text").chunks]).combine_chunks()
        base = np.frombuffer(text.buffers()[1], np.int64)[text.offset :]
        flat = np.frombuffer(text.buffers()[2], np.uint8)
        out = []
        first, size = span["first"].astype(np.int64), span["more"].astype(np.int64) + WIDTH
        own = np.flatnonzero(~span["crowded"])
        if len(own):
            out += dealt(span["cell"][own].astype(np.int64), doc[own], first[own], size[own], base[doc[own]] + first[own], flat, ids, names)
        own = np.flatnonzero(span["crowded"])
        own = own[np.argsort(doc[own], kind="stable")]
        for _, k in _by(np.cumsum(size[own]) // _OWN, own):
            at = base[doc[k]] + first[k]
            out += own_marks(doc[k], first[k], [flat[x:y].tobytes() for x, y in zip(at.tolist(), (at + size[k]).tolist(), strict=True)], ids, names)
        return pa.Table.from_batches([record(out)])

    def windows_of(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches(it, 2000, sized=2, most=2 << 20):
            packed = [np.frombuffer(x.as_py(), WINDOW) for x in b.column(2)]
            w = np.concatenate(packed)
            doc = np.repeat(np.arange(len(packed)), list(map(len, packed)))
            by = np.lexsort((w["at"], doc))
            w, doc, at = w[by], doc[by], w["at"][by].astype(np.int64)
            run = np.flatnonzero(np.concatenate([[True], (doc[1:] != doc[:-1]) | (at[1:] != at[:-1] + 1)]))  # neighbouring windows are one string
            raw = np.ascontiguousarray(w["bytes"]).view(np.uint8).reshape(len(w), WIDTH)
            tails = raw[:, -1].tobytes()
            strings = [raw[x].tobytes() + tails[x + 1 : y] for x, y in zip(run.tolist(), [*run[1:].tolist(), len(w)], strict=True)]
            rows = own_marks(doc[run], at[run], strings, b.column(0).to_numpy(), b.column(1).to_numpy())
            if rows:
                yield record(rows)

    def own_marks(doc: np.ndarray, first: np.ndarray, strings: list[bytes], ids: np.ndarray, names: np.ndarray) -> list[tuple]:
        """Marks that a batch finds on its own, then the windows that it leaves."""
        hit, at, left, left_at = marked_by_index(strings, ids[doc])
        rows = [(int(k % groups), True, _intervals(starts).tobytes(), b"", ids[k : k + 1].tobytes(), names[k : k + 1].tobytes()) for k, starts in _by(doc[hit], first[hit] + at)]
        flat, base = np.frombuffer(b"".join(strings), np.uint8), np.cumsum([0, *map(len, strings)])
        at = base[left] + left_at
        cell = (np.uint64(cells) + window_hash(flat, at) % np.uint64(window_cells)).astype(np.int64)
        return rows + dealt(cell, doc[left], first[left] + left_at, np.full(len(left), WIDTH), at, flat, ids, names)

    def dealt(cell: np.ndarray, doc: np.ndarray, first: np.ndarray, size: np.ndarray, at: np.ndarray, flat: np.ndarray, ids: np.ndarray, names: np.ndarray) -> list[tuple]:
        """Strings that start at ``at`` in ``flat``, packed by the group of their cell."""
        rows = []
        head = np.empty(len(cell), HEAD)
        head["first"], head["size"], head["cell"] = first, size, cell // groups
        for group, order, used, place in _dealt(cell % groups, doc):
            own, n = head[order], size[order]
            own["doc"] = place
            ends = np.cumsum(n)
            data = flat[np.repeat(at[order] - (ends - n), n) + np.arange(ends[-1])].tobytes()
            rows.append((group, False, own.tobytes(), data, ids[used].tobytes(), names[used].tobytes()))
        return rows

    def record(rows: list[tuple]) -> pa.RecordBatch:
        types = (pa.int32(), pa.bool_(), pa.binary(), pa.binary(), pa.binary(), pa.binary())
        columns = list(zip(*rows, strict=True)) or [[]] * 6
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["part", "settled", "heads", "bytes", "ids", "names"])

    def look(t: pa.Table) -> pa.Table:
        worker_state("suffix_dedup", None, lambda: None)
        settled = t.column("settled").to_numpy()
        out: list[tuple] = []
        heads, ids, names = (t.column(c).filter(settled) for c in ("heads", "ids", "names"))
        if len(heads):
            pairs = [np.frombuffer(x.as_py(), "<u4").reshape(-1, 2) for x in heads]
            ids, names = (np.concatenate([np.frombuffer(x.as_py(), np.int64) for x in c]) for c in (ids, names))
            out += packed_marks(np.repeat(np.arange(len(pairs)), list(map(len, pairs))), np.concatenate(pairs), ids, names, homes)
        heads, data, ids, names = (t.column(c).filter(~settled) for c in ("heads", "bytes", "ids", "names"))
        if len(heads):
            ids, names = ([np.frombuffer(x.as_py(), np.int64) for x in c] for c in (ids, names))
            base = np.cumsum([0, *map(len, ids)])
            parts = [np.frombuffer(x.as_py(), HEAD) for x in heads]
            head = np.concatenate(parts)
            doc = head["doc"] + np.repeat(base[:-1], list(map(len, parts)))
            ids, names, data = np.concatenate(ids), np.concatenate(names), b"".join(x.as_buffer() for x in data)
            end = np.cumsum(head["size"], dtype=np.int64)
            start, pairs = end - head["size"], []
            flat = np.frombuffer(data, np.uint8)
            for own in (k for _, cell in _by(head["cell"], np.arange(len(head))) for k in lots(cell, head["size"], start, flat)):
                hit, at, _, _ = marked_by_index([data[x:y] for x, y in zip(start[own].tolist(), end[own].tolist(), strict=True)], ids[doc[own]])
                if len(hit):
                    pairs.append(_runs(doc[own[hit]] << 32 | head["first"][own[hit]] + at))
            if pairs:
                pairs = np.concatenate(pairs)
                out += packed_marks(pairs[:, 0] >> 32, pairs & 0xFFFFFFFF, ids, names, homes)
        columns = list(zip(*out, strict=True)) or [[]] * 4
        return pa.table({c: pa.array(v, p) for c, v, p in zip(("home", "spans", "ids", "names"), columns, (pa.int32(), pa.binary(), pa.binary(), pa.binary()), strict=True)})

    asked = found.where(F.col("kind") == OPEN).select("home", "spans", "ids", "names")
    late = texts_at_home(docs, asked, homes).groupBy("home").cogroup(asked.groupBy("home")).applyInArrow(spans_of, CELL)
    early = found.where(F.col("kind") == CUT_WINDOWS).select("doc_id", "text_hash", "spans").mapInArrow(windows_of, CELL)
    return late.unionByName(early).groupBy("part").applyInArrow(look, MARKED)


CUT = "doc_id long, text_hash long, n_removed long, n_spans long, kept_sha256 string, kept binary"


def cut_texts(docs: DataFrame, marks: DataFrame, homes: int, with_text: bool) -> DataFrame:
    """Removes the union of the marked intervals from each text."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out: tuple[list, ...] = ([], [], [], [], [], [])
        if right.num_rows:
            ids, names, mark, doc = met(left, right, MARK)
            order = np.lexsort((mark["from"], doc))
            mark, texts = mark[order], left.column("text")
            for k, pairs in _by(doc[order], np.stack([mark["from"], mark["to"]], 1).astype(np.int64)):
                text = texts[k].as_py()
                reach = np.maximum.accumulate(pairs[:, 1])
                new = np.concatenate([[True], pairs[1:, 0] > reach[:-1]])
                lo, hi = pairs[new, 0], reach[np.append(np.flatnonzero(new)[1:] - 1, len(pairs) - 1)]
                kept = b"".join(text[x:y] for x, y in zip([0, *hi.tolist()], [*lo.tolist(), len(text)], strict=True))
                for column, value in zip(out, (int(ids[k]), int(names[k]), int((hi - lo).sum()), len(lo), hashlib.sha256(kept).hexdigest(), kept if with_text else None), strict=True):
                    column.append(value)
        types = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary())
        return pa.table({c: pa.array(v, t) for c, v, t in zip(("doc_id", "text_hash", "n_removed", "n_spans", "kept_sha256", "kept"), out, types, strict=True)})

    return texts_at_home(docs, marks, homes).groupBy("home").cogroup(marks.groupBy("home")).applyInArrow(run, CUT)


def deduplicate(docs: DataFrame, with_text: bool = False) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) per row; ``with_text`` adds ``kept`` (binary).

    A byte goes if a 50-byte string that covers it also starts in a document of a smaller id, judged on
    the input. Null texts are empty; rows with a null id keep everything and take nothing away; rows
    that repeat an id are judged each for itself, and not against each other; an empty table gives no
    rows; other columns are ignored.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary")
    docs = docs.select(F.col("doc_id").cast("long"), text.alias("text")).withColumn("text_hash", F.xxhash64("text"))
    base = written(docs.select("doc_id", "text_hash", F.octet_length("text").cast("long").alias("n_bytes"), F.sha2("text", 256).alias("sha")), "texts")
    total = base.agg(F.coalesce(F.sum("n_bytes"), F.lit(0))).first()[0]
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), total // 16_000_000)
    named = base.where("doc_id is not null").groupBy("text_hash", F.col("sha").alias("first_sha")).agg(F.min("doc_id").alias("first"))
    cells, window_cells = max(4 * parts, total // 2_000_000), max(16, total // 4_000_000)
    homes = max(min(4 * parts, 64), total // 8_000_000, -(-(cells + window_cells) // 256))  # groups too: a cell's number in its group is a byte
    found = written(meet(docs.where("doc_id is not null and octet_length(text) >= 50"), parts, homes, cells), "spans")
    marks = found.where(F.col("kind") == MARKS).select("home", "spans", "ids", "names")
    marks = marks.unionByName(by_indexes(docs, found, homes, homes, cells, window_cells))
    marks = written(marks, "marks")
    spent(found)
    cut = cut_texts(docs, marks, homes, with_text)
    rows = spread_join(base, written(named, "firsts"), "text_hash", "left").join(cut, ["doc_id", "text_hash"], "left")
    copy = F.coalesce((F.col("doc_id") > F.col("first")) & (F.col("sha") == F.col("first_sha")) & (F.col("n_bytes") >= WIDTH), F.lit(False))
    return rows.select(
        "doc_id",
        "n_bytes",
        F.when(copy, F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(copy, 1).otherwise(F.coalesce("n_spans", F.lit(0))).cast("long").alias("n_spans"),
        F.when(copy, F.sha2(F.lit("").cast("binary"), 256)).otherwise(F.coalesce("kept_sha256", "sha")).alias("kept_sha256"),
        *([F.when(copy, F.lit("").cast("binary")).otherwise(F.col("kept")).alias("kept"), "text_hash"] if with_text else []),
    )
