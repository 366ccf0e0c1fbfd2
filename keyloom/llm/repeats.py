"""Removal of byte strings that repeat across documents: every byte under a 50-byte string that an earlier one has too.

A window is 50 consecutive bytes of a document. Its anchor is the smallest (by hash) of its 12-byte strings, so equal
windows have equal anchors at equal places. A window reaches at least 19 bytes beyond its anchor to the right, or else
to the left: that side and the anchor, 31 bytes, are its key. Windows in a row with one anchor and one side are a part,
some 60 bytes for some 10 windows. Three exchanges over blocks of documents follow; each covers all documents:

1. every block sends the hashes of its parts' keys, and learns which keys another document has too;
2. only parts whose key is shared are sent, with the places where they occur; where they meet, equal parts are joined,
   and the others' suffixes are sorted: a merge sort, group by group, in which two suffixes are compared by a binary
   search for their common extension over prefix-polynomial hashes; every order and every equality that follows is then
   checked on the bytes. Suffixes that agree over 50 bytes are one string; the smallest id that has it keeps it;
3. the stretches to remove come back to their block, and the documents are cut.

A key that very many different parts share (a common line in ever new surroundings) is hot: its parts are sent window
by window, each to where the hash of its own 50 bytes says, so no task gets them all. Counts and hot keys come from all
documents. Equal parts of one block travel once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import blocks as B
from . import textvec

LENGTH = 50
ANCHOR = 12
#: bytes that a key has beside its anchor; every window has as many on one side of it at least
SIDE = (LENGTH - ANCHOR) // 2
#: different parts of a key beyond which they travel window by window
HOT = 2_000
_CHUNK = 1 << 20
_KEY_BITS = 40
_RIGHT, _LEFT, _WINDOW = 0, 1, 2
_BASE = 0x9E3779B97F4A7C15
_LONGEST = 128
_UP = np.array([pow(_BASE, i, 1 << 64) for i in range(_LONGEST)], dtype=np.uint64)
_DOWN = np.array([pow(_BASE, -i, 1 << 64) for i in range(_LONGEST)], dtype=np.uint64)


def _words_at(buf: np.ndarray) -> np.ndarray:
    """The 8 bytes from each position as a number; `buf` needs 8 bytes of padding at its end."""
    return np.ndarray(shape=(len(buf) - 8,), dtype="<u8", buffer=buf, strides=(1,))


def _mix(a: np.ndarray) -> np.ndarray:
    a = a ^ (a >> np.uint64(31))
    a *= np.uint64(0xBF58476D1CE4E5B9)
    a ^= a >> np.uint64(29)
    return a


def _order(buf: np.ndarray, at: slice) -> np.ndarray:
    """40 bits by which anchors are ordered, shifted up by 24: a hash of the ANCHOR (9 to 16) bytes from each position."""
    h = _words_at(buf)[at] * np.uint64(_BASE)
    tail = np.ndarray(shape=(len(buf) - 8 - (ANCHOR - 8),), dtype="<u8", buffer=buf[ANCHOR - 8 :], strides=(1,))[at] * np.uint64(0xD6E8FEB86659FD93)
    h ^= tail >> np.uint64(32)
    h += tail
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h &= np.uint64(((1 << 40) - 1) << 24)
    return h


def find_contexts(buf: np.ndarray, doc_starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First window start, last window start and anchor position of each run of windows with one anchor; texts do not mix.

    `buf` holds the texts end to end, then at least 24 bytes of padding.
    """
    n_kmers = LENGTH - ANCHOR + 1
    total = int(doc_starts[-1])
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    ends = doc_starts[1:]
    step = np.zeros(total + 1, dtype=np.int32)  # windows that would leave their text
    np.add.at(step, np.maximum(doc_starts[:-1], ends - LENGTH + 1), 1)
    np.add.at(step, ends, -1)
    blocked = np.cumsum(step[:-1], dtype=np.int32) > 0
    del step
    for c in range(0, total, _CHUNK):
        last = min(total, c + _CHUNK)
        stop = min(total + 4, last + n_kmers + 4)
        key = _order(buf, slice(c, stop))
        key |= np.arange(stop - c, dtype=np.uint64)
        span = 1
        while span * 2 <= n_kmers:
            key = np.minimum(key[:-span], key[span:])
            span *= 2
        if span < n_kmers:
            key = np.minimum(key[: -(n_kmers - span)], key[n_kmers - span :])
        at = np.flatnonzero(~blocked[c:last])
        at = at[at < len(key)]
        if not len(at):
            continue
        p = (key[at] & np.uint64(0xFFFFFF)).astype(np.int64)
        new = np.ones(len(at), dtype=bool)
        new[1:] = (p[1:] != p[:-1]) | (at[1:] != at[:-1] + 1)
        end = np.ones(len(at), dtype=bool)
        end[:-1] = new[1:]
        out.append((at[new] + c, at[end] + c, p[new] + c))
    if not out:
        none = np.empty(0, dtype=np.int64)
        return none, none, none
    a, b, p = (np.concatenate(x) for x in zip(*out, strict=True))
    return a, b, p


def key_hashes(buf: np.ndarray, at: np.ndarray, length: int = SIDE + ANCHOR) -> np.ndarray:
    """Hash of `length` (17 or more) bytes from each position, from all its 8-byte words."""
    eight = _words_at(buf)
    h = np.full(len(at), length, dtype=np.uint64)
    for k in (*range(0, length - 8, 8), length - 8):
        h = _mix((h ^ eight[at + k]) * np.uint64(_BASE))
    return _mix(h * np.uint64(0x94D049BB133111EB))


class Parts:
    """The parts of some documents: kind, first and last window start, anchor, index of the document, and hash of the key."""

    def __init__(self, ids: list, texts: list[bytes]) -> None:
        known = [(i, t) for i, t in zip(ids, texts, strict=True) if i is not None]
        self.ids = np.array([i for i, _ in known], dtype=np.int64)
        self.starts = np.zeros(len(known) + 1, dtype=np.int64)
        np.cumsum([len(t) for _, t in known], out=self.starts[1:])
        self.buf = np.frombuffer(b"".join(t for _, t in known) + bytes(64), dtype=np.uint8)
        first, last, anchor = find_contexts(self.buf, self.starts)
        right, left = anchor - last <= SIDE, anchor - first > SIDE
        self.kind = np.concatenate([np.full(right.sum(), _RIGHT, dtype=np.uint8), np.full(left.sum(), _LEFT, dtype=np.uint8)])
        self.first = np.concatenate([np.maximum(first, anchor - SIDE)[right], first[left]])
        self.last = np.concatenate([last[right], np.minimum(last, anchor - SIDE - 1)[left]])
        self.anchor = np.concatenate([anchor[right], anchor[left]])
        self.key = key_hashes(self.buf, self.anchor - np.where(self.kind == _LEFT, SIDE, 0)) ^ self.kind
        of = np.searchsorted(self.starts, first, side="right") - 1  # first ascends, within either kind
        self.id = self.ids[np.concatenate([of[right], of[left]])]

    def numbered(self, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Distinct keys as (bucket, what is left of the key) in one ascending number; the number of each part's key;
        whether documents of different ids have it; and how many different parts have it (by a hash: this only steers).
        """
        key = (self.key % np.uint64(buckets) << np.uint64(_KEY_BITS)) | (self.key // np.uint64(buckets) & np.uint64((1 << _KEY_BITS) - 1))
        order = np.argsort(key)
        k = key[order]
        new = np.ones(len(k), dtype=bool)
        new[1:] = k[1:] != k[:-1]
        begin = np.flatnonzero(new)
        group = np.cumsum(new) - 1
        number = np.empty(len(k), dtype=np.int64)
        number[order] = group
        many, different = np.zeros(len(begin), dtype=bool), np.ones(len(begin), dtype=np.int64)
        again = np.flatnonzero(~new)  # parts whose key another part has too, and from here on only those
        some = order[np.union1d(again, again - 1)]
        if len(some):
            g, i = number[some], self.id[some]
            many[g[1:][(g[1:] == g[:-1]) & (i[1:] != i[:-1])]] = True
            far = self.last[some] + LENGTH - SIDE - ANCHOR
            whole = key_hashes(self.buf, self.first[some]) + _mix(key_hashes(self.buf, far)) + (far - self.first[some]).astype(np.uint64)
            by = np.lexsort((whole, g))
            g, whole = g[by], whole[by]
            fresh = np.ones(len(g), dtype=bool)
            fresh[1:] = (g[1:] != g[:-1]) | (whole[1:] != whole[:-1])
            different = np.maximum(different, np.bincount(g[fresh], minlength=len(begin)))
        return k[begin], number, many, different


def _say_keys(buckets: int):  # noqa: ANN202
    def say(number: int, texts: tuple) -> list[tuple[int, bytes]]:
        keys, _, many, n = Parts(*texts[:2]).numbered(buckets)
        bucket = (keys >> np.uint64(_KEY_BITS)).astype(np.int64)
        edges = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1], [True]])) if len(keys) else np.zeros(1, dtype=np.int64)
        out = []
        for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
            more = np.flatnonzero(n[a:b] > 1).astype(np.int32)
            rest = keys[a:b] & np.uint64((1 << _KEY_BITS) - 1)
            out.append((int(bucket[a]), B.pack(B.steps(rest), np.packbits(many[a:b]).tobytes(), more.tobytes(), n[a:b][more].astype(np.int32).tobytes())))
        return out

    return say


def _match_keys(hot: int):  # noqa: ANN202
    """For each key of each block: 0 if no other document has it, 1 if one has, 2 if the key is hot."""

    def reply(bodies: list[bytes]) -> list[bytes]:
        keys, many, counts, sizes = [], [], [], []
        for body in bodies:
            raw, bits, more, n = B.unpack(body)
            k = B.from_steps(raw)
            c = np.ones(len(k), dtype=np.int64)
            c[np.frombuffer(more, np.int32)] = np.frombuffer(n, np.int32)
            keys.append(k)
            many.append(np.unpackbits(np.frombuffer(bits, np.uint8), count=len(k)).astype(bool))
            counts.append(c)
            sizes.append(len(k))
        whole = np.concatenate(keys)
        order = np.argsort(whole, kind="stable")  # keys come sorted from each block
        k = whole[order]
        begin = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]]))
        length = np.diff(np.append(begin, len(k)))
        shared = (length > 1) | np.logical_or.reduceat(np.concatenate(many)[order], begin)
        verdict = np.empty(len(k), dtype=np.uint8)
        verdict[order] = np.repeat(shared.astype(np.uint8) + (shared & (np.add.reduceat(np.concatenate(counts)[order], begin) > hot)), length)
        edges = np.cumsum([0, *sizes])
        return [B.pack(verdict[a:b].tobytes()) for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)]

    return reply


def _same_bytes(buf: np.ndarray, a: np.ndarray, b: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Whether `length` bytes (8 at least, _LONGEST at most) from a and from b agree."""
    eight = _words_at(buf)
    same = np.ones(len(a), dtype=bool)
    for k in range(0, _LONGEST, 8):
        at = np.minimum(k, length - 8)
        same &= eight[a + at] == eight[b + at]
        if k and (at < k).all():
            break
    return same


def _leaders(buf: np.ndarray, first: np.ndarray, length: np.ndarray, kind: np.ndarray, place: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """For each stretch the one that stands for it: an equal one of the same kind and place with the least id; bytes are checked.

    A stretch whose hash equals that of others with other bytes stands for itself.
    """
    h = _mix(key_hashes_of(buf, first, length) + (kind.astype(np.uint64) << np.uint64(32)) + place.astype(np.uint64))
    order = np.lexsort((ids, h))
    k = h[order]
    new = np.concatenate([[True], k[1:] != k[:-1]])
    lead = order[np.flatnonzero(new)][np.cumsum(new) - 1]
    fine = (length[order] == length[lead]) & (kind[order] == kind[lead]) & (place[order] == place[lead])
    fine &= _same_bytes(buf, first[order], first[lead], np.minimum(length[order], length[lead]))
    out = np.empty(len(order), dtype=np.int64)
    out[order] = np.where(fine, lead, order)
    return out


def key_hashes_of(buf: np.ndarray, first: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Hash of stretches of LENGTH to _LONGEST bytes: from their length and the 8-byte words that cover them."""
    eight = _words_at(buf)
    h = length.astype(np.uint64)
    for k in range(0, _LONGEST, 8):
        at = np.minimum(k, length - 8)
        h = _mix((h ^ eight[first + at]) * np.uint64(_BASE))
        if k and (at < k).all():
            break
    return h


def _say_parts(buckets: int):  # noqa: ANN202
    """From a block's texts and the verdicts on its keys: the shared parts, by the bucket of their key (or window)."""

    def use(number: int, texts: tuple, answers: list[tuple[int, bytes]]) -> Iterator[pa.RecordBatch]:
        parts = Parts(*texts[:2])
        _, key_number, _, _ = parts.numbered(buckets)
        verdict = np.frombuffer(b"".join(B.unpack(body)[0] for _, body in answers), np.uint8)
        mine = verdict[key_number]
        some, hot = np.flatnonzero(mine == 1), np.flatnonzero(mine == 2)
        n = parts.last[hot] - parts.first[hot] + 1
        windows = np.repeat(parts.first[hot] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        kind = np.concatenate([parts.kind[some], np.full(len(windows), _WINDOW, dtype=np.uint8)])
        first = np.concatenate([parts.first[some], windows])
        size = np.concatenate([parts.last[some] - parts.first[some], np.zeros(len(windows), dtype=np.int64)])
        place = np.concatenate([parts.anchor[some] - parts.first[some], np.zeros(len(windows), dtype=np.int64)])
        ids = np.concatenate([parts.id[some], np.repeat(parts.id[hot], n)])
        if not len(first):
            return
        lead = _leaders(parts.buf, first, size + LENGTH, kind, place, ids)
        key = np.concatenate([parts.key[some], key_hashes(parts.buf, windows, LENGTH)])
        bucket = (key % np.uint64(buckets)).astype(np.int64)
        # occurrences in the order (bucket, leader, place), the leader's attributes once
        occurs = np.lexsort((first, lead, bucket[lead]))
        new = np.concatenate([[True], lead[occurs][1:] != lead[occurs][:-1]])
        heads = lead[occurs][new]
        times = np.diff(np.append(np.flatnonzero(new), len(occurs)))
        edge = np.flatnonzero(np.concatenate([[True], bucket[heads][1:] != bucket[heads][:-1], [True]]))
        upto = np.concatenate([[0], np.cumsum(times)])
        rows = []
        for a, b in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
            h, o = heads[a:b], occurs[upto[a] : upto[b]]
            length = size[h] + LENGTH
            at = np.repeat(first[h] - (np.cumsum(length) - length), length) + np.arange(length.sum())
            later = ids[o] > ids[lead[o]]
            low = int(ids[h].min())
            rows.append((int(bucket[h[0]]), number, B.pack(kind[h], size[h].astype(np.uint8), place[h].astype(np.uint8), low, B.planes((ids[h] - low).view(np.uint64)), B.planes(times[a:b].astype(np.uint64)), B.planes(first[o].astype(np.uint64)), np.packbits(later), parts.buf[at].tobytes())))
        yield B.message_batch(rows)

    return use


class Suffixes:
    """Prefix-polynomial hashes over stretches laid end to end; a suffix is a position, of which 50 bytes count."""

    def __init__(self, buf: np.ndarray, first: np.ndarray, length: np.ndarray) -> None:
        """`buf` holds the stretches (at most _LONGEST bytes each) and padding."""
        self.buf = buf
        total = int(length.sum())
        self.offset = (np.arange(total) - np.repeat(first, length)).astype(np.uint8)
        self.prefix = np.zeros(total + 1, dtype=np.uint64)
        np.cumsum((buf[:total].astype(np.uint64) + np.uint64(1)) * _UP[self.offset], out=self.prefix[1:])

    def common(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Length of the common extension of the suffixes x and y, LENGTH at most, by binary search over hashes."""
        px, py, dx, dy = self.prefix[x], self.prefix[y], _DOWN[self.offset[x]], _DOWN[self.offset[y]]
        agree = lambda k, s: (self.prefix[x[s] + k] - px[s]) * dx[s] == (self.prefix[y[s] + k] - py[s]) * dy[s]
        out = np.full(len(x), LENGTH, dtype=np.int64)
        left = np.flatnonzero(~agree(LENGTH, slice(None)))
        low, high = np.zeros(len(left), dtype=np.int64), np.full(len(left), LENGTH, dtype=np.int64)
        while len(left) and (high - low > 1).any():  # they agree over `low` bytes and not over `high`
            half = (low + high) >> 1
            yes = agree(half, left)
            low, high = np.where(yes, half, low), np.where(yes, high, half)
        out[left] = low
        return out

    def less(self, x: np.ndarray, y: np.ndarray, head_x: np.ndarray, head_y: np.ndarray) -> np.ndarray:
        """Whether suffix x comes before suffix y: by their first 8 bytes (as numbers), or else by the first byte after
        their common extension."""
        out = head_x < head_y
        s = np.flatnonzero(head_x == head_y)
        x, y = x[s], y[s]
        n = self.common(x, y)
        out[s] = (n < LENGTH) & (self.buf[x + np.minimum(n, LENGTH - 1)] < self.buf[y + np.minimum(n, LENGTH - 1)])
        return out

    def compared_bytes(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """-1, 0 or 1 as the LENGTH bytes of x come before, equal or come after those of y."""
        eight = _words_at(self.buf)
        out = np.zeros(len(x), dtype=np.int8)
        left = np.arange(len(x))
        for k in (*range(0, LENGTH - 8, 8), LENGTH - 8):
            a, b = eight[x[left] + k].byteswap(), eight[y[left] + k].byteswap()
            out[left] = np.where(a < b, -1, np.where(a > b, 1, 0))
            left = left[a == b]
        return out

    def sort(self, at: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """An order of the suffixes `at` by (group, bytes), and where in it a class of equal suffixes begins.

        A merge sort from below, all groups at once: a suffix's place in the merged run is its place in its own run and
        the number of suffixes of the other run before it, found by binary search. `group` must ascend.
        """
        n = len(at)
        index = np.arange(n)
        begin = np.concatenate([[True], group[1:] != group[:-1]]) if n else np.zeros(0, dtype=bool)
        start = np.maximum.accumulate(np.where(begin, index, 0))
        size = np.bincount(np.cumsum(begin) - 1)[np.cumsum(begin) - 1] if n else index
        order, width, most = index.copy(), 1, int(size.max()) if n else 0
        head = _words_at(self.buf)[at].byteswap()
        while width < most:
            live = np.flatnonzero(size > width)  # groups that are not one run yet
            r = live - start[live]
            run = r // width
            low = np.minimum((run ^ 1) * width, size[live])
            high = np.minimum(low + width, size[live])
            first, from_ = low.copy(), run & 1 == 1
            mine = order[live]
            todo = np.flatnonzero(low < high)
            while len(todo):
                half = (low[todo] + high[todo]) >> 1
                own, other, right = mine[todo], order[start[live[todo]] + half], from_[todo]
                # of equal suffixes those of the left run stay ahead
                x, y = np.where(right, own, other), np.where(right, other, own)
                before = self.less(at[x], at[y], head[x], head[y]) ^ right
                low[todo] = np.where(before, half + 1, low[todo])
                high[todo] = np.where(before, high[todo], half)
                todo = todo[low[todo] < high[todo]]
            to = start[live] + (run & ~1) * width + (r - run * width) + (low - first)
            merged = order.copy()
            merged[to] = order[live]
            order, width = merged, width * 2
        new = np.ones(n, dtype=bool)
        if n > 1:
            x, y = at[order[:-1]], at[order[1:]]
            inside = ~begin[1:]
            how = self.compared_bytes(x, y)
            new[1:] = ~inside | (how != 0)
            wrong = inside & ((how > 0) | ((how == 0) != (self.common(x, y) == LENGTH)))
            for g in np.unique(start[1:][wrong]).tolist():  # two hashes met: this group is sorted by its bytes
                where = np.arange(g, g + size[g])
                raw = sorted((self.buf[p : p + LENGTH].tobytes(), k) for p, k in zip(at[order[where]].tolist(), order[where].tolist(), strict=True))
                order[where] = [k for _, k in raw]
                new[where] = [True] + [a[0] != b[0] for a, b in zip(raw[1:], raw, strict=False)]
        return order, new


def find_repeats(kind: np.ndarray, size: np.ndarray, place: np.ndarray, least: np.ndarray, text: bytes) -> np.ndarray:
    """For each part a mask: bit j is set if a smaller id than its own has its window j."""
    n = len(kind)
    length = size.astype(np.int64) + LENGTH
    first = np.cumsum(length) - length
    buf = np.frombuffer(text + bytes(64), dtype=np.uint8)
    full = (np.uint64(1) << (size.astype(np.uint64) + np.uint64(1))) - np.uint64(1)
    place = place.astype(np.int64)
    lead = _leaders(buf, first, length, kind, place, least)
    mask = np.where(least > least[lead], full, np.uint64(0))
    ahead = np.flatnonzero(lead == np.arange(n))
    if not len(ahead):
        return mask
    key = key_hashes(buf, first[ahead] + place[ahead] - np.where(kind[ahead] == _LEFT, SIDE, 0)) ^ kind[ahead]
    single = kind[ahead] == _WINDOW
    key[single] = key_hashes(buf, first[ahead[single]], LENGTH)
    order = np.argsort(key, kind="stable")
    k = key[order]
    begin = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]]))
    group = np.repeat(np.arange(len(begin)), np.diff(np.append(begin, len(k))))
    ids = least[ahead[order]]
    some = (np.minimum.reduceat(ids, begin) < np.maximum.reduceat(ids, begin))[group]  # of keys that still have several ids
    mine, group = ahead[order[some]], group[some]
    if not len(mine):
        return mask
    count = size[mine].astype(np.int64) + 1
    before = np.cumsum(count) - count
    owner = np.repeat(np.arange(len(mine)), count)
    nth = np.arange(count.sum()) - before[owner]
    # windows can be equal only if their anchors lie at the same place in them
    together = np.lexsort((place[mine][owner] - nth, group[owner]))
    where = group[owner][together] * LENGTH + (place[mine][owner] - nth)[together]
    at = (first[mine][owner] + nth)[together]
    got, edge = Suffixes(buf, first, length).sort(at, where)
    who = least[mine][owner][together]
    smallest = np.minimum.reduceat(who[got], np.flatnonzero(edge))[np.cumsum(edge) - 1]
    least_of = np.empty(len(at), dtype=np.int64)
    least_of[together[got]] = smallest
    bits = (least_of < least[mine][owner]).astype(np.uint64) << nth.astype(np.uint64)
    mask[mine] |= np.bitwise_or.reduceat(bits, before)
    joined = (lead != np.arange(n)) & (least == least[lead])
    mask[joined] |= mask[lead[joined]]
    return mask


def _compare(bodies: list[bytes]) -> list[bytes | None]:
    """For each block the stretches of its bytes that go, as far as this bucket's windows tell."""
    held = [B.unpack(body) for body in bodies]
    kind, size, place = (np.concatenate([h[c] for h in held]) for c in range(3))
    least = np.concatenate([B.from_planes(h[4]).view(np.int64) + h[3] for h in held])
    times = np.concatenate([B.from_planes(h[5]).astype(np.int64) for h in held])
    places = [B.from_planes(h[6]).astype(np.int64) for h in held]
    occurs = np.concatenate(places)
    later = np.concatenate([np.unpackbits(h[7], count=len(p)).astype(bool) for h, p in zip(held, places, strict=True)])
    mask = find_repeats(kind, size, place, least, b"".join(h[8] for h in held))
    owner = np.repeat(np.arange(len(kind)), times)
    full = (np.uint64(1) << (size.astype(np.uint64) + np.uint64(1))) - np.uint64(1)
    own = np.where(later, full[owner], mask[owner])
    out: list[bytes | None] = []
    upto = np.cumsum([0, *map(len, places)])
    for a, b in zip(upto[:-1].tolist(), upto[1:].tolist(), strict=True):
        some = a + np.flatnonzero(own[a:b])
        if not len(some):
            out.append(None)
            continue
        count = size[owner[some]].astype(np.int64) + 1
        before = np.cumsum(count) - count
        which = np.repeat(np.arange(len(some)), count)
        nth = np.arange(count.sum()) - before[which]
        gone = own[some][which] >> nth.astype(np.uint64) & np.uint64(1) > 0
        out.append(B.pack(*(B.steps(x.astype(np.uint64)) for x in _merged(occurs[some][which[gone]] + nth[gone]))))
    return out


def _merged(windows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of what windows at these places cover."""
    at = np.sort(windows)
    new = np.concatenate([[True], at[1:] > at[:-1] + LENGTH])
    last = np.concatenate([new[1:], [True]])
    return at[new].astype(np.int64), at[last].astype(np.int64) + LENGTH


def _cut_texts(id_name: str):  # noqa: ANN202
    """From a block's texts and the stretches that go: the documents, cut."""

    def use(number: int, texts: tuple, answers: list[tuple[int, bytes]]) -> Iterator[pa.RecordBatch]:
        ids, raw, _ = texts
        starts = np.zeros(len(raw) + 1, dtype=np.int64)  # as in Parts: of documents with an id
        np.cumsum([len(t) if i is not None else 0 for i, t in zip(ids, raw, strict=True)], out=starts[1:])
        change = np.zeros(int(starts[-1]) + 1, dtype=np.int32)
        for _, body in answers:
            first, last = (B.from_steps(x).astype(np.int64) for x in B.unpack(body))
            np.add.at(change, first, 1)
            np.add.at(change, last, -1)
        gone = np.cumsum(change[:-1]) > 0
        out = []
        for k, (i, text) in enumerate(zip(ids, raw, strict=True)):
            mine = gone[starts[k] : starts[k + 1]]
            spans: list[dict] = []
            kept = text
            if mine.any():
                edge = np.flatnonzero(np.diff(np.concatenate([[False], mine, [False]]).astype(np.int8)))
                spans = [{"start": a, "end": b} for a, b in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True)]
                kept = np.frombuffer(text, dtype=np.uint8)[~mine].tobytes()
            out.append((i, len(text), spans, kept))
        columns = list(zip(*out, strict=True))
        span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), span, pa.binary()), strict=True)], names=[id_name, "n_bytes", "spans", "kept"])

    return use


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = B.BLOCK_BYTES, hot: int = HOT) -> DataFrame:
    """id_col (long), n_bytes, spans (start, end in bytes) of removed runs, kept (the remaining bytes), per input row.

    A null text is empty. A row with a null id keeps all its bytes and takes none from others; rows that share an id
    take none from each other. Texts of fewer than 50 bytes have no window; a text longer than `block_bytes` is a block
    of its own. An empty table gives an empty result. Other columns are ignored. The input is read once: its blocks are
    checkpointed, so its partitions and order may change on a retry.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), F.lit(None).cast("boolean").alias("more"))
    blocks = B.make(rows, block_bytes)
    n, at, _ = B.tasks(blocks)
    verdicts = B.in_buckets(B.send(blocks, _say_keys(n)), n, _match_keys(hot))
    parts = B.at_blocks(blocks, verdicts, at, _say_parts(n), B.MESSAGE)
    gone = B.in_buckets(parts, n, _compare)
    schema = T.StructType([T.StructField(id_col, T.LongType()), T.StructField("n_bytes", T.LongType()), T.StructField("spans", T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))), T.StructField("kept", T.BinaryType())])
    return B.at_blocks(blocks, gone, at, _cut_texts(id_col), schema)
