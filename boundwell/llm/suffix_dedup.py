"""Removal of byte strings that occur more than once, with hash-compared suffix sorts.

A byte is removed if a string of `length` bytes over it also starts anywhere else, in the same document or another.

Anchors.  Of the GRAM-byte strings inside each window of `length` bytes the one with the least hash (the leftmost of equals) is
the window's anchor.  Equal windows have equal anchors at the same place, so windows need only be compared where anchors are
equal; one position in about (length - GRAM) / 2 is an anchor.  Anchors whose string occurs once are dropped.

Periodic text.  Anchors of a run with period p stand p apart and are followed by the same bytes.  A run's windows all repeat inside
it, so its bytes are removed where it stands (the period is checked byte by byte), and of its anchors only those of the
first period and window go on, which have every window that the run has: a run of any length sends a bounded number of rows.

Contexts.  All windows of an anchor lie in its context, the bytes from length - GRAM before it to length after it.  Anchors
with equal anchor string and equal context are one class; a class of two or more is removed whole, without moving its text.
What decides there is a BLAKE2b digest of the context's bytes, of which more than 100 bits are kept, beside the 64-bit hash of the
anchor string. One member of each class meets the other classes of its anchor string.

Suffix sort.  These few contexts are laid end to end.  For a range of window offsets the suffixes that begin at the range's last
window are sorted by a mergesort which compares two suffixes by the length of their common extension: a binary search over
prefix polynomial hashes.  Neighbours whose extension reaches the part that all windows of the range share may be equal in some
window, others in none; neighbours that share the range's whole reach are equal in all.  Ranges that are undecided are
halved.  Extensions that decide are verified byte by byte.

An anchor string with more than GROUP classes isn't gathered: its range of offsets is halved, and the contexts are dealt anew by
the bytes that all windows of a half share, again and again until the parts are small.  At the end of the halving the shared bytes are
one whole window, and what still shares them by more than GROUP is equal by its digest.

Rows are told by a 64-bit hash of id and text; hashes that two different rows share are found first, by a second hash, and these rows take
the second one.

Defined results: null text counts as empty; texts shorter than `length` lose nothing; repeated rows (equal id and text) both
lose what repeats, which is all of a long text; null ids are documents of their own; an empty table gives an empty result;
other columns are not read, or carried along by drop_repeats.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from boundwell.llm.bytehash import PrefixHash, U, mix, packed, slices
from boundwell.llm.near_dedup import _bounds, _groups
from boundwell.llm.runtime import apart, cut, free, fresh, parted, release, sieve, sifted, small_batches

LENGTH = 200
#: Bytes of an anchor string, as a part of a window.
GRAM_PART = 4
#: Bytes of a text that are looked at together.
SEGMENT = 1 << 19
#: Classes of one anchor string that a task sorts together: their contexts' prefix hashes take some 30 bytes a byte.
GROUP = 4_096
LARGE = U(2**64 - 1)


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each `width` neighbours."""
    out, have = values, 1
    while have * 2 <= width:
        out = np.minimum(out[:-have], out[have:])
        have *= 2
    rest = width - have
    return np.minimum(out[: len(out) - rest], out[rest:]) if rest else out


def anchor_places(buf: np.ndarray, hashes: PrefixHash, starts: np.ndarray, ends: np.ndarray, length: int) -> np.ndarray:
    """Positions in buf that are the anchor of a window inside one of the texts [starts, ends)."""
    gram = length // GRAM_PART
    wide = length - gram + 1
    n = len(buf) - gram + 1
    if n < wide:
        return np.zeros(0, np.int64)
    place = np.arange(n)
    order = mix(hashes.of(place, place + gram))
    inside = np.zeros(len(buf) + 1, np.int8)
    long = ends - starts >= length
    np.add.at(inside, starts[long], 1)
    np.add.at(inside, ends[long] - length + 1, -1)
    window = np.cumsum(inside[:n], dtype=np.int8).view(bool)[: n - wide + 1]
    found = []
    bits, step = 24, 1 << 23
    for lo in range(0, n - wide + 1, step):
        # The hash's high bits decide, then the place: the leftmost of equals.
        part = order[lo : lo + step + wide - 1]
        key = (part >> U(bits) << U(bits)) | np.arange(len(part), dtype=U)
        least = sliding_min(key, wide)
        found.append(lo + np.unique((least[window[lo : lo + len(least)]] & U((1 << bits) - 1)).astype(np.int64)))
    return np.unique(np.concatenate(found))


def thinned(buf: np.ndarray, hashes: PrefixHash, at: np.ndarray, own: np.ndarray, ends: np.ndarray, length: int) -> tuple[np.ndarray, list[tuple[int, int, int]]]:
    """Which anchors go on, and the runs (text, start, stop in buf) that are periodic and whose other anchors don't."""
    keep, found = np.ones(len(at), bool), []
    if len(at) < 3:
        return keep, found
    a, b, wide = at[:-1], at[1:], length - length // GRAM_PART
    gap = b - a
    link = (own[:-1] == own[1:]) & (gap <= wide) & (b + length <= ends[own[1:]])
    some = np.flatnonzero(link)
    link[some] = hashes.of(a[some], a[some] + length) == hashes.of(b[some], b[some] + length)
    on = link[1:] & link[:-1] & (gap[1:] == gap[:-1])
    first = np.flatnonzero(link & ~np.concatenate(([False], on)))
    last = np.flatnonzero(link & ~np.concatenate((on, [False]))) + 1
    for i, j in zip(first.tolist(), last.tolist(), strict=True):
        start, stop, period = int(at[i]), int(at[j]) + length, int(gap[i])
        inner = at[i : j + 1] > start + period + wide
        if inner[-1] and np.array_equal(buf[start : stop - period], buf[start + period : stop]):
            keep[i : j + 1] &= ~inner
            found.append((int(own[i]), start, stop))
    return keep, found


def segments(texts: list[bytes], length: int) -> Iterator[tuple[np.ndarray, PrefixHash, np.ndarray, np.ndarray, np.ndarray, list[tuple[int, int, int]]]]:
    """Anchors of texts: per buffer, its bytes and hashes, and for each anchor its place in the buffer, text and place in the text; and the periodic runs (text, start, stop).

    Texts beyond SEGMENT come in pieces that overlap enough; an anchor is told in the piece that it begins in.
    """
    pieces: list[tuple[int, int, int, int, bytes]] = []
    for i, text in enumerate(texts):
        if len(text) <= 2 * SEGMENT:
            pieces.append((i, 0, 0, len(text), text))
        else:
            for lo in range(0, len(text), SEGMENT):
                start = max(0, lo - 2 * length)
                pieces.append((i, start, lo, lo + SEGMENT, text[start : lo + SEGMENT + 2 * length]))
    for first, buf, starts, ends in packed([p[4] for p in pieces], SEGMENT):
        hashes = PrefixHash(buf)
        at = anchor_places(buf, hashes, starts, ends, length)
        own = np.searchsorted(starts, at, side="right") - 1
        keep, found = thinned(buf, hashes, at, own, ends, length)
        at, own = at[keep], own[keep]
        info = np.array([p[:4] for p in pieces[first : first + len(starts)]], np.int64).reshape(-1, 4)
        place = at - starts[own] + info[own, 1]
        mine = (place >= info[own, 2]) & (place < info[own, 3])
        moved = [int(info[k, 1] - starts[k]) for k, _, _ in found]
        yield buf, hashes, at[mine], info[own[mine], 0], place[mine], [(int(info[k, 0]), a + m, b + m) for (k, a, b), m in zip(found, moved, strict=True)]


#: h: hash of the anchor string; c, x: digest of its context, of which the low bits of x are the bytes before and from the place; key, pos: the text and the place.
#: A periodic run has h null, its start as pos and its end as c.
ANCHOR = "h long, c long, x long, key long, pos long"


def _reach(length: int) -> tuple[int, int]:
    """Bits of a number of context bytes, and their mask."""
    return length.bit_length(), (1 << length.bit_length()) - 1


def anchor_hashes(docs: DataFrame, length: int) -> DataFrame:
    """(h) of every anchor of docs (text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, texts in slices(batch.column("text"), SEGMENT):
                for _, hashes, at, *_ in segments(texts, length):
                    yield pa.RecordBatch.from_arrays([pa.array(mix(hashes.of(at, at + length // GRAM_PART)).view(np.int64))], ["h"])

    return docs.select("text").mapInArrow(run, "h long")


def anchors(docs: DataFrame, length: int) -> DataFrame:
    """ANCHOR rows of docs (key, text)."""
    bits, _ = _reach(length)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        back = length - length // GRAM_PART
        names = ["h", "c", "x", "key", "pos"]
        for batch in batches:
            for first, texts in slices(batch.column("text"), SEGMENT):
                sizes = np.array([len(t) for t in texts], np.int64)
                key = batch.column("key").slice(first, len(texts)).to_numpy()
                for buf, hashes, at, own, place, runs_ in segments(texts, length):
                    l, r = np.minimum(place, back), np.minimum(sizes[own] - place, length)
                    h = mix(hashes.of(at, at + length // GRAM_PART))
                    c, x = context_digests(buf, at - l, at + r).T
                    x = (x >> U(2 * bits) << U(2 * bits)) | ((l << bits) | r).astype(U)
                    yield pa.RecordBatch.from_arrays([*(pa.array(np.ascontiguousarray(v).view(np.int64)) for v in (h, c, x)), pa.array(key[own]), pa.array(place)], names)
                    if runs_:
                        text, start, stop = np.array(runs_, np.int64).T
                        yield pa.RecordBatch.from_arrays([pa.nulls(len(text), pa.int64()), pa.array(stop), pa.array(stop), pa.array(key[text]), pa.array(start)], names)

    return docs.select("key", "text").mapInArrow(run, ANCHOR)


def context_digests(buf: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """BLAKE2b digests of slices of buf, as two words each."""
    view, digest = memoryview(buf), hashlib.blake2b
    data = b"".join([digest(view[a:b], digest_size=16).digest() for a, b in zip(start.tolist(), stop.tolist(), strict=True)])
    return np.frombuffer(data, "<u8").reshape(-1, 2)


class Suffixes:
    """Suffixes of a buffer, compared by common extensions."""

    def __init__(self, buf: np.ndarray) -> None:
        self.buf, self.hashes = buf, PrefixHash(buf, seed=3)

    def extension(self, a: np.ndarray, b: np.ndarray, limit: np.ndarray) -> np.ndarray:
        """Length of the common extension of the suffixes at a and b, up to limit: a binary search over hashes."""
        out = limit.astype(np.int64)
        part = np.flatnonzero(self.hashes.of(a, a + out) != self.hashes.of(b, b + out))
        a, b, hi = a[part], b[part], out[part] - 1
        lo = np.zeros(len(part), np.int64)
        while (lo < hi).any():
            mid = (lo + hi + 1) // 2
            same = self.hashes.of(a, a + mid) == self.hashes.of(b, b + mid)
            lo, hi = np.where(same, mid, lo), np.where(same, hi, np.maximum(mid - 1, lo))
        out[part] = lo
        return out

    def less(self, a: np.ndarray, b: np.ndarray, limit: np.ndarray) -> np.ndarray:
        """Whether the suffix at a is less than that at b, within limit bytes."""
        n = self.extension(a, b, limit)
        x, y = self.buf[np.minimum(a + n, len(self.buf) - 1)], self.buf[np.minimum(b + n, len(self.buf) - 1)]
        return (n < limit) & (x < y)

    def verified(self, a: np.ndarray, b: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Whether n bytes from a and from b are the same, byte by byte."""
        out = np.ones(len(a), bool)
        for lo in range(0, len(a), 4096):
            s = slice(lo, lo + 4096)
            step = np.arange(int(n[s].max(initial=0)))
            inside = step[None, :] < n[s, None]
            last = len(self.buf) - 1
            x, y = (self.buf[np.minimum(v[s, None] + step[None, :], last)] for v in (a, b))
            out[s] = ((x == y) | ~inside).all(1)
        return out

    def order(self, group: np.ndarray, at: np.ndarray, limit: np.ndarray) -> np.ndarray:
        """The order of the suffixes at `at` within each group (ascending), by bottom-up mergesort; limit is one value a group."""
        order = np.arange(len(at))
        bounds = np.flatnonzero(np.diff(group, prepend=group[0] - 1, append=group[-1] + 1)) if len(group) else np.zeros(1, np.int64)
        begin, size = np.repeat(bounds[:-1], np.diff(bounds)), np.repeat(np.diff(bounds), np.diff(bounds))
        width = 1
        while len(active := np.flatnonzero(size > width)):
            # Each element's place in the merged run is its own place in its run and its rank in the other.
            local = active - begin[active]
            run = local // width
            other = begin[active] + (run ^ 1) * width
            stop = np.minimum(other + width, begin[active] + size[active])
            lo, hi = np.minimum(other, stop), stop.copy()
            first, top = lo.copy(), run % 2 == 0
            x = order[active]
            # Only elements that still search are compared: the others' places may be in a group with another limit.
            while len(open_ := np.flatnonzero(lo < hi)):
                mid = (lo[open_] + hi[open_]) // 2
                own, y, up = x[open_], order[mid], top[open_]
                # Left elements go before equal ones of the right run, right elements after.
                before = self.less(at[np.where(up, y, own)], at[np.where(up, own, y)], limit[own]) == up
                lo[open_], hi[open_] = np.where(before, mid + 1, lo[open_]), np.where(before, hi[open_], mid)
            pair = begin[active] + (run // 2) * 2 * width
            place = pair + local % width + (lo - first)
            merged = order.copy()
            merged[place] = x
            order = merged
            width *= 2
        return order

    def classes(self, group: np.ndarray, at: np.ndarray, need: np.ndarray, verify: bool) -> np.ndarray:
        """A class number for each suffix: equal for those of a group whose first `need` bytes (one value a group) are equal."""
        if not len(at):
            return np.zeros(0, np.int64)
        order = self.order(group, at, need)
        a, b = order[:-1], order[1:]
        near = group[a] == group[b]
        same = near.copy()
        x, y, n = at[a[near]], at[b[near]], need[a[near]]
        same[near] = self.hashes.of(x, x + n) == self.hashes.of(y, y + n)
        if verify:
            same[same] = self.verified(at[a[same]], at[b[same]], need[a[same]])
        out = np.empty(len(at), np.int64)
        out[order] = np.concatenate(([0], np.cumsum(~same)))
        return out


def _several(group: np.ndarray, valid: np.ndarray) -> np.ndarray:
    """Whether a valid row's group has another valid row."""
    _, inverse, n = np.unique(group, return_inverse=True, return_counts=True)
    n = np.bincount(inverse, weights=valid, minlength=len(n))
    return valid & (n[inverse] > 1)


def matched(suffixes: Suffixes, group: np.ndarray, at: np.ndarray, l: np.ndarray, r: np.ndarray, length: int, low: np.ndarray | None = None, high: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """For anchors at `at` (with l bytes before and r from there): the least and the greatest offset d of a window from at - d that another of the group has too; (length, -1): none.

    low, high: the range of offsets, one a group; all if not given. A range is tried as a whole; what it leaves open is halved. Rows of one group stand together.
    """
    least, greatest = np.full(len(at), length), np.full(len(at), -1)
    wide, n = length - length // GRAM_PART, len(at)
    low, high = (np.zeros(n, np.int64) if low is None else low), (np.full(n, wide) if high is None else high)
    # The whole range is not tried: its windows share the anchor string, which is equal, and its reach is the context, which is not.
    mid = np.where(high - low == wide, wide // 2, high)
    two = np.flatnonzero(mid < high)
    row, quiet = np.concatenate((np.arange(n), two)), np.zeros(n + len(two), bool)
    lo, hi = np.concatenate((low, mid[two] + 1)), np.concatenate((mid, high[two]))
    node = np.concatenate((2 * group, 2 * group[two] + 1)).astype(np.int64)
    while len(row):
        # Rows with a window in the range.
        ok = (l[row] >= lo) & (r[row] >= length - hi)
        row, lo, hi, node, quiet = (x[ok] for x in (row, lo, hi, node, quiet))
        if not len(row):
            break
        order = np.argsort(node, kind="stable")
        row, lo, hi, node, quiet = (x[order] for x in (row, lo, hi, node, quiet))
        # What all windows of the range share begins at the last one's end of it.
        shared = suffixes.classes(node, at[row] - lo, length - (hi - lo), False)
        open_ = _several(shared, np.ones(len(row), bool))
        # A class without a row that still asks is done with.
        ask = np.bincount(shared, weights=~quiet, minlength=int(shared.max()) + 1)[shared] > 0
        open_ &= ask
        row, lo, hi, shared, quiet = (x[open_] for x in (row, lo, hi, shared, quiet))
        if not len(row):
            break
        order = np.argsort(shared, kind="stable")
        row, lo, hi, shared, quiet = (x[order] for x in (row, lo, hi, shared, quiet))
        whole = (l[row] >= hi) & (r[row] >= length - lo)
        reach = np.arange(len(row)) + int(shared.max()) + 1  # rows without the whole reach stay alone
        part = np.flatnonzero(whole)
        if len(part):
            reach[part] = suffixes.classes(shared[part], at[row[part]] - hi[part], length + (hi - lo)[part], True)
        done = _several(reach, whole)
        np.minimum.at(least, row[done], lo[done])
        np.maximum.at(greatest, row[done], hi[done])
        # Of rows that are equal in the whole range one goes on, for the others to be compared with.
        keep = ~done
        _, one = np.unique(np.where(done, reach, -1), return_index=True)
        keep[one] = True
        quiet = quiet | done
        keep &= lo < hi
        row, lo, hi, shared, quiet = (x[keep] for x in (row, lo, hi, shared, quiet))
        mid = (lo + hi) // 2
        row, quiet = np.concatenate((row, row)), np.concatenate((quiet, quiet))
        node = np.concatenate((2 * shared, 2 * shared + 1))
        lo, hi = np.concatenate((lo, mid + 1)), np.concatenate((mid, hi))
    return least, greatest


SPAN = "key long, start long, stop long"


def _spans(key: np.ndarray, start: np.ndarray, stop: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(key.astype(np.int64)), pa.array(start.astype(np.int64)), pa.array(stop.astype(np.int64))], ["key", "start", "stop"])


def _sort_contexts(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows (h, lo, hi, key, pos, l, alone, context), a group's together: spans of the rows that are alone in their class."""
        for table in _groups(batches, 3):
            key, pos, l, lo, hi = (table.column(c).to_numpy().astype(np.int64) for c in ("key", "pos", "l", "lo", "hi"))
            bounds = _bounds(table, 3)
            group = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
            context = table.column("context").to_pylist()
            size = np.array([len(c) for c in context], np.int64)
            buf = np.frombuffer(b"".join(context) + bytes(1), np.uint8)
            begin = np.cumsum(size) - size
            least, greatest = matched(Suffixes(buf), group, begin + l, l, size - l, length, lo, hi)
            hit = (greatest >= 0) & table.column("alone").to_numpy(zero_copy_only=False)
            yield _spans(key[hit], pos[hit] - greatest[hit], pos[hit] - least[hit] + length)

    return run


MEMBER = "h long, g long, lo int, hi int, key long, pos long, l int, alone boolean, context binary"


def _halved(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """MEMBER rows to those of the halves of their ranges: h and g are a digest of the range and the bytes that its windows share."""
        for batch in batches:
            h, lo, hi, l = (batch.column(c).to_numpy().astype(np.int64) for c in ("h", "lo", "hi", "l"))
            context = batch.column("context").to_pylist()
            mid = (lo + hi) // 2
            rows, ranges, marks = [], [], []
            for i, data in enumerate(context):
                for a, b in ((int(lo[i]), int(mid[i])), (int(mid[i]) + 1, int(hi[i]))):
                    if a <= b and l[i] >= a and len(data) - l[i] >= length - b:
                        shared = data[int(l[i]) - a : int(l[i]) - b + length]
                        rows.append(i)
                        ranges.append((a, b))
                        marks.append(hashlib.blake2b(b"%d %d %d " % (h[i], a, b) + shared, digest_size=16).digest())
            mark = np.frombuffer(b"".join(marks), "<i8").reshape(-1, 2)
            part = batch.take(pa.array(rows, pa.int64()))
            new = {"h": pa.array(np.ascontiguousarray(mark[:, 0])), "g": pa.array(np.ascontiguousarray(mark[:, 1])), "lo": pa.array([r[0] for r in ranges], pa.int32()), "hi": pa.array([r[1] for r in ranges], pa.int32())}
            yield pa.RecordBatch.from_arrays([new.get(n, part.column(n)) for n in part.schema.names], part.schema.names)

    return run


def _small_groups(members: DataFrame, length: int) -> tuple[list[DataFrame], DataFrame | None]:
    """Tables of MEMBER rows whose groups have at most GROUP rows, from groups with more; and the spans of rows that agree in a whole window."""
    small, whole = [], None
    while members.limit(1).count():
        dealt = cut(members.mapInArrow(_halved(length), MEMBER))
        sizes = dealt.groupBy("h", "g", "lo", "hi").agg(F.count("*").alias("n")).where("n > 1").select(apart("h").alias("_h"), F.col("g").alias("_g"), F.col("lo").alias("_lo"), F.col("hi").alias("_hi"), "n")
        same = [F.col(c) == F.col("_" + c) for c in ("h", "g", "lo", "hi")]
        sized = cut(dealt.join(sizes.hint("shuffle_merge"), same).select(*dealt.columns, "n"))
        small.append(sized.where(F.col("n") <= GROUP).drop("n"))
        large = sized.where(F.col("n") > GROUP)
        equal = large.where("lo = hi and alone").select("key", (F.col("pos") - F.col("lo")).alias("start"), (F.col("pos") - F.col("lo") + length).alias("stop"))
        whole = equal if whole is None else whole.unionByName(equal)
        members = large.where("lo < hi").drop("n")
    return small, whole


def repeated_spans(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """key, spans (sorted, disjoint and not touching) of every text with repeated bytes. docs: key (long, one for each distinct row), text."""
    small_batches(docs.sparkSession)
    bits, mask = _reach(length)
    wide = length - length // GRAM_PART
    often = anchor_hashes(docs, length).groupBy("h").agg(F.count("*").alias("n")).where("n > 1").select(apart("h").alias("_h"))
    # Periodic runs, which have no h, stay.
    again = cut(anchors(docs, length).join(often.hint("shuffle_merge"), F.col("h") == F.col("_h"), "left").where("h is null or _h is not null").drop("_h"))
    release(docs.sparkSession)
    runs_ = again.where("h is null").select("key", F.col("pos").alias("start"), F.col("c").alias("stop"))
    placed = again.where("h is not null")
    classes = cut(placed.groupBy("h", "c", "x").agg(F.count("*").alias("n"), F.min(F.struct("key", "pos")).alias("y")))
    twins = classes.where("n > 1").select(apart("h").alias("_h"), F.col("c").alias("_c"), F.col("x").alias("_x"))
    same = (F.col("h") == F.col("_h")) & (F.col("c") == F.col("_c")) & (F.col("x") == F.col("_x"))
    before, after = F.shiftright("x", bits).bitwiseAND(F.lit(mask)), F.col("x").bitwiseAND(F.lit(mask))
    whole = placed.join(twins.hint("shuffle_merge"), same).select("key", (F.col("pos") - before).alias("start"), (F.col("pos") + after).alias("stop"))
    groups = classes.groupBy("h").agg(F.count("*").alias("classes"), F.min("n").alias("fewest")).where("classes > 1 and fewest = 1").select(apart("h").alias("_h"), "classes")
    mixed = classes.join(groups.hint("shuffle_merge"), F.col("h") == F.col("_h")).select("h", "n", "classes", "y.*", before.cast("int").alias("l"))
    contexts = cut(_contexts(docs, mixed, length))
    release(docs.sparkSession)
    all_ = contexts.withColumns({"g": F.lit(0).cast("long"), "lo": F.lit(0), "hi": F.lit(wide)}).select("classes", *(c.split()[0] for c in MEMBER.split(", ")))
    parts, equal = _small_groups(all_.where(F.col("classes") > GROUP).drop("classes"), length)
    few = all_.where(F.col("classes") <= GROUP).drop("classes")
    for p in parts:
        few = few.unionByName(p)
    dealt = few.select("h", "lo", "hi", "key", "pos", "l", "alone", "context").repartition("h", "lo", "hi").sortWithinPartitions("h", "lo", "hi", "key", "pos")
    spans = whole.unionByName(runs_).unionByName(dealt.mapInArrow(_sort_contexts(length), SPAN))
    if equal is not None:
        spans = spans.unionByName(equal)
    gathered = spans.distinct().groupBy("key").agg(F.array_sort(F.collect_list(F.struct("start", "stop"))).alias("all"))

    # A text has at most a span for each of its anchors, of which a periodic run has few, so its list is bounded by its own length.
    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))
        for batch in batches:
            out = []
            for spans_ in batch.column("all").to_pylist():
                merged: list[dict] = []
                for s in spans_:
                    if merged and s["start"] <= merged[-1]["stop"]:
                        merged[-1]["stop"] = max(merged[-1]["stop"], s["stop"])
                    else:
                        merged.append(dict(s))
                out.append(merged)
            yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(out, kind)], ["key", "spans"])

    out = cut(gathered.mapInArrow(merge, "key long, spans array<struct<start:long,stop:long>>"))
    free(again, classes, contexts)
    release(docs.sparkSession)
    return out


#: Contexts that are told in one batch.
CONTEXT_ROWS = 5000


def _contexts(docs: DataFrame, members: DataFrame, length: int) -> DataFrame:
    """The members' contexts, read from the texts. members: h, n, classes, key, pos, l."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, text, asked in zip(batch.column("key").to_pylist(), batch.column("text"), batch.column("asked"), strict=True):
                data = (text.as_py() or "").encode()
                table = pa.RecordBatch.from_struct_array(asked.values)
                for first in range(0, table.num_rows, CONTEXT_ROWS):
                    part = table.slice(first, CONTEXT_ROWS)
                    pos, l = (part.column(c).to_numpy() for c in ("pos", "l"))
                    context = [data[p - k : p + length] for p, k in zip(pos.tolist(), l.tolist(), strict=True)]
                    alone = pa.array(part.column("n").to_numpy() == 1)
                    yield pa.RecordBatch.from_arrays([part.column("h"), part.column("classes"), pa.array(np.full(len(pos), key)), part.column("pos"), part.column("l"), alone, pa.array(context, pa.binary())], ["h", "classes", "key", "pos", "l", "alone", "context"])

    asked = cut(members.groupBy(F.col("key").alias("_key")).agg(F.collect_list(F.struct("h", "n", "classes", "pos", "l")).alias("asked")))
    # Repeated rows have one key and one text.
    some = sifted(docs, "key", sieve(asked.select(F.col("_key").alias("key")), "key"))
    joined = some.join(asked.hint("shuffle_merge"), F.col("key") == F.col("_key")).dropDuplicates(["key"]).select("key", "text", "asked")
    return joined.mapInArrow(run, "h long, classes long, key long, pos long, l int, alone boolean, context binary")


def _hashes(doc_id: Column, text: Column) -> tuple[Column, Column]:
    return F.xxhash64(doc_id, text), F.xxhash64(F.lit(1), text, doc_id)


def row_key(docs: DataFrame, id_col: str, text_col: str) -> Column:
    """A 64-bit key of each distinct row (id, text), as an expression.

    The few hashes that two different rows share, about n * n / 2**65 of n rows, are looked up beforehand.
    """
    first, second = _hashes(F.col(id_col), F.coalesce(F.col(text_col), F.lit("")))
    pairs = docs.select(first.alias("a"), second.alias("b")).groupBy("a").agg(F.min("b").alias("low"), F.max("b").alias("high"))
    shared = [r["a"] for r in pairs.where("low <> high").select("a").collect()]
    return F.when(first.isin(shared), second).otherwise(first) if shared else first


def _cut_out(data: bytes, spans: list[dict] | None) -> bytes:
    at, parts = 0, []
    for s in spans or ():
        parts.append(data[at : s["start"]])
        at = s["stop"]
    return b"".join([*parts, data[at:]])


def suffix_dedup(docs: DataFrame, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans."""
    key = row_key(docs, id_col, text_col)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), key.alias("key"))
    spans = repeated_spans(rows.select("key", "text"), length).withColumnRenamed("key", "_key")
    # Only texts that lose something meet their spans.
    inside, outside = parted(rows, "key", sieve(spans.select(F.col("_key").alias("key")), "key"))
    met = inside.join(spans.hint("shuffle_merge"), F.col("key") == F.col("_key"), "left").select("doc_id", "text", "spans")
    joined = met.unionByName(outside.select("doc_id", "text", F.lit(None).cast(spans.schema["spans"].dataType).alias("spans")))
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, removed, count, sha = [], [], [], []
            for text, spans_ in zip(batch.column("text"), batch.column("spans").to_pylist(), strict=True):
                data = text.as_py().encode()
                kept = _cut_out(data, spans_)
                n.append(len(data))
                removed.append(len(data) - len(kept))
                count.append(len(spans_ or ()))
                sha.append(hashlib.sha256(kept).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(count, pa.int64()), pa.array(sha, pa.string()), batch.column("spans")], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans"])

    return joined.mapInArrow(run, f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<struct<start:long,stop:long>>")


def drop_repeats(docs: DataFrame, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text", size_col: str | None = "n_chars") -> DataFrame:
    """The documents without their repeated bytes, with all their columns; size_col, if there is one, is the new number of characters.

    A character of which a part is removed goes with it. Documents stay, even with an empty text.
    """
    expr = row_key(docs, id_col, text_col)
    spans = repeated_spans(docs.select(expr.alias("key"), F.coalesce(F.col(text_col), F.lit("")).alias("text")), length)
    key, found = fresh(docs, "key"), fresh(docs, "spans")
    full = docs.withColumn(key, expr)
    removed = spans.select(F.col("key").alias(fresh(full, "span_key")), F.col("spans").alias(found))
    inside, outside = parted(full, key, sieve(removed, removed.columns[0]))
    met = inside.join(removed.hint("shuffle_merge"), inside[key] == removed[removed.columns[0]], "left").select(*docs.columns, found)
    joined = met.unionByName(outside.select(*docs.columns, F.lit(None).cast(spans.schema["spans"].dataType).alias(found)))
    k = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t if not s else _cut_out(t.encode(), s).decode("utf-8", "ignore") for t, s in zip(batch.column(k).to_pylist(), batch.column(batch.num_columns - 1).to_pylist(), strict=True)]
            columns = [batch.column(i) for i in range(batch.num_columns - 1)]
            columns[k] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays(columns, batch.schema.names[:-1])

    out = joined.mapInArrow(run, docs.schema)
    if size_col in docs.columns:
        out = out.withColumn(size_col, F.length(text_col).cast(docs.schema[size_col].dataType))
    return out.select(docs.columns)
