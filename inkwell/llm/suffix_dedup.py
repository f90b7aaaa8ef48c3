"""Exact substring de-duplication by suffix arrays.

Every byte is removed that lies in a ``WINDOW``-byte string which also starts in
a document with a smaller id. Suffix arrays of whole shards would have to meet
pair by pair; instead shards are cut by content. The ``GRAM``-byte string of the
smallest hash in a window is its anchor, so equal windows have equal anchors.
Documents are packed into batches; anchors that lie in two documents are found
from sorted hashes of batches, and only around those is text moved, to the
shard of the anchor's hash, where all windows equal to it come too. A batch
sends each different context once, with the smallest id that has it.

A shard builds suffix arrays over units of anchor contexts by Larsson-Sadakane
refinement (groups of equal prefixes are split by the rank of what follows, at
doubled depth), takes common prefixes by Kasai's rule, stepping through all
contexts at once, and reads runs of equal windows off them. Units of one shard
are merged by binary search of each unit's windows in the others' order.
An anchor with more than ``HOT`` occurrences could fill a task: its contexts are
cut into their windows, which go to shards by their own content, each different
one once a batch; there the same suffix arrays decide.

Equal texts are settled first, by their digest: all but the one with the
smallest id go wholly.

Defined cases: a null text counts as empty; texts below WINDOW bytes lose
nothing; rows with a null id neither lose bytes nor take them from others;
repeated rows of one id are judged each, and never remove each other; a text of
any length is one document, whose anchors and contexts are taken step by step;
an empty table gives an empty result; extra columns are ignored by
``removal_report`` and kept by ``remove_repeats``. Ids are integers.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._io import discard, durable, text_blocks
from ._text import U, mix, powers, prefix_sums, BASE_INV

WINDOW, GRAM = 50, 24
#: Windows that hold one anchor, and bytes around it that they reach.
SPREAD = WINDOW - GRAM + 1
CONTEXT = 2 * WINDOW - GRAM
#: Least and most bytes of text in a batch, between which it is one hundred-thousandth of the table; a longer text is a batch of its own.
BATCH_BYTES, MOST_BATCH_BYTES = 8 << 20, 64 << 20
#: Bytes of text for each shard of contexts, and for each part of the hashes, which are much smaller; a small table is cut into up to ``LEAST_PARTS``.
SHARD_BYTES, PART_BYTES = 4 << 20, 64 << 20
LEAST_PARTS, LEAST_BYTES = 256, 256 << 10
#: A part's number and a hash of 40 bits are one sort key.
MOST_PARTS = 1 << 23
#: Windows whose anchors are looked for in one step.
STEP = 1 << 20
STEP_BITS = U(21)
#: Contexts in one suffix array.
UNIT = 16_384
HOT = 1 << 16
SPOT = np.dtype([("id", "<i8"), ("lo", "u1"), ("hi", "u1"), ("ctx", "u1", (CONTEXT,))])
OFFSETS = np.arange(SPREAD)
BITS = OFFSETS.astype(np.uint32)


def anchors(data: np.ndarray, offs: np.ndarray, step: int = STEP) -> tuple[np.ndarray, np.ndarray]:
    """(position, 64-bit hash) of the anchors of all windows of a block, in steps of so many windows."""
    long_ = np.diff(offs) >= WINDOW
    first, last = offs[:-1][long_], offs[1:][long_] - WINDOW + 1  # bounds of where windows begin
    found: list[tuple[np.ndarray, np.ndarray]] = []
    for at in range(0, max(len(data) - WINDOW + 1, 0), step):
        part = data[at : at + step + WINDOW - 1]
        n = len(part) - WINDOW + 1
        prefix = prefix_sums(part.astype(U) + U(1))
        grams = mix((prefix[GRAM:] - prefix[:-GRAM]) * powers(BASE_INV, len(prefix))[: len(prefix) - GRAM])
        low, width = (grams >> STEP_BITS << STEP_BITS) | np.arange(len(grams), dtype=U), 1  # the leftmost of equal hashes
        while 2 * width <= SPREAD:
            low = np.minimum(low[:-width], low[width:])
            width *= 2
        low = np.minimum(low[: len(low) - (SPREAD - width)], low[SPREAD - width :])
        inside = np.zeros(n + 1, np.int32)
        i, j = np.searchsorted(last, at, "right"), np.searchsorted(first, at + n)
        np.add.at(inside, np.maximum(first[i:j] - at, 0), 1)
        np.add.at(inside, np.minimum(last[i:j] - at, n), -1)
        starts = np.flatnonzero(np.cumsum(inside)[:n] > 0)
        used = np.zeros(len(grams), bool)
        used[(low[starts] & ((U(1) << STEP_BITS) - U(1))).astype(np.int64)] = True
        pos = np.flatnonzero(used)
        found.append((pos + at, grams[pos]))
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, U)
    pos, once = np.unique(np.concatenate([p for p, _ in found]), return_index=True)  # two steps may share an anchor
    return pos, np.concatenate([g for _, g in found])[once]


def contexts(data: np.ndarray, offs: np.ndarray, ids: np.ndarray, pos: np.ndarray, padded: np.ndarray | None = None) -> np.ndarray:
    """SPOT records: the bytes around each anchor, and which windows in them lie within the document. ``padded`` is ``pad(data)``, if it is at hand."""
    out = np.zeros(len(pos), SPOT)
    doc = np.searchsorted(offs, pos, "right") - 1
    begin = pos - (SPREAD - 1)
    low, high = offs[doc] - begin, offs[doc + 1] - begin
    ctx = np.lib.stride_tricks.sliding_window_view(pad(data) if padded is None else padded, CONTEXT)[pos]
    edge = np.flatnonzero((low > 0) | (high < CONTEXT))
    column = np.arange(CONTEXT)
    ctx[edge] = np.where((column >= low[edge, None]) & (column < high[edge, None]), ctx[edge], 0)
    out["ctx"], out["id"] = ctx, ids[doc]
    out["lo"] = np.clip(low, 0, SPREAD)
    out["hi"] = np.clip(high - WINDOW + 1, 0, SPREAD)
    return out


def pad(data: np.ndarray) -> np.ndarray:
    """A block with room for a context before its first and behind its last byte."""
    return np.concatenate([np.zeros(SPREAD - 1, np.uint8), data, np.zeros(CONTEXT, np.uint8)])


def column_hash(columns: np.ndarray, seed: np.ndarray | int = 0) -> np.ndarray:
    """64-bit hash of each row of a byte table, 8 bytes at a time."""
    n, k = columns.shape
    wide = np.zeros((n, -(-k // 8) * 8), np.uint8)
    wide[:, :k] = columns
    acc = np.full(n, 0x9E3779B97F4A7C15, U) + np.asarray(seed).astype(U)
    for word in wide.view("<u8").T:
        acc = (acc + word + U(1)) * U(0xD1342543DE82EF95)
        acc ^= acc >> U(29)
    return mix(acc)


def distinct(spots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(rows of the different contexts, each the one with the smallest id; for each record the number of its context)."""
    if not len(spots):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    same = column_hash(spots["ctx"], spots["lo"].astype(np.int64) * 64 + spots["hi"])
    alike = lambda a, b: (a["ctx"] == b["ctx"]).all(1) & (a["lo"] == b["lo"]) & (a["hi"] == b["hi"])
    for hashed in (True, False):
        order = np.lexsort((spots["id"], same))
        new = np.ones(len(order), bool)
        new[1:] = same[order][1:] != same[order][:-1]
        first = order[new]
        number = np.empty(len(spots), np.int64)
        number[order] = np.cumsum(new) - 1
        if not hashed or alike(spots, spots[first][number]).all():
            return first, number
        same = np.unique(np.ascontiguousarray(spots[["lo", "hi", "ctx"]]).astype([("lo", "u1"), ("hi", "u1"), ("ctx", "u1", (CONTEXT,))]).view(f"V{CONTEXT + 2}"), return_inverse=True)[1].ravel()  # unequal contexts of one hash
    raise AssertionError


def suffix_array(text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order and ranks of the suffixes [context, offset < SPREAD], compared on their first WINDOW bytes.

    Ranks of 8 bytes are refined to 16, 32 and WINDOW bytes: a suffix is placed by its own
    rank and that of the suffix where its known prefix ends. A group of one is settled and
    leaves the sorting.
    """
    n = len(text)
    width = CONTEXT - 8 + 1
    key = np.zeros((n, width), U)
    for b in range(8):
        key = key << U(8) | text[:, b : b + width].astype(U)
    rank = np.unique(key.ravel(), return_inverse=True)[1].reshape(n, width).astype(np.int64)
    depth = 8
    while depth < WINDOW:
        step = min(depth, WINDOW - depth)
        width -= step
        first, then = rank[:, :width], rank[:, step : step + width]
        flat = first.ravel()
        size = np.bincount(flat)
        start = np.cumsum(size) - size
        rank = start[flat]  # ranks are first places, which leave room for the splits
        open_ = np.flatnonzero(size[flat] > 1)
        if len(open_):
            order = open_[np.lexsort((then.ravel()[open_], flat[open_]))]
            f, t = flat[order], then.ravel()[order]
            new = np.ones(len(order), bool)
            new[1:] = f[1:] != f[:-1]
            place = np.arange(len(order)) - np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))
            new[1:] |= t[1:] != t[:-1]
            head = np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))
            rank[order] = start[f] + place[head]
        rank = rank.reshape(n, width)
        depth += step
    flat = rank.ravel()
    return np.argsort(flat, kind="stable"), flat


def common_prefixes(text: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Bytes, up to WINDOW, that each suffix shares with the one before it in the order.

    Kasai's rule over all contexts at once: if the neighbour's next suffix also comes before
    this one's, the next suffix of a context shares at least one byte less with its neighbour
    than this one did, so the comparison goes on from there.
    """
    n = len(text)
    before = np.full(n * SPREAD, -1, np.int64)
    before[order[1:]] = order[:-1]
    before = before.reshape(n, SPREAD)
    place = np.empty(n * SPREAD, np.int64)
    place[order] = np.arange(n * SPREAD)
    out = np.zeros((n, SPREAD), np.int16)
    flat = text.ravel()
    have = np.zeros(n, np.int64)
    row = np.arange(n) * CONTEXT
    for o in range(SPREAD):
        b = before[:, o]
        other = np.where(b < 0, 0, b // SPREAD * CONTEXT + b % SPREAD)
        if o:
            last = before[:, o - 1]
            follows = (last >= 0) & (last % SPREAD < SPREAD - 1)
            follows &= place[np.where(follows, last + 1, 0)] < place[np.arange(n) * SPREAD + o]
            have = np.where((b >= 0) & follows, np.maximum(have - 1, 0), 0)
        live = np.flatnonzero(b >= 0)
        while len(live):
            same = flat[row[live] + o + have[live]] == flat[other[live] + have[live]]
            live = live[same]
            have[live] += 1
            live = live[have[live] < WINDOW]
        out[:, o] = have
    return out


def _runs(text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order of the suffixes, number of its run of equal windows for each place)."""
    order, _ = suffix_array(text)
    lcp = common_prefixes(text, order).ravel()[order]
    return order, np.cumsum(lcp < WINDOW) - 1


def repeated_windows(spots: np.ndarray, unit: int = UNIT) -> np.ndarray:
    """For each SPOT record, bits of the windows that a record with a smaller id holds too."""
    valid = valid_windows(spots)
    far = np.iinfo(np.int64).max
    parts = []
    for i in range(0, len(spots), unit):
        text = np.ascontiguousarray(spots["ctx"][i : i + unit])
        order, run = _runs(text)
        ids = np.where(valid[i : i + unit], spots["id"][i : i + unit, None], far).ravel()[order]
        head = np.flatnonzero(np.diff(run, prepend=-1))
        least = np.minimum.reduceat(ids, head)
        parts.append((i, text, order, run, head, least))
    if len(parts) > 1:  # merge the units: each one's windows are looked up in the others' order
        words = []
        for _, text, order, _, head, _ in parts:
            at = order[head]
            win = np.lib.stride_tricks.sliding_window_view(text, WINDOW, axis=1)[at // SPREAD, at % SPREAD]
            words.append(np.ascontiguousarray(win).view(f"S{WINDOW}").ravel())
        own = [p[5] for p in parts]
        for a in range(len(parts)):
            least = own[a].copy()
            for b in range(len(parts)):
                if a != b:
                    k = np.minimum(np.searchsorted(words[b], words[a]), len(words[b]) - 1)
                    hit = words[b][k] == words[a]
                    least[hit] = np.minimum(least[hit], own[b][k[hit]])
            parts[a] = (*parts[a][:5], least)
    mask = np.zeros(len(spots), np.uint32)
    for i, text, order, run, _, least in parts:
        low = np.empty(len(order), np.int64)
        low[order] = least[run]
        low = low.reshape(len(text), SPREAD)
        bits = valid[i : i + unit] & (low < spots["id"][i : i + unit, None])
        mask[i : i + len(text)] = (bits.astype(np.uint32) << np.arange(SPREAD, dtype=np.uint32)).sum(1, dtype=np.uint32)
    return mask


def valid_windows(spots: np.ndarray) -> np.ndarray:
    """[record, offset]: whether a window begins there."""
    return (OFFSETS >= spots["lo"][:, None]) & (OFFSETS < spots["hi"][:, None])


def mark_contexts(spots: np.ndarray) -> np.ndarray:
    """``repeated_windows``, after equal contexts are taken once and those that share no window are left out.

    A window holds the anchor and at least half of SPREAD - 1 bytes before or behind it, so
    a context with a window of another one shares the anchor with those bytes on one side.
    """
    half = (SPREAD - 1) // 2
    first, number = distinct(spots)
    once = spots[first]
    near = np.zeros(len(first), bool)
    for a in (SPREAD - 1 - half, SPREAD - 1):
        _, inverse, count = np.unique(column_hash(once["ctx"][:, a : a + GRAM + half]), return_inverse=True, return_counts=True)
        near |= count[inverse] > 1
    mask = np.zeros(len(first), np.uint32)
    if near.any():
        mask[near] = repeated_windows(once[near])
    every = (valid_windows(once).astype(np.uint32) << BITS).sum(1, dtype=np.uint32)
    return np.where(spots["id"] > once["id"][number], every[number], mask[number])


def covered(begins: np.ndarray, step: int = STEP) -> np.ndarray:
    """Which bytes lie in a window that begins at a marked one."""
    out = np.empty(len(begins), bool)
    for at in range(0, len(begins), step):
        low = max(0, at - WINDOW + 1)
        total = np.concatenate([[0], np.cumsum(begins[low : at + step])])
        end = np.arange(at - low + 1, len(total))
        out[at : at + step] = total[end] > total[np.maximum(end - WINDOW, 0)]
    return out


# Packed batches


def _pack(batches: Iterator[pa.RecordBatch], batch_bytes: int) -> Iterator[pa.RecordBatch]:
    """Rows of (batch, ids, offsets, compressed text)."""
    compress = zstandard.ZstdCompressor(level=1).compress
    ids: list[np.ndarray] = []
    texts: list[np.ndarray] = []
    sizes: list[np.ndarray] = []

    def row() -> pa.RecordBatch:
        offs = np.concatenate([[0], np.cumsum(np.concatenate(sizes))]).astype("<i8")
        values = [np.concatenate(ids).tobytes(), offs.tobytes(), compress(np.concatenate(texts))]
        for x in (ids, texts, sizes):
            x.clear()
        return pa.RecordBatch.from_arrays([pa.array([uuid.uuid4().int >> 65], pa.int64()), *(pa.array([x], pa.binary()) for x in values)], ["batch", "ids", "offs", "data"])

    have = 0
    for batch in batches:
        numbers = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
        for i, j, data, offs in text_blocks(batch.column(1), batch_bytes):
            if ids and have + len(data) > batch_bytes:
                yield row()
                have = 0
            ids.append(numbers[i:j])
            texts.append(data.copy())
            sizes.append(np.diff(offs))
            have += len(data)
    if ids:
        yield row()


def _unpack(batch: pa.RecordBatch, r: int) -> tuple[int, np.ndarray, np.ndarray, np.ndarray]:
    get = lambda c: batch.column(batch.schema.get_field_index(c))[r].as_py()
    data = np.frombuffer(zstandard.ZstdDecompressor().decompress(get("data")), np.uint8)
    return get("batch"), np.frombuffer(get("ids"), np.int64), np.frombuffer(get("offs"), np.int64), data


def _sorted_anchors(data: np.ndarray, offs: np.ndarray, parts: int):
    """Anchors of a batch in the order of (part, hash): positions, keys of both, parts, 40-bit hashes, and bounds of equal ones."""
    pos, h = anchors(data, offs)
    key = h % U(parts) << U(40) | (h // U(parts)) & U((1 << 40) - 1)
    order = np.argsort(key)  # the order of equal ones does not matter
    pos, key = pos[order], key[order]
    new = np.ones(len(pos), bool)
    new[1:] = key[1:] != key[:-1]
    return pos, key, (key >> U(40)).astype(np.int32), key & U((1 << 40) - 1), np.flatnonzero(new)


def _emit_hashes(batches: Iterator[pa.RecordBatch], parts: int) -> Iterator[pa.RecordBatch]:
    """For each part a batch has anchors of: the distinct hashes, 5 bytes each, and a byte for each: the power of two that its occurrences reach, and 128 if they lie in two documents."""
    for batch in batches:
        for r in range(batch.num_rows):
            name, ids, offs, data = _unpack(batch, r)
            pos, _, part, short, head = _sorted_anchors(data, offs, parts)
            if not len(pos):
                continue
            doc_id = ids[np.searchsorted(offs, pos, "right") - 1]
            many = np.minimum.reduceat(doc_id, head) < np.maximum.reduceat(doc_id, head)
            count = np.diff(np.append(head, len(pos)))
            code = (np.ceil(np.log2(count)) + 128 * many).astype(np.uint8)
            at = part[head]
            cut = np.append(np.flatnonzero(np.diff(at, prepend=-1)), len(at))
            raw = np.ascontiguousarray(short[head].astype(">u8").view(np.uint8).reshape(-1, 8)[:, 3:])
            blobs = [raw[a:b].tobytes() for a, b in zip(cut, cut[1:])]
            codes = [code[a:b].tobytes() for a, b in zip(cut, cut[1:])]
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(blobs), pa.int64()), pa.array(at[cut[:-1]]), pa.array(blobs, pa.binary()), pa.array(codes, pa.binary())], ["batch", "part", "hashes", "codes"])


def _shared_hashes(table: pa.Table, hot_count: int) -> pa.Table:
    """Of one part: for each batch, which of its hashes other documents hold too (2 bits: shared, hot)."""
    blobs = table.column("hashes").to_pylist()
    size = [len(b) // 5 for b in blobs]
    raw = np.zeros((sum(size), 8), np.uint8)
    raw[:, 3:] = np.frombuffer(b"".join(blobs), np.uint8).reshape(-1, 5)
    h = raw.view(">u8").ravel().astype(np.int64)
    code = np.frombuffer(b"".join(table.column("codes").to_pylist()), np.uint8)
    order = np.argsort(h, kind="stable")
    head = np.flatnonzero(np.diff(h[order], prepend=-1))
    count = np.diff(np.append(head, len(h)))
    either = np.maximum.reduceat(code[order] & 128, head) if len(head) else head
    occurs = np.add.reduceat(np.exp2((code[order] & 127).astype(float)), head) if len(head) else head
    group = np.repeat(np.arange(len(head)), count)
    shared, hot = np.zeros(len(h), np.uint8), np.zeros(len(h), np.uint8)
    shared[order] = ((count > 1) | (either > 0))[group]
    hot[order] = (occurs > hot_count)[group]
    edge = np.cumsum([0, *size])
    bits = [np.packbits(np.stack([shared[a:b], hot[a:b]], 1)).tobytes() for a, b in zip(edge, edge[1:])]
    keep = [bool(shared[a:b].any()) for a, b in zip(edge, edge[1:])]
    out = pa.table({"batch": table.column("batch"), "part": table.column("part"), "bits": pa.array(bits, pa.binary())})
    return out.filter(pa.array(keep, pa.bool_()))


class Shared:
    """A batch's anchors that other documents hold too, in runs of equal ones: the cold runs first, then the hot ones, each in the order of their shards."""

    def __init__(self, batch: pa.RecordBatch, r: int, parts: int, shards: int):
        self.name, self.ids, self.offs, self.data = _unpack(batch, r)
        self.shards = shards
        answers = batch.column(batch.schema.get_field_index("answers"))[r].as_py() or []
        if not answers:
            self.pos, self.shard, self.bounds, self.n_cold = np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(1, np.int64), 0
            return
        pos, key, part, _, head = _sorted_anchors(self.data, self.offs, parts)
        self.padded = pad(self.data)
        at = part[head]
        shard = (mix(key) % U(shards)).astype(np.int32)
        shared, hot = np.zeros(len(head), bool), np.zeros(len(head), bool)
        for x in answers:
            a, b = np.searchsorted(at, [x["part"], x["part"] + 1])
            bits = np.unpackbits(np.frombuffer(x["bits"], np.uint8))[: 2 * (b - a)].reshape(-1, 2)
            shared[a:b], hot[a:b] = bits[:, 0], bits[:, 1]
        size = np.diff(np.append(head, len(pos)))
        by_shard = lambda runs: runs[np.argsort(shard[head[runs]], kind="stable")]
        runs = np.concatenate([by_shard(np.flatnonzero(shared & ~hot)), by_shard(np.flatnonzero(shared & hot))])
        self.n_cold = int((shared & ~hot).sum())
        self.bounds = np.concatenate([[0], np.cumsum(size[runs])])
        rows = np.repeat(head[runs] - self.bounds[:-1], size[runs]) + np.arange(self.bounds[-1])
        self.pos, self.shard = pos[rows], shard[rows]

    def _once(self, a: int, b: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(different contexts of the anchors a to b, an anchor of each, for each anchor the number of its context), UNIT anchors at a time."""
        spots, where, number, have = [], [], [], 0
        for k in range(a, b, UNIT):
            all_ = contexts(self.data, self.offs, self.ids, self.pos[k : min(b, k + UNIT)], self.padded)
            first, n = distinct(all_)
            spots.append(all_[first])
            where.append(first + k)
            number.append(n + have)
            have += len(first)
        every, where, number = np.concatenate(spots), np.concatenate(where), np.concatenate(number)
        if len(spots) > 1:
            first, n = distinct(every)
            every, where, number = every[first], where[first], n[number]
        return every, where, number

    def blocks(self):
        """Yield (records to send, their shards in order, a function from their masks and a slice of anchors to [anchor, offset] marks, the anchors' positions). Each block takes whole runs, about UNIT anchors."""
        for begin, end, hot in ((0, self.n_cold, False), (self.n_cold, len(self.bounds) - 1, True)):
            i = begin
            while i < end:
                j = min(end, max(i + 1, int(np.searchsorted(self.bounds, self.bounds[i] + UNIT, "right")) - 1))
                a, b = int(self.bounds[i]), int(self.bounds[j])
                i = j
                once, where, number = self._once(a, b)
                own = self.ids[np.searchsorted(self.offs, self.pos[a:b], "right") - 1]
                yield (*(self._windows(once, number, own) if hot else self._contexts(once, self.shard[where], number, own)), self.pos[a:b])

    def _contexts(self, once, shard, number, own):
        order = np.argsort(shard, kind="stable")
        once, shard = once[order], shard[order]
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        at = place[number]

        def marks(masks: np.ndarray, some: slice) -> np.ndarray:
            k = at[some]
            return (own[some] > once["id"][k])[:, None] & valid_windows(once[k]) | ((masks[k][:, None] >> BITS & 1) > 0)

        return once, shard, marks

    def _windows(self, once, number, own):
        """Contexts cut into their windows: all other bytes are blanked, so that equal windows are equal records."""
        k, o = np.nonzero(valid_windows(once))
        every = np.zeros(len(k), SPOT)
        every["id"], every["lo"], every["hi"] = once["id"][k], o, o + 1
        column = np.arange(CONTEXT)
        every["ctx"] = np.where((column >= o[:, None]) & (column < o[:, None] + WINDOW), once["ctx"][k], 0)
        first, n = distinct(every)
        every = every[first]
        shard = (column_hash(every["ctx"]) % U(self.shards)).astype(np.int32)
        order = np.argsort(shard, kind="stable")
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        every, shard = every[order], shard[order]
        window = np.full((len(once), SPREAD), -1, np.int64)
        window[k, o] = place[n]

        def marks(masks: np.ndarray, some: slice) -> np.ndarray:
            at = window[number[some]]
            return (at >= 0) & ((own[some, None] > every["id"][at]) | ((masks[at] >> BITS & 1) > 0))

        return every, shard, marks


def _emit_contexts(batches: Iterator[pa.RecordBatch], parts: int, shards: int) -> Iterator[pa.RecordBatch]:
    """(batch, block, shard, spots): what each batch asks the shards."""
    for batch in batches:
        for r in range(batch.num_rows):
            mine = Shared(batch, r, parts, shards)
            for block, (spots, s, _, _) in enumerate(mine.blocks()):
                cut = np.append(np.flatnonzero(np.diff(s, prepend=-1)), len(s))
                n = len(cut) - 1
                yield pa.RecordBatch.from_arrays([pa.array([mine.name] * n, pa.int64()), pa.array([block] * n, pa.int32()), pa.array(s[cut[:-1]]), pa.array([spots[a:b].tobytes() for a, b in zip(cut, cut[1:])], pa.binary())], ["batch", "block", "shard", "spots"])


def _mark_shard(table: pa.Table) -> pa.Table:
    """One shard: for each row that has repeated windows, the masks of its records."""
    blobs = table.column("spots").to_pylist()
    edge = np.cumsum([0, *(len(b) // SPOT.itemsize for b in blobs)])
    spots = np.frombuffer(b"".join(blobs), SPOT)
    del blobs
    mask = mark_contexts(spots)
    out = [mask[a:b].tobytes() if mask[a:b].any() else None for a, b in zip(edge, edge[1:])]
    done = table.select(["batch", "block", "shard"]).append_column("masks", pa.array(out, pa.binary()))
    return done.filter(pa.array([x is not None for x in out], pa.bool_()))


def _finish(batches: Iterator[pa.RecordBatch], parts: int, shards: int, texts: bool) -> Iterator[pa.RecordBatch]:
    """Per document of each batch: bytes, bytes and spans removed, and the digest (or the text) of what stays."""
    for batch in batches:
        for r in range(batch.num_rows):
            mine = Shared(batch, r, parts, shards)
            given = {(x["block"], x["shard"]): x["masks"] for x in batch.column(batch.schema.get_field_index("marks"))[r].as_py() or []}
            begins = np.zeros(len(mine.data), bool)
            for block, (spots, s, marks, pos) in enumerate(mine.blocks()):
                masks = np.zeros(len(spots), np.uint32)
                cut = np.append(np.flatnonzero(np.diff(s, prepend=-1)), len(s))
                for a, b in zip(cut, cut[1:]):
                    if (block, int(s[a])) in given:
                        masks[a:b] = np.frombuffer(given[block, int(s[a])], np.uint32)
                for i in range(0, len(pos), UNIT):
                    k, o = np.nonzero(marks(masks, slice(i, i + UNIT)))
                    begins[pos[i + k] - (SPREAD - 1) + o] = True
            gone = covered(begins)
            rows = []
            for a, b in zip(mine.offs, mine.offs[1:]):
                g = gone[a:b]
                stays = mine.data[a:b][~g]
                rows.append((b - a, np.count_nonzero(g), np.count_nonzero(g[1:] & ~g[:-1]) + bool(b > a and g[0]), stays.tobytes() if texts else hashlib.sha256(stays).hexdigest()))
            n_bytes, removed, spans, last = zip(*rows)
            yield pa.RecordBatch.from_arrays([pa.array(mine.ids), *(pa.array(np.array(x, np.int64)) for x in (n_bytes, removed, spans)), pa.array(last, pa.binary() if texts else pa.string())], ["id", "n_bytes", "n_removed", "n_spans", "kept"])


def _removal(docs: DataFrame, id_col: str, text_col: str, texts: bool, batch_bytes: int | None, hot_count: int) -> DataFrame:
    base = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    digest = F.md5(F.col("text").cast("binary"))
    narrow = durable(base.where("id is not null").select("id", digest.alias("fp"), F.octet_length("text").cast("long").alias("n_bytes")))
    copied = durable(narrow.groupBy("fp").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("c")).where("c > 1").drop("c"))
    judged = durable(narrow.join(copied, "fp", "left").select("id", "fp", "n_bytes", F.coalesce("first", "id").alias("least")))
    total = judged.agg(F.sum("n_bytes")).first()[0] or 0
    cut = lambda size: min(max(1, -(-total // size), min(LEAST_PARTS, -(-total // LEAST_BYTES))), MOST_PARTS)
    parts, shards = cut(PART_BYTES), cut(SHARD_BYTES)
    batch_bytes = batch_bytes or min(max(BATCH_BYTES, total // 100_000), MOST_BATCH_BYTES)
    rep = judged.where("id = least").select("id", "fp").distinct()
    packed = durable(base.withColumn("fp", digest).join(rep, ["id", "fp"], "left_semi").select("id", "text").mapInArrow(lambda b: _pack(b, batch_bytes), "batch long, ids binary, offs binary, data binary"))
    hashes = packed.mapInArrow(lambda b: _emit_hashes(b, parts), "batch long, part int, hashes binary, codes binary")
    answers = durable(hashes.groupBy("part").applyInArrow(lambda t: _shared_hashes(t, hot_count), "batch long, part int, bits binary"))
    listed = answers.groupBy("batch").agg(F.collect_list(F.struct("part", "bits")).alias("answers"))
    spots = packed.join(listed, "batch").mapInArrow(lambda b: _emit_contexts(b, parts, shards), "batch long, block int, shard int, spots binary")
    marks = durable(spots.groupBy("shard").applyInArrow(_mark_shard, "batch long, block int, shard int, masks binary"))
    discard(narrow, copied)
    final = packed.join(listed, "batch", "left").join(marks.groupBy("batch").agg(F.collect_list(F.struct("block", "shard", "masks")).alias("marks")), "batch", "left")
    kind = "binary" if texts else "string"
    done = final.mapInArrow(lambda b: _finish(b, parts, shards, texts), f"id long, n_bytes long, n_removed long, n_spans long, kept {kind}")
    gone = F.col("n_bytes") >= WINDOW
    whole = lambda df: df.select("id", "n_bytes", F.lit(0).cast("long").alias("n_removed"), F.lit(0).cast("long").alias("n_spans"), "kept")
    keep = lambda c: c.cast("binary") if texts else F.sha2(c.cast("binary"), 256)
    copies = judged.where("id <> least").where(gone).select("id", "n_bytes", F.col("n_bytes").alias("n_removed"), F.lit(1).cast("long").alias("n_spans"), keep(F.lit("")).alias("kept"))
    short_copies = judged.where("id <> least").where(~gone).select("id", "fp", "n_bytes")
    short = base.where(F.octet_length("text") < WINDOW).select("id", digest.alias("fp"), keep(F.col("text")).alias("kept"))
    short = whole(short_copies.distinct().join(short, ["id", "fp"]))
    nulls = whole(base.where("id is null").select("id", F.octet_length("text").cast("long").alias("n_bytes"), keep(F.col("text")).alias("kept")))
    return done.unionByName(copies).unionByName(short).unionByName(nulls)


def removal_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", batch_bytes: int | None = None, hot_count: int = HOT) -> DataFrame:
    """Per row: its id, ``n_bytes``, ``n_removed``, ``n_spans`` and ``kept_sha256``."""
    return _removal(docs, id_col, text_col, False, batch_bytes, hot_count).withColumnsRenamed({"id": id_col, "kept": "kept_sha256"})


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", batch_bytes: int | None = None, hot_count: int = HOT) -> DataFrame:
    """Per row: its id, the counts, and ``kept``, the bytes that stay (cuts may fall within a character)."""
    return _removal(docs, id_col, text_col, True, batch_bytes, hot_count).withColumnRenamed("id", id_col)


#: The report in DuckDB, window by window; for small tables.
SQL = r"""WITH d AS (SELECT doc_id, row_number() OVER () AS rid, octet_length(encode(coalesce(text, ''))) AS n, hex(encode(coalesce(text, ''))) AS hx FROM documents),
w AS (SELECT rid, doc_id, s, substr(hx, 2 * s - 1, 100) AS g FROM d CROSS JOIN LATERAL (SELECT unnest(range(1, n - 48)) AS s) x),
f AS (SELECT w.rid, s FROM w JOIN (SELECT g, min(doc_id) AS first FROM w GROUP BY g) m ON m.g = w.g WHERE first < doc_id),
sp AS (SELECT rid, min(s) AS a, max(s) + 49 AS b FROM (SELECT rid, s, sum(new) OVER (PARTITION BY rid ORDER BY s ROWS UNBOUNDED PRECEDING) AS k FROM (SELECT rid, s, CASE WHEN s <= lag(s) OVER (PARTITION BY rid ORDER BY s) + 50 THEN 0 ELSE 1 END AS new FROM f)) GROUP BY rid, k),
pc AS (SELECT rid, string_agg(substr(hx, 2 * a - 1, 2 * (b - a + 1)), '' ORDER BY a) AS hx FROM (SELECT d.rid, hx, coalesce(lag(b) OVER (PARTITION BY d.rid ORDER BY a), 0) + 1 AS a, sp.a - 1 AS b FROM d JOIN sp ON sp.rid = d.rid
  UNION ALL SELECT d.rid, hx, e + 1, n FROM d JOIN (SELECT rid, max(b) AS e FROM sp GROUP BY rid) t ON t.rid = d.rid) WHERE b >= a GROUP BY rid),
c AS (SELECT rid, CAST(sum(b - a + 1) AS BIGINT) AS n_removed, CAST(count(*) AS BIGINT) AS n_spans FROM sp GROUP BY rid)
SELECT doc_id, CAST(n AS BIGINT) AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(CASE WHEN c.rid IS NULL THEN d.hx ELSE coalesce(pc.hx, '') END)) AS kept_sha256
FROM d LEFT JOIN c ON c.rid = d.rid LEFT JOIN pc ON pc.rid = d.rid
"""
