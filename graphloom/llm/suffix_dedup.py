"""Suffix-array deduplication: remove bytes of passages that start in an earlier document too.

A byte goes if a string of WINDOW bytes that covers it also starts in a document with a smaller id. Texts are UTF-8
bytes, matches stay within a document, and all strings are judged on the input.

1. Documents with equal texts: all but those of the least id lose everything (if they have WINDOW bytes at all) and
   take no further part. A fixed-size filter of repeated text hashes keeps the other texts where they are.
2. Every string of WINDOW bytes holds one anchor: the place whose GRAM bytes have the least hash. Equal strings have
   equal anchors, so only suffixes at anchors matter, a fourteenth of all. Tasks send the distinct hashes of their
   anchors; those in two documents enter a Bloom filter of fixed size (false positives only cost work).
3. Around each anchor that passes, a task cuts the strings that have it as anchor, as one context. Equal contexts of a
   task are resolved there: all but the least id's are covered. What is left is range-partitioned by the suffix at the
   anchor, between splitters sampled from the anchors' leading GRAM bytes, so that no string crosses a boundary.
4. A bucket sorts its suffixes by multikey quicksort, eight bytes at a time. Equal contexts are neighbours; where one
   anchor has different contexts, their strings of WINDOW bytes are sorted the same way. The least id of each run of
   equal strings decides which are covered.
5. Covered spans meet their texts; documents without any (by a fixed-size filter) aren't moved.

Null text: empty. Null id: after all others. Ties (equal ids): neither is earlier. Repeated rows: same as equal ids.
Texts under WINDOW bytes lose nothing. Very long texts are cut into overlapping pieces for step 2 and 3. Empty table:
empty result. Extra columns: not read, unless named in ``carry``.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import key_hash, lean, lean_group, marked, mix, powers, prefix_hash, row_filter, slices, small_batches, stored, utf8

WINDOW = 50
GRAM = 24
SPAN = WINDOW - GRAM + 1
#: Bytes of a context: up to SPAN strings of WINDOW bytes.
CONTEXT = WINDOW + SPAN - 1
#: Bytes of text that are hashed at once.
PIECE = 1 << 18
ANCHOR_BITS = 1 << 27
LAST = (1 << 63) - 1
#: Splitters are taken from about so many sampled anchors.
SAMPLED = 65_536
HELD = 600_000
#: Strings that are sorted at once.
STRINGS = 300_000


def pieces(data: np.ndarray, offsets: np.ndarray, most: int = PIECE) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Texts in chunks of about most bytes: (bytes, offsets, row of each text, place in its row). Long texts are cut so
    that every string of WINDOW bytes lies in exactly one piece."""
    cuts: list[tuple[int, int, int]] = []
    size = 0

    def chunk():
        ends = np.cumsum([0, *(b - a for _, a, b in cuts)])
        joined = np.concatenate([data[a:b] for _, a, b in cuts])
        return joined, ends, np.array([r for r, _, _ in cuts]), np.array([a - offsets[r] for r, a, _ in cuts])

    for row in range(len(offsets) - 1):
        start, end = int(offsets[row]), int(offsets[row + 1])
        for a in range(start, end, most):
            b = min(end, a + most + WINDOW - 1)
            if b - a >= WINDOW:
                if size + b - a > most and cuts:
                    yield chunk()
                    cuts, size = [], 0
                cuts.append((row, a, b))
                size += b - a
    if cuts:
        yield chunk()


def _sliding(x: np.ndarray, best) -> np.ndarray:
    """best over x[i : i + SPAN], by doubling."""
    width = 1
    while width * 2 <= SPAN:
        x = best(x[:-width], x[width:])
        width *= 2
    rest = SPAN - width
    return best(x[: len(x) - rest], x[rest:]) if rest else x


def anchors(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places of the anchors, the hash at every place, and for each string start its least hash (0: not a string)."""
    n = len(data)
    prefix = prefix_hash(data)
    grams = np.full(n, np.uint64(0xFFFFFFFFFFFFFFFF))
    if n >= GRAM:
        grams[: n - GRAM + 1] = mix((prefix[GRAM:] - prefix[: n - GRAM + 1]) * powers(n + 1)[1][: n - GRAM + 1]) | np.uint64(1)
    valid = np.ones(n, bool)
    for end, start in zip(offsets[1:], offsets[:-1], strict=True):
        valid[max(start, end - WINDOW + 1) : end] = False
    least = np.zeros(n, np.uint64)
    if n >= SPAN:
        least[: n - SPAN + 1] = _sliding(grams, np.minimum)
    least[~valid] = 0
    highest = _sliding(np.concatenate([np.zeros(SPAN - 1, np.uint64), least]), np.maximum)
    return np.flatnonzero(highest == grams), grams, least


def multikey_sort(words: np.ndarray) -> np.ndarray:
    """The order of rows of big-endian 8-byte words: each word splits only the rows still tied by the words before."""
    n, depth = words.shape
    order = np.argsort(words[:, 0], kind="stable")
    if n < 2:
        return order
    first = words[order, 0]
    tied = first[1:] == first[:-1]
    for j in range(1, depth):
        if not tied.any():
            break
        # Rows of runs of ties, and the number of each row's run.
        inside = np.zeros(n, bool)
        inside[1:] |= tied
        inside[:-1] |= tied
        at = np.flatnonzero(inside)
        run = np.cumsum(~np.concatenate([[False], tied])[at])
        own = order[at]
        key = words[own, j]
        own = own[np.lexsort((key, run))]
        order[at] = own
        key = words[own, j]
        same = (key[1:] == key[:-1]) & (run[1:] == run[:-1]) & (at[1:] == at[:-1] + 1)
        tied = np.zeros(n - 1, bool)
        tied[at[1:][same] - 1] = True
    return order


def _words(matrix: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(matrix).view(">u8").astype(np.uint64)


def _new_rows(words: np.ndarray) -> np.ndarray:
    """Whether each row of a sorted table differs from the one before."""
    out = np.ones(len(words), bool)
    out[1:] = (words[1:] != words[:-1]).any(axis=1)
    return out


class Contexts:
    """Occurrences of contexts: id, row key, place, number of strings, the anchor's offset, and CONTEXT bytes."""

    def __init__(self, ids, keys, places, counts, offsets, text):
        self.ids, self.keys, self.places, self.counts, self.offsets, self.text = ids, keys, places, counts, offsets, text

    def __len__(self) -> int:
        return len(self.ids)

    def take(self, at: np.ndarray) -> Contexts:
        return Contexts(*(x[at] for x in (self.ids, self.keys, self.places, self.counts, self.offsets, self.text)))

    @staticmethod
    def concat(parts: list[Contexts]) -> Contexts:
        return Contexts(*(np.concatenate([getattr(p, k) for p in parts]) for k in ("ids", "keys", "places", "counts", "offsets", "text")))

    def to_bytes(self, press: zstandard.ZstdCompressor) -> bytes:
        lengths = self.counts.astype(np.int64) + WINDOW - 1
        text = self.text[np.arange(CONTEXT)[None, :] < lengths[:, None]]
        raw = b"".join([np.array([len(self)], "<i8").tobytes(), self.ids.astype("<i8").tobytes(), self.keys.astype("<i8").tobytes(), self.places.astype("<i8").tobytes(), self.counts.astype(np.uint8).tobytes(), self.offsets.astype(np.uint8).tobytes(), text.tobytes()])
        return press.compress(raw)

    @classmethod
    def from_bytes(cls, data: bytes) -> Contexts:
        raw = zstandard.ZstdDecompressor().decompress(data)
        n = int(np.frombuffer(raw, "<i8", 1)[0])
        longs = np.frombuffer(raw, "<i8", 3 * n, 8).reshape(3, n)
        small = np.frombuffer(raw, np.uint8, 2 * n, 8 + 24 * n).reshape(2, n)
        lengths = small[0].astype(np.int64) + WINDOW - 1
        text = np.zeros((n, CONTEXT), np.uint8)
        text[np.arange(CONTEXT)[None, :] < lengths[:, None]] = np.frombuffer(raw, np.uint8, int(lengths.sum()), 8 + 26 * n)
        return cls(*longs, *small, text)

    def suffixes(self) -> np.ndarray:
        """Words to sort by: the suffix at the anchor, then what stands before it, then both lengths."""
        n = len(self)
        offsets, lengths = self.offsets.astype(np.int64)[:, None], (self.counts.astype(np.int64) + WINDOW - 1)[:, None]
        padded = np.concatenate([self.text, np.zeros((n, WINDOW + 6), np.uint8)], axis=1)
        at = np.arange(56)[None, :]
        suffix = np.where(at < lengths - offsets, padded[np.arange(n)[:, None], at + offsets], 0).astype(np.uint8)
        at = np.arange(32)[None, :]
        before = np.where(at < offsets, padded[:, :32], 0).astype(np.uint8)
        last = (offsets[:, 0] * 256 + self.counts).astype(np.uint64)
        return np.concatenate([_words(suffix), _words(before), last[:, None]], axis=1)


def _compare_strings(found: Contexts, first: np.ndarray, context: np.ndarray, least: np.ndarray, several: np.ndarray, rest: np.ndarray) -> list[np.ndarray]:
    """Spans of the strings of some contexts that also stand in another context of an earlier document."""
    counts = found.counts[first[several]].astype(np.int64)
    owner = np.repeat(np.arange(len(several)), counts)
    place = np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)
    text = found.text[first[several]]
    covered = np.zeros(len(owner), bool)
    matrix = np.zeros((len(owner), 56), np.uint8)
    matrix[:, :WINDOW] = text[owner[:, None], place[:, None] + np.arange(WINDOW)[None, :]]
    strings = _words(matrix)
    by = multikey_sort(strings)
    runs = np.flatnonzero(_new_rows(strings[by]))
    own = least[several][owner]
    lowest = np.repeat(np.minimum.reduceat(own[by], runs), np.diff(np.append(runs, len(by))))
    covered[by] = lowest < own[by]
    # Runs of covered strings within a context, for its occurrences in the least document.
    start = covered & ~np.concatenate([[False], covered[:-1] & (owner[1:] == owner[:-1])])
    end = covered & ~np.concatenate([covered[1:] & (owner[1:] == owner[:-1]), [False]])
    run_owner, a, b = owner[start], place[start], place[end] + WINDOW
    which = np.full(len(first), -1)
    which[several] = np.arange(len(several))
    slot = which[context[rest]]
    rest, slot = rest[slot >= 0], slot[slot >= 0]
    low, high = np.searchsorted(run_owner, slot), np.searchsorted(run_owner, slot, side="right")
    n = high - low
    rows = np.repeat(rest, n)
    run = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(low, n)
    return [found.ids[rows], found.keys[rows], found.places[rows] + a[run], found.places[rows] + b[run]]


def resolve(found: Contexts) -> list[np.ndarray]:
    """Covered spans as (ids, keys, starts, ends), by sorting all suffixes of a bucket."""
    if not len(found):
        return [np.zeros(0, np.int64)] * 4
    words = found.suffixes()
    order = multikey_sort(words)
    found, words = found.take(order), words[order]
    new = _new_rows(words)
    first = np.flatnonzero(new)
    context = np.cumsum(new) - 1
    least = np.minimum.reduceat(found.ids, first)
    # A context that also stands in an earlier document is covered as a whole.
    whole = found.ids > least[context]
    out = [[found.ids[whole], found.keys[whole], found.places[whole], found.places[whole] + found.counts[whole] + WINDOW - 1]]
    # Anchors with several contexts: compare their strings.
    grams = _new_rows(words[first, :3])
    gram = np.cumsum(grams) - 1
    every = np.flatnonzero(np.bincount(gram)[gram] > 1)
    # In parts of whole anchors, to bound memory.
    ends = np.cumsum(found.counts[first[every]].astype(np.int64)) // STRINGS
    last = np.ones(len(every), bool)
    last[:-1] = gram[every][1:] != gram[every][:-1]
    part = np.zeros(len(every), np.int64)
    if len(every):
        part = ends[np.flatnonzero(last)][np.cumsum(np.concatenate([[False], last[:-1]]))]
    rest = np.flatnonzero(~whole)
    for several in np.split(every, np.flatnonzero(np.diff(part)) + 1) if len(every) else ():
        out.append(_compare_strings(found, first, context, least, several, rest))
    return [np.concatenate([x[i] for x in out]).astype(np.int64) for i in range(4)]


def _places(h: np.ndarray, bits: int) -> list[np.ndarray]:
    """Three places of 48-bit hashes in a filter of bits bits (a power of two)."""
    mask, other = np.uint64(bits - 1), mix(h)
    return [(x & mask).astype(np.int64) for x in (h, other, other >> np.uint64(32))]


def _send_anchors(bucket_bits: int, modulus: int):
    """Distinct anchor hashes (48 bits) of a task by their top bits, and whether two of its documents have them."""
    kinds = [("bucket", pa.int32()), ("hashes", pa.binary()), ("samples", pa.binary())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(1)
        held, size, doc, sampled = [], 0, 0, {}

        def send() -> Iterator[pa.RecordBatch]:
            h, d = (np.concatenate([x[i] for x in held]) for i in range(2))
            order = np.lexsort((d, h))
            h, d = h[order], d[order]
            new = np.ones(len(h), bool)
            new[1:] = h[1:] != h[:-1]
            first = np.flatnonzero(new)
            last = np.append(first[1:], len(h)) - 1
            names = h[first] << np.uint64(1) | (d[first] != d[last]).astype(np.uint64)
            cuts = np.searchsorted(names, np.arange(1, 1 << bucket_bits, dtype=np.uint64) << np.uint64(49 - bucket_bits))
            rows = []
            for b, own in enumerate(np.split(names, cuts)):
                if len(own):
                    steps = np.diff(own, prepend=np.uint64(0))
                    steps = steps.astype("<u4") if len(own) > 1 and steps[1:].max() < 1 << 32 and own[0] < 1 << 32 else steps.astype("<u8")
                    chosen = [x for x in (own[(own >> np.uint64(1)) % np.uint64(modulus) == 0] >> np.uint64(1)).tolist()]
                    rows.append((b, steps.dtype.char.encode() + press.compress(steps.tobytes()), np.array(chosen, "<u8").tobytes() + b"".join(sampled[x] for x in chosen)))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*rows, strict=True), kinds, strict=True)], [k for k, _ in kinds])

        for part in slices(batches, "text"):
            for data, offsets, rows, _ in pieces(*utf8(part.column("text"))):
                at, grams, _ = anchors(data, offsets)
                own = doc + rows[np.searchsorted(offsets, at, side="right") - 1]
                h = grams[at] >> np.uint64(16)
                chosen = np.flatnonzero(h % np.uint64(modulus) == 0)
                sampled.update((x, data[i : i + GRAM].tobytes()) for x, i in zip(h[chosen].tolist(), at[chosen].tolist(), strict=True))
                if len(at):
                    held.append((h, own.astype(np.int32)))
                    size += len(at)
            doc += part.num_rows
            if size > HELD:
                yield from send()
                held, size, sampled = [], 0, {}
        if size:
            yield from send()

    return run


def _repeated(bucket_bits: int):
    """Of a bucket of hashes: a bitmap of those in two documents, and the leading bytes of the sampled ones."""
    bits = ANCHOR_BITS >> bucket_bits

    def run(table):
        unpress = zstandard.ZstdDecompressor()
        names, sampled = [], {}
        for x, s in zip(table.column("hashes").to_pylist(), table.column("samples").to_pylist(), strict=True):
            names.append(np.cumsum(np.frombuffer(unpress.decompress(x[1:]), "<u4" if x[:1] == b"I" else "<u8").astype(np.uint64), dtype=np.uint64))
            n = len(s) // (8 + GRAM)
            sampled.update(zip(np.frombuffer(s, "<u8", n).tolist(), (s[8 * n + GRAM * i : 8 * n + GRAM * (i + 1)] for i in range(n)), strict=True))
        names = np.sort(np.concatenate(names))
        h, many = names >> np.uint64(1), (names & np.uint64(1)).astype(bool)
        many[1:] |= h[1:] == h[:-1]
        h = np.unique(h[many])
        bitmap = np.zeros(bits, bool)
        for place in _places(h, bits):
            bitmap[place] = True
        kept = b"".join(sampled[x] for x in sorted(set(sampled) & set(h[np.isin(h, np.fromiter(sampled, np.uint64, len(sampled)))].tolist())))
        return pa.table({"bucket": pa.array([table.column("bucket")[0].as_py()], pa.int32()), "bits": pa.array([zstandard.compress(np.packbits(bitmap, bitorder="little").tobytes(), 1)], pa.binary()), "samples": pa.array([kept], pa.binary())})

    return run


def _send_contexts(bits, splitters, bucket_bits: int, buckets: int):
    """Contexts of a task's anchors that pass the filter, by range of their suffix; spans that the task can tell."""
    per_bucket = ANCHOR_BITS >> bucket_bits
    names = ["bucket", "contexts", "spans"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press, passes, cuts = zstandard.ZstdCompressor(3), bits.value, np.array(splitters.value, f"S{GRAM}")
        held: list[Contexts] = []
        size = 0

        def send() -> Iterator[pa.RecordBatch]:
            found = Contexts.concat(held)
            held.clear()
            words = np.zeros((len(found), 11), np.uint64)
            padded = np.zeros((len(found), 80), np.uint8)
            padded[:, :CONTEXT] = found.text
            words[:, :10], words[:, 10] = padded.view(">u8"), found.counts
            del padded
            order = multikey_sort(words)
            words = words[order]
            new = _new_rows(words)
            del words
            found = found.take(order)
            least = np.minimum.reduceat(found.ids, np.flatnonzero(new))[np.cumsum(new) - 1]
            mine = found.ids > least
            spans = np.stack([found.ids[mine], found.keys[mine], found.places[mine], found.places[mine] + found.counts[mine] + WINDOW - 1]) if mine.any() else np.zeros((4, 0), np.int64)
            spans = merge_spans(*spans)
            found = found.take(np.flatnonzero(~mine))
            lead = found.text[np.arange(len(found))[:, None], found.offsets.astype(np.int64)[:, None] + np.arange(GRAM)[None, :]]
            bucket = np.searchsorted(cuts, np.ascontiguousarray(lead).view(f"S{GRAM}")[:, 0], side="right")
            order = np.argsort(bucket, kind="stable")
            rows = []
            for own in np.split(order, np.flatnonzero(np.diff(bucket[order])) + 1):
                if len(own):
                    rows.append((int(bucket[own[0]]), found.take(own).to_bytes(press), None))
            deal = spans[0] % buckets
            order = np.argsort(deal, kind="stable")
            for own in np.split(order, np.flatnonzero(np.diff(deal[order])) + 1):
                if len(own):
                    rows.append((int(deal[own[0]]), None, press.compress(np.stack([x[own] for x in spans]).astype("<i8").tobytes())))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int32(), pa.binary(), pa.binary()), strict=True)], names)

        for part in slices(batches, "text"):
            ids, keys = part.column("d").to_numpy(), part.column("rk").to_numpy()
            for data, offsets, rows, bases in pieces(*utf8(part.column("text"))):
                at, grams, least = anchors(data, offsets)
                h = grams[at] >> np.uint64(16)
                first = (h >> np.uint64(48 - bucket_bits)).astype(np.int64) * per_bucket
                passed = np.ones(len(at), bool)
                for place in _places(h, per_bucket):
                    bit = first + place
                    passed &= passes[bit >> 3] >> (bit & 7).astype(np.uint8) & 1 == 1
                at = at[passed]
                if not len(at):
                    continue
                # The strings whose anchor this is: a run of starts up to the anchor; from equal hashes the first counts.
                starts = at[:, None] - np.arange(SPAN - 1, -1, -1)[None, :]
                equal = np.where(starts >= 0, least[np.maximum(starts, 0)], 0) == grams[at][:, None]
                low = at - (SPAN - 1) + equal.argmax(axis=1)
                high = at - equal[:, ::-1].argmax(axis=1)
                same = np.zeros(len(at), bool)
                same[1:] = grams[at[1:]] == grams[at[:-1]]
                low[1:] = np.where(same[1:], np.maximum(low[1:], at[:-1] + 1), low[1:])
                kept = low <= high
                at, low, high = at[kept], low[kept], high[kept]
                text = np.concatenate([data, np.zeros(CONTEXT, np.uint8)])[low[:, None] + np.arange(CONTEXT)[None, :]]
                counts = high - low + 1
                text[np.arange(CONTEXT)[None, :] >= (counts + WINDOW - 1)[:, None]] = 0
                piece = np.searchsorted(offsets, low, side="right") - 1
                row = rows[piece]
                held.append(Contexts(ids[row], keys[row], low - offsets[piece] + bases[piece], counts.astype(np.uint8), (at - low).astype(np.uint8), text))
                size += len(at)
                if size > HELD // 4:
                    yield from send()
                    size = 0
        if size:
            yield from send()

    return run


def merge_spans(ids: np.ndarray, keys: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> list[np.ndarray]:
    """Spans of each (id, key) in order, those that touch or overlap as one."""
    if not len(ids):
        return [ids, keys, starts, ends]
    order = np.lexsort((starts, keys, ids))
    ids, keys, starts, ends = ids[order], keys[order], starts[order], ends[order]
    change = np.ones(len(ids), bool)
    change[1:] = (ids[1:] != ids[:-1]) | (keys[1:] != keys[:-1])
    # Running greatest end within a document: lift each document above the one before.
    lift = (np.cumsum(change) - 1) * (int(ends.max()) + 2)
    reach = np.maximum.accumulate(ends + lift)
    new = change.copy()
    new[1:] |= starts[1:] + lift[1:] > reach[:-1]
    first = np.flatnonzero(new)
    return [ids[first], keys[first], starts[first], np.maximum.reduceat(ends, first)]


def _resolve_bucket(table):
    contexts = [Contexts.from_bytes(x) for x in table.column("contexts").to_pylist() if x is not None]
    spans = [np.frombuffer(zstandard.decompress(x), "<i8").reshape(4, -1) for x in table.column("spans").to_pylist() if x is not None]
    parts = ([resolve(Contexts.concat(contexts))] if contexts else []) + [list(x) for x in spans]
    merged = merge_spans(*(np.concatenate([p[i] for p in parts]) for i in range(4)))
    return pa.table([pa.array(x, pa.int64()) for x in merged], ["d", "rk", "start", "end"])


def kept_bytes(text: bytes, spans: list[tuple[int, int]]) -> tuple[bytes, int, int]:
    """What is left of text without the spans, the number of bytes removed, and of maximal removed runs."""
    out, at, n_removed, n_runs = [], 0, 0, 0
    last = -1
    for start, end in sorted(spans):
        if start > last:
            n_runs += 1
        if start > at:
            out.append(text[at:start])
        if end > max(start, at):
            n_removed += end - max(start, at)
        at, last = max(at, end), max(last, end)
    out.append(text[at:])
    return b"".join(out), n_removed, n_runs


def _press(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Compress the texts that are moved."""
    press = zstandard.ZstdCompressor(3)
    for part in slices(batches, "text"):
        packed = pa.array([press.compress((t or "").encode()) for t in part.column("text").to_pylist()], pa.binary())
        new = {"packed": packed, "text": pa.nulls(part.num_rows, pa.string())}
        yield pa.RecordBatch.from_arrays([new.get(c, part.column(c)) for c in part.schema.names], part.schema.names)


def _finish(as_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpress = zstandard.ZstdDecompressor()
        for part in (x for y in slices(batches, "text") for x in slices(iter([y]), "packed")):
            rest = [part.schema.names.index(c) for c in part.schema.names if c not in ("text", "packed", "spans", "copy")]
            rows = []
            for text, packed, spans, copy in zip(*(part.column(c).to_pylist() for c in ("text", "packed", "spans", "copy")), strict=True):
                data = (text or "").encode() if packed is None else unpress.decompress(packed)
                if copy and len(data) >= WINDOW:
                    spans = [{"start": 0, "end": len(data)}]
                kept, n_removed, n_spans = kept_bytes(data, [(s["start"], s["end"]) for s in spans or ()])
                rows.append((len(data), n_removed, n_spans, kept))
            sizes = [pa.array(c, pa.int64()) for c in list(zip(*rows, strict=True))[:3]]
            kept = pa.array([r[3].decode("utf-8", "ignore") for r in rows], pa.string()) if as_text else pa.array([r[3] for r in rows], pa.binary())
            yield pa.RecordBatch.from_arrays([*(part.column(i) for i in rest), *sizes, pa.array([hashlib.sha256(r[3]).hexdigest() for r in rows]), kept], [*(part.schema.names[i] for i in rest), "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    return run


def dedup(docs: DataFrame, carry: tuple[str, ...] = (), with_kept: str = "") -> DataFrame:
    """(doc_id, *carry, n_bytes, n_removed, n_spans, kept_sha256[, kept]) of docs (doc_id, text).

    with_kept: "bytes" or "text" (without characters that were cut in two)."""
    spark = docs.sparkSession
    small_batches(spark)
    digest = F.sha2(F.col("text"), 256)
    half = lambda at: F.conv(F.substring(digest, at, 16), 16, -10).cast("long")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *[F.col(c).alias(f"c_{c}") for c in carry], F.coalesce("text", F.lit("")).alias("text")).withColumns({"d": F.coalesce("doc_id", F.lit(LAST)), "rk": F.xxhash64("doc_id", "text"), "ka": half(1), "kb": half(17)})
    own = [f"c_{c}" for c in carry]
    # A row is told by its id; only rows of repeated ids need a key of their own (zeros cost nothing to move).
    twice = rows.groupBy("d").agg(F.count("*").alias("_n")).filter("_n > 1")
    rows = marked(rows, key_hash("d"), row_filter(twice, key_hash("d")), "_twice").withColumn("rk", F.when(F.col("_twice"), F.col("rk")).otherwise(0)).drop("_twice")
    first = rows.groupBy("ka", "kb").agg(F.min("d").alias("_first"), F.count("*").alias("_n"), F.first(F.octet_length("text")).alias("_bytes"))
    first = stored(first, "texts-once")
    total = first.agg(F.sum("_bytes")).first()[0] or 0
    repeats = first.filter("_n > 1")
    known = marked(rows, key_hash("ka"), row_filter(repeats, key_hash("ka")), "_maybe")
    moved = known.filter("_maybe").drop("_maybe").join(first.select(F.col("ka").alias("_a"), F.col("kb").alias("_c"), "_first"), (F.col("ka") == F.col("_a")) & (F.col("kb") == F.col("_c")))
    moved = stored(moved.select("doc_id", *own, "text", "d", "rk", (F.col("d") > F.col("_first")).alias("copy")), "repeated-texts")
    single = known.filter(~F.col("_maybe")).select("doc_id", *own, "text", "d", "rk", F.lit(False).alias("copy"))
    sources = single.unionByName(moved.filter(~F.col("copy"))).filter(F.octet_length("text") >= WINDOW)

    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    estimate = int(total * 2 / (SPAN + 1))
    bucket_bits = min(16, max(8, (estimate >> 22).bit_length()))
    modulus = max(16, estimate // SAMPLED)
    sent = sources.select("text").mapInArrow(lean(_send_anchors(bucket_bits, modulus)), "bucket int, hashes binary, samples binary")
    told = sent.groupBy("bucket").applyInArrow(lean_group(_repeated(bucket_bits)), "bucket int, bits binary, samples binary").collect()  # ANCHOR_BITS bits and about SAMPLED samples
    passes = np.zeros(ANCHOR_BITS // 8, np.uint8)
    width = ANCHOR_BITS >> bucket_bits + 3
    samples: list[bytes] = []
    for bucket, bits, leads in told:
        passes[bucket * width : (bucket + 1) * width] = np.frombuffer(zstandard.decompress(bytes(bits)), np.uint8)
        samples += [bytes(leads[i : i + GRAM]) for i in range(0, len(leads), GRAM)]
    samples.sort()
    buckets = max(1, 8 * tasks)
    cuts = sorted({samples[i * len(samples) // buckets] for i in range(1, buckets)}) if samples else []
    shared, splitters = spark.sparkContext.broadcast(passes), spark.sparkContext.broadcast(cuts)
    contexts = sources.select("d", "rk", "text").mapInArrow(lean(_send_contexts(shared, splitters, bucket_bits, buckets)), "bucket int, contexts binary, spans binary")
    spans = contexts.groupBy("bucket").applyInArrow(lean_group(_resolve_bucket), "d long, rk long, start long, end long")
    spans = stored(spans, "spans")

    listed = spans.groupBy("d", "rk").agg(F.collect_list(F.struct("start", "end")).alias("spans"))
    at = lambda df: marked(df, key_hash("d"), row_filter(spans, key_hash("d")), "_hit")
    everyone = at(single.unionByName(moved))
    found = everyone.filter("_hit").drop("_hit").withColumn("packed", F.lit(b""))
    hit = found.mapInArrow(lean(_press), found.schema).join(listed, ["d", "rk"], "left")
    clean = everyone.filter(~F.col("_hit")).drop("_hit").withColumns({"packed": F.lit(None).cast("binary"), "spans": F.lit(None).cast(listed.schema["spans"].dataType)})
    done = hit.unionByName(clean).select("doc_id", *own, "text", "packed", "spans", "copy")
    kinds = {f.name: f.dataType for f in done.schema.fields}
    from pyspark.sql.types import BinaryType, LongType, StringType, StructType

    schema = StructType()
    for c in ["doc_id", *own]:
        schema = schema.add(c, kinds[c])
    for c in ("n_bytes", "n_removed", "n_spans"):
        schema = schema.add(c, LongType())
    schema = schema.add("kept_sha256", StringType()).add("kept", StringType() if with_kept == "text" else BinaryType())
    out = done.mapInArrow(lean(_finish(with_kept == "text")), schema)
    return out.select("doc_id", *[F.col(f"c_{c}").alias(c) for c in carry], "n_bytes", "n_removed", "n_spans", "kept_sha256", *["kept"] * bool(with_kept))


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each document keeps when passages of earlier documents go."""
    return dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))
