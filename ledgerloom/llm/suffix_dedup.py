"""Suffix-array dedup (2): repeats of at least ``length`` bytes by the common-prefix interval tree of a suffix array.

A suffix array over the whole corpus would put every byte through a sort that no task can hold, so the text is first cut
where equal strings must be cut alike. Every window of ``length`` bytes picks the least hash among its GRAM-byte
strings (its anchor); neighbouring windows with the same anchor form a span, and equal windows always lie in spans with
equal anchors. Three passes over chunks of documents that are dealt once:

1. Anchors per chunk; key-range tasks answer with one bit each: does it also occur in another document?
2. Spans of repeated anchors, each distinct span of a chunk once, go to the key-range tasks. There an enhanced suffix
   array over the spans is scanned with a stack; intervals with a common prefix of at least ``length`` whose occurrences
   differ in the byte to their left are the maximal repeat groups within spans, with all their occurrences.
3. Occurrences whose group holds a smaller document come back as ranges; chunks remove their bytes.

A passage that a third of all documents share sends one span per chunk, not one per document. An anchor with more than HOT
spans (a common phrase, with as many different contexts) would still bring them all to one task. Its windows are dealt
instead, by a hash of their own: first a bit each as for anchors, then a 128-bit digest and the least document of those
that occur again. So no task holds more than its range of hashes and HOT spans of an anchor, whatever is frequent.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.common import by_group, parts, small_batches, stash, trimmed

LENGTH, GRAM = 50, 20
#: Bytes of text in a chunk, windows that are sorted at once, and bytes of text hashed at once.
CHUNK_BYTES, SORTED_WINDOWS, BLOCK = 4 << 20, 50_000, 1 << 17
NO_ID = (1 << 63) - 1
_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
_POSITION = np.uint64((1 << 22) - 1)


#: Different spans of an anchor, summed over chunks, beyond which its windows are dealt (8 MB of spans); those in a chunk
#: from which they are counted.
HOT, MANY = 100_000, 16


def gram_hashes(block: np.ndarray, gram: int, base: int = int(_M2)) -> np.ndarray:
    """64-bit hash of each ``gram``-byte string, built from halves: h(2n)[i] = h(n)[i] * B**n + h(n)[i + n]."""
    with np.errstate(over="ignore"):
        power, size = block.astype(np.uint64) + np.uint64(1), 1
        out, done, left = None, 0, gram
        while left:
            if left & 1:
                shifted = power[done:]
                out = shifted.copy() if out is None else out[: len(shifted)] * np.uint64(pow(base, size, 1 << 64)) + shifted[: len(out)]
                done += size
            left >>= 1
            if left:
                power = power[: len(power) - size] * np.uint64(pow(base, size, 1 << 64)) + power[size:]
                size *= 2
        out = out[: len(block) - gram + 1]
        out = out ^ (out >> np.uint64(31))
        out *= _M1
        out ^= out >> np.uint64(29)
        out *= _M2
        out ^= out >> np.uint64(32)
    return out


def sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    size = 1
    while size * 2 <= width:
        values = np.minimum(values[: len(values) - size], values[size:])
        size *= 2
    rest = width - size
    return np.minimum(values[: len(values) - rest], values[rest:]) if rest else values


@dataclass
class Spans:
    """Maximal runs of windows with one anchor, in order: document, first byte and end within it, anchor, and a hash of the
    span's ends and length, by which most different spans differ."""

    doc: np.ndarray
    start: np.ndarray
    end: np.ndarray
    anchor: np.ndarray
    ends: np.ndarray


def remixed(hashes: np.ndarray) -> np.ndarray:
    """Other hashes for the same strings: least hashes are small, so they would all fall into the first key ranges."""
    with np.errstate(over="ignore"):
        out = (hashes + np.uint64(1)) * _M1
        return (out ^ (out >> np.uint64(32))) * _M2


def spans_of(texts: list[bytes], length: int = LENGTH, gram: int = GRAM) -> Spans:
    """The spans of each text. Texts are hashed in blocks; long ones in overlapping segments, whose windows are the same."""
    out: list[tuple[np.ndarray, ...]] = []
    held, marks, size = [], [], 0

    def flush() -> None:
        nonlocal held, marks, size
        if not held:
            return
        block = np.frombuffer(b"".join(held), np.uint8)
        hashes = gram_hashes(block, gram)
        tagged = (hashes & ~_POSITION) | np.arange(len(hashes), dtype=np.uint64)
        least = (sliding_least(tagged, length - gram + 1) & _POSITION).astype(np.int64)
        firsts = np.array([m[0] for m in marks])
        sizes = np.array([m[1] for m in marks]) - length + 1  # windows of each segment
        window = np.repeat(firsts - np.concatenate(([0], np.cumsum(sizes)[:-1])), sizes) + np.arange(sizes.sum())
        at = least[window]
        edge = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1])))
        last = np.concatenate((edge[1:], [len(at)])) - 1
        segment = np.repeat(np.arange(len(marks)), sizes)[edge]
        shift = np.array([m[3] for m in marks])[segment] - firsts[segment]
        with np.errstate(over="ignore"):
            ends = hashes[window[edge]] + hashes[window[last] + length - gram] * _M1 + (last - edge).astype(np.uint64)
        out.append((np.array([m[2] for m in marks])[segment], window[edge] + shift, window[last] + length + shift, remixed(hashes[at[edge]]), ends))
        held, marks, size = [], [], 0

    for k, t in enumerate(texts):
        for a in range(0, max(1, len(t) - length + 1), BLOCK):
            part = t[a : a + BLOCK + length - 1]
            if len(part) < length:
                continue
            if size + len(part) > 2 * BLOCK:
                flush()
            marks.append((size, len(part), k, a))
            held.append(part)
            size += len(part)
    flush()
    if not out:
        return Spans(*(np.empty(0, np.int64) for _ in range(3)), *(np.empty(0, np.uint64) for _ in range(2)))
    return Spans(*(np.concatenate(c) for c in zip(*out, strict=True)))


@dataclass
class Repeat:
    """A maximal repeat: all occurrences (segment, offset) of one string of ``length`` bytes."""

    length: int
    segments: np.ndarray
    offsets: np.ndarray


def maximal_repeats(segments: list[bytes], length: int = LENGTH) -> Iterator[Repeat]:
    """Maximal repeats of at least ``length`` bytes among segments, each with every occurrence.

    The suffixes that have ``length`` bytes are sorted with the common prefix of each and its neighbour (an enhanced
    suffix array, suffixes end with their segment). A stack holds the open common-prefix intervals; closing one yields
    it unless all its occurrences have the same byte to their left, for then a longer repeat holds them all.
    """
    segments = [s.replace(b"\0", b"\xff") for s in segments]  # 0xFF isn't in UTF-8, and 0 marks the ends here
    sizes = np.array([len(s) for s in segments], np.int64)
    counts = np.maximum(sizes - length + 1, 0)
    if counts.sum() < 2:
        return
    most = int(sizes.max())
    buffer = np.frombuffer(b"".join(s + b"\0" for s in segments) + b"\0" * most, np.uint8)
    heads = np.concatenate(([0], np.cumsum(sizes + 1)[:-1]))
    segment = np.repeat(np.arange(len(segments)), counts)
    offset = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
    if len(segment) <= SORTED_WINDOWS:
        yield from _scan(buffer, heads, sizes, segment, offset, length, most)
        return
    # suffixes whose first ``length`` bytes are equal have equal hashes: each class is an array of its own
    classes = gram_hashes(buffer, length)[heads[segment] + offset] % np.uint64(-(-len(segment) // SORTED_WINDOWS))
    by_class = np.argsort(classes, kind="stable")
    for part in np.split(by_class, np.flatnonzero(np.diff(classes[by_class])) + 1):
        yield from _scan(buffer, heads, sizes, segment[part], offset[part], length, most)


def _scan(buffer: np.ndarray, heads: np.ndarray, sizes: np.ndarray, segment: np.ndarray, offset: np.ndarray, length: int, most: int) -> Iterator[Repeat]:
    """Sort these suffixes, find common prefixes of neighbours and close intervals with a stack."""
    at = heads[segment] + offset
    table = np.lib.stride_tricks.sliding_window_view(buffer, most)[at]
    table[np.arange(most) >= (sizes[segment] - offset)[:, None]] = 0
    order = np.argsort(table.view(f"S{most}").ravel(), kind="stable")
    table, segment, offset, at = table[order], segment[order], offset[order], at[order]
    differ = table[1:] != table[:-1]
    common = np.where(differ.any(axis=1), differ.argmax(axis=1), most)
    left_over = sizes[segment] - offset
    common = np.minimum(common, np.minimum(left_over[1:], left_over[:-1]))
    left = np.where(offset > 0, buffer[at - 1].astype(np.int64), -1 - np.arange(len(at)))
    runs = np.flatnonzero(common >= length)
    if not len(runs):
        return
    breaks = np.flatnonzero(np.diff(runs) > 1)
    for a, b in zip(np.concatenate(([runs[0]], runs[breaks + 1])).tolist(), np.concatenate((runs[breaks], [runs[-1]])).tolist(), strict=True):
        before = left[a : b + 2]
        if before[0] >= 0 and (before == before[0]).all():
            continue
        heights = common[a : b + 1].tolist()
        changes = np.concatenate(([0], np.cumsum(before[1:] != before[:-1]))).tolist()
        stack = [(0, 0)]  # height and left end of the open intervals
        for k, height in enumerate([*heights, 0]):
            bound = k
            while stack[-1][0] > height:
                tall, bound = stack.pop()
                if before[bound] < 0 or changes[k] != changes[bound]:
                    yield Repeat(tall, segment[a + bound : a + k + 1], offset[a + bound : a + k + 1])
            if stack[-1][0] < height:
                stack.append((height, bound))


def _bucket(hashes: np.ndarray, buckets: int) -> np.ndarray:
    return ((hashes >> np.uint64(40)) * np.uint64(buckets) >> np.uint64(24)).astype(np.int64)


class Chunk:
    """A chunk's documents in id order with their spans; what one pass sends, the next finds again by the same order."""

    def __init__(self, rows: pa.Table, length: int, gram: int) -> None:
        ids = rows["doc_id"].to_pylist()
        texts = [t or b"" for t in rows["text"].to_pylist()]
        order = sorted(range(len(ids)), key=lambda k: (NO_ID if ids[k] is None else ids[k], texts[k]))
        self.order = order
        self.ids, self.texts = [ids[k] for k in order], [texts[k] for k in order]
        self.keys = np.array([NO_ID if i is None else i for i in self.ids], np.int64)
        self.spans = spans_of(self.texts, length, gram)
        by_hash = np.argsort(self.spans.anchor, kind="stable")
        sorted_ = self.spans.anchor[by_hash]
        head = np.concatenate(([True], sorted_[1:] != sorted_[:-1])) if len(sorted_) else np.empty(0, bool)
        first = np.flatnonzero(head)
        last = np.concatenate((first[1:], [len(sorted_)])) - 1 if len(first) else first
        self.anchors = sorted_[first]
        owners = self.keys[self.spans.doc[by_hash]] if len(sorted_) else np.empty(0, np.int64)
        self.shared = owners[first] != owners[last]  # in several documents of this chunk
        self.rank = np.empty(len(sorted_), np.int64)
        self.rank[by_hash] = np.cumsum(head) - 1

    def anchor_rows(self, buckets: int) -> Iterator[tuple[int, bytes, bytes, bytes]]:
        """(bucket, low bits, whether in several documents here, place and number of different spans where there are many)."""
        counts = np.zeros(len(self.anchors), np.int64)
        if len(self.rank):
            with np.errstate(over="ignore"):
                first = np.unique(remixed(self.rank.astype(np.uint64)) ^ self.spans.ends, return_index=True)[1]
            counts = np.bincount(self.rank[first], minlength=len(self.anchors))
        for bucket, a, b in _slices(_bucket(self.anchors, buckets)):
            many = np.flatnonzero(counts[a:b] >= MANY)
            yield bucket, _low(self.anchors[a:b]).tobytes(), np.packbits(self.shared[a:b]).tobytes(), np.stack([many, counts[a:b][many]], axis=1).astype(np.uint32).tobytes()

    def repeated(self, answers: pa.Table, buckets: int) -> tuple[np.ndarray, np.ndarray]:
        """Which anchors occur in another document, and which of them are hot, from the answers of the key-range tasks."""
        bucket, hot = _bucket(self.anchors, buckets), np.zeros(len(self.anchors), bool)
        for own, places in zip(answers["bucket"].to_pylist(), answers["hot"].to_pylist(), strict=True):
            if places:
                hot[np.searchsorted(bucket, own) + np.frombuffer(places, np.uint32)] = True
        return _told(answers, bucket), hot

    def distinct(self, repeated: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
        """Spans of repeated anchors; of each the index of its first equal; the bytes of each first."""
        found = np.flatnonzero(repeated[self.rank]) if len(self.rank) else np.empty(0, np.int64)
        doc, start, end = (x[found].tolist() for x in (self.spans.doc, self.spans.start, self.spans.end))
        seen: dict[bytes, int] = {}
        same = [seen.setdefault(self.texts[d][a:b], len(seen)) for d, a, b in zip(doc, start, end, strict=True)]
        return found, np.array(same, np.int64), list(seen)


def _low(hashes: np.ndarray) -> np.ndarray:
    return ((hashes >> np.uint64(8)) & np.uint64(0xFFFFFFFF)).astype(np.uint32)


def _slices(bucket: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(value, start, end) of the runs of ordered bucket numbers."""
    edges = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1], [True]))) if len(bucket) else []
    for a, b in zip(edges[:-1], edges[1:], strict=True):
        yield int(bucket[a]), int(a), int(b)


def _told(answers: pa.Table, bucket: np.ndarray) -> np.ndarray:
    """The answers' bits for items that are in order of their bucket."""
    out = np.zeros(len(bucket), bool)
    for own, bits in zip(answers["bucket"].to_pylist(), answers["bits"].to_pylist(), strict=True):
        a, b = np.searchsorted(bucket, [own, own + 1])
        out[a:b] = np.unpackbits(np.frombuffer(bits, np.uint8), count=b - a).astype(bool)
    return out


class Windows:
    """The windows of a chunk's distinct spans of hot anchors; each different window has a number in order of its hashes."""

    def __init__(self, own: Chunk, found: np.ndarray, same: np.ndarray, texts: list[bytes], hot: np.ndarray, length: int) -> None:
        first = found[np.unique(same, return_index=True)[1]] if len(same) else np.empty(0, np.int64)
        #: of the distinct spans, whether they are dealt by window, and their least document
        self.hot = hot[own.rank[first]] if len(first) else np.empty(0, bool)
        self.owners = own.keys[own.spans.doc[first]] if len(first) else np.empty(0, np.int64)
        numbers = np.flatnonzero(self.hot)
        out, held, size = [], [], 0
        for k, n in enumerate(numbers.tolist()):
            held.append(n)
            size += len(texts[n])
            if size > BLOCK or k + 1 == len(numbers):
                out.append(self._hashed(held, [texts[n] for n in held], length))
                held, size = [], 0
        self.span, self.offset, one, two = (np.concatenate(c) for c in zip(*out, strict=True)) if out else (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.uint64), np.empty(0, np.uint64))
        order = np.lexsort((two, one))
        one, two = one[order], two[order]
        head = np.concatenate(([True], (one[1:] != one[:-1]) | (two[1:] != two[:-1]))) if len(one) else np.empty(0, bool)
        self.number = np.empty(len(order), np.int64)
        self.number[order] = np.cumsum(head) - 1
        self.one, self.two = one[head], two[head]
        owner = self.owners[self.span]
        self.least, most = np.full(len(self.one), NO_ID), np.full(len(self.one), -NO_ID)
        np.minimum.at(self.least, self.number, owner)
        np.maximum.at(most, self.number, owner)
        self.shared = self.least != most

    @staticmethod
    def _hashed(numbers: list[int], texts: list[bytes], length: int) -> tuple[np.ndarray, ...]:
        block = np.frombuffer(b"".join(texts), np.uint8)
        sizes = np.array([len(t) for t in texts], np.int64)
        counts = sizes - length + 1
        offset = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
        at = np.repeat(np.cumsum(sizes) - sizes, counts) + offset
        return np.repeat(np.array(numbers, np.int64), counts), offset, gram_hashes(block, length)[at], gram_hashes(block, length, int(_M1))[at]

    def rows(self, buckets: int) -> Iterator[tuple[int, bytes, bytes, bytes]]:
        for bucket, a, b in _slices(_bucket(self.one, buckets)):
            yield bucket, _low(self.one[a:b]).tobytes(), np.packbits(self.shared[a:b]).tobytes(), b""

    def again(self, answers: pa.Table, buckets: int) -> np.ndarray:
        """Numbers of the windows that occur in another document, here or elsewhere."""
        return np.flatnonzero(_told(answers, _bucket(self.one, buckets)))

    def covered(self, again: np.ndarray, answers: pa.Table, buckets: int) -> tuple[np.ndarray, np.ndarray]:
        """(span, offset) of the windows that a smaller document has, in this chunk or (by the answers) in another one."""
        gone = np.zeros(len(self.one), bool)
        gone[again] = _told(answers, _bucket(self.one[again], buckets))
        hit = gone[self.number] | (self.owners[self.span] > self.least[self.number])
        return self.span[hit], self.offset[hit]


def remove_repeats(
    docs: DataFrame, length: int = LENGTH, gram: int = GRAM, id_col: str = "doc_id", text_col: str = "text", with_row: bool = False
) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans (array of start, end), and if asked
    kept (the text left, without what is left of a split character) and row (a struct of the document's other columns).

    Removed is each byte covered by a string of ``length`` bytes that also starts in a document with a smaller id; texts
    are judged as they came. Null text is empty; a null id counts as larger than any other; rows that repeat an id are
    one document to each other (none removes from the other); other columns are ignored; no rows give no rows.
    """
    small_batches(docs.sparkSession, 256)  # rows here hold texts and packed spans
    total = docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    chunks = buckets = max(parts(docs.sparkSession), -(-total // CHUNK_BYTES))
    others = [F.col(f"`{c}`") for c in docs.columns if c != text_col]
    dealt = docs.select(
        *[F.struct(*others).alias("row")] * with_row, F.pmod(F.xxhash64(F.col(id_col), F.col(text_col)), F.lit(chunks)).cast("long").alias("chunk"), F.col(id_col).cast("long").alias("doc_id"), F.encode(F.coalesce(text_col, F.lit("")), "UTF-8").alias("text")
    ).repartition(chunks, "chunk")

    asked = "bucket long, chunk long, low binary, shared binary, many binary"

    def question(chunk: int, sent: list[tuple]) -> pa.Table:
        bucket, *rest = zip(*sent, strict=True) if sent else ((), (), (), ())
        return pa.table({"bucket": pa.array(bucket, pa.int64()), "chunk": pa.array([chunk] * len(sent), pa.int64()), **{c: pa.array(v, pa.binary()) for c, v in zip(("low", "shared", "many"), rest, strict=True)}})

    def anchors(rows: pa.Table) -> pa.Table:
        return question(rows["chunk"][0].as_py(), list(Chunk(rows, length, gram).anchor_rows(buckets)))

    def answer(bucket: int, rows: pa.Table) -> pa.RecordBatch:
        low = [np.frombuffer(x, np.uint32) for x in rows["low"].to_pylist()]
        sizes = [len(x) for x in low]
        heads = np.cumsum(sizes) - sizes
        flags = np.concatenate([np.unpackbits(np.frombuffer(x, np.uint8), count=n) for x, n in zip(rows["shared"].to_pylist(), sizes, strict=True)]).astype(bool)
        values, spans = np.concatenate(low), np.ones(len(flags), np.int64)
        for head, many in zip(heads.tolist(), rows["many"].to_pylist(), strict=True):
            if many:
                place, n = np.frombuffer(many, np.uint32).reshape(-1, 2).T
                spans[head + place] = n
        order = np.argsort(values, kind="stable")
        ordered = values[order]
        first = np.flatnonzero(np.concatenate(([True], ordered[1:] != ordered[:-1])))
        counts = np.diff(np.concatenate((first, [len(ordered)])))
        flags[order[np.repeat(counts > 1, counts)]] = True
        crowd = np.zeros(len(flags), bool)
        crowd[order] = np.repeat(np.add.reduceat(spans[order], first) > HOT, counts)
        crowd &= flags
        ends = np.cumsum(sizes)[:-1]
        bits = [np.packbits(x).tobytes() for x in np.split(flags, ends)]
        hot = [np.flatnonzero(x).astype(np.uint32).tobytes() for x in np.split(crowd, ends)]
        return pa.RecordBatch.from_arrays([rows["chunk"].combine_chunks(), pa.array([bucket] * len(bits), pa.int64()), pa.array(bits, pa.binary()), pa.array(hot, pa.binary())], ["chunk", "bucket", "bits", "hot"])

    told = "chunk long, bucket long, bits binary, hot binary"
    grouped = dealt.groupBy("chunk")
    # written once: later passes read the bits, and no stage holds two of these operators
    sent = grouped.applyInArrow(trimmed(anchors), asked)
    answers = stash(by_group(sent, "bucket", trimmed(answer), told, buckets), "anchor-bits").withColumn("level", F.lit(0))

    def at_level(rows: pa.Table, level: int) -> pa.Table:
        return rows.filter(pa.compute.equal(rows["level"], level)) if rows.num_rows else rows

    def opened(rows: pa.Table, back: pa.Table) -> tuple[Chunk, np.ndarray, np.ndarray, list[bytes], Windows]:
        own = Chunk(rows, length, gram)
        repeated, hot = own.repeated(at_level(back, 0), buckets)
        found, same, texts = own.distinct(repeated)
        return own, found, same, texts, Windows(own, found, same, texts, hot, length)

    def windows(rows: pa.Table, back: pa.Table) -> pa.Table:
        if not rows.num_rows or not back.num_rows or not any(back["hot"].to_pylist()):
            return question(0, [])
        return question(rows["chunk"][0].as_py(), list(opened(rows, back)[-1].rows(buckets)))

    if not answers.filter("length(hot) > 0").isEmpty():
        asked_again = grouped.cogroup(answers.groupBy("chunk")).applyInArrow(trimmed(windows), asked)
        again = stash(by_group(asked_again, "bucket", trimmed(answer), told, buckets), "window-bits")
        answers = answers.unionByName(again.withColumns({"level": F.lit(1), "hot": F.lit(None).cast("binary")}))

    def spans(rows: pa.Table, back: pa.Table) -> pa.Table:
        out = {"bucket": [], "chunk": [], "number": [], "owner": [], "size": [], "spans": []}
        if rows.num_rows and back.num_rows:
            own, found, same, texts, dealt_windows = opened(rows, back)
            chunk = rows["chunk"][0].as_py()
            first = np.unique(same, return_index=True)[1]
            owner, anchor = own.keys[own.spans.doc[found[first]]], own.spans.anchor[found[first]]
            bucket = _bucket(anchor, buckets)
            order = np.argsort(bucket, kind="stable")
            order = order[~dealt_windows.hot[order]]
            for b, x, y in _slices(bucket[order]):
                part = order[x:y]
                strings = [texts[k] for k in part.tolist()]
                row = b, chunk, part.astype(np.uint32).tobytes(), owner[part].tobytes(), np.array([len(s) for s in strings], np.uint16).tobytes(), b"".join(strings)
                for column, value in zip(out.values(), row, strict=True):
                    column.append(value)
            some = dealt_windows.again(at_level(back, 1), buckets)
            one, two = dealt_windows.one[some], dealt_windows.two[some]
            for b, x, y in _slices(_bucket(one, buckets)):  # windows: no numbers, digests instead of spans
                row = b, chunk, None, dealt_windows.least[some[x:y]].tobytes(), None, np.stack([one[x:y], two[x:y]], axis=1).tobytes()
                for column, value in zip(out.values(), row, strict=True):
                    column.append(value)
        kinds = [pa.int64(), pa.int64(), *[pa.binary()] * 4]
        return pa.table({c: pa.array(v, t) for (c, v), t in zip(out.items(), kinds, strict=True)})

    candidates = grouped.cogroup(answers.groupBy("chunk")).applyInArrow(trimmed(spans), "bucket long, chunk long, number binary, owner binary, size binary, spans binary")

    def judge_windows(bucket: int, rows: pa.Table) -> list[tuple]:
        digests = [np.frombuffer(x, np.uint64).reshape(-1, 2) for x in rows["spans"].to_pylist()]
        sizes = [len(x) for x in digests]
        if not sizes:
            return []
        every, owner = np.concatenate(digests), np.concatenate([np.frombuffer(x, np.int64) for x in rows["owner"].to_pylist()])
        order = np.lexsort((every[:, 1], every[:, 0]))
        ordered = every[order]
        first = np.flatnonzero(np.concatenate(([True], (ordered[1:] != ordered[:-1]).any(axis=1))))
        counts = np.diff(np.concatenate((first, [len(ordered)])))
        later = np.empty(len(every), bool)
        later[order] = owner[order] > np.repeat(np.minimum.reduceat(owner[order], first), counts)
        return [(c, bucket, np.packbits(x).tobytes(), None, None, None) for c, x in zip(rows["chunk"].to_pylist(), np.split(later, np.cumsum(sizes)[:-1]), strict=True)]

    def judge(bucket: int, rows: pa.Table) -> pa.RecordBatch | None:
        of_spans = pa.compute.is_valid(rows["number"])
        out = judge_windows(bucket, rows.filter(pa.compute.invert(of_spans))) + judge_spans(rows.filter(of_spans))
        if not out:
            return None
        names, kinds = ["chunk", "bucket", "bits", "number", "offset", "size"], [pa.int64(), pa.int64(), *[pa.binary()] * 4]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names)

    def judge_spans(rows: pa.Table) -> list[tuple]:
        strings, owners, row, number = [], [], [], []
        if not rows.num_rows:
            return []
        for k, r in enumerate(rows.to_pylist()):
            sizes = np.frombuffer(r["size"], np.uint16).astype(np.int64)
            ends = np.cumsum(sizes)
            strings += [r["spans"][e - n : e] for e, n in zip(ends.tolist(), sizes.tolist(), strict=True)]
            owners.append(np.frombuffer(r["owner"], np.int64))
            number.append(np.frombuffer(r["number"], np.uint32))
            row.append(np.full(len(sizes), k))
        owner, row, number = np.concatenate(owners), np.concatenate(row), np.concatenate(number)
        known: dict[bytes, int] = {}
        which = np.array([known.setdefault(s, len(known)) for s in strings], np.int64)
        least = np.full(len(known), NO_ID, np.int64)
        np.minimum.at(least, which, owner)
        whole = np.flatnonzero(owner > least[which])  # equal to a span of a smaller document
        lengths = np.array([len(x) for x in strings], np.int64)
        parts = [(whole, np.zeros(len(whole), np.int64), lengths[whole])]
        keep = np.flatnonzero(owner == least[which])
        keep = keep[np.argsort(which[keep], kind="stable")]
        texts = list(known)
        for group in _by_anchor(texts, length, gram):
            ids = np.array(group, np.int64)
            span, start, end = _covered([texts[g] for g in group], least[ids], length)
            first, last = np.searchsorted(which[keep], ids[span]), np.searchsorted(which[keep], ids[span], side="right")
            n = last - first  # a span may be the least one of a document more than once
            own = np.repeat(first - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum()) if len(n) else first
            parts.append((keep[own], np.repeat(start, n), np.repeat(end - start, n)))
        index, offset, size = (np.concatenate(c) for c in zip(*parts, strict=True))
        offset, size = offset.astype(np.uint16), size.astype(np.uint16)
        order = np.argsort(row[index], kind="stable")
        index, offset, size = index[order], offset[order], size[order]
        chunk = rows["chunk"].to_pylist()
        return [(chunk[k], None, None, number[index[a:b]].tobytes(), offset[a:b].tobytes(), size[a:b].tobytes()) for k, a, b in _slices(row[index])]

    ranges = stash(by_group(candidates, "bucket", trimmed(judge), "chunk long, bucket long, bits binary, number binary, offset binary, size binary", buckets), "repeat-ranges")
    back = answers.withColumns({c: F.lit(None).cast("binary") for c in ("number", "offset", "size")}).unionByName(
        ranges.withColumns({"level": F.when(F.col("number").isNull(), 2).otherwise(3), "hot": F.lit(None).cast("binary")})
    )

    def cut(rows: pa.Table, back: pa.Table) -> pa.Table:
        out: dict[str, list] = {c: [] for c in ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans", *["kept"] * with_row)}
        if rows.num_rows:
            own, found, same, _, dealt_windows = opened(rows, back)
            heads = np.concatenate(([0], np.cumsum([len(t) for t in own.texts]))).astype(np.int64)
            depth = np.zeros(heads[-1] + 1, np.int32)
            if len(found):
                first = found[np.unique(same, return_index=True)[1]]
                later = own.keys[own.spans.doc[found]] > own.keys[own.spans.doc[first[same]]]
                at = heads[own.spans.doc] + own.spans.start
                np.add.at(depth, at[found[later]], 1)
                np.add.at(depth, (heads[own.spans.doc] + own.spans.end)[found[later]], -1)
                # documents that repeat their own span, or rows that repeat an id, share the first's verdict
                equals = found[~later]
                lists: dict[int, list[int]] = {}
                for k, s in zip(equals.tolist(), same[~later].tolist(), strict=True):
                    lists.setdefault(s, []).append(k)
                for r in at_level(back, 3).select(["number", "offset", "size"]).to_pylist():
                    number, offset, size = np.frombuffer(r["number"], np.uint32), np.frombuffer(r["offset"], np.uint16), np.frombuffer(r["size"], np.uint16)
                    for n, o, z in zip(number.tolist(), offset.tolist(), size.tolist(), strict=True):
                        for k in lists[n]:
                            depth[at[k] + o] += 1
                            depth[at[k] + o + z] -= 1
                some = dealt_windows.again(at_level(back, 1), buckets)
                for n, o in zip(*(x.tolist() for x in dealt_windows.covered(some, at_level(back, 2), buckets)), strict=True):
                    for k in lists[n]:
                        depth[at[k] + o] += 1
                        depth[at[k] + o + length] -= 1
            gone = np.cumsum(depth[:-1]) > 0
            for k, t in enumerate(own.texts):
                mask = gone[heads[k] : heads[k + 1]]
                edges = np.flatnonzero(np.diff(np.concatenate(([False], mask, [False])).astype(np.int8)))
                kept = np.frombuffer(t, np.uint8)[~mask].tobytes() if len(edges) else t
                out["doc_id"].append(own.ids[k])
                out["n_bytes"].append(len(t))
                out["n_removed"].append(len(t) - len(kept))
                out["n_spans"].append(len(edges) // 2)
                out["kept_sha256"].append(hashlib.sha256(kept).hexdigest())
                out["spans"].append([{"start": a, "end": b} for a, b in edges.reshape(-1, 2).tolist()])
                if with_row:
                    out["kept"].append(kept.decode("utf-8", "ignore"))
        kinds = [*[pa.int64()] * 4, pa.string(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])), *[pa.string()] * with_row]
        found = pa.table({c: pa.array(v, t) for (c, v), t in zip(out.items(), kinds, strict=True)})
        if with_row and rows.num_rows:
            row = rows["row"].combine_chunks().take(pa.array(own.order))
            found = found.append_column("row", pa.StructArray.from_arrays(row.flatten(), names=[f.name for f in row.type]))
        return found

    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<struct<start:long,end:long>>" + f", kept string, row {dealt.schema['row'].dataType.simpleString() if with_row else ''}" * with_row
    return grouped.cogroup(back.groupBy("chunk")).applyInArrow(trimmed(cut), schema)


def _covered(texts: list[bytes], owner: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, start, end) of the bytes that a repeat covers whose group has a text of a smaller owner.

    Shorter repeats are closed after the longer ones in them, so each position keeps its first, longest one."""
    heads = np.concatenate(([0], np.cumsum([len(t) + 1 for t in texts]))).astype(np.int64)
    cover = np.zeros(heads[-1], np.int64)
    for repeat in maximal_repeats(texts, length):
        own = owner[repeat.segments]
        at = (heads[repeat.segments] + repeat.offsets)[own > own.min()]
        cover[at] = np.maximum(cover[at], repeat.length)
    starts = np.flatnonzero(cover)
    depth = np.zeros(heads[-1] + 1, np.int64)
    np.add.at(depth, starts, 1)
    np.add.at(depth, starts + cover[starts], -1)
    edges = np.flatnonzero(np.diff(np.concatenate(([False], np.cumsum(depth) > 0, [False])).astype(np.int8)))
    begin, end = edges[::2], edges[1::2]
    text = np.searchsorted(heads, begin, side="right") - 1
    return text, begin - heads[text], end - heads[text]


def _by_anchor(texts: list[bytes], length: int, gram: int) -> Iterator[list[int]]:
    """Indexes of spans, split into batches of bounded size that no repeat crosses; anchors with one span are left out."""
    own = spans_of(texts, length, gram)
    # each text is one span, or was cut at another text's length limit; its anchor is that of its first window
    anchor = np.zeros(len(texts), np.uint64)
    anchor[own.doc[::-1]] = own.anchor[::-1]
    order = np.argsort(anchor, kind="stable")
    edges = np.concatenate(([0], np.flatnonzero(np.diff(anchor[order])) + 1, [len(order)]))
    held, windows = [], 0
    for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
        if b - a < 2:
            continue
        group = order[a:b].tolist()
        held += group
        windows += sum(len(texts[g]) - length + 1 for g in group)
        if windows > SORTED_WINDOWS:
            yield held
            held, windows = [], 0
    if held:
        yield held


def drop_repeats(docs: DataFrame, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with the repeated bytes cut out of the text (what is left of a split character is dropped too) and
    ``n_chars``, if there is one, counted anew. Every row stays, with its other columns."""
    found = remove_repeats(docs, length, id_col=id_col, text_col=text_col, with_row=True)
    own = {c: F.col("row").getField(c) for c in docs.columns if c != text_col} | {text_col: F.col("kept")}
    if "n_chars" in own:
        own["n_chars"] = F.char_length("kept").cast(docs.schema["n_chars"].dataType)
    return found.select(*[own[c].alias(c) for c in docs.columns])
