"""Packing (4): mixture-controlled packing by deficit round-robin over source queues.

Every source is a queue of token streams. Tokens are offered to the queues in turn (:func:`deal`): a queue's deficit grows
by its weight with each offer and pays for a token when it reaches the weight of the queues from it on, else the offer
goes to the next queue. Deficits are carried from window to window (one sequence of 4096 tokens), so every window has the
target proportions to within a token per queue. The counters after any number of tokens have a closed form
(:func:`carried`), so a task that starts in the middle of the corpus knows them without hearing from other tasks, and each
document finds its windows on its own: no shuffle of texts, no group in one task. A queue that runs dry ends a phase; the
others share its part from then on, with new counters.
"""

from __future__ import annotations

import array
import itertools
import json
import os
import re
import sys
import zlib
from collections.abc import Callable, Iterable, Iterator, Mapping
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ledgerloom.llm.common import CACHES, lean, scratch_path, small_batches, stash

WINDOW = 4096
#: Queues that one level of the schedule deals to; of more sources the smaller ones have a level of their own below it.
MAX_QUEUES = 512
#: Sums per task and queue are broadcast up to this number of rows, and joined by shuffle beyond it.
BROADCAST_SUMS = 100_000
REST = "\x00rest"
#: Targets by which all sources that have tokens left share alike.
EQUAL = "equal"


#: The tokenizer's own word pattern, and what it amounts to below U+0100; both must agree for words to be cut here.
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
LATIN_WORDS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zªµºß-öø-ÿ]+|[0-9²³¹¼-¾]|[^\s0-9a-zªµºß-öø-ÿ²³¹¼-¾]+")
LATIN = re.compile("[\x00-\x1b\x20-\xff]*")
#: The usual form of a chunk in lower case: two words of the pattern.
WORD_AND_MARKS = r"^(?P<word>[a-z]+)(?P<marks>[.,;:!?]*)$"


def byte_letters() -> list[str]:
    """The letter that stands for each byte in byte-level vocabularies: itself if it can be seen, else one from U+0100 on."""
    seen = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    hidden = [b for b in range(256) if b not in seen]
    return [chr(b) if b in seen else chr(0x100 + hidden.index(b)) for b in range(256)]


class Chunks(dict):
    """Ids by chunk; a chunk that is looked up first is encoded, and kept unless it is long. Two generations are kept: what
    is looked up again when the newer one is full moves on to the next."""

    def __init__(self, encode: Callable[[str], bytes], longest: int) -> None:
        super().__init__()
        self.encode, self.longest = encode, longest
        self.before: dict[str, bytes] = {}

    def __missing__(self, chunk: str) -> bytes:
        if (ids := self.before.get(chunk)) is None:
            ids = self.encode(chunk)
        if len(chunk) <= self.longest:
            self[chunk] = ids
        return ids

    def bound(self, most: int) -> None:
        """Begin a generation if there are more than ``most`` in this one."""
        if len(self) > most:
            self.before = dict(self)
            self.clear()


class ChunkTokenizer:
    """Exact ids of whole texts by way of bounded caches of chunks between blanks and of the words in them.

    Valid for tokenizers whose pre-tokenizer drops white space and never crosses it, as ``word_bpe_49k.json`` does. New
    chunks of Latin letters are cut into words here, so only words that are new go through the merges; other chunks go
    through the whole tokenizer.
    """

    CHUNKS, WORDS, LONGEST = 20_000, 100_000, 40
    #: Bytes of texts that are cut into chunks at once, but for a text that is longer.
    PART = 1 << 21

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.width = "<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4"
        self.code = "H" if self.width == "<u2" else "I"
        setup = json.loads(self.tokenizer.to_str())
        own = json.dumps(WORD_PATTERN) in json.dumps(setup["pre_tokenizer"]) and "Lowercase" in json.dumps(setup["normalizer"])
        self.by_word = own and sys.byteorder == "little"
        self.letters = byte_letters()
        self.model = self.tokenizer.model
        self.known = Chunks(self._chunk if self.by_word else self._whole, self.LONGEST)
        self.words = Chunks(self._word, self.LONGEST)

    def _whole(self, chunk: str) -> bytes:
        return np.array(self.tokenizer.encode(chunk, add_special_tokens=False).ids, self.width).tobytes()

    def _word(self, word: str) -> bytes:
        spelt = word if word.isascii() and word.isprintable() else "".join([self.letters[b] for b in word.encode()])
        return array.array(self.code, [t.id for t in self.model.tokenize(spelt)]).tobytes()

    def _chunk(self, chunk: str) -> bytes:
        if "<|" in chunk or not ((chunk.isascii() and chunk.isprintable()) or LATIN.fullmatch(chunk)):
            return self._whole(chunk)
        return b"".join(map(self.words.__getitem__, LATIN_WORDS.findall(chunk.lower())))

    def _parts(self, chunks: pa.Array) -> tuple[list[bytes], np.ndarray, np.ndarray]:
        """Strings of ids, and of each chunk the two of them that it consists of: a plain word and the marks after it, or
        the whole chunk and nothing."""
        if not self.by_word:
            return [*map(self.known.__getitem__, chunks.to_pylist()), b""], np.arange(len(chunks)), np.full(len(chunks), len(chunks))
        split = pc.extract_regex(chunks, WORD_AND_MARKS)
        word, marks = (pc.struct_field(split, [k]).dictionary_encode() for k in (0, 1))
        plain = split.is_valid().to_numpy(zero_copy_only=False)
        others = chunks.filter(pa.array(~plain))
        listed = [x.to_numpy(zero_copy_only=False).tolist() for x in (word.dictionary, marks.dictionary, others)]
        ids = [*map(self.words.__getitem__, listed[0]), *[self.words[m] if m else b"" for m in listed[1]], *map(self.known.__getitem__, listed[2]), b""]
        first, second = np.empty(len(chunks), np.int64), np.full(len(chunks), len(ids) - 1)
        first[plain] = word.indices.drop_null().to_numpy()
        second[plain] = marks.indices.drop_null().to_numpy() + len(listed[0])
        first[~plain] = np.arange(len(listed[2])) + len(listed[0]) + len(listed[1])
        return ids, first, second

    def encode(self, texts: pa.Array, end: int | None) -> pa.Array:
        """Each text's ids as little-endian integers of ``width``, with ``end`` after them; null is empty.

        A batch goes through in parts of ``PART`` bytes, which bounds what a worker holds besides the ids.
        """
        lengths = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        part = (np.cumsum(lengths) - lengths) // self.PART
        cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(texts)]
        return pa.concat_arrays([self._encode(texts[a:b], end) for a, b in itertools.pairwise(cuts)])

    def _encode(self, texts: pa.Array, end: int | None) -> pa.Array:
        """Ids of one part: it is cut into chunks at once; each distinct word is looked up once, and the ids are gathered by
        number. A-Z are lower-cased before, as the tokenizer would do.
        """
        self.known.bound(self.CHUNKS)
        self.words.bound(self.WORDS)
        low = pc.ascii_lower(pc.fill_null(texts, "")) if self.by_word else pc.fill_null(texts, "")
        lists = pc.split_pattern(pc.replace_substring(low, "\n", " "), " ")
        numbered = lists.flatten().dictionary_encode()
        strings, first, second = self._parts(numbered.dictionary)
        ids = np.frombuffer(b"".join(strings), self.width)
        lengths = np.fromiter(map(len, strings), np.int64, len(strings)) // ids.itemsize
        number = numbered.indices.to_numpy()
        parts = np.stack([first[number], second[number]], axis=1).ravel()
        own = lengths[parts]
        ends = np.cumsum(own)
        at = np.repeat((np.cumsum(lengths) - lengths)[parts] - (ends - own), own)
        at += np.arange(len(at))
        heads = lists.offsets.to_numpy().astype(np.int64) - lists.offsets[0].as_py()
        tails = np.concatenate(([0], ends))[2 * heads]  # ids before each text, and all of them
        out = ids[at]
        if end is not None:
            out = np.insert(out, tails[1:], end)
            tails = tails + np.arange(len(tails))
        return pa.Array.from_buffers(pa.large_binary(), len(texts), [None, pa.py_buffer(tails * ids.itemsize), pa.py_buffer(np.ascontiguousarray(out))])

    def encode_batch(self, texts: list[str], end: int | None) -> list[bytes]:
        return self.encode(pa.array(texts, pa.string()), end).to_pylist()


@lru_cache(maxsize=2)
def tokenizer_at(path: str) -> ChunkTokenizer:
    return ChunkTokenizer(path)


CACHES["tokens"] = tokenizer_at.cache_clear


@dataclass(frozen=True)
class Phase:
    start: int  # tokens packed before it
    weights: tuple[int, ...]
    before: tuple[int, ...]  # tokens served from each queue before it


@dataclass
class Schedule:
    """Which tokens of which queue fill which window."""

    phases: tuple[Phase, ...]
    total: int
    window: int = WINDOW
    keep: int = 1_000_000  # numbers that are remembered
    below: dict[int, Schedule] = field(default_factory=dict, repr=False, compare=False)  # groups of queues, dealt as one here
    _seen: dict[int, tuple[int, ...]] = field(default_factory=dict, repr=False, compare=False)

    @staticmethod
    def planned(totals: list[int], targets: list[float] | None = None, window: int = WINDOW) -> Schedule:
        """Targets: wanted proportions of tokens, by default those of the queues; each phase ends where a queue runs dry."""
        if targets is None:
            return Schedule((Phase(0, tuple(totals), (0,) * len(totals)),), sum(totals), window)
        return Schedule.weighted(totals, scaled_targets(targets, totals), window)

    @staticmethod
    def weighted(totals: list[int], scaled: list[int], window: int = WINDOW) -> Schedule:
        left, served, start, phases = list(totals), [0] * len(totals), 0, []
        while any(left):
            weights = [w if n else 0 for w, n in zip(scaled, left, strict=True)]
            all_w, spare = sum(weights), len(left)
            length = min((n - spare) * all_w // w for n, w in zip(left, weights, strict=True) if w)
            if length <= 0:  # the queue that is all but dry is served out
                last = min((n * all_w // w, k) for k, (n, w) in enumerate(zip(left, weights, strict=True)) if w)[1]
                weights, length = [int(k == last) for k in range(len(left))], left[last]
            phases.append(Phase(start, tuple(weights), tuple(served)))
            for k, n in enumerate(carried(length, weights)[0]):
                served[k] += n
                left[k] -= n
            start += length
        return Schedule(tuple(phases), start, window)

    @staticmethod
    def tiered(totals: list[int], targets: list[float] | None = None, window: int = WINDOW, most: int = MAX_QUEUES) -> tuple[Schedule, list[tuple[int, ...]]]:
        """The schedule of any number of queues, and each one's path in it: the first ``most`` queues are dealt to directly,
        the others in at most ``most`` groups, each with the sum of its queues' tokens and weights and a schedule of its own
        for the tokens that it gets."""
        weights = totals if targets is None else scaled_targets(targets, totals)

        def level(members: list[int]) -> tuple[Schedule, dict[int, tuple[int, ...]]]:
            rest = members[most:]
            size = max(1, -(-len(rest) // most))
            groups = [rest[k : k + size] for k in range(0, len(rest), size)]
            parts = [[k] for k in members[:most]] + groups
            sums = [[sum(c[k] for k in part) for part in parts] for c in (totals, weights)]
            own = Schedule((Phase(0, tuple(sums[0]), (0,) * len(parts)),), sum(sums[0]), window) if targets is None else Schedule.weighted(*sums, window)
            paths = {k: (place,) for place, k in enumerate(members[:most])}
            for place, part in enumerate(groups, len(members[:most])):
                if len(part) == 1:
                    paths[part[0]] = (place,)
                    continue
                own.below[place], inner = level(part)
                own.below[place].keep = 4_000
                paths.update({k: (place, *path) for k, path in inner.items()})
            return own, paths

        top, paths = level(list(range(len(totals))))
        return top, [paths[k] for k in range(len(totals))]

    def reached(self, w: int, path: tuple[int, ...]) -> tuple[int, int]:
        """Tokens taken from a queue in the windows before ``w``, and those from all queues that come before it."""
        served, at = self.served(w), path[0]
        n, ahead, node = served[at], sum(served[:at]), self
        for k in path[1:]:
            node = node.below[at]
            served, at = node.dealt(n), k
            n, ahead = served[at], ahead + sum(served[:at])
        return n, ahead

    def served(self, w: int) -> tuple[int, ...]:
        """Tokens taken from each queue of this level in the windows before ``w``."""
        return self.dealt(min(w * self.window, self.total))

    def dealt(self, tokens: int) -> tuple[int, ...]:
        """Tokens taken from each queue of this level when it has dealt ``tokens``."""
        if (found := self._seen.get(tokens)) is None:
            p = next((p for p in reversed(self.phases) if p.start <= tokens), self.phases[0])
            found = tuple(b + n for b, n in zip(p.before, carried(tokens - p.start, p.weights)[0], strict=True))
            if len(self._seen) * len(p.weights) > self.keep:
                self._seen.clear()
            self._seen[tokens] = found
        return found

    def window_of(self, path: tuple[int, ...], position: int) -> int:
        """The window that takes this token of the queue, by binary search over the carried state."""
        low, high = 0, -(-self.total // self.window)
        while high - low > 1:
            mid = (low + high) // 2
            low, high = (mid, high) if self.reached(mid, path)[0] <= position else (low, mid)
        return low

    def pieces(self, path: int | tuple[int, ...], first: int, n: int, near: int = 0) -> Iterator[tuple[int, int, int, int]]:
        """(start in the document, length, sequence, offset there) of a document that holds [first, first + n) of a queue."""
        last = self.total // self.window  # the window that is not full, if any
        path = (path,) if isinstance(path, int) else path
        w = near if self.reached(near, path)[0] <= first < self.reached(near + 1, path)[0] else self.window_of(path, first)
        done = 0
        while done < n:
            (a, ahead), (b, ahead_next) = self.reached(w, path), self.reached(w + 1, path)
            take = min(n - done, b - first - done)
            if take > 0:
                at = ahead_next - ahead + first + done - a
                if w < last:
                    yield done, take, w, at
                else:
                    yield from ((done + s, m, q, o) for s, m, q, o in self._tail(at, take))
                done += take
            w += 1

    def _tail(self, at: int, n: int) -> Iterator[tuple[int, int, int, int]]:
        """The last tokens form sequences whose lengths are powers of two, so they need no padding."""
        rest, start, sequence, done = self.total % self.window, 0, self.total // self.window, 0
        for bit in reversed(range(rest.bit_length())):
            if rest >> bit & 1:
                size = 1 << bit
                if done < n and start <= at + done < start + size:
                    take = min(n - done, start + size - at - done)
                    yield done, take, sequence, at + done - start
                    done += take
                start += size
                sequence += 1


def scaled_targets(targets: list[float], totals: list[int]) -> list[int]:
    """Whole weights, in millionths, of queues that have tokens; at least one each."""
    whole = sum(targets) or 1.0
    return [max(1, round(t * 1_000_000 / whole)) if n else 0 for t, n in zip(targets, totals, strict=True)]


def deal(weights: list[int], deficits: list[int]) -> int:
    """The queue that the next token is served from; ``deficits`` are carried on in place."""
    rest = sum(weights)
    for k, w in enumerate(weights):
        deficits[k] += w
        if w and deficits[k] >= rest:
            deficits[k] -= rest
            return k
        rest -= w
    raise ValueError("no queue has a weight")


def carried(tokens: int, weights: Iterable[int]) -> tuple[list[int], list[int]]:
    """Tokens served from each queue, and the deficits, after ``tokens`` calls of :func:`deal`: of n offers to a queue
    n * weight // rest are taken, and the remainder is what it carries. The served ones sum to ``tokens`` and never fall as
    it grows."""
    weights, served, deficits = list(weights), [], []
    rest = sum(weights)
    for w in weights:
        due, carry = divmod(tokens * w, rest) if rest else (0, 0)
        served.append(due)
        deficits.append(carry)
        tokens -= due
        rest -= w
    return served, deficits


def pack_documents(
    docs: DataFrame, tokenizer: str, end_id: int | None = 2, targets: Mapping[str, float] | str | None = None,
    id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", window: int = WINDOW,
) -> DataFrame:
    """One row per piece: doc_id, source, start, length, ids_crc32, doc_tokens, sequence_id, offset, ids (packed integers).

    ``tokenizer``: path of a tokenizers file that every machine has. ``targets``: wanted shares by source ('' is the null
    source; 0 where none is given: those come last), EQUAL for equal shares, None for those that the sources have. Null text is empty (its end id alone; no piece
    without an end id); a null source is a queue of its own; repeated rows are packed once each; ids may be null and
    other columns are ignored; no rows give no rows. Every token lies in exactly one piece, sequences are full but for
    the last window, which is cut at powers of two.
    """
    spark = docs.sparkSession
    small_batches(spark)
    path = scratch_path(spark, "tokens")

    def tokenise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = tokenizer_at(tokenizer)
        size = np.dtype(own.width).itemsize
        tag, sums = TaskContext.get().partitionId(), {}  # names this task's rows in the table that is written once
        for batch in batches:
            ids, texts, sources = (batch.column(k) for k in range(3))
            packed = own.encode(texts, end_id)
            n = (pc.binary_length(packed).to_numpy(zero_copy_only=False) // size).tolist()
            starts = []
            for s, k in zip(queues := [REST if s is None else s for s in sources.to_pylist()], n, strict=True):
                starts.append(sums.get(s, 0))
                sums[s] = starts[-1] + k
            yield pa.RecordBatch.from_arrays(
                [ids, sources, pa.array(queues), pa.array([tag] * len(n), pa.int64()), pa.array(starts, pa.int64()), pa.array(n, pa.int64()), packed.cast(pa.binary())],
                ["doc_id", "source", "queue", "tag", "start", "n", "ids"],
            )

    picked = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.col(source_col).cast("string").alias("source"))
    schema = "doc_id long, source string, queue string, tag long, start long, n long, ids binary"
    picked.select("doc_id", "text", "source").mapInArrow(lean(tokenise, "tokens"), schema).write.option("compression", "zstd").parquet(path)
    tokens = spark.read.schema(schema).parquet(path)

    sums = stash(tokens.groupBy("queue", "tag").agg(F.sum("n").alias("n")), "queue-sums")
    # One name and number per source reach the driver; those with a target come first, then the largest.
    found = [(r.queue, r.n) for r in sums.groupBy("queue").agg(F.sum("n").alias("n")).collect()]
    target = {q: 1.0 if targets == EQUAL else (targets or {}).get("" if q == REST else q, 0.0) for q, _ in found}
    found.sort(key=lambda e: (not target[e[0]], -e[1], e[0]))
    plan, paths = Schedule.tiered([n for _, n in found], None if targets is None else [target[q] for q, _ in found], window)
    # By Arrow, for rows of plain Python would start workers of their own beside those that have texts.
    numbers = spark.createDataFrame(pa.table({"queue": pa.array([q for q, _ in found], pa.string()), "k": pa.array(range(len(found)), pa.int32())}))
    sums = sums.join(F.broadcast(numbers) if len(found) <= BROADCAST_SUMS else numbers, "queue")
    told = spark.sparkContext.broadcast((plan, paths))
    before = Window.partitionBy("k").orderBy("tag", "queue").rowsBetween(Window.unboundedPreceding, -1)
    firsts = sums.select("queue", "tag", "k", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        near: dict[int, int] = {}
        plan, paths = told.value
        kinds = [pa.int64(), pa.string(), *[pa.int64()] * 6, pa.binary()]
        for batch in batches:
            out: list[list] = [[] for _ in OUT]
            doc, src, ids, n, k, first = (batch.column(c).to_pylist() for c in ("doc_id", "source", "ids", "n", "k", "first"))
            for d, s, packed, m, q, at in zip(doc, src, ids, n, k, first, strict=True):
                size = len(packed) // m if m else 4  # bytes an id: no tokenizer is needed here, so workers let go of it
                wide = packed if size == 4 else np.frombuffer(packed, "<u2").astype("<u4").tobytes()
                for start, length, sequence, offset in plan.pieces(paths[q], at, m, near.get(q, 0)) if m else ():
                    row = (d, s, start, length, zlib.crc32(wide[4 * start : 4 * (start + length)]), m, sequence, offset, packed[start * size : (start + length) * size])
                    for column, value in zip(out, row, strict=True):
                        column.append(value)
                    near[q] = min(sequence, plan.total // plan.window)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, kinds, strict=True)], OUT)

    if sums.count() <= BROADCAST_SUMS:
        firsts = F.broadcast(firsts)
    placed = tokens.join(firsts, ["queue", "tag"]).select("doc_id", "source", "ids", "n", "k", (F.col("first") + F.col("start")).alias("first"))
    return placed.mapInArrow(lean(place), ", ".join(f"{c} {t}" for c, t in zip(OUT, ["long", "string", *["long"] * 6, "binary"], strict=True)))


OUT = ["doc_id", "source", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids"]
