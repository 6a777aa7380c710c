"""SentencePiece encoding and decoding (5): exact merge-type encoding by backtracking.

Aho-Corasick lists the pieces that start at each position; the longest is tried first. Two adjacent pieces are
compatible if merging the characters of both together leaves exactly the two; a sequence whose neighbours are all
compatible is the one that merging finds. Where no piece fits, the position is marked in a bitfield of failed positions
and the last piece is given up for its next shorter prefix.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.common import CACHES, lean, small_batches

BLANK = "▁"


class PieceCodec:
    """Encoder and decoder over the pieces and scores of a merge-type sentencepiece model with an identity normaliser."""

    #: Words that a generation of the cache holds (there are two of them), and letters of the longest.
    CACHED, LONGEST = 400_000, 60

    def __init__(self, path: str) -> None:
        import ahocorasick
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.pieces = [model.id_to_piece(k) for k in range(model.get_piece_size())]
        self.scores = [model.get_score(k) for k in range(len(self.pieces))]
        bytes_ = {k for k in range(len(self.pieces)) if model.is_byte(k)}
        silent = {k for k in range(len(self.pieces)) if model.is_control(k) or model.is_unknown(k)}
        self.silent = silent
        self.ids = {p: k for k, p in enumerate(self.pieces) if k not in bytes_ and k not in silent}
        self.byte_ids = {int(self.pieces[k][3:5], 16): k for k in bytes_}
        self.bytes = {k: b for b, k in self.byte_ids.items()}
        self.unknown, self.end = model.unk_id(), model.eos_id()
        self.dummy = model.encode("a") == model.encode(" a") or bool(model.encode("a", out_type=str)[0].startswith(BLANK))
        if any(BLANK in p.lstrip(BLANK) for p in self.ids):
            raise ValueError("pieces cross blanks: words can't be encoded one by one")
        self.search = ahocorasick.Automaton()
        for p, k in self.ids.items():
            self.search.add_word(p, (len(p), k))
        self.search.make_automaton()
        self.pairs: dict[tuple[int, int], bool] = {}
        #: neighbouring letters inside pieces
        self.inner = {p[k : k + 2] for p in self.ids for k in range(len(p) - 1)}
        self.marks: dict[str, tuple[bytes, str | None]] = {}
        self.letters = {p for p in self.ids if len(p) == 1}
        #: ids of words that are decoded to themselves: of those after one blank by the word alone, of others with their blanks; the last two generations
        self.words: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.spelt = [f" {k}".encode() for k in range(len(self.pieces))]
        self.shown = [None if k in bytes_ else " ⁇ " if k == self.unknown else "" if k in silent else p.replace(BLANK, " ") for k, p in enumerate(self.pieces)]

    def merge(self, text: str) -> list[str]:
        """The defining process: merge the neighbours whose union has the best score, leftmost first, until none is a piece."""
        parts = list(text)
        while len(parts) > 1:
            best, at = None, -1
            for k in range(len(parts) - 1):
                found = self.ids.get(parts[k] + parts[k + 1])
                if found is not None and (best is None or self.scores[found] > best):
                    best, at = self.scores[found], k
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def compatible(self, last: int, piece: int) -> bool:
        """Whether merging the characters of both leaves exactly the two; ``last`` -1 stands for the beginning."""
        if (ok := self.pairs.get((last, piece))) is None:
            whole = [self.pieces[k] for k in (last, piece) if k >= 0]
            if len(self.pairs) > 2_000_000:
                self.pairs.clear()
            ok = self.pairs[last, piece] = self.merge("".join(whole)) == whole
        return ok

    def _backtrack(self, text: str) -> list[int]:
        """Ids of a text of known characters."""
        starts: list[list[tuple[int, int]]] = [[] for _ in text]
        for last, found in self.search.iter(text):
            starts[last - found[0] + 1].append(found)  # matches come by their end, so shorter ones first
        pairs, failed, at, n, last = self.pairs, 0, 0, len(text), -1
        out: list[tuple[int, int, int]] = []  # id, length, index of the choice
        options = starts[0]
        choice = len(options) - 1
        while True:
            while choice >= 0:
                length, piece = options[choice]
                if not (failed and failed >> (at + length) & 1):
                    ok = pairs.get((last, piece))
                    if ok or (ok is None and self.compatible(last, piece)):
                        break
                choice -= 1
            if choice >= 0:
                out.append((piece, length, choice))
                at += length
                if at == n:
                    return [k for k, _, _ in out]
                last, options = piece, starts[at]
                choice = len(options) - 1
            else:
                failed |= 1 << at
                _, length, choice = out.pop()
                at -= length
                last, options = out[-1][0] if out else -1, starts[at]
                choice -= 1

    def encode_word(self, word: str) -> list[int]:
        """Ids of a run of blanks and other characters after it; characters without a piece become bytes or the unknown id."""
        if self.letters.issuperset(word):
            return self._backtrack(word) if word else []
        out: list[int] = []
        known = ""
        for c in word:
            if c in self.ids:
                known += c
                continue
            out += self._backtrack(known) if known else []
            known = ""
            out += [self.byte_ids[b] for b in c.encode()] if self.byte_ids else [self.unknown]
        return out + self._backtrack(known) if known else out

    def split(self, text: str) -> list[str]:
        """The words of a text, each with the blanks before it."""
        if not text:
            return []
        text = (" " if self.dummy else "") + text.replace(BLANK, " ")
        return re.findall(" +[^ ]*|[^ ]+", text)

    def encode(self, text: str) -> list[int]:
        return [k for w in self.split(text) for k in self.encode_word(w.replace(" ", BLANK))]

    def decode(self, ids: list[int]) -> str:
        """Text of ids: blanks restored, the added first blank dropped, byte runs read as UTF-8, control ids silent."""
        text = self._surface(ids)
        return text[1:] if self.dummy and text.startswith(" ") else text

    def _surface(self, ids: list[int]) -> str:
        parts = [self.shown[k] for k in ids]
        if None not in parts:
            return "".join(parts)
        out, run = [], bytearray()
        for k, shown in zip(ids, parts, strict=True):
            if shown is None:
                run.append(self.bytes[k])
                continue
            if run:
                out.append(run.decode("utf-8", "replace"))
                run = bytearray()
            out.append(shown)
        if run:
            out.append(run.decode("utf-8", "replace"))
        return "".join(out)

    def _word(self, key: str, word: str) -> tuple[bytes, str | None]:
        """Ids (as text, each after a blank) of a word, by way of the cache, and what they are decoded to if that is not the
        word itself; such words are not kept.

        No merge crosses two letters that no piece holds side by side, so the parts between such places are looked up.
        """
        if (hit := self.words.get(key) or self.older.get(key)) is not None:
            self.words[key] = hit
            return hit, None
        cuts = [k for k in range(2, len(word)) if word[k - 1 : k + 1] not in self.inner and word[k - 1] != " "]
        if cuts:
            head = len(word) - len(key)
            first = self._word(key[: cuts[0] - head], word[: cuts[0]])
            others = [self._part(word[a:b]) for a, b in zip(cuts, [*cuts[1:], len(word)], strict=True)]
            ids = first[0] + b"".join([x for x, _ in others])
            same = first[1] is None and all([own is None for _, own in others])
            ends = zip([0, *cuts], [*cuts, len(word)], strict=True)
            shown = None if same else "".join([word[a:b] if own is None else own for (a, b), (_, own) in zip(ends, [first, *others], strict=True)])
        else:
            ids, shown = self._encoded(word)
        if shown is None and len(cuts) < 2 and len(key) <= self.LONGEST:
            self.words[key] = ids
        return ids, shown

    def _part(self, part: str) -> tuple[bytes, str | None]:
        """As :meth:`_word`, for a part without blanks of a word."""
        if len(part) > 1:
            return self._word("\0" + part, part)
        if (mark := self.marks.get(part)) is None:
            mark = self._encoded(part)
            if len(self.marks) < 10_000:
                self.marks[part] = mark
        return mark

    def _encoded(self, word: str) -> tuple[bytes, str | None]:
        ids = self.encode_word(word.replace(" ", BLANK))
        shown = self._surface(ids)
        return b"".join([self.spelt[k] for k in ids]), None if shown == word else shown

    def digest(self, text: str) -> tuple[int, str, str]:
        """Number of ids with the end id, digest of the ids and of the decoded text; words are looked up in a bounded cache."""
        text = text.replace(BLANK, " ")
        blank = " " if self.dummy and text else ""
        words = text.split(" ") if blank and text[0] != " " and "  " not in text else None
        if len(self.words) > self.CACHED:
            self.older, self.words = self.words, {}
        lead = "" if words is None else " "
        if words is None:  # their blanks are part of the key, so they never begin like a word alone
            words = re.findall(" +[^ ]*|[^ ]+", blank + text)
            keys = ["\0" + w for w in words]
        else:
            keys = words
        found, changed = list(map(self.words.get, keys)), {}
        if None in found:
            for k, hit in enumerate(found):
                if hit is None:
                    found[k], shown = self._word(keys[k], lead + words[k])
                    if shown is not None:
                        changed[k] = shown
        ids = b"".join(found) + f" {self.end}".encode()
        plain = text
        if changed:
            plain = "".join([changed.get(k, lead + w) for k, w in enumerate(words)])
            if self.dummy and plain.startswith(" "):
                plain = plain[1:]
        return ids.count(b" "), hashlib.sha256(ids[1:]).hexdigest(), hashlib.sha256(plain.encode()).hexdigest()


@lru_cache(maxsize=2)
def codec_at(path: str) -> PieceCodec:
    return PieceCodec(path)


CACHES["pieces"] = codec_at.cache_clear


def encode_documents(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text", end: bool = True) -> DataFrame:
    """``doc_id, ids array<int>`` per document; null text is empty, other columns are ignored, repeated rows are kept."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec_at(model)
        for b in batches:
            ids = [own.encode(t or "") + [own.end] * end for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "ids"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string")).mapInArrow(lean(run, "pieces"), "doc_id long, ids array<int>")


def decode_documents(encoded: DataFrame, model: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """``doc_id, text`` from arrays of ids; a null array gives an empty text."""
    small_batches(encoded.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec_at(model)
        for b in batches:
            texts = [own.decode(ids or []) for ids in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return encoded.select(F.col(id_col).cast("long").alias("doc_id"), F.col(ids_col)).mapInArrow(lean(run, "pieces"), "doc_id long, text string")


def codec_digests(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256`` per document: encoding with the end id, and its round trip.

    Texts of any length pass whole, one batch of documents at a time; no rows give no rows.
    """
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec_at(model)
        for b in batches:
            n, ids, plain = zip(*[own.digest(t or "") for t in b.column(1).to_pylist()], strict=True) if b.num_rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(plain, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string")).mapInArrow(lean(run, "pieces"), schema)
