"""Vector bin packing of token sequences.

Every document is a demand vector (tokens, segments, loss-bearing tokens); every sequence is a bin with a limit in each
dimension. The open sequence takes, of the documents that wait, the one whose demand has the largest dot product with
what the sequence has left, both as shares of the limits (the dot-product heuristic). Nothing fits: a document is cut, so that the
sequence is filled to the token. What is left at a task's end is cut into powers of two, which need no padding.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Callable, Iterator
from unicodedata import is_normalized

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.llm._hashing import parts, split_words

#: Distinct pieces of text that a worker remembers; beyond it the memory starts anew (results don't depend on it).
REMEMBERED = 1_200_000
#: ASCII punctuation without the apostrophe, which may begin a piece of its own.
TAIL = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"
#: Bytes of text whose pieces are looked up at once.
AT_ONCE = 12 << 20
#: Documents, and tokens, that wait at once in a task.
WAITING, WAITING_TOKENS = 256, 1 << 20
PIECE = "doc_id {id}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, loss_tokens long, sequence_length long"
_tokenizers: dict[str, WordIds] = {}
#: What a tokenizer's file must say for its texts to be encoded by pieces (fixed values): it normalizes, makes white space one space,
#: lower-cases, drops what stands between words, numbers and punctuation, and merges within each of these.
NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]}
SPLIT = {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True}
LEVEL = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}


def encodes_by_piece(tokenizer: dict) -> bool:
    """Whether a tokenizer (its file's JSON) is of the form that ``WordIds`` relies on; others encode whole texts."""
    model = tokenizer["model"]
    added = all(t["special"] and not (t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"]) and t["content"].startswith("<|") for t in tokenizer["added_tokens"])
    return added and tokenizer["normalizer"] == NORMALIZER and tokenizer["pre_tokenizer"] == {"type": "Sequence", "pretokenizers": [SPLIT, LEVEL]} and model["type"] == "BPE" and not model.get("dropout") and not (tokenizer["truncation"] or tokenizer["padding"])


class WordIds(dict):
    """Token ids (as little-endian unsigned 32-bit bytes) of a piece of text without white space.

    A tokenizer of the form that ``encodes_by_piece`` asks for drops white space and never merges across it, so a text's ids are
    those of its pieces in turn. It also lower-cases, so A-Z are lower-cased first, but for texts that may hold one of its special
    strings. Any other tokenizer encodes whole texts.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.by_piece = encodes_by_piece(json.loads(self.tokenizer.to_str()))
        special = [t for t in self.tokenizer.get_added_tokens_decoder().items() if t[1].special]
        self.between_id, self.between = (special[0][0], special[0][1].content) if special else (None, "")

    def encoded(self, piece: bytes) -> bytes:
        return np.array(self.tokenizer.encode(piece.decode(), add_special_tokens=False).ids, "<u4").tobytes()

    def __missing__(self, piece: bytes) -> bytes:
        ids = self.encoded(piece)
        if len(piece) < 64:
            self[piece] = ids
        return ids

    def learn(self, pieces: list[bytes]) -> None:
        """Many pieces in one call: a special token between them shows where each one's ids end."""
        if len(self) > REMEMBERED:
            self.clear()
        new = [p for p in pieces if p not in self and b"<|" not in p and len(p) < 64]
        for at in range(0, len(new) if self.between else 0, 512):
            part = new[at : at + 512]
            ids = np.array(self.tokenizer.encode_batch_fast([self.between.join([p.decode() for p in part])], add_special_tokens=False)[0].ids, "<u4")
            ends = [*np.flatnonzero(ids == self.between_id).tolist(), len(ids)]
            if len(ends) == len(part):
                raw, starts = ids.tobytes(), [0, *(e + 1 for e in ends)]
                self.update((p, raw[4 * x : 4 * y]) for p, x, y in zip(part, starts, ends, strict=False))

    @staticmethod
    def lowered(text: str) -> bytes:
        """In UTF-8, with A-Z lower-cased where that leaves the tokenizer's own normalization nothing else to do."""
        raw = text.encode()
        if b"<|" in raw:
            return raw
        low = raw.lower()
        if len(raw) == len(text) or is_normalized("NFC", text) and is_normalized("NFC", low.decode()):
            return low
        return raw

    def batch(self, texts: list[str]) -> list[bytes]:
        """The ids of each text. Each distinct word, and punctuation behind a word, is looked up once; ids are then gathered for all texts at a time."""
        if not self.by_piece:
            return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        pieces, starts = split_words(pa.array([self.lowered(t) for t in texts], pa.binary()).cast(pa.string()))
        if not len(pieces):
            return [b""] * len(texts)
        heads, tails = _apart(pieces)
        index, own, known = [], [], 0
        for part in (heads, tails):
            coded = part.dictionary_encode()
            distinct = coded.dictionary.cast(pa.binary()).to_pylist()
            self.learn(distinct)
            own += [self[p] if p else b"" for p in distinct]
            index.append(coded.indices.to_numpy(zero_copy_only=False) + known)
            known += len(distinct)
        sizes = np.fromiter(map(len, own), np.int64, len(own)) // 4
        pool, at = np.frombuffer(b"".join(own), "<u4"), np.cumsum(sizes) - sizes
        turns = np.stack(index, 1).ravel()  # each word, then its punctuation
        lengths = sizes[turns]
        ends = np.concatenate([[0], np.cumsum(lengths)])
        ids = pool[np.repeat(at[turns] - ends[:-1], lengths) + np.arange(ends[-1])]
        edges = ends[2 * starts].tolist()
        return [ids[x:y].tobytes() for x, y in zip(edges[:-1], edges[1:], strict=True)]


    def masked(self, text: str, spans: list[dict]) -> tuple[bytes, np.ndarray]:
        """A text's ids, and which of them stand for a character of one of the spans (start, end in code points)."""
        found = self.tokenizer.encode(text, add_special_tokens=False)
        at = np.array(found.offsets, np.int64).reshape(-1, 2)
        inside = np.zeros(len(at), bool)
        for s in spans:
            inside |= (at[:, 0] < s["end"]) & (at[:, 1] > s["start"])
        return np.array(found.ids, "<u4").tobytes(), inside


def _apart(pieces: pa.Array) -> tuple[pa.Array, pa.Array]:
    """Words, and the punctuation behind each (empty if there is none, or if no ASCII letter stands before it).

    To the tokenizer, punctuation behind a letter is a piece of its own; what may hold a special string stays whole.
    """
    heads = pc.ascii_rtrim(pieces, TAIL)
    size = pc.binary_length(heads).to_numpy(zero_copy_only=False)
    _, offsets, data = heads.buffers()
    ends = np.frombuffer(offsets, np.int32)[heads.offset + 1 : heads.offset + 1 + len(heads)]
    last = np.frombuffer(data, np.uint8)[np.maximum(ends - 1, 0)] if data is not None and data.size else np.zeros(len(heads), np.uint8)
    letter = (size > 0) & ((last | 32) >= 97) & ((last | 32) <= 122)
    letter = pa.array(letter & ~pc.match_substring(pieces, "<|").to_numpy(zero_copy_only=False))
    words = pc.if_else(letter, heads, pieces)
    return words, pc.if_else(letter, _rest(pieces, heads), "")


def _rest(pieces: pa.Array, heads: pa.Array) -> pa.Array:
    """What each piece has behind its head."""
    whole, some = pc.binary_length(pieces).to_numpy(zero_copy_only=False), pc.binary_length(heads).to_numpy(zero_copy_only=False)
    _, offsets, data = pieces.buffers()
    ends = np.frombuffer(offsets, np.int32)[pieces.offset + 1 : pieces.offset + 1 + len(pieces)].astype(np.int64)
    sizes = (whole - some).astype(np.int64)
    to = np.concatenate([[0], np.cumsum(sizes)])
    at = np.repeat(ends - sizes - to[:-1], sizes) + np.arange(to[-1])
    return pa.StringArray.from_buffers(len(pieces), pa.py_buffer(to.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(np.frombuffer(data, np.uint8)[at])) if len(at) else pa.py_buffer(b""))


class Packer:
    """Packs documents into sequences; ``out`` gets the pieces as rows.

    A waiting document, and a piece, is a slice [doc, ids, start, end, loss sums, every token bears loss].
    """

    def __init__(self, limit: int, max_segments: int, max_loss: int, first: int, out: Callable[[tuple], None]):
        self.limits = np.array([limit, max_segments, max_loss], float)
        self.out, self.sequence = out, first
        self.waiting: list[list] = []
        self.need = np.zeros((2 * WAITING, 3))
        self.tokens = 0
        self.open()

    def open(self, tokens: int | None = None) -> None:
        self.left, self.pieces = self.limits.copy(), []
        if tokens:
            self.left[0] = tokens

    def close(self) -> None:
        length, offset = sum(p[3] - p[2] for p in self.pieces), 0
        for piece in self.pieces:
            doc, ids, start, end, *_ = piece
            self.out((doc, start, end - start, zlib.crc32(ids[4 * start : 4 * end]), len(ids) // 4, self.sequence, offset, self.loss(piece), length))
            offset += end - start
        self.sequence += bool(self.pieces)
        self.open()

    @staticmethod
    def loss(item: list) -> int:
        _, _, start, end, sums, every = item
        return int(sums[end] - sums[start]) if sums is not None else (end - start) * every

    def add(self, doc, ids: bytes, every: bool = True, loss: np.ndarray | None = None) -> None:
        """``loss``: for each token, whether it bears loss; without it all do, or none."""
        if len(self.waiting) >= WAITING or self.tokens > WAITING_TOKENS:
            while len(self.waiting) > WAITING // 2 or self.tokens > WAITING_TOKENS // 2:
                self.place()
        if ids:
            self.wait([doc, ids, 0, len(ids) // 4, None if loss is None else np.concatenate([[0], np.cumsum(loss, dtype=np.int64)]), every])

    def wait(self, item: list) -> None:
        if len(self.waiting) == len(self.need):
            self.need = np.concatenate([self.need, np.zeros_like(self.need)])
        self.need[len(self.waiting)] = item[3] - item[2], 1, self.loss(item)
        self.waiting.append(item)
        self.tokens += item[3] - item[2]

    def place(self) -> None:
        """One piece into the open sequence; closes the sequence when it is full or nothing more can go in."""
        need = self.need[: len(self.waiting)]
        fits = (need <= self.left).all(axis=1)
        if self.left[1] <= 1:  # the last segment is kept for a piece that fills the sequence
            fits &= need[:, 0] >= self.left[0]
        if fits.any():
            at = int(np.argmax(np.where(fits, (need / self.limits) @ (self.left / self.limits), -1)))
            self.take(at, int(need[at, 0]))
        else:
            at = int(np.argmax(need[:, 0]))  # the longest is cut: so pieces stay few
            _, _, start, _, sums, every = self.waiting[at]
            n = int(min(self.left[0], need[at, 0]))
            if sums is not None:
                n = min(n, int(np.searchsorted(sums[start : start + n + 1] - sums[start], self.left[2], "right")) - 1)
            elif every:
                n = min(n, int(self.left[2]))
            if n < 1:
                return self.close()
            self.take(at, n)
        if self.left[0] <= 0 or self.left[1] <= 0:
            self.close()

    def take(self, at: int, n: int) -> None:
        item = self.waiting[at]
        piece = [*item[:3], item[2] + n, *item[4:]]
        self.pieces.append(piece)
        self.left -= n, 1, self.loss(piece)
        self.tokens -= n
        item[2] += n
        if item[2] < item[3]:
            self.need[at] = item[3] - item[2], 1, self.loss(item)
            return
        last = self.waiting.pop()
        if at < len(self.waiting):
            self.waiting[at] = last
            self.need[at] = self.need[len(self.waiting)]

    def finish(self) -> None:
        """The last tokens go into sequences of power-of-two lengths, so that they need no padding either."""
        while self.waiting or self.pieces:
            total = self.tokens + sum(p[3] - p[2] for p in self.pieces)
            if total >= self.limits[0] and self.waiting:
                self.place()
                continue
            for piece in self.pieces:
                self.wait(piece)
            self.open(1 << (min(total, int(self.limits[0])).bit_length() - 1))
            before = self.sequence
            while self.sequence == before and self.waiting:
                self.place()
            if not self.waiting:
                self.close()


def pack_documents(docs: DataFrame, tokenizer: str, end_id: int, id_col: str = "doc_id", text_col: str = "text", limit: int = 4096, max_segments: int = 512, max_loss: int | None = None, loss_col: str | None = None, spans_col: str | None = None) -> DataFrame:
    """Texts as token ids (the tokenizer's, without special tokens, then ``end_id``), packed; one row per piece.

    Returns id, start, length, ids_crc32, doc_tokens, sequence_id, offset, loss_tokens, sequence_length. No sequence has
    more than ``limit`` tokens, ``max_segments`` pieces or ``max_loss`` loss-bearing tokens (default: ``limit``).
    ``loss_col`` (boolean) says whether a row's tokens bear loss; null or no such column: they do. ``spans_col`` (array of
    structs start, end: code points of the text) says which parts do: the tokens that overlap one, and ``end_id`` if one reaches
    the text's end; null: ``loss_col`` decides. Each task packs its
    own rows, so nothing is shuffled; a task's rest is cut into power-of-two sequences. sequence_id is unique: the
    task's number times 2**40 plus a count. A null text is empty (only ``end_id``); null ids stay null; repeated rows are
    packed each; other columns are ignored; an empty table gives no rows.
    """

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = _tokenizers.get(tokenizer) or _tokenizers.setdefault(tokenizer, WordIds(tokenizer))
        end = np.array([end_id], "<u4").tobytes()
        context, rows = TaskContext.get(), []
        packer = Packer(limit, max_segments, limit if max_loss is None else max_loss, (context.partitionId() if context else 0) << 40, rows.append)
        schema = None
        for part in parts(batches, 1, AT_ONCE):
            schema = schema or pa.schema([pa.field("doc_id", part.schema.field(0).type), *(pa.field(n, pa.int64()) for n in ("start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "loss_tokens", "sequence_length"))])
            texts = pc.fill_null(part.column(1), "").to_pylist()
            spans = part.column(3).to_pylist() if spans_col else [None] * len(texts)
            found = words.batch([t if s is None else "" for t, s in zip(texts, spans, strict=True)])
            for doc, ids, every, text, parts_ in zip(part.column(0).to_pylist(), found, pc.fill_null(part.column(2), True).to_pylist(), texts, spans, strict=True):
                loss = None
                if parts_ is not None:
                    ids, inside = words.masked(text, parts_)
                    loss = np.append(inside, any(s["end"] >= len(text) > s["start"] for s in parts_))
                packer.add(doc, ids + end, every, loss)
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
                rows.clear()
        packer.finish()
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    kind = docs.schema[id_col].dataType.simpleString()
    given = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"), (F.col(loss_col).cast("boolean") if loss_col else F.lit(True)).alias("loss"), *([F.col(spans_col).cast("array<struct<start:int,end:int>>").alias("spans")] if spans_col else []))
    return given.mapInArrow(packed, PIECE.format(id=kind)).withColumnRenamed("doc_id", id_col)
