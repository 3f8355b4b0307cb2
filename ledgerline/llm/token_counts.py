"""Token counts by a whole-token shortcut.

A piece vocabulary in which no piece has a word mark behind another character can never merge across the start of a
word. Then a text's token count is the sum over its words, and a word that is known to encode as one token need not be
merged at all. ``prove_whole_tokens`` establishes both facts from the model's own specification and pieces, once, before any
text is read; a model of another kind encodes whole texts.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MARK = "▁"
#: Distinct words that a worker remembers; beyond it the memory starts anew (results don't depend on it).
REMEMBERED = 400_000
_models: dict[str, Counter] = {}


def proto_fields(raw: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of each field of a protocol buffer message; messages and strings come as bytes."""
    at = 0

    def number() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = raw[at]
            at, value, shift = at + 1, value | (byte & 127) << shift, shift + 7
            if byte < 128:
                return value

    while at < len(raw):
        tag = number()
        if tag & 7 == 0:
            yield tag >> 3, number()
            continue
        size = {1: 8, 5: 4}.get(tag & 7) or number()
        yield tag >> 3, raw[at : at + size]
        at += size


#: Numbers of fields in a model's specification of its training (2) and its normalizer (3): fixed values.
MODEL_TYPE, SUFFIX_MARK, BYTE_FALLBACK = 3, 24, 35
CHARACTER_MAP, MARK_FIRST, TRIM_SPACES, MARK_SPACES, RULES = 2, 3, 4, 5, 6
PAIR_MERGES = 2


def counts_by_word(model: bytes) -> bool:
    """Whether the model's specification lets words be counted apart.

    It must merge pairs, fall back to bytes (or unknown characters of neighbouring words would be one token), and its normalizer
    must map no character, trim nothing, and put the mark before the text and for every space.
    """
    parts = dict(proto_fields(model))  # the pieces (1) repeat; of the specifications each is there once
    trained, normal = (dict(proto_fields(parts.get(n, b""))) for n in (2, 3))
    merges = trained.get(MODEL_TYPE, 1) == PAIR_MERGES and trained.get(BYTE_FALLBACK, 0) == 1 and not trained.get(SUFFIX_MARK, 0)
    plain = not normal.get(CHARACTER_MAP) and not normal.get(RULES) and normal.get(TRIM_SPACES, 1) == 0
    return merges and plain and normal.get(MARK_FIRST, 1) == 1 and normal.get(MARK_SPACES, 1) == 1


def prove_whole_tokens(processor) -> set[str] | None:
    """The strings that, as a word of their own, encode as exactly one token; None if words can't be counted apart.

    Words can be counted apart if the specification lets them (``counts_by_word``), no piece has the word mark behind another
    character and none holds a line feed; each candidate is then proved by encoding it.
    """
    pieces = [processor.id_to_piece(i) for i in range(processor.get_piece_size())]
    normal = [p for i, p in enumerate(pieces) if not (processor.is_control(i) or processor.is_byte(i) or processor.is_unknown(i))]
    if not counts_by_word(processor.serialized_model_proto()) or any(MARK in p.lstrip(MARK) or "\n" in p for p in normal):
        return None
    found = [p[1:] for p in normal if p[0] == MARK and len(p) > 1 and MARK not in p[1:]]
    return {p for p, ids in zip(found, processor.encode(found), strict=True) if len(ids) == 1}


class Counter(dict):
    """Token count of a word that stands after one space, or after a line feed if it starts with one."""

    def __init__(self, path: str):
        import sentencepiece

        self.processor = sentencepiece.SentencePieceProcessor(model_file=path)
        self.whole = prove_whole_tokens(self.processor)
        self.runs: dict[str, int] = {}
        self.start()

    def start(self) -> None:
        self.clear()
        self.update(dict.fromkeys(self.whole or (), 1))

    def __missing__(self, word: str) -> int:
        if len(self) > REMEMBERED:
            self.start()
        n = len(self.processor.encode(word)) - (word[0] == "\n")
        if len(word) < 100:
            self[word] = n
        return n

    def run(self, unit: str) -> int:
        """Of spaces followed by a word or the text's end; the encoder itself puts the first space before it."""
        if (n := self.runs.get(unit)) is None:
            if len(self.runs) > REMEMBERED:
                self.runs.clear()
            n = self.runs[unit] = len(self.processor.encode(unit[1:])) if len(unit) > 1 else 1
        return n

    def count(self, text: str) -> tuple[int, int]:
        """Tokens, and how many of them the shortcut gave."""
        if not text or self.whole is None:
            return (len(self.processor.encode(text)), 0) if text else (0, 0)
        if MARK in text:
            text = text.replace(MARK, " ")
        if "  " in text or text[0] in " \n" or text[-1] == " " or " \n" in text:
            units = re.findall(" *[^ ]+| +", f" {text}")
            return sum(map(self.run, units)), sum(u[1:] in self.whole for u in units)
        parts = text.replace("\n", " \n").split(" ")
        return sum(map(self.__getitem__, parts)), sum(map(self.whole.__contains__, parts))


def token_counts(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 4096) -> DataFrame:
    """One row per row of ``docs``: its id, ``n_bytes`` (UTF-8), ``n_tokens``, ``over_limit``, ``n_shortcut``.

    ``model`` is the path of a sentencepiece model that every executor can read. A null text counts as empty (0 tokens);
    a null id stays null; repeated rows each give a row; other columns are ignored. Needs no shuffle.
    """

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _models.get(model) or _models.setdefault(model, Counter(model))
        for batch in batches:
            texts = pc.fill_null(batch.column(1), "")
            found = [counter.count(t.as_py()) for t in texts]
            tokens = pa.array([n for n, _ in found], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), pc.binary_length(texts).cast(pa.int64()), tokens, pc.greater(tokens, limit), pa.array([s for _, s in found], pa.int64())], ["id", "n_bytes", "n_tokens", "over_limit", "n_shortcut"])

    kind = docs.schema[id_col].dataType.simpleString()
    given = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return given.mapInArrow(counted, f"id {kind}, n_bytes long, n_tokens long, over_limit boolean, n_shortcut long").withColumnRenamed("id", id_col)
