"""SentencePiece encoding and decoding with a distinct-chunk table.

No piece of the vocabulary holds a white-space marker behind another character, so no merge crosses the place
where a marker follows a non-marker.  A text therefore falls into marked words that are segmented independently:
each task keeps a table of the distinct marked words it has met, segments each of them once with the library and
joins ids (and decoded bytes) back to the texts by position.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import ship

MARK = "▁"
#: Characters of all chunks after which a task starts a new table, so that its memory stays bounded (about 30 bytes a
#: character at most), and the length from which a chunk is segmented each time it is met and not kept.  Results depend on neither.
TABLE_CHARACTERS, LONG_CHUNK = 4_000_000, 512


def marked_words(text: str) -> list[str]:
    """The text's chunks, each as the text (without its first marker) that the library would mark the same way.

    A chunk is a run of markers and the non-markers behind it; the first marker of a text is the one that the
    library prepends.  The trailing run of n markers is given as n spaces, told apart by its leading "\\0s".
    """
    if not text:
        return []
    if MARK in text:
        text = text.replace(MARK, " ")
    parts = text.split(" ")
    if "" not in parts:
        return parts
    out, run = [], 0
    for part in parts:
        if part:
            out.append(" " * run + part if run else part)
            run = 0
        else:
            run += 1
    if run:
        out.append("\0s" + " " * run)
    return out


class ChunkTable:
    """Distinct chunks with their ids and decoded text, as flat arrays to gather from."""

    def __init__(self, model_file: str):
        import sentencepiece

        self.piece = sentencepiece.SentencePieceProcessor(model_file=model_file)
        for i in range(self.piece.get_piece_size()):
            if MARK in self.piece.id_to_piece(i).lstrip(MARK):
                raise ValueError("this vocabulary has pieces that cross white-space markers")
        if self.piece.decode(self.piece.encode("  a")) != "  a":
            raise ValueError("this model folds white space, so chunks can't be joined by position")
        self.clear()

    def clear(self) -> None:
        self.index: dict[str, int] = {}
        self.ids: list[list[int]] = []
        self.text: list[str] = []
        self.characters = 0

    def _trailing(self, run: int) -> list[int]:
        return self.piece.encode(" " * (run - 1)) if run > 1 else [self.piece.piece_to_id(MARK)]

    def segmented(self, chunk: str) -> tuple[list[int], str]:
        ids = self._trailing(len(chunk) - 2) if chunk.startswith("\0s ") else self.piece.encode(chunk)
        return ids, " " + self.piece.decode(ids)

    def add(self, chunks: list[str]) -> None:
        new = [c for c in dict.fromkeys(chunks) if c not in self.index]
        plain = [c for c in new if not c.startswith("\0s ")]
        for chunk, ids in zip(plain, self.piece.encode(plain, num_threads=1) if plain else [], strict=True):
            self._put(chunk, ids)
        for chunk in new:
            if chunk.startswith("\0s "):  # no other chunk has a space behind another character
                self._put(chunk, self._trailing(len(chunk) - 2))

    def _put(self, chunk: str, ids: list[int]) -> None:
        self.index[chunk] = len(self.ids)
        self.characters += len(chunk)
        self.ids.append(ids)
        self.text.append(" " + self.piece.decode(ids))


def _encode_batches(model_file: str, text: str, keep: list[str]):
    def run(batches):
        table = ChunkTable(model_file)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                docs = [marked_words(t or "") for t in part.column(text).to_pylist()]
                if table.characters > TABLE_CHARACTERS:
                    table.clear()
                table.add([c for d in docs for c in d if len(c) < LONG_CHUNK])
                index, ids, shown = table.index, table.ids, table.text
                flat, sizes, decoded = [], np.zeros(len(docs) + 1, np.int64), []
                for k, doc in enumerate(docs):
                    before, words = len(flat), []
                    for c in doc:
                        p = index.get(c)
                        own, word = (ids[p], shown[p]) if p is not None else table.segmented(c)
                        flat += own
                        words.append(word)
                    sizes[k + 1] = sizes[k] + len(flat) - before
                    decoded.append("".join(words)[1:])
                arrays = [part.column(c) for c in keep]
                lists = pa.ListArray.from_arrays(pa.array(sizes.astype(np.int32)), pa.array(np.array(flat, np.int32)))
                yield pa.RecordBatch.from_arrays([*arrays, lists, pa.array(decoded, pa.string())], schema=pa.schema([*[part.schema.field(c) for c in keep], pa.field("ids", lists.type), pa.field("decoded", pa.string())]))

    return run


def encode_decode(docs: DataFrame, model_file: str, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Per row: key, ids array<int> (as the library encodes the whole text) and decoded string (as it decodes them).

    Null and empty texts have no ids and decode to the empty text.  Repeated rows each get their own result; other
    columns are ignored.  One narrow stage: no shuffle, and a worker holds one slice of rows and one bounded table.
    """
    ship(docs.sparkSession)
    docs = docs.select(key, text)
    kind = docs.schema[key].dataType.simpleString()
    return docs.mapInArrow(_encode_batches(model_file, text, [key]), f"`{key}` {kind}, ids array<int>, decoded string")


def digests(encoded: DataFrame, key: str = "doc_id") -> DataFrame:
    """n_tokens, ids_sha256 and decoded_sha256 of encode_decode's rows."""
    return encoded.select(
        key,
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2(F.encode("decoded", "UTF-8"), 256).alias("decoded_sha256"),
    )
