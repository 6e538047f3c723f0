"""SentencePiece ids and decoded texts of whole columns through a distinct-chunk table.

The model's pieces hold the white-space marker at their start only, or nothing else, and none holds
a line feed, so no piece crosses into a marked word or over a line feed. A text is cut there; each
distinct marked word is segmented once for a worker, and the ids are joined back by position. The
same table knows whether a word's ids decode to the word; a text of which all words do decodes to
itself, any other is decoded by the library. A model without these properties, and texts that hold
the marker itself, go to the library as they are.

Defined cases: a null text is empty, and has the begin and end ids only; null ids and repeated rows
are kept as they are; an empty table gives no rows; further columns are carried by `encode_decode`
only where asked for.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytesops import UnitTable, doc_starts, slices
from .common import arrow_map

MARK = "▁"


class MarkedWords:
    _loaded: dict[str, MarkedWords] = {}

    def __init__(self, model: str):
        import sentencepiece

        self.library = sentencepiece.SentencePieceProcessor(model_file=model)
        pieces = [self.library.id_to_piece(i) for i in range(self.library.get_piece_size())]
        self.splits = len(pieces) < 1 << 16 and not any(MARK in p.lstrip(MARK) or "\n" in p for p in pieces)
        self.mark = self.library.piece_to_id(MARK)
        self.probe = self.library.encode("a")
        self.table = UnitTable(self._encode)

    @classmethod
    def load(cls, model: str) -> MarkedWords:
        if model not in cls._loaded:
            cls._loaded[model] = cls(model)
        return cls._loaded[model]

    def _encode(self, units: list[bytes]) -> tuple[list[list[int]], np.ndarray]:
        # the library puts one marker before what it is given
        texts = [(u[1:] if u[:1] == b" " else u).decode() for u in units]
        ids = self.library.encode(texts, num_threads=1)
        for k, u in enumerate(units):
            if u == b" ":
                ids[k] = [self.mark]
            elif u[:1] == b"\n":
                ids[k] = ids[k][1:]
        back = self.library.decode([self.probe + x for x in ids])
        return ids, np.array([x[1:].encode() == u for x, u in zip(back, units, strict=True)])

    def rows(self, column: pa.Array) -> Iterator[tuple[np.ndarray, bytes]]:
        """The ids (with begin and end) and the decoded text of each row."""
        bos, eos = self.library.bos_id(), self.library.eos_id()
        for lo, hi, data, offsets in slices(column):
            raw = data.tobytes()
            whole = not self.splits or MARK.encode() in raw
            if not whole:
                spaced = np.insert(data, offsets[:-1], 32)
                at = offsets + np.arange(len(offsets))
                first = doc_starts(len(spaced), at)[:-1]
                space = spaced == 32
                head = first | (spaced == 10)
                head[1:] |= space[1:] & ~space[:-1]
                starts = np.flatnonzero(head)
                ends = np.append(starts[1:], len(spaced))
                entries = self.table.entries(spaced, starts, ends)
                ids = self.table.gather(entries)
                units = np.searchsorted(starts, at)
                total = np.concatenate([[0], np.cumsum(self.table.size[entries], dtype=np.int64)])[units]
                odd = np.concatenate([[0], np.cumsum(~self.table.flag[entries])])[units]
            for k in range(hi - lo):
                text = raw[offsets[k] : offsets[k + 1]]
                if whole or not text:
                    own = self.library.encode(text.decode())
                    yield np.array([bos, *own, eos], "<u4"), self.library.decode([bos, *own, eos]).encode()
                    continue
                own = np.empty(total[k + 1] - total[k] + 2, "<u4")
                own[0], own[-1] = bos, eos
                own[1:-1] = ids[total[k] : total[k + 1]]
                yield own, text if odd[k + 1] == odd[k] else self.library.decode(own.tolist()).encode()


def encode_decode(docs: DataFrame, model: str, keep: list[str] | None = None, with_ids: bool = False, with_text: bool = False) -> DataFrame:
    """doc_id, the columns of `keep`, n_tokens, ids_sha256, decoded_sha256, and on demand `ids` and `decoded`."""
    keep = [c for c in (keep or []) if c != "doc_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = MarkedWords.load(model)
        for batch in batches:
            n, ids, texts, decoded = [], [], [], []
            all_ids, text_out = [], []
            for own, text in codec.rows(batch.column("_sp_text")):
                n.append(len(own))
                ids.append(hashlib.sha256(own).hexdigest())
                decoded.append(hashlib.sha256(text).hexdigest())
                if with_ids:
                    all_ids.append(own.astype(np.int32))
                if with_text:
                    text_out.append(text.decode())
            cols = [batch.column(c) for c in ("doc_id", *keep)] + [pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(decoded, pa.string())]
            names = ["doc_id", *keep, "n_tokens", "ids_sha256", "decoded_sha256"]
            if with_ids:
                cols.append(pa.array(all_ids, pa.list_(pa.int32())))
                names.append("ids")
            if with_text:
                cols.append(pa.array(text_out, pa.string()))
                names.append("decoded")
            yield pa.RecordBatch.from_arrays(cols, names)

    rows = docs.select(F.col("doc_id").cast("long"), *keep, F.col("text").cast("string").alias("_sp_text"))
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    schema = ", ".join(["doc_id long", *[f"`{c}` {kinds[c]}" for c in keep], "n_tokens long, ids_sha256 string, decoded_sha256 string"])
    schema += ", ids array<int>" * with_ids + ", decoded string" * with_text
    return arrow_map(rows, run, schema)
