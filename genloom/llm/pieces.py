"""SentencePiece encoding and decoding for merge-type vocabularies."""

from __future__ import annotations

import codecs
import hashlib
import heapq
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from genloom.llm.common import rows, text_buffer, texts
from genloom.llm.units import Memo, distinct_units, gather, space_cuts
from genloom.session import ship, table

_SPACE = "▁"
codecs.register_error("genloom-each", lambda e: ("�" * (e.end - e.start), e.end))


class PieceCodec:
    """Encoder and decoder of one model file.

    Adjacent symbols merge in the order of the merged piece's score, leftmost
    first among equals, taken from an agenda (a heap) of candidate pairs. No
    piece holds a space sign behind another character, so no merge crosses
    the place between a word and the space after it: texts are cut there and
    each distinct unit is encoded once. Each unit is compared with the
    library when it is first met; a difference is an error.
    """

    def __init__(self, path: str) -> None:
        import sentencepiece

        self.library = sp = sentencepiece.SentencePieceProcessor(model_file=path)
        self.scores: dict[str, float] = {}
        self.ids: dict[str, int] = {}
        self.byte_ids = [0] * 256
        self.surface: list[bytes] = []
        for i in range(sp.get_piece_size()):
            piece = sp.id_to_piece(i)
            if sp.is_byte(i):
                self.byte_ids[int(piece[1:-1], 16)] = i
                self.surface.append(bytes([int(piece[1:-1], 16)]))
            elif sp.is_control(i):
                self.surface.append(b"")
            elif sp.is_unknown(i):
                self.surface.append(" ⁇ ".encode())
            else:
                self.scores[piece], self.ids[piece] = sp.get_score(i), i
                self.surface.append(piece.replace(_SPACE, " ").encode())
        if any(_SPACE in p.lstrip(_SPACE) for p in self.ids):
            raise ValueError("a piece holds a space sign behind another character; units can't be cut at spaces")
        self.memo = Memo()

    def merge(self, text: str) -> list[int]:
        """Ids of one text that already has space signs, by the agenda."""
        symbols = list(text)
        n = len(symbols)
        before, after = list(range(-1, n - 1)), [*range(1, n), -1]
        score = self.scores.get
        pairs = map(str.__add__, symbols, symbols[1:])
        agenda = [(-v, i, i + 1, 2) for i, p in enumerate(pairs) if (v := score(p)) is not None]
        heapq.heapify(agenda)
        while agenda:
            _, left, right, size = heapq.heappop(agenda)
            joined = symbols[left] + symbols[right]
            if not symbols[left] or not symbols[right] or len(joined) != size:
                continue  # one of the two has merged otherwise meanwhile
            symbols[left], symbols[right] = joined, ""
            beyond = after[left] = after[right]
            if beyond >= 0:
                before[beyond] = left
                pair = joined + symbols[beyond]
                if (v := score(pair)) is not None:
                    heapq.heappush(agenda, (-v, left, beyond, len(pair)))
            ahead = before[left]
            if ahead >= 0:
                pair = symbols[ahead] + joined
                if (v := score(pair)) is not None:
                    heapq.heappush(agenda, (-v, ahead, left, len(pair)))
        out: list[int] = []
        for s in symbols:
            if s:
                known = self.ids.get(s)
                out.extend([known] if known is not None else [self.byte_ids[b] for b in s.encode()])
        return out

    def fresh(self, units: list[bytes]) -> list[bytes]:
        """Little-endian ids of units, all of which begin with a space; each is checked against the library."""
        own = [self.merge(u.decode().replace(" ", _SPACE)) for u in units]
        theirs = self.library.encode([u[1:].decode() for u in units], num_threads=1)
        for u, a, b in zip(units, own, theirs):
            if a != b and u != b" ":  # the library gives the empty text no space sign
                raise ValueError(f"the library encodes {u!r} as {b}, not {a}")
        return [array("i", a).tobytes() for a in own]

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids and row offsets of a column of texts."""
        data, offsets = text_buffer(column)
        lo = int(offsets[0])
        data, offsets = data[lo : int(offsets[-1])], offsets - lo
        full = offsets[1:] > offsets[:-1]
        spaced = np.insert(data, offsets[:-1][full], 0x20)  # the model puts a space before each text
        offsets = offsets + np.r_[0, np.cumsum(full)]
        found, codes, of_row = distinct_units(spaced, offsets, space_cuts(spaced))
        return gather(self.memo.resolve(found, self.fresh), codes, of_row)

    def decode(self, ids: list[int]) -> str:
        """The text of a list of ids; bytes that are not UTF-8 become U+FFFD each."""
        raw = b"".join(map(self.surface.__getitem__, ids))
        if raw[:1] == b" ":  # the space before each text goes, unless a byte piece spells it
            shown = next(i for i in ids if self.surface[i])
            raw = raw if shown == self.byte_ids[0x20] else raw[1:]
        return raw.decode("utf-8", "genloom-each")


_CODECS: dict[str, PieceCodec] = {}


def codec(path: str) -> PieceCodec:
    """This process's codec of a model file."""
    if path not in _CODECS:
        _CODECS[path] = PieceCodec(path)
    return _CODECS[path]


def encoded(docs: DataFrame, model: str) -> DataFrame:
    """``doc_id`` and ``ids`` of every text: no begin or end ids; null and empty texts have none."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows(batches):
            ids, ends = codec(model).encode(batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids, pa.int32()))], ["doc_id", "ids"])

    return texts(docs).mapInArrow(run, "doc_id long, ids array<int>")


def decoded(ids: DataFrame, model: str) -> DataFrame:
    """``doc_id`` and ``text`` of every row of ``doc_id, ids``; a null list gives the empty text."""
    ship(ids.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([codec(model).decode(x or []) for x in batch.column(1).to_pylist()], pa.string())], ["doc_id", "text"])

    return ids.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def digests(docs: DataFrame, model: str) -> DataFrame:
    """Per row of ``docs`` the digests of its ids and of the text decoded from them.

    Both come from ``PieceCodec.encode`` and ``PieceCodec.decode`` in one pass,
    without a shuffle. Rows that repeat give rows that repeat; null counts as
    empty; a text of any length is encoded whole. No rows in, none out.
    """
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(model)
        decimal = [b",%d" % i for i in range(len(c.surface))]
        for batch in rows(batches):
            ids, ends = c.encode(batch.column(1))
            of_ids, of_text = [], []
            for lo, hi in zip(ends[:-1].tolist(), ends[1:].tolist()):
                own = ids[lo:hi].tolist()
                of_ids.append(hashlib.sha256(b"".join(map(decimal.__getitem__, own))[1:]).hexdigest())
                of_text.append(hashlib.sha256(c.decode(own).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.diff(ends)), pa.array(of_ids, pa.string()), pa.array(of_text, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return texts(docs).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return digests(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
