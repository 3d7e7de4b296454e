"""SentencePiece ids of texts through a table of distinct chunks (operator 12)."""

from __future__ import annotations

import re
import zlib
from collections import defaultdict
from collections.abc import Iterator
from itertools import chain, islice

import numpy as np
import public_tokenizers
import pyarrow as pa
import sentencepiece
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm.storage import store_bucketed, table

MODEL = "piece_bpe_32k.model"
#: The vocabulary's white-space mark; a space becomes one, and one is put before each text that is not empty.
MARK = "▁"
#: A chunk is a run of marks and what follows up to the next one.
CHUNK = re.compile(f"{MARK}+[^{MARK}]*")
#: Characters of text whose distinct chunks are numbered together, and buckets, by a hash, of such chunks.
BLOCK = 24_000_000
BUCKETS = 1024
#: Chunks of text in a row of numbers.
ROW = 250_000


def chunks(text: str | None) -> list[str]:
    """The marked chunks of a text, in order; none of an empty one."""
    return CHUNK.findall(MARK + text.replace(" ", MARK)) if text else []


class ChunkModel:
    """Ids of single chunks as the vocabulary's library gives them within any text.

    The vocabulary must leave texts as they are (no normalising, a mark in front) and have no piece with a mark
    behind another character; then no merge reaches over a chunk's borders.  Both are checked.
    """

    def __init__(self, path: str):
        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        crossing = (self.model.id_to_piece(k).lstrip(MARK) for k in range(self.model.get_piece_size()))
        if any(MARK in piece for piece in crossing):
            raise ValueError(f"{path} has pieces that cross white space")
        probe = "  ﬁ é\t Ａ　x  "
        if self.model.decode(self.model.encode(probe)) != probe:
            raise ValueError(f"{path} changes texts before it cuts them")
        self.mark = self.model.piece_to_id(MARK)

    def ids(self, found: list[str]) -> list[list[int]]:
        """Ids of each chunk.  The library puts the first mark back; a lone mark is a piece, an empty text is none."""
        told = self.model.encode([c[1:].replace(MARK, " ") for c in found], num_threads=1)
        return [own if c != MARK else [self.mark] for c, own in zip(found, told, strict=True)]

    def texts(self, ids: list[list[int]]) -> list[str]:
        """The text of each chunk's ids, first space included, which the library drops at the start of a text."""
        return [" " + text for text in self.model.decode(ids, num_threads=1)] if ids else []


def _planes(numbers: np.ndarray) -> bytes:
    """Unsigned numbers, compressed by bytes of equal weight."""
    return zlib.compress(np.ascontiguousarray(numbers.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes(), 1)


def _numbers(planes: bytes) -> np.ndarray:
    raw = np.frombuffer(zlib.decompress(planes), np.uint8).reshape(4, -1)
    return np.ascontiguousarray(raw.T).view("<u4").ravel().astype(np.int64)


def _gaps(numbers: np.ndarray) -> bytes:
    return _planes(np.diff(numbers, prepend=0))


class Block:
    """Texts of one task and their distinct chunks, numbered by frequency, then by bucket and chunk.

    Frequent chunks have small numbers, and the many that occur once are neighbours, which makes both kinds of rows
    short.
    """

    def __init__(self):
        self.seen: defaultdict[str, int] = defaultdict()
        self.seen.default_factory = self.seen.__len__
        self.ids: list = []
        self.places: list[np.ndarray] = []
        self.size = 0

    def add(self, doc_id, text: str | None) -> None:
        found = chunks(text)
        self.ids.append(doc_id)
        self.places.append(np.fromiter(map(self.seen.__getitem__, found), np.uint32, len(found)))
        self.size += len(text or "")

    def rows(self, batch: int) -> Iterator[tuple]:
        """(batch, bucket, ids, sizes, numbers, chunks): of texts without bucket and chunks, of chunks without ids."""
        names = list(self.seen)
        every = np.concatenate(self.places) if self.places else np.zeros(0, np.uint32)
        counts = np.bincount(every, minlength=len(names)).tolist()
        bucket = [zlib.crc32(c.encode()) % BUCKETS for c in names]
        keys = list(zip((-n for n in counts), bucket, names, strict=True))
        order = sorted(range(len(names)), key=keys.__getitem__)
        number = np.empty(len(names), np.uint32)
        number[order] = np.arange(len(names), dtype=np.uint32)
        start = 0
        while start < len(self.ids):
            end, held = start, 0
            while end < len(self.ids) and (end == start or held + len(self.places[end]) <= ROW):
                held += len(self.places[end])
                end += 1
            sizes = np.array([len(p) for p in self.places[start:end]])
            yield batch, None, self.ids[start:end], _planes(sizes), _planes(number[np.concatenate(self.places[start:end])]), None
            start = end
        buckets = np.array(bucket, np.int64)[order]
        by_bucket = np.argsort(buckets, kind="stable")
        cuts = np.flatnonzero(np.diff(buckets[by_bucket], prepend=-1, append=-1)) if len(order) else np.zeros(0, int)
        for a, b in zip(cuts, cuts[1:], strict=False):
            at = by_bucket[a:b]
            own = [names[order[k]] for k in at.tolist()]
            told = "".join(own).encode()
            block = zlib.compress(_planes(np.array([len(c) for c in own])) + told, 6)
            yield batch, int(buckets[at[0]]), None, None, _gaps(at), block


def _strings(block: bytes) -> list[str]:
    """The chunks that Block.rows packed."""
    raw = zlib.decompress(block)
    sizes = zlib.decompressobj()
    planes = np.frombuffer(sizes.decompress(raw), np.uint8).reshape(4, -1)
    ends = np.cumsum(np.ascontiguousarray(planes.T).view("<u4").ravel().astype(np.int64)).tolist()
    text = sizes.unused_data.decode()
    return [text[a:b] for a, b in zip([0, *ends], ends, strict=False)]


def coded(docs: DataFrame, block: int = BLOCK) -> DataFrame:
    """docs (id, text) as rows of Blocks, stored in buckets by batch; a batch is some texts of one task."""
    id_type = docs.schema["id"].dataType.simpleString()
    schema = f"batch long, bucket int, ids array<{id_type}>, sizes binary, numbers binary, chunks binary"

    def numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, made, own, id_kind = TaskContext.get().partitionId(), 0, Block(), None

        def told() -> Iterator[pa.RecordBatch]:
            rows = own.rows(task << 32 | made)
            kinds = (pa.int64(), pa.int32(), pa.list_(id_kind), pa.binary(), pa.binary(), pa.binary())
            while some := list(islice(rows, 64)):
                arrays = [pa.array(list(c), k) for c, k in zip(zip(*some, strict=True), kinds, strict=True)]
                yield pa.RecordBatch.from_arrays(arrays, ["batch", "bucket", "ids", "sizes", "numbers", "chunks"])

        for batch in batches:
            id_kind = batch.schema.field("id").type
            for k, text in zip(batch.column("id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                own.add(k, text)
                if own.size >= block:
                    yield from told()
                    made, own = made + 1, Block()
        if own.ids:
            yield from told()

    return store_bucketed(docs.mapInArrow(numbered, schema), "coded", "batch")


def encode(docs: DataFrame, path: str | None = None, block: int = BLOCK) -> DataFrame:
    """(doc_id, ids, decoded), one row for each row of docs: the ids of its whole text and the text that they decode to.

    Each task numbers the distinct chunks of its texts.  The chunks of all tasks meet in buckets by a hash, where each
    distinct chunk is segmented once; its ids go back to the batches that hold it and are joined by position, with the
    texts as numbers, which are not shuffled (see coded).  A chunk is at most one entry a batch, so frequent chunks are
    no hot keys; a bucket's chunks are streamed.

    Defined results: null text counts as empty and has no ids; repeated rows, repeated or null ids give a row each;
    a text of any length is taken whole (a row and a chunk must fit into a task's memory); an empty table gives an
    empty one.  Only doc_id and text are read, so other columns may have any name.
    """
    path = path or public_tokenizers.path(MODEL)
    ChunkModel(path)

    def segmented(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, known, bucket = ChunkModel(path), {}, None
        for batch in batches:
            out = []
            for own, packed in zip(batch.column("bucket").to_pylist(), batch.column("chunks").to_pylist(), strict=True):
                if own != bucket:
                    known, bucket = {}, own
                found = _strings(packed)
                new = [c for c in found if c not in known]
                known.update(zip(new, model.ids(new), strict=True))
                ids = [known[c] for c in found]
                sizes = np.array([len(i) for i in ids])
                out.append((_planes(sizes), _planes(np.fromiter(chain.from_iterable(ids), np.int64, sizes.sum()))))
            arrays = [pa.array([r[k] for r in out], pa.binary()) for k in range(2)]
            yield pa.RecordBatch.from_arrays([batch.column("batch"), batch.column("numbers"), *arrays], ["of", "numbers", "sizes", "ids"])

    def placed(known: pa.Table, texts: pa.Table) -> pa.Table:
        model, own = ChunkModel(path), {}
        for gaps, sizes, ids in zip(*(known[c].to_pylist() for c in ("numbers", "sizes", "ids")), strict=True):
            own[len(own)] = (np.cumsum(_numbers(gaps)), _numbers(sizes), _numbers(ids))
        numbers, sizes, flat = ([x[k] for x in own.values()] for k in range(3))
        n = sum(map(len, numbers))
        lengths, starts = np.zeros(n, np.int64), np.zeros(n, np.int64)
        at, flat = np.concatenate([*numbers, np.zeros(0, np.int64)]), np.concatenate([*flat, np.zeros(0, np.int64)]).astype(np.int32)
        lengths[at] = np.concatenate([*sizes, np.zeros(0, np.int64)])
        starts[at] = np.cumsum(lengths[at]) - lengths[at]
        listed = flat.tolist()
        words = np.empty(n, object)
        words[:] = model.texts([listed[a:b] for a, b in zip(starts.tolist(), (starts + lengths).tolist(), strict=True)])
        out = []
        for doc_ids, counts, places in zip(*(texts[c].to_pylist() for c in ("ids", "sizes", "numbers")), strict=True):
            if doc_ids is None:  # chunks of the batch
                continue
            at, ends = _numbers(places), np.cumsum(_numbers(counts))
            own_lengths = lengths[at]
            before = np.cumsum(own_lengths) - own_lengths
            values = flat[np.repeat(starts[at] - before, own_lengths) + np.arange(own_lengths.sum())]
            cuts = np.concatenate([[0], np.cumsum(own_lengths)])[np.concatenate([[0], ends])].astype(np.int32)
            said = words[at]
            decoded = ["".join(said[a:b])[1:] for a, b in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)]
            arrays = [pa.array(doc_ids, texts["ids"].type.value_type), pa.ListArray.from_arrays(pa.array(cuts), pa.array(values)), pa.array(decoded, pa.string())]
            out.append(pa.RecordBatch.from_arrays(arrays, ["doc_id", "ids", "decoded"]))
        kinds = [("doc_id", texts["ids"].type.value_type), ("ids", pa.list_(pa.int32())), ("decoded", pa.string())]
        return pa.Table.from_batches(out, pa.schema(kinds))

    rows = coded(docs.select(F.col("doc_id").alias("id"), "text"), block)
    own = rows.where("bucket IS NOT NULL").select("batch", "bucket", "numbers", "chunks")
    met = own.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(segmented, "of long, numbers binary, sizes binary, ids binary")
    id_type = docs.schema["doc_id"].dataType.simpleString()
    texts = rows.where("bucket IS NULL").select("batch", "ids", "sizes", "numbers")
    return met.groupBy("of").cogroup(texts.groupBy("batch")).applyInArrow(placed, f"doc_id {id_type}, ids array<int>, decoded string")


def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's columns over all documents."""
    return encode(table(spark, sf_dir, "documents")).select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )
