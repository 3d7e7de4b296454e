"""Packing token pieces into near-equal windows by multiway differencing (operator 6)."""

from __future__ import annotations

import heapq
import os
import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from quillspark.llm.storage import table

WINDOW = 2048
#: What is left of a document behind its full windows is cut into pieces of at most this many tokens.
PIECE = 512
#: Pieces that are packed together.
BATCH = 2048
END_ID = 1
#: Bytes of text whose distinct words are looked up at a time, and words whose ids are spread out at a time.
SLICE, SPREAD = 6_000_000, 250_000
#: Pre-tokens whose ids a Python worker remembers.
REMEMBERED = 200_000


def difference(sizes: np.ndarray, ways: int) -> list[list[int]]:
    """Karmarkar-Karp multiway differencing: items dealt to `ways` sets of near-equal sums.

    Starts from one partial partition an item, its sums (size, 0, ..., 0).  The two partial partitions of
    largest spread are merged, the largest sums of one with the smallest of the other, until one is left.
    """
    n = len(sizes)
    if not n:
        return [[] for _ in range(ways)]
    after = np.full(n, -1)
    last = np.arange(n)
    heap: list[tuple[int, int]] = []
    parts: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for k, size in enumerate(sizes.tolist()):
        # sums in descending order without the zeros behind, and the first item of each set
        parts[k] = (np.array([size], np.int64), np.array([k]))
        heap.append((-size if ways > 1 else 0, k))
    heapq.heapify(heap)
    named = n
    while len(heap) > 1:
        _, x = heapq.heappop(heap)
        _, y = heapq.heappop(heap)
        (sx, fx), (sy, fy) = parts.pop(x), parts.pop(y)
        alike = max(0, len(sx) + len(sy) - ways)  # sets that get something from both sides
        kx, ky = len(sx) - alike, len(sy) - alike
        tail_x, tail_y = fx[kx:], fy[ky:][::-1]
        if alike:
            after[last[tail_x]] = tail_y
            last[tail_x] = last[tail_y]
        sums = np.concatenate([sx[:kx], sx[kx:] + sy[ky:][::-1], sy[:ky]])
        first = np.concatenate([fx[:kx], tail_x, fy[:ky]])
        order = np.argsort(-sums, kind="stable")
        sums, first = sums[order], first[order]
        least = int(sums[-1]) if len(sums) == ways else 0
        parts[named] = (sums, first)
        heapq.heappush(heap, (least - int(sums[0]), named))
        named += 1
    sets = []
    for item in parts[heap[0][1]][1].tolist():
        own = []
        while item >= 0:
            own.append(item)
            item = int(after[item])
        sets.append(own)
    return sets + [[] for _ in range(ways - len(sets))]


def windows(sizes: np.ndarray, capacity: int = WINDOW) -> list[list[int]]:
    """Items (each at most capacity) in as few near-equal windows as differencing fits them into.

    Starts at the least possible number; while the fullest window is above capacity the number rises.
    """
    ways = max(1, -(-int(sizes.sum()) // capacity))
    while True:
        sets = difference(sizes, ways)
        if max((int(sizes[x].sum()) for x in sets), default=0) <= capacity:
            return [x for x in sets if x]
        ways += 1


#: Fixed values of the vocabulary's pre-tokenizer, and words on which its steps are as plain as below:
#: printable ASCII and Latin letters, where normalising is lower-casing.
PRETOKEN = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+")
PLAIN = re.compile(r"[\x21-\x7e\xa1-\u024f]+")


def byte_characters() -> dict[int, str]:
    """The character that stands for each byte: itself if it prints, else the next from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    return {b: chr(b) for b in plain} | {b: chr(0x100 + k) for k, b in enumerate(sorted({*range(256)} - {*plain}))}


class WordIds:
    """ids of texts, word by word.

    The vocabulary's normaliser and pre-tokenizer never look across ASCII white space, so a text's ids are
    those of its words in turn.  Each distinct word of a batch is looked at once; its pre-tokens are
    remembered across batches, up to a bound.  Plain words skip the library's slow alignment of normalised
    text; all others go through the whole tokenizer.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.bytes = byte_characters()
        self.pieces: dict[str, bytes] = {}

    def piece(self, piece: str) -> bytes:
        """ids of one pre-token, in lower case."""
        found = self.pieces.get(piece)
        if found is None:
            form = piece if piece.isascii() else piece.encode().decode("latin-1").translate(self.bytes)
            found = self.pieces[piece] = array("I", [t.id for t in self.model.tokenize(form)]).tobytes()
        return found

    def word(self, text: str) -> bytes:
        """ids of a word, unsigned 32-bit."""
        if not PLAIN.fullmatch(text) or ("|" in text and any(x in text for x in self.special)):
            return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes() if text else b""
        text = text.lower()
        if text.isalpha():
            return self.piece(text)
        if text[-1] in ",." and text[:-1].isalpha():
            return self.piece(text[:-1]) + self.piece(text[-1])
        return b"".join([self.piece(x) for x in PRETOKEN.findall(text)])

    def __call__(self, texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(first, ids, edges) of runs of about SPREAD words: the ids of text first + k are ids[edges[k]:edges[k + 1]].

        Each distinct word of the texts is looked up once; ids are spread out run by run.  Null counts as empty.
        """
        if len(self.pieces) > REMEMBERED:
            self.pieces.clear()
        lists = pc.ascii_split_whitespace(pc.fill_null(texts.cast(pa.large_string()), ""))
        coded = lists.flatten().dictionary_encode()
        own = [self.word(w) for w in coded.dictionary.to_pylist()]
        at = coded.indices.to_numpy()
        lengths = np.fromiter(map(len, own), np.int64, len(own)) // 4
        starts = np.cumsum(lengths) - lengths
        known = np.frombuffer(b"".join(own), "<u4")
        offsets = lists.offsets.to_numpy() - lists.offsets[0].as_py()
        first = 0
        while first < len(texts):
            last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + SPREAD, "right")) - 1)
            here = at[offsets[first] : offsets[last]]
            each = lengths[here]
            ends = np.concatenate([[0], np.cumsum(each)])
            ids = known[np.repeat(starts[here] - ends[:-1], each) + np.arange(ends[-1])]
            yield first, ids, ends[offsets[first : last + 1] - offsets[first]]
            first = last


_encoders: dict[str, WordIds] = {}


def encoder(path: str) -> WordIds:
    if path not in _encoders:
        _encoders[path] = WordIds(path)
    return _encoders[path]


def cuts(tokens: int) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces: full windows, then pieces of near-equal length."""
    full = [(k, WINDOW) for k in range(0, tokens - WINDOW + 1, WINDOW)]
    start = len(full) * WINDOW
    left = tokens - start
    count = -(-left // PIECE)
    edges = [start + left * k // count for k in range(count + 1)] if count else []
    return full + [(a, b - a) for a, b in zip(edges, edges[1:], strict=False)]


def slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """batch in slices of about SLICE bytes of text, one row at least."""
    size = np.cumsum(pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    edges = np.flatnonzero(np.diff(size // SLICE, prepend=0))
    for a, b in zip([0, *edges], [*edges, len(batch)], strict=True):
        if b > a:
            yield batch.slice(a, b - a)


SCHEMA = "doc_id {}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def pack(docs: DataFrame, path: str | None = None) -> DataFrame:
    """One row for each piece of each row of docs (doc_id, text): where it comes from and where it lies.

    Each task tokenizes its rows and packs their pieces in batches of BATCH, so nothing is shuffled and
    memory holds one batch; sequence ids are the task's partition number and a counter.  A task that runs
    again packs the same rows the same way.

    Defined results: null or blank text is the closing id alone; repeated rows are packed each; ids may be
    null; an empty table gives an empty one.  Only doc_id and text are read.
    """
    path = path or public_tokenizers.path("word_bpe_49k.json")
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of = encoder(path)
        task = TaskContext.get()
        sequence = (task.partitionId() if task else 0) << 36
        end = np.array([END_ID], "<u4").tobytes()
        pending: list[tuple] = []

        def flush() -> pa.RecordBatch:
            nonlocal sequence
            out: list[tuple] = []
            short = [p for p in pending if p[2] < WINDOW]
            for p in pending:
                if p[2] == WINDOW:
                    out.append((*p, sequence, 0))
                    sequence += 1
            for own in windows(np.array([p[2] for p in short], np.int64)) if short else []:
                offset = 0
                for k in own:
                    out.append((*short[k], sequence, offset))
                    offset += short[k][2]
                sequence += 1
            pending.clear()
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
            columns = list(zip(*out, strict=True))
            arrays = [pa.array(columns[0], id_arrow), *(pa.array(c, pa.int64()) for c in columns[1:])]
            return pa.RecordBatch.from_arrays(arrays, names)

        id_arrow = None
        for batch in batches:
            id_arrow = batch.column(0).type
            for part in slices(batch):
                names = part.column(0).to_pylist()
                for first, ids, edges in ids_of(part.column(1)):
                    for k, doc_id in enumerate(names[first : first + len(edges) - 1]):
                        raw = ids[edges[k] : edges[k + 1]].tobytes() + end
                        tokens = len(raw) // 4
                        view = memoryview(raw)
                        for start, length in cuts(tokens):
                            crc = zlib.crc32(view[4 * start : 4 * (start + length)])
                            pending.append((doc_id, start, length, crc, tokens))
                        if len(pending) >= BATCH:
                            yield flush()
        if pending:
            yield flush()

    return docs.select("doc_id", F.col("text")).mapInArrow(run, SCHEMA.format(id_type))


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's columns over all documents."""
    return pack(table(spark, sf_dir, "documents"))
