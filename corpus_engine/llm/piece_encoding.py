"""SentencePiece encoding by a table of distinct chunks, and decoding.

A text is cut before every run of markers of white space and around every line end. No piece of the model crosses
such a cut (this is checked when the model is read), so each chunk is segmented by itself. Tasks cut blocks of whole
texts; a block writes each of its distinct chunks once, with the chunk's positions in the block. The positions stay
with the block; the chunks are dealt by hash to the buckets of the table of distinct chunks, whose number follows
theirs, are segmented there once, whatever the number of blocks that hold them, and their ids go back to the blocks,
which join them to the positions. A common chunk is one entry per block, however often it occurs. What travels is
packed: numbers in as few bytes as hold them, and compressed.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpus_engine.llm.frames import extended, stored
from corpus_engine.llm.words import blocks, run_hashes

#: The marker that stands for a space, and the character that no longer piece holds.
MARKER, BORDER = "▁", "\n"
#: A model is sent with every task, so its size is checked.
MOST_MODEL_BYTES = 64 << 20
BLOCK_BYTES = 10 << 20
BLOCK_ROWS = 1 << 16
#: The table of distinct chunks has a bucket for so many bytes of text.
BUCKET_BYTES = 5 << 20
#: So many numbers are worked on at once.
WINDOW = 1 << 18
ROW = ["block", "row", "first", "n", "letters", "lengths", "counts", "places"]


def read_model(path: str) -> bytes:
    """The model's bytes; an error if its pieces can cross a cut or it changes texts before it cuts them.

    The driver reads the file; tasks get its bytes, so executors need no copy of it.
    """
    with open(path, "rb") as file:
        model = file.read()
    if len(model) > MOST_MODEL_BYTES:
        raise ValueError(f"the model has {len(model)} bytes, more than {MOST_MODEL_BYTES}")
    sp = processor(model)
    pieces = [sp.id_to_piece(i) for i in range(sp.get_piece_size())]
    if any(MARKER in p.lstrip(MARKER) or (BORDER in p and len(p) > 1) for p in pieces):
        raise ValueError("pieces of the model cross markers or line ends")
    probe = f" a  ﬁ{BORDER}Å "
    if sp.normalize(probe) != MARKER + probe.replace(" ", MARKER) or len(sp.encode(BORDER)) != 2:
        raise ValueError("the model changes texts, puts no marker before them, or has no ids for line ends")
    return model


@lru_cache(maxsize=4)
def processor(model: bytes) -> sentencepiece.SentencePieceProcessor:
    return sentencepiece.SentencePieceProcessor(model_proto=model)


def chunk_ids(sp: sentencepiece.SentencePieceProcessor, chunks: list[str]) -> list[list[int]]:
    """Ids of each chunk as they stand inside a text: the marker and the line end put before it are taken off."""
    return [ids[2:] for ids in sp.encode([BORDER + c for c in chunks], num_threads=1)]


def cut(data: np.ndarray, offsets: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """Chunks of the texts of a block, one after the other, and where those of each text begin.

    Texts begin with the space that stands for the leading marker (empty ones have no byte).
    """
    space, border = data == 0x20, data == 0x0A
    edge = np.zeros(len(data) + 1, dtype=bool)
    edge[offsets] = True
    edge[1:-1] |= (space[1:] & ~space[:-1]) | (border[1:] != border[:-1])
    edge[len(data)] = True
    at = np.flatnonzero(edge)
    first = np.searchsorted(at, offsets)
    chunks = pa.Array.from_buffers(pa.large_string(), len(at) - 1, [None, pa.py_buffer(at.astype(np.int64)), pa.py_buffer(data)])
    return chunks, first


def widths(most: np.ndarray) -> np.ndarray:
    return np.where(most < 1 << 8, 1, np.where(most < 1 << 16, 2, 4))


def packed(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Each run ``first[i]:first[i + 1]`` of rising numbers: the width of its steps, then its steps in so many bytes."""
    step = np.diff(values, prepend=values.dtype.type(0))
    step[first[:-1]] = values[first[:-1]]
    count = np.diff(first)
    width = widths(np.maximum.reduceat(step, first[:-1]))
    parts = [width.astype(np.uint8)]
    for low, high in windows(count):
        own, wide = step[first[low] : first[high]], np.repeat(width[low:high], count[low:high])
        parts.append(own.astype("<u4").view(np.uint8).reshape(-1, 4)[np.arange(4) < wide[:, None]])
    return np.concatenate(parts)


def windows(count: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of runs of about ``WINDOW`` numbers together, or of one longer run."""
    ends, low = np.cumsum(count), 0
    while low < len(count):
        high = max(int(np.searchsorted(ends, (ends[low - 1] if low else 0) + WINDOW, side="right")), low + 1)
        yield low, high
        low = high


def unpacked(data: np.ndarray, count: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The numbers that ``packed`` packed, and the run of each, by windows."""
    width, begin = data[: len(count)].astype(np.int64), len(count)
    for low, high in windows(count):
        wide, run = np.repeat(width[low:high], count[low:high]), np.repeat(np.arange(low, high), count[low:high])
        end = begin + int(wide.sum())
        four = np.zeros((len(wide), 4), dtype=np.uint8)
        four[np.arange(4) < wide[:, None]] = data[begin:end]
        begin, total = end, np.cumsum(four.view("<u4").ravel().astype(np.int64))
        before = np.concatenate([[0], total])[np.cumsum(count[low:high]) - count[low:high]]
        yield total - np.repeat(before, count[low:high]), run


def _buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    column = column.cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    held = column.buffers()[2]
    data = np.frombuffer(held, dtype=np.uint8) if held is not None and held.size else np.empty(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def squeezed(values: np.ndarray) -> bytes:
    """Numbers from 0 in one, two or four bytes each, compressed."""
    most = int(values.max()) if len(values) else 0
    kind = next(k for k in ("<u1", "<u2", "<u4") if most < 1 << (8 * np.dtype(k).itemsize))
    return kind.encode() + len(values).to_bytes(8, "little") + pa.compress(values.astype(kind).tobytes(), "zstd", asbytes=True)


def spread(data: bytes) -> np.ndarray:
    """The numbers that ``squeezed`` packed."""
    kind, n = np.dtype(data[:3].decode()), int.from_bytes(data[3:11], "little")
    return np.frombuffer(pa.decompress(data[11:], n * kind.itemsize, "zstd", asbytes=True), dtype=kind)


def letters_of(chunks: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of chunks, one after the other, and the bytes of each."""
    data, offsets = _buffers(chunks)
    return data, np.diff(offsets)


def chunks_of(letters: bytes, lengths: bytes) -> pa.Array:
    data, size = spread(letters), spread(lengths).astype(np.int64)
    offsets = np.concatenate([[0], np.cumsum(size)])
    return pa.Array.from_buffers(pa.large_string(), len(size), [None, pa.py_buffer(offsets), pa.py_buffer(data)])


def cut_into_chunks(docs: DataFrame, text: str, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Rows of blocks. Of each document: its columns but the text, and where its chunks lie (first, n). Of the block:
    its distinct chunks in order (letters, lengths), their number (n), how often each occurs (counts) and where (places)."""
    kept = [c for c in docs.columns if c != text]
    ordered = docs.select(F.col(text), *kept)

    def rows(number: int, texts: pa.Array, row: pa.Array) -> Iterator[pa.RecordBatch]:
        # One block of `blocks` holds all texts here, since block_bytes cut the texts before.
        _, _, data, offsets = next(blocks(texts, 1 << 62, 1 << 62))
        # A block is known by what it holds, so that it is the same whenever it is cut; one without chunks asks for
        # nothing and may have any name. Blocks that are equal in all columns share their positions and ids.
        columns = pa.RecordBatch.from_arrays([row], names=["row"]).serialize()
        named = xxhash.xxh3_64_intdigest(columns, seed=xxhash.xxh3_64_intdigest(data)) if len(data) else number
        block = int(np.uint64(named).astype(np.int64))
        chunks, first = cut(data, offsets)
        coded = chunks.dictionary_encode()
        by_name = pc.sort_indices(coded.dictionary)
        order = np.empty(len(by_name), dtype=np.int32)
        order[by_name.to_numpy()] = np.arange(len(by_name), dtype=np.int32)
        codes = order[coded.indices.to_numpy()]  # numbers in the order of the chunks, where like ones stand together
        names = coded.dictionary.take(by_name)
        del chunks, coded, by_name, order, data
        starts = np.concatenate([[0], np.cumsum(np.bincount(codes, minlength=len(names)))])
        places = np.argsort(codes, kind="stable").astype(np.int32)
        del codes
        n = len(row)
        empty = [pa.nulls(n, pa.binary())] * 4
        yield pa.RecordBatch.from_arrays([pa.array(np.full(n, block)), row, pa.array(first[:-1].astype(np.int64)), pa.array(np.diff(first).astype(np.int64)), *empty], names=ROW)
        if len(names):
            letters, lengths = letters_of(names)
            held = [squeezed(letters), squeezed(lengths), squeezed(np.diff(starts)), squeezed(packed(places, starts))]
            packs = [pa.array([x], pa.binary()) for x in held]
            yield pa.RecordBatch.from_arrays([pa.array([block]), pa.nulls(1, row.type), pa.nulls(1, pa.int64()), pa.array([len(names)]), *packs], names=ROW)

    def marked(texts: pa.Array) -> pa.Array:
        texts = pc.replace_substring(pc.fill_null(texts.cast(pa.large_string()), ""), MARKER, " ")
        spaced = pc.binary_join_element_wise(pa.scalar(" ", pa.large_string()), texts, pa.scalar("", pa.large_string()))
        return pc.if_else(pc.equal(texts, ""), texts, spaced)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        texts, held, size = [], [], 0
        for batch in batches:
            row = pa.StructArray.from_arrays([pa.array(np.zeros(len(batch), bool)), *batch.columns[1:]], names=["_", *batch.schema.names[1:]])
            for start, stop, data, _ in blocks(batch.column(0), max(block_bytes // 8, 1)):
                texts.append(marked(batch.column(0)[start:stop]))
                held.append(row[start:stop])
                size += len(data)
                if size >= block_bytes or sum(map(len, held)) >= BLOCK_ROWS:
                    yield from rows(number, pa.concat_arrays(texts), pa.concat_arrays(held))
                    number, texts, held, size = number + 1, [], [], 0
        if texts:
            yield from rows(number, pa.concat_arrays(texts), pa.concat_arrays(held))

    fields = ", ".join(["_: boolean", *(f"`{f.name}`: {f.dataType.simpleString()}" for f in ordered.schema.fields[1:])])
    return ordered.mapInArrow(run, f"block long, row struct<{fields}>, first long, n long, letters binary, lengths binary, counts binary, places binary")


def deal(pieces: DataFrame, buckets: int) -> DataFrame:
    """(bucket, block, numbers, letters, lengths): the chunks of each block by bucket, and their numbers in the block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, letters, lengths in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                names = chunks_of(letters, lengths)
                data, offsets = _buffers(names)
                bucket = (run_hashes(data, offsets[:-1], offsets[1:]) % np.uint64(buckets)).astype(np.int64)
                order = np.argsort(bucket, kind="stable")
                own, at = np.unique(bucket[order], return_index=True)
                ends, out = [*at[1:], len(order)], []
                for low, high in zip(at, ends, strict=True):
                    numbers = order[low:high]
                    data, size = letters_of(names.take(pa.array(numbers)))
                    out.append((squeezed(np.diff(numbers, prepend=0)), squeezed(data), squeezed(size)))
                columns = [pa.array(x, pa.binary()) for x in zip(*out, strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(own), pa.array(np.full(len(own), block)), *columns], names=["bucket", "block", "numbers", "letters", "lengths"])

    return pieces.select("block", "letters", "lengths").mapInArrow(run, "bucket long, block long, numbers binary, letters binary, lengths binary")


def segment(dealt: DataFrame, model: bytes) -> DataFrame:
    """(block, numbers, sizes, ids): the distinct chunks of each bucket segmented once, back to the blocks that hold them."""

    def run(rows: pa.Table) -> pa.Table:
        held = [chunks_of(a, b) for a, b in zip(rows["letters"].to_pylist(), rows["lengths"].to_pylist(), strict=True)]
        coded = pa.concat_arrays(held).dictionary_encode()
        sp, size, ids = processor(model), [], []
        for i in range(0, len(coded.dictionary), 10_000):
            found = chunk_ids(sp, coded.dictionary[i : i + 10_000].to_pylist())
            size.append(np.array([len(x) for x in found], dtype=np.int64))
            ids.append(np.array([x for one in found for x in one], dtype=np.int64))
        size, ids = np.concatenate(size), np.concatenate(ids)
        codes, low, out = coded.indices.to_numpy(), 0, []
        for part in held:
            mine = codes[low : low + len(part)]
            low += len(part)
            out.append((squeezed(size[mine]), squeezed(runs(ids, np.cumsum(size) - size, size, mine))))
        sizes, found = (pa.array(x, pa.binary()) for x in zip(*out, strict=True))
        return pa.Table.from_arrays([rows["block"], rows["numbers"], sizes, found], names=["block", "numbers", "sizes", "ids"])

    return dealt.groupBy("bucket").applyInArrow(run, "block long, numbers binary, sizes binary, ids binary")


def runs(values: np.ndarray, low: np.ndarray, size: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The runs of ``size`` values from ``low`` on, for each of ``at``, one after the other."""
    size = size[at]
    ends = np.cumsum(size)
    return values[np.repeat(low[at] - (ends - size), size) + np.arange(ends[-1] if len(ends) else 0)]


def assemble(table: pa.Table) -> tuple[pa.Array, pa.Array]:
    """Columns and ids of the documents of one block, from its rows of documents, of positions and of ids."""
    docs = table.filter(pc.is_valid(table["row"])).combine_chunks()
    first, n = docs["first"].to_numpy(), docs["n"].to_numpy()
    own = table.filter(pc.is_valid(table["counts"]))
    replies = table.filter(pc.is_valid(table["numbers"]))
    order = np.lexsort((n, first))  # documents come in any order; one without chunks stands before the next one's
    first, n = first[order], n[order]
    parts, size = [], np.zeros(len(n), np.int64)
    if len(own):
        count = spread(own["counts"][0].as_py()).astype(np.int64)
        chunk_at = np.empty(count.sum(), dtype=np.int32)
        for position, chunk in unpacked(spread(own["places"][0].as_py()), count):
            chunk_at[position] = chunk
        numbers, sizes, ids = [], [], []
        for a, b, c in zip(replies["numbers"].to_pylist(), replies["sizes"].to_pylist(), replies["ids"].to_pylist(), strict=True):
            numbers.append(np.cumsum(spread(a).astype(np.int64)))
            sizes.append(spread(b).astype(np.int64))
            ids.append(spread(c).astype(np.int32))
        number, sizes, ids = np.concatenate(numbers), np.concatenate(sizes), np.concatenate(ids)
        low, length = np.empty(len(count), np.int64), np.empty(len(count), np.int64)
        low[number], length[number] = np.cumsum(sizes) - sizes, sizes
        for i, j in windows(n):
            at = chunk_at[first[i] : first[j - 1] + n[j - 1]]
            parts.append(runs(ids, low, length, at))
            ends = np.concatenate([[0], np.cumsum(length[at])])
            begin = first[i:j] - first[i]
            size[i:j] = ends[begin + n[i:j]] - ends[begin]
    took = np.concatenate(parts) if parts else np.empty(0, np.int32)
    row = docs["row"].chunk(0) if docs["row"].num_chunks else pa.array([], docs.schema.field("row").type)
    return row.take(pa.array(order)), pa.LargeListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(size)])), pa.array(took))


def encode(docs: DataFrame, model_path: str, text: str = "text", block_bytes: int = BLOCK_BYTES, bucket_bytes: int = BUCKET_BYTES, settled: bool = False) -> DataFrame:
    """All columns of ``docs`` but the text, and ``_ids``: what the library's ``encode`` gives for the whole text.

    No begin or end ids, no sampling. Null and empty texts have no ids; repeated rows each have theirs; an empty
    table gives an empty result. A column named ``_ids`` is replaced, other names don't clash. A text is held
    whole by the task that cuts it and the one that puts it together. Texts are cut twice, for the chunks and for their
    positions, which costs less than to write both: so rows that are ``settled`` (a table read from files, which come in
    the same order again) are read twice, others are stored first.
    """
    model = read_model(model_path)
    docs = docs.drop("_ids") if text != "_ids" else docs
    docs = docs if settled else stored(docs)
    kept = [c for c in docs.columns if c != text]
    pieces = cut_into_chunks(docs, text, block_bytes)
    own = pieces.filter("counts IS NOT NULL")
    buckets = (docs.agg(F.sum(F.octet_length(text))).first()[0] or 0) // bucket_bytes + 1
    replies = segment(deal(own, buckets), model)
    none = lambda c: F.lit(None).cast("binary").alias(c)
    asked = pieces.select("block", "row", "first", "n", "counts", "places", none("numbers"), none("sizes"), none("ids"))
    told = replies.select("block", F.lit(None).cast(pieces.schema["row"].dataType).alias("row"), F.lit(None).cast("long").alias("first"), F.lit(None).cast("long").alias("n"), none("counts"), none("places"), "numbers", "sizes", "ids")

    def put_together(rows: pa.Table) -> pa.Table:
        row, ids = assemble(rows)
        columns = [row.field(i + 1) for i in range(row.type.num_fields - 1)]
        return pa.Table.from_arrays([*columns, ids.cast(pa.list_(pa.int32()))], names=[*(f.name for f in list(row.type)[1:]), "_ids"])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields if f.name in kept), "_ids array<int>"])
    return asked.unionByName(told).groupBy("block").applyInArrow(put_together, schema)


def decode(encoded: DataFrame, model_path: str, ids: str = "_ids") -> DataFrame:
    """All columns and ``_text``: what the library's ``decode`` gives for the ids; empty for null or no ids."""
    model = read_model(model_path)
    encoded = encoded.drop("_text") if ids != "_text" else encoded
    at = encoded.columns.index(ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sp = processor(model)
        for batch in batches:
            for i in range(0, len(batch), 100):
                part = batch.slice(i, 100)
                texts = [sp.decode(x) if x else "" for x in part.column(at).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(texts, pa.string())], names=[*part.schema.names, "_text"])

    return encoded.mapInArrow(run, extended(encoded, _text="string"))
