"""A distinct-word table for a corpus, and the way back from it to the documents.

Documents are gathered in chunks of bounded size. A chunk's distinct words are dealt to buckets by
their hash; a bucket, which meets each of its words once whatever the number of chunks, computes a
value for it. The values come back to the chunks packed, and each document is put together from its
own list of places in the chunk's words. What is shuffled is the chunks' distinct words and their
values; the documents' lists stay where they were written, in a table bucketed by chunk.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import plan_bytes, scratch_path

CHUNK = "chunk long, doc_ids array<long>, n_bytes array<long>, lens binary, places binary, times binary, words array<struct<bucket:int,packed:binary>>"
#: Bytes of text in a chunk, and words that a bucket keeps at a time.
CHUNK_BYTES, KEPT_WORDS = 24_000_000, 1_000_000


def squeeze(a: np.ndarray | bytes) -> bytes:
    return zstandard.ZstdCompressor(level=3).compress(a if isinstance(a, bytes) else a.tobytes())


def opened(b: bytes, kind: str = "<u4") -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(b), kind)


def pack_strings(parts: list[bytes]) -> bytes:
    return squeeze(np.array([len(parts), *map(len, parts)], "<u4").tobytes() + b"".join(parts))


def unpack_strings(b: bytes) -> list[bytes]:
    raw = zstandard.ZstdDecompressor().decompress(b)
    n = int(np.frombuffer(raw, "<u4", 1)[0])
    ends = np.cumsum(np.frombuffer(raw, "<u4", n, 4), dtype=np.int64) + 4 * (n + 1)
    starts = np.concatenate([[4 * (n + 1)], ends[:-1]]) if n else []
    return [raw[a:b] for a, b in zip(starts, ends, strict=True)]


class Places(dict):
    """word -> its place, given out in the order of first look-up."""

    def __missing__(self, word: str) -> int:
        self[word] = n = len(self)
        return n


def chunks(docs: DataFrame, words_of: Callable[[str], list[str]], buckets: int, counted: bool) -> DataFrame:
    """``docs(doc_id, text)`` in chunks; ``counted``: distinct words and times, not the words in order."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        no = TaskContext.get().partitionId() << 32
        table, ids, sizes, lists, times, held = Places(), [], [], [], [], 0

        def out() -> pa.RecordBatch:
            nonlocal no, table, ids, sizes, lists, times, held
            words = [w.encode() for w in table]
            bucket = np.fromiter(map(xxhash.xxh32_intdigest, words), np.uint32, len(words)) % buckets
            order = sorted(range(len(words)), key=lambda i: (bucket[i], words[i]))
            place = np.empty(len(words), "<u4")
            place[order] = np.arange(len(words), dtype="<u4")
            at = bucket[order]
            edges = [0, *(np.nonzero(np.diff(at))[0] + 1).tolist(), len(order)] if len(order) else [0]
            packed = [{"bucket": int(at[a]), "packed": pack_strings([words[i] for i in order[a:b]])} for a, b in zip(edges, edges[1:])]  # noqa: B905
            row = {
                "chunk": [no], "doc_ids": [ids], "n_bytes": [sizes], "lens": [squeeze(np.array([len(x) for x in lists], "<u4"))],
                "places": [squeeze(place[np.concatenate(lists)] if lists else place[:0])], "times": [squeeze(np.concatenate(times) if times else place[:0])], "words": [packed],
            }
            no, table, ids, sizes, lists, times, held = no + 1, Places(), [], [], [], [], 0
            return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(row.values(), (pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary(), pa.binary(), pa.binary(), pa.list_(pa.struct([("bucket", pa.int32()), ("packed", pa.binary())]))), strict=True)], list(row))

        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                text = text.as_py() or ""
                words = words_of(text)
                if counted:
                    many: dict[str, int] = {}
                    for w in words:
                        many[w] = many.get(w, 0) + 1
                    words = list(many)
                    times.append(np.fromiter(many.values(), "<u4", len(many)))
                lists.append(np.fromiter(map(table.__getitem__, words), "<u4", len(words)))
                ids.append(doc_id)
                sizes.append(len(text.encode()))
                held += sizes[-1] + 200
                if held >= CHUNK_BYTES:
                    yield out()
        if ids:
            yield out()

    return docs.mapInArrow(run, CHUNK)


def through_words(docs: DataFrame, words_of: Callable[[str], list[str]], value_of: Callable[[list[str]], list[bytes]], assemble: Callable, schema: str, counted: bool) -> DataFrame:
    """Values of distinct words, put together for each document.

    ``value_of`` gets distinct words in batches; ``assemble(doc_ids, n_bytes, lens, places, times, values)``
    gets a chunk and yields tuples of ``schema``.
    """
    spark = docs.sparkSession
    shards = max(4, min(100_000, plan_bytes(docs) // 8_000_000))
    buckets = max(64, min(65_536, 4 * shards))
    name = f"sparkloom_chunks_{uuid.uuid4().hex}"
    chunked = chunks(docs, words_of, buckets, counted)
    chunked.write.bucketBy(shards, "chunk").format("parquet").option("path", scratch_path(spark, "chunks")).option("compression", "none").saveAsTable(name)
    table = spark.table(name)

    def values(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[bytes, bytes] = {}
        bucket = None
        for batch in batches:
            for r in batch.to_pylist():
                if r["bucket"] != bucket or len(known) > KEPT_WORDS:
                    known, bucket = {}, r["bucket"]
                words = unpack_strings(r["packed"])
                new = [w for w in words if w not in known]
                known.update(zip(new, value_of([w.decode() for w in new]), strict=True))
                yield pa.RecordBatch.from_arrays([pa.array([r["chunk"]], pa.int64()), pa.array([r["bucket"]], pa.int32()), pa.array([pack_strings([known[w] for w in words])], pa.binary())], ["chunk", "bucket", "packed"])

    dealt = table.select("chunk", F.explode("words").alias("w")).select("chunk", "w.bucket", "w.packed")
    valued = dealt.repartition(min(buckets, shards), "bucket").sortWithinPartitions("bucket").mapInArrow(values, "chunk long, bucket int, packed binary")
    # dealt as the bucketed table is, or the join would deal the documents' lists anew
    back = valued.repartition(shards, "chunk").groupBy("chunk").agg(F.array_sort(F.collect_list(F.struct("bucket", "packed"))).alias("values"))

    def whole(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out_schema = None
        for batch in batches:
            for i in range(batch.num_rows):
                r = batch.slice(i, 1).to_pylist()[0]
                vals = [v for x in r["values"] or () for v in unpack_strings(x["packed"])]
                rows = list(assemble(r["doc_ids"], r["n_bytes"], opened(r["lens"]), opened(r["places"]), opened(r["times"]), vals))
                out_schema = out_schema or pa.schema([(c.split()[0], {"long": pa.int64(), "string": pa.string(), "boolean": pa.bool_(), "array<int>": pa.list_(pa.int32())}[c.split()[1]]) for c in schema.split(", ")])
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), out_schema, strict=True)], schema=out_schema)

    return table.drop("words").join(back, "chunk", "left").mapInArrow(whole, schema)
