"""BPE encoding through a distinct-word table, and decoding through an id-to-piece join."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import column, load_tokenizer, read, texts, worker_cache
from .wordtable import through_words

ENCODED = "doc_id long, n_bytes long, ids array<int>"
DIGESTS = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def units_of(text: str) -> list[str]:
    """Words between blanks and line feeds; what else this vocabulary takes for white space stays inside a word, for the tokenizer."""
    return list(filter(None, text.replace("\n", " ").split(" ")))


def id_bytes(path: str):
    """Distinct words -> their ids, little-endian and 32 bits each."""

    def value_of(words: list[str]) -> list[bytes]:
        tok = load_tokenizer(path)
        return [np.array(e.ids, "<u4").tobytes() for i in range(0, len(words), 20_000) for e in tok.encode_batch_fast(words[i : i + 20_000], add_special_tokens=False)]

    return value_of


def pieces_of(path: str) -> list[bytes]:
    """The id-to-piece table of a vocabulary, by id; its size is the vocabulary's, whatever the corpus."""
    cache = worker_cache()
    if ("pieces", path) not in cache:
        tok = load_tokenizer(path)
        cache["pieces", path] = [(tok.id_to_token(i) or "").encode() for i in range(tok.get_vocab_size(with_added_tokens=True))]
    return cache["pieces", path]


def encode(docs: DataFrame, tokenizer_path: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_bytes, ids`` for each row, as ``tokenizers`` gives them without added tokens.

    For vocabularies that drop white space. A null text counts as empty, with no ids. Null ids of
    documents stay null, repeated rows are encoded each, an empty table gives no rows, other columns
    are ignored.
    """

    def assemble(doc_ids, n_bytes, lens, places, times, values) -> Iterator[tuple]:
        ends = np.cumsum(lens, dtype=np.int64)
        for doc_id, size, lo, hi in zip(doc_ids, n_bytes, (ends - lens).tolist(), ends.tolist(), strict=True):
            yield doc_id, size, np.frombuffer(b"".join(map(values.__getitem__, places[lo:hi].tolist())), "<u4").astype(np.int32)

    return through_words(texts(docs, id_col, text_col), units_of, id_bytes(tokenizer_path), assemble, ENCODED, counted=False)


def decode(encoded: DataFrame, tokenizer_path: str, *, key: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """``key, decoded``: pieces joined by a blank, as ``decode(ids, skip_special_tokens=False)`` of a vocabulary without decoder.

    The id-to-piece table has one row for each id of the vocabulary, so it is broadcast. Keys have to
    be unique; null or empty ids decode to an empty text; ids outside the vocabulary are left out.
    """
    spark = encoded.sparkSession
    table = spark.createDataFrame([(i, p.decode()) for i, p in enumerate(pieces_of(tokenizer_path))], "id int, piece string")
    rows = encoded.select(column(key).alias("k"), F.posexplode_outer(column(ids_col)).alias("at", "id")).join(F.broadcast(table), "id", "left")
    return rows.groupBy("k").agg(F.array_sort(F.collect_list(F.when(F.col("piece").isNotNull(), F.struct("at", "piece")))).alias("p")).select(F.col("k").alias(key), F.array_join(F.col("p.piece"), " ").alias("decoded"))


def round_trip(docs: DataFrame, tokenizer_path: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``DIGESTS`` of the ids and of the decoded text of each row; cases as in ``encode``.

    The ids come back by position as in ``encode``; each distinct word of a chunk is joined with the
    id-to-piece table once, and a document's decoded text is its words' pieces in order.
    """

    def assemble(doc_ids, n_bytes, lens, places, times, values) -> Iterator[tuple]:
        pieces = pieces_of(tokenizer_path)
        some = [np.frombuffer(v, "<u4").tolist() for v in values]
        numbers, text = [" ".join(map(str, x)).encode() for x in some], [b" ".join(map(pieces.__getitem__, x)) for x in some]
        size = np.array([len(x) for x in some], np.int64) if some else np.zeros(0, np.int64)
        ends = np.cumsum(lens, dtype=np.int64)
        for doc_id, lo, hi in zip(doc_ids, (ends - lens).tolist(), ends.tolist(), strict=True):
            own = places[lo:hi]
            n = size[own]
            own = own[n > 0].tolist()
            yield doc_id, int(n.sum()), hashlib.sha256(b" ".join(map(numbers.__getitem__, own))).hexdigest(), hashlib.sha256(b" ".join(map(text.__getitem__, own))).hexdigest()

    return through_words(texts(docs, id_col, text_col), units_of, id_bytes(tokenizer_path), assemble, DIGESTS, counted=False)


def op6_bpe(spark, sf_dir: str) -> DataFrame:
    """Every text of ``documents`` through word_bpe_49k and back."""
    import public_tokenizers

    return round_trip(read(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
