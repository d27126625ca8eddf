"""Token counts: pieces are counted once for each distinct pre-token and summed over a document's pre-tokens."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame

from .common import load_tokenizer, read, texts, worker_cache
from .wordtable import through_words

#: Characters outside these ranges may have got their class in a later Unicode version than the library knows.
SETTLED = r"[^\x00-\u0557\u0590-\u06ff\u2000-\u206f\u20a0-\u20bf\u3041-\u3096\u30a1-\u30fa\u4e00-\u9fa5\uac00-\ud7a3]"
COUNTS = "doc_id long, n_bytes long, n_tokens long"


def splitter(path: str, pattern: str):
    """Cuts a text into pre-tokens as a byte-level vocabulary does; the strings of added tokens are pre-tokens of their own."""

    def cut(text: str) -> list[str]:
        cache = worker_cache()
        if ("cut", path, pattern) not in cache:
            import regex

            added = sorted((t.content for t in load_tokenizer(path).get_added_tokens_decoder().values()), key=len, reverse=True)
            cache["cut", path, pattern] = regex.compile(pattern), regex.compile("(" + "|".join(map(regex.escape, added)) + ")") if added else None, added, regex.compile(SETTLED)
        find, special, added, unsettled = cache["cut", path, pattern]
        plain = find.findall
        if not text.isascii() and unsettled.search(text):
            plain = lambda part: [part[a:b] for _, (a, b) in load_tokenizer(path).pre_tokenizer.pre_tokenize_str(part)]
        if special is None or not any(a in text for a in added):
            return plain(text)
        out: list[str] = []
        for i, part in enumerate(special.split(text)):
            out += [part] if i % 2 else plain(part)
        return out

    return cut


def count_tokens(docs: DataFrame, tokenizer_path: str, pattern: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_bytes, n_tokens`` for each row, as ``tokenizers`` encodes its text without special tokens around it.

    ``pattern`` is the one that splits text before merges of a byte-level vocabulary without normaliser.
    A null text counts as empty, with no tokens. Null ids stay null, repeated rows are counted each,
    an empty table gives no rows, other columns are ignored.
    """

    def pieces(words: list[str]) -> list[bytes]:
        tok = load_tokenizer(tokenizer_path)
        return [np.array([len(e.ids)], "<u4").tobytes() for i in range(0, len(words), 20_000) for e in tok.encode_batch_fast(words[i : i + 20_000], add_special_tokens=False)]

    def assemble(doc_ids, n_bytes, lens, places, times, values) -> Iterator[tuple]:
        each = np.frombuffer(b"".join(values), "<u4").astype(np.int64)
        total = np.concatenate([[0], np.cumsum(each[places] * times)])
        ends = np.cumsum(lens, dtype=np.int64)
        yield from zip(doc_ids, n_bytes, (total[ends] - total[ends - lens]).tolist(), strict=True)

    return through_words(texts(docs, id_col, text_col), splitter(tokenizer_path, pattern), pieces, assemble, COUNTS, counted=True)


def op3_tokens(spark, sf_dir: str) -> DataFrame:
    """Tokens of byte_bpe_50k in every text of ``documents``; ``over_limit`` beyond 1024."""
    import public_tokenizers as p

    return count_tokens(read(spark, sf_dir, "documents"), p.path("byte_bpe_50k.json"), p.PATTERN).selectExpr("doc_id", "n_bytes", "n_tokens", "n_tokens > 1024 AS over_limit")
