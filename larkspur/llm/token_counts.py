"""Token counts: batch encoding in Arrow functions that return lengths only.

Batches are balanced by bytes, not rows, and a long text is cut at places where the encoding cannot join tokens,
so that no batch holds much more than ``batch_bytes``.

A null text counts as empty: no bytes, no tokens. Equal rows get equal counts; an empty table gives an empty one. Where
the vocabulary gives no safe place for a cut, as its own description tells, texts are encoded whole.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.llm._store import read_table, ship

VOCABULARY = "byte_bpe_50k.json"
BATCH_BYTES = 1 << 19
PIECE_CHARS = 1 << 16
LIMIT = 512
#: A space between two visible characters always begins a new pre-token, and no special token holds one. The mark U+2581,
#: which stands for a space in some vocabularies, is not visible in this sense.
_SAFE = re.compile(r"(?<=[^\s\u2581]) (?=[^\s\u2581])")


def vocabulary_path(name: str) -> str:
    if os.path.isabs(name):
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


@lru_cache(maxsize=4)
def _encoder(name: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    path = vocabulary_path(name)
    if path.endswith(".model"):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        return lambda texts: [len(x) for x in sp.encode(texts, num_threads=1)], "drop" if marks_begin_pieces(sp) else None
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    return lambda texts: [len(x) for x in t.encode_batch_fast(texts, add_special_tokens=False)], "keep" if spaces_begin_tokens(t) else None


def marks_begin_pieces(sp) -> bool:
    """Whether no piece has the mark of a space behind another character, so that no token reaches over a space."""
    return not any("\u2581" in sp.id_to_piece(i).lstrip("\u2581") for i in range(sp.get_piece_size()))


def spaces_begin_tokens(t) -> bool:
    """Whether the tokenizer leaves texts as they are and splits them by the byte-level pattern, in which a space before a
    visible character begins a pre-token, and whether no special string has white space at its ends or within."""
    made = json.loads(t.to_str())
    split = made.get("pre_tokenizer") or {}
    plain = split.get("type") == "ByteLevel" and split.get("use_regex", True) and not split.get("add_prefix_space")
    special = [x for x in made.get("added_tokens", []) if x.get("lstrip") or x.get("rstrip") or re.search(r"\s", x["content"])]
    return plain and not made.get("normalizer") and not special


def safe_pieces(text: str, most: int = PIECE_CHARS, space: str = "keep") -> Iterator[str]:
    """Parts of about ``most`` characters whose token counts add up to the text's. The space at a cut begins the next part, or
    with ``space="drop"`` is left out, for vocabularies that put a mark before each text themselves."""
    at = 0
    while len(text) - at > most:
        m = _SAFE.search(text, at + most)
        if m is None:
            break
        yield text[at : m.start()]
        at = m.start() if space == "keep" else m.end()
    yield text[at:]


def count_tokens(texts: pa.Array, vocabulary: str = VOCABULARY, batch_bytes: int = BATCH_BYTES) -> list[int]:
    encode, space = _encoder(vocabulary)
    counts = [0] * len(texts)
    batch: list[str] = []
    owner: list[int] = []
    held = 0

    def flush() -> None:
        for i, n in zip(owner, encode(batch), strict=True):
            counts[i] += n
        batch.clear()
        owner.clear()

    for i, value in enumerate(texts):
        text = value.as_py()
        if not text:
            continue
        size = value.as_buffer().size
        for piece in safe_pieces(text, space=space) if space else (text,):
            batch.append(piece)
            owner.append(i)
            held += size if len(piece) == len(text) else len(piece.encode())
            if held >= batch_bytes:
                flush()
                held = 0
    if batch:
        flush()
    return counts


def token_count(text: Column, vocabulary: str = VOCABULARY) -> Column:
    """Number of tokens of a text column under a public vocabulary file, without added special tokens."""

    @F.arrow_udf("long")
    def lengths(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            yield pa.array(count_tokens(texts, vocabulary), pa.int64())

    return lengths(text)


def with_token_counts(docs: DataFrame, text_col: str = "text", out_col: str = "n_tokens", vocabulary: str = VOCABULARY) -> DataFrame:
    """``docs`` with a column of token counts; a column that has its name already is replaced."""
    ship(docs.sparkSession)
    return docs.withColumn(out_col, token_count(F.col(text_col), vocabulary))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    counted = with_token_counts(docs)
    return counted.select(
        "doc_id",
        F.octet_length("text").cast("long").alias("n_bytes"),
        "n_tokens",
        (F.col("n_tokens") > LIMIT).alias("over_limit"),
    )
