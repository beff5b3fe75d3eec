"""Token counts by overlap resynchronisation.

Texts up to ``chunk_chars`` are encoded whole, many at a time. A longer one is encoded
in chunks that overlap, with offsets. Two neighbours are spliced at a boundary in their
overlap that both have and that no context can move: a single space between two
characters that are no white space. Word patterns and piece vocabularies start a token
there whatever stands before, and end one whatever follows, so tokens left of it come from the left
chunk and tokens right of it from the right one. The next tokens of both sides must
agree as well; where no boundary qualifies, the overlap is widened, up to the text's end.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import subwords
from .common import documents
from .registry import register
from .subwords import piece_model, slices, tokenizer, vocabulary_path

VOCABULARY = "byte_bpe_50k.json"
LIMIT = 512
CHUNK_CHARS = 32_768
OVERLAP_CHARS = 512
#: Tokens behind a boundary that both chunks must have alike, as far as both reach.
AGREE = 4
#: Characters encoded in one call of the library.
BATCH_CHARS = 1 << 20

#: Encodes a text to its tokens' starts (in characters) and ids.
Encode = Callable[[str], tuple[list[int], list[int]]]


def stable(text: str, at: int) -> bool:
    """A single space between two characters that are no white space."""
    return 0 < at < len(text) - 1 and text[at] == " " and not text[at - 1].isspace() and not text[at + 1].isspace()


def splice(text: str, begin: int, left: tuple, right_begin: int, right: tuple) -> tuple[int, int] | None:
    """Places (in tokens of the left and right chunk) of the first common stable boundary, or None."""
    starts = {s + right_begin: i for i, s in enumerate(right[0])}
    for i, s in enumerate(left[0]):
        at = s + begin
        if at <= right_begin or not stable(text, at) or (j := starts.get(at)) is None:
            continue
        if left[1][i : i + AGREE] == right[1][j : j + AGREE]:
            return i, j
    return None


def count_spliced(text: str, encode: Encode, chunk: int = CHUNK_CHARS, overlap: int = OVERLAP_CHARS) -> int:
    """Tokens of a text, encoded chunk by chunk."""
    begin, done, total = 0, 0, 0
    current = encode(text[: chunk + overlap])
    end = chunk + overlap
    while end < len(text):
        wide = overlap
        while True:
            right_begin = end - wide
            right_end = min(len(text), max(end, right_begin + chunk + overlap))
            right = encode(text[right_begin:right_end])
            # the last tokens before a chunk's end may change with what follows
            held = [k for k, s in enumerate(current[0]) if s + begin < end]
            found = splice(text, begin, (current[0][done : len(held)], current[1][done : len(held)]), right_begin, right)
            if found:
                total += found[0]
                begin, done, current, end = right_begin, found[1], right, right_end
                break
            if end == len(text):
                break
            if wide * 2 < end - begin:
                wide *= 2
            else:
                end = min(len(text), end + max(chunk, end - begin))
                current = encode(text[begin:end])
                wide = overlap
                if end == len(text):
                    break
    return total + len(current[1]) - done


def text_encoder(path: str) -> tuple[Encode, Callable[[list[str]], list[int]]]:
    """For a vocabulary file: encoding with offsets, and token counts of a list of texts."""
    if path.endswith(".model"):
        model = piece_model(path)

        def pieces(text: str) -> tuple[list[int], list[int]]:
            found = model.encode(text, return_type="proto").pieces
            starts = [p.begin for p in found]  # in bytes
            if not text.isascii():
                ends = accumulate((len(c.encode()) for c in text), initial=0)
                place = {byte: i for i, byte in enumerate(ends)}
                starts = [place.get(s, -1) for s in starts]
            return starts, [p.id for p in found]

        return pieces, lambda texts: [len(x) for x in model.encode(texts, num_threads=1)]
    library = tokenizer(path)

    def tokens(text: str) -> tuple[list[int], list[int]]:
        found = library.encode(text, add_special_tokens=False)
        return [s for s, _ in found.offsets], found.ids

    whole = subwords.text_encoder(path)
    return tokens, lambda texts: [len(whole.ids(t)) for t in texts]


def count_tokens(
    docs: DataFrame, vocabulary: str | None = None, limit: int = LIMIT, chunk: int = CHUNK_CHARS, overlap: int = OVERLAP_CHARS
) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit, one row per row of ``docs``.

    Needs doc_id and text; other columns are ignored. Null and empty texts have no bytes
    and no tokens; rows that repeat are counted one by one; an empty table gives an empty
    result. ``vocabulary`` is the path of a .json or .model file; it must be one that
    starts a token at single spaces, as the public ones do.
    """
    path = vocabulary or vocabulary_path(VOCABULARY)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, count = text_encoder(path)
        for batch in batches:
            n_tokens: list[int] = []
            n_bytes: list[int] = []
            for _, _, part in slices(batch.column(1), BATCH_CHARS):
                short = iter(count([t for t in part if len(t) <= chunk]))
                n_tokens += [next(short) if len(t) <= chunk else count_spliced(t, encode, chunk, overlap) for t in part]
                n_bytes += [len(t.encode()) for t in part]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n_bytes, pa.int64()), pa.array(n_tokens, pa.int64())], ["doc_id", "n_bytes", "n_tokens"]
            )

    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    schema = T.StructType([rows.schema["doc_id"], T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType())])
    return rows.mapInArrow(run, schema).withColumn("over_limit", F.col("n_tokens") > limit)


@register("op10_token_counts")
def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(documents(spark, sf_dir))
