"""Exact token counts by a map-side lookup in two tiers, without shuffling pre-tokens.

Byte-level BPE splits a text into pre-tokens by a fixed pattern and merges inside each pre-token
only, so a text's count is the sum over its pre-tokens.  Tier one is a broadcast table of the most
frequent pre-tokens of the corpus and their lengths in tokens, of a fixed number of entries.  Tier
two is a cache in each worker: a miss is encoded once by the library and kept.  The corpus
statistics behind tier one come from one cheap pass over all rows: blank-separated words are
counted in each task, the heaviest of a task are summed, and only the winners are cut by the
pattern.  The table decides speed only, never a count.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Stages, keyed_text, map_batches

#: entries of the broadcast table, each of at most LONGEST characters: under 8 MB
ENTRIES = 1 << 16
LONGEST = 32
#: words a task reports, and words it holds before it forgets rare ones
REPORTED, HELD = 1 << 15, 1 << 19
#: entries of a worker's cache
CACHED = 1 << 18

_workers: dict = {}


class _Lengths(dict):
    """Pre-token to its number of tokens; missing ones are encoded and kept."""

    def __init__(self, tokenizer, table: dict[str, int]):
        super().__init__(table)
        self.tokenizer, self.fixed = tokenizer, table

    def __missing__(self, piece: str) -> int:
        n = len(self.tokenizer.encode(piece, add_special_tokens=False).ids)
        if len(piece) <= 4 * LONGEST:
            if len(self) > len(self.fixed) + CACHED:
                self.clear()
                self.update(self.fixed)
            self[piece] = n
        return n


class Counting:
    """Counts tokens of texts with one vocabulary file; built once in a worker."""

    def __init__(self, path: str, table: dict[str, int]):
        import regex
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.lengths = _Lengths(self.tokenizer, table)
        self.pieces = regex.compile(pattern()).findall
        special = sorted((t.content for t in self.tokenizer.get_added_tokens_decoder().values()), key=len, reverse=True)
        self.special = regex.compile("|".join(map(regex.escape, special))) if special else None
        self.marks = special

    def count(self, text: str) -> int:
        """Tokens of one text; each special string in it is one token, as the library has it by default."""
        get = self.lengths.__getitem__
        if self.special is None or not any(m in text for m in self.marks):
            return sum(map(get, self.pieces(text)))
        parts = self.special.split(text)
        return len(parts) - 1 + sum(sum(map(get, self.pieces(part))) for part in parts)


def pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


def vocabulary(name: str) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def _worker(name: str, shared) -> Counting:
    key = (name, shared.id if hasattr(shared, "id") else id(shared))
    if key not in _workers:
        _workers.clear()
        _workers[key] = Counting(vocabulary(name), shared.value)
    return _workers[key]


def _frequent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    words: Counter = Counter()
    for batch in batches:
        for text in batch.column(0).to_pylist():
            if text:
                words.update(text.split(" "))
                if len(words) > HELD:
                    words = Counter(dict(words.most_common(HELD // 2)))
    top = [(w, n) for w, n in words.most_common(REPORTED) if 0 < len(w) <= LONGEST]
    yield pa.RecordBatch.from_arrays([pa.array([w for w, _ in top], pa.string()), pa.array([n for _, n in top], pa.int64())], ["word", "n"])


def frequent_lengths(docs: DataFrame, name: str, entries: int = ENTRIES) -> dict[str, int]:
    """The broadcast table: frequent pre-tokens of the whole table to their lengths in tokens."""
    counted = docs.select("text").mapInArrow(_frequent, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    stages = Stages(docs.sparkSession, "token-counts")
    counted = stages.write(counted.withColumn("grade", F.floor(4 * F.log2("n")).cast("int")), "words")
    # Whole grades of frequency, from the top, while they fit: no task has to merge all candidates.
    least, room = 0, entries
    for grade, size in sorted(((r["grade"], r["count"]) for r in counted.groupBy("grade").count().collect()), reverse=True):
        room -= size
        if room < 0:
            least = grade + 1
            break
    top = counted.where(F.col("grade") >= least).toArrow()
    stages.drop("words")
    tool = Counting(vocabulary(name), {})
    weight: Counter = Counter()
    for word, n in zip(top["word"].to_pylist(), top["n"].to_pylist()):
        for piece in tool.pieces(" " + word):
            weight[piece] += n
    return {piece: tool.lengths[piece] for piece, _ in weight.most_common(entries) if len(piece) <= LONGEST + 1}


def count_tokens(docs: DataFrame, name: str = "byte_bpe_50k.json", limit: int = 1024, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_bytes, n_tokens, over_limit (n_tokens > limit).

    Null texts count as empty: no bytes, no tokens.  Repeated rows are counted each; other columns
    are not read; an empty table gives an empty result.
    """
    docs = keyed_text(docs, id_col, text_col)
    shared = docs.sparkSession.sparkContext.broadcast(frequent_lengths(docs, name))

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        count = _worker(name, shared).count
        n = pa.array([count(text) if text else 0 for text in batch.column(1).to_pylist()], pa.int64())
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), n], ["doc_id", "n_bytes", "n_tokens"])

    sized = docs.withColumn("n_bytes", F.coalesce(F.octet_length("text").cast("long"), F.lit(0).cast("long")))
    counted = map_batches(sized, run, f"doc_id {dict(docs.dtypes)['doc_id']}, n_bytes long, n_tokens long")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
