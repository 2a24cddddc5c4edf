"""Packing as a table function for SQL.

    udtf.register(spark)
    select * from pack_sentences(table(encoded) partition by domain order by (doc_id), 256, 0, array(33, 46), array(10))
"""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

from millrace.operators.corpus import pack_stream


class PackSentences:
    """domain, seq, tokens, padding: sentence-bounded chunks of the rows (domain, tokens, spaced) of a partition, in their
    order; arguments: chunk length, end-of-document id, ids that end a sentence, ids with a line feed, whether to keep the
    tail. What has not filled a chunk is carried from row to row, less than a chunk, so a partition of any size is read
    through, in one task: corpus.pack_sentences() cuts large domains into streams."""

    @staticmethod
    def analyze(rows: AnalyzeArgument, length: AnalyzeArgument, eos: AnalyzeArgument, ends: AnalyzeArgument, newlines: AnalyzeArgument, flush_tail: AnalyzeArgument | None = None) -> AnalyzeResult:
        if not rows.isTable:
            raise ValueError("the first argument is a table")
        names = {f.name for f in rows.dataType.fields}
        if missing := {"domain", "tokens", "spaced"} - names:
            raise ValueError(f"the table has no column {', '.join(sorted(missing))}")
        if length.value is not None and length.value < 2:
            raise ValueError("a chunk has two tokens at least")
        return AnalyzeResult(StructType().add("domain", StringType()).add("seq", IntegerType()).add("tokens", ArrayType(IntegerType())).add("padding", IntegerType()))

    def __init__(self) -> None:
        self.held: tuple[list[int], list[bool]] = ([], [])
        self.seq, self.options, self.domain = 0, None, None

    def eval(self, rows, length: int, eos: int, ends: list[int], newlines: list[int], flush_tail: bool = False):
        if self.options is None:
            self.domain, self.options, self.flush = rows["domain"], (length, eos, set(ends), frozenset(newlines)), flush_tail
        tokens, spaced = list(rows["tokens"] or []), list(rows["spaced"] or [])
        # the carried rest opens the document, but its chunks are the document's own
        whole = (self.held[0] + tokens, self.held[1] + spaced)
        fold = pack_stream([self.held, (tokens, spaced)], *self.options)
        while True:
            try:
                chunk, padding = next(fold)
            except StopIteration as end:
                left = end.value
                break
            yield self.domain, self.seq, chunk, padding
            self.seq += 1
        at = len(whole[0]) - left
        self.held = (whole[0][at:], whole[1][at:])

    def terminate(self):
        if self.options is not None and self.flush and self.held[0]:
            yield self.domain, self.seq, self.held[0], self.options[0] - len(self.held[0])


def register(spark: SparkSession) -> None:
    """Make pack_sentences() known to the session's SQL."""
    spark.udtf.register("pack_sentences", udtf(PackSentences))
