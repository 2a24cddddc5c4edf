"""From one vocabulary to another, row by row; sequences are truncated, never packed anew."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame


def translate(tokens: list[int], decode: Callable[[list[int]], str], encode: Callable[[str], list[int]], old_eos: int, new_eos: int, length: int, bos: int | None = None) -> list[int]:
    """The parts between old_eos, decoded and encoded anew, with new_eos between them; cut to length."""
    out: list[int] = []
    part: list[int] = []
    for t in [*tokens, old_eos]:
        if t != old_eos:
            part.append(t)
            continue
        out += [*encode(decode(part)), new_eos]
        part = []
    out.pop()
    if bos is not None:
        return [bos, *out[: length - 1]]
    out = out[:length]
    return out if len(out) > 1 else [*out, new_eos]


def retokenize(rows: DataFrame, make: Callable[[], tuple[Callable, Callable]], old_eos: int, new_eos: int, length: int, bos: int | None = None) -> DataFrame:
    """idx, tokens of rows (idx, tokens), as many as before. make() gives (decode, encode) once per task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decode, encode = make()
        for batch in batches:
            new = [translate(t, decode, encode, old_eos, new_eos, length, bos) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(new, pa.list_(pa.int32()))], ["idx", "tokens"])

    return rows.select("idx", "tokens").mapInArrow(run, "idx long, tokens array<int>")
