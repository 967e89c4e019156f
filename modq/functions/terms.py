"""Sums of term weights over the tokens of whole texts, in one Arrow pass without a shuffle."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Between a profile and a term in a key of both: no token holds white space.
BETWEEN = "\n"
#: Tokens that are looked up at once, but for one longer text.
SLICE_TOKENS = 1 << 17


def token_scores(texts: DataFrame, tokens: Column, weights: pa.Table, group: str | None = None, keep: list[str] | None = None) -> DataFrame:
    """texts' columns keep (default: all) with s: the sum of the weights of a text's tokens, each as often as it stands there. No row meets another, so texts may be a stream.

    weights: term, weight, a table that goes to every task, so its size must be bounded; with group, a column of texts, term is the
    group's name, BETWEEN and the term. Null tokens: 0.
    """
    keep = texts.columns if keep is None else keep
    rows = texts.select(*keep, *([F.coalesce(F.col(group), F.lit("")).alias("score_group")] if group else []), tokens.alias("score_tokens"))
    terms, values = weights.column("term").combine_chunks(), weights.column("weight").to_numpy().astype(np.float64)
    shared = texts.sparkSession.sparkContext.broadcast((terms, np.append(values, 0.0)))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, worth = shared.value
        for batch in batches:
            lists = batch.column("score_tokens")
            sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
            sums, upto, row = np.zeros(len(sizes)), np.cumsum(sizes, dtype=np.int64), 0
            while row < len(sizes):
                end = max(int(np.searchsorted(upto, upto[row] - sizes[row] + SLICE_TOKENS, "right")), row + 1)
                owner, flat = np.repeat(np.arange(end - row), sizes[row:end]), pc.list_flatten(lists.slice(row, end - row))
                if group:
                    flat = pc.binary_join_element_wise(batch.column("score_group").slice(row, end - row).take(pa.array(owner)).cast(flat.type), flat, pa.scalar(BETWEEN, flat.type))
                at = pc.fill_null(pc.index_in(flat, value_set=known.cast(flat.type)), len(worth) - 1).to_numpy(zero_copy_only=False)
                sums[row:end] = np.bincount(owner, worth[at], minlength=end - row)
                row = end
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in keep], pa.array(sums)], names=[*keep, "s"])

    kinds = dict(texts.dtypes)
    return rows.mapInArrow(scan, ", ".join(f"`{c}` {kinds[c]}" for c in keep) + ", s double")
