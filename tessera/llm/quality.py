"""Quality rules as a bitmask ledger.

Every rule is evaluated once per document. The ledger keeps one bit per failed rule beside the
measurements, so a policy is only a mask over bits: applying another version, or asking what a
policy would do without one of its rules, needs no second look at any text.

Defined results: null and empty texts have no words and fail `few_words`; null ids pass through;
repeated rows are judged one by one; very long texts are measured whole, in a slice of their own; other
columns aren't read; an empty table gives an empty ledger.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm import kernels as K
from tessera.llm.frames import arrow_rows, bounded, map_text, number_of, numbered

SYMBOLS = K.byte_class(b"#*$%&|<>")
WINDOW = 5
#: Rules by name, in the order of their bits: SQL conditions over the measurements under which a document fails.
RULES = {
    "few_words": "n_words < 10",
    "repeated_words": "100 * n_repeat_words > 20 * n_words",
    "symbols": "5 * n_symbols > n_words",
    "repeated_lines": "n_lines > 3 AND 2 * n_dup_lines > n_lines",
    "long_words": "word_chars > 20 * n_words",
    "short_words": "word_chars < 2 * n_words",
}
BIT = {name: 1 << i for i, name in enumerate(RULES)}
#: Versioned policies: the rules that reject.
POLICIES = {
    "base": ("few_words", "repeated_words"),
    "v1": ("few_words", "repeated_words", "symbols", "repeated_lines", "long_words", "short_words"),
}
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines")


def measure(part: pa.RecordBatch) -> pa.RecordBatch:
    buf, offsets = K.text_of(part.column("text"))
    n_docs = part.num_rows
    words = K.Words(buf, offsets)
    doc = np.repeat(np.arange(n_docs), words.counts())
    in_text = np.zeros(len(buf) + 1, np.int64)
    np.cumsum(~K.SPACES[buf] & ((buf & 0xC0) != 0x80), out=in_text[1:])
    symbols = np.zeros(len(buf) + 1, np.int64)
    np.cumsum(SYMBOLS[buf], out=symbols[1:])
    # lines: between line feeds and the ends of documents
    feeds = np.flatnonzero(buf == 10)
    line_start = np.sort(np.concatenate([offsets[:-1], feeds + 1]))
    line_end = np.sort(np.concatenate([offsets[1:], feeds]))
    line_doc = np.searchsorted(feeds, offsets)  # feeds before each document
    line_first = line_doc + np.arange(n_docs + 1)  # and one more line for each document before
    line_of = np.repeat(np.arange(n_docs), np.diff(line_first))
    full = np.searchsorted(words.starts, line_end) > np.searchsorted(words.starts, line_start)
    keys = K.span_hash(buf, line_start, line_end, 1) + K.mix(line_of.astype(np.uint64) + np.uint64(1))
    later = np.zeros(len(keys), bool)
    at = np.flatnonzero(full)
    later[at] = K.again(keys[at])[1]
    # windows of five words that the document holds twice
    starts = np.flatnonzero(words.room() >= WINDOW)
    windows = K.rolling(words.hashes(), WINDOW)[starts] + K.mix(doc[starts].astype(np.uint64) + np.uint64(1))
    repeated = K.covered(len(words), starts[K.again(windows)[0]], WINDOW)
    return arrow_rows(
        ["doc_id", *MEASURES],
        [
            part.column("doc_id"), words.counts(), np.diff(in_text[offsets]), np.diff(symbols[offsets]),
            K.per_doc(later, line_first), K.per_doc(repeated, words.first), K.per_doc(full, line_first),
        ],
        [pa.int64()] * 7,
    )


def failed_bits() -> Column:
    return reduce(lambda a, b: a.bitwiseOR(b), (F.when(F.expr(rule), BIT[name]).otherwise(0).cast("long") for name, rule in RULES.items()))


def ledger(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, the measurements, and `failed`: the bits of the rules that the document fails."""
    rows = map_text(docs, id_col, text_col, measure, ", ".join(f"{c} long" for c in ("doc_id", *MEASURES)))
    return rows.withColumn("failed", failed_bits())


def mask(policy: str | tuple[str, ...]) -> int:
    return sum(BIT[r] for r in (POLICIES[policy] if isinstance(policy, str) else policy))


def passes(policy: str | tuple[str, ...], bits: str = "failed") -> Column:
    return F.col(bits).bitwiseAND(F.lit(mask(policy)).cast("long")) == 0


def ablation(rows: DataFrame, policy: str) -> DataFrame:
    """For each rule of a policy: how many documents fail it, and how many the policy would keep without it.

    The ledger is reduced to one count per distinct bitmask first (at most 2 ** rules groups), so
    neither the number of policies nor that of rules multiplies the work over documents.
    """
    by_bits = rows.groupBy("failed").agg(F.count("*").alias("n"))
    m = mask(policy)
    hit = F.col("failed").bitwiseAND(F.lit(m).cast("long"))
    columns = [
        F.struct(
            F.lit(r).alias("rule"),
            F.sum(F.when(hit.bitwiseAND(F.lit(BIT[r]).cast("long")) != 0, F.col("n")).otherwise(0)).alias("n_failed"),
            F.sum(F.when(hit == BIT[r], F.col("n")).otherwise(0)).alias("n_only"),
            F.sum(F.when(hit.bitwiseAND(F.lit(m & ~BIT[r]).cast("long")) == 0, F.col("n")).otherwise(0)).alias("n_kept_without"),
        ) for r in POLICIES[policy]
    ]
    return by_bits.agg(F.array(*columns).alias("r")).select(F.inline("r"))


def passing(docs: DataFrame, policy: str = "v1", text_col: str = "text") -> DataFrame:
    """The rows of docs, with all their columns, that a policy passes; judged in the scan, without a join.

    Columns may have any names. Null texts count as empty; an empty table stays empty.
    """
    bounded(docs.sparkSession)
    rows, text = numbered(docs), number_of(docs, text_col)
    names, schema = rows.columns, T.StructType([*rows.schema.fields, *(T.StructField(m, T.LongType()) for m in MEASURES)])

    def run(batches):
        for batch in batches:
            for part in K.slices(batch, text):
                found = measure(pa.RecordBatch.from_arrays([pa.nulls(part.num_rows, pa.int64()), part.column(text)], names=["doc_id", "text"]))
                yield pa.RecordBatch.from_arrays([*part.columns, *found.columns[1:]], names=[*names, *MEASURES])

    failed = reduce(lambda a, b: a | b, (F.expr(RULES[r]) for r in POLICIES[policy]))
    return rows.mapInArrow(run, schema).where(~failed).select(*names).toDF(*docs.columns)


def digest(docs: DataFrame) -> DataFrame:
    rows = ledger(docs)
    return rows.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", (~passes("base")).alias("base_failed"),
        passes("v1").alias("kept"), "failed",
    )
