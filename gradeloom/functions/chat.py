"""Chat rows as one text, where each message lies in it, and labels for the assistant's tokens alone.

Tokens are given by their lengths in UTF-8 bytes, as byte-level tokenisers have them: a token may begin or end within a character. Its span in characters begins with the character
its first byte is of and ends behind the one its last byte is of.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Marks of a message's start and end, and the label of tokens that aren't learned.
START, END, IGNORED = "<|im_start|>", "<|im_end|>", -100


def _turn(m: Column) -> Column:
    return F.concat(F.lit(START), F.coalesce(m["role"], F.lit("")), F.lit("\n"), F.coalesce(m["content"], F.lit("")), F.lit(f"{END}\n"))


def rendered(messages: Column, ask: bool = False) -> Column:
    """Messages (role, content) as one text; ``ask``: with the start of an answer behind them. Null roles and contents are empty."""
    text = F.array_join(F.transform(messages, _turn), "")
    return F.concat(text, F.lit(f"{START}assistant\n")) if ask else text


def spans(messages: Column) -> Column:
    """Role, and where in the rendered text the content of each message starts and ends, in characters."""

    def add(state: Column, m: Column) -> Column:
        head = state["at"] + len(START) + F.length(F.coalesce(m["role"], F.lit(""))) + 1
        tail = head + F.length(F.coalesce(m["content"], F.lit("")))
        own = F.struct(m["role"].alias("role"), head.alias("start"), tail.alias("end"))
        return F.struct((tail + len(END) + 1).alias("at"), F.concat(state["found"], F.array(own)).alias("found"))

    none = F.array().cast("array<struct<role:string,start:int,end:int>>")
    return F.aggregate(messages, F.struct(F.lit(0).alias("at"), none.alias("found")), add)["found"]


def answer_start(messages: Column) -> Column:
    """Where the answer begins in the rendered text: the content of the last message if it is the assistant's; null if it isn't."""
    last = F.try_element_at(spans(messages), F.lit(-1))
    return F.when(last["role"] == "assistant", last["start"])


SPAN = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))


def character_spans(text: str, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First character of each token and the one behind its last, from tokens' lengths in bytes."""
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    if not len(raw) and not len(lengths):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    ends = np.cumsum(lengths)
    if (len(ends) and ends[-1] != len(raw)) or (np.asarray(lengths) < 1).any():
        raise ValueError(f"tokens of {int(ends[-1]) if len(ends) else 0} bytes for a text of {len(raw)}")
    character = np.cumsum((raw & 0xC0) != 0x80) - 1
    return character[ends - lengths], character[ends - 1] + 1


#: Tokens whose spans leave a task at a time, or those of one text.
TOKENS = 1_000_000


def spans_of(texts: pa.Array, lengths: pa.Array) -> pa.Array:
    """``character_spans`` of texts and arrays of lengths, null ones empty, as an array of arrays; tokens stay numbers in columns and are never objects."""
    none = np.empty(0, np.int64)
    sizes, tokens = pc.fill_null(pc.list_value_length(lengths), 0).to_numpy(zero_copy_only=False), [n.values for n in lengths]
    found = [character_spans(t.as_py() or "", none if n is None else n.to_numpy(zero_copy_only=False).astype(np.int64)) for t, n in zip(texts, tokens, strict=True)]
    edges = (pa.array(np.concatenate([none, *(f[side] for f in found)]).astype(np.int32)) for side in (0, 1))
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), pa.StructArray.from_arrays(list(edges), ["start", "end"]))


@F.arrow_udf(SPAN)
def token_spans(parts: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    """Column function: ``character_spans`` of texts and arrays of lengths; null texts and arrays are empty. Spans leave by ``TOKENS`` at most, however many a batch of rows has."""
    for text, lengths in parts:
        block = np.cumsum(pc.fill_null(pc.list_value_length(lengths), 0).to_numpy(zero_copy_only=False)) // TOKENS
        cuts = [0, *(np.flatnonzero(np.diff(block)) + 1).tolist(), len(text)]
        for a, z in zip(cuts, cuts[1:], strict=False):
            yield spans_of(text.slice(a, z - a), lengths.slice(a, z - a))


def labels(ids: Column, token_spans_: Column, start: Column, most: int | None = None) -> Column:
    """Ids of tokens that begin at ``start`` or behind it, ``IGNORED`` for those before; all ignored if start is null. ``most``: tokens that are kept."""
    marked = F.zip_with(ids, token_spans_, lambda i, s: F.when(s["start"] >= start, i).otherwise(IGNORED))
    return marked if most is None else F.slice(marked, 1, most)


def learned(labels_: Column) -> Column:
    """How many tokens a row teaches; rows with none are no use for training."""
    return F.size(F.filter(labels_, lambda x: x != IGNORED))
