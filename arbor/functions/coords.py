"""Tree coordinates as Column expressions: a node is (height, level_index); topology is arithmetic."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def parent(h: Column, li: Column) -> tuple[Column, Column]:
    return h + 1, F.shiftright(li, 1)


def left_child(h: Column, li: Column) -> tuple[Column, Column]:
    """Null at height 0, which has no children."""
    return F.when(h > 0, h - 1), F.when(h > 0, li * 2)


def right_child(h: Column, li: Column) -> tuple[Column, Column]:
    return F.when(h > 0, h - 1), F.when(h > 0, li * 2 + 1)


def sibling(li: Column) -> Column:
    return li.bitwiseXOR(F.lit(1).cast("bigint"))


def neighbor(li: Column, offset: int) -> Column:
    """Null left of the first node."""
    return F.when(li + offset >= 0, li + offset)


def is_left(li: Column) -> Column:
    return li % 2 == 0


def ancestor_index(h: Column, li: Column, at: Column) -> Column:
    """Level index of the ancestor at a height."""
    return F.expr("1L") * F.floor(li / F.pow(F.lit(2.0), at - h)).cast("bigint")


def first_leaf(h: Column, li: Column) -> Column:
    return li * F.pow(F.lit(2.0), h).cast("bigint")


def last_leaf(h: Column, li: Column) -> Column:
    return (li + 1) * F.pow(F.lit(2.0), h).cast("bigint") - 1


def within(h: Column, li: Column, lo: Column, hi: Column) -> Column:
    return (first_leaf(h, li) >= lo) & (last_leaf(h, li) <= hi)


def bits(n: Column) -> Column:
    """Binary digits of n >= 0: floor(log2 n) + 1, exactly."""
    return F.length(F.bin(n))


def forest_size(n: Column) -> Column:
    """Nodes of a complete forest over n leaves."""
    return 2 * n - F.bit_count(n)


def max_height(n: Column) -> Column:
    return F.when(n > 0, bits(n) - 1).otherwise(0)


def node_id(doc: Column, h: Column, li: Column) -> Column:
    return F.concat_ws(":", doc.cast("string"), h.cast("string"), li.cast("string"))


def leaf_of(id_: Column) -> Column:
    """Level index of the leaf that an id names; null for higher nodes."""
    return F.when(F.split_part(id_, F.lit(":"), F.lit(-2)) == "0", F.split_part(id_, F.lit(":"), F.lit(-1)).cast("bigint"))
