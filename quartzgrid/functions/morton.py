"""Z-order (Morton) codes and bit formats as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

U32 = 0xFFFFFFFF
#: Shift and mask of each spreading step (fixed values of the published bit trick).
SPREAD = ((8, 0x00FF00FF), (4, 0x0F0F0F0F), (2, 0x33333333), (1, 0x55555555))


def cell(coordinate: Column, integer: bool = False) -> Column:
    """A coordinate as an unsigned 32-bit cell number: truncated toward zero, negatives modulo 2^32.

    Floating coordinates out of the 32-bit range, NaN and infinities give null.
    """
    whole = coordinate if integer else coordinate.try_cast("int")
    return whole.cast("long").bitwiseAND(F.lit(U32))


def spread_steps(value: Column, masked: bool = False) -> list[Column]:
    """The value and what it is after each spreading step. No 16-bit mask comes first: byte 2 of a value beyond
    65535 folds into byte 1 and byte 3 is lost, as the codes are defined. ``masked``: it is a cell number already."""
    steps = [value if masked else value.cast("long").bitwiseAND(F.lit(U32))]
    for shift, mask in SPREAD:
        steps.append(steps[-1].bitwiseOR(F.shiftleft(steps[-1], shift)).bitwiseAND(F.lit(mask)))
    return steps


def morton(x: Column, y: Column) -> Column:
    """Interleave two cell numbers: x in the even bits, y in the odd bits, as a long of 0 to 2^32 - 1."""
    return spread_steps(x, True)[-1].bitwiseOR(F.shiftleft(spread_steps(y, True)[-1], 1))


def check_bits(k: int) -> int:
    if not 0 <= k <= 30:
        raise ValueError(f"k must be 0 to 30, not {k}")
    return k


def bin_id(code: Column, k: int) -> Column:
    """The low k bits of a code: a strided lattice of 2^k bins, not a tile."""
    return code.bitwiseAND(F.lit((1 << check_bits(k)) - 1))


def binary32(value: Column) -> Column:
    """32 binary digits of an unsigned value."""
    return F.lpad(F.bin(value), 32, "0")
