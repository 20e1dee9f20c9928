"""States as packed keys.

A neuron fires where its activation is > 0; NaN, zero and null do not. Neuron i is bit i % 8
(lowest first) of byte i // 8, and the last byte's spare bits are zero. Up to 63 neurons are
one BIGINT, which whole-stage codegen builds and sorts as it is; wider states are BINARY.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, DoubleType, FloatType

#: A BIGINT key leaves its sign bit alone, so that integer order is state order.
BIGINT_NEURONS = 63


def fires(x: Column, boolean: bool = False) -> Column:
    """Whether one activation fires. Spark holds NaN > 0 to be true, so NaN is asked for by name."""
    return F.coalesce(x, F.lit(False)) if boolean else F.coalesce((x > 0) & ~F.isnan(x), F.lit(False))


def activations(df: DataFrame, name: str) -> tuple[Column, bool]:
    """The column as ARRAY<FLOAT> or ARRAY<BOOLEAN>; doubles become floats. Other types: TypeError."""
    kind = df.schema[name].dataType
    if isinstance(kind, ArrayType):
        if isinstance(kind.elementType, BooleanType):
            return F.col(name), True
        if isinstance(kind.elementType, FloatType):
            return F.col(name), False
        if isinstance(kind.elementType, DoubleType):
            return F.col(name).cast("array<float>"), False
    raise TypeError(f"{name} must be an array of float or boolean, not {kind.simpleString()}")


def pack_bigint(bits: list[Column]) -> Column:
    """Up to 63 firing flags as one BIGINT, unrolled: no interpreted function stands in the plan."""
    if not 1 <= len(bits) <= BIGINT_NEURONS:
        raise ValueError(f"a BIGINT key has 1 to {BIGINT_NEURONS} neurons, not {len(bits)}")
    return reduce(lambda a, b: a.bitwiseOR(b), [F.when(b, F.lit(1 << i).cast("bigint")).otherwise(F.lit(0).cast("bigint")) for i, b in enumerate(bits)])


def pack_array(a: Column, n: int, boolean: bool = False, start: int = 0) -> Column:
    """BIGINT key of the elements start .. start + n of an array; null where the array is."""
    return F.when(a.isNotNull(), pack_bigint([fires(F.get(a, F.lit(start + i)), boolean) for i in range(n)]))


def pack_native(a: Column, n: int, boolean: bool = False) -> Column:
    """BINARY key without a Python worker, a byte at a time."""
    bit = lambda i: F.when(fires(F.get(a, i), boolean) & (i < n), 1).otherwise(0)
    byte = lambda b: F.lpad(F.hex(reduce(lambda x, y: x.bitwiseOR(y), [F.shiftleft(bit(b * 8 + j), j) for j in range(8)])), 2, "0")
    return F.when(a.isNotNull(), F.unhex(F.array_join(F.transform(F.sequence(F.lit(0), F.lit((n + 7) // 8 - 1)), byte), "")))


def packed_array(on: np.ndarray) -> pa.Array:
    """Rows of booleans as an Arrow array of packed keys, without an object for each."""
    bits = np.packbits(on, axis=1, bitorder="little")
    ends = np.arange(len(bits) + 1, dtype=np.int32) * np.int32(bits.shape[1])
    return pa.Array.from_buffers(pa.binary(), len(bits), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(bits))])


def rows_of(a: pa.Array, n: int | None = None) -> np.ndarray:
    """An Arrow list column without null rows as a matrix of floats, over its flat values; a null value is NaN. Rows of several widths, or not n, are an error."""
    size = np.diff(a.offsets.to_numpy())
    if len(size) and (size != (size[0] if n is None else n)).any():
        raise ValueError(f"expected {size[0] if n is None else n} values, got {sorted(set(size.tolist()))}")
    return a.flatten().to_numpy(zero_copy_only=False).astype(np.float32, copy=False).reshape(len(a), int(size[0]) if len(size) else 0)


def _filled(keys: pa.Array, there: pa.Array) -> pa.Array:
    """keys at the places that are there, null at the others."""
    if len(keys) == len(there):
        return keys
    at = np.cumsum(there.to_numpy(zero_copy_only=False)) - 1
    return keys.take(pa.array(at, mask=~there.to_numpy(zero_copy_only=False)))


def pack_arrow(n: int):
    """BINARY keys in Arrow batches by numpy, over a batch's flat values: the fast way for hundreds of neurons and more."""

    @F.arrow_udf("binary")
    def pack(a: pa.Array) -> pa.Array:
        there = a.is_valid()
        return _filled(packed_array(rows_of(a.filter(there), n) > 0), there)

    return pack


def pack_tensors(n: int, positions: int, channel_axis: int):
    """An ARRAY<BINARY> of a key for each position, from flattened tensors of n channels (first or last) by positions."""

    @F.arrow_udf("array<binary>")
    def pack(a: pa.Array) -> pa.Array:
        there = a.is_valid()
        x = rows_of(a.filter(there), n * positions) > 0
        x = x.reshape(-1, n, positions).transpose(0, 2, 1) if channel_axis == 1 else x.reshape(-1, positions, n)
        keys = packed_array(x.reshape(-1, n))
        rows = pa.ListArray.from_arrays(pa.array(np.arange(x.shape[0] + 1, dtype=np.int32) * positions), keys)
        return _filled(rows, there)

    return pack


def pack_state(df: DataFrame, name: str, n: int, kind: str = "auto") -> Column:
    """The key of column `name` with n neurons. kind: bigint, binary (native), arrow, or auto, which is
    bigint up to 63 neurons and arrow beyond. A row of another width fails the job; null stays null."""
    a, boolean = activations(df, name)
    kind = ("bigint" if n <= BIGINT_NEURONS else "arrow") if kind == "auto" else kind
    if kind == "arrow":
        return pack_arrow(n)(a.cast("array<float>") if boolean else a)
    ok = F.when(a.isNotNull() & (F.size(a) != n), F.raise_error(F.concat(F.lit(f"expected {n} neurons, got "), F.size(a).cast("string")))).otherwise(F.lit(True))
    key = pack_array(a, n, boolean) if kind == "bigint" else pack_native(a, n, boolean)
    return F.when(ok.cast("boolean"), key)


def unpack_state(key: Column, n: int, binary: bool = False) -> Column:
    """ARRAY<BOOLEAN> of n neurons from a BIGINT or BINARY key."""
    if not binary:
        return F.when(key.isNotNull(), F.array(*[F.getbit(key, F.lit(i)) == 1 for i in range(n)]))
    byte = lambda i: F.conv(F.substr(F.hex(key), F.floor(i / 8).cast("int") * 2 + 1, F.lit(2)), 16, 10).cast("int")
    return F.when(key.isNotNull(), F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.get(F.transform(F.array(byte(i)), lambda b: F.pmod(F.floor(b / F.pow(F.lit(2), i % 8)), F.lit(2)) == 1), F.lit(0))))


def sort_key(key: Column, binary: bool = False) -> Column:
    """What states are ordered by: the last neuron is the most significant bit."""
    return F.array_join(F.reverse(F.regexp_extract_all(F.hex(key), F.lit(".."), F.lit(0))), "") if binary else key


def register(spark: SparkSession) -> None:
    """SQL functions pack_state(array<float>) -> binary and unpack_state(binary, n) -> array<boolean>."""

    @F.arrow_udf("binary")
    def pack(a: pa.Array) -> pa.Array:
        there = a.is_valid()
        x = a.filter(there)
        size = np.diff(x.offsets.to_numpy())
        if len(size) and (size == size[0]).all():
            return _filled(packed_array(rows_of(x) > 0), there)
        # rows of several widths: a neuron's bit has its place in its row's bytes
        wide = (size + 7) // 8
        on = np.flatnonzero(x.flatten().to_numpy(zero_copy_only=False).astype(np.float32) > 0)
        row = np.searchsorted(np.cumsum(size), on, side="right")
        bit = on - (np.cumsum(size) - size)[row] + 8 * (np.cumsum(wide) - wide)[row]
        flat = np.zeros(8 * int(wide.sum()), bool)
        flat[bit] = True
        ends = np.append(0, np.cumsum(wide)).astype(np.int32)
        return _filled(pa.Array.from_buffers(pa.binary(), len(size), [None, pa.py_buffer(ends), pa.py_buffer(np.packbits(flat, bitorder="little"))]), there)

    @F.arrow_udf("array<boolean>")
    def unpack(k: pa.Array, n: pa.Array) -> pa.Array:
        return pa.array([None if b is None or m is None else np.unpackbits(np.frombuffer(b, np.uint8), bitorder="little")[:m].astype(bool) for b, m in zip(k.to_pylist(), n.to_pylist(), strict=True)], pa.list_(pa.bool_()))

    spark.udf.register("pack_state", pack)
    spark.udf.register("unpack_state", unpack)
