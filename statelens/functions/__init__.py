"""Column functions: quantise, pack, unpack and order states; entropy formulas."""

from .pack import fires, pack_bigint, pack_state, register, sort_key, unpack_state

__all__ = ["fires", "pack_bigint", "pack_state", "register", "sort_key", "unpack_state"]
