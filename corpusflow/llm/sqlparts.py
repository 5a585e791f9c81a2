"""Pieces of the oracle SQL."""

from __future__ import annotations


def crc32_sql(text: str) -> str:
    """CRC-32 of a text's UTF-8 bytes, unsigned, bit by bit."""
    bits = "list_reduce([xor(c, x), 0, 0, 0, 0, 0, 0, 0, 0], lambda v, z: xor(v >> 1, 3988292384 * (v & 1)))"
    octets = f"list_transform(range(octet_length(encode({text}))::BIGINT), lambda i: ('0x' || substr(hex(encode({text})), (2 * i + 1)::BIGINT, 2))::BIGINT)"
    return f"xor(list_reduce(list_concat([4294967295], {octets}), lambda c, x: {bits}), 4294967295)"
