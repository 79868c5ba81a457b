"""Pieces of SQL that several oracle statements share."""

#: A table expression `crc(t)` of one row: the table of CRC-32 by bytes, made from its rule.
CRC_TABLE = """crc AS MATERIALIZED (SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)),
  lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t)"""


def crc32(text: str) -> str:
    """CRC-32 of a text's UTF-8 bytes, unsigned, where the row of crc is joined."""
    at = f"list_transform(range(octet_length(encode({text}))), lambda i: CAST('0x' || substr(hex(encode({text})), 2 * i + 1, 2) AS BIGINT))"
    return f"xor(4294967295, list_reduce(list_prepend(4294967295, {at}), lambda c, b: xor(c >> 8, t[1 + (xor(c, b) & 255)])))"
