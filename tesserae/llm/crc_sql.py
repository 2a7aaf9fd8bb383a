"""CRC-32 in DuckDB's SQL, for the queries held against SQL."""

#: Fixed value: the reversed polynomial of CRC-32.
POLYNOMIAL = 0xEDB88320

#: One row, one list: what each byte makes of an empty remainder.
TABLE = f"crc AS MATERIALIZED (SELECT list(list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, x: CASE WHEN c % 2 = 1 THEN xor(c // 2, {POLYNOMIAL}) ELSE c // 2 END) ORDER BY i) AS t FROM range(256) AS r(i))"


def crc32(text: str) -> str:
    """The unsigned CRC-32 of a text's UTF-8 bytes, by the list ``t`` of TABLE."""
    byte = f"list_transform(range(0, strlen({text})), lambda k: ('0x' || substr(hex(encode({text})), (2 * k + 1)::INT, 2))::BIGINT)"
    return f"xor(list_reduce(list_prepend(4294967295, {byte}), lambda c, b: xor(c // 256, t[xor(c % 256, b) + 1])), 4294967295)"
