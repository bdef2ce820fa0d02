"""DuckDB pieces used by several oracles."""

#: crc32 (the reflected polynomial 0xEDB88320) of a text's UTF-8 bytes, from its rule.
CRC = """
crc_table AS MATERIALIZED (
  SELECT list(v ORDER BY i) AS t FROM (
    SELECT i, list_reduce(list_prepend(i, range(8)),
      lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS v
    FROM (SELECT unnest(range(256)) AS i)))
"""


def crc32(text: str, table: str = "t") -> str:
    """SQL for the crc32 of a text expression, which must not be null; crc_table stands in the FROM clause."""
    digits = f"list_transform(regexp_extract_all(hex({text}), '..'), lambda x: ('0x' || x)::BIGINT)"
    step = f"lambda c, b: xor(c >> 8, {table}[1 + (xor(c, b) & 255)])"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, {digits}), {step}), 4294967295)"
