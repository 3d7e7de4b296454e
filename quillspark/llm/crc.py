"""CRC-32 in DuckDB SQL, which has no function for it."""

#: A common table expression, one row: the 256 remainders of CRC-32, by its rule.
CRC_TABLE = """crc_table AS (
  SELECT list_transform(range(256), lambda k: list_reduce(range(8),
           lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k)) AS remainders
)"""


def crc32_sql(ascii_text: str) -> str:
    """The CRC-32 of an expression of ASCII text, in a query over crc_table."""
    codes = f"list_transform(string_split({ascii_text}, ''), lambda c: CAST(ascii(c) AS BIGINT))"
    step = "lambda c, b: xor(c >> 8, remainders[(xor(c, b) & 255) + 1])"
    return f"xor(list_reduce({codes}, {step}, CAST(4294967295 AS BIGINT)), 4294967295)"
