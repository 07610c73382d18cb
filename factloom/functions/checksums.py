"""Checksums in the SQL that queries are held against."""


def crc32_sql(text: str) -> str:
    """DuckDB SQL for the unsigned crc32 of a string of ASCII characters: bytes are mixed in, 256 stands for a shift by one bit."""
    steps = f"flatten(list_transform(range(1, len(({text})) + 1), lambda k: [ascii(({text})[k])::BIGINT, 256, 256, 256, 256, 256, 256, 256, 256]))"
    mixed = "lambda c, v: CASE WHEN v < 256 THEN xor(c, v) ELSE xor(c >> 1, (c & 1) * 3988292384) END"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, {steps}), {mixed}), 4294967295::BIGINT)"
