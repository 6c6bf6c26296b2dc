"""crc32 in DuckDB's SQL, which has no such function."""

#: A query of one row, ``tab``: the table of crc32 (polynomial 0xEDB88320, reflected), from its rule.
CRC_TABLE = "select list_transform(range(256), lambda i: list_reduce(list_concat([i], range(8)), lambda c, k: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end)) tab"


def crc32_sql(points: str) -> str:
    """Of a list of code points up to 0xFF, as UTF-8; ``tab`` has to be in scope."""
    bytes_ = f"flatten(list_transform({points}, lambda c: case when c < 128 then [c::bigint] else [(192 + (c >> 6))::bigint, (128 + (c & 63))::bigint] end))"
    return f"xor(list_reduce(list_concat([4294967295::bigint], {bytes_}), lambda c, b: xor(c >> 8, tab[(xor(c, b) & 255) + 1])), 4294967295)"


def points_sql(text: str) -> str:
    """The code points of ``text``."""
    return f"list_transform(string_split({text}, ''), lambda c: unicode(c)::bigint)"
