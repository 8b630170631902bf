"""BLAKE2b (RFC 7693) of short texts as DuckDB text: the oracle of the hash that SQL lacks."""

from __future__ import annotations

from math import isqrt

_M = "18446744073709551615::UHUGEINT"
#: Initial values: the first 64 fractional bits of the square roots of the first eight primes.
_IV = [isqrt(p << 128) & (1 << 64) - 1 for p in (2, 3, 5, 7, 11, 13, 17, 19)]
#: The word order of each round.
_SIGMA = (
    (0, 1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15),
    (14, 10, 4, 8, 9, 15, 13, 6, 1, 12, 0, 2, 11, 7, 5, 3),
    (11, 8, 12, 0, 5, 2, 15, 13, 10, 14, 3, 6, 7, 1, 9, 4),
    (7, 9, 3, 1, 13, 12, 11, 14, 2, 6, 5, 10, 4, 0, 15, 8),
    (9, 0, 5, 7, 2, 4, 10, 15, 14, 1, 11, 12, 6, 8, 3, 13),
    (2, 12, 6, 10, 0, 11, 8, 3, 4, 13, 7, 5, 15, 14, 1, 9),
    (12, 5, 1, 15, 14, 13, 4, 10, 0, 7, 6, 3, 9, 2, 8, 11),
    (13, 11, 7, 14, 12, 1, 3, 9, 5, 0, 15, 4, 8, 6, 2, 10),
    (6, 15, 14, 9, 11, 3, 0, 8, 12, 2, 13, 7, 1, 4, 10, 5),
    (10, 2, 8, 4, 7, 6, 1, 5, 15, 11, 9, 14, 3, 12, 13, 0),
)
_WORDS = 10  # of eight bytes: texts of up to 80


def blake2b_sql(rows: str, size: int = 8) -> str:
    """CTEs ending in ``blake`` (id, h): the first eight of ``size`` digest bytes, as a big-endian number, of the ASCII
    texts ``s`` of ``rows`` (id, s). A step of all four mixing columns or diagonals is one CTE."""
    v = [f"v{i}" for i in range(16)]
    m = [f"m{i}" for i in range(_WORDS)]
    start = [f"{x}::UHUGEINT" for x in [_IV[0] ^ 0x01010000 ^ size, *_IV[1:], *_IV[:4]]]
    start += [f"xor({_IV[4]}::UHUGEINT, length(s)::UHUGEINT)", f"{_IV[5]}::UHUGEINT", f"{_IV[6] ^ (1 << 64) - 1}::UHUGEINT", f"{_IV[7]}::UHUGEINT"]
    words = [" + ".join(f"ascii(substr(s, {8 * i + j + 1}, 1))::UHUGEINT * {1 << 8 * j}::UHUGEINT" for j in range(8)) for i in range(_WORDS)]
    ctes = [f"b0 AS (SELECT id, {', '.join(f'{e} AS {n}' for e, n in zip([*start, *words], [*v, *m]))} FROM ({rows}))"]

    def turn(x: str, n: int) -> str:
        return f"((({x}) >> {n}) | (({x}) << {64 - n})) & {_M}"

    def step(changes: dict[int, str]) -> None:
        columns = [f"{changes[i]} AS {n}" if i in changes else n for i, n in enumerate(v)]
        ctes.append(f"b{len(ctes)} AS MATERIALIZED (SELECT id, {', '.join([*columns, *m])} FROM b{len(ctes) - 1})")

    for r in range(12):
        order = [f"m{i}" if i < _WORDS else "0::UHUGEINT" for i in _SIGMA[r % 10]]
        for half, cells in enumerate(([(i, i + 4, i + 8, i + 12) for i in range(4)],
                                      [(i, 4 + (i + 1) % 4, 8 + (i + 2) % 4, 12 + (i + 3) % 4) for i in range(4)])):
            for k, (first, second) in enumerate(((32, 24), (16, 63))):
                step({a: f"(v{a} + v{b} + {order[8 * half + 2 * i + k]}) & {_M}" for i, (a, b, _, _) in enumerate(cells)})
                step({d: turn(f"xor(v{d}, v{a})", first) for a, _, _, d in cells})
                step({c: f"(v{c} + v{d}) & {_M}" for _, _, c, d in cells})
                step({b: turn(f"xor(v{b}, v{c})", second) for _, b, c, _ in cells})
    h = f"xor(xor({_IV[0] ^ 0x01010000 ^ size}::UHUGEINT, v0), v8)"
    swapped = " + ".join(f"((h >> {8 * j}) & 255::UHUGEINT) * {1 << 8 * (7 - j)}::UHUGEINT" for j in range(8))
    ctes.append(f"blake AS (SELECT id, {swapped} AS h FROM (SELECT id, {h} AS h FROM b{len(ctes) - 1}))")
    return ",\n".join(ctes)
