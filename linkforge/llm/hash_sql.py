"""XXH64 in DuckDB's SQL, for the queries whose results are hashes: unsigned 128-bit arithmetic modulo 2^64 over lists of bytes."""

from __future__ import annotations

#: Fixed: the published primes of XXH64.
P1, P2, P3, P4, P5 = 11400714785074694791, 14029467366897019727, 1609587929392839161, 9650029242287828579, 2870177450012600261
M = 1 << 64


def u(x: int) -> str:
    return f"{x}::uhugeint"


def mul(a: str, b: str) -> str:
    return f"(({a}) * ({b}) % {u(M)})"


def add(a: str, b: str) -> str:
    return f"((({a}) + ({b})) % {u(M)})"


def rotl(x: str, r: int) -> str:
    """x, a column, turned left by r bits."""
    return f"(({x}) * {u(1 << r)} % {u(M)} + ({x}) // {u(1 << (64 - r))})"


def shifted(x: str, r: int) -> str:
    """x ^ (x >> r)."""
    return f"xor({x}, ({x}) // {u(1 << r)})"


def _word(begin: str, length: int) -> str:
    """The little-endian number of so many bytes from the 0-based place in the list p of bytes in hexadecimal."""
    return f"('0x' || array_to_string(list_reverse(p[{begin} + 1:{begin} + {length}]), ''))::ubigint::uhugeint"


def xxh64_ctes(name: str, source: str, key: str, text: str, seed: str = "0") -> str:
    """CTEs that end in name(key, h): the hash, as uhugeint, of each distinct (key, text, seed) of a source."""
    lanes = "abcd"
    turn = f"{{{', '.join(f'''{q}: {mul(rotl('x', 31).replace('x', f'({add(f's.{q}', mul(f'e.{q}', u(P2)))})'), u(P1))}''' for q in lanes)}}}"
    first = f"{{'a': {add('seed', u((P1 + P2) % M))}, 'b': {add('seed', u(P2))}, 'c': seed, 'd': {add('seed', u(M - P1))}}}"
    stripe = f"{{{', '.join(f'''{q}: {_word(f'32 * i + {8 * k}', 8)}''' for k, q in enumerate(lanes))}}}"
    mixed = f"{add(add(rotl('v.a', 1), rotl('v.b', 7)), add(rotl('v.c', 12), rotl('v.d', 18)))}"
    round_ = lambda w: mul(rotl("x", 31).replace("x", mul(w, u(P2))), u(P1))
    merged = "h0"
    for q in lanes:
        merged = add(mul(f"xor({merged}, {round_(f'v.{q}')})", u(P1)), u(P4))
    eight = add(mul(rotl("x", 27).replace("x", f"xor(s.h, {round_('e.w')})"), u(P1)), u(P4))
    four = add(mul(rotl("x", 23).replace("x", f"xor(s.h, {mul('e.w', u(P1))})"), u(P2)), u(P3))
    one = mul(rotl("x", 11).replace("x", f"xor(s.h, {mul('e.w', u(P5))})"), u(P1))
    return f"""{name}_x AS (SELECT DISTINCT {key} AS key, ({seed})::uhugeint AS seed, CASE WHEN {text} = '' THEN [] ELSE string_split(hex(encode({text})), '') END AS x FROM {source}),
{name}_p AS (SELECT key, seed, list_transform(range(0, len(x) // 2), lambda i: x[2 * i + 1] || x[2 * i + 2]) AS p FROM {name}_x),
{name}_v AS (SELECT key, seed, p, len(p) AS n, CASE WHEN len(p) >= 32 THEN list_reduce(list_prepend({first}, list_transform(range(0, len(p) // 32), lambda i: {stripe})), lambda s, e: {turn}) END AS v FROM {name}_p),
{name}_m AS (SELECT key, seed, p, n, v, {mixed} AS h0 FROM {name}_v),
{name}_h AS (SELECT key, p, n, {add(f"CASE WHEN n >= 32 THEN {merged} ELSE {add('seed', u(P5))} END", 'n::uhugeint')} AS h, n // 32 * 32 AS done FROM {name}_m),
{name}_t AS (SELECT key, list_reduce(list_concat([{{'h': h, 'k': 0, 'w': 0::uhugeint}}], list_transform(range(0, (n - done) // 8), lambda i: {{'h': 0::uhugeint, 'k': 8, 'w': {_word('done + 8 * i', 8)}}}),
  CASE WHEN n % 8 >= 4 THEN [{{'h': 0::uhugeint, 'k': 4, 'w': {_word('(n // 8 * 8)', 4)}}}] ELSE [] END, list_transform(range(n // 4 * 4, n), lambda i: {{'h': 0::uhugeint, 'k': 1, 'w': {_word('i', 1)}}})),
  lambda s, e: {{'h': CASE e.k WHEN 8 THEN {eight} WHEN 4 THEN {four} ELSE {one} END, 'k': 0, 'w': 0::uhugeint}}).h AS h FROM {name}_h),
{name}_a AS (SELECT key, {mul(shifted('h', 33), u(P2))} AS h FROM {name}_t), {name}_b AS (SELECT key, {mul(shifted('h', 29), u(P3))} AS h FROM {name}_a),
{name} AS (SELECT key, {shifted('h', 32)} AS h FROM {name}_b)"""
