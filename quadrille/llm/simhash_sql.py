"""SQL that fingerprints, links and groups documents as op2 does, with XXH64 in arithmetic of 128 bits."""

from __future__ import annotations

#: Fixed values of XXH64.
_PRIMES = (11400714785074694791, 14029467366897019727, 1609587929392839161, 9650029242287828579, 2870177450012600261)
_MASK = f"{2**64 - 1}::UHUGEINT"


def _mod(x: str) -> str:
    return f"(({x}) & {_MASK})"


def _mul(x: str, k: int) -> str:
    return _mod(f"({x}) * {_PRIMES[k - 1]}::UHUGEINT")


def _rot(x: str, r: int) -> str:
    return _mod(f"({_mod(x)} << {r}) | ({_mod(x)} >> {64 - r})")


def _read(at: str, n: int) -> str:
    """The little-endian number of n bytes of x, in hex, from place ``at``."""
    return "CAST(concat('0x', " + ", ".join(f"substr(x, 2 * ({at}) + {2 * k + 1}, 2)" for k in reversed(range(n))) + ") AS UBIGINT)::UHUGEINT"


def _fold(start: str, items: str, step: str) -> str:
    return f"list_reduce(list_prepend({start}, {items}), lambda a, b: {step})"


_V = [f"{(42 + _PRIMES[0] + _PRIMES[1]) % 2**64}::UHUGEINT", f"{(42 + _PRIMES[1]) % 2**64}::UHUGEINT", "42::UHUGEINT", f"{(42 - _PRIMES[0]) % 2**64}::UHUGEINT"]
#: XXH64 of each distinct shingle, seed 42, in the steps of its specification: lanes of 32 bytes, then 8, 4 and single ones.
_XXH64 = f"""
x0 AS (SELECT DISTINCT t FROM shingle),
x1 AS (SELECT t, hex(encode(t)) AS x, octet_length(encode(t)) AS n FROM x0),
x2 AS (SELECT *, {", ".join(_fold(_V[i], f"list_transform(range(0, n // 32), lambda j: {_read(f'32 * j + {8 * i}', 8)})", _mul(_rot(f"a + {_mul('b', 2)}", 31), 1)) + f" AS v{i}" for i in range(4))} FROM x1),
x3 AS (SELECT *, CASE WHEN n < 32 THEN {(42 + _PRIMES[4]) % 2**64}::UHUGEINT ELSE {_mod(" + ".join(_rot(f"v{i}", r) for i, r in enumerate((1, 7, 12, 18))))} END AS h FROM x2),
{", ".join(f"x{4 + i} AS (SELECT t, x, n, v0, v1, v2, v3, CASE WHEN n < 32 THEN h ELSE " + _mod(f"{_mul(f'xor(h, {_mul(_rot(_mul(f"v{i}", 2), 31), 1)})', 1)} + {_PRIMES[3]}::UHUGEINT") + f" END AS h FROM x{3 + i})" for i in range(4))},
x8 AS (SELECT t, x, n, {_mod("h + n::UHUGEINT")} AS h FROM x7),
x9 AS (SELECT t, x, n, {_fold("h", f"list_transform(range(n // 32 * 4, n // 8), lambda j: {_read('8 * j', 8)})", _mod(f"{_mul(_rot(f'xor(a, {_mul(_rot(_mul("b", 2), 31), 1)})', 27), 1)} + {_PRIMES[3]}::UHUGEINT"))} AS h FROM x8),
x10 AS (SELECT t, x, n, CASE WHEN n % 8 < 4 THEN h ELSE {_mod(f"{_mul(_rot(f'xor(h, {_mul(_read("n // 8 * 8", 4), 1)})', 23), 2)} + {_PRIMES[2]}::UHUGEINT")} END AS h FROM x9),
x11 AS (SELECT t, {_fold("h", f"list_transform(range(n // 4 * 4, n), lambda j: {_read('j', 1)})", _mul(_rot(f"xor(a, {_mul('b', 5)})", 11), 1))} AS h FROM x10),
x12 AS (SELECT t, {_mul("xor(h, h >> 33)", 2)} AS h FROM x11),
x13 AS (SELECT t, {_mul("xor(h, h >> 29)", 3)} AS h FROM x12),
hash AS (SELECT t, CAST(xor(h, h >> 32) AS UBIGINT) AS h FROM x13)
"""
OP2 = rf"""
WITH RECURSIVE
src AS (
  SELECT doc_id, row_number() OVER () AS rid,
    list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w FROM documents
),
shingle AS (SELECT rid, unnest(CASE WHEN len(w) < 3 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i+2], ' ')) END) AS t FROM src WHERE len(w) > 0),
{_XXH64.strip()},
bits AS (SELECT rid, {" + ".join(f"(CASE WHEN 2 * sum((h >> {b}) & 1) > count(*) THEN {2**b} ELSE 0 END)::UHUGEINT" for b in range(64))} AS fp FROM shingle JOIN hash USING (t) GROUP BY rid),
prints AS (SELECT src.rid, src.doc_id, CAST(coalesce(fp, 0) AS UBIGINT) AS fp FROM src LEFT JOIN bits USING (rid)),
fps AS (SELECT DISTINCT fp FROM prints),
edge AS (SELECT a.fp AS a, b.fp AS b FROM fps a JOIN fps b ON bit_count(xor(a.fp, b.fp)) <= 3),
reach AS (SELECT a, b FROM edge UNION SELECT reach.a, edge.b FROM reach JOIN edge ON reach.b = edge.a),
low AS (SELECT reach.a AS fp, min(prints.doc_id) AS component_id FROM reach JOIN prints ON reach.b = prints.fp GROUP BY reach.a)
SELECT doc_id, lpad(lower(hex(fp)), 16, '0') AS fingerprint, component_id FROM prints JOIN low USING (fp)
"""
