"""XXH3-64 as SQL text, so that SQL engines can check content fids (published algorithm, seed 0)."""

from __future__ import annotations

# Fixed values of the published algorithm: the default secret and the primes.
_SECRET = bytes.fromhex(
    "b8fe6c3923a44bbe7c01812cf721ad1cded46de9839097db7240a4a4b7b3671fcb79e64eccc0e578825ad07dccff7221b8084674f743248ee03590e6813a264c"
    "3c2852bb91c300cb88d0658b1b532ea371644897a20df94e3819ef46a9deacd8a8fa763fe39c343ff9dcbbc7c70b4f1d8a51e04bcdb45931c89f7ec9d9787364"
    "eac5ac8334d3ebc3c581a0fffa1363eb170ddd51b7f0da49d316552629d4689e2b16be587d47a1fc8ff8b8d17ad031ce45cb3a8f95160428afd7fbcabb4b407e"
)
_P32 = (0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D)
_P64 = (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5)
_MX1, _MX2 = 0x165667919E3779F9, 0x9FB21C651E98DF25
_START = (_P32[2], _P64[0], _P64[1], _P64[2], _P64[3], _P32[1], _P64[4], _P32[0])
_MOD = f"{1 << 64}::UHUGEINT"


def _u(n: int) -> str:
    return f"{n}::UBIGINT"


def _secret(at: int, size: int = 8) -> int:
    return int.from_bytes(_SECRET[at : at + size], "little")


def _read(at: str, size: int = 8, h: str = "h") -> str:
    """`size` bytes of hex text h from byte `at`, little-endian."""
    return "('0x' || " + " || ".join(f"substr({h}, CAST(2 * ({at}) + {2 * i + 1} AS BIGINT), 2)" for i in reversed(range(size))) + ")::UBIGINT"


def _wide(x: str) -> str:
    return f"({x})::UHUGEINT"


def _add(*x: str) -> str:
    return f"(({' + '.join(map(_wide, x))}) % {_MOD})::UBIGINT"


def _mul(a: str, b: str) -> str:
    return f"(({_wide(a)} * {_wide(b)}) % {_MOD})::UBIGINT"


def _shifted(x: str, bits: int) -> str:
    return f"xor({x}, ({x}) >> {bits})"


class _Steps:
    """Names for intermediate values: each is a column of a SELECT around the one before."""

    def __init__(self) -> None:
        self.columns: list[str] = []

    def name(self, sql: str) -> str:
        self.columns.append(f"{sql} AS s{len(self.columns)}")
        return f"s{len(self.columns) - 1}"

    def around(self, source: str) -> str:
        for c in self.columns:
            source = f"(SELECT *, {c} FROM {source})"
        return source


def _avalanche(s: _Steps, x: str) -> str:
    a = s.name(_shifted(s.name(x), 37))
    return _shifted(s.name(_mul(a, _u(_MX1))), 32)


def _avalanche64(s: _Steps, x: str) -> str:
    a = s.name(_mul(s.name(_shifted(s.name(x), 33)), _u(_P64[1])))
    return _shifted(s.name(_mul(s.name(_shifted(a, 29)), _u(_P64[2]))), 32)


def _fold(s: _Steps, a: str, b: str) -> str:
    p = s.name(f"{_wide(a)} * {_wide(b)}")
    return s.name(f"xor(({p} % {_MOD})::UBIGINT, ({p} // {_MOD})::UBIGINT)")


def _mix(s: _Steps, at: str, secret: int) -> str:
    return _fold(s, f"xor({_read(at)}, {_u(_secret(secret))})", f"xor({_read(f'({at}) + 8')}, {_u(_secret(secret + 8))})")


def _select(s: _Steps, result: str, where: str) -> str:
    return f"SELECT id, {result} AS u FROM {s.around(f'(SELECT * FROM x3in WHERE {where})')}"


def _rotated(x: str, bits: int) -> str:
    return f"((({_wide(x)} * {1 << bits}::UHUGEINT) % {_MOD})::UBIGINT | ({x} >> {64 - bits}))"


def _parts() -> list[str]:
    out = [f"SELECT id, {_u(0x2D06800538D394C2)} AS u FROM x3in WHERE n = 0"]
    s = _Steps()
    c = s.name(f"({_read('0', 1)} << 16) | ({_read('n // 2', 1)} << 24) | {_read('n - 1', 1)} | (n::UBIGINT << 8)")
    out.append(_select(s, _avalanche64(s, f"xor({c}, {_u(_secret(0, 4) ^ _secret(4, 4))})"), "n BETWEEN 1 AND 3"))
    s = _Steps()
    k = s.name(f"xor({_read('n - 4', 4)} + {_read('0', 4)} * {_u(1 << 32)}, {_u(_secret(8) ^ _secret(16))})")
    a = s.name(_mul(s.name(f"xor(xor({k}, {_rotated(k, 49)}), {_rotated(k, 24)})"), _u(_MX2)))
    b = s.name(_mul(s.name(f"xor({a}, ({a} >> 35) + n::UBIGINT)"), _u(_MX2)))
    out.append(_select(s, _shifted(b, 28), "n BETWEEN 4 AND 8"))
    s = _Steps()
    lo = s.name(f"xor({_read('0')}, {_u(_secret(24) ^ _secret(32))})")
    hi = s.name(f"xor({_read('n - 8')}, {_u(_secret(40) ^ _secret(48))})")
    turned = " | ".join(f"((({lo} >> {8 * i}) & 255) << {56 - 8 * i})" for i in range(8))
    out.append(_select(s, _avalanche(s, _add("n", s.name(turned), hi, _fold(s, lo, hi))), "n BETWEEN 9 AND 16"))
    for least, most, halves in ((17, 32, 1), (33, 64, 2), (65, 96, 3), (97, 128, 4)):
        s = _Steps()
        terms = [_mul("n", _u(_P64[0]))]
        for i in range(halves):
            terms += [_mix(s, str(16 * i), 32 * i), _mix(s, f"n - {16 * (i + 1)}", 32 * i + 16)]
        out.append(_select(s, _avalanche(s, _add(*terms)), f"n BETWEEN {least} AND {most}"))
    for rounds in range(8, 16):
        s = _Steps()
        first = s.name(_avalanche(s, _add(_mul("n", _u(_P64[0])), *(_mix(s, str(16 * i), 16 * i) for i in range(8)))))
        rest = [_mix(s, str(16 * i), 16 * (i - 8) + 3) for i in range(8, rounds)] + [_mix(s, "n - 16", 119)]
        out.append(_select(s, _avalanche(s, _add(first, *rest)), f"n BETWEEN {max(129, 16 * rounds)} AND {min(240, 16 * rounds + 15)}"))
    return out


def _at(values: list[int], index: str) -> str:
    """The value of a list of constants at a 0-based index."""
    return f"([{', '.join(map(_u, values))}])[CAST({index} + 1 AS BIGINT)]"


def xxh3_sql(source: str, name: str = "x3") -> str:
    """CTEs, the last called `name` with (id, u): XXH3 as UBIGINT of a query with (id, h): any id and upper- or lower-case hex."""
    secrets = [_secret(8 * i) for i in range(24)]
    last = [_secret(121 + 8 * i) for i in range(8)]
    scramble = f"xor(xor(v, v >> 47), {_at([_secret(128 + 8 * i) for i in range(8)], 'lane')})"
    s = _Steps()
    merged = [_fold(s, f"xor(a[{2 * i + 1}], {_u(_secret(11 + 16 * i))})", f"xor(a[{2 * i + 2}], {_u(_secret(19 + 16 * i))})") for i in range(4)]
    final = _avalanche(s, _add(_mul("n", _u(_P64[0])), *merged))
    return f"""x3in AS (SELECT id, h, CAST(length(h) // 2 AS BIGINT) AS n FROM ({source})),
x3short AS ({' UNION ALL '.join(_parts())}),
x3long AS (SELECT id, h, n, (n - 1) // 1024 AS blocks FROM x3in WHERE n > 240),
x3stripes AS (SELECT id, h, k // 16 AS block, k * 64 AS pos, k % 16 AS key, FALSE AS tail, blocks FROM (SELECT *, unnest(range((n - 1) // 64)) AS k FROM x3long)
  UNION ALL SELECT id, h, blocks, n - 64, 0, TRUE, blocks FROM x3long),
x3lanes AS (SELECT id, block, blocks, lane, d, xor(d, CASE WHEN tail THEN {_at(last, 'lane')} ELSE {_at(secrets, 'key + lane')} END) AS k
  FROM (SELECT *, {_read('pos + 8 * lane')} AS d FROM (SELECT *, unnest(range(8)) AS lane FROM x3stripes))),
x3adds AS (SELECT id, block, blocks, lane, (k & 4294967295) * (k >> 32) AS v FROM x3lanes UNION ALL SELECT id, block, blocks, CASE WHEN lane % 2 = 0 THEN lane + 1 ELSE lane - 1 END, d FROM x3lanes),
x3sums AS (SELECT id, blocks, lane, block, CAST(sum(v::HUGEINT) % {1 << 64}::HUGEINT AS UBIGINT) AS v FROM x3adds GROUP BY ALL),
x3acc AS (SELECT id, lane, list_reduce(list_prepend({_at(list(_START), 'lane')}, list(v ORDER BY block) FILTER (WHERE block < blocks)),
    lambda acc, x: {_mul(scramble.replace('v', _add('acc', 'x')), _u(_P32[0]))}) AS scrambled, coalesce(max(v) FILTER (WHERE block = blocks), 0) AS rest FROM x3sums GROUP BY id, lane),
x3end AS (SELECT l.id, l.n, list({_add('scrambled', 'rest')} ORDER BY lane) AS a FROM x3acc a JOIN x3long l ON a.id = l.id GROUP BY l.id, l.n),
{name} AS (SELECT id, u FROM x3short UNION ALL SELECT id, {final} AS u FROM {s.around('x3end')})"""
