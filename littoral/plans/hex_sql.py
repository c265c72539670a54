"""The hexagonal grid in DuckDB SQL: cells of places by arithmetic on their face's plane. Pentagons are left out."""

from __future__ import annotations

from ..functions import hexagons as H


def cells(places: str, res: int) -> str:
    """A query for lat, lon, cell, face, a, b (the cell's place on its face's lattice), clat and clon (its centre) of each
    distinct place of the query ``places`` (lat, lon)."""
    g = H.grid()
    num = lambda x: f"{float(x)!r}::DOUBLE"
    faces = ", ".join(f"({f}, " + ", ".join(num(x) for axis in (g.centre, g.x, g.y) for x in axis[f]) + ")" for f in range(20))
    known = ", ".join(f"({f}, {a - 4}, {b - 4}, {g.base[f, a, b]}, {g.turns[f, a, b]})" for f in range(20) for a in range(9) for b in range(9) if g.base[f, a, b] >= 0 and not g.pentagon[g.base[f, a, b]])
    scale = H._scale(res)
    inverse = 1 / (scale * H.UNIT)
    real = lambda a, b: f"({a} - {b} / 2.0::DOUBLE)"
    imag = lambda b: f"({b} * {num(H.np.sin(H.np.pi / 3))})"
    parts = [
        f"p AS (SELECT DISTINCT lat::DOUBLE AS lat, lon::DOUBLE AS lon FROM ({places}) WHERE lat IS NOT NULL AND lon IS NOT NULL)",
        "v AS (SELECT lat, lon, cos(radians(lat)) * cos(radians(lon)) AS x, cos(radians(lat)) * sin(radians(lon)) AS y, sin(radians(lat)) AS z FROM p)",
        f"f AS (SELECT * FROM (VALUES {faces}) t(face, cx, cy, cz, ix, iy, iz, jx, jy, jz))",
        "n AS (SELECT *, x * cx + y * cy + z * cz AS depth FROM v, f QUALIFY row_number() OVER (PARTITION BY lat, lon ORDER BY depth DESC) = 1)",
        "w AS (SELECT *, (x * ix + y * iy + z * iz) / depth AS re, (x * jx + y * jy + z * jz) / depth AS im FROM n)",
        f"s AS (SELECT * EXCLUDE (re, im), re * {num(inverse.real)} - im * {num(inverse.imag)} AS re, re * {num(inverse.imag)} + im * {num(inverse.real)} AS im FROM w)",
        f"c AS (SELECT *, floor(re + im / {num(H.np.sin(H.np.pi / 3))} / 2)::BIGINT + da AS a, floor(im / {num(H.np.sin(H.np.pi / 3))})::BIGINT + db AS b FROM s, (VALUES (0, 0), (1, 0), (0, 1), (1, 1)) d(da, db))",
        f"l{res} AS (SELECT *, a AS a{res}, b AS b{res}, 0::BIGINT AS digits FROM c QUALIFY row_number() OVER (PARTITION BY lat, lon ORDER BY pow({real('a', 'b')} - re, 2) + pow({imag('b')} - im, 2)) = 1)",
    ]
    third = lambda top: f"floor(({top}) / 7.0::DOUBLE + 0.5)::BIGINT"
    for r in range(res, 0, -1):
        a, b = f"a{r}", f"b{r}"
        up = (f"3 * {a} - {b}", f"{a} + 2 * {b}") if r % 2 else (f"2 * {a} + {b}", f"3 * {b} - {a}")
        parts.append(f"u{r} AS (SELECT *, {third(up[0])} AS a{r - 1}, {third(up[1])} AS b{r - 1} FROM l{r})")
        a0, b0 = f"a{r - 1}", f"b{r - 1}"
        down = (f"2 * {a0} + {b0}", f"3 * {b0} - {a0}") if r % 2 else (f"3 * {a0} - {b0}", f"{a0} + 2 * {b0}")
        digit = "CASE " + " ".join(f"WHEN {a} - ({down[0]}) = {da} AND {b} - ({down[1]}) = {db} THEN {k}" for k, (da, db) in enumerate(H.DIGITS.tolist())) + " END"
        parts.append(f"l{r - 1} AS (SELECT * EXCLUDE (digits), digits + ({digit})::BIGINT * {8 ** (15 - r)}::BIGINT AS digits FROM u{r})")
    turned = " + ".join(f"{8 ** (15 - r)}::BIGINT * CASE (digits // {8 ** (15 - r)}) % 8 " + " ".join(f"WHEN {k} THEN {H.BY_ANGLE.tolist()}[({H.ANGLES[k]} + turns) % 6 + 1]" for k in range(1, 7)) + " ELSE 0 END" for r in range(1, res + 1)) or "0"
    parts += [
        f"k AS (SELECT * FROM (VALUES {known}) t(face, a0, b0, base, turns))",
        f"i AS (SELECT *, {(1 << 59) + (res << 52) + (1 << 3 * (15 - res)) - 1} + base::BIGINT * {1 << 45}::BIGINT + {turned} AS cell, {real(f'a{res}', f'b{res}')} AS qr, {imag(f'b{res}')} AS qi FROM l0 JOIN k USING (face, a0, b0))",
    ]
    back = scale * H.UNIT
    parts += [
        f"q AS (SELECT * EXCLUDE (qr, qi), qr * {num(back.real)} - qi * {num(back.imag)} AS qr, qr * {num(back.imag)} + qi * {num(back.real)} AS qi FROM i)",
        "o AS (SELECT *, cx + qr * ix + qi * jx AS ox, cy + qr * iy + qi * jy AS oy, cz + qr * iz + qi * jz AS oz FROM q)",
        f"SELECT lat, lon, cell, face, a{res} AS a, b{res} AS b, degrees(asin(oz / sqrt(ox * ox + oy * oy + oz * oz))) AS clat, degrees(atan2(oy, ox)) AS clon FROM o",
    ]
    return "WITH " + ", ".join(parts[:-1]) + " " + parts[-1]


def parent(cell: str, res: int) -> str:
    """The ancestor of a cell as an SQL expression."""
    rest = 8 ** (15 - res)
    return f"(({cell}) - ((({cell}) >> 52) & 15) * {1 << 52}::BIGINT + {res << 52}::BIGINT) // {rest} * {rest} + {rest - 1}"
