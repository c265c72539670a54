"""The hexagonal grid of aperture 7 on an icosahedron, with its published 64-bit cell ids.

A point is projected from the sphere's centre on the plane of its face, rounded to the lattice of its resolution, and led
up through the coarser lattices: each step gives a digit. Twelve of the 122 coarsest cells are pentagons about the
icosahedron's corners, which lack one digit's sector.

Only the position of the faces is a fixed value. Which coarse cell holds which point of a face, and by how many sixths
of a turn its axes differ there, follows from unfolding neighbouring faces into one plane; the coarse cells are numbered
from north to south. Ids, parents and centres equal the published ones; at odd resolutions the published outline of a
cell that crosses an edge of the icosahedron has one point more at the edge.

Core functions work on arrays; the columns below run them on Arrow batches, and parents are bit arithmetic.
"""

from __future__ import annotations

from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Latitude and longitude of the centre of each face, and the azimuth of its first axis there, in radians.
FACES = (
    (0.803582649718989942, 1.248397419617396099, 5.619958268523939882),
    (1.307747883455638156, 2.536945009877921159, 5.760339081714187279),
    (1.054751253523952054, -1.347517358900396623, 0.780213654393430055),
    (0.600191595538186799, -0.450603909469755746, 0.430469363979999913),
    (0.491715428198773866, 0.401988202911306943, 6.130269123335111400),
    (0.172745327415618701, 1.678146885280433686, 2.692877706530642877),
    (0.605929321571350690, 2.953923329812411617, 2.982963003477243874),
    (0.427370518328979641, -1.888876200336285401, 3.532912002790141181),
    (-0.079066118549212831, -0.733429513380867741, 3.494305004259568154),
    (-0.230961644455383637, 0.506495587332349035, 3.003214169499538391),
    (0.079066118549212831, 2.408163140208925497, 5.930472956509811562),
    (0.230961644455383637, -2.635097066257444203, 0.138378484090254847),
    (-0.172745327415618701, -1.463445768309359553, 0.448714947059150361),
    (-0.605929321571350690, -0.187669323777381622, 0.158629650112549365),
    (-0.427370518328979641, 1.252716453253507838, 5.891865957979238535),
    (-0.600191595538186799, 2.690988744120037492, 2.711123289609793325),
    (-0.491715428198773866, -2.739604450678486295, 3.294508837434268316),
    (-0.803582649718989942, -1.893195233972397139, 3.804819692245439833),
    (-1.307747883455638156, -0.604647643711872080, 3.664438879055192436),
    (-1.054751253523952054, 1.794075294689396615, 2.361378999196363184),
)
# The two faces of each coarse cell that lies on an edge are told by its number; its axes are those of this face.
EDGE_HOMES = {
    1: 2, 5: 1, 11: 1, 13: 3, 19: 2, 22: 0, 28: 4, 30: 0, 35: 11, 39: 6, 40: 7, 43: 3, 52: 10, 53: 4, 54: 12, 67: 5, 68: 16, 69: 8,
    78: 15, 81: 14, 82: 13, 86: 9, 91: 17, 93: 16, 99: 17, 102: 19, 108: 15, 110: 18, 116: 18, 120: 19,
}
# The face whose axes each pentagon has.
PENTAGON_HOMES = {4: 0, 14: 11, 24: 10, 38: 12, 49: 14, 58: 13, 63: 6, 72: 7, 83: 5, 97: 8, 107: 9, 117: 19}

TURN = np.arcsin(np.sqrt(3 / 28))  # by which the lattices of odd resolutions are turned
UNIT = 0.38196601125010500003  # of the coarsest lattice, on the plane that touches the unit sphere
DIGITS = np.array([(0, 0), (-1, -1), (0, 1), (-1, 0), (1, 0), (0, -1), (1, 1)])  # steps of the seven digits along the axes at 0 and 120 degrees
ANGLES = np.array([-1, 4, 2, 3, 0, 5, 1])  # of the digits, in sixths of a turn
BY_ANGLE = np.array([4, 6, 2, 3, 1, 5])
SECTORS = np.array([3, 5, 0, 1, 2])  # of a pentagon's five faces, counter-clockwise from its home; the fourth sixth is left out
CORNERS = np.array([2, 2 * np.exp(2j * np.pi / 3), 2 * np.exp(4j * np.pi / 3)])


def to_plane(ab: np.ndarray) -> np.ndarray:
    """Lattice coordinates to a complex number."""
    return ab[..., 0] + ab[..., 1] * np.exp(2j * np.pi / 3)


def to_lattice(z: np.ndarray) -> np.ndarray:
    """The nearest lattice point: one of the corners of the rhombus that holds z."""
    b = z.imag / np.sin(np.pi / 3)
    a = z.real + b / 2
    low = np.stack((np.floor(a), np.floor(b)), axis=-1).astype(np.int64)
    corners = low[..., None, :] + np.array([(0, 0), (1, 0), (0, 1), (1, 1)])
    best = np.abs(to_plane(corners) - z[..., None]).argmin(axis=-1)
    return np.take_along_axis(corners, best[..., None, None], axis=-2)[..., 0, :]


def _up(ab: np.ndarray, odd: bool) -> np.ndarray:
    """The parent of a lattice point, which is of an odd resolution or not."""
    a, b = ab[..., 0], ab[..., 1]
    top = np.stack((3 * a - b, a + 2 * b) if odd else (2 * a + b, 3 * b - a), axis=-1)
    return np.floor_divide(2 * top + 7, 14)


def _down(ab: np.ndarray, odd: bool) -> np.ndarray:
    """The lattice point amid a parent's children, which are of an odd resolution or not."""
    a, b = ab[..., 0], ab[..., 1]
    return np.stack((2 * a + b, 3 * b - a) if odd else (3 * a - b, a + 2 * b), axis=-1)


class Grid:
    """Faces as planes, how they unfold about each other, and the coarse cells."""

    def __init__(self) -> None:
        lat, lon, azimuth = np.array(FACES).T
        self.centre = np.stack((np.cos(lat) * np.cos(lon), np.cos(lat) * np.sin(lon), np.sin(lat)), axis=1)
        north = np.stack((-np.sin(lat) * np.cos(lon), -np.sin(lat) * np.sin(lon), np.cos(lat)), axis=1)
        east = np.stack((-np.sin(lon), np.cos(lon), np.zeros(20)), axis=1)
        axis = lambda t: north * np.cos(t)[:, None] + east * np.sin(t)[:, None]
        self.x, self.y = axis(azimuth), axis(azimuth - np.pi / 2)
        corners = self.sphere(np.repeat(np.arange(20), 3), np.tile(CORNERS, 20)).reshape(20, 3, 3)
        near = lambda p, q: np.abs(p - q).sum(axis=-1) < 1e-6
        # across edge e (from corner e to the next): the face there, and its plane as seen from ours: z -> turn * z + shift
        self.across = np.zeros((20, 3), dtype=np.int64)
        self.turn, self.shift = np.zeros((20, 3), dtype=complex), np.zeros((20, 3), dtype=complex)
        for f in range(20):
            for e in range(3):
                p, q = corners[f, e], corners[f, (e + 1) % 3]
                for g in range(20):
                    if g != f and near(corners[g], p).any() and near(corners[g], q).any():
                        i, j = near(corners[g], p).argmax(), near(corners[g], q).argmax()
                        self.across[f, e] = g
                        self.turn[f, e] = (CORNERS[(e + 1) % 3] - CORNERS[e]) / (CORNERS[j] - CORNERS[i])
                        self.shift[f, e] = CORNERS[e] - self.turn[f, e] * CORNERS[i]
        self._number(corners)

    def sphere(self, face: np.ndarray, z: np.ndarray) -> np.ndarray:
        z = z * UNIT
        p = self.centre[face] + z.real[..., None] * self.x[face] + z.imag[..., None] * self.y[face]
        return p / np.linalg.norm(p, axis=-1, keepdims=True)

    def _number(self, corners: np.ndarray) -> None:
        """base, turns: for a face and a lattice point (plus 4) the coarse cell there, and by how many sixths of a turn
        its axes lie counter-clockwise of the face's; home_face, home_at: where each coarse cell's own axes are."""
        own = [(f, ab) for f in range(20) for ab in ((0, 0), (1, 0), (0, 1), (-1, -1), (1, 1), (-1, 0), (0, -1), (2, 0), (0, 2), (-2, -2))]
        at = self.sphere(np.array([f for f, _ in own]), to_plane(np.array([ab for _, ab in own])))
        first = [int((np.abs(at[: k + 1] - p).sum(axis=1) < 1e-6).argmax()) for k, p in enumerate(at)]
        order = sorted(set(first), key=lambda k: -at[k, 2])
        number = {k: n for n, k in enumerate(order)}
        cells = {(f, ab): number[first[k]] for k, (f, ab) in enumerate(own)}
        self.home_face, self.home_at = np.zeros(122, dtype=np.int64), np.zeros((122, 2), dtype=np.int64)
        for (f, ab), n in cells.items():
            if (EDGE_HOMES | PENTAGON_HOMES).get(n, f) == f:
                self.home_face[n], self.home_at[n] = f, ab
        self.pentagon = np.isin(np.arange(122), list(PENTAGON_HOMES))
        self.base = np.full((20, 9, 9), -1)
        self.turns = np.zeros((20, 9, 9), dtype=np.int64)
        self.sector = np.zeros((20, 3), dtype=np.int64)  # number of a face about the pentagon at its corner, from the pentagon's home
        self.around = np.zeros((122, 5), dtype=np.int64)
        self.around_corner = np.zeros((122, 5), dtype=np.int64)
        sixth = lambda w: int(round(np.angle(w) / (np.pi / 3))) % 6
        for n in PENTAGON_HOMES:
            face, corner = self.home_face[n], int(np.abs(CORNERS - to_plane(self.home_at[n])).argmin())
            for k in range(5):  # counter-clockwise about a corner: over the edge that ends there
                self.around[n, k], self.around_corner[n, k], self.sector[face, corner] = face, corner, k
                p = corners[face, corner]
                face = self.across[face, (corner + 2) % 3]
                corner = int(np.abs(corners[face] - p).sum(axis=1).argmin())
        for (f, ab), n in cells.items():
            a, b = ab[0] + 4, ab[1] + 4
            self.base[f, a, b] = n
            if not self.pentagon[n] and self.home_face[n] != f:
                e = int((self.across[f] == self.home_face[n]).argmax())
                self.turns[f, a, b] = -sixth(self.turn[f, e]) % 6
        for f in range(20):  # lattice points just beyond an edge belong to the face there
            for e in range(3):
                g = self.across[f, e]
                for ab in ((1, 0), (0, 1), (-1, -1)):
                    a, b = to_lattice(np.array([self.turn[f, e] * to_plane(np.array(ab)) + self.shift[f, e]]))[0] + 4
                    if self.base[f, a, b] < 0:
                        self.base[f, a, b], self.turns[f, a, b] = cells[g, ab], -sixth(self.turn[f, e]) % 6

    def unfold(self, face: np.ndarray, z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The face under a point of a face's plane, and the point in that face's plane."""
        face, z = face.copy(), z.copy()
        for _ in range(2):
            middle = np.exp(1j * np.pi / 3 * np.array([1, 3, 5]))  # of the edges
            over = np.real(z[:, None] * np.conj(middle)) - 1
            edge = over.argmax(axis=1)
            out = np.flatnonzero(over[np.arange(len(z)), edge] > 1e-9)
            f, e = face[out], edge[out]
            z[out] = (z[out] - self.shift[f, e]) / self.turn[f, e]
            face[out] = self.across[f, e]
        return face, z


@cache
def grid() -> Grid:
    return Grid()


_SIXTH = np.exp(1j * np.pi / 3)


def _scale(res: int) -> complex:
    """The lattice vector at angle 0 of a resolution, in the coarsest lattice's plane."""
    return 7 ** (-res / 2) * (np.exp(1j * TURN) if res % 2 else 1)


def points(lat: np.ndarray, lon: np.ndarray) -> np.ndarray:
    lat, lon = np.radians(lat), np.radians(lon)
    return np.stack((np.cos(lat) * np.cos(lon), np.cos(lat) * np.sin(lon), np.sin(lat)), axis=-1)


def degrees(p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return np.degrees(np.arcsin(np.clip(p[..., 2], -1, 1))), np.degrees(np.arctan2(p[..., 1], p[..., 0]))


def cells_of(p: np.ndarray, res: int) -> np.ndarray:
    """Ids of the cells that hold these points of the unit sphere."""
    g = grid()
    face = (p @ g.centre.T).argmax(axis=1)
    depth = (p * g.centre[face]).sum(axis=1) * UNIT
    ab = to_lattice(((p * g.x[face]).sum(axis=1) + 1j * (p * g.y[face]).sum(axis=1)) / depth / _scale(res))
    digits = np.zeros((len(p), res), dtype=np.int64)
    digit_of = np.zeros((3, 3), dtype=np.int64)
    digit_of[DIGITS[:, 0], DIGITS[:, 1]] = np.arange(7)
    for r in range(res, 0, -1):
        parent = _up(ab, r % 2 == 1)
        step = ab - _down(parent, r % 2 == 1)
        digits[:, r - 1] = digit_of[step[:, 0], step[:, 1]]
        ab = parent
    base, turns = g.base[face, ab[:, 0] + 4, ab[:, 1] + 4], g.turns[face, ab[:, 0] + 4, ab[:, 1] + 4]
    five = np.flatnonzero(g.pentagon[base])
    if len(five) and res:
        corner = np.abs(to_plane(ab[five])[:, None] - CORNERS).argmin(axis=1)
        here = digits[five]
        lead = ANGLES[here[np.arange(len(five)), (here > 0).argmax(axis=1)]]
        lead = np.where((here > 0).any(axis=1), lead, 0)
        beside = (lead - 2 * corner) % 6 - 3  # sectors from the face's own, as 2 * corner + 3 points to its middle
        turns[five] = SECTORS[(g.sector[face[five], corner] + beside) % 5] - lead
    turned = np.where(digits > 0, BY_ANGLE[(ANGLES[digits] + turns[:, None]) % 6], 0)
    out = (1 << 59) + (res << 52) + (base << 45) + (1 << 3 * (15 - res)) - 1
    for r in range(res):
        out += turned[:, r] << 3 * (14 - r)
    return out


def resolution(cells: np.ndarray) -> np.ndarray:
    return cells >> 52 & 15


def _placed(cells: np.ndarray, res: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Face and place on its plane of the centres of cells of one resolution, and whether they are pentagons."""
    g = grid()
    base = cells >> 45 & 127
    ab, lead = g.home_at[base], np.zeros(len(cells), dtype=np.int64)
    for r in range(1, res + 1):
        digit = cells >> 3 * (15 - r) & 7
        ab = _down(ab, r % 2 == 1) + DIGITS[digit]
        lead = np.where(lead > 0, lead, digit)
    z, face = to_plane(ab) * _scale(res), g.home_face[base].copy()
    five = g.pentagon[base]
    at = np.flatnonzero(five)
    if len(at):
        about = z[at] - CORNERS[0]
        first = np.where(lead[at] > 0, ANGLES[lead[at]], SECTORS[0])
        on = np.rint(np.angle(about * _SIXTH ** (-first.astype(float))) / (np.pi / 3)).astype(np.int64)  # sectors from the first digit's
        k = ((first[:, None] == SECTORS).argmax(axis=1) + on) % 5
        face[at], corner = g.around[base[at], k], g.around_corner[base[at], k]
        z[at] = CORNERS[corner] + about * _SIXTH ** (2.0 * corner + 3 - first - on)
    plain = np.flatnonzero(~five)
    face[plain], z[plain] = g.unfold(face[plain], z[plain])
    return face, z, five & (lead == 0)


def centres(cells: np.ndarray) -> np.ndarray:
    """Points of the unit sphere amid the cells."""
    out = np.zeros((len(cells), 3))
    for res in np.unique(resolution(cells)):
        at = np.flatnonzero(resolution(cells) == res)
        face, z, _ = _placed(cells[at], int(res))
        out[at] = grid().sphere(face, z)
    return out


def outlines(cells: np.ndarray) -> np.ndarray:
    """The six corners of each cell on the unit sphere, counter-clockwise; a pentagon's sixth is NaN."""
    g = grid()
    out = np.full((len(cells), 6, 3), np.nan)
    for res in np.unique(resolution(cells)):
        at = np.flatnonzero(resolution(cells) == res)
        face, z, five = _placed(cells[at], int(res))
        first = _scale(int(res)) * np.exp(1j * np.pi / 6) / np.sqrt(3)
        for k in range(6):
            out[at, k] = g.sphere(*g.unfold(face, z + first * _SIXTH**k))
        for i in at[five]:  # one corner in each of the faces about it
            base = cells[i] >> 45 & 127
            f, corner = g.around[base], g.around_corner[base]
            out[i, :5] = g.sphere(f, CORNERS[corner] + first * _SIXTH ** (2.0 * corner + 2))
            out[i, 5] = np.nan
    return out


def neighbours(cells: np.ndarray) -> np.ndarray:
    """The cells across the six edges of each cell, in a row; a pentagon's own id fills its sixth place."""
    corner, middle = outlines(cells), centres(cells)
    following = np.roll(corner, -1, axis=1)
    five = np.isnan(corner[:, 5, 0])
    following[five, 4], following[five, 5], corner[five, 5] = corner[five, 0], middle[five], middle[five]
    edge = (corner + following) / 2
    beyond = edge + 0.05 * (edge - middle[:, None])
    out = np.zeros((len(cells), 6), dtype=np.int64)
    for res in np.unique(resolution(cells)):
        at = np.flatnonzero(resolution(cells) == res)
        out[at] = cells_of(beyond[at].reshape(-1, 3), int(res)).reshape(-1, 6)
    return out


def disks(cells: np.ndarray, k: int) -> list[np.ndarray]:
    """For each cell the cells within k steps, itself included, sorted."""
    own = np.stack((np.arange(len(cells)), cells), axis=1)
    for _ in range(k):
        ids, index = np.unique(own[:, 1], return_inverse=True)
        near = neighbours(ids)[index]
        own = np.unique(np.concatenate((own, np.stack((np.repeat(own[:, 0], 6), near.ravel()), axis=1))), axis=0)
    return np.split(own[:, 1], np.searchsorted(own[:, 0], np.arange(1, len(cells)))) if len(cells) else []


def _of_known(out: np.ndarray, known: np.ndarray) -> pd.Series:
    return pd.Series(out, dtype="Int64").where(known)


def cell(lat: Column, lon: Column, res: int) -> Column:
    """Id of the cell that holds a place in degrees; null without a finite place."""

    @F.pandas_udf(T.LongType())
    def at(lat: pd.Series, lon: pd.Series) -> pd.Series:
        x, y = lat.to_numpy(dtype=float, na_value=np.nan), lon.to_numpy(dtype=float, na_value=np.nan)
        known = np.isfinite(x) & np.isfinite(y)
        return _of_known(cells_of(points(np.where(known, x, 0), np.where(known, y, 0)), res), known)

    return at(lat.cast("double"), lon.cast("double"))


def name(cell: Column) -> Column:
    """The published form of an id."""
    return F.lower(F.hex(cell))


def parent(cell: Column, res: int) -> Column:
    """The ancestor at a coarser resolution: its digits end earlier. The same cell where that isn't coarser."""
    at = cell.bitwiseAND(F.lit(~(15 << 52))).bitwiseOR(F.lit(res << 52)).bitwiseOR(F.lit((1 << 3 * (15 - res)) - 1))
    return F.when(F.shiftright(cell, 52).bitwiseAND(F.lit(15)) > res, at).otherwise(cell)


def _nullable(cells: pd.Series) -> tuple[np.ndarray, np.ndarray]:
    known = cells.notna().to_numpy()
    return cells.to_numpy(dtype="int64", na_value=0)[known], known


@F.pandas_udf(T.StructType([T.StructField("lat", T.DoubleType()), T.StructField("lon", T.DoubleType())]))
def centre(cells: pd.Series) -> pd.DataFrame:
    """Latitude and longitude amid a cell."""
    some, known = _nullable(cells.astype("Int64"))
    out = np.full((2, len(cells)), np.nan)
    out[:, known] = degrees(centres(some))
    return pd.DataFrame({"lat": out[0], "lon": out[1]})


@F.pandas_udf(T.ArrayType(T.ArrayType(T.DoubleType())))
def ring(cells: pd.Series) -> pd.Series:
    """A cell's outline as a closed list of (lon, lat), counter-clockwise."""
    some, known = _nullable(cells.astype("Int64"))
    lat, lon = degrees(outlines(some))
    lists = iter([[[x, y] for x, y in zip(a, b) if x == x] for a, b in zip(lon.tolist(), lat.tolist())])
    return pd.Series([[*(r := next(lists)), r[0]] if k else None for k in known], dtype=object)


def disk(cell: Column, k: int) -> Column:
    """The ids within k steps of a cell, itself included."""

    @F.pandas_udf(T.ArrayType(T.LongType()))
    def around(cells: pd.Series) -> pd.Series:
        some, known = _nullable(cells.astype("Int64"))
        lists = iter(disks(some, k))
        return pd.Series([next(lists) if x else None for x in known], dtype=object)

    return around(cell)
