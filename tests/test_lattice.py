"""Operators against numpy on small lattices, and the rules for NaN, infinities and zeros."""

import math

import numpy as np
import pytest

from gridloom.functions import numeric as N
from gridloom.lattice import Lattice
from gridloom.operators import REGISTRY, components, lines, mesh, stencil, tensor
from gridloom.operators.reduce import compare, robust_range

RNG = np.random.default_rng(5)


@pytest.fixture(scope="module")
def cube(spark):
    a = RNG.normal(size=(7, 6, 5))
    return a, Lattice.of_numpy(spark, a, pix=(1.0, 2.0, 3.0, 1.0))


@pytest.fixture(scope="module")
def series(spark):
    a = RNG.normal(size=(24, 2, 2, 2))
    a[:, 0, 0, 0] = 1.0
    a[:, 0, 0, 1] = np.arange(24)
    return a, Lattice.of_numpy(spark, a)


def test_special_values(spark):
    v = [math.nan, math.inf, -math.inf, 0.0, -0.0, 2.5, -2.5, -1.0]
    lat = Lattice.of_numpy(spark, np.array(v).reshape(1, 1, 8))
    got = lambda name, *a: lat.apply(name, *a).to_numpy().ravel()
    assert got("bin").tolist() == [0, 1, 0, 0, 0, 1, 0, 0]
    assert got("binv").tolist() == [1, 0, 1, 1, 1, 0, 1, 1]
    assert got("nan")[0] == 0 and got("nanm").tolist() == [1] + [0] * 7
    assert got("round")[5:].tolist() == [3, -3, -1]
    assert got("trunc")[5:].tolist() == [2, -2, -1]
    assert math.isnan(got("thr", 0)[0]) and math.isnan(got("uthr", 0)[0])
    assert got("max", 1)[0] == 1 and got("min", 1)[0] == 1
    assert got("log")[3] == 0 and got("log")[7] == 0
    assert got("recip")[3] == 0
    assert got("div", 0)[5] == math.inf
    assert got("odt", "char").tolist() == [0, 255, 0, 0, 0, 3, 0, 0]


def test_bad_operands(cube):
    _, lat = cube
    for name, arg in (("rem", 0), ("mod", 0), ("mas", 2), ("thr", lat), ("power", lat)):
        with pytest.raises(ValueError):
            lat.apply(name, arg)
    with pytest.raises(ValueError):
        lat.apply("no_such_operator")
    with pytest.raises(NotImplementedError):
        lat.apply("skullstrip")
    with pytest.raises(AttributeError):
        lat.no_such_operator()
    with pytest.raises(ValueError):
        lat.add(Lattice.of_numpy(lat.df.sparkSession, np.zeros((2, 2, 2))))


def test_identity_is_folded(cube):
    _, lat = cube
    assert lat.add(0) is lat and lat.mul(1) is lat


def test_pointwise_chain_needs_no_shuffle(cube):
    _, lat = cube
    plan = lat.mul(2).add(1).thr(0).df._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan and "Python" not in plan


def test_normal_conversions():
    assert N.NORMAL["ztop"](0) == 0.5 and N.NORMAL["ztop"](-9) == 1 and N.NORMAL["ztop"](9) == 0
    for z in (-3.0, -0.5, 0.0, 1.7, 5.0):
        assert abs(N.NORMAL["ptoz"](N.upper_tail(z)) - z) < 1e-6
    assert N.NORMAL["ptozc"](0) == 13 and N.NORMAL["ptozc"](1) == -13 and math.isnan(N.NORMAL["ptozc"](2))


@pytest.mark.parametrize("name", ["fmean", "fmeanu", "dilM", "dilD", "dilF", "ero", "eroF", "fmedian"])
def test_scattered_equals_dense(cube, name):
    a, lat = cube
    a = np.where(a < 0, 0, np.round(a * 3))
    lat = Lattice.of_numpy(lat.df.sparkSession, a)
    small = lat.apply(name).to_numpy()[0]
    assert np.allclose(small, stencil.dense(name, a, stencil.offsets(lat)))
    big = lat.kernel("boxv", 5)
    assert np.allclose(big.apply(name).to_numpy()[0], stencil.dense(name, a, stencil.offsets(big)))


def test_slabs_have_no_seams(spark, monkeypatch):
    from gridloom.plans import blocks

    a = RNG.normal(size=(40, 4, 4))
    lat = Lattice.of_numpy(spark, a)
    whole = lat.s(1.0).to_numpy()
    monkeypatch.setattr(blocks, "SLAB_VOXELS", 1)
    assert np.allclose(lat.s(1.0).to_numpy(), whole)


def test_unifize_in_slabs(spark, monkeypatch):
    """One task had a whole volume."""
    from gridloom.plans import blocks

    a = np.abs(RNG.normal(size=(60, 3, 4)))
    a[RNG.random(a.shape) < 0.1] = 0
    a = np.stack([a, -a, 3 * a])
    monkeypatch.setattr(blocks, "SLAB_VOXELS", 1)
    assert np.array_equal(Lattice.of_numpy(spark, a).unifize().to_numpy(), np.stack([components.unify(v, (1.0, 1.0, 1.0)) for v in a]))
    v = RNG.normal(size=(2, 1, 1, 999))
    v[1] = np.round(v[1])
    got = components.percentile(Lattice.of_numpy(spark, v).df, 0.98, bins=50, few=10)
    assert [got[t] for t in (0, 1)] == [np.percentile(x, 98) for x in v]


def by_parts(lat):
    """Whether no step of the plan groups by volume alone."""
    plan = lat.df._jdf.queryExecution().executedPlan().toString()
    groups = [line for line in plan.splitlines() if "InPandas" in line]
    return groups and all("b#" in line for line in groups)


@pytest.mark.parametrize("op", ["edt", "sedt", ("dilate", 1.5, 2), ("erode", -1, 1.5), ("close", 1.5, 3, 1), ("close", 1.5, 3, 0)])
def test_distances_in_parts(spark, monkeypatch, op):
    """One task had a whole volume."""
    from gridloom.plans import blocks

    a, pix = RNG.normal(size=(2, 20, 4, 3)), (1.0, 2.0, 0.5)
    a[1] = 9.0 if op == "edt" else a[1]
    op = (op,) if isinstance(op, str) else op
    monkeypatch.setattr(blocks, "SLAB_VOXELS", 30)
    lat = Lattice.of_numpy(spark, a, pix=(*pix, 1.0)).apply(*op)
    d = lambda m: np.nan_to_num(lines.distance(m, pix), posinf=lines.FAR)
    want = {
        "edt": lambda v: d(v > 0),
        "sedt": lambda v: d(v > 0) - d(~(v > 0)),
        "dilate": lambda v: np.where(d(v < 1.5) <= 2, v, 0),
        "erode": lambda v: np.where(d(v >= -1) >= 1.5, v, 0),
        "close": lambda v: np.where((e := d(d(v < 1.5) < op[2])) * (e >= op[3]) > 0, np.maximum(1.5, v), v),
    }[op[0]]
    assert np.array_equal(lat.to_numpy(), np.stack([want(v) for v in a])) and by_parts(lat)


def test_envelope_of_far_sites():
    for n, k in ((700, 2), (1000, 0), (513, 500)):
        f = np.full(n, np.inf)
        f[RNG.integers(0, n, k)] = RNG.random(k) * 1e4
        i = np.arange(n)
        want = np.min(f[None] + ((i[:, None] - i) * 0.7) ** 2, axis=1)
        assert np.allclose(lines.envelope(np.stack([f, f * 0], 1), 0.7)[:, 0], want, rtol=1e-14)


@pytest.mark.parametrize("zooms", [(2, 1, 1, 3), (1, 0.5, 2.5, 3), (1, 2, 0.3, 4), (1, 1, 0.5, 0)])
def test_resize_in_runs(spark, monkeypatch, zooms):
    """One task had a whole volume."""
    from gridloom.plans import blocks

    a = RNG.normal(size=(2, 30, 4, 3))
    monkeypatch.setattr(blocks, "SLAB_VOXELS", 30)
    lat = Lattice.of_numpy(spark, a).resize(*zooms)
    want = a
    for axis, n in ((3, 3), (2, 4), (1, 30)):
        m = lines.resize_matrix(n, math.ceil(n * zooms[3 - axis]), zooms[3]) if zooms[3 - axis] != 1 else np.eye(n)
        want = np.moveaxis(np.tensordot(m, want, axes=(1, axis)), 0, axis)
    assert np.allclose(lat.to_numpy(), want, atol=1e-12) and by_parts(lat)


@pytest.fixture
def thin(monkeypatch):
    """Slabs of three planes, so that components run through many."""
    from gridloom.plans import blocks

    monkeypatch.setattr(blocks, "CHAIN_PLANES", 3)
    monkeypatch.setattr(blocks, "SLAB_VOXELS", 30)


def in_chain(lat):
    """Whether no step sees the voxels of a volume at once."""
    plan = lat.df._jdf.queryExecution().executedPlan().toString()
    return all("b#" in line or "k#" in line for line in plan.splitlines() if "InPandas" in line)


@pytest.mark.parametrize("conn", [6, 18, 26])
def test_labels_through_slabs(spark, thin, conn):
    """One task had a whole volume."""
    m = (RNG.random((2, 20, 5, 4)) < [0.35, 0.2, 0.15][[6, 18, 26].index(conn)]) * 1.0
    m[0, :, 2, 2] = 1.0
    lat = Lattice.of_numpy(spark, m).bwlabel(conn)
    assert np.array_equal(lat.to_numpy(), np.stack([components.label(components.filled(v > 0, 6), conn) for v in m])) and in_chain(lat)


@pytest.mark.parametrize("name,conn,share", [("fillh", 6, 0.7), ("fillh26", 26, 0.92)])
def test_holes_through_slabs(spark, thin, name, conn, share):
    m = (RNG.random((2, 20, 6, 5)) < share) * 1.0
    m[0] = 1.0
    m[0, 1:-1, 2, 2] = 0.0  # a hole through many slabs
    lat = Lattice.of_numpy(spark, m).apply(name)
    want = np.stack([components.filled(v > 0, conn) for v in m])
    assert want[0].all() and np.array_equal(lat.to_numpy(), want) and in_chain(lat)


def plain_tfce(a, h, e, conn):
    """Level by level, as it is defined; also the level and the sum at each."""
    top, out = a.max(), np.zeros(a.shape)
    for k in range(1, 101):
        lab = components.label(a >= k * top / 100, conn)
        size = np.bincount(lab.ravel()).astype(float)
        out += size[lab] ** e * (k * top / 100) ** h * (lab > 0)
        yield k, lab, out


@pytest.mark.parametrize("conn", [6, 26])
def test_tfce_through_slabs(spark, thin, conn):
    a = RNG.normal(size=(2, 20, 5, 4))
    lat = Lattice.of_numpy(spark, a).tfce(2, 0.5, conn)
    want = []
    for v in a:
        *_, (_, _, out) = plain_tfce(v, 2.0, 0.5, conn)
        want.append(out)
    assert np.allclose(lat.to_numpy(), np.stack(want), rtol=1e-12) and in_chain(lat)


@pytest.mark.parametrize("threshold", [0.01, 3.0, 1e6])
def test_support_through_slabs(spark, thin, threshold):
    a = np.abs(RNG.normal(size=(1, 20, 5, 4)))
    a[0, 9, 2, 1] = 2.0
    lat = Lattice.of_numpy(spark, a).tfceS(2, 0.5, 6, 2, 2, 9, threshold)  # x counts from the other side
    want = np.zeros(a.shape[1:])
    for _, lab, out in plain_tfce(a[0], 2.0, 0.5, 6):
        if out[9, 2, 1] >= threshold and lab[9, 2, 1]:
            want = 1.0 * (lab == lab[9, 2, 1])
            break
    assert np.array_equal(lat.to_numpy()[0], want) and (threshold > 1e5 or want.any())


@pytest.mark.parametrize("wall", [1, -1])
def test_hollow_through_slabs(spark, thin, wall):
    a = RNG.normal(size=(2, 20, 6, 5))
    lat = Lattice.of_numpy(spark, a).hollow(-1.2, wall)
    want = []
    for v in a:
        lab = components.label(v >= -1.2, 6)
        d = lines.distance(components.filled(lab == 1 + np.argmax(np.bincount(lab.ravel())[1:]), 6), (1, 1, 1))
        out = np.where(d > 1, v.min(), v)
        z, y, x = np.unravel_index(int(np.argmax(d)), d.shape)
        if wall < 0:
            out[max(0, z - 1) : z + 1, y:, max(0, x - 1) : x + 2] = v.min()
        want.append(out)
    assert np.array_equal(lat.to_numpy(), np.stack(want)) and in_chain(lat)
    for threshold, thick, said in ((99, 1, "no voxel"), (-1.2, 50, "nothing is deeper")):
        with pytest.raises(Exception, match=said):
            Lattice.of_numpy(spark, a).hollow(threshold, thick).to_numpy()


@pytest.mark.parametrize("kernel", [("3D",), ("2D",), ("boxv3", 3, 3, 5)])
def test_dilall_in_rounds(spark, thin, kernel, monkeypatch):
    from gridloom.plans import blocks

    monkeypatch.setattr(blocks, "by_volume", None)
    a = np.where(RNG.random((3, 60, 4, 3)) < 0.02, RNG.normal(size=(3, 60, 4, 3)), 0.0)
    a[1], a[0, 5:] = 0.0, 0.0
    a[0, 0, 0, 0], a[2, 7, 1, 1], a[2, 7, 1, 2] = 1.0, 1.0, -1.0
    start = Lattice.of_numpy(spark, a).kernel(*kernel)
    lat = start.dilall()
    want = a.copy()
    for v in want:
        for _ in range(100):
            v[:] = stencil.dense("dilM", v, stencil.offsets(start))
    assert np.array_equal(lat.to_numpy(), want)


def test_constant_stays_under_smoothing(spark):
    assert np.allclose(Lattice.of_numpy(spark, np.full((9, 9, 9), 3.0)).s(2).to_numpy(), 3.0)


def test_distance_is_exact(cube):
    a, lat = cube
    inside = a > -0.5
    got = lat.add(0.5).edt().to_numpy()[0]
    z, y, x = np.indices(a.shape)
    p = np.stack([z * 3.0, y * 2.0, x * 1.0], -1)
    out = p[~inside]
    want = np.array([0 if not k else np.sqrt(((q - out) ** 2).sum(1).min()) for k, q in zip(inside.ravel(), p.reshape(-1, 3), strict=True)])
    assert np.allclose(got.ravel(), want)


def test_close_covers_input(cube):
    a, lat = cube
    assert (lat.close(0.5, 2, 1).to_numpy()[0] >= a - 1e-9).all()


@pytest.mark.parametrize("conn", [6, 18, 26])
def test_labels(conn):
    m = RNG.random((6, 7, 8)) > 0.6
    lab = components.label(m, conn)
    seen, n = np.zeros(m.shape, int), 0
    offs = [(z, y, x) for z in (-1, 0, 1) for y in (-1, 0, 1) for x in (-1, 0, 1) if 0 < abs(z) + abs(y) + abs(x) <= {6: 1, 18: 2, 26: 3}[conn]]
    for s in zip(*np.nonzero(m), strict=True):
        if seen[s]:
            continue
        n += 1
        todo = [s]
        seen[s] = n
        while todo:
            c = todo.pop()
            for o in offs:
                q = tuple(np.add(c, o))
                if all(0 <= i < k for i, k in zip(q, m.shape, strict=True)) and m[q] and not seen[q]:
                    seen[q] = n
                    todo.append(q)
    assert (lab == seen).all()


def test_contacts_by_connectivity():
    m = np.zeros((4, 4, 4), bool)
    m[0, 0, 0] = m[1, 1, 0] = m[2, 2, 1] = True  # an edge contact, then a corner contact
    assert [components.label(m, c).max() for c in (6, 18, 26)] == [3, 2, 1]


def test_bubble_is_filled(spark):
    a = np.ones((5, 5, 5))
    a[2, 2, 2] = 0
    lat = Lattice.of_numpy(spark, np.pad(a, 1))
    assert lat.fillh().to_numpy().sum() == 125
    assert lat.bwlabel(26).to_numpy().max() == 1


def test_dilall_ends(spark):
    assert np.allclose(Lattice.of_numpy(spark, np.zeros((3, 3, 3))).dilall().to_numpy(), 0)
    a = np.zeros((5, 5, 5))
    a[0, 0, 0] = 4
    assert np.allclose(Lattice.of_numpy(spark, a).dilall().to_numpy(), 4)


def test_time_filters(series):
    a, lat = series
    d = lat.detrend().to_numpy()
    assert np.allclose(d[:, 0, 0, 1], 0) and np.allclose(d[:, 0, 0, 0], 0)
    assert np.allclose(lat.bptf(-1, -1).to_numpy(), a)
    assert np.allclose(lat.bptf(3, 1).to_numpy()[:, 0, 0, 1], 0, atol=1e-9)  # a line is removed wholly
    b = lat.bandpass(0.3, 0.05, 1).to_numpy()
    assert np.allclose(b[:, 0, 0, 0], 0) and abs(b[:, 1, 1, 1]).max() < abs(a).max()
    assert lat.rank().to_numpy()[:, 0, 0, 0].tolist() == list(range(1, 25))


def test_bandpass_in_chunks(spark, monkeypatch):
    """The driver made a matrix of the series' length squared, and tasks had whole series."""
    from gridloom.operators import temporal

    a = RNG.normal(size=(90, 2, 3, 2))
    high, low = temporal.bandpass_weights(90, 2, 0.3)
    h = np.einsum("szyx,st->tzyx", a, high)
    monkeypatch.setattr(temporal, "CHUNK", 8)
    monkeypatch.setattr(temporal, "CHUNK_VALUES", 200)
    lat = Lattice.of_numpy(spark, a)
    assert np.allclose(lat.bptfm(2, 0.3).to_numpy(), np.einsum("szyx,st->tzyx", h, low), atol=1e-12)
    assert np.allclose(lat.bptf(2, 0.3).to_numpy(), np.einsum("szyx,st->tzyx", h - h.mean(axis=0), low), atol=1e-12)
    a[40, 1, 2, 0] = np.nan
    bad = np.isnan(Lattice.of_numpy(spark, a).bptfm(2, 0.3).to_numpy())
    assert bad[:, 1, 2, 0].nonzero()[0].tolist() == list(range(40 - 14, 40 + 15)) and bad.sum() == 29
    seen = []
    monkeypatch.setattr(temporal, "bandpass_weights", lambda n, *_: seen.append(n))
    Lattice.of_numpy(spark, a[:1]).with_df(lat.df, shape=(2, 3, 2, 10**6)).bptf(2, 0.3)
    assert not seen  # none on the driver


def test_butterworth_gain():
    from gridloom.operators.temporal import butterworth

    for low, high, pass_, stop in ((0, 0.2, 0.01, 0.9), (0.4, 0, 0.9, 0.02), (0.2, 0.5, 0.33, 0.01)):
        b, a = butterworth(low, high)
        gain = lambda f, b=b, a=a: abs(np.polyval(b, np.exp(1j * np.pi * f)) / np.polyval(a, np.exp(1j * np.pi * f)))
        assert gain(pass_) > 0.9 and gain(stop) < 0.1
        for corner in (low, high):
            if corner:
                assert abs(gain(corner) - math.sqrt(0.5)) < 1e-6


def test_resize_shrinks(spark):
    lat = Lattice.of_numpy(spark, np.ones((4, 6, 8)))
    out = lat.resize(0.5, 0.5, 1, 1)
    assert out.shape[:3] == (4, 3, 4) and abs(out.to_numpy()[0, 1, 1, 1] - 1) < 1e-9


def test_robust_range_small_is_full(spark):
    lo, hi = robust_range(Lattice.of_numpy(spark, np.arange(8.0).reshape(2, 2, 2))).first()
    assert (lo, hi) == (0, 7)


def test_reslice_identity(cube):
    a, lat = cube
    assert np.allclose(lat.reslice(lat).to_numpy()[0], a) and np.allclose(lat.reslice_nn(lat).to_numpy()[0], a)


def test_ras_keeps_world_positions(spark):
    a = RNG.normal(size=(2, 3, 4))
    m = ((0, -2.0, 0, 5), (0, 0, 3.0, 1), (1.0, 0, 0, 2))
    lat = Lattice.of_numpy(spark, a, affine=m)
    out = lat.ras()
    where = lambda l: {tuple(np.round(np.array(l.affine) @ [r.x, r.y, r.z, 1], 6)): round(r.v, 9) for r in l.df.collect()}  # noqa: E731, E741
    assert where(lat) == where(out)
    assert (np.array(out.affine)[:, :3].diagonal() > 0).all()


def test_registration_finds_a_shift(spark):
    z, y, x = np.indices((16, 16, 16))
    blob = np.exp(-((x - 7) ** 2 + (y - 8) ** 2 + (z - 8) ** 2) / 12.0) * 100
    moved = np.exp(-((x - 9) ** 2 + (y - 8) ** 2 + (z - 7) ** 2) / 12.0) * 100
    out = Lattice.of_numpy(spark, moved).allineate(Lattice.of_numpy(spark, blob), "ls", "shr").to_numpy()[0]
    assert np.corrcoef(out[3:-3, 3:-3, 3:-3].ravel(), blob[3:-3, 3:-3, 3:-3].ravel())[0, 1] > 0.98


def test_tensor_of_known_shape(spark):
    d = tensor.decompose(np.array([[3.0, 0, 0, 2, 0, 1], [1, 0, 0, 1, 0, 1], [-1, 0, 0, -1, 0, -1]]))
    assert np.allclose(d[0, :3], [3, 2, 1]) and abs(d[0, 12] - 2) < 1e-9
    assert d[1, 14] == 0 and d[2, 14] == 0
    g = RNG.normal(size=(3, 12))
    g /= np.linalg.norm(g, axis=0)
    b = np.r_[0, [1000.0] * 12]
    g = np.c_[np.zeros(3), g]
    t = np.array([[1.5, 0.1, 0], [0.1, 0.8, 0.2], [0, 0.2, 0.5]]) * 1e-3
    s = 1000 * np.exp(-b * np.einsum("in,ij,jn->n", g, t, g))
    fit, s0 = tensor.dtifit(Lattice.of_numpy(spark, s.reshape(-1, 1, 1, 1)), b, g, flip_x=False)
    assert np.allclose(fit.to_numpy().ravel(), t[np.triu_indices(3)]) and abs(s0.to_numpy().ravel()[0] - 1000) < 1e-6


def test_compare(cube):
    _, lat = cube
    r = compare(lat, lat).first()
    assert r["same"] == r["voxels"] and r["max_diff"] == 0 and abs(r["r"] - 1) < 1e-9


def test_mesh_of_a_sphere(spark, tmp_path):
    from gridloom.sources import meshes

    z, y, x = np.indices((16, 16, 16))
    a = 6.0 - np.sqrt((x - 7.5) ** 2 + (y - 7.5) ** 2 + (z - 7.5) ** 2)
    v, f = mesh.arrays(*mesh.isosurface(Lattice.of_numpy(spark, a), 0.0))
    edges = np.sort(np.concatenate([f[:, [0, 1]], f[:, [1, 2]], f[:, [2, 0]]]), axis=1)
    assert (np.unique(edges, axis=0, return_counts=True)[1] == 2).all()  # closed
    assert len(v) - len(np.unique(edges, axis=0)) + len(f) == 2  # one sphere
    volume = np.einsum("ij,ij->i", v[f[:, 0]], np.cross(v[f[:, 1]], v[f[:, 2]])).sum() / 6
    assert abs(volume - 4 / 3 * np.pi * 216) / (4 / 3 * np.pi * 216) < 0.05
    v2, f2 = mesh.simplified(v, f, 0.5)
    assert len(f2) <= len(f) * 0.55
    assert np.isfinite(mesh.smoothed(v, f, 3)).all()
    for end in meshes.WRITERS:
        assert meshes.write(str(tmp_path / ("m" + end)), v, f).endswith(end)
    back = meshes.read_mz3(str(tmp_path / "m.mz3"))
    assert np.allclose(back[0], v, atol=1e-5) and (back[1] == f).all()
    assert meshes.write(str(tmp_path / "m.xyz"), v, f).endswith(".mz3")


def test_every_command_is_registered():
    for name in "exp add dilM s bptf tfce edt ras allineate tensor_decomp unifize Tmean Zar1 otsu crop roi".split():
        assert name in REGISTRY
    assert lines.resize_matrix(4, 8, 1).shape == (8, 4)
