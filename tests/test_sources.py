"""Image files, the command line, pictures and streams."""

import struct

import numpy as np
import pytest

from gridloom.lattice import Lattice
from gridloom.plans import cli
from gridloom.sources import bitmap, nifti

A = np.random.default_rng(1).normal(size=(3, 4, 5, 6)).round(3)


def image(spark, **more):
    return Lattice.of_numpy(spark, A, pix=(2.0, 2.0, 2.5, 1.0), affine=((-2.0, 0, 0, 9), (0, 2.0, 0, -7), (0, 0, 2.5, 3)), **more)


@pytest.mark.parametrize("end", [".nii", ".nii.gz", ".nii.zst", ".hdr"])
@pytest.mark.parametrize("version", [1, 2])
def test_round_trip(spark, tmp_path, end, version):
    if end == ".hdr" and version == 2:
        pytest.skip("pairs are written in the first version")
    path = str(tmp_path / ("i" + end))
    nifti.write(image(spark), path, "double", version)
    back = nifti.read(spark, path)
    assert back.shape == (6, 5, 4, 3) and back.affine == image(spark).affine and np.allclose(back.pix, (2, 2, 2.5, 1))
    assert np.array_equal(back.to_numpy(), A) and back.negative


def test_big_endian_scaled_integers(spark, tmp_path):
    b = bytearray(nifti.encode(A * 0 + np.arange(6), image(spark), "short", order=">"))
    struct.pack_into(">ff", b, 112, 0.5, -10.0)
    p = tmp_path / "be.nii"
    p.write_bytes(bytes(b))
    assert np.allclose(nifti.read(spark, str(p)).to_numpy()[0, 0, 0], np.arange(6) * 0.5 - 10)


def test_saturating_output(spark, tmp_path):
    p = str(tmp_path / "c.nii")
    nifti.write(image(spark).mul(1000), p, "char")
    got = nifti.read(spark, p).to_numpy()
    assert got.min() == 0 and got.max() == 255


def test_short_and_foreign_files_are_refused(spark, tmp_path):
    p = tmp_path / "s.nii"
    p.write_bytes(nifti.encode(A, image(spark), "float")[:-8])
    with pytest.raises(Exception, match="shorter"):
        nifti.read(spark, str(p)).to_numpy()
    (tmp_path / "x.nii").write_bytes(b"\0" * 600)
    with pytest.raises(ValueError):
        nifti.read(spark, str(tmp_path / "x.nii"))


def test_partitions_read_planes(spark, tmp_path):
    p = str(tmp_path / "p.nii")
    nifti.write(image(spark), p, "double")
    parts = nifti.NiftiReader({"path": p, "voxelsPerPartition": "60"}).partitions()
    assert len(parts) == 6 and sum(x.last - x.first for x in parts) == 12


def test_command_line(spark, tmp_path, monkeypatch):
    src, out = str(tmp_path / "a.nii"), str(tmp_path / "b.nii")
    nifti.write(image(spark), src, "double")
    cli.run(spark, ["-dt", "double", src, "-add", "10", "-mul", src, "-Tmean", out, "-odt", "float"][:-2])
    assert np.allclose(nifti.read(spark, out).to_numpy()[0], ((A + 10) * A).mean(axis=0))
    cli.run(spark, [src, "-kernel", "boxv", "3", "-dilM", "-thr", "0", out, "-odt", "short"][:-2] + [])
    assert cli.run(spark, [src]) is None
    with pytest.raises(ValueError):
        cli.run(spark, [src, "-nonsense", out])
    monkeypatch.setenv("FSLOUTPUTTYPE", "NIFTI")
    cli.run(spark, [src, "-abs", str(tmp_path / "c")])
    assert (tmp_path / "c.nii").exists()
    assert cli.number("4d") is None and cli.number("1e3") == 1000


def test_terminal_commands(spark, tmp_path, capsys):
    from gridloom.sources import meshes

    z, y, x = np.indices((10, 10, 10))
    ball = 4.0 - np.sqrt((x - 4.5) ** 2 + (y - 4.5) ** 2 + (z - 4.5) ** 2)
    src = str(tmp_path / "ball.nii")
    nifti.write(Lattice.of_numpy(spark, ball), src, "float")
    cli.run(spark, [src, "-mesh", "-i", "0", "-p", "0", "-r", "0.5", str(tmp_path / "b.mz3")])
    n = len(meshes.read_mz3(str(tmp_path / "b.mz3"))[1])
    cli.run(spark, [str(tmp_path / "b.mz3"), "-r", "0.5", str(tmp_path / "c.mz3")])
    assert len(meshes.read_mz3(str(tmp_path / "c.mz3"))[1]) < n
    cli.run(spark, [src, "-bitmap", "-z", "0.5", "-c", "viridis", str(tmp_path / "b.png")])
    assert (tmp_path / "b.png").read_bytes()[:4] == b"\x89PNG"
    cli.run(spark, [src, "--compare", src])
    assert "'max_diff': 0.0" in capsys.readouterr().out
    b = [0.0] + [1000.0] * 7
    g = np.random.default_rng(2).normal(size=(3, 8))
    g /= np.linalg.norm(g, axis=0)
    g[:, 0] = 0
    (tmp_path / "b.bval").write_text(" ".join(map(str, b)))
    (tmp_path / "b.bvec").write_text("\n".join(" ".join(map(str, r)) for r in g))
    nifti.write(Lattice.of_numpy(spark, np.full((8, 2, 2, 2), 500.0) * np.exp(-np.array(b) * 1e-3)[:, None, None, None]), src, "double")
    cli.run(spark, ["--dtifit", "-k", src, "-r", str(tmp_path / "b.bvec"), "-b", str(tmp_path / "b.bval"), "-o", str(tmp_path / "d")])
    assert np.allclose(nifti.read(spark, str(tmp_path / "d_MD.nii.gz")).to_numpy(), 1e-3, atol=1e-6)


def test_bitmap(spark, tmp_path):
    lat = image(spark)
    data = bitmap.bitmap(lat, str(tmp_path / "a.png"), {"z": [0.2, 0.8]}, "viridis", overlay=lat)
    assert data[:8] == b"\x89PNG\r\n\x1a\n" and struct.unpack(">II", data[16:24]) == (12, 5)
    for name in bitmap.TABLES:
        assert bitmap.table(name).shape == (256, 3)


def test_stream_of_voxels(spark, tmp_path):
    from gridloom.streaming.rows import pointwise

    lat = image(spark)
    lat.df.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(lat.df.schema).parquet(str(tmp_path / "in"))
    q = pointwise(stream, lat.shape, ("mul", 2), ("thr", 0)).writeStream.format("memory").queryName("voxels").start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("voxels").count() == A.size and spark.table("voxels").agg({"v": "min"}).first()[0] >= 0


def test_runs_of_a_file(spark, monkeypatch, tmp_path):
    """The whole image went through the driver."""
    from gridloom.lattice import Lattice

    monkeypatch.setattr(nifti, "RUN", 7)
    a = np.random.default_rng(2).normal(size=(3, 4, 2, 5)) * 100
    a[1, 2] = np.nan
    lat = Lattice.of_numpy(spark, a)
    for kind in ("double", "short"):
        head = nifti.parse_header(nifti.header_bytes(lat, kind)[:348])
        whole = nifti.encode(a, lat, kind)
        runs = nifti.encoded(lat, kind)
        assert b"".join(bytes(r["data"]) for r in runs.orderBy("run").collect()) == whole[352:]
        monkeypatch.setattr(Lattice, "to_numpy", None)
        back = {tuple(r)[:4]: r["v"] for r in nifti.decoded(runs, head).collect()}
        nifti.write(lat.with_df(lat.df.where("t <> 1 or z <> 0")), str(tmp_path / "a.nii"), kind)
        monkeypatch.undo()
        monkeypatch.setattr(nifti, "RUN", 7)
        assert len(back) == a.size and all(np.array_equal(v, nifti.scaled(whole[352:], head).reshape(a.shape)[k], equal_nan=True) for k, v in back.items())
        gap = a.copy()
        gap[1, 0] = np.nan
        assert (tmp_path / "a.nii").read_bytes() == nifti.encode(gap, lat, kind)
    long = lat.with_df(lat.df, shape=(5, 2, 4, 40_000))
    assert nifti.geometry(nifti.parse_header(nifti.header_bytes(long, "double", nifti.least_version(long))))[0] == long.shape
