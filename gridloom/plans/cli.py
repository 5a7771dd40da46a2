"""A command line: ``input [-operator arguments ...] output``, read from left to right into one lazy plan."""

from __future__ import annotations

import os
import sys

import numpy as np
from pyspark.sql import SparkSession

from gridloom.lattice import Lattice
from gridloom.operators import REGISTRY, mesh, tensor
from gridloom.operators.components import otsu_threshold
from gridloom.operators.reduce import compare
from gridloom.sources import bitmap, meshes, nifti

#: Operators with arguments, and how many; others have none. ``?`` is a number or an image.
ARGUMENTS = {
    **dict.fromkeys("add sub mul div rem mod power max min thr uthr mas".split(), "?"),
    **dict.fromkeys("thrp thrP uthrp uthrP clamp uclamp inm ing fdr s seed otsu dehaze bwlabel qform sform p robustfov robustv Xperc Yperc Zperc Tperc".split(), 1),
    **dict.fromkeys("grid bptf bptfm crop unsharp dog dogr dogx dogy dogz dilate erode hollow".split(), 2),
    **dict.fromkeys("bandpass close tfce".split(), 3),
    "resize": 4, "roi": 8, "comply": 8, "tfceS": 7, "reslice": "i", "reslice_nn": "i", "reslice_mask": "i", "allineate": "i", "deface": "ii",
}
KERNELS = {"3D": 0, "2D": 0, "box": 1, "boxv": 1, "boxv3": 3, "sphere": 1, "gauss": 1, "file": "i"}


def number(text: str) -> float | None:
    """The number, if the whole text is one."""
    try:
        return float(text)
    except ValueError:
        return None


def options(args: list[str], flags: str = "") -> dict[str, str]:
    """``-a value`` pairs; letters of ``flags`` take no value."""
    out, rest = {}, list(args)
    while rest:
        name = rest.pop(0).lstrip("-")
        out[name] = "1" if name in flags else rest.pop(0)
    return out


def save_mesh(lat: Lattice, args: list[str], path: str) -> str:
    """``-i d|m|b|number``: iso from Otsu classes or a number; ``-p`` smooth first, ``-r`` keep a share, ``-s`` rounds of smoothing."""
    o = options(args)
    iso = o.get("i", "m")
    if o.get("p", "1") != "0":
        lat = lat.apply("s", -0.5)
    level = number(iso)
    if level is None:
        level = otsu_threshold(lat, {"d": 5, "m": 3, "b": 1}[iso])
    v, f = mesh.arrays(*mesh.isosurface(lat, level))
    if int(o.get("s", 0)):
        v = mesh.smoothed(v, f, int(o["s"]))
    if float(o.get("r", 1)) < 1:
        v, f = mesh.simplified(v, f, float(o["r"]))
    return meshes.write(path, v, f)


def save_tensors(spark: SparkSession, args: list[str]) -> None:
    """``-k image -r bvec -b bval -o base [-m mask]``: writes every part of the fit."""
    o = options(args)
    numbers = lambda path: np.array(nifti.open_bytes(path).decode().split(), float)
    b = numbers(o["b"])
    fit, s0 = tensor.dtifit(nifti.read(spark, o["k"]), b, numbers(o["r"]).reshape(3, len(b)), nifti.read(spark, o["m"]) if "m" in o else None)
    parts = tensor.parts(fit)
    for name in ("FA", "MD", "MO", "L1", "L2", "L3"):
        nifti.write(tensor.part(parts, name), f"{o['o']}_{name}.nii.gz")
    for k in (1, 2, 3):
        at = tensor.PARTS.index(f"V{k}x")
        nifti.write(parts.apply("crop", at, 3), f"{o['o']}_V{k}.nii.gz")
    nifti.write(s0, f"{o['o']}_S0.nii.gz")
    nifti.write(fit, f"{o['o']}_tensor.nii.gz")


def run(spark: SparkSession, argv: list[str]) -> Lattice | None:
    """Run a command; returns the image that is written, or None for reports."""
    args = list(argv)
    dtype = "float"
    if args[:1] == ["--dtifit"]:
        save_tensors(spark, args[1:])
        return None
    if len(args) > 1 and args[0].endswith(".mz3"):
        v, f = meshes.read_mz3(args[0])
        meshes.write(args[-1], *mesh.simplified(v, f, float(options(args[1:-1], "v").get("r", 0.25))))
        return None
    if args[:1] == ["-dt"]:
        if args[1] not in ("float", "double"):
            raise ValueError("-dt takes float or double")
        dtype, args = args[1], args[2:]
    if not args:
        raise ValueError("usage: input [-operator arguments ...] output")
    source = args.pop(0)
    if not args:
        for k, v in nifti.read_header(source).items():
            print(f"{k}: {v}")
        return None
    load = lambda path: nifti.read(spark, path, dtype)
    lat, kind, gz = load(source), "float" if dtype == "float" else "double", None
    output = args.pop()
    if len(args) >= 2 and args[-2] == "-odt":
        kind, args = args[-1], args[:-2]
    while args:
        name = args.pop(0).lstrip("-")
        if name == "compare":
            print(compare(lat, load(output)).first().asDict())
            return None
        if name == "mesh":
            save_mesh(lat, args, output)
            return None
        if name == "bitmap":
            o = options(args, "abnNuf")
            bitmap.bitmap(lat, output, {c: [float(k) for k in o[c].split(",")] for c in "xyz" if c in o} or None, o.get("c", "gray"), zoom=int(o.get("s", 1)))
            return None
        if name == "kernel":
            shape = args.pop(0)
            n = KERNELS.get(shape, 0)
            lat = lat.apply("kernel", shape, *([load(args.pop(0))] if n == "i" else [args.pop(0) for _ in range(n)]))
        elif name == "save":
            nifti.write(lat, args.pop(0), kind)
        elif name == "restart":
            lat = load(args.pop(0))
        elif name == "gz":
            gz = int(args.pop(0))
        elif name in REGISTRY:
            n = ARGUMENTS.get(name, 0)
            if n == "?":
                text = args.pop(0)
                value = number(text)
                lat = lat.apply(name, load(text) if value is None else value)
            elif isinstance(n, str):
                lat = lat.apply(name, *(load(args.pop(0)) for _ in n))
            else:
                lat = lat.apply(name, *(args.pop(0) for _ in range(n)))
        else:
            raise ValueError(f"unknown operator -{name}")
    path, version = nifti.output_path(output, os.environ.get("FSLOUTPUTTYPE"), gz)
    nifti.write(lat, path, {"flt": "float"}.get(kind, kind), version)
    return lat


def main() -> int:
    run(SparkSession.builder.getOrCreate(), sys.argv[1:])
    return 0


if __name__ == "__main__":
    sys.exit(main())
