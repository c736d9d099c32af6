"""The package source: byte ranges of any size give every line once, notebooks are read cell by cell, suffixes decide."""

import io
import json

import numpy as np
import pytest

from docloom.sources import package as pk


@pytest.mark.parametrize("step", [1, 3, 7, 64, 10_000])
def test_ranges_give_every_line_once(step):
    rng = np.random.default_rng(step)
    text = "\n".join("é" * int(n) for n in rng.integers(0, 20, 60)) + ("\n" if step % 2 else "")
    raw = text.encode()
    got = [r for a in range(0, len(raw), step) for r in pk.lines(io.BytesIO(raw), a, min(a + step, len(raw)))]
    want = text.split("\n")[:-1] if text.endswith("\n") else text.split("\n")
    assert [r[3] for r in got] == want and len({r[1] for r in got}) == len(got)


def test_cells_are_streamed(monkeypatch):
    cells = [{"cell_type": "markdown", "source": ["# a\n", "b"]}, {"cell_type": "code", "source": "x", "outputs": [
        {"output_type": "stream", "text": ["1\n", "2"]}, {"data": {"text/plain": "p", "text/markdown": ["m"], "image/png": "zz"}}]}, {"cell_type": "raw", "source": "r"}, {}]
    raw = json.dumps({"metadata": {"é": 1}, "cells": cells, "nbformat": 4}, ensure_ascii=False).encode()
    want = [(0, 0, "markdown", "# a\nb"), (1, 0, "code", "x"), (1, 1, "text", "1\n2"), (1, 2, "plain", "p"), (1, 3, "markdown_out", "m"), (1, 4, "imagen", None), (2, 0, "otra", "r"), (3, 0, "otra", "")]
    for step in (1, 5, 1 << 20):
        assert list(pk.cells(io.BytesIO(raw), step)) == want
    assert [r[2] for r in pk.cells(io.BytesIO(b"no json"))] == ["error"] and [r[2] for r in pk.cells(io.BytesIO(b'{"cells": [{"a": '))] == ["error"]


def test_package_table(spark, tmp_path):
    (tmp_path / "r1" / "sub").mkdir(parents=True)
    (tmp_path / "r1" / "output").mkdir()
    (tmp_path / "r1" / "a.md").write_text("uno\r\ndos\n\ntres", encoding="utf-8")
    (tmp_path / "r1" / "sub" / "b.txt").write_bytes(b"\xff mal\n")
    (tmp_path / "r1" / "output" / "c.log").write_text("x\n")
    (tmp_path / "r1" / "d.bin").write_bytes(b"zz")
    (tmp_path / "r1" / "empty.md").write_text("")
    (tmp_path / "r1" / "n.ipynb").write_text(json.dumps({"cells": [{"cell_type": "code", "source": "y = 1", "outputs": [{"text": "1"}]}]}))
    r = pk.read_package(spark, str(tmp_path), byte_range=4)
    got = sorted((x["path"], x["pos"], x["campo"], x["texto"]) for x in r.collect())
    assert got == [("r1/a.md", 0, "linea", "uno"), ("r1/a.md", 5, "linea", "dos"), ("r1/a.md", 9, "linea", ""), ("r1/a.md", 10, "linea", "tres"),
                   ("r1/n.ipynb", 0, "code", "y = 1"), ("r1/n.ipynb", 1, "text", "1"), ("r1/output/c.log", 0, "linea", "x"), ("r1/sub/b.txt", 0, "linea", "� mal")]
    assert {x["path"] for x in pk.read_package(spark, str(tmp_path), input_only=True).collect()} == {"r1/a.md", "r1/n.ipynb", "r1/sub/b.txt"}
    assert [x["texto"] for x in pk.deliverable_lines(r, with_outputs=False).where("clase = 'ipynb'").collect()] == []
    files = pk.file_list(spark, str(tmp_path))
    assert {(x["path"], x["bytes"]) for x in files.collect()} >= {("r1/d.bin", 2), ("r1/a.md", 14)}
    best = pk.deliverables(files, r"\.(md|txt)$", pk.F.lit("r1")).first()
    assert best["path"] == "r1/a.md"
    (tmp_path / "none").mkdir()
    assert pk.read_package(spark, str(tmp_path / "none")).count() == 0
