"""Sources of rasters and the search session."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from inkwell.functions import kernels as K
from inkwell.operators.search import template_from_region
from inkwell.session import SearchSession, Settings
from inkwell.sources import rasters as R
from inkwell.sources.bridge import glyph_raster, rasters


def test_settings(tmp_path):
    f = tmp_path / "s.json"
    assert Settings.load(f) == Settings()
    for text in ("nonsense", "[]", '{"index_max_mb": 3, "release_after_min": 7}', '{"index_max_mb": true}'):
        f.write_text(text)
        assert Settings.load(f) == Settings()
    assert Settings(300, 60).save(f) and Settings.load(f) == Settings(300, 60)


def test_rgba_pages(spark):
    m = np.zeros((2, 3, 4), np.uint8)
    m[..., 3] = 255
    m[0] = 255
    m[1, 2, 3] = 10
    df = spark.createDataFrame([(1, 3, 2, bytearray(m.tobytes())), (2, 3, 2, bytearray(b"x")), (3, None, 2, None)], "page long, w int, h int, rgba binary")
    rows = R.from_rgba(df).collect()
    assert [(r.page, bytes(r.bits)) for r in rows] == [(1, bytes([0, 0, 0, 1, 1, 0]))]


def test_image_files(spark, tmp_path):
    ppm = lambda px: b"P6\n3 1\n255\n" + bytes(px)
    import struct
    import zlib

    def png(px):
        chunk = lambda t, d: struct.pack(">I", len(d)) + t + d + struct.pack(">I", zlib.crc32(t + d))
        return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", 3, 1, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(b"\0" + bytes(px))) + chunk(b"IEND", b"")

    (tmp_path / "page-7.png").write_bytes(png([0, 0, 0, 255, 0, 0, 255, 255, 255]))
    (tmp_path / "page-8.png").write_bytes(png([0, 0, 255, 255, 255, 0, 200, 200, 200]))
    (tmp_path / "note-9.png").write_bytes(ppm([0] * 9)[:5])
    got = {r.page: list(r.bits) for r in R.from_image_files(spark, f"{tmp_path}").collect()}
    assert got == {7: [1, 1, 0], 8: [1, 0, 0]}  # pure red and blue are dark enough


def test_session(spark, tmp_path):
    session = SearchSession(spark)
    with pytest.raises(ValueError):
        session.search(None)
    texts = spark.createDataFrame([(1, "abca"), (2, "bb"), (3, "ha a")], "id long, t string")
    session.bind(rasters(texts, "id", "t", True))
    with pytest.raises(ValueError):
        session.search(K.prepare_template(np.zeros((2, 2), np.uint8)))
    t = template_from_region(glyph_raster("a"), 0, 0, 20, 28)
    every = session.search(t)
    assert every.count() >= session.shown().count() == 4
    assert [session.step(1), session.step(1), session.step(1), session.step(1), session.step(-1)] == [1, 2, 3, 0, 3]
    session.set_min_score(2)
    assert session.min_score == 0.9
    session.save_results(f"{tmp_path}/r")
    assert spark.read.parquet(f"{tmp_path}/r").count() == 4
    only = spark.createDataFrame([(3,)], "page long")
    assert {r.page for r in session.search(t, only).collect()} == {3}
    session.bind(session.images)
    assert session.matches is None


def test_settings_of_tables_and_files_agree(spark, tmp_path):
    """The column expression and the loader read the same of any saved text."""
    import json

    from inkwell.session import Settings, settings_of

    values = [None, 50, 49.9, 250, 1e9, -5, "300", True, [1], {"a": 1}]
    saved = [json.dumps({"index_max_mb": v, "release_after_min": m}) for v in values for m in (None, 5, 15.0, 16, "30", False)]
    saved += ["", "no json", "[]", "{}", "null", '{"index_max_mb": 99', '{"index_max_mb": Infinity}', '{"other": 1}']
    rows = spark.createDataFrame([(k, t) for k, t in enumerate(saved)], "k long, saved string").select("k", *settings_of(F.col("saved"))).collect()
    for r in rows:
        path = tmp_path / f"{r.k}.json"
        path.write_text(saved[r.k])
        want = Settings.load(path)
        assert (r.index_max_mb, r.release_after_min) == (float(want.index_max_mb), float(want.release_after_min)), saved[r.k]
    assert len({r.index_max_mb for r in rows}) > 2 and len({r.release_after_min for r in rows}) > 2
