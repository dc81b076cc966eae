"""Collections read in blocks of any size have the rows of those read whole."""

from __future__ import annotations

import json
import random

import pytest

from lodestone.sources import layers, split_geojson


def tricky(rng: random.Random, i: int) -> dict:
    text = "".join(rng.choice(['"', "\\", "{", "}", "[", "]", ",", ":", "é", "水", " ", "\n", "a"]) for _ in range(rng.randrange(12)))
    place = {"type": "Point", "coordinates": [i / 8, rng.randrange(80)]} if i % 5 else {"type": "Polygon", "coordinates": [[[0, 0], [1, 0], [1, 1], [0, 0]]]}
    return {"type": "Feature", "id": str(i), "properties": {"name": text, '{"': '}"', "n": str(i)}, "geometry": place if i % 7 else None}


def plain(df):
    return sorted((r._source, r._src_index, r.epsg, r.id, r.geometry, sorted((r.properties or {}).items())) for r in df.collect())


@pytest.fixture
def folder(tmp_path):
    rng = random.Random(5)
    crs = {"type": "name", "properties": {"name": "EPSG:3857"}}
    many = [tricky(rng, i) for i in range(60)]
    (tmp_path / "a.json").write_text(json.dumps({"type": "FeatureCollection", "name": 'a "{[', "features": many}))
    (tmp_path / "b.json").write_text(json.dumps({"type": "FeatureCollection", "crs": crs, "features": many}, indent=3, ensure_ascii=False) + "\n\n")
    (tmp_path / "c.json").write_text(json.dumps({"features": many[:9], "crs": crs, "type": "FeatureCollection"}, separators=(",", ":"), ensure_ascii=False))
    (tmp_path / "d.json").write_text('{"type": "FeatureCollection", "features": []}')
    return str(tmp_path)


@pytest.mark.parametrize("size", [1500, 1 << 27])
def test_blocks_of_any_size(spark, folder, size):
    want = plain(layers.read_geojson(spark, folder))
    assert len(want) == 129
    keys = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    old = {k: spark.conf.get(k) for k in keys}
    spark.conf.set(keys[0], str(size))
    spark.conf.set(keys[1], "0")
    try:
        got = plain(layers.read_geojson_split(spark, folder))
    finally:
        for k in keys:
            spark.conf.set(k, old[k])
    assert got == want


def test_blocks_by_hand():
    """Every way to cut a text behind closing braces gives the same features."""
    import pandas as pd

    rng = random.Random(3)
    text = json.dumps({"type": "FeatureCollection", "crs": {"properties": {"name": "x"}}, "features": [tricky(rng, i) for i in range(8)]}, ensure_ascii=False).encode()
    ends = [i + 1 for i, c in enumerate(text) if c == 125]
    for _ in range(200):
        cuts = sorted(rng.sample(ends[:-1], rng.randrange(len(ends) // 2)))
        parts = [text[a:b] for a, b in zip([0, *cuts], [*cuts, len(text)])]
        batch = pd.DataFrame([("f", n, piece) for n, part in enumerate(parts) for piece in part.split(b"}")[:-1]], columns=["_source", "block", "value"])

        class Pieces:
            def mapInPandas(self, f, schema):
                self.rows = pd.concat(f(iter([batch])))
                return self

            def collect(self):
                return list(self.rows.rename(columns={"_source": "s"}).assign(_source="f").apply(lambda r: type("Row", (), {**r.to_dict(), "_source": "f"}), axis=1))

        rows = pd.concat(split_geojson._cut(split_geojson.begins(Pieces()))(iter([batch])))
        found = rows[rows.n >= 0].sort_values(["n", "block"]).groupby("n").value.agg(b"".join)
        assert [json.loads(x)["id"] for x in found] == [str(i) for i in range(8)]
        assert json.loads(b"".join(rows[rows.n < 0].sort_values("block").value))["features"] == []


def test_errors(spark, tmp_path):
    (tmp_path / "x.json").write_text('{"type": "Topology", "features": [{"id": "1"}]}')
    with pytest.raises(ValueError, match="no feature collection"):
        layers.read_geojson_split(spark, str(tmp_path))
    (tmp_path / "y.json").write_text("")
    with pytest.raises(ValueError, match="empty"):
        layers.read_geojson_split(spark, str(tmp_path))
