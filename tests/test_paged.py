from __future__ import annotations

import json
from pathlib import Path

import pytest
from prismlake.sources import paged, server


def land(path, sizes, first=0):
    n = 0
    path.mkdir(exist_ok=True)
    for page, size in enumerate(sizes, first):
        (path / f"page_{page}.json").write_text(json.dumps({"assets": {"items": [{"id": f"x{n + i}", "type": "IMAGE", "people": [{"id": "u", "name": "Zoé"}]} for i in range(size)]}}))
        n += size


@pytest.mark.parametrize("full", [0, 1, 2, 3, 4, 7, 8, 9, 33])
@pytest.mark.parametrize("rest", [0, 2])
def test_the_end_of_a_listing_is_found_by_few_pages(tmp_path, full, rest):
    land(tmp_path / "p", [3] * full + ([rest] if rest else []))
    land(tmp_path / "p", [3, 3], 500)
    reader = paged.PageReader(str(tmp_path / "p"), 3, 4)
    asked = []
    fetch = reader.fetch
    reader.fetch = lambda page: asked.append(page) or fetch(page)
    assert reader.last() == full and len(asked) <= 2 * (full + 2).bit_length() + 1
    ranges = [(p.first, p.end) for p in reader.partitions()]
    assert ranges[0][0] == 0 and ranges[-1][1] == full + 1 and all(a[1] == b[0] for a, b in zip(ranges, ranges[1:]))


def test_pages_are_read_in_ranges_and_tried_again_each_on_its_own(spark, tmp_path):
    land(tmp_path / "p", [3] * 9 + [1])
    calls = tmp_path / "calls"
    calls.mkdir()

    class Shaky(paged.PageReader):
        def fetch(self, page):
            n = len(list(Path(calls).glob(f"{page}.*")))
            (Path(calls) / f"{page}.{n}").write_text("")
            if page % 3 == 2 and n < 2:
                raise OSError("away")
            return super().fetch(page)

    class Source(paged.AssetPages):
        reader_of = Shaky

    found = paged.items(spark, str(tmp_path / "p"), 3, Source)
    assert found.rdd.getNumPartitions() == 1 and paged.AssetPages({"path": "x", "pages": "4"}).reader(None).pages == 4
    rows = found.orderBy("page", "place").collect()
    assert [r.id for r in rows] == [f"x{i}" for i in range(28)] and rows[0].people[0].name == "Zoé"
    assert len(list(calls.glob("2.*"))) >= 3 and server.scan_items(found, limit=5).count() == 5

    class Away(paged.PageReader):
        def fetch(self, page):
            raise OSError("away")

    Source.reader_of = Away
    with pytest.raises(Exception, match="away"):
        paged.items(spark, str(tmp_path / "p"), 3, Source).count()


def test_a_page_is_landed_whole(spark, tmp_path):
    pages = spark.createDataFrame([(i, ([(f"x{i}",)],)) for i in range(5)], "page long, assets struct<items:array<struct<id:string>>>")
    for _ in range(2):
        paged.land_pages(pages, str(tmp_path / "p"))
    assert sorted(p.name for p in (tmp_path / "p").iterdir() if not p.name.startswith(".")) == [f"page_{i}.json" for i in range(5)]
    assert [r.id for r in paged.items(spark, str(tmp_path / "p"), 1).orderBy("page").collect()] == [f"x{i}" for i in range(5)]
