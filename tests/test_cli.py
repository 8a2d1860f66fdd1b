"""The command line over a small source: build with places, suggest, search with filters."""

import json

from convolens.cli import main
from convolens.schemas import REQUIRED, SCHEMAS
from tests.test_image_places import GAZETTEER, jpeg

APPLE = 978_307_200  # seconds from 1970 to the epoch of the source's nanoseconds


def test_build_suggest_search(spark, tmp_path, capsys):
    day = lambda d: (1_700_000_000 + d * 86_400 - APPLE) * 10**9
    said = [(1, "the lease is signed", day(0), 0, 1), (2, "lease photos", day(1), 0, 2), (3, "my own lease", day(40), 1, 0)]
    tables = {
        "message": [(i, t, None, d, 0, 0, me, h, 0) for i, t, d, me, h in said], "chat": [(1, 45), (2, 43)], "chat_message_join": [(1, 1), (2, 2), (2, 3)], "chat_handle_join": [(1, 1), (2, 1), (2, 2)],
        "handle": [(1, "+15551234567"), (2, "kit@x.org")], "attachment": [(7, "~/a.jpg")], "message_attachment_join": [(2, 7)],
    }
    for name in REQUIRED:
        spark.createDataFrame(tables[name], SCHEMAS[name]).write.parquet(f"{tmp_path}/src/{name}.parquet")
    spark.createDataFrame(GAZETTEER, "lat double, lon double, city string, admin string, country_code string").write.parquet(f"{tmp_path}/places")
    spark.createDataFrame([("c1", "Noor Haddad", ["+15551234567"])], SCHEMAS["contacts"]).write.parquet(f"{tmp_path}/contacts")
    (tmp_path / "a.jpg").write_bytes(jpeg(38.7, -9.1))
    run = lambda verb, *more: (main([verb, f"{tmp_path}/src", f"{tmp_path}/index", "--contacts", f"{tmp_path}/contacts", *more]), capsys.readouterr().out)[1]

    assert run("build", "--places", f"{tmp_path}/places", "--home", str(tmp_path)).startswith("v=")
    assert "lease photos" in run("search", "lisbon")
    out = run("suggest", "noor had")
    assert "Noor Haddad" in out and "kit@x.org" in out, out
    assert "Noor Haddad" not in run("suggest", "haddad zz")
    assert "the lease is signed" in run("search", "lease", "--chat", "1")
    hits = [h["message_id"] for line in run("search", "lease", "--before", "2023-12-01", "--chat", "2").splitlines() for h in json.loads(line)["hits"]]
    assert hits == [2]  # the later message is context
