import dataclasses

import pytest
from pyspark.sql import functions as F

from leafpress.operators import activity as A
from leafpress.plans import office_bytes as W
from leafpress.sources import readers as R
from leafpress.sources import scan as S


@pytest.fixture
def folder(tmp_path):
    files = {
        "a.txt": "第一行\n\n第二行".encode("gb18030"), "sub/b.md": b"\xef\xbb\xbf# T\n", "c.xlsx": W.xlsx([("s", [[1, "x"]], [])]),
        "d.docx": b"broken", "e.xlsx": R.office.OLE + b"x", "f.zip": b"PK", "~$a.docx": b"", ".hidden.txt": b"h", "g.tmp": b"",
        "_h.txt": b"h", "big.txt": b"x" * 3000, "p.pdf": b"%PDF"
    }
    for name, data in files.items():
        p = tmp_path / name
        p.parent.mkdir(exist_ok=True)
        p.write_bytes(data)
    return str(tmp_path)


def test_refs(spark, folder):
    claimed = spark.createDataFrame([(e,) for e in R.extensions()], "extension string")
    names = lambda files: [r["relative_path"] for r in S.refs(files, folder, claimed).collect()]
    assert names(S.list_local(spark, folder)) == ["_h.txt", "a.txt", "big.txt", "c.xlsx", "d.docx", "e.xlsx", "p.pdf", "sub/b.md"]
    assert names(S.list_files(spark, folder)) == ["a.txt", "big.txt", "c.xlsx", "d.docx", "e.xlsx", "p.pdf", "sub/b.md"]
    row = S.refs(S.list_files(spark, folder), folder, claimed).first()
    assert row["artifact_id"].startswith("a_") and len(row["artifact_id"]) == 18 and row["workspace_id"].startswith("ws_") and row["size"] > 0


def test_scan(spark, folder):
    got = {r["name"]: r for r in R.scan(spark, folder, max_bytes=2000).collect()}
    assert got["a.txt"]["content"] == "第一行\n\n第二行" and got["a.txt"]["line_count"] == 3 and got["a.txt"]["provider_id"] == "text.read"
    assert got["b.md"]["content"] == "# T" and got["c.xlsx"]["blocks"][0]["grid"] == [["1", "x"]]
    errors = {k: v["error_type"] for k, v in got.items() if v["status"] != "ok"}
    assert errors == {
        "d.docx": "ArtifactParseError", "e.xlsx": "EncryptedArtifactError", "big.txt": "ArtifactTooLargeError",
        "p.pdf": "ArtifactParseError"
    }
    records = R.cell_records(R.scan(spark, folder)).select("address", F.expr("try_variant_get(value, '$', 'string')").alias("v")).collect()
    assert {(r["address"], r["v"]) for r in records} == {("A1", "1"), ("B1", "x")}


def test_fallback_and_permissions(spark):
    def bad(data):
        raise KeyError("no")

    files = spark.createDataFrame([("/ws/a.txt", b"hello"), ("/ws/b.md", b"x")], "path string, content binary")
    specs = [
        R.ReaderSpec("x.read", ("txt",), bad, priority=200),
        R.ReaderSpec("n.read", ("md",), R.read_markdown, priority=200, required=("network",)), *R.defaults()
    ]
    got = {r["name"]: r for r in R.read(files, readers=specs).collect()}
    assert (got["a.txt"]["provider_id"], got["a.txt"]["fallback_from"]) == ("text.read", "x.read")
    assert (got["b.md"]["provider_id"], got["b.md"]["error_type"]) == (None, "PluginPermissionError")
    assert R.read(files, readers=specs, granted=("filesystem.read", "network")).where("name = 'b.md'").first()["provider_id"] == "n.read"


def test_registry():
    spec = R.ReaderSpec("new.read", ("zzz",), R.read_text)
    R.register(spec)
    try:
        with pytest.raises(ValueError):
            R.register(dataclasses.replace(spec, priority=1))
        assert [s.provider_id for s in R.chain(".ZZZ", R.registry())] == ["new.read"]
    finally:
        R.reset()
    assert R.chain("zzz", R.registry()) == []


def test_search_is_literal(spark):
    files = spark.createDataFrame(
        [("1", "a%b.txt", "a%b.txt", "txt"), ("2", "axb.txt", "axb.txt", "txt")],
        "artifact_id string, name string, relative_path string, extension string"
    )
    assert [r["key"] for r in A.search("A%B", files=files).collect()] == ["1"]
    assert A.search("  ", files=files).count() == 0


def test_pinned_stay(spark):
    opens = spark.createDataFrame([(f"/w{k}", k) for k in range(5)], "workspace_key string, opened_at int")
    got = lambda pins: [
        r["workspace_key"]
        for r in A.recent_workspaces(
            opens, spark.createDataFrame([(p,) for p in pins], "workspace_key string"), 3
        ).orderBy("position").collect()
    ]
    assert got([]) == ["/w4", "/w3", "/w2"] and got(["/w0"]) == ["/w0", "/w4", "/w3", "/w2"]


def test_availability():
    from leafpress.operators.runtime import unavailable_here as why

    assert why([], ">=3.10", version=(3, 13, 0)) == why(None, "~=3.9") == why(
        ["Linux"], None, platform="linux"
    ) == why(["windows"], "", platform="win32") == ""
    assert "platform" in why(
        ["windows"], None, platform="linux"
    ) and "python" in why([], ">=3.13.1", version=(3, 13, 0)) and why([], ">=3.13", version=(3, 13, 0)) == ""
