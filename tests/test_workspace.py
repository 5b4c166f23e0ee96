import hashlib
import json

import pytest

from leafpress.operators import answers, settings
from leafpress.operators import context as C
from leafpress.plans import office_bytes as W
from leafpress.streaming import watch
from leafpress.workspace import Workspace, WorkspaceBoundaryError


@pytest.fixture
def folder(tmp_path):
    root = tmp_path / "ws"
    (root / "sub").mkdir(parents=True)
    (root / "a.txt").write_text("流动性\n久期")
    (root / "sub/t.xlsx").write_bytes(W.xlsx([("资产负债表", [["科目", "期初", "期末"], ["营业收入", 1200, 1500], ["a|b", None, 2]], [])]))
    (root / "p.pptx").write_bytes(W.pptx([W.shape("当前面临的问题", "title") + W.shape("问题一\n问题二\n问题三")]))
    (root / "d.docx").write_bytes(W.docx(W.paragraph("2.2 审批流程", "H2") + W.paragraph("运营部")))
    return root


def test_contexts_hold_the_facts(spark, folder):
    ws = Workspace(spark, str(folder))
    got = {r["context"].split("\n")[1].removeprefix("Name: "): r["context"] for r in ws.contexts().collect()}
    assert "| 营业收入 | 1200 | 1500 |" in got["t.xlsx"] and "| a\\|b |  | 2 |" in got["t.xlsx"] and "[Table 3x3 | sheet=资产负债表 range=A1:C3]" in got["t.xlsx"] and "Relative Path: sub/t.xlsx" in got["t.xlsx"]
    assert "[Slide 1] 当前面临的问题" in got["p.pptx"] and "问题三" in got["p.pptx"]
    assert "[Heading 2] 2.2 审批流程" in got["d.docx"] and "[Paragraph] 运营部" in got["d.docx"]
    assert "[Paragraph] 流动性\n[Paragraph] 久期" in got["a.txt"] and str(folder) not in got["a.txt"]


def test_ask(spark, folder):
    ws = Workspace(spark, str(folder))
    assert {r["answer"] for r in ws.ask("?", answers.FixedReply("yes"), C.Policy(max_chars=300)).collect()} == {"yes"}
    failed = ws.ask("?", answers.ChatClient("http://127.0.0.1:9", "m", timeout=1)).collect()
    assert all(r["answer"] is None and r["error"] for r in failed)


def test_boundary(spark, folder, tmp_path):
    (tmp_path / "secret.txt").write_text("x")
    (folder / "link.txt").symlink_to(tmp_path / "secret.txt")
    ws = Workspace(spark, str(folder))
    for path in ("../secret.txt", "link.txt", "/etc/passwd"):
        with pytest.raises(WorkspaceBoundaryError):
            ws.resolve(path)
    assert ws.read("a.txt").first()["n_blocks"] == 2
    assert [r["relative_path"] for r in ws.refs().collect() if r["name"] != "link.txt"] == ["a.txt", "d.docx", "p.pptx", "sub/t.xlsx"]
    with pytest.raises(FileNotFoundError):
        Workspace(spark, str(folder / "none"))
    with pytest.raises(NotADirectoryError):
        Workspace(spark, str(folder / "a.txt"))


def test_stream(spark, folder, tmp_path):
    query = watch.artifacts(spark, str(folder)).select("name", "status", "n_blocks").writeStream.format("memory").queryName("watched").option(
        "checkpointLocation", str(tmp_path / "ck")
    ).trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert {r["name"] for r in spark.sql("select * from watched where status = 'ok'").collect()} == {"a.txt", "t.xlsx", "p.pptx", "d.docx"}


def test_stream_does_not_read_large_files(spark, folder, tmp_path):
    (folder / "large.txt").write_text("x" * 90_000)
    spark.conf.set("spark.sql.sources.binaryFile.maxLength", "60000")
    try:
        query = watch.artifacts(spark, str(folder), max_bytes=50_000).select("name", "error_type").writeStream.format("memory").queryName(
            "limited"
        ).option("checkpointLocation", str(tmp_path / "ck2")).trigger(availableNow=True).start()
        query.awaitTermination(120)
        got = {r["name"]: r["error_type"] for r in spark.sql("select * from limited").collect()}
        assert got == {"a.txt": None, "t.xlsx": None, "p.pptx": None, "d.docx": None, "large.txt": "ArtifactTooLargeError"}
    finally:
        spark.conf.unset("spark.sql.sources.binaryFile.maxLength")


def test_precedence():
    s = settings.resolve(
        {"llm_model": "u", "restore_last_workspace": False, "recent_workspace_limit": 0, "api_key_env": "LEAFPRESS_LLM_API_KEY"},
        {"LEAFPRESS_LLM_MODEL": " e ", "MODEL_DIR": "/m", "LEAFPRESS_LLM_API_KEY": "k"}, {"recent_activity_limit": 3}
    )
    assert s["llm_model"] == ("e", settings.ENVIRONMENT, "LEAFPRESS_LLM_MODEL") and s["model_dir"] == ("/m", settings.ENVIRONMENT, "MODEL_DIR")
    assert s["restore_last_workspace"][:2] == (False, settings.USER) and s["recent_workspace_limit"][:2] == (0, settings.USER)
    assert s["recent_activity_limit"][:2] == (3, settings.RUNTIME) and s["llm_base_url"][:2] == ("", settings.DEFAULT) and s["api_key_env"][1] == settings.DEFAULT
    assert settings.secret(s, {"LEAFPRESS_LLM_API_KEY": " k "}) == "k" and answers.client(s, "k") == (None, "Not Configured")
    assert settings.plugin_dirs(["/a", "/b"], {"LEAFPRESS_PLUGIN_PATH": "/b:/c"}, ["/a", "/d"]) == [
        ("/a", settings.USER), ("/b", settings.USER), ("/c", settings.ENVIRONMENT), ("/d", settings.RUNTIME)
    ]


def test_files(spark, tmp_path):
    path = tmp_path / "x/state.json"
    settings.save_json({"recent_workspaces": [{"path": "/w", "secret": 1}, 3], "recent_activity": [{"activity_type": "other"}]}, path)
    state, errors = settings.load_state(path)
    own = "ws_" + hashlib.sha256(b"/w").hexdigest()[:12]  # an entry without an id gets that of its path
    assert state == {"recent_workspaces": [{"workspace_id": own, "path": "/w"}], "recent_activity": []} and len(errors) == 2
    path.write_text("{")
    assert settings.load_state(path)[0]["recent_workspaces"] == [] and (tmp_path / "x/state.json.corrupt").exists() and not path.exists()
    assert settings.load_config(tmp_path / "none.json") == ({}, [])
    assert settings.check({"recent_activity_limit": -1, "zzz": 1}) == ["unknown field zzz", "recent_activity_limit must be a whole number from 0"]
    for k, text in enumerate([json.dumps({"id": "a", "version": "1.0.0", "api_version": 1}), "{broken"]):
        (tmp_path / f"m{k}.json").write_text(text)
    rows = settings.manifests(spark, str(tmp_path / "m*.json")).cache().collect()
    assert sorted((r["id"] or "", r["_corrupt_record"] is not None) for r in rows) == [("", True), ("a", False)]


def test_data_source(spark, folder):
    from leafpress.sources import datasource

    datasource.register(spark)
    got = {r["name"]: (r["status"], r["provider_id"], r["n_blocks"]) for r in spark.read.format("leafpress").load(str(folder)).collect()}
    assert got == {
        "a.txt": ("ok", "text.read", 2), "t.xlsx": ("ok", "xlsx.read", 1), "p.pptx": ("ok", "pptx.read", 3),
        "d.docx": ("ok", "docx.read", 2)
    }


def test_state_that_cannot_be_saved(tmp_path):
    (tmp_path / "file").write_text("x")
    (error,) = settings.persist_state({"a": 1}, tmp_path / "file/state.json")
    assert "can't be saved" in error and (tmp_path / "file").read_text() == "x"
    assert settings.persist_state({"a": 1}, tmp_path / "state.json") == [] and json.loads((tmp_path / "state.json").read_text()) == {"a": 1}
