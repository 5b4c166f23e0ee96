import json

import pytest

from leafpress.__main__ import main
from leafpress.operators import runtime, settings
from leafpress.sources import plugins as P
from leafpress.sources import readers as R

CODE = """
from leafpress.sources.readers import ReaderSpec

def read(data):
    return {"content": "own:" + data.decode()}, [{"block_type": "paragraph", "text": "own"}]

class Plugin:
    def readers(self):
        return [ReaderSpec("mark.read", ("wrong",), read, priority=1)]
"""


def write(folder, name, code=CODE, module="plugin", **changes):
    own = folder / name
    place = own / (module.replace(".", "/") + ".py")
    place.parent.mkdir(parents=True)
    if "." in module:
        (own / module.split(".")[0] / "__init__.py").write_text("")
    place.write_text(code)
    manifest = {
        "id": f"ext.{name}", "name": name, "version": "1.0.0", "api_version": 1, "entrypoint": {"module": module, "class": "Plugin"},
        "accepts": {"extensions": [".MD"]}, "capabilities": [{"id": P.CAPABILITY, "priority": 100}], "permissions": ["filesystem.read"]
    }
    (own / "plugin.json").write_text(json.dumps(manifest | changes))


@pytest.fixture
def folder(tmp_path):
    write(tmp_path, "a")
    write(tmp_path, "b", CODE.replace("mark.read", "pack.read"), module="own.plugin", accepts={"extensions": ["zzz"]})
    write(tmp_path, "c", "raise KeyError('at import')")
    write(tmp_path, "d", id="ext.a")
    write(tmp_path, "e", api_version=2)
    write(tmp_path, "f", id="ext.off", accepts={"extensions": ["off"]}, code=CODE.replace("mark.read", "off.read"))
    write(tmp_path, "g")  # a reader of the same id
    write(tmp_path, "h", CODE.replace("mark.read", "win.read"), platforms=["no-such-platform"], accepts={"extensions": ["win"]})
    (tmp_path / "i").mkdir()
    (tmp_path / "i/plugin.json").write_text("{")
    (tmp_path / "none").mkdir()
    return str(tmp_path)


def test_assembly(spark, folder):
    a = P.assemble([folder, folder + "/missing"], ["ext.off"])
    state = {(i, s): e for i, _, _, source, s, e in a.report if source == P.EXTERNAL}
    assert set(state) == {
        ("ext.a", "loaded"), ("ext.b", "loaded"), ("ext.c", "failed"), ("ext.a", "failed"), ("ext.e", "failed"), ("ext.off", "disabled"),
        ("ext.g", "failed"), ("ext.h", "loaded"), ("i", "failed"), ("missing", "failed")
    }
    assert "KeyError" in state["ext.c", "failed"] and "duplicate plugin" in state["ext.a", "failed"] and "api_version" in state["ext.e", "failed"] and "duplicate reader" in state["ext.g", "failed"]
    own = next(s for s in a.specs if s.provider_id == "mark.read")
    assert (own.priority, own.extensions, own.plugin_id, own.declared) == (100, ("md",), "ext.a", ("filesystem.read",))  # the manifest's word holds
    assert a.only_disabled("off") and not a.only_disabled("md") and not a.enable("ext.off").only_disabled("off")
    assert [s.provider_id for s in a.disable("text").specs if "txt" in s.extensions] == []
    files = spark.createDataFrame([("/w/a.md", b"x"), ("/w/b.zzz", b"y"), ("/w/c.win", b"z"), ("/w/d.txt", b"t")], "path string, content binary")
    got = {r["name"]: (r["provider_id"], r["plugin_id"], r["content"], r["error_type"]) for r in R.read(files, readers=a.specs).collect()}
    assert got == {
        "a.md": ("mark.read", "ext.a", "own:x", None), "b.zzz": ("pack.read", "ext.b", "own:y", None),
        "c.win": (None, None, None, "ProviderNotAvailableError"), "d.txt": ("text.read", "text", "t", None)
    }
    status = {
        r["plugin_id"]: r["status"]
        for r in runtime.plugin_status(a.plugins(spark).dropDuplicates(["plugin_id"]), a.providers(spark)).collect()
    }
    assert status["ext.off"] == "Disabled" and status["ext.e"] == "Incompatible" and status["ext.c"] == "Load Failed" and status["ext.h"] == "Unavailable" and status["docx"] == "Enabled"


def test_rescan_and_manifests(folder, tmp_path):
    a = P.assemble([folder])
    write(tmp_path, "z", CODE.replace("mark.read", "late.read"))
    assert "late.read" not in {s.provider_id for s in a.specs} and "late.read" in {s.provider_id for s in a.rescan().specs}
    m = next(f.manifest for f in P.discover([folder]) if f.manifest)
    assert P.Manifest.of(m.to_dict()) == m
    for bad in (
        None, [], {}, m.to_dict() | {"permissions": ["root"]}, m.to_dict() | {"id": "Bad Id"},
        m.to_dict() | {"capabilities": [{"id": "x"}, {"id": "x"}]}
    ):
        with pytest.raises(P.PluginError):
            P.Manifest.of(bad)


def test_command_line(spark, tmp_path):
    (tmp_path / "a.txt").write_text("one\ntwo")
    (tmp_path / "big.txt").write_text("x" * (2 << 20))
    said = []
    run = lambda *args: main([str(a) for a in args], spark=spark, say=said.append)
    assert run(tmp_path) == 0 and len(said) == 3 and said[0].startswith("txt: 2, ") and run(tmp_path / "none", "--scan") == 1
    said.clear()
    assert run(tmp_path / "a.txt", "--no-llm", "--show-context") == 0 and "a.txt" in said[0] and "[Paragraph] two" in said[1]
    assert run(tmp_path / "big.txt", "--max-size-mb", 1) == 1 and "ArtifactTooLargeError" in said[-1]
    assert run(tmp_path / "nothing.txt") == 1 and run(tmp_path / "a.txt") == 0 and "Not Configured" in said[-1]


def test_questions_from_arguments_and_files(spark, tmp_path, monkeypatch):
    from leafpress.operators import answers

    (tmp_path / "a.txt").write_text("one")
    (tmp_path / "asked").write_text("second?\n\n third? \n")
    monkeypatch.setattr(answers, "client", lambda *a: (answers.FixedReply("yes"), "ok"))
    said = []
    args = [str(tmp_path / "a.txt"), "--question", "first?", "--questions", str(tmp_path / "asked")]
    assert main(args, spark=spark, say=said.append) == 0
    assert said[1:] == ["first?\nyes", "second?\nyes", "third?\nyes"]


def test_paths_and_state(tmp_path):
    assert settings.data_dir({"LEAFPRESS_DATA_DIR": "/x"}) == settings.config_path({"LEAFPRESS_DATA_DIR": "/x"}).parent == settings.logs_dir({"LEAFPRESS_DATA_DIR": "/x"}).parent
    assert str(settings.data_dir({"APPDATA": "/app"}, "win32")) == "/app/leafpress" and str(
        settings.data_dir({"XDG_DATA_HOME": "/d"}, "linux")
    ) == "/d/leafpress"
    assert str(settings.state_path({"LEAFPRESS_STATE": "/s.json"})) == "/s.json"
    path = tmp_path / "state.json"
    settings.save_json(
        {
            "recent_workspaces": [{"path": "/w", "workspace_id": "old-random"}, {"path": "/v", "workspace_id": "ws_1"}],
            "recent_activity": [{"activity_type": "artifact"}]
        },
        path
    )
    state, errors = settings.load_state(path)
    assert not errors and state["recent_workspaces"][0]["workspace_id"].startswith("ws_") and state["recent_workspaces"][1]["workspace_id"] == "ws_1" and state["recent_activity"][0]["entry_id"]
    assert len(settings.check({"schema_version": 9, "llm_model": 3, "restore_last_workspace": "yes", "llm_base_url": "ftp://x"})) == 4
