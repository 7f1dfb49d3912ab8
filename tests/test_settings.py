import json

from assetloom.settings import TOKEN, Settings


def test_given_before_saved_before_default(tmp_path, monkeypatch):
    file = tmp_path / "settings.json"
    settings = Settings(file=str(file), default="/data/default")
    assert settings.files_at() == "/data/default"
    file.write_text(json.dumps({"folder": "/data/saved"}))
    assert settings.files_at() == "/data/saved"
    assert Settings(folder="/data/given", file=str(file)).files_at() == "/data/given"
    for broken in ("{", "[]", '{"folder": null}'):
        file.write_text(broken)
        assert settings.files_at() == "/data/default"
    monkeypatch.delenv(TOKEN, raising=False)
    assert settings.access_token() is None
    monkeypatch.setenv(TOKEN, "secret")
    assert settings.access_token() == "secret"
    assert Settings(token="own").access_token() == "own"


def test_moving_keeps_other_settings_and_survives_a_read_only_place(spark, tmp_path):
    file = tmp_path / "settings.json"
    file.write_text(json.dumps({"other": 1, "folder": str(tmp_path)}))
    moved = Settings(file=str(file)).moved(spark, "/data/new")
    assert moved.files_at() == "/data/new"
    assert json.loads(file.read_text()) == {"other": 1, "folder": "/data/new"}
    assert Settings(file=str(file)).files_at() == "/data/new"
    nowhere = Settings(file=str(tmp_path / "none" / "settings.json"), default=str(tmp_path))
    assert nowhere.moved(spark, "/data/new").files_at() == "/data/new"
