"""Requests and replies of the services, without a network."""

import hashlib
import json
from urllib.parse import parse_qs, urlsplit

import pytest

from glossloom import config
from glossloom.operators import providers as P


class Wire:
    def __init__(self, *replies):
        self.replies, self.calls = list(replies), []

    def __call__(self, call):
        self.calls.append(call)
        return self.replies.pop(0)


def test_single_text_services():
    slept = []
    w = Wire({"responseData": {"translatedText": "eins"}}, {"responseData": None})
    assert P.MyMemory(transport=w, sleep=slept.append).translate(["a&b", "c"], "de") == ["eins", ""]
    assert slept == [0.12, 0.12] and "q=a%26b&langpair=Autodetect|de" in w.calls[0].url
    w = Wire([[["ei", "x"], None, ["ns"]]])
    assert P.Google(transport=w, sleep=slept.append).translate(["a"], "de") == ["eins"]


def test_deepl():
    w = Wire({"translations": [{"text": "1"}, {"text": "2"}]})
    assert P.DeepL(key="k", transport=w).translate(["a", "b"], "ja") == ["1", "2"]
    assert parse_qs(w.calls[0].body.decode()) == {"target_lang": ["JA"], "text": ["a", "b"]}
    with pytest.raises(RuntimeError, match="key"):
        P.DeepL(transport=w).translate(["a"], "ja")


def test_baidu_signs_and_batches():
    w = Wire({"trans_result": [{"dst": str(i)} for i in range(5)]}, {"error_code": "54003", "error_msg": "slow"})
    b = P.Baidu(key="k", app_id="id", transport=w, clock=lambda: 1.5)
    with pytest.raises(RuntimeError, match="54003 slow"):
        b.translate(list("abcdef"), "zh-CN")
    q = parse_qs(urlsplit(w.calls[0].url).query)
    assert q["q"] == ["a\nb\nc\nd\ne"] and q["to"] == ["zh"] and q["sign"] == [hashlib.md5(b"ida\nb\nc\nd\ne1500k").hexdigest()]


def test_chat_model_realigns():
    w = Wire({"choices": [{"message": {"content": "noise\n[1] zwei\n [0]eins"}}]}, {"choices": []})
    m = P.ChatModel(key="k", model="m", transport=w)
    assert m.translate(list("abcdefgh") + ["i"], "en") == ["eins", "zwei", *[""] * 7]
    assert json.loads(w.calls[0].body)["temperature"] == 0.3 and w.calls[0].url.endswith("/v1/chat/completions")


def test_settings(tmp_path):
    at = tmp_path / "s.json"
    assert config.load(at) == config.Settings()
    config.save(config.Settings(concurrency=99, max_mb=500), at)
    assert (config.load(at).concurrency, config.load(at).max_mb) == (10, 200)
    at.write_text('{"target_lang": "en", "api_key": "x"}')
    assert config.load(at).target_lang == "en"


def test_export_formats():
    assert config.export_formats({"text"}) == {"md", "docx", "pdf"}
    assert config.export_formats({"empty"}) == {"md", "docx"}
    assert config.export_formats({"image", "empty"}) == {"md", "docx", "pdf", "txt"}
