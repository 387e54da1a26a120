"""Translation services over HTTP, as providers of the memory.

A provider says how its requests look and how replies are read; a transport sends them. The default transport uses the
standard library; tests give one of their own. Keys live in the provider object on its way to the tasks, never in a
DataFrame.
"""

from __future__ import annotations

import hashlib
import json
import re
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from urllib.error import HTTPError
from urllib.parse import quote, urlencode
from urllib.request import Request, urlopen

from glossloom.functions.text import LANGUAGE_CODES, OTHER_LANGUAGE

TIMEOUT = 20


@dataclass(frozen=True)
class Call:
    url: str
    body: bytes | None = None
    headers: tuple[tuple[str, str], ...] = ()


Transport = Callable[[Call], object]


def over_http(call: Call) -> object:
    """The reply's JSON. Errors name the status, by which the memory's retries tell rate limits."""
    try:
        with urlopen(Request(call.url, call.body, dict(call.headers)), timeout=TIMEOUT) as reply:
            return json.loads(reply.read().decode("utf-8"))
    except HTTPError as e:
        raise RuntimeError(f"HTTP {e.code}") from e


@dataclass
class Service:
    """Sends batches of `batch` texts, with `pause` seconds after each call."""

    key: str = ""
    transport: Transport = over_http
    sleep: Callable[[float], None] = time.sleep
    name: str = field(default="", init=False)
    batch: int = field(default=1, init=False)
    pause: float = field(default=0.0, init=False)
    needs_key: bool = field(default=False, init=False)

    def call(self, texts: list[str], lang: str) -> Call:
        raise NotImplementedError

    def read(self, reply, n: int) -> list[str]:
        raise NotImplementedError

    def code(self, lang: str) -> str:
        return LANGUAGE_CODES.get(self.name, {}).get(lang, OTHER_LANGUAGE.get(self.name, lang))

    def translate(self, texts: list[str], target_lang: str) -> list[str]:
        if self.needs_key and not self.key:
            raise RuntimeError(f"{self.name} needs a key")
        out: list[str] = []
        for at in range(0, len(texts), self.batch):
            part = texts[at : at + self.batch]
            out += self.read(self.transport(self.call(part, target_lang)), len(part))
            if self.pause:
                self.sleep(self.pause)
        return out


@dataclass
class MyMemory(Service):
    def __post_init__(self) -> None:
        self.name, self.pause = "mymemory", 0.12

    def call(self, texts: list[str], lang: str) -> Call:
        return Call(f"https://api.mymemory.translated.net/get?q={quote(texts[0], safe='')}&langpair=Autodetect|{lang}")

    def read(self, reply, n: int) -> list[str]:
        text = ((reply or {}).get("responseData") or {}).get("translatedText")
        return [text if isinstance(text, str) else ""]


@dataclass
class Google(Service):
    def __post_init__(self) -> None:
        self.name, self.pause = "google", 0.15

    def call(self, texts: list[str], lang: str) -> Call:
        return Call("https://translate.googleapis.com/translate_a/single?" + urlencode({"client": "gtx", "sl": "auto", "tl": lang, "dt": "t", "q": texts[0]}))

    def read(self, reply, n: int) -> list[str]:
        return ["".join(piece[0] or "" for piece in (reply or [[]])[0] or [] if piece)]


@dataclass
class DeepL(Service):
    def __post_init__(self) -> None:
        self.name, self.batch, self.needs_key = "deepl", 50, True

    def call(self, texts: list[str], lang: str) -> Call:
        body = urlencode([("target_lang", self.code(lang)), *(("text", t) for t in texts)]).encode()
        return Call("https://api-free.deepl.com/v2/translate", body, (("Authorization", f"DeepL-Auth-Key {self.key}"),))

    def read(self, reply, n: int) -> list[str]:
        return [t["text"] for t in reply.get("translations", [])]


@dataclass
class Baidu(Service):
    """Five lines a request, signed with the MD5 of id, text, salt and key."""

    app_id: str = ""
    clock: Callable[[], float] = time.time

    def __post_init__(self) -> None:
        self.name, self.batch, self.needs_key = "baidu", 5, True

    def call(self, texts: list[str], lang: str) -> Call:
        q, salt = "\n".join(texts), str(int(self.clock() * 1000))
        sign = hashlib.md5(f"{self.app_id}{q}{salt}{self.key}".encode()).hexdigest()
        return Call("https://fanyi-api.baidu.com/api/trans/vip/translate?" + urlencode({"q": q, "from": "auto", "to": self.code(lang), "appid": self.app_id, "salt": salt, "sign": sign}))

    def read(self, reply, n: int) -> list[str]:
        if reply.get("error_code"):
            raise RuntimeError(f"baidu {reply['error_code']} {reply.get('error_msg', '')}")
        return [t["dst"] for t in reply.get("trans_result", [])]


@dataclass
class ChatModel(Service):
    """A chat model behind an OpenAI-like address: eight numbered lines a request, put back by their numbers."""

    model: str = ""
    base_url: str = "http://127.0.0.1:11434/v1"

    def __post_init__(self) -> None:
        self.name, self.batch = "openai", 8

    def call(self, texts: list[str], lang: str) -> Call:
        lines = "\n".join(f"[{i}] {t}" for i, t in enumerate(texts))
        prompt = f"Translate each of these lines into {self.code(lang)}. Keep meaning, tone and the [number] at the start; one line for each line, nothing else.\n{lines}"
        body = json.dumps({"model": self.model, "messages": [{"role": "system", "content": prompt}], "temperature": 0.3}).encode()
        key = (("Authorization", f"Bearer {self.key}"),) if self.key else ()
        return Call(self.base_url.rstrip("/") + "/chat/completions", body, (("Content-Type", "application/json"), *key))

    def read(self, reply, n: int) -> list[str]:
        choice = (reply.get("choices") or [{}])[0]
        content = (choice.get("message") or {}).get("content") or ""
        found = {int(k): t.strip() for k, t in re.findall(r"(?m)^\s*\[\s*(\d+)\s*\][^\S\n]*(.*)$", content)}
        return [found.get(i, "") for i in range(n)]


SERVICES = {"mymemory": MyMemory, "google": Google, "deepl": DeepL, "openai": ChatModel, "baidu": Baidu}
