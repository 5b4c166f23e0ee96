"""Questions to a language model over contexts: the client, and answers as a DataFrame."""

from __future__ import annotations

import json
import urllib.error
import urllib.request
from collections.abc import Callable
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame

from leafpress.operators import context as C


class ModelError(RuntimeError):
    """The model could not be asked, or its reply not understood."""


@dataclass(frozen=True)
class ChatClient:
    """A chat-completions endpoint."""

    base_url: str
    model: str
    api_key: str = ""
    timeout: float = 60.0

    def __call__(self, system: str, user: str) -> str:
        body = {"model": self.model, "temperature": 0, "messages": [{"role": "system", "content": system}, {"role": "user", "content": user}]}
        request = urllib.request.Request(
            f"{self.base_url.rstrip('/')}/chat/completions", json.dumps(body).encode(),
            {"Content-Type": "application/json", "Authorization": f"Bearer {self.api_key}"}
        )
        try:
            with urllib.request.urlopen(request, timeout=self.timeout) as r:
                return json.loads(r.read())["choices"][0]["message"]["content"]
        except urllib.error.HTTPError as e:
            raise ModelError(f"HTTP {e.code}: {e.read(2000).decode('utf-8', 'replace')}") from e
        except (OSError, ValueError, KeyError, IndexError, TypeError) as e:
            raise ModelError(f"{type(e).__name__}: {e}") from e


@dataclass(frozen=True)
class FixedReply:
    """For tests and demonstrations: always the same answer."""

    reply: str = "(no model was asked)"

    def __call__(self, system: str, user: str) -> str:
        return self.reply


def client(settings: dict, key: str) -> tuple[Callable | None, str]:
    """A client from settings, or none and why; never raises."""
    url, model = (str(settings[k][0]).strip() for k in ("llm_base_url", "llm_model"))
    if not url or not model:
        return None, "Not Configured"
    if not url.startswith(("http://", "https://")):
        return None, "Error"
    return ChatClient(url, model, key), "Ready"


def ask(contexts: DataFrame, question: str, model: Callable[[str, str], str]) -> DataFrame:
    """(artifact_id, answer, error) per context. The question itself is kept nowhere."""

    def run(batches):
        for b in batches:
            answers, errors = [], []
            for system, user in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                try:
                    answers.append(model(system, user))
                    errors.append(None)
                except ModelError as e:
                    answers.append(None)
                    errors.append(str(e))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(answers, pa.string()), pa.array(errors, pa.string())], ["artifact_id", "answer", "error"]
            )

    return C.prompt(contexts, question).select("artifact_id", "system", "prompt").mapInArrow(run, "artifact_id string, answer string, error string")
