"""What a model or a network would do, behind small protocols with deterministic stand-ins."""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .constants import CLUSTER_COSINE, SAME_EVENT_CONFIDENCE


class ChatModel(Protocol):
    def complete(self, messages: list[dict], **options) -> dict: ...

    def stream(self, messages: list[dict], **options) -> Iterator[str]: ...


class StubChat:
    """Answers with what stands after the last mark 答： or else with the start of the last message."""

    def complete(self, messages: list[dict], **options) -> dict:
        text = messages[-1]["content"] if messages else ""
        answer = text.rpartition("答：")[2][:300] if "答：" in text else text[:300]
        used = sum(len(m["content"]) // 2 + 4 for m in messages) + 3
        return {"content": answer, "model": "stub", "finish_reason": "stop", "usage": {"prompt_tokens": used, "completion_tokens": len(answer) // 2}}

    def stream(self, messages: list[dict], **options) -> Iterator[str]:
        yield from self.complete(messages, **options)["content"]


class HttpChat(StubChat):
    """Any server with the common chat interface; not used unless named."""

    def __init__(self, base_url: str, model: str, key: str = "", timeout: float = 60):
        self.base_url, self.model, self.key, self.timeout = base_url.rstrip("/"), model, key, timeout

    def complete(self, messages: list[dict], **options) -> dict:
        import urllib.request

        body = json.dumps({"model": self.model, "messages": messages, **options}).encode()
        req = urllib.request.Request(f"{self.base_url}/chat/completions", body, {"Content-Type": "application/json", "Authorization": f"Bearer {self.key}"})  # noqa: S310
        with urllib.request.urlopen(req, timeout=self.timeout) as r:  # noqa: S310
            got = json.load(r)
        one = got["choices"][0]
        return {"content": one["message"]["content"], "model": got.get("model", self.model), "finish_reason": one.get("finish_reason"), "usage": got.get("usage", {})}


CHAT = {"stub": StubChat, "openai": HttpChat, "qwen": HttpChat, "azure": HttpChat, "openai_compatible": HttpChat}


def chat_model(name: str = "stub", **options) -> ChatModel:
    if name not in CHAT:
        raise ValueError(f"no such provider: {name}; there are {', '.join(CHAT)}")
    return CHAT[name](**options)


def hashed_vector(text: str, dim: int = 64) -> list[float]:
    """Counts of hashed character pairs, of length one: the stand-in for an embedding model."""
    v = np.zeros(dim)
    for a, b in zip(text, text[1:], strict=False):
        v[zlib.crc32((a + b).encode("utf-8", "surrogatepass")) % dim] += 1
    n = np.linalg.norm(v)
    return (v / n if n else v).tolist()


def embed(df: DataFrame, text: str, out: str = "x", dim: int = 64) -> DataFrame:
    """df with a vector of each text, from Arrow batches; empty texts have the zero vector."""

    @F.pandas_udf("array<double>")
    def vectors(s: pd.Series) -> pd.Series:
        return s.fillna("").map(lambda t: hashed_vector(t, dim))

    return df.withColumn(out, vectors(F.col(text)))


def same_event(jaccard: Column, cosine: Column | None = None) -> tuple[Column, Column]:
    """(same, confidence): the stand-in for a model that judges whether an item tells of its leader's event."""
    conf = F.least(F.lit(1.0), F.lit(0.6) + jaccard / 2)
    return conf >= SAME_EVENT_CONFIDENCE if cosine is None else (conf >= SAME_EVENT_CONFIDENCE) & (cosine >= CLUSTER_COSINE), conf


def judge_batch(df: DataFrame, prompt: str, provider: str = "stub", parallel: int = 5, **options) -> DataFrame:
    """df with the model's answer to each prompt, `parallel` partitions at a time; errors are answers with a status."""
    schema = df.schema.add("answer", "string").add("status", "string")

    def run(batches):
        model = chat_model(provider, **options)
        for b in batches:
            answers, status = [], []
            for p in b[prompt]:
                try:
                    answers.append(model.complete([{"role": "user", "content": p or ""}])["content"])
                    status.append("success")
                except Exception as x:  # one bad call is one bad row
                    answers.append(str(x)[:500])
                    status.append("failed")
            yield b.assign(answer=answers, status=status)

    return df.repartition(parallel).mapInPandas(run, schema)
