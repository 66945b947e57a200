"""Distillers, judges and embeddings by name; each runs inside a plan, over batches of rows.

A distiller maps (transcript, existing notes) to a list of notes {path, content, importance}; a judge
maps two texts to whether they contradict each other; an embedder maps a list of texts to vectors.
Local and hosted models are reached over HTTP with the standard library; what they answer is taken
for a note only after it has been parsed here and gone through the gates.
"""

from __future__ import annotations

import json
import os
import urllib.request
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Distiller = Callable[[str, str], list[dict]]
Judge = Callable[[str, str], bool]
Embedder = Callable[[list[str]], list[list[float]]]

DISTILLERS: dict[str, Callable[[str], Distiller]] = {}
JUDGES: dict[str, Callable[[str], Judge]] = {}
EMBEDDERS: dict[str, Callable[[str], Embedder]] = {}
#: Texts of one request, and characters of a text that an embedding sees.
BATCH, EMBED_MOST = 16, 6000
SYSTEM = (
    "From the events of a session distil durable notes. Answer with one JSON object "
    '{"memories": [{"path": "kind/name.md", "content": "...", "importance": 1-10}]}; kinds are profile, '
    "tools, project and general. Reuse the path of an existing note to update it. Leave out secrets."
)
JUDGE = "Do these two notes contradict each other, so that both can't hold? Answer yes or no.\n\n1:\n{}\n\n2:\n{}"


def register(kind: dict, name: str):
    """Enters a factory, from a model's name, into one of the registries."""

    def put(factory):
        kind[name] = factory
        return factory

    return put


def chosen(kind: dict, name: str):
    if name not in kind:
        raise ValueError(f"unknown provider {name!r}; there are {', '.join(sorted(kind)) or 'none'}")
    return kind[name]


def object_in(text: str) -> dict:
    """The outermost {...} of an answer, whatever stands around it."""
    first, last = text.find("{"), text.rfind("}")
    if first < 0 or last < first:
        raise ValueError("no JSON object in the answer")
    return json.loads(text[first : last + 1])


def _post(url: str, body: dict, headers: dict[str, str], timeout: int) -> dict:
    request = urllib.request.Request(url, json.dumps(body).encode(), {"Content-Type": "application/json"} | headers)
    with urllib.request.urlopen(request, timeout=timeout) as answer:
        return json.loads(answer.read())


def _asked(name: str, model: str, system: str, text: str, timeout: int = 600) -> str:
    """One question to a provider, by its public HTTP interface; keys come from the environment."""
    turns = [{"role": "user", "content": text}]
    if name == "anthropic":
        got = _post("https://api.anthropic.com/v1/messages", {"model": model, "max_tokens": 4096, "system": system, "messages": turns}, {"x-api-key": os.environ["ANTHROPIC_API_KEY"], "anthropic-version": "2023-06-01"}, timeout)
        return "".join(x.get("text", "") for x in got["content"])
    turns.insert(0, {"role": "system", "content": system})
    if name == "openai":
        got = _post("https://api.openai.com/v1/chat/completions", {"model": model, "messages": turns}, {"Authorization": f"Bearer {os.environ['OPENAI_API_KEY']}"}, timeout)
        return got["choices"][0]["message"]["content"] or ""
    got = _post(f"{_local()}/api/chat", {"model": model, "messages": turns, "stream": False}, {}, timeout)
    return got["message"]["content"] or ""


def _local() -> str:
    return os.environ.get("OLLAMA_HOST", "http://127.0.0.1:11434").rstrip("/")


def _register_http() -> None:
    for name in ("anthropic", "openai", "ollama"):

        def distiller(model: str, name=name) -> Distiller:
            def ask(transcript: str, existing: str) -> list[dict]:
                return object_in(_asked(name, model, SYSTEM, f"Existing notes:\n{existing}\n\nEvents:\n{transcript}")).get("memories", [])

            return ask

        def judge(model: str, name=name) -> Judge:
            def ask(a: str, b: str) -> bool:
                try:
                    return _asked(name, model, "You compare notes.", JUDGE.format(a, b), 120).strip().lower().startswith("y")
                except (OSError, KeyError, ValueError):
                    return False  # a judge that fails never hides a good note

            return ask

        DISTILLERS[name], JUDGES[name] = distiller, judge

    def local(model: str) -> Embedder:
        return lambda texts: _post(f"{_local()}/api/embed", {"model": model, "input": texts}, {}, 120)["embeddings"]

    def hosted(model: str) -> Embedder:
        return lambda texts: [x["embedding"] for x in _post("https://api.openai.com/v1/embeddings", {"model": model, "input": texts}, {"Authorization": f"Bearer {os.environ['OPENAI_API_KEY']}"}, 120)["data"]]

    EMBEDDERS.update(ollama=local, openai=hosted)


_register_http()


def embedding(embed: Embedder) -> Callable[[Column], Column]:
    """An embedder as a column function: a few texts per request, each cut; null where it fails."""

    @F.pandas_udf("array<float>")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in parts:
            out: list = []
            for at in range(0, len(texts), BATCH):
                some = [str(t or "")[:EMBED_MOST] for t in texts[at : at + BATCH]]
                try:
                    out.extend(embed(some))
                except (OSError, KeyError, ValueError):
                    out.extend([None] * len(some))
            yield pd.Series(out, index=texts.index)

    return run


def judging(judge: Judge) -> Callable[[Column, Column], Column]:
    """A judge as a function of two columns."""

    @F.pandas_udf("boolean")
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([bool(judge(x or "", y or "")) for x, y in zip(a, b, strict=True)], index=a.index)

    return run


def _notes(distiller: Distiller, text: str, existing: str) -> list[tuple]:
    """(path, content, importance) of what a distiller gives; nothing where it fails."""
    try:
        found = [x for x in distiller(text, existing) if isinstance(x, dict)]
    except (OSError, KeyError, ValueError):
        return []
    return [(x.get("path"), x.get("content"), None if x.get("importance") is None else str(x["importance"])) for x in found]


def for_sql(spark: SparkSession, name: str, distiller: Distiller | None = None, judge: Judge | None = None, embedder: Embedder | None = None, existing: str = "") -> None:
    """Gives SQL a distiller as the table function ``name(transcript)``, with a row (path, content, importance) per
    note, and one of nulls where there is none, for LATERAL joins; or a judge as the function ``name(a, b)``; or an embedder as ``name(text)``."""
    if sum(x is not None for x in (distiller, judge, embedder)) != 1:
        raise ValueError("one of distiller, judge and embedder is needed")
    if judge:
        spark.udf.register(name, judging(judge))
    elif embedder:
        spark.udf.register(name, embedding(embedder))
    else:

        class Notes:
            def eval(self, transcript: str):
                yield from _notes(distiller, transcript, existing) or [(None, None, None)]

        spark.udtf.register(name, F.udtf(Notes, returnType="path string, content string, importance string", useArrow=True))


def distilled(transcripts: DataFrame, distiller: Distiller, existing: str = "") -> DataFrame:
    """(session_key, watermark, path, content, importance) for rows (session_key, watermark, transcript):
    a row per note, and one of nulls for a session that gave none, or whose distiller failed."""

    def run(parts):
        for pdf in parts:
            rows = []
            for key, mark, text in zip(pdf["session_key"], pdf["watermark"], pdf["transcript"], strict=True):
                rows += [(key, mark, *x) for x in _notes(distiller, text, existing)] or [(key, mark, None, None, None)]
            yield pd.DataFrame(rows, columns=["session_key", "watermark", "path", "content", "importance"], dtype=object)

    return transcripts.select("session_key", "watermark", "transcript").mapInPandas(run, "session_key string, watermark string, path string, content string, importance string")
